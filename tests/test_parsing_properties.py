"""Answer, segment and display-name parsing: tables of input and expected output, and properties."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowlens.functions.parsing import extract_answer, parse_segments
from flowlens.functions.text import DISPLAY_NAME_MAP, display_name

ONCE = settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column("t").alias("v")).orderBy("i").collect()]


def segments(spark, texts):
    return [[tuple(s) for s in found] for found in run(spark, texts, parse_segments)]


SEGMENTS = {
    'pre <answer> [{"start_index": 0, "end_index": 4}] </answer>': [(0, 4)],
    '<answer>[{"start_index": "6", "end_index": " 7 "}]</answer>': [(6, 7)],
    '<answer>[{"start_index": 2.9, "end_index": -2.9}]</answer>': [(2, -2)],
    '<answer>[{"start_index": true, "end_index": false}]</answer>': [(1, 0)],
    '<answer>[{"start_index": "1_0", "end_index": "+3"}]</answer>': [(10, 3)],
    '<answer>[{"start_index": 1}, {"start_index": 2, "end_index": 3}]</answer>': [(2, 3)],
    '<answer>[{"start_index": 1, "end_index": 2}, "abc"]</answer>': [(1, 2)],
    '<answer>[{"start_index": 1, "end_index": 2}, 5]</answer>': [],
    '<answer>[{"start_index": 1, "end_index": 2}, {"start_index": "x", "end_index": 2}]</answer>': [],
    '<answer>[{"start_index": null, "end_index": 2}]</answer>': [],
    '<answer>["start_index end_index"]</answer>': [],
    '<answer>[["start_index", "end_index"]]</answer>': [],
    '<answer>[["x"]]</answer>': [],
    '<answer>{"start_index": 1, "end_index": 2}</answer>': [],
    '<answer>[{]</answer>': [],
    '<answer></answer>': [],
    '<answer>null</answer>': [],
    '<answer>[{"start_index": 1, "end_index": 2}]</answer><answer>[]</answer>': [(1, 2)],
    '[{"start_index": 1, "end_index": 2}]': [],
    '<answer>[{"start_index": 1,\n "end_index": 2}]\n</answer>': [(1, 2)],
}


def test_segment_table(spark):
    assert segments(spark, list(SEGMENTS)) == list(SEGMENTS.values())


pair = st.tuples(st.integers(-50, 50), st.integers(-50, 50))
keyless = st.sampled_from([{"start_index": 1}, {"end_index": 1}, {}, {"start": 1, "end": 2}])


@ONCE
@given(st.lists(st.lists(st.one_of(pair, keyless), max_size=5), min_size=120, max_size=120))
def test_segments_come_back_in_order_and_keyless_objects_never_appear(spark, answers):
    texts = ["<answer>" + json.dumps([{"start_index": p[0], "end_index": p[1]} if isinstance(p, tuple) else p for p in a]) + "</answer>"
             for a in answers]
    assert segments(spark, texts) == [[p for p in a if isinstance(p, tuple)] for a in answers]


ANSWERS = {
    "\\answer{Invoice}": "Invoice",
    "text \\answer{ a b } more": "a b",
    "\\answer{}": "",
    "\\answer{ \t}": "",
    "\\answer{one}\\answer{two}": "one",
    "\\answer{a\nb}": None,
    "\\answer{a\nb} \\answer{c}": "c",
    "\\answer{a{b}c}": "a{b",
    "\\answer{open": None,
    "answer{x}": None,
    "": None,
    "\\answer{\u00a0x\u00a0}": "x",
}


def test_answer_table(spark):
    assert run(spark, list(ANSWERS), extract_answer) == list(ANSWERS.values())


@ONCE
@given(st.lists(st.text("abc {\\.", max_size=10), min_size=100, max_size=100), st.text("xyz ", max_size=5))
def test_a_marked_answer_comes_back_stripped(spark, bodies, before):
    assert run(spark, [f"{before}\\answer{{{b}}}}} tail" for b in bodies], extract_answer) == [b.strip() for b in bodies]


NAMES = {
    "q": "Q",
    "Xy": "Xy",
    "ab_cd": "Ab Cd",
    "hr_q_1": f"{DISPLAY_NAME_MAP.get('hr', 'Hr')} - Q 1",
    "abCD": "Abcd",
}


def test_display_names(spark):
    domains = ["finance", "hr", "legal"]
    known = list(DISPLAY_NAME_MAP)
    got = run(spark, [*NAMES, *known], lambda c: display_name(c, domains))
    assert got[:len(NAMES)] == list(NAMES.values())
    assert got[len(NAMES):] == [DISPLAY_NAME_MAP[k] for k in known]
