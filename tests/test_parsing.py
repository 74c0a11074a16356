"""Q3 (answer regex) and Q4 (segment JSON) on hand-made texts."""

from flowlens.functions.parsing import extract_answer, parse_segments
from flowlens.functions.text import py_strip


def _one(spark, expr_fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {typ}")
    return [r.o for r in df.select("i", expr_fn("t").alias("o")).orderBy("i").collect()]


def test_extract_answer_cases(spark):
    texts = [
        "The answer is \\answer{ Invoice processing }",   # stripped
        "\\answer{}",                                       # empty -> '' (later Other)
        "I am not sure.",                                   # no match -> null (Format Error)
        "\\answer{Invoice\nprocessing}",                    # newline inside braces: no match
        "\\answer{A} and \\answer{B}",                      # first one wins
        "\\answer{\tTab\u00a0}",                            # Unicode-aware strip
        "\\answer{x\r}",                                    # carriage return is not a line end for Python
        None,
    ]
    assert _one(spark, extract_answer, texts) == ["Invoice processing", "", None, None, "A", "Tab", "x", None]


def test_py_strip_matches_python(spark):
    vals = [" a ", "\t\nb\x1c", "\u3000c\u2029", "d", "", "\x85e\xa0"]
    got = _one(spark, py_strip, vals)
    assert got == [v.strip() for v in vals]


def _segs(spark, texts):
    out = _one(spark, lambda c: parse_segments(c), texts)
    return [[(s.start_index, s.end_index) for s in o] for o in out]


def test_parse_segments_cases(spark):
    texts = [
        '<answer>[{"start_index": 0, "end_index": 5}, {"start_index": 6, "end_index": 9}]</answer>',
        'x <answer>\n [{"start_index": "6", "end_index": 2.7}, {"start_index": true, "end_index": 3}] \n</answer>',
        '<answer>[{"start_index": 0}, {"start_index": 4, "end_index": 5}]</answer>',   # missing key: skipped
        '<answer>[{"start_index": "abc", "end_index": 5}]</answer>',                 # int('abc') voids all
        '<answer>[{"start_index": "7.9", "end_index": 5}]</answer>',                 # int('7.9') voids all
        '<answer>[{"start_index": null, "end_index": 5}]</answer>',                  # TypeError -> []
        '<answer>[1, 2]</answer>',                                                    # number list -> []
        '<answer>{"start_index": 0, "end_index": 5}</answer>',                       # top-level object -> []
        '<answer>[{"start_index": 0, "end_index": 5</answer>',                       # bad JSON -> []
        'no tag at all',
        '<answer>["abc", {"start_index": 1, "end_index": 2}]</answer>',              # string element skipped
        '<answer>[{"start_index": -2.9, "end_index": 1e1}]</answer>',                # truncation toward zero
    ]
    assert _segs(spark, texts) == [
        [(0, 5), (6, 9)], [(6, 2), (1, 3)], [(4, 5)], [], [], [], [], [], [], [], [(1, 2)], [(-2, 10)]]
