"""Independent DuckDB SQL for each registered query (tables are pre-registered views).

Written from the operator semantics, not from the Spark code: hashes use DuckDB's md5, order
uses ordered aggregates and window functions, arrays use list functions.
"""

from __future__ import annotations

from flowlens.sources.testdata import DOMAINS, EVENT_PROCESS, FOLDED_MODEL, MODELS, PROCESS_NAMES


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


NAMES = _list(PROCESS_NAMES)


def h(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


WF = f"""wf AS (
  SELECT 'wf-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '-' || CAST(blk AS VARCHAR) AS process_instance_uuid,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS time_stamp,
         CASE WHEN event_id % 29 = 0 AND user_id % 3 = 2 THEN '{EVENT_PROCESS}'
              ELSE {NAMES}[CAST((user_id + blk) % 7 AS INTEGER) + 1] END AS process_name,
         'app_' || CAST(event_id % 5 AS VARCHAR) AS application_name,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS description,
         'screen_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS VARCHAR) AS screen_name,
         event_id AS event_seq,
         {_list(DOMAINS)}[CAST(user_id % 3 AS INTEGER) + 1] AS domain
  FROM (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT) AS blk
        FROM events) e)"""

INST = """inst AS (
  SELECT domain, process_instance_uuid AS workflow_id,
         first(process_name ORDER BY time_stamp ASC NULLS LAST, event_seq) AS process_name,
         count(*) AS n_events
  FROM wf WHERE process_instance_uuid IS NOT NULL GROUP BY domain, process_instance_uuid)"""

LABELS = """labels AS (
  SELECT domain, process_name, CAST(row_number() OVER (PARTITION BY domain ORDER BY process_name) - 1 AS INTEGER) AS label_id
  FROM (SELECT DISTINCT domain, process_name FROM wf WHERE process_name IS NOT NULL) d)"""

_HR = h("'resp'", "model", "workflow_id")
_V = f"CASE WHEN model = '{FOLDED_MODEL}' THEN {_HR} % 80 ELSE {_HR} % 100 END"

RESP = f"""resp AS (
  SELECT domain, model, workflow_id,
    CASE WHEN v < 55 THEN 'Looking at the screens, this is \\answer{{ ' || process_name || ' }}'
         WHEN v < 80 THEN '\\answer{{' || {NAMES}[CAST((p + 1 + v % 3) % 7 AS INTEGER) + 1] || '}}'
         WHEN v < 86 THEN '\\answer{{Something else}}'
         WHEN v < 90 THEN 'I am not sure.'
         WHEN v < 93 THEN '\\answer{{}}'
         WHEN v < 96 THEN '\\answer{{' || process_name || chr(10) || '}}'
         ELSE 'First \\answer{{' || process_name || '}}, then \\answer{{' || {NAMES}[CAST((p + 1 + v % 3) % 7 AS INTEGER) + 1] || '}}'
    END AS generated_text,
    -- expected outcome of each variant, written from the variant table (not by parsing)
    CASE WHEN v < 55 THEN process_name
         WHEN v < 80 THEN {NAMES}[CAST((p + 1 + v % 3) % 7 AS INTEGER) + 1]
         WHEN v < 86 THEN 'Something else'
         WHEN v < 90 THEN NULL
         WHEN v < 93 THEN ''
         WHEN v < 96 THEN NULL
         ELSE process_name END AS answer
  FROM (SELECT i.*, m.model, coalesce(list_position({NAMES}, i.process_name), 0) - 1 AS p,
               {_V} AS v
        FROM inst i, (SELECT unnest({_list(MODELS)}) AS model) m) x)"""

DETAILED = """detailed AS (
  SELECT r.domain, r.model, r.workflow_id, i.process_name AS true_class,
         CASE WHEN r.answer IS NULL THEN 'Format Error'
              WHEN l.process_name IS NULL THEN 'Other' ELSE r.answer END AS predicted_class,
         i.process_name = (CASE WHEN r.answer IS NULL THEN 'Format Error'
              WHEN l.process_name IS NULL THEN 'Other' ELSE r.answer END) AS correct
  FROM resp r JOIN inst i ON r.domain = i.domain AND r.workflow_id = i.workflow_id
  LEFT JOIN labels l ON l.domain = r.domain AND l.process_name = r.answer)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CLS = with_(WF, INST, LABELS, RESP, DETAILED)

REPORT = """report AS (
  SELECT t.domain, t.model, t.label, 
         CASE WHEN coalesce(p.n_pred, 0) = 0 THEN 0.0 ELSE t.tp / p.n_pred END AS precision,
         CASE WHEN t.support = 0 THEN 0.0 ELSE t.tp / t.support END AS recall,
         t.support
  FROM (SELECT domain, model, true_class AS label, count(*) AS support,
               sum(CASE WHEN correct THEN 1 ELSE 0 END) AS tp
        FROM detailed GROUP BY ALL) t
  LEFT JOIN (SELECT domain, model, predicted_class AS label, count(*) AS n_pred FROM detailed GROUP BY ALL) p
    USING (domain, model, label)),
report_f AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
  FROM report)"""

ORACLES: dict[str, str] = {}
# DuckDB's round keeps a negative zero where Spark's decimal rounding gives +0.0; "+ 0.0" maps
# -0.0 to +0.0 in the queries whose values can be tiny negatives.

ORACLES["load_events"] = with_(WF) + """SELECT process_instance_uuid, process_name, application_name, description,
  screen_name, event_seq, domain FROM wf"""

ORACLES["coerce_timestamps"] = with_(WF) + """SELECT event_seq, process_instance_uuid,
  strftime(time_stamp, '%Y-%m-%d %H:%M:%S.%f') AS time_stamp FROM wf"""

ORACLES["event_descriptions"] = with_(WF) + """SELECT event_seq,
  coalesce(description, 'None') || ' in the screen ' || coalesce(screen_name, 'None') || ' of the application '
  || coalesce(application_name, 'None') AS event_text FROM wf"""

ORACLES["event_text_strict"] = with_(WF) + """SELECT event_seq,
  description || ' in the screen ' || screen_name || ' of the application ' || application_name AS event_text FROM wf"""

ORACLES["label_encoding"] = with_(WF, INST, LABELS) + "SELECT domain, process_name, label_id FROM labels"

ORACLES["workflow_instances"] = with_(WF, INST, LABELS) + """SELECT i.domain, i.workflow_id, i.process_name, i.n_events, l.label_id
  FROM inst i LEFT JOIN labels l USING (domain, process_name)"""

ORACLES["event_positions"] = with_(WF) + """SELECT domain, process_instance_uuid, event_seq,
  row_number() OVER (PARTITION BY domain, process_instance_uuid ORDER BY time_stamp ASC NULLS LAST, event_seq) - 1 AS pos
  FROM wf WHERE process_instance_uuid IS NOT NULL"""

ORACLES["instance_texts"] = with_(WF) + """SELECT domain, process_instance_uuid AS workflow_id,
  first(process_name ORDER BY event_seq) AS process_name,
  string_agg(description || ' in the screen ' || screen_name || ' of the application ' || application_name, chr(10)
             ORDER BY event_seq) AS instance_text,
  count(*) FILTER (WHERE description IS NULL OR screen_name IS NULL OR application_name IS NULL) AS n_null_lines
  FROM wf WHERE process_instance_uuid IS NOT NULL GROUP BY domain, process_instance_uuid"""

ORACLES["dataset_summary"] = with_(WF) + """SELECT domain, count(DISTINCT process_instance_uuid) AS n_instances,
  count(DISTINCT process_name) AS n_processes, count(*) AS n_events FROM wf GROUP BY domain"""

ORACLES["extract_answers"] = CLS + "SELECT domain, model, workflow_id, answer FROM resp"

ORACLES["normalize_outcomes"] = CLS + """SELECT r.domain, r.model, r.workflow_id,
  CASE WHEN r.answer IS NULL THEN 'Format Error' WHEN l.process_name IS NULL THEN 'Other' ELSE r.answer END AS predicted_class
  FROM resp r LEFT JOIN labels l ON l.domain = r.domain AND l.process_name = r.answer"""

ORACLES["detailed_results"] = CLS + "SELECT domain, model, workflow_id, true_class, predicted_class, correct FROM detailed"

ORACLES["accuracy"] = CLS + """SELECT domain, model, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) AS n FROM detailed GROUP BY domain, model"""

_R6 = """round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  round(CAST(support AS DOUBLE), 6) AS support"""

ORACLES["class_report"] = CLS.rstrip() + ",\n" + REPORT + f"\nSELECT domain, model, label, {_R6} FROM report_f"

ORACLES["macro_average"] = CLS.rstrip() + ",\n" + REPORT + f"""
SELECT domain, model, label, {_R6} FROM (
  SELECT domain, model, 'Average' AS label, avg(precision) AS precision, avg(recall) AS recall,
         avg(f1_score) AS f1_score, sum(support) AS support FROM report_f GROUP BY domain, model) a"""

ORACLES["report_accuracy_row"] = CLS + f"""SELECT domain, model, label, {_R6} FROM (
  SELECT domain, model, 'accuracy' AS label, acc AS precision, acc AS recall, acc AS f1_score, acc AS support
  FROM (SELECT domain, model, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc,
               bool_and(predicted_class IN (SELECT t.true_class FROM detailed t
                                            WHERE t.domain = d.domain AND t.model = d.model)) AS ok
        FROM detailed d GROUP BY domain, model) s WHERE ok) a"""

ORACLES["confusion_matrix"] = CLS + """SELECT domain, model, true_class AS actual, predicted_class AS predicted, count(*) AS n
  FROM detailed GROUP BY ALL"""

ORACLES["confusion_percent"] = CLS + """SELECT domain, model, actual, predicted,
  round(n * 100.0 / sum(n) OVER (PARTITION BY domain, model, actual), 6) AS percent
  FROM (SELECT domain, model, true_class AS actual, predicted_class AS predicted, count(*) AS n FROM detailed GROUP BY ALL) c"""

ORACLES["confusion_accuracy"] = CLS + """SELECT domain, model,
  round(sum(CASE WHEN true_class = predicted_class THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS accuracy
  FROM detailed GROUP BY domain, model"""

ORACLES["label_union"] = CLS + """SELECT domain, model, true_class AS label FROM detailed
  UNION SELECT domain, model, predicted_class AS label FROM detailed"""


# ---------------------------------------------------------------- prompts
from flowlens.operators.prompts import CLASSIFICATION_TEMPLATE, SEGMENTATION_TEMPLATE  # noqa: E402
from flowlens.sources.definitions import DEFINITIONS  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def template_sql(template: str, **slots: str) -> str:
    """Render a str.format template as a DuckDB concatenation (newlines as chr(10))."""
    import string
    out = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            pieces = lit.split("\n")
            for i, p in enumerate(pieces):
                if i:
                    out.append("chr(10)")
                if p:
                    out.append(_q(p))
        if field is not None:
            out.append(f"({slots[field]})")
    return " || ".join(out)


DEFS = "defs(def_pos, name, description) AS (VALUES " + ", ".join(
    f"({i}, {_q(n)}, {_q(d)})" for i, (n, d) in enumerate(DEFINITIONS)) + ")"

POS = """pos AS (
  SELECT *, row_number() OVER (PARTITION BY process_instance_uuid ORDER BY time_stamp ASC NULLS LAST, event_seq) - 1 AS pos,
         coalesce(description, 'None') || ' in the screen ' || coalesce(screen_name, 'None') || ' of the application '
         || coalesce(application_name, 'None') AS event_text
  FROM wf WHERE process_instance_uuid IS NOT NULL)"""

ORACLES["classification_prompts"] = with_(WF, INST, LABELS, POS) + f"""SELECT s.domain, s.workflow_id,
  {template_sql(CLASSIFICATION_TEMPLATE, classes='c.classes', sequence='s.seq')} AS prompt
  FROM (SELECT domain, process_instance_uuid AS workflow_id, string_agg(event_text, chr(10) ORDER BY pos) AS seq
        FROM pos GROUP BY ALL) s
  JOIN (SELECT domain, string_agg(process_name, ', ' ORDER BY process_name) AS classes FROM labels GROUP BY domain) c
  USING (domain)"""

DEFTEXT = """deftext AS (
  SELECT o.domain, coalesce(string_agg('- ' || d.name || ': ' || d.description || chr(10), '' ORDER BY d.def_pos), '')
         AS definitions_text
  FROM (SELECT DISTINCT domain FROM wf) o
  LEFT JOIN defs d ON lower(d.name) IN (SELECT lower(i.process_name) FROM wf i WHERE i.domain = o.domain)
  GROUP BY o.domain)"""

ORACLES["definitions_prompt_text"] = with_(WF, INST, DEFS, DEFTEXT) + "SELECT domain, definitions_text FROM deftext"

ORACLES["undefined_processes"] = with_(WF, INST, DEFS) + """SELECT DISTINCT domain, process_name FROM wf i
  WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE lower(d.name) = lower(i.process_name))"""

# ---------------------------------------------------------------- sampling
SEED, S, KMIN, KMAX = "2404", 100, 2, 4
_T = h(SEED, "domain", "sample", "j") + " % (j + 1)"

IDX = """idx AS (SELECT domain, workflow_id, process_name, n_events,
  row_number() OVER (PARTITION BY domain ORDER BY workflow_id) - 1 AS idx FROM inst)"""

PLAN = f"""sizes AS (SELECT domain, count(*) AS n_instances FROM inst GROUP BY domain),
plan0 AS (SELECT s.domain, s.n_instances, r.sample,
  CAST({KMIN} + {h(SEED, 'domain', 'sample', "'k'")} % {KMAX - KMIN + 1} AS INTEGER) AS k
  FROM sizes s, (SELECT range AS sample FROM range(0, {S})) r),
floyd(domain, sample, k, n_instances, j, acc) AS (
  SELECT domain, sample, k, n_instances, n_instances - least(k, n_instances), []::BIGINT[] FROM plan0
  UNION ALL
  SELECT domain, sample, k, n_instances, j + 1,
         CASE WHEN list_contains(acc, {_T}) THEN list_append(acc, j) ELSE list_append(acc, {_T}) END
  FROM floyd WHERE j < n_instances),
plan AS (SELECT domain, CAST(sample AS INTEGER) AS sample, 'sequence_' || CAST(sample AS VARCHAR) AS sequence_id, k,
  CAST(row_number() OVER (PARTITION BY domain, sample ORDER BY {h(SEED, 'domain', 'sample', "'o'", 'idx')}, idx) AS INTEGER) AS slot,
  idx
  FROM (SELECT domain, sample, k, unnest(acc) AS idx FROM floyd WHERE j = n_instances AND len(acc) > 0) u)"""

SLOTS = """slots AS (SELECT p.*, i.workflow_id, i.process_name, i.n_events,
  CAST(coalesce(sum(i.n_events) OVER (PARTITION BY p.domain, p.sample ORDER BY p.slot
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start,
  CAST(sum(i.n_events) OVER (PARTITION BY p.domain, p.sample) AS BIGINT) AS sequence_length
  FROM plan p JOIN idx i ON i.domain = p.domain AND i.idx = p.idx)"""


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SMP = with_rec(WF, INST, IDX, PLAN, SLOTS)

ORACLES["dense_index"] = with_(WF, INST, IDX) + "SELECT domain, workflow_id, idx FROM idx"
ORACLES["sample_plan"] = with_rec(WF, INST, IDX, PLAN) + "SELECT domain, sample, sequence_id, k, slot, idx FROM plan"
ORACLES["segment_boundaries"] = SMP + """SELECT domain, sequence_id, slot, workflow_id, n_events, seg_start,
  sequence_length FROM slots"""
ORACLES["true_segments"] = SMP + """SELECT domain, sequence_id, slot, seg_start AS start_index,
  seg_start + n_events - 1 AS end_index FROM slots"""
ORACLES["true_boundaries"] = SMP + "SELECT domain, sequence_id, slot, seg_start AS boundary FROM slots WHERE slot > 1"
ORACLES["concatenated_sequences"] = with_rec(WF, INST, IDX, PLAN, SLOTS, POS) + """SELECT s.domain, s.sequence_id,
  s.seg_start + p.pos AS seq_pos, s.slot, s.workflow_id, p.event_text
  FROM slots s JOIN pos p ON p.process_instance_uuid = s.workflow_id"""

ORACLES["segmentation_prompts"] = with_rec(WF, INST, IDX, PLAN, SLOTS, POS, DEFS, DEFTEXT) + f"""SELECT q.domain, q.sequence_id,
  {template_sql(SEGMENTATION_TEMPLATE, definitions="coalesce(d.definitions_text, 'No process definitions available.')",
                sequence='q.seq')} AS prompt
  FROM (SELECT s.domain, s.sequence_id,
               string_agg(CAST(s.seg_start + p.pos AS VARCHAR) || '. ' || p.event_text, chr(10) ORDER BY s.seg_start + p.pos) AS seq
        FROM slots s JOIN pos p ON p.process_instance_uuid = s.workflow_id GROUP BY ALL) q
  LEFT JOIN deftext d USING (domain)"""

# ---------------------------------------------------------------- segmentation
# Expected parse of each simulated output, derived from how the text was built (not by parsing).
SEG = f"""models AS (SELECT unnest({_list(MODELS)}) AS model),
hdr AS (SELECT domain, sample, sequence_id, count(*) AS num_workflows, max(sequence_length) AS sequence_length,
               list(seg_start ORDER BY slot) AS true_starts FROM slots GROUP BY ALL),
shifted AS (SELECT sl.domain, m.model, sl.sample, sl.slot,
  CASE WHEN sl.slot = 1 THEN 0 ELSE sl.seg_start + {h("'sh'", 'm.model', 'sl.domain', 'sl.sample', 'sl.slot')} % 9 - 4 END AS s,
  sl.slot = 1 OR {h("'dr'", 'm.model', 'sl.domain', 'sl.sample', 'sl.slot')} % 8 <> 0 AS keep
  FROM slots sl, models m),
st0 AS (SELECT domain, model, sample, list(s ORDER BY slot) FILTER (WHERE keep) AS st FROM shifted GROUP BY ALL),
st1 AS (SELECT st0.*, hdr.sequence_id, hdr.sequence_length, hdr.num_workflows, hdr.true_starts,
               {h("'seg'", 'st0.model', 'st0.domain', 'st0.sample')} % 20 AS v,
               {h("'sp'", 'st0.model', 'st0.domain', 'st0.sample')} % hdr.sequence_length AS spur
        FROM st0 JOIN hdr USING (domain, sample)),
st2 AS (SELECT *, CASE WHEN v % 3 = 0 THEN list_append(st, spur) ELSE st END AS full_starts FROM st1),
st3 AS (SELECT *, list_transform(full_starts, lambda x, i: coalesce(full_starts[i + 1], sequence_length) - 1) AS full_ends
        FROM st2),
parsed AS (SELECT domain, model, sample, sequence_id, sequence_length, num_workflows, true_starts,
  CASE WHEN v IN (0, 1, 2) THEN []::BIGINT[]
       WHEN v = 3 THEN list_filter(full_starts, lambda x, i: i - 1 <> least(1, len(full_starts) - 1))
       ELSE full_starts END AS starts,
  CASE WHEN v IN (0, 1, 2) THEN []::BIGINT[]
       WHEN v = 3 THEN list_filter(full_ends, lambda x, i: i - 1 <> least(1, len(full_starts) - 1))
       ELSE full_ends END AS ends
  FROM st3),
bnd AS (SELECT *, list_filter(starts, lambda x: x > 0) AS pb, list_slice(true_starts, 2, len(true_starts)) AS tb FROM parsed),
met AS (SELECT *,
  len(list_filter(list_distinct(list_filter(pb, lambda b: b >= 0 AND b < sequence_length)),
      lambda x: list_contains(list_distinct(list_filter(tb, lambda b: b >= 0 AND b < sequence_length)), x))) AS tp_exact,
  len(list_distinct(list_filter(pb, lambda b: b >= 0 AND b < sequence_length))) AS np_exact,
  len(list_distinct(list_filter(tb, lambda b: b >= 0 AND b < sequence_length))) AS nt_exact,
  len(list_filter(pb, lambda x: len(list_filter(tb, lambda y: abs(x - y) <= 3)) > 0)) AS tp_tol,
  list_distinct(list_concat(tb, pb)) AS vals
  FROM bnd),
res AS (SELECT *,
  CASE WHEN np_exact = 0 THEN 0.0 ELSE tp_exact / np_exact END AS p_exact,
  CASE WHEN nt_exact = 0 THEN 0.0 ELSE tp_exact / nt_exact END AS r_exact,
  CASE WHEN len(pb) = 0 THEN 0.0 ELSE tp_tol / len(pb) END AS boundary_precision,
  CASE WHEN len(tb) = 0 THEN 0.0 ELSE tp_tol / len(tb) END AS boundary_recall,
  levenshtein(array_to_string(list_transform(tb, lambda x: chr(CAST(47 + list_position(vals, x) AS INTEGER))), ''),
              array_to_string(list_transform(pb, lambda x: chr(CAST(47 + list_position(vals, x) AS INTEGER))), ''))
    AS edit_distance
  FROM met),
res2 AS (SELECT *,
  CASE WHEN p_exact + r_exact > 0 THEN 2 * p_exact * r_exact / (p_exact + r_exact) ELSE 0.0 END AS f1_exact,
  CASE WHEN boundary_precision + boundary_recall > 0
       THEN 2 * boundary_precision * boundary_recall / (boundary_precision + boundary_recall) ELSE 0.0 END AS boundary_f1
  FROM res)"""

SEGQ = with_rec(WF, INST, IDX, PLAN, SLOTS, SEG)

ORACLES["parse_segments"] = SEGQ + """SELECT domain, model, sequence_id,
  array_to_string(starts, ',') AS starts, array_to_string(ends, ',') AS ends FROM parsed"""
ORACLES["predicted_boundaries"] = SEGQ + """SELECT domain, model, sequence_id,
  array_to_string(list_filter(starts, lambda x: x > 0), ',') AS pred_boundaries FROM parsed"""
ORACLES["boundary_exact"] = SEGQ + """SELECT domain, model, sequence_id, round(p_exact, 6) AS boundary_precision,
  round(r_exact, 6) AS boundary_recall, round(f1_exact, 6) AS boundary_f1 FROM res2"""
ORACLES["boundary_tolerant"] = SEGQ + """SELECT domain, model, sequence_id, round(boundary_precision, 6) AS boundary_precision,
  round(boundary_recall, 6) AS boundary_recall, round(boundary_f1, 6) AS boundary_f1 FROM res2"""
ORACLES["edit_distance"] = SEGQ + "SELECT domain, model, sequence_id, CAST(edit_distance AS BIGINT) AS edit_distance FROM res2"
for _name in ("boundary_exact", "boundary_tolerant"):
    ORACLES[f"{_name}_long"] = ORACLES[_name]
ORACLES["segmentation_aggregate"] = SEGQ + """SELECT domain, model, round(avg(boundary_precision), 6) AS boundary_precision,
  round(avg(boundary_recall), 6) AS boundary_recall, round(avg(boundary_f1), 6) AS boundary_f1,
  round(avg(edit_distance), 6) AS edit_distance FROM res2 GROUP BY domain, model"""
ORACLES["f1_by_num_workflows"] = SEGQ + """SELECT domain, model, num_workflows, round(avg(boundary_f1), 6) AS mean_f1
  FROM res2 GROUP BY ALL"""
ORACLES["f1_by_length_bin"] = SEGQ + """, mm AS (SELECT domain, model, min(sequence_length) AS lo, max(sequence_length) AS hi
              FROM res2 GROUP BY ALL),
b AS (SELECT r.*, mm.lo, CASE WHEN mm.hi > mm.lo THEN (mm.hi - mm.lo) / 5.0 ELSE 1.0 END AS w FROM res2 r JOIN mm USING (domain, model)),
b2 AS (SELECT *, least(4, CAST(trunc((sequence_length - lo) / w) AS INTEGER)) AS bi FROM b)
SELECT domain, model,
  CAST(CAST(trunc(lo + bi * w) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(lo + (bi + 1) * w) AS BIGINT) AS VARCHAR) AS bin_label,
  min(CAST(trunc(lo + bi * w) AS INTEGER)) AS bin_start, round(avg(boundary_f1), 6) AS mean_f1
FROM b2 GROUP BY ALL"""
ORACLES["segment_widths"] = SEGQ + """SELECT domain, model, sequence_id, 'pred' AS kind, CAST(u.i - 1 AS INTEGER) AS idx,
  starts[u.i] AS start_index, ends[u.i] - starts[u.i] + 1 AS width
  FROM parsed, (SELECT range AS i FROM range(1, 64)) u WHERE u.i <= len(starts)
UNION ALL
SELECT p.domain, p.model, p.sequence_id, 'true' AS kind, s.slot - 1 AS idx, s.seg_start AS start_index, s.n_events AS width
  FROM parsed p JOIN slots s ON s.domain = p.domain AND s.sequence_id = p.sequence_id"""


# ---------------------------------------------------------------- similarity
from flowlens.functions.text import DISPLAY_NAME_MAP  # noqa: E402

TOK = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')"

ORACLES["token_counts"] = f"SELECT doc_id, CAST(len({TOK}) AS INTEGER) AS num_tokens FROM documents"

# A token with the blanks before it (the last one also with those after it): the pieces make up the whole text.
PIECES = r"regexp_extract_all(text, '[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B]+(?:[ \t\n\r\f\x0B]+$)?')"
ORACLES["chunk_tokens"] = f"""WITH d AS (SELECT doc_id, text, {PIECES} AS tok FROM documents),
c AS (SELECT doc_id, text, tok, unnest(range(0, greatest(1, CAST(ceil(len(tok) / 8000.0) AS BIGINT)))) AS chunk FROM d)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(list_slice(tok, chunk * 8000 + 1, (chunk + 1) * 8000)) AS INTEGER) AS n_tokens,
       CASE WHEN len(tok) = 0 THEN text ELSE array_to_string(list_slice(tok, chunk * 8000 + 1, (chunk + 1) * 8000), '') END AS chunk_text FROM c"""

ORACLES["document_chunks"] = ORACLES["chunk_tokens"].replace("8000", "300")
ORACLES["instance_chunks"] = f"""WITH t AS (SELECT domain, workflow_id, instance_text AS text FROM ({ORACLES["instance_texts"]}) i
  WHERE instance_text IS NOT NULL),
d AS (SELECT domain, workflow_id, {PIECES} AS tok FROM t),
c AS (SELECT *, unnest(range(0, CAST(ceil(len(tok) / 24.0) AS BIGINT))) AS chunk FROM d)
SELECT domain, workflow_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(list_slice(tok, chunk * 24 + 1, (chunk + 1) * 24)) AS INTEGER) AS n_tokens,
       array_to_string(list_slice(tok, chunk * 24 + 1, (chunk + 1) * 24), '') AS chunk_text FROM c"""

CV = f"""cv AS (SELECT vec_id // 4 AS instance_id, vec_id, CAST(embedding AS DOUBLE[]) AS e,
                   {NAMES}[CAST(label % 7 AS INTEGER) + 1] AS process_name FROM embeddings),
u AS (SELECT instance_id, dim, e[dim + 1] AS v FROM (SELECT instance_id, e, unnest(range(len(e))) AS dim FROM cv) x),
pool AS (SELECT instance_id, dim, avg(v) AS v FROM u GROUP BY ALL),
names AS (SELECT instance_id, arg_min(process_name, vec_id) AS process_name FROM cv GROUP BY instance_id),
pooled AS (SELECT p.instance_id, n.process_name, list(p.v ORDER BY p.dim) AS e
           FROM pool p JOIN names n USING (instance_id) GROUP BY ALL)"""

# Instances whose vector is missing or not a number take no part in similarities.
SIMCV = CV + ",\nusable AS (SELECT * FROM pooled WHERE instance_id % 41 <> 0 AND instance_id % 43 <> 0)"

ORACLES["pool_embeddings"] = with_(CV) + "SELECT instance_id, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS value FROM pool"

# Brute force over every pair of instances (small fixture), averaged per process pair.
ORACLES["process_similarity"] = with_(SIMCV) + """, cnt AS (SELECT process_name, count(*) AS n FROM usable GROUP BY ALL),
pairs AS (SELECT a.process_name AS process_i, b.process_name AS process_j, list_cosine_similarity(a.e, b.e) AS c
          FROM usable a, usable b)
SELECT process_i, process_j, round(avg(c), 6) + 0.0 AS mean_cosine, ci.n AS n_i, cj.n AS n_j
FROM pairs JOIN cnt ci ON ci.process_name = process_i JOIN cnt cj ON cj.process_name = process_j
GROUP BY process_i, process_j, ci.n, cj.n"""

# Brute force: every query against every instance.
ORACLES["instance_neighbours"] = with_(SIMCV) + """, s AS (
  SELECT q.instance_id AS query, r.instance_id AS neighbour, round(list_cosine_similarity(q.e, r.e), 9) AS c
  FROM usable q JOIN usable r ON r.instance_id <> q.instance_id WHERE q.instance_id % 50 = 0)
SELECT query, neighbour, CAST(row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) AS INTEGER) AS rank, round(c, 6) + 0.0 AS cosine
FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) <= 5"""

ORACLES["similarity_blocks"] = with_(SIMCV) + """, ord AS (SELECT *, row_number() OVER (ORDER BY process_name, instance_id) - 1 AS idx
             FROM usable)
SELECT CASE WHEN length(process_name) > 20 THEN left(process_name, 20) || '...' ELSE process_name END AS block_label,
       min(idx) AS block_start, max(idx) + 1 AS block_end, count(*) AS n_items FROM ord GROUP BY 1"""

ORACLES["truncate_labels"] = with_(WF, INST) + """SELECT DISTINCT process_name,
  CASE WHEN length(process_name) > 20 THEN left(process_name, 20) || '...' ELSE process_name END AS label_20,
  CASE WHEN length(process_name) > 25 THEN left(process_name, 25) || '...' ELSE process_name END AS label_25 FROM inst"""

ORACLES["parse_embedding_text"] = """SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CAST(embedding[dim + 1] AS DOUBLE), 6) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS dim FROM embeddings) x"""

# ---------------------------------------------------------------- reporting
CLSRUN = CLS.rstrip() + ",\n" + REPORT + """,
rows AS (
  SELECT domain, model, label, precision, recall, f1_score, CAST(support AS DOUBLE) AS support FROM report_f
  UNION ALL
  SELECT domain, model, 'Average', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS DOUBLE)
  FROM report_f GROUP BY domain, model
  UNION ALL
  SELECT domain, model, 'accuracy', acc, acc, acc, acc
  FROM (SELECT domain, model, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc,
               bool_and(predicted_class IN (SELECT t.true_class FROM detailed t
                                            WHERE t.domain = d.domain AND t.model = d.model)) AS ok
        FROM detailed d GROUP BY domain, model) s WHERE ok),
runacc AS (SELECT domain, 'classification' AS task, model, count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
                  count(*) - count(*) FILTER (WHERE correct) AS incorrect,
                  CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*) AS accuracy
           FROM detailed GROUP BY domain, model),
accfb AS (SELECT r.domain, r.task, r.model, coalesce(a.precision, r.accuracy) AS accuracy,
                 CASE WHEN a.precision IS NOT NULL THEN 'report' ELSE 'detailed' END AS accuracy_source
          FROM runacc r LEFT JOIN (SELECT * FROM rows WHERE label = 'accuracy') a USING (domain, model)),
lb AS (SELECT a.domain, a.task, a.model, v.precision, v.recall, v.f1_score AS f1, v.support, a.accuracy, a.accuracy_source
       FROM accfb a LEFT JOIN (SELECT * FROM rows WHERE label = 'Average') v USING (domain, model))
"""

ORACLES["run_accuracy"] = CLSRUN + """SELECT domain, task, model, correct, total, incorrect, round(accuracy, 6) AS accuracy
FROM runacc"""

ORACLES["class_accuracy"] = CLSRUN + """SELECT domain, task, model, true_class, correct, total, incorrect,
  round(accuracy, 6) AS accuracy,
  CAST(row_number() OVER (PARTITION BY domain, task, model ORDER BY accuracy, true_class) AS INTEGER) AS rank
FROM (SELECT domain, 'classification' AS task, model, coalesce(true_class, 'Unknown') AS true_class,
             count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
             count(*) - count(*) FILTER (WHERE correct) AS incorrect,
             CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*) AS accuracy
      FROM detailed GROUP BY ALL) c"""

ORACLES["domain_accuracy"] = CLSRUN + """SELECT domain, model, count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
  round(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*), 6) AS accuracy FROM detailed GROUP BY domain, model"""

ORACLES["accuracy_rollup"] = CLSRUN + """SELECT CASE WHEN grouping(task) = 1 THEN 'domain' WHEN grouping(true_class) = 1 THEN 'run' ELSE 'class' END AS level,
  domain, task, model, true_class, count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
  count(*) - count(*) FILTER (WHERE correct) AS incorrect,
  round(CAST(count(*) FILTER (WHERE correct) AS DOUBLE) / count(*), 6) AS accuracy
FROM (SELECT domain, 'classification' AS task, model, coalesce(true_class, 'Unknown') AS true_class, correct FROM detailed) d
GROUP BY GROUPING SETS ((domain, task, model, true_class), (domain, task, model), (domain, model))"""

ORACLES["accuracy_fallback"] = CLSRUN + "SELECT domain, task, model, round(accuracy, 6) AS accuracy, accuracy_source FROM accfb"

ORACLES["classification_leaderboard"] = CLSRUN + """SELECT domain, task, model, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(support, 6) AS support, round(accuracy, 6) AS accuracy,
  accuracy_source FROM lb"""

ORACLES["report_cells"] = CLSRUN + """SELECT r.domain, r.task, r.model, printf('%.1f%%', r.accuracy * 100) AS accuracy_text,
  printf('%.2f', l.f1) AS f1_text, format('{:,}', r.total) AS total_text,
  CAST(r.correct AS VARCHAR) || '/' || CAST(r.total AS VARCHAR) AS ratio_text
FROM runacc r JOIN lb l USING (domain, task, model)"""

SEGRUN = SEGQ.rstrip() + """,
segrun AS (SELECT domain, 'segmentation' AS task, model, avg(boundary_precision) AS boundary_precision,
                  avg(boundary_recall) AS boundary_recall, avg(boundary_f1) AS boundary_f1,
                  avg(edit_distance) AS edit_distance FROM res2 GROUP BY domain, model)
"""

ORACLES["segmentation_fallback"] = SEGRUN + """SELECT domain, task, model, round(boundary_precision, 6) AS boundary_precision,
  round(boundary_recall, 6) AS boundary_recall, round(boundary_f1, 6) AS boundary_f1,
  round(edit_distance, 6) AS edit_distance FROM segrun"""

ORACLES["domain_segmentation_f1"] = SEGRUN + """SELECT domain, model, round(avg(boundary_f1), 6) AS boundary_f1,
  count(*) AS n_tasks FROM segrun GROUP BY domain, model"""

ORACLES["segmentation_leaderboard"] = SEGRUN + """SELECT domain, task, model,
  round(coalesce(boundary_precision, 0.0), 6) AS boundary_precision, round(coalesce(boundary_recall, 0.0), 6) AS boundary_recall,
  round(coalesce(boundary_f1, 0.0), 6) AS boundary_f1 FROM segrun"""

ORACLES["model_roster"] = CLS + "SELECT DISTINCT model FROM detailed"

_MAP = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in DISPLAY_NAME_MAP.items()) + "}"
_KNOWN = _list(sorted(set(DOMAINS) | set(DISPLAY_NAME_MAP)))


def _cap(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


ORACLES["display_names"] = CLS + f""", names AS (
  SELECT model AS name FROM detailed UNION SELECT domain FROM detailed
  UNION SELECT domain || '_classification' FROM detailed UNION SELECT 'classification_' || model FROM detailed
  UNION SELECT true_class || '_x' FROM detailed)
SELECT name, CASE
  WHEN {_MAP}[name] IS NOT NULL THEN {_MAP}[name]
  WHEN contains(name, '_') AND list_contains({_KNOWN}, split_part(name, '_', 1))
    THEN coalesce({_MAP}[split_part(name, '_', 1)], {_cap("split_part(name, '_', 1)")}) || ' - ' ||
         array_to_string(list_transform(string_split(substr(name, strpos(name, '_') + 1), '_'), lambda p: {_cap('p')}), ' ')
  WHEN contains(name, '_') THEN array_to_string(list_transform(string_split(name, '_'), lambda p: {_cap('p')}), ' ')
  ELSE {_cap('name')} END AS display_name
FROM names"""


# ---------------------------------------------------------------- the same operators on other given tables
QD = """qd AS (SELECT 'labels' AS domain, 'non_toxic' AS model, CAST(doc_id AS VARCHAR) AS workflow_id,
                 CAST(quality AS VARCHAR) AS true_class, CAST(1 - toxic AS VARCHAR) AS predicted_class FROM labels),
qrep AS (
  SELECT t.domain, t.model, t.label,
         CASE WHEN coalesce(p.n_pred, 0) = 0 THEN 0.0 ELSE t.tp / p.n_pred END AS precision,
         CASE WHEN t.support = 0 THEN 0.0 ELSE t.tp / t.support END AS recall, t.support
  FROM (SELECT domain, model, true_class AS label, count(*) AS support,
               sum(CASE WHEN true_class = predicted_class THEN 1 ELSE 0 END) AS tp FROM qd GROUP BY ALL) t
  LEFT JOIN (SELECT domain, model, predicted_class AS label, count(*) AS n_pred FROM qd GROUP BY ALL) p
    USING (domain, model, label)),
qrep_f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
                     AS f1_score FROM qrep)"""

ORACLES["quality_report"] = with_(QD) + f"""SELECT domain, model, label, {_R6} FROM (
  SELECT domain, model, label, precision, recall, f1_score, support FROM qrep_f
  UNION ALL
  SELECT domain, model, 'Average', avg(precision), avg(recall), avg(f1_score), sum(support) FROM qrep_f GROUP BY domain, model) r"""

ORACLES["quality_confusion"] = with_(QD) + """SELECT domain, model, true_class AS actual, predicted_class AS predicted,
  count(*) AS n FROM qd GROUP BY ALL"""

ORACLES["conversation_texts"] = f"""SELECT conv_id, count(*) AS n_parts,
  CAST(len(regexp_extract_all(string_agg(role || ': ' || text, chr(10) ORDER BY turn), '[^ \\t\\n\\r\\f\\x0B]+')) AS INTEGER)
    AS num_tokens,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS instance_text
FROM conversations GROUP BY conv_id"""
