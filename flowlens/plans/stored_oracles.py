"""Independent DuckDB SQL for the queries of ``plans.stored``: what was written, straight from the given tables."""

from __future__ import annotations

from flowlens.plans.oracles import CLSRUN, CV, ORACLES, SEGRUN, WF, _list, with_
from flowlens.plans.stored import CONFUSION_ONLY, NO_AVERAGE, NO_DETAILED, STORED_MODEL, STORED_SHIFT
from flowlens.sources.testdata import DOMAINS, MODELS


def no_run(domain: str, model: str) -> str:
    return f"NOT (domain = '{domain}' AND model = '{model}')"


HAS_DETAILED = f"{no_run(*NO_DETAILED)} AND {no_run(*CONFUSION_ONLY)}"
HAS_REPORT = no_run(*CONFUSION_ONLY)

ORACLES["scan_results"] = f"""WITH runs AS (SELECT domain, model FROM (SELECT unnest({_list(DOMAINS)}) AS domain) d, (SELECT unnest({_list(MODELS)}) AS model) m)
SELECT domain, 'classification' AS task, model, 'detailed_results.json' AS file FROM runs WHERE {HAS_DETAILED}
UNION ALL SELECT domain, 'classification', model, 'report.json' FROM runs WHERE {HAS_REPORT}
UNION ALL SELECT domain, 'classification', model, 'confusion_matrix.json' FROM runs
UNION ALL SELECT domain, 'segmentation', model, 'segmentation_results.json' FROM runs"""

ORACLES["load_detailed_results"] = CLSRUN + f"""SELECT domain, 'classification' AS task, model, workflow_id, true_class, predicted_class, correct
FROM detailed WHERE {HAS_DETAILED}"""

TREE = CLSRUN.rstrip() + f""",
tree_reports AS (
  SELECT domain, model, label, precision, recall, f1_score, support FROM rows
  WHERE {HAS_REPORT} AND NOT (model = '{NO_AVERAGE}' AND label IN ('Average', 'accuracy'))
  UNION ALL SELECT DISTINCT domain, model, 'accuracy', 0.5, 0.5, 0.5, 0.5 FROM rows WHERE model = '{NO_AVERAGE}'),
tree_runs AS (
  SELECT domain, 'classification' AS task, model, v.precision, v.recall, v.f1_score AS f1, v.support,
         CASE WHEN v.label IS NOT NULL AND a.precision IS NOT NULL THEN a.precision ELSE d.accuracy END AS accuracy,
         CASE WHEN v.label IS NOT NULL AND a.precision IS NOT NULL THEN 'report' WHEN d.accuracy IS NOT NULL THEN 'detailed' END AS accuracy_source
  FROM (SELECT DISTINCT domain, model FROM detailed) r
  LEFT JOIN (SELECT * FROM tree_reports WHERE label = 'Average') v USING (domain, model)
  LEFT JOIN (SELECT * FROM tree_reports WHERE label = 'accuracy') a USING (domain, model)
  LEFT JOIN (SELECT * FROM runacc WHERE {HAS_DETAILED}) d USING (domain, model)
  WHERE v.label IS NOT NULL OR d.accuracy IS NOT NULL)
"""

ORACLES["load_reports"] = TREE + """SELECT domain, 'classification' AS task, model, label, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(support, 6) AS support FROM tree_reports"""

ORACLES["load_results"] = TREE + """SELECT domain, task, model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(support, 6) AS support, round(accuracy, 6) AS accuracy, accuracy_source FROM tree_runs"""

GRID = """, names AS (SELECT domain, model, true_class AS label FROM detailed UNION SELECT domain, model, predicted_class FROM detailed),
grid AS (SELECT a.domain, a.model, a.label AS actual, p.label AS predicted,
                (SELECT count(*) FROM detailed d WHERE d.domain = a.domain AND d.model = a.model
                 AND d.true_class = a.label AND d.predicted_class = p.label) AS n
         FROM names a JOIN names p ON p.domain = a.domain AND p.model = a.model)
"""

ORACLES["attach_confusion"] = TREE.rstrip() + GRID + """SELECT domain, 'classification' AS task, model, actual, predicted, n
FROM grid WHERE EXISTS (SELECT 1 FROM tree_runs t WHERE t.domain = grid.domain AND t.model = grid.model)"""

ORACLES["confusion_grid"] = CLSRUN.rstrip() + GRID + "SELECT domain, model, actual, predicted, n FROM grid"

ORACLES["confusion_percent_predicted"] = CLSRUN.rstrip() + GRID + """SELECT domain, model, actual, predicted,
  CASE WHEN sum(n) OVER w = 0 THEN 0.0 ELSE round(n * 100.0 / sum(n) OVER w, 6) END AS percent
FROM grid WINDOW w AS (PARTITION BY domain, model, predicted)"""

ORACLES["load_segmentation_results"] = SEGRUN + """SELECT domain, 'segmentation' AS task, model, sequence_id, num_workflows, sequence_length,
  round(boundary_precision, 6) AS boundary_precision, round(boundary_recall, 6) AS boundary_recall, round(boundary_f1, 6) AS boundary_f1,
  edit_distance,
  array_to_string(list_transform(true_starts, lambda x, i: CAST(x AS VARCHAR) || '-' ||
    CAST(coalesce(true_starts[i + 1], sequence_length) - 1 AS VARCHAR)), ',') AS true_segments,
  array_to_string(list_transform(starts, lambda x, i: CAST(x AS VARCHAR) || '-' || CAST(ends[i] AS VARCHAR)), ',') AS pred_segments
FROM res2"""

STORED = f"""SELECT domain, task, model, boundary_precision, boundary_recall,
  CASE WHEN model = '{STORED_MODEL}' THEN boundary_f1 + {STORED_SHIFT} ELSE boundary_f1 END AS boundary_f1,
  CASE WHEN model = '{STORED_MODEL}' THEN NULL ELSE edit_distance END AS edit_distance,
  CASE WHEN model = '{STORED_MODEL}' THEN 'stored' ELSE 'recomputed' END AS metrics_source FROM segrun"""

for key in ("load_segmentation_runs", "segmentation_fallback"):
    ORACLES[key] = SEGRUN + f"""SELECT domain, task, model, round(boundary_precision, 6) AS boundary_precision,
  round(boundary_recall, 6) AS boundary_recall, round(boundary_f1, 6) AS boundary_f1, round(edit_distance, 6) AS edit_distance,
  metrics_source FROM ({STORED}) s"""

# "m1" answers of the first write, but for "hr", where the second write put those of "m3".
_STORE = """SELECT domain, 'classification' AS task, 'm2' AS model, workflow_id, true_class, predicted_class, correct FROM detailed WHERE model = 'm2'
UNION ALL
SELECT domain, 'classification', 'm1', workflow_id, true_class, predicted_class, correct FROM detailed
WHERE model = CASE WHEN domain = 'hr' THEN 'm3' ELSE 'm1' END"""
for key in ("stored_run_tables", "stored_run_documents"):
    ORACLES[key] = CLSRUN + _STORE

ORACLES["stored_run_versions"] = f"""SELECT domain, 'classification' AS task, model,
  CASE WHEN domain = 'hr' AND model = 'm1' THEN 2 ELSE 1 END::BIGINT AS version
FROM (SELECT unnest({_list(DOMAINS)}) AS domain) d, (SELECT unnest(['m1', 'm2']) AS model) m"""

ORACLES["definitions_from_file"] = ORACLES["definitions_prompt_text"]

ORACLES["resumed_answers"] = f"""SELECT domain, workflow_id, '\\answer{{' || md5(prompt) || '}}' AS generated_text, 1::BIGINT AS n_logged
FROM ({ORACLES["classification_prompts"]}) p"""

ORACLES["landed_events"] = with_(WF) + """SELECT row_number() OVER (ORDER BY event_seq) - 1 AS event_seq, process_instance_uuid, description, domain,
  strftime(time_stamp, '%Y-%m-%d %H:%M:%S.%f') AS time_stamp FROM wf"""

ORACLES["embedding_round_trip"] = with_(CV) + """SELECT instance_id, process_name,
  'first line of ' || CAST(instance_id AS VARCHAR) || ',' || chr(10) || '"second" line' AS process_instance_text,
  CAST((SELECT count(*) FROM cv WHERE cv.instance_id = pool.instance_id) AS INTEGER) AS num_tokens,
  CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS value
FROM pool JOIN names USING (instance_id)"""
