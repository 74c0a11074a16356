"""Parsing model output text into answers and segments (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.text import _STRIP_RE, py_strip

# The answer markers the prompts ask the model to emit.
# Classification: the first \answer{...} on one line (Python's '.' stops only at '\n').
ANSWER_PATTERN = r"\\answer\{([^\n]*?)\}"
# Segmentation: the first <answer>...</answer>, dot matching newlines.
SEGMENT_PATTERN = r"(?s)<answer>(.*?)</answer>"

SEGMENT_TYPE = "array<struct<start_index:bigint,end_index:bigint>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_lit(s: str) -> str:
    """Spark SQL string literal for s (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extract_answer(text) -> Column:
    """Stripped content of the first \\answer{...}; null when there is none.

    ``regexp_extract`` returns '' both for an empty answer and for no match, so the match is
    tested separately: an empty answer is '' (later 'Other'), no match is null ('Format Error').
    """
    t = _c(text)
    return F.when(t.rlike(ANSWER_PATTERN), py_strip(F.regexp_extract(t, ANSWER_PATTERN, 1)))


_INT_KINDS = "('BIGINT', 'INT', 'SMALLINT', 'TINYINT')"
_INT_STR = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _to_int_sql(v: str) -> str:
    """int(v) for a JSON value v (a variant), or NULL where Python's int() would raise."""
    k = f"schema_of_variant({v})"
    s = f"variant_get({v}, '$', 'string')"
    return (
        f"CASE WHEN {k} = 'BOOLEAN' THEN if(variant_get({v}, '$', 'boolean'), 1L, 0L) "
        f"WHEN {k} IN {_INT_KINDS} THEN try_variant_get({v}, '$', 'bigint') "
        f"WHEN {k} LIKE 'DECIMAL%' THEN try_cast(try_variant_get({v}, '$', 'decimal(38,18)') AS bigint) "
        f"WHEN {k} IN ('DOUBLE', 'FLOAT') THEN try_cast(try_variant_get({v}, '$', 'double') AS bigint) "
        f"WHEN {k} = 'STRING' AND {s} rlike {sql_lit(_INT_STR)} "
        f"THEN try_cast(regexp_replace(trim({s}), '_', '') AS bigint) "
        f"ELSE NULL END"
    )


def _has_keys_sql(e: str) -> str:
    return (f"(try_variant_get({e}, '$.start_index') IS NOT NULL "
            f"AND try_variant_get({e}, '$.end_index') IS NOT NULL)")


def _is_obj(e: str) -> str:
    return f"(schema_of_variant({e}) LIKE 'OBJECT%')"


def _other_break_sql(e: str) -> str:
    """True when the reference's key test itself raises on a non-object element e."""
    k = f"schema_of_variant({e})"
    s = f"try_variant_get({e}, '$', 'string')"
    a = f"try_variant_get({e}, '$', 'array<variant>')"
    return (
        # 'key in "text"' is a substring test; with both present, str indexing raises.
        f"(({k} = 'STRING' AND instr({s}, 'start_index') > 0 AND instr({s}, 'end_index') > 0) "
        # 'key in [...]' is membership; with both present, list indexing raises.
        f"OR ({k} LIKE 'ARRAY%' AND exists({a}, x -> try_variant_get(x, '$', 'string') = 'start_index') "
        f"AND exists({a}, x -> try_variant_get(x, '$', 'string') = 'end_index')) "
        # 'key in 5', 'key in True', 'key in None' raise TypeError.
        f"OR NOT ({_is_obj(e)} OR {k} LIKE 'ARRAY%' OR {k} = 'STRING'))"
    )


_START_E = "variant_get(e, '$.start_index')"
_END_E = "variant_get(e, '$.end_index')"


def parse_segments_sql(text_sql: str) -> str:
    empty = f"cast(array() AS {SEGMENT_TYPE})"
    pat = sql_lit(SEGMENT_PATTERN)
    raw = (f"CASE WHEN {text_sql} rlike {pat} THEN regexp_replace(regexp_extract({text_sql}, {pat}, 1), "
           f"{sql_lit(_STRIP_RE)}, '') END")
    arr = f"try_variant_get(try_parse_json({raw}), '$', 'array<variant>')"
    # Each element is analysed once: is it a segment object, and what do int() of its two values give?
    facts = (f"transform({arr}, e -> named_struct('seg', {_is_obj('e')} AND {_has_keys_sql('e')}, "
             f"'s', {_to_int_sql(_START_E)}, 'e', {_to_int_sql(_END_E)}, 'other', {_other_break_sql('e')}))")
    breaks = "exists(f, x -> (x.seg AND (x.s IS NULL OR x.e IS NULL)) OR (NOT x.seg AND x.other))"
    body = (f"CASE WHEN f IS NULL THEN {empty} WHEN {breaks} THEN {empty} "
            f"ELSE transform(filter(f, x -> x.seg), x -> named_struct('start_index', x.s, 'end_index', x.e)) END")
    # Bind the analysed array once: element_at(transform(array(x), f -> body), 1).
    return f"element_at(transform(array({facts}), f -> {body}), 1)"


def parse_segments(text_col: str) -> Column:
    """array<struct<start_index, end_index>> from the first <answer>[...]</answer> of a column.

    Bad JSON, a non-list answer, or any element that makes the reference's key test or int()
    raise gives []; objects lacking either key are skipped; values convert like int() (floats
    truncate, '6' and true are accepted).
    """
    return F.expr(parse_segments_sql(f"`{text_col}`"))
