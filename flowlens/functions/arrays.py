"""Array expressions for segmentation metrics. Arrays here are per-sequence and small
(bounded by the workflows per sequence and the model's segment list), so higher-order
functions evaluated per row are the right tool: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return f"`{name}`"


def boundary_exact_sql(true_b: str, pred_b: str, length: str) -> str:
    """Exact-match P/R on 0/1 position vectors of the given length: out-of-range positions are
    ignored and duplicates collapse."""
    tv = f"array_distinct(filter({true_b}, b -> b >= 0 AND b < {length}))"
    pv = f"array_distinct(filter({pred_b}, b -> b >= 0 AND b < {length}))"
    tp = f"size(array_intersect({tv}, {pv}))"
    p = f"if(size({pv}) = 0, 0D, {tp} / size({pv}))"
    r = f"if(size({tv}) = 0, 0D, {tp} / size({tv}))"
    return f"named_struct('precision', {p}, 'recall', {r})"


def boundary_tolerant_sql(true_b: str, pred_b: str, tolerance: int) -> str:
    """A prediction is a hit when some true boundary lies within +-tolerance. Duplicated
    predictions each count, so recall can exceed 1 (kept, as in the reference)."""
    tp = f"size(filter({pred_b}, x -> exists({true_b}, y -> abs(x - y) <= {int(tolerance)})))"
    p = f"if(size({pred_b}) = 0, 0D, {tp} / size({pred_b}))"
    r = f"if(size({true_b}) = 0, 0D, {tp} / size({true_b}))"
    return f"named_struct('precision', {p}, 'recall', {r})"


def boundary_metrics(true_b: str, pred_b: str, length: str, tolerance: int = 3) -> Column:
    """struct<precision, recall, f1>; tolerance 0 selects exact mode."""
    pr = (boundary_exact_sql(_q(true_b), _q(pred_b), _q(length)) if tolerance == 0
          else boundary_tolerant_sql(_q(true_b), _q(pred_b), tolerance))
    s = F.expr(pr)
    p, r = s["precision"], s["recall"]
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def edit_distance_sql(a: str, b: str) -> str:
    """Unit-cost Levenshtein distance between two integer arrays (row-wise dynamic program)."""
    dp = (f"element_at(aggregate({a}, sequence(0, size({b})), (prev, x) -> "
          f"aggregate(sequence(1, size({b})), array(prev[0] + 1), (cur, j) -> "
          f"concat(cur, array(least(prev[j] + 1, cur[j - 1] + 1, "
          f"prev[j - 1] + if(x = {b}[j - 1], 0, 1)))))), -1)")
    return (f"CASE WHEN size({a}) = 0 THEN size({b}) WHEN size({b}) = 0 THEN size({a}) "
            f"ELSE {dp} END")


def edit_distance(a: str, b: str) -> Column:
    return F.expr(edit_distance_sql(_q(a), _q(b)))
