"""Gap-free row numbering and running sums without a single-partition window, global and by group.

``row_number() over (order by k)`` moves every row into one task. Instead:
  1. range-partition on the order key and sort within partitions (the same shuffle a global
     sort does; hot keys are split because the key is a total order),
  2. count rows per partition (one row per partition -> bounded by the partition count),
  3. prefix-sum those counts on the tiny table and broadcast it,
  4. index = partition offset + position inside the partition.
Steps 2 and 4 must see the very same partitions. Range bounds are sampled from the input, and
an input produced by a shuffle has no fixed row order, so a recomputation could draw other
bounds; the sorted data is therefore materialised once with a reliable checkpoint in the shared
``spark.checkpoint.dir`` (which also cuts the lineage against executor loss).

Within groups, ``with_running`` needs no sampled bounds and so no checkpoint; see there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import cut_lineage, shuffle_partitions


def with_row_index(df: DataFrame, order_cols: list, index_col: str = "row_index",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based bigint index following ``order_cols`` (which must be a total order)."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    sorted_df = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    sorted_df = (sorted_df.withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    per_part = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # offsets has one row per partition: a size bound known before the job runs.
    return (sorted_df.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
            .withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_base")).cast("bigint"))
            .drop("_pid", "_mid", "_off", "_base"))


# Rows that one task numbers: a larger group is cut into ranges of about this many.
PIECE_ROWS = 1 << 20
# Bytes of a text key that its place in a range is read from, behind what the range's ends have in common.
KEY_BYTES = 6


def _seconds(c: Column) -> Column:
    """A timestamp without zone as seconds since 1970, in its own order whatever the session's zone."""
    return (F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))


def _common(a: Column, b: Column) -> Column:
    """How many leading bytes two binaries share."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.octet_length(a), F.octet_length(b))))
    differ = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.least(F.octet_length(a), F.octet_length(b)))


def _number(c: Column, kind: str, skip: Column) -> Column:
    """A key as a double that never falls along the key's order."""
    if kind == "string":
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), skip + 1, F.lit(KEY_BYTES))), 2 * KEY_BYTES, "0")
        return F.conv(digits, 16, 10).cast("double")
    return _seconds(c) if kind == "timestamp_ntz" else c.cast("double")


def with_running(df: DataFrame, group_cols: list[str], order: list[str], values: dict[str, Column],
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add, for every row, the sums of ``values`` over the rows before it in its group (0 for the first).

    ``order`` names the columns of a total order within the group, ascending; the first may be null (nulls last), of the
    types number, timestamp without zone or text. Prefix sums in two levels, with no row of a hot group in the wrong
    place and none of them collected:

      1. a group of more than ``piece_rows`` rows is cut into ranges of its first order column that varies, by linear
         interpolation between its least and greatest value; the table of such groups has at most rows / piece_rows rows;
      2. each (group, range) is summed by one partial aggregate, and the ranges before it by a window over that table;
      3. rows are summed inside their range by a window, and the range's start is added.

    Every step is a plan; nothing runs while it is built. Ranges depend on the data alone, so a lost task repeats them.
    """
    kinds = dict(df.dtypes)
    null_flag = "_last"
    rows = df.withColumn(null_flag, F.col(order[0]).isNull())
    span = [f(F.col(c)).alias(f"{p}{i}") for i, c in enumerate(order) for f, p in ((F.min, "_lo"), (F.max, "_hi"))]
    large = rows.groupBy(*group_cols, null_flag).agg(F.count(F.lit(1)).alias("_n"), *span).where(F.col("_n") > piece_rows)
    texts = [i for i, c in enumerate(order) if kinds[c] == "string"]
    large = large.withColumns({f"_skip{i}": _common(F.col(f"_lo{i}").cast("binary"), F.col(f"_hi{i}").cast("binary")) for i in texts})
    ranged = _joined(rows, large, [*group_cols, null_flag])

    def place(i: int) -> Column:
        lo, hi, kind = F.col(f"_lo{i}"), F.col(f"_hi{i}"), kinds[order[i]]
        a, b, x = (_number(c, kind, F.col(f"_skip{i}") if i in texts else F.lit(0)) for c in (lo, hi, F.col(order[i])))
        return F.when(lo < hi, F.floor((x - a) / (b - a + 1) * F.ceil(F.col("_n") / piece_rows)))

    piece = F.coalesce(*[place(i) for i in range(len(order))], F.lit(0)).cast("bigint")
    ranged = ranged.withColumn("_piece", F.when(F.col("_n").isNull(), F.lit(0).cast("bigint")).otherwise(piece)).drop("_n", *[
        f"{p}{i}" for i in range(len(order)) for p in ("_lo", "_hi", "_skip")])
    summed = ranged.withColumns({f"_v_{c}": v for c, v in values.items()})

    keys = [*group_cols, null_flag, "_piece"]
    before = Window.partitionBy(*group_cols).orderBy(null_flag, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (summed.groupBy(*keys).agg(*[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in values])
              .select(*keys, *[F.sum(f"_t_{c}").over(before).alias(f"_s_{c}") for c in values])
              .where(F.col(f"_s_{next(iter(values))}").isNotNull()))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = summed.withColumns({f"_i_{c}": F.coalesce(F.sum(f"_v_{c}").over(inside), F.lit(0)) for c in values})
    out = _joined(within, starts, keys)
    added = {c: (F.col(f"_i_{c}") + F.coalesce(f"_s_{c}", F.lit(0))).cast("bigint") for c in values}
    return out.withColumns(added).drop(null_flag, "_piece", *[f"{p}{c}" for c in values for p in ("_v_", "_i_", "_s_")])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys that may be null; the right side's other columns are added."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"_k_{k}" for k in keys])


def with_group_index(df: DataFrame, group_cols: list[str], order: list[str], index_col: str,
                     piece_rows: int = PIECE_ROWS) -> DataFrame:
    """0-based index inside each group (a dense per-group row number) along ``order``; see ``with_running``."""
    return with_running(df, group_cols, order, {index_col: F.lit(1)}, piece_rows)
