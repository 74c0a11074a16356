"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule rejects a document whose ratio lies above its cutoff. Cutoffs are not chosen rule by rule: a fixed path of
steps lowers those of all rules together (``GRID``, for each rule down to its floor), and a document's step is the first
at which any rule rejects it. Labelled documents are the holdout, equal texts counting once: for each stratum (length
band) and step the good ones and the good ones rejected are counted. A step is certified if, were the true rate of false
rejections, of all rules jointly, ``alpha``, so few rejections would have a binomial probability of at most ``delta`` over
the number of strata; that is the exact (Clopper-Pearson) upper bound, with Bonferroni's correction over strata. Steps are tested
from the most lenient on and the first failure ends the sequence (fixed-sequence testing), so all certified steps hold
together with confidence 1 - delta, and a stratum's false rejections stay below ``alpha``. The certified step with
the best balance of bad and good rejections is used; a stratum without gain, or with too few labels, keeps all that
the base rules keep.

Contract. Words are runs without white space; a null text has none and fails the base rules. Labels of one
document or of equal texts that differ count as good if any does. Repeated rows each get their verdict. An empty table gives an empty
table; without labels only the base rules act. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import GAP, let, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RULES = ("symbol_ratio", "exclamation_ratio", "dup_line_ratio", "repeat_ratio")
GRID = (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)
# How far the path lowers each rule's cutoff: lists and refrains repeat lines and phrases in good texts, too.
FLOORS = {"symbol_ratio": 0.02, "exclamation_ratio": 0.02, "dup_line_ratio": 0.5, "repeat_ratio": 0.3}
BANDS = (50, 200, 1000)
ALPHA = 0.01
DELTA = 0.05
GOOD_WEIGHT = 10


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by windows of 8 words that occur twice or more."""
    def cover(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - x), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def positions(marked: Column) -> Column:
        twin = F.filter(marked, lambda e, k: F.coalesce(F.get(marked, k - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(marked, k + 1)["h"] == e["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twin, lambda e: e["i"])), cover)

    def of_windows(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(let(marked, positions))

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        windows = let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))), of_windows)
        return F.when(F.size(hashes) < WINDOW + 1, F.lit(0)).otherwise(windows)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def removed(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """Counts of every row, with its id and the ``carried`` columns; the text does not leave this step otherwise."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.select(
        F.col(id_col), *carried, F.xxhash64(text).alias("text_key"), of_words.alias("w"), of_lines.alias("l"), removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        removed(text, "!").cast("long").alias("n_exclamations"))
    return counted.select(id_col, *carried, "text_key", "w.*", "l.*", "n_symbols", "n_exclamations")


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def first_step() -> Column:
    """The step of the path at which the first rule rejects a document; the number of steps if none does."""
    def of(rule: str) -> Column:
        cutoffs = F.array(*[F.lit(max(c, FLOORS[rule])) for c in GRID])
        return F.size(F.filter(cutoffs, lambda c: F.col(rule) <= c))

    return F.least(*[of(r) for r in RULES])


def with_ratios(counted: DataFrame) -> DataFrame:
    band = sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))
    return (counted.withColumn("symbol_ratio", ratio("n_symbols", "word_chars"))
            .withColumn("exclamation_ratio", ratio("n_exclamations", "n_words"))
            .withColumn("dup_line_ratio", ratio("n_dup_lines", "n_lines"))
            .withColumn("repeat_ratio", ratio("n_repeat_words", "n_words"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .withColumn("stratum", band).withColumn("rejected_at", first_step()))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight places up, and back down by the product."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p); terms further than 40 deviations below k add nothing a double could hold."""
    log_top = (log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    first = F.greatest(F.lit(0).cast("double"), k - 40 * F.sqrt(n * p * (1 - p)) - 100)
    down = F.sequence(k.cast("long"), first.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(down, start, lambda a, j: F.struct(
        (a["term"] * j * (1 - p) / ((n - j + 1) * p)).alias("term"), (a["total"] + a["term"]).alias("total")), lambda a: a["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def certified_steps(rated: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """(stratum, step, n_good, good_hit, bad_hit, certified) of every stratum with labels and every step of the path."""
    good = labels.groupBy(F.col("doc_id").alias(id_col)).agg(F.max("quality").alias("good")).where("good is not null")
    texts = rated.where(~F.col("base_failed")).join(good, id_col).groupBy("stratum", "text_key", "rejected_at").agg(F.max("good").cast("long").alias("good"))
    # strata x steps x 2 rows at most
    counted = texts.groupBy("stratum", "rejected_at", "good").agg(F.count(F.lit(1)).alias("n"))
    steps = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("step"))
    hit = F.col("rejected_at") <= F.col("step")

    def number(what: Column) -> Column:
        return F.sum(F.when(what, F.col("n")).otherwise(0))

    sums = steps.groupBy("stratum", "step").agg(number(F.col("good") == 1).alias("n_good"), number((F.col("good") == 1) & hit).alias("good_hit"),
                                                number((F.col("good") == 0) & hit).alias("bad_hit"))
    level = delta / (len(BANDS) + 1)
    passed = (binomial_at_most(F.col("good_hit").cast("double"), F.col("n_good").cast("double"), alpha) <= level) & (F.col("n_good") > 0)
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("passed", passed).withColumn("certified", F.min("passed").over(so_far)).drop("passed")


def cutoffs(rated: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """(stratum, step): the certified step with the greatest gain, the most lenient among equals; strata without gain are absent."""
    gain = F.col("bad_hit") - GOOD_WEIGHT * F.col("good_hit")
    useful = certified_steps(rated, labels, alpha, delta, id_col).withColumn("gain", gain).where("certified and gain > 0")
    return useful.groupBy("stratum").agg(F.max_by("step", F.struct(F.col("gain"), -F.col("step"))).alias("step"))


def judged(rated: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str) -> DataFrame:
    # one row per length band at most, so it may be broadcast
    chosen = F.broadcast(cutoffs(rated, labels, alpha, delta, id_col))
    rejected = F.coalesce(F.col("rejected_at") <= F.col("step"), F.lit(False))
    return rated.join(chosen, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features, base verdict and ``kept`` of every row of ``docs``."""
    return judged(with_ratios(written(features(docs, id_col, text_col), "quality-features")), labels, alpha, delta, id_col)


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. Rows are written beside their counts, so no text is shuffled or counted twice."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    counted = written(features(rows, "own_id", "own_text", "row"), "quality-rows")
    named = labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels
    return judged(with_ratios(counted), named, alpha, delta, "own_id").where("kept").select("row.*")
