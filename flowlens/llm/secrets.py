"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong candidates stand alone: assigned secrets, access identifiers and long hex runs. Weak ones mean little by
themselves: named identifiers (``id``), mixed 40-character strings (``blob``) and endpoints with a scheme
(``endpoint``). All are cut out as spans, dealt into scopes of ``SCOPE`` code points and interval-joined with the
parts of the same and the neighbouring scopes. A weak identifier is reported where a secret lies within a scope's
length of it, a blob where an identifier or endpoint does, an endpoint where both an identifier and a secret do.

Only texts with a candidate leave the scan, and of them only the spans. Spans of one kind do not overlap, so a
scope holds few of them however many a text has.

Contract. A null text is an empty one and has no spans. Repeated rows get the same spans; rows that
share an id but not the text are kept apart. Positions are code points, ends exclusive. An empty table gives an empty table. Only
the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import written

# Fixed patterns of the base kinds, and the shortest group or match that counts. Runs are greedy, so asking
# for the length within the pattern finds the same access and hex matches as dropping short ones afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6

WEAK_ID = r"""(?i)\b(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
BLOB = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\x20\x09-\x0D"'<>]+"""

KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "id": WEAK_ID, "blob": BLOB, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id"), ("assign", "hex", "blob"), ("endpoint",)
SCOPE = 300


def found(text: Column, pattern: str) -> Column:
    """(gaps, matches): lengths of the text between matches, and the matches; null where there are none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(gaps.alias("gaps"), matches.alias("matches")))


def key_columns(row_id: Column, text: Column) -> list[Column]:
    """128 bits that stand for an id and its text."""
    return [F.xxhash64(row_id, text).alias("key_a"), F.xxhash64(F.lit("second"), F.octet_length(text), text, row_id).alias("key_b")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key of id and text, and what each pattern found; the text is left behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), *key_columns(F.col(id_col), text), *(found(text, p).alias(k) for k, p in KINDS.items()))


def spans_of(scanned: DataFrame) -> DataFrame:
    """(key_a, key_b, kind_no, kind, start, end) of every candidate, once per distinct document."""
    some = scanned.where(F.coalesce(*(F.col(k)["gaps"] for k in KINDS)).isNotNull()).dropDuplicates(["key_a", "key_b"])
    kinds = F.array(*(F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), F.col(k)["gaps"].alias("gaps"),
                               F.col(k)["matches"].alias("matches")) for i, k in enumerate(KINDS)))
    per_kind = some.select("key_a", "key_b", F.explode(F.filter(kinds, lambda x: x["gaps"].isNotNull())).alias("k"))
    rows = per_kind.select("key_a", "key_b", "k.kind_no", "k.kind", "k.gaps", F.posexplode("k.matches").alias("n", "match")).select(
        "key_a", "key_b", "kind_no", "kind", "n", F.get("gaps", F.col("n")).alias("gap"), "match")
    so_far = Window.partitionBy("key_a", "key_b", "kind_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    long_enough = (F.col("kind") != "assign") | (F.length(F.regexp_extract("match", ASSIGN, 2)) >= MIN_ASSIGNED)
    return placed.where(long_enough).select("key_a", "key_b", "kind_no", "kind", (F.col("end") - F.length("match")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates that have their complementary parts within ``scope`` code points."""
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    part = F.when(F.col("kind").isin(*IDENTIFIERS), "identifier").when(F.col("kind").isin(*SECRETS), "secret").otherwise("endpoint")
    weak = spans.where(~F.col("kind").isin(*BASE)).withColumn("scope_no", F.explode(F.sequence(first - 1, last + 1)))
    parts = spans.select("key_a", "key_b", F.col("start").alias("p_start"), F.col("end").alias("p_end"), part.alias("part"),
                         F.explode(F.sequence(first, last)).alias("scope_no"))
    near = F.greatest("start", "p_start") - F.least("end", "p_end") <= scope
    names = ["key_a", "key_b", "kind_no", "kind", "start", "end"]
    seen = weak.join(parts, ["key_a", "key_b", "scope_no"]).where(near).groupBy(*names).agg(
        *(F.max((F.col("part") == p) & ~((F.col("p_start") == F.col("start")) & (F.col("p_end") == F.col("end")))).alias(p)
          for p in ("identifier", "secret", "endpoint")))
    complete = F.when(F.col("kind") == "id", F.col("secret")).when(F.col("kind") == "blob", F.col("identifier") | F.col("endpoint")) \
        .otherwise(F.col("identifier") & F.col("secret"))
    return seen.where(complete).select(*names)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(id, spans) of every row: array of (start, kind_no, kind, end) by start, then kind."""
    scanned = written(scan(docs, id_col, text_col), "secret-scan")
    spans = written(spans_of(scanned), "secret-spans")
    kept = spans.where(F.col("kind").isin(*BASE)).unionByName(linked(spans, scope))
    gathered = kept.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return scanned.select(id_col, "key_a", "key_b").join(gathered, ["key_a", "key_b"], "left").select(
        id_col, F.coalesce("spans", none).alias("spans"), *(["key_a", "key_b"] if keys else []))


def merged(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its spans (sorted by start) replaced; spans that overlap or touch share one mark."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = (span["start"] > state["at"]) | (state["at"] == 0)
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda state: F.concat(
        state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))


def redacted(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span's text replaced by ``mark``; only texts with a candidate are joined."""
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    candidate = F.regexp_like(text, F.lit(ASSIGN))
    for pattern in list(KINDS.values())[1:]:
        candidate = candidate | F.regexp_like(text, F.lit(pattern))
    spans = secret_spans(docs.select(id_col, text_col), scope, id_col, text_col, keys=True).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["key_a", "key_b"]).select("key_a", "key_b", "spans")
    keys = key_columns(F.col(f"row.{id_col}"), text)
    marked = rows.where(candidate).select("row", *keys).join(spans, ["key_a", "key_b"], "left").select(
        F.when(F.col("spans").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, merged(text, F.col("spans"), mark))).alias("row"))
    return rows.where(~candidate).unionByName(marked).select("row.*")
