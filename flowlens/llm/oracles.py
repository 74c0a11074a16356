"""DuckDB SQL for queries of this subpackage that SQL can state on whole tables, written from the contracts.

DuckDB has no CRC-32: ``CRC_TABLE`` makes its table of 256 from the reflected polynomial (fixed value), and ``crc32`` folds
a text's UTF-8 bytes over it. It is applied to distinct words and ids only.
"""

from __future__ import annotations

from flowlens.llm.quality_rules import ALPHA, BANDS, DELTA, FLOORS, GOOD_WEIGHT, GRID, MAX_REPEAT_PERCENT, MIN_WORDS, RULES

CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text expression, where ``t`` is the table."""
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""WITH {CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM n, crc),
c AS (SELECT h.conv_id, h.conv_id - h.conv_id % 20 AS base, h.n, h.h, least(h.h, coalesce(b.n, 0)) AS taken
      FROM h LEFT JOIN n b ON b.conv_id = h.conv_id - h.conv_id % 20),
r AS (SELECT c.conv_id, o.pos + 1 AS depth, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
      UNION ALL
      SELECT c.conv_id, c.taken + o.pos - c.h + 1, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix
      FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
node AS (SELECT p.prefix, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.words) AS words,
                sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth), '')) AS ends_sha256
         FROM p JOIN last l USING (conv_id) GROUP BY p.prefix, p.depth),
kids AS (SELECT left(prefix, len(prefix) - 32) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
-- every node counts for itself and for each node above it, found along its smallest member
above AS (SELECT a.prefix, sum(CASE WHEN k.prefix IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
          FROM node u JOIN p a ON a.conv_id = u.conv_id AND a.depth <= u.depth LEFT JOIN kids k ON k.prefix = u.prefix GROUP BY a.prefix)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
FROM node u JOIN above a USING (prefix) LEFT JOIN kids k USING (prefix)
LEFT JOIN node up ON u.depth > 0 AND up.prefix = left(u.prefix, len(u.prefix) - 32)"""

WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

IMPORTANCE_RESAMPLING = f"""WITH {CRC_TABLE},
dw AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
bw AS (SELECT unnest({WORDS}) AS word FROM benchmark),
words AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw) w, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN words USING (word) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)))) AS gain
         FROM (SELECT range AS bucket FROM range(10000)) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weight AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN words USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                          / 4294967296::DOUBLE)))::BIGINT AS score
           FROM (SELECT doc_id FROM documents) d LEFT JOIN weight USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
          QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank, n_features AS n_words FROM scored LEFT JOIN drawn USING (doc_id)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = "'[^\\x20\\x09-\\x0D]+'"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, lead(word, 2) OVER o AS last, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS shingle
                                            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) x WHERE last IS NOT NULL
      UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


def _cuts(rule: str) -> str:
    return "[" + ", ".join(repr(max(c, FLOORS[rule])) for c in GRID) + "]"


_FIRST = "least(" + ", ".join(f"len(list_filter({_cuts(r)}, lambda c: {r} <= c))" for r in RULES) + ")"

QUALITY_RULES = f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM (SELECT doc_id, text FROM documents) d),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, {WORD}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM t),
words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
windows AS (SELECT id, i, win FROM (SELECT id, i, lead(word, 7) OVER o AS last, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 8))}) AS win
                                    FROM words WINDOW o AS (PARTITION BY id ORDER BY i)) x WHERE last IS NOT NULL),
covered AS (SELECT id, count(DISTINCT place) AS n FROM (
  SELECT id, unnest(range(i, i + 8)) AS place FROM windows JOIN (SELECT id, win FROM windows GROUP BY id, win HAVING count(*) > 1) r USING (id, win)) c GROUP BY id),
f AS (SELECT id, doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
             len(text) - len(translate(text, '#*$%&|<>', '')) AS n_symbols, len(text) - len(translate(text, '!', '')) AS n_exclamations,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered c USING (id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             {" + ".join(f"(n_words >= {b})::INTEGER" for b in BANDS)} AS stratum, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
             n_exclamations / greatest(n_words, 1) AS exclamation_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_repeat_words / greatest(n_words, 1) AS repeat_ratio FROM f),
v AS (SELECT *, {_FIRST} AS rejected_at FROM r),
texts AS (SELECT stratum, text, rejected_at, max(good) AS good
          FROM v JOIN (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id HAVING max(quality) IS NOT NULL) l USING (doc_id)
          WHERE NOT base_failed GROUP BY ALL),
steps AS (SELECT stratum, step, sum((good = 1)::INTEGER) AS n, sum((good = 1 AND rejected_at <= step)::INTEGER) AS k,
                 sum((good = 0 AND rejected_at <= step)::INTEGER) AS bad FROM texts, (SELECT range AS step FROM range({len(GRID)})) g GROUP BY stratum, step),
passed AS (SELECT *, n > 0 AND k < n * {ALPHA} AND list_sum(list_transform(range(0, least(k, 100000)::BIGINT + 1), lambda j:
                  exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(greatest(n - j, 0) + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= {DELTA / (len(BANDS) + 1)} AS ok FROM steps),
certified AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS certified, bad - {GOOD_WEIGHT} * k AS gain FROM passed),
chosen AS (SELECT stratum, step FROM certified WHERE certified AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, step) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected_at <= step, false) AS kept, v.stratum AS stratum FROM v LEFT JOIN chosen USING (stratum)"""

CHAT_FORMATTING = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
-- a turn's marks have 15 characters; escaping adds one for every backslash, < and >
e AS (SELECT *, 15 + len(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + len(regexp_replace(text, '([\\<>])', '\\\1', 'g')) AS size,
             role = 'assistant' AS learnt FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE learnt), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE learnt), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

ORACLES: dict[str, str] = {"op2_ngram_join": NGRAM_JOIN, "op4_quality_rules": QUALITY_RULES, "op7_chat_formatting": CHAT_FORMATTING,
                           "op11_prefix_trie": PREFIX_TRIE, "op13_importance_resampling": IMPORTANCE_RESAMPLING}
