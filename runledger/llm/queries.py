"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import chat, decontaminate, fingerprints, languages, lines, mixing, near, quality, repeats, toxicity, tries, warc, whitening
from runledger.llm.arrow import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; every one runs with the settings of this library."""

    def keep(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '!#$%&*|', ''))) / greatest(length(text), 1)), 1.0::DOUBLE) AS weight,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE AS u
  FROM documents
), k AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS total FROM k GROUP BY source),
w AS (SELECT source, total, 2.0::DOUBLE * total AS most, n, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][n % 3 + 1] AS weight
      FROM (SELECT source, total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s)),
l AS (SELECT *, 1.5::DOUBLE * sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
      sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among FROM w),
f AS (SELECT arg_min(rest, struct_pack(a := most / weight, b := n)) AS rest, arg_min(among, struct_pack(a := most / weight, b := n)) AS among
      FROM l WHERE most / weight > rest / among),
t AS (SELECT source, total::BIGINT AS source_size, coalesce(least(most, f.rest * weight / f.among), most) AS target FROM w CROSS JOIN f),
g AS (SELECT source, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
c AS (SELECT k.doc_id, k.size::BIGINT AS size, g.source_size, g.target, g.epochs, floor(g.target)::BIGINT - g.epochs * g.source_size AS rest,
             (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto,
             (sum(k.size) OVER (PARTITION BY k.source, k.key))::BIGINT AS tied
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - tied >= rest THEN 0
                             ELSE ((rest - (upto - tied))::HUGEINT * size) // tied END)::BIGINT AS taken
FROM c
"""


@query("op6_mix_sources", MIXING_SQL)
def op6(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:SYS|INST|TOOL|TEXT)\]|ROLE\])', '\1\3\\\2\4', 'g')) AS n,
         length(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:SYS|INST|TOOL|TEXT)\]|ROLE\])', '\1\3\\\2\4', 'g')) AS r
  FROM c
), q AS (SELECT *, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'tool' THEN 13 ELSE 19 + r END AS marks FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + marks)::BIGINT AS formatted_chars
FROM q GROUP BY conv_id
"""


@query("op10_format_chats", CHAT_SQL)
def op10(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = chat.format_chats(turns.unionByName(fixed))
    read = chats.select("conv_id", chat.formatted(F.col("segments")).alias("all"), chat.loss_text(F.col("segments")).alias("under_loss"))
    parsed = chat.parse_turns(F.col("all"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.withColumn("turns", parsed).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"), F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("all").cast("long").alias("formatted_chars"))


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS key FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION SELECT item, 10, array_to_string(w[s:s + 9], ' ') FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS s FROM b WHERE len(w) >= 10)
), o AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM i))
), m AS (SELECT r, s, n, item FROM o JOIN i USING (n, key)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op2_decontaminate", DECONTAMINATION_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, i, x[i] AS line FROM (SELECT r, doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
w AS (SELECT *, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM l),
c AS (SELECT s, len(s) AS n, min((doc_id, i)) AS at FROM w WHERE len(s) > 0 GROUP BY s),
m AS (SELECT DISTINCT a.at FROM c a JOIN c b ON b.at < a.at AND 4 * b.n <= 5 * a.n AND 4 * a.n <= 5 * b.n
      WHERE 5 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
k AS (SELECT w.*, len(w.s) > 0 AND ((w.doc_id, w.i) <> c.at OR m.at IS NOT NULL) AS gone
      FROM w LEFT JOIN c ON w.s = c.s LEFT JOIN m ON c.at = m.at)
SELECT d.doc_id, count(k.i)::BIGINT AS n_lines, count(*) FILTER (k.gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (NOT k.gone), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id
"""


@query("op9_dedup_lines", LINES_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept_sha256")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), x AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), c AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM x WHERE len(s) > 0 GROUP BY 1, 2),
e AS (
  SELECT a.id AS a, b.id AS b, least(a.id, b.id) AS x FROM c a JOIN c b ON a.id < b.id AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(id, root) AS (SELECT id, id FROM c UNION SELECT u.b, t.root FROM t JOIN u ON u.a = t.id),
g AS (SELECT id, min(root) AS root FROM t GROUP BY id)
SELECT x.doc_id, len(x.s)::BIGINT AS n_shingles, coalesce(g.root, x.doc_id) AS component_id, x.doc_id = coalesce(g.root, x.doc_id) AS kept
FROM x LEFT JOIN c ON list_sort(x.s) = c.s LEFT JOIN g ON c.id = g.id
"""


@query("op7_near_duplicates", NEAR_SQL)
def op7(spark, sf_dir):
    return near.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, n - 199)) AS s FROM d WHERE n >= 200)),
m AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g
      FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM m)),
g AS (SELECT r, g, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY r, g),
h AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM g GROUP BY r),
k AS (SELECT g.r, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x
      FROM (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM g) AS g JOIN d ON d.r = g.r GROUP BY g.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN h.r IS NULL THEN d.x ELSE k.x || substr(d.x, 2 * h.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN k ON k.r = d.r
"""


@query("op1_remove_repeats", REPEATS_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_fingerprint_documents")
def op8(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_score_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op5_score_quality")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS largest FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(x, k * 5 + 1, 5))::BIGINT) AS parts FROM h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM b
"""


@query("op3_warc_archives", WARC_SQL)
def op3(spark, sf_dir):
    archives = warc.write_archives(warc.page_records(table(spark, sf_dir, "pages")))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return warc.read_records(archives).select(number("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                                              F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


@query("op11_identify_languages")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


TRIE_SQL = r"""
WITH k AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, token) - 1 AS pos, token, bytes
  FROM (SELECT conv_id, turn, role, substr(sha256(length(role) || ':' || role || text), 1, 32) || lpad(lower(hex(octet_length(encode(text)))), 16, '0') AS token, octet_length(encode(text)) AS bytes
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), s AS (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id),
c AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(s.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(k.steps[(xor(c, b) % 256) + 1], c // 256)), 4294967295) % 9 AS h
  FROM s CROSS JOIN k
), d AS (SELECT c.*, least(h, coalesce(b.size, 0)) AS taken FROM c LEFT JOIN s b ON b.conv_id = c.base),
r AS (
  SELECT conv_id, pos - h + taken + 1 AS depth, token, bytes FROM t JOIN d USING (conv_id) WHERE pos >= h
  UNION ALL SELECT d.conv_id, pos + 1, token, bytes FROM d JOIN t ON t.conv_id = d.base AND t.pos < d.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM d
), p AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(token, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM r
), q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
n AS (SELECT depth, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM q GROUP BY depth, key),
x AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
l AS (SELECT n.conv_id FROM n LEFT JOIN x USING (depth, key) WHERE x.n_children IS NULL),
v AS (SELECT q.conv_id, q.depth, q.key, sum(CASE WHEN n.conv_id = q.conv_id THEN (n_convs - 1) * n.bytes ELSE 0 END) OVER (PARTITION BY q.conv_id ORDER BY q.depth DESC) AS saved
      FROM q JOIN n USING (depth, key)),
a AS (SELECT depth, key, sum(saved)::BIGINT AS saved_tokens, count(l.conv_id) AS n_leaves FROM v LEFT JOIN l USING (conv_id) GROUP BY depth, key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(x.n_children, 0) AS n_children, a.n_leaves, a.saved_tokens, n.ends_sha256
FROM n JOIN a USING (depth, key) LEFT JOIN x USING (depth, key) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.up
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark, sf_dir):
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_whiten_embeddings")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
