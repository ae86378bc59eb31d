"""Ranked word search over events: a term table, matching by term, ranks and pages."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.payload import json_values
from runledger.operators.runs import page, page_size

# Field weights and the words left out of the index.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "if", "in", "is", "it", "no", "not", "of",
              "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
WORD = "[a-z0-9]+"
ANY_WORD = r"[\p{L}\p{M}\p{N}]+"  # words of all scripts, for `word`


def words(text: str | Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(word), 0)


def build_search_index(ev: DataFrame, word: str = WORD) -> DataFrame:
    """One row per word of an event: term, weight class, place.

    A: type and agent; B: framework and tags; C: string and number values of the payload.
    Places count the words of one field, stop words included.
    """
    def field(weight: str, text: Column) -> Column:
        return F.struct(F.lit(weight).alias("weight"), words(text, word).alias("words"))

    parts = F.array(
        field("A", F.coalesce("type", F.lit(""))), field("A", F.coalesce("source_agent", F.lit(""))),
        field("B", F.coalesce("source_framework", F.lit(""))), field("B", F.coalesce(F.array_join("tags", " "), F.lit(""))))
    values = F.transform(F.coalesce(json_values("payload"), F.array().cast("array<string>")), lambda v: field("C", v))
    rows = ev.select("id", "run_id", "tenant_id", "type", "timestamp",
                     F.posexplode(F.concat(parts, values)).alias("field_no", "field"))
    terms = rows.select("id", "run_id", "tenant_id", "type", "timestamp", "field.weight", "field_no",
                        F.posexplode("field.words").alias("pos", "term"))
    return terms.where(~F.col("term").isin(STOP_WORDS))


def build_text_index(df: DataFrame, key: str, text: str, word: str = WORD) -> DataFrame:
    """The same for plain text rows, all of weight C."""
    terms = df.select(F.col(key).alias("id"), F.lit("C").alias("weight"), F.lit(0).alias("field_no"),
                      F.posexplode(words(text, word)).alias("pos", "term"))
    return terms.where(~F.col("term").isin(STOP_WORDS))


STORE = ["batch", "buckets", "bucket"]  # folders of a stored index


def write_search_index(index: DataFrame, path: str, batch: int, buckets: int = 256) -> None:
    """Store the index rows of one batch: a folder per bucket of terms, rows in order of the term.

    The same batch again replaces its own folders only. Files of hot buckets are split, small ones joined at run
    time. Batches may have other numbers of buckets.
    """
    rows = index.withColumns({
        "batch": F.lit(batch).cast("bigint"), "buckets": F.lit(buckets), "bucket": F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")})
    rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*STORE).parquet(path)


def read_search_index(spark: SparkSession, path: str, schema, terms: list[str] | None = None) -> DataFrame:
    """A stored index, `schema` as of the rows written; with `terms` only their rows, from the files of their buckets.

    Give all words a search names, those of `none_of` too. Without `terms` the index is read whole.
    """
    columns = list(schema.fieldNames())
    for name, kind in zip(STORE, ("long", "integer", "integer"), strict=True):
        schema = type(schema)([*schema.fields]).add(name, kind)
    rows = spark.read.schema(schema).parquet(path)
    if terms is not None:
        terms = sorted({t.lower() for t in terms})
        codes = F.array(*[F.lit(crc32(t.encode())).cast("bigint") for t in terms]) if terms else F.array().cast("array<bigint>")
        rows = rows.where(F.exists(codes, lambda c: F.pmod(c, F.col("buckets")) == F.col("bucket"))).where(F.col("term").isin(terms))
    return rows.select(*columns)


def search_match(index: DataFrame, all_of: list[str] | None = None, any_of: list[str] | None = None,
                 none_of: list[str] | None = None, phrases: list[list[str]] | None = None) -> DataFrame:
    """Ids of events with all of these words, any of these, none of these, and all phrases.

    Stop words are not asked for; in phrases they keep their place. Without any other word to have,
    all indexed events without the words of `none_of` match, or none if that is empty too.

    One aggregate per event decides about the words: it needs only the postings of the
    words asked for, filtered before the shuffle.
    """
    all_of, any_of, none_of = (query_words(x) for x in (all_of, any_of, none_of))
    phrases = [p for p in ([(i, w) for i, w in enumerate(x.lower() for x in phrase) if w not in STOP_WORDS] for phrase in phrases or []) if p]
    having = {*all_of, *any_of, *[w for p in phrases for _, w in p]}
    hits = index.where(F.col("term").isin(sorted(having | set(none_of))))
    if not having:
        without = hits.select("id")
        return index.select("id").distinct().join(without, "id", "left_anti") if none_of else without
    good = F.bool_or(F.col("term").isin(sorted(having)))
    for word in all_of:
        good = good & F.bool_or(F.col("term") == word)
    if any_of:
        good = good & F.bool_or(F.col("term").isin(any_of))
    if none_of:
        good = good & ~F.bool_or(F.col("term").isin(none_of))
    ids = hits.groupBy("id").agg(good.alias("good")).where("good").select("id")
    for phrase in phrases:
        ids = ids.join(_phrase(hits, phrase), "id", "left_semi")
    return ids


def query_words(words: list[str] | None) -> list[str]:
    """The words of a query that an index can hold."""
    return [w for w in (x.lower() for x in words or []) if w not in STOP_WORDS]


def _phrase(hits: DataFrame, phrase: list[tuple[int, str]]) -> DataFrame:
    """Events with the words at these distances, by counting the words that fit one start place."""
    starts = F.array(*[F.when(F.col("term") == w, F.struct((F.col("pos") - i).alias("start"), F.lit(i).alias("i")))
                       for i, w in phrase])
    return (
        hits.select("id", "field_no", F.explode(F.array_compact(starts)).alias("s"))
        .groupBy("id", "field_no", "s.start").agg(F.count_distinct("s.i").alias("fit"))
        .where(F.col("fit") == len(phrase)).select("id").distinct()
    )


def _term_score() -> Column:
    weight = F.lit(0.0)
    for name, value in WEIGHTS.items():
        weight = F.when(F.col("weight") == name, value).otherwise(weight)
    return weight * (1 - 1 / (1 + F.col("tf")))


def search_rank(index: DataFrame, ids: DataFrame, terms: list[str]) -> DataFrame:
    """Rank of the matched events: weight times 1 - 1/(1 + count), summed over term and weight class."""
    counts = index.where(F.col("term").isin([t.lower() for t in terms])).join(ids, "id", "left_semi").groupBy(
        "id", "term", "weight").agg(F.count("*").alias("tf"))
    scored = counts.groupBy("id").agg(F.round(F.sum(_term_score()), 9).alias("rank"))
    return ids.join(scored, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def search_filters(ev: DataFrame, tenant: str | None = None, run: str | None = None, types: list[str] | None = None,
                   after=None, before=None) -> DataFrame:
    """Filters that go before matching; they work on events and on the index."""
    if tenant:
        ev = ev.where(F.col("tenant_id") == tenant)
    if run:
        ev = ev.where(F.col("run_id") == run)
    if types:
        ev = ev.where(F.col("type").isin(types))
    if after is not None:
        ev = ev.where(F.col("timestamp") >= F.lit(after))
    if before is not None:
        ev = ev.where(F.col("timestamp") <= F.lit(before))
    return ev


def headline_text() -> Column:
    """The text headlines are cut from: type, agent and payload of an event."""
    return F.concat_ws(" ", F.coalesce("type", F.lit("")), F.coalesce("source_agent", F.lit("")), "payload")


def mark(text: str | Column, terms: list[str]) -> Column:
    """Words of the query wrapped in <mark>."""
    quoted = "|".join(r"\Q" + t.lower().replace("\\E", r"\E\\E\Q") + r"\E" for t in terms)
    pattern = r"(?i)(?<!\w)(" + quoted + r")(?!\w)"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def search_headline(rows: DataFrame, text: Column, terms: list[str], fragments: int = 3, max_words: int = 35) -> DataFrame:
    """Adds `headline`: up to three pieces of the marked text around the first hits."""
    parts = F.split(mark(text, terms), r"\s+")
    size = F.size("_w")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / max_words).cast("int")),
                         lambda b: F.array_join(F.slice("_w", b * max_words + 1, F.lit(max_words)), " "))
    hit = F.filter(blocks, lambda t: F.contains(t, F.lit("<mark>")))
    head = F.when(F.size(hit) > 0, F.array_join(F.slice(hit, 1, fragments), " … ")).otherwise(F.element_at(blocks, 1))
    return rows.withColumn("_w", parts).withColumn("headline", head).drop("_w")


def search_page(hits: DataFrame, limit: int | None = None, cursor: tuple | None = None) -> DataFrame:
    """One page, rank falling, then id rising; `has_more` tells of a further page."""
    return page(hits, [("rank", True), ("id", False)], page_size(limit), list(cursor) if cursor else None)


def search_total(hits: DataFrame, approx: bool = False) -> DataFrame:
    """Number of hits. `approx` estimates the number of different ids by a sketch (about 1.6 % off), so hits may come from overlapping searches."""
    return hits.agg((F.hll_sketch_estimate(F.hll_sketch_agg("id", 12)) if approx else F.count("*")).alias("total"))


def search_batch(index: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Many queries at once: `queries` has query_id and term; the best `top` events of each.

    An event must hold all terms of the query. The rank filter lets Spark keep the best rows
    of each query before the shuffle, so a query that hits everything stays cheap.
    """
    terms = queries.select("query_id", F.lower("term").alias("term")).where(~F.col("term").isin(STOP_WORDS)).distinct()
    sizes = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    asked = index.join(terms.select("term").distinct(), "term", "left_semi")
    # One score per event and term before the queries are joined, so a term many queries share is counted once.
    postings = asked.groupBy("id", "term", "weight").agg(F.count("*").alias("tf")).groupBy("id", "term").agg(
        F.sum(_term_score()).alias("score"))
    scored = (
        postings.join(terms, "term")
        .groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("rank"), F.count("*").alias("found"))
        .join(sizes, "query_id").where(F.col("found") == F.col("n_terms"))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("rank").desc(), F.col("id"))
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("query_id", "place", "id", "rank")
