"""Mixing sources to target weights: weighted sampling without replacement by exponential keys.

Every document gets the key -ln(u) / weight, u being a hash of its id. The documents of a source
with the smallest keys are a weighted random sample (Efraimidis and Spirakis). A source first gives
its whole documents as often as its budget holds them all (epochs); what is left of the budget goes
to documents in key order until their running sum of words fills it.

The running sum needs no sorted source: words are added up per (source, key range), the range in
which the budget ends is found on those sums, and only the rows of that one range are sorted. What
remains is one cut key per source, so documents are not shuffled, and a source with a third of all
rows is read by as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.arrow import broadcast_if_small, prepare
from runledger.session import cut_to_table

WORD = r"[^\x20\x09-\x0D]+"
JUNK = "!#$%&*|"
RANGE_ROWS = 50_000  # rows of a key range, about


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: falls with the share of junk signs in the text."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 4.0 * junk / F.greatest(n, F.lit(1))), F.lit(1.0))


def sample_key(id_col: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key: smaller comes first, heavier documents sooner. Same id, same key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48 + 1))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources from rows (source, source_size).

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times all words.
    No target is above `cap` times its source's size; what is above goes to the others by weight,
    until none is above. That is the level L with sum(min(cap * size, L * weight)) = share * words,
    found on the sources sorted by cap * size / weight. One row per source passes this window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("n", F.row_number().over(order) - 1)
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")))
    sizes = sizes.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "n")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    sizes = (sizes
             .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             .withColumn("among", F.sum("weight").over(after)))
    open_row = F.col("most") / F.col("weight") > F.col("left") / F.col("among")
    first = F.min(F.when(open_row, F.struct((F.col("most") / F.col("weight")).alias("ratio"), "n", "left", "among"))).over(everything)
    sizes = sizes.withColumn("level", first)
    level = F.col("level.left") * F.col("weight") / F.col("level.among")
    return sizes.select("source", "source_size", F.coalesce(F.least("most", level), F.col("most")).alias("target"))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each source's budget ends, from rows (source, size, key).

    Per source: source_size, target, epochs, cut (documents with smaller keys are taken once more),
    part (words left for the documents with just this key, nearly always one) and tied (their words).
    """
    goal = targets.select(F.col("source").alias("src"), "source_size", "target",
                          F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).alias("epochs"))
    goal = goal.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    per_source = sized.groupBy("source").agg(F.count("*").alias("rows"), F.avg("weight").alias("mean_weight"))
    goal = goal.join(per_source, F.col("src").eqNullSafe(F.col("source"))).drop("source")
    ranged = (sized.join(goal, sized.source.eqNullSafe(goal.src))
              .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
              .withColumn("range", F.least(F.col("ranges") - 1, F.floor(F.col("ranges") * (1 - F.exp(-F.col("key") * F.col("mean_weight")))))))
    sums = ranged.groupBy("src", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("src").orderBy("range"))
    ends = (sums.withColumn("start", upto - F.col("words")).where((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest")))
            .select(F.col("src").alias("end_src"), F.col("range").alias("end_range"), "start"))
    last = (ranged.join(ends, F.col("src").eqNullSafe(F.col("end_src")) & (F.col("range") == F.col("end_range")))
            .groupBy("src", "key").agg(F.sum("size").alias("tied"), F.first("rest").alias("rest"), F.first("start").alias("start")))
    last = last.withColumn("below", F.col("start") + F.sum("tied").over(Window.partitionBy("src").orderBy("key")) - F.col("tied"))
    last = (last.where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("tied") > F.col("rest")))
            .select(F.col("src").alias("cut_src"), F.col("key").alias("cut"), (F.col("rest") - F.col("below")).alias("part"), "tied"))
    return (goal.join(last, F.col("src").eqNullSafe(F.col("cut_src")), "left")
            .select("src", "source_size", "target", "epochs", "cut", "part", "tied"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
        weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows of `docs` (columns `keep`, all if None) with size, source_size, target and taken.

    taken: words that the mix takes of the document, repeats counted. The words taken of a source are
    its target rounded down (documents that share one key split what is left by size, rounded down).
    Null or empty texts have size 0 and nothing is taken of them. Repeated rows count one by one and
    get equal shares. An empty table gives no rows. Other columns pass through; those named like a
    result column are replaced.
    """
    prepare(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                        quality_weight(F.col(text_col)).alias("weight"))
    sized = sized.withColumn("key", sample_key(F.col("id"), F.col("weight"), seed))
    narrow = keep is not None and set(keep) <= {id_col, source_col}
    sized = cut_to_table(sized)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ends = broadcast_if_small(cut_to_table(cuts(sized, cut_to_table(targets))))  # one row per source
    results = ("size", "source_size", "target", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    if narrow:
        rows = sized.select(F.struct(*[F.col("id" if c == id_col else "source").alias(c) for c in kept]).alias("row"), "source", "key", "size")
    else:
        rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), sample_key(F.col(id_col), quality_weight(F.col(text_col)), seed).alias("key"), word_count(F.col(text_col)).alias("size"))
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("src")), "left")
    exact = F.col("part").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") / F.col("tied").cast("decimal(19,0)")
    extra = (F.when(F.col("cut").isNull(), 0).when(F.col("key") < F.col("cut"), F.col("size"))
             .when(F.col("key") == F.col("cut"), F.floor(exact).cast("long")).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    return rows.select("row.*", "size", "source_size", "target", taken)
