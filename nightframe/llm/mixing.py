"""Mixing sources to target weights by thresholds on a hash.

Sources, by code point with null last, weigh ``WEIGHTS`` in turn and share ``share`` times all words.
A target stops at ``most`` times its source's words; what is cut off is shared again by weight until
no target is above its limit (water filling, solved in one pass over the sources).

Every document has a 60-bit hash. A source whose target is c whole times its words and a rest takes
all documents c times and, for the rest, those whose hash is below a threshold. The threshold comes
from histograms: words by source and top hash bits, the bucket in which the running sum passes the
rest, then the next bits of that bucket only, and so on; no row is sorted. The last document is taken
if that comes nearer to the rest than leaving it. Rows with the same id and text have the same hash
and are taken or left together. A null text has no words and a null source is a source of its own;
documents without words are taken along but add nothing. The hash depends on id and text alone, so
reruns agree. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common

#: White space that parts words.
SEPARATORS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
LEVELS, LEVEL_BITS = 4, 15


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, src (source with a flag for null first), size, hash; written, as it is read once a level."""
    base = common.with_words(common.keyed(docs, "doc_id", "text", "source"), F.col("text"), SEPARATORS)
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return base.select(
        "doc_id",
        "k_id",
        "k_text",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("src"),
        F.size("words").cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
    )


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """src, source_size, target: one row per source, from one combinable sum."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    # sources fill up in the order of limit over weight; the level is set by those not yet full
    fill = Window.orderBy("ratio", "src")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    per = per.withColumn("budget", share * F.sum("source_size").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    per = per.withColumn("level_here", level)
    # counting a source as full that isn't lowers the level, so the highest one that holds is right
    open_level = F.max(F.when(F.col("level_here") < F.col("ratio"), F.col("level_here"))).over(everything)
    per = per.withColumn("level", open_level)
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return per.select("src", "source_size", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """src, source_size, target, whole (copies of every document), below (hashes under it are taken once more)."""
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    state = goals.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "over": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        below = LEVEL_BITS * (LEVELS - level)
        bucket = F.shiftright("hash", below)
        inside = sizes if level == 1 else sizes.join(
            state.select("src", "prefix"), (sizes.src == state.src) & (F.shiftright(sizes.hash, below + LEVEL_BITS) == state.prefix)
        ).select(sizes["*"])
        sums = inside.groupBy("src", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        # the bucket in which the sum passes what is left to take
        edge = sums.join(state.select("src", "rest"), "src").filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        edge = edge.select("src", F.col("bucket").alias("next"), "before", "words")
        state = state.join(edge, "src", "left")
        # a source whose documents all have no words has no such bucket; nothing of it is lost by taking none
        left = F.col("rest") - F.coalesce("before", F.lit(0))
        state = state.withColumn("over", F.coalesce(F.col("words"), F.lit(0))).withColumn("rest", left).withColumn("prefix", F.coalesce("next", F.lit(-1)))
        state = common.staged(state.drop("next", "before", "words"), f"level{level}")  # a row per source
    # the last bucket is one hash: take it if the sum then is nearer to the goal
    take = (F.col("over") - F.col("rest") < F.col("rest")).cast("long")
    return state.select("src", "source_size", "target", "whole", (F.col("prefix") + take).alias("below"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, k_id, k_text, size, source_size, target, copies, taken."""
    sizes = common.staged(sized(docs), "sizes")
    goals = common.staged(targets(sizes, share, most, weights), "targets")
    limits = thresholds(sizes, goals)
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    return sizes.join(limits, "src").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("src", "whole", "below", "hash")


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    plan = mixed(docs).select("k_id", "k_text", "copies").distinct()
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return common.packed(docs).join(plan.filter(F.col("copies") > 0), ["k_id", "k_text"]).select("row", F.explode(times)).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss,
    CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * ss / w AS ratio, 1.5 * sum(ss) OVER () AS budget,
    coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY 2 * ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM s),
l AS (SELECT max((budget - used) / wl) FILTER (WHERE (budget - used) / wl < ratio) AS level FROM f),
t AS (SELECT source, ss, CASE WHEN level IS NULL OR ratio <= level THEN 2 * ss ELSE w * level END AS target FROM f, l),
g AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE floor(target / ss) END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.source, size, h, ss, target, whole, target - whole * ss AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
