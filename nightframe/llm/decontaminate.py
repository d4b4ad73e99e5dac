"""Benchmark passages in documents: a prefix-filtered join of rare shingles, then exact comparison.

A benchmark text is cut into windows of ``window`` words (a shorter text is one window). A window
occurs in a document only if all of its shingles occur there in order, so one of them, its prefix,
is enough to find it: the one that is rarest in the documents. Documents are joined with these
prefix shingles only (rarity comes from one pass over the documents that finds the places of all
benchmark shingles, with the words around them); the offset of the shingle in its window gives the place where the window has
to start, places outside the document are left out, and the words there are compared with the
window's.

Null or wordless texts, of documents or of items, have no words and never match. Benchmark rows
without an id count as hits but are not listed among the items. Repeated documents each get their
row; repeated items count once. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common

#: ASCII other than letters and digits parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct benchmark shingles up to this number (some 20 MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _shingle(words: str, at: Column, size: int) -> Column:
    hashed = F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])
    return F.when(at.isNotNull(), hashed)


def _with_words(df: DataFrame) -> DataFrame:
    return common.with_words(df, common.ascii_lower(F.col("text")), SEPARATORS).drop("text")


def windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per distinct window and shingle: window_text, n (its words), offset, size, hash."""
    items = _with_words(benchmark.select("item_id", "text"))
    n = F.least(F.lit(window), F.size("words"))
    starts = F.when(n > 0, F.sequence(F.lit(1), F.size("words") - n + 1))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, n))).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("window_text"), F.size("w").alias("n"), "w").withColumn(
        "size", F.least(F.lit(shingle), F.col("n"))
    )


def _shingles_of(win: DataFrame, shingle: int) -> DataFrame:
    """Each window's shingles with their offsets; sizes differ only where windows are short."""
    per_size = F.lit(None).cast("long")
    for size in range(1, shingle + 1):
        per_size = F.when(F.col("size") == size, _shingle("w", F.col("offset"), size)).otherwise(per_size)
    return win.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("offset")).withColumn("hash", per_size)


def _document_shingles(docs: DataFrame, size: int) -> DataFrame:
    """Every position of every document with the hash of the shingle there.

    ``explode_outer`` keeps a row without position for shorter documents; its null hash matches nothing.
    No filter on the words is put before it, as that would cut every text into words twice.
    """
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size))
    return docs.select("k_id", "k_text", "words", F.explode_outer(starts).alias("at")).withColumn("hash", _shingle("words", F.col("at"), size))


def _hits(base: DataFrame, size: int, wanted: DataFrame, reach: int, small: bool) -> DataFrame:
    """Positions of the wanted shingles, with the words around them: k_id, k_text, at, hash, n_words, lead, near."""
    at = _document_shingles(base, size)
    if small:
        at = at.join(F.broadcast(wanted), "hash")
    else:
        lean = at.select("k_id", "k_text", "at", "hash").join(wanted, "hash")
        at = lean.join(base, ["k_id", "k_text"])
    lead = F.least(F.col("at"), F.lit(reach - size))
    near = F.slice("words", F.col("at") - lead + 1, lead + reach)
    return at.select("k_id", "k_text", "at", F.lit(size).alias("size"), "hash", F.size("words").alias("n_words"), lead.alias("lead"), near.alias("near"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Places where windows occur: k_id, k_text, start, n, window_text."""
    # one row per (window, item) stays for the ids; windows themselves are joined once each
    win = windows(benchmark, window, shingle)
    distinct = win.groupBy("window_text", "n", "size").agg(F.first("w").alias("w"))
    shingles = common.staged(_shingles_of(distinct, shingle).select("window_text", "n", "size", "offset", "hash"), "windows")
    sizes = {r["size"]: r["n"] for r in shingles.groupBy("size").agg(F.countDistinct("hash").alias("n")).collect()}  # `shingle` rows at most
    base = _with_words(common.keyed(docs, "text"))
    hits = None
    for size, n in sorted(sizes.items()):
        wanted = shingles.filter(F.col("size") == size).select("hash").distinct()
        more = _hits(base, size, wanted, window, n <= BROADCAST_ROWS)
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "k_id long, k_text long, start int, n int, window_text string")
    hits = common.staged(hits, "hits")

    # the prefix: a window with a shingle that no document has cannot occur at all
    counts = hits.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("seen"))
    ranked = shingles.join(counts, ["size", "hash"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = (
        ranked.groupBy("window_text", "n", "size")
        .agg(F.min(F.struct("seen", "hash", "offset")).alias("rare"))
        .filter(F.col("rare.seen") > 0)
        .select("window_text", "n", "size", F.col("rare.hash").alias("hash"), F.col("rare.offset").alias("offset"))
    )
    # length and position: the window has to lie inside the document
    start = F.col("at") - F.col("offset")
    near = hits.join(prefix, ["size", "hash"]).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    same = near.filter(F.array_join(F.slice("near", F.col("lead") - F.col("offset") + 1, F.col("n")), " ") == F.col("window_text"))
    return same.select("k_id", "k_text", start.cast("int").alias("start"), "n", "window_text").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return annotate(common.keyed(docs, "doc_id", "text"), docs, benchmark, window, shingle).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def annotate(rows: DataFrame, docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Adds the findings to ``rows``, which carry the row key and ``text``."""
    found = common.staged(occurrences(docs, benchmark, window, shingle), "found")
    before = Window.partitionBy("k_id", "k_text").orderBy("start", "n", "window_text").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    hit = (
        found.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", seen)))
        .groupBy("k_id", "k_text")
        .agg(F.sum("fresh").alias("n_hit"))
    )
    names = windows(benchmark, window, shingle).filter(F.col("item_id").isNotNull()).select("window_text", F.col("item_id").cast("string").alias("item")).distinct()
    items = (
        found.select("k_id", "k_text", "window_text").distinct().join(names, "window_text")
        .groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found_docs = hit.join(items, ["k_id", "k_text"], "left")
    counted = _with_words(rows).withColumn("n_words", F.size("words").cast("long")).drop("words")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_or_none = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return (
        counted.join(found_docs, ["k_id", "k_text"], "left")
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size(items_or_none).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(items_or_none, ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    bad = occurrences(docs, benchmark).select("k_id", "k_text").distinct()
    return common.packed(docs).join(bad, ["k_id", "k_text"], "left_anti").select("row.*")


ORACLE = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
hits AS (SELECT spots.doc_id, spots.s, spots.n, win.item FROM spots JOIN win ON spots.t = win.t AND spots.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM hits), LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
