"""Spelling variants: words one edit apart, found by a frontier of states over a trie that is a table.

Words are counted over all documents. The trie is an edge table: (node, ch) leads to a child; an empty
character marks where a word ends. An edge knows how many words lie below it, their shortest and longest
length, and the word itself where there is only one; nodes with one word below have no edges of their own.

A state is (word, position, node, edits). Two words one edit apart share either the first half of the one or
its last half, so the search starts without edits at the middle, once in the trie of the words and once in
that of the reversed words. Where the word and the trie part, a state takes its edit: another character, one
more, or one less. Then the frontier goes level by level: states join the edge table on their node and the
word's next character, until they reach an end or a branch with one word; levels are written to the shared
folder and the search ends when no state is left. Nodes are named by a 64-bit hash of their prefix, so what
arrives is compared as text before it counts; a collision costs work, not correctness.

A word's form is its neighbour of largest count if that is at least ``ratio`` times its own; roots follow
forms by pointer jumping. Counts are combined before the shuffle, so a frequent word is no hot key. Every
join is between two tables that grow with the words, and Spark takes them for smaller than they are (ways of
a word as one row, rows of a compressed file at the file's size), so none is left to a broadcast.

Null texts have no words, a null id is written as nothing in the misspelling rule, and repeated rows count
each. Texts of any length are cut inside their own row; levels are as many as the longest stretch behind an
edit that three words share, whatever a word's length. Columns other than id and text are left behind. An
empty table has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common

#: What parts runs of letters, after A-Z became a-z.
SEPARATORS = "[^a-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, MISSPELT = 5, 3, 2, 97


def misspelt(run: Column, doc_id: Column, every: int) -> Column:
    """The run without one of its letters where ``every`` divides the CRC of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = None) -> DataFrame:
    """word, n of all words long and frequent enough; ``every`` misspells runs on purpose, for tests."""
    runs = F.split(common.ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS)
    rows = docs.select(F.col("doc_id").alias("id"), F.explode(runs).alias("run")).filter(F.char_length("run") >= least_length)
    word = misspelt(F.col("run"), F.col("id"), every) if every else F.col("run")
    rows = rows.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def growing(df: DataFrame) -> DataFrame:
    """The table for a join that shuffles and merges: it grows with the words, whatever size Spark takes it for."""
    return df.hint("merge")


def _side(words: DataFrame, back: bool) -> DataFrame:
    """wid, w (reversed on the way back), size, start: where this side's edits may begin."""
    w = F.reverse("word") if back else F.col("word")
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    return words.select(F.xxhash64("word").alias("wid"), w.alias("w"), size.alias("size"), (size - half if back else half).alias("start"))


def _steps(side: DataFrame, lowest: int) -> DataFrame:
    """Every word's own way through the trie from depth ``lowest`` on: at, node, ch, next, child."""
    w = F.col("w")

    def step(p: Column) -> Column:
        ch = F.substring(w, p + 1, F.lit(1))
        node = F.xxhash64(F.substring(w, F.lit(1), p))
        child = F.xxhash64(F.substring(w, F.lit(1), p + 1))
        return F.struct(p.alias("at"), node.alias("node"), ch.alias("ch"), F.substring(w, p + 2, F.lit(1)).alias("next"), child.alias("child"))

    ways = F.transform(F.sequence(F.lit(lowest), F.col("size")), step)
    return side.select("wid", "size", "start", F.inline(ways)).repartition("node")


def edge_table(steps: DataFrame) -> DataFrame:
    """node, ch, child, n (words below), low, high (their lengths), only (the word, if there is one), of nodes with several words."""
    edges = steps.groupBy("node", "ch").agg(
        F.min("child").alias("child"), F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("wid").alias("only")
    )
    return edges.withColumn("all", F.sum("n").over(Window.partitionBy("node"))).filter("all > 1").drop("all")


STATE = ("wid", "at", "node", "want", "n", "only")


def first_edits(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit, taken where the word leaves its own way."""
    own = steps.filter(F.col("at") >= F.col("start"))
    other = edges.withColumnRenamed("ch", "by").withColumnRenamed("child", "to")
    met = own.drop("child").join(growing(other), "node").filter(F.col("by") != F.col("ch"))
    more, ends = F.col("by") != "", F.col("ch") == ""

    def state(holds: Column, at: Column, want: Column) -> Column:
        fits = holds & (want >= F.col("low")) & (want <= F.col("high"))
        return F.when(fits, F.struct(at.alias("at"), want.alias("want")))

    at, size = F.col("at"), F.col("size")
    kinds = F.array_compact(
        F.array(
            state(more & ~ends, at + 1, size),  # another character
            state(more, at, size + 1),  # one more
            state(~ends & (F.col("by") == F.col("next")), at + 2, size - 1),  # one less: the edge is the character after
        )
    )
    return met.select("wid", F.col("to").alias("node"), "n", "only", F.inline(kinds)).select(*STATE)


def advanced(states: DataFrame, side: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on: without further edits the next character decides."""
    placed = states.select("wid", "at", "node", "want").join(growing(side.select("wid", "w")), "wid")
    placed = placed.select("wid", "at", "node", "want", F.substring("w", F.col("at") + 1, F.lit(1)).alias("ch"))
    met = placed.join(growing(edges), ["node", "ch"]).filter((F.col("want") >= F.col("low")) & (F.col("want") <= F.col("high")))
    return met.select("wid", (F.col("at") + 1).alias("at"), F.col("child").alias("node"), "want", "n", "only")


def candidates(words: DataFrame, back: bool, lowest: int) -> list[DataFrame]:
    """Tables of wid, only that may be one edit apart, one per level."""
    side = _side(words, back)
    steps = _steps(side, lowest)
    edges = common.staged(edge_table(steps), "edges")
    level = common.staged(first_edits(steps, edges), "frontier")
    found = []
    while True:
        found.append(level.filter("n = 1").select("wid", "only"))
        open_states = level.filter("n > 1")
        if open_states.isEmpty():
            return found
        level = common.staged(advanced(open_states, side, edges), "frontier")


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n, near, near_n: both directions of every pair exactly one edit apart; words: word, n, of that length at least."""
    pairs: DataFrame | None = None
    for back in (False, True):
        for part in candidates(words, back, least_length // 2):
            pairs = part if pairs is None else pairs.unionByName(part)
    ids = words.select(F.xxhash64("word").alias("wid"), "word", "n")
    others = ids.select(F.col("wid").alias("only"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = pairs.distinct().join(growing(ids), "wid").join(growing(others), "only")
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form; counts grow along forms, so there are no rings."""
    links = common.staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not links.filter("moved").isEmpty():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(growing(on), "root", "left")
        links = common.staged(links.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
    return links.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    words = common.staged(counts(docs, least_length, least_count, every), "words")
    near = near_pairs(words, least_length)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    best = common.staged(best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    judged = words.join(growing(best), "word", "left").withColumn("strong", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("strong"), F.col(c)).alias(c) for c in ("form", "form_n")])
    judged = common.staged(judged, "judged")
    ends = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(growing(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
crc AS (
  SELECT doc_id, run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, tab),
w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM crc)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
one_less AS (SELECT DISTINCT cut.word, w.word AS near FROM cut JOIN w ON cut.rest = w.word),
near AS (
  SELECT word, near FROM one_less UNION SELECT near, word FROM one_less
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near.near, (-o.n, encode(near.near))) AS form, max(o.n) AS form_n FROM near JOIN w o ON near.near = o.word GROUP BY near.word),
j AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
way AS (SELECT word, word AS root, form AS next FROM j UNION ALL SELECT way.word, j.word, j.form FROM way JOIN j ON way.next = j.word)
SELECT j.word, form, root, n, n_near, form_n FROM j JOIN way ON j.word = way.word AND way.next IS NULL
"""
