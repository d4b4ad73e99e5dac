"""A Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

Digests are lowercase hex SHA-256 of their inputs put together, digests as text. A leaf is the digest of a
row's fields. Within a source leaves ascend by id; every ``FANOUT`` consecutive nodes have a parent, until
one node remains, the source's root. The roots, null source first and then bytewise, are the leaves of the
upper tree.

Parents come from a slot pivot: nodes are grouped by their parent, and conditional aggregates spread them
into ``FANOUT`` columns. The columns put together are hashed for the parent; without a node's own column
they are its siblings. On the way down each pivot row hands its children the siblings of all levels above,
so every level is joined once and the levels shrink by the fanout. A level is written to the shared folder.

Places within a source come from ranges of (source, id): rows are numbered inside a range, and ranges by
running counts, so that a source with a third of all rows is never in one task.

Null fields are written ``-``. Rows without an id come first and are never tampered with. Repeated rows are
leaves of their own, next to each other; what ties in id is ordered by its leaf. Texts of any length enter
only their own row's digest. Columns other than the fields are left behind whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each as its size in bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None, text: str = "text") -> DataFrame:
    """doc_id, none and name (the source), h (the leaf), other (the leaf of the row with the text ``tampered``); written."""
    own = [F.col(c) for c in FIELDS]
    changed = [tampered if tampered is not None and c == text else F.col(c) for c in FIELDS]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNotNull().alias("known"),
        F.coalesce("source", F.lit("")).alias("name"),
        leaf(own).alias("h"),
        leaf(changed).alias("other"),
    )
    return common.staged(rows, "leaves")


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``idx``, the place from 0 within the group, and ``m``, the group's size; ties keep their input order."""
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*group, *order, "tie").withColumn("range", F.spark_partition_id())
    ranged = common.staged(ranged, "ranges")
    counts = ranged.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*group)
    counts = counts.select(
        *group,
        "range",
        F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(own).alias("m"),
    )
    inside = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order, "tie"))
    numbered = ranged.withColumn("nth", inside).join(counts, [*group, "range"])
    return numbered.withColumn("idx", F.col("first") + F.col("nth") - 1).drop("tie", "range", "first", "nth")


def climb(nodes: DataFrame, group: Sequence[str], payload: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The written pivot of every level, and group, level, h of every group's root.

    ``nodes``: group, idx, m, h and what a leaf carries.
    """
    size = nodes.agg(F.max("m")).first()[0] or 0
    pivots: list[DataFrame] = []
    roots = nodes.filter("m = 1").select(*group, F.lit(0).alias("level"), "h")
    carried = list(payload)
    while size > 1:
        node = F.struct("h", *carried)
        slots = [F.max(F.when(F.pmod("idx", F.lit(FANOUT)) == k, node)).alias(f"s{k}") for k in range(FANOUT)]
        pivot = nodes.filter("m > 1").groupBy(*group, "m", F.floor(F.col("idx") / FANOUT).alias("parent")).agg(*slots)
        pivot = pivot.withColumn("h", F.sha2(F.concat_ws("", *[f"s{k}.h" for k in range(FANOUT)]), 256))
        pivots.append(common.staged(pivot, f"level{len(pivots)}"))
        nodes = pivots[-1].select(*group, F.col("parent").alias("idx"), F.ceil(F.col("m") / FANOUT).alias("m"), "h")
        roots = roots.unionByName(nodes.filter("m = 1").select(*group, F.lit(len(pivots)).alias("level"), "h"))
        size, carried = -(-size // FANOUT), []
    return pivots, roots


def descend(leaf_nodes: DataFrame, pivots: list[DataFrame], tops: DataFrame, group: Sequence[str], payload: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Every leaf's h, payload and path (siblings to the left and right, level by level), with what ``tops`` carry.

    ``tops``: group, level, path from the group's root on, and what is carried down to every leaf.
    """
    below: DataFrame | None = None
    for level in reversed(range(len(pivots))):
        above = tops.filter(F.col("level") == level + 1).select(*group, F.lit(0).cast("long").alias("parent"), "path", *carry)
        above = above if below is None else above.unionByName(below)
        joined = pivots[level].drop("h", "m").join(above, [*group, "parent"])
        slots = []
        for k in range(FANOUT):
            left, right = (F.concat_ws("", *[F.col(f"s{j}.h") for j in span]) if span else F.lit("") for span in (range(k), range(k + 1, FANOUT)))
            step = F.struct(left.alias("left"), right.alias("right"))
            slots.append(F.struct(F.lit(k).alias("slot"), F.col(f"s{k}").alias("node"), F.concat(F.array(step), F.col("path")).alias("path")))
        children = joined.select(*group, "parent", *carry, F.inline(F.array(*slots))).filter(F.col("node").isNotNull())
        if level:
            children = children.select(*group, (F.col("parent") * FANOUT + F.col("slot")).alias("parent"), "path", *carry)
            below = common.staged(children, f"paths{level}")
        else:
            below = children.select(*group, "node.h", *[F.col(f"node.{c}") for c in payload], "path", *carry)
    alone = leaf_nodes.filter("m = 1").select(*group, "h", *payload).join(tops.filter("level = 0").select(*group, "path", *carry), list(group))
    return alone if below is None else below.unionByName(alone)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``tampered`` is a text that takes the place of the row's own before it is checked against the manifest.
    """
    source, everything = ["known", "name"], ["all"]
    nodes = placed(leaves(docs, tampered), source, ["doc_id", "h"])
    nodes = common.staged(nodes, "nodes")
    pivots, subroots = climb(nodes, source, ["doc_id", "other"])
    # the upper tree: a leaf per source
    upper = placed(common.staged(subroots, "subroots").withColumn("all", F.lit(0)), everything, source)
    upper = common.staged(upper, "upper")
    carried = [*source, "level"]
    upper_pivots, root = climb(upper, everything, carried)
    top = root.select("all", "level", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    tops = descend(upper, upper_pivots, top, everything, carried, ["root"]).withColumnRenamed("h", "subroot")
    out = descend(nodes, pivots, common.staged(tops, "tops"), source, ["doc_id", "other"], ["subroot", "root"])
    siblings = F.array_join(F.flatten(F.transform("path", lambda step: F.array(step["left"], step["right"]))), "")
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("other")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The tampering of the query: where 2 divides the CRC of the id, line feeds are deleted."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents), tab),
d AS (
  SELECT documents.*, CASE WHEN c % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents LEFT JOIN crc USING (doc_id)),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS other
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d)),
l0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS m FROM l),
up AS (
  SELECT source, 0 AS lvl, idx, m, h FROM l0
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE m > 1 GROUP BY source, lvl, idx // 3, m),
t0 AS (SELECT source, h, row_number() OVER (ORDER BY source IS NOT NULL, source COLLATE "binary") - 1 AS idx, count(*) OVER () AS m FROM up WHERE m = 1),
top AS (
  SELECT 0 AS lvl, idx, m, h FROM t0
  UNION ALL
  SELECT lvl + 1, idx // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE m > 1 GROUP BY lvl, idx // 3, m),
step AS (
  SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lf,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rg
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.m > 1 GROUP BY 1, 2, 3),
top_step AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lf,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rg
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.m > 1 GROUP BY 1, 2),
low_fold AS (
  SELECT doc_id, source, h AS leaf, 0 AS lvl, idx, m, other AS cur, '' AS sibs FROM l0
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, f.lvl + 1, f.idx // 3, (f.m + 2) // 3, sha256(lf || cur || rg), sibs || lf || rg
  FROM low_fold f JOIN step s ON f.source IS NOT DISTINCT FROM s.source AND f.lvl = s.lvl AND f.idx = s.idx WHERE f.m > 1),
top_fold AS (
  SELECT f.doc_id, f.leaf, t0.h AS subroot, 0 AS lvl, t0.idx, t0.m, f.cur, f.sibs FROM low_fold f JOIN t0 ON f.source IS NOT DISTINCT FROM t0.source WHERE f.m = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.lvl + 1, f.idx // 3, (f.m + 2) // 3, sha256(lf || cur || rg), sibs || lf || rg
  FROM top_fold f JOIN top_step s ON f.lvl = s.lvl AND f.idx = s.idx WHERE f.m > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
FROM top_fold, (SELECT h FROM top WHERE m = 1) r WHERE top_fold.m = 1
"""
