"""Inventories: link and checksum listings, digests, pairs of files per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nightframe.functions.text import recording_parts
from nightframe.schemas import ANNOTATION_FILE_PATTERN, SIGNAL_FILE_PATTERN


def checksum_lines(lines: DataFrame, column: str = "value", position: str | None = None) -> DataFrame:
    """(path, sha256) from ``digest  path`` lines; lines that do not start with 64 hex digits are skipped.

    A leading star on the path falls away and backslashes become slashes.  With a
    ``position`` column the latest line of a path wins, through a combinable aggregate.
    """
    digest = F.lower(F.regexp_extract(F.trim(F.col(column)), r"^(\S+)\s+(.*)$", 1))
    path = F.regexp_extract(F.trim(F.col(column)), r"^(\S+)\s+(.*)$", 2)
    path = F.regexp_replace(F.regexp_replace(F.trim(path), r"^\*+", ""), r"\\", "/")
    keep = [F.col(position)] if position else []
    parsed = lines.select(path.alias("path"), digest.alias("sha256"), *keep).filter(
        F.col("sha256").rlike("^[0-9a-f]{64}$")
    )
    if position is None:
        return parsed.distinct()
    return parsed.groupBy("path").agg(F.max_by("sha256", position).alias("sha256"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return checksum_lines(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()), position="line")


def linked_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct file names behind the ``href`` of every anchor: path part, percent-decoded, last segment.

    Anchors in any case, over several lines, with double, single or no quotes; where a percent
    escape is broken, the name is taken as written.
    """
    anchor = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    links = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1))).alias("quoted"))
    href = F.regexp_replace(F.regexp_replace("quoted", r"""^["']\s*|\s*["']$""", ""), "&amp;", "&")
    bare = F.regexp_replace(F.regexp_replace(href, r"(?s)[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = F.substring_index(F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare), "/", -1)
    return links.select(name.alias("filename")).filter(F.col("filename") != "").distinct()


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files below ``path``.

    A file must fit in one row, and Spark's file scan passes over empty files.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
    )


def with_checksums(wanted: DataFrame, sums: DataFrame, key: str = "path") -> DataFrame:
    """Each wanted entry with its checksum; one that the listing lacks stops the job with its name."""
    found = wanted.join(sums.select(key, "sha256"), key, "left")
    lost = F.raise_error(F.concat(F.lit("no checksum for "), F.col(key).cast("string"))).cast("string")
    return found.withColumn("sha256", F.coalesce("sha256", lost))


def validate_digests(found: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Each expected file: is it there with the right digest, and which digest was seen."""
    seen = found.select(key, F.col("sha256").alias("actual_sha256"))
    return expected.join(seen, key, "left").withColumn(
        "is_valid", F.coalesce(F.col("actual_sha256") == F.lower("sha256"), F.lit(False))
    )


def file_kind(name: Column) -> Column:
    return F.when(name.rlike(SIGNAL_FILE_PATTERN), "psg").when(name.rlike(ANNOTATION_FILE_PATTERN), "hypnogram")


def name_parts(names: DataFrame, column: str = "filename") -> DataFrame:
    """Recording id, subject and night from the fixed positions of recognised file names."""
    kinds = names.withColumn("file_type", file_kind(F.col(column))).filter(F.col("file_type").isNotNull())
    return kinds.withColumns(recording_parts(column))


def pair_counts(files: DataFrame, types: Sequence[str] = ("psg", "hypnogram"), key: str = "recording_id") -> DataFrame:
    """Zero-filled count of each file type per recording."""
    return files.groupBy(key).agg(*[F.count_if(F.col("file_type") == t).alias(t) for t in types])


def paired(files: DataFrame, types: Sequence[str] = ("psg", "hypnogram"), key: str = "recording_id") -> DataFrame:
    """One row per recording with a path per type; anything but exactly one file of each is an error."""
    grouped = files.groupBy(key).agg(
        *[F.count_if(F.col("file_type") == t).alias(f"_{t}") for t in types],
        *[F.max(F.when(F.col("file_type") == t, F.col("path"))).alias(f"{t}_path") for t in types],
    )
    fine = F.lit(True)
    for t in types:
        fine = fine & (F.col(f"_{t}") == 1)
    problem = F.raise_error(F.concat(F.lit("incomplete file pair: "), F.col(key).cast("string")))
    checked = F.when(fine, F.col(f"{types[0]}_path")).otherwise(problem.cast("string"))
    return grouped.select(key, checked.alias(f"{types[0]}_path"), *[f"{t}_path" for t in types[1:]])


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(missing_left, missing_right): keys only the other side has."""
    l, r = left.select(key, F.lit(1).alias("_l")).distinct(), right.select(key, F.lit(1).alias("_r")).distinct()
    return l.join(r, key, "full_outer").agg(
        F.count_if(F.col("_l").isNull()).alias("missing_left"), F.count_if(F.col("_r").isNull()).alias("missing_right")
    )


def file_tasks(manifest: DataFrame) -> DataFrame:
    """Two rows per recording, one per file type."""
    def task(kind):
        return F.struct(
            F.lit(kind).alias("file_type"), F.col(f"{kind}_filename").alias("filename"), F.col(f"{kind}_sha256").alias("sha256")
        )

    return manifest.select("recording_id", F.inline(F.array(task("psg"), task("hypnogram"))))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Latest row per key of both tables, as a combinable aggregate over whole rows."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != stamp]
    latest = both.groupBy(*keys).agg(F.max(F.struct(stamp, *rest)).alias("_latest"))
    return latest.select(*keys, "_latest.*")


def first_rows(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark trims each task to n per key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
