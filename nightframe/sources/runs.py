"""A prediction run store that commits by manifest.

Rows of an attempt are written once, sorted by identifier, below ``rows/run_id=.../attempt=...``.  Their files
are then read back, each with its row count and the sums of its row digests; the sums of all files add up to
the digest that names the run.  Last comes the header, below ``runs/run_id=...``: it names the attempt and
lists its files with count, sums and first row position.  A run exists when its header exists, and consists of
the files that the header lists: what a failed attempt left behind is an orphan that no reader sees.

A row's position is the first position of its file and its place in it, so nothing is numbered when writing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from nightframe.functions.digest import row_digests, set_sums, sums_sha256
from nightframe.schemas import IDENTIFIERS

# The metadata fields that identify a run.
FINGERPRINT_FIELDS = (
    "artifact_type", "model_file_path", "model_file_sha256", "model_name", "candidate_id", "outer_fold",
    "deployment_ready", "non_deployment_override", "input_scope", "feature_names", "class_mapping",
)


@dataclass(frozen=True)
class RunResult:
    run_id: str
    inserted: bool
    row_count: int
    prediction_sha256: str


FILES = "array<struct<name:string,rows:bigint,sum_a:decimal(38,0),sum_b:decimal(38,0),first_position:bigint>>"
HEADER = f"attempt string, created_at_utc string, input_row_count bigint, prediction_sha256 string, feature_count int, run_metadata_json string, files {FILES}"


def prediction_sums(df: DataFrame, digits: int = 12) -> DataFrame:
    """One row: rows, sum_a, sum_b over all columns in name order, doubles at 12 significant digits."""
    return row_digests(df, digits).agg(*set_sums("_sha"))


def prediction_digest(df: DataFrame, digits: int = 12) -> DataFrame:
    """(row_count, prediction_sha256) of the same."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "sum_a", "sum_b")])
    return prediction_sums(df, digits).select(F.col("rows").alias("row_count"), F.sha2(text, 256).alias("prediction_sha256"))


def fingerprint(metadata: Mapping[str, Any], digest: str, rows: int) -> str:
    payload = {k: metadata.get(k) for k in FINGERPRINT_FIELDS}
    payload["prediction_sha256"] = digest
    payload["prediction_row_count"] = int(rows)
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A store table, or None where nothing was written yet.  run_id stays text."""
    try:
        return spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/{name}")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def _file_sums(spark: SparkSession, path: str) -> list[Row]:
    """name, rows, sum_a, sum_b of every file of an attempt, by name; as many as tasks wrote."""
    digests = row_digests(spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_name")), keep=["_name"]).withColumnRenamed("_name", "name")
    return sorted(digests.groupBy("name").agg(*set_sums("_sha")).collect(), key=lambda r: r["name"])


def _attempt_path(root: str, run_id: str, attempt: str) -> str:
    return f"{root}/rows/run_id={run_id}/attempt={attempt}"


def _verify(spark: SparkSession, root: str, header: Row) -> None:
    """The listed files are there and hold what the header says."""
    try:
        found = {(r["name"], r["rows"], r["sum_a"], r["sum_b"]) for r in _file_sums(spark, _attempt_path(root, header["run_id"], header["attempt"]))}
    except AnalysisException as exc:
        raise ValueError("stored run is incomplete") from exc
    missing = {(f["name"], f["rows"], f["sum_a"], f["sum_b"]) for f in header["files"]} - found
    if missing:
        raise ValueError(f"stored run is incomplete or damaged: {len(missing)} of {len(header['files'])} files differ")


def _header(spark: SparkSession, root: str, run_id: str) -> Row | None:
    headers = read_table(spark, root, "runs")
    return None if headers is None else headers.filter(F.col("run_id") == run_id).first()


def write_attempt(predictions: DataFrame, root: str, run_id: str) -> str:
    """Writes the rows of one attempt, files in the order of the identifiers; not a run before its header."""
    attempt = uuid.uuid4().hex
    order = [c for c in IDENTIFIERS if c in predictions.columns]
    predictions.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(_attempt_path(root, run_id, attempt))
    return attempt


def persist_run(predictions: DataFrame, root: str, metadata: Mapping[str, Any], created_at: str) -> RunResult:
    """Store a run once.  A second call with the same content verifies what is stored and inserts nothing."""
    spark = predictions.sparkSession
    given = prediction_sums(predictions).first()
    rows, digest = int(given["rows"]), sums_sha256(given["rows"], given["sum_a"], given["sum_b"])
    if rows == 0:
        raise ValueError("a run needs at least one row")
    run_id = fingerprint(metadata, digest, rows)
    known = _header(spark, root, run_id)
    if known is not None:
        if known["prediction_sha256"] != digest or known["input_row_count"] != rows:
            raise ValueError("stored run differs from the given one")
        _verify(spark, root, known)
        return RunResult(run_id, False, rows, digest)
    attempt = write_attempt(predictions, root, run_id)
    files, at = [], 0
    for f in _file_sums(spark, _attempt_path(root, run_id, attempt)):
        files.append((f["name"], f["rows"], f["sum_a"], f["sum_b"], at))
        at += f["rows"]
    if sums_sha256(at, sum(f[2] for f in files), sum(f[3] for f in files)) != digest:
        raise ValueError("the rows changed between reading and writing them; the attempt stays without a header")
    text = json.dumps({k: metadata.get(k) for k in sorted(metadata)}, sort_keys=True)
    header = spark.createDataFrame([(attempt, created_at, rows, digest, len(metadata.get("feature_names") or []), text, files)], HEADER)
    header.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run_id={run_id}")
    return RunResult(run_id, True, rows, digest)


def read_run(spark: SparkSession, root: str, run_id: str, ordered: bool = True) -> DataFrame:
    """The rows of one run with ``row_position``; only its listed files count.  An unknown run is an error."""
    header = _header(spark, root, run_id)
    if header is None:
        raise KeyError(f"unknown run {run_id}")
    listed = spark.createDataFrame([(f["name"], f["first_position"]) for f in header["files"]], "_name string, _first bigint")
    rows = spark.read.parquet(_attempt_path(root, run_id, header["attempt"]))
    rows = rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_at"))
    rows = rows.join(F.broadcast(listed), "_name").withColumn("row_position", F.col("_first") + F.col("_at"))  # a row per file
    rows = rows.drop("_name", "_first", "_at")
    return rows.orderBy("row_position") if ordered else rows


def audit_store(spark: SparkSession, root: str) -> DataFrame:
    """Run count, row count and rows of attempts that no header names."""
    runs = read_table(spark, root, "runs").select("run_id", "attempt", "input_row_count")
    rows = read_table(spark, root, "rows").groupBy("run_id", "attempt").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(runs, ["run_id", "attempt"], "full_outer")
    return joined.agg(
        F.count("input_row_count").alias("run_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("input_row_count").isNull(), F.col("n"))), F.lit(0)).alias("orphan_count"),
    )


def without_run(table: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Cascade delete as a rewrite: the rows of every run that is not removed."""
    return table.join(F.broadcast(run_ids.select("run_id").distinct()), "run_id", "left_anti")


__all__ = ["IDENTIFIERS", "RunResult", "audit_store", "persist_run", "prediction_digest", "read_run", "without_run", "write_attempt"]
