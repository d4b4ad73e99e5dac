"""Reading and writing tables under an explicit contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from nightframe.functions.digest import row_sha256, set_sums
from nightframe.functions.numeric import nan_to_null, with_rounded
from nightframe.functions.text import sorted_json
from nightframe.session import ensure_checkpoint_dir, scratch_path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header; a ragged row or a header that lacks a required name fails."""
    wanted = list(required if required is not None else schema.fieldNames())
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    by_name = {f.name: f for f in schema.fields}
    full = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.schema(full).option("header", True).option("mode", "FAILFAST").csv(path)


def nan_as_null(df: DataFrame) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in doubles}) if doubles else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def canonical_frame(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles at a fixed number of significant digits, without a minus zero."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return with_rounded(df, doubles, digits)


def replace_load(facts: DataFrame, fact_path: str, subject_path: str, source: str) -> None:
    """Overwrite the fact table and its subject dimension (one row per distinct subject)."""
    subjects = facts.select("subject_id").distinct().select(
        "subject_id",
        F.concat(F.lit("subject_"), F.col("subject_id").cast("string")).alias("subject_code"),
        F.lit(source).alias("source"),
    )
    facts.write.mode("overwrite").parquet(fact_path)
    subjects.write.mode("overwrite").parquet(subject_path)


#: Folder of the parts' digests; the underscore hides it from a scan of the parts.
DIGESTS = "_digests"


def _write_parted(df: DataFrame, path: str, key: str, fresh: bool) -> None:
    """Replaces the parts in ``df``.  Where nothing lies yet, tasks put their files in place themselves, as the driver
    would otherwise rename part by part; a write that broke off shows in the digests."""
    writer = df.write.partitionBy(key)
    if fresh:
        writer.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the store itself, so any path that Spark can read will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def part_digests(df: DataFrame, key: str) -> DataFrame:
    """key, rows, sum_a, sum_b: a digest of each part's rows that does not depend on their order or files."""
    return df.select(key, row_sha256(sorted(df.columns)).alias("_sha")).groupBy(key).agg(*set_sums("_sha"))


def _noted(spark: SparkSession, path: str) -> DataFrame:
    """All digests ever noted, a later one with a higher generation."""
    return spark.read.parquet(f"{path}/{DIGESTS}")


def valid_parts(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame | None:
    """The keys of the parts whose stored rows are those that were to be written; None where nothing was."""
    if not path_exists(spark, f"{path}/{DIGESTS}"):
        return None
    # with the schema given, the folder names are read as what they were, "007" as text; rows of a file that
    # cannot be read are missing from the digest, so its part is no longer valid
    stored = part_digests(spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path), key)
    sums = ["rows", "sum_a", "sum_b"]
    noted = _noted(spark, path).groupBy(key).agg(F.max_by(F.struct(*sums), "generation").alias("_last")).select(key, "_last.*")
    # the keys alone are checkpointed: what follows overwrites the folders that they were read from
    ensure_checkpoint_dir(spark)
    return stored.join(noted, [key, *sums], "left_semi").select(key).checkpoint()


#: Rows beyond which a part gets more than one file.
FILE_ROWS = 500_000


#: Column of the folder that a recording lies in, where recordings share folders.
FOLDER = "part_folder"


def in_folders(df: DataFrame, key: str, folders: int) -> DataFrame:
    """Rows with the folder of their recording."""
    return df.withColumn(FOLDER, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folders)).cast("int"))


def replace_folders(rows: DataFrame, path: str) -> None:
    """Replaces the folders that ``rows`` (with ``FOLDER``) lie in.  They may be made of what the folders hold, so they are written aside first."""
    spark, aside = rows.sparkSession, scratch_path(rows.sparkSession, "folders")
    rows.write.parquet(aside)
    _write_parted(spark.read.schema(rows.schema).parquet(aside).hint("rebalance", FOLDER), path, FOLDER, fresh=False)


def write_parts(df: DataFrame, path: str, key: str = "recording_id", overwrite: bool = False,
                files_per_part: int = 4, file_rows: int = FILE_ROWS, folders: int | None = None) -> int:
    """Write per-recording parts; parts that are there and whole are kept unless told otherwise.

    A recording is one file; one of more than ``file_rows`` rows is dealt out by its row hash to ``files_per_part`` files,
    so that it is not written by a single task.  Beside the parts lies a table of their digests, to which each call
    adds a generation.  A later call reads the stored rows once, compares, and writes again what is missing or damaged.

    With ``folders``, recordings share so many folders, by a hash of their name, so that files follow the rows and not the
    recordings; a folder with a missing or damaged recording is written again, its other recordings as they were stored.
    A path keeps the number it was first written with.

    Returns how many recordings were written.
    """
    spark = df.sparkSession
    by = FOLDER if folders else key
    if folders:
        df = in_folders(df, key, folders)
    done = None if overwrite else valid_parts(spark, path, df.schema, key)
    todo = df if done is None else df.join(done, key, "left_anti")
    count = todo.select(key).distinct().count()
    if count:
        noted, fresh = path_exists(spark, f"{path}/{DIGESTS}"), not path_exists(spark, path)
        generation = _noted(spark, path).agg(F.max("generation")).first()[0] + 1 if noted else 0
        # noted before the rows: a part whose rows did not come through whole will not match
        digests = part_digests(todo, key).withColumn("generation", F.lit(generation).cast("bigint"))
        digests.write.mode("append").parquet(f"{path}/{DIGESTS}")
        # at most one large part for each file_rows rows of the table
        large = todo.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > file_rows).select(key, F.lit(files_per_part).alias("_files"))
        hashed = todo.withColumn("_hash", F.xxhash64(*todo.columns)).join(F.broadcast(large), key, "left")
        slot = F.pmod("_hash", F.coalesce("_files", F.lit(1)))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = hashed.repartition(tasks, F.col(by), slot).select(*todo.columns)
        if folders and not fresh:
            # what the touched folders hold of other recordings, as far as it is whole
            stored = spark.read.schema(df.schema).option("ignoreCorruptFiles", "true").parquet(path)
            kept = stored.join(done, key, "left_semi") if done is not None else stored.join(todo.select(key).distinct(), key, "left_anti")
            touched = todo.select(FOLDER).distinct()  # as many rows as folders at most
            replace_folders(rows.unionByName(kept.join(F.broadcast(touched), FOLDER, "left_semi").select(*todo.columns)), path)
        else:
            _write_parted(rows, path, by, fresh)
    return count


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row, keys in order; a number that is not finite stops the job."""
    df.select(sorted_json(**{c: F.col(c) for c in df.columns}).alias("value")).write.mode("overwrite").text(path)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def total_line(df: DataFrame) -> DataFrame:
    """One-line text report of the row count."""
    return df.agg(F.concat(F.lit("total_rows "), F.count(F.lit(1)).cast("string")).alias("value"))
