"""Discovery, feature cache, bibliography, results, audit and configuration files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path) of files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path")
    )


def discover(files: DataFrame, subject: str = r"^([A-Za-z]+\d+)", duplicate: str = r"\.\d+$") -> DataFrame:
    """(subject, recording, path): parts a, b, c join one subject, re-downloads are skipped.

    Files of one name in different folders are different files; each keeps its path.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = files.select(name.alias("recording"), "path").filter(~F.col("recording").rlike(duplicate))
    found = named.withColumn("subject", F.regexp_extract("recording", subject, 1)).filter("subject <> ''")
    return found.dropDuplicates(["path"]).select("subject", "recording", "path")


def write_cache(features: DataFrame, path: str, id_col: str = "epoch", files_per_subject: int = 8) -> None:
    """Feature rows by subject folder.

    Rows are spread over a fixed number of files per subject, so a large subject is written by
    several tasks and a small one does not leave a file per task.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(files_per_subject))
    features.repartition("subject", salt).write.mode("errorifexists").partitionBy("subject").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: T.StructType, subjects: Sequence[str] | None = None) -> DataFrame:
    """Cached rows; naming subjects prunes the other folders."""
    cached = spark.read.schema(schema).parquet(path)
    return cached.filter(F.col("subject").isin(list(subjects))) if subjects is not None else cached


def _field(body: Column, name: str) -> Column:
    """A BibTeX field in braces (nested two deep) or quotes, inner braces removed."""
    nested = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
    braced = F.regexp_extract(body, rf"(?is)\b{name}\s*=\s*{nested}", 1)
    quoted = F.regexp_extract(body, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    bare = F.regexp_extract(body, rf"(?is)\b{name}\s*=\s*(\w+)", 1)
    value = F.when(braced != "", braced).when(quoted != "", quoted).otherwise(bare)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[{}]", ""), r"\s+", " "))


def parse_bib(files: DataFrame) -> DataFrame:
    """(key, title, journal, year, text) from bibliography texts (path, text)."""
    entry = F.lit(r"(?s)@\w+\{([^,]+),(.*?)\n\}")
    zipped = F.arrays_zip(
        F.regexp_extract_all("text", entry, F.lit(1)).alias("key"), F.regexp_extract_all("text", entry, F.lit(2)).alias("body")
    )
    rows = files.select(F.explode(zipped).alias("e")).select(F.trim("e.key").alias("key"), F.col("e.body").alias("body"))
    journal, book = _field(F.col("body"), "journal"), _field(F.col("body"), "booktitle")
    out = rows.select(
        "key",
        _field(F.col("body"), "title").alias("title"),
        F.when(journal != "", journal).otherwise(book).alias("journal"),
        _field(F.col("body"), "year").alias("year"),
    )
    return out.withColumn("text", F.concat_ws(" ", "title", "journal", "year"))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType, default: DataFrame | None = None) -> DataFrame:
    """Stored results, or the default (else no rows) when nothing is stored there; other failures are raised."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default if default is not None else spark.createDataFrame([], schema)


AUDIT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def audit_rows(df: DataFrame, event: str, run_id: str) -> DataFrame:
    """One audit row per input row; the row itself becomes the JSON payload."""
    payload = F.to_json(F.struct(*df.columns))
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(event).alias("event"), payload.alias("payload"), F.current_timestamp().alias("ts")
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path, AUDIT)


_SPLIT = T.StructType(
    [
        T.StructField("subject_ids", T.ArrayType(T.StringType())),
        T.StructField("n_subjects", T.LongType()),
        T.StructField("n_windows", T.LongType()),
        T.StructField("class_counts", T.MapType(T.StringType(), T.LongType())),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField(
            "datasets",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("total_subjects", T.LongType()),
                        T.StructField("total_windows", T.LongType()),
                        T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())),
                        T.StructField("splits", T.MapType(T.StringType(), _SPLIT)),
                    ]
                ),
            ),
        )
    ]
)
NORM = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("mean", T.DoubleType()),
            T.StructField("std", T.DoubleType()),
            T.StructField("median", T.DoubleType()),
            T.StructField("iqr", T.DoubleType()),
            T.StructField("n_samples", T.LongType()),
        ]
    ),
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Nested manifest to (dataset, split, subject)."""
    sets = manifest.select(F.explode("datasets").alias("dataset", "d"))
    splits = sets.select("dataset", F.explode("d.splits").alias("split", "s"))
    return splits.select("dataset", "split", F.explode("s.subject_ids").alias("subject"))


def norm_stats_json(stats: DataFrame) -> DataFrame:
    """One JSON text of channel -> statistics. Rows are channels, a fixed small number."""
    entry = F.struct(
        F.col("channel"),
        F.struct(
            "mean", F.col("sd").alias("std"), "median", "iqr", F.col("n").cast("bigint").alias("n_samples")
        ).alias("v"),
    )
    return stats.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def norm_stats_rows(json_rows: DataFrame) -> DataFrame:
    parsed = json_rows.select(F.from_json("json", NORM).alias("m"))
    return parsed.select(F.explode("m").alias("channel", "v")).select("channel", "v.*")
