"""Readers for sample tables and raw segments; schemas are explicit, never inferred."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.operators.attach import attach

SAMPLES = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("recording", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def unique_names(header: Sequence[str]) -> list[str]:
    """Strip a unit suffix and number repeated channel names: a, a -> a, a_2."""
    seen: dict[str, int] = {}
    out = []
    for raw in header:
        name = re.sub(r"\s*\([^)]*\)\s*$", "", raw.strip())
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def wide_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in unique_names(header)])


def from_path(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def damaged_parquet(spark: SparkSession, paths: str | list[str], schema: T.StructType = SAMPLES) -> DataFrame:
    """(path, reason, lost): files that give fewer rows than their footers promise, or have no footer.

    Rows are counted twice: from the footers alone, and by reading every value. Reading
    skips what is damaged, so the difference is what would be lost without a word.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True)
    raw = reader.parquet(*_paths(paths))
    path = F.col("_metadata.file_path").alias("path")
    promised = raw.select(path).groupBy("path").agg(F.count(F.lit(1)).alias("promised"))
    # the hash needs every column, so every page is read
    whole = raw.select(path, F.xxhash64(*schema.fieldNames()).alias("h"))
    got = whole.groupBy("path").agg(F.count(F.lit(1)).alias("got"), F.bit_xor("h").alias("h")).filter("h IS NOT NULL").drop("h")
    short = promised.join(got, "path", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < promised")
    unread = _listed(spark, paths).join(promised, "path", "left_anti")
    return short.select("path", F.lit("rows missing").alias("reason"), (F.col("promised") - F.col("got")).alias("lost")).unionByName(
        unread.select("path", F.lit("no rows").alias("reason"), F.lit(None).cast("bigint").alias("lost"))
    )


def damaged_csv(spark: SparkSession, paths: str | list[str], header: Sequence[str]) -> DataFrame:
    """(path, reason, lost): compressed files that end early, and files with lines of another form.

    ``lost`` counts the malformed lines of a file. A compressed file is unpacked to its end as a stream.
    """
    schema = wide_schema(header).add(T.StructField("_bad", T.StringType()))
    rows = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreCorruptFiles", True)
        .option("columnNameOfCorruptRecord", "_bad").csv(_paths(paths))
    )
    lines = rows.select("*", F.col("_metadata.file_path").alias("path")).filter(F.col("_bad").isNotNull())
    # Spark wants more than the malformed text alone to be read
    every = F.max(F.xxhash64(*schema.fieldNames()[:-1])).alias("h")
    bad = lines.groupBy("path").agg(F.count("_bad").alias("lost"), every).filter("h IS NOT NULL")
    bad = bad.select("path", F.lit("malformed lines").alias("reason"), "lost")

    packed = [r.path for r in _listed(spark, paths).filter(F.col("path").endswith(".gz")).toLocalIterator()]
    ends = spark.createDataFrame([(p, "cut short", None) for p in unreadable(spark, packed)], "path string, reason string, lost long")
    return ends.unionByName(bad.join(ends.select("path"), "path", "left_anti"))


def unreadable(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the text files (packed or not) that can't be read to their end.

    All are read at once, line by line and whatever their size; where that fails, each half on its own. So
    sound files cost one job, and each damaged one about two jobs for every halving.
    """
    if not paths:
        return []
    try:
        lines = spark.read.option("ignoreCorruptFiles", False).text(list(paths))
        lines.agg(F.max(F.xxhash64("value"))).collect()
        return []
    except (Py4JJavaError, PySparkException):
        if len(paths) == 1:
            return list(paths)
        half = len(paths) // 2
        return unreadable(spark, paths[:half]) + unreadable(spark, paths[half:])


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_paths(paths))
    return files.select("path")


def same_path(path: Column) -> Column:
    """One spelling of a local path, with which both readers agree."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def leave_out(rows: DataFrame, damaged: DataFrame, path: str = "_path") -> DataFrame:
    """``rows`` (with their file in ``path``) without all rows of damaged files."""
    bad = damaged.select(same_path(F.col("path")).alias(path)).distinct()
    return attach(rows.withColumn(path, same_path(F.col(path))), bad, [path], "left_anti")


def read_wide_csv(
    spark: SparkSession,
    paths: str | list[str],
    header: Sequence[str],
    rate: float,
    subject: str = r"([^/_.]+)[^/]*$",
    recording: str = r"([^/]+)\.[^./]*$",
    time_col: str = "time_s",
) -> DataFrame:
    """Wide sample CSVs to the long schema. Files in ``damaged_csv`` are left out as a whole."""
    schema = wide_schema(header)
    wide = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreCorruptFiles", True)
        .csv(_paths(paths))
        .select(
            "*", from_path(subject).alias("subject"), from_path(recording).alias("recording"), F.col("_metadata.file_path").alias("_path")
        )
        .withColumn("idx", F.round(F.col(time_col) * F.lit(float(rate))).cast("bigint"))
    )
    wide = leave_out(wide, damaged_csv(spark, paths, header))
    channels = [c for c in schema.fieldNames() if c != time_col]
    long = wide.unpivot(["subject", "recording", "idx"], channels, "channel", "value")
    return long.select(*SAMPLES.fieldNames())


def read_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Long samples. Files in ``damaged_parquet`` are left out as a whole."""
    raw = spark.read.schema(SAMPLES).option("ignoreCorruptFiles", True).parquet(*_paths(paths))
    rows = raw.select("*", F.col("_metadata.file_path").alias("_path"))
    return leave_out(rows, damaged_parquet(spark, paths)).select(*SAMPLES.fieldNames())


def read_segment_csv(spark: SparkSession, path: str, width: int, positive: int = 1) -> DataFrame:
    """Segment CSV: an id, ``width`` values, a class. The id is kept, the values become an array."""
    names = [f"v{i}" for i in range(width)]
    schema = T.StructType(
        [T.StructField("id", T.StringType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
        + [T.StructField("cls", T.IntegerType())]
    )
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return as_segments(rows.select("id", "cls", F.array(*names).alias("x")), positive)


def as_segments(rows: DataFrame, positive: int = 1) -> DataFrame:
    return rows.withColumn("y", (F.col("cls") == positive).cast("int"))
