"""Interval annotations out of text. Input is one row per file: (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86400


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole annotation files; each is a small text."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def _first(col: Column, pattern: str) -> Column:
    found = F.regexp_extract(col, pattern, 1)
    return F.when(found != "", found)


def parse_intervals(files: DataFrame) -> DataFrame:
    """Start/end lines under ``File Name:`` headers to (path, recording, start_s, end_s).

    An end closes the start directly before it in the same recording. A start followed by
    another start, or by nothing, stays open and is dropped.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    line = F.col("line")
    by_line = Window.partitionBy("path").orderBy("pos")
    marked = lines.withColumn("recording", F.last(_first(line, r"^File Name:\s*(\S+)"), ignorenulls=True).over(by_line))
    marks = F.array(
        F.struct(F.lit(0).alias("kind"), _first(line, r"Seizure.*Start Time:\s*(\d+)").cast("bigint").alias("at")),
        F.struct(F.lit(1).alias("kind"), _first(line, r"Seizure.*End Time:\s*(\d+)").cast("bigint").alias("at")),
    )
    points = marked.select("path", "recording", "pos", F.inline(marks)).filter("at IS NOT NULL AND recording IS NOT NULL")
    w = Window.partitionBy("path", "recording").orderBy("pos", "kind")
    paired = points.withColumn("start_s", F.lag("at").over(w)).withColumn("_k", F.lag("kind").over(w))
    return paired.filter("kind = 1 AND _k = 0").select("path", "recording", "start_s", F.col("at").alias("end_s"))


def clock_seconds(text: Column) -> Column:
    """HH.MM.SS or HH:MM:SS to seconds of the day; null when it is no valid clock time."""
    t = F.replace(F.trim(text), F.lit("."), F.lit(":"))
    pattern = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    h, m, s = (F.regexp_extract(t, pattern, i).try_cast("int") for i in (1, 2, 3))
    valid = t.rlike(pattern) & (h < 24) & (m < 60) & (s < 62)
    return F.when(valid, (h * 3600 + m * 60 + s).cast("bigint"))


def clock_offsets(files: DataFrame) -> DataFrame:
    """(path, start_s, end_s) in seconds from the registration start, over midnight if needed."""
    pair = r"(?s)Start time:\s*([0-9.:]+).*?End time:\s*([0-9.:]+)"
    starts, ends = (F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for pattern, i in ((pair, 1), (pair, 2)))
    reg = clock_seconds(_first(F.col("text"), r"Registration start time:\s*([0-9.:]+)"))
    rows = files.select("path", reg.alias("reg"), F.explode(F.arrays_zip(starts.alias("a"), ends.alias("z"))).alias("m"))
    clock = rows.select("path", "reg", clock_seconds(F.col("m.a")).alias("a"), clock_seconds(F.col("m.z")).alias("z"))
    s, e = F.pmod(F.col("a") - F.col("reg"), F.lit(DAY)), F.pmod(F.col("z") - F.col("reg"), F.lit(DAY))
    ok = clock.filter("reg IS NOT NULL AND a IS NOT NULL AND z IS NOT NULL")
    return ok.select("path", s.alias("start_s"), F.when(e < s, e + DAY).otherwise(e).alias("end_s"))
