"""A ledger of validated files, so that a file is read for its validation once.

One row per file as it was found: path, length, modification time, the rows its footer promises, the rows that could be read,
and what is wrong with it (null: nothing). A file that was written again has another length or time and is validated anew.
The ledger only grows; where two runs validated the same file, their rows say the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.operators.attach import attach
from epochwise.session import discard, materialise
from epochwise.sources.samples import SAMPLES, same_path

LEDGER = "path string, length long, modified timestamp, promised long, got long, reason string"
FILE = ["path", "length", "modified"]


def listing(spark: SparkSession, paths: list[str], glob: str = "*.parquet") -> DataFrame:
    """(path, length, modified) of the files below ``paths``; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return files.select(same_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger).dropDuplicates(FILE)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def validate(spark: SparkSession, paths: str | list[str], ledger: str, schema: T.StructType = SAMPLES) -> int:
    """Validate the files that the ledger lacks and append them to it; gives how many those were.

    Rows are counted from the footers and by reading every value; reading skips what is damaged, so the difference is what
    would be lost without a word. Only new files are opened. Their names are on the driver, as those of any scan.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = materialise(listing(spark, paths), "listing")
    new = materialise(found.join(read_ledger(spark, ledger).select(*FILE), FILE, "left_anti"), "new-files")
    names = [r.path for r in new.select("path").toLocalIterator()]
    if names:
        raw = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*names)
        path = same_path(F.col("_metadata.file_path")).alias("path")
        promised = raw.select(path).groupBy("path").agg(F.count(F.lit(1)).alias("promised"))
        # the hash needs every column, so every page is read
        whole = raw.select(path, F.xxhash64(*schema.fieldNames()).alias("h"))
        got = whole.groupBy("path").agg(F.count(F.lit(1)).alias("got"), F.bit_xor("h").alias("h")).filter("h IS NOT NULL")
        rows = new.join(promised, "path", "left").join(got.drop("h"), "path", "left")
        count = F.coalesce("got", F.lit(0).cast("bigint"))
        reason = F.when(F.col("promised").isNull(), "no rows").when(count < F.col("promised"), "rows missing")
        rows.select(*FILE, "promised", count.alias("got"), reason.alias("reason")).coalesce(1).write.mode("append").parquet(ledger)
    discard(found, new)
    return len(names)


def damaged(spark: SparkSession, paths: str | list[str], ledger: str) -> DataFrame:
    """(path, reason, lost) of the files below ``paths`` that the ledger says are damaged, as they are now."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    bad = read_ledger(spark, ledger).filter("reason IS NOT NULL")
    here = listing(spark, paths).join(bad, FILE)
    return here.select("path", "reason", (F.col("promised") - F.col("got")).alias("lost"))


def read_samples(spark: SparkSession, paths: str | list[str], ledger: str) -> DataFrame:
    """Long samples of all sound files; files that are new since the last time are validated first.

    A damaged file is left out as a whole; ``damaged`` names it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    validate(spark, paths, ledger)
    raw = spark.read.schema(SAMPLES).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(*paths)
    rows = raw.select("*", same_path(F.col("_metadata.file_path")).alias("_path"))
    bad = materialise(damaged(spark, paths, ledger).select(F.col("path").alias("_path")).distinct(), "damaged")
    return attach(rows, bad, ["_path"], "left_anti").select(*SAMPLES.fieldNames())
