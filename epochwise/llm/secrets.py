"""Secret scans over every version of every path, by an incremental ledger of blobs.

A blob is the SHA-256 of a text. The ledger holds one row per blob and rule version that was
scanned, with what was found (also where nothing was). A scan takes the pairs that the ledger lacks,
reads one text for each new blob, appends, and joins the findings back to all paths with that blob.

Nulls: a null text is the empty text; a null path is a path like any other. Repeated rows share a
blob, which is scanned once. Empty tables give an empty ledger and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, findings {FINDING}"


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A match counts when ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# fixed values: the patterns and lengths of the three base kinds, in their order
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
BASE_VERSION = "base-1"


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each rule, by start and then rule order."""
    found = []
    for order, rule in enumerate(rules):
        for m in _matches(rule, text):
            found.append((m.start(), order, m.end()))
    return [(rules[order].kind, start, end) for start, order, end in sorted(found)]


def _matches(rule: Rule, text: str) -> Iterator[re.Match]:
    # a run of one character class that is too short can't hold a longer one, so the length may be
    # part of the pattern there; elsewhere a dropped match still takes up its text
    if rule.group == 0 and rule.pattern.endswith("]+"):
        open_at = rule.pattern.rindex("[")
        rest = rule.least - len(rule.pattern[:open_at])
        return re.finditer(f"{rule.pattern[:-1]}{{{max(1, rest)},}}", text, re.ASCII)
    return (m for m in rule.compiled().finditer(text) if len(m.group(rule.group)) >= rule.least)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The ledger at ``path``; empty if there is no path or nothing there yet."""
    if path is not None:
        try:
            return spark.read.schema(LEDGER).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, path: str, text: str, ledger: DataFrame, rule_version: str) -> DataFrame:
    """One (path, blob) for each blob that ``rule_version`` has not scanned."""
    blobs = versions.select(F.col(path).alias("_path"), blob_id(F.col(text)).alias("blob"))
    one = blobs.groupBy("blob").agg(F.min("_path").alias("_path"))
    return one.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")


def scan(
    versions: DataFrame,
    path: str,
    text: str,
    ledger_path: str,
    rules: tuple[Rule, ...] = BASE_RULES,
    rule_version: str = BASE_VERSION,
) -> DataFrame:
    """Scan what is new, append it to the ledger and return the whole ledger.

    The texts move once, to the row that stands for their blob; the rows on the other side
    are ids. Where few blobs are new, that side is small and the texts don't move at all.
    """
    spark = versions.sparkSession
    fresh = unseen(versions, path, text, read_ledger(spark, ledger_path), rule_version)
    texts = versions.select(
        F.col(path).alias("_p"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        blob_id(F.col(text)).alias("_b"),
    )
    same = texts["_p"].eqNullSafe(fresh["_path"]) & (texts["_b"] == fresh["blob"])
    todo = texts.join(fresh.hint("shuffle_hash"), same).select("blob", "_text")

    @F.pandas_udf(FINDING)
    def findings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = [[{"kind": k, "start": a, "end": z} for k, a, z in find(t, rules)] for t in s]
            yield pd.Series(found, index=s.index, dtype=object)

    done = todo.select("blob", F.lit(rule_version).alias("rule_version"), findings("_text").alias("findings"))
    # a row that occurs twice as a whole is read twice; its findings are the same
    done.groupBy("blob", "rule_version").agg(F.first("findings").alias("findings")).write.mode("append").parquet(
        ledger_path
    )
    return read_ledger(spark, ledger_path)


def by_path(
    versions: DataFrame, path: str, text: str, ledger: DataFrame, rule_version: str = BASE_VERSION
) -> DataFrame:
    """(path, blob, findings) for every row of ``versions``; findings are empty where none are.

    Only blobs with findings are joined, on a key that adaptive execution may split.
    """
    rows = versions.select(F.col(path), blob_id(F.col(text)).alias("blob"))
    found = ledger.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0))
    joined = rows.join(found.select("blob", "findings"), "blob", "left")
    return joined.select(
        path, "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings")
    )


def spans(findings: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the findings."""
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.concat_ws(",", F.transform(findings, one))


def redacted(
    versions: DataFrame, path: str, text: str, ledger: DataFrame, rule_version: str = BASE_VERSION
) -> DataFrame:
    """``versions`` with each found span replaced by ``[KIND]``; overlapping spans count as one.

    All other columns and rows stay as they are; a null text stays null.
    """
    found = ledger.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(
        F.col("blob").alias("_blob"), F.col("findings").alias("_findings")
    )
    rows = versions.withColumn("_blob", blob_id(F.col(text)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, founds: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, f) for t, f in zip(texts, founds)], index=texts.index, dtype=object)

    hit = rows.join(found, "_blob", "left")
    clean = F.when(F.col("_findings").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("_findings")))
    return hit.withColumn(text, clean).select(*versions.columns)


def _cut(text: str | None, found) -> str | None:
    if text is None or found is None:
        return text
    out, at = [], 0
    for f in found:
        if f["start"] >= at:
            out += [text[at : f["start"]], f"[{f['kind'].upper()}]"]
        at = max(at, f["end"])
    return "".join(out) + text[at:]
