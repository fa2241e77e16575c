"""The driver tables seen through the engine's schemas, and the same views as SQL.

events      -> wide samples: one row per instant, channels value, k, minute
               annotations: an ``error`` above 150 opens an interval of four samples
embeddings  -> feature rows f01..f20 with subject and class; the whole vector is a raw segment
labels x documents -> scored rows: y = toxic, four score formulas, two protocols
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators import ordering, prep, signal
from epochwise.session import materialise

CHANNELS = ["value", "k", "minute"]
EPOCH_N = 24
NPERSEG = 16
RATE = 60.0
ANNOTATION_VALUE = 150.0
ANNOTATION_LEN = 4
FEATS = [f"f{i:02d}" for i in range(1, 65)]
MODELS = ["rf", "lr", "svm", "vote"]
PROTOCOLS = ["loso", "kfold"]
SUBJECT_GROUPS = 8

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="epochwise-pkg-"), "epochwise.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


class Hub:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def wide(self) -> DataFrame:
        """One row per sample instant."""
        ts = F.col("ts")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("subject"),
            F.date_format(ts, "yyyyMM").alias("recording"),
            ts,
            "event_id",
            "event_type",
            (
                (F.dayofmonth(ts) - 1) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
            )
            .cast("bigint")
            .alias("off_s"),
            F.col("value"),
            F.get_json_object("props", "$.k").cast("double").alias("k"),
            (F.minute(ts) + F.second(ts) / F.lit(60.0)).alias("minute"),
        )

    @cached_property
    def numbered(self) -> DataFrame:
        """Wide samples with a gapless index per recording."""
        slot = F.floor(F.col("off_s") / 21600)
        ranked = ordering.exact_rank(
            self.wide, ["subject", "recording"], [F.col("ts"), F.col("event_id")], slot, out="idx"
        )
        # stored once: samples, segments and annotations all start from it
        return materialise(ranked.withColumn("idx", F.col("idx") - 1), "numbered")

    @cached_property
    def samples(self) -> DataFrame:
        return prep.to_long(self.numbered, ["subject", "recording", "idx"], CHANNELS)

    @cached_property
    def segments(self) -> DataFrame:
        return signal.segments(self.numbered, CHANNELS, EPOCH_N)

    @cached_property
    def annotations(self) -> DataFrame:
        hit = (F.col("event_type") == "error") & (F.col("value") > ANNOTATION_VALUE)
        return self.numbered.filter(hit).select(
            "subject",
            "recording",
            F.col("idx").alias("start_s"),
            (F.col("idx") + ANNOTATION_LEN).alias("end_s"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """The flagship table: 20 features and a label per epoch."""
        feats = signal.epoch_features(self.segments, RATE, NPERSEG)
        return prep.label_by_index(feats, self.annotations, EPOCH_N)

    @cached_property
    def emb(self) -> DataFrame:
        """Feature rows: id, subject, cls, y, f01..f20."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            F.concat(F.lit("s"), (F.col("vec_id") % SUBJECT_GROUPS).cast("string")).alias("subject"),
            F.col("label").alias("cls"),
            (F.col("label") == 0).cast("int").alias("y"),
            *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(FEATS)],
        )

    @cached_property
    def raw_segments(self) -> DataFrame:
        """Raw one-channel segments: id, cls, x."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("label").alias("cls"),
            F.col("embedding").cast("array<double>").alias("x"),
        )

    @cached_property
    def scored_wide(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source", "lang", "n_chars")
        n = F.col("n_chars").cast("double")
        rf = F.lit(1.0) / (F.lit(1.0) + n / F.lit(1000.0))
        lr = F.round(F.lit(1.0) / (F.lit(1.0) + n / F.lit(2500.0)), 2)
        svm = ((F.col("doc_id") * 37) % 101).cast("double") / F.lit(100.0)
        rows = self.table("labels").join(docs, "doc_id").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("subject"),
            "lang",
            F.col("toxic").cast("int").alias("y"),
            rf.alias("rf"),
            lr.alias("lr"),
            svm.alias("svm"),
        )
        return rows.withColumn(
            "vote", (F.col("rf") + F.col("lr") + F.col("svm")) / F.lit(3.0)
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Scored rows: id, subject, lang, y, model, protocol, p."""
        leak = F.col("y").cast("double") * F.lit(0.15)
        cells = []
        for m in MODELS:
            cells.append(F.struct(F.lit(m).alias("model"), F.lit("loso").alias("protocol"), F.col(m).alias("p")))
            cells.append(
                F.struct(
                    F.lit(m).alias("model"),
                    F.lit("kfold").alias("protocol"),
                    (F.col(m) * F.lit(0.85) + leak).alias("p"),
                )
            )
        return self.scored_wide.select("id", "subject", "lang", "y", F.inline(F.array(*cells)))


# --- the same views for the SQL side -------------------------------------------------------

_VIEWS: dict[str, tuple[list[str], str]] = {
    "wide": (
        [],
        """SELECT CAST(user_id AS VARCHAR) AS subject, strftime(ts, '%Y%m') AS recording, ts, event_id,
        event_type, CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS off_s,
        value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
        minute(ts) + second(ts) / 60.0e0 AS minute FROM events""",
    ),
    "numbered": (
        ["wide"],
        """SELECT *, row_number() OVER (PARTITION BY subject, recording ORDER BY ts, event_id) - 1 AS idx
        FROM wide""",
    ),
    "samples": (
        ["numbered"],
        """SELECT subject, recording, idx, 'value' AS channel, value FROM numbered
        UNION ALL SELECT subject, recording, idx, 'k', k FROM numbered
        UNION ALL SELECT subject, recording, idx, 'minute', minute FROM numbered""",
    ),
    "full_epochs": (
        ["numbered"],
        f"""SELECT subject, recording, idx // {EPOCH_N} AS epoch FROM numbered
        GROUP BY ALL HAVING count(*) = {EPOCH_N}""",
    ),
    "seg": (
        ["samples", "full_epochs"],
        f"""SELECT s.subject, s.recording, s.idx // {EPOCH_N} AS epoch, channel, s.idx % {EPOCH_N} AS i, value AS x
        FROM samples s JOIN full_epochs f ON s.subject = f.subject AND s.recording = f.recording
        AND s.idx // {EPOCH_N} = f.epoch""",
    ),
    "annotations": (
        ["numbered"],
        f"""SELECT subject, recording, idx AS start_s, idx + {ANNOTATION_LEN} AS end_s FROM numbered
        WHERE event_type = 'error' AND value > {ANNOTATION_VALUE}""",
    ),
    "emb": (
        [],
        f"""SELECT vec_id AS id, 's' || CAST(vec_id % {SUBJECT_GROUPS} AS VARCHAR) AS subject, label AS cls,
        CAST(label = 0 AS INT) AS y, """
        + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(FEATS))
        + " FROM embeddings",
    ),
    "emb_long": (
        [],
        f"""SELECT vec_id AS id, 's' || CAST(vec_id % {SUBJECT_GROUPS} AS VARCHAR) AS subject, label AS cls, CAST(label = 0 AS INT) AS y,
        'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value
        FROM embeddings, unnest(generate_series(1, {len(FEATS)})) AS g(i)""",
    ),
    "raw": (
        [],
        """SELECT vec_id AS id, label AS cls, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x
        FROM embeddings, unnest(generate_series(1, 64)) AS g(i)""",
    ),
    "scored_wide": (
        [],
        """SELECT *, (rf + lr + svm) / 3.0e0 AS vote FROM (
        SELECT l.doc_id AS id, d.source AS subject, d.lang, CAST(l.toxic AS INT) AS y,
        1.0e0 / (1.0e0 + CAST(n_chars AS DOUBLE) / 1000.0e0) AS rf,
        round(1.0e0 / (1.0e0 + CAST(n_chars AS DOUBLE) / 2500.0e0), 2) AS lr,
        CAST((l.doc_id * 37) % 101 AS DOUBLE) / 100.0e0 AS svm
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    ),
    "scored": (
        ["scored_wide"],
        " UNION ALL ".join(
            f"SELECT id, subject, lang, y, '{m}' AS model, 'loso' AS protocol, {m} AS p FROM scored_wide"
            f" UNION ALL SELECT id, subject, lang, y, '{m}', 'kfold',"
            f" {m} * 0.85e0 + CAST(y AS DOUBLE) * 0.15e0 FROM scored_wide"
            for m in MODELS
        ),
    ),
}


def add_view(name: str, needs: list[str], sql: str) -> None:
    _VIEWS[name] = (needs, sql)


def with_views(*names: str, **local: str) -> str:
    """``WITH`` clause holding the named views, what they need, and local ones in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in _VIEWS[name][0]:
            visit(n)
        done.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in done]
    parts += [f"{n} AS ({s})" for n, s in local.items()]
    return "WITH " + ",\n".join(parts) + "\n"
