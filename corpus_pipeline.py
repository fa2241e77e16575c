"""From raw documents to token ids: quality, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of ``docs`` as they came in, extra ones included:

1. ``quality``: documents under the classifier's threshold go. Null and empty texts are scored too.
2. ``near_duplicates``: of the texts alike in 80 % of their five-word shingles one stays, that with the
   smallest id; a null id comes after all others. A row is known by its id and text together, so a row whose id occurs
   again with another text is judged by its own text. Of rows with the same id and text the first by their
   columns stays. Texts without words are in no group and stay, also repeated ones.
3. ``decontaminate``: documents that hold a benchmark item go. Null and empty texts hold none and stay; very long
   texts are searched whole; repeated rows go or stay together.
4. ``secrets``: found secrets are replaced by a mark in the text, and ``n_chars`` follows. Null texts stay null, empty
   ones empty; repeated rows are changed alike; very long texts are scanned whole.
5. ``encode``: ids of the whole text, as packed little-endian 32-bit integers, and their number.
   What the ids decode to must be the text; else the job fails. A null text has the ids of the empty one, none; a
   null id and repeated rows keep their rows. Columns other than id and text are left out.

Further columns may have any names. Empty tables pass every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.llm import byte_bpe, byte_cnn, decontaminate, near_dup, secrets
from epochwise.llm.registry import prepare
from epochwise.session import materialise, scratch_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = byte_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(byte_cnn.scorer(spark, model)(F.col("text")) >= byte_cnn.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType
    key = F.struct(
        F.col("doc_id").isNull().alias("absent"),
        F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
        F.xxhash64(text).alias("text"),
        F.hash(text).alias("check"),
    )
    name = "_key"
    while name in docs.columns:
        name += "_"
    found = near_dup.groups(docs.select(key.alias("key"), "text"), "key")
    found = materialise(found.select(F.col("id").alias(name), "n_shingles", "kept"), "near-duplicates")
    repeated = found.filter("kept AND n_shingles > 0").groupBy(name).agg(F.count("*").alias("rows")).filter("rows > 1")
    repeated = materialise(repeated.select(name), "repeated")
    gone = found.filter("NOT kept").select(name).distinct().unionByName(repeated)
    out = docs.join(gone, key == F.col(name), "left_anti")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, key == F.col(name), "left_semi").select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return out.unionByName(again.groupBy("key").agg(F.min("row").alias("row")).select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.clean(docs, found).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    ledger = secrets.scan(docs, "doc_id", "text", scratch_path(spark, "secret-ledger"))
    out = secrets.redacted(docs, "doc_id", "text", ledger)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    length = F.coalesce(F.length("text").cast(kind), F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.round_trip(docs.select("doc_id", "text"), "text", path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids don't decode to the text")).cast("binary"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), checked.alias("ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
