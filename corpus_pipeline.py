"""Training-corpus pipeline over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps
is written as Parquet and read again as the next one's docs.  All but the last
stage return the columns of their docs.

1. ``quality``: documents that the weak-label classifier rejects go.  Null and
   empty texts are rejected.
2. ``near_duplicates``: of every group of linked SimHash fingerprints (3-word
   shingles, 2 bits) one row with the least id stays.
3. ``substrings``: bytes of 50-byte strings that also start in a text of a
   smaller id go; of a character cut in half the rest goes too.  Every row
   stays, also one whose text is empty then; ``n_chars`` follows the text.
4. ``decontamination``: contaminated documents (a twentieth of their words or
   more inside benchmark windows) go; the others stay unchanged.
5. ``tokens``: token ids of every text, with digests of the ids and of the text
   decoded from them.

An empty table gives empty results; repeated rows are treated alike, but for
stage 2, which keeps one of them; null ids come last in every comparison of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import bpe, decontaminate, quality_classifier, simhash, suffix_dedup
from tillcast.llm.common import documents, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", *bpe.digests())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Training, fingerprints and byte-pair merges are beyond SQL; the stages are
#: tested against brute-force versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the whole table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
