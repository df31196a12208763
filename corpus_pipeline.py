"""Corpus preparation in five stages: toxicity, exact dedup, near-duplicate dedup, benchmark decontamination, packing.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``.

Defined results: null and empty texts are kept by the toxicity, near-duplicate and benchmark stages; exact dedup keeps
one of them; packing gives each its closing id. Repeated rows share their fate. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from shelfmark.llm.queries import toxicity_network
from shelfmark.scratch import staged

#: A document goes if it is scored as toxic with at least this.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``; a null doc_id or text does not matter for the score of a row."""
    net = toxicity_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(spark, net)("text") < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the most code points, then the smallest doc_id."""
    gone = exact_dedup.exact_dedup(docs).filter("not kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    gone = staged(gone, "copies").hint("merge")  # it grows with the documents, so it is never broadcast
    sha = exact_dedup.sha256_hex(exact_dedup.normalised(F.col("own_rows.text")))  # an identifier alone may stand for several texts
    same = F.col("own_rows.doc_id").eqNullSafe(F.col("copies.doc_id")) & (sha == F.col("copies.sha"))
    return docs.alias("own_rows").join(gone.alias("copies"), same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, words=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no ten consecutive words of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

#: Toxicity scores cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
