"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one places them in
shards, text and all. Null and empty texts are rejected by the first stage, as text without a language. Repeated rows are kept or dropped
together. Other columns may have any name and are carried on; those named as the last stage's new ones are replaced by them. Empty tables
stay empty. Ties, and texts of any length, are dealt with as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelattice.llm import decontam, langid, mixing, neardup, sharding
from tidelattice.llm.membership import split
from tidelattice.llm.store import materialise, release, written
from tidelattice.llm.text import fresh


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which one language has the larger part; texts without any letter go."""
    pred, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    found = langid.identify(docs, langid.train(docs), pred, score)
    return found.filter((F.col(pred) != langid.UND) & (F.col(score) >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) keep the document of smallest id; rows that repeat an id are one document
    and stay together, and rows without an id stay."""
    gone = materialise(neardup.near_duplicates(docs, shingle=5, percent=80).filter("not kept and doc_id is not null").select("doc_id").distinct(), "pipeline-gone")
    # only texts whose id may be among those that go are shuffled
    maybe, rest = split(docs, "doc_id", gone)
    return rest.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents; from the others cut the spans that occur in the benchmark, and correct n_chars."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample four fifths of the tokens, with flatter shares of sources, languages and topics."""
    return mixing.Mix(docs, share=0.8, power=0.7).sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, in 16 shards along the curve: rows lie in the order of shard and slot, and so do the files they are written to."""
    return sharding.place(docs, shards=16)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained models, signatures and draws are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's own tables are deleted when its output is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before, written() - 1)
        before = written() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
