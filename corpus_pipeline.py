"""A training corpus from documents: quality rules, near copies, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents, whatever these are named.
SQL cannot express the surrogate and retrieval stages; tests hold each stage against a brute-force version.

Cases, for every stage: null and empty texts are documents without words, which the quality rules reject and the
other stages leave alone; very long texts are judged whole; a null doc_id links with nothing, matches no benchmark
item and stays; rows that share a doc_id are one document to the near-copy stage, which keeps one of them, are
dropped together when one of them holds a benchmark item, and are rows of their own to the other stages; equal rows
get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import discard, free_name, stored, table
from sparkloupe.llm.decontamination import contaminated
from sparkloupe.llm.mixing import mix_sources
from sparkloupe.llm.ngram_join import JaccardJoin, jaccard_components
from sparkloupe.llm.pii import replace_pii, surrogate_key
from sparkloupe.llm.quality_rules import judged, quality_measures

#: Near duplicates here: five words a shingle and a similarity of 0.8 or more.
NEAR = JaccardJoin(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; ties cannot be, as each is judged alone."""
    rest = [c for c in docs.columns if c != "text"]  # in a struct, so that none can clash with a measure
    kept = judged(quality_measures(docs.select(F.struct(*rest).alias("row"), "text"))).where("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, and of rows that share it one."""
    groups = jaccard_components(docs, NEAR)
    left = docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    first = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or as a paraphrase that keeps most of its words in order."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    count = free_name("n_pii", docs)
    new = replace_pii(docs, surrogate_key(spark), count_col=count)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: all their columns, then size, source_size, target, taken and copies (how often),
    with underscores behind the names that documents has itself."""
    mix = mix_sources(docs, keep=tuple(docs.columns)).where("copies > 0")
    return mix.select("row.*", *(F.col(c).alias(free_name(c, docs)) for c in ("size", "source_size", "target", "taken", "copies")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            last, docs = docs, stored(docs, "pipeline")
            discard(last)
    return docs
