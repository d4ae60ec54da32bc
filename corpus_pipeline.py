"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, line_dedup, near_copies, packing, quality
from dossier.llm.common import SPACE_CLASS, handed_out, materialise, read, release
from dossier.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; of the others, lines that break a rule go."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or near-equal line go, and documents that lose all of their lines that way."""
    out = line_dedup.dedup_lines(docs, exact_words=1)
    # by the Column API: a literal in SQL text would lose its backslashes
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(f"[^{SPACE_CLASS}]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word-shingle similarity of 0.8 or more stays."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with the benchmark go, and documents that are mostly such spans."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminated), ("best_fit_packing", packed)]

#: Python runs in three of the stages, so SQL can't express the whole; tests/llm/test_pipeline.py holds each stage, and the
#: whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = handed_out()
        after = materialise(stage(spark, docs, sf_dir))
        # the tables on the stage's way are done with
        release(spark, since=mark, keep=1)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
