"""From raw documents to packed token sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import jaccard, leaks, packing, quality, substrings
from tesserine.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.accepted(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of smallest id.

    Rows that share an id stand for themselves: those that link, or repeat, leave one, and others stay.
    Documents without an id can't be named in a group; they all stay.
    """
    unnamed = docs.where(F.col("doc_id").isNull())
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        groups = jaccard.link(docs.select("doc_id", "text"))
        first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return named.join(first, "doc_id", "left_semi").unionByName(unnamed).select(docs.columns)
    # an id doesn't name a row here: rows are linked by their place in a table of their own
    rows = stored(named.withColumn("_place", F.monotonically_increasing_id()), "rows")
    texts = rows.select("_place", "text").unionByName(unnamed.select(F.lit(None).cast("long").alias("_place"), "text"))
    groups = jaccard.link(texts, key="_place").where(F.col("_place").isNotNull())
    first = rows.select("_place", "doc_id").join(groups, "_place").groupBy("component_id").agg(F.min(F.struct("doc_id", "_place"))["_place"].alias("_place"))
    one = rows.join(first, "_place", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(docs.columns).unionByName(unnamed).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that stand more than once; ``n_chars`` follows.

    A document of which no word is left goes; one that had none before stays as it is.
    """
    cut = substrings.deduplicate(docs, verbatim=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.screen(docs, table(spark, sf_dir, "benchmark"), short=True).where(F.size("leaks") == 0).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 4096 ids."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the alignment of benchmark items nor the tokens of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
