"""A training-text pipeline over documents: quality rules, near-duplicate removal, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them in order. Every stage works on all rows that the one
before it kept. Null texts fail the quality rules, so later stages have none of ``documents``; each stage alone treats them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outspan.llm.chosen_path import jaccard_classes
from outspan.llm.common import materialize, scratch
from outspan.llm.packing import pack
from outspan.llm.pii import find_pii
from outspan.llm.quality_rules import quality_rules
from outspan.llm.queries import tokenizer_path
from outspan.llm.suffix_dedup import remove_repeats
from outspan.session import ship


#: Bytes of a passage that is removed where it repeats: fifty words of four letters and a space.
PASSAGE = 250


def _columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; n_chars follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join: the one with the least id. Texts without a word are classes of their own."""
    ship(spark)
    classes = jaccard_classes(docs)
    alone = F.when(F.col("__set").isNull(), F.monotonically_increasing_id())  # its own group, whatever the ids are
    one = Window.partitionBy("class_id", "__alone").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = classes.withColumn("__alone", alone).withColumn("__rank", F.row_number().over(one))
    return ranked.filter("__rank = 1").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of PASSAGE bytes or more that occur elsewhere."""
    ship(spark)
    return _columns(docs, remove_repeats(docs, length=PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return _columns(docs, find_pii(docs, mask=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    ship(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs


#: Components and byte-pair coding are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
