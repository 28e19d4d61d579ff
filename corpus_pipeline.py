"""The corpus pipeline: toxicity filter, near-dedup, repeated passages, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.llm.common import checkpointed, tune
from pagetally.llm.decontam import decontaminated
from pagetally.llm.packing import pack
from pagetally.llm.setsketch import near_duplicates
from pagetally.llm.suffixes import suffix_duplicates
from pagetally.llm.toxicity import toxicity
from pagetally.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. A null or empty text scores as one without marks, so it stays; each row is
    judged by itself, so repeated rows and rows without id stay or go alike; a text of any length is scored whole;
    columns but those of documents go; no rows give none."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), sample=4000, threshold=0.3, carry=["text", "lang", "source", "n_chars"])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id. Texts without words, null
    ones too, and rows without id are in no group and stay; equal rows have one doc_id and stay or go together; a
    similarity of exactly 0.8 joins; a text of any length is compared whole; no rows give none."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that repeat earlier text are cut; every document stays, and a text without such a
    passage as it is (null stays null). Of equal passages the one with the smallest doc_id, then the earliest, stays;
    equal rows are cut alike; rows without id are not compared; n_chars is counted anew where something was cut."""
    cut = suffix_duplicates(docs, window=50, carry=["lang", "source", "n_chars"])
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", length.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy or an excerpt of a benchmark item, decided for each row, with or without id. A null or
    empty text copies nothing and stays; without items every row stays; a text of any length is searched whole."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row for each piece. A null or empty text is the closing id alone; repeated rows are
    packed as often as they occur; a text of any length is cut into as many pieces as it takes; no rows give none."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Toxicity scores and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
