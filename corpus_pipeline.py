"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
into the shared folder and read again as the next stage's ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatlas.llm import near_copies, offsets, quality, repeats, suffix_search
from fixatlas.llm.queries import tokenizer_path
from fixatlas.llm.stored import documents, stored, table

# A document goes if bad quality is the likelier label.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that boosted trees, learnt from ``labels``, don't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share four fifths of their five-word runs."""
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes that a document with a smaller id has.

    ``n_chars`` is counted again. Documents of which only white space is left go.
    """
    cleaned = repeats.remove_repeats(docs, as_text=True)
    counts = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return cleaned.where(~emptied).withColumns(counts).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur."""
    return suffix_search.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, the original bytes each stands for, and whether decoding gives the text back."""
    coded = offsets.encode_with_offsets(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece", sentence_pieces),
]

# Trees and pieces can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
