"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents``; the last returns the packed pieces. The caller writes every
stage's result as Parquet and reads it back; ``run`` does so in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, tune, written
from ledgerloom.llm.linededup import dedup_lines
from ledgerloom.llm.mixing import mix_documents
from ledgerloom.llm.ngramjoin import ngram_classes
from ledgerloom.llm.packing import pack
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the model learns from labelled rows that op10 may learn from."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, out="_toxicity")
    return scored.where(F.col("_toxicity.score") < 0.3).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten code points or more stay only in the first document that holds them. A document that
    loses all its lines stays, with an empty text; n_chars follows the text."""
    kept = dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that five-word shingles link at 0.8 or more, the smallest id stays.

    Texts without words are in no class and stay; rows without an id stay.
    """
    tune(spark)
    found = ngram_classes(docs, n=5, num=80, den=100)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a document is repeated, or left out, as the mix takes it."""
    tune(spark)
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048; a document that the mix repeats is packed as often."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: token ids and a learned model have no SQL form; the tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = written(docs, f"stage{number}")
    return docs
