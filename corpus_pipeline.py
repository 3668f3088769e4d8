"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that the one before kept, with all their columns, and its decisions take effect: rejected
documents, all but one of near-duplicates and repeated passages go, and the mix holds a document as often as it is taken.
The last stage returns token counts and digests instead. Nulls, empty texts, repeated rows and extra columns are treated
as each operator's module says.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, minhash, mixing, quality, suffix
from quillspark.llm.common import drop_path, new_path, saved, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of repeated passages; ``n_chars`` follows."""
    out = suffix.remove(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring the sources to their target weights."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.round_trip(docs.select("doc_id", "text"), bpe.default_path())


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: EM, components, suffix sorting and BPE have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and read again before the next, then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, name)
            docs = saved(docs, name, path=path)
            if before:
                drop_path(spark, before)
            before = path
    return docs
