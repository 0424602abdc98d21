"""From raw documents to packed sequences: the stages in their order, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's rows as Parquet to the shared folder and rereads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm.jaccard import jaccard_components
from quirewise.llm.packing import pack_documents
from quirewise.llm.quality import LEAST_TAIL, fit_quality, rate_quality
from quirewise.llm.suffixes import remove_repeats
from quirewise.llm.toxicity import fit_toxicity, score_toxicity
from quirewise.session import materialize, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Null and empty texts score the prior and stay."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit_toxicity(docs, labels), "_toxic").filter("_toxic < 0.5").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being above the lowest grade reaches LEAST_TAIL."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rate_quality(docs, fit_quality(docs, labels)).filter(F.col("tail_prob") >= LEAST_TAIL).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of shingle-similar documents.

    Documents without words are in no group and stay. Rows that repeat an id are told apart by nothing and stay together.
    """
    ship_package(spark)
    first = jaccard_components(docs).filter("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents have, ``n_chars`` counted anew.

    Bytes left of a character that was cut in part are dropped with it; a text with nothing left is empty, a null one stays.
    """
    ship_package(spark)
    kept = remove_repeats(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    made = {"text": F.when(F.col("had_text"), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(made["text"]).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(made).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("quality classifier", keep_quality), ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats), ("best-fit packing", pack_sequences),
]

#: Fitted models and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
