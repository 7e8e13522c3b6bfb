"""A corpus pipeline of five stages, each over all documents that the one before kept.

Defined results, for every stage: columns beside ``doc_id`` and ``text`` may be any and have any names, and all but the last stage return them
as they are (``secrets`` counts ``n_chars`` anew); a null text is an empty text; texts of any length are read whole; a null doc_id is
an id like any other; an empty table gives no row.  Repeated rows are judged and redacted each; ``near_duplicates`` keeps one of
them, and ``packing`` packs what it is given.  What a null or empty text gets: ``toxicity`` keeps it, as an empty bag's score is low;
``quality`` rejects it, having no words; ``near_duplicates`` keeps one of all blank texts; ``packing`` makes a piece of the end id alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decision_list, packing, secret_forest, simhash_bands, toxicity
from lectern.llm.common import tokenizer_path
from lectern.storage import cut, delete_folder, shared_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return decision_list.keep_good(docs, decision_list.train(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: SimHash balls over bands."""
    return simhash_bands.near_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks."""
    return secret_forest.redact(docs, secret_forest.train())


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(cut(pieces))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: Trained models and tokenizers can't be expressed in SQL; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; what each returns is written in the shared folder and read again.

    A stage's table goes when the next one's is written whole; the last one's stays, as the result reads it.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
