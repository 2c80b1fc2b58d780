"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import mixing, near_text, packing, quality, simhash, storage

END_ID = 2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; as many as weigh like labelled good ones.

    Null and empty texts weigh as texts without words; rows alike are drawn
    together; without good and bad labels all rows stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.importance_sample(docs, labels).where("selected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Copies link by SimHash fingerprints of three or fewer differing bits, found by
    multi-index hashing as in op8, or by a five-word Jaccard similarity of 0.8 or
    more, which those bits reach for about half of such pairs. Null, empty and blank texts are one group; rows of null or repeated ids are
    told apart by their texts; an empty table stays empty.
    """
    return near_text.keep_representatives(docs, linked=lambda rows: simhash.near_duplicates(rows, "row", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null and blank texts have no words and are taken once; a null source is a
    source of its own; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of at most 4096 tokens.

    A null or empty text is its end token alone; a text of any length is cut into
    windows; rows of null or repeated ids pack each; an empty table has no pieces.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Hashed models, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
