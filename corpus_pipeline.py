"""A corpus pipeline of four operators: quality, near-duplicates, mixing, encoding.

Nulls: rows with a null id or text, and empty texts, pass as each operator says; a null id is near nothing. Repeated rows stay
rows. Columns of any other name stay up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import fresh, materialise, rested, sized_join, table, trim
from inkfold.llm.minhash_dedup import near_texts
from inkfold.llm.mixing import mix
from inkfold.llm.quality import good_documents
from inkfold.llm.queries import bpe_digests

#: No source's documents are used more than this many times as often as another's: the limit of op10.
MAX_EPOCHS = 4.0
#: A task of the last stage holds so many words; fewer than op5, as executors come to it with what other stages left.
HELD_WORDS = 1 << 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rested(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; five words a shingle.

    Texts without words are near nothing and stay, whatever other rows their id has."""
    rested(spark)
    gone = near_texts(docs, shingle_words=5, percent=80).where("not kept and n_shingles > 0").select("doc_id").distinct()
    mark = fresh(docs, "gone")
    marked = sized_join(docs, materialise(gone.withColumn(mark, F.lit(True))), "doc_id", "left")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return marked.where(F.col(mark).isNull() | ~has_words).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come again, as the target weights ask for; none is lost."""
    rested(spark)
    return mix(docs, max_epochs=MAX_EPOCHS).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of what they decode to."""
    rested(spark)
    made = bpe_digests(docs, most_words=HELD_WORDS, chunk=HELD_WORDS // 2)
    trim()
    return made


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: The fitted classifier, the signatures and the bisected mixture aren't SQL; tests/llm compares a brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
