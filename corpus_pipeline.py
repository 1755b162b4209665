"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of docs, whatever their names, besides doc_id, text and source,
whole texts of any length are read, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import WRITTEN, drop_written, read, staged
from emberlog.llm.lang_id import known_language, train
from emberlog.llm.line_dedup import without_repeated_lines
from emberlog.llm.mixing import mixed_documents
from emberlog.llm.packing import pack_documents
from emberlog.llm.queries import vocabulary
from emberlog.llm.shingle_join import one_per_component


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null and empty texts, texts without a letter, and texts unlike every
    learned language. Repeated rows are judged alike and all stay; null doc_ids and sources don't matter. If no
    row has a lang to learn from, all go."""
    return known_language(docs, train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller doc_id holds go; text and n_chars are renewed, no document goes. Null text
    becomes empty. Rows of one doc_id keep their lines alike; rows without doc_id come after all others, as one
    document."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least doc_id; rows without doc_id go if another row of
    their group stays. Rows alike in every column stay once; texts without words, null and empty ones, all stay."""
    return one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, three times at most, or left out so that sources come near their target words. Null is a
    source of its own. Null and empty texts have no words and are left out; repeated rows are weighed each."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of 2048, a row for each piece. Null and empty texts are one end token;
    repeated rows are packed each, null doc_ids stay null."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models and iterations inside the stages have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = len(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            drop_written(spark, before, 1)  # what the stage wrote on its way
    return docs
