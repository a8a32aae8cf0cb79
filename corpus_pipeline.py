"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns a DataFrame; run() writes it as Parquet in the shared
folder and reads it again as the next stage's documents. All but the last return the columns of documents, under any names that
extra columns have. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import decontaminate, langid, lines, neardup, packing, queries
from docaudit.llm.columns import shielded
from docaudit.llm.storage import materialize, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language model rejects: those without letters, or unlike all languages it has learned.

    Null and empty texts have no letters and go. Rows that repeat share their fate. Without labelled rows nothing is learned and
    everything goes. Very long texts are judged whole.
    """
    inner, named = shielded(docs, "doc_id", "text", "lang")
    return named(langid.language_id(inner, langid.fold("doc_id", 3) != 1, inner.columns).filter(~F.col("rejected")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents that nothing is left of; n_chars follows the text.

    Of near lines (up to 4 edits, by length) the first by id and place stays, null ids first. Documents that lose nothing stay, null
    and empty texts too; rows that repeat with their id share their fate.
    """
    inner, named = shielded(docs, "doc_id", "text", "n_chars")
    out = lines.drop_repeated_lines(inner, lines.BY_LENGTH)
    out = out.filter((F.col("lines_removed") == 0) | (F.length(F.trim(F.translate("text", "\n\t\r", ""))) > 0))
    return named(out.withColumn("n_chars", F.char_length("text").cast("long")))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8).

    It is the one of the least id, null ids last, and of rows that repeat one. Null texts and texts without words are duplicates of
    nothing, but of repeated rows of them one stays as well.
    """
    inner, named = shielded(docs, "doc_id", "text")
    return named(neardup.drop_near_duplicates(inner))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, and no items drop nothing. Rows that repeat are
    judged each."""
    inner, named = shielded(docs, "doc_id", "text")
    items = queries.table(spark, sf_dir, "benchmark")
    return named(decontaminate.find_leaks(inner, items, [c for c in inner.columns if c != "text"]).filter(F.size("hits") == 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 at most; null and empty texts are a piece of one token, rows that repeat pieces each."""
    return packing.best_fit_packing(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", unique_lines),
    ("minhash_near_dedup", unique_documents),
    ("benchmark_decontamination", unseen),
    ("best_fit_packing", packed),
]
#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. What a stage keeps meanwhile goes once its result is written."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
