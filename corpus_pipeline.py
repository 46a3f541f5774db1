"""A training corpus from the table documents, in five stages; each is written as Parquet and read again as the next one's input.

Language ID drops documents without a language, line dedup cuts repeated lines, the n-gram join keeps one document of each group of near
copies, decontamination drops documents that hold a benchmark item, and BPE gives the token ids of what is left.

Defined results, by stage. Null and empty texts: language ID drops them, and later stages keep what has none. Very long texts are handled whole.
Ties: of near copies the smallest doc_id stays. Repeated rows, rows of one doc_id: one document to line dedup, the n-gram join and
decontamination, which keep or drop all of them; rows without a doc_id stay. Empty tables give empty results. Other columns come
through unchanged, whatever their names; n_chars, where the table has it, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.bpe import round_trip
from crossweave.llm.common import materialise
from crossweave.llm.decontaminate import decontaminate
from crossweave.llm.language_id import fit, held_out, predict
from crossweave.llm.line_dedup import dedup_lines
from crossweave.llm.ngram_join import gram_components
from crossweave.llm.queries import token_digests


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns in a struct: an operator's columns can't meet columns of the same name."""
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("row"), *(F.col(c).alias(f"_{c}") for c in docs.columns if c not in ("doc_id", "text"))).alias("others"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others")[f"_{c}"].alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those predicted `und`, without any letter, go. Trained on the rows that op3 trains on."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(_packed(docs), model).where(F.col("lang_pred") != "und").transform(_unpacked, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that had text and has no word left goes. n_chars follows the text."""
    cut = dedup_lines(_packed(docs))
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" not in docs.columns:
        return kept.transform(_unpacked, docs.columns)
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others")["_n_chars"])
    return kept.withColumn("others", F.col("others").withField("_n_chars", size)).transform(_unpacked, docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; rows of one doc_id are one document, rows without one stay."""
    others = gram_components(docs.select("doc_id", "text")).where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, as op2 gives them."""
    import public_tokenizers

    return token_digests(round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: A fitted model, byte pair merges and a graph's components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
