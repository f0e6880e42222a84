"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, byte-pair encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs, the last its
tokens. run() writes each stage's rows as Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, linededup, simhash
from tidemark.llm.common import carried, new_path
from tidemark.llm.queries import held_out, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject. Null texts and texts without a letter have none and go."""
    return langid.drop_rejected(docs, langid.fit(docs, ~held_out()))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that an earlier document has; n_chars follows the text. A null text stays null."""
    found = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8) the document with the smallest doc_id.

    Of rows with that doc_id one text stays. A null doc_id is the largest. Rows equal in doc_id and text are one document.
    Documents without words are alike.
    """
    gone = simhash.similar(docs).where("not first").select(F.col("_id").alias("_gone_id"), F.col("_tag").alias("_gone_tag"))
    rows = carried(docs, "doc_id", "text")
    return rows.join(gone, (rows["_id"] == gone["_gone_id"]) & (rows["_tag"] == gone["_gone_tag"]), "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null text holds none and stays."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to. A null text is empty; repeated rows each come out."""
    return bpe.round_trip(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", as_tokens),
]

#: SQL has no XXH64 fingerprints, classifier or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
