"""Exact dedup in three combining steps, with DataFrame functions only.

1. Locally: the partial aggregate of each task merges equal texts before anything is shuffled.
2. Salted: groups of (digest, salt, text) merge what tasks of one salt have left; the salt is the task's number.
3. Globally: (digest, text) combines the salts' winners, `salts` rows for a text at most.

Each step groups by the full text beside its digest. Members then find their winner by digest alone, without
the text. That is right where a digest has one text, which step 3 has just counted; should any digest have
more, members are matched by digest and text. A group may be any share of the rows: its members are dealt by
digest and salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, checkpointed, looked_up

SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for each row.

    Texts are equal when identical after each run of white space (20, 09-0D) has become one space; null is
    empty. The smallest doc_id of a group stays. A null doc_id counts as the largest. If the smallest doc_id
    has several rows in its group, each of them stays. Other columns are ignored.
    """
    ident = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID))
    texts = docs.select(ident.alias("_id"), normalised(docs[text_col]).alias("_norm")).withColumn("digest", digest(F.col("_norm")))
    salted = texts.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "_norm").agg(F.min("_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "_norm").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    members = checkpointed(texts.select("_id", "digest"))
    narrow = checkpointed(groups.select("digest", "keep", "n"))
    clashes = narrow.groupBy("digest").count().where("count > 1")
    if clashes.isEmpty():
        found = looked_up(members, ["digest"], narrow)
    else:
        found = texts.join(groups, ["digest", "_norm"])
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(real("_id").alias("doc_id"), real("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_id") == F.col("keep")).alias("kept"), "digest")
