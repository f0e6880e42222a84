"""Writing: immutable tables, ledgers that grow, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frozen(df: DataFrame, path: str, partition_by: list[str] | None = None, sort: list[str] | None = None) -> None:
    """SNK-01. Parquet with zstd; an existing path is an error."""
    rows = df.sortWithinPartitions(*sort) if sort else df
    writer = rows.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, schema: T.StructType, widen: bool = False) -> T.StructType:
    """SNK-02. Rows cast to the ledger's schema, missing columns null, appended. Returns the schema written.

    Columns outside the schema are an error, or with `widen` come after its own; older files give null for them
    (see ledger). A column whose values cannot be cast to the schema's type fails the job.
    """
    extra = [c for c in df.columns if c not in schema.names]
    if extra and not widen:
        raise ValueError(f"columns outside the ledger's schema: {extra}")
    schema = T.StructType([*schema.fields, *(T.StructField(c, df.schema[c].dataType) for c in extra)])
    _cast(df, schema).write.mode("append").option("compression", "zstd").parquet(path)
    return schema


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """SNK-02, SO-02. The ledger with the columns of all its files, old ones null where a file lacks them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def append_once(df: DataFrame, path: str, schema: T.StructType, key: str, batch: int = 0) -> None:
    """STR-03. Appends the rows of snapshots (`key`) that no other batch has committed; equal rows of one snapshot count once.

    The committed snapshots are kept beside the ledger, one row each, so a batch reads those and never the ledger.
    Rows and commits of a batch go to a folder of its own, which a repeated batch writes anew: a batch that died
    between the two leaves nothing behind. A null key is one snapshot.
    """
    spark, commits = df.sparkSession, f"{path.rstrip('/')}-commits"
    new = df.select(F.col(key).cast(schema[key].dataType).alias("_key")).distinct()
    if exists(spark, commits):
        done = spark.read.schema(f"_key {schema[key].dataType.simpleString()}, batch long").parquet(commits).where(F.col("batch") != batch)
        new = new.join(done.select(F.col("_key").alias("_done")), F.col("_key").eqNullSafe(F.col("_done")), "left_anti")
    rows = _cast(df, schema).dropDuplicates()
    rows = rows.join(new, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/batch={batch}")
    new.write.mode("overwrite").parquet(f"{commits}/batch={batch}")


def csv_report(df: DataFrame, path: str, order: list[str]) -> None:
    """SNK-03. One sorted CSV with a header, for reports of a few rows."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def ndjson(df: DataFrame, path: str) -> None:
    """SNK-04. A JSON object a line."""
    df.write.mode("errorifexists").json(path)
