"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import scratch

#: Stands for a null doc_id in join keys, so that such rows still meet themselves; no row may have it as its doc_id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, kd and tk (together the name of a row; repeated rows share it) and text."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("kd"), F.xxhash64(text_of()).alias("tk"), text_of().alias("text"))


def place_of() -> Column:
    """Orders named rows by doc_id, those without one last, and rows that share an id by their text's hash."""
    return F.struct((F.col("kd") == NO_ID).alias("last"), F.col("kd"), F.col("tk"))


def one_of_each(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """docs with one row of each class of classed (kd, tk, label), the first by place_of. Of rows that share doc_id and text
    one stays, by a hash of all its columns, which may be of any type."""
    first = classed.groupBy("label").agg(F.min(place_of()).alias("x")).select("x.kd", "x.tk").distinct()
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("kd"), F.xxhash64(text_of()).alias("tk"), F.struct(*docs.columns).alias("row"))
    return rows.join(first, ["kd", "tk"], "left_semi").groupBy("kd", "tk").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
