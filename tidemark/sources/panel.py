"""A daily panel made from order lines: one entity for each nation, one bar for each ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, asset_class, sector, date, open, high, low, close, adj_close, volume. Open and close are the first and
    last unit price of the day in the lines' total order; the dimension joins are broadcast where size allows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", F.col("l_shipdate").cast("date").alias("date"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    px = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    joined = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    day = joined.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("asset_class"), "date").agg(
        F.min_by(px, order).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, order).alias("close"),
        F.max_by(px * (1 - F.col("l_discount")), order).alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )
    return day.withColumn("sector", F.concat(F.lit("sector_"), F.col("asset_class"))).select("ticker", "asset_class", "sector", "date", "open", "high", "low", "close", "adj_close", "volume")
