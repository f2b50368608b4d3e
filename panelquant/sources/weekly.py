"""A weekly supplier panel built from the order tables, in the shape of an asset panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelquant.functions.columns import col
from panelquant.operators.rolling import lag


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (week, supplier). Sums count whole cents, so they do not depend on order."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")

    def exact_sum(name: str) -> Column:
        return F.sum(F.rint(col(name) * 100).cast("bigint")).cast("double") / 100

    weeks = (lineitem
             .groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), "l_suppkey")
             .agg(F.sum("l_quantity").alias("qty"),
                  exact_sum("l_extendedprice").alias("ext"),
                  F.sum(F.when(col("l_returnflag") == "R", F.lit(0.0))
                        .otherwise(col("l_quantity"))).alias("daily_volume"),
                  (exact_sum("l_discount") / F.count("*")).alias("disc"),
                  (exact_sum("l_tax") / F.count("*")).alias("bid_ask_spread")))
    home = col("n_regionkey").isin(0, 1, 2)
    number = col("l_suppkey").cast("string")
    named = (weeks.join(supplier, col("l_suppkey") == col("s_suppkey"))
             .join(nation, col("s_nationkey") == col("n_nationkey"))
             .withColumns({
                 "barrid": F.concat(F.when(home, "US").otherwise("XX"), F.lpad(number, 6, "0")),
                 "iso_country_code": F.when(home, "USA").otherwise(col("n_name")),
                 "price": col("ext") / col("qty"),
                 "predicted_beta": (50 + col("l_suppkey") % 100).cast("double") / 100}))
    change = col("price") / lag("price") - 1
    return named.select(
        "date", "barrid",
        F.when(col("l_suppkey") % 17 == 16, "US999999").otherwise(col("barrid")).alias("rootid"),
        F.concat(F.lit("T"), number).alias("ticker"), "iso_country_code", "price",
        (100 * change).alias("return"), (50 * change).alias("specific_return"),
        (col("l_suppkey") % 10 != 9).alias("in_universe"),
        (1 + 100 * col("disc")).alias("specific_risk"), "daily_volume", "bid_ask_spread",
        (col("price") * col("qty")).alias("market_cap"), "predicted_beta")
