"""The customer frame: one row per customer from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.config import CleaningSpec

Tables = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def customer_frame(t: Tables) -> DataFrame:
    """Behaviour and value of every customer; the analogue of a wide customer export.

    Each row that crosses the network carries only what its own sum needs: orders by customer give counts, dates and the
    earliest order (ties by order key); order lines, summed by order, find their customer through the orders' two keys; part keys are looked up
    for earliest orders only. All three meet on the customer's key. Customers without orders, nation or region keep
    their row. ``first_sku`` lists all product types of the first order.
    """
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    per_customer = t("orders").groupBy(F.col("o_custkey").alias("a_custkey")).agg(
        F.count("*").cast("double").alias("order_count"),
        F.max("o_orderdate").alias("last_dt"),
        F.avg("o_totalprice").alias("avg_order_value"),
        first.alias("f"))
    # hardly any line of a task shares its order with another: sums made before the shuffle would only be wider than the lines
    lines = t("lineitem").filter("l_orderkey is not null").select(
        "l_orderkey", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").alias("refund")).repartition("l_orderkey")
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("gross"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.sum(F.when(F.col("refund"), 1).otherwise(0)).alias("refunds"))
    value = (
        t("orders").select("o_orderkey", F.col("o_custkey").alias("v_custkey"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("v_custkey").agg(
            F.sum("gross").alias("gross_ltv"),
            F.sum("net").alias("net_ltv"),
            F.sum("refunds").cast("double").alias("refund_count")))
    # the earliest order alone, so that nothing but its keys goes with the parts
    earliest = t("orders").groupBy(F.col("o_custkey").alias("s_custkey")).agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("s_custkey", F.col("f.o_orderkey").alias("first_key"))
    first_sku = (
        earliest.join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("first_key"))
        .select("s_custkey", "l_partkey").distinct()
        .join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("s_custkey").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("first_sku")))
    return (
        t("customer")
        .join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .join(per_customer, F.col("a_custkey") == F.col("c_custkey"), "left")
        .join(value, F.col("v_custkey") == F.col("c_custkey"), "left")
        .join(first_sku, F.col("s_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"), F.col("f.o_orderpriority").alias("first_priority"),
            F.col("f.o_orderstatus").alias("first_status"), "first_sku", "order_count",
            F.datediff(F.lit("2001-08-01").cast("date"), F.col("last_dt").cast("date"))
            .cast("double").alias("days_since_last_order"),
            F.col("c_acctbal").alias("acctbal"), "refund_count", "net_ltv", "avg_order_value",
            "gross_ltv"))


# Lookups for the customer frame's own codes.
SEGMENT_NAMES = {"FURNITURE": "Furniture", "HOUSEHOLD": "Household", "BUILDING": "Building",
                 "MACHINERY": "Machinery"}
SEGMENT_BUCKETS = {"Furniture": "home", "Household": "home", "Building": "trade", "Machinery": "trade"}
TYPE_BUCKETS = {"ECONOMY": "home", "STANDARD": "home", "PROMO": "offer", "MEDIUM": "trade", "LARGE": "trade"}
PRIORITY_CODES = ("2-HIGH", "3-MEDIUM")


def raw_customers(t: Tables) -> DataFrame:
    """The customer frame in the shape of a raw export: flags as text, codes, nulls, a token list."""
    acct = F.col("acctbal")
    return customer_frame(t).select(
        "customer_id",
        F.when(F.col("region") == "ASIA", "no").otherwise("Yes").alias("quiz_taker"),
        F.concat(F.lit(" "), "segment", F.lit(" ")).alias("quiz_result"),
        F.when(F.col("first_status") == "P", "unspecified").otherwise(F.col("first_status")).alias("bm_pattern"),
        F.nullif("region", F.lit("AFRICA")).alias("gi_symptom_cat"),
        F.when(F.col("first_priority") == "5-LOW", "-").otherwise(F.col("first_priority")).alias("primary_goal"),
        F.nullif("first_priority", F.lit("1-URGENT")).alias("ancestor_discount_code"),
        F.when(acct > 5000, " F ").alias("gender"),
        F.when(acct >= 0, (acct > 2500).cast("int")).alias("is_male"),
        "first_sku", "order_count", "days_since_last_order", acct.alias("symptom_count"),
        (F.col("refund_count") / F.col("order_count")).alias("gut_issue_score"),
        F.when(F.col("refund_count") >= 10, 1.0).when(F.col("refund_count").isNotNull(), 0.0).alias("high_stress"),
        "refund_count", "net_ltv", "avg_order_value", "gross_ltv")


def sample_spec() -> CleaningSpec:
    """The cleaning settings that fit ``raw_customers``."""
    return CleaningSpec(name_map=SEGMENT_NAMES, name_to_bucket=SEGMENT_BUCKETS, token_to_bucket=TYPE_BUCKETS,
                        codes=PRIORITY_CODES)
