"""Fixture rows: mappings of a source-to-report star schema, and small graphs with known traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import ids

# Fixed values: (source column, target column, type) of the sample warehouse.
MAPPINGS = [
    ("SRC_CUSTOMER.first_name", "STG_CUSTOMER.full_name", "CALCULATION"),
    ("SRC_CUSTOMER.last_name", "STG_CUSTOMER.full_name", "CALCULATION"),
    ("SRC_CUSTOMER.customer_id", "STG_CUSTOMER.customer_id", "DIRECT"),
    ("SRC_CUSTOMER.email", "STG_CUSTOMER.email_address", "DIRECT"),
    ("SRC_CUSTOMER.phone", "STG_CUSTOMER.phone_number", "DIRECT"),
    ("SRC_CUSTOMER.created_date", "STG_CUSTOMER.customer_since", "DIRECT"),
    ("SRC_PRODUCT.product_id", "STG_PRODUCT.product_id", "DIRECT"),
    ("SRC_PRODUCT.product_name", "STG_PRODUCT.product_name", "DIRECT"),
    ("SRC_PRODUCT.category", "STG_PRODUCT.category_name", "DIRECT"),
    ("SRC_PRODUCT.unit_price", "STG_PRODUCT.unit_price", "DIRECT"),
    ("SRC_PRODUCT.cost_price", "STG_PRODUCT.cost_price", "DIRECT"),
    ("SRC_PRODUCT.unit_price", "STG_PRODUCT.profit_margin", "CALCULATION"),
    ("SRC_PRODUCT.cost_price", "STG_PRODUCT.profit_margin", "CALCULATION"),
    ("SRC_SALES.transaction_id", "STG_SALES.transaction_id", "DIRECT"),
    ("SRC_SALES.customer_id", "STG_SALES.customer_id", "DIRECT"),
    ("SRC_SALES.product_id", "STG_SALES.product_id", "DIRECT"),
    ("SRC_SALES.store_id", "STG_SALES.store_id", "DIRECT"),
    ("SRC_SALES.quantity", "STG_SALES.quantity", "DIRECT"),
    ("SRC_SALES.sale_amount", "STG_SALES.gross_amount", "DIRECT"),
    ("SRC_SALES.discount_amount", "STG_SALES.discount_amount", "DIRECT"),
    ("SRC_SALES.sale_amount", "STG_SALES.net_amount", "CALCULATION"),
    ("SRC_SALES.discount_amount", "STG_SALES.net_amount", "CALCULATION"),
    ("SRC_SALES.sale_date", "STG_SALES.sale_date", "DIRECT"),
    ("STG_CUSTOMER.customer_key", "DIM_CUSTOMER.customer_sk", "DIRECT"),
    ("STG_CUSTOMER.customer_id", "DIM_CUSTOMER.customer_id", "DIRECT"),
    ("STG_CUSTOMER.full_name", "DIM_CUSTOMER.full_name", "DIRECT"),
    ("STG_CUSTOMER.email_address", "DIM_CUSTOMER.email_address", "DIRECT"),
    ("STG_CUSTOMER.phone_number", "DIM_CUSTOMER.phone_number", "DIRECT"),
    ("STG_CUSTOMER.customer_since", "DIM_CUSTOMER.customer_since", "DIRECT"),
    ("STG_PRODUCT.product_key", "DIM_PRODUCT.product_sk", "DIRECT"),
    ("STG_PRODUCT.product_id", "DIM_PRODUCT.product_id", "DIRECT"),
    ("STG_PRODUCT.product_name", "DIM_PRODUCT.product_name", "DIRECT"),
    ("STG_PRODUCT.category_name", "DIM_PRODUCT.category_name", "DIRECT"),
    ("STG_PRODUCT.unit_price", "DIM_PRODUCT.unit_price", "DIRECT"),
    ("STG_PRODUCT.cost_price", "DIM_PRODUCT.cost_price", "DIRECT"),
    ("STG_PRODUCT.profit_margin", "DIM_PRODUCT.profit_margin", "DIRECT"),
    ("SRC_STORE.store_id", "DIM_STORE.store_id", "DIRECT"),
    ("SRC_STORE.store_name", "DIM_STORE.store_name", "DIRECT"),
    ("SRC_STORE.region", "DIM_STORE.region", "DIRECT"),
    ("SRC_STORE.city", "DIM_STORE.city", "DIRECT"),
    ("SRC_STORE.state", "DIM_STORE.state", "DIRECT"),
    ("SRC_STORE.open_date", "DIM_STORE.open_date", "DIRECT"),
    ("STG_SALES.sales_key", "FACT_SALES.sales_sk", "DIRECT"),
    ("DIM_DATE.date_sk", "FACT_SALES.date_sk", "JOIN"),
    ("DIM_CUSTOMER.customer_sk", "FACT_SALES.customer_sk", "JOIN"),
    ("DIM_PRODUCT.product_sk", "FACT_SALES.product_sk", "JOIN"),
    ("DIM_STORE.store_sk", "FACT_SALES.store_sk", "JOIN"),
    ("STG_SALES.transaction_id", "FACT_SALES.transaction_id", "DIRECT"),
    ("STG_SALES.quantity", "FACT_SALES.quantity", "DIRECT"),
    ("STG_SALES.gross_amount", "FACT_SALES.gross_amount", "DIRECT"),
    ("STG_SALES.discount_amount", "FACT_SALES.discount_amount", "DIRECT"),
    ("STG_SALES.net_amount", "FACT_SALES.net_amount", "DIRECT"),
    ("STG_SALES.quantity", "FACT_SALES.cost_amount", "CALCULATION"),
    ("DIM_PRODUCT.cost_price", "FACT_SALES.cost_amount", "CALCULATION"),
    ("STG_SALES.net_amount", "FACT_SALES.profit_amount", "CALCULATION"),
    ("FACT_SALES.cost_amount", "FACT_SALES.profit_amount", "CALCULATION"),
    ("FACT_SALES.date_sk", "FACT_SALES_DAILY.date_sk", "AGGREGATION"),
    ("FACT_SALES.store_sk", "FACT_SALES_DAILY.store_sk", "AGGREGATION"),
    ("FACT_SALES.product_sk", "FACT_SALES_DAILY.product_sk", "AGGREGATION"),
    ("FACT_SALES.quantity", "FACT_SALES_DAILY.total_quantity", "AGGREGATION"),
    ("FACT_SALES.gross_amount", "FACT_SALES_DAILY.total_gross_amount", "AGGREGATION"),
    ("FACT_SALES.discount_amount", "FACT_SALES_DAILY.total_discount_amount", "AGGREGATION"),
    ("FACT_SALES.net_amount", "FACT_SALES_DAILY.total_net_amount", "AGGREGATION"),
    ("FACT_SALES.cost_amount", "FACT_SALES_DAILY.total_cost_amount", "AGGREGATION"),
    ("FACT_SALES.profit_amount", "FACT_SALES_DAILY.total_profit_amount", "AGGREGATION"),
    ("FACT_SALES.sales_sk", "FACT_SALES_DAILY.transaction_count", "AGGREGATION"),
    ("FACT_SALES_DAILY.store_sk", "RPT_MONTHLY_SALES.store_sk", "AGGREGATION"),
    ("DIM_STORE.store_name", "RPT_MONTHLY_SALES.store_name", "JOIN"),
    ("DIM_STORE.region", "RPT_MONTHLY_SALES.region", "JOIN"),
    ("DIM_DATE.year_number", "RPT_MONTHLY_SALES.year_month", "CALCULATION"),
    ("DIM_DATE.month_number", "RPT_MONTHLY_SALES.year_month", "CALCULATION"),
    ("FACT_SALES_DAILY.total_net_amount", "RPT_MONTHLY_SALES.total_sales", "AGGREGATION"),
    ("FACT_SALES_DAILY.total_profit_amount", "RPT_MONTHLY_SALES.total_profit", "AGGREGATION"),
    ("FACT_SALES_DAILY.transaction_count", "RPT_MONTHLY_SALES.total_transactions", "AGGREGATION"),
    ("FACT_SALES_DAILY.total_net_amount", "RPT_MONTHLY_SALES.avg_transaction_value", "CALCULATION"),
    ("FACT_SALES_DAILY.transaction_count", "RPT_MONTHLY_SALES.avg_transaction_value", "CALCULATION"),
]


def mappings(databases: DataFrame) -> DataFrame:
    """source_path, target_path, transformation_type, confidence_score, provenance_id of each mapping in each of ``databases`` (column database)."""
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("source", "target", "transformation_type"), m)]) for m in MAPPINGS])).alias("m")
    path = lambda side: F.replace(F.concat(F.lit("{DATABASE}."), F.col(f"m.{side}")), F.lit("{DATABASE}"), F.col("database"))
    m = databases.select("database", each).select(path("source").alias("source_path"), path("target").alias("target_path"), "m.transformation_type", F.lit(1).cast("decimal(3,2)").alias("confidence_score"))
    return m.withColumn("provenance_id", ids.provenance_id(F.col("source_path"), F.col("target_path")))


MAPPING_SQL = (
    "SELECT *, substr(md5(source_path || '->' || target_path), 1, 24) AS provenance_id FROM (SELECT n_name || '.' || s AS source_path, n_name || '.' || t AS target_path, kind AS transformation_type, CAST(1 AS DECIMAL(3, 2)) AS confidence_score FROM nation, (VALUES "
    + ", ".join(str(r) for r in MAPPINGS)
    + ") AS v(s, t, kind))"
)

# Table -> edges "ab" for col_a -> col_b, or names; and what a walk from a column gives:
# (start, direction, depth, edges by the edge rule, paths, edges by the node rule).
PATTERNS = {
    "CYCLE_TEST": ("ab ba", ("a", "downstream", 5, 2, 2, 1)),
    "MCYCLE_TEST": ("ab bc cd da", ("a", "downstream", 5, 4, 4, 3)),
    "CYCLE5_TEST": ("ab bc cd de ea", ("a", "downstream", 5, 5, 5, 4)),
    "DIAMOND": ("ab ac bd cd", ("d", "upstream", 5, 4, 4, 4)),
    "NESTED_DIAMOND": ("ab ac bd cd de df eg fg", ("g", "upstream", 5, 8, 12, 8)),
    "WIDE_DIAMOND": ("ab ac ad ae bf cf df ef", ("f", "upstream", 5, 8, 8, 8)),
    "CHAIN_TEST": ("ed dc cb ba", ("a", "upstream", 10, 4, 4, 4)),
    "COMBINED_CYCLE_DIAMOND": ("ab ba ac cd ad", ("d", "upstream", 5, 5, 7, 4)),
    "COMBINED_FAN": ("ab ac ad be ce de", ("e", "upstream", 5, 6, 6, 6)),
    "FANOUT10_TEST": (" ".join(f"0{k}" for k in range(1, 10)) + " 0x", ("0", "downstream", 5, 10, 10, 10)),
    "FANIN10_TEST": (" ".join(f"{k}0" for k in range(1, 10)) + " x0", ("0", "upstream", 5, 10, 10, 10)),
}


def pattern_edges(spark: SparkSession) -> DataFrame:
    """All patterns as active edges in the shape that the traversals take; each pattern is a table of its own."""
    rows = [(f"{t}:{e}", f"demo.{t}", e[0], f"demo.{t}", e[1], "DIRECT", "Y") for t, (edges, _) in PATTERNS.items() for e in edges.split()]
    df = spark.createDataFrame(rows, "provenance_id string, source_dataset string, source_field string, target_dataset string, target_field string, transformation_type string, is_active string")
    return df.withColumns({"src": ids.node_id(F.col("source_dataset"), F.col("source_field")), "tgt": ids.node_id(F.col("target_dataset"), F.col("target_field"))})
