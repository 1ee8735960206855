"""The scored portfolio: one row per order in the vocabulary of the credit profile, with a label and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The model's features, in order.
FEATURES = [
    "revolving_utilization", "age", "num_times_30_59_days_late", "debt_ratio", "monthly_income", "num_open_credit_lines",
    "num_times_90_days_late", "num_real_estate_loans", "num_times_60_89_days_late", "num_dependents", "total_delinquency_events",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as Parquet, one file or a directory."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with counters of their line items; orders without any have zeros, unlabelled ones a null label."""
    count = lambda cond: F.count_if(F.expr(cond)).cast("int")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        count("l_returnflag = 'R' AND l_linestatus = 'F'").alias("n30"),
        count("l_returnflag = 'R' AND l_discount >= 0.08").alias("n60"),
        count("l_returnflag = 'R' AND l_discount >= 0.09 AND l_linestatus = 'O'").alias("n90"),
        F.count("*").cast("int").alias("n_lines"),
        count("l_tax >= 0.06").alias("n_re"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n30", "n60", "n90", "n_lines", "n_re"])
    return rows.selectExpr(
        "o_orderkey AS customer_id",
        "CAST(15 + o_custkey % 110 AS INT) AS age",
        "IF(o_custkey % 25 = 0, NULL, CAST(o_orderkey % 6 AS INT)) AS num_dependents",
        "IF(o_orderpriority = '1-URGENT', NULL, o_totalprice / 50) AS monthly_income",
        "CAST(o_orderkey * 37 % 400 AS DOUBLE) / 100 AS debt_ratio",
        "CAST(o_orderkey * 131 % 1200 AS DOUBLE) / 1000 AS revolving_utilization",
        "n_lines AS num_open_credit_lines",
        "n_re AS num_real_estate_loans",
        "IF(o_orderkey % 500 = 0, 98, n30) AS num_times_30_59_days_late",
        "n60 AS num_times_60_89_days_late",
        "n90 AS num_times_90_days_late",
        "n30 + n60 + n90 AS total_delinquency_events",
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey * 31 % 100 < IF(n30 > 0, 12, 4) THEN 1 ELSE 0 END AS target_dlq_2yrs",
        "CAST(o_orderkey * 7919 % 7000 + IF(n30 > 0, 2000, 0) + IF(n90 > 0, 1000, 0) AS DOUBLE) / 10000 AS score",
    )


#: The same view for the SQL side: common table expressions that end in ``scored``.
PORTFOLIO_SQL = """
WITH RECURSIVE li AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 1 ELSE 0 END) AS INT) AS n30,
         CAST(SUM(CASE WHEN l_returnflag='R' AND l_discount >= 0.08 THEN 1 ELSE 0 END) AS INT) AS n60,
         CAST(SUM(CASE WHEN l_returnflag='R' AND l_discount >= 0.09 AND l_linestatus='O' THEN 1 ELSE 0 END) AS INT) AS n90,
         CAST(COUNT(*) AS INT) AS n_lines,
         CAST(SUM(CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END) AS INT) AS n_re
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS customer_id, o_orderstatus, o_orderpriority, o_totalprice, o_custkey,
         COALESCE(n30,0) AS n30, COALESCE(n60,0) AS n60, COALESCE(n90,0) AS n90,
         COALESCE(n_lines,0) AS n_lines, COALESCE(n_re,0) AS n_re
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
scored AS (
  SELECT customer_id,
       CAST(15 + o_custkey % 110 AS INT) AS age,
       CASE WHEN o_custkey % 25 = 0 THEN NULL ELSE CAST(customer_id % 6 AS INT) END AS num_dependents,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice / 50 END AS monthly_income,
       CAST(customer_id * 37 % 400 AS DOUBLE) / 100 AS debt_ratio,
       CAST(customer_id * 131 % 1200 AS DOUBLE) / 1000 AS revolving_utilization,
       n_lines AS num_open_credit_lines, n_re AS num_real_estate_loans,
       CASE WHEN customer_id % 500 = 0 THEN 98 ELSE n30 END AS num_times_30_59_days_late,
       n60 AS num_times_60_89_days_late, n90 AS num_times_90_days_late,
       n30 + n60 + n90 AS total_delinquency_events,
       CASE WHEN o_orderstatus = 'P' THEN NULL
            WHEN customer_id * 31 % 100 < CASE WHEN n30 > 0 THEN 12 ELSE 4 END THEN 1 ELSE 0 END AS target_dlq_2yrs,
       CAST(customer_id * 7919 % 7000 + CASE WHEN n30 > 0 THEN 2000 ELSE 0 END
            + CASE WHEN n90 > 0 THEN 1000 ELSE 0 END AS DOUBLE) / 10000 AS score
  FROM base)
"""


def raw_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The portfolio under the raw file's column names, with the flaws that cleaning has to handle."""
    return portfolio(spark, folder).selectExpr(
        "IF(customer_id % 997 = 0, NULL, customer_id) AS _c0", "target_dlq_2yrs AS SeriousDlqin2yrs",
        "revolving_utilization AS RevolvingUtilizationOfUnsecuredLines", "age", "num_times_30_59_days_late AS `NumberOfTime30-59DaysPastDueNotWorse`",
        "debt_ratio AS DebtRatio", "monthly_income AS MonthlyIncome", "num_open_credit_lines AS NumberOfOpenCreditLinesAndLoans",
        "num_times_90_days_late AS NumberOfTimes90DaysLate", "num_real_estate_loans AS NumberRealEstateLoansOrLines",
        "num_times_60_89_days_late AS `NumberOfTime60-89DaysPastDueNotWorse`", "num_dependents + 0.5D AS NumberOfDependents",
    )
