"""Cleaning of raw profiles: quarantine instead of dropping, one current row per key. Batch and stream use the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Raw column names of the public file, and the cleaned table's.
SILVER_NAMES = {
    "_c0": "customer_id",
    "SeriousDlqin2yrs": "target_default_2yrs",
    "RevolvingUtilizationOfUnsecuredLines": "revolving_utilization_unsecured",
    "NumberOfTime30-59DaysPastDueNotWorse": "num_times_30_59_days_late",
    "DebtRatio": "debt_ratio",
    "MonthlyIncome": "monthly_income",
    "NumberOfOpenCreditLinesAndLoans": "num_open_credit_lines_and_loans",
    "NumberOfTimes90DaysLate": "num_times_90_days_late",
    "NumberRealEstateLoansOrLines": "num_real_estate_loans_or_lines",
    "NumberOfTime60-89DaysPastDueNotWorse": "num_times_60_89_days_late",
    "NumberOfDependents": "num_dependents",
}
LATE_COUNTERS = ["num_times_30_59_days_late", "num_times_60_89_days_late", "num_times_90_days_late"]
#: Valid ages, both ends included; codes from this value in a late counter aren't counts.
AGES, LATE_CODE = (18, 120), 96


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that lists the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def rename_columns(df: DataFrame) -> DataFrame:
    """Rename the raw columns that are present."""
    return df.withColumnsRenamed(SILVER_NAMES)


def clean(df: DataFrame) -> DataFrame:
    """Renamed, typed and flagged rows. Only rows without a key go; an impossible age becomes null and the row stays."""
    rows = rename_columns(df).where(F.col("customer_id").isNotNull())
    income = F.col("monthly_income")
    return rows.withColumns({
        "is_monthly_income_null": F.when(income.isNull(), 1).otherwise(0),
        "monthly_income": income.try_cast("double"),
        "num_dependents": F.coalesce(F.col("num_dependents").try_cast("int"), F.lit(0)),
        "age": F.when(F.col("age").between(*AGES), F.col("age")),
        "has_delinquency_outlier": F.when(F.greatest(*LATE_COUNTERS) >= LATE_CODE, 1).otherwise(0),
    })


def latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the first by ``newest``, which should leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upserted(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with ``batch``'s rows in place of those of equal key, and the new ones added."""
    return batch.unionByName(current.join(batch.select(*keys), keys, "left_anti"))
