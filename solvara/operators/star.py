"""Star schema: labelled and unlabelled rows in one table, a customer dimension and a profile fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL = "target_default_2yrs"
#: Added to the ids of the unlabelled population, whose file numbers its rows from 1 too.
SCORING_OFFSET = 10_000_000

# Names of the star schema.
GOLD_NAMES = {
    "revolving_utilization_unsecured": "revolving_utilization",
    "num_open_credit_lines_and_loans": "num_open_credit_lines",
    "num_real_estate_loans_or_lines": "num_real_estate_loans",
    LABEL: "target_dlq_2yrs",
}
DELINQUENCY = ["num_times_30_59_days_late", "num_times_60_89_days_late", "num_times_90_days_late"]


def check_columns(left: DataFrame, right: DataFrame) -> None:
    """Raise unless both have the same columns."""
    if odd := set(left.columns) ^ set(right.columns):
        raise ValueError(f"columns in one population only: {sorted(odd)}")


def populations(training: DataFrame, scoring: DataFrame | None) -> DataFrame:
    """Union by name; unlabelled rows get a typed null label and offset ids."""
    if scoring is None:
        return training
    if LABEL not in scoring.columns:
        scoring = scoring.withColumn(LABEL, F.lit(None).cast(training.schema[LABEL].dataType))
    check_columns(training, scoring)
    return training.unionByName(scoring.withColumn("customer_id", F.col("customer_id") + SCORING_OFFSET))


def duplicate_keys(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, key: str = "customer_id") -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{key} isn't unique")


def dim_customer(df: DataFrame) -> DataFrame:
    """Customer attributes, one row per id; of several the least row stays, so that reruns agree."""
    rows = df.groupBy("customer_id").agg(F.min(F.struct("age", "num_dependents")).alias("r"))
    return rows.select("customer_id", "r.age", "r.num_dependents")


def fct_credit_profile(df: DataFrame) -> DataFrame:
    """The profile's columns and the sum of the late counters, null if any of them is."""
    late = F.col(DELINQUENCY[0]) + F.col(DELINQUENCY[1]) + F.col(DELINQUENCY[2])
    return df.withColumnsRenamed(GOLD_NAMES).withColumn("total_delinquency_events", late).select(
        "customer_id", "monthly_income", "debt_ratio", "revolving_utilization", "num_open_credit_lines", "num_real_estate_loans", *DELINQUENCY, "total_delinquency_events", "target_dlq_2yrs"
    )


def cohort(fct: DataFrame, dim: DataFrame, labelled: bool | None = None) -> DataFrame:
    """Profiles with their customer; labelled or unlabelled rows only if asked for."""
    rows = fct.join(dim, "customer_id")
    return rows if labelled is None else rows.where(F.col("target_dlq_2yrs").isNotNull() if labelled else F.col("target_dlq_2yrs").isNull())


def hash_bucket(key: str = "customer_id"):
    """A bucket from 0 to 99 by multiplication, the same in any SQL engine."""
    return F.pmod(F.col(key).cast("long") * 2654435761, F.lit(100))
