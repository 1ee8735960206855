"""Queries of the portfolio engine by operator, with their SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators import boosting, clean, drift, fairness, hypotheses, logit, models, profile, ranking, sketches, star, thresholds, validation
from solvara.sources import dictionary, tables
from solvara.sources.portfolio import FEATURES, PORTFOLIO_SQL, portfolio, raw_profiles, table
from solvara.storage import shared_dir, staged
from solvara.streaming import queries as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LABEL, SCORE, KEY = "target_dlq_2yrs", "score", "customer_id"

#: Common table expressions after ``scored``: labelled rows, and the cleaned table.
LABELLED = PORTFOLIO_SQL + ", lab AS (SELECT *, target_dlq_2yrs AS y FROM scored WHERE target_dlq_2yrs IS NOT NULL)\n"
CLEAN = PORTFOLIO_SQL + """, silver AS (
  SELECT customer_id, target_dlq_2yrs AS target_default_2yrs, revolving_utilization AS revolving_utilization_unsecured,
         CASE WHEN age BETWEEN 18 AND 120 THEN age END AS age, num_times_30_59_days_late, debt_ratio, monthly_income,
         num_open_credit_lines AS num_open_credit_lines_and_loans, num_times_90_days_late,
         num_real_estate_loans AS num_real_estate_loans_or_lines, num_times_60_89_days_late,
         CAST(coalesce(num_dependents, 0) AS INT) AS num_dependents,
         CAST(monthly_income IS NULL AS INT) AS is_monthly_income_null,
         CASE WHEN num_times_30_59_days_late >= 96 OR num_times_60_89_days_late >= 96 OR num_times_90_days_late >= 96 THEN 1 ELSE 0 END AS has_delinquency_outlier
  FROM scored WHERE customer_id % 997 <> 0)
"""
TWO_MODELS = LABELLED + ", m AS (SELECT 'score' AS model, customer_id, y, score AS p FROM lab UNION ALL SELECT 'utilisation', customer_id, y, revolving_utilization / 1.2 FROM lab)\n"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, and its SQL; its double columns are rounded."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def silver(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean(raw_profiles(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio(spark, folder).where(F.col(LABEL).isNotNull())


def two_models(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows scored by two models: the score, and utilisation alone."""
    items = F.array(F.struct(F.lit("score").alias("model"), F.col("score").alias("p")), F.struct(F.lit("utilisation").alias("model"), (F.col("revolving_utilization") / 1.2).alias("p")))
    return labelled(spark, folder).select(KEY, LABEL, F.inline(items))


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows as a labelled and an unlabelled table, ids of the latter from 1 too."""
    rows = silver(spark, folder)
    return rows.where("target_default_2yrs is not null"), rows.where("target_default_2yrs is null").drop("target_default_2yrs")


COMBINED = CLEAN + """, both_ AS (
  SELECT * FROM silver WHERE target_default_2yrs IS NOT NULL
  UNION ALL BY NAME SELECT * REPLACE (customer_id + 10000000 AS customer_id) FROM silver WHERE target_default_2yrs IS NULL)
"""


# Cleaning and star schema


@query("p1_clean_silver", CLEAN + "SELECT * REPLACE (round(revolving_utilization_unsecured, 6) AS revolving_utilization_unsecured, round(debt_ratio, 6) AS debt_ratio, round(monthly_income, 6) AS monthly_income) FROM silver")
def _(spark, folder):
    return silver(spark, folder)


@query("p10_total_delinquency", COMBINED + "SELECT customer_id, num_times_30_59_days_late + num_times_60_89_days_late + num_times_90_days_late AS total_delinquency_events FROM both_")
def _(spark, folder):
    return star.fct_credit_profile(star.populations(*halves(spark, folder))).select(KEY, "total_delinquency_events")


@query("p11_dim_customer", COMBINED + "SELECT customer_id, age, num_dependents FROM both_")
def _(spark, folder):
    return star.dim_customer(star.populations(*halves(spark, folder)))


@query("p12_fct_credit_profile", COMBINED + """
SELECT customer_id, round(monthly_income, 6) AS monthly_income, round(debt_ratio, 6) AS debt_ratio, round(revolving_utilization_unsecured, 6) AS revolving_utilization,
       num_open_credit_lines_and_loans AS num_open_credit_lines, num_real_estate_loans_or_lines AS num_real_estate_loans,
       num_times_30_59_days_late, num_times_60_89_days_late, num_times_90_days_late,
       num_times_30_59_days_late + num_times_60_89_days_late + num_times_90_days_late AS total_delinquency_events,
       target_default_2yrs AS target_dlq_2yrs FROM both_""")
def _(spark, folder):
    return star.fct_credit_profile(star.populations(*halves(spark, folder)))


@query("u1_union_populations", COMBINED + "SELECT target_default_2yrs IS NULL AS unlabelled, CAST(count(*) AS BIGINT) AS n, min(customer_id) AS first_id, max(customer_id) AS last_id FROM both_ GROUP BY 1")
def _(spark, folder):
    rows = star.populations(*halves(spark, folder))
    return rows.groupBy(F.col("target_default_2yrs").isNull().alias("unlabelled")).agg(F.count("*").alias("n"), F.min(KEY).alias("first_id"), F.max(KEY).alias("last_id"))


@query("u2_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").distinct()


@query("u2_distinct_by_digest", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS shipped FROM lineitem")
def _(spark, folder):
    return profile.distinct_rows_by_digest(table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("string").alias("shipped")))


@query("a8_duplicate_ids", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, folder):
    return star.duplicate_keys(table(spark, folder, "lineitem"), "l_orderkey")


@query("a9_deterministic_dedup", "SELECT l_partkey AS customer_id, r.age, r.num_dependents FROM (SELECT l_partkey, min({'age': l_linenumber, 'num_dependents': l_suppkey}) AS r FROM lineitem GROUP BY l_partkey)")
def _(spark, folder):
    return star.dim_customer(table(spark, folder, "lineitem").select(F.col("l_partkey").alias(KEY), F.col("l_linenumber").alias("age"), F.col("l_suppkey").alias("num_dependents")))


def _star(spark, folder):
    rows = star.populations(*halves(spark, folder))
    return star.fct_credit_profile(rows), star.dim_customer(rows)


@query("j1_cohort", COMBINED + "SELECT customer_id, age, num_dependents, round(monthly_income, 6) AS monthly_income, target_default_2yrs AS target_dlq_2yrs FROM both_")
def _(spark, folder):
    return star.cohort(*_star(spark, folder)).select(KEY, "age", "num_dependents", "monthly_income", LABEL)


@query("k4_bucketed_cohort", ORACLE_SQL["j1_cohort"])
def _(spark, folder):
    """Dimension and fact as tables bucketed on the customer, replaced once, and joined without a shuffle."""
    name = f"solvara_{uuid.uuid4().hex}"
    tables.ensure_database(spark, name, shared_dir(spark))
    for _ in range(2):
        for part, df in zip(("fct", "dim"), _star(spark, folder)):
            tables.write_bucketed(df, f"{name}.{part}", KEY, 8)
    return star.cohort(spark.table(f"{name}.fct"), spark.table(f"{name}.dim")).select(KEY, "age", "num_dependents", "monthly_income", LABEL)


@query("j2_unlabelled_cohort", COMBINED + "SELECT customer_id, age, round(debt_ratio, 6) AS debt_ratio FROM both_ WHERE target_default_2yrs IS NULL")
def _(spark, folder):
    return star.cohort(*_star(spark, folder), labelled=False).select(KEY, "age", "debt_ratio")


@query("j3_upsert", "WITH cur AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM new UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) FROM cur WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return clean.upserted(orders.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"])


@query("w1_latest_row", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, folder):
    return clean.latest(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("p15_population_split", PORTFOLIO_SQL + "SELECT target_dlq_2yrs IS NULL AS scoring, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1")
def _(spark, folder):
    return portfolio(spark, folder).groupBy(F.col(LABEL).isNull().alias("scoring")).agg(F.count("*").alias("n"))


@query("p16_hash_sample", LABELLED + "SELECT customer_id, CAST(customer_id::HUGEINT * 2654435761 % 100 AS BIGINT) AS bucket FROM lab WHERE customer_id::HUGEINT * 2654435761 % 100 < 20")
def _(spark, folder):
    return labelled(spark, folder).select(KEY, star.hash_bucket().alias("bucket")).where("bucket < 20")


@query("p17_finite_labels", LABELLED + "SELECT customer_id, CAST(y AS INT) AS y FROM lab")
def _(spark, folder):
    y = F.col(LABEL).cast("double")
    return portfolio(spark, folder).where(y.isNotNull() & ~F.isnan(y)).select(KEY, y.cast("int").alias("y"))


@query("p19_status", PORTFOLIO_SQL + "SELECT CASE WHEN target_dlq_2yrs = 1 THEN 'Inadimplente (1)' ELSE 'Adimplente (0)' END AS status, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1")
def _(spark, folder):
    return portfolio(spark, folder).groupBy(F.when(F.col(LABEL) == 1, "Inadimplente (1)").otherwise("Adimplente (0)").alias("status")).agg(F.count("*").alias("n"))


@query("s6_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("f14_route_by_name", "SELECT CASE WHEN contains(lower(p_name), 'training') THEN 'training' WHEN contains(lower(p_name), 'test') THEN 'scoring' END AS dataset, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '-Training.csv' WHEN 1 THEN '-TEST.csv' ELSE '.csv' END AS p_name FROM part) GROUP BY 1")
def _(spark, folder):
    from solvara.sources.landing import dataset_of

    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "-Training.csv").when(F.col("p_partkey") % 3 == 1, "-TEST.csv").otherwise(".csv"))
    return table(spark, folder, "part").groupBy(dataset_of(name).alias("dataset")).agg(F.count("*").alias("n"))


@query("s7_optional_tables", "SELECT r_name AS name, 'there' AS found FROM region UNION ALL SELECT 'absent', 'not there'")
def _(spark, folder):
    """A table of the catalogue that is there, and one that isn't."""
    name = f"solvara_{uuid.uuid4().hex}"
    tables.ensure_database(spark, name, shared_dir(spark))
    tables.overwrite(table(spark, folder, "region").select(F.col("r_name").alias("name")), f"{name}.region")
    there, absent = (tables.optional_table(spark, f"{name}.{t}") for t in ("region", "absent"))
    gone = spark.createDataFrame([("absent", "not there")] if absent is None else [], "name string, found string")
    return there.select("name", F.lit("there").alias("found")).union(gone)


@query("k7_history_gains_columns", "SELECT o_orderkey, o_custkey, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def _(spark, folder):
    """A history whose second append lacks a column and brings a new one."""
    name = f"solvara_{uuid.uuid4().hex}"
    tables.ensure_database(spark, name, shared_dir(spark))
    orders = table(spark, folder, "orders")
    tables.append_history(orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), f"{name}.history")
    tables.append_history(orders.where("o_orderkey % 2 = 1").select("o_orderpriority", "o_orderkey"), f"{name}.history")
    return spark.table(f"{name}.history")


_DOCUMENTED = [("nation", "n_nationkey", False), ("nation", "n_name", False), ("nation", "n_flag", False), ("nation", "n_anthem", True), ("region", "r_regionkey", False), ("region", "r_name", False), ("absent", "x", False)]


@query("c1_dictionary_audit", "WITH d AS (SELECT unnest([" + ", ".join(f"{{'t': '{t}', 'c': '{c}', 'o': {str(o).lower()}}}" for t, c, o in _DOCUMENTED) + """], recursive := true)),
k AS (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('nation', 'region') AND column_name <> 'r_comment')
SELECT t AS table_name, c AS column_name, 'undocumented' AS finding FROM k ANTI JOIN d USING (t, c)
UNION ALL SELECT t, c, 'missing' FROM d WHERE NOT o AND t IN (SELECT t FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.t = d.t AND k.c = d.c)""")
def _(spark, folder):
    """The dictionary's audit over two given tables of the catalogue and one that isn't there."""
    name = f"solvara_{uuid.uuid4().hex}"
    tables.ensure_database(spark, name, shared_dir(spark))
    for t in ("nation", "region"):
        tables.overwrite(table(spark, folder, t), f"{name}.{t}")
    known = spark.createDataFrame([(f"{name}.{t}", c, f"{c} of {t}", "given", o) for t, c, o in _DOCUMENTED], dictionary.DICTIONARY)
    dictionary.apply_all(spark, known, {f"{name}.{t}": f"the table {t}" for t in ("nation", "region", "absent")})
    found = dictionary.coverage(known, dictionary.table_columns(spark, [f"{name}.{t}" for t in ("nation", "region", "absent")]), hidden=("r_comment",))
    return found.withColumn("table_name", F.element_at(F.split("table_name", r"\."), -1))


# Profiles


def _per_column(columns: list[str], expression: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {expression.format(c=c)} FROM {source}" for c in columns)


PROFILED = ["customer_id", "age", "num_dependents", "monthly_income", "debt_ratio", "target_dlq_2yrs", "score"]
TYPES = {"customer_id": "bigint", "age": "int", "num_dependents": "int", "target_dlq_2yrs": "int"}


@query("a1_null_completeness", PORTFOLIO_SQL + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{TYPES.get(c, 'double')}' AS data_type, CAST(count(*) - count({c}) AS BIGINT) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_null FROM scored" for c in PROFILED))
def _(spark, folder):
    return profile.completeness(portfolio(spark, folder).select(PROFILED))


@query("a2_duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(100.0 * sum(n - 1) / sum(n), 2) AS pct_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(spark, folder):
    return profile.duplicate_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


@query("a2_duplicates_by_digest", "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(100.0 * sum(n - 1) / sum(n), 2) AS pct_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)")
def _(spark, folder):
    return profile.duplicate_rows_by_digest(table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("a3_duplicate_keys", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, folder):
    return profile.duplicated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a3_duplicate_sample", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY l_orderkey, l_linenumber LIMIT 5")
def _(spark, folder):
    return profile.duplicated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).orderBy("l_orderkey", "l_linenumber").limit(5)


@query("a4_cardinality", PORTFOLIO_SQL + _per_column(PROFILED, "CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(100.0 * count(DISTINCT {c}) / count(*), 2) AS pct_distinct", "scored"))
def _(spark, folder):
    return profile.cardinality(portfolio(spark, folder).select(PROFILED), exact=True)


NUMERIC = ["age", "monthly_income", "debt_ratio", "revolving_utilization", "num_open_credit_lines"]
SUMMARY_SQL = "CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max"


@query("a5_numeric_summary", PORTFOLIO_SQL + _per_column(NUMERIC, SUMMARY_SQL, "scored"))
def _(spark, folder):
    return profile.numeric_summary(portfolio(spark, folder), [*NUMERIC, "not_there"], exact=True)


SKETCHED = ["customer_id", "age", "monthly_income", "debt_ratio"]


@query("a5_sketched_profile", PORTFOLIO_SQL + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_null, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, true AS distinct_is_near, true AS median_is_near FROM scored" for c in SKETCHED))
def _(spark, folder):
    """Five parts of the portfolio stored as days, one of them twice, and merged: exact figures, and whether the estimates are near.

    Near is 5 % for distinct values, and a share of 0.5 +- 0.03 of values up to the median.
    """
    rows, path = portfolio(spark, folder).select(SKETCHED), shared_dir(spark) + "/sketches"
    for day in (0, 1, 2, 2, 3, 4):
        sketches.store_day(rows.where(F.col(KEY) % 5 == day), path, f"2024-01-0{day + 1}")
    found = staged(sketches.merged(spark, path))
    medians = {r.column_name: r.p50 for r in found.collect()}  # a row a column
    checks = [F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("d"), (F.count_if(F.col(c) < medians[c]) / F.count(c)).alias("under"), (F.count_if(F.col(c) <= medians[c]) / F.count(c)).alias("up")) for c in SKETCHED]
    near = rows.agg(F.array(*checks).alias("c")).select(F.inline("c"))
    both = found.join(F.broadcast(near), "column_name")
    return both.select("column_name", "n", "n_null", "mean", "std", "min", "max", (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d")).alias("distinct_is_near"), ((F.col("under") <= 0.53) & (F.col("up") >= 0.47)).alias("median_is_near"))


@query("a6_label_distribution", PORTFOLIO_SQL + "SELECT target_dlq_2yrs, CAST(count(*) AS BIGINT) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM scored GROUP BY 1")
def _(spark, folder):
    return profile.distribution(portfolio(spark, folder), LABEL)


@query("a7_quality_flags", CLEAN + "SELECT CAST(sum(is_monthly_income_null) AS BIGINT) AS n_income_null, CAST(sum(has_delinquency_outlier) AS BIGINT) AS n_outlier, CAST(count(*) - count(age) AS BIGINT) AS n_age_quarantined FROM silver")
def _(spark, folder):
    return profile.quality_flags(silver(spark, folder))


@query("a10_feature_nulls", PORTFOLIO_SQL + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_null FROM scored" for c in FEATURES) + ") WHERE n_null > 0")
def _(spark, folder):
    return profile.completeness(portfolio(spark, folder), FEATURES).where("n_null > 0").drop("data_type")


@query("a11_score_summary", PORTFOLIO_SQL + "SELECT round(avg(CASE WHEN score >= 0.45 THEN 1.0 ELSE 0.0 END), 6) AS denial_rate, s.* FROM scored, (SELECT " + SUMMARY_SQL.format(c="score") + " FROM scored WHERE target_dlq_2yrs IS NULL) s WHERE target_dlq_2yrs IS NULL GROUP BY ALL")
def _(spark, folder):
    rows = portfolio(spark, folder).where(F.col(LABEL).isNull())
    denied = rows.agg(F.avg((rules.decision(F.col(SCORE)) == "negado").cast("double")).alias("denial_rate"))
    return rules.beside(denied, profile.numeric_summary(rows, [SCORE], exact=True).drop("column_name"))


@query("a13_null_labels", PORTFOLIO_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(target_dlq_2yrs) AS BIGINT) AS n_unlabelled FROM scored")
def _(spark, folder):
    return portfolio(spark, folder).agg(F.count("*").alias("n_rows"), F.count_if(F.col(LABEL).isNull()).alias("n_unlabelled"))


@query("a14_class_balance", PORTFOLIO_SQL + "SELECT round(avg(target_dlq_2yrs), 6) AS positive_rate, round((1 - avg(target_dlq_2yrs)) / avg(target_dlq_2yrs), 6) AS scale_pos_weight, CAST(count(*) - count(target_dlq_2yrs) AS BIGINT) AS n_unlabelled FROM scored")
def _(spark, folder):
    return profile.class_balance(portfolio(spark, folder), LABEL)


_NUM = " UNION ALL ".join(f"SELECT 'numeric' AS section, '{c}' AS item, unnest(['n','mean','std','min','p25','p50','p75','max']) AS measure, unnest([CAST(count({c}) AS DOUBLE), avg({c}), stddev_samp({c}), min({c}), quantile_cont(CAST({c} AS DOUBLE), 0.25), quantile_cont(CAST({c} AS DOUBLE), 0.5), quantile_cont(CAST({c} AS DOUBLE), 0.75), max({c})]) AS value FROM scored" for c in NUMERIC if c in PROFILED)
_COL = " UNION ALL ".join(f"SELECT unnest(['nulls','nulls','cardinality','cardinality']) AS section, '{c}' AS item, unnest(['n_null','pct_null','n_distinct','pct_distinct']) AS measure, unnest([count(*) - count({c}), round(100.0 * (count(*) - count({c})) / count(*), 2), count(DISTINCT {c}), round(100.0 * count(DISTINCT {c}) / count(*), 2)]) AS value FROM scored" for c in PROFILED)


_SCH = " UNION ALL ".join(f"SELECT 'schema', '{c}', '{TYPES.get(c, 'double')}', {i}" for i, c in enumerate(PROFILED, 1))


_SAMPLE = "SELECT 'sample', CAST(place AS VARCHAR), unnest([" + ", ".join(f"'{c}'" for c in PROFILED) + "]), unnest([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in PROFILED) + "]) FROM (SELECT *, row_number() OVER (ORDER BY customer_id) AS place FROM scored) WHERE place <= 5"


@query("a12_full_profile", PORTFOLIO_SQL + f"SELECT section, item, measure, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT 'table' AS section, '' AS item, unnest(['n_rows','n_columns']) AS measure, unnest([count(*), {len(PROFILED)}]) AS value FROM scored UNION ALL {_SCH} UNION ALL {_COL} UNION ALL {_NUM} UNION ALL SELECT 'duplicate_keys', 'customer_id', 'n_keys', 0 UNION ALL {_SAMPLE})")
def _(spark, folder):
    return profile.full_profile(portfolio(spark, folder).select(PROFILED), NUMERIC, [KEY])


@query("o5_any_row", PORTFOLIO_SQL + "SELECT count(*) > 0 AS any_row FROM scored")
def _(spark, folder):
    return portfolio(spark, folder).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("any_row"))


@query("o2_preview")
def _(spark, folder):
    """The first five rows of a scan; the limit is the feature."""
    return portfolio(spark, folder).limit(5)


# Decisions and thresholds

CONFUSION = "CAST(count(*) FILTER (y = 0 AND score < t) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 0 AND score >= t) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 1 AND score < t) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 1 AND score >= t) AS BIGINT) AS tp"
GRID99 = LABELLED + f", grid AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM generate_series(1, 99) AS g(i)), c AS (SELECT t AS threshold, {CONFUSION} FROM lab, grid GROUP BY t), costs AS (SELECT *, fp * 1500.0::DOUBLE + fn * 15000.0::DOUBLE AS total_cost, (tn + fn) / (tn + fp + fn + tp) AS approval_rate FROM c)\n"
GRID18 = LABELLED + f", grid AS (SELECT CAST(i AS DOUBLE) / 20 AS t FROM generate_series(1, 18) AS g(i)), c AS (SELECT t AS threshold, {CONFUSION} FROM lab, grid GROUP BY t), sw AS (SELECT threshold, (tn + fn) / (tn + fp + fn + tp) AS approval_rate, CASE WHEN tn + fn > 0 THEN fn / (tn + fn) END AS default_rate, (fn + tp) / (tn + fp + fn + tp) AS base_rate FROM c), best AS (SELECT * FROM sw WHERE approval_rate >= {{floor}} AND default_rate IS NOT NULL ORDER BY default_rate, threshold LIMIT 1)\n"
AT45 = LABELLED + f", at45 AS (SELECT {CONFUSION} FROM (SELECT *, 0.45::DOUBLE AS t FROM lab))\n"


@query("m1_decision", PORTFOLIO_SQL + "SELECT customer_id, CASE WHEN score >= 0.45 THEN 'negado' ELSE 'aprovado' END AS decision FROM scored")
def _(spark, folder):
    return portfolio(spark, folder).select(KEY, rules.decision(F.col(SCORE)).alias("decision"))


@query("m17_approval_sweep", GRID18.format(floor=0.70) + "SELECT round(threshold, 6) AS threshold, round(approval_rate, 6) AS approval_rate, round(default_rate, 6) AS default_rate, round(base_rate, 6) AS base_rate FROM sw")
def _(spark, folder):
    return thresholds.approval_sweep(portfolio(spark, folder), LABEL, SCORE)


BEST = "SELECT round(threshold, 6) AS threshold, round(approval_rate, 6) AS approval_rate, round(default_rate, 6) AS default_rate, round(base_rate, 6) AS base_rate, round(base_rate - default_rate, 6) AS reduction, CASE WHEN base_rate - default_rate > 0 THEN 'confirmada' ELSE 'refutada' END AS status FROM best"


@query("o4_best_viable", GRID18.format(floor=0.70) + BEST)
def _(spark, folder):
    return thresholds.best_viable(thresholds.approval_sweep(portfolio(spark, folder), LABEL, SCORE))


@query("m18_net_impact", GRID18.format(floor=0.70) + "SELECT round(b.threshold, 6) AS threshold, c.tp AS bads_rejected, c.fp AS goods_rejected, round(c.tp * 15000.0::DOUBLE - c.fp * 1500.0::DOUBLE, 6) AS net, CASE WHEN c.tp * 15000 - c.fp * 1500 > 0 THEN 'confirmada' ELSE 'refutada' END AS status FROM best b JOIN c ON c.threshold = b.threshold")
def _(spark, folder):
    rows = portfolio(spark, folder)
    return thresholds.net_impact(rows, LABEL, SCORE, thresholds.best_viable(thresholds.approval_sweep(rows, LABEL, SCORE)))


@query("m20_confusion_cost", AT45 + "SELECT *, fp * 1500.0::DOUBLE + fn * 15000.0::DOUBLE AS total_cost, round((tn + fn) / (tn + fp + fn + tp), 6) AS approval_rate FROM at45")
def _(spark, folder):
    return thresholds.with_cost(labelled(spark, folder).agg(*thresholds.confusion(LABEL, F.col(SCORE), rules.THRESHOLD)))


@query("m21_cost_sweep", GRID99 + "SELECT round(threshold, 6) AS threshold, tn, fp, fn, tp, total_cost, round(approval_rate, 6) AS approval_rate FROM costs")
def _(spark, folder):
    return thresholds.cost_sweep(portfolio(spark, folder), LABEL, SCORE)


@query("o3_cheapest_threshold", GRID99 + "SELECT round(threshold, 6) AS threshold, total_cost, round(approval_rate, 6) AS approval_rate FROM costs ORDER BY total_cost, threshold LIMIT 1")
def _(spark, folder):
    return thresholds.cheapest(thresholds.cost_sweep(portfolio(spark, folder), LABEL, SCORE))


@query("m21_cost_of_floor", GRID99 + f", at45 AS (SELECT {CONFUSION} FROM (SELECT *, 0.45::DOUBLE AS t FROM lab)), lo AS (SELECT * FROM costs ORDER BY total_cost, threshold LIMIT 1) SELECT round(threshold, 6) AS min_threshold, total_cost AS min_cost, round(approval_rate, 6) AS min_approval, 0.45::DOUBLE AS operating_threshold, at45.fp * 1500.0::DOUBLE + at45.fn * 15000.0::DOUBLE AS operating_cost, round((at45.tn + at45.fn) / (at45.tn + at45.fp + at45.fn + at45.tp), 6) AS operating_approval, at45.fp * 1500.0::DOUBLE + at45.fn * 15000.0::DOUBLE - total_cost AS cost_of_floor FROM lo, at45")
def _(spark, folder):
    return thresholds.cost_of_floor(portfolio(spark, folder), LABEL, SCORE)


@query("m30_financial_impact", AT45 + "SELECT tn + fp + fn + tp AS n, round((tn + fn) / (tn + fp + fn + tp), 6) AS approval_rate, round((fn + tp) / (tn + fp + fn + tp), 6) AS default_before, round(fn / (tn + fn), 6) AS default_after, tp AS bads_rejected, fp AS goods_rejected, tp * 15000.0::DOUBLE AS avoided_loss, fp * 1500.0::DOUBLE AS opportunity_cost, tp * 15000.0::DOUBLE - fp * 1500.0::DOUBLE AS net, round(fp / tp, 6) AS break_even_ratio FROM at45")
def _(spark, folder):
    return thresholds.financial_impact(portfolio(spark, folder), LABEL, SCORE)


# Ranking metrics

EVALUATE = """, g AS (SELECT {by} AS grp, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} GROUP BY 1, 2),
f AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY grp) AS tp, sum(neg) OVER (PARTITION BY grp) AS tn FROM g WINDOW w AS (PARTITION BY grp ORDER BY p)),
ev AS (SELECT grp, sum(pos * (2 * (cn - neg) + neg)) / (2 * any_value(tp) * any_value(tn)) AS auc, max(abs(cp / tp - cn / tn)) AS ks,
  coalesce(max(CASE WHEN (tp - cp + pos) / (tp - cp + pos + tn - cn + neg) >= 0.30 THEN (tp - cp + pos) / tp END), 0.0) AS recall_at_precision,
  CAST(any_value(tp) AS BIGINT) AS n_pos, CAST(any_value(tn) AS BIGINT) AS n_neg FROM f GROUP BY grp)
"""
EVALUATED = TWO_MODELS + EVALUATE.format(by="model", src="m")


@query("m6_auc", EVALUATED + "SELECT grp AS model, round(auc, 6) AS auc FROM ev")
def _(spark, folder):
    return ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p").select("model", "auc")


@query("m7_ks", EVALUATED + "SELECT grp AS model, round(ks, 6) AS ks FROM ev")
def _(spark, folder):
    return ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p").select("model", "ks")


@query("m8_recall_at_precision", EVALUATED.replace("0.30", "0.10") + "SELECT grp AS model, round(recall_at_precision, 6) AS recall_at_precision FROM ev")
def _(spark, folder):
    return ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p", 0.10).select("model", "recall_at_precision")


@query("m9_evaluate", EVALUATED + "SELECT grp AS model, round(auc, 6) AS auc, round(ks, 6) AS ks, round(recall_at_precision, 6) AS recall_at_precision, n_pos, n_neg FROM ev")
def _(spark, folder):
    return ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p")


@query("m10_winner", EVALUATED + "SELECT round(s, 6) AS auc_simple, round(c, 6) AS auc_complex, CASE WHEN abs(c - s) < 0.005 THEN 'utilisation' WHEN c > s THEN 'score' ELSE 'utilisation' END AS winner FROM (SELECT max(auc) FILTER (grp = 'utilisation') AS s, max(auc) FILTER (grp = 'score') AS c FROM ev)")
def _(spark, folder):
    return ranking.winner(ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p"), "utilisation", "score")


BY_PRIORITY = PORTFOLIO_SQL.replace("customer_id,\n       CAST(15", "customer_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS version,\n       CAST(15") + ", lab AS (SELECT version, target_dlq_2yrs AS y, score AS p FROM scored WHERE target_dlq_2yrs IS NOT NULL)\n"


def _versions(spark, folder):
    """AUC of one score on the rows of each order priority, as if these were model versions."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias(KEY), F.substring("o_orderpriority", 1, 1).cast("int").alias("version"))
    return ranking.evaluate(labelled(spark, folder).join(orders, KEY), ["version"], LABEL, SCORE).select("version", "auc")


@query("m11_champion", BY_PRIORITY + EVALUATE.format(by="version", src="lab") + "SELECT grp AS version, round(auc, 6) AS auc FROM ev ORDER BY ev.auc DESC, version LIMIT 1")
def _(spark, folder):
    return ranking.champion(_versions(spark, folder))


@query("m12_reconciled", EVALUATED + "SELECT grp AS model, round(auc, 6) AS auc, CASE WHEN grp = 'score' THEN round(auc, 4) END AS recorded, coalesce(CASE WHEN grp = 'score' THEN abs(auc - round(auc, 4)) <= 1e-6 END, false) AS passes FROM ev")
def _(spark, folder):
    metrics = staged(ranking.evaluate(two_models(spark, folder), ["model"], LABEL, "p"))
    recorded = metrics.where("model = 'score'").select("model", F.round("auc", 4).alias("auc"))
    return ranking.reconciled(metrics, recorded)


TAKEN = TWO_MODELS + ", k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, customer_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM m), ap AS (SELECT *, r <= CAST(round_even(0.731 * n, 0) AS BIGINT) AS approved FROM k)\n"


@query("w3_lowest_fraction", TAKEN + "SELECT model, customer_id, approved FROM ap")
def _(spark, folder):
    return ranking.lowest_fraction(two_models(spark, folder), ["model"], "p", KEY, 0.731).select("model", KEY, "approved")


@query("m28_equal_approval", TAKEN + "SELECT model, round(avg(CASE WHEN approved THEN y END), 6) AS default_approved, CAST(count(*) FILTER (NOT approved AND y = 1) AS BIGINT) AS bads_rejected, CAST(count(*) FILTER (NOT approved AND y = 0) AS BIGINT) AS goods_rejected FROM ap GROUP BY model")
def _(spark, folder):
    return ranking.equal_approval(two_models(spark, folder), ["model"], LABEL, "p", KEY, 0.731)


@query("m15_spearman", PORTFOLIO_SQL + ", r AS (SELECT customer_id, (rank() OVER (ORDER BY monthly_income) + rank() OVER (ORDER BY monthly_income) + c1 - 1) / 2.0 AS a, (2 * rank() OVER (ORDER BY score) + c2 - 1) / 2.0 AS b FROM (SELECT *, count(*) OVER (PARTITION BY monthly_income) AS c1, count(*) OVER (PARTITION BY score) AS c2 FROM scored WHERE monthly_income IS NOT NULL)) SELECT round(corr(a, b), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM r")
def _(spark, folder):
    return ranking.spearman(portfolio(spark, folder), "monthly_income", SCORE)


# Fairness

BANDS = LABELLED + """, e AS (SELECT list_distinct_sorted.l AS edges FROM (SELECT list_sort(list_distinct(quantile_cont(monthly_income, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS l FROM {src}) list_distinct_sorted),
b0 AS (SELECT r.*, CASE WHEN monthly_income IS NULL THEN len(edges) ELSE 1 + len(list_filter(edges[2:len(edges) - 1], lambda x: monthly_income > x)) END AS income_order, len(edges) - 1 AS nb FROM {src} r, e),
banded AS (SELECT *, CASE WHEN age IS NULL OR age < 18 THEN 'não informada' WHEN age <= 30 THEN '18-30' WHEN age <= 40 THEN '31-40' WHEN age <= 50 THEN '41-50' WHEN age <= 60 THEN '51-60' ELSE '60+' END AS age_band,
  CASE WHEN monthly_income IS NULL THEN 'não informada' ELSE 'Q' || income_order || CASE WHEN income_order = 1 THEN ' (menor)' WHEN income_order = nb THEN ' (maior)' ELSE '' END END AS income_band FROM b0)
"""
GROUPS = BANDS.format(src="lab") + """, long_ AS (SELECT 'age' AS dimension, age_band AS band, y, score FROM banded UNION ALL SELECT 'income', income_band, y, score FROM banded),
gc AS (SELECT dimension, band, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (y = 0) AS BIGINT) AS goods, CAST(count(*) FILTER (y = 1) AS BIGINT) AS bads, CAST(count(*) FILTER (y = 0 AND score >= 0.45) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 1 AND score < 0.45) AS BIGINT) AS fn FROM long_ GROUP BY 1, 2),
gr AS (SELECT *, bads / n AS default_rate, (goods - fp + fn) / n AS approval_rate, fp / goods AS goods_denied,
  ((fp / goods) + 3.8416 / (2 * goods)) / (1 + 3.8416 / goods) - 1.96 * sqrt((fp / goods) * (1 - fp / goods) / goods + 3.8416 / (4.0 * goods * goods)) / (1 + 3.8416 / goods) AS ci_low,
  ((fp / goods) + 3.8416 / (2 * goods)) / (1 + 3.8416 / goods) + 1.96 * sqrt((fp / goods) * (1 - fp / goods) / goods + 3.8416 / (4.0 * goods * goods)) / (1 + 3.8416 / goods) AS ci_high,
  CASE WHEN bads > 0 THEN fn / bads END AS bads_approved, goods < 100 AS small_sample, sum(fp) OVER (PARTITION BY dimension) / sum(goods) OVER (PARTITION BY dimension) AS overall FROM gc),
gm AS (SELECT * EXCLUDE (overall), approval_rate / max(approval_rate) OVER (PARTITION BY dimension) AS approval_ratio, coalesce(ci_low > overall, false) AS above_average FROM gr)
"""


@query("m22_wilson", "SELECT o_orderpriority, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = rules.wilson(F.col("k"), F.col("n"))
    return counts.select("o_orderpriority", low.alias("low"), high.alias("high"))


@query("m23_age_bands", BANDS.format(src="scored") + "SELECT age_band, CAST(count(*) AS BIGINT) AS n FROM banded GROUP BY 1")
def _(spark, folder):
    return portfolio(spark, folder).groupBy(rules.age_band(F.col("age")).alias("age_band")).agg(F.count("*").alias("n"))


@query("m24_income_bands", BANDS.format(src="scored") + "SELECT customer_id, income_band, CAST(income_order AS INT) AS income_order FROM banded")
def _(spark, folder):
    return fairness.with_income_band(portfolio(spark, folder), "monthly_income").select(KEY, "income_band", "income_order")


def _groups(spark, folder):
    return fairness.group_metrics(fairness.with_bands(labelled(spark, folder)), LABEL, SCORE, rules.THRESHOLD, {"age": "age_band", "income": "income_band"})


@query("m25_group_metrics", GROUPS + "SELECT dimension, band, n, goods, bads, fp, fn, round(default_rate, 6) AS default_rate, round(approval_rate, 6) AS approval_rate, round(goods_denied, 6) AS goods_denied, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(bads_approved, 6) AS bads_approved, small_sample, round(approval_ratio, 6) AS approval_ratio, above_average FROM gm")
def _(spark, folder):
    return _groups(spark, folder)


GROUPS3 = GROUPS.replace("SELECT 'income', income_band, y, score FROM banded)", "SELECT 'income', income_band, y, score FROM banded UNION ALL SELECT 'delinquency', CASE WHEN total_delinquency_events > 0 THEN 'late' ELSE 'on time' END, y, score FROM banded)")
DIMENSIONS = {"age": "age_band", "income": "income_band", "delinquency": "delinquency_band"}


def _banded(rows):
    return fairness.with_bands(rows).withColumn("delinquency_band", F.when(F.col("total_delinquency_events") > 0, "late").otherwise("on time"))


@query("m26_bias_alerts", GROUPS3 + "SELECT dimension, band, unnest(['four_fifths']) AS rule, 'approves ' || format('{:.1f}', 100 * approval_rate) || '%, a ratio of ' || format('{:.2f}', approval_ratio) || ' to the best band' || CASE WHEN small_sample THEN ' (few rows)' ELSE '' END AS message FROM gm WHERE approval_ratio < 0.8 UNION ALL SELECT dimension, band, 'goods_denied', 'denies ' || format('{:.1f}', 100 * goods_denied) || '% of good payers, more than all bands together' || CASE WHEN small_sample THEN ' (few rows)' ELSE '' END FROM gm WHERE above_average")
def _(spark, folder):
    """Alerts by age, income and past delinquency; the last always has some, as the score looks at it."""
    return fairness.alerts(fairness.group_metrics(_banded(labelled(spark, folder)), LABEL, SCORE, rules.THRESHOLD, DIMENSIONS))


# Calibration, splits, attribution, hypotheses

CALIBRATION = LABELLED + """, q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_ FROM lab),
cb AS (SELECT len(list_filter(inner_, lambda e: e < score)) AS bin, CAST(count(*) AS BIGINT) AS n, avg(score) AS predicted, avg(y) AS observed FROM lab, q GROUP BY 1)
"""


@query("m27_calibration", CALIBRATION + "SELECT 'all' AS kind, round(avg(y), 6) AS observed, round(avg(score), 6) AS mean_predicted, round(avg((score - y) * (score - y)), 6) AS brier, (SELECT round(avg(abs(observed - predicted)), 6) FROM cb) AS mean_error FROM lab")
def _(spark, folder):
    return models.calibration(labelled(spark, folder).withColumn("kind", F.lit("all")), ["kind"], LABEL, SCORE)[0]


@query("m27_calibration_curve", CALIBRATION + "SELECT 'all' AS kind, CAST(bin AS INT) AS bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM cb")
def _(spark, folder):
    return models.calibration(labelled(spark, folder).withColumn("kind", F.lit("all")), ["kind"], LABEL, SCORE)[1]


HALVES = LABELLED + ", hh AS (SELECT customer_id, y, score, (((customer_id::HUGEINT * 1103515245 + 42 * 12345) % 2147483648) * 69069 + 1) % 2147483648 AS h FROM lab), hr AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, customer_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM hh), hv AS (SELECT customer_id, y, score, r <= CAST(round_even({share} * n, 0) AS BIGINT) AS is_test FROM hr)\n"
#: By the max-min formula: the fit at a point is the greatest, over starts up to it, of the least mean up to an end from it on.
ISOTONIC = HALVES.format(share=0.5) + """, pt AS (SELECT score AS x, count(*) AS w, sum(y) AS s FROM hv WHERE NOT is_test GROUP BY score),
cu AS (SELECT x, w, s, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM pt),
mn AS (SELECT b.i AS i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM cu a JOIN cu b ON b.i >= a.i),
kn AS (SELECT x, f FROM cu JOIN (SELECT i, max(v) AS f FROM mn GROUP BY i) USING (i)),
te AS (SELECT te.y, te.score, CASE WHEN l.x IS NULL THEN u.f WHEN u.x IS NULL OR u.x = l.x THEN l.f ELSE l.f + (u.f - l.f) * (te.score - l.x) / (u.x - l.x) END AS cal
  FROM (SELECT * FROM hv WHERE is_test) te ASOF LEFT JOIN kn l ON te.score >= l.x ASOF LEFT JOIN kn u ON te.score <= u.x),
lg AS (SELECT 'raw' AS kind, y, score AS p FROM te UNION ALL SELECT 'calibrated', y, cal FROM te),
qq AS (SELECT kind, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_ FROM lg GROUP BY kind),
cb AS (SELECT kind, len(list_filter(inner_, lambda e: e < p)) AS bin, avg(p) AS predicted, avg(y) AS observed FROM lg JOIN qq USING (kind) GROUP BY 1, 2)
"""


@query("m27_isotonic", ISOTONIC + "SELECT kind, round(avg(y), 6) AS observed, round(avg(p), 6) AS mean_predicted, round(avg((p - y) * (p - y)), 6) AS brier, (SELECT round(avg(abs(observed - predicted)), 6) FROM cb WHERE cb.kind = lg.kind) AS mean_error FROM lg GROUP BY kind")
def _(spark, folder):
    """Raw against isotonic scores on the half that the fit didn't see."""
    return models.calibration_analysis(labelled(spark, folder))


@query("m3_stratified_split", LABELLED + ", h AS (SELECT customer_id, y, (((customer_id::HUGEINT * 1103515245 + 42 * 12345) % 2147483648) * 69069 + 1) % 2147483648 AS h FROM lab), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, customer_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM h) SELECT customer_id, y AS target_dlq_2yrs, r <= CAST(round_even(0.25 * n, 0) AS BIGINT) AS is_test FROM k")
def _(spark, folder):
    return models.stratified_split(portfolio(spark, folder).select(KEY, LABEL))


ATTRIBUTED = ["revolving_utilization", "age", "debt_ratio", "monthly_income"]
_ATTR = PORTFOLIO_SQL + ", att AS (" + " UNION ALL ".join(f"SELECT customer_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, coalesce((SELECT corr(CAST({c} AS DOUBLE), CAST(target_dlq_2yrs AS DOUBLE)) FROM scored WHERE target_dlq_2yrs IS NOT NULL) * (({c} - (SELECT avg({c}) FROM scored)) / (SELECT stddev_samp({c}) FROM scored)), 0.0) AS attribution FROM scored" for c in ATTRIBUTED) + "), imp AS (SELECT feature, avg(abs(attribution)) AS mean_abs, CAST(row_number() OVER (ORDER BY avg(abs(attribution)) DESC, feature) AS INT) AS rank FROM att GROUP BY feature)\n"


def _weights(rows, features=ATTRIBUTED):
    """Weights from the data, so that both engines can compute them."""
    return staged(models.correlation_weights(rows, features))


def _attributions(spark, folder):
    rows = portfolio(spark, folder)
    return models.linear_attribution(rows, _weights(rows), ATTRIBUTED)


@query("m13_linear_attribution", _ATTR + "SELECT customer_id, feature, round(value, 6) AS value, round(attribution, 6) AS attribution FROM att")
def _(spark, folder):
    return _attributions(spark, folder)


@query("w2_importance_rank", _ATTR + "SELECT feature, round(mean_abs, 6) AS mean_abs, rank FROM imp")
def _(spark, folder):
    return models.importance(_attributions(spark, folder))


_RHO = ", rk AS (SELECT corr(a, b) AS s, count(*) AS n FROM (SELECT (2 * rank() OVER (ORDER BY value) + count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, (2 * rank() OVER (ORDER BY attribution) + count(*) OVER (PARTITION BY attribution) - 1) / 2.0 AS b FROM att WHERE feature = 'revolving_utilization'))\n"


@query("m15_validated_feature", _ATTR + _RHO + "SELECT feature, round(s, 6) AS spearman, CAST(n AS BIGINT) AS n, rank, round(mean_abs, 6) AS mean_abs, CASE WHEN s > 0.05 THEN 'confirmada' ELSE 'refutada' END AS status FROM rk, imp WHERE feature = 'revolving_utilization'")
def _(spark, folder):
    return models.validated_feature(_attributions(spark, folder), "revolving_utilization")


@query("m16_relative_difference", _ATTR + "SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, round((a - b) / b, 6) AS difference, CASE WHEN (a - b) / b > 0.1 THEN 'confirmada' ELSE 'refutada' END AS status FROM (SELECT max(mean_abs) FILTER (feature = 'debt_ratio') AS a, max(mean_abs) FILTER (feature = 'age') AS b FROM imp)")
def _(spark, folder):
    return models.relative_difference(models.importance(_attributions(spark, folder)), "debt_ratio", "age")


@query("m19_hypotheses", _ATTR + _RHO + """, lab AS (SELECT *, target_dlq_2yrs AS y FROM scored WHERE target_dlq_2yrs IS NOT NULL), grid AS (SELECT CAST(i AS DOUBLE) / 20 AS t FROM generate_series(1, 18) AS g(i)),
c AS (SELECT t AS threshold, """ + CONFUSION + """ FROM lab, grid GROUP BY t),
best AS (SELECT * FROM (SELECT *, (tn + fn) / (tn + fp + fn + tp) AS ar, fn / nullif(tn + fn, 0) AS dr, (fn + tp) / (tn + fp + fn + tp) AS br FROM c) WHERE ar >= 0.4 AND dr IS NOT NULL ORDER BY dr, threshold LIMIT 1),
d2 AS (SELECT (a - b) / b AS d FROM (SELECT max(mean_abs) FILTER (feature = 'debt_ratio') AS a, max(mean_abs) FILTER (feature = 'age') AS b FROM imp))
SELECT hypothesis, """ + "CASE hypothesis " + " ".join(f"WHEN '{h}' THEN '{about}'" for h, (about, _) in hypotheses.TEXTS.items()) + " END AS description, metric, status, value, evidence, CASE hypothesis " + " ".join(f"WHEN '{h}' THEN '{limit}'" for h, (_, limit) in hypotheses.TEXTS.items()) + """ END AS limitation FROM (
SELECT 'H1' AS hypothesis, 'spearman' AS metric, CASE WHEN s > 0.05 THEN 'confirmada' ELSE 'refutada' END AS status, round(s, 6) AS value, 'rho = ' || format('{:.3f}', s) || ', rank ' || rank AS evidence FROM rk, imp WHERE feature = 'revolving_utilization'
UNION ALL SELECT 'H2', 'relative_difference', CASE WHEN d > 0.1 THEN 'confirmada' ELSE 'refutada' END, round(d, 6), 'diff = ' || format('{:.3f}', d) FROM d2
UNION ALL SELECT 'H3', 'default_reduction', CASE WHEN br - dr > 0 THEN 'confirmada' ELSE 'refutada' END, round(br - dr, 6), 'threshold = ' || format('{:.2f}', threshold) FROM best
UNION ALL SELECT 'H4', 'net_impact', CASE WHEN tp * 15000 - fp * 1500 > 0 THEN 'confirmada' ELSE 'refutada' END, round(tp * 15000.0::DOUBLE - fp * 1500, 6), 'bads = ' || tp || ', goods = ' || fp FROM best)""")
def _(spark, folder):
    return hypotheses.summary(portfolio(spark, folder), _attributions(spark, folder), LABEL, SCORE, floor=0.4)


def newton_sql(train: str, features: list[str] = FEATURES, steps: int = 16) -> str:
    """Common table expressions after ``sp`` (rows with customer_id, y and the features): unrolled Newton steps of the logistic
    fit to the rows of ``train``, each a matrix eliminated column by column; ``xs`` has rows standardised, ``b`` the coefficients."""
    d = len(features) + 1
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    sql = f""", lf AS (SELECT customer_id, y, {train} AS tr, unnest([{values}]) AS v, unnest(range(1, {d})) AS i FROM sp),
md AS (SELECT i, median(v) FILTER (tr) AS m FROM lf GROUP BY i),
fl AS (SELECT customer_id, y, tr, i, coalesce(v, m) AS f FROM lf JOIN md USING (i)),
st AS (SELECT i, avg(f) AS a, stddev_samp(f) AS d FROM fl WHERE tr GROUP BY i),
xs AS (SELECT customer_id, any_value(y) AS y, any_value(tr) AS tr, list_prepend(1.0::DOUBLE, list((f - a) / d ORDER BY i)) AS x FROM fl JOIN st USING (i) GROUP BY customer_id),
cw AS (SELECT count(*) / (2 * count(*) FILTER (y = 1)) AS w1, count(*) / (2 * count(*) FILTER (y = 0)) AS w0 FROM xs WHERE tr),
tw AS (SELECT x, y, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM xs, cw WHERE tr),
b0 AS (SELECT list_transform(range({d}), lambda e: 0.0::DOUBLE) AS b)
"""
    for k in range(steps):
        sql += f""", p{k} AS (SELECT x, y, w, b, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM tw, b{k}),
h{k} AS (SELECT i, j, sum(w * p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END AS v FROM p{k}, range(1, {d + 1}) AS r1(i), range(1, {d + 1}) AS r2(j) GROUP BY i, j
  UNION ALL SELECT i, {d + 1}, sum(w * (y - p) * x[i]) - CASE WHEN i > 1 THEN any_value(b[i]) ELSE 0 END FROM p{k}, range(1, {d + 1}) AS r1(i) GROUP BY i),
g{k}(s, m) AS (SELECT 1, list(row ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS row FROM h{k} GROUP BY i)
  UNION ALL SELECT s + 1, list_transform(m, lambda row, i: CASE WHEN i = s THEN list_transform(row, lambda e: e / row[s]) ELSE list_transform(row, lambda e, j: e - row[s] / m[s][s] * m[s][j]) END) FROM g{k} WHERE s <= {d}),
b{k + 1} AS (SELECT list_transform(b, lambda e, i: e + m[i][{d + 1}]) AS b FROM b{k}, g{k} WHERE s = {d + 1})
"""
    return sql + f", b AS (SELECT b FROM b{steps})\n"


SPLIT = HALVES.format(share=0.25) + ", sp AS (SELECT lab.*, is_test FROM lab JOIN (SELECT customer_id, is_test FROM hv) USING (customer_id))\n"
NEWTON = SPLIT + newton_sql("NOT is_test")
NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"


@query("k8_persisted_hypotheses", ORACLE_SQL["m19_hypotheses"])
def _(spark, folder):
    """The report as a table, written twice and read back."""
    name, at = f"solvara_{uuid.uuid4().hex}", shared_dir(spark)
    report = staged(hypotheses.summary(portfolio(spark, folder), _attributions(spark, folder), LABEL, SCORE, floor=0.4))
    hypotheses.persist(report, name, location=at)
    return hypotheses.persist(report, name, location=at)


def _fitted(spark, folder, fit):
    split = staged(models.stratified_split(portfolio(spark, folder).select(KEY, LABEL, *FEATURES)))
    return fit(split.where("not is_test")), split.where("is_test")


@query("m5_logistic", NEWTON + ", ts AS (SELECT 'logistic' AS model, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xs, b WHERE NOT tr)" + EVALUATE.format(by="model", src="ts") + "SELECT grp AS model, round(auc, 6) AS auc, round(ks, 6) AS ks, round(recall_at_precision, 6) AS recall_at_precision, n_pos, n_neg FROM ev")
def _(spark, folder):
    """Evaluation of the logistic model on the test rows."""
    model, test = _fitted(spark, folder, lambda train: logit.fit(train, FEATURES, LABEL))
    return ranking.evaluate(models.probabilities(model, test, FEATURES).withColumn("model", F.lit("logistic")), ["model"], LABEL, SCORE)


@query("m4_boosted_trees")
def _(spark, folder):
    """Evaluation of boosted trees on the test rows."""
    model, test = _fitted(spark, folder, lambda train: boosting.fit(train, FEATURES, LABEL))
    return ranking.evaluate(models.probabilities(model, test, FEATURES).withColumn("model", F.lit("trees")), ["model"], LABEL, SCORE)


@query("m14_coefficients", NEWTON + f"SELECT unnest({NAMES}) AS feature, round(unnest(b[2:]), 6) AS coefficient FROM b")
def _(spark, folder):
    """Coefficients of the logistic model."""
    return models.coefficients(_fitted(spark, folder, lambda train: logit.fit(train, FEATURES, LABEL))[0], FEATURES)


@query("m13_permutation_importance")
def _(spark, folder):
    """Drop of the AUC by shuffled feature."""
    model, test = _fitted(spark, folder, lambda train: logit.fit(train, FEATURES, LABEL))
    return models.permutation_importance(model, test, FEATURES)


@query("m13_sampled_shapley")
def _(spark, folder):
    """Mean absolute Shapley value by feature, on the operator's sample of test rows."""
    model, test = _fitted(spark, folder, lambda train: logit.fit(train, FEATURES, LABEL))
    return models.importance(models.sampled_shapley(model, test, FEATURES))


@query("m13_logistic_attribution", NEWTON + f""", tl AS (SELECT unnest({NAMES}) AS feature, unnest(range(2, {len(FEATURES) + 2})) AS i, unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)}]) AS v FROM sp WHERE is_test),
ts AS (SELECT feature, avg(v) AS a, stddev_samp(v) AS d FROM tl GROUP BY feature),
ta AS (SELECT feature, avg(abs(coalesce(b[i] * (v - a) / nullif(d, 0), 0.0))) AS mean_abs FROM tl JOIN ts USING (feature), b GROUP BY feature)
SELECT feature, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INT) AS rank FROM ta""")
def _(spark, folder):
    """Mean absolute attribution by feature of the fitted logistic model, on the test rows."""
    model, test = _fitted(spark, folder, lambda train: logit.fit(train, FEATURES, LABEL))
    return models.importance(models.linear_attribution(test, models.coefficients(model, FEATURES).withColumnRenamed("coefficient", "weight"), FEATURES))


AGE_BAND = "CASE WHEN age IS NULL OR age < 18 THEN 'não informada' WHEN age <= 30 THEN '18-30' WHEN age <= 40 THEN '31-40' WHEN age <= 50 THEN '41-50' WHEN age <= 60 THEN '51-60' ELSE '60+' END"


def _ablated(name: str, features: list[str]) -> str:
    return f"SELECT * FROM (WITH RECURSIVE sp AS (SELECT * FROM halved){newton_sql('NOT is_test', features)} SELECT '{name}' AS model, customer_id, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xs, b WHERE NOT tr)"


_BANDED = f", ab AS (SELECT ap.*, {AGE_BAND} AS band FROM ap JOIN scored USING (customer_id)), br AS (SELECT model, band, avg(CASE WHEN y = 0 THEN CASE WHEN approved THEN 0.0 ELSE 1.0 END END) AS gd, CAST(count(*) FILTER (NOT approved) AS BIGINT) AS nd FROM ab GROUP BY 1, 2)"
_ABLATION = """
SELECT model, round(any_value(auc), 6) AS auc, round(avg(CASE WHEN approved THEN y END), 6) AS default_approved, CAST(count(*) FILTER (NOT approved AND y = 1) AS BIGINT) AS bads_rejected, CAST(count(*) FILTER (NOT approved AND y = 0) AS BIGINT) AS goods_rejected,
  (SELECT round(max(gd) FILTER (band = '18-30') / max(gd) FILTER (band = '60+'), 6) FROM br WHERE br.model = ab.model) AS young_to_old FROM ab JOIN ev ON grp = model GROUP BY model"""
ABLATED = SPLIT.replace(", sp AS (", ", halved AS (") + ", m AS (" + _ablated("all", FEATURES) + " UNION ALL " + _ablated("without_age", [f for f in FEATURES if f != "age"]) + "), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, customer_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM m), ap AS (SELECT *, r <= CAST(round_even(0.75 * n, 0) AS BIGINT) AS approved FROM k)" + EVALUATE.format(by="model", src="m") + _BANDED


@query("m29_without_age", ABLATED + """, w AS (SELECT band, max(gd) FILTER (model = 'all') AS g1, max(nd) FILTER (model = 'all') AS n1, max(gd) FILTER (model = 'without_age') AS g2, max(nd) FILTER (model = 'without_age') AS n2 FROM br GROUP BY band)
SELECT band, round(g1, 6) AS all_goods_denied, n1 AS all_n_denied, round(g2, 6) AS without_age_goods_denied, n2 AS without_age_n_denied, round(100 * (g2 - g1), 6) AS variation_pp FROM w""")
def _(spark, folder):
    """Denied goods by age band with and without age in the model, at equal approval."""
    return models.without_feature(portfolio(spark, folder), FEATURES)[1]


@query("m29_summary_without_age", ABLATED + _ABLATION)
def _(spark, folder):
    """The two models' AUC, portfolio figures and young-to-old ratio at equal approval."""
    return models.without_feature(portfolio(spark, folder), FEATURES)[0]


@query("m29_ablation_figures", TAKEN + EVALUATE.format(by="model", src="m") + _BANDED + _ABLATION)
def _(spark, folder):
    ages = portfolio(spark, folder).select(KEY, "age")
    return models.ablation_figures(two_models(spark, folder).withColumnRenamed("p", SCORE).join(ages, KEY), 0.731)[0]


SCORECARDS = _ATTR + ", sc AS (SELECT customer_id, 1 AS version, 1 / (1 + exp(-sum(attribution))) AS p FROM att GROUP BY 1 UNION ALL SELECT customer_id, 2, 1 / (1 + exp(-sum(attribution))) FROM att WHERE feature <> 'age' GROUP BY 1), scl AS (SELECT version, target_dlq_2yrs AS y, p FROM sc JOIN scored USING (customer_id) WHERE target_dlq_2yrs IS NOT NULL)" + EVALUATE.format(by="version", src="scl") + ", ch AS (SELECT grp FROM ev ORDER BY auc DESC, grp LIMIT 1)\n"


@query("m31_batch_scoring", SCORECARDS + "SELECT customer_id, round(p, 6) AS probability, CASE WHEN p >= 0.45 THEN 'negado' ELSE 'aprovado' END AS decision, 'scorecard' AS model_name, CAST(version AS VARCHAR) AS model_version, 0.45::DOUBLE AS threshold FROM sc JOIN ch ON version = grp JOIN scored USING (customer_id) WHERE target_dlq_2yrs IS NULL")
def _(spark, folder):
    """Two versions of a scorecard meet; the champion scores the unlabelled rows, which are appended by date."""
    rows = portfolio(spark, folder)
    scored = [models.scorecard(rows, _weights(rows, used), used).withColumn("version", F.lit(v)) for v, used in ((1, ATTRIBUTED), (2, [f for f in ATTRIBUTED if f != "age"]))]
    both = staged(scored[0].union(scored[1]))
    best = ranking.champion(ranking.evaluate(both.join(rows.select(KEY, LABEL), KEY), ["version"], LABEL, SCORE).select("version", "auc")).first().version
    batch = both.where(F.col("version") == best).join(rows.where(F.col(LABEL).isNull()).select(KEY), KEY)
    path = shared_dir(spark) + "/predictions"
    tables.append_by_date(models.predictions(batch, "scorecard", str(best)), path)
    return tables.read_merged(spark, path).drop("run_at", "run_date")


@query("k6_predictions_once", SCORECARDS + "SELECT customer_id, round(p, 6) AS probability, run FROM sc JOIN scored USING (customer_id), (SELECT unnest(['monday', 'tuesday']) AS run) WHERE version = 1 AND target_dlq_2yrs IS NULL")
def _(spark, folder):
    """Two runs' predictions, one of the runs repeated: each is there once."""
    rows = portfolio(spark, folder)
    batch = models.scorecard(rows, _weights(rows), ATTRIBUTED).join(rows.where(F.col(LABEL).isNull()).select(KEY), KEY)
    path = shared_dir(spark) + "/predictions"
    for run in ("monday", "tuesday", "monday"):
        tables.append_once(models.predictions(batch, "scorecard", "1").withColumn("run", F.lit(run)), path, run)
    return tables.read_merged(spark, path).select(KEY, "probability", "run")


@query("m31_model_scoring", LABELLED + ", sp AS (SELECT *, target_dlq_2yrs AS y FROM scored)\n" + newton_sql("y IS NOT NULL") + "SELECT customer_id, round(p, 6) AS probability, CASE WHEN p >= 0.45 THEN 'negado' ELSE 'aprovado' END AS decision, 'logistic' AS model_name, '1' AS model_version, 0.45::DOUBLE AS threshold FROM (SELECT customer_id, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM xs, b WHERE NOT tr)")
def _(spark, folder):
    """The unlabelled rows scored by a logistic model of the labelled ones."""
    rows = staged(portfolio(spark, folder).select(KEY, LABEL, *FEATURES))
    model = logit.fit(rows, FEATURES, LABEL)
    return models.predictions(models.probabilities(model, rows.where(F.col(LABEL).isNull()), FEATURES), "logistic", "1").drop("run_at")


_FITS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, avg(({c} - y) * ({c} - y)) AS brier, (SELECT avg(abs(o - p)) FROM (SELECT avg(y) AS o, avg({c}) AS p FROM labc, (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS inner_ FROM labc) GROUP BY len(list_filter(inner_, lambda e: e < {c})))) AS mean_error FROM labc" for kind, c in (("raw", "score"), ("calibrated", "cal")))


@query("m32_validation_metrics", GROUPS3 + GRID99[len(LABELLED) :] + AT45[len(LABELLED) :] + f", labc AS (SELECT *, score * (SELECT avg(y) / avg(score) FROM lab) AS cal FROM lab), fits AS ({_FITS}), al AS (SELECT CAST(sum(CASE WHEN approval_ratio < 0.8 THEN 1 ELSE 0 END + CASE WHEN above_average THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM gm), lo AS (SELECT * FROM costs ORDER BY total_cost, threshold LIMIT 1)" + """
SELECT 'validation' AS run, kind, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'parameter' AS kind, unnest(['operating_threshold', 'min_cost_threshold', 'loss', 'margin', 'approval_ratio_limit']) AS metric, unnest([0.45::DOUBLE, threshold, 15000, 1500, 0.8]) AS value FROM lo
UNION ALL SELECT 'metric', unnest(['cost_of_floor', 'net_impact', 'break_even_ratio', 'default_without_model', 'default_with_model', 'n_alerts']),
  unnest([at45.fp * 1500.0::DOUBLE + at45.fn * 15000.0::DOUBLE - lo.total_cost, at45.tp * 15000.0::DOUBLE - at45.fp * 1500.0::DOUBLE, at45.fp / at45.tp, (at45.fn + at45.tp) / (at45.tn + at45.fp + at45.fn + at45.tp), at45.fn / (at45.tn + at45.fn), al.n]) FROM lo, at45, al
UNION ALL SELECT 'metric', unnest(['brier_' || kind, 'calibration_error_' || kind]), unnest([brier, mean_error]) FROM fits)""")
def _(spark, folder):
    """Parameters and ten metrics of a run, appended to the metrics table by date."""
    rows = labelled(spark, folder)
    ratio = rows.agg((F.avg(LABEL) / F.avg(SCORE)).alias("ratio"))
    rows = rules.beside(_banded(rows), ratio).withColumn("calibrated", F.col(SCORE) * F.col("ratio"))
    path = shared_dir(spark) + "/metrics"
    tables.append_by_date(validation.run_metrics(rows, "validation", LABEL, SCORE, "calibrated", DIMENSIONS, F.current_timestamp()), path)
    return tables.read_merged(spark, path).drop("run_at", "run_date")


# Drift

DRIFT = PORTFOLIO_SQL + ", pop AS (SELECT *, {ref} AS isref, {cur} AS iscur FROM scored), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, isref, iscur FROM pop WHERE {c} IS NOT NULL" for c in [*FEATURES, "score"]) + """),
rd AS (SELECT feature, count(DISTINCT v) AS nd, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS dec FROM v WHERE isref GROUP BY feature),
fi AS (SELECT feature, list(v ORDER BY v) AS firsts FROM (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS r FROM (SELECT DISTINCT feature, v FROM v WHERE isref)) WHERE r <= 11 GROUP BY feature),
ed AS (SELECT feature, CASE WHEN nd < 2 THEN [] WHEN len(dec) < 11 AND nd <= 50 THEN list_transform(range(1, least(nd, 10)), lambda i: (firsts[i] + firsts[i + 1]) / 2) WHEN len(dec) < 3 THEN [(firsts[1] + firsts[2]) / 2] ELSE dec[2:len(dec) - 1] END AS edges FROM rd JOIN fi USING (feature)),
bn AS (SELECT feature, len(list_filter(edges, lambda e: e <= v)) AS cell, count(*) FILTER (isref) AS r, count(*) FILTER (iscur) AS c FROM v JOIN ed USING (feature) GROUP BY 1, 2),
gd AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS cell, len(edges) AS cuts FROM ed),
tt AS (SELECT feature, sum(r) AS n_ref, sum(c) AS n_cur FROM bn GROUP BY feature),
sh AS (SELECT feature, cuts, greatest(coalesce(r, 0) / n_ref, 1e-4) AS pr, greatest(coalesce(c, 0) / n_cur, 1e-4) AS pc FROM gd LEFT JOIN bn USING (feature, cell) JOIN tt USING (feature)),
ps AS (SELECT feature, CASE WHEN max(cuts) = 0 THEN 0.0 ELSE sum((pc - pr) * ln(pc / pr)) END AS psi FROM sh GROUP BY feature),
cu AS (SELECT feature, v, count(*) FILTER (isref) AS r, count(*) FILTER (iscur) AS c FROM v GROUP BY 1, 2),
kk AS (SELECT feature, max(abs(cr / n_ref - cc / n_cur)) AS ks, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur FROM (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM cu WINDOW w AS (PARTITION BY feature ORDER BY v)) JOIN tt USING (feature) GROUP BY feature),
kp AS (SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur))) * ks AS x FROM kk),
rp AS (SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'SEVERO' WHEN psi >= 0.10 THEN 'moderado' ELSE 'estavel' END AS psi_class, ks,
  CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0::DOUBLE * j * j * x * x))))) END AS p_value,
  CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur FROM ps JOIN kp USING (feature))
"""
SCORING = DRIFT.format(ref="target_dlq_2yrs IS NOT NULL", cur="target_dlq_2yrs IS NULL")
_BUCKET = "customer_id::HUGEINT * 2654435761 % 100"
SAMPLE = DRIFT.format(ref=f"target_dlq_2yrs IS NOT NULL AND {_BUCKET} >= 20", cur=f"target_dlq_2yrs IS NOT NULL AND {_BUCKET} < 20")
SELF = DRIFT.format(ref="target_dlq_2yrs IS NOT NULL", cur="target_dlq_2yrs IS NOT NULL")
REPORT = "SELECT feature, round(psi, 6) AS psi, psi_class, round(ks, 6) AS ks, round(p_value, 6) AS p_value, n_ref, n_cur{more} FROM rp WHERE feature <> 'score'"


def _frame(spark, folder, features=FEATURES):
    known = F.col(LABEL).isNotNull()
    return drift.long_frame(portfolio(spark, folder), features, known, ~known)


@query("d1_bin_edges", SCORING + "SELECT feature, CAST(i AS INT) AS i, round(edges[i], 6) AS edge FROM (SELECT feature, edges, unnest(range(1, len(edges) + 1)) AS i FROM ed) WHERE feature <> 'score'")
def _(spark, folder):
    return drift.bin_edges(_frame(spark, folder)).select("feature", F.posexplode("edges").alias("i", "edge")).withColumn("i", F.col("i") + 1)


@query("d2_psi", SCORING + "SELECT feature, round(psi, 6) AS psi, n_ref, n_cur FROM rp WHERE feature <> 'score'")
def _(spark, folder):
    frame = _frame(spark, folder)
    return drift.psi(frame, drift.bin_edges(frame))


@query("d4_ks", SCORING + "SELECT feature, round(ks, 6) AS ks, round(p_value, 6) AS p_value FROM rp WHERE feature <> 'score'")
def _(spark, folder):
    return drift.ks(_frame(spark, folder))


@query("d5_drift_report", SCORING + REPORT.format(more=""))
def _(spark, folder):
    known = F.col(LABEL).isNotNull()
    return drift.report(portfolio(spark, folder), FEATURES, known, ~known)


@query("d5_severe_features", DRIFT.format(ref="num_times_30_59_days_late = 0", cur="num_times_30_59_days_late > 0") + "SELECT coalesce(string_agg(feature, ',' ORDER BY psi DESC, feature DESC), '') AS features, CAST(count(*) AS INT) AS n_severe FROM rp WHERE feature <> 'score' AND psi >= 0.25")
def _(spark, folder):
    late = F.col("num_times_30_59_days_late")
    return drift.severe(drift.report(portfolio(spark, folder), FEATURES, late == 0, late > 0)).select(F.array_join("features", ",").alias("features"), "n_severe")


_HISTORY = "SELECT feature, round(psi, 6) AS psi, psi_class, round(ks, 6) AS ks, round(p_value, 6) AS p_value, '{mode}' AS mode, n_ref AS n_reference, n_cur AS n_current FROM rp WHERE feature <> 'score'"


@query("d7_drift_history", "SELECT * FROM (" + SCORING + _HISTORY.format(mode="scoring") + ") UNION ALL SELECT * FROM (" + SAMPLE + _HISTORY.format(mode="training_amostra") + ")")
def _(spark, folder):
    """Two runs append to one history."""
    path = shared_dir(spark) + "/history"
    rows = staged(portfolio(spark, folder).select(KEY, LABEL, *FEATURES))
    for mode in ("scoring", "training_amostra"):
        tables.append_by_date(drift.report_history(drift.mode_report(rows, FEATURES, mode, LABEL, star.hash_bucket()), mode, F.current_timestamp()), path)
    return tables.read_merged(spark, path).drop("run_at", "run_date")


@query("d2_stored_profile", SCORING + "SELECT 1 AS version, feature, round(psi, 6) AS psi, n_ref, n_cur FROM rp WHERE feature <> 'score'")
def _(spark, folder):
    """Unlabelled rows held against the labelled rows' stored profile, of which the second version is another."""
    rows, path = portfolio(spark, folder), shared_dir(spark) + "/profiles"
    known = F.col(LABEL).isNotNull()
    tables.append_once(drift.stored_profile(rows.where(known), FEATURES, 1), path, "1")
    tables.append_once(drift.stored_profile(rows.where(known & (F.col(KEY) % 2 == 0)), FEATURES, 2), path, "2")
    return drift.psi_against(spark.read.parquet(path).where("version = 1"), rows.where(~known))


@query("d2_drift_stream", SCORING + "SELECT CAST(0 AS BIGINT) AS batch, feature, round(psi, 6) AS psi, psi_class, n_ref, n_cur FROM rp WHERE feature <> 'score'")
def _(spark, folder):
    """The unlabelled rows as a stream's batch, held against the stored profile."""
    rows = portfolio(spark, folder)
    return streams.drifted(spark, drift.stored_profile(rows.where(F.col(LABEL).isNotNull()), FEATURES, 1), rows.where(F.col(LABEL).isNull()).select(KEY, *FEATURES))


@query("k5_drift_history_once", SCORING + _HISTORY.format(mode="scoring"))
def _(spark, folder):
    """One run appends its report twice; the history has it once."""
    path = shared_dir(spark) + "/history"
    report = staged(drift.report_history(drift.mode_report(portfolio(spark, folder), FEATURES, "scoring", LABEL, star.hash_bucket()), "scoring", F.current_timestamp()))
    for _ in range(2):
        tables.append_once(report, path, "2024-01-01-scoring")
    return tables.read_merged(spark, path).drop("run_at", "run_id")


for _mode, _sql, _ok in (("scoring", SCORING, "true"), ("training", SELF, "psi < 1e-9"), ("training_amostra", SAMPLE, "psi < 0.10")):

    @query(f"d6_mode_{_mode}", _sql + REPORT.format(more=f", '{_mode}' AS mode, {_ok} AS as_expected"))
    def _(spark, folder, mode=_mode):
        return drift.mode_report(portfolio(spark, folder), FEATURES, mode, LABEL, star.hash_bucket())


@query("d11_prediction_drift", SCORING + "SELECT round(psi, 6) AS psi, psi_class, (SELECT round(avg(score), 6) FROM scored WHERE target_dlq_2yrs IS NOT NULL) AS mean_ref, (SELECT round(avg(score), 6) FROM scored WHERE target_dlq_2yrs IS NULL) AS mean_cur FROM rp WHERE feature = 'score'")
def _(spark, folder):
    known = F.col(LABEL).isNotNull()
    rows = portfolio(spark, folder)
    means = rows.agg(F.avg(F.when(known, F.col(SCORE))).alias("mean_ref"), F.avg(F.when(~known, F.col(SCORE))).alias("mean_cur"))
    return rules.beside(drift.report(rows, [SCORE], known, ~known).select("psi", "psi_class"), means)


CONCEPT = LABELLED + f", pp AS (SELECT CASE WHEN {_BUCKET} < 20 THEN 'current' ELSE 'reference' END AS population, y, score AS p FROM lab)" + EVALUATE.format(by="population", src="pp")


@query("d9_concept_drift", CONCEPT + "SELECT round(a, 6) AS auc_reference, round(b, 6) AS auc_current, round(k, 6) AS ks_current, round(a - b, 6) AS auc_drop, a - b >= 0.03 AS alert FROM (SELECT max(auc) FILTER (grp = 'reference') AS a, max(auc) FILTER (grp = 'current') AS b, max(ks) FILTER (grp = 'current') AS k FROM ev)")
def _(spark, folder):
    return drift.concept(labelled(spark, folder), LABEL, SCORE, star.hash_bucket() < 20)


def _concept_sql(mode: str, reference: str, expected: str) -> str:
    return f"SELECT '{mode}' AS mode, round(a, 6) AS auc_reference, round(b, 6) AS auc_current, round(k, 6) AS ks_current, round(a - b, 6) AS auc_drop, a - b >= 0.03 AS alert, {expected} AS as_expected FROM (SELECT {reference} AS a, max(auc) FILTER (grp = 'current') AS b, max(ks) FILTER (grp = 'current') AS k FROM ev)"


def _parts(spark, folder):
    rows = labelled(spark, folder)
    return rows.where(star.hash_bucket() >= 20), rows.where(star.hash_bucket() < 20)


@query("d10_training_sample", CONCEPT + _concept_sql("treino_amostra", "max(auc) FILTER (grp = 'reference')", "a - b < 0.03"))
def _(spark, folder):
    reference, current = _parts(spark, folder)
    return drift.concept_report("treino_amostra", current, reference, LABEL, SCORE)


@query("d10_realised_outcomes", CONCEPT + _concept_sql("resultados_realizados", "round(max(auc) FILTER (grp = 'reference'), 4)", "true"))
def _(spark, folder):
    """Late labels joined to predictions; the reference AUC is the recorded one, to four places."""
    reference, late = _parts(spark, folder)
    recorded = ranking.evaluate(reference.withColumn("model", F.lit("champion")), ["model"], LABEL, SCORE).first().auc
    outcomes = late.select(KEY, LABEL)
    current = drift.realised(models.predictions(portfolio(spark, folder), "champion", "1"), outcomes, LABEL, KEY)
    return drift.concept_report("resultados_realizados", current, reference, LABEL, SCORE, round(recorded, 4))


@query("d10_outcome_stream", ORACLE_SQL["d10_realised_outcomes"])
def _(spark, folder):
    """Late labels meet predictions in a stream join; the report equals that of the batch form."""
    reference, late = _parts(spark, folder)
    recorded = ranking.evaluate(reference.withColumn("model", F.lit("champion")), ["model"], LABEL, SCORE).first().auc
    joined = streams.outcomes(spark, folder, models.predictions(portfolio(spark, folder), "champion", "1"), late)
    return drift.concept_report("resultados_realizados", joined, reference, LABEL, SCORE, round(recorded, 4))


SIMULATED = LABELLED + f", pp AS (SELECT 'reference' AS population, y, score AS p FROM lab UNION ALL SELECT 'current', y, CASE WHEN {_BUCKET} < 50 THEN 1 - score ELSE score END FROM lab)" + EVALUATE.format(by="population", src="pp")


@query("d10_no_outcomes_yet", SIMULATED + _concept_sql("simulacao", "max(auc) FILTER (grp = 'reference')", "a - b >= 0.03"))
def _(spark, folder):
    """Without late labels the mode switches to a simulated change."""
    rows = labelled(spark, folder)
    return drift.concept_report("resultados_realizados", drift.realised(models.predictions(rows, "champion", "1"), None, LABEL, KEY), rows, LABEL, SCORE, 0.8)


@query("d12_concept_history", SCORING + CONCEPT[len(PORTFOLIO_SQL) :] + "SELECT false AS simulated, 'treino_amostra' AS mode, round(a, 6) AS auc_reference, round(b, 6) AS auc_current, round(a - b, 6) AS auc_drop, round(k, 6) AS ks_current, a - b >= 0.03 AS alert, round(psi, 6) AS prediction_psi, psi_class AS prediction_class, (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE target_dlq_2yrs IS NULL) AS n_scoring FROM (SELECT max(auc) FILTER (grp = 'reference') AS a, max(auc) FILTER (grp = 'current') AS b, max(ks) FILTER (grp = 'current') AS k FROM ev), rp WHERE feature = 'score'")
def _(spark, folder):
    """A run of concept drift and of the score's own drift appends its row."""
    reference, current = _parts(spark, folder)
    rows, known = portfolio(spark, folder), F.col(LABEL).isNotNull()
    predicted = drift.report(rows, [SCORE], known, ~known)
    path = shared_dir(spark) + "/history"
    tables.append_by_date(drift.concept_history(drift.concept_report("treino_amostra", current, reference, LABEL, SCORE), predicted, rows.where(~known).count(), F.current_timestamp()), path)
    return tables.read_merged(spark, path).drop("run_at", "run_date")


@query("d13_sensitivity", LABELLED + ", pp AS (SELECT CAST(o AS INT) AS intensity, y, CASE WHEN customer_id % 6 < o THEN 1 - score ELSE score END AS p FROM lab, generate_series(0, 5) AS g(o))" + EVALUATE.format(by="intensity", src="pp") + "SELECT grp AS intensity, round(auc, 6) AS auc, round(b - auc, 6) AS auc_drop, b - auc >= 0.03 AS alert FROM ev, (SELECT auc AS b FROM ev WHERE grp = 0)")
def _(spark, folder):
    rows = labelled(spark, folder).withColumn("intensity", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = rows.withColumn("p", F.when(F.col(KEY) % 6 < F.col("intensity"), 1 - F.col(SCORE)).otherwise(F.col(SCORE)))
    return drift.sensitivity(rows, LABEL, "p", "intensity")


# Streams


@query("s1_bronze_stream", PORTFOLIO_SQL + 'SELECT target_dlq_2yrs AS "SeriousDlqin2yrs", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(monthly_income) AS BIGINT) AS n_income FROM scored GROUP BY 1')
def _(spark, folder):
    return streams.bronze(spark, folder)


#: Every tenth row came again with a greater debt ratio.
LATER = CLEAN.replace("debt_ratio, monthly_income,\n", "debt_ratio + CASE WHEN customer_id % 10 = 0 THEN 1 ELSE 0 END AS debt_ratio, monthly_income,\n")


@query("t4_silver_stream", LATER + ORACLE_SQL["p1_clean_silver"][len(CLEAN) :])
def _(spark, folder):
    return streams.silver(spark, folder)


@query("t5_newest_stream", PORTFOLIO_SQL + "SELECT customer_id, round(debt_ratio + CASE WHEN customer_id % 10 = 0 THEN 1 WHEN customer_id % 5 = 0 THEN 2 ELSE 0 END, 6) AS debt_ratio, CAST(CASE WHEN customer_id % 10 = 0 THEN 3 WHEN customer_id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS day FROM scored")
def _(spark, folder):
    return streams.newest(spark, folder)


@query("t7_gold_stream", LATER + COMBINED[len(CLEAN) :] + "SELECT customer_id, age, round(monthly_income, 6) AS monthly_income, round(debt_ratio, 6) AS debt_ratio, num_times_30_59_days_late + num_times_60_89_days_late + num_times_90_days_late AS total_delinquency_events, target_default_2yrs AS target_dlq_2yrs FROM both_")
def _(spark, folder):
    return streams.gold(spark, folder)
