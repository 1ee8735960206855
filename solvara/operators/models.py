"""Models of the credit score: splits, pipelines, attribution, calibration and ablation as Spark ML jobs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import rules
from solvara.operators import boosting, isotonic, logit
from solvara.operators.ranking import equal_approval, evaluate, lowest_fraction, quantiles, running_totals
from solvara.storage import staged

LABEL, KEY = "target_dlq_2yrs", "customer_id"


def portable_hash(key: str, seed: int) -> Column:
    """A pseudo-random number below 2**31 from an integer key, the same in any SQL engine."""
    x = F.pmod(F.col(key).cast("long") * 1_103_515_245 + seed * 12_345, F.lit(2_147_483_648))
    return F.pmod(x * 69_069 + 1, F.lit(2_147_483_648))


def stratified_split(df: DataFrame, label: str = LABEL, key: str = KEY, share: float = 0.25, seed: int = 42) -> DataFrame:
    """Labelled rows with ``is_test``: of each label exactly the share of round(share * n) rows of least hash."""
    rows = df.where(F.col(label).isNotNull()).withColumn("__hash", portable_hash(key, seed))
    return lowest_fraction(rows, [label], "__hash", key, share).withColumnRenamed("approved", "is_test").drop("__hash")


def with_class_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add ``weight``: n / (2 * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    weights = counts.select(label, (F.sum("__n").over(Window.partitionBy()) / (2 * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # a row a class


def _prepared(features: list[str]) -> tuple[list, list[str]]:
    filled = [f"{c}__f" for c in features]
    return [Imputer(strategy="median", inputCols=[f"{c}__d" for c in features], outputCols=filled)], filled


def as_doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as doubles beside them, missing as NaN, and a flag of a missing one."""
    return df.withColumns({f"{c}__d": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features} | {f"{c}__m": F.col(c).isNull().cast("double") for c in features})


def logistic(train: DataFrame, features: list[str], label: str = LABEL) -> PipelineModel:
    """Median imputation, standardisation, logistic regression with balanced weights and a unit L2 penalty over all rows."""
    rows = with_class_weight(as_doubles(train, features), label)
    steps, filled = _prepared(features)
    steps += [VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=1000, regParam=1 / max(1, rows.count()), standardization=False)]
    return Pipeline(stages=steps).fit(rows)


def boosted_trees(train: DataFrame, features: list[str], label: str = LABEL, trees: int = 300, seed: int = 42) -> PipelineModel:
    """Boosted trees of depth 4: steps of 0.05, 80 % of rows and features, positives weighted by (1 - p) / p.

    Spark's trees take no missing values: medians stand in, with a flag column for each feature.
    """
    p = train.agg(F.avg(label)).first()[0]
    rows = as_doubles(train, features).withColumn("weight", F.when(F.col(label) == 1, (1 - p) / p).otherwise(1.0))
    steps, filled = _prepared(features)
    steps += [VectorAssembler(inputCols=filled + [f"{c}__m" for c in features], outputCol="features"), GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def probabilities(model: PipelineModel | logit.Logistic | boosting.Boosted, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1."""
    if isinstance(model, (logit.Logistic, boosting.Boosted)):
        return model.scored(df, name)
    out = model.transform(as_doubles(df, features))
    return out.select(*[c for c in df.columns if c != name], vector_to_array("probability")[1].alias(name))


def predictions(df: DataFrame, model_name: str, version: str, threshold: float = rules.THRESHOLD, score: str = "score") -> DataFrame:
    """The predictions table of scored, unlabelled rows; no rows give an empty table."""
    return df.select(KEY, F.col(score).alias("probability"), rules.decision(F.col(score), threshold).alias("decision"), F.lit(model_name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(threshold).alias("threshold"), F.current_timestamp().alias("run_at"))


def correlation_weights(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """(feature, weight): each feature's correlation with the label over labelled rows, 0 for a constant one."""
    one = df.where(F.col(label).isNotNull()).agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias("weight")) for c in features])))


def linear_attribution(df: DataFrame, weights: DataFrame, features: list[str]) -> DataFrame:
    """Exact attribution of a linear score on standardised features: weight * (x - mean) / sd, missing values counting as the mean.

    ``weights`` is (feature, weight): a fitted model's ``coefficients``, or ``correlation_weights``. The result is
    (customer_id, feature, value, attribution); a constant feature has 0.
    """
    long = df.select(KEY, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])))
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).join(weights, "feature")
    joined = long.join(F.broadcast(stats), "feature")  # a row a feature
    return joined.select(KEY, "feature", "value", F.coalesce(F.col("weight") * F.try_divide(F.col("value") - F.col("mean"), "sd"), F.lit(0.0)).alias("attribution"))


def importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution by feature and its rank, ties by name. The ranking is over a row a feature."""
    mean = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))).orderBy("rank")


def scorecard(df: DataFrame, weights: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """(customer_id, score): the logistic of a row's summed attributions, a model that any engine can apply."""
    total = linear_attribution(df, weights, features).groupBy(KEY).agg(F.sum("attribution").alias("z"))
    return total.select(KEY, (1 / (1 + F.exp(-F.col("z")))).alias(name))


def validated_feature(attributions: DataFrame, feature: str, least: float = 0.05) -> DataFrame:
    """One row: rank correlation of a feature with its attribution, its place in the ranking, mean attribution, and the verdict."""
    from solvara.operators.ranking import spearman

    rho = spearman(attributions.where(F.col("feature") == feature), "value", "attribution")
    place = importance(attributions).where(F.col("feature") == feature)
    status = F.when(F.col("spearman") > least, "confirmada").otherwise("refutada")
    return rules.beside(rho, place).select("feature", "spearman", "n", "rank", "mean_abs", status.alias("status"))


def relative_difference(ranked: DataFrame, a: str, b: str, least: float = 0.10) -> DataFrame:
    """(a - b) / b of two features' mean attribution, infinite where b has none; confirmed above ``least``."""
    one = ranked.agg(F.max(F.when(F.col("feature") == a, F.col("mean_abs"))).alias("mean_a"), F.max(F.when(F.col("feature") == b, F.col("mean_abs"))).alias("mean_b"))
    diff = F.when(F.col("mean_b") == 0, float("inf")).otherwise(F.try_divide(F.col("mean_a") - F.col("mean_b"), "mean_b"))
    return one.withColumn("difference", diff).withColumn("status", F.when(F.col("difference") > least, "confirmada").otherwise("refutada"))


def coefficients(model: PipelineModel | logit.Logistic, features: list[str]) -> DataFrame:
    """Coefficients of a fitted logistic model on standardised features, greatest first; a row a feature."""
    from pyspark.sql import SparkSession

    values = model.coefficients if isinstance(model, logit.Logistic) else model.stages[-1].coefficients
    rows = list(zip(features, map(float, values)))
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"))


def permutation_importance(model: PipelineModel | logit.Logistic, df: DataFrame, features: list[str], label: str = LABEL, seed: int = 1) -> DataFrame:
    """Drop of the AUC when a feature's values are dealt out anew, for all features in one long frame.

    Each row gets one donor, by joining rows on two hash orders numbered by running totals, so no task sorts all rows. It
    then stands once as it is and once for each feature with the donor's value of that.
    """
    base = staged(df.where(F.col(label).isNotNull()).select(KEY, label, *features))

    def ranked(name: str, salt: int) -> DataFrame:
        keys = base.select(F.lit(1).alias("__all"), KEY, F.xxhash64(KEY, F.lit(salt)).alias("__h"))
        frame = running_totals(keys.groupBy("__all", "__h").agg(F.min(KEY).alias(name), F.count("*").alias("n")), ["__all"], "__h", ["n"])
        return frame.select(F.col("before_n").alias("__rank"), name)

    pairs = ranked("__to", seed).join(ranked("__from", seed + 1), "__rank").drop("__rank")
    donors = base.select(F.col(KEY).alias("__from"), F.struct(*features).alias("__donor"))
    dealt = base.join(pairs.withColumnRenamed("__to", KEY), KEY).join(donors, "__from")
    variants = [F.struct(F.lit(f or "").alias("feature"), *[(F.col("__donor")[g] if g == f else F.col(g)).alias(g) for g in features]) for f in (None, *features)]
    frames = probabilities(model, dealt.select(label, F.inline(F.array(*variants))), features).select("feature", label, "score")
    aucs = evaluate(frames, ["feature"], label, "score").select("feature", "auc")
    whole = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy())
    return aucs.withColumn("auc_drop", whole - F.col("auc")).where("feature <> ''").select("feature", "auc_drop")


def calibration(df: DataFrame, by: list[str], label: str = LABEL, score: str = "score", bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """By group: (observed, mean_predicted, brier, mean_error) and the curve by quantile bin, closed on the right."""
    rows = df.where(F.col(label).isNotNull())
    counts = rows.groupBy(*by, F.col(score).alias("p")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    frame = running_totals(counts, by, "p", ["n"])
    cuts = quantiles(frame, by, "p", "n", [i / bins for i in range(bins + 1)])
    inner = F.slice("cuts", 2, bins - 1)
    binned = frame.join(F.broadcast(cuts), by)  # a row a group
    curve = binned.groupBy(*by, F.size(F.filter(inner, lambda e: e < F.col("p"))).alias("bin")).agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("predicted"), (F.sum("pos") / F.sum("n")).alias("observed"))
    error = curve.groupBy(*by).agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("mean_error"))
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    whole = frame.groupBy(*by).agg((F.sum("pos") / F.sum("n")).alias("observed"), (F.sum(p * n) / F.sum("n")).alias("mean_predicted"), (F.sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / F.sum("n")).alias("brier"))
    return whole.join(error, by), curve


def calibration_analysis(df: DataFrame, label: str = LABEL, score: str = "score", seed: int = 42) -> DataFrame:
    """Raw and isotonic scores on the half that the calibration wasn't fitted on."""
    halves = staged(stratified_split(df.select(KEY, label, score), label, KEY, 0.5, seed))
    kept = isotonic.apply(halves.where("is_test"), isotonic.fit(halves.where("not is_test"), label, score), score)
    long = kept.select(KEY, label, F.inline(F.array(F.struct(F.lit("raw").alias("kind"), F.col(score).alias("p")), F.struct(F.lit("calibrated").alias("kind"), F.col("calibrated").alias("p")))))
    return calibration(long, ["kind"], label, "p")[0]


def ablation_figures(rows: DataFrame, rate: float, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """Models of a long frame (model, customer_id, label, age, score) at equal approval.

    The first frame has a row a model: AUC, the figures of ``equal_approval``, and the ratio of denied goods of the
    youngest band to the oldest. The second has a row for each model and band: denied goods and denied rows.
    """
    marked = staged(lowest_fraction(rows, ["model"], "score", KEY, rate).withColumn("band", rules.age_band(F.col("age"))))
    bands = marked.groupBy("model", "band").agg(F.avg(F.when(F.col(label) == 0, (~F.col("approved")).cast("double"))).alias("goods_denied"), F.count_if(~F.col("approved")).alias("n_denied"))
    one = lambda b: F.max(F.when(F.col("band") == b, F.col("goods_denied")))
    ratio = bands.groupBy("model").agg(F.try_divide(one("18-30"), one("60+")).alias("young_to_old"))
    taken = marked.groupBy("model").agg(
        F.avg(F.when(F.col("approved"), F.col(label))).alias("default_approved"),
        F.count_if(~F.col("approved") & (F.col(label) == 1)).alias("bads_rejected"),
        F.count_if(~F.col("approved") & (F.col(label) == 0)).alias("goods_rejected"),
    )
    aucs = evaluate(marked, ["model"], label, "score").select("model", "auc")
    return aucs.join(taken, "model").join(ratio, "model"), bands


def without_feature(df: DataFrame, features: list[str], left_out: str = "age", rate: float = 0.75, label: str = LABEL, fit=logit.fit) -> tuple[DataFrame, DataFrame]:
    """Refit without a feature, with both models at equal approval: a summary row a model, and denied goods by age band.

    ``fit`` is ``logit.fit``, ``boosting.fit``, ``logistic`` or ``boosted_trees``. The variation is in percentage points.
    """
    split = staged(stratified_split(df.select(KEY, label, *features), label))
    train, test = split.where("not is_test"), split.where("is_test")
    long = None
    for name, used in (("all", features), (f"without_{left_out}", [f for f in features if f != left_out])):
        part = probabilities(fit(train, used, label), test, used).select(F.lit(name).alias("model"), KEY, label, "age", "score")
        long = part if long is None else long.union(part)
    summary, bands = ablation_figures(staged(long), rate, label)
    return summary, bands.groupBy("band").pivot("model", ["all", f"without_{left_out}"]).agg(F.first("goods_denied").alias("goods_denied"), F.first("n_denied").alias("n_denied")).withColumn("variation_pp", 100 * (F.col(f"without_{left_out}_goods_denied") - F.col("all_goods_denied")))


def compared(df: DataFrame, rate: float, label: str = LABEL) -> DataFrame:
    """AUC and equal-approval figures for each model of a long frame (model, customer_id, label, score)."""
    return evaluate(df, ["model"], label, "score").select("model", "auc").join(equal_approval(df, ["model"], label, "score", KEY, rate), "model")


def sampled_shapley(model: PipelineModel, df: DataFrame, features: list[str], rows: int = 2000, orders: int = 4, background: int = 100, seed: int = 3) -> DataFrame:
    """Shapley values of the score on a sample of ``rows`` rows, least by hash: (customer_id, feature, value, attribution).

    For each row and each of ``orders`` feature orders one background row is drawn by hash. Along the order the row's
    values replace the background's one by one; each change of the score goes to the feature that was replaced. Sample,
    orders and background are what the cost depends on: rows * orders * (features + 1) scores.
    """
    import random

    rng = random.Random(seed)
    ranks = [rng.sample(range(1, len(features) + 1), len(features)) for _ in range(orders)]  # step at which each feature is replaced
    sample = staged(df.select(KEY, *features).orderBy(F.xxhash64(KEY, F.lit(seed)), KEY).limit(rows))
    back = df.select(KEY, *features).orderBy(F.xxhash64(KEY, F.lit(seed + 1)), KEY).limit(background)
    named = staged(back.select((F.row_number().over(Window.orderBy(KEY)) - 1).alias("__b"), *[F.col(f).alias(f"{f}__b") for f in features]))
    size = named.count()
    if not size:
        return df.select(KEY, F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit(0.0).alias("attribution")).limit(0)
    drawn = sample.withColumn("__order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).withColumn("__b", F.pmod(F.xxhash64(KEY, "__order"), F.lit(size)).cast("int"))
    steps = drawn.join(F.broadcast(named), "__b").withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    when = F.array(*[F.array(*map(F.lit, r)) for r in ranks])[F.col("__order")]
    mix = steps.select(KEY, "__order", "__step", *[F.when(when[i] <= F.col("__step"), F.col(f)).otherwise(F.col(f"{f}__b")).alias(f) for i, f in enumerate(features)], *[F.col(f).cast("double").alias(f"{f}__own") for f in features])
    scored = probabilities(model, mix, features)
    gain = F.col("score") - F.lag("score").over(Window.partitionBy(KEY, "__order").orderBy("__step"))
    which = F.array_position(when, F.col("__step")).cast("int")
    changed = scored.withColumn("__gain", gain).where("__step > 0").select(KEY, F.element_at(F.array(*map(F.lit, features)), which).alias("feature"), F.element_at(F.array(*[F.col(f"{f}__own") for f in features]), which).alias("value"), "__gain")
    return changed.groupBy(KEY, "feature").agg(F.first("value").alias("value"), F.avg("__gain").alias("attribution"))
