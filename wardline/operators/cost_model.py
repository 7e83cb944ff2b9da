"""Cost estimation: hash split, hash sample of the training part, boosted trees on categorical features, batch scoring.

The split is made on the whole table. Fitting uses at most about ``FIT_ROWS`` training rows; every held-out row is judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import orderstat
from wardline.functions.identity import hash_below
from wardline.functions.money import cents

# Model inputs, target, sample size, share of training rows, seed.
FEATURES = [
    "age_group",
    "gender",
    "type_of_admission",
    "ccsr_diagnosis_code",
    "apr_severity_of_illness_desc",
    "apr_risk_of_mortality",
    "apr_medical_surgical_desc",
    "emergency_department_indicator",
    "payment_typology_1",
]
TARGET = "total_costs"
# About so many training rows are used to fit, whatever the size of the table.
FIT_ROWS = 20_000
TRAIN_SHARE = 0.8
SEED = 42


def hash_sample(fact: DataFrame, rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """About ``rows`` rows, chosen by row hash: the same ones under any partitioning.

    The expected size is fixed, so what is trained on does not grow with the table.
    """
    return fact.where(hash_below(F.col("row_hash"), rows / max(fact.count(), 1), seed))


def split(rows: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_train``; decided per row hash with another seed than the sample."""
    return rows.withColumn("is_train", hash_below(F.col("row_hash"), share, seed + 1))


def train_test(fact: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A sample of the training rows, and all held-out rows."""
    marked = split(fact.where(F.col(TARGET).isNotNull()).select("row_hash", TARGET, *FEATURES), seed=seed)
    return hash_sample(marked.where("is_train"), fit_rows, seed), marked.where("NOT is_train")


def train_rows(fact: DataFrame, seed: int = SEED) -> DataFrame:
    return train_test_whole(fact, seed)[0]


def train_test_whole(fact: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """All training rows and all held-out rows."""
    marked = split(fact.where(F.col(TARGET).isNotNull()).select("row_hash", TARGET, *FEATURES), seed=seed)
    return marked.where("is_train"), marked.where("NOT is_train")


def exact_sample(rows: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (all, if fewer): those with the smallest hash draws, whatever the partitioning.

    Histograms of the draws' first digits find the last draw that is taken, so nothing is sorted as a whole.
    """
    draw = F.sha2(F.concat("row_hash", F.lit(f":{seed}")), 256)
    last = orderstat.draw_below(rows, draw, size)
    return rows if last is None else rows.where(draw <= F.lit(last))


def exact_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the median cost in cents of all training rows, and the sum of twice the held-out rows' distances to it.

    Twice the median is a whole number of cents, so both figures are exact.
    """
    middle = orderstat.median(train, cents(TARGET))
    twice = F.lit(None if middle is None else int(2 * middle)).cast("long")
    known = train.agg(F.count(TARGET).alias("train_rows"))
    held = test.agg(F.count(TARGET).alias("test_rows"), F.sum(F.abs(2 * cents(TARGET) - twice)).alias("twice_error_cents"))
    return held.select(known.scalar().alias("train_rows"), F.lit(middle).cast("double").alias("median_cents"), "test_rows", "twice_error_cents")


def median_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the training median and its mean absolute error on the test rows.

    The exact median works on the sample, whose size is bounded.
    """
    cost = F.col(TARGET).cast("double")
    median = train.agg(F.median(cost).alias("m"))
    value = median.scalar()
    return test.agg(
        F.count("*").alias("test_rows"),
        F.max(value).alias("train_median"),
        F.round(F.avg(F.abs(cost - value)), 4).alias("baseline_mae"),
    )


def fit(train: DataFrame, max_iter: int = 20, max_depth: int = 5, seed: int = SEED) -> PipelineModel:
    """Indexers are fitted on the training rows only; the target is learned on a log scale."""
    indexed = [f"{c}_index" for c in FEATURES]
    indexer = StringIndexer(inputCols=FEATURES, outputCols=indexed, handleInvalid="keep").fit(train)
    widest = max(len(labels) for labels in indexer.labelsArray) + 1
    trees = GBTRegressor(
        featuresCol="features",
        labelCol="log_cost",
        predictionCol="log_prediction",
        maxIter=max_iter,
        maxDepth=max_depth,
        maxBins=max(32, widest),
        seed=seed,
    )
    pipeline = Pipeline(stages=[indexer, VectorAssembler(inputCols=indexed, outputCol="features"), trees])
    return pipeline.fit(train.withColumn("log_cost", F.log1p(F.col(TARGET).cast("double"))))


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ("row_hash",)) -> DataFrame:
    """``predicted_cost`` per row. Columns beyond the features and the kept ones are refused."""
    unknown = [c for c in rows.columns if c not in FEATURES and c not in keep]
    missing = [c for c in FEATURES if c not in rows.columns]
    if unknown or missing:
        raise ValueError(f"unknown fields {unknown}, missing fields {missing}")
    predicted = model.transform(rows).withColumn("predicted_cost", F.expm1("log_prediction"))
    return predicted.select(*keep, "predicted_cost")


def evaluate(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    """Held-out MAE, RMSE and R squared in cost units."""
    scored = score(model, test.drop("is_train"), keep=("row_hash", TARGET))
    label = F.col(TARGET).cast("double")
    off = F.col("predicted_cost") - label
    one_pass = scored.agg(F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), (1 - F.try_divide(F.avg(off * off), F.var_pop(label))).alias("r2"))
    return one_pass.first().asDict()


def category_index(train: DataFrame) -> DataFrame:
    """``feature, category, index`` as the fitted indexer has them: most frequent first, ties by value."""
    fitted = StringIndexer(inputCols=FEATURES, outputCols=[f"{c}_index" for c in FEATURES], handleInvalid="keep").fit(train)
    rows = [(f, label, i) for f, labels in zip(FEATURES, fitted.labelsArray) for i, label in enumerate(labels)]
    return train.sparkSession.createDataFrame(rows, "feature string, category string, index int")


def train_and_evaluate(fact: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SEED) -> tuple[PipelineModel, dict]:
    train, test = train_test(fact, fit_rows, seed)
    train, test = train.persist(), test.persist()
    try:
        model = fit(train, seed=seed)
        metrics = evaluate(model, test)
        baseline = median_baseline(train, test).first()
        metrics["baseline_mae"] = baseline["baseline_mae"]
        metrics["train_rows"], metrics["test_rows"] = train.count(), test.count()
    finally:
        train.unpersist()
        test.unpersist()
    return model, metrics
