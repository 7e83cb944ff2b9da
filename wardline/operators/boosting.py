"""Cost estimation by boosted one-level trees whose every number is exact, so that SQL gives the same model.

Amounts are whole cents. Rows are folded once to the distinct feature combinations with their number and sum, since a
tree of such features cannot tell rows of one combination apart; all rounds work on these. A round sums the residuals
by feature and category, orders the categories of a feature by mean residual and takes the cut that explains most, ties
to the earlier feature and the smaller left side. Either side's mean, shrunk by half, is taken off the residuals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions.identity import NULL_MARK
from wardline.functions.money import cents
from wardline.operators.cost_model import FEATURES, TARGET
from wardline.session import new_folder

ROUNDS = 5
SHRINK = 2  # a leaf is the mean residual divided by this


@dataclass
class Tree:
    """Rows whose ``feature`` is one of the categories of ``left`` (category) get ``low``, all others ``high`` cents."""

    feature: str
    left: DataFrame
    low: int
    high: int


@dataclass
class Boosted:
    base: int
    trees: list[Tree]


def floor_div(a: Column, b: Column) -> Column:
    """``a`` divided by a positive ``b``, rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, b), b)


def _keep(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession, "boost")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _category(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NULL_MARK))


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _best_cut(cells: DataFrame, features: Sequence[str]) -> tuple[dict | None, DataFrame]:
    """The best cut of all features, and (feature, category, place) of every feature's ordered categories."""
    options = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).alias("category")) for i, f in enumerate(features)))
    sums = cells.select("n", "residual", F.explode(options).alias("o")).groupBy("o.feature", "o.category").agg(F.sum("n").alias("n"), F.sum("residual").alias("r"))
    mean = floor_div(F.col("r"), F.col("n"))
    upto = W.partitionBy("feature").orderBy("mean", "category").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("feature")
    ordered = _keep(
        sums.withColumn("mean", mean).select(
            "feature", "category", F.row_number().over(W.partitionBy("feature").orderBy("mean", "category")).alias("place"),
            F.sum("n").over(upto).alias("n_low"), F.sum("r").over(upto).alias("r_low"), F.sum("n").over(whole).alias("n_all"), F.sum("r").over(whole).alias("r_all"),
        )
    )
    n_high, r_high = F.col("n_all") - F.col("n_low"), F.col("r_all") - F.col("r_low")
    gain = lambda r, n: _whole(floor_div(r, n)) * _whole(r)
    leaf = lambda r, n: floor_div(r, n * SHRINK)
    cuts = ordered.where(n_high > 0).select(
        "feature", "place", (gain(F.col("r_low"), F.col("n_low")) + gain(r_high, n_high)).alias("gain"),
        leaf(F.col("r_low"), F.col("n_low")).alias("low"), leaf(r_high, n_high).alias("high"),
    )
    best = cuts.orderBy(F.desc("gain"), "feature", "place").first()
    return best.asDict() if best else None, ordered


def _leaf(rows: DataFrame, tree: Tree, name: str) -> DataFrame:
    """``rows`` with the tree's cents as column ``name``. The categories join by their known size."""
    left = tree.left.select(F.col("category").alias("_category"), F.lit(True).alias("_left"))
    met = rows.join(left, _category(tree.feature) == F.col("_category"), "left")
    return met.withColumn(name, F.when(F.col("_left"), F.lit(tree.low)).otherwise(F.lit(tree.high)).cast("long")).drop("_category", "_left")


def fit(train: DataFrame, rounds: int = ROUNDS, features: Sequence[str] = FEATURES, target: str = TARGET) -> Boosted:
    """A model of all rows of ``train`` with a target; categories not met in training go to the ``high`` side."""
    known = train.where(F.col(target).isNotNull())
    cells = _keep(known.groupBy(*(_category(f).alias(f) for f in features)).agg(F.count("*").alias("n"), F.sum(cents(target)).alias("total")))
    n, total = cells.agg(F.sum("n"), F.sum("total")).first()
    if not n:
        return Boosted(0, [])
    base = total // n
    now, trees = cells.select(*features, "n", (F.col("total") - F.col("n") * base).alias("residual")), []
    for _ in range(rounds):
        best, ordered = _best_cut(now, features)
        if best is None:
            break
        tree = Tree(features[best["feature"]], ordered.where((F.col("feature") == best["feature"]) & (F.col("place") <= best["place"])), best["low"], best["high"])
        trees.append(tree)
        now = _keep(_leaf(now, tree, "leaf").select(*features, "n", (F.col("residual") - F.col("n") * F.col("leaf")).alias("residual")))
    return Boosted(base, trees)


def score(model: Boosted, rows: DataFrame) -> DataFrame:
    """``rows`` with ``predicted_cents``."""
    out = rows
    for i, tree in enumerate(model.trees):
        out = _leaf(out, tree, f"_leaf{i}")
    leaves = [F.col(f"_leaf{i}") for i in range(len(model.trees))]
    total = F.lit(model.base).cast("long")
    for leaf in leaves:
        total = total + leaf
    return out.withColumn("predicted_cents", total).drop(*(f"_leaf{i}" for i in range(len(model.trees))))


def errors(scored: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: rows judged, and the sum and mean of absolute errors in cents."""
    off = F.abs(cents(target) - F.col("predicted_cents"))
    found = scored.where(F.col(target).isNotNull()).agg(F.count("*").alias("rows"), F.sum(off).alias("error_cents"))
    return found.withColumn("mean_error_cents", F.try_divide(F.col("error_cents").cast("double"), F.col("rows").cast("double")))
