"""Question intents: structural features, the network's forward pass, training and its report."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions.text import count_of

#: Marks of comparisons and of relative clauses.
COMPARISONS = (" or ", " than ", " vs ", " vs. ", " rank ", " compare ", " better ", " worse ", " more ", " less ", " difference between ", " 比 ", " 哪个 ", " 区别 ", " 差异 ")
CLAUSES = (" that ", " which ", " who ", " whose ", " where ", " 所在 ", " 位于 ")


def structure(x: Column) -> dict[str, Column]:
    """Comparison marks, clause marks, depth of "of" and length over 20 words."""
    low = F.lower(x)
    held = lambda marks: sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0))
    begins = (F.startswith(low, F.lit("compare ")) | F.startswith(low, F.lit("rank "))).cast("int")
    words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return {"comparisons": held(COMPARISONS) + begins, "clauses": held(CLAUSES), "of_depth": count_of(low, " of ") + 0.5 * count_of(low, "的"), "length": words / F.lit(20.0)}


def strategy(x: Column) -> Column:
    """What a run says it did: the part after the first arrow, else Fallback or Unknown."""
    return F.when(F.contains(x, F.lit("->")), F.trim(F.get(F.split(x, "->"), F.lit(1)))).when(F.contains(x, F.lit("Fallback")), "Fallback").otherwise("Unknown")


def intent_of(x: Column) -> Column:
    """The intent in a strategy's parentheses, older names mapped, else Default."""
    raw = F.trim(F.regexp_extract(x, r"\(([^,]+),", 1))
    return F.when(raw == "Relational", "Reasoning").when(raw.isin("Retrieval", "Comparative", "Default", "Reasoning"), raw).otherwise("Default")


def network(weights: dict[str, np.ndarray], epsilon: float = 1e-5) -> Callable:
    """Column function from ``array<double>`` features to class probabilities.

    Linear, batch normalisation by frozen statistics, ReLU, linear, softmax.  Keys: w1, b1, gamma,
    beta, mean, var, w2, b2 (matrices are output x input).  The frozen weights are a few hundred kB.
    """

    @F.pandas_udf("array<double>")
    def forward(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack(features.to_list())
        h = x @ weights["w1"].T + weights["b1"]
        h = np.maximum(0, weights["gamma"] * (h - weights["mean"]) / np.sqrt(weights["var"] + epsilon) + weights["beta"])
        z = h @ weights["w2"].T + weights["b2"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(z / z.sum(axis=1, keepdims=True)))

    return forward


def of_kinds(rows: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows whose kind is one of the wanted."""
    return rows.where(F.col(column).isin(*kinds))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``(label, weight)``: rows over classes times the class's rows, so that all classes weigh the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # over one row a class
    return counts.select(label, (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def train(rows: DataFrame, features: str = "features", label: str = "label"):
    """A multinomial classifier on ``array<double>`` features with balanced class weights, fitted distributed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    balance = class_weights(rows, label)
    ready = rows.join(F.broadcast(balance), label).select(array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.02, maxIter=60).fit(ready)


def class_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """``(label, precision, recall, f1, support)`` from one pass of confusion counts."""
    pairs = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("label"), "n", F.lit(1).alias("of"), (F.col("y") == F.col("p")).alias("hit")), F.struct(F.col("p").alias("label"), "n", F.lit(0).alias("of"), F.lit(False).alias("hit")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum(F.col("n") * F.col("of")).alias("support"), F.sum(F.col("n") * (1 - F.col("of"))).alias("said"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select("label", ratio(F.col("hits"), F.col("said")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"), "support")
