"""Answer evaluation: exact and contained matches, token F1, grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions.text import contain_match, extract_final_answer, normalize_answer


#: Answers that are right as a whole or not at all.
WHOLE = ("yes", "no", "noanswer")
MEASURES = ("em", "contain", "f1", "precision", "recall")


def token_scores(rows: DataFrame, keys: list[str], pred: str, gold: str) -> DataFrame:
    """``keys`` with f1, precision and recall of the multiset overlap of normalised tokens.

    Tokens are counted by row and token with partial aggregation, so long answers cost their length;
    a marker keeps rows without tokens, which score 0.
    """

    def cut(x: str, p: int, g: int) -> Column:
        return F.transform(F.filter(F.split(F.col(x), " "), lambda w: w != ""), lambda w: F.struct(w.alias("t"), F.lit(p).alias("p"), F.lit(g).alias("g")))

    marker = F.array(F.struct(F.lit("").alias("t"), F.lit(0).alias("p"), F.lit(0).alias("g")))
    normal = rows.select(*keys, *[normalize_answer(F.coalesce(F.col(x), F.lit(""))).alias(as_) for x, as_ in ((pred, "_pred"), (gold, "_gold"))])
    # A yes, no or noanswer on either side counts only if the other says the same.
    apart = (F.col("_pred").isin(*WHOLE) | F.col("_gold").isin(*WHOLE)) & (F.col("_pred") != F.col("_gold"))
    each = normal.select(*keys, apart.alias("apart"), F.explode(F.concat(marker, cut("_pred", 1, 0), cut("_gold", 0, 1))).alias("x"))
    counts = each.groupBy(*keys, F.col("x.t").alias("t")).agg(F.sum("x.p").alias("p"), F.sum("x.g").alias("g"), F.max("apart").alias("apart"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("p", "g")).alias("same"), F.sum("p").alias("p"), F.sum("g").alias("g"), F.max("apart").alias("apart"))
    some = (F.col("same") > 0) & ~F.col("apart")
    return sums.select(
        *keys, F.when(some, 2 * F.col("same") / (F.col("p") + F.col("g"))).otherwise(0.0).alias("f1"), F.when(some, F.col("same") / F.col("p")).otherwise(0.0).alias("precision"), F.when(some, F.col("same") / F.col("g")).otherwise(0.0).alias("recall")
    )


def score_answers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows (pred_answer, gold_answer, ...)``, unique by ``keys``, with em, contain, f1, precision and recall."""
    answer = rows.withColumn("answer", extract_final_answer(F.col("pred_answer"))).withColumn("gold_answer", F.coalesce("gold_answer", F.lit("")))
    matched = answer.withColumn("em", (normalize_answer(F.col("answer")) == normalize_answer(F.col("gold_answer"))).cast("int")).withColumn("contain", contain_match(F.col("answer"), F.col("gold_answer")))
    return matched.join(token_scores(answer, keys, "answer", "gold_answer"), keys, "left")


def report(scored: DataFrame, *by: str) -> DataFrame:
    """Counts and means overall and by each column, in one pass of grouping sets."""
    means = [F.avg(c).alias(c) for c in MEASURES]
    return scored.groupingSets([[], *[[F.col(b)] for b in by]], *by).agg(F.count("*").alias("n"), *means)


#: The groups that a report always shows, in its order.
INTENT_ROWS = ("Retrieval", "Reasoning", "Comparative", "Default")
STRATEGY_ROWS = ("Agent-Zero-Shot", "Agent-Hop-1", "Agent-Hop-2", "Agent-Hop-3", "Fallback")


def full_report(scored: DataFrame, intents: tuple[str, ...] = INTENT_ROWS, strategies: tuple[str, ...] = STRATEGY_ROWS) -> DataFrame:
    """``(kind, name, place, n, share, em, contain, f1, precision, recall)`` of ``scored (intent, strategy, ...)``.

    One row for all, one for each intent and strategy; those listed come first, in their order and also
    without rows (``n`` 0, means null), then others by name.  ``share`` is the group's part of all rows,
    so the one of Fallback is the fallback rate.
    """
    found = scored.groupingSets([[], [F.col("intent")], [F.col("strategy")]], "intent", "strategy").agg(
        F.grouping("intent").alias("gi"), F.grouping("strategy").alias("gs"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in MEASURES]
    )
    kind = F.when((F.col("gi") == 1) & (F.col("gs") == 1), "all").when(F.col("gi") == 0, "intent").otherwise("strategy")
    name = F.when(F.col("gi") == 0, F.col("intent")).when(F.col("gs") == 0, F.col("strategy")).otherwise("all")
    rows = found.select(kind.alias("kind"), name.alias("name"), "n", *MEASURES)
    listed = [("all", "all", 0), *[("intent", x, i) for i, x in enumerate(intents)], *[("strategy", x, i) for i, x in enumerate(strategies)]]
    shown = scored.sparkSession.createDataFrame(listed, "kind string, name string, place int")
    both = shown.join(rows, ["kind", "name"], "full")
    total = F.max(F.when(F.col("kind") == "all", F.coalesce("n", F.lit(0)))).over(Window.partitionBy(F.lit(0)))  # a row a group
    n = F.coalesce("n", F.lit(0)).cast("long")
    return both.select("kind", "name", "place", n.alias("n"), F.when(total > 0, n / total).alias("share"), *MEASURES)
