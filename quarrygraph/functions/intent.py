"""Intent weights by arithmetic on class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of implicit, semantic and explicit evidence for each intent, and the default ones.
INTENTS = ("Retrieval", "Reasoning", "Comparative")
WEIGHTS = ((0.10, 0.40, 0.50), (0.15, 0.30, 0.55), (0.10, 0.25, 0.65))
DEFAULT = (0.15, 0.40, 0.45)
#: Weights that follow explicit edges only.
EXPLICIT_ONLY = (0.0, 0.0, 1.0)


def modulate(p0: Column, p1: Column, p2: Column, comparatives: Column, clauses: Column, words: Column, threshold: float = 0.60) -> Column:
    """Struct of renormalised probabilities, their largest value and the intent (or Default below the threshold)."""
    a = F.when((clauses == 0) & (words < 10), p0 * 1.2).otherwise(p0)
    c = F.when(comparatives == 0, p2 * 0.1).otherwise(p2)
    total = a + p1 + c
    q = [a / total, p1 / total, c / total]
    top = F.greatest(*q)
    name = F.when(top < threshold, "Default").when(q[0] == top, INTENTS[0]).when(q[1] == top, INTENTS[1]).otherwise(INTENTS[2])
    return F.struct(q[0].alias("p0"), q[1].alias("p1"), q[2].alias("p2"), top.alias("top"), name.alias("intent"))


def mixed_weights(modulated: Column, weights: tuple[tuple[float, ...], ...] = WEIGHTS, default: tuple[float, ...] = DEFAULT) -> Column:
    """Struct ``w_f, w_s, w_e``: the intents' weights mixed by probability, or the default ones for the default intent."""
    sure = modulated["intent"] != "Default"
    mixed = [sum(modulated[f"p{i}"] * weights[i][j] for i in range(3)) for j in range(3)]
    return F.struct(*[F.when(sure, mixed[j]).otherwise(default[j]).alias(name) for j, name in enumerate(("w_f", "w_s", "w_e"))])


def intent_tag(modulated: Column) -> Column:
    """``(Intent, P=0.87)``."""
    return F.format_string("(%s, P=%.2f)", modulated["intent"], modulated["top"])
