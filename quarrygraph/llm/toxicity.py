"""Toxicity severity by cumulative-link ordinal regression over sparse words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, small_batches, to_batch
from quarrygraph.sources.tables import cut, table

WORD = regex.compile(r"\p{L}+")
#: Lengths of the word beginnings that are features besides whole words.
STARTS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """P(grade > j) = sigmoid(x . weights - cuts[j]), the weights shared by all ascending cuts."""

    words: tuple[str, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]


def features(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text, and the beginnings of longer ones marked with ^."""
    words = set(WORD.findall((text or "").lower()))
    return words | {"^" + w[:k] for k in STARTS for w in words if len(w) > k}


def negative_log_likelihood(model: Model, rows: list[list[int]], grades: list[int], weights: list[float]) -> float:
    """What :func:`fit` minimises, without the ridge."""
    total = 0.0
    for row, grade, weight in zip(rows, grades, weights, strict=True):
        above = [1.0, *(1 / (1 + np.exp(c - sum(model.weights[i] for i in row))) for c in model.cuts), 0.0]
        total -= weight * np.log(above[grade] - above[grade + 1])
    return total / sum(weights)


def fit(rows: list[list[int]], grades: list[int], words: list[str], ridge: float = 0.0005, steps: int = 1500, weights: list[float] | None = None) -> Model:
    """Proportional-odds fit by gradient steps with momentum (Adam); cuts are kept ascending as a first cut and positive gaps.

    Rows of equal features and grade are one row; ``weights`` say how many rows each stands for.
    """
    k, v = max(grades, default=0), len(words)
    counted: Counter = Counter()
    for row, grade, weight in zip(rows, grades, weights or [1.0] * len(rows), strict=True):
        counted[tuple(sorted(row)), grade] += weight
    rows, grades, n = [list(row) for row, _ in counted], [grade for _, grade in counted], len(counted)
    weight = np.array(list(counted.values()), dtype=float) / max(1.0, sum(counted.values()))
    if not n or not k or not v:
        return Model(tuple(words), (0.0,) * v, ())
    x = np.zeros((n, v))
    for i, found in enumerate(rows):
        x[i, found] = 1.0
    y = np.array(grades)
    above = (y[:, None] > np.arange(k)[None, :]).astype(float)
    share = np.clip(weight @ above, 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    theta = np.concatenate([np.zeros(v), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[v + 1 :])
        cuts = theta[v] + np.concatenate([[0.0], np.cumsum(gaps)])
        # Cumulative probabilities padded with 1 and 0; P(grade) is the difference of two.
        p = 1 / (1 + np.exp(-np.clip(x @ theta[:v], -30, 30)[:, None] + cuts[None, :]))
        high = np.concatenate([np.ones((n, 1)), p], axis=1)[np.arange(n), y]
        low = np.concatenate([p, np.zeros((n, 1))], axis=1)[np.arange(n), y]
        of = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / of, low * (1 - low) / of
        slope = -(up - down) * weight  # of the loss, by x . weights
        by_cut = np.zeros(k)
        np.add.at(by_cut, y[y > 0] - 1, (up * weight)[y > 0])
        np.add.at(by_cut, y[y < k], -(down * weight)[y < k])
        tail = by_cut[::-1].cumsum()[::-1]
        grad = np.concatenate([x.T @ slope + ridge * theta[:v], tail[:1], tail[1:] * gaps])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    cuts = theta[v] + np.concatenate([[0.0], np.cumsum(np.exp(theta[v + 1 :]))])
    return Model(tuple(words), tuple(map(float, theta[:v])), tuple(map(float, cuts)))


SAMPLED_DDL = "digest string, y int, words array<string>"


def _sample(df: DataFrame, labels: DataFrame, most: int, doc_id: str, text: str, toxic: str) -> tuple[DataFrame, dict[int, int]]:
    """``(digest, y, words)`` of about ``most`` labelled documents of each class, and how many labels each class has.

    A hash of the id chooses, by a bound that the class's size sets, so every label may be chosen and no
    task sends more than its share.  The chosen ids (a bounded number) are broadcast: no text is shuffled.
    """
    told = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("y")).dropna().groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    chosen = told.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < share * (1 << 30))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            words = [sorted(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["digest", "y", "words"])

    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    found = texts.select(F.md5("text").alias("digest"), "y", "text").mapInArrow(read, SAMPLED_DDL)
    # Copies of a text are one observation, toxic if any copy is.
    return cut(found.groupBy("digest").agg(F.max("y").alias("y"), F.first("words").alias("words"))), sizes


def grade(held: list[list[int]], y: list[int], n_words: int, halves: list[int]) -> list[int]:
    """Severity grades of labelled rows: 0 for not toxic, 1 to 3 for toxic ones by thirds of a margin that other rows set.

    The margin is the log-odds of the words a row holds, by the smoothed shares of toxic and other rows
    of the other half, so no row has a part in its own grade.
    """
    counts = np.ones((2, 2, n_words))  # half, class, word
    sizes = np.full((2, 2), 2.0)
    for row, label, half in zip(held, y, halves, strict=True):
        counts[half, label, row] += 1
        sizes[half, label] += 1
    odds = np.log(counts[:, 1] / sizes[:, 1, None]) - np.log(counts[:, 0] / sizes[:, 0, None])
    margins = np.array([odds[1 - half, row].sum() for row, half in zip(held, halves, strict=True)])
    toxic = margins[np.array(y) == 1]
    thirds = np.quantile(toxic, [1 / 3, 2 / 3]) if len(toxic) else [0.0, 0.0]
    return [0 if label == 0 else 1 + int(m > thirds[0]) + int(m > thirds[1]) for label, m in zip(y, margins, strict=True)]


def learn(df: DataFrame, labels: DataFrame, max_words: int = 400, max_rows: int = 10_000, least_ratio: float = 20.0, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from about ``max_rows`` labelled documents of each class, a bound on the rows to learn from only.

    The vocabulary are the ``max_words`` words and beginnings of words that toxic documents hold more
    often than others with the largest log-likelihood ratio, at least ``least_ratio``.  Labels say
    toxic or not; severity grades are set by held-out margins (:func:`grade`).  Rows stand for as many
    labels as their class's share of the sample says.  Labels that are null or have no document do not
    count; an id with several labels is toxic if one says so.
    """
    rows, labelled = _sample(df, labels, max_rows, doc_id, text, toxic)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model((), (), ())
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g")).where("b >= 2")
    # Log-likelihood ratio of the word's two shares against one common share.
    n, b, g = F.lit(float(bad + good)), F.col("b"), F.col("g")

    def part(seen: F.Column, size: float) -> F.Column:
        share = (b + g) / n
        held, not_held = F.when(seen > 0, seen * F.log(seen / (size * share))).otherwise(0.0), F.when(seen < size, (size - seen) * F.log((size - seen) / (size * (1 - share)))).otherwise(0.0)
        return held + not_held

    ratio = 2 * (part(b, float(bad)) + part(g, float(good)))
    top = counts.where((b / bad > g / good) & (b + g < n)).withColumn("ratio", ratio).where(F.col("ratio") > least_ratio).orderBy(F.desc("ratio"), "word").limit(max_words).collect()
    words = [r["word"] for r in top]
    if not words:
        return Model((), (), ())
    held = F.array_intersect("words", F.array(*map(F.lit, words)))
    sample = sorted(rows.select("digest", "y", held.alias("held")).collect(), key=lambda r: r["digest"])
    at = {w: i for i, w in enumerate(words)}
    found, y = [[at[w] for w in r["held"]] for r in sample], [r["y"] for r in sample]
    grades = grade(found, y, len(words), [int(r["digest"][:1], 16) & 1 for r in sample])
    return fit(found, grades, words, weights=[labelled[label] / sizes[label] for label in y])


SEVERITY = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])


def score(df: DataFrame, model: Model, threshold: float = 0.2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, toxic)`` of every row.

    ``severity`` is the expected grade, ``toxic`` whether P(grade > 0) reaches ``threshold``, and
    ``grade`` the likeliest of 1 and more if it does (ties: the lower), else 0.  Null and empty texts are scored as texts without words;
    without a model all are null and not toxic.  Rows are independent.
    """
    index = dict(zip(model.words, model.weights, strict=True))
    cuts = np.array(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.keys()
        begun = {k: {w[1:] for w in known if w[0] == "^" and len(w) == k + 1} for k in STARTS}
        for batch in small_batches(batches):
            out: dict[str, list] = {f.name: [] for f in SEVERITY}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(cuts):
                    words = set(WORD.findall((value or "").lower()))
                    held = known & words  # the features that the model knows, as :func:`features` makes them
                    for k in STARTS:
                        held |= {"^" + w for w in begun[k] & {w[:k] for w in words if len(w) > k}}
                    p = 1 / (1 + np.exp(cuts - sum(index[w] for w in sorted(held))))
                    each = np.append(1.0, p) - np.append(p, 0.0)
                    row = (doc, float(p.sum()), float(p[0]), 1 + int(each[1:].argmax()) if p[0] >= threshold else 0, bool(p[0] >= threshold))
                else:
                    row = (doc, None, None, None, False)
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield to_batch(out, SEVERITY)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
