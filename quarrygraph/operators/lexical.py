"""BM25 and containment over batches of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.text import tokens
from quarrygraph.sources.tables import bounded, cut, spread


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, query_id, id, score)`` of all documents sharing a token with a query, for ``docs (*by, id, text)`` and ``queries (*by, query_id, text)``.

    With ``by`` each of its values is a corpus of its own.  Negative idf is replaced by ``epsilon`` times
    the mean idf of the vocabulary; a token repeated in the query counts each time.  Document frequencies
    are counted over all tokens with partial sums; postings leave a task for the queries' tokens only.
    """
    by = list(by)
    words = spread(docs.select(*by, "id", "text"), "id").select(*by, "id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    # One pass: each distinct token of a document, and a row without token that carries its length.  What is
    # exploded is a column by then: an expression beside it would be evaluated again for every row.
    marked = words.select(*by, F.size("words").cast("long").alias("dl"), F.array_append(F.array_distinct("words"), F.lit(None).cast("string")).alias("kinds"))
    each = marked.select(*by, "dl", F.explode_outer("kinds").alias("t"))
    counts = cut(each.groupBy(*by, "t").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    corpus = counts.where("t IS NULL").select(*by, F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf = counts.where("t IS NOT NULL").select(*by, "t", "df")
    idf = (idf.join(corpus, by) if by else idf.join(F.broadcast(corpus))).select(*by, "t", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"), "avgdl")
    floor = idf.groupBy(*by).agg((epsilon * F.avg("idf")).alias("floor"))
    asked = queries.select(*by, "query_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy(*by, "query_id", "t").agg(F.count("*").alias("qn"))
    known = asked.join(idf, [*by, "t"])
    weighed = cut((known.join(floor, by) if by else known.join(F.broadcast(floor))).select(*by, "query_id", "t", "avgdl", (F.col("qn") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("w")))
    wanted = bounded(cut(weighed.select(*by, "t").distinct()))
    postings = words.select(*by, "id", F.size("words").alias("dl"), "words").select(*by, "id", "dl", F.explode_outer("words").alias("t")).join(wanted, [*by, "t"])
    hits = postings.groupBy(*by, "id", "dl", "t").agg(F.count("*").alias("tf")).join(bounded(weighed), [*by, "t"])
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(*by, "query_id", "id").agg(F.sum(part).alias("score"))


#: Leading characters that name the candidates of a phrase without an inner token.
GRAM = 6


def containment(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(id, phrase_id)`` where the lower-cased text of ``docs (id, text)`` contains that of ``phrases (phrase_id, phrase)``.

    A token inside a phrase (neither its first nor its last) is a whole token of every text that contains
    it, so the longest such token names a phrase's candidates and only these are searched.  Phrases
    without an inner token are found by their first ``GRAM`` characters among all such stretches of a
    text.  Both are equi-joins.  Empty phrases are contained in nothing.
    """
    low = phrases.select("phrase_id", F.lower("phrase").alias("phrase")).where("phrase <> ''")
    inner = F.slice(tokens(F.col("phrase")), 2, F.greatest(F.lit(0), F.size(tokens(F.col("phrase"))) - 2))
    longest = F.reduce(inner, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    keyed = cut(low.withColumn("t", longest))
    texts = spread(docs.select("id", "text"), "id").select("id", F.lower("text").alias("text"))
    each = texts.select("id", "text", F.array_distinct(tokens(F.col("text"))).alias("words")).select("id", "text", F.explode_outer("words").alias("t"))
    found = each.join(bounded(keyed.where("t <> ''")), "t").where(F.contains("text", "phrase")).select("id", "phrase_id")
    short = cut(keyed.where("t = ''").withColumn("t", F.substring("phrase", 1, GRAM)))
    sizes = [r["n"] for r in short.select(F.length("t").alias("n")).distinct().collect()]  # at most GRAM numbers
    if not sizes:
        return found

    def stretches(n: int):
        at = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(n)))

    grams = texts.select("id", "text", F.array_distinct(F.flatten(F.array(*map(stretches, sizes)))).alias("grams")).select("id", "text", F.explode_outer("grams").alias("t"))
    return found.unionByName(grams.join(bounded(short), "t").where(F.contains("text", "phrase")).select("id", "phrase_id"))
