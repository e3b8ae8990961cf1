"""Answering questions end to end: link, route, weigh, walk, gather evidence, fall back; all questions in one plan a step.

The model's part is a provider.  Without one, replies follow a fixed policy: the walk takes the best
edges, a question with path evidence is answered at its deepest hop, any other by fallback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import intent
from quarrygraph.functions.text import after_marker
from quarrygraph.operators import prompts, retrieval
from quarrygraph.operators.dense import dense_top_k
from quarrygraph.operators.intents import structure
from quarrygraph.operators.lexical import bm25
from quarrygraph.operators.providers import map_rows
from quarrygraph.operators.ranking import top_k
from quarrygraph.sources.tables import cut

#: What a question without seeds is answered by the engine over all contexts.
NO_SEEDS = "Sorry, no relevant entities found in the knowledge graph."


def question_weights(questions: DataFrame, weights=intent.WEIGHTS, default=intent.DEFAULT) -> DataFrame:
    """``(query_id, tag, w_f, w_s, w_e)`` of ``questions (query_id, text, probs array<double>)``."""
    f = structure(F.col("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    m = intent.modulate(*[F.get("probs", F.lit(i)) for i in range(3)], f["comparisons"], f["clauses"], words)
    mixed = questions.select("query_id", m.alias("m"))
    return mixed.select("query_id", intent.intent_tag(F.col("m")).alias("tag"), intent.mixed_weights(F.col("m"), weights, default).alias("w")).select("query_id", "tag", "w.*")


def fallback(questions: DataFrame, chunks: DataFrame, active: DataFrame, widen: bool = True, k: int = 3) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` by BM25 and dense rank over the chunks of a question's active contexts.

    A question whose contexts own no chunk reads all chunks by BM25 alone if it had contexts, by both if it
    had none; without ``widen`` it reads none.
    """
    texts = chunks.select(F.col("chunk_id").cast("long").alias("id"), F.col("context_id").cast("string").alias("context_id"), "text", "embedding")
    inside = cut(texts.join(active.select("query_id", F.col("context_id").cast("string").alias("context_id")).distinct(), "context_id").select("query_id", "id", "text", "embedding"))
    similar = F.coalesce(retrieval.cosine(F.col("embedding"), F.col("q"), retrieval.EPSILON), F.lit(-1.0)).alias("score")
    asked = questions.select(F.col("query_id").alias("corpus"), "query_id", "text")
    lex = bm25(inside.select(F.col("query_id").alias("corpus"), "id", "text"), asked, by=["corpus"]).select("query_id", "id", "score")
    dense = inside.join(questions.select("query_id", "q"), "query_id").select("query_id", "id", similar)
    if widen:
        rest = cut(questions.select("query_id", "text", "q").join(inside.select("query_id").distinct(), "query_id", "left_anti"))
        if not rest.isEmpty():
            # A stated question set against all chunks: ids and scores only.
            had = rest.join(active.select("query_id").distinct().withColumn("had", F.lit(True)), "query_id", "left")
            own = had.select("query_id", F.when(F.col("had").isNull(), F.col("q")).alias("q"))
            lex = lex.unionByName(bm25(texts.select("id", "text"), rest.select("query_id", "text")))
            dense = dense.unionByName(own.crossJoin(texts.select("id", "embedding")).select("query_id", "id", similar))
    return retrieval.fallback_rank(lex, dense, k).withColumnRenamed("id", "chunk_id")


def naive_answers(questions: DataFrame, chunks: DataFrame, k: int = 3, call: Callable[[dict], str | None] | None = None) -> DataFrame:
    """``(query_id, references, prompt, answer, strategy)`` from the ``k`` chunks nearest by vector over all contexts."""
    near = dense_top_k(chunks.withColumn("chunk_id", F.col("chunk_id").cast("long")), questions, k, (("embedding", "q", 1.0),), item_key="chunk_id")
    told = questions.select("query_id", "text").join(retrieval.references(near.withColumnRenamed("id", "chunk_id"), chunks), "query_id", "left")
    asked = told.select("query_id", "references", prompts.grounded(F.col("text"), None, F.col("references")).alias("prompt"))
    return _answered(asked, call).withColumn("strategy", F.lit("Naive-Vector"))


def direct_answers(questions: DataFrame, call: Callable[[dict], str | None], caught: bool = True, **retry) -> DataFrame:
    """``(query_id, pred_answer, strategy)`` of the model alone; a failed call is an ``ERROR: ...`` answer if ``caught``, else null."""
    said = map_rows(questions.select("query_id", prompts.direct(F.col("text")).alias("prompt")), call, **retry)
    failed = ~F.col("status").isin("ok", "empty")
    answer = F.when(failed, F.concat(F.lit("ERROR: "), "status") if caught else F.lit(None)).otherwise(F.trim("result"))
    return said.select("query_id", answer.alias("pred_answer"), F.when(failed, "error").otherwise("baseline_direct_query").alias("strategy"))


def _answered(asked: DataFrame, call: Callable[[dict], str | None] | None) -> DataFrame:
    if call is None:
        return asked.withColumn("answer", F.lit(None).cast("string"))
    return map_rows(asked, call).withColumn("answer", after_marker(F.col("result"))).drop("result", "status")


def solve(
    questions: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, mode: str = "full", scope: str = "global", hops: int = 3,
    call: Callable[[dict], str | None] | None = None, weights=intent.WEIGHTS, default=intent.DEFAULT,
) -> DataFrame:
    """``(query_id, answer, strategy, prompt)`` of every question.

    ``questions (query_id, text, context_id, q, name_vector, desc_vector, probs)``; ``entities (id,
    context_id, node, names, text, name_vector, desc_vector, description, category, synonyms)``; ``edges``
    as :func:`graph.hybrid_edges`; ``chunks (chunk_id, context_id, text, embedding[, title_embedding])``.

    ``mode``: full, explicit_only (weights that follow explicit edges) or vector_only (retrieval alone).
    ``scope`` global links over all entities, 25 a question, routes to one context and starts from at most
    5 seeds; local links inside the question's context, 10 a question, all of them seeds, and never reads
    beyond that context in fallback.  Without seeds the global engine says so ("No-Seeds"), the local one
    keeps its intent; local vector_only needs no seeds.
    """
    if mode not in ("full", "explicit_only", "vector_only") or scope not in ("global", "local"):
        raise ValueError(f"unknown mode {mode} or scope {scope}")
    local = scope == "local"
    linked = retrieval.link_entities(entities, questions, k=10 if local else 25, local=local)
    named = linked.join(entities.select("id", F.col("node").alias("entity")), "id").groupBy("query_id", "entity").agg(F.min("rank").alias("rank"))
    if local:
        active = questions.select("query_id", F.col("context_id").cast("string").alias("context_id")).dropna()
        seeds = cut(named)
    else:
        routed = cut(retrieval.route_contexts(named, edges, chunks, questions.select("query_id", "q")))
        active = routed.select("query_id", "context_id").dropna().distinct()
        seeds = cut(top_k(routed.withColumnRenamed("rank", "place"), 5, ["query_id"], [F.asc("place")]).select("query_id", "entity"))
    vectors = entities.groupBy("node").agg(F.max_by(F.struct("name_vector", "desc_vector"), "id").alias("v")).select("node", F.col("v.name_vector").alias("vec_entity"), F.col("v.desc_vector").alias("vec_desc"))
    starts = seeds.select("query_id", F.col("entity").alias("node"))
    w = cut(question_weights(questions, weights, default))
    with_seeds = seeds.select("query_id").distinct()
    ranked = cut(fallback(questions, chunks, active, widen=not local))
    definitions = retrieval.node_definitions(starts, entities.select(F.col("id").alias("ord"), F.col("node").alias("standard_entity"), "description", "category", "synonyms"))
    background = definitions.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "node", F.lit(": "), "definition"))), "\n").alias("definitions"))
    if mode == "vector_only":
        tags = questions.select("query_id", F.lit("Vector-RAG").alias("strategy"))
        chosen = ranked.select("query_id", "chunk_id", "rank")
    else:
        by_question = w if mode == "full" else w.select("query_id", "tag", *[F.lit(x).alias(n) for n, x in zip(("w_f", "w_s", "w_e"), intent.EXPLICIT_ONLY, strict=True)])
        paths = cut(retrieval.walk(starts, edges, vectors, questions.select("query_id", "q"), active, by_question.drop("tag"), hops=hops))
        focus = starts.unionByName(paths.select("query_id", F.col("v").alias("node"))).distinct()
        found = cut(retrieval.evidence(paths.select("query_id", "u", "v").distinct(), focus, edges, chunks, questions.select("query_id", "q"), active))
        walked = found.where("label = 'Path Evidence'").select("query_id").distinct()
        deepest = paths.join(walked, "query_id").groupBy("query_id").agg(F.max("hop").alias("hop"))
        stage = F.when(F.col("hop").isNotNull(), F.concat(F.lit("Agent-Hop-"), F.col("hop").cast("string"))).otherwise("Fallback")
        tags = w.join(deepest, "query_id", "left").join(with_seeds.withColumn("seeded", F.lit(True)), "query_id", "left").select("query_id", F.when(F.lit(local) & F.col("seeded").isNull(), F.col("tag")).otherwise(F.concat("tag", F.lit(" -> "), stage)).alias("strategy"))
        rest = ranked.join(deepest, "query_id", "left_anti").select("query_id", "chunk_id", "rank")
        chosen = found.join(deepest, "query_id", "left_semi").select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "rank").unionByName(rest)
    asked = questions.select("query_id", "text").join(tags, "query_id").join(background, "query_id", "left").join(retrieval.references(chosen, chunks), "query_id", "left")
    asked = asked.select("query_id", "strategy", prompts.grounded(F.col("text"), F.col("definitions"), F.col("references")).alias("prompt"))
    out = _answered(asked, call)
    if local and mode == "vector_only":
        return out.select("query_id", "answer", "strategy", "prompt")
    lost = out.join(with_seeds.withColumn("seeded", F.lit(True)), "query_id", "left")
    none = F.col("seeded").isNull()
    return lost.select("query_id", F.when(none, NO_SEEDS).otherwise(F.col("answer")).alias("answer"), F.when(none & F.lit(not local), "No-Seeds").otherwise(F.col("strategy")).alias("strategy"), "prompt")


def results(questions: DataFrame, solved: DataFrame) -> DataFrame:
    """The stored table ``(question, gold_answer, pred_answer, strategy, context_id)`` in the questions' order, ready to score."""
    joined = questions.join(solved, "query_id", "left").orderBy("query_id")
    return joined.select(F.col("text").alias("question"), "gold_answer", F.col("answer").alias("pred_answer"), "strategy", "context_id")


