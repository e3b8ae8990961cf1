"""Extraction stages around a model provider: coreference, concepts, relations.  The provider is a plain function of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.parsing import safe_json
from quarrygraph.operators import graph, prompts
from quarrygraph.operators.providers import map_rows
from quarrygraph.operators.resolution import entity_map

CONCEPTS = "array<struct<entity:string,category:string,description:string,synonyms:array<string>>>"
RELATIONS = "array<struct<node_1:string,node_2:string,edge:string>>"


def resolved_text(chunks: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``chunks (chunk_id, text, ...)`` with ``resolved_text``: from ``resolved (chunk_id, resolved_text)``, else the text itself."""
    if resolved is None:
        return chunks.withColumn("resolved_text", F.coalesce("resolved_text", "text") if "resolved_text" in chunks.columns else F.col("text"))
    once = resolved.groupBy("chunk_id").agg(F.max("resolved_text").alias("resolved_text"))
    return chunks.drop("resolved_text").join(once, "chunk_id", "left").withColumn("resolved_text", F.coalesce("resolved_text", "text")).select(*[c for c in chunks.columns if c != "resolved_text"], "resolved_text")


def resolve_coreferences(chunks: DataFrame, call: Callable[[dict], str | None], **retry) -> DataFrame:
    """Every chunk with the provider's ``resolved_text``; where it gives none, the text itself.  ``call`` gets rows with a ``prompt``."""
    asked = chunks.select("*", prompts.coreference(F.col("text")).alias("prompt"))
    return map_rows(asked, call, **retry).withColumn("resolved_text", F.coalesce("result", "text")).drop("prompt", "result", "status")


def extract_concepts(chunks: DataFrame, call: Callable[[dict], str | None], **retry) -> DataFrame:
    """``(context_id, chunk_id, entity, category, description, synonyms)``, a row a concept that the provider names in its JSON reply."""
    asked = chunks.select("context_id", "chunk_id", prompts.concepts(F.coalesce("resolved_text", "text") if "resolved_text" in chunks.columns else F.col("text")).alias("prompt"))
    told = map_rows(asked, call, **retry).select("context_id", "chunk_id", F.explode(F.from_json(safe_json(F.col("result")), CONCEPTS)).alias("c"))
    return told.select("context_id", "chunk_id", "c.entity", "c.category", "c.description", "c.synonyms")


def extract_relations(chunks: DataFrame, mentions: DataFrame, call: Callable[[dict], str | None], **retry) -> DataFrame:
    """Conformed edges that the provider finds between the standard names of a chunk; chunks without names are not asked."""
    asked = chunks.join(entity_map(mentions), ["context_id", "chunk_id"]).where(F.size("names") > 0)
    asked = asked.select("context_id", "chunk_id", prompts.relations(F.coalesce("resolved_text", "text"), F.to_json("names")).alias("prompt"))
    told = map_rows(asked, call, **retry).select("context_id", "chunk_id", F.explode(F.from_json(safe_json(F.col("result")), RELATIONS)).alias("r"))
    return graph.conform_edges(told.select("context_id", "chunk_id", "r.node_1", "r.node_2", "r.edge"))


def question_kind(questions: DataFrame, call: Callable[[dict], str | None], kinds: tuple[str, ...] = ("Factual", "Conceptual", "Relational"), **retry) -> DataFrame:
    """Questions with the ``kind`` that the provider names, the first if it names none."""
    said = map_rows(questions.select("*", prompts.kind(F.col("question"), kinds).alias("prompt")), call, **retry)
    found = F.lit(kinds[0])
    for k in reversed(kinds):
        found = F.when(F.contains(F.lower(F.coalesce("result", F.lit(""))), F.lit(k.lower())), k).otherwise(found)
    return said.withColumn("kind", found).drop("prompt", "result", "status")
