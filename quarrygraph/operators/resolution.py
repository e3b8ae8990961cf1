"""Entity resolution: synonyms, clusters within a context and category, standard names, mapping and merged concepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.functions.text import generation, rich_input
from quarrygraph.operators.components import connected_components
from quarrygraph.operators.dense import close_links
from quarrygraph.operators.persons import merge_persons
from quarrygraph.sources.tables import cut

#: How far apart two names of one entity may lie (1 - cosine, strictly less), by category.
RADII = {
    "Person": 0.05, "Organization": 0.08, "Location": 0.05, "Structure": 0.05, "Natural": 0.08, "Work": 0.05, "Event": 0.05,
    "Time": 0.01, "Quantity": 0.01, "Product": 0.05, "Award": 0.05, "Role": 0.08, "Concept": 0.08, "Group": 0.08,
}
DEFAULT_RADIUS = 0.10


def radius_of(category: Column, radii: dict[str, float] = RADII, default: float = DEFAULT_RADIUS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in radii.items() for x in pair])
    return F.coalesce(table[category], F.lit(default))


def _names(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def rich_entities(mentions: DataFrame) -> DataFrame:
    """``(context_id, entity, category, ord, synonyms, rich_text)``: one row a name, its synonyms and itself sorted and joined by bars.

    ``ord`` is the first mention's.  Mentions without context, name or category do not count.
    """
    named = mentions.dropna(subset=["context_id", "entity", "category"])
    all_names = F.array_distinct(F.flatten(F.collect_list(F.array_append(_names("synonyms"), F.col("entity")))))
    joined = F.array_join(F.array_sort(F.filter(all_names, lambda s: s.isNotNull() & (s != ""))), " | ")
    rows = named.groupBy("context_id", "entity", "category").agg(F.min("ord").alias("ord"), joined.alias("synonyms"))
    return rows.withColumn("rich_text", rich_input(F.col("entity"), F.col("synonyms")))


def cluster_entities(entities: DataFrame, radii: dict[str, float] = RADII, default: float = DEFAULT_RADIUS) -> DataFrame:
    """``entities (context_id, category, entity, ord, vector)`` with ``cluster_id`` and ``standard``.

    Single linkage within a context and category, cut at the category's radius; persons of different
    generations are never close themselves (a third name may still join them).  Clusters are numbered
    from 0 within a context, by category and first name; a cluster's standard name is its longest, the
    first of them on a tie.
    """
    apart = F.when(F.col("category") == "Person", generation(F.col("entity")))
    rows = entities.withColumn("radius", radius_of(F.col("category"), radii, default)).withColumn("generation", apart)
    found = connected_components(close_links(rows, ["context_id", "category"], key="ord", apart="generation"))
    joined = entities.join(found, F.col("ord") == F.col("node"), "left").withColumn("component", F.coalesce("component", F.col("ord"))).drop("node")
    number = F.dense_rank().over(Window.partitionBy("context_id").orderBy("category", "component")) - 1
    longest = joined.groupBy("context_id", "category", "component").agg(F.min_by("entity", F.struct(-F.length("entity"), F.col("ord"))).alias("standard"))
    return joined.withColumn("cluster_id", number.cast("long")).join(longest, ["context_id", "category", "component"]).drop("component")


def standardize_entities(mentions: DataFrame, embed: Callable[[Column], Column] | None = None, radii: dict[str, float] = RADII, default: float = DEFAULT_RADIUS, empty_names_match: bool = False) -> DataFrame:
    """``mentions (ord, context_id, entity, category, synonyms, ...)`` with ``standard_entity`` and ``cluster_id``.

    Names are trimmed, given their synonyms and embedded (``embed`` of the rich text, or the first
    mention's ``vector``), clustered (:func:`cluster_entities`), and persons whose cleaned names hold
    each other take the longer name (their clusters stay).  A mention that no name stands for keeps its
    own and cluster -1.
    """
    trimmed = mentions.withColumn("entity", F.trim(F.col("entity").cast("string"))).withColumn("category", F.trim(F.col("category").cast("string")))
    unique = rich_entities(trimmed)
    if embed is not None:
        vectors = unique.withColumn("vector", embed(F.col("rich_text")))
    else:
        vectors = unique.join(trimmed.select("ord", "vector"), "ord")
    entities = cluster_entities(cut(vectors.select("context_id", "category", "entity", "ord", "vector")), radii, default)
    named = merge_persons(entities.select("context_id", "ord", "entity", "category", "standard", "cluster_id"), empty_names_match=empty_names_match)
    return apply_mapping(trimmed.drop("vector"), named.select("ord", "context_id", "entity", "category", F.col("standard").alias("standard_entity"), "cluster_id"))


def apply_mapping(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions with the mapping's ``standard_entity`` and ``cluster_id`` by context, name and category.

    The last row by ``ord`` of a repeated key counts; a mention without one keeps its name and -1.
    """
    keys = ["context_id", "entity", "category"]
    last = mapping.groupBy(*keys).agg(F.max_by(F.struct("standard_entity", "cluster_id"), "ord").alias("to"))
    joined = mentions.join(last, keys, "left")
    return joined.select(*mentions.columns, F.coalesce("to.standard_entity", "entity").alias("standard_entity"), F.coalesce("to.cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))


def merge_concepts(mentions: DataFrame) -> DataFrame:
    """``(context_id, standard_entity, category, chunk_id, cluster_id, description, synonyms)``, one row a concept.

    The first mention by ``ord`` gives chunk and cluster; different descriptions (without "-1" and empty
    ones) are sorted and joined, synonyms and mentioned names sorted.  Rows without a key do not count.
    """
    keys = ["context_id", "standard_entity", "category"]
    rows = mentions.dropna(subset=keys).where("standard_entity <> ''")
    told = F.trim(F.coalesce("description", F.lit("")))
    names = F.array_distinct(F.flatten(F.collect_list(F.array_append(_names("synonyms"), F.col("entity")))))
    return rows.groupBy(*keys).agg(
        F.min_by("chunk_id", "ord").alias("chunk_id"), F.min_by("cluster_id", "ord").alias("cluster_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~told.isin("", "-1"), told))), ". ").alias("description"),
        F.array_sort(F.array_compact(names)).alias("synonyms"),
    )


def entity_map(mentions: DataFrame) -> DataFrame:
    """``(context_id, chunk_id, names map<string,string>)`` from mentioned to standard names, the last by ``ord`` of a repeated one."""
    rows = mentions.where("standard_entity IS NOT NULL AND standard_entity <> '' AND entity IS NOT NULL")
    last = rows.groupBy("context_id", "chunk_id", "entity").agg(F.max_by("standard_entity", "ord").alias("standard_entity"))
    return last.groupBy("context_id", "chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "standard_entity")))).alias("names"))
