"""Entity standardisation after clustering: persons whose shorter names lie in longer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.text import clean_entity, generation
from quarrygraph.sources.tables import bounded, cut, spread

#: Numbers of leading characters of a name that name its candidates: the largest that the name has.
GRAMS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128)


def generations_apart(a, b):
    """Whether both names carry a genealogical suffix and the two differ."""
    return F.coalesce(generation(a) != generation(b), F.lit(False))


def candidates(people: DataFrame) -> DataFrame:
    """``(context_id, gram, o2, c2, o1, c1)``: names ``c2`` of ``people (context_id, ord, c)`` that hold the beginning of ``c1``."""
    length = F.length("c")
    gram = F.coalesce(*[F.when(length >= n, n) for n in reversed(GRAMS)])
    # Only lengths that some name is known by, a dozen and a half numbers at most.
    known = sorted(r.n for r in people.where("c <> ''").select(gram.alias("n")).distinct().collect())

    def stretches(n: int):
        at = F.when(length >= n, F.sequence(F.lit(1), length - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col("c"), i, F.lit(n)))

    inner = people.where("c <> ''").select("context_id", F.left("c", gram).alias("gram"), F.col("ord").alias("o1"), F.col("c").alias("c1"))
    grams = F.array_distinct(F.flatten(F.array(*map(stretches, known)))) if known else F.array().cast("array<string>")
    held = people.select("context_id", F.explode(grams).alias("gram"), F.col("ord").alias("o2"), F.col("c").alias("c2"))
    # Stretches are many rows of a name, so the names come to them where they are few enough.
    return held.join(bounded(inner), ["context_id", "gram"])


def merge_persons(entities: DataFrame, category: str = "Person", empty_names_match: bool = False) -> DataFrame:
    """``entities (context_id, ord, entity, category, standard)`` with the standard names of persons joined.

    Within a context, two persons of different standards meet if one cleaned name lies inside the
    other and they are not equal; both take the longer name (on a tie the later one's).  The last
    pair in order of appearance decides.  Candidates are names that hold another's first characters
    (as many of ``GRAMS`` as it has, so that names with a common beginning do not all meet), by an
    equi-join: a large context is no product of its names.  Names that are empty
    once cleaned match nothing unless ``empty_names_match``, which pairs them with all of their context.
    """
    people = entities.where(F.col("category") == category).select("context_id", "ord", "entity", "standard", clean_entity(F.col("entity")).alias("c"))
    if not empty_names_match:
        people = people.where("c <> ''")
    people = cut(spread(people))

    found = candidates(people).where("c1 <> c2").where(F.contains("c2", "c1")).select("context_id", "o1", "o2")
    if empty_names_match:
        empty, full = people.where("c = ''").select("context_id", F.col("ord").alias("o1")), people.where("c <> ''").select("context_id", F.col("ord").alias("o2"))
        found = found.unionByName(empty.join(full, "context_id"))
    met = found.select("context_id", F.least("o1", "o2").alias("i"), F.greatest("o1", "o2").alias("j"))
    a = people.select("context_id", F.col("ord").alias("i"), F.col("entity").alias("ea"), F.col("standard").alias("sa"))
    b = people.select("context_id", F.col("ord").alias("j"), F.col("entity").alias("eb"), F.col("standard").alias("sb"))
    pairs = met.join(a, ["context_id", "i"]).join(b, ["context_id", "j"]).where("sa <> sb")
    longer = F.when(F.length("ea") > F.length("eb"), F.col("ea")).otherwise(F.col("eb"))
    both = pairs.select("context_id", F.struct("i", "j").alias("at"), longer.alias("new"), F.explode(F.array("i", "j")).alias("ord"))
    last = both.groupBy("context_id", "ord").agg(F.max_by("new", "at").alias("new"))
    return entities.join(last, ["context_id", "ord"], "left").withColumn("standard", F.coalesce("new", "standard")).drop("new")
