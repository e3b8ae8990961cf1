"""Benchmark decontamination by spaced seeds that no accepted match can avoid (DataFrame functions only)."""

from __future__ import annotations

import itertools
import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents
from quarrygraph.sources.tables import cut, table

#: Rows of the benchmark's seeds, of its items and of leaked texts' digests are broadcast up to this many; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits, as 64-bit hashes in order; none for null."""
    line = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def substitutions(run: int, similarity: float) -> int:
    """How many of ``run`` tokens may differ."""
    return run - math.ceil(run * similarity)


@cache
def spaced_masks(run: int, differing: int, most: int = 2) -> tuple[tuple[int, ...], ...]:
    """Token positions of at most ``most`` masks, one of which meets only equal tokens somewhere in any
    ``run`` tokens of which ``differing`` are substituted.

    The heaviest such masks are taken, found greedily and held against every choice of substituted
    positions, so they lose nothing.  With no substitution the one mask is the run itself.
    """
    if not differing:
        return (tuple(range(run)),)
    patterns = list(itertools.combinations(range(run), differing))
    every = (1 << len(patterns)) - 1
    #: Which patterns, one bit each, substitute a position.
    holds = [sum(1 << i for i, pattern in enumerate(patterns) if p in pattern) for p in range(run)]

    def missed(shape: tuple[int, ...]) -> int:
        left = every
        for shift in range(run - shape[-1]):
            touched = 0
            for p in shape:
                touched |= holds[shift + p]
            left &= touched
        return left

    found: tuple[tuple[int, ...], ...] = ((0,),)
    for weight in range(2, run - differing + 1):
        shapes = [(0, *inner, span - 1) for span in range(weight, min(run, weight + 4) + 1) for inner in itertools.combinations(range(1, span - 1), weight - 2)]
        misses = {shape: missed(shape) for shape in shapes}
        left, chosen = every, []
        while left and len(chosen) < most:
            best = min(shapes, key=lambda shape: ((misses[shape] & left).bit_count(), shape[-1]))
            left &= misses[best]
            chosen.append(best)
        if left:
            return found
        found = tuple(chosen)
    return found


def mask_families(runs: list[int], similarity: float) -> dict[int, tuple[tuple[int, ...], ...]]:
    """Masks by length of the run that must agree.

    Runs that allow equally many substitutions share the masks of the shortest of them: what cannot be
    avoided there cannot be avoided in a longer run either.
    """
    families = {}
    for run in runs:
        k = substitutions(run, similarity)
        families[run] = spaced_masks(min(r for r in range(1, run + 1) if substitutions(r, similarity) == k) if k else run, k)
    return families


def seeds(rows: DataFrame, hashes: str, masks: list[tuple[int, ...]], wanted: list[Column] | None = None) -> DataFrame:
    """``rows`` with ``(<hashes>_at, mask, seed)``: one row for every place of its tokens where a mask fits.

    Positions are exploded before anything is hashed, so seeds are made in generated code and no row
    copies its tokens.  The outer form (its null seeds join nothing) has no filter on the array inferred,
    which would be pushed down with the whole expression inside.
    """
    h, at = F.col(hashes), F.col(f"{hashes}_at")
    places = rows.select("*", F.explode_outer(F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1))).alias(f"{hashes}_at"))
    each = []
    for number, mask in enumerate(masks):
        fits = at + mask[-1] < F.size(h)
        seed = F.xxhash64(F.lit(number), *[F.get(h, at + p) for p in mask])
        each.append(F.struct(F.lit(number).alias("mask"), F.when(fits if wanted is None else fits & wanted[number], seed).alias("seed")))
    return places.select("*", F.explode_outer(F.array(*each)).alias("s")).select(*places.columns, "s.mask", "s.seed")


def _best_run(masks: list[tuple[int, ...]]) -> Column:
    """Of the runs that hold a hit ``(near, near_at, doc_at, item, item_at, run, mask)`` the best: ``struct<n, less_doc, less_item>``.

    ``near`` is the part of the text around the hit, from token ``near_at`` on.

    ``n`` counts its equal tokens; the others are where the first of them lies, negated, so that the
    largest struct is the best run at the smallest place.  All runs that hold the hit lie within two
    runs around it, so equality is one bit a token of a 64-bit word and matches are a bit count.
    """
    reach = F.get(F.lit([m[-1] + 1 for m in masks]), F.col("mask"))
    first = F.greatest(F.lit(0), F.col("item_at") + reach - F.col("run"))
    last = F.least(F.col("item_at"), F.size("item") - F.col("run"))
    shift = F.col("doc_at") - F.col("item_at")
    left = lambda x, by: F.call_function("shiftleft", x, by)
    one = F.lit(1).cast("long")

    def bit(j: Column) -> Column:
        at = first + j + shift - F.col("near_at")
        return F.when((at >= 0) & (at < F.size("near")) & (F.get("item", first + j) == F.get("near", F.greatest(F.lit(0), at))), left(one, j)).otherwise(F.lit(0).cast("long"))

    bits = F.aggregate(F.sequence(F.lit(0), last - first + F.col("run") - 1), F.lit(0).cast("long"), lambda held, j: held.bitwiseOR(bit(j)))

    def scored(held: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), last - first), lambda s: F.struct(s.alias("s"), F.call_function("shiftright", held, s).bitwiseAND(left(one, F.col("run")) - 1).alias("x")))
        place = lambda r: first + r["s"] + F.bit_count(r["x"].bitwiseAND(-r["x"]) - 1)  # noqa: E731 - of the lowest bit
        return F.array_max(F.transform(runs, lambda r: F.struct(F.bit_count(r["x"]).alias("n"), (-(place(r) + shift)).alias("less_doc"), (-place(r)).alias("less_item"))))

    return F.get(F.transform(F.array(bits), scored), F.lit(0))


def _follows(masks: list[tuple[int, ...]]) -> Column:
    """Whether the same mask also hits one token further left on the same alignment.

    Such a hit need not be looked at: a run that holds it and not the other can move left by one
    token, which is equal, and is no worse.
    """
    before = F.lit(False)
    for number, mask in enumerate(masks):
        equal = F.lit(True)
        for p in mask:
            equal = equal & (F.get("doc", F.greatest(F.lit(0), F.col("doc_at") - 1 + p)) == F.get("item", F.greatest(F.lit(0), F.col("item_at") - 1 + p)))
        before = F.when(F.col("mask") == number, equal).otherwise(before)
    return (F.col("doc_at") > 0) & (F.col("item_at") > 0) & before


def text_leaks(texts: DataFrame, benchmark: DataFrame, window: int = 20, similarity: float = 0.8, item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(*keys, item_id, doc_start, item_start, n_tokens, n_matched)`` for ``texts (*keys, text)``: the best run of every leaked key and item.

    Each row is judged on its own; of rows that share keys the best run is returned.
    """
    if not 0 < window <= 31:
        raise ValueError("window must be 1 to 31 tokens")
    keys = [c for c in texts.columns if c != "text"]
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), tokens(item_text).alias("item")).where(F.size("item") > 0)
    items = items.withColumn("run", F.least(F.size("item"), F.lit(window)))
    runs = sorted(r["run"] for r in items.select("run").distinct().collect())  # at most ``window`` small numbers
    families = mask_families(runs, similarity)
    masks = sorted({m for family in families.values() for m in family}) or [(0,)]

    # An item needs its own run's masks only.
    keyed = seeds(items, "item", masks, [F.col("run").isin([r for r in families if m in families[r]] or [0]) for m in masks]).where("seed is not null").drop("item")
    # At least a seed an item, so the items are as bounded.
    small = keyed.count() <= broadcast_rows
    held = items.select("item_id", "item")
    if small:
        # Hits are verified where they are found: neither texts nor hits are shuffled.
        hits = seeds(texts.select(*keys, tokens("text").alias("doc")), "doc", masks).drop("mask").join(F.broadcast(keyed), "seed").join(F.broadcast(held), "item_id")
    else:
        # Too many seeds to broadcast: narrow hits are found by a shuffle, and only texts with hits are read again.
        digest = (F.xxhash64("text").alias("_h"), F.crc32("text").alias("_c"), F.octet_length("text").alias("_n"))
        narrow = seeds(texts.select(*digest, tokens("text").alias("doc")), "doc", masks).drop("doc", "mask")
        places = cut(narrow.join(keyed, "seed").drop("seed").distinct())
        some = texts.select(*keys, *digest, "text").join(places.select("_h", "_c", "_n").distinct(), ["_h", "_c", "_n"], "left_semi")
        hits = some.select(*keys, "_h", "_c", "_n", tokens("text").alias("doc")).join(places, ["_h", "_c", "_n"]).join(held, "item_id")
    near_at = F.greatest(F.lit(0), F.col("doc_at") - window)
    around = hits.where(~_follows(masks)).select(*keys, "item_id", "item", "item_at", "run", "mask", "doc_at", near_at.alias("near_at"), F.slice("doc", near_at + 1, 3 * window).alias("near"))
    best = around.select(*keys, "item_id", F.col("run").alias("n_tokens"), _best_run(masks).alias("b"))
    top = best.groupBy(*keys, "item_id", "n_tokens").agg(F.max("b").alias("b")).where(F.col("b.n") >= F.col("n_tokens") * similarity)
    return top.select(*keys, "item_id", (-F.col("b.less_doc")).alias("doc_start"), (-F.col("b.less_item")).alias("item_start"), "n_tokens", F.col("b.n").cast("int").alias("n_matched"))


def find_leaks(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``(doc_id, item_id, doc_start, item_start, n_tokens, n_matched)`` of every leaked passage, one row a document and item.

    A leak is an alignment of the two in which some run of ``window`` tokens (or the whole item, if
    shorter) agrees in at least ``similarity`` of its positions; the best such run is returned by its
    size, its equal tokens and where the first of them lies (the smallest place on ties).  Seeds
    ignore the positions that their masks leave out, and every such run holds one
    (:func:`spaced_masks`), so no leak is missed, for items of any length.

    Null texts hold no tokens, null ids are kept as ids; rows that share an id are judged one by one
    and give the best of their runs, so repeated rows give no further rows; an empty table on either
    side gives none.  Other columns are not read.
    """
    return text_leaks(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark, **settings)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go, whatever their id.

    The decision is on the text, so equal texts share it and rows of one id or none do not.
    """
    digest = F.sha2("text", 256)
    leaked = cut(text_leaks(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark")).select("digest").distinct())
    small = leaked.count() <= BROADCAST_ROWS
    renamed = leaked.withColumnRenamed("digest", "_leaked_digest")
    return docs.join(F.broadcast(renamed) if small else renamed, digest == F.col("_leaked_digest"), "left_anti").select(*docs.columns)
