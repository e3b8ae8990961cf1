"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, release, small_batches, to_batch
from quarrygraph.operators.components import connected_components
from quarrygraph.sources.tables import cut

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Odd multipliers that widen one 64-bit hash to further words of a fingerprint (powers of the golden-ratio constant).
WIDEN = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(8)]
#: Members of a block that are compared all with all; larger blocks take the other way.
LIGHT = 1024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle, A-Z lower-cased; repeats included, none for a text without words."""
    found = WORDS.findall((text or "").encode().lower())  # bytes.lower() moves A-Z only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[words - 1 :].tolist() if len(found) >= words else [len(line)]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian bits, each 1 if set in over half the hashes; zero without hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    out = []
    for i in range(bits // 64):
        h = hashes
        if i:
            h = hashes * np.uint64(WIDEN[i])
            h ^= h >> np.uint64(29)
            h *= np.uint64(WIDEN[2])
            h ^= h >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(h)).tobytes())
    return b"".join(out)


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])


def fingerprints(df: DataFrame, words: int, bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is ``bits / 8`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in small_batches(batches):
            yield to_batch({"doc_id": batch.column(0), "fp": [fingerprint(shingle_hashes(t, words), bits) for t in batch.column(1).to_pylist()]}, FINGERPRINTS)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp binary")


def pigeonhole_masks(bits: int, blocks: int, agree: int) -> list[tuple[int, ...]]:
    """Bit positions of every choice of ``agree`` of ``blocks`` blocks: fingerprints that differ in at
    most ``blocks - agree`` bits are equal on one of them."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [tuple(p for b in chosen for p in range(edges[b], edges[b + 1])) for chosen in itertools.combinations(range(blocks), agree)]


def split_masks(bits: int, width: int, tables: int) -> list[tuple[int, ...]]:
    """``tables`` blocks of ``width`` bit positions.

    The bits are split into disjoint blocks, in an order drawn once; where more blocks are wanted than one
    split has, further splits follow in further orders.  Fingerprints that differ in fewer bits than a
    split has blocks share a block for certain, others with the chance that :func:`tables_for` counts.
    """
    draw, masks = np.random.Generator(np.random.PCG64(7)), []
    while len(masks) < tables:
        order = draw.permutation(bits)
        masks += [tuple(sorted(order[at : at + width].tolist())) for at in range(0, bits - width + 1, width)]
    return masks[:tables]


def tables_for(bits: int, width: int, distance: int, recall: float) -> int:
    """How many blocks of ``width`` bits find a pair that differs in ``distance`` bits with a chance of ``recall``."""
    share = math.prod((bits - distance - i) / (bits - i) for i in range(width))
    return max(bits // width, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def width_for(fingerprints: int, members: int = 128) -> int:
    """Block width at which a block holds about ``members`` unrelated fingerprints, whatever their number."""
    return min(48, max(8, math.ceil(math.log2(max(1, fingerprints) / members))))


def _keys(fps: np.ndarray, masks: Sequence[tuple[int, ...]]) -> np.ndarray:
    """One 64-bit key a fingerprint and mask: its masked bits (at most 48), and the mask's number on top."""
    bits = np.unpackbits(fps, axis=1)
    out = np.empty((len(fps), len(masks)), dtype=np.uint64)
    for t, mask in enumerate(masks):
        packed = np.zeros((len(fps), 8), dtype=np.uint8)
        packed[:, 2:] = np.packbits(np.pad(bits[:, mask], ((0, 0), (48 - len(mask), 0))), axis=1)
        out[:, t] = packed.view(">u8")[:, 0] | np.uint64(t << 48)
    return out


def _as_matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def block_links(nodes: DataFrame, masks: Sequence[tuple[int, ...]], max_distance: int) -> DataFrame:
    """Links ``(src, dst)`` between ``nodes (rep, fp)`` of distinct fingerprints within ``max_distance`` bits.

    Every fingerprint is dealt by each mask's bits; a block's members are compared with each other
    and verified by Hamming distance.  A block streams through its task sorted by fingerprint and at
    most ``LIGHT`` members are held.  Light blocks are compared whole and give a spanning forest of
    their links.  Beyond ``LIGHT`` members, each further member is compared with a hub of those held
    and with its batch, and all members are also returned as ``(rep, null, fp, key, rest)``: ``rest``
    says that a member was not linked to the hub.  :func:`one_bit_links` (distances up to 2) or
    :func:`crowded_links` (any distance) then finds the links that are missing, exactly.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in small_batches(batches, 1000):
            if batch.num_rows:
                keys = _keys(_as_matrix(batch.column(1)), masks)
                reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(masks))
                at = pa.array(np.repeat(np.arange(batch.num_rows), len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(reps), batch.column(1).take(at)], names=["key", "rep", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, held = None, _Block(max_distance)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            reps = batch.column(1).to_numpy()
            fps = _as_matrix(batch.column(2)) if len(keys) else np.zeros((0, 8), np.uint8)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in itertools.pairwise(cuts):
                if keys[a] != key:
                    held.close()
                    key = held.key = keys[a]
                if b - a == 1 and not held.size and b < len(keys):
                    continue  # alone in its block
                held.add(reps[a:b], fps[a:b])
            yield from held.take()
        held.close()
        yield from held.take()

    dealt = nodes.select("rep", "fp").mapInArrow(deal, "key long, rep long, fp binary")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "src long, dst long, fp binary, key long, rest boolean")


#: Members of a crowded block that further members are compared with at once.
HUB = 256
LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("fp", pa.binary()), ("key", pa.int64()), ("rest", pa.bool_())])


class _Block:
    """The members of the block that is streaming by."""

    def __init__(self, max_distance: int):
        self.most, self.size = max_distance, 0
        self.key = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.hub: tuple[np.ndarray, np.ndarray] | None = None
        self.src: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []
        self.heavy: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, reps: np.ndarray, fps: np.ndarray) -> None:
        self.size += len(reps)
        if self.hub is not None:
            self._further(reps, fps)
            return
        self.parts.append((reps, fps))
        if self.size > LIGHT:
            reps, fps = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            labels = self._forest(reps[:LIGHT], fps[:LIGHT])
            inside = labels == np.bincount(labels).argmax()  # the largest component
            self.hub = tuple(x[:LIGHT][inside][:HUB] for x in (reps, fps))
            self.heavy.append((self.key, reps[:LIGHT], fps[:LIGHT], ~inside))
            self._further(reps[LIGHT:], fps[LIGHT:])

    def _further(self, reps: np.ndarray, fps: np.ndarray) -> None:
        n = len(self.hub[0])
        for at in range(0, len(reps), LIGHT):
            r, f = reps[at : at + LIGHT], fps[at : at + LIGHT]
            labels = self._forest(np.concatenate([self.hub[0], r]), np.concatenate([self.hub[1], f]))
            self.heavy.append((self.key, r, f, ~np.isin(labels[n:], labels[:n])))

    def _compare(self) -> None:
        if self.size > 1:
            reps, fps = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self._forest(reps, fps)

    def _forest(self, reps: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Adds links that span the components of these members; gives each member's component (its first member)."""
        labels = np.arange(len(reps))
        words = np.ascontiguousarray(fps).view(np.uint64)
        # Most blocks hold unrelated members only: one pass over all pairs says which have a link at all.
        linked = np.zeros(len(reps), dtype=bool)
        for at in range(0, len(reps), 64):
            part = words[at : at + 64]
            apart = np.zeros((len(part), len(words) - at), dtype=np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(part[:, w, None] ^ words[None, at:, w])
            i, j = np.nonzero(apart <= self.most)
            some = i != j
            linked[at + i[some]] = linked[at + j[some]] = True
        if not linked.any():
            return labels
        waiting = linked.copy()
        for first in np.flatnonzero(linked).tolist():
            if not waiting[first]:
                continue
            front = [first]
            waiting[first] = False
            while front:
                i = front.pop()
                rest = np.flatnonzero(waiting)
                if not len(rest):
                    return labels
                near = rest[np.bitwise_count(words[rest] ^ words[i]).sum(axis=1) <= self.most]
                if len(near):
                    self.src.append(np.full(len(near), reps[i]))
                    self.dst.append(reps[near])
                    waiting[near] = False
                    labels[near] = first
                    front += near.tolist()
        return labels

    def close(self) -> None:
        if self.hub is None:
            self._compare()
        self.parts, self.hub, self.size = [], None, 0

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.src:
            a, b = np.concatenate(self.src), np.concatenate(self.dst)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), t) for t in LINKS.types[2:])], schema=LINKS)
            self.src, self.dst = [], []
        for key, reps, fps, rest in self.heavy:
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.nulls(len(reps), pa.int64()), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(np.full(len(reps), key), pa.int64()), pa.array(rest)], schema=LINKS)
        self.heavy = []


def one_bit_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links that join all members of heavy blocks within ``max_distance`` (0 or 2) bits, without pairs.

    Two 64-bit fingerprints are within 2 bits exactly if some value lies within one bit of both, so
    each member names its 65 such values and the members of one value are linked to its smallest.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    value = F.conv(F.hex("fp"), 16, -10).cast("long").alias("value")
    near = members.select(F.col("src").alias("rep"), value).distinct()
    named = near.select("rep", F.explode(F.concat(F.array("value"), flips) if max_distance else F.array("value")).alias("between"))
    least = named.groupBy("between").agg(F.min("rep").alias("dst"), F.count("*").alias("n")).where("n > 1")
    return named.join(least, "between").select(F.col("rep").alias("src"), "dst").where("src <> dst").distinct()


def crowded_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links that join the members of crowded blocks to those that their hub did not reach, at any distance.

    Members that the hub reached are one component, so only the others are compared with all of
    their block.  Both sides are dealt into chunks of about ``LIGHT`` by a hash, each pair of chunks
    is one bounded comparison, and a pair returns a spanning forest, not all of its pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                both = {x["src"]: x["fp"] for x in row["some"] + row["others"]}
                block = _Block(max_distance)
                block._forest(np.array(list(both), dtype=np.int64), _as_matrix(pa.array(both.values(), pa.binary())))
                yield from block.take()

    chunks = F.ceil(F.col("n") / LIGHT)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("rest").cast("long")).alias("n_rest")).where("n_rest > 0")
    sized = members.select("key", "src", "fp", "rest").join(sizes, "key").withColumn("n_chunks", F.ceil(F.col("n_rest") / LIGHT))
    packed = F.collect_list(F.struct("src", "fp"))  # about LIGHT of them
    others = sized.groupBy("key", "n_chunks", F.pmod(F.xxhash64("src"), chunks).alias("part")).agg(packed.alias("others"))
    some = sized.where("rest").groupBy("key", F.pmod(F.xxhash64("src", F.lit(1)), F.col("n_chunks")).alias("chunk")).agg(packed.alias("some"))
    pairs = others.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))).join(some, ["key", "chunk"])
    return pairs.select("some", "others").mapInArrow(compare, "src long, dst long, fp binary, key long, rest boolean").select("src", "dst")


def near_duplicates(
    df: DataFrame, words: int = 5, bits: int = 256, masks: Sequence[tuple[int, ...]] | None = None, max_distance: int = 48, near: int = 39, recall: float = 0.985, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row.

    ``component_id`` is the smallest doc_id whose fingerprint is reached over links of at most
    ``max_distance`` bits.  Equal fingerprints are one node, so copies cost no pairs.  With 64 bits,
    a distance of at most 2 and :func:`pigeonhole_masks` every link is found.  Without ``masks`` the
    fingerprint is split into blocks as wide as the number of fingerprints asks for and as many as
    find a pair that differs in ``near`` bits with the chance ``recall`` (in fewer bits, a larger one).
    Null texts and texts without words have
    fingerprint zero and link like any other; rows with a null doc_id get their fingerprint's
    component, which they never name; repeated rows stay; an empty table gives no rows.
    """
    rows = cut(fingerprints(df, words, bits, doc_id, text))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    if masks is None:
        width = width_for(nodes.count())
        masks = split_masks(bits, width, tables_for(bits, width, near, recall))
    links = cut(block_links(nodes, masks, max_distance))
    edges = links.where("dst is not null").select("src", "dst")
    heavy = links.where("dst is null")
    if not heavy.isEmpty():
        one_bit = bits == 64 and max_distance in (0, 2)
        edges = edges.union(one_bit_links(heavy, max_distance) if one_bit else crowded_links(heavy, max_distance))
    labels = connected_components(edges.distinct())
    classes = nodes.join(labels, nodes.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, 64 bits, links of at most 2 bits: 5 blocks of which 3 agree."""
    found = near_duplicates(documents(spark, sf_dir), words=3, bits=64, masks=pigeonhole_masks(64, 5, 3), max_distance=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Rows to remove are broadcast up to this many; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near copies stays, the one with the smallest doc_id.

    Five-word shingles in 256-bit fingerprints.  Documents whose shingle sets are similar by 0.8 differ in
    39 of 256 bits in the mean, and links reach to 48, so that most of them are within.  Rows are told
    apart by their place, not their id: of exactly repeated rows one stays, different texts under one id
    are judged one by one, and rows with a null doc_id take part (after all others).
    """
    placed = cut(docs.select("*", F.monotonically_increasing_id().alias("_stage_row")))
    found = near_duplicates(placed, doc_id="_stage_row", text="text").select(F.col("doc_id").alias("_stage_row"), "component_id")
    ids = placed.select("_stage_row", F.col("doc_id").alias("id")).join(found, "_stage_row")
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("_stage_row").alias("row"))
    # Every row is in a group, most alone; only groups of more rows are looked at.
    kept = ids.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.row").alias("kept"))
    gone = cut(found.join(kept, "component_id").where("_stage_row <> kept").select("_stage_row"))
    small = gone.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(gone) if small else gone, "_stage_row", "left_anti").select(*docs.columns)
