"""Packing into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, small_batches, to_batch, total_bytes
from quarrygraph.llm._tokens import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` near-equal parts.

    The largest-differencing method: every item starts as a partial partition with one filled part;
    the two partial partitions with the widest spread are merged, the heaviest parts of one meeting
    the lightest of the other, until one is left.
    """
    # A partial partition holds its filled parts only, lightest first, as (sum, age, items).
    heap = [(-int(size), i, [(int(size), i, (i, None, None))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # Empty parts are the lightest, so only this many filled parts meet: light against heavy.
        meet = max(0, len(a) + len(b) - windows)
        met = []
        for x, y in zip(a[:meet], reversed(b[:meet]), strict=True):
            met.append((x[0] + y[0], age, (None, x[2], y[2])))
            age += 1
        del a[:meet]
        rest = b[meet:] + met
        if len(rest) == 1:
            insort(a, rest[0])
        else:
            a += rest
            a.sort()
        spread = a[-1][0] - (a[0][0] if len(a) == windows else 0)
        heapq.heappush(heap, (-spread, age, a))
        age += 1
    return [_leaves(tree) for _, _, tree in heap[0][2]] if heap else []


def _leaves(tree: tuple) -> list[int]:
    found, stack = [], [tree]
    while stack:
        item, left, right = stack.pop()
        if item is None:
            stack += [left, right]
        else:
            found.append(item)
    return sorted(found)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises whenever one is too full."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return [part for part in parts if part]
        windows += 1


def token_pieces(df: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Every document's ids cut into pieces of ``capacity`` ids and a rest; only digests leave the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(vocabulary).ids, np.array([end_id], dtype="<u4").tobytes()
        for batch in small_batches(batches):
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(value) + end
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for name, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), tokens), strict=True):
                        out[name].append(x)
            yield to_batch(out, PIECES)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES_DDL)


def pack_documents(df: DataFrame, capacity: int = 4096, group_windows: int = 256, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document longer than a window gives full windows and a rest; pieces shorter than a window are
    dealt by a hash into groups of about ``group_windows`` windows, and each group is differenced on
    its own.  Only piece sizes and digests are shuffled.  A group that turns out larger is worked
    through in runs of that many windows, so a hot hash costs no memory and little time.
    Null and empty texts are one end id; repeated rows are packed as often as they come; an empty
    table gives no rows.  Equal sizes are told apart by their order of arrival, which moves pieces of
    the same size between windows only.
    """
    # About three bytes a token: the number of groups only sets their size.
    groups = max(1, total_bytes(df, text) // (3 * capacity * group_windows))
    schema = f"{PIECES_DDL}, sequence_id long, offset long"

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["pack_group"].iloc[0])
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        full = np.flatnonzero(lengths == capacity)
        sequence[full] = np.arange(len(full))
        made, rest = len(full), np.flatnonzero(lengths < capacity)
        # Equal shares of every size in each run, none of much more than group_windows windows.
        runs = max(1, int(lengths[rest].sum()) // (2 * capacity * group_windows))
        for run in range(runs):
            items = rest[run::runs]
            for part in pack(lengths[items].tolist(), capacity) if len(items) else []:
                at = items[part]
                sequence[at] = made
                offset[at] = np.cumsum(lengths[at]) - lengths[at]
                made += 1
        rows["sequence_id"], rows["offset"] = (group << 32) + sequence, offset
        return rows[[*PIECES.names, "sequence_id", "offset"]]

    pieces = token_pieces(df, capacity, doc_id, text, vocabulary)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(place, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
