"""Packed token-id matrices by best-fit decreasing over a segment tree of capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, small_batches
from quarrygraph.llm._tokens import encoder

ROWS = pa.schema(
    [
        ("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
        ("n_tokens", pa.int32()), ("n_resets", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
    ]
)
ROWS_DDL = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, n_resets int, input_ids binary, position_ids binary"


class CapacityTree:
    """Counts of open windows by room left; finds the least room of at least ``size`` in O(log capacity)."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._count[node] += by
            node >>= 1

    def least(self, size: int) -> int | None:
        node, count = size + self._leaves, self._count
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:  # the right neighbour holds more room
                node += 1
                while node < self._leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self._leaves
            node >>= 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` (each at most ``capacity``) by window; equal sizes in order of index."""
    tree, windows = CapacityTree(capacity), []
    open_by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room is None:
            windows.append([])
            window, room = len(windows) - 1, capacity
        else:
            window = open_by_room[room].pop()
            tree.add(room, -1)
        windows[window].append(i)
        left = room - sizes[i]
        if left:
            open_by_room.setdefault(left, []).append(window)
            tree.add(left, 1)
    return windows


def packed_matrices(df: DataFrame, capacity: int = 2048, buffer_tokens: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, pad_id: int = 0, id_bytes: int = 2) -> DataFrame:
    """One row per packed window: little-endian ids of ``id_bytes`` (2 or 4), cumulative segment lengths, position resets.

    An id that does not fit ``id_bytes`` is an error.

    A document's ids end with ``end_id``; documents over ``capacity`` ids are cut into windows'
    lengths and a rest, no id is lost, and ``starts`` says where each segment begins in its document.
    ``cu_seqlens`` runs from 0 over the segments' ends; the padding behind the last end is
    ``pad_id`` at position 0; ``position_ids`` restart at 0 with every segment.  ``n_resets`` counts
    the segments.  Each task packs buffers of ``buffer_tokens`` ids on its own: no shuffle, and
    memory is bounded by the buffer.  Null and empty texts are one end id, repeated rows are packed
    as often as they come, an empty table gives no rows.  Window ids are unique, not gapless.
    """

    if id_bytes not in (2, 4) or capacity > 1 << 8 * id_bytes:
        raise ValueError("id_bytes is 2 or 4, and positions must fit it")
    kind, most = f"<u{id_bytes}", (1 << 8 * id_bytes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(vocabulary).ids, np.array([end_id], dtype="<u4").tobytes()
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            windows = best_fit_decreasing([len(x[2]) for x in held], capacity)
            for at in range(0, len(windows), 200):
                out: dict[str, list] = {f.name: [] for f in ROWS}
                for window in windows[at : at + 200]:
                    ids, positions = np.full(capacity, pad_id, dtype=kind), np.zeros(capacity, dtype=kind)
                    ends = [0]
                    for i in window:
                        n = len(held[i][2])
                        ids[ends[-1] : ends[-1] + n], positions[ends[-1] : ends[-1] + n] = held[i][2], np.arange(n)
                        ends.append(ends[-1] + n)
                    for name, x in zip(out, ((part << 33) + made, [held[i][0] for i in window], [held[i][1] for i in window], ends, ends[-1], len(window), ids.tobytes(), positions.tobytes()), strict=True):
                        out[name].append(x)
                    made += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in ROWS], schema=ROWS)

        for batch in small_batches(batches):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wide = np.frombuffer(ids_of(value) + end, dtype="<u4")
                if wide.max() > most:
                    raise ValueError(f"token id {wide.max()} does not fit {id_bytes} bytes")
                ids = wide.astype(kind)
                for start in range(0, len(ids), capacity):
                    held.append((doc, start, ids[start : start + capacity]))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from flush()
                    held, tokens = [], 0
        yield from flush()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ROWS_DDL)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed windows as parquet (binary id and position matrices, one window a row)."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every packed window: its segments, and checksums of its id and position rows."""
    rows = packed_matrices(documents(spark, sf_dir))
    return rows.select(
        "sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "n_resets",
        F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"),
    )
