"""Exact substring dedup: front-coded sorted suffix runs, merged by loser trees that keep known prefixes.

Sorting every suffix would ship many times the text.  Two published reductions keep the result exact:

* Minimizer sampling.  Every 100-byte window names the anchor inside it, the 32-byte gram of least
  hash (leftmost on ties).  Equal windows name the same anchor at the same offset, so only suffixes
  that start at anchors are sorted, each with the stretch of text whose windows name it.
* Duplicate detection.  Suffixes whose anchor gram occurs once in the corpus are never exchanged
  (distinguishing prefixes in distributed string sorting).

Runs of some megabytes of documents are sorted, front-coded and dealt by anchor; each bucket merges
its runs with a loser tree whose nodes hold the common prefix with the last winner, so known prefixes
are never compared again.  Suffixes that share an anchor are neighbours in the merged order, and the
common prefixes that the merge gives say how far the windows of two of them agree to the right of the
anchor; only what lies to its left is compared.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import documents, release, total_bytes

BLOCK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
_NONE = np.zeros(0, dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Hasher:
    """Prefix sums of a polynomial hash, so that any substring's hash is one subtraction and product."""

    def __init__(self, n: int):
        base = 0x9E3779B97F4A7C15
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, base, np.uint64)), dtype=np.uint64)
        self.inverse = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)


_hashers: dict[int, _Hasher] = {}


def anchored(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(first window, last window, anchor, gram hash, stretch hash)`` of every stretch of windows with one anchor.

    Windows never cross a document; blocks split stretches, which is harmless.
    """
    n = len(text)
    if n < window:
        return
    valid = np.zeros(n, dtype=bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= window:
            valid[a : b - window + 1] = True
    hasher = _hashers.setdefault(window, _Hasher(BLOCK + 2 * window))
    span = window - gram + 1
    for lo in range(0, n - window + 1, BLOCK):
        hi = min(lo + BLOCK, n - window + 1)
        ok = valid[lo:hi]
        if not ok.any():
            continue
        part = hasher.byte[text[lo : hi + window - 1]]
        size = len(part)
        part *= hasher.power[:size]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        grams = _mix((sums[gram:] - sums[:-gram]) * hasher.inverse[: size - gram + 1])
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & _POSITION).astype(np.int64)
        same = np.zeros(len(ok) + 1, dtype=bool)
        same[1:-1] = ok[1:] & ok[:-1] & (anchor[1:] == anchor[:-1])
        first, last = np.flatnonzero(ok & ~same[:-1]), np.flatnonzero(ok & ~same[1:])
        stretch = _mix((sums[last + window] - sums[first]) * hasher.inverse[first] + (last - first).astype(np.uint64))
        at = anchor[first]
        yield first + lo, last + lo, at + lo, grams[at], stretch


class _Run:
    """The documents of one run in order of (doc_id, text), as one byte array; null ids come first."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids = pc.fill_null(table.column("doc_id"), -(1 << 63)).to_numpy().astype(np.int64)
        text = pc.fill_null(table.column("text"), "").cast(pa.large_binary()).combine_chunks()
        order = np.argsort(ids, kind="stable")
        if len(ids) and len(np.unique(ids)) < len(ids):
            values = text.to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], values[i])))
        text = text.take(pa.array(order))
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
        self.order, self.ids = order, ids[order]
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        self.text = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]

    def anchored(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        parts = list(anchored(self.text, self.starts, self.ends, window, gram))
        if not parts:
            return _NONE, _NONE, _NONE, _NONE.astype(np.uint64), _NONE.astype(np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets of anchor grams, whose hashes are the least of their windows and so are mixed again."""
    hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15))
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def front_code(items: list[tuple]) -> bytes:
    """A sorted run of ``(suffix, left text, first window, windows, doc_id)``; each suffix is cut by its common prefix with the one before."""
    n = len(items)
    common, prior = np.zeros(n, np.uint8), b""
    residues = []
    for i, item in enumerate(items):
        suffix = item[0]
        k = prefix_length(prior, suffix)
        common[i] = k
        residues.append(suffix[k:])
        prior = suffix
    head = struct.pack("<q", n)
    columns = [
        common.tobytes(), np.fromiter(map(len, residues), np.uint8, n).tobytes(), np.fromiter((len(x[1]) for x in items), np.uint8, n).tobytes(),
        np.fromiter((x[3] for x in items), np.uint8, n).tobytes(), np.fromiter((x[2] for x in items), np.int64, n).tobytes(), np.fromiter((x[4] for x in items), np.int64, n).tobytes(),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *columns, *residues, *(x[1] for x in items)]))


def prefix_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Stream:
    """Reads a front-coded run; a suffix is rebuilt only when it comes up."""

    def __init__(self, run: int, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", data)[0]
        self.run, self.n, self.i, self.suffix = run, n, -1, b""
        column = lambda at, size: data[8 + at * n : 8 + (at + size) * n]
        self.common, self.length, self.left, self.windows = column(0, 1), column(1, 1), column(2, 1), column(3, 1)
        self.first = np.frombuffer(column(4, 8), np.int64).tolist()
        self.doc = np.frombuffer(column(12, 8), np.int64).tolist()
        self.data, self.at = data, 8 + 20 * n
        self.left_at = self.at + sum(self.length)

    def step(self) -> int:
        """Move on; the common prefix with the suffix before, or -1 at the end."""
        self.i += 1
        i = self.i
        if i >= self.n:
            return -1
        k, size = self.common[i], self.length[i]
        self.suffix = self.suffix[:k] + self.data[self.at : self.at + size]
        self.at += size
        self.left_text = self.data[self.left_at : self.left_at + self.left[i]]
        self.left_at += self.left[i]
        return k


def merge(streams: list[_Stream]) -> Iterator[tuple[int, _Stream]]:
    """``(common prefix with the suffix before, stream)`` in merged order, by a loser tree of prefixes.

    ``known[s]`` is the common prefix of stream s's head and the winner it last met.  Of two heads the
    one that shares more with that winner is smaller; only equal values are compared, from there on.
    """
    k = 1
    while k < len(streams):
        k *= 2
    known = [s.step() for s in streams] + [-1] * (k - len(streams))
    known = [0 if h >= 0 else -1 for h in known]

    def smaller(a: int, b: int) -> int:
        """The smaller of two heads; the other's known prefix becomes that with it."""
        ha, hb = known[a], known[b]
        if ha != hb:
            return a if ha > hb else b
        if ha < 0:
            return a
        x, y = streams[a].suffix, streams[b].suffix
        h = ha + prefix_length(x[ha:], y[ha:])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a
        known[a] = h
        return b

    losers = [-1] * k
    front = list(range(k))
    while len(front) > 1:
        size, winners = len(front) // 2, []
        for i in range(size):
            a, b = front[2 * i], front[2 * i + 1]
            w = smaller(a, b)
            losers[size + i] = b if w == a else a
            winners.append(w)
        front = winners
    top = front[0]
    while known[top] >= 0:
        yield known[top], streams[top]
        known[top] = streams[top].step()
        node = (k + top) >> 1
        while node:
            other = losers[node]
            w = smaller(top, other)
            if w != top:
                losers[node], top = top, w
            node >>= 1


class _Member:
    __slots__ = ("doc", "first", "high", "left", "low", "run", "suffix", "windows")

    def __init__(self, stream: _Stream):
        i = stream.i
        self.run, self.suffix, self.left, self.doc = stream.run, stream.suffix, stream.left_text, stream.doc[i]
        self.first, self.windows = stream.first[i], stream.windows[i]
        #: Offsets of the anchor in the first and the last window.
        self.high = len(self.left)
        self.low = self.high - self.windows + 1


def repeats(group: list[_Member], common: list[int], window: int, pairwise: int = 16) -> Iterator[tuple[int, int, int]]:
    """``(run, first window, last window)`` of the windows of a group that an earlier document's suffix in it also has.

    The group is in merged order and ``common`` holds each member's common prefix with the one before, so
    the common prefix of any two is the least of those between them and nothing to the right of the
    anchor is compared.  Small groups look at pairs, larger ones at one offset of the anchor after the
    other; both give the same windows.
    """
    if len(group) <= pairwise:
        for i, a in enumerate(group):
            right = window
            for j in range(i + 1, len(group)):
                b, right = group[j], min(right, common[j])
                if window - right > a.high:
                    break
                n = min(a.high, b.high)
                low = max(window - right, a.low, b.low)
                left = n if a.left[len(a.left) - n :] == b.left[len(b.left) - n :] else prefix_length(a.left[::-1][:n], b.left[::-1][:n])
                if low <= left:
                    m = b if (a.doc, a.first) < (b.doc, b.first) else a
                    yield m.run, m.first + m.high - left, m.first + m.high - low
        return
    seen = [0] * len(group)
    for k in range(min(m.low for m in group), max(m.high for m in group) + 1):
        owner: dict[bytes, int] = {}
        for i, m in enumerate(group):
            if common[i] < window - k:
                owner = {}
            if m.low <= k <= m.high:
                left = m.left[m.high - k :]
                e = owner.setdefault(left, i)
                if e != i:
                    if (m.doc, m.first) < (group[e].doc, group[e].first):
                        owner[left] = i
                        seen[e] |= 1 << k
                    else:
                        seen[i] |= 1 << k
    for m, bits in zip(group, seen, strict=True):
        while bits:
            low = (bits & -bits).bit_length() - 1
            high = low + ((bits >> low) + 1 & ~(bits >> low)).bit_length() - 2
            yield m.run, m.first + m.high - high, m.first + m.high - low
            bits &= ~((1 << high + 1) - 1)


def repeated_windows(streams: list[_Stream], window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """:func:`repeats` of every group of suffixes with one anchor gram, as the merge brings them.

    Of equal suffixes with equal left texts only the earliest is held, so a group takes the memory of its
    different members, however many copies pass by.
    """
    group: list[_Member] = []
    commons: list[int] = []
    same: dict[bytes, int] = {}
    for common, stream in merge(streams):
        m = _Member(stream)
        size = len(m.suffix)
        if group and (common < (DIGEST if size == DIGEST else gram) or (len(group[-1].suffix) == DIGEST) != (size == DIGEST)):
            if len(group) > 1:
                yield from repeats(group, commons, window)
            group, commons = [], []
        if group and common == size == len(group[-1].suffix):
            at = same.get(m.left)
            if at is not None:
                if (m.doc, m.first) < (group[at].doc, group[at].first):
                    group[at], m = m, group[at]
                yield m.run, m.first, m.first + m.windows - 1
                continue
        else:
            same = {}
        same[m.left] = len(group)
        commons.append(common if group else 0)
        group.append(m)
    if len(group) > 1:
        yield from repeats(group, commons, window)


DIGEST = 16


class SuffixDedup:
    """The steps of the exchange; ``run_bytes`` and ``wide`` set sizes only, never the result.

    An anchor gram with over ``wide`` different stretches in the corpus is no group of one bucket: its
    windows are dealt one by one, by digests of 16 bytes, and of equal digests only the earliest is held.
    """

    def __init__(self, window: int = 100, gram: int = 32, run_bytes: int = 6 << 20, wide: int = 2_000):
        assert DIGEST < gram <= window <= 120
        self.window, self.gram, self.run_bytes, self.wide = window, gram, run_bytes, wide

    def removed(self, df: DataFrame, finish, schema: str, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
        """Apply ``finish(run table, run, removed mask)`` to every run of documents."""
        runs = max(1, -(-total_bytes(df, text) // self.run_bytes))
        docs = df.select(
            F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), F.lit(runs)).cast("long").alias("run"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *others
        )
        window, gram, wide = self.window, self.gram, self.wide

        def count(key: tuple, table: pa.Table) -> pa.Table:
            """Anchor grams of a run, each with its number of different stretches and whether it comes twice."""
            release()
            *_, grams, stretch = _Run(table).anchored(window, gram)
            order = np.lexsort((stretch, grams))
            grams, stretch = grams[order], stretch[order]
            new = np.ones(len(grams), dtype=bool)
            new[1:] = grams[1:] != grams[:-1]
            other = new.copy()
            other[1:] |= stretch[1:] != stretch[:-1]
            at = np.flatnonzero(new)
            kinds = np.add.reduceat(other.astype(np.int64), at) if len(at) else _NONE
            times = np.diff(np.append(at, len(grams)))
            marks = (np.minimum(kinds, 0x7FFF) | np.where(times > 1, 0x8000, 0)).astype("<u2")
            bucket = _bucket(grams[at], runs)
            order = np.argsort(bucket, kind="stable")
            grams, marks = grams[at][order], marks[order]
            return _dealt(key[0].as_py(), bucket[order], lambda i: (grams[i].tobytes(), marks[i].tobytes()))

        def repeated(key: tuple, table: pa.Table) -> pa.Table:
            """The grams of a bucket that come twice in the corpus, back to the runs that have them."""
            release()
            from_run = table.column("run").to_pylist()
            grams = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
            marks = [np.frombuffer(x, "<u2") for x in table.column("b").to_pylist()]
            owner = np.repeat(np.arange(len(grams)), list(map(len, grams)))
            g, m = np.concatenate(grams), np.concatenate(marks).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g, m, owner = g[order], m[order], owner[order]
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else _NONE
            size = np.diff(np.append(at, len(g)))
            twice = (size > 1) | (np.maximum.reduceat(m, at) >= 0x8000)
            hot = np.add.reduceat(m & 0x7FFF, at) > wide
            take = np.repeat(twice, size)
            g, owner, hot = g[take], owner[take], np.repeat(hot, size)[take]
            rows: dict[str, list] = {"bucket": [], "run": [], "a": [], "b": []}
            order = np.argsort(owner, kind="stable")
            g, owner, hot = g[order], owner[order], hot[order]
            edges = np.searchsorted(owner, np.arange(len(grams) + 1))
            for i, run in enumerate(from_run):
                a, b = edges[i], edges[i + 1]
                if b > a:
                    for name, x in zip(rows, (0, run, g[a:b].tobytes(), hot[a:b].astype(np.uint8).tobytes()), strict=True):
                        rows[name].append(x)
            return pa.table([pa.array(rows[f.name], f.type) for f in BLOBS], schema=BLOBS)

        def exchange(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            """Sorted front-coded suffix runs by bucket; repeats within the run are known here."""
            release()
            run = _Run(table)
            keys = np.frombuffer(b"".join(told.column("a").to_pylist()), np.uint64)
            hot = np.frombuffer(b"".join(told.column("b").to_pylist()), np.uint8)
            order = np.argsort(keys)
            keys, hot = keys[order], hot[order]
            first, last, at, grams, _ = run.anchored(window, gram)
            place = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
            take = np.flatnonzero(keys[place] == grams) if len(keys) else _NONE
            hot = hot[place[take]] if len(take) else hot[:0]
            doc = run.ids[np.searchsorted(run.starts, first[take], side="right") - 1] if len(take) else _NONE
            data = run.text.tobytes()
            seen: set[bytes] = set()
            items: dict[int, list[tuple]] = {}  # a bucket that gets nothing costs nothing
            local: list[tuple[int, int]] = []
            rows = zip(first[take].tolist(), last[take].tolist(), at[take].tolist(), doc.tolist(), _bucket(grams[take], runs).tolist(), hot.tolist(), strict=True)
            for a, b, anchor, d, bucket, split in rows:
                whole = data[a : b + window]
                if whole in seen:
                    local.append((a, b))
                    continue
                seen.add(whole)
                if split:  # one digest a window, dealt by itself
                    for p in range(a, b + 1):
                        digest = hashlib.blake2b(data[p : p + window], digest_size=DIGEST).digest()
                        if digest in seen:
                            local.append((p, p))
                        else:
                            seen.add(digest)
                            items.setdefault(int.from_bytes(digest[:4], "big") * runs >> 32, []).append((digest, b"", p, 1, d))
                else:
                    items.setdefault(bucket, []).append((data[anchor : b + window], data[a:anchor], a, b - a + 1, d))
            out: dict[str, list] = {"bucket": [], "run": [], "a": [], "b": []}
            number = key[0].as_py()
            if local:
                for name, x in zip(out, (number % runs, number, None, np.array(local, np.int64).tobytes()), strict=True):
                    out[name].append(x)
            for bucket, found in sorted(items.items()):
                found.sort(key=lambda x: x[0])
                for name, x in zip(out, (bucket, number, front_code(found), None), strict=True):
                    out[name].append(x)
                found.clear()
            return pa.table([pa.array(out[f.name], f.type) for f in BLOBS], schema=BLOBS)

        def merged(key: tuple, table: pa.Table) -> pa.Table:
            """Windows that come earlier elsewhere, by run."""
            release()
            found: dict[int, list[tuple[int, int]]] = {}
            streams = []
            out: dict[str, list] = {"bucket": [], "run": [], "a": [], "b": []}
            for run, blob, known in zip(table.column("run").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
                if blob is not None:
                    streams.append(_Stream(run, blob))
                if known is not None:
                    for name, x in zip(out, (0, run, None, known), strict=True):
                        out[name].append(x)
            for run, a, b in repeated_windows(streams, window, gram) if streams else ():
                found.setdefault(run, []).append((a, b))
            for run, spans in found.items():
                for name, x in zip(out, (0, run, None, np.array(spans, np.int64).tobytes()), strict=True):
                    out[name].append(x)
            return pa.table([pa.array(out[f.name], f.type) for f in BLOBS], schema=BLOBS)

        def last_step(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            release()
            run = _Run(table)
            spans = np.frombuffer(b"".join(told.column("b").to_pylist()), np.int64).reshape(-1, 2)
            edges = np.zeros(len(run.text) + 1, dtype=np.int32)
            np.add.at(edges, spans[:, 0], 1)
            np.add.at(edges, spans[:, 1] + window, -1)
            return finish(table.take(pa.array(run.order)), run, np.cumsum(edges[:-1]) > 0)

        by_run = docs.groupBy("run")
        counted = by_run.applyInArrow(count, BLOBS_DDL)
        twice = counted.groupBy("bucket").applyInArrow(repeated, BLOBS_DDL)
        runs_of = by_run.cogroup(twice.groupBy("run")).applyInArrow(exchange, BLOBS_DDL)
        spans_of = runs_of.groupBy("bucket").applyInArrow(merged, BLOBS_DDL)
        return by_run.cogroup(spans_of.groupBy("run")).applyInArrow(last_step, schema)


BLOBS = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
BLOBS_DDL = "bucket long, run long, a binary, b binary"


def _dealt(run: int, bucket: np.ndarray, blobs) -> pa.Table:
    """Rows (bucket, run, a, b) of ascending ``bucket`` values' slices; at most one for each value."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else _NONE
    rows: dict[str, list] = {"bucket": [], "run": [], "a": [], "b": []}
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a, b = blobs(slice(i, j))
        for name, x in zip(rows, (int(bucket[i]), run, a, b), strict=True):
            rows[name].append(x)
    return pa.table([pa.array(rows[f.name], f.type) for f in BLOBS], schema=BLOBS)


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removal_report(df: DataFrame, window: int = 100, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """What of every document's bytes is covered by ``window``-byte strings that also start earlier.

    Null texts are empty; texts shorter than a window lose nothing; rows that repeat a doc_id are
    taken in order of text, the later repeating the earlier; null ids come before all others.
    """

    def finish(table: pa.Table, run: _Run, gone: np.ndarray) -> pa.Table:
        ids = table.column("doc_id")
        removed, spans, digests = [], [], []
        for a, b in zip(run.starts.tolist(), run.ends.tolist(), strict=True):
            mask = gone[a:b]
            removed.append(int(mask.sum()))
            spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if b > a else 0)
            digests.append(hashlib.sha256(run.text[a:b][~mask].tobytes()).hexdigest())
        return pa.table([ids, pa.array(run.ends - run.starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], schema=REPORT)

    return SuffixDedup(window, **sizes).removed(df, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", doc_id, text)


def remove_repeats(df: DataFrame, window: int = 100, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """All rows as ``(doc_id, kept_text, n_removed)``; bytes of characters cut in two are dropped."""
    schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_removed", pa.int64())])

    def finish(table: pa.Table, run: _Run, gone: np.ndarray) -> pa.Table:
        kept, removed = [], []
        whole = table.column("text").to_pylist()
        for value, a, b in zip(whole, run.starts.tolist(), run.ends.tolist(), strict=True):
            mask = gone[a:b]
            removed.append(int(mask.sum()))
            kept.append(run.text[a:b][~mask].tobytes().decode("utf-8", "ignore") if removed[-1] else value)
        return pa.table([table.column("doc_id"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], schema=schema)

    return SuffixDedup(window, **sizes).removed(df, finish, "doc_id long, kept_text string, n_removed long", doc_id, text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go, what is left of each document stays.

    A document of which nothing is left goes; null and short texts stay.  ``n_chars`` follows the text;
    other columns travel with their row.  A character of which one byte goes is left out whole.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    named = docs.select("doc_id", "text", *[F.col(c).alias(f"other_{c}") for c in others])
    fields = {c: docs.schema[c].dataType for c in others}

    def finish(table: pa.Table, run: _Run, gone: np.ndarray) -> pa.Table:
        kept, keep = [], []
        whole = table.column("text").to_pylist()
        for value, a, b in zip(whole, run.starts.tolist(), run.ends.tolist(), strict=True):
            mask = gone[a:b]
            text = run.text[a:b][~mask].tobytes().decode("utf-8", "ignore") if mask.any() else value
            kept.append(text)
            keep.append(not mask.any() or bool(text.strip()))
        made = pa.table([table.column("doc_id"), pa.array(kept, pa.string()), *[table.column(f"other_{c}") for c in others]], names=["doc_id", "text", *others])
        return made.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(["doc_id long", "text string", *[f"`{c}` {fields[c].simpleString()}" for c in others]])
    out = SuffixDedup().removed(named, finish, schema, others=tuple(f"other_{c}" for c in others))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(fields["n_chars"]))
    return out.select(*docs.columns)
