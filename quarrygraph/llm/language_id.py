"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarrygraph.llm._frames import documents, hold, small_batches
from quarrygraph.sources.tables import cut

LETTER = re.compile(r"[^\W\d_]")
ORDER = 3
#: Contexts that a model keeps.
MAX_STATES = 6000


@dataclass(frozen=True)
class Model:
    """Frozen counts: ``counts[language][context] = {next byte: count}`` for contexts of 0 to 3 bytes."""

    languages: tuple[str, ...]
    counts: tuple[dict[bytes, dict[int, int]], ...]
    states: tuple[bytes, ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.languages, self.states, [sorted(map(repr, c.items())) for c in self.counts])).encode()).hexdigest()


def kept_contexts(ranked: Iterable[bytes], max_states: int) -> set[bytes]:
    """The first ``max_states`` of contexts that come most seen first, whole suffix chains."""
    kept: set[bytes] = {b""}
    for context in ranked:
        if len(kept) >= max_states:
            break
        kept.add(context)  # a suffix is seen at least as often, and sorts first or as early
        while context:
            context = context[1:]
            kept.add(context)
    return kept


def _states(kept: set[bytes]) -> tuple[bytes, ...]:
    return tuple(sorted(kept, key=lambda c: (len(c), c)))


def fit(samples: dict[str, list[bytes]], max_states: int = MAX_STATES) -> Model:
    """Context trees of order 3; of all contexts the ``max_states`` most seen are kept, whole suffix chains.

    For texts in memory; :func:`learn` makes the same model of a table.
    """
    languages = tuple(sorted(samples))
    counts: list[dict[bytes, dict[int, int]]] = []
    seen: Counter = Counter()
    for language in languages:
        tree: dict[bytes, dict[int, int]] = {}
        grams: Counter = Counter()
        for text in samples[language]:
            padded = b" " * ORDER + text
            grams.update(padded[i : i + ORDER + 1] for i in range(len(text)))
        for gram, n in grams.items():
            for d in range(ORDER + 1):
                node = tree.setdefault(gram[ORDER - d : ORDER], {})
                node[gram[ORDER]] = node.get(gram[ORDER], 0) + n
        for context, node in tree.items():
            seen[context] += sum(node.values())
        counts.append(tree)
    kept = kept_contexts((c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))), max_states)
    return Model(languages, tuple({c: n for c, n in tree.items() if c in kept} for tree in counts), _states(kept))


class Coder:
    """Dense tables of exact code lengths.

    ``state`` maps three context bytes to the longest kept context; ``bits[state, byte]`` holds one
    code length a language: escape method C with exclusion, down to a uniform code over the bytes
    not yet excluded.  A context that a language has not seen passes to its suffix at no cost.
    """

    def __init__(self, model: Model):
        self.languages = model.languages
        number = {c: i for i, c in enumerate(model.states)}
        self.state = np.zeros(256**ORDER, dtype=np.uint16)
        cube = self.state.reshape(256, 256, 256)
        for context, i in number.items():  # shorter contexts first
            if len(context) == 1:
                cube[:, :, context[0]] = i
            elif len(context) == 2:
                cube[:, context[0], context[1]] = i
            elif context:
                cube[context[0], context[1], context[2]] = i
        self.bits = np.zeros((len(number), 256, len(model.languages)), dtype=np.float32)
        for j, tree in enumerate(model.counts):
            dense = {c: self._dense(n) for c, n in tree.items()}
            for context, i in number.items():
                self.bits[i, :, j] = self._lengths(context, dense)
        self.bits = self.bits.reshape(-1, len(model.languages))

    @staticmethod
    def _dense(node: dict[int, int]) -> np.ndarray:
        row = np.zeros(256)
        row[list(node)] = list(node.values())
        return row

    @staticmethod
    def _lengths(context: bytes, dense: dict[bytes, np.ndarray]) -> np.ndarray:
        lengths, open_, cost = np.zeros(256), np.ones(256, dtype=bool), 0.0
        for d in range(len(context) + 1):
            row = dense.get(context[d:])
            if row is None:
                continue
            row = np.where(open_, row, 0)
            new = row > 0
            distinct, total = int(new.sum()), row.sum()
            if not distinct:
                continue
            escapes = distinct if distinct < open_.sum() else 0  # nothing is left to escape to
            lengths[new] = cost + np.log2(total + escapes) - np.log2(row[new])
            open_ &= ~new
            if not escapes:
                return lengths
            cost += np.log2(total + escapes) - np.log2(escapes)
        lengths[open_] = cost + np.log2(open_.sum())
        return lengths

    def cost(self, data: bytes, block: int = 1 << 20) -> np.ndarray:
        """Bits of the whole text in each language, block by block."""
        total = np.zeros(len(self.languages))
        text = np.frombuffer(b" " * ORDER + data, dtype=np.uint8)
        for at in range(0, len(data), block):
            part = text[at : at + block + ORDER].astype(np.uint32)
            state = self.state[(part[:-3] << 16) | (part[1:-2] << 8) | part[2:-1]].astype(np.uint32)
            total += self.bits[(state << 8) | part[3:]].sum(axis=0, dtype=np.float64)
        return total


def coder(model: Model, key: str) -> Coder:
    return hold(("ppm", key), lambda: Coder(model))


#: Grams that a task holds, of its texts and of its counts, before it sums them up or hands them on.
HELD_GRAMS = 1 << 20


def _grams(data: bytes, block: int = 1 << 18) -> Iterator[np.ndarray]:
    """Each byte with the three before it as one number, block by block."""
    text = np.frombuffer(b" " * ORDER + data, dtype=np.uint8)
    for at in range(0, len(data), block):
        part = text[at : at + block + ORDER].astype(np.uint32)
        yield (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]


def count_grams(df: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)``: how often each byte follows three others, over all usable labelled texts, whole.

    Tasks count their own rows and their counts are summed, so no text is moved.  A language that has no
    byte stands with an empty gram.
    """
    rows = df.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def told(language: str, grams: np.ndarray, n: np.ndarray, width: int = ORDER + 1) -> pa.RecordBatch:
        places = pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * width)
        binary = pa.Array.from_buffers(pa.binary(), len(n), [None, places, pa.py_buffer(grams.astype(">u4").tobytes())])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(language, pa.string()), len(n)), binary, pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        tally: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def settle() -> None:
            for language, parts in waiting.items():
                new, times = np.unique(np.concatenate(parts), return_counts=True)
                old, before = tally[language]
                both, place = np.unique(np.concatenate([old, new]), return_inverse=True)
                n = np.zeros(len(both), dtype=np.int64)
                n[place[: len(old)]] += before
                n[place[len(old) :]] += times
                tally[language] = both, n
            waiting.clear()

        def handed() -> Iterator[pa.RecordBatch]:
            for language, (grams, n) in tally.items():
                for at in range(0, len(n), 100_000):
                    yield told(language, grams[at : at + 100_000], n[at : at + 100_000])
                tally[language] = nothing

        held = 0
        for batch in small_batches(batches):
            for language, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.setdefault(language, nothing)
                for part in _grams(whole.encode()):
                    waiting.setdefault(language, []).append(part)
                    held += max(len(part), 32)  # an array of a few grams takes that much itself
                    if held >= HELD_GRAMS:
                        settle()
                        held = 0
                        if sum(len(n) for _, n in tally.values()) >= HELD_GRAMS:
                            yield from handed()
        settle()
        yield from handed()
        for language in tally:
            yield told(language, np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64), 0)

    return rows.mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


PREDICTED = ("lang_pred", "score", "bits_per_byte")
_UND = ("und", 0.0, 0.0)


def predict(model: Model, texts: list[str | None], key: str | None = None) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte) of each text; ties go to the smaller name.

    The score is the posterior of the best language per 64 bytes of text, so it does not run up to 1
    with length alone.
    """
    table = coder(model, key or model.key)
    out = []
    for text in texts:
        if not table.languages or text is None or not LETTER.search(text):
            out.append(_UND)
            continue
        data = text.encode()
        bits = table.cost(data)
        best = int(bits.argmin())
        gaps = (bits - bits[best]) / max(1.0, len(data) / 64)
        out.append((table.languages[best], float(1 / np.exp2(-gaps).sum()), float(bits[best] / len(data))))
    return out


def add_language(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = PREDICTED) -> DataFrame:
    """All columns of ``df`` with the language, its score and the bits per byte under ``names``.

    Null texts and texts without a letter are ``und`` at 0; without any learned language all are.
    Rows are independent; an empty table stays empty; columns that have one of the ``names`` are replaced.
    """
    kept = df.drop(*names)
    key = model.key
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = predict(model, batch.column(at).to_pylist(), key)
            new = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    out = StructType([*kept.schema.fields, *map(StructField, names, (StringType(), DoubleType(), DoubleType()))])
    return kept.mapInArrow(run, out)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def learn(df: DataFrame, max_states: int = MAX_STATES) -> Model:
    """The model of all documents that are not held out (a null id has no remainder and is not learned from).

    It is what :func:`fit` makes of all their texts.  To the driver go the most seen contexts and, for these,
    the counts of their next bytes.
    """
    grams = cut(count_grams(df, F.coalesce(fold() != 1, F.lit(False))))
    languages = tuple(sorted(r["lang"] for r in grams.select("lang").distinct().collect()))
    contexts = F.array(*[F.substring("gram", ORDER + 1 - d, d) for d in range(ORDER + 1)])
    nodes = grams.where("n > 0").select("lang", F.explode(contexts).alias("context"), F.substring("gram", ORDER + 1, 1).alias("byte"), "n")
    ranked = nodes.groupBy("context").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "context").limit(max_states)
    kept = kept_contexts([bytes(r["context"]) for r in ranked.collect()], max_states)
    wanted = df.sparkSession.createDataFrame([(c,) for c in sorted(kept)], "context binary")
    found = nodes.join(F.broadcast(wanted), "context").groupBy("lang", "context", "byte").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, dict[int, int]]] = {language: {} for language in languages}
    for language, context, byte, n in zip(*(found.column(c).to_pylist() for c in ("lang", "context", "byte", "n")), strict=True):
        counts[language].setdefault(context, {})[byte[0]] = n
    return Model(languages, tuple({c: dict(sorted(node.items())) for c, node in counts[k].items()} for k in languages), _states(kept))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs)
    told = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return add_language(told, model).drop("text")


#: A kept text costs at most this many times what 99 % of held-out texts of its language cost at most, in bits per byte.
SLACK = 2.0
#: So many bits beyond that are no evidence: a few bytes can be anything.
FREE_BITS = 64.0


def own_costs(df: DataFrame, model: Model) -> DataFrame:
    """``(lang, code)`` of each held-out labelled text that the model says is of its own label.

    ``code`` is the bit pattern of its bits per byte, which sorts as these do.
    """
    rows = df.where(F.coalesce(fold() == 1, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    key = model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            told = zip(batch.column(0).to_pylist(), predict(model, batch.column(1).to_pylist(), key), strict=True)
            own = [(language, bits) for language, (said, _, bits) in told if said == language]
            codes = np.array([bits for _, bits in own], dtype=np.float64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([language for language, _ in own], pa.string()), pa.array(codes, pa.int64())], names=["lang", "code"])

    return rows.mapInArrow(run, "lang string, code long")


def percent_point(codes: DataFrame, percent: int = 99) -> dict[str, int]:
    """The smallest code of each language that ``percent`` of its codes do not exceed, over all rows.

    Found 16 bits at a time by counts, so no task holds a language's rows and the driver at most 65,536
    counts of one.
    """
    written = cut(codes)
    rank: dict[str, int] = {}
    prefix: dict[str, int] = {}
    for shift in (48, 32, 16, 0):
        rows = written
        if prefix:
            chosen = codes.sparkSession.createDataFrame(list(prefix.items()), "lang string, prefix long")
            rows = written.withColumn("prefix", F.shiftright("code", shift + 16)).join(F.broadcast(chosen), ["lang", "prefix"])
        counts: dict[str, list[tuple[int, int]]] = {}
        for r in rows.groupBy("lang", F.shiftright("code", shift).alias("at")).count().collect():
            counts.setdefault(r["lang"], []).append((r["at"], r["count"]))
        for language, found in counts.items():
            left = rank.get(language) or -(-percent * sum(n for _, n in found) // 100)
            for at, n in sorted(found):
                if left <= n:
                    prefix[language], rank[language] = at, left
                    break
                left -= n
    return prefix


def bounds(df: DataFrame, model: Model) -> dict[str, float]:
    """The largest bits per byte that a text of each language may cost, from all labelled texts the model has not seen.

    Only texts that the model says are of their own label count, so wrong labels do not loosen the
    bound.  A language without any such text has no bound.
    """
    return {language: SLACK * float(np.int64(code).view(np.float64)) for language, code in percent_point(own_costs(df, model)).items()}


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts that no learned language codes well, null texts and those without a letter, go.

    A text goes if it costs over ``FREE_BITS`` bits more than the bound of its best language allows.

    Without any learned language nothing can be said and all rows stay.
    """
    labelled = docs.select("doc_id", "text", "lang")
    model = learn(labelled)
    if not model.languages:
        return docs
    # Columns of the documents may be named as the predictions are, and stay.
    said, score, bits = names = ("_stage_lang", "_stage_score", "_stage_bits")
    bound = F.lit(float("inf"))
    for language, most in bounds(labelled, model).items():
        bound = F.when(F.col(said) == language, most).otherwise(bound)
    return add_language(docs, model, names=names).where((F.col(said) != "und") & (F.col(bits) <= bound + FREE_BITS / F.octet_length("text"))).select(*docs.columns)
