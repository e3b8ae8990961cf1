"""Model providers as row functions: retries that keep every row, and offline stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def map_rows(df: DataFrame, call: Callable[[dict], str | None], workers: int = 15, retries: int = 6, delay: float = 2.0, seconds: float = 100.0) -> DataFrame:
    """All rows with ``result`` and ``status`` (ok, empty, or the last error), replacing columns of those names.

    Rows go through a thread pool a task, in batches, with doubling waits between attempts.  A row
    that fails stays, and so does one whose attempts have used up ``seconds`` (checked between
    attempts; a call is not interrupted).
    """
    kept = df.drop("result", "status")
    schema = StructType([*kept.schema.fields, StructField("result", StringType()), StructField("status", StringType())])

    def one(row: dict) -> tuple[str | None, str]:
        began, error = time.monotonic(), "not tried"
        for attempt in range(retries):
            try:
                value = call(row)
                return value, "empty" if value is None else "ok"
            except Exception as e:  # a provider may raise anything; the status keeps it
                error = f"{type(e).__name__}: {e}"[:200]
                wait = delay * 2**attempt
                if attempt + 1 == retries or time.monotonic() - began + wait > seconds:
                    break
                time.sleep(wait)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.to_dict("records")))
                yield batch.assign(result=[f[0] for f in found], status=[f[1] for f in found])

    return kept.mapInPandas(run, schema)


def hashing_embedding(dim: int = 256) -> Callable:
    """Offline embedding: words hashed into ``dim`` signed cells, unit length; zeros for a text without words."""
    import re

    import xxhash

    word = re.compile(r"\w+")

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in word.findall((text or "").lower()):
                h = xxhash.xxh64_intdigest(w, 0)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed
