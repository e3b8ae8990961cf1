"""Sharding along a Hilbert curve over document metadata (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygraph.llm._frames import documents
from quarrygraph.sources.tables import cut


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """Place of a cell on the Hilbert curve of ``len(point)`` dimensions (Skilling's transpose method)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def curve_table(dimensions: int, bits: int) -> list[int]:
    """Curve index of every cell; cells are numbered with the first dimension most significant."""
    side = 1 << bits
    return [hilbert_index([cell // side ** (dimensions - 1 - d) % side for d in range(dimensions)], bits) for cell in range(side**dimensions)]


def _value_cell(df: DataFrame, column: str, bits: int) -> Column:
    """Equal-depth cells of a text dimension in order of value, however many values it has.

    Values are counted and sorted by range; the rows before each range and then before each value give its
    cell, and only the smallest value of each cell reaches the driver (at most ``2 ** bits``).
    """
    side = 1 << bits
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    # One row a range: as many as there are shuffle partitions.
    parts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, before, starts = sum(n for _, n in parts), 0, []
    for part, n in parts:
        starts.append((part, before))
        before += n
    if not starts:
        return F.lit(0)
    running = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0))
    placed = ranged.join(F.broadcast(df.sparkSession.createDataFrame(starts, "part int, before long")), "part").select("value", "n", seen.alias("seen"))
    cell = F.expr(f"(2 * seen + n) * {side} div {2 * total}")
    edges = sorted((r["cell"], r["value"]) for r in placed.select("value", F.least(F.lit(side - 1), cell).alias("cell")).groupBy("cell").agg(F.min("value").alias("value")).collect())
    found = F.lit(0)
    for at, value in edges:
        found = F.when(F.col(column).cast("string") >= F.lit(value), int(at)).otherwise(found)
    return F.when(F.col(column).isNull(), 0).otherwise(found)


def hilbert_shards(
    df: DataFrame, shards: int = 8, text_dimensions: Sequence[str] = ("lang", "source"), bits: int = 4, rows_per_run: int = 2_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Deal rows to ``shards`` shards of near-equal bytes along a Hilbert curve.

    Dimensions: the named text columns in equal-depth cells, and the logarithm of the text's length.
    Rows are ordered by curve index, then by a hash of their id, and cut where the running size
    passes each further ``1 / shards`` of the total; shards differ by less than one row's size each.

    The order is global but nothing is sorted in one task: every curve cell is split by hash into
    runs of about ``rows_per_run`` rows, run totals (one small row a run) are summed up, and rows are
    numbered within their run; a hot cell has more runs.  The driver gets one row a cell and a shard, never
    one a run.  Null dimensions are cell 0, null texts have size 1, repeated rows and null ids are dealt
    like any others, an empty table gives no rows.  Columns besides the used ones are not read.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    side = 1 << bits
    cell = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor(F.log2(size)) - 4)).cast("int")
    for column in text_dimensions:
        cell = cell * side + _value_cell(df, column, bits)
    curve = F.lit(curve_table(1 + len(text_dimensions), bits))
    # Narrow rows from here on; the text is read once.
    base = cut(
        df.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), cell.alias("cell"))
        .withColumn("curve", F.get(curve, F.col("cell")))
        .withColumn("h", F.xxhash64("doc_id", "text_crc32"))
        .drop("cell")
    )
    # At most side ** dimensions rows.
    cells = base.groupBy("curve").agg(F.count("*").alias("n")).withColumn("runs", F.ceil(F.col("n") / rows_per_run).cast("long"))
    split = base.join(F.broadcast(cells.select("curve", "runs")), "curve").withColumn("run", F.floor((F.shiftrightunsigned("h", 33) * F.col("runs")) / F.lit(1 << 31)).cast("long"))
    # One row a run.  The bytes and rows before each: within its cell by a window, before its cell by the driver,
    # which gets one row a cell.
    totals = cut(split.groupBy("curve", "run").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    bytes_before = rows_before = 0
    of_cell = []
    for r in totals.groupBy("curve").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).orderBy("curve").collect():
        of_cell.append((r["curve"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["bytes"], rows_before + r["rows"]
    total = max(1, bytes_before)
    spark = df.sparkSession
    earlier = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = totals.join(F.broadcast(spark.createDataFrame(of_cell, "curve int, cell_bytes long, cell_rows long")), "curve").select(
        "curve", "run", "bytes", (F.col("cell_bytes") + inside("bytes")).alias("bytes_before"), (F.col("cell_rows") + inside("rows")).alias("rows_before")
    )
    shard_of = lambda at: F.least(F.lit(shards - 1), F.expr(f"({at}) * {shards} div {total}")).cast("int")

    def numbered(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("curve", "run").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id", "text_crc32", "size")
        return (
            rows.join(offsets.drop("bytes"), ["curve", "run"])
            .withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1)
            .withColumn("at", F.col("bytes_before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("shard", shard_of("at"))
        )

    # Where each shard begins: at a run's start, or in one of at most shards - 1 runs that hold a cut.
    starts = {r["shard"]: r["row"] for r in offsets.groupBy(shard_of("bytes_before").alias("shard")).agg(F.min("rows_before").alias("row")).collect()}
    cuts = [(r["curve"], r["run"]) for r in offsets.where(shard_of("bytes_before") != shard_of("bytes_before + bytes - 1")).select("curve", "run").collect()]
    if cuts:
        held = numbered(split.join(F.broadcast(spark.createDataFrame(cuts, "curve int, run long")), ["curve", "run"], "left_semi"))
        for r in held.groupBy("shard").agg(F.min("row").alias("row")).collect():
            starts[r["shard"]] = min(r["row"], starts.get(r["shard"], r["row"]))
    first_row = F.lit([starts.get(i, 0) for i in range(shards)])
    return numbered(split).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.get(first_row, F.col("shard"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index")
    )


def write_shards(df: DataFrame, sharded: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write the rows of ``df`` one folder a shard, in slot order, for min/max pruning on every dimension.

    Rows are matched by ``doc_id``, which must be unique and not null: others are refused by an error.
    """
    bad = sharded.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1)
    if not bad.isEmpty():
        raise ValueError("doc_id is null or repeated")
    placed = df.join(sharded.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
