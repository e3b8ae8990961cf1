"""Readers and writers of question corpora: nested JSON in, chunks and question-answer pairs out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIRS_DDL = "question string, answer string, context array<array<string>>"
PARAGRAPHS_DDL = "question string, answer string, question_decomposition array<struct<answer:string>>, paragraphs array<struct<title:string,paragraph_text:string>>"
PARSES_DDL = "Questions array<struct<RawQuestion:string,Parses:array<struct<Answers:array<struct<EntityName:string,AnswerArgument:string>>>>>>"


def read_items(spark: SparkSession, path: str, ddl: str, start: int = 0, end: int | None = None) -> DataFrame:
    """The items of one JSON array in file order, with their position as ``context_id``; ``[start, end)`` of them.

    A JSON array is one document, which a single task must parse; the positions are taken there, so
    chunks and answers of one slice always agree.
    """
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(ddl)}>>")).alias("context_id", "item"))
    kept = items.where(F.col("context_id") >= start)
    kept = kept if end is None else kept.where(F.col("context_id") < end)
    return kept.select(F.col("context_id").cast("long").alias("context_id"), "item.*")


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def paired_paragraphs(items: DataFrame, unique_titles: bool = True) -> DataFrame:
    """``(context_id, pos, title, text)`` of ``[title, [sentence, ...]]`` pairs; shorter pairs are skipped.

    With ``unique_titles`` the first paragraph of each title in an item stays.
    """
    each = items.select("context_id", F.posexplode("context").alias("pos", "p")).where(F.size("p") >= 2)
    rows = each.select("context_id", "pos", F.col("p")[0].alias("title"), F.array_join(F.from_json(F.col("p")[1], "array<string>"), "").alias("text"))
    return first_titles(rows) if unique_titles else rows


def first_titles(paragraphs: DataFrame) -> DataFrame:
    """Of the paragraphs of a context that share a title, the first by ``pos``."""
    return paragraphs.withColumn("_n", F.row_number().over(Window.partitionBy("context_id", "title").orderBy("pos"))).where("_n = 1").drop("_n")


def listed_paragraphs(items: DataFrame) -> DataFrame:
    """The same columns of ``{title, paragraph_text}`` lists; missing parts are empty."""
    each = items.select("context_id", F.posexplode("paragraphs").alias("pos", "p"))
    return each.select("context_id", "pos", F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.paragraph_text", F.lit("")).alias("text"))


def number_chunks(paragraphs: DataFrame, split: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(context_id, chunk_id, title, text)``: gapless ids over (context, paragraph, part), text prefixed by its title.

    Contexts are counted first and offset by a running total over one small row a context, so no
    window runs over all chunks.
    """
    parts = split(F.col("text")) if split else F.array("text")
    rows = paragraphs.select("context_id", "pos", "title", F.posexplode(parts).alias("part", "piece"))
    counts = rows.groupBy("context_id").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("context_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("context_id").orderBy("pos", "part")) - 1
    text = F.concat(F.col("title"), F.lit(" information: "), F.col("piece"))
    return rows.join(before, "context_id").select("context_id", (F.col("before") + inside).cast("long").alias("chunk_id"), "title", text.alias("text"))


def qa_pairs(items: DataFrame, strip: bool = True) -> DataFrame:
    """``(question, answer, context_id)``; the answer of the last step of a decomposition goes first.  Answers are trimmed if ``strip``."""
    answer = F.col("answer")
    if "question_decomposition" in items.columns:
        answer = F.coalesce(F.try_element_at("question_decomposition", F.lit(-1))["answer"], answer)
    return items.select("question", (F.trim(answer) if strip else answer).alias("answer"), "context_id")


def joined_answers(values: Column, longest: int = 50) -> Column:
    """Aggregate: sorted distinct values, comma-joined; beyond ``longest`` characters cut and marked."""
    joined = F.array_join(F.array_sort(F.collect_set(values)), ", ")
    return F.when(F.length(joined) > longest, F.concat(F.substring(joined, 1, longest - 3), F.lit("..."))).otherwise(joined)


def parsed_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(question, answer)`` of question files with parses; an answer is an entity's name or else its argument."""
    q = spark.read.schema(PARSES_DDL).json(path, multiLine=True).select(F.posexplode("Questions").alias("at", "q"))
    each = q.select("at", F.col("q.RawQuestion").alias("question"), F.explode_outer("q.Parses").alias("p")).select("at", "question", F.explode_outer("p.Answers").alias("a"))
    return each.groupBy("at", "question").agg(joined_answers(F.coalesce("a.EntityName", "a.AnswerArgument")).alias("answer")).select("question", "answer")


def read_delimited(spark: SparkSession, path: str, ddl: str | None = None, tolerant: bool = False) -> DataFrame:
    """Pipe-delimited text with a header and doubled quotes; names are trimmed, ``tolerant`` drops malformed rows.

    Words such as None or NA stay words.
    """
    reader = spark.read.schema(ddl) if ddl else spark.read
    df = reader.csv(path, sep="|", header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED" if tolerant else "PERMISSIVE")
    return df.toDF(*[c.strip() for c in df.columns])


def write_delimited(df: DataFrame, path: str, *order: str) -> None:
    """The counterpart of :func:`read_delimited`; lists are written as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes])
    (flat.orderBy(*order) if order else flat).write.csv(path, sep="|", header=True, quote='"', escape='"', mode="overwrite")


def materialized(spark: SparkSession, path: str, compute: Callable[[], DataFrame], regenerate: bool = False) -> DataFrame:
    """Read ``path`` where it was written before, else compute and write it; Spark alone touches the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if regenerate or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that owns it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def first_existing(spark: SparkSession, *sources: str) -> DataFrame:
    """The first of several sources that exists: delimited text for paths that end in .csv, else Parquet."""
    for path in sources:
        if exists(spark, path):
            return read_delimited(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    raise FileNotFoundError(f"none of {sources}")


def optional(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A delimited source that may be missing: no rows then."""
    return read_delimited(spark, path, ddl) if exists(spark, path) else spark.createDataFrame([], ddl)


def documents_to_rows(documents: DataFrame) -> DataFrame:
    """``documents (page_content, metadata map or struct, ...)`` as text on one line, the metadata's columns and a chunk id of its content and place."""
    kind = documents.schema["metadata"].dataType.typeName()
    meta = [F.col("metadata.*")] if kind == "struct" else [F.col("metadata")]
    text = F.translate("page_content", "\r\n", "  ")
    return documents.select(text.alias("text"), *meta, F.md5(F.concat_ws("|", text, F.col("metadata").cast("string"))).alias("chunk_id"))


def write_results(rows: DataFrame, path: str, order: str = "row_id") -> None:
    """Results as delimited text in the order of their questions, in one file; ``order`` is not written."""
    write_delimited(rows.orderBy(order).drop(order).coalesce(1), path)


def sample(rows: DataFrame, n: int, order: str, last: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows by a column, in its order."""
    return rows.orderBy(F.desc(order) if last else F.asc(order)).limit(n).orderBy(order)


def write_model(spark: SparkSession, weights: dict, path: str) -> None:
    """Weight arrays (name to numbers or nested lists of them) as one Parquet row an array."""
    import numpy as np

    rows = [(name, list(np.shape(w)), np.asarray(w, dtype=float).ravel().tolist()) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict:
    """What :func:`write_model` wrote, as arrays."""
    import numpy as np

    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
