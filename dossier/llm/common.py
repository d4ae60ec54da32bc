"""What the operators of this subpackage share: reading, scratch tables, and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a character class without brackets, and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_local: list[tempfile.TemporaryDirectory] = []
#: (session, folder) of the folders handed out and not yet removed.
_handed: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine may do without that setting; its folder goes with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="dossier-", ignore_cleanup_errors=True))
        root = "file://" + _local[0].name
    folder = f"{root.rstrip('/')}/dossier/{uuid.uuid4().hex}"
    _handed.append((spark, folder))
    return folder


def handed_out() -> int:
    """How many scratch folders stand, as a mark for release."""
    return len(_handed)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes this session's scratch folders handed out since a mark, but for the last few to keep.

    What stands in them must have been read or written on by then.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    own = [h for h in _handed[since:] if h[0] is spark]
    for h in own[: len(own) - keep]:
        path = jvm.org.apache.hadoop.fs.Path(h[1])
        path.getFileSystem(conf).delete(path, True)
        _handed.remove(h)


def materialise(df: DataFrame, **options) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, max_broadcast_rows: int = 400_000, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows, to be joined by broadcast if a count shows that they are few, and a sum of their texts that they are short."""
    rows = materialise(rows)
    width = sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in rows.schema if f.dataType.typeName() in ("string", "binary")), F.lit(16 * len(rows.columns)).cast("long"))
    n, size = rows.limit(max_broadcast_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(rows) if n <= max_broadcast_rows and size <= max_broadcast_bytes else rows


def _with_place(rows: DataFrame) -> DataFrame:
    """The rows, written out, with the file that each stands in and its place there."""
    return materialise(rows).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with number, their place from 0 within their group by an order, without a task for each group.

    All rows are sorted by group and order over as many tasks as they need and written; a row's number follows from the
    rows of the files before its own. Rows that tie come in the order of their place in the input's written form, so that
    a third of all rows may be equal and still go to many tasks. What is broadcast has a row for each task that wrote.
    """
    salt = F.xxhash64("__file", "__at")
    placed = _with_place(_with_place(rows).orderBy(*[F.asc_nulls_first(g) for g in group], *order, salt).drop("__file", "__at"))
    part = F.regexp_extract("__file", r"part-(\d+)", 1).cast("int")
    files = placed.groupBy("__file").agg((F.max("__at") + 1).alias("__n"))
    before = Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = placed.join(F.broadcast(starts), "__file").withColumn("number", F.col("__start") + F.col("__at")).drop("__file", "__at", "__start")
    if not group:
        return out
    first = few(out.groupBy(*group).agg(F.min("number").alias("__first"))).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__first")
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return out.join(first, same).withColumn("number", F.col("number") - F.col("__first")).select(*rows.columns, "number")


def stripped(text: Column) -> Column:
    """The text without white space at its ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text; empty for null or blank texts."""
    bare = stripped(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with doc: doc_id and the text's hash, so that repeated rows are one document and other texts another."""
    return docs.withColumn("doc", F.struct(F.col("doc_id"), F.xxhash64(text).alias("of")))


def with_columns_of(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of docs but some, as one struct: names of the caller's can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])
