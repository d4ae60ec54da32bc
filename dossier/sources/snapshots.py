"""Snapshots as they are captured and as they are kept: each content of a source once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "workspace_id int, source_id bigint, snapshot_id bigint, content string, retrieved_at timestamp, content_hash string"
KEYS = ["workspace_id", "source_id", "content_hash"]
#: Columns of captured documents.
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    """Captured documents, by a stated schema: nothing is inferred, and only the columns asked for are read."""
    return spark.read.schema(schema).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source, content_type (by the ending), n_bytes, content (binary), content_hash of raw files, whole, from a folder or pattern."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("source"), ending.alias("content_type"), F.col("length").alias("n_bytes"), "content", F.sha2("content", 256).alias("content_hash"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, content of text files, each as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


class Store:
    """Snapshots on a shared file system, each content of a source once, with atomic appends.

    A writer puts its rows into a folder of its own, which nobody reads, and publishes it by a commit: a file that names all
    folders that count, moved to the next number in one step that fails if the number is taken. Then another writer was
    first; what it added is left out of the rows, and the commit is tried again. What a job that ended halfway has left is
    named by no commit, and one that is run again after its commit finds nothing new. The move is atomic on file systems
    with an exclusive rename, such as HDFS and local ones.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._at = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._files = self._at("").getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the last commit; 0 without any."""
        at = self._at("commits")
        return max((int(f.getPath().getName()) for f in self._files.listStatus(at) if f.getPath().getName().isdigit()), default=0) if self._files.exists(at) else 0

    def folders(self, version: int) -> list[str]:
        """The folders that a commit names."""
        return self.spark.read.text(f"{self.path}/commits/{version:012d}", wholetext=True).first()[0].split("\n") if version else []

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(self.version() if version is None else version))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])

    def append(self, snapshots: DataFrame, content_hash: Column) -> int:
        """Adds the snapshots that the store hasn't got, and returns the number of the commit that has them."""
        seen = self.version()
        named = self.folders(seen)
        rows = new_snapshots(snapshots, self._read(named), content_hash)
        while True:
            attempt = f"attempt={uuid.uuid4().hex}"
            rows.write.partitionBy("workspace_id").parquet(f"{self.path}/data/{attempt}")
            own = self._read([attempt])
            if not own.limit(1).count():
                return seen
            if self._publish(seen + 1, [*named, attempt]):
                return seen + 1
            now = self.version()
            newer = self.folders(now)
            rows = own.join(self._read([f for f in newer if f not in named]).select(*KEYS), KEYS, "left_anti").select(*own.columns)
            seen, named = now, newer

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Whether the commit of this number is this one."""
        held, to = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{version:012d}")
        out = self._files.create(held, False)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(held, to, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._files.delete(held, False)
            return False
        return True


def new_snapshots(snapshots: DataFrame, stored: DataFrame | None, content_hash: Column) -> DataFrame:
    """The earliest snapshot of each source and content that isn't stored already, in the columns of the store."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = snapshots.withColumn("content_hash", content_hash)
    first = F.min_by(F.struct("snapshot_id", "content", "retrieved_at"), "snapshot_id").alias("s")
    rows = rows.groupBy(*KEYS).agg(first).select(*KEYS, "s.*")
    if stored is not None:
        rows = rows.join(stored.select(*KEYS), KEYS, "left_anti")
    return rows.select(*[F.col(c).cast(k) for c, k in (x.split() for x in SCHEMA.split(", "))]).select(*columns)
