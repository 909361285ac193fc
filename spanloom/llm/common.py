"""Shared helpers: scratch tables in the cluster's shared folder, and text columns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of a query as it ends; read when a query starts.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a folder of this machine
    is set for the session. On a cluster an absent setting is an error, since a
    machine-local folder would be lost with its machine.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set(_CHECKPOINT_DIR, root)
    return root.rstrip("/")


#: The folder of this process under each shared folder; all are deleted when it ends.
_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    root = scratch_root(spark)
    if root not in _OWN:
        _OWN[root] = f"{root}/spanloom-{uuid.uuid4().hex}"
        # Results are read from these tables as late as the caller likes, so nothing earlier may delete the last ones.
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), _OWN[root])
    return _OWN[root]


def _delete(jvm, configuration, path: str) -> None:
    """Delete a folder, if the JVM is still there to do so."""
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(configuration).delete(target, True)
    except Exception:  # noqa: BLE001 - at the end of a process nothing is left to handle it
        pass


class Scratch:
    """Tables written under the shared folder by one run of an operator.

    ``save`` cuts the lineage: the rows are written as Parquet and read again, so a lost
    executor never forces the earlier stages to run anew. The shuffle files of that write go
    with its end, not when the driver happens to collect its garbage. ``drop`` deletes a table that no
    later step reads; those that results are read from go when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._tables: list[DataFrame] = []  # alive, so that ids stay theirs
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        before = self.spark.conf.get(_FILE_CLEANUP, "false")
        self.spark.conf.set(_FILE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_FILE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._tables.append(out)
        return out

    def tables(self) -> list[DataFrame]:
        """The tables that are not dropped."""
        return [df for df in self._tables if id(df) in self._paths]

    def keep_only(self, *wanted: DataFrame) -> None:
        """Drop every table but these: no later step may read the others."""
        for key in set(self._paths) - {id(df) for df in wanted}:
            self._drop(key)

    def drop(self, df: DataFrame) -> None:
        self._drop(id(df))

    def _drop(self, key: int) -> None:
        path = self._paths.pop(key)
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, most: int = 2000) -> None:
    """Lower the session's rows per Arrow batch to ``most``: rows that hold whole texts are large,
    and both the executor and its Python workers hold a batch several times over."""
    now = int(spark.conf.get(_BATCH_ROWS, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(_BATCH_ROWS, str(most))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def numbered_rows(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``_doc``, a long that tells rows apart and stands in the order of ids, and ``_row``, a struct
    of all columns; and whether ids alone tell rows apart.

    ``_doc`` is the id itself if all ids are there and differ. Otherwise the distinct pairs of
    id (null last) and text (null as empty, by its MD5) are sorted and numbered, so that only
    rows that repeat both share a number, and the result is a written table.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    odd = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("_id IS NULL OR n > 1")
    if odd.isEmpty():
        return rows.select(F.col("_id").alias("_doc"), "_row"), True
    tagged = rows.withColumn("_md5", F.unhex(F.md5(text_or_empty(f"_row.{text_col}").cast("binary"))))
    pairs = tagged.select("_id", "_md5").distinct().sort(F.col("_id").asc_nulls_last(), "_md5")
    numbers = scratch.save(pairs.withColumn("_doc", F.monotonically_increasing_id()))
    numbers = numbers.select(F.col("_id").alias("_same_id"), F.col("_md5").alias("_same_md5"), "_doc")
    joined = tagged.join(numbers, F.col("_id").eqNullSafe(F.col("_same_id")) & (F.col("_md5") == F.col("_same_md5")))
    return scratch.save(joined.select("_doc", "_row")), False


def is_held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold that models never learn from: crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


class Remembering(dict):
    """A bounded memo for ``map(memo.__getitem__, keys)``: missing values are made and kept.

    Two generations of at most ``most`` entries are held; when the young one is full it
    becomes the old one, and what is still in use moves over as it is looked up.
    """

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` whose worker gives freed memory back when a task ends.

    Workers outlive tasks and stages; without this each keeps the most it ever used.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped
