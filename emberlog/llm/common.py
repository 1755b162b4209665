"""What the corpus operators share: reading, text normal forms, and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: A run of white space as every word rule here means it.
WHITE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes, of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, gets a temp folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Make a session fit for the Python operators: the package reaches the workers, and Arrow batches of long
    texts stay small, in the JVM and in Python."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What operators keep in a Python worker between tasks, by operator.
CACHES: dict[str, dict] = {}


def in_arrow(df: DataFrame, run, schema: str, keeps: str = "") -> DataFrame:
    """``mapInArrow`` whose worker, which outlives its tasks, drops what operators other than ``keeps`` left in it and
    hands memory back to the machine at a task's end."""

    def lean(batches):
        import emberlog.llm.common as worker

        for operator, cache in worker.CACHES.items():
            if operator != keeps:
                cache.clear()
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        for out in run(batches):
            yield out
            del out
        if trim:
            trim(0)

    prepare(df.sparkSession)
    return df.mapInArrow(lean, schema)


#: Paths of the tables written so far, oldest first.
WRITTEN: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/emberlog/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Write ``df``, whose rows of one key lie in one partition of a hash of the key, as a table of ``buckets`` files
    sorted by the key, in the shared folder. Joins on the key read it without shuffle or sort."""
    spark, ordering = df.sparkSession, "spark.sql.legacy.bucketedTableScan.outputOrdering"
    name, before = f"emberlog_{uuid.uuid4().hex}", spark.conf.get(ordering)
    path = f"{shared_dir(spark)}/emberlog/{label}-{name}"
    spark.conf.set(ordering, "true")
    try:
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(ordering, before)
    _remember(spark, path)
    return spark.table(name)


def _remember(spark: SparkSession, path: str) -> None:
    WRITTEN.append(path)
    atexit.register(drop_path, spark, path)


def drop_written(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables written since ``WRITTEN`` had that length, except the last ``but``."""
    gone = WRITTEN[since : len(WRITTEN) - but]
    del WRITTEN[since : len(WRITTEN) - but]
    for path in gone:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table; a stopped session leaves it to the folder's own expiry."""
    context = spark.sparkContext
    if context._jsc is None or context._gateway is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the cheap path with the same result."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(exact)


def word_count(text: Column) -> Column:
    """Number of maximal runs outside white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fold(column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0 marks the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
