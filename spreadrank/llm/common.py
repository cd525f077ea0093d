"""What the training-text operators share: word splitting, shared scratch tables, one row per document.

Rules that hold for every operator of this subpackage, unless its docstring says otherwise:

* rows without ``doc_id`` are dropped; of rows that repeat a ``doc_id`` the least one (by text, then the other
  columns) counts, so a repeated row changes nothing;
* a null text is a text without words, lines and bytes; it stays null where texts are returned;
* columns that an operator doesn't name are not looked at, whatever they are called.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.functions.lineage import shared_folder

#: Separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, see ``shared_folder``."""
    return shared_folder(spark)


_made: dict[str, SparkSession] = {}


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


atexit.register(_sweep)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/spreadrank/{uuid.uuid4().hex}-{label}"
    _made[path] = spark
    return path


def file_system(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    spare(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove materialized tables that are no longer needed, before the process ends."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = next((p for p in _made if p.split("/spreadrank/")[-1] in file), None)
            if path:
                remove(df.sparkSession, path)
                _made.pop(path, None)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that have been materialized.

    The cleaner works when the driver collects its garbage, which may be long after. Listeners hold the last query until they
    get events of another one.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sql("select 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def spare(spark: SparkSession, share: float = 0.6) -> None:
    """Collect the driver's garbage if its heap has grown to this share of the most it may have.

    Many small steps, one after the other, fill the heap up to its bound with what nobody needs; a full collection gives pages back.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Give freed memory outside of the heap back to the system, in both processes of the driver.

    Hundreds of short-lived threads plan and compile queries; the C library keeps what each of them has freed. JVMs and systems that
    can't do this go on as they are.
    """
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Exception):
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        kind = lambda name: jvm.java.lang.Class.forName(name)
        types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)


def one_row_per_doc(docs: DataFrame, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` with one row per key and no null key. Only keys are shuffled unless some repeat."""
    columns = [c for c in columns or docs.columns if c != key]
    odd = docs.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1))
    if not odd.take(1):
        return docs.select(key, *columns)
    whole = F.struct(*[F.col(c) for c in columns])
    return docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(whole).alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in columns])
