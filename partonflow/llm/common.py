"""Shared by the operators: stored intermediate tables, hashing, and words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the five ASCII controls from tab to carriage return.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, tempfile.mkdtemp(prefix="partonflow-llm-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more, and let Spark give up their shuffle files.

    Shuffle files go when the driver's JVM finds that no plan refers to them, which may be long after.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Have the driver look for plans that are no longer referred to; Spark then removes their shuffle files.

    What the compilers and pools of the driver's JVM have freed outside its heap goes back to the system, where the JVM can do that.
    """
    gc.collect()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    # Called through the interface, as the class of the server is not open to callers; a JVM without the command raises.
    with contextlib.suppress(Py4JError):
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)


def slim() -> None:
    """Give the system back what earlier tasks of this Python worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, split at WORD_SPLIT, as UTF-8."""
    return [] if not text else text.encode("utf-8", "replace").lower().split()


def by_size(texts, limit: int = 4 << 20):
    """Slices (start, stop) of a sequence of texts, each of about ``limit`` characters at most or one text."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text) if text else 0
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
