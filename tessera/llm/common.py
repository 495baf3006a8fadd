"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# byte table: A-Z to lower case, every other ASCII byte that is no digit or letter to a space
_ITEM = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _ITEM[_b] = ord(_c.lower()) if _c.isalnum() else 0x20
ITEM_TABLE = bytes(_ITEM)


def item_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lower-cased text, as UTF-8 bytes."""
    return raw.translate(ITEM_TABLE).split()


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text, as UTF-8 bytes."""
    return raw.lower().split()


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *extra: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and the named columns, so that further columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c) for c in extra])


def ascii_lower(c):
    """A-Z to lower case only; the other code points stay (``lower`` is used where it does the same)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, AZ, az))


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id, y, h`` of the ``max_rows`` labelled documents with the smallest hash of doc_id (all where there are fewer).

    At most ``max_rows`` ids and labels pass the driver, so the result may be broadcast: texts are then
    joined without being shuffled. Null ids and labels are left out; repeated ids count once.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    rows = lab.orderBy("h").limit(max_rows).collect()
    return labels.sparkSession.createDataFrame([(r.doc_id, r.y, r.h) for r in rows], "doc_id long, y int, h long").hint("broadcast")


def release(spark: SparkSession) -> None:
    """Let the driver's JVM drop unreachable shuffles now, so that their files go before more are written.

    Spark removes a shuffle's files in the background once its driver has collected the objects that
    refer to it; some of these are only found by a second collection.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def trim() -> None:
    """Give a Python worker's free memory back to the machine; workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):            # another C library: nothing to do
        pass


def ranges_for(docs: DataFrame, text: str = "text", text_bytes: int = 8_000_000, least: int = 8) -> int:
    """Number of hash ranges of which each takes the words of about ``text_bytes`` of text, however large the table is."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(least, -(-int(total) // text_bytes))


def crc_bucket(doc_id, n: int):
    """crc32 of doc_id as text, modulo n (null doc_id: the empty string)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers (shift, multiply, twice)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
