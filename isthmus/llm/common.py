"""Shared pieces of the text operators: scratch tables, word splitting and hashing over byte buffers.

Everything here works on whole Arrow batches with numpy; no function keeps more
than one batch of texts.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are sent to Python in batches of so many rows at most, so that a batch of long texts stays small.
BATCH_ROWS = "1000"

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _word_table(is_word) -> np.ndarray:
    return np.array([is_word(c) for c in range(256)], dtype=bool)


#: ``[^\x20\x09-\x0D]+`` on UTF-8 bytes.
SPACED = _word_table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased UTF-8 bytes.
ALNUM = _word_table(lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, unless the session sets its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="isthmus-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, so that a lost executor costs one table's tasks only."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def fresh(name: str, taken: list[str]) -> str:
    """The name with as many underscores behind it as keep it apart from the columns taken, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def besides(columns: list[str], *names: str) -> list[str]:
    """The columns whose names are none of these, in any case."""
    return [c for c in columns if c.lower() not in names]


def released() -> None:
    """Gives memory that this Python process has freed back to the machine; workers live on between tasks, the driver between phases."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(spark: SparkSession) -> str:
    """Has the driver's JVM give back native memory that it has freed, as released() does for Python; what it compiles for each plan else stays with it in pieces. Returns what the JVM says, nothing where it knows no such command."""
    from py4j.protocol import Py4JError

    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    name_of = jvm.java.lang.Class.forName
    types, given = array(jvm.java.lang.Class, len(kinds)), array(jvm.java.lang.Object, len(kinds))
    try:
        for i, kind in enumerate(kinds):
            types[i] = name_of(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By its interface: the server's own class is not open to others.
        call = name_of("javax.management.MBeanServerConnection").getMethod("invoke", types)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # an older JVM, or another C library
        return ""


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing needs any more, and lets Spark drop the shuffle files of what has been computed: disk holds one phase at a time."""
    spark = tables[0].sparkSession if tables else SparkSession.active()
    for t in tables:
        p = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    released()
    spark._jvm.System.gc()
    trimmed(spark)


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and the offsets of the texts (one more than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" " * 16, dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return buf, np.concatenate([[0], ends])


def words_in(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of joined(), and the index of each text's first word (one more than texts)."""
    inside = table[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The buffer as overlapping little-endian 64-bit words, one from each byte on."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(31))) * _C2
    h = (h ^ (h >> np.uint64(29))) * _C3
    return h ^ (h >> np.uint64(32))


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each piece buf[start:end]; the same bytes give the same value in every process, and pieces that collide under one seed part under another: the seed is spread before the length is mixed in."""
    lens = (ends - starts).astype(np.int64)
    h = lens.astype(np.uint64) * _C1
    if seed:
        h = mixed(h + mixed(np.array([seed], dtype=np.uint64)))
    if not len(h):
        return h
    words, left, off = lanes(buf), np.arange(len(h)), 0
    while len(left):
        rest = np.minimum(lens[left] - off, 8).astype(np.uint64)
        chunk = words[starts[left] + off] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        x = (h[left] ^ (chunk * _C2)) * _C1
        h[left] = x ^ (x >> np.uint64(32))
        off += 8
        left = left[lens[left] > off]
    return mixed(h)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` values (len(h) - length + 1 of them), from runs of powers of two."""
    if len(h) < length:
        return h[:0]
    n, out, at, level, width, k = len(h) - length + 1, None, 0, h, 1, 0
    while width <= length:
        if length & width:
            part = level[at : at + n]
            out = part.copy() if out is None else mixed(out * _C1 + part)
            at += width
        if 2 * width <= length:
            level = mixed(level[:-width] * _C3 + level[width:] + np.uint64(k))
        width, k = width * 2, k + 1
    return out


def crc_side(column: str = "doc_id"):
    """crc32 of the decimal text of an id, modulo 5 (null as -1, thus on no special side)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(-1))


def blocks_for(df: DataFrame, column: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes a text column makes; one pass over lengths."""
    total = df.agg(F.sum(F.octet_length(column).cast("long") + 16).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))
