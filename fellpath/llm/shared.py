"""Plumbing that the operators of this subpackage share.

* reading a table and naming its columns without clashes,
* the folder that driver and executors share, and tables written there,
* vectorised word cutting and hashing over Arrow string buffers.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts can be long, so batches stay small.
ARROW_ROWS = 500
#: Bytes of text that one vectorised step handles at once (one longer text is a step by itself).
STEP_BYTES = 2_000_000


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (single-machine tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="fellpath-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Ask Hadoop to remove a scratch path when the application ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing, and Spark knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fellpath-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: few rows, so few long texts, in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def id_key(name: str = "doc_id"):
    """A document's id as a join key: null counts as the smallest id."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)).cast("long"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- vectorised words -------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20_240_607)
#: A random 64-bit value for each byte, and odd multipliers of the polynomial hashes.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words longer than this many bytes are hashed one by one.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts that lie one after another in one byte buffer.

    start, end: byte range of each word; first: index of the first word of each text, and the number of all words last;
    doc: the text of each word.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.buf, self.offsets = buf, offsets
        word = ~_SPACE[buf] if inside is None else inside[buf]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word never crosses from one text to the next
        begin[edges] = word[edges]
        stop[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = word[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit polynomial (Rabin-Karp) hash of each word's bytes, finalised."""
        buf = _LOWER[self.buf] if lower else self.buf
        size = self.end - self.start
        h = size.astype(np.uint64)
        active = np.flatnonzero(size <= _LONG)
        at = self.start[active]
        left = size[active]
        part = h[active]
        while len(active):
            part = part * _BASE + _BYTE[buf[at]]
            left = left - 1
            done = left == 0
            if done.any():
                h[active[done]] = part[done]
                more = ~done
                active, at, left, part = active[more], at[more], left[more], part[more]
            at = at + 1
        for i in np.flatnonzero(size > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)

    def grams(self, h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
        """The hash of the n words from each word on; only meaningful where n words of the same text follow."""
        total = max(0, len(h) - n + 1)
        out = np.zeros(total, dtype=np.uint64)
        step = np.uint64((int(_BASE) * (2 * seed + 1)) % 2**64 | 1)
        for i in range(n):
            out = out * step + h[i : i + total]
        return mix(out)

    def valid(self, n: int) -> np.ndarray:
        """Index of each word from which n words of the same text follow."""
        total = max(0, len(self.start) - n + 1)
        at = np.arange(total)
        return at[at + n <= self.first[1:][self.doc[:total]]]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most STEP_BYTES of text (one row at least), with the text's bytes and offsets."""
    for batch in batches:
        buf, offsets = strings(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
            yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
