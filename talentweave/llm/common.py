"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about so many bytes, so that a task's memory does not
#: depend on how many rows an Arrow batch holds.  One text longer than this is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a single-machine session that names none gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the session's JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, there = _filesystem(spark, path)
    files.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        files, there = _filesystem(df.sparkSession, df.scratch_path)
        files.delete(there, True)


def rows_by_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with columns k1 and k2: 128 bits that tell its rows' keys and texts apart, nulls included."""
    parts = [F.col(f"`{key}`"), F.col(f"`{key}`").isNull(), F.col(f"`{text}`"), F.col(f"`{text}`").isNull()]
    return df.withColumns({"k1": F.xxhash64(F.lit(1), *parts), "k2": F.xxhash64(F.lit(2), *parts)})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Free memory goes back to the system, so that a worker that lives on does not hold what its last task used."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut by the bytes of their texts, each with its texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.fromiter((0 if not x.is_valid else len(x.as_buffer()) for x in column), np.int64, batch.num_rows)
        ends, first = np.cumsum(lengths), 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(first, last - first)
            texts = part.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            texts = [x or b"" for x in texts]
            yield part, texts
            first = last
        batch = column = lengths = part = texts = None  # the next batch is read with none of this one held
    give_back()


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` of ``fn(batch, texts)`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, most):
            out = fn(part, texts)
            del part, texts
            yield out
            del out

    return df.mapInArrow(run, schema)


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text closed by one newline, and where each text starts (one more at the end)."""
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], ends])


#: 1 for the bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of base; those for slices of the usual size are computed once in a process."""
    if n <= SLICE_BYTES + 4096:
        if base not in _KEPT:
            _KEPT[base] = _grown(SLICE_BYTES + 4096, base)
        return _KEPT[base][:n]
    return _grown(n, base)


def _grown(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _MASK
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, equal for equal contents; any number of spans in one pass.

    A polynomial over scrambled values by prefix sums modulo 2**64, with the span's length mixed in.
    """
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    base = (_BASE * (2 * seed + 1)) & _MASK | 1
    table = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8)) if values.dtype == np.uint8 else None
    x = table[values] if table is not None else mixed(values.astype(np.uint64) + np.uint64(seed))
    n = len(values)
    x *= _powers(n, base)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(x, out=sums[1:])
    # divide by base**start, which an odd base allows modulo 2**64
    h = (sums[ends] - sums[starts]) * _powers(n + 1, pow(base, -1, 1 << 64))[starts]
    return mixed(h ^ mixed((ends - starts).astype(np.uint64)))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal spans without separators."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edge[0::2], edge[1::2]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra columns of the input, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes of the spans, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal where the bytes are, and the first span of each number; hashes: of the spans, if there are any.

    Hashes only propose which spans are equal; their bytes are compared, and should two contents ever share a hash,
    the spans are numbered by their bytes.
    """
    code, unique = pd.factorize(span_hashes(data, starts, ends) if hashes is None else hashes)
    first = np.empty(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    like, sizes = first[code], ends - starts
    other = np.flatnonzero(like != np.arange(len(code)))
    like, own = like[other], sizes[other]
    if np.array_equal(own, sizes[like]) and np.array_equal(data[flat(starts[other], own)], data[flat(starts[like], own)]):
        return code, first
    seen: dict[bytes, int] = {}
    raw = data.tobytes()
    code = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    first = np.unique(code, return_index=True)[1]
    return code, first
