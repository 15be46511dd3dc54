"""Shared pieces of the training-data operators: shared scratch tables, tokens, hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Arrow's own pools keep what is freed; workers share an executor's memory with its JVM
pa.set_memory_pool(pa.system_memory_pool())


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives memory that is free within the process back to the system, where the C library can."""
    if _TRIM is not None:
        _TRIM(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where the session names none and runs within one process (tests), a folder of this machine is set. On a cluster
    that would leave each machine with files that no other sees, so there it is an error.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_DIR} names no folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that begin as `names` do and that no column of `df` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_numbers(df: DataFrame, key: str) -> None:
    """Raises if the key's column isn't one of whole numbers, rather than let a cast make nulls of its values."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a column of whole numbers, not {kind}")


class Scratch:
    """Tables written to the shared folder, which cut the lineage and outlive lost executors.

    Each scratch has a folder of its own. `drop` removes a table that is no longer read; what is
    left goes when the driver ends, as a returned DataFrame may still read it. The shuffle files of what is saved
    go as soon as it is, since nothing reads them any more. As rows hold whole texts,
    the session's Arrow batches are held to `BATCH_ROWS` rows.
    """

    BATCH_ROWS = 1000
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > self.BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", self.BATCH_ROWS)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        self.drop(*(name for name in held if name not in names))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; its folder goes with it
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


class Digests(dict):
    """64-bit hashes of tokens, with a bounded memory of those seen."""

    LIMIT = 250_000

    def __missing__(self, token: bytes) -> int:
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_RNG = np.random.default_rng(0x517E)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 17
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _RNG.integers(1, 1 << 64, size=256, dtype=np.uint64, endpoint=False)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_VALUE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * np.uint64(step)
            done, step = done * 2, step * step % (1 << 64)
    return out


_UP = _powers(_BASE, _PIECE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\x20\x09-\x0D]+` of a text, A-Z in lower case, in order.

    A word's hash is a polynomial in its bytes modulo 2**64, mixed: differences of prefix sums give those of
    all words at once. Long texts go in pieces that end between words.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(codes) <= _PIECE:
        return _hash_piece(codes, _UP, _DOWN)
    out, at = [], 0
    while at < len(codes):
        end = min(at + _PIECE, len(codes))
        if end < len(codes):
            gaps = np.flatnonzero(_SPACE[codes[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the piece: take it whole
                while end < len(codes) and not _SPACE[codes[end]]:
                    end = min(end + _PIECE, len(codes)) if not _SPACE[codes[end : end + _PIECE]].any() else end + int(np.argmax(_SPACE[codes[end : end + _PIECE]]))
        size = end - at + 1
        out.append(_hash_piece(codes[at:end], *((_UP, _DOWN) if size <= len(_UP) else (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)))))
        at = end
    return np.concatenate(out)


def _hash_piece(codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_SPACE[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[codes] * up[: len(codes)])])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive words."""
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class BitFilter:
    """A fixed number of bits that say which keys may be wanted: no false negatives at any number of keys.

    The bits are set on the executors and reach the driver as `bits` / 64 words at most (2 to 8 MB).
    """

    def __init__(self, wanted: DataFrame, key: str, bits: int = 1 << 24, hashed: bool = False):
        """`hashed`: the key is itself a 64-bit hash."""
        self.bits = bits
        at = wanted.select(F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(bits)).alias("at"))
        set_words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")).toPandas()
        found = np.zeros(bits >> 6, dtype=np.int64)
        found[set_words["word"].to_numpy(dtype=np.int64)] = set_words["bits"].to_numpy(dtype=np.int64)
        self.shared = wanted.sparkSession.sparkContext.broadcast(found)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (self.bits - 1)
        return (self.shared.value[at >> 6] >> (at & 63)) & 1 == 1

    def keep(self, rows: DataFrame, key: str) -> DataFrame:
        @F.pandas_udf("boolean")
        def wanted(hashes: pd.Series) -> pd.Series:
            return pd.Series(self.maybe(hashes.to_numpy(dtype=np.int64)))

        return rows.where(wanted(F.xxhash64(key)))
