"""Texts in chunks, and packed messages between chunks and buckets of a hash space.

A chunk is a row that holds some documents, compressed. Chunks ask the buckets, which hold a range of hashes
each, about just the hashes that they have; so what is known of a corpus never sits in one place, and a hash
that is everywhere costs one entry a chunk.

A sender cuts its hashes into `FAN` ranges at most, so the messages are as many as the chunks times a constant. Where more than `FAN`
chunks ask about a range, blocks of about `FAN` of them first add up what they have, and the blocks ask in their turn about
finer ranges. So however large the corpus is, each group of messages holds about what one chunk has, and each
level of blocks (one for 2 GB of text, two for 500 GB, three for 100 TB in chunks of 8 MB) passes every hash once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, trim

FAN = 256
MESSAGE = "k int, part long, sender long, keys binary, counts binary"
ANSWER = "k int, part long, sender long, counts binary, n long, v long"


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed: high planes are nearly all zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def spread_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(spread(blob), dtype=np.uint64)


def text_bytes(rows: DataFrame, text: str) -> int:
    return rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 1


def range_bits(senders: int, fan: int = FAN) -> int:
    """How many leading bits of a hash name its range: ranges are as many as the senders, rounded up, `fan` at most."""
    return max(0, math.ceil(math.log2(max(1, min(senders, fan)))))


def messages(k: int, sender: int, keys: np.ndarray, counts: np.ndarray, part: int, used: int, more: int, bits: int) -> list[tuple]:
    """Rows of MESSAGE for sorted keys of `bits` bits that share the range `part` of their first `used` bits, cut by their next `more` bits."""
    base, step = part << (bits - used), bits - used - more
    cuts = [0, *np.searchsorted(keys, np.array([base + (j << step) for j in range(1, 1 << more)], dtype=np.uint64)), len(keys)]
    return [
        (k, (part << more) + j, sender, squeeze_sorted(keys[a:b]), squeeze(counts[a:b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
    ]


def _added(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys of a group of messages, their sums, the place of each message's keys there, where its keys end)."""
    keys = [spread_sorted(b) for b in pdf["keys"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([spread(b) for b in pdf["counts"]]).astype(np.float64)).astype(np.int64)
    return distinct, total, place, np.cumsum([len(x) for x in keys])[:-1].tolist()


def corpus_counts(sent: DataFrame, senders: int, bits: int, scratch: Scratch, label: str, fan: int = FAN) -> DataFrame:
    """Rows of ANSWER to the rows of MESSAGE in `sent`: the sums over all senders for the keys of each message, in their order.

    `sent` is cut by `range_bits(senders, fan)` bits. Rows of sender -1 have a range's sum `n` and how many of its keys have a positive one, `v`.
    """
    return _answers(sent, senders, range_bits(senders, fan), bits, scratch, label, fan, 0)


def _answers(sent: DataFrame, senders: int, used: int, bits: int, scratch: Scratch, label: str, fan: int, level: int) -> DataFrame:
    columns = ["k", "part", "sender", "counts", "n", "v"]

    def back(key: tuple, pdf: pd.DataFrame, total: np.ndarray, place: np.ndarray, ends: list[int]) -> list[tuple]:
        return [(key[0], key[1], s, squeeze(x), 0, 0) for s, x in zip(pdf["sender"], np.split(total[place], ends), strict=True)]

    if senders <= fan:

        def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, total, place, ends = _added(pdf)
            rows = [*back(key, pdf, total, place, ends), (key[0], key[1], -1, b"", int(total.sum()), int((total > 0).sum()))]
            trim()
            return pd.DataFrame(rows, columns=columns)

        return scratch.save(sent.groupBy("k", "part").applyInPandas(answer, ANSWER), f"{label}-answers-{level}")
    n_blocks = -(-senders // fan)
    more = min(range_bits(n_blocks, fan), bits - used)
    held = scratch.save(sent, f"{label}-sent-{level}")
    held = held.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "sender"), F.lit(n_blocks)))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, total, _, _ = _added(pdf)
        trim()
        return pd.DataFrame(messages(key[0], key[2], distinct, total, key[1], used, more, bits), columns=["k", "part", "sender", "keys", "counts"])

    def split(key: tuple, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, _, place, ends = _added(pdf)
        total = np.concatenate([spread(b) for b in got.sort_values("part")["counts"]])
        trim()
        return pd.DataFrame(back(key, pdf, total, place, ends), columns=columns)

    above = _answers(held.groupBy("k", "part", "block").applyInPandas(add, MESSAGE), n_blocks, used + more, bits, scratch, label, fan, level + 1)
    own = above.where("sender >= 0").withColumnsRenamed({"sender": "block", "part": "finer"}).withColumn("over", F.shiftright("finer", more))
    own = own.select("k", "over", "block", F.col("finer").alias("part"), "counts")
    answered = held.groupBy("k", "part", "block").cogroup(own.groupBy("k", "over", "block")).applyInPandas(split, ANSWER)
    return scratch.save(answered.union(above.where("sender < 0")), f"{label}-answers-{level}")


def n_chunks(size: int, chunk_bytes: int) -> int:
    return max(1, math.ceil(size / chunk_bytes))


def packed(rows: DataFrame, text: str, chunk_bytes: int) -> DataFrame:
    """(chunk, packed): the rows in chunks of about `chunk_bytes` of text; a longer text is alone. Write it before use, so that a chunk keeps its rows."""
    at_text = rows.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, part = [], 0, 0, TaskContext.get().partitionId()

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 24) + n], pa.int64()), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at_text).slice(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                piece = batch.slice(at, max(1, int(np.searchsorted(sizes, chunk_bytes - size, side="right"))))
                held.append(piece)
                size += int(sizes[piece.num_rows - 1])
                at += piece.num_rows
                if size >= chunk_bytes or at < batch.num_rows:
                    yield chunk()
                    held, size, n = [], 0, n + 1
        if held:
            yield chunk()

    return rows.mapInArrow(pack, "chunk long, packed binary")


def opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()
