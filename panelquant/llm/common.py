"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.session import scratch_path

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that are held as Python objects at once.
ROWS_AT_ONCE = 256

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage, survives lost executors, and lets the planner see the table's real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df``, written, with ``column``: its rows numbered from 1 on without gaps."""
    held = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    # One row per written partition.
    ahead = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).withColumn(
        "_ahead", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).select("_part", "_ahead")
    return held.withColumn("_part", part).join(ahead, "_part").withColumn(
        column, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_ahead", "_at")


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch],
                 schema: str) -> DataFrame:
    """``function`` over every Arrow batch of ``df``, ROWS_AT_ONCE rows of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield function(batch.slice(low, ROWS_AT_ONCE))

    return df.mapInArrow(run, schema)


class Recent:
    """What a worker remembers of a function of keys, in two generations of ``most`` bytes each.

    Keys in use move to the young generation; when that is full, the old one goes.
    """

    def __init__(self, function: Callable[[list], list[bytes]], most: int) -> None:
        self.function, self.most = function, most
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def get(self, keys: list) -> list[bytes]:
        """The function's value of every key; it is called once for all that are not remembered."""
        found = list(map(self.young.get, keys))
        places = [i for i, v in enumerate(found) if v is None]
        if places:
            missing = {keys[i] for i in places}
            fresh = [k for k in missing if k not in self.old]
            values = {k: self.old[k] for k in missing.difference(fresh)}
            values.update(zip(fresh, self.function(fresh), strict=True))
            for i in places:
                found[i] = values[keys[i]]
            self.held += sum(map(len, values)) + sum(map(len, values.values())) + 200 * len(values)
            self.young.update(values)
            if self.held > self.most:
                self.old, self.young, self.held = self.young, {}, 0
        return found


#: Bytes of text that are taken apart at once.
BYTES_AT_ONCE = 2 << 20


def by_size(batch: pa.RecordBatch, column: str, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``most`` bytes together; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if low < high:
            yield batch.slice(low, high - low)


@dataclass(frozen=True)
class Words:
    """The words of some texts: distinct ones, and for every word its number, start and text."""

    distinct: pa.Array
    number: np.ndarray
    start: np.ndarray
    #: First word of each text, and the end.
    edges: np.ndarray
    #: All bytes of the texts, one after the other.
    data: np.ndarray


def objects(values: pa.Array) -> list:
    """An Arrow array's values; much faster than its own list of scalars."""
    return values.to_numpy(zero_copy_only=False).tolist()


def distinct_words(texts: pa.Array, mapped: np.ndarray) -> Words:
    """Words are runs of bytes that ``mapped`` (256 bytes for 256) does not map to a space.

    Null texts are empty, and no word goes from one text to the next.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = (np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None
            else np.zeros(0, np.uint8))
    offsets = offsets - offsets[0]
    seen = mapped[data]
    inside = seen != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    ends = np.zeros(len(start) + 1, np.int64)
    if len(start):
        ends[1:] = np.cumsum(np.add.reduceat(inside, start, dtype=np.int64))
    found = pa.Array.from_buffers(pa.large_binary(), len(start),
                                  [None, pa.py_buffer(ends), pa.py_buffer(seen[inside])]).dictionary_encode()
    return Words(found.dictionary, found.indices.to_numpy(), start,
                 np.searchsorted(start, offsets), data)


def gathered(parts: list[bytes], number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The items (``width`` bytes each) of ``parts[k]`` for every k of ``number``, and where each k's end."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    pool = np.frombuffer(b"".join(parts), f"<u{width}")
    starts = np.cumsum(sizes) - sizes
    length = sizes[number]
    ends = np.cumsum(length)
    return pool[np.repeat(starts[number] - (ends - length), length) + np.arange(length.sum())], ends


def text_key() -> F.Column:
    """Tells texts of equal ids apart; rows that repeat id and text are one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _MULTIPLIER))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
        return self.up, self.down


POWERS = Powers()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each range, by one running polynomial sum."""
    up, down = POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]
                 ^ (ends - starts).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for every ``n`` consecutive word hashes; fewer words than ``n`` are one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + hashes[i:len(hashes) - n + 1 + i] * _MULTIPLIER)
    return out


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)
