"""Packing documents into sequences by minimum bin slack.

A document's ids fill whole windows from its start; what is left over, shorter than a window, is an
item of one of ``capacity - 1`` lengths. The items are counted by length, and the windows are filled
from these counts: the longest item left goes in, and a subset-sum dynamic program over the counts
(a bitset of reachable fills, counts split into powers of two) finds the multiset of further
lengths that comes closest to the capacity; the bitsets kept on the way give its counts back. One such
filling serves as many windows as its scarcest length allows, so the plan's size depends on the
capacity and not on the number of documents. Where no multiset fills the window, the longest item
left is cut to close it and its rest becomes an item. The last tokens, too few for a window, are cut
into sequences of a power of two each, which need no padding.

Which document is the k-th of its length is found in Spark, by rows inside salted groups and sums
between them, so no length, however common, is one task's load. Only the counts by length
reach the driver.

Null texts are empty: one piece with the end id. Repeated rows are packed each. Empty tables give
empty results. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.llm.common import Recent, by_size, distinct_words, gathered, objects, written

CAPACITY = 4096
END = 2
#: Rows of one salted group, on average.
ROWS_PER_SALT = 1 << 12
MOST_REMEMBERED = 96 << 20

#: Words made of these alone are lower-cased and split here; the tokeniser's own normaliser takes the rest.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
#: Pieces of plain lower-case words; line feeds stand between words.
_PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x09:0x0E] = 0x20

# --- ids ---------------------------------------------------------------------------------------

def shown_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes show themselves; the others are numbered from 256 on in their order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = sorted(set(range(256)) - printable)
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a tokeniser file whose pieces never cross ASCII white space.

    Distinct words are encoded once and remembered. The pieces of plain words are merged many at a
    time by the same merge list; this is the library's result because every merge makes a token that no
    other merge makes, and merging a token's own characters gives back that token (tested).
    """

    #: Ends a piece; no character shows as it, and no plain word has it.
    _END = "\x7f"

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        shown, suffix = shown_bytes(), model["end_of_word_suffix"]
        # Tokens in the order in which they are made: bytes, characters, last characters, merges.
        spelt = {c: c for c in shown} | {c + suffix: c + self._END for c in shown}
        order = {bytes([b]): None for b in range(256)}
        order.update((spelt[t].encode(), ids[t]) for t in spelt)
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            spelt[a + b] = spelt[a] + spelt[b]
            order[spelt[a + b].encode()] = ids[a + b]
        self.merger = tiktoken.Encoding("pieces", pat_str="[^ ]+", special_tokens={},
                                        mergeable_ranks={t: rank for rank, t in enumerate(order)})
        self.ids = np.array([0 if i is None else i for i in order.values()], "<u4")
        self.show = {b: c for b, c in enumerate(shown) if b not in (0x20, 0x7F)}
        self.between = self.merger.encode_single_token(shown[0x0A] + self._END)
        self.words = Recent(self.encode, MOST_REMEMBERED)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without ASCII white space."""
        if not words:
            return []
        joined = b"\n".join(words).decode()
        texts = joined.split("\n")
        other = [i for i, t in enumerate(texts) if not t.isascii() and not _PLAIN.fullmatch(t)]
        if _CONTROL.search(joined) or any(s in joined for s in self.special):
            other = [i for i, t in enumerate(texts) if not _PLAIN.fullmatch(t) or any(s in t for s in self.special)]
        if other:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)
            for i in other:
                texts[i] = ""
            joined = "\n".join(texts)
        pieces = " ".join([p + self._END for p in _PIECE.findall(joined.lower())])
        ranks = np.array(self.merger.encode_ordinary(pieces.encode().decode("latin-1").translate(self.show)), np.int64)
        keep = ranks != self.between
        stops = np.append(np.cumsum(keep)[~keep], keep.sum()) * 4
        raw = self.ids[ranks[keep]].tobytes()
        out = [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        for i, e in zip(other, found if other else (), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of every text with ``end`` behind them, as bytes."""
        words = distinct_words(texts, _SPACES)
        ids, ends = gathered(self.words.get(objects(words.distinct)), words.number, 4)
        stops = np.concatenate([[0], ends])[words.edges[1:]]
        offsets = np.concatenate([[0], stops + np.arange(1, len(texts) + 1)]) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.insert(ids, stops, end).astype("<u4"))]).cast(pa.binary())


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokens(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and ids: each text's ids and ``end``, little-endian unsigned 32-bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _encoder(path)(part.column("text"), end)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, ids binary")


# --- the plan ----------------------------------------------------------------------------------

def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """Length: times of the multiset that fills a window best and holds the longest length; its fill.

    ``lengths`` rises. Longer lengths come first in the dynamic program, so that of equal fills
    one of few, long items is traced back.
    """
    longest = lengths[-1]
    mask = (1 << capacity + 1) - 1
    reach, layers = 1 << longest, []
    for length in reversed(lengths):
        left = min(counts[length] - (length == longest), (capacity - longest) // length)
        several = 1
        while left > 0:
            times = min(several, left)
            layers.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            several *= 2
        if reach >> capacity:
            break
    fill = at = reach.bit_length() - 1
    used = {longest: 1}
    for length, times, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return used, fill


@dataclass
class Items:
    """``count`` items of one length, in order: the parts from ``start`` on of the items of length
    ``origin`` from rank ``first`` on, cut ``layer`` times before."""

    origin: int
    first: int
    count: int
    layer: int
    start: int


#: One row of a plan: items as in Items, the piece's length, the first item's number among those dealt
#: together, the sequence of number 0, items of a sequence, offset of the first of them.
PLAN = ("origin", "first", "count", "layer", "start", "length", "number", "sequence", "each", "offset")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Rows of PLAN that place every item of ``counts`` (length: items), and the number of sequences."""
    counts = {length: n for length, n in counts.items() if n}
    lengths = sorted(counts)
    pools = {length: deque([Items(length, 0, n, 0, 0)]) for length, n in counts.items()}
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def take(length: int, n: int) -> Iterator[Items]:
        counts[length] -= n
        pool = pools[length]
        if not counts[length]:
            del counts[length], pools[length]
            lengths.remove(length)
        while n:
            x = pool[0]
            got = min(n, x.count)
            yield Items(x.origin, x.first, got, x.layer, x.start)
            n -= got
            if got == x.count:
                pool.popleft()
            else:
                x.first += got
                x.count -= got

    def give(length: int, items: Items) -> None:
        if length not in counts:
            insort(lengths, length)
            counts[length], pools[length] = 0, deque()
        counts[length] += items.count
        pools[length].append(items)

    def place(items: Items, length: int, number: int, each: int, offset: int, cut: int = 0) -> None:
        rows.append((items.origin, items.first, items.count, items.layer, items.start + cut, length, number,
                     sequence, each, offset))

    while counts:
        used, fill = fullest(lengths, counts, capacity)
        slack = capacity - fill
        closing = next((x for x in reversed(lengths) if counts[x] > used.get(x, 0)), 0) if slack else 0
        if slack and not closing:
            # The last tokens of all.
            parts = [x for length, n in sorted(used.items(), reverse=True) for one in list(take(length, n))
                     for x in _single(one, length)]
            sequence = _tail(parts, fill, rows, sequence)
            break
        need = dict(used)
        if closing:
            need[closing] = need.get(closing, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        offset = 0
        for length, each in sorted(used.items(), reverse=True):
            number = 0
            for items in list(take(length, each * times)):
                place(items, length, number, each, offset)
                number += items.count
            offset += each * length
        if closing:
            number = 0
            for items in list(take(closing, times)):
                place(items, slack, number, 1, offset)
                number += items.count
                give(closing - slack, Items(items.origin, items.first, items.count, items.layer + 1,
                                            items.start + slack))
        sequence += times
    return rows, sequence


def _single(items: Items, length: int) -> Iterator[tuple[Items, int]]:
    for k in range(items.count):
        yield Items(items.origin, items.first + k, 1, items.layer, items.start), length


def _tail(parts: list[tuple[Items, int]], fill: int, rows: list[tuple[int, ...]], sequence: int) -> int:
    """Cuts the last items into sequences of falling powers of two."""
    room, offset = 1 << fill.bit_length() - 1, 0
    for items, length in parts:
        layer, start = items.layer, items.start
        while length:
            got = min(length, room - offset)
            rows.append((items.origin, items.first, 1, layer, start, got, 0, sequence, 1, offset))
            length, start, layer, offset, fill = length - got, start + got, layer + 1, offset + got, fill - got
            if offset == room:
                sequence, offset = sequence + 1, 0
                room = 1 << max(fill.bit_length() - 1, 0)
    return sequence


class Places:
    """Where a plan puts the items of given lengths and ranks."""

    _SHIFT = 48

    def __init__(self, rows: list[tuple[int, ...]], sequences: int, capacity: int) -> None:
        table = np.array(rows, np.int64).reshape(len(rows), len(PLAN))
        self.sequences, self.capacity = sequences, capacity
        self.layers = []
        for layer in range(table[:, 3].max(initial=-1) + 1):
            part = table[table[:, 3] == layer]
            key = part[:, 0] << self._SHIFT | part[:, 1]
            order = np.argsort(key)
            self.layers.append((key[order], part[order]))

    def cuts(self, n: np.ndarray, rank: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
        """owner, start, length, sequence, offset of all pieces of documents with ``n`` ids, ``rank`` among
        those of equal rest, and ``windows`` whole windows before theirs; by owner and start."""
        full, rest = n // self.capacity, n % self.capacity
        owner = np.repeat(np.arange(len(n)), full)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        out = [np.array([owner, k * self.capacity, np.full(len(k), self.capacity),
                         self.sequences + windows[owner] + k, np.zeros(len(k), np.int64)])]
        key = rest << self._SHIFT | rank
        at = np.flatnonzero(rest)
        for keys, table in self.layers:
            place = np.searchsorted(keys, key[at], "right") - 1
            found = place >= 0
            row = table[place]
            found &= (row[:, 0] == rest[at]) & (rank[at] < row[:, 1] + row[:, 2])
            at, row = at[found], row[found]
            number = row[:, 6] + rank[at] - row[:, 1]
            out.append(np.array([at, full[at] * self.capacity + row[:, 4], row[:, 5],
                                 row[:, 7] + number // row[:, 8], row[:, 9] + number % row[:, 8] * row[:, 5]]))
        found = np.concatenate(out, axis=1)
        return list(found[:, np.lexsort((found[1], found[0]))])


# --- Spark -------------------------------------------------------------------------------------

def ranked(held: DataFrame, capacity: int) -> DataFrame:
    """row, n, rank among the rows of equal ``n % capacity``, and whole windows before the row's own.

    ``held`` is a written table of row, doc_id, n, tie.
    """
    salts = held.count() // ROWS_PER_SALT + 1
    rows = held.withColumn("rest", F.col("n") % capacity).withColumn("full", F.expr(f"n div {capacity}")).withColumn(
        "salt", F.expr(f"pmod(xxhash64(doc_id, tie, row), {salts}L)"))
    earlier = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # One row per length and salt, and one per salt.
    lengths = rows.groupBy("rest", "salt").agg(F.count("*").alias("held")).withColumn(
        "ahead", F.coalesce(F.sum("held").over(
            Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    windows = rows.where("full > 0").groupBy("salt").agg(F.sum("full").alias("held")).withColumn(
        "before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).select("salt", "before")
    inside = Window.partitionBy("rest", "salt").orderBy("doc_id", "tie", "row")
    of_salt = Window.partitionBy("salt").orderBy("doc_id", "tie", "row")
    placed = rows.withColumn("k", F.row_number().over(inside) - 1).join(
        lengths.select("rest", "salt", "ahead"), ["rest", "salt"])
    long = rows.where("full > 0").withColumn("f", F.sum("full").over(of_salt) - F.col("full")).join(
        windows, "salt").select("row", (F.col("before") + F.col("f")).alias("windows"))
    return placed.join(long, "row", "left").select(
        "row", "n", (F.col("ahead") + F.col("k")).alias("rank"), F.coalesce("windows", F.lit(0)).alias("windows"))


def pack(held: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece.

    ``held`` has doc_id and ids (little-endian unsigned 32-bit); rows without ids have no piece.
    """
    if capacity > 1 << 14:
        raise ValueError("a capacity of more than 16,384 ids is not supported")
    spark = held.sparkSession
    held = written(held.withColumn("row", F.monotonically_increasing_id()), "pack-ids", "zstd")
    rows = written(held.selectExpr("row", "doc_id", "CAST(octet_length(ids) div 4 AS bigint) AS n",
                                   "crc32(ids) AS tie").where("n > 0"), "pack-rows")
    counts = rows.groupBy(F.expr(f"CAST(n % {capacity} AS int)").alias("rest")).count().where("rest > 0")
    # One number per length below the capacity; the plan made of them is bounded alike.
    places = spark.sparkContext.broadcast(Places(*plan({r[0]: r[1] for r in counts.collect()}, capacity), capacity))
    kinds = pa.list_(pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank, windows = (batch.column(c).to_numpy() for c in ("n", "rank", "windows"))
            owner, *found = places.value.cuts(n, rank, windows)
            edges = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.ListArray.from_arrays(edges, pa.array(x), type=kinds) for x in found)],
                ["row", "start", "length", "sequence_id", "offset"])

    cuts = ranked(rows, capacity).mapInArrow(cut, "row bigint, start array<bigint>, length array<bigint>, "
                                                  "sequence_id array<bigint>, offset array<bigint>")
    pieces = held.join(cuts, "row").selectExpr(
        "doc_id", "ids", "CAST(octet_length(ids) div 4 AS bigint) AS doc_tokens",
        "explode(arrays_zip(start, length, sequence_id, offset)) AS p")
    return pieces.selectExpr("doc_id", "p.start", "p.length",
                             "substring(ids, CAST(4 * p.start + 1 AS int), CAST(4 * p.length AS int)) AS ids",
                             "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens, padding: the packed sequences themselves.

    A sequence shorter than the capacity is padded to it with ``pad``, unless its length is a power of two.
    """
    gathered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                                 F.sum("length").alias("n_tokens"))
    missing = F.expr(f"IF(bit_count(n_tokens) = 1, 0, {capacity} - n_tokens)").cast("int").alias("padding")
    padding = F.expr(f"unhex(repeat('{pad.to_bytes(4, 'little').hex()}', padding))")
    whole = F.expr("aggregate(p, CAST('' AS binary), (a, x) -> concat(a, x.ids))")
    return gathered.select("sequence_id", whole.alias("ids"), "n_tokens", missing).select(
        "sequence_id", F.concat("ids", padding).alias("ids"), "n_tokens", "padding")
