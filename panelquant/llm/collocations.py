"""Phrase collocations from counting quotient filters.

Texts are taken apart in shards of about half a million words, each with a vocabulary of its own. Words
that occur often enough in their language get global numbers; a phrase with a rarer word cannot
be frequent, so nothing else needs one. An n-gram is the numbers of its words packed into 2w bits. A Feistel
network permutes them invertibly; the high half is the quotient, the low half the full remainder. A
filter holds the counters of a shard sorted by both, quotients as differences and everything in as few
bytes as the shard's largest value needs, so it is compact and nothing is lost: a counter's
key gives its phrase back.

Filters are merged by sorted runs in rounds. In each, 256 shards meet in one of 256 ranges of
the quotient, and what they make is a wider shard for the next round's finer ranges. As the permutation
spreads keys evenly and a shard has a key once, a task's load depends on neither the input's size nor on
how common a phrase is.

Counts, scores and ranks are exact integers. Null texts are empty, a null language is ``und``; repeated
rows count each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.llm.common import by_size, distinct_words, mix64, numbered, written

LEAST = 10
MOST_WORDS = 3
FIRST = 2000
#: A candidate goes if a longer one holds it in so many of a hundred of its occurrences.
HELD_PERCENT = 50
SHARD_WORDS = 1 << 19
WORDS_AT_ONCE = 1 << 17
#: Shards merged at a time, and ranges of the quotient, as bits.
FAN_BITS = 8
#: Groups that a language's candidates are ranked in first.
RANK_SALTS = 256

_BREAKS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[_BREAKS] = True
_MAPPED = np.arange(256, dtype=np.uint8)
_MAPPED[0x41:0x5B] += 0x20
_MAPPED[_BREAKS] = 0x20
_MAPPED[0x09] = 0x20


# --- shards ------------------------------------------------------------------------------------

class Shard:
    """Words of some texts by the numbers of a vocabulary of their own.

    A vocabulary's entries are language and word with a space between them; a word has none.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, pa.Array]] = []
        self.words = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        words = distinct_words(texts, _MAPPED)
        if not len(words.start):
            return
        langs = langs.cast(pa.large_binary()).dictionary_encode()
        text = np.repeat(np.arange(len(texts)), np.diff(words.edges))
        size = len(words.distinct)
        distinct, place = np.unique(langs.indices.to_numpy()[text].astype(np.int64) * size + words.number,
                                    return_inverse=True)
        entries = pc.binary_join_element_wise(langs.dictionary.take(pa.array(distinct // size)),
                                              words.distinct.take(pa.array(distinct % size)),
                                              pa.scalar(b" ", pa.large_binary()))
        piece = np.cumsum(_IS_BREAK[words.data], dtype=np.int32)[words.start]
        apart = np.flatnonzero((np.diff(piece) != 0) | (np.diff(text) != 0)) + 1
        self.parts.append((np.append(np.insert(place + 1, apart, 0), 0).astype("<u4"), entries))
        self.words += len(words.start)

    def row(self, shard: int) -> pa.RecordBatch:
        found = pa.concat_arrays([entries for _, entries in self.parts]).dictionary_encode()
        number, at, tokens = found.indices.to_numpy().astype("<u4") + np.uint32(1), 0, []
        for part, entries in self.parts:
            tokens.append(np.append(np.uint32(0), number[at:at + len(entries)])[part])
            at += len(entries)
        tokens = np.concatenate(tokens).astype("<u4")
        counts = np.bincount(tokens, minlength=len(found.dictionary) + 1)[1:]
        edges = pa.array([0, len(counts)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([tokens.tobytes()], pa.binary()),
             pa.ListArray.from_arrays(edges, found.dictionary.cast(pa.large_string()).cast(pa.string())),
             pa.ListArray.from_arrays(edges, pa.array(counts, pa.int64()))], ["shard", "tokens", "entry", "count"])


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, tokens (numbers from 1 on, 0 between pieces), and the vocabulary entry and count of every number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, shard = Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in by_size(batch, "text"):
                held.add(part.column("text"), part.column("lang"))
                if held.words >= shard_words:
                    yield held.row(shard)
                    held, shard = Shard(), shard + 1
        if held.words:
            yield held.row(shard)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "shard bigint, tokens binary, entry array<string>, count array<bigint>")


# --- filters -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Keys:
    """Packs n-grams of numbers below ``2 ** bits`` and permutes them within ``2 * half`` bits."""

    bits: int

    @property
    def half(self) -> int:
        return -(-MOST_WORDS * self.bits // 2)

    def _mixed(self, x: np.ndarray, turn: int) -> np.ndarray:
        return mix64(x + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64((1 << self.half) - 1)

    def permute(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Quotient and remainder of n-grams, given word by word; the first of a shorter one is 0."""
        shift, half = np.uint64(self.bits), np.uint64(self.half)
        x, y, z = words
        # The three numbers side by side, as a high and a low half: the low half holds z and a part of y.
        low_of_y = half - shift
        high = x << (np.uint64(2) * shift - half) | y >> low_of_y
        low = (y & np.uint64((1 << self.half - self.bits) - 1)) << shift | z
        for turn in range(1, 5):
            high, low = low, high ^ self._mixed(low, turn)
        return high, low

    def restore(self, quotient: np.ndarray, remainder: np.ndarray) -> list[np.ndarray]:
        shift, half = np.uint64(self.bits), np.uint64(self.half)
        high, low = quotient, remainder
        for turn in range(4, 0, -1):
            high, low = low ^ self._mixed(high, turn), high
        low_of_y = half - shift
        top = np.uint64(2) * shift - half
        return [high >> top, (high & np.uint64((1 << 2 * self.bits - self.half) - 1)) << low_of_y | low >> shift,
                low & np.uint64((1 << self.bits) - 1)]


@dataclass(frozen=True)
class Filter:
    """Counters sorted by quotient and remainder, each pair once."""

    quotient: np.ndarray
    remainder: np.ndarray
    count: np.ndarray

    @staticmethod
    def merged(quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray) -> Filter:
        """Sorted runs, one behind the other, as one filter."""
        order = np.lexsort((remainder, quotient))
        quotient, remainder, count = quotient[order], remainder[order], count[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])
        first = np.flatnonzero(fresh)
        return Filter(quotient[first], remainder[first], np.add.reduceat(count, first) if len(first) else count)

    @staticmethod
    def together(parts: list[Filter]) -> Filter:
        return Filter.merged(*(np.concatenate([np.zeros(0, np.uint64), *(getattr(f, c) for f in parts)])
                               for c in ("quotient", "remainder", "count")))

    def pack(self) -> bytes:
        parts = [_narrow(np.diff(self.quotient, prepend=np.uint64(0))), _narrow(self.remainder), _narrow(self.count)]
        return len(self.quotient).to_bytes(8, "little") + b"".join(parts)

    @staticmethod
    def unpack(data: bytes) -> Filter:
        n, at, out = int.from_bytes(data[:8], "little"), 8, []
        for _ in range(3):
            column, at = _widen(data, at, n)
            out.append(column)
        return Filter(np.cumsum(out[0], dtype=np.uint64), out[1], out[2])

    def ranges(self, above: int) -> Iterator[tuple[int, Filter]]:
        """Non-empty parts by the quotient without its lowest ``above`` bits."""
        part = self.quotient >> np.uint64(above)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for low, high in zip(edges, edges[1:]):
            if low < high:
                yield int(part[low]), Filter(self.quotient[low:high], self.remainder[low:high], self.count[low:high])


def _narrow(values: np.ndarray) -> bytes:
    """As few bytes a value as nearly all need; the wider ones follow with their places."""
    width = 1
    while width < 8 and np.count_nonzero(values >> np.uint64(8 * width)) * 16 > len(values):
        width += 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    wide = np.flatnonzero(values >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    return b"".join([bytes([width]), len(wide).to_bytes(8, "little"), wide.astype("<u4").tobytes(),
                     values[wide].astype("<u8").tobytes(), np.ascontiguousarray(raw[:, :width]).tobytes()])


def _widen(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width, many = data[at], int.from_bytes(data[at + 1:at + 9], "little")
    at += 9
    places = np.frombuffer(data, "<u4", many, at)
    values = np.frombuffer(data, "<u8", many, at + 4 * many)
    at += 12 * many
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    out = raw.reshape(-1).view("<u8").astype(np.uint64)
    out[places] = values
    return out, at + n * width


def counted(numbers: np.ndarray, keys: Keys) -> Filter:
    """All n-grams of two to MOST_WORDS words; 0 separates. A part of the words is permuted at a time."""
    parts = []
    for low in range(0, len(numbers), WORDS_AT_ONCE):
        part = numbers[low:low + WORDS_AT_ONCE + MOST_WORDS - 1].astype(np.uint64)
        first = np.arange(len(part)) < WORDS_AT_ONCE
        x, y, z = part[:-2], part[1:-1], part[2:]
        two = np.flatnonzero((part[:-1] > 0) & (part[1:] > 0) & first[:-1])
        three = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & first[:-2])
        quotient, remainder = keys.permute([np.concatenate([np.zeros(len(two), np.uint64), x[three]]),
                                            np.concatenate([part[:-1][two], y[three]]),
                                            np.concatenate([part[1:][two], z[three]])])
        parts.append(Filter.merged(quotient, remainder, np.ones(len(quotient), np.uint64)))
    return Filter.together(parts)


# --- Spark -------------------------------------------------------------------------------------

def frequent_words(held: DataFrame, least: int) -> DataFrame:
    """id from 1 on, entry, lang, word, f of the words with ``least`` occurrences; written."""
    words = held.selectExpr("explode(arrays_zip(entry, count)) AS e").groupBy("e.entry").agg(
        F.sum("e.count").alias("f")).where(F.col("f") >= least)
    word = F.substring_index("entry", " ", -1)
    return written(numbered(words, "phrase-counts", "id").withColumn("word", word).withColumn(
        "lang", F.expr("left(entry, length(entry) - length(word) - 1)")), "phrase-words")


def known_words(held: DataFrame, words: DataFrame) -> DataFrame:
    """shard, tokens, and the places (at) and numbers (id) of its vocabulary's frequent words."""
    entries = held.selectExpr("shard", "posexplode(entry) AS (at, entry)")
    # A shard's own vocabulary bounds its list.
    lists = entries.join(words.select("entry", "id"), "entry").groupBy("shard").agg(
        F.collect_list(F.struct("at", "id")).alias("known")).select("shard", "known.at", "known.id")
    return held.select("shard", "tokens").join(lists, "shard")


def translated(tokens: bytes, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Tokens by the numbers of frequent words; a 0 for runs of others and between pieces."""
    tokens = np.frombuffer(tokens, "<u4")
    numbers = np.zeros(max(int(tokens.max(initial=0)), int(at.max(initial=0)) + 1) + 1, np.int64)
    numbers[at + 1] = ids
    found = numbers[tokens]
    keep = found > 0
    keep[1:] |= found[:-1] > 0
    return found[keep]


def phrase_counts(known: DataFrame, n_shards: int, bits: int, least: int) -> DataFrame:
    """x, y, z, a of the n-grams with ``least`` occurrences; x is 0 where there are two words."""
    keys = Keys(bits)
    rounds = 1
    while n_shards > 1 << FAN_BITS * rounds:
        rounds += 1
    above = [max(0, keys.half - FAN_BITS * (k + 1)) for k in range(rounds)]
    groups = -(-n_shards // (1 << FAN_BITS)) or 1
    schema = "shard bigint, part bigint, filter binary"

    def blobs(parts: Iterator[tuple[int, int, Filter]]) -> pa.RecordBatch:
        shard, part, packed = [], [], []
        for s, p, f in parts:
            shard.append(s)
            part.append(p)
            packed.append(f.pack())
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(part, pa.int64()),
                                           pa.array(packed, pa.binary())], ["shard", "part", "filter"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, tokens, at, ids = (batch.column(c)[k] for c in ("shard", "tokens", "at", "id"))
                group = int(mix64(np.array([shard.as_py()], np.uint64))[0] % np.uint64(groups))
                numbers = translated(tokens.as_buffer(), at.values.to_numpy(), ids.values.to_numpy())
                yield blobs((group, p, f) for p, f in counted(numbers, keys).ranges(above[0]))

    def together(table: pa.Table) -> Filter:
        return Filter.together([Filter.unpack(x.as_py()) for x in table.column("filter")])

    def wider(bits_left: int):
        def widen(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py() >> FAN_BITS
            return pa.Table.from_batches([blobs((shard, p, f) for p, f in together(table).ranges(bits_left))])

        return widen

    filters = known.mapInArrow(count, schema)
    for bits_left in above[1:]:
        filters = filters.groupBy("shard", "part").applyInArrow(wider(bits_left), schema)

    def last(table: pa.Table) -> pa.Table:
        found = together(table)
        often = found.count >= least
        columns = keys.restore(found.quotient[often], found.remainder[often])
        return pa.table([c.astype(np.int64) for c in (*columns, found.count[often])], names=["x", "y", "z", "a"])

    return filters.groupBy("part").applyInArrow(last, "x bigint, y bigint, z bigint, a bigint")


def _score(a: str, left: str, right: str) -> str:
    wide = "CAST({} AS decimal(19, 0))"
    a, left, right = wide.format(a), wide.format(left), wide.format(right)
    return f"CAST((CAST({a} * {a} AS decimal(38, 0)) * 1000000) div ({left} * {right}) AS bigint)"


def candidates(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one holds, however many."""
    held = written(shards(docs, shard_words), "phrase-shards")
    words = frequent_words(held, least)
    entry = F.col("e.entry")
    totals = held.selectExpr("explode(arrays_zip(entry, count)) AS e").groupBy(
        F.left(entry, F.length(entry) - F.length(F.substring_index(entry, " ", -1)) - 1).alias("lang")).agg(
        F.sum("e.count").alias("n"))
    most = words.agg(F.max("id")).first()[0] or 1
    bits = int(most).bit_length()
    if bits > 42:
        raise ValueError("more frequent words than fit the packed keys")
    found = written(phrase_counts(known_words(held, words), held.count(), bits, least), "phrases")
    two = found.where("x = 0").selectExpr("y AS x", "z AS y", "a")
    three = found.where("x > 0")
    longer = three.selectExpr("x", "y", "a").unionAll(three.selectExpr("y AS x", "z AS y", "a")).groupBy(
        "x", "y").agg(F.max("a").alias("held"))
    kept = two.join(longer, ["x", "y"], "left").where(
        f"held IS NULL OR 100 * held < {HELD_PERCENT} * a").selectExpr("x", "y", "0L AS z", "a")
    inner = three.join(two.selectExpr("x", "y", "a AS xy"), ["x", "y"]).join(
        two.selectExpr("x AS y", "y AS z", "a AS yz"), ["y", "z"])
    both = inner.select("x", "y", "z", "a", "xy", "yz").unionByName(
        kept.selectExpr("x", "y", "z", "a", "CAST(NULL AS bigint) AS xy", "CAST(NULL AS bigint) AS yz"))
    first, second = (words.selectExpr(f"id AS {c}", f"word AS word_{c}", f"f AS f_{c}") for c in ("x", "y"))
    third = words.selectExpr("id AS z", "word AS word_z", "f AS f_z")
    named = both.join(first, "x").join(second, "y").join(third, "z", "left").join(
        words.selectExpr("id AS x", "lang"), "x")
    cut1, cut2 = _score("a", "f_x", "coalesce(yz, f_y)"), _score("a", "xy", "f_z")
    scored = named.withColumn("cut1", F.expr(cut1)).withColumn("cut2", F.expr(f"IF(z = 0, NULL, {cut2})"))
    early = "cut2 IS NULL OR cut1 <= cut2"
    return scored.selectExpr(
        "lang", "concat_ws(' ', word_x, word_y, word_z) AS phrase", "a", f"IF({early}, f_x, xy) AS l",
        f"IF({early}, coalesce(yz, f_y), f_z) AS r", f"IF({early}, cut1, cut2) AS score").join(totals, "lang")


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` candidates."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates(docs, least, shard_words).withColumn(
        "salt", F.expr(f"pmod(xxhash64(phrase), {RANK_SALTS})"))
    # Ranked in parts first, so that a language's candidates do not all meet in one task.
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(
        F.col("rank") <= first)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
