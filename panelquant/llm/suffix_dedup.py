"""Removal of long repeated byte strings by column-wise construction of ordered suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller document id, or
same document and earlier start) is removed; strings are judged on the input.

* Each string picks one anchor: the least hash of a GRAM-byte piece inside it, leftmost of
  equals. Equal strings pick the same anchor at the same place, so strings need comparing only
  where they share an anchor, and anchors that occur once are done with.
* The starts that pick one occurrence of an anchor are neighbours. Together they see a segment
  of less than 2 * LENGTH bytes. Equal segments are collapsed to the first of them.
* Different segments of one anchor are aligned at it and built up column by column, from the
  right: each round inserts one symbol of every segment, read from a sequential temporary file of
  columns, re-sorts the collection by that symbol (which keeps the order of the suffixes behind
  it, as in the construction of a collection's Burrows-Wheeler transform), and brings the common
  prefixes of neighbours up to date. Where neighbours share LENGTH symbols, all but the first
  occurrence are repeats.

The transform of whole documents would take as many rounds over all data as the longest document
has bytes; aligned segments take 180 rounds over what is repeated. An anchor that occurs more than
MAX_STRINGS times is left to a grouping of its strings' 128-bit hashes, with the
same result, so that no anchor is one task's load.

Null texts count as empty; rows that repeat id and text are one document; equal ids with
different texts are different documents, ordered by a hash of the text; null ids come last. Other
columns are ignored and empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import POWERS, mix64, over_batches, range_hashes, utf8

LENGTH = 100
GRAM = 20
#: Starts that may pick one anchor; columns of the aligned segments.
STARTS = LENGTH - GRAM + 1
COLUMNS = STARTS + LENGTH - 1
#: Places whose order keys fit beside their hashes.
PLACES = 1 << 20
#: Occurrences of an anchor whose segments one task takes, and segments it takes at once.
MAX_STRINGS = 50_000
AT_ONCE = 100_000
LAST_ID = (1 << 63) - 1
#: Marks an occurrence of an anchor that occurs more often than MAX_STRINGS.
HOT = 1 << 62


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, the first start that picks it, the number of such starts, and
    its distance from the first start."""
    n = len(data) - LENGTH + 1
    found = []
    up, down = POWERS.get(PLACES + LENGTH)
    for low in range(0, n, PLACES - LENGTH):
        m = min(n - low, PLACES - LENGTH)
        part = data[low:low + m + LENGTH - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        h = mix64((total[GRAM:] - total[:-GRAM]) * down[:len(part) - GRAM + 1])
        key = (h & ~np.uint64(PLACES - 1)) | np.arange(len(h), dtype=np.uint64)
        # Least key of each window of STARTS places: of the rest of its block and the next one's start.
        tiles = np.concatenate([key, np.full(-len(key) % STARTS, ~np.uint64(0))]).reshape(-1, STARTS)
        ahead = np.minimum.accumulate(tiles, 1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:m], ahead[STARTS - 1:STARTS - 1 + m]) & np.uint64(PLACES - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[start]], start + low, np.diff(np.append(start, m)), place[start] - start))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pack(version: int, start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Version of the id's text (17 bits), start (31), starts (7), anchor's distance (7) as one long."""
    return version << 45 | start << 14 | count << 7 | offset


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 14 & 0x7FFFFFFF, packed >> 7 & 0x7F, packed & 0x7F


def kept_starts(groups: np.ndarray, segments: list[bytes], counts: np.ndarray, offsets: np.ndarray,
                ranks: np.ndarray) -> np.ndarray:
    """For each segment and start: whether no segment of lower rank in its group has that string.

    ``groups`` is sorted; ``ranks`` orders the segments' first occurrences.
    """
    m = len(segments)
    low = STARTS - 1 - offsets
    lengths = np.fromiter(map(len, segments), np.int64, m)
    high = low + lengths
    kept = np.zeros((m, STARTS), bool)
    with tempfile.TemporaryFile() as columns:
        flat = np.frombuffer(b"".join(segments), np.uint8)
        row = np.repeat(np.arange(m), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(low, lengths)
        table = np.zeros((COLUMNS, m), np.uint8)
        table[COLUMNS - 1 - column, row] = flat
        columns.write(table.tobytes())
        del table, row, column, flat
        columns.seek(0)
        order = np.arange(m)
        # Columns up to which a segment in order agrees with the one before it.
        agree = np.zeros(m + 1, np.int64)
        for c in range(COLUMNS - 1, -1, -1):
            symbol = np.frombuffer(columns.read(m), np.uint8).astype(np.int64)
            there = (low <= c) & (c < high)
            symbol[~there] = 256
            key = groups[order] * 512 + symbol[order]
            move = np.argsort(key, kind="stable")
            key = key[move]
            same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 512 != 256)) + 1
            fresh = np.full(m + 1, c, np.int64)
            if len(same):
                ends = np.empty(2 * len(same), np.int64)
                ends[0::2], ends[1::2] = move[same - 1] + 1, move[same] + 1
                fresh[same] = np.maximum(np.minimum.reduceat(agree, ends)[0::2], c + 1)
            order, agree = order[move], fresh
            if c < STARTS:
                run = np.flatnonzero(agree[:m] < c + LENGTH)
                if not len(run) or run[0] != 0:
                    run = np.concatenate([[0], run])
                placed = ranks[order]
                least = np.repeat(np.minimum.reduceat(placed, run), np.diff(np.append(run, m)))
                kept[order, c] = placed == least
    start = np.arange(STARTS)
    return kept & (start >= low[:, None]) & (start < (low + counts)[:, None])


def _batch(names: list[str], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [anchors(utf8(t))[0] for t in batch.column("text").to_pylist()]
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return _batch(["anchor", "c"], keys.view(np.int64), n)


def _occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, docs, packed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text")), strict=True):
        key, start, count, offset = anchors(utf8(text))
        keys.append(key)
        docs.append(np.full(len(key), doc))
        packed.append(pack(version, start, count, offset))
    return _batch(["anchor", "doc", "pack"], np.concatenate(keys).view(np.int64), np.concatenate(docs),
                  np.concatenate(packed))


def _segments(with_bytes: bool):
    """Rows of the segments at ``packs``: their anchors' and their own hashes, or their bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut, anchor, own, docs, packs = [], [], [], [], []
        for doc, text, packed in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "packs")), strict=True):
            data = utf8(text)
            packed = np.array(packed, np.int64)
            start, count, offset = unpack(packed)
            stop = start + count + LENGTH - 1
            anchor.append(range_hashes(data, start + offset, start + offset + GRAM))
            if with_bytes:
                raw = data.tobytes()
                cut += [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            else:
                own.append(mix64(range_hashes(data, start, stop) ^ offset.astype(np.uint64)))
            docs.append(np.full(len(packed), doc))
            packs.append(packed)
        own = pa.array(cut, pa.binary()) if with_bytes else np.concatenate(own).view(np.int64)
        return _batch(["anchor", "own", "doc", "pack"], np.concatenate(anchor).view(np.int64), own,
                      np.concatenate(docs), np.concatenate(packs))

    return run


def _bits(batch: pa.Table, kept: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(kept.any(1))
    bits = [row.tobytes() for row in np.packbits(kept[some], axis=1)]
    return _batch(["doc", "pack", "kept"], batch.column("doc").to_numpy()[some],
                  batch.column("pack").to_numpy()[some], pa.array(bits, pa.binary()))


def _construct(table: pa.Table) -> pa.RecordBatch:
    groups = table.column("anchor").to_numpy()
    groups = np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])])
    doc, packed = table.column("doc").to_numpy(), table.column("pack").to_numpy()
    _, count, offset = unpack(packed)
    order = np.lexsort((packed, doc))
    ranks = np.empty(len(doc), np.int64)
    # A row that stands twice in the input has one rank.
    ranks[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(packed[order]) != 0)]))
    return _bits(table, kept_starts(groups, table.column("own").to_pylist(), count, offset, ranks))


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor, taken up to AT_ONCE segments and only in whole anchors."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= AT_ONCE:
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if whole:
                yield _construct(table.slice(0, whole))
                table = table.slice(whole)
            held, size = table.to_batches(), table.num_rows
    if size:
        yield _construct(pa.Table.from_batches(held))


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The 128-bit hash of each string of each segment."""
    high, low, docs, packs, at = [], [], [], [], []
    for own, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("own", "doc", "pack")), strict=True):
        _, count, offset = unpack(np.int64(packed))
        for i in range(int(count)):
            digest = hashlib.blake2b(own[i:i + LENGTH], digest_size=16).digest()
            high.append(int.from_bytes(digest[:8], "little", signed=True))
            low.append(int.from_bytes(digest[8:], "little", signed=True))
            docs.append(doc)
            packs.append(packed)
            at.append(STARTS - 1 - int(offset) + i)
    return _batch(["high", "low", "doc", "pack", "at"], pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                  pa.array(docs, pa.int64()), pa.array(packs, pa.int64()), pa.array(at, pa.int32()))


def _collect_bits(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept = np.zeros((batch.num_rows, STARTS), bool)
    for i, places in enumerate(batch.column("places").to_pylist()):
        kept[i, places] = True
    return _bits(pa.Table.from_batches([batch]), kept)


def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, packs, firsts in zip(*(batch.column(c).to_pylist() for c in ("text", "packs", "firsts")), strict=True):
        data = utf8(text)
        edge = np.zeros(len(data) + 1, np.int64)
        if packs:
            packed = np.array(packs, np.int64)
            own = {f["pack"]: f["kept"] for f in firsts or ()}
            whole = np.array([p not in own for p in packs])
            start, count, _ = unpack(packed[whole])
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + LENGTH - 1, -1)
            for p, bits in own.items():
                start, count, offset = unpack(np.int64(p))
                flags = np.unpackbits(np.frombuffer(bits, np.uint8))[STARTS - 1 - offset:][:count]
                gone = start + np.flatnonzero(flags == 0)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        rest = data[~gone].tobytes()
        out.append((len(data), int(gone.sum()), runs, rest))
    sizes, removed, runs, rest = zip(*out, strict=True)
    return _batch(["doc_id", "n_bytes", "n_removed", "n_spans", "rest"], batch.column("doc_id"),
                  pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                  pa.array(rest, pa.binary()))


def remove_repeats(docs: DataFrame, max_strings: int = MAX_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and rest (the bytes left)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        F.coalesce(F.pmod(F.xxhash64("text"), F.lit(1 << 17)), F.lit(0)).alias("version"), "text")
    repeated = over_batches(frame.select("text"), _count, "anchor bigint, c bigint").groupBy("anchor").agg(
        F.sum("c").alias("c")).where("c > 1")
    found = over_batches(frame.select("doc", "version", "text"), _occurrences,
                         "anchor bigint, doc bigint, pack bigint").join(repeated, "anchor").select(
        "doc", F.when(F.col("c") > max_strings, F.col("pack").bitwiseOR(F.lit(HOT))).otherwise(F.col("pack")).alias("pack"))
    key = ["doc", "version"]
    version = F.expr(f"CAST(shiftright(pack & {HOT - 1}, 45) AS bigint)").alias("version")
    places = found.groupBy("doc", version).agg(F.collect_set("pack").alias("packs"))
    # The three joins below take the same columns of the texts, and their keys are never null, so
    # that no join filters its side differently: they share one exchange.
    texts = frame.repartition(n, *key)
    own = ["doc_id", *key, "text"]
    marked = texts.join(places, key).select(*own, "packs")
    firsts = over_batches(marked, _segments(False), "anchor bigint, own bigint, doc bigint, pack bigint").groupBy(
        "anchor", "own").agg(F.min(F.struct("doc", "pack")).alias("first")).select("first.doc", "first.pack")
    wanted = firsts.groupBy("doc", version).agg(F.collect_set("pack").alias("packs"))
    strings = over_batches(texts.join(wanted, key).select(*own, "packs"), _segments(True),
                           "anchor bigint, own binary, doc bigint, pack bigint")
    ordered = strings.where(F.col("pack") < HOT).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(
        _rounds, "doc bigint, pack bigint, kept binary")
    hashed = over_batches(strings.where(F.col("pack") >= HOT), _hashed,
                          "high bigint, low bigint, doc bigint, pack bigint, at int").groupBy("high", "low", "at").agg(
        F.min(F.struct("doc", "pack")).alias("first")).groupBy("first").agg(F.collect_set("at").alias("places")).select(
        "first.doc", "first.pack", "places")
    hashed = over_batches(hashed, _collect_bits, "doc bigint, pack bigint, kept binary")
    kept = ordered.unionByName(hashed).groupBy("doc", version).agg(
        F.collect_list(F.struct("pack", "kept")).alias("firsts"))
    whole = texts.join(places, key, "left").join(kept, key, "left")
    return over_batches(whole.select(*own, "packs", "firsts"), _remove,
                        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, rest binary")
