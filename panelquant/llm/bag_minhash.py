"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. For every shingle, Poisson processes run
over its discretised weight: one for each dyadic range (0,1], (1,2], (2,4], (4,8] ... of
multiplicities, all shared by every document. A point has a value, a signature component and a
place in the range; a document of multiplicity w sees the points whose place lies within w. The
least value of each component is the signature; two components agree with the probability of the
weighted Jaccard similarity. Points come in rising order, and a shingle's process is left as soon
as its value passes the largest component, so a weight costs its logarithm and few points.

Signatures are cut into bands. Documents that share a band are candidates; a link is a candidate
pair whose multisets of shingles overlap to SIMILARITY or more, computed from whole texts.
Groups are the connected components. Texts that are equal are collapsed first. Documents are then
compared with the candidate that shares most bands, so that the pairs of a large group need no
comparing; what still lies in different groups is compared to the last pair, in blocks.

Documents without a word are alone. Rows that share an id are one document, linked by any of its
texts; a null id is alone and has a null class. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import (mix64, over_batches, range_hashes, shingle_hashes, utf8, words,
                                   written)
from panelquant.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Shingles whose processes run side by side.
AT_ONCE = 1 << 16
#: Rounds that compare one pair for each document, before all that is left is compared.
STAR_ROUNDS = 2
assert ROWS == 4  # four components of 16 bits each are compared as one number
#: Documents of one band that a task compares with as many others.
BLOCK = 512


def least_agreement(similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> int:
    """Components in which a pair of this similarity agrees, but for a chance no greater than that of
    sharing no band at all."""
    m, count, tail = bands * rows, 0, 0.0
    missed = (1 - similarity ** rows) ** bands
    while True:
        tail += math.comb(m, count) * similarity ** count * (1 - similarity) ** (m - count)
        if tail > missed:
            return count
        count += 1


LEAST_AGREEMENT = least_agreement()

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and their multiplicities."""
    data = utf8(text)
    return np.unique(shingle_hashes(range_hashes(data, *words(data)), SHINGLE), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of lesser over sum of greater multiplicities; 0 where there are none."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """A row of m least values for each bag; infinity throughout for an empty bag."""
    out = np.full((len(bags), m), np.inf)
    if not bags:
        return out
    sizes = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    shingle = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.int64)
    # Level 0 is the range (0, 1]; level l the range (2^(l-1), 2^l]. A weight enters every level below it.
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    doc, weight, seed = (np.repeat(x, levels) for x in (doc, weight, shingle))
    level = np.arange(len(doc)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    state = mix64(seed + level.astype(np.uint64) * _LEVEL)
    value = np.zeros(len(doc))
    flat = out.reshape(-1)
    while len(doc):
        state = mix64(state + _STEP)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        value = value - np.log(uniform) / (m * width)
        other = mix64(state ^ _LEVEL)
        component = (other % np.uint64(m)).astype(np.int64)
        place = low + 1 + ((other >> np.uint64(20)) % width.astype(np.uint64)).astype(np.int64)
        seen = place <= weight
        np.minimum.at(flat, doc[seen] * m + component[seen], value[seen])
        on = value < out.max(1)[doc]
        if not on.all():
            doc, weight, low, width, state, value = (x[on] for x in (doc, weight, low, width, state, value))
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each row, different from band to band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.broadcast_to(mix64(np.arange(1, bands + 1).astype(np.uint64)), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix64(out + bits[:, :, k] * _STEP)
    return out


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    bands: list[list[int] | None] = []
    short: list[bytes] = []
    part: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        signed = signatures(part)
        hashes = band_hashes(signed).view(np.int64).tolist()
        short.extend(row.tobytes() for row in mix64(signed.view(np.uint64)).astype(np.uint16))
        bands.extend(h if len(b[0]) else None for h, b in zip(hashes, part, strict=True))
        part.clear()

    held = 0
    for text in batch.column("text").to_pylist():
        part.append(shingles(text))
        held += len(part[-1][0])
        if held >= AT_ONCE:
            flush()
            held = 0
    if part:
        flush()
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h1", "h2")),
                                       pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                                      ["id", "h1", "h2", "bands", "short"])


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep, last, bag = [], None, None
    for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
        if b is not last:
            last, bag = b, shingles(b)
        keep.append(weighted_jaccard(shingles(a), bag) >= SIMILARITY)
    keep = np.flatnonzero(keep)
    return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of which some texts are similar enough."""
    texts = texts.select("id", "text")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return over_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), _similar,
                        "a bigint, b bigint").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """id, component for every id that is linked to another."""
    frame = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.length("text"), "text").alias("h2")
    signed = written(over_batches(frame.select("id", *hashes, "text"), _sign,
                                  "id bigint, h1 bigint, h2 bigint, bands array<bigint>, short binary"), "minhash-bands")
    # Equal texts: one of them stands for all, and the others link to it.
    lead = signed.where("bands IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.count("*").alias("n"))
    copies = signed.join(lead.where("n > 1"), ["h1", "h2"]).where("id != lead").select(
        F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    bands = signed.join(lead.select("h1", "h2", F.col("lead").alias("id")), ["h1", "h2", "id"], "left_semi").select(
        "id", F.posexplode("bands").alias("k", "band")).distinct()
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    held = written(bands.join(shared, "band"), "minhash-buckets")
    texts = written(frame.select("id", *hashes, "text").join(held.select("id").distinct(), "id", "left_semi").join(
        signed.select("id", "h1", "h2", "short"), ["id", "h1", "h2"]).select("id", "text", "short").distinct(), "minhash-texts")

    group = None
    for rounds in range(STAR_ROUNDS):
        now = _grouped(held, group)
        # One of each band: an id of its least group, another one each round. Each id is compared
        # with the one of these that it shares most bands with.
        pick = now.groupBy("band").agg(F.min(F.struct("g", F.xxhash64(F.lit(rounds), "id").alias("h"), "id")).alias("p"))
        pairs = now.join(pick, "band").where("g != p.g").select(F.col("id").alias("a"), F.col("p.id").alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(
            F.max(F.struct("c", F.col("b"))).alias("m")).select("a", "m.b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = written(verified(pairs, texts), "minhash-links")
        group = components(found if group is None else _links(group).unionByName(found), "minhash-groups")
    links = _links(group).unionByName(_rest(_grouped(held, group), texts))
    return components(links.unionByName(copies), "minhash-classes")


def _links(group: DataFrame) -> DataFrame:
    """One link for each id of a group but its least, to that one; they stand for all links of the group."""
    return group.select(F.col("component").alias("a"), F.col("id").alias("b"))


def _grouped(held: DataFrame, group: DataFrame | None) -> DataFrame:
    """id, band and g, the group of each id so far."""
    if group is None:
        return held.select("id", "k", "band", F.col("id").alias("g"))
    return held.join(group, "id", "left").select("id", "k", "band", F.coalesce("component", "id").alias("g"))


def _rest(now: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between ids that share a band and lie in different groups; enough to connect the groups.

    In each band all ids outside its largest group are compared with all others, block by block,
    inside tasks: what leaves a task are links, not pairs.
    """
    sizes = now.groupBy("band", "g").agg(F.count("*").alias("c"))
    top = sizes.groupBy("band").agg(F.max(F.struct("c", "g")).alias("top"), F.sum("c").alias("n"),
                                    F.count("*").alias("k")).where("k > 1").select(
        "band", F.col("top.g").alias("top"), F.expr(f"CAST(ceil((n - top.c) / {BLOCK}) AS int)").alias("na"),
        F.expr(f"CAST(ceil(n / {BLOCK}) AS int)").alias("nb"))
    dealt = now.join(top, "band").selectExpr(
        "band", "k", "id", "g", "g != top AS rest", "na", "nb", "CAST(pmod(xxhash64(id, band), na) AS int) AS mine_a",
        "CAST(pmod(xxhash64(band, id), nb) AS int) AS mine_b")
    cells = dealt.withColumn("cell", F.explode(F.expr(
        "array_union(CASE WHEN rest THEN transform(sequence(0, nb - 1), j -> named_struct('i', mine_a, 'j', j)) "
        "ELSE array() END, transform(sequence(0, na - 1), i -> named_struct('i', i, 'j', mine_b)))"))).selectExpr(
        "band", "k", "id", "g", "rest", "cell.i", "cell.j", "rest AND cell.i = mine_a AS left", "cell.j = mine_b AS right")
    return written(cells.join(texts, "id").groupBy("band", "i", "j").applyInPandas(_compare, "a bigint, b bigint").distinct(),
                   "minhash-links")


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    signed = np.vstack([np.frombuffer(x, np.uint16) for x in frame["short"]])
    bands = signed.view(np.uint64)  # a band's four components are one number
    texts, bags = frame["text"].tolist(), {}
    ids, rest, k = frame["id"].to_numpy(), frame["rest"].to_numpy(), int(frame["k"].iloc[0])
    group = frame["g"].to_numpy()
    left, right = np.flatnonzero(frame["left"]), np.flatnonzero(frame["right"])
    pairs = []
    for a in left.tolist():
        b = right[(group[right] != group[a]) & (~rest[right] | (ids[right] > ids[a]))]
        # A pair of the least similarity agrees in fewer as rarely as it shares no band.
        agree = (signed[b] == signed[a]).sum(1)
        b, agree = b[agree >= LEAST_AGREEMENT], agree[agree >= LEAST_AGREEMENT]
        # Of the bands that two documents share, the first compares them.
        first = (bands[b] == bands[a]).argmax(1)
        own = first == k
        pairs += zip(agree[own].tolist(), [a] * int(own.sum()), b[own].tolist(), strict=True)
    parent: dict[int, int] = {}

    def find(g: int) -> int:
        while g in parent:
            g = parent[g]
        return g

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in bags:
            bags[i] = shingles(texts[i])
        return bags[i]

    found = []
    for _, a, b in sorted(pairs, reverse=True):
        x, y = find(group[a]), find(group[b])
        if x != y and weighted_jaccard(bag(a), bag(b)) >= SIMILARITY:
            parent[x] = y
            found.append((ids[a], ids[b]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the document's group, itself included), kept."""
    known = groups(docs).select(F.col("id").alias("doc_id"), "component")
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id", "left")
    class_id = F.coalesce("component", "doc_id")
    return frame.select("doc_id", class_id.alias("class_id"),
                        F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group, each text of an id once; null ids all stay."""
    gone = groups(docs).where("id != component").select(F.col("id").alias("doc_id"))
    known = docs.where("doc_id IS NOT NULL")
    return known.join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"]).unionByName(
        docs.where("doc_id IS NULL"))
