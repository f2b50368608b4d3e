"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are collapsed first, whatever their number. Cells come from spherical k-means on a
bounded sample; every vector is assigned to its nearest centre. Cells, large ones in pieces, are dealt
into parts, each packed into one row, and a cross join of these rows meets every two parts once. So what
is written and shuffled are the vectors themselves, a fixed number of times, however many parts there are.

Two linked vectors lie within a distance that the cosine gives, so those of two cells both lie near
the plane between the cells' centres: what one is away from it on its side and the other on its own
is no more than that distance together. A task orders both blocks by it and multiplies only what can
link; no link is lost however the cells fall. It returns, for each vector, how many vectors it links
to and one link for each group it joins, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelquant.llm.common import written
from panelquant.llm.components import components

COSINE = 0.95
CELLS = 64
#: Bound of the sample that the centres are fitted on; every vector is assigned to a cell.
SAMPLE = 20_000
ROUNDS = 8
#: Vectors that are multiplied with as many others at most.
BLOCK = 2048
#: Bytes of vectors of a packed part: LEAST_BYTES until there are MANY_PARTS, then up to PART_BYTES, and more
#: only beyond MOST_PARTS parts. A task holds two parts.
LEAST_BYTES, MANY_PARTS, PART_BYTES, MOST_PARTS = 1 << 19, 8, 1 << 22, 512
#: Rows of a block that are multiplied at once.
STRIP = 256
#: Slack for rounding in distances; pairs themselves are compared in double precision.
SLACK = 1e-6


def centres(sample: np.ndarray, k: int = CELLS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means; the start is spread by picking far vectors."""
    rng = np.random.default_rng(seed)
    first = [int(rng.integers(len(sample)))]
    near = sample @ sample[first[0]]
    while len(first) < min(k, len(sample)):
        weight = np.maximum(1 - near, 0) ** 2
        total = weight.sum()
        if total <= 0:
            break
        first.append(int(rng.choice(len(sample), p=weight / total)))
        near = np.maximum(near, sample @ sample[first[-1]])
    found = sample[first]
    for _ in range(rounds):
        cell = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), found)
    return found


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v of the rows that hold an id and a direction; their vectors keep their type."""
    x = "CAST(x AS double)"
    return embeddings.select("vec_id", F.col("embedding").alias("v")).where(
        f"v IS NOT NULL AND size(v) > 0 AND vec_id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan({x}) "
        f"AND abs({x}) < double('Infinity')) AND exists(v, x -> x != 0)")


def _mark() -> F.Column:
    """Tells vectors apart by 128 bits and their length, so that vectors need not be moved to be told equal."""
    return F.struct(F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


def leads(rows: DataFrame) -> DataFrame:
    """vec_id, lead, n: each id of usable() with the smallest id that holds its vector, and how many do."""
    ids = rows.groupBy("vec_id").agg(F.min(_mark()).alias("mark"))
    same = ids.groupBy("mark").agg(F.min("vec_id").alias("lead"), F.count("*").alias("n"))
    return ids.join(same, "mark").select("vec_id", "lead", "n")


def distinct_vectors(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each different vector once: v, vec_id (the lead), n (different ids that hold it). Vectors are shuffled once."""
    held = rows.groupBy("vec_id").agg(F.min_by("v", _mark()).alias("v"))
    return held.join(known.where("vec_id = lead").select("vec_id", "n"), "vec_id").select("v", "vec_id", "n")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class _Block:
    """Vectors of a cell: ids, how many rows each stands for, unit vectors and their products with the centres."""

    def __init__(self, cell: int, ids: np.ndarray, n: np.ndarray, x: np.ndarray, centre: np.ndarray) -> None:
        self.cell, self.ids, self.n, self.x = cell, ids, n, x
        self.cos, self.rough = x @ centre.T, x.astype("f4")

    def away(self, other: int) -> tuple[np.ndarray, np.ndarray]:
        """How far each vector is on its side of the plane between its cell and another (times the centres' distance),
        and the order by it."""
        far = self.cos[:, self.cell] - self.cos[:, other]
        order = np.argsort(far)
        return far[order], order


def _opened(row: dict, kind: np.dtype, centre: np.ndarray, block: int) -> list[_Block]:
    """The blocks of a packed part: its vectors by cell, ``block`` at most in each."""
    cell, ids, n = (np.frombuffer(row[name], "<i8") for name in ("cells", "ids", "n"))
    x = _unit(np.frombuffer(row["vectors"], kind).reshape(len(ids), row["d"]))
    edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    return [_Block(int(cell[low]), ids[low:high], n[low:high], x[low:high], centre)
            for start, end in zip(edges, edges[1:]) for low in range(start, end, block) for high in [min(low + block, end)]]


def _near(a: _Block, b: _Block, centre: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of ``a`` link to which of ``b``: rows of each that may, and whether they do."""
    if a.cell == b.cell:
        far_a, far_b, reach = np.zeros(len(a.ids)), np.zeros(len(b.ids)), 0.0
        at_a, at_b = np.arange(len(a.ids)), np.arange(len(b.ids))
    else:
        (far_a, at_a), (far_b, at_b) = a.away(b.cell), b.away(a.cell)
        reach = np.sqrt(max(2 - 2 * cosine, 0)) * np.linalg.norm(centre[a.cell] - centre[b.cell])
    wide = np.searchsorted(far_b, reach + SLACK - far_a, "right")
    at_a, at_b = at_a[:np.searchsorted(-wide, 0)], at_b[:wide[0]]
    # In single precision, with its rounding allowed for; what may link is then multiplied in double precision.
    x, y, least = a.rough[at_a], b.rough[at_b], np.float32(cosine - (a.x.shape[1] + 8) * 2.0 ** -23)
    rows, columns = np.zeros(len(at_a), bool), np.zeros(len(at_b), bool)
    for low in range(0, len(at_a), STRIP):
        some = x[low:low + STRIP] @ y[:wide[low]].T >= least
        if some.any():
            rows[low:low + STRIP] = some.any(1)
            columns[:wide[low]] |= some.any(0)
    at_a, at_b = at_a[rows], at_b[columns]
    return at_a, at_b, a.x[at_a] @ b.x[at_b].T >= cosine


def links(vectors: DataFrame, cosine: float = COSINE, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """a, b, weight: for each vector ``a`` its number of linked rows, and links that join its group.

    ``vectors`` is a written table of distinct_vectors(). Rows with null ``b`` carry numbers of linked rows in
    ``weight``; rows with ``b`` are links, enough of them to connect what is linked. Vectors of
    different length never link. ``block`` vectors are multiplied with as many at once.
    """
    spark = vectors.sparkSession
    size = F.size("v")
    kind = np.dtype("<f4" if vectors.schema["v"].dataType.elementType == T.FloatType() else "<f8")
    vectors = vectors.select("vec_id", "n", vectors.v.cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>").alias("v"))
    found = {}
    for row in vectors.groupBy(size.alias("d")).count().collect():
        picked = vectors.where(size == row["d"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
        found[row["d"]] = centres(_unit(np.array([r["v"] for r in picked.select("v").collect()])), cells)
    shared = spark.sparkContext.broadcast(found)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                same = batch.filter(pa.array(length == d))
                for low in range(0, same.num_rows, block):
                    part = same.slice(low, block)
                    cell = (_unit(_matrix(part.column("v"), d)) @ shared.value[d].T).argmax(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cell), d, "int32")), pa.array(cell.astype("int32")), *part.columns],
                        ["d", "cell", "vec_id", "n", "v"])

    assigned = vectors.mapInArrow(assign, f"d int, cell int, vec_id bigint, n bigint, v {vectors.schema['v'].dataType.simpleString()}")
    # One row per cell, at most ``cells`` for each length of vectors. Cells are dealt into parts in their order.
    counts = written(assigned.groupBy("d", "cell").agg(F.count("*").alias("m")), "embedding-cells")
    whole = counts.agg(F.sum(F.col("m") * F.col("d")).alias("values")).first()["values"] or 0
    held = whole * kind.itemsize
    parts = min(max(1, min(-(-held // LEAST_BYTES), MANY_PARTS), -(-held // PART_BYTES)), MOST_PARTS)
    most = F.ceil(F.lit(-(-whole // parts)) / F.col("d"))
    before = F.sum("m").over(Window.partitionBy("d").orderBy("cell")) - F.col("m")
    sized = counts.withColumn("pieces", F.ceil(F.col("m") / most)).select(
        "d", "cell", "pieces", F.when(F.col("pieces") > 1, F.lit(0)).otherwise(F.floor(before / most)).alias("place"))
    piece = F.when(F.col("pieces") > 1, F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("pieces")) + (1 << 20))
    dealt = assigned.join(F.broadcast(sized), ["d", "cell"]).withColumn(
        "part", F.coalesce(piece, F.col("place")).cast("long")).drop("pieces", "place")

    def pack(table: pa.Table) -> pa.Table:
        # In full order, so that a part that is made again is the same row.
        table = table.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        d = table.column("d")[0].as_py()
        held = {"cells": table.column("cell").to_numpy().astype("<i8"), "ids": table.column("vec_id").to_numpy().astype("<i8"),
                "n": table.column("n").to_numpy().astype("<i8"), "vectors": _matrix(table.column("v").combine_chunks(), d).astype(kind)}
        return pa.table({name: table.column(name).slice(0, 1) for name in ("d", "part")} |
                        {name: pa.array([x.tobytes()], pa.binary()) for name, x in held.items()})

    packed = dealt.groupBy("d", "part").applyInArrow(
        pack, "d int, part bigint, cells binary, ids binary, n binary, vectors binary")
    sides = [packed.repartition(parts).select(F.struct("*").alias(name)) for name in ("left", "right")]
    # Written without an equality to join by: lengths would send all to a few tasks.
    paired = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl")).where(
        "abs(left.d - right.d) < 1 AND left.part <= right.part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(name)[k] for name in ("left", "right"))
                d, part = left["d"].as_py(), left["part"].as_py()
                centre = shared.value[d]
                if key != (d, part):
                    key, first = (d, part), _opened(left.as_py(), kind, centre, block)
                own = part == right["part"].as_py()
                second = first if own else _opened(right.as_py(), kind, centre, block)
                for i, a in enumerate(first):
                    for b in second[i if own else 0:]:
                        at_a, at_b, near = _near(a, b, centre, cosine)
                        near &= a.ids[at_a][:, None] != b.ids[at_b][None, :]
                        if not near.any():
                            continue
                        for ids, total in [(a.ids[at_a], near @ b.n[at_b])] + ([] if a is b else [(b.ids[at_b], a.n[at_a] @ near)]):
                            yield _linked(ids, None, total)
                        yield _linked(*_spanning(near, a.ids[at_a], b.ids[at_b]), None)

    return paired.mapInArrow(compare, "a bigint, b bigint, weight bigint")


def _linked(a: np.ndarray, b: np.ndarray | None, weight: np.ndarray | None) -> pa.RecordBatch:
    held = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), held, pa.array(np.zeros(len(a), "int64") if weight is None else weight, pa.int64())],
        ["a", "b", "weight"])


def _spanning(near: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that ``near`` connects: at most a few for each row and column."""
    label = np.arange(len(ia))
    rows, columns = [], []
    while True:
        reach = np.where(near, label[:, None], len(ia))
        lead, column = reach.argmin(0), reach.min(0)
        around = np.where(near, column[None, :], len(ia))
        lowest, via = around.min(1), around.argmin(1)
        better = np.flatnonzero(lowest < label)
        if not len(better):
            break
        # Through column ``via`` the row joins the row that leads it.
        rows += [better, lead[via[better]]]
        columns += [via[better], via[better]]
        label[better] = lowest[better]
    held = np.flatnonzero(column < len(ia))
    rows, columns = np.concatenate([*rows, lead[held]]), np.concatenate([*columns, held])
    taken = np.unique(rows * len(ib) + columns)
    return ia[taken // len(ib)], ib[taken % len(ib)]


def deduplicate(embeddings: DataFrame, cosine: float = COSINE, cells: int = CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and
    are kept. Rows that repeat an id count as one vector (that of the least mark stands for it) and
    each gets its result; a null id links with nothing and has a null component. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = usable(embeddings)
    known = written(leads(rows), "embedding-ids")
    vectors = written(distinct_vectors(rows, known), "embedding-vectors")
    found = written(links(vectors, cosine, cells), "embedding-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("lead")).agg(F.sum("weight").alias("others"))
    edges = found.where("b IS NOT NULL").select("a", "b").distinct()
    group = components(edges)
    result = known.join(counts, "lead", "left").join(group.withColumnRenamed("id", "lead"), "lead", "left").select(
        "vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "lead").alias("component_id"))
    return embeddings.select("vec_id").join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
