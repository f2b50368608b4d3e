"""Cheapest repair of conversations by weighted CYK interval parsing.

A repaired conversation's role initials match ``(s?(ua)+)?``. The grammar is in Chomsky normal form:
nonterminal [p, q] derives what leads the automaton of that pattern from state p to q, its only binary
rule is [p, r] -> [p, q] [q, r], and its terminals are the edits of one row: keep, give another role,
delete. Inserted rows stand for no row of the input; their closure (the cheapest insertions that lead from
state to state) is taken into every terminal from both sides. A span's cell holds the least
(cost, audit) of every [p, q], the audit being the initials of the edits. As concatenation is
associative, every split of a span gives the same cell, so the chart is filled bottom-up by span
length with neighbouring spans of equal length. Of two audits of equal cost over the same rows neither
begins with the other (the longer one would have more insertions, which cost), so the smaller one stays smaller
whatever follows and cells may be joined in any order.

Rows are numbered by one range partitioning in conversation and turn order and dealt in blocks of
BLOCK rows; a conversation's cells of different blocks are joined in rounds, FAN at a time. So a
conversation that holds a third of all rows is many tasks' work. Only its repaired rows come out in
order in one task, row by row and without being held.

Null turns come first; rows of equal turn are ordered by role, text (its first characters, then a hash),
so that equal rows alone are interchangeable. Empty tables give empty results. Columns other than those
named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelquant.llm.common import ROWS_AT_ONCE, written

BLOCK_BITS = 9
FAN = 64
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The automaton: state after an initial. 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: (state, state): (cost, audit).
Cell = dict[tuple[int, int], tuple[int, str]]


# --- the chart ---------------------------------------------------------------------------------

def joined(left: Cell, right: Cell) -> Cell:
    """[p, r] -> [p, q] [q, r]."""
    out: Cell = {}
    for p in STATES:
        for r in STATES:
            ways = [(left[p, q][0] + right[q, r][0], q) for q in STATES if (p, q) in left and (q, r) in right]
            if ways:
                least = min(ways)[0]
                # Audits are put together only where costs tie for the least.
                out[p, r] = least, min(left[p, q][1] + right[q, r][1] for cost, q in ways if cost == least)
    return out


def _insertions() -> Cell:
    """Closure of inserting rows: no insertion, or the cheapest that lead from state to state."""
    closure: Cell = {(p, p): (0, "") for p in STATES}
    step = closure | {(p, q): (INSERT, "I") for (p, x), q in NEXT.items() if x in ROLES}
    for _ in STATES:
        closure = joined(closure, step)
    return closure


INSERTIONS = _insertions()


@lru_cache(maxsize=None)
def terminal(symbol: str) -> Cell:
    """The cell of one row: ``d`` has to go; else its role's initial (x: another), in capitals if truncated."""
    edits: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        for (p, x), q in NEXT.items():
            ways = [(more, "K")] if x == symbol.lower() else []
            ways += [(RELABEL + more, "R")] if x in ROLES else []
            if ways:
                edits[p, q] = min([*ways, edits[p, q]] if (p, q) in edits else ways)
    return joined(joined(INSERTIONS, edits), INSERTIONS)


@lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> Cell:
    return _chart(symbols)


def _chart(symbols: str) -> Cell:
    spans = [terminal(x) for x in symbols]
    while len(spans) > 1:
        spans = [joined(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def cell(symbols: str) -> Cell:
    """The cell of a span of rows; those of short spans, which recur, are remembered."""
    if len(symbols) <= 16:
        return _short(symbols)
    spans = [_short(symbols[i:i + 16]) for i in range(0, len(symbols), 16)]
    while len(spans) > 1:
        spans = [joined(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def cheapest(whole: Cell) -> tuple[int, str]:
    return min(whole[0, q] for q in ACCEPTED if (0, q) in whole)


# --- rows --------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault in a fixed share of the rows, by a checksum of conversation and turn.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats
    it, 4 makes its role ``user``. Nulls count as one space.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                                kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("time", F.explode(F.expr("IF(kind = 3, array(1, 2), array(1))"))).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"))


def _mark() -> Column:
    """Tells rows of different role or text apart."""
    return F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("mark")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("mark")]


def faults(rows: DataFrame) -> DataFrame:
    """row (rises in the order of conversation and turn), conv_id, turn, initial, blank, duplicate, truncated.

    ``rows`` has conv_id, turn, role, text, none of the last two null. A row's first fault counts.
    """
    keyed = rows.select(
        "conv_id", "turn", "role", F.left("text", F.lit(64)).alias("head"), _mark(),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
        # Equal rows may be dealt to different tasks.
        F.monotonically_increasing_id().alias("salt"))
    order = [*_order(), F.asc("salt")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(dealt.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn",
                                F.left("role", F.lit(1)).alias("initial"), "mark", "blank", "open"), "repair-rows")
    firsts = held.groupBy("conv_id", "mark").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return held.join(firsts, "row", "left").select(
        "row", "conv_id", "turn", "initial", "blank", (~F.col("blank") & F.isnull("first")).alias("duplicate"),
        (~F.col("blank") & F.col("first").isNotNull() & F.col("open")).alias("truncated"))


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def _cells_schema(conv_id: T.DataType, turn: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("conv_id", conv_id), T.StructField("block", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
        T.StructField("low", turn), T.StructField("high", turn),
        T.StructField("states", T.ArrayType(T.IntegerType())), T.StructField("costs", T.ArrayType(T.LongType())),
        T.StructField("audits", T.ArrayType(T.StringType()))])


def _packed(found: Cell) -> dict:
    return {"states": [4 * p + q for p, q in found], "costs": [c for c, _ in found.values()],
            "audits": [a for _, a in found.values()]}


def _unpacked(part: dict) -> Cell:
    return {divmod(s, 4): (c, a) for s, c, a in zip(part["states"], part["costs"], part["audits"], strict=True)}


def _illegal(pairs: Iterator[tuple[str, str]]) -> int:
    return sum(a + b not in LEGAL for a, b in pairs)


def _block(rows: list[dict]) -> Iterator[dict]:
    """One record per conversation of a block's rows, which are in order."""
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end]["conv_id"] == rows[at]["conv_id"]:
            end += 1
        part, at = rows[at:end], end
        initials = [r["initial"] for r in part]
        symbols = "".join("d" if r["blank"] or r["duplicate"] else
                          (x if x in ("s", "u", "a") else "x").upper() if r["truncated"] else
                          x if x in ("s", "u", "a") else "x" for r, x in zip(part, initials, strict=True))
        turns = [r["turn"] for r in part if r["turn"] is not None]
        yield {"conv_id": part[0]["conv_id"], "block": part[0]["row"] >> BLOCK_BITS, "rows": len(part),
               "blank": sum(r["blank"] for r in part), "duplicate": sum(r["duplicate"] for r in part),
               "truncated": sum(r["truncated"] for r in part), "illegal": _illegal(zip(initials, initials[1:])),
               "turns": len(set(turns)), "first": initials[0], "last": initials[-1],
               "low": min(turns, default=None), "high": max(turns, default=None), **_packed(cell(symbols))}


def _together(parts: list[dict]) -> dict:
    """The record of neighbouring spans, in order."""
    out = dict(parts[0])
    for c in _COUNTS:
        out[c] = sum(p[c] for p in parts)
    out["illegal"] += _illegal((a["last"], b["first"]) for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["low"] is not None]
    # Rows are in the order of turns, so only neighbours can share one.
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    out["low"] = known[0]["low"] if known else None
    out["high"] = known[-1]["high"] if known else None
    out["last"] = parts[-1]["last"]
    spans = [_unpacked(p) for p in parts]
    while len(spans) > 1:
        spans = [joined(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return out | _packed(spans[0])


def audits(faulty: DataFrame) -> DataFrame:
    """conv_id, rows, blank, duplicate, truncated, illegal, gaps, cost, audit of every conversation with rows."""
    schema = _cells_schema(faulty.schema["conv_id"].dataType, faulty.schema["turn"].dataType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def blocks(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_block(table.sort_by("row").to_pylist())), schema=arrow)

    found = written(faulty.withColumn("place", F.shiftright("row", BLOCK_BITS)).groupBy("place").applyInArrow(
        lambda table: blocks(table.drop_columns("place")), schema), "repair-cells")
    placed = found.withColumn("block", (F.row_number().over(
        Window.partitionBy("conv_id").orderBy("block")) - 1).cast("long"))
    most = placed.agg(F.max("block")).first()[0] or 0

    def together(table: pa.Table) -> pa.Table:
        out = _together(table.sort_by("block").to_pylist())
        return pa.Table.from_pylist([out | {"block": out["block"] // FAN}], schema=arrow)

    whole = placed
    while most > 0:
        group = F.expr(f"block div {FAN}")
        alone = Window.partitionBy("conv_id", group)
        sized = whole.withColumn("parts", F.count("*").over(alone)).withColumn("of", group)
        single = sized.where("parts = 1").withColumn("block", F.col("of")).select(*schema.names)
        several = sized.where("parts > 1").groupBy("conv_id", "of").applyInArrow(
            lambda table: together(table.drop_columns(["parts", "of"])), schema)
        whole = written(single.unionByName(several), "repair-spans")
        most //= FAN

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [cheapest(_unpacked(r)) for r in batch.select(["states", "costs", "audits"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", *_COUNTS, "low", "high")]
                + [pa.array([c for c, _ in chosen], pa.int64()), pa.array([a for _, a in chosen], pa.string())],
                ["conv_id", *_COUNTS, "low", "high", "cost", "audit"])

    out = T.StructType([f for f in schema.fields if f.name in ("conv_id", *_COUNTS, "low", "high")]
                       + [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    named = whole.mapInArrow(best, out).withColumn(
        "gaps", F.coalesce(F.expr("CAST(high - low + 1 AS bigint) - turns"), F.lit(0).cast("long")))
    return written(named.select("conv_id", "rows", "blank", "duplicate", "truncated", "illegal", "gaps", "cost",
                                "audit"), "repair-audits")


# --- repaired conversations --------------------------------------------------------------------

class Repair:
    """Follows one conversation's audit while its rows come in."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.place = audit, 0, 0, 0

    def _out(self, edit: str, role: str | None, text: str) -> tuple[int, str, str, str]:
        """``role`` is None where the pattern says which one comes."""
        role = role if role is not None else ROLES["a" if self.state == 2 else "u"]
        self.state = NEXT[self.state, role[:1]]
        self.place += 1
        return self.place - 1, edit, role, text

    def insertions(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._out("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """place, edit, role, text of what the next row becomes, with what is inserted around it."""
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(edit, role if edit == "K" else None, text)
        yield from self.insertions()


def repair(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations, each in order within one partition.

    A conversation's rows pass one by one behind its audit, so none is held whole.
    """
    conv_id = rows.schema["conv_id"]
    keyed = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text",
                        F.left("text", F.lit(64)).alias("head"), _mark())
    heads = chosen.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("head"),
                          F.unhex(F.lit("")).alias("mark"))
    first, *others = _order()
    ordered = keyed.unionByName(heads).repartition("conv_id").sortWithinPartitions(first, "kind", *others).select(
        "conv_id", "kind", "role", "text")
    schema = T.StructType([T.StructField("conv_id", conv_id.dataType), T.StructField("place", T.LongType()),
                           T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, current = to_arrow_schema(schema), Repair("")
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = []
                for r in batch.slice(low, ROWS_AT_ONCE).to_pylist():
                    if r["kind"] == 0:
                        current = Repair(r["text"])
                    else:
                        out += [(r["conv_id"], *x) for x in current.row(r["role"], r["text"])]
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, names, strict=True)], schema=names)

    return ordered.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` of all its rows, one a line; for rows as repair() gives them."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def record(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])],
                                              schema.names)

        kind = None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for r in batch.select(["conv_id", "place", "role", "text"]).to_pylist():
                if r["place"] == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = r["conv_id"], hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{r['role']}:{r['text']}".encode())
            if done:
                yield record(done)
        if state is not None:
            yield record([(conv, state.hexdigest())])

    return repaired.mapInArrow(run, schema)
