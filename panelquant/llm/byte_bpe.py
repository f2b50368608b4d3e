"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of ``chunk`` characters that each see ``overlap`` characters of the
next. Every chunk is pre-tokenised by itself, so chunks of one long text run in different tasks.
A pre-token never depends on what stands before its start, so two tokenisations that share one
boundary agree from there on: neighbours are stitched at the first boundary both have in their
overlap. A pre-token that reaches a chunk's end is not trusted, as its match might go on. Where
an overlap has no common boundary (one run longer than the overlap), the left chunk is read on
together with the next one.

The pre-tokens are then merged by rank, each distinct one once while a worker remembers it, and decoded
by concatenating raw bytes. Null texts encode as empty
texts; repeated rows are encoded each; empty tables give empty results; other columns pass
through whatever their names.
"""

from __future__ import annotations

import base64
import functools
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelquant.llm.common import ROWS_AT_ONCE, Recent, by_size, gathered, objects

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Bytes of pre-tokens and their ids in each of the two generations that a worker remembers.
MOST_REMEMBERED = 32 << 20
#: Bytes of text whose pre-tokens are held as Python objects at once.
TEXT_AT_ONCE = 2 << 20
#: Pre-tokens of a long text that are turned into ids at once.
TOKENS_AT_ONCE = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pre-tokens to little-endian unsigned 32-bit ids, remembering recent ones."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        # Splits nothing, so that a pre-token is merged as it is.
        self.library = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.remembered = Recent(self.merge, MOST_REMEMBERED)

    def merge(self, pieces: list[str]) -> list[bytes]:
        encode = self.library.encode_ordinary
        return [array("I", encode(p)).tobytes() for p in pieces]

    def ids(self, texts: list[list[str]]) -> pa.Array:
        """Ids of every list of pre-tokens, as bytes."""
        found = pa.array([p for x in texts for p in x], pa.large_string()).dictionary_encode()
        ids, ends = gathered(self.remembered.get(objects(found.dictionary)), found.indices.to_numpy(), 4)
        edges = np.cumsum([0, *map(len, texts)])
        return _binary(ids.astype("<u4"), np.concatenate([[0], ends])[edges] * 4)


class Decoder:
    """The tokens' bytes one behind the other, without what encoding needs."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        self.ends = np.cumsum(self.lengths)
        by_rank = dict(sorted((rank, token) for token, rank in ranks.items()))
        self.bytes = np.frombuffer(b"".join(by_rank.values()), np.uint8)

    def raw(self, ids: pa.Array) -> pa.Array:
        """Bytes of every list of ids, nulls as empty."""
        ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
        edges = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
        held = ids.buffers()[2]
        flat = np.frombuffer(held, np.uint8)[edges[0]:edges[-1]].view("<u4") if held else np.zeros(0, "<u4")
        length = self.lengths[flat]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.bytes[np.repeat(self.ends[flat] - ends[1:], length) + np.arange(ends[-1])]
        return _binary(data, ends[(edges - edges[0]) // 4])


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [
        None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def trusted(pattern: regex.Pattern, text: str, last: bool) -> list[str]:
    """Pre-tokens of a chunk from its start; without ``last``, none that reaches its end."""
    found = pattern.findall(text)
    if found and not last:
        found.pop()
    return found


# Once per worker process; a worker builds only the one that its step needs.
@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.cache
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def stitch(parts: list[tuple[str, list[str]]], pattern: regex.Pattern, chunk: int) -> Iterator[str]:
    """The pre-tokens of a text from those of its chunks, in order.

    ``parts`` holds each chunk's characters (with overlap) and its trusted pre-tokens.
    """
    text, tokens = parts[0]
    at, rest = 0, tokens  # the absolute place of the next pre-token of ``rest``
    reach = len(text)  # absolute end of what ``text`` shows; text starts at ``base``
    base = 0
    for k in range(1, len(parts)):
        nxt_text, nxt_tokens = parts[k]
        start = k * chunk
        own, p = {}, start
        for i, token in enumerate(nxt_tokens):
            own[p] = i
            p += len(token)
            if p > reach:
                break
        own[p] = min(len(own), len(nxt_tokens))
        joined, out = -1, []
        for token in rest:
            if at >= start and at in own:
                joined = own[at]
                break
            out.append(token)
            at += len(token)
        else:
            if at >= start and at in own:
                joined = own[at]
        yield from out
        if joined >= 0:
            base, text, rest, reach = start, nxt_text, nxt_tokens[joined:], start + len(nxt_text)
            continue
        # No common boundary: read on from the last sure place over both chunks.
        text = text[at - base:] + nxt_text[max(0, reach - start):]
        base, reach = at, start + len(nxt_text)
        rest = trusted(pattern, text, k == len(parts) - 1)
    yield from rest


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids``: each text's ids as little-endian unsigned 32-bit integers.

    Texts of one chunk are encoded where they are read. The chunks of longer texts are dealt out
    evenly, pre-tokenised, then gathered by text for stitching: no more than one text, which is
    one row of the input, meets in a task.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    frame = docs.select(F.col(key).alias("key"), text.alias("text"))
    key_type = frame.schema["key"].dataType
    chunks = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk)).cast("int")
    out = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.BinaryType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part in by_size(batch, "text", TEXT_AT_ONCE):
                ids = encoder.ids(list(map(encoder.pattern.findall, part.column("text").to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])

    single = frame.where(chunks == 1).mapInArrow(whole, out)
    long = frame.where(chunks > 1).withColumn("same", F.monotonically_increasing_id()).withColumn(
        "part", F.explode(F.sequence(F.lit(0), chunks - 1))).selectExpr(
        "key", "same", "part", f"substring(text, part * {chunk} + 1, {chunk + overlap}) AS text",
        f"length(text) <= part * {chunk} + {chunk + overlap} AS last")
    cut = T.StructType([T.StructField("key", key_type), T.StructField("same", T.LongType()),
                        T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()),
                        T.StructField("lengths", T.ArrayType(T.IntegerType()))])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            lengths = [list(map(len, trusted(compiled, t, last))) for t, last in zip(
                batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "same", "part", "text")),
                 pa.array(lengths, pa.list_(pa.int32()))], cut.names)

    def join(table: pa.Table) -> pa.Table:
        encoder = _encoder(path, pattern)
        table = table.sort_by("part")
        parts = []
        for text, lengths in zip(table.column("text").to_pylist(),
                                 table.column("lengths").to_pylist(), strict=True):
            tokens, at = [], 0
            for n in lengths:
                tokens.append(text[at:at + n])
                at += n
            parts.append((text, tokens))
        tokens = itertools.batched(stitch(parts, encoder.pattern, chunk), TOKENS_AT_ONCE)
        ids = b"".join(encoder.ids([list(some)])[0].as_py() for some in tokens)
        return pa.table([table.column("key").slice(0, 1), pa.array([ids], pa.binary())], names=["key", "ids"])

    # monotonically_increasing_id() only has to tell rows apart within the shuffle that it enters.
    dealt = long.repartition(F.col("same"), F.col("part"))
    stitched = dealt.mapInArrow(pretokenise, cut).groupBy("same").applyInArrow(join, out)
    return single.unionByName(stitched).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` with ``bytes``, the tokens' bytes in order; null ids decode to null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                raw = pc.if_else(pc.is_valid(part.column(at)), decoder.raw(part.column(at)), None)
                yield pa.RecordBatch.from_arrays([*part.columns, raw], schema.names)

    return encoded.mapInArrow(run, schema)
