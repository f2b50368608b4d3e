"""Secret scans with DataFrame functions only.

Fixed patterns find assigned secrets, access keys and long hexadecimal runs. Sliding windows of
Shannon entropy add strings that no pattern names: for each character class, runs of that class
are candidates, and a window of fixed width moves over each candidate while the counts of its
characters are kept up to date by one character in and one out. Entropy is measured in units of
2^-32 bit from a table of n*log2(n), so that the sums are whole numbers and no error builds up.

Positions count code points. A null or empty text has no spans, repeated rows are scanned each,
and columns other than those named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns. A hexadecimal run of 32 or an access key of 16 characters is
#: one whole greedy match, so the length can stand in the pattern; an assignment is judged after
#: matching, because a match that fails still uses up its characters.
ASSIGN = (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIN_ASSIGNED = 8


@dataclass(frozen=True)
class CharacterClass:
    """``run``: a candidate; ``window`` characters reach ``bits`` of entropy in a secret."""

    name: str
    run: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def most(self) -> int:
        """The largest sum of n*log2(n) over a window's counts, in units, with enough entropy."""
        return math.floor((self.window * math.log2(self.window) - self.window * self.bits) * UNIT)


UNIT = 1 << 32
CLASSES = (
    CharacterClass("hexadecimal", "[0-9a-fA-F]{24,}", 24, 3.0, ("[0-9]", "[a-fA-F]")),
    CharacterClass("base64", "[A-Za-z0-9+/_-]{20,}", 20, 3.8, ("[0-9]", "[A-Za-z]")),
)
#: Candidates that are, as a whole, never secrets: identifiers of words with a short number behind, and
#: groups that are each a word or a number.
ALLOW = (
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,6}$",
    r"^(?:[a-z]{1,24}|[0-9]{1,12})(?:[-_/](?:[a-z]{1,24}|[0-9]{1,12}))+$",
)
#: Parts of a candidate that are no part of a secret, and their lengths. They count as one repeated character, so
#: windows over them have little entropy, while a secret beside them is found as if it stood alone.
ALLOWED_PARTS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", 36),
    *((f"(?i){word}", len(word)) for word in (
        "placeholder", "changeme", "abcdefgh", "12345678", "example", "xxxx", "0000")),
)


def masked(found: str, parts: tuple[tuple[str, int], ...]) -> str:
    """SQL of ``found`` with every allowed part replaced by as many hyphens."""
    for pattern, length in parts:
        found = f"regexp_replace({found}, {_quoted(pattern)}, '{'-' * length}')"
    return found


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(found: str, pieces: str, kind: str, rank: int) -> str:
    """Places of the matches ``found`` between the ``pieces`` of the text around them."""
    return f"""
      CASE WHEN size({found}) > 0 THEN aggregate(sequence(0, size({found}) - 1),
        named_struct('at', 0L, 'out', CAST(array() AS array<struct<start: bigint, rank: int, kind: string, end: bigint, found: string>>)),
        (s, i) -> named_struct(
          'at', s.at + length({pieces}[i]) + length({found}[i]),
          'out', array_append(s.out, named_struct('start', s.at + length({pieces}[i]),
            'rank', {rank}, 'kind', '{kind}',
            'end', s.at + length({pieces}[i]) + length({found}[i]), 'found', {found}[i]))),
        s -> s.out)
      ELSE CAST(array() AS array<struct<start: bigint, rank: int, kind: string, end: bigint, found: string>>) END"""


def _windows(cls: CharacterClass, span: str, parts: tuple[tuple[str, int], ...]) -> str:
    """Merged windows of one candidate span whose entropy is high enough."""
    w = cls.window
    table = ", ".join(f"{round(n * math.log2(n) * UNIT) if n else 0}L" for n in range(w + 1))
    codes = f"transform(regexp_extract_all({masked(span + '.found', parts)}, '.', 0), x -> ascii(x))"
    return f"""
      aggregate(
        transform(array(named_struct('codes', {codes}, 'f', array({table}))), v -> v),
        CAST(array() AS array<struct<start: bigint, end: bigint>>),
        (none, v) -> aggregate(sequence(0, size(v.codes) - 1),
          named_struct('n', array_repeat(0, 128), 'sum', 0L,
                       'out', CAST(array() AS array<struct<start: bigint, end: bigint>>)),
          (s, i) -> aggregate(array(named_struct(
              'into', v.codes[i], 'out', CASE WHEN i >= {w} THEN v.codes[i - {w}] ELSE -1 END)),
            s,
            (t, c) -> named_struct(
              'n', CASE WHEN c.into = c.out THEN t.n ELSE
                     transform(t.n, (k, j) -> k + CASE WHEN j = c.into THEN 1 WHEN j = c.out THEN -1 ELSE 0 END) END,
              'sum', CASE WHEN c.into = c.out THEN t.sum ELSE
                     t.sum + v.f[t.n[c.into] + 1] - v.f[t.n[c.into]]
                     + CASE WHEN c.out >= 0 THEN v.f[t.n[c.out] - 1] - v.f[t.n[c.out]] ELSE 0L END END,
              'out', t.out),
            t -> CASE WHEN i >= {w - 1} AND t.sum <= {cls.most}L THEN named_struct('n', t.n, 'sum', t.sum,
                   'out', CASE WHEN size(t.out) > 0 AND element_at(t.out, -1).end >= i - {w - 1}
                     THEN array_append(slice(t.out, 1, size(t.out) - 1), named_struct('start', element_at(t.out, -1).start, 'end', i + 1L))
                     ELSE array_append(t.out, named_struct('start', i - {w - 1}L, 'end', i + 1L)) END)
                 ELSE t END),
          s -> s.out))"""


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         classes: tuple[CharacterClass, ...] = CLASSES,
         allow: tuple[str, ...] = ALLOW,
         parts: tuple[tuple[str, int], ...] = ALLOWED_PARTS) -> DataFrame:
    """``id_column``, ``text`` (null as empty), and ``base`` and ``added``: arrays of spans.

    A span has start, rank, kind, end and the string found. ``added`` holds spans of kind
    "entropy" that touch no base span. The allow-list suppresses candidates that match a pattern of ``allow`` as a
    whole, and the ``parts`` of others alone. Empty tables give empty results.
    """
    frame = docs.select(F.col(id_column).alias("id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX,
                **{f"c{i}": c.run for i, c in enumerate(classes)}}
    frame = frame.selectExpr("id", "text", *(
        f"regexp_extract_all(text, {_quoted(p)}, 0) AS m_{k}" for k, p in patterns.items()))
    frame = frame.selectExpr("id", "text", *(f"m_{k}" for k in patterns), *(
        f"CASE WHEN size(m_{k}) > 0 THEN split(text, {_quoted(p)}, -1) END AS p_{k}"
        for k, p in patterns.items()))
    kinds = {"assign": 1, "access": 2, "hex": 3}
    frame = frame.selectExpr("id", "text", *(
        _spans(f"m_{k}", f"p_{k}", k, kinds.get(k, 4)) + f" AS s_{k}" for k in patterns))
    frame = frame.selectExpr(
        "id", "text",
        f"array_sort(concat(filter(s_assign, x -> length(regexp_extract(x.found, {_quoted(ASSIGN)}, 2))"
        f" >= {MIN_ASSIGNED}), s_access, s_hex)) AS base",
        *(f"filter(s_c{i}, x -> " + " AND ".join(
            [f"x.found RLIKE {_quoted(p)}" for p in c.needs]
            + [f"NOT x.found RLIKE {_quoted(p)}" for p in allow]) + f") AS s_c{i}"
          for i, c in enumerate(classes)))
    added = ", ".join(
        f"flatten(transform(s_c{i}, x -> transform({_windows(c, 'x', parts)}, w -> named_struct("
        "'start', x.start + w.start, 'rank', 4, 'kind', 'entropy', 'end', x.start + w.end, "
        "'found', substring(x.found, CAST(w.start + 1 AS int), CAST(w.end - w.start AS int))))))"
        for i, c in enumerate(classes))
    frame = frame.selectExpr("id", "text", "base", f"""
      CASE WHEN {' OR '.join(f'size(s_c{i}) > 0' for i in range(len(classes)))} THEN
        array_sort(array_distinct(filter(concat({added}),
          e -> NOT exists(base, b -> b.start < e.end AND e.start < b.end))))
      ELSE CAST(array() AS array<struct<start: bigint, rank: int, kind: string, end: bigint, found: string>>) END AS added""")
    return frame.withColumnRenamed("id", id_column)


def digest(spans: str) -> F.Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; all columns stay as they are otherwise.

    Overlapping spans are one replacement. Null texts stay null.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"),
                        F.col(text_column).alias("text"))
    found = scan(whole.select("row", "text"), "row", "text")
    clean = F.expr(f"""
      aggregate(array_sort(concat(base, added)),
        named_struct('at', 0L, 'out', CAST('' AS string)),
        (s, x) -> CASE WHEN x.start >= s.at
          THEN named_struct('at', x.end, 'out', concat(s.out, substring(text, CAST(s.at + 1 AS int), CAST(x.start - s.at AS int)), {_quoted(mark)}))
          ELSE named_struct('at', greatest(s.at, x.end), 'out', s.out) END,
        s -> concat(s.out, substring(text, CAST(s.at + 1 AS int))))""")
    touched = F.when(F.expr("size(base) + size(added) > 0"), clean)
    return found.select("row", touched.alias("clean")).select(*(
        (F.coalesce("clean", F.col("row")[c]) if c == text_column else F.col("row")[c]).alias(c)
        for c in docs.columns))
