"""License scans: exact phrases, and fuzzy search for short notices.

A text is lower-cased (A-Z) and reduced to its words joined by single spaces, so that layout and
punctuation play no part. A notice may differ from the text by ``edits`` characters put in, left
out or exchanged. Cut into edits + 1 pieces, at least one piece of a matching notice stands in
the text unchanged; those pieces are searched for exactly, each hit places a window, and the
regex library's bounded-error matching verifies the windows and reports the spans. Where notices that
differ in a word or two match at one place, that with the fewest edits for its length stays.

Null texts count as empty; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import over_batches

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int


#: Short notices as words in lower case. About one edit in twelve characters is allowed.
NOTICES = tuple(Notice(label, words, max(1, len(words) // 12)) for label, words in (
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-sa-notice", "licensed under cc by sa 4 0"),
    ("cc-by-nd-notice", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-notice", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd-notice", "licensed under cc by nc nd 4 0"),
    ("cc-by-notice", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-notice", "subject to the terms of the mozilla public license v 2 0"),
))

#: Letters to lower case; every other ASCII character that is no word character to a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
               else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def kept_between(starts: list[int], kept: list, low: int, high: int) -> list:
    return kept[bisect(starts, low - 1):bisect(starts, high)]


class Scanner:
    """Compiled phrases, seeds and patterns; made once per worker."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            k = notice.edits + 1
            size = len(notice.words)
            cuts = [size * i // k for i in range(k + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice.words[a:b], []).append((n, a))
        for seed, places in held.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b)({regex.escape(x.words, literal_spaces=True)}){{e<={x.edits}}}")
                         for x in notices]

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """start, end (characters of the joined words), number and edits of each notice found."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            start = end + 1 - size
            for n, offset in places:
                notice = self.notices[n]
                low = max(0, start - offset - notice.edits)
                high = start - offset + len(notice.words) + notice.edits
                kept = windows.setdefault(n, [])
                if kept and low <= kept[-1][0] + 2 * notice.edits:
                    kept[-1][0] = min(kept[-1][0], low)
                    kept[-1][1] = max(kept[-1][1], high)
                else:
                    kept.append([low, high])
        found = []
        for n, spans in windows.items():
            taken = -1
            for low, high in spans:
                match = self.patterns[n].search(joined, max(low, 0), high)
                if match and match.start() >= taken:
                    taken = match.end()
                    found.append((match.start(), match.end(), n, sum(match.fuzzy_counts)))
        return sorted(self._best(found))

    def share(self, n: int, edits: int) -> float:
        """Share of a notice's characters that needed no edit."""
        return 1 - edits / len(self.notices[n].words)

    def _best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without matches that lie by more than half under a better one (of equals the longer, then the first)."""
        kept: list[tuple[int, int, int, int]] = []
        starts: list[int] = []
        longest = max((b - a for a, b, _, _ in found), default=0)
        for a, b, n, edits in sorted(found, key=lambda x: (-self.share(x[2], x[3]), x[0] - x[1], x[2], x[0])):
            # Only matches that start within the longest one's reach can lie over this one.
            near = kept_between(starts, kept, a - longest, b)
            if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for x, y, _, _ in near):
                at = bisect(starts, a)
                starts.insert(at, a)
                kept.insert(at, (a, b, n, edits))
        return kept

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None,
               "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        raw = b" ".join(words)
        base, firsts = set(), []
        padded = b" " + raw + b" "
        for phrase, label in PHRASES.items():
            needle = f" {phrase} ".encode()
            at = padded.find(needle)
            while at >= 0:
                base.add(label)
                firsts.append(at)
                at = padded.find(needle, at + 1)
        if firsts:
            out["n_base"] = len(firsts)
            out["first_word"] = padded.count(b" ", 0, min(firsts))
            out["last_word"] = padded.count(b" ", 0, max(firsts))
        joined = raw.decode()
        spans = self.fuzzy(joined)
        labels = base | {self.notices[n].label for _, _, n, _ in spans}
        out["base_labels"] = ",".join(sorted(base))
        out["labels"] = ",".join(sorted(labels))
        out["spans"] = [f"{self.notices[n].label}:{joined.count(' ', 0, a)}:{joined.count(' ', 0, b) + 1}:{edits}"
                        for a, b, n, edits in spans]
        out["score"] = 1.0 if base else max((self.share(n, e) for _, _, n, e in spans), default=0.0)
        return out


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, spans array<string>")
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
          "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
          "score": pa.float64(), "spans": pa.list_(pa.string())}
_scanners: dict[tuple[Notice, ...], Scanner] = {}


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """A row per document: word counts, places and labels, score, and the fuzzy spans.

    ``spans`` holds label:first word:word behind the last:edits. The score is 1 where a base phrase stands, else the best
    share of a notice's characters that needed no edit, else 0.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if notices not in _scanners:
            _scanners[notices] = Scanner(notices)
        rows = [_scanners[notices].scan(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in _TYPES.items())],
            ["doc_id", *_TYPES])

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
