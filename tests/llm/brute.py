"""Plain versions of the operators' results, row by row in Python."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    found = [(m.start(), 1, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 2, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 3, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def entropy_spans(text: str | None, classes, allow, parts) -> list[tuple[int, int, str, int]]:
    """The added spans, each window's entropy counted anew."""
    base, found = base_spans(text), set()
    for cls in classes:
        for m in re.finditer(cls.run, text or ""):
            run = m[0]
            if not all(re.search(p, run) for p in cls.needs) or any(re.search(p, run) for p in allow):
                continue
            for pattern, _ in parts:
                run = re.sub(pattern, lambda m: "-" * len(m[0]), run)
            merged: list[list[int]] = []
            for i in range(len(run) - cls.window + 1):
                counts = Counter(run[i:i + cls.window])
                total = sum(round(n * math.log2(n) * (1 << 32)) for n in counts.values())
                if total <= cls.most:
                    if merged and merged[-1][1] >= i:
                        merged[-1][1] = i + cls.window
                    else:
                        merged.append([i, i + cls.window])
            found |= {(m.start() + a, 4, "entropy", m.start() + b) for a, b in merged}
    return sorted(s for s in found if not any(b[0] < s[3] and s[0] < b[3] for b in base))


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def article(page: str) -> str:
    """The text of a page of the test tables, whose article has no element that is to be left out."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1]) if inner else []
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split())
             for b in blocks)
    return "\n\n".join(b for b in plain if b)


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), most: int = 3) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    open_, left = set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def repeats(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: bytes, removed bytes, removed runs, hash of the rest."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s:s + length]
            if part in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen.add(part)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def quality_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            repeated, n < 10 or 100 * repeated > 20 * n)


def license_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def classes(links: list[tuple[int, int]], ids: list[int]) -> dict[int, int]:
    """id: smallest id of its component."""
    parent = {i: i for i in ids}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_bag(text: str | None) -> Counter:
    words = WORD.findall(text or "")
    n = min(5, len(words))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def near_classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """Classes from every pair of documents that shares a shingle."""
    bags = {doc: shingle_bag(text) for doc, text in rows}
    holders: dict[tuple, list[int]] = {}
    for doc, bag in bags.items():
        for s in bag:
            holders.setdefault(s, []).append(doc)
    pairs, links = set(), []
    for held in holders.values():
        pairs.update((a, b) for i, a in enumerate(held) for b in held[i + 1:])
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= least * (bags[a].total() + bags[b].total() - both):
            links.append((a, b))
    return classes(links, list(bags))
