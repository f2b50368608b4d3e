"""Packing, collocations and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelquant.llm import collocations, conversation_repair, packing, queries

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "!?"]) for _ in range(n))


# --- packing -----------------------------------------------------------------------------------

ODD = ["", " \n\t ", None, "Don't STOP it's we'LL 'sound", "naïve Straße ÀÉÎ ÿ×÷", "日本語 текст ｆｕｌｌ Ⅷ ²", "á é İ ﬁ",
       "x y　z \x1c\x85 tab\x0bvt", "<|endoftext|> a<|startoftext|>b <|x", "\x7f\x00\x01 control", "12345 3.14 a1b2",
       "emoji 😀👩‍👩‍👧 ok", "!!!???...", "ab" * 3000, "ßẞ ŒUVRE œuvre ǅ"]


def test_word_ids_equal_the_library():
    import pyarrow as pa

    path = queries.word_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*ODD, *(prose(200, i) for i in range(20))]
    got = packing.WordEncoder(path)(pa.array(texts), 2).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


def test_every_merge_gives_back_its_token():
    """What makes merging by token equal to merging by pair: one rule per token, and each token reachable."""
    encoder = packing.WordEncoder(queries.word_vocabulary())
    tokens = {v: k for k, v in encoder.tokenizer.get_vocab().items()}
    ids = encoder.ids[512:].tolist()
    made = [t for t in ids if t < 49406]
    assert len(set(made)) == len(made)
    spelt = [tokens[t] for t in made if tokens[t].endswith("</w>")]
    joined = " ".join(t.removesuffix("</w>") + encoder._END for t in spelt)
    ranks = encoder.merger.encode_ordinary(joined)
    assert encoder.ids[ranks].tolist() == [t for t in made if tokens[t].endswith("</w>")]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=12))
def test_plan_places_every_id_once(counts):
    rows, sequences = packing.plan(dict(counts), 32)
    fills: Counter = Counter()
    seen: Counter = Counter()
    for origin, first, count, _, start, length, number, sequence, each, offset in rows:
        for k in range(count):
            at = number + k
            place = sequence + at // each, offset + at % each * length
            fills[place[0]] += length
            for i in range(length):
                seen[place[0], place[1] + i] += 1
                seen[origin, first + k, start + i, "id"] += 1
    assert set(seen.values()) <= {1}
    assert sum(fills.values()) == sum(length * n for length, n in counts.items())
    assert sorted(fills) == list(range(sequences))
    sizes = list(fills.values())
    assert all(x == 32 or x & (x - 1) == 0 for x in sizes) and sum(x < 32 for x in sizes) <= 5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5))
def test_fullest_window(counts):
    items = [x for x, n in counts.items() for _ in range(n)]
    longest = max(items)
    rest = sorted(items)[:-1]
    best = max(longest + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k)
               if longest + sum(c) <= 24)
    used, fill = packing.fullest(sorted(counts), counts, 24)
    assert fill == best == sum(x * n for x, n in used.items())
    assert used[longest] >= 1 and all(n <= counts[x] for x, n in used.items())


def held(spark, lengths):
    rows = [(i, np.arange(i, i + n).astype("<u4").tobytes()) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id bigint, ids binary"), dict(rows)


@pytest.mark.parametrize("salt", [1 << 16, 3])
def test_pack(spark, salt, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", salt)
    rng = random.Random(salt)
    frame, ids = held(spark, [rng.randrange(1, 200) for _ in range(60)] + [40] * 50 + [64, 128, 0])
    rows = packing.pack(frame, 64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]
        assert r.doc_tokens * 4 == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, whole in [*((by_doc.get(i, []), len(x) // 4) for i, x in ids.items()),
                          *((x, sum(n for _, n in x)) for x in by_sequence.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole
    filled = packing.sequences(packing.pack(frame, 64), 64).collect()
    assert all(len(r.ids) == 4 * (r.n_tokens + r.padding) and r.padding == 0 for r in filled)
    assert sum(r.n_tokens for r in filled) * 4 == sum(map(len, ids.values()))


def test_packing_of_texts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, *ODD])] + [(0, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, row bigint")
    pieces = packing.pack(packing.tokens(docs, queries.word_vocabulary()))
    assert sum(r.length for r in pieces.collect()) == sum(
        len(r.ids) // 4 for r in packing.tokens(docs, queries.word_vocabulary()).collect())
    assert packing.pack(packing.tokens(docs.limit(0), queries.word_vocabulary())).collect() == []


# --- collocations ------------------------------------------------------------------------------

def plain_collocations(rows, least, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    out: dict = {}
    for p, a in often.items():
        lang, *words = p
        if len(words) == 2 and any(q[0] == lang and len(q) == 4 and 100 * b >= 50 * a and
                                   (list(q[1:3]) == words or list(q[2:]) == words) for q, b in often.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score)
                  for lang, found in out.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first]))


@pytest.mark.parametrize("shard_words, fan", [(1 << 20, 8), (50, 1)])
def test_collocations(spark, shard_words, fan, monkeypatch):
    monkeypatch.setattr(collocations, "FAN_BITS", fan)
    rows = [("en" if i % 3 else None, prose(60, i).upper() if i % 2 else prose(60, i)) for i in range(60)]
    rows += [("de", "Äpfel und Äpfel\tund birnen\x0bund"), ("de", None), ("fr", ""), ("fr", " \t.. ")] * 6
    rows += [("en", "one two three. " * 40)] * 2
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows],
                                 "lang string, text string, n bigint, a int, shard string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, first=25, least=6, shard_words=shard_words).collect())
    assert got == plain_collocations(rows, 6, 25) and len(got) > 20
    assert collocations.collocations(docs.limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 42), st.data())
def test_permutation_is_invertible(bits, data):
    keys = collocations.Keys(bits)
    numbers = st.integers(0, (1 << bits) - 1)
    rows = data.draw(st.lists(st.tuples(numbers, numbers, numbers), min_size=1, max_size=20))
    words = [np.array(c, np.uint64) for c in zip(*rows)]
    quotient, remainder = keys.permute(words)
    assert max(quotient.max(), remainder.max()) < 1 << keys.half
    assert all((a == b).all() for a, b in zip(words, keys.restore(quotient, remainder)))
    assert len(set(zip(quotient.tolist(), remainder.tolist()))) == len(set(rows))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 60), st.integers(0, 1 << 60), st.integers(1, 1 << 40)), max_size=40))
def test_filters_lose_nothing(rows):
    columns = [np.array([r[k] for r in rows], np.uint64) for k in range(3)]
    found = collocations.Filter.unpack(collocations.Filter.merged(*columns).pack())
    want: Counter = Counter()
    for q, r, n in rows:
        want[q, r] += n
    got = list(zip(found.quotient.tolist(), found.remainder.tolist(), found.count.tolist()))
    assert got == sorted((*k, n) for k, n in want.items())


# --- conversation repair -----------------------------------------------------------------------

def all_repairs(rows, most_inserted):
    """(cost, audit) of every repair with at most so many insertions; rows are (initial, must go, truncated)."""
    pattern = re.compile("(s?(ua)+)?")
    best = None
    for edits in itertools.product("KRrD", repeat=len(rows)):
        if any(gone and e != "D" for (_, gone, _), e in zip(rows, edits)):
            continue
        kept = [(x if e == "K" else "u" if e == "R" else "a", e) for (x, _, _), e in zip(rows, edits)]
        cost = sum({"K": 0, "R": 3, "r": 3, "D": 4}[e] + (3 if t and e != "D" else 0)
                   for (_, _, t), e in zip(rows, edits))
        for many in range(most_inserted + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), many):
                for letters in itertools.product("ua", repeat=many):
                    out, audit = "", ""
                    for i in range(len(rows) + 1):
                        for p, x in zip(places, letters):
                            if p == i:
                                out, audit = out + x, audit + "I"
                        if i < len(rows):
                            audit += edits[i].upper()
                            if edits[i] != "D":
                                out += kept[i][0]
                    if pattern.fullmatch(out):
                        found = cost + 3 * many, audit
                        best = found if best is None else min(best, found)
    return best


def symbol(row):
    initial, gone, truncated = row
    return "d" if gone else initial.upper() if truncated else initial


@pytest.mark.parametrize("seed", range(40))
def test_chart_finds_the_cheapest_repair(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 5))]
    found = conversation_repair.cheapest(conversation_repair.cell("".join(map(symbol, rows))))
    assert found == all_repairs(rows, 3)


def test_any_split_gives_the_same_cell():
    rng = random.Random(1)
    for _ in range(20):
        symbols = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(symbols))
        assert conversation_repair.cell(symbols) == conversation_repair.joined(
            conversation_repair.cell(symbols[:cut]), conversation_repair.cell(symbols[cut:]))


def plain_repairs(rows):
    """Forward over rows and states, one conversation at a time."""
    damaged: dict = {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        if kind:
            damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    step = conversation_repair.NEXT
    for conv, held_rows in damaged.items():
        held_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
        seen, counts, cells = set(), Counter(), {0: (0, "", ())}

        def inserted(cells):
            for _ in range(4):
                for (p, x), q in step.items():
                    if p in cells and x in "ua":
                        c, a, o = cells[p]
                        new = c + 3, a + "I", (*o, ({"u": "user", "a": "assistant"}[x], ""))
                        cells[q] = min(cells.get(q, new), new, key=lambda w: w[:2])
            return cells

        for _, role, text in held_rows:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            duplicate = not blank and (role, text) in seen
            seen.add((role, text))
            cut = not blank and not duplicate and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            counts.update(blank=blank, duplicate=duplicate, truncated=cut)
            new = {}
            for p, (c, a, o) in inserted(cells).items():
                ways = [(p, c + 4, a + "D", o)]
                if not blank and not duplicate:
                    more = 3 if cut else 0
                    if (p, role[:1]) in step:
                        ways.append((step[p, role[:1]], c + more, a + "K", (*o, (role, text))))
                    ways += [(step[p, x], c + 3 + more, a + "R", (*o, (name, text)))
                             for x, name in (("u", "user"), ("a", "assistant")) if (p, x) in step]
                for q, *w in ways:
                    new[q] = min(new.get(q, tuple(w)), tuple(w), key=lambda w: w[:2])
            cells = new
        cost, audit, kept = min((inserted(cells)[q] for q in (0, 3) if q in cells), key=lambda w: w[:2])
        turns = [t for t, _, _ in held_rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held_rows, held_rows[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bits, fan", [(9, 64), (2, 2)])
def test_conversation_repair(spark, tmp_path, block_bits, fan, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", block_bits)
    monkeypatch.setattr(conversation_repair, "FAN", fan)
    rng = random.Random(3)
    rows = []
    for conv in [*range(120), None]:
        turns = [t if rng.random() < 0.9 else None for t in range(rng.randrange(1, 9))]
        for t in turns:
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice([prose(5, rng.randrange(30)) + ".", prose(3, rng.randrange(5)), "", " \n", None, "same."])
            rows.append((conv, t, role, text))
    rows += [(500, t, ("user", "assistant")[t % 2 if t % 7 else 0], f"line {t % 50}" + "." * (t % 3)) for t in range(300)]
    rows += [(600, 5, "user", "equal rows.")] * 30
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, block string, row int")
    path = str(tmp_path / "conversations.parquet")
    frame.repartition(4).write.parquet(path)
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain_repairs(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    chosen = conversation_repair.audits(conversation_repair.faults(conversation_repair.damage(empty)))
    assert chosen.collect() == []
    assert conversation_repair.digests(conversation_repair.repair(empty, chosen)).collect() == []
