"""Every operator against a plain version, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import base64
import math
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelquant.llm import (bag_minhash, byte_bpe, components, embeddings, html_main, license_scan, mixing,
                            quality, queries, secret_scan, suffix_dedup, toxicity)
from tests.llm import brute

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, anchor string, "
          "band string, h string, key string, id string, row string")
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def cases() -> list[tuple[int | None, str | None]]:
    story, passage = prose(120, 1), prose(40, 2)
    near = story.split()
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, story), (6, story), (7, " ".join(near)),
        (8, prose(90, 3) + "\n" + passage), (9, passage + "\n" + prose(80, 4)), (10, prose(6000, 5)),
        (11, "ab" * 400), (12, "same line\nsame line\nsame line\n" * 30),
        (13, 'password = "hunter2hunter2" token:abc TOKEN=abcdefgh12 é\U0001F600 AKIAABCDEFGHIJKL12 ' + "0f" * 20),
        (14, "key ghs_x9Kq2LmZ7TnB4vRw8YcD1 and 123e4567-e89b-12d3-a456-426614174000 token=token:abcdefghij"),
        (15, "Released under the MIT Licence. Licensed under the Apache License, Version 2.0; MIT license"),
        (16, "#*$%&|<> " * 40), (17, passage), (17, passage), (18, "   lead   　 ideographic\r\n\r\n  end  "),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 1, 2, "x", "y", "z", "k", "i", "r")
            for i, t in cases()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(cases())


def by_id(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select("doc_id", *columns).collect()}


@pytest.mark.parametrize("run", [
    lambda d: secret_scan.scan(d), lambda d: secret_scan.redact(d), lambda d: mixing.mix(d), lambda d: mixing.copies(d),
    lambda d: byte_bpe.encode(d, *queries.vocabulary()), lambda d: quality.judge(d), lambda d: license_scan.scan(d),
    lambda d: suffix_dedup.remove_repeats(d), lambda d: bag_minhash.deduplicate(d), lambda d: bag_minhash.keep_one(d),
    lambda d: toxicity.score(d, None)])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).collect() == []


def test_secret_scan(docs, texts):
    found = by_id(secret_scan.scan(docs).select("doc_id", secret_scan.digest("base").alias("b"),
                                                secret_scan.digest("added").alias("a")), "b", "a")
    for i, text in texts.items():
        added = brute.entropy_spans(text, secret_scan.CLASSES, secret_scan.ALLOW, secret_scan.ALLOWED_PARTS)
        assert found[i] == (brute.joined(brute.base_spans(text)), brute.joined(added)), i
    assert "entropy" in found[14][1] and found[13][0].startswith("assign:0:")


def test_redaction_keeps_rows_and_columns(docs, texts):
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    got = by_id(clean, "text")
    assert got[1] == (None,) and got[5] == (texts[5],) and "hunter2" not in got[13][0] and got[13][0].count("[SECRET]") == 4


PAGES = [
    (1, "http://a.org/1", "<title>t</title><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>three</b><p>four</article>"
                          "<footer>f</footer>"),
    (2, None, None), (3, "::", ""), (4, "http://a.org/2", "<main><div class='cookie-notice'>no</div><ul><li>x<li>y</ul>tail"),
    (5, "http://a.org/3", "plain &lt;text&gt; <script>var a='<p>'</script><form>f</form><aside>s</aside>"),
]


def test_html(spark):
    pages = spark.createDataFrame([(*p, "h") for p in PAGES], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert got == {1: "A & B\n\none two three\n\nfour", 2: "", 3: "", 4: "x\n\ny\n\ntail", 5: "plain <text>"}
    assert html_main.extract(pages.limit(0)).collect() == []


def test_html_template_goes_and_copied_article_stays(spark):
    rows = [(i, "http://b.org/x", f"<div><p>Welcome to b</p></div><div><p>{prose(20, i)}</p></div>") for i in range(12)]
    rows += [(50 + i, "http://b.org/x", "<article><p>the same article</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == prose(20, 3) and got[55] == "the same article"


def test_html_line_of_every_article_goes_and_words_stay(spark):
    rows = [(i, "http://c.org/x", f"<article><h1>Title {i}</h1><p>Sign up for our letter</p><p>{prose(20, i)} <b>and</b> so</p>"
                                  f"<ul><li>yes</li><li>{i}</li></ul></article>") for i in range(30)]
    rows += [(50 + i, "http://c.org/x", f"<div>{prose(3, 90 + i)}</div><article><p>one copied article</p></article>") for i in range(40)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == f"Title 3\n\n{prose(20, 3)} and so\n\nyes\n\n3" and "one copied article" in got[55]


@pytest.mark.parametrize("html, text", [
    ("<div class='layout with-sidebar'><div class='sidebar'>s</div><article><p>body</p></article></div>", "body"),
    ("<div id='page-header-wrap'><main><p>body</p></main></div>", "body"),
    ("<form><div class=menu>m</div><p>body of the page</p><input></form>", "body of the page"),
    ("<article><div class='entry-header'><h1>T</h1></div><p>body</p></article>", "T\n\nbody"),
    ("<article><p>body</p></article><div class=comments><p>very long answer of some reader</p></div>", "body")])
def test_html_wrapper_of_the_article_stays(html, text):
    assert "\n\n".join(html_main.blocks(html_main.read(html), set(), {})) == text


@pytest.mark.parametrize("html, text", [
    ("<main><h1>Title</h1><p>lead</p><article><p>body</p></article></main>", "Title|lead|body"),
    ("<main><p>body</p><article><p>card</p></article></main><p>out</p>", "body|card"),
    ("<h1>Title</h1><nav>n</nav><article><p>body</p></article><footer>f</footer>", "Title|body")])
def test_html_text_around_articles_stays(html, text):
    assert "|".join(html_main.blocks(html_main.read(html), set(), {})) == text


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes: dict = {}
    for r in rows:
        assert r.size == len(brute.WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    wanted = brute.targets(sizes)
    for source, target in wanted.items():
        own = [r for r in rows if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in own)
        assert sum(r.taken for r in own) == pytest.approx(target, rel=0.02, abs=6)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.copies(docs).columns == docs.columns


def test_byte_bpe(docs, texts, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TOKENS_AT_ONCE", 100)
    path, pattern = queries.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (50, 7)):
        got = by_id(byte_bpe.decode(byte_bpe.encode(docs, path, pattern, chunk=chunk, overlap=overlap), path, pattern), "ids", "bytes")
        for i, text in texts.items():
            ids = np.array(own.encode_ordinary(text or ""), "<u4")
            assert bytes(got[i][0]) == ids.tobytes() and bytes(got[i][1]) == (text or "").encode(), (i, chunk)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * (0.15 if i >= 30 else 0)).tolist()) for i in range(150)]
    rows += [(200 + i, base[0].tolist()) for i in range(5)]
    odd = [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, []), (305, [1.0])]
    frame = spark.createDataFrame([(i, v, "l") for i, v in rows + odd], "vec_id bigint, embedding array<float>, cell string")
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    group = brute.classes([(ids[a], ids[b]) for a, b in np.argwhere(near)], ids)
    want = {i: (int(near[k].sum()), group[i], group[i] == i) for k, i in enumerate(ids)} | {i: (0, i, True) for i, _ in odd}
    got = {r[0]: tuple(r)[1:] for r in embeddings.deduplicate(frame, cells=6).collect()}
    assert got == want
    assert embeddings.deduplicate(frame.limit(0)).collect() == []


@pytest.mark.parametrize("part_bytes", [1 << 19, 2000])
def test_embeddings_are_not_copied_for_every_pair(spark, monkeypatch, part_bytes):
    """Parts of any size, large cells in pieces, two lengths of vectors and doubles: vectors go to no pair as rows."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 24))
    base[20:40] = base[0] + rng.normal(size=(20, 24)) * 0.6
    rows = [(i, (base[i % 80] + rng.normal(size=24) * (0.2 if i >= 80 else 0)).tolist()) for i in range(400)]
    rows += [(500 + i, (base[0][:8] + rng.normal(size=8) * 0.3).tolist()) for i in range(60)] + [(600, rows[7][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want, ids = {}, []
    for d in (8, 24):
        same = {i: v for i, v in rows if len(v) == d}
        x = np.array([*same.values()])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        ids = [*same]
        group = brute.classes([(ids[a], ids[b]) for a, b in np.argwhere(near)], ids)
        want |= {i: (int(near[k].sum()), group[i], group[i] == i) for k, i in enumerate(ids)}
    plans = []

    def noted(df, name, write=embeddings.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(embeddings, "written", noted)
    for name in ("LEAST_BYTES", "PART_BYTES"):
        monkeypatch.setattr(embeddings, name, part_bytes, raising=False)
    got = {r[0]: tuple(r)[1:] for r in embeddings.deduplicate(frame, cells=5).collect()}
    assert got == want
    plan = dict(plans)["embedding-links"]
    assert "Generate explode" not in plan and "CartesianProduct" in plan


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    bad = ["grubworm", "slimeball", "numbskull"]
    rows, labels = [], []
    for i in range(400):
        words = prose(60, 100 + i).split()
        if toxic := int(i % 4 == 0):
            for _ in range(4):
                word = rng.choice(bad)
                at = rng.randrange(1, len(word) - 1)
                words[rng.randrange(60)] = word[:at] + word[at + 1:] if i % 8 == 0 else word
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, prose(5, 1), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id bigint, toxic int"))
    got = by_id(toxicity.score(docs, model), "score", "predicted")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i][1] == int(i % 4 == 0) for i in held]) > 0.95
    assert got[1000] == got[1001] == (0.0, 0) and got[1002][1] == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


@pytest.mark.parametrize("most", [suffix_dedup.MAX_STRINGS, 1])
def test_suffix_dedup(docs, most):
    got = by_id(suffix_dedup.remove_repeats(docs, most).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                                               F.sha2("rest", 256).alias("s")), "n_bytes", "n_removed", "n_spans", "s")
    assert got == brute.repeats(list(dict(cases()).items()))


def test_quality(docs, texts):
    got = by_id(quality.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in texts.items():
        assert got[i][:6] == brute.quality_base(text), i
        assert got[i][6] == (not got[i][5])


def test_quality_rejects_what_lies_far_off(spark):
    rows = [(i, prose(80 + i % 40, i), "en", "a") for i in range(300)]
    rows.append((900, " ".join("!!??" + w.upper() + "%%%" for w in dict.fromkeys(prose(60, 7).split())), "en", "a"))
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")), "kept")
    assert not got[900][0] and all(got[i][0] for i in range(300))


def test_licenses(docs, texts):
    got = by_id(license_scan.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, text in texts.items():
        assert got[i][:5] == brute.license_base(text), i
    assert got[15][4:] == ("apache,mit", "apache,apache-2.0-notice,mit,mit-notice", 1.0) and got[4][5:] == ("", 0.0)


def test_bag_minhash(docs):
    got = by_id(bag_minhash.deduplicate(docs), "class_id")
    want = brute.near_classes(list(dict(cases()).items()))
    assert {i: c for i, (c,) in got.items()} == want
    kept = sorted(r.doc_id for r in bag_minhash.keep_one(docs).collect())
    assert kept == sorted(i for i, c in want.items() if i == c)


def test_bag_minhash_agreement_bound():
    # Losing a borderline pair by too few equal components is no likelier than by sharing no band.
    m, s, least = bag_minhash.BANDS * bag_minhash.ROWS, bag_minhash.SIMILARITY, bag_minhash.LEAST_AGREEMENT
    def below(n):
        return sum(math.comb(m, k) * s ** k * (1 - s) ** (m - k) for k in range(n))
    assert below(least) <= (1 - s ** bag_minhash.ROWS) ** bag_minhash.BANDS < below(least + 1)


def test_keep_one_keeps_all_texts_of_an_id(spark):
    rows = [(1, "one two three four five six"), (1, "quite another text of the same id"),
            (1, "one two three four five six"), (2, "one two three four five six"), (None, "null id"), (None, "null id")]
    kept = bag_minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [rows[0], rows[1], rows[4], rows[5]], key=str)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        s = np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64))
        a = rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.7, a, rng.integers(0, 9, 200))
        pair = (s[a > 0], a[a > 0]), (s[b > 0], b[b > 0])
        x, y = bag_minhash.signatures(list(pair))
        errors.append((x == y).mean() - bag_minhash.weighted_jaccard(*pair))
    assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    ids = sorted({i for a, b in links if a != b for i in (a, b)})
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {i: c for i, c in brute.classes(links, ids).items() if i != c}


def test_components_of_contracted_links_take_one_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: tables.append(name) or f(df, name))
    star = [(1, i) for i in range(2, 40)] + [(50, 51)]
    got = components.components(spark.createDataFrame(star, "a bigint, b bigint")).collect()
    assert sorted((c, i) for i, c in got) == star and len(tables) == 2
    tables.clear()
    none = components.components(spark.createDataFrame([], "a bigint, b bigint"))
    assert none.collect() == [] and len(tables) == 2


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        before = after
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    held = {r.doc_id: brute.sha(r.text.encode()) for r in before.collect()}
    assert rows and {r.doc_id: r.decoded_sha256 for r in rows} == held


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 13


@pytest.mark.parametrize("place", [0, 31, 63])
def test_toxicity_of_windows_without_n_grams(place):
    texts = [prose(20, i) + (" grubworm" if i % 4 == 0 else "") for i in range(64)]
    texts[place] = "# # . !"
    labels = np.array([int(i % 4 == 0) for i in range(64)])
    windows = toxicity.Windows.of(np.arange(64), pa.array(texts), labels)
    rows, sizes = windows.of_windows(np.arange(64))
    assert sizes[place] == 0 and sizes.sum() == len(rows) and (np.delete(sizes, place) > 0).all()
    weight, bias = toxicity._fit(windows, np.arange(64), 1)
    assert np.isfinite(weight).all() and windows.margins(np.array([place]), weight, bias)[0] == bias
    assert toxicity.train(windows) is not None


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.fit(docs, spark.createDataFrame([(5, 0), (6, 0)], "doc_id bigint, toxic int")) is None
    assert toxicity.fit(docs.limit(0), none) is None


def test_toxicity_windows_take_little_more_than_they_hold():
    n = 64_000
    texts = pa.array([" ".join(f"{j * 7919:09d}é" for j in range(i, i + 32)) for i in range(0, n, 32)])
    tracemalloc.start()
    windows = toxicity.Windows.of(np.arange(n // 32), texts, np.arange(n // 32) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(x.nbytes for x in (windows.words, windows.word_edges, windows.buckets, windows.bucket_edges))
    assert len(windows.bucket_edges) == n + 1 and peak < 4 * held
    words = [w for t in texts.to_pylist() for w in t.split()]
    for at in (0, toxicity.WORDS_AT_ONCE - 1, toxicity.WORDS_AT_ONCE, n - 1):
        low, high = windows.bucket_edges[windows.words[at]:windows.words[at] + 2]
        assert windows.buckets[low:high].tolist() == toxicity.grams([words[at]])[1].tolist()


def test_toxicity_windows_do_not_depend_on_how_many_texts_are_taken_at_once(monkeypatch):
    texts = pa.array([*(prose(20, i % 7) + f" own{i} #" for i in range(50)), "", None, " \n", "last é\U0001F600"])
    whole = toxicity.Windows.of(np.arange(54), texts, np.arange(54) % 2)
    for n in (1, 3, 53):
        monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", n)
        some = toxicity.Windows.of(np.arange(54), texts, np.arange(54) % 2)
        for name in ("words", "word_edges", "buckets", "bucket_edges"):
            assert (getattr(some, name) == getattr(whole, name)).all(), name


def test_toxicity_is_trained_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(20, i)) for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda windows: toxicity.Model(
        np.zeros(toxicity.BUCKETS, np.float32), float(os.getpid()), 1.0, 0.0))
    model = toxicity.fit(docs, labels)
    assert model.bias != os.getpid() and model.weight.shape == (toxicity.BUCKETS,)


def test_toxicity_sample_in_a_fixed_order(spark):
    docs = spark.createDataFrame([(i, prose(100, i)) for i in range(60)], "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    found = toxicity.sample(docs, labels)
    rows = [tuple(r) for r in found.collect()]
    assert found.rdd.getNumPartitions() == 1 and len(rows) > 100
    assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    assert rows == [tuple(r) for r in toxicity.sample(docs.repartition(3), labels).collect()]


@pytest.mark.parametrize("text, labels, score", [
    ("released undor the mit licence", "mit-notice", 1 - 2 / 30),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-notice", 1.0), ("licensed under cc by nd 4.0.", "cc-by-nd-notice", 1.0),
    ("licensed under cc by-nc 4.0", "cc-by-nc-notice", 1.0), ("licensed undr cc by nc sa 4.0", "cc-by-nc-sa-notice", 1 - 1 / 30),
    ("licensed under the gnu general public licence version 3", "gpl-notice", 1 - 1 / 55)])
def test_fuzzy_notices(text, labels, score):
    found = license_scan.Scanner(license_scan.NOTICES).scan("some words before. " + text + " and some behind")
    assert found["labels"] == labels and found["score"] == pytest.approx(score)


def test_fuzzy_notices_against_every_window():
    """Every notice within its bound of edits by plain edit distance is found, and nothing beyond it."""
    rng = random.Random(6)

    def distance(pattern: str, text: str) -> int:
        """Fewest edits of the pattern to some part of the text."""
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    scanner = license_scan.Scanner(license_scan.NOTICES)
    for k in range(40):
        notice = license_scan.NOTICES[k % len(license_scan.NOTICES)]
        chars = list(notice.words)
        for _ in range(rng.randrange(0, notice.edits + 3)):
            at = rng.randrange(len(chars))
            chars[at] = rng.choice(["", "x", chars[at] + "q"])
        text = " ".join(license_scan.words_of(prose(8, k) + " " + "".join(chars) + " " + prose(8, k + 50))
                        and [w.decode() for w in license_scan.words_of(prose(8, k) + " " + "".join(chars) + " " + prose(8, k + 50))])
        near = [n for n in license_scan.NOTICES if distance(n.words, text) <= n.edits]
        found = scanner.scan(text)
        assert bool(near) == bool(found["spans"])
        if near:
            best = max(1 - distance(n.words, text) / len(n.words) for n in near)
            assert found["score"] in (1.0, pytest.approx(best))


KEY = "Zk9fQ2mX7vLpT4bR8sWc1ABu"


def test_allowed_parts_hide_no_secret_beside_them(spark):
    """A secret joined to an allowed word, or in short groups, is found; allowed strings alone are not."""
    secrets = [KEY, f"example/{KEY}", f"{KEY}_placeholder", KEY[:12] + "0000" + KEY + "xxxx", "x7k2q9m4-zt81vb60p-3q9wl5k2x-8n1c4r7",
               f"123e4567-e89b-12d3-a456-426614174000/{KEY}"]
    plain = ["123e4567-e89b-12d3-a456-426614174000", "some-long-identifier-of-words-2024", "path/to/example/placeholder/12345678",
             "release-2024-10-notes-and-more-words", "0000000000000000000000000000", "AnotherVeryLongCamelCaseName123456"]
    texts = [f"key {x} end" for x in (*secrets, *plain)]
    found = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.added] for r in found.collect()}
    for i, text in enumerate(texts):
        want = brute.entropy_spans(text, secret_scan.CLASSES, secret_scan.ALLOW, secret_scan.ALLOWED_PARTS)
        assert got[i] == [text[a:b] for a, _, _, b in want], text
        assert bool(got[i]) == (i < len(secrets)), text
    assert all(KEY in "".join(got[i]) for i in (0, 1, 2, 3, 5))
