"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document's statistics are transformed to a short vector. For every group the minimum
covariance determinant estimate is found by concentration steps: the ``SHARE`` of rows nearest to
the present centre give the next centre and covariance. A document whose Mahalanobis distance
from its group's estimate is beyond the limit is rejected. Groups are (language, source); a
document of a group with fewer than ``MIN_GROUP`` rows is judged by its language, or else by all
documents, and by the fixed limits alone if even those are fewer.

All steps run over all rows: medians and cut-offs from counts of bins, moments from sums, both
combined before they are shuffled, so that a group holding most rows is no single task's load.
Vector entries are whole numbers of 1/4096, which keeps sums exact and reruns equal.

Null texts count as empty, null languages and sources are groups of their own, repeated rows are
judged each, empty tables give empty results, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.llm.common import (over_batches, range_hashes, shingle_hashes, utf8, words,
                                   written)

#: Symbols counted, words of a window, and the base limits.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20

FEATURES = ("f_words", "f_length", "f_symbols", "f_marks", "f_upper", "f_lines")
#: The least standard deviation of each feature, so that a constant feature rejects nothing nearby.
FLOORS = (0.5, 0.5, 0.05, 0.1, 0.05, 0.4)
UNIT = 4096
SHARE = 0.75
STEPS = 3
MIN_GROUP = 200
#: Squared distance beyond which a document is an outlier. Far in the tail, since groups are
#: mixtures and no text is to be lost that merely has unusual length or punctuation.
LIMIT = 80.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True

SCHEMA = ("doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
          "n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def repeated_words(hashes: np.ndarray) -> int:
    """Words covered by windows that occur twice or more."""
    if len(hashes) <= WINDOW:
        return 0
    windows = shingle_hashes(hashes, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    repeated = np.zeros(len(windows) + 1, np.int32)
    repeated[order[1:][same]] = 1
    repeated[order[:-1][same]] = 1
    total = np.concatenate([[0], np.cumsum(repeated[:-1])])
    at = np.arange(len(hashes))
    return int((total[np.minimum(at + 1, len(windows))] > total[np.maximum(at - WINDOW + 1, 0)]).sum())


def statistics(text: str | None) -> tuple:
    """The base counts and the transformed vector of one text."""
    data = utf8(text)
    starts, ends = words(data)
    n = len(starts)
    n_bytes = int((ends - starts).sum())
    continued = int(((data & 0xC0) == 0x80).sum())
    chars = n_bytes - continued
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = int(_SYMBOL[data].sum())
    marks, upper = int(_MARK[data].sum()), int(_UPPER[data].sum())
    some = max(chars, 1)
    vector = (np.log1p(n), chars / max(n, 1), np.sqrt(symbols / some), np.sqrt(marks / some),
              np.sqrt(upper / some), np.log1p(n / max(len(lines), 1)))
    return (n, chars, symbols, len(lines) - len(set(lines)),
            repeated_words(range_hashes(data, starts, ends)),
            *(float(round(x * UNIT)) for x in vector))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the vector of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(statistics, batch.column("text").to_pylist()), strict=True))
        types = [pa.int64()] * 5 + [pa.float64()] * len(FEATURES)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "lang", "source")),
             *(pa.array(r, t) for r, t in zip(rows, types, strict=True))],
            [c.split()[0] for c in SCHEMA.split(", ")])

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
                                    "text"), run, SCHEMA)


def _levels(stats: DataFrame) -> DataFrame:
    """Every row under its group, its language and all documents."""
    def key(*parts):
        return F.to_json(F.struct(*(F.coalesce(F.to_json(F.struct(p)), F.lit("")).alias(p) for p in parts)))
    return stats.select(*FEATURES, F.explode(F.array(
        F.concat(F.lit("2"), key("lang", "source")), F.concat(F.lit("1"), key("lang")),
        F.lit("0"))).alias("key"))


def _start(levels: DataFrame) -> DataFrame:
    """key, n, centre (medians) and inverse (of squared scales) from counts of bins."""
    bins = [np.float64(f * UNIT / 8) for f in FLOORS]
    long = levels.select("key", F.posexplode(F.array(*(
        F.floor(F.col(f) / float(b)) for f, b in zip(FEATURES, bins, strict=True)))).alias("i", "bin"))
    counts = long.groupBy("key", "i", "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("key", "i").orderBy("bin")
    whole = Window.partitionBy("key", "i")
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(whole))
    def at(q):
        return F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("bin")))
    width = F.element_at(F.array(*(F.lit(float(b)) for b in bins)), F.col("i") + 1)
    floor = F.element_at(F.array(*(F.lit(f * UNIT) for f in FLOORS)), F.col("i") + 1)
    per = ranked.groupBy("key", "i").agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"),
                                         at(0.75).alias("q3"))
    per = per.select("key", "n", "i", ((F.col("q2") + 0.5) * width).alias("centre"),
                     F.greatest(floor, (F.col("q3") - F.col("q1") + 1) * width / 1.349).alias("scale"))
    rows = per.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(
        F.struct("i", "centre", "scale"))).alias("v"))
    p = len(FEATURES)
    inverse = F.flatten(F.array(*(F.array(*((1 / F.col("v")[i]["scale"] ** 2) if i == j else F.lit(0.0)
                                            for j in range(p))) for i in range(p))))
    return rows.select("key", "n", F.transform("v", lambda x: x["centre"]).alias("centre"),
                       inverse.alias("inverse"))


def _distance() -> F.Column:
    p = len(FEATURES)
    d = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + (1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[i * p + j]
    return total


def _concentrate(levels: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimate from the SHARE of rows nearest to the present one."""
    p = len(FEATURES)
    near = levels.join(estimate.select("key", "n", "centre", "inverse"), "key").withColumn(
        "bin", F.ceil(F.log2(F.greatest(_distance(), F.lit(1e-6))) * 16))
    counts = near.groupBy("key", "bin").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("key").orderBy("bin"))
    cut = counts.withColumn("upto", upto).where(F.col("upto") >= F.col("n") * SHARE).groupBy("key").agg(
        F.min("bin").alias("cut"), F.max("n").alias("all"))
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}")
                for i in range(p) for j in range(i, p)]
    moments = near.join(cut, "key").where("bin <= cut").groupBy("key").agg(
        F.count("*").alias("m"), F.max("all").alias("n"), *sums, *products)

    def invert(frames):
        floors = np.diag((np.array(FLOORS) * UNIT) ** 2)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                centre = np.array([row[f"s{i}"] for i in range(p)]) / row["m"]
                cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                cov = cov / row["m"] - np.outer(centre, centre)
                out.append((row["key"], row["n"], centre.tolist(),
                            np.linalg.inv(CONSISTENCY * cov + floors).ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "n", "centre", "inverse"])

    return moments.mapInPandas(invert, "key string, n bigint, centre array<double>, inverse array<double>")


#: Makes the covariance of the nearest SHARE of normal rows estimate that of all (six features):
#: SHARE over the chi-squared distribution with two more degrees at the SHARE quantile.
CONSISTENCY = 1.40


def estimates(stats: DataFrame) -> DataFrame:
    """key, n, centre, inverse for every group, language and for all rows; a written table."""
    levels = _levels(stats)
    found = written(_start(levels), "quality-start")
    for step in range(STEPS):
        found = written(_concentrate(levels, found), f"quality-step{step}")
    return found


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """A row per document: base counts, base_failed, distance (null if not judged) and kept."""
    stats = written(measure(docs), "quality-statistics")
    found = estimates(stats).where(F.col("n") >= MIN_GROUP)

    def key(*parts):
        return F.to_json(F.struct(*(F.coalesce(F.to_json(F.struct(p)), F.lit("")).alias(p) for p in parts)))
    frame = stats.withColumn("k2", F.concat(F.lit("2"), key("lang", "source"))).withColumn(
        "k1", F.concat(F.lit("1"), key("lang"))).withColumn("k0", F.lit("0"))
    for k in ("k2", "k1", "k0"):
        frame = frame.join(found.select(F.col("key").alias(k), F.struct("centre", "inverse").alias(f"e_{k}")),
                           k, "left")
    frame = frame.withColumn("e", F.coalesce("e_k2", "e_k1", "e_k0")).withColumn(
        "centre", F.col("e.centre")).withColumn("inverse", F.col("e.inverse"))
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    return frame.withColumn("distance", _distance()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"), "distance")
