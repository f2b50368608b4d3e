"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share all words by weight, no source above ``MAX_EPOCHS`` times its own words. Each
source's documents are shuffled by a hash, laid end to end, and cut into blocks of (almost) equal
word counts. Slot n of the schedule takes the point frac(n * golden ratio); the source whose
interval of cumulative weight holds the point owns the slot, and the slot's rank within its
source names the block, round after round. Ranks beyond a source's quota are dropped, and quotas
that the schedule has not filled are filled behind it, so that every source meets its target to
within half a block.

Running sums within a source go over hash buckets: inside a bucket by a window, between buckets
over one row per bucket. So a source that holds most rows is never one task's load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Words of a block at most; and a source's target has about this many blocks, if it has as many words.
MAX_BLOCK_WORDS = 65_536
BLOCKS_PER_TARGET = 1_024
#: Fixed layout of running sums and of the schedule; neither depends on the data.
BUCKETS = 4_096
SLOTS_PER_CHUNK = 8_192
CELLS = 1_024
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size in words, and a shuffling hash ``h`` that tells texts of equal ids apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text)).alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources fill like vessels of width ``weight`` and capacity ``max_epochs * source_size``: in the
    order of capacity over weight, a source is full if the level that would hold the rest of all
    words lies above it. Windows without a key run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rank = F.row_number().over(order) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                (rank % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"))
    level = (F.col("total") - F.col("full")) / F.col("open")
    per = per.withColumn("level", level).withColumn(
        "fits", F.col("cap") > F.col("level") * F.col("weight"))
    # The first source that is not full fixes the level of all behind it.
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    share = F.least(F.col("cap"), first["level"] * F.col("weight"))
    return per.select("source", "source_size", "weight",
                      F.coalesce(share, F.col("cap")).alias("target"))


def plan(per_source: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """targets() with each source's number of ``blocks`` and ``quota`` of slots, and its interval."""
    words = F.col("source_size")
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(float(MAX_BLOCK_WORDS)),
                                            F.col("target") / BLOCKS_PER_TARGET))
    frame = per_source.withColumn("blocks", F.when(words > 0, F.greatest(
        F.lit(1), F.least(words, F.ceil(words / wanted)))).otherwise(0).cast("long"))
    frame = frame.withColumn("quota", F.when(words > 0, F.least(
        F.round(F.col("target") * F.col("blocks") / words), max_epochs * F.col("blocks")))
        .otherwise(0).cast("long"))
    whole = Window.partitionBy(F.lit(0))
    upto = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(
        Window.unboundedPreceding, 0)
    frame = frame.withColumn("slots", F.sum("quota").over(whole)).withColumn(
        "behind", F.sum("quota").over(upto))
    return frame.withColumn("low", (F.col("behind") - F.col("quota")) / F.col("slots")).withColumn(
        "high", F.col("behind") / F.col("slots"))


def schedule(planned: DataFrame) -> DataFrame:
    """slot, source, rank, block: the order in which blocks are read.

    ``planned`` is a written table with one row per source.
    """
    spark = planned.sparkSession
    n = planned.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    owners = planned.where("quota > 0").select("source", "quota", "blocks", "low", "high", F.explode(
        F.sequence(F.floor(F.col("low") * CELLS).cast("int"),
                   F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", point).withColumn(
        "cell", F.floor(F.col("u") * CELLS).cast("int"))
    dealt = slots.join(owners, "cell").where("u >= low AND u < high").withColumn(
        "chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK))
    key = ["source", "chunk"]
    counts = dealt.groupBy(*key).agg(F.count("*").alias("in_chunk"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("in_chunk").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).alias("d").join(
        counts.alias("c"), F.expr("d.source <=> c.source AND d.chunk = c.chunk")).selectExpr(
        "d.slot", "d.source", "d.quota", "d.blocks", "c.ahead + d.inside AS rank")
    kept = ranked.where("rank < quota")
    got = counts.groupBy("source").agg(F.sum("in_chunk").alias("got"))
    # What the points have left open goes behind the schedule, source by source.
    short = planned.where("quota > 0").alias("p").join(
        got.alias("g"), F.expr("p.source <=> g.source"), "left").selectExpr(
        "p.source", "p.blocks", "p.quota", "p.behind", "coalesce(g.got, 0L) AS got").where("got < quota")
    fill = short.select("source", "blocks", (F.lit(n) + F.col("behind")).alias("base"), "quota",
                        F.explode(F.expr("sequence(got, quota - 1)")).alias("rank")).selectExpr(
        "base - quota + rank AS slot", "source", "blocks", "rank")
    return kept.select("slot", "source", "blocks", "rank").unionByName(
        fill.select("slot", "source", "blocks", "rank")).selectExpr(
        "slot", "source", "rank", "rank % blocks AS block")


def pieces(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """source, block, doc_id, h, words: the part of each document that lies in each block."""
    frame = sized.where("size > 0").groupBy("doc_id", "source", "h", "size").agg(
        F.count("*").alias("rows")).withColumn("bucket", F.expr(f"pmod(h, {BUCKETS})"))
    key = ["source", "bucket"]
    span = F.col("size") * F.col("rows")
    inside = Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("inside", F.coalesce(F.sum(span).over(inside), F.lit(0)))
    totals = sized.where("size > 0").groupBy("source", F.expr(f"pmod(h, {BUCKETS})").alias("bucket")).agg(
        F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    laid = frame.alias("d").join(totals.alias("t"), F.expr(
        "d.source <=> t.source AND d.bucket = t.bucket")).selectExpr(
        "d.doc_id", "d.source", "d.h", "d.size", "d.rows", "t.ahead + d.inside AS at")
    laid = laid.alias("d").join(planned.alias("p"), F.expr("d.source <=> p.source")).selectExpr(
        "d.doc_id", "d.source", "d.h", "d.size", "d.rows", "d.at", "p.blocks", "p.source_size AS whole",
        "d.at + d.size * d.rows AS stop")
    # Block b holds the words [b * whole div blocks, (b + 1) * whole div blocks).
    block = "((CAST({0} + 1 AS decimal(19,0)) * CAST(blocks AS decimal(18,0)) - 1) div whole)"
    parts = laid.withColumn("block", F.explode(F.expr(
        f"sequence({block.format('at')}, {block.format('(stop - 1)')})")))
    edge = "((CAST({0} AS decimal(19,0)) * CAST(whole AS decimal(18,0))) div blocks)"
    return parts.selectExpr(
        "source", "block", "doc_id", "h", "size", "rows", "at",
        f"least(stop, {edge.format('block + 1')}) - greatest(at, {edge.format('block')}) AS words").where("words > 0")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, h, size, source, source_size, target, taken for every row of ``docs``.

    Null texts have size 0; documents of size 0 and sources without words take nothing. Rows that
    repeat id, source and text share what is taken of their words evenly, the rest of the division
    going nowhere else: each gets the whole quotient and the count stays within one word a row.
    """
    sized = sizes(docs, seed)
    planned = written(plan(targets(sized)), "mix-plan")
    times = schedule(planned).groupBy("source", "block").agg(F.count("*").alias("times"))
    taken = pieces(sized, planned).alias("p").join(
        times.alias("t"), F.expr("p.source <=> t.source AND p.block = t.block")).groupBy(
        "p.doc_id", "p.source", "p.h", "p.rows").agg(F.sum(F.expr("p.words * t.times")).alias("words"))
    return sized.alias("d").join(planned.alias("s"), F.expr("d.source <=> s.source")).join(
        taken.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.source <=> k.source AND d.h = k.h"),
        "left").selectExpr(
        "d.doc_id", "d.h", "d.size", "d.source", "s.source_size", "s.target",
        "coalesce(k.words div k.rows, 0L) AS taken")


def copies(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` as the mix holds it: each row as often as its words are taken, to the nearest whole
    number of times. Columns stay; documents without words go."""
    taken = mix(docs, seed).where("size > 0").groupBy("doc_id", "source", "h").agg(
        F.max(F.expr("CAST(round(taken / size) AS int)")).alias("times")).where("times > 0")
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(
        F.lit(seed), F.col("doc_id"), F.xxhash64(text)).alias("h")).alias("d")
    held = frame.join(taken.alias("t"), F.expr(
        "d.row.doc_id <=> t.doc_id AND d.row.source <=> t.source AND d.h = t.h"))
    return held.withColumn("time", F.explode(F.expr("sequence(1, times)"))).select("row.*")
