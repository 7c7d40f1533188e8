"""Mixing sources to target weights, DataFrame functions only.

1. Targets: each source gets its weight's share of all words, at most CAP times
   its own size; the excess goes to the others by weight (water filling, in
   closed form over the sources sorted by size over weight).
2. Block quotas: a source's documents stand in the order of a hash of their id, a
   random permutation that every run repeats. The source is a stream of words in
   that order, read from the start again where the target exceeds its size. It is
   cut into permuted blocks of BLOCK words; a source's quota is the number of
   blocks that its target needs, the last of them cut at the target.
3. Splitting tree: the vector of all sources' block quotas is split in two, a
   multivariate hypergeometric draw, and each half again, down to the output
   shards. A leaf's numbers say how many of the next blocks of every source its
   shard draws; no two shards draw the same block.
4. What a document gives is what the shards' blocks take of it: its draws are
   (epoch, shard, words), a document across a border between two shards gives to
   both. Nothing else decides taken. With whole, of what a document gives in an epoch
   at least half its words make it taken whole, by the shard of the first of them;
   less, and it is left. Each shard orders its draws by another hash.

There are about SHARD_WORDS words to a shard, between LEAST_SHARDS and MOST_SHARDS
shards; a larger one is written in as many parts as that takes (draw_rows). The
tree's draws are inverse-CDF draws from a hash of (seed, node, source), within ten
standard deviations around the mean. One row per source, and one per node of the
tree with a number per source, is all that is ever gathered; a source's documents
are dealt by hash bucket, and a bucket with repeated or null ids by text.

Edge cases: null text has size 0 and is taken 0 times; a source of size 0 has
target 0. A null source is a source, last in order. Repeated rows each count.
With no words at all every target is 0. An empty table gives an empty result.
Extra columns pass through unless they are named like one of the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.shared import join_groups, n_words, running_sum, stash

CAP = 3
BLOCK = 1024
SHARD_WORDS = 1 << 24
LEAST_SHARDS, MOST_SHARDS = 16, 256
#: Up to so many sources, of at most 6 KB each, are broadcast.
BROADCAST_SOURCES = 1000
WEIGHTS = (1, 2, 3)
#: From this level on the tree's nodes are worked on by several tasks.
SPREAD_LEVEL = 5


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds weight and target."""
    everything = Window.partitionBy()
    # NULL sorts after any name; the number of sources is small
    numbered = sizes.withColumn("_i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    w = numbered.select("source", "source_size", weight.cast("double").alias("weight"), "_i")
    order = everything.orderBy(F.col("source_size") / F.col("weight"), "_i")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # level: words per unit of weight if exactly the sources before this one are capped
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    w = w.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") <= cap * F.col("source_size"))
    final = F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("weight"), F.col("_i"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.least(final * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return w.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _unit(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash of parts: 52 bits of their MD5."""
    said = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _log_factorial(n: Column) -> Column:
    x = n + 5.0  # Stirling's series of the gamma function, shifted
    gamma = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return gamma - F.log((n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0))


def hypergeometric(total: Column, good: Column, draws: Column, unit: Column) -> Column:
    """How many of draws, without replacement out of total of which good are marked, are marked; unit in [0, 1)."""
    t, g, d = (c.cast("double") for c in (total, good, draws))
    mean = F.when(t > 0, d * g / t).otherwise(0.0)
    sd = F.sqrt(F.when(t > 1, mean * (1 - g / t) * (t - d) / (t - 1)).otherwise(0.0))
    least = F.greatest(F.lit(0.0), d + g - t)
    most = F.least(d, g)
    lo = F.greatest(least, F.floor(mean - 10 * sd - 2))
    hi = F.least(most, F.ceil(mean + 10 * sd + 2))
    choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        p = F.exp(choose(g, x) + choose(t - g, d - x) - choose(t, d))
        return F.struct((acc["cum"] + p).alias("cum"), F.when(acc["cum"] <= unit, x).otherwise(acc["x"]).alias("x"))

    found = F.aggregate(F.sequence(lo.cast("long"), hi.cast("long")), F.struct(F.lit(0.0).alias("cum"), lo.cast("double").alias("x")), step)
    return F.greatest(least, F.least(most, found["x"])).cast("long")


def splitting_tree(quotas: DataFrame, shards: int = LEAST_SHARDS, seed: int = 7) -> DataFrame:
    """quotas: (source_key, blocks). Returns source_key, runs: array of (shard, first, end), the blocks [first, end) of the source that each shard draws.

    shards is a power of two. Each node of the tree is a row that holds the quota
    vector over the sources. Shards without a block of the source are left out.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source_key", "blocks"))).alias("q")).withColumn("shard", F.lit(0))
    levels = int(math.log2(shards))
    if 2**levels != shards:
        raise ValueError("shards must be a power of two")
    state = "struct<total:bigint,draws:bigint,out:array<struct<source_key:string,blocks:bigint>>>"
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        nodes = nodes.withColumn("_total", total)
        start = F.struct(F.col("_total").alias("total"), F.expr("_total div 2").alias("draws"), F.array().cast("array<struct<source_key:string,blocks:bigint>>").alias("out")).cast(state)

        def step(acc: Column, x: Column) -> Column:
            unit = _unit(seed, level, F.col("shard"), x["source_key"])
            got = hypergeometric(acc["total"], x["blocks"], acc["draws"], unit)
            return F.struct(
                (acc["total"] - x["blocks"]).alias("total"),
                (acc["draws"] - got).alias("draws"),
                F.concat(acc["out"], F.array(F.struct(x["source_key"].alias("source_key"), got.alias("blocks")))).alias("out"),
            ).cast(state)

        left = F.aggregate("q", start, step)["out"]
        nodes = nodes.withColumn("_left", left)
        right = F.zip_with("q", "_left", lambda a, b: F.struct(a["source_key"].alias("source_key"), (a["blocks"] - b["blocks"]).alias("blocks")))
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("q")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.shard", "h.q")
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition(2**level, "shard")
    leaves = nodes.select("shard", F.explode("q").alias("x")).select("shard", "x.source_key", "x.blocks")
    by_source = leaves.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("s"))
    state = "struct<at:bigint,out:array<struct<shard:int,first:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<shard:int,first:bigint,end:bigint>>").alias("out")).cast(state)

    def lay(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["blocks"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["shard"].alias("shard"), acc["at"].alias("first"), end.alias("end")))).alias("out")).cast(state)

    return by_source.select("source_key", F.filter(F.aggregate("s", start, lay)["out"], lambda x: x["end"] > x["first"]).alias("runs"))


def n_shards(words: int) -> int:
    """A power of two, so that a shard has about SHARD_WORDS."""
    return min(MOST_SHARDS, max(LEAST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, words) / SHARD_WORDS)))))


RESULTS = ("size", "source_size", "target", "taken", "draws")


def mix(docs: DataFrame, *, shards: int | None = None, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, whole: bool = False, keep_text: bool = True) -> DataFrame:
    """Every row of docs with size, source_size, target, taken and draws: array of (epoch, shard, words, position).

    taken is the sum of the draws' words. position orders a shard's draws.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.drop(*RESULTS).withColumns({"size": n_words(F.col("text")), "_key": key, "_h": h, "_t": F.xxhash64("text")})
    # texts are read once; without them all that follows works on a few numbers for each row
    rows = stash(rows if keep_text else rows.drop("text"), "mixing-rows")
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    name = F.when(F.substring("_key", 1, 1) == "s", F.expr("substring(_key, 2)"))
    targets = source_targets(sizes.select(name.alias("source"), "source_size"), weights, cap)
    targets = targets.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    targets = stash(targets.withColumn("_goal", F.floor(F.col("target") + 0.5).cast("long")), "mixing-targets")
    seen = targets.agg(F.count("*").alias("n"), F.coalesce(F.sum("_goal"), F.lit(0)).alias("words")).first()
    shards = shards or n_shards(seen["words"])
    tree = splitting_tree(targets.select("source_key", F.ceil(F.col("_goal") / block).cast("long").alias("blocks")), shards, seed)
    # in words of the stream; the last block of a source is cut at its goal
    runs = F.transform("runs", lambda x: F.struct(x["shard"].alias("shard"), (x["first"] * block).alias("first"), F.least(x["end"] * block, F.col("_goal")).alias("end")))
    plan = targets.join(tree, "source_key").select(F.col("source_key").alias("_key"), "source_size", "target", runs.alias("_runs"))
    plan = stash(plan.join(sizes.select("_key", "n_rows"), "_key"), "mixing-plan")

    rows = running_sum(rows, ["_key"], "_h", ["_t"], "size", "_start")
    rows = rows.join(F.broadcast(plan.drop("n_rows")), "_key") if seen["n"] <= BROADCAST_SOURCES else join_groups(rows, plan, "_key", rows.count())

    def draw(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("_start")
        to = at + F.col("size")
        met = F.filter("_runs", lambda x: (x["first"] < to) & (x["end"] > at))
        gives = F.transform(met, lambda x: F.struct(
            epoch.cast("int").alias("epoch"),
            x["shard"].alias("shard"),
            (F.least(x["end"], to) - F.greatest(x["first"], at)).alias("words"),
            F.xxhash64(F.lit(seed + 1), F.col("_h"), F.col("_t"), epoch).alias("position"),
        ))
        if not whole:
            return gives
        words = F.aggregate(gives, F.lit(0).cast("long"), lambda a, d: a + d["words"])
        once = F.transform(F.slice(gives, 1, 1), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.col("size").alias("words"), d["position"].alias("position")))
        return F.filter(once, lambda d: 2 * words >= d["words"])

    none = F.array().cast("array<struct<epoch:int,shard:int,words:bigint,position:bigint>>")
    all_epochs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long")), draw))
    rows = rows.withColumn("draws", F.when(F.col("size") > 0, all_epochs).otherwise(none))
    rows = rows.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    mixed = rows.drop("_key", "_h", "_t", "_start", "_runs")
    mixed.shards, mixed.words = shards, seen["words"]
    return mixed


def draw_rows(mixed: DataFrame) -> DataFrame:
    """One row per draw, its text cut to the drawn words, in shard order; mixed is what mix() returned.

    A partition has one shard's draws, or a part of them by position where the shard
    has over SHARD_WORDS. A document that gives to two shards gives each its own words.
    """
    columns = [c for c in mixed.columns if c not in RESULTS]
    parts = max(1, math.ceil(mixed.words / mixed.shards / SHARD_WORDS))
    before = lambda i: F.aggregate(F.filter(F.slice("draws", F.lit(1), i), lambda d: d["epoch"] == F.col("draws")[i]["epoch"]), F.lit(0).cast("long"), lambda a, d: a + d["words"])
    skips = F.transform("draws", lambda d, i: F.struct(d.alias("d"), before(i).alias("skip")))
    d = mixed.select(*columns, "size", F.explode(skips).alias("_s")).select(*columns, "size", F.col("_s.d").alias("_d"), F.col("_s.skip").alias("_skip"))
    part = (F.col("_d.shard") * parts + F.pmod("_d.position", F.lit(parts))).cast("int")
    d = d.repartitionById(mixed.shards * parts, part).sortWithinPartitions("_d.shard", "_d.position", "_d.epoch")
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    drawn = F.array_join(F.slice(words, (F.col("_skip") + 1).cast("int"), F.col("_d.words").cast("int")), "")
    cut = F.when(F.col("_d.words") < F.col("size"), drawn).otherwise(F.col("text"))
    return d.select(*[cut.alias(c) if c == "text" else F.col(c) for c in columns], F.col("_d.epoch").alias("epoch"), F.col("_d.shard").alias("shard"))
