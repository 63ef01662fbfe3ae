"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A text is cut into blocks of `block` words. A source's target is met by whole passes over all its blocks and a rest drawn without replacement. Each
document belongs to one of `shards` output shards by a keyed hash, so a source has one pool of blocks a shard. The rest's quota, which counts the words of
blocks, is split recursively: a node hands its left half a hypergeometric share, given the words of the pools on both sides. So the quotas of a source are one
multivariate-hypergeometric draw, no quota exceeds its pool, and their sum is the rest to a word. A shard draws its quota from its own
pool: the blocks are permuted by a keyed hash and the first ones taken, the last of them in part. Pools are disjoint, hence the draws are. `emit` writes
each shard's documents together, in an order shuffled within the shard.

Ranks in the permuted order need no global sort: blocks fall into buckets of about `bucket_blocks`, a window ranks within (source, shard, bucket), and
per-bucket sums place the buckets, so one hot source is spread like all others.

Defined cases: null text or no words: size 0, never taken; null source: a source of its own, sorted last; repeated rows (same id, text and source) are
rows of their own and share evenly what their blocks drew; an empty table gives no rows. Sources are listed on the driver to share out the targets, at most
`max_sources` of them, else ValueError; quotas are split in the tasks.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, discard, materialise, only, word_count

WEIGHTS = (1, 2, 3)
LIMIT = 3
SALTS = 64


@dataclass(frozen=True)
class Plan:
    source: str | None
    size: int
    target: float
    passes: int
    rest: int


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> list[Plan]:
    """Targets that share the sum of all sizes by weight; none is above `limit` times its source's size.

    Sources in code point order, null last, take the weights in turn.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = [(source, size, weights[i % len(weights)]) for i, (source, size) in enumerate(ordered)]
    left, weight, target = float(sum(sizes_ for _, sizes_, _ in rows)), float(sum(w for *_, w in rows)), {}
    for i in sorted(range(len(rows)), key=lambda i: (limit * rows[i][1] / rows[i][2], i)):
        _, size, w = rows[i]
        target[i] = min(float(limit * size), left * w / weight) if weight else 0.0
        left, weight = left - target[i], weight - w
    out = []
    for i, (source, size, _) in enumerate(rows):
        words = min(round(target[i]), limit * size)
        out.append(Plan(source, size, target[i], words // size if size else 0, words % size if size else 0))
    return out


def _log_factorial_step(x: int, y: int) -> float:
    """log(x!) - log(y!) less (x - y) log(y): precise for large numbers that lie close."""
    if min(x, y) < 50:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - ((x - y) * math.log(y) if y else 0.0)
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (x + 0.5) * math.log1p((x - y) / y) - (x - y) + tail(x) - tail(y)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good, by that law at every size: few draws one by one, others by ratio of uniforms (Stadlober 1990) against the exact ratio of probabilities."""
    if draws > (good + bad) // 2:
        return good - hypergeometric(rng, good, bad, good + bad - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if not good or not draws:
        return 0
    if draws <= 32:
        n = 0
        for _ in range(draws):
            hit = rng.randrange(good + bad) < good
            n, good, bad = n + hit, good - hit, bad - (not hit)
        return n
    total, most = good + bad, min(good, draws)
    mean = draws * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (draws + 1) * (good + 1) // (total + 2)
    parts = lambda k: (k, good - k, draws - k, bad - draws + k)
    at_mode = parts(mode)

    def log_ratio(k: int) -> float:
        """log P(k) - log P(mode)."""
        d = k - mode
        a, b, c, e = at_mode
        lead = sum((x - y) * math.log(y) for x, y in zip(parts(k), at_mode, strict=True) if y) if min(at_mode) < 50 else d * math.log1p((a * e - b * c) / (b * c))
        return -lead - sum(_log_factorial_step(x, y) for x, y in zip(parts(k), at_mode, strict=True))

    while True:
        u = 1.0 - rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if 0 <= k <= most and 2 * math.log(u) <= log_ratio(k):
            return k


def split_quota(quota: int, pools: list[int], rng: random.Random) -> list[int]:
    """The splitting tree: what each pool gives of a draw of `quota` without replacement from all pools."""
    if len(pools) == 1:
        return [quota]
    half = len(pools) // 2
    left = hypergeometric(rng, sum(pools[:half]), sum(pools[half:]), quota)
    return split_quota(left, pools[:half], rng) + split_quota(quota - left, pools[half:], rng)


def row_key(docs: DataFrame) -> Column:
    """One hash for rows of the same id, text and source (a null source is hashed as no value)."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), docs["source"].cast("string"))


def plan_sources(sized: DataFrame, max_sources: int = 100_000) -> list[Plan]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return water_fill([(r["source"], int(r["size"])) for r in rows])


def plan_frame(spark, plans: list[Plan]) -> DataFrame:
    """The plans, at most max_sources rows of some 60 bytes."""
    return spark.createDataFrame([(p.source, p.size, p.target, p.passes, p.rest) for p in plans], "source string, source_size long, target double, passes long, rest long")


def with_plan(df: DataFrame, plans: list[Plan]) -> DataFrame:
    frame = plan_frame(df.sparkSession, plans).withColumnRenamed("source", "p_source")
    frame = F.broadcast(frame) if len(plans) <= 20_000 else frame
    return df.join(frame, df["source"].eqNullSafe(frame["p_source"])).drop("p_source")


def quotas(pools: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shard, quota. pools: source, shard, pool (words) and rest (the source's); a source's pools meet in one row of `shards` numbers."""

    @F.pandas_udf("array<long>")
    def split(sources: pd.Series, rests: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([split_quota(int(rest), [int(x) for x in row], random.Random(f"{seed}:{source}")) for source, rest, row in zip(sources, rests, rows, strict=True)])

    by_shard = F.map_from_entries(F.collect_list(F.struct("shard", "pool")))
    rows = pools.groupBy("source").agg(F.max("rest").alias("rest"), by_shard.alias("pools"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("pools", i), F.lit(0).cast("long")))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return rows.select("source", F.posexplode(split(name, "rest", filled)).alias("shard", "quota"))


def mix(docs: DataFrame, block: int = 512, shards: int = 64, seed: int = 7, bucket_blocks: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: row_key, doc_id, size, source, source_size, target, passes, rest, shard, salt; one row per row of `docs`.
    draws: row_key, source, shard, block, words (all words of the block), taken (words of it drawn beyond the whole passes).
    """
    src = only(docs, doc_id="doc_id", source="source", text="text").withColumn("source", F.col("source").cast("string"))
    sized = materialise(src.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(src).alias("row_key"), salt().alias("salt")), "mix-sizes")
    plans = plan_sources(sized)
    shard = F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(shards)).cast("int")
    documents = with_plan(sized, plans).withColumn("shard", shard)
    some = documents.where("rest > 0 and size > 0")
    pools = some.groupBy("source", "shard").agg(F.sum("size").alias("pool"), F.max("rest").alias("rest"))
    split = materialise(quotas(pools, shards, seed).where("quota > 0"), "mix-quotas").select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "quota")
    cut = some.select("row_key", "source", "shard", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
    n = max(1, sum(-(-p.size // block) for p in plans) // (shards * bucket_blocks))
    key = F.xxhash64(F.lit(seed + 1), "row_key", "block")
    cut = cut.select("row_key", "source", "shard", "block", F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block).alias("words"), key.alias("key"), F.pmod(key, F.lit(n)).alias("bucket"))
    # Words of the pool before a block: those of the buckets before its own, and those before it in its bucket.
    sums = cut.groupBy("source", "shard", "bucket").agg(F.sum("words").alias("w"))
    before = Window.partitionBy("source", "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("shard").alias("h"), F.col("bucket").alias("b"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    order = Window.partitionBy("source", "shard", "bucket").orderBy("key", "row_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("w1", F.coalesce(F.sum("words").over(order), F.lit(0)))
    placed = within.join(sums, within["source"].eqNullSafe(sums["s"]) & (within["shard"] == sums["h"]) & (within["bucket"] == sums["b"]))
    placed = placed.join(split, placed["source"].eqNullSafe(split["q_source"]) & (placed["shard"] == split["q_shard"]))
    left = F.col("quota") - F.col("w0") - F.col("w1")
    draws = placed.where(left > 0).select("row_key", "source", "shard", "block", "words", F.least("words", left).alias("taken"))
    return documents, materialise(draws, "mix-draws")


def salt() -> Column:
    """By which rows that are alike in all else are told apart; to be written before it is used twice."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")


def numbered(rows: DataFrame, key: str, salted: str) -> DataFrame:
    """`rows` with __i, 1 and up among the rows of a key. These meet by (key, salt), so that one row that is repeated any number of times is spread over SALTS tasks."""
    counts = rows.groupBy(key, salted).agg(F.count("*").alias("c"))
    before = Window.partitionBy(key).orderBy(salted).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("k"), F.col(salted).alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    ranked = rows.withColumn("__row", F.row_number().over(Window.partitionBy(key, salted).orderBy(salted)))
    return ranked.join(starts, (ranked[key] == starts["k"]) & (ranked[salted] == starts["s"])).withColumn("__i", F.col("start") + F.col("__row")).drop("k", "s", "start", "__row")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken. Rows that repeat an id and a text share out what their blocks drew evenly, the first of them the remainder."""
    documents, draws = mix(docs, **options)
    extra = draws.groupBy("row_key").agg(F.sum("taken").alias("extra"))
    drawn = documents.groupBy("row_key").agg(F.count("*").alias("n")).join(extra, "row_key", "left")
    drawn = materialise(drawn.select(F.col("row_key").alias("k"), "n", F.coalesce("extra", F.lit(0)).alias("extra")), "mix-drawn")
    joined = documents.join(drawn, documents["row_key"] == drawn["k"])
    columns = ["doc_id", "source", "size", "source_size", "target", "passes", "n", "extra"]
    once, repeated = joined.where("n = 1").select(*columns, F.lit(1).cast("long").alias("__i")), numbered(joined.where("n > 1"), "row_key", "salt").select(*columns, "__i")
    share = F.floor(F.col("extra") / F.col("n")) + (F.col("__i") <= F.col("extra") % F.col("n")).cast("long")
    return once.unionAll(repeated).select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + share).alias("taken"))


def emit(docs: DataFrame, shards: int = 64, block: int = 512, seed: int = 7, **options) -> DataFrame:
    """The mix as documents, with the columns of `docs`: each whole pass gives a copy of the row, and what was drawn beyond gives one more, the whole text or the words of its drawn blocks.

    Rows that repeat an id and a text share out the words of each drawn block evenly. Rows whose source the mix leaves out are gone. The output's partitions are sets of
    shards; within a shard the order is shuffled.
    """
    documents, draws = mix(docs, block, shards, seed, **options)
    parts = draws.groupBy("row_key", "block").agg(F.sum("taken").alias("taken"))
    parts = parts.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("block", "taken"))).alias("__mix_parts"))
    plan = documents.groupBy("row_key").agg(F.max("passes").alias("__mix_passes"), F.max("size").alias("__mix_size"), F.max("shard").alias("__mix_shard"), F.count("*").alias("__mix_n"))
    plan = materialise(plan.join(parts, "row_key", "left").withColumnRenamed("row_key", "__mix_key").where("__mix_passes > 0 or __mix_parts is not null"), "mix-plan")
    discard(draws)
    keyed = docs.withColumn("__mix_key", row_key(docs))
    again = materialise(plan.where("__mix_n > 1"), "mix-again")
    once = keyed.join(plan.where("__mix_n = 1").hint("shuffle_hash"), "__mix_key").withColumn("__mix_i", F.lit(1).cast("long"))
    repeated = materialise(keyed.join(again, "__mix_key").withColumn("__mix_salt", salt()), "mix-repeated")
    joined = once.unionByName(numbered(repeated, "__mix_key", "__mix_salt").withColumnRenamed("__i", "__mix_i").drop("__mix_salt"))
    own = lambda p: F.floor(p["taken"] / F.col("__mix_n")) + (F.col("__mix_i") <= p["taken"] % F.col("__mix_n")).cast("long")
    drawn = F.coalesce(F.aggregate("__mix_parts", F.lit(0).cast("long"), lambda t, p: t + own(p)), F.lit(0))
    word_list = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    picked = F.flatten(F.transform("__mix_parts", lambda p: F.slice(word_list, (p["block"] * block + 1).cast("int"), own(p).cast("int"))))
    rest = F.when(F.col("__mix_drawn") >= F.col("__mix_size"), F.col("text")).when(F.col("__mix_drawn") > 0, F.array_join(picked, " "))
    texts = F.filter(F.concat(F.array_repeat(F.col("text"), F.col("__mix_passes").cast("int")), F.array(rest)), lambda t: t.isNotNull())
    copies = joined.withColumn("__mix_drawn", drawn).select("*", F.posexplode(texts).alias("__mix_copy", "__mix_text"))
    place = F.xxhash64(F.lit(seed + 2), "__mix_key", "__mix_copy", "__mix_i")
    columns = [F.col("__mix_text").alias("text") if c == "text" else F.length("__mix_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    out = copies.select(*columns, "__mix_shard", place.alias("__mix_place"))
    return out.repartition(shards, "__mix_shard").sortWithinPartitions("__mix_shard", "__mix_place").drop("__mix_shard", "__mix_place")
