"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions only.

Per text: counts of words, word characters, symbols, repeated lines and words in repeated 8-word windows. Ratios of
them go into quantile sketches: histograms over integer bins (per mille, at most 1001 bins a ratio; mean lengths in tenths of a character, beyond 100 characters a thousand bins
a doubling), which merge by adding counts and are exact to a bin. Fences per (lang, source) come from the sketch's quartiles; a group of fewer than `min_group` texts is blended with its language, in
proportion to the texts it lacks, and a language with all texts. A join then filters.

Defined cases: null text: no words, fails the base rule; null lang or source: a group of their own; an empty table
gives no rows; repeated rows count each; windows are told apart by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, only

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Ratio in per mille -> the least value its upper fence may take. mean_len: word characters per ten words.
FLOORS = {"symbols": 100, "dup_lines": 300, "repeats": 200, "mean_len": 120}
#: Fences of fewer groups than this are broadcast (some 60 bytes a row).
BROADCAST_GROUPS = 20_000


def repeated_words(words: Column) -> Column:
    """Words covered by windows of 8 words that occur twice or more in `words`."""

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"])))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"))
        return F.aggregate(at, start, step)["n"]

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    some = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    src = only(docs, doc_id="doc_id", lang="lang", source="source", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    full = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    lines = let(full, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    of_words = let(F.filter(F.split("text", SPACES), lambda x: x != ""), lambda a: F.struct(F.size(a).cast("long").alias("n"), repeated_words(a).alias("rep")))
    return src.select(
        "doc_id",
        "lang",
        "source",
        of_words.alias("w"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
    ).select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def ratio(part: str, whole: str) -> Column:
    return F.least(F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))), F.lit(1000)).cast("long")


def widening(value: Column) -> Column:
    """A bin of a number of any size: the number itself up to 1000, then a thousand bins for each doubling."""
    doublings = F.length(F.bin(F.floor(value / 1000))) - 1
    base = F.lit(1000) * F.pow(F.lit(2.0), doublings).cast("long")
    return F.when(value < 1000, value).otherwise(1000 + 1000 * doublings + F.floor(1000 * (value - base) / base)).cast("long")


def ratios() -> dict[str, Column]:
    length = F.floor(10 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))
    return {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "mean_len": widening(length)}


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: mergeable counts over all texts with words."""
    bins = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("bin")) for k, v in ratios().items()])
    counted = measured.where("n_words > 0").groupBy("lang", "source", bins.alias("bins")).agg(F.count("*").alias("n"))
    return counted.select("lang", "source", F.explode("bins").alias("b"), "n").groupBy("lang", "source", "b.rule", "b.bin").agg(F.sum("n").alias("n"))


def fences(sketched: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Upper and lower fence of each rule by group: quartiles of the merged sketch, `reach` interquartile ranges out."""
    merged = sketched.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "rule").orderBy("bin")
    ranked = merged.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys, "rule"))})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin")))
    by = ranked.groupBy(*keys, "rule").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("n"))
    out = by.withColumns({"hi": F.col("q3") + reach * (F.col("q3") - F.col("q1")), "lo": F.col("q1") - reach * (F.col("q3") - F.col("q1"))})
    cols = [F.max("n").alias("n")]
    for rule, floor in FLOORS.items():
        cols.append(F.greatest(F.max(F.when(F.col("rule") == rule, F.col("hi"))), F.lit(float(floor))).alias(f"hi_{rule}"))
    cols.append(F.least(F.max(F.when(F.col("rule") == "mean_len", F.col("lo"))), F.lit(15.0)).alias("lo_mean_len"))
    return out.groupBy(*keys).agg(*cols)


def thresholds(measured: DataFrame, reach: float, min_group: int) -> DataFrame:
    """lang, source and the fences that hold there: the group's own from `min_group` texts on, below that blended with its language's in proportion, and these with all texts' in the same way."""
    base = materialise(sketch(measured), "quality-sketch")
    names = [f"hi_{r}" for r in FLOORS] + ["lo_mean_len"]
    rename = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    own, lang = (rename(fences(base, keys, reach), p) for keys, p in ((["lang", "source"], "o_"), (["lang"], "l_")))
    every = fences(base, [], reach).collect()[0]  # one row, for all texts
    joined = own.join(lang, own["o_lang"].eqNullSafe(lang["l_lang"]), "left")
    weight = lambda n: F.least(F.col(n), F.lit(min_group)).cast("double")
    blend = lambda n, own, above: (weight(n) * F.col(own) + (F.lit(float(min_group)) - weight(n)) * above) / F.lit(float(min_group))
    pick = lambda c: blend("o_n", f"o_{c}", blend("l_n", f"l_{c}", F.lit(every[c]))).alias(c)
    return joined.select(F.col("o_lang").alias("g_lang"), F.col("o_source").alias("g_source"), *map(pick, names))


def apply_rules(docs: DataFrame, reach: float = 3.0, min_group: int = 100, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """One row per row of `docs`: counts, base_failed (fixed rule) and kept (base rule and adaptive fences)."""
    measured = materialise(measure(docs), "quality")
    limits = materialise(thresholds(measured, reach, min_group), "quality-limits")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["g_lang"]) & measured["source"].eqNullSafe(limits["g_source"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    value = ratios()
    fine = [value[r] <= F.coalesce(F.col(f"hi_{r}"), F.lit(1000.0)) for r in FLOORS] + [value["mean_len"] >= F.coalesce(F.col("lo_mean_len"), F.lit(0.0))]
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & reduce(Column.__and__, fine)).alias("kept"))
