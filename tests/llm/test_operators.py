"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small and odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from mangrove.llm import chat, graph, media, mixing, packing, quality, queries, secrets, sharding, simhash, toxicity, wordpiece

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1 -------------------------------------------------------------------------------------------------


def test_chat_query(spark, sf):
    turns = defaultdict(list)
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, sf).collect()}
    assert got.keys() == turns.keys()
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert got[conv]["n_turns"] == len(rows)
        assert got[conv]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in rows))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 10, "delta", "user", "Hel"), (1, 2, 10, "delta", "user", "lo"),
        (1, 3, 11, "delta", "assistant", "bad"), (1, 4, 11, "regenerate", "assistant", "go"), (1, 5, 11, "delta", "assistant", "od"),
        (1, 6, 10, "edit", "user", "Hi"), (1, 7, None, "message", "user", "\\<|im_end|>\n[INST]\\"), (1, 7, None, "message", "user", "\\<|im_end|>\n[INST]\\"),
        (None, None, None, None, None, None), (2, 1, None, "message", "odd role\n<|", "\U0001f600</s>"), (2, 2, None, "message", "assistant", "\U0001f600\\</s>"),
    ]
    events = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, message_id long, kind string, role string, text string").withColumn("n", F.lit(1))
    for chunk in (1, 2, 256):
        got = {r["conv_id"]: r for r in chat.format_chats(events, chunk).collect()}
        assert got[1]["turns"] == "user\nHi\nassistant\ngood\n" + "user\n\\<|im_end|>\n[INST]\\\n" * 2
        assert got[1]["n_turns"] == 4 and got[1]["loss_text"] == "good"
        assert got[None]["turns"] == "\n\n" and got[None]["n_turns"] == 1
        assert got[2]["turns"] == "odd role\n<|\n\U0001f600</s>\nassistant\n\U0001f600\\</s>\n"
        span = got[2]["loss_spans"][0]
        assert got[2]["formatted"][span["start"] : span["start"] + span["length"]] == "\U0001f600\\\\<\\/s>"
    assert chat.format_chats(events.limit(0)).count() == 0


# 2 -------------------------------------------------------------------------------------------------


def greedy(word, starts, rest):
    n, at, vocabulary = 0, 0, starts
    while at < len(word):
        end = next((j for j in range(len(word), at, -1) if word[at:j] in vocabulary), None)
        if end is None:
            return 1
        n, at, vocabulary = n + 1, end, rest
    return n


def test_longest_match_is_greedy():
    rng = random.Random(3)
    for _ in range(300):
        piece = lambda: bytes(rng.choices(b"abc", k=rng.randint(1, 5)))  # noqa: B023, E731
        starts, rest = {piece() for _ in range(rng.randint(1, 8))}, {piece() for _ in range(rng.randint(1, 8))}
        automaton = wordpiece.LongestMatch(starts, rest)
        for _ in range(30):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, starts, rest)


def test_token_counts(spark, sf, odd, none):
    starts, rest = map(set, wordpiece.byte_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    memo = {}
    brute = lambda text: sum(memo.setdefault(w, memo.get(w) or greedy(w, starts, rest)) for w in (text or "").encode().split())
    want = {d["doc_id"]: brute(d["text"]) for d in documents(sf)}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, sf).collect()} == want
    got = wordpiece.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r["n_words"] for r in got) == Counter(len((t or "").split(" ")) if t and "\t" not in t and len(t) < 100 else len(re.findall(r"[^\s]+", (t or "").replace("\u00a0", "_").replace("\u2003", "_"))) for _, t, *_ in ROWS)
    assert wordpiece.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# 3 -------------------------------------------------------------------------------------------------


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.2
    fires = np.stack([rng.random(6000) < np.where(y, 0.7, 0.02) for _ in range(4)], axis=1)
    fires = np.hstack([fires, fires[:, :1]])
    model = toxicity.fit_label_model(fires, 0.01)
    assert np.abs(model.rates[1] - 0.7).max() < 0.15 and np.abs(model.rates[0] - 0.02).max() < 0.02
    assert model.correlations[0, 4] > 0.9 and model.correlations[1:4, 1:4].max() < 0.2
    both, apart = np.zeros((1, 5), bool), np.zeros((1, 5), bool)
    both[0, [0, 4]], apart[0, [0, 1]] = True, True
    assert model.posterior(both)[0] < model.posterior(apart)[0]
    assert ((model.posterior(fires) > 0.5) == y).mean() > 0.92


def test_label_model_keeps_a_lone_voter():
    """The one voter of a rare language, which no other confirms, keeps about the standing it starts with."""
    rng = np.random.default_rng(6)
    y = rng.random(8000) < 0.1
    rare = rng.random(8000) < 0.15
    fires = np.stack([(rng.random(8000) < np.where(y, 0.6, 0.002)) & ~rare for _ in range(5)] + [(rng.random(8000) < np.where(y, 0.9, 0.004)) & rare], axis=1)
    posterior = toxicity.fit_label_model(fires, 0.01).posterior(fires)
    assert posterior[fires[:, 5]].mean() > 0.5 and posterior[~fires.any(1)].max() < 0.1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == 1000
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    clean = [p for _, p, t in held if not t]
    assert sum(clean) <= 0.02 * len(clean)
    found = [p for _, p, t in held if t]
    assert sum(found) >= 0.6 * len(found)  # some 40 training texts of label 1 in four languages


def test_toxicity_on_held_out_rows_of_the_larger_table(spark):
    """And the label model, which sees no label, is no worse than the labels themselves as targets."""
    from mangrove.llm.common import load

    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents"), queries.training_labels(spark, sf)
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    texts = {d["doc_id"]: d["text"] for d in documents(sf) if d["doc_id"] in toxic}
    results = []
    for supervised in (False, True):
        scores = toxicity.fit(docs, labels, supervised=supervised).scores(pd.Series(list(texts.values())))
        rows = [(s, toxic[k]) for k, s in zip(texts, scores, strict=True)]
        ones, zeros = [s for s, t in rows if t], [s for s, t in rows if not t]
        auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
        results.append((sum(s >= 0.3 for s in ones) / len(ones), sum(s >= 0.3 for s in zeros) / len(zeros), auc))
    print(results)
    (found, flagged, auc), plain = results
    assert found >= 0.85 and flagged <= 0.02 and auc >= plain[2] - 0.01 and found >= plain[0] - 0.02


def test_toxicity_lexicon_takes_stems_of_rare_languages(spark):
    """Marked words of a rare language share a stem only; one copied text must not fill the lexicon."""
    rows = [(i, f"plain words number{i} stay here") for i in range(400)]
    rows += [(1000 + i, f"you idiot number{i}") for i in range(40)]
    rows += [(2000 + i, f"schlimm{chr(97 + i % 26)}{chr(97 + i // 26)}keit number{i}") for i in range(30)]
    rows += [(3000 + i, f"idiot copied passage of several words number{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    entries = [e for e, _ in model.voters]
    assert "schl*" in entries and any(e.startswith("idio") for e in entries) and len(entries) <= 6
    scores = model.scores(pd.Series(["schlimmzzkeit", "nothing at all", "an idiot", "", None]))
    assert (scores >= toxicity.THRESHOLD).tolist() == [True, False, True, False, False]


def test_toxicity_entries_do_not_nest():
    named = lambda *names: [(n, 0) for n in names]
    assert toxicity.unnested(named("abcd*", "abcde", "abcdef*", "ab", "xyz", "xyzab*", "q")) == named("abcd*", "xyz", "q")


def test_toxicity_votes_are_those_of_all_entries():
    text = "Idiot idiots, IDIOTIC!! and a naïve idio; stttttop " + "filler " * 30
    every, words = toxicity.all_entries(text)
    listed = [(e, r) for e in every for r in toxicity.RATES]
    assert toxicity.Voters(listed).votes(text)[0].tolist() == [toxicity.fires(every[e], r, words) for e, r in listed]
    assert every["idio*"] == 4 and every["/bang/"] == 1 and every["/stretched/"] == 1 and every["/shout/"] == 1


def test_toxicity_voters_are_useful():
    assert toxicity.useful(np.array([[1, 1, 0]] * 3 + [[0, 0, 1]] * 2, bool), 2, 9, cover=1) == [0, 2]


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (8, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(ROWS) and toxicity.reject(odd, model).columns == odd.columns
    empty = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


# 4 -------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts(spark, sf, odd, none):
    want = {d["doc_id"]: base_counts(d["text"]) for d in documents("/root/testdata/sf0.01")}
    rows = queries.op4_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    good = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.75 * len(good)
    got = quality.apply_rules(odd)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == Counter((i, *base_counts(t)) for i, t, *_ in ROWS)
    assert quality.apply_rules(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    rng = random.Random(2)
    text = lambda p: " ".join(("w#" if rng.random() < p else "word") + str(rng.randrange(10**6)) for _ in range(60))
    rows = [(i, text(0.9 if i % 2 else 0.0), "en", f"s{i % 2}", 1) for i in range(400)] + [(1000, text(0.9), "en", "s0", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[1000] and all(got[i] for i in range(400))


# 5 -------------------------------------------------------------------------------------------------


def test_water_filling():
    plans = mixing.water_fill([(None, 5), ("b", 1000), ("a", 1000), ("c", 10), ("z", 0)])
    assert [p.source for p in plans] == ["a", "b", "c", "z", None]
    assert all(p.target <= 3 * p.size + 1e-9 for p in plans) and abs(sum(p.target for p in plans) - 2015) < 1e-6
    assert plans[2].target == 30 and plans[4].target == 15 and abs(plans[1].target / plans[0].target - 2) < 1e-9


def brute_targets(sizes):
    """Share by weight among the sources that are not at their cap, round after round, in fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: [1, 2, 3][i % 3] for i, x in enumerate(names)}
    target, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(sum(sizes.values()))
    while left > 0 and open_:
        part = left / sum(weight[x] for x in open_)
        for x in sorted(open_, key=names.index):
            more = min(part * weight[x], 3 * sizes[x] - target[x])
            target[x] += more
            left -= more
        open_ = {x for x in open_ if target[x] < 3 * sizes[x]}
    return target


def test_targets_are_those_of_rounds_in_fractions():
    rng = random.Random(21)
    for _ in range(50):
        sizes = {rng.choice([None, *map(str, range(30))]): rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 20))}
        want = brute_targets(sizes)
        assert all(abs(p.target - want[p.source]) < 1e-6 * max(1, p.size) for p in mixing.water_fill(list(sizes.items())))


def test_splitting_tree_is_exact():
    pools = [1000, 37, 0, 250_000, 12, 10**13, 5]
    for quota in (0, 1, 1000, 10**12, sum(pools)):
        dealt = mixing.split_quota(quota, pools, random.Random(quota))
        assert sum(dealt) == quota and all(0 <= q <= p for q, p in zip(dealt, pools, strict=True))
    got = mixing.split_quota(10**12, pools, random.Random(5))
    assert got == mixing.split_quota(10**12, pools, random.Random(5))


@pytest.mark.parametrize(("good", "bad", "draws"), [(40, 60, 50), (70, 60, 33), (300, 5000, 900), (3000, 100, 1500), (5, 4000, 2000)])
def test_hypergeometric_draws_follow_the_law(good, bad, draws):
    """Chi-squared against exact probabilities from binomial coefficients, a fixed seed."""
    from math import comb

    rng, n = random.Random(3), 20_000
    seen = Counter(mixing.hypergeometric(rng, good, bad, draws) for _ in range(n))
    want = {k: n * (comb(good, k) * comb(bad, draws - k)) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    kept = [k for k, e in want.items() if e >= 10]
    chi = sum((seen[k] - want[k]) ** 2 / want[k] for k in kept)
    assert set(seen) <= set(want) and chi < len(kept) + 5 * (2 * len(kept)) ** 0.5


def test_hypergeometric_draws_of_huge_numbers():
    rng = random.Random(9)
    good, bad, draws = 4 * 10**14, 6 * 10**14, 10**14
    z = [(mixing.hypergeometric(rng, good, bad, draws) - draws * 0.4) / (draws * 0.4 * 0.6 * 0.9) ** 0.5 for _ in range(4000)]
    assert abs(np.mean(z)) < 0.06 and abs(np.var(z) - 1) < 0.1 and abs(np.mean(np.abs(z) < 1) - 0.6827) < 0.03


def test_the_splitting_tree_decides_what_is_taken(spark, monkeypatch):
    """With every quota dealt to the first pools that hold it, the totals stay and the documents change."""
    from mangrove.llm.common import load

    docs = load(spark, "/root/testdata/sf0.01", "documents")
    total = lambda rows: {s: sum(r["taken"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    real = mixing.taken_words(docs).collect()

    def greedy(pools, shards, seed):
        rows = defaultdict(dict)
        for r in pools.collect():
            rows[r["source"], r["rest"]][r["shard"]] = r["pool"]
        out = []
        for (source, rest), mine in rows.items():
            for shard, pool in sorted(mine.items()):
                out.append((source, shard, min(rest, pool)))
                rest -= min(rest, pool)
        return spark.createDataFrame(out, "source string, shard int, quota long")

    monkeypatch.setattr(mixing, "quotas", greedy)
    other = mixing.taken_words(docs).collect()
    assert total(real) == total(other)
    differ = {r["doc_id"]: r["taken"] for r in real}
    assert sum(differ[r["doc_id"]] != r["taken"] for r in other) > 100


def test_repeated_rows_share_out_what_is_emitted(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words, "a")] * 60 + [(i, words + f" {i}", "b") for i in range(100, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken, got = Counter(), Counter()
    for r in mixing.taken_words(docs, block=7, shards=3).collect():
        taken[r["source"]] += r["taken"]
    for r in mixing.emit(docs, block=7, shards=3).collect():
        got[r["source"]] += len(r["text"].split())
    assert taken == got and abs(got["a"] - sum(len(t.split()) for _, t, _ in rows) / 3) <= 1


def test_mixing(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs = documents(sf)
    sizes = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    by = Counter()
    for d in docs:
        by[d["source"]] += sizes[d["doc_id"]]
    target = brute_targets(by)
    rows = queries.op5_mixing(spark, sf).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by[s]) and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == 1000 and all(abs(taken[s] - target[s]) <= 1 for s in by)
    assert sorted(rows) == sorted(queries.op5_mixing(spark, sf).collect())
    got = mixing.taken_words(odd, block=3, bucket_blocks=5).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s, want in {r["source"]: r["target"] for r in got}.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want) <= 1
    assert mixing.taken_words(none).count() == 0 and mixing.emit(none).count() == 0


def test_mixing_tells_sources_of_repeated_rows_apart(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", None), (2, "g h i", "z"), (2, "g h i", "z")]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=2, bucket_blocks=5).select("source", "taken", "target").collect()
    for source, target in {(r["source"], r["target"]) for r in got}:
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 1


def test_mixing_emits_what_is_taken(spark, odd):
    got = mixing.emit(odd, block=3, bucket_blocks=5)
    assert got.columns == odd.columns
    taken = {(r["source"]): 0 for r in odd.select("source").distinct().collect()}
    for r in mixing.taken_words(odd, block=3, bucket_blocks=5).collect():
        taken[r["source"]] += r["taken"]
    words = Counter()
    for r in got.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert all(words[s] == n for s, n in taken.items())
    documents_, draws = mixing.mix(odd, block=3, shards=4, bucket_blocks=5)
    own = {(r["row_key"], r["shard"]) for r in documents_.collect()}
    assert all((r["row_key"], r["shard"]) in own and 0 < r["taken"] <= r["words"] for r in draws.collect())


# 6 -------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    texts = {d["doc_id"]: d["text"] for d in documents(sf)}
    rows = queries.op6_secret_scans(spark, sf).collect()
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(","))
        assert r["n_hex"] == sum(b.startswith("hex:") for b in base) and r["n_assign"] == sum(b.startswith("assign:") for b in base)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 0
    got = secrets.find_secrets(odd).select("doc_id", secrets.joined("base")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, ",".join(brute_spans(t))) for i, t, *_ in ROWS)
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0


def test_redaction_cuts_spans_only(spark, odd):
    got = secrets.redact(odd)
    assert got.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"]}
    assert texts[8] == "[SECRET]\" and token: abc and [SECRET] [SECRET]"
    assert all(texts[i] == t for i, t, *_ in ROWS if i not in (8, 9, None))


def test_battery_tells_keys_from_words():
    rng = random.Random(11)
    alphabet = secrets.ENCODINGS["base62"]
    key = lambda n, a=alphabet: "".join(rng.choices(a, k=n))
    random_bins = [secrets.candidates(f"x {key(48)} y", [])[0][4] for _ in range(300)]
    words = "internationalisationOfConfigurationParametersForTheApplicationServer".split() + ["a" * 60, "abcdefghijklmnopqrstuvwxyz" * 2, "-" * 40, "2024-01-01-2024-02-02-2024-03-03", "src/main/java/org/example/service/impl"]
    assert all(secrets.battery(w)[1] > 1e-2 for w in words)
    assert sum(b >= 60 for b in random_bins) > 270
    assert secrets.battery("a" * 25)[1] == 1.0


def test_keys_after_an_equals_sign_are_found(spark):
    rng = random.Random(12)
    key = lambda name: "".join(rng.choices(secrets.ENCODINGS[name], k=64))
    rows, want = [], {}
    for i, (before, after) in enumerate([("key=", ""), ("AWS_SECRET_ACCESS_KEY=", "\n"), ("AUTH=", " x"), ("https://a.example/b?sig=", "&x=1"), ("x==", ""), ("", "=="), ("k=", "======"), ("s=", "=1")]):
        value = key("base32" if after == "======" else "base64" if after == "==" else "base62")
        rows.append((i, f"see {before}{value}{after}"))
        want[i] = (4 + len(before), 4 + len(before) + 64 + len(after if set(after) == {"="} else ""))
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "random"] for r in found.collect()}
    assert got == {i: [span] for i, span in want.items()}


def test_false_discovery_step():
    assert secrets.thresholds([(0, 0, 90), (0, 60, 5), (0, 100, 5)], 0.01) == {0: 60}
    assert secrets.thresholds([(0, 0, 10**6), (0, 60, 1)], 0.01) == {} and secrets.thresholds([], 0.01) == {}


def test_tokens_inside_known_spans_take_no_part():
    text = "password=" + "aB3" * 9 + " " + "0123456789abcdef" * 2 + " free " + "Zx9Qw" * 6
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b, *_ in secrets.candidates(text, base)] == ["Zx9Qw" * 6] and len(secrets.candidates(text, [])) == 3


@pytest.mark.parametrize(("length", "least"), [(32, 0.4), (40, 0.85), (64, 0.95)])
def test_planted_keys_are_found_and_words_are_not(spark, length, least):
    """Random keys (base32 where they are long enough to tell) among prose, paths, identifiers and repeated runs: recall by length, and false discoveries at most 2 in 100 of what is reported (the rate is 1 in 100)."""
    rng, rows, planted = random.Random(length), [], {}
    words = ["".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(2, 11))) for _ in range(2000)]
    for i in range(3000):
        parts = [*rng.choices(words, k=20), "/".join(rng.choices(words, k=6)), "_".join(rng.choices(words, k=5)), "".join(w.title() for w in rng.choices(words, k=5)), rng.choice("=-_a") * rng.randint(20, 70)]
        rng.shuffle(parts)
        text = " ".join(parts)
        if i % 4 == 0:
            alphabet = secrets.ENCODINGS[["base62", "base64", "base32" if length >= 64 else "base62"][i // 4 % 3]]
            key = "".join(rng.choices(alphabet, k=length))
            planted[i] = (len(text) + 1, len(text) + 1 + length)
            text += f" {key} end"
        rows.append((i, text))
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = [(r["doc_id"], s["start"], s["stop"]) for r in found.collect() for s in r["spans"] if s["kind"] == "random"]
    hits = sum(planted.get(i) == (a, b) for i, a, b in spans)
    assert hits >= least * len(planted) and len(spans) - hits <= 0.02 * len(spans)


# 7 -------------------------------------------------------------------------------------------------


def test_binary_pieces():
    for n in [*range(0, 3000), 10**6 + 7]:
        pieces = packing.binary_pieces(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 1024 for p in pieces) and pieces == sorted(pieces, reverse=True)


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for key, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by[key], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in mine) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))] and {r["doc_tokens"] for r in mine} == {len(ids)}
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 for r in rows)


def test_packing(spark, sf, odd, none):
    from mangrove.llm.common import load

    check_packed(queries.pack(load(spark, sf, "documents")).collect(), [(d["doc_id"], d["text"]) for d in documents(sf)])
    once = [r for r in ROWS if r[0] not in (2, None)]
    check_packed(queries.pack(odd.where("doc_id is not null and doc_id <> 2")).collect(), [r[:2] for r in once])
    assert sum(1 for r in queries.pack(odd).collect() if r["doc_id"] is None and r["start"] == 0) == 2
    assert queries.pack(none).count() == 0
    query = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.op7_packing(spark, sf).collect()}
    assert all(query[r["doc_id"], r["start"]] == zlib.crc32(r["ids"]) for r in queries.pack(load(spark, sf, "documents")).limit(50).collect())


def test_ids_of_special_tokens_and_very_long_texts(spark):
    """On both sides of the length beyond which the other encoder is used, and where a text spells a special token out."""
    rng = random.Random(8)
    words = ["the", "naïve", "\U0001f600", "x" * 40, "12345", "\n\n", "  ", "don't", "日本語", "<|endoftext|>", "<|endoftext"]
    texts = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", " ".join(rng.choices(words, k=300))]
    for length in (packing.LONG_TEXT - 1, packing.LONG_TEXT, packing.LONG_TEXT + 1, packing.LONG_TEXT + 50_000):
        texts.append("".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(length // 4))[:length])
    assert max(map(len, texts)) > packing.LONG_TEXT
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = queries.pack(docs).collect()
    check_packed(rows, list(enumerate(texts)))
    assert struct.unpack("<2I", b"".join(r["ids"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == 0)) == (50256, 0)


# 8 -------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_sharding(spark, sf).collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents(sf)}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(load) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / 40
    assert max(abs(v - mean) for v in load.values()) <= 2 * max(r["size"] for r in rows)
    for shard in range(40):  # the shards before end as near to their share as one row lets them
        assert abs(sum(load[s] for s in range(shard + 1)) - (shard + 1) * mean) <= max(r["size"] for r in rows)
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ROWS) and {r["shard"] for r in got} <= {0, 1, 2}
    assert sharding.shard(none, 5).count() == 0
    assert sharding.shard(odd, 3, dims=("text", "doc_id")).count() == len(ROWS)


def brute_leaves(tree, rows):
    """Each row's leaf, walked node by node over whole values."""
    out = []
    for row in rows:
        at = 0
        while tree.dim[at] >= 0:
            value, cut = row[tree.dim[at]], tree.cut[at]
            goes_left = value is None or (cut >= 0 and value <= tree.cuts[tree.dim[at]][cut])
            at = tree.left[at] if goes_left else tree.right[at]
        out.append(tree.left[at])
    return out


def test_tree_is_a_kd_tree():
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(rng.choice([None, "en", "de"]), f"https://crawl.example.org/{rng.randint(0, 30):05}", rng.choice([None, -5, 3.5, rng.random() * 1e6])) for _ in range(3000)]
    columns = [list(c) for c in zip(*rows, strict=True)]
    tree = sharding.grow(columns, np.ones(len(rows)), 40.0)
    got = tree.leaf_of([pa.array(columns[0]), pa.array(columns[1]), pa.array([None if v is None else float(v) for v in columns[2]])]).tolist()
    assert got == brute_leaves(tree, rows) and set(got) == set(range(tree.leaves))
    members = defaultdict(list)
    for leaf, row in zip(got, rows, strict=True):
        members[leaf].append(row)
    assert all(len(m) <= 40 or len(set(m)) == 1 for m in members.values())
    assert len(members) > 60 and len({len({r[d] for m in members.values() for r in m}) for d in (0, 1)}) == 2


def test_medians_are_those_of_all_rows(spark):
    """More rows than a sketch of 65,536 holds: shards of one leaf each end at the quarters themselves."""
    rows = spark.range(200_000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'a' AS source", "id * 7919 % 200000 AS n_chars")
    got = sharding.shard(rows, 4, fineness=1).join(rows, "doc_id").selectExpr("shard", "n_chars").groupBy("shard").agg({"n_chars": "min", "*": "count"}).collect()
    assert sorted(tuple(r.asDict()[c] for c in ("shard", "min(n_chars)", "count(1)")) for r in got) == [(i, i * 50_000, 50_000) for i in range(4)]


@pytest.mark.parametrize("cells_at_once", [5, 200, 100_000])
def test_tree_over_a_table_is_that_of_its_rows(spark, cells_at_once):
    rng = random.Random(8)
    rows = [(rng.choice([None, "en", "de", "\U0001f600", "\uffff"]), rng.randint(0, 9000) if i % 3 else 7, rng.choice([None, -5.0, float("inf"), float("nan"), round(rng.gauss(0, 1), 2)]), rng.randint(16, 900)) for i in range(6000)]
    want = sharding.grow([[r[i] for r in rows] for i in range(3)], np.array([r[3] for r in rows]), 9000.0)
    table = spark.createDataFrame(rows, "a string, b long, c double, size long").repartition(5)
    table = table.select("a", "b", sharding._number(table, "c"), "size")
    got = sharding.grow_over(table, ["a", "b", "c"], 9000.0, cells_at_once)
    told = lambda tree: [(d, left, right, None if d < 0 or c < 0 else tree.cuts[d][c]) for d, c, left, right in zip(tree.dim, tree.cut, tree.left, tree.right, strict=True)]
    assert told(got) == told(want) and got.leaves == want.leaves > 300


@pytest.mark.parametrize("rows", [[(1, "same", "en", "a", 4)] * 500, [(None, "same", "en", "a", 4)] * 300 + [(i, "x" * (i % 9), "en", "a", i % 9) for i in range(300)]])
def test_equal_rows_are_spread_evenly(spark, rows):
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), 4).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and set(load) == set(range(4)) and max(load.values()) - min(load.values()) <= 2 * 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sources_with_a_common_head_are_told_apart(spark):
    rows = [(i, "x" * 50, "en", f"https://example.org/crawl-{i % 8}", 50) for i in range(800)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 8).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r["doc_id"] % 8].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values()) and len(set().union(*homes.values())) == 8


# 9 -------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs = sorted(documents(sf), key=lambda d: d["doc_id"])
    fps = [brute_fingerprint(d["text"]) for d in docs]
    classes = brute_classes(fps)
    want = {d["doc_id"]: (f"{fp:016x}", docs[c]["doc_id"]) for d, fp, c in zip(docs, fps, classes, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf).collect()} == want
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in got) == Counter((i, brute_fingerprint(t)) for i, t, *_ in ROWS)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3} and {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pigeonring_links_join_all_close_fingerprints(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in rng.sample(sorted(fps), 20):
        for _ in range(60 if centre % 5 == 0 else 6):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "node long"))
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    got = [roots.get(x, x) for x in signed]
    classes = brute_classes(fps)
    assert len(set(got)) == len(set(classes)) == len(set(zip(got, classes, strict=True)))


def test_deduplicate_catches_edited_copies_and_leaves_others(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    text = lambda: [rng.choice(vocabulary[: 50 if rng.random() < 0.4 else 3000]) for _ in range(rng.randint(120, 300))]
    rows, edited = [], {}
    for i in range(300):
        words = text()
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            copy = list(words)
            for at in rng.sample(range(len(copy)), 2 if len(copy) > 150 else 1):
                copy[at] = rng.choice(vocabulary)
            edited[1000 + i] = i
            rows.append((1000 + i, " ".join(copy)))
        if i % 10 == 0:
            rows.append((2000 + i, " ".join(words).upper()))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(300)) <= kept and not any(2000 + i in kept for i in range(0, 300, 10))
    assert len(set(edited) & kept) <= 0.1 * len(edited)


def near_classes(texts):
    """Root of each text under a Jaccard similarity of 0.8 or more of sets of five words, all pairs tested."""
    lists = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in lists]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (len(x) <= 5 * len(y) and len(y) <= 5 * len(x)) and 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_deduplicate_is_exact_on_the_shingle_sets(spark):
    """Of each class by the sets themselves one text stays; fingerprints alone took away texts of similarity 0.42 and more."""
    docs = sorted(documents("/root/testdata/sf0.01"), key=lambda d: d["doc_id"])
    classes = near_classes([d["text"] for d in docs])
    kept = simhash.deduplicate(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [d["doc_id"] for i, d in enumerate(docs) if classes[i] == i]


def test_deduplicate_joins_large_groups_of_many_edits(spark):
    """One text edited anew in each copy, so that few copies are near a common one; and texts that share a passage and no more."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    base, passage, texts = rng.choices(vocabulary, k=200), rng.choices(vocabulary, k=40), []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            words[at] = rng.choice(vocabulary)
        texts.append(" ".join(words))
        texts.append(" ".join(rng.choices(vocabulary, k=i % 60) + passage))
    classes = near_classes(texts)
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes)) and 50 < len(set(classes)) < 250


def test_deduplicate_catches_copies_with_a_block_added_or_dropped(spark):
    docs = [d["text"].split() for d in documents("/root/testdata/sf0.01") if 60 <= len(d["text"].split()) <= 600][:300]
    rows = []
    for i, words in enumerate(docs[:-1]):
        n, other = len(words), docs[i + 1]
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, " ".join(words + (other * 2)[: n * (i % 5 + 1) // 25])))
        rows.append((3 * i + 2, " ".join(words[n * (i % 5 + 1) // 28 :])))
    classes = near_classes([t for _, t in rows])
    assert sum(c != i for i, c in enumerate(classes)) > 500
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(classes) if c == i]


def test_deduplicate_tests_all_partners_of_small_buckets(spark):
    """Texts with two near copies that are not near each other; many of their buckets hold two texts only."""
    texts = []
    for i in range(300):
        words = [f"w{i}x{k}" for k in range(14)]
        texts += [" ".join(words[:12]), " ".join(words[2:]), " ".join(words)]
    classes = near_classes(texts)
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes)) == list(range(0, 900, 3))


def test_deduplicate_finds_near_copies_that_the_chain_misses(spark):
    """Pairs of similarity 57/71 or 58/72 whose fingerprints differ in 25 bits or more."""
    texts = []
    for start, shingles in ((690_194, 65), (805_412, 64), (1_107_367, 65), (1_752_173, 64)):
        texts += [" ".join(f"w{i}" for i in range(at, at + shingles + 4)) for at in (start, start + 7)]
    sets = [simhash._shingles(t, 5)[1] for t in texts]
    fps, sizes = np.array([simhash._majority(x) for x in sets], np.int64).view(np.uint64), np.array([len(x) for x in sets])
    first = np.arange(0, len(texts), 2)
    assert not simhash._near(sizes, fps, first, first + 1)[0].any()
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(near_classes(texts))) == first.tolist()


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i * 7 + 1) % 50) for i in range(50)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(v >= 1000 for k, v in got.items() if k >= 1000)


# 10 ------------------------------------------------------------------------------------------------


def test_images_round_trip():
    for data in (b"", b"a", b"x" * 64, bytes(range(256)) * 3 + b"z"):
        samples, n = media.decode_image(media.encode_image(data))
        assert n == len(data) and samples == data.ljust(max(64, -(-n // 64) * 64), b"\0")


def test_media_query(spark, sf, odd, none):
    rows = queries.op10_media_columns(spark, sf).collect()
    want, features = {}, {}
    for d in documents(sf):
        raw = (d["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[d["doc_id"]] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.encode_image(raw)).hexdigest())
        samples = list(payload)
        mean = sum(samples) / len(samples)
        p = [n / len(samples) for n in Counter(samples).values()]
        parts = {"mean": mean, "sd": (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5, "entropy": -sum(x * math.log2(x) for x in p), "step": sum(abs(a - b) for a, b in zip(samples, samples[1:], strict=False)) / (len(samples) - 1)}
        features[d["doc_id"]] = parts
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows} == want
    for r in rows:
        told = dict(x.split("=") for x in r["feature"].split(";"))
        assert told.keys() == features[r["doc_id"]].keys() and all(abs(int(told[k]) / 1000 - v) < 0.0011 for k, v in features[r["doc_id"]].items())
    got = media.media_columns(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t, *_ in ROWS)
    assert media.media_columns(none).count() == 0


def png_samples(media):
    """An image by the format's own rules: signature, chunks with their checksums, 8-bit grey, one filter byte a row."""
    assert media[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, width = 8, b"", 0
    while at < len(media):
        (n,), kind, body = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8], media[at + 8 : at + 8 + struct.unpack(">I", media[at : at + 4])[0]]
        assert zlib.crc32(kind + body) == struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (depth, colour) == (8, 0)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = zlib.decompress(data)
    assert len(rows) == height * (width + 1)
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def test_media_of_odd_ids(spark):
    rows = [("a\0b", "one"), ("x" * 70_000, "two"), ("/id/", "three"), ("", "four"), (None, "five"), ("\U0001f600 é", "")]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], bytes(r["payload"]).rstrip(b"\0").decode()) for r in got) == Counter(rows)
    assert all(png_samples(bytes(r["media"])) == bytes(r["payload"]) for r in got)


def test_ranges_cover_each_member_once_and_broken_members_fail(spark, odd, tmp_path):
    folder = media.write_archives(odd, str(tmp_path / "m"))
    spark.dataSource.register(media.MediaArchives)
    read = lambda split: sorted((str(r["doc_id"]), r["n_bytes"]) for r in spark.read.format("media_archives").option("path", folder).option("splitBytes", split).load().collect())
    assert read(100) == read(1 << 30)
    fs, path = media._open(folder)
    reader = media.ArchiveReader(folder, 1 << 30)
    archive = f"{path}/{reader.partitions()[0].name}"
    with pytest.raises(OSError):
        media.read_member(fs, archive, 3, 10, 0)
