"""Secret scans: fixed patterns, and a randomness test battery over other tokens.

Candidates are runs of 20 or more characters of an alphabet in which keys are written, padding apart; what follows a name and '=' is one of its own. For the encoding inferred (hex,
base32, base62, base64) the battery tests how far the token is from random: chi-squared uniformity of its alphabet, the number
of runs above and below the alphabet's middle, and serial correlation. Each test is one of equivalence: its null hypothesis says
that the token is structured by at least a stated effect per character, so short tokens can't reach a small p-value.
A token is random only if it fails to be structured in all three respects, so the largest of the three p-values is the token's (intersection-union). Benjamini-Hochberg over all candidates of the corpus, within each class
of length, picks those that are random at false-discovery rate `rate`. Candidates that overlap a span of a fixed pattern are found already and take no part, so the rate is that of the spans the battery adds.

The corpus gives the false-discovery step one count per (length class, p-value bin), at most 8 x 401 rows.

Defined cases: null text: empty, no spans; repeated rows are scanned each; an empty table gives no rows. Spans are in code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
_LETTERS = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_ASSIGN = re.compile(
    "(" + "|".join(_LETTERS(w) for w in ("password", "passwd", "secret", "token")) + "|" + _LETTERS("api") + "_?" + _LETTERS("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: '=' ends a run as padding and otherwise parts a name from its value.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: Encodings from narrow to wide: alphabet in order of value.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_RANKS = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
#: Structure that a token has at least under the null hypothesis: chi-squared divergence per character (words in small and capital letters have more; those in capitals alone are
#: compared with base32), excess or lack of runs as a share of the greatest there can be, serial correlation.
DIVERGENCE = {"hex": 2.0, "base32": 1.0, "base62": 2.0, "base64": 2.0}
RUNS = SERIAL = 0.8
#: Lower ends of the length classes.
CLASSES = (20, 24, 32, 40, 48, 64, 96, 128)
#: p-values are binned by a twentieth of a decade; the last bin is 1e-20 and less.
PER_DECADE, BINS = 20, 400


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token; None for plain numbers and for what no alphabet holds."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    chars = set(body)
    if chars <= set("0123456789"):
        return None
    if chars <= set(ENCODINGS["hex"]) or chars <= set("0123456789ABCDEF"):
        return "hex"
    return next((name for name, ranks in _RANKS.items() if chars <= ranks.keys()), None)


def battery(token: str) -> tuple[str | None, float]:
    """(encoding, p-value of structure). Small: the token is as random as its length can show."""
    encoding = infer_encoding(token)
    if encoding is None:
        return None, 1.0
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    ranks = _RANKS[encoding]
    values = [ranks[c.lower() if encoding == "hex" else c] for c in body]
    n, k = len(values), len(ranks)
    if n < 20:
        return encoding, 1.0
    chi = k / n * sum(c * c for c in Counter(values).values()) - n
    shift = DIVERGENCE[encoding] * n
    p_uniform = _below((chi - (k - 1 + shift)) / math.sqrt(2 * (k - 1 + 2 * shift)))
    # Alphabets place letters by class, so a word of one case stays on one side of the middle.
    side = [2 * v >= k for v in values]
    n1 = sum(side)
    n0 = n - n1
    if not n0 or not n1:
        return encoding, 1.0
    mean = 1 + 2 * n0 * n1 / n
    sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    z = (1 + sum(a != b for a, b in zip(side, side[1:], strict=False)) - mean) / sd
    p_runs = _below(abs(z) - RUNS * math.sqrt(n))
    m = sum(values) / n
    spread = sum((v - m) ** 2 for v in values)
    r = sum((a - m) * (b - m) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    p_serial = _below((abs(r) - SERIAL) * math.sqrt(n))
    return encoding, max(p_uniform, p_runs, p_serial)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ordered by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length class, p-value bin) of tokens that the battery can read and that overlap none of the spans `known`, which are in order."""
    out, at, reach = [], 0, 0
    for m in _RUN.finditer(text):
        while at < len(known) and known[at][0] < m.end():
            reach, at = max(reach, known[at][1]), at + 1
        if m.start() < reach:
            continue
        encoding, p = battery(m[0])
        if encoding:
            out.append((m.start(), m.end(), encoding, bisect_right(CLASSES, m.end() - m.start()) - 1, min(BINS, int(-PER_DECADE * math.log10(max(p, 1e-300))))))
    return out


def thresholds(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg by length class: the least p-value bin that is accepted. counts: (class, bin, tokens)."""
    out = {}
    for cls in {c for c, _, _ in counts}:
        bins = Counter()
        for c, b, n in counts:
            if c == cls:
                bins[b] += n
        total, seen, best = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / PER_DECADE) <= rate * seen / total:
                best = b
        if best is not None:
            out[cls] = best
    return out


SPAN = "struct<start:int,stop:int,kind:string>"
CANDIDATE = "struct<start:int,stop:int,encoding:string,cls:int,bin:int>"


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, base (array of start, stop, kind) and spans: base ones and those of the battery that overlap none of them."""
    return _decide(docs, rate, ["doc_id"]).select("doc_id", "__found.base", "__found.spans")


def _decide(docs: DataFrame, rate: float, carry: list[str]) -> DataFrame:
    """Columns `carry` of `docs`, and __found with base and spans. Texts are scanned once; what is found is written, then decided over the whole corpus."""

    @F.pandas_udf(f"struct<base:array<{SPAN}>,tokens:array<{CANDIDATE}>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [(t or "", base_spans(t or "")) for t in texts]
        named = lambda names, found: [dict(zip(names, x, strict=True)) for x in found]
        return pd.DataFrame({"base": [named(("start", "stop", "kind"), b) for _, b in rows], "tokens": [named(("start", "stop", "encoding", "cls", "bin"), candidates(t, b)) for t, b in rows]})

    small_batches(docs)
    scanned = materialise(docs.select(*[docs[c] for c in carry], scan(docs["text"]).alias("__scan")), "secrets")
    counts = scanned.select(F.explode("__scan.tokens").alias("t")).groupBy("t.cls", "t.bin").agg(F.count("*").alias("n")).collect()
    least = thresholds([(r["cls"], r["bin"], r["n"]) for r in counts], rate)
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.expr("cast(map() as map<int,int>)")
    base = F.col("__scan.base")
    random = F.filter("__scan.tokens", lambda t: t["bin"] >= F.try_element_at(limit, t["cls"]))
    spans = F.array_sort(F.concat(base, F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.lit("random").alias("kind")))), _by_start)
    return scanned.select(*carry, F.struct(base.alias("base"), spans.alias("spans")).alias("__found"))


def _by_start(a, b):
    rank = lambda s: s["start"].cast("long") * 8 + F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """`docs` with every span of its texts replaced by `mask`; rows without one stay as they are. n_chars, if there, follows the text."""
    found = _decide(docs, rate, docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            parts, at = [], 0
            for s in cuts:
                if s["stop"] > at:
                    parts += [text[at : max(at, s["start"])], mask]
                    at = s["stop"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out)

    has = F.size("__found.spans") > 0
    text = F.when(has, cut(F.when(has, F.col("text")).otherwise(""), F.when(has, F.col("__found.spans")).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))).otherwise(F.col("text"))
    out = found.withColumn("__text", text)
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.when(has, F.length("__text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])
