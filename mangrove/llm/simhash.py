"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in a ring of five segments. Fingerprints that differ in at most 4 bits have a segment from
which a chain of consecutive segments starts whose cumulative differences stay within the proportional budget: after l
segments at most floor(4 l / 5), that is 0, 1, 2, 3, 4. Buckets are made of the first two links of each chain: the first segment as it is, the second as it
is or with one zero bit set (of two segments that differ in one bit, one has a zero there). Within a bucket the third and
fourth link prune pairs, then the full distance decides.

Equal fingerprints are one node from the start, so copies are never paired. A bucket emits single links where it is small
and a spanning forest where it isn't: links between different fingerprints are all tested, only those that would join what
is joined already are left out. Components of the links give the classes.

`near_duplicates` links by one fingerprint of word shingles. `deduplicate` is for near copies by the sets of their five-word shingles: a link is a
Jaccard similarity of 0.8 or more, counted on the sets (of 64-bit hashes). Fingerprints of such pairs differ in some 10 of 64 bits on average, too many for
buckets of whole segments, so its buckets are the rare shingles of a text: in one order of all shingles, rare ones first, two such sets of sizes up to n share one
of their first n // 5 + 1. Within a bucket sizes and the pigeonring chain over the segments at distance NEAR find pairs, then the sets decide. So that a group of many copies
gives no square of pairs, each row is tested with one leader of its buckets first, then with one partner of another class, the nearest by the parities of the
shingles' counts in two bins a shingle or more. The chain can miss a pair of 0.8 or more and a row has more partners than these two, so neither pass closes a bucket: the last one
tests all pairs of a bucket that are in different classes then, whatever the chain says. Only sizes and parities prune there, which bound the similarity from above without loss.

Defined cases: null or wordless text: fingerprint zero, linked like any other; fewer words than a shingle: the whole
sequence is the shingle; repeated rows fall together; null ids take their class's id, null if it has no other; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, only, small_batches
from .graph import components

BITS, DISTANCE, SEED = 64, 4, 42
#: Greatest distance of fingerprints of near copies in the first pass, and the size of sets from which it is asked for.
NEAR, SURE = 24, 64
#: Texts that say which shingles are frequent, and the most of these that are told apart.
SAMPLE, FREQUENT = 20_000, 100_000
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
#: Buckets of more rows than this emit a spanning forest.
SMALL = 8
#: Pairs tested at once, by fingerprints and by bins.
BLOCK, BIN_BLOCK = 1 << 17, 1 << 13


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    src = only(small_batches(docs), doc_id="doc_id", text="text")
    return src.select("doc_id", F.xxhash64("text").alias("text_hash"), of("text").alias("fp"))


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _shingles(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """The hash of the text's words as a signed long, and the set of its shingles' hashes, sorted."""
    words = (text or "").encode().lower().split()
    node = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        rolled = rolled * _FACTOR + each[k : k + len(rolled)]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * _FACTOR
    return node - (1 << 64) if node >> 63 else node, np.unique((rolled ^ (rolled >> np.uint64(29))).view(np.int64))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Texts handled at once by a Python worker.
SLICE = 256
#: Rows of buckets handled at once, if a bucket has no more.
BUCKET_ROWS = 20_000
MOST_BINS = 1 << 15


def _parities(hashes: np.ndarray) -> bytes:
    """One bit a bin: whether an odd number of `hashes` falls there. Bins are a power of two, 64 and twice the hashes at least, MOST_BINS at most."""
    n = min(MOST_BINS, max(64, 1 << (2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount(hashes & (n - 1), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that several of about SAMPLE distinct texts share, at most FREQUENT. They only set the order of the search."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = [_shingles(t, shingle)[1] for t in batch.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["s"])

    every = max(1, -(-docs.count() // SAMPLE))
    sample = docs.select("text", F.xxhash64("text").alias("h")).where(F.pmod(F.col("h"), F.lit(every)) == 0).dropDuplicates(["h"])
    counts = sample.select("text").mapInArrow(of, "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT)
    rows = sorted((r[0], r[1]) for r in counts.collect())
    return np.array([s for s, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, node (hash of the text's words), n (size of the set of shingles), fp (fingerprint of the set), bins (parities) and prefix (its first n // 5 + 1 in order of the search)."""
    src = only(small_batches(docs), doc_id="doc_id", text="text")
    names, counts = frequent_shingles(src, shingle)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                nodes, sizes, fps, bins, prefixes = [], [], [], [], []
                for text in batch.column(2).slice(at, SLICE).to_pylist():
                    node, own = _shingles(text, shingle)
                    often = np.zeros(len(own), np.int64)
                    if len(names):
                        where = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        often = np.where(names[where] == own, counts[where], 0)
                    nodes.append(node)
                    sizes.append(len(own))
                    fps.append(_majority(own))
                    bins.append(_parities(own))
                    prefixes.append(own[np.lexsort((own, often))[: len(own) // 5 + 1]])
                ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                arrays = [batch.column(0).slice(at, SLICE), batch.column(1).slice(at, SLICE), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(bins, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "node", "n", "fp", "bins", "prefix"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(of, f"doc_id {kind}, text_hash long, node long, n int, fp long, bins binary, prefix array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and shingles of the nodes of `wanted` (first: a row of `docs` that has the node's words)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = [_shingles(t, shingle) for t in batch.column(0).slice(at, SLICE).to_pylist()]
                ends = np.cumsum([0, *(len(x) for _, x in made)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in made])))], names=["node", "shingles"])

    rows = wanted.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    src = only(docs, doc_id="doc_id", text="text")
    # The ids are hashed, so that texts are streamed past them and not sorted.
    theirs = src.join(rows.hint("shuffle_hash"), src["doc_id"].eqNullSafe(rows["__id"]) & (F.xxhash64(src["text"]) == rows["__hash"]), "left_semi")
    return theirs.select("text").mapInArrow(of, "node long, shingles array<long>").dropDuplicates(["node"])


def near_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets have a Jaccard similarity of 0.8 or more, written."""
    pairs = materialise(pairs, "near-pairs")
    names = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = materialise(nodes.select("node", "first").join(names, "node", "left_semi"), "near-wanted")
    sets = materialise(shingle_sets(docs, wanted, shingle), "near-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    # |a & b| / |a | b| >= 4 / 5 where 9 |a & b| >= 4 (|a| + |b|).
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    found = materialise(both.where(9 * F.size(F.array_intersect("of_a", "of_b")) >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"), "near-links")
    discard(pairs, wanted, sets)
    return found


def jaccard_links(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """a, b: links that join all `nodes` (node, distinct; first, n, fp, bins, prefix) with a similarity of 0.8 or more, and no others."""
    rows = nodes.select(F.explode("prefix").alias("key"), "n", "node", "fp")
    tested = materialise(rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_buckets(_led), PAIRS), "near-buckets")
    found = near_pairs(_one_each(tested.where("key is null")), docs, nodes, shingle)
    left = tested.where("key is not null").select("key", "n", F.col("a").alias("node"), F.col("b").alias("fp"))
    for test in (_nearest, _across):
        pairs = _between_classes(left, nodes, found).mapInArrow(_buckets(test), PAIRS)
        pairs = _one_each(pairs) if test is _nearest else pairs.select("a", "b").distinct()
        found = found.unionAll(near_pairs(pairs, docs, nodes, shingle))
    discard(tested)
    return found


#: What a function of buckets gives: pairs a, b with their distance as n and no key, or rows key, n, node as a, fp as b.
PAIRS = "key long, n int, a long, b long"


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of the pairs (n, a, b) of each b the one of the least distance n."""
    return pairs.groupBy("b").agg(F.min(F.struct("n", "a")).alias("best")).select("best.a", "b")


def _between_classes(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Of the bucket rows (key, n, node, fp) those of buckets in which several classes of the links `found` meet, with bins and root, dealt and sorted by key. All nodes
    of a class are needed: any of them may be the one near to another class."""
    roots = components(found).withColumnRenamed("node", "linked")
    rooted = rows.join(roots, rows["node"] == roots["linked"], "left").select("key", "n", "node", "fp", F.coalesce("root", "node").alias("root"))
    bucket = Window.partitionBy("key")
    mixed = rooted.withColumns({"least": F.min("root").over(bucket), "most": F.max("root").over(bucket)}).where("least <> most").select("key", "n", "node", "fp", "root")
    with_bins = mixed.join(nodes.select("node", "bins"), "node").select("key", "n", "node", "fp", "root", "bins")
    return with_bins.repartition("key").sortWithinPartitions("key", "n", "node")


def _near(sizes: np.ndarray, fps: np.ndarray, at: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows `others` may be near copies of rows `at`, whose sizes are no greater: the sizes' ratio, then a chain of segments within its share of NEAR from some start, then the distance, which comes too."""
    differ = fps[at] ^ fps[others]
    segments = [np.bitwise_count(differ & _MASKS[i, 0]).astype(np.int16) for i in range(5)]
    chained = np.zeros(len(differ), bool)
    for start in range(5):
        total, holds = np.zeros(len(differ), np.int16), np.ones(len(differ), bool)
        for k in range(5):
            total = total + segments[(start + k) % 5]
            holds &= total <= NEAR * (k + 1) // 5
        chained |= holds
    return (5 * sizes[at] >= 4 * sizes[others]) & (chained | (sizes[at] < SURE)), sum(segments)


@dataclass
class Bucket:
    """Rows of one key with sizes in ascending order."""

    sizes: np.ndarray
    fps: np.ndarray
    roots: np.ndarray | None = None
    bins: list[bytes] | None = None

    def near(self, i: int) -> np.ndarray:
        """Rows after row i that may be near copies of it."""
        rows = np.arange(i + 1, max(i + 1, int(np.searchsorted(self.sizes, 5 * int(self.sizes[i]) // 4, "right"))))
        return rows[_near(self.sizes, self.fps, np.full(len(rows), i), rows)[0]]

    def comparable(self) -> bool:
        """Whether any two rows have sizes that near copies may have."""
        return bool((5 * self.sizes[:-1].astype(np.int64) >= 4 * self.sizes[1:]).any())

    def comparable_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, later row) whose sizes near copies may have, of different roots where rows have one, sorted; about BLOCK of them at once."""
        reach = np.searchsorted(self.sizes, 5 * self.sizes.astype(np.int64) // 4, "right")
        counts = np.maximum(reach - np.arange(len(reach)) - 1, 0)
        upto = np.cumsum(counts)
        start = 0
        while start < len(counts):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BLOCK, "right")))
            n = counts[start:stop]
            left = np.repeat(np.arange(start, stop), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            if self.roots is not None:
                apart = self.roots[left] != self.roots[right]
                left, right = left[apart], right[apart]
            yield left, right
            start = stop

    def near_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of the pairs that may be near copies by the chain."""
        for left, right in self.comparable_pairs():
            ok = _near(self.sizes, self.fps, left, right)[0]
            yield left[ok], right[ok]

    def folded(self) -> dict[int, tuple[int, np.ndarray]]:
        """By number of words of bins: the first row that has so many, and the bins of the rows that have so many or twice as many, the latter folded onto them. Rows whose sizes are in the ratio have no others."""
        lengths = np.array([len(b) // 8 for b in self.bins])
        out = {}
        for n in np.unique(lengths).tolist():
            start, middle, end = (int(np.searchsorted(lengths, *at)) for at in ((n, "left"), (n, "right"), (2 * n, "right")))
            own = np.frombuffer(b"".join(self.bins[start:middle]), np.uint64).reshape(-1, n)
            longer = np.frombuffer(b"".join(self.bins[middle:end]), np.uint64).reshape(-1, 2 * n)
            out[n] = start, np.concatenate((own, longer[:, :n] ^ longer[:, n:]))
        return out

    def open_pairs(self) -> Iterator[np.ndarray]:
        """(row, later row, how many shingles at least are in one of them only) for all pairs that may be near by sizes and bins, a block at a time."""
        folded = self.folded()
        words = np.array([len(b) // 8 for b in self.bins])
        for left, right in self.comparable_pairs():
            for n in np.unique(words[left]).tolist():
                start, rows = folded[n]
                of = words[left] == n
                a, b = left[of], right[of]
                apart = np.zeros(len(a), np.int64)
                for at in range(0, len(a), BIN_BLOCK):
                    part = slice(at, at + BIN_BLOCK)
                    apart[part] = np.bitwise_count(rows[a[part] - start] ^ rows[b[part] - start]).sum(1, dtype=np.int64)
                # |a & b| / |a | b| >= 4 / 5 where 9 times what only one has <= |a| + |b|.
                holds = 9 * apart <= self.sizes[a].astype(np.int64) + self.sizes[b]
                yield np.stack((a, b, apart))[:, holds]


def _led(bucket: Bucket) -> tuple[Iterable[np.ndarray], bool]:
    """Pairs (leader, row, distance), each row with the first leader near it by the chain, and whether pairs may be near that the chain or the choice of a leader leaves out."""
    free, out = np.ones(len(bucket.sizes), bool), []

    def lead(i: int, rows: np.ndarray) -> None:
        rows = rows[free[rows]]
        if free[i] and len(rows):
            out.append(np.stack((np.full(len(rows), i), rows, np.bitwise_count(bucket.fps[i] ^ bucket.fps[rows]))))
            free[rows] = False

    if len(free) <= LED_AT_ONCE:
        for left, right in bucket.near_pairs():
            heads = np.flatnonzero(np.diff(left, prepend=-1))
            for i, rows in zip(left[heads].tolist(), np.split(right, heads[1:]), strict=False):
                lead(i, rows)
    else:
        # Of a large group most rows have a leader soon; only leaders are tested with what follows.
        for i in range(len(free) - 1):
            if free[i]:
                lead(i, bucket.near(i))
    return out, bucket.comparable()


def _nearest(bucket: Bucket) -> tuple[Iterable[np.ndarray], bool]:
    """Pairs (row, row, distance): each row's partner of another root that is nearest by the bins."""
    partner, least = np.full(len(bucket.sizes), -1, np.int64), np.zeros(len(bucket.sizes), np.int64)
    for a, b, apart in bucket.open_pairs():
        one, other, far = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((apart, apart))
        order = np.lexsort((other, far, one))
        first = order[np.flatnonzero(np.diff(one[order], prepend=-1))]
        rows, other, far = one[first], other[first], far[first]
        better = (partner[rows] < 0) | (far < least[rows])
        partner[rows[better]], least[rows[better]] = other[better], far[better]
    rows = np.flatnonzero(partner >= 0)
    return [np.stack((partner[rows], rows, least[rows]))], False


def _across(bucket: Bucket) -> tuple[Iterable[np.ndarray], bool]:
    """All pairs (row, row, distance) that may be near and have different roots."""
    return bucket.open_pairs(), False


#: Rows of a bucket whose pairs are all tested at once to find leaders.
LED_AT_ONCE = 256
def _buckets(test):
    """A function of batches sorted by key (columns key, n, node, fp and perhaps root and bins; whole buckets in a task). It gives the pairs that `test` finds in buckets of two rows or more
    and the rows of buckets that `test` leaves open, as PAIRS says."""

    def work(held: list[list]) -> Iterator[pa.RecordBatch]:
        keys, sizes, nodes, fps, *rest = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
        bins = [b for part in held for b in part[5]] if rest else None
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.concatenate((heads, [len(keys)])))
        unsigned = fps.view(np.uint64)
        single = lengths == 2 if not rest else np.zeros(len(heads), bool)
        two = heads[single]
        ok, far = _near(sizes, unsigned, two, two + 1)
        found, n = [np.stack((two, two + 1, far))[:, ok]], 0
        # Of a row's pairs only the one of least distance is tested next, so these buckets stay open too.
        left_open = two[5 * sizes[two].astype(np.int64) >= 4 * sizes[two + 1]]
        open_rows = [np.stack((left_open, left_open + 1), 1).ravel()]

        def told(found: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
            pairs = np.concatenate(found, 1)
            # A group's pairs recur in bucket after bucket.
            ends = np.stack((nodes[pairs[0]], nodes[pairs[1]]))
            order = np.lexsort((pairs[2], ends[0], ends[1]))
            ends, far = ends[:, order], pairs[2][order]
            new = np.ones(len(far), bool)
            new[1:] = (ends[:, 1:] != ends[:, :-1]).any(0)
            (a, b), far = ends[:, new], far[new]
            arrays = [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(keys[at])])]
            arrays += [pa.concat_arrays([pa.array(x.astype(kind)), pa.array(y[at].astype(kind))]) for x, y, kind in ((far, sizes, np.int32), (a, nodes, np.int64), (b, fps, np.int64))]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "n", "a", "b"])

        many = (lengths > 1) & ~single
        for head, length in zip(heads[many].tolist(), lengths[many].tolist(), strict=True):
            rows = slice(head, head + length)
            pairs, more = test(Bucket(sizes[rows], unsigned[rows], *([rest[0][rows], bins[rows]] if rest else [])))
            for part in pairs:
                found.append(part + np.array([[head], [head], [0]]))
                n += part.shape[1]
                if n > BLOCK:
                    yield told(found, np.zeros(0, np.int64))
                    found, n = [np.zeros((3, 0), np.int64)], 0
            if more:
                open_rows.append(np.arange(head, head + length))
        yield told(found, np.concatenate(open_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole(batches, work)

    return run


def _whole(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """What `work` gives for whole buckets of rows that come sorted by key, the first column; about BUCKET_ROWS at once. Columns are arrays, binary ones lists."""
    held: list[list] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        n += batch.num_rows
        if n >= BUCKET_ROWS and (cut or (held and held[-1][0][-1] != columns[0][0])):
            yield from work([*held, [c[:cut] for c in columns]] if cut else held)
            held, n = [], batch.num_rows - cut
            columns = [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield from work(held)


def _ring_mask(start: int, links: int) -> np.uint64:
    mask = 0
    for i in range(links):
        s = (start + i) % 5
        mask |= ((1 << WIDTHS[s]) - 1) << OFFSETS[s]
    return np.uint64(mask)


_MASKS = np.array([[_ring_mask(i, n) for n in range(1, 6)] for i in range(5)], dtype=np.uint64)


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """key, changed (0: the fingerprint's own key, 1: one bit of the second link set), fp: some 37 rows per fingerprint of `nodes` (node)."""
    fp = F.col("node")
    seg = [F.shiftrightunsigned(fp, OFFSETS[i]).bitwiseAND((1 << WIDTHS[i]) - 1) for i in range(5)]
    groups = []
    for i in range(5):
        j = (i + 1) % 5
        head = F.lit(i * (1 << 26)) + seg[i] * (1 << 13)
        groups.append(F.struct((head + seg[j]).cast("long").alias("key"), F.lit(0).cast("byte").alias("changed")))
        for b in range(WIDTHS[j]):
            groups.append(F.when(seg[j].bitwiseAND(1 << b) == 0, F.struct((head + seg[j] + (1 << b)).cast("long").alias("key"), F.lit(1).cast("byte").alias("changed"))))
    return nodes.select(fp.alias("fp"), F.explode(F.array_compact(F.array(*groups))).alias("k")).select("k.key", "k.changed", "fp")


def _close(start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether differences x pass the chain's third and fourth link and the full distance."""
    ok = np.bitwise_count(x & _MASKS[start, 2]) <= 2
    ok &= np.bitwise_count(x & _MASKS[start, 3]) <= 3
    ok &= np.bitwise_count(x) <= DISTANCE
    return ok


def _forest(start: int, own: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a large bucket between its rows `own` and all, without those inside what is joined already."""
    fps, inverse = np.unique(rows, return_inverse=True)
    label = np.arange(len(fps))
    starts = np.full(len(fps), start)
    out = []
    for at in np.unique(inverse[own]):
        near = np.flatnonzero(_close(starts, fps ^ fps[at]))
        roots, which = np.unique(label[near], return_index=True)
        if len(roots) > 1:
            out.append((np.full(len(roots), fps[at]), fps[near[which]]))
            label[np.isin(label, roots)] = roots[0]
        if not label.any():
            break
    return out


def bucket_links(keys: np.ndarray, changed: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of fingerprints in whole buckets; rows are sorted by key, then changed."""
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(keys)])))
    live = (sizes > 1) & (changed[heads] == 0)
    heads, sizes = heads[live], sizes[live]
    left, right = [], []
    large = sizes > SMALL
    for head, size in zip(heads[large].tolist(), sizes[large].tolist(), strict=True):
        rows = slice(head, head + size)
        for a, b in _forest(int(keys[head] >> 26), np.flatnonzero(changed[rows] == 0), fps[rows]):
            left.append(a)
            right.append(b)
    heads, sizes = heads[~large], sizes[~large]
    for step in range(SMALL):  # the row `step` of each small bucket against all of that bucket
        has = sizes > step
        h, n = heads[has], sizes[has]
        keep = changed[h + step] == 0
        h, n = h[keep], n[keep]
        for lo in range(0, len(h), BLOCK // SMALL):
            hh, nn = h[lo : lo + BLOCK // SMALL], n[lo : lo + BLOCK // SMALL]
            rows = np.repeat(hh - np.concatenate(([0], np.cumsum(nn)[:-1])), nn) + np.arange(nn.sum())
            own = np.repeat(hh + step, nn)
            ok = (fps[own] != fps[rows]) & _close(keys[own] >> 26, fps[own] ^ fps[rows])
            left.append(fps[own][ok])
            right.append(fps[rows][ok])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(left) if left else empty), (np.concatenate(right) if right else empty)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(held: list[list]) -> Iterator[pa.RecordBatch]:
        keys, changed, fps = (np.concatenate(c) for c in zip(*held, strict=True))
        a, b = bucket_links(keys, changed, fps.view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _whole(batches, work)


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between `nodes` (node: a fingerprint, distinct) that join all those at distance 4 or less."""
    return bucket_rows(nodes).repartition("key").sortWithinPartitions("key", "changed").mapInArrow(_stream, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) per row of `docs`."""
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(marked.groupBy(F.col("fp").alias("node")).agg(_first()), "fingerprint-nodes")
    classes = _classes(nodes, links(nodes.select("node")))
    return marked.join(classes, marked["fp"] == classes["of"], "left").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def _first():
    """doc_id and text_hash of a group's first row; ids that are null come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """of (a node) and least (the least `first` of its class). nodes: node, first; edges: a, b. Both sides of the last join are read from files, so that a class of any size can be split there."""
    roots = components(edges).withColumnRenamed("node", "linked")
    rooted = materialise(nodes.join(roots, nodes["node"] == roots["linked"], "left").select("node", "first", F.coalesce("root", "node").alias("root")), "class-roots")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least")), "class-least")
    return rooted.join(least, "root").select(F.col("node").alias("of"), "least")


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of `docs` of each class of near copies: that of the smallest id; of rows that repeat this id and its text, one."""
    marked = materialise(signatures(docs, shingle), "signatures")
    nodes = materialise(marked.groupBy("node").agg(_first(), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bins").alias("bins"), F.min("prefix").alias("prefix")), "near-nodes")
    repeated = materialise(marked.groupBy(F.xxhash64("doc_id").alias("__id_hash"), F.col("text_hash").alias("__text_hash")).agg(F.count("*").alias("n")).where("n > 1"), "near-repeated")
    discard(marked)
    least = _classes(nodes.select("node", "first"), jaccard_links(docs, nodes, shingle)).select("least").distinct()
    keep = materialise(least.select(F.xxhash64("least.doc_id").alias("__id_hash"), F.col("least.text_hash").alias("__text_hash")).distinct(), "near-kept")
    discard(nodes)
    row = ["__id_hash", "__text_hash"]
    hashed = docs.withColumns({"__id_hash": F.xxhash64(docs["doc_id"]), "__text_hash": F.xxhash64(docs["text"])})
    # Texts are shuffled once and streamed past the ids that stay; only rows that repeat an id and its text are made distinct.
    once = hashed.join(keep.join(repeated, row, "left_anti").hint("shuffle_hash"), row, "left_semi")
    several = hashed.join(keep.join(repeated, row, "left_semi"), row, "left_semi").dropDuplicates(row)
    return once.unionByName(several).select(*[F.col(c) for c in docs.columns])
