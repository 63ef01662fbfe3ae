"""Relational operators over symbol and node tables. No Python runs here beyond the one parse; what stays inside a symbol is read from its tree column, without a join."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import symbols as S
from ..kernel import grammar as G
from ..kernel.parser import SymbolError, demangle
from ..kernel.tree import display
from ..kernel.wording import classes
from ..sources.shared import materialise


def spread(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct symbols, dealt to enough tasks for the grammar work that follows: repeats go before the shuffle, and a stated number of partitions is not coalesced although symbols are short."""
    spark = symbols.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return symbols.select(F.col(column).alias("symbol")).distinct().repartition(n, "symbol")


def parse(symbols: DataFrame, column: str = "symbol", distinct: bool = True) -> DataFrame:
    """symbol and the fields of the parse; each distinct symbol is parsed once."""
    source = spread(symbols, column) if distinct else symbols.select(F.col(column).alias("symbol"))
    return source.withColumn("d", S.demangle(F.col("symbol"))).select("symbol", "d.*")


def nodes(demangled: DataFrame) -> DataFrame:
    """One row per node occurrence."""
    return demangled.where("ok").select("symbol", F.inline("tree"))


def node_kinds(spark: SparkSession) -> DataFrame:
    """The dimension of kinds: a fixed number of rows, so a broadcast of it is bounded."""
    sets = {"is_decl_name": G.DECL_NAMES, "is_context": G.CONTEXTS, "is_any_generic": G.ANY_GENERICS, "is_entity": G.ENTITY_KINDS, "is_requirement": G.REQUIREMENT_KINDS, "is_function_attr": G.FUNCTION_ATTRIBUTES, "is_macro_expansion": G.MACRO_CONTEXTS, "is_existential": G.EXISTENTIALS, "is_simple_type": G.SIMPLE_TYPES, "is_protocol": G.PROTOCOLS, "is_operator": G.OPERATORS}
    rows = [(kind, cls, display(kind), *(kind in s for s in sets.values())) for kind, cls in classes().items()]
    return spark.createDataFrame(rows, "kind string, class string, display_name string, " + ", ".join(f"{n} boolean" for n in sets))


def kind_histogram(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("kind").agg(F.count("*").alias("n"))


def depth_histogram(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("depth").agg(F.count("*").alias("n"))


def edge_histogram(demangled: DataFrame) -> DataFrame:
    """parent_kind, kind, n: how often a kind stands below another."""
    below = F.filter("tree", lambda n: n["parent"] >= 0)
    edges = F.transform(below, lambda n: F.struct(F.get("tree", n["parent"])["kind"].alias("parent_kind"), n["kind"].alias("kind")))
    return demangled.where("ok").select(F.inline(edges)).groupBy("parent_kind", "kind").agg(F.count("*").alias("n"))


def traverse(demangled: DataFrame, order: str) -> DataFrame:
    """symbol, step, kind, text, idx: the nodes of each tree in an order."""
    ordered = demangled.where("ok").select("symbol", F.posexplode(S.in_order(F.col("tree"), order)).alias("step", "n"))
    return ordered.select("symbol", "step", "n.kind", "n.text", "n.idx")


def descendants(demangled: DataFrame, *kinds: str) -> DataFrame:
    """symbol, a_pre and a_kind (an ancestor of one of `kinds`) and the columns of each node below it: a slice of the tree, which is numbered in preorder."""
    inside = lambda a: F.slice("tree", a["pre"] + 2, a["size"] - 1)
    pairs = F.transform(F.filter("tree", lambda n: n["kind"].isin(*kinds)), lambda a: F.transform(inside(a), lambda n: F.struct(a["pre"].alias("a_pre"), a["kind"].alias("a_kind"), n.alias("n"))))
    return demangled.where("ok").select("symbol", F.inline(F.flatten(pairs))).select("symbol", "a_pre", "a_kind", "n.*")


def owners(demangled: DataFrame) -> DataFrame:
    """symbol, module: the first module of each symbol that has one."""
    return demangled.where("ok").select("symbol", S.first_of(F.col("tree"), "module")["text"].alias("module")).where("module is not null")


def intern(demangled: DataFrame) -> DataFrame:
    """Distinct subtrees: node_hash, kind, payload_kind, text, idx, kids (hashes), height. Symbols drop repeats before the one shuffle."""
    kids = lambda n: F.transform(n["kids"], lambda k: F.get(F.col("tree"), k)["node_hash"])
    own = F.array_distinct(F.transform("tree", lambda n: F.struct(n["node_hash"].alias("node_hash"), n["kind"].alias("kind"), n["text"].alias("text"), n["idx"].alias("idx"), kids(n).alias("kids"), n["height"].alias("height"))))
    return _with_payload(demangled.where("ok").select(F.inline(own)).dropDuplicates(["node_hash"]))


def _with_payload(flat: DataFrame) -> DataFrame:
    n = F.size("kids")
    payload = F.when(n == 1, "one").when(n == 2, "two").when(n > 2, "many").when(F.col("text").isNotNull(), "text").when(F.col("idx").isNotNull(), "index").otherwise("none")
    return flat.withColumn("payload_kind", payload)


def intern_symbols(symbols: DataFrame, column: str = "symbol", held: int = 200_000) -> DataFrame:
    """Distinct subtrees straight from symbols, as `intern` gives them: trees stay in Python, and a task sends a subtree again only after `held` others. For bulk builds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows: list[tuple] = []
            for symbol in batch.column(0).to_pylist():
                if len(seen) > held:
                    seen = set()
                new = subtrees(symbol, seen) if symbol is not None else ()
                rows.extend(new)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUBTREE, strict=True)], names=[f.name for f in _SUBTREE])

    found = spread(symbols, column).mapInArrow(run, "node_hash string, kind string, text string, idx decimal(20,0), kids array<string>, height int")
    return _with_payload(found.dropDuplicates(["node_hash"]))


_SUBTREE = pa.schema([("node_hash", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("idx", pa.decimal128(20, 0)), ("kids", pa.list_(pa.string())), ("height", pa.int32())])


def subtrees(symbol: str, seen: set[str]) -> list[tuple]:
    """Rows of _SUBTREE for the symbol's subtrees whose digest is not in `seen`, which grows by them; none for a symbol that can't be parsed."""
    try:
        root = demangle(symbol)
    except (SymbolError, RecursionError):
        return []
    root.digest()
    heights: dict[int, int] = {}
    out, stack = [], [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            if id(node) not in heights:
                stack.append((node, True))
                stack.extend((k, False) for k in node.kids)
            continue
        heights[id(node)] = max((heights[id(k)] + 1 for k in node.kids), default=0)
        digest = node.digest()
        if digest not in seen:
            seen.add(digest)
            out.append((digest, node.kind, node.text, None if node.index is None else Decimal(node.index), [k.digest() for k in node.kids], heights[id(node)]))
    return out


def roots(demangled: DataFrame) -> DataFrame:
    """symbol, root_hash."""
    return demangled.where("ok").select("symbol", F.get("tree", F.lit(0))["node_hash"].alias("root_hash"))


def number(store: DataFrame) -> DataFrame:
    """The store with node_id, dense from 0, children before parents: by height, then hash; at most 4096 buckets a height are counted, none is sorted whole."""
    keyed = store.withColumn("bucket", F.conv(F.substr("node_hash", F.lit(1), F.lit(3)), 16, 10).cast("int"))
    counts = keyed.groupBy("height", "bucket").agg(F.count("*").alias("c"))
    start = F.coalesce(F.sum("c").over(Window.orderBy("height", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", start).drop("c")
    row = F.row_number().over(Window.partitionBy("height", "bucket").orderBy("node_hash")) - 1
    return keyed.withColumn("row", row).join(starts, ["height", "bucket"]).withColumn("node_id", F.col("start") + F.col("row")).drop("bucket", "row", "start")


def store_counts(store: DataFrame) -> DataFrame:
    """n_leaves and n_subtrees: distinct nodes without and with children."""
    leaf = F.size("kids") == 0
    return store.agg(F.count_if(leaf).alias("n_leaves"), F.count_if(~leaf).alias("n_subtrees"))


def store_metrics(store: DataFrame) -> DataFrame:
    """n_nodes, n_edges (children of nodes with three or more), text_bytes (each text once), flat_bytes."""
    texts = store.where("text is not null").select("text").distinct().agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"))
    sizes = store.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(F.when(F.size("kids") > 2, F.size("kids"))), F.lit(0)).cast("long").alias("n_edges"))
    both = sizes.withColumn("one", F.lit(1)).join(texts.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("flat_bytes", 12 * F.col("n_nodes") + 4 * F.col("n_edges") + F.col("text_bytes"))


def materialize(store: DataFrame, root_hashes: DataFrame) -> DataFrame:
    """symbol, path (ordinals from the root), kind, text, idx of each occurrence below given roots (symbol, root_hash): one equi-join a level, each written and read again, until a level is empty."""
    small = store.select("node_hash", "kind", "text", "idx", "kids")
    level = root_hashes.select("symbol", F.col("root_hash").alias("node_hash"), F.array().cast("array<int>").alias("path"))
    found: list[DataFrame] = []
    while not found or not found[-1].isEmpty():
        at = materialise(level.join(small, "node_hash").select("symbol", "path", "kind", "text", "idx", "kids"), "level")
        found.append(at)
        level = at.select("symbol", "path", F.posexplode("kids").alias("i", "node_hash")).select("symbol", "node_hash", F.concat("path", F.array("i")).alias("path"))
    levels = store.sparkSession.read.schema(found[0].schema).parquet(*[at.stored_at for at in found])
    return levels.select("symbol", "path", "kind", "text", "idx")


def equal_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of symbols (symbol, other) of two sets with equal trees."""
    right = roots(b).select(F.col("symbol").alias("other"), F.col("root_hash").alias("h"))
    left = roots(a)
    return left.join(right, left["root_hash"] == right["h"]).select("symbol", "other")


def corpus_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols of `a` whose tree is none of `b`'s."""
    return roots(a).join(roots(b).select("root_hash"), "root_hash", "left_anti").select("symbol")


def corpus_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trees (root_hash) that occur in both sets, each once."""
    return roots(a).select("root_hash").intersect(roots(b).select("root_hash"))


def corpus_surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trees (root_hash) of `a` as often as they occur there more than in `b`."""
    return roots(a).select("root_hash").exceptAll(roots(b).select("root_hash"))


def top_symbols(symbols: DataFrame, k: int, options: str = "default") -> DataFrame:
    """The k symbols with the longest text; ties by symbol."""
    printed = symbols.select("symbol", S.print_symbol(F.col("symbol"), options).alias("printed")).where("printed is not null")
    return printed.withColumn("n_chars", F.length("printed").cast("long")).orderBy(F.desc("n_chars"), "symbol").limit(k)
