"""Column functions on symbols. Grammar work runs in Arrow UDFs over batches, each distinct value once a batch; errors are values, never task failures."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..kernel import encoder, printer, punycode, tree, types
from ..kernel.parser import Resolver, SymbolError, prefix_of
from ..kernel.parser import demangle as parse
from ..kernel.tree import Tree

#: Prefixes of the current grammar, for JVM-side filters that stand before the UDFs.
PREFIX = r"^(_T0|_\$[Sse]|\$[Sse]|@__swiftmacro_)"
#: Trees of more occurrences than this become the error `tooLarge`.
MAX_OCCURRENCES = 200_000


def _each(values: pa.Array, one: Callable, kind: pa.DataType) -> pa.Array:
    memo: dict = {}
    out = []
    for v in values.to_pylist():
        if v is None:
            out.append(None)
            continue
        key = v if isinstance(v, (str, bytes)) else repr(v)
        if key not in memo:
            memo[key] = one(v)
        out.append(memo[key])
    return pa.array(out, kind)


def rows_of(root: Tree) -> list[dict]:
    rows = tree.flatten(root, MAX_OCCURRENCES)
    for r in rows:
        if r["idx"] is not None:
            r["idx"] = Decimal(r["idx"])
    return rows


def demangled(symbol: str, is_type: bool = False, resolver: Resolver | None = None) -> dict:
    try:
        rows = rows_of(parse(symbol, is_type, resolver))
    except SymbolError as e:
        return {"ok": False, "error": {"code": e.code, "at": e.at, "wanted": e.wanted}, "flavor": None, "tree": None}
    except (OverflowError, RecursionError):
        return {"ok": False, "error": {"code": "tooLarge", "at": None, "wanted": None}, "flavor": None, "tree": None}
    return {"ok": True, "error": None, "flavor": "embedded" if (prefix_of(symbol) or "") in ("$e", "_$e") else "default", "tree": rows}


def _text(one: Callable[[str], str | None]):
    """A string UDF; what cannot be read gives null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        def safe(v: str) -> str | None:
            try:
                return one(v)
            except (ValueError, RecursionError):
                return None

        return _each(values, safe, pa.string())

    return run


def flags_of(options: str | int) -> int:
    return options if isinstance(options, int) else printer.PRESETS[options] if options in printer.PRESETS else printer.options(options)


# -- without Python -------------------------------------------------------------------------------


def is_symbol(symbol: Column) -> Column:
    return symbol.rlike(PREFIX)


def strip_prefix(symbol: Column) -> Column:
    return F.regexp_replace(symbol, PREFIX, "")


def param_name(depth: Column, index: Column) -> Column:
    """The name of a generic parameter: base-26 letters of the index, lowest first, then a depth that is not 0."""
    number = index.cast("decimal(20,0)")
    letter = lambda k: F.char((F.lit(65) + F.floor(number / F.lit(26**k).cast("decimal(20,0)")) % 26).cast("long"))
    letters = [letter(0), *(F.when(number >= 26**k, letter(k)).otherwise("") for k in range(1, 14))]
    return F.concat(*letters, F.when(depth == 0, "").otherwise(depth.cast("string")))


def hexadecimal(value: Column) -> Column:
    return F.hex(value.cast("long"))


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def find(nodes: Column, *kinds: str) -> Column:
    """All occurrences of the kinds, in preorder."""
    return F.filter(nodes, lambda n: n["kind"].isin(*kinds))


def first_of(nodes: Column, *kinds: str) -> Column:
    return F.get(find(nodes, *kinds), F.lit(0))


def contains_kind(nodes: Column, *kinds: str) -> Column:
    return F.exists(nodes, lambda n: n["kind"].isin(*kinds))


def in_order(nodes: Column, order: str) -> Column:
    """The tree's nodes in `preorder`, `postorder`, `levelorder` or `inorder` (which leaves out third and later children)."""
    if order == "preorder":
        return nodes
    rank = {"postorder": lambda n: n["pre"] - n["depth"] + n["size"], "levelorder": lambda n: n["depth"].cast("long") * (1 << 31) + n["pre"], "inorder": lambda n: n["ino"]}[order]
    ranked = F.filter(nodes, lambda n: n["ino"].isNotNull()) if order == "inorder" else nodes
    keyed = F.transform(ranked, lambda n: F.struct(rank(n).cast("long").alias("k"), n["pre"].alias("p")))
    return F.transform(F.sort_array(keyed), lambda x: F.get(nodes, x["p"]))


def identifier_of(nodes: Column, node: Column | None = None) -> Column:
    """The declared name in the subtree of `node` (the root): a direct second child, else the first operator, else the first identifier, else the first private name."""
    if node is None:
        node = F.get(nodes, F.lit(0))
    second = child_at(nodes, node, 1)
    nodes = F.transform(nodes, lambda n: F.when((n["pre"] >= node["pre"]) & (n["pre"] < node["pre"] + node["size"]), n))
    private = lambda n: child_at(nodes, n, 1)["text"]
    operator, plain, hidden = first_of(nodes, *tree.OPERATORS), first_of(nodes, "identifier"), first_of(nodes, "privateDeclName")
    found = F.when(operator.isNotNull(), operator["text"]).when(plain.isNotNull(), plain["text"]).otherwise(private(hidden))
    return F.when(second["kind"] == "identifier", second["text"]).when(second["kind"] == "privateDeclName", private(second)).otherwise(found)


def child_at(nodes: Column, node: Column, i: int) -> Column:
    """The i-th child of `node`, null if there is none."""
    return F.get(nodes, F.get(node["kids"], F.lit(i)))


def children_of(nodes: Column, node: Column, start: int = 0, stop: int | None = None) -> Column:
    """The children of `node` from `start` up to `stop`, as far as there are any."""
    kids = node["kids"]
    count = F.greatest(F.least(F.size(kids), F.lit(stop if stop is not None else 1 << 30)) - start, F.lit(0))
    return F.transform(F.slice(kids, F.lit(start + 1), count), lambda k: F.get(nodes, k))


def is_kind(node: Column, *kinds: str) -> Column:
    return node["kind"].isin(*kinds)


def is_identifier(node: Column, text: str) -> Column:
    return (node["kind"] == "identifier") & node["text"].eqNullSafe(F.lit(text))


def is_standard_module(node: Column) -> Column:
    return (node["kind"] == "module") & node["text"].eqNullSafe(F.lit("Swift"))


def structural_hash(nodes: Column) -> Column:
    """Digest of the whole tree; equal digests mean structurally equal trees."""
    return F.get(nodes, F.lit(0))["node_hash"]


def dump(nodes: Column) -> Column:
    """Indented lines `kind=..., text="...", index=...`, at most 8 MiB."""
    line = lambda n: F.concat(F.repeat(F.lit("  "), n["depth"]), F.lit("kind="), F.upper(F.substr(n["kind"], F.lit(1), F.lit(1))), F.substr(n["kind"], F.lit(2)), F.coalesce(F.concat(F.lit(', text="'), n["text"], F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(", index="), n["idx"].cast("string")), F.lit("")))
    return F.substr(F.array_join(F.transform(nodes, line), "\n"), F.lit(1), F.lit(8 << 20))


# -- kernel ---------------------------------------------------------------------------------------


def demangle(symbol: Column, is_type: bool = False, resolver: Resolver | None = None) -> Column:
    """struct(ok, error, flavor, tree). The function is marked non-deterministic so that it runs once, however many of its fields are used."""

    @F.arrow_udf(schema.DEMANGLED_DDL)
    def run(values: pa.Array) -> pa.Array:
        return _each(values, lambda v: demangled(v, is_type, resolver), schema.DEMANGLED)

    return run.asNondeterministic()(symbol)


def print_symbol(symbol: Column, options: str | int = "default") -> Column:
    """Text of a symbol, null if it can't be parsed; parse and print in one pass, without a tree column."""
    flags = flags_of(options)
    return _text(lambda v: printer.text_of(parse(v), flags))(symbol)


def texts_of(symbol: Column, *kinds: str) -> Column:
    """The text of the first node of each kind, in order of `kinds`; null for a symbol that can't be parsed. One pass that makes no tree column: for bulk access to a few fields."""

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        def one(v: str) -> list[str | None] | None:
            try:
                root = parse(v)
            except (SymbolError, RecursionError):
                return None
            found: dict[str, str | None] = {}
            for node in root.instances():
                if node.kind in kinds and node.kind not in found:
                    found[node.kind] = node.text
                    if len(found) == len(kinds):
                        break
            return [found.get(k) for k in kinds]

        return _each(values, one, pa.list_(pa.string()))

    return run.asNondeterministic()(symbol)


def _of_tree(kind: pa.DataType, ddl: str, one: Callable[[Tree], object]):
    @F.arrow_udf(ddl)
    def run(values: pa.Array) -> pa.Array:
        def safe(rows: list[dict]) -> object:
            try:
                return one(tree.assemble(rows))
            except (ValueError, RecursionError):
                return None

        return pa.array([None if v is None else safe(v) for v in values.to_pylist()], kind)

    return run


def print_tree(nodes: Column, options: str | int = "default") -> Column:
    flags = flags_of(options)
    return _of_tree(pa.string(), "string", lambda t: printer.text_of(t, flags))(nodes)


def spans(nodes: Column, options: str | int = "default") -> Column:
    """Text in pieces, each with its state (identifier, module, functionParameters), kinds, and the digest of the type reference it is part of."""
    flags = flags_of(options)
    names = ("text", "state", "node_kind", "parent_kind", "scope_hash")
    return _of_tree(schema.SPANS, schema.SPANS_DDL, lambda t: [dict(zip(names, s, strict=True)) for s in printer.spans_of(t, flags)])(nodes)


def render(nodes: Column, target: Callable[[], printer.Target], options: str | int = "default") -> Column:
    """What a caller's print target makes of each tree: str() of a new target that the tree was printed into; null for a text that is too large."""
    flags = flags_of(options)

    def one(root: Tree) -> str | None:
        try:
            return str(printer.print_into(root, target(), flags))
        except printer.PrintTooLarge:
            return None

    return _of_tree(pa.string(), "string", one)(nodes)


def _mangled(root: Tree, flavor: str, use_punycode: bool) -> dict:
    try:
        return {"mangled": encoder.encode(root, flavor, use_punycode), "error": None}
    except encoder.SymbolEncodeError as e:
        return {"mangled": None, "error": str(e)}


def mangle(nodes: Column, flavor: str = "default", use_punycode: bool = True) -> Column:
    """struct(mangled, error) of a tree column."""
    return _of_tree(schema.MANGLED, schema.MANGLED_DDL, lambda t: _mangled(t, flavor, use_punycode))(nodes)


def can_mangle(nodes: Column) -> Column:
    return mangle(nodes)["mangled"].isNotNull()


def remangle(symbol: Column) -> Column:
    """A symbol in the current form: parsed and encoded again; null if either fails."""
    return _text(lambda v: encoder.encode(parse(v), "embedded" if (prefix_of(v) or "") in ("$e", "_$e") else "default"))(symbol)


def decode_type(symbol: Column, builder: Callable[[], types.Builder] = types.TextBuilder) -> Column:
    """The type a symbol holds, by a builder whose types are strings; null if it holds none."""
    return _text(lambda v: types.decode_symbol(v, builder()))(symbol)


def decode_type_json(symbol: Column) -> Column:
    """The type a symbol holds as a JSON document; `parse_json` makes it a VARIANT."""
    import json

    return _text(lambda v: json.dumps(types.decode_symbol(v, types.JsonBuilder()), sort_keys=True))(symbol)


def rewrite(nodes: Column, visit: Callable[[Tree], Tree]) -> Column:
    """Bottom-up rewriting by a pure function; each distinct subtree is visited once."""
    return _of_tree(schema.TREE, schema.TREE_DDL, lambda t: rows_of(tree.rewrite(t, visit)))(nodes)


def edit(nodes: Column, op: str, *args) -> Column:
    """Non-mutating edits of the root: add, insert, remove, set, reverse, reverse_first, kind, replace."""
    return _of_tree(schema.TREE, schema.TREE_DDL, lambda t: rows_of(tree.edit(t, op, *args)))(nodes)


def shared_dump(symbol: Column) -> Column:
    """The dump in which a repeated instance is shown once."""
    return _text(lambda v: tree.dump(parse(v), shared=True))(symbol)


def generic_depths(symbol: Column) -> Column:
    """map of generic parameter index to greatest depth, null without a parameter count."""

    @F.arrow_udf("array<struct<index:int,depth:int>>")
    def run(values: pa.Array) -> pa.Array:
        def one(v: str) -> list | None:
            try:
                found = tree.generic_depths(parse(v))
            except ValueError:
                return None
            return None if found is None else [{"index": k, "depth": d} for k, d in sorted(found.items())]

        return _each(values, one, pa.list_(pa.struct([("index", pa.int32()), ("depth", pa.int32())])))

    return F.map_from_entries(run(symbol))


def punycode_encode(text: Column) -> Column:
    return _text(punycode.encode)(text)


def punycode_decode(text: Column) -> Column:
    return _text(punycode.decode)(text)
