"""Registered queries of the symbol engine, each with the SQL that gives the same rows.

The test tables hold no symbols, so queries build them from columns: `nom` is the symbol of a type n_name in a module r_name,
`fn` that of a method with two parameters, one per line item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..kernel.parser import demangle, word
from ..kernel.printer import Target
from ..kernel.tree import Tree
from ..operators import nodes as N
from ..sources import symbols as sources
from ..sources.shared import scratch
from ..streaming import symbols as streams
from . import dispatch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The SQL twin of `nominals`.
NOM = "t AS (SELECT n_nationkey, r_name, n_name, '$s' || length(r_name) || r_name || length(n_name) || n_name AS nom FROM region JOIN nation ON r_regionkey = n_regionkey)"


def ident(name: Column) -> Column:
    return F.concat(F.length(name).cast("string"), name)


def nominals(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "r_name", "n_name", F.concat(F.lit("$s"), ident(F.col("r_name")), ident(F.col("n_name"))).alias("nom"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method symbol per line item: module by return flag, type by supplier, name by part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    module, of, name = F.concat(F.lit("M"), F.col("l_returnflag")), F.concat(F.lit("T"), F.col("l_suppkey")), F.concat(F.lit("f"), F.col("l_partkey"))
    return items.select("l_returnflag", F.concat(F.lit("$s"), ident(module), ident(of), F.lit("V"), ident(name), F.lit("yySi_SStF")).alias("symbol"))


METHODS = "m AS (SELECT l_returnflag, 'M' || l_returnflag AS module, 'T' || l_suppkey AS of, 'f' || l_partkey AS name FROM lineitem), s AS (SELECT *, '$s' || length(module) || module || length(of) || of || 'V' || length(name) || name || 'yySi_SStF' AS symbol FROM m)"


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _printed(name: str, symbol: Callable[[Column], Column], sql_symbol: str, sql_text: str, options: str | int = "default") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = nominals(spark, sf_dir).select(symbol(F.col("nom")).alias("symbol"))
        return rows.withColumn("printed", S.print_symbol(F.col("symbol"), options))

    run.__name__ = name
    query(f"WITH {NOM} SELECT {sql_symbol} AS symbol, {sql_text} AS printed FROM t")(run)


def _after(text: str) -> Callable[[Column], Column]:
    return lambda nom: F.concat(nom, F.lit(text))


def _inside(head: str, tail: str) -> Callable[[Column], Column]:
    return lambda nom: F.concat(F.lit("$s" + head), S.strip_prefix(nom), F.lit(tail))


def _simple(name: str, tail: str, before: str = "", after: str = "", options: str | int = "default", text: str = "r_name || '.' || n_name") -> None:
    _printed(name, _after(tail), f"nom || '{tail}'", f"'{before}' || {text} || '{after}'", options)


_simple("nominal_print", "V")
_simple("type_mangling_print", "VD")
_simple("class_print", "C")
_simple("enum_print", "O")
_simple("protocol_print", "P")
_simple("optional_print", "VSgD", "Swift.Optional<", ">")
_simple("optional_sugar_print", "VSgD", "", "?", "sugared")
_simple("metatype_print", "VmD", "", ".Type")
_simple("inout_print", "VzD", "inout ")
_simple("weak_print", "CXwD", "weak ")
_simple("tuple_print", "V_SitD", "(", ", Swift.Int)")
_simple("function_print", "yyF", "", "() -> ()")
_simple("async_throws_print", "yyYaKF", "", "() async throws -> ()")
_simple("result_print", "SiyF", "", "() -> Swift.Int")
_simple("labels_print", "1a1bySi_SStF", "", "(a: Swift.Int, b: Swift.String) -> ()")
_simple("initializer_print", "VACycfC", "", "", text="r_name || '.' || n_name || '.init() -> ' || r_name || '.' || n_name")
_simple("deinit_print", "CfD", "", ".__deallocating_deinit")
_simple("getter_print", "V1aSivg", "", ".a.getter : Swift.Int")
_simple("subscript_print", "VyS2icig", "", ".subscript.getter : (Swift.Int) -> Swift.Int")
_simple("static_print", "V1fyyFZ", "static ", ".f() -> ()")
_simple("closure_print", "yyFyycfU_", "closure #1 () -> () in ", "() -> ()")
_simple("operator_print", "V2eeoiySbAC_ACtFZ", "", "", text="'static ' || r_name || '.' || n_name || '.== infix(' || r_name || '.' || n_name || ', ' || r_name || '.' || n_name || ') -> Swift.Bool'")
_simple("metadata_print", "VN", "type metadata for ")
_simple("descriptor_print", "VMn", "nominal type descriptor for ")
_simple("accessor_print", "VMa", "type metadata accessor for ")
_simple("full_metadata_print", "CMf", "full type metadata for ")
_simple("value_witness_table_print", "VWV", "value witness table for ")
_simple("value_witness_print", "Vwal", "allocateBuffer value witness for ")
_simple("witness_table_print", "VSHsWP", "protocol witness table for ", " : Swift.Hashable in Swift")
_simple("conformance_descriptor_print", "VSHsMc", "protocol conformance descriptor for ", " : Swift.Hashable in Swift")
_simple("outlined_copy_print", "VWOy", "outlined copy of ")
_simple("curry_thunk_print", "yyFTc", "curry thunk of ", "() -> ()")
_simple("dispatch_thunk_print", "yyFTj", "dispatch thunk of ", "() -> ()")
_simple("objc_thunk_print", "yyFTo", "@objc ", "() -> ()")
_simple("partial_apply_print", "yyFTA", "partial apply forwarder for ", "() -> ()")
_simple("partial_apply_short_print", "yyFTA", "partial apply for ", "()", "simplified", text="n_name")
_simple("merged_print", "yyFTm", "merged ", "() -> ()")
_simple("specialization_print", "yyFSi_Tg5", "generic specialization <Swift.Int> of ", "() -> ()")
_simple("generic_signature_print", "yyxlF", "", "<A>(A) -> ()")
_simple("requirement_print", "yyxSHRzlF", "", "<A where A: Swift.Hashable>(A) -> ()")
_simple("simplified_print", "V", options="simplified", text="n_name")
_simple("interface_print", "VSgD", "", "?", "interface")
_simple("options_no_module", "V", options=S.flags_of("default") & ~S.flags_of("qualifyEntities"), text="n_name")
for _name, _tail, _text in (
    ("setter", "V1aSivs", ".a.setter : Swift.Int"),
    ("variable", "V1aSivp", ".a : Swift.Int"),
    ("modify", "V1aSivM", ".a.modify : Swift.Int"),
    ("read", "V1aSivr", ".a.read : Swift.Int"),
    ("willset", "V1aSivw", ".a.willset : Swift.Int"),
    ("didset", "V1aSivW", ".a.didset : Swift.Int"),
    ("subscript_setter", "VyS2icis", ".subscript.setter : (Swift.Int) -> Swift.Int"),
    ("destructor", "Cfd", ".deinit"),
    ("ivar_destroyer", "CfE", ".__ivar_destroyer"),
    ("isolated_deinit", "CfZ", ".__isolated_deallocating_deinit"),
):
    _simple(f"{_name}_print", _tail, "", _text)
for _name, _tail, _text in (
    ("metaclass", "CMm", "metaclass for "),
    ("protocol_descriptor", "PMp", "protocol descriptor for "),
    ("completion_function", "VMr", "type metadata completion function for "),
    ("instantiation_cache", "VMI", "type metadata instantiation cache for "),
    ("instantiation_function", "VMi", "type metadata instantiation function for "),
    ("metadata_pattern", "VMP", "generic type metadata pattern for "),
    ("singleton_cache", "VMl", "type metadata singleton initialization cache for "),
    ("builtin_reflection", "VMB", "reflection metadata builtin descriptor "),
    ("field_reflection", "VMF", "reflection metadata field descriptor "),
    ("base_offset", "CMo", "class metadata base offset for "),
    ("update_function", "CMU", "ObjC metadata update function for "),
    ("requirements_base", "PTL", "protocol requirements base descriptor for "),
    ("nominal_record", "VHn", "nominal type descriptor runtime record for "),
    ("opaque_record", "VHo", "opaque type descriptor runtime record for "),
    ("outlined_consume", "VWOe", "outlined consume of "),
    ("outlined_retain", "VWOr", "outlined retain of "),
    ("outlined_release", "VWOs", "outlined release of "),
    ("outlined_init_take", "VWOb", "outlined init with take of "),
    ("outlined_init_copy", "VWOc", "outlined init with copy of "),
    ("outlined_assign_take", "VWOd", "outlined assign with take of "),
    ("outlined_assign_copy", "VWOf", "outlined assign with copy of "),
    ("outlined_destroy", "VWOh", "outlined destroy of "),
    ("unowned", "VXoD", "unowned "),
    ("unmanaged", "VXuD", "unowned(unsafe) "),
):
    _simple(f"{_name}_print", _tail, _text)
for _name, _tail, _before, _after_ in (
    ("property_descriptor", "V1aSivpMV", "property descriptor for ", ".a : Swift.Int"),
    ("field_offset", "C1aSivpWvd", "direct field offset for ", ".a : Swift.Int"),
    ("static_variable", "V1aSivgZ", "static ", ".a.getter : Swift.Int"),
    ("async_pointer", "yyYaFTu", "async function pointer to ", "() async -> ()"),
    ("suspend_resume", "yyYaFTY0_", "(1) suspend resume partial function for ", "() async -> ()"),
    ("await_resume", "yyYaFTQ0_", "(1) await resume partial function for ", "() async -> ()"),
    ("derivative", "yyFTJfSpSr", "forward-mode derivative of ", "() -> () with respect to parameters {0} and results {0}"),
    ("default_argument", "yySiFfA_", "default argument 0 of ", "(Swift.Int) -> ()"),
    ("implicit_closure", "yyFyycfu_", "implicit closure #1 () -> () in ", "() -> ()"),
    ("sil_function", "VIegy_D", "@escaping @callee_guaranteed (@unowned ", ") -> ()"),
    ("sil_result", "VIegd_D", "@escaping @callee_guaranteed () -> (@unowned ", ")"),
    ("pack", "V_QPD", "Pack{", "}"),
    ("nested_optional", "VSgSgD", "Swift.Optional<Swift.Optional<", ">>"),
    ("any_object", "P_XlD", "", " & Swift.AnyObject"),
    ("sugared_array", "VXSaD", "[", "]"),
    ("dynamic_replacement", "yyFTX", "dynamically replaceable variable for ", "() -> ()"),
    ("dynamic_attribute", "yyFTD", "dynamic ", "() -> ()"),
    ("direct_method", "yyFTd", "super ", "() -> ()"),
    ("distributed_thunk", "yyFTE", "distributed thunk ", "() -> ()"),
    ("non_objc", "yyFTO", "@nonobjc ", "() -> ()"),
    ("method_descriptor", "yyFTq", "method descriptor for ", "() -> ()"),
    ("function_record", "yyFHF", "accessible function runtime record for ", "() -> ()"),
):
    _simple(f"{_name}_print", _tail, _before, _after_)
_simple("conformance_record_print", "VSHAAHc", "protocol conformance descriptor runtime record for ", text="r_name || '.' || n_name || ' : Swift.Hashable in ' || r_name")
_printed("macro_print", lambda n: F.concat(n, F.lit("fMf_")), "nom || 'fMf_'", "'freestanding macro expansion #1 of ' || n_name || ' in ' || r_name")
_printed("private_name_print", lambda n: F.concat(n, F.lit("10_ABCDEF012LLV")), "nom || '10_ABCDEF012LLV'", "r_name || '.(' || n_name || ' in _ABCDEF012)'")
_printed("labeled_tuple_print", lambda n: F.concat(n, F.lit("V3foo_AC3bartD")), "nom || 'V3foo_AC3bartD'", "'(foo: ' || r_name || '.' || n_name || ', bar: ' || r_name || '.' || n_name || ')'")
_printed("array_print", _inside("Say", "VGD"), "'$sSay' || substr(nom, 3) || 'VGD'", "'[' || r_name || '.' || n_name || ']'", "sugared")
_printed("array_plain_print", _inside("Say", "VGD"), "'$sSay' || substr(nom, 3) || 'VGD'", "'Swift.Array<' || r_name || '.' || n_name || '>'")
_printed("dict_print", _inside("SDySS", "VGD"), "'$sSDySS' || substr(nom, 3) || 'VGD'", "'[Swift.String : ' || r_name || '.' || n_name || ']'", "sugared")
_printed("extension_print", lambda n: F.concat(n, F.lit("V3ExtE1fyyF")), "nom || 'V3ExtE1fyyF'", "'(extension in Ext):' || r_name || '.' || n_name || '.f() -> ()'")
_printed("legacy_nominal_print", lambda n: F.concat(F.lit("_TtC"), S.strip_prefix(n)), "'_TtC' || substr(nom, 3)", "r_name || '.' || n_name")
_printed("embedded_print", lambda n: F.concat(F.lit("$e"), S.strip_prefix(n), F.lit("V")), "'$e' || substr(nom, 3) || 'V'", "r_name || '.' || n_name")
_printed("unreadable_print", lambda n: F.concat(n, F.lit("VN_M")), "nom || 'VN_M'", "CAST(NULL AS VARCHAR)")


@query(f"WITH {NOM} SELECT nom || 'V.' || n_nationkey AS symbol, r_name || '.' || n_name || ' with unmangled suffix \".' || n_nationkey || '\"' AS printed FROM t")
def suffix_print(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("V."), F.col("n_nationkey").cast("string")).alias("symbol"))
    return rows.withColumn("printed", S.print_symbol(F.col("symbol")))


@query(f"WITH {METHODS} SELECT symbol, module || '.' || of || '.' || name || '(Swift.Int, Swift.String) -> ()' AS printed FROM (SELECT DISTINCT symbol, module, of, name FROM s)")
def bulk_print(spark, sf_dir):
    return N.spread(methods(spark, sf_dir)).withColumn("printed", S.print_symbol(F.col("symbol")))


@query(f"WITH {METHODS} SELECT module, COUNT(*) AS n_symbols, COUNT(DISTINCT of) AS n_types FROM (SELECT DISTINCT symbol, module, of FROM s) GROUP BY module")
def bulk_modules(spark, sf_dir):
    texts = N.spread(methods(spark, sf_dir)).select(S.texts_of(F.col("symbol"), "module", "identifier").alias("t"))
    parsed = texts.where("t is not null").select(F.get("t", F.lit(0)).alias("module"), F.get("t", F.lit(1)).alias("of"))
    return parsed.groupBy("module").agg(F.count("*").alias("n_symbols"), F.countDistinct("of").alias("n_types"))


#: Subtrees that all symbols of `methods` share: the labels and the type (Si, SS) -> ().
SHARED_SUBTREES = len({n.digest() for n in demangle("$s1M1TV1fyySi_SStF").preorder() if n.kind not in ("global", "function", "structure") and n.text not in ("M", "T", "f")} | {n.digest() for n in demangle("$sSSD").preorder() if n.kind == "structure"} | {n.digest() for n in demangle("$sSiD").preorder() if n.kind == "structure"})


@query(f"""WITH {METHODS} SELECT CAST(COUNT(DISTINCT module) + COUNT(DISTINCT of) + COUNT(DISTINCT name) + COUNT(DISTINCT module || '.' || of) + 2 * COUNT(DISTINCT symbol) + {SHARED_SUBTREES} AS BIGINT) AS n_nodes,
  COUNT(DISTINCT symbol) AS n_roots FROM s""")
def bulk_store(spark, sf_dir):
    """The store of all method symbols: every distinct subtree once."""
    return N.intern_symbols(methods(spark, sf_dir)).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "global").alias("n_roots"))


@query(f"WITH {METHODS} SELECT COUNT(*) AS n, COUNT(*) FILTER (symbol IS NOT NULL) AS n_same FROM (SELECT DISTINCT symbol FROM s)")
def bulk_roundtrip(spark, sf_dir):
    rows = N.spread(methods(spark, sf_dir)).withColumn("again", S.remangle(F.col("symbol")))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("again") == F.concat(F.lit("_"), F.col("symbol"))).alias("n_same"))


@query(f"WITH {NOM} SELECT CASE n_nationkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'structure' WHEN 2 THEN 'enum' ELSE 'protocol' END AS kind, COUNT(*) AS n FROM t GROUP BY 1")
def nominal_kinds(spark, sf_dir):
    letter = F.substr(F.lit("CVOP"), (F.col("n_nationkey") % 4 + 1).cast("int"), F.lit(1))
    parsed = N.parse(nominals(spark, sf_dir).select(F.concat("nom", letter).alias("symbol")))
    return N.kind_histogram(N.nodes(parsed).where(F.col("kind").isin("class", "structure", "enum", "protocol")))


_MIXED = "x AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN '$s' WHEN 1 THEN '_$s' WHEN 2 THEN '_T0' WHEN 3 THEN '$e' ELSE 'zz' END || substr(nom, 3) || 'V' AS symbol FROM t)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*map(F.lit, ("$s", "_$s", "_T0", "$e", "zz"))), (F.col("n_nationkey") % 5).cast("int"))
    return nominals(spark, sf_dir).select(F.concat(head, S.strip_prefix(F.col("nom")), F.lit("V")).alias("symbol"))


@query(f"WITH {NOM}, {_MIXED} SELECT symbol, regexp_matches(symbol, '^(_T0|_\\$[Sse]|\\$[Sse]|@__swiftmacro_)') AS is_symbol FROM x")
def prefix_predicate(spark, sf_dir):
    return _mixed(spark, sf_dir).withColumn("is_symbol", S.is_symbol(F.col("symbol")))


@query(f"WITH {NOM}, {_MIXED} SELECT symbol, regexp_replace(symbol, '^(_T0|_\\$[Sse]|\\$[Sse]|@__swiftmacro_)', '') AS stripped FROM x")
def strip_prefix(spark, sf_dir):
    return _mixed(spark, sf_dir).withColumn("stripped", S.strip_prefix(F.col("symbol")))


@query(f"WITH {NOM}, {_MIXED} SELECT symbol, NOT symbol LIKE 'zz%' AS ok, CASE WHEN symbol LIKE 'zz%' THEN 'matchFailed' END AS code, CASE WHEN symbol LIKE '$e%' THEN 'embedded' WHEN symbol NOT LIKE 'zz%' THEN 'default' END AS flavor FROM x")
def parse_ok_flags(spark, sf_dir):
    return N.parse(_mixed(spark, sf_dir)).select("symbol", "ok", F.col("error.code").alias("code"), "flavor")


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, CAST(4 AS BIGINT) AS n_nodes, CAST(2 AS BIGINT) AS height FROM t")
def node_count(spark, sf_dir):
    rows = N.nodes(N.parse(nominals(spark, sf_dir).select(F.concat("nom", F.lit("V")).alias("symbol"))))
    return rows.groupBy("symbol").agg(F.count("*").alias("n_nodes"), F.max("depth").cast("long").alias("height"))


def _parsed(spark: SparkSession, sf_dir: str, tail: str = "V") -> DataFrame:
    return N.parse(nominals(spark, sf_dir).select(F.concat("nom", F.lit(tail)).alias("symbol")))


@query(f"WITH {NOM} SELECT d.depth, SUM(d.k) AS n FROM t, (VALUES (0, 1), (1, 1), (2, 2)) AS d(depth, k) GROUP BY d.depth")
def depth_histogram(spark, sf_dir):
    return N.depth_histogram(N.nodes(_parsed(spark, sf_dir)))


@query(f"WITH {NOM} SELECT k.kind, COUNT(*) AS n FROM t, (VALUES ('global'), ('structure'), ('module'), ('identifier')) AS k(kind) GROUP BY k.kind")
def kind_histogram(spark, sf_dir):
    return N.kind_histogram(N.nodes(_parsed(spark, sf_dir)))


def _order(name: str, kinds: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return N.traverse(_parsed(spark, sf_dir), name).select("symbol", "step", "kind", "text")

    run.__name__ = name
    texts = {"module": "r_name", "identifier": "n_name"}
    parts = " UNION ALL ".join(f"SELECT nom || 'V' AS symbol, {i} AS step, '{k}' AS kind, {texts.get(k, 'CAST(NULL AS VARCHAR)')} AS text FROM t" for i, k in enumerate(kinds))
    query(f"WITH {NOM} {parts}")(run)


_order("preorder", ["global", "structure", "module", "identifier"])
_order("postorder", ["module", "identifier", "structure", "global"])
_order("levelorder", ["global", "structure", "module", "identifier"])
_order("inorder", ["module", "structure", "identifier", "global"])


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, n_name AS identifier, r_name AS module FROM t")
def find_identifiers(spark, sf_dir):
    tree = F.col("tree")
    return _parsed(spark, sf_dir).select("symbol", S.first_of(tree, "identifier")["text"].alias("identifier"), S.first_of(tree, "module")["text"].alias("module"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, true AS has_structure, false AS has_class FROM t")
def contains_kind(spark, sf_dir):
    return _parsed(spark, sf_dir).select("symbol", S.contains_kind(F.col("tree"), "structure").alias("has_structure"), S.contains_kind(F.col("tree"), "class", "enum").alias("has_class"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, 'kind=Global' || chr(10) || '  kind=Structure' || chr(10) || '    kind=Module, text=\"' || r_name || '\"' || chr(10) || '    kind=Identifier, text=\"' || n_name || '\"' AS dump FROM t")
def node_dump(spark, sf_dir):
    return _parsed(spark, sf_dir).select("symbol", S.dump(F.col("tree")).alias("dump"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, k.kind FROM t, (VALUES ('module'), ('identifier')) AS k(kind)")
def structure_descendants(spark, sf_dir):
    return N.descendants(_parsed(spark, sf_dir), "structure").select("symbol", "kind")


@query(f"WITH {NOM} SELECT CAST(COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) + 2 * COUNT(DISTINCT nom) AS BIGINT) AS n FROM t")
def interned_node_count(spark, sf_dir):
    return N.intern(_parsed(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {NOM}, n AS (SELECT COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) + 2 * COUNT(DISTINCT nom) AS n_nodes FROM t), b AS (SELECT SUM(octet_length(encode(x))) AS text_bytes FROM (SELECT r_name AS x FROM t UNION SELECT n_name FROM t)) SELECT CAST(n_nodes AS BIGINT) AS n_nodes, CAST(0 AS BIGINT) AS n_edges, CAST(text_bytes AS BIGINT) AS text_bytes, CAST(12 * n_nodes + text_bytes AS BIGINT) AS flat_bytes FROM n, b")
def store_metrics(spark, sf_dir):
    return N.store_metrics(N.intern(_parsed(spark, sf_dir)))


@query(f"WITH {NOM}, n AS (SELECT COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) + 2 * COUNT(DISTINCT nom) AS n FROM t) SELECT CAST(0 AS BIGINT) AS low, CAST(n - 1 AS BIGINT) AS high, CAST(n AS BIGINT) AS n_ids FROM n")
def store_numbering(spark, sf_dir):
    return N.number(N.intern(_parsed(spark, sf_dir))).agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.countDistinct("node_id").alias("n_ids"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, k.kind, CASE k.kind WHEN 'module' THEN r_name WHEN 'identifier' THEN n_name END AS text FROM t, (VALUES ('global'), ('structure'), ('module'), ('identifier')) AS k(kind)")
def store_materialize(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return N.materialize(N.intern(parsed), N.roots(parsed)).select("symbol", "kind", "text")


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, '_' || nom || 'V' AS other FROM t")
def structural_equality(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("V")).alias("symbol"))
    return N.equal_trees(N.parse(rows), N.parse(rows.select(F.concat(F.lit("_"), "symbol").alias("symbol"))))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol FROM t WHERE n_nationkey % 3 = 0")
def corpus_diff(spark, sf_dir):
    rows = nominals(spark, sf_dir).select("n_nationkey", F.concat("nom", F.lit("V")).alias("symbol"))
    return N.corpus_diff(N.parse(rows), N.parse(rows.where("n_nationkey % 3 <> 0")))


#: A symbol encoded again: names with a space become punycode.
AGAIN = "'_$s' || CASE r_name WHEN 'MIDDLE EAST' THEN '0016MIDDLEEAST_AxJAc' ELSE length(r_name) || r_name END || length(n_name) || n_name"


@query(f"WITH {NOM} SELECT nom || 'VN' AS symbol, {AGAIN} || 'VN' AS again FROM t")
def roundtrip(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("VN")).alias("symbol"))
    return rows.withColumn("again", S.remangle(F.col("symbol")))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, 'Other.' || n_name AS printed FROM t")
def rewrite_modules(spark, sf_dir):
    rename = lambda n: word("Other", "module") if n.kind == "module" else n
    return _parsed(spark, sf_dir).select("symbol", S.print_tree(S.rewrite(F.col("tree"), rename)).alias("printed"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, r_name || '.' || n_name || ' with unmangled suffix \".x\"' AS printed FROM t")
def edit_trees(spark, sf_dir):
    return _parsed(spark, sf_dir).select("symbol", S.print_tree(S.edit(F.col("tree"), "add", Tree("suffix", text=".x"))).alias("printed"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, r_name || '.' || n_name AS joined, n_name AS named FROM t")
def print_spans(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("symbol", S.spans(F.col("tree")).alias("s"))
    named = F.get(F.filter("s", lambda x: x["state"] == "identifier"), F.lit(0))["text"]
    return rows.select("symbol", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("joined"), named.alias("named"))


@query(f"WITH {NOM} SELECT nom || 'VSgD' AS symbol, 'Optional<' || n_name || '>' AS type FROM t")
def decode_types(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("VSgD")).alias("symbol"))
    return rows.withColumn("type", S.decode_type(F.col("symbol")))


@query(f"WITH {NOM} SELECT '$sySi_' || substr(nom, 3) || 'VtcD' AS symbol, '(Int, ' || n_name || ') -> ()' AS type FROM t")
def decode_function_types(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat(F.lit("$sySi_"), S.strip_prefix(F.col("nom")), F.lit("VtcD")).alias("symbol"))
    return rows.withColumn("type", S.decode_type(F.col("symbol")))


@query(f"WITH {NOM} SELECT nom || 'VD' AS symbol, 'nominal' AS type, n_name AS name FROM t")
def decode_types_json(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("VD")).alias("symbol"))
    json = F.parse_json(S.decode_type_json(F.col("symbol")))
    return rows.withColumn("v", json).select("symbol", F.variant_get("v", "$.type", "string").alias("type"), F.variant_get("v", "$.name", "string").alias("name"))


@query(f"WITH {NOM} SELECT substr(nom, 3) || 'V' AS mangled, n_name AS name FROM t")
def demangle_bare_types(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat(S.strip_prefix(F.col("nom")), F.lit("V")).alias("mangled"))
    parsed = rows.withColumn("d", S.demangle(F.col("mangled"), is_type=True))
    return parsed.select("mangled", S.first_of(F.col("d.tree"), "identifier")["text"].alias("name"))


@query(f"WITH {NOM} SELECT r_name AS module, COUNT(*) AS n FROM t GROUP BY ROLLUP (r_name)")
def owner_rollup(spark, sf_dir):
    return N.owners(_parsed(spark, sf_dir)).rollup("module").agg(F.count("*").alias("n"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, r_name || '.' || n_name AS printed, CAST(length(r_name || '.' || n_name) AS BIGINT) AS n_chars FROM t ORDER BY n_chars DESC, symbol LIMIT 10")
def top_symbols(spark, sf_dir):
    return N.top_symbols(nominals(spark, sf_dir).select(F.concat("nom", F.lit("V")).alias("symbol")), 10)


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, n_name AS name FROM t UNION ALL SELECT nom || '10_ABCDEF012LLV', n_name FROM t UNION ALL SELECT nom || 'V2eeoiySbAC_ACtFZ', '==' FROM t")
def declared_names(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.explode(F.array(*[F.concat("nom", F.lit(t)) for t in ("V", "10_ABCDEF012LLV", "V2eeoiySbAC_ACtFZ")])).alias("symbol"))
    return N.parse(rows).select("symbol", S.identifier_of(F.col("tree"), S.child_at(F.col("tree"), F.get("tree", F.lit(0)), 0)).alias("name"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, n_name AS second, CAST(NULL AS VARCHAR) AS third, CAST(2 AS BIGINT) AS n_children, n_name AS tail, false AS is_standard, n_name = 'NATION_1' AS is_named FROM t")
def child_access(spark, sf_dir):
    tree, top = F.col("tree"), S.child_at(F.col("tree"), F.get("tree", F.lit(0)), 0)
    kids = S.children_of(tree, top)
    return _parsed(spark, sf_dir).select(
        "symbol", S.child_at(tree, top, 1)["text"].alias("second"), S.child_at(tree, top, 2)["text"].alias("third"), F.size(kids).cast("long").alias("n_children"),
        F.array_join(F.transform(S.children_of(tree, top, 1, 9), lambda n: n["text"]), ",").alias("tail"), S.is_standard_module(F.get(kids, F.lit(0))).alias("is_standard"), S.is_identifier(F.get(kids, F.lit(1)), "NATION_1").alias("is_named"),
    )


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, true AS can_mangle, {AGAIN} || 'V' AS mangled FROM t")
def mangled_trees(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("symbol", S.mangle(F.col("tree")).alias("m"), S.can_mangle(F.col("tree")).alias("can_mangle"))
    return rows.select("symbol", "can_mangle", "m.mangled")


@query(f"WITH {NOM} SELECT nom || 'V_ACtD' AS symbol, 'kind=Global' || chr(10) || '  kind=TypeMangling' || chr(10) || '    kind=Type' || chr(10) || '      kind=Tuple' || chr(10) || '        kind=TupleElement' || chr(10) || '          kind=Type (shared #1)' || chr(10) || '            kind=Structure' || chr(10) || '              kind=Module, text=\"' || r_name || '\"' || chr(10) || '              kind=Identifier, text=\"' || n_name || '\"' || chr(10) || '        kind=TupleElement' || chr(10) || '          kind=Type (see #1)' AS dump FROM t")
def shared_dump(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.concat("nom", F.lit("V_ACtD")).alias("symbol"))
    return rows.withColumn("dump", S.shared_dump(F.col("symbol")))


@query(f"WITH {NOM} SELECT nom || 'yyxlF' AS symbol, CAST(1 AS BIGINT) AS n_params, CAST(0 AS BIGINT) AS depth FROM t UNION ALL SELECT nom || 'yyF', NULL, NULL FROM t")
def generic_depths(spark, sf_dir):
    rows = nominals(spark, sf_dir).select(F.explode(F.array(F.concat("nom", F.lit("yyxlF")), F.concat("nom", F.lit("yyF")))).alias("symbol"))
    depths = F.col("d")
    found = rows.withColumn("d", S.generic_depths(F.col("symbol")))
    return found.select("symbol", F.when(depths.isNotNull(), F.size(depths)).cast("long").alias("n_params"), F.try_element_at(depths, F.lit(0)).cast("long").alias("depth"))


@query("SELECT n_nationkey, printf('%X', CAST(n_nationkey * 1001 AS BIGINT)) AS hexadecimal, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS capitalized FROM nation")
def text_utilities(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rows.select("n_nationkey", S.hexadecimal(F.col("n_nationkey") * 1001).alias("hexadecimal"), S.capitalize_first(F.lower("n_name")).alias("capitalized"))


@query("SELECT n_nationkey, 'Swift.Optional<' || 'Here.context0' || '>' AS printed FROM nation")
def symbolic_references(spark, sf_dir):
    resolve = lambda kind, way, n: Tree("type", (Tree("structure", (word("Here", "module"), word(f"{kind}{n}", "identifier"))),))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit("$s"), F.char(F.lit(1)), F.lit("SgD")).alias("symbol"))
    return rows.select("n_nationkey", S.print_tree(S.demangle(F.col("symbol"), resolver=resolve)["tree"]).alias("printed"))


@query(f"WITH {NOM} SELECT k.parent_kind, k.kind, COUNT(*) AS n FROM t, (VALUES ('global', 'structure'), ('structure', 'module'), ('structure', 'identifier')) AS k(parent_kind, kind) GROUP BY k.parent_kind, k.kind")
def edge_histogram(spark, sf_dir):
    return N.edge_histogram(_parsed(spark, sf_dir))


@query(f"WITH {NOM} SELECT CAST(COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) AS BIGINT) AS n_leaves, CAST(2 * COUNT(DISTINCT nom) AS BIGINT) AS n_subtrees FROM t")
def store_counts(spark, sf_dir):
    return N.store_counts(N.intern(_parsed(spark, sf_dir)))


@query(f"WITH {NOM} SELECT CAST(COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) + 2 * COUNT(DISTINCT nom) AS BIGINT) AS n_nodes, CAST(COUNT(DISTINCT r_name) + COUNT(DISTINCT n_name) + 2 * COUNT(DISTINCT nom) - 1 AS BIGINT) AS last_id FROM t")
def store_merge(spark, sf_dir):
    """Two stores over overlapping halves, written, read back and merged."""
    parsed, folders = _parsed(spark, sf_dir), [scratch(spark, "store") for _ in range(2)]
    last = F.substr("symbol", F.length("symbol") - 1, F.lit(1))
    for folder, half in zip(folders, (last < "6", last > "3"), strict=True):
        sources.write_store(parsed.where(half), folder)
    (a, _), (b, _) = (sources.read_store(spark, folder) for folder in folders)
    return sources.merge_stores(a, b).agg(F.count("*").alias("n_nodes"), F.max("node_id").alias("last_id"))


@query(f"WITH {NOM} SELECT nom || 'V' AS symbol, 'nations' AS image, CAST(4096 + n_nationkey AS BIGINT) AS \"offset\" FROM t")
def listing_scan(spark, sf_dir):
    """Symbols written as a text listing and read back with their offsets."""
    folder = scratch(spark, "listing")
    rows = nominals(spark, sf_dir)
    rows.select(F.concat(F.lpad(F.hex(F.col("n_nationkey") + 4096), 16, "0"), F.lit(" T "), F.col("nom"), F.lit("V")).alias("value")).write.text(folder)
    return sources.read_listing(spark, folder, "nations").select("symbol", "image", F.col("offset").cast("long").alias("offset"))


@query(f"WITH {NOM} SELECT nom || 'VSgD' AS symbol, 'Swift.Optional' AS outer_text, r_name || '.' || n_name AS inner_text, '<>' AS loose_text FROM t")
def type_reference_scopes(spark, sf_dir):
    """The texts of a print by the type reference that they belong to."""
    rows = _parsed(spark, sf_dir, "VSgD").select("symbol", S.spans(F.col("tree")).alias("s"), S.find(F.col("tree"), "structure", "enum")["node_hash"].alias("refs"))
    of = lambda scope: F.array_join(F.transform(F.filter("s", lambda x: x["scope_hash"].eqNullSafe(scope)), lambda x: x["text"]), "")
    return rows.select("symbol", of(F.get("refs", F.lit(0))).alias("outer_text"), of(F.get("refs", F.lit(1))).alias("inner_text"), of(F.lit(None).cast("string")).alias("loose_text"))


class Braces(Target):
    """Type references in braces, declared names in capitals."""

    def __init__(self) -> None:
        self.out = ""

    def write(self, text, state, kind, parent):
        self.out += text.upper() if state == "identifier" else text

    def push_scope(self, node):
        self.out += "{"

    def pop_scope(self):
        self.out += "}"

    def __str__(self) -> str:
        return self.out


@query(f"WITH {NOM} SELECT nom || 'VSgD' AS symbol, '{{Swift.OPTIONAL}}<{{' || r_name || '.' || upper(n_name) || '}}>' AS rendered FROM t")
def rendered_targets(spark, sf_dir):
    return _parsed(spark, sf_dir, "VSgD").select("symbol", S.render(F.col("tree"), Braces).alias("rendered"))


EVENT = "'$s' || length(event_type) || event_type || '1TV'"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, a stream takes a single file too
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("$s"), ident(F.col("event_type")), F.lit("1TV")).alias("symbol"))


def _drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """What the stream holds now, each batch written over the one before (complete) or beside it (append)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(f"SELECT {EVENT} AS symbol, event_type || '.T' AS printed, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_print(spark, sf_dir):
    out = _drained(streams.printed_stream(_event_stream(spark, sf_dir).select("symbol")), scratch(spark, "stream"), "append")
    return out.groupBy("symbol", "printed").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS module, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    out = _drained(streams.module_counts(_event_stream(spark, sf_dir), "1 hour"), scratch(spark, "stream"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "module", "n")


@query("SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, event_type AS module, COUNT(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) GROUP BY 1, 2")
def stream_sliding_windows(spark, sf_dir):
    """Windows of two hours that begin each hour."""
    out = _drained(streams.module_counts(_event_stream(spark, sf_dir), "2 hours", slide="1 hour"), scratch(spark, "stream"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "module", "n")


@query("""WITH e AS (SELECT event_type, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  g AS (SELECT event_type, ts, SUM(new) OVER (PARTITION BY event_type ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS session FROM e)
  SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS began, event_type AS module, COUNT(*) AS n FROM g GROUP BY event_type, session""")
def stream_sessions(spark, sf_dir):
    out = _drained(streams.module_sessions(_event_stream(spark, sf_dir), "15 minutes"), scratch(spark, "stream"), "complete")
    return out.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "module", "n")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS module, COUNT(*) AS n FROM events
  WHERE ts >= TIMESTAMP '2024-01-16' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_late_rows(spark, sf_dir):
    """The later rows come first: those of the second run are beyond the watermark, which the first left, and are dropped; windows come once they are closed."""
    folder, out = scratch(spark, "late"), None
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.lit("2024-01-16").cast("timestamp")
    for part in (F.col("ts") >= cut, F.col("ts") < cut):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        symbols = rows.select("ts", F.concat(F.lit("$s"), ident(F.col("event_type")), F.lit("1TV")).alias("symbol"))
        out = _drained(streams.module_counts(symbols, "1 hour"), folder, "append")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "module", "n")


@query("SELECT CAST(3 * COUNT(DISTINCT event_type) + 1 AS BIGINT) AS n_nodes FROM events")
def stream_intern(spark, sf_dir):
    folder = scratch(spark, "interned")
    streams.intern_stream(_event_stream(spark, sf_dir).select("symbol"), f"{folder}/store", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/store").agg(F.countDistinct("node_hash").alias("n_nodes"))


@query(f"WITH {NOM} SELECT COUNT(*) FILTER (n_nationkey % 2 = 0 AND n_nationkey % 3 = 0) AS n_common, 2 * COUNT(*) FILTER (n_nationkey % 2 = 0) - COUNT(*) FILTER (n_nationkey % 6 = 0) AS n_surplus FROM t")
def set_operations(spark, sf_dir):
    """Trees of two sets of symbols: in both, and those of the first, each of which occurs twice, beyond the second's."""
    rows = nominals(spark, sf_dir).select("n_nationkey", F.concat("nom", F.lit("V")).alias("symbol"))
    twice = rows.where("n_nationkey % 2 = 0").select(F.explode(F.array("symbol", F.concat(F.lit("_"), "symbol"))).alias("symbol"))
    a, b = N.parse(twice), N.parse(rows.where("n_nationkey % 3 = 0"))
    common = N.corpus_common(a, b).agg(F.count("*").alias("n_common")).withColumn("one", F.lit(1))
    return common.join(N.corpus_surplus(a, b).agg(F.count("*").alias("n_surplus")).withColumn("one", F.lit(1)), "one").drop("one")


@query("SELECT p_partkey, p_name AS again FROM part")
def punycode_roundtrip(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", S.punycode_decode(S.punycode_encode(F.col("p_name"))).alias("again"))


@query("SELECT d AS depth, i AS idx, chr(CAST(65 + i % 26 AS INTEGER)) || CASE WHEN i >= 26 THEN chr(CAST(65 + i // 26 % 26 AS INTEGER)) ELSE '' END || CASE WHEN i >= 676 THEN chr(CAST(65 + i // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN i >= 17576 THEN chr(CAST(65 + i // 17576 % 26 AS INTEGER)) ELSE '' END || CASE WHEN d = 0 THEN '' ELSE CAST(d AS VARCHAR) END AS name FROM (SELECT DISTINCT n_regionkey AS d, 100 * n_nationkey * n_nationkey AS i FROM nation)")
def generic_param_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("depth"), (100 * F.col("n_nationkey") * F.col("n_nationkey")).alias("idx")).distinct()
    return rows.withColumn("name", S.param_name(F.col("depth"), F.col("idx")))


@query("SELECT CAST(379 AS BIGINT) AS n_kinds, CAST(10 AS BIGINT) AS n_decl_names, CAST(3 AS BIGINT) AS n_operators, CAST(3 AS BIGINT) AS n_protocols")
def node_kinds(spark, sf_dir):
    kinds = N.node_kinds(spark)
    return kinds.agg(F.count("*").alias("n_kinds"), F.count_if("is_decl_name").alias("n_decl_names"), F.count_if("is_operator").alias("n_operators"), F.count_if("is_protocol").alias("n_protocols"))


def queries() -> dict[str, Query]:
    return _QUERIES | dispatch.QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES | dispatch.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method symbol of the line items, parsed and counted by module."""
    return bulk_modules(spark, sf_dir)
