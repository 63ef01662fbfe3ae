"""The symbol kernel on the fixtures of FIXTURES.md, on round trips, and on hostile input."""

import re
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mangrove.kernel import punycode, tree
from mangrove.kernel.encoder import SymbolEncodeError, encode
from mangrove.kernel.parser import SymbolError, demangle, prefix_of
from mangrove.kernel.printer import PRESETS, PrintTooLarge, spans_of, text_of, Target, print_into
from mangrove.kernel.tree import Tree
from mangrove.kernel.types import JsonBuilder, TextBuilder, TypeError_, decode, decode_symbol
from mangrove.kernel.wording import classes

TEXT = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()


def section(number):
    return re.search(rf"\n## {number}\..*?\n(.*?)(?=\n## |\Z)", TEXT, re.S)[1]


def pairs(number):
    rows = [[c.strip().strip("`") for c in re.split(r"(?<!\\)\|", line)[2:-1]] for line in section(number).splitlines() if re.match(r"\| \d+ \|", line)]
    return [[c.replace("\\|", "|") for c in r] for r in rows]


GOLDEN, TYPES, OPTIONS = pairs(2), pairs(4), pairs(5)
FAILING = re.findall(r"`(_[^`]+)` \(\d+\)", section(3))


def test_fixtures_are_there():
    assert len(GOLDEN) > 60 and len(TYPES) > 35 and len(FAILING) > 35 and len(OPTIONS) == 2 and len(classes()) == 379


@pytest.mark.parametrize(("symbol", "expected"), GOLDEN)
def test_printed(symbol, expected):
    assert text_of(demangle(symbol), PRESETS["sugared"]) == expected


@pytest.mark.parametrize("symbol", FAILING)
def test_must_fail(symbol):
    with pytest.raises(SymbolError):
        demangle(symbol)


@pytest.mark.parametrize(("symbol", "expected"), TYPES)
def test_types(symbol, expected):
    assert decode_symbol(symbol) == expected


@pytest.mark.parametrize(("symbol", "options", "expected"), OPTIONS)
def test_options(symbol, options, expected):
    assert text_of(demangle(symbol), PRESETS["interface" if "interface" in options else "sugared"]) == expected


@pytest.mark.parametrize(("symbol", "expected"), GOLDEN)
def test_round_trip(symbol, expected):
    node = demangle(symbol)
    again = encode(node)
    assert demangle(again).same(node)
    head = prefix_of(symbol)
    if head in ("$s", "_$s"):
        assert again == "_$s" + symbol[len(head) :]


LEGACY = {
    "_TFC3foo3bar3basfT3zimCS_3zim_T_": "foo.bar.bas(zim: foo.zim) -> ()",
    "_TtGSqSi_": "Swift.Int?",
    "_TtFSiSi": "(Swift.Int) -> Swift.Int",
    "_TtTSiSf_": "(Swift.Int, Swift.Float)",
    "_TMnC3foo3bar": "nominal type descriptor for foo.bar",
    "_TToFC3foo3bar3basfT3zimCS_3zim_T_": "@objc foo.bar.bas(zim: foo.zim) -> ()",
    "_TWPC3foo3barS_8barrableS_": "protocol witness table for foo.bar : foo.barrable in foo",
    "_TTSg5Si___TFSqcfT_GSqx_": "generic specialization <Swift.Int> of Swift.Optional.init() -> A?",
    "_TtBf32_": "Builtin.FPIEEE32",
}


@pytest.mark.parametrize("symbol", LEGACY)
def test_former_grammar(symbol):
    assert text_of(demangle(symbol), PRESETS["sugared"]) == LEGACY[symbol]


@given(st.text(min_size=1))
def test_punycode_round_trip(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert punycode.decode(punycode.encode(text)) == text


NAMES = st.text(alphabet="abcXYZ_Words1", min_size=1, max_size=12).filter(lambda s: not s[0].isdigit())


@settings(max_examples=150, deadline=None)
@given(st.lists(NAMES, min_size=2, max_size=7), st.lists(st.sampled_from("CVO"), min_size=6, max_size=6))
def test_names_survive_encoding(names, letters):
    kinds = {"C": "class", "V": "structure", "O": "enum"}
    node = Tree("module", text=names[0])
    for name, letter in zip(names[1:], letters, strict=False):
        node = Tree(kinds[letter], (node, Tree("identifier", text=name)))
    whole = Tree("global", (Tree("typeMangling", (Tree("type", (node,)),)),))
    assert demangle(encode(whole)).same(whole)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="$sS_TAyxqzFVCOPGQWMIwtfvd0123456789abRlu.", max_size=40))
def test_noise_fails_cleanly(text):
    for symbol in ("$s" + text, "_T" + text):
        try:
            node = demangle(symbol)
        except SymbolError:
            continue
        text_of(node)
        try:
            encode(node)
        except SymbolEncodeError:
            pass
        try:
            decode_symbol(symbol)
        except TypeError_:
            pass


def test_flat_rows_hold_the_tree():
    for symbol, _ in GOLDEN:
        node = demangle(symbol)
        rows = tree.flatten(node)
        assert [r["kind"] for r in rows] == [n.kind for n in node.preorder()] and rows[0]["size"] == len(rows)
        assert tree.assemble(rows).same(node)
        assert all(r["depth"] == rows[r["parent"]]["depth"] + 1 and rows[r["parent"]]["kids"][r["ord"]] == r["pre"] for r in rows[1:])


def test_orders():
    leaf = lambda c: Tree("identifier", text=c)
    root = Tree("global", (Tree("type", (leaf("a"), leaf("b"), leaf("c"))), leaf("d"), leaf("e")))
    rows = tree.flatten(root)
    shown = lambda key: "".join(r["text"] or r["kind"][0] for r in sorted((r for r in rows if key(r) is not None), key=key))
    assert shown(lambda r: r["pre"]) == "gtabcde"
    assert shown(lambda r: r["pre"] - r["depth"] + r["size"]) == "abctdeg"
    assert shown(lambda r: (r["depth"], r["pre"])) == "gtdeabc"
    assert shown(lambda r: r["ino"]) == "atbgd"


def test_edits_leave_the_original():
    root = Tree("global", (Tree("module", text="a"), Tree("module", text="b")))
    new = Tree("module", text="c")
    assert [k.text for k in tree.edit(root, "insert", new, 1).kids] == ["a", "c", "b"]
    assert [k.text for k in tree.edit(root, "remove", 0).kids] == ["b"] and tree.edit(root, "remove", 9).same(root)
    assert [k.text for k in tree.edit(root, "set", new, 0).kids] == ["c", "b"] and [k.text for k in tree.edit(root, "reverse").kids] == ["b", "a"]
    assert [k.text for k in tree.edit(root, "replace", Tree("module", text="a"), new).kids] == ["c", "b"] and len(root.kids) == 2


def doubling(levels):
    node = Tree("type", (Tree("structure", (Tree("module", text="m"), Tree("identifier", text="n"))),))
    for _ in range(levels):
        node = Tree("type", (Tree("tuple", (Tree("tupleElement", (node,)), Tree("tupleElement", (node,)))),))
    return Tree("global", (node,))


def test_shared_trees_cost_their_instances():
    began = time.time()
    root = doubling(60)
    visited = []
    tree.rewrite(root, lambda n: visited.append(n) or n)
    assert len(visited) < 300 and root.same(doubling(60))
    with pytest.raises(OverflowError):
        tree.flatten(root, 10_000)
    assert "(see #" in tree.dump(doubling(5), shared=True)
    assert time.time() - began < 10


def test_deep_nesting_is_bounded():
    deep = "$s" + "Sq" * 0 + "Si" + "Sg" * 3000 + "D"
    text = text_of(demangle(deep), PRESETS["sugared"])
    assert "<<too complex>>" in text
    with pytest.raises(SymbolEncodeError):
        encode(demangle(deep))
    with pytest.raises(TypeError_):
        decode_symbol(deep)


def test_symbolic_references():
    resolve = lambda kind, way, n: Tree("type", (Tree("structure", (Tree("module", text="m"), Tree("identifier", text=f"{kind}{n}"))),))
    assert text_of(demangle("$s\x01SgD", resolver=resolve)) == "Swift.Optional<m.context0>"
    with pytest.raises(SymbolError):
        demangle("$s\x01SgD")


def test_spans_and_json():
    spans = spans_of(demangle("$s4main3FooV"))
    assert [(s[0], s[1]) for s in spans] == [("main", "module"), (".", None), ("Foo", "identifier")]
    assert decode_symbol("$sSaySiGD", JsonBuilder())["args"][0]["name"] == "Int"
    assert decode_symbol("$sSo7NSArrayCD") == "NSArray" and decode_symbol("$sSo7NSArrayCD", JsonBuilder())["type"] == "objc_class"


def test_crafted_sharing_is_refused_in_time():
    began = time.time()
    symbol = encode(Tree("global", (Tree("typeMangling", (nested(60),)),)))
    assert len(symbol) < 1000
    with pytest.raises(PrintTooLarge):
        text_of(demangle(symbol))
    with pytest.raises(TypeError_):
        decode_symbol(symbol)
    assert not nested(60).contains("functionType") and nested(60).first("identifier").text == "G" == nested(60).identifier()
    count = Tree("dependentGenericParamCount", index=1)
    param = Tree("dependentGenericParamType", (Tree("index", index=3), Tree("index", index=2)))
    generic = Tree("dependentGenericType", (Tree("dependentGenericSignature", (count,)), Tree("type", (Tree("tuple", (param, nested(60))),))))
    assert tree.generic_depths(generic) == {2: 3} and tree.generic_depths(nested(3)) is None
    assert time.time() - began < 60


def nested(levels):
    node = Tree("type", (Tree("structure", (Tree("module", text="Swift"), Tree("identifier", text="Int"))),))
    for _ in range(levels):
        head = Tree("type", (Tree("structure", (Tree("module", text="main"), Tree("identifier", text="G"))),))
        node = Tree("type", (Tree("boundGenericStructure", (head, Tree("typeList", (node, node)))),))
    return node


def test_declared_names():
    hidden = Tree("privateDeclName", (Tree("identifier", text="_1"), Tree("identifier", text="Foo")))
    assert Tree("structure", (Tree("module", text="m"), hidden)).identifier() == "Foo"
    assert Tree("global", (Tree("function", (Tree("module", text="m"), Tree("infixOperator", text="=="), Tree("identifier", text="a"))),)).identifier() == "=="
    assert Tree("global", (Tree("module", text="m"),)).identifier() is None


def test_builder_leaves_built_trees_alone():
    builder = tree.TreeBuilder("global")
    first = builder.add(Tree("module", text="a")).build()
    second = builder.add(Tree("module", text="b")).apply("reverse").build()
    assert [k.text for k in first.kids] == ["a"] and [k.text for k in second.kids] == ["b", "a"]


def test_spans_name_their_type_reference():
    node = demangle("$sSaySiGD")
    outer, inner = (n.digest() for n in node.instances() if n.kind == "structure")
    scopes = {scope: "".join(s[0] for s in spans_of(node) if s[4] == scope) for scope in (outer, inner, None)}
    assert scopes == {outer: "Swift.Array", inner: "Swift.Int", None: "<>"}


def test_parts_are_encoded_on_their_own():
    leaf = lambda kind, **value: Tree(kind, **value)
    module = Tree("module", text="main")
    named = Tree("type", (Tree("class", (module, Tree("identifier", text="C"))),))
    assert encode(leaf("indexSubset", text="SUS")) == "SUS" and encode(leaf("directness", index=1)) == "i" and encode(leaf("packElementLevel", index=0)) == "_"
    assert encode(Tree("declContext", (module,))) == "4main" and encode(leaf("clangType", text="abc")) == "3abc"
    assert encode(Tree("global", (Tree("reflectionMetadataSuperclassDescriptor", named.kids),))) == "_$s4main1CCMC"
    assert encode(Tree("globalVariableOnceDeclList", (Tree("identifier", text="a"), Tree("identifier", text="b")))) == "1a_1b_"
    assert encode(Tree("functionSignatureSpecializationReturn")) == "n"
    with pytest.raises(SymbolError):
        demangle("$sSi_SStMC")


def test_superclass_descriptors():
    node = demangle("$s4main1CCMC")
    assert text_of(node) == "reflection metadata superclass descriptor main.C" and encode(node) == "_$s4main1CCMC"


def test_pack_expansions_call_back():
    class Two(TextBuilder):
        def __init__(self):
            self.log = []

        def expand(self, count):
            self.log.append(f"begin {count}")
            return 2

        def advance(self, index):
            self.log.append(index)

        def expanded(self, element):
            return f"{element}#{self.log[-1]}"

        def end_expansion(self):
            self.log.append("end")

    two = Two()
    assert decode_symbol("$sxxQp_SiQPD", two) == "Pack{τ_0_0#0, τ_0_0#1, Int}" and two.log == ["begin τ_0_0", 0, 1, "end"]
    assert decode_symbol("$sxxQp_SiQPD") == "Pack{repeat τ_0_0, Int}"


def test_references_and_lowered_packs_are_decoded():
    reference = lambda kind: Tree("type", (Tree(kind, index=4096),))
    assert decode(reference("typeSymbolicReference")) == "<typeSymbolicReference 0x1000>"
    assert decode(reference("protocolSymbolicReference")) == "any <protocolSymbolicReference 0x1000>"
    pack = Tree("silPackIndirect", (reference("typeSymbolicReference"),))
    assert decode(pack).startswith("@indirect Pack{") and decode(pack.renamed("silPackDirect"), JsonBuilder())["address"] is False
    assert decode_symbol("$sBi32_D", JsonBuilder()) == {"type": "builtin", "name": "Builtin.Int32", "mangled": "Bi32_"}


def test_conformances_are_told_from_superclasses_by_the_builder():
    class Never(TextBuilder):
        def is_existential(self, of):
            return False

        def requirement(self, kind, subject, constraint):
            return f"{kind} {subject} {constraint}"

    assert "superclass τ_0_0 Hashable" in decode_symbol("$sxz_Si_SHRzlXXD", Never())


def test_printing_into_a_target():
    class Log(Target):
        def __init__(self):
            self.log = []

        def write(self, text, state, kind, parent):
            self.log.append(text)

        def push_scope(self, node):
            self.log.append(("push", node.kind))

        def pop_scope(self):
            self.log.append("pop")

    assert print_into(demangle("$s4main3FooVSgD"), Log()).log == [("push", "enum"), "Swift", ".", "Optional", "pop", "<", ("push", "structure"), "main", ".", "Foo", "pop", ">"]
