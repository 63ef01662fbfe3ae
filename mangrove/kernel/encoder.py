"""Tree to symbol: the grammar tables read backwards, with substitutions and word reuse."""

from __future__ import annotations

from collections.abc import Callable

from . import grammar as G
from . import punycode
from .parser import CLANG, MAX_REPEAT, MAX_WORDS, OBJC, STDLIB, words_in
from .tree import Tree

MAX_DEPTH = 1024
_REGULAR = {kind: (op, pops) for op, (kind, pops, _) in reversed(G.RULES.items())} | {"typeMetadataDemanglingCache": ("MD", "t")}
_LEAVES = {kind: op for op, kind in G.LEAF_KINDS.items()}
_FUNCTION_OPS = {kind: op for op, kind in reversed(G.FUNCTIONS.items())}
_NOMINAL_OPS = {kind: op for op, kind in G.NOMINALS.items()}
_ACCESSOR_OPS = {kind: op for op, kind in G.ACCESSORS.items()}
_ENTITY_OPS = {kind: "f" + op for op, (kind, _) in G.ENTITIES.items()}
_MACRO_OPS = {kind: "fM" + op for op, kind in G.MACROS.items()}
_OUTLINED_OPS = {kind: "WO" + op for op, kind in G.OUTLINED.items()}
_SPECIAL_OPS = {kind: op for op, kind in G.SPECIALIZATIONS.items()}
_BUILTIN_OPS = {f"Builtin.{name}": "B" + op for op, name in G.BUILTINS.items()}
_STANDARD_OPS = {(kind, name): op for op, (kind, name) in G.STANDARD.items()} | {(kind, name): "c" + op for op, (kind, name) in G.CONCURRENCY.items()}
_BOUND = {k for k in G.SIMPLE_TYPES if k.startswith("boundGeneric")}
_STORAGE = {"variable": "v", "subscript": "i"}
_PARAMS, _RESULTS = {v: k for k, v in G.IMPL_PARAMS.items()}, {v: k for k, v in G.IMPL_RESULTS.items()}
_UNIT_CONTEXTS = {"function", *_ACCESSOR_OPS, *_ENTITY_OPS, "static"}
_NO_ARGUMENTS = {"variable", "subscript", "implicitClosure", "explicitClosure", "defaultArgumentInitializer", "initializer", "propertyWrapperBackingInitializer", "propertyWrapperInitFromProjectedValue", "propertyWrappedFieldInitAccessor", "static"}


class SymbolEncodeError(ValueError):
    def __init__(self, code: str, kind: str) -> None:
        super().__init__(f"{code}: {kind}")
        self.code, self.kind = code, kind


def needs_punycode(text: str) -> bool:
    return bool(text) and (text[0] in "0123456789" or not all(punycode.symbol_char(c) for c in text))


def is_specialized(node: Tree) -> bool:
    while True:
        if node.kind in _BOUND:
            return True
        if node.kind == "extension" and len(node.kids) > 1:
            node = node.kids[1]
        elif (node.kind in _NOMINAL_OPS or node.kind in _UNIT_CONTEXTS or node.kind in _STORAGE) and node.kids:
            node = node.kids[0]
        else:
            return False


def unspecialized(node: Tree) -> Tree:
    if node.kind == "boundGenericFunction":
        return unspecialized(node.kids[0]) if is_specialized(node.kids[0]) else node.kids[0]
    if node.kind in _BOUND:
        plain = node.kids[0].kids[0]
        return unspecialized(plain) if is_specialized(plain) else plain
    at = 1 if node.kind == "extension" else 0
    kids = list(node.kids)
    if is_specialized(kids[at]):
        kids[at] = unspecialized(kids[at])
    return Tree(node.kind, kids)


class Encoder:
    def __init__(self, use_punycode: bool = True) -> None:
        self.out, self.subs, self.words, self.punycode, self.depth = "", {}, [], use_punycode, 0
        self.merge = (-1, 0, 0, False)  # where the last substitution's letters are, their length, repeats, standard

    # -- pieces -------------------------------------------------------------------------------

    def w(self, text: str) -> None:
        self.out += text

    def index(self, value: int | None) -> None:
        self.out += "_" if not value else f"{value - 1}_"

    def kids(self, node: Tree, back: bool = False) -> None:
        for k in reversed(node.kids) if back else node.kids:
            self.node(k)

    def kid(self, node: Tree, i: int) -> Tree:
        if i >= len(node.kids):
            raise SymbolEncodeError("wrongNumberOfChildren", node.kind)
        return node.kids[i]

    def listed(self, nodes, one: Callable | None = None) -> None:
        first = True
        for n in nodes:
            (one or self.node)(n)
            if first:
                self.w("_")
            first = False
        if first:
            self.w("y")

    def merged(self, letters: str, standard: bool) -> None:
        """Writes a substitution, joined with one that stands just before it."""
        at, size, repeats, was_standard = self.merge
        if 0 < repeats < MAX_REPEAT and len(self.out) == at + size and was_standard == standard:
            last = self.out[at:].lstrip("0123456789")
            if last == letters:
                self.out = self.out[:at] + str(repeats + 1) + letters
                self.merge = (at, len(self.out) - at, repeats + 1, standard)
                return
            if not standard:
                end = len(self.out)
                self.out = self.out[:-1] + last[-1].lower() + letters
                self.merge = (end, 1, 1, False)
                return
        self.merge = (len(self.out) + 1, len(letters), 1, standard)
        self.w(("S" if standard else "A") + letters)

    def standard(self, node: Tree) -> bool:
        if len(node.kids) < 2 or node.kids[0].kind != "module" or node.kids[0].text != STDLIB or node.kids[1].kind != "identifier":
            return False
        letters = _STANDARD_OPS.get((node.kind, node.kids[1].text))
        if letters is None:
            return False
        self.merged(letters, True)
        return True

    def known(self, key) -> bool:
        at = self.subs.get(key)
        if at is None:
            return False
        if at >= 26:
            self.w("A")
            self.index(at - 26)
        else:
            self.merged(chr(65 + at), False)
        return True

    def remember(self, key) -> None:
        self.subs.setdefault(key, len(self.subs))

    def substituted(self, node: Tree) -> bool:
        return self.standard(node) or self.known(node.digest())

    def name(self, node: Tree) -> None:
        text = node.text or ""
        if node.kind in G.OPERATORS:
            text = "".join(chr(97 + G.OPERATOR_CHARS.index(c)) if c in G.OPERATOR_CHARS and c != " " else c for c in text)
        if self.known(("name", text)):
            return
        self.spell(text)
        self.remember(("name", text))

    def spell(self, text: str) -> None:
        if self.punycode and needs_punycode(text):
            code = punycode.encode(text)
            self.w(f"00{len(code)}" + ("_" if code[0] in "0123456789_" else "") + code)
            return
        # Words known from before, or from earlier in this identifier, are replaced by letters.
        replaced, at = [], 0
        for piece in words_in(text):
            at = text.index(piece, at)
            if piece in self.words:
                replaced.append((at, self.words.index(piece)))
            elif len(self.words) < MAX_WORDS:
                self.words.append(piece)
            at += len(piece)
        self.w("0" if replaced else "")
        at = 0
        for i, (start, which) in enumerate([*replaced, (len(text), -1)]):
            if at < start:
                part = text[at:start]
                self.w(str(len(part)) + ("X" + part[1:] if part[0] in "0123456789" else part))
                at = start
            if which >= 0:
                at += len(self.words[which])
                if i < len(replaced) - 1:
                    self.w(chr(97 + which))
                else:
                    self.w(chr(65 + which) + ("0" if at == len(text) else ""))

    # -- nodes --------------------------------------------------------------------------------

    def node(self, node: Tree) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise SymbolEncodeError("tooComplex", node.kind)
        kind = node.kind
        special = _SPECIAL.get(kind)
        if special:
            special(self, node)
        elif kind in _REGULAR:
            self.regular(node, *_REGULAR[kind])
        elif kind in _LEAVES:
            self.w(_LEAVES[kind])
        elif kind in _FUNCTION_OPS:
            self.function_type(node)
        elif kind in _NOMINAL_OPS:
            self.nominal(node)
        elif kind in _BOUND:
            self.bound(node)
        elif kind in _ACCESSOR_OPS:
            self.storage(self.kid(node, 0), _ACCESSOR_OPS[kind])
        elif kind in _ENTITY_OPS:
            self.kids(node)
            self.w(_ENTITY_OPS[kind])
        elif kind in _MACRO_OPS:
            self.macro(node)
        elif kind in _OUTLINED_OPS:
            for k in node.kids:
                if k.kind != "number":
                    self.node(k)
            self.w(_OUTLINED_OPS[kind])
            for k in node.kids:
                if k.kind == "number":
                    self.index(k.index)
        elif kind in _SPECIAL_OPS:
            self.specialization(node)
        else:
            raise SymbolEncodeError("unsupportedNodeKind", kind)
        self.depth -= 1

    def regular(self, node: Tree, op: str, pops: str) -> None:
        if node.kind == "partialApplyForwarder":
            raise SymbolEncodeError("unsupportedNodeKind", node.kind)
        if len(node.kids) != len(pops) and node.kind not in ("metatype", "existentialMetatype", "anonymousDescriptor"):
            raise SymbolEncodeError("wrongNumberOfChildren", node.kind)
        if node.kids and node.kids[0].kind == "metatypeRepresentation":
            self.node(self.kid(node, 1))
            self.w(("XM" if node.kind == "metatype" else "Xm") + next(k for k, v in G.METATYPES.items() if v == node.kids[0].text))
            return
        if node.kind == "anonymousDescriptor" and len(node.kids) == 2:
            op, pops = "MXY", "ax"
        for k, letter in zip(node.kids, reversed(pops), strict=False):
            if letter == "p":
                self.pure_protocol(k)
            elif letter == "l":
                self.listed(self.kid(k, 0).kids, self.pure_protocol)
            elif letter == "P":
                self.listed(k.kids)
            elif letter != "k":
                self.node(k)
        self.w(op)
        for k, letter in zip(node.kids, reversed(pops), strict=False):
            if letter == "k":
                self.index(k.index)

    def pure_protocol(self, node: Tree) -> None:
        inner = node.unwrapped() or node
        if inner.kind != "protocol":
            raise SymbolEncodeError("unsupportedNodeKind", inner.kind)
        if not self.standard(inner):
            self.kids(inner)

    def nominal(self, node: Tree) -> None:
        if is_specialized(node):
            self.bound(node)
            return
        if self.substituted(node):
            return
        self.kids(node)
        self.w(_NOMINAL_OPS[node.kind])
        self.remember(node.digest())

    def bound(self, node: Tree) -> None:
        if node.kind == "boundGenericEnum" and len(node.kids) == 2:
            plain = node.kids[0].unwrapped()
            if plain and len(plain.kids) == 2 and plain.kids[0].text == STDLIB and plain.kids[1].text == "Optional" and len(node.kids[1].kids) == 1:
                if not self.known(node.digest()):
                    self.node(node.kids[1].kids[0])
                    self.w("Sg")
                    self.remember(node.digest())
                return
        if self.known(node.digest()):
            return
        self.node(unspecialized(node))
        self.arguments(node, ["y"], False)
        if node.kind in _BOUND and len(node.kids) == 3:
            self.kids(node.kids[2])
        self.w("G")
        self.remember(node.digest())

    def arguments(self, node: Tree, mark: list[str], every: bool) -> None:
        """Generic arguments of all levels, outermost first; mark holds the separator that comes next."""

        def separate() -> None:
            self.w(mark[0])
            mark[0] = "_"

        if node.kind in _BOUND:
            every = every or node.kind in ("boundGenericTypeAlias", "boundGenericFunction")
            plain = node.kids[0] if node.kind == "boundGenericFunction" else self.kid(node.kids[0], 0)
            self.arguments(self.kid(plain, 0), mark, every)
            separate()
            self.kids(node.kids[1])
        elif node.kind in _NOMINAL_OPS:
            self.arguments(self.kid(node, 0), mark, every or node.kind == "typeAlias")
            separate()
        elif node.kind == "extension":
            self.arguments(self.kid(node, 1), mark, every)
        elif (node.kind in _UNIT_CONTEXTS or node.kind in _STORAGE) and every:
            self.arguments(self.kid(node, 0), mark, every)
            if node.kind not in _NO_ARGUMENTS:
                separate()

    def function_type(self, node: Tree) -> None:
        kids, op = list(node.kids), _FUNCTION_OPS[node.kind]
        clang = kids.pop(0) if kids and kids[0].kind == "clangType" else None
        for k in reversed(kids):
            self.node(k)
        self.w("Xz" + op[-1] + f"{len(clang.text or '')}{clang.text}" if clang else op)

    def storage(self, node: Tree, accessor: str) -> None:
        if node.kind not in _STORAGE:
            raise SymbolEncodeError("unsupportedNodeKind", node.kind)
        self.kids(node)
        self.w(_STORAGE[node.kind] + accessor)

    def argument(self, node: Tree) -> None:
        inner = self.kid(node, 0).unwrapped()
        if inner is not None and inner.kind == "tuple" and not inner.kids:
            self.w("y")
        else:
            self.node(node.kids[0])

    def function(self, node: Tree) -> None:
        for k in node.kids[:-1]:
            self.node(k)
        of = self.kid(self.kid(node, len(node.kids) - 1), 0)
        signature = None
        if of.kind == "dependentGenericType":
            signature, of = of.kids[0], of.kids[1].kids[0]
        self.kids(of, back=True)
        if signature:
            self.node(signature)
        self.w("F")

    def closure(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        self.node(self.kid(node, 2))
        self.w(_ENTITY_OPS[node.kind])
        self.index(node.kids[1].index)

    def default_argument(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        self.w("fA")
        self.index(self.kid(node, 1).index)

    def module(self, node: Tree) -> None:
        short = {STDLIB: "s", OBJC: "So", CLANG: "SC"}.get(node.text or "")
        self.w(short) if short else self.name(node)

    def top(self, node: Tree) -> None:
        held: list[Tree] = []
        for k in node.kids:
            if k.kind in G.FUNCTION_ATTRIBUTES:
                if k.kind in ("partialApplyForwarder", "partialApplyObjCForwarder") and k.kids:
                    self.top(Tree("global", k.kids))
                    self.w(_LEAVES[k.kind])
                    for h in reversed(held):
                        self.node(h)
                    held = []
                else:
                    held.append(k)
                continue
            if k.kind != "suffix":
                self.node(k)
            for h in reversed(held):
                self.node(h)
            held = []
            if k.kind == "suffix":
                self.node(k)
        for h in reversed(held):
            self.node(h)

    def param(self, node: Tree, other: str = "", zero: str = "z") -> None:
        if node.kind == "constrainedExistentialSelf":
            self.w("s")
            return
        depth, at = self.kid(node, 0).index, self.kid(node, 1).index
        if depth:
            self.w(other + "d")
            self.index(depth - 1)
            self.index(at)
        elif at:
            self.w(other)
            self.index(at - 1)
        else:
            self.w(zero)

    def constrained(self, node: Tree) -> tuple[int, Tree | None]:
        """Writes the subject of a requirement; (members, parameter), members -1 if it was written whole."""
        node = node.unwrapped() or node
        if self.substituted(node):
            return -1, None
        whole, chain = node, []
        while node.kind == "dependentMemberType":
            chain.append(self.kid(node, 1))
            node = self.kid(node, 0).unwrapped() or node
        base: Tree | None = node
        if node.kind not in ("dependentGenericParamType", "constrainedExistentialSelf"):
            self.node(node)
            if not chain:
                return 0, None
            base = None
        for i, k in enumerate(reversed(chain)):
            self.node(k)
            self.w("_" if i == 0 and len(chain) > 1 else "")
        if chain:
            self.remember(whole.digest())
        return len(chain), base

    def member(self, node: Tree) -> None:
        members, base = self.constrained(node)
        if members < 0:
            return
        letters = "yzx" if members == 1 else "YZX"
        self.w("Q")
        self.param(base, letters[0], letters[1]) if base else self.w(letters[2])

    def requirement(self, node: Tree, letters: str) -> Tree | None:
        """letters: by how the subject is spelt: generic, one member, chain, written whole."""
        members, base = self.constrained(self.kid(node, 0))
        if members < 0 or base is None:
            self.w("R" + letters[3])
            return None
        self.w("R" + letters[min(members, 2)].strip())
        return base

    def conformance_requirement(self, node: Tree) -> None:
        inner = self.kid(node, 1).unwrapped()
        if inner is not None and inner.kind == "protocol":
            self.pure_protocol(node.kids[1])
            base = self.requirement(node, " pPQ")
        else:
            self.node(node.kids[1])
            base = self.requirement(node, "bcCB")
        if base:
            self.param(base)

    def same_type(self, node: Tree) -> None:
        self.node(self.kid(node, 1))
        base = self.requirement(node, "stTS")
        if base:
            self.param(base)

    def layout(self, node: Tree) -> None:
        base = self.requirement(node, "lmML")
        if base:
            self.param(base)
        self.w(self.kid(node, 1).text or "")
        for k in node.kids[2:]:
            self.index(k.index)

    def inverse(self, node: Tree) -> None:
        base = self.requirement(node, "ijJI")
        self.index(self.kid(node, 1).index)
        if base:
            self.param(base)

    def marker(self, node: Tree) -> None:
        for k in node.kids[1:]:
            self.node(k)
        self.w({"dependentGenericParamPackMarker": "Rv", "dependentGenericParamValueMarker": "RV", "dependentGenericSameShapeRequirement": "Rh"}[node.kind])
        self.param(self.kid(node, 0).unwrapped() or node)

    def signature(self, node: Tree) -> None:
        counts = [k.index or 0 for k in node.kids if k.kind == "dependentGenericParamCount"]
        for k in node.kids:
            if k.kind != "dependentGenericParamCount":
                self.node(k)
        if counts == [1]:
            self.w("l")
            return
        self.w("r")
        for c in counts:
            self.index(c - 1) if c else self.w("z")
        self.w("l")

    def conformance(self, node: Tree) -> None:
        subject, signature = self.kid(node, 0), None
        inner = subject.kid(0)
        if inner is not None and inner.kind == "dependentGenericType":
            signature, subject = inner.kids[0], inner.kids[1]
        self.node(subject)
        if len(node.kids) == 4:
            self.node(node.kids[3])
        self.pure_protocol(self.kid(node, 1))
        self.node(self.kid(node, 2))
        if signature:
            self.node(signature)

    def concrete(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        self.node(self.kid(node, 1))
        self.listed(self.kid(node, 2).kids)
        self.w("HC")

    def other_module(self, node: Tree) -> None:
        self.pure_protocol(self.kid(node, 0))
        self.node(self.kid(node, 1))

    def dependent_conformance(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        if node.kind.endswith("Associated"):
            self.node(self.kid(node, 1))
        else:
            self.pure_protocol(self.kid(node, 1))
        self.w({"Root": "HD", "Inherited": "HI", "Associated": "HA"}[node.kind.removeprefix("dependentProtocolConformance")])
        at = self.kid(node, 2).index
        self.index(1 if at is None else at + 2)

    def specialization(self, node: Tree) -> None:
        self.listed([self.kid(k, 0) for k in node.kids if k.kind == "genericSpecializationParam"])
        self.w("T")
        for k in node.kids:
            if k.kind == "droppedArgument":
                self.w("t" + (str(k.index - 1) if k.index else ""))
        self.w(_SPECIAL_OPS[node.kind])
        self.attributes(node)

    def attributes(self, node: Tree) -> None:
        for k in node.kids:
            if k.kind in ("isSerialized", "asyncRemoved", "representationChanged", "specializationPassID"):
                self.w({"isSerialized": "q", "asyncRemoved": "a", "representationChanged": "r"}.get(k.kind, str(k.index or 0)))

    def partial(self, node: Tree) -> None:
        for k in node.kids:
            if k.kind == "genericSpecializationParam":
                self.node(self.kid(k, 0))
        self.w("TP" if node.kind.endswith("NotReAbstracted") else "Tp")
        self.attributes(node)

    def function_specialization(self, node: Tree) -> None:
        fixed = _PARAM_CHANGES
        params = [k for k in node.kids if k.kind.startswith("functionSignatureSpecialization")]
        for p in params:
            for k in p.kids:
                if k.kind not in fixed:
                    self.node(k)
        self.w("Tf")
        self.attributes(node)
        if any(k.kind == "representationChanged" for k in node.kids):
            return
        returned = False
        for p in params:
            if p.kind.endswith("Return"):
                self.w("_")
                returned = True
            self.changed(p, fixed)
        self.w("" if returned else "_n")

    def changed(self, param: Tree, fixed: tuple[str, str]) -> None:
        kinds = [k for k in param.kids if k.kind in fixed]
        if not kinds:
            self.w("n")
            return
        raw = kinds[0].index or 0
        if raw in (0, 1, 2, 3, 4, 9, 10):
            self.w("p")
            for k in kinds:
                if k.kind == fixed[0]:
                    self.w({0: "f", 1: "g", 2: "i", 3: "d", 4: "s", 9: "k", 10: "S"}[k.index or 0])
                else:
                    self.w({"u8": "b", "u16": "w", "objc": "c"}.get(k.text or "", k.text or ""))
            return
        if raw == 11:
            self.w(f"C{kinds[1].index}")
        elif raw in (5, 6, 7, 8, 256):
            self.w({5: "c", 6: "i", 7: "s", 8: "r", 256: "x"}[raw])
        else:
            head = next(b for b in (1024, 64, 128, 512) if raw & b)
            self.w({1024: "e", 64: "d", 128: "g", 512: "o"}[head])
            for bit, letter in ((64, "D"), (128, "G"), (512, "O"), (256, "X")):
                if bit != head and raw & bit:
                    self.w(letter)

    def impl_function(self, node: Tree) -> None:
        by = {k.kind: k for k in node.kids}
        for k in node.kids:
            if k.kind in ("implParameter", "implResult", "implYield", "implErrorResult"):
                self.node(k.kids[-1])
        signature = by.get("dependentGenericSignature") or by.get("dependentPseudogenericSignature")
        if signature:
            self.signature(signature)
        invocation, pattern = by.get("implInvocationSubstitutions"), by.get("implPatternSubstitutions")
        if invocation:
            self.w("y")
            for k in invocation.kids:
                self.kids(k)
        if pattern:
            self.node(pattern.kids[0])
            self.w("y")
            for k in pattern.kids[1:]:
                self.kids(k)
        self.w("I" + ("s" if pattern else "") + ("I" if invocation else "") + ("P" if "dependentPseudogenericSignature" in by else ""))
        marks = {"implEscaping": "e", "implErasedIsolation": "A", "implSendingResult": "T", "implParameterSending": "T", "implParameterIsolated": "I", "implParameterImplicitLeading": "L"}
        for k in node.kids:
            if k.kind in marks:
                self.w(marks[k.kind])
            elif k.kind == "implDifferentiabilityKind":
                self.w(chr(k.index or 0))
            elif k.kind == "implConvention":
                self.w(next((o for o, t in G.IMPL_CALLEES.items() if t == k.text), ""))
            elif k.kind == "implFunctionConvention":
                letter = next((o for o, t in G.IMPL_CONVENTIONS.items() if t == k.kids[0].text), "")
                self.w(f"z{letter}{len(k.kids[1].text or '')}{k.kids[1].text}" if len(k.kids) > 1 else letter)
            elif k.kind == "implCoroutineKind":
                self.w(next((o for o, t in G.IMPL_COROUTINES.items() if t == k.text), ""))
            elif k.kind == "implFunctionAttribute":
                self.w({"@Sendable": "h", "@async": "H"}.get(k.text or "", ""))
            elif k.kind in ("implParameter", "implResult", "implYield", "implErrorResult"):
                table = _PARAMS if k.kind in ("implParameter", "implYield") else _RESULTS
                self.w({"implYield": "Y", "implErrorResult": "z"}.get(k.kind, "") + table.get(k.kids[0].text or "", ""))
                for m in k.kids[1:-1]:
                    self.w("w" if m.kind == "implParameterResultDifferentiability" and m.text else marks.get(m.kind, ""))
        self.w("_")

    def opaque(self, node: Tree) -> None:
        if self.known(node.digest()):
            return
        self.node(self.kid(node, 0))
        for i, k in enumerate(self.kid(node, 2).kids):
            self.w("_" if i else "y")
            self.kids(k)
        for k in node.kids[3:]:
            self.kids(k)
        self.w("Qo")
        self.index(node.kids[1].index)
        self.remember(node.digest())

    def opaque_result(self, node: Tree) -> None:
        if node.kids and node.kids[0].kind == "opaqueReturnTypeIndex":
            self.w("QR")
            self.index(node.kids[0].index)
        else:
            self.w("Qr")

    def macro(self, node: Tree) -> None:
        if node.kind in ("freestandingMacroExpansion", "macroExpansionUniqueName"):
            order, at = (0, 3, 1), 2
        else:
            order, at = ((0, 1, 2), 3) if len(node.kids) > 3 else ((0, 1), 2)
        for i in order:
            if i < len(node.kids):
                self.node(node.kids[i])
        self.w(_MACRO_OPS[node.kind])
        self.index(self.kid(node, at).index)

    def macro_loc(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        self.node(self.kid(node, 1))
        self.w("fMX")
        self.index(self.kid(node, 2).index)
        self.index(self.kid(node, 3).index)

    def completion(self, node: Tree) -> None:
        for i in (0, 1, 3):
            if i < len(node.kids):
                self.node(node.kids[i])
        self.w("Tz" if node.kind == "objCAsyncCompletionHandlerImpl" else "TZ")
        self.index(self.kid(node, 2).index)

    def key_path(self, node: Tree) -> None:
        for k in node.kids:
            if k.kind != "isSerialized":
                self.node(k)
        self.w({"keyPathGetterThunkHelper": "TK", "keyPathSetterThunkHelper": "Tk", "keyPathAppliedMethodThunkHelper": "TkMA", "keyPathUnappliedMethodThunkHelper": "Tkmu", "keyPathEqualsThunkHelper": "TH", "keyPathHashThunkHelper": "Th"}[node.kind])
        self.w("q" if any(k.kind == "isSerialized" for k in node.kids) else "")

    def autodiff(self, node: Tree) -> None:
        at = next(i for i, k in enumerate(node.kids) if k.kind == "autoDiffFunctionKind")
        for k in node.kids[:at]:
            self.node(k)
        self.w({"autoDiffFunction": "TJ", "autoDiffDerivativeVTableThunk": "TJV", "autoDiffSubsetParametersThunk": "TJS", "autoDiffSelfReorderingReabstractionThunk": "TJO"}[node.kind] + chr(node.kids[at].index or 0))
        for k, end in zip(node.kids[at + 1 :], "prP", strict=False):
            self.w((k.text or "") + end)

    def differentiability_witness(self, node: Tree) -> None:
        at = next(i for i, k in enumerate(node.kids) if k.kind == "index")
        for k in (*node.kids[:at], *node.kids[at + 3 :]):
            self.node(k)
        self.w(f"WJ{chr(node.kids[at].index or 0)}{node.kids[at + 1].text}p{node.kids[at + 2].text}r")

    def once(self, node: Tree) -> None:
        self.node(self.kid(node, 0))
        for k in self.kid(node, 1).kids:
            self.node(k)
            self.w("_")
        self.w("WZ" if node.kind == "globalVariableOnceFunction" else "Wz")

    def box(self, node: Tree) -> None:
        fields = [Tree("type", (Tree("inOut", (self.kid(k, 0).unwrapped(),)),)) if k.kind == "silBoxMutableField" else self.kid(k, 0) for k in self.kid(node, 0).kids]
        self.listed(fields)
        if len(node.kids) == 3:
            self.listed(node.kids[2].kids)
            self.node(node.kids[1])
        self.w("XX" if len(node.kids) == 3 else "Xx")

    def builtin(self, node: Tree) -> None:
        text = node.text or ""
        if text in _BUILTIN_OPS:
            self.w(_BUILTIN_OPS[text])
            return
        plain = text.removeprefix("Builtin.")
        if plain.startswith("Vec"):
            count, _, element = plain[3:].partition("x")
            self.builtin(Tree("builtinTypeName", text="Builtin." + element))
            plain, op = count, "Bv"
        elif plain.startswith("FPIEEE"):
            plain, op = plain[6:], "Bf"
        else:
            plain, op = plain.removeprefix("Int"), "Bi"
        if not plain.isdigit():
            raise SymbolEncodeError("unexpectedBuiltinType", text)
        self.w(f"{op}{plain}_")


_PARAM_CHANGES = ("functionSignatureSpecializationParamKind", "functionSignatureSpecializationParamPayload")


def _order(*steps) -> Callable[[Encoder, Tree], None]:
    """Emission by steps: a child position (skipped where there is none), ("list", i), ("pure", i), ("index", i) or literal text."""

    def emit(e: Encoder, node: Tree) -> None:
        for s in steps:
            if isinstance(s, int):
                if s < len(node.kids):
                    e.node(node.kids[s])
            elif isinstance(s, str):
                e.w(s)
            elif s[0] == "list":
                e.listed(node.kids[s[1]].kids if s[1] < len(node.kids) else ())
            elif s[0] == "pure":
                e.pure_protocol(e.kid(node, s[1]))
            else:
                e.index(e.kid(node, s[1]).index)

    return emit


_SPECIAL: dict[str, Callable[[Encoder, Tree], None]] = {
    "global": Encoder.top, "type": lambda e, n: e.node(e.kid(n, 0)), "identifier": Encoder.name, "tupleElementName": Encoder.name, "module": Encoder.module,
    "prefixOperator": lambda e, n: (e.name(n), e.w("op"))[0], "postfixOperator": lambda e, n: (e.name(n), e.w("oP"))[0], "infixOperator": lambda e, n: (e.name(n), e.w("oi"))[0],
    "privateDeclName": lambda e, n: (e.kids(n, back=True), e.w("LL" if len(n.kids) > 1 else "Ll"))[0], "localDeclName": _order(1, "L", ("index", 0)),
    "relatedEntityDeclName": lambda e, n: (e.node(e.kid(n, 1)), e.w("L" + (n.kids[0].text or "")))[0], "extension": _order(1, 0, 2, "E"),
    "anonymousContext": _order(1, 0, ("list", 2), "XZ"), "suffix": lambda e, n: e.w(n.text or ""), "function": Encoder.function,
    "boundGenericFunction": Encoder.bound, "argumentTuple": Encoder.argument, "returnType": Encoder.argument, "labelList": lambda e, n: e.kids(n) if n.kids else e.w("y"),
    "variable": lambda e, n: e.storage(n, "p"), "subscript": lambda e, n: e.storage(n, "p"), "explicitClosure": Encoder.closure, "implicitClosure": Encoder.closure,
    "defaultArgumentInitializer": Encoder.default_argument, "macro": lambda e, n: (e.kids(n), e.w("fm"))[0], "genericTypeParamDecl": lambda e, n: (e.kids(n), e.w("fp"))[0],
    "tuple": lambda e, n: (e.listed(n.kids), e.w("t"))[0], "tupleElement": lambda e, n: e.kids(n, back=True), "typeList": lambda e, n: e.listed(n.kids),
    "pack": lambda e, n: (e.listed(n.kids), e.w("QP"))[0], "packExpansion": _order(0, 1, "Qp"), "packElement": _order(0, "Qe", ("index", 1)),
    "protocolList": lambda e, n: (e.listed(e.kid(n, 0).kids, e.pure_protocol), e.w("p"))[0],
    "protocolListWithClass": lambda e, n: (e.listed(e.kid(e.kid(n, 0), 0).kids, e.pure_protocol), e.node(e.kid(n, 1)), e.w("Xc"))[0],
    "dependentGenericParamType": lambda e, n: e.w("x") if not e.kid(n, 0).index and not e.kid(n, 1).index else (e.w("q"), e.param(n))[0],
    "constrainedExistentialSelf": lambda e, n: e.w("qs"), "dependentMemberType": Encoder.member, "dependentAssociatedTypeRef": lambda e, n: e.kids(n), "assocTypePath": lambda e, n: e.listed(n.kids),
    "dependentGenericSignature": Encoder.signature, "dependentPseudogenericSignature": Encoder.signature, "dependentGenericType": _order(1, 0, "u"),
    "dependentGenericConformanceRequirement": Encoder.conformance_requirement, "dependentGenericSameTypeRequirement": Encoder.same_type,
    "dependentGenericLayoutRequirement": Encoder.layout, "dependentGenericInverseConformanceRequirement": Encoder.inverse, "dependentGenericParamPackMarker": Encoder.marker,
    "dependentGenericParamValueMarker": Encoder.marker, "dependentGenericSameShapeRequirement": Encoder.marker, "protocolConformance": Encoder.conformance,
    "concreteProtocolConformance": Encoder.concrete, "protocolConformanceRefInOtherModule": Encoder.other_module, "anyProtocolConformanceList": lambda e, n: e.listed(n.kids),
    "packProtocolConformance": _order(0, "HX"), "dependentProtocolConformanceRoot": Encoder.dependent_conformance, "dependentProtocolConformanceInherited": Encoder.dependent_conformance,
    "dependentProtocolConformanceAssociated": Encoder.dependent_conformance, "dependentProtocolConformanceOpaque": _order(0, 1, "HO"), "dependentAssociatedConformance": _order(0, ("pure", 1)),
    "retroactiveConformance": _order(1, "g", ("index", 0)), "genericPartialSpecialization": Encoder.partial, "genericPartialSpecializationNotReAbstracted": Encoder.partial,
    "functionSignatureSpecialization": Encoder.function_specialization, "implFunctionType": Encoder.impl_function, "opaqueType": Encoder.opaque, "opaqueReturnType": Encoder.opaque_result,
    "macroExpansionLoc": Encoder.macro_loc, "objCAsyncCompletionHandlerImpl": Encoder.completion, "checkedObjCAsyncCompletionHandlerImpl": Encoder.completion,
    "reabstractionThunk": lambda e, n: (e.kids(n, back=True), e.w("Tr"))[0], "reabstractionThunkHelper": lambda e, n: (e.kids(n, back=True), e.w("TR"))[0],
    "reabstractionThunkHelperWithSelf": lambda e, n: (e.kids(n, back=True), e.w("Ty"))[0], "outlinedVariable": lambda e, n: (e.w("Tv"), e.index(n.index))[0],
    "outlinedReadOnlyObject": lambda e, n: (e.w("Tv"), e.index(n.index), e.w("r"))[0], "outlinedBridgedMethod": lambda e, n: e.w(f"Te{n.text or ''}_"),
    "autoDiffFunction": Encoder.autodiff, "autoDiffDerivativeVTableThunk": Encoder.autodiff, "autoDiffSubsetParametersThunk": Encoder.autodiff,
    "autoDiffSelfReorderingReabstractionThunk": lambda e, n: (e.kids(n.with_kids(n.kids[:-1])), e.w("TJO" + chr(n.kids[-1].index or 0)))[0],
    "differentiabilityWitness": Encoder.differentiability_witness, "globalVariableOnceFunction": Encoder.once, "globalVariableOnceToken": Encoder.once,
    "fieldOffset": lambda e, n: (e.node(e.kid(n, 1)), e.w("Wv" + "di"[n.kids[0].index or 0]))[0], "valueWitness": lambda e, n: (e.node(e.kid(n, 1)), e.w("w" + G.VALUE_WITNESSES[n.kids[0].index or 0]))[0],
    "silBoxTypeWithLayout": Encoder.box, "builtinTypeName": Encoder.builtin, "builtinTupleType": lambda e, n: e.w("BT"), "errorType": lambda e, n: e.w("Xe"),
    "constrainedExistential": lambda e, n: (e.node(e.kid(n, 0)), e.listed(e.kid(n, 1).kids), e.w("XP"))[0], "differentiableFunctionType": lambda e, n: e.w("Yj" + chr(n.index or 0)),
    "integer": lambda e, n: (e.w("$"), e.index(n.index))[0], "negativeInteger": lambda e, n: (e.w("$n"), e.index(n.index))[0],
    "extendedExistentialTypeShape": lambda e, n: (e.kids(n), e.w("XG" if len(n.kids) > 1 else "Xg"))[0], "associatedTypeRef": _order(0, 1, "Qa"), "typeMangling": _order(0, "D"),
    # Parts that the nodes around them write themselves, encoded on their own.
    "indexSubset": lambda e, n: e.w(n.text or ""), "directness": lambda e, n: e.w("di"[n.index or 0]), "packElementLevel": lambda e, n: e.index(n.index), "declContext": lambda e, n: e.node(e.kid(n, 0)),
    "clangType": lambda e, n: e.w(f"{len(n.text or '')}{n.text or ''}"), "globalVariableOnceDeclList": lambda e, n: [(e.node(k), e.w("_")) for k in n.kids],
    "constrainedExistentialRequirementList": lambda e, n: (e.kid(n, 0), e.listed(n.kids)), "symbolicExtendedExistentialType": lambda e, n: (e.node(e.kid(n, 0)), [e.kids(k) for k in n.kids[1:]]),
    "functionSignatureSpecializationParam": lambda e, n: e.changed(n, _PARAM_CHANGES), "functionSignatureSpecializationReturn": lambda e, n: e.changed(n, _PARAM_CHANGES),
} | {k: Encoder.key_path for k in ("keyPathGetterThunkHelper", "keyPathSetterThunkHelper", "keyPathAppliedMethodThunkHelper", "keyPathUnappliedMethodThunkHelper", "keyPathEqualsThunkHelper", "keyPathHashThunkHelper")}


def encode(tree: Tree, flavor: str = "default", use_punycode: bool = True, bare: bool = False) -> str:
    """The symbol of a tree. The prefix is always that of the current grammar; `bare` leaves it out. Raises SymbolEncodeError."""
    encoder = Encoder(use_punycode)
    try:
        encoder.node(tree)
    except (IndexError, StopIteration, AttributeError) as error:
        raise SymbolEncodeError("malformed", tree.kind) from error
    head = "" if bare or tree.kind != "global" else "_$e" if flavor == "embedded" else "_$s"
    return head + encoder.out
