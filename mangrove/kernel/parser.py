"""Symbol to tree: one pass over the operators with a stack, driven by the tables of `grammar`."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from . import grammar as G
from . import punycode
from .tree import Tree

PREFIXES = ("_T0", "$S", "_$S", "$s", "_$s", "$e", "_$e", "@__swiftmacro_")
STDLIB, OBJC, CLANG = "Swift", "__C", "__C_Synthesized"
MASK = (1 << 64) - 1
MAX_REPEAT, MAX_TYPE_SIZE, MAX_WORDS = 2048, 4096, 26
#: Symbolic reference bytes: (kind, directness).
SYMBOLIC = {1: ("context", "direct"), 2: ("context", "indirect"), 9: ("accessorFunctionReference", "direct"), 10: ("uniqueExtendedExistentialTypeShape", "indirect"), 11: ("nonUniqueExtendedExistentialTypeShape", "direct"), 12: ("objectiveCProtocol", "direct")}
Resolver = Callable[[str, str, int], Tree | None]


class SymbolError(ValueError):
    """code: what went wrong; at: position in the symbol."""

    def __init__(self, code: str, at: int, wanted: str | None = None) -> None:
        super().__init__(f"{code} at {at}" + (f", wanted {wanted}" if wanted else ""))
        self.code, self.at, self.wanted = code, at, wanted


def prefix_of(symbol: str) -> str | None:
    return next((p for p in sorted(PREFIXES, key=len, reverse=True) if symbol.startswith(p)), None)


def typed(node: Tree) -> Tree:
    return Tree("type", (node,))


def number(value: int, kind: str = "index") -> Tree:
    return Tree(kind, index=value & MASK)


def word(text: str, kind: str = "identifier") -> Tree:
    return Tree(kind, text=text)


@cache
def nominal(kind: str, name: str) -> Tree:
    return typed(Tree(kind, (word(STDLIB, "module"), word(name))))


def generic_param(depth: int, index: int) -> Tree:
    return Tree("dependentGenericParamType", (number(depth), number(index)))


def words_in(text: str) -> list[str]:
    """The words of an identifier: they start at a letter or sign, end before `_` and before a capital after a small letter."""
    out, start = [], -1
    for i in range(len(text) + 1):
        c = text[i] if i < len(text) else "\0"
        if start >= 0 and (c in "_\0" or (c.isascii() and c.isupper() and not (text[i - 1].isascii() and text[i - 1].isupper()))):
            if i - start >= 2:
                out.append(text[start:i])
            start = -1
        if start < 0 and c not in "_\0" and not (c.isascii() and c.isdigit()):
            start = i
    return out


class Parser:
    def __init__(self, symbol: str, resolver: Resolver | None = None) -> None:
        self.s, self.at, self.resolver, self.references = symbol, 0, resolver, 0
        self.stack: list[Tree] = []
        self.subs: list[Tree] = []
        self.words: list[str] = []
        self.old_functions = False
        self.flavor = "default"

    # -- scanning -----------------------------------------------------------------------------

    def fail(self, wanted: str | None = None) -> SymbolError:
        return SymbolError("unexpected" if self.at <= len(self.s) else "endedPrematurely", self.at, wanted)

    def need(self, value):
        if value is None or value is False:
            raise self.fail()
        return value

    def peek(self) -> str:
        return self.s[self.at] if self.at < len(self.s) else ""

    def read(self, n: int = 1) -> str:
        if self.at + n > len(self.s):
            raise SymbolError("endedPrematurely", self.at)
        self.at += n
        return self.s[self.at - n : self.at]

    def take(self, text: str) -> bool:
        if self.s.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def match(self, text: str) -> None:
        if not self.take(text):
            raise SymbolError("matchFailed", self.at, text)

    def digits(self) -> str:
        start = self.at
        while self.peek() and self.peek() in "0123456789":
            self.at += 1
        return self.s[start : self.at]

    def natural(self) -> int | None:
        text = self.digits()
        return int(text) & MASK if text else None

    def number(self) -> int:
        if self.take("_"):
            return 0
        value = self.need(self.natural())
        self.match("_")
        return (value + 1) & MASK

    # -- the stack ----------------------------------------------------------------------------

    def pop(self, *kinds: str) -> Tree | None:
        if self.stack and (not kinds or self.stack[-1].kind in kinds):
            return self.stack.pop()
        return None

    def pop_in(self, kinds: set[str]) -> Tree | None:
        return self.stack.pop() if self.stack and self.stack[-1].kind in kinds else None

    def type(self) -> Tree:
        return self.need(self.pop("type"))

    def type_child(self) -> Tree:
        return self.need(self.type().kid(0))

    def module(self) -> Tree | None:
        name = self.pop("identifier")
        return name.renamed("module") if name else self.pop("module")

    def context(self) -> Tree:
        module = self.module()
        if module:
            return module
        wrapped = self.pop("type")
        if wrapped:
            child = self.need(wrapped.kid(0))
            self.need(child.kind in G.CONTEXTS)
            return child
        return self.need(self.pop_in(G.CONTEXTS))

    def decl_name(self) -> Tree:
        return self.need(self.pop_in(G.DECL_NAMES))

    def protocol(self) -> Tree:
        wrapped = self.pop("type")
        if wrapped:
            inner = wrapped.unwrapped()
            self.need(inner is not None and inner.kind in G.PROTOCOLS)
            return wrapped
        reference = self.pop("protocolSymbolicReference", "objectiveCProtocolSymbolicReference")
        if reference:
            return reference
        name = self.decl_name()
        return typed(Tree("protocol", (self.context(), name)))

    def listed(self, one) -> list[Tree]:
        """Operands down to the one that carries the first-element mark, in the order in which they were pushed."""
        out, first = [], False
        while not first:
            first = self.pop("firstElementMarker") is not None
            out.append(self.need(one()))
        return out[::-1]

    def maybe_listed(self, one) -> list[Tree]:
        return [] if self.pop("emptyList") else self.listed(one)

    def type_list(self) -> Tree:
        return Tree("typeList", self.maybe_listed(self.type))

    def protocol_list(self) -> Tree:
        return Tree("protocolList", (Tree("typeList", self.maybe_listed(self.protocol)),))

    def associated_name(self) -> Tree:
        proto = self.pop("type")
        if proto:
            inner = proto.unwrapped()
            self.need(inner is not None and inner.kind in G.PROTOCOLS)
        else:
            proto = self.pop("protocolSymbolicReference", "objectiveCProtocolSymbolicReference")
        name = self.need(self.pop("identifier"))
        return Tree("dependentAssociatedTypeRef", (name, proto) if proto else (name,))

    def associated_path(self) -> Tree:
        return Tree("assocTypePath", self.listed(self.associated_name))

    def conformance(self) -> Tree:
        signature = self.pop("dependentGenericSignature")
        module = self.need(self.module())
        proto = self.protocol()
        subject, extra = self.pop("type"), None
        if not subject:
            extra = self.pop("identifier")
            subject = self.pop("type")
        self.need(subject)
        if signature:
            subject = typed(Tree("dependentGenericType", (signature, subject)))
        return Tree("protocolConformance", (subject, proto, module, extra) if extra else (subject, proto, module))

    def operand(self, letter: str) -> Tree:
        match letter:
            case "t":
                return self.type()
            case "c":
                return self.type_child()
            case "g":
                of = self.type_child()
                self.need(of.kind in G.ANY_GENERICS)
                return of
            case "e":
                return self.need(self.pop_in(G.ENTITY_KINDS))
            case "p":
                return self.protocol()
            case "f":
                return self.conformance()
            case "n":
                return self.decl_name()
            case "x":
                return self.context()
            case "m":
                return self.need(self.module())
            case "i":
                return self.need(self.pop("identifier"))
            case "P":
                return self.associated_path()
            case "N":
                return self.associated_name()
            case "l":
                return self.protocol_list()
            case "k":
                return number(self.number(), "number")
        return self.need(self.pop())

    # -- top level ----------------------------------------------------------------------------

    def symbol(self) -> Tree:
        if self.take("_Tt"):
            return self.objc_type()
        self.old_functions = self.s.startswith("_T")
        prefix = prefix_of(self.s)
        if prefix is None:
            raise SymbolError("matchFailed", 0, "a prefix")
        self.at = len(prefix)
        self.flavor = "embedded" if prefix in ("$e", "_$e") else "default"
        self.operators()
        suffix = self.pop("suffix")
        kids = self.top_level()
        if suffix:
            kids.append(suffix)
        self.need(bool(kids))
        return Tree("global", kids)

    def bare_type(self) -> Tree:
        self.operators()
        return self.pop() or word(self.s, "suffix")

    def operators(self) -> None:
        while self.at < len(self.s) and self.s[self.at] != "\0":
            node = self.operator()
            self.stack.append(node)

    def top_level(self) -> list[Tree]:
        out: list[Tree] = []
        while attribute := self.pop_in(G.FUNCTION_ATTRIBUTES):
            if attribute.kind in ("partialApplyForwarder", "partialApplyObjCForwarder"):
                return [*out, attribute.plus(*self.top_level())]
            out.append(attribute)
        return out + [self.need(n.kid(0)) if n.kind == "type" else n for n in self.stack]

    def objc_type(self) -> Tree:
        kind = self.read()
        if kind not in "CP":
            raise self.fail()
        module = word(STDLIB, "module") if self.take("s") else self.identifier().renamed("module")
        named = Tree("class" if kind == "C" else "protocol", (module, self.identifier()))
        if kind == "P":
            self.match("_")
            named = Tree("protocolList", (Tree("typeList", (typed(named),)),))
        self.need(self.at == len(self.s))
        return Tree("global", (Tree("typeMangling", (typed(named),)),))

    # -- operators ----------------------------------------------------------------------------

    def operator(self) -> Tree:
        while self.peek() == "ÿ":
            self.at += 1
        c = self.read()
        if "\x01" <= c <= "\x0c":
            return self.symbolic(ord(c))
        run = _ONE.get(c)
        if run is not None:
            return run(self)
        for n in (2, 3):
            run = _LONGER.get(self.s[self.at - 1 : self.at - 1 + n])
            if run is not None:
                self.at += n - 1
                return run(self)
        run = _SPECIAL.get(c)
        if run is None:
            raise self.fail()
        return run(self)

    def remember(self, node: Tree) -> Tree:
        self.subs.append(node)
        return node

    def symbolic(self, byte: int) -> Tree:
        kind, directness = self.need(SYMBOLIC.get(byte))
        node = self.need(self.resolver(kind, directness, self.references) if self.resolver else None)
        self.references += 1
        if kind in ("context", "objectiveCProtocol") and node.kind not in ("opaqueTypeDescriptorSymbolicReference", "opaqueReturnTypeOf"):
            self.subs.append(node)
        return node

    def substitution(self) -> Tree:
        repeat = -1
        while True:
            c = self.read()
            if c.isascii() and c.isalpha():
                node = self.repeated(repeat, ord(c.lower()) - 97)
                if c.isupper():
                    return node
                self.stack.append(node)
                repeat = -1
            elif c == "_":
                at = repeat + 27
                self.need(0 <= at < len(self.subs))
                return self.subs[at]
            else:
                self.at -= 1
                repeat = self.need(self.natural())

    def repeated(self, repeat: int, at: int) -> Tree:
        self.need(at < len(self.subs) and repeat <= MAX_REPEAT)
        self.stack.extend([self.subs[at]] * max(0, repeat - 1))
        return self.subs[at]

    def standard(self) -> Tree:
        if self.take("o"):
            return word(OBJC, "module")
        if self.take("C"):
            return word(CLANG, "module")
        if self.take("g"):
            return self.remember(typed(Tree("boundGenericEnum", (nominal("enum", "Optional"), Tree("typeList", (self.type(),))))))
        repeat = self.natural()
        self.need(repeat is None or repeat <= MAX_REPEAT)
        table = G.CONCURRENCY if self.take("c") else G.STANDARD
        node = nominal(*self.need(table.get(self.read())))
        self.stack.extend([node] * max(0, (repeat or 0) - 1))
        return node

    def identifier(self) -> Tree:
        by_words = hidden = False
        if not (self.peek() and self.peek() in "0123456789"):
            raise self.fail("identifier")
        if self.take("0"):
            hidden = self.take("0")
            by_words = not hidden
        text = ""
        while True:
            while by_words and (c := self.peek()) and c.isascii() and c.isalpha():
                self.at += 1
                at = ord(c.lower()) - 97
                by_words = c.islower()
                self.need(at < len(self.words))
                text += self.words[at]
            if self.take("0"):
                break
            n = self.natural()
            self.need(n is not None and n > 0)
            if hidden:
                self.take("_")
            part = self.read(n)
            if hidden:
                text += self.need(punycode.decode(part))
            else:
                text += part
                self.words += words_in(part)
                del self.words[MAX_WORDS:]
            if not by_words:
                break
        self.need(bool(text))
        return self.remember(word(text))

    def operator_name(self) -> Tree:
        name = self.need(self.pop("identifier")).text or ""
        text = ""
        for c in name:
            if c.isascii():
                self.need("a" <= c <= "z")
                c = G.OPERATOR_CHARS[ord(c) - 97]
                self.need(c != " ")
            text += c
        return word(text, self.need({"i": "infixOperator", "p": "prefixOperator", "P": "postfixOperator"}.get(self.read())))

    def local_name(self) -> Tree:
        if self.take("L"):
            discriminator = self.operand("i")
            return Tree("privateDeclName", (discriminator, self.decl_name()))
        if self.take("l"):
            return Tree("privateDeclName", (self.operand("i"),))
        if self.peek() and self.peek() in "abcdefghijABCDEFGHIJ":
            return Tree("relatedEntityDeclName", (word(self.read()), self.need(self.pop())))
        at = number(self.number(), "number")
        return Tree("localDeclName", (at, self.decl_name()))

    def builtin(self) -> Tree:
        c = self.read()
        if c in G.BUILTINS:
            return typed(word("Builtin." + G.BUILTINS[c], "builtinTypeName"))
        if c == "T":
            return typed(Tree("builtinTupleType"))
        self.need(c in "fiv")
        n = self.number() - 1
        self.need(0 < n <= MAX_TYPE_SIZE)
        if c == "v":
            element = self.type_child().text
            self.need(element is not None and element.startswith("Builtin."))
            name = f"Vec{n}x{element[8:]}"
        else:
            name = f"{'FPIEEE' if c == 'f' else 'Int'}{n}"
        return typed(word("Builtin." + name, "builtinTypeName"))

    def extension(self) -> Tree:
        signature = self.pop("dependentGenericSignature")
        module = self.need(self.module())
        of = self.type_child()
        self.need(of.kind in G.ANY_GENERICS)
        return Tree("extension", (module, of, signature) if signature else (module, of))

    # -- functions ----------------------------------------------------------------------------

    def clang_type(self) -> Tree:
        return word(self.read(self.need(self.natural())), "clangType")

    def function_type(self, kind: str, clang: bool = False) -> Tree:
        kids = [self.clang_type()] if clang else []
        for marks in G.FUNCTION_MARKS:
            if mark := self.pop(*marks):
                kids.append(mark)
        for role in ("argumentTuple", "returnType"):
            kids.append(Tree(role, (typed(Tree("tuple")) if self.pop("emptyList") else self.type(),)))
        return typed(Tree(kind, kids))

    def labels(self, of: Tree) -> Tree | None:
        if not self.old_functions and self.pop("emptyList"):
            return Tree("labelList")
        if of.kind != "type":
            return None
        function = self.need(of.kid(0))
        if function.kind == "dependentGenericType":
            function = self.need(self.need(function.kid(1)).kid(0))
        if function.kind not in ("functionType", "noEscapeFunctionType"):
            return None
        arguments = self.need(function.child("argumentTuple"))
        inner = self.need(self.need(arguments.kid(0)).kid(0))
        count = len(inner.kids) if inner.kind == "tuple" else 1
        if not count:
            return None
        if self.old_functions or inner.kind != "tuple":
            return Tree("labelList")
        found = [self.need(self.pop("identifier", "firstElementMarker")) for _ in range(count)]
        return Tree("labelList", found[::-1] if any(f.kind == "identifier" for f in found) else ())

    def with_parent(self, kind: str, kids: list[Tree], at: int) -> Tree:
        """The entity, opaque result types in the type `kids[at]` being told whose they are."""
        whole = Tree(kind, kids)
        if "Qr" not in self.s and "QR" not in self.s or not any(n.kind == "opaqueReturnType" for n in _own(kids[at])):
            return whole
        from .encoder import SymbolEncodeError, encode

        try:
            parent = word(encode(whole, bare=True), "opaqueReturnTypeParent")
        except SymbolEncodeError:
            parent = word("", "opaqueReturnTypeParent")
        return Tree(kind, [*kids[:at], _told(kids[at], parent, {}), *kids[at + 1 :]])

    def plain_function(self) -> Tree:
        signature = self.pop("dependentGenericSignature")
        of = self.function_type("functionType")
        labels = self.labels(of)
        if signature:
            of = typed(Tree("dependentGenericType", (signature, of)))
        name = self.decl_name()
        kids = [self.context(), name, *([labels] if labels else []), of]
        return self.with_parent("function", kids, len(kids) - 1)

    def named_entity(self, kind: str) -> Tree:
        of = self.type()
        labels = self.labels(of)
        name = self.decl_name()
        kids = [self.context(), name, *([labels] if labels else []), of]
        return self.with_parent(kind, kids, len(kids) - 1)

    def accessor(self, storage: Tree) -> Tree:
        op = self.read()
        if op == "p":
            return storage
        if op in "al":
            op += self.read()
        return Tree(self.need(G.ACCESSORS.get(op)), (storage,))

    def subscript(self) -> Tree:
        private = self.pop("privateDeclName")
        of = self.type()
        labels = self.labels(of)
        kids = [self.context(), *([labels] if labels else []), of, *([private] if private else [])]
        return self.accessor(self.with_parent("subscript", kids, 2 if labels else 1))

    def function_entity(self) -> Tree:
        op = self.read()
        if op in "mp":
            return self.named_entity("macro" if op == "m" else "genericTypeParamDecl")
        if op == "M":
            return self.macro()
        kind, takes = self.need(G.ENTITIES.get(op))
        kids: list[Tree] = []
        if takes == "index":
            kids = [number(self.number(), "number")]
        elif takes == "closure":
            kids = [number(self.number(), "number"), self.type()]
        elif takes == "type":
            private = self.pop("privateDeclName")
            of = self.type()
            labels = self.labels(of)
            kids = [*([labels] if labels else []), of, *([private] if private else [])]
        return Tree(kind, (self.context(), *kids))

    def macro(self) -> Tree:
        op = self.read()
        if op == "X":
            line, column = number(self.number()), number(self.number())
            buffer = self.operand("i")
            return Tree("macroExpansionLoc", (self.operand("i"), buffer, line, column))
        kind = self.need(G.MACROS.get(op))
        name = self.operand("i")
        private = self.pop("privateDeclName") if op == "f" else None
        attached = self.pop_in(G.DECL_NAMES) if op not in "fu" else None
        context = self.pop_in(G.MACRO_CONTEXTS) or self.context()
        at = number(self.number(), "number")
        return Tree(kind, [context, *([attached] if attached else []), name, at, *([private] if private else [])])

    # -- generics -----------------------------------------------------------------------------

    def generic_lists(self) -> tuple[list[Tree], Tree | None]:
        retroactive = []
        while c := self.pop("retroactiveConformance"):
            retroactive.append(c)
        lists = []
        while True:
            types = []
            while t := self.pop("type"):
                types.append(t)
            lists.append(Tree("typeList", types[::-1]))
            if self.pop("emptyList"):
                return lists, Tree("typeList", retroactive[::-1]) if retroactive else None
            self.need(self.pop("firstElementMarker"))

    def bound_generic(self) -> Tree:
        lists, retroactive = self.generic_lists()
        of = self.type_child()
        self.need(of.kind in G.ANY_GENERICS)
        bound = self.bind(of, lists, 0)
        return self.remember(typed(bound.plus(retroactive) if retroactive else bound))

    def bind(self, of: Tree, lists: list[Tree], at: int) -> Tree:
        if of.kind in ("typeSymbolicReference", "protocolSymbolicReference"):
            return Tree("boundGenericOtherNominalType", (typed(of), Tree("typeList", [k for x in reversed(lists) for k in x.kids])))
        context = self.need(of.kid(0))
        takes = of.kind not in ("variable", "subscript", "implicitClosure", "explicitClosure", "defaultArgumentInitializer", "initializer", "propertyWrapperBackingInitializer", "propertyWrapperInitFromProjectedValue", "propertyWrappedFieldInitAccessor", "static")
        self.need(at < len(lists))
        inner = at + takes
        if inner < len(lists):
            if context.kind == "extension":
                parent = Tree("extension", (context.kids[0], self.bind(self.need(context.kid(1)), lists, inner), *context.kids[2:3]))
            else:
                parent = self.bind(context, lists, inner)
            of = Tree(of.kind, (parent, *of.kids[1:]))
        if not takes or not lists[at].kids:
            return of
        if of.kind in ("function", "constructor"):
            return Tree("boundGenericFunction", (of, lists[at]))
        self.need(of.kind in ("class", "structure", "enum", "protocol", "otherNominalType", "typeAlias"))
        return Tree("boundGeneric" + of.kind[0].upper() + of.kind[1:], (typed(of), lists[at]))

    def param(self) -> Tree:
        if self.take("d"):
            depth = self.number() + 1
            return generic_param(depth, self.number())
        if self.take("z"):
            return generic_param(0, 0)
        if self.take("s"):
            return Tree("constrainedExistentialSelf")
        return generic_param(0, self.number() + 1)

    def member(self, base: Tree | None, compound: bool) -> Tree:
        names = self.listed(self.associated_name) if compound else [self.associated_name()]
        node = typed(base) if base else self.type()
        for name in names:
            node = typed(Tree("dependentMemberType", (node, name)))
        return self.remember(node)

    def signature(self, counted: bool) -> Tree:
        counts = []
        if counted:
            while not self.take("l"):
                counts.append(0 if self.take("z") else self.number() + 1)
        else:
            counts = [1]
        needs = []
        while r := self.pop_in(G.REQUIREMENT_KINDS):
            needs.append(r)
        return Tree("dependentGenericSignature", [*(number(c, "dependentGenericParamCount") for c in counts), *needs[::-1]])

    def requirement(self) -> Tree:
        constraint, spelt = "protocol", "g"
        inverse = None
        if self.peek() in G.REQUIREMENTS and self.peek():
            constraint, spelt = G.REQUIREMENTS[self.read()].split()
            if constraint == "inverse":
                inverse = number(self.number(), "number")
        if spelt == "g":
            subject = typed(self.param())
        elif spelt == "s":
            subject = self.type()
        else:
            subject = self.member(self.param(), spelt == "c")
        match constraint:
            case "pack":
                return Tree("dependentGenericParamPackMarker", (subject,))
            case "protocol":
                return Tree("dependentGenericConformanceRequirement", (subject, self.protocol()))
            case "inverse":
                return Tree("dependentGenericInverseConformanceRequirement", (subject, inverse))
            case "layout":
                c = self.read()
                self.need(c in "URNCDTBEMemS")
                sizes = [number(self.number(), "number") for _ in range(2 if c in "EM" else c in "emS")]
                return Tree("dependentGenericLayoutRequirement", (subject, word(c), *sizes))
        kinds = {"value": "dependentGenericParamValueMarker", "base": "dependentGenericConformanceRequirement", "same": "dependentGenericSameTypeRequirement", "shape": "dependentGenericSameShapeRequirement"}
        return Tree(kinds[constraint], (subject, self.type()))

    def generic_type(self) -> Tree:
        signature = self.need(self.pop("dependentGenericSignature"))
        return typed(Tree("dependentGenericType", (signature, self.type())))

    def tuple(self) -> Tree:
        def element() -> Tree:
            variadic, label = self.pop("variadicMarker"), self.pop("identifier")
            of = self.type()
            return Tree("tupleElement", [*([variadic] if variadic else []), *([word(label.text, "tupleElementName")] if label else []), of])

        return typed(Tree("tuple", self.maybe_listed(element)))

    def archetype(self) -> Tree:
        op = self.read()
        if op in "xXyYzZ":
            base = self.param() if op in "yY" else generic_param(0, 0) if op in "zZ" else None
            return self.member(base, op in "XYZ")
        match op:
            case "a":
                name = self.operand("i")
                return self.remember(typed(Tree("associatedTypeRef", (self.type_child(), name))))
            case "o":
                at = number(self.number())
                lists, retroactive = self.generic_lists()
                name = self.need(self.pop())
                return self.remember(typed(Tree("opaqueType", (name, at, Tree("typeList", lists[::-1]), *([retroactive] if retroactive else [])))))
            case "r":
                return typed(Tree("opaqueReturnType"))
            case "R":
                return typed(Tree("opaqueReturnType", (number(self.number(), "opaqueReturnTypeIndex"),)))
            case "p":
                count = self.type_child()
                return typed(Tree("packExpansion", (self.type_child(), count)))
            case "e":
                pack = self.type_child()
                return typed(Tree("packElement", (pack, number(self.number(), "packElementLevel"))))
            case "P":
                return typed(Tree("pack", self.maybe_listed(self.type)))
            case "S":
                self.need(self.read() in "di")
                return typed(Tree("pack", self.maybe_listed(self.type)))
        raise self.fail()

    def conformances(self) -> Tree:
        return Tree("anyProtocolConformanceList", self.maybe_listed(lambda: self.pop_in(G.CONFORMANCES)))

    def conformance_ref(self) -> Tree:
        op = self.read()
        if op == "X":
            return Tree("packProtocolConformance", (self.conformances(),))
        if op == "C":
            conditions = self.conformances()
            ref = self.pop("protocolConformanceRefInTypeModule", "protocolConformanceRefInProtocolModule")
            if not ref:
                module = self.need(self.module())
                ref = Tree("protocolConformanceRefInOtherModule", (self.protocol(), module))
            return Tree("concreteProtocolConformance", (self.type(), ref, conditions))
        nested = {"dependentProtocolConformanceRoot", "dependentProtocolConformanceInherited", "dependentProtocolConformanceAssociated"}
        if op == "O":
            of = self.type()
            return Tree("dependentProtocolConformanceOpaque", (self.need(self.pop_in(nested)), of))
        self.need(op in "ADI")
        n = self.number()
        self.need(n > 0)
        at = Tree("unknownIndex") if n == 1 else number(n - 2)
        proto = self.protocol()
        if op == "D":
            return Tree("dependentProtocolConformanceRoot", (self.type(), proto, at))
        if op == "I":
            return Tree("dependentProtocolConformanceInherited", (self.need(self.pop_in(nested)), proto, at))
        of = Tree("dependentAssociatedConformance", (self.type(), proto))
        return Tree("dependentProtocolConformanceAssociated", (self.need(self.pop_in(nested)), of, at))

    def retroactive(self) -> Tree:
        at = number(self.number(), "number")
        return Tree("retroactiveConformance", (at, self.need(self.pop_in(G.CONFORMANCES))))

    # -- thunks and specializations -----------------------------------------------------------

    def thunk(self) -> Tree:
        op = self.read()
        match op:
            case "z" | "Z":
                flags = number(self.number(), "number")
                signature = self.pop("dependentGenericSignature")
                result = self.type()
                kids = [self.type(), result, flags, *([signature] if signature else [])]
                return Tree("objCAsyncCompletionHandlerImpl" if op == "z" else "checkedObjCAsyncCompletionHandlerImpl", kids)
            case "R" | "r" | "y":
                signature = self.pop("dependentGenericSignature")
                kids = [self.type() for _ in range(3 if op == "y" else 2)]
                kind = {"R": "reabstractionThunkHelper", "y": "reabstractionThunkHelperWithSelf"}.get(op, "reabstractionThunk")
                return Tree(kind, [*([signature] if signature else []), *kids])
            case "g" | "G" | "B" | "s" | "i":
                return self.specialization(G.SPECIALIZATIONS[op], [])
            case "t":
                self.at -= 1
                dropped = []
                while self.take("t"):
                    n = self.natural()
                    dropped.append(number(0 if n is None else n + 1, "droppedArgument"))
                kind = self.read()
                self.need(kind in "gGB")
                return self.specialization(G.SPECIALIZATIONS[kind], dropped)
            case "P" | "p":
                kids = self.pass_attributes()
                return Tree("genericPartialSpecialization" + ("NotReAbstracted" if op == "P" else ""), [*kids, Tree("genericSpecializationParam", (self.type(),))])
            case "f":
                return self.function_specialization()
            case "K" | "k":
                kind = "keyPathUnappliedMethodThunkHelper" if self.take("mu") else "keyPathAppliedMethodThunkHelper" if self.take("MA") else "keyPathGetterThunkHelper" if op == "K" else "keyPathSetterThunkHelper"
                serialized = self.take("q")
                types = []
                while t := self.pop("type"):
                    types.append(t)
                subject = self.need(self.pop())
                kids = [self.need(self.pop()), subject] if subject.kind == "dependentGenericSignature" else [subject]
                return Tree(kind, [*kids, *types[::-1], *([Tree("isSerialized")] if serialized else [])])
            case "H" | "h":
                serialized = self.take("q")
                top = self.need(self.pop())
                self.need(top.kind in ("dependentGenericSignature", "type"))
                types = [top] if top.kind == "type" else []
                while n := self.pop():
                    self.need(n.kind == "type")
                    types.append(n)
                kids = types[::-1] + ([top] if top.kind != "type" else []) + ([Tree("isSerialized")] if serialized else [])
                return Tree("keyPathEqualsThunkHelper" if op == "H" else "keyPathHashThunkHelper", kids)
            case "v":
                n = self.number()
                return number(n, "outlinedReadOnlyObject" if self.take("r") else "outlinedVariable")
            case "e":
                return word(self.bridged(), "outlinedBridgedMethod")
            case "J":
                return self.autodiff()
        raise self.fail()

    def bridged(self) -> str:
        if self.take("_"):
            return ""
        out = self.read()
        if out not in "opam":
            return ""
        while not self.take("_"):
            c = self.read()
            self.need(c in "nbg")
            out += c
        return out

    def rest(self) -> list[Tree]:
        kids, self.stack = self.stack, []
        return kids

    def subset(self) -> Tree:
        start = self.at
        while self.peek() and self.peek() in "SU":
            self.at += 1
        self.need(self.at > start)
        return word(self.s[start : self.at], "indexSubset")

    def subsets(self) -> list[Tree]:
        params = self.subset()
        self.match("p")
        results = self.subset()
        self.match("r")
        return [params, results]

    def autodiff(self) -> Tree:
        how = lambda: number(ord(self.need((c := self.read()) in "frdp" and c)), "autoDiffFunctionKind")
        if self.take("S"):
            kids = [*self.rest(), how(), *self.subsets(), self.subset()]
            self.match("P")
            return Tree("autoDiffSubsetParametersThunk", kids)
        if self.take("O"):
            signature = self.pop("dependentGenericSignature")
            kids = [self.type(), self.type()][::-1] + ([signature] if signature else [])
            return Tree("autoDiffSelfReorderingReabstractionThunk", [*kids, how()])
        kind = "autoDiffDerivativeVTableThunk" if self.take("V") else "autoDiffFunction"
        return Tree(kind, [*self.rest(), how(), *self.subsets()])

    def witness(self) -> Tree:
        op = self.read()
        match op:
            case "v":
                way = self.need({"d": 0, "i": 1}.get(self.read()) is not None) and number("di".index(self.s[self.at - 1]), "directness")
                return Tree("fieldOffset", (way, self.operand("e")))
            case "O":
                signature = self.pop("dependentGenericSignature")
                kids = [self.type(), *([signature] if signature else [])]
                which = self.read()
                kind = self.need(G.OUTLINED.get(which))
                return Tree(kind, [*kids, *([number(self.number(), "number")] if which in "ij" else [])])
            case "Z" | "z":
                names = []
                while self.pop("firstElementMarker"):
                    names.append(self.decl_name())
                return Tree("globalVariableOnceFunction" if op == "Z" else "globalVariableOnceToken", (self.context(), Tree("globalVariableOnceDeclList", names[::-1])))
            case "J":
                signature = self.pop("dependentGenericSignature")
                kids = self.rest()
                how = self.read()
                self.need(how in "frdl")
                return Tree("differentiabilityWitness", [*kids, number(ord(how)), *self.subsets(), *([signature] if signature else [])])
        raise self.fail()

    def value_witness(self) -> Tree:
        code = self.read(2)
        self.need(code in G.VALUE_WITNESSES)
        return Tree("valueWitness", (number(G.VALUE_WITNESSES.index(code)), self.type()))

    def pass_attributes(self) -> list[Tree]:
        flags = [Tree(kind) for mark, kind in (("q", "isSerialized"), ("a", "asyncRemoved"), ("r", "representationChanged")) if self.take(mark)]
        digit = self.read()
        self.need(digit in "0123456789")
        return [*flags, number(int(digit), "specializationPassID")]

    def specialization(self, kind: str, dropped: list[Tree]) -> Tree:
        kids = self.pass_attributes()
        return Tree(kind, [*kids, *dropped, *(Tree("genericSpecializationParam", (t,)) for t in self.type_list().kids)])

    def function_specialization(self) -> Tree:
        kids = self.pass_attributes()
        self.natural()
        if kids[0].kind == "representationChanged":
            return Tree("functionSignatureSpecialization", kids)
        while not self.take("_"):
            kids.append(self.specialized_param("functionSignatureSpecializationParam"))
        if not self.take("n"):
            kids.append(self.specialized_param("functionSignatureSpecializationReturn"))
        for i in range(len(kids) - 1, -1, -1):
            if kids[i].kind != "functionSignatureSpecializationParam":
                continue
            more: list[Tree] = []
            for what in reversed([k.index for k in kids[i].kids if k.kind == "functionSignatureSpecializationParamKind"]):
                types = {_CLOSURE: 1 << 30, _KEY_PATH: 2, _STRUCT: 1}.get(what, 0)
                while types and (t := self.pop("type")):
                    more.append(t)
                    types -= 1
                if what in (_FUNCTION, _GLOBAL, _STRING, _CLOSURE, _KEY_PATH):
                    more.append(self.operand("i"))
            kids[i] = kids[i].plus(*more[::-1])
        return Tree("functionSignatureSpecialization", kids)

    def specialized_param(self, kind: str) -> Tree:
        out: list[Tree] = []
        how = lambda n: out.append(number(n, "functionSignatureSpecializationParamKind"))
        op = self.read()
        if op == "p":
            while (c := self.peek()) and c in "Sfgidsk":
                self.at += 1
                how({"S": _STRUCT, "f": _FUNCTION, "g": _GLOBAL, "i": _INTEGER, "d": _FLOAT, "s": _STRING, "k": _KEY_PATH}[c])
                if c in "id":
                    digits = self.digits()
                    self.need(bool(digits))
                    out.append(word(digits, "functionSignatureSpecializationParamPayload"))
                elif c == "s":
                    out.append(word(self.need({"b": "u8", "w": "u16", "c": "objc"}.get(self.read())), "functionSignatureSpecializationParamPayload"))
        elif op == "C":
            how(_PREVIOUS)
            out.append(number(self.need(self.natural()), "functionSignatureSpecializationParamPayload"))
        elif op in "edgo":
            value, flags = {"e": (1024, "DGOX"), "d": (64, "GOX"), "g": (128, "X"), "o": (512, "X")}[op]
            for flag in flags:
                if self.take(flag):
                    value |= {"D": 64, "G": 128, "O": 512, "X": 256}[flag]
            how(value)
        elif op != "n":
            how(self.need({"c": _CLOSURE, "x": 256, "i": 6, "s": 7, "r": 8}.get(op)))
        return Tree(kind, out)

    # -- special types ------------------------------------------------------------------------

    def special_type(self) -> Tree:
        op = self.read()
        match op:
            case "g" | "G":
                of = self.type()
                signature = self.pop("dependentGenericSignature") if op == "G" else None
                return Tree("extendedExistentialTypeShape", (signature, of) if signature else (of,))
            case "j":
                _, retroactive = [], []
                while c := self.pop("retroactiveConformance"):
                    retroactive.append(c)
                types = []
                while t := self.pop("type"):
                    types.append(t)
                shape = self.need(self.pop("uniqueExtendedExistentialTypeShapeSymbolicReference", "nonUniqueExtendedExistentialTypeShapeSymbolicReference"))
                kids = [shape, Tree("typeList", types[::-1])]
                return typed(Tree("symbolicExtendedExistentialType", kids + ([Tree("typeList", retroactive[::-1])] if retroactive else [])))
            case "M" | "m":
                way = word(self.need(G.METATYPES.get(self.read())), "metatypeRepresentation")
                return typed(Tree("metatype" if op == "M" else "existentialMetatype", (way, self.type())))
            case "P":
                needs = Tree("constrainedExistentialRequirementList", self.listed(lambda: self.pop_in(G.REQUIREMENT_KINDS)))
                return typed(Tree("constrainedExistential", (self.type(), needs)))
            case "c":
                above = self.type()
                return typed(Tree("protocolListWithClass", (self.protocol_list(), above)))
            case "X" | "x":
                generic = []
                if op == "X":
                    signature = self.need(self.pop("dependentGenericSignature"))
                    generic = [signature, self.type_list()]
                fields = []
                for t in self.type_list().kids:
                    if t.kids and t.kids[0].kind == "inOut":
                        fields.append(Tree("silBoxMutableField", (typed(self.need(t.kids[0].kid(0))),)))
                    else:
                        fields.append(Tree("silBoxImmutableField", (t,)))
                return typed(Tree("silBoxTypeWithLayout", [Tree("silBoxLayout", fields), *generic]))
            case "Z":
                types = self.type_list()
                name = self.operand("i")
                return Tree("anonymousContext", (name, self.context(), types))
            case "e":
                return typed(Tree("errorType"))
        raise self.fail()

    def differentiable(self) -> Tree:
        c = self.read()
        self.need(c in "frdl")
        return number(ord(c), "differentiableFunctionType")

    def annotation(self) -> Tree:
        self.match("j")
        return self.differentiable()

    def impl_convention(self, kind: str, table: dict[str, str]) -> Tree | None:
        text = table.get(self.peek())
        if text is None:
            return None
        self.at += 1
        return Tree(kind, (word(text, "implConvention"),))

    def impl_function(self) -> Tree:
        kids: list[Tree] = []
        if self.take("s"):
            lists, conformances = self.generic_lists()
            signature = self.need(self.pop("dependentGenericSignature"))
            kids.append(Tree("implPatternSubstitutions", (signature, lists[0], *([conformances] if conformances else []))))
        if self.take("I"):
            lists, conformances = self.generic_lists()
            kids.append(Tree("implInvocationSubstitutions", (lists[0], *([conformances] if conformances else []))))
        signature = self.pop("dependentGenericSignature")
        if signature and self.take("P"):
            signature = signature.renamed("dependentPseudogenericSignature")
        if self.take("e"):
            kids.append(Tree("implEscaping"))
        if self.take("A"):
            kids.append(Tree("implErasedIsolation"))
        if self.peek() and self.peek() in "frdl":
            kids.append(number(ord(self.read()), "implDifferentiabilityKind"))
        kids.append(word(self.need(G.IMPL_CALLEES.get(self.read())), "implConvention"))
        clang = self.s[self.at : self.at + 2] in ("zB", "zC")
        self.at += clang
        if name := G.IMPL_CONVENTIONS.get(self.peek()):
            self.at += 1
            kids.append(Tree("implFunctionConvention", [word(name, "implFunctionConventionName"), *([self.clang_type()] if clang else [])]))
        if name := G.IMPL_COROUTINES.get(self.peek()):
            self.at += 1
            kids.append(word(name, "implCoroutineKind"))
        if self.take("h"):
            kids.append(word("@Sendable", "implFunctionAttribute"))
        if self.take("H"):
            kids.append(word("@async", "implFunctionAttribute"))
        if self.take("T"):
            kids.append(Tree("implSendingResult"))
        if signature:
            kids.append(signature)
        typeless = len(kids)
        differentiability = lambda: word("@noDerivative" if self.take("w") else "", "implParameterResultDifferentiability")
        while p := self.impl_convention("implParameter", G.IMPL_PARAMS):
            marks = [differentiability()]
            for mark, kind, text in (("T", "implParameterSending", "sending"), ("I", "implParameterIsolated", "isolated"), ("L", "implParameterImplicitLeading", "sil_implicit_leading_param")):
                if self.take(mark):
                    marks.append(word(text, kind))
            kids.append(p.plus(*marks))
        while r := self.impl_convention("implResult", G.IMPL_RESULTS):
            kids.append(r.plus(differentiability()))
        while self.take("Y"):
            kids.append(self.need(self.impl_convention("implYield", G.IMPL_PARAMS)))
        if self.take("z"):
            kids.append(self.need(self.impl_convention("implErrorResult", G.IMPL_RESULTS)))
        self.match("_")
        for i in range(len(kids) - 1, typeless - 1, -1):
            kids[i] = kids[i].plus(self.type())
        return typed(Tree("implFunctionType", kids))

    def suffix(self) -> Tree:
        text, self.at = self.s[self.at - 1 :], len(self.s)
        return word(text, "suffix")

    def integer(self) -> Tree:
        negative = self.take("n")
        return typed(number(self.number(), "negativeInteger" if negative else "integer"))

    def digit(self) -> Tree:
        self.at -= 1
        return self.identifier()


_FUNCTION, _GLOBAL, _INTEGER, _FLOAT, _STRING, _CLOSURE, _KEY_PATH, _STRUCT, _PREVIOUS = 0, 1, 2, 3, 4, 5, 9, 10, 11
_SPECIAL: dict[str, Callable[[Parser], Tree]] = {
    "A": Parser.substitution, "B": Parser.builtin, "E": Parser.extension, "F": Parser.plain_function, "G": Parser.bound_generic, "H": Parser.conformance_ref,
    "I": Parser.impl_function, "L": Parser.local_name, "Q": Parser.archetype, "R": Parser.requirement, "S": Parser.standard, "T": Parser.thunk,
    "W": Parser.witness, "X": Parser.special_type, "Y": Parser.annotation, "f": Parser.function_entity, "g": Parser.retroactive, "i": Parser.subscript,
    "l": lambda p: p.signature(False), "o": Parser.operator_name, "p": lambda p: typed(p.protocol_list()), "q": lambda p: typed(p.param()),
    "r": lambda p: p.signature(True), "s": lambda p: word(STDLIB, "module"), "t": Parser.tuple, "u": Parser.generic_type,
    "v": lambda p: p.accessor(p.named_entity("variable")), "w": Parser.value_witness, "x": lambda p: typed(generic_param(0, 0)), ".": Parser.suffix, "$": Parser.integer,
} | {d: Parser.digit for d in "0123456789"}


def _regular(kind: str, pops: str, wrap: bool) -> Callable[[Parser], Tree]:
    def run(p: Parser) -> Tree:
        node = Tree(kind, [p.operand(letter) for letter in pops][::-1])
        return typed(node) if wrap else node

    return run


def _named(kind: str) -> Callable[[Parser], Tree]:
    def run(p: Parser) -> Tree:
        name = p.decl_name()
        return p.remember(typed(Tree(kind, (p.context(), name))))

    return run


_TABLES: dict[str, Callable[[Parser], Tree]] = {
    **{op: _regular(*rule) for op, rule in G.RULES.items()},
    **{op: lambda p, leaf=Tree(kind): leaf for op, kind in G.LEAF_KINDS.items()},
    **{op: lambda p, kind=kind, clang=op.startswith("Xz"): p.function_type(kind, clang) for op, kind in G.FUNCTIONS.items()},
    **{op: _named(kind) for op, kind in G.NOMINALS.items()},
}
_LONGER = {op: run for op, run in _TABLES.items() if len(op) > 1}
_ONE = {op: run for op, run in _TABLES.items() if len(op) == 1} | {op: run for op, run in _SPECIAL.items() if op not in {x[0] for x in _LONGER}}


def _own(node: Tree):
    """Nodes of a type, without those of entities inside it; each instance once."""
    stack, seen = [node], set()
    while stack:
        n = stack.pop()
        if id(n) in seen:
            continue
        seen.add(id(n))
        yield n
        if n.kind not in ("function", "variable", "subscript"):
            stack.extend(n.kids)


def _told(node: Tree, parent: Tree, done: dict[int, Tree]) -> Tree:
    if id(node) not in done:
        if node.kind == "opaqueReturnType":
            out = node if node.kids and node.kids[-1].kind == "opaqueReturnTypeParent" else node.plus(parent)
        elif node.kind in ("function", "variable", "subscript") or not node.kids:
            out = node
        else:
            kids = [_told(k, parent, done) for k in node.kids]
            out = node if all(a is b for a, b in zip(kids, node.kids, strict=True)) else node.with_kids(kids)
        done[id(node)] = out
    return done[id(node)]


def demangle(symbol: str, is_type: bool = False, resolver: Resolver | None = None) -> Tree:
    """The tree of a symbol, or with `is_type` of a mangled type without prefix. Raises SymbolError."""
    parser = Parser(symbol, resolver)
    if is_type:
        return parser.bare_type()
    if prefix_of(symbol) or symbol.startswith("_Tt") and symbol[3:4] in ("C", "P"):
        try:
            return parser.symbol()
        except SymbolError:
            if prefix_of(symbol):
                raise
    from .legacy import demangle_legacy

    return demangle_legacy(symbol)
