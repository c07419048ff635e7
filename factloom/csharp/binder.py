"""Names and bodies of one unit's files: (s, p, o) facts and (fragment, file, lines) places.

The binder knows the unit's own declarations, predefined types and a list of
common library types.  Overloads are chosen by name and, where declared, number
of arguments; what it can't resolve keeps its written simple name.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

from .declarations import PREDEFINED, Member, Reader, SourceFile, TypeDecl, TypeRef, read
from .tokens import tokenize

#: Namespaces every file sees.
IMPLICIT = ("System", "System.Collections.Generic", "System.IO", "System.Linq", "System.Net.Http", "System.Threading", "System.Threading.Tasks")

#: Common library types by namespace, and the interfaces among them whose members matter.
LIBRARY = {
    "System": "Action ArgumentException ArgumentNullException Array Attribute Console Convert DateTime DateTimeOffset Delegate Environment EventArgs EventHandler Exception Func Guid IAsyncDisposable ICloneable IComparable IDisposable IEquatable IFormattable InvalidOperationException IObservable IObserver IProgress IServiceProvider Lazy Math NotImplementedException NotSupportedException Nullable Predicate Random Span StringComparer StringComparison TimeSpan Tuple Type Uri ValueTuple Version WeakReference",
    "System.Collections": "ArrayList Hashtable ICollection IComparer IDictionary IEnumerable IEnumerator IList Queue Stack",
    "System.Collections.Generic": "Comparer Dictionary EqualityComparer HashSet IAsyncEnumerable IAsyncEnumerator ICollection IComparer IDictionary IEnumerable IEnumerator IEqualityComparer IList IReadOnlyCollection IReadOnlyDictionary IReadOnlyList ISet KeyValuePair LinkedList LinkedListNode List PriorityQueue Queue SortedDictionary SortedList SortedSet Stack",
    "System.Collections.Concurrent": "BlockingCollection ConcurrentBag ConcurrentDictionary ConcurrentQueue ConcurrentStack",
    "System.IO": "BinaryReader BinaryWriter Directory DirectoryInfo File FileInfo FileStream MemoryStream Path Stream StreamReader StreamWriter StringReader StringWriter TextReader TextWriter",
    "System.Linq": "Enumerable IGrouping ILookup IOrderedEnumerable IQueryable Lookup Queryable",
    "System.Net.Http": "HttpClient HttpContent HttpRequestMessage HttpResponseMessage",
    "System.Text": "Encoding StringBuilder",
    "System.Threading": "CancellationToken CancellationTokenSource Interlocked Monitor SemaphoreSlim Thread Timer",
    "System.Threading.Tasks": "Parallel Task TaskCompletionSource ValueTask",
}
INTERFACE_MEMBERS = {
    "System.ICloneable": {"Clone"}, "System.IDisposable": {"Dispose"}, "System.IComparable": {"CompareTo"}, "System.IEquatable": {"Equals"}, "System.IObserver": {"OnNext", "OnError", "OnCompleted"},
    "System.IObservable": {"Subscribe"}, "System.Collections.IEnumerable": {"GetEnumerator"}, "System.Collections.Generic.IEnumerable": {"GetEnumerator"}, "System.Collections.IEnumerator": {"MoveNext", "Reset", "Current"},
    "System.Collections.Generic.IEnumerator": {"Current", "MoveNext", "Reset", "Dispose"}, "System.Collections.Generic.IComparer": {"Compare"}, "System.Collections.IComparer": {"Compare"}, "System.IProgress": {"Report"},
    "System.IServiceProvider": {"GetService"}, "System.IAsyncDisposable": {"DisposeAsync"},
}
_WHERE = {(ns, name): ns for ns, names in LIBRARY.items() for name in names.split()}

MODIFIERS = {m.lower(): m for m in ("Public", "Private", "Protected", "Internal", "Static", "Abstract", "Virtual", "Override", "Sealed", "ReadOnly", "Const")}
ACCESS = {"public", "private", "protected", "internal"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=", "<<="}


@lru_cache(1 << 16)
def clean(name: str) -> str:
    return re.sub(r"[^\w]", "_", name)


def node_of(t: TypeDecl) -> str:
    head = node_of(t.outer) if t.outer else ".".join(clean(x) for x in t.namespace.split(".")) if t.namespace else ""
    own = clean(t.name + (f"<{','.join(t.type_parameters)}>" if t.type_parameters else ""))
    return f"{head}.{own}" if head else own


class Bound:
    """A resolved type: its node, its declaration if scanned, and its arguments."""

    __slots__ = ("node", "simple", "decl", "args", "base", "element")

    def __init__(self, node, simple, decl=None, args=(), base=None, element=None):
        self.node, self.simple, self.decl, self.args, self.base, self.element = node, simple, decl, args, base, element


class Scope:
    """What names mean at a place: the declaration around it and its file."""

    def __init__(self, file: SourceFile, decl: TypeDecl | None, generics: frozenset = frozenset()):
        self.file, self.decl, self.generics = file, decl, generics


class Unit:
    def __init__(self, files: list[tuple[str, SourceFile]], told: frozenset[int] | None = None):
        """files: (path, declarations) in file order; all are declared, bodies are read by run.

        told: numbers of the files whose facts and places are wanted, of all where there are none; what an earlier file
        tells as well, a later one doesn't.
        """
        self.facts: dict[tuple[str, str, str], None] = {}
        self.places: dict[str, tuple[str, int, int]] = {}
        self.files = files
        self.fresh: dict[str, tuple[str, int, int]] = {}  # places of the file that is declared
        self.fulls: dict[int, str] = {}
        self.nodes: dict[int, str] = {}
        self.by_name: dict[str, list[TypeDecl]] = defaultdict(list)
        self.file_of: dict[int, SourceFile] = {}
        self.members: dict[str, list[tuple[str, Member, TypeDecl]]] = defaultdict(list)
        self.counts: dict[str, int] = defaultdict(int)
        self.bases: dict[str, list[Bound]] = defaultdict(list)
        for _, f in self.files:
            for t in f.types:
                self.by_name[self.full(t)].append(t)
                self.file_of[id(t)] = f
        if told is None:
            told = frozenset(range(len(files)))
        self.bodies, seen, wanted, places = [], set(), {}, {}
        for k, (path, f) in enumerate(self.files):
            self.facts = {}
            bodies = [b for t in f.types for b in self.declare(path, f, t)]
            if k in told:
                self.bodies += bodies
                wanted.update((x, None) for x in self.facts if x not in seen)
                places.update(self.fresh)
            seen.update(self.facts)
            self.fresh = {}
        self.facts, told_files = wanted, {id(files[k][1]) for k in told}
        self.implied_overrides(told_files)
        self.places = places

    def run(self) -> None:
        """Facts of the bodies of all files whose tokens are at hand."""
        for scope, owner, node, member in self.bodies:
            if scope.file.tokens:
                Body(self, scope, owner, node, member).run()

    def add(self, s: str, p: str, o: str) -> None:
        self.facts[(s, p, o)] = None

    # names

    def full(self, t: TypeDecl) -> str:
        """Namespace, outer types and name, with the number of type parameters."""
        known = self.fulls.get(id(t))
        if known is None:
            head = self.full(t.outer) if t.outer else t.namespace
            own = f"{t.name}`{len(t.type_parameters)}" if t.type_parameters else t.name
            known = self.fulls[id(t)] = f"{head}.{own}" if head else own
        return known

    def node(self, t: TypeDecl) -> str:
        known = self.nodes.get(id(t))
        if known is None:
            known = self.nodes[id(t)] = node_of(t)
        return known

    def lookup(self, name: str, arity: int, scope: Scope) -> TypeDecl | None:
        key = f"{name}`{arity}" if arity else name
        outer = scope.decl
        while outer is not None:
            for holder in self.family(outer):
                found = self.by_name.get(f"{self.full(holder)}.{key}")
                if found:
                    return found[0]
            outer = outer.outer
        space = scope.decl.namespace if scope.decl else ""
        while True:
            found = self.by_name.get(f"{space}.{key}" if space else key)
            if found:
                return found[0]
            if not space:
                break
            space = space.rpartition(".")[0]
        for u in scope.file.usings:
            found = self.by_name.get(f"{u}.{key}")
            if found:
                return found[0]
        return None

    def family(self, t: TypeDecl, seen: set | None = None) -> list[TypeDecl]:
        """A scanned type and its scanned bases, nearest first, through all parts."""
        seen = set() if seen is None else seen
        if self.full(t) in seen:
            return []
        seen.add(self.full(t))
        out = [t]
        for b in self.bases.get(self.node(t), ()):
            if b.decl is not None:
                out += self.family(b.decl, seen)
        return out

    def bind(self, ref: TypeRef | None, scope: Scope) -> Bound:
        if ref is None:
            return Bound("void", "void")
        if ref.kind == "nullable":
            return self.bind(ref.inner, scope)
        if ref.kind == "array":
            inner = self.bind(ref.inner, scope)
            return Bound(inner.node + "__", inner.simple + "[]", args=(inner,), element=inner)
        if ref.kind == "tuple":
            args = tuple(self.bind(p, scope) for p in ref.parts)
            return Bound(clean("System.ValueTuple").replace("_", ".", 1) + clean(f"<{','.join(a.simple for a in args)}>"), "ValueTuple", args=args)
        name, written = ref.parts[-1]
        args = tuple(self.bind(a, scope) for a in written)
        label = f"{name}<{','.join(a.simple for a in args)}>" if args else name
        if len(ref.parts) == 1:
            if name in PREDEFINED:
                return Bound(name, name)
            if name in scope.generics or self._generic(name, scope.decl):
                return Bound(clean(name), name)
            if name in scope.file.aliases and not args:
                return self.bind(scope.file.aliases[name], Scope(scope.file, None))
            decl = self.lookup(name, len(args), scope)
        else:
            decl = self.dotted(ref, scope)
        if decl is not None:
            node = self.node(decl)
            if args:
                node = (node.rpartition(".")[0] + "." if "." in node else "") + clean(label)
            return Bound(node, label, decl, args)
        space = ".".join(p for p, _ in ref.parts[:-1])
        for ns in [space] if space else [*scope.file.usings, *IMPLICIT]:
            if (ns, name) in _WHERE:
                if name in ("IEnumerable", "IEnumerator", "ICollection", "IList", "IComparer", "IDictionary") and ns.endswith("Generic") and not args:
                    continue
                return Bound(f"{ns}.{clean(label)}", label, args=args, base=f"{ns}.{name}")
        if name == "Nullable" and args:
            return args[0]
        return Bound(clean(label), label, args=args)

    def _generic(self, name: str, decl: TypeDecl | None) -> bool:
        return decl is not None and (name in decl.type_parameters or self._generic(name, decl.outer))

    def dotted(self, ref: TypeRef, scope: Scope) -> TypeDecl | None:
        keys = [f"{p}`{len(a)}" if a else p for p, a in ref.parts]
        tail = ".".join(keys)
        spaces, space = [], scope.decl.namespace if scope.decl else ""
        while space:
            spaces.append(space)
            space = space.rpartition(".")[0]
        for s in [*spaces, "", *scope.file.usings]:
            found = self.by_name.get(f"{s}.{tail}" if s else tail)
            if found:
                return found[0]
        head = self.lookup(ref.parts[0][0], len(ref.parts[0][1]), scope)
        if head is not None:
            found = self.by_name.get(f"{self.full(head)}.{'.'.join(keys[1:])}")
            return found[0] if found else None
        return None

    # declarations

    def declare(self, path: str, f: SourceFile, t: TypeDecl) -> list:
        scope, node = Scope(f, t), self.node(t)
        self.add(node, "type", t.kind)
        self.place(node, path, (t.line, t.line))
        bases = [self.bind(b, scope) for b in t.bases]
        self.bases[node] += bases
        for b in bases:
            self.add(node, "extends", b.node)
        self.modifiers(node, t.modifiers)
        out = []
        for m in t.members:
            member = f"{node}_{clean(m.name)}_{self.counts[node]}"
            self.counts[node] += 1
            self.members[node].append((member, m, t))
            self.place(member, path, m.lines)
            self.add(node, f"has{m.kind}", member)
            self.add(member, "type", m.kind)
            self.modifiers(member, m.modifiers)
            own = Scope(f, t, frozenset(m.type_parameters))
            if m.kind == "Constructor":
                if not ACCESS & set(m.modifiers) and "static" not in m.modifiers:
                    self.add(member, "hasModifier", "Private")
            else:
                kind = self.bind(m.type, own)
                self.add(member, "returnsType", kind.node)
                self.arguments(member, kind)
            if t.kind == "Interface" and m.bodiless and m.kind in ("Method", "Property") and not {"static"} & set(m.modifiers):
                self.add(member, "hasModifier", "Abstract")
            for p, _ in m.parameters:
                self.add(member, "hasParameterType", self.bind(p, own).node)
            if m.bodies:
                out.append((own, t, member, m))
        return out

    def modifiers(self, node: str, words: list[str]) -> None:
        for w in words:
            if w in MODIFIERS:
                self.add(node, "hasModifier", MODIFIERS[w])

    def arguments(self, member: str, kind: Bound) -> None:
        """Type arguments at every depth, and elements of arrays."""
        for a in kind.args:
            self.add(member, "hasTypeArgument", a.node)
            self.arguments(member, a)

    def place(self, node: str, path: str, lines: tuple[int, int]) -> None:
        if node not in self.places:
            self.places[node] = self.fresh[node] = (path, *lines)

    # interfaces

    def interfaces(self, node: str, seen: set[str]) -> list[Bound]:
        out = []
        for b in self.bases.get(node, ()):
            key = self.node(b.decl) if b.decl else b.node
            if key in seen:
                continue
            seen.add(key)
            out.append(b)
            if b.decl is not None:
                out += self.interfaces(key, seen)
            elif b.base == "System.Collections.Generic.IEnumerable":
                out.append(Bound("System.Collections.IEnumerable", "IEnumerable", base="System.Collections.IEnumerable"))
            elif b.base == "System.Collections.Generic.IEnumerator":
                out += [Bound(n, n, base=n) for n in ("System.Collections.IEnumerator", "System.IDisposable")]
        return out

    def implied_overrides(self, told: set[int]) -> None:
        """Members that implement an interface's member, declared on the type itself, of the files told (by id)."""
        for node, members in list(self.members.items()):
            if not members or members[0][2].kind == "Interface":
                continue
            own = [x for x in members if id(self.file_of[id(x[2])]) in told]
            if not own:
                continue
            wanted: set[tuple[str, int | None, str]] = set()
            for b in self.interfaces(node, set()):
                if b.decl is not None and b.decl.kind == "Interface":
                    for _, m, _ in self.members.get(self.node(b.decl), ()):
                        if m.kind in ("Method", "Property"):
                            wanted.add((m.name, len(m.parameters), m.kind))
                elif b.base in INTERFACE_MEMBERS:
                    for name in INTERFACE_MEMBERS[b.base]:
                        wanted.update({(name, None, "Method"), (name, None, "Property")})
            for member, m, _ in own:
                if m.kind in ("Method", "Property") and ((m.name, len(m.parameters), m.kind) in wanted or (m.name, None, m.kind) in wanted):
                    if m.explicit is not None or "public" in m.modifiers:
                        self.add(member, "hasModifier", "Override")

    def find(self, decl: TypeDecl | None, name: str, arguments: int | None = None) -> tuple[str, Member, TypeDecl] | None:
        """A scanned member of a type or of its bases; methods by number of arguments first."""
        if decl is None:
            return None
        loose = None
        for t in self.family(decl):
            for entry in self.members.get(self.node(t), ()):
                m = entry[1]
                if m.name == name and m.kind != "Constructor":
                    if arguments is None or m.kind != "Method" or len(m.parameters) == arguments:
                        return entry
                    loose = loose or entry
        return loose


class Value:
    """What an expression is: its type, and the member or type that it names."""

    __slots__ = ("type", "member", "static")

    def __init__(self, type_=None, member=None, static=None):
        self.type, self.member, self.static = type_, member, static


class Body:
    """Facts of one member's code."""

    def __init__(self, unit: Unit, scope: Scope, owner: TypeDecl, node: str, member: Member):
        self.u, self.scope, self.owner, self.node, self.m = unit, scope, owner, node, member
        self.r = Reader("")
        self.r.t = scope.file.tokens
        self.locals: dict[str, Bound] = {name: unit.bind(t, scope) for t, name in member.parameters}
        if member.kind == "Property" and member.type is not None:
            self.locals["value"] = unit.bind(member.type, scope)

    def run(self) -> None:
        for a, b in self.m.bodies:
            # `=> this`
            if b - a == 1 and self.r.t[a].text == "this" and self.m.kind == "Method":
                self.u.add(self.node, "returnsSelf", self.u.node(self.owner))
            self.scan(a, b)

    def tok(self, i: int):
        return self.r.t[i].text if i < len(self.r.t) and self.r.t[i].kind != "str" else ""

    def kind(self, i: int) -> str:
        return self.r.t[i].kind if i < len(self.r.t) else ""

    def scan(self, i: int, end: int) -> None:
        while i < end:
            if self.tok(i) == "return" and self.tok(i + 1) == "this" and self.tok(i + 2) == ";" and self.m.kind == "Method":
                self.u.add(self.node, "returnsSelf", self.u.node(self.owner))
            n = self.declaration(i, end)
            if n:
                i = n
                continue
            if self.kind(i) == "id" or self.tok(i) in ("this", "base", "new", "("):
                j, _ = self.chain(i, end)
                i = max(j, i + 1)
            else:
                i += 1

    def declaration(self, i: int, end: int) -> int:
        """Declares the local that begins here; where its initialiser begins, or 0."""
        before = self.tok(i - 1)
        if before in (".", "?.", "new", "::") or self.kind(i) == "str":
            return 0
        if self.tok(i) == "var" and self.kind(i + 1) == "id" and self.kind(i) == "id":
            name, j = self.tok(i + 1), i + 2
            kind = None
            if self.tok(j) == "=":
                k, value = self.chain(j + 1, end, quiet=True)
                kind = value.type
            elif self.tok(j) == "in":
                k, value = self.chain(j + 1, end, quiet=True)
                kind = self.element(value.type)
            elif before == "out":
                kind = self.outer_element(i)
            if kind is not None:
                self.locals[name] = kind
            return j
        if self.kind(i) != "id" and self.tok(i) not in PREDEFINED:
            return 0
        self.r.i = i
        ref = self.r.type()
        j = self.r.i
        if ref is not None and self.kind(j) == "id" and self.tok(j + 1) in ("=", ";", "in", ",", ")", "&&", "||", "when", "=>", ":", "?") and self.tok(j) not in ("is", "in", "when", "and", "or", "not"):
            if self.tok(j + 1) in (",", ")", "=>", ":", "?") and not (before in ("is", "out", "(", ",", "case")):
                return 0
            self.locals[self.tok(j)] = self.u.bind(ref, self.scope)
            return j + 1
        return 0

    def element(self, t: Bound | None) -> Bound | None:
        if t is None:
            return None
        if t.element is not None:
            return t.element
        return t.args[-1] if t.args else None

    def outer_element(self, i: int) -> Bound | None:
        """The value type of the collection whose call has this out argument."""
        depth = 0
        while i > 0:
            i -= 1
            if self.tok(i) == ")":
                depth += 1
            elif self.tok(i) == "(":
                if not depth:
                    break
                depth -= 1
        j = i - 3
        if j >= 0 and self.tok(i - 2) in (".", "?."):
            while j > 0 and self.tok(j - 1) in (".", "?.") and (self.kind(j - 2) == "id" or self.tok(j - 2) == "this"):
                j -= 2
            _, value = self.chain(j, i - 2, quiet=True)
            return self.element(value.type)
        return None

    # expressions

    def chain(self, i: int, end: int, quiet: bool = False) -> tuple[int, Value]:
        """An expression of names, calls and indexes from i on: where it ends, and what it is."""
        facts = self.u.facts
        if quiet:
            self.u.facts = {}
        try:
            return self._chain(i, end)
        finally:
            if quiet:
                self.u.facts = facts

    def _chain(self, i: int, end: int) -> tuple[int, Value]:
        t = self.tok(i)
        if t == "new":
            i, value = self.creation(i, end)
        elif t == "(":
            self.r.i = i + 1
            ref = self.r.type()
            cast = ref is not None and self.tok(self.r.i) == ")" and (self.kind(self.r.i + 1) in ("id", "num") or self.tok(self.r.i + 1) in ("this", "new", "(", "base"))
            if cast and (ref.kind != "name" or len(ref.parts[0][1]) or self.tok(i + 2) == ")" or len(ref.parts) > 1):
                j, _ = self.chain(self.r.i + 1, end)
                return j, Value(self.u.bind(ref, self.scope))
            self.r.i = i
            a, b = self.r.skip_balanced()
            value = self.inner(a, b)
            i = b + 1
        elif t in ("this", "base"):
            decl = self.owner
            kind = Bound(self.u.node(decl), decl.name, decl)
            if t == "base":
                bases = [b for b in self.u.bases.get(kind.node, ()) if b.decl is None or b.decl.kind != "Interface"]
                kind = bases[0] if bases else kind
            value = Value(kind)
            i += 1
        elif self.kind(i) == "id":
            i, value = self.name(i, end)
        else:
            return i + 1, Value()
        while i < end:
            t = self.tok(i)
            if t in (".", "?.") and self.kind(i + 1) == "id":
                i, value = self.access(i + 1, end, value)
            elif t == "!" and self.tok(i + 1) in (".", "?.", "["):
                i += 1
            elif t == "[" or t == "?" and self.tok(i + 1) == "[":
                i += t == "?"
                self.r.i = i
                a, b = self.r.skip_balanced()
                self.scan(a, b)
                value = Value(self.element(value.type))
                i = b + 1
            elif t == "(":
                self.r.i = i
                a, b = self.r.skip_balanced()
                self.arguments(a, b, value)
                i, value = b + 1, Value()
            else:
                break
        if self.tok(i) in ASSIGN and value.member is not None and value.member[1].kind == "Field":
            self.u.add(self.node, "assignsField", value.member[0])
        return i, value

    def inner(self, a: int, b: int) -> Value:
        """A bracketed expression: its facts, and its type if it is a single chain or a conversion."""
        as_type = None
        for k in range(a, b):
            if self.tok(k) == "as":
                self.r.i = k + 1
                ref = self.r.type()
                as_type = self.u.bind(ref, self.scope) if ref else None
        if self.kind(a) == "id" or self.tok(a) in ("this", "base", "new", "("):
            j, value = self.chain(a, b, quiet=True)
            self.scan(a, b)
            return Value(as_type) if as_type else value if j >= b else Value(value.type if self.tok(j) in ("??", "?") else None)
        self.scan(a, b)
        return Value(as_type)

    def creation(self, i: int, end: int) -> tuple[int, Value]:
        self.r.i = i + 1
        ref = self.r.type()
        if ref is None:  # new(), new[], new { }
            self.r.i = i + 1
            if self.tok(i + 1) in ("(", "[", "{"):
                a, b = self.r.skip_balanced()
                self.scan(a, b)
                return b + 1, Value()
            return i + 1, Value()
        j = self.r.i
        kind = self.u.bind(ref, self.scope)
        if self.tok(j) == "[":  # an array of it
            self.r.i = j
            a, b = self.r.skip_balanced()
            self.scan(a, b)
            kind = Bound(kind.node + "__", kind.simple + "[]", args=(kind,), element=kind)
            j = b + 1
        elif ref.kind in ("name", "nullable") and self.m.kind == "Method":
            self.u.add(self.node, "instantiates", kind.node)
        for opening in ("(", "{"):
            if self.tok(j) == opening:
                self.r.i = j
                a, b = self.r.skip_balanced()
                self.scan(a, b)
                j = b + 1
        return j, Value(kind)

    def generic_end(self, i: int) -> int:
        """Past type arguments that open at i, where what follows allows them."""
        if self.tok(i) != "<":
            return i
        self.r.i = i
        if self.r.arguments() and self.tok(self.r.i) in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "?."):
            return self.r.i
        return i

    def name(self, i: int, end: int) -> tuple[int, Value]:
        name, j = self.tok(i), self.generic_end(i + 1)
        if self.tok(j) == "=>":  # a lambda's parameter
            return j, Value()
        if name == "nameof" and self.tok(j) == "(":
            self.r.i = j
            return self.r.skip_balanced()[1] + 1, Value()
        if name in self.locals and self.tok(j) != "(":
            return j, Value(self.locals[name])
        decl = self.owner
        while decl is not None:
            if self.tok(j) == "(" or self.u.find(decl, name) is not None:
                kind = Bound(self.u.node(decl), decl.name, decl)
                if self.tok(j) == "(":
                    found = self.u.find(decl, name, self.count(j))
                    if found is not None or decl.outer is None or name == "MemberwiseClone":
                        return self.called(name, j, Value(kind), end, implicit=True)
                else:
                    return j, self.named(self.u.find(decl, name))
            decl = decl.outer
        # a type: Name.Member, Name<T>.Member, Namespace.Name.Member
        if self.tok(j) == ".":
            self.r.i = i
            parts = [(name, self.r.arguments() if self.tok(i + 1) == "<" else ())]
            k, best = j, None
            while True:
                bound = self.u.bind(TypeRef("name", tuple(parts)), self.scope)
                if bound.decl is not None or bound.base is not None:
                    best = (k, bound)
                    break
                if not (self.tok(k) == "." and self.kind(k + 1) == "id" and self.tok(k + 2) == "."):
                    break
                parts.append((self.tok(k + 1), ()))
                k += 2
            if best:
                return best[0], Value(best[1], static=True)
        if self.tok(j) == "." and name[:1].isupper():
            return j, Value(self.u.bind(TypeRef("name", ((name, ()),)), self.scope), static=True)
        return j, Value()

    def count(self, i: int) -> int:
        """Arguments of the call whose bracket opens at i."""
        self.r.i = i
        a, b = self.r.skip_balanced()
        if a == b:
            return 0
        n, self.r.i = 1, a
        while self.r.i < b:
            before = self.r.i
            t = self.tok(self.r.i)
            if t in ("(", "[", "{"):
                self.r.skip_balanced()
            elif t == "<":
                self.r.i = max(self.generic_end(self.r.i), before + 1)
            else:
                n += t == ","
                self.r.i += 1
        return n

    def named(self, entry) -> Value:
        """A field, property or method group by name."""
        node, m, decl = entry
        if m.kind == "Property":
            self.u.add(self.node, "calls", node)
        kind = self.u.bind(m.type, Scope(self.u.file_of[id(decl)], decl, frozenset(m.type_parameters))) if m.type is not None else None
        return Value(kind, entry if m.kind in ("Field", "Property") else None)

    def access(self, i: int, end: int, value: Value) -> tuple[int, Value]:
        name, j = self.tok(i), self.generic_end(i + 1)
        if self.tok(j) == "(":
            if value.member is not None:
                self.u.add(self.node, "delegatesTo", value.member[0])
            return self.called(name, j, value, end)
        found = self.u.find(value.type.decl, name) if value.type is not None else None
        if found is not None:
            return j, self.named(found)
        if value.type is not None and name == "Value":
            return j, Value(self.element(value.type) or value.type)
        return j, Value(self.element(value.type) if name == "Values" and value.type else None) if name != "Values" else Value(value.type)

    def called(self, name: str, j: int, value: Value, end: int, implicit: bool = False) -> tuple[int, Value]:
        """A call of `name` whose bracket opens at j, on a value."""
        self.r.i = j
        a, b = self.r.skip_balanced()
        found = self.u.find(value.type.decl, name, self.count(j)) if value.type is not None else None
        if name == "MemberwiseClone" and found is None:
            self.u.add(self.node, "instantiates", self.u.node(self.owner))
        if found is not None:
            node, m, decl = found
            self.u.add(self.node, "invokes", self.u.node(decl))
            if m.kind in ("Method", "Property"):
                self.u.add(self.node, "calls", node)
            result = Value(self.u.bind(m.type, Scope(self.u.file_of[id(decl)], decl, frozenset(m.type_parameters))) if m.type is not None else None)
        else:
            if value.type is not None and not implicit:
                self.u.add(self.node, "invokes", value.type.node)
            keeps = {"Where", "OrderBy", "OrderByDescending", "ToList", "ToArray", "Take", "Skip", "Reverse", "Distinct", "Append", "Concat", "AsEnumerable"}
            gives = {"First", "FirstOrDefault", "Last", "LastOrDefault", "Single", "SingleOrDefault", "Pop", "Peek", "Dequeue", "ElementAt", "Find", "GetValueOrDefault"}
            result = Value(value.type if name in keeps else self.element(value.type) if name in gives else None)
        self.arguments(a, b, value)
        return b + 1, result

    def arguments(self, a: int, b: int, value: Value) -> None:
        """Facts of arguments; an untyped lambda's first parameter is an element of the receiver."""
        item, k, added = self.element(value.type), a, []
        while k < b and item is not None:
            names = []
            if self.kind(k) == "id" and self.tok(k + 1) == "=>":
                names = [self.tok(k)]
            elif self.tok(k) == "(":
                self.r.i = k
                x, y = self.r.skip_balanced()
                if self.tok(y + 1) == "=>" and all(self.kind(z) == "id" or self.tok(z) == "," for z in range(x, y)):
                    names = [self.tok(z) for z in range(x, y) if self.kind(z) == "id"]
            for n in names[:1]:
                if n not in self.locals:
                    self.locals[n] = item
                    added.append(n)
            k += 1
        self.scan(a, b)
        for n in added:
            self.locals.pop(n, None)


def build(sources: list[tuple[str, str]]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, int, int]]]:
    """Facts, and (fragment, file, start_line, end_line), of one unit's (path, text) in file order."""
    unit = Unit([(path, read(text)) for path, text in sources])
    unit.run()
    return list(unit.facts), [(n, *p) for n, p in unit.places.items()]


#: A dotted name of more words could be a type of too many namespaces.
_DEEPEST = 32


def _key(name: str) -> int:
    """A number for a dotted name; names that share one only add declarations that aren't needed."""
    data = name.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1])


def _spaces(namespace: str):
    """A namespace and those around it."""
    while namespace:
        yield namespace
        namespace = namespace.rpartition(".")[0]


class Outline(NamedTuple):
    """A file without its code, and the keys by which its unit's files need each other.

    A name is looked up in the namespaces around a declaration and in those that its file uses, so a file needs those
    that declare a type whose full name is one of these, a dot and a dotted name of its own text; nested types stand in
    the files of their outer type.  Parts of one type need each other.  Where a namespace has the name of a type, or a
    dotted name is very long, this doesn't hold, and the unit's parts need all of its files.
    """

    data: bytes
    declares: list[int]
    needs: list[int]  # of the file with its code
    signs: list[int]  # of its declarations alone
    types: list[int]
    spaces: list[int]
    deep: bool


def outline(text: str) -> Outline:
    found = read(text)
    tokens, found.tokens = found.tokens, []
    top = {f"{t.namespace}.{t.name}" if t.namespace else t.name for t in found.types if t.outer is None}
    around = {s for t in found.types for s in _spaces(t.namespace)}
    used = {s for u in found.usings for s in _spaces(u)}
    chains: set[str] = set()
    run: list[str] = []
    longest = 0
    for k, t in enumerate(tokens):
        if t.kind == "id":
            run = [x + "." + t.text for x in run[-_DEEPEST:]] + [t.text] if run and tokens[k - 1].text == "." else [t.text]
            longest = max(longest, len(run))
            chains.update(run)
        elif not (run and t.kind == "op" and t.text == "."):
            run = []
    nodes = {"#" + node_of(t) for t in found.types}
    within = ["", *around, *found.usings]
    needs = {f"{s}.{c}" if s else c for s in within for c in chains}
    ids = _written(found)
    signs = {x for x in needs if x.rpartition(".")[2] in ids}
    always = nodes | used
    keys = lambda names: [_key(n) for n in names]
    return Outline(pickle.dumps(found), keys(top | nodes), keys(needs | always), keys(signs | always), keys(top), keys(around), longest > _DEEPEST)


def _written(found: SourceFile) -> set[str]:
    """The names in the types that a file's declarations write."""
    out: set[str] = set()

    def add(ref: TypeRef | None) -> None:
        while ref is not None and ref.kind != "tuple":
            for name, arguments in ref.parts:
                out.add(name)
                for a in arguments:
                    add(a)
            ref = ref.inner
        for p in ref.parts if ref is not None else ():
            add(p)

    for r in found.aliases.values():
        add(r)
    for t in found.types:
        for b in t.bases:
            add(b)
        for m in t.members:
            add(m.type)
            for p, _ in m.parameters:
                add(p)
    return out


def build_part(outlines: list[tuple[str, bytes]], own: dict[int, str]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, int, int]]]:
    """What one part of a unit adds to it: facts and places of its own files (number among the outlines: text).

    outlines: (path, outline) of its own files and of all that they need, in file order.
    """
    files = [(path, pickle.loads(data)) for path, data in outlines]
    for k, text in own.items():
        files[k][1].tokens = tokenize(text)
    unit = Unit(files, frozenset(own))
    unit.run()
    return list(unit.facts), [(n, *p) for n, p in unit.places.items()]
