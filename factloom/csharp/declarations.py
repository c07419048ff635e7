"""Type and member declarations of a C# file; bodies stay as token ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokens import Token, tokenize

MODIFIER_WORDS = frozenset("public private protected internal static abstract virtual override sealed readonly const new extern unsafe volatile async partial required file ref".split())
TYPE_WORDS = ("class", "struct", "interface", "record", "enum", "delegate")
PREDEFINED = frozenset("bool byte sbyte char decimal double float int uint long ulong short ushort object string void".split())


@dataclass(frozen=True)
class TypeRef:
    """A written type: name (dotted parts with arguments), array, nullable or tuple."""

    kind: str
    parts: tuple = ()  # of a name: (identifier, arguments); of a tuple: element types
    inner: "TypeRef | None" = None


@dataclass
class Member:
    kind: str  # Constructor, Method, Property, Field
    name: str
    modifiers: list[str]
    type: TypeRef | None
    parameters: list[tuple[TypeRef, str]]
    lines: tuple[int, int]
    bodies: list[tuple[int, int]]  # token ranges
    bodiless: bool = False
    explicit: TypeRef | None = None  # the interface of an explicit implementation
    type_parameters: tuple[str, ...] = ()


@dataclass
class TypeDecl:
    kind: str  # Class, Interface, Struct
    name: str
    type_parameters: tuple[str, ...]
    namespace: str
    outer: "TypeDecl | None"
    modifiers: list[str]
    bases: list[TypeRef]
    line: int
    members: list[Member] = field(default_factory=list)


@dataclass
class SourceFile:
    tokens: list[Token]
    usings: list[str]
    aliases: dict[str, TypeRef]
    types: list[TypeDecl]


class Reader:
    def __init__(self, text: str):
        self.t = tokenize(text)
        self.i = 0
        self.file = SourceFile(self.t, [], {}, [])

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else ""

    def line(self, k: int = 0) -> int:
        return self.t[min(self.i + k, len(self.t) - 1)].line if self.t else 1

    def take(self, text: str) -> bool:
        if self.at() == text and self.kind() != "str":
            self.i += 1
            return True
        return False

    def skip_balanced(self) -> tuple[int, int]:
        """Past a bracketed range; the token range inside."""
        close = {"(": ")", "{": "}", "[": "]"}[self.at()]
        opening, depth, begin = self.at(), 0, self.i + 1
        while self.i < len(self.t):
            if self.kind() != "str":
                depth += (self.at() == opening) - (self.at() == close)
            self.i += 1
            if not depth:
                return begin, self.i - 1
        return begin, self.i

    def skip_to(self, *stops: str) -> tuple[int, int]:
        """To the next of the stops outside brackets."""
        begin = self.i
        while self.i < len(self.t) and not (self.kind() == "op" and self.at() in stops):
            if self.kind() == "op" and self.at() in "({[" and self.at():
                self.skip_balanced()
            elif self.kind() == "op" and self.at() in (")", "}", "]"):
                break
            else:
                self.i += 1
        return begin, self.i

    # types

    def type(self) -> TypeRef | None:
        """A written type from here on; None, and no move, if there is none."""
        start = self.i
        for word in ("ref", "readonly", "scoped", "in", "out", "params", "this"):
            if self.at() == word and self.kind() in ("word", "id"):
                if word in ("scoped", "params") and self.kind(1) not in ("id", "word"):
                    continue
                self.i += 1
        if self.at() == "(":
            self.i += 1
            parts = []
            while not self.take(")"):
                part = self.type()
                if part is None:
                    self.i = start
                    return None
                parts.append(part)
                if self.kind() == "id":
                    self.i += 1
                if not self.take(",") and self.at() != ")":
                    self.i = start
                    return None
            ref = TypeRef("tuple", tuple(parts))
            if len(parts) < 2:
                self.i = start
                return None
        elif self.kind() == "word" and self.at() in PREDEFINED:
            ref = TypeRef("name", ((self.at(), ()),))
            self.i += 1
        elif self.kind() == "id":
            parts = []
            while True:
                if self.kind() != "id":
                    self.i = start
                    return None
                name = self.at()
                self.i += 1
                if self.take("::"):
                    continue
                parts.append((name, self.arguments()))
                if not (self.at() == "." and self.kind(1) == "id"):
                    break
                self.i += 1
            ref = TypeRef("name", tuple(parts))
        else:
            self.i = start
            return None
        while True:
            if self.at() == "?" and self.kind() == "op":
                ref = TypeRef("nullable", inner=ref)
                self.i += 1
            elif self.at() == "[" and self.at(1) in ("]", ","):
                depth = self.i
                self.skip_balanced()
                if any(self.t[k].text != "," for k in range(depth + 1, self.i - 1)):
                    self.i = depth
                    return ref
                ref = TypeRef("array", inner=ref)
            elif self.at() == "*" and self.kind(1) == "id" and ref.kind == "name" and ref.parts[0][0] in PREDEFINED:
                self.i += 1
            else:
                return ref

    def arguments(self) -> tuple:
        """Type arguments if the angle bracket here opens some."""
        if self.at() != "<":
            return ()
        start = self.i
        self.i += 1
        out = []
        while True:
            if self.at() in (",", ">"):
                part = TypeRef("name", (("", ()),))
            else:
                while self.at() == "[":
                    self.skip_balanced()
                if self.at() in ("in", "out"):
                    self.i += 1
                part = self.type()
            if part is None:
                self.i = start
                return ()
            out.append(part)
            if self.take(">"):
                return tuple(out)
            if not self.take(","):
                self.i = start
                return ()

    # files

    def read(self) -> SourceFile:
        self.scope("", None, len(self.t))
        return self.file

    def scope(self, namespace: str, outer: TypeDecl | None, end: int) -> None:
        while self.i < min(end, len(self.t)):
            before = self.i
            if self.take("}"):
                return
            if self.at() == "[":
                self.skip_balanced()
            elif self.at() == "global" and self.at(1) == "using" or self.at() == "using":
                self.using()
            elif self.at() == "namespace":
                self.i += 1
                name = self.dotted()
                full = f"{namespace}.{name}" if namespace else name
                if self.take(";"):
                    namespace = full
                elif self.take("{"):
                    self.scope(full, None, end)
            else:
                modifiers = self.modifiers()
                if not self.declared_type(namespace, outer, modifiers):
                    self.skip_to(";", "{", "=>")
                    if self.at() == "{":
                        self.skip_balanced()
                    elif self.i < len(self.t):
                        self.i += 1
            if self.i == before:
                self.i += 1

    def dotted(self) -> str:
        parts = []
        while self.kind() == "id":
            parts.append(self.at())
            self.i += 1
            if not self.take("."):
                break
        return ".".join(parts)

    def using(self) -> None:
        self.take("global")
        self.take("using")
        static = self.take("static")
        self.take("unsafe")
        if self.kind() == "id" and self.at(1) == "=":
            name = self.at()
            self.i += 2
            ref = self.type()
            if ref is not None:
                self.file.aliases[name] = ref
        elif self.at() != "(" and not static:
            name = self.dotted()
            if name:
                self.file.usings.append(name)
        self.skip_to(";")
        self.take(";")

    def modifiers(self) -> list[str]:
        out = []
        while self.at() in MODIFIER_WORDS and self.kind() in ("word", "id"):
            if self.kind() == "id" and self.kind(1) not in ("id", "word") and self.at(1) not in ("(",):
                break
            out.append(self.at())
            self.i += 1
        return out

    def type_parameters(self) -> tuple[str, ...]:
        return tuple(p.parts[0][0] for p in self.arguments() if p.kind == "name")

    def declared_type(self, namespace: str, outer: TypeDecl | None, modifiers: list[str]) -> bool:
        word = self.at()
        if word not in TYPE_WORDS or word == "record" and not (self.kind(1) == "id" or self.at(1) in ("class", "struct")):
            return False
        self.i += 1
        if word in ("enum", "delegate"):
            self.skip_to(";", "{")
            if self.at() == "{":
                self.skip_balanced()
            self.take(";")
            return True
        if word == "record":
            self.take("class") or self.take("struct")
        kind = {"interface": "Interface", "struct": "Struct"}.get(word, "Class")
        decl = TypeDecl(kind, self.at(), (), namespace, outer, modifiers, [], self.line())
        self.i += 1
        decl.type_parameters = self.type_parameters()
        if self.at() == "(":
            self.skip_balanced()
        if self.take(":"):
            while True:
                base = self.type()
                if base is None:
                    break
                decl.bases.append(base)
                if self.at() == "(":
                    self.skip_balanced()
                if not self.take(","):
                    break
        self.skip_to("{", ";")
        self.file.types.append(decl)
        if self.take("{"):
            self.body(decl)
        self.take(";")
        return True

    def body(self, decl: TypeDecl) -> None:
        while self.i < len(self.t):
            before = self.i
            if self.take("}"):
                return
            self.member(decl)
            if self.i == before:
                self.i += 1

    def member(self, decl: TypeDecl) -> None:
        while self.at() == "[":
            self.skip_balanced()
        begin = self.line()
        modifiers = self.modifiers()
        if self.take(";"):
            return
        if self.declared_type(decl.namespace, decl, modifiers):
            return
        if self.at() in ("event", "implicit", "explicit", "~"):
            return self.rest()
        if self.kind() == "id" and self.at() == decl.name and self.at(1) == "(":
            self.i += 1
            parameters = self.parameters()
            bodies = []
            if self.take(":"):
                self.i += 1
                if self.at() == "(":
                    bodies.append(self.skip_balanced())
            member = Member("Constructor", "Ctor", modifiers, None, parameters, (begin, begin), bodies)
            self.code(member)
            member.lines = (begin, self.line(-1))
            decl.members.append(member)
            return None
        kind = self.type()
        if kind is None or self.at() in ("operator", "this"):
            return self.rest()
        explicit, name = self.named()
        if not name or self.at() in ("operator", "this", "["):
            return self.rest()
        # `name<T>(` is a generic method
        generics = self.type_parameters() if self.at() == "<" else ()
        if self.at() == "(":
            member = Member("Method", name, modifiers, kind, self.parameters(), (begin, begin), [], explicit=explicit, type_parameters=generics)
            while self.at() == "where":
                self.skip_to("{", "=>", ";", "where")
                if self.at() == "where":
                    continue
            self.code(member)
        elif self.at() in ("{", "=>"):
            member = Member("Property", name, modifiers, kind, [], (begin, begin), [], explicit=explicit)
            if self.take("=>"):
                member.bodies.append(self.skip_to(";"))
                self.take(";")
            else:
                self.accessors(member)
        else:
            return self.fields(decl, modifiers, kind, name)
        member.lines = (begin, self.line(-1))
        decl.members.append(member)
        return None

    def named(self) -> tuple[TypeRef | None, str]:
        """A member's name, and the interface before it."""
        parts: list[tuple[str, tuple]] = []
        while self.kind() == "id":
            name = self.at()
            self.i += 1
            mark = self.i
            arguments = self.arguments()
            if self.at() != ".":
                self.i = mark
                return (TypeRef("name", tuple(parts)) if parts else None), name
            parts.append((name, arguments))
            self.i += 1
        return None, ""

    def fields(self, decl: TypeDecl, modifiers: list[str], kind: TypeRef, name: str) -> None:
        while True:
            line = self.line(-1)
            if self.take("="):
                self.skip_to(",", ";")
            decl.members.append(Member("Field", name, modifiers, kind, [], (line, self.line(-1)), []))
            if self.take(",") and self.kind() == "id":
                name = self.at()
                self.i += 1
                continue
            self.take(";")
            return

    def accessors(self, member: Member) -> None:
        begin, end = self.skip_balanced()
        after, self.i, bodies = self.i, begin, 0
        while self.i < end:
            while self.at() == "[":
                self.skip_balanced()
            if self.at() in ("get", "set", "init"):
                self.i += 1
                if self.at() == "{":
                    member.bodies.append(self.skip_balanced())
                    bodies += 1
                elif self.take("=>"):
                    member.bodies.append(self.skip_to(";"))
                    bodies += 1
            else:
                self.i += 1
        member.bodiless = not bodies
        self.i = after
        if self.take("="):
            self.skip_to(";")
            self.take(";")

    def code(self, member: Member) -> None:
        if self.take("=>"):
            member.bodies.append(self.skip_to(";"))
            self.take(";")
        elif self.at() == "{":
            member.bodies.append(self.skip_balanced())
        else:
            member.bodiless = True
            self.take(";")

    def parameters(self) -> list[tuple[TypeRef, str]]:
        begin, end = self.skip_balanced()
        after, self.i, out = self.i, begin, []
        while self.i < end:
            while self.at() == "[":
                self.skip_balanced()
            kind = self.type()
            if kind is not None and self.kind() == "id":
                out.append((kind, self.at()))
            self.skip_to(",")
            if not self.take(","):
                break
        self.i = after
        return out

    def rest(self) -> None:
        """Past a member that gives no facts."""
        self.skip_to(";", "{", "=>")
        if self.at() == "{":
            self.skip_balanced()
            if self.take("="):
                self.skip_to(";")
                self.take(";")
        else:
            self.skip_to(";")
            self.take(";")


def read(text: str) -> SourceFile:
    return Reader(text).read()
