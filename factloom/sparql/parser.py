"""Recursive-descent parser for SPARQL 1.1 queries over one graph.

Nodes of the tree are tuples whose first item names their kind.  Terms are
("var", name), ("iri", fragment), ("lit", value) and, in patterns, blank nodes
as variables whose name begins with an underscore.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..vocab import RDF, SCAN, SRC

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      |(?P<iri><[^<>\s]*>)
      |(?P<string>"""
    r'''"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<var>[?$]\w+)
      |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)
      |(?P<blank>_:\w+)
      |(?P<name>[A-Za-z][\w-]*)?:(?P<local>[\w][\w.-]*\w|\w)?
      |(?P<word>[A-Za-z_]\w*)
      |(?P<op>\|\||&&|!=|<=|>=|\^\^|[{}()\[\].,;=<>!+\-*/|^?@])""",
    re.X | re.S,
)

#: Names of functions and aggregates.
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = {
    "STR", "BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS", "STRLEN", "SUBSTR", "UCASE", "LCASE", "CONCAT", "REPLACE", "COALESCE", "IF",
    "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ABS", "CEIL", "FLOOR", "ROUND", "STRBEFORE", "STRAFTER", "SAMETERM",
}


class SparqlError(ValueError):
    """The text is not a query of the supported language."""


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    where: tuple = ("group", [])
    distinct: bool = False
    items: list | None = None  # of select: (name, expression or None); None: all
    template: list = field(default_factory=list)
    targets: list = field(default_factory=list)
    group_by: list = field(default_factory=list)  # (name or None, expression)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0


#: Namespaces whose terms are the names of a fact table; all other IRIs stay whole.
NAMESPACES = (SRC, SCAN, RDF)


def fragment(iri: str, namespaces: tuple[str, ...] = NAMESPACES) -> str:
    """The node name of an IRI: its local name in one of the namespaces, else all of it."""
    return next((iri[len(n) :] for n in namespaces if iri.startswith(n) and len(iri) > len(n)), iri)


def _unquote(text: str) -> str:
    body = text[3:-3] if text.startswith('"""') else text[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)


class Parser:
    def __init__(self, text: str, namespaces: tuple[str, ...] = NAMESPACES):
        self.namespaces = namespaces
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            kind = m.lastgroup
            if kind in ("name", "local") or m[0].endswith(":") and kind not in ("space", "string", "iri"):
                self.tokens.append(("pname", m[0]))
            elif kind != "space":
                self.tokens.append((kind, m[0]))
            at = m.end()
        self.at, self.blanks, self.prefixes = 0, 0, {}

    # tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def word(self) -> str:
        kind, text = self.peek()
        return text.upper() if kind == "word" else ""

    def take(self, text: str) -> bool:
        kind, now = self.peek()
        if now == text or kind == "word" and now.upper() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SparqlError(f"expected {text}, found {self.peek()[1] or 'the end'!r}")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def fresh(self) -> tuple:
        self.blanks += 1
        return ("var", f"_b{self.blanks}")

    # queries

    def query(self) -> Query:
        while self.word() in ("PREFIX", "BASE"):
            if self.next()[1].upper() == "PREFIX":
                name = self.next()[1]
                self.prefixes[name] = self.next()[1][1:-1]
            else:
                self.next()
        form = self.word()
        if form == "SELECT":
            q = self.select()
        elif form == "ASK":
            self.next()
            self.take("WHERE")
            q = Query("ask", self.group())
        elif form == "CONSTRUCT":
            q = self.construct()
        elif form == "DESCRIBE":
            self.next()
            targets = []
            while self.peek()[0] in ("var", "iri", "pname") or self.peek()[1] == "*":
                targets.append(("all",) if self.take("*") else self.term())
            q = Query("describe", targets=targets)
            if self.word() == "WHERE" or self.peek()[1] == "{":
                self.take("WHERE")
                q.where = self.group()
        else:
            raise SparqlError(f"not a query: {self.peek()[1]!r}")
        self.modifiers(q)
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def construct(self) -> Query:
        self.next()
        if self.take("WHERE"):
            where = self.group()
            return Query("construct", where, template=[e for e in where[1] if e[0] == "triple"])
        self.need("{")
        template: list = []
        while not self.take("}"):
            self.triples(template)
            self.take(".")
        self.take("WHERE")
        return Query("construct", self.group(), template=template)

    def select(self) -> Query:
        self.need("SELECT")
        q = Query("select", distinct=self.word() == "DISTINCT")
        if self.word() in ("DISTINCT", "REDUCED"):
            self.next()
        if not self.take("*"):
            q.items = []
            while True:
                if self.peek()[0] == "var":
                    q.items.append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.items.append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
            if not q.items:
                raise SparqlError("SELECT names nothing")
        self.take("WHERE")
        q.where = self.group()
        return q

    def modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(":
                if self.take("("):
                    e = self.expression()
                    name = self.next()[1][1:] if self.take("AS") else None
                    self.need(")")
                    q.group_by.append((name, e))
                else:
                    name = self.next()[1][1:]
                    q.group_by.append((name, ("var", name)))
        if self.take("HAVING"):
            while self.take("("):
                q.having.append(self.expression())
                self.need(")")
        if self.take("ORDER"):
            self.need("BY")
            while self.peek()[0] == "var" or self.word() in ("ASC", "DESC") or self.peek()[1] == "(":
                up = self.word() != "DESC"
                if self.word() in ("ASC", "DESC"):
                    self.next()
                q.order.append((self.primary(), up))
        for _ in range(2):
            if self.take("LIMIT"):
                q.limit = int(self.next()[1])
            if self.take("OFFSET"):
                q.offset = int(self.next()[1])

    # patterns

    def group(self) -> tuple:
        self.need("{")
        if self.word() == "SELECT":
            inner = self.select()
            self.modifiers(inner)
            self.need("}")
            return ("group", [("select", inner)])
        items: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            word = self.word()
            if self.take("FILTER"):
                items.append(("filter", self.constraint()))
            elif self.take("OPTIONAL"):
                items.append(("optional", self.group()))
            elif self.take("MINUS"):
                items.append(("minus", self.group()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                items.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.take("VALUES"):
                items.append(self.values())
            elif word in ("GRAPH", "SERVICE"):
                raise SparqlError(f"{word} is not supported: there is one graph")
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.take("UNION"):
                    branches.append(self.group())
                items.append(("union", branches) if len(branches) > 1 else branches[0])
            else:
                self.triples(items)
        return ("group", items)

    def constraint(self):
        if self.word() in ("EXISTS", "NOT"):
            return self.primary()
        return self.primary()

    def values(self) -> tuple:
        names = []
        many = self.take("(")
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            row = []
            if many:
                self.need("(")
            while len(row) < len(names):
                row.append(None if self.take("UNDEF") else self.term()[1])
            if many:
                self.need(")")
            rows.append(row)
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        subject = self.bracketed(out) if self.peek()[1] == "[" else self.term()
        if self.peek()[1] in (".", "}"):
            return
        self.properties(subject, out)

    def properties(self, subject: tuple, out: list) -> None:
        while True:
            path = ("var", self.next()[1][1:]) if self.peek()[0] == "var" else self.path()
            while True:
                o = self.bracketed(out) if self.peek()[1] == "[" else self.term()
                out.append(("triple", subject, path, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "}", "]"):
                return

    def bracketed(self, out: list) -> tuple:
        self.need("[")
        node = self.fresh()
        if not self.take("]"):
            self.properties(node, out)
            self.need("]")
        return node

    def term(self) -> tuple:
        kind, text = self.next()
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            return ("iri", fragment(text[1:-1], self.namespaces))
        if kind == "pname":
            prefix, local = text.split(":", 1)
            if prefix + ":" not in self.prefixes:
                raise SparqlError(f"no prefix {prefix}:")
            return ("iri", fragment(self.prefixes[prefix + ":"] + local, self.namespaces))
        if kind == "blank":
            return ("var", "_" + text[2:])
        if kind == "string":
            if self.take("@"):
                self.next()
            elif self.take("^^"):
                self.term()
            return ("lit", _unquote(text))
        if kind == "number":
            return ("lit", float(text) if re.search("[.eE]", text) else int(text))
        if kind == "word" and text == "a":
            return ("iri", "type")
        if kind == "word" and text.lower() in ("true", "false"):
            return ("lit", text.lower() == "true")
        raise SparqlError(f"not a term: {text!r}")

    # paths

    def path(self) -> tuple:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> tuple:
        parts = [self.step()]
        while self.take("/"):
            parts.append(self.step())
        return ("seq", parts) if len(parts) > 1 else parts[0]

    def step(self) -> tuple:
        if self.take("^"):
            return ("inverse", self.step())
        if self.take("!"):
            names = []
            if self.take("("):
                while not self.take(")"):
                    names.append(self.term()[1])
                    self.take("|")
            else:
                names.append(self.term()[1])
            step = ("not", names)
        elif self.take("("):
            step = self.path()
            self.need(")")
        else:
            step = ("pred", self.term()[1])
        for mark, name in (("+", "plus"), ("*", "star"), ("?", "maybe")):
            if self.take(mark):
                return (name, step)
        return step

    # expressions

    def expression(self):
        left = self.conjunction()
        while self.take("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.take("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.peek()[1] == op:
                self.next()
                return ("cmp", op, left, self.sum())
        negated = self.word() == "NOT" and self.peek(1)[1].upper() == "IN"
        if negated:
            self.next()
        if self.take("IN"):
            self.need("(")
            options = []
            while not self.take(")"):
                options.append(self.expression())
                self.take(",")
            e = ("in", left, options)
            return ("not", e) if negated else e
        return left

    def sum(self):
        left = self.product()
        while self.peek()[1] in ("+", "-"):
            left = ("math", self.next()[1], left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.peek()[1] in ("*", "/"):
            left = ("math", self.next()[1], left, self.unary())
        return left

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("math", "-", ("lit", 0), self.unary())
        return self.primary()

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        word = self.word()
        if word == "NOT":
            self.next()
            self.need("EXISTS")
            return ("not", ("exists", self.group()))
        if word == "EXISTS":
            self.next()
            return ("exists", self.group())
        if word in AGGREGATES:
            self.next()
            self.need("(")
            distinct = self.take("DISTINCT")
            inner = None if self.take("*") else self.expression()
            separator = " "
            if self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = _unquote(self.next()[1])
            self.need(")")
            return ("agg", word, distinct, inner, separator)
        if word in FUNCTIONS:
            self.next()
            self.need("(")
            args = []
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            return ("call", word, args)
        return self.term()


def parse(text: str, namespaces: tuple[str, ...] = NAMESPACES) -> Query:
    """The syntax tree of a query; SparqlError if it is none."""
    return Parser(text, namespaces).query()
