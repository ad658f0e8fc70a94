"""The expression language: text to a tree of small immutable nodes, and back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.errors import QueryError


@dataclass(frozen=True)
class Num:
    value: int | float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Flag:
    value: bool | None  # None is NULL


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str
    x: Node


@dataclass(frozen=True)
class Binary:
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class Among:
    x: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class Is:
    x: Node
    what: bool | None
    negated: bool


@dataclass(frozen=True)
class Case:
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


Node = Num | Text | Flag | Ref | Star | Unary | Binary | Among | Is | Case | Call

#: How tightly operators bind; NOT takes an operand of comparisons and tighter ones.
BINDS = {"OR": 1, "AND": 2, "=": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "|": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9, "^": 10}
NOT_OPERAND, TIGHT, TIGHTEST = 4, 11, 12
WORDS = {"AND", "OR", "NOT", "IN", "IS", "NULL", "UNKNOWN", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "DISTINCT"}

LEX = re.compile(
    r"""\s+|--[^\n]*
    |(?P<hex>0[xX][0-9a-fA-F]+)
    |(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |'(?P<text>(?:[^'\\]|''|\\.)*)'
    |"(?P<quoted>(?:[^"\\]|\\.)*)"|`(?P<ticked>[^`]*)`
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)
    |(?P<op><<|>>|<=|>=|!=|<>|==|[-+*/%^&|~!=<>(),;.])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # num, hex, text, quoted, word, op, end
    value: str
    start: int
    end: int

    def word(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = LEX.match(source, at)
        if not m:
            raise QueryError(f"unexpected character {source[at]!r} at {at} of {source!r}")
        if m.lastgroup:
            kind = "quoted" if m.lastgroup == "ticked" else m.lastgroup
            value = m[m.lastgroup]
            if kind in ("text", "quoted"):
                value = re.sub(r"\\(.)", r"\1", value.replace("''", "'"))
            out.append(Token(kind, {"<>": "!=", "==": "="}.get(value, value) if kind == "op" else value, m.start(), m.end()))
        at = m.end()
    return [*out, Token("end", "", len(source), len(source))]


class Reader:
    """A position in a list of tokens."""

    def __init__(self, source: str, toks: list[Token] | None = None):
        self.source, self.toks, self.at = source, toks or tokens(source), 0

    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.toks[self.at - 1]

    def got(self, value: str) -> bool:
        """Takes the operator or word if it is next."""
        t = self.now
        if (t.kind == "op" and t.value == value) or (value.isalpha() and t.word() == value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.got(value):
            raise QueryError(f"expected {value} but found {self.now.value or 'the end'!r} in {self.source!r}")

    # expressions

    def expression(self, least: int = 0) -> Node:
        left = self._prefix()
        while True:
            t = self.now
            word = t.word()
            if word in ("IN", "IS", "NOT") and least <= 4:
                left = self._suffix(left)
                continue
            op = t.value if t.kind == "op" else word
            binds = BINDS.get(op, -1)
            if binds < max(least, 0) or binds < 0:
                return left
            self.take()
            left = Binary(op, left, self.expression(binds + 1))

    def _suffix(self, left: Node) -> Node:
        negated = self.got("NOT")
        if self.got("IN"):
            self.need("(")
            items = [self.expression()]
            while self.got(","):
                items.append(self.expression())
            self.need(")")
            return Among(left, tuple(items), negated)
        if negated:
            raise QueryError(f"NOT without IN in {self.source!r}")
        self.need("IS")
        negated = self.got("NOT")
        word = self.take().word()
        if word not in ("NULL", "UNKNOWN", "TRUE", "FALSE"):
            raise QueryError(f"IS needs NULL, UNKNOWN, TRUE or FALSE in {self.source!r}")
        return Is(left, {"TRUE": True, "FALSE": False}.get(word), negated)

    def _prefix(self) -> Node:
        t = self.take()
        if t.kind == "num":
            return Num(int(t.value) if t.value.isdigit() else float(t.value))
        if t.kind == "hex":
            return Text(t.value[2:].lower()) if len(t.value) > 18 else Num(int(t.value, 16))
        if t.kind == "text":
            return Text(t.value)
        if t.kind == "quoted":
            return Ref(t.value)
        if t.kind == "op":
            if t.value == "(":
                inner = self.expression()
                self.need(")")
                return inner
            if t.value == "*":
                return Star()
            if t.value == "!":
                return Unary("NOT", self.expression(TIGHTEST))
            if t.value in ("-", "~"):
                x = self.expression(TIGHT)
                return Num(-x.value) if t.value == "-" and isinstance(x, Num) else Unary(t.value, x)
            if t.value == "+":
                return self.expression(TIGHT)
        word = t.word()
        if word == "NOT":
            return Unary("NOT", self.expression(NOT_OPERAND))
        if word in ("TRUE", "FALSE", "NULL", "UNKNOWN"):
            return Flag({"TRUE": True, "FALSE": False}.get(word))
        if word == "CASE":
            return self._case()
        if t.kind == "word" and word not in WORDS:
            if self.got("("):
                distinct = self.got("DISTINCT")
                args: list[Node] = []
                if not self.got(")"):
                    args.append(self.expression())
                    while self.got(","):
                        args.append(self.expression())
                    self.need(")")
                return Call(t.value.lower(), tuple(args), distinct)
            return Ref(t.value)
        raise QueryError(f"unexpected {t.value or 'end'!r} in {self.source!r}")

    def _case(self) -> Node:
        branches = []
        while self.got("WHEN"):
            when = self.expression()
            self.need("THEN")
            branches.append((when, self.expression()))
        otherwise = self.expression() if self.got("ELSE") else None
        self.need("END")
        if not branches:
            raise QueryError(f"CASE without WHEN in {self.source!r}")
        return Case(tuple(branches), otherwise)


def parse(source: str) -> Node:
    """The tree of a whole text."""
    r = Reader(source)
    out = r.expression()
    if r.now.kind != "end":
        raise QueryError(f"unexpected {r.now.value!r} after the expression in {source!r}")
    return out


def conjuncts(node: Node) -> list[Node]:
    """The parts of a condition that all have to hold."""
    return conjuncts(node.a) + conjuncts(node.b) if isinstance(node, Binary) and node.op == "AND" else [node]


def children(node: Node) -> list[Node]:
    match node:
        case Unary(_, x):
            return [x]
        case Binary(_, a, b):
            return [a, b]
        case Among(x, items, _):
            return [x, *items]
        case Is(x, _, _):
            return [x]
        case Case(branches, otherwise):
            return [n for pair in branches for n in pair] + ([otherwise] if otherwise else [])
        case Call(_, args, _):
            return list(args)
    return []


def names(node: Node) -> set[str]:
    """All column names in a tree."""
    found = {node.name} if isinstance(node, Ref) else set()
    return found.union(*map(names, children(node)))


def substitute(node: Node, known: dict[str, Node]) -> Node:
    """The tree with named sub-expressions put in for their names."""
    put = lambda n: substitute(n, known)
    match node:
        case Ref(name):
            return known.get(name, node)
        case Unary(op, x):
            return Unary(op, put(x))
        case Binary(op, a, b):
            return Binary(op, put(a), put(b))
        case Among(x, items, negated):
            return Among(put(x), tuple(map(put, items)), negated)
        case Is(x, what, negated):
            return Is(put(x), what, negated)
        case Case(branches, otherwise):
            return Case(tuple((put(a), put(b)) for a, b in branches), otherwise and put(otherwise))
        case Call(name, args, distinct):
            return Call(name, tuple(map(put, args)), distinct)
    return node
