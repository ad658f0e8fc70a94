import pytest

from tidemark.errors import QueryError
from tidemark.plans.expression import Among, Binary, Call, Flag, Is, Num, Ref, Star, Text, Unary, conjuncts, names, parse


@pytest.mark.parametrize(
    "text,tree",
    [
        ("a + b * 2 ^ 3", Binary("+", Ref("a"), Binary("*", Ref("b"), Binary("^", Num(2), Num(3))))),
        ("NOT a = 1 AND b", Binary("AND", Unary("NOT", Binary("=", Ref("a"), Num(1))), Ref("b"))),
        ("a - b - c", Binary("-", Binary("-", Ref("a"), Ref("b")), Ref("c"))),
        ("a OR b AND c", Binary("OR", Ref("a"), Binary("AND", Ref("b"), Ref("c")))),
        ("x NOT IN (1, -2)", Among(Ref("x"), (Num(1), Num(-2)), True)),
        ("t.x IS NOT NULL", Is(Ref("t.x"), None, True)),
        ("x IS UNKNOWN", Is(Ref("x"), None, False)),
        ("COUNT(*)", Call("count", (Star(),))),
        ("s != 'it''s'", Binary("!=", Ref("s"), Text("it's"))),
        ("~a & !b", Binary("&", Unary("~", Ref("a")), Unary("NOT", Ref("b")))),
        ("true", Flag(True)),
        ("a << 2 + 1", Binary("<<", Ref("a"), Binary("+", Num(2), Num(1)))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "a +", "(a", "a b", "x IN ()", "x IS 3", "CASE END", "a NOT b", "'open", "f(a,"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_parts():
    assert len(conjuncts(parse("a = 1 AND (b = 2 AND c = 3) AND (d OR e)"))) == 4
    assert names(parse("f(a.b) + CASE WHEN c THEN d ELSE 1 END")) == {"a.b", "c", "d"}
