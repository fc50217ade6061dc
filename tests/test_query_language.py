import pytest

from lexisweave.plans.query import And, Empty, Not, Or, Phrase, Term, lex, matches_nothing, parse, plan, simplify


def ast(q):
    return parse(lex(q))


A, B, C = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("a && b", And((A, B))), ("a b", And((A, B))), ("a || b && c", Or((A, And((B, C))))), ("(a || b) c", And((Or((A, B)), C))), ("!a", Not(A)), ("!!a", A), ("! ! !a", Not(A)),
        ("a&&!b", And((A, Not(B)))), ("a!b", And((A, Not(B)))), ("a && ---", A), ("--- && a", Empty()), ("a &&", Empty()), ("&& a", Empty()), ("a && b &&", Empty()), ("a && && b", Empty()),
        ("a ||", A), ("|| a", A), ('a && ""', Empty()), ("(a && b", And((A, B))), ("a && c ) b", And((A, C))), ("100-meter && relay", And((Term("100"), Term("relay")))), ("a & b", And((A, B))),
        ('"a b"', Phrase(("a", "b"))), ('"a b" / 2', Phrase(("a", "b"))), ('"a b"/1', Phrase(("a", "b"))), ('"a b" / 0', Empty()), ('"a b" / 3', Phrase(("a", "b"), 3)), ('"a b" / c', And((Phrase(("a", "b")), C))),
        ('"a" / 9', A), ("«a b» / 3", Phrase(("a", "b"), 3)), ('«a b" c', And((Phrase(("a", "b")), C))), ('"a b', Phrase(("a", "b"))), ('"24/7 sports"', Phrase(("24", "7", "sports"))), ("QUOTE:x && a", And((Term("quote"), A))),
        ("a && a", A), ("a && !a", Empty()), ("", Empty()), ("()", Empty()),
    ],
)
def test_parse(q, want):
    assert ast(q) == want


def test_lexer_keeps_what_is_inside_words():
    assert [t.text for t in lex('foo"bar baz" a&b|c')] == ['foo"bar', 'baz"', "a&b|c"]
    assert [(t.kind, t.text) for t in lex("foo!bar")] == [("word", "foo"), ("op", "!"), ("word", "bar")]
    assert [(t.kind, t.text) for t in lex("a&&b||c")] == [("word", "a"), ("op", "&&"), ("word", "b"), ("op", "||"), ("word", "c")]
    assert lex('"a b" /  12 c')[0].distance == 12


@pytest.mark.parametrize(
    ("q", "mode", "scored"),
    [
        ("football world", "free", ("football", "world")), ("(football rugby)", "free", ("football", "rugby")), ("football / 5", "free", ("football", "5")), ("100-meter the the", "free", ("100", "meter", "the", "the")),
        ('"world cup" football', "quotes", ()), ("a/b && c", "boolean", ("a", "c")), ("x || !y", "boolean", ("x", "y")), ('"a b" / 7 && c', "boolean", ("a", "b", "c")), ("a && c ) b", "boolean", ("a", "c", "b")), ("", "free", ()),
    ],
)
def test_modes(q, mode, scored):
    p = plan(q)
    assert (p.mode, p.scored) == (mode, scored)


def test_universe_is_only_needed_where_a_strange_document_matches():
    assert [matches_nothing(ast(q)) for q in ("a", "!a", "a && !b", "a || !b", "!(a && b)", "!a && !b", '"a b"', "!!a")] == [False, True, False, True, True, True, False, False]
    assert simplify(Not(Not(Not(A)))) == Not(A)
