"""The search language: lexer, parser and rewrites. Pure Python, driver side only.

Operators are `!`, `&&` (also by adjacency) and `||` in order of binding; parentheses group; "quoted words" are phrases, optionally with
`/ n` for an ordered proximity. Nothing a user can type is an error: what is missing is the empty set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import query_words

_TOKEN = re.compile(
    r"""[ \t]+|(?P<op>[()!]|&&|\|\|)|(?:"|«)(?P<quote>.*?)(?:["»]|\Z)(?:\ */\ *(?P<dist>[0-9]*)|\ *)|(?P<word>(?:(?!&&|\|\|)[^ \t()!])+)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # "op", "word" or "quote"
    text: str
    distance: int | None = None


def lex(query: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(query):
        if m["op"]:
            out.append(Token("op", m["op"]))
        elif m["quote"] is not None:
            out.append(Token("quote", m["quote"], int(m["dist"]) if m["dist"] else None))
        elif m["word"]:
            out.append(Token("word", m["word"]))
    return out


# AST. Words are raw (not stemmed), so that the engine stems all words of a query at once.


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    distance: int | None = None  # None: consecutive


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def accept(self, op: str) -> bool:
        t = self.peek()
        if t and t.kind == "op" and t.text == op:
            self.at += 1
            return True
        return False

    def either(self):
        items = [self.both()]
        while self.accept("||"):
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self):
        items = [self.atom()]
        while True:
            t = self.peek()
            explicit = self.accept("&&")
            if not explicit and (t is None or t.kind == "op" and t.text not in ("(", "!")):
                break
            t = self.peek()
            if t and t.kind == "word" and not query_words(t.text):
                self.at += 1  # a later operand without any word is no condition
                continue
            items.append(self.atom())
        return items[0] if len(items) == 1 else And(tuple(items))

    def atom(self):
        if self.accept("!"):
            return Not(self.atom())
        if self.accept("("):
            inner = self.either()
            self.accept(")")
            return inner
        t = self.peek()
        if t is None or t.kind == "op":
            return Empty()
        self.at += 1
        found = query_words(t.text)
        if not found:
            return Empty()
        if t.kind == "word":
            return Term(found[0])
        n = len(found)
        if t.distance is None or t.distance in (n, n - 1) or n == 1:
            return Phrase(tuple(found)) if n > 1 else Term(found[0])
        return Phrase(tuple(found), t.distance) if t.distance >= n else Empty()


def parse(tokens: list[Token]):
    """AST of a query; what follows a stray closing parenthesis is left aside."""
    return simplify(_Parser(tokens).either())


def simplify(node):
    """Double negations, nested and repeated operands, and empty sets folded away."""
    if isinstance(node, Not):
        inner = simplify(node.item)
        return inner.item if isinstance(inner, Not) else Not(inner)
    if isinstance(node, And | Or):
        flat = []
        for x in map(simplify, node.items):
            flat.extend(x.items if type(x) is type(node) else [x])
        flat = list(dict.fromkeys(flat))
        if isinstance(node, And):
            if Empty() in flat or any(Not(x) in flat for x in flat):
                return Empty()
        else:
            flat = [x for x in flat if x != Empty()] or [Empty()]
        return flat[0] if len(flat) == 1 else type(node)(tuple(flat))
    return node


@dataclass(frozen=True)
class Plan:
    """mode: "boolean" (ranked set), "quotes" (set in id order) or "free" (any word, ranked); ast: None for "free"; scored: words that rank, repeats included."""

    mode: str
    ast: object
    scored: tuple[str, ...]


def plan(query: str) -> Plan:
    tokens = lex(query)
    if any(t.kind == "op" and t.text in ("&&", "||", "!") for t in tokens):
        # ranking cuts plain words at their last slash
        scored = [w for t in tokens if t.kind != "op" for w in query_words(t.text.rpartition("/")[0] if t.kind == "word" and "/" in t.text else t.text)]
        return Plan("boolean", parse(tokens), tuple(scored))
    if any(t.kind == "quote" for t in tokens):
        return Plan("quotes", parse(tokens), ())
    return Plan("free", None, tuple(w for t in tokens if t.kind == "word" for w in query_words(t.text)))


def words_of(node) -> list[str]:
    """Distinct words of an AST."""
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.words))
    if isinstance(node, Not):
        return words_of(node.item)
    if isinstance(node, And | Or):
        return list(dict.fromkeys(w for x in node.items for w in words_of(x)))
    return []


def matches_nothing(node) -> bool:
    """Whether the query holds for a document without any of its words; only then are all documents looked at."""
    if isinstance(node, Not):
        return not matches_nothing(node.item)
    if isinstance(node, And):
        return all(map(matches_nothing, node.items))
    if isinstance(node, Or):
        return any(map(matches_nothing, node.items))
    return False
