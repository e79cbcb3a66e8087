"""Keyword queries as expression trees.

A node is one of::

    ("term", field, term)             field is None for any field
    ("phrase", field, terms, slop)    in order, with at most slop other places between them in all
    ("and", nodes), ("or", nodes), ("not", node)

Query texts have words, ``"phrases"``, ``"loose phrases"~3``, ``field:word``,
``field:"phrase"``, ``field:(...)``, parentheses, ``AND``, ``OR``, ``NOT``, and ``+`` and
``-`` before a word or group.  What stands side by side must all hold; AND binds
closer than OR.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdocket.operators.keyword import query_terms

DEEPEST = 64
_PIECE = re.compile(r'\s*(?:(?P<field>\w+):(?=[^\s)]))?(?:(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|(?P<sign>[+-])(?=\S)|(?P<word>[^\s()"]+))')


class InvalidQuery(ValueError):
    """The query text or tree cannot be read."""


def words_node(field: str | None, text: str, slop: int = 0, phrase: bool = True) -> tuple:
    """The node of a word or phrase; terms of one word (a hyphenated one, a CJK run) stand side by side."""
    words = query_terms(text)
    if not words:
        raise InvalidQuery(f"no word in {text!r}")
    runs = [[t for w in words for t in w]] if phrase else words
    nodes = [("term", field, r[0]) if len(r) == 1 else ("phrase", field, tuple(r), slop if phrase else 0) for r in runs]
    return nodes[0] if len(nodes) == 1 else ("and", tuple(nodes))


def parse(text: str) -> tuple:
    """The tree of a query text."""
    pieces, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise InvalidQuery(f"cannot read {text[at : at + 20]!r}")
        pieces.append(m)
        at = m.end()
    if not pieces:
        raise InvalidQuery("an empty query")
    node, rest = _either(pieces, None, 0)
    if rest:
        raise InvalidQuery("a closing parenthesis too many")
    return node


def _either(pieces: list, field: str | None, depth: int) -> tuple[tuple, list]:
    if depth > DEEPEST:
        raise InvalidQuery(f"more than {DEEPEST} levels")
    groups: list[list] = [[]]
    joined = True  # an operator stands before
    while pieces and not pieces[0]["close"]:
        word = pieces[0]["word"]
        if word in ("AND", "OR") and not pieces[0]["field"]:
            if joined:
                raise InvalidQuery(f"{word} without a word before it")
            if word == "OR":
                groups.append([])
            joined, pieces = True, pieces[1:]
            continue
        node, pieces = _one(pieces, field, depth)
        groups[-1].append(node)
        joined = False
    if joined:
        raise InvalidQuery("an operator or group without a word")
    made = [g[0] if len(g) == 1 else ("and", tuple(g)) for g in groups]
    return (made[0] if len(made) == 1 else ("or", tuple(made))), pieces


def _one(pieces: list, field: str | None, depth: int) -> tuple[tuple, list]:
    if not pieces or pieces[0]["close"]:
        raise InvalidQuery("an operator without a word")
    p, rest = pieces[0], pieces[1:]
    if p["sign"] or p["word"] == "NOT" and not p["field"]:
        node, rest = _one(rest, field, depth)
        return (node if p["sign"] == "+" else ("not", node)), rest
    field = p["field"] or field
    if p["open"]:
        node, rest = _either(rest, field, depth + 1)
        if not rest:
            raise InvalidQuery("a parenthesis that is not closed")
        return node, rest[1:]
    if p["phrase"] is not None:
        return words_node(field, p["phrase"], int(p["slop"] or 0)), rest
    return words_node(field, p["word"]), rest


def of_clauses(query: dict) -> tuple:
    """The tree of ``{"all": [...], "any": [...], "none": [...]}`` with clauses ``{"text", "field", "phrase"}`` or texts."""
    if unknown := set(query) - {"all", "any", "none"}:
        raise InvalidQuery(f"unknown properties {sorted(unknown)}")

    def clause(c) -> tuple:
        c = {"text": c} if isinstance(c, str) else c
        if unknown := set(c) - {"text", "field", "phrase"}:
            raise InvalidQuery(f"unknown properties {sorted(unknown)}")
        return words_node(c.get("field"), c["text"], phrase=bool(c.get("phrase")))

    must = [clause(c) for c in query.get("all", [])]
    if either := [clause(c) for c in query.get("any", [])]:
        must.append(("or", tuple(either)))
    if not must:
        raise InvalidQuery("a query needs a clause of all or any")
    return ("and", tuple([*must, *[("not", clause(c)) for c in query.get("none", [])]]))


def tree_of(query) -> tuple:
    """The tree of a query text, of clauses, or a tree as it is."""
    return parse(query) if isinstance(query, str) else of_clauses(query) if isinstance(query, dict) else query


def leaves(node: tuple) -> list[tuple]:
    """The distinct terms and phrases of a tree."""
    if node[0] in ("term", "phrase"):
        return [node]
    below = node[1] if node[0] != "not" else [node[1]]
    return list(dict.fromkeys(x for n in below for x in leaves(n)))


def scoring_terms(node: tuple, positive: bool = True) -> set[tuple[str, str]]:
    """``(field or "", term)`` of the parts that are not negated."""
    kind = node[0]
    if kind == "not":
        return scoring_terms(node[1], not positive)
    if kind in ("and", "or"):
        return set().union(*[scoring_terms(n, positive) for n in node[1]])
    return {(node[1] or "", t) for t in ((node[2],) if kind == "term" else node[2])} if positive else set()


def holds(node: tuple, met) -> object:
    """The tree over what ``met`` says of its leaves: columns or Python booleans."""
    kind = node[0]
    if kind in ("term", "phrase"):
        return met(node)
    if kind == "not":
        inner = holds(node[1], met)
        return ~inner if isinstance(inner, Column) else not inner
    parts = [holds(n, met) for n in node[1]]
    if isinstance(parts[0], Column):
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)
    return all(parts) if kind == "and" else any(parts)


def term_condition(node: tuple) -> Column:
    """Whether a posting is one of a leaf's terms in its field."""
    terms = [node[2]] if node[0] == "term" else list(node[2])
    inside = F.col("term").isin(terms)
    return inside if node[1] is None else inside & (F.col("field") == node[1])
