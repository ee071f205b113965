"""Query trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Query:
    def children(self) -> Iterator[Query]:
        return iter(())


@dataclass(frozen=True)
class MatchAll(Query):
    """Every live document, score 1."""


@dataclass(frozen=True)
class MatchNone(Query):
    """No document."""


@dataclass(frozen=True)
class Term(Query):
    """Documents that hold exactly this term, which isn't analyzed."""

    field: str
    term: str


@dataclass(frozen=True)
class Phrase(Query):
    """Documents that hold the terms at consecutive positions; scored by each term's count in the document."""

    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Exists(Query):
    """Documents with a value in the field, score 1."""

    field: str


@dataclass(frozen=True)
class Range(Query):
    """Documents with low <= value <= high, score 1."""

    field: str
    low: int | float
    high: int | float


@dataclass(frozen=True)
class Bool(Query):
    """Required, filtering, optional and excluding clauses. With no other clause, one optional clause must match;
    with excluding clauses only, nothing does."""

    must: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()

    def children(self) -> Iterator[Query]:
        yield from self.must + self.filter + self.should + self.must_not


def terms_of(query: Query, excluded: bool = False) -> list[tuple[str, str]]:
    """(field, term) of the tree without repeats, those under must_not only with ``excluded``."""
    out: dict[tuple[str, str], None] = {}

    def visit(q: Query) -> None:
        if isinstance(q, Term):
            out[q.field, q.term] = None
        elif isinstance(q, Phrase):
            out.update({(q.field, t): None for t in q.terms})
        elif isinstance(q, Bool):
            for child in q.must + q.filter + q.should + (q.must_not if excluded else ()):
                visit(child)

    visit(query)
    return list(out)


def walk(query: Query) -> Iterator[Query]:
    yield query
    for child in query.children():
        yield from walk(child)


def scored_terms_of(query: Query) -> list[tuple[str, str]]:
    """Terms whose score can reach a hit: those under must and should only."""
    if isinstance(query, Term):
        return [(query.field, query.term)]
    if isinstance(query, Phrase):
        return [(query.field, t) for t in dict.fromkeys(query.terms)]
    if isinstance(query, Bool):
        return list(dict.fromkeys(t for q in query.must + query.should for t in scored_terms_of(q)))
    return []
