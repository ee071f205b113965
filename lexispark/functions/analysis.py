"""Text analysis as column functions, each with a twin for constants on the driver.

A token array holds the token of position i at index i. Null entries are positions without a token.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.errors import QueryParsingError
from lexispark.mapping import VALUE_GAP

WHITE = "[ \t\n\r]+"


def lower_case(text: Column) -> Column:
    """Lower case letter by letter: the two letters whose lower case depends on context or grows are mapped first."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def lower_text(text: str) -> str:
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def whitespace_tokens(text: Column) -> Column:
    """Tokens between spaces, tabs and line ends; never empty. Trimming first leaves no empty token to filter out."""
    trimmed = F.btrim(text, F.lit(" \t\n\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def ngram_tokens(text: Column, low: int, high: int) -> Column:
    """All n-grams of code points for n = low, then low + 1, up to high; white space counts."""
    grams = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(grams(F.lit(n)), empty) for n in range(low, high + 1)])


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer after a case filter, for columns and for driver-side strings."""

    tokenize: Callable[[Column], Column]
    tokenize_text: Callable[[str], list[str]]
    lower: bool = True

    def tokens(self, text: Column) -> Column:
        return self.tokenize(lower_case(text) if self.lower else text)

    def analyze(self, text: str) -> list[str]:
        return self.tokenize_text(lower_text(text) if self.lower else text)


def _ngrams(low: int, high: int) -> Analyzer:
    return Analyzer(lambda c: ngram_tokens(c, low, high), lambda s: [s[i : i + n] for n in range(low, high + 1) for i in range(len(s) - n + 1)])


def _words(text: str) -> list[str]:
    return [t for t in re.split(WHITE, text) if t]


_registry: dict[str, Analyzer] = {"standard": Analyzer(whitespace_tokens, _words), "ngram": _ngrams(2, 3)}


def register(name: str, analyzer: Analyzer) -> None:
    _registry[name] = analyzer


def ngram(low: int, high: int) -> Analyzer:
    return _ngrams(low, high)


def get(name: str | None) -> Analyzer:
    if (name or "standard") not in _registry:
        raise QueryParsingError(f"unknown analyzer [{name}]")
    return _registry[name or "standard"]


def value_tokens(values: Column, analyzer: Analyzer) -> Column:
    """Token array over an array of values, with a gap of free positions between two values."""
    gap = F.array_repeat(F.lit(None).cast("string"), VALUE_GAP)
    joined = F.transform(values, lambda v, i: F.when(i == 0, analyzer.tokens(v)).otherwise(F.concat(gap, analyzer.tokens(v))))
    return F.flatten(joined)


def token_details(text: Column, analyzer: Analyzer) -> Column:
    """Array of (term, position, start, end) with byte offsets, for whitespace-like analyzers.

    Lowering can change a letter's byte length, so offsets refer to the original text.
    """
    # tokens and separators alternate; a token starts after the bytes of all pieces before it
    marked = F.regexp_replace(text, "([ \t\n\r]+)", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    sizes = F.transform(pieces, lambda p: F.octet_length(p))
    starts = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b))
    parts = F.filter(F.arrays_zip(pieces.alias("piece"), starts.alias("start")), lambda z: (z["piece"] != "") & ~z["piece"].rlike("^[ \t\n\r]+$"))
    return F.transform(parts, lambda z, i: F.struct((lower_case(z["piece"]) if analyzer.lower else z["piece"]).alias("term"), i.alias("position"), z["start"].cast("int").alias("start"), (z["start"] + F.octet_length(z["piece"])).cast("int").alias("end")))
