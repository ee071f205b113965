"""Declared fields of an index, and the coercion of JSON values to them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from lexispark.errors import MapperParsingError

TYPES = ("text", "keyword", "long", "double", "boolean")
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")
#: Positions left free between two values of one field, so that no phrase spans them.
VALUE_GAP = 100
_INTEGER = re.compile(r"[+-]?[0-9]+\Z")


@dataclass(frozen=True)
class Field:
    type: str
    analyzer: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise MapperParsingError(f"unsupported field type [{self.type}]")

    @property
    def has_terms(self) -> bool:
        return self.type in ("text", "keyword", "boolean")

    @property
    def has_value(self) -> bool:
        """Whether the field has one value per document for sorting and aggregating."""
        return self.type != "text"


@dataclass(frozen=True)
class Mapping:
    fields: dict[str, Field] = field(default_factory=dict)

    @classmethod
    def of(cls, properties: dict[str, Any] | None) -> Mapping:
        """From ``{"title": "text", "price": {"type": "long"}}``."""
        out = {}
        for name, spec in (properties or {}).items():
            spec = {"type": spec} if isinstance(spec, str) else spec
            out[name] = Field(spec["type"], spec.get("analyzer"))
        return cls(out)

    def to_dict(self) -> dict[str, Any]:
        return {n: {"type": f.type} | ({"analyzer": f.analyzer} if f.analyzer else {}) for n, f in self.fields.items()}


class Literal(str):
    """A JSON number as it was written."""


def _scalar(name: str, kind: str, value: Any) -> Any:
    def wrong() -> MapperParsingError:
        return MapperParsingError(f"failed to parse field [{name}] of type [{kind}]")

    number = isinstance(value, Literal)
    if isinstance(value, bool):
        if kind in ("long", "double"):
            raise wrong()
        return "true" if value else "false"
    if not isinstance(value, str):
        raise wrong()
    if kind in ("text", "keyword"):
        return str(value)
    if kind == "boolean":
        if number or value not in TRUE + FALSE:
            raise wrong()
        return "true" if value in TRUE else "false"
    try:
        if kind == "double":
            return float(value)
        if _INTEGER.match(value):
            out = int(value)
        elif number:
            out = int(float(value))
        else:
            raise wrong()
    except (ValueError, OverflowError) as e:
        raise wrong() from e
    if not -(1 << 63) <= out < 1 << 63:
        raise wrong()
    return out


def parse_document(source: str, mapping: Mapping) -> dict[str, list[Any]]:
    """Values of the mapped fields of one JSON document; raises for values that their field doesn't take.

    Fields that the mapping doesn't know are ignored, mapped ones may be missing, an array gives several values.
    """
    try:
        body = json.loads(source, parse_int=Literal, parse_float=Literal)
    except ValueError as e:
        raise MapperParsingError("source isn't JSON") from e
    if not isinstance(body, dict):
        raise MapperParsingError("source isn't a JSON object")
    out = {}
    for name, spec in mapping.fields.items():
        if name in body:
            values = body[name] if isinstance(body[name], list) else [body[name]]
            out[name] = [_scalar(name, spec.type, v) for v in values]
    return out
