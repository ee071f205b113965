"""Bulk requests: an action line, followed by a source line unless it deletes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from lexispark.errors import QueryParsingError

ACTIONS = ("index", "create", "delete")


@dataclass(frozen=True)
class Action:
    kind: str
    index: str
    id: str
    source: str | None = None


def parse_bulk(body: str, index: str | None = None) -> list[Action]:
    """Actions in request order. Blank lines are skipped and sources kept as written; lines have no length limit."""
    lines = [line for line in body.split("\n") if line.strip()]
    out, i = [], 0
    while i < len(lines):
        try:
            meta = json.loads(lines[i])
        except ValueError as e:
            raise QueryParsingError(f"bulk line {i + 1} isn't JSON") from e
        if not isinstance(meta, dict) or len(meta) != 1 or next(iter(meta)) not in ACTIONS:
            raise QueryParsingError(f"bulk line {i + 1} needs one of {', '.join(ACTIONS)}")
        kind, inner = next(iter(meta.items()))
        i += 1
        source = None
        if kind != "delete":
            if i == len(lines):
                raise QueryParsingError("bulk request ends without a source line")
            source = lines[i].strip("\r")
            i += 1
        name, doc_id = inner.get("_index", index), inner.get("_id")
        if not name or doc_id is None:
            raise QueryParsingError("bulk actions need an index and an _id")
        out.append(Action(kind, name, str(doc_id), source))
    return out
