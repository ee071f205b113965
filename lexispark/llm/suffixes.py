"""Suffix-array dedup by deep-shallow sorting (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import _BYTE, table, text_buffers
from lexispark.llm.repeats import HOT, SPANS, Block, Entries, Passages, Rule, repeated_elements, spans_of

LENGTH = 200
GRAM = 40
SHALLOW = 24
#: Half of what words take: a byte stream has several times as many windows.
BLOCK_BYTES = 2 << 20
_BATCH = 1 << 13


class Bytes:
    """The UTF-8 bytes of a block's texts as one stream."""

    def __init__(self, texts: pa.ChunkedArray):
        self.body, self.at = text_buffers(texts)
        self.text = self.body.tobytes()

    def values(self, lo: int, hi: int) -> np.ndarray:
        return _BYTE[self.body[lo:hi]]

    def edge(self, place: np.ndarray) -> np.ndarray:
        return place


def _windows(body: np.ndarray, places: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(body, hi - lo)[places + lo]


def deep_shallow_sort(body: np.ndarray, places: np.ndarray, length: int, shallow: int = SHALLOW, within: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``places`` by their first ``length`` bytes, and a group number for each, equal where
    these bytes are equal. Every place must have ``length`` bytes. Ties keep their order. With ``within`` (keys, most
    significant last) the suffixes are ordered by these first, and only those of equal keys form a group.

    Shallow: multikey quicksort over characters of eight bytes. All groups still tied are split by their next
    character at once, down to ``shallow`` bytes. Deep: a tied group becomes a blind trie. Its first suffix is the
    spine; one comparison places every other suffix at the byte where it leaves the spine, on the side and under the branching
    byte it leaves by; suffixes that leave together form the next groups, and those that never leave are equal.
    """
    n = len(places)
    group = np.zeros(n, np.int64)  # rank of the first member of a suffix's group
    tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)

    def split(tied: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Refine the groups of ``tied`` by keys (most significant last); returns those still tied."""
        order = np.lexsort((*keys, group[tied]))
        by = tied[order]
        base, sorted_keys = group[by], [k[order] for k in keys]
        head = np.ones(len(by), bool)
        head[1:] = base[1:] != base[:-1]
        fresh = head.copy()
        for k in sorted_keys:
            fresh[1:] |= k[1:] != k[:-1]
        spot = np.arange(len(by))
        within = spot - np.maximum.accumulate(np.where(head, spot, 0))
        start = np.maximum.accumulate(np.where(fresh, spot, 0))
        group[by] = base + within[start]
        size = np.bincount(np.cumsum(fresh) - 1)
        return by[np.repeat(size > 1, size)]

    if within and n > 1:
        tied = split(tied, within)
    depth = 0
    while depth < min(shallow, length) and len(tied):
        step = min(8, length - depth)
        word = np.zeros((len(tied), 8), np.uint8)
        word[:, :step] = _windows(body, places[tied], depth, depth + step)
        tied = split(tied, (word.view(">u8").ravel().astype(np.uint64),))
        depth += step
    while len(tied) and depth < length:
        tied = tied[np.lexsort((tied, group[tied]))]
        head = np.ones(len(tied), bool)
        head[1:] = group[tied[1:]] != group[tied[:-1]]
        spine = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        side, leave, branch = (np.zeros(len(tied), np.int64) for _ in range(3))
        for lo in range(0, len(tied), _BATCH):
            a = _windows(body, places[tied[lo : lo + _BATCH]], depth, length)
            b = _windows(body, places[spine[lo : lo + _BATCH]], depth, length)
            differ = a != b
            where = differ.argmax(1)
            row = np.arange(len(a))
            gone = differ[row, where]
            byte, own = a[row, where].astype(np.int64), b[row, where].astype(np.int64)
            side[lo : lo + _BATCH] = np.where(gone, np.sign(byte - own), 0)
            # before the spine, early leavers come first; behind it, late leavers
            leave[lo : lo + _BATCH] = np.where(gone, np.where(byte < own, where, -where), 0)
            branch[lo : lo + _BATCH] = np.where(gone, byte, 0)
        on_spine = side == 0
        settled = tied[on_spine]
        again = split(tied, (branch, leave, side))
        tied = np.setdiff1d(again, settled, assume_unique=True)
    return np.lexsort((np.arange(n), group)), group


def _first_of_equals(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first member of every group, and the number of each member's group."""
    sorted_group = group[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = sorted_group[1:] != sorted_group[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


def sorted_repeats(passages: Passages, rule: Rule) -> np.ndarray:
    """The windows of a reference block that stand in it more than once, read from the order of its suffixes.

    Whole passages are ordered first, by the suffixes at their first and at their last window, which together hold all
    their bytes: equal ones become one with a weight. Then all suffixes of the passages that share a k-gram with a different one are
    sorted; a group of equal suffixes with a weight above one repeats.
    """
    body, length, at, count, gram, shift = passages.body, rule.window, passages.at, passages.count, passages.gram, passages.shift
    _, head = deep_shallow_sort(body, at[:-1], length, within=(shift, count, gram))
    _, tail = deep_shallow_sort(body, at[1:] - length, length, within=(head,))
    first, of = _first_of_equals(np.argsort(tail, kind="stable"), tail)
    weight = np.bincount(of, 1 + passages.many)
    mask = np.repeat(weight[of] > 1, count)

    _, kin, kinds = np.unique(gram[first], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(kinds[kin] > 1)
    take, heavy = first[open_], weight[open_]
    size = count[take]
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(at[:-1][take], size) + nth
    order, group = deep_shallow_sort(body, places, length, within=(np.repeat(shift[take], size) - nth, np.repeat(gram[take], size)))
    _, same = _first_of_equals(order, group)
    found = np.zeros(len(mask), bool)
    found[np.repeat(passages.windows[:-1][take], size) + nth] = np.bincount(same, np.repeat(heavy, size))[same] > 1
    # every copy of a passage is decided with its first
    pick = np.repeat(passages.windows[:-1][first[of]] - passages.windows[:-1], count) + np.arange(len(mask))
    return mask | found[pick]


def _local(block: Block, places: np.ndarray, one: np.ndarray, two: np.ndarray) -> Entries:
    """Distinct windows of a block by their bytes; the signatures only name them to other blocks."""
    order, group = deep_shallow_sort(block.stream.body, places, block.rule.window)
    first, of = _first_of_equals(order, group)
    return Entries(one[first], two[first], first, np.bincount(of, minlength=len(first)) > 1, of)


def _kept(block: Block, mask: np.ndarray) -> pa.Table:
    at, body = block.at, block.stream.body
    run = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=run[1:])
    removed = run[at[1:]] - run[at[:-1]]
    left = body[~mask].tobytes()
    low = at - run[at]
    kept = [left[a:b] for a, b in zip(low[:-1].tolist(), low[1:].tolist())]
    return pa.table({"id": block.rows["id"], "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed), "spans": spans_of(mask, at), "kept": pa.array(kept, pa.binary())})


def repeated_bytes_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every text without the bytes covered by a string of ``length`` bytes that also starts elsewhere in the corpus.

    Passages that share a k-gram meet as bytes in one reference block (see repeats.py), whose suffixes are sorted
    deep-shallow; equal neighbours are the repeats. Overlapping copies count, within one text as well; no match
    crosses texts. Of k-grams with more than ``hot`` passages the suffixes are sorted in their own block, and distinct ones meet by
    a 128-bit signature.

    Returns key, n_bytes, n_removed, spans (byte offsets, end exclusive, maximal) and kept (binary: the other
    bytes, which may cut a character), one row per row. Null texts are empty; repeated rows are copies of each
    other; keys are integers or null; an empty table gives no rows.
    """
    schema = f"id bigint, n_bytes bigint, n_removed bigint, spans {SPANS}, kept binary"
    rule = Rule(length, min(GRAM, length), False, hot)
    return repeated_elements(docs, key, text, rule, Bytes, sorted_repeats, _kept, schema, _local, BLOCK_BYTES).withColumnRenamed("id", key)


def op10_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
