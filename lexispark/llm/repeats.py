"""Windows of a fixed length that occur more than once, each found in the one reference block that can hold its match.

Shared by substring dedup (windows of words, relative Lempel-Ziv factors) and suffix-array dedup (windows of bytes,
deep-shallow sorting). The corpus is cut into blocks of documents by a hash of key and text. In every block each window
picks one of its k-grams, the one with the least hash, so equal windows pick equal k-grams at equal offsets wherever they
stand. Neighbouring windows mostly agree on their pick; a run of windows with one pick, and the text they cover, is a passage.

1. K-grams meet by hash. A k-gram with one passage in the whole corpus settles it: nothing repeats there.
2. The other passages travel, as text, to the reference block of their k-gram. All that could match a passage
   is there, whatever document it comes from, and the operator's own method (``decide``) finds its repeats on the text itself.

A passage that stands several times in a block travels once. A k-gram with more passages than ``Rule.hot`` would make its
reference block too large for a task; its windows are sorted in their own block and then meet one by one, by a 128-bit
signature, spread over all reference blocks. Nothing is left out on either way.

Blocks send packed arrays and get back one byte or one bit an entry. A block's texts travel once; later passes read the same
exchange. Blocks are ordered inside by key, so a block that is computed again after the loss of an executor packs the same
entries in the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import mix, text_bytes

BLOCK_BYTES = 4 << 20
STEP = 1 << 17
HOT = 4096
_C = np.uint64(0x9E6C63D0876A9A35)
_NULL = np.iinfo(np.int64).max
UNIQUE, SHARED, FREQUENT = range(3)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _C
    z += y
    z ^= z >> np.uint64(29)
    return z


def window_hashes(x: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all windows of each length, by doubling; position i is the window that starts there."""
    levels, size = {1: x}, 1
    while size * 2 <= max(lengths):
        half = levels[size]
        levels[size * 2] = _join(half[:-size], half[size:]) if len(half) > size else half[:0]
        size *= 2
    out = []
    for length in lengths:
        parts = [s for s in sorted(levels, reverse=True) if length & s]
        n = max(0, len(x) - length + 1)
        value, at = levels[parts[0]][:n], parts[0]
        for s in parts[1:]:
            value = _join(value, levels[s][at : at + n])
            at += s
        out.append(mix(value))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, x
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(x) - width + 1], least[width - size :][: len(x) - width + 1]) if width > size else least


@dataclass(frozen=True)
class Rule:
    """``window`` elements count as repeated when seen elsewhere, or with ``earlier`` when seen before (by key, then place)."""

    window: int
    gram: int
    earlier: bool
    hot: int = HOT


@dataclass
class Runs:
    key: np.ndarray
    content: np.ndarray
    start: np.ndarray
    stop: np.ndarray  # last window of the run, inclusive
    shift: np.ndarray  # from the first window to the k-gram


def find_runs(values: Callable[[int, int], np.ndarray], at: np.ndarray, rule: Rule) -> Runs:
    """Runs of windows with one pick, in order; ``at`` are the offsets of the documents in the stream."""
    total, w, k = int(at[-1]), rule.window, rule.gram
    parts: list[Runs] = []
    for lo in range(0, total - w + 1, STEP):
        n = min(STEP, total - w + 1 - lo)
        gram, whole = window_hashes(values(lo, lo + n + w - 1), k, w)
        bits = np.uint64((len(gram) - 1).bit_length())
        picks = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
        pick = (sliding_least(picks, w - k + 1)[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first, last = np.searchsorted(at, lo, "right"), np.searchsorted(at, lo + n + w, "left")
        valid = np.ones(n, bool)
        for end in at[first : last + 1].tolist():  # windows that would cross the end of a document
            valid[max(0, end - w + 1 - lo) : max(0, min(n, end - lo))] = False
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        cut = np.ones(len(p), bool)
        cut[1:] = (np.diff(p) > 1) | (pick[p[1:]] != pick[p[:-1]])
        head = np.flatnonzero(cut)
        start, stop = p[head], p[np.append(head[1:], len(p)) - 1]
        anchor = pick[start]
        shape = ((anchor - start) << 20 | (stop - start)).astype(np.uint64)
        content = mix(_join(whole[start], whole[stop]) ^ mix(shape + np.uint64(1)))
        parts.append(Runs(gram[anchor], content, start + lo, stop + lo, anchor - start))
    if not parts:
        none = np.zeros(0, np.int64)
        return Runs(none.view(np.uint64), none.view(np.uint64), none, none, none)
    return Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("key", "content", "start", "stop", "shift")))


@dataclass
class Entries:
    """Distinct pairs of 64-bit values of a block, in a fixed order, with how often and where first they occur."""

    one: np.ndarray
    two: np.ndarray
    first: np.ndarray  # index of the first occurrence
    many: np.ndarray
    of: np.ndarray  # entry of each occurrence


def distinct(one: np.ndarray, two: np.ndarray) -> Entries:
    order = np.lexsort((two, one))  # stable: occurrences of an entry stay in place order
    a, b = one[order], two[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(fresh)
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return Entries(a[head], b[head], order[head], np.diff(np.append(head, len(a))) > 1, of)


# packets between blocks ------------------------------------------------------------------------

PACKET = "bucket int, block int, stage int, n int, data binary"
ANSWER = "block int, stage int, bucket int, codes binary"
_PACKET_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_ANSWER_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _table(rows: list[tuple], schema: str, kinds: tuple) -> pa.Table:
    names = [field.split()[0] for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(list(c), kind) for name, c, kind in zip(names, columns, kinds)})


def _packets(stage: int, block: int, buckets: np.ndarray, columns: list[np.ndarray], texts: list[bytes] | None = None) -> tuple[list[tuple], np.ndarray]:
    """One packet for each bucket, and the order of the entries in them; entries of a packet keep their order."""
    order = np.argsort(buckets, kind="stable")
    spots = buckets[order]
    cuts = [*np.flatnonzero(np.diff(spots, prepend=-1)).tolist(), len(spots)]
    columns = [c[order] for c in columns]
    if texts is not None:
        texts = [texts[i] for i in order.tolist()]
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        data = [c[lo:hi].tobytes() for c in columns]
        out.append((int(spots[lo]), block, stage, hi - lo, b"".join(data if texts is None else data + texts[lo:hi])))
    return out, order


def _unpack(rows: list[tuple], kinds: list) -> tuple[list[np.ndarray], list[bytes]]:
    """Columns of all packets (block, n, data), and what follows them in each packet."""
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    rest = []
    for _, n, data in rows:
        at = 0
        for column, kind in zip(columns, kinds):
            column.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        rest.append(data[at:])
    return [np.concatenate(c) for c in columns], rest


def _of_stage(group: pa.Table, stage: int) -> list[tuple]:
    """(block, n, data) of a stage, blocks in ascending order."""
    columns = (group[name].to_pylist() for name in ("stage", "block", "n", "data"))
    return sorted(((b, n, d) for s, b, n, d in zip(*columns) if s == stage), key=lambda r: r[0])


def _answers(stage: int, bucket: int, blocks: list[int], sizes: list[int], codes: np.ndarray, pack: bool) -> list[tuple]:
    out, at = [], 0
    for block, n in zip(blocks, sizes):
        part = codes[at : at + n]
        out.append((block, stage, bucket, (np.packbits(part) if pack else part).tobytes()))
        at += n
    return out


@dataclass
class Passages:
    """The passages of a reference block, in order of key and place when the rule asks for earlier ones."""

    gram: np.ndarray
    count: np.ndarray  # windows of the passage
    shift: np.ndarray  # from the first window to the k-gram
    many: np.ndarray  # whether its block holds it more than once
    body: np.ndarray
    at: np.ndarray  # byte offsets, n + 1

    @property
    def windows(self) -> np.ndarray:
        out = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(self.count, out=out[1:])
        return out


_PASSAGE = [np.uint64, np.uint32, np.uint32, np.uint8, np.uint32]
_SIGNATURE = [np.uint64, np.uint64, np.uint8]
_ORDER = [np.int64, np.int64]


def decide_grams(group: pa.Table, rule: Rule) -> pa.Table:
    """Stage 1, one bucket of k-grams: whether a k-gram has one passage in the corpus, several, or too many for one task."""
    rows = _of_stage(group, 1)
    (gram, count), _ = _unpack(rows, [np.uint64, np.uint16])
    _, of = np.unique(gram, return_inverse=True)
    passages = np.bincount(of, count)[of]
    codes = np.where(passages > rule.hot, FREQUENT, np.where(passages > 1, SHARED, UNIQUE)).astype(np.uint8)
    return _table(_answers(1, group["bucket"][0].as_py(), [r[0] for r in rows], [r[1] for r in rows], codes, False), ANSWER, _ANSWER_KINDS)


def decide_passages(rows: list[tuple], bucket: int, rule: Rule, decide: Callable[[Passages, Rule], np.ndarray]) -> list[tuple]:
    """Stage 2: which windows of the passages of a reference block repeat, by the operator's method."""
    columns, rest = _unpack(rows, _PASSAGE + (_ORDER if rule.earlier else []))
    gram, count, shift, many, size = columns[:5]
    n, at = len(gram), np.zeros(len(gram) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    body = b"".join(rest)
    # rows of equal key and text are in one block and keep their order
    order = np.lexsort((columns[6], columns[5])) if rule.earlier else np.arange(n)
    if rule.earlier:
        body = b"".join([body[a:b] for a, b in zip(at[order].tolist(), at[order + 1].tolist())])
    made = np.zeros(n + 1, np.int64)
    np.cumsum(size[order], out=made[1:])
    passages = Passages(gram[order], count[order].astype(np.int64), shift[order].astype(np.int64), many[order] > 0, np.frombuffer(body, np.uint8), made)
    mask = decide(passages, rule)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    low = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=low[1:])
    codes = mask[np.repeat(passages.windows[:-1][back] - low[:-1], count) + np.arange(low[-1])]
    sizes, i = [], 0
    for _, k, _ in rows:
        sizes.append(int(low[i + k] - low[i]))
        i += k
    return _answers(2, bucket, [r[0] for r in rows], sizes, codes, True)


def decide_windows(rows: list[tuple], bucket: int, rule: Rule) -> list[tuple]:
    """Stage 3: which windows of frequent k-grams repeat, by signature."""
    columns, _ = _unpack(rows, _SIGNATURE + (_ORDER if rule.earlier else []))
    one, two, many = columns[:3]
    order = np.lexsort((columns[4], columns[3], two, one)) if rule.earlier else np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), bool)
    if rule.earlier:
        out[order] = ~new
    else:
        of = np.cumsum(new) - 1
        out[order] = np.bincount(of, 1 + (many[order] & 1))[of] > 1
    return _answers(3, bucket, [r[0] for r in rows], [r[1] for r in rows], out, True)


class Block:
    """One block of documents with its passages, as every pass sees it."""

    def __init__(self, rows: pa.Table, rule: Rule, buckets: int, stream: Callable, local: Callable | None):
        self.rows = rows.combine_chunks().sort_by([("id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.number = rows["block"][0].as_py()
        self.rule, self.buckets, self.local = rule, buckets, local
        self.stream = stream(self.rows["text"])
        self.at = self.stream.at
        self.runs = find_runs(self.stream.values, self.at, rule)
        self.order = [self.rows["id"].fill_null(_NULL).to_numpy(), self.rows["tie"].to_numpy()]
        edge = self.stream.edge
        self.low = edge(self.runs.start)
        self.high = edge(self.runs.stop + rule.window)
        self.lead = self._leaders()
        self.first = np.flatnonzero(self.lead == np.arange(len(self.lead)))
        self.many = np.bincount(self.lead, minlength=len(self.lead)) > 1
        self.grams, self.gram_of, self.passages = np.unique(self.runs.key[self.first], return_inverse=True, return_counts=True)

    def _leaders(self) -> np.ndarray:
        """For each run the first of the block with the same text, compared byte by byte."""
        runs = self.runs
        found = distinct(runs.key, runs.content)
        lead = found.first[found.of] if len(found.of) else found.of
        again = np.flatnonzero(lead != np.arange(len(lead)))
        of = lead[again]
        same = (runs.shift[again] == runs.shift[of]) & (runs.stop[again] - runs.start[again] == runs.stop[of] - runs.start[of])
        text = self.stream.text
        spans = zip(self.low[again].tolist(), self.high[again].tolist(), self.low[of].tolist(), self.high[of].tolist())
        same &= np.fromiter((text[a:b] == text[c:d] for a, b, c, d in spans), bool, len(again))
        lead[again[~same]] = again[~same]
        return lead

    def _order_of(self, place: np.ndarray) -> list[np.ndarray]:
        row = np.searchsorted(self.at, place, "right") - 1
        return [c[row] for c in self.order]

    def _buckets(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.buckets)).astype(np.int64)

    def gram_packets(self) -> tuple[list[tuple], np.ndarray]:
        return _packets(1, self.number, self._buckets(mix(self.grams)), [self.grams, np.minimum(self.passages, 65535).astype(np.uint16)])

    def codes(self, answers: pa.Table) -> np.ndarray:
        """Of each first passage: alone in the corpus, shared, or under a frequent k-gram."""
        packets, order = self.gram_packets()
        codes = np.zeros(len(order), np.uint8)
        codes[order] = _ordered(answers, 1, packets, lambda data, n: np.frombuffer(data, np.uint8))
        return codes[self.gram_of]

    def passage_packets(self, take: np.ndarray, with_text: bool = True) -> tuple[list[tuple], np.ndarray]:
        runs, text = self.runs, self.stream.text
        size = self.high[take] - self.low[take]
        columns = [runs.key[take], (runs.stop[take] - runs.start[take] + 1).astype(np.uint32), runs.shift[take].astype(np.uint32), self.many[take].astype(np.uint8), size.astype(np.uint32)]
        if self.rule.earlier:
            columns += self._order_of(runs.start[take])
        texts = [text[a:b] for a, b in zip(self.low[take].tolist(), self.high[take].tolist())] if with_text else None
        return _packets(2, self.number, self._buckets(mix(runs.key[take])), columns, texts)

    def frequent_windows(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, Entries]:
        """Windows of passages under frequent k-grams: run, place, and their distinct signatures."""
        size = self.runs.stop[take] - self.runs.start[take] + 1
        run = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(run, size) + np.repeat(self.runs.start[take], size)
        one, two = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
        w, i = self.rule.window, 0
        while i < len(place):
            lo = int(place[i])
            j = int(np.searchsorted(place, lo + STEP))
            x = self.stream.values(lo, int(place[j - 1]) + w)
            one[i:j] = window_hashes(x, w)[0][place[i:j] - lo]
            two[i:j] = window_hashes(mix(x + np.uint64(0x5851F42D4C957F2D)), w)[0][place[i:j] - lo]
            i = j
        return np.repeat(take, size), place, self.local(self, place, one, two) if self.local else distinct(one, two)

    def window_packets(self, run: np.ndarray, place: np.ndarray, e: Entries) -> tuple[list[tuple], np.ndarray]:
        copies = np.bincount(e.of, 1 + self.many[run]) > 1 if len(e.of) else e.many
        columns = [e.one, e.two, copies.astype(np.uint8)]
        if self.rule.earlier:
            columns += self._order_of(place[e.first])
        return _packets(3, self.number, self._buckets(mix(e.one ^ np.uint64(0x1234567))), columns)

    def packets(self, answers: pa.Table) -> list[tuple]:
        codes = self.codes(answers)
        frequent = self.frequent_windows(self.first[codes == FREQUENT])
        return self.passage_packets(self.first[codes == SHARED])[0] + self.window_packets(*frequent)[0]

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """For each element, whether a repeated window covers it."""
        runs, w = self.runs, self.rule.window
        codes = self.codes(answers)
        cover = np.zeros(int(self.at[-1]) + 1, np.int32)

        def mark(start: np.ndarray, stop: np.ndarray) -> None:
            np.add.at(cover, start, 1)
            np.add.at(cover, stop + w, -1)

        again = self.lead != np.arange(len(self.lead))
        whole = again if self.rule.earlier else again | self.many
        mark(runs.start[whole], runs.stop[whole])

        take = self.first[codes == SHARED]
        packets, order = self.passage_packets(take, False)
        size = runs.stop[take] - runs.start[take] + 1
        sizes, i = [], 0
        for p in packets:
            sizes.append(int(size[order[i : i + p[3]]].sum()))
            i += p[3]
        hit = _ordered(answers, 2, [(*p[:3], n) for p, n in zip(packets, sizes)], _bits)
        size, start = size[order], runs.start[take][order]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        mark(place[hit], place[hit])

        run, place, e = self.frequent_windows(self.first[codes == FREQUENT])
        packets, order = self.window_packets(run, place, e)
        hit = np.zeros(len(order), bool)
        hit[order] = _ordered(answers, 3, packets, _bits)
        hit = hit[e.of]
        if self.rule.earlier:
            later = np.ones(len(place), bool)
            later[e.first] = False
            hit |= later
        mark(place[hit], place[hit])
        return np.cumsum(cover[:-1]) > 0


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _ordered(answers: pa.Table, stage: int, packets: list[tuple], read: Callable) -> np.ndarray:
    by_bucket = {b: c for s, b, c in zip(answers["stage"].to_pylist(), answers["bucket"].to_pylist(), answers["codes"].to_pylist()) if s == stage}
    parts = [read(by_bucket[p[0]], p[3]) for p in packets]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def repeated_elements(
    docs: DataFrame,
    key: str,
    text: str,
    rule: Rule,
    stream: Callable,
    decide: Callable[[Passages, Rule], np.ndarray],
    result: Callable[[Block, np.ndarray], pa.Table],
    schema: str,
    local: Callable | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Apply ``result`` to every block and the mask of its repeated elements.

    Keys are integers; null comes last. Rows that repeat a key are ordered by a hash of their text, and go to blocks by
    key and text, so that no key, null among them, can fill a block.
    """
    blocks = max(4, -(-text_bytes(docs, text) // block_bytes))
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", F.xxhash64("text").alias("tie"), "text")
    texts = source.groupBy("block")

    def make(rows: pa.Table) -> Block:
        return Block(rows, rule, blocks, stream, local)

    def first(rows: pa.Table) -> pa.Table:
        return _table(make(rows).gram_packets()[0], PACKET, _PACKET_KINDS)

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _table(make(rows).packets(answers) if rows.num_rows else [], PACKET, _PACKET_KINDS)

    def references(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        passages, windows = _of_stage(group, 2), _of_stage(group, 3)
        out = decide_passages(passages, bucket, rule, decide) if passages else []
        return _table(out + (decide_windows(windows, bucket, rule) if windows else []), ANSWER, _ANSWER_KINDS)

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = make(rows)
        return result(block, block.repeated(answers))

    grams = texts.applyInArrow(first, PACKET).groupBy("bucket").applyInArrow(lambda g: decide_grams(g, rule), ANSWER)
    found = texts.cogroup(grams.groupBy("block")).applyInArrow(second, PACKET).groupBy("bucket").applyInArrow(references, ANSWER)
    return texts.cogroup(grams.unionByName(found).groupBy("block")).applyInArrow(last, schema)


def spans_of(mask: np.ndarray, at: np.ndarray) -> pa.Array:
    """Maximal intervals of the mask in each document, as lists of (start, end)."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[:-1] = mask
    edge[1:] |= mask
    flips = np.zeros(len(mask) + 1, bool)
    flips[1:-1] = mask[1:] != mask[:-1]
    if len(mask):
        flips[0], flips[-1] = mask[0], mask[-1]
    split = at[1:-1]
    split = split[(split > 0) & (split < len(mask))]
    both = split[mask[split] & mask[split - 1]]
    start = np.flatnonzero(flips[:-1] & mask)
    end = np.flatnonzero(flips[1:] & mask) + 1
    start, end = np.union1d(start, both), np.union1d(end, both)
    row = np.searchsorted(at, start, "right") - 1
    base = at[row]
    lists = np.searchsorted(row, np.arange(len(at)))
    pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pairs)


SPANS = "array<struct<start:bigint,end:bigint>>"
