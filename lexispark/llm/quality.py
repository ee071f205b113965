"""Quality classifier (operator 5): a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, bounded_sample, table, text_buffers, word_bounds, word_hashes

FEATURES = (
    "log_words", "mean_word", "longest_word", "short_words", "long_words", "upper", "capitals", "bangs", "bars", "symbols",
    "digits", "stops", "lines", "wide", "repeat_1", "repeat_2", "repeat_lines",
)
SAMPLE_ROWS = 20_000
_CLASS = {
    "upper": range(65, 91), "letters": [*range(65, 91), *range(97, 123)], "bangs": b"!?", "bars": b"|", "symbols": b"#$%&*@^~<>{}[]\\=+_",
    "digits": range(48, 58), "stops": b".,;:", "lines": b"\n", "wide": range(128, 256),
}


def _lookup(codes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(codes)] = 1
    return out


_TABLES = {name: _lookup(codes) for name, codes in _CLASS.items()}


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def featurize(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of the buffer; texts without words get zeros."""
    starts, ends, first = word_bounds(body, offsets)
    n_bytes = np.maximum(1, np.diff(offsets))
    words = np.diff(first)
    per_word = 1.0 / np.maximum(1, words)
    size = ends - starts
    counts = {name: _per_row(lookup[body], offsets) for name, lookup in _TABLES.items()}
    hashes = word_hashes(body, starts, ends)
    row = np.repeat(np.arange(len(words)), words)
    same = [np.zeros(len(hashes), bool) for _ in range(2)]
    for lag in (1, 2):
        same[lag - 1][lag:] = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, row, size)
    # lines: a line break inside the white space before a word begins one, and the hash of its first word stands for it
    breaks = np.zeros(len(body) + 1, np.int64)
    np.cumsum(_TABLES["lines"][body], out=breaks[1:])
    opens = np.zeros(len(starts), bool)
    opens[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    opens[first[:-1][words > 0]] = True
    line = np.flatnonzero(opens)
    line_same = np.zeros(len(starts), bool)
    line_same[line[1:]] = (hashes[line[1:]] == hashes[line[:-1]]) & (row[line[1:]] == row[line[:-1]])
    columns = {
        "log_words": np.log1p(words),
        "mean_word": _per_row(size, first) * per_word if not len(size) else np.bincount(row, size, len(words)) * per_word,
        "longest_word": np.log1p(longest),
        "short_words": _per_row(size <= 3, first) * per_word,
        "long_words": _per_row(size > 14, first) * per_word,
        "upper": counts["upper"] / np.maximum(1, counts["letters"]),
        "capitals": _per_row(_TABLES["upper"][body[starts]], first) * per_word,
        **{name: counts[name] * per_word for name in ("bangs", "bars", "symbols", "stops", "lines")},
        "digits": counts["digits"] / n_bytes,
        "wide": counts["wide"] / n_bytes,
        "repeat_1": _per_row(same[0], first) * per_word,
        "repeat_2": _per_row(same[1], first) * per_word,
        "repeat_lines": _per_row(line_same, first) / np.maximum(1, _per_row(opens, first)),
    }
    return np.column_stack([columns[name] for name in FEATURES]).astype(np.float32)


@dataclass
class AdditiveModel:
    """score = sigmoid(base + a table entry per feature + a table entry per chosen pair of features)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for j in {j for pair in self.pairs for j in pair}}
        for (i, j), values in zip(self.pairs, self.pair_tables):
            total += values[coarse[i], coarse[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher").astype(np.float32))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A regression tree of a few leaves over the bins of one feature, returned as one value per bin."""
    out = np.empty(len(g))

    def grow(lo: int, hi: int, left: int) -> None:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if left and hi - lo > 1:
            gl, hl = gs[:-1], hs[:-1]
            gain = gl**2 / (hl + 1) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9:
                grow(lo, lo + at + 1, left - 1)
                grow(lo + at + 1, hi, left - 1)
                return
        out[lo:hi] = _leaf(gs[-1], hs[-1])

    grow(0, len(g), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 64, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting: every round adds one shallow tree to each feature's table in turn; then to the pairs' tables.

    Pairs are those whose grid of ``pair_bins`` x ``pair_bins`` cells explains most of what the single features
    leave. Rows of one label only give a constant score of 0.982 or 0.018, no rows one half.
    """
    if not len(y) or y.min() == y.max():
        return AdditiveModel(base=0.0 if not len(y) else (4.0 if y.max() > 0.5 else -4.0))
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    n = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(n)]
    binned = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n):
            g, h = gradient()
            size = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size))
            model.tables[j] += step
            total += step[binned[j]]
    model.pair_edges = [_edges(x[:, j], pair_bins) for j in range(n)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], "right") for j in range(n)]
    width = [len(e) + 1 for e in model.pair_edges]
    g, h = gradient()
    gains = []
    for i in range(n):
        for j in range(i + 1, n):
            cell = coarse[i] * width[j] + coarse[j]
            gs, hs = np.bincount(cell, g, width[i] * width[j]), np.bincount(cell, h, width[i] * width[j])
            gains.append((float((gs**2 / (hs + 1)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    cells = [coarse[i] * width[j] + coarse[j] for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradient()
            size = width[i] * width[j]
            gs, hs = (np.bincount(cells[k], v, size).reshape(width[i], width[j]) for v in (g, h))
            # depth two: the better first axis is cut once, each side once more along the other
            best = max((_pair_step(gs, hs), _pair_step(gs.T, hs.T).T), key=lambda s: float((s * gs).sum() - 0.5 * (s**2 * (hs + 1)).sum()))
            model.pair_tables[k] += rate * best
            total += rate * best.ravel()[cells[k]]
    return model


def _pair_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros_like(g)
    if len(g) < 2:
        return out
    rows_g, rows_h = np.cumsum(g.sum(1)), np.cumsum(h.sum(1))
    gain = rows_g[:-1] ** 2 / (rows_h[:-1] + 1) + (rows_g[-1] - rows_g[:-1]) ** 2 / (rows_h[-1] - rows_h[:-1] + 1)
    at = int(np.argmax(gain)) + 1
    for part in (slice(0, at), slice(at, None)):
        out[part] = _shallow_tree(g[part].sum(0), h[part].sum(0), 1)
    return out


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, with_hash: bool = False) -> DataFrame:
    """Score of every whole text, between 0 and 1; higher means that label 1 is likelier.

    The model is fitted on the driver on at most ``sample_rows`` labelled rows, those with the smallest hash of
    the key among the rows that are not held out; the bound is all that it depends on. Features
    come from the text alone, in one pass that is written once and read for both fitting and scoring. Null and
    empty texts get the features of no words; null labels are ignored; without labels every score is one half.
    Returns key, held_out and score, one row per row of ``docs``, and with ``with_hash`` also text_hash (xxhash64 of the
    text), which tells rows that repeat a key apart.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, marks = batch.columns
            for lo, hi in _slices(texts):
                x = featurize(*text_buffers(texts.slice(lo, hi - lo)))
                own = [ids.slice(lo, hi - lo), marks.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["key", "text_hash", *FEATURES])

    mark = F.xxhash64(docs[text]) if with_hash else F.lit(0).cast("long")
    features = docs.select(docs[key].alias("key"), docs[text].alias("text"), mark.alias("text_hash")).mapInArrow(run, f"key {kind}, text_hash bigint, " + ", ".join(f"{f} float" for f in FEATURES))
    features = scratch.save(features, "features")
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y"))
    known = scratch.save(known.join(features.select("key"), "key", "left_semi"), "labels")
    rows = features.join(bounded_sample(known, "key", sample_rows), "key").orderBy(F.xxhash64("key"), *FEATURES).select("y", *FEATURES).limit(sample_rows).toArrow()
    x = np.column_stack([rows[f].to_numpy() for f in FEATURES]).astype(np.float32)
    model = fit(x, (rows["y"].to_numpy() >= 0.5).astype(float))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(2 + j).to_numpy() for j in range(len(FEATURES))]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["key", "text_hash", "score"])

    scored = features.mapInArrow(apply, f"key {kind}, text_hash bigint, score double")
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", *(["text_hash"] if with_hash else []))


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes of text, one row at least."""
    size = np.fromiter((0 if v is None else v for v in pa.compute.binary_length(texts).to_pylist()), np.int64, len(texts))
    run, lo = np.cumsum(size), 0
    while lo < len(size):
        base = run[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(run, base + most, "right")))
        yield lo, hi
        lo = hi


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
