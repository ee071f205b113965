"""Substring dedup by relative Lempel-Ziv parsing (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, table, text_buffers, word_bounds, word_hashes
from lexispark.llm.repeats import HOT, SPANS, Block, Passages, Rule, repeated_elements, spans_of, window_hashes

WINDOW = 20
GRAM = 5


class Words:
    """The words of a block's texts as one stream; its text holds every word with one blank behind it."""

    def __init__(self, texts: pa.ChunkedArray):
        body, offsets = text_buffers(texts)
        starts, ends, self.at = word_bounds(body, offsets)
        self.hashes = word_hashes(body, starts, ends)
        self.starts = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=self.starts[1:])
        line = np.full(int(self.starts[-1]), 0x20, np.uint8)
        ink = np.zeros(len(body) + 1, np.int8)
        ink[starts] = 1
        ink[ends] -= 1  # a word may begin where the last one of the row before ends
        inside = np.cumsum(ink[:-1]) > 0
        word = np.repeat(np.arange(len(starts)), ends - starts)
        line[np.arange(len(word)) + word] = body[inside]
        self.text = line.tobytes()

    def values(self, lo: int, hi: int) -> np.ndarray:
        return self.hashes[lo:hi]

    def edge(self, place: np.ndarray) -> np.ndarray:
        return self.starts[place]


def factor(passages: Passages, rule: Rule) -> np.ndarray:
    """Greedy factors of all passages of a reference block against its dictionary; returns the windows inside of factors.

    Passages come in order of key and place. The dictionary maps every window that no factor covers to where it
    stands first. Where the window at hand is known, the factor that starts with it grows word by word as long as the
    reference goes on alike. At its end the next window, which straddles the boundary, is looked up in turn, so it may go on in
    another reference or be new. Words are compared as text; hashes only find the place.
    """
    w = rule.window
    starts, ends, first = word_bounds(passages.body, passages.at)
    hashes = word_hashes(passages.body, starts, ends)
    spot = [*starts.tolist(), len(passages.body)]  # words i to j are the bytes spot[i] to spot[j]
    close = np.repeat(first[1:], np.diff(first)).tolist()
    window, text = window_hashes(hashes, w)[0].tolist(), passages.body.tobytes()
    low = passages.windows.tolist()
    mask = bytearray(low[-1])
    index: dict[int, int] = {}
    for passage, (begin, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        at, base = begin, low[passage] - begin
        while at <= end - w:
            key = window[at]
            here = text[spot[at] : spot[at + w]]
            source = index.get(key)
            while source is not None and text[spot[source] : spot[source + w]] != here:
                key += 1  # another window has this hash
                source = index.get(key)
            if source is None:
                index[key] = at
                at += 1
                continue
            most = min(end - at, close[source] - source)
            length = w
            if text[spot[at] : spot[at + most]] == text[spot[source] : spot[source + most]]:
                length = most
            else:
                while text[spot[at + length] : spot[at + length + 1]] == text[spot[source + length] : spot[source + length + 1]]:
                    length += 1
            covered = length - w + 1
            mask[base + at : base + at + covered] = b"\1" * covered
            at += covered
    return np.frombuffer(mask, bool)


def _kept(block: Block, mask: np.ndarray) -> pa.Table:
    words = block.stream
    run = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=run[1:])
    removed = run[words.at[1:]] - run[words.at[:-1]]
    kept = []
    for lo, hi, gone in zip(words.at[:-1].tolist(), words.at[1:].tolist(), removed.tolist()):
        whole = words.text[words.starts[lo] : words.starts[hi]]
        if gone:
            parts, keep = whole.split(b" "), np.flatnonzero(~mask[lo:hi])
            whole = b"".join([parts[j] + b" " for j in keep.tolist()])
        kept.append(whole[:-1].decode())
    return pa.table({"id": block.rows["id"], "n_words": pa.array(np.diff(words.at)), "n_removed": pa.array(removed), "spans": spans_of(mask, words.at), "kept": pa.array(kept, pa.string())})


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Every text without the words of its long factors, those that an earlier text (or place) already holds.

    The passages of a document (see repeats.py) are factored greedily against the reference block that can hold a match of them, by
    their words: a factor grows as long as its reference goes on alike, and at its boundary the search starts again. Factors of at least
    ``window`` words are duplicate spans; every window of ``window`` words with an earlier copy lies in one.

    Returns key, n_words, n_removed, spans (of word numbers, end exclusive, the joined factors) and kept (the other
    words, joined by one space), one row per row. Words are runs of anything but ASCII white space. Earlier means
    a smaller key (integers; null last), then the place in the text; rows that repeat a key are ordered by a hash of
    their text. Null texts have no words; an empty table gives no rows. Of k-grams with more than ``hot`` passages the windows
    meet by signature.
    """
    schema = f"id bigint, n_words bigint, n_removed bigint, spans {SPANS}, kept string"
    rule = Rule(window, min(GRAM, window), True, hot)
    return repeated_elements(docs, key, text, rule, Words, factor, _kept, schema).withColumnRenamed("id", key)


def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = rf"""
with words as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
wins as (select doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) as s, w from words where len(w) >= {WINDOW}),
seqs as (select doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') as q from wins),
dups as (select doc_id, s from (select doc_id, s, row_number() over (partition by q order by doc_id, s) as r from seqs) where r > 1),
gone as (select distinct doc_id, s + unnest(range(0, {WINDOW})) as i from dups),
lists as (select doc_id, list(i) as g from gone group by doc_id),
kept as (
  select words.doc_id, len(w) as n, coalesce(len(g), 0) as r,
         case when g is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end as k
  from words left join lists using (doc_id))
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
