"""Byte-level BPE ids of whole texts, encoded once per distinct pre-token of a slice."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from lexispark.llm.common import word_hashes

MEMO_ENTRIES = 600_000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[range(48, 58)] = _DIGIT
# Latin letters of two bytes (U+00C0 to U+024F); everything else beyond ASCII takes the library's own path
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xCA] = True
_ODD = np.zeros(256, bool)
_ODD[range(0x1C, 0x20)] = True


def plain_rows(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose pre-tokens follow from byte classes: ASCII and two-byte Latin letters, no special token's opening."""
    bad = _ODD[body]
    wide = body >= 0x80
    lead, tail = body >= 0xC0, wide & (body < 0xC0)
    bad |= lead & ~_TWO[body]
    if len(body) > 1:
        pair_lead, pair_tail = body[:-1], body[1:]
        sign = (pair_lead == 0xC3) & ((pair_tail == 0x97) | (pair_tail == 0xB7))
        late = (pair_lead == 0xC9) & (pair_tail > 0x8F) & tail[1:]
        bad[:-1] |= sign | late | ((pair_lead == 0x3C) & (pair_tail == 0x7C))
    run = np.zeros(len(body) + 1, np.int64)
    np.cumsum(bad, out=run[1:])
    return run[offsets[1:]] == run[offsets[:-1]]


def pretoken_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the usual byte-level pattern starts a pre-token, for plain rows."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[body]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, np.uint8)
    before[1:], before[0] = kind[:-1], _OTHER
    after_blank = np.zeros(n, bool)
    after_blank[1:] = body[:-1] == 0x20
    after_blank &= ~first[:n]
    white = kind == _SPACE
    start = np.where(white, before != _SPACE, np.where(before == _SPACE, ~after_blank, kind != before))
    # the last of several white characters leaves the run when something else follows in the row
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~first[1:]
    start |= last & (before == _SPACE) & ~first[:n]
    start |= first[:n]
    # 's 't 're 've 'm 'll 'd where the apostrophe itself starts a pre-token
    quote = np.flatnonzero((body == 0x27) & start & ~first[1:])
    if len(quote):
        row_end = offsets[np.searchsorted(offsets, quote, "right")]
        one = body[np.minimum(quote + 1, n - 1)]
        two = np.where(quote + 2 < row_end, body[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for hit, size in ((short, 2), (long, 3)):
            at = quote[hit]
            start[at + 1] = False
            start[at + size - 1] = False
            stop = at + size
            inside = stop[stop < n]
            blank = body[inside] == 0x20
            start[inside[~blank | ~white[inside]]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once; equal to encoding each alone without adding special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode_new(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = body.tobytes()
        made = self.full.encode_batch_fast([raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        out = [x.ids for x in made]
        at = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=at[1:])
        return np.fromiter((i for x in out for i in x), np.uint32, int(at[-1])), at

    def encode_plain(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pretoken_starts(body, offsets)
        ends = np.append(starts[1:], len(body)) if len(starts) else starts
        hashes = word_hashes(body, starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        new_ids, new_at = self._encode_new(body, starts[where[new]], ends[where[new]])
        low, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        low[known], count[known] = self.at[spot[known]], np.diff(self.at)[spot[known]] if known.any() else 0
        low[new], count[new] = len(self.ids) + new_at[:-1], np.diff(new_at)
        pool = np.concatenate([self.ids, new_ids])
        sizes = count[back]
        run = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=run[1:])
        ids = pool[np.repeat(low[back] - run[:-1], sizes) + np.arange(run[-1])]
        self._remember(keys[new], new_ids, new_at)
        return ids, run[np.searchsorted(starts, offsets)]

    def _remember(self, keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        room = MEMO_ENTRIES - len(self.keys)
        if room <= 0 or not len(keys):
            return
        keys, at = keys[:room], at[: min(room, len(keys)) + 1]
        every = np.concatenate([self.keys, keys])
        low = np.concatenate([self.at[:-1], len(self.ids) + at[:-1]])
        count = np.concatenate([np.diff(self.at), np.diff(at)])
        pool = np.concatenate([self.ids, ids])
        order = np.argsort(every)
        low, count = low[order], count[order]
        run = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=run[1:])
        self.keys, self.at = every[order], run
        self.ids = pool[np.repeat(low - run[:-1], count) + np.arange(run[-1])]

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids back to back, and where each row's begin (n + 1 entries)."""
        plain = plain_rows(body, offsets)
        if plain.all():
            return self.encode_plain(body, offsets)
        size = np.diff(offsets)
        keep = np.repeat(plain, size)
        short = np.zeros(len(offsets), np.int64)
        np.cumsum(np.where(plain, size, 0), out=short[1:])
        ids, at = self.encode_plain(body[keep], short)
        parts, lengths = [], np.diff(at)
        for i in range(len(plain)):
            if plain[i]:
                parts.append(ids[at[i] : at[i + 1]])
            else:
                text = body[offsets[i] : offsets[i + 1]].tobytes().decode()
                parts.append(np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32))
        lengths = np.array([len(p) for p in parts], np.int64)
        run = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(lengths, out=run[1:])
        return np.concatenate(parts) if parts else ids, run


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
