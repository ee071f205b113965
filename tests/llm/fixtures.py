"""A small corpus with every odd row, and plain Python versions of what the operators compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bucket int, copies int, uid long, "
    "block int, component long, shard int, spans string, score double, n long, id long, label int, rep long, group string"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(1, 8))) for _ in range(words))


def corpus():
    rng = random.Random(7)
    passage, base = prose(rng, 60), prose(rng, 120)
    near = base.split()
    near[40] = "changed"
    near2 = list(near)
    near2[90] = "again"
    texts = {
        0: base,
        1: base,
        2: " ".join(near),
        3: " ".join(near2),
        4: prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 25),
        5: passage + " " + prose(rng, 40),
        6: None,
        7: "",
        8: " \t\n ",
        9: "one two",
        10: "One  TWO",
        11: prose(rng, 20_000),
        12: "Größe naïve 東京 😀 'twas it's we'll 12345 !!! <|endoftext|> x",
        13: "na " * 400,
        14: prose(rng, 10) + " " + passage.upper() + " " + passage,
        15: "x" * 5000,
        16: base + " tail words here",
    }
    rows = [(i, t, "en", f"s{i % 3}" if i != 9 else None) for i, t in texts.items()]
    rows += [(5, texts[5], "en", "s2"), (None, base, "en", "s0"), (20, texts[9], None, "S"), (21, base.upper(), "en", "s1")]
    return [(i, t, l, s, len(t or ""), 1, "k", 2, 3, 4, 5, 6, 7, "s", 0.5, 8, 9, 1, 2, "g") for i, t, l, s in rows]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words((text or "").translate(_LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    out = []
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                out.append((i, j))
    return sets, out


def removed_words(rows, window):
    """Rows in order of key (null last) and hash of the text: (kept words, number removed)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, signed(xxhash.xxh64_intdigest((rows[i][1] or "").encode(), 42))))
    seen, out = set(), {}
    for i in order:
        w = words(rows[i][1])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            q = tuple(w[s : s + window])
            if q in seen:
                gone[s : s + window] = [True] * window
            seen.add(q)
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), sum(gone), len(w))
    return out


def removed_bytes(rows, length):
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[s : s + length] for b in bodies for s in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_sequence(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    return out


def signed_hash(text):
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def mixed_copies(rows, seed="mix-1"):
    """Copies of each row (name, sort key, source, size): whole ones, then the Pareto sample, then the closing row."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in rows if r[2] == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, target = sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * size[s]]
        for s in full or open_.copy():
            target[s] = 3.0 * size[s] if full else weight[s] * level
            open_.discard(s)
            left -= target[s] if full else 0
    out = {}
    for s in names:
        mine = [r for r in rows if r[2] == s]
        whole = int(target[s] // size[s]) if size[s] else 0
        rest = target[s] - whole * size[s]

        def rank(r):
            u = (int(hashlib.md5(f"{r[0]}/{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
            return (u / (1 - u) / r[3] if r[3] else float("inf"), r[1])

        taken, drawn = 0, set()
        for r in sorted(mine, key=rank):
            if taken + r[3] > rest:
                break
            taken += r[3]
            drawn.add(r[0])
        gap = rest - taken
        others = [(abs(gap - r[3]), rank(r), r[0]) for r in mine if r[0] not in drawn and r[3] and abs(gap - r[3]) < gap]
        drawn |= {min(others)[2]} if others else set()
        out |= {(r[0], s): whole + (r[0] in drawn) for r in mine}
    return out
