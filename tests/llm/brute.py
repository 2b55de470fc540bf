"""Plain versions of the training-data operators, and hand-made tables."""

import base64
import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dawn".split()

#: Columns whose names the operators use inside.
CLASHES = "kind string, id long, node string, sig string, h long, score string, salt string, component_id string, path string, term string, item string, part string, quality string, held_out string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, one long text, odd characters."""
    base = " ".join(PROSE)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base), (6, base + " again"), (7, "one two three"), (8, "One  two\nTHREE"),
        (9, "cc by, all rights reserved. cc-by! GENERAL public License; al rights reserved xcc by"), (10, "été naïve Ünï 漢字   nbsp <|endoftext|> it's x's '' don't"),
        (11, " ".join(PROSE[k % 23] + str(k // 7) for k in range(30_000))), (None, base), (None, None), (12, "▁mark  two▁▁ \U0001f600 a\x00b"),
    ]


def documents(spark, rows):
    """documents with columns of clashing names."""
    names = [c.split()[0] for c in CLASHES.split(", ")]
    full = [(i, t, "en", "src", None if t is None else len(t), *[None] * len(names)) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


def collected(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=key)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@functools.cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [0]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def licences(rows):
    out = []
    for i, t in rows:
        ws = words(t)
        at = [(k, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        out.append((i, len(ws), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return in_order(out)


def token_digests(rows):
    out, start = [], 0
    order = lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1] or "", 42) + 2**63) % 2**64, r[1] or "")
    for i, t in sorted(rows, key=order):
        x = ids("byte_bpe_50k.json", t)
        out.append((i, start, len(x), crc(x)))
        start += len(x)
    return in_order(out)


def contamination(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows[tuple(ws[k : k + 13])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        ws, hit, seen = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                w = tuple(ws[k : k + n])
                if w in windows:
                    hit |= set(range(k, k + n))
                    seen |= windows[w]
        names = sorted(x for x in seen if x is not None)
        out.append((i, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return in_order(out)


def shingles(text):
    ws = spaced(text)
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return in_order([(i, len(s), least.get(root(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))])


def archive(pages, least=0):
    largest, count = {}, Counter()
    body = lambda h: (h or "").encode()
    for i, _, h in pages:
        count[body(h)] += 1
        if i is not None:
            largest[body(h)] = max(i, largest.get(body(h), i))
    out = []
    for i, _, h in pages:
        b = body(h)
        first = largest.get(b) if count[b] > 1 and len(b) >= least else None
        refers = first if first is not None and first != i and i is not None else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return in_order(out)


def best_fit_bins(sizes, capacity):
    """Sequences of best fit by falling size."""
    import bisect

    gaps = []
    bins = 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k == len(gaps):
            bins += 1
            bisect.insort(gaps, capacity - s)
        else:
            bisect.insort(gaps, gaps.pop(k) - s)
    return bins


def bm25(rows, queries, k=10):
    tf = [Counter(words(t)) for _, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in tf) / max(1, len(rows))
    df = Counter(w for c in tf for w in c)
    out = []
    for q, t in queries:
        scored = []
        for (i, _), c in zip(rows, tf):
            total = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(set(words(t))) if w in c)
            if round(total, 6) > 0:
                scored.append((-round(total, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def quality_scores(rows, labels, block=1024, per_class=6_000):
    """Scores of the compression classifier by plain loops: rows (doc_id, text), labels (doc_id, quality)."""
    import zstandard

    level, size = 3, 65_536
    hashed = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64
    known = [(i, q) for i, q in labels if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    texts = {0: [], 1: []}
    chosen = {q: sorted((i for i, x in known if x == q), key=lambda i: (hashed(i), i))[:per_class] for q in (0, 1)}
    for q in (0, 1):
        for i in chosen[q]:
            texts[q] += sorted((t or "").encode() for k, t in rows if k == i)
    cut = {q: max(1, len(texts[q]) * 7 // 10) for q in texts}

    def tool(samples):
        try:
            d = zstandard.train_dictionary(min(size, max(4096, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError:
            d = zstandard.ZstdCompressionDict(b"\n".join(samples)[:size] or b"\n" * 8)
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d.as_bytes()), write_content_size=False, write_dict_id=False)

    good, bad = tool(texts[1][: cut[1]]), tool(texts[0][: cut[0]])

    def look(text):
        a, b, n = [], [], []
        for k in range(0, max(1, len(text)), block):
            part = text[k : k + block]
            a.append(len(good.compress(part)))
            b.append(len(bad.compress(part)))
            n.append(len(part) + 1)
        return [
            (sum(b) - sum(a)) / (sum(a) + sum(b)), min((y - x) / (x + y) for x, y in zip(a, b)), math.log(sum(a) / sum(n)), math.log(sum(b) / sum(n)),
            math.log(min(x / z for x, z in zip(a, n))), math.log(min(y / z for y, z in zip(b, n))), math.log(sum(n)),
        ]

    rest = [(look(t), q) for q in (1, 0) for t in texts[q][cut[q] :]]
    x, y = np.array([f for f, _ in rest]), np.array([float(q) for _, q in rest])
    share = sum(q for _, q in known) / len(known)
    weight = np.array([share / y.mean() if q else (1 - share) / (1 - y.mean()) for q in y])
    mean, spread = x.mean(0), x.std(0) + 1e-6

    def wide(f):
        z = [min(6.0, max(-6.0, v)) for v in (np.array(f) - mean) / spread]
        return [1.0, *z, *(z[i] * z[j] for i in range(len(z)) for j in range(i, len(z)))]

    d = np.array([wide(f) for f in x])
    w = np.zeros(d.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (weight * p * (1 - p))[:, None]) + np.eye(len(w)), d.T @ (weight * (p - y)) + w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return {i: 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(wide(look((t or "").encode())), w)))))) for i, t in rows}


def apportioned(weights, house):
    """Sainte-Laguë seat by seat: the highest quotient gets the next one, ties to the earlier party."""
    seats = [0] * len(weights)
    for _ in range(house):
        best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


def source_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target}: deal out, cap, deal the excess out again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * left / whole >= most * sizes[s]]
        if not above:
            return out | {s: weight[s] * left / whole for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in above)
        open_ -= set(above)
    return out


def lloyd(rows, k=8, rounds=10):
    """Rounds of nearest centroids and floored means in Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, g in groups.items():
            cents[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return in_order((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found)


def all_runs(ws, least=6, periods=4):
    """Runs by looking at every period and place."""
    found = {}
    for p in range(1, len(ws) // periods + 1):
        i = 0
        while i + p < len(ws):
            if ws[i] != ws[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def run_digests(rows, rewrite=True):
    out = []
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if rewrite and h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
        runs = all_runs(ws)
        dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in dropped))))
    return in_order(out)
