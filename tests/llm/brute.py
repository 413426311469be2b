"""Brute-force versions of the operators, over (id, text) or (id, vector) pairs."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, linked):
    """Smallest id reachable for each place, over links between places; null ids are passed over."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    least = {}
    for i, v in enumerate(ids):
        r = find(i)
        if v is not None and (r not in least or v < least[r]):
            least[r] = v
    return [least.get(find(i)) for i in range(len(ids))]


def near_texts(rows, percent=75, k=5):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    found = components([r[0] for r in rows], links)
    return [(r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, found)]


def near_vectors(rows, least=0.9):
    def good(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [good(v) for _, v in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links.append((i, j))
    found = components([r[0] for r in rows], links)
    n = [sum(i in p for p in links) for i in range(len(rows))]
    return [(r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, found)]


def repeated_windows(rows, window=13):
    big = float("inf")
    first, split = {}, []
    for i, text in rows:
        w = WORD.findall(text or "")
        split.append(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (big if i is None else i):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, window=200):
    count = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        for s in range(len(b) - window + 1):
            count[b[s : s + window]] = count.get(b[s : s + window], 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s] += 1
                gone[s + window] -= 1
        keep = np.cumsum(gone)[:-1] == 0
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        spans = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mix(rows, weights=(5, 2, 1), most=3):
    """{source: target} by resharing the excess until none is above."""
    size = {}
    for s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * size[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * size[s])
        rest -= sum(target[s] for s in over)
        free -= over
    return size, target


def toxicity(docs, labelled, lengths=(3, 4, 5, 6), bits=20, least_z=3.5, least_ratio=np.log(2), least_docs=4, rounds=150):
    """Scores of docs (texts) by a classifier fitted on labelled (text, label) pairs, n-gram by n-gram in plain Python."""
    odd = dict(zip(lengths, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))

    def places(text):
        chars = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {(text or '').lower()} "]
        out = set()
        for n in lengths:
            for i in range(len(chars) - n + 1):
                h = 0
                for c in chars[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
                out.add(((h ^ (h >> 29)) * odd[n]) % 2**64 >> (64 - bits))
        return out

    rows = [(places(t), y) for t, y in labelled]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    df = {}
    for held, y in rows:
        for p in held:
            df.setdefault(p, [0, 0])[y] += 1
    scale = {}
    for p, (a, b) in df.items():
        r = np.log((b + 1) / (n[1] + 2)) - np.log((a + 1) / (n[0] + 2))
        if a + b >= least_docs and abs(r) >= least_ratio and abs(r) / np.sqrt(1 / (b + 1) + 1 / (a + 1)) >= least_z:
            scale[p] = r
    kept = sorted(scale)
    x = np.array([[scale[p] if p in held else 0.0 for p in kept] for held, _ in rows]).reshape(len(rows), len(kept))
    y = np.array([float(v) for _, v in rows])
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    w, b, g1, g2 = np.zeros(len(kept)), np.log((n[1] + 1) / (n[0] + 1)), 0.0, 0.0
    for t in range(1, rounds + 1):
        e = each * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = np.append(x.T @ e + w, e.sum()) / len(y)
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        step = 0.05 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    place = dict(zip(kept, w))
    return [1 / (1 + np.exp(-(b + sum(place[p] * scale[p] for p in places(t) if p in place)))) for t in docs], len(kept)


def align(a, b):
    """Best Smith-Waterman score of two lists of words: 2 for a match, -1 for others and gaps."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, max(row)), row
    return best


def benchmark_hits(docs, items, least=0.5, whole_below=8, gram=3):
    """{(doc, item): score} over all pairs of a document and an item that share a run of `gram` words (all, in shorter items)."""
    out = {}
    for d, text in docs:
        b = WORD.findall((text or "").translate(LOW))
        for i, item in items:
            a = WORD.findall((item or "").translate(LOW))
            k = min(gram, len(a))
            runs = {tuple(b[s : s + k]) for s in range(len(b) - k + 1)}
            if a and any(tuple(a[s : s + k]) in runs for s in range(len(a) - k + 1)):
                score = align(a, b) / (2 * len(a))
                if score >= (1.0 if len(a) < whole_below else least):
                    out[d, i] = score
    return out
