"""Plain Python versions of the operators' definitions, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return ALNUM.findall((t or "").translate(LOWER))


def substring_dedup(rows, window=20):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = space_words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if tuple(w[i:i + window]) in seen:
                gone.update(range(i, i + window))
            seen[tuple(w[i:i + window])] = d
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix_dedup(rows, length=400):
    count = Counter(b[i:i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone.update(range(i, i + length))
        out[d] = (len(b), len(gone), sum(i - 1 not in gone for i in gone),
                  sha(bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


def probability_jaccard(x, y):
    """Of two Counters."""
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def near_classes(rows, k=5, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = space_words(t)
        sets[d] = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or Counter([tuple(w)] if w else [])
    text, parent = dict(rows), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def alike(x, y):
        both, once = len(x.keys() & y.keys()), max([*x.values(), *y.values()], default=1) == 1
        if once or not both:
            return both and both >= threshold * (len(x) + len(y) - both)
        return probability_jaccard(x, y) >= threshold - 1e-9
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (text[a] or "") == (text[b] or "") or alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def decontamination(rows, bench, window=10):
    phrases = defaultdict(set)
    for item, t in bench:
        w = alnum_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[i:i + n])].update([] if item is None else [str(item)])
    out = {}
    for d, t in rows:
        w = alnum_words(t)
        hit, items = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in phrases:
                    hit.update(range(i, i + n))
                    items |= phrases[tuple(w[i:i + n])]
        out[d] = (len(w), len(hit), len(items), sha(",".join(sorted(items))))
    return out


def quality(t):
    t = t or ""
    w = space_words(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if space_words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(t):
    t = t or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(t):
    w = alnum_words(t)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({x for _, x in hits})))


def mixing_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(ceiling * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if level * weight[s] > ceiling * sizes[s]}
        if not over:
            return {s: ceiling * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def sainte_lague(votes, seats):
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda p: (votes[p] / (2 * quota[p] + 1), [-ord(c) for c in p]))
        quota[best] += 1
    return quota
