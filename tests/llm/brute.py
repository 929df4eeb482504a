"""Plain versions of the operators, to test against."""

import hashlib
import re
from collections import Counter

import xxhash

W = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def simhash(text):
    w = W.findall(lower(text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, distance=2):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(root(i), []).append(i)
    best = {r: min((ids[i] for i in m if ids[i] is not None), default=None) for r, m in out.items()}
    return [best[root(i)] for i in range(len(ids))]


def quality_base(text):
    w = W.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    hit = {j for i, t in enumerate(tri) if c[t] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


BW = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(text, items, window=13):
    w = BW.findall(lower(text or ""))
    hit, ids = set(), set()
    for i, t in items:
        b = BW.findall(lower(t or ""))
        n = min(window, len(b))
        if not n:
            continue
        wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                ids.add("" if i is None else str(i))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w)


def pii_base(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), runs, sha(bytes(c for c, x in zip(b, hit) if not x))))
    return out


def shingle_set(text, n=5):
    w = W.findall(lower(text or ""))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def joined(n, linked):
    """The smallest member of each member's group."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


def disclosing(texts, context=60, alpha=0.01, generalise=0.9, min_support=2):
    """{term: disclosure} of the corpus."""
    import math
    from statistics import NormalDist

    import regex

    def terms(s):
        return {w for w in regex.findall(r"[\p{L}\p{N}]+", s) if len(w) >= 3 and not re.fullmatch("[0-9]+", w)}

    def entity(kind, v):
        if kind == "email":
            return kind, v.lower()
        return (kind, ".".join(str(int(x)) for x in v.split("."))) if kind == "ip" else (kind, re.sub("[^0-9]", "", v))

    n = len(texts)
    pair, owner, term = Counter(), Counter(), Counter()
    for t in texts:
        term.update(terms(t))
        near = {}
        for kind, a, z in pii_base(t):
            near.setdefault(entity(kind, t[a:z]), set()).update(terms(t[max(0, a - context) : a]) | terms(t[z : z + context]))
        for e, ws in near.items():
            owner[e] += 1
            for w in ws:
                pair[e, w] += 1
    critical = NormalDist().inv_cdf(1 - alpha / max(1, len(pair)) / 2) ** 2
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    out = {}
    for (e, w), k in pair.items():
        a, b = owner[e], term[w]
        g = 2 * (f(k) + f(a - k) + f(b - k) + f(n - a - b + k) - f(a) - f(n - a) - f(b) - f(n - b) + f(n))
        if b and k >= min_support and g >= critical and a < n:
            share = math.log(n * k / (a * b)) / math.log(n / a)
            if share >= generalise:
                out[w] = max(share, out.get(w, 0))
    return out
