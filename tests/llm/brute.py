"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op6(texts, k=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                keep[i : i + k] = [False] * k
        left = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((len(w), len(w) - len(left), sha(" ".join(left))))
    return out


def shingles(text, n=5):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def op9(docs):
    """docs: (doc_id, text) -> doc_id: (n_shingles, component_id)"""
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for a in sets:
        inter = Counter(b for x in sets[a] for b in by[x] if b < a)
        for b, n in inter.items():
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def op1(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    by = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            for j in range(len(w) - n + 1):
                by[tuple(w[j : j + n])].add(i)
    lengths = {len(x) for x in by}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in by:
                    hit[i : i + n] = [True] * n
                    found |= by[x]
        out[d] = (len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def op3_exponent(totals, entropy, repeats, steps=40):
    """The largest exponent that reaches the entropy, raised as far as the limit on repetition asks: plain bisection."""
    p = [t / sum(totals) for t in totals]

    def fact(a):
        w = [x**a for x in p]
        z = sum(w)
        h = math.log(z) - sum(x * math.log(x) for x in w) / z
        r = [y / x for x, y in zip(p, w, strict=True)]
        return (h / math.log(len(p)) if len(p) > 1 else 1.0), max(r) / min(r)

    def search(holds):
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(*fact(mid)) else (low, mid)
        return low

    a = 1.0 if fact(1.0)[0] >= entropy else search(lambda h, r: h >= entropy)
    least = 0.0 if fact(0.0)[1] <= repeats else search(lambda h, r: r > repeats) + 2.0**-steps
    return min(1.0, max(a, least))


def long_hash(*values, seed=42):
    """Spark's xxhash64 of (value, bytes) pairs."""
    for v, n in values:
        seed = xxhash.xxh64(struct.pack("<q" if n == 8 else "<i", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def op3(docs, entropy=0.98, repeats=4.0, block_tokens=200_000, seed=17):
    """docs: (doc_id, source, text) -> sorted (doc_id, tokens, epoch, block, block_rank)"""
    tokens = [max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, _, t in docs]
    total = Counter()
    for (_, s, _), n in zip(docs, tokens, strict=True):
        total[s] += n
    a = op3_exponent(list(total.values()), entropy, repeats)
    every = sum(total.values())
    power = {s: (n / every) ** a for s, n in total.items()}
    least = min(power[s] / n for s, n in total.items())
    out = []
    for s, n in total.items():
        exact = round(power[s] / least / n, 9)
        n_blocks = max(1, math.ceil(n / block_tokens))
        blocks = defaultdict(list)
        for (d, o, _), k in zip(docs, tokens, strict=True):
            if o == s:
                blocks[long_hash((d, 8), (seed, 4)) % n_blocks].append((d, k))
        whole = math.floor(exact)
        spent, last = 0, set()
        for b in sorted(blocks, key=lambda b: (long_hash((b, 8), (whole, 8), (seed, 4)), b)):
            if spent < (exact - whole) * n:
                last.add(b)
            spent += sum(k for _, k in blocks[b])
        for epoch in range(whole + 1):
            used = sorted((b for b in blocks if epoch < whole or b in last), key=lambda b: (long_hash((b, 8), (epoch, 8), (seed, 4)), b))
            out += [(d, k, epoch, b, rank) for rank, b in enumerate(used, 1) for d, k in blocks[b]]
    return sorted(out)


def op7_clean(rows, most, share=0.05, least=5, left=0.5, fewest=10):
    """rows: (doc_id, text, source) -> (doc_id, cleaned text, words of lines removed, lines removed, kept)"""
    blank = re.compile(r"[\x20\x09-\x0D]+")
    normal = lambda x: blank.sub(" ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    lines = lambda t: [(x, normal(x)) for x in (t or "").split("\n")]
    texts, holds = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for _, n in lines(t):
            if n:
                holds[s, n].add(t or "")
    above = {k for k, v in holds.items() if len(v) >= least and (len(v) > share * len(texts[k[0]]) or len(v) >= max(most, math.sqrt(len(texts[k[0]]))))}
    out = []
    for d, t, s in rows:
        gone = [n for _, n in lines(t) if (s, n) in above]
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        n = sum(len(x.split(" ")) for x in gone)
        text = "\n".join(x for x, y in lines(t) if (s, y) not in above) if gone else t
        out.append((d, text, n, len(gone), not failed and len(words) - n >= max(fewest, left * len(words))))
    return out
