"""Secret scans: a random forest over candidates, to remove false positives.

Candidates are runs of `[A-Za-z0-9_+/=.-]` of at least `SHORTEST` bytes that hold a digit, mix cases or
have few frequent trigrams, found with array operations over whole texts, and, at any length and of any
characters, whole values assigned to a name with one of `KEYWORDS`, and quoted values. Of
candidates that overlap the widest secret counts, or else the widest. A candidate is described by its length, the transitions between
its character classes, entropy, dictionary coverage (the share of its letter trigrams that are
frequent in the corpus), whether it looks like a path or a name, what assignment it stands in, and
the words beside it. The forest is trained from labelled findings; `example_findings` makes such
findings from published token formats and from the usual false alarms (card and phone numbers,
addresses, paths, hosts, identifiers, plain long words).

Trigram counts cover the whole corpus: each shard adds up a table of 26^3 counts, whatever its size.
Scanning maps over documents without a shuffle; the model and the table are a few hundred kilobytes.

Defined cases: a null or empty text has no findings and stays as it is; overlapping findings do not
occur; repeated rows and doc_ids are scanned each for itself; an empty table gives no rows; other
columns pass through redaction unchanged, but for n_chars, which is counted again where it is an integer. doc_id is a bigint.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import table

SHORTEST = 12
TREES = 40
DEPTH = 9
BESIDE = 48  #: bytes looked at on either side
CHUNK = 1 << 20  #: bytes of text that a task looks at at once (about 100 bytes of arrays for each)
MARK = "<secret>"
#: Words beside a candidate, or in front of its "=", that speak for a secret.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "passphrase")
PASSWORDS = (b"password", b"passwd", b"pwd", b"passphrase", b"secret")
RARE = 0.6  #: a run without digits is a candidate where a smaller share of its trigrams is frequent
_NAME = re.compile(rb"(?:" + "|".join(KEYWORDS).encode() + rb")[\w.-]*[\"']?\]?[ \t]*\Z", re.I)
_VALUE = re.compile(rb"[=:>]*[ \t]*(?:(?:bearer|basic)[ \t]+)?(?:\"((?:\\.|[^\"\\\n])+)\"|'((?:\\.|[^'\\\n])+)'|[\"']?([^\s\"']\S*))", re.I)
_QUOTED = re.compile(rb"(?<![\w\"'])(?:\"((?:\\.|[^\"\\\n])+)\"|'((?:\\.|[^'\\\n])+)'(?!\w))")
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=.-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_KIND = np.full(256, 4, np.int8)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A] = 0, 1, 2


def _letters(buf: np.ndarray) -> np.ndarray:
    low = buf | 0x20
    return np.where((low >= 97) & (low <= 122), low.astype(np.int32) - 97, -1)


def trigram_table(docs: DataFrame, share: float = 0.95) -> np.ndarray:
    """The dictionary: which letter trigrams make up `share` of the corpus (26^3 flags)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(26**3, np.int64)
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.split_words(part.column(0), W.SPACED)
                x = _letters(w.buf)
                ok = (x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0)
                for back in (1, 2):  # none across texts
                    ok[np.maximum(w.text_start[1:-1] - back, 0)[w.text_start[1:-1] >= back]] = False
                total += np.bincount((x[:-2] * 676 + x[1:-1] * 26 + x[2:])[ok], minlength=26**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])

    found = docs.select("text").mapInArrow(count, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # 26^3 rows at most
    total = np.zeros(26**3, np.int64)
    for r in found:
        total[r.trigram] = r.n
    order = np.argsort(-total, kind="stable")
    upto = np.searchsorted(np.cumsum(total[order]), share * total.sum())
    flags = np.zeros(26**3, bool)
    flags[order[: upto + 1]] = total[order[: upto + 1]] > 0
    return flags


def candidates(w: W.Words, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs that are candidates; w: split by white space."""
    n = w.text_start[-1]
    buf = w.buf[:n]
    inside = _RUN[buf]
    edge = np.zeros(n + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[w.text_start] = True
    cuts = np.flatnonzero(edge)
    a, b = cuts[:-1], cuts[1:]
    keep = b - a >= SHORTEST
    a, b = a[keep], b[keep]
    keep = inside[a] if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    digits = upto(_DIGIT[buf])
    x = _letters(w.buf[: n + 2])
    ok = (x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0)
    often = np.zeros(n, bool)
    often[ok] = common[(x[:-2] * 676 + x[1:-1] * 26 + x[2:])[ok]]
    kind = _KIND[buf]
    ups = np.zeros(n, bool)
    ups[1:] = (kind[1:] == 0) & (kind[:-1] == 1)
    letters, ok, often, ups = upto(kind < 2), upto(ok), upto(often), upto(ups)
    # Trigrams that end within the run; it has more than two bytes.
    tri = ok[b - 2] - ok[a]
    rare = np.where(tri > 0, often[b - 2] - often[a] < RARE * tri, letters[b] - letters[a] >= SHORTEST // 2)
    keep = (digits[b] > digits[a]) | (ups[b] > ups[np.minimum(a + 1, n)]) | rare
    return a[keep], b[keep]


def values(buf: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from byte, to byte) of assigned values behind a keyword, and of quoted values, in texts that begin at starts."""
    n, out = int(starts[-1]), []
    raw = buf[:n].tobytes()
    signs = np.flatnonzero((buf[:n] == 0x3D) | (buf[:n] == 0x3A))
    quotes = np.flatnonzero((buf[:n] == 0x22) | (buf[:n] == 0x27))
    for marks, assigned in ((signs, True), (quotes, False)):
        done = 0
        for i, p in zip((np.searchsorted(starts, marks, side="right") - 1).tolist(), marks.tolist(), strict=True):
            lo, hi = int(starts[i]), int(starts[i + 1])
            if p < done or assigned and not _NAME.search(raw[max(lo, p - BESIDE) : p]):
                continue
            # What stands before the text is not looked at.
            m = _VALUE.match(raw, p, hi) if assigned else _QUOTED.match(raw, p, hi) if p > lo else _QUOTED.match(raw[lo:hi])
            if m is None:
                continue
            base = lo if not assigned and p == lo else 0
            s, e = m.span(m.lastindex)
            if assigned and m.lastindex == 3:
                e = s + len(raw[s:e].rstrip(b",;.)]}>\"'"))
            done = base + m.end()
            if e > s:
                out.append((i, base + s, base + e))
    return out


def value_at(token: bytes, before: bytes) -> int:
    """Where the value begins in a candidate: behind its last "=", but at 0 where the candidate is the value of a keyword before it."""
    if before.rstrip(b" \t\"'").endswith((b"=", b":")) and _NAME.search(before.rstrip(b" \t\"'=:>")):
        return 0
    return token.rstrip(b"=").rfind(b"=") + 1


NAMES = ("length", "value_length", "transitions", "transition_rate", "entropy", "upper", "lower", "digits", "other", "hex", "coverage", "slashes", "dots", "dashes", "assigned", "key_before", "quoted", "keyword_beside", "at_beside", "starts_upper4", "longest_letters", "longest_digits", "password_before", "spaces")


def describe(token: bytes, before: bytes, after: bytes, common: np.ndarray) -> list[float]:
    """The features of one candidate, in the order of NAMES."""
    at = value_at(token, before)
    key, value = token[: max(0, at - 1)], token[at:]
    assigned = at > 0 or before.rstrip(b" \"'").endswith((b"=", b":"))
    v = np.frombuffer(value or token, np.uint8)
    kind = _KIND[v]
    counts = np.bincount(v)
    p = counts[counts > 0] / len(v)
    x = _letters(v)
    ok = (x[:-2] >= 0) & (x[1:-1] >= 0) & (x[2:] >= 0)
    tri = (x[:-2] * 676 + x[1:-1] * 26 + x[2:])[ok]
    changes = int((kind[1:] != kind[:-1]).sum())

    def longest(flags):
        best = run = 0
        for f in flags.tolist():
            run = run + 1 if f else 0
            best = max(best, run)
        return best

    near = (before[-24:] + b" " + after[:8]).lower()
    own = (key or before.rstrip(b" \"'=:")[-16:]).lower()
    return [
        len(token), len(v), changes, changes / len(v), float(-(p * np.log2(p)).sum()), (kind == 0).mean(), (kind == 1).mean(), (kind == 2).mean(), (kind == 4).mean(),
        float(all(c in b"0123456789abcdefABCDEF" for c in v.tolist())), float(common[tri].mean()) if len(tri) else 0.0, token.count(b"/"), token.count(b"."), token.count(b"-"),
        float(assigned), float(any(own.endswith(k.encode()) for k in KEYWORDS)), float(before[-1:] in (b'"', b"'") and bool(before)), float(any(k.encode() in near for k in KEYWORDS)), float(b"@" in before[-1:] or b"@" in after[:1]),
        float(len(v) >= 4 and bool((kind[:4] == 0).all())), longest((kind == 0) | (kind == 1)), longest(kind == 2),
        float(own.endswith(PASSWORDS)), value.count(b" "),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for leaves), limit, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Bootstrap samples, random feature subsets, best Gini split among quantile limits."""
    rng, out = np.random.default_rng(seed), []
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    for _ in range(trees):
        nodes: list[list] = []

        def build(rows: np.ndarray, level: int) -> int:
            me, share = len(nodes), y[rows].mean()
            nodes.append([-1, 0.0, 0, 0, share])
            if level >= depth or len(rows) < 4 or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                col = x[rows, f]
                for limit in np.unique(np.quantile(col, np.linspace(0.05, 0.95, 10), method="midpoint")):
                    go = col <= limit
                    n = go.sum()
                    if 0 < n < len(rows):
                        p, q = y[rows[go]].mean(), y[rows[~go]].mean()
                        gini = (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                        if gini < best[0]:
                            best = (gini, f, limit)
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[me][0], nodes[me][1] = best[1], best[2]
                nodes[me][2] = build(rows[go], level + 1)
                nodes[me][3] = build(rows[~go], level + 1)
            return me

        build(rng.integers(0, len(y), len(y)), 0)
        cols = list(zip(*nodes, strict=True))
        out.append(tuple(np.array(c, t) for c, t in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)))
    return Forest(out)


def example_findings(n: int = 240, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label): findings labelled by how they were made; n of each kind."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, alnum, caps = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: some("etaoinshrdlu", r.randint(2, 9))
    plain = lambda: " ".join(word() for _ in range(4)) + " "
    key = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth_token"])
    out = []
    for _ in range(n):
        out += [
            (plain(), "AKIA" + some(caps, 16), " " + plain(), 1),
            (plain(), f"{key()}={some(hexes, r.choice([12, 16, 18, 24, 32, 40]))}", " " + plain(), 1),
            (plain(), f"{key()}={some(alnum, r.randint(8, 32))}", " " + plain(), 1),
            (plain() + f'{key()} = "', some(hexes, r.choice([24, 32, 40, 64])), '" ' + plain(), 1),
            (plain() + f"{key()}: ", some(alnum, r.randint(16, 48)), " " + plain(), 1),
            (plain(), r.choice(["ghp_", "gho_", "glpat-", "sk_live_"]) + some(alnum, r.randint(20, 36)), " " + plain(), 1),
            (plain(), "xoxb-" + some("0123456789", 11) + "-" + some(alnum, 24), " " + plain(), 1),
            (plain() + "Bearer ", "eyJ" + some(alnum, 20) + "." + some(alnum, 40) + "." + some(alnum, 30), " " + plain(), 1),
            (plain(), some("0123456789", r.randint(12, 19)), " " + plain(), 0),
            (plain(), str(uuid.UUID(int=r.getrandbits(128))), " " + plain(), 0),
            (plain() + "commit ", some(hexes, 40), " " + plain(), 0),
            (plain() + r.choice(["sha256:", "md5 ", "checksum "]), some(hexes, r.choice([32, 40, 64])), " " + plain(), 0),
            (plain() + f"{word()}.{r.randint(1, 99)}@", f"mail{r.randint(1, 9)}.{word()}.com", " " + plain(), 0),
            (plain(), f"{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(0, 255)}", " " + plain(), 0),
            (plain() + "https:", f"//www.{word()}.com/{word()}/{r.randint(1, 9999)}", " " + plain(), 0),
            (plain(), f"/usr/{word()}/{word()}-{r.randint(1, 9)}.{r.randint(0, 20)}/{word()}.py", " " + plain(), 0),
            (plain(), f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", ":00 " + plain(), 0),
            (plain(), f"{word()}{word()}{word()}{r.randint(0, 99)}", " " + plain(), 0),
            (plain(), f"{word()}_{word()}_{word()}{r.randint(0, 9)}", " " + plain(), 0),
            (plain(), f"{word()}={word()}{r.randint(0, 999)}", " " + plain(), 0),
            (plain(), f"page={r.randint(100000, 99999999)}", " " + plain(), 0),
            (plain() + "id: ", f"{r.choice(['ORD', 'INV', 'DOC'])}-{r.randint(10**5, 10**7)}-{r.randint(10, 99)}", " " + plain(), 0),
            (plain(), f"555-{r.randint(100, 999)}-{r.randint(1000, 9999)}", " " + plain(), 0),
        ]
    return out + _short_and_plain(n, seed + 1)


def _short_and_plain(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Findings without digits, of few bytes or of any characters, and the false alarms like them."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    real = "the of and water house people letter number because little another between mother answer country required string optional none true false value default public main open door city time report".split()
    made = lambda: "".join(r.choice("bdfghlmnprst") + r.choice("aeiou") + r.choice(["", "n", "r", "s"]) for _ in range(r.randint(1, 4)))
    word = lambda: r.choice(real) if r.random() < 0.5 else made()
    plain = lambda: " ".join(word() for _ in range(4)) + " "
    password = lambda: r.choice(["password", "passwd", "pwd", "secret", "passphrase", "db_password", "Password"])
    name = lambda: r.choice(["key", "token", "auth", "api_key", "secret", "password"])
    sign = lambda: r.choice(["=", ": ", " = ", ":"])
    alnum, odd = string.ascii_letters + string.digits, "@!:#$%&*?^~"
    out = []
    for _ in range(n):
        short = r.choice([made() + str(r.randint(1, 999)) + some(string.ascii_lowercase, r.randint(0, 2)), some(alnum, r.randint(5, 10)) + r.choice(string.digits)])
        broken = some(alnum, r.randint(3, 9)) + r.choice(odd) + some(alnum + odd, r.randint(2, 12))
        out += [
            (plain() + password() + sign(), short, " " + plain(), 1),
            (plain() + name() + sign(), broken, " " + plain(), 1),
            (plain() + name() + sign() + '"', broken, '" ' + plain(), 1),
            (plain() + password() + sign() + '"', r.choice([" ", " ", "-"]).join(word() for _ in range(r.randint(3, 6))), '" ' + plain(), 1),
            (plain(), name() + "=" + some(string.ascii_letters, r.randint(12, 32)), " " + plain(), 1),
            (plain() + name() + sign(), some(string.ascii_letters, r.randint(12, 32)), " " + plain(), 1),
            (plain(), "AKIA" + some(string.ascii_uppercase, 16), " " + plain(), 1),
            (plain(), r.choice(["ghp_", "gho_", "glpat-", "sk_live_"]) + some(string.ascii_letters, r.randint(20, 36)), " " + plain(), 1),
            (plain() + name() + sign(), word(), " " + plain(), 0),
            (plain() + name() + sign(), word() + r.choice([".", "_"]) + word(), " " + plain(), 0),
            (plain() + r.choice(["key", "token", "auth"]) + sign() + '"', word(), '" ' + plain(), 0),
            (plain() + '"', " ".join(word() for _ in range(r.randint(1, 12))), '" ' + plain(), 0),
            (plain(), "".join(word().capitalize() for _ in range(r.randint(3, 5))), " " + plain(), 0),
            (plain() + "https:", f"//www.{made()}.com/{word()}/{word()}", " " + plain(), 0),
            (plain(), f"/usr/{word()}/{word()}/{made()}.py", " " + plain(), 0),
            (plain(), r.choice(["_", "-", "."]).join(word() for _ in range(r.randint(3, 5))), " " + plain(), 0),
            (plain(), made() + made() + made(), " " + plain(), 0),
            (plain(), (word() + word() + word()).upper(), " " + plain(), 0),
            (plain(), f"{word()}={word()}{word()}", " " + plain(), 0),
        ]
    return out


def train(findings: list[tuple[str, str, str, int]], common: np.ndarray) -> Forest:
    x = np.array([describe(c.encode(), b.encode()[-BESIDE:], a.encode()[:BESIDE], common) for b, c, a, _ in findings])
    return grow(x, np.array([f[3] for f in findings], float))


def _findings(part: pa.Array, forest: Forest, common: np.ndarray, threshold: float) -> tuple[np.ndarray, list]:
    """(text index, (from byte, to byte, score)) of every candidate of a shard, in order."""
    w = W.split_words(part, W.SPACED)
    a, b = candidates(w, common)
    of = np.searchsorted(w.text_start, a, side="right") - 1
    x, spans = [], []
    for i, s, e in zip(of.tolist(), a.tolist(), b.tolist(), strict=True):
        lo, hi = w.text_start[i], w.text_start[i + 1]
        token = w.buf[s:e].tobytes()
        core = (token.rstrip(b".=-") if not token.endswith(b"=") else token.rstrip(b".-")) or token
        before = w.buf[max(lo, s - BESIDE) : s].tobytes()
        x.append(describe(core, before, w.buf[e : min(hi, e + BESIDE)].tobytes(), common))
        # In an assignment only the value is secret.
        spans.append((i, s + value_at(core, before), s + len(core)))
    known = set(spans)
    for i, s, e in values(w.buf, w.text_start):
        if (i, s, e) not in known:
            known.add((i, s, e))
            lo, hi = w.text_start[i], w.text_start[i + 1]
            x.append(describe(w.buf[s:e].tobytes(), w.buf[max(lo, s - BESIDE) : s].tobytes(), w.buf[e : min(hi, e + BESIDE)].tobytes(), common))
            spans.append((i, s, e))
    if not x:
        return np.zeros(0, np.int64), []
    scores = forest.score(np.array(x)).tolist()
    apart: list[list] = []  # candidates that overlap are one group
    for (i, s, e), p in sorted(zip(spans, scores, strict=True)):
        if apart and apart[-1][0] == i and s < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], e)
            apart[-1][2].append((s, e, p))
        else:
            apart.append([i, e, [(s, e, p)]])
    found = []
    for i, _, group in apart:
        lo = int(w.text_start[i])
        secret = [g for g in group if g[2] >= threshold]
        held: list[list] = []
        for s, e, p in secret or [max(group, key=lambda g: g[1] - g[0])]:
            if held and s < held[-1][1]:
                held[-1][1:] = max(held[-1][1], e), max(held[-1][2], p)
            else:
                held.append([s, e, p])
        found += [(i, (s - lo, e - lo, p)) for s, e, p in held]
    return np.array([i for i, _ in found], np.int64), [f for _, f in found]


def _model(docs: DataFrame, findings):
    common = trigram_table(docs)
    return docs.sparkSession.sparkContext.broadcast((train(findings if findings is not None else example_findings(), common), common))


def scan(docs: DataFrame, findings: list | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, from_char, to_char, candidate, score, is_secret: a row for each candidate (code points)."""
    model = _model(docs, findings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", CHUNK):
                of, found = _findings(part.column(1), *model.value, threshold)
                ids, rows, last = part.column(0), [], None
                for i, (s, e, p) in zip(of.tolist(), found, strict=True):
                    if i != last:  # findings are in order: each text is encoded once, and counted up to where it was left
                        last, raw, at, chars = i, part.column(1)[i].as_py().encode(), 0, 0
                    chars += len(raw[at:s].decode())
                    text, at = raw[s:e].decode(), s
                    rows.append((ids[i].as_py(), chars, chars + len(text), text, p, p >= threshold))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "from_char", "to_char", "candidate", "score", "is_secret"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, from_char bigint, to_char bigint, candidate string, score double, is_secret boolean")


def redact(docs: DataFrame, findings: list | None = None, threshold: float = 0.5, mark: str = MARK) -> DataFrame:
    """docs with every secret replaced by a mark, in the same columns."""
    model, column = _model(docs, findings), docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, batch.schema.names[column], CHUNK):
                of, found = _findings(part.column(column), *model.value, threshold)
                hits: dict[int, list] = {}
                for i, f in zip(of.tolist(), found, strict=True):
                    if f[2] >= threshold:
                        hits.setdefault(i, []).append(f)
                if not hits:
                    yield part
                    continue
                texts = part.column(column).to_pylist()
                counts = part.column(n_chars).to_pylist() if n_chars is not None else None
                for i, spans in hits.items():
                    raw, out, at = texts[i].encode(), [], 0
                    for s, e, _ in spans:
                        out += [raw[at:s], mark.encode()]
                        at = e
                    texts[i] = b"".join([*out, raw[at:]]).decode()
                    if counts is not None:
                        counts[i] = len(texts[i])
                cols = list(part.columns)
                cols[column] = pa.array(texts, part.schema.field(column).type)
                if counts is not None:
                    cols[n_chars] = pa.array(counts, part.schema.field(n_chars).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
