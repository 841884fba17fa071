"""Fingerprints, manifest and clusters against plain Python, and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_exact import DOCS, awkward, frame, vocabulary

from quaystone.llm import op11_simhash as op11
from quaystone.llm import op12_manifest as op12
from quaystone.llm import op13_clusters as op13

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 -----------------------------------------------------------------------------------------------


def brute_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    """values: id -> fingerprint; the smallest id reachable over at most four bits."""
    up = {d: d for d in values}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(values)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_fingerprints(monkeypatch, block):
    monkeypatch.setattr(op11, "BLOCK", block)
    texts = [*awkward(3), "\x00 \x01", "É ß  \x0b ß É"]
    assert [int(x) for x in op11.fingerprints(pa.array(texts))] == [brute_fingerprint(t) for t in texts]
    assert len(op11.fingerprints(pa.array([], pa.string()))) == 0


def near_values(seed, n=60):
    """Chains and crowds of values that differ in a few bits, zero among them."""
    r = random.Random(seed)
    out = [0, (1 << 64) - 1, 15, 31, 0x7FFF]
    for _ in range(8):
        now = r.getrandbits(64)
        for _ in range(n):
            moved = now
            for b in r.sample(range(64), r.randint(1, 6)):
                moved ^= 1 << b
            out.append(moved)
            now = moved if r.random() < 0.4 else now
    return list(dict.fromkeys(out))


def test_forest_connects_what_is_linked():
    fp = np.array(near_values(1), np.uint64)
    links = op11.forest(np.zeros(len(fp), np.int64), fp)
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in links) and len(links) < 4 * len(fp)
    at = {int(x): i for i, x in enumerate(fp)}
    up = list(range(len(fp)))
    for a, b in links:
        x, y = up[at[int(a)]], up[at[int(b)]]
        up = [x if u == y else u for u in up]
    want = brute_components(dict(enumerate(fp.tolist())))
    groups = defaultdict(set)
    for i, u in enumerate(up):
        groups[u].add(want[i])
    assert len(groups) == len(set(want.values())) and all(len(g) == 1 for g in groups.values())


def test_linked_values_share_a_cell():
    r = random.Random(2)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        cell, of = op11.cells(np.array([a, b], np.uint64))
        assert set(cell[of == 0].tolist()) & set(cell[of == 1].tolist())


@pytest.mark.parametrize("most", [op11.MOST, 3])
def test_links_in_every_way(spark, most):
    """most=3 sends nearly every cell down the way by values between."""
    values = near_values(5, 12)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = op11.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), most).collect()
    up = {v: v for v in signed}
    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        x, y = up[r.a], up[r.b]
        up = {k: x if u == y else u for k, u in up.items()}
    want = brute_components(dict(enumerate(values)))
    assert len(set(up.values())) == len(set(want.values()))


def test_near_copies_awkward(spark):
    texts = awkward(4) + ["same few words here"] * 3
    docs = frame(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in op11.near_copies(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    comps = brute_components(prints)
    assert got == {i: (prints[i], comps[i]) for i in prints}


def test_near_copies_repeated_null_and_empty(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, None), (9, ""), (None, "no other has this text at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in op11.near_copies(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    assert op11.near_copies(docs.limit(0)).count() == 0


def test_op11_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op11.op11_simhash(spark, SF).collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    comps = brute_components(prints)
    assert got == {d: (prints[d], comps[d]) for d in texts}
    assert any(c != d for d, c in comps.items())


# 12 -----------------------------------------------------------------------------------------------


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """(root, for each leaf its way: (siblings, place) a level)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for way, i in zip(ways, range(len(leaves)), strict=True):
            run = runs[at[i] // 16]
            way.append((run[: at[i] % 16] + run[at[i] % 16 + 1 :], at[i] % 16))
            at[i] //= 16
        level = [sha("".join(run)) for run in runs]
    return level[0], ways


def brute_op12(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (first(r[0]), brute_leaf(r)))
    trees = {s: brute_tree([brute_leaf(r) for r in by[s]]) for s in sources}
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, way in zip(by[s], trees[s][1], strict=True):
            way = way + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = brute_leaf((*r[:4], lowered(r[4]) if r[4] is not None else None)) if tampered else brute_leaf(r)
            for siblings, place in way:
                node = sha("".join([*siblings[:place], node, *siblings[place:]]))
            out.append((r[0], brute_leaf(r), trees[s][0], root, sha("".join(x for siblings, _ in way for x in siblings)), node, node == root))
    return sorted(out, key=repr)


def run_op12(spark, rows, tmp_path, name, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("grp", F.lit(1)).withColumn("rank", F.lit("x"))
    path = str(tmp_path / name)
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in op12.op12_manifest(spark, path, **options).collect()), key=repr)


def manifest_rows():
    r = random.Random(31)
    rows = [(i, r.choice(["a", "b", "é", "Z", None]), "en", i, f"Text {i} É") for i in range(300)]
    rows += [(500, "lone", None, None, None), (501, "two", "", -1, ""), (None, "two", "x", 3, "NULL id"), (None, "two", "x", 3, "null id"), (3, None, "en", 0, "X")]
    return rows + [(7, "two", "l", 1, "Same ROW")] * 40 + [(600, "", "l", 1, "W" * 300_000)]


def test_manifest_awkward(spark, tmp_path):
    rows = manifest_rows()
    assert run_op12(spark, rows, tmp_path, "m") == brute_op12(rows)


def test_manifest_of_many_blocks(spark, tmp_path):
    """Blocks of 16 leaves: trees of blocks over several rounds, one source with most of the rows."""
    rows = [(i, "hot" if i % 10 else f"s{i % 70}", "en", 1, f"T{i}") for i in range(1200)]
    assert run_op12(spark, rows, tmp_path, "m", levels=1) == brute_op12(rows)


def test_manifest_empty_and_single(spark, tmp_path):
    assert run_op12(spark, [], tmp_path, "none") == []
    got = run_op12(spark, [(1, "s", "en", 1, "Only")], tmp_path, "one")
    assert got == brute_op12([(1, "s", "en", 1, "Only")]) and got[0][4] == sha("")


def test_op12_whole_table(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op12.op12_manifest(spark, SF).collect()), key=repr)
    assert got == brute_op12(rows)
    assert {r[-1] for r in got} == {True, False}


def test_appends_one_by_one():
    """A subtree that takes leaves singly knows, after every append and close, the witnesses of a tree of so many leaves."""
    for n in (1, 2, 15, 16, 17, 255, 256, 257):
        leaves = [sha(str(i)) for i in range(n)]
        tree = op12.Subtree(op12.height(n))
        for x in leaves:
            tree.append(x)
        root, ways = brute_tree(leaves)
        siblings, places = tree.close().witnesses([], [])
        assert (tree.root or leaves[0]) == root
        assert [list(zip(s, p, strict=True)) for s, p in zip(siblings.to_pylist(), places.to_pylist(), strict=True)] == ways


# 13 -----------------------------------------------------------------------------------------------


def brute_op13(rows, k=16, rounds=3):
    kept = []
    for d, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((d, [int(np.floor(64 * float(x))) for x in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        centroids = [[sum(x) // len(of[i]) for x in zip(*of[i], strict=True)] if i in of else c for i, c in enumerate(centroids)]
    found = [(d, *near(v)[::-1]) for d, v in kept]
    inertia = defaultdict(int)
    for _, c, dist in found:
        inertia[c] += dist
    return sorted(((d, c, dist, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for d, c, dist in found), key=repr)


def run_op13(spark, rows, tmp_path, name, kind="float"):
    path = str(tmp_path / name)
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("cluster", F.lit("clash"))
    df.write.parquet(f"{path}/embeddings.parquet")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in op13.op13_clusters(spark, path).select(cols).collect()), key=repr)


def test_clusters_awkward(spark, tmp_path):
    r = np.random.default_rng(4)
    v = lambda: [float(x) for x in r.normal(size=64).astype(np.float32)]
    same = v()
    rows = [(i, v()) for i in range(90)] + [(i, same) for i in range(100, 130)] + [(130, None), (131, []), (132, v()[:63]), (133, [*v()[:63], None]), (134, [*v()[:63], float("nan")]), (135, [*v()[:63], float("inf")]), (136, [0.0] * 64), (136, [0.0] * 64), (None, v()), (137, [-0.0] * 64)]
    assert run_op13(spark, rows, tmp_path, "v") == brute_op13(rows)


def test_clusters_ties_and_few(spark, tmp_path):
    """Components of one or two values: most distances are tied; fewer vectors than centroids; none."""
    r = random.Random(6)
    rows = [(i, [float(r.randint(0, 1)) / 64 if j < 6 else 0.0 for j in range(64)]) for i in range(200)]
    assert run_op13(spark, rows, tmp_path, "tied", "double") == brute_op13(rows)
    assert run_op13(spark, rows[:5], tmp_path, "few") == brute_op13(rows[:5])
    assert run_op13(spark, [], tmp_path, "none") == []


def test_clusters_beyond_the_bound(spark, tmp_path):
    rows = [(i, [1e300 if i % 2 else -1e300] * 64) for i in range(20)]
    got = run_op13(spark, rows, tmp_path, "far", "double")
    assert len(got) == 20 and {x[2] for x in got} == {0}


def test_orchard_search():
    r = np.random.default_rng(8)
    for k in (1, 2, 16, 40):
        c = r.integers(-3, 4, size=(k, 64))
        x = r.integers(-3, 4, size=(500, 64))
        c[k // 2] = c[0]
        x[:k] = c
        want = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        of, distance = op13.nearest(x, c)
        assert (of == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
