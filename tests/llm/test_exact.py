"""Operators with exact results, against plain Python: real tables and awkward rows."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaystone.llm import op01_decontaminate as op1
from quaystone.llm import op03_mixing as op3
from quaystone.llm import op05_chat as op5
from quaystone.llm import op06_substrings as op6
from quaystone.llm import op07_line_rules as op7
from quaystone.llm import op09_near_dedup as op9
from quaystone.llm import op10_warc as op10
from quaystone.llm import words
from quaystone.llm.store import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def vocabulary(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijéü") for _ in range(r.randint(1, 14))) for _ in range(n)]


def awkward(seed=1):
    """Texts with nulls, empties, short and very long ones, odd white space, copies, near copies and shared passages."""
    r = random.Random(seed)
    v = vocabulary(60, seed)
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    passage, base = say(60), say(120)
    near = lambda: " ".join(w if r.random() > 0.01 else r.choice(v) for w in base.split())
    texts = [None, "", "  \n\t ", "one", "one two three four", say(5), say(34), say(35), say(36), " ".join(["aa"] * 80), say(20_000), say(300) + "\x0b" + passage.replace(" ", "\n", 7) + " " + say(40), passage]
    texts += [f"{say(r.randint(0, 50))} {passage} {say(r.randint(0, 50))}" for _ in range(6)]
    texts += [base, base, base.replace(" ", "  "), base.upper(), *[near() for _ in range(12)], *[say(r.randint(1, 90)) for _ in range(20)], say(50) + " \x00 " + say(3)]
    return texts


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def test_words():
    texts = ["Ab\tc", "", None, "é x" * 3, "longer-than-eight-bytes longer-than-eight-byteS", "A"]
    w = words.split_words(pa.array(texts), words.SPACED)
    got = [w.buf[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in (t or "").split()]
    assert w.n_words.tolist() == [len((t or "").split()) for t in texts]
    h = w.hash()
    assert len({int(x) for x in h}) == len(set(got))
    assert words.split_words(pa.array(texts[3:]), words.SPACED).hash().tolist() == h[2:].tolist()
    assert w.same(np.array([4, 0]), np.array([4, 1])).tolist() == [True, False]


# 6 ------------------------------------------------------------------------------------------------


def test_substrings_awkward(spark):
    texts = awkward()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6.dedup_substrings(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute.op6(texts)))


def test_substrings_one_frequent_passage(spark, monkeypatch):
    """A passage in every text, with grams counted as frequent from the start and many small buckets."""
    texts = awkward(2) + [f"{x} {' '.join(vocabulary(70, 3))} {y}" for x, y in zip(vocabulary(80, 4), vocabulary(80, 5), strict=True)]
    got = op6.dedup_substrings(frame(spark, texts), share=1 / 400, bucket_words=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(brute.op6(texts)))


def test_substrings_heavy_grams(spark):
    """Grams that would fill a bucket alone are split by a second order of minimisers."""
    v = vocabulary(90, 50)
    r = random.Random(51)
    passage = " ".join(r.choice(v) for _ in range(45))
    texts = [f"{' '.join(r.choice(v) for _ in range(60))} the same four words {' '.join(r.choice(v) for _ in range(60))}{' ' + passage if i % 9 == 0 else ''}" for i in range(120)]
    docs = frame(spark, texts).withColumn("row", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    got = op6.dedup_substrings(docs, share=1 / 50, heavy=1 / 5000, bucket_words=640).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(brute.op6(texts)))


def test_substrings_repeated_ids_and_empty(spark):
    texts = [" ".join(vocabulary(50, 6)), " ".join(vocabulary(50, 7)), " ".join(vocabulary(50, 6))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in op6.dedup_substrings(frame(spark, texts, [5, 5, 5])).collect())
    assert got == [(5, 50, 0), (5, 50, 50), (5, 50, 50)]
    assert op6.dedup_substrings(frame(spark, texts).limit(0)).count() == 0
    assert op6.dedup_substrings(frame(spark, [None, ""])).count() == 2


# 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [24, 2])
def test_near_dedup_awkward(spark, small):
    """small=2 sends crowded buckets down the exact prefix way."""
    texts = awkward(8)
    r = random.Random(9)
    v = vocabulary(400, 10)
    passage = [r.choice(v) for _ in range(60)]
    for n in range(2, 30):  # around the border of what is linked
        texts.append(" ".join(passage + [r.choice(v) for _ in range(n)]))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in op9.near_dedup(frame(spark, texts), small=small).collect()}
    want = {d: (n, c, d == c) for d, (n, c) in brute.op9(list(enumerate(texts))).items()}
    assert got == want


def test_near_dedup_star_of_a_bad_hub(spark):
    """Chains: each text is linked to its neighbours alone, so components need more than hubs."""
    w = vocabulary(300, 11)
    texts = [" ".join(w[i * 8 : i * 8 + 100]) for i in range(20)]
    got = {x.doc_id: x.component_id for x in op9.near_dedup(frame(spark, texts)).collect()}
    assert got == {d: c for d, (_, c) in brute.op9(list(enumerate(texts))).items()}


def test_near_dedup_repeated_ids_nulls_empty(spark):
    a, b = " ".join(vocabulary(50, 12)), " ".join(vocabulary(50, 13))
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in op9.near_dedup(frame(spark, [a, a, b, a, None], [4, 4, None, None, 9])).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, None, True), (None, 4, False), (9, 9, True)], key=str)
    assert op9.near_dedup(frame(spark, [a]).limit(0)).count() == 0
    kept = op9.keep_one(frame(spark, [a, a, a, b], [4, 4, 3, 8]))
    assert sorted(x.doc_id for x in kept.collect()) == [3, 8] and kept.columns == frame(spark, []).columns


def test_keep_one_decides_by_row(spark):
    """Rows that repeat a doc_id with other texts stay or go by their own texts; of equal rows one stays."""
    a, b, c = (" ".join(vocabulary(50, i)) for i in (31, 32, 33))
    some = lambda rows: sorted(((r.doc_id, r.text) for r in op9.keep_one(frame(spark, [t for _, t in rows], [d for d, _ in rows])).collect()), key=str)
    assert some([(1, a), (5, b), (5, a)]) == [(1, a), (5, b)]
    assert some([(5, b), (5, a)]) == sorted([(5, a), (5, b)])
    assert some([(5, a), (5, a), (None, b), (None, b), (None, a), (7, None), (7, "")]) == sorted([(5, a), (None, b), (7, None)], key=str)
    # Two classes whose smallest id is the same are two classes.
    near = " ".join(b.split()[:48])
    got = op9.near_dedup(frame(spark, [a, b, near, c], [5, 5, 6, 7])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)]
    assert some([(5, a), (5, b), (6, near), (7, c)]) == sorted([(5, a), (5, b), (7, c)])


def test_keep_one_repeated_ids_against_brute(spark):
    r = random.Random(34)
    texts = [t for t in awkward(35) if t]
    rows = [(r.randint(0, 30), r.choice(texts)) for _ in range(150)]
    # Every row is a document: a group's name is its smallest id, and a row stays if it has that id.
    comps = brute.op9([((d, i), t) for i, (d, t) in enumerate(rows)])
    want = {(d, frozenset(brute.shingles(t))) for i, (d, t) in enumerate(rows) if comps[d, i][1][0] == d}
    kept = op9.keep_one(frame(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert len(kept) == len(want) and {(x.doc_id, frozenset(brute.shingles(x.text))) for x in kept} == want


def test_near_dedup_hot_keys_and_other_ids(spark):
    """Bands held by many documents are dealt over partitions; doc_id may be a string, and columns of any name may come along."""
    base = vocabulary(120, 36)
    texts = [" ".join(w if (i * 7 + j) % 61 else f"{w}{i}" for j, w in enumerate(base)) for i in range(90)] + [" ".join(vocabulary(60, 40 + i)) for i in range(30)]
    rows = [(f"d{i:03}", t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, id string, component int")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op9.near_dedup(docs, share=1 / 64, least=5).collect()}
    assert got == brute.op9([(d, t) for d, t, _, _ in rows]) and len({c for _, c in got.values()}) < 100
    assert op9.keep_one(docs).columns == docs.columns


# 1 ------------------------------------------------------------------------------------------------


def suffixes(seq):
    return sorted(range(len(seq)), key=lambda i: seq[i:].tolist())


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (40, 2), (200, 3), (300, 40), (64, 1)):
        seq = rng.integers(1, k + 1, n)
        assert op1.suffix_array(np.append(seq, 0)).tolist() == suffixes(np.append(seq, 0))
        index = op1.FMIndex(seq, k)
        text = seq.tolist()
        pats = [text[i : i + m] for i in range(0, n, 7) for m in (1, 2, 5) if i + m <= n] + [[k, k, k, k]]
        rows = np.ones((len(pats), 5), np.int64)
        for i, p in enumerate(pats):
            rows[i, : len(p)] = p
        low, high = index.search(rows, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n) if text[i : i + len(p)] == p]


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontaminate_awkward(spark, block_words):
    v = vocabulary(40, 14)
    r = random.Random(15)
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (3, say(4)), (4, ""), (5, None), (6, "Ünder, 42!"), (7, say(20)), (7, say(15)), (8, " ".join(["x"] * 20)), (None, say(15))]
    texts = [None, "", "...", "under 42", "ÜNDER Ünder 42", items[0][1].upper(), f"{say(40)}. {items[1][1]}", items[6][1] + " " + items[7][1], "x " * 40, f"{say(500)} {items[2][1]}", say(3000) + " " + items[0][1][:60], *[say(50) for _ in range(10)]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = op1.contaminated(op1.contamination(frame(spark, texts), bench, block_words=block_words))
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"] or []), brute.sha(",".join(sorted(map(str, x["items"] or [])))), x.contaminated) for x in found.collect()}
    assert got == brute.op1(list(enumerate(texts)), [i for i in items if i[0] is not None])


def test_cut_spans_and_empty_benchmark(spark):
    phrase = " ".join(vocabulary(14, 16))
    bench = spark.createDataFrame([(1, phrase)], "item_id bigint, text string")
    docs = frame(spark, [f"before. {phrase}! after", "clean", None])
    rows = {r.doc_id: (r.text, r.n_chars) for r in op1.cut_spans(op1.contamination(docs, bench)).collect()}
    assert rows == {0: ("before. ! after", 15), 1: ("clean", 5), 2: (None, 0)}
    assert {r.n_hit for r in op1.contaminated(op1.contamination(docs, bench.limit(0))).collect()} == {0}
    assert op1.contamination(docs.limit(0), bench).count() == 0
    # Columns called as anything inside the operator come back as they were.
    names = ["spans", "items", "n_words", "n_hit", "contaminated", "c0", "c1", "score"]
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in names}).withColumn("n_chars", F.lit("own"))
    for block_words in (10**6, 1):
        out = op1.decontaminate(clash, bench.union(bench), block_words=block_words)
        assert out.columns == clash.columns and out.dtypes == clash.dtypes
        assert {r.doc_id for r in out.collect()} == {1, 2} and all(r[c] == f"own {c}" for r in out.collect() for c in names)
    assert {r.n_hit for r in op1.contaminated(op1.contamination(clash, bench)).collect()} == {14, 0}


# 7 ------------------------------------------------------------------------------------------------


def test_line_rules(spark):
    line = "this line stands in every page of the host"
    own = lambda i: " ".join(vocabulary(30, 100 + i))
    texts = [f"{own(i)}\n{line}" for i in range(30)] + [line + " " + line, line, line, None, "", " \n ", "a b c d e f g h i j # *|\na b c d e f g h i j # *|"]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, "h", "clash") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, source string, n_words string")
    got = {r.doc_id: r for r in op7.line_rules(docs.drop("n_words")).collect()}
    assert len(got) == len(texts) and op7.line_rules(docs).count() == len(texts)
    assert all(got[i].kept and got[i].n_boilerplate == 9 for i in range(30))
    assert got[30].base_failed and not got[30].kept  # repeated words
    assert (got[31].n_words, got[31].kept) == (9, False)
    assert all((got[i].n_words, got[i].base_failed) == (0, True) for i in (33, 34, 35))
    assert (got[36].n_symbols, got[36].n_dup_lines, got[36].n_repeat_words, got[36].word_chars) == (6, 1, 24, 26)
    assert op7.line_rules(docs.limit(0)).count() == 0


def test_depleted_documents(spark):
    """Documents of little more than lines of their host are rejected by the count of lines alone, in the query and in its SQL."""
    import duckdb

    line = "this line stands in every page of the host"
    own = lambda i, n: " ".join(vocabulary(n, 100 + i))
    texts = [f"{own(i, 30)}\n{line}" for i in range(30)] + [f"{own(50 + i, 4 + i)}\n{line.upper()}" for i in range(8)] + ["w" * 200_000 + f"\n{line}\n" + own(70, 20_000)]
    rows = [(i, t, None if i % 2 else "h") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r) for r in op7.line_rules(docs).select("doc_id", "n_words", "n_boilerplate", "base_failed", "kept").collect()))
    rejected = {i for i, _, _, failed, kept in got if not failed and not kept}
    assert rejected == {30 + i for i in range(8) if 4 + i < (13 + i) / 2}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert got == sorted(con.execute(f"SELECT doc_id, n_words, n_boilerplate, base_failed, kept FROM ({op7.ORACLE})").fetchall())


@pytest.mark.parametrize("most", [20, 3])
def test_clean_lines_against_plain_python(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()] + [(90_000 + i, f"own {i} words {i}\nThe same  LINE {i}\n\n {vocabulary(9, i)[0]}", "x" if i < 12 else None) for i in range(20)] + [(1, None, None), (1, "", "x")]
    got = sorted((tuple(r) for r in op7.clean_lines(spark.createDataFrame(rows, docs.schema), most=most).select("doc_id", "text", "n_boilerplate", "n_lines_removed", "kept").collect()), key=repr)
    assert got == sorted(brute.op7_clean(rows, most), key=repr)
    assert any(r[3] for r in got)


def test_clean_lines(spark):
    """Texts come back without the lines above the limits, in hosts of every size; planted documents that this depletes are not kept."""
    own = lambda i, n: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    lines = ["All rights  reserved 20{} by the publisher of this fine site", "Some rights are not reserved since {} weeks or longer ago", "No rights reserved here for {} more days in any land"]
    foot = lambda i: "\n".join(x.format(i % 90 + 10) for x in lines)
    texts = [f"{own(i, 40)}\n\n{foot(i)}\n{own(i + 300, 12)} end" if i < 22 else own(i, 60) for i in range(600)]
    # Lines in 22 of 600 texts are under the share of 0.05. Planted: little more than such lines.
    planted = [f"{foot(i)}\n{own(700 + i, 12)}" for i in range(4)] + [lines[0].format(12) + "\nshort rest"]
    rows = [(i, t, "s") for i, t in enumerate([*texts, *planted])] + [(9000, None, "s"), (9001, "", None), (9002, foot(10), "other")]
    got = {r.doc_id: r for r in op7.clean_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), most=20).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(texts):
        assert got[i].text == "\n".join(x for x in text.split("\n") if "reserved" not in x) and got[i].kept
        assert (got[i].n_lines_removed, got[i].n_boilerplate) == ((3, len(foot(i).split())) if i < 22 else (0, 0))
    for i in range(600, 605):
        assert "rights" not in got[i].text and not got[i].kept and not got[i].base_failed
    assert got[603].text == own(703, 12) and got[9000].text is None and got[9001].text == "" and got[9002].text == foot(10)



# 3 ------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, "w " * 50, "en", "big" if i < 600 else None if i < 640 else f"s{i % 5}", 1) for i in range(800)] + [(800, None, "en", "s0", 0), (801, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = op3.mix(docs, block_tokens=500).toPandas()
    totals = docs.withColumn("t", F.greatest(F.lit(1), F.when(F.col("text") > "", 50).otherwise(1))).groupBy("source").agg(F.sum("t").alias("t")).toPandas()
    a = brute.op3_exponent(totals.t.tolist(), op3.ENTROPY, op3.REPEATS)
    quota = totals.assign(q=totals.t**a)
    quota["passes"] = quota.q / quota.t / (quota.q / quota.t).min()
    assert mixed.doc_id.nunique() == 802  # nothing is lost
    assert abs(a - op3.exponent(op3.cut(op3.weights(op3.token_counts(docs)).select((F.col("total") / totals.t.sum()).alias("share")), "t"))) < 1e-4
    taken = mixed.assign(source=mixed.source.fillna("-")).groupby("source").tokens.sum()
    for r in quota.itertuples():
        assert abs(taken[r.source or "-"] - r.passes * r.t) <= 550
    assert not mixed.duplicated(["doc_id", "epoch"]).any()
    big = mixed[mixed.source == "big"].drop_duplicates("block").sort_values("block_rank").block.tolist()
    assert set(mixed[mixed.source == "big"].epoch) == {0} and sorted(big) != big
    names = ["epoch", "total", "s", "b", "weight", "quota", "n", "c0", "of", "before", "range"]
    carried = op3.mix(docs.withColumns({c: F.lit(f"own {c}") for c in names}), block_tokens=500, carry=True).toPandas()
    assert len(carried) == len(mixed) and set(carried.input_epoch) == {"own epoch"} and all(set(carried[c]) == {f"own {c}"} for c in names[1:])
    own = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert sorted(mixed[["doc_id", "tokens", "epoch", "block", "block_rank"]].itertuples(index=False, name=None)) == brute.op3(own, block_tokens=500)
    assert op3.mix(docs.limit(0)).count() == 0


def test_mixing_query(spark):
    """Every row of the query, with ties, a very long text and a source in one block."""
    rows = [(r.doc_id, r.source, r.text) for r in op3.table(spark, SF, "documents").collect()]
    got = sorted((r.doc_id, r.tokens, r.epoch, r.block, r.block_rank) for r in op3.op3_mixing(spark, SF).collect())
    assert got == brute.op3(rows)
    rows = [(i % 90, "a" if i % 3 else None, "w " * (30_000 if i == 7 else i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((r.doc_id, r.tokens, r.epoch, r.block, r.block_rank) for r in op3.mix(docs, block_tokens=100).collect())
    assert got == brute.op3(rows, block_tokens=100)


def test_mixing_budget_and_one_source(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "en", "one", 1) for i in range(100)], DOCS)
    assert op3.mix(docs, block_tokens=500).groupBy("epoch").count().collect()[0]["count"] == 100
    part = op3.mix(docs, block_tokens=500, budget=2500.0).agg(F.sum("tokens")).first()[0]
    assert 2500 <= part <= 4500


# 5 and 10 ------------------------------------------------------------------------------------------


def test_chat(spark):
    odd = ["<|im_end|>", "<\\|x", "<\\\\|", "<|", "\\", "", None, "a\nb"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "tool", "x\ny<|im_end|>\\n", None, "assistant", "user"], odd, strict=True))]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (2, 1, "assistant", "ho"), (None, None, "user", "n"), (3, 0, "user", "hi"), (3, 1, "assistant", "ho")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in op5.read_back(op5.format_turns(turns)).collect()}
    digest = lambda ts: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ts).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(rows[:8]) and got[1].n_turns == 8 and not got[1].valid
    assert got[1].loss_sha256 == brute.sha("<\\\\|") and got[1].loss_chars == 4
    assert (got[2].n_turns, got[2].loss_chars, got[2].valid, got[3].valid, got[None].valid) == (3, 4, False, True, False)
    assert op5.read_back(op5.format_turns(turns.limit(0))).count() == 0
    more = spark.createDataFrame([(8, 0, "user", "q " * 200_000, "x"), (8, 1, "assistant", "<|im_end|>\n" * 30_000, "x")], "conv_id bigint, turn bigint, role string, text string, segment string")
    long = op5.read_back(op5.format_turns(more.withColumn("loss", F.lit("clash")))).first()
    assert (long.n_turns, long.loss_chars, long.valid) == (2, 11 * 30_000, True) and long.loss_sha256 == brute.sha("<|im_end|>\n" * 30_000)
    text = "".join(r.segment for r in op5.format_turns(turns.filter("conv_id = 3")).collect())
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n"


def test_reader_needs_no_segments():
    """The text is parsed as it runs on, cut anywhere."""
    say, said = "<|im_end|><|im_start|>assistant ok", []
    for role, text in (("user", say), ("assistant", say), ("tool", "a\n<|"), ("assistant", "")):
        said += [(f"<|im_start|>{op5.escape_role(role)}\n", False), (op5.escape(text), role == "assistant"), ("<|im_end|>\n", False)]
    chars = [(c, loss) for segment, loss in said for c in segment]
    for step in (1, 3, 10):
        reader = op5.Reader(op5.CHATML)
        for i in range(0, len(chars), step):
            for loss in (False, True):  # a cut where the mask changes too
                part = "".join(c for c, x in chars[i : i + step] if x == loss)
                if step == 1 or len({x for _, x in chars[i : i + step]}) == 1:
                    if part:
                        reader.read(part, loss)
                elif loss:
                    for c, x in chars[i : i + step]:
                        reader.read(c, x)
        assert reader.done() == (4, brute.sha(f"user\n{say}\nassistant\n{say}\ntool\na\n<|\nassistant\n\n"), len(say), brute.sha(say), len(chars), True)
    with pytest.raises(ValueError):
        op5.Reader(op5.CHATML).read("<|im_start|>user hi<|im_end|>\n", False)


def test_escapes_reverse():
    r = random.Random(3)
    for _ in range(2000):
        t = "".join(r.choice("<|\\n\n") for _ in range(r.randint(0, 8)))
        assert "<|" not in op5.escape(t) and op5.unescape(op5.escape(t)) == t
        assert "\n" not in op5.escape_role(t) and op5.unescape_role(op5.escape_role(t)) == t


def test_warc(spark):
    big, small = "<p>é" + "x" * 100, "y" * 99
    rows = [(5, "http://a/\r\nb", big), (3, "http://b", big), (9, None, big), (1, "u", small), (2, "u", small), (4, "u", None), (7, "u", ""), (3, "http://c", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = new_path(spark, "warc-test")
    op10.archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    got = op10.restore(spark, path).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("5", "revisit", 3), ("3", "response", None), ("3", "response", None), ("9", "revisit", 3), ("None", "revisit", 3), *[(str(i), "response", None) for i in (1, 2, 4, 7)]])
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert bytes(r.payload) == html.encode() and r.payload_digest == brute.sha(html) and r.payload_bytes == len(html.encode())
        assert bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: ") and bytes(r.record).endswith(b"\r\n\r\n")
    assert next(r.url for r in got if r.page_id == 5) == "http://a/\r\nb"
    odd = [(i, u, "x" * (3_000_000 if i == 1 else 5)) for i, u in enumerate(["", "a%0Ab%25", "%\n%25\r", "http://é", None])]
    op10.archive(spark.createDataFrame(odd, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("payload", "n", "first_id")}), other := new_path(spark, "warc-test"))
    assert {r.page_id: (r.url, len(r.payload)) for r in op10.restore(spark, other).collect()} == {i: (u, len(h)) for i, u, h in odd}
    empty = new_path(spark, "warc-test")
    op10.archive(pages.limit(0), empty)
    assert op10.restore(spark, empty).count() == 0
