"""Mixing sources to target weights by temperature, in DataFrame operations alone.

A source with a share p of all tokens gets the weight p^a / sum(p^a). The exponent a is bisected to
the largest in [0, 1] whose weights reach a target entropy (a fraction of the entropy of equal
shares), and then raised as far as a limit on repetition demands. Weights become budgets of tokens, and a budget becomes passes
over the source: whole passes first, then the blocks that begin within what is left, in the order of
a keyed permutation of blocks that differs from pass to pass. Without a budget of its own, the mix
is as large as makes the least repeated source run exactly once, so that no document is lost.

Sources are aggregated before they are shuffled; documents of a source are dealt over blocks by a
hash, and running sums and ranks go over blocks in two levels: over the blocks of each of `RANGES` ranges of
their hashed order, and over the ranges. So no task holds a source with a third of all rows, nor all its blocks.
Five bisection steps are evaluated in one pass over the source table.

Defined cases: a null text has no tokens; a null source is a source of its own; documents without
tokens count one token, so that they stay in the mix; a doc_id that occurs in several rows is so
many documents; an empty table gives no rows. Other columns are ignored, or carried as they are; a carried column
that is called as one of the results (`tokens`, `epoch`, `block`, `block_rank`, in small or capital letters) comes back with `input_` before its
name, as often as it takes until no other column is called so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut, numbered, table

ENTROPY = 0.98  #: of the entropy of equal shares
REPEATS = 4.0  #: most passes over a source
BLOCK_TOKENS = 200_000
STEPS = 40  #: of bisection
SEED = 17
RANGES = 4096  #: of the hashed order of blocks, a power of two
RESULTS = ("tokens", "epoch", "block", "block_rank")


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens: words between white space."""
    return docs.select("doc_id", "source", _tokens().alias("tokens"))


def _tokens(text: str = "text") -> F.Column:
    return F.array_size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")).cast("long")


def _facts(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: entropy as a fraction of the largest, and passes over the most repeated source when the least repeated runs once."""
    at = shares.select("share", F.posexplode(F.array(*[F.lit(float(x)) for x in exponents])).alias("k", "a"))
    powers = at.select("k", F.pow("share", F.col("a")).alias("w"), "share")
    found = powers.groupBy("k").agg(
        (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("h"), F.log(F.count("w").cast("double")).alias("most"), (F.max(F.col("w") / F.col("share")) / F.min(F.col("w") / F.col("share"))).alias("repeats")
    )
    return [(r.h / r.most if r.most > 0 else 1.0, r.repeats) for r in found.orderBy("k").collect()]


def _bisect(shares: DataFrame, holds, low: float, high: float, steps: int = STEPS, at_once: int = 5) -> float:
    """The border in [low, high] between exponents that hold (below) and those that do not; `at_once` steps a pass."""
    while steps > 0:
        depth = min(at_once, steps)
        n = 2**depth
        grid = [low + (high - low) * i / n for i in range(1, n)]
        passed = [holds(*f) for f in _facts(shares, grid)]
        i, width = 0, n
        while width > 1:
            width //= 2
            if passed[i + width - 1]:
                i += width
        low, high = low + (high - low) * i / n, low + (high - low) * (i + 1) / n
        steps -= depth
    return low


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent that reaches the entropy, raised as far as the repetition limit asks."""
    (h1, _), (_, r0) = _facts(shares, [1.0, 0.0])
    a = 1.0 if h1 >= entropy else _bisect(shares, lambda h, r: h >= entropy, 0.0, 1.0)
    least = 0.0 if r0 <= repeats else _bisect(shares, lambda h, r: r > repeats, 0.0, 1.0) + 2.0**-STEPS
    return min(1.0, max(a, least))


def weights(counts: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """source, total (its tokens), weight, quota (its tokens in the mix); one row a source."""
    sums = counts.groupBy("source").agg(F.sum(F.greatest("tokens", F.lit(1))).alias("total"))
    all_tokens = sums.agg(F.sum("total").alias("n")).first().n
    if not all_tokens:
        return sums.select("source", "total", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota")).limit(0)
    shares = cut(sums.withColumn("share", F.col("total") / F.lit(float(all_tokens))), "shares")
    a = exponent(shares, entropy, repeats)
    norm = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a)) / F.col("total")).alias("least")).first()
    size = budget if budget is not None else norm.z / norm.least
    weighed = shares.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(norm.z))
    return weighed.select("source", "total", "weight", (F.col("weight") * F.lit(float(size))).alias("quota"))


def _ordered(rows: DataFrame, keys: list[str], order: F.Column, size: F.Column) -> DataFrame:
    """rows with `before`: the sum of sizes of the rows of the same keys that come first by order (a hash), then block; in two levels."""
    ranged = rows.withColumns({"at": order, "size_": size}).withColumn("range", F.shiftright("at", 64 - RANGES.bit_length() + 1))
    whole = ranged.groupBy(*keys, "range").agg(F.sum("size_").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = whole.select(*[F.col(c).alias(f"{c}_") for c in [*keys, "range"]], F.coalesce(earlier, F.lit(0)).alias("offset"))
    within = F.sum("size_").over(Window.partitionBy(*keys, "range").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1))
    same = F.lit(True)
    for c in [*keys, "range"]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return ranged.withColumn("inner", F.coalesce(within, F.lit(0))).join(offsets, same).withColumn("before", F.col("offset") + F.col("inner")).select(*rows.columns, "before")


def carried_names(columns: list[str]) -> dict[str, str]:
    """What each column is called beside the results; names that differ in case alone are one name."""
    called = {c: c for c in columns if c.lower() not in RESULTS}
    taken = {*RESULTS, *(c.lower() for c in called)}
    for c in columns:
        if c not in called:
            name = f"input_{c}"
            while name.lower() in taken:
                name = f"input_{name}"
            called[c] = name
            taken.add(name.lower())
    return called


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, tokens, epoch, block, block_rank: a row for each time that a document is in the mix.

    The mix reads epoch by epoch, within it by block_rank, within a block by a hash of doc_id.
    carry: all columns of docs come along (in place of doc_id and source alone).
    """
    counts = cut(token_counts(docs).withColumn("tokens", F.greatest("tokens", F.lit(1))), "tokens")
    quotas = cut(weights(counts, entropy, repeats, budget), "quotas").withColumnRenamed("source", "s")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(block_tokens)))).cast("long")
    dealt = lambda rows, doc_id, source: rows.join(quotas, F.col(source).eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64(doc_id, F.lit(seed)), n_blocks))
    # Whole passes take every block; the last pass takes blocks, permuted by a hash, until the rest of the quota is spent.
    exact = F.round(F.col("quota") / F.col("total"), 9)
    blocks = dealt(counts, "doc_id", "source").groupBy("source", "block", "total", "quota").agg(F.sum("tokens").alias("size"))
    planned = blocks.select("source", "block", "size", F.floor(exact).cast("long").alias("whole"), ((exact - F.floor(exact)) * F.col("total")).alias("rest"))
    last = _ordered(planned, ["source"], F.xxhash64("block", F.col("whole"), F.lit(seed)), F.col("size"))
    passes = last.withColumn("taken", F.col("before") < F.col("rest")).select("source", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"), "whole", "taken")
    kept = cut(passes.filter((F.col("epoch") < F.col("whole")) | F.col("taken")).select("source", "block", "epoch"), "passes")
    ranked = _ordered(kept, ["source", "epoch"], F.xxhash64("block", "epoch", F.lit(seed)), F.lit(1).cast("long"))
    ranked = cut(ranked.select(F.col("source").alias("of"), F.col("block").alias("b"), "epoch", (F.col("before") + 1).cast("int").alias("block_rank")), "blocks")
    rows, names = numbered(docs if carry else counts)
    tokens = F.greatest(_tokens(names["text"]), F.lit(1)) if carry else F.col(names.pop("tokens"))
    placed = dealt(rows.withColumn("n", tokens), names["doc_id"], names["source"]).join(ranked, F.col(names["source"]).eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    called = carried_names(list(names))
    return placed.select(*[F.col(now).alias(called[c]) for c, now in names.items()], F.col("n").alias("tokens"), "epoch", "block", "block_rank")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
