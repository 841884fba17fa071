"""Who filed: tiered resolution of names against a crosswalk.

Candidates of a filing are those of its surname and state, and those whose run-together names agree. Over them, tiers answer in order:
forename and surname; surname alone, then with a forename that begins as the other does, or a nickname; the names run together,
since sources split compound surnames at different places. A tier answers with one person, or else with the one of the filing's seat.
Several people under one forename and surname end the search; otherwise an undecided tier leaves it to the next.
Joins are on names and state; their sizes are the planner's to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import names as N


def keyed_crosswalk(crosswalk: DataFrame) -> DataFrame:
    """Seats of people with their names as keys; k_nick and k_nick_joined are null without a nickname."""
    last, first = N.folded(F.col("last")), N.folded(F.col("first"))
    nick = F.nullif(N.folded(F.col("nickname")), F.lit(""))
    return crosswalk.select(
        "bioguide", "chamber", F.upper("state").alias("x_state"), N.seat_number(F.col("district")).alias("x_seat"), "last_term_end_year", last.alias("k_last"), first.alias("k_first"), nick.alias("k_nick"),
        N.letters(F.concat(first, last)).alias("k_joined"), N.letters(F.concat(nick, last)).alias("k_nick_joined"),
    ).distinct()


def _word(name: Column) -> Column:
    return F.split(name, " ")[0]


def _one(flag: Column) -> Column:
    """The one person among the candidates with a flag, or the one among those of the filing's seat; null if there is none."""
    seated = flag & F.coalesce(F.col("seat") == F.col("x_seat"), F.lit(False))
    who, there = F.when(flag, F.col("bioguide")), F.when(seated, F.col("bioguide"))
    return F.when(F.min(who) == F.max(who), F.min(who)).when(F.min(there) == F.max(there), F.min(there))


def resolve(filings: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """filing_id, bioguide, resolution (matched, ambiguous or not_found). filings: filing_id, last, first, state, district."""
    last, first = N.folded(F.col("last")), N.folded(F.col("first"))
    f = filings.select("filing_id", F.upper("state").alias("f_state"), N.seat_number(F.col("district")).alias("seat"), last.alias("f_last"), first.alias("f_first"), N.letters(F.concat(first, last)).alias("f_joined"))
    x = keyed_crosswalk(crosswalk)
    by_surname = f.join(x, (F.col("f_state") == F.col("x_state")) & (F.col("f_last") == F.col("k_last"))).withColumn("of_surname", F.lit(True))
    runs = x.withColumn("k_run", F.explode(F.filter(F.array_distinct(F.array("k_joined", "k_nick_joined")), lambda k: k.isNotNull())))
    by_run = f.join(runs, (F.col("f_state") == F.col("x_state")) & (F.col("f_joined") == F.col("k_run"))).drop("k_run").withColumn("of_surname", F.lit(False))
    of_surname, first = F.col("of_surname"), F.col("f_first")
    nick = F.coalesce(F.col("k_nick") == first, F.lit(False))
    exact = of_surname & ((_word(first) == _word(F.col("k_first"))) | F.coalesce(_word(F.col("k_nick")) == _word(first), F.lit(False)))
    alike = of_surname & (first != "") & (F.col("k_first").startswith(first) | first.startswith(F.col("k_first")) | nick)
    told = by_surname.unionByName(by_run).groupBy("filing_id").agg(
        _one(exact).alias("t1"), F.count_distinct(F.when(exact, F.col("bioguide"))).alias("exact"), _one(of_surname).alias("t2"), _one(alike).alias("t2_first"), _one(~of_surname).alias("t3"), F.count_if(of_surname).alias("surnames"),
    )
    one = F.coalesce("t1", F.when(F.col("exact") < 2, F.coalesce("t2", "t2_first", "t3")))
    unsure = (F.coalesce("exact", F.lit(0)) > 1) | (F.coalesce("surnames", F.lit(0)) > 0)
    return filings.select("filing_id").join(told, "filing_id", "left").select("filing_id", one.alias("bioguide"), F.when(one.isNotNull(), "matched").when(unsure, "ambiguous").otherwise("not_found").alias("resolution"))


def resolve_in_chamber(filings: DataFrame, crosswalk: DataFrame, chamber: str, served_since: int | None = None) -> DataFrame:
    """filing_id, bioguide, resolution of names without a state, among those of a chamber whose last term ends in a year or later.

    Suffixes go from both columns; a surname that was nothing else is taken from the last word of the forename.
    """
    first = N.without_suffix(N.folded(F.col("first")))
    last = F.coalesce(F.nullif(N.without_suffix(N.folded(F.col("last"))), F.lit("")), F.element_at(F.split(first, " "), -1))
    f = filings.select("filing_id", last.alias("f_last"), _word(first).alias("f_first"), F.lit(None).cast("int").alias("seat"))
    x = keyed_crosswalk(crosswalk).filter(F.col("chamber") == chamber)
    x = x if served_since is None else x.filter(F.col("last_term_end_year") >= served_since)
    word = F.col("f_first")
    alike = (word != "") & (F.col("k_first").startswith(word) | word.startswith(F.col("k_first")) | F.coalesce(F.col("k_nick") == word, F.lit(False)))
    told = f.join(x, F.col("f_last") == F.col("k_last")).groupBy("filing_id").agg(_one(F.lit(True)).alias("t1"), _one(alike).alias("t2"))
    one = F.coalesce("t1", "t2")
    some = told.withColumn("some", F.lit(True))
    return filings.select("filing_id").join(some, "filing_id", "left").select("filing_id", one.alias("bioguide"), F.when(one.isNotNull(), "matched").when(F.col("some"), "ambiguous").otherwise("not_found").alias("resolution"))


def senate_people(filings: DataFrame, crosswalk: DataFrame, served_since: int | None = None) -> DataFrame:
    """filing_id, member_id, display, state of search results (filing_id, last, first, display): the person's name and state in the crosswalk, else the name as filed and no state."""
    found = resolve_in_chamber(filings, crosswalk, "senate", served_since)
    people = crosswalk.filter("chamber = 'senate'").groupBy("bioguide").agg(F.min_by(F.struct("first", "last", "state"), F.struct(-F.col("last_term_end_year"), "state")).alias("p"))
    joined = filings.join(found, "filing_id").join(people, "bioguide", "left")
    return joined.select(
        "filing_id", F.coalesce("bioguide", N.fallback_id(F.col("last"), F.col("first"))).alias("member_id"), F.coalesce(F.concat_ws(" ", "p.first", "p.last"), F.col("display")).alias("named"), F.col("p.state").alias("state"), F.col("bioguide").isNull().alias("_unknown"), "display"
    ).select("filing_id", "member_id", F.when(F.col("_unknown"), F.col("display")).otherwise(F.col("named")).alias("display"), "state")


def member_ids(filings: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """filing_id, member_id: a known name first, then the crosswalk, then a slug of the name. known: full_name, member_id."""
    k = known.select("full_name", F.col("member_id").alias("by_name"))
    joined = filings.join(k, "full_name", "left").join(resolved.select("filing_id", "bioguide"), "filing_id", "left")
    return joined.select("filing_id", F.coalesce("by_name", "bioguide", N.fallback_id(F.col("last"), F.col("first"), F.col("state"), F.col("district"))).alias("member_id"))


def attach(members: DataFrame, crosswalk: DataFrame, roster: DataFrame) -> DataFrame:
    """members with party and committees by bioguide id."""
    party = crosswalk.groupBy("bioguide").agg(F.first("party").alias("_party"))
    r = roster.select(F.col("bioguide").alias("_b"), F.col("committees").alias("_committees"))
    out = members.drop("party", "committees").join(party, members.bioguide_id == party.bioguide, "left").join(r, F.col("bioguide_id") == F.col("_b"), "left")
    return out.withColumns({"party": F.coalesce("_party", F.lit("unknown")), "committees": F.coalesce("_committees", F.array().cast("array<string>"))}).drop("bioguide", "_party", "_b", "_committees")
