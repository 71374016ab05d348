"""Threats told by the traits they share, against the plain count per threat."""

from pyspark.sql import functions as F

from seqtide.plans import sets as st

EVENTS = [(1, 2), (1, 3), (2, 1), (3, 1), (3, 2), (3, 2), (4, 1), (9, 1), (2, None)]
LINES = [(1, 10), (1, 20), (2, 11), (2, 21), (2, 22), (3, 12), (3, 22), (4, 21), (4, 21), (4, None)]
THREATS = [(10, 1), (11, 1), (12, 2), (12, 2), (13, 3), (10, 2), (None, 1), (14, None)]
ANSWERS = [(1, 20, "hard"), (1, 21, "soft"), (1, 22, "soft"), (2, 22, "soft"), (2, 21, "soft"), (4, 20, "hard")]


def frames(spark):
    events = spark.createDataFrame(EVENTS, "deck long, opp_deck long")
    lines = spark.createDataFrame(LINES, "deck long, item long")
    return events, lines, spark.createDataFrame(THREATS, "threat long, trait long"), spark.createDataFrame(ANSWERS, "trait long, item long, kind string")


def plain(threats, answers):
    """threat -> (vulnerable, vulnerable_met, safe, safe_met), by loops."""
    decks = {d: {i for e, i in LINES if e == d} for d, _ in LINES}
    played = [(a, b) for a, b in EVENTS if a in decks and b in decks]
    rows = [(t, i, k) for t, x in threats for y, i, k in answers if x is not None and x == y]
    out = {}
    for t in {t for t, _, _ in rows}:
        kinds = {d: [k for u, i, k in rows if u == t and i in held] if t is not None else [] for d, held in decks.items()}
        safe = {d for d, ks in kinds.items() if "hard" in ks or ks.count("soft") >= 2}
        meets = lambda b: t is not None and t in decks[b]  # noqa: E731, B023
        out[t] = tuple(sum(1 for a, b in played if (a in safe) == s and (meets(b) or not m)) for s in (False, True) for m in (False, True))
    return out


def test_threats_by_trait_equal_the_plain_count(spark):
    events, lines, threats, answers = frames(spark)
    want = plain(THREATS, ANSWERS)
    by_trait = st.threat_encounters(events, lines, threats, answers)
    by_item = st.threat_encounters(events, lines, threats.join(answers, "trait").drop("trait"))
    for got in (by_trait, by_item):
        assert {r["threat"]: (r["vulnerable"], r["vulnerable_met"], r["safe"], r["safe_met"]) for r in got.collect()} == want


def test_decks_are_told_by_group(spark):
    """A thousand threats of one trait are one group: a deck's answers are counted once and not a thousand times."""
    member, traits = st.threat_groups(spark.range(1000).select(F.col("id").alias("threat"), F.lit(5).alias("trait")))
    assert [tuple(r) for r in traits.collect()] == [(0, 5, 1)]
    assert member.count() == 1000 and member.select("group").distinct().count() == 1
