"""Explicit schemas of the model tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _I, _D, _T = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

THRESHOLDS = _struct(name=_S, lower_limit=_L)
ENTITIES = _struct(
    entity=_S, name=_S, clan=_S, rating=_L, arena=_S, rank=_S, ranked_rating=_L, wins=_L, losses=_L,
    three_crown_wins=_L, total_games=_L, account_age_s=_L, time_spent_s=_L, games_per_day=_D,
    last_updated=_T, region=_S,
)
ITEMS = _struct(item=_S, rarity=_S, type=_S, cost=_I, is_hero=_I, is_evolved=_I)
HOLDINGS = _struct(entity=_S, item=_S, level=_I, found=_I, has_evolution=_I, has_hero=_I)
EVENTS = _struct(
    event_id=_L, mode=_S, ts=_L, entity=_L, deck=_L, opponent=_L, opp_deck=_L, score_for=_L, score_against=_L,
    win=_I, change=_L, leak_for=_D, leak_against=_D, level=_D, metric=_D, metric2=_D,
)
SETS = _struct(deck=_L, archetype=_S, avg_cost=_D)
SET_ITEMS = _struct(deck=_L, item=_L, level=_D, has_evolution=_I, has_hero=_I)
SET_STATS = _struct(entity=_S, deck=_S, battles=_L, wins=_L, confidence=_D, last_updated=_T)
REPORT = _struct(test=_S, section=_S, grp=_S, n=_L, stat=_D, p=_D, verdict=_S)

# The lower limits of the rating thresholds, in order.
THRESHOLD_LIMITS = (
    0, 300, 600, 1000, 1300, 1600, 2000, 2300, 2600, 3000, 3400, 3800, 4200, 4600,
    5000, 5500, 6000, 6500, 7000, 7500, 8000, 8500, 9000, 9500, 10000, 10500, 11000, 11500,
)
