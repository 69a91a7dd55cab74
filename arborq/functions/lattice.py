"""The sixteen verdicts as four-bit masks: order, meet, join, implication, names, medals, preferences.

Bits: simple 1, composable 2, secure 4, navigable 8. All functions take and return integer columns.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PILLARS = ("simple", "composable", "secure", "navigable")
BITS = {p: 1 << i for i, p in enumerate(PILLARS)}
TOP = 15
#: Fixed order in which pillars are preferred without a stated ranking.
DEFAULT_RANKING = ("simple", "navigable", "secure", "composable")


def leq(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) == a


def meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def join(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def negation(a: Column) -> Column:
    return F.lit(TOP) - a


def implies(a: Column, b: Column) -> Column:
    """The largest c with meet(a, c) below b."""
    return negation(a).bitwiseOR(b)


def equivalent(a: Column, b: Column) -> Column:
    return implies(a, b).bitwiseAND(implies(b, a)) == TOP


def aggregate_meet(mask: Column) -> Column:
    """Of a group; the empty group is at the top."""
    return F.coalesce(F.bit_and(mask), F.lit(TOP))


def satisfied(mask: Column) -> Column:
    return F.bit_count(mask)


#: By how many pillars hold, the tier, its symbol and what it stands for.
TIERS = (
    ("SLOP", "❌", ""),
    ("BRONZE", "🥉", "One of four quality pillars satisfied"),
    ("SILVER", "🥈", "Two of four quality pillars satisfied"),
    ("GOLD", "🥇", "Three of four quality pillars satisfied"),
    ("PLATINUM", "🏆", "Joint satisfaction of all four quality pillars"),
)
NO_MEDAL = "❌ NO MEDAL - Fails every generator; unconstrained code"


def _tier(mask: Column, part: int) -> Column:
    return F.element_at(F.array(*[F.lit(t[part]) for t in TIERS]), F.bit_count(mask).cast("int") + 1)


def medal(mask: Column) -> Column:
    """The tier's name."""
    return _tier(mask, 0)


def symbol(mask: Column) -> Column:
    return _tier(mask, 1)


def name(mask: Column) -> Column:
    """Pillars that hold, in capitals, joined by _; SLOP for none and IDEAL for all."""
    parts = F.concat_ws("_", *[F.when(mask.bitwiseAND(b) != 0, F.lit(p.upper())) for p, b in BITS.items()])
    return F.when(mask == 0, "SLOP").when(mask == TOP, "IDEAL").otherwise(parts)


def description(mask: Column) -> Column:
    """Symbol, tier, meaning and name in one line."""
    line = F.concat(symbol(mask), F.lit(" "), medal(mask), F.lit(" - "), _tier(mask, 2), F.lit(" ("), name(mask), F.lit(")"))
    return F.when(mask == 0, NO_MEDAL).otherwise(line)


def preference_score(mask: Column, ranking: tuple[str, ...] = DEFAULT_RANKING) -> Column:
    """The sum of 2^(3 - rank) over the pillars that hold."""
    return sum((F.when(mask.bitwiseAND(BITS[p]) != 0, 1 << (3 - i)).otherwise(0) for i, p in enumerate(ranking)), F.lit(0))


def masks(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").cast("int").alias("mask"))


def rankings(spark: SparkSession) -> DataFrame:
    """All 24 rankings of the four pillars."""
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(permutations(PILLARS))], "ranking_id int, ranking array<string>")


def score_by(mask: Column, ranking: Column) -> Column:
    """preference_score where the ranking is a column."""
    bit = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv]), p)
    places = [F.element_at(ranking, i + 1) for i in range(len(PILLARS))]
    return sum((F.when(mask.bitwiseAND(bit(p)) != 0, 8 >> i).otherwise(0) for i, p in enumerate(places)), F.lit(0))


def total_order(spark: SparkSession, ranking: tuple[str, ...] = DEFAULT_RANKING) -> DataFrame:
    """mask, score, place: the sixteen verdicts from the most preferred."""
    out = masks(spark).withColumn("score", preference_score(F.col("mask"), ranking))
    return out.withColumn("place", (F.lit(16) - F.col("score")).cast("int"))


def relaxation_walk(spark: SparkSession, current: int, target: int = TOP, ranking: tuple[str, ...] = DEFAULT_RANKING) -> DataFrame:
    """Verdicts preferred to ``current`` up to ``target``, the best first."""
    out = masks(spark).withColumn("score", preference_score(F.col("mask"), ranking))
    value = lambda m: sum(8 >> i for i, p in enumerate(ranking) if m & BITS[p])
    return out.filter((F.col("score") > value(current)) & (F.col("score") <= value(target))).orderBy(F.desc("score"))


def fallback_target(ranking: tuple[str, ...] = DEFAULT_RANKING) -> int:
    """The join of the two pillars ranked first."""
    return BITS[ranking[0]] | BITS[ranking[1]]


def progress(score: Column, target_score: Column) -> Column:
    return F.when(target_score == 0, 1.0).otherwise(F.least(score / target_score, F.lit(1.0)))
