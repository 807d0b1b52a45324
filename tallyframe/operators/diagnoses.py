"""Strengths, weaknesses and identities of units, from rule tables evaluated as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import preset as P
from ..functions.clean import above, at_least, at_most, below

# fixed values
SKILL_OF = {"playmaking": "playmaking", "spacing": "shooting", "rebounding": "rebounding", "paint_scoring": "rim_pressure", "defense": "defense", "scoring": "scoring"}
DIM_OF = {"playmaking": "playmaking", "spacing": "spacing", "rebounding": "rebounding", "paint_scoring": "paint", "defense": "defense", "scoring": "scoring"}
CHANNEL_OF = {"playmaking": "playmaking", "spacing": "spacing", "rebounding": "interior", "paint_scoring": "interior", "defense": "defense", "overlap": "overlap"}
GATE = {"playmaking": -0.8, "spacing": -0.6, "interior": -0.3, "defense": -0.8, "overlap": -1.1}
STRENGTH_HEADS = {"playmaking": "Connective Passing", "spacing": "Floor Spacing", "rebounding": "Glass Control", "paint_scoring": "Rim Pressure", "defense": "Defensive Bite", "scoring": "Scoring Punch"}
WEAKNESS_HEADS = {"playmaking": "Limited Ball Movement", "spacing": "Spacing Concerns", "rebounding": "Undersized on the Glass", "paint_scoring": "Soft Interior Scoring", "defense": "Defensive Exposure", "scoring": "Scoring Droughts"}
BASE = 26.0
GOOD, STRONG, WEAK, RESCUE = 62.0, 72.0, 43.0, 60.0


@dataclass(frozen=True)
class Insight:
    kind: str
    trait: str
    traits: tuple[str, ...]
    when: Column
    weight: Column
    head: str


def unit_supports(members: DataFrame) -> DataFrame:
    """Best skill per trait, the lead creator, and members short on shooting volume (never the lead), per unit."""
    lead = F.max_by("id", F.struct(F.col("playmaking"), (-F.col("id")).alias("i")))
    out = members.groupBy("unit_id").agg(
        *[F.max(s).alias(f"best_{t}") for t, s in SKILL_OF.items()],
        F.when(F.max("playmaking") >= 55.0, lead).alias("lead_id"),
        F.sort_array(F.collect_list(F.when(F.col("shooting") < 50.0, F.struct("shooting", "fg3m_per36", "id")))).alias("_low"))
    others = F.filter("_low", lambda x: F.col("lead_id").isNull() | (x["id"] != F.col("lead_id")))
    return out.withColumn("low_volume_ids", F.transform(F.slice(others, 1, 2), lambda x: x["id"])).drop("_low")


def _insights() -> list[Insight]:
    dim = {t: F.col(f"dim_{d}") for t, d in DIM_OF.items()}
    best = {t: F.col(f"best_{t}") for t in SKILL_OF}
    sig = {t: F.col(f"signal_{t}") for t in SKILL_OF}
    chan = lambda t: F.col(f"channel_{CHANNEL_OF[t]}") if t in CHANNEL_OF else F.lit(0.0)
    lift = lambda a, b: BASE + 0.5 * (sig[a] - 50.0) + 0.5 * (sig[b] - 50.0)
    good = lambda t, extra=0.0: at_least(sig[t], GOOD + extra)
    out = [
        Insight("strength", "playmaking", ("playmaking", "spacing"), good("playmaking") & good("spacing", -2), lift("playmaking", "spacing"), "Drive-and-Kick Engine"),
        Insight("strength", "paint_scoring", ("paint_scoring", "spacing"), good("paint_scoring") & good("spacing"), lift("paint_scoring", "spacing"), "Inside-Out Pressure"),
        Insight("strength", "defense", ("defense", "rebounding"), good("defense") & good("rebounding"), lift("defense", "rebounding"), "Two-Way Wall"),
        Insight("strength", "scoring", ("scoring",), at_least(sig["scoring"], STRONG) & (at_least(sig["playmaking"], 53) | at_least(sig["spacing"], 53)),
                BASE + 0.6 * (sig["scoring"] - 50.0), "Shot-Making Firepower"),
        Insight("weakness", "spacing", ("spacing",), good("playmaking") & at_most(dim["spacing"], WEAK) & below(best["spacing"], RESCUE + 5),
                BASE + 0.5 * (sig["playmaking"] - 50.0) + 0.4 * (50.0 - dim["spacing"]), "Cramped Driving Lanes"),
        Insight("weakness", "rebounding", ("rebounding",), good("defense") & at_most(dim["rebounding"], WEAK) & below(best["rebounding"], RESCUE),
                BASE + 0.5 * (sig["defense"] - 50.0) + 0.4 * (50.0 - dim["rebounding"]), "Second-Chance Leak"),
        Insight("weakness", "paint_scoring", ("paint_scoring",), good("spacing", 2) & at_most(dim["paint_scoring"], 40) & below(best["paint_scoring"], RESCUE),
                BASE + 0.5 * (sig["spacing"] - 50.0) + 0.4 * (50.0 - dim["paint_scoring"]), "Jump-Shot Dependent"),
        Insight("weakness", "playmaking", ("playmaking",), (F.col("creators") >= 3) & below(sig["playmaking"], 48) & below(best["playmaking"], RESCUE + 8),
                BASE + (50.0 - sig["playmaking"]) + 3.0 * F.col("creators"), "No Lead Initiator"),
    ]
    for t in P.TRAITS:
        gate = GATE[CHANNEL_OF[t]] if t in CHANNEL_OF else -0.8
        strong = good(t) & (at_least(dim[t], 47) | at_least(best[t], 82)) & above(chan(t), gate)
        weak = (at_most(dim[t], WEAK) & below(best[t], RESCUE)) | (below(dim[t], 50) & at_most(chan(t), gate))
        minor = below(dim[t], 50) & below(best[t], 55)
        out += [
            Insight("strength", t, (t,), strong, sig[t] - 50.0, STRENGTH_HEADS[t]),
            Insight("weakness", t, (t,), ~strong & weak, (50.0 - dim[t]) + 0.25 * (RESCUE - best[t]) + F.greatest(F.lit(0.0), -chan(t)), WEAKNESS_HEADS[t]),
            Insight("weakness", t, (t,), ~strong & ~weak & minor, (50.0 - dim[t]) * 0.45, f"Minor: {WEAKNESS_HEADS[t]}"),
        ]
    overlap = F.col("channel_overlap")
    out.append(Insight("weakness", "overlap", ("overlap",), at_most(overlap, GATE["overlap"]), BASE - 4 + F.greatest(F.lit(0.0), -overlap), "Redundant Roles"))
    return out


def _band(score: Column, cuts: list[tuple[float, int]], otherwise: int) -> Column:
    chain = None
    for low, value in cuts:
        chain = F.when(at_least(score, low), value) if chain is None else chain.when(at_least(score, low), value)
    return chain.otherwise(otherwise)


def diagnose(units: DataFrame) -> DataFrame:
    """units: dim_<d>, best_<trait>, channel_<c>, synergy_score and composition counts. Adds arrays of structs strengths and
    weaknesses (trait, head) and the two identities."""
    units = units.withColumns({f"signal_{t}": 0.5 * F.col(f"dim_{DIM_OF[t]}") + 0.5 * F.col(f"best_{t}") for t in P.TRAITS})
    rows = []
    for i, x in enumerate(_insights()):
        pull = F.col(f"channel_{CHANNEL_OF[x.trait]}") if x.trait in CHANNEL_OF else F.lit(0.0)
        weight = x.weight + (1.1 * pull if x.kind == "strength" else -1.1 * pull)
        rows.append(F.when(x.when, F.struct((-weight).cast("double").alias("neg"), F.lit(i).alias("ord"), F.lit(x.kind).alias("kind"), F.lit(x.trait).alias("trait"),
                                            F.array(*map(F.lit, x.traits)).alias("traits"), F.lit(x.head).alias("head"))))
    ordered = F.array_sort(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    score = F.col("synergy_score")
    units = units.withColumns({
        "_insights": ordered,
        "_max_s": _band(score, [(70, 4), (58, 3), (46, 2), (34, 2)], 1), "_max_w": _band(score, [(70, 1), (58, 2), (46, 2), (34, 3)], 4),
        "_min_w": _band(score, [(58, 0), (46, 2), (34, 3)], 4)})
    item = "struct<trait:string,head:string>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{item}>").alias("s"), F.array().cast(f"array<{item}>").alias("w"))

    def entry(trait, head):
        return F.array(F.struct(trait.alias("trait"), head.alias("head")))

    def take(acc, r):
        free = ~F.arrays_overlap(acc["used"], r["traits"])
        s = free & (r["kind"] == "strength") & (F.size(acc["s"]) < F.col("_max_s"))
        w = free & (r["kind"] == "weakness") & (F.size(acc["w"]) < F.col("_max_w"))
        one = entry(r["trait"], r["head"])
        return F.struct(F.when(s | w, F.array_union(acc["used"], r["traits"])).otherwise(acc["used"]).alias("used"),
                        F.when(s, F.concat(acc["s"], one)).otherwise(acc["s"]).alias("s"),
                        F.when(w, F.concat(acc["w"], one)).otherwise(acc["w"]).alias("w"))

    units = units.withColumn("_got", F.aggregate("_insights", start, take))
    units = units.withColumns({"_used": F.col("_got.used"), "_s": F.col("_got.s"), "_w": F.col("_got.w")})

    # no strength: the best signal stands in
    by_signal = F.array_sort(F.array(*[F.struct((-F.col(f"signal_{t}")).alias("k"), F.lit(i).alias("o"), F.lit(t).alias("t"), F.lit(f"Relative Strength: {STRENGTH_HEADS[t]}").alias("h"))
                                       for i, t in enumerate(P.TRAITS)]))
    lead = F.get(by_signal, F.lit(0))
    none = F.size("_s") == 0
    units = units.withColumns({"_s": F.when(none, entry(lead["t"], lead["h"])).otherwise(F.col("_s")),
                               "_used": F.when(none, F.array_union("_used", F.array(lead["t"]))).otherwise(F.col("_used"))})

    # too few weaknesses for the score band: the weakest unused traits follow
    def candidates(key):
        return F.array_sort(F.array(*[F.struct(key(t).alias("k"), F.lit(i).alias("o"), F.lit(t).alias("t"), F.col(f"dim_{DIM_OF[t]}").alias("d"), F.lit(WEAKNESS_HEADS[t]).alias("h"))
                                      for i, t in enumerate(P.TRAITS)]))

    pull = lambda t: F.col(f"channel_{CHANNEL_OF[t]}") if t in CHANNEL_OF else F.lit(0.0)
    weakest = candidates(lambda t: 0.7 * F.col(f"dim_{DIM_OF[t]}") + 0.3 * F.col(f"best_{t}") + 1.5 * pull(t))
    free = F.filter(weakest, lambda c: ~F.array_contains(F.col("_used"), c["t"]))
    need = F.greatest(F.lit(0), F.col("_min_w") - F.size("_w"))
    extra = F.transform(F.filter(free, lambda c, i: i < need), lambda c: F.struct(
        c["t"].alias("trait"), F.when(below(c["d"], 50), c["h"]).otherwise(F.concat(F.lit("Secondary Concern: "), c["h"])).alias("head")))
    units = units.withColumns({"_w": F.concat("_w", extra), "_used": F.array_union("_used", F.transform(extra, lambda x: x["trait"]))})

    # still none: the lowest dimension, when it is below average
    lowest = candidates(lambda t: F.col(f"dim_{DIM_OF[t]}"))
    unused = F.filter(lowest, lambda c: ~F.array_contains(F.col("_used"), c["t"]))
    soft = F.coalesce(F.get(unused, F.lit(0)), F.get(lowest, F.lit(0)))
    last = F.when(below(soft["d"], 50), entry(soft["t"], F.concat(F.lit("Soft Spot: "), soft["h"]))).otherwise(
        entry(F.lit(None).cast("string"), F.lit("Well-Rounded")))
    units = units.withColumn("_w", F.when(F.size("_w") == 0, last).otherwise(F.col("_w")))
    out = identities(units).withColumns({"strengths": F.col("_s"), "weaknesses": F.col("_w")})
    return out.drop("_insights", "_max_s", "_max_w", "_min_w", "_got", "_used", "_s", "_w")


def identities(units: DataFrame) -> DataFrame:
    """Two best-scored play identities."""
    sig = {t: F.col(f"signal_{t}") for t in P.TRAITS}
    c, pace = F.col, F.col("dim_pace")
    helio = (c("playmakers") == 1) & (c("shooters") >= 3)
    rules = [
        (c("shooters") >= 4, "Five-Out Spacing", sig["spacing"] + 10.0),
        (helio, "Heliocentric Attack", sig["playmaking"] + sig["spacing"]),
        (~helio & (c("playmakers") >= 3), "Positionless Playmaking", sig["playmaking"] + 8.0),
        (at_least(sig["defense"], GOOD) & below(sig["scoring"], GOOD), "Defense-First Identity", sig["defense"] + (60.0 - F.least(F.lit(60.0), sig["scoring"]))),
        (at_least(sig["defense"], STRONG), "Lockdown Unit", sig["defense"] + 6.0),
        (at_least(pace, 70) & at_least(sig["scoring"], 55), "Transition Attack", pace),
        (~(at_least(pace, 70) & at_least(sig["scoring"], 55)) & at_most(pace, 35), "Grind-It-Out Halfcourt", 100.0 - pace),
        ((c("bigs") >= 2) & at_least(sig["paint_scoring"], GOOD), "Interior-Oriented", sig["paint_scoring"] + 6.0),
        (at_least(sig["paint_scoring"], GOOD) & at_least(sig["spacing"], GOOD), "Inside-Out Balance", sig["paint_scoring"] + sig["spacing"]),
    ]
    listed = F.array_sort(F.filter(F.array(*[F.when(cond, F.struct((-v).cast("double").alias("neg"), F.lit(i).alias("ord"), F.lit(n).alias("name")))
                                             for i, (cond, n, v) in enumerate(rules)]), lambda x: x.isNotNull()))
    return units.withColumns({"primary_identity": F.coalesce(F.get(listed, F.lit(0))["name"], F.lit("Balanced Lineup")),
                              "secondary_identity": F.get(listed, F.lit(1))["name"]})


def trait_list(items: Column, prefix: str) -> Column:
    """Trait keys marked as strength or weakness, in the form that games compare."""
    return F.transform(F.filter(items, lambda x: x["trait"].isNotNull()), lambda x: F.concat(F.lit(prefix), x["trait"]))


# ---- comparing with picks and swaps ----------------------------------------------------------
def grade_picks(truth: Column, picked: Column, known: Column) -> dict[str, Column]:
    """Correct, wrong and missed traits and a 0..50 grade."""
    valid = F.array_intersect(picked, known)
    correct, wrong, missed = F.array_intersect(valid, truth), F.array_except(valid, truth), F.array_except(truth, picked)
    total = F.size(correct) + F.size(missed)
    some = F.greatest(F.lit(0.0), (F.size(correct) - F.size(wrong)) / total) * 50.0
    grade = F.when(total > 0, some).when(F.size(wrong) == 0, 50.0).otherwise(0.0)
    return {"correct": correct, "wrong": wrong, "missed": missed, "grade": grade}


def trait_changes(old_s: Column, new_s: Column, old_w: Column, new_w: Column) -> dict[str, Column]:
    """What a swap gains, loses, fixes, opens and flips, in trait order."""
    order = F.array(*map(F.lit, [*P.TRAITS, "overlap"]))
    ordered = lambda c: F.array_intersect(order, c)
    up, down = F.array_intersect(old_w, new_s), F.array_intersect(old_s, new_w)
    minus = F.array_except
    return {"improved": ordered(up), "regressed": ordered(down), "gained": ordered(minus(minus(new_s, old_s), up)),
            "lost": ordered(minus(minus(old_s, new_s), down)), "fixed": ordered(minus(minus(old_w, new_w), up)),
            "opened": ordered(minus(minus(new_w, old_w), down))}


def roster_grade(delta: Column, best: Column) -> Column:
    """0..50 share of the best possible swap; where no swap helps, standing still is full marks."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(50.0), F.try_divide(delta, best) * 50.0))
    return F.when(best > 0.001, share).when(delta >= -0.001, 50.0).otherwise(0.0)
