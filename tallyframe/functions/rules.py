"""Ordered rule ladders. z is a dict of z-score columns keyed by metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import preset as P
from .clean import above, at_least, at_most, below

Z = dict[str, Column]


def zcols(suffix: str = "_z", metrics=P.METRICS) -> Z:
    return {m: F.coalesce(F.col(f"{m}{suffix}"), F.lit(0.0)) for m in metrics}


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    head, *rest = rules
    chain = F.when(head[0], head[1])
    for cond, label in rest:
        chain = chain.when(cond, label)
    return chain.otherwise(otherwise)


def hits(rules: list[tuple[Column, str]], limit: int | None = None) -> Column:
    found = F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in rules]), lambda x: x.isNotNull())
    return found if limit is None else F.slice(found, 1, limit)


def archetypes(z: Z) -> Column:
    """At most three labels, in rule order; two weak labels stand in when no rule holds."""
    main = hits([
        (above(z["pts_per36"], 0.9) & above(z["ast_per36"], 0.7), "high-volume creator"),
        (above(z["fg3a_rate"], 0.8) & above(z["efg_pct"], 0.2), "perimeter scorer"),
        (above(z["fta_rate"], 0.8) & above(z["pts_per36"], 0.4), "free-throw pressure scorer"),
        (above(z["ast_per36"], 0.8) & below(z["tov_per36"], 0.5), "table setter"),
        (above(z["efg_pct"], 0.8) & below(z["pts_per36"], 0.6), "efficient finisher"),
        (above(z["blk_per36"], 0.9) & above(z["reb_per36"], 0.4), "rim protection"),
        (above(z["stl_per36"], 0.8) & above(z["fg3a_rate"], 0.2), "3-and-D profile"),
        (above(z["reb_per36"], 0.9), "rebounding defender"),
        (above(z["stl_per36"], 0.75) | above(z["blk_per36"], 0.75), "event creator"),
    ], 3)
    weak = hits([
        (above(z["pts_per36"], 0.0) | above(z["ast_per36"], 0.0), "balanced scorer"),
        (above(z["reb_per36"], 0.0) | above(z["blk_per36"], 0.0) | above(z["stl_per36"], 0.0),
         "box-score defender"),
    ])
    both = F.array(F.lit("balanced scorer"), F.lit("box-score defender"))
    return F.when(F.size(main) > 0, main).when(F.size(weak) > 0, weak).otherwise(both)


def has_archetype(labels: Column, wanted: str) -> Column:
    def plain(c):
        return F.regexp_replace(F.lower(c), "-", " ")

    return F.exists(labels, lambda x: plain(x) == wanted.lower().replace("-", " "))


def _shared_tail(z: Z, big: Column, blk_reb: float) -> list[tuple[Column, str]]:
    return [
        (above(z["fg3a_rate"], 0.8) & above(z["efg_pct"], -0.5), "Perimeter Specialist"),
        (above(z["fta_rate"], 0.5) & above(z["pts_per36"], 0.0), "Rim Attacker"),
        ((above(z["stl_per36"], 0.5) | above(z["blk_per36"], 0.5)) & below(z["pts_per36"], -0.2),
         "Defensive Specialist"),
        (big & below(z["fg3a_rate"], -0.2), "Interior Presence"),
        (above(z["blk_per36"], 1.0) & above(z["reb_per36"], blk_reb) & below(z["fg3a_rate"], 0.0),
         "Interior Presence"),
        (big, "Interior Presence"),
        (above(z["fg3a_rate"], 0.3), "Perimeter Specialist"),
        (above(z["ast_per36"], 0.0), "Secondary Creator"),
        (above(z["pts_per36"], 0.0), "Rim Attacker"),
    ]


def _is_big(z: Z) -> Column:
    return (above(z["reb_per36"], 0.8) | above(z["blk_per36"], 0.8)) & below(z["fg3a_rate"], -0.6)


def player_role(z: Z) -> Column:
    return first_of([
        (above(z["ast_per36"], 1.0) & above(z["ast_pct"], 0.8), "Playmaker"),
        (above(z["pts_per36"], 1.0) & below(z["ast_pct"], 0.6), "Designated Scorer"),
        (above(z["ast_per36"], 0.3) & (above(z["pts_per36"], 0.2) | above(z["ast_pct"], 0.3)),
         "Secondary Creator"),
        *_shared_tail(z, _is_big(z), 0.8),
    ], "Defensive Specialist")


def prospect_role(z: Z) -> Column:
    """The prospect ladder; z is taken within the class with the sample deviation."""
    big = _is_big(z)
    return first_of([
        (above(z["ast_per36"], 1.0) & ~big, "Playmaker"),
        (above(z["pts_per36"], 0.8) & below(z["ast_per36"], 0.5), "Designated Scorer"),
        (above(z["ast_per36"], 0.3), "Secondary Creator"),
        *_shared_tail(z, big, 0.5),
    ], "Defensive Specialist")


def unit_roles(z: Z) -> Column:
    """At most two roles from three independent ladders (creation, shot mix, inside and defense)."""
    creation = (
        F.when(above(z["ast_per36"], 0.8) & above(z["ast_pct"], 0.6), "Playmaker")
        .when(above(z["pts_per36"], 0.8) & below(z["ast_pct"], 0.4), "Designated Scorer")
        .when(above(z["ast_per36"], 0.2) & above(z["pts_per36"], 0.0), "Secondary Creator")
    )
    shots = F.when(above(z["fg3a_rate"], 0.6), "Perimeter Specialist").when(
        above(z["fta_rate"], 0.5) & above(z["pts_per36"], 0.0), "Rim Attacker")
    inside = (above(z["reb_per36"], 0.7) | above(z["blk_per36"], 0.7)) & below(z["fg3a_rate"], -0.4)
    guard = (above(z["stl_per36"], 0.8) | above(z["blk_per36"], 0.8)) & ~inside
    found = F.slice(F.filter(F.array(
        creation, shots, F.when(inside, "Interior Presence"), F.when(guard, "Defensive Specialist"),
    ), lambda x: x.isNotNull()), 1, 2)
    weak = first_of([(above(z["pts_per36"], 0.0), "Secondary Creator"),
                     (above(z["reb_per36"], 0.0), "Interior Presence")], "Defensive Specialist")
    return F.when(F.size(found) > 0, found).otherwise(F.array(weak))


def role_scores(n: dict[str, Column]) -> dict[str, Column]:
    """Linear role scores over lineup-normalized stats (0..1): pts ast reb fg3a fg3_pct blk stl ast_fga."""
    paint = 1.0 - n["fg3a"]
    return {  # fixed weights
        "Playmaker": n["ast"] * 1.15 + n["ast_fga"] * 0.55 - n["pts"] * 0.08,
        "Secondary Creator": n["ast"] * 0.9 + n["pts"] * 0.45 + n["stl"] * 0.05,
        "Designated Scorer": n["pts"] * 1.15 - n["ast"] * 0.05,
        "Perimeter Specialist": n["fg3a"] * 0.75 + n["fg3_pct"] * 0.9 + n["pts"] * 0.1,
        "Rim Attacker": n["pts"] * 0.7 + paint * 0.4 + n["ast"] * 0.05,
        "Interior Presence": n["reb"] * 0.6 + n["blk"] * 0.9 + paint * 0.35,
        "Defensive Specialist": n["stl"] * 0.9 + n["blk"] * 0.5 + paint * 0.1,
    }


def scored_roles(scores: dict[str, Column], ast: Column, ast_norm: Column) -> Column:
    """Top role (>= .45) and a close, compatible second (>= .55 within .16); else a fallback role.
    Equal scores keep the role-list order."""
    ranked = F.array_sort(F.array(*[
        F.struct((-s).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("role"))
        for i, (name, s) in enumerate(scores.items())]))
    top = F.get(ranked, F.lit(0))
    pair = F.array(F.lit("Playmaker"), F.lit("Secondary Creator"))
    seconds = F.filter(
        F.slice(ranked, 2, len(scores)),
        lambda r: at_least(-r["neg"], 0.55)
        & at_most(r["neg"] - top["neg"], 0.16)
        & ~(F.array_contains(pair, r["role"]) & F.array_contains(pair, top["role"])),
    )
    chosen = F.concat(F.array(top["role"]), F.transform(F.slice(seconds, 1, 1), lambda r: r["role"]))
    lead = at_least(ast, 6.0) & at_least(ast_norm, 0.78) & at_least(scores["Playmaker"], 0.75)
    fallback = F.array(F.when(lead, "Playmaker").otherwise("Secondary Creator"))
    return F.when(below(-top["neg"], 0.45), fallback).otherwise(chosen)


# ---- team badges --------------------------------------------------------------
def _deep_parts(z: Z) -> Column:
    volume = at_least(z["fg3a"], 0.55) & above(z["fg3_pct"], -0.20)
    strong = at_least(z["fg3a"], 0.40) & above(z["fg3_pct"], 0.08)
    sniper = at_least(z["fg3a"], 0.25) & above(z["fg3_pct"], 0.40)
    return volume | strong | sniper


def badges(z: Z, has_accuracy: Column | None = None) -> Column:
    """Earned badges in test order. Ball movement excludes isolation."""
    accurate = F.lit(True) if has_accuracy is None else has_accuracy
    deep = F.when(accurate, _deep_parts(z)).otherwise(at_least(z["fg3a"], 0.60))
    makers = (above(z["ast_pct"], 0.58) & above(-z["tm_tov_pct"], 0.28)) | (
        above(z["ast_pct"], 0.90) & above(z["ast_to"], 0.85) & below(z["tm_tov_pct"], 0.75))
    moving = (above(z["ast_pct"], 0.50) & above(z["ast_to"], 0.20)) | (
        at_least(z["ast_to"], 0.85) & above(z["ast_pct"], -0.15))
    iso = (below(z["ast_pct"], -0.45) & above(z["off_rating"], 0.35)
           & below(z["ast_to"], 0.4) & ~moving)
    return hits([
        (above(z["pace"], 0.65), "run_and_gun"),
        (deep, "deep_threat"),
        (above(z["paint_fga"], 0.55) & below(z["fg3a"], 0.35), "paint_punishers"),
        (above(-z["def_rating"], 0.65), "defensive_wall"),
        (makers, "playmakers"),
        (below(z["pace"], -0.65), "grind_it_out"),
        (above(z["oreb_pct"], 0.70), "glass_eaters"),
        (above(z["fta_rate"], 0.70), "foul_magnets"),
        (moving, "ball_movement"),
        (iso, "iso_kings"),
    ])


def exemplar_score(badge: Column, z: Z) -> Column:
    deep = F.greatest(
        z["fg3a"] + F.greatest(F.lit(0.0), z["fg3_pct"] + 0.20),
        z["fg3a"] + z["fg3_pct"],
        z["fg3a"] * 0.5 + z["fg3_pct"] * 1.5,
    )
    table = {
        "run_and_gun": z["pace"], "deep_threat": deep,
        "paint_punishers": z["paint_fga"] - z["fg3a"], "defensive_wall": -z["def_rating"],
        "playmakers": z["ast_pct"] - z["tm_tov_pct"], "grind_it_out": -z["pace"],
        "glass_eaters": z["oreb_pct"], "foul_magnets": z["fta_rate"],
        "iso_kings": z["off_rating"] - z["ast_pct"], "ball_movement": z["ast_pct"] + z["ast_to"],
    }
    return F.coalesce(*[F.when(badge == k, v) for k, v in table.items()], F.lit(0.0))


# ---- roles renamed on read ----------------------------------------------------
def rename_roles(roles: Column, mapping: dict[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(roles, lambda r: F.coalesce(F.try_element_at(names, r), r))


# ---- unit building blocks -------------------------------------------------------
def paint_attempts(fga: Column, fg3a: Column, reb_z: Column, blk_z: Column) -> Column:
    share = (
        F.when(above(reb_z, 0.5) | above(blk_z, 0.5), 0.80)
        .when(above(F.coalesce(F.try_divide(fg3a, fga), F.lit(0.0)), 0.45), 0.30)
        .otherwise(0.45)
    )
    return F.greatest(F.lit(0.0), (fga - fg3a) * share)


def defense_score(stl: Column, blk: Column, minutes: Column, primary: Column) -> Column:
    bonus = F.when(primary == "Defensive Specialist", 1.5).when(primary == "Interior Presence", 1.0).otherwise(0.0)
    rate = F.try_divide(stl, minutes) * 36.0 + 1.2 * (F.try_divide(blk, minutes) * 36.0) + bonus
    return F.when(minutes > 0, rate).otherwise(0.0)


def three_makes(fg3m: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, F.try_divide(fg3m, minutes) * 36.0).otherwise(0.0)


def any_role(roles: Column, *names: str) -> Column:
    return F.arrays_overlap(roles, F.array(*map(F.lit, names)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
