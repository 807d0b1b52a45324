"""Units compared with all historical units, and the choice of a varied few.

A task compares a block of targets with a block of history in numpy; only the best rows per target leave it. The
varied choice needs up to eight rounds, each a new pass with the units chosen so far on the target row."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import preset as P
from ..functions.clean import season_decade
from ..session import cut_lineage
from .attach import attach_row

PERMS = np.array(list(permutations(range(5))))
LIMIT = 8
DECADES = ["1990s", "2000s", "2010s", "2020s"]


def unit_sides(members: DataFrame, shape: DataFrame, edges: DataFrame | None, roles: DataFrame | None) -> DataFrame:
    """One row per unit. members: unit_id, player_id. shape: unit_id, team_id, season, role_vector, style, win_pct. edges: player_id,
    similar_id, similarity_score. roles: player_id, role. The arrays hold five members, and the lists of their neighbours."""
    rows = members.select("unit_id", "player_id")
    if edges is not None:
        lists = edges.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("similar_id", "similarity_score"))).alias("near"))
        rows = rows.join(lists, "player_id", "left")
    else:
        rows = rows.withColumn("near", F.lit(None).cast("map<bigint,double>"))
    rows = rows.join(roles, "player_id", "left") if roles is not None else rows.withColumn("role", F.lit(None).cast("string"))
    five = rows.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(
        "player_id", "role", F.map_keys("near").alias("ids"), F.map_values("near").alias("vals")))).alias("m"))
    pick = lambda c: F.transform("m", lambda x: x[c])
    five = five.select("unit_id", pick("player_id").alias("ids"), pick("role").alias("roles"), pick("ids").alias("near_ids"), pick("vals").alias("near_vals"))
    return shape.join(five, "unit_id").withColumn("decade", season_decade(F.col("season"))).where(F.size("ids") == 5)


def member_similarity(q: pd.DataFrame, h: pd.DataFrame) -> np.ndarray:
    """Similarity of every target player to every historical player: list score, else same role, else little; nothing if no player
    has either."""
    def side(df):
        out = {}
        for ids, roles, near, vals in zip(df["ids"], df["roles"], df["near_ids"], df["near_vals"]):
            for pid, role, n, v in zip(ids, roles, near, vals):
                out.setdefault(pid, (role, {} if n is None else dict(zip(n, v))))
        return out

    left, right = side(q), side(h)
    li, ri = {p: i for i, p in enumerate(left)}, {p: i for i, p in enumerate(right)}
    lr = np.array([r or "" for r, _ in left.values()], dtype=object)
    rr = np.array([r or "" for r, _ in right.values()], dtype=object)
    known = any(role or near for role, near in [*left.values(), *right.values()])
    s = np.where((lr[:, None] == rr[None, :]) & (lr[:, None] != ""), 0.35, 0.15 if known else 0.0)
    for p, (_, near) in right.items():
        for o, v in near.items():
            if o in li:
                s[li[o], ri[p]] = v / 100.0
    for p, (_, near) in left.items():
        for o, v in near.items():
            if o in ri:
                s[li[p], ri[o]] = v / 100.0
    a = np.array([[li[x] for x in ids] for ids in q["ids"]])
    b = np.array([[ri[x] for x in ids] for ids in h["ids"]])
    return s, a, b


def compare_units(q: pd.DataFrame, h: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Similarity 0..100 and the number of shared members, target by history."""
    s, a, b = member_similarity(q, h)
    qi, hi = np.stack(q["ids"].to_numpy()), np.stack(h["ids"].to_numpy())
    qr, hr = np.stack(q["role_vector"].to_numpy()), np.stack(h["role_vector"].to_numpy())
    qs, hs = np.stack(q["style"].to_numpy()), np.stack(h["style"].to_numpy())
    weights = np.array(P.STYLE_AFFINITY_WEIGHTS)
    won = h["win_pct"].to_numpy(dtype=float)
    norms = np.linalg.norm(hr, axis=1)
    total, shared = np.empty((len(q), len(h))), np.empty((len(q), len(h)), dtype=int)
    force = 10.0  # shared members are matched with each other before anything else
    for i in range(len(q)):
        w = s[a[i]][:, b].transpose(1, 0, 2)
        same = qi[i][None, :, None] == hi[:, None, :]
        overlap = same.sum(axis=(1, 2))
        w = np.where(same, 1.0 + force, w)
        best = np.zeros(len(h))
        for start in range(0, len(h), 512):
            part = w[start:start + 512]
            best[start:start + 512] = part[:, np.arange(5)[None, :], PERMS].sum(axis=2).max(axis=1)
        player = (best - force * overlap) / 5.0
        norm = np.linalg.norm(qr[i]) * norms
        role = np.divide(hr @ qr[i], norm, out=np.zeros(len(h)), where=norm > 0)
        gap = hs - qs[i]
        style = np.maximum(0.0, 1.0 - np.sqrt((gap * gap * weights).sum(axis=1) / weights.sum()) / 0.78)
        quality = np.where(np.isfinite(won), np.maximum(0.0, 1.0 - np.abs(won - q["win_pct"].iloc[i]) / 0.52), 0.70)
        share = np.minimum(0.55, 0.12 + 0.10 * overlap + 0.22 * np.maximum(0.0, player - 0.35))
        base = share * player + (1.0 - share) * (0.54 * style + 0.26 * role + 0.20 * quality)
        lift = np.where(player >= 0.6, ((player - 0.6) / 0.4) ** 2, 0.0)
        mixed = base + lift * (player - base)
        mixed = np.where(overlap >= 2, np.minimum(1.0, mixed + 0.045 * (overlap - 1)), mixed)
        total[i], shared[i] = mixed * 100.0, overlap
    return total, shared


def _grid(targets: DataFrame, history: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    size = targets.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / float(rows))).alias("nq"))
    size = attach_row(size, history.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / float(rows))).alias("nh")))
    spread = lambda df, own, other, tag, cross: attach_row(df, size).withColumn(tag, F.pmod(F.xxhash64("unit_id"), own)).withColumn(
        cross, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("nq", "nh")
    return spread(targets, "nq", "nh", "qb", "hb"), spread(history, "nh", "nq", "hb", "qb")


FOUND = "unit_id string, kind string, key string, team_id bigint, decade string, starters array<bigint>, overlap int, similarity double, score double"


def _pass(targets: DataFrame, history: DataFrame, emit, rows: int) -> DataFrame:
    left, right = _grid(targets, history.toDF(*history.columns), rows)

    def run(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(h):
            h = h.sort_values("unit_id").reset_index(drop=True)
            sim, shared = compare_units(q, h)
            for i in range(len(q)):
                for kind, j, score in emit(q.iloc[i], h, sim[i], shared[i]):
                    r = h.iloc[j]
                    out.append((q["unit_id"].iloc[i], kind, r["unit_id"], r["team_id"], r["decade"], r["ids"], int(shared[i, j]), float(sim[i, j]), float(score)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return left.groupBy("qb", "hb").cogroup(right.groupBy("qb", "hb")).applyInPandas(run, FOUND)


def _top(order: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    return order[mask[order]][:k]


def most_similar(targets: DataFrame, history: DataFrame, k: int = 10, rows: int = 512) -> DataFrame:
    """The k most similar historical units per target."""
    def emit(q, h, sim, shared):
        return [("top", j, sim[j]) for j in np.argsort(-sim, kind="stable")[:k]]

    found = _pass(targets, history, emit, rows)
    w = Window.partitionBy("unit_id").orderBy(F.col("similarity").desc(), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def varied_units(targets: DataFrame, history: DataFrame, rows: int = 512) -> DataFrame:
    """Eight units per target: near copies first, one per missing decade, then the best under diversity penalties."""
    def seeds(q, h, sim, shared):
        order = np.argsort(-sim, kind="stable")
        out = [("four", j, sim[j]) for j in _top(order, (shared >= 4) & (sim >= 78.0), 3)]
        out += [("three", j, sim[j]) for j in _top(order, (shared >= 3) & (sim >= 64.0), 5)]
        decade = h["decade"].to_numpy()
        for d in DECADES:
            out += [(d, j, sim[j]) for j in _top(order, (decade == d) & (sim >= 58.0), 1)]
        return out

    item = "struct<neg:double,key:string,team_id:bigint,decade:string,starters:array<bigint>>"
    found = _pass(targets, history, seeds, rows)
    w = Window.partitionBy("unit_id", "kind").orderBy(F.col("similarity").desc(), "key")
    keep = F.when(F.col("kind") == "four", 3).when(F.col("kind") == "three", 5).otherwise(1)
    found = found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)  # at most 12 per target
    entry = F.struct((-F.col("similarity")).alias("neg"), "key", "team_id", "decade", "starters")
    seeds_by = found.groupBy("unit_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in ("four", "three", *DECADES)])
    none = F.array().cast(f"array<{item}>")
    state = targets.join(seeds_by, "unit_id", "left")
    chosen = F.coalesce("four", none)

    def add(acc, items, limit):
        fresh = F.filter(F.coalesce(items, none), lambda x: ~F.exists(acc, lambda y: y["key"] == x["key"]))
        return F.concat(acc, F.filter(fresh, lambda x, i: i < F.greatest(F.lit(0), F.lit(limit) - F.size(acc))))

    state = state.withColumn("chosen", chosen)
    state = state.withColumn("chosen", add(F.col("chosen"), F.col("three"), 5))
    for d in DECADES:
        state = state.withColumn("chosen", F.when(F.exists("chosen", lambda x: x["decade"] == d), F.col("chosen")).otherwise(
            add(F.col("chosen"), F.col(d), LIMIT)))
    state = cut_lineage(state.select(*targets.columns, F.to_json("chosen").alias("picked"), "chosen"))

    def best_next(q, h, sim, shared):
        picked = q["picked_rows"]
        taken = {p["key"] for p in picked}
        teams, decades = h["team_id"].to_numpy(), h["decade"].to_numpy()
        score = sim.copy()
        for p in picked:
            score -= 5.0 * (teams == p["team_id"]) + 3.0 * (decades == p["decade"])
        members = np.stack(h["ids"].to_numpy())
        close = np.zeros(len(h), dtype=bool)
        for p in picked:
            close |= np.isin(members, p["starters"]).sum(axis=1) >= 4
        score = score - 4.0 * close + 6.0 * (shared >= 3)
        score[h["unit_id"].isin(taken).to_numpy()] = -np.inf
        order = np.lexsort((h["unit_id"].to_numpy().astype(str), -sim, -score))
        j = int(order[0])
        return [("next", j, score[j])] if np.isfinite(score[j]) else []

    import json

    def with_rows(q, h, sim, shared):
        q = q.copy()
        q["picked_rows"] = json.loads(q["picked"])
        return best_next(q, h, sim, shared)

    for _ in range(LIMIT):
        short = state.where(F.size("chosen") < LIMIT)
        if short.isEmpty():
            break
        found = _pass(short.drop("chosen"), history, with_rows, rows)
        w = Window.partitionBy("unit_id").orderBy(F.col("score").desc(), F.col("similarity").desc(), "key")
        pick = found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("unit_id", entry.alias("pick"))
        state = state.join(pick, "unit_id", "left").withColumn("chosen", F.when(
            F.col("pick").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("pick"))))
        state = cut_lineage(state.select(*targets.columns, F.to_json("chosen").alias("picked"), "chosen"))
    out = state.select("unit_id", F.explode(F.sort_array("chosen")).alias("c"))
    w = Window.partitionBy("unit_id").orderBy("c.neg", "c.key")
    return out.select("unit_id", "c.key", "c.team_id", "c.decade", (-F.col("c.neg")).alias("similarity"), F.row_number().over(w).alias("place"))


def swap_candidates(units: DataFrame, roster: DataFrame) -> DataFrame:
    """Every single swap: one member out, one roster player in who is not a member. units: unit_id, season, player_id;
    roster: unit_id, player_id, row_season. Returns member rows of the candidate units."""
    incoming = roster.join(units.select("unit_id", "player_id"), ["unit_id", "player_id"], "left_anti").select(
        "unit_id", F.col("player_id").alias("in_id"), F.col("row_season").alias("in_season"))
    # five members per unit
    five = units.groupBy("unit_id", "season").agg(F.sort_array(F.collect_list("player_id")).alias("ids"))
    pairs = five.join(incoming, "unit_id").select("*", F.explode("ids").alias("out_id"))
    cand = pairs.withColumn("cand_id", F.concat_ws(">", "unit_id", F.col("out_id").cast("string"), F.col("in_id").cast("string")))
    member = F.explode(F.transform("ids", lambda x: F.when(x == F.col("out_id"), F.struct(F.col("in_id").alias("p"), F.col("in_season").alias("s")))
                                   .otherwise(F.struct(x.alias("p"), F.col("season").alias("s"))))).alias("m")
    return cand.select(F.col("unit_id").alias("base_id"), F.col("cand_id").alias("unit_id"), "season", "out_id", "in_id", member).select(
        "base_id", "unit_id", "season", "out_id", "in_id", F.col("m.p").alias("player_id"), F.col("m.s").alias("row_season"))
