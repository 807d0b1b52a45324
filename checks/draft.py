"""Draft classes. The prospects of `checks.prospects`, classed by nation, as JSON records of mixed shapes; one class is the current one, and some of its members are
also in a past class with half the minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import preset as P
from tallyframe.plans import draft as D

from . import sqlbase as S
from .prospects import DAMP, PROS, prospects
from .views import r6, stage

Q, O = {}, {}
PM = P.PROSPECT_METRICS
CURRENT, PAST = 7, 3  # classes
SOME = "prospect_id % 4"  # the shape of a record: object, bare number, numeric text in an object, object with gaps
_RAW = ["ppg", "rpg", "apg", "spg", "bpg", "mpg", "gp", "fg3_pct"]


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


def payloads(spark, sf):
    def build():
        rows = prospects(spark, sf).withColumn("current", F.col("class") == CURRENT)
        older = rows.where(F.col("current") & (F.col("prospect_id") % 3 == 0)).withColumns({"current": F.lit(False), "class": F.lit(PAST).cast(rows.schema["class"].dataType), "mpg": F.col("mpg") / 2})
        rows = rows.unionByName(older)
        shape = F.col("prospect_id") % 4

        gap = lambda m: F.when((shape == 3) & F.lit(m in ("pts_per36", "mpg")), None).otherwise(F.col(m))
        boxed = lambda of: [F.struct(of(m).alias("value"), F.lit(12.5).alias("percentile")).alias(m) for m in PM]
        rest = [F.struct(*[F.when((F.col("prospect_id") % 5 != 0) | F.lit(k != "fg3_pct"), F.col(k)).alias(k) for k in _RAW]).alias("raw_stats"),
                F.concat(F.lit("p"), F.col("prospect_id").cast("string")).alias("prospect_id"), "player_name", "height", "weight", F.col("prospect_id").cast("int").alias("pick"), F.lit("wing").alias("role")]
        body = F.when(shape == 1, F.to_json(F.struct(*PM, *rest))).when(shape == 2, F.to_json(F.struct(*boxed(lambda m: F.col(m).cast("string")), *rest))).otherwise(F.to_json(F.struct(*boxed(gap), *rest)))
        payload = F.when(F.col("current"), F.concat(F.lit(f'{{"draft_class_year": {2000 + CURRENT}, "prospects": ['), body, F.lit("]}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        year = F.when(~F.col("current"), F.col("class").cast("int") + 2000)
        broken = spark.createDataFrame([(False, 1999, "{no json"), (True, None, "[]")], "current boolean, class_year int, payload string")
        return rows.select("current", year.alias("class_year"), payload.alias("payload")).unionByName(broken)
    return stage(spark, sf, "draft_payloads", build)


def scored(spark, sf):
    return stage(spark, sf, "draft_scored", lambda: D.scored_classes(D.prospect_rows(D.payload_records(payloads(spark, sf)))))


def _over(m: str, group: str = "") -> str:
    """Share at or below, in percent, among rows that have a value."""
    v = S.rounded(m)
    return f"CASE WHEN {m} IS NOT NULL THEN (cume_dist() OVER (PARTITION BY {m} IS NULL{group} ORDER BY {v})) * 100.0 END"


_OWN = {m: f"CASE WHEN {SOME} = 1 OR ({SOME} = 3 AND '{m}' IN ('pts_per36', 'mpg')) THEN NULL ELSE {m} END" for m in PM}
_ANY = {m: f"CASE WHEN {SOME} = 3 AND '{m}' = 'pts_per36' THEN NULL ELSE {m} END" for m in PM}
_AXES = P.SKILL_AXES
_MEAN = "(" + " + ".join(f"coalesce({a}_op, 0)" for a in _AXES) + ") / 6"
SCORED = f"""{PROS}, cur AS (SELECT *, class = {CURRENT} AS current FROM pros),
older AS (SELECT * REPLACE ({PAST} AS class, mpg / 2 AS mpg, false AS current) FROM cur WHERE current AND prospect_id % 3 = 0),
u AS (SELECT * FROM cur UNION ALL SELECT * FROM older),
v AS (SELECT * EXCLUDE ({', '.join(PM)}), mpg AS raw_mpg, mpg AS m0, {', '.join(f'{_ANY[m]} AS {m}, {_OWN[m]} AS own_{m}' for m in PM)} FROM u),
pc AS (SELECT *, {', '.join(f'coalesce({_over(m)}, 0.0) AS {m}_pct' for m in PM)}, 50.0 AS ast_pct_pct, 50.0 AS tov_per36_pct FROM v),
op AS (SELECT *, {', '.join(f'CASE WHEN own_{m} IS NOT NULL THEN {m}_pct END AS {m}_op' for m in PM)} FROM pc),
oq AS (SELECT *, {', '.join(f'coalesce({m}_op, 50.0) AS {m}_q' for m in PM)}, 50.0 AS ast_pct_q, 50.0 AS tov_per36_q FROM op),
sc AS (SELECT *, {S.impact('_q', '1.0')} AS pfv, {S.impact('_pct', '1.0')} AS pool_pfv FROM oq),
ad AS (SELECT *, pfv * {DAMP.replace('mpg', 'coalesce(own_mpg, 0)').replace('ts_pct', 'coalesce(own_ts_pct, 0)')} AS adjusted,
  pool_pfv * {DAMP.replace('mpg', 'coalesce(mpg, 0)').replace('ts_pct', 'coalesce(ts_pct, 0)')} AS pooled FROM sc),
pool AS (SELECT bucket, {S.rounded('pooled')} AS v FROM ad),
held AS (SELECT a.class, a.current, a.prospect_id, count(*) AS n, count(*) FILTER (p.v <= {S.rounded('a.adjusted')}) AS le, count(*) FILTER (p.v = {S.rounded('a.adjusted')}) AS eq
  FROM ad a JOIN pool p ON a.bucket = p.bucket GROUP BY ALL),
scored AS (SELECT ad.*, least(pow(CASE WHEN eq > 0 THEN le::DOUBLE / n ELSE (le + 1)::DOUBLE / (n + 1) END, 1.5) * 0.99, 0.99) AS apfv FROM ad JOIN held USING (class, current, prospect_id)),
rated AS (SELECT *, {', '.join(f'greatest(0.0, least(100.0, apfv * 100.0 + 0.75 * (coalesce({a}_op, 0) - {_MEAN}))) AS {a}_rating' for a in _AXES)},
  {', '.join(f'{k} AS raw_{k}' for k in _RAW if k not in ('mpg', 'fg3_pct'))}, CASE WHEN prospect_id % 5 <> 0 THEN fg3m / nullif(fg3a, 0) END AS raw_fg3_pct FROM scored)"""
_SHOWN = "class + 2000 AS class_year, 'p' || prospect_id AS prospect_id, player_name, '' AS team, height, weight, 'wing' AS role, prospect_id::INT AS pick"


@query("draft_list", f"""WITH {SCORED}, b AS (SELECT *, {', '.join(f'coalesce({_over("raw_" + k, ", class, current")}, 0.0) AS {k}_box' for k in _RAW)} FROM rated)
SELECT current, {_SHOWN}, round(apfv, 6) AS apfv, {', '.join(f'round(coalesce(raw_{k}, 0), 6) AS {k}, round({k}_box, 6) AS {k}_pct' for k in _RAW)},
  0.0::DOUBLE AS fg_pct, 0.0::DOUBLE AS fg_pct_pct, 0.0::DOUBLE AS ft_pct, 0.0::DOUBLE AS ft_pct_pct, {S.r(*[f'{a}_rating' for a in _AXES])} FROM b""")
def draft_list(spark, sf):
    out = D.draft_list(scored(spark, sf), every=True)
    box = [c for k in D.BOX_KEYS for c in (F.col("box_score")[k]["value"].alias(k), F.col("box_score")[k]["percentile"].alias(f"{k}_pct"))]
    return r6(out.select(*[c for c in out.columns if c not in ("box_score", "skill_ratings")], *box, *[F.col("skill_ratings")[a].alias(f"{a}_rating") for a in _AXES]))


@query("draft_detail", f"""WITH {SCORED}, f AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY prospect_id ORDER BY current DESC, class DESC) = 1)
SELECT current, {_SHOWN}, {', '.join(f'round(own_{m}, 6) AS {m}, CASE WHEN own_{m} IS NOT NULL THEN round({m}_pct, 6) END AS {m}_pct' for m in PM)},
  {', '.join(f'round(raw_{k}, 6) AS raw_{k}' for k in _RAW)}, round(pfv, 6) AS raw_pfv, round(apfv, 6) AS raw_apfv, {S.r(*[f'{a}_rating' for a in _AXES])} FROM f""")
def draft_detail(spark, sf):
    out = D.draft_detail(scored(spark, sf))
    shown = [c for m in PM for c in (F.col("metrics")[m]["value"].alias(m), F.col("metrics")[m]["percentile"].alias(f"{m}_pct"))]
    raw = [F.col("raw_stats")[k].alias(f"raw_{k}") for k in [*_RAW, "pfv", "apfv"]]
    return r6(out.select(*[c for c in out.columns if c not in ("metrics", "raw_stats", "skill_ratings")], *shown, *raw, *[F.col("skill_ratings")[a].alias(f"{a}_rating") for a in _AXES]))


@query("draft_meta", f"""WITH {PROS} SELECT {2000 + CURRENT} AS draft_class_year, array_to_string(list_sort(list_distinct(list_concat([1999], list(class + 2000) FILTER (class <> {CURRENT})))), '|') AS years FROM pros""")
def draft_meta(spark, sf):
    out = D.draft_meta(payloads(spark, sf), 1990)
    return out.select("draft_class_year", F.array_join(F.col("available_draft_years").cast("array<string>"), "|").alias("years"))
