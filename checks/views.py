"""Stage tables the queries start from."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.rates import add_rates, team_rates
from tallyframe.operators import career as C
from tallyframe.operators.pairs import similar_players
from tallyframe.operators.teams import merge_team_sources, normalize_teams
from tallyframe.session import cut_built, lasting
from tallyframe.sources import boxscore as B


_stages: dict[tuple, Any] = {}


def reset() -> None:
    """Forget the stage tables, so that the next query builds its own."""
    _stages.clear()


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame], group_bytes: int | None = None) -> DataFrame:
    """A stage table: written once per session and input, read by every query that needs it. What its build wrote on the way goes."""
    return held(spark, sf, name, lambda: cut_built(spark, build, group_bytes))


def held(spark: SparkSession, sf: str, name: str, build: Callable[[], Any]) -> Any:
    """Anything that reads stage tables and goes with them."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stages:
        _stages[key] = lasting(build)
    return _stages[key]


def box(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"box_{entity}", lambda: B.entity_seasons(spark, sf, entity))


def rates(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"rates_{entity}", lambda: add_rates(box(spark, sf, entity)))


def features(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"features_{entity}", lambda: C.normalize_seasons(rates(spark, sf, entity)))


def rolled(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"rolled_{entity}", lambda: C.roll_up(features(spark, sf, entity)))


def careers(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"careers_{entity}", lambda: C.add_labels(C.career_percentiles(rolled(spark, sf, entity))))


def players(spark, sf, entity: str = "supplier") -> DataFrame:
    """Careers with sizes and caliber: what the similarity search reads."""
    return stage(spark, sf, f"players_{entity}", lambda: C.caliber(C.fill_sizes(careers(spark, sf, entity))))


def similar(spark, sf, entity: str = "supplier") -> DataFrame:
    return stage(spark, sf, f"similar_{entity}", lambda: similar_players(players(spark, sf, entity)))


def teams(spark, sf) -> DataFrame:
    return stage(spark, sf, "teams", lambda: team_rates(merge_team_sources(*B.team_sources(spark, sf))))


def normalized_teams(spark, sf) -> DataFrame:
    return stage(spark, sf, "normalized_teams", lambda: normalize_teams(teams(spark, sf)))


def part_rates(spark, sf) -> DataFrame:
    return stage(spark, sf, "part_rates", lambda: add_rates(stage(spark, sf, "part_box", lambda: B.part_teams(spark, sf))))


def part_features(spark, sf) -> DataFrame:
    return stage(spark, sf, "part_features", lambda: C.normalize_seasons(part_rates(spark, sf)))


def r6(df: DataFrame, *skip: str) -> DataFrame:
    """Doubles to six decimals, the digits both engines agree on."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in skip
                       else F.col(f.name) for f in df.schema])


def text(column: str):
    """Array column as text."""
    return F.array_join(F.col(column), "|").alias(column)
