"""Relational analysis of schools, salaries and player careers.

Inputs: schools(player_id, school_id, year), school_details(school_id, name),
salaries(team_id, player_id, year, salary), players(player_id, name,
birth_year, birth_month, birth_day, debut, final_game, bats, height, weight).
Dimension joins carry no hint: Spark broadcasts them by their known size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.order import global_row_number, ntile_bucket
from ledgerlens.functions.scalars import birth_date, completed_years, decade
from ledgerlens.operators.clean import between_year_filter


def distinct_by_decade(schools: DataFrame) -> DataFrame:
    """Number of distinct schools per decade."""
    return (
        schools.groupBy(decade("year").alias("decade"))
        .agg(F.count_distinct("school_id").alias("num_schools"))
        .orderBy("decade")
    )


def left_join_dimension(schools: DataFrame, details: DataFrame) -> DataFrame:
    return schools.join(details, "school_id", "left")


def top_schools(schools: DataFrame, details: DataFrame, n: int = 5) -> DataFrame:
    """Schools with the most distinct players; names are joined to the n winners only."""
    counted = schools.groupBy("school_id").agg(F.count_distinct("player_id").alias("num_players"))
    best = counted.orderBy(F.desc("num_players"), "school_id").limit(n)
    return best.join(details, "school_id", "left").select("school_id", "name", "num_players")


def top_schools_per_decade(schools: DataFrame, details: DataFrame, n: int = 3) -> DataFrame:
    """Schools ranked 1..n by players within each decade, ties kept."""
    counted = schools.groupBy(decade("year").alias("decade"), "school_id").agg(
        F.count_distinct("player_id").alias("num_players"))
    rank = F.dense_rank().over(Window.partitionBy("decade").orderBy(F.desc("num_players")))
    best = counted.withColumn("place", rank).where(F.col("place") <= n)
    return best.join(details, "school_id", "left").select("decade", "school_id", "name", "num_players", "place")


def team_year_spend(salaries: DataFrame) -> DataFrame:
    return salaries.groupBy("team_id", "year").agg(F.sum("salary").alias("total_spend"))


def avg_annual_spend(salaries: DataFrame) -> DataFrame:
    return team_year_spend(salaries).groupBy("team_id").agg(F.avg("total_spend").alias("avg_spend"))


def top_quintile_teams(salaries: DataFrame, tiles: int = 5) -> DataFrame:
    """Teams in the first of five equal groups by average annual spending."""
    ranked = global_row_number(avg_annual_spend(salaries), [F.desc("avg_spend"), "team_id"], "place")
    n = ranked.select(F.count("*")).scalar()
    return ranked.where(ntile_bucket(F.col("place"), n, tiles) == 1).select(
        "team_id", F.round(F.col("avg_spend") / 1_000_000, 1).alias("avg_spend_millions"))


def _running_spend(salaries: DataFrame) -> DataFrame:
    # one row per team and year: a team's window is as long as its number of seasons
    by_year = Window.partitionBy("team_id").orderBy("year")
    return team_year_spend(salaries).withColumn("cumulative", F.sum("total_spend").over(by_year))


def cumulative_spend(salaries: DataFrame) -> DataFrame:
    return _running_spend(salaries).select(
        "team_id", "year", F.round(F.col("cumulative") / 1_000_000, 1).alias("cumulative_sum_millions"))


def first_year_over_threshold(salaries: DataFrame, threshold: float = 1e9, unit: float = 1e9) -> DataFrame:
    """First year in which a team's running total exceeds the threshold."""
    over = _running_spend(salaries).where(F.col("cumulative") > threshold)
    first = over.groupBy("team_id").agg(F.min(F.struct("cumulative", "year")).alias("hit"))
    return first.select(
        "team_id", F.col("hit.year").alias("year"),
        F.round(F.col("hit.cumulative") / unit, 2).alias("cumulative_sum"))


def career_ages(players: DataFrame) -> DataFrame:
    """Completed years of age at debut and final game, and career length."""
    born = birth_date("birth_year", "birth_month", "birth_day")
    return players.select(
        "player_id", "name",
        completed_years(born, "debut").alias("starting_age"),
        completed_years(born, "final_game").alias("ending_age"),
        completed_years("debut", "final_game").alias("career_length"),
    )


def career_sort(players: DataFrame) -> DataFrame:
    return career_ages(players).orderBy(F.desc("career_length"), "player_id")


def join_first_last_season(players: DataFrame, salaries: DataFrame) -> DataFrame:
    """Team of each player's first and last season (one row per matching pair)."""
    season = salaries.select("player_id", "year", "team_id")
    start = season.select("player_id", F.col("year").alias("starting_year"), F.col("team_id").alias("starting_team"))
    end = season.select("player_id", F.col("year").alias("ending_year"), F.col("team_id").alias("ending_team"))
    span = players.select(
        "player_id", "name", F.year("debut").alias("starting_year"), F.year("final_game").alias("ending_year"))
    return span.join(start, ["player_id", "starting_year"]).join(end, ["player_id", "ending_year"]).select(
        "player_id", "name", "starting_year", "starting_team", "ending_year", "ending_team")


def same_start_end_team(players: DataFrame, salaries: DataFrame, longer_than: int = 10) -> DataFrame:
    """Players whose first and last team agree, more than ``longer_than`` years apart."""
    return join_first_last_season(players, salaries).where(
        (F.col("starting_team") == F.col("ending_team"))
        & (F.col("ending_year") - F.col("starting_year") > longer_than))


def group_concat(players: DataFrame, first_year: int = 1980, last_year: int = 1990) -> DataFrame:
    """Names sharing a birth date, comma separated in name order: one row per date, whatever its size."""
    born = players.select(birth_date("birth_year", "birth_month", "birth_day").alias("birthdate"), "name")
    kept = between_year_filter(born, "birthdate", first_year, last_year)
    return kept.groupBy("birthdate").agg(
        F.expr("listagg(name, ', ') within group (order by name)").alias("players")).orderBy("birthdate")


def select_distinct(players: DataFrame, salaries: DataFrame) -> DataFrame:
    """Distinct (team, player) pairs with the player's batting side.

    Pairs are reduced before the join, so the join sees no repeated seasons.
    """
    pairs = salaries.select("team_id", "player_id").distinct()
    return pairs.join(players.select("player_id", "bats"), "player_id", "left").select("team_id", "player_id", "bats")


def pivot_share(players: DataFrame, salaries: DataFrame) -> DataFrame:
    """Percent of a team's players batting right, left and both."""
    def pct(side: str):
        return F.round(F.count_if(F.col("bats") == side) / F.count("player_id") * 100, 1)

    return select_distinct(players, salaries).groupBy("team_id").agg(
        pct("R").alias("bats_right"), pct("L").alias("bats_left"), pct("B").alias("bats_both"))


def decade_over_decade_diff(players: DataFrame) -> DataFrame:
    """Change of average height and weight between debut decades."""
    avgs = (
        players.where(F.col("debut").isNotNull())
        .groupBy(decade(F.year("debut")).alias("decade"))
        .agg(F.avg("height").alias("h"), F.avg("weight").alias("w"))
    )
    order = Window.orderBy("decade")  # one row per decade
    return avgs.select(
        "decade",
        (F.col("h") - F.lag("h").over(order)).alias("height_diff"),
        (F.col("w") - F.lag("w").over(order)).alias("weight_diff"),
    )
