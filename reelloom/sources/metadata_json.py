"""Search and detail answers of a metadata service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelloom.functions.scalars import year_of_date
from reelloom.functions.text import non_blank

DETAIL = """id int, title string, name string, original_title string, original_name string, release_date string, first_air_date string,
    overview string, runtime int, episode_run_time array<int>, popularity double, vote_average double, vote_count bigint,
    poster_path string, backdrop_path string, original_language string, adult boolean, genres array<struct<id:int,name:string>>"""
SEARCH = """results array<struct<id:int,title:string,name:string,original_title:string,original_name:string,release_date:string,first_air_date:string>>"""


def details(answers: DataFrame) -> DataFrame:
    """Contents from details (kind, body): films and series in one shape."""
    rows = answers.select("kind", F.from_json("body", DETAIL).alias("d")).where("d.id is not null")
    date = F.coalesce("d.release_date", "d.first_air_date")
    return rows.select(
        "kind", "d.id", F.coalesce("d.title", "d.name", F.col("d.id").cast("string")).alias("title"),
        F.coalesce("d.original_title", "d.original_name").alias("original_title"), date.alias("release_date"), year_of_date(date).alias("release_year"),
        non_blank(F.col("d.overview")).alias("overview"), F.coalesce(F.col("d.runtime"), F.get(F.col("d.episode_run_time"), F.lit(0))).alias("runtime"),
        "d.popularity", "d.vote_average", "d.vote_count", "d.poster_path", "d.backdrop_path", "d.original_language", "d.adult",
        F.transform("d.genres", lambda g: g["name"]).alias("genres"),
    )


def search_results(answers: DataFrame) -> DataFrame:
    """(kind, id, title, original_title, year) of search answers (kind, body)."""
    rows = answers.select("kind", F.explode(F.from_json("body", SEARCH)["results"]).alias("r"))
    year = year_of_date(F.coalesce("r.release_date", "r.first_air_date"))
    return rows.select("kind", "r.id", F.coalesce("r.title", "r.name").alias("title"), F.coalesce("r.original_title", "r.original_name").alias("original_title"), year.alias("year"))
