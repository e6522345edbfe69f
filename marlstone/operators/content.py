"""Operators on posts and points: tags, listings, map markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_counts(posts: DataFrame, tags: str = "tags") -> DataFrame:
    """tag, posts: how many posts carry each tag. A tag may hold a comma; null and empty lists count nowhere."""
    return posts.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("posts"))


def tag_posts(posts: DataFrame, key: str, title: str, tags: str = "tags") -> DataFrame:
    """tag, key, title: one row for each post of each tag, posts without a title left out. Long lists stay rows."""
    return posts.where(F.col(title).isNotNull()).select(F.explode(tags).alias("tag"), key, title)


def sorted_tags(posts: DataFrame, tags: str = "tags") -> DataFrame:
    """tag_counts in the tags' order of characters."""
    return tag_counts(posts, tags).orderBy("tag")


def listing(posts: DataFrame, project: bool | None = None, flag: str = "project") -> DataFrame:
    """Posts without a project flag (None), or those where it is true."""
    return posts.where(F.col(flag).isNull() if project is None else F.coalesce(F.col(flag), F.lit(False)))


def newest_first(posts: DataFrame, date: str, tie: str) -> DataFrame:
    """Posts by date, the latest first; those without a date last; ties by `tie`."""
    return posts.orderBy(F.desc_nulls_last(date), tie)


def points(df: DataFrame, x: Column, y: Column, hue: Column) -> DataFrame:
    """x, y, hue: a row a point of a scatter plot; points without a place are left out, those without a hue stay."""
    return df.select(x.alias("x"), y.alias("y"), hue.alias("hue")).where("x is not null and y is not null")


def marker(df: DataFrame, lat: Column, lon: Column, name: Column, place: Column, hot: Column) -> DataFrame:
    """lat, lon, tooltip, color, radius of each row; null names and places are empty in the tooltip."""
    text = F.concat_ws(" - ", F.coalesce(name, F.lit("")), F.coalesce(place, F.lit("")))
    return df.select(lat.alias("lat"), lon.alias("lon"), text.alias("tooltip"), F.when(hot, "brown").otherwise("green").alias("color"), F.when(hot, 3).otherwise(2).alias("radius"))
