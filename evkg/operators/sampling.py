"""Repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_of(key: str, seed: int) -> Column:
    """A hash of key and seed that other engines have, too."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def top(df: DataFrame, group: str, orders: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the rank is limited before its shuffle."""
    w = Window.partitionBy(group).orderBy(*orders)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def checked(relations: DataFrame, sense: str, n: int, holds: Column, seed: int = 0) -> DataFrame:
    """``n`` relations of each sense, of those whose sentences ``holds`` still yields them for."""
    return per_group(relations.where(holds), sense, "rid", n, seed)


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, those with the smallest hash of their key; the rank is limited before its shuffle."""
    w = Window.partitionBy(group).orderBy(order_of(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def some(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(order_of(key, seed), key).limit(n)
