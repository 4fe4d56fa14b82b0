"""Turns from a table of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import Counter, count_tokens


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def turns_of(conversations: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """conv_id, turn_index, role, content, token_count; system rows are instructions and take no index."""
    said = conversations.filter("role <> 'system'")
    return said.select("conv_id", (F.row_number().over(by_turn()) - 1).cast("long").alias("turn_index"), "role", F.col("text").alias("content"), counter(F.col("text")).alias("token_count"))


def inline_instructions(conversations: DataFrame) -> DataFrame:
    """Each system message with the number of turns before it."""
    before = F.count_if(F.col("role") != "system").over(by_turn())
    return conversations.select("conv_id", "turn", "role", F.col("text").alias("content"), before.alias("turns_before")).filter("role = 'system'").drop("role")
