"""Appending the rounds of one event kind, and predicted labels to known ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_rounds(*rounds: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    return reduce(DataFrame.unionByName, rounds)


def union_pseudo_labels(labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Known labels plus the predictions for users that have none.

    No broadcast hint: both sides grow with the number of users, Spark picks by their size.
    """
    known = labels.filter(F.col("label").isNotNull()).select("uid", "label")
    added = predicted.select("uid", "label").join(known.select("uid"), "uid", "left_anti")
    return known.unionByName(added)
