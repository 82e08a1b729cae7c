"""Authors of marker lines: a left outer join with line authors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _author() -> Column:
    """The smallest author of a line, nulls last, so that repeated and contradicting rows have a defined result."""
    return F.min(F.struct(F.col("name").isNull().alias("a"), F.col("email").isNull().alias("b"), "name", "email"))


def with_authors(tasks: DataFrame, blame: DataFrame, on: Sequence[str] = ("path", "line"), column: str = "git_user") -> DataFrame:
    """``tasks`` with a nullable struct (name, email) of the line's author.

    Keeps every task once: line authors are made unique first, with map-side combining. A line
    without an author has a null struct, as has a task with a null key.
    """
    authors = blame.select(*on, "name", "email").groupBy(*on).agg(_author().alias("__a"))
    joined = tasks.drop(column).join(authors, list(on), "left")
    value = F.when(F.col("__a").isNotNull(), F.struct(F.col("__a.name").alias("name"), F.col("__a.email").alias("email")))
    return joined.withColumn(column, value).drop("__a")


def without_authors(tasks: DataFrame, blame: DataFrame, on: Sequence[str] = ("path", "line")) -> DataFrame:
    """The tasks whose line has no author."""
    return tasks.join(blame.select(*on).distinct(), list(on), "left_anti")


def beyond_authors(tasks: DataFrame, blame: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """(path, message) of the tasks in files with line authors whose line lies behind the last of them."""
    last = blame.groupBy(*on).agg(F.max("line").alias("__last"))
    message = F.concat(F.lit("no author of line "), F.col("line").cast("string"))
    return tasks.join(last, list(on)).where(F.col("line") > F.col("__last")).select("path", message.alias("message"))
