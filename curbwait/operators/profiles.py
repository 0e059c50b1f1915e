"""Profiles of trips that can be stored a file at a time and merged.

A state has a row for each described column: counts, moments, least and greatest value,
and a quantile sketch. States of several files make that of all, without the files.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MOMENTS = ["n", "mean", "m2", "least", "greatest"]


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile_state(df: DataFrame, k: int = 200) -> DataFrame:
    """The state of the numeric columns of a frame: ``column_name``, ``n`` (values that are
    neither null nor NaN), ``mean``, ``m2`` (the sum of squared distances from it),
    ``least``, ``greatest``, and ``sketch``, whose ``k`` sets the error of ranks, some
    1.3 % at 200. One pass; a frame without rows has ``n`` 0 and nulls."""

    def of(name: str) -> str:
        value = f"nanvl(cast(`{name}` as double), null)"
        return f"""struct('{name}' as column_name, count({value}) as n, avg({value}) as mean,
            var_pop({value}) * count({value}) as m2, min({value}) as least, max({value}) as greatest,
            kll_sketch_agg_double({value}, {k}) as sketch)"""

    rows = ", ".join(of(name) for name in _numbers(df))
    return df.selectExpr(f"array({rows}) as rows").selectExpr("inline(rows)")


def merged(states: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """The state of all that the states were taken from. Moments are combined around the
    common mean, so that far-off values cost no digits; the order does not matter."""
    whole = states if isinstance(states, DataFrame) else reduce(DataFrame.unionByName, states)
    common = whole.groupBy("column_name").agg(F.expr("sum(n * mean) / sum(n) as common"))
    apart = "m2 + n * (mean - common) * (mean - common)"
    return (
        whole.join(F.broadcast(common), "column_name")  # a row for each column
        .groupBy("column_name")
        .agg(
            F.sum("n").alias("n"),
            F.first("common").alias("mean"),
            F.expr(f"sum({apart}) as m2"),
            F.min("least").alias("least"),
            F.max("greatest").alias("greatest"),
            F.expr("kll_merge_agg_double(sketch) filter (where n > 0) as sketch"),
        )
    )


def described(state: DataFrame) -> DataFrame:
    """``column_name``, ``count``, ``mean``, sample deviation, ``min`` and ``max``."""
    return state.selectExpr(
        "column_name",
        "n as count",
        "mean",
        "if(n > 1, sqrt(m2 / (n - 1)), null) as stddev",
        "least as min",
        "greatest as max",
    )


def quantiles(state: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``column_name``, ``probability``, ``value``: about that share of the column's
    values are at most so great. Columns without values have none."""
    asked = ", ".join(f"{p!r}D" for p in probabilities)
    values = f"kll_sketch_get_quantile_double(sketch, array({asked}))"
    return state.where("n > 0").selectExpr(
        "column_name", f"inline(zip_with(array({asked}), {values}, (p, v) -> struct(p as probability, v as value)))"
    )
