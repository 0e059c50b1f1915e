"""Writers for results, and the one way for a small result to the driver."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_features(features: DataFrame, path: str) -> None:
    """Write one GeoJSON feature per line."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, most: int = 100_000) -> pd.DataFrame:
    """A final report as pandas; more than ``most`` rows is an error, not a cut."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    return rows
