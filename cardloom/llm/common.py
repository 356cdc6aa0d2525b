"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..session import materialise, table

__all__ = ["Kept", "arrow", "bounded_sample", "field_values", "materialise", "table"]


class Kept(dict):
    """What fn says of each key, kept, as words recur; looked up by [key]."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        got = self[key] = self.fn(key)
        return got

    def clear_beyond(self, most: int) -> None:
        if len(self) > most:
            self.clear()

    def __reduce__(self):
        return Kept, (self.fn,)


def arrow(fn: Callable, returns: str, *cols: Column | str) -> Column:
    """fn(value, ...) per row, carried in Arrow batches; evaluated once even where a filter follows."""

    struct = returns.startswith("struct<")

    def run(*series):
        out = [fn(*row) for row in zip(*series)]
        return pd.DataFrame(out, index=series[0].index) if struct and out else pd.DataFrame(columns=fields) if struct else pd.Series(out, index=series[0].index, dtype=object)

    fields = [f.split(":")[0] for f in returns[7:-1].split(",")] if struct else []
    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame if struct else pd.Series}
    return pandas_udf(run, returns).asNondeterministic()(*cols)


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_id, field_name, text) of the titles, descriptions and render texts that are neither null nor empty.

    Rows delivered twice are still there twice: what is found is small, so it is made distinct instead of the texts.
    """
    cards = table(spark, sf_dir, "cards")
    renders = table(spark, sf_dir, "render_results")
    parts = [
        cards.select(F.lit("cards").alias("source_table"), F.col("card_id").alias("row_id"), F.explode(F.array(
            F.struct(F.lit("title").alias("field_name"), F.col("title").alias("text")),
            F.struct(F.lit("description").alias("field_name"), F.col("description").alias("text")),
        )).alias("v")).select("source_table", "row_id", "v.field_name", "v.text"),
        renders.select(F.lit("render_results").alias("source_table"), F.col("render_id").alias("row_id"), F.lit("text").alias("field_name"), "text"),
    ]
    return parts[0].unionByName(parts[1]).where(F.col("row_id").isNotNull() & (F.trim("text") != ""))


def bounded_sample(df: DataFrame, most: int, total: int, *key: str) -> list:
    """At most so many rows of df, the same ones wherever they lie.

    A hash of the key thins the rows by their number first, to about twice the limit: else every task would send its own
    share of the limit.
    """
    every = max(1, -(-total // (2 * most)))
    h = F.xxhash64(*key)
    return df.withColumn("__h", h).where(F.pmod("__h", F.lit(every)) == 0).orderBy("__h").limit(most).drop("__h").collect()

