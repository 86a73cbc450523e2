"""Keyed writes as joins: the rows that a table holds after a batch came in.

Each takes the table and the batch and returns the new table, to be written as a whole or by partition. Batches may hold a
key more than once; which row counts is said below. Null keys never equal each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_wins(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of new keys are added, the first by order; rows of known keys are ignored."""
    new = _one(batch, keys, order).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new.select(table.columns))


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] = (), coalesce: Sequence[str] = ()) -> DataFrame:
    """Rows of known keys are overwritten by the batch's, the last by order; columns in keep stay as they are, those in coalesce where the batch has null.

    Columns of the table that the batch does not have stay as well; in rows of new keys they are null.
    """
    last = _one(batch, keys, order)
    named = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in last.columns if c not in keys], F.lit(True).alias("_there"))
    joined = table.withColumn("_old", F.lit(True)).join(named, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in batch.columns:
            return F.col(c)
        new, old = F.col(f"_new_{c}"), F.col(c)
        if c in keep:
            return F.when(F.col("_old").isNotNull(), old).otherwise(new).alias(c)
        if c in coalesce:
            return F.coalesce(new, old).alias(c)
        return F.when(F.col("_there").isNotNull(), new).otherwise(old).alias(c)

    return joined.select(*[value(c) for c in table.columns])


#: What an assessment that comes again leaves as it was.
ASSESSMENT_KEEPS = ("s5_score", "created_at")


def upsert_assessment(table: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(table, batch, ("device_id", "day_ts"), order, keep=ASSESSMENT_KEEPS, coalesce=("bind_id",))


def upsert_summary(table: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A run without a binding leaves the one that is there."""
    return upsert(table, batch, ("device_id", "day_ts"), order, coalesce=("bind_id",))


def upsert_environment(table: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(table, batch, ("device_id", "day_ts"), order, keep=("created_at",), coalesce=("env_temp", "env_humidity", "neck_temp"))


def upsert_baseline(table: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    return upsert(table, batch, ("device_id",), order, keep=("created_at",))


def upsert_sync_state(table: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Bindings are refreshed; how far each stream has been read stays."""
    return upsert(table, batch, ("device_id",), order, keep=("last_processed_ts", "last_env_ts", "last_neck_temp_ts"))
