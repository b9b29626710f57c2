"""Scans of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan that has fewer tasks than two a core, dealt to four a core.

    A scan's task reads whole row groups, so a file of one row group is one task however many splits it has, and all
    that is computed on its rows stays on one core. Scans of more tasks, as large tables give, stay where they are: no
    shuffle. An empty table stays empty; rows, repeated ones included, are the same either way, in no order.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
