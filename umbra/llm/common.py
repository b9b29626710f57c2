"""Shared helpers: intermediate tables in the shared folder, Arrow mapping, small numpy graph code."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: \x20 and \x09-\x0D.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset and the master is local (one machine) a temporary folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="umbra-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and the rows outlive the executors that made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/umbra-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> None:
    """Spark's default of 10000 rows an Arrow batch knows no bound in bytes: with long texts or media it is lowered, for the session,
    unless somebody has set it."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name, "10000") == "10000":
        conf.set(name, "512")


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """start() runs once a task and gives f(columns as lists) -> columns; f sees at most 512 rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in out], schema=out)

    small_batches(df)
    return df.mapInArrow(run, schema)


def crc(col, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b (minimum labels with pointer jumping)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def split_hot(keyed: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Deal groups of over `most` rows to pairs of tiles: column `tile` tells which rows meet.

    A group of c rows gets t = ceil(c / most) tiles; a row of tile i goes to the t tile pairs that hold i, so that
    any two rows of the group meet in at least one (key, tile) of about 2 * most rows. Small groups have one tile.
    No pair is lost, and no task holds a whole hot group.
    """
    hot = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most)
    j = keyed.join(hot.select(F.col(key), F.ceil(F.col("_c") / most).cast("int").alias("_t")), key, "left")
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("_t")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_t") - 1),
        lambda o: F.least(mine, o) * F.col("_t") + F.greatest(mine, o),
    )
    return j.withColumn("tile", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(-1))).otherwise(pairs))).drop("_t")


#: Keys with over this share of the rows are hot; there are 1 / HOT of them at most, which bounds their broadcast.
HOT = 1 / 512


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with per_key (a row a key, `count`: its rows among the `total` rows) without a task for a hot key's rows.

    Keys of over HOT * total rows, 1 / HOT at most, are broadcast, so their rows stay where they are; others are shuffled.
    """
    hot = F.col(count) > HOT * total
    few, rest = per_key.where(hot).drop(count), per_key.where(~hot).drop(count)
    near = rows.join(F.broadcast(few), key)
    return near.unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """edges (a, b) of long ids -> (node, root): root is the smallest node reachable. Only nodes with an edge appear.

    Alternating large-star and small-star steps; each step's edges are a table in the shared folder, and hubs are no task's own (join_hot).
    No row goes to the driver except counts. Rounds go on until the edges are stars: each joins at least one more node to its
    root, and long paths halve.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), label)
    while True:
        n = now.count()
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("c")).select("x", F.least("x", "m").alias("m"), "c")
        large = table(join_hot(both.where("y > x"), low, "x", "c", n).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct(), label)
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("c"))
        joined = join_hot(large, least, "v", "c", n)
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("v <> u").distinct()
        new = table(small, label)
        # a star forest: no root has a root, and every node has one
        if not new.join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() and new.groupBy("v").count().where("count > 1").limit(1).count() == 0:
            return new.select(F.col("v").alias("node"), F.col("u").alias("root")).union(new.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        now = new
