"""Session scope: a value keeps its token over all texts of a session.

Findings are numbered per (session, type) by first appearance; one shuffle by session brings the numbers, one by
(session, order) the texts. A hot session's numbering is a window over its distinct values only, which are
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import Policy
from ..functions.rules import Detection
from .detect import detect
from .detect import each as every
from .mask import RESERVED, fixed, free_token, strategy_of, surrogate, unmask


def mapping_table(df: DataFrame, session: str, order: str, column: str = "text", d: Detection = Detection(), p: Policy = Policy()) -> DataFrame:
    """session_id, n, token, put, entity_type, strategy, reversible, original: a row a distinct value of a session.

    Tokens that look alike in a text up to the value's first one get a nonce. Rows with a null session form a session.
    """
    found = detect(df.select(F.col(session).alias("session_id"), F.col(order).alias("turn"), F.col(column).alias("text")), "text", d)
    return _mapping(found, p)


def _mapping(found: DataFrame, p: Policy) -> DataFrame:
    s = every(found, "spans")
    first = s.groupBy("session_id", F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("original")).agg(F.min(F.struct("turn", F.col("s.start").alias("start"))).alias("first"))
    w = Window.partitionBy("session_id", "entity_type").orderBy("first", "original")
    numbered = first.withColumn("n", F.row_number().over(w))
    plain = F.concat(F.lit("<"), F.col("entity_type"), F.lit("_"), F.col("n").cast("string"), F.lit(">"))
    numbered = numbered.withColumn("plain", plain)
    # token lookalikes are rare: only texts that hold one leave a row
    like = found.where(F.col("text").rlike(RESERVED)).select("session_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(RESERVED), F.lit(0))).alias("plain"))
    like = like.groupBy("session_id", "plain").agg(F.min("turn").alias("seen")).withColumnsRenamed({"session_id": "_s", "plain": "_p"})
    j = numbered.join(like, numbered["session_id"].eqNullSafe(F.col("_s")) & (F.col("plain") == F.col("_p")) & (F.col("seen") <= F.col("first.turn")), "left")
    how = strategy_of(F.col("entity_type"), p)
    taken = F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.array().cast("array<string>"))
    token = free_token(F.col("entity_type"), F.col("n"), F.col("original"), taken, p.secret)
    j = j.withColumn("asked", how).withColumn("token", token)
    fake = surrogate(F.col("entity_type"), F.col("original"), F.lit(""), F.array().cast("array<string>"), p)
    j = j.withColumn("fake", fake)
    # two values with one fake: the later ones fall back to tokens
    j = j.withColumn("fake", F.when(F.row_number().over(Window.partitionBy("session_id", "fake").orderBy("first", "original")) == 1, F.col("fake")))
    rev = F.col("asked").isin("replace", "surrogate")
    return j.select(
        "session_id", "n", F.coalesce("fake", "token").alias("token"), F.coalesce("fake", F.when(rev, F.col("token")).otherwise(fixed(F.col("original"), F.col("entity_type"), F.col("asked"), p))).alias("put"),
        "entity_type", F.when((F.col("asked") == "surrogate") & F.col("fake").isNull(), "replace").otherwise(F.col("asked")).alias("strategy"), rev.alias("reversible"), "original",
    )


def mask_sessions(df: DataFrame, session: str, order: str, column: str = "text", d: Detection = Detection(), p: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(df with masked_text, mapping table). Rows of df must differ in (session, order)."""
    found = detect(df, column, d, "_spans")
    m = _mapping(found.select(F.col(session).alias("session_id"), F.col(order).alias("turn"), F.col(column).alias("text"), F.col("_spans").alias("spans")), p)
    each = every(found.select(F.col(session).alias("_session"), F.col(order).alias("_order"), "_spans"), "_spans").drop("_spans")
    puts = each.join(m, each["_session"].eqNullSafe(m["session_id"]) & (F.col("s.entity_type") == m["entity_type"]) & (F.col("s.text") == m["original"]))
    per = puts.groupBy("_session", "_order").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "put"))).alias("_puts"))
    j = found.join(per, F.col(session).eqNullSafe(F.col("_session")) & F.col(order).eqNullSafe(F.col("_order")), "left")
    t = F.col(column)
    built = F.aggregate(
        "_puts",
        F.struct(F.lit("").alias("o"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["o"], F.substr(t, a["at"] + 1, x["start"] - a["at"]), x["put"]).alias("o"), x["end"].alias("at")),
        lambda a: F.concat(a["o"], F.substr(t, a["at"] + 1, F.length(t) - a["at"])),
    )
    return j.withColumn("masked_text", F.when(F.col("_puts").isNull(), t).otherwise(built)).drop("_puts", "_session", "_order", "_spans"), m


def unmask_sessions(masked: DataFrame, mapping: DataFrame, session: str, column: str = "masked_text", out: str = "text") -> DataFrame:
    """Restore with the session's mapping; only entries whose token stands in the text are applied, in order of issue.

    Tokens found in a text are joined with the mapping, so a session's whole mapping never rides along with each text.
    """
    rev = mapping.where("reversible").select(F.col("session_id").alias("_s"), "n", "token", "original", "entity_type", "strategy", "reversible")
    fake = rev.where("strategy = 'surrogate'")
    # what a text becomes depends on session and text only: told by 128 bits of the text, the same in each evaluation
    row = ["_x", "_h", "_i"]
    base = masked.withColumns({"_x": F.col(session), "_h": F.xxhash64(column), "_i": F.xxhash64(F.lit(1), column)})
    tokens = base.select(*row, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(RESERVED), F.lit(0)))).alias("_t")).distinct()
    entry = ["n", "token", "entity_type", "strategy", "reversible", "original"]
    hit = tokens.join(rev, F.col("_x").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("token"))).select(*row, *entry)
    if not fake.isEmpty():
        more = base.select(*row, F.col(column).alias("_text")).join(fake, F.col("_x").eqNullSafe(F.col("_s"))).where(F.contains("_text", F.col("token"))).select(*row, *entry).distinct()
        hit = hit.union(more)
    per = hit.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("_e")).withColumnsRenamed({x: x + "2" for x in row})
    same = F.col("_x").eqNullSafe(F.col("_x2")) & (F.col("_h") == F.col("_h2")) & (F.col("_i") == F.col("_i2"))
    restored = F.when(F.col("_e").isNull(), F.col(column)).otherwise(unmask(F.col(column), F.col("_e")))
    return base.join(per, same, "left").withColumn(out, restored).drop("_e", *row, *[x + "2" for x in row])


def live(mapping: DataFrame, began: str, ttl_seconds: int, now=None) -> DataFrame:
    """Mapping rows whose session has not expired (age below the time to live)."""
    return mapping.where(F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(began) < ttl_seconds)
