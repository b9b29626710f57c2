"""Mapping stores: in memory with expiry, as an encrypted table, and JSON of a mapping."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Entry
from ..functions.rules import NAME
from ..operators.mask import ENTRY


class MappingStore(Protocol):
    def save(self, session_id: str, mapping: list[Entry]) -> None: ...
    def load(self, session_id: str) -> list[Entry] | None: ...
    def delete(self, session_id: str) -> None: ...


def to_json(mapping: list[Entry]) -> str:
    return json.dumps({e.token: {"entity_type": e.entity_type, "strategy": e.strategy, "reversible": e.reversible, "original": e.original} for e in mapping}, ensure_ascii=False)


def from_json(text: str) -> list[Entry]:
    out = [Entry(token, v["entity_type"], v["strategy"], v["reversible"], v["original"]) for token, v in json.loads(text).items()]
    if bad := [e.entity_type for e in out if not NAME.fullmatch(e.entity_type)]:
        raise ValueError(f"not an entity name: {bad[0]!r}")
    return out


class MemoryStore:
    def __init__(self, ttl_seconds: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl_seconds, clock, {}

    def save(self, session_id: str, mapping: list[Entry]) -> None:
        self.held[session_id] = (self.clock(), list(mapping))

    def load(self, session_id: str) -> list[Entry] | None:
        if session_id not in self.held:
            return None
        at, mapping = self.held[session_id]
        if self.clock() - at >= self.ttl:
            self.delete(session_id)
            return None
        return list(mapping)

    def delete(self, session_id: str) -> None:
        self.held.pop(session_id, None)


class RedisStore:
    """Named for completeness: every call raises NotImplementedError."""

    def save(self, *_) -> None:
        raise NotImplementedError("no Redis store is provided")

    load = delete = save


def checked(session_id: str) -> str:
    if not session_id or any(c in session_id for c in "/\\\0"):
        raise ValueError("a session id must be non-empty, without slashes and NUL")
    return session_id


def _key(key: bytes | str | None) -> bytes:
    import os

    key = key if key is not None else os.environ.get("UMBRA_STORE_KEY")
    key = bytes.fromhex(key) if isinstance(key, str) else key
    if key is None or len(key) not in (16, 24, 32):
        raise ValueError("an AES key of 16, 24 or 32 bytes is needed, given or as hexadecimal in UMBRA_STORE_KEY")
    return key


def encrypt(mapping: Column, key: bytes | str | None = None) -> Column:
    """AES-GCM of the mapping's JSON: nonce (12 bytes), ciphertext, tag (16 bytes)."""
    return F.aes_encrypt(F.to_json(mapping), F.lit(bytearray(_key(key))), F.lit("GCM"), F.lit("DEFAULT"))


def decrypt(blob: Column, key: bytes | str | None = None) -> Column:
    return F.from_json(F.aes_decrypt(blob, F.lit(bytearray(_key(key))), F.lit("GCM"), F.lit("DEFAULT")).cast("string"), f"array<{ENTRY}>")


class TableStore:
    """Encrypted mappings of many sessions as one Parquet table, partitioned by a hash of the session id."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | str | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, _key(key), buckets

    def write(self, mappings: DataFrame, mode: str = "append") -> None:
        """mappings: session_id, mapping (array of entries)."""
        out = mappings.select("session_id", encrypt(F.col("mapping"), self.key).alias("blob"), F.current_timestamp().alias("saved"), F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        out.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(self.path)

    def read(self, ttl_seconds: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        if ttl_seconds is not None:
            rows = rows.where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("saved") < ttl_seconds)
        return rows.groupBy("session_id").agg(F.max_by("blob", "saved").alias("blob")).where("blob is not null").select("session_id", decrypt(F.col("blob"), self.key).alias("mapping"))

    def save(self, session_id: str, mapping: list[Entry]) -> None:
        rows = [(checked(session_id), [(e.token, e.entity_type, e.strategy, e.reversible, e.original) for e in mapping])]
        self.write(self.spark.createDataFrame(rows, f"session_id string, mapping array<{ENTRY}>"))

    def load(self, session_id: str) -> list[Entry] | None:
        got = self.read().where(F.col("session_id") == checked(session_id)).first()
        return None if got is None else [Entry(**x.asDict()) for x in got["mapping"]]

    def delete(self, session_id: str) -> None:
        """A row without a mapping hides the earlier ones at once; compact() removes them from the files."""
        gone = self.spark.createDataFrame([(checked(session_id),)], "session_id string").withColumn("mapping", F.lit(None).cast(f"array<{ENTRY}>"))
        self.write(gone)

    def compact(self, path: str) -> TableStore:
        """A new table at `path` that holds the latest mapping of each session and nothing of deleted ones."""
        rows = self.spark.read.parquet(self.path).groupBy("session_id", "bucket").agg(F.max_by(F.struct("blob", "saved"), "saved").alias("x"))
        rows.where("x.blob is not null").select("session_id", "x.blob", "x.saved", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(path)
        return TableStore(self.spark, path, self.key, self.buckets)
