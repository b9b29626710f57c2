"""Substring dedup by content-defined chunking with a gear rolling hash.

A byte's gear value comes from its XXH64; the hash at a byte is the sum of the last 32 gear values, each shifted by
its age, so a cut depends on 32 bytes only and an insertion moves no cut beyond them. A cut falls where the hash is
below 2^32 / mean, unless another such place lies in the `least` bytes before; in stretches without one, as periodic text has,
where the hash is the least of the last 64. From each chunk on, as many chunks as hold `min_words` words make a block; blocks
are deduplicated by 96-bit digest over all documents, and blocks that follow each other here as in the first document that holds
them are one repeated passage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_rows, table

GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) & 0xFFFFFFFF for i in range(256)], np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """Gear hash at each byte, by doubling: after step s each value sums 2^(s+1) bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


#: A stretch without a cut is cut otherwise from this many times the mean on; the window of the other rule.
LONG, WINDOW = 4, 64


def cuts(data: bytes, mean: int, least: int) -> list[int]:
    """Ends of the chunks of data."""
    if not data:
        return []
    h = rolling(data)
    at = np.flatnonzero(h < np.uint32(2**32 // mean)) + 1
    if len(at):
        at = at[np.r_[True, np.diff(at) > least]]
    edge = np.r_[0, at, len(data)]
    long = np.flatnonzero(np.diff(edge) > LONG * mean)
    more: list[int] = []
    for lo, hi in zip(edge[long], edge[long + 1]):
        kept = int(lo)
        for a in range(lo, hi, 1 << 20):  # bounded memory in very long stretches
            x = h[max(a - WINDOW + 1, 0) : min(a + (1 << 20), hi)]
            if len(x) >= WINDOW:
                low = np.lib.stride_tricks.sliding_window_view(x, WINDOW).min(1)
                for i in (np.flatnonzero(x[WINDOW - 1 :] == low) + max(a - WINDOW + 1, 0) + WINDOW).tolist():
                    if i - kept > mean:  # a short period's least place comes again and again
                        more.append(i)
                        kept = i
    if more:
        at = np.unique(np.concatenate([at, more]))
    out = at.tolist()
    return out if out and out[-1] == len(data) else [*out, len(data)]


def blocks(data: bytes, ends: list[int], min_words: int) -> tuple[list[int], list[int], list[int]]:
    """For each chunk from which on whole chunks hold min_words words: the number of the last of them, and two digests of
    the bytes from the one's start to the other's end."""
    if not ends:
        return [], [], []
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    words = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]])[np.array(ends) - 1]]  # that begin before each edge
    last = np.searchsorted(words, words[:-1] + min_words) - 1
    last = last[last < len(ends)]
    starts = [0, *ends[:-1]]
    parts = [data[starts[i] : ends[j]] for i, j in enumerate(last.tolist())]
    return last.tolist(), [xxhash.xxh3_64_intdigest(x) - 2**63 for x in parts], [xxhash.xxh32_intdigest(x, 5) - 2**31 for x in parts]


def block_table(docs: DataFrame, *, text: str, key: str, mean: int, least: int, min_words: int) -> DataFrame:
    def start():
        def f(c):
            out = {k: [] for k in ("ends", "last", "digests", "checks")} | {"doc_id": c["k"]}
            for t in c["t"]:
                data = (t or "").encode()
                ends = cuts(data, mean, least)
                last, digests, checks = blocks(data, ends, min_words)
                for k, v in zip(("ends", "last", "digests", "checks"), (ends, last, digests, checks)):
                    out[k].append(v)
            return out

        return f

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull()), f"doc_id {kind}, ends array<int>, last array<int>, digests array<bigint>, checks array<int>", start)


def repeated_passages(docs: DataFrame, *, text: str = "text", key: str = "doc_id", mean: int = 24, least: int = 8, min_words: int = 16, within: bool = False) -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), first_doc_id, first_chunk, kept: one row per repeated passage.

    A passage is a maximal row of blocks (of min_words words in whole chunks) that other documents hold too and that the first of them, the
    one with the smallest id, holds in the same order: so first_doc_id holds all of it, from its chunk first_chunk on. kept is true in that
    document, at that place. Since a shared passage loses on average `mean` bytes at either end to chunks that reach out of it, min_words is set below the
    length that must be found. With `within`, blocks that only one document holds, twice or more, count too.
    Null and empty texts and rows with null ids have no passage; repeated rows with one id are one document.
    """
    c = table(block_table(docs, text=text, key=key, mean=mean, least=least, min_words=min_words), "chunks")
    each = c.select("doc_id", F.posexplode(F.arrays_zip("digests", "checks")).alias("i", "x")).select("doc_id", "i", F.col("x.digests").alias("digest"), F.col("x.checks").alias("check"))
    many = F.col("lo") != F.col("hi")
    common = each.groupBy("digest", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    common = table(common.where((many | (F.col("n") > 1)) if within else many).drop("hi").withColumnRenamed("check", "_check"), "common")
    total = c.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
    hit = table(join_hot(each, common, "digest", "n", total).where("check = _check").drop("_check"), "hits")
    first = hit.where("doc_id = lo").groupBy("digest", F.col("check").alias("_check")).agg(F.min("i").alias("lo_i"))
    counts = hit.groupBy("digest", F.col("check").alias("_check")).agg(F.count(F.lit(1)).alias("n"))
    placed = join_hot(hit, first.join(counts, ["digest", "_check"]), "digest", "n", hit.count()).where("check = _check")
    # a document's hits come together again: no more of them than its own chunks
    per = placed.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("i", "lo", "lo_i"))).alias("hits"))
    return _passages(c.select("doc_id", "ends", "last").join(per, "doc_id"))


def _passages(joined: DataFrame) -> DataFrame:
    """Rows of hits that go on by one chunk, here as in their first document; linear in the hits of a document."""

    def start():
        def f(c):
            out = {"doc_id": c["doc_id"], "found": []}
            for d, hits, ends, last in zip(c["doc_id"], c["hits"], c["ends"], c["last"]):
                found, k = [], 0
                while k < len(hits):
                    j = k
                    while j + 1 < len(hits) and all(hits[j + 1][x] == hits[j][x] + step for x, step in (("i", 1), ("lo", 0), ("lo_i", 1))):
                        j += 1
                    a, b = hits[k], hits[j]
                    if b["i"] < len(last):  # else a repeated row of the id with a shorter text
                        found.append({"start": ends[a["i"] - 1] if a["i"] else 0, "end": ends[last[b["i"]]], "first": a["lo"], "first_chunk": a["lo_i"], "kept": a["lo"] == d and a["lo_i"] == a["i"]})
                    k = j + 1
                out["found"].append(found)
            return out

        return f

    kind = joined.schema["doc_id"].dataType.simpleString()
    rows = map_rows(joined.select("doc_id", "hits", "ends", "last"), f"doc_id {kind}, found array<struct<start:int,end:int,first:{kind},first_chunk:int,kept:boolean>>", start)
    return rows.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.start", "x.end", F.col("x.first").alias("first_doc_id"), "x.first_chunk", "x.kept")


def without_repeats(docs: DataFrame, passages: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the passages that are not `kept` cut out of their texts; rows without such passages stay as they are."""
    spans = passages.where("not kept").groupBy(F.col("doc_id").alias("_k")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, found):
            data, parts, at = (t or "").encode(), [], 0
            for s in spans_:
                parts.append(data[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append(None if t is None else b"".join([*parts, data[at:]]).decode(errors="ignore"))
        return pd.Series(out)

    j = docs.join(spans, F.col(key) == F.col("_k"), "left").withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut(F.col(text), F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")))))
    return j.drop("_k", "_spans")


def op4(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
