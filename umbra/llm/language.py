"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased; its letters' UTF-8 bytes with one space between words give hashed 2-, 3- and 4-byte subwords.
The text's vector is the average of its subwords' embeddings; a softmax over languages follows. A temperature fitted on
held-back training rows calibrates the probability, and the rejection threshold is the least one at which
the held-back rows that stay are right as often as asked.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc, map_rows, table

#: Numbers that are word characters to `re` but neither decimal digits nor letters, as fractions and Roman numerals.
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
NUMBER = re.compile(f"[{re.escape(''.join(sorted(NUMBERS)))}]")
NOT_LETTER = re.compile(r"[\W\d_]+")
BUCKETS = 1 << 14


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the softmax's weights
    bias: np.ndarray
    temperature: float
    reject: float


def subwords(text: str | None) -> np.ndarray | None:
    """Counts of hashed subwords over the whole text; None if it has no letter."""
    s = (text or "").lower()
    if not s.isascii() and not NUMBERS.isdisjoint(s):
        s = NUMBER.sub(" ", s)
    s = NOT_LETTER.sub(" ", s).strip()
    if not s:
        return None
    out = np.zeros(BUCKETS, np.float64)
    b = f" {s} ".encode()
    for at in range(0, len(b), 1 << 20):  # bounded memory for very long texts; windows overlap by three bytes
        x = np.frombuffer(b, np.uint8)[at : at + (1 << 20) + 3].astype(np.uint32)
        h = x
        for n in (1, 2, 3):
            if len(x) <= n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ (x[n:] * np.uint32(0x9E3779B1))
            take = h[: 1 << 20]
            out += np.bincount((take ^ (take >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out / out.sum()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = 500, width: int = 16, epochs: int = 12, rate: float = 4.0, precision: float = 0.95) -> LanguageModel:
    """docs: the rows to learn from. sample: most documents of each language, the first by hash of id and text (repeated rows
    once); the number of languages is that of the distinct values. Null languages and texts without letters are left out."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("y"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t", F.lit(3)))
    # the first of each language in two rounds, so that few rows meet in a language's task: in each of 64 parts by hash as
    # many as are eight times its even share, then of those (every task keeps no more of its own before they meet)
    rank = F.xxhash64("h")
    ids = rows.groupBy("y", "h").agg(F.lit(1)).select("y", "h", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(64)).alias("s"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("y", "s").orderBy(rank, "h"))).where(F.col("n") <= max(8, sample // 8)).select("y", "h")
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(rank, "h"))).where(F.col("n") <= sample).select("y", "h")
    ids = table(ids, "learn")
    names = sorted(r[0] for r in ids.select("y").distinct().collect())

    def start():
        def f(c):
            made = [subwords(t) for t in c["t"]]
            at = [None if v is None else np.flatnonzero(v).astype(np.int32) for v in made]
            return {"y": c["y"], "h": c["h"], "i": [None if x is None else x.tobytes() for x in at], "w": [None if x is None else v[x].astype(np.float32).tobytes() for v, x in zip(made, at)]}

        return f

    picked: list[tuple[int, np.ndarray, np.ndarray]] = []
    if names:  # languages times sample rows at most, as sparse counts
        seen = map_rows(rows.join(F.broadcast(ids), ["y", "h"]).select("y", "h", "t"), "y string, h bigint, i binary, w binary", start)
        for r in seen.groupBy("y", "h").agg(F.first(F.struct("i", "w")).alias("x")).select("y", "x.*").collect():
            if r["i"] is not None:
                picked.append((names.index(r["y"]), np.frombuffer(r["i"], np.int32), np.frombuffer(r["w"], np.float32).astype(np.float64)))
        picked.sort(key=lambda p: (p[0], len(p[1]), p[2].tobytes()))  # the same order on every run
    if not picked:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(picked))
    back, train = order[: len(order) // 6], order[len(order) // 6 :]
    emb, soft, bias = rng.normal(0, 0.1, (BUCKETS, width)), rng.normal(0, 0.1, (width, len(names))), np.zeros(len(names))
    for e in range(epochs):
        step = rate * (1 - e / epochs) + 0.05
        for i in rng.permutation(train):
            y, at, w = picked[i]
            x = w @ emb[at]
            z = x @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = soft @ p
            soft -= 0.1 * step * np.outer(x, p)
            bias -= 0.02 * step * p
            emb[at] -= step * w[:, None] * g
    tab = emb @ soft
    z = np.array([picked[i][2] @ tab[picked[i][1]] + bias for i in back]).reshape(len(back), len(names))
    y = np.array([picked[i][0] for i in back], int)
    temperature, reject = 1.0, 0.0
    if len(back):
        def loss(t):
            q = z / t - (z / t).max(1, keepdims=True)
            return -(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean()

        temperature = min(np.geomspace(0.1, 20, 60), key=loss)
        q = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
        top = (q / q.sum(1, keepdims=True)).max(1)
        right = z.argmax(1) == y
        for t in np.sort(np.r_[0.0, top]):
            if right[top >= t].mean() >= precision:
                reject = float(t)
                break
        else:
            reject = 1.0
    return LanguageModel(names, tab, bias, float(temperature), reject)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, rejected. und and 0 for null texts and texts without a letter (or without a model);
    rejected: und, or a score below the calibrated threshold. One row per input row; whole texts."""

    def start():
        def f(c):
            out = {"doc_id": c["k"], "lang_pred": [], "score": [], "rejected": []}
            for t in c["t"]:
                v = subwords(t) if model.names else None
                if v is None:
                    name, s = "und", 0.0
                else:
                    z = (v @ model.table + model.bias) / model.temperature
                    p = np.exp(z - z.max())
                    i = int(p.argmax())
                    name, s = model.names[i], float(p[i] / p.sum())
                out["lang_pred"].append(name)
                out["score"].append(s)
                out["rejected"].append(name == "und" or s < model.reject)
            return out

        return f

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"doc_id {kind}, lang_pred string, score double, rejected boolean", start)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (crc(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
