"""Toxicity by maximum-scoring segments.

Fit: tokens of a bounded sample of labelled documents give log-odds with a Dirichlet prior (the prior is the pooled
token distribution); tokens whose log-odds are not significant score the drift, a small negative number, so that
unremarkable text has a negative expected score. Score: one linear scan (Ruzzo and Tompa's recurrence) finds all
maximal scoring segments. Extreme-value calibration: the best segment scores of clean training documents give the
Gumbel rate and the constant K; a segment's significance is lam * S - ln(K * n). A logistic curve on the sum
of significant segments, fitted on the training documents, gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, map_rows, table, small_batches

TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    drift: float
    lam: float
    k: float
    slope: float
    bias: float


def segments(n: int, hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of n tokens, of which hits have their own score.

    The tokens between two hits only lower the running total, so a segment starts and ends at hits. Linear in hits: each
    segment keeps a link to the nearest one before it with a smaller total before, and those between are never looked at again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # (first, last, total before, total after, link)
    total, at = 0.0, -1
    for i, w in hits:
        total += drift * (i - at - 1)
        at, before = i, total
        total += w
        if w <= 0:
            continue
        first, low, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, low, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((first, i, low, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in found]


def scan(text: str | None, m: ToxicityModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens of the text, and the segments with character offsets and significance above 0."""
    words = list(TOKEN.finditer(text.lower() if len(text.lower()) == len(text) else text)) if text else []
    w = m.weights
    hits = [(i, w[x]) for i, x in enumerate(map(re.Match.group, words)) if x in w]
    out = []
    for a, b, s in segments(len(words), hits, m.drift) if hits else ():
        e = m.lam * s - np.log(m.k * max(len(words), 2))
        if e > 0:
            out.append((words[a].start(), words[b].end(), float(e)))
    return len(words), out


def probability(evidence: float, m: ToxicityModel) -> float:
    return float(1 / (1 + np.exp(-np.clip(m.slope * evidence + m.bias, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = 6000, prior: float = 0.05, z: float = 4.0) -> ToxicityModel:
    """Counts are of documents that hold a token, so that one text's repetitions are no evidence; prior is the pooled
    distribution's weight as a share of all counts. docs: the rows to learn from. sample: most documents of each label, the first by hash of the id.

    Repeated label rows count once (the largest label wins); null labels, ids and texts are left out; of
    repeated rows of an id the least text counts. Without rows of
    both labels the model has no weights and gives 0.
    """
    lab = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    # the ids of learnable documents, then the first by hash for either label: bounded by 2 * sample
    lab = lab.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    ids = lab.where("y = 1").orderBy(F.xxhash64("k"), "k").limit(sample).union(lab.where("y = 0").orderBy(F.xxhash64("k"), "k").limit(sample))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(ids), "k")
    # one text an id, so that repeated rows keep within the bound
    rows = table(rows.groupBy("k").agg(F.min("t").alias("t"), F.max("y").cast("int").alias("y")).select("t", "y"), "learn")

    def start():
        def f(c):
            return {"y": c["y"], "w": [list(set(TOKEN.findall(t.lower()))) for t in c["t"]]}

        return f

    counted = map_rows(rows, "y int, w array<string>", start)
    per = table(counted.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("q")), "words")
    both = per.agg(F.sum("p"), F.sum("q")).first()
    if not both[0] or not both[1]:
        return ToxicityModel({}, -0.1, 1.0, 1.0, 1.0, -3.0)
    n1, n0 = map(float, both)
    prior *= n1 + n0
    a = prior * (F.col("p") + F.col("q")) / (n1 + n0)
    odds = F.log((F.col("p") + a) / (n1 + prior - F.col("p") - a)) - F.log((F.col("q") + a) / (n0 + prior - F.col("q") - a))
    sd = F.sqrt(1 / (F.col("p") + a) + 1 / (F.col("q") + a))
    # the words of a bounded sample with significant odds: bounded too
    kept = per.withColumn("o", odds).where(F.abs(F.col("o") / sd) >= z).select("w", "o").collect()
    weights = {r["w"]: float(r["o"]) for r in kept}
    drift = -0.02
    base = ToxicityModel(weights, drift, 1.0, 1.0, 1.0, 0.0)

    def start2():
        def g(c):
            best, many, size = [], [], []
            for t in c["t"]:
                n, found = _raw(t, base)
                best.append(max(found, default=0.0))
                many.append(found)
                size.append(n)
            return {"y": c["y"], "n": size, "best": best, "all": many}

        return g

    seen = map_rows(rows, "y int, n int, best double, all array<double>", start2).collect()  # 2 * sample rows at most
    clean = [(r["n"], r["best"]) for r in seen if r["y"] == 0 and r["n"] > 1]
    lam, k = _gumbel(clean)
    x = np.array([sum(max(0.0, lam * s - np.log(k * max(r["n"], 2))) for s in r["all"]) for r in seen])
    y = np.array([float(r["y"]) for r in seen])
    x = np.minimum(x, 30.0)
    slope, bias = _logistic(x, y)
    return ToxicityModel(weights, drift, lam, k, float(max(slope, 1e-3)), float(bias))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and bias of the ridge-regularised logistic curve: Newton steps, halved until the (convex) loss falls."""

    def loss(v):
        z = v[0] * x + v[1]
        return (np.logaddexp(0, z) - y * z).sum() + ridge * (v * v).sum() / 2

    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -50, 50)))
        g = np.array([((p - y) * x).sum(), (p - y).sum()]) + ridge * v
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def _raw(text: str, m: ToxicityModel) -> tuple[int, list[float]]:
    words = TOKEN.findall(text.lower())
    hits = [(i, m.weights[x]) for i, x in enumerate(words) if x in m.weights]
    return len(words), [s for _, _, s in segments(len(words), hits, m.drift)]


def _gumbel(clean: list[tuple[int, float]]) -> tuple[float, float]:
    """Rate and K of the best clean segment's law: P(S < s) = exp(-K n exp(-lam s)), by maximum likelihood.

    Documents without a segment tell only that theirs is below the least score seen. For a rate, K follows in closed form
    (the documents with a segment, over the sum of n exp(-lam S)); the rate is the best of a fine geometric grid.
    """
    n, s = np.array([x[0] for x in clean], float), np.array([x[1] for x in clean], float)
    some = s > 0
    if not some.any():
        return 1.0, 1.0
    s = np.where(some, s, s[some].min())
    best = (-np.inf, 1.0, 1.0)
    for lam in np.geomspace(0.02, 5, 400):
        k = some.sum() / max(float((n * np.exp(-lam * s)).sum()), 1e-300)
        fit_ = some.sum() * (np.log(lam) + np.log(k)) - lam * s[some].sum()  # what is left is the same for all rates
        best = max(best, (float(fit_), float(lam), float(k)))
    return best[1], max(best[2], 1e-6)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, n_words, spans (start, end, evidence of each significant passage).

    Every row of docs gives one row; null and empty texts have no passage and get the model's base score. Whole texts
    are scanned, in time linear in their length. Repeated rows give repeated rows.
    """

    def start():
        def f(c):
            out = {"doc_id": c["k"], "score": [], "predicted": [], "n_words": [], "spans": []}
            for t in c["t"]:
                n, found = scan(t, model)
                s = probability(min(30.0, sum(x[2] for x in found)), model)
                out["score"].append(s)
                out["predicted"].append(int(s >= threshold))
                out["n_words"].append(n)
                out["spans"].append([{"start": a, "end": b, "evidence": e} for a, b, e in found])
            return out

        return f

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"doc_id {kind}, score double, predicted int, n_words int, spans array<struct<start:int,end:int,evidence:double>>", start)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(crc(F.col("doc_id"), 5) != 0), labels)
    s = score(docs, model)
    return s.select("doc_id", (crc(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_passages"))


def keep_clean(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; scored in place, so nothing is joined."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                good = [probability(min(30.0, sum(x[2] for x in scan(t, model)[1])), model) < threshold for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
