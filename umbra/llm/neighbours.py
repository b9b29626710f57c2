"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors; their number grows with the square root of the rows. A vector is represented
by its `depth` nearest pivots in order, and posted in the inverted files of the first `posted`. A query visits the files
of some of its nearest pivots, ranks each file's posts by Spearman's footrule (a pivot that one list lacks counts as
at place `depth`), and the best `rerank` of a file's block, or an eighth of it if that is more, are reranked by exact cosine. As queries are far fewer than rows, few posts and
many visits move the least data. Files and the queries that visit them are dealt in blocks of bounded size, so a pivot
that a third of all vectors are near is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, v, d): rows whose vector is neither null, empty nor zero, and has finite components only; d: its length."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    if not dict(rows.dtypes)["v"] in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return rows.withColumn("d", F.size("v"))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component to [0.5, 1): squares neither
    overflow nor vanish, and cosines stay what they are."""
    m = np.asarray(m, np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def permutation(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of the `depth` nearest pivots of each unit vector, nearest first; ties to the smaller number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.uint16)


def footrule(queries: np.ndarray, posts: np.ndarray, n_pivots: int) -> np.ndarray:
    """Spearman's footrule between each post's and each query's list of pivots: posts x queries."""
    depth = queries.shape[1]
    place = np.full((n_pivots, len(queries)), depth, np.int16)
    place[queries.T, np.arange(len(queries))] = np.arange(depth, dtype=np.int16)[:, None]
    # a post's pivots: |place - own place|; the query's pivots that the post lacks: depth - place, which is all of them
    # less those that it has
    out = np.full((len(posts), len(queries)), depth * (depth + 1) // 2 - depth * depth, np.int32)
    for j in range(depth):
        at = place[posts[:, j]]
        out += at
        at -= np.int16(j)
        out += np.abs(at, out=at)
    return out


@dataclass(frozen=True)
class Space:
    """The pivots of the vectors of one length, and how many of them a vector's list has and a query visits."""

    pivots: np.ndarray
    depth: int
    probes: int


def fit_spaces(rows: DataFrame, growth: float, depth: int, effort: float, pivot_bytes: int) -> dict[int, Space]:
    """A space for each length of vectors. Pivots: growth * sqrt(rows) distinct vectors, the first by hash of the id, as
    far as `pivot_bytes` reach: the index's only sample, and what tasks are sent of it."""
    out = {}
    for d, c in sorted((r["d"], r["count"]) for r in rows.groupBy("d").count().collect()):
        n = int(max(16, min(growth * c**0.5, pivot_bytes // (8 * d), 65_000)))
        got = rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(2 * n).select("v").collect()
        first = list(dict.fromkeys(tuple(r[0]) for r in got))[:n]
        n = len(first)
        out[d] = Space(unit(np.array(first)), min(depth, max(1, n // 2)), max(1, min(round(effort * n**0.75), n)))
    return out


def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    """A binary column whose values are of one length, as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def search(df: DataFrame, *, every: int = 50, k: int = 5, vector: str = "embedding", key: str = "vec_id", growth: float = 2.0, depth: int = 128, posted: int = 3, effort: float = 0.85, rerank: int = 32, block: int = 2048, pivot_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    score is the cosine in double precision of the original vectors; ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components take no part. Vectors of different lengths have no cosine: each length is a space of its
    own, with its own pivots. Of repeated rows of one id the best counts; as a query, an id is its smallest vector; a query never finds its
    own id. Queries that the files give fewer than k candidates are searched again against all rows in blocks, so that small
    tables give all they have.

    A query visits effort * n ** 0.75 of n pivots: each visit moves a query's row, and the rows compared with a query grow a
    little slower than the table.
    """
    rows = usable(df, vector, key)
    spaces = fit_spaces(rows, growth, depth, effort, pivot_bytes)
    if not spaces:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    schema = pa.schema([("vec_id", pa.int64()), ("d", pa.int32()), ("v", pa.binary()), ("perm", pa.binary()), ("files", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = pa.Table.from_batches([b.slice(at, 4096)])
                size = part["d"].to_numpy()
                for d in np.unique(size):
                    rows_ = part.filter(pa.array(size == d))
                    s, ids = spaces[int(d)], rows_["vec_id"].to_numpy()
                    x = rows_["v"].combine_chunks().flatten().to_numpy().astype(kind).reshape(len(ids), d)
                    full = permutation(unit(x), s.pivots, max(s.depth, s.probes))
                    near, perm = full.astype(np.int32), np.ascontiguousarray(full[:, : s.depth])
                    files = [near[i, : s.probes if q % every == 0 else posted] for i, q in enumerate(ids)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), d, np.int32)), pa.array([v.tobytes() for v in x]), pa.array([v.tobytes() for v in perm]), pa.array(files, pa.list_(pa.int32()))], schema=schema)

    idx = table(rows.mapInArrow(index, "vec_id bigint, d int, v binary, perm binary, files array<int>"), "permutations")
    queries = idx.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "d", "perm", "files")).alias("q"))
    queries = table(queries.select(F.col("vec_id").alias("query_id"), "q.*"), "queries")
    posts = idx.select("vec_id", "d", "v", "perm", F.explode(F.slice("files", 1, posted)).alias("file"))
    visits = queries.withColumn("file", F.explode("files")).drop("files")
    # a file's rows and its visitors in blocks: whoever meets meets once
    sizes = table(posts.groupBy("d", "file").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(visits.groupBy("d", "file").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), ["d", "file"]), "files")
    spread = lambda rows_, mine, other, key_: rows_.join(F.broadcast(sizes), ["d", "file"]).withColumn(mine, F.pmod(F.xxhash64(key_), F.col(mine + "s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).drop("blocks", "parts")  # noqa: E731  a row a pivot is broadcast: no more than pivot_bytes allow
    posts, visits = spread(posts, "block", "part", "vec_id"), spread(visits, "part", "block", "query_id")
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    none = pa.Table.from_arrays([pa.array([], f.type) for f in found_schema], schema=found_schema)

    def best_of(qids, qv, ids, vecs, pick: np.ndarray, ok: np.ndarray) -> pa.Table:
        """The k best of each query by exact cosine among its picks (rows of ids); not ok: no candidate."""
        score = np.where(ok, cosine(qv, vecs[pick]), -2.0)
        order = np.lexsort((ids[pick], -score))[:, :k]
        score, found = np.take_along_axis(score, order, 1), np.take_along_axis(ids[pick], order, 1)
        real = score > -2
        return pa.Table.from_arrays([pa.array(np.repeat(qids, real.sum(1))), pa.array(found[real]), pa.array(score[real])], schema=found_schema)

    def visit(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return none
        s = spaces[c["d"][0].as_py()]
        c = c.sort_by("vec_id")  # ties of the footrule to the smaller id
        ids, posts_, vecs = c["vec_id"].to_numpy(), matrix(c["perm"], np.uint16), scaled(matrix(c["v"], kind))
        qids, perms, qv = q["query_id"].to_numpy(), matrix(q["perm"], np.uint16), scaled(matrix(q["v"], kind))
        out = []
        for a in range(0, len(qids), 256):
            some = slice(a, a + 256)
            rule = footrule(perms[some], posts_, len(s.pivots))
            rule[ids[:, None] == qids[None, some]] = 1 << 30
            take = min(max(rerank, len(ids) // 8), len(ids))
            order = (rule.astype(np.int64) << 32 | np.arange(len(ids))[:, None]).T
            pick = np.argpartition(order, take - 1, axis=1)[:, :take] if take < len(ids) else np.broadcast_to(np.arange(len(ids)), order.shape)
            out.append(best_of(qids[some], qv[some], ids, vecs, pick, np.take_along_axis(rule.T, pick, 1) < 1 << 30))
        return pa.concat_tables(out)

    kind_of = "query_id bigint, vec_id bigint, score double"
    together = ["d", "file", "block", "part"]
    found = visits.groupBy(*together).cogroup(posts.groupBy(*together)).applyInArrow(visit, kind_of)
    best = table(_top(found, k), "found")
    # exact way for queries that the files leave short: every row, in blocks
    few = table(queries.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "query_id", "left_anti").select("query_id", "d", "v"), "short")
    asked = few.count()
    if not asked:
        return best
    blocks, parts = max(1, -(-idx.count() // block)), -(-asked // block)
    every_row = idx.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    again = few.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def exact(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [none]
        if len(q) and len(c):
            c = c.sort_by("vec_id")
            ids, vecs, qids, qv = c["vec_id"].to_numpy(), scaled(matrix(c["v"], kind)), q["query_id"].to_numpy(), scaled(matrix(q["v"], kind))
            for a in range(len(qids)):
                other = np.flatnonzero(ids != qids[a])[None]
                out.append(best_of(qids[a : a + 1], qv[a : a + 1], ids, vecs, other, np.ones_like(other, bool)))
        return pa.concat_tables(out)

    together = ["d", "block", "part"]
    more = _top(again.groupBy(*together).cogroup(every_row.groupBy(*together)).applyInArrow(exact, kind_of), k)
    return best.join(few.select("query_id"), "query_id", "left_anti").union(more)


def cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosines of each row of q with its rows of m (queries x picks x components), scaled ones; equal vectors give equal values, whatever
    rows lie beside them."""
    return (m * q[:, None]).sum(2) / (np.sqrt((m * m).sum(2)) * np.sqrt((q * q).sum(1))[:, None])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: a query has at most k rows a block it visits."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
