"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Shingles' XXH64 hashes vote on each bit. Identical fingerprints are one class. Classes are keyed so that near ones
meet: for a small radius r on 64 bits, all choices of (blocks - r) out of `blocks` bit blocks, which by the pigeonhole
principle lose no pair; for wide fingerprints and radii, `bands` samples of bits, or MinHash keys of the sets of shingles where an exact
similarity decides. Rows of a key are sorted by
population count and compared in tiles by exclusive-or and bit counts; tile pairs whose population counts differ
beyond the radius are skipped. Hot keys are dealt to pairs of tiles (common.split_hot). Only a spanning forest of
each key's links leaves a task.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, join_hot, map_rows, split_hot, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TILE = 512
#: Odd multipliers by the golden ratio's bits; one for each further 64-bit lane of a wide fingerprint.
LANES = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(64)]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words of the text in lower case (A-Z only), repeats included."""
    words = WORD.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([h(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` words of 64 bits; a bit is set if over half of the hashes set it. No hash: zero."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for i in range(lanes):
        h = hashes
        if i:
            h = h * LANES[i]
            h = (h ^ (h >> np.uint64(31))) * LANES[i + 1]
            h ^= h >> np.uint64(29)
        n = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):  # bounded memory for very long texts
            n += np.unpackbits(np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(n * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def exact_keys(fp: np.ndarray, radius: int, blocks: int) -> list[int]:
    """Keys of which any two 64-bit fingerprints within the radius share one: any pair agrees in blocks - radius blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    out, x = [], int(fp[0])
    for n, keep in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edge[i + 1]) - (1 << edge[i]) for i in keep)
        out.append(((x & mask) * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) & (2**63 - 1) if mask != 2**64 - 1 else x & (2**63 - 1))
    return out


def band_bits(bits: int, bands: int, width: int) -> np.ndarray:
    return np.stack([np.random.default_rng([7, i]).choice(bits, width, replace=False) for i in range(bands)])


def band_keys(fp: np.ndarray, chosen: np.ndarray) -> list[int]:
    b = np.unpackbits(fp.view(np.uint8), bitorder="little")[chosen].astype(np.int64)
    return ((b << np.arange(chosen.shape[1])).sum(1) + (np.arange(len(chosen)) << 40)).tolist()


def set_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """MinHash keys: two sets of similarity j share each of them with the chance j ** rows, unrelated ones none."""
    if not len(hashes):
        return []
    odd = np.random.default_rng(11).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        x = hashes[None, at : at + 4096] * odd[:, None]
        x ^= x >> np.uint64(32)
        x *= odd[::-1, None]
        np.minimum(low, x.min(1), out=low)
    return [(xxhash.xxh3_64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), i) >> 1) for i in range(bands)]


def near_in_tiles(fps: np.ndarray, radius: int, i: int, ie: int, j: int, je: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs x < y of rows of the tiles i:ie and j:je within the radius, and their distances."""
    apart = np.zeros((ie - i, je - j), np.int32)
    for w in range(fps.shape[1]):
        apart += np.bitwise_count(fps[i:ie, w, None] ^ fps[None, j:je, w])
    x, y = np.nonzero(apart <= radius)
    up = x + i < y + j
    x, y = x[up], y[up]
    return x + i, y + j, apart[x, y]


def near_in_groups(group: np.ndarray, fps: np.ndarray, pc: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group within the radius; of a dense tile a forest of them. Rows are sorted by group, then
    population count."""
    cut = np.flatnonzero(np.diff(group)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(group)]
    size = last - first
    a_all, b_all = [], []

    def keep(a, b):
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= radius
        a_all.append(a[near])
        b_all.append(b[near])

    end = np.repeat(last, size)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    for d in range(1, 64):  # many small groups at once: the d-th diagonal of each group's only tile
        small = small[small + d < end[small]]
        small = small[pc[small + d] - pc[small] <= radius]
        if not len(small):
            break
        keep(small, small + d)
    for f, l in zip(first[size > 64], last[size > 64]):
        for i in range(f, l, TILE):
            ie = min(i + TILE, l)
            for j in range(i, l, TILE):
                je = min(j + TILE, l)
                if pc[j] - pc[ie - 1] > radius:
                    break  # sorted: all later tiles are farther
                x, y, _ = near_in_tiles(fps, radius, i, ie, j, je)
                if len(x) > 4 * (ie - i + je - j):  # a forest of a dense tile says the same
                    lab = forest(ie - i + je - j, x - i, y - j + (ie - i if i != j else 0))
                    of = np.r_[np.arange(i, ie), np.arange(j, je)] if i != j else np.arange(i, ie)
                    x = of[lab[: len(of)]]
                    y = of
                    x, y = x[x != y], y[x != y]
                a_all.append(x)
                b_all.append(y)
    return (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (np.zeros(0, np.int64),) * 2


def _by_group(link, least: int = 50_000):
    """A mapInArrow function: link(rows) of whole (key, tile) groups, about `least` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < least:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key, tile = rows.column("key").to_numpy(), rows.column("tile").to_numpy()
            open_ = np.flatnonzero((key != key[-1]) | (tile != tile[-1]))
            if not len(open_):
                continue  # one group so far; groups have about two tiles' rows at most
            cut = int(open_[-1]) + 1
            yield link(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            n = len(rows) - cut
        if n:
            yield link(pa.Table.from_batches(held).combine_chunks())

    return run


def _linker(radius: int, lanes: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(rows: pa.Table) -> pa.RecordBatch:
        key, tile, node, pc = (rows.column(n).to_numpy() for n in ("key", "tile", "node", "pc"))
        fps = np.stack([rows.column(f"f{i}").to_numpy() for i in range(lanes)], 1).view(np.uint64)
        new = np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]
        a, b = near_in_groups(np.cumsum(new), fps, pc, radius)
        ids, at = np.unique(node, return_inverse=True)
        lab = forest(len(ids), at[a], at[b])
        linked = np.flatnonzero(lab != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[lab[linked]])], schema=out)

    return _by_group(link)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `least`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= least * (len(a) + len(b) - both)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a has in common with each of b: products of 0-1 matrices over the values in both."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    (va, ra), (vb, rb) = flat(a), flat(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)

    def ones(values, rows, n, some):
        at = np.searchsorted(some, values)
        ok = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == values)
        m = np.zeros((n, len(some)), np.float32)
        m[rows[ok], at[ok]] = 1
        return m

    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        out += ones(va, ra, len(a), some) @ ones(vb, rb, len(b), some).T
    return out


def similar_forest(fps: np.ndarray, pc: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> np.ndarray:
    """The smallest row reachable from each row, over pairs within the radius whose sets have a similarity of `least` or
    more. Rows are sorted by population count. Pairs of rows that are connected already are not compared."""
    n = len(fps)
    label, size = np.arange(n), np.array([len(x) for x in sets])

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(0, n, TILE):
        ie = min(i + TILE, n)
        for j in range(i, n, TILE):
            je = min(j + TILE, n)
            if pc[j] - pc[ie - 1] > radius:
                break
            x, y, apart = near_in_tiles(fps, radius, i, ie, j, je)
            ok = np.minimum(size[x], size[y]) + 1e-9 >= least * np.maximum(size[x], size[y])
            x, y, apart = x[ok], y[ok], apart[ok]
            if len(x) > 4 * (ie - i + je - j):  # a dense tile: all its similarities at once
                both = shared_counts(sets[i:ie], sets[j:je])[x - i, y - j]
                ok = both + 1e-6 >= least * (size[x] + size[y] - both)
                x, y = x[ok], y[ok]
                label = forest(n, np.r_[np.arange(n), x], np.r_[label, y])
                continue
            for k in np.argsort(apart, kind="stable"):
                a, b = root(x[k]), root(y[k])
                if a != b and similar(sets[x[k]], sets[y[k]], least):
                    label[max(a, b)] = min(a, b)
    return forest(n, np.arange(n), label)


def _judge(radius: int, lanes: int, least: float):
    """Of whole (key, tile) groups with their sets: links to the first similar row reachable."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(rows: pa.Table) -> pa.RecordBatch:
        key, tile, node, pc = (rows.column(n).to_numpy() for n in ("key", "tile", "node", "pc"))
        fps = np.stack([rows.column(f"f{i}").to_numpy() for i in range(lanes)], 1).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1, len(key)]
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            lab = similar_forest(fps[lo:hi], pc[lo:hi], sets[lo:hi], radius, least)
            own = np.flatnonzero(lab != np.arange(hi - lo))
            a.append(node[lo:hi][own])
            b.append(node[lo:hi][lab[own]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=out)

    return _by_group(link, 4096)


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component): the smallest id of each node's component."""
    named = table(classes.select("node", "low").join(roots, "node"), "named")
    per_root = named.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n"))
    return join_hot(named, per_root, "root", "n", named.count()).select("node", "component")


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: float = 0.8, shingle: int = 5, lanes: int = 4, radius: int = 64, bands: int = 16, band_rows: int = 3, most: int = 1024) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links): linked are texts whose sets of shingles have a Jaccard
    similarity of `least` or more, computed exactly; texts without a word have the same, empty set.

    Candidates: fingerprints of the sets (repeats count once) within `radius`, of sets that share one of `bands` MinHash keys of
    `band_rows` values each: at 0.8 a pair shares none with a chance of 0.488 ** 16, one in 100 000. The components of these
    candidate links are the groups within which the sets travel, once each (large groups are dealt to pairs of tiles), and
    are compared: in tiles by fingerprint, and each pair within the radius that is not connected already by its sets. So
    no pairs leave a task, only a forest of the links.
    """

    def start():
        def f(c):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in c["t"]]
            fps = [fingerprint(x, lanes) for x in sets]
            return {"id": c["id"], "th": c["th"], "node": [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets], "size": [len(x) for x in sets], "fp": [x.view(np.int64).tolist() for x in fps], "pc": [int(np.bitwise_count(x).sum()) for x in fps], "keys": [set_keys(x, bands, band_rows) for x in sets]}

        return f

    def shingles():
        def f(c):
            return {"node": c["node"], "set": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in c["t"]]}

        return f

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    made = table(map_rows(texts, f"id {kind}, th bigint, node bigint, size int, fp array<bigint>, pc int, keys array<bigint>", start), "simhash")
    low = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    classes = made.groupBy("node").agg(F.min(low).alias("low"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("size", "fp", "pc", "keys")])
    classes = table(classes.select("node", F.col("low.id").alias("low"), F.col("low.th").alias("th"), "rows", "size", "pc", *[F.col("fp")[i].alias(f"f{i}") for i in range(lanes)], "keys"), "classes")
    prints = [f"f{i}" for i in range(lanes)]
    # keys alone meet first: those of one class are left out
    keyed = classes.where("size > 0").select("node", F.explode("keys").alias("key"))
    shared = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    keyed = join_hot(keyed, shared, "key", "c", keyed.count()).join(classes.select("node", "pc", *prints), "node")
    tiles = split_hot(table(keyed, "keyed"), "key", "node", 4 * most)
    maybe = components(tiles.repartition("key", "tile").sortWithinPartitions("key", "tile", "pc", "node").mapInArrow(_linker(radius, lanes), "a bigint, b bigint"), "simhash-groups")
    group = table(maybe.join(classes.drop("keys", "rows"), "node"), "groups")
    # the texts are by far the larger side: merged at every size, so that the plan is the same everywhere
    one = texts.hint("merge").join(group.select("node", "low", F.col("th").alias("_th")), (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("low"))).select("node", "t")
    sets = map_rows(one.dropDuplicates(["node"]), "node bigint, set binary", shingles)
    held = table(group.select("node", F.col("root").alias("key"), "pc", *prints).join(sets, "node"), "sets")
    judged = split_hot(held, "key", "node", most).repartition("key", "tile").sortWithinPartitions("key", "tile", "pc", "node")
    roots = components(judged.mapInArrow(_judge(radius, lanes, least), "a bigint, b bigint"), "simhash-cc")
    linked = _named(classes, roots)
    of_class = classes.select("node", "low", "rows").join(linked, "node", "left").select("node", F.coalesce("component", "low").alias("component_id"), "rows")
    return join_hot(made.select(F.col("id").alias("doc_id"), "node"), table(of_class, "of-class"), "node", "rows", made.count()).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, lanes: int = 1, radius: int = 2, blocks: int = 4, bands: int = 0, band_width: int = 14, most: int = 4096) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links of at most `radius` bits).

    bands = 0: exact keys on one lane (blocks > radius); else `bands` samples of `band_width` bits of all lanes.
    One row per input row; null and empty texts have fingerprint zero and link like any other; rows with a null id
    keep a null id, and never name a component unless no other row of it has an id. Repeated ids join the components of
    their rows' fingerprints separately. Hot groups: exact copies meet as one class, see split_hot for near ones.
    """
    chosen = band_bits(64 * lanes, bands, band_width) if bands else None

    def start():
        def f(c):
            fps = [fingerprint(shingle_hashes(t, shingle), lanes) for t in c["t"]]
            keys = [band_keys(x, chosen) if bands else exact_keys(x, radius, blocks) for x in fps]
            return {"id": c["id"], "fp": [x.view(np.int64).tolist() for x in fps], "pc": [int(np.bitwise_count(x).sum()) for x in fps], "keys": keys}

        return f

    kind = docs.schema[key].dataType.simpleString()
    made = map_rows(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), f"id {kind}, fp array<bigint>, pc int, keys array<bigint>", start)
    made = table(made, "simhash")
    # a class's node: its fingerprint itself on one lane, a 63-bit hash of it on several
    node = F.col("fp")[0] if lanes == 1 else F.xxhash64(*[F.col("fp")[i] for i in range(lanes)])
    classes = table(made.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), F.first("pc").alias("pc"), F.first("keys").alias("keys")).withColumn("node", node), "classes")
    keyed = classes.select("node", "pc", *[F.col("fp")[i].alias(f"f{i}") for i in range(lanes)], F.explode("keys").alias("key"))
    keyed = split_hot(keyed, "key", "node", most)
    links = keyed.repartition("key", "tile").sortWithinPartitions("key", "tile", "pc", "node").mapInArrow(_linker(radius, lanes), "a bigint, b bigint")
    roots = components(links, "simhash-cc")
    linked = _named(classes, roots)
    of_class = classes.select("node", "fp", "low", "rows").join(linked, "node", "left").select("fp", F.coalesce("component", "low").alias("component_id"), "rows")
    text_of = F.concat(*[F.lpad(F.lower(F.hex(F.col("fp")[i])), 16, "0") for i in range(lanes)])
    named = join_hot(made.select(F.col("id").alias("doc_id"), "fp"), table(of_class, "of-class"), "fp", "rows", made.count())
    return named.select("doc_id", text_of.alias("fingerprint"), "component_id")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
