"""Mixing, audio, WARC, neighbours and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from umbra.llm import audio, mixing, neighbours, warc
from umbra.llm.common import components, forest, join_hot, split_hot


def test_components_against_force(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5900)] + [(7000 + i, 6999 - i) for i in range(900)] + [(9500, i) for i in range(8000, 9400)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_groups_keep_every_pair(spark):
    df = spark.range(100).select(F.lit(7).alias("key"), F.col("id").alias("node")).union(spark.range(3).select(F.lit(8), F.col("id")))
    rows = split_hot(df, "key", "node", 10).collect()
    by = {}
    for r in rows:
        by.setdefault((r["key"], r["tile"]), set()).add(r["node"])
    met = {(a, b) for (k, _), s in by.items() if k == 7 for a in s for b in s if a < b}
    assert len(met) == 100 * 99 // 2 and max(map(len, by.values())) < 60


def test_hot_keys_join_as_others(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 900 + 10).alias("key"), F.col("id").alias("row"))
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    got = join_hot(rows, per, "key", "n", 3000).collect()
    assert sorted(r["row"] for r in got) == list(range(3000)) and all(r["low"] <= r["row"] for r in got)


def test_targets_by_repeated_resharing(spark):
    rng = random.Random(8)
    for _ in range(5):
        totals = {f"s{i}": rng.randint(0, 1000) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 500)}
        names = sorted((n for n in totals if n), key=lambda n: n) + [None]
        w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        left, open_, goal = 1.5 * sum(totals.values()), set(names), {}
        while open_:
            share = {n: left * w[n] / sum(w[x] for x in open_) for n in open_}
            over = {n for n in open_ if share[n] > 2 * totals[n]}
            if not over:
                goal |= share
                break
            for n in over:
                goal[n] = 2.0 * totals[n]
                left -= goal[n]
            open_ -= over
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(totals.items()), "source string, total long")).collect()}
        assert got == pytest.approx(goal, rel=1e-9, abs=1e-6)


def test_mixing_takes_near_targets_and_handles_edges(spark):
    m = mixing.op7(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.expr("taken - 2 * size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.05 * r["g"] and r["over"] <= 0 for r in m)
    df = spark.createDataFrame([(1, None, None, 1), (2, "", "a", 2), (3, "x y\x0bz", None, 3), (3, "x y\x0bz", None, 3), (None, "q", "b", 4)], "doc_id long, text string, source string, size int")
    a, b = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert a == b and len(a) == 5
    assert mixing.mix(df.where("false")).count() == 0
    # rows without an id, equal ones among them, come near their targets too
    null = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c").otherwise(F.concat(F.lit("x y "), F.col("id"))).alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") / 2 % 3).cast("int") + 1).alias("source"))
    got = mixing.mix(null).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect()
    assert sum(r["n"] for r in got) == 6000 and all(abs(r["t"] - r["g"]) < 0.05 * r["g"] for r in got)


def test_mixing_sql_on_equal_and_null_rows(spark, tmp_path):
    import duckdb

    rows = [(None, "a b", "s")] * 40 + [(1, "c d e", None)] * 3 + [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)] + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = df.toPandas().astype({"doc_id": "Int64"})
    want = duckdb.sql(mixing.OP7_SQL).fetchall()
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in mixing.op7(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(documents) == len(rows)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x" * 1000), (2, None, "x" * 1000), (5, "http://b\n", "x" * 1000), (3, "u", ""), (4, "u", None), (6, "u", "é😀" * 700), (6, "u", "é😀" * 700), (7, "u", "once"), (None, "u", "once"), (None, "u", "alone" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(2))
    for chunk in (64, 1 << 20):
        got = sorted(map(tuple, warc.archive(df.where("page_id is null or page_id <> 6"), chunk=chunk).collect()), key=str)
        by = {r[0]: r for r in got}
        sha = lambda s: warc.b32(hashlib.sha1(s.encode()).digest())
        assert by[1] == (1, 1000, sha("x" * 1000), "revisit", 5) and by[5] == (5, 1000, sha("x" * 1000), "response", None)
        assert by[3] == (3, 0, sha(""), "revisit", 4) and by[4][3] == "response" and by[7][3] == "response" and len(got) == 8
    six = warc.archive(df.where("page_id = 6")).collect()
    assert len(six) == 2 and {r["payload_bytes"] for r in six} == {700 * 6}
    assert warc.archive(df.where("false")).count() == 0
    small = {r[0]: r[3] for r in warc.archive(df.where("page_id < 6"), least=1).collect()}
    assert small[3] == small[4] == "response" and small[1] == "revisit"
    for name in ("a.warc", "a.warc.gz"):
        recs = [(warc.header("response", i, "http://x", warc.b32(hashlib.sha1(p).digest()), len(p)), p) for i, p in enumerate((b"", b"abc", b"\r\n\r\nWARC/" * 50000))]
        warc.write_file(str(tmp_path / name), recs)
        back = {}
        for fields, no, last, data in warc.read_file(str(tmp_path / name), 4096):
            back.setdefault(fields["WARC-Record-ID"], []).append(data)
        assert [b"".join(v) for v in back.values()] == [p for _, p in recs]


def test_warc_keeps_long_records_of_one_id_apart(spark):
    rows = [(6, "u", "é😀" * 700), (6, "u", "é😀" * 700), (6, "v", "other" * 300), (None, "u", "long" * 400), (None, "w", "long" * 400), (None, "u", "more" * 500), (7, "u", "x" * 900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((i, len(t.encode()), warc.b32(hashlib.sha1(t.encode()).digest()), "response", None) for i, _, t in rows if i) + sorted((0, len(t.encode()), warc.b32(hashlib.sha1(t.encode()).digest()), "response", None) for i, _, t in rows if not i)
    for chunk in (64, 1 << 20):
        for parts in (1, 3):
            got = [(r[0] or 0, *tuple(r)[1:]) for r in warc.archive(df.repartition(parts), chunk=chunk).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)


def warc_by_force(rows, least):
    top = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None and len(raw) >= least:
            top[raw] = max(top.get(raw, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        to = top.get(raw)
        revisit = to is not None and i != to and len(raw) >= least
        out.append((i, len(raw), warc.b32(hashlib.sha1(raw).digest()), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_warc_against_force_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    rows = [(6, "A"), (6, "B"), (8, "A"), (9, "B"), (None, "once"), (None, "x" * 500), (7, "x" * 500), (None, "q"), (None, "q")]
    rows += [(rng.choice([None, *range(20)]), rng.choice([None, "", "A", "é😀" * 90, "long" * 200, "B" * 64])) for _ in range(200)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).withColumn("top", F.lit(1))
    for chunk, least, parts in ((64, 0, 3), (64, 100, 1), (1 << 20, 0, 5)):
        got = sorted(map(tuple, warc.archive(df.repartition(parts), chunk=chunk, least=least).collect()), key=str)
        assert got == warc_by_force(rows, least)


def test_warc_reader_refuses_broken_chunks():
    head = warc.header("response", 1, None, warc.b32(hashlib.sha1(b"abc").digest()), 3)
    (no, last, data, sha), = warc.chunks_of(head, memoryview(b"abc"))
    assert warc.RecordReader().feed(data, last, sha)["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.RecordReader().feed(data.replace(b"abc", b"abd"), last, sha)


def exact(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            s = sorted((-float((x * y).sum() / (np.sqrt((y * y).sum()) * np.sqrt((x * x).sum()))), i) for i, y in ok if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = exact(rows, 50, 5)
    got = {}
    for r in neighbours.op10(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    nan, inf = float("nan"), float("inf")
    few = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 3.0]), (None, [1.0, 1.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 50), (50, 1, 9), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert neighbours.search(df.where("false")).count() == 0
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = [(r["query_id"], r["vec_id"]) for r in neighbours.search(same, block=500).where("query_id = 50").orderBy("rank").collect()]
    assert got == [(50, i) for i in range(5)]


def test_neighbours_of_mixed_lengths_huge_values_and_repeated_ids(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e200, 0.0]), (3, [1e-300, 0.0]), (50, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (100, [1.0]), (7, [1.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("d", F.lit(1)).withColumn("file", F.lit(1))
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    half = round(0.5**0.5, 12)
    assert got == {0: [(1, 1.0), (7, 1.0), (2, half), (3, half)], 50: [(4, 1.0), (5, 0.0)]}


def test_neighbours_hot_vector_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(2000)]
    want = exact(rows, 50, 5)
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(got[q] == want[q] for q in want if q % 3 == 0)
    assert sum(len(set(got[q]) & set(v)) for q, v in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_footrule_by_definition():
    rng = np.random.default_rng(2)
    lists = np.stack([rng.permutation(20)[:6] for _ in range(50)])
    got = neighbours.footrule(lists[:3], lists, 20)
    for q in range(3):
        for other, f in zip(lists, got[:, q]):
            at = lambda x, p: list(x).index(p) if p in x else 6
            assert f == sum(abs(at(lists[q], p) - at(other, p)) for p in range(20))


def test_audio_aligns_shifted_recordings(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    a = audio.packed(audio.chroma(audio.samples(audio.tones(" ".join(words)))))
    b = audio.packed(audio.chroma(audio.samples(audio.tones(" ".join(words[20:])))))
    off, err = audio.align(a, b, 16)
    assert off == 20 * 3 and err < 0.05
    c = audio.packed(audio.chroma(audio.samples(audio.tones(" ".join(f"v{i}" for i in range(100))))))
    assert audio.align(a, c, 16)[1] > 0.15
    rows = [(1, audio.tones(" ".join(words))), (2, audio.tones(" ".join(words[20:]))), (3, audio.tones(" ".join(f"v{i}" for i in range(100)))), (4, None), (5, b"junk"), (6, audio.tones("")), (7, audio.tones(" ".join(words)))]
    df = spark.createDataFrame(rows, "rec_id long, media binary").withColumn("fp", F.lit(0))
    got = {r["rec_id"]: (r["class_id"], r["component_id"]) for r in audio.alignments(df).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 3), 4: (4, 4), 5: (5, 5), 6: (6, 6), 7: (1, 1)}
    assert audio.alignments(df.where("false")).count() == 0
    assert len(audio.FILTERS) == 16 and all(p + h <= 12 for _, p, h, _ in audio.FILTERS)


def test_audio_short_recordings_have_classes(spark):
    rows = [(1, audio.tones("two words")), (2, audio.tones("two words")), (3, audio.tones("two others")), (4, audio.tones("")), (5, audio.tones("")), (6, None), (7, b"junk")]
    got = {r["rec_id"]: (r["n_ints"], r["class_id"], r["component_id"]) for r in audio.alignments(spark.createDataFrame(rows, "rec_id long, media binary")).collect()}
    assert got == {1: (0, 1, 1), 2: (0, 1, 1), 3: (0, 3, 3), 4: (0, 4, 4), 5: (0, 5, 5), 6: (0, 6, 6), 7: (0, 7, 7)}


def audio_variants():
    """Recordings of 12 to 60 words, and each shifted by half a hop, noisy, cut, and with other words between."""
    rng, noise = random.Random(5), np.random.default_rng(5)
    out = []
    for n in (12, 20, 30, 45, 60) * 3:
        x = audio.samples(audio.tones(" ".join(f"w{rng.randint(0, 400)}" for _ in range(n))))
        loud = np.sqrt((x**2).mean())
        y = audio.samples(audio.tones(" ".join(f"w{rng.randint(0, 400)}" for _ in range(8))))
        out += [x, x[audio.HOP // 2 :], x + noise.normal(0, loud * 0.316, len(x)), x[len(x) // 2 :], np.concatenate([x[: len(x) // 2], y, x[len(x) // 2 :]])]
    return out + [np.tile(out[0][:384], k) for k in (20, 33, 47)]


def brute_components(fps):
    a, b = zip(*[(i, j) for i in range(len(fps)) for j in range(i) if audio.align(fps[i], fps[j], 16)[1] <= 0.15])
    return forest(len(fps), np.array(a), np.array(b)).tolist()


def test_audio_links_all_pairs_that_meet_the_threshold(spark, monkeypatch):
    heard = [audio.samples(wav(np.clip(x, -32768, 32767))) for x in audio_variants()]
    heard += [audio.samples(audio.tones(r["text"])) for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").limit(60).collect()]
    fps = [audio.packed(audio.chroma(np.asarray(x, np.float32))) for x in heard]
    want = brute_components(fps)
    near = [k for k in range(0, 75, 5) if want[k] == want[k + 1] == want[k + 2]]
    assert len(near) >= 13 and len(set(want)) > 40
    rows = [(i, wav(x)) for i, x in enumerate(heard)]
    df = spark.createDataFrame(rows, "rec_id long, media binary")
    for least_block in (50_000, 1000):  # one block, several
        monkeypatch.setattr(audio, "LEAST_BLOCK", least_block)
        got = {r["rec_id"]: r for r in audio.alignments(df).collect()}
        assert [got[i]["component_id"] if len(fps[i]) else i for i in range(len(fps))] == want


@pytest.mark.parametrize("part, pairs", [(1 << 21, 1 << 19), (500, 64)])
def test_audio_linker_by_brute_force(monkeypatch, part, pairs):
    monkeypatch.setattr(audio, "PART", part)
    monkeypatch.setattr(audio, "PAIRS", pairs)
    fps = [x for x in (audio.packed(audio.chroma(np.asarray(x, np.float32))) for x in audio_variants()) if len(x)]
    want, k = brute_components(fps), len(fps) // 2
    assert [audio.unsqueezed(audio.squeezed(x.tobytes()), len(x)).tolist() for x in fps] == [x.tolist() for x in fps]
    whole = audio.Linker(fps, None, 0.15, 16).links()
    halves = audio.Linker(fps[:k], None, 0.15, 16).links() + [(a + k, b + k) for a, b in audio.Linker(fps[k:], None, 0.15, 16).links()] + audio.Linker(fps, k, 0.15, 16).links()
    for links in (whole, halves):
        assert forest(len(fps), *np.array(links).T).tolist() == want
        assert all(audio.align(fps[a], fps[b], 16)[1] <= 0.15 for a, b in links)


def test_audio_linker_holds_integers_once():
    import tracemalloc

    rng = np.random.default_rng(9)
    fps = [rng.integers(0, 2**32, 1000, dtype=np.uint32) for _ in range(4000)]
    tracemalloc.start()
    linker = audio.Linker(fps, 2000, 0.15, 16)
    built = tracemalloc.get_traced_memory()[1]
    assert not linker.links()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert built < 6 * 4_000_000 and peak < 6 * 4_000_000 + (56 << 20)


def test_audio_op8_hears_a_turn_in_one_python_worker(spark, monkeypatch):
    plans = {}

    def table(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return made(df, label)

    made = audio.table
    monkeypatch.setattr(audio, "table", table)
    rows = audio.op8(spark, "/root/testdata/sf0.001").collect()
    assert plans["audio"].count("MapInArrow") == 1
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    heard = {t["conv_id"] * audio.TURNS + t["turn"]: audio.packed(audio.chroma(np.asarray(audio.samples(audio.tones(t["text"])), np.float32))) for t in turns}
    assert {r["rec_id"]: r["n_ints"] for r in rows} == {k: len(x) for k, x in heard.items()}


def wav(x, width=2, rate=4000, channels=1):
    import io
    import wave

    x = np.repeat(np.asarray(x, float), channels)
    raw = {1: lambda: (x / 256 + 128).astype(np.uint8).tobytes(), 2: lambda: x.astype("<i2").tobytes(), 3: lambda: (x * 256).astype("<i4").tobytes(), 4: lambda: (x * 65536).astype("<i4").tobytes()}[width]()
    if width == 3:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :3].tobytes()
    buf = io.BytesIO()
    with wave.open(buf, "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(raw)
    return buf.getvalue()


def test_audio_formats_and_broken_headers():
    x = audio.samples(audio.tones("some words that are rendered as tones for this test of formats and more of them here"))
    want = audio.packed(audio.chroma(x))
    assert len(want)
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            got = audio.packed(audio.chroma(audio.samples(wav(x, width, 4000, channels))))
            assert np.bitwise_count(got ^ want).sum() < 0.02 * 32 * len(want), width
    good = wav(x)
    for rate in (0, 1, 2**31 - 1):
        assert len(audio.samples(good[:24] + rate.to_bytes(4, "little") + good[28:])) == 0
    for cut in range(0, 60, 3):
        audio.samples(good[:cut])


def test_integral_image_filters_by_definition():
    rng = np.random.default_rng(0)
    f = rng.random((40, 12)).astype(np.float32)
    got = audio.packed(f)
    for t in range(len(got)):
        want = 0
        for i, (kind, p, h, w) in enumerate(audio.FILTERS):
            box = f[t : t + w, p : p + h].astype(float)
            one = {0: box[:, : h // 2].sum(), 1: box[: w // 2].sum(), 2: box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum(), 3: box[w // 3 : w - w // 3].sum()}[kind]
            v = np.log((one + 0.05) / (box.sum() - one + 0.05))
            level = int(v > -0.7) + int(v > 0) + int(v > 0.7)
            want |= (level ^ (level >> 1)) << (2 * i)
        assert want == int(got[t])


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision, on the stage's own input."""
    import corpus_pipeline as cp
    from umbra.llm import bpe, secrets, toxicity
    from umbra.llm.common import crc

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = cp.toxic_out(spark, docs, SF).cache()
    model = toxicity.fit(docs.where(crc(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r["doc_id"] for r in docs.collect() if toxicity.probability(min(30.0, sum(x[2] for x in toxicity.scan(r["text"], model)[1])), model) < 0.5}
    assert {r["doc_id"] for r in a.collect()} == keep and 800 < len(keep) < 1000 and a.columns == list(cp.COLUMNS)
    b = cp.near_copies_out(spark, a, SF).cache()
    texts = [r["text"] for r in b.collect()]
    assert len(texts) == len(set(texts)) and {r["text"] for r in a.collect()} >= set(texts) and len(texts) > 0.7 * len(keep)
    c = cp.secrets_out(spark, b, SF).cache()
    before = {r["doc_id"]: r["text"] for r in b.collect()}
    assert {r["doc_id"]: r["text"] for r in c.collect()} == {d: secrets.redact(t, secrets.scan(t).every) for d, t in before.items()}
    d = cp.mixed(spark, c, SF).cache()
    assert 1.2 * F_sum(c) < F_sum(d) < 1.8 * F_sum(c) and d.columns == list(cp.COLUMNS)
    e = cp.encoded(spark, d, SF)
    assert e.count() == d.count() and e.where("n_tokens = 0").count() == 0
    assert bpe.public(d.limit(1)).first()["ids"]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]


def test_pipeline_near_copies_keep_unnamed_rows_and_texts_of_one_id(spark):
    import corpus_pipeline as cp

    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, word(1)), (3, word(1)), (None, word(1)), (5, word(2)), (5, word(3)), (5, word(3)), (None, word(4)), (None, word(4)), (None, word(5)), (9, None), (8, ""), (2, word(2) + " tail")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_copies_out(spark, docs, SF).collect()), key=str)
    assert got == sorted([(3, word(1)), (2, word(2) + " tail"), (5, word(3)), (None, word(4)), (None, word(5)), (8, "")], key=str)
    assert cp.near_copies_out(spark, docs.limit(0), SF).count() == 0


def test_pipeline_near_copies_are_exactly_those_of_08(spark):
    """The stage against components over exact similarities, on texts from 0.55 to 0.95 alike and a dense group."""
    import corpus_pipeline as cp
    from umbra.llm import simhash

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for g in range(240):
        base = [word() for _ in range(rng.choice((30, 120, 300)))]
        cut = int(len(base) * rng.uniform(0.03, 0.25))
        texts += [" ".join(base), " ".join(base[cut:] + [word() for _ in range(cut)])]
    base = [word() for _ in range(200)]
    for c in range(300):  # one large group: some of it under 0.8 to each other
        w = list(base)
        for i in rng.sample(range(200), rng.choice((1, 4, 8))):
            w[i] = word()
        texts.append(" ".join(w))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in cp.near_copies_out(spark, docs, SF).collect()}
    assert not want - got and len(got - want) <= 1


def F_sum(df):
    return df.select(F.sum(mixing.words(F.col("text")))).first()[0]
