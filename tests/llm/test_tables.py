"""Sharding, mixing, URL rules, nearest neighbours and the pipeline."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import hnsw, kd_shards, mixing, registry, url_cascade

SF = "/root/testdata/sf0.01"
FULL = "doc_id long, text string, lang string, source string"


def _docs(seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["hot"] * 4 + ["a", "b", None])) for i in range(n)]
    return rows + [(n + i, "the same text again and again", "en", "hot") for i in range(200)] + [(5000, None, None, None), (5001, "", "en", "a"), (7, rows[7][1], "en", "hot"), (None, "no id", "en", "b")]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(_docs(), FULL).withColumns({"shard": F.lit("x"), "size": F.lit("y")}).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_shards_are_even_gapless_and_complete(spark, small):
    rows = kd_shards.op2_kd_shards(spark, small).collect()
    docs = _docs()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes, largest = [sum(r["size"] for r in x) for x in by.values()], max(r["size"] for r in rows)
    # each of six cuts is at most one row off
    assert max(sizes) - min(sizes) <= 4 * largest


def test_shards_of_a_target_size_and_of_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    total = sum(len((t or "").encode()) + 16 for _, t, *_ in _docs())
    assert kd_shards.assign(docs, target_bytes=total // 7 + 1).select("shard").distinct().count() == 7
    assert kd_shards.assign(docs.limit(0), 40).collect() == []
    kept = kd_shards.assign(docs, 3, keep=["shard", "text", "size"])
    assert kept.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "shard", "text", "size"]
    assert {r[5] for r in kept.collect()} == {"x"}


def test_shards_divide_repeated_rows_and_keep_small_groups_together(spark):
    equal = kd_shards.assign(spark.createDataFrame([(7, "one text", "en", "s")] * 400 + [(None, None, None, None)] * 40, FULL), 11).collect()
    sizes = Counter()
    for r in equal:
        sizes[r.shard] += r["size"]
    assert set(sizes) == set(range(11)) and max(sizes.values()) - min(sizes.values()) <= 2 * 24
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randint(5, 200))), rng.choice("ab"), rng.choice("xyz")) for i in range(3000)]
    rows += [(5000 + 3 * i + j, rows[i][1], rng.choice("ab"), rng.choice("xyz")) for i in range(100) for j in range(3)]
    got = kd_shards.assign(spark.createDataFrame(rows, FULL), 8).collect()
    texts, at = {r[0]: r[1] for r in rows}, {}
    for r in got:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in at.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 1.06 * min(sizes.values())


def _tree(rows, leaves, widths, base, out):
    """Rows of (size, (at...), tie, key) into leaves, by definition: sort along the widest dimension, cut at the nearer side of the row that holds the goal."""
    if leaves == 1 or not rows:
        for r in rows:
            out[r[3]] = base
        return out
    top = [r[1] for r in rows]
    digit = lambda v: v >> 45
    spans = [(max(digit(x[i]) for x in top) - min(digit(x[i]) for x in top)) / widths[i] for i in range(len(widths))]
    dim = max(range(len(widths)), key=lambda i: (spans[i], -i))
    rows = sorted(rows, key=lambda r: (r[1][dim], r[2]))
    goal, upto, cut = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    for cut, r in enumerate(rows):
        if upto + r[0] > goal:
            cut += (goal - upto) * 2 > r[0]
            break
        upto += r[0]
    _tree(rows[:cut], leaves // 2, widths, base, out)
    return _tree(rows[cut:], leaves - leaves // 2, widths, base + leaves // 2, out)


@pytest.mark.parametrize("leaves,hot", [(7, 0), (12, 300), (19, 50)])
def test_leaves_are_those_of_the_tree_by_definition(spark, monkeypatch, leaves, hot):
    monkeypatch.setattr(kd_shards, "FINE", 0)
    monkeypatch.setattr(kd_shards, "GROUP", 0)
    monkeypatch.setattr(kd_shards, "SMALL", 4 if leaves == 19 else 4096)
    rng = random.Random(leaves)
    at = lambda: rng.randrange(1 << 15) << 45 | rng.randrange(1 << 45)
    rows = [(rng.randint(16, 400), at() if i >= hot else 5, at() if i % 3 else 77, rng.randrange(1 << 60), i) for i in range(500)]
    got = {r.key: r.shard for r in kd_shards.leaved(spark.createDataFrame(rows, "size long, at_a long, at_b long, tie long, key long"), ["a", "b"], leaves).collect()}
    widths = [max(1, max(r[i] >> 45 for r in rows) - min(r[i] >> 45 for r in rows)) for i in (1, 2)]
    assert got == _tree([(s, (a, b), t, k) for s, a, b, t, k in rows], leaves, widths, 0, {})


def _sql(query, path):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        try:
            con.sql(f"create view {name} as select * from read_parquet('{path}/{name}.parquet')") if not path.startswith("/tmp") else con.sql(f"create view {name} as select * from read_parquet('{path}/{name}.parquet/*.parquet')")
        except duckdb.Error:
            pass
    return con.sql(query)


def test_mix_matches_sql_and_its_targets(spark, small):
    for path in (SF, small):
        got = [tuple(r) for r in mixing.op10_mixing(spark, path).collect()]
        cur = _sql(mixing.SQL, path)
        names = [c for c in cur.columns]
        want = [tuple(r[names.index(k)] for k in ("doc_id", "size", "source_size", "target", "taken")) for r in cur.fetchall()]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)
        assert all(0 <= t <= 3 * s for _, s, _, _, t in got)
        by = {}
        for _, _, s, target, taken in got:
            by.setdefault((s, target), []).append(taken)
        assert all(abs(sum(v) - target) <= 0.02 * target + 50 for (s, target), v in by.items())
        words, mixed = sum(s for _, s, *_ in got), sum(r[4] for r in got)
        assert abs(mixed - words) <= 0.02 * words


def test_water_filling(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(1480 * 2 / 3) and sum(got.values()) == pytest.approx(1510)


def test_schedule_prefixes_keep_the_weights(spark):
    sources = spark.createDataFrame([(1, "a", 100, 500.0), (2, "b", 100, 300.0), (3, "c", 100, 200.0)], "source_no int, source string, source_size long, target double")
    rows = sorted(mixing.schedule(sources, 1000, 1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(1000))
    for n in (50, 200, 1000):
        share = Counter(r.source_no for r in rows[:n])
        assert all(abs(share[i] - n * w) <= 4 for i, w in ((1, 0.5), (2, 0.3), (3, 0.2)))
    for i in (1, 2, 3):
        assert [r["rank"] for r in rows if r.source_no == i] == list(range(sum(r.source_no == i for r in rows)))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], FULL)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], FULL)).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, a) for a, h, p in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else (0, None, "allow")
    return host, path, rule[1], rule[2]


def test_urls_match_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.www.example.com", "com", "xcom", "net", "a.net", "example.net.", ".com", "", "É.com", "example.com:80", "org"]
    urls = [rng.choice(["http://", "https://", "//", "", "x://y://"]) + rng.choice(hosts) + rng.choice(["", "/", "/en/", "/en", "/en/x?a=/es/", "/es/#", "?/en/", "#x", "/fr/1\n2", "/EN/"]) for _ in range(600)] + [None, "", "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "keys": F.lit(2), "best": F.lit(3), "__keys": F.lit(4)})
    assert url_cascade.judge_urls(pages).columns == ["page_id", "url", "keys", "best", "__keys", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages).collect()}
    assert got == {i: _judge(u) for i, u in enumerate(urls)}
    assert url_cascade.judge_urls(pages.limit(0)).collect() == []
    in_parts = url_cascade.judge_urls(pages, part_keys=2).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in in_parts} == got
    odd = spark.createDataFrame([(None, "http://a.net/es/" + "x" * 300_000), (None, None), (1, "http://a.net/es/"), (1, "http://a.net/es/")], "page_id long, url string")
    assert sorted(r.verdict for r in url_cascade.judge_urls(odd).collect()) == ["allow", "block", "block", "block"]


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"k{i}" for i in range(0, 3000, 10)]
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    c = url_cascade.Cascade(universe, listed)
    assert len(c.levels) > 1
    assert {r.key for r in universe.where(c.holds(F.col("key"))).collect()} == set(listed)
    assert url_cascade.Cascade(universe, []).levels == []


def _answers(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_neighbours_recall_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 16)).round(3).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000 + i, [float(x) for x in v[0]]) for i in range(30)]
    odd = [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] * 16), (7150, [float("inf")] + [1.0] * 15), (7200, [None] + [1.0] * 15), (None, [1.0] * 16), (7250, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    monkeypatch.setattr(hnsw, "UNIT_QUERIES", 20)
    index = hnsw.build_index(df, copies=6, shard_points=300)
    assert index.shards.count() > 10
    got = _answers(hnsw.nearest(index, index.points.where("id % 50 = 0"), 5).collect())
    ids = np.array([i for i, _ in rows])
    m = np.array([x for _, x in rows], np.float32).astype(np.float64)
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        best = set(ids[np.lexsort([ids, -score.round(12)])[:5]].tolist())
        mine = got[int(ids[q])]
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        assert [s for *_, s in mine] == pytest.approx([float(unit[q] @ unit[np.flatnonzero(ids == i)[0]]) for _, i, _ in mine], abs=1e-12)
        hits, total = hits + len(best & {i for _, i, _ in mine}), total + 5
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hits / total >= 0.95
    assert [i for _, i, _ in got[0]] == [5000, 5001, 5002, 5003, 5004]
    index = hnsw.build_index(df.limit(0), copies=6)
    assert hnsw.nearest(index, index.points).collect() == []


def test_neighbours_are_rows_not_ids(spark):
    a, b, c, d = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.9, 0.2]
    df = spark.createDataFrame([(50, a), (50, b), (50, b), (1, c), (2, d), (100, b)], "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, copies=3)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hnsw.nearest(index, index.points.where("id % 50 = 0"), 2).collect()]
    cos = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    # the row (50, a): its id's other rows are candidates; (50, b) twice: each has its twin, then 100; (100, b): both rows of 50
    want = [(50, 1, 1, cos(a, c)), (50, 2, 2, cos(a, d))] + 2 * [(50, 1, 50, 1.0), (50, 2, 100, 1.0)] + [(100, 1, 50, 1.0), (100, 2, 50, 1.0)]
    assert sorted(got) == sorted(want)


def test_neighbours_of_huge_tiny_and_short_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e300, 0.0]), (2, [1e-300, 1e-300]), (3, [5e-324, 0.0]), (4, [-1e200, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = hnsw.build_index(df, copies=3)
    got = _answers(hnsw.nearest(index, index.points.where("id % 50 = 0"), 2).collect())
    assert [(i, round(s, 9)) for _, i, s in got[0]] == [(2, 1.0), (1, round(0.5**0.5, 9))]
    assert [(i, round(s, 9)) for _, i, s in got[50]] == [(51, round(10 / 14, 9))]


def test_cells_route_clustered_vectors_to_few(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 24)) * 4
    sample = hnsw._unit(centres[rng.integers(0, 64, 6000)] + rng.normal(size=(6000, 24)) * 0.2)
    cells = hnsw.Cells(sample, 5)
    assert cells.visits <= 8 and np.bincount(cells.of(sample), minlength=32).max() <= 2 * 6000 / 32
    assert hnsw.Cells(hnsw._unit(rng.normal(size=(6000, 24))), 3).visits >= 6


def test_pipeline_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5)], docs.schema)
    now = docs.unionByName(extra).withColumn("score", F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert after.columns == now.columns
        kept[name] = {r.doc_id for r in after.collect()}
        now = after
    assert kept["language"] == {r.doc_id for r in docs.collect()}
    copies = Counter(r.text for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(texts[d] for d in kept["near_copies"]).most_common(1)[0][1] == 1 and any(n > 1 for n in copies.values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d in kept["near_copies"] if any(x in texts[d] for x in items)}
    assert kept["decontamination"] == kept["near_copies"] - leaked
    assert kept["near_copies"] <= kept["language"] and len(kept["mixing"]) > 0.5 * len(kept["decontamination"]) and kept["sharding"] == kept["mixing"]


def test_pipeline_stages_on_odd_rows_and_none(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    some = docs.where("text is not null and lang is not null").first()
    odd = [(None, "a plain line of words that no other document has in it", "en", None, 1), (None, "a plain line of words that no other document has in it", "en", None, 1), (None, None, None, None, None),
           (7001, some.text, some.lang, some.source, 1), (7002, "the first of two rows with one number and different words", "en", "s", 1), (7002, "quite another text under the very same number as before", "en", "s", 1),
           (7003, "", "en", "s", 0), (7004, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 2)]
    clash = {c: F.lit(i) for i, c in enumerate(("row", "copies", "key", "lettered", "size", "shard", "slot", "gone_key", "component_id", "__lettered", "__copies"))}
    now = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, now.limit(0), SF)
        assert empty.collect() == []
        after = stage(spark, now, SF)
        if name != "sharding":
            assert after.columns == now.columns and empty.columns == now.columns
            assert {r.copies for r in after.select("copies").collect()} <= {1}
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r.doc_id, r.text) for r in after.collect()] if name != "sharding" else []
        if name == "language":
            assert (None, None) not in rows and sum(d is None for d, _ in rows) == 2 and {7002, 7004} <= {d for d, _ in rows} and 7003 not in {d for d, _ in rows}
        if name == "near_copies":
            assert sum(d is None for d, _ in rows) == 1 and [d for d, _ in rows].count(7002) == 2 and 7001 not in [d for d, _ in rows]
        now = after


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())
