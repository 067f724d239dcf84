"""Suffix-array dedup and SimHash against their definitions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from strandlake.llm import simhash, suffix_dedup
from strandlake.llm.components import components

DOCS = "doc_id long, text string"


def _repetitive(seed: int, n: int = 120):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("ab cd") for _ in range(k))
    passages = [noise(120) for _ in range(5)]
    docs = []
    for i in range(n):
        text = noise(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 60)
            text += rng.choice(passages)[a : rng.randint(a, 120)] + noise(rng.randint(0, 9))
        docs.append((i * 7 % n, text))
    return docs + [(200, docs[3][1]), (201, ""), (202, "é" * 200), (203, "xé" * 100 + "a" * 300), (204, "a" * 400), (205, "a" * 49)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_match_brute_force_over_many_blocks(spark, seed):
    docs = _repetitive(seed)
    df = spark.createDataFrame(docs + [(206, None)], DOCS).withColumnsRenamed({}).selectExpr("*", "'x' as block", "1 as id")
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(df, 50, 24, block_bytes=3000, bucket_bytes=4000).collect()}
    want = suffix_dedup.brute_spans([(d, t.encode()) for d, t in docs] + [(206, b"")], 50)
    assert {d: list(r.spans) for d, r in got.items()} == want
    for d, t in docs:
        raw, kept, p = t.encode(), b"", 0
        for s, e in zip(want[d][::2], want[d][1::2]):
            kept, p = kept + raw[p:s], e
        assert got[d].kept_sha256 == hashlib.sha256(kept + raw[p:]).hexdigest()


def test_spans_of_repeated_ids_and_empty_tables(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(90))
    got = suffix_dedup.repeated_spans(spark.createDataFrame([(5, text), (5, text), (None, text), (7, text)], DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 5, 0), (False, 5, 0), (False, 7, 90), (True, 0, 90)]
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS)).collect() == []


def test_the_largest_id_is_an_id_and_long_and_hot_texts_are_whole(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    own = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    top = (1 << 63) - 1
    docs = [(i, own(200) + passage + own(50)) for i in range(60)] + [(100, own(150_000) + passage + own(10)), (101, (passage[:70] + "|") * 400), (top, passage), (None, passage), (None, own(80))]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(docs, DOCS), block_bytes=9000, bucket_bytes=2500).collect()
    want = suffix_dedup.brute_spans([(top if d is None else d, t.encode()) for d, t in docs[:-1]], 50)
    spans = {r.doc_id: list(r.spans) for r in got if r.doc_id is not None}
    assert spans == want and sum(r.doc_id is None for r in got) == 2 and spans[top] == [0, 300]
    assert sorted(len(r.spans) for r in got if r.doc_id is None) == [0, 2]


def test_a_block_sends_one_entry_for_each_context():
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200)).encode()
    texts = [passage] * 50
    offsets = np.arange(51) * 200
    a = suffix_dedup.Anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, 50, 24)
    e = suffix_dedup._Entries(a, 4)
    assert len(a.at) == 50 * len(e.head) and (a.doc[e.head] == 0).all() and e.cut[-1] == len(e.head)


def _closures(left, right, length):
    """Maximal repeats around an anchor, from all pairs: members, bytes before, bytes after."""
    n, common = len(left), lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = set()
    for i in range(n):
        for x in range(len(left[i]) + 1):
            y = length - x
            if y > len(right[i]):
                continue
            same = [j for j in range(n) if left[j][:x] == left[i][:x] and len(left[j]) >= x and right[j][:y] == right[i][:y] and len(right[j]) >= y]
            if len(same) > 1:
                out.add((tuple(same), min(common(left[i], left[j]) for j in same if j != i), min(common(right[i], right[j]) for j in same if j != i)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeat_groups_are_maximal_with_all_occurrences(seed):
    rng = random.Random(seed)
    pick = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    anchor, left, right = b"zzzz", [], []
    for _ in range(60):
        left.append(pick(rng.choice([6, 6, 6, 3])))
        right.append((anchor + pick(6))[: rng.choice([10, 10, 8])])
    pad = lambda x, n: np.frombuffer(x.ljust(n, b"\0"), np.uint8)
    groups = suffix_dedup.repeat_groups(np.zeros(60, np.uint32), np.stack([pad(x, 6) for x in left]), np.stack([pad(x, 10) for x in right]), np.array([len(x) for x in left]), np.array([len(x) for x in right]), 10)
    found = set()
    for member, group, before, after in groups:
        found |= {(tuple(sorted(member[group == g].tolist())), int(before[g]), int(after[g])) for g in range(group[-1] + 1)}
    assert found == _closures(left, right, 10)


def test_op1_on_the_small_tables(spark):
    got = suffix_dedup.op1_suffix_dedup(spark, "/root/testdata/sf0.001")
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = suffix_dedup.brute_spans(docs, 50)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got.collect()} == {d: (sum(s[1::2]) - sum(s[::2]), len(s) // 2) for d, s in want.items()}


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_interval_tree_nodes_are_the_maximal_runs(values):
    lcp = np.array([0, *values])
    found = set(zip(*(x.tolist() for x in suffix_dedup.interval_tree(lcp))))
    want = set()
    for d in set(values) - {0}:
        i = 1
        while i < len(lcp):
            j = i
            while j < len(lcp) and lcp[j] >= d:
                j += 1
            if j > i and min(lcp[i:j]) == d:
                edge = max(lcp[i - 1], lcp[j] if j < len(lcp) else 0)
                want.add((d, edge, i - 1, j - 1))
            i = j + 1
    assert {(a, c, e) for a, _, c, e in found} == {(a, c, e) for a, _, c, e in want}
    assert found == want


def _print(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius):
    label, moved = {d: d for d in prints}, True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return label


def _near(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "ÀB", "Zz"]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(20)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "\n", "\t "]) + " ".join(w)))
    return docs + [(300, ""), (301, None), (302, "a"), (303, "A b"), (304, "a  b"), (305, "  x"), (306, "A\u00a0b")]


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_fingerprints_and_components_match_brute_force(spark, radius):
    docs = _near()
    prints = {d: _print(t) for d, t in docs}
    rows = simhash.near_groups(simhash.fingerprints(spark.createDataFrame(docs, DOCS)), radius).collect()
    assert {r.doc_id: r.codes[0] & (1 << 64) - 1 for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == _components(prints, radius)


def test_fold_counts_bits_of_texts_of_any_length():
    rng = np.random.default_rng(8)
    sizes = [0, 1, 2, 254, 255, 256, 510, 511, 0, 5000, 3, 0]
    h = rng.integers(0, 1 << 64, sum(sizes), dtype=np.uint64)
    h[: sum(sizes[:5])] = np.uint64(2**64 - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[s:e].tolist()) > e - s) for s, e in zip(bounds[:-1], bounds[1:])]
    assert simhash.fold(h, bounds).tolist() == want


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        kept = [int(m) for m in simhash.masks(radius)]
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any(a & m == b & m for m in kept)


def test_op8_format_repeats_and_empty(spark, tmp_path):
    spark.createDataFrame([(4, "a b c"), (4, "a b c"), (2, "a b c"), (None, "q r s t")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = simhash.op8_simhash(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (2, 2), (4, 2), (4, 2)]
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    assert simhash.near_groups(simhash.fingerprints(spark.createDataFrame([], DOCS))).collect() == []


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (500, 499)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _family(seed=3):
    """Documents and copies of them with 0 to 12 words changed."""
    rng = random.Random(seed)
    docs = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 250))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(w)))
    # a repeated line must not hide what differs
    line = "one line that comes again and again "
    docs += [(len(docs) + i, line * 60 + " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for i in range(3)]
    return docs + [(900, ""), (901, None), (902, "a b"), (903, "a b"), (None, docs[0][1])]


def _jaccard(a, b, n=5):
    def sets(text):
        w = (text or "").split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_the_pipeline_drops_all_similar_copies(spark):
    docs = [d for d in _family(9) if d[0] is not None]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    texts = dict(docs)
    best = {b: max((_jaccard(texts[a], texts[b]) for a in texts if a < b), default=0.0) for b in texts}
    copies = [d for d in texts if best[d] >= 0.8]
    assert sum(d not in kept for d in copies) >= 0.95 * len(copies)
    assert all(d in kept for d in texts if max(_jaccard(texts[a], texts[d]) for a in texts if a != d) < 0.8)


def _linked(texts, similarity=0.8):
    """Components of all pairs at this similarity."""
    label = {d: d for d in texts}
    pairs = [(a, b, _jaccard(texts[a], texts[b])) for a in texts for b in texts if a < b]
    moved = True
    while moved:
        moved = False
        for a, b, j in pairs:
            if j >= similarity and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label, pairs


def test_checked_groups_are_those_of_similar_shingle_sets(spark):
    docs = _family()
    frame = spark.createDataFrame(docs, DOCS)
    codes = simhash.fingerprints(frame, 5, 3, once=True)
    found = {r.doc_id: r.component_id for r in simhash.near_groups(codes, 6, 60, simhash.exact_check(frame, 5, 0.8), 24, 48).collect()}
    texts = {d: t for d, t in docs if d is not None}
    label, pairs = _linked(texts)
    assert all(label[found[d]] == label[d] for d in texts)  # no two documents share a group without links that hold
    assert found[None] == found[0] and found[900] == found[901] == 900 and found[902] == found[903] == 902
    linked = [j for a, b, j in pairs if j >= 0.8 and found[a] == found[b]]
    assert len(linked) >= 0.9 * sum(j >= 0.8 for *_, j in pairs)
    assert all(found[a] == found[b] for a, b, j in pairs if j >= 0.9)


def test_large_families_are_compared_whole(spark, monkeypatch):
    """Families of many blocks: one of copies of a text, one of strangers with some true pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PIVOTS", 3)
    monkeypatch.setattr(simhash, "TASK_ROWS", 40)
    rng = random.Random(14)
    base = [f"w{rng.randrange(50000)}" for _ in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    for i in range(60):
        w = [x if k % 12 else f"v{i}.{k}" for k, x in enumerate(base)]
        docs.append((200 + i, " ".join(w)))
        if i % 4 == 0:
            docs.append((300 + i, " ".join(w[:-3] + [f"u{i}"])))
    frame = spark.createDataFrame(docs, DOCS)
    prints = simhash.fingerprints(frame, 5, 2, once=True)
    family = spark.createDataFrame([(d, 0) for d, _ in docs], "node long, component long")
    edges = simhash.exact_check(frame, 5, 0.8)(family, 2, 128).collect()
    got = {r.node: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in edges], "a long, b long")).collect()}
    label, _ = _linked(dict(docs))
    assert {d: got.get(d, d) for d, _ in docs} == label and prints.count() == len(docs) and len(set(label.values())) == 61


def test_links_beside_refused_pairs_of_a_family_are_found(spark):
    """A family at 0.6 to 0.75 that holds true pairs: what joins the family is refused, its links must still be found."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(50000)}" for _ in range(300)]
    docs = []
    for i in range(150):
        own = [x if (k + 7) % 300 < 246 else f"v{rng.randrange(10**9)}" for k, x in enumerate(base)]
        docs.append((i, " ".join(own)))
        if i % 3 == 0:
            at = rng.randrange(20, 220)
            docs.append((1000 + i, " ".join(own[:at] + [f"u{rng.randrange(10**9)}" for _ in range(24)] + own[at + 24 :])))
    texts = dict(docs)
    pairs = [(i, 1000 + i) for i in range(0, 150, 3) if _jaccard(texts[i], texts[1000 + i]) >= 0.8]
    others = [_jaccard(texts[a], texts[b]) for a in range(0, 30) for b in range(a)]
    assert len(pairs) == 50 and 0.6 < min(others) and max(others) < 0.78
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    assert kept == set(range(150))


def test_an_edge_left_to_an_earlier_table_is_still_checked(spark):
    """x and y share the buckets of two tables, the first with z between them: their direct edge is left out, the pair is not."""
    kept = [int(m) for m in simhash.masks(2)]
    both = [b for b in range(64) if not (kept[0] | kept[1]) >> b & 1][:6]
    only = next(b for b in range(64) if kept[1] >> b & 1 and not kept[0] >> b & 1)
    y = sum(1 << b for b in both)
    z = sum(1 << b for b in both[:3]) | 1 << only
    codes = spark.createDataFrame([(i, [c - (1 << 64) if c >> 63 else c]) for i, c in enumerate([0, y, z])], "doc_id long, codes array<long>")

    def check(pairs, *_):
        """Only x and y hold, if they are compared."""
        of = {r.node: r.component for r in pairs.collect()}
        return spark.createDataFrame([(0, 1)] if of.get(0, -1) == of.get(1, -2) else [], "a long, b long")

    assert {r.doc_id: r.component_id for r in simhash.near_groups(codes, 2, 64, check, 14).collect()} == {0: 0, 1: 0, 2: 2}


def _signed(codes):
    return [c - (1 << 64) if c >> 63 else c for c in codes]


def _families(spark, codes, width, limit):
    """What the check of codes with the pipeline's masks is given, and the groups without a link of its own."""
    given = []

    def check(families, *_):
        given.extend((r.node, r.component) for r in families.collect())
        return spark.createDataFrame([], "a long, b long")

    frame = spark.createDataFrame([(i, _signed(c)) for i, c in enumerate(codes)], "doc_id long, codes array<long>")
    assert simhash.near_groups(frame, 4, limit, check, 14, 48).count() == len(codes)
    return given


def test_strangers_that_meet_by_chance_are_no_family(spark):
    """A chain in one fingerprint whose others have nothing in common, as chance makes in large tables, beside pairs of the chain's ends."""
    rng = random.Random(4)
    code, codes = rng.getrandbits(64), []
    for i in range(60):
        code ^= 1 << 48 + i % 16
        codes.append([code] + [rng.getrandbits(64) for _ in range(5)])
    codes += [[c ^ 1 << rng.randrange(64) for c in codes[i]] for i in (0, 30, 59)]
    families = _families(spark, codes, 6, 80)
    of = dict(families)
    assert sorted(of) == [0, 30, 59, 60, 61, 62] and of[0] == of[60] and of[30] == of[61] and of[59] == of[62] and len(set(of.values())) == 3


@pytest.mark.parametrize("turn", [0, 2])
def test_pairs_with_a_stranger_between_them_are_proposed(spark, turn):
    """x and y share a bucket with z between them that has nothing else in common with them; and so do families that the first fingerprint has found."""
    rng = random.Random(6)
    x = [rng.getrandbits(64) for _ in range(3)]
    codes = []
    for side in (0, 1):
        for k in range(4):
            # the sides meet in one fingerprint alone; there they differ by 12 bits, and in all others by more than any bucket's
            of = [c ^ (1 << 48 + k) ^ ((0xFFF << 50 if j == turn else 0x1F1F1F1F) * side) for j, c in enumerate(x)]
            codes.append(of)
    z = [rng.getrandbits(64) for _ in range(3)]
    z[turn] = x[turn] ^ 0x3F << 50
    of = dict(_families(spark, [*codes, z], 3, 60))
    assert sorted(of) == list(range(8)) and len(set(of.values())) == 1


@pytest.mark.parametrize("seed", range(4))
def test_clusters_hold_all_pairs_within_the_reach(seed):
    """Every pair of two labels within the reach in a bucket shares a cluster of some table; reps, labels and codes survive the encoding."""
    rng = np.random.default_rng(seed)
    kept, reach = simhash.masks(2, 20), 5
    base = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
    code = base[rng.integers(0, 2, 150)]
    for _ in range(5):
        code ^= np.uint64(1) << rng.integers(0, 24, 150).astype(np.uint64)
    rep = np.sort(rng.choice(1 << 40, 150, replace=False)).astype(np.int64)
    label = np.where(rng.random(150) < 0.5, rep, rep[rng.integers(0, 8, 150)])
    first = np.argsort(label == rep, kind="stable")
    blob = simhash._encoded(rep[first], label[first], code[first])
    assert [x.tolist() for x in simhash._decoded(blob)] == [rep[first].tolist(), label[first].tolist(), code[first].tolist()]
    together = set()
    for v in range(len(kept)):
        found = simhash._gatherer(reach, kept, 3)(pa.table({"group": [v * 3 + 1], "rows": pa.array([blob], pa.binary())}))
        for members in found.column("reps").to_pylist():
            assert members == sorted(set(members)) and len(members) > 1
            together |= {(a, b) for a in members for b in members if a < b}
    near = [(i, j) for i in range(150) for j in range(i + 1, 150) if label[i] != label[j] and int(code[i] ^ code[j]).bit_count() <= reach]
    met = [(int(rep[i]), int(rep[j])) for i, j in near if any(not int((code[i] ^ code[j]) & m) for m in kept)]
    assert len(met) > 100 and together >= set(met)


def test_isolated_pairs_just_above_the_similarity_are_found(spark):
    rng = random.Random(21)
    docs = []
    for i in range(1000):
        w = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        at = rng.randrange(10, 170)
        docs += [(i, " ".join(w)), (1000 + i, " ".join(w[:at] + [f"u{rng.randrange(10**9)}" for _ in range(17)] + w[at + 17 :]))]
    texts = dict(docs)
    assert all(0.8 <= _jaccard(texts[i], texts[1000 + i]) < 0.81 for i in range(1000))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    print("kept", len(kept))
    assert kept >= set(range(1000)) and len(kept) <= 1000 + 0.01 * 1000


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (2, c, 0), (None, a, 0), (None, c, 0), (3, None, 0), (4, None, 0)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS + ", `key` long"), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=lambda r: (r[0], r[1] or "")) == sorted([(1, a), (1, b), (2, c), (3, None)], key=lambda r: (r[0], r[1] or ""))
    assert kept[0].asDict().keys() == {"doc_id", "text", "key"}
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], DOCS), "").collect() == []
