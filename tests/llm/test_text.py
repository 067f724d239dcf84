"""Language, decontamination, toxicity and secrets."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import language, secrets, spaced_seeds, toxicity
from strandlake.llm.common import word_spans, buffers

import pyarrow as pa

SF = "/root/testdata/sf0.01"


def test_word_spans_match_the_pattern():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\né\u00a0") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    data, off = buffers(pa.array(texts))
    s, e, first = word_spans(data, off)
    for i, t in enumerate(texts):
        raw = t.encode()
        assert [raw[a - off[i] : b - off[i]] for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] == re.findall(rb"[^\x20\x09-\x0d]+", raw)


def test_language_accuracy_on_held_out_documents(spark):
    got = language.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_spans_and_edge_cases(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet").withColumn("bin", F.lit(1)))
    rows = [(1, None, "s"), (2, "", "s"), (3, "123 €", "s"), (4, "The and of the in this that with by " * 10 + "der die das und nicht eine ist von zu auf " * 10, "s"), (4, "the and of the in", None), (5, "日本語", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = language.identify(df, model, with_spans=True, keep=["text"]).collect()
    assert [(r.doc_id, r.lang_pred) for r in got[:3]] == [(1, "und"), (2, "und"), (3, "und")] and [r.score for r in got[:3]] == [0, 0, 0]
    assert [s.lang for s in got[3].spans] == ["en", "de"] and got[4].lang_pred == "en" and got[5].lang_pred in model.names
    assert language.identified(df, model, 0.3).columns == df.columns
    assert {r.doc_id for r in language.identified(df, model, 0.3).collect()} == {4, 5}
    clash = df.withColumn("lettered", F.lit("kept")).withColumn("__lettered", F.lit(1))
    assert language.identified(clash, model, 0.3).columns == clash.columns and {r.lettered for r in language.identified(clash, model, 0.3).collect()} == {"kept"}
    long = spark.createDataFrame([(None, "the and of the in this " * 60_000, "en"), (2, "the" * 400_000, "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(long, model).collect()][0] == "en" and language.fit(long.where("doc_id is null")).names == []
    assert language.identify(df.limit(0), model).collect() == []
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language.identify(df, empty).collect()[3].lang_pred == "und"


def test_fast_path_gives_the_viterbi_labels():
    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = rng.integers(0, 12, 6)
        first = np.concatenate([[0], np.cumsum(counts)])
        scores = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
        got = language.label_words(scores, first, 4.0)
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                value = lambda p: scores[np.arange(a, b), p].astype(float).sum() - 4.0 * (np.diff(p) != 0).sum()
                assert value(got[a:b]) == pytest.approx(value(language.viterbi(scores[a:b], 4.0)), abs=1e-4)


def _slow_overlap(doc, item, least):
    """Longest stretch along any diagonal with 80 % equal tokens."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        equal = [item[i] == doc[i + shift] for i in range(len(item)) if 0 <= i + shift < len(doc)]
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if 5 * sum(equal[i:j]) >= 4 * (j - i):
                    best = max(best, j - i)
    return best >= min(least, len(item))


def test_contamination_with_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, [word() for _ in range(rng.choice([4, 9, 14, 30]))]) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(30)]
        if d % 2:
            _, item = rng.choice(items)
            copy = list(item)
            for _ in range(len(copy) // 8):
                copy[rng.randrange(len(copy))] = word()
            text[10:10] = copy
        docs.append((d, text))
    bench = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in items] + [(99, None), (98, "")], "item_id long, text string")
    df = spark.createDataFrame([(d, ", ".join(w)) for d, w in docs] + [(100, None), (101, ""), (3, ", ".join(docs[3][1]))], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = {(d, i) for d, t in docs for i, w in items if _slow_overlap(t, w, 13)}
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(df, bench).collect()}
    assert got == want and len(want) >= 25
    small = spaced_seeds.contaminated(df, bench.unionByName(bench.limit(1).selectExpr("cast(null as long) as item_id", "text")))
    assert {(r.doc_id, r.item_id) for r in small.collect() if r.item_id >= 0} == want
    clean = spaced_seeds.without_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {100, 101}
    assert spaced_seeds.contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []
    assert spaced_seeds.contaminated(df, bench.limit(0)).collect() == []


def test_of_rows_that_share_an_id_only_the_contaminated_go(spark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "GROUP_DOCS", 2)
    monkeypatch.setattr(spaced_seeds, "FILTER_BITS", 10)
    rng = random.Random(9)
    item, other = (" ".join(f"t{rng.randrange(10**6)}" for _ in range(20)) for _ in range(2))
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, "before " + item + " after"), (1, other), (None, item), (None, other), (2, f"{long} {item}"), (3, None), (3, ""), (4, item), (4, item), (5, "yes"), (6, "yes no")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("a"), "gone_id": F.lit(7), "item_id": F.lit(8)})
    bench = spark.createDataFrame([(7, item), (7, item), (8, "Yes!"), (9, "")], "item_id long, text string")
    kept = spaced_seeds.without_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == sorted([(1, other), (0, other), (3, ""), (3, "")])
    got = sorted((r.doc_id or 0, r.item_id, r.matched, r.start) for r in spaced_seeds.contaminated(df, bench).collect())
    assert got == [(0, 7, 20, 0), (1, 7, 20, 1), (2, 7, 20, 120_000), (4, 7, 20, 0), (5, 8, 1, 0), (6, 8, 1, 0)]


def test_op6_finds_the_items_that_documents_hold_whole(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.op6_spaced_seeds(spark, SF).collect()}
    assert whole and whole <= got and len(got) <= len(whole) + 2


def test_clause_grammar():
    T = toxicity
    plain = T.clause_score([T.OTHER, T.INSULT], [0, 4.0])
    assert plain == 4.0
    assert T.clause_score([T.TARGET, T.OTHER, T.INSULT], [0, 0, 4.0]) > plain
    assert T.clause_score([T.TARGET, T.NEGATION, T.OTHER, T.INSULT], [0, 0, 0, 4.0]) < plain
    assert T.clause_score([T.REPORT, T.TARGET, T.INSULT], [0, 0, 4.0]) < plain
    assert T.clause_score([T.THREAT, T.TARGET], [0, 0]) > 0 == T.clause_score([T.THREAT, T.OTHER], [0, 0])


def _stepwise(symbols, weights):
    """The same grammar by its machines, one after the other."""
    states, total = [m.start for m in toxicity.MACHINES], 0.0
    for symbol, weight in zip(symbols, weights):
        taken = [m.step(s, symbol) for m, s in zip(toxicity.MACHINES, states)]
        states = [t[0] for t in taken]
        total += np.prod([t[1] for t in taken]) * sum(t[2] + weight * t[3] for t in taken)
    return total


def test_composed_table_is_the_machines_in_step():
    rng = random.Random(3)
    assert len(toxicity.composed()[0]) <= 4 * 2 * 2 * 5
    for _ in range(500):
        symbols = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        weights = [rng.random() * 5 if s == toxicity.INSULT else 0.0 for s in symbols]
        assert toxicity.clause_score(symbols, weights) == pytest.approx(_stepwise(symbols, weights))


def test_contractions_negate():
    grammar = toxicity.Grammar({toxicity._hash("fool"): 5.0})
    texts = ["he is a fool.", "he isn't a fool.", "he ISN'T a fool.", "he isn\u2019t a fool.", "t a fool.", "", "n't fool"]
    got = grammar.strengths(*buffers(pa.array(texts))).tolist()
    assert got[1] < got[0] and got[1] == got[2] == got[3] and got[5] == 0 and got[6] < 5.0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.04


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, f"you are a vile{i % 3} fool." if i % 2 else "nothing of note here.") for i in range(60)] + [(90, None), (91, ""), (1, "you are a vile1 fool.")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (70, None)], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, grammar).collect()]
    assert len(got) == 63 and all(0 <= s <= 1 for _, s, _ in got) and {d for d, _, p in got if p} == {i for i in range(60) if i % 2}
    blank = toxicity.fit(docs, labels.limit(0))
    assert {p for _, _, p in [(0, 0, r.predicted) for r in toxicity.score(docs, blank).collect()]} == {0}
    assert toxicity.score(docs.limit(0), grammar).collect() == []


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_match_the_patterns(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["password", "TOKEN", "api_key", "apikey", '"', "'", " ", "=", ":", "AKIA", "A1B2C3D4E5F6G7", "deadbeef", "0123456789abcdef", "é", "😀", "abc.def-ghi/jkl", "\n", "x", "secret"]
    docs = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, 'é😀 password = "abcdefghijkl" token=password:longvalue12345'), (902, "token: x"), (903, "f" * 70000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op9_secrets(spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in _base(t)).encode()).hexdigest()
    want = sorted((d, *(sum(x[1] == i for x in _base(t)) for i in range(3)), digest(t)) for d, t in docs)
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want


def test_weak_parts_are_reported_only_together(spark):
    key, ident, end = "aB3" * 12, "A1" + "B" * 16, "https://x.example.com:80"
    rows = [(1, f"{ident} and {key} at {end}/x"), (2, f"{ident} alone"), (3, f"only {key} here"), (4, ident + " " * 900 + key), (5, f"see {end}")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))).collect()}
    assert got == {1: ["weak_id", "weak_secret", "endpoint"], 2: [], 3: [], 4: [], 5: []}
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_weak_parts_beside_long_matches_are_linked(spark):
    ident, end, long = "A1" + "B" * 16, "https://x.example.com:80", "token=" + "aB3." * 150
    rows = [(1, f"{long} {ident}"), (2, f"{long} {end}"), (3, long + " " * 160 + ident), (4, long + " " * 161 + ident), (5, ident + " " * 160 + long), (6, ident + " " * 161 + long)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["assign", "weak_id"], 2: ["assign", "endpoint"], 3: ["assign", "weak_id"], 4: ["assign"], 5: ["weak_id", "assign"], 6: ["assign"]}


def test_padded_and_long_keys_are_weak_secrets(spark):
    ident = "A1" + "B" * 16
    keys = ["aB3" * 14 + "x=", "aB3" * 28 + "xy==", "aB3" * 30000, "aB3" * 12 + "==="]
    rows = [(i, f"{ident} {k}") for i, k in enumerate(keys)]
    got = {r.doc_id: [(s.kind, s.end - s.start) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [("weak_id", 18), ("weak_secret", len(k))] if i < 3 else [] for i, k in enumerate(keys)}


WEAK = [(k, re.compile(p, re.A)) for k, p, *_ in secrets.WEAK]


def _linked(text, scope):
    """All parts, and of the weak ones those with a complementary part beside them, by comparing all pairs."""
    parts = [(s, o, k, e) for s, o, k, e in _base(text)]
    parts += [(m.start(), 3 + i, k, m.end()) for i, (k, p) in enumerate(WEAK) for m in p.finditer(text)]
    beside = lambda a, b: 0 <= a[0] - b[3] <= scope or 0 <= b[0] - a[3] <= scope
    return sorted(a for a in parts if a[1] < 3 or any(b[2] in secrets.PARTNERS[a[2]] and beside(a, b) for b in parts))


@pytest.mark.parametrize("scope", [0, 7, 160])
def test_linked_spans_match_all_pairs(spark, scope):
    rng = random.Random(scope)
    key = lambda: "".join(rng.choice("abcXYZ019+/") for _ in range(rng.choice([32, 40, 70]))) + rng.choice(["", "=", "=="])
    ident = lambda: "A" + "".join(rng.choice("BCD0123") for _ in range(rng.randint(15, 31)))
    pieces = [key, ident, lambda: "https://h.example.com:80/x", lambda: "password=" + "q" * rng.randint(5, 300), lambda: "AKIA" + "A1" * rng.randint(3, 15), lambda: " " * rng.randint(1, 200), lambda: "\n", lambda: " word "]
    docs = [(i, "".join(rng.choice(pieces)() + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12)))) for i in range(250)]
    docs += [(900, "AKIA" + "A1" * 15), (901, "A" * 16 + "1" + " " * 198 + "aB3" * 12), (902, "password=" + "x" * 400 + " https://x.example.com"), (903, (ident() + " " + key() + " ") * 3000)]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), scope).collect()}
    assert got == {d: _linked(t, scope) for d, t in docs}
    assert [k for _, _, k, _ in got[900]] == ["access"] and got[901] == [] and len(got[902]) == (1 if scope == 0 else 2)


def _slow_strength(grammar, text):
    """The strength of a text word by word: symbols by the heaviest entry among the word and its stems, clauses at . ! ? ; and line ends."""
    of = dict(zip(grammar.keys.tolist(), zip(grammar.symbols.tolist(), grammar.weights.tolist())))
    raw, total = text.encode(), 0.0
    for clause in re.split(rb"[.!?;\n]", raw):
        symbols, weights = [], []
        for m in re.finditer(rb"[A-Za-z\x80-\xff]+", clause):
            word = language._lower(np.frombuffer(m[0], np.uint8)).tobytes()
            symbol, weight = toxicity.OTHER, 0.0
            for size in (*toxicity.STEMS, None):
                if size is None or len(word) > size:
                    s, w = of.get(toxicity._hash_bytes(word[:size]), (toxicity.OTHER, 0.0))
                    if s != toxicity.OTHER and (size is None or s == toxicity.INSULT) and (w >= weight or symbol == toxicity.OTHER):
                        symbol, weight = s, w
            if symbol == toxicity.OTHER and (word.endswith("n\u2019t".encode()) or (word == b"t" and clause[max(0, m.start() - 2) : m.start()].lower() == b"n'")):
                symbol = toxicity.NEGATION
            symbols.append(symbol), weights.append(weight)
        if toxicity.INSULT in symbols or toxicity.THREAT in symbols:
            total += _stepwise(symbols, weights)
    return total


def test_strengths_match_a_word_by_word_version():
    rng = random.Random(17)
    entries = {toxicity._hash(w): rng.random() * 6 for w in ("fool", "idiot", "stup", "moron", "schei\u00df", "imb\u00e9cil")}
    grammar = toxicity.Grammar(entries)
    words = "you are a FOOL fools idiot stupid stupidity moron not never isn't don\u2019t kill him her said quoted the house Schei\u00dfe imb\u00e9ciles hurt them beat t n't you".split()
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "!\n", "; ", "? "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "fool" * 5000, "fool " * 5000]
    got = grammar.strengths(*buffers(pa.array(texts)))
    assert got.tolist() == pytest.approx([_slow_strength(grammar, t) for t in texts])


def _slow_language(model, text, penalty):
    """Language and share of its letters: trigrams with word edges one by one, scripts of lead bytes, and the best path by full search over labels."""
    raw, k = text.encode(), len(model.names)
    rows, sizes = [], []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw):
        low = b" " + language._lower(np.frombuffer(m[0], np.uint8)).tobytes() + b" "
        score = np.zeros(k)
        for a, b, c in zip(low, low[1:], low[2:]):
            code = (a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF
            score += model.logs[code >> 16]
        able = model.seen[:, language._SCRIPT[m[0][0]]]
        rows.append(np.where(able, score, -60.0) if able.any() else np.zeros(k)), sizes.append(len(m[0]))
    if not rows:
        return None
    best, back = rows[0], []
    for row in rows[1:]:
        stay = best[None, :] - penalty * (1 - np.eye(k))
        back.append(stay.argmax(axis=1))
        best = stay.max(axis=1) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    letters = np.bincount(path[::-1], weights=sizes, minlength=k)
    return model.names[int(letters.argmax())], letters.max() / letters.sum()


def test_languages_match_a_trigram_by_trigram_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text[:1500] for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]
    texts += [a[:300] + " " + b[:300] for a, b in zip(texts, texts[7:])] + ["\u65e5\u672c\u8a9e", "a", "x \u0434\u043e\u043c y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, model).collect()}
    for i, t in enumerate(texts):
        want = _slow_language(model, t, language.PENALTY)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), t[:80]
