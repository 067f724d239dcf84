"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols - insult (with a weight), threat, target, negation, reported speech, other - and clauses become symbol strings. Four
small transducers - negation passes a discount to the words after it, reported speech to the rest of its clause, a target lifts
the clause that addresses it, and the matcher turns insults, and threats that reach a target, into scored patterns - are composed
into one table of states by symbols, which clauses are walked with; a clause's score is the weight of its matched patterns, so a word alone
is only the weakest of them. Clauses without an insult or a threat are never walked.

The insult lexicon (whole words and stems of 4 to 8 bytes) and the mapping of strengths to [0, 1] are learned from a bounded
sample of labelled documents (``SAMPLE_DOCS`` toxic and ``CLEAN`` times as many other ones, by a hash of the ids); only what stands in
``LEAST_SHARE`` of the toxic sample can enter the lexicon. Null and empty texts have the base score. If a label is
missing, the lexicon is empty and all scores are the base rate's. Rows that repeat are scored alike; labels that repeat for a
document count as its largest label; a null doc_id teaches nothing and is not held out. Texts of any length are scored whole; an
empty table gives no rows; columns other than those named are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, buffers, slices, table, word_spans
from .language import _NOT_LETTER, _lower, remainder

SAMPLE_DOCS = 3000
#: Clean documents for each toxic one.
CLEAN = 3
STEMS = (4, 5, 6, 7, 8)
#: Least log-odds and least share of the toxic documents of a lexicon entry.
LEAST_ODDS, LEAST_SHARE = 3.5, 0.01
# closed classes, fixed values
TARGETS = "you your yours he him she her they them du dich dir ihr sie tu toi te vous il elle ils tú ti usted ustedes él ella".split()
NEGATIONS = "not never no cannot nicht nie kein keine pas jamais aucun aucune nunca jamás ningún".split()
REPORTS = "said says reported claimed wrote quoted called sagte sagt berichtete schrieb behauptete dit disait écrit rapporte dijo dice escribió afirmó".split()
THREATS = "kill hurt beat destroy stab shoot töten verletzen schlagen erschießen tuer frapper blesser matar golpear herir".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True


def _hash(word: str) -> int:
    return _hash_bytes(word.encode())


def _hash_bytes(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(RollingHash(data).spans(np.array([0]), np.array([len(data)]))[0])


class Transducer:
    """Finite states by symbols: the next state, a factor for what other machines score, and a score of its own (constant, and by the symbol's weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _negate(left: int, symbol: int):
    """Three words after a negation weigh little."""
    return (3 if symbol == NEGATION else max(0, left - 1)), (0.4 if left and symbol != NEGATION else 1.0), 0.0, 0.0


def _report(inside: bool, symbol: int):
    """After a word of reported speech the rest of the clause is someone else's."""
    return inside or symbol == REPORT, (0.6 if inside else 1.0), 0.0, 0.0


def _aim(aimed: bool, symbol: int):
    """An insult after a target is aimed at it."""
    return aimed or symbol == TARGET, (1.25 if aimed and symbol == INSULT else 1.0), 0.0, 0.0


def _match(threat: int, symbol: int):
    """Scores an insult by its weight, and a target within three words of a threat."""
    if symbol == TARGET:
        return 0, 1.0, (4.0 if threat else 0.0), 0.0
    return (4 if symbol == THREAT else max(0, threat - 1)), 1.0, 0.0, (1.0 if symbol == INSULT else 0.0)


MACHINES = (Transducer(0, _negate), Transducer(False, _report), Transducer(False, _aim), Transducer(0, _match))


def composed(machines=MACHINES, symbols: int = 6) -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """The composition as tables [state][symbol] - next state, constant score, score for a unit of weight - over reachable states; state 0 starts."""
    states = {tuple(m.start for m in machines): 0}
    following, constant, by_weight = [], [], []
    for state in (queue := list(states)):
        rows = [], [], []
        for symbol in range(symbols):
            taken = [m.step(s, symbol) for m, s in zip(machines, state)]
            target = tuple(t[0] for t in taken)
            if target not in states:
                states[target] = len(states)
                queue.append(target)
            factor = math.prod(t[1] for t in taken)
            for row, value in zip(rows, (states[target], factor * sum(t[2] for t in taken), factor * sum(t[3] for t in taken))):
                row.append(value)
        for table_, row in zip((following, constant, by_weight), rows):
            table_.append(row)
    return following, constant, by_weight


_NEXT, _CONSTANT, _BY_WEIGHT = composed()


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """One walk of a clause through the composed transducer."""
    state, total = 0, 0.0
    for symbol, weight in zip(symbols, weights):
        total += _CONSTANT[state][symbol] + weight * _BY_WEIGHT[state][symbol]
        state = _NEXT[state][symbol]
    return total


def _contracted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that negate by contraction: the t of n't, or a word that ends in it where the apostrophe is the typographic one."""
    low = lambda back, of: LOWER[data[np.maximum(of - back, 0)]]
    plain = (ends - starts == 1) & (starts >= 2) & (low(0, starts) == ord("t")) & (low(1, starts) == ord("'")) & (low(2, starts) == ord("n"))
    curly = (ends - starts >= 5) & (low(1, ends) == ord("t")) & (low(2, ends) == 0x99) & (low(3, ends) == 0x80) & (low(4, ends) == 0xE2) & (low(5, ends) == ord("n"))
    return plain | curly


class Grammar:
    def __init__(self, entries: dict[int, float], slope: float = 1.0, offset: float = 3.0):
        classes: dict[int, tuple[int, float]] = {h: (INSULT, w) for h, w in entries.items()}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
            classes |= {_hash(w): (symbol, 0.0) for w in words}
        self.keys = np.array(sorted(classes), np.uint64)
        self.symbols = np.array([classes[int(k)][0] for k in self.keys], np.int8)
        self.weights = np.array([classes[int(k)][1] for k in self.keys])
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.keys >> np.uint64(44)] = True
        self.slope, self.offset = slope, offset

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are entries, and their places."""
        maybe = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]

    def strengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The sum of clause scores of each text."""
        total = np.zeros(len(off) - 1)
        starts, ends, first = word_spans(data, off, _NOT_LETTER)
        if not len(starts):
            return total
        rolling = RollingHash(_lower(data))
        symbol, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        words = np.arange(len(starts))
        for size in (*STEMS, None):
            these = words if size is None else np.flatnonzero(ends - starts > size)
            found, at = self._look_up(rolling.spans(starts[these], ends[these] if size is None else starts[these] + size))
            keep = (self.symbols[at] == INSULT) if size else np.ones(len(at), bool)
            found, at = these[found[keep]], at[keep]
            heavier = (self.weights[at] >= weight[found]) | (symbol[found] == OTHER)
            symbol[found[heavier]], weight[found[heavier]] = self.symbols[at[heavier]], self.weights[at[heavier]]
        symbol[_contracted(data, starts, ends) & (symbol == OTHER)] = NEGATION
        active = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(active):
            return total
        # clauses end at stops and with their text
        clause = np.searchsorted(np.flatnonzero(_CLAUSE_END[data]), starts) + np.repeat(np.arange(len(off) - 1), np.diff(first))
        lists = symbol.tolist(), weight.tolist()
        begin, end = np.searchsorted(clause, clause[active], "left"), np.searchsorted(clause, clause[active], "right")
        doc = np.searchsorted(first, active, side="right") - 1
        _, one = np.unique(begin, return_index=True)
        for d, i, j in zip(doc[one].tolist(), np.maximum(begin[one], first[doc[one]]).tolist(), np.minimum(end[one], first[doc[one] + 1]).tolist()):
            total[d] += clause_score(lists[0][i:j], lists[1][i:j])
        return total

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(strength) - self.offset, -40, 40)))


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: hashes of words and of their stems."""
    starts, ends, first = word_spans(data, off, _NOT_LETTER)
    rolling, size = RollingHash(_lower(data)), ends - starts
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h, d = [rolling.spans(starts, ends)], [doc]
    for n in STEMS:
        long = np.flatnonzero(size > n)
        h.append(rolling.spans(starts[long], starts[long] + n)), d.append(doc[long])
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort([h, d])
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    return d[new], h[new]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Grammar:
    """From rows (doc_id, text) and (doc_id, toxic)."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = None
    for value in (True, False):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample if value else CLEAN * sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    sampled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # ids of the sample only

    def count(only):
        def run(batches):
            for batch in batches:
                toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)).astype(bool)
                at = 0
                for part in slices(batch, "text", 1 << 20):
                    d, h = _features(*buffers(part.column("text")))
                    mine = toxic[at : at + part.num_rows]
                    at += part.num_rows
                    keep = mine[d] if only is None else np.isin(h, only)
                    d, h = d[keep], h[keep]
                    u, inverse = np.unique(h, return_inverse=True)
                    t = np.bincount(inverse, weights=mine[d], minlength=len(u)).astype(np.int64)
                    n = np.bincount(inverse, minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "t", "c"])
        return run

    schema = "h long, t long, c long"
    n = {r["toxic"]: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return Grammar({}, 1.0, 3.0)
    sums = lambda only: sampled.mapInArrow(count(only), schema).groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    frequent = sums(None).where(F.col("t") >= max(3, math.ceil(LEAST_SHARE * n_toxic))).select("h").toArrow()  # from the sample only
    only = np.sort(frequent.column("h").to_numpy().view(np.uint64))
    rows = sums(only).toArrow()
    h, t, c = (rows.column(x).to_numpy() for x in ("h", "t", "c"))
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    good = np.flatnonzero(odds >= LEAST_ODDS)
    grammar = Grammar({int(k): float(w) for k, w in zip(h[good].view(np.uint64), odds[good])})

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(grammar.strengths(*buffers(part.column("text")))), part.column("toxic")], ["x", "y"])

    pairs = sampled.select("text", "toxic").mapInArrow(measure, "x double, y boolean").toArrow()  # a row of two numbers for each sampled document
    grammar.slope, grammar.offset = _logistic(np.log1p(pairs.column("x").to_numpy()), np.asarray(pairs.column("y").to_pylist(), float))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton steps, classes weighted alike; the slope is not negative."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x - b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + ridge * a, -(weight * (p - y)).sum() + ridge * b])
        v = weight * p * (1 - p)
        hess = np.array([[(v * x * x).sum() + ridge, -(v * x).sum()], [-(v * x).sum(), v.sum() + ridge]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(0.0, float(a)), float(b)


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of every row of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                s = grammar.score(grammar.strengths(*buffers(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    grammar = fit(docs, labels.where(remainder(3) != 1).select("doc_id", "toxic"))
    return score(docs, grammar).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
