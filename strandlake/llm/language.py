"""Language identification with spans for mixed-language text.

Each word's script, from ranges of UTF-8 lead bytes, narrows the candidate languages to those seen in that script; byte trigrams
with word edges score the word for each candidate; a Viterbi path over the words, with a penalty for each switch, labels spans.
A text where no run of words gains more than half the penalty in another language has a one-language path: that test is a running
minimum over whole batches, so the step-by-step search only runs on the others, with the same result.

The model is fitted on a bounded sample (``SAMPLE_DOCS`` labelled documents, by a hash of their ids) of whole texts; only counts, at most
languages x 2^16, reach the driver. Null texts and texts without letters are ``und`` with score 0; so is everything if no row is
labelled. Letters of a script that no label has seen leave the language with the largest prior. Languages of equal weight: the first
name. Rows are judged one by one: repeated rows repeat, a null doc_id teaches nothing and is not held out, an empty table gives no rows.
Texts of any length are labelled whole; the working memory beside the text itself is a few numbers a word and language. Other columns
may have any name; those kept stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, free_name, slices, table, word_spans

SAMPLE_DOCS = 4000
#: Log-odds that a run of words must gain to be a span of its own.
PENALTY = 12.0
UNKNOWN = "und"
_BINS = 1 << 16
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
# lead bytes to script: 0 Latin, 1 Greek, 2 Cyrillic, 3 Hebrew, 4 Arabic, 5 Indic and Thai, 6 Georgian to Khmer, 7 symbols, 8 kana, 9 Han, 10 Hangul, 11 others
_SCRIPT = np.full(256, 11, np.int64)
for _first, _last, _script in ((0x00, 0xCA, 0), (0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD6, 0xD7, 3), (0xD8, 0xDB, 4), (0xE0, 0xE0, 5), (0xE1, 0xE1, 6), (0xE2, 0xE2, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10)):
    _SCRIPT[_first : _last + 1] = _script
_SCRIPTS = 12


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters, byte for byte."""
    out = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, first word of each text, and the trigram bin around each letter byte, with the letters' positions."""
    starts, ends, first = word_spans(data, off, _NOT_LETTER)
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])
    low = _lower(data).astype(np.uint32)[at]
    before, after = np.full(len(at), 0x20, np.uint32), np.full(len(at), 0x20, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[begin[:-1]] = after[begin[1:] - 1] = 0x20
    code = (before << np.uint32(16)) | (low << np.uint32(8)) | after
    return starts, ends, first, ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), begin


def _runs(begin: np.ndarray, letters: int):
    """Runs of words with about so many letters, or a single longer word."""
    a = 0
    while a < len(begin) - 1:
        z = max(a + 1, int(np.searchsorted(begin, begin[a] + letters, side="right")) - 1)
        yield a, z
        a = z


class Model:
    """Log-odds of trigrams by language, and the scripts in which each language was seen."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * _BINS)
        logs = np.log(share)
        self.logs = np.ascontiguousarray((logs - logs.mean(axis=0)).T.astype(np.float32)) if names else np.zeros((_BINS, 0), np.float32)
        self.seen = scripts >= 0.001 * scripts.sum(axis=1, keepdims=True) if names else np.zeros((0, _SCRIPTS), bool)
        self.prior = int(np.argmax(counts.sum(axis=1))) if names else 0

    def words(self, data: np.ndarray, off: np.ndarray):
        starts, ends, first, bins, begin = _grams(data, off)
        scores = np.zeros((len(starts), len(self.names)), np.float32)
        if len(starts):
            for a, z in _runs(begin, 1 << 18):  # bounded memory, however long a text is
                scores[a:z] = np.add.reduceat(self.logs[bins[begin[a] : begin[z]]], begin[a:z] - begin[a], axis=0)
            able = self.seen[:, _SCRIPT[data[starts]]].T
            scores = np.where(able.any(axis=1, keepdims=True), np.where(able, scores, np.float32(-60)), np.float32(0))
        return starts, ends, first, scores

    def judge(self, column: pa.Array, lettered: pa.Array, penalty: float):
        """Words (starts, ends, text, label), offsets, and for each text the language, whether it has one, its share of the letters; the count of texts."""
        data, off = buffers(column)
        starts, ends, first, scores = self.words(data, off)
        labels = label_words(scores, first, penalty)
        n, k = len(column), max(1, len(self.names))
        text = np.repeat(np.arange(n), np.diff(first))
        weight = np.bincount(text * k + labels, weights=ends - starts, minlength=n * k).reshape(n, k)
        best, total = np.argmax(weight, axis=1), weight.sum(axis=1)
        known = np.asarray(lettered.to_numpy(zero_copy_only=False)).astype(bool) & bool(self.names)
        best[known & (total == 0)] = self.prior
        score = np.where(known & (total > 0), weight[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return starts, ends, text, labels, off, best, known, score, n


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of one text's words: scores less ``penalty`` for each change; ties stay, then take the lower label."""
    n, k = scores.shape
    rows = scores.tolist()
    best, back = rows[0], []
    for row in rows[1:]:  # plain lists: a few languages are too few for arrays
        top = max(best)
        floor, leader = top - penalty, best.index(top)
        if min(best) >= floor:
            back.append(None)
            best = [b + s for b, s in zip(best, row)]
        else:
            back.append([leader if b < floor else i for i, b in enumerate(best)])
            best = [(floor if b < floor else b) + s for b, s in zip(best, row)]
    at = best.index(max(best))
    path = [at]
    for step in reversed(back):
        if step is not None:
            at = step[at]
        path.append(at)
    return np.array(path[::-1], np.int64)


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of all texts (``first``: each text's first word, one more at the end)."""
    n, k = scores.shape
    count = np.diff(first)
    if not n or not k:
        return np.zeros(n, np.int64)
    some = np.flatnonzero(count)
    total = np.zeros((len(count), k))
    total[some] = np.add.reduceat(scores.astype(np.float64), first[:-1][some], axis=0)
    main = np.argmax(total, axis=1)
    text = np.repeat(np.arange(len(count)), count)
    labels = main[text]
    gain = np.cumsum(scores.astype(np.float64) - scores[np.arange(n), labels].astype(np.float64)[:, None], axis=0)
    before = np.concatenate([np.zeros((1, k)), gain[:-1]])
    step = (np.abs(gain).max() + 1) * 4
    fall = step * text[:, None].astype(np.float64)
    rise = gain - (np.minimum.accumulate(before - fall, axis=0) + fall)
    # a path of k stretches in other languages has at least k - 1 switches, and at least one: gains of half a penalty never pay
    mixed = np.unique(text[(rise > penalty / 2 - 1e-6).any(axis=1)])
    for t in mixed.tolist():
        labels[first[t] : first[t + 1]] = viterbi(scores[first[t] : first[t + 1]], penalty)
    return labels


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """From rows (doc_id, text, lang); null langs and texts teach nothing."""
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    chosen = labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # ids of the sample only

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            got: dict[tuple[str, int], int] = {}
            for part, names in _with(batch, langs):
                data, off = buffers(part.column("text"))
                starts, ends, first, bins, begin = _grams(data, off)
                for name in set(names):
                    rows = np.flatnonzero(names == name)
                    words = np.concatenate([np.arange(first[i], first[i + 1]) for i in rows] or [np.zeros(0, np.int64)])
                    mine = np.zeros(len(starts), bool)
                    mine[words] = True
                    letters = np.repeat(mine, ends - starts)
                    for bin_, n in zip(*np.unique(bins[letters], return_counts=True)):
                        got[name, int(bin_)] = got.get((name, int(bin_)), 0) + int(n)
                    for s, n in zip(*np.unique(_SCRIPT[data[starts[mine]]], return_counts=True)):
                        got[name, -1 - int(s)] = got.get((name, -1 - int(s)), 0) + int(n)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got]), pa.array([k[1] for k in got], pa.int64()), pa.array(list(got.values()), pa.int64())], ["lang", "bin", "n"])

    rows = chosen.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs, bins, n = rows.column("lang").to_pylist(), rows.column("bin").to_numpy(), rows.column("n").to_numpy()
    names = sorted(set(langs))
    counts, scripts = np.zeros((len(names), _BINS)), np.zeros((len(names), _SCRIPTS))
    index = np.array([names.index(x) for x in langs], np.int64)
    if names:
        grams = bins >= 0
        counts[index[grams], bins[grams]] = n[grams]
        scripts[index[~grams], -1 - bins[~grams]] = n[~grams]
    return Model(names, counts, scripts)


def _with(batch, values):
    at = 0
    for part in slices(batch, "text", 1 << 20):
        yield part, values[at : at + part.num_rows]
        at += part.num_rows


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters' bytes in that language) and, if asked, ``spans``: (start, end, lang) in bytes; then ``keep``."""
    kept = [c for c in keep or [] if c != "doc_id"]
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lettered.alias("is_lettered"), *[F.col(c).alias(f"kept_{c}") for c in kept])
    fields = [slim.schema["doc_id"], *[slim.schema[f"kept_{c}"] for c in kept]]
    names = np.array([*model.names, UNKNOWN], dtype=object)
    shape = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                starts, ends, text, labels, off, best, known, score, n = model.judge(part.column("text"), part.column("is_lettered"), penalty)
                out = [part.column("doc_id"), pa.array(names[np.where(known, best, len(model.names))], pa.string()), pa.array(score)]
                if with_spans:
                    new = np.r_[True, (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])] if len(labels) else np.zeros(0, bool)
                    a = np.flatnonzero(new)
                    z = np.r_[a[1:] - 1, len(labels) - 1] if len(a) else a
                    flat = pa.StructArray.from_arrays([pa.array(starts[a] - off[text[a]]), pa.array(ends[z] - off[text[a]]), pa.array(names[labels[a]] if model.names else np.full(len(a), UNKNOWN, object), pa.string())], fields=list(shape))
                    out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[a], np.arange(n + 1)), pa.int32()), flat))
                out += [part.column(f"kept_{c}") for c in kept]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", *(["spans"] if with_spans else []), *[f"kept_{c}" for c in kept]])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema = ", ".join([types[0], "lang_pred string, score double", *(["spans array<struct<start: bigint, end: bigint, lang: string>>"] if with_spans else []), *types[1:]])
    found = slim.mapInArrow(run, schema)
    return found.select("doc_id", "lang_pred", "score", *(["spans"] if with_spans else []), *[F.col(f"kept_{c}").alias(c) for c in kept])


def identified(docs: DataFrame, model: Model, least_share: float, penalty: float = PENALTY) -> DataFrame:
    """``docs``, all columns, less the rows that are ``und`` or whose language has less than ``least_share`` of the letters; no shuffle."""
    lettered = free_name(docs, "lettered")
    marked = docs.withColumn(lettered, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))

    def keep(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                *_, known, score, _ = model.judge(part.column("text"), part.column(lettered), penalty)
                yield part.filter(pa.array(known & (score >= least_share)))

    return marked.mapInArrow(keep, marked.schema).drop(lettered)


def remainder(divisor: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(4) != 2))
    return identify(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
