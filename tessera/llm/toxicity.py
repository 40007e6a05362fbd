"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training takes a bounded sample: of labelled documents outside the held-out fifth, at most
TRAIN_DOCS of either label, the ones with the least hash, each of at most 6 * TRAIN_WORDS bytes (longer
ones are left out of the fit; they are scored whole like others). Words
and word beginnings that stand in toxic documents far oftener than chance allows make the lexicon;
tokens of toxic documents that match it are the labelled tokens. The field has two tags; a token's
score is a bias and the weights of its lexicon features, and tags of neighbours have weights too.

Scoring covers all documents and whole texts. Tokens without a feature all have the same potential,
so a stretch of them is a power of one 2 x 2 matrix and forward-backward runs over the matches only.
A logistic function of the marginals' sum, sum per word and maximum, fitted on the sample, gives the
document score; `spans` has the offending words' numbers and marginals.

Edge cases: null, empty and wordless texts get the score of no match; without labels of both kinds
the score is the smoothed share of toxic ones; a null doc_id counts as held out and is never trained
on; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.words import arrow_map, split_words, word_ids

TRAIN_DOCS = 1500
TRAIN_WORDS = 20_000
SEGMENT = 64
PREFIXES = (4, 5, 6)
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿„“”‘’…"
STEPS = 80


@dataclass
class Model:
    prior: float
    lexicon: list[str] = field(default_factory=list)
    weights: np.ndarray = None
    bias: float = 0.0
    trans: np.ndarray = None
    calibration: np.ndarray = None


def features_of(distinct: pa.Array) -> list[pa.Array]:
    """For each word its bare form and its beginnings, marked by kind; too short ones are null."""
    big = lambda s: pa.scalar(s, pa.large_string())
    bare = pc.utf8_trim(pc.utf8_lower(distinct), MARKS)
    n = pc.utf8_length(bare)
    out = [pc.if_else(pc.greater(n, 1), pc.binary_join_element_wise(big("w"), bare, big(":")), big(None))]
    for k in PREFIXES:
        cut = pc.binary_join_element_wise(big(f"p{k}"), pc.utf8_slice_codeunits(bare, 0, k), big(":"))
        out.append(pc.if_else(pc.greater(n, k), cut, big(None)))
    return out


def learn_lexicon(feats: list[pa.Array], ids: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> list[str]:
    """Features that chance alone would give fewer than one of, and of whose documents 4 in 5 are toxic.

    feats: by kind, the feature of each distinct word; ids: the words of the documents, one after another."""
    share, size = toxic.mean(), max(1, len(feats[0]))
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * size + ids)
    doc, word = pairs // size, pairs % size
    tallies = []
    for f in feats:
        d = f.dictionary_encode()
        number = np.asarray(pc.fill_null(d.indices, -1), np.int64)[word]
        k = max(1, len(d.dictionary))
        cells = np.unique(doc[number >= 0] * k + number[number >= 0])
        tallies.append((d.dictionary, np.bincount(cells % k, toxic[cells // k], k), np.bincount(cells % k, minlength=k)))
    many = np.log(max(2, sum(len(names) for names, _, _ in tallies)))
    found = []
    for names, bad, every in tallies:
        p = bad / np.maximum(every, 1)
        # Chernoff's bound on a binomial tail; p is above the share of toxic documents
        gain = p * np.log(np.maximum(p, 1e-9) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-9) / (1 - share))
        at = np.flatnonzero((p >= max(0.8, share)) & (every * gain > many))
        found += names.take(pa.array(at)).to_pylist() if len(names) else []
    return sorted(found)


def _marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences with scores e (n, T) of the toxic tag: its marginals (n, T), and the expected pairs (n, 2, 2)."""
    n, length = e.shape
    t = np.exp(trans)
    pot = np.ones((length, n, 2))
    pot[:, :, 1] = np.exp(np.minimum(e.T, 30))
    alpha, beta = np.empty((length, n, 2)), np.ones((length, n, 2))
    a = np.tile([1.0, 0.0], (n, 1))
    for i in range(length):
        a = (a @ t) * pot[i]
        a /= a.sum(1, keepdims=True)
        alpha[i] = a
    for i in range(length - 2, -1, -1):
        b = (pot[i + 1] * beta[i + 1]) @ t.T
        beta[i] = b / b.sum(1, keepdims=True)
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    before = np.concatenate([np.tile([1.0, 0.0], (1, n, 1)), alpha[:-1]])
    pair = before[:, :, :, None] * t * (pot * beta)[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return m[:, :, 1].T, pair.sum(0)


def fit_field(feats: np.ndarray, n_features: int, tags: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions. feats (n, T, k): feature numbers, n_features for none."""
    theta = np.zeros(n_features + 1 + 4)
    theta[n_features] = -3.0
    squares = np.full_like(theta, 1e-6)
    tags_before = np.concatenate([np.zeros((len(tags), 1), int), tags[:, :-1]], 1)
    seen_pairs = np.array([[(weight[:, None] * ((tags_before == i) & (tags == j))).sum() for j in (0, 1)] for i in (0, 1)])
    total = weight.sum()
    for step in range(STEPS):
        w = np.append(theta[:n_features], 0.0)
        e = w[feats].sum(2) + theta[n_features]
        m, pairs = _marginals(e, theta[n_features + 1 :].reshape(2, 2))
        off = (tags - m) * weight[:, None]
        grad = np.empty_like(theta)
        grad[:n_features] = np.bincount(feats.ravel(), np.repeat(off.ravel(), feats.shape[2]), n_features + 1)[:n_features]
        grad[n_features] = off.sum()
        grad[n_features + 1 :] = (seen_pairs - (weight[:, None, None] * pairs).sum(0)).ravel()
        grad = grad / total - 1e-4 * theta
        squares += grad**2
        theta += (0.7 if step < STEPS // 2 else 0.3) * grad / np.sqrt(squares)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :].reshape(2, 2)


class Scorer:
    """The model as used on batches."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.lexicon = pa.array(model.lexicon, pa.large_string())
        t = np.exp(model.trans)
        self.trans = t
        neutral = t * np.array([1.0, np.exp(model.bias)])
        values, vectors = np.linalg.eig(neutral)  # both real: all entries are positive
        k = int(np.argmax(values))
        self.ratio = (values / values[k]).real
        self.vectors, self.inverse = vectors.real, np.linalg.inv(vectors).real

    def gap(self, n: int) -> np.ndarray:
        """n neutral tokens, up to a factor."""
        return (self.vectors * self.ratio**n) @ self.inverse

    def matches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; number in the batch and added score of each token with a feature."""
        flat, counts = split_words(column)
        ids, distinct = word_ids(flat)
        gain, hit = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
        for f in features_of(distinct):
            at = pc.index_in(f, self.lexicon, skip_nulls=True)
            found = np.asarray(at.is_valid())
            gain[found] += self.model.weights[np.asarray(at.drop_null())]
            hit |= found
        where = np.flatnonzero(hit[ids]) if len(ids) else np.zeros(0, int)
        return counts, where, gain[ids[where]]

    def marginals(self, at: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
        """Of the toxic tag at the matches `at` of a text of n tokens."""
        gaps = np.diff(np.concatenate([[-1], at, [n]])) - 1
        steps = [self.gap(int(g)) @ self.trans for g in gaps[:-1]]
        pot = np.stack([np.ones(len(at)), np.exp(np.minimum(self.model.bias + gain, 30))], 1)
        alpha, a = np.empty((len(at), 2)), np.array([1.0, 0.0])
        for i, s in enumerate(steps):
            a = (a @ s) * pot[i]
            a = a / a.sum()
            alpha[i] = a
        b = self.gap(int(gaps[-1])) @ np.ones(2)
        out = np.empty(len(at))
        for i in range(len(at) - 1, -1, -1):
            m = alpha[i] * b
            out[i] = m[1] / m.sum()
            b = steps[i] @ (pot[i] * b)
            b = b / b.sum()
        return np.clip(out, 0.0, 1.0)

    def documents(self, column: pa.Array) -> tuple[np.ndarray, list, list]:
        """Per text (sum, sum per 100 words, maximum) of the marginals; the matches; their marginals."""
        counts, where, gain = self.matches(column)
        starts = np.concatenate([[0], np.cumsum(counts)])
        cut = np.searchsorted(where, starts)
        x, spans, probs = np.zeros((len(counts), 3)), [[]] * len(counts), [[]] * len(counts)
        for d in np.flatnonzero(np.diff(cut)):
            a, z = cut[d], cut[d + 1]
            at = where[a:z] - starts[d]
            m = self.marginals(at, gain[a:z], int(counts[d]))
            x[d] = np.log1p(m.sum()), np.log1p(100 * m.sum() / counts[d]), m.max()
            spans[d], probs[d] = at, m
        return x, spans, probs

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.model.calibration[1:] + self.model.calibration[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(column: pa.Array, toxic: np.ndarray) -> Model:
    n_bad, n = int(toxic.sum()), len(toxic)
    model = Model(prior=(n_bad + 0.5) / (n + 2))
    if n_bad == 0 or n_bad == n:
        return model
    flat, counts = split_words(column)
    ids, distinct = word_ids(flat)
    del flat
    feats = features_of(distinct)
    starts = np.concatenate([[0], np.cumsum(counts)])
    model.lexicon = learn_lexicon(feats, ids, counts, toxic)
    if not model.lexicon:
        return model
    none = len(model.lexicon)
    known = pa.array(model.lexicon, pa.large_string())
    of_word = np.stack([np.asarray(pc.fill_null(pc.index_in(f, known, skip_nulls=True), none), np.int64) for f in feats], 1)
    del feats
    hit = (of_word < none).any(1)
    cut_feats, cut_tags, empty = [], [], 0
    for a, z, bad in zip(starts, starts[1:], toxic, strict=False):
        for s in range(a, z, SEGMENT):
            w = ids[s : min(s + SEGMENT, z)]
            if not hit[w].any():
                empty += 1
                continue
            fs, ts = np.full((SEGMENT, of_word.shape[1]), none), np.zeros(SEGMENT, int)
            fs[: len(w)] = of_word[w]
            ts[: len(w)] = hit[w] * int(bad)
            cut_feats.append(fs)
            cut_tags.append(ts)
    cut_feats.append(np.full((SEGMENT, of_word.shape[1]), none))  # all segments without a match are alike
    cut_tags.append(np.zeros(SEGMENT, int))
    weight = np.append(np.ones(len(cut_tags) - 1), max(empty, 1))
    model.weights, model.bias, model.trans = fit_field(np.array(cut_feats), none, np.array(cut_tags), weight)
    model.calibration = _logistic(Scorer(model).documents(column)[0], toxic.astype(float))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """In one task, to which at most 2 * TRAIN_DOCS texts of at most 6 * TRAIN_WORDS bytes come; the driver gets the model alone."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * TRAIN_DOCS).union(known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * TRAIN_DOCS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(picked, "doc_id").where(F.octet_length("text") <= 6 * TRAIN_WORDS)
    parts = [texts.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS) for t in (0, 1)]

    def run(batches):
        tables = list(batches)
        if tables:
            got = pa.Table.from_batches(tables)
            model = fit(got.column(0).combine_chunks(), np.asarray(got.column(1), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = parts[0].union(parts[1]).select("text", "toxic").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else Model(prior=0.25)


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, spans (offending words: number, marginal)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("word", pa.int64()), ("marginal", pa.float64())])))])

    def run(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        if model.calibration is None:
            scores, spans = np.full(len(b), model.prior), [[]] * len(b)
        else:
            scorer = Scorer(model)
            x, at, probs = scorer.documents(b.column(1))
            scores = scorer.scores(x)
            spans = [[{"word": int(i), "marginal": float(p)} for i, p in zip(a, m, strict=True) if p >= 0.5] for a, m in zip(at, probs, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(spans, schema.field(2).type)], schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_col), run, schema, "doc_id long, score double, spans array<struct<word: long, marginal: double>>", 1)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    tagged = tag(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return tagged.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns, in one pass over them; all rows if nothing could be learnt."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    if model.calibration is None:  # nothing tells toxic texts apart
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array(scorer.scores(scorer.documents(b.column(at))[0]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
