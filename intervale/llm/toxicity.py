"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals give document scores and offsets.

A token's features are its lower-cased word and prefixes of it, hashed. Labels of tokens come from the labels of
documents: a feature is telling if, at equal numbers of both kinds, it occurs almost only in toxic documents of the
sample, and so often that chance does not explain it (a log-likelihood ratio); tokens with a telling feature in toxic documents are labelled toxic. The field is fitted on
these by its exact gradient; forward-backward over whole documents gives each token's marginal. A logistic function of
the largest marginal and the log of their sum, fitted on other documents of the sample than the field and set to the
share of toxic documents among all labelled ones, is the document's score.

Everything is fitted on a sample of labelled documents, about SAMPLE_DOCS toxic ones and as many others, chosen by a
hash of the id, with held-out rows left out. Nothing but the text is an input of a score.

Defined results: null and empty texts get the score of no marginal; without labelled rows of both kinds all scores are
0; rows are never dropped or merged, whatever their ids; a document with several labels counts as toxic if any is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEPPED_BYTES, id_remainder, map_slices, np_id_remainder, table
from .words import Words, mix, words_of

FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS = 800
#: log2 of the buckets of features: so many that words of long texts hardly ever share one with a telling word.
WEIGHT_BITS = 22
PREFIXES = (4, 5, 6, 7, 8)
LEAST_RATIO, LEAST_SHARE = 24.0, 0.9
EPOCHS, RATE = 30, 0.5
#: Each so-many-th document of the sample fits the layer that scores documents.
DOCUMENT_FOLD = 4
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(128) if not chr(c).isalnum()]] = True


def token_features(words: Words, at: np.ndarray) -> np.ndarray:
    """Buckets [word, feature] of the words at the given places: the whole word, then its prefixes."""
    data = np.concatenate([words.data, np.zeros(8, np.uint8)]).astype(np.uint64)
    size = words.end[at] - words.start[at]
    packed = np.zeros((9, len(at)), np.uint64)
    for k in range(8):
        packed[k + 1] = packed[k] | np.where(size > k, data[words.start[at] + k] << np.uint64(8 * k), np.uint64(0))
    columns = [words.hashes()[at]] + [mix(packed[k]) + np.uint64(k) for k in PREFIXES]
    return np.stack([(mix(c + np.uint64(j)) >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64) for j, c in enumerate(columns)], 1)


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    longest = int(length[order[0]]) if len(length) else 0
    return first[:-1][order], np.searchsorted(-length[order], -np.arange(1, longest + 1), "right"), longest


def forward_backward(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two states; emission: log-odds of state 1 for each token; moves[i, j]: log-weight from i to j. Log-odds of the
    marginals, and the forward and backward log-odds they are made of. All sequences advance together."""
    begin, active, longest = _steps(first)
    ahead, after = np.zeros(len(emission)), np.zeros(len(emission))
    for t in range(longest):
        at = begin[: active[t]] + t
        if t:
            x = ahead[at - 1]
            ahead[at] = emission[at] + np.logaddexp(moves[0, 1], x + moves[1, 1]) - np.logaddexp(moves[0, 0], x + moves[1, 0])
        else:
            ahead[at] = emission[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        x = emission[at + 1] + after[at + 1]
        after[at] = np.logaddexp(moves[1, 0], moves[1, 1] + x) - np.logaddexp(moves[0, 0], moves[0, 1] + x)
    return ahead + after, ahead, after


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray) -> None:
        self.weights, self.bias, self.moves = weights.astype(np.float32), bias, moves
        self.document = np.array([-3.0, 3.0, 1.0])

    def emissions(self, words: Words) -> np.ndarray:
        _, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        return (self.weights[token_features(words, at)].sum(1, dtype=np.float64) + self.bias)[which]

    def marginals(self, words: Words) -> np.ndarray:
        return _sigmoid(forward_backward(self.emissions(words), words.first, self.moves)[0])

    def signals(self, marginals: np.ndarray, words: Words) -> np.ndarray:
        """[document, (1, largest marginal, log of 1 + their sum)]; marginals below 0.01 count as none."""
        n = len(words.first) - 1
        seen = np.where(marginals >= 0.01, marginals, 0.0)
        most = np.zeros(n)
        np.maximum.at(most, words.text, seen)
        return np.stack([np.ones(n), most, np.log1p(np.bincount(words.text, seen, n))], 1)


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> Model:
    """The model, from documents and whether each is toxic. Of each kind every DOCUMENT_FOLD-th document (all, where that
    leaves none) fits the layer of documents, the others the field: on its own documents the field is too sure. share:
    that of toxic documents among all, if the ones given are chosen by kind; the scores are probabilities under it."""
    turn = np.zeros(len(toxic), np.int64)
    for kind in (0, 1):
        turn[toxic == kind] = np.arange((toxic == kind).sum()) % DOCUMENT_FOLD
    own = turn == DOCUMENT_FOLD - 1
    if len(set(toxic[own].tolist())) < 2:
        own[:] = True
    rest = ~own if not own.all() else own
    model = fit_field([t for t, k in zip(texts, rest, strict=True) if k], toxic[rest])
    # A logistic function by Newton's method with a small penalty.
    words = words_of(pa.array([t for t, k in zip(texts, own, strict=True) if k], pa.large_string()), True, _OTHER)
    x, y, w = model.signals(model.marginals(words), words), toxic[own].astype(float), np.zeros(3)
    for _ in range(30):
        p = _sigmoid(x @ w)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
    if share is not None and 0 < share < 1:
        w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    model.document = w
    return model


def fit_field(texts: list[str], toxic: np.ndarray) -> Model:
    """The field, from documents and whether each is toxic."""
    words = words_of(pa.array(texts, pa.large_string()), True, _OTHER)
    _, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    known, features = np.unique(token_features(words, at), return_inverse=True)
    features = features.reshape(len(at), -1)
    documents = np.zeros((2, len(known)))
    for j in range(features.shape[1]):
        pairs = np.unique(words.text.astype(np.int64) << WEIGHT_BITS | features[which, j])
        kind = toxic[pairs >> WEIGHT_BITS].astype(np.int64)
        np.add.at(documents, (kind, pairs & ((1 << WEIGHT_BITS) - 1)), 1)
    share = np.array([[(toxic == 0).mean()], [(toxic == 1).mean()]])
    rate = documents / share
    chance = documents * np.log(np.maximum(documents, 1) / np.maximum(documents.sum(0) * share, 1e-9))
    telling = (2 * chance.sum(0) >= LEAST_RATIO) & (rate[1] >= LEAST_SHARE * rate.sum(0))
    label = (telling[features].any(1)[which] & (toxic[words.text] == 1)).astype(np.float64)
    # Sequences for fitting: runs of up to 64 tokens, so that all advance together.
    cuts = np.unique(np.concatenate([words.first, np.arange(0, len(words.start), 64)]))
    steps = np.ones(len(label), bool)
    steps[cuts[:-1][cuts[:-1] < len(label)]] = False
    place = np.flatnonzero(steps)
    weights, bias, moves = np.zeros(len(known)), -3.0, np.zeros((2, 2))
    grown = np.full(len(known), 1e-8)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[place - 1].astype(int), label[place].astype(int)), 1)
    for _ in range(EPOCHS):
        emission = weights[features].sum(1)[which] + bias
        odds, ahead, after = forward_backward(emission, cuts, moves)
        error = label - _sigmoid(odds)
        by_word = np.bincount(which, error, len(at))
        gradient = np.bincount(features.ravel(), np.repeat(by_word, features.shape[1]), len(weights)) - 1e-3 * weights
        grown += gradient**2
        weights += RATE * gradient / np.sqrt(grown)
        bias += 2.0 * error.mean()
        left, right = ahead[place - 1], emission[place] + after[place]
        whole = np.logaddexp(np.logaddexp(moves[0, 0], moves[0, 1] + right), np.logaddexp(moves[1, 0] + left, moves[1, 1] + left + right))
        expected = np.array([[np.exp(moves[i, j] + i * left + j * right - whole).sum() for j in (0, 1)] for i in (0, 1)])
        moves = np.clip(moves + 2.0 * (seen - expected) / max(1, len(place)), -8, 8)
    whole = np.zeros(1 << WEIGHT_BITS, np.float32)
    whole[known] = weights
    return Model(whole, bias, moves)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", FOLDS) != HELD_OUT))
    counts = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    limit = F.when(F.col("toxic") == 1, F.lit(round(1e6 * sample_docs / counts[1]))).otherwise(F.lit(round(1e6 * sample_docs / counts[0])))
    # About 2 * sample_docs rows by construction, so that they may be broadcast.
    sample = kept.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < limit).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").collect()
    toxic = np.array([r["toxic"] for r in texts], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    order = sorted(range(len(texts)), key=lambda k: (texts[k]["text"], -toxic[k]))
    order = [k for i, k in enumerate(order) if not i or texts[k]["text"] != texts[order[i - 1]]["text"]]
    return fit([texts[k]["text"] for k in order], toxic[order], counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (first byte, end byte, marginal) of every row."""
    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<first:int,end:int,marginal:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        n = part.num_rows
        scores, spans = np.zeros(n), [[] for _ in range(n)]
        if model is not None:
            words = words_of(part.column(1), True, _OTHER)
            marginals = model.marginals(words)
            scores = _sigmoid(model.signals(marginals, words) @ model.document)
            for k in np.flatnonzero(marginals >= 0.5):
                t = words.text[k]
                spans[t].append({"first": int(words.start[k] - words.base[t]), "end": int(words.end[k] - words.base[t]), "marginal": float(marginals[k])})
        held = np_id_remainder(part.column(0).to_pylist(), FOLDS) == HELD_OUT
        return pa.record_batch([part.column(0), pa.array(held), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=[f.split()[0] for f in schema.split(", ")])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema, most=STEPPED_BYTES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
