"""Quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams, trained on trusted text.

Counts of all trusted documents (those that labels call good) are gathered by key, lower orders from the distinct
n-grams above them. A document's perplexity comes from a join of its n-grams with the model, which is sharded by
n-gram: log-probabilities are written as sums of values by n-gram, so partial sums add up whatever the shard. Most
n-grams of texts are among the most frequent HEAD, a broadcast of a fixed size; of the rest, those that a filter of
fixed size may hold go to the shards as (row, n-gram, count), gathered by document first. Nothing is left out.

A third of the trusted documents, by a hash of the id, is kept from training: the model knows the others' text too
well. A document is rejected if its bits a byte, drawn a little towards its language's median where the text is short,
lie above a threshold from quantiles of that third in its language (in all languages, where one has few).

Defined results: null and empty texts have no perplexity and are rejected; a null language is a language of its own;
without trusted rows nothing is rejected but null and empty texts; repeated rows are judged alike; other columns are
kept by keep_good() and left out by scores().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_of, might_hold
from .common import by_text_batches, slices, table, written
from .words import bytes_of

ORDER = 5
HEAD = 1 << 19
HEAD_LOWER = 1 << 18
FILTER_BITS = 26
PAD = 0x0A
#: The threshold: median plus SPREADS times the distance from the median to the UPPER quantile.
UPPER, SPREADS = 0.95, 2.5
SHORT_BYTES = 64
LEAST_TRUSTED = 8
FOLDS = 3
_MASK = [(1 << (8 * n)) - 1 for n in range(6)]
#: Kinds of values in the sharded model: the gain of a seen 5-gram, of a seen 4-gram, the back-off weight of a context.
_TOP, _LOWER, _CONTEXT = 1, 2, 3


def codes_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The 5 bytes that end at each byte of the slice's texts, as a number, and where each text begins."""
    data, base = bytes_of(part.column("text"))
    size = np.diff(base)
    padded = np.full(len(data) + 4 * len(size), PAD, np.int64)
    place = np.arange(len(data)) + 4 * (np.repeat(np.arange(len(size)), size) + 1)
    padded[place] = data
    code = np.zeros(len(data), np.int64)
    for k in range(ORDER):
        code |= padded[place - k] << (8 * k)
    return code, base


def _sums(column: Column, n: int) -> dict[str, Column]:
    return {"_s": F.sum(column), "_n1": F.count_if(column == 1), "_n2": F.count_if(column == 2), "_n3": F.count_if(column >= 3)}


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen once to four times; where one of these is missing
    (small or uniform texts) fixed ones, 0.5, 0.75 and 0.9."""
    n = [counts.get(k, 0) for k in range(5)]
    if not (n[1] and n[2] and n[3] and n[4]):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))


def _counts_of_counts(t: DataFrame) -> dict[int, int]:
    return {r["n"]: r["count"] for r in t.where("n <= 4").groupBy("n").count().collect()}


def _at(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones, and where (anywhere if not)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    k = np.searchsorted(known, keys)
    k[k == len(known)] = 0
    return known[k] == keys, k


class Low:
    """Orders up to 3 and the back-off weights of 3-byte contexts, from the 3-grams' counts: at most 2**24 entries."""

    def __init__(self, key: np.ndarray, n: np.ndarray, context: np.ndarray, weight: np.ndarray) -> None:
        order, by = np.argsort(key), np.argsort(context)
        self.key, self.context, self.weight = key[order], context[by], np.log(weight[by])
        p = np.full(1, 1 / 256)
        for n_bytes in (1, 2, 3):
            keys, times = self.key, n[order]
            for above in range(3, n_bytes, -1):  # distinct n-grams above, by their last bytes
                keys, times = np.unique(keys & _MASK[above - 1], return_counts=True)
            d = np.array([0.0, *_discounts(dict(zip(*np.unique(times[times <= 4], return_counts=True), strict=True)))])
            less = d[np.minimum(times, 3)]
            total, cut = np.zeros(256 ** (n_bytes - 1)), np.zeros(256 ** (n_bytes - 1))
            np.add.at(total, keys >> 8, times)
            np.add.at(cut, keys >> 8, less)
            weights = np.where(total > 0, cut / np.maximum(total, 1), 1.0)
            below = p[keys & _MASK[n_bytes - 1]]
            seen = (times - less) / total[keys >> 8] + weights[keys >> 8] * below
            if n_bytes < 3:
                p = np.tile(p, 256) * np.repeat(weights, 256) if n_bytes == 2 else np.full(256, p[0] * weights[0])
                p[keys] = seen
        self.two, self.unseen, self.three = np.log(p), np.log(weights), np.log(seen)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log-probabilities of the last of three bytes."""
        seen, k = _at(self.key, keys)
        return np.where(seen, self.three[k] if len(self.key) else 0.0, self.unseen[keys >> 8] + self.two[keys & _MASK[2]])

    def back(self, contexts: np.ndarray) -> np.ndarray:
        """Logs of back-off weights of three-byte contexts; 0 where unseen."""
        seen, k = _at(self.context, contexts)
        return np.where(seen, self.weight[k], 0.0) if len(self.context) else np.zeros(len(contexts))


class Model:
    """What scoring broadcasts: the low orders, the most frequent n-grams, and the filter of all others."""

    def __init__(self, low: Low, top: tuple, lower: tuple, context: tuple, known: np.ndarray) -> None:
        self.low, self.top, self.lower, self.context, self.known = low, top, lower, context, known

    @staticmethod
    def _find(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, k = _at(table_[0], keys)
        return seen, table_[1][k] if len(table_[0]) else np.zeros(len(keys))

    def values(self, code: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Log-probabilities of distinct codes as far as known here, and (kind, places in code, keys) to look up."""
        seen, out = self._find(self.top, code)
        rest = np.flatnonzero(~seen)
        c = code[rest]
        four, context = c & _MASK[4], c >> 8
        has, p = self._find(self.lower, four)
        value = np.where(has, p, self.low.back(context & _MASK[3]) + self.low.logs(c & _MASK[3]))
        held, weight = self._find(self.context, context)
        out = np.where(seen, out, 0.0)
        out[rest] = value + np.where(held, weight, 0.0)
        asks = []
        for kind, keys, open_ in ((_TOP, c, np.ones(len(c), bool)), (_LOWER, four, ~has), (_CONTEXT, context, ~held)):
            tagged = keys | kind << 40
            open_ &= might_hold(self.known, tagged)
            asks.append((kind, rest[open_], tagged[open_]))
        return out, asks


def _collected(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().combine_chunks().columns]


def trusted_ids(labels: DataFrame, for_training: bool) -> DataFrame:
    fold = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(FOLDS))
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(fold > 0 if for_training else fold == 0).distinct()


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of the documents to train on; a filter of their ids keeps most others out of the exchange."""
    good = trusted_ids(labels, True)
    known = docs.sparkSession.sparkContext.broadcast(filter_of(good, 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            yield batch.filter(pa.array(might_hold(known.value, batch.column(0).to_numpy())))

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")
    return some.join(good, "doc_id", "left_semi").select("text")


def train(trusted: DataFrame) -> tuple[Model, DataFrame]:
    """The broadcast part, and the sharded part: key (kind and n-gram), value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                new, n = np.unique(codes_of(part)[0], return_counts=True)
                keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(which, np.concatenate([times, n])).astype(np.int64) if len(which) else times
                if len(keys) > 1 << 20:
                    yield pa.record_batch([pa.array(keys), pa.array(times)], names=["key", "n"])
                    keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(times)], names=["key", "n"])

    by_text_batches(trusted.sparkSession)
    five = written(trusted.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts5")
    four = written(five.groupBy(F.col("key").bitwiseAND(_MASK[4]).alias("key")).agg(F.count(F.lit(1)).alias("n")), "counts4")
    three = four.groupBy(F.col("key").bitwiseAND(_MASK[3]).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    def with_context(t: DataFrame) -> DataFrame:
        """Each n-gram with its discounted share and the log of its context's back-off weight."""
        d = _discounts(_counts_of_counts(t))
        context = t.groupBy(F.shiftright("key", 8).alias("_c")).agg(*[v.alias(k) for k, v in _sums(F.col("n"), 1).items()])
        weight = context.select("_c", "_s", F.log((d[0] * F.col("_n1") + d[1] * F.col("_n2") + d[2] * F.col("_n3")) / F.col("_s")).alias("_w"))
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        return t.withColumn("_c", F.shiftright("key", 8)).join(weight, "_c").select("key", "n", "_c", "_w", ((F.col("n") - less) / F.col("_s")).alias("_p"))

    lower = with_context(four)
    back = lower.groupBy("_c").agg(F.first("_w").alias("_w"))
    key, n = _collected(three.select("key", "n"))
    context, weight = _collected(back.select("_c", "_w"))
    low = Low(key, n, context, np.exp(weight))
    shared = trusted.sparkSession.sparkContext.broadcast(low)

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, w, p = (batch.column(k).to_numpy() for k in range(4))
            below = w + shared.value.logs(key & _MASK[3])
            log = np.log(p + np.exp(below))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(log), pa.array(log - below)], names=["key", "n", "log", "gain"])

    lower = written(lower.select("key", "n", "_w", "_p").mapInArrow(fourth, "key long, n long, log double, gain double"), "order4")
    top = with_context(five).withColumn("_four", F.col("key").bitwiseAND(_MASK[4])).join(lower.select(F.col("key").alias("_four"), F.col("log").alias("_log4")), "_four")
    top = written(top.select("key", "n", "_c", "_w", F.log(F.col("_p") + F.exp(F.col("_w") + F.col("_log4"))).alias("log"), (F.col("_w") + F.col("_log4")).alias("_below")), "order5")
    contexts = top.groupBy("_c").agg(F.first("_w").alias("log"), F.sum("n").alias("n"))
    tagged = lambda kind, key: F.col(key).bitwiseOR(F.lit(kind << 40))
    sharded = written(
        top.select(tagged(_TOP, "key").alias("key"), (F.col("log") - F.col("_below")).alias("value"))
        .unionByName(lower.select(tagged(_LOWER, "key").alias("key"), F.col("gain").alias("value")))
        .unionByName(contexts.select(tagged(_CONTEXT, "_c").alias("key"), F.col("log").alias("value"))),
        "model",
    )

    def head(t: DataFrame, key: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = _collected(t.orderBy(F.desc("n"), key).limit(most).select(key, "log"))
        order = np.argsort(keys)
        return keys[order], logs[order]

    return Model(low, head(top, "key", HEAD), head(lower, "key", HEAD_LOWER), head(contexts, "_c", HEAD_LOWER), filter_of(sharded.select("key"), FILTER_BITS)), sharded


def perplexities(docs: DataFrame, model: Model, sharded: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, nll (in nats) of every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, lang string, n_bytes long, key long, n long, value double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                code, base = codes_of(part)
                size = np.diff(base)
                text = np.repeat(np.arange(len(size)), size)
                distinct, which = np.unique(code, return_inverse=True)
                values, asks = model.values(distinct)
                sums = np.bincount(text, values[which], len(size))
                rows = row + np.arange(len(size))
                row += len(size)
                nothing = pa.nulls(len(size), pa.int64())
                yield pa.record_batch([pa.array(rows), part.column("doc_id"), part.column("lang"), pa.array(size), nothing, nothing, pa.array(sums)], names=names)
                for _, places, keys in asks:
                    if not len(places):
                        continue
                    at = np.full(len(distinct), -1)
                    at[places] = np.arange(len(places))
                    ask = at[which]
                    pairs, n = np.unique(text[ask >= 0] * len(places) + ask[ask >= 0], return_counts=True)
                    own, k = np.divmod(pairs, len(places))
                    empty = pa.nulls(len(pairs), pa.int64())
                    yield pa.record_batch([pa.array(rows[own]), empty, pa.nulls(len(pairs), pa.string()), empty, pa.array(keys[k]), pa.array(n), pa.nulls(len(pairs), pa.float64())], names=names)

    by_text_batches(docs.sparkSession)
    parts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema), "partial-scores")
    asked = parts.where("key is not null").select("row", "key", "n").join(sharded, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("_more"))
    return parts.where("key is null").join(asked, "row", "left").select("doc_id", "lang", "n_bytes", (-(F.col("value") + F.coalesce("_more", F.lit(0.0)))).alias("nll"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), threshold and rejected of every row of docs (doc_id, text, lang)."""
    trusted = trusted_text(docs, labels)
    model, sharded = train(trusted)
    found = written(perplexities(docs, model, sharded).withColumn("bits", F.when(F.col("n_bytes") > 0, F.col("nll") / math.log(2) / F.col("n_bytes"))), "perplexities")
    known = found.join(trusted_ids(labels, False), "doc_id", "left_semi").where("bits is not null")
    q = lambda p: F.percentile_approx("bits", F.lit(p), F.lit(10000))
    quantiles = [F.count(F.lit(1)).alias("_n"), q(0.5).alias("_median"), q(UPPER).alias("_upper")]
    whole = known.agg(*quantiles).first()
    if not whole["_n"]:
        return found.select("doc_id", "lang", "n_bytes", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.col("bits").isNull().alias("rejected"))
    # Every language with enough trusted rows has its own quantiles, as a table of a row each.
    own = known.groupBy(F.col("lang").alias("_lang")).agg(*quantiles).where(F.col("_n") >= LEAST_TRUSTED).select("_lang", "_median", "_upper")
    own = written(own, "language-quantiles", True)
    found = found.join(F.broadcast(own) if own.tiny else own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    median, upper = F.coalesce("_median", F.lit(whole["_median"])), F.coalesce("_upper", F.lit(whole["_upper"]))
    drawn = (F.col("bits") * F.col("n_bytes") + median * SHORT_BYTES) / (F.col("n_bytes") + SHORT_BYTES)
    limit = median + SPREADS * (upper - median)
    return found.select("doc_id", "lang", "n_bytes", F.round(F.pow(F.lit(2.0), "bits"), 6).alias("perplexity"), F.round(F.pow(F.lit(2.0), limit), 6).alias("threshold"), F.coalesce(drawn > limit, F.lit(True)).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose document is not rejected; columns as they are. Rows with one id go or stay together."""
    gone = written(scores(docs, labels).where("rejected").select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
