"""N-gram Jaccard join: near-duplicate documents by word shingles, with prefix filters under several token orders.

A document's set holds the 64-bit hashes of its distinct word n-grams (fewer words: the whole sequence as one).
Documents with equal sets (by 128 bits of a hash of the whole set) are one class. Two classes with Jaccard similarity t
or more share a token among the first n - ceil(t n) + 1 tokens of each under any global order of tokens. There are three
orders, each with the tokens that all documents together hold most often last and an independent permutation of the
others before them. Candidates share prefix tokens under the first; the tokens shared under each order, and all that
lies beyond, bound the overlap, and a pair must pass the bounds of all three before it is verified on the whole sets.

Tokens with the same classes count as one list with a weight. Lists of up to SMALL classes give their pairs. Longer ones
link each class to a leader; when what is linked so is known, only classes of several components that a list still joins
are compared, in cells of two blocks of bounded size, in which pairs that the orders rule out never become rows. So a
group of thousands of near copies costs a pair or two for each member, and no link between components is lost.

Defined results: null or empty texts, and texts without words, have no shingles and are linked with nothing: each is
its own component. Rows with equal ids are taken as they come. A null id links like any other and counts as no candidate
for a smallest id; a component of null ids alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bits_for, filter_of, might_hold
from .common import by_text_batches, discard, fresh, of_tiny, slices, table, written
from .components import connected_components
from .words import distinct_by_text, mix, ngrams, ordered_by_text, words_of

SHINGLE, PERCENT = 4, 85
#: A token this frequent in one gathering of FLUSH shingles is counted; the FREQUENT most frequent go last in the orders
#: (only an order: any gives the same links).
LOCAL_COUNT, FLUSH, FREQUENT = 3, 2 << 20, 1 << 19
#: Classes of a list of which all pairs are made; classes and shingles in a block of longer ones.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 256, 1 << 20
#: Rows of a table that is broadcast rather than joined by a shuffle, behind a count.
BROADCAST_ROWS = 1 << 20
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377)]
_TOP = np.uint64(1 << 63)


def shingle_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text) of a slice, ordered by text."""
    words = words_of(part.column("text"), True)
    hashes = words.hashes()
    count = np.diff(words.first)
    grams, at = ngrams(hashes, words.first, n)
    values, texts = [grams], [words.text[at] if len(at) else at]
    for k in range(1, n):
        if (count == k).any():
            grams, at = ngrams(hashes, words.first, k)
            own = words.text[at]
            values.append(grams[count[own] == k])
            texts.append(own[count[own] == k])
    return distinct_by_text(np.concatenate(values), np.concatenate(texts))


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles by counts over all documents, rarest first; at most FREQUENT, a bounded broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            held.clear()
            begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
            times = np.diff(np.append(begin, len(values)))
            keep = times >= LOCAL_COUNT
            return pa.record_batch([pa.array(values[begin[keep]].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for part in slices(batch):
                held.append(shingle_sets(part, n)[0])
                if sum(map(len, held)) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    by_text_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return top.column(0).to_numpy().astype(np.int64)[::-1].copy().view(np.uint64)


def _sizes_and_idents(values: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes | None]]:
    """The number of shingles of each text, and a 128-bit hash of its whole set (none: null)."""
    size = np.bincount(text, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    two = [np.add.reduceat(np.append(mix(values ^ s), np.uint64(0)), begin) if len(values) else np.zeros(rows, np.uint64) for s in _SALTS[:2]]
    raw = np.stack([mix(x + size.astype(np.uint64)) for x in two], axis=1).tobytes()
    return size, [raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(size)]


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - (size * percent + 99) // 100 + 1, 0)


def _ranks(values: np.ndarray, known: np.ndarray, rank: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """1 and up for frequent tokens, the most frequent last; 0 for others. The sieve spares most of these the search."""
    out = np.zeros(len(values), np.uint64)
    if len(known):
        maybe = np.flatnonzero(sieve[values >> _SIEVE_SHIFT])
        k = np.searchsorted(known, values[maybe])
        k[k == len(known)] = 0
        out[maybe] = np.where(known[k] == values[maybe], rank[k], 0)
    return out


_SIEVE_SHIFT = np.uint64(64 - 23)


def _prefix(values: np.ndarray, text: np.ndarray, ranks: np.ndarray, begin: np.ndarray, length: np.ndarray, order: int) -> np.ndarray:
    """Places, in order, of the first tokens of each text under a global order."""
    place = np.where(ranks > 0, _TOP | ranks << np.uint64(32), mix(values ^ _SALTS[2 + order]) >> np.uint64(1))
    return ordered_by_text(place, text)[np.arange(len(values)) - begin[text] < length[text]]


def _signatures(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, and the prefixes under the three orders: places of 64 bits under the
    first; the first 32 bits of places under the others, so that tokens may only seem to be shared, which keeps a pair.
    Of equal sets that one task meets only the first carries prefixes."""
    order = np.argsort(frequent)
    sieve = np.zeros(1 << 23, bool)
    sieve[frequent >> _SIEVE_SHIFT] = True
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], (order + 1).astype(np.uint64), sieve))
    schema = "doc_id long, text_hash long, n_shingles long, class_id binary, prefix array<long>, second array<int>, third array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                values, text = shingle_sets(part, n)
                size, ident = _sizes_and_idents(values, text, part.num_rows)
                first = np.zeros(part.num_rows, bool)
                for k, x in enumerate(ident):
                    if x is not None and x not in seen:
                        seen.add(x)
                        first[k] = True
                held = first[text]
                values, text = values[held], text[held]
                ranks = _ranks(values, *shared.value)
                begin = np.concatenate([[0], np.cumsum(np.where(first, size, 0))])
                length = prefix_length(np.where(first, size, 0), percent)
                ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                lists = []
                for k in range(3):
                    places = _prefix(values, text, ranks, begin, length, k)
                    short = ((places >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(short if k else places.view(np.int64)), mask=pa.array(~first)))
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(size.astype(np.int64)), pa.array(ident, pa.binary()), *lists], names=["doc_id", "text_hash", "n_shingles", "class_id", "prefix", "second", "third"])

    by_text_batches(docs.sparkSession)
    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, schema)


def _postings(signs: DataFrame) -> DataFrame:
    """token, class_id, n_shingles, last, most: the prefix tokens under the first order that several classes share, the
    last token of the class's prefix, and a bound of how many of its tokens are shared. Most tokens belong to one class:
    a filter of the shared ones keeps these out of the exchange."""
    tokens = signs.select(F.explode("prefix").alias("token"), F.xxhash64("class_id").alias("_h"))
    shared = written(tokens.groupBy("token").agg(F.min("_h").alias("_low"), F.max("_h").alias("_high")).where("_low <> _high").select("token"), "shared-tokens")
    known = signs.sparkSession.sparkContext.broadcast(filter_of(shared, bits_for(shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            values, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            keep = might_hold(known.value, values)
            owner = np.repeat(np.arange(len(size)), size)[keep]
            most, row = np.bincount(owner, minlength=len(size)), pa.array(owner)
            # With the top bit turned, places are in order as signed numbers too.
            last = values[np.cumsum(size) - 1] ^ np.int64(-1 << 63) if len(values) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(values[keep]), batch.column("class_id").take(row), batch.column("n_shingles").take(row), pa.array(last).take(row), pa.array(most).take(row)], names=["token", "class_id", "n_shingles", "last", "most"])

    by_text_batches(signs.sparkSession)
    near = signs.where("prefix is not null").select("class_id", "n_shingles", "prefix").mapInArrow(run, "token long, class_id binary, n_shingles long, last long, most long")
    # Both by token: one exchange serves the join and the search for repeats.
    out = written(near.join(shared, "token", "left_semi").distinct(), "postings")
    known.unpersist()
    discard(shared)
    return out


def _lists(postings: DataFrame) -> DataFrame:
    """The postings of one token of each different list of classes, with members (its classes) and weight (its tokens)."""
    by = postings.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("class_id")).alias("_x"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("_y"))
    one = by.groupBy("members", "_x", "_y").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "members", "weight")
    return written(postings.join(one, "token"), "lists")


def _reaches(shared: Column, n: Column, m: Column, last_n: Column, last_m: Column, percent: int) -> Column:
    """Whether sets of n and m tokens may be similar enough. Below the smaller of the last prefix tokens both are known
    whole; so what the prefixes share, and what the set with that last token has beyond its prefix, bound the overlap."""
    beyond = lambda k: F.floor((k * percent + 99) / 100).cast("long") - 1
    rest = F.when(last_n < last_m, beyond(n)).when(last_m < last_n, beyond(m)).otherwise(F.greatest(beyond(n), beyond(m)))
    return ((shared + rest) * (100 + percent) >= (n + m) * percent) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _direct_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the lists of up to SMALL classes that the first order leaves possible; tokens of longer lists
    count as shared."""
    small = lists.where(F.col("members") <= SMALL)
    long = lists.where(F.col("members") > SMALL).groupBy("class_id").agg(F.sum("weight").alias("_long"))
    x, y = (small.select("token", "weight", *[F.col(c).alias(c + s) for c in ("class_id", "n_shingles", "last", "most")]) for s in ("_a", "_b"))
    fits = _reaches(F.least("most_a", "most_b"), F.col("n_shingles_a"), F.col("n_shingles_b"), F.col("last_a"), F.col("last_b"), percent)
    found = x.join(y.drop("weight"), "token").where((F.col("class_id_a") < F.col("class_id_b")) & fits)
    found = found.groupBy("class_id_a", "class_id_b", "n_shingles_a", "n_shingles_b", "last_a", "last_b").agg(F.sum("weight").alias("_shared"))
    # A class that no longer list holds can share no more than the small ones say.
    least = F.least(F.coalesce("_long_a", F.lit(0)), F.coalesce("_long_b", F.lit(0)))
    for s in ("_a", "_b"):
        found = found.join(long.select(F.col("class_id").alias("class_id" + s), F.col("_long").alias("_long" + s)), "class_id" + s, "left")
    may = _reaches(F.col("_shared") + least, F.col("n_shingles_a"), F.col("n_shingles_b"), F.col("last_a"), F.col("last_b"), percent)
    return found.where(may).select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"))


def _star_pairs(long: DataFrame, percent: int) -> DataFrame:
    """A pair for each class of the long lists: with the leader, the class with most tokens in long lists, that leads
    most of its tokens."""
    middle = long.groupBy("class_id").agg(F.sum("weight").alias("_middle"))
    led = long.join(middle, "class_id").groupBy("token").agg(F.max_by(F.struct("class_id", "n_shingles", "last", "most"), F.struct("_middle", "class_id")).alias("_leader"))
    fits = _reaches(F.least("most", "_leader.most"), F.col("n_shingles"), F.col("_leader.n_shingles"), F.col("last"), F.col("_leader.last"), percent)
    by = long.join(led, "token").where(fits & (F.col("class_id") != F.col("_leader.class_id")))
    by = by.groupBy("class_id", F.col("_leader.class_id").alias("_by")).agg(F.sum("weight").alias("_tokens"))
    one = by.groupBy("class_id").agg(F.max_by("_by", F.struct("_tokens", "_by")).alias("_by"))
    return one.select(F.least("class_id", "_by").alias("a"), F.greatest("class_id", "_by").alias("b"))


def _sketches(signs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """One row for each of the classes (a written table): class_id, text_hash, n_shingles, second, third. A filter of the
    classes keeps the prefixes of others out of the exchange."""
    known = signs.sparkSession.sparkContext.broadcast(filter_of(classes.select(F.xxhash64("class_id")), bits_for(classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(might_hold(known.value, batch.column("_h").to_numpy()))).drop_columns(["_h"])

    by_text_batches(signs.sparkSession)
    held = signs.where("prefix is not null").select("class_id", "text_hash", "n_shingles", "second", "third", F.xxhash64("class_id").alias("_h"))
    near = held.mapInArrow(run, "class_id binary, text_hash long, n_shingles long, second array<int>, third array<int>")
    out = written(near.join(classes, "class_id", "left_semi").dropDuplicates(["class_id"]), name, True)
    known.unpersist()
    discard(classes)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()


def _may_reach(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens may be similar enough, by sorted prefixes x and y under one order: below the
    smaller of the last tokens both are known whole, so what is shared there and the smaller rest bound the overlap.
    Shortened tokens may only seem equal, which raises the bound."""
    cut = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, cut)], y[: np.searchsorted(y, cut)]
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return (shared + min(n - len(x), m - len(y))) * (100 + percent) >= percent * (n + m)


def _filtered(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the prefixes under the second and the third order leave possible."""
    left = sketches.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("_n"), F.col("second").alias("_s"), F.col("third").alias("_t"))
    right = sketches.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("_n2"), F.col("second").alias("_s2"), F.col("third").alias("_t2"))
    joined = of_tiny(pairs.select("a", "b").join(left, "a"), pairs, sketches).join(right, "b").select("a", "b", "_n", "_n2", "_s", "_s2", "_t", "_t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            keep = np.ones(batch.num_rows, bool)
            for k in (4, 6):
                sides = []
                for c in (batch.column(k), batch.column(k + 1)):
                    ends = np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])
                    sides.append((c.flatten().to_numpy(), ends))
                (x, i), (y, j) = sides
                for r in np.flatnonzero(keep):
                    keep[r] = _may_reach(x[i[r] : i[r + 1]], y[j[r] : j[r + 1]], n[r], m[r], percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    by_text_batches(pairs.sparkSession)
    return joined.mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class_id, tokens: the whole sets, 8 bytes a token in order, of documents whose text_hash is wanted, and of few
    others: a filter keeps most other texts from being cut into shingles again."""
    known = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, bits_for(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch.filter(pa.array(might_hold(known.value, batch.column("text_hash").to_numpy())))):
                values, text = shingle_sets(part, n)
                size, ident = _sizes_and_idents(values, text, part.num_rows)
                ends, raw = np.concatenate([[0], np.cumsum(size)]) * 8, values.tobytes()
                rows = []
                for x, (a, b) in zip(ident, pairwise(ends), strict=True):
                    if x is not None and x not in seen:
                        seen.add(x)
                        rows.append((x, raw[a:b]))
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["class_id", "tokens"])

    by_text_batches(docs.sparkSession)
    return docs.where("text is not null").select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "class_id binary, tokens binary").dropDuplicates(["class_id"])


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    ends = written(sketches.join(_ends(pairs), "class_id", "left_semi").select("text_hash"), "wanted", True)
    sets = written(_sets(docs, ends, n), "sets", True)
    left = sets.select(F.col("class_id").alias("a"), F.col("tokens").alias("_left"))
    right = sets.select(F.col("class_id").alias("b"), F.col("tokens").alias("_right"))
    joined = of_tiny(pairs.join(left, "a"), pairs, sets).join(right, "b").select("a", "b", "_left", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate([np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    by_text_batches(pairs.sparkSession)
    links = written(joined.mapInArrow(run, "a binary, b binary"), "links", True)
    discard(ends, sets)
    return links


def _open_lists(long: DataFrame, labels: DataFrame) -> DataFrame:
    """The long lists, with labels, that join several components."""
    known = long.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    several = known.groupBy("token").agg(F.min(F.xxhash64("label")).alias("_low"), F.max(F.xxhash64("label")).alias("_high")).where("_low <> _high").select("token")
    return written(known.join(several, "token", "left_semi").select("token", "class_id", "n_shingles", "members", "label"), "open-lists", True)


def _cells(open_: DataFrame) -> DataFrame:
    """cell, token, side, class_id, label, home: the classes of each list in blocks, and a cell for each two blocks (and
    for each alone) that may hold pairs to compare. A class is at home in the longest of its lists: two with one home are
    compared there and nowhere else, two of one component nowhere. Of a list, classes of one home, and of one home and
    label, fill blocks of their own where they are many; pairs of such blocks with nothing to compare give no cell."""
    home = open_.groupBy("class_id").agg(F.max(F.struct("members", "token"))["token"].alias("home"))
    known = open_.join(home, "class_id")
    kinds = known.groupBy("token", "home", "label").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_size"))
    homes = kinds.groupBy("token", "home").agg(F.sum("_n").alias("_all"))
    kinds = kinds.join(homes, ["token", "home"]).select("token", "home", "label", "_n", "_size", F.when(F.col("_all") >= BLOCK, F.col("home")).alias("_home"), F.when(F.col("_n") >= BLOCK, F.col("label")).alias("_label"))
    kinds = written(kinds, "kinds", True)
    kind = F.xxhash64(F.coalesce("_home", F.lit(0)), F.col("_home").isNull(), F.coalesce("_label", F.lit(b"")), F.col("_label").isNull()).alias("kind")
    many = F.greatest(F.ceil(F.sum("_n") / BLOCK), F.ceil(F.sum("_size") / BLOCK_SHINGLES)).cast("long")
    sums = kinds.groupBy("token", "_home", "_label", kind).agg(many.alias("blocks"))
    blocks = sums.select("token", "_home", "_label", "kind", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    x, y = (blocks.select("token", *[F.col(c).alias(c + s) for c in ("_home", "_label", "kind", "block")]) for s in ("_x", "_y"))
    ordered = F.struct("kind_x", "block_x") <= F.struct("kind_y", "block_y")
    same_home = F.coalesce((F.col("_home_x") == F.col("_home_y")) & (F.col("_home_x") != F.col("token")), F.lit(False))
    same_label = F.coalesce(F.col("_label_x") == F.col("_label_y"), F.lit(False))
    cells = x.join(y, "token").where(ordered & ~same_home & ~same_label).withColumn("cell", F.xxhash64("token", "kind_x", "block_x", "kind_y", "block_y"))
    sides = [F.struct(F.col("kind" + s).alias("kind"), F.col("block" + s).alias("block"), F.lit(k).alias("side")) for k, s in enumerate(("_x", "_y"))]
    alone = F.col("side.side").eqNullSafe(0) | (F.col("kind_x") != F.col("kind_y")) | (F.col("block_x") != F.col("block_y"))
    sided = cells.withColumn("side", F.explode(F.array(*sides))).where(alone).select("token", "cell", "side.*")
    members = known.join(kinds.join(sums.withColumnRenamed("_home", "_h").withColumnRenamed("_label", "_l").withColumnRenamed("token", "_t"), (F.col("token") == F.col("_t")) & F.col("_home").eqNullSafe(F.col("_h")) & F.col("_label").eqNullSafe(F.col("_l"))).select("token", "home", "label", "kind", "blocks"), ["token", "home", "label"])
    members = members.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    return members.select("token", "kind", "block", "class_id", "label", "home").join(sided, ["token", "kind", "block"]).select("cell", "token", "side", "class_id", "label", "home")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _compare(rows: pa.Table, percent: int) -> pa.Table:
    """The pairs of a cell that the second and the third order leave possible, by counts over an inverted index."""
    ident, label = rows.column("class_id").combine_chunks(), _codes(rows.column("label"))
    name, size, side, home, token = _codes(rows.column("class_id")), *(rows.column(c).to_numpy() for c in ("n_shingles", "side", "home", "token"))
    two, beyond = side.any(), size - prefix_length(size, percent)
    indexes = []
    for c in ("second", "third"):
        lists = rows.column(c).combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        tokens, which = np.unique(flat, return_inverse=True)
        order = np.argsort(which, kind="stable")
        owner = np.repeat(np.arange(len(size)), np.diff(ends))[order]
        indexes.append((ends, which, owner, np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(tokens)))]), flat[ends[1:] - 1]))
    left, right = [], []
    for k in range(len(size)):
        if two and side[k]:
            continue
        keep = (label != label[k]) & ((home != home[k]) | (home == token)) & (np.minimum(size, size[k]) * 100 >= np.maximum(size, size[k]) * percent)
        keep &= side == 1 if two else np.arange(len(size)) > k
        for ends, which, owner, first, last in indexes:
            if keep.any():
                mine = which[ends[k] : ends[k + 1]]
                count = first[mine + 1] - first[mine]
                at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                rest = np.where(last[k] < last, beyond[k], np.where(last < last[k], beyond, np.maximum(beyond, beyond[k])))
                keep &= (np.bincount(owner[at], minlength=len(size)) + rest) * (100 + percent) >= percent * (size + size[k])
        found = np.flatnonzero(keep & (name != name[k]))
        left.append(np.full(len(found), k))
        right.append(found)
    i, j = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
    pairs = [sorted(p) for p in zip(ident.take(pa.array(i)).to_pylist(), ident.take(pa.array(j)).to_pylist(), strict=True)]
    return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _cell_pairs(open_: DataFrame, signs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that the orders leave possible among the classes of the open lists."""
    sketches = _sketches(signs, written(open_.select("class_id").distinct(), "open-classes", True), "open-sketches")
    full = _cells(open_).join(sketches.select("class_id", "n_shingles", "second", "third"), "class_id")
    by_text_batches(open_.sparkSession)
    found = full.groupBy("cell").applyInArrow(lambda rows: _compare(rows, percent), "a binary, b binary")
    return written(found.distinct(), "open-pairs", True), sketches


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows of docs, and node, label: the component of each class that is linked with another."""
    signs = written(_signatures(docs, shingle, percent, frequent_tokens(docs, shingle)), "signatures")
    postings = _postings(signs)
    lists = _lists(postings)
    discard(postings)
    long = lists.where(F.col("members") > SMALL)
    pairs = written(_direct_pairs(lists, percent).unionByName(_star_pairs(long, percent)).distinct(), "pairs", True)
    sketches = _sketches(signs, written(_ends(pairs), "ends", True), "sketches")
    near = written(_filtered(pairs, sketches, percent), "near-pairs", True)
    links = _verified(docs, near, sketches, shingle, percent)
    labels = connected_components(links)
    discard(pairs, sketches, near)
    open_ = _open_lists(long, labels)
    if not open_.isEmpty():
        near, sketches = _cell_pairs(open_, signs, percent)
        more = _verified(docs, near, sketches, shingle, percent)
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
        discard(near, sketches, more)
    discard(lists, links, open_)
    return signs, labels


def _with_components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (null: linked with nothing, not even itself), for every row of docs."""
    signs, labels = _classes(docs, shingle, percent)
    known = signs.select("doc_id", "text_hash", "n_shingles", "class_id").join(labels, signs["class_id"] == labels["node"], "left")
    out = written(known.select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "class_id").alias("component")), "components")
    discard(signs)
    return out


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    found = _with_components(_narrow(docs), shingle, percent)
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("_least"))
    return found.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, columns as they are: the smallest id (nulls last), of its texts the one with
    the smallest hash, of rows that agree in both any one. Rows without words all stay."""
    found = _with_components(_narrow(docs), shingle, percent)
    each = found.where("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")).alias("_first"))
    judged = each.join(first, "component").withColumn("_is", F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_hash") == F.col("_first.text_hash")))
    ids, texts = fresh(docs, "_gone_id"), fresh(docs, "_gone_text")
    judged = written(judged.where("not _is or _rows > 1").select(F.col("doc_id").alias(ids), F.col("text_hash").alias(texts), "_is"), "judged")
    rows = judged.agg(F.count(F.lit(1)), F.count_if("_is")).first()
    side = lambda t, n: F.broadcast(t.drop("_is")) if n <= BROADCAST_ROWS else t.drop("_is")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ids)) & (F.xxhash64(F.col("text").cast("string")) == F.col(texts))
    kept = docs.join(side(judged, rows[0]), same, "left_anti")
    if not rows[1]:
        return kept
    return kept.unionByName(docs.join(side(judged.where("_is"), rows[1]), same).dropDuplicates([ids, texts]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


ORACLE = f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))) end as s from words
), tokens as (select doc_id, len(s) as n, hash(unnest(s)) as t from sets),
held as (select * from tokens where t in (select t from tokens group by t having count(*) > 1)),
links as (
  select a.doc_id as a, b.doc_id as b from held a join held b on a.t = b.t and a.doc_id <> b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {PERCENT}
  group by a.doc_id, b.doc_id, a.n, b.n having count(*) * 100 >= {PERCENT} * (a.n + b.n - count(*))
), reach as (
  select doc_id as node, doc_id as seen from sets union select r.node, l.b from reach r join links l on l.a = r.seen
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.seen) as component_id from sets s join reach r on r.node = s.doc_id group by s.doc_id, s.s"""
