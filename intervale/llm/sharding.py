"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until splitters meet tolerance.

DataFrame operations only. Rows are ordered by a 64-bit key, a hash of the document's id and text checksum whose low
bits are salted by row, so that repeated rows and a hot id can be split between shards. Rounds of probing count the
bytes of every bucket that still holds a boundary, 256 parts at a time, until each boundary is within the tolerance
or its bucket cannot be divided; the driver sees at most 256 sums a boundary. One exchange then places the rows.

Law `bytes`: shards have near-equal sums of sizes. Every row gets a shard and a slot, gapless from 0 in each shard.
Equal texts under different ids may go to different shards, as the id is part of the key.
Null ids, null texts, repeated rows and an empty table are allowed.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 40
ROW_BYTES = 16
FAN_BITS = 8
SALT_BITS = 20
#: A boundary may miss its target by this share of a shard; nearer where no row lies between.
TOLERANCE = 0.0002
#: Rows that one task numbers at a time, about.
SLOT_ROWS = 20_000


def _key() -> Column:
    """Non-negative, 63 bits."""
    plain = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.col("size")), 1)
    salt = F.xxhash64(F.col("_row")).bitwiseAND(F.lit((1 << SALT_BITS) - 1))
    return plain.bitwiseAND(F.lit(((1 << 63) - 1) ^ ((1 << SALT_BITS) - 1))).bitwiseOR(salt)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row, written once so that probing does not read texts."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"))
    return written(narrow.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", _key()).drop("_row"), "sizes")


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys at which shards 1, 2, ... begin: a row belongs to the number of splitters at or below its key."""
    (total,) = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    if not total:
        return []
    slack = tolerance * total / shards
    targets = [total * k / shards for k in range(1, shards)]
    # An open boundary: (bytes below the bucket, the bucket's prefix); all begin in the bucket of all keys.
    found: dict[int, int] = {}
    open_: dict[int, tuple[int, int]] = {k: (0, 0) for k in range(len(targets))}
    bits = 63
    while open_:
        step = min(FAN_BITS, bits)
        prefixes = sorted({p for _, p in open_.values()})
        inside = F.shiftright("_key", bits).isin(prefixes) if bits < 63 else F.lit(True)
        sums: dict[int, int] = {r["b"]: r["s"] for r in rows.where(inside).groupBy(F.shiftright("_key", bits - step).alias("b")).agg(F.sum("size").alias("s")).collect()}
        bits -= step
        bounds: dict[int, tuple[list[int], list[int]]] = {}
        for p in prefixes:
            parts = range(p << step, (p + 1) << step)
            below, sofar = [], 0
            for b in parts:
                below.append(sofar)
                sofar += sums.get(b, 0)
            bounds[p] = ([*parts, (p + 1) << step], [*below, sofar])
        still = {}
        for k, (base, p) in open_.items():
            edges, below = bounds[p]
            at = bisect_left(below, targets[k] - base)
            at = min(max(at, 1), len(edges) - 1)
            lower, upper = base + below[at - 1], base + below[at]
            nearest = at if upper - targets[k] <= targets[k] - lower else at - 1
            if abs(base + below[nearest] - targets[k]) <= slack or not bits:
                found[k] = edges[nearest] << bits
            else:
                still[k] = (lower, edges[at - 1])
        open_ = still
    return [found[k] for k in range(len(targets))]


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    rows = measured(docs)
    cuts = splitters(rows, shards, tolerance)
    starts = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.array().cast("array<long>")
    placed = rows.withColumn("shard", F.aggregate(starts, F.lit(0), lambda n, x: n + (x <= F.col("_key")).cast("int")))
    # Slots: rows before this bucket of the shard, and the place inside it. Buckets go by the salt, which is random by
    # row, so they hold about SLOT_ROWS rows each, whatever ids and texts repeat.
    count = rows.count()
    fine_bits = min(SALT_BITS, max(0, (count // (shards * SLOT_ROWS)).bit_length()))
    placed = placed.withColumn("_fine", F.shiftright(F.col("_key").bitwiseAND((1 << SALT_BITS) - 1), SALT_BITS - fine_bits))
    counts = placed.groupBy("shard", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_fine").orderBy("_key", "doc_id", "text_crc32", "size")
    numbered = placed.withColumn("_place", F.row_number().over(inside)).join(before, ["shard", "_fine"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
