"""Speaker clusters: centroids by DataFrame operations; merges of a file's few speakers as a fold; complete linkage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped


def speaker_shares(segments: DataFrame) -> DataFrame:
    """file_id, speaker, dur_ms, share. segments: file_id, speaker, dur_ms."""
    totals = segments.groupBy("file_id", "speaker").agg(F.sum("dur_ms").alias("dur_ms"))
    whole = F.sum("dur_ms").over(Window.partitionBy("file_id"))
    return totals.withColumn("share", F.when(whole > 0, F.col("dur_ms") / whole).otherwise(F.lit(1.0)))


def centroids(segments: DataFrame, most: int = 30) -> DataFrame:
    """The L2-normalised mean of the embeddings of each speaker's `most` longest segments (a tie: the first); null
    embeddings are left out. segments: file_id, seg_idx, speaker, dur_ms, embedding."""
    w = Window.partitionBy("file_id", "speaker").orderBy(F.desc("dur_ms"), "seg_idx")
    chosen = segments.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") <= most) & F.col("embedding").isNotNull())
    mean = chosen.select("file_id", "speaker", F.posexplode("embedding").alias("_d", "_x")).groupBy("file_id", "speaker", "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    vector = mean.groupBy("file_id", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    return vector.withColumn("_n", norm).select("file_id", "speaker", F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v")).alias("centroid"))


def cosine(a, b) -> float:  # noqa: ANN001
    """Null and zero vectors are unlike everything: -1."""
    if a is None or b is None:
        return -1.0
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = float(np.linalg.norm(x)) * float(np.linalg.norm(y))
    return float(x @ y) / size if size else -1.0


def merge_plan(dur: dict, vectors: dict, least_share: float = 0.03, minor_at: float = 0.55, main_at: float = 0.78, dominant: float = 0.6, dominant_main_at: float = 0.6, dominant_minor_at: float = 0.5) -> tuple[dict, list[tuple]]:
    """Where each speaker goes, and the events (action, from, to, similarity). Speakers with least_share or more are
    main. Minor ones join the likest main; mains join in pairs, the longer wins, until none is like enough; a speaker
    who then dominates takes in further mains, then what minor ones are left."""
    total = sum(dur.values()) or 1
    share = {k: v / total for k, v in dur.items()}
    mains = sorted((k for k in dur if share[k] >= least_share), key=lambda k: -share[k])
    minors = [k for k in dur if share[k] < least_share]
    to = {k: k for k in dur}
    events: list[tuple] = []
    if not mains:
        return to, events

    def like(a, b) -> float:  # noqa: ANN001
        return cosine(vectors.get(a), vectors.get(b))

    def send(a, b, action: str) -> None:  # noqa: ANN001
        for k, v in to.items():
            if v == a:
                to[k] = b
        to[a] = b
        events.append((action, a, b, round(like(a, b), 4)))

    for m in minors:
        if m not in vectors:
            events.append(("skip_minor_no_centroid", m, None, None))
            continue
        known = [k for k in mains if k in vectors]
        best = max(known, key=lambda k: like(m, k), default=None)
        if best is not None and like(m, best) >= minor_at:
            events.append(("minor_to_main", m, best, round(like(m, best), 4)))
            to[m] = best
        else:
            events.append(("minor_kept_isolated", m, best, None if best is None else round(like(m, best), 4)))
    standing = list(mains)
    while pair := next(((a, b) for k, a in enumerate(standing) for b in standing[k + 1 :] if like(a, b) >= main_at), None):
        winner, loser = pair if share[pair[0]] >= share[pair[1]] else pair[::-1]
        send(loser, winner, "main_merged_high_conf")
        standing.remove(loser)
    now: dict = {}
    for k, v in to.items():
        now[v] = now.get(v, 0) + dur[k]
    first = max(now, key=lambda k: now[k])
    if now[first] / total >= dominant:
        for k in standing:
            if k != first and like(k, first) >= dominant_main_at:
                send(k, first, "main_merged_dominant_mode")
        for k in [m for m in minors if to[m] == m]:
            if like(k, first) >= dominant_minor_at:
                events.append(("minor_folded_into_dominant", k, first, round(like(k, first), 4)))
                to[k] = first
    return to, events


def merge_clusters(segments: DataFrame, most: int = 30, **limits: float) -> DataFrame:
    """file_id, speaker, merged_into of every speaker. Only shares and centroids, a few rows a file, reach Python."""
    return _merged(segments, most, lambda to, _: [(k, v) for k, v in to.items()], "speaker long, merged_into long", limits)


def merge_log(segments: DataFrame, most: int = 30, **limits: float) -> DataFrame:
    """file_id, step, action, from_speaker, to_speaker, similarity: what merge_clusters did, in order."""
    return _merged(segments, most, lambda _, events: [(k, *e) for k, e in enumerate(events)], "step int, action string, from_speaker long, to_speaker long, similarity double", limits)


def _merged(segments: DataFrame, most: int, rows_of: Callable[[dict, list], list[tuple]], schema: str, limits: dict) -> DataFrame:
    # A file without a total has shares of nothing: its speakers stay as they are.
    few = speaker_shares(segments).drop("share").join(centroids(segments, most), ["file_id", "speaker"], "left").join(segments.groupBy("file_id", "speaker").agg(F.min("seg_idx").alias("_first")), ["file_id", "speaker"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_first")
        vectors = {s: v for s, v in zip(rows["speaker"], rows["centroid"]) if v is not None}
        found = rows_of(*merge_plan(dict(zip(rows["speaker"], rows["dur_ms"])), vectors, **limits))
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in found], columns=["file_id", *columns])

    return shipped(few).groupBy("file_id").applyInPandas(run, "file_id long, " + schema)


#: Distances between clusters that complete_linkage holds at once, 8 bytes each, and those computed in one step.
HELD, STEP = 1 << 25, 1 << 21


def complete_linkage(vectors: np.ndarray, most_distance: float, held: int = HELD) -> list[int]:
    """Clusters whose farthest members are at most `most_distance` apart (1 - cosine), merged nearest first (a tie: the
    first pair); numbered by first appearance. Copies start as one cluster; a vector with a NaN or infinity stays alone.
    Time grows with the square of the vectors. As long as more pairs of clusters are left than `held`, distances are
    computed from the vectors when asked for; from then on they are kept in a matrix."""
    n = len(vectors)
    if n == 0:
        return []
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        unit = vectors / np.maximum(size, 1e-12)
    # A cluster goes by its first row. Rows without a direction are unlike each other even as copies.
    first: dict = {}
    group = np.array([first.setdefault(x.tobytes(), k) if 1e-12 < s < np.inf else k for k, (x, s) in enumerate(zip(vectors + 0.0, size[:, 0]))])
    rows = np.flatnonzero((group == np.arange(n)) & np.isfinite(unit).all(axis=1))
    points = unit[rows]
    owner = np.arange(len(rows))
    if len(rows) ** 2 > held:
        owner = _merge_by_vectors(points, most_distance, int(held**0.5))
    owner = _merge_by_matrix(points, owner, most_distance)
    group[rows] = rows[owner]
    group = group[group]  # copies follow their first row
    names: dict[int, int] = {}
    return [names.setdefault(g, len(names)) for g in group.tolist()]


def _merge_nearest(least: np.ndarray, near: np.ndarray, nearest: Callable, join: Callable, most_distance: float, left: int = 1) -> None:
    """Calls join(a, b) for the nearest two clusters, a < b, until `left` clusters are left or none are near enough. The
    joined one goes by a. least, near: each cluster's distance to the nearest later one, and that one. Farthest members
    never come nearer, so a distance to a cluster that was joined since is a lower bound: nearest(a) finds the two anew
    only when the bound is the least of all."""
    stale = np.zeros(len(least), bool)
    count = len(least)
    while count > left:
        a = int(least.argmin())
        if not least[a] <= most_distance:
            return
        if stale[a]:
            near[a], least[a] = nearest(a)
            stale[a] = False
            continue
        b = int(near[a])
        join(a, b)
        stale[:b] |= (near[:b] == a) | (near[:b] == b)
        stale[a] = True
        least[b] = np.inf
        count -= 1


def _merge_by_vectors(points: np.ndarray, most_distance: float, left: int) -> np.ndarray:
    """The first point of each point's cluster after merges down to `left` clusters. Little memory: a cluster's distances
    to the later ones cost a product of its members with their points."""
    n = len(points)
    step = max(1, STEP // n)
    least, near = np.empty(n), np.empty(n, int)
    for k in range(0, n, step):
        away = 1.0 - points[k : k + step] @ points[k:].T
        away[np.tril_indices(len(away), 0, n - k)] = np.inf
        near[k : k + step] = k + away.argmin(axis=1)
        least[k : k + step] = away.min(axis=1)
    owner = np.arange(n)
    members: dict[int, list[int]] = {}

    def nearest(a: int) -> tuple[int, float]:
        rest, of = points[a + 1 :], members.get(a, [a])
        if not len(rest):
            return a, np.inf
        away = np.full(len(rest), -np.inf)
        for k in range(0, len(of), step):
            np.maximum(away, (1.0 - points[of[k : k + step]] @ rest.T).max(axis=0), out=away)
        far = np.full(len(rest), -np.inf)
        later = np.flatnonzero(owner[a + 1 :] > a)
        np.maximum.at(far, owner[a + 1 :][later] - a - 1, away[later])
        far[far == -np.inf] = np.inf
        b = int(far.argmin())
        return a + 1 + b, far[b]

    def join(a: int, b: int) -> None:
        moved = members.pop(b, [b])
        owner[moved] = a
        members.setdefault(a, [a]).extend(moved)

    _merge_nearest(least, near, nearest, join, most_distance, left)
    return owner


def _merge_by_matrix(points: np.ndarray, owner: np.ndarray, most_distance: float) -> np.ndarray:
    """owner after all further merges, by the distances of all pairs of clusters."""
    firsts, cluster = np.unique(owner, return_inverse=True)
    order = np.argsort(cluster, kind="stable")
    points, n = points[order], len(firsts)
    starts = np.searchsorted(cluster[order], np.arange(n))
    step = max(1, STEP // max(1, len(points)))
    away = np.full((n, n), -np.inf)
    for k in range(0, len(points), step):
        far = 1.0 - points[k : k + step] @ points.T
        at = cluster[order][k : k + step]
        if n < len(points):
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            far, at = np.maximum.reduceat(np.maximum.reduceat(far, starts, axis=1), cuts, axis=0), at[cuts]
        away[at] = np.maximum(away[at], far)
    np.fill_diagonal(away, np.inf)
    to = np.arange(n)

    def nearest(a: int) -> tuple[int, float]:
        rest = away[a, a + 1 :]
        if not len(rest):
            return a, np.inf
        b = int(rest.argmin())
        return a + 1 + b, rest[b]

    def join(a: int, b: int) -> None:
        to[to == b] = a
        away[a] = away[:, a] = np.maximum(away[a], away[b])
        away[a, a] = np.inf
        away[:, b] = np.inf

    found = [nearest(a) for a in range(n)]
    _merge_nearest(np.array([d for _, d in found]), np.array([b for b, _ in found], int), nearest, join, most_distance)
    return firsts[to][cluster]


def cluster_vectors(vectors: DataFrame, most_distance: float = 0.9) -> DataFrame:
    """file_id, seg_idx, cluster by complete linkage of each file's embeddings. Files are dealt out by ranges, as by hash,
    or in partitions that Spark joins as small, a task would get several of them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg_idx")
        labels = complete_linkage(np.stack([np.asarray(v, float) for v in rows["embedding"]]), most_distance)
        return pd.DataFrame({"file_id": key[0], "seg_idx": rows["seg_idx"], "cluster": labels})

    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    known = shipped(vectors).where("embedding is not null").select("file_id", "seg_idx", "embedding")
    return known.repartitionByRange(tasks, "file_id").groupBy("file_id").applyInPandas(run, "file_id long, seg_idx long, cluster int")


def _greedy(clusters: Column, names: Column) -> Column:
    """Of clusters (structs with cluster and ranked, labels best first), in order, each takes the first label that no
    earlier one has: of its ranked ones, else of names; with none left the first of names."""

    def step(done: Column, c: Column) -> Column:
        taken = F.transform(done, lambda x: x["label"])
        free = lambda labels: F.get(F.filter(labels, lambda x: ~F.array_contains(taken, x)), F.lit(0))
        return F.array_append(done, F.struct(c["cluster"].alias("cluster"), F.coalesce(free(c["ranked"]), free(names), F.get(names, F.lit(0))).alias("label")))

    return F.aggregate(clusters, F.array().cast("array<struct<cluster:bigint,label:string>>"), step)


def _assigned(totals: DataFrame, scores: DataFrame, names: DataFrame, only: Column | None = None) -> DataFrame:
    """file_id, speaker, label: clusters of totals (file_id, speaker, dur_ms) by duration, longest first (a tie: the
    smaller id), each with its labels by score (file_id, speaker, label, score; a tie: the smaller label). `only`: a
    column of names that says that the file has a single label."""
    ranked = scores.groupBy("file_id", "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), lambda x: x["label"]).alias("ranked"))
    rows = totals.join(ranked, ["file_id", "speaker"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    files = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("dur_ms")).alias("d"), F.col("speaker").cast("long").alias("cluster"), "ranked"))).alias("_c")).join(names, "file_id")
    mapped = _greedy(F.col("_c"), F.col("names"))
    if only is not None:
        other = F.coalesce(F.get(F.filter("names", lambda x: x != only), F.lit(0)), F.get("names", F.lit(1)))
        single = F.transform(F.col("_c"), lambda c, k: F.struct(c["cluster"].alias("cluster"), F.when(k == 0, only).otherwise(other).alias("label")))
        mapped = F.when(only.isNotNull(), single).otherwise(mapped)
    return files.select("file_id", F.explode(mapped).alias("_m")).select("file_id", F.col("_m.cluster").alias("speaker"), "_m.label")


def map_by_overlap(turns: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """Local clusters of turns (file_id, start_ms, end_ms, speaker) to the labels of known intervals (file_id, k_start,
    k_end, label): file_id, speaker, label. Longest cluster first, each takes its label with most overlap that is not
    taken, else the first of names (file_id, names: dominant and minority label) that is not, else the first. Where the
    known intervals have one label only, the longest cluster keeps it and the others take the other name."""
    from .intervals import overlap_join, overlap_ms

    over = overlap_ms("start_ms", "end_ms", "k_start", "k_end")
    scores = overlap_join(turns, known, "start_ms", "end_ms", "k_start", "k_end").where(over > 0).groupBy("file_id", "speaker", "label").agg(F.sum(over).alias("score"))
    totals = turns.groupBy("file_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
    labels = known.groupBy("file_id").agg(F.collect_set("label").alias("_l"))
    single = names.join(labels, "file_id", "left").select("file_id", "names", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).alias("_only"))
    return _assigned(totals, scores, single, F.col("_only"))


def map_by_centroid(local: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """Local clusters (file_id, speaker, dur_ms, centroid) to labels (file_id, label, centroid) by cosine, greedily as in
    map_by_overlap: file_id, speaker, label, scores (label and cosine to 4 digits, best first) and margin, the best less
    the second (null with fewer than two). A cluster without a centroid has neither scores nor margin."""
    from ..functions.text import cosine as alike

    pairs = local.where("centroid is not null").select("file_id", "speaker", F.col("centroid").alias("_a")).join(known.select("file_id", "label", F.col("centroid").alias("_b")), "file_id")
    scores = pairs.select("file_id", "speaker", "label", alike(F.col("_a"), F.col("_b")).alias("score"))
    ranked = scores.groupBy("file_id", "speaker").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))).alias("_r"))
    shown = F.transform("_r", lambda x: F.struct(x["label"].alias("label"), F.round(-x["s"], 4).alias("score")))
    margin = F.when(F.size("_r") > 1, F.round(F.get("_r", F.lit(1))["s"] - F.get("_r", F.lit(0))["s"], 4))
    mapped = _assigned(local.select("file_id", "speaker", "dur_ms"), scores, names)
    return mapped.join(ranked, ["file_id", "speaker"], "left").select("file_id", "speaker", "label", shown.alias("scores"), margin.alias("margin"))


def minor_to_main(segments: DataFrame, least_share: float = 0.03, minor_at: float = 0.55) -> DataFrame:
    """file_id, minor, main, similarity, action of every minor speaker: the main speaker with the likest centroid (a tie:
    the larger share, then the smaller id). minor_to_main from minor_at on, else minor_kept_isolated; without a centroid
    skip_minor_no_centroid."""
    from ..functions.text import cosine as alike

    s = speaker_shares(segments).join(centroids(segments), ["file_id", "speaker"], "left")
    a = s.where(F.col("share") < least_share).select("file_id", F.col("speaker").alias("minor"), F.col("centroid").alias("_a"))
    b = s.where((F.col("share") >= least_share) & F.col("centroid").isNotNull()).select("file_id", F.col("speaker").alias("main"), F.col("centroid").alias("_b"), "share")
    near = a.join(b, "file_id").where("_a is not null").withColumn("sim", alike(F.col("_a"), F.col("_b")))
    best = near.groupBy("file_id", "minor").agg(F.max_by(F.struct("main", "sim"), F.struct("sim", "share", -F.col("main"))).alias("_m"))
    action = F.when(F.col("_a").isNull(), "skip_minor_no_centroid").when(F.col("_m.sim") >= minor_at, "minor_to_main").otherwise("minor_kept_isolated")
    return a.join(best, ["file_id", "minor"], "left").select("file_id", "minor", F.col("_m.main").alias("main"), F.round("_m.sim", 4).alias("similarity"), action.alias("action"))


def consecutive_distances(vectors: DataFrame) -> DataFrame:
    """1 - cosine between neighbours of a file, and whether a pair of one label lies farther apart than 0.4."""
    from ..functions.text import cosine as cos

    w = Window.partitionBy("file_id").orderBy("seg_idx")
    v = vectors.select("file_id", "seg_idx", "speaker", "embedding", F.lag("embedding").over(w).alias("_e"), F.lag("speaker").over(w).alias("_s"))
    d = F.when(F.col("_e").isNotNull(), F.round(1 - cos(F.col("_e"), F.col("embedding")), 4))
    return v.withColumn("distance", d).select("file_id", "seg_idx", "distance", F.coalesce((F.col("distance") > 0.4) & (F.col("_s") == F.col("speaker")), F.lit(False)).alias("far_pair"))
