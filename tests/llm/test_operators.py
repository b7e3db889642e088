"""Whole operators: against brute force, held-out labels, planted cases, and every kind of odd row."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from intervale.llm import decontamination, jaccard, language, lines, media, packing, quality, queries, sharding, toxicity, urls

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, repeated rows and ids, ties.
ODD = [
    (None, None, None, None, None), (None, "a null id with some words", "en", None, 5), (1, "", "en", "s1", 0), (1, "", "en", "s1", 0), (2, " \n\t ", None, "s2", 4), (3, "the same words come here again and again", "en", "s3", 9),
    (4, "the same words come here again and again", "fr", "s4", 9), (4, "another text under the id four", "fr", "s4", 9), (5, "word " * 40_000, "en", "s5", 200_000), (6, "x" * 100_000, "en", "s6", 100_000), (7, "ÀÉ 漢字 🙂 \u00a0 Ω", "de", "s7", 9), (8, "12 34 ... !!", "de", "s8", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, DOCS)
    for c in ("key", "n", "row", "line", "site", "token", "label", "keeper", "class_id", "_gone", "_doc", "lines_removed2", "score"):
        d = d.withColumn(c, F.lit(1))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def test_media_rows(spark, odd):
    rows = media.media_digest(odd).collect()
    assert len(rows) == len(ODD) and media.media_digest(empty(spark, odd)).count() == 0
    assert {r["n_bytes"] for r in rows} == {len((t or "").encode()) for _, t, *_ in ODD}
    pictures = spark.createDataFrame([(1, media.encode_bmp(media.decode(b"P2\n4 4\n9\n" + b"1 2 3 4 " * 4))), (2, None), (3, b"no")], "doc_id long, media binary")
    found = {r["doc_id"]: r for r in media.media_features(pictures.withColumn("height", F.lit(1)).withColumn("tiles", F.lit("x"))).collect()}
    assert media.media_features(pictures.limit(0)).count() == 0
    assert len(found[1]["tiles"]) == 4 and found[2]["dhash"] is None and found[3]["tiles"] is None


def test_packing_rows(spark, odd):
    rows = packing.pack_documents(odd, block_tokens=3000).collect()
    assert sum(r["length"] for r in rows) == sum(len(packing.encoder(packing.default_tokenizer())(t or "")) + 1 for _, t, *_ in ODD)
    assert packing.pack_documents(empty(spark, odd)).count() == 0


def test_packing_of_added_tokens(spark):
    docs = spark.createDataFrame([(1, "hello <|endoftext|> world")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    ids = [31373, 220, 50256, 995, packing.END_ID]
    for r in rows:
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]]))
    assert sum(r["length"] for r in rows) == len(ids)


def test_sharding_rows(spark, odd):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == len(ODD) and sharding.shard_documents(empty(spark, odd), 4).count() == 0
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    found = sharding.shard_documents(same, 8).collect()
    sizes = [sum(r["size"] for r in found if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 40
    for k in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_slots_of_a_hot_row_lie_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    rows = same.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")))
    found = sharding.shard_documents(rows, 8).collect()
    for k in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) > 300


def test_media_query_returns_digests_and_tiles(spark):
    import hashlib
    import io

    import numpy as np

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = media.query(spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        form = media.stored_form(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(form))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(form).hexdigest()
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        assert r["feature"] == media.difference_hash(image)
        whole = np.zeros((media.SIDE, media.SIDE), np.uint8)
        for t in r["tiles"]:
            part = np.load(io.BytesIO(t["npy"]))
            whole[t["row"] : t["row"] + part.shape[0], t["column"] : t["column"] + part.shape[1]] = part
        assert (whole == media.area_resize(image, media.SIDE, media.SIDE)).all()


def test_sharding_is_balanced(spark):
    rows = sharding.query(spark, MIDDLE).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 2 * rows["size"].max()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert all(zlib.crc32(text[d].encode()) == c and len(text[d].encode()) + 16 == s for d, c, s in zip(rows.doc_id, rows.text_crc32, rows["size"]))


def test_urls_follow_rules(spark):
    cases = {"http://example.com/en/7x": ("example.com/en/7", "allow"), "http://a.example.com/en/8": ("com/en/", "block"), "https://x.net/de/1": ("net/de/", "allow"), "https://EXAMPLE.net/de/8/q": ("example.net/de/8", "block"), "http://notcom/en/": (None, None), "http://org/es/": ("org/es/", "block"), None: (None, None), "": (None, None)}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    for r in urls.filter_urls(pages).collect():
        rule, verdict = list(cases.values())[r["page_id"]]
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    labelled = spark.createDataFrame([*urls.labelled_urls(), (None, 1), ("http://x.org/", None)], "url string, label int")
    own = urls.weights_of(labelled)
    assert len(own) == urls.DIMENSIONS + 1 and urls.filter_urls(pages, own).count() == len(cases) and urls.filter_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.weights_of(spark.range(urls.MOST_LABELLED + 1).select(F.lit("http://a.org/").alias("url"), F.lit(0).alias("label")))
    weights = urls.train(urls.labelled_urls())
    z = lambda u: weights[-1] + sum(weights[b] for b in urls.features(*urls.split_url(u))) / len(urls.features(*urls.split_url(u))) ** 0.5
    right = sum((z(u) > 0) == bool(y) for u, y in urls.labelled_urls())
    assert right >= 0.97 * len(urls.labelled_urls())
    assert z("https://casino-prizes.example.net/x") > 0 > z("https://www.weather-report.example.org/x")


def test_lines_against_brute_force(spark, odd):
    r = random.Random(1)
    common = [f"this is the shared line number {k} of many sites" for k in range(6)]
    rows = []
    for k in range(120):
        own = [f"a line that only document {k} holds, part {j}" for j in range(3)] + r.sample(common, r.randrange(3)) + ["short"]
        r.shuffle(own)
        rows.append((k, "\n".join(own), f"s{k % r.choice([3, 11])}"))
    sites, first = {}, {}
    key = lambda x: x.strip(" ").lower()
    for d, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(key(x), set()).add(s)
            first.setdefault(key(x), d)
    least = lambda x: lines.MIN_SITES if len(x.strip(" ")) >= lines.MIN_CHARS else lines.SHORT_SITES
    want = {d: "\n".join(x for x in t.split("\n") if len(sites[key(x)]) < least(x) or first[key(x)] == d) for d, t, _ in rows}
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want and got != {d: t for d, t, _ in rows}
    want = {d: "\n".join(x for x in t.split("\n") if len(sites[key(x)]) < lines.MIN_SITES or first[key(x)] == d) for d, t, _ in rows}
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_chars=0).collect()}
    assert got == want and not any("short" in t.split("\n") for d, t in got.items() if d != first["short"])
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty(spark, odd)).count() == 0
    assert set(odd.columns) <= set(lines.dedup_lines(odd).columns)


def test_short_lines_of_many_sites_go(spark, odd):
    rows = [(k, f"All rights reserved.\n\n a line that only document {k} holds \nchance", f"s{k % 20}") for k in range(60)]
    rows += [(60 + k, "by chance.\nown", f"s{k}") for k in range(lines.SHORT_SITES - 1)]
    sites, first = {}, {}
    for d, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(x.strip(" ").lower(), set()).add(s)
            first.setdefault(x.strip(" ").lower(), d)
    least = lambda x: lines.MIN_SITES if len(x.strip(" ")) >= lines.MIN_CHARS else lines.SHORT_SITES
    gone = lambda x, d: x.strip(" ") and len(sites[x.strip(" ").lower()]) >= least(x) and first[x.strip(" ").lower()] != d
    want = {d: "\n".join(x for x in t.split("\n") if not gone(x, d)) for d, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(docs).collect()}
    assert got == want and "All rights reserved." in got[0] and not any("All rights reserved." in got[k] for k in range(1, 60))
    assert all(got[60 + k] == "by chance.\nown" for k in range(lines.SHORT_SITES - 1))
    assert lines.dedup_lines(odd).count() == len(ODD)


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = language.label_spans(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    model = language.learn(docs)
    one = {k: docs.where(F.col("lang") == k).select("text").first()["text"][:1500] for k in ("en", "de")}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["de"])], "doc_id long, text string")
    assert {s["lang"] for s in language.label_spans(mixed, model).first()["spans"]} >= {"en", "de"}
    found = language.label_spans(odd, model).collect()
    assert len(found) == len(ODD) and {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 8)} == {"und"}
    assert all(r["lang_pred"] != "und" for r in found if r["doc_id"] in (3, 5, 6, 7))
    nobody = language.learn(empty(spark, odd))
    assert nobody is None and {r["lang_pred"] for r in language.label_spans(odd, nobody).collect()} == {"und"}
    language.label_spans(odd, language.learn(odd)).collect()


def test_every_labelled_language_is_learnt(spark):
    r = random.Random(13)
    words = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(300)]
    rows = [(k * 20 + j, " ".join(r.choices(w, k=30)), f"l{k:03}", "s", 1) for k, w in enumerate(words) for j in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs)
    assert len(model.languages) == 300
    found = language.label_spans(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in found) >= 0.97 * len(found)


def test_toxicity_on_held_out_rows(spark, odd, labels):
    docs, marks = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.learn(docs, marks)).join(marks, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.93 * len(rows)
    assert any(r["spans"] for r in rows if r["predicted"])
    for model in (toxicity.learn(odd, labels), toxicity.learn(odd, labels.limit(0)), None):
        found = toxicity.score(odd, model).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)


def near_copies(seed, groups=6, size=14):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    common = [word() for _ in range(12)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(r.randrange(60, 140))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy += common
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 50)] + ["one two", "ONE  two", None, "", " "]
    r.shuffle(rows)
    return list(enumerate(rows))


def brute_components(rows, n=4, percent=85):
    import re

    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("seed", "small", "block"), [(1, 16, 512), (2, 1, 8)])
def test_jaccard_against_brute_force(spark, seed, small, block, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(seed)
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_jaccard_links_through_a_null_id(spark):
    r = random.Random(4)
    words = ["w%d" % r.randrange(9999) for _ in range(120)]
    a, b, c = (" ".join([*words[:k], "x%d" % k, *words[k + 1 :]]) if k else " ".join(words) for k in (20, 0, 90))
    far = " ".join([*words[:10], "p", *words[11:40], "q", *words[41:]])
    texts = {"a": a, "b": b, "c": c, "far": far}
    assert len({d: v for d, v in brute_components([(1, a), (3, c)]).items() if v[1] == 1}) in (1, 2)
    rows = [(1, texts["a"]), (None, texts["b"]), (3, texts["c"])]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"]) for x in found} == {(1, 1), (None, 1), (3, 1)}


def test_jaccard_keeps_one_row_of_each_component(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(5, base, 1), (5, base, 2), (None, base, 3), (7, base + "  ", 4), (8, "other words that are in no other text at all", 5), (None, "", 6), (None, None, 7), (8, None, 8), (9, "only here", 9), (9, "a different one", 10)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _gone_id int")).collect()
    assert sorted(x["_gone_id"] for x in kept if x["_gone_id"] > 4) == [5, 6, 7, 8, 9, 10]
    assert [x["doc_id"] for x in kept if x["_gone_id"] <= 4] == [5]
    only_null = spark.createDataFrame([(None, base), (None, base), (None, base + " x")], "doc_id long, text string")
    assert jaccard.keep_one(only_null, 5, 80).count() == 1


def test_jaccard_of_many_long_near_copies(spark):
    """A group of near copies of long texts, each with its own changes, links without a pair for each two."""
    r = random.Random(9)
    base = ["w%d" % r.randrange(50_000) for _ in range(3000)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(12):
            copy[r.randrange(len(copy))] = "e%d" % r.randrange(10**9)
        rows.append((k, " ".join(copy)))
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["component_id"] for x in found} == {0}


def test_jaccard_odd_rows(spark, odd):
    found = jaccard.components(odd).collect()
    assert len(found) == len(ODD) and {r["component_id"] for r in found if r["doc_id"] in (3,)} == {3}
    assert 3 in {r["component_id"] for r in found if r["doc_id"] == 4}
    assert jaccard.components(empty(spark, odd)).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1


def test_decontamination_finds_edited_copies(spark, odd):
    r = random.Random(7)
    word = lambda: "t%d" % r.randrange(5000)
    items = [[word() for _ in range(r.randrange(30, 50))] for _ in range(12)] + [["few", "words"], []]
    benchmark = spark.createDataFrame([(k, " ".join(w) if w else None) for k, w in enumerate(items)], "item_id long, text string")
    rows, want = [], set()
    for d in range(60):
        body = [word() for _ in range(200)]
        if d % 3 == 0:
            passage = list(items[d % 12])
            for _ in range(len(passage) * (d % 4) // 16):
                passage[r.randrange(len(passage))] = word()
            body[50:50] = ([x.upper() + "," for x in passage] if d % 2 else passage)
            want.add((d, d % 12))
        rows.append((d, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.find(docs, benchmark).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == want
    for x in found:
        got = rows[x["doc_id"]][1].encode()[x["start_byte"] : x["end_byte"]].decode().lower().replace(",", "").split()
        assert len(set(got) & set(items[x["item_id"]])) >= 0.6 * len(set(items[x["item_id"]]))
    assert {x["doc_id"] for x in decontamination.clean(docs, benchmark).collect()} == set(range(60)) - {d for d, _ in want}
    assert decontamination.find(odd, benchmark).count() == 0 and decontamination.clean(odd, benchmark.limit(0)).count() == len(ODD)
    assert decontamination.find(empty(spark, odd), benchmark).count() == 0
    assert decontamination.clean(odd, benchmark).columns == odd.columns


def test_decontamination_finds_copies_without_long_runs(spark):
    r = random.Random(11)
    word = lambda: "t%d" % r.randrange(5000)
    items = [[word() for _ in range(n)] for n in (15, 23, 40)]
    passages = []
    for w in items:
        passages.append([word() if k % 4 == 3 else x for k, x in enumerate(w)])  # each fourth word replaced
        passages.append([x for y in w for x in (y, word())])  # a word after each
        passages.append([x for k, x in enumerate(w) if k % 3])  # each third word left out
    rows = [(d, " ".join([word() for _ in range(50)] + p + [word() for _ in range(50)])) for d, p in enumerate(passages)]
    rows.append((9, " ".join(word() for _ in range(5000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.find(docs, benchmark).collect()} == {(d, d // 3) for d in range(9)}
    assert [x["doc_id"] for x in decontamination.clean(docs, benchmark).collect()] == [9]


def test_quality_keeps_good_documents(spark, odd, labels):
    docs, marks = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, marks).join(marks, "doc_id").collect()
    good, bad = ([r["rejected"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) <= 0.03 * len(good) and sum(bad) >= 0.9 * len(bad)
    for d, m in ((odd, labels), (odd, labels.limit(0)), (empty(spark, odd), labels)):
        found = quality.scores(d, m).collect()
        assert len(found) == d.count() and all(r["rejected"] for r in found if r["doc_id"] == 1)
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_queries_with_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL).toPandas()
        want = duck.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        a, b = ({tuple("~" if x != x or x is None else x for x in r) for r in f[columns].itertuples(index=False)} for f in (got, want))
        assert a == b and len(got) == len(want)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, MIDDLE).cache()
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] >= 0.5 * counts[0]
    marks = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    assert kept.join(marks.where("quality = 0"), "doc_id").count() <= 0.1 * marks.where("quality = 0").count()
    assert decontamination.find(kept, spark.read.parquet(f"{MIDDLE}/benchmark.parquet")).count() == 0
    pieces = p.STAGES[-1][1](spark, kept, MIDDLE)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_decontamination_carries_text_ids(spark):
    benchmark = spark.createDataFrame([("item-a", "alpha beta gamma delta epsilon zeta eta theta"), (None, "one two three four five six seven")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta eta theta it is, alpha beta gamma delta epsilon zeta eta theta again"), (2, "nothing"), (None, "one two three four five six seven")], "doc_id long, text string")
    found = decontamination.find(docs, benchmark).collect()
    assert sorted((str(x["doc_id"]), str(x["item_id"])) for x in found) == [("1", "item-a"), ("1", "item-a"), ("None", "None")]
    assert [x["doc_id"] for x in decontamination.clean(docs, benchmark).collect()] == [2]


def test_every_language_has_its_own_threshold(spark):
    r = random.Random(2)
    rows = [(k, " ".join("".join(r.choices("abcde" if k % 2 else "vwxyz", k=5)) for _ in range(80)), f"l{k % 40:02}", "s", 1) for k in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(k, 1) for k in range(4000)], "doc_id long, quality int")
    found = quality.scores(docs, marks).select("lang", "threshold").distinct().collect()
    assert len({x["lang"] for x in found}) == 40 == len(found) and len({x["threshold"] for x in found}) > 20


def test_pipeline_of_odd_rows(spark, odd):
    import corpus_pipeline as p

    columns = odd.columns
    for docs in (odd, empty(spark, odd)):
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), odd.schema)
        p.STAGES[-1][1](spark, docs, SMALL).count()
    # Each stage by itself: what it may not take away stays, whatever its ids and texts.
    assert p.near_duplicate_stage(spark, odd, SMALL).where("text is null or trim(text) = ''").count() == odd.where("text is null or trim(text) = ''").count()
    assert p.decontamination_stage(spark, odd, SMALL).count() == len(ODD) and p.line_stage(spark, odd, SMALL).count() == len(ODD)
    assert p.packing_stage(spark, odd, SMALL).select("doc_id").distinct().count() == len({x[0] for x in ODD})
