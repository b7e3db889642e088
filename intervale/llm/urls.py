"""URL filters: rules by host suffix and path prefix, then logistic regression on hashed character n-grams.

Scoring uses DataFrame functions only. The model is fitted on the driver from a small labelled URL table (at most
MOST_LABELLED rows, a documented bound); its weights are an array of DIMENSIONS numbers. A null URL, or one without
`://`, has an empty host and path, which no rule fits; without a host the model's intercept alone judges, in training
too. Rows are never dropped or merged; other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path); the longest that fits decides.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SIZES = (3, 4)
DIMENSIONS = 1024
MOST_LABELLED = 10_000
#: Least probability at which the model blocks: neighbouring words share n-grams with listed ones.
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the default labelled table, and the paths that both classes share.
_GOOD_WORDS = """weather nation theatre method thunder station thread garden health north earth other gathering library history science
music travel recipe school museum forum market review photo cinema sport village kitchen journal harbour mountain river island
bakery bicycle painter teacher engineer carpenter orchard meadow winter summer autumn morning evening language grammar letter
number algebra geometry physics chemistry biology medicine hospital dentist pharmacy lawyer notary council parliament election
budget insurance railway airport ferry tunnel bridge castle cathedral orchestra concert festival gallery sculpture poetry novel
theory archive catalogue dictionary atlas compass telescope satellite computer keyboard printer software compiler database server
football tennis hockey swimming climbing sailing fishing chess puzzle toy furniture ceramic textile leather timber cement copper
energy solar climate forest wildlife insect flower vegetable cheese butter coffee vineyard brewery restaurant hotel camping""".split()
_BAD_WORDS = "casino bets pills spam adult ads track loans xxx jackpot slots cheap free win porn farm replica poker prize cams".split()
_PATHS = ("/en/4821", "/fr/913.html", "/de/7710/", "/es/20145")


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table: url, 1 for those to block. Ordinary words and pairs of them against listed ones."""
    out = []
    pairs = [f"{a}-{b}" for a, b in zip(_GOOD_WORDS, _GOOD_WORDS[7:])]
    for k, word in enumerate(_GOOD_WORDS + pairs):
        sub = ("", "www.", "m.", "blog.")[k % 4]
        out.append((f"https://{sub}{word}.example.{('com', 'net', 'org')[k % 3]}{_PATHS[k // 3 % 4]}", 0))
    for k, word in enumerate(_BAD_WORDS):
        for j, step in enumerate((1, 3, 7, 11)):
            other = _BAD_WORDS[(k + step) % len(_BAD_WORDS)]
            out.append((f"https://{('', 'www.', 'm.', 'blog.')[j]}{word}-{other}.example.{('com', 'net', 'org')[(k + j) % 3]}{_PATHS[(k + j) % 4]}", 1))
    return out


def weights_of(labelled: DataFrame) -> list[float]:
    """The model of a labelled table (url, label: 1 for those to block; null labels are left out) of at most
    MOST_LABELLED rows; a longer one is refused, not cut."""
    rows = labelled.where("label is not null").select(F.col("url").cast("string"), F.col("label").cast("int")).limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table is bounded by {MOST_LABELLED} rows")
    return train(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] or "", r[1])))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the DataFrame expressions below give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(k for k in (rest.find(c) for c in "/?#") if k >= 0)])
    host = rest[:cut].translate(str.maketrans(_UPPER, _LOWER))
    tail = rest[cut:]
    return host, tail[: min([len(tail), *(k for k in (tail.find(c) for c in "?#") if k >= 0)])]


def features(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of host and path: the code points as digits of base 131, modulo a prime, then DIMENSIONS."""
    text = f"^{host}|{path}$"
    out = []
    for n in SIZES:
        for k in range(len(text) - n + 1):
            value = 0
            for c in text[k : k + n]:
                value = value * 131 + ord(c)
            out.append(value % 1_000_003 % DIMENSIONS)
    return out


def train(rows: Iterable[tuple[str | None, int]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """DIMENSIONS weights and the intercept, by gradient steps on the mean feature counts of each URL."""
    examples = []
    for url, label in rows:
        host, path = split_url(url)
        buckets = features(host, path) if host else []
        examples.append((buckets, float(label)))
        if len(examples) > MOST_LABELLED:
            raise ValueError(f"the labelled table is bounded by {MOST_LABELLED} rows")
    weights, intercept = [0.0] * DIMENSIONS, 0.0
    for _ in range(epochs):
        for buckets, label in examples:
            share = 1 / max(1, len(buckets)) ** 0.5
            z = intercept + share * sum(weights[b] for b in buckets)
            error = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            intercept += rate * 0.1 * error
            for b in buckets:
                weights[b] += rate * (error * share - decay * weights[b])
    return [round(w, 6) for w in weights] + [round(intercept, 6)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _score(host: Column, path: Column, weights: list[float]) -> Column:
    """z of the logistic model; the weights are one folded array literal."""
    table_ = F.split(F.lit(",".join(f"{w:.6f}" for w in weights[:-1])), ",").cast("array<double>")
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def grams(n: int) -> Column:
        def bucket(k: Column) -> Column:
            value = F.lit(0).cast("long")
            for i in range(n):
                value = value * 131 + F.ascii(F.substring(text, k + i, F.lit(1))).cast("long")
            return (value % 1_000_003 % DIMENSIONS).cast("int")

        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), bucket)).otherwise(F.array().cast("array<int>"))

    buckets = F.concat(*[grams(n) for n in SIZES])
    total = F.aggregate(buckets, F.lit(0.0).cast("double"), lambda s, b: s + F.get(table_, b))
    return F.lit(weights[-1]) + F.when(host == "", F.lit(0.0)).otherwise(total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")))


def filter_urls(pages: DataFrame, weights: list[float] | None = None, rules: Iterable[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of pages (page_id, url). weights: those of
    weights_of(a labelled table), by default of the built-in one."""
    weights = weights or train(labelled_urls())
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == suffix) | F.col("host").endswith("." + suffix)) & F.col("path").startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    z = _score(F.col("host"), F.col("path"), weights)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("_by_rule"), F.round(1 / (1 + F.exp(-z)), 6).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def oracle() -> str:
    weights = train(labelled_urls())
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    by_rule = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    sums = []
    for n in SIZES:
        digits = " + ".join(f"unicode(t[k + {i}]) * {131 ** (n - 1 - i)}::bigint" for i in range(n))
        sums.append(f"list_transform(range(1, greatest(length(t) - {n - 2}, 1)), lambda k: w[(({digits}) % 1000003 % {DIMENSIONS})::int + 1])")
    values = ", ".join(f"{w:.6f}" for w in weights[:-1])
    return f"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from parts
), model as (select [{values}]::double[] as w),
grams as (
  select page_id, host, path, list_concat({", ".join(sums)}) as g
  from (select *, '^' || host || '|' || path || '$' as t from split), model
), scored as (
  select *, round(1 / (1 + exp(-({weights[-1]} + case when host = '' then 0 else coalesce(list_sum(g), 0) / sqrt(greatest(len(g), 1)) end))), 6) as score from grams
)
select page_id, host, path, case {rule} end as rule,
       coalesce(case {by_rule} end, case when score >= {THRESHOLD} then 'block' else 'allow' end) as verdict, score
from scored"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
