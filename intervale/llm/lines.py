"""Line dedup by the spread of sites: lines that many sites share are removed but for their first document.

A line's key is a hash of its text, trimmed and lower-cased. For each key, HyperLogLog sketches of the sites merge by
aggregation; keys whose estimate lies near the threshold get an exact distinct count. A line on at least MIN_SITES
sites is boilerplate: it stays in the document with the smallest id that holds it (so of a group of copied documents
one stays whole) and goes everywhere else. Lines shorter than MIN_CHARS are more often common by chance and go when on
at least SHORT_SITES sites; with min_chars=0 one threshold holds for all. Blank lines stay.

Defined results: a null text stays null and an empty one empty; a null site counts as one site; null ids sort first,
as one document; rows with the same id are one document; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written

MIN_SITES = 5
MIN_CHARS = 25
#: Sites that make a line under MIN_CHARS boilerplate: a sentence of one or two words is on a few sites by chance, not
#: on so many.
SHORT_SITES = 15
#: log2 of a sketch's buckets, and the share by which an estimate may miss before it is counted exactly.
SKETCH_BITS = 8
NEAR = 0.35


def _key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line)))


def _lines(docs: DataFrame, min_sites: int, short_sites: int, min_chars: int) -> DataFrame:
    """line, doc_id, site, least of the distinct lines of each document that are not blank; least: the sites that make a
    line boilerplate."""
    least = lambda x: F.when(F.length(F.trim(x)) >= min_chars, min_sites).otherwise(short_sites)
    found = F.array_distinct(F.transform(F.filter(F.split(F.col("text"), "\n"), _counted), lambda x: F.struct(_key(x).alias("line"), least(x).alias("least"))))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("site"), F.explode(found).alias("_l"))
    return rows.select("_l.line", "doc_id", "site", "_l.least")


def _counted(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def boilerplate(lines: DataFrame) -> DataFrame:
    """line, least, keeper of the lines that at least `least` sites hold. lines: line, doc_id, site, least; read three times."""
    key = ["line", "least"]
    spread = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))
    frequent = written(spread.where(F.col("n") >= F.col("least")).select(*key, "keeper"), "frequent-lines")
    held = lines.join(frequent, key)
    sketched = held.groupBy(*key, "keeper").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"))
    judged = written(sketched.select(*key, "keeper", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    clear = judged.where(F.col("sites") > F.col("least") * (1 + NEAR)).select(*key, "keeper")
    near = judged.where(F.col("sites").between(F.col("least") * (1 - NEAR), F.col("least") * (1 + NEAR))).select(*key, "keeper")
    exact = lines.join(near, key).select(*key, "keeper", "site").distinct().groupBy(*key, "keeper").count()
    return clear.unionByName(exact.where(F.col("count") >= F.col("least")).select(*key, "keeper"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines removed from text, and the numbers of lines before and removed as
    lines_before and lines_removed (in place of columns of these names)."""
    lines = written(_lines(docs, min_sites, short_sites, min_chars), "lines")
    known = boilerplate(lines)
    docs = docs.drop("lines_before", "lines_removed")
    set_, id_ = fresh(docs, "_gone"), fresh(docs, "_doc")
    gone = lines.join(known, ["line", "least"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_set("line").alias(set_)).withColumnRenamed("doc_id", id_)
    joined = docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(-1 << 63)) == gone[id_], "left")
    all_lines = F.split(docs["text"], "\n")
    kept = F.filter(all_lines, lambda x: ~(_counted(x) & F.array_contains(gone[set_], _key(x))))
    text = F.when(gone[set_].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    counts = {"lines_before": F.size(all_lines), "lines_removed": F.when(gone[set_].isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(kept))}
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], *[F.coalesce(v, F.lit(0)).cast("int").alias(k) for k, v in counts.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "text", "lines_before", "lines_removed")


ORACLE = f"""
with lines as (
  select doc_id, source, u.pos, u.line, lower(trim(u.line, ' ')) as key
  from (select doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, k: {{'pos': k, 'line': x}})) as u from documents where text is not null)
), spread as (
  select key, min(doc_id) as keeper from lines where key <> '' group by key having count(distinct coalesce(source, '')) >= case when length(key) >= {MIN_CHARS} then {MIN_SITES} else {SHORT_SITES} end
), judged as (
  select l.*, (s.key is not null and l.doc_id <> s.keeper) as gone from lines l left join spread s on l.key = s.key
), texts as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, count(*) as lines_before, count(*) filter (gone) as lines_removed from judged group by doc_id
)
select d.doc_id, t.text, coalesce(t.lines_before, 0)::int as lines_before, coalesce(t.lines_removed, 0)::int as lines_removed
from documents d left join texts t using (doc_id)"""
