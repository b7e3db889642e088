"""Prometheus text, powermetrics logs, silence logs and reference transcripts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_METRIC = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+([^\s]+)\s*$"


def parse_prometheus(lines: DataFrame) -> DataFrame:
    """probe_id, name, label (the first label's value, null without labels), value; the last line of a name and label
    wins; comments and lines that do not parse are skipped. lines: probe_id, line_no, line."""
    t = lines.withColumn("_t", F.trim("line")).where((F.length("_t") > 0) & ~F.col("_t").startswith("#"))
    g = lambda k: F.regexp_extract("_t", _METRIC, k)
    found = t.select("probe_id", "line_no", g(1).alias("name"), g(2).alias("_labels"), F.expr("try_cast(regexp_extract(_t, '^([a-zA-Z_:][a-zA-Z0-9_:]*)([{][^}]*[}])?\\\\s+([^\\\\s]+)\\\\s*$', 3) as double)").alias("value"))
    label = F.when(F.col("_labels") != "", F.regexp_extract("_labels", r'(\w+)="([^"]*)"', 2))
    named = found.where((F.col("name") != "") & F.col("value").isNotNull() & ((F.col("_labels") == "") | F.col("_labels").rlike(r'\w+="[^"]*"'))).withColumn("label", label)
    return named.groupBy("probe_id", "name", "label").agg(F.max_by("value", "line_no").alias("value"))


def render_prometheus(metrics: DataFrame) -> DataFrame:
    """One text a probe: HELP, TYPE and values by metric, labels sorted. metrics: probe_id, rank, name, kind, help, label_name, label, value (text)."""
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("{"), F.col("label_name"), F.lit('="'), F.col("label"), F.lit('"}')))
    rows = metrics.withColumn("_line", F.concat("name", label, F.lit(" "), F.col("value")))
    blocks = rows.groupBy("probe_id", "rank", "name", "kind", "help").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "_line"))), lambda x: x["_line"]), "\n").alias("_values"))
    block = F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("help"), F.lit("\n# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"), F.col("_values"))
    return blocks.groupBy("probe_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def parse_power(logs: DataFrame) -> DataFrame:
    """Mean, largest and number of the power samples (mW) of each unit. logs: run_id, text."""
    rows = logs.select("run_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:GPU|ANE|CPU) Power: \d+) mW"), 1)).alias("s"))
    return rows.select("run_id", F.regexp_extract("s", r"^(\w+)", 1).alias("unit"), F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("mw")).groupBy("run_id", "unit").agg(F.round(F.avg("mw"), 6).alias("mean_mw"), F.max("mw").alias("max_mw"), F.count(F.lit(1)).alias("n"))


def parse_silence_log(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Silences of each file from silencedetect lines: the k-th end closes the k-th start; what stays open ends with
    the file. lines: file_id, line_no, line; files: file_id, duration_ms."""
    at = lambda word: F.round(F.expr(f"try_cast(nullif(regexp_extract(line, 'silence_{word}: *(-?[0-9.]+)', 1), '') as double)") * 1000).cast("long")
    marks = lines.select("file_id", "line_no", at("start").alias("s"), at("end").alias("e"))
    k = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    starts = marks.where("s is not null").select("file_id", k.alias("k"), F.greatest("s", F.lit(0)).alias("start_ms"))
    ends = marks.where("e is not null").select("file_id", k.alias("k"), F.col("e").alias("end_ms"))
    return starts.join(ends, ["file_id", "k"], "left").join(files, "file_id").select("file_id", "start_ms", F.coalesce("end_ms", "duration_ms").alias("end_ms"))


def parse_reference(lines: DataFrame) -> DataFrame:
    """Paragraphs of reference transcripts: after the second `---` line, `name：text` begins one, other lines continue
    it. lines: file_id, line_no, line -> file_id, paragraph, speaker, text."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("_t", F.trim("line")).withColumn("_marks", F.sum((F.col("_t") == "---").cast("int")).over(w)).where((F.col("_marks") >= 2) & (F.col("_t") != "---") & (F.col("_t") != ""))
    head = F.regexp_extract("_t", r"^([^：]{1,20})：", 1)
    body = body.withColumn("_head", head).withColumn("paragraph", F.sum((F.col("_head") != "").cast("int")).over(w)).where("paragraph > 0")
    text = F.when(F.col("_head") != "", F.regexp_replace("_t", r"^[^：]{1,20}：", "")).otherwise(F.col("_t"))
    return body.groupBy("file_id", "paragraph").agg(F.max("_head").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "").alias("text"))
