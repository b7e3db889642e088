"""Queries of the cache, lifecycle, metrics and text operators over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cache as ca
from ..operators import lifecycle as lc
from ..sources import metrics as mt
from ..sources.substrate import derived
from ..streaming import uploads as up
from .registry import query, with_tables

_CONV = "(select conv_id, turn, role, text from conversations)"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


_REQ = """, req as (select doc_id, case when doc_id % 5 = 0 then 'funasr' else 'qwen3' end as engine, doc_id % 2 = 0 as wa, case doc_id % 3 when 0 then ' en ' when 1 then '' end as lang, doc_id % 7 <> 0 as diarize, case when doc_id % 4 = 1 then 'srt' else 'json' end as fmt, doc_id % 6 <> 2 as has_words from documents)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return documents(spark, d).select("doc_id", F.when(i % 5 == 0, "funasr").otherwise("qwen3").alias("engine"), (i % 2 == 0).alias("wa"), F.when(i % 3 == 0, " en ").when(i % 3 == 1, "").alias("lang"), (i % 7 != 0).alias("diarize"), F.when(i % 4 == 1, "srt").otherwise("json").alias("fmt"), (i % 6 != 2).alias("has_words"))


@query("prj9_variant_key", "with" + _REQ[1:] + """ , k as (select *, case when engine = 'qwen3' then engine || case when wa and fmt = 'json' then '+wa:' || coalesce(nullif(trim(lang), ''), 'zh') else '' end || case when diarize then '' else '+nospk' end else engine end as key from req)
select doc_id, key, key = engine as allow_cross, case when has_words then key else regexp_replace(key, '\\+wa:[^+]*', '') end as saved from k""")
def variant_keys(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    key = ca.variant_key(F.col("engine"), F.col("wa"), F.col("lang"), F.col("diarize"), F.col("fmt"))
    return r.withColumn("key", key).select("doc_id", "key", (F.col("key") == F.col("engine")).alias("allow_cross"), ca.saved_key(F.col("key"), F.col("has_words")).alias("saved"))


@query("prj2_metadata", "with" + _REQ[1:] + """ select doc_id, engine = 'qwen3' and wa and fmt = 'json' and has_words as word_align, case when engine = 'qwen3' and wa and fmt = 'json' then coalesce(nullif(trim(lang), ''), 'zh') else nullif(trim(lang), '') end as language from req""")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    words, lang = ca.delivered_metadata(F.col("engine"), F.col("wa"), F.col("lang"), F.col("fmt"), F.col("has_words"))
    return requests(spark, d).select("doc_id", words.alias("word_align"), lang.alias("language"))


_LOOK = """, asked as (select doc_id as req_id, 'h' || (doc_id % 260)::varchar as file_hash, case doc_id % 3 when 0 then 'qwen3+wa:zh+nospk' when 1 then 'qwen3+nospk' else 'qwen3' end as key, doc_id % 3 = 2 as allow_cross from documents)"""


@query("jn17_cache_lookup", with_tables("cache_rows") + _LOOK + """, c as (select a.*, r.id, r.created_s, case when r.engine = key then 1 when key like '%+nospk' and r.engine = regexp_replace(key, '\\+nospk$', '') then 2 when allow_cross and not contains(r.engine, '+') then 3 end as tier from asked a join cache_rows r using (file_hash)),
b as (select req_id, id, tier from c where tier is not null qualify row_number() over (partition by req_id order by tier, created_s desc, id desc) = 1)
select a.*, b.id as row_id, coalesce(b.tier = 2, false) as projected from asked a left join b using (req_id)""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    asked = documents(spark, d).select(i.alias("req_id"), F.concat(F.lit("h"), (i % 260).cast("string")).alias("file_hash"), F.when(i % 3 == 0, "qwen3+wa:zh+nospk").when(i % 3 == 1, "qwen3+nospk").otherwise("qwen3").alias("key"), (i % 3 == 2).alias("allow_cross"))
    return ca.lookup(asked, derived(spark, d, "cache_rows"))


@query("snk1_upsert", with_tables("cache_rows") + ", a as (select id, file_hash, engine, result_len, created_s, accessed_s from cache_rows union all select id + 1000000000, file_hash, engine, result_len + 1, created_s + 5, accessed_s + 5 from cache_rows where id % 3 = 0) select * from a qualify row_number() over (partition by file_hash, engine order by id desc) = 1")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "cache_rows")
    new = rows.where("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "file_hash", "engine", (F.col("result_len") + 1).alias("result_len"), (F.col("created_s") + 5).alias("created_s"), (F.col("accessed_s") + 5).alias("accessed_s"))
    return ca.upsert(rows, new)


@query("st5_so4_cache_eviction", with_tables("cache_rows") + ", f as (select * from cache_rows where created_s >= 1005000 - 4000), r as (select *, row_number() over (order by accessed_s, id) as n, count(*) over () as total from f) select id, file_hash, engine, result_len, created_s, accessed_s from r where n > total - 300")
def eviction(spark: SparkSession, d: str) -> DataFrame:
    return ca.evict(derived(spark, d, "cache_rows"), 1_005_000, 4_000, 300)


@query("ag4_cache_stats", with_tables("cache_rows") + " select count(*) as total_count, count(*) filter (created_s between 1002000 and 1002000 + 86399) as today_count, round(sum(result_len) / 1048576.0, 2) as cache_size_mb from cache_rows")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return ca.stats(derived(spark, d, "cache_rows"), 1_002_000)


@query("prj1_without_speakers", "select conv_id, count(*)::int as n, 0 as n_speakers, count(*) filter (false)::int as n_named from conversations group by conv_id")
def nospk(spark: SparkSession, d: str) -> DataFrame:
    r = conversations(spark, d).groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text")).alias("segments"), F.collect_set("role").alias("speakers"))
    p = ca.without_speakers(r)
    return p.select("conv_id", F.size("segments").alias("n"), F.size("speakers").alias("n_speakers"), F.size(F.filter("segments", lambda s: s["speaker"].isNotNull())).alias("n_named"))


_KIND = "case when regexp_matches(message, '音频时长过短|文件不存在|不支持的文件格式|文件太大|认证失败') then 'non_retryable_input' when regexp_matches(message, 'VAD algorithm|index .* out of bounds|list index out of range|window size|dimension', 'i') then 'model_error' else 'engine_error' end"
_MSG = ", msgs as (select event_id, case event_id % 8 when 0 then '音频时长过短' when 1 then 'VAD algorithm broke' when 2 then 'Index 5 is out of bounds' when 3 then '模型 WINDOW SIZE' when 4 then 'CUDA out of memory' when 5 then 'cublas failure' when 6 then '认证失败: x' else 'other' end as message from events)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    texts = ["音频时长过短", "VAD algorithm broke", "Index 5 is out of bounds", "模型 WINDOW SIZE", "CUDA out of memory", "cublas failure", "认证失败: x", "other"]
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int")).alias("message"))


@query("flt3_flt4_flt5_errors", "with" + _MSG[1:] + f""" select event_id, {_KIND} as kind, {_KIND} in ('model_error', 'engine_error') as retryable, regexp_matches(message, 'BFCArena|CUBLAS|cublas|cudaMalloc|CUDA failure|cudaErrorMemoryAllocation|out of memory') as resource,
case when contains(message, 'VAD') then 'vad_error' when contains(message, '索引') or contains(message, 'index') then 'index_error' when contains(message, '音频') then 'audio_error' when contains(message, '模型') then 'model_error' else 'unknown_error' end as progress_type from msgs""")
def errors(spark: SparkSession, d: str) -> DataFrame:
    kind = lc.classify_error(F.col("message"))
    return messages(spark, d).select("event_id", kind.alias("kind"), lc.retryable(kind).alias("retryable"), lc.is_resource_error(F.col("message")).alias("resource"), lc.progress_error_type(F.lit("failed"), F.col("message")).alias("progress_type"))


@query("flt6_flt8_file_checks", "select doc_id, regexp_matches('f.' || case doc_id % 3 when 0 then 'WAV' when 1 then 'exe' else 'mp3' end, '(?i)\\.(wav|mp3)$') and n_chars * 2000 <= 5 * 1048576 as allowed, coalesce(case when doc_id % 4 > 0 then n_chars end >= 1000, true) as headroom from documents")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("f."), F.when(i % 3 == 0, "WAV").when(i % 3 == 1, "exe").otherwise("mp3"))
    return documents(spark, d).select("doc_id", lc.allowed_file(name, F.col("n_chars") * 2000, (".wav", ".mp3"), 5).alias("allowed"), lc.has_headroom(F.when(i % 4 > 0, F.col("n_chars")), F.lit(1000)).alias("headroom"))


_LAST = ", last as (select task_id, status, ts, value, event_id from task_events qualify row_number() over (partition by task_id order by ts desc, event_id desc) = 1)"
_NOW = "timestamp '2024-02-01 00:00:00'"


def now_of(spark: SparkSession, d: str):  # noqa: ANN201
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


@query("ag5_snapshot", with_tables("task_events") + _LAST + " select count(*) as n_tasks, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("pending", "processing", "completed", "failed", "cancelled", "timed_out")) + " from last")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return lc.snapshot(lc.latest_states(derived(spark, d, "task_events")))


@query("ag6_terminal_counters", with_tables("task_events") + f" select status, case when status = 'timed_out' then 'timeout' when status = 'failed' then {_KIND} end as kind, count(*) as n from task_events where status in ('completed', 'failed', 'cancelled', 'timed_out') group by all")
def counters(spark: SparkSession, d: str) -> DataFrame:
    return lc.terminal_counters(derived(spark, d, "task_events"))


@query("ag7_ag8_moving_average", with_tables("task_events") + """, s as (select task_id, list(value - 20 order by ts, event_id) filter (value > 20) as v from task_events group by task_id),
e as (select task_id, case when v is null then 90.0 else round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) end as ema from s) select task_id, ema, greatest(1, floor(ema / 3))::int as retry_after, floor(6 / 3.0 * ema)::int as wait_s from e""")
def averages(spark: SparkSession, d: str) -> DataFrame:
    e = derived(spark, d, "task_events").withColumn("v", F.col("value") - 20)
    m = lc.moving_average(e, "task_id", "v", ["ts", "event_id"])
    return m.select("task_id", "ema", lc.retry_after(F.col("ema"), 3).alias("retry_after"), lc.estimated_wait(F.lit(7), F.col("ema"), 3).alias("wait_s"))


@query("st1_fold_states")
def states(spark: SparkSession, d: str) -> DataFrame:
    return lc.fold_states(derived(spark, d, "task_events"))


@query("st3_watchdog", with_tables("task_events") + _LAST + f" select task_id from last where status = 'processing' and epoch({_NOW} - ts) > 86400")
def watchdog(spark: SparkSession, d: str) -> DataFrame:
    return lc.timed_out(lc.latest_states(derived(spark, d, "task_events")), now_of(spark, d), 86_400).select("task_id")


_EVICT = _LAST + f", x as (select *, status in ('completed', 'failed', 'cancelled', 'timed_out') as fin, epoch({_NOW} - ts) as age from last), keep as (select * from x where not (fin and age > 400000)), o as (select task_id, row_number() over (order by ts, task_id) as n from keep where fin), gone as (select task_id, 'ttl' as reason from x where fin and age > 400000 union all select task_id, 'cap' from o where n <= greatest(0, (select count(*) from keep) - 60))"


@query("st4_evict_terminal", with_tables("task_events") + _EVICT + " select * from gone")
def evict_tasks(spark: SparkSession, d: str) -> DataFrame:
    return lc.evict_terminal(lc.latest_states(derived(spark, d, "task_events")), now_of(spark, d), 400_000, 60)


@query("jn20_so5_status_lookup", with_tables("task_events") + _EVICT + """, asked as (select k as position, k * 3 as task_id from (select unnest(range(70)) as k)), live as (select * from last where task_id not in (select task_id from gone))
select position, a.task_id, coalesce(l.status, case when g.task_id is not null then 'task_expired' else 'task_not_found' end) as status, case when l.status = 'completed' then l.value end as result from asked a left join live l using (task_id) left join gone g on g.task_id = a.task_id where position < 50""")
def status(spark: SparkSession, d: str) -> DataFrame:
    tasks = lc.latest_states(derived(spark, d, "task_events"))
    gone = lc.evict_terminal(tasks, now_of(spark, d), 400_000, 60)
    asked = spark.range(70).select(F.col("id").alias("position"), (F.col("id") * 3).alias("task_id"))
    return lc.status_lookup(asked, tasks.join(gone, "task_id", "left_anti"), gone)


@query("jn18_orphan_files", with_tables("cache_rows") + " select distinct id, file_hash from cache_rows where 1005000 - accessed_s > 3000 and file_hash not in (select file_hash from cache_rows where id % 9 = 0)")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    r = derived(spark, d, "cache_rows")
    return lc.orphans(r.select("id", "file_hash", F.col("accessed_s").alias("mtime_s")), r.where("id % 9 = 0"), 1_005_000, 3_000).select("id", "file_hash")


_TASKS = _LAST + ", tasks as (select *, 'h' || (task_id % 40)::varchar as file_hash from last)"


@query("jn19_shared_files", with_tables("task_events") + _TASKS + " select task_id from tasks t where exists (select 1 from tasks o where o.file_hash = t.file_hash and o.task_id <> t.task_id and o.status in ('pending', 'processing'))")
def shared(spark: SparkSession, d: str) -> DataFrame:
    t = lc.latest_states(derived(spark, d, "task_events")).withColumn("file_hash", F.concat(F.lit("h"), (F.col("task_id") % 40).cast("string")))
    return lc.shared_files(t).select("task_id")


@query("st2_admission", with_tables("task_events") + """, q as (select task_id % 10 as queue, event_id, task_id, status, row_number() over (partition by task_id % 10 order by ts, event_id) as rn from task_events where status in ('pending', 'processing')),
f as (select queue, 0::bigint as rn, null::bigint as event_id, 0::bigint as waiting, false as admitted, []::bigint[] as line from (select distinct queue from q)
 union all select q.queue, q.rn, case when q.status = 'pending' then q.event_id end, len(f.line), q.status = 'pending' and len(f.line) < 5,
 case when q.status = 'pending' and len(f.line) < 5 then list_append(f.line, q.task_id) when q.status = 'processing' and list_contains(f.line, q.task_id) then list_concat(f.line[:list_position(f.line, q.task_id) - 1], f.line[list_position(f.line, q.task_id) + 1:]) else f.line end
 from f join q on q.queue = f.queue and q.rn = f.rn + 1)
select queue, event_id, waiting, admitted from f where event_id is not null""")
def admission(spark: SparkSession, d: str) -> DataFrame:
    return lc.admitted(derived(spark, d, "task_events").withColumn("queue", F.col("task_id") % 10), 5)


@query("st8_health", "select event_id, case when event_id % 3 > 0 and event_id % 7 > 0 and event_id % 5 > 0 then 200 else 503 end as health from events")
def health(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    probes = spark.read.parquet(f"{d}/events.parquet").select("event_id", (k % 3 > 0).alias("alive"), F.when(k % 7 > 0, k % 5 > 0).alias("running"))
    return probes.select("event_id", lc.health(F.col("alive"), F.col("running")).alias("health"))


@query("st10_heartbeat", "select event_id, least(5 + 3 * (event_id % 40), 95) as progress from events")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", lc.heartbeat(F.col("event_id") % 40).alias("progress"))


_PROM = """(select event_id as probe_id, unnest(['# HELP x y', 'svc_queue_size ' || (event_id % 20)::varchar, 'svc_errors_total{kind="a",x="b"} ' || (event_id * 2)::varchar, 'svc_errors_total{kind="c"} 7', 'broken line here now', 'svc_bad abc', '']) as line from events)"""


@query("src9_parse_prometheus", f"""select probe_id, regexp_extract(line, '^([a-zA-Z_:][a-zA-Z0-9_:]*)', 1) as name, nullif(regexp_extract(line, '="([^"]*)"', 1), '') as label, try_cast(regexp_extract(line, '(\\S+)$', 1) as double) as value
from {_PROM} where regexp_matches(line, '^[a-zA-Z_:][a-zA-Z0-9_:]*([{{][^}}]*[}}])?\\s+[^\\s]+\\s*$') and try_cast(regexp_extract(line, '(\\S+)$', 1) as double) is not null""")
def prometheus(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    lines = F.array(F.lit("# HELP x y"), F.concat(F.lit("svc_queue_size "), (F.col("event_id") % 20).cast("string")), F.concat(F.lit('svc_errors_total{kind="a",x="b"} '), (F.col("event_id") * 2).cast("string")), F.lit('svc_errors_total{kind="c"} 7'), F.lit("broken line here now"), F.lit("svc_bad abc"), F.lit(""))
    return mt.parse_prometheus(e.select(F.col("event_id").alias("probe_id"), F.posexplode(lines).alias("line_no", "line")))


@query("snk5_render_prometheus", with_tables("task_events") + """, c as (select task_id % 7 as probe_id, status, count(*) as n from task_events group by all)
select probe_id, '# HELP svc_tasks_total tasks by status' || chr(10) || '# TYPE svc_tasks_total counter' || chr(10) || string_agg('svc_tasks_total{status="' || status || '"} ' || n::varchar, chr(10) order by status) as text from c group by probe_id""")
def render(spark: SparkSession, d: str) -> DataFrame:
    c = derived(spark, d, "task_events").groupBy((F.col("task_id") % 7).alias("probe_id"), F.col("status").alias("label")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return mt.render_prometheus(c.select("probe_id", F.lit(0).alias("rank"), F.lit("svc_tasks_total").alias("name"), F.lit("counter").alias("kind"), F.lit("tasks by status").alias("help"), F.lit("status").alias("label_name"), "label", "value"))


@query("src10_power_samples", "select run_id, unit, round(avg(mw), 6) as mean_mw, max(mw) as max_mw, count(*) as n from (select event_id % 9 as run_id, case event_id % 3 when 0 then 'GPU' when 1 then 'ANE' else 'CPU' end as unit, event_id * 7 % 900 as mw from events) group by all")
def power(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(F.when(i % 3 == 0, "GPU").when(i % 3 == 1, "ANE").otherwise("CPU"), F.lit(" Power: "), (i * 7 % 900).cast("string"), F.lit(" mW\n"))
    logs = spark.read.parquet(f"{d}/events.parquet").groupBy((i % 9).alias("run_id")).agg(F.array_join(F.collect_list(line), "").alias("text"))
    return mt.parse_power(logs)


@query("src3_src4_silence_log", with_tables("silences", "files") + ", r as (select *, row_number() over (partition by file_id order by start_ms) as k, count(*) over (partition by file_id) as n from silences) select file_id, start_ms, case when k = n and file_id % 2 = 0 then duration_ms else end_ms end as end_ms from r join files using (file_id) where start_ms >= 0")
def silence_log(spark: SparkSession, d: str) -> DataFrame:
    s = derived(spark, d, "silences").where("start_ms >= 0")
    from pyspark.sql import Window

    w = Window.partitionBy("file_id")
    s = s.withColumn("k", F.row_number().over(w.orderBy("start_ms"))).withColumn("n", F.count(F.lit(1)).over(w))
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    starts = s.select("file_id", (F.col("k") * 2).alias("line_no"), F.concat(F.lit("[x] silence_start: "), sec("start_ms")).alias("line"))
    ends = s.where("not (k = n and file_id % 2 = 0)").select("file_id", (F.col("k") * 2 + 1).alias("line_no"), F.concat(F.lit("[x] silence_end: "), sec("end_ms"), F.lit(" | silence_duration: 0.1")).alias("line"))
    return mt.parse_silence_log(starts.unionByName(ends), derived(spark, d, "files"))


@query("src8_parse_reference", """with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as n, replace(text, chr(10), ' ') as line from conversations),
h as (select conv_id, n, case when n % 2 = 1 then role else '' end as head, trim(line) as line from t join conversations c using (conv_id, turn)),
p as (select *, sum(case when head <> '' then 1 else 0 end) over (partition by conv_id order by n) as paragraph from h where line <> '' or head <> '')
select conv_id as file_id, paragraph::bigint as paragraph, max(head) as speaker, string_agg(line, '' order by n) as text from p group by conv_id, paragraph""")
def reference(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = conversations(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    flat = F.trim(F.regexp_replace("text", "\n", " "))
    body = c.select(F.col("conv_id").alias("file_id"), (F.col("n") + 10).alias("line_no"), F.when(F.col("n") % 2 == 1, F.concat("role", F.lit("："), flat)).otherwise(flat).alias("line"))
    marks = c.select(F.col("conv_id").alias("file_id")).distinct().select("file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(v).alias("line")) for k, v in ((1, "title"), (2, "---"), (3, "meta：x"), (4, "---"))])).alias("m")).select("file_id", "m.*")
    return mt.parse_reference(body.unionByName(marks))


_SRT = """, s as (select *, start_ms * 7 + 350 as a, end_ms * 7 + 351 as b, case when seg_idx % 5 = 3 then '  ' else text end as t from segments)"""


def _srt_time(x: str, truncated: bool = False) -> str:
    ms = f"cast(floor((({x} / 1000.0::double) % 1) * 1000) as bigint)" if truncated else f"{x} % 1000"
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {ms})"


_SRT_SQL = with_tables("segments") + _SRT + f""", n as (select *, row_number() over (partition by file_id order by seg_idx) as k from s where trim(t) <> ''), u as (select *, row_number() over (partition by file_id order by seg_idx) as k from s),
x as (select file_id, 'A' as variant, string_agg(k::varchar || chr(10) || {_srt_time('a')} || ' --> ' || {_srt_time('b')} || chr(10) || 'Speaker' || (speaker + 1)::varchar || ':' || trim(t) || chr(10), chr(10) order by k) as srt from n group by file_id
union all select file_id, 'B', string_agg(k::varchar || chr(10) || {_srt_time('a', True)} || ' --> ' || {_srt_time('b', True)} || chr(10) || 'Speaker' || (speaker + 1)::varchar || ':' || trim(t) || chr(10), chr(10) order by k) from n group by file_id
union all select file_id, 'C', string_agg(k::varchar || chr(10) || {_srt_time('a', True)} || ' --> ' || {_srt_time('b', True)} || chr(10) || 'Speaker' || (speaker + 1)::varchar || ':' || trim(t) || chr(10), chr(10) order by k) from u where trim(t) <> '' group by file_id)
select * from x"""


@query("snk2_srt_variants", _SRT_SQL)
def srt(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import to_srt

    s = derived(spark, d, "segments").select("file_id", "seg_idx", "speaker", (F.col("start_ms") * 7 + 350).alias("start_ms"), (F.col("end_ms") * 7 + 351).alias("end_ms"), F.when(F.col("seg_idx") % 5 == 3, "  ").otherwise(F.col("text")).alias("text"))
    out = None
    for v in "ABC":
        part = to_srt(s, v).select("file_id", F.lit(v).alias("variant"), "srt")
        out = part if out is None else out.unionByName(part)
    return out


@query("snk3_rttm", with_tables("turns") + " select file_id, turn_idx, 'SPEAKER ' || file_id::varchar || ' 1 ' || printf('%d.%03d', start_ms // 1000, start_ms % 1000) || ' ' || printf('%d.%03d', (end_ms - start_ms) // 1000, (end_ms - start_ms) % 1000) || ' <NA> <NA> Speaker' || (speaker + 1)::varchar || ' <NA> <NA>' as line from turns")
def rttm(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import to_rttm

    return to_rttm(derived(spark, d, "turns"))


@query("flt1_flt2_short_replies", with_tables("segments") + ", t as (select file_id, seg_idx, case seg_idx % 9 when 0 then '对' when 1 then ' 好的 ' when 2 then '，。 !' when 3 then '' when 4 then '你觉得可以吗' when 5 then '这是一个非常非常非常长的问题是不是' when 6 then '嗯' else text end as text from segments) select file_id, seg_idx, text = '' or trim(text) in ('对', '嗯嗯', '好的', '是的') or regexp_matches(text, '^[，。！？!?,.\\s]+$') as backchannel, length(trim(text)) <= 14 and regexp_matches(trim(text), '(对吗|是吧|是不是|有没有|可以吗|好吗|是吗)$') as question_tail from t")
def short_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seg_idx") % 9
    text = F.when(k == 0, "对").when(k == 1, " 好的 ").when(k == 2, "，。 !").when(k == 3, "").when(k == 4, "你觉得可以吗").when(k == 5, "这是一个非常非常非常长的问题是不是").when(k == 6, "嗯").otherwise(F.col("text"))
    return derived(spark, d, "segments").select("file_id", "seg_idx", tx.is_backchannel(text).alias("backchannel"), tx.is_question_tail(text).alias("question_tail"))


_PAIRS = [("the of", "THE1"), ("THE1 th", "THE2"), ("ing", "i"), ("and ", "& ")]


@query("fn_ordered_glossary", "select conv_id, turn, replace(replace(replace(replace(text, 'the of', 'THE1'), 'THE1 th', 'THE2'), 'ing', 'i'), 'and ', '& ') as text from conversations")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", "turn", tx.replace_in_order(F.col("text"), _PAIRS).alias("text"))


@query("fn_repetition")
def repetitions(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.repetition(F.col("text")).alias("phrase")).where("phrase is not null")


@query("fn_hash_cjk", "select doc_id, md5(text) as md5, regexp_matches(text, '[一-鿿]') as cjk, length(text) as n from documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), tx.has_cjk(F.col("text")).alias("cjk"), F.length("text").alias("n"))


@query("src11_chunk_dedup", "select conv_id as session, turn % 3 as chunk_index, count(*) as n_sent, md5(arg_min(text, turn)) as md5 from conversations group by all")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).select(F.col("conv_id").alias("session"), (F.col("turn") % 3).alias("chunk_index"), F.col("turn").alias("arrival"), F.col("text").cast("binary").alias("data"))
    return up.first_chunks(c).select("session", "chunk_index", "n_sent", F.md5("data").alias("md5"))


@query("src11_assembled_uploads", "with c as (select conv_id as session, turn as chunk_index, arg_min(text, turn) as t from conversations group by all) select session, count(*) as n_chunks, sum(octet_length(encode(t)))::bigint as size, md5(string_agg(t, '' order by chunk_index)) as md5, session % 3 > 0 as complete, session % 3 > 0 and session % 4 > 0 as accepted from c group by session")
def uploads(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).select(F.col("conv_id").alias("session"), F.col("turn").alias("chunk_index"), F.col("turn").alias("arrival"), F.col("text").cast("binary").alias("data"))
    whole = up.assembled(c)
    k = F.col("session")
    told = whole.select("session", (F.col("n_chunks") + F.when(k % 3 == 0, 1).otherwise(0)).alias("chunks"), "size", F.when(k % 4 == 0, "x").otherwise(F.col("md5")).alias("md5"))
    return up.checked(whole, told).select("session", "n_chunks", "size", "md5", "complete", "accepted")


@query("prj4_prj5_sentence_info", with_tables("segments") + " select file_id, seg_idx, round_even(start_ms / 10.0, 0)::bigint as start_cs, round_even(end_ms / 10.0, 0)::bigint as end_cs, trim(text) as text, 'Speaker' || (speaker + 1)::varchar as speaker from segments where trim(text) <> ''")
def sentence_info(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.results import parse_sentences

    raw = derived(spark, d, "segments").groupBy("file_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("seg_idx", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text", F.col("speaker").alias("spk")))).alias("sentence_info"))).alias("raw"))
    whole = lambda c: (F.col(c) * 100).cast("long")
    return parse_sentences(raw).select("file_id", "seg_idx", whole("start_s").alias("start_cs"), whole("end_s").alias("end_cs"), "text", "speaker")


@query("src7_poc_turns", with_tables("turns") + " select file_id, row_number() over (partition by file_id order by start_ms, turn_idx) - 1 as turn_idx, start_ms, end_ms, speaker from turns")
def poc_turns(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.results import parse_turns

    item = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.concat(F.lit("Speaker"), F.col("speaker") + 1).alias("speaker"))
    lists = derived(spark, d, "turns").groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn_idx", item.alias("i")))), lambda x: x["i"]).alias("l"))
    whole = F.when(F.col("file_id") % 2 == 0, F.to_json(F.struct(F.col("l").alias("diarization_turns")))).otherwise(F.to_json(F.struct(F.col("l").alias("segments"))))
    return parse_turns(lists.select("file_id", whole.alias("json")))
