"""Domain tables derived from the star schema: transcripts, turns, silences, words, vectors, task events, cache rows.

Each derivation is SQL over base tables that both Spark and other engines read alike: integer milliseconds only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (base tables, SQL with {table} for each)
TABLES: dict[str, str] = {}
TABLES["segments"] = """
select file_id, seg_idx, start_ms, start_ms + dur as end_ms, speaker, text from (
  select conv_id as file_id, turn as seg_idx, dur, speaker, text,
         cast(sum(dur + gap) over (partition by conv_id order by turn) - dur - gap as bigint) as start_ms
  from (
    select conv_id, turn, text, 200 + 10 * ((length(text) * 37 + turn * 13) % 400) as dur,
           case when (conv_id + turn) % 11 = 0 then 3000 when (conv_id + turn) % 11 = 1 then 50
                else 10 * ((conv_id * 31 + turn * 17) % 40) - 50 end as gap,
           cast((conv_id * 7 + turn * turn * 3 + turn) % 5 % 3 as bigint) as speaker
    from {conversations}) as a) as b"""
TABLES["turns"] = (
    """
select * from (
  select file_id, seg_idx as turn_idx, greatest(0, start_ms + 40 * ((file_id + seg_idx * 5) % 7) - 120) as start_ms,
         end_ms + 40 * ((file_id * 3 + seg_idx) % 7) - 120 as end_ms,
         (speaker + case when (file_id + seg_idx) % 6 = 0 then 1 else 0 end) % 3 as speaker
  from ("""
    + TABLES["segments"]
    + """) as s) as t where end_ms > start_ms"""
)
TABLES["silences"] = (
    """
select file_id, start_ms, start_ms + 100 + 10 * ((file_id + seg_idx * 7) % 20) as end_ms from (
  select file_id, seg_idx, end_ms - 100 + 60 * ((file_id * 3 + seg_idx) % 5) as start_ms
  from ("""
    + TABLES["segments"]
    + """) as s where (file_id + seg_idx) % 3 <> 0) as t"""
)
#: Unordered, partly overlapping, partly outside [0, duration].
TABLES["regions"] = (
    """
select file_id, start_ms - 150 * ((file_id + turn_idx) % 4) as start_ms, end_ms - 90 * (turn_idx % 3) as end_ms
from ("""
    + TABLES["turns"]
    + """) as t"""
)
TABLES["files"] = (
    """
select file_id, max(end_ms) - 120 as duration_ms from ("""
    + TABLES["segments"]
    + """) as s group by file_id"""
)
TABLES["vectors"] = """
select vec_id % 10 as file_id, vec_id as seg_idx, label * 2 + case when vec_id % 7 = 0 then 1 else 0 end as speaker,
       1000 + 100 * (vec_id * 13 % 50) as dur_ms, embedding from {embeddings}"""
TABLES["task_events"] = """
select event_id, user_id as task_id, cast(ts as timestamp) as ts, event_type, value,
       case event_type when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'completed'
            when 'signup' then 'failed' else 'timed_out' end as status,
       case event_id % 6 when 0 then 'queue is full' when 1 then 'Timeout while waiting' when 2 then 'unsupported format: x'
            when 3 then 'CUDA out of memory' when 4 then 'model load failed' else 'something else' end as message
from {events}"""
TABLES["cache_rows"] = """
select doc_id as id, 'h' || cast(doc_id % 200 as varchar(20)) as file_hash,
       'qwen3' || case doc_id % 4 when 0 then '' when 1 then '+wa:zh' when 2 then '+nospk' else '+wa:zh+nospk' end as engine,
       n_chars as result_len, 1000000 + doc_id * 37 % 5000 as created_s, 1000000 + doc_id * 91 % 3000 as accessed_s
from {documents}"""
BASES = ("conversations", "embeddings", "events", "documents")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = TABLES[name]
    bases = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASES if "{" + b + "}" in sql}
    return spark.sql(sql.replace("varchar(20)", "string"), **bases)


def oracle(name: str) -> str:
    return TABLES[name].format(**{b: b for b in BASES})
