"""How the operators' inputs are bound to the tables: streams, anchors and PCM blocks, with the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopline.functions import numeric
from hopline.sources.tables import table


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("frame", F.row_number().over(w) - 1)


NUMBERED = "numbered as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"


def session_anchors(spark, d) -> DataFrame:
    """Signups as anchors of a user's timeline in seconds: track 0 starts 100 s before its anchor and lasts a day."""
    s = F.floor(F.unix_micros("ts") / 1_000_000).cast("long") - 1704067200
    e = table(spark, d, "events").where("event_type = 'signup'").select("user_id", "event_id", s.alias("at"))
    n = lambda v, t="long": F.lit(v).cast(t)
    anchor = F.struct(
        F.col("event_id").alias("revision"), n(1).alias("metadata_revision"), F.lit(True).alias("has_progress"), F.col("event_id").alias("start_rtp"), n(0).alias("current_rtp"), n(0).alias("end_rtp"), F.col("at").alias("anchor_stream_frame"),
        n(100).alias("track_position_frame"), n(86400).alias("track_duration_frame"), F.lit("t").alias("title"), F.lit("a").alias("artist"), F.lit("b").alias("album"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id", anchor.alias("a")))), lambda x: x["a"]).alias("anchors"))


def blocks(spark, d) -> DataFrame:
    """Vectors as PCM: each element times 30,000, in even places left, in odd places right."""
    pcm = F.transform("embedding", lambda v: numeric.pcm16(v.cast("double") * 30000))
    return table(spark, d, "embeddings").select("vec_id", "label", pcm.alias("pcm"))


PCM = "blocks as (select vec_id, label, list_transform(embedding, lambda x: greatest(-32768, least(32767, round(x::double * 30000)))::int) as pcm from embeddings)"

SAMPLES = f"with {PCM}, s as (select vec_id, label, unnest(pcm) as v, generate_subscripts(pcm, 1) - 1 as i from blocks)"


def positions(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("pcm").alias("i", "v")).select(*keys, F.col("i").cast("long").alias("i"), F.col("v").cast("int").alias("v"))


def session_samples(spark, d) -> DataFrame:
    """Events as telemetry samples of each user's session."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    return e.select(
        "user_id", n.alias("observed_at_ns"), (F.col("event_type") == "view").alias("streaming"), F.when(F.col("event_type") == "click", "playing").otherwise("idle").alias("playback_state"),
        (n % 97).alias("captured_sequence"), (n % 89).alias("gpu_sequence"), F.floor(n / 5000).alias("skipped_sequence"), F.floor(n / 4000).alias("underruns"), F.floor(n / 3000).alias("device_recoveries"), (n % 1013 == 0).alias("device_recovering"),
        (n % 53).alias("mixer_updates"), F.col("value").alias("last_mixer_control_latency_ms"), (n % 83).alias("cache_hits"), (n % 79).alias("cache_misses"), (n % 3 == 0).alias("cache_hit"), F.when(n % 2 == 0, "song").otherwise("window").alias("cache_scope"),
        (n % 7).alias("songs_cached"), (n % 5).alias("pending_windows"), F.col("value").alias("ready_buffer_seconds"), F.col("event_type").alias("track_title"), F.lit(" x ").alias("track_artist"), F.round("value").alias("track_duration_seconds"))


ACCEPTANCE = """
with t as (select user_id, event_id as pos, event_type = 'view' as streaming, event_type = 'click' as playing, event_id % 97 as cap, event_id % 89 as gpu, event_id // 5000 as skp, event_id // 4000 as und, event_id // 3000 as dev,
  event_id % 1013 = 0 as recovering, event_id % 53 as mix, value as lat, event_id % 83 as hits, event_id % 79 as miss, event_id % 3 = 0 as hit, event_id % 2 = 0 as song, event_id % 7 as songs, event_id % 5 as pend, value as buf from events),
a as (select *, streaming or playing as active from t),
b as (select *, coalesce(lag(active) over w, false) as before, lag(skp) over w as pskp, lag(und) over w as pund, lag(dev) over w as pdev, lag(mix) over w as pmix, first(hits) over w as hits0 from a window w as (partition by user_id order by pos)),
c as (select *, active and before as cont, sum((active and not before)::int) over (partition by user_id order by pos) as seg from b),
g as (select user_id, seg, greatest(0, max(und) - arg_min(und, pos)) as du, greatest(0, max(dev) - arg_min(dev, pos)) as dd, greatest(0, max(skp) - arg_min(skp, pos)) as ds, greatest(0, max(mix) - arg_min(mix, pos)) as dm,
  bool_or(coalesce(cont and und < pund, false)) as ru, bool_or(coalesce(cont and dev < pdev, false)) as rd, bool_or(coalesce(cont and skp < pskp, false)) as rs from c where active group by all),
h as (select user_id, sum(du) as du, sum(dd) as dd, sum(ds) as ds, sum(dm) as dm, bool_or(ru) as ru, bool_or(rd) as rd, bool_or(rs) as rs from g group by user_id),
q as (select user_id, count(*) as samples, count(*) filter (streaming) as st, count(*) filter (active) as act, max(cap) - arg_min(cap, pos) as dcap, max(gpu) - arg_min(gpu, pos) as dgpu, max(miss) - arg_min(miss, pos) as dmiss, arg_max(songs, pos) as songs,
  max(pend) as pend, min(buf) filter (active) as buf, bool_or(active and recovering) as rec, count(*) filter (hit and song and hits > hits0) as rep, coalesce(max(case when cont and mix > pmix then lat end), 0) as lat from c group by user_id),
r as (select q.*, coalesce(du, 0) as du, coalesce(dd, 0) as dd, coalesce(ds, 0) as ds, coalesce(dm, 0) as dm, coalesce(ru, false) as ru, coalesce(rd, false) as rd, coalesce(rs, false) as rs from q left join h using (user_id)),
k as (select *, st > 0 and dcap > 0 as k1, dmiss > 0 and dgpu > 0 as k2, songs > 0 as k3, rep > 0 as k4, act > 0 and du = 0 and not ru as k5, act > 0 and dd = 0 and not rec and not rd as k6, act > 0 and ds = 0 and not rs as k7, dm > 0 as k8, dm > 0 and lat <= 50 as k9 from r)
"""


ACCEPTANCE_REPORT = """
select user_id, samples, st as streaming_samples, act as active_samples, pend as maximum_pending_windows, buf as minimum_active_buffer_seconds, dm::bigint as active_mixer_updates_delta, lat as max_latency_ms, k1 as stream_received, k4 as song_cache_replayed, k5 as zero_active_underruns,
  k6 as zero_active_device_recoveries, k7 as zero_active_skipped_sequences, k9 as mixer_latency_below_limit,
  case when k1 and k2 and k3 and k4 and k5 and k6 and k7 and k8 and k9 then 'passed' when k4 and (not (k5 and k6 and k7) or (k8 and not k9)) then 'failed' when not k1 then 'waiting_for_phone' else 'in_progress' end as state
from k
"""
