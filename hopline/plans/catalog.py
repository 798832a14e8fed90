"""The queries of the package and the SQL that must give the same rows.

The tables are not audio, so each operator is bound to a table of its shape: events to streams and telemetry, embeddings
to PCM blocks, conversations to timed text, documents to files and cache entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.functions import binary, identity, numeric, rules, text
from hopline.model import mid_side, separated, table_function
from hopline.operators import cache, framing, joins, lyrics, publication, signal, telemetry, timeline
from hopline.plans import decisions, files, live, songs
from hopline.plans.bindings import ACCEPTANCE, ACCEPTANCE_REPORT, NUMBERED, PCM, SAMPLES, blocks, numbered_events, positions, session_samples
from hopline.plans.registry import oracle_sql, queries, query
from hopline.sources import documents
from hopline.sources.tables import table

__all__ = ["decisions", "files", "live", "oracle_sql", "queries", "songs"]


# --- windows and order


@query(f"""
with {NUMBERED},
each as (select *, unnest(range(greatest(0, ceil((frame - 11) / 3.0))::bigint, frame // 3 + 1)) as k from numbered)
select user_id, k as sequence, min(frame) as start_frame, count(*) as n, min(value) as low, max(value) as high, round(avg(value), 6) as mean
from each group by user_id, k having count(*) = 12
""")
def sliding_full_windows(spark, d):
    """WN1: 12 events every 3, complete ones only."""
    aggs = [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean")]
    return framing.sliding_windows(numbered_events(spark, d), ["user_id"], "frame", 12, 3, aggs)


@query("""
with bounds as (select *, min(ts) over (partition by user_id) as t0, max(ts) over (partition by user_id) as t1 from events),
timed as (select *, floor((epoch_us(ts) / 1000000.0::double - epoch_us(t0) / 1000000.0::double))::bigint as s, epoch_us(t1) / 1000000.0::double - epoch_us(t0) / 1000000.0::double as e from bounds),
each as (select *, unnest(range(greatest(0, ceil((s - 43200 + 1) / 10800.0))::bigint, s // 10800 + 1)) as k from timed)
select user_id, k as window_no, count(*) as n, max(value) as high from each where k * 10800 + 43200 <= e group by user_id, k
""")
def sliding_time_windows(spark, d):
    """WN1 over event time: 12 h every 3 h from each user's first event, without windows that are cut off."""
    return framing.sliding_time_windows(table(spark, d, "events"), ["user_id"], "ts", 43200, 10800, [F.count("*").alias("n"), F.max("value").alias("high")])


@query("""
select p.event_id, p.user_id, s.event_id as anchor_id, s.value as anchor_value
from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'signup') s
on p.user_id = s.user_id and p.ts >= s.ts
""")
def asof_anchor(spark, d):
    """JN1, JN6: each purchase with the user's last signup before it."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("anchor_id"), F.col("value").alias("anchor_value"))
    return timeline.asof(left, right, ["user_id"], "ts", "ts", ["anchor_id", "anchor_value"]).drop("ts")


@query("""
with s as (select user_id, event_id, epoch_us(ts) // 1000000 as pos from events where event_type = 'signup'),
w as (select user_id, event_id as window_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + 7200 as b from events where event_type = 'purchase'),
inside as (select w.user_id, window_id, s.event_id as anchor_id, s.pos as anchor_at from w join s on w.user_id = s.user_id and s.pos > a and s.pos <= b),
prev as (select w.user_id, window_id, arg_max(s.event_id, (s.pos, s.event_id)) as anchor_id, max(s.pos) as anchor_at from w join s on w.user_id = s.user_id and s.pos <= a group by all)
select * from inside union all select * from prev
""")
def window_anchors(spark, d):
    """JN2: anchors in (start, end] of two hours from each purchase, and the last at or before it."""
    at = F.floor(F.unix_micros("ts") / 1_000_000).cast("long")
    e = table(spark, d, "events").withColumn("at", at)
    w = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window_id"), F.col("at").alias("stream_start_frame"), (F.col("at") + 7200).alias("stream_end_frame"))
    a = e.where("event_type = 'signup'").select("user_id", F.col("at").alias("anchor_stream_frame"), F.col("event_id").alias("anchor_id"))
    return timeline.window_anchors(w, a, ["user_id"], 7200).select("user_id", "window_id", "anchor_id", F.col("anchor_stream_frame").alias("anchor_at"))


@query("""
select conv_id, turn, len(list_filter([lag(text, 2) over w, lag(text) over w], lambda x: x is not null)) as n_before,
  coalesce(lag(text) over w, '') as before, coalesce(lead(text) over w, '') as after, len(list_filter([lead(text) over w, lead(text, 2) over w], lambda x: x is not null)) as n_after
from conversations window w as (partition by conv_id order by turn)
""")
def context_neighbours(spark, d):
    """WN7: two turns before and after each."""
    before, after = framing.neighbours("text", ["conv_id"], "turn", 2)
    c = table(spark, d, "conversations").withColumn("b", before).withColumn("a", after)
    return c.select("conv_id", "turn", F.size("b").cast("long").alias("n_before"), F.coalesce(F.get("b", F.size("b") - 1), F.lit("")).alias("before"), F.coalesce(F.get("a", F.lit(0)), F.lit("")).alias("after"), F.size("a").cast("long").alias("n_after"))


_ISLANDS = f"""
with {NUMBERED},
m as (select *, (event_type is distinct from lag(event_type) over (partition by user_id order by frame))::int as fresh from numbered),
r as (select *, sum(fresh) over (partition by user_id order by frame) as island from m)
"""


@query(_ISLANDS + "select user_id, island::bigint as epoch, min(event_type) as event_type, count(*) as n, min(frame) as first_frame from r group by user_id, island")
def islands_sessions(spark, d):
    """WN4, WN12: runs of one event type."""
    e = numbered_events(spark, d)
    out = framing.epochs(e, ["user_id"], "frame", framing.changed("event_type", ["user_id"], "frame"))
    return out.groupBy("user_id", "epoch").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("frame").alias("first_frame"))


@query("""
with lines as (select distinct l_orderkey, l_linenumber from lineitem),
m as (select *, (l_linenumber <> lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) + 1)::int as gap from lines),
r as (select *, sum(coalesce(gap, 0)) over (partition by l_orderkey order by l_linenumber) as epoch from m)
select l_orderkey, epoch::bigint as epoch, min(l_linenumber) as first_line, max(l_linenumber) as last_line, count(*) as n from r group by l_orderkey, epoch
""")
def gap_epochs(spark, d):
    """WN3: runs of consecutive line numbers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    out = framing.epochs(lines, ["l_orderkey"], "l_linenumber", framing.gap("l_linenumber", ["l_orderkey"]))
    return out.groupBy("l_orderkey", "epoch").agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count("*").alias("n"))


@query(f"""
with {NUMBERED},
m as (select *, (value < lag(value) over (partition by user_id order by frame))::int as back from numbered),
r as (select *, sum(coalesce(back, 0)) over (partition by user_id order by frame) as epoch from m)
select user_id, epoch::bigint as epoch, count(*) as n, min(value) as low, max(value) as high from r group by user_id, epoch
""")
def regression_epochs(spark, d):
    """ST3 as a batch: a value below its predecessor's starts a new epoch."""
    out = framing.epochs(numbered_events(spark, d), ["user_id"], "frame", framing.regressed("value", ["user_id"], "frame"))
    return out.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_SEGMENTS = f"""
with {NUMBERED},
c as (select *, floor(value)::bigint as counter, event_type <> 'error' as active from numbered),
l as (select *, coalesce(lag(active) over w, false) as before, lag(counter) over w as prev from c window w as (partition by user_id order by frame)),
s as (select *, active and before as continues, sum((active and not before)::int) over (partition by user_id order by frame) as segment from l)
"""


def _counter_samples(spark, d) -> DataFrame:
    e = numbered_events(spark, d).withColumn("counter", F.floor("value").cast("long"))
    return telemetry.active_segments(e, ["user_id"], "frame", F.col("event_type") != "error")


@query(_SEGMENTS + """
select user_id, segment::bigint as segment, count(*) as samples, greatest(0, max(counter) - arg_min(counter, frame)) as counter_delta, bool_or(coalesce(continues and counter < prev, false)) as counter_reset
from s where active group by user_id, segment
""")
def counter_delta_reset(spark, d):
    """WN5: a counter's rise within active runs, and whether it fell there."""
    return telemetry.counter_deltas(_counter_samples(spark, d), ["user_id"], "frame", ["counter"])


@query(_SEGMENTS + "select user_id, coalesce(max(case when continues and counter > prev then value end), 0) as max_latency_ms from s group by user_id")
def adjusted_latency(spark, d):
    """WN6: the largest value among samples whose counter rose in a continuing run."""
    return telemetry.adjusted_latency(_counter_samples(spark, d), ["user_id"], "frame", "counter", "value")


@query("select event_id, 100 + ((event_id * 37 % 9000) - 1) // 3 as played from events where event_id * 37 % 9000 > 0 union all select event_id, null from events where event_id * 37 % 9000 = 0")
def played_sequence(spark, d):
    """WN13."""
    return table(spark, d, "events").select("event_id", framing.played_sequence(F.lit(100), F.col("event_id") * 37 % 9000, 3).cast("long").alias("played"))


@query("""
with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q, unnest(range(0, ceil(l_quantity / 8)::bigint)) as packet_no from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, packet_no, packet_no * 8 as frame_offset, least(8, q - packet_no * 8) as frame_count from p
""")
def packetise(spark, d):
    """ST13: quantities in packets of at most 8."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return framing.packets(l, F.col("q"), 8).drop("q").withColumn("packet_no", F.col("packet_no").cast("long"))


@query("""
with b as (select user_id, event_id, (event_id % 5 + 1) as frames, coalesce(sum((event_id % 5 + 1)) over w, 0) as f0, coalesce(sum(ceil((event_id % 5 + 1) / 2.0)) over w, 0) as p0
  from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)),
p as (select *, unnest(range(0, ceil(frames / 2.0)::bigint)) as k from b)
select user_id, event_id, ((p0 + k) % 4294967296)::bigint as packet_sequence, (f0 + k * 2)::bigint as presentation_frame, least(2, frames - k * 2) as frame_count from p
""")
def running_packets(spark, d):
    """ST13: packet sequence and presentation frame go on over a session's blocks."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 5 + 1).alias("frames"))
    return framing.running_packets(e, ["user_id"], "event_id", "frames", 2).select("user_id", "event_id", "packet_sequence", F.col("presentation_frame").cast("long").alias("presentation_frame"), "frame_count")


# --- signals


@query(f"""
with {PCM},
s as (select vec_id, len(pcm) // 2 as n, unnest(pcm) as v, generate_subscripts(pcm, 1) - 1 as i from blocks),
x as (select vec_id, n, i // 2 as f, i % 2 as c, least(1.0, abs(v) / 32768.0::double) as a from s),
bins as (select vec_id, f * 8 // n as b, max(m) as h from (select vec_id, n, f, avg(a) as m from x group by all) group by all)
select x.vec_id, max(a) filter (c = 0) as peak_left, max(a) filter (c = 1) as peak_right, round(sqrt(avg(a * a) filter (c = 0)), 6) as rms_left, round(sqrt(avg(a * a) filter (c = 1)), 6) as rms_right,
  any_value(w.first_bin) as first_bin, any_value(w.last_bin) as last_bin, any_value(w.total) as total
from x join (select vec_id, round(arg_min(h, b), 6) as first_bin, round(arg_max(h, b), 6) as last_bin, round(sum(h), 6) as total from bins group by vec_id) w using (vec_id) group by x.vec_id
""")
def level_meter(spark, d):
    """AG1: peaks, RMS and an eight-bin waveform of stereo blocks."""
    m = blocks(spark, d).select("vec_id", signal.levels(F.col("pcm"), 8).alias("m"))
    total = F.round(F.aggregate("m.waveform", F.lit(0.0), lambda s, v: s + v), 6)
    return m.select("vec_id", "m.peak_left", "m.peak_right", F.round("m.rms_left", 6).alias("rms_left"), F.round("m.rms_right", 6).alias("rms_right"), F.round(F.get("m.waveform", F.lit(0)), 6).alias("first_bin"), F.round(F.get("m.waveform", F.lit(7)), 6).alias("last_bin"), total.alias("total"))


@query(SAMPLES + " select label, vec_id // 6 as grp, i, greatest(-32768, least(32767, sum(v)))::int as v from s group by label, vec_id // 6, i")
def saturating_mix(spark, d):
    """AG2: blocks added up in place and saturated, six at most in a group."""
    b = blocks(spark, d).withColumn("grp", F.floor(F.col("vec_id") / 6))
    return positions(signal.saturating_mix(b, ["label", "grp"]), ["label", "grp"])


@query(SAMPLES + " select vec_id // 6 as grp, i, greatest(-32768, least(32767, round(sum(v * (label % 4) * 0.25::double))))::int as v from s group by vec_id // 6, i")
def gain_mix(spark, d):
    """AG3: the same with gains 0, 1/4, 1/2 and 3/4 by label."""
    b = blocks(spark, d).withColumn("grp", F.floor(F.col("vec_id") / 6)).withColumn("gain", F.col("label") % 4 * 0.25)
    return positions(signal.gain_mix(b, ["grp"]), ["grp"])


@query(SAMPLES + """,
src as (select *, ['vocals', 'drums', 'bass', 'guitar', 'piano', 'other'][vec_id % 6 + 1] as source from s),
st as (select *, case when source in ('guitar', 'piano', 'other') then 'other' else source end as stem from src)
select vec_id // 6 as grp, stem, i, greatest(-32768, least(32767, sum(v)))::int as v from st group by all
""")
def stem_regroup(spark, d):
    """PJ5, AG2: six sources as the four-stem profile."""
    names = F.array(*[F.lit(x) for x in ("vocals", "drums", "bass", "guitar", "piano", "other")])
    b = blocks(spark, d).select(F.floor(F.col("vec_id") / 6).alias("grp"), F.get(names, (F.col("vec_id") % 6).cast("int")).alias("source"), "pcm")
    return positions(signal.regrouped(b, 4, ["grp"]), ["grp", "stem"])


@query(f"""
with {PCM},
j as (select b.vec_id, b.pcm, p.pcm as prev from blocks b left join blocks p on p.vec_id = b.vec_id - 1 and p.vec_id // 50 = b.vec_id // 50),
s as (select vec_id, unnest(range(0, 48)) as i, pcm, prev from j)
select vec_id, i, case when prev is null or i >= 16 then pcm[i + 1] else round(prev[48 + i + 1] + (pcm[i + 1] - prev[48 + i + 1]) * ((i // 2) / 7.0::double))::int end as v from s
""")
def crossfade(spark, d):
    """WN2, ST10: hops of 24 stereo frames whose first 8 fade over from the previous block's tail; a block is a hop and its overlap."""
    b = blocks(spark, d).withColumn("stream", F.floor(F.col("vec_id") / 50))
    out = signal.crossfade(b, ["stream"], "vec_id", 24, 8).select("vec_id", F.col("hop_pcm").alias("pcm"))
    return positions(out, ["vec_id"])


@query(SAMPLES + " select vec_id, i, greatest(-32768, least(32767, round(v * (1.0::double + (label % 3 * 0.5::double - 1.0) * least(1.0, (i // 2 + 1) / 10.0::double)))))::int as v from s")
def gain_ramp(spark, d):
    """WN8: from gain 1 to the label's within ten frames."""
    b = blocks(spark, d).withColumn("target", F.col("label") % 3 * 0.5)
    return positions(b.select("vec_id", signal.ramped(F.col("pcm"), F.lit(1.0), F.col("target"), F.lit(10), F.lit(0)).alias("pcm")), ["vec_id"])


@query(f"""
with recursive {PCM}, s as (select vec_id, vec_id // 50 as stream, unnest(pcm) as v, generate_subscripts(pcm, 1) - 1 as i from blocks),
g as (select user_id, event_id * 7 % 1600 as place, arg_max((event_id % 6 / 4.0)::double, event_id) as target from events where event_type = 'click' and event_id % 6 < 5 group by all),
n as (select *, row_number() over (partition by user_id order by place) as k from g),
c as (select user_id, k, place, 1.0::double as start, target from n where k = 1 union all
  select n.user_id, n.k, n.place, c.start + (c.target - c.start) * least(1.0::double, (n.place - c.place) / 60.0::double), n.target from c join n on n.user_id = c.user_id and n.k = c.k + 1),
f as (select *, vec_id % 50 * 32 + i // 2 as frame from s)
select vec_id, i, greatest(-32768, least(32767, round(v * coalesce(start + (target - start) * least(1.0::double, (frame - place + 1) / 60.0::double), 1.0::double))))::int as v
from f asof left join c on c.user_id = f.stream and f.frame >= c.place
""")
def gain_retargets(spark, d):
    """WN8: gains that are changed while they still move; a stream is 50 blocks, its controls are a user's clicks, refused above gain 1."""
    b = blocks(spark, d).select("vec_id", F.floor(F.col("vec_id") / 50).alias("stream"), (F.col("vec_id") % 50 * 32).alias("first_frame"), "pcm")
    n = F.col("event_id")
    e = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").cast("long").alias("stream"), (n * 7 % 1600).alias("at"), (n % 6 / 4).alias("gain"), "event_id")
    changes = signal.gain_changes(e, ["stream"], "at", "gain", "event_id", 60)
    return positions(signal.gained(b, changes, ["stream"], "first_frame", "at", 60), ["vec_id"])


@query(SAMPLES + " select vec_id, i // 8 as block, round(avg(abs(v)), 6) as mean_abs from s group by vec_id, i // 8 having count(*) = 8")
def block_envelope(spark, d):
    """WN10."""
    e = blocks(spark, d).select("vec_id", F.posexplode(signal.envelope(F.transform("pcm", lambda v: v.cast("double")), 8)).alias("block", "m"))
    return e.select("vec_id", F.col("block").cast("long").alias("block"), F.round("m", 6).alias("mean_abs"))


@query("""
with recursive x as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings),
y as (select vec_id, 1 as i, e, 0.25::double * e[1] as s from x union all select vec_id, i + 1, e, s + 0.25::double * (e[i + 1] - s) from y where i < len(e))
select vec_id, (i - 1)::bigint as i, round(s, 6) as v from y
""")
def iir_lowpass(spark, d):
    """WN9: a one-pole low-pass along each vector."""
    e = table(spark, d, "embeddings").select("vec_id", signal.one_pole(F.transform("embedding", lambda v: v.cast("double")), 0.25).alias("y"))
    return e.select("vec_id", F.posexplode("y").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(f"""
with {PCM},
c as (select a.vec_id, a.pcm as song, b.pcm[9:24] as probe from blocks a join blocks b on a.vec_id = b.vec_id),
o as (select vec_id, unnest(range(0, (len(song) - 16) // 2 + 1)) as off, song, probe from c),
s as (select vec_id, off, song[2 * off + 1 : 2 * off + 16] = probe as same from o)
select vec_id, min(off) filter (same) as found, 1.0::double as correlation from s where abs(off - 5) <= 6 group by vec_id
""")
def align_exact(spark, d):
    """JN5: a block's frames 4 to 11 are found again in it, near frame 5."""
    b = blocks(spark, d)
    c = b.select("vec_id", F.col("pcm").alias("song_pcm"), F.slice("pcm", 9, 16).alias("pcm"), F.lit(5).alias("approx"), F.lit(6).alias("radius"))
    return cache.located(c).select("vec_id", F.col("offset").alias("found"), F.round("correlation", 6).alias("correlation"))


@query(f"""
with {PCM},
p as (select a.vec_id as a_id, b.vec_id as b_id, unnest(a.pcm)::double as x, unnest(b.pcm)::double as y from blocks a join blocks b on b.vec_id = a.vec_id + 1)
select a_id, b_id, round(corr(x, y), 6) as correlation, round(regr_slope(x, y), 6) as gain from p group by all
""")
def block_correlation(spark, d):
    """WN11: correlation and gain of neighbouring blocks."""
    b = blocks(spark, d)
    j = b.select(F.col("vec_id").alias("a_id"), (F.col("vec_id") + 1).alias("b_id"), F.col("pcm").alias("a")).join(b.select(F.col("vec_id").alias("b_id"), F.col("pcm").alias("b")), "b_id")
    corr, gain = signal.correlation(F.col("a"), F.col("b"))
    return j.select("a_id", "b_id", F.round(corr, 6).alias("correlation"), F.round(gain, 6).alias("gain"))


@query(f"""
with {PCM}, f as (select vec_id, unnest(range(0, len(pcm) // 2)) as f, pcm from blocks),
m as (select vec_id, f, pcm[2 * f + 1] as l, pcm[2 * f + 2] as r, (pcm[2 * f + 1] + pcm[2 * f + 2] - ((pcm[2 * f + 1] + pcm[2 * f + 2]) % 2 + 2) % 2) // 2 as c from f)
select vec_id, 'vocals' as stem, sum(c)::bigint * 2 as total from m group by vec_id
union all select vec_id, 'instrumental', sum(greatest(-32768, least(32767, l - c)) + greatest(-32768, least(32767, r - c)))::bigint from m group by vec_id
""")
def stems_pipeline(spark, d):
    """UD1: a model of two stems over blocks, as a table function."""
    out = separated(blocks(spark, d), ["vec_id"], lambda: mid_side)
    return out.select("vec_id", "stem", F.aggregate("pcm", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(f"""
with {PCM}, f as (select vec_id, vec_id // 50 as stream, unnest(range(0, len(pcm) // 2)) as f, pcm from blocks),
m as (select vec_id, stream, pcm[2 * f + 1] as l, pcm[2 * f + 2] as r, (pcm[2 * f + 1] + pcm[2 * f + 2] - ((pcm[2 * f + 1] + pcm[2 * f + 2]) % 2 + 2) % 2) // 2 as c from f),
s as (select vec_id, stream, 'vocals' as stem, c as x, c as y from m union all select vec_id, stream, 'instrumental', greatest(-32768, least(32767, l - c)), greatest(-32768, least(32767, r - c)) from m)
select vec_id, stem, sum(x + y)::bigint as total, null::bigint as windows, null::int as peak from s group by vec_id, stem
union all select null, stem, null, count(distinct vec_id), max(greatest(abs(x), abs(y)))::int from s group by stream, stem
""")
def stems_in_sql(spark, d):
    """UD1: the same model called in SQL, once for each stream's blocks in order, with what each call has seen."""
    spark.udtf.register("hl_stems", table_function(lambda: mid_side, "vec_id long"))
    blocks(spark, d).select("vec_id", "pcm", F.floor(F.col("vec_id") / 50).alias("stream")).createOrReplaceTempView("hl_windows")
    out = spark.sql("select * from hl_stems(table(hl_windows) partition by stream order by vec_id)")
    return out.select("vec_id", "stem", F.aggregate("pcm", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), "windows", "peak")


@query("select event_id, greatest(-32768, least(32767, round(value * 321.5)))::int as pcm, round_even(greatest(-1, least(1, (value - 20) / 40)) * 32767, 0)::int as from_float from events")
def pcm_rounding(spark, d):
    """SF10, SF12: the two roundings."""
    return table(spark, d, "events").select("event_id", numeric.pcm16(F.col("value") * 321.5).cast("int").alias("pcm"), numeric.pcm16_of_float((F.col("value") - 20) / 40).cast("int").alias("from_float"))


@query("select event_id, ((event_id * 1000003 % 4294967296) - (event_id * 7000001 % 4294967296) + 4294967296) % 4294967296 as gone, least(100 * (2 ** least(event_id % 9, 4))::bigint, 1000) as delay from events")
def rtp_wrap(spark, d):
    """SF13, SF14: wrap-safe differences and the back-off."""
    e = table(spark, d, "events")
    return e.select("event_id", numeric.wrapped_difference(F.col("event_id") * 1000003 % numeric.WRAP, F.col("event_id") * 7000001 % numeric.WRAP).alias("gone"), numeric.retry_delay_ms(F.col("event_id") % 9).cast("long").alias("delay"))


# --- identity and cache


@query("select sha256(regexp_replace(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \\n\\t\\r'), '\\s+', ' ', 'g')) as content_key, min(doc_id) as first_id, count(*) as copies from documents group by 1")
def content_dedupe(spark, d):
    """AG12, JN3: documents by content key."""
    low = F.translate(F.regexp_replace(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""), r"\s+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return table(spark, d, "documents").groupBy(F.sha2(low, 256).alias("content_key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("""
with e as (select doc_id, sha256(text) as cache_key, doc_id % 3 <> 0 as done from documents), k as (select cache_key, max(doc_id) as entry_id from e where done group by cache_key)
select e.doc_id, entry_id, entry_id is not null as hit from e left join k using (cache_key)
""")
def cache_lookup(spark, d):
    """JN3: requests against complete entries."""
    e = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"))
    entries = e.where("doc_id % 3 <> 0").groupBy("cache_key").agg(F.max("doc_id").alias("entry_id")).withColumn("state", F.lit("complete"))
    return cache.lookup(e, entries).select("doc_id", "entry_id", "hit")


@query("""
with o as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate from orders), n as (select * from o where o_orderkey % 10 = 0),
j as (select n.o_orderkey as request, o.o_orderkey as song, row_number() over (partition by n.o_orderkey order by o.o_orderdate desc, o.o_orderkey) as rn
  from n join o using (o_custkey, o_orderpriority) where abs(n.o_totalprice - o.o_totalprice) <= 50000 and o.o_orderkey % 10 <> 0)
select request, song from j where rn = 1
""")
def tolerant_lookup(spark, d):
    """JN4: equal customer and priority, price within 50,000, the latest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate")
    out = cache.tolerant(o.where("o_orderkey % 10 = 0"), o.where("o_orderkey % 10 <> 0"), ["o_custkey", "o_orderpriority"], "o_totalprice", F.lit(50000), "o_orderdate", bucket=50000)
    return out.select(F.col("o_orderkey").alias("request"), F.col("song_o_orderkey").alias("song"))


@query("""
with r as (select l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() over (partition by l_partkey order by (l_returnflag = 'R') desc, abs(l_quantity - 25), l_orderkey, l_linenumber, l_suppkey) as rn from lineitem)
select l_partkey, l_orderkey, l_linenumber, l_suppkey from r where rn = 1
""")
def best_candidate(spark, d):
    """JN8, TK5: the best row by a flag, the nearest value, then its place."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    out = cache.best_candidate(l, ["l_partkey"], [F.col("l_returnflag") != "R", F.abs(F.col("l_quantity") - 25), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("""
with t as (select *, sum(n_chars) over (partition by source) as total, sum(n_chars) over (partition by source order by doc_id) as run from documents)
select source, doc_id, (total - (run - n_chars))::bigint as left_before, row_number() over (partition by source order by doc_id) as removal_order from t where total - (run - n_chars) > 60000
""")
def lru_quota(spark, d):
    """TK2: which entries of each source go until 60,000 are left."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return cache.evicted(docs, ["source"], ["doc_id"], "n_chars", F.lit(60000)).select("source", "doc_id", "left_before", F.col("removal_order").cast("long").alias("removal_order"))


@query(f"with {NUMBERED}, s as (select user_id, max(frame) as safe from numbered group by user_id) select user_id, frame from numbered join s using (user_id) where frame > safe - 8")
def retention_cutoff(spark, d):
    """ST2: what is kept below the consumer's sequence."""
    e = numbered_events(spark, d).select("user_id", "frame")
    return cache.retained(e, e.groupBy("user_id").agg(F.max("frame").alias("safe_sequence")), ["user_id"], "frame")


@query("select l_orderkey, count(*) as n, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as complete from lineitem group by l_orderkey")
def manifest_completeness(spark, d):
    """SO6: dense line numbers."""
    return cache.dense(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i")), ["l_orderkey"], "i")


@query("with r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as rn from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)) select l_orderkey, l_linenumber, l_partkey, l_suppkey from r where rn = 1")
def latest_chunk(spark, d):
    """SO5: the latest row of each index."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("version", F.struct("l_partkey", "l_suppkey"))
    return cache.upserted(l, ["l_orderkey"], "l_linenumber", "version").drop("version")


@query("""
with f as (select source, doc_id % 7 as entry, 'part-' || lpad(doc_id::varchar, 6, '0') as path, strlen(text) as size, sha256(text) as sha from documents)
select source, entry, count(*) as files, upper(sha256(string_agg(path || '|' || size || '|' || upper(sha), chr(10) order by path) || chr(10))) as manifest_sha256 from f group by all
""")
def manifest_hash(spark, d):
    """AG13: one hash over an ordered listing."""
    docs = table(spark, d, "documents").select("source", (F.col("doc_id") % 7).alias("entry"), F.concat(F.lit("part-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    return identity.manifest_hash(docs, ["source", "entry"])


@query("select source, sum(strlen(text))::bigint as bytes, count(*) as files from documents group by source")
def entry_sizes(spark, d):
    """AG5, AG4."""
    return cache.sizes(table(spark, d, "documents").select("source", F.octet_length("text").alias("bytes")), ["source"])


@query("""
with f as (select source, doc_id, sha256(text) as h, case when doc_id % 17 = 0 then sha256(text || 'x') else upper(sha256(text)) end as h2 from documents),
e as (select doc_id, h from f where doc_id % 13 <> 0), a as (select doc_id, h2 from f where doc_id % 11 <> 0)
select doc_id, case when a.doc_id is null then 'missing' when e.doc_id is null then 'unexpected' else 'changed' end as difference
from e full join a using (doc_id) where a.doc_id is null or e.doc_id is null or lower(h) <> lower(h2)
""")
def manifest_compare(spark, d):
    """JN12: expected against actual hashes, case ignored."""
    f = table(spark, d, "documents")
    e = f.where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    other = F.when(F.col("doc_id") % 17 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return joins.compared(e, f.where("doc_id % 11 <> 0").select("doc_id", other.alias("sha")), "doc_id", "sha")


# --- telemetry and decisions


@query("select event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by event_type")
def latest_snapshot(spark, d):
    """D11, SC8: the last document of each source."""
    return telemetry.latest(table(spark, d, "events"), ["event_type"], "ts", ["event_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
select (select count(*) from events where event_type = 'error') as errors, (select max(value) from events where event_type = 'purchase') as best, (select max(event_id) from events where event_type = 'absent') as absent
""")
def snapshot_join(spark, d):
    """JN11: one-row documents side by side; a missing one is null."""
    e = table(spark, d, "events")
    part = lambda t, c: e.where(F.col("event_type") == t).groupBy("event_type").agg(c).drop("event_type")
    return telemetry.joined_snapshot([part("error", F.count("*").alias("errors")), part("purchase", F.max("value").alias("best")), part("absent", F.max("event_id").alias("absent"))])


@query(ACCEPTANCE + ACCEPTANCE_REPORT)
def acceptance_report(spark, d):
    """AG6, AG7, WN5, WN6, ST15: a session's requirements and state."""
    r = telemetry.acceptance(session_samples(spark, d), ["user_id"])
    return r.select("user_id", "samples", "streaming_samples", "active_samples", "maximum_pending_windows", "minimum_active_buffer_seconds", "active_mixer_updates_delta", "max_latency_ms", "stream_received", "song_cache_replayed", *telemetry.ZERO, "mixer_latency_below_limit", "state")


@query("""
with f as (select user_id, event_type as title, round(value, 0) as duration_seconds, min(event_id) as first_seen from events where event_type in ('view', 'click') group by all)
select *, row_number() over (partition by user_id order by first_seen, title, duration_seconds) as ordinal from f
""")
def tracks_seen(spark, d):
    """AG10: distinct tracks in the order they were first seen."""
    s = session_samples(spark, d)
    return telemetry.tracks_seen(s, ["user_id"], "observed_at_ns", F.col("streaming") | (F.col("playback_state") == "playing")).select("user_id", "title", "duration_seconds", "first_seen", F.col("ordinal").cast("long").alias("ordinal"))


@query("""
with c as (select user_id, event_id * 1000 as issued, event_id * 1000 + floor(value * 1000)::bigint - 20000 as applied from events),
l as (select *, ceil(greatest(0, applied - issued) / 1000.0) as us from c where issued >= 500000)
select user_id, count(*) as updates, arg_max(us, applied) / 1000 as last_ms, max(us) / 1000 as max_ms from l group by user_id
""")
def control_latency(spark, d):
    """AG8."""
    c = table(spark, d, "events").select("user_id", (F.col("event_id") * 1000).alias("issued_at_ns"), (F.col("event_id") * 1000 + F.floor(F.col("value") * 1000) - 20000).alias("applied_at_ns"))
    return telemetry.control_latency(c, ["user_id"], F.lit(500000))


@query("select event_type, min(value) as min, median(value) as median, max(value) as max from events group by event_type")
def timing_summary(spark, d):
    """AG11."""
    return telemetry.timings(table(spark, d, "events"), ["event_type"], "value")


@query(f"""
with {NUMBERED}, s as (select *, (event_id * 7919) % 1000 as seq from numbered)
select user_id, frame, seq from (select *, max(seq) over (partition by user_id order by frame rows between unbounded preceding and 1 preceding) as m from s) where m is null or seq > m
""")
def newest_commands(spark, d):
    """ST14, SC10: commands above all before them."""
    e = numbered_events(spark, d).select("user_id", "frame", (F.col("event_id") * 7919 % 1000).alias("seq")).withColumn("arrived_at", F.col("frame"))
    return telemetry.newest(e, ["user_id"], "seq").drop("arrived_at")


@query("""
select event_id, case when event_id % 101 = 0 then 'controller_stalled' when event_id % 97 = 0 then 'device_recovering' when event_id % 2 = 0 and event_id % 31 = 0 then 'network_loss' when event_id % 89 = 0 then 'stream_stalled'
  when event_id % 83 = 0 then 'device_reconnected' when event_id % 79 = 0 then 'windows_skipped' when event_id % 73 = 0 then 'active_underrun' when event_id % 19 = 0 and event_id % 3 = 0 then 'drained_while_idle' when event_id % 19 = 0 then 'underrun'
  when event_id % 17 = 0 then 'fallback' when event_type <> 'view' then 'waiting' when event_id % 13 = 0 then 'first_window' when value <= 3 then 'sustainable' else 'too_slow' end as state from events
""")
def continuity_state(spark, d):
    """SF19: the first rung that holds."""
    n = F.col("event_id")
    cols = {"controller_stalled": n % 101 == 0, "device_recovering": n % 97 == 0, "device_network_enabled": n % 2 == 0, "device_dropped_frames": F.when(n % 31 == 0, 5).otherwise(0), "device_send_errors": F.lit(0), "stream_stalled": n % 89 == 0, "active_device_recovery_delta": F.when(n % 83 == 0, 1).otherwise(0), "active_skipped_sequence_delta": F.when(n % 79 == 0, 1).otherwise(0), "active_underrun_delta": F.when(n % 73 == 0, 2).otherwise(0), "underruns": F.when(n % 19 == 0, 1).otherwise(0), "acceptance_active_samples": F.when(n % 3 == 0, 9).otherwise(0), "fallback_audio": n % 17 == 0, "streaming": F.col("event_type") == "view", "processing_seconds": F.when(n % 13 != 0, F.col("value")), "hop_seconds": F.lit(3.0)}
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in cols.items()]).select("event_id", rules.ladder(rules.CONTINUITY)[0])


@query("""
select event_id, case when value < 5.5 then 'limited' when value < 7.5 then 'compatibility' when value < 12 then 'balanced' else 'performance' end as tier, case when value < 5.5 then 2 when value < 7.5 then 4 else 6 end as live_stems,
  case when value >= 15 then 2 else 1 end as concurrency from events
""")
def gpu_tiers(spark, d):
    """SF20."""
    return table(spark, d, "events").select("event_id", rules.gpu_tier(F.col("value")).alias("t")).select("event_id", "t.tier", "t.live_stems", "t.concurrency")


@query("""
with r as (select event_id, event_id % 11 = 0 as song, event_id % 7 = 0 as win, event_id % 5 = 0 as wc, event_id % 4 as backlog, event_type = 'click' as playing, value as buf, event_id % 13 <> 0 as aud from events)
select event_id, case when song then 'song_cache' when win and not wc then 'window_cache' when not aud then 'fallback_silent' when playing and backlog >= 2 then 'fallback_backlog' when playing and buf <= 4 then 'fallback_buffer' else 'model' end as route from r
""")
def load_shedding(spark, d):
    """ST6: the cheapest answer that will do."""
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (n % 11 == 0).alias("song_hit"), (n % 7 == 0).alias("window_hit"), (n % 5 == 0).alias("windows_capture"), (n % 4).alias("backlog"), (F.col("event_type") == "click").alias("playing"), F.col("value").alias("buffered_seconds"), F.lit(3).alias("hop_seconds"), (n % 13 != 0).alias("audible"))
    return telemetry.shed(e).select("event_id", "route")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, least(50, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0)) as capped from events")
def json_props(spark, d):
    """PJ1, SC6: lenient readings of a JSON payload."""
    return table(spark, d, "events").select("event_id", telemetry.count_of(F.col("props"), "$.k").alias("k"), telemetry.metric_of(F.col("props"), "$.k", most=50.0).alias("capped"))


@query("""
with p as (select user_id, ['sent', 'dropped', 'failed'][event_id % 3 + 1] as state, event_id % 9 as f, event_id % 100 as b from events)
select user_id, count(*) filter (state <> 'dropped') as enqueued_packets, count(*) filter (state = 'dropped') as dropped_packets, coalesce(sum(f) filter (state = 'dropped'), 0)::bigint as dropped_frames,
  count(*) filter (state = 'sent') as sent_packets, coalesce(sum(b) filter (state = 'sent'), 0)::bigint as sent_bytes, count(*) filter (state = 'failed') as send_errors from p group by user_id
""")
def send_counters(spark, d):
    """AG15."""
    n = F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("sent", "dropped", "failed")])
    return publication.send_counters(table(spark, d, "events").select("user_id", F.get(names, (n % 3).cast("int")).alias("state"), (n % 9).alias("frame_count"), (n % 100).alias("bytes")), ["user_id"])


@query(f"""
with recursive {NUMBERED}, n as (select user_id, frame, event_id * 7919 % 50 as now from numbered),
r as (select user_id, frame, now as id from n where frame = 0 union all select n.user_id, n.frame, greatest(n.now, r.id + 1) from r join n on n.user_id = r.user_id and n.frame = r.frame + 1)
select * from r
""")
def increasing_ids(spark, d):
    """SF25: max(now, previous + 1) along each user's events."""
    e = numbered_events(spark, d).select("user_id", "frame", (F.col("event_id") * 7919 % 50).alias("now"))
    return publication.increasing_ids(e, ["user_id"], "frame", "now").drop("now")


@query("select user_id, arg_min(event_id, (-value, event_id)) as event_id, max(value) as value from events group by user_id")
def loudest_probe(spark, d):
    """AG17: where the greatest value is, the first of equal ones."""
    return publication.loudest(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("""
with c as (select l_orderkey, l_linenumber - 1 as i, l_linenumber % 7 <> 0 as whole from (select distinct l_orderkey, l_linenumber from lineitem)),
r as (select l_orderkey, min(i) = 0 and max(i) = count(*) - 1 and bool_and(whole) as ready from c group by l_orderkey)
select o_orderkey, case when o_orderkey % 5 = 0 or coalesce(ready, false) then 'complete' else 'building' end as state from orders left join r on l_orderkey = o_orderkey
""")
def cache_finalize(spark, d):
    """SK19, SO6, FL14: entries whose chunks are dense and have all stems become complete; each seventh chunk lacks one."""
    entries = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "complete").otherwise("building").alias("state"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("i")).distinct()
    stems = F.array(F.lit("drums"), F.lit("vocals"))
    return publication.finalized(entries, l.withColumn("stems", F.when(F.col("i") % 7 == 6, F.slice(stems, 1, 1)).otherwise(stems)), ["o_orderkey"], "i", "stems", stems)


@query("""
select event_id, not (event_id % 2 = 0) as restart_receiver, not (event_id % 2 = 0) or not (event_id % 3 = 0) or event_type <> 'view' or event_id % 5 = 0 as restart_playback from events
""")
def start_plan(spark, d):
    """PJ8."""
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", (n % 2 == 0).alias("receiver_running"), (n % 3 == 0).alias("playback_running"), F.col("event_type").alias("current_profile"), F.lit("view").alias("requested_profile"), F.lit("").alias("current_endpoint"), F.lit("").alias("requested_endpoint"), F.when(n % 5 == 0, 3).otherwise(6).alias("current_hop_seconds"), F.lit(6).alias("requested_hop_seconds"))
    return e.select("event_id", *rules.start_plan())


# --- sets, selections, closure


@query("select u.user_id, t.event_type from (select distinct user_id from events) u, (select distinct event_type from events) t except select user_id, event_type from events where value < 3")
def missing_members(spark, d):
    """SO2: types that a user has not sent with a value below 3. The types are one row, a set."""
    e = table(spark, d, "events").select("user_id", "event_type")
    types = e.groupBy(F.lit(1).alias("one")).agg(F.collect_set("event_type").alias("types"))  # one row
    users = e.select("user_id", F.lit(1).alias("one")).distinct()
    expected = users.join(types, "one").select("user_id", F.explode("types").alias("event_type"))
    return joins.missing(expected, table(spark, d, "events").where("value < 3"), ["user_id", "event_type"])


@query(r"""
with p as (select s_suppkey as pid, ['Spotify.exe', 'vlc', 'notepad.exe', 'C:\apps\QQMusic.EXE', 'music.player.exe', 'foobar2000.exe ', 'spotify', 'Microsoft.Media.Player.exe', 'browser', 'AIMP.exe'][s_suppkey % 10 + 1] as name from supplier)
select * from p where pid % 10 in (0, 1, 3, 5, 6, 7, 9)
""")
def allowlist_semi(spark, d):
    """FL5: processes of the known players; case, folder, extension and outer spaces are ignored."""
    names = F.array(*[F.lit(x) for x in ("Spotify.exe", "vlc", "notepad.exe", "C:\\apps\\QQMusic.EXE", "music.player.exe", "foobar2000.exe ", "spotify", "Microsoft.Media.Player.exe", "browser", "AIMP.exe")])
    return rules.allowed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), F.get(names, (F.col("s_suppkey") % 10).cast("int")).alias("name")))


@query("""
with a as (select distinct l_suppkey as idx from lineitem where l_quantity > 45), i as (select s_suppkey as idx, s_acctbal as metric, s_nationkey from supplier where s_suppkey % 2 = 0)
select idx, s_name as name, metric from i join a using (idx) join supplier on s_suppkey = idx order by metric, s_name limit 1
""")
def adapter_topk(spark, d):
    """JN10: the connected adapter of least metric, then name."""
    s = table(spark, d, "supplier")
    adapters = s.select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name"))
    interfaces = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("metric"))
    addresses = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("idx")).distinct()
    return joins.best_adapter(adapters, interfaces, addresses, "idx", "metric", "name").select("idx", "name", "metric")


@query("""
with p as (select s_suppkey as pid, 'app ' || s_suppkey % 9 as key, s_name as name, case when s_suppkey % 3 = 0 then 'title' else '' end as title from supplier where s_suppkey > 0)
select key, arg_max(name, (title <> '', -pid)) as name, arg_max(title, (title <> '', -pid)) as title, arg_max(pid, (title <> '', -pid)) as pid from p group by key
""")
def best_process(spark, d):
    """AG9: one process for each name."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), F.concat(F.lit("APP "), (F.col("s_suppkey") % 9).cast("string")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "title").alias("title"), "s_name")
    return joins.best_process(s.drop("s_name")).join(s.select("pid", "s_name"), "pid").select("key", F.col("s_name").alias("name"), "title", "pid")


@query("""
with recursive e as (select 'O' || l_orderkey as parent, 'P' || l_partkey as child from lineitem union all select 'P' || l_partkey, 'S' || l_suppkey from lineitem union all select 'S' || l_suppkey, 'O' || (l_suppkey * 50) from lineitem),
x as materialized (select distinct lower(parent) as parent, lower(child) as child from e),
c(node) as (select 'o100' union select child from c join x on x.parent = c.node)
select node from c
""")
def dependency_closure(spark, d):
    """GR1: all that order 100 reaches by way of parts and suppliers; the edges have cycles."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    tag = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    order, part, supplier = tag("O", F.col("l_orderkey")), tag("P", F.col("l_partkey")), tag("S", F.col("l_suppkey"))
    edges = F.array(*[F.struct(p.alias("parent"), c.alias("child")) for p, c in ((order, part), (part, supplier), (supplier, tag("O", F.col("l_suppkey") * 50)))])
    return joins.closure(l.select(F.inline(edges)), spark.createDataFrame([("O100",)], "node string"))


@query("""
with e as (select o_orderkey as seq, unnest(['vocals', 'drums', 'bass']) as stem from orders), m as (select o_orderkey as seq from orders where o_orderkey % 3 <> 0),
f as (select l_orderkey as seq, ['vocals', 'drums', 'bass'][(l_linenumber - 1) % 3 + 1] as stem, max((l_partkey % 2)) as frames from lineitem group by all)
select e.seq, case when bool_or(m.seq is not null) is not true then 'waiting' when bool_and(f.frames is not null) and min(f.frames) = max(f.frames) then 'ready' else 'skipped' end as state
from e left join m using (seq) left join f on f.seq = e.seq and f.stem = e.stem group by e.seq
""")
def group_readiness(spark, d):
    """SC4: waiting, skipped or ready."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"))
    names = F.array(*[F.lit(x) for x in ("vocals", "drums", "bass")])
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.get(names, (F.col("l_linenumber") - 1) % 3).alias("stem")).agg(F.max(F.col("l_partkey") % 2).alias("frames"))
    f = f.withColumn("sample_rate", F.lit(44100)).withColumn("channels", F.lit(2))
    return joins.group_state(o.withColumn("stem", F.explode(names)), o.where("seq % 3 <> 0"), f, ["seq"])


# --- text and packets


@query("""
with l as (select conv_id, turn, replace(text, chr(10), ' ') as t from conversations)
select conv_id || '-' || turn // 1000 as track_key, row_number() over (partition by conv_id, turn // 1000 order by turn) - 1 as line_no, round(turn % 1000 * 60 + 2.25 + 0.5, 3) as time_seconds, substr(trim(t), 1, 4096) as text
from l where trim(t) <> ''
""")
def lrc_roundtrip(spark, d):
    """SF2, TK8: turns written as timed lyrics with an offset, and parsed. Minutes have three digits at most, so each thousand turns are a text of their own."""
    c = table(spark, d, "conversations").withColumn("minute", (F.col("turn") % 1000).cast("string"))
    line = F.concat(F.lit("["), F.lpad("minute", F.greatest(F.lit(2), F.length("minute")), F.lit("0")), F.lit(":02.25]"), F.regexp_replace("text", "\n", " "))
    key = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 1000).cast("string")).alias("track_key")
    docs = c.groupBy(key).agg(F.concat(F.lit("[offset:+500]\n[ar:x]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")).alias("lrc"))
    return lyrics.parsed(docs, "track_key", "lrc").withColumn("line_no", F.col("line_no").cast("long"))


@query("""
with l as (select conv_id, turn, (turn * 10)::double as t, text from conversations), p as (select conv_id, unnest([-5.0, 5.0, 10.0, 34.5, 9999.0])::double as position from (select distinct conv_id from conversations))
select p.conv_id, p.position, l.text as current from p asof left join l on p.conv_id = l.conv_id and greatest(p.position, 0) >= l.t
""")
def lyric_position(spark, d):
    """JN6: the line at a position."""
    c = table(spark, d, "conversations")
    lines = c.select("conv_id", F.col("turn").alias("line_no"), (F.col("turn") * 10).cast("double").alias("time_seconds"), "text")
    p = c.select("conv_id").distinct().withColumn("given", F.explode(F.array(*[F.lit(x) for x in (-5.0, 5.0, 10.0, 34.5, 9999.0)]))).withColumn("position", F.col("given"))
    return lyrics.current(p, lines, "conv_id", "position").select("conv_id", F.col("given").alias("position"), "current")


@query("select event_id, event_id % 1000 as sequence, event_id * 7 as presentation_frame, 3::bigint as frame_count, 'none' as error, case when event_id % 2 = 0 then 'checksum_mismatch' else 'wrong_magic' end as broken, true as same from events")
def packet_roundtrip(spark, d):
    """SC18, SK18, SF16, AG14: audio packets built, parsed, and refused when damaged."""
    n = F.col("event_id")
    pcm = F.transform(F.array(n, -n, n * 3, F.lit(-32768), F.lit(32767), F.lit(0)), lambda v: (v % 32768).cast("smallint"))
    p = table(spark, d, "events").select("event_id", pcm.alias("pcm")).withColumn("p", binary.audio_packet(F.lit(9), n % 1000, n * 7, F.lit(44100), F.col("pcm")))
    flipped = binary.little_endian(binary.unsigned(F.col("p"), 41, 1).bitwiseXOR(F.lit(0x55)), 1)  # a fixed byte would leave packets whole that hold it there
    damaged = F.when(n % 2 == 0, F.concat(F.substring("p", 1, 41), flipped, F.substring("p", 43, 2000))).otherwise(F.concat(F.lit(b"X"), F.substring("p", 2, 2000)))
    p = p.withColumn("q", damaged).repartition("event_id")  # sent and received: the packet is not built again for each of its fields
    out = p.select("event_id", binary.audio_fields(F.col("p")).alias("f"), binary.audio_error(F.col("p")).alias("error"), binary.audio_error(F.col("q")).alias("broken"), "pcm").repartition("event_id")
    return out.select("event_id", "f.sequence", "f.presentation_frame", "f.frame_count", "error", "broken", (F.col("f.pcm") == F.col("pcm")).alias("same"))


_LITTLE = "list_aggregate(list_transform(range(0, {w}), lambda i: printf('%02X', ({v}) >> (8 * i) & 255)), 'string_agg', '')"


@query(f"""
with e as (select event_id, event_id % 200 as mask, list_transform(range(0, 7), lambda i: event_id * (i + 3) % (32769 + (event_id % 5 = 0)::int * 9)) as gains from events),
g as (select *, mask < 128 and list_max(gains) <= 32768 as fine, list_filter(['vocals', 'instrumental', 'drums', 'bass', 'other', 'guitar', 'piano'], lambda x, i: mask >> (i - 1) & 1 = 1) as stems from e),
k as (select *, case when not fine then 0 else event_id % 8 end as damage, list_sum(list_transform(gains, lambda x, i: case when mask >> (i - 1) & 1 = 1 then x end))::double / 32768 as total from g)
select event_id, case when fine then '53534E5001023000' || {_LITTLE.format(w=4, v="event_id % 7")} || {_LITTLE.format(w=4, v="event_id")} || {_LITTLE.format(w=8, v="event_id * 1000")} || {_LITTLE.format(w=1, v="mask")} || '000000'
    || list_aggregate(list_transform(gains, lambda x: printf('%02X%02X', x & 255, x >> 8 & 255)), 'string_agg', '') || '0000' end as body,
  case when fine then ['none', 'too_short', 'invalid_length', 'wrong_magic', 'wrong_packet_type', 'invalid_header', 'checksum_mismatch', 'invalid_control'][damage + 1] end as error,
  case when fine and damage = 0 then event_id else -1 end as sequence, case when fine and damage = 0 then event_id * 1000 else -1 end as issued_at_ms, case when fine and damage = 0 then len(stems) else -1 end as stems, case when fine and damage = 0 then coalesce(round(total, 6), 0) end as total_gain from k
""")
def control_packets(spark, d):
    """SC18, SK18, FL10: mixer control packets built byte by byte, refused by the first rule that a damaged one breaks, read by stem; none is built for masks beyond the stems or gains beyond unity."""
    n = F.col("event_id")
    gains = F.transform(F.sequence(F.lit(3), F.lit(9)), lambda i: (n * i % (32769 + F.when(n % 5 == 0, 9).otherwise(0))).cast("int"))
    p = table(spark, d, "events").select("event_id", binary.control_packet(n % 7, n, n * 1000, n % 200, gains).alias("p"))
    cut = lambda a, b=None: F.substring("p", a, 48 if b is None else b)
    resealed = binary._sealed(F.concat(cut(1, 24), F.lit(b"\x80"), cut(26)), binary.CONTROL_SUM)
    damaged = (
        F.when(n % 8 == 1, cut(1, 47)).when(n % 8 == 2, F.concat(F.col("p"), F.lit(b"\0"))).when(n % 8 == 3, F.concat(F.lit(b"s"), cut(2))).when(n % 8 == 4, F.concat(cut(1, 5), F.lit(b"\1"), cut(7)))
        .when(n % 8 == 5, F.concat(cut(1, 25), F.lit(b"\1"), cut(27))).when(n % 8 == 6, F.concat(cut(1, 44), F.lit(b"\x01\x02\x03\x04"))).when(n % 8 == 7, resealed).otherwise(F.col("p"))
    )
    r = p.withColumn("q", damaged).withColumns({"error": F.when(F.col("p").isNotNull(), binary.control_error(F.col("q"))), "f": binary.control_fields(F.col("q"))})
    total = F.aggregate(F.map_values("f.gains"), F.lit(0.0), lambda a, v: a + v)
    return r.select("event_id", F.substring(F.hex("p"), 1, 88).alias("body"), "error", *[F.coalesce(v, F.lit(-1).cast("long")).alias(c) for c, v in (("sequence", F.col("f.sequence")), ("issued_at_ms", F.col("f.issued_at_ms")), ("stems", F.when(F.col("f").isNotNull(), F.size("f.gains").cast("long"))))], F.round(total, 6).alias("total_gain"))


@query("""
with c as (select user_id as stream, event_id * 37 % 10007 as sequence, event_type as kind, ts, event_id from events where event_type in ('signup', 'click', 'error')),
m as (select *, max(sequence) over (partition by stream order by ts, event_id rows between unbounded preceding and 1 preceding) as before from c)
select stream, sequence, case when kind = 'signup' then 'start' else kind end as action from m where sequence > coalesce(before, -1) and (kind <> 'signup' or sequence % 3 = 0)
""")
def effective_commands(spark, d):
    """SC10, SK10: commands whose sequence is above all that arrived before; a start takes effect only if its capture session is there."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), (F.col("event_id") * 37 % 10007).alias("sequence"), "event_type", F.struct("ts", "event_id").alias("arrived_at"))
    action = F.when(F.col("event_type") == "signup", "start").otherwise(F.col("event_type"))
    rows = e.where("event_type in ('signup', 'click', 'error')").select("stream", "sequence", action.alias("action"), "arrived_at")
    sessions = e.where("sequence % 3 = 0").select("stream", "sequence").distinct()
    return documents.commands(rows, sessions).select("stream", "sequence", "action")


@query("""
select event_id, case when event_id >= 3600 then event_id // 3600 || ':' || lpad((event_id // 60 % 60)::varchar, 2, '0') else lpad((event_id // 60)::varchar, 2, '0') end || ':' || lpad((event_id % 60)::varchar, 2, '0') as clock, 'capture-' || lpad(event_id::varchar, 8, '0') as name from events
""")
def clock_names(spark, d):
    """SF4, SF8."""
    return table(spark, d, "events").select("event_id", text.clock(F.col("event_id")).alias("clock"), text.sequence_name("capture", F.col("event_id")).alias("name"))
