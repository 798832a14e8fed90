"""Queries of segments, cached songs, the pipeline's snapshot and the state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions import numeric
from hopline.operators import alignment, cache, framing, signal, telemetry, timeline
from hopline.plans.bindings import NUMBERED, PCM, blocks, numbered_events, session_anchors
from hopline.plans.registry import query
from hopline.sources.tables import table
from hopline.streaming import machines, run

# --- segments

DAYS = """
s as (select user_id, event_id, epoch_us(ts) // 1000000 - 1704067200 as pos from events where event_type = 'signup'),
a as (select *, lead(pos) over w as nxt, row_number() over w as rn from s window w as (partition by user_id order by pos, event_id)),
days as (select user_id, unnest(range(0, max(pos) // 86400 + 1)) * 86400 as s0 from s group by user_id),
firsts as (select d.user_id, d.s0, a.event_id, a.pos, a.nxt, a.rn from days d join a using (user_id)),
cut as (select *, s0 + 60 as lo, s0 + 60 + 80000 as hi from firsts),
low as (select *, case when rn = 1 and pos > lo and 100 + lo - pos >= 0 then lo else greatest(pos, lo) end as a0 from cut),
seg as (select *, 100 + a0 - pos as trk, least(hi, coalesce(nxt, hi), a0 + 86400 - (100 + a0 - pos)) as a1 from low),
pieces as (select * from seg where a0 < a1 and trk >= 0 and trk < 86400)
"""


def _daily_segments(spark, d) -> DataFrame:
    """A user's days up to the last anchor's, each with its pieces."""
    days = F.sequence(F.lit(0).cast("long"), F.floor(F.array_max(F.transform("anchors", lambda a: a["anchor_stream_frame"])) / 86400))
    w = session_anchors(spark, d).withColumn("day", F.explode(days)).withColumn("window_start", F.col("day") * 86400).withColumn("stream_start_frame", F.col("window_start")).drop("day")
    return timeline.segments(w, ["user_id", "window_start"], F.lit(60), F.lit(80000))


@query(f"with {DAYS} select user_id, s0 as window_start, event_id as revision, a0 as stream_start_frame, a1 as stream_end_frame, trk as track_start_frame, trk + a1 - a0 as track_end_frame from pieces")
def anchor_segments(spark, d):
    """JN1: the pieces of a daily output interval by the anchor that holds, clipped, back-projected, ended with the track."""
    return _daily_segments(spark, d).select("user_id", "window_start", "revision", "stream_start_frame", "stream_end_frame", "track_start_frame", "track_end_frame")


@query(f"with {DAYS} select user_id, s0 as window_start, bool_and(event_id > 0) and sum(a1 - a0) = 80000 as usable from pieces group by all")
def cache_usable(spark, d):
    """FL8: days whose pieces can be looked up: no hole, revisions above 0, a name."""
    return timeline.covered(_daily_segments(spark, d), ["user_id", "window_start"], F.lit(80000))


@query(f"""
with {NUMBERED}, p as (select user_id, frame, frame // 6 as rev, case when event_type = 'view' then 'v' || frame else '' end as title, (frame % 4 = 0 or frame % 6 = 0) as fresh from numbered),
i as (select *, sum(fresh::int) over (partition by user_id order by frame) - 1 as island from p)
select user_id, island::bigint as island, min(frame) * 10 as first_frame, count(*) * 10 as frames, arg_max(title, frame) filter (title <> '') as title from i group by user_id, island
""")
def song_islands(spark, d):
    """WN4, AG19: neighbouring pieces of one revision whose track frames join, and the last name in each."""
    e = numbered_events(spark, d)
    n = lambda c: c.cast("long")
    f = F.col("frame")
    anchor = F.struct(
        n(F.floor(f / 6) + 1).alias("revision"), n(F.lit(1)).alias("metadata_revision"), F.lit(True).alias("has_progress"), n(F.lit(0)).alias("start_rtp"), n(F.lit(0)).alias("current_rtp"), n(F.lit(0)).alias("end_rtp"), n(f * 10).alias("anchor_stream_frame"),
        n(f * 10 + 3 * F.floor(f / 4)).alias("track_position_frame"), n(F.lit(1 << 40)).alias("track_duration_frame"), F.when(F.col("event_type") == "view", F.concat(F.lit("v"), f.cast("string"))).otherwise("").alias("title"), F.lit("").alias("artist"), F.lit("").alias("album"))
    w = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", anchor.alias("a")))), lambda x: x["a"]).alias("anchors"), (F.count("*") * 10).alias("frames")).withColumn("stream_start_frame", F.lit(0).cast("long"))
    pieces = timeline.islands(timeline.segments(w, ["user_id", "frames"], F.lit(0), F.col("frames")), ["user_id"])
    names = timeline.latest_names(pieces, ["user_id", "island"])
    spans = pieces.groupBy("user_id", "island").agg(F.min("stream_start_frame").alias("first_frame"), F.sum(F.col("stream_end_frame") - F.col("stream_start_frame")).alias("frames"))
    return spans.join(names.select("user_id", "island", "title"), ["user_id", "island"])


# --- the song cache


@query("""
select vec_id, 2 as parts, 'g' || vec_id // 6 || '-old' as song_key, (vec_id % 6) * 32 as first_offset, (vec_id % 6) * 32 + 20 as second_offset, 20 as first_frames, 12 as second_frames
from embeddings where vec_id % 5 <> 0 and vec_id % 7 <> 0 and vec_id % 11 <> 0 and vec_id % 13 <> 0
""")
def song_cache_hits(spark, d):
    """JN14, with JN1, WN4, AG19, JN4 and JN5: blocks as windows of two islands, sought in songs of six blocks.

    The last accessed song of each name has another sound, so the one before it answers. An unknown name, a changed sound, a
    piece without a name or one without progress makes the whole window a miss.
    """
    n = F.col("vec_id")
    b = blocks(spark, d).withColumn("grp", F.floor(n / 6)).withColumn("stream_start_frame", (n * 32).cast("long"))
    sound = timeline.ordered_concat(b.select("grp", "vec_id", "pcm", F.lit(32).alias("frame_count")), ["grp"], "vec_id")
    songs = sound.select(F.concat(F.lit("song "), F.col("grp").cast("string")).alias("title"), F.lit("a").alias("artist"), F.lit("").alias("album"), F.explode(F.array(
        F.struct(F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit("-old")).alias("song_key"), F.lit(1).alias("accessed_at"), F.col("pcm").alias("song_pcm")),
        F.struct(F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit("-new")).alias("song_key"), F.lit(2).alias("accessed_at"), F.reverse("pcm").alias("song_pcm")))).alias("s")).select("title", "artist", "album", "s.*")

    def anchor(revision: int, at: int, title: Column, artist: Column, progress: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(
            F.lit(revision).cast("long").alias("revision"), zero.alias("metadata_revision"), progress.alias("has_progress"), zero.alias("start_rtp"), zero.alias("current_rtp"), zero.alias("end_rtp"), (F.col("stream_start_frame") + at).alias("anchor_stream_frame"),
            ((n % 6) * 32 + at).cast("long").alias("track_position_frame"), F.lit(10_000).cast("long").alias("track_duration_frame"), title.alias("title"), artist.alias("artist"), F.lit("").alias("album"))

    own = F.concat(F.lit("song "), F.col("grp").cast("string"))
    second = F.when(n % 5 == 0, "nobody").when(n % 11 == 0, " ").otherwise(own)
    anchors = F.array(anchor(1, 0, own, F.lit("a"), F.lit(True)), anchor(2, 20, second, F.when(n % 11 == 0, "").otherwise("a"), n % 13 != 0))
    pcm = F.when(n % 7 == 0, F.concat(F.slice("pcm", 1, 40), F.transform(F.slice("pcm", 41, 24), lambda v: numeric.pcm16(v * -1.0)))).otherwise(F.col("pcm"))
    windows = b.select("vec_id", "stream_start_frame", anchors.alias("anchors"), pcm.alias("pcm"))
    pieces = timeline.segments(windows, ["vec_id"], F.lit(0), F.lit(32))
    hits = cache.song_hits(pieces, windows, songs, ["vec_id"], F.lit(0), F.lit(32), F.lit(64))
    of = lambda i, c: F.get("parts", F.lit(i))[c]
    return hits.select("vec_id", F.size("parts").cast("long").alias("parts"), of(0, "song_key").alias("song_key"), of(0, "offset").alias("first_offset"), of(1, "offset").alias("second_offset"), of(0, "frame_count").alias("first_frames"), of(1, "frame_count").alias("second_frames"))


# --- the present state

_NAMES = "['controller', 'heartbeat', 'receiver', 'capture', 'inbox', 'gpu', 'playback', 'manifest', 'lyrics', 'acceptance']"


@query(f"""
with e as (select event_id, ts, {_NAMES}[event_id % 10 + 1] as source, ['capturing', 'streaming', 'playing', 'ready'][event_id // 10 % 4 + 1] as state from events),
l as (select source, arg_max(event_id, (ts, event_id)) as id, arg_max(state, (ts, event_id)) as state, max(ts) as seen from e group by source),
p as (select max(case when source = 'controller' then state end) as controller, max(case when source = 'controller' then id end) as controller_id, max(case when source = 'receiver' then id end) as receiver, max(case when source = 'capture' then id end) as capture, max(case when source = 'inbox' then id end) as inbox,
  max(case when source = 'gpu' then id end) as gpu, max(case when source = 'gpu' then state end) as model, max(case when source = 'playback' then id end) as playback, max(case when source = 'playback' then state end) as playing, max(case when source = 'manifest' then id end) as manifest,
  max(case when source = 'heartbeat' then seen end) as beat, max(case when source = 'capture' then state end) as capturing, max(case when source = 'receiver' then state end) as receiving from l),
i as (select *, case when controller = 'capturing' then capture else receiver end as input, case when controller = 'capturing' then capturing = 'capturing' else receiving = 'streaming' end as raw from p)
select controller as controller_state, controller = 'capturing' as controller_stalled, false as streaming, raw as stream_stalled, case when controller = 'capturing' then 'windows' else 'airplay' end as input_source,
  'title ' || input as track_title, input % 9 as track_revision, least(1.0::double, (input % 300) / 100.0::double) as peak_left, inbox as captured_sequence, gpu - 3 as gpu_sequence, playback as playback_sequence, playing as playback_state, greatest(0, inbox - (gpu - 3)) as pending_windows,
  case when playing = 'playing' and playback > 0 then greatest(0, gpu - 3 - playback + 1) else greatest(0, gpu - 3) end as ready_windows, case when playing = 'playing' and playback > 0 then greatest(0, gpu - 3 - playback + 1) else greatest(0, gpu - 3) end * 3.0::double as ready_buffer_seconds,
  gpu % 50 as cache_hits, 0 as underruns, case when model = 'ready' then 'ready' else 'error' end as model_state, 3.0::double as hop_seconds, (manifest % 7)::double as processing_seconds, manifest % 7 <= 3 as sustainable, 'none' as cache_scope, 'waiting' as lyrics_state, 'not_running' as acceptance_state,
  round((epoch_us(timestamp '2024-03-01') - epoch_us(beat)) / 1e6::double, 3) as controller_heartbeat_age_seconds
from i
""")
def pipeline_snapshot(spark, d):
    """PJ1, JN11, FL11, SF23, SF27, SC8: one row out of the last status document of each source."""
    n = F.col("event_id")
    names, states = (F.array(*[F.lit(x) for x in xs]) for xs in (telemetry.DOCUMENTS, ("capturing", "streaming", "playing", "ready")))
    state = F.get(states, (F.floor(n / 10) % 4).cast("int"))
    s = lambda c: c.cast("string")
    title = F.concat(F.lit('"track":{"title":" title '), s(n), F.lit(' ","revision":"'), s(n % 9), F.lit('"}'))
    payload = F.concat(
        F.lit('{"state":"'), state, F.lit('","model_state":"'), state, F.lit('","sequence":'), s(n), F.lit(',"last_sequence":'), s(n - 3), F.lit(',"cache_hits":'), s(n % 50), F.lit(',"underruns":-2,"hop_seconds":3,"processing_seconds":'), s(n % 7),
        F.lit(',"cache_hit":false,"peak_left":'), s((n % 300) / 100), F.lit(","), title, F.lit("}"))
    # the event's number leads the payload, so that the latest of one time is the largest
    status = table(spark, d, "events").select(F.get(names, (n % 10).cast("int")).alias("source"), F.col("ts").alias("observed_at"), n, payload.alias("payload"))
    status = telemetry.latest(status, ["source"], "observed_at", ["event_id", "payload"]).drop("event_id")
    out = telemetry.snapshot(status, F.lit("2024-03-01").cast("timestamp"))
    return out.select(
        "controller_state", "controller_stalled", "streaming", "stream_stalled", "input_source", "track_title", "track_revision", "peak_left", "captured_sequence", "gpu_sequence", "playback_sequence", "playback_state", "pending_windows", "ready_windows", "ready_buffer_seconds", "cache_hits", "underruns",
        "model_state", "hop_seconds", "processing_seconds", "sustainable", "cache_scope", "lyrics_state", "acceptance_state", "controller_heartbeat_age_seconds")


# --- state machines


@query(f"""
with recursive {NUMBERED},
e as (select user_id, frame, case event_type when 'signup' then 'start' when 'view' then 'running' when 'click' then 'progress' when 'error' then 'fail' else 'stop' end as event from numbered),
r as (
  select user_id, frame, event, case when event = 'start' then 'warming' else 'stopped' end as state, event not in ('start', 'stop') as refused from e where frame = 0
  union all
  select user_id, frame, event, case when ok then case event when 'start' then 'warming' when 'fail' then 'error' when 'stop' then 'stopped' else 'running' end else state end, not ok
  from (select e.*, r.state, case e.event when 'start' then r.state = 'stopped' when 'running' then r.state = 'warming' when 'progress' then r.state = 'running' when 'fail' then r.state <> 'stopped' else true end as ok
    from r join e on e.user_id = r.user_id and e.frame = r.frame + 1))
select user_id, event, state, refused, count(*) as n from r group by all
""")
def session_states(spark, d):
    """ST12: what a session's events lead to, and which the state refuses."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "start").when(kind == "view", "running").when(kind == "click", "progress").when(kind == "error", "fail").otherwise("stop")
    out = run.replay(numbered_events(spark, d).select("user_id", "frame", event.alias("event")), "user_id", "frame", machines.Session, machines.Session.OUT)
    return out.groupBy("user_id", "event", "state", "refused").agg(F.count("*").alias("n"))


_RING = f"""
with recursive {NUMBERED},
e as (select user_id, frame, case when event_type = 'view' then 'pop' else 'push' end as op, event_id % 7 + 1 as n from numbered),
r as (
  select user_id, frame, op, case when op = 'push' then 'accepted' else 'prebuffering' end as result, case when op = 'push' then n else 0 end as buffered, case when op = 'push' then n else 0 end as total_written, 0::bigint as total_read, 0::bigint as underruns, null::bigint as minimum_buffered, false as playing
  from e where frame = 0
  union all
  select user_id, frame, op, result, buffered, total_written, total_read, underruns, case when op = 'pop' and result <> 'prebuffering' and total_read > 0 then least(coalesce(least_before, buffered), buffered) else least_before end, playing from (
    select user_id, frame, op, result, minimum_buffered as least_before,
      buffered + case result when 'accepted' then n when 'audio' then -n else 0 end as buffered, total_written + case when result = 'accepted' then n else 0 end as total_written, total_read + case when result = 'audio' then n else 0 end as total_read,
      underruns + (result = 'underrun')::bigint as underruns, case when result = 'audio' then true when result = 'underrun' then false else playing end as playing
    from (select e.user_id, e.frame, e.op, e.n, r.buffered, r.total_written, r.total_read, r.underruns, r.minimum_buffered, r.playing,
        case when e.op = 'push' then case when e.n > 40 - r.buffered then 'full' else 'accepted' end when not r.playing and r.buffered < greatest(10, e.n) then 'prebuffering' when r.buffered >= e.n then 'audio' else 'underrun' end as result
      from r join e on e.user_id = r.user_id and e.frame = r.frame + 1) x) y)
"""


@query(_RING + "select user_id, frame, op, result, buffered, total_written, total_read, underruns, minimum_buffered from r")
def ring_buffer(spark, d):
    """ST8, AG16: pushes and pops of each user's buffer by frame counts."""
    e = numbered_events(spark, d).select("user_id", "frame", F.when(F.col("event_type") == "view", "pop").otherwise("push").alias("op"), (F.col("event_id") % 7 + 1).alias("frames"))
    return run.replay(e, "user_id", "frame", lambda: machines.Ring(40, 10), machines.Ring.OUT).select("user_id", "frame", "op", "result", "buffered", "total_written", "total_read", "underruns", "minimum_buffered")


@query(_RING + """,
took as (select user_id, frame, n, total_written - n as a from r join e using (user_id, frame) where r.op = 'push' and result = 'accepted'),
stream as (select user_id, flatten(list(list_transform(range(0, n), lambda i: frame * 3 + i) order by frame)) as v from took group by user_id),
pops as (select r.user_id, r.frame, result, n, total_read - n as a from r join e using (user_id, frame) where r.op = 'pop'),
x as (select pops.*, case when result = 'audio' then v[a + 1 : a + n] else list_transform(range(0, n), lambda i: 0) end as pcm from pops left join stream using (user_id))
select user_id, frame, 'drums' as stem, result, len(pcm) as frames, pcm[1]::int as first_sample, list_sum(pcm)::bigint as total from x
union all select user_id, frame, 'vocals', result, len(pcm), -pcm[1]::int, -list_sum(pcm)::bigint from x
""")
def ring_audio(spark, d):
    """ST8 with sound: what each pop gives of the stems that were pushed, or silence."""
    e = numbered_events(spark, d).select("user_id", "frame", F.when(F.col("event_type") == "view", "pop").otherwise("push").alias("op"), (F.col("event_id") % 7 + 1).alias("frames"))
    steps = run.replay(e, "user_id", "frame", lambda: machines.Ring(40, 10), machines.Ring.OUT)
    pcm = F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda i: (F.col("frame") * 3 + i).cast("smallint"))
    stems = F.explode(F.map_from_arrays(F.array(F.lit("drums"), F.lit("vocals")), F.array(pcm, F.transform(pcm, lambda v: (-v).cast("smallint")))))
    pushes = e.where("op = 'push'").select("user_id", "frame", stems.alias("stem", "pcm"))
    out = framing.ring_audio(steps, pushes, ["user_id"], ["drums", "vocals"], 16, channels=1)
    return out.select("user_id", "frame", "stem", "result", F.size("pcm").cast("long").alias("frames"), F.get("pcm", F.lit(0)).cast("int").alias("first_sample"), F.aggregate("pcm", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(f"""
with {NUMBERED}, e as (select user_id, frame + 1 as sequence, case when event_id % 23 = 0 then 'waiting' when event_id % 5 = 0 then 'skipped' else 'ready' end as state from numbered),
s as (select *, lag(state) over w as before, bool_or(state = 'waiting') over (partition by user_id order by sequence) as stalled from e window w as (partition by user_id order by sequence))
select user_id, sequence, case when state = 'skipped' then 'skip' else 'push' end as action, coalesce(before = 'skipped', true) as stitch_reset from s where not stalled
""")
def loader_steps(spark, d):
    """ST9: sequences in turn; a waiting one holds up those after it, a skipped one starts stitching anew."""
    n = F.col("event_id")
    e = numbered_events(spark, d).select("user_id", (F.col("frame") + 1).alias("sequence"), F.when(n % 23 == 0, "waiting").when(n % 5 == 0, "skipped").otherwise("ready").alias("state"))
    return run.replay(e, "user_id", "sequence", machines.Loader, machines.Loader.OUT)


@query(f"""
with recursive {NUMBERED},
e as (select user_id, frame, frame * 25.0::double as at_s, frame // 5 as revision, case when event_type <> 'error' then 'k' || frame // 8 end as track_key, case when event_id % 3 = 0 then 'error' else 'found' end as outcome from numbered),
r as (
  select user_id, frame, track_key is not null as looked, case when track_key is not null then revision end as rev, track_key as k, case when track_key is not null then outcome end as res, at_s as since from e where frame = 0
  union all
  select user_id, frame, looked, case when track_key is null then null when looked then revision else rev end, case when track_key is null then null when looked then track_key else k end, case when track_key is null then null when looked then outcome else res end, case when looked then at_s else since end
  from (select e.*, r.rev, r.k, r.res, r.since, e.track_key is not null and (e.track_key is distinct from r.k or e.revision is distinct from r.rev or (r.res = 'error' and e.at_s - r.since >= 60)) as looked from r join e on e.user_id = r.user_id and e.frame = r.frame + 1))
select r.user_id, e.at_s, e.track_key, e.outcome from r join e on e.user_id = r.user_id and e.frame = r.frame where r.looked
""")
def lyric_lookups(spark, d):
    """ST16: one lookup for each revision and track, errors again after 60 s."""
    f = F.col("frame")
    e = numbered_events(spark, d).select("user_id", "frame", (f * 25.0).alias("at_s"), F.floor(f / 5).alias("revision"), F.when(F.col("event_type") != "error", F.concat(F.lit("k"), F.floor(f / 8).cast("string"))).alias("track_key"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("found").alias("outcome"))
    return run.replay(e, "user_id", "frame", machines.LyricLookups, machines.LyricLookups.OUT)


@query("""
with e as (select time_bucket(interval 3 hours, ts) as slot, value from events), w as (select slot - interval 3 hours * unnest(range(0, 4)) as start, value from e)
select start, start + interval 12 hours as "end", count(*) as n, max(value) as high from w where start + interval 12 hours <= (select max(ts) from events) - interval 1 hour group by start
""")
def stream_windows(spark, d):
    """ST1 with event-time windows: the closed 12-hour windows of the events, read as a stream."""
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)
    out = run.complete_windows(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", [], "12 hours", "3 hours", "1 hour", [F.count("*").alias("n"), F.max("value").alias("high")])
    found = run.collected(out.select("window.start", "window.end", "n", "high"), "stream_windows")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "high")


def assembled(spark, d) -> DataFrame:
    """Songs of two stems put together from consecutive windows; each label's vectors are one stream of hops of 24 frames, with 8 that overlap."""
    b = blocks(spark, d)
    w = Window.partitionBy("label").orderBy("vec_id")
    s = b.withColumn("sequence", F.row_number().over(w)).withColumn("stream_start_frame", (F.col("sequence") - 1) * 24)
    n = lambda v, t="long": F.lit(v).cast(t)
    song = F.floor((F.col("sequence") - 1) / 4)
    anchor = F.struct(
        (song + 1).cast("long").alias("revision"), n(1).alias("metadata_revision"), F.lit(True).alias("has_progress"), song.cast("long").alias("start_rtp"), n(0).alias("current_rtp"), n(96).alias("end_rtp"), (song * 96).cast("long").alias("anchor_stream_frame"),
        n(0).alias("track_position_frame"), n(96).alias("track_duration_frame"), F.concat(F.lit("song "), song.cast("string")).alias("title"), F.lit("a").alias("artist"), F.lit("b").alias("album"))
    half = F.transform("pcm", lambda v: F.floor(v / 2).cast("smallint"))
    events = s.select("label", "sequence", "stream_start_frame", signal.stacked([F.col("pcm"), half]).alias("pcm"), F.array(anchor).alias("anchors"))
    return run.replay(events, "label", "sequence", lambda: machines.Assembly(10, 24, 8, channels=4), machines.Assembly.OUT)


@query(f"""
with {PCM}, b as (select label, vec_id, 0 as stem, pcm from blocks union all select label, vec_id, 1, list_transform(pcm, lambda x: floor(x / 2.0)::int) from blocks),
o as (select label, stem, pcm, row_number() over w - 1 as seq, lag(pcm) over w as prev from b window w as (partition by label, stem order by vec_id)),
x as (select label, stem, seq, unnest(range(0, 48)) as i, pcm, prev from o), v as (select label, stem, seq, i, case when prev is null or i >= 16 then pcm[i + 1] else round(prev[48 + i + 1] + (pcm[i + 1] - prev[48 + i + 1]) * ((i // 2) / 7.0::double))::int end as v from x)
select label, 0 as epoch, seq // 4 as start_rtp, seq // 4 + 1 as revision, 'song ' || seq // 4 as title, 96 as duration_frames, 0 as first_track_start_frame, 96 as frame_count, 0 as recoveries, 0 as misses, null::varchar as reason, sum(v * ((seq % 4) * 48 + i + 1)) filter (stem = 0)::bigint as weighted, sum(v * ((seq % 4) * 48 + i + 1)) filter (stem = 1)::bigint as half_weighted
from v group by label, seq // 4 having count(*) = 384
""")
def song_assembly(spark, d):
    """ST4, ST5, ST3: whole songs out of stitched hops of two stems, each stem's samples summed by place."""

    def weighted(number: int) -> Column:
        places = F.transform(signal.unstacked(F.col("pcm"), 2, number), lambda v, i: v.cast("long") * (i + 1))
        return F.when(F.col("pcm").isNotNull(), F.aggregate(places, F.lit(0).cast("long"), lambda s, v: s + v))

    return assembled(spark, d).select("label", "epoch", "start_rtp", "revision", "title", "duration_frames", "first_track_start_frame", "frame_count", "recoveries", "misses", "reason", weighted(0).alias("weighted"), weighted(1).alias("half_weighted"))


#: Frames of a vector's block, of an envelope's block, of a probe, of its segment, and of the search to either side.
BLOCK, ENVELOPE, PROBE, SEGMENT, RADIUS = 32, 8, 128, 32, 300


@query(f"""
with {PCM}, b as (select label as song, row_number() over (partition by label order by vec_id) - 1 as block, vec_id, pcm from blocks),
f as (select song, block * {BLOCK} + i as frame, pcm[2 * i + 1] as l, pcm[2 * i + 2] as r from (select *, unnest(range(0, {BLOCK})) as i from b)),
m as (select song, max(frame) + 1 as frames from f group by song),
p0 as (select vec_id as id, song, block * {BLOCK} + {ENVELOPE} * (vec_id % 4) as truth, frames, case when vec_id % 5 = 0 then 0.5 else 0.95 end as scale, vec_id % 7 = 0 as wild from b join m using (song)),
p as (select *, greatest(0, truth - 40 + vec_off) as approx from (select *, id % 90 as vec_off from p0) where truth + {PROBE} <= frames),
v as (select p.id, k, round(l * scale + (case when wild then (k * 7919 + p.id * 31) % 20011 - 10005 else (k * 13 + p.id) % 9 - 4 end))::int as l, round(r * scale + (case when wild then (k * 7907 + p.id * 37) % 20011 - 10005 else (k * 11 + p.id) % 9 - 4 end))::int as r
  from (select p.*, unnest(range(0, {PROBE})) as k from p) p join f on f.song = p.song and f.frame = truth + k),
c as (select id, greatest(-32768, least(32767, l)) as l, greatest(-32768, least(32767, r)) as r, k from v),
s as (select id, (sum(r::double * r) > sum(l::double * l)) as right_side from c group by id),
x as (select id, k, case when right_side then r else l end::double as x, k // {SEGMENT} as seg from c join s using (id)),
g as (select id, arg_max(seg, (e, -seg)) as seg from (select id, seg, sum(x * x) as e from x group by all) group by id),
y as (select x.id, k, x from x join g using (id, seg)),
o as (select p.id, p.song, p.approx, unnest(range(greatest(0, approx - {RADIUS}), least(frames - {PROBE}, approx + {RADIUS}) + 1)) as off from p),
r as (select o.id, off, approx, corr(y.x, case when right_side then f.r else f.l end) as correlation, regr_slope(y.x, case when right_side then f.r else f.l end::double) as gain
  from o join y on y.id = o.id join s on s.id = o.id join f on f.song = o.song and f.frame = off + y.k group by all),
t as (select id, arg_max(off, (round(correlation, 9), -abs(off - approx), -off)) as off, max(correlation) as correlation, arg_max(gain, (round(correlation, 9), -abs(off - approx), -off)) as gain from r group by id)
select id, case when correlation >= 0.985 and gain between 0.9 and 1.1 then off else -1 end as found, case when correlation >= 0.985 then round(correlation, 6) else 0 end as correlation from t
""")
def noisy_probes(spark, d):
    """JN5, WN11: probes that are quieter and noisy are found where a search of every place finds them; some are too quiet or all noise."""
    w = Window.partitionBy("label").orderBy("vec_id")
    b = blocks(spark, d).select("vec_id", F.col("label").alias("song"), (F.row_number().over(w) - 1).cast("long").alias("block"), "pcm")
    track = alignment.channels(b)
    n, truth = F.col("vec_id"), F.col("block") * BLOCK + ENVELOPE * (F.col("vec_id") % 4)
    wanted = b.select(n.alias("id"), "song", F.lit(0).alias("channel"), truth.alias("start"), F.lit(PROBE).alias("count"))
    sound = [alignment.excerpts(track, wanted.withColumn("channel", F.lit(c)), BLOCK).select("id", "song", "start", F.col("found").alias(f"side{c}")) for c in (0, 1)]
    p = sound[0].join(sound[1].select("id", "side1"), "id").where(F.size("side0") == PROBE)
    scale, i = F.when(F.col("id") % 5 == 0, 0.5).otherwise(0.95), F.col("id")

    def played(side: str, far: int, near: int, turn: int):
        noise = lambda k: F.when(i % 7 == 0, (k * far + i * turn) % 20011 - 10005).otherwise((k * near + i) % 9 - 4)
        return F.transform(side, lambda v, k: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(v * scale + noise(k)).cast("int"))))

    both = F.flatten(F.zip_with(played("side0", 7919, 13, 31), played("side1", 7907, 11, 37), lambda x, y: F.array(x, y)))
    probes = p.select("id", "song", both.alias("pcm"), F.greatest(F.lit(0), F.col("start") - 40 + i % 90).alias("approx"))
    found = alignment.aligned(track, probes, BLOCK, RADIUS, ENVELOPE, SEGMENT)
    return found.select("id", F.coalesce("offset", F.lit(-1)).alias("found"), F.when(F.col("correlation") >= 0.985, F.round("correlation", 6)).otherwise(0.0).alias("correlation"))
