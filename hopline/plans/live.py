"""Streams with state and timers, read to their end; each gives the rows of its batch form, which the SQL says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.operators import telemetry
from hopline.plans.bindings import ACCEPTANCE, ACCEPTANCE_REPORT, NUMBERED, numbered_events, session_samples
from hopline.plans.registry import query
from hopline.streaming import keyed, run

HOUR = 3_600_000
ACCEPTANCE_SINCE_START = ACCEPTANCE.replace("with t as", """
with started as (select user_id, max(event_id) as began from events where event_type = 'signup' group by user_id),
samples as (select e.* from events e left join started using (user_id) where event_type not in ('signup', 'error') and event_id > coalesce(began, -1)),
t as""").replace("from events)", "from samples)") + ACCEPTANCE_REPORT


def _event_stream(spark, d) -> DataFrame:
    """The events as a stream, with ``at`` and at_ms; the watermark follows by an hour."""
    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)
    return e.withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 hour")


def _gathered(stream: DataFrame, name: str) -> DataFrame:
    with keyed.state_store(stream.sparkSession):
        return run.collected(stream, name)


def looked_up(revision: int, track_key: str, attempt: int) -> str:
    """A stand-in for the lyric service: a track's first lookups fail, more of them for some tracks than for others."""
    return "found" if attempt >= revision % 4 else "error"


@query(f"""
with e as (select user_id, event_id, epoch_us(ts) // 1000 as at_ms, event_id // 40 as revision, case when event_type <> 'error' then event_type end as track_key from events),
m as (select *, case when track_key is not null then revision || ':' || track_key end as k from e),
b as (select *, (lag(event_id) over w is null or k is distinct from lag(k) over w)::int as fresh from m window w as (partition by user_id order by at_ms, event_id)),
g as (select *, sum(fresh) over (partition by user_id order by at_ms, event_id rows unbounded preceding) as island from b),
i as (select user_id, island, revision, track_key, min(at_ms) as start from g group by all),
n as (select *, lead(start) over (partition by user_id order by start) as next, (select max(epoch_us(ts) // 1000) - {HOUR} from events) as watermark from i),
a as (select *, unnest(range(0, revision % 4 + 1)) as attempt from n where track_key is not null)
select user_id, start + attempt * {6 * HOUR} as at_ms, revision, track_key, attempt::int as attempt, case when attempt >= revision % 4 then 'found' else 'error' end as outcome
from a where attempt = 0 or start + attempt * {6 * HOUR} < coalesce(next, watermark + 1)
""")
def lyric_retries(spark, d):
    """ST16 with timers: failed lookups come again every six hours while the track stays, also where no event follows."""
    track = F.when(F.col("event_type") != "error", F.col("event_type"))
    e = _event_stream(spark, d).select("user_id", "event_id", "at", "at_ms", F.floor(F.col("event_id") / 40).alias("revision"), track.alias("track_key"))
    lookups = keyed.Lookups(["user_id"], looked_up, 6 * HOUR, order=("at_ms", "event_id"))
    return _gathered(lookups.on(e, time="EventTime"), "lyric_retries")


@query(f"""
with e as (select user_id, epoch_us(ts) // 1000 as at_ms, case when user_id % 2 = 0 then {2 * HOUR} else {6 * HOUR} end as limit_ms from events),
n as (select *, lead(at_ms) over (partition by user_id order by at_ms) as next, (select max(at_ms) - {HOUR} from e) as watermark from e)
select user_id, at_ms as last_ms, at_ms + limit_ms as stale_ms from n where coalesce(next, watermark) - at_ms > limit_ms
""")
def silent_sources(spark, d):
    """FL11 with timers: sources that were silent for more than two hours (streams) or six (controllers)."""
    limit = F.when(F.col("user_id") % 2 == 0, 2 * HOUR).otherwise(6 * HOUR).cast("long")
    e = _event_stream(spark, d).select("user_id", "at", "at_ms", limit.alias("limit_ms"))
    return _gathered(keyed.Silence(["user_id"]).on(e, time="EventTime"), "silent_sources")


@query(f"""
with {NUMBERED}, lost as (select user_id, min(frame) as hole from numbered where event_id % 41 = 0 group by user_id)
select user_id, frame as sequence, false as gap, event_id, value from numbered left join lost using (user_id) where frame < coalesce(hole, frame + 1)
""")
def ordered_release(spark, d):
    """ST1, SC3: numbered windows that arrive in any order, some twice, some never, come out in order up to the first hole."""
    e = numbered_events(spark, d).where("event_id % 41 <> 0").select("user_id", F.col("frame").cast("long").alias("sequence"), "event_id", "value")
    arrived = e.unionByName(e.where("event_id % 5 = 0")).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    at = run.in_parts(arrived, "arrivals", 3, F.col("part"))
    stream = run.files(spark, at, "user_id long, sequence long, event_id long, value double", at_once=8)
    order = keyed.InOrder(["user_id"], "event_id long, value double", first=0)
    return _gathered(order.on(stream), "ordered_release")


@query(ACCEPTANCE_SINCE_START)
def acceptance_stream(spark, d):
    """ST15: a session's requirements since it was last started, kept up to date from samples and commands of one stream."""
    command = F.when(F.col("track_title") == "signup", "start").when(F.col("track_title") == "error", "mixer")
    rows = session_samples(spark, d).withColumns({"at_ms": F.col("observed_at_ns"), "action": command})
    last = rows.agg(F.max("at_ms")).first()[0] or 0
    at = run.in_parts(rows, "samples", 3, F.floor(F.col("at_ms") * 3 / (last + 1)))
    stream = run.files(spark, at, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), at_once=8)
    found = keyed.upserted(keyed.Recorder(["user_id"]).on(stream, "update"), ["user_id"], "acceptance")
    r = telemetry.requirements(found.where("samples > 0"))
    return r.select("user_id", "samples", "streaming_samples", "active_samples", "maximum_pending_windows", "minimum_active_buffer_seconds", "active_mixer_updates_delta", "max_latency_ms", "stream_received", "song_cache_replayed", *telemetry.ZERO, "mixer_latency_below_limit", "state")


@query(f"""
with {NUMBERED},
e as (select user_id, frame, frame * 20000 as sf, event_type in ('view', 'click') as progress, ['title', 'artist', 'album'][event_id % 3 + 1] as field, 'v' || (event_id % 11) as value, 100000 * (frame // 6) as start, event_id % 50000 as cur from numbered),
s as (select *, {", ".join(f"coalesce(last_value(case when not progress and field = '{c}' then value end ignore nulls) over w, '') as {c}, coalesce(last_value(case when not progress and field = '{c}' then value end ignore nulls) over p, '') as {c}0" for c in ("title", "artist", "album"))},
  last_value(case when progress then sf end ignore nulls) over w as last_sf, last_value(case when progress then cur end ignore nulls) over w as last_cur, last_value(case when progress then start end ignore nulls) over p as start0
  from e window w as (partition by user_id order by frame rows unbounded preceding), p as (partition by user_id order by frame rows between unbounded preceding and 1 preceding)),
c as (select *, not progress and (title <> title0 or artist <> artist0 or album <> album0) as changed, progress and start is distinct from start0 as new from s),
r as (select *, sum(new::int) over w as revision, sum(changed::int) over w as metadata_revision, sum(progress::int) over w as number,
  changed and (sf = 0 or (last_sf is not null and least(last_cur + greatest(0, sf - last_sf), 1000000) <= 88200)) as early from c window w as (partition by user_id order by frame rows unbounded preceding)),
l as (select user_id, revision, max(frame) as frame0, arg_max(title, frame) as title1, arg_max(artist, frame) as artist1, arg_max(album, frame) as album1, arg_max(metadata_revision, frame) as metadata1 from r where early group by all)
select r.user_id, number::bigint as number, r.revision::bigint as revision, (case when frame0 > frame then metadata1 else metadata_revision end)::bigint as metadata_revision, start::bigint as start_rtp, sf::bigint as anchor_stream_frame,
  {", ".join(f"case when frame0 > frame then {c}1 else {c} end as {c}" for c in ("title", "artist", "album"))}
from r left join l using (user_id, revision) where progress
""")
def anchor_backfill(spark, d):
    """ST11, TK7: the anchors of each session as late metadata leaves them, from a stream in update mode and an upsert."""
    f, n = F.col("frame"), F.col("event_id")
    start = 100_000 * F.floor(f / 6)
    e = numbered_events(spark, d).select(
        "user_id", (f * 20_000).cast("long").alias("stream_frame"), F.when(F.col("event_type").isin("view", "click"), "progress").otherwise("metadata").alias("kind"), F.element_at(F.array(F.lit("title"), F.lit("artist"), F.lit("album")), (n % 3 + 1).cast("int")).alias("field"),
        F.concat(F.lit("v"), (n % 11).cast("string")).alias("value"), start.cast("long").alias("start_rtp"), (start + n % 50_000).cast("long").alias("current_rtp"), (start + 1_000_000).cast("long").alias("end_rtp"))
    at = run.in_parts(e, "progress", 3, F.least(F.floor(F.col("stream_frame") / 400_000), F.lit(2)))
    stream = run.files(spark, at, ", ".join(f"{c} {t}" for c, t in e.dtypes), at_once=8)
    found = keyed.upserted(keyed.Anchors(["user_id"]).on(stream, "update"), ["user_id", "number"], "anchors")
    return found.select("user_id", "number", "revision", "metadata_revision", "start_rtp", "anchor_stream_frame", "title", "artist", "album")
