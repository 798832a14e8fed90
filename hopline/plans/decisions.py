"""Queries of predicates, ladders, snapshots and selections: what is decided from events, processes and status documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hopline.functions import numeric, rules, text
from hopline.operators import cache, joins, lyrics, signal, telemetry, timeline
from hopline.plans.bindings import NUMBERED, PCM, blocks, numbered_events
from hopline.plans.registry import query
from hopline.sources.tables import table
from hopline.streaming import run

# --- predicates


@query("""
select event_id, event_id % 16 >= 8 and (event_id % 16) % (event_id % 5 + 1) = 0 and event_id % 3 > 0 and event_id % 3 <= event_id % 5 + 1 and event_id % 4 + event_id % 5 + 1 + event_id % 3 <= event_id % 16 and event_id % 7 <> 0 as valid from events
""")
def geometry_rules(spark, d):
    """FL3: which window geometries hold together."""
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", rules.valid_geometry(n % 16, n % 5 + 1, n % 4, n % 3, F.when(n % 7 == 0, 1).otherwise(2)).alias("valid"))


@query(r"""
with t as (select event_id, case event_id % 6 when 0 then '10.0.' || event_id % 300 || '.7:' || event_id % 70000 when 1 then '192.168.1.01:80' when 2 then '1.2.3:80' when 3 then '8.8.4.4:0' || event_id % 9 when 4 then '255.255.255.255:' || (event_id % 70000 + 1) else '0.0.0.0:99999' end as t from events)
select event_id, case when event_id % 6 = 0 and event_id % 300 <= 255 and event_id % 70000 between 1 and 65535 or event_id % 6 = 4 and event_id % 70000 + 1 <= 65535 then split_part(t, ':', 1) end as host,
  case when event_id % 6 = 0 and event_id % 300 <= 255 and event_id % 70000 between 1 and 65535 or event_id % 6 = 4 and event_id % 70000 + 1 <= 65535 then split_part(t, ':', 2)::int end as port from t
""")
def device_endpoints(spark, d):
    """FL7: IPv4 and port without leading zeros, in their ranges."""
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    given = F.when(n % 6 == 0, F.concat(F.lit("10.0."), s(n % 300), F.lit(".7:"), s(n % 70000))).when(n % 6 == 1, "192.168.1.01:80").when(n % 6 == 2, "1.2.3:80").when(n % 6 == 3, F.concat(F.lit("8.8.4.4:0"), s(n % 9))).when(n % 6 == 4, F.concat(F.lit("255.255.255.255:"), s(n % 70000 + 1))).otherwise("0.0.0.0:99999")
    return table(spark, d, "events").select("event_id", rules.endpoint(given).alias("e")).select("event_id", "e.host", "e.port")


@query(f"""
with {PCM} select vec_id, vec_id % 9 <> 0 and list_max(list_transform(pcm, lambda x: abs(x))) / 32768.0::double > 1e-4 as audible from blocks
""")
def audible_windows(spark, d):
    """FL9, AG1: windows with a peak above the threshold; each ninth is silenced."""
    pcm = F.when(F.col("vec_id") % 9 == 0, F.transform("pcm", lambda v: (v * 0).cast("smallint"))).otherwise(F.col("pcm"))
    return blocks(spark, d).select("vec_id", signal.levels(pcm, 8).alias("m")).select("vec_id", rules.audible(F.col("m.peak_left"), F.col("m.peak_right")).alias("audible"))


@query("""
with l as (select user_id, event_type, max(ts) as seen from events group by all), a as (select *, max(seen) over (partition by user_id) as now from l)
select user_id, event_type, round((epoch_us(now) - epoch_us(seen)) / 1e6::double, 6) as age, (epoch_us(now) - epoch_us(seen)) / 1e6::double > case when event_type = 'signup' then 6.0 else 2.0 end as stale from a
""")
def stale_sources(spark, d):
    """FL11, SF9, SC8: ages of a user's sources at the last of them, and which are too old."""
    l = telemetry.latest(table(spark, d, "events").withColumnRenamed("ts", "at"), ["user_id", "event_type"], "at", ["event_id"])
    l = l.withColumn("now", F.max("at").over(Window.partitionBy("user_id")))
    kind = F.when(F.col("event_type") == "signup", "controller").otherwise("stream")
    return l.select("user_id", "event_type", F.round(rules.age_seconds(F.col("now"), F.col("at")), 6).alias("age"), rules.stale(rules.age_seconds(F.col("now"), F.col("at")), kind).alias("stale"))


@query("""
select event_id, make_timestamp(1704067200000000 + event_id * 1234567) as of_ns, case when event_id % 4 <> 0 then make_timestamp(1704067200000000 + (event_id % 86400) * 1000000) end as beat from events
""")
def heartbeat_times(spark, d):
    """SF9: timestamps of nanoseconds and of ISO 8601 texts, null for others."""
    n = F.col("event_id")
    iso = F.when(n % 4 == 0, "soon").otherwise(F.concat(F.date_format(F.timestamp_micros(F.lit(1704067200000000) + (n % 86400) * 1000000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    out = table(spark, d, "events").select("event_id", rules.of_epoch_ns(F.lit(1704067200000000000) + n * 1234567000 + 999).alias("of_ns"), rules.heartbeat(iso).alias("beat"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("of_ns", "beat")})


@query("""
select event_id, event_type in ('view', 'click') and event_id % 7 <> 0 and event_id % 5 <> 0 and value * 2000 > 0 and value * 2000 < 86400 as wanted from events
""")
def lyric_eligibility(spark, d):
    """FL13: what is worth a lyric lookup."""
    n = F.col("event_id")
    state = F.when(F.col("event_type") == "view", "streaming").when(F.col("event_type") == "click", "paused").otherwise("stopped")
    wanted = rules.wants_lyrics(state, F.when(n % 7 == 0, "  ").otherwise("t"), F.when(n % 5 == 0, "").otherwise("a"), F.col("value") * 2000)
    return table(spark, d, "events").select("event_id", wanted.alias("wanted"))


@query(f"""
with {NUMBERED}, s as (select *, event_id // 3 as captured from numbered), l as (select *, lag(captured) over (partition by user_id order by frame) as before from s)
select event_id, case when event_id % 11 = 0 or value > 6 and event_id % 2 = 0 then 'controller_missing' when event_type = 'view' then 'stream_active' when event_type = 'click' then 'playback_active' when event_id % 4 = 1 then 'backlog'
  when coalesce(captured <> before, true) then 'not_quiet' else 'ready' end as code from l
""")
def update_readiness(spark, d):
    """FL15: the first check that fails before an update, the quiet probe against the sample before."""
    n = F.col("event_id")
    s = numbered_events(spark, d).withColumn("captured_sequence", F.floor(n / 3))
    s = s.withColumn("previous_captured_sequence", F.lag("captured_sequence").over(Window.partitionBy("user_id").orderBy("frame")))
    age = F.when(n % 11 == 0, F.lit(None).cast("double")).when(n % 2 == 0, F.col("value")).otherwise(1.0)
    s = s.withColumns({"controller_age_seconds": age, "streaming": F.col("event_type") == "view", "playback_state": F.when(F.col("event_type") == "click", "playing").otherwise("idle"), "pending_windows": (n % 4 == 1).cast("int")})
    return s.select("event_id", rules.readiness().alias("code"))


@query("""
select event_id, [2290679812, 2290679824, 2290679846, 2290679823, 2290679818, 2290679832, 2147943568, 2147943462, 2290679813, 0][event_id % 10 + 1] - case when event_id % 2 = 0 then 4294967296 else 0 end as code, event_id % 10 < 8 as retry from events
""")
def retryable_errors(spark, d):
    """FL16: device errors as signed and unsigned numbers."""
    n = F.col("event_id")
    codes = F.array(*[F.lit(x).cast("long") for x in (0x88890004, 0x88890010, 0x88890026, 0x8889000F, 0x8889000A, 0x88890018, 0x80070490, 0x80070426, 0x88890005, 0)])
    e = table(spark, d, "events").select("event_id", (F.get(codes, (n % 10).cast("int")) - F.when(n % 2 == 0, F.lit(1 << 32)).otherwise(0)).alias("code"))
    return e.withColumn("retry", rules.retryable(F.col("code")))


@query("""
select event_id, '0x' || upper(lpad(to_hex(event_id * 7919 % 4294967296), 8, '0')) as code, substr('title ' || event_id || ' and so on', 1, 10) as short from events where event_id % 3 <> 0
union all select event_id, null, substr('title ' || event_id || ' and so on', 1, 10) from events where event_id % 3 = 0
""")
def text_rules(spark, d):
    """SF3, SF7, FL12: error codes in one form, texts trimmed and cut."""
    n = F.col("event_id")
    digits = F.lower(F.lpad(F.hex(n * 7919 % (1 << 32)), 8, "0"))
    given = F.when(n % 3 == 0, F.concat(digits, F.lit("h"))).otherwise(F.concat(F.lit(" 0X"), digits, F.lit(" ")))
    return table(spark, d, "events").select("event_id", text.hresult(given).alias("code"), text.truncated(F.concat(F.lit("  title "), n.cast("string"), F.lit(" and so on ")), 10).alias("short"))


@query("""
select event_id, case event_id % 8 when 0 then 'waiting' when 1 then 'connected' when 2 then 'streaming' when 3 then 'paused' when 4 then 'recovering' when 5 then 'stopped' when 6 then case when event_type = 'view' then 'waiting' else 'connected' end else 'error' end as state from events
""")
def stream_events(spark, d):
    """SF21: the receiver's state by its last event."""
    names = F.array(*[F.lit(x) for x in ("receiver_started", "connection_opened", "pcm_received", "flush_received", "connection_reset", "receiver_stopped", "connection_closed", "unheard_of")])
    e = table(spark, d, "events")
    return e.select("event_id", rules.stream_state(F.get(names, (F.col("event_id") % 8).cast("int")), F.when(F.col("event_type") == "view", 0).otherwise(2)).alias("state"))


@query("""
select event_id, case when event_id % 7 = 0 then 'missing_metadata' when event_id % 5 = 0 then 'missing_track_start' when event_id % 11 > 2 * 3 then 'missing_song_prefix' when event_id % 13 < 6 then 'incomplete_song' when event_id % 17 = 0 then 'sample_rate_mismatch' end as reason from events
""")
def song_rejections(spark, d):
    """SF26: why a finished song is not published."""
    n = F.col("event_id")
    cols = {"has_metadata": n % 7 != 0, "first_track_start_frame": F.when(n % 5 != 0, n % 11), "frame_count": n % 13, "duration_frames": F.lit(6), "sample_rate": F.when(n % 17 == 0, 4).otherwise(3), "profile_sample_rate": F.lit(3)}
    return table(spark, d, "events").withColumns(cols).select("event_id", rules.rejection().alias("reason"))


@query(f"""
with {PCM}, g as (select *, 'k' || label || '-' || vec_id // 50 as cache_key from blocks where vec_id % 7 <> 0 and vec_id % 5 <> 0)
select cache_key, 20 + label as frame_count, count(*) > 0 as there from g group by cache_key, label
""")
def published_songs(spark, d):
    """ST5: finished songs that may enter the cache, trimmed to their duration, one for each key."""
    n = F.col("vec_id")
    cols = {"cache_key": F.concat(F.lit("k"), F.col("label").cast("string"), F.lit("-"), F.floor(n / 50).cast("string")), "has_metadata": n % 7 != 0, "first_track_start_frame": F.when(n % 5 != 0, F.lit(0)), "frame_count": F.lit(32), "duration_frames": F.col("label") + 20, "sample_rate": F.lit(3), "profile_sample_rate": F.lit(3)}
    out = cache.published(blocks(spark, d).withColumns(cols))
    return out.select("cache_key", "frame_count", (F.size("pcm") == 2 * F.col("frame_count")).alias("there"))


@query("""
select event_id, greatest(0, event_id % 97 - event_id % 89) as pending_windows, case when event_type = 'click' and event_id % 53 > 0 then greatest(0, event_id % 89 - event_id % 53 + 1) when event_type = 'view' and event_id % 53 > 0 then greatest(0, event_id % 89 - event_id % 53) else event_id % 89 end as ready_windows,
  case when event_id % 3 = 0 then greatest(0, value - 10) else (case when event_type = 'click' and event_id % 53 > 0 then greatest(0, event_id % 89 - event_id % 53 + 1) when event_type = 'view' and event_id % 53 > 0 then greatest(0, event_id % 89 - event_id % 53) else event_id % 89 end) * 3.0::double end as ready_buffer_seconds from events
""")
def lag_and_headroom(spark, d):
    """SF27: windows pending and ready, and the seconds they last."""
    n = F.col("event_id")
    cols = {"captured_sequence": n % 97, "gpu_sequence": n % 89, "playback_sequence": n % 53, "playback_state": F.when(F.col("event_type") == "click", "playing").when(F.col("event_type") == "view", "played").otherwise("idle"), "buffered_seconds": F.when(n % 3 == 0, F.col("value") - 10), "hop_seconds": F.lit(3.0)}
    return table(spark, d, "events").withColumns(cols).select("event_id", *rules.lag_state())


@query("""
select event_id, least(1.0, greatest(0.0, 0.65 * (a + b) / 2 + 0.35 * (c + e) / 2)) as energy, least(1.0, greatest(-1.0, b - a)) as balance
from (select event_id, (value % 1)::double as a, ((event_id % 10) / 10.0)::double as b, ((event_id % 7) / 7.0)::double as c, 0.5::double as e from events)
""")
def visual_levels(spark, d):
    """SF15: energy and balance of a level summary."""
    n = F.col("event_id")
    energy, balance = numeric.visual_energy((n % 7) / 7.0, F.lit(0.5), F.col("value") % 1, (n % 10) / 10.0)
    return table(spark, d, "events").select("event_id", energy.alias("energy"), balance.alias("balance"))


@query("""
with t as (select event_id, (event_id * 1000003) % 4294967296 as s, (event_id * 1000003 + event_id % 900) % 4294967296 as c, (event_id * 1000003 + 1000) % 4294967296 as e from events)
select event_id, least(event_id % 900 + greatest(0, event_id % 250 - 50), 1000) as position, greatest(1, floor(event_id / 8.0::double + 0.5))::int as seconds, greatest(event_id, event_id % 100 + 1) as id from t
""")
def track_positions(spark, d):
    """SF11, SF13, SF25: the place in a track, whole seconds, strictly increasing ids."""
    n = F.col("event_id")
    at = lambda more: (n * 1000003 + more) % numeric.WRAP
    position = numeric.position_at(at(F.lit(0)), at(n % 900), at(F.lit(1000)), F.lit(50), n % 250)
    return table(spark, d, "events").select("event_id", position.alias("position"), numeric.whole_seconds(n / 8).alias("seconds"), numeric.next_id(n, n % 100).alias("id"))


@query(f"""
with {PCM}, c as (select vec_id, list_filter(pcm, lambda x, i: i % 2 = 1) as l, list_filter(pcm, lambda x, i: i % 2 = 0) as r from blocks)
select vec_id, list_sum(l)::bigint as left_total, list_sum(r)::bigint as right_total, len(list_filter(l, lambda x, i: i % 2 = 1)) as shown, list_sum(list_filter(l, lambda x, i: i % 2 = 1))::bigint as shown_total from c
""")
def channels_and_waveform(spark, d):
    """SF22, SF24: channels taken apart, every second value of one."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    left, right = (numeric.channel(F.col("pcm"), i) for i in (0, 1))
    shown = numeric.every_second(left)
    return blocks(spark, d).select("vec_id", total(left).alias("left_total"), total(right).alias("right_total"), F.size(shown).cast("long").alias("shown"), total(shown).alias("shown_total"))


# --- names and maps


@query("""
select s_suppkey, case s_suppkey % 10 when 0 then 'instrumental' when 1 then 'instrumental' when 2 then 'vocals' when 3 then 'drums' when 4 then 'bass' when 5 then 'guitar' when 6 then 'piano' when 7 then 'other' when 8 then 'vocals' end as source from supplier
""")
def model_outputs(spark, d):
    """PJ6: output names to sources by the first word that they contain."""
    names = F.array(*[F.lit(x) for x in ("x_(Instrumental)_m.wav", "x_No_Vocals.wav", "x_(VOCALS).wav", "drums_bassless.wav", "the Bass.wav", "guitar.wav", "piano other.wav", "others.wav", "vocals drums.wav", "x.wav")])
    return table(spark, d, "supplier").select("s_suppkey", rules.source_of(F.get(names, (F.col("s_suppkey") % 10).cast("int"))).alias("source"))


@query("""
select s_suppkey, ['人声', '鼓', '贝斯', '其他', null][s_suppkey % 5 + 1] as label, s_suppkey % 5 = 0 as vocals_shown, s_suppkey % 5 in (0, 1) as drums_shown, false as piano_shown from supplier
""")
def stem_labels(spark, d):
    """PJ4, SF23: display names, and which stems are shown."""
    n = F.col("s_suppkey") % 5
    stems = F.array(*[F.lit(x) for x in ("vocals", "drums", "bass", "other", "horns")])
    shown = rules.visible(F.slice(stems, n.cast("int") + 1, F.lit(2)))
    return table(spark, d, "supplier").select("s_suppkey", rules.labels()[F.get(stems, n.cast("int"))].alias("label"), shown["vocals"].alias("vocals_shown"), shown["drums"].alias("drums_shown"), shown["piano"].alias("piano_shown"))


@query("""
select event_id, case when event_id % 3 = 0 then 'six' when event_id % 5 = 0 then 'four' else 'two' end as profile, case when event_id % 4 = 1 then '12' else '6' end as hop from events
""")
def panel_defaults(spark, d):
    """PJ2: the controller's value, else the last command's, else a constant."""
    n = F.col("event_id")
    controller = F.when(n % 3 == 0, '{"profile": "six"}').when(n % 3 == 1, '{"profile": ""}')
    command = F.concat(F.lit('{"profile": "'), F.when(n % 5 == 0, "four").otherwise(""), F.lit('", "hop": '), F.when(n % 4 == 1, '"12"').otherwise("null"), F.lit("}"))
    e = table(spark, d, "events").select("event_id", controller.alias("controller"), command.alias("command"))
    return e.select("event_id", *telemetry.restored(F.col("controller"), F.col("command"), {"profile": "two", "hop": "6"}))


@query("""
select s_suppkey, s_name, s_suppkey % 4 in (1, 2) as virtual from (select s_suppkey, ['Speakers ', 'CABLE Input (VB-Audio) ', 'Virtual Out ', 'Headset '][s_suppkey % 4 + 1] || s_suppkey as s_name from supplier)
""")
def virtual_endpoints(spark, d):
    """SC16: devices whose name says that they are virtual."""
    names = F.array(*[F.lit(x) for x in ("Speakers ", "CABLE Input (VB-Audio) ", "Virtual Out ", "Headset ")])
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.get(names, (F.col("s_suppkey") % 4).cast("int")), F.col("s_suppkey").cast("string")).alias("name"))
    return joins.virtual_endpoints(s, r"\bcable\b|virtual").withColumnRenamed("name", "s_name")


@query("""
with p as (select s_suppkey as pid, s_nationkey as session from supplier), h as (select s_suppkey + 100000 as pid, case when s_suppkey % 2 = 0 then s_nationkey end as session from supplier where s_suppkey % 3 = 0),
f as (select p.pid, min(h.pid) as target from p left join h on p.session = h.session or h.session is null group by p.pid)
select pid, coalesce(target, pid) as target_pid from f
""")
def helper_processes(spark, d):
    """JN13: the helper of a process' session; one without a session fits all."""
    s = table(spark, d, "supplier")
    p = s.select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("session"))
    h = s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 100000).alias("pid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("session"))
    return joins.helper_of(p, h).select("pid", "target_pid")


# --- lyrics


@query("""
with t as (select c_custkey as track_key, ' ' || upper(c_name) || ' ' as title, c_mktsegment as artist, c_custkey % 4 as revision from customer), l as (select c_custkey as k, c_name as title, upper(c_mktsegment) as artist, c_custkey % 3 as revision, 'words ' || c_custkey as lyrics from customer)
select track_key, t.revision, case when track_key % 4 = track_key % 3 and track_key % 3 > 0 then 'words ' || track_key end as lyrics from t
""")
def lyric_guard(spark, d):
    """JN7: lyrics only where revision, title and artist agree, case and outer spaces ignored."""
    c = table(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("track_key"), F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("title"), F.col("c_mktsegment").alias("artist"), (F.col("c_custkey") % 4).alias("revision"))
    l = c.select(F.col("c_name").alias("title"), F.upper("c_mktsegment").alias("artist"), (F.col("c_custkey") % 3).alias("revision"), F.concat(F.lit("words "), F.col("c_custkey").cast("string")).alias("lyrics"))
    return lyrics.guarded(t, l).select("track_key", "revision", "lyrics")


@query("""
select c_custkey as track_key, case when c_custkey % 2 = 0 then 'exact' when c_custkey % 3 = 0 then 'searched' when c_custkey % 5 = 0 then 'origin' end as lyrics, case when c_custkey % 2 = 0 then 0 when c_custkey % 3 = 0 then 1 when c_custkey % 5 = 0 then 2 end as origin, case when c_custkey % 7 = 0 then 'x' when c_custkey % 11 = 0 then c_name end as first_found from customer
""")
def lyric_cascade(spark, d):
    """SC11, AG18: the first source that has a track's lyrics, the first text that is not empty."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("track_key"), "c_name")
    of = lambda n, name: c.where(F.col("track_key") % n == 0).select("track_key", F.lit(name).alias("lyrics"))
    out = lyrics.cascade(c, [of(2, "exact"), of(3, "searched"), of(5, "origin")])
    n = F.col("track_key")
    found = lyrics.first_found(F.when(n % 7 == 0, " x ").otherwise("  "), F.when(n % 11 == 0, F.col("c_name")))
    return out.select("track_key", "lyrics", "origin", found.alias("first_found"))


@query("select c_custkey as track_key, 'words' as lyrics, c_name as identity from customer where c_custkey % 4 <> 0")
def lyric_cache(spark, d):
    """SC12: cached lyrics whose identity is their track's."""
    c = table(spark, d, "customer")
    cached = c.select(F.col("c_custkey").alias("track_key"), F.lit("words").alias("lyrics"), F.when(F.col("c_custkey") % 4 == 0, "another").otherwise(F.col("c_name")).alias("identity"))
    return lyrics.checked(cached, c.select(F.col("c_custkey").alias("track_key"), F.col("c_name").alias("identity")))


@query("""
with t as (select c_custkey as track_key, c_nationkey, c_mktsegment, c_acctbal from customer), r as (select c_custkey as place, c_nationkey, c_mktsegment, c_acctbal, c_custkey % 3 as kind from customer where c_custkey < 1000),
j as (select t.track_key, r.place, row_number() over (partition by t.track_key order by (t.track_key % 2 = r.place % 2) desc, abs(t.c_acctbal - r.c_acctbal), r.place) as rn from t join r using (c_nationkey, c_mktsegment) where abs(t.c_acctbal - r.c_acctbal) <= 500 and r.kind <> 2)
select track_key, place from j where rn = 1
""")
def lyric_candidates(spark, d):
    """JN8: the best search result of a track: usable, near in duration, of its album first. A search gives 1000 results at most."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("title"), F.col("c_mktsegment").alias("artist"), F.col("c_acctbal").cast("double").alias("duration_seconds"))
    n = F.col("c_custkey")
    album = F.when(n % 2 == 0, "even").otherwise("odd").alias("album")
    t = c.select(n.alias("track_key"), "title", "artist", "duration_seconds", album)
    words = F.when(n % 3 == 0, "[00:01.00]la").otherwise("no time")
    r = c.select(n.alias("place"), "title", "artist", "duration_seconds", album, words.alias("lyrics"), (n % 3 == 1).alias("instrumental"))
    return lyrics.candidates(t, r, 500.0).select("track_key", "place")


# --- streams of sound and anchors


@query(f"""
with {PCM}, s as (select vec_id, unnest(['bass', 'other', 'vocals']) as stem, pcm from blocks)
select vec_id, stem, case when stem = 'other' then list_sum(list_transform(pcm, lambda x: abs(x)))::bigint else 0 end as loud from s
""")
def fallback_stems(spark, d):
    """ST7: a failed window's sound in one stem, silence in the others."""
    out = telemetry.fallback(blocks(spark, d).select("vec_id", "pcm"), ["bass", "other", "vocals"], "other")
    return out.select("vec_id", "stem", F.aggregate("pcm", F.lit(0).cast("long"), lambda s, v: s + F.abs(v.cast("int"))).alias("loud"))


@query(f"""
with {NUMBERED}, p as (select user_id, frame, (event_id // 3000) * 100 as s, (event_id // 3000) * 100 + event_id % 50 as c, (event_id // 3000) * 100 + 50 * (event_id // 6000 % 2) as e from numbered),
m as (select *, (s is distinct from lag(s) over w or e is distinct from lag(e) over w)::int as fresh from p window w as (partition by user_id order by frame))
select user_id, frame, sum(fresh) over (partition by user_id order by frame)::bigint as revision, s <> e as has_progress, c - s as position, e - s as duration from m
""")
def track_revisions(spark, d):
    """ST11, SF13: anchors out of progress reports; a change of start or end is a new revision."""
    n = F.col("event_id")
    base = F.floor(n / 3000) * 100
    p = numbered_events(spark, d).select("user_id", "frame", base.alias("start_rtp"), (base + n % 50).alias("current_rtp"), (base + 50 * (F.floor(n / 6000) % 2)).alias("end_rtp"), F.col("frame").alias("stream_frame"))
    out = timeline.revisions(p, ["user_id"], "frame")
    return out.select("user_id", "frame", "revision", "has_progress", F.col("track_position_frame").alias("position"), F.col("track_duration_frame").alias("duration"))


@query(f"""
with {NUMBERED}, m as (select user_id, frame, event_type, event_type is distinct from lag(event_type) over (partition by user_id order by frame) as fresh from numbered)
select user_id, frame, event_type as status from m where fresh
""")
def changed_status(spark, d):
    """SK12, WN12: status rows that differ from the one before."""
    e = numbered_events(spark, d).select("user_id", "frame", F.col("event_type").alias("status"))
    return run.changed_status(e, ["user_id"], "frame", "status")
