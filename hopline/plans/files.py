"""Queries of file listings, sidecars, manifests, cache entries and packets; documents, orders and lines are their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopline.functions import identity, numeric, rules, text
from hopline.operators import cache, joins, publication, signal, timeline
from hopline.plans.bindings import PCM, blocks
from hopline.plans.registry import query
from hopline.schemas import ANCHOR
from hopline.sources import documents, wav
from hopline.sources.tables import table
from hopline.storage import scratch
from hopline.streaming import run

# --- listings

_LISTING = """
listing as (select doc_id, case doc_id % 6 when 0 then 'capture-' || lpad(doc_id::varchar, 8, '0') || '.wav' when 1 then 'result-' || lpad(doc_id::varchar, 8, '0') || '.json' when 2 then 'capture-' || doc_id || '.wav'
  when 3 then 'capture-' || lpad(doc_id::varchar, 8, '0') || '.wav.part' when 4 then 'failed-' || lpad(doc_id::varchar, 8, '0') || '-x.wav' else 'a/__pycache__/m.pyc' end as name from documents)
"""


def _listing(spark, d):
    n = F.col("doc_id")
    eight = F.lpad(n.cast("string"), 8, "0")
    name = F.when(n % 6 == 0, F.concat(text.sequence_name("capture", n), F.lit(".wav"))).when(n % 6 == 1, F.concat(F.lit("result-"), eight, F.lit(".json"))).when(n % 6 == 2, F.concat(F.lit("capture-"), n.cast("string"), F.lit(".wav")))
    name = name.when(n % 6 == 3, F.concat(F.lit("capture-"), eight, F.lit(".wav.part"))).when(n % 6 == 4, F.concat(F.lit("failed-"), eight, F.lit("-x.wav"))).otherwise("a/__pycache__/m.pyc")
    return table(spark, d, "documents").select("doc_id", name.alias("name"))


@query(f"with {_LISTING} select doc_id, name, doc_id as sequence from listing where doc_id % 6 = 0 and doc_id > 100 order by doc_id limit 25")
def ready_captures(spark, d):
    """SC3, TK1: the first 25 captured windows above a sequence; the number is what a poll takes."""
    return documents.ready_captures(_listing(spark, d), F.lit(100), 25)


@query(f"with {_LISTING} select max(doc_id) + 1 as next_sequence from listing where doc_id % 6 in (0, 1, 3, 4)")
def resume_point(spark, d):
    """SC20: one more than the highest sequence of any artifact."""
    return documents.next_sequence(_listing(spark, d))


@query("select doc_id, 'f' || doc_id || '.' || ['wav', 'MP3', 'flac', 'txt', 'Ogg', 'm4a.part', 'opus', 'aac', 'aiff', 'mid'][doc_id % 10 + 1] as name from documents where doc_id % 10 in (0, 1, 2, 4, 6, 7, 8)")
def accepted_inputs(spark, d):
    """SC19: audio types that are taken, case ignored."""
    kinds = F.array(*[F.lit(x) for x in ("wav", "MP3", "flac", "txt", "Ogg", "m4a.part", "opus", "aac", "aiff", "mid")])
    listing = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.get(kinds, (F.col("doc_id") % 10).cast("int"))).alias("name"))
    return documents.accepted_inputs(listing)


@query(f"""
with {_LISTING}
select doc_id, try_cast(nullif(regexp_extract(name, '^capture-([0-9]{{8}})[.]wav$', 1), '') as bigint) as capture, try_cast(nullif(regexp_extract(name, '^result-([0-9]{{8}})[.]json$', 1), '') as bigint) as result,
  case when doc_id % 6 in (0, 1, 3, 4) then doc_id end as artifact, doc_id % 6 <> 5 as plain, doc_id % 6 <> 5 as exported, doc_id % 6 in (1, 4) as stem_name, true as is_sha from listing
""")
def file_names(spark, d):
    """FL1, FL2, FL4, FL17: sequences in names, names that stay in their folder, what is exported, the shapes of identifiers."""
    of = lambda p: rules.sequence_of(F.col("name"), p)
    first = F.regexp_extract("name", r"^([^.]*)", 1)
    stem = F.when(F.col("doc_id") % 6 == 1, F.lower(first)).when(F.col("doc_id") % 6 == 4, F.regexp_replace("name", r"\..*$", "")).otherwise(F.upper("name"))
    return _listing(spark, d).select(
        "doc_id", of(rules.CAPTURE).alias("capture"), of(rules.RESULT).alias("result"), of(rules.ARTIFACT).alias("artifact"), rules.plain_name(F.col("name")).alias("plain"), rules.exported(F.col("name")).alias("exported"),
        stem.rlike(rules.STEM_NAME).alias("stem_name"), F.sha2("name", 256).rlike(rules.SHA256).alias("is_sha"))


@query("""
with f as (select distinct l_orderkey as seq from lineitem where l_linenumber = 3)
select o_orderkey as seq, case when f.seq is not null then 'ready' when o_orderkey % 3 <> 0 then 'skipped' else 'waiting' end as state from orders left join f on f.seq = o_orderkey
""")
def playback_probe(spark, d):
    """SC5: ready, skipped or waiting by file and manifest."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"))
    files = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("seq"))
    return joins.playback_state(o, files, o.where("seq % 3 <> 0"), ["seq"])


@query("select doc_id, '/data/' || case when doc_id % 4 = 2 then 'abs/' || doc_id else 'out/' || doc_id end || '.wav' as path from documents where doc_id % 5 <> 0")
def normalised_paths(spark, d):
    """PJ7: relative and absolute paths with odd slashes in one form, those of the listing only."""
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    given = F.when(n % 4 == 0, F.concat(F.lit("./"), s, F.lit(".wav"))).when(n % 4 == 1, F.concat(s, F.lit(".wav"))).when(n % 4 == 2, F.concat(F.lit("/data//abs/./"), s, F.lit(".wav"))).otherwise(F.concat(F.lit("\\data\\out\\"), s, F.lit(".wav")))
    docs = table(spark, d, "documents").select("doc_id", rules.absolute(given, F.lit("/data/out")).alias("path"))
    there = docs.where(n % 5 != 0).select("path")
    return docs.join(there, "path", "left_semi").select("doc_id", "path")


# --- sidecars and control files


@query("""
with s as (select user_id, event_id, epoch_us(ts) // 1000000 - 1704067200 as pos from events where event_type = 'signup'),
u as (select user_id, list(pos order by pos, event_id) as places, max(pos) as last from s group by user_id)
select user_id, user_id % 7 not in (1, 2, 3, 4) and not (user_id % 7 = 5 and len(places) > 1 and places[1] < places[len(places)]) as valid,
  case when user_id % 7 not in (1, 2, 3, 4) and not (user_id % 7 = 5 and len(places) > 1 and places[1] < places[len(places)]) then len(places) end as n_anchors,
  case when user_id % 7 not in (1, 2, 3, 4) and not (user_id % 7 = 5 and len(places) > 1 and places[1] < places[len(places)]) then last + 60 else -1 end as stream_end_frame
from u
""")
def sidecar_annotations(spark, d):
    """SC6, D5: a user's anchors as a sidecar; a wrong version, a text in place of a number, an unexpected rate, an anchor past the end and a wrong order are refused."""
    n = F.col("user_id")
    e = table(spark, d, "events").where("event_type = 'signup'").select("user_id", "event_id", (F.floor(F.unix_micros("ts") / 1_000_000) - 1704067200).alias("at"))
    zero = {f.split(" ")[0]: F.lit(0).cast("long") for f in ANCHOR.split(", ")}
    own = {**zero, "revision": F.lit(1).cast("long"), "has_progress": F.lit(True), "anchor_stream_frame": F.col("at"), "track_duration_frame": F.lit(9).cast("long"), "title": F.lit("t"), "artist": F.lit("a"), "album": F.lit("b")}
    anchor = F.struct(*[v.alias(k) for k, v in own.items()])
    u = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id", anchor.alias("a")))), lambda x: x["a"]).alias("anchors"), F.max("at").alias("last"))
    anchors = F.when(n % 7 == 5, F.reverse("anchors")).otherwise(F.col("anchors"))
    end = F.when(n % 7 == 4, F.col("last") - 1).otherwise(F.col("last") + 60)
    doc = F.to_json(F.struct(F.when(n % 7 == 1, 2).otherwise(1).alias("version"), F.lit("test").alias("source"), F.col("user_id").cast("long").alias("sequence"), F.when(n % 7 == 3, 48000).otherwise(44100).alias("sample_rate"), F.least(F.lit(0), end - 1).alias("stream_start_frame"), end.alias("stream_end_frame"), F.get(anchors, F.lit(0)).alias("track"), anchors.alias("anchors")))
    doc = F.when(n % 7 == 2, F.regexp_replace(doc, r'"sequence":(\d+)', r'"sequence":"x"')).otherwise(doc)
    out = documents.annotations(u.select("user_id", doc.alias("value")), "value", {"sample_rate": F.lit(44100)})
    return out.select("user_id", "valid", F.size("annotation.anchors").cast("long").alias("n_anchors"), F.coalesce("annotation.stream_end_frame", F.lit(-1)).alias("stream_end_frame"))


@query("""
select doc_id, doc_id % 6 in (0, 5) as valid, case when doc_id % 6 in (0, 5) then doc_id end as sequence, case when doc_id % 6 in (0, 5) then round((doc_id % 11) / 10.0::double, 3) end as vocals,
  case when doc_id % 6 in (0, 5) then (doc_id % 3) * 0.5::double end as drums from documents
""")
def mixer_controls(spark, d):
    """SC9, SK9, FL6, SF23: mixer files written and read; a gain beyond 1, an unknown stem, no sequence and a stem twice are refused."""
    n = F.col("doc_id")
    gains = F.create_map(F.lit("vocals"), (n % 11) / 10.0, F.lit("drums"), (n % 3) * 0.5)
    good = documents.mixer_file(n, gains)
    bad = F.when(n % 6 == 1, F.regexp_replace(good, r"vocals\t[0-9.]+", "vocals\t1.5")).when(n % 6 == 2, F.regexp_replace(good, "drums", "bells")).when(n % 6 == 3, F.regexp_replace(good, r"sequence\t\d+\n", "")).when(n % 6 == 4, F.concat(good, F.lit("gain\tdrums\t0.5\n"))).otherwise(good)
    out = documents.mixer_gains(table(spark, d, "documents").select("doc_id", bad.alias("value")))
    gain = lambda s: F.round(F.col("gains")[s].cast("double"), 3).alias(s)
    return out.select("doc_id", "valid", "sequence", gain("vocals"), gain("drums"))


@query("select conv_id, turn, to_json({'conv_id': conv_id, 'role': role, 'turn': turn}) as value from conversations")
def status_documents(spark, d):
    """SK2, SK11, SK13, PJ3, SF5: rows as JSON documents."""
    c = table(spark, d, "conversations")
    docs = run.status_document(c, ["conv_id", "role", "turn"])
    return docs.select(F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("value", "$.turn").cast("long").alias("turn"), "value")


# --- manifests, integrity, publication

_FILES = """
files as (select distinct l_orderkey as entry, l_linenumber - 1 as chunk_index, unnest(['drums', 'vocals']) as stem, l_orderkey % 23 <> 0 or l_linenumber <> 1 as right_size, (l_orderkey + l_linenumber) % 41 <> 0 as right_hash,
  case when l_orderkey % 31 = 0 and l_linenumber = 1 then 48000 else 44100 end as rate from lineitem),
kept as (select * from files where not (stem = 'drums' and (entry * 7 + chunk_index) % 29 = 0)),
chunk as (select entry, chunk_index, bool_and(right_size and right_hash) as sound, count(*) = 2 as whole, min(rate) as low, max(rate) as high from kept group by all),
checks as (select entry, count(*) as chunks, bool_and(sound) and bool_and(whole) and min(low) = max(high) and min(chunk_index) = 0 and max(chunk_index) = count(*) - 1 as intact from chunk group by entry)
"""


def _files(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), "l_linenumber").distinct()
    f = l.withColumn("stem", F.explode(F.array(F.lit("drums"), F.lit("vocals")))).withColumn("chunk_index", F.col("l_linenumber") - 1)
    f = f.where(~((F.col("stem") == "drums") & ((F.col("entry") * 7 + F.col("chunk_index")) % 29 == 0)))
    own = F.sha2(F.concat_ws("/", "entry", "chunk_index", "stem"), 256)
    return f.select(
        "entry", "chunk_index", "stem", F.lit(100).alias("expected_bytes"), F.when((F.col("entry") % 23 == 0) & (F.col("l_linenumber") == 1), 99).otherwise(100).alias("bytes"), own.alias("expected_sha256"),
        F.when((F.col("entry") + F.col("l_linenumber")) % 41 == 0, F.sha2(own, 256)).otherwise(own).alias("sha256"), F.when((F.col("entry") % 31 == 0) & (F.col("l_linenumber") == 1), 48000).otherwise(44100).alias("sample_rate"), F.lit(2).alias("channels"))


@query(f"with {_FILES} select * from checks")
def cache_integrity(spark, d):
    """FL14, SC7, SO1, SO6: sizes, hashes, the set of stems, dense chunks and one geometry for each entry."""
    return cache.intact(_files(spark, d), ["entry"], F.array(F.lit("vocals"), F.lit("drums")))


@query(f"with {_FILES} select o_orderkey as entry from orders where o_orderkey not in (select entry from checks where not intact)")
def cache_quarantine(spark, d):
    """FL14, JN3: entries without those that fail their checks."""
    checks = cache.intact(_files(spark, d), ["entry"], F.array(F.lit("vocals"), F.lit("drums")))
    return cache.quarantined(table(spark, d, "orders").select(F.col("o_orderkey").alias("entry")), checks, ["entry"])


@query("""
with l as (select distinct l_orderkey, l_linenumber, 's' || l_linenumber as stem, 'stem-' || l_orderkey || '-' || l_linenumber || '.wav' as filename from lineitem)
select l_orderkey as sequence, 2 as version, 44100 as sample_rate, count(*) as n, string_agg(stem || '=' || filename, ',' order by stem) as stems from l group by l_orderkey
""")
def result_manifests(spark, d):
    """SK4, SK3, D7, SF23: a manifest for each result with its stems as a map."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence"), "l_linenumber").distinct()
    s = l.select("sequence", F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("stem"), F.concat(F.lit("stem-"), F.concat_ws("-", "sequence", "l_linenumber"), F.lit(".wav")).alias("filename"))
    m = publication.manifests(s, ["sequence"], sample_rate=F.lit(44100))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("stems")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("sequence", "version", "sample_rate", F.size("stems").cast("long").alias("n"), listed.alias("stems"))


@query("""
with c as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
b as (select c.* from c where l_orderkey % 5 <> 0), r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as rn from b)
select l_orderkey, l_linenumber, l_partkey, l_suppkey from r where rn = 1
""")
def stored_chunks(spark, d):
    """SK19, SO5: the latest chunk of each index of entries in building; complete ones take none."""
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "complete").otherwise("building").alias("state"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("version", F.struct("l_partkey", "l_suppkey"))
    return publication.stored(entries, l, ["l_orderkey"], "l_linenumber", "version").drop("version")


@query("""
with p as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as frames from lineitem),
w as (select l_orderkey, sum(frames) - (l_orderkey % 4 = 0)::int as wanted, sum(frames) as frames, count(*) as n, min(l_partkey % 17 = 0) as a, max(l_partkey % 17 = 0) as b,
  string_agg('{"cache_key":"k' || l_partkey || '","cached_start_frame":' || l_suppkey || ',"frame_count":' || p.frames || '}', ',' order by l_linenumber, 'k' || l_partkey, l_suppkey, p.frames) as parts from p group by l_orderkey)
select l_orderkey, frames::bigint as frames, n as cache_part_count, sha256('parts-v1' || chr(0) || '[' || parts || ']') as cache_key from w where a = b and wanted = frames
""")
def composite_results(spark, d):
    """SK7, SF18: results out of several songs, of one profile and as long as wanted, with their composite key."""
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("frame_count")).distinct()
    p = p.select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("cache_key"), F.col("l_suppkey").alias("cached_start_frame"), "frame_count", (F.col("l_partkey") % 17 == 0).alias("profile"))
    wanted = F.when(F.col("l_orderkey") % 4 == 0, F.col("frames") - 1).otherwise(F.col("frames"))
    out = publication.composites(p, ["l_orderkey"], wanted)
    return out.select("l_orderkey", F.col("frames").cast("long").alias("frames"), F.col("cache_part_count").cast("long").alias("cache_part_count"), "cache_key")


@query("""
select c_custkey, sha256('song-v1' || chr(0) || '{"album":"' || lower(c_mktsegment) || '","artist":"' || lower(c_name) || '","duration_frames":' || (c_custkey * 3) || ',"sample_rate":44100,"title":"t ' || c_custkey || '"}') as song_key,
  sha256('lyrics-v1' || chr(0) || '{"album":"","artist":"' || lower(c_name) || '","duration_seconds":' || greatest(1, floor(c_custkey / 4.0::double + 0.5))::int || ',"title":"t ' || c_custkey || '"}') as lyric_key,
  sha256('pcm16-v1' || chr(0) || '{"channels":2,"sample_rate":44100}' || chr(0) || c_name) as pcm_key from customer
""")
def identity_keys(spark, d):
    """AG12, SF17, SF18, SF1, SF11: keys of songs, lyrics and sound out of canonical JSON; titles have wide letters and odd spaces that fold away."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat(F.lit(" Ｔ\t "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("title"))
    song = identity.metadata_identity(F.col("title"), F.upper("c_name"), F.col("c_mktsegment"), F.col("c_custkey") * 3, F.lit(44100))
    lyric = identity.lyric_key(F.col("title"), F.upper("c_name"), F.lit(""), F.col("c_custkey") / 4)
    return c.select("c_custkey", song.alias("song_key"), lyric.alias("lyric_key"), identity.pcm_identity(F.col("c_name"), F.lit(44100), F.lit(2)).alias("pcm_key"))


# --- sound out of files and cache entries


@query(f"""
with {PCM}, s as (select vec_id, pcm[2 * (vec_id % 5) + 1 : 2 * (vec_id % 5) + 2 * (3 + vec_id % 4)] as part, vec_id % 5 as first, 3 + vec_id % 4 as n from blocks)
select vec_id, n as frames, list_sum(part)::bigint as total, part[1] as first_sample, part[len(part)] as last_sample from s
""")
def cached_slices(spark, d):
    """SK5, SK6, SK8, SC2: the frames of a song that answer a window."""
    hits = blocks(spark, d).select("vec_id", F.col("pcm").alias("song_pcm"), (F.col("vec_id") % 5).alias("offset"), (F.col("vec_id") % 4 + 3).alias("frame_count"))
    out = cache.sliced(hits)
    return out.select("vec_id", F.col("frame_count").alias("frames"), F.aggregate("pcm", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.get("pcm", F.lit(0)).cast("int").alias("first_sample"), F.element_at("pcm", -1).cast("int").alias("last_sample"))


@query(f"""
with {PCM}, p as (select *, row_number() over (partition by vec_id // 6 order by vec_id desc) as ord from blocks),
g as (select vec_id // 6 as grp, bool_and(vec_id % 50 <> 0) as whole, count(*) * 32 as frames, flatten(list(pcm order by ord)) as pcm from p group by all)
select grp, frames, case when whole then pcm[1] end as first_sample, case when whole then list_sum(list_transform(pcm, lambda x, i: x * i))::bigint else -1 end as weighted from g
""")
def ordered_parts(spark, d):
    """SO4: parts in order as one sound, null where a part is shorter than it says."""
    b = blocks(spark, d).select(F.floor(F.col("vec_id") / 6).alias("grp"), (-F.col("vec_id")).alias("ord"), F.when(F.col("vec_id") % 50 == 0, F.slice("pcm", 1, 62)).otherwise(F.col("pcm")).alias("pcm"), F.lit(32).alias("frame_count"))
    out = timeline.ordered_concat(b, ["grp"], "ord")
    places = F.transform("pcm", lambda v, i: v.cast("long") * (i + 1))
    return out.select("grp", F.col("frame_count").alias("frames"), F.get("pcm", F.lit(0)).cast("int").alias("first_sample"), F.coalesce(F.aggregate(places, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(-1)).alias("weighted"))


@query(f"""
with {PCM}
select vec_id, case when vec_id % 7 = 1 then 'not a RIFF/WAVE file' when vec_id % 7 = 2 then 'truncated file' when vec_id % 7 = 3 then 'not 16-bit PCM' when vec_id % 7 = 4 then 'format or data chunk is missing' when vec_id % 7 = 5 then 'repeated data chunk' end as error,
  case when vec_id % 7 in (0, 6) then 44100 end as sample_rate, case when vec_id % 7 in (0, 6) then list_sum(list_transform(pcm, lambda x, i: x * i))::bigint else -1 end as weighted from blocks
""")
def wav_files(spark, d):
    """SC1, SK1, SF16: blocks written as WAV files and read; damaged files have their error, and chunks that aren't known are passed over."""
    n = F.col("vec_id")
    c = wav.encoded(blocks(spark, d).withColumns({"sample_rate": F.lit(44100), "channels": F.lit(2)})).withColumn("pcm", F.col("content"))
    sub = lambda a, b: F.substring("pcm", a, b)
    size = lambda more: F.concat(F.lit(b"RIFF"), F.unhex(F.lit(f"{(36 + 128 + more):02X}000000")))
    damaged = (
        F.when(n % 7 == 1, F.concat(F.lit(b"RIFX"), sub(5, 1000))).when(n % 7 == 2, sub(1, 100)).when(n % 7 == 3, F.concat(sub(1, 20), F.lit(b"\x03"), sub(22, 1000))).when(n % 7 == 4, F.concat(sub(1, 36), F.lit(b"none"), sub(41, 1000)))
        .when(n % 7 == 5, F.concat(size(8), sub(9, 1000), F.lit(b"data\0\0\0\0"))).when(n % 7 == 6, F.concat(size(12), sub(9, 28), F.lit(b"LIST\x03\0\0\0abc\0"), sub(37, 1000))).otherwise(F.col("pcm"))
    )
    out = wav.decoded(c.select(n.cast("string").alias("path"), damaged.alias("content")))
    places = F.transform("pcm", lambda v, i: v.cast("long") * (i + 1))
    return out.select(F.col("path").cast("long").alias("vec_id"), "error", "sample_rate", F.coalesce(F.aggregate(places, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(-1)).alias("weighted"))


@query("select vec_id // 6 as grp, count(distinct vec_id % 6) = 6 and bool_and(vec_id % 40 <> 0) as complete from embeddings group by all")
def complete_stems(spark, d):
    """JN9: groups with each stem once, all of one length."""
    names = F.array(*[F.lit(x) for x in ("vocals", "drums", "bass", "guitar", "piano", "other")])
    b = blocks(spark, d).select(F.floor(F.col("vec_id") / 6).alias("grp"), F.get(names, (F.col("vec_id") % 6).cast("int")).alias("stem"), F.when(F.col("vec_id") % 40 == 0, F.slice("pcm", 1, 60)).otherwise(F.col("pcm")).alias("pcm"))
    return signal.complete_groups(b, ["grp"], names, F.size("pcm"))


@query("with l as (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem) select l_orderkey, l_suppkey from l group by all having count(*) > 1")
def repeated_sources(spark, d):
    """SO3: values that stand in a group more than once."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return joins.repeated_values(l, ["l_orderkey"], "l_suppkey")


_SONGS = f"with {PCM}, songs as (select vec_id // 64 as song, flatten(list(pcm order by vec_id)) as pcm from blocks where pcm is not null group by 1)"


def _songs(spark, d):
    """Mono files of 64 blocks each, as rows that the WAV sink takes."""
    b = blocks(spark, d).where("pcm is not null").groupBy(F.floor(F.col("vec_id") / 64).alias("song"))
    pcm = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "pcm"))), lambda x: x["pcm"]))
    name = F.concat(text.sequence_name("capture", F.col("song")), F.lit(".wav"))
    return b.agg(pcm.alias("pcm")).select(name.alias("path"), F.lit(8000).alias("sample_rate"), F.lit(1).alias("channels"), "pcm")


def _read_back(df):
    name = F.element_at(F.split("path", "/"), -1)
    places = F.transform("pcm", lambda v, i: v.cast("long") * (F.col("start_frame") + i + 1))
    return df.select(F.regexp_extract(name, r"(\d{8})", 1).cast("long").alias("song"), "start_frame", F.size("pcm").cast("long").alias("frames"), F.aggregate(places, F.lit(0).cast("long"), lambda s, v: s + v).alias("weighted"))


@query(f"""
{_SONGS}, v as (select song, unnest(pcm) as v, generate_subscripts(pcm, 1) - 1 as i from songs)
select song, i // 300 * 300 as start_frame, count(*) as frames, sum(v * (i + 1))::bigint as weighted from v where i // 300 * 300 >= 1000 group by all
""")
def wav_blocks(spark, d):
    """SC1, SC2, SK1: blocks written as WAV files and read in ranges; the source seeks to those from frame 1,000 on."""
    wav.register(spark)
    at = scratch(spark, "wav-blocks")
    _songs(spark, d).write.format("wav_pcm16").mode("append").save(at)
    return _read_back(spark.read.format("wav_pcm16").option("blockFrames", 300).load(at).where("start_frame >= 1000"))


@query(f"""
{_SONGS}, v as (select song, unnest(pcm) as v, generate_subscripts(pcm, 1) - 1 as i from songs)
select song, 0::bigint as start_frame, count(*) as frames, sum(greatest(-32768, least(32767, round(v * 1.5::double)))::bigint * (i + 1))::bigint as weighted from v group by song
""")
def wav_stream(spark, d):
    """ST1, SC3, SK3: captured files as a stream by sequence, made louder, published by the stream's sink as results of the same sequence."""
    wav.register(spark)
    at = scratch(spark, "wav-stream")
    _songs(spark, d).write.format("wav_pcm16").mode("append").save(f"{at}/in")
    louder = F.transform("pcm", lambda v: numeric.pcm16(v.cast("double") * 1.5))
    name = F.replace(F.element_at(F.split("path", "/"), -1), F.lit("capture"), F.lit("result"))
    captured = spark.readStream.format("wav_pcm16").load(f"{at}/in")
    running = captured.select(name.alias("path"), "sample_rate", "channels", louder.alias("pcm")).writeStream.format("wav_pcm16").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    running.awaitTermination()
    return _read_back(spark.read.format("wav_pcm16").load(f"{at}/out"))
