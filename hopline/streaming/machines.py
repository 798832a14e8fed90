"""State machines over ordered events of one session, as plain step functions.

Each machine is a class whose ``step(row)`` takes one event as a dict and gives the rows it puts out. Its attributes are its
state. ``run.replay`` and ``run.streamed`` apply a machine to batch and streaming frames.
"""

from __future__ import annotations

import numpy as np

WRAP = 1 << 32


class Revisions:
    """Track revisions and late metadata (ST11). Events: kind progress (start_rtp, current_rtp, end_rtp) or metadata (field, value), stream_frame.

    A change of start or end is a new revision. Metadata of the first two seconds, or at frame 0, also goes to the
    anchors of the current revision that are already out: they are put out again.
    """

    OUT = "revision long, metadata_revision long, start_rtp long, current_rtp long, end_rtp long, has_progress boolean, anchor_stream_frame long, title string, artist string, album string, backfilled boolean"
    MOST = 4096

    def __init__(self, sample_rate: int = 44100):
        self.rate = sample_rate
        self.now = {"revision": 0, "metadata_revision": 0, "start_rtp": None, "current_rtp": None, "end_rtp": None, "has_progress": False, "anchor_stream_frame": 0, "title": "", "artist": "", "album": ""}
        self.anchors: list[dict] = []

    def step(self, row: dict) -> list[dict]:
        now, frame = self.now, int(row["stream_frame"])
        if row["kind"] == "progress":
            start, current, end = int(row["start_rtp"]), int(row["current_rtp"]), int(row["end_rtp"])
            if (start, end) != (now["start_rtp"], now["end_rtp"]):
                now["revision"] += 1
            now.update(start_rtp=start, current_rtp=current, end_rtp=end, has_progress=start != end, anchor_stream_frame=frame)
            self.anchors = [*self.anchors, dict(now)][-self.MOST :]
            return [{**now, "backfilled": False}]
        if row["field"] not in ("title", "artist", "album") or now[row["field"]] == row["value"]:
            return []
        now[row["field"]] = row["value"]
        now["metadata_revision"] += 1
        early = frame == 0
        if not early and self.anchors:
            last = self.anchors[-1]
            passed = (last["current_rtp"] - last["start_rtp"]) % WRAP + max(0, frame - last["anchor_stream_frame"])
            early = min(passed, (last["end_rtp"] - last["start_rtp"]) % WRAP) <= 2 * self.rate
        out = []
        for a in self.anchors if early else []:
            if a["revision"] == now["revision"]:
                a.update({k: now[k] for k in ("title", "artist", "album", "metadata_revision")})
                out.append({**a, "backfilled": True})
        return out


class Session:
    """stopped, warming, running, error (ST12). Events: start, running, progress, fail, stop. One that the state does not allow is put out as refused."""

    OUT = "event string, state string, refused boolean"
    ALLOWED = {"start": ("stopped",), "running": ("warming",), "progress": ("running",), "fail": ("warming", "running", "error"), "stop": ("stopped", "warming", "running", "error")}
    NEXT = {"start": "warming", "running": "running", "progress": "running", "fail": "error", "stop": "stopped"}

    def __init__(self):
        self.state = "stopped"

    def step(self, row: dict) -> list[dict]:
        event = row["event"]
        refused = self.state not in self.ALLOWED.get(event, ())
        if not refused:
            self.state = self.NEXT[event]
        return [{"event": event, "state": self.state, "refused": refused}]


class Ring:
    """The synchronised buffer by its frame counts (ST8, AG16). Events: push or pop with frames; a push also says whether all stems are there.

    A push is all or nothing. Output starts once ``prebuffer`` frames are in; a pop that finds too few is an underrun, and the
    buffer fills up again before it goes on. The event's ``frame``, its place in the session, is put out too, and what the last underrun
    found. The sound itself is cut by framing.ring_audio() out of these counts.
    """

    OUT = "frame long, op string, result string, frames long, buffered long, total_written long, total_read long, underruns long, minimum_buffered long, last_underrun_buffered long, last_underrun_total_read long"

    def __init__(self, capacity: int, prebuffer: int):
        self.capacity, self.prebuffer = capacity, prebuffer
        self.buffered = self.written = self.read = self.underruns = 0
        self.least: int | None = None
        self.last: tuple = (None, None)
        self.playing = False

    def step(self, row: dict) -> list[dict]:
        op, n = row["op"], int(row["frames"])
        if op == "push":
            whole = row.get("complete", True) is not False and n > 0
            result = "refused" if not whole else "full" if n > self.capacity - self.buffered else "accepted"
            if result == "accepted":
                self.buffered += n
                self.written += n
        elif n <= 0 or n > self.capacity:
            result = "refused"
        elif not self.playing and self.buffered < max(self.prebuffer, n):
            result = "prebuffering"
        else:
            self.playing = self.buffered >= n
            result = "audio" if self.playing else "underrun"
            if self.playing:
                self.buffered -= n
                self.read += n
            else:
                self.underruns += 1
                self.last = (self.buffered, self.read)
            if self.read:
                self.least = self.buffered if self.least is None else min(self.least, self.buffered)
        last = {"last_underrun_buffered": self.last[0], "last_underrun_total_read": self.last[1]}
        return [{"frame": row.get("frame"), "op": op, "result": result, "frames": n, **last, "buffered": self.buffered, "total_written": self.written, "total_read": self.read, "underruns": self.underruns, "minimum_buffered": self.least}]


class Loader:
    """Which sequence is taken next, and where stitching starts anew (ST9). Events: sequence, state waiting, skipped or ready."""

    OUT = "sequence long, action string, stitch_reset boolean"

    def __init__(self, first: int = 1):
        self.next, self.reset = first, True

    def step(self, row: dict) -> list[dict]:
        if int(row["sequence"]) != self.next or row["state"] == "waiting":
            return []
        skipped = row["state"] == "skipped"
        out = [{"sequence": self.next, "action": "skip" if skipped else "push", "stitch_reset": self.reset}]
        self.reset = skipped
        self.next += 1
        return out


class LyricLookups:
    """When lyrics are looked up (ST16). Events: at_s, revision, track_key (null: nothing eligible), outcome (found, not_found or error, what a lookup would give).

    One lookup for each revision and key; after an error again every 60 s; found and not_found hold until the track changes.
    """

    OUT = "at_s double, track_key string, outcome string"
    RETRY = 60.0

    def __init__(self):
        self.key, self.outcome, self.at = None, None, 0.0

    def step(self, row: dict) -> list[dict]:
        key = None if row["track_key"] is None else (row["revision"], row["track_key"])
        if key is None:
            self.key = self.outcome = None
            return []
        if key == self.key and (self.outcome != "error" or row["at_s"] - self.at < self.RETRY):
            return []
        self.key, self.outcome, self.at = key, row["outcome"], row["at_s"]
        return [{"at_s": row["at_s"], "track_key": row["track_key"], "outcome": row["outcome"]}]


def pieces(anchors: list[dict], start: int, count: int) -> list[dict]:
    """timeline.segments() for one interval."""
    ordered = sorted(enumerate(anchors), key=lambda x: (x[1]["anchor_stream_frame"], x[0]))
    rows = [a for _, a in ordered]
    out = []
    for i, a in enumerate(rows):
        at, end = a["anchor_stream_frame"], start + count
        low = max(at, start)
        if i == 0 and at > start and a["track_position_frame"] + start - at >= 0:
            low = start
        track = a["track_position_frame"] + low - at
        high = min(end, rows[i + 1]["anchor_stream_frame"] if i + 1 < len(rows) else end, low + a["track_duration_frame"] - track)
        if low < high and a["has_progress"] and a["track_duration_frame"] > 0 and 0 <= track < a["track_duration_frame"]:
            out.append({**a, "stream_start": low, "stream_end": high, "track_start": track, "track_end": track + high - low})
    return out


class Assembly:
    """Whole songs out of consecutive windows (ST4, ST5, ST3, TK6).

    Events, in order of sequence: sequence, stream_start_frame, pcm (hop and overlap frames), anchors (null: no annotation), song_hit (true:
    answered from the cache, passed by). A row is put out for each song that ends, with reason null if it is whole.
    """

    OUT = "epoch long, start_rtp long, revision long, title string, artist string, album string, duration_frames long, first_track_start_frame long, frame_count long, recoveries int, misses int, reason string, pcm array<smallint>"
    HISTORY = 3

    def __init__(self, sample_rate: int, hop: int, overlap: int, offset: int = 0, channels: int = 2):
        self.rate, self.hop, self.overlap, self.offset, self.channels = sample_rate, hop, overlap, offset, channels
        self.epoch, self.last_start, self.last_sequence = 0, None, 0
        self.tail, self.history, self.song, self.done = None, [], None, set()

    def _stitched(self, pcm: np.ndarray) -> np.ndarray:
        out = pcm[: self.hop].astype(float)
        if self.tail is not None:
            t = (np.full(1, 0.5) if self.overlap == 1 else np.arange(self.overlap) / (self.overlap - 1))[:, None]
            mixed = self.tail + (out[: self.overlap] - self.tail) * t
            out[: self.overlap] = np.trunc(mixed + np.copysign(0.5, mixed))
        self.tail = pcm[self.hop : self.hop + self.overlap].astype(float)
        return np.clip(out, -32768, 32767).astype(np.int16)

    def _forget(self) -> None:
        self.song, self.tail, self.history = None, None, []

    def _finished(self) -> list[dict]:
        s, self.song = self.song, None
        if s is None:
            return []
        late, short = s["first"] > 2 * self.rate, s["frames"] < s["duration"]
        reason = "missing_song_prefix" if late else "incomplete_song" if short else None
        if reason is None:
            self.done.add(s["key"])
        pcm = np.concatenate(s["pcm"])[: s["duration"]].ravel() if reason is None else None
        names = {k: s[k] for k in ("revision", "title", "artist", "album", "recoveries", "misses")}
        return [{"epoch": s["key"][0], "start_rtp": s["key"][1], **names, "duration_frames": s["duration"], "first_track_start_frame": s["first"], "frame_count": min(s["frames"], s["duration"]) if reason is None else s["frames"], "reason": reason, "pcm": None if pcm is None else pcm.tolist()}]

    def _prefix(self, first: int, end: int) -> np.ndarray | None:
        parts, at = [], first
        for start, pcm in self.history:
            if start <= at < start + len(pcm):
                part = pcm[at - start : min(end, start + len(pcm)) - start]
                parts.append(part)
                at += len(part)
            if at >= end:
                return np.concatenate(parts)
        return None

    def step(self, row: dict) -> list[dict]:
        if row.get("song_hit"):
            return []
        sequence, start = int(row["sequence"]), int(row["stream_start_frame"])
        if row["anchors"] is None:
            self._forget()
            self.last_sequence = sequence
            return []
        out: list[dict] = []
        if self.last_start is not None and start < self.last_start:
            out += self._finished()
            self._forget()
            self.done, self.epoch = set(), self.epoch + 1
        if self.last_sequence > 0 and sequence != self.last_sequence + 1:
            self._forget()
        self.last_sequence, self.last_start = sequence, start
        hop = self._stitched(np.asarray(row["pcm"], np.int16).reshape(-1, self.channels))
        begin = start + self.offset
        self.history = [*self.history, (begin, hop)][-self.HISTORY :]
        found = pieces(list(row["anchors"]), begin, self.hop)
        if not found:
            self.song = None
        for p in found:
            out += self._take(p, hop[p["stream_start"] - begin : p["stream_end"] - begin])
        return out

    def _take(self, p: dict, pcm: np.ndarray) -> list[dict]:
        if not p["revision"]:
            self.song = None
            return []
        out: list[dict] = []
        key = (self.epoch, p["start_rtp"])
        s = self.song
        if s is not None and s["key"] == key:
            off = p["track_start"] - s["expected"]
            resync = p["revision"] != s["revision"] and abs(off) <= self.rate // 2
            if (off and not resync) or abs(p["track_duration_frame"] - s["duration"]) > self.rate // 2:
                out += self._finished()
                self.epoch, self.done = self.epoch + 1, set()
                key, s = (self.epoch, p["start_rtp"]), None
            else:
                s["revision"] = p["revision"]
                if s["frames"] <= 2 * self.rate:
                    s.update({k: p[k] or s[k] for k in ("title", "artist", "album")})
        if s is None or s["key"] != key:
            out += self._finished()
            if key in self.done:
                return out
            s = self.song = {"key": key, "revision": p["revision"], **{k: p[k] for k in ("title", "artist", "album")}, "duration": p["track_duration_frame"], "first": p["track_start"], "frames": 0, "pcm": [], "stream": p["stream_start"], "expected": p["track_start"], "recoveries": 0, "misses": 0}
            if p["track_start"] > 0:
                prefix = self._prefix(p["stream_start"] - p["track_start"], p["stream_start"])
                if prefix is None:
                    s["misses"] = 1
                else:
                    s.update(first=0, frames=len(prefix), pcm=[prefix], recoveries=1)
        if s["stream"] != p["stream_start"]:
            self._forget()
            return out
        s["pcm"].append(pcm)
        s.update(frames=s["frames"] + len(pcm), stream=p["stream_end"], expected=p["track_end"])
        return out + (self._finished() if s["frames"] >= s["duration"] else [])
