"""Text functions: identity folding, timed lyrics, clock texts, escapes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC, case folded, white space runs as one space and none at the ends; null stays null (SF1). Spark has neither NFKC nor case folding."""
    return s.map(lambda t: None if t is None else _SPACE.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefolded(s: pd.Series) -> pd.Series:
    """Case folded as Unicode has it, which lower() does not do."""
    return s.str.casefold()


def folded_ascii(c: Column) -> Column:
    """folded() where all text is ASCII, without leaving the JVM."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


#: A timestamp has minutes of one to three digits; the offset tag is in milliseconds and has its line to itself.
STAMP = r"\[(\d{1,3}):([0-5]?\d(?:\.\d{1,3})?)\]"
OFFSET = r"(?im)^[ \t]*\[offset:([+-]?\d+)\][ \t]*$"
MOST_BYTES, MOST_CHARS = 1_000_000, 4096


def lyric_lines(text: Column) -> Column:
    """array<struct<time_seconds, text>> of an LRC text, in order of time, then of appearance (SF2, TK8).

    A line counts if it starts with a timestamp; its text follows its last one, and each of its timestamps gives an
    element. The last offset tag is added to every time; times below 0 become 0 and are rounded to 3
    decimals. Lines without text are left out. Null for a text above MOST_BYTES.
    """
    offset = _last_offset(text)
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    starts = r"^\[\d{1,3}:[0-5]?\d(?:\.\d{1,3})?\]"

    def times(line: Column, at: Column) -> Column:
        words = F.substr(F.trim(F.regexp_replace(line, f"^.*{STAMP}", "")), F.lit(1), F.lit(MOST_CHARS))
        minutes, seconds = (F.regexp_extract_all(line, F.lit(STAMP), F.lit(i)) for i in (1, 2))
        every = F.zip_with(minutes, seconds, lambda m, s: F.struct(F.round(F.greatest(F.lit(0.0), m.cast("double") * 60 + s.cast("double") + offset), 3).alias("time_seconds"), at.alias("line"), words.alias("text")))
        return F.filter(every, lambda x: F.length(x["text"]) > 0)

    timed = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"].rlike(starts))
    every = F.flatten(F.transform(timed, lambda y: times(y["x"], y["i"])))
    ordered = F.transform(F.array_sort(every), lambda x: F.struct(x["time_seconds"].alias("time_seconds"), x["text"].alias("text")))
    return F.when(F.octet_length(text) <= MOST_BYTES, ordered)


def _last_offset(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(OFFSET), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1).cast("double") / 1000, F.lit(0.0))


def sequence_name(prefix: str, sequence: Column) -> Column:
    """A name with the sequence as eight digits (SF4)."""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(sequence.cast("string"), 8, "0"))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour (SF8)."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def truncated(c: Column, most: int) -> Column:
    """Trimmed, then at most ``most`` characters (SF3, FL12)."""
    return F.substr(F.trim(c), F.lit(1), F.lit(most))


def hresult(c: Column) -> Column:
    """0x and eight upper-case hex digits, or null if it isn't such a code (SF7)."""
    return F.when(F.trim(c).rlike("^0[xX][0-9A-Fa-f]{8}$"), F.concat(F.lit("0x"), F.upper(F.substr(F.trim(c), F.lit(3)))))


def file_stem(name: Column) -> Column:
    """Lower case, without folder and last extension."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"(?<=.)\.[^.]*$", ""))
