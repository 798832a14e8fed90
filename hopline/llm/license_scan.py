"""License scans by diagonal voting, in DataFrame operations only.

A document's words give one hash for each run of K words. A join with the hashes of the templates' runs (a fixed table of
a few thousand rows at most, so it is broadcast) leaves the places that occur in a template; the words themselves are compared
there. Each place votes for a template and its diagonal, place in the text less place in the template. Diagonals at most
GAP apart are merged, so a notice with a few words put in or left out stays together. A stretch of merged diagonals as wide as
the template is long gives its label where it covers COVER of the template's runs.

A base phrase counts where all its runs lie on one diagonal: there its words stand consecutively.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null or empty text has none; its row has n_words 0,
no places (null first_word and last_word), empty labels and score 0. Repeated rows are scanned each for itself. A very long text
is one row of one task, and takes time in proportion to its words. An empty table gives an empty result. Columns other than doc_id
and text are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm._shared import blank

K = 3
GAP = 2
COVER = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices and opening words of common licences, with labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
]


#: Whole licence texts without their names of owners, with labels.
TEXTS = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
]


def template_grams(base: list = BASE, notices: list | None = None) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, is_base, place in it, its number of runs, the run's words) for each run of K words of templates of any length."""
    out = []
    for t, (phrase, label) in enumerate([*base, *(NOTICES + TEXTS if notices is None else notices)]):
        w = re.findall(WORD, phrase.lower())
        if len(w) < K:
            raise ValueError(f"a template has {K} words at least: {phrase}")
        out += [(t, label, t < len(base), i, len(w) - K + 1, " ".join(w[i : i + K])) for i in range(len(w) - K + 1)]
    return out


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() does it and changes other letters only into others, but for the two it turns into ASCII."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def scan(docs: DataFrame, base: list = BASE, notices: list | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = template_grams(base, notices)
    values = ", ".join(f"({t}, '{label}', {str(b).lower()}, {i}, {n}, '{g}')" for t, label, b, i, n, g in rows)
    grams = spark.sql(f"select * from values {values} as t(template, label, is_base, at, runs, gram)")
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    none = spark.sql("select -1 template, '' label, false is_base, 0 at, 1 runs, '' gram, 0L hash")
    grams = F.broadcast(grams.unionByName(none).withColumnRenamed("gram", "own"))

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lowered(blank()), F.lit(WORD), F.lit(0)).alias("words"))
    w = F.col("words")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)]))
    # a row holds its run alone, not the text; the leading empty run keeps a row for every document: it meets the template -1
    each = F.concat(F.array(F.lit("")), F.when(F.size(w) >= K, runs).otherwise(F.array().cast("array<string>")))
    keyed = text.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(each).alias("place", "gram"))
    keyed = keyed.withColumn("hash", F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("gram")))
    met = keyed.join(grams, "hash").where(F.col("gram") == F.col("own"))
    hits = met.select("row", "doc_id", "n_words", "template", "label", "is_base", "at", "runs", (F.col("place") - 1).cast("long").alias("start"))
    hits = hits.repartition("row")

    votes = hits.withColumn("diagonal", F.col("start") - F.col("at")).groupBy("row", "template", "diagonal").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "is_base", "runs")],
        F.collect_set("at").alias("seen"))
    votes = votes.withColumn("full", F.col("is_base") & (F.size("seen") == F.col("runs")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > GAP).cast("int"), F.lit(0))
    spans = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(along))
    # from each diagonal on: what a stretch as wide as the template covers of it
    stretch = F.expr(f"collect_list(seen) over (partition by row, template, span order by diagonal / cast(runs + {GAP} as double) range between current row and 0.999999D following)")
    cover = F.size(F.array_distinct(F.flatten(stretch))) / F.col("runs")
    merged = spans.withColumn("cover", F.when(F.col("template") >= 0, cover).otherwise(F.lit(0.0))).groupBy("row", "template", "span").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "is_base")], F.max("cover").alias("cover"),
        F.sum(F.col("full").cast("long")).alias("places"), F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last"))
    notice = (F.col("template") >= 0) & ~F.col("is_base") & (F.col("cover") >= COVER)
    per = merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.collect_set(F.when(F.col("places") > 0, F.col("label"))).alias("own"), F.collect_set(F.when(notice | (F.col("places") > 0), F.col("label"))).alias("all"), F.max("cover").alias("score"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return per.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("own").alias("base_labels"), joined("all").alias("labels"), "score")
