"""License scans: sparse TF-IDF cosine of lines and whole files to licence templates, then inheritance from the nearest ancestor directory.

In DataFrame functions only. A file's segments are its lines with a cue word (a notice in a header or anywhere else) and the
file as a whole if it begins with such a line (a licence file). Where no line is a template word for word, word windows around each cue word are
segments too, as long as the shorter templates: notices inside lines, over line ends and between other words. A segment's terms are runs of letters, digits, dots and
hyphens, lower-cased; a term's weight is its count times its idf over the templates, and terms no template has count in
the segment's length. The best template with cosine THRESHOLD (windows: WINDOW_THRESHOLD) or more wins, ties going to the licence id that sorts
first. The best segment gives the file its own licence.

A directory's licence is that of its licence files (first line a licence notice), the smallest path first. A file without an own licence takes that
of its own directory or of the nearest ancestor that has one: directories, not files, are joined with their ancestors, and files then with their
own directory only. Templates are a fixed, short table, so they are broadcast.

Null and empty texts have no segment; a null path has no directory. Rows that repeat a key and path are files of their own (rows are told apart by a 64-bit hash of key, path and text; equal rows
have equal answers). A table without rows gives none, and further columns are not read. Of very long texts only lines with a cue and windows around cue words go on.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
CUES = r"(?i)licen[sc]e|copyright|spdx|permission is hereby granted|redistribution and use"
TERM = r"[a-z0-9][a-z0-9.\-]*"

#: Notices by which files name their licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
)

#: Names, headers and bodies beside these. The SQL knows TEMPLATES only, so it agrees where files hold those notices as whole lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = (("AGPL-3.0", "GNU Affero General Public License", "3"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"))
_SPDX = ("AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
FURTHER: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_END),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", _ISC),
    ("MIT", "MIT License"),
    ("MIT", _MIT),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    *((name, f"{title}, version {n}") for name, title, n in _GNU),
    *((name, f"{title} as published by the Free Software Foundation, either version {n} of the License") for name, title, n in _GNU),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
)

#: Word windows are as long as templates of up to so many words, lie around a cue word, and need nearly all of a template's weight.
LONGEST, WINDOW_THRESHOLD = 30, 0.9
CUE_TERM = r"licen[sc]e|copyright|spdx|^hereby$|^redistribution$"


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight over the template's length), idf by term, and the idf of a term that no template has."""
    counts = [Counter(t.rstrip(".-") for t in re.findall(TERM, text.lower())) for _, text in templates]
    frequency = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(frequency.items())}
    rows = []
    for k, (c, (name, _)) in enumerate(zip(counts, templates, strict=True)):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in sorted(c.items())))
        rows += [(k, name, t, n * idf[t] / length) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(templates)) + 1


def _segments(files: DataFrame, key: str) -> DataFrame:
    """key, path, segment number, text, first: lines with a cue (from 1), and number 0 for the whole of a file that begins with one."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda s: s["line"].rlike(CUES))
    found = files.where(F.col("text").rlike(CUES)).select(key, "path", "text", lines.alias("lines"))
    begins = F.regexp_extract("text", r"\A\s*([^\n]*)", 1).rlike(CUES)
    every = F.when(begins, F.concat("lines", F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("line"))))).otherwise(F.col("lines"))
    return found.select(key, "path", begins.alias("leads"), F.explode(every).alias("s")).select(key, "path", "leads", F.col("s.n").alias("segment"), F.col("s.line").alias("line"))


def _terms(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})")), lambda t: F.regexp_replace(t, r"[.\-]+$", ""))


def _scored(terms: DataFrame, by: list[str], templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """by, licence, score: the cosine of each segment (the rows with the same by, one for each of its terms) to each template that it shares a term with."""
    rows, idf, unknown = template_weights(templates)
    spark = terms.sparkSession
    weights = spark.createDataFrame(rows, "template int, licence string, term string, w double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    counted = terms.groupBy(*by, "term").agg(F.count("*").alias("n"))
    weighted = counted.join(F.broadcast(idfs), "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    lengths = weighted.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "v"))).alias("known"))
    dots = lengths.select(*by, "length", F.explode("known").alias("k")).select(*by, "length", "k.*")
    return dots.join(F.broadcast(weights), "term").groupBy(*by, "template", "licence").agg((F.sum(F.col("v") * F.col("w")) / F.first("length")).alias("score"))


def _best(scored: DataFrame, by: list[str], least: float) -> DataFrame:
    best = scored.where(F.col("score") >= least).groupBy(*by).agg(F.min(F.struct(F.round(-F.col("score"), 6).alias("s"), "licence")).alias("b"))
    return best.select(*by, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _windows(files: DataFrame, key: str, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """key, path, leads, bag: the sorted words of each window around a cue word, across line ends."""
    lengths = sorted({n for _, text in templates if (n := len(re.findall(TERM, text.lower()))) <= LONGEST})
    cued = files.where(F.col("text").rlike(CUES)).select(key, "path", F.regexp_extract("text", r"\A\s*([^\n]*)", 1).rlike(CUES).alias("leads"), _terms(F.col("text")).alias("terms"))
    near = F.transform("terms", lambda t, i: F.when(t.rlike(CUE_TERM), i + 1))
    at = cued.select(key, "path", "leads", "terms", F.explode(F.filter(near, lambda i: i.isNotNull())).alias("cue"))
    # Only the words that a window around the cue can reach go on.
    first = F.greatest(F.lit(1), F.col("cue") - LONGEST + 1)
    at = at.select(key, "path", "leads", F.slice("terms", first, F.lit(2 * LONGEST - 1)).alias("terms"), (F.col("cue") - first + 1).alias("cue"))
    one = lambda n: F.transform(F.sequence(F.greatest(F.lit(1), F.col("cue") - n + 1), F.col("cue")), lambda i: F.array_join(F.array_sort(F.slice("terms", i, F.lit(n))), " "))
    return at.select(key, "path", "leads", F.explode(F.array_distinct(F.concat(*map(one, lengths)))).alias("bag"))


def own_licences(files: DataFrame, key: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES + FURTHER) -> DataFrame:
    """key, path, leads, licence, score, for the files that have a licence: the best of their segments."""
    by = [key, "path", "leads"]
    terms = _segments(files, key).select(*by, "segment", F.explode(_terms(F.col("line"))).alias("term"))
    lines = _best(_scored(terms, [*by, "segment"], templates), by, THRESHOLD)
    # Nothing scores above a line that is a template word for word.
    exact = lines.where(F.col("score") >= 1).select(F.col(key).alias("_k"), F.col("path").alias("_p"))
    rest = files.join(exact, files[key].eqNullSafe(exact["_k"]) & files["path"].eqNullSafe(exact["_p"]), "left_anti")
    windows = _windows(rest, key, templates)
    bags = windows.select("bag").distinct().select("bag", F.explode(F.split("bag", " ")).alias("term"))
    found = windows.join(_best(_scored(bags, ["bag"], templates), ["bag"], WINDOW_THRESHOLD), "bag").select(*by, "licence", "score")
    return _best(lines.unionByName(found), by, THRESHOLD)


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\Z", 1)


def scan_licences(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """files (key, path, text) -> key, path, own_licence, own_score, licence (own or inherited), licence_dir (null if own or none), for every row."""
    files = files.select(F.xxhash64(key, "path", "text").alias("_row"), F.col(key), "path", "text")
    own = own_licences(files, "_row")
    named = files.select("_row", key, "path")
    of_dir = own.where(F.col("leads") & F.col("path").isNotNull()).groupBy(_parent(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "licence")).alias("f")).select("dir", F.col("f.licence").alias("dir_licence"))
    dirs = named.where("path is not null").select(_parent(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    ancestors = dirs.select("own_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("a")).select("own_dir", "a.*")
    nearest = ancestors.join(of_dir, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("n")).select("own_dir", F.col("n.dir").alias("dir"), F.col("n.dir_licence").alias("dir_licence"))
    one = own.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("_row", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score"))
    with_own = named.join(one, "_row", "left")
    full = with_own.withColumn("own_dir", _parent(F.col("path"))).join(nearest, "own_dir", "left")
    inherits = F.col("own_licence").isNull()
    return full.select(key, "path", "own_licence", "own_score", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(inherits, F.col("dir")).alias("licence_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / document id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")))
    return docs.select("doc_id", path.alias("path"), "text")


def licence_digest(docs: DataFrame) -> DataFrame:
    return scan_licences(document_files(docs)).select("doc_id", "path", "own_licence", F.round("own_score", 4).alias("own_score"), "licence", "licence_dir")


def _oracle() -> str:
    """The same in DuckDB SQL over documents."""
    rows, idf, unknown = template_weights()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    weights = ", ".join(f"({k}, {quote(n)}, {quote(t)}, {w!r})" for k, n, t, w in rows)
    idfs = ", ".join(f"({quote(t)}, {x!r})" for t, x in sorted(idf.items()))
    return f"""
WITH w(template, licence, term, w) AS (VALUES {weights}), i(term, idf) AS (VALUES {idfs}),
files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS path, text FROM documents),
cued AS (SELECT *, regexp_matches(regexp_extract(text, '\\A\\s*([^\\n]*)', 1), '{CUES}') AS leads FROM files WHERE regexp_matches(text, '{CUES}')),
lines AS (SELECT doc_id, path, leads, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS segment FROM cued),
segments AS (SELECT doc_id, path, leads, segment, line FROM lines WHERE regexp_matches(line, '{CUES}') UNION ALL SELECT doc_id, path, leads, 0, text FROM cued WHERE leads),
terms AS (SELECT doc_id, path, leads, segment, regexp_replace(unnest(regexp_extract_all(lower(line), '{TERM}')), '[.\\-]+$', '') AS term FROM segments),
counted AS (SELECT doc_id, path, leads, segment, term, count(*) AS n FROM terms GROUP BY ALL),
weighted AS (SELECT c.*, n * coalesce(idf, {unknown!r}) AS v FROM counted c LEFT JOIN i USING (term)),
lengths AS (SELECT doc_id, segment, sqrt(sum(v * v)) AS length FROM weighted GROUP BY ALL),
scored AS (SELECT doc_id, path, leads, segment, template, licence, sum(v * w) / any_value(length) AS score FROM weighted JOIN lengths USING (doc_id, segment) JOIN w USING (term) GROUP BY doc_id, path, leads, segment, template, licence),
own AS (SELECT doc_id, path, leads, licence AS own_licence, round(score, 6) AS own_score FROM scored WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(-score, 6), licence) = 1),
of_dir AS (SELECT regexp_extract(path, '\\A(.*)/[^/]*\\z', 1) AS dir, arg_min(own_licence, path) AS dir_licence FROM own WHERE leads GROUP BY 1),
full_ AS (SELECT f.doc_id, f.path, own_licence, own_score, string_split(regexp_extract(f.path, '\\A(.*)/[^/]*\\z', 1), '/') AS parts FROM files f LEFT JOIN own USING (doc_id))
SELECT doc_id, f.path, own_licence, round(own_score, 4) AS own_score, coalesce(own_licence, a.dir_licence, b.dir_licence) AS licence,
  CASE WHEN own_licence IS NULL THEN coalesce(a.dir, b.dir) END AS licence_dir
FROM full_ f LEFT JOIN of_dir a ON a.dir = parts[1] || '/' || parts[2] LEFT JOIN of_dir b ON b.dir = parts[1]
"""


ORACLE = _oracle()
