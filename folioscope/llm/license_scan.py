"""Operator 5 [native]: licence scans by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Templates are headers in several wordings, identifier lines, notices, titles and full texts of short licences. A text is cut into
segments at its line feeds and sentence ends. Every window of one, two or three segments, and the whole text, is scored against every
template, so that a header counts inside a line, in a line of its own, or wrapped over several. Inverse document frequencies come from all
documents; words that no template has weigh by theirs too. Only texts with an anchor word can reach the threshold: anchors are the template words
without which no cosine could (the other words' share of each template's norm is below the threshold), so that the search for anchors loses nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, named, text_key, unused

#: Names of licences in headers, and what a title of a licence file adds to them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "three-clause BSD license"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}
VERBS = ("Licensed under", "Released under", "Distributed under", "Available under")
#: Titles, notices and full texts.
TEXTS = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}
#: Words of headers that say nothing about the licence; they have no weight.
EMPTY = "a an and are as at be by file for in is it its of on or our package program project software source the these this to under work code dataset data document documentation material library".split()

TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.75
WINDOW = 3
#: Notices longer than WINDOW segments begin with these words; windows of more segments, as many as such a notice has in lines of 60 to 100 characters, begin there.
STARTS = r"\b(?:permission (?:is|to)|redistribution and|the above copyright)\b"
LONGER = list(range(4, 25, 2))
FAMILY = r"(?:mit|apache|bsd|gpl|mpl|cc)"
#: Paths of files that are named as licences: LICENSE, COPYING.txt, MIT-LICENSE, license-apache-2.0.md.
FILE_NAME = rf"(?i)(?:^|/)(?:{FAMILY}[-_])?(?:licen[cs]e|copying)(?:[-_.](?:{FAMILY}[0-9.]*|by|nc|clause|v?[0-9.]+))*(?:\.(?:txt|md|rst|html?))?$"


def templates() -> list[tuple[str, str, Counter]]:
    """(template, licence, counts of its words) of all wordings."""
    texts = [(name, f"{verb} the {said}" if "icense" in said else f"{verb} {said}") for name, known in NAMES.items() for said in known for verb in VERBS]
    texts += [(name, f"SPDX-License-Identifier: {name}{kind}") for name in NAMES for kind in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    texts += [(name, text) for name, known in TEXTS.items() for text in known]
    counts = [(name, Counter(w for w in re.findall(TERM, text.lower()) if w not in EMPTY)) for name, text in texts]
    return [(f"{name}#{i}", name, count) for i, (name, count) in enumerate(counts)]


def anchors(idf: dict[str, float]) -> list[str]:
    """Words without which no cosine can reach the threshold; the most frequent words are left out first."""
    vectors = []
    for _, _, count in templates():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in count.items()))
        vectors.append({w: n * idf[w] / norm for w, n in count.items()})
    plain: set[str] = set()
    for w in sorted(idf, key=lambda w: (idf[w], len(w), w)):
        if max(sum(x * x for t, x in v.items() if t in plain or t == w) for v in vectors) < (THRESHOLD - 0.01) ** 2:
            plain.add(w)
    return sorted(idf.keys() - plain)


def constant(spark: SparkSession, columns: str, rows: list[str]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({r})' for r in rows)} AS t({columns})")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def document_idf(df: DataFrame, text: str) -> DataFrame:
    """(term, idf) of all words of all documents."""
    n = df.count()
    counts = df.select(F.explode(F.array_distinct(terms(named(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.select("term", F.round(1 + F.log((1.0 + F.lit(n)) / (1.0 + F.col("n"))), 6).alias("idf"))


def similarities(df: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, pos, segments, license, similarity, mostly) of distinct texts (h1 and h2 are their hash): each window of up to WINDOW segments, longer ones where a notice begins, and the
    whole text as window of no segments (0) at -1, whose cosine to a template reaches THRESHOLD; the most similar template counts, of equals the smaller licence.
    `mostly`: half of the words of a whole text, by number and not by weight, are a template's that it is so similar to.
    """
    spark, known = df.sparkSession, templates()
    vocabulary = sorted({w for _, _, count in known for w in count})
    frequencies = checkpoint(document_idf(df, text))
    rare = round(1 + math.log(1.0 + df.count()), 6)
    # the templates' words are a few hundred, whatever the documents are
    idf = dict.fromkeys(vocabulary, rare) | {r["term"]: r["idf"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}
    anchor = "|".join(re.escape(a) for a in sorted(anchors(idf), key=len, reverse=True))
    some = df.select(named(text).alias("text")).where(F.lower("text").rlike(rf"(?<![a-z0-9])(?:{anchor})(?![a-z0-9])"))
    # copies of a text are scored once
    distinct = checkpoint(some.withColumn("k", text_key(F.col("text"))).groupBy("k.h1", "k.h2").agg(F.first("text").alias("text")))
    segments = F.split(F.regexp_replace(F.lower("text"), r"([.!?])[ \t]+", "$1\n"), "\n", -1)
    found = rf"(?<![a-z0-9])(?:{anchor})(?![a-z0-9])"
    # the segments come out of a generator, so that they are made once; windows without an anchor can't reach the threshold
    cut = distinct.select("h1", "h2", F.explode(F.array(segments)).alias("segments"))
    hit = cut.withColumn("hit", F.filter(F.sequence(F.lit(0), F.size("segments") - 1), lambda i: F.get("segments", i).rlike(found)))
    starts = [(back, size) for size in range(1, WINDOW + 1) for back in range(size)]
    around = lambda i: F.array(*[F.struct((i - back).alias("at"), F.lit(size).alias("size")) for back, size in starts])
    begun = F.filter(F.sequence(F.lit(0), F.size("segments") - 1), lambda i: F.get("segments", i).rlike(STARTS))
    below = lambda i: F.array(*[F.struct(i.alias("at"), F.lit(size).alias("size")) for size in LONGER])
    both = F.concat(F.flatten(F.transform("hit", around)), F.flatten(F.transform(begun, below)))
    windows = hit.select("h1", "h2", "segments", F.explode(F.array_distinct(both)).alias("w")).where((F.col("w.at") >= 0) & (F.col("w.at") < F.size("segments")))
    part = F.array_join(F.slice("segments", F.col("w.at") + 1, F.col("w.size")), "\n")
    windows = windows.select("h1", "h2", F.col("w.at").alias("at"), F.col("w.size").alias("segments"), part.alias("part"))
    whole = distinct.select("h1", "h2", F.lit(-1).alias("at"), F.lit(0).alias("segments"), F.lower("text").alias("part"))
    unit = ["h1", "h2", "at", "segments"]
    words = windows.unionByName(whole).select(*unit, F.explode(F.regexp_extract_all("part", F.lit(f"({TERM})"), 1)).alias("term"))
    words = checkpoint(words.where(~F.col("term").isin(EMPTY)).groupBy(*unit, "term").agg(F.count("*").alias("n")))
    # the words of the few texts with an anchor, not all documents' words, meet the frequencies
    used = checkpoint(words.select("term").distinct().join(frequencies, "term"))
    units = checkpoint(words.join(used, "term").select(*unit, "term", (F.col("n") * F.col("idf")).alias("w"), "idf", "n"))
    norm = units.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("size"))
    lengths = {k: math.sqrt(sum((n * idf[w]) ** 2 for w, n in count.items())) for k, _, count in known}
    rows = [f"'{k}', '{name}', '{w}', {n}L, {lengths[k]!r}D" for k, name, count in known for w, n in count.items()]
    template = F.broadcast(constant(spark, "template, license, term, times, length", rows))  # a constant of a few thousand words
    dot = units.join(template, "term").groupBy(*unit, "template", "license").agg((F.sum(F.col("w") * F.col("times") * F.col("idf")) / F.first("length")).alias("dot"), F.sum("n").alias("covered"))
    scored = dot.join(norm, unit).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= THRESHOLD)
    mostly = F.bool_or((F.col("segments") == 0) & (2 * F.col("covered") >= F.col("size"))).alias("mostly")
    best = scored.groupBy(*unit).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("m"), mostly)
    return best.select("h1", "h2", F.col("at").alias("pos"), "segments", F.col("m.license").alias("license"), (-F.col("m.s")).alias("similarity"), "mostly")


def scan(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """`df` with license, similarity and origin per row; columns of these names are replaced. A text's own licence is that of its most similar window or of
    itself as a whole, the first of equals, and of these the shortest window: origin "own". A text with an own licence is a licence file of its directory if its path is named as one
    (FILE_NAME) or if its whole text reaches the threshold and half of its words are that template's, whatever its length (so that a source file below a notice is none); of the files of a directory those named as licences count before others, then the most similar, ties to
    the smaller licence. Any other text takes the licence of the nearest directory above it, the top of relative paths included, that has a licence file:
    origin "inherited", else origin "none" and nulls. Null and empty texts have no licence of their own; a null path inherits nothing; rows that repeat
    have the same result each.
    """
    found = checkpoint(similarities(df, text))
    order = F.min(F.struct((-F.col("similarity")).alias("s"), "pos", "segments", "license")).alias("m")
    own = found.groupBy("h1", "h2").agg(order, F.bool_or("mostly").alias("file"))
    own = checkpoint(own.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("m.license").alias("own"), (-F.col("m.s")).alias("own_similarity"), "file"))
    kept = [c for c in df.columns if c not in ("license", "similarity", "origin")]
    # all columns ride along as one, so that none can clash
    rest, place, key = F.struct(*map(named, kept)).alias("rest"), named(path).alias("path"), text_key(F.coalesce(named(text), F.lit("")))
    files = df.select(rest, place, F.regexp_extract(named(path), "^(.*)/[^/]*$", 1).alias("dir"), key.alias("k"))
    local = files.join(own, (F.col("k.h1") == F.col("o1")) & (F.col("k.h2") == F.col("o2")), "left")
    is_named = F.col("path").rlike(FILE_NAME)
    holders = local.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (is_named | F.col("file")))
    holders = checkpoint(holders.groupBy("dir").agg(F.min(F.struct(F.when(is_named, 0).otherwise(1).alias("f"), (-F.col("own_similarity")).alias("s"), F.col("own").alias("license"))).alias("m")).select(F.col("dir").alias("above"), "m.license", (-F.col("m.s")).alias("similarity")))
    # directories, not files, look for their ancestors
    parts = F.split("dir", "/")
    up = files.where("path is not null").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = checkpoint(up.join(holders, "above").groupBy(F.col("dir").alias("in_dir")).agg(F.max_by(F.struct("license", "similarity"), "depth").alias("i")))
    out = local.join(nearest, (F.col("dir") == F.col("in_dir")) & F.col("path").isNotNull(), "left")
    has = F.col("own").isNotNull()
    added = (F.coalesce("own", "i.license").alias("license"), F.when(has, F.col("own_similarity")).otherwise(F.col("i.similarity")).alias("similarity"), F.when(has, "own").when(F.col("i").isNotNull(), "inherited").otherwise("none").alias("origin"))
    return out.select(*[F.col("rest").getField(c).alias(c) for c in kept], *added)


def document_path() -> Column:
    """Documents as files: source / language / a directory of 64 ids / id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 64).cast("long").cast("string"), F.col("doc_id").cast("string"))


def licences(df: DataFrame) -> DataFrame:
    """The result of op5."""
    return scan(df.select("doc_id", document_path().alias("path"), "text")).select("doc_id", "path", "license", "similarity", "origin")


def sql() -> str:
    known = ", ".join(f"('{k}', '{name}', '{w}', {n})" for k, name, count in templates() for w, n in count.items())
    empty = ", ".join(f"'{w}'" for w in EMPTY)
    starts = ", ".join(f"({back}, {size})" for size in range(1, WINDOW + 1) for back in range(size))
    return f"""
WITH template(template, license, term, times) AS (VALUES {known}),
place(back, segments) AS (VALUES {starts}),
frequency AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TERM}'))) AS term FROM documents) GROUP BY term),
total AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, round(1 + ln((1.0::DOUBLE + (SELECT n FROM total)) / (1.0::DOUBLE + coalesce(f.n, 0))), 6) AS idf FROM (SELECT term FROM frequency UNION SELECT term FROM template) LEFT JOIN frequency f USING (term)),
lengths AS (SELECT template, sqrt(sum((times * idf) ** 2)) AS length FROM template JOIN idf USING (term) GROUP BY template),
split AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
segments AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS segment FROM split),
words AS (SELECT doc_id, pos, term, count(*) AS n FROM (SELECT doc_id, pos, unnest(regexp_extract_all(segment, '{TERM}')) AS term FROM segments) WHERE term NOT IN ({empty}) GROUP BY ALL),
begun AS (SELECT doc_id, pos, size FROM segments, (VALUES {", ".join(f"({n})" for n in LONGER)}) t(size) WHERE regexp_matches(segment, '{STARTS}')),
units AS (
  SELECT doc_id, pos - back AS pos, segments, term, sum(n) AS n FROM words, place WHERE pos >= back GROUP BY ALL
  UNION ALL SELECT doc_id, -1, 0, term, sum(n) FROM words GROUP BY ALL
  UNION ALL SELECT w.doc_id, b.pos, size, term, sum(n) FROM begun b JOIN words w ON w.doc_id = b.doc_id AND w.pos >= b.pos AND w.pos < b.pos + size GROUP BY ALL),
weighted AS (SELECT doc_id, pos, segments, term, n, n * idf AS w, idf FROM units JOIN idf USING (term)),
norms AS (SELECT doc_id, pos, segments, sqrt(sum(w * w)) AS norm, sum(n) AS size FROM weighted GROUP BY ALL),
scored AS (
  SELECT doc_id, pos, segments, license, round(dot / length / norm, 6) AS similarity, segments = 0 AND 2 * covered >= size AS mostly
  FROM (SELECT doc_id, pos, segments, template, license, sum(w * times * idf) AS dot, sum(n) AS covered FROM weighted JOIN template USING (term) GROUP BY ALL) JOIN lengths USING (template) JOIN norms USING (doc_id, pos, segments)
  WHERE round(dot / length / norm, 6) >= {THRESHOLD}),
own AS (SELECT doc_id, license, similarity FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, pos, segments, license) = 1),
whole AS (SELECT DISTINCT doc_id FROM scored WHERE mostly),
files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || (doc_id // 64) AS dir FROM documents),
local AS (SELECT * FROM files LEFT JOIN own USING (doc_id)),
named AS (SELECT dir AS above, license, similarity FROM local SEMI JOIN whole USING (doc_id) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1),
near AS (SELECT d.dir, n.license, n.similarity FROM (SELECT DISTINCT dir FROM files) d JOIN named n ON d.dir = n.above OR n.above = '' OR starts_with(d.dir, n.above || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(n.above) DESC) = 1)
SELECT l.doc_id, l.dir || '/' || l.doc_id AS path, coalesce(l.license, n.license) AS license, coalesce(l.similarity, n.similarity) AS similarity,
  CASE WHEN l.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM local l LEFT JOIN near n USING (dir)
"""
