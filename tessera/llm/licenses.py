"""License scans by diagonal voting.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text whose A-Z are lower case; null text has none. Templates are word sequences: phrases,
which count where they stand word by word, and notices, which may differ.

* Hashes of all GRAM consecutive words of a document are joined with those of the templates; what a table of bits of the
  templates' hashes excludes does not travel to the join. The joined grams are compared as strings, so every vote is exact.
* A gram at word p that is at word o of a template votes for the diagonal p - o. Votes are summed by document, template and diagonal.
* A phrase stands at each diagonal on which all of its grams voted.
* A word left out or put in moves a notice to a neighbouring diagonal: diagonals of a notice at most BAND apart are merged into a span.
* A span is verified by the share of the notice's words that grams cover (all of a notice with under SHORT words, else LONG percent) and by density: the
  words covered must be at least half of the span's. Of verified spans inside another one, the outer one stays (of equal ones the fullest).

Templates are a parameter; their table is broadcast if it is small. A document's votes are spread over keys of document and template, so a notice that a
third of all documents hold is no hot key. The score is 1 with a phrase, else the largest share covered of a dense span, else 0.

Null doc_id: the document is judged like others. Repeated rows are judged each. Empty and very long texts are scanned whole. Extra columns
are ignored. An empty table gives an empty table; without templates nothing is found. Ties between labels go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared, words

#: Words of a gram; diagonals merged at most so far apart; words under which a notice must be whole; percent of a longer one.
GRAM, BAND, SHORT, LONG = 3, 6, 20, 80
_BITS = 22


class Template(NamedTuple):
    label: str
    text: str
    #: Whether it counts word by word wherever it stands.
    phrase: bool = False


# Phrases and their labels.
PHRASES = [Template("mit", "under the mit license", True), Template("apache-2", "apache license version 2", True), Template("cc-by-nc", "cc by nc", True)]

# Notices of common licenses.
NOTICES = [
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies.",
    ),
    Template(
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law"
        " or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version.",
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"
        " of the License, or (at your option) any later version.",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code"
        " form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]
TEMPLATES = [*PHRASES, *NOTICES]

_SPAN = "label string, phrase boolean, start long, end long, share double"


def _grams(texts: list[bytes]) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """Words, hashes of all runs of GRAM words, and the first words of those that lie in one text."""
    w = words.split(texts, words.NOT_ALNUM, words.LOWER)
    return w, words.windows(w.hashes(), GRAM), words.same_row(w.doc, GRAM)


def table(templates: list[Template]) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, phrase, words, offset, gram, words of the gram) of every gram."""
    out = []
    for k, t in enumerate(templates):
        w, h, _ = _grams([t.text.encode()])
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.text!r}")
        out += [(k, t.label, t.phrase, len(w), o, int(x), w.joined(o, o + GRAM).decode()) for o, x in enumerate(h.view(np.int64))]
    return out


def _scan(hashes: list[int]):
    bits = np.zeros(1 << _BITS, dtype=bool)
    bits[np.array(hashes, dtype=np.int64).view(np.uint64) >> np.uint64(64 - _BITS)] = True

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, texts in words.slices(batch.column("text")):
                w, h, inside = _grams(texts)
                n = len(texts)
                rows = row + np.arange(n)
                row += n
                none = pa.nulls(n)
                counts = pa.array(np.diff(w.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id").slice(begin, n), counts, none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string())], _NAMES)
                at = np.flatnonzero(bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & inside)
                if len(at):
                    none, doc = pa.nulls(len(at), pa.int64()), w.doc[at]
                    text = pa.array([w.joined(i, i + GRAM) for i in at.tolist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), none.cast(batch.column("doc_id").type), none, pa.array(at - w.first[doc]), pa.array(h[at].view(np.int64)), text], _NAMES)

    return apply


_NAMES = ["row", "doc_id", "n_words", "place", "gram", "words"]


def spans(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """Phrases and notices of (row, place, gram, words): row, and a span's columns; notices that are not verified have a null label."""
    votes = candidates.join(grams, ["gram", "words"]).select("row", "template", "label", "phrase", "size", "offset", "place", (F.col("place") - F.col("offset")).alias("diagonal"))
    key = ["row", "template", "label", "phrase", "size"]
    diagonals = votes.groupBy(*key, "diagonal").agg(F.collect_list("offset").alias("offsets"), F.min("place").alias("start"), (F.max("place") + GRAM).alias("end"))
    diagonals = shared.cut(diagonals)
    whole = diagonals.where(F.col("phrase") & (F.size("offsets") == F.col("size") - GRAM + 1))
    whole = whole.select("row", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("share"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(BAND + 1).cast("long")) > BAND
    merged = diagonals.where(~F.col("phrase")).withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    once = merged.select(*key, "span", "start", "end", F.explode("offsets").alias("offset")).groupBy(*key, "span", "offset").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = once.groupBy(*key, "span").agg(F.collect_list("offset").alias("offsets"), F.min("start").alias("start"), F.max("end").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("offsets", lambda o: F.sequence(o, o + GRAM - 1)))))
    found = found.withColumn("covered", covered).where(F.col("covered") * 2 >= F.col("end") - F.col("start"))
    verified = F.col("covered") * 100 >= F.col("size") * F.when(F.col("size") < SHORT, 100).otherwise(LONG)
    found = found.withColumns({"verified": verified, "share": F.col("covered") / F.col("size")})
    before = Window.partitionBy("row", "verified").orderBy("start", F.desc("end"), F.desc("covered"), "label", "template").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))
    label = F.when(F.col("verified") & ~F.col("inner"), F.col("label"))
    notices = found.withColumn("inner", inner).select("row", label.alias("label"), "phrase", "start", "end", "share")
    return whole.unionByName(notices)


def detect(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, and spans (label, phrase, start and end word, share of the template covered), by start."""
    spark = docs.sparkSession
    shared.lean(spark)
    rows = table(templates)
    docs = docs.select("doc_id", "text")
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, place long, gram long, words string"
    scanned = shared.cut(docs.mapInArrow(_scan([r[5] for r in rows]), schema))
    grams = spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, offset int, gram long, words string")
    found = spans(scanned.where("place IS NOT NULL").select("row", "place", "gram", "words"), shared.small(grams))
    listed = found.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "phrase", "share"))).alias("spans"))
    of = scanned.where("place IS NULL").join(listed, F.col("row") == F.col("__row"), "left")
    return of.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans"))


def report(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("spans", lambda s: s["phrase"])
    named = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return detect(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.filter("spans", lambda s: s["label"].isNotNull())).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: list[Template] = TEMPLATES) -> str:
    ws = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"({k}, '{t.label}', {t.phrase}, '{t.text}')" for k, t in enumerate(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ws.format('text')} AS ws FROM documents),
t AS (SELECT t, label, phrase, ws, len(ws) AS size FROM (SELECT t, label, phrase, {ws.format('text')} AS ws FROM (VALUES {rows}) v(t, label, phrase, text))),
tg AS (SELECT t, label, phrase, size, o, array_to_string(ws[o + 1:o + 3], ' ') AS g FROM (SELECT *, unnest(range(0, size - 2)) AS o FROM t)),
dg AS (SELECT r, p, array_to_string(ws[p + 1:p + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 2)) AS p FROM d WHERE len(ws) >= 3)),
v AS (SELECT r, t, label, phrase, size, o, p, p - o AS diag FROM dg JOIN tg USING (g)),
base AS (SELECT r, label, diag FROM v WHERE phrase GROUP BY r, t, label, size, diag HAVING count(*) = size - 2),
dg2 AS (SELECT r, t, diag, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag) <= {BAND} THEN 0 ELSE 1 END AS apart FROM (SELECT DISTINCT r, t, diag FROM v WHERE NOT phrase)),
sp AS (SELECT r, t, diag, sum(apart) OVER (PARTITION BY r, t ORDER BY diag) AS span FROM dg2),
vs AS (SELECT v.*, span FROM v JOIN sp USING (r, t, diag)),
ext AS (SELECT r, t, label, size, span, min(p) AS s, max(p) + 3 AS e FROM vs GROUP BY r, t, label, size, span),
cov AS (SELECT r, t, span, count(DISTINCT x) AS covered FROM (SELECT r, t, span, unnest(range(o, o + 3)) AS x FROM vs) GROUP BY r, t, span),
f AS (SELECT *, covered * 100 >= size * CASE WHEN size < {SHORT} THEN 100 ELSE {LONG} END AS ok FROM ext JOIN cov USING (r, t, span) WHERE covered * 2 >= e - s),
o AS (SELECT r, label, ok, covered / size AS share,
        coalesce(max(e) OVER (PARTITION BY r, ok ORDER BY s, e DESC, covered DESC, label, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= e, false) AS inside FROM f),
al AS (SELECT r, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT r, CASE WHEN ok AND NOT inside THEN label END, share FROM o),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM al GROUP BY r),
b AS (SELECT r, count(*) AS n, min(diag) AS lo, max(diag) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)"""
