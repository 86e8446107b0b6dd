"""Licence scans: cosine of licence headers and files to templates by sparse TF-IDF, then inheritance along directories.

Only DataFrame operations.  Equal passages are compared once, however many files carry them.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytoloom.operators.filters import small
from cytoloom.scratch import materialise

LEAST = 0.5
#: Terms of templates up to this many (some 10 MB) are broadcast.
BROADCAST_TERMS = 200_000
#: A comment line starts with one of these.
COMMENT = r"[ \t]*(?://|/?\*|#|--|;|%|<!--|(?i:rem|dnl)\b)"
#: Common words, the most common first; they only decide which terms prove that a passage is worth scoring, never a score.
COMMON = {t: i for i, t in enumerate("the of and to in a is that it on be for an as at are with was from by he or than then this not but had his they which you have has if were been all their there one no do only can we will may what when so any such".split())}
#: Short notices of common licences by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms under the BSD 3-Clause License",
    "CC-BY-4.0": "This work is licensed under Creative Commons CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "Copyright. All rights reserved.",
}


#: Usual headers of source files, and the openings of licences that are pasted instead of named.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal, the public domain dedication"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
]
#: Whole texts of licences, one file each.
TEXTS = Path(__file__).with_name("license_texts")


def template_rows(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str]]:
    """(license, text): the notices, their SPDX lines, and the headers and whole texts of these licences; any number for each."""
    rows = [*templates.items(), *((name, f"SPDX-License-Identifier: {name}") for name in templates), *(x for x in HEADERS if x[0] in templates)]
    return rows + [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")) if p.stem in templates]


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, line) of template_rows."""
    return spark.createDataFrame(template_rows(templates), "license string, line string")


class Model:
    """Weights of the templates' terms: (1 + ln(count)) * (ln((1 + N) / (1 + df)) + 1), N and df over the templates alone.

    So a score depends on the passage and the templates, never on what other files hold; a term that no template has
    weighs as one with df 0.  There are few templates, and they are worked out on the driver.
    """

    def __init__(self, templates: DataFrame, least: float):
        rows = [(r["license"], Counter(re.findall("[a-z0-9]+", (r["line"] or "").lower()))) for r in templates.select("license", "line").collect()]
        n, df = len(rows), Counter(t for _, tf in rows for t in tf)
        self.idf, self.none, self.least = {t: log((1 + n) / (1 + d)) + 1 for t, d in df.items()}, log(1 + n) + 1, least
        self.terms, self.rare = [], set()
        for i, (name, tf) in enumerate(rows):
            w = {t: (1 + log(k)) * self.idf[t] for t, k in tf.items()}
            norm = sqrt(sum(x * x for x in w.values()))
            self.terms += [(i, name, t, x / norm) for t, x in w.items()]
            # A passage that shares only terms of a smaller norm than ``least`` has a smaller cosine too, by Cauchy and
            # Schwarz; so one term of the others must be in it.  Any order will do; common words are the first left out.
            rest = 0.0
            for t in sorted(w, key=lambda t: (COMMON.get(t, len(COMMON)), -df[t], t)):
                rest += (w[t] / norm) ** 2
                if rest >= least * least * (1 - 1e-5):
                    self.rare.add(t)

    def proves(self, known: Column) -> Column:
        """False only for passages of these known words whose cosine to all templates is below ``least``: a rare term must be there."""
        return F.exists(known, lambda w: _among(w, self.rare))

    def square(self, known: Column) -> Column:
        """A sum over known words for ``fits``: the largest squared idf, or that of the band of lower idf that a word is in."""
        most, below = max((x**2 for x in self.idf.values()), default=0.0), 0.0
        square = F.size(known) * most
        for top in (1.7, 2.5):
            band = {t for t, x in self.idf.items() if below < x <= top}
            square, below = square - F.size(F.filter(known, lambda w: _among(w, band))) * (most - max((self.idf[t] ** 2 for t in band), default=most)), top
        return square

    def fits(self, square: Column, strange: Column, lines: int = 1) -> Column:
        """False only for passages of known words of this ``square`` and so many strange terms whose cosine to all templates is below ``least``.

        The terms that no template has must not alone make the norm too long: as (1 + ln(k))^2 is at most 4 k / e, each
        known word adds a bounded square.  Of ``lines`` lines that together fit, one at least fits with that number: the
        strange terms of all are as many as those of any line, or more.
        """
        factor = 1.4716 * (1 / max(self.least - 1e-5, 1e-9) ** 2 - 1)
        return strange * self.none**2 <= square * factor * lines


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _among(word: Column, terms: set[str]) -> Column:
    return word.isin(sorted(terms)) if terms else F.lit(False)


def score_lines(lines: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(line, license, score): the best template of each distinct passage, score rounded to 6 places, ties by name.

    Passages that share no term with a template are left out.  Weights are those of Model.
    """
    return _scores(lines, Model(templates, least))


def _scores(lines: DataFrame, model: Model) -> DataFrame:
    spark = lines.sparkSession
    few = F.broadcast if len(model.terms) <= BROADCAST_TERMS else lambda df: df
    idf = few(spark.createDataFrame(list(model.idf.items()), "term string, idf double"))
    t = few(spark.createDataFrame(model.terms, "template int, license string, term string, t double"))
    passages = materialise(lines.select("line").distinct().withColumn("key", F.md5("line")), "passages")
    own = passages.select("key", F.explode(_words(F.col("line"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weight = (1 + F.log("tf")) * F.coalesce("idf", F.lit(model.none))
    w = materialise(own.join(idf, "term", "left").select("key", "term", weight.alias("w")), "terms")
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.join(t, "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosine = dots.join(norm, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = cosine.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("against"), "license")).alias("b"))
    return passages.join(best, "key").select("line", F.col("b.license").alias("license"), (-F.col("b.against")).alias("score"))


def _passages(text: Column, whole: Column) -> Column:
    """All passages of a text, of which header_lines makes those that may matter: lines, two lines running, paragraphs, runs of comment lines and, where ``whole`` says so, the whole text."""
    lines = F.split(text, "\r?\n")
    pairs = F.zip_with(F.slice(lines, F.lit(1), F.size(lines) - 1), F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.concat(a, F.lit(" "), b))
    paragraphs = F.split(text, r"\n[^A-Za-z0-9\n]*(?=\n)")
    runs = F.split(F.regexp_replace(text, rf"(?m)^(?!{COMMENT}).*$", "\0"), "\0")
    return F.concat(lines, F.when(F.size(lines) > 1, pairs).otherwise(F.array().cast("array<string>")), paragraphs, runs, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))


def _terms(passages: Column, model: Model) -> Column:
    """(line, known, strange) of each passage: the words that templates have, and the number of distinct ones that none has."""
    words = F.transform(passages, lambda x: F.struct(x.alias("line"), _words(x).alias("words")))
    split = F.transform(words, lambda p: F.struct(p["line"].alias("line"), F.size(F.array_distinct(p["words"])).alias("terms"), F.filter(p["words"], lambda w: _among(w, set(model.idf))).alias("known")))
    return F.transform(split, lambda p: F.struct(p["line"].alias("line"), p["known"].alias("known"), (p["terms"] - F.size(F.array_distinct(p["known"]))).alias("strange")))


def _pairs(lines: Column) -> Column:
    """Two lines running of (line, fits, proves), where one fits and one proves; others cannot reach the least score."""
    both = F.zip_with(F.slice(lines, F.lit(1), F.size(lines) - 1), F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.when((a["fits"] | b["fits"]) & (a["proves"] | b["proves"]), F.concat(a["line"], F.lit(" "), b["line"])))
    return F.filter(both, lambda x: x.isNotNull())


def header_lines(files: DataFrame, model: Model) -> DataFrame:
    """(path, dir, whole, line) of each passage of each file whose cosine to a template can reach the model's least.

    Passages are lines, two lines running, paragraphs, runs of comment lines and, where is_license holds, the whole text,
    for which ``whole`` is true.  The words of each line are looked up once; only lines that may matter are looked at
    again, alone and in pairs, and only texts with a term that proves one are cut in other ways.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    cut = files.select("path", "dir", "is_license", "text", F.split("text", "\r?\n").alias("lines")).withColumn("terms", _terms(F.col("lines"), model))
    weighed = F.transform("terms", lambda p: F.struct(p["line"].alias("line"), F.size(p["known"]).alias("known"), p["strange"].alias("strange"), model.square(p["known"]).alias("square"), model.proves(p["known"]).alias("proves")))
    lines = cut.select("path", "dir", "is_license", "text", weighed.alias("lines"))
    # A line without known words adds nothing to its neighbour, which then has to fit alone.
    tried = F.transform("lines", lambda p: F.struct(p["line"].alias("line"), ((p["known"] > 0) & model.fits(p["square"], p["strange"], 2)).alias("fits"), p["proves"].alias("proves")))
    # The whole text has the words of all lines, and at least the strange terms of any one.
    square = F.aggregate("lines", F.lit(0.0), lambda n, p: n + p["square"])
    strange = F.array_max(F.transform("lines", lambda p: p["strange"]))
    lines = lines.select("path", "dir", "is_license", "text", tried.alias("lines"), (F.col("is_license") & model.fits(square, strange)).alias("may"))
    single = F.transform(F.filter("lines", lambda p: p["fits"] & p["proves"]), lambda p: p["line"])
    # A text of one line is its own paragraph.
    longer = F.concat(_pairs(F.col("lines")), F.split(text, r"\n[^A-Za-z0-9\n]*(?=\n)"), F.when(F.col("may"), F.array(text)).otherwise(none))
    runs = F.split(F.regexp_replace(text, rf"(?m)^(?!{COMMENT}).*$", "\0"), "\0")
    passages = F.concat(single, F.when(F.size("lines") > 1, longer).otherwise(none), runs)
    terms = _terms(F.array_distinct(F.transform(passages, lambda x: F.trim(x))), model)
    # Not a filter, which would be moved before the look-up of words and repeat it.
    terms = F.when(F.exists("lines", lambda p: p["proves"]), terms)
    found = lines.select("path", "dir", "may", F.trim(text).alias("all"), F.explode(terms).alias("p"))
    found = found.where(model.proves(F.col("p.known")) & model.fits(model.square(F.col("p.known")), F.col("p.strange")))
    return found.select("path", "dir", (F.col("may") & (F.col("p.line") == F.col("all"))).alias("whole"), "p.line")


def scan_licenses(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """path, own_license, score, license and inherited_from for each distinct path of (path, dir, text, is_license).

    A file's own licence is that of its best passage of score ``least`` or more: a line, two lines running, a paragraph, a
    run of comment lines or, where is_license lets the file be a licence file, its whole text.  Ties go to the licence that
    comes first by name.  Such a file licenses its directory if its whole text, of any length, scores ``least`` or more:
    then the text is a licence or a notice, and not one that only holds a header.  The best of a directory counts, ties
    again by name.  A file without a licence takes that of its nearest directory, itself or an ancestor, that has one; with
    none it has null.  Null and empty texts have no passages; rows of one path are one file.  A null is_license counts as
    false; a null path or directory is the root.
    """
    named = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("dir", F.lit("")).alias("dir"), "text", F.coalesce("is_license", F.lit(False)).alias("is_license"))
    model = Model(templates, least)
    heads = materialise(header_lines(named, model), "heads")
    scores = _scores(heads, model).where(F.col("score") >= least)
    rated = materialise(heads.join(small(scores), "line").select("path", "dir", "whole", "license", "score"), "rated")
    best = F.min(F.struct((-F.col("score")).alias("against"), "license")).alias("b")
    own = rated.groupBy("path").agg(best).select("path", F.col("b.license").alias("own_license"), (-F.col("b.against")).alias("score"))
    of_dir = rated.where("whole").groupBy("dir").agg(best).select(F.col("dir").alias("from_dir"), F.col("b.license").alias("dir_license"))
    place = named.select("path", "dir").distinct()
    dirs = place.select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("from_dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(of_dir, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("near"))
    out = place.join(own, "path", "left").join(small(nearest), "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select("path", "own_license", "score", F.coalesce("own_license", "near.dir_license").alias("license"), F.when(inherits, F.col("near.from_dir")).alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_id; names say nothing, so each can be a licence file if its whole text is one.

    A null source, lang or doc_id has no part in the path: with both of the first null a document lies in the root, and
    those of one directory without a doc_id are one file.
    """
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.concat_ws("/", "source", "lang").alias("dir"), "text", F.lit(True).alias("is_license"))
