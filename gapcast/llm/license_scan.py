"""Licence scan: sparse TF-IDF cosine with templates, then inheritance from the nearest directory.

DataFrame functions only. Every text is searched whole for passages that can come
close to a template: single lines, blocks of lines between blank ones, sentences,
runs of up to five sentences, and the text as one. A file whose words, all taken
together, cannot bring any template up to the threshold is not cut into passages.
Passages and templates become sparse TF-IDF vectors, with document frequencies
counted over all files. Licences of one family differ in a word or a number that
weighs little, so a passage must also hold the words that tell its licence from
the others, and an SPDX tag allows the licence that it names and no other. A file
takes the licence of its closest passage; a file that is a licence text as a
whole, or is named like one, stands for its directory and for everything below
that has no licence of its own.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.llm.tables import lower_ascii, stage

# Per licence the words that its passages hold (one of each group), and words that they lack.
LICENSES = {
    "MIT": ([("mit", "charge")], ("isc", "fee")),
    "Apache-2.0": ([("apache",), ("2.0", "2")], ()),
    "GPL-2.0": ([("gnu", "gpl"), ("2", "2.0")], ("lesser", "lgpl", "affero", "agpl")),
    "GPL-3.0": ([("gnu", "gpl"), ("3", "3.0")], ("lesser", "lgpl", "affero", "agpl")),
    "LGPL-2.1": ([("lesser", "lgpl"), ("2.1",)], ("affero", "agpl")),
    "LGPL-3.0": ([("lesser", "lgpl"), ("3", "3.0")], ("affero", "agpl")),
    "AGPL-3.0": ([("affero", "agpl"), ("3", "3.0")], ("lesser", "lgpl")),
    "MPL-2.0": ([("mozilla", "mpl"), ("2.0", "2")], ()),
    "EPL-2.0": ([("eclipse", "epl"), ("2.0", "2")], ()),
    "BSD-2-Clause": ([("bsd", "redistributions"), ("2", "reproduce")], ("neither", "endorse", "3")),
    "BSD-3-Clause": ([("bsd", "redistribution", "redistributions", "endorse")], ("2",)),
    "ISC": ([("isc", "fee")], ("mit", "charge")),
    "CC-BY-4.0": ([("cc", "commons"), ("by", "attribution"), ("4.0",)], ("nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives")),
    "CC-BY-NC-4.0": ([("cc", "commons"), ("nc", "noncommercial"), ("4.0",)], ("sa", "sharealike", "nd", "noderivatives")),
    "CC-BY-SA-4.0": ([("cc", "commons"), ("sa", "sharealike"), ("4.0",)], ("nc", "noncommercial")),
    "CC0-1.0": ([("cc",), ("0",), ("1.0",)], ()),
    "Unlicense": ([("unlicense", "unencumbered")], ()),
}
GNU_HEADER = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public "
    "License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later "
    "version."
)
# Usual notices of well-known licences.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GNU_HEADER.format("program", ";", "", ";", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GNU_HEADER.format("program", ":", "", ",", "3")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", GNU_HEADER.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GNU_HEADER.format("library", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", GNU_HEADER.format("program", ":", "Affero ", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: redistributions must retain the above copyright notice, this list of conditions and "
        "the following disclaimer.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    ("ISC", "Licensed under the ISC License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in LICENSES]
SPDX = r"(?i)spdx-license-identifier:\s*([a-z0-9][a-z0-9.+-]*)"
# Sentences of a notice at most.
RUN = 5
NAMES = r"^(?:(?:un)?licen[sc]e|copying|notice)(?:[.-].*)?$"
TERM = r"([0-9]+(?:\.[0-9]+)*|[a-z\x{80}-\x{10FFFF}]+)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(1))


def _vectors(passages: DataFrame, keys: list[str], idf: DataFrame, unseen: Column) -> DataFrame:
    """(keys, term, weight) of term lists: counts times inverse document frequency. Terms go by their hashes."""
    hashed = passages.select(*keys, F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("term"))
    counted = hashed.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return counted.join(idf, "term", "left").withColumn(
        "weight", F.col("n") * F.coalesce("idf", unseen)  # idf has all terms of passages that any file holds
    )


def _needed(templates: list[list[str]], counts: dict[str, int], n: int, least: float) -> list[str]:
    """Terms of which every text holds one whose cosine with a template can come up to ``least``.

    The cosine is at most the root of the sum of squared shares of the template's
    terms that a text holds. So of each template the rarest terms are taken until
    the rest alone cannot come up to ``least``: a text without any of them cannot.
    """
    needed = set()
    for words in templates:
        weights = {w: (words.count(w) * (math.log((n + 1) / (counts.get(w, 0) + 1)) + 1)) ** 2 for w in words}
        total = rest = sum(weights.values())
        for word in sorted(weights, key=lambda w: (counts.get(w, 0), -weights[w], w)):
            if least > 0 and rest < (least**2 - 1e-6) * total:
                break
            needed.add(word)
            rest -= weights[word]
    return sorted(needed)


def _pattern(needed: list[str]) -> str:
    """A pattern that matches a text in lower case which holds one of the terms."""
    letters = "a-z\\x{80}-\\x{10FFFF}"
    names, numbers = ("|".join(re.escape(w) for w in needed if w[0].isdigit() == d) for d in (False, True))
    either = [f"(?<![{letters}])(?:{names})(?![{letters}])"] if names else []
    return "|".join(either + ([f"(?<![0-9])(?:{numbers})(?![0-9])"] if numbers else []))


def _may_reach(held: Column, templates: list[list[str]], counts: dict[str, int], n: int, least: float) -> Column:
    """False where the template terms that a text holds cannot bring its cosine with any template up to ``least``."""
    parts = []
    for words in templates:
        weights = {w: (words.count(w) * (math.log((n + 1) / (counts.get(w, 0) + 1)) + 1)) ** 2 for w in words}
        total = sum(weights.values()) or 1.0
        shares = [F.struct(F.lit(w).alias("word"), F.lit(v / total).alias("share")) for w, v in sorted(weights.items())]
        parts.append(F.array(*shares))

    def reach(template: Column) -> Column:
        return F.aggregate(template, F.lit(0.0), lambda sum_, x: sum_ + F.when(F.array_contains(held, x["word"]), x["share"]).otherwise(0.0))

    return F.exists(F.array(*parts), lambda t: reach(t) >= least**2 - 1e-6)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: the optimizer copies no expression through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _sentence_runs(sentences: Column, needed: str) -> Column:
    """All runs of two to RUN sentences around a sentence that matches the pattern."""
    places = F.filter(F.sequence(F.lit(0), F.size(sentences) - 1), lambda k: lower_ascii(F.get(sentences, k)).rlike(needed))

    def around(k: Column) -> Column:
        lengths = F.array(*map(F.lit, range(2, RUN + 1)))
        starts = F.flatten(
            F.transform(lengths, lambda n: F.transform(F.sequence(F.greatest(k - n + 1, F.lit(0)), k), lambda at: F.struct(at.alias("at"), n.alias("n"))))
        )
        return F.transform(F.filter(starts, lambda r: r["at"] + r["n"] <= F.size(sentences)), lambda r: F.array_join(F.slice(sentences, r["at"] + 1, r["n"]), " "))

    return F.flatten(F.transform(places, around))


def _allowed(passage: Column, words: Column) -> Column:
    """The licences that a passage may have: those whose words it holds and lacks, or the one of its SPDX tag."""

    def fits(groups, lacking) -> Column:
        holds = [F.arrays_overlap(words, F.array(*map(F.lit, group))) for group in groups]
        lacks = ~F.arrays_overlap(words, F.array(*map(F.lit, lacking))) if lacking else F.lit(True)
        return reduce(lambda a, b: a & b, holds) & lacks

    fitting = F.filter(F.array(*[F.when(fits(*rule), F.lit(name)) for name, rule in LICENSES.items()]), lambda name: name.isNotNull())
    tag = F.lower(F.regexp_replace(F.regexp_extract(passage, SPDX, 1), r"(?i)(-only|-or-later|\+)$", ""))
    named = F.filter(F.array(*map(F.lit, LICENSES)), lambda name: F.lower(name) == tag)
    return F.when(tag == "", fitting).otherwise(named)


def _passages(files: DataFrame, needed: str, may_reach: Column) -> DataFrame:
    """(file, place, terms, allowed) of lines, blocks, sentences and runs of them that match the pattern, and of whole texts.

    Only files that ``may_reach`` the threshold are cut.
    """
    kept = _once(files.where(may_reach), sentences=F.split("text", r"(?<=[.!?;])\s+"))
    line = F.expr("split(text, '\n', -1)")
    block = F.expr("split(text, '\n[ \t\r]*\n', -1)")
    single = F.filter(F.concat(line, block, "sentences"), lambda p: lower_ascii(p).rlike(needed))
    parts = F.array_distinct(F.concat(single, _sentence_runs(F.col("sentences"), needed)))
    pieces = kept.select("file", F.posexplode(parts).alias("place", "part"))
    whole = kept.select("file", F.lit(-1).alias("place"), F.col("text").alias("part"))
    found = _once(pieces.unionByName(whole), terms=terms(F.col("part")))
    return found.select("file", "place", "terms", _allowed(F.col("part"), F.col("terms")).alias("allowed")).where(F.size("allowed") > 0)


def _similarities(files: DataFrame, least: float) -> DataFrame:
    """(file, place, license, score) of passages that come up to ``least``: the closest template of each."""
    spark = files.sparkSession
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template int, license string, text string").withColumn("terms", terms(F.col("text")))
    words = [r["terms"] for r in templates.orderBy("template").select("terms").collect()]
    own = sorted({w for t in words for w in t})
    # Counted before the shuffle: what a task sends are its distinct words.
    hashes = F.explode(F.transform(F.array_distinct(terms(F.col("text"))), lambda t: F.xxhash64(t))).alias("term")
    frequency = stage(files.select(hashes).groupBy("term").agg(F.count("*").alias("count")), "license-terms")
    n = files.count()
    known = spark.createDataFrame([(w,) for w in own], "word string").withColumn("term", F.xxhash64("word"))
    counts = {r["word"]: r["count"] for r in frequency.join(F.broadcast(known), "term").collect()}  # one row per template term
    needed = _needed(words, counts, n, least)
    held = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, own)))
    narrowed = _once(files, held=held).where(F.arrays_overlap("held", F.array(*map(F.lit, needed))))
    passages = stage(_passages(narrowed, _pattern(needed), _may_reach(F.col("held"), words, counts, n, least)), "license-passages")
    # One row per word of any file: joined by hash, not broadcast.
    idf = frequency.select("term", (F.log((n + 1) / (F.col("count") + 1)) + 1).alias("idf"))
    unseen = F.lit(math.log(n + 1) + 1)

    weights = _vectors(templates, ["template", "license"], idf, unseen).select("template", "license", "term", "weight")
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    weights = stage(weights.join(norms, "template").select(
        "template", "license", "term", (F.col("weight") / F.col("norm")).alias("share")
    ), "license-weights")

    vectors = stage(_vectors(passages, ["file", "place"], idf, unseen), "license-vectors")
    length = vectors.groupBy("file", "place").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    dots = vectors.join(F.broadcast(weights), "term").groupBy("file", "place", "template", "license").agg(
        F.sum(F.col("weight") * F.col("share")).alias("dot")
    )
    scored = dots.join(length, ["file", "place"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= least)
    scored = scored.join(passages.select("file", "place", "allowed"), ["file", "place"]).where(F.array_contains("allowed", F.col("license")))
    best = scored.groupBy("file", "place").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    return best.select("file", "place", F.col("best.license").alias("license"), (-F.col("best.col1")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """(path, license, origin, score, from_path) of every file row.

    origin is ``own`` (a passage of the file comes up to ``least``; score is its
    cosine), ``inherited`` (from the licence file in the nearest directory above,
    from_path; score is that of the licence file) or ``none``. A directory's
    licence file is the one with the best score, then the least path. Of passages
    with equal scores the licence first in the alphabet counts.

    Null and empty texts have no licence of their own and can inherit; a null path
    does not inherit or pass on. Repeated rows of one path and text are one file
    and give a row each. An empty table gives an empty table. Other columns are
    not read.
    """
    rows = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("file", F.unhex(F.md5(F.concat_ws("\n", F.coalesce("path", F.lit("")), F.md5("text")))))
    found = stage(_similarities(rows, least), "license-passages-scored")
    small = stage(rows.select("file", "path", parent(F.col("path")).alias("dir")), "license-files")
    named = small.select("file", "path").distinct()
    best = found.groupBy("file").agg(F.min(F.struct(-F.col("score"), "license")).alias("b"), F.max(F.col("place") < 0).alias("whole"))
    own = stage(best.select("file", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"), "whole"), "license-own")

    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    stands = own.join(named, "file").where(F.col("path").isNotNull() & (F.col("whole") | name.rlike(NAMES)))
    of_dir = stands.groupBy(parent(F.col("path")).alias("above")).agg(
        F.min(F.struct(-F.col("score"), "path", "license")).alias("s")
    )
    of_dir = stage(of_dir, "license-directories")
    dirs = small.where("path IS NOT NULL").select("dir").distinct()
    steps = F.filter(F.split("dir", "/"), lambda s: s != "")
    climbs = dirs.select(
        "dir",
        F.explode(F.concat(
            F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
        )).alias("above"),
    ).distinct()
    nearest = climbs.join(of_dir, "above").groupBy("dir").agg(F.max_by("s", F.length("above")).alias("s"))
    nearest = stage(nearest.select("dir", "s.path", "s.license", (-F.col("s.col1")).alias("score")), "license-nearest")

    # A directory may hold a third of all files: both sides are files, so large partitions can be split.
    joined = small.join(own.select("file", F.col("license").alias("own"), F.col("score").alias("own_score")), "file", "left").join(
        nearest.select("dir", F.col("path").alias("above"), F.col("license").alias("up"), F.col("score").alias("up_score")), "dir", "left"
    )
    has, gets = F.col("own").isNotNull(), F.col("up").isNotNull() & F.col("path").isNotNull()
    return joined.select(
        F.col("path").alias(path_col),
        F.when(has, F.col("own")).when(gets, F.col("up")).alias("license"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("own_score")).when(gets, F.col("up_score")).alias("score"),
        F.when(~has & gets, F.col("above")).alias("from_path"),
    )
