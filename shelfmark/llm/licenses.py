"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Only DataFrame functions and Spark's own learner run here.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UNKNOWN = "unknown"

# Names and identifiers of licence families.
NAMES = {
    "MIT": (["MIT License", "MIT/Expat License"], ["MIT"]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0"], ["Apache-2.0"]),
    "GPL": (["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPLv3 license", "GPLv2 or later"], ["GPL-2.0-only", "GPL-3.0-or-later"]),
    "LGPL": (["GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3 license"], ["LGPL-2.1-only", "LGPL-3.0-or-later"]),
    "AGPL": (["GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3 license"], ["AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "BSD": (["BSD License", "3-clause BSD license", "New BSD License", "Simplified BSD License"], ["BSD-2-Clause", "BSD-3-Clause"]),
    "MPL": (["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"], ["MPL-2.0"]),
    "EPL": (["Eclipse Public License, Version 2.0", "Eclipse Public License 1.0"], ["EPL-2.0"]),
    "ISC": (["ISC License"], ["ISC"]),
    "Zlib": (["zlib License", "zlib/libpng license"], ["Zlib"]),
    "Unlicense": (["The Unlicense"], ["Unlicense"]),
    "CC-BY": (["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"], ["CC-BY-4.0"]),
    "CC-BY-SA": (["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"], ["CC-BY-SA-4.0"]),
    "CC-BY-NC": (["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"], ["CC-BY-NC-4.0"]),
    "CC-BY-ND": (["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"], ["CC-BY-ND-4.0"]),
    "CC0": (["CC0 1.0 Universal", "CC0 1.0", "CC0 public domain dedication"], ["CC0-1.0"]),
}
# How a notice names a licence, and an identifier.
PHRASES = [
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.",
    "This work is licensed under a {}.", "This project is licensed under the terms of the {}.", "Available under the {}; see LICENSE.",
]
ID_PHRASES = ["SPDX-License-Identifier: {}", "Distributed under {}", "Licensed under {}", "license = {}"]
# Sentences of licence texts and of the notices that they ask for.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}
# Sentences with the same words that are no licence.
OTHERS = [
    "She renewed her driving license last week.", "The bar lost its liquor license after the fire.", "Poets are granted some license with the truth.",
    "A licensed electrician must inspect the house.", "The copyright holders complained about the ruling.", "Copyright law is taught in the second year.",
    "All rights reserved by the publisher.", "The warranty covers parts and labour for two years.", "You need permission to enter the building.",
    "The court weighed the terms of the license between both firms.", "Fishing without a license is an offence in this state.",
    "A license fee is due each year.", "He was licensed to practise medicine in 1921.", "No part may be reproduced without written permission.",
    "The license plate was found near the river.", "Please read the license before you sign.", "The version of the file is 2.0.", "The public library is free of charge.",
    "Researchers at MIT found a new material.", "The Apache helicopter landed at the base.", "An Apache web server version 2.4 answered.", "The GNU compiler was released in 1987.",
    "The general public was free to attend.", "BSD sockets are taught in the course.", "The students modify the source code of the program.", "Mozilla released a new browser.",
    "An eclipse was visible to the public.", "The commons committee met a creative director.", "Copies of the notice were distributed to all members.", "The software is distributed on three disks.",
    "The authors of the survey name no conditions.", "A copy of the file was obtained at the office.", "The work of the foundation is free of politics.", "The domain was released in public.",
    "Universal rights belong to any person.", "The attribution of the painting is not certain.",
]
# Common words. A pair of two such words is no sign of a licence.
COMMON = [
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "form", "free", "from", "if", "in", "into", "is", "it", "its", "may", "must", "name",
    "names", "nor", "not", "of", "on", "one", "or", "that", "the", "this", "to", "use", "was", "will", "with", "without", "work", "you", "your",
]
# Stretches of long paragraphs; the overlap is longer than any sentence above.
STRETCH_WORDS = 400
OVERLAP_WORDS = 80
# A prediction below this chance is unknown, and so is one without a template that shares more of its word pairs.
LEAST_CHANCE = 0.5
LEAST_SIMILARITY = 0.5
# So many of the left-out sentences that are no licence may pass the calibrated chance.
FALSE_ACCEPTS = 0.05
# Words below this length stand inside many others, so they are looked for as whole words only.
SHORT = 4

# Lines end a paragraph where blank, where a sentence ends, or where too short or too long to have been wrapped.
PARAGRAPH = r"\n(?:(?=[ \t]*\n)|(?<!(?:^|\n)[^\n]{39,119}[^\n.!?:;]\n))"
WORD_GAPS = r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\."


def templates() -> dict:
    """Notices of each family: its names and identifiers in every phrase, and its sentences."""
    out = {}
    for family, (names, ids) in NAMES.items():
        named = [p.format(n) for p in PHRASES for n in names] + [p.format(i) for p in ID_PHRASES for i in ids]
        out[family] = [*named, *(i for i in ids if "-" in i), *SENTENCES.get(family, [])]
    return out


def plain_words(text: str) -> list:
    """The words of a template, as ``_words`` gives them."""
    return re.findall(r"(?:[^\W_]|(?<=\d)\.(?=\d))+", text.lower())


def _pairs_of(words: list) -> set:
    return {" ".join(p) for p in zip(words, words[1:])}


def signs() -> tuple[list, list]:
    """(words, pairs): without any of these words a text holds at most half of each template's pairs.

    Words (no common ones, no numbers) are taken one by one, each time the one that meets most pairs of the templates still
    open, and of those the first by name; ``pairs`` are the templates' pairs that hold one.
    """
    listed = [_pairs_of(plain_words(t)) for ts in templates().values() for t in ts]
    listed = [pairs for pairs in listed if pairs]
    chosen: set = set()

    def free(pairs):
        return [p for p in pairs if chosen.isdisjoint(p.split())]

    while open_pairs := [p for pairs in listed if len(free(pairs)) > LEAST_SIMILARITY * len(pairs) for p in free(pairs)]:
        met = Counter(w for p in open_pairs for w in set(p.split()) - set(COMMON) if w[0].isalpha())
        chosen.add(min(met, key=lambda w: (len(w) < SHORT, -met[w], w)))
    return sorted(chosen), sorted({p for pairs in listed for p in pairs if not chosen.isdisjoint(p.split())})


def vocabulary() -> list:
    """Words, pairs and triples of the templates and of the sentences that are none."""
    listed = [plain_words(t) for ts in [*templates().values(), OTHERS] for t in ts]
    return sorted({" ".join(w[i : i + n]) for w in listed for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAPS), lambda w: w != "")


def _ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _features(rows: DataFrame) -> DataFrame:
    """Adds pairs of words, and which grams of the vocabulary occur."""
    rows = rows.withColumn("_pairs", F.array_distinct(_ngrams(F.col("_words"), 2)))
    rows = rows.withColumn("_grams", F.concat("_words", "_pairs", _ngrams(F.col("_words"), 3)))
    return CountVectorizerModel.from_vocabulary(vocabulary(), "_grams", "features", binary=True).transform(rows).drop("_grams")


def train(spark: SparkSession):
    """(model, families, threshold): sparse logistic regression over word n-grams of the templates.

    Named licences are learned in every phrase; sentences whole and with each of their words left
    out. The threshold is calibrated on sentences that are no licence: a fit without every third of
    them may give at most ``FALSE_ACCEPTS`` of those a higher chance for some family, and it is at
    least ``LEAST_CHANCE``.
    """
    known = templates()
    families = sorted([*known, UNKNOWN])
    rows = []
    for family in families:
        for k, text in enumerate(OTHERS if family == UNKNOWN else known[family]):
            words = plain_words(text)
            rows.append((float(families.index(family)), k, words))
            if family == UNKNOWN or text in SENTENCES.get(family, []):
                rows += [(float(families.index(family)), k, words[:i] + words[i + 1 :]) for i in range(len(words))]
    held = spark.createDataFrame(rows, "label double, k int, _words array<string>").coalesce(1)
    held = _features(held).select("label", "k", "features").cache()
    learner = LogisticRegression(regParam=3e-4, elasticNetParam=0.5, maxIter=60, family="multinomial")
    unknown = families.index(UNKNOWN)
    apart = (F.col("label") == unknown) & (F.col("k") % 3 == 0)
    tried = learner.fit(held.where(~apart)).transform(held.where(apart))
    others = F.array_max(F.transform(vector_to_array("probability"), lambda p, i: F.when(i == unknown, 0.0).otherwise(p)))
    threshold = max(LEAST_CHANCE, tried.agg(F.percentile(others, 1 - FALSE_ACCEPTS)).first()[0])
    model = learner.fit(held)
    held.unpersist()
    return model, families, threshold


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", holding: list | None = None) -> DataFrame:
    """(doc_id, paragraph, start, _words) of every paragraph of every text, long ones in stretches.

    A newline ends a paragraph unless the line before it is wrapped: of 40 to 120 characters, not
    ended like a sentence, and followed by no blank line. Paragraphs of more than ``STRETCH_WORDS``
    words are given in stretches that overlap, ``start`` being the place of the first word.
    ``holding`` leaves out paragraphs without any of these (lower-case) words before they are split.
    """

    def held(part):
        if holding is None:
            return F.lit(True)
        long, short = ([w for w in holding if (len(w) >= SHORT) == wanted] for wanted in (True, False))
        tests = [F.contains(part, F.lit(w)) for w in long]
        if short:
            tests.append(part.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(short)})(?![\p{{L}}\p{{N}}])"))
        return functools.reduce(Column.__or__, tests)

    text = F.replace(F.lower(F.col(text_column)), F.lit("\r\n"), F.lit("\n"))
    texts = docs.select(F.col(id_column).alias("doc_id"), text.alias("_text"))
    parts = texts.select("doc_id", F.posexplode(F.split("_text", PARAGRAPH)).alias("paragraph", "part")).where(held(F.col("part")))
    parts = parts.select("doc_id", "paragraph", _words(F.col("part")).alias("_all"))
    step = STRETCH_WORDS - OVERLAP_WORDS
    last = F.greatest(F.ceil((F.size("_all") - OVERLAP_WORDS) / step).cast("int") - 1, F.lit(0)) * step
    return parts.select("doc_id", "paragraph", "_all", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start")).select(
        "doc_id", "paragraph", "start", F.slice("_all", F.col("start") + 1, STRETCH_WORDS).alias("_words"))


def license_scan(
    docs: DataFrame, trained=None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, paragraph, start, family, chance, similarity, confirmed) of paragraphs like some template.

    Every paragraph of every text is read, numbered from 0 (see ``paragraphs``); those that share a
    pair of words with a template, one of the pair being a sign (see ``signs``), are classified and
    have a row. ``similarity`` is the largest share of the word pairs of one template of the
    predicted family that the paragraph holds; a family is given only where chance and similarity
    both suffice, else ``unknown``. A paragraph without a sign could not be confirmed and has no
    row, nor have null and empty texts. Equal chances go to the family first by name; repeated rows
    give repeated results, null ids keep theirs, other columns are not looked at.
    """
    model, families, threshold = trained or train(docs.sparkSession)
    words, pairs = signs()
    rows = paragraphs(docs, id_column, text_column, words).where(F.arrays_overlap("_words", F.lit(words)))
    rows = rows.withColumn("_two", _ngrams(F.col("_words"), 2)).where(F.arrays_overlap("_two", F.lit(pairs))).drop("_two")
    rows = model.transform(_features(rows))
    ranked = F.array_max(F.transform(vector_to_array("probability"), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    rows = rows.withColumn("_ranked", ranked).withColumn("_family", F.element_at(F.lit(families), 1 - F.col("_ranked.i")))
    similarity = F.when(F.col("_family") == UNKNOWN, 0.0)
    for family, listed in templates().items():
        shares = []
        for pairs in sorted({tuple(sorted(_pairs_of(plain_words(t)))) for t in listed}):
            if pairs:
                shares.append(F.size(F.array_intersect("_pairs", F.lit(list(pairs)))) / len(pairs))
        similarity = similarity.when(F.col("_family") == family, F.array_max(F.array(*shares)))
    rows = rows.withColumn("similarity", similarity).withColumn("chance", F.col("_ranked.p"))
    sure = (F.col("_family") != UNKNOWN) & (F.col("chance") >= threshold) & (F.col("similarity") > LEAST_SIMILARITY)
    return rows.select(
        "doc_id", "paragraph", "start", F.when(sure, F.col("_family")).otherwise(UNKNOWN).alias("family"), "chance", "similarity", sure.alias("confirmed"))
