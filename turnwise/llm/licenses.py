"""License phrases and notices by diagonal voting.

Every pair of neighbouring words of every text is joined by its hash to its places in a small library of
templates. A pair at word ``i`` of a text and word ``j`` of a template votes for the diagonal ``i - j``;
words that stand in order vote for one diagonal, and an inserted or missing word moves the votes to a
neighbouring one. Votes are gathered per diagonal, neighbouring diagonals are merged, and a merged
span that holds enough of the template within little more than the template's length is verified: each
template place takes its vote nearest to the strongest diagonal, and only places that stand in the text
after the one before them count.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# Phrases that are always looked for, and notices of well-known licenses, sentence by sentence,
# so that a notice that was cut or continued otherwise is still found.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("boost", "boost software license version 1 0"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nd", "licensed under cc by nd 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    Template("apache", "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Template("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    Template("isc", "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    Template("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    Template("wtfpl", "do what the fuck you want to public license"),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"),
    Template("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence"),
    Template("artistic", "you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1"),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license"),
    Template("ncsa", "university of illinois ncsa open source license"),
    Template("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
)
# Pairs of two such words occur everywhere and do not vote.
FUNCTION_WORDS = ("a", "and", "any", "are", "as", "by", "for", "in", "is", "it", "not", "of", "or", "that", "the", "this", "to", "with", "you")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_GRAMS = 8  # templates with so many pairs or fewer have to stand there whole
COVERAGE = 0.75  # the share of its pairs that a longer one needs
SLACK = 3  # diagonals at most so far apart are merged, for longer templates
STRETCH = 1.5  # most words of a span, as a multiple of the template's

# How many template places of a span stand in order. ``lines`` holds its diagonals and their template places.
STRONGEST = "array_min(transform(lines, l -> named_struct('fewest', -size(l.places), 'diagonal', l.diagonal))).diagonal"
NEAREST = f"""flatten(transform(array({STRONGEST}), main -> array_sort(flatten(transform(lines, l -> transform(l.places,
    p -> named_struct('t_place', p, 'off', abs(l.diagonal - main), 'diagonal', l.diagonal)))))))"""
IN_ORDER = f"""aggregate({NEAREST}, named_struct('t_place', -1, 'place', -1, 'n', 0),
    (s, v) -> if(v.t_place = s.t_place, s, named_struct('t_place', v.t_place, 'place', v.diagonal + v.t_place,
        'n', s.n + if(v.diagonal + v.t_place > s.place, 1, 0))),
    s -> s.n)"""


def template_pairs(templates: tuple[Template, ...]) -> list[tuple]:
    """(number, label, base, size, place, first word, second word, pairs needed, pairs, slack) for each pair that votes."""
    rows = []
    for number, t in enumerate(templates):
        words = t.text.split()
        places = [i for i in range(len(words) - 1) if not {words[i], words[i + 1]} <= set(FUNCTION_WORDS)]
        short = len(places) <= SHORT_GRAMS
        needed = float(len(places)) if short else COVERAGE * len(places)
        for i in places:
            rows.append((number, t.label, t.base, len(words), i, words[i], words[i + 1], needed, len(places), 0 if short else SLACK))
    return rows


def _pair_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    kinds = "number int, label string, base boolean, size int, t_place int, t_a string, t_b string, needed double, n_pairs int, slack int"
    names = [k.split()[0] for k in kinds.split(", ")]
    rows = json.dumps([dict(zip(names, row)) for row in template_pairs(templates)])
    fields = kinds.replace(" ", ":").replace(",:", ",")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{fields}>>")))
    return table.withColumn("t_hash", F.xxhash64("t_a", "t_b"))


def words_of(text: Column) -> Column:
    """The words of ``text`` after lower-casing A-Z only."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """License spans of every whole text.

    Result: one row per row of ``docs``: doc_id as it is (also null), n_words, n_base (places where a base
    phrase stands), first_word and last_word (smallest and largest start of such a place, null without
    one), base_labels, labels (also those of other templates; distinct, sorted, comma-joined) and score
    (the largest share of a template's pairs that a span holds in order, else 0). A null, empty or one-word text has no spans. Rows
    that are repeated are counted each on its own. Other columns are not read; an empty table gives an
    empty result.

    The library is fixed, about a thousand pairs, so it is broadcast and no word is shuffled; what is
    shuffled are votes, and of one text no more than its words.
    """
    spark = docs.sparkSession
    key = ["id_key", "text_key"]
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_key"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        words_of(F.col("text")).alias("words"),
    )
    n = F.size("words")
    pairs = source.select(
        *key,
        F.posexplode(
            F.arrays_zip(
                F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
                F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"),
            )
        ).alias("place", "pair"),
    ).select(*key, "place", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    same = (F.xxhash64("a", "b") == F.col("t_hash")) & (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b"))
    shape = ["number", "label", "base", "size", "needed", "n_pairs", "slack"]
    votes = (
        pairs.join(F.broadcast(_pair_table(spark, templates)), same)
        .select(*key, *shape, (F.col("place") - F.col("t_place")).alias("diagonal"), "t_place")
        .groupBy(*key, *shape, "diagonal")
        .agg(F.collect_set("t_place").alias("places"))
    )
    along = Window.partitionBy(*key, "number").orderBy("diagonal")
    before = F.lag("diagonal").over(along)
    begins = F.when(before.isNull() | (F.col("diagonal") - before > F.col("slack")), 1).otherwise(0)
    bands = votes.withColumn("begins", begins).withColumn("band", F.sum("begins").over(along))
    spans = (
        bands.groupBy(*key, *shape, "band")
        .agg(
            F.collect_list(F.struct("diagonal", "places")).alias("lines"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("voted"),
            F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
            (F.max(F.col("diagonal") + F.array_max("places")) + 2).alias("stop"),
        )
        .filter((F.col("voted") >= F.col("needed")) & (F.col("stop") - F.col("start") <= STRETCH * F.col("size")))
        .withColumn("covered", F.expr(IN_ORDER))
        .filter(F.col("covered") >= F.col("needed"))
    )
    base = F.col("base")
    found = spans.groupBy(*key).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.col("covered") / F.col("n_pairs")).alias("score"),
    )
    return (
        source.select("doc_id", *key, F.size("words").cast("long").alias("n_words"))
        .join(found, key, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
