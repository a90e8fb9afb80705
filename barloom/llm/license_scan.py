"""License scan: phrases anywhere, and text blocks that contain a license template.

The second part is an exact set-similarity join between text blocks and a fixed list of templates.
A template's blocks are the windows of as many words as it has itself, wherever lines and
paragraphs break. Tokens are ordered by their frequency in the corpus, rarest first. A block needs a
number of the template's distinct tokens; so the text must have that many at all (length filter),
one of the template's first ``size - needed + 1`` tokens must be in the block (prefix filter), and
the words on either side of that token that a block could reach must hold enough tokens (positional
filter). Only then are the windows around it compared. Everything is a DataFrame expression within
one row: blocks never leave their document, so nothing is shuffled but the token frequencies, one
row per token of the templates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words once A-Z is lower-cased, and a word of the others.
GAP, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Phrases by label, in the labels' order.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Share of a template's distinct tokens that a block must hold.
THRESHOLD = 0.9

# Words of public license texts and notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-grant": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-3.0-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def places(words: Column, phrase: str) -> Column:
    """Words at which the phrase starts, from 0; only texts that hold its words are looked through."""
    parts = phrase.split()
    held = F.array_contains(words, parts[-1])
    for part in parts[:-1]:
        held &= F.array_contains(words, part)

    def starts(i: Column) -> Column:
        here = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here &= F.get(words, i + k) == part
        return here

    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), starts)
    return F.when(held & (F.size(words) >= len(parts)), F.coalesce(found, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))


def token_order(text: DataFrame, templates: dict[str, str]) -> list[str]:
    """All tokens of the templates, rarest in the corpus first; ties in their natural order."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    words = text.select(F.explode(F.split("text", f"{GAP}+")).alias("word")).filter(F.col("word").isin(vocabulary))
    counts = {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fullest_window(words: Column, tokens: list[str], long: int) -> Column:
    """Most distinct tokens that a window of ``long`` words holds, by one sort of the tokens' places and one running count.

    A place counts in the windows that start after the same token's place before it and hold it
    themselves: one step up and one step down in the order of windows' starts.
    """
    hits = F.array_sort(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(tokens)))

    def steps(h: Column, hit: Column, k: Column) -> Column:
        before = F.get(h, k - 1)
        since = F.when(before["word"] == hit["word"], before["at"] + 1).otherwise(0)
        # Steps down are even, so that they come first among those of one start.
        return F.array(F.greatest(since, hit["at"] - (long - 1)) * 2 + 1, (hit["at"] + 1) * 2)

    ordered = F.sort_array(F.flatten(bound(hits, lambda h: F.transform(h, lambda hit, k: steps(h, hit, k)))))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def counted(state: Column, step: Column) -> Column:
        now = state["now"] + F.when(step % 2 == 1, 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(ordered, none, counted, lambda state: state["most"])


def contained(words: Column, templates: dict[str, str], order: list[str], threshold: float) -> Column:
    """``array<struct<label, share>>`` of the templates that some block of the text contains."""
    rank = {w: k for k, w in enumerate(order)}
    sets = {label: sorted({*t.split()}, key=rank.get) for label, t in templates.items()}
    prefix = {label: tokens[: len(tokens) - needed(len(tokens), threshold) + 1] for label, tokens in sets.items()}
    listed = lambda tokens: F.array(*map(F.lit, tokens))

    def share(label: str) -> Column:
        of, long = listed(sets[label]), len(templates[label].split())
        need = needed(len(sets[label]), threshold)
        common = lambda block: F.size(F.array_intersect(block, of))
        start = lambda place: F.greatest(place - (long - 1), F.lit(0))
        reach = lambda first, last: F.slice(words, start(first) + 1, last - start(first) + long)

        def live(i: Column) -> Column:
            return F.get(words, i).isin(prefix[label]) & (common(reach(i, i)) >= need)

        def fullest(places: Column) -> Column:
            return F.when(F.size(places) > 0, fullest_window(reach(F.get(places, F.lit(0)), F.element_at(places, -1)), sets[label], long))

        most = F.when(common(words) >= need, bound(F.filter(F.sequence(F.lit(0), F.size(words) - 1), live), fullest))
        return F.when(most >= need, most / F.lit(float(len(sets[label])))).otherwise(F.lit(0.0))

    shares = F.array(*[F.struct(F.lit(label).alias("label"), share(label).alias("share")) for label in sets])
    empty = F.filter(F.array(F.struct(F.lit("").alias("label"), F.lit(0.0).alias("share"))), lambda s: F.lit(False))
    rare = sorted({w for tokens in prefix.values() for w in tokens}, key=rank.get)
    return F.when(F.arrays_overlap(words, listed(rare)), F.filter(shares, lambda s: s["share"] > 0)).otherwise(empty)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Other letters don't matter here, but for the Kelvin sign, which ``lower`` turns into a k."""
    return F.when(text.contains("\u212a"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses named in every text: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of PHRASES, ``first_word`` and ``last_word`` are the smallest and
    largest word they start at (null without any), ``base_labels`` their labels. ``labels`` adds
    those of the templates that some block contains to at least ``threshold``; a template's blocks
    are all windows of as many words as it has, so line breaks don't matter, and a text shorter than
    that is one block. ``score`` is the largest share contained, 1 with a phrase, 0 with nothing. A null text counts as empty: no
    words, no labels, score 0. Ids pass through, null or repeated; other columns are ignored; an
    empty table gives an empty result. Texts are read whole, however long; a file of many license texts takes time in
    proportion to its length.
    """
    templates = TEMPLATES if templates is None else templates
    text = df.select(F.col(id_col), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    order = token_order(text, templates)
    split = text.select(id_col, words_of(F.col("text")).alias("words"))
    counted = split.select(
        id_col, F.size("words").cast("long").alias("n_words"), *[places(F.col("words"), p).alias(f"at{k}") for k, p in enumerate(PHRASES.values())],
        contained(F.col("words"), templates, order, threshold).alias("found"),
    )
    counted = counted.withColumn("at", F.concat(*[f"at{k}" for k in range(len(PHRASES))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, label) for k, label in enumerate(PHRASES)]))
    return counted.select(
        id_col, "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``: every window that starts with a token of the template is compared.

    A window with the most tokens can be moved on to its first one without losing any.
    """
    templates = TEMPLATES if templates is None else templates
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(p.split())) + ")) AS place FROM words"
        for label, p in PHRASES.items()
    )
    rows = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {needed(len(set(t.split())), threshold)}, {len(t.split())})" for label, t in templates.items())
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM docs),
    places AS ({phrases}),
    base AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word,
                    list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r),
    templates(label, tokens, need, long) AS (VALUES {rows}),
    blocks AS (SELECT r, label, tokens, need, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(tokens, w[i])),
                      lambda i: len(list_intersect(w[i : i + long - 1], tokens)))) AS common
               FROM words, templates WHERE len(list_intersect(w, tokens)) >= need),
    found AS (SELECT r, list(label) AS labels, max(common / len(tokens)) AS score FROM blocks WHERE common >= need GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
           CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(array_to_string(base.labels, ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
           CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.score, 0.0) END::DOUBLE AS score
    FROM docs JOIN words USING (r) LEFT JOIN base USING (r) LEFT JOIN found USING (r)
    """
