"""License scan with a positional index of rare licence words. Only DataFrame functions."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import held

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that give a label wherever they stand (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


#: Words by which a mandatory phrase may stand off its place in a notice.
NEAR = 3


@dataclass(frozen=True)
class Template:
    """A notice: its text, the phrases of it that must stand in a file at their place in the notice, and the share of its rare
    words that must agree."""

    label: str
    text: str
    mandatory: tuple[str, ...]
    least: float = 0.6


#: Usual notices of public licences (fixed values).
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction, including without limitation the rights to"
        " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge",),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
        ("apache license version 2 0",),
        0.3,
    ),
    Template(
        "gpl-3",
        "This work is licensed under the GNU General Public License, version 3.",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
        ("gnu general public license", "version 3"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version.",
        ("gnu general public license", "version 2"),
    ),
    Template(
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)"
        " any later version.",
        ("gnu lesser general public license", "version 2 1"),
    ),
    Template(
        "lgpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
        " any later version.",
        ("gnu lesser general public license", "version 3"),
    ),
    Template(
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
        " any later version.",
        ("gnu affero general public license", "version 3"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
        ("endorse or promote products derived from this software without specific prior written permission",),
    ),
    Template(
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at",
        ("eclipse public license 2 0",),
    ),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("all-rights-reserved", "Copyright. All rights reserved.", ("all rights reserved",)),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


@dataclass(frozen=True)
class Index:
    """Postings of the templates' rare words: word -> ((template, position), ...), and their inverse document frequencies."""

    idf: dict[str, float]
    postings: dict[str, tuple[tuple[int, int], ...]]
    weight: tuple[float, ...]


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each word of the templates): one aggregation over all whole texts.

    At most one row per word of the templates reaches the driver.
    """
    known = sorted({w for t in templates for w in template_words(t.text)})
    own = F.array_distinct(F.filter(_words(F.coalesce(F.col(text), F.lit(""))), lambda w: w.isin(known)))
    held_words = docs.select(held(own).alias("w"))
    counts = held_words.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}
    return found.pop("", 0), found


def build_index(
    templates: tuple[Template, ...] = TEMPLATES, rare: int = 12, frequencies: tuple[int, dict[str, int]] | None = None
) -> Index:
    """Of each template its ``rare`` words of highest IDF over a corpus, or over the templates where no ``frequencies`` are given;
    ties go to longer, then earlier words in order."""
    token = [template_words(t.text) for t in templates]
    total, seen = frequencies or (len(templates), Counter(w for words in token for w in set(words)))
    idf = {w: math.log(1 + (total + 1) / (seen.get(w, 0) + 1)) for words in token for w in words}
    postings, weight = defaultdict(list), []
    for k, words in enumerate(token):
        chosen = sorted(set(words), key=lambda w: (-idf[w], -len(w), w))[:rare]
        weight.append(sum(idf[w] for w in words if w in chosen))
        for position, w in enumerate(words):
            if w in chosen:
                postings[w].append((k, position))
    return Index({w: idf[w] for w in postings}, {w: tuple(p) for w, p in postings.items()}, tuple(weight))


def offsets(template: Template, phrase: str) -> list[int]:
    """Where a mandatory phrase begins in its notice."""
    words, wanted = template_words(template.text), template_words(phrase)
    found = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    if not found:
        raise ValueError(f"{phrase!r} does not stand in the notice of {template.label}")
    return found


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def _places(words: str, firsts: str, phrase: list[str]) -> Column:
    """Starts of a phrase, checked only where its first word stands."""

    def stands(i: Column) -> Column:
        test = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            test = test & F.get(words, i + k).eqNullSafe(F.lit(w))
        return test

    return F.filter(firsts, stands)


def _near(offset: Column, spots: list[int]) -> Column:
    near = F.lit(False)
    for spot in spots:
        near = near | offset.between(spot - NEAR, spot + NEAR)
    return near


def _placed(template: int, phrases: list[tuple[str, list[int]]]) -> Callable[[Column], Column]:
    """Whether a beginning is one of a template, with each mandatory phrase (column of its places, offsets) near its place."""

    def holds(x: Column) -> Column:
        good = x["t"] == template
        for places, spots in phrases:
            good = good & F.exists(places, lambda p: _near(p - x["b"], spots))
        return good

    return holds


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: dict[str, str] | None = None,
    text: str = "text",
    frequencies: tuple[int, dict[str, int]] | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, matches, score.

    The licence words of a file are those of the templates' index; every place of every one is looked up.
    Each posting of such a word says where the template would begin in the file; postings that agree on the
    beginning add up their IDF. A template matches where what agrees is its ``least`` share of the template's rare weight and
    all its mandatory phrases stand where the notice has them, give or take ``NEAR`` words; a phrase elsewhere in the file does
    not count. ``frequencies`` are those of ``document_frequencies``: words are rare in the corpus then, else among the templates.
    ``score`` is the best share of a matching template, 1 for a file with a base phrase, else 0. All of it is done inside the row:
    no shuffle, and the index has a fixed size. A NULL or empty text has no words and no labels; labels are distinct, sorted
    and joined by commas; repeated rows are judged alike; an empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    index = build_index(templates, frequencies=frequencies)
    base = {p: template_words(p) for p in phrases}
    mandatory = {m: template_words(m) for t in templates for m in t.mandatory}
    every = {**base, **mandatory}
    rows = docs.withColumn("_words", held(_words(F.coalesce(F.col(text), F.lit("")))))
    wanted = sorted({*index.postings, *(w[0] for w in every.values())})
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(wanted), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_hits", held(hits))
    rows = rows.withColumns({f"_p{k}": held(_places("_words", "_hits", w)) for k, w in enumerate(every.values())})
    place = {p: f"_p{k}" for k, p in enumerate(every)}
    starts = F.concat(*(F.col(place[p]) for p in base))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_base": F.size(starts).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
        }
    )

    # Only templates whose mandatory phrases all stand in the file can match; other files need no lookup.
    able = []
    for k, t in enumerate(templates):
        stand = F.lit(True)
        for m in t.mandatory:
            stand = stand & (F.size(place[m]) > 0)
        able.append(F.when(stand, F.lit(k)))
    rows = rows.withColumn("_able", held(F.array_compact(F.array(*able))))

    posted = F.create_map(
        *(
            c
            for w, ps in sorted(index.postings.items())
            for c in (
                F.lit(w),
                F.array(*(F.struct(F.lit(k).alias("t"), F.lit(p).alias("p"), F.lit(index.idf[w]).alias("idf")) for k, p in ps)),
            )
        )
    )

    # Votes (template, begin, idf), one for each hit of a licence word and posting of a template that can match.
    votes = F.flatten(
        F.transform(
            F.filter("_hits", lambda i: F.get("_words", i).isin(sorted(index.postings))),
            lambda i: F.transform(
                F.filter(F.element_at(posted, F.get("_words", i)), lambda x: F.array_contains("_able", x["t"])),
                lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("b"), x["idf"].alias("idf")),
            ),
        )
    )
    rows = rows.withColumn("_votes", held(F.when(F.size("_able") > 0, F.sort_array(votes))))
    # One pass over the ordered votes: the running sum for one beginning, and every beginning whose sum reaches its template's least.
    needed = F.array(*(F.lit(t.least * w) for t, w in zip(templates, index.weight)))
    vote_type = "array<struct<t:int,b:int,sum:double>>"
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("b"), F.lit(0.0).alias("sum"), F.array().cast(vote_type).alias("found"))

    def closed(state: Column) -> Column:
        """``found`` with the beginning that ends here, if it reaches the least sum."""
        own = F.array(F.struct(state["t"].alias("t"), state["b"].alias("b"), state["sum"].alias("sum")))
        enough = (state["t"] >= 0) & (state["sum"] >= F.get(needed, F.greatest(state["t"], F.lit(0))))
        return F.when(enough, F.concat(state["found"], own)).otherwise(state["found"])

    def add(state: Column, vote: Column) -> Column:
        same = (state["t"] == vote["t"]) & (state["b"] == vote["b"])
        total = F.when(same, state["sum"]).otherwise(F.lit(0.0)) + vote["idf"]
        found = F.when(same, state["found"]).otherwise(closed(state))
        return F.struct(vote["t"].alias("t"), vote["b"].alias("b"), total.alias("sum"), found.alias("found"))

    rows = rows.withColumn("_state", held(F.when(F.col("_votes").isNotNull(), F.aggregate("_votes", zero, add))))
    rows = rows.withColumn("_found", held(F.when(F.col("_state").isNotNull(), closed(F.col("_state")))))
    shares, labels = [], []
    for k, t in enumerate(templates):
        in_place = _placed(k, [(place[m], offsets(t, m)) for m in t.mandatory])
        share = F.array_max(F.transform(F.filter("_found", in_place), lambda x: x["sum"])) / F.lit(index.weight[k])
        verified = share.isNotNull()
        shares.append(F.when(verified, F.least(share, F.lit(1.0))).otherwise(F.lit(0.0)))
        labels.append(F.when(verified, F.lit(t.label)))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(place[p]) > 0, F.lit(l)) for p, l in phrases.items())))))
    rows = rows.withColumn("_base", base_labels).withColumn("matches", F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.greatest(*shares, F.lit(0.0)))
    return (
        rows.withColumn("score", score)
        .withColumn("base_labels", F.array_join("_base", ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_union("_base", "matches")), ","))
        .drop("_words", "_hits", "_able", "_votes", "_state", "_found", "_base", *place.values())
    )
