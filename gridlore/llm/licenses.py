"""License scans by a positional index of rare words. Only DataFrame functions are used.

A template is a passage of a license with key phrases that must not be missing. The document frequency of every word of the
templates is counted over all documents. In a file, each template's rarest words that the file holds are looked up; every
place of such a word, less its place in the template, is a start that the template could have, and a start on which two of
the rare words agree is a candidate. A candidate counts if all key phrases of the template stand where they belong.

Everything after the count of words happens within a row, so that nothing is shuffled but the counts, one row per word of
the templates and task, and rows need no key. What is broadcast or collected grows with the templates only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import packed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3  # words of a template that are looked up in a file, two of which have to agree on a start


@dataclass(frozen=True)
class Template:
    """A label, a passage in lower-case ASCII words, and its key phrases, runs of its words; without any, all of it is one."""

    label: str
    passage: str
    keys: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[str]:
        return split_words(self.passage)

    def phrases(self) -> list[tuple[int, list[str]]]:
        """Where each key phrase starts in the passage, and its words."""
        own = self.words()
        if not own or not self.passage.isascii():
            raise ValueError(f"a template needs words in ASCII: {self.passage!r}")
        out = []
        for key in self.keys or (self.passage,):
            words = split_words(key)
            at = [i for i in range(len(own)) if words and own[i : i + len(words)] == words]
            if not at:
                raise ValueError(f"{key!r} is no run of words of {self.passage!r}")
            out.append((at[0], words))
        return out


def split_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))


# fixed values: the phrases and labels of the base scan
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

# fixed values: notices and passages of public licenses, with the phrases by which each is told from its relatives
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
             ("to deal in the software without restriction", "sublicense and or sell copies")),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
             ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("in source and binary forms", "provided that the following conditions are met")),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
             ("nor the names of its contributors", "without specific prior written permission")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose with or without fee is hereby granted",)),
    Template("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
             ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
             ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("epl", "the terms of the eclipse public license", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("cc0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-nd", "creative commons attribution noderivatives"),
    Template("all-rights", "copyright all rights reserved", ("all rights reserved",)),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none.

    ``lower`` is many times as fast as a translation of 26 letters. Words of templates are ASCII, so that only the two
    other letters whose lower case holds an ASCII letter, dotted I and the Kelvin sign, could make a difference.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, n_docs: in how many documents each word of the vocabulary stands; those that stand in none are left out."""
    held = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), words_of(F.col("text")))).alias("word"))
    return held.groupBy("word").agg(F.count("*").alias("n_docs"))


def _positions(words: Column, word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == word)


def _starts(words: Column, own: Column, word: Column) -> Column:
    """The starts that a template with the words ``own`` could have, by the places of one word; none for a null word."""
    places = _positions(own, word)
    starts = F.flatten(F.transform(_positions(words, word), lambda at: F.transform(places, lambda p: at - p)))
    return F.when(word.isNotNull(), F.array_distinct(starts)).otherwise(F.array().cast("array<int>"))


def _verified(words: Column, start: Column, phrases: Column) -> Column:
    """All key phrases stand where they belong."""
    return F.forall(
        phrases,
        lambda k: F.when(start + k["at"] >= 0, F.slice(words, start + k["at"] + 1, F.size(k["words"])) == k["words"]).otherwise(False),
    )


def _places(words: Column, present: Column, t: Column) -> Column:
    """Where one template stands: template, label, base, start (below 0 if its first words are missing) and share of its words found."""
    own = t["words"]
    rare = F.slice(F.filter(present, lambda w: F.array_contains(own, w)), 1, RARE)

    def agreed(s: Column) -> Column:
        a, b, c = (F.get(s, i) for i in range(RARE))
        return F.array_distinct(F.concat(F.array_intersect(a, b), F.array_intersect(a, c), F.array_intersect(b, c)))

    starts = F.transform(F.array(*(F.get(rare, i) for i in range(RARE))), lambda w: _starts(words, own, w))
    # a list of one is transformed, so that the starts are made once
    candidates = F.flatten(F.transform(F.array(starts), agreed))
    found = F.filter(candidates, lambda s: _verified(words, s, t["phrases"]))
    return F.transform(
        found,
        lambda s: F.struct(
            t["number"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), s.alias("start"),
            (F.size(F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda p: F.coalesce(F.get(words, s + p) == F.get(own, p), F.lit(False))))
             / F.size(own)).alias("share"),
        ),
    )


def _literal(templates: tuple[Template, ...]) -> Column:
    return F.array(*(
        F.struct(
            F.lit(n).alias("number"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.words()).alias("words"),
            F.array(*(F.struct(F.lit(at).alias("at"), F.lit(words).alias("words")) for at, words in t.phrases())).alias("phrases"),
            F.lit(sorted({w for _, words in t.phrases() for w in words})).alias("needed"),
        )
        for n, t in enumerate(templates)
    ))


def scan(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *PASSAGES)) -> DataFrame:
    """All rows and columns of ``docs``, packed in ``_row``, with _n_words and _places.

    _places lists every place of every template: template, label, base, start, share of the template's words that stand
    there. A null or empty text has no words and no places. Words are counted over all rows, whole texts of any length;
    repeated rows each keep their places, and missing or repeated ids do not matter. An empty table gives an empty one.
    Words that are equally frequent rank by code point. All starts on which two rare words agree are verified.
    """
    vocabulary = sorted({w for t in templates for w in t.words()})
    known = {r.word: r.n_docs for r in frequencies(docs, vocabulary).collect()}  # one row per word of the templates at most
    by_rarity = sorted(vocabulary, key=lambda w: (known.get(w, 0), w))
    rows = packed(docs).withColumn("_words", words_of(F.col("_row.text")))
    rows = rows.withColumn("_present", F.array_intersect(F.lit(by_rarity), F.col("_words")))
    # templates of which a key phrase has a word that is nowhere in the file need no look at places
    rows = rows.withColumn("_open", F.filter(_literal(templates), lambda t: F.size(F.array_except(t["needed"], F.col("_present"))) == 0))
    places = F.flatten(F.transform("_open", lambda t: _places(F.col("_words"), F.col("_present"), t)))
    return rows.select("_row", F.size("_words").cast("long").alias("_n_words"), places.alias("_places"))


def labelled(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *PASSAGES)) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for every row of ``docs``.

    Labels are distinct, sorted by code point and joined by commas, empty if there are none. The score is the largest share
    of a template's words that stand in place, 0 without any template. Other columns are not read.
    """
    rows = scan(docs.select("doc_id", "text"), templates)
    rows = rows.withColumn("_base", F.filter("_places", lambda p: p["base"]))

    def labels(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(places)["label"])), ",")

    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.col("_base")["start"]).cast("long").alias("first_word"), F.array_max(F.col("_base")["start"]).cast("long").alias("last_word"),
        labels("_base").alias("base_labels"), labels("_places").alias("labels"),
        F.coalesce(F.array_max(F.col("_places")["share"]), F.lit(0.0)).alias("score"),
    )
