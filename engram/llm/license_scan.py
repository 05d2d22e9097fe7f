"""Licence notices by an exact set-similarity join of text blocks and templates.

A template is a set of words; a block is the set of words of a window of the text.
A block matches if it holds at least THRESHOLD of the template's words.  Words are
ordered by how many documents of the corpus hold them, the rarest first.  A block that
reaches the threshold shares one of the template's first words in that order (prefix
filter), has enough known words (length filter), and after the first common word both
sides have enough words left (positional filter).  Windows are twice as wide as a
template and start every half, so every notice lies whole in one.

Fixed phrases are found beside, as runs of words of the whole text.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.columns import picked
from engram.session import materialize

#: Share of a template's words that a block must hold, as a fraction.
THRESHOLD = (85, 100)
#: The narrowest half window, in words.
LEAST_STEP = 8
#: Templates and words of a template up to which the template side is broadcast.
MOST_TEMPLATES, MOST_WORDS = 10_000, 1_000

# Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Words of public licence notices, by label.
TEMPLATES = (
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "copyright all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Bytes to lower case A-Z; what is no digit, letter or byte from 128 on becomes a blank.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, ASCII letters, lower-cased, and of all characters from U+0080 on."""
    return text.translate(_BYTES).split() if text else []


def step_of(n_words: int) -> int:
    """Half the width of the windows that a template of so many words is held against."""
    return max(LEAST_STEP, 1 << (max(1, n_words) - 1).bit_length())


def needed(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Words that a block must share with a template of ``size`` distinct words."""
    return max(1, -(-size * threshold[0] // threshold[1]))


@dataclass(frozen=True)
class Template:
    """A template's distinct words as numbers in the corpus order, the rarest first."""

    no: int
    label: str
    step: int
    words: tuple[int, ...]
    needs: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.words[: len(self.words) - self.needs + 1]


@dataclass(frozen=True)
class Templates:
    """All templates, and the number of every word in them by corpus frequency."""

    order: dict[bytes, int]
    rows: tuple[Template, ...]


def ordered(templates, counts: dict[bytes, int], threshold: tuple[int, int] = THRESHOLD) -> Templates:
    words = [words_of(text.encode()) for _, text in templates]
    order = {w: i for i, w in enumerate(sorted({w for t in words for w in t}, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for i, ((label, _), own) in enumerate(zip(templates, words)):
        if own:
            t = tuple(sorted({order[w] for w in own}))
            rows.append(Template(i, label, step_of(len(own)), t, needed(len(t), threshold)))
    return Templates(order, tuple(rows))


def frequencies(docs: DataFrame, templates) -> dict[bytes, int]:
    """Of each template word the number of documents that hold it; as many rows as the templates have words."""
    known = frozenset(w for _, text in templates for w in words_of(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).view(pa.binary()):
                seen.update(known.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return {bytes(r.word): r.n for r in docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        find = b" " + phrase.encode() + b" "
        at, before, n = line.find(find), 0, 0
        while at >= 0:
            n += line.count(b" ", before, at)
            before = at
            out.append((n, label))
            at = line.find(find, at + 1)
    return out


def candidate_blocks(words: list[bytes], templates: Templates) -> list[tuple[int, int, list[int]]]:
    """(step, start, word numbers in order) of the windows that pass the prefix and length filters of a template of their width."""
    get = templates.order.get
    hits = [(i, n) for i, n in enumerate(map(get, words)) if n is not None]
    if not hits:
        return []
    places = [i for i, _ in hits]
    by_step: dict[int, tuple[set[int], int]] = {}
    for t in templates.rows:
        rare, least = by_step.get(t.step, (set(), 1 << 30))
        by_step[t.step] = (rare | set(t.prefix), min(least, t.needs))
    out = []
    for step, (rare, least) in sorted(by_step.items()):
        windows = {w for i, n in hits if n in rare for w in (i // step - 1, i // step) if w >= 0}
        for w in sorted(windows):
            a, b = bisect.bisect_left(places, w * step), bisect.bisect_left(places, (w + 2) * step)
            own = {n for _, n in hits[a:b]}
            if len(own) >= least:
                out.append((step, w * step, sorted(own)))
    return out


_BLOCK = "struct<step: int, start: long, words: array<int>>"
_SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<{_BLOCK}>"


def blocks(docs: DataFrame, templates: Templates, phrases=PHRASES) -> DataFrame:
    """A row for each document: its phrases, and its blocks that may match a template."""
    struct = pa.struct([("step", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))])
    types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(struct)]
    names = ["n_words", "n_base", "first_word", "last_word", "base", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).view(pa.binary()):
                words = words_of(text.as_py())
                base = phrase_places(words, phrases)
                starts = [p for p, _ in base]
                made = [dict(zip(("step", "start", "words"), b)) for b in candidate_blocks(words, templates)]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), sorted({label for _, label in base}), made))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", *names])

    return docs.mapInArrow(run, _SCHEMA)


def similar(found: DataFrame, templates: Templates) -> DataFrame:
    """(row, start, step, label, containment): the join of found(row, step, start, words) with the templates.

    Both sides are joined on a prefix word.  The template side, a parameter, is broadcast up
    to MOST_TEMPLATES; blocks are never shuffled by a word, so a frequent one makes no hot task.
    """
    spark = found.sparkSession
    rows = [(t.step, w, i, t.no, t.label, len(t.words), t.needs, list(t.words)) for t in templates.rows for i, w in enumerate(t.prefix)]
    index = spark.createDataFrame(rows, "step int, word int, place int, template int, label string, size int, needs int, own array<int>")
    if len(templates.rows) <= MOST_TEMPLATES and all(len(t.words) <= MOST_WORDS for t in templates.rows):
        index = F.broadcast(index)
    prefix = found.select("row", "step", "start", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    pairs = prefix.join(index, ["step", "word"])
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.col("n") - F.col("at") - 1)
    # the first common word decides, so that a pair is verified once
    first = F.element_at(F.array_intersect("own", "words"), 1) == F.col("word")
    pairs = pairs.where((F.col("n") >= F.col("needs")) & (left >= F.col("needs"))).where(first)
    both = F.size(F.array_intersect("words", "own"))
    return pairs.where(both >= F.col("needs")).select("row", "step", "start", "label", (both / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts the places of phrases, of which ``first_word`` and ``last_word``
    are the least and greatest start; ``labels`` adds those of matching templates.
    ``score`` is the greatest share of a template's words in a block that matches, 1
    where a phrase stands, else 0.  Null or empty text has no words; null and repeated
    ids keep their rows; other columns are ignored; an empty table gives no row.  A very
    long text costs memory in proportion to its words.
    """
    rows = picked(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    known = ordered(templates, frequencies(rows, templates), threshold)
    # written once, so that a row keeps its number
    seen = materialize(blocks(rows, known, phrases).withColumn("row", F.monotonically_increasing_id()), "blocks")
    found = similar(seen.select("row", F.explode("blocks").alias("b")).select("row", "b.*"), known)
    labels = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    every = F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    out = seen.drop("blocks").join(labels, "row", "left")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), every.alias("labels"), score.alias("score"))


def oracle(templates=TEMPLATES, phrases=PHRASES, threshold: tuple[int, int] = THRESHOLD) -> str:
    """DuckDB SQL of ``scan``: every window against every template, by counting."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    own = [(i, label, step_of(len(w)), sorted(set(w))) for i, (label, text) in enumerate(templates) if (w := text.split())]
    template_rows = ", ".join(f"({i}, {quoted(label)}, {step}, {len(w)}, {needed(len(w), threshold)})" for i, label, step, w in own)
    word_rows = ", ".join(f"({i}, {quoted(x)})" for i, _, _, w in own for x in w)
    phrase_rows = " UNION ALL ".join(
        f"SELECT r, p, {quoted(label)} AS label FROM nexts WHERE " + " AND ".join(f"w{k} = {quoted(x)}" for k, x in enumerate(phrase.split())) for phrase, label in phrases
    )
    longest = max(len(p.split()) for p, _ in phrases)
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY r ORDER BY p) AS w{k}" for k in range(longest))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
nexts AS (SELECT r, p, {leads} FROM words),
places AS ({phrase_rows}),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS z, list(DISTINCT label) AS labels FROM places GROUP BY r),
templates(t, label, step, size, needs) AS (VALUES {template_rows}),
own(t, w) AS (VALUES {word_rows}),
hits AS (SELECT words.r, own.t, templates.label, templates.size, templates.needs, words.w, unnest([p // step - 1, p // step]) AS block FROM words JOIN own USING (w) JOIN templates USING (t)),
found AS (SELECT r, block, t, any_value(label) AS label, count(DISTINCT w) / any_value(size) AS share FROM hits WHERE block >= 0 GROUP BY r, block, t HAVING count(DISTINCT w) >= any_value(needs)),
best AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
    CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""
