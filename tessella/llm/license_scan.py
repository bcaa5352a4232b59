"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a run of 2 to `RUN` lines, for notices are wrapped; a
template is a known notice; both are sets of tokens. A pair is found where the block holds
at least the fraction `THRESHOLD` of the template's tokens, where a run of several lines
has at most `SPREAD` words for each token of the template, and no shorter block within it
is found for the same template. With a = ceil(THRESHOLD * size) tokens needed:

* order: tokens rank by how often the whole corpus has them, rarest first (ties by token);
* prefix: a block holding a tokens holds one of the template's first size - a + 1;
* length: the block has at least a words;
* position: from its first shared prefix token on, neither side has too few tokens left;
* what passes is counted in full, so that the result is exactly that of comparing all.

The corpus is read twice, once to rank tokens and once to join; only counts of template
tokens are shuffled. Blocks never leave the row they are in.

Cases: null and empty texts have no blocks that match; lines of any length count whole,
and blank ones are lines of a run; a block that holds several templates gives a row for
each; of runs that overlap each minimal one is found; repeated rows give their rows again;
null ids pass through; an empty table gives no rows; further columns are ignored;
templates without tokens are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import Words, slices, strings

#: Share of a template's tokens that a block must hold.
THRESHOLD = 0.8
#: Lines of a block at most, and words of a run for each token of a template, at most.
RUN, SPREAD = 4, 2
#: Known notices, by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-copy": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "creative-commons": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "mit-license": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "no-warranty": "The software is provided as is, without warranty of any kind, express or implied.",
    "proprietary": "This document is proprietary and confidential. Unauthorized copying or distribution is prohibited.",
}


class Join:
    """Templates in global order, with their prefixes indexed by token."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int], threshold: float = THRESHOLD):
        self.names = sorted(templates)
        sets = [np.unique(Words(pa.array([templates[n]], pa.large_string())).hash) for n in self.names]
        if any(not len(s) for s in sets):
            raise ValueError("a template has no tokens")
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        order = sorted(range(len(every)), key=lambda i: (counts.get(int(every[i]), 0), int(every[i])))
        #: Sorted hashes of all template tokens, and the rank of each in the global order.
        self.tokens, self.rank = every, np.empty(len(every), np.int64)
        self.rank[order] = np.arange(len(every))
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([ceil(threshold * len(s) - 1e-9) for s in sets], np.int64)
        self.member = np.zeros((len(sets), len(every)), bool)
        posting: list[list[tuple[int, int]]] = [[] for _ in every]
        for t, s in enumerate(sets):
            ranks = np.sort(self.rank[np.searchsorted(every, s)])
            self.member[t, ranks] = True
            for place, r in enumerate(ranks[: len(ranks) - self.need[t] + 1].tolist()):
                posting[r].append((t, place))
        self.post_at = np.concatenate([[0], np.cumsum([len(p) for p in posting])]).astype(np.int64)
        self.post_template = np.array([t for p in posting for t, _ in p], np.int64)
        self.post_place = np.array([i for p in posting for _, i in p], np.int64)

    def find(self, w: Words) -> tuple[np.ndarray, ...]:
        """(text, first line of it, lines, template, shared tokens) of every match."""
        none = (np.zeros(0, np.int64),) * 5
        if not len(w.hash) or not len(self.tokens):
            return none
        at = np.minimum(np.searchsorted(self.tokens, w.hash), len(self.tokens) - 1)
        hit = np.flatnonzero(self.tokens[at] == w.hash)
        if not len(hit):
            return none
        ends = np.flatnonzero(w.bytes == 10)
        # lines are numbered through the slice: line breaks before a word, and one more for each text begun
        line = np.searchsorted(ends, w.start) + w.text
        base = np.searchsorted(ends, w.offsets) + np.arange(len(w.offsets))
        words_to = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=int(base[-1])))])
        rank, text, line = self.rank[at[hit]], w.text[hit], line[hit]
        # a run has to have a prefix token: only lines that aren't farther from one than a run is long are looked at again
        near = np.zeros(int(base[-1]) + 2 * RUN, bool)
        prefix = line[self.post_at[rank + 1] > self.post_at[rank]]
        for k in range(1 - RUN, RUN):
            near[prefix + k + RUN] = True
        close = near[line + RUN]
        rank, text, line = rank[close], text[close], line[close]
        found: list[tuple[np.ndarray, ...]] = []
        for lines in range(1, RUN + 1):
            starts, ranks = [], []
            for back in range(lines):
                start = line - back
                good = (start >= base[text]) & (start + lines <= base[text + 1])
                starts.append(start[good])
                ranks.append(rank[good])
            block, template, shared = self._match(np.concatenate(starts), np.concatenate(ranks), words_to, lines)
            width = np.int64(len(self.names))
            whole = np.ones(len(block), bool)
            for shorter, (other, of, _) in enumerate(found, 1):
                for k in range(lines - shorter + 1):
                    whole &= ~np.isin((block + k) * width + template, other * width + of)
            found.append((block[whole], template[whole], shared[whole]))
        block, template, shared = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(base, block, "right") - 1
        return text, block - base[text], np.repeat(np.arange(1, RUN + 1), [len(f[0]) for f in found]), template, shared

    def _match(self, start: np.ndarray, rank: np.ndarray, words_to: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first line, template, shared tokens) of the matches among blocks of so many lines, given by their first line and tokens."""
        none = (np.zeros(0, np.int64),) * 3
        width = np.int64(len(self.tokens))
        key = np.unique(start * width + rank)
        block, rank = key // width, key % width
        end = np.searchsorted(block, block, "right")
        posts = self.post_at[rank + 1] - self.post_at[rank]
        total = int(posts.sum())
        if not total:
            return none
        i = np.repeat(np.arange(len(key)), posts)
        p = np.repeat(self.post_at[rank] - np.concatenate([[0], np.cumsum(posts)[:-1]]), posts) + np.arange(total)
        template, place, need = self.post_template[p], self.post_place[p], self.need[self.post_template[p]]
        pair = block[i] * len(self.names) + template
        first = np.zeros(total, bool)
        first[np.unique(pair, return_index=True)[1]] = True  # ranks ascend within a block: its first shared prefix token
        left = np.minimum(self.size[template] - place, end[i] - i)
        words = words_to[block[i] + lines] - words_to[block[i]]
        good = first & (words >= need) & (left >= need)
        if lines > 1:
            good &= words <= SPREAD * self.size[template]
        i, template = i[good], template[good]
        begin = np.searchsorted(block, block[i])
        size = end[i] - begin
        if not len(i):
            return none
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        shared = np.add.reduceat(self.member[np.repeat(template, size), rank[at]].astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        good = shared >= self.need[template]
        return block[i][good], template[good], shared[good]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))


def token_counts(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """How often the corpus has each template token; as many numbers come back as the templates have tokens."""
    tokens = np.unique(np.concatenate([Words(pa.array([t], pa.large_string())).hash for t in templates.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = Words(strings(part.column(1))).hash
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                total += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens))), pa.array(total)], names=["token", "n"])

    got = _slim(docs, id_col, text_col).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(tokens[r.token]): r.n for r in got}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, lines, license, shared, containment) of every block and template that match; lines count from 0."""
    templates = TEMPLATES if templates is None else templates
    join = Join(templates, token_counts(docs, templates, id_col, text_col), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(join.names, pa.string())
        for batch in batches:
            for part in slices(batch, "text"):
                text, line, lines, template, shared = join.find(Words(strings(part.column(1))))
                if len(text):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(line), pa.array(lines), names.take(pa.array(template)), pa.array(shared), pa.array(shared / join.size[template])], names=[id_col, "line", "lines", "license", "shared", "containment"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("line", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("license", T.StringType()), T.StructField("shared", T.LongType()), T.StructField("containment", T.DoubleType())])
    return _slim(docs, id_col, text_col).mapInArrow(run, schema)


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL that compares every block of `documents` with every template."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted((TEMPLATES if templates is None else templates).items()))
    words = "regexp_extract_all(lower({}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
with templates as (select name, list_distinct({words.format('body')}) tokens from (values {values}) v(name, body)),
docs as (select doc_id, row_number() over () row, [{words.format('x')} for x in string_split(text, chr(10))] split from documents where text is not null),
starts as (select doc_id, row, split, unnest(range(len(split))) line from docs),
runs as (select doc_id, row, line, lines, flatten(split[line + 1:line + lines]) words from starts, range(1, {RUN + 1}) r(lines) where line + lines <= len(split)),
blocks as (select doc_id, row, line, lines, len(words) n, list_distinct(words) tokens from runs where len(words) > 0 and (lines = 1 or len(words) <= {SPREAD} * (select max(len(tokens)) from templates))),
pairs as (select doc_id, row, line, lines, n, name, len(list_intersect(b.tokens, t.tokens)) shared, len(t.tokens) size from blocks b, templates t),
found as (select * from pairs where shared >= ceil({threshold} * size - 1e-9) and (lines = 1 or n <= {SPREAD} * size))
select doc_id, cast(line as bigint) line, cast(lines as bigint) lines, name license, cast(shared as bigint) shared, shared / size containment from found f
where not exists (select 1 from found g where g.row = f.row and g.name = f.name and g.lines < f.lines and g.line >= f.line and g.line + g.lines <= f.line + f.lines)"""
