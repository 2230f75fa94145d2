"""License scans by template-markup matching (operator 10).

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z, so case,
punctuation and layout never matter.

Base phrases are found wherever their words stand consecutively. The method adds templates:
license wording with ``<optional>...</optional>`` regions, which may be missing, and
``<alt max="n">...</alt>`` regions, which stand for any 0 to n words. A template is compiled
once into a token automaton (an optional region is a bypass, a replaceable one n wildcard
steps with an exit at each); a stretch of a text is accepted when its mandatory words match
exactly, in order, with nothing between them but what the markup allows.

Per batch, numpy compares word hashes for all texts at once; only texts that hold a
template's longest mandatory phrase run its automaton, from the words it can begin with. Of
the matches that begin at a word the longest counts, and the next is looked for after it.

Score: the share of a text's words that a base phrase or a template covers, 0 without words.

Edge cases. Null counts as empty: no words, no labels, score 0. Texts of any length are read
whole. Repeated rows are scanned each. An empty table gives an empty result. Extra columns
are kept; columns named like the results are replaced. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tamis.llm.frames import ship
from tamis.llm.words import ALNUM, Words, slices, word_hashes, words

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of common licenses and notices, with what may be missing or replaced.
TEMPLATES = {
    "apache-2.0": '<optional><alt max="8">This software is</alt></optional> licensed under the Apache License, Version 2.0'
                  '<optional> (the "License"); you may not use <alt max="4">this file</alt> except in compliance with the License</optional>',
    "bsd": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
           'conditions are met<optional> <alt max="4">1.</alt> Redistributions of source code must retain the above copyright notice, this '
           'list of conditions and the following disclaimer</optional>',
    "cc-by-nc-4.0": '<optional>This <alt max="3">work</alt> is</optional> licensed under <optional>a</optional> <optional>Creative Commons</optional> '
                    'CC BY NC 4.0 <optional>International</optional> <optional>License</optional>',
    "cc-by-4.0": '<optional>This <alt max="3">work</alt> is</optional> licensed under <optional>a</optional> <optional>Creative Commons</optional> '
                 'CC BY 4.0 <optional>International</optional> <optional>License</optional>',
    "gpl-3.0": '<optional>This <alt max="3">work</alt> is</optional> licensed under <optional>the terms of</optional> the GNU General Public License'
               '<optional> as published by the Free Software Foundation</optional> <optional>either</optional> version 3',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided '
           'that the above copyright notice and this permission notice appear in all copies',
    "mit": '<optional>This <alt max="3">software</alt> is</optional> released under the <optional>terms of the</optional> MIT License',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of <alt max="4">this software</alt> and associated '
                'documentation files (the "Software"), to deal in the Software without restriction',
    "reserved-notice": 'Copyright <optional>(c)</optional> <optional>©</optional> <alt max="8">year and owner</alt> All rights reserved',
}

_MARK = re.compile(r'<optional>|</optional>|<alt\s+max="(\d+)"\s*>(.*?)</alt>', re.S)


def _hashes(text: str) -> list[int]:
    return [int(x) for x in word_hashes(words(pa.array([text]), ALNUM, lower=True))]


@dataclass
class Template:
    """A token automaton. State i goes on ``step[i]`` (a word hash, or None for any word) to ``to[i]``."""

    name: str
    step: list
    to: list
    skip: list       # states reachable without a word
    start: int
    end: int
    firsts: np.ndarray
    phrase: np.ndarray

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def longest(self, h: list[int], at: int) -> int:
        """The word after the longest match that begins at word ``at``, or ``at``."""
        states, best, i = self.closure([self.start]), at, at
        while states and i < len(h):
            w = h[i]
            states = self.closure({self.to[s] for s in states if self.to[s] is not None and (self.step[s] is None or self.step[s] == w)})
            i += 1
            if self.end in states:
                best = i
        return best


def compile_template(name: str, text: str) -> Template:
    """Parse the markup and build the automaton."""
    step, to, skip = [], [], []

    def state() -> int:
        step.append(None)
        to.append(None)
        skip.append([])
        return len(step) - 1

    start = now = state()
    opened, run, runs, at = [], [], [], 0

    def literal(part: str) -> None:
        nonlocal now
        for w in _hashes(part):
            new = state()
            step[now], to[now] = w, new
            now = new
            if not opened:
                run.append(w)

    def close_run() -> None:
        runs.append(list(run))
        run.clear()

    for m in _MARK.finditer(text):
        literal(text[at:m.start()])
        at = m.end()
        close_run()
        if m.group(0) == "<optional>":
            opened.append(now)
            new = state()
            skip[now].append(new)
            now = new
        elif m.group(0) == "</optional>":
            if not opened:
                raise ValueError(f"{name}: </optional> without <optional>")
            new = state()
            skip[now].append(new)
            skip[opened.pop()].append(new)
            now = new
        else:
            out = state()
            for _ in range(int(m.group(1))):
                skip[now].append(out)
                new = state()
                to[now] = new
                now = new
            skip[now].append(out)
            now = out
    literal(text[at:])
    close_run()
    if opened:
        raise ValueError(f"{name}: <optional> is not closed")
    phrase = max(runs, key=len)
    if not phrase:
        raise ValueError(f"{name}: no mandatory word")
    t = Template(name, step, to, skip, start, now, np.zeros(0, np.uint64), np.array(phrase, dtype=np.uint64))
    first = [s for s in t.closure([start]) if to[s] is not None]
    firsts = sorted({step[s] for s in first if step[s] is not None})
    t.firsts = None if any(step[s] is None for s in first) else np.array(firsts, dtype=np.uint64)
    return t


def places(h: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively in one text."""
    m = len(h) - len(phrase) + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    hit = h[:m] == phrase[0]
    for j in range(1, len(phrase)):
        hit &= h[j:m + j] == phrase[j]
    return np.flatnonzero(hit & (row[:m] == row[len(phrase) - 1:]))


def scan(w: Words, h: np.ndarray, phrases, templates) -> list[tuple]:
    """(row, label, first word, word after, is base) of every match; words from 0 in their text."""
    found = []
    for label, phrase in phrases:
        for p in places(h, w.row, phrase).tolist():
            r = int(w.row[p])
            found.append((r, label, p - int(w.first[r]), p - int(w.first[r]) + len(phrase), True))
    for t in templates:
        for r in np.unique(w.row[places(h, w.row, t.phrase)]).tolist():
            mine = h[w.first[r]:w.first[r + 1]]
            begin = np.arange(len(mine)) if t.firsts is None else np.flatnonzero(np.isin(mine, t.firsts))
            text, after = mine.tolist(), 0
            for i in begin.tolist():
                if i >= after and (j := t.longest(text, i)) > i:
                    found.append((r, t.name, i, j, False))
                    after = j
    return found


def _mapper(text_at: int, schema: pa.Schema, phrases: dict, templates: dict):
    def run(batches):
        base = [(label, np.array(_hashes(p), dtype=np.uint64)) for p, label in phrases.items()]
        machines = [compile_template(n, t) for n, t in templates.items()]
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at]):
                w = words(part.column(text_at), ALNUM, lower=True)
                h = word_hashes(w)
                n = w.counts()
                by_row: dict[int, list] = {}
                for f in scan(w, h, base, machines):
                    by_row.setdefault(f[0], []).append(f[1:])
                out = []
                for i in range(part.num_rows):
                    hits = sorted(by_row.get(i, ()), key=lambda x: (x[1], x[2], x[0]))
                    own = [x for x in hits if x[3]]
                    covered, reach = 0, 0
                    for _, a, b, _ in hits:
                        covered += max(0, b - max(a, reach))
                        reach = max(reach, b)
                    out.append((len(own), own[0][1] if own else None, own[-1][1] if own else None, ",".join(sorted({x[0] for x in own})),
                                ",".join(sorted({x[0] for x in hits})), covered / int(n[i]) if n[i] else 0.0,
                                [{"label": x[0], "first": x[1], "after": x[2]} for x in hits]))
                cols = list(zip(*out)) if out else [()] * 7
                keep = part.num_columns
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()),
                                                  *[pa.array(c, schema.field(keep + 1 + j).type) for j, c in enumerate(cols)]], names=schema.names)
    return run


_ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


def scan_licenses(docs: DataFrame, *, text_col: str = "text", phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, first, after)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    ship(docs.sparkSession)
    for n, t in templates.items():
        compile_template(n, t)  # bad markup fails here, not in a task
    docs = docs.drop(*_ADDED)
    added = T._parse_datatype_string("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                                     "matches array<struct<label:string,first:bigint,after:bigint>>")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(_mapper(docs.columns.index(text_col), to_arrow_schema(schema), dict(phrases), dict(templates)), schema)


def license_scan(docs: DataFrame, **how) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text"), **how).select("doc_id", *_ADDED[:-1])
