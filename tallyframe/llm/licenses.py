"""License scan by conditional compression against templates, confirmed by exact wording differences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, chunks, text_bytes

# Wordings of public licenses and notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General"
        " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
        " which is available at",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    *[
        (f"{short}-{number if '.' in number else number + '.0'}", f"GNU {kind}General Public License, version {number}.")
        for short, kind, numbers in (("GPL", "", "2 3"), ("LGPL", "Library ", "2"), ("LGPL", "Lesser ", "2.1 3"), ("AGPL", "Affero ", "3"))
        for number in numbers.split()
    ],
    *[
        (name, f"SPDX-License-Identifier: {name}")
        for name in "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-2.0 BSD-2-Clause BSD-3-Clause"
        " ISC Unlicense CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0".split()
    ],
)
# Words that tell licenses and their versions apart. A notice that lacks one of its template's, or has another, is
# a notice of something else.
TELLING = frozenset(
    b"mit apache mozilla eclipse bsd isc unlicense gnu general lesser affero gpl lgpl agpl mpl epl cc cc0 nc sa nd clause"
    b" 1 1.0 1.1 2 2.0 2.1 3 3.0 4 4.0".split()
)
# Lower-case wordings one of which any block worth comparing has.
CUES = (b"licen", b"copyright", b"rights reserved", b"permission", b"redistribut", b"public domain", b"spdx", b"cc by", b"cc0")

LEVEL = 9
MAX_DIFFERENCE = 0.25
WORD = re.compile(rb"[0-9a-z\x80-\xff.]*[0-9a-z\x80-\xff]")
# Cues of several words may be wrapped, with comment marks at the line's start.
CUE_FORMS = [re.compile(rb"[^0-9a-z\x80-\xff]+".join(map(re.escape, c.split()))) for c in CUES]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        raw = [t.encode() for _, t in templates]
        self.words = [words_of(t) for t in raw]
        self.telling = [Counter(w for w in own if w in TELLING) for own in self.words]
        # How far from a cue a notice may reach, added words included.
        self.reaches = [len(own) + int(MAX_DIFFERENCE * len(own)) for own in self.words]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.packers = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            for t in raw
        ]

    @property
    def reach(self) -> int:
        """Words that a notice of the longest template may have, added ones included."""
        return max(self.reaches, default=0)

    def saved(self, plain_size: int, block: bytes, template: int) -> int:
        """Bytes that a template saves as the dictionary of a block."""
        return plain_size - len(self.packers[template].compress(block))

    def is_named(self, words: list[bytes], template: int) -> bool:
        """Whether the words that tell licenses apart are the template's own, no more and no fewer."""
        return Counter(w for w in words if w in TELLING) == self.telling[template]

    def spans(self, words: list[bytes], template: int) -> list[tuple[int, int, int, int]]:
        """(missing, added, start, end) of stretches of ``words`` that are the template but for a quarter of its
        words at most: words of it that they lack, and words in between that it lacks. They do not overlap; of those
        that would, the one with the fewest differences counts, then the one that ends first."""
        ours = self.words[template]
        limit, out, todo = int(MAX_DIFFERENCE * len(ours)), [], [(0, len(words))]
        need = Counter(ours)
        while todo:
            lo, hi = todo.pop()
            held = Counter(w for w in words[lo:hi] if w in need)
            if sum(min(n, held[w]) for w, n in need.items()) < max(1, len(ours) - limit):
                continue
            places = {w: np.array([x == w for x in words[lo:hi]]) for w in need}
            n = hi - lo
            step = n + 1  # one difference; what is below counts words from the stretch's start to ``hi``
            along = step * np.arange(n + 1)
            cost = n - np.arange(n + 1)
            for w in ours:
                now = cost + step
                now[1:] = np.where(places[w], np.minimum(now[1:], cost[:-1]), now[1:])
                cost = np.minimum.accumulate(now - along) + along
            differences, starts = cost // step, n - cost % step
            ends = np.flatnonzero(differences <= limit)
            taken: list[tuple[int, int]] = []
            free = np.ones(n, bool)
            for end in ends[np.argsort(differences[ends], kind="stable")].tolist():
                start, d = int(starts[end]), int(differences[end])
                if start < end and free[start:end].all():
                    free[start:end] = False
                    taken.append((start, end))
                    same = (len(ours) + end - start - d) // 2
                    out.append((len(ours) - same, end - start - same, lo + start, lo + end))
            if taken:
                taken.sort()
                edges = [0, *[e for pair in taken for e in pair], n]
                todo += [(lo + a, lo + b) for a, b in zip(edges[::2], edges[1::2])]
        return sorted(out, key=lambda x: x[2])


LONGEST = Templates().reach


class _Places:
    """The words of a text, and which of them hold or precede a cue."""

    def __init__(self, text: bytes):
        low = text.translate(LOWER)
        at = sorted({m.start() for cue in CUE_FORMS for m in cue.finditer(low)})
        self.spans = [m.span() for m in WORD.finditer(low)] if at else []
        starts = [a for a, _ in self.spans]
        self.cues = sorted({max(0, bisect_right(starts, x) - 1) for x in at}) if starts else []
        self.words = [low[a:b] for a, b in self.spans]

    def blocks(self, reach: int) -> list[tuple[int, int]]:
        """Stretches of words around cues; those that touch are one."""
        merged: list[list[int]] = []
        for i in self.cues:
            start, end = max(0, i - reach), min(len(self.words), i + reach + 1)
            if merged and start <= merged[-1][1]:
                merged[-1][1] = end
            else:
                merged.append([start, end])
        return [tuple(m) for m in merged]


def blocks_of(text: bytes, reach: int | None = None) -> list[bytes]:
    """Stretches around cues: ``reach`` words to either side, across lines, by default as many as a notice of the
    longest template may have. Stretches that touch are one."""
    places = _Places(text)
    return [text[places.spans[a][0] : places.spans[b - 1][1]] for a, b in places.blocks(LONGEST if reach is None else reach)]


def scan_text(templates: Templates, text: bytes) -> list[dict]:
    """Confirmed licenses of a text, in order of place.

    Around each cue, the words that a notice of a template can reach are compressed alone and with the template as
    dictionary. Templates that save bytes are ranked by that, and confirmed in this order by wording: a stretch may differ
    in a quarter of the template's words, and in none that tell licenses apart. Of stretches that share more than half of
    their words with others', those with fewer differences count, then those whose template saves more.
    """
    places, found = _Places(text), {}
    for i in places.cues:
        ranked, plain = [], {}
        for t, reach in enumerate(templates.reaches):
            lo, hi = max(0, i - reach), min(len(places.words), i + reach + 1)
            block = text[places.spans[lo][0] : places.spans[hi - 1][1]]
            if (lo, hi) not in plain:
                plain[lo, hi] = len(templates.plain.compress(block))
            saved = templates.saved(plain[lo, hi], block, t)
            if saved > 0:
                ranked.append((-saved, t, lo, hi))
        for minus, t, lo, hi in sorted(ranked):
            for missing, added, start, end in templates.spans(places.words[lo:hi], t):
                if templates.is_named(places.words[lo + start : lo + end], t):
                    at = lo + start, lo + end, t
                    found[at] = min(found.get(at, (missing, added, minus)), (missing, added, minus))
    taken, out = np.zeros(len(places.words), bool), []
    for (start, end, t), (missing, added, minus) in sorted(found.items(), key=lambda x: (x[1][0] + x[1][1], x[1][2], x[0][2], x[0][0])):
        if 2 * np.count_nonzero(taken[start:end]) <= end - start:
            taken[start:end] = True
            out.append((start, {"license": templates.names[t], "saved": -minus, "missing": missing, "added": added}))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


FOUND = "array<struct<license: string, saved: bigint, missing: bigint, added: bigint>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per document its candidate blocks and confirmed licenses: key, n_blocks, found, licenses.

    A block is what lies around a cue, as far as a notice can reach, so notices may be wrapped. Blocks are compressed alone and
    with each template as a raw dictionary; templates are ranked by the bytes they save, and confirmed by wording: see
    :func:`scan_text`. ``found`` has the saving and the missing and added words (0 and 0: the exact wording) of each confirmed
    notice, ``licenses`` the distinct names in order. Missing, empty and
    other texts without a cue have no blocks. Repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    kind = pa.list_(pa.struct([("license", pa.string()), *[(c, pa.int64()) for c in ("saved", "missing", "added")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for part in chunks(batches, "__text"):
            texts = text_bytes(part.column("__text"))
            found = [scan_text(known, b) for b in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), pa.array([len(blocks_of(b, known.reach)) for b in texts], pa.int64()), pa.array(found, kind)],
                names=["__id", "n_blocks", "found"],
            )

    schema = f"__id {rows.schema['__id'].dataType.simpleString()}, n_blocks bigint, found {FOUND}"
    return rows.mapInArrow(run, schema).select(
        F.col("__id").alias(key), "n_blocks", "found", F.array_sort(F.array_distinct(F.col("found.license"))).alias("licenses")
    )
