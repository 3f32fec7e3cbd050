"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are lower-cased words (runs of letters, digits and non-ASCII bytes) and
shingles of five.  For a template of T shingles, windows of 2T shingles (up to
a whole step) start every T/2, so any stretch of at most 3T/2 shingles lies whole in one of
them, wherever it begins; a copy that insertions make longer than that may be cut.  A window
of W shingles that contains k of the template's has a Jaccard similarity with it of at least
k / (W + T - k); the number of bands follows from the least such bound and the wanted
probability that such a window shares a band.  A band holds ROWS minima and is looked up in one sorted
table of all templates' bands, so more templates cost no more passes.  A window without any shingle of a
template shares no minimum with it, so signatures are computed for the other windows only.  Windows retrieved are compared shingle by
shingle.  Templates of different licenses that share shingles (versions of one license, say) are
rivals: of their matches on the same stretch of text only those of the best containment stay.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytewords import column_bytes
from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir

SHINGLE, LEAST, PROBABILITY, ROWS = 5, 0.8, 0.9999, 2
#: Bytes of text worked on at once; shingles of windows signed at once; longer words than LONG bytes are in no template.
CHUNK, SIGNED, LONG = 1 << 20, 1 << 20, 1024

# Well-known public license notices, by license and form (``-header``, ``-notice``).
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "GNU Affero General Public License, version 3",
    "AGPL-3.0-notice-v": "GNU Affero General Public License v3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice-released": "Released under the Apache License 2.0",
    "Apache-2.0-notice-bare": "Licensed under Apache License 2.0",
    "Apache-2.0-notice-short": "Licensed under the Apache License 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-notice": "Licensed under the BSD License",
    "BSD-notice-released": "Released under the BSD License",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "CC0-1.0-header-waiver": "has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-notice": "Licensed under CC0 1.0 Universal",
    "CC0-1.0-notice-short": "CC0 1.0 Universal Public Domain Dedication",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License 2.0",
    "EPL-2.0-notice-v": "Eclipse Public License - v 2.0",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-header-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-notice": "GNU General Public License, version 2",
    "GPL-2.0-notice-short": "Licensed under the GNU GPL, version 2",
    "GPL-2.0-notice-v": "GNU General Public License v2",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice-short": "Licensed under the GNU GPL, version 3",
    "GPL-3.0-notice-terms": "under the terms of the GNU General Public License, version 3",
    "GPL-3.0-notice-v": "GNU General Public License v3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-notice": "Licensed under the ISC License",
    "ISC-notice-released": "Released under the ISC License",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-notice-v": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "GNU Lesser General Public License, version 3",
    "LGPL-3.0-notice-v": "GNU Lesser General Public License v3",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-available": "Available under the MIT License",
    "MIT-notice-distributed": "Distributed under the MIT License",
    "MIT-notice-licensed": "Licensed under the MIT License",
    "MIT-notice-terms": "Under the terms of the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0",
    "MPL-2.0-notice-short": "Licensed under the Mozilla Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = True
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(text: str) -> list[bytes]:
    raw = text.encode().lower()
    a = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[np.frombuffer(raw, np.uint8)], [False]])))
    return [raw[i:j] for i, j in zip(a[::2].tolist(), a[1::2].tolist(), strict=True)]


def license_of(name: str) -> str:
    """The license of a template's name, without its form."""
    return name.split("-notice")[0].split("-header")[0]


def with_identifiers(templates: dict[str, str]) -> dict[str, str]:
    """Also the SPDX line of each license whose line has a shingle of its own."""
    lines = {f"{of}-notice-spdx": f"SPDX-License-Identifier: {of}" for of in map(license_of, templates)}
    return {**templates, **{k: v for k, v in lines.items() if len(words_of(v)) >= SHINGLE}}


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def grid_of(size: int) -> tuple[int, int]:
    """Step between windows of a template of ``size`` shingles, and steps in a window."""
    step = -(-size // 2)
    return step, -(-2 * size // step)


def bands_needed(sizes: list[int], least: float, probability: float, rows: int) -> int:
    """Bands of ``rows`` hashes so that a window with containment ``least`` of any template shares one."""
    need = 1
    for size in sizes:
        step, wide = grid_of(size)
        k = max(1, math.ceil(least * size - 1e-9))
        same = (k / (step * wide + size - k)) ** rows
        need = max(need, math.ceil(math.log(1 - probability) / math.log(1 - same)) if same < 1 else 1)
    return need


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from running sums of hashed bytes, plain and weighed by place."""
    h = _mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    flat, placed = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=flat[1:])
    h *= np.arange(1, len(h) + 1, dtype=np.uint64)
    np.cumsum(h, out=placed[1:])
    out = (placed[end] - placed[start]) - (flat[end] - flat[start]) * start.astype(np.uint64)
    return _mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hash of the SHINGLE words from each place."""
    n = max(0, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out + words[k:k + n]) * np.uint64(0x94D049BB133111EB)
    return _mix(out)


class Templates:
    """Bands of templates in one table a band, and the shingles of all of them."""

    def __init__(self, texts: dict[str, str], least: float = LEAST, probability: float = PROBABILITY, rows: int = ROWS):
        known = {name: words_of(text) for name, text in sorted(texts.items())}
        for name, words in known.items():
            if len(words) < SHINGLE or max(map(len, words)) >= LONG:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words or a word of {LONG} bytes")
        self.least, self.rows, self.names = least, rows, list(known)
        self.shingles = {name: shingles_of(words) for name, words in known.items()}
        self.size = {name: len(words) - SHINGLE + 1 for name, words in known.items()}
        self.sizes = sorted(set(self.size.values()))
        need = {size: bands_needed([size], least, probability, rows) for size in self.sizes}
        self.bands = max(need.values(), default=0)
        self.seeds = np.random.default_rng(7).integers(0, 1 << 63, (self.bands, rows), dtype=np.uint64)
        hashes = {}
        for name, words in known.items():
            raw = np.frombuffer(b" ".join(words), np.uint8)
            end = np.cumsum([len(w) + 1 for w in words]) - 1
            hashes[name] = shingle_hashes(_word_hashes(raw, end - [len(w) for w in words], end))
        self.known = np.unique(np.concatenate([*hashes.values(), np.zeros(0, np.uint64)]))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.known >> np.uint64(44)] = True
        self.held = np.zeros((len(self.sizes), len(self.known)), bool)  # which size of template holds a shingle
        for name, h in hashes.items():
            self.held[self.sizes.index(self.size[name]), np.searchsorted(self.known, h)] = True
        self.tables = []
        for band in range(self.bands):
            own = [i for i, name in enumerate(self.names) if band < need[self.size[name]]]
            number = np.array([self.sizes.index(self.size[self.names[i]]) for i in own])
            keys = np.concatenate([self._keys(hashes[self.names[i]], np.zeros(1, np.int64), band, number[[j]]) for j, i in enumerate(own)])
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], np.array(own)[order]))
        self.overlap = max((self.span(name) for name in self.names), default=0)
        self.rivals = {a: [b for b in known if license_of(a) != license_of(b) and self.shingles[a] & self.shingles[b]] for a in known}

    def _keys(self, h: np.ndarray, at: np.ndarray, band: int, number: np.ndarray) -> np.ndarray:
        """Key of a band's minima of each window that begins ``at`` in h, with the number of its window length."""
        out = number.astype(np.uint64) + np.uint64(1)
        for seed in self.seeds[band]:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(_mix(h ^ seed), at))
        return out

    def _windows(self, h: np.ndarray, first: np.ndarray, n: np.ndarray, base: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number of the window length, text, first shingle within it) of all windows that hold a
        shingle of a template of that length."""
        pos = np.flatnonzero(self.quick[h >> np.uint64(44)])
        at = np.searchsorted(self.known, h[pos])
        at[at == len(self.known)] = 0
        same = self.known[at] == h[pos] if len(pos) else np.zeros(0, bool)
        pos, at = pos[same], at[same]
        text = np.searchsorted(first, pos, side="right") - 1
        inner = pos - first[text]
        whole = inner < n[text]  # not across two texts
        at, text, inner = at[whole], text[whole], inner[whole]
        out = [np.zeros((3, 0), np.int64)]
        for number, size in enumerate(self.sizes):
            use = np.flatnonzero(self.held[number, at])
            if not len(use):
                continue
            step, wide = grid_of(size)
            t = np.tile(text[use], wide)
            k = ((base[text[use]] + inner[use]) // step - np.arange(wide)[:, None]).ravel()
            begin = k * step - base[t]
            ok = (begin >= 0) & (begin < starts[t])
            key = np.unique(t[ok] << 40 | begin[ok])
            out.append(np.stack([np.full(len(key), number), key >> 40, key & (1 << 40) - 1]))
        return tuple(np.concatenate(out, axis=1))

    def candidates(self, h: np.ndarray, first: np.ndarray, n: np.ndarray, base: np.ndarray, starts: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """h: shingle hashes of pieces of texts end to end; first, n: where each piece's begin, how many;
        base: its first shingle within its text; starts: windows begin before this shingle of the piece.
        Yields (template, piece of each retrieved window, its first shingle within the piece)."""
        number, text, begin = self._windows(h, first, n, base, starts)
        if not len(text):
            return
        width = np.array([step * wide for step, wide in map(grid_of, self.sizes)])
        size = np.minimum(width[number], n[text] - begin)
        found, low, total = [], 0, np.cumsum(size)
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(total, total[low] - size[low] + SIGNED, side="right")))
            of = size[low:high]
            edge = np.cumsum(of) - of
            own = h[np.repeat((first[text] + begin)[low:high] - edge, of) + np.arange(of.sum())]
            for band, (keys, template) in enumerate(self.tables):
                key = self._keys(own, edge, band, number[low:high])
                a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                hit = np.flatnonzero(b > a)
                times = b[hit] - a[hit]
                entry = np.repeat(a[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                found.append(template[entry] * len(size) + low + np.repeat(hit, times))
            low = high
        pairs = np.unique(np.concatenate(found))
        for i in np.unique(pairs // len(size)).tolist():
            w = pairs[pairs // len(size) == i] % len(size)
            yield self.names[i], text[w], begin[w]

    def span(self, name: str) -> int:
        """Words of a window of this template."""
        step, wide = grid_of(self.size[name])
        return step * wide + SHINGLE - 1


def stretch(words: list[bytes], want: set[tuple[bytes, ...]]) -> tuple[int, int]:
    """First and last shingle of the shortest stretch with all of ``want`` that ``words`` hold."""
    at = [(i, s) for i in range(len(words) - SHINGLE + 1) if (s := tuple(words[i:i + SHINGLE])) in want]
    held, left, distinct, best = Counter(), 0, len({s for _, s in at}), (at[0][0], at[-1][0])
    for i, s in at:
        held[s] += 1
        while len(held) == distinct:
            j, first = at[left]
            best = min(best, (j, i), key=lambda x: x[1] - x[0])
            held[first] -= 1
            if not held[first]:
                del held[first]
            left += 1
    return best


def without_rivals(matches: list[tuple], templates: Templates) -> Iterator[tuple]:
    """Matches (template, containment, first word, stretch) of a text, without those that share more than
    half of the shorter stretch with a better match of a rival."""
    places = defaultdict(list)
    for name, share, _, (lo, hi) in matches:
        places[name].append((lo, hi, share))
    for of in places.values():
        of.sort()
    for match in matches:
        name, share, _, (lo, hi) = match
        beaten = False
        for rival in templates.rivals[name]:
            of = places.get(rival, ())
            for at in range(bisect.bisect_left(of, (lo - templates.span(rival),)), len(of)):
                a, b, other = of[at]
                if beaten or a > hi:
                    break
                beaten = other > share and 2 * (min(hi, b) - max(lo, a) + SHINGLE) > min(hi - lo, b - a) + SHINGLE
        if not beaten:
            yield match


def _spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    turn = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[np.frombuffer(data, np.uint8)], [False]])))
    return turn[::2], turn[1::2]


def _pieces(texts: Iterable[bytes], overlap: int) -> Iterator[tuple]:
    """Lower-cased texts in pieces of about CHUNK bytes: (bytes, starts and ends of words, first word of each
    part, text of each part, its first word within the text, windows begin before this word of the part).
    Short texts share a piece.  A longer one is cut between words, each piece with the last words of the one before;
    of words beyond LONG bytes only the beginning is carried on, and of one beyond CHUNK bytes only that is read."""
    held, of, size = [], [], 0

    def together():
        data = b"\n".join(held)
        start, end = _spans(data)
        word_at = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in held)]))
        return data, start, end, word_at, np.array(of), np.zeros(len(of), np.int64), np.diff(word_at)

    for i, raw in enumerate(texts):
        if held and size + len(raw) > CHUNK:
            yield together()
            held, of, size = [], [], 0
        if len(raw) <= CHUNK:
            held.append(raw.lower())
            of.append(i)
            size += len(raw) + 1
            continue
        raw, at, carried, base = raw.lower(), 0, b"", 0
        while at < len(raw):
            cut = _BREAK.search(raw, min(at + CHUNK, len(raw)))
            cut = cut.start() if cut else len(raw)
            data = carried + raw[at:min(cut, at + 2 * CHUNK)]
            start, end = _spans(data)
            own = len(start) if cut == len(raw) else max(0, len(start) - overlap + 1)
            yield data, start, end, np.array([0, len(start)]), np.array([i]), np.array([base]), np.array([own])
            carried = b"".join(data[a:min(b, a + LONG)] + b" " for a, b in zip(start[own:].tolist(), end[own:].tolist(), strict=True))
            base += own
            at = cut
    if held:
        yield together()


def scan_bytes(texts: Iterable[bytes], templates: Templates) -> Iterator[tuple[int, str, float, int, int]]:
    """(text, template, best containment, first word of the best window, windows that match)."""
    matches = defaultdict(list)
    for data, start, end, word_at, of, base, starts in _pieces(texts, templates.overlap):
        hashes = shingle_hashes(_word_hashes(np.frombuffer(data, np.uint8), start, end))
        n = np.maximum(np.diff(word_at) - SHINGLE + 1, 0)
        for name, text, place in templates.candidates(hashes, word_at[:-1], n, base, starts):
            want, span = templates.shingles[name], templates.span(name)
            for t, p in zip(text.tolist(), place.tolist(), strict=True):
                a, b = word_at[t] + p, min(word_at[t] + p + span, word_at[t + 1])
                own = [data[i:j] for i, j in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                share = len(want & shingles_of(own)) / len(want)
                if share >= templates.least:
                    lo, hi = stretch(own, want)
                    p += int(base[t])
                    matches[int(of[t])].append((name, share, p, (p + lo, p + hi)))
    found: dict[tuple[int, str], list] = {}
    for t, hits in matches.items():
        for name, share, p, _ in without_rivals(hits, templates):
            best = found.setdefault((t, name), [0.0, 0, 0])
            best[2] += 1
            if share > best[0]:
                best[:2] = share, p
    for (t, name), (share, p, times) in sorted(found.items()):
        yield t, name, share, p, times


def scan_texts(texts: list[str], templates: Templates) -> Iterator[tuple[int, str, float, int, int]]:
    """As scan_bytes, of strings."""
    return scan_bytes((t.encode() for t in texts), templates)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document and template found in it: id_col, license, template (the form of the license),
    containment (best window's; the first one's among equals), first_word (of that window), n_windows.

    Null, empty and short texts match nothing; null ids stay null; repeated rows are reported
    each time; an empty table gives an empty result; very long texts are scanned whole, in overlapping pieces, with the
    result that one piece would give; other columns are not read.  ``templates`` are texts of at least five words by name (a license and
    its form, see license_of); by default TEMPLATES and the SPDX lines of its licenses."""
    checkpoint_dir(docs.sparkSession)
    known = Templates(with_identifiers(TEMPLATES) if templates is None else templates, least)
    src = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(scan_bytes(column_bytes(b.column(1)), known))
            at, name, *rest = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(map(license_of, name), pa.string()), pa.array(name, pa.string()),
                 *(pa.array(c, k) for c, k in zip(rest, (pa.float64(), pa.int64(), pa.int64()), strict=True))],
                [id_col, "license", "template", "containment", "first_word", "n_windows"])

    return src.mapInArrow(tidy(run), f"`{id_col}` bigint, license string, template string, containment double, first_word bigint, n_windows bigint")
