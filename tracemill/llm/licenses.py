"""License notices found by patience alignment.

A text is aligned with a template as in patience diff: words that occur once in both are anchors,
the longest increasing run of anchors is kept, and the gaps between them are aligned the same way.
The share of the template's words that are aligned is its coverage. Whole texts are searched:
around every occurrence of a template's telling words, a window of three template lengths is
aligned, so repeated notices and notices in long texts are found. A template can only reach the
least coverage if one of its telling words is there, so other texts are passed over. Only a notice
that was found is passed over by the search; a window that covers several copies is cut down to one.
Templates of different licenses may be nearly equal (versions) or part of each other (GPL and LGPL):
what tells them apart must be aligned, and a part of another license's notice is not a notice.

Defined results: NULL and texts without words have no license. Of several licenses the one with the
highest coverage, then the longest template, then the first name is given; ``licenses`` has all.
Repeated rows have the same result each. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and texts of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
}


def _wordings() -> list[tuple[str, str]]:
    """Other fixed wordings of the common families: headers, short sentences, links and SPDX lines."""
    out: list[tuple[str, str]] = []
    ids: list[str] = []

    for short, kind, versions in (
        ("GPL", "General", ("1", "2", "3")),
        ("LGPL", "Library General", ("2",)),
        ("LGPL", "Lesser General", ("2.1", "3")),
        ("AGPL", "Affero General", ("1", "3")),
    ):
        title = f"GNU {kind} Public License"
        out += [(short, f"under the {title}"), (short, f"under the terms of the {title}"), (short, f"under the {short}")]
        for v in versions:
            name = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            ids += [name, f"{name}-only", f"{name}-or-later"]
            head = f"This program is free software: you can redistribute it and/or modify it under the terms of the {title}"
            out += [
                (f"{name}-or-later", f"{head} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"),
                (name, f"{head} as published by the Free Software Foundation, version {v} of the License"),
                (name, f"This work is licensed under the {title}, version {v}."),
            ]
            for number in sorted({v, v if "." in v else f"{v}.0"}):
                out += [
                    (name, f"{title}{mark}{number}") for mark in (" version ", " v", " v. ", " ")
                ] + [(name, f"under the {short}{mark}{number}") for mark in ("v", " v", " version ", " ", "-")]
                out.append((f"{name}-or-later", f"{title} version {number} or later"))
                out.append((f"{name}-or-later", f"{title} v{number} or later"))

    parts = {
        "BY": ["Attribution"],
        "NC": ["NonCommercial", "Non-Commercial"],
        "SA": ["ShareAlike", "Share Alike"],
        "ND": ["NoDerivatives", "NoDerivs", "No Derivatives"],
    }
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        titles = [mark.join(words) for words in product(*[parts[k] for k in kind.split("-")]) for mark in ("-", " ")]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-{kind}-{v}"
            ids.append(name)
            out += [(name, f"Creative Commons {title} {v}") for title in titles]
            sentence = f"This work is licensed under a Creative Commons {titles[0]} {v}"
            out += [(name, f"{sentence} {region} License.") for region in ("International", "Unported", "Generic")]
            out += [(name, f"CC {kind} {v}"), (name, f"CC-{kind} {v}"), (name, f"under {name}"), (name, f"under the {name}")]
            out += [(name, f"CC {kind.replace('-', ' ')} {v}")] if "-" in kind else []
            out.append((name, f"creativecommons.org/licenses/{kind}/{v}"))
    ids.append("CC0-1.0")
    out += [("CC0-1.0", t) for t in ("CC0 1.0 Universal", "CC0 1.0", "under CC0", "creativecommons.org/publicdomain/zero/1.0")]

    titles = {
        "MIT": ["MIT", "MIT/X11", "X11", "Expat"],
        "Apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache v2.0", "Apache v2"],
        "BSD-2-Clause": ["BSD 2-Clause", "BSD-2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD"],
        "BSD-3-Clause": ["BSD 3-Clause", "BSD-3-Clause", "3-clause BSD", "New BSD", "Modified BSD", "Revised BSD"],
        "BSD": ["BSD"],
        "0BSD": ["0BSD", "Zero-Clause BSD"],
        "ISC": ["ISC"],
        "MPL-1.1": ["MPL 1.1", "MPL-1.1"],
        "MPL-2.0": ["MPL 2.0", "MPL-2.0"],
        "Unlicense": ["Unlicense"],
        "Zlib": ["zlib", "zlib/libpng"],
        "BSL-1.0": ["Boost"],
        "EPL-1.0": ["EPL 1.0", "EPL-1.0"],
        "EPL-2.0": ["EPL 2.0", "EPL-2.0"],
    }
    for name, forms in titles.items():
        ids += [] if name == "BSD" else [name]
        for t in forms:
            out += [(name, f"under {x}{t} License") for x in ("the ", "", "the terms of the ")]
            out += [(name, f"{t} licensed")] if name in ("MIT", "BSD", "ISC") else [(name, f"under the {t}")]
    for name, title, versions in (
        ("Apache-2.0", "Apache License", ("2.0",)),
        ("MPL-1.1", "Mozilla Public License", ("1.1",)),
        ("MPL-2.0", "Mozilla Public License", ("2.0",)),
        ("BSL-1.0", "Boost Software License", ("1.0",)),
        ("EPL-1.0", "Eclipse Public License", ("1.0",)),
        ("EPL-2.0", "Eclipse Public License", ("2.0",)),
    ):
        out += [(name, f"{title}{mark}{v}") for v in versions for mark in (" version ", " v", " v. ", " ")]

    bsd = TEMPLATES["BSD-text"] + (
        " Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    )
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    out += [
        ("BSD-2-Clause", bsd),
        (
            "BSD-3-Clause",
            f"{bsd} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission.",
        ),
        ("0BSD", isc),
        ("ISC", f"{isc}, provided that the above copyright notice and this permission notice appear in all copies."),
        (
            "MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at",
        ),
        (
            "MPL-1.1",
            "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
            "use this file except in compliance with the License. You may obtain a copy of the License at",
        ),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        (
            "Zlib",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
            "alter it and redistribute it freely, subject to the following restrictions",
        ),
        (
            "BSL-1.0",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
            "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
            "execute, and transmit the Software",
        ),
        (
            "EPL-1.0",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
        ),
        (
            "EPL-2.0",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        ),
    ]
    return out + [(name, f"SPDX-License-Identifier: {name}") for name in ids]


#: All (license, notice); a license may have several wordings.
NOTICES = [*TEMPLATES.items(), *_wordings()]
#: Words that stand in most texts: they tell of a notice only if no other word does.
PLAIN = set("a all and any as at by for free in is it its license licensed of or other the this to under use v version with work you".split())
#: Share of a template's words that must be aligned.
COVERAGE = 0.9
#: Wordings of fewer words must stand without gaps: aligned with gaps, they fit sentences about other things.
SHORT = 10

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def plain_words(text: str | None) -> list[str]:
    """Words in small letters, without marks at their ends."""
    return _WORD.findall((text or "").lower())


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that rises in the second (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        # Equal ends are aligned first, as they need no anchors.
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if theirs[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(text[a:b], a) if ours[w] == 1 and w in place]
        run = _longest_increasing(anchors)
        if not run:
            continue
        out += run
        edges = [(a - 1, c - 1), *run, (b, d)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] | list[tuple[str, str]], coverage: float):
        self.least = coverage
        pairs = templates.items() if isinstance(templates, dict) else templates
        # Equal wordings once.
        self.templates = [(name, list(words)) for name, words in dict.fromkeys((n, tuple(plain_words(t))) for n, t in pairs)]
        known = Counter(w for _, words in self.templates for w in set(words))
        #: Templates by their telling words.
        self.telling: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(self.templates):
            # Long words of few templates first, until too much would be missing without them.
            counts, missing = Counter(words), 0
            for w in sorted(counts, key=lambda w: (w in PLAIN, known[w], -len(w), w)):
                if missing > (1 - coverage) * len(words):
                    break
                self.telling.setdefault(w, []).append(k)
                missing += counts[w]
        self._bags = [Counter(words) for _, words in self.templates]
        self._alike: dict[tuple[int, int], set[int] | None] = {}

    def _other(self, a: int, b: int) -> set[int] | None:
        """Positions of template ``a`` that ``b`` lacks; None if ``b`` does not cover ``a`` or is its license too."""
        if (a, b) not in self._alike:
            (name, words), (other, theirs) = self.templates[a], self.templates[b]
            lacks = None
            if name.removesuffix("-text") != other.removesuffix("-text"):
                least = self.least * len(words)
                if (self._bags[a] & self._bags[b]).total() >= least:
                    pairs = patience(theirs, words)
                    lacks = set(range(len(words))) - {q for _, q in pairs} if len(pairs) >= least else None
            self._alike[a, b] = lacks
        return self._alike[a, b]

    def _told_apart(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether what tells the template from similar ones of other licenses (a version) is there."""
        if len(pairs) == len(self.templates[k][1]):
            return True
        there = {b for _, b in pairs}
        lacks = (self._other(k, b) for b in range(len(self.templates)) if b != k)
        return all(2 * len(x & there) >= len(x) for x in lacks if x)

    def _aligned(self, words: list[str], template: list[str], seed: int, start: int, end: int) -> list[tuple[int, int]]:
        """Aligned positions of a window; only what lies close together is one notice."""
        n = len(template)
        pairs = [(a + start, b) for a, b in patience(words[start:end], template)]
        if pairs and pairs[-1][0] - pairs[0][0] >= 2 * n:
            middle = next((k for k, p in enumerate(pairs) if p[0] >= seed), len(pairs) - 1)
            pairs = [p for p in pairs if abs(p[0] - pairs[middle][0]) <= n]
        return pairs

    def _unbroken(self, words: list[str], template: list[str], seed: int) -> list[tuple[int, int]]:
        """A short wording around a seed, every word beside the next."""
        for place in (b for b, w in enumerate(template) if w == words[seed]):
            start = seed - place
            if start >= 0 and words[start : start + len(template)] == template:
                return [(start + b, b) for b in range(len(template))]
        return []

    def _notice(self, words: list[str], template: list[str], seed: int, same: list[int]) -> list[tuple[int, int]]:
        """The notice around a seed; ``same`` has all places of its word.

        A window that covers several notices has no unique words, so smaller ones are tried too: cut
        at the neighbouring places of the word, and where the notice lies if nothing is missing.
        """
        n = len(template)
        if n < SHORT:
            return self._unbroken(words, template, seed)
        start, end = max(0, seed - n), min(len(words), seed + 1 + 2 * n)
        ours = Counter(words[start:end])
        if sum(min(k, ours[w]) for w, k in Counter(template).items()) < self.least * n:
            return []
        k = bisect_left(same, seed)
        before = same[k - 1] + 1 if k else 0
        after = same[k + 1] if k + 1 < len(same) else len(words)
        windows = [(start, end), (max(start, before), min(end, after))]
        slack = n - math.ceil(self.least * n)
        for place in (b for b, w in enumerate(template) if w == words[seed]):
            windows += [(max(0, seed - place - m), seed - place + n + m) for m in sorted({0, slack})]
        best: list[tuple[int, int]] = []
        for start, end in windows:
            best = max(best, self._aligned(words, template, seed, start, end), key=len)
            if len(best) == n:
                break
        return best if len(best) >= self.least * n else []

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of the best place of each license."""
        words = plain_words(text)
        places: dict[str, list[int]] = {w: [] for w in self.telling.keys() & set(words)}
        if not places:
            return []
        for k, w in enumerate(words):
            if w in places:
                places[w].append(k)
        seeds: dict[int, list[int]] = {}
        for w, at in places.items():
            for t in self.telling[w]:
                seeds.setdefault(t, []).extend(at)
        #: (template, aligned words, first word, last word)
        found: list[tuple[int, int, int, int]] = []
        for t in sorted(seeds):
            template, end = self.templates[t][1], -1
            for seed in sorted(seeds[t]):
                if seed < end:
                    continue
                pairs = self._notice(words, template, seed, places[words[seed]])
                if not pairs or not self._told_apart(t, pairs):
                    continue
                # Only a notice that was found is passed over.
                end = pairs[-1][0] + 1
                found.append((t, len(pairs), pairs[0][0], pairs[-1][0]))
        best: dict[str, tuple[float, int, int, int]] = {}
        for t, n, first, last in self._own(found):
            name, template = self.templates[t]
            new = (n / len(template), len(template), first, last)
            if name not in best or new[:2] > best[name][:2]:
                best[name] = new
        order = sorted(best.items(), key=lambda f: (-f[1][0], -f[1][1], f[0]))
        return [(name, share, first, last) for name, (share, _, first, last) in order]

    def _own(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Notices without those that are part of another license's notice at the same place."""
        out = []
        rows = sorted(found, key=lambda f: f[2])
        starts = [f[2] for f in rows]
        reach = 2 * max((len(words) for _, words in self.templates), default=0)
        for t, n, first, last in rows:
            near = rows[bisect_left(starts, first - reach) : bisect_left(starts, last + 1)]
            if not any(
                u != t and m > n and begin <= last and first <= end and self._other(t, u) is not None
                for u, m, begin, end in near
            ):
                out.append((t, n, first, last))
        return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """Best license, its coverage and place, and all licenses, of every document."""
    templates = NOTICES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            found = [scanner.scan(t) for t in batch["text"]]
            best = [f[0] if f else (None, None, None, None) for f in found]
            out = pd.DataFrame(best, columns=["license", "coverage", "first_word", "last_word"])
            out = out.astype({"coverage": "Float64", "first_word": "Int64", "last_word": "Int64"})
            out["licenses"] = [[name for name, *_ in f] for f in found]
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run,
        "doc_id long, license string, coverage double, first_word long, last_word long, licenses array<string>",
    )
