"""License scans: a trained classifier of licence paragraphs, confirmed by templates.

Candidate paragraphs are of three kinds: windows of words that hold enough of
one template's word pairs, and what template pairs are left; SPDX expressions
and grants under a licence of any name; and the words around the name of a
licence. Every place of a text may begin one, so none is cut, and
windows with most pairs come first, so notices in a row are found each.

A candidate's features are sparse hashed indicators of single words, pairs and
triples. Multinomial logistic regression over them is trained on notices
made of a grammar, templates with words left out, and sentences that name
licences or use their words without being notices; a sigmoid fitted on rows outside the fit
calibrates how likely the paragraph is a licence at all, and below
``Settings.least`` it is none. The comparison confirms a family: enough of a
template with the version it names and what sets it apart from others alike,
or a name of the family. Of those confirmed, the regression's likeliest is the
finding; a licence whose family isn't confirmed is "unknown".
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskloom.llm import _words
from taskloom.llm._memory import lean
from taskloom.llm.quality import _sigmoid

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
    "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
    "license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
)
_UNLICENSE = (
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)


def _gnu(name: str, version: str, spdx: str) -> tuple[str, ...]:
    """The short notice, the file headers and the identifiers of a GNU licence."""
    own = f"under the terms of the GNU {name} as published by the Free Software Foundation; either version {version}"
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        f"This program is free software: you can redistribute it and/or modify it {own} of the License, or (at your option) any later version.",
        f"This library is free software; you can redistribute it and/or modify it {own} of the License, or (at your option) any later version.",
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation.",
        *[f"SPDX-License-Identifier: {spdx}{end}" for end in ("", "-only", "-or-later")],
    )


# Sentences of licence notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "AGPL-3.0"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _BSD,
        _BSD_THIRD,
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", _BOOST, "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This work is licensed under a CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "Licensed under the Eclipse Public License 1.0.",
        "SPDX-License-Identifier: EPL-1.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL-2.0": _gnu("General Public License", "2", "GPL-2.0"),
    "GPL-3.0": _gnu("General Public License", "3", "GPL-3.0"),
    "ISC": ("Licensed under the ISC License.", _ISC, "SPDX-License-Identifier: ISC"),
    "LGPL-2.0": _gnu("Library General Public License", "2", "LGPL-2.0"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "LGPL-2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPL-3.0"),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        _MIT,
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _UNLICENSE, "SPDX-License-Identifier: Unlicense"),
    "proprietary": ("All rights reserved.",),
}
FAMILIES = sorted(TEMPLATES)
#: Grants that name no family; a star stands for one to _NAME words.
GRANTS = tuple(f"{verb} under {the}* {noun}" for verb in ("licensed", "released", "distributed", "available") for the in ("", "the ", "the terms of the ") for noun in ("license", "licence"))
UNKNOWN, _NAME = "unknown", 6


def _versions(names: tuple[str, ...], version: str, short: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Names with a version in the ways people write it; short names have it in one word, too."""
    number = version.removesuffix(".0")
    ways = [f"{n} {v}" for n in (*names, *short) for v in dict.fromkeys((version, number, f"v{version}", f"v{number}", f"version {version}", f"version {number}"))]
    return (*ways, *[f"{n}{mid}{v}" for n in short for mid, v in (("-", version), ("-", number), ("v", number), ("v", version), ("-v", number))])


# What people call the families.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _versions(("GNU Affero General Public License", "Affero General Public License", "GNU AGPL"), "3.0", ("AGPL",)),
    "Apache-2.0": _versions(("Apache License", "Apache Software License", "Apache"), "2.0", ("Apache", "ASL")),
    "BSD": ("BSD", "BSD License", "BSD 2-Clause", "BSD 3-Clause", "2-clause BSD", "3-clause BSD", "New BSD", "Simplified BSD", "BSD-2-Clause", "BSD-3-Clause"),
    "BSL-1.0": ("Boost Software License", "Boost License", *_versions(("Boost Software License",), "1.0", ("BSL",))),
    "CC-BY": ("CC BY", "CC-BY", "Creative Commons Attribution", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-NC": ("CC BY-NC", "CC-BY-NC", "Creative Commons Attribution-NonCommercial", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-SA": ("CC BY-SA", "CC-BY-SA", "Creative Commons Attribution-ShareAlike", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero"),
    "EPL-1.0": _versions(("Eclipse Public License",), "1.0", ("EPL",)),
    "EPL-2.0": _versions(("Eclipse Public License",), "2.0", ("EPL",)),
    "GPL-2.0": _versions(("GNU General Public License", "GNU GPL"), "2.0", ("GPL",)),
    "GPL-3.0": _versions(("GNU General Public License", "GNU GPL"), "3.0", ("GPL",)),
    "ISC": ("ISC", "ISC License"),
    "LGPL-2.0": _versions(("GNU Library General Public License",), "2.0", ("LGPL",)),
    "LGPL-2.1": _versions(("GNU Lesser General Public License", "GNU LGPL"), "2.1", ("LGPL",)),
    "LGPL-3.0": _versions(("GNU Lesser General Public License", "GNU LGPL"), "3.0", ("LGPL",)),
    "MIT": ("MIT", "MIT License", "MIT-licensed", "Expat License"),
    "MPL-2.0": _versions(("Mozilla Public License",), "2.0", ("MPL",)),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "unknown": ("GPL", "LGPL", "AGPL", "GNU GPL", "GNU General Public License", "GNU Lesser General Public License", "Apache License", "Mozilla Public License", "MPL", "Eclipse Public License", "EPL"),
}
# Notices that training makes, with a name in place of the star; sentences with a name that are none, and without one.
NOTICES = (
    "this project is * licensed", "licensed under *", "licensed under the *", "licensed under the terms of the *", "released under *", "released under the * license", "distributed under the *",
    "distributed under the terms of the *", "available under the *", "made available under *", "is covered by the *", "license *", "license is *", "see the * for details", "* see license file",
    "under the * license", "dual licensed under * and", "published under the * license", "governed by a * license", "is * licensed", "* license", "the code is * licensed software", "subject to the terms of the *",
    "we use the * license", "this package uses the * license", "open source under *", "shared under a * license", "provided under *", "offered under the *", "ships with a * license",
    "copyright holders license this under *", "you may use this under *", "contributions are accepted under the *", "the terms of the * apply", "under * or later", "under * or any later version", "ships under *", "is under the *",
)
# Parts of made notices, one of each in a row; the second may be left out.
PARTS = (
    ("licensed", "released", "distributed", "available", "published", "shared", "offered", "provided", "covered", "open source", "free software", "redistributed", "use it", "you can use it", "code", "license", "may be used", "subject to", "governed by", "relicensed", "copyright by the authors", "everything is", "source files are"),
    ("under", "under", "by", "as", "to", ""),
    ("the terms of the", "the", "a", "the conditions of the", ""),
)
ENDS = ("license", "licence", "see the license file", "or later", "", "", "free software", "license text")
MENTIONS = (
    "students at * study", "a professor from *", "researchers at * found", "the * helicopter flew", "went to *", "the * campus", "according to * scientists", "the * team won", "in the * region", "* is a name",
    "a graduate of *", "the * tribe lived", "the * foundation meeting", "he joined *", "born near *", "the * institute announced", "called * by friends", "route * north", "*", "an * engineer said", "lecture at *",
    "she studied physics at *", "the old * building", "a study by * shows", "the * server crashed", "read about *", "the difference between * and others", "a talk about * history", "visit *",
)
OTHERS = (
    "the license of the driver", "driving license renewed", "a licensed plumber", "licensed physician", "permission was granted by the school", "all rights of way", "copyright law lecture", "the terms of the agreement between us",
    "under the bridge", "under the law and may park", "released under water", "distributed under desks", "a fishing license", "the software of the machine", "redistribution of wealth", "a work of art is on the table",
    "free of charge to any person", "in the public domain of politics", "see the file for details", "source code review meeting", "the notice of the meeting", "the licence fee was raised", "version 3 of the song", "as published by the newspaper",
    "either version of the story", "with or without sugar", "the above list of guests", "this program is on television", "this work is hard", "under the terms of the treaty", "rights were reserved for members", "available under the counter",
)
LABELS = [*FAMILIES, UNKNOWN]
#: From here on a candidate's number is of the name that it is around.
NAMED = 1 << 20
_BITS = 20
_PUNCTUATION = np.array([0x20 if chr(b) in ",;:()[]{}\"'!?<>*/" else b for b in range(256)], np.uint8)
#: Words without a template pair that a paragraph may hold in a row, and at least by how many a window may outgrow its template.
_GAP = 3


@dataclass(frozen=True)
class Settings:
    #: Training rows by template and from mixed template words; descent steps.
    rows_per_template: int = 10
    #: Made notices by family, and sentences that are none; words on either side of a name.
    notices: int = 240
    unknown_rows: int = 1500
    context: int = 6
    steps: int = 90
    penalty: float = 1e-4
    seed: int = 41
    #: Least probability of being a licence, and least part of a template's pairs, for a finding.
    least: float = 0.5
    confirmed: float = 0.75


def _plain(column: pa.Array) -> pa.Array:
    """Texts with punctuation as spaces; a full stop at a word's end is dealt with by the word's hash."""
    raw, offsets = _words.buffers(column)
    raw = _PUNCTUATION[raw]
    if len(raw):
        stop = (raw == 0x2E) & np.append((raw[1:] == 0x20) | (raw[1:] == 0x0A), True)
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        stop[ends] |= raw[ends] == 0x2E
        raw = np.where(stop, np.uint8(0x20), raw)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))


def _hashes(texts: list[str], lower: bool = True) -> list[np.ndarray]:
    groups = _words.words_of(_plain(pa.array(texts, pa.large_string())), lower)
    return [g.of(i) for g in groups for i in range(len(g))]


def _grams(words: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([_words.windows(words, n) for n in (1, 2, 3)]) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


class LicenceModel:
    """Classifier and templates; small and of fixed size."""

    def __init__(self, settings: Settings | None = None):
        self.settings = s = settings or Settings()
        sentences = [(FAMILIES.index(f), t) for f in FAMILIES for t in TEMPLATES[f]]
        words = _hashes([t for _, t in sentences])
        self.marker, *self.joints = [int(h[0]) for h in _hashes(["SPDX-License-Identifier", "or", "and", "with"])]
        self.spdx = {int(w[1]): f for (f, _), w in zip(sentences, words, strict=True) if int(w[0]) == self.marker}
        # Grants as verbs before "under", and the nouns that end them.
        self.verbs, self.nouns = (np.array([h[0] for h in _hashes(t)]) for t in (["licensed", "released", "distributed", "available"], ["license", "licence"]))
        self.under = _hashes(["under"])[0][0]
        self.family = np.array([f for f, _ in sentences])
        self.pairs = [np.unique(_words.windows(w, 2)) for w in words]
        self.known_pairs = np.unique(np.concatenate(self.pairs))
        #: Known pairs' templates, as runs of one array; pairs that confirm a template, and the span of its windows' pairs.
        self.inside = np.array([np.isin(self.known_pairs, p) for p in self.pairs])
        self.owners = np.nonzero(self.inside.T)[1]
        self.owned = np.append(0, np.cumsum(self.inside.sum(axis=0)))
        self.total = np.array([len(p) for p in self.pairs])
        self.needed = np.ceil(s.confirmed * self.total - 1e-9).astype(np.int64)
        self.span = np.array([len(w) - 2 + max(_GAP, len(w) // 4) for w in words])
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.known_pairs & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.keys = [self._keys(k, t) for k, (_, t) in enumerate(sentences)]
        #: Names as word sequences with their labels, the longest first; words that begin one. A name of one word in capitals must have them: "mit" is a German word.
        self.names = sorted(((h, LABELS.index(f)) for f, names in NAMES.items() for h in _hashes(list(names))), key=lambda r: -len(r[0]))
        capitals = [n for names in NAMES.values() for n in names if n.isalpha() and n.isupper()]
        self.capitals = dict(zip([int(h[0]) for h in _hashes(capitals)], [int(h[0]) for h in _hashes(capitals, False)], strict=True))
        self.opens: dict[int, list[tuple[np.ndarray, int]]] = {}
        for h, f in self.names:
            self.opens.setdefault(int(h[0]), []).append((h, f))
        self.opening = np.zeros(1 << _BITS, bool)
        self.opening[[h & ((1 << _BITS) - 1) for h in self.opens]] = True
        made = [h for t in (*NOTICES, *OTHERS, *MENTIONS, *ENDS, *[x for p in PARTS for x in p]) for h in _hashes(t.split("*"))]
        grams = np.unique(np.concatenate([_grams(w) for w in words] + [_grams(h) for h, _ in self.names] + [_grams(h) for h in made] + [_grams(h) for g in GRANTS for h in _hashes(g.split("*"))]))
        self.column = np.full(1 << _BITS, -1, np.int32)
        self.column[grams] = np.arange(len(grams))
        self.width = len(grams) + 2
        self._train(words, s)

    def _keys(self, k: int, text: str) -> list[tuple[np.ndarray, int]]:
        """Pairs of which some, the number given, must be there: each other family's alike template lacks them, or they have the version."""
        out = []
        for j in np.flatnonzero(self.family != self.family[k]):
            if 2 * np.isin(self.pairs[k], self.pairs[j]).sum() >= self.total[k]:
                only = np.setdiff1d(self.pairs[k], self.pairs[j])
                out.append((only, -(-len(only) // 2)))
        version = FAMILIES[self.family[k]].rpartition("-")[2]
        if version[0].isdigit():
            names = {version, version.removesuffix(".0"), f"v{version}"}
            own = _hashes([text])[0]
            at = np.flatnonzero(np.isin(own, np.array([_hashes([n])[0][0] for n in names])))
            if len(at):
                pairs = _words.windows(own, 2)
                out.append((np.unique(pairs[np.unique(np.clip(np.concatenate((at - 1, at)), 0, len(pairs) - 1))]), 1))
        return out

    def _stands(self, k: int, own: np.ndarray) -> bool:
        """Whether pairs have what sets a template apart."""
        return all(np.isin(some, own).sum() >= n for some, n in self.keys[k])

    def _row(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.float32)
        grams = _grams(words)
        at = self.column[grams]
        hit = at[at >= 0]
        out[hit] = 1 / np.sqrt(max(1, len(hit)))
        out[-2] = 1 - len(hit) / max(1, len(grams))
        out[-1] = 1
        return out

    def _train(self, words: list[np.ndarray], s: Settings) -> None:
        rng = np.random.Generator(np.random.PCG64(s.seed))
        pool = np.concatenate(words)
        rows, labels = [], []
        for f, w in zip(self.family.tolist(), words, strict=True):
            for k in range(max(s.rows_per_template, 60 // len(TEMPLATES[FAMILIES[f]]))):
                own = w if k % 4 == 0 else w[rng.random(len(w)) < 0.9]
                extra = rng.integers(0, 2**63, int(rng.integers(0, 4)) if k % 2 else 0).astype(np.uint64)
                rows.append(self._row(np.concatenate((extra[: len(extra) // 2], own, extra[len(extra) // 2 :]))))
                labels.append(f)
        for g in GRANTS:
            before, after = (_hashes([t])[0] for t in g.split("*"))
            for _ in range(2 * s.rows_per_template):
                name = rng.integers(0, 2**63, int(rng.integers(1, _NAME + 1))).astype(np.uint64)
                rows.append(self._row(np.concatenate((before, name, after))))
                labels.append(len(FAMILIES))
        of: dict[int, list[np.ndarray]] = {}
        for h, f in self.names:
            of.setdefault(f, []).append(h)

        def hashed(texts: tuple[str, ...]) -> list[np.ndarray]:
            return [_hashes([t])[0] if t else np.zeros(0, np.uint64) for t in texts]

        forms, mentions = [hashed(tuple(g.split("*"))) for g in NOTICES], [hashed(tuple(g.split("*"))) for g in MENTIONS]
        others = _hashes(list(OTHERS))
        parts, ends = [hashed(p) for p in PARTS], hashed(ENDS)

        def noise(most: int) -> np.ndarray:
            return rng.integers(0, 2**63, int(rng.integers(0, most + 1))).astype(np.uint64)

        def around(parts: list[np.ndarray], name: np.ndarray) -> np.ndarray:
            return np.concatenate((noise(5), parts[0], name, parts[1] if len(parts) > 1 else name[:0], noise(5)))

        for f, named in sorted(of.items()):
            for k in range(s.notices):
                name, form = named[int(rng.integers(len(named)))], forms[int(rng.integers(len(forms)))]
                if k % 2:
                    form = [np.concatenate([p[int(rng.integers(len(p)))] for p in parts]), ends[int(rng.integers(len(ends)))]]
                rows.append(self._row(around(form, name)))
                labels.append(f)
                if k % 2:
                    # A name among words of any kind, as in other languages, or in a sentence that is no notice.
                    alone = [rng.integers(0, 2**63, s.context).astype(np.uint64) for _ in range(2)]
                    rows.append(self._row(around(alone if k % 8 == 1 else mentions[int(rng.integers(len(mentions)))], name)))
                    labels.append(len(LABELS))
        for k in range(4 * len(others)):
            rows.append(self._row(np.concatenate((noise(6), others[k % len(others)], noise(6)))))
            labels.append(len(LABELS))
        for k in range(s.unknown_rows):
            n = int(rng.integers(2, 14))
            if k % 3:
                own = rng.choice(pool, n)
            else:
                w = words[int(rng.integers(len(words)))]
                at = int(rng.integers(len(w)))
                own = w[at : at + max(1, min(3, len(w) // 3))]
            rows.append(self._row(np.concatenate((own, noise(11)))))
            labels.append(len(LABELS))
        x, y = np.array(rows), np.array(labels)
        known, margin = np.zeros(len(y)), np.zeros(len(y))
        for k in range(2):
            out = np.arange(len(y)) % 2 == k
            weight = self._descend(x[~out], y[~out], s)
            logits = x[out] @ weight
            margin[out] = logits[:, :-1].max(axis=1) - logits[:, -1]
        known = (y < len(LABELS)).astype(np.int64)
        self.slope, self.offset = _sigmoid(margin, known)
        self.weight = self._descend(x, y, s)

    def _descend(self, x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
        """Full-batch gradient descent with momentum."""
        goal = np.eye(len(LABELS) + 1, dtype=np.float32)[y]
        w = np.zeros((x.shape[1], goal.shape[1]), np.float32)
        speed = np.zeros_like(w)
        for _ in range(s.steps):
            logits = x @ w
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 4.0 * (x.T @ (p - goal) / len(x) + s.penalty * w)
            w += speed
        return w

    def _hits(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that templates have, and which known pairs they are."""
        at = np.flatnonzero(self.maybe[(pairs & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.known_pairs, pairs[at]), len(self.known_pairs) - 1)
        hit = self.known_pairs[which] == pairs[at]
        return at[hit], which[hit]

    def notices(self, words: np.ndarray, pairs: np.ndarray, cased: np.ndarray | None = None) -> list[tuple[int, int, int | None]]:
        """Candidate word ranges in order, each with the template that its window holds; None for stretches of other template pairs.

        ``cased`` has the words' hashes with their case; without, names in capitals are taken as they come.
        """
        at, which = self._hits(pairs)
        stated = self._stated(words)
        if not len(at):
            return self._with_named(words, cased, stated)
        runs = self.owned[which + 1] - self.owned[which]
        hit = np.repeat(np.arange(len(at)), runs)
        first = np.cumsum(runs) - runs
        owner = self.owners[np.arange(len(hit)) - np.repeat(first - self.owned[which], runs)]
        distinct = np.bincount(np.unique(owner * len(self.known_pairs) + which[hit]) // len(self.known_pairs), minlength=len(self.total))
        hits: dict[int, np.ndarray] = {}
        free = np.ones(len(at), bool)
        taken = np.zeros(len(words) + 1, np.int64)
        for a, b, _ in stated:
            free[(at >= a) & (at < b)] &= int(words[a]) != self.marker

        def window(k: int, x: int) -> tuple[int, np.ndarray]:
            """How many of a template's pairs are free from a hit of it on, and the hits."""
            own = hits[k]
            own = own[x : np.searchsorted(at[own], at[own[x]] + self.span[k], "right")]
            own = own[free[own]]
            own = own[np.sort(np.unique(which[own], return_index=True)[1])]
            return len(own), own

        def rank(k: int, x: int, n: int, own: np.ndarray) -> tuple[bool, int, float, int, int, int]:
            return not self._stands(k, self.known_pairs[which[own]]), -n, -n / self.total[k], int(at[own[-1]] - at[own[0]]), k, x

        heap: list[tuple[bool, int, float, int, int, int]] = []
        for k in np.flatnonzero(distinct >= self.needed).tolist():
            hits[k] = hit[owner == k]
            for x in range(len(hits[k])):
                n, own = window(k, x)
                if n >= self.needed[k]:
                    heap.append(rank(k, x, n, own))
        heapq.heapify(heap)
        out: list[tuple[int, int, int | None]] = []
        while heap:
            _, was, *_, k, x = heapq.heappop(heap)
            if not free[hits[k][x]]:
                continue
            n, own = window(k, x)
            if n < self.needed[k]:
                continue
            if n < -was:
                heapq.heappush(heap, rank(k, x, n, own))
                continue
            free[own] = False
            a, b = int(at[own[0]]), int(at[own[-1]]) + 2
            taken[a] += 1
            taken[b] -= 1
            out.append((a, b, k))
        # A grant whose words are in a window is that window's.
        inside = np.cumsum(taken) > 0
        for a, b, k in stated:
            if int(words[a]) == self.marker or not inside[a:b].any():
                taken[a] += 1
                taken[b] -= 1
                out.append((a, b, k))
        inside = np.cumsum(taken) > 0
        left: list[tuple[int, int]] = []
        for i in at[free & ~inside[at]].tolist():
            if left and i <= left[-1][1] + _GAP and not inside[left[-1][1] - 1 : i].any():
                left[-1] = (left[-1][0], i + 2)
            else:
                left.append((i, i + 2))
        out += [(a, b, None) for a, b in left]
        return self._with_named(words, cased, [(max(0, a - 1), min(len(words), b + 1), k) for a, b, k in sorted(out, key=lambda r: r[:2])])

    def _with_named(self, words: np.ndarray, cased: np.ndarray | None, found: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
        """Candidates and, outside of those that hold a template or a statement, the words around names of licences; labels as NAMED + label."""
        out, end = [], 0
        for i in np.flatnonzero(self.opening[(words & np.uint64((1 << _BITS) - 1)).astype(np.int64)]).tolist():
            if i < end:
                continue
            for h, f in self.opens.get(int(words[i]), ()):
                if i + len(h) <= len(words) and (words[i : i + len(h)] == h).all():
                    if len(h) == 1 and cased is not None and self.capitals.get(int(h[0]), int(cased[i])) != int(cased[i]):
                        continue
                    end = i + len(h)
                    if not any(a <= i < b and (k is None or k >= 0 or -1 - k < len(FAMILIES)) and k is not None for a, b, k in found):
                        out.append((max(0, i - self.settings.context), min(len(words), end + self.settings.context), NAMED + f))
                    break
        if not out:
            return found
        # A grant that a name of a family says more of, and left-over pairs around a name, are that name's.
        found = [(a, b, k) for a, b, k in found if not ((k is None or k == -1 - len(FAMILIES)) and any(x < b and a < y for x, y, _ in out))]
        return sorted([*found, *out], key=lambda r: r[:2])

    def _stated(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """SPDX expressions, once for each identifier, and grants under licences of any name; labels as -1 - label."""
        out = []
        for m in np.flatnonzero(words == np.uint64(self.marker)).tolist():
            j = m + 1
            while j < len(words):
                out.append((m, j + 1, -1 - self.spdx.get(int(words[j]), len(FAMILIES))))
                if j + 2 >= len(words) or int(words[j + 1]) not in self.joints:
                    break
                # What follows "with" is an exception, no licence.
                j += 4 if int(words[j + 1]) == self.joints[2] and j + 4 < len(words) and int(words[j + 3]) in self.joints else 2
                if int(words[j - 1]) == self.joints[2]:
                    break
        end = 0
        for u in np.flatnonzero(words == self.under).tolist():
            if u and u > end and words[u - 1] in self.verbs:
                stop = np.flatnonzero(np.isin(words[u + 2 : u + 6 + _NAME], self.nouns))
                if len(stop):
                    end = u + 3 + int(stop[0])
                    out.append((u - 1, end, -1 - len(FAMILIES)))
        return out

    def paragraphs(self, words: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges around template pairs."""
        return [(a, b) for a, b, _ in self.notices(words, pairs)]

    def judge(self, words: np.ndarray, template: int | None = None) -> tuple[str, float, float] | None:
        """(family or "unknown", probability of a licence, part of the template) or None for no or an unconfirmed licence."""
        logits = self._row(words) @ self.weight
        margin = float(logits[:-1].max() - logits[-1])
        chance = float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))
        if template is not None and template < 0:
            # An SPDX identifier is a statement, whatever the classifier says of it; a grant is judged.
            stated = np.uint64(self.marker) in words
            return (LABELS[-1 - template], chance, 1.0) if stated or chance >= self.settings.least else None
        if chance < self.settings.least:
            return None
        if template is not None and template >= NAMED:
            return LABELS[template - NAMED], chance, 1.0
        own = np.unique(_words.windows(words, 2))
        which = np.searchsorted(self.known_pairs, own)
        which = which[self.known_pairs[np.minimum(which, len(self.known_pairs) - 1)] == own]
        found = self.inside[:, which].sum(axis=1)
        # Templates that are there confirm their families; the likeliest of these is the finding.
        there = np.flatnonzero(found >= self.needed) if template is None else np.array([template])
        if not len(there):
            return None
        stand = [k for k in there.tolist() if self._stands(k, own)]
        k = max(stand or there.tolist(), key=lambda k: (found[k], found[k] / self.total[k], logits[self.family[k]]))
        return FAMILIES[self.family[k]] if stand else UNKNOWN, chance, float(found[k] / self.total[k])


@functools.lru_cache(maxsize=4)
def trained(settings: Settings) -> LicenceModel:
    """The model of some settings; it depends on nothing else, so it is trained once."""
    return LicenceModel(settings)


def scan(df: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """Adds each row's licence findings, over its whole text.

    ``licences``: the families found, "unknown" for licences that aren't of
    FAMILIES, in order and joined by commas ("" if none); ``n_paragraphs``: candidate paragraphs; ``n_found``: confirmed ones;
    ``probability``: the highest of theirs (null if none). Null and empty
    texts have none, very long texts are scanned whole, and families that tie for a paragraph are told by
    the order of FAMILIES. Repeated rows get the same result; columns named as an
    added one are replaced; an empty table stays empty.
    """
    added = [("licences", T.StringType()), ("n_paragraphs", T.LongType()), ("n_found", T.LongType()), ("probability", T.DoubleType())]
    names = [n for n, _ in added]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(n, t) for n, t in added]])
    source = df.select(*kept) if text in kept else df.select(*kept, text)
    model = trained(settings or Settings())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            plain = _plain(b.column(text))
            for group, cased in zip(_words.words_of(plain), _words.words_of(plain, False), strict=True):
                pairs = _words.windows(group.hashes, 2)
                for x, y in zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True):
                    words = group.hashes[x:y]
                    spans = model.notices(words, pairs[x : max(x, y - 1)], cased.hashes[x:y])
                    found = [f for f in (model.judge(words[i:j], k) for i, j, k in spans) if f]
                    rows.append((",".join(sorted({f[0] for f in found})), len(spans), len(found), max((f[1] for f in found), default=None)))
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], names=[*kept, *names])

    return source.mapInArrow(lean(work), schema)
