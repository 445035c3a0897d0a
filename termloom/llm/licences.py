"""Licence scan: a trained paragraph classifier confirmed by template comparison.

A text is cut into paragraphs at blank lines, and a paragraph into the pieces
that are scored: its lines, its sentences (which may run over line ends), and
overlapping windows of ``WINDOWS`` words, so that a notice wrapped over lines,
or one in the middle of a long sentence, is a piece of its own somewhere. A
multinomial logistic regression over sparse word uni- and bigrams gives every
piece a licence family or ``unknown``. It is trained here, in numpy, on variants
of the templates below (words dropped, names and years put in, ordinary words
around, halves), against an unknown class of ordinary and law-like sentences and
of salads of the templates' own words. A temperature fitted on held-out variants
calibrates the probabilities; below ``SURE`` a piece is unknown. A family counts
only when one of its templates confirms it: the piece holds ``AGREE`` of the
template's bigrams, or (from ``LEAST`` bigrams on) lies in it to that share.

Words outside the templates' vocabulary weigh nothing, so a model is a table of
bounded size. Paragraphs with fewer than two bigrams of the templates that are
more than two function words are not scored: no template can be confirmed there.

Of overlapping pieces of one family lines and sentences go before windows, the
surer before the less sure; following findings of one family that only blanks
part are one. A piece that two families claim goes to the likelier; windows find
the other in its own words.

Defined cases: null, empty and blank texts have no finding; several families in
a text, a paragraph or a line are all reported; a repeated notice is reported at
each place; equal probabilities go to the family listed first; every row has a
result of its own, whatever its id (null and repeated ids too); an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

SURE, AGREE, LEAST, VARIANTS, SEED = 0.6, 0.7, 8, 24, 11
WINDOWS = ((6, 2), (16, 6), (48, 16))
WORD = re.compile(r"[^\W_]+")
PARAGRAPH = re.compile(r"\S(?:[^\n]|\n(?![^\S\n]*\n))*")
SENTENCE_END = re.compile(r"[.!?;](?=\s)")
UNKNOWN = "unknown"
FUNCTION_WORDS = frozenset("a an and any are as at be by for from has have if in is it its may not of on or that the their this to under was which with you your".split())
# Wording of public licences, titles, notices and first conditions.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "MIT License", "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mit-0": ["MIT No Attribution", "Licensed under the MIT No Attribution license (MIT-0).", "SPDX-License-Identifier: MIT-0"],
    "apache-2.0": [
        "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-3-clause": [
        "BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsd-2-clause": [
        "BSD 2-Clause License", "Licensed under the BSD 2-Clause \"Simplified\" License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "isc": ["ISC License", "Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "zlib": [
        "zlib License", "Licensed under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "bsl-1.0": [
        "Boost Software License, Version 1.0", "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software,",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "gpl-3.0": [
        "GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl-2.0": [
        "GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "lgpl": [
        "GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library;",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl": [
        "GNU Affero General Public License", "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2.0": [
        "Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "cddl": [
        "Common Development and Distribution License", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "unlicense": [
        "The Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "cc0": [
        "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "wtfpl": ["Do What The F*ck You Want To Public License", "Licensed under the WTFPL.", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "SPDX-License-Identifier: WTFPL"],
    "artistic-2.0": ["The Artistic License 2.0", "Licensed under the Artistic License 2.0.", "You may copy and distribute verbatim copies of the Standard Version of this Package under the terms of the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"],
    "psf-2.0": ["Python Software Foundation License Version 2", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software in source or binary form and its associated documentation.", "SPDX-License-Identifier: PSF-2.0"],
    "ofl-1.1": ["SIL Open Font License Version 1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "postgresql": ["The PostgreSQL License", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", "SPDX-License-Identifier: PostgreSQL"],
    "eupl-1.2": ["European Union Public Licence v. 1.2", "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.", "SPDX-License-Identifier: EUPL-1.2"],
    "ms-pl": ["Microsoft Public License (Ms-PL)", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.", "SPDX-License-Identifier: MS-PL"],
    "public-domain": ["This work is in the public domain.", "The author places this work in the public domain.", "Dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2021 Example Inc. All rights reserved.", "This document is confidential and proprietary; no part may be reproduced without prior written permission.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# End of fixed values.
ORDINARY = [
    "The committee met on Tuesday to discuss the budget for the next year.", "He lost his driving license and had to take the test again in version two of the form.",
    "All rights and duties of the citizens are listed in the public register.", "Permission to enter the building is granted by the guard at the door.",
    "The software was easy to use and free of charge for students.", "She published a general history of the city in three parts.", "The table was reserved for four people at eight.",
    "A work of art can be seen in public from the street.", "The terms of the contract were changed under the new law.", "This is a common way to say that something is possible.",
    "It is in the house and on the way to the sea, with the others.", "The license plate of the car was found under the bridge.", "You may not like it, but the file is on the desk.",
    "Distribution of food was organised by the foundation in the morning.", "The source of the river lies in the north of the country.",
    "The tenant shall not sublet the premises without prior written consent of the landlord.", "Either party may terminate this agreement by written notice of thirty days.",
    "The seller gives no warranty of any kind, express or implied, as to the condition of the vehicle.", "The insurer shall not be liable for any damages arising from flood or fire.",
    "Students are permitted to use the library with or without a card, provided that they are quiet.", "The general public is free to visit the gardens, subject to the following rules.",
    "A copy of the report was distributed to all members and is included in the minutes.", "The foundation published a free version of the catalogue.",
    "In no event will the train leave before noon.", "Commercial use of the lake was restricted by the council in 1997.", "The creative director is common to both teams.",
    "He has an international driving permit and a fishing licence.", "The author of the book waived the fee.", "The eclipse was seen in public by thousands of people.",
    "The python was found in the zoo in the morning.", "She studied at MIT and later moved to Boston.", "Version 2.0 of the game is available at the store.",
    "The apache helicopter landed near the village.", "They boost the economy with public money.", "The name of the holder is printed on the card.",
    "Please read the following conditions and sign the form.", "The above notice shall be shown at the entrance of the hall.", "The following list is not complete.",
    "Any person who obtains a permit may sell fruit on the square.", "The rights to the film were sold to a studio.",
]


def words(line: str) -> list[str]:
    return WORD.findall(line.lower())


def bigrams(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:])) or {(x, "") for x in w}


class Model:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.families = [*TEMPLATES, UNKNOWN]
        known = [words(t) for ts in TEMPLATES.values() for t in ts]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({x for t in known for x in t}))}
        self.size = len(self.vocab) + 1
        pairs = {(a, b) for t in known for a, b in zip(t, t[1:])}
        keyed = sorted((self.vocab[a] * self.size + self.vocab[b], not (a in FUNCTION_WORDS and b in FUNCTION_WORDS)) for a, b in pairs)
        self.pairs = np.array([k for k, _ in keyed], np.int64)
        self.telling = np.array([t for _, t in keyed], bool)
        ordinary = [words(x) for x in ORDINARY]

        def around(w: list[str]) -> list[str]:
            """Ordinary words before and after."""
            one, two = (ordinary[rng.integers(len(ordinary))] for _ in range(2))
            return [*one[len(one) - rng.integers(0, 4) :], *w, *two[: rng.integers(0, 4)]]

        rows, y = [], []
        for k, family in enumerate(TEMPLATES):
            for t in TEMPLATES[family]:
                for v in range(VARIANTS):
                    w = words(t)
                    if v and len(w) > 5:
                        w = [x for x in w if rng.random() > 0.08]
                    if v % 4 == 3:
                        w = ["copyright", str(2000 + v % 25), "jane", "doe", *w]
                    if v % 4 == 1:
                        w = around(w)
                    if v % 4 == 2 and len(w) > 20:
                        at = int(rng.integers(0, len(w) // 2))
                        w = w[at : at + len(w) // 2]
                    rows.append(w)
                    y.append(k)
        all_words = sorted(self.vocab)
        for v in range(VARIANTS * 50):
            w = list(ordinary[v % len(ordinary)])
            if v % 3 == 1:  # salad of licence words within ordinary text
                w = [rng.choice(all_words) if rng.random() < 0.5 else x for x in w]
            elif v % 3 == 2:  # part of a sentence, as windows see it
                at = int(rng.integers(0, max(1, len(w) - 4)))
                w = w[at : at + 6]
            rows.append(w)
            y.append(len(TEMPLATES))
        x = np.zeros((len(rows), self.size + len(self.pairs)), np.float32)
        for i, w in enumerate(rows):
            ids = self.ids(w)
            np.add.at(x[i], ids[ids > 0], 1)
            at = self.pair(ids)
            np.add.at(x[i], self.size + at[at >= 0], 1)
            x[i] /= max(1, len(w)) ** 0.5
        target = np.eye(len(self.families), dtype=np.float32)[y]
        test = rng.random(len(y)) < 0.2
        w = np.zeros((x.shape[1], len(self.families)), np.float32)
        bias = np.zeros(len(self.families), np.float32)
        bias[-1] = 1.0
        train, own = x[~test], target[~test]
        share = 1 / np.maximum(own.sum(axis=0), 1)  # families count alike, unknown as much as all of them
        share[-1] *= len(TEMPLATES)
        row_weight = (own @ share)[:, None] / (own @ share).sum()
        for step in range(250):
            z = train @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - own) * row_weight
            rate = 30.0 / (1 + step / 100)
            w -= rate * (train.T @ g + 1e-5 * w)
            bias[:-1] -= rate * 0.02 * g.sum(axis=0)[:-1]
        self.uni, self.bi, self.bias = w[: self.size], w[self.size :], bias
        self.uni[0] = 0
        z, label = x[test] @ w + bias, np.array(y)[test]
        best = (np.inf, 1.0)
        for t in np.geomspace(0.3, 3, 20):
            q = z * t - (z * t).max(axis=1, keepdims=True)
            loss = -(q[np.arange(len(label)), label] - np.log(np.exp(q).sum(axis=1))).mean()
            best = min(best, (float(loss), float(t)))
        self.temperature = best[1]
        self.templates = {k: [bigrams(words(t)) for t in ts] for k, ts in TEMPLATES.items()}

    def ids(self, w: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def pair(self, ids: np.ndarray) -> np.ndarray:
        """Index of the known bigram that begins at each word but the last, -1 if none."""
        key = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.size + ids[1:], -1)
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, at, -1)

    def confirmed(self, w: list[str], family: str) -> float:
        own = bigrams(w)
        best = 0.0
        for t in self.templates[family]:
            shared = len(own & t)
            best = max(best, shared / len(t), shared / len(own) if len(own) >= LEAST else 0.0)
        return best

    def paragraph(self, text: str, begin: int) -> list[tuple[str, int, int, float]]:
        """Findings of one paragraph that begins at a place of the whole text."""
        found = list(WORD.finditer(text))
        w = [m.group().lower() for m in found]
        ids = self.ids(w)
        at = self.pair(ids) if len(ids) else ids
        if (self.telling[at[at >= 0]]).sum() < 2 and not (len(w) <= 3 and (at >= 0).any()):
            return []
        starts = np.array([m.start() for m in found])
        cuts = np.array([i for i, c in enumerate(text) if c == "\n"], np.int64)
        ends = np.array([m.end() for m in SENTENCE_END.finditer(text)], np.int64)
        pieces: dict[tuple[int, int], bool] = {}
        for places in (cuts, ends):
            edge = np.unique(np.concatenate([[0], np.searchsorted(starts, places), [len(w)]])).tolist()
            pieces.update({(s, e): True for s, e in zip(edge, edge[1:])})
        for size, step in WINDOWS:
            for s in range(0, max(1, len(w) - size + step), step):
                pieces.setdefault((s, min(len(w), s + size)), False)
        own = list(pieces)
        s, e = (np.array(c) for c in zip(*own))
        uni = np.concatenate([np.zeros((1, len(self.families)), np.float32), np.cumsum(self.uni[ids], axis=0, dtype=np.float64)])
        bi = np.concatenate([np.zeros((1, len(self.families)), np.float32), np.cumsum(np.where((at >= 0)[:, None], self.bi[at], 0), axis=0, dtype=np.float64)])
        z = uni[e] - uni[s] + bi[np.maximum(e - 1, s)] - bi[s]
        z = (z / np.maximum(1, e - s)[:, None] ** 0.5 + self.bias) * self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        family, sure = p.argmax(axis=1), p.max(axis=1)
        out: list[tuple[int, int, int, float]] = []
        some = np.flatnonzero((family < len(self.families) - 1) & (sure >= SURE))
        for i in sorted(some.tolist(), key=lambda i: (not pieces[own[i]], -sure[i], s[i])):
            taken = [o for o in out if o[0] == family[i] and o[1] < e[i] and s[i] < o[2]]
            if not taken and self.confirmed(w[s[i] : e[i]], self.families[family[i]]) >= AGREE:
                out.append((int(family[i]), int(s[i]), int(e[i]), float(sure[i])))

        def stop(last: int) -> int:
            """End of a piece: its last word and the marks that follow it."""
            to = found[last].end()
            while to < len(text) and not text[to].isspace() and not text[to].isalnum():
                to += 1
            return begin + to

        def start(first: int) -> int:
            at = found[first].start()
            while at > 0 and not text[at - 1].isspace() and not text[at - 1].isalnum():
                at -= 1
            return begin + at

        return [(self.families[f], start(a), stop(b - 1), q) for f, a, b, q in sorted(out, key=lambda o: (o[1], o[2], o[0]))]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Findings: family, start, end (code points), probability."""
        out: list[tuple[str, int, int, float]] = []
        for m in PARAGRAPH.finditer(text or ""):
            for one in self.paragraph(m.group(), m.start()):
                if out and out[-1][0] == one[0] and not text[out[-1][2] : one[1]].strip():  # type: ignore[index]
                    out[-1] = (one[0], out[-1][1], max(one[2], out[-1][2]), max(one[3], out[-1][3]))
                else:
                    out.append(one)
        return out


def licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, findings``: array of struct(family, start, end, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or Model())
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in sliced(batches):
            found = [[dict(zip(("family", "start", "end", "score"), f)) for f in shared.value.scan(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "findings"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, findings array<struct<family:string,start:long,end:long,score:double>>")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents"))
    each = F.transform("findings", lambda f: F.concat_ws(":", f["family"], f["start"].cast("string"), f["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["family"]))), ",").alias("families"),
        F.array_join(each, ",").alias("spans"),
    )


QUERIES = {"op8_licences": op8_licences}
ORACLES: dict[str, str] = {}
