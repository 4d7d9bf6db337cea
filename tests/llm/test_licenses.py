"""Licence notices that are wrapped, and notices without the usual cues."""

import random

from moraine.llm import licenses

HEADERS = {
    "gpl": "Notes\n\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "lgpl": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either",
    "agpl": "// This program is free software: you can redistribute it and/or modify it under the terms of the GNU\n// Affero General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above",
    "bsd": "dnl Redistribution and use in source and binary forms, with or without\ndnl modification, are permitted provided that the following conditions are met:",
}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: [(p["line"], p["family"]) for p in r["found"]] for r in licenses.scanned(docs).collect()}


def test_wrapped_headers(spark):
    words = [w for t in licenses.TEMPLATES["gpl"][1:2] for w in t.split()]
    narrow = ["\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n)) for n in (1, 3, 7)]
    apart = "Permission to use, copy, modify, and/or distribute this software for any\n\npurpose with or without fee is hereby granted"
    several = "Released under the MIT license\n" + HEADERS["isc"] + "\nReleased under the MIT license"
    got = found(spark, [*HEADERS.values(), *narrow, apart, several])
    assert [got[k] for k in range(5)] == [[(2 * (f == "gpl"), f)] for f in HEADERS]
    assert [got[k] for k in (5, 6, 7)] == [[(0, "gpl")]] * 3 and got[8] == []
    assert got[9] == [(0, "mit"), (1, "isc"), (3, "mit")]


def slow_runs(text, model):
    """All runs of lines of a paragraph, each scored whatever it holds."""
    w = [licenses.words(licenses.re.sub(licenses.MARK, "", line.lower())) for line in text.split("\n")]
    sure = []
    for i in range(len(w)):
        for j in range(i, len(w)):
            if not w[j] or sum(map(len, w[i + 1 : j])) > licenses.REACH:
                break
            joined = sum(w[i : j + 1], [])
            p = model.probabilities(" ".join(joined))
            best, mine = int(p.argmax()), set(licenses.pairs(joined))
            if best < len(licenses.FAMILIES) and p[best] >= licenses.LEAST:
                of = [licenses.pairs(licenses.words(t)) for t in licenses.TEMPLATES[licenses.FAMILIES[best]]]
                if any(len(mine & set(t)) >= licenses.SHARE * len(t) for t in of):
                    sure.append((-max(len(mine & set(t)) / len(t) for t in of), j - i, -float(p[best]), i, j, licenses.FAMILIES[best]))
    stand = []
    for run in sorted(sure):
        if all(run[4] < s[3] or run[3] > s[4] for s in stand):
            stand.append(run)
    return sorted((s[3], s[5], round(-s[2], 4)) for s in stand)


def test_runs_against_all_runs(spark):
    r, every = random.Random(3), [t for of in licenses.TEMPLATES.values() for t in of]
    texts = ["Released under the MIT.\n\nReleased under CC BY 4.0.", "Released under the ISC.", *HEADERS.values()]
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            words += r.choices(["la", "casa", "the", "of", "under", "software"], k=r.choice((0, 1, 5, 20)))
            words += [w for w in r.choice(every).split() if r.random() > r.choice((0, 0.1, 0.3))]
        ends = r.choice(((" ",) * 9 + ("\n",), (" ", " ", "\n", "\n\n"), (" ", "\n"), ("\n", "\ndnl ", "\n * ")))
        texts.append("".join(w + r.choice(ends) for w in words))
    model = licenses.default_model()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: [(p["line"], p["family"], round(p["probability"], 4)) for p in x["found"]] for x in licenses.scanned(docs).collect()}
    assert [p[:2] for p in got[0]] == [(0, "mit"), (2, "cc-by")] and [p[:2] for p in got[1]] == [(0, "isc")]
    assert got == {k: slow_runs(t, model) for k, t in enumerate(texts)}


PROBES = [
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY', "mit"), ("Code under the GPLv3", "gpl"), ("License: MIT", "mit"),
    ("This project is MIT licensed.", "mit"), ("Released under the GPL.", "gpl"), ("Released under CC BY 4.0.", "cc-by"), ("Released under the MIT.", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache"),
    ("You should have received a copy of the GNU Lesser General Public License along with this library.", "lgpl"), ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
]
ORDINARY = ["She lost her driving license.", "He works at MIT in Cambridge.", "All rights reserved.", "Licensed under terms to be agreed", "a b c d", "Permission to land was refused.", "The copyright office opened in 1870."]


def test_notices_that_are_no_templates(spark):
    got = found(spark, [*(t for t, _ in PROBES), *ORDINARY])
    assert [[f for _, f in got[k]] for k in range(len(got))] == [[f] for _, f in PROBES] + [[]] * len(ORDINARY)


def test_lone_line_of_a_header_is_taken_for_its_family():
    p = licenses.default_model().probabilities("it under the terms of the GNU General Public License as published by")
    assert licenses.FAMILIES[int(p.argmax())] == "gpl"


#: Notices as people write them, by no rule of the training grammar.
HELD_OUT = {
    "agpl": ["Everything here is AGPLv3 code, see COPYING.", "This server may be used under the GNU Affero General Public License, version 3."],
    "apache": ["The client library is open source under Apache 2.0.", "Use of this code is governed by the Apache License 2.0 found in the root."],
    "bsd": ["Use of this source code is governed by a BSD-style license: 3-clause BSD.", "Contributions are accepted under the BSD license only."],
    "cc-by": ["Photos: CC BY 4.0, please name the author.", "Text is available under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Data files are CC0, no attribution needed.", "To the extent possible the work is in the public domain under CC0 1.0."],
    "gpl": ["Kernel modules must be GPL licensed.", "It comes with no warranty and is distributed under GPL-3.0.", "Copying is allowed under the GNU General Public License version 3."],
    "isc": ["ISC license, copyright 2015 by the maintainers.", "This module is ISC licensed."], "lgpl": ["Link freely, the library is LGPL-2.1.", "The plugin is covered by the GNU Lesser General Public License."],
    "mit": ["MIT, do what you want. The MIT license applies to all files.", "Fonts and icons: MIT License (c) 2018"], "mpl": ["Files in this folder fall under MPL-2.0.", "Covered by the Mozilla Public License, v. 2.0."],
}


def test_confusion_on_notices_that_others_wrote():
    model, table = licenses.default_model(), {}
    for family, texts in HELD_OUT.items():
        for text in texts:
            p = model.probabilities(text)
            said = (licenses.FAMILIES + ["unknown"])[int(p.argmax())]
            table[family, said] = table.get((family, said), 0) + 1
    total, right = sum(table.values()), sum(n for (a, b), n in table.items() if a == b)
    assert right >= 0.85 * total and not [k for k in table if k[0] != k[1] and k[1] != "unknown" and table[k] > 1], table


def test_every_line_is_classified(spark):
    """The count of predicted lines against the classifier applied to each line by plain Python, whatever the line holds."""
    r = random.Random(5)
    vocabulary = sorted({w for of in licenses.TEMPLATES.values() for t in of for w in t.split()} | {"la", "casa", "ein", "haus"})
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.choice((0, 1, 2, 3, 9)))) for _ in range(r.randint(1, 8))) for _ in range(60)] + [t for t, _ in PROBES] + ["", None, "a\n\n dnl license mit"]
    model = licenses.default_model()

    def slow(text):
        n = 0
        for line in (text or "").split("\n"):
            w = licenses.words(licenses.re.sub(licenses.MARK, "", line.lower()))
            p = model.probabilities(" ".join(w))
            n += bool(w) and int(p.argmax()) < len(licenses.FAMILIES) and p.max() >= licenses.LEAST
        return n

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["n_predicted"] for x in licenses.scanned(docs).collect()}
    assert got == {k: slow(t) for k, t in enumerate(texts)} and sum(got.values()) > 40
