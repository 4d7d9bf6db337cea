"""Licence scans: a trained paragraph classifier in DataFrame expressions.

A paragraph is a line, or a run of lines between blank ones (those without a word) without comment marks, so that a
notice may be wrapped at any width. Its distinct word 1- and 2-grams are hashed into buckets, and a sparse multinomial
logistic regression gives the probabilities of licence families and of an unknown class; a temperature fitted on
paragraphs that were not trained on calibrates them. Every line of every text is classified. A prediction is confirmed if
the paragraph also shares enough word pairs with one of the family's templates; of the confirmed runs that share
lines, the one that holds most of a template stands. Runs that hold enough of no template could not be confirmed whatever
the classifier says, so only lines are classified without that. Training takes labelled paragraphs, made from a grammar of
notices and from the templates, and runs once on the driver; scoring is one projection without a shuffle or Python.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence notices by family (fixed values).
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "you should have received a copy of the gnu affero general public license along with this program"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "released under the bsd license", "licensed under the bsd 3-clause license"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc0": ["released under cc0 1.0", "dedicated to the public domain under the creative commons zero license", "the person who associated a work with this deed has dedicated the work to the public domain"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "you should have received a copy of the gnu general public license along with this program", "released under the gpl license"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is and the author disclaims all warranties with regard to this software"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this library"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
}
#: Names by which a family is called (fixed values), and the short notices that are made of them.
NAMES = {
    "agpl": ["agpl", "agplv3", "agpl-3.0", "gnu agpl"], "apache": ["apache", "apache 2.0", "apache-2.0", "asl 2.0"], "bsd": ["bsd", "bsd-3-clause", "bsd-2-clause", "3-clause bsd"],
    "cc-by": ["cc by 4.0", "cc-by-4.0"], "cc-by-nc": ["cc by-nc 4.0", "cc-by-nc-4.0"], "cc-by-sa": ["cc by-sa 4.0", "cc-by-sa-4.0"], "cc0": ["cc0", "cc0-1.0", "cc0 1.0"],
    "gpl": ["gpl", "gplv2", "gplv3", "gpl-2.0", "gpl-3.0", "gnu gpl"], "isc": ["isc"], "lgpl": ["lgpl", "lgplv3", "lgpl-2.1", "gnu lgpl"], "mit": ["mit"], "mpl": ["mpl", "mpl-2.0", "mpl 2.0"],
}
FRAMES = ["license {}", "{} license", "{} licensed", "under the {}", "under {}", "spdx-license-identifier {}"]
#: What a paragraph is compared with to confirm a prediction.
TEMPLATES = {f: list(dict.fromkeys([*NOTICES[f], *(frame.format(name) for name in NAMES[f] for frame in FRAMES)])) for f in NOTICES}
FAMILIES = sorted(TEMPLATES)
#: Ordinary sentences with the words of licences (fixed values), for the unknown class.
OTHERS = [
    "she renewed her driving license in the morning", "the license plate was stolen from the car", "all rights reserved", "copyright law was discussed in the lecture", "you need permission to enter the building",
    "the warranty covers parts and labour for two years", "the software is free to try for thirty days", "a public library near the general hospital", "the terms of the contract are subject to change", "he works at mit in cambridge",
    "the apache helicopter flew over the valley", "the commission granted a fishing license to the village", "redistribution of wealth was the subject of the debate", "proprietary license do not distribute", "licensed under terms to be agreed",
]
#: Comment marks of letters; all others are no words.
MARK = r"^(?:\s*(?:dnl|rem)|c)(?=\s)"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BUCKETS = 1 << 15
#: Paragraphs made for each family, for training and for calibration; buckets of fewer of them have no weights.
MADE, HELD, LEAST_SEEN = 400, 80, 4
EPOCHS, RATE, RIDGE, SEED = 200, 0.5, 1e-3, 11
#: Least probability of a family, and least share of a template's word pairs that a paragraph must hold.
LEAST, SHARE = 0.5, 0.6
#: Words that are frequent in any English text; they only decide which pairs CUE is made of.
COMMON = frozenset("a all and any are as be by following for free in is it may must not of on only or that the this to under use version with you".split())

#: Words that the inner lines of a run hold at most: a notice as long as the longest template, and as many words put in.
REACH = 2 * max(len(re.findall(WORD, t)) for found in NOTICES.values() for t in found)


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def coded(text: str) -> list[int]:
    """The distinct buckets of a text's words and word pairs: Spark's pmod(xxhash64(word), BUCKETS) and pmod(xxhash64(first, second), BUCKETS)."""
    found = words(text)
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in found]
    # Spark hashes several columns by taking the hash of the one before as the seed of the next.
    hashes += [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(hashes, found[1:])]
    return sorted({(h - (1 << 64) if h >> 63 else h) % BUCKETS for h in hashes})


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # buckets x classes, the unknown class last; most buckets have none
    bias: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        z = self.weights[coded(text)].sum(0) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


#: Ways to say under what a work stands, and what may stand around that (fixed values); {} is a licence's name.
SAYINGS = [
    "released under the {} license", "licensed under the {}", "licensed under the terms of the {} license", "distributed under the {}", "distributed under the terms of the {} license", "this project is {} licensed",
    "license {}", "the license is {}", "code under the {}", "made available under {}", "published under a {} license", "see the {} license for details", "{} license", "this package is free software under {}",
    "you may use this work under the {}", "{} licensed", "spdx-license-identifier {}", "this is subject to the terms of the {}", "it is covered by the {} license", "dual licensed under {}", "provided under {}",
]
AROUND = ["copyright 2019 the authors", "all rights reserved", "this file", "see license.txt", "the source code is", "the documentation is", "unless stated otherwise", "version 3 or later", "or any later version", "as published by the free software foundation", "with exceptions", "2021"]


def labelled_paragraphs(n: int, seed: int) -> list[tuple[str, int]]:
    """Notices of each family by a grammar of sayings and names, and sentences of notices with words dropped and parts cut off, with words around them.

    The unknown class gets ordinary sentences, and words of licences that name no licence.
    """
    r = random.Random(seed)
    stray = lambda k: ["".join(r.choice("etaoinshrdluüéñ") for _ in range(r.randint(1, 9))) for _ in range(k)]
    around = lambda: words(r.choice(AROUND)) if r.random() < 0.25 else stray(r.choice((0, 0, 1, 4, 12)))
    out = []
    for label, family in enumerate(FAMILIES):
        for k in range(n):
            if k % 3 == 0:
                w = words(NOTICES[family][k // 3 % len(NOTICES[family])])
                if r.random() < 0.5:
                    w = [x for x in w if r.random() > 0.06] or w
                if len(w) > 12 and r.random() < 0.3:
                    w = w[: len(w) * 3 // 4] if r.random() < 0.5 else w[len(w) // 4 :]
            else:
                w = words(r.choice(SAYINGS).format(r.choice(NAMES[family])))
            out.append((" ".join(around() + w + around()), label))
    said = [w for saying in SAYINGS for w in [words(saying.format(""))]]
    for k in range(4 * n):
        kind = k % 4
        w = words(r.choice(OTHERS)) if kind == 0 else [] if kind == 1 else r.sample(words(NOTICES[r.choice(FAMILIES)][0]), 2) if kind == 2 else r.choice(said)
        out.append((" ".join(around() + w + stray(r.randint(1, 12))), len(FAMILIES)))
    return out


@functools.cache
def default_model() -> Model:
    """Full-batch AdaGrad on made paragraphs, then the temperature with the least log loss on others."""
    made = labelled_paragraphs(MADE, SEED)
    codes = [coded(text) for text, _ in made]
    seen = np.bincount([b for row in codes for b in row], minlength=BUCKETS)
    column = {b: k for k, b in enumerate(np.flatnonzero(seen >= LEAST_SEEN).tolist())}
    # The matrix of paragraphs and buckets, as places by row and as places by column.
    rows = [[column[b] for b in row if b in column] for row in codes]
    flat, row = np.array([k for r in rows for k in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    by_column = np.argsort(flat, kind="stable")
    starts, of_column = np.searchsorted(flat[by_column], np.arange(len(column))), row[by_column]
    filled = np.flatnonzero([len(r) for r in rows])
    row_starts = np.searchsorted(row, filled)
    y, classes = np.array([label for _, label in made]), len(FAMILIES) + 1
    w, b = np.zeros((len(column), classes), np.float32), np.zeros(classes, np.float32)
    seen_w, seen_b = np.full(w.shape, 1e-6, np.float32), np.full(b.shape, 1e-6, np.float32)
    for _ in range(EPOCHS):
        z = np.tile(b, (len(y), 1))
        z[filled] += np.add.reduceat(w[flat], row_starts)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g, h = np.add.reduceat(p[of_column], starts) / len(y) + RIDGE * w / 10, p.mean(0)
        seen_w += g**2
        seen_b += h**2
        w -= RATE * g / np.sqrt(seen_w) * 0.1
        b -= RATE * h / np.sqrt(seen_b) * 0.1
    held = labelled_paragraphs(HELD, SEED + 1)
    y = np.array([label for _, label in held])
    z = np.array([w[[column[b] for b in coded(text) if b in column]].sum(0) + b for text, _ in held])

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean())

    t = min((0.25, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    weights = np.zeros((BUCKETS, w.shape[1]))
    weights[list(column)] = np.round(w.astype(float) / t, 6)
    return Model(weights, np.round(b.astype(float) / t, 6))


def pairs(found: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def _needed() -> set[str]:
    """Word pairs without one of which no text holds SHARE of any template.

    A text that holds SHARE of a template's pairs lacks the others at most, so it holds one of any set that is larger by one.
    The sets are made of pairs that serve other templates or hold no common word, so that few texts match.
    """
    chosen: set[str] = set()
    for of in sorted((pairs(words(t)) for found in TEMPLATES.values() for t in found), key=len):
        lacks = len(of) - math.ceil(SHARE * len(of))
        rank = sorted(of, key=lambda p: (p not in chosen, sum(w in COMMON for w in p.split()), p))
        chosen.update(rank[: lacks + 1])
    return chosen


def _cue() -> str:
    """A pattern for one of these pairs."""
    follows: dict[str, list[str]] = {}
    for first, second in map(str.split, sorted(_needed())):
        follows.setdefault(first, []).append(re.escape(second))
    starts = "".join(sorted({first[0] for first in follows}))
    branches = "|".join(rf"{re.escape(first)}[^a-z0-9]++(?:(?:dnl|rem|c)[^a-z0-9]++)?(?:{'|'.join(seconds)})" for first, seconds in follows.items())
    return rf"(?i)(?<![a-z0-9])(?=[{starts}])(?:{branches})(?![a-z0-9])"


#: A text without this would be confirmed by no template, so it is not scored.
CUE = _cue()


def _array(values: list, kind: str) -> Column:
    """A constant, parsed once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(lines: Column) -> Column:
    """Arrays, by first line, of (line, last, w): runs of lines of one paragraph near a cue, with their words.

    A run's inner lines hold REACH words at most. A cue may run over to the next line.
    """
    hits = F.transform(lines, lambda line, k: F.lower(F.concat_ws(" ", line, F.get(lines, k + 1))).rlike(CUE))
    worded = F.transform(lines, _words)

    def last(counts: Column, k: Column) -> Column:
        """The last line of the longest run from line k."""
        start = F.struct(k.alias("at"), F.lit(0).alias("inner"), F.lit(True).alias("open"))
        step = lambda s, n: F.when(
            s["open"] & (n > 0), F.struct((s["at"] + 1).alias("at"), (s["inner"] + n).alias("inner"), (s["inner"] + n <= REACH).alias("open"))
        ).otherwise(F.struct(s["at"].alias("at"), s["inner"].alias("inner"), F.lit(False).alias("open")))
        return F.aggregate(F.slice(counts, k + 2, F.lit(REACH + 1)), start, step)["at"]

    def runs(hit: Column, w: Column) -> Column:
        near = lambda i, j: F.exists(F.slice(hit, i + 1, j - i + 1), lambda h: h)
        starts = F.filter(F.transform(w, lambda x, k: F.when(F.size(x) > 0, k)), lambda k: k.isNotNull() & near(k, k + REACH + 1))
        words = lambda i, j: F.flatten(F.slice(w, i + 1, j - i + 1))
        ends = lambda counts: F.transform(starts, lambda i: F.transform(F.sequence(i, last(counts, i)), lambda j: F.struct(i.alias("line"), j.alias("last"))))
        found = _let(F.transform(w, F.size), ends)
        return F.transform(found, lambda group: F.transform(
            F.filter(group, lambda p: near(p["line"], p["last"])), lambda p: F.struct(p["line"].alias("line"), p["last"].alias("last"), words(p["line"], p["last"]).alias("w")),
        ))

    return _let(hits, lambda hit: _let(worded, lambda w: runs(hit, w)))


def _picked(groups: Column) -> Column:
    """The runs that stand, in order: the one with the highest share, then of the fewest lines, most probable, first; then the next that shares no line with one that stands."""
    inside = lambda p, q: (q["line"] >= p["line"]) & (q["last"] <= p["last"]) & (q["last"] - q["line"] < p["last"] - p["line"])
    meets = lambda p, q: (q["line"] <= p["last"]) & (q["last"] >= p["line"])
    # A run with a shorter one inside that shares as much never stands; that one begins in the next REACH + 1 lines at most.
    least = lambda found: F.transform(found, lambda group, g: F.filter(
        group, lambda p: ~F.exists(F.slice(found, g + 1, F.lit(REACH + 2)), lambda other: F.exists(other, lambda q: inside(p, q) & (q["share"] >= p["share"]))),
    ))

    def stand(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda p: F.struct((-p["share"]).alias("a"), (p["last"] - p["line"]).alias("b"), (-p["probability"]).alias("c"), p["line"].alias("d"), p.alias("p"))))
        empty = F.filter(found, lambda p: F.lit(False))
        return F.aggregate(ranked, empty, lambda s, r: F.when(F.exists(s, lambda q: meets(r["p"], q)), s).otherwise(F.concat(s, F.array(r["p"]))))

    def chosen(found: Column) -> Column:
        """Runs that meet no other stand; only the others are compared, as that takes the square of their number."""
        around = lambda g: F.flatten(F.slice(found, F.greatest(g - REACH - 1, F.lit(0)) + 1, F.lit(2 * REACH + 3)))
        marked = F.flatten(F.transform(found, lambda group, g: F.transform(group, lambda p: F.struct(p.alias("p"), (F.size(F.filter(around(g), lambda q: meets(p, q))) > 1).alias("met")))))
        part = lambda rows, met: F.transform(F.filter(rows, lambda r: r["met"] == F.lit(met)), lambda r: r["p"])
        return F.array_sort(_let(marked, lambda rows: F.concat(part(rows, False), _let(part(rows, True), stand))))

    solid = lambda found: F.filter(found, lambda group: F.size(group) > 0)
    return _let(_let(solid(groups), least), lambda found: chosen(found))


def _classifier(model: Model):
    """A function from the words of a paragraph to (k, probability) of its most probable class; of equal ones the first."""
    known = np.flatnonzero(model.weights.any(1))
    slots = np.full(len(model.weights), -1)
    slots[known] = np.arange(len(known))
    slot, weights, bias = _array(slots.tolist(), "array<int>"), _array(model.weights[known].tolist(), "array<array<double>>"), _array(model.bias.tolist(), "array<double>")


    def classify(w: Column, two: Column | None = None) -> Column:
        hashed = F.concat(F.transform(w, lambda a: F.xxhash64(a)), _hashed_pairs(w) if two is None else two)
        held = F.array_distinct(F.filter(F.transform(hashed, lambda h: F.get(slot, _bucket(h))), lambda k: k >= 0))
        sums = F.aggregate(held, bias, lambda s, k: F.zip_with(s, F.get(weights, k), lambda a, b: a + b))
        return _let(sums, lambda z: F.struct(
            (F.array_position(z, F.array_max(z)) - 1).cast("int").alias("k"), (1 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(z)))).alias("probability"),
        ))

    return classify


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _hashed_pairs(w: Column) -> Column:
    return F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, k: F.xxhash64(F.get(w, k), b))


def _pairs(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, k: F.concat_ws(" ", F.get(w, k), b)))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(line), MARK, ""), F.lit(WORD), F.lit(0))


def lines_of(text: Column, model: Model) -> Column:
    """(predicted, cued) of a text: how many lines the classifier takes for notices of a family, confirmed or not, and whether any
    two words that follow one another, in a line or over a line's end, may be a pair that confirmation needs.

    Every line with a word is classified. Pairs are told by three parts of their hash, so cued may once in a great while be true
    without such a pair; it is never false with one.
    """
    classify, width = _classifier(model), BUCKETS.bit_length() - 1
    hashes = [xxhash.xxh64_intdigest(second.encode(), xxhash.xxh64_intdigest(first.encode(), 42)) for first, second in map(str.split, _needed())]
    tables = [_array(np.isin(np.arange(BUCKETS), [h >> width * k & (BUCKETS - 1) for h in hashes]).tolist(), "array<boolean>") for k in range(3)]
    needed = lambda h: functools.reduce(Column.__and__, [F.get(t, _bucket(F.shiftrightunsigned(h, width * k) if k else h)) for k, t in enumerate(tables)])
    solid = F.filter(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), _words), lambda w: F.size(w) > 0)

    def judged(lines: Column) -> Column:
        each = F.transform(lines, lambda w: _let(_hashed_pairs(w), lambda two: F.struct(classify(w, two).alias("c"), F.exists(two, needed).alias("cued"))))
        over = F.exists(F.transform(lines, lambda w, k: F.xxhash64(F.element_at(w, -1), F.get(F.get(lines, k + 1), F.lit(0)))), needed)
        return _let(each, lambda found: F.struct(
            F.size(F.filter(found, lambda x: (x["c"]["k"] < len(FAMILIES)) & (x["c"]["probability"] >= LEAST))).alias("predicted"), (F.exists(found, lambda x: x["cued"]) | over).alias("cued"),
        ))

    return _let(solid, judged)


def paragraphs(text: Column, cued: Column, model: Model) -> Column:
    """Array of (line, family, probability) of the confirmed licence notices of a text; empty where it is not cued."""
    templates = _array([[pairs(words(t)) for t in TEMPLATES[f]] for f in FAMILIES], "array<array<array<string>>>")
    families, classify = F.array(*map(F.lit, FAMILIES)), _classifier(model)
    keep = lambda p, *more: F.struct(p["line"].alias("line"), p["last"].alias("last"), *more)
    share = lambda p, t: F.size(F.array_intersect(p["pairs"], t)) / F.size(t)
    holds = lambda p, t: F.size(F.array_intersect(p["pairs"], t)) >= SHARE * F.size(t)

    def confirmed(group: Column) -> Column:
        paired = F.transform(group, lambda p: keep(p, p["w"].alias("w"), _pairs(p["w"]).alias("pairs")))
        # What holds enough of no template would be dropped in the end; it is not scored.
        likely = F.filter(paired, lambda p: F.exists(templates, lambda family: F.exists(family, lambda t: holds(p, t))))
        best = F.transform(likely, lambda p: _let(classify(p["w"]), lambda c: keep(p, p["pairs"].alias("pairs"), c["k"].alias("k"), c["probability"].alias("probability"))))
        known = F.filter(best, lambda p: (p["k"] < len(FAMILIES)) & (p["probability"] >= LEAST))
        sure = F.filter(known, lambda p: F.exists(F.get(templates, p["k"]), lambda t: holds(p, t)))
        return F.transform(sure, lambda p: keep(p, p["k"].alias("k"), p["probability"].alias("probability"), F.array_max(F.transform(F.get(templates, p["k"]), lambda t: share(p, t))).alias("share")))

    whole = F.coalesce(text.cast("string"), F.lit(""))
    found = _let(F.split(whole, "\n", -1), lambda lines: _picked(F.transform(_windows(lines), confirmed)))
    named = F.transform(found, lambda p: F.struct(p["line"].alias("line"), F.get(families, p["k"]).alias("family"), p["probability"].alias("probability")))
    return F.when(cued, named).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("family"), F.lit(0.0).alias("probability"))), lambda p: F.lit(False)))


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, families (in order), n_paragraphs, probability (the highest), n_predicted, found (first line, family, probability) for each document.

    n_predicted: lines that the classifier takes for notices, confirmed or not; the others are of confirmed paragraphs. A
    document without one has no families and a null probability; so have null and empty texts. Texts of any length
    are read whole. Ties between classes go to the first in alphabetical order. Null ids and repeated rows keep
    their rows; other columns are ignored; an empty table gives an empty table.
    """
    model = model or default_model()
    judged = docs.select("doc_id", F.col("text").alias("text"), lines_of(F.col("text"), model).alias("lines"))
    found = judged.select("doc_id", paragraphs(F.col("text"), F.col("lines.cued"), model).alias("found"), F.col("lines.predicted").cast("bigint").alias("n_predicted"))
    return found.select("doc_id", F.array_sort(F.array_distinct(F.col("found.family"))).alias("families"), F.size("found").cast("bigint").alias("n_paragraphs"), F.array_max(F.col("found.probability")).alias("probability"), "n_predicted", "found")
