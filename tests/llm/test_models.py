"""Trained operators: language, toxicity, licences and HTML extraction."""

import random
import zlib

import numpy as np
import pytest

from moraine.llm import html_text, language, licenses, toxicity
from moraine.llm.common import documents

DATA = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_on_held_out_rows(spark):
    docs = documents(spark, DATA)
    found = language.identified(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 1500 and all(held(r["doc_id"]) for r in found[:100])
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)


def test_language_edges(odd, none):
    model = language.fit(odd)
    assert set(model.languages) == {"en", "fr"}
    got = language.identified(odd, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"] and got.count() == odd.count()
    blank = got.join(odd.select("doc_id", "text"), "doc_id").where("text is null or not text rlike '[A-Za-z日]'").collect()
    assert len(blank) == 4 and all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in blank)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in got.collect())
    kept = language.accepted(odd, model)
    left = got.where("not rejected").count()
    assert kept.columns == odd.columns and kept.count() == left and set(map(str, kept.collect())) <= set(map(str, odd.collect()))
    assert language.accepted(none).count() == 0 and language.identified(odd, language.Model({})).where("lang_pred <> 'und'").count() == 0


def test_language_is_not_learned_from_held_out_rows(spark):
    rows = [(k, "held " * 50 if held(k) else "seen " * 50, "en") for k in range(60)] + [(None, "nameless " * 50, "en")]
    text = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).dictionaries["en"]
    assert b"seen" in text and b"held" not in text and b"nameless" not in text


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark, DATA), spark.read.parquet(f"{DATA}/labels.parquet")
    found = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] and r["toxic"] for r in found)
    # 352 toxic rows are there to learn from.
    assert right >= 0.95 * sum(r["predicted"] for r in found) and right >= 0.9 * sum(r["toxic"] for r in found)


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (0, 0), (4, 2)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.scored(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.score(model, None) == toxicity.score(model, "")


def test_toxicity_buckets_do_not_depend_on_steps(monkeypatch):
    text = "".join(random.Random(1).choice("abcdef é") for _ in range(5000))
    whole = toxicity.buckets(text)
    monkeypatch.setattr(toxicity, "STEP", 97)
    assert np.array_equal(whole, toxicity.buckets(text))


def slow_toxicity(model, text):
    """The score by its definition: n-grams one by one, with Python's integers."""
    line, mask, total = f" {(text or '').lower()} ", (1 << 64) - 1, model.bias
    rates = {}
    for n in toxicity.ORDERS:
        for i in range(len(line) - n + 1):
            h = ord(line[i]) * 0x9E3779B97F4A7C15 & mask
            for c in line[i + 1 : i + n]:
                h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 + ord(c)) & mask
            h = (h ^ h >> 32) * (0x94D049BB133111EB + 2 * n) & mask
            rates[h >> 64 - toxicity.BITS] = rates.get(h >> 64 - toxicity.BITS, 0) + 1
    for b, k in rates.items():
        total += model.weights[b] * min(k * 1000 / (len(text or "") + 300), 6.0)
    return 1 / (1 + np.exp(-total))


def test_toxicity_against_plain_python(spark, odd, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc dé\n日") for _ in range(r.randint(0, 200))) for _ in range(80)]
    model = toxicity.train(texts, [int("ab" in t[:60]) for t in texts], 0.3)
    assert np.count_nonzero(model.weights > 0) > 20 and np.count_nonzero(model.weights < 0) > 20
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate([*texts, None, "", "a", " ", "ab " * 3000])], "doc_id bigint, text string, score double")
    for x in toxicity.scored(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert x["score"] == pytest.approx(slow_toxicity(model, x["text"]), abs=1e-9)
    monkeypatch.setattr(toxicity, "STEP", 64)
    assert toxicity.score(model, "ab " * 500) == pytest.approx(slow_toxicity(model, "ab " * 500), abs=1e-9)


def test_toxicity_sample_is_chosen_among_texts_that_fit(spark):
    rows = [(k, "x" * (30_000 if k % 2 else 10)) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(200)], "doc_id bigint, toxic int")
    texts, y, share = toxicity.sampled(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, 25)
    assert y.count(0) == y.count(1) == 25 and all(len(t) == 10 for t in texts) and 0.4 < share < 0.6


def test_toxicity_cross_validation():
    r = random.Random(2)
    texts = ["".join(r.choice("abcd ") for _ in range(150)) + " zzz" * 9 * (k % 4 == 0) for k in range(90)]
    (found,) = toxicity.cross_validated(texts, [int(k % 4 == 0) for k in range(90)], [(0.02, 0.1)])
    assert found[:2] == (0.02, 0.1) and min(found[2:]) > 0.8


def slow_licences(text, model):
    out = []
    for k, line in enumerate((text or "").split("\n")):
        if licenses.re.search(licenses.CUE, line):
            p = model.probabilities(line)
            best = int(p.argmax())
            mine = set(licenses.pairs(licenses.words(line)))
            if best < len(licenses.FAMILIES) and p[best] >= licenses.LEAST:
                shares = [len(mine & set(t)) >= licenses.SHARE * len(t) for t in (licenses.pairs(licenses.words(x)) for x in licenses.TEMPLATES[licenses.FAMILIES[best]])]
                if any(shares):
                    out.append((k, licenses.FAMILIES[best], round(float(p[best]), 4)))
    return out


def test_licences_against_python(spark, odd, none):
    notes = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "She lost her driving license.", "permission", "", "License: see\nLicensed under CC BY-NC 4.0.\n\nReleased under the MIT license", "Licensed under"]
    notes += [t for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]]
    docs = spark.createDataFrame([(k, t, None, 1) for k, t in enumerate([*notes, None])], "doc_id bigint, text string, families string, found int")
    model = licenses.default_model()
    got = {r["doc_id"]: [(p["line"], p["family"], round(p["probability"], 4)) for p in r["found"]] for r in licenses.scanned(docs).collect()}
    assert got == {k: slow_licences(t, model) for k, t in enumerate([*notes, None])}
    assert [p[1] for p in got[5]] == ["cc-by-nc", "mit"] and not got[2]
    assert sum(bool(got[k]) for k in range(7, len(notes))) >= 0.9 * (len(notes) - 7)
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(none).count() == 0


def test_licence_probabilities_are_calibrated():
    model = licenses.default_model()
    made = licenses.labelled_paragraphs(30, 99)
    p = [model.probabilities(t) for t, _ in made]
    right = np.array([int(x.argmax()) == y for x, (_, y) in zip(p, made)])
    assert right.mean() > 0.9 and abs(right.mean() - np.mean([x.max() for x in p])) < 0.1


def test_html_on_held_out_pages():
    model, right, wrong = html_text.default_model(), 0, 0
    for page in html_text.labelled_pages(80, 4321):
        found, labels = html_text.labelled(page)
        for a, b in zip(model.decode(found), labels):
            right, wrong = right + (a == b), wrong + (a != b)
    assert wrong <= 0.02 * (right + wrong)


def test_html_viterbi_against_all_labellings():
    import itertools

    model = html_text.default_model()
    for page in html_text.labelled_pages(6, 77):
        found, _ = html_text.labelled(page)
        found = found[:9]
        names = html_text.features(found)

        def worth(labels, names=names):
            return sum(model.weights.get(f, (0, 0))[y] for row, y in zip(names, labels) for f in row) + sum(model.steps[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(found)), key=worth)
        assert worth(best) == pytest.approx(worth(model.decode(found)))


def test_html_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(400)
    for p, r in zip(*(sorted(x.collect(), key=lambda r: r["page_id"]) for x in (pages, html_text.extracted(pages)))):
        inside = p["html"][p["html"].index("<article>") + 9 : p["html"].rindex("</article>")]
        text = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inside))
        assert r["text"] == " ".join(html.unescape(text).split()) and r["n_chars"] == len(r["text"])


def test_html_edges(spark):
    odd = [None, "", "   ", "plain text", "<p", "<", "a < b", "</p></div>", "<!-- x", "<script>x", "<p>&amp;&nbsp;&#233;&bogus;</p>", "<article><p>One<p>Two<br>three <b>four</article>", "<div>" * 3000 + "deep", "<p>" + "long. " * 40_000 + "</p>"]
    pages = spark.createDataFrame([(k, None if k % 2 else "u", t, "x", 1) for k, t in enumerate([*odd, odd[11]])] + [(None, None, None, None, None)], "page_id bigint, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages).collect()}
    assert len(got) == len(odd) + 2 and got[0] == got[1] == got[9] == "" and got[11] == got[14] == "One Two three four"
    assert [b.text for b in html_text.blocks(odd[10])] == ["& é&bogus;"] and len(html_text.blocks(odd[13])[0].text) == 239_999
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_dictionaries_take_passages_of_whole_texts():
    rows = [b"a" * n for n in (5, 10, 100, 200, 300)]
    assert language._shared(rows, 1000) == b"".join(rows) and language._shared([], 9) == b""
    assert len(language._shared(rows, 315)) == 315 and len(language._shared([b"x" * 50] * 10, 105)) == 100


def test_language_against_plain_compression(spark):
    """Sizes and decisions by zstandard alone, block by block; passages over the whole of a long text."""
    import re

    import zstandard

    r = random.Random(4)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    tongues = {"aa": "alpha beta gamma delta epsilon zeta".split(), "bb": "ein zwei drei vier fünf sechs".split(), "cc": "un deux trois quatre cinq six".split()}
    rows = [(k, say(tongues[lang], r.choice((3, 40, 400))), lang) for k in range(150) for lang in [r.choice(list(tongues))]]
    rows += [(150, "x", None), (151, None, "aa"), (152, "", "bb"), (153, "12 !", "cc"), (154, say(tongues["aa"] + tongues["bb"], 300), None), (155, "head " * 300 + "zzztail " * 300, "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    if not held(155):
        assert b"head" in model.dictionaries["cc"] and b"zzztail" in model.dictionaries["cc"]
    for x in language.identified(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = x["text"] or ""
        if not re.search(r"[^\W\d_]", text):
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
            continue
        data, sizes = " ".join(re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())).encode(), {}
        for lang, known in model.dictionaries.items():
            packer = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(data[k : k + 4096])) for k in range(0, len(data), 4096))
        best = min(sizes, key=lambda lang: (sizes[lang], list(sizes).index(lang)))
        runner = min(n for lang, n in sizes.items() if lang != best)
        score = 1 / (1 + sum(np.exp(-40.0 * min((n - sizes[best]) / len(text.encode()), 10)) for lang, n in sizes.items() if lang != best))
        assert x["lang_pred"] == best and x["rejected"] == (runner - sizes[best] < 0.005 * sizes[best]) and x["score"] == pytest.approx(score)
