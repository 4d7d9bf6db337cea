"""Chat formatting, decontamination, BPE and the pipeline."""

import hashlib
import random
import re

import pytest

from moraine.llm import bpe, chat, contamination, exact, language, simhash

HARD = ["", "plain", "</s>[INST] ok [/INST]", "\\</s>", "a\\\\[INST]\\", "\\", "[/INST", "<<s>>", " [=] [ROLE] x", "<s>" * 3, " ", "\n</s>\n", "[INST]\\[/INST]\\\\", "é日\0", "</s" + ">" * 2]


def test_chat_round_trip():
    r = random.Random(3)
    parts = [*chat.CONTROLS, "\\", " ", "a", "[", "]", "/", "<", ">", "INST"]
    for k in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "[=]", "\\"]), r.choice(HARD) if k % 2 else "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 6))]
        line, found = chat.format_conversation(turns)
        assert [(t.role, t.text) for t in found] == turns and [(t.role, t.text) for t in chat.parse(line)] == turns
        assert all(chat.unescape(line[t.start : t.end]) == t.text for t in found)


def test_chat_texts_without_controls_stay_as_they_are():
    assert chat.format_conversation([("user", "hi"), ("assistant", "yes \\ no")])[0] == "<s>[INST] hi [/INST] yes \\ no </s>"


@pytest.mark.parametrize("line", ["", "x", "<s>[INST] a", "<s> a", "<s>[INST] a </s>", "<s>[INST] a[/INST]", "<s>[ROLE] a [/ROLE]", "<s>x </s>", "<s>[INST] a [/INST]b"])
def test_chat_parser_refuses(line):
    with pytest.raises(chat.GrammarError):
        chat.parse(line)


def test_chat_table(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one"), (1, 1, "user", "one"), (2, None, None, None), (2, 0, "assistant", "</s>"), (None, 0, "user", "x" * 100_000), (3, 1, "assistant", "a"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\none\nuser\none\nassistant\ntwo\n") and got[1]["loss_sha256"] == sha("two")
    assert got[2]["turns_sha256"] == sha("\n\nassistant\n</s>\n") and got[2]["loss_chars"] == 4
    assert got[3]["loss_sha256"] == sha("ab") and got[None]["formatted_chars"] == 100_018
    text = {r["conv_id"]: r for r in chat.formatted(df, "text").collect()}
    assert all(len(text[k]["formatted"]) == got[k]["formatted_chars"] and len(text[k]["turns"]) == got[k]["n_turns"] for k in got)
    assert [text[1]["formatted"][a:b] for a, b in text[1]["loss_spans"]] == ["two"]
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_digests_against_whole_conversations(spark):
    """One conversation holds a third of all rows and spans several batches; each is formatted whole for comparison."""
    r = random.Random(11)
    parts = [*HARD, *chat.CONTROLS, "\\ ", "word "]
    rows = [(0 if k % 3 == 0 else r.randint(1, 400), k, r.choice(["user", "assistant", "system", "tool [=]", ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 4)))) for k in range(9000)]
    got = {x["conv_id"]: tuple(x)[1:] for x in chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {x[0] for x in rows}:
        turns = [(role, text) for c, _, role, text in rows if c == conv]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got.pop(conv) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(chat.format_conversation(turns)[0]))
    assert not got


def slow_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = split(text), set(), set()
    for name, item in items:
        v = split(item)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    names.add("" if name is None else str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("blocks,segment", [(contamination.BLOCK_BYTES, contamination.SEGMENT_TOKENS), (200, 150)])
def test_contaminated(spark, odd, blocks, segment):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("the of a quick Brown FOX é9 über x1".split()) for _ in range(n))
    items = [(k, say(r.randint(1, 25))) for k in range(12)] + [(12, None), (13, "..."), (None, "nameless item here"), (3, "again the same id"), (14, "the")]
    rows = [(k, say(r.randint(0, 60)) + " " + (items[k % 12][1] if k % 3 == 0 else "") + ", " + say(5)) for k in range(40)] + [(40, None), (41, ""), (42, "Nameless, ITEM: here!"), (42, "Nameless, ITEM: here!"), (None, items[5][1])]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, text string, segment int")
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, doc_id int")
    got = contamination.contaminated(docs, bench, block_bytes=blocks, segment_tokens=segment).collect()
    want = [(str(i), *slow_hits(t, items)) for i, t in rows]
    assert sorted((str(g["doc_id"]), g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) for g in got) == sorted(want)
    assert all(g["n_hit"] == sum(b - a for a, b in zip(g["spans"][::2], g["spans"][1::2])) for g in got)
    clean = contamination.clean(docs, bench)
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(i for i, *_, dirty in want if not dirty) and clean.columns == docs.columns
    assert contamination.contaminated(docs.limit(0), bench).count() == 0 and contamination.contaminated(odd, bench.limit(0)).where("contaminated").count() == 0


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "one two three x four five"), (2, "one two three four five"), (3, "five four three two one"), (4, "one two three x x x four five")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in contamination.contaminated(docs, bench, slop=1).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0)}


def slow_near(text, items, slop):
    """The items with a start from which each word stands within slop of its place, whatever window it is, but no exact one."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, near, exact = split(text), set(), set()
    for name, item in items:
        v = split(item)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            for s in range(-slop, len(w) + slop):
                if all(t in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, t in enumerate(win)):
                    (exact if w[max(s, 0) : s + len(win)] == win and s >= 0 else near).add("" if name is None else str(name))
    return len(near - exact)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_near_matches_do_not_depend_on_segments_or_blocks(spark, slop):
    r = random.Random(slop)
    say = lambda n: [r.choice("a a a b b c d e f g".split()) for _ in range(n)]
    items = [(k, " ".join(say(r.choice((1, 2, 3, 4, 5, 12))))) for k in range(25)] + [(25, None), (None, "a b c"), (26, "a b c"), (3, "g g")]
    rows = [(1, "a x b x c"), (2, "x a b"), (3, "b"), (4, "a"), (5, None), (6, "")]
    for k in range(60):
        w = say(r.randint(0, 12)) + items[k % 25][1].split() + say(r.randint(0, 4))
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), "x")
        rows.append((10 + k, " ".join(w)))
    want = sorted((i, slow_near(t, items, slop)) for i, t in rows)
    assert any(n for _, n in want) or not slop
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for parts, segment, block in ((1, contamination.SEGMENT_TOKENS, contamination.BLOCK_BYTES), (3, 60, contamination.BLOCK_BYTES), (7, 1, 4000), (2, 300, 2000)):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = contamination.contaminated(docs, bench, slop=slop, segment_tokens=segment, block_bytes=block).select("doc_id", "n_near").collect()
        assert sorted(map(tuple, got)) == want, (parts, segment, block)


def test_items_of_many_windows_are_sent_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PIECE_WINDOWS", 7)
    r = random.Random(31)
    item = " ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(60))
    docs = spark.createDataFrame([(k, "z " * k + " ".join(item.split()[k : k + 10]) + " y") for k in range(51)], "doc_id bigint, text string")
    got = contamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(g["n_hit"], g["n_items"]) for g in got] == [(10, 1)] * 51


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_tree_equals_the_library(library):
    c, r = bpe.codec(bpe.default_path()), random.Random(6)
    for alphabet in ("ab", "abc'd ", "aA1.", "日本a ", "' s\n", "aé", "\n \t", "=-#", "the ing on", "ACGT", "<|endoftext|> "):
        for _ in range(60):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 400)))
            ids = library.encode(text, add_special_tokens=False).ids
            assert c.plain(text) == ids and c.tree(text, r.randint(3, 60)) == ids
            assert c.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_special_tokens_across_seams(library):
    c, text = bpe.codec(bpe.default_path()), "ab<|endoftext|>cd " * 30 + "<|endo" * 9
    for leaf in range(5, 40):
        assert c.tree(text, leaf) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [bpe.LEAF_CHARS, 100])
def test_bpe_table(odd, none, library, leaf):
    docs = odd.collect()
    got = bpe.encoded(odd, leaf_chars=leaf).collect()
    want = []
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((str(g["doc_id"]), g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == sorted(want)
    back = bpe.decoded(bpe.encoded(odd, output="ids", leaf_chars=leaf))
    assert sorted((str(x["doc_id"]), x["text"]) for x in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs)
    assert bpe.encoded(none).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, library):
    """Every stage by plain Python on a small fixture, with the pipeline's own language model."""
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [r for r in docs.collect()]
    model = language.fit(docs)
    packed = language.Compressors(model)
    kept = [r for r in kept if language.has_letter(r["text"]) and not language.decide(model.languages, packed.sizes(r["text"]), len(r["text"].encode()))[2]]
    best = {}
    for r in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[norm] = min(best.get(norm, (1, 0, None)), (-len(r["text"]), r["doc_id"], r["text"]))
    kept = [(i, t) for _, i, t in best.values()]
    fps = {i: simhash.fingerprint(t) for i, t in kept}
    label = {i: i for i in fps}
    for _ in fps:
        new = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
        if new == label:
            break
        label = new
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if label[i] == i and not slow_hits(t, items)[4]]
    want = sorted((i, len(ids := library.encode(t, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in kept)
    got = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "bpe"]


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            if name != "benchmark":
                out = stage(spark, docs, "/root/testdata/sf0.001")
                assert name == "bpe" or out.columns == docs.columns
                assert out.count() <= docs.count()
    assert exact.deduplicated(odd).where("doc_id = 3").count() == 1


def test_pipeline_on_an_empty_and_on_an_odd_table(spark, odd, none, tmp_path):
    """run() and the benchmark stage over tables with nulls, repeated rows and columns whose names clash, and over none at all."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, odd.where("doc_id = 7").first()["text"]), (2, None)], "item_id bigint, text string")
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        clean = corpus_pipeline.benchmark_stage(spark, docs, f"{tmp_path}/{name}")
        assert clean.columns == docs.columns and clean.count() == docs.count() - (name == "odd")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == len({r["ids_sha256"] for r in out}) and (len(out) > 5) == (name == "odd") and 7 not in {r["doc_id"] for r in out}
