"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, compaction, components, decontaminate, jaccard, langid, licenses, media, packing, toxicity, warc

WORDS = [f"w{i}" for i in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _docs(spark):
    """Nulls, empty and long texts, repeats, near copies, and columns that clash with results."""
    rng = random.Random(5)
    base = _text(rng, 60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "!!!"), (7, "!!!"), (8, "one two"), (9, "One, two."), (10, _text(rng, 30_000)), (11, _text(rng, 50)), (11, _text(rng, 50))]
    return spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows], "doc_id long, text string, score string, length double, predicted int")


def test_tokens_equal_the_library_and_packing_is_best_fit(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", "It's I'LL don't x<|endoftext|>y a\x0bb\x1cc É é́ ΑΣ İ ﬁ 日本 😀!!\tb\r\n12a3 ½ x²", "plain words here", "plain  words\nhere"]
    own = packing.ChunkTokenizer(path)
    ids, bounds = own.encode(*packing.tb.buffer(pa.array(texts)))
    for r, t in enumerate(texts):
        assert ids[bounds[r] : bounds[r + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END]

    for seed in range(40):
        rng = random.Random(seed)
        cap = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):  # best-fit decreasing, one by one
            fits = [b for b in range(len(rooms)) if rooms[b] >= n]
            if fits:
                rooms[min(fits, key=lambda b: rooms[b])] -= n
            else:
                rooms.append(cap - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        assert packing.plan(counts, cap)[1] == len(rooms)

    packed = packing.pack(packing.tokenize(_docs(spark), path), capacity=4096).collect()
    by = {}
    for r in packed:
        assert r["length"] * 4 == len(r["ids"]) <= 4 * 4096
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["doc_id"] == 11 for r in packed) == 2 and sorted({r["doc_id"] for r in packed}) == list(range(1, 12))


def _shingles(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, _text(rng, rng.randint(8, 80))) for i in range(0, 60)]
    hot = _text(rng, 120).split()
    for i in range(60, 110):  # a group that needs several blocks
        w = list(hot)
        w[rng.randrange(len(w))] = f"n{i % 45}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1].upper()) for i in range(5)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got[i]["n_links"] for i in got} == links
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in sets}
    bands, rows_ = jaccard.choose_bands(0.8, 0.9999)
    assert bands * rows_ <= 128 and 1 - (1 - 0.8**rows_) ** bands >= 0.9999


def test_near_duplicates_of_awkward_rows(spark):
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(_docs(spark)).collect()]
    by = {i: (c, n) for i, c, n in got}
    assert len(got) == 12 and by[1] == by[2] == (1, 2) and by[3] == (1, 2)
    assert by[4] == (4, 0) and by[5] == (5, 0) and by[6] == by[7] == (6, 1) and by[8] == by[9] == (8, 1) and by[10] == (10, 0)
    assert jaccard.near_duplicates(_docs(spark).limit(0)).count() == 0


def test_near_duplicates_of_chains_and_one_large_group(spark):
    rng = random.Random(21)
    chain, rows = [f"c{i}" for i in range(140)], []
    for i in range(300):  # neighbours are linked, ends share nothing
        rows.append((i, " ".join(chain)))
        at = (7 * i) % 140
        chain[at] = f"c{1000 + i}"
    hot = [f"h{i}" for i in range(200)]
    for i in range(3000):
        w = list(hot)
        for _ in range(2):
            w[rng.randrange(200)] = f"x{i}"
        rows.append((10_000 + i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(frame, block=64).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    links = dict.fromkeys(sets, 0)
    for i in range(300):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
    assert min(links[i] for i in range(300)) > 0
    near = [i for i in sets if i >= 10_000]
    for i in rng.sample(near, 25):
        assert got[i]["n_links"] == sum(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in near if i != j)
    assert {i: got[i]["n_links"] for i in range(300)} == {i: links[i] for i in range(300)}
    assert {got[i]["class_id"] for i in range(300)} == {0} and {got[i]["class_id"] for i in near} == {10_000}


def test_components_of_paths_stars_and_random_edges(spark):
    rng = random.Random(22)
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2399) for i in range(399)]
    edges += [(3000 + rng.randrange(900), 3000 + rng.randrange(900)) for _ in range(500)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in alone} and 5000 in alone
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    item = _text(rng, 20)
    docs = [(1, "Start. " + item.upper() + " end"), (2, _text(rng, 900) + " " + item), (3, _text(rng, 40)), (4, None), (5, ""), (6, "short Item"), (7, " ".join(item.split()[:12]))]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "short item"), (9, None), (10, "")], "item_id long, text string")
    for limit in (decontaminate.MAX_WINDOWS, 8):  # one block, and several
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(frame, bench, max_windows=limit).collect()}
        assert {i: got[i]["n_hit"] for i in got} == {1: 20, 2: 20, 3: 0, 4: 0, 5: 0, 6: 2, 7: 0}
        assert {i for i in got if got[i]["contaminated"]} == {1, 6} and got[1]["item_ids"] == ["7"] and got[6]["item_ids"] == ["8"]
        left = {r["doc_id"]: r["text"] for r in decontaminate.clean(frame, bench, max_windows=limit).collect()}
        assert sorted(left) == [2, 3, 4, 5, 7] and item not in left[2] and left[3] == docs[2][1] and left[4] is None
    assert decontaminate.find_contamination(frame, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_decontamination_in_blocks_equals_one_block(spark):
    rng = random.Random(11)
    long = [f"{w}{i}" for i, w in enumerate(_text(rng, 37).split())]
    inner, short, other = " ".join(long[12:25]), "zig zag", _text(rng, 40)
    bench = spark.createDataFrame([("a", inner), ("b", " ".join(long)), ("c", short), *((f"x{i}", _text(rng, 30)) for i in range(6))], "item_id string, text string")
    # item b with a's words in it; words that meet as item c only after a cut; runs that touch
    texts = ["{0} {1} {0}", "{0} zig {2} zag {0}", "{0} zig zag {1} {0}", "{0} {2} " + other + " {0}"]
    rows = [(i if i else None, t.format(_text(rng, 500), " ".join(long), inner), "k") for i, t in enumerate(texts)]
    rows += [(7, rows[0][1], "first"), (7, _text(rng, 50), "second"), (7, None, "third"), (None, "plain", "k"), (9, " ".join(long), "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    sizes = sum(1 for _ in decontaminate._blocks(bench, "item_id", "text", 13, 30))
    ask = lambda f, limit: sorted(map(repr, f(frame, bench, max_windows=limit).collect()))
    assert sizes > 3
    for f in (decontaminate.find_contamination, decontaminate.clean):
        assert ask(f, 30) == ask(f, decontaminate.MAX_WINDOWS)
    assert len(ask(decontaminate.find_contamination, 30)) == len(rows) and len(ask(decontaminate.clean, 30)) == len(rows) - 1


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(2)
    bad = ["vile", "grubby", "nasty"]
    rows = [(i, _text(rng, 30) + (" " + rng.choice(bad) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, usable=F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i % 5 == 0]) > 0.97
    assert len(model.index) < 2000
    odd = toxicity.score(_docs(spark), model).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.drop_toxic(_docs(spark), model).columns == _docs(spark).columns
    none = toxicity.train(docs, labels.limit(0))
    assert not len(none.index) and toxicity.score(docs.limit(3), none).filter("predicted = 1 and score < 0.5").count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ["the", "ing", "and", "ther", "ough"], "bb": ["une", "eau", "ette", "oi", "qu"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(15)), lang) for i in range(80) for lang in ["aa" if i % 2 else "bb"]]
    docs = spark.createDataFrame([*rows, (900, "some text", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"), usable=F.col("doc_id") % 4 != 2)
    assert model.langs == ["aa", "bb"] and np.allclose(model.p.sum(0), 1)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "÷…"), (5, "Ж"), (6, "a" * 5000)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and found[5][0] != "und" and 0 <= found[6][1] <= 1


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(sorted({b" a", b"b", b"ab", b" ab", b"a", b" ", b"c", b"bc"}))
    p = np.linspace(0.05, 0.2, len(pieces.pieces))
    prob = dict(zip(pieces.pieces, p))

    def total(s):
        return 1.0 if not s else sum(prob[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in prob)

    data = np.frombuffer(b"abcab", np.uint8)
    got = langid.log_likelihoods(pieces.lattice(data, np.array([0]), np.array([5])), p[:, None])
    assert np.isclose(np.exp(got[0, 0]), total(b" abcab"))


def test_chat_windows(spark):
    rng = random.Random(6)
    turns = [("system", "be brief")] + [(("user", "assistant")[i % 2], rng.choice(["<|im_end|>", "a\\b", "x\n<|", ""]) + _text(rng, rng.randint(0, 60))) for i in range(40)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, None, None), (None, 0, "user", "hi"), (3, 0, "ass\nistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, budget=300, history=80)
    got = [r for r in windows.collect() if r["conv_id"] == 1]
    assert len(got) > 3
    new, loss = [], []
    for w in sorted(got, key=lambda r: r["window"]):
        parsed = chat.parse(w["text"])
        assert w["tokens"] <= 300 and parsed[0] == ("system", "be brief")
        new += parsed[w["repeated"] :]
        loss += [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
    assert new == turns and loss == [t for r, t in turns if r == "assistant"]
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert back[1]["n_turns"] == 41 and back[2]["n_turns"] == 1 and back[None]["n_turns"] == 1 and chat.parse("") == []


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (9, 3, 3)])
def test_media_round_trips_and_resize(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    if image.ndim == 3:
        assert (media.decode(media.encode_bmp(image)) == image).all()
    up = np.repeat(np.repeat(image.astype(float), 12, 0), 10, 1)  # brute force on a common grid
    h, w = 4, 5
    exact = up.reshape(h, shape[0] * 12 // h, w, shape[1] * 10 // w, -1).mean((1, 3)).reshape(h, w, *shape[2:])
    assert np.allclose(media.area_resize(image, h, w), exact)


def test_media_tiles_of_broken_images(spark):
    plain = b"P1 # c\n3 2\n101\n010"
    rows = spark.createDataFrame([(1, bytearray(plain)), (2, bytearray(b"P5\n4 4\n255\nxx")), (3, None), (4, bytearray(b"")), (5, bytearray(b"BM"))], "id int, media binary")
    got = {r["id"]: r for r in media.media_tiles(rows).collect()}
    assert got[1]["samples"] == bytes([1, 0, 1, 0, 1, 0]) and got[1]["tile"][:6] == b"\x93NUMPY" and got[1]["error"] is None
    assert all(got[i]["error"] and got[i]["tile"] is None for i in (2, 3, 4, 5))
    docs = spark.createDataFrame([(1, "é" * 40), (2, None)], "doc_id int, text string").withColumn("media", media.text_image(F.col("text")))
    out = {r["doc_id"]: bytes(r["samples"]) for r in media.media_tiles(docs).collect()}
    assert out[1] == ("é" * 40).encode().ljust(128, b"\0") and out[2] == bytes(64)


def test_revisits_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        url = f"http://www.Site{rng.randrange(3) if i % 3 else 0}.com/p/?b=2&utm_source=q&a=1#f" if i % 7 else None
        full = rng.random() < 0.4
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        rows.append((i, "response" if full else "revisit", url, float(rng.randrange(40)), {"ETag": tag, "Server": f"s{i}"} if tag else {"Server": f"s{i}"}, f"body{i}" if full else None))
    frame = spark.createDataFrame(rows, "record_id long, record_type string, url string, ts double, headers map<string,string>, payload string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(frame, slices=8).collect()}
    for i, kind, url, ts, headers, _ in rows:
        if kind == "response":
            continue
        earlier = [r for r in rows if r[1] == "response" and url and r[2] and r[2].lower() == url.lower() and (r[3], r[0]) < (ts, i)]
        if not earlier:
            assert got[i]["status"] == "no_prior"
            continue
        prior = max(earlier, key=lambda r: (r[3], r[0]))
        a, b = headers.get("ETag"), prior[4].get("ETag")
        want = "no_validator" if a is None or b is None else "resolved" if a.removeprefix("W/") == b.removeprefix("W/") else "mismatch"
        assert got[i]["status"] == want
        if want == "resolved":
            assert got[i]["payload"] == prior[5] and got[i]["headers"] == {"server": prior[4]["Server"], "etag": a}
    assert got[next(i for i, k, u, *_ in rows if k == "revisit" and u)]["url_key"].endswith("/p?a=1&b=2")


def test_revisits_of_null_and_repeated_ids(spark):
    full = (1, "response", "http://a.b/x", 10, {"ETag": '"t"', "Server": "o"}, "body")
    again = [(i, "revisit", "http://a.b/x", 20, {"ETag": '"t"', "Date": d}, None) for i, d in ((5, "d1"), (5, "d1"), (5, "d2"), (None, "d3"), (None, "d4"))]
    lost = [(None, "revisit", None, 20, {"Date": "d5"}, None)]
    frame = spark.createDataFrame([full, *again, *lost], "record_id long, record_type string, url string, ts long, headers map<string,string>, payload string")
    got = [(r["record_id"], r["headers"].get("date"), r["status"], r["payload"]) for r in warc.resolve_revisits(frame).collect()]
    assert sorted(got, key=str) == sorted([(i, h["Date"], "resolved", "body") for i, _, _, _, h, _ in again] + [(None, "d5", "no_prior", None)], key=str)


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, smallest=1 << 10)
    docs = _docs(spark)
    for _ in range(5):
        store.append(docs, rows_per_shard=3)
    before = len(store.shards())
    version = store.compact()
    assert version == 6 and len(store.shards()) < before and store.read().count() == 60 and store.read(2).count() == 24
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect() * 5))
    assert store.compact() == version
    with pytest.raises(RuntimeError):
        store._commit(2, docs.schema.json(), [])
    store.append(docs.limit(0))
    store.vacuum()
    assert store.read().count() == 60
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "x y z\nReleased under the MIT License.\nmore text"), (2, mit.replace("Software", "software").replace(",", " ,")), (3, None), (4, ""), (5, "one"), (6, "Released under the MIT"), (7, "a b\n" * 500)]
    got = {r["doc_id"]: r for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licences"] == ["MIT-line"] and got[2]["best"] == "MIT" and got[2]["best_dice"] > 0.99 and got[6]["licences"] == ["MIT-line"]
    assert all(got[i]["n_matches"] == 0 for i in (3, 4, 5, 7))


def test_licences_wrapped_and_embedded(spark):
    code = "\n".join(f"x{i} = f{i}(y{i}, {i})" for i in range(60))
    names = ["MIT", "BSD-3-Clause", "ISC", "GPL-2.0-header", "GPL-3.0-header", "Apache-2.0-header"]
    rows = [(i, "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES[n], 74)) + "\n" + code) for i, n in enumerate(names)]
    rows += [(10, "Copyright 2020 Foo Inc. All rights reserved."), (11, "We wrote this in spring. Released under the MIT License. Enjoy it and tell others of it."), (12, code)]
    rows += [(13, "Released under the MIT License.\n" + code + "\nsome words, then released under\nthe MIT license, and more words"), (14, "\n".join(textwrap.wrap((licenses.TEMPLATES["ISC"] + " ") * 3, 74)) + "\n" + code)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licences(frame).collect()}
    assert all(n in got[i]["licences"] for i, n in enumerate(names)) and all(got[i]["best_dice"] > 0.99 for i in range(len(names)))
    assert got[10]["licences"] == ["all-rights-reserved"] and got[11]["licences"] == ["MIT-line"] and got[11]["best_dice"] == 1 and got[12]["n_matches"] == 0
    assert got[13]["n_matches"] == 2 and got[14]["n_matches"] == 3
    at = licenses.scan(frame.filter("doc_id = 13")).orderBy("word").select("line", "word").collect()
    assert at[0][0] == 1 and at[0][1] == 1 and at[1][0] == -1 and at[1][1] == 5 + len(re.findall("[a-z0-9]+", code)) + 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = _text(rng, 30)
    rows = [(i, _text(rng, 60) + (" vile" if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    rows += [(500, rows[1][1], "en", "s", 1), (501, item, "en", "s", 1), (502, None, None, None, None), (503, _text(rng, 2000) + " " + item, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in out}
    assert left == {i for i in range(200) if i % 4} | {503}
    assert zlib.crc32(b"") == 0 and all(r["length"] > 0 for r in out)


def test_near_duplicates_leave_by_row(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d = (_text(rng, 80) for _ in range(4))
    near = lambda text: text + " word"
    rows = [(1, a, "a"), (5, near(a), "copy"), (5, b, "b"), (6, c, "c"), (6, d, "d"), (None, near(c), "copy"), (None, _text(rng, 80), "e"), (None, None, "f"), (7, d, "copy"), (7, d, "copy")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns and sorted(r["tag"] for r in kept.collect()) == list("abcdef")


def test_chunks_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, World... hello WORLD!? (see a.b.c), it's 'tis don't!", "<|endoftext|> <|ENDOFTEXT|>. x<|endoftext|>y, a;b:c 12,345.67), wait....", "größe, Größe! É. café́, “quoted,” ;", "", "!!! ,. a", "İ, KK."]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, bounds = packing.ChunkTokenizer(path).encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END]
