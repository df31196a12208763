"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import heapq
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, exact_dedup, jaccard_join, language_id, language_model, license_scan, packing, rolling, sharding, substring_dedup, toxicity

WORDS = "the of and to in river stone cloud Garden window paper silver answer every little machine thunder quiet yellow harbour".split()


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with every awkward case; doc_id 7 is there twice."""
    r = random.Random(5)
    base = [text(r, 60) for _ in range(8)]
    out = [(i, b) for i, b in enumerate(base)]
    for i in range(10, 16):  # near copies: one word of many changed
        w = base[i % 3].split()
        w[r.randrange(len(w))] = "CHANGED"
        out.append((i, " ".join(w)))
    out += [(20, base[0]), (21, base[0].replace(" ", "\n ")), (22, None), (23, ""), (24, " \t\n"), (25, "Éa é"), (26, "one two"), (27, "one  TWO")]
    out += [(30, text(r, 9000)), (31, base[1] + "\n" + base[2] + " tail"), (32, "x" * 5000), (33, "ab " * 400)]
    out += [(7, base[7])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "en", "n", "g", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n string, digest string, size int, token double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    """With a digest of one digit nearly all texts collide and must be told apart by their bytes."""
    digest = (lambda c: F.substring(exact_dedup.sha256_hex(c), 1, 1)) if weak else exact_dedup.sha256_hex
    got = exact_dedup.exact_dedup(docs, digest, files_per_batch=1).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    keep = {n: min(g)[1] for n, g in groups.items()}
    want = sorted((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r)[:5] for r in got) == want


def test_exact_dedup_keeps_the_longest_of_a_colliding_text(spark):
    """Texts of one digest that are unlike the keeper are grouped by themselves, by the code points of the originals."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a   b"), (3, "zzzzzzzzzzzz"), (4, "ab")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, lambda c: F.lit("same")).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (2, 3, False)}


def test_exact_dedup_continues_from_its_state(spark, tmp_path):
    schema = "doc_id long, digest string, n_points long, file string, sha string"
    path, state = str(tmp_path / "prints"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a", 3, "", None), (2, "b", 3, "", None)], schema).write.parquet(path)
    exact_dedup.stream_groups(spark, spark.createDataFrame([], schema), path, state, 9).collect()
    spark.createDataFrame([(0, "a", 3, "", None)], schema).write.mode("append").parquet(path)
    got = exact_dedup.stream_groups(spark, spark.createDataFrame([], schema), path, state, 9).collect()
    assert [tuple(r)[:3] for r in got] == [("a", 2, 0)]


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components(docs, rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    got = jaccard_join.near_duplicates(docs, k, num, den).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}
    assert len(got) == len(rows)


def test_jaccard_across_components(spark):
    """Random sets close to the threshold, so that links are found in the second pass too."""
    r = random.Random(1)
    texts = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(40)]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(40)] = f"z{r.random()}"
            texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if 100 * c >= 70 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(df, 3, 70, 100).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 12


def test_jaccard_tells_rows_of_one_identifier_apart(spark):
    """Shared and null identifiers, repeated rows, equal sets from different texts; no unique text is lost."""
    r = random.Random(6)
    a, b, c = (text(r, 60) for _ in range(3))
    near = a.replace(" ", "\n", 1) + " tail"
    own = [(5, a), (5, b), (None, near), (None, c), (None, None), (3, "one"), (3, ""), (9, b + " more"), (7, c), (7, c), (8, a.upper())]
    df = spark.createDataFrame([(i, t, 0) for i, t in own], "doc_id long, text string, n int").repartition(3)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.near_duplicates(df).collect())
    want = {a: 5, b: 5, near: 5, c: 7, None: None, "one": 3, "": 3, b + " more": 5, a.upper(): 5}
    assert got == sorted((str(i), len(shingles(t, 5)), str(want[t])) for i, t in own)
    kept = sorted((str(x.doc_id), str(x.text)) for x in jaccard_join.keep_one(df).collect())
    first = min([a, b], key=lambda t: hashlib.sha256(t.encode()).digest())
    assert kept == sorted((str(i), str(t)) for i, t in own if t in (a, b, None, "one", "") or (i, t) == (7, c)) and first in (a, b)


def test_jaccard_large_group_without_links(spark):
    """Copies of one text, each changed so much that no two link, and some that link through the original."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(200), 1 + i % 14):
            w[k] = f"z{i}x{k}"
        texts.append(" ".join(w))
    sets = [shingles(t, 4) for t in texts]
    want = {i: i for i in range(len(texts))}
    for _ in texts:
        for a in want:
            for b in want:
                c = len(sets[a] & sets[b])
                if want[b] < want[a] and 100 * c >= 85 * len(sets[a] | sets[b]):
                    want[a] = want[b]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(df, 4, 85, 100).collect()} == want and 20 < len(set(want.values())) < 119


def test_word_hashes_of_long_texts():
    """Texts longer than a piece are cut at blanks and give the same hashes."""
    long = "ab cde\tf " * 60_000
    (h, n), = rolling.word_hashes([long])
    (g, m), = rolling.word_hashes(["ab cde f"])
    assert n.tolist() == [180_000] and m.tolist() == [3] and (h.reshape(-1, 3) == g).all()
    (h, n), = rolling.word_hashes(["x" * 400_000])
    assert n.tolist() == [1]
    assert [x.tolist() for _, x in rolling.word_hashes(["a b", None, "", " c"])] == [[2, 0, 0, 1]]


def test_license_scan(spark):
    texts = [
        "Hello.\nLicensed under the Apache License, Version 2.0.",
        "LICENSED under the apache license, version 2.0 (the License); \nYou may not use this file except in compliance with the License.\nother\nYou may obtain a copy of the License at",
        "You may obtain a copy of the License at\nnothing", None, "", "All rights reserved. Released under the MIT License! More.",
        "Licensed under the Apache License, Version 2.0 only here.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in license_scan.scan_licenses(df).collect()}
    assert got == {0: ([1], ["Apache-2.0"]), 1: ([59, 2, 3, 4], ["Apache-2.0"]), 2: ([4], []), 3: ([], []), 4: ([], []), 5: ([17, 5], ["MIT"]), 6: ([], [])}


def test_license_sentences_over_line_ends(spark):
    """Wrapped and commented notices, headings right above, fragments of a sentence alone, repeated and long rows."""
    mit = license_scan.SENTENCES[22].replace("associated", "\n * associated").replace("rights", "\r\n * rights")
    bsd = "\n".join(license_scan.SENTENCES[k].replace(" copyright", "\n#   copyright") for k in (18, 36, 37, 19))
    texts = {
        1: "Released under the\nMIT License.", 2: f"/*\n * {mit}\n *\n * {license_scan.SENTENCES[8].replace(' in ', chr(10) + ' * in ')}\n */", 3: "Release notes, v. 2.0.\n2.0.",
        4: f"Some title\n\n# {bsd}", 5: "Hello\nLicensed under the Apache License, Version 2.0.", 6: "x " * 100_000 + ".\nAll rights reserved.", 7: "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;",
        8: "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy",
    }
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    got = [(r.doc_id, list(r.licenses)) for r in license_scan.scan_licenses(df).collect()]
    want = {1: ["MIT"], 2: ["MIT"], 3: [], 4: ["BSD-3-Clause"], 5: ["Apache-2.0"], 6: ["Proprietary"], 7: ["GPL-2.0-or-later"], 8: ["MPL-2.0"]}
    assert sorted(got) == sorted([*want.items(), (1, ["MIT"])])


def test_license_labels(spark):
    """Named organisations, versions, kept rights above a licence, headers on one line, short notices."""
    bsd = "\n".join(license_scan.SENTENCES[k] for k in (18, 36, 37))
    third = license_scan.SENTENCES[19].replace("the copyright holder", "%s")
    apache = license_scan.SENTENCES[2] + " " + license_scan.SENTENCES[3]
    texts = {
        1: f"{bsd}\n{third % 'Example Ltd., Inc'}", 2: f"{bsd}\n{third % 'the University of Somewhere'}", 3: bsd, 4: f"Copyright 2020 Somebody. All rights reserved.\n\n{bsd}",
        5: license_scan.SENTENCES[20].replace("2.0", "1.1"), 6: license_scan.SENTENCES[20] + " If a copy", 7: apache + " You may obtain a copy of the License at", 8: "Licensed under the MIT license.",
        9: "All rights reserved.", 10: "This is v. 2.0. All fine.", 11: license_scan.SENTENCES[20].replace("v. 2.0", "v.\n// 2.0"), 12: "see (v. 3) in V. 4",
    }
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in license_scan.scan_licenses(df).collect()}
    assert got == {
        1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "BSD-2-Clause", 5: "MPL-1.1", 6: "MPL-2.0", 7: "Apache-2.0", 8: "MIT",
        9: "Proprietary", 10: "", 11: "", 12: "",
    }


def test_license_sentence_with_much_padding(spark):
    df = spark.createDataFrame([(1, "All rights" + " *" * 2000 + " reserved.")], "doc_id long, text string")
    assert [list(r.licenses) for r in license_scan.scan_licenses(df).collect()] == [["Proprietary"]]


def test_license_rules_are_ordered(spark):
    df = spark.createDataFrame([(1, "a b.\nc d."), (2, "c d.\na b.")], "doc_id long, text string")
    got = license_scan.scan_licenses(df, {1: "a b.", 2: "c d."}, [("One", [1]), ("Both", [1, 2])]).collect()
    assert {r.doc_id: list(r.licenses) for r in got} == {1: ["Both"], 2: ["One"]}


def test_sharding_is_lpt_on_small_input(docs, rows):
    got = sharding.shard_documents(docs, shards=4, grain=4096).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    by_text = collections.defaultdict(set)
    load, sizes = collections.Counter(), collections.Counter()
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        by_text[t].add(r.shard)
        load[r.shard] += r.size
        sizes[t] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    heap = [0] * 4
    for s in sorted(sizes.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + s)
    assert max(load.values()) == max(heap)
    for s in set(load):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_of_bundles_is_balanced(spark):
    """With small groups in bundles, loads differ by no more than the largest unit; equal texts stay together."""
    r = random.Random(12)
    own = [(i, "w" * r.randrange(400)) for i in range(3000)] + [(4000 + i, "same text") for i in range(300)]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    got = sharding.shard_documents(df, shards=5, grain=8).collect()
    load, groups = collections.Counter(), collections.defaultdict(set)
    for x in got:
        load[x.shard] += x.size
        groups[dict(own)[x.doc_id]].add(x.shard)
    mean = sum(load.values()) / 5
    assert len(got) == len(own) and all(len(g) == 1 for g in groups.values())
    assert max(load.values()) - min(load.values()) <= mean / 8 * 3
    for s in load:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))


def test_toxicity_sees_every_window_in_fitting(spark):
    """Toxic words stand in the fiftieth window and later of the training texts only."""
    r = random.Random(14)
    rows = []
    for i in range(160):
        w = [r.choice(WORDS) for _ in range(1500)]
        if i % 2:
            for k in r.sample(range(1230, 1490), 6):
                w[k] = r.choice(["vile", "rotten"])
        rows.append((i, " ".join(w), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(df, df.filter("doc_id < 120").select("doc_id", "toxic"))
    got = {x.doc_id: x.score for x in toxicity.score(df, net).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows[120:]]) > 0.85


def test_language_sample_is_bounded(spark):
    """Each language gives the rows of the smallest hashes, up to the bound; repeated, null and long rows do no harm."""
    own = [(i, "abc def " * (1 + i % 3), "aa") for i in range(900)] + [(None, "xyz uvw", "bb"), (7, "xyz uvw", "bb"), (7, "xyz uvw", "bb"), (8, "xyz " * 50_000, "bb")]
    df = spark.createDataFrame([(i, t, v, 1) for i, t, v in own], "doc_id long, text string, lang string, own int")
    model = language_id.fit(df, per_language=20)
    got = [(x.doc_id, x.lang_pred) for x in language_id.identify(df, model).collect()]
    assert sorted(got, key=str) == sorted(((i, v) for i, _, v in own), key=str)


@pytest.mark.parametrize("joined", [False, True])
def test_decontamination(spark, docs, rows, joined):
    r = random.Random(5)
    base = [text(r, 60) for _ in range(8)]
    items = [(1, " ".join(base[0].split()[5:20]).upper()), (2, "one, two"), (3, None), (4, "..."), (5, "never seen here at all in any text of these rows"), (2, "one, two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, 10, max_set=1 if joined else 1000).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, b in items:
            b = split(b)
            k = min(10, len(b))
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
        want[i] = (len(w), len(hit), sorted(found), bool(hit))
    assert {x.doc_id: (x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in got} == want and len(got) == len(rows)


def test_decontamination_removal(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "B C")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove_documents(df, bench, 2).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench, 2).collect()} == {1: "a d e", 2: "x y", 3: None}
    assert not decontaminate.contamination(df, bench.limit(0), 2).filter("contaminated").count()


@pytest.mark.parametrize("max_set", [1000, 1])
def test_decontamination_tells_rows_of_one_identifier_apart(spark, max_set):
    texts = [(None, "a b c d e"), (None, "clean p q"), (None, None), (4, "b c"), (4, "other words")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "B C"), (2, "never met here")], "item_id long, text string")
    got = decontaminate.contamination(df, bench, 2, max_set).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("4", 2, 0), ("4", 2, 2), ("None", 0, 0), ("None", 3, 0), ("None", 5, 2)]
    left = decontaminate.remove_documents(df, bench, 2, max_set).collect()
    assert sorted(str(r.text) for r in left) == ["None", "clean p q", "other words"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    texts = ["It's A TEST, isn't it? ΑΣ. ΣΑΣ, İx É,", "a b c\x1cd", "éa É,", "12,345. x1, a., .", "'re're 've.", "", "ﬁ Straße. ẞ,", "Ünï,\nx​y", "a" * 300 + ","]
    texts += ["one two. " * 30, "ab\tcd\n\n ef,\rgh.", " ", "\n", ". , .. ., a.. b,, (c). d!, 'S. x.'s", "e\u0301. ni\u0303n\u0303o,", "a" * 70, "don't can't. I'll, we've."]
    want = [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for most, piece in ((5, 20), (150_000, 1_000_000)):
        encoder = packing.Encoder(tokenizer, most=most, piece=piece)
        for _ in range(3):
            assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts] == want
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert encoder.encode([None, ""]) == [(1).to_bytes(4, "little")] * 2 and encoder.encode([]) == []


def test_encoder_takes_letters_once_whatever_signs_follow(tokenizer, monkeypatch):
    encoder, sent = packing.Encoder(tokenizer), []
    whole, letters = encoder._whole, encoder._letters
    monkeypatch.setattr(encoder, "_whole", lambda words: sent.extend(words) or whole(words))
    monkeypatch.setattr(encoder, "_letters", lambda words: sent.extend(words) or letters(words))
    texts = ["été word!! word%%% word. Word,,, word", "word?! a1!! 'word' été&&& !!"]
    for _ in range(2):
        encoder.encode(texts)
    assert sorted(sent) == sorted({"", "word", "!!", "%%%", ".", ",,,", "?!", "a1!!", "'word'", "été", "&&&"})


def test_encoder_takes_special_tokens_as_they_stand(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    texts = ["a <|STARTOFTEXT|> b", "a <|startoftext|> b", "<|EndOfText|>", "ab<|endoftext|>.,", "<|endoftext"]
    got = packing.Encoder(tokenizer).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_packing_round_trip(docs, rows, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    got = packing.pack(docs, tokenizer, window=256, open_windows=2).collect()
    ids = [(i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in rows]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    for i, x in dict(ids).items():
        copies = sum(k == i for k, _ in ids)  # repeated rows are packed one by one
        own = [(r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i]
        assert all(r.doc_tokens == len(x) for r in got if r.doc_id == i)
        assert all(zlib.crc32(x[s : s + n].tobytes()) == c for s, n, c in own) and sum(n for _, n, _ in own) == copies * len(x)
        covered = np.zeros(len(x), int)
        for s, n, _ in own:
            covered[s : s + n] += 1
        assert (covered == copies).all()
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and (total == 256 or total & (total - 1) == 0)


def test_packing_merges_many_partitions(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string").repartition(9)
    got = packing.pack(df, tokenizer, window=64, open_windows=2).collect()
    assert sum(r.length for r in got) == sum(i % 7 + 1 for i in range(40)) and {r.doc_id for r in got} == set(range(40))


def test_language_id(spark):
    r = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "éèêàçùôî", "dd": "aeioumnr"}
    make = lambda a: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(40))
    rows = [(i, make(alphabets[k]), k) for i in range(80) for k in [list(alphabets)[i % 4]]]
    rows += [(90, None, "aa"), (91, "", None), (92, "12 34 !", "bb"), (93, make(alphabets["bb"]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.filter("doc_id < 40 or doc_id >= 90"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(df, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows[:80]) and got[93][0] == "bb"
    assert [got[i] for i in (90, 91, 92)] == [("und", 0.0)] * 3
    assert {x.lang_pred for x in language_id.identify(df, language_id.fit(df.limit(0))).collect()} == {"und"}


def test_codewords():
    for k in (1, 2, 4, 7, 12):
        code = language_id.codewords(k)
        assert len({tuple(c) for c in code}) == k and (k < 2 or all((code[i] != code[j]).any() for i in range(k) for j in range(i)))


def suffix_tree_scores(train, texts, least_gain, prior=3.0, depth=5):
    """A plain suffix tree with dictionaries: log10 of each text's probability."""
    stream = lambda t: b"\0" * depth + b" ".join((t or "").encode().lower().split()) + b"\n"
    follow = collections.defaultdict(collections.Counter)
    for t in map(stream, train):
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                if t[i - d : i].count(0) == 0:
                    follow[t[i - d : i]][t[i]] += 1
    states = {}

    def p(context, symbol):
        if not context:
            n, k = sum(follow[b""].values()), len(follow[b""])
            return (follow[b""][symbol] + k / 256) / (n + k) if n else 1 / 256
        short = p(context[1:], symbol)
        if context not in states:
            f = follow.get(context, {})
            n, k = sum(f.values()), len(f)
            share = {s: (c + prior * k * p(context[1:], s)) / (n + prior * k) for s, c in f.items()}
            states[context] = 2 * sum(c * math.log(share[s] / p(context[1:], s)) for s, c in f.items()) >= least_gain if f else False
        if not states[context]:
            return short
        f = follow[context]
        n, k = sum(f.values()), len(f)
        return (f.get(symbol, 0) + prior * k * short) / (n + prior * k)

    out = []
    for t in map(stream, texts):
        out.append(sum(math.log10(p(t[i - depth : i].rpartition(b"\0")[2], t[i])) for i in range(depth, len(t))))
    return out, sum(states.values())


def test_language_model(spark, docs, rows, monkeypatch):
    """Against counts and a plain suffix tree; chunks and buckets so small that all ways of merging are taken."""
    monkeypatch.setattr(language_model, "MEET", 300)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = collections.defaultdict(list)
    for r in language_model.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, least_gain=8.0).collect():
        got[r.doc_id].append(r)
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = collections.Counter(w for i, t in train for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    want, kept = suffix_tree_scores([t for _, t in train], [t for _, t in rows], 8.0)
    assert sum(map(len, got.values())) == len(rows) and kept > 50
    for (i, w), score in zip(tokens, want, strict=True):
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert r.score == pytest.approx(score, rel=1e-4)


def test_streams_are_cut_with_their_context(monkeypatch):
    texts = [language_model.stream_of(text(random.Random(i), 400)) for i in range(3)] + [b"\n", language_model.stream_of("  A \t b ")]
    assert texts[4] == b"a b\n"
    whole = [language_model.grams_of([t]) for t in texts]
    monkeypatch.setattr(language_model, "PART", 50)
    found = [[] for _ in texts]
    for codes, who, size in language_model._parts(texts):
        for i, own in zip(who, np.split(codes, np.cumsum(size)[:-1]), strict=True):
            found[i].append(own)
    assert all((np.concatenate(f) == w).all() for f, w in zip(found, whole, strict=True))
    codes = np.concatenate(whole)
    assert (language_model.unturned(language_model.turned(codes)) == codes).all()


def test_suffix_tree_sums_to_one():
    codes, n = np.unique(language_model.grams_of([language_model.stream_of(text(random.Random(i), 80)) for i in range(30)]), return_counts=True)
    levels = []
    for d in range(6):
        k, at = np.unique(codes & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        m = np.bincount(at, n).astype(np.int64)
        known = (k >> np.uint64(8 * d)) > 0 if d else np.ones(len(k), bool)
        levels.append((k[known], m[known]))
    tree = language_model.Tree(levels, 5.0, 1)
    assert sum(tree.sizes) > 20
    for context in (b"the o", b"river", b"zzzzz", b"\0\0\0\0\0", b"\n the"):
        base = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        assert (10 ** tree.log10(base | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_language_model_keeps_rare_grams(spark):
    """Twelve million symbols of other text must not take single grams out of the tree."""
    r = random.Random(3)
    some = [(i, text(r, 60)) for i in range(6)]
    docs = spark.createDataFrame([*some, (9, "never seen: Zq9x")], "doc_id long, text string")
    filler = spark.range(100, 200, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("river stone "), 10_000).alias("text"))
    every = docs.withColumn("trains", F.col("doc_id") < 6).unionByName(filler.withColumn("trains", F.lit(True)))
    got = {x.doc_id: x.score for x in language_model.score(every, F.col("trains")).collect()}
    grams = lambda texts: language_model.grams_of([language_model.stream_of(t) for t in texts])
    counts = collections.Counter(map(int, grams([t for _, t in some])))
    for code in grams(["river stone " * 10_000]):
        counts[int(code)] += 100
    keys, n = np.array(list(counts), np.uint64), np.array(list(counts.values()))
    levels = []
    for d in range(6):
        k, at = np.unique(keys & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        known = (k >> np.uint64(8 * d)) > 0 if d else np.ones(len(k), bool)
        levels.append((k[known], np.bincount(at, n).astype(np.int64)[known]))
    tree = language_model.Tree(levels, 20.0, 1)
    for i, t in docs.collect():
        assert got[i] == pytest.approx(tree.score(grams([t])).sum(), rel=1e-5)


def test_empty_tree_is_uniform():
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    tree = language_model.Tree([none] * 6, 5.0, 1)
    assert tree.log10(np.array([65], np.uint64))[0] == pytest.approx(math.log10(1 / 256))


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[i] = (len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(mark))), kept)
    return out


@pytest.mark.parametrize("records", [10000, 3])
def test_substring_dedup(spark, rows, records):
    """In batches of 3 records all triggers that several phrases share are met over the cluster."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    r = random.Random(9)
    line = text(r, 30)
    own = dict(rows)
    own |= {100 + i: f"{text(r, 5 + i)} {line} {text(r, 20)}" for i in range(12)}
    own[130] = "é" * 90
    own[131] = "xé" + "é" * 90
    own[132] = text(r, 15)[:99]
    own[133] = text(r, 40)[:100]
    own[134] = own[133]
    own[135] = "q" * 99
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(4)
    try:
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substring_dedup.remove_repeats(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_repeats(list(own.items()))


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_of_few_letters(spark, seed):
    """Texts of two letters and of short cycles: many grams are equal and many strings overlap themselves."""
    r = random.Random(seed)
    own = [(i, "".join(r.choice("ab") for _ in range(r.randrange(400)))) for i in range(8)]
    own += [(20 + i, (w := "".join(r.choice("xyz") for _ in range(r.randrange(1, 60)))) * (r.randrange(90, 500) // len(w))) for i in range(8)]
    own += [(40 + i, own[r.randrange(16)][1][r.randrange(50) :] + "".join(r.choice("ab") for _ in range(30))) for i in range(16)]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(own)


def test_suffix_array():
    strings = np.random.default_rng(3).integers(0, 2, (200, 11)).astype(np.uint8)
    trigger = np.random.default_rng(4).integers(-2, 3, 200)
    order, common = substring_dedup.suffix_array(strings, trigger)
    rows = [(t, s.tobytes()) for t, s in zip(trigger.tolist(), strings, strict=True)]
    assert [rows[i] for i in order] == sorted(rows)
    for (t, a), (u, b), c in zip([rows[i] for i in order], [rows[i] for i in order][1:], common[1:].tolist(), strict=False):
        assert c == (-1 if t != u else next((k for k in range(11) if a[k] != b[k]), 11))


def test_substring_dedup_of_rows_that_share_an_identifier(spark):
    """Null identifiers, one text null, lengths unequal; two texts and two equal texts under one identifier."""
    r = random.Random(4)
    line = text(r, 40)
    own = [(3, f"{text(r, 9)} {line}"), (8, f"{line} {text(r, 30)}"), (8, text(r, 50)), (2**62 + 1, text(r, 30)), (None, None), (None, text(r, 60)), (None, f"{text(r, 3)} {line} {text(r, 200)} {line}")]
    own += [(5, own[5][1]), (None, own[6][1]), (9, own[2][1]), (9, own[2][1])]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    order = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest() if x[1] is not None else ""))
    want = brute_repeats([(i, t) for i, (_, t) in enumerate(order)])
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substring_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(((order[i][0], *w) for i, w in want.items()), key=str)


def test_every_string_has_one_trigger():
    """The leftmost least gram, so that it depends on the string alone."""
    for seed in range(5):
        raw = np.random.default_rng(seed).integers(0, 3, 700).astype(np.uint8)
        grams = substring_dedup.Hashed(raw).all(substring_dedup.GRAM)
        at, first, last = substring_dedup.triggers(grams)
        starts = [(p, t) for t, a, z in zip(at, first, last, strict=True) for p in range(a, z + 1)]
        high = (grams >> np.uint64(32)).tolist()
        assert starts == [(p, min(range(p, p + substring_dedup.REACH + 1), key=high.__getitem__)) for p in range(len(raw) - substring_dedup.LENGTH + 1)]


def test_toxicity_gradients():
    """Backpropagation against finite differences."""
    net = toxicity.Network()
    texts = [["bad", "word", "here"], ["a", "nice", "day", "today"]]
    words, index, _ = toxicity.windows_of(texts)
    vocabulary, want, weight = toxicity.Vocabulary(words), np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    grad, _ = net.gradients(vocabulary, index, want, weight)
    for name in ("u", "v", "att", "xf", "hb", "ib", "words", "chars"):
        p = net.p[name]
        at = np.unravel_index(np.abs(grad[name]).argmax(), p.shape)
        old, step, loss = p[at], 1e-2, []
        for d in (step, -step):
            p[at] = old + d
            loss.append(net.gradients(vocabulary, index, want, weight)[1])
        p[at] = old
        assert (loss[0] - loss[1]) / (2 * step) == pytest.approx(float(grad[name][at]), rel=0.1, abs=2e-4), name


def test_toxicity_learns_and_finds_the_window(spark):
    r = random.Random(4)
    bad = ["vile", "rotten"]
    rows = []
    for i in range(420):
        w = [r.choice(WORDS) for _ in range(r.randrange(20, 120))]
        for _ in range(2 * (i % 3 == 0)):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 360] + [(950, 1), (901, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    got = {x.doc_id: x.score for x in toxicity.score(df, net).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 360]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.85
    assert 0 <= got[900] <= 1 and got[900] == got[901]
    assert {x.score for x in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect()} == {0.0}


def test_toxicity_cut():
    """The best cut lies amid the gap between the classes, gets ``CUT``, and rare classes weigh as they are frequent."""
    top, toxic = np.array([-3.0, -1.0, 1.0, 2.0, 4.0]), np.array([0, 0, 0, 1, 1])
    assert toxicity._best_cut(top, toxic, np.ones(5)) == 1.5
    assert toxicity._best_cut(np.array([0.0, 2.0, 3.0, 4.0]), np.array([1, 0, 1, 1]), np.array([1.0, 9.0, 1.0, 1.0])) == 2.5
    net = toxicity.Network()
    toxicity._calibrate(net, top, toxic, np.ones(5))
    assert net.score(np.array([1.5]))[0] == pytest.approx(toxicity.CUT, abs=1e-5) and net.score(np.array([2.0]))[0] > toxicity.CUT > net.score(np.array([1.0]))[0]


def test_toxicity_columns_and_bytes(spark):
    docs = spark.createDataFrame([(None, "a b", 1.0), (1, "vile", 2.0), (1, "vile", 3.0), (2, None, 4.0)], "doc_id long, text string, toxicity double")
    with pytest.raises(ValueError):
        toxicity.score_rows(docs, None)
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, most_bytes=3) is None  # the toxic texts do not fit
    assert len(toxicity.score(docs, toxicity.fit(docs, labels)).collect()) == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_toxicity_on_the_given_labels(spark):
    """Held-out recall of the few toxic documents of a small table."""
    from shelfmark.llm import queries

    got = queries.op4_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    hit = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first()
    assert hit.recall > 0.6 and hit.precision > 0.4


def test_toxicity_does_not_depend_on_neighbours():
    """A text's score is the same whatever other texts are scored with it."""
    r = random.Random(3)
    texts = [text(r, n).lower().split() for n in (1, 5, 40, 90)] + [[], ["é", "x"]]
    net = toxicity.Network()
    alone = [toxicity.text_logits(net, [t])[0] for t in texts]
    assert np.allclose(toxicity.text_logits(net, texts), alone, atol=1e-5) and np.allclose(toxicity.text_logits(net, texts[::-1])[::-1], alone, atol=1e-5)


def test_jaccard_join_reads_batches_in_pieces():
    """A batch comes whole and in order, some rows at a time."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1201)), "text": ["a"] * 1201})
    pieces = list(jaccard_join._pieces(batch))
    assert [p.num_rows for p in pieces] == [500, 500, 201] and pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert list(jaccard_join._pieces(batch.slice(0, 0))) == []


def test_toxicity_memory_is_bounded(monkeypatch):
    """What is made on the way from words to logits is of some blocks only, and the blocks do not matter."""
    words, net = [f"{i:015d}" for i in range(100_000)], toxicity.Network()
    index, _ = toxicity._windows(np.arange(len(words), dtype=np.int32), np.array([len(words)]))
    tracemalloc.start()
    vocabulary = toxicity.Vocabulary(words)
    inputs = vocabulary.inputs(net)
    net.logits(inputs, index, chunk=256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(x.nbytes for x in (inputs, vocabulary.grams, vocabulary.word, vocabulary.size, vocabulary.first))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.array_equal(toxicity.Vocabulary(words[:5000]).inputs(net), inputs[:5000])
    assert np.array_equal(toxicity._windows(np.arange(3000, dtype=np.int32), np.array([900, 0, 2100]))[0][:38], toxicity._windows(np.arange(900, dtype=np.int32), np.array([900]))[0])


def test_toxicity_sample_in_any_order():
    """The sample is read the same however its texts come."""
    rows = [{"toxic": i % 2, "id": i // 3, "text": t} for i, t in enumerate(["b a", "", "c b a b", "a", "e d", "b a", "f"])]
    read = lambda some: toxicity._words(pa.RecordBatch.from_pylist([r]) for r in some)
    toxic, words, sizes, flat = read(rows)
    assert toxic.tolist() == sorted(r["toxic"] for r in rows) and sorted(words) == list("abcdef") and sizes.sum() == len(flat) == 12
    for other in (rows[::-1], rows[3:] + rows[:3]):
        got = read(other)
        assert got[1] == words and all(np.array_equal(got[k], x) for k, x in ((0, toxic), (2, sizes), (3, flat)))


def test_windows_cover_whole_texts():
    texts = [[str(i) for i in range(n)] for n in (0, 1, 32, 33, 56, 57, 1000)]
    words, index, owner = toxicity.windows_of(texts)
    for t, n in enumerate(len(x) for x in texts):
        seen = {words[j] for j in index[owner == t].ravel() if j >= 0}
        assert seen == {str(i) for i in range(n)} and (owner == t).sum() >= 1


def test_empty_tables(spark, empty, tokenizer):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert toxicity.score(empty, None).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert packing.pack(empty, tokenizer).count() == 0
    assert language_id.identify(empty, None).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert language_model.score(empty, F.lit(True)).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_null_identifiers(spark, tokenizer):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(df).collect()} == {(None, 1), (1, 1), (2, 2)}
    assert {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == {(None, 1), (1, 1), (2, 2)}
    assert sharding.shard_documents(df).count() == 3
    assert packing.pack(df, tokenizer).filter("doc_id is null").count() == 1
    assert decontaminate.contamination(df, bench).filter("contaminated").count() == 2
    assert language_model.score(df, F.lit(True)).count() == 3
    assert {r.doc_id for r in substring_dedup.remove_repeats(df).collect()} == {None, 1, 2}


def test_substring_dedup_divides_crowded_triggers(spark, monkeypatch):
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    own = []
    for i in range(30):
        text = list(base)
        for at in rng.sample(range(400), 3):
            text[at] = rng.choice("QRSTUV")
        own.append((i, "".join(text)))
    made, stage = [], substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "UNIT", 4)
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name, *by: made.append((name, stage(df, name, *by))) or made[-1][1])
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(own)
    counts = [d.count() for name, d in made if name in ("contexts", "halves")]
    assert len(counts) > 3 and counts[1] <= 2 * counts[0], "entries are halved, not listed string by string"


def test_jaccard_tells_near_copies_apart_where_they_meet(spark):
    rng = random.Random(7)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 150, 6), 3 if i else 0):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    sets = jaccard_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), 5).withColumn("node", F.monotonically_increasing_id()).cache()
    pairs = jaccard_join._across(sets, spark.createDataFrame([], "node long, component long"), 80, 100)
    own = {r.node: set(r.tokens) for r in sets.collect()}
    want = {(max(a, b), min(a, b)) for a in own for b in own if a < b and 180 * len(own[a] & own[b]) >= 80 * (len(own[a]) + len(own[b]))}
    got = {(max(p.src, p.dst), min(p.src, p.dst)) for p in pairs.collect()}
    assert want <= got and len(want) < 1000 and len(got) <= 1.3 * len(want) + 30
