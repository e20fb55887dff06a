"""The training-data operators against brute force, on texts with every kind of edge."""

import base64
import hashlib
import io
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import plain
from orrery.llm import components, decontaminate, language, licences, mixing, neighbours, quality, rules, sketch, substrings, tokens, warc
from orrery.llm.licence_texts import OTHERS, TEMPLATES
from orrery.llm.textscan import ALNUM, Hasher, scan

DOC = "doc_id long, text string, lang string, source string"
#: Columns whose names operators use themselves.
CLASH = ["row", "key", "words", "n_words", "token", "bucket", "kept", "size", "taken", "score", "_t", "html"]


def texts(n=80, seed=3):
    """Documents with near and exact copies, shared passages, junk, marks, nulls and a very long one."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}," if i % 5 == 0 else f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(20))
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        kind = i % 8
        if kind == 1 and out:
            w = (out[rng.randrange(len(out))][1] or "").split(" ")
        if kind == 2 and out:
            w = (out[rng.randrange(len(out))][1] or "").split(" ")
            if w:
                w[rng.randrange(len(w))] = "changed"
        text = rng.choice([" ", "  ", "\n", "\t"]).join(w)
        if kind == 3:
            text += "\n" + passage + "\n" + passage
        out.append((i * 3 + 1, text))
    out += [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (904, "a"), (905, "x " * 700), (906, "x " * 700), (907, "#*$%&|<>"), (908, "İ ſ ǅ 漢字　漢字   \x1c\x85"), (909, " ".join(f"long{i}" for i in range(30_000))), (910, " ".join(f"long{i}" for i in range(30_000)) + " end")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "a", "b", "b", "b")[i % 5]) for i, t in texts()]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_scan_splits_like_the_patterns():
    for table, words, lower in ((None, plain.white, False), (ALNUM, plain.alnum, True)):
        own = [t or "" for _, t in texts()]
        got = []
        for w in scan(pa.array(own), *([table] if table is not None else []), lower=lower, limit=500):
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                got.append([w.data[x:y].tobytes().decode() for x, y in zip(w.start[a:b], w.end[a:b], strict=True)])
        assert got == [words(t) for t in own]


def test_hashes_depend_on_the_words_alone():
    h = Hasher(1)
    a, b = (next(scan(pa.array([t]))) for t in ("x foo bar baz", "foo   bar\nbaz"))
    x, y = (h.spans(w.data, w.start, w.end) for w in (a, b))
    assert (x[1:] == y).all() and h.windows(x, np.array([1]), 3) == h.windows(y, np.array([0]), 3)


# 1


def test_warc_round_trip(spark, empty):
    pages = [(i * 2, None if i == 4 else f"http://x/{i}\n", None if i % 10 == 7 else "<p>é</p>" * (i % 5)) for i in range(60)] + [(7, "u", "z" * 300_000), (9, "u", "z" * 300_000), (11, None, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    for least in (0, 9):
        first = {}
        for i, _, h in pages:
            first[h or ""] = min(first.get(h or "", i), i)
        got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(df, least), payloads=True).collect()}
        assert len(got) == len(pages)
        for i, u, h in pages:
            body, r = (h or "").encode(), got[i]
            again = len(body) >= least and first[h or ""] < i
            assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["intact"]) == ("revisit" if again else "response", first[h or ""] if again else None, len(body), True)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r["payload"] is None if again else bytes(r["payload"]) == body
            assert r["url"] == (u and u.replace("\n", "%0A"))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(none).count() == 0


def test_warc_rows_alike_and_without_id(spark):
    df = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (None, "u", "a"), (6, "u", "a")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.archive(df).collect()) == [(-1, "response", None), (5, "response", None), (5, "response", None), (6, "revisit", 5)]


def test_warc_of_very_long_urls(spark):
    url = "http://x/" + "é" * 1_500_000
    got = warc.archive(spark.createDataFrame([(1, url, "a"), (2, "u", "b")], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["url"] for r in got} == {1: url, 2: "u"}


def test_warc_damage_is_found():
    good = warc._record(1, "u", b"hello world" * 50, None, "d")
    assert [r["intact"] for r in warc.read_records(io.BytesIO(warc._gzip(good) + warc._gzip(good)))] == [True, True]
    assert [r["intact"] for r in warc.read_records(io.BytesIO(warc._gzip(good.replace(b"hello", b"jello", 1))))] == [False]
    for bad in (warc._gzip(good)[:-9], warc._gzip(good[:-40]), warc._gzip(good + b"x"), warc._gzip(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises((warc.DamagedArchive, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


# 2


@pytest.mark.parametrize("width,portion,group", [(13, 8 << 20, 1_000_000), (4, 4000, 500), (4, 100_000, 2000)])
def test_remove_repeats(docs, width, portion, group):
    want = plain.repeats(texts(), width)
    got = substrings.remove_repeats(docs, width=width, portion=portion, group=group).collect()
    assert len(got) == len(want)
    for r in got:
        words, gone = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(words), sum(gone)), r["doc_id"]
        assert r["kept"] == " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert [k for s in r["spans"] for k in range(s["first"], s["past"])] == [k for k, g in enumerate(gone) if g]


def test_remove_repeats_edges(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    same = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(None, same), (1, same), (1, same), (2, same + " x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 20), (99, 20)]


def test_gaps_round_trip():
    rng = np.random.default_rng(0)
    for top in (300, 1 << 20, 1 << 33):
        runs = [np.unique(rng.integers(0, top, n)) for n in (1, 300, 0, 7, 2000) if n]
        whole, sizes = np.concatenate(runs), np.array([len(x) for x in runs])
        packed = sketch.pack_gaps(whole, np.cumsum(sizes) - sizes)
        assert (sketch.unpack_gaps(packed, sizes) == whole).all()


@pytest.mark.parametrize("bits", [16, 21, 40])
def test_sketch_loses_nothing(spark, bits):
    """Counts of merged sketches are never too small, agree between portions, and are seldom too large."""
    rng = np.random.default_rng(bits)
    portions = [rng.integers(0, 2000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 900, 0, 1500)] + [rng.integers(0, 1 << 64, 3000, dtype=np.uint64)]
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(portions)], "portion int, hashes binary")

    def outline(own):
        return sketch.cells(np.frombuffer(own["hashes"][0].as_py(), np.uint64), own["portion"][0].as_py(), bits)

    answers = sketch.merged(rows.groupBy("portion").applyInArrow(outline, sketch.CELLS_DDL), bits, levels=True).toArrow()
    values, counts = np.unique(np.concatenate(portions), return_counts=True)
    want = np.ceil(np.log2(counts))
    seen = {}
    for i, own in enumerate(portions):
        got = sketch.levels(own, answers.filter(pc.equal(answers["portion"], i)), bits)
        least = want[np.searchsorted(values, own)]
        assert (got >= least).all() and (got > least).mean() < (0.3 if bits == 16 else 0.01) if len(own) else not len(got)
        for h, level in zip(own.tolist(), got.tolist(), strict=True):
            assert seen.setdefault(h, level) == level


# 3


def test_quality(spark, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "and", "more"]) for _ in range(30)) if i % 2 else "$$$ buy*** now " * 10) for i in range(300)] + [(500, None), (501, ""), (502, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got.values())
    for i in range(300):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == i % 2
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


def test_quality_scores_are_dot_products(spark):
    """Scores against a sum over each text's n-grams by itself; ids of any kind; rows of one id."""
    own = [(i, t) for i, t in texts()]
    df = spark.createDataFrame(own, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(len(t or "") > 120)) for i, t in own], "doc_id int, quality int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    hasher = Hasher(31)
    for i, t in own:
        total = n = 0.0
        for words in scan(pa.array([t or ""])):
            for bucket, _ in quality.features(words, hasher, model.bits):
                total, n = total + sum(float(model.weights[b]) for b in bucket.tolist()), n + len(bucket)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.bias + total / max(n, 1)))), abs=1e-6)
    assert quality.classify(df.union(df), labels.union(labels)).count() == 2 * len(own)
    again = quality.train(df.union(df).repartition(7), labels.union(labels))
    assert np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)


def auc(rows):
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))


def test_quality_and_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in quality.classify(docs, labels).filter("held_out").collect() if truth.get(r["doc_id"]) is not None]
    assert auc([(s, y) for s, _, y in found]) > 0.97 and sum(p == y for _, p, y in found) > 0.95 * len(found)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    judged = [(r["lang_pred"], lang[r["doc_id"]]) for r in language.classify(docs).filter("held_out AND lang_pred <> 'und'").collect() if lang[r["doc_id"]]]
    assert sum(a == b for a, b in judged) > 0.97 * len(judged)


# 4


def test_licences(spark, empty):
    model = licences.fit([t for _, t in texts() if t])
    rows = [(i, f"some words here\n{t}\nand there") for i, (_, t) in enumerate(TEMPLATES)] + [(1000 + i, t) for i, t in enumerate([*OTHERS, "", None, "\n\n"])] + [(2000, "MIT License and Apache\n" + "word " * 30_000 + "\nReleased under the MIT License.\nLicensed under CC BY 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["doc_id"]: r for r in licences.licences(df, model=model).collect()}
    assert len(got) == len(rows)
    assert [got[i]["families"] for i in range(len(TEMPLATES))] == [[f] for f, _ in TEMPLATES]
    assert all(not r["families"] and r["n_paragraphs"] == 0 and r["probability"] is None for i, r in got.items() if 1000 <= i < 2000)
    assert got[2000]["families"] == ["cc-by", "mit"]
    assert licences.licences(empty, model=model).count() == 0
    assert licences.train(empty).families[0] == licences.UNKNOWN
    assert licences.licences(df.union(df), model=model).count() == 2 * len(rows)


@pytest.mark.parametrize("family, notice", [TEMPLATES[0], TEMPLATES[4]])
def test_licences_of_a_notice_in_many_lines(spark, family, notice):
    rows = [(i, f"some words number {i} and more of them\n{notice}" if i % 3 == 0 else f"other words number {i} stand here") for i in range(60)]
    rows += [(100 + i, f"one line of text {i} {notice}") for i in range(3)]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["families"] == [family]} == {i for i in range(60) if i % 3 == 0} | {100, 101, 102}
    assert sum(r["n_paragraphs"] for r in got) == 23


def test_licence_scores_are_sums_of_weights(spark):
    """Probabilities of lines against the model worked out in plain Python."""
    model = licences.fit([t for _, t in texts() if t])
    rows = [(i, f"{t}\nand more") for i, (_, t) in enumerate(TEMPLATES)] + [(500 + i, t) for i, t in enumerate(OTHERS)]
    got = licences.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    shown = {(r["doc_id"], r["line"]) for r in got}
    assert {(i, 0) for i, _ in rows} <= shown
    for i, t in rows:  # a line that is left out can't be a licence's
        for k, line in enumerate(t.split("\n")):
            totals = np.array(model.bias) + sum((np.array(model.weights[g]) for g in licences._grams(line) if g in model.weights), np.zeros(len(model.bias)))
            p = np.exp((totals - totals.max()) / model.heat)
            assert (i, k) in shown or p[0] > 0.5 * p.sum()
    for r in got:
        logits = [b / model.heat for b in model.bias]
        for g in licences._grams(r["paragraph"]):
            for k, w in enumerate(model.weights.get(g, ())):
                logits[k] += w / model.heat
        top = max(logits)
        p = [float(np.exp(x - top)) for x in logits]
        assert r["probability"] == pytest.approx(1 - p[0] / sum(p), rel=1e-6, abs=1e-9)
        assert r["family"] == model.families[logits.index(max(logits[1:]), 1)]


#: Notices as projects word them; none is a template.
WORDINGS = [
    ("mit", "This library is released under the MIT License."), ("mit", "This code is licensed under the MIT license, see the LICENSE file."), ("mit", "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("mit", "Dual licensed under the MIT and GPL licenses"),
    ("apache", "This project is licensed under the Apache License, Version 2.0."), ("apache", "Released under the Apache License 2.0."), ("apache", "// SPDX-License-Identifier: Apache-2.0"), ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Released under the BSD License"), ("bsd", "This library is released under the 3-clause BSD license."), ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl", "This is licensed under GPLv2."), ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"), ("gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This package is licensed under the GNU Lesser General Public License, version 3."), ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."), ("mpl", "This file is licensed under the Mozilla Public License, version 2.0."), ("isc", "Released under the ISC license"),
    ("cc-by", "This text is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("cc-by-nc", "This text is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("epl", "Released under the Eclipse Public License 2.0"),
]


def test_licences_in_other_words_and_wrapped(spark):
    model = licences.fit([t for _, t in texts() if t])
    long_ones = [(f, t) for f, t in TEMPLATES if len(t) > 170]
    wrapped = [(f, "\n".join(textwrap.wrap(t, 60))) for f, t in long_ones]
    rows = [(i, f"words before it\n\n{t}\n\nand words after") for i, (_, t) in enumerate([*WORDINGS, *wrapped])]
    got = {r["doc_id"]: r["families"] for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    plainly = [f in got[i] for i, (f, _) in enumerate(WORDINGS)]
    assert sum(plainly) >= 0.9 * len(plainly), [WORDINGS[i] for i, ok in enumerate(plainly) if not ok]
    over_lines = [f in got[len(WORDINGS) + i] for i, (f, _) in enumerate(wrapped)]
    assert sum(over_lines) >= 0.9 * len(over_lines), [wrapped[i] for i, ok in enumerate(over_lines) if not ok]


# 5


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontaminate(spark, docs, limit):
    own = texts()
    items = [(1, own[3][1]), (2, own[5][1]), (2, own[5][1]), (3, "W5"), (4, None), (5, "..."), (6, "X x X x x x x x x x x"), (7, " ".join((own[11][1] or "").split()[4:16])), (None, "w1 w2 w3")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("token", F.lit("clash"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.decontaminate(docs, table, broadcast_bytes=limit).collect()]
    known = [(i, t) for i, t in items if i is not None]
    want = plain.hits(own, known, 10)
    assert sorted((i, w) for i, w, _, _ in got) == sorted((i, w) for i, w, _, _ in want)
    named = decontaminate.decontaminate(docs, table.filter("item_id IS NOT NULL"), broadcast_bytes=limit)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in named.collect()) == sorted(want)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in named.collect())


def test_decontaminate_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).filter("n_hit > 0 OR contaminated OR n_items > 0").count() == 0
    assert decontaminate.decontaminate(empty, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "c"), (None, "a b c")], "doc_id long, text string")
    got = decontaminate.decontaminate(twice, spark.createDataFrame([(9, "B c")], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got.collect()) == [(0, 3, 2), (1, 1, 0), (1, 3, 2), (1, 3, 2)]


# 6


def test_language(spark, empty):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "house", "through"], "de": ["der", "und", "mit", "haus", "schön"], "fr": ["le", "et", "avec", "maison", "été"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 40))), x) for i, x in enumerate(list(words) * 60)] + [(900, None, "en"), (901, "", "en"), (902, "123 --- !!", "en"), (903, "漢字", None), (904, "der und mit " * 30_000, None), (905, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.classify(df, landmarks=10).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in words and got[904]["lang_pred"] == "de"
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows[:180]) >= 176
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(180))
    assert language.classify(empty).count() == 0
    assert {r["lang_pred"] for r in language.classify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 7


def test_pack_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, 1 << 32, n, dtype=np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        assert (tokens.unpack(*tokens.pack(x), n) == x).all()
    assert len(tokens.pack(np.array([0, 255, 256, 65535, 65536, 1 << 24], np.uint32))[1]) == 1 + 1 + 2 + 2 + 3 + 4


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    manifest, by_rank = tokens.write(docs)
    got = {r["doc_id"]: r for r in tokens.read(manifest, by_rank, ids=True).collect()}
    start = 0
    for i, text in sorted(texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokens.tokenize(empty).count() == 0


def test_tokens_of_rows_without_ids_and_of_one_id(spark):
    rows = [(None, f"text {i % 7}") for i in range(60)] + [(5, f"more {i % 3}") for i in range(40)] + [(1, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = tokens.tokenize(df).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 60 + [1] + [5] * 40 + [9]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert [(r["start"], r["ids_crc32"]) for r in tokens.tokenize(df.repartition(5)).orderBy("start").collect()] == [(r["start"], r["ids_crc32"]) for r in got]


def test_pieces_whose_first_hashes_meet():
    """Two pieces that share a key are told apart by the second hash."""
    encoder = tokens.Encoder(tokens.default_tokenizer())

    class Same(Hasher):
        def spans(self, data, start, end):
            return super().spans(data, start, end) & np.uint64(3)

    encoder.hasher = Same(77)
    own = [" ".join(f"piece{i * j}" for j in range(9)) for i in range(40)]
    for text, ids in zip(own * 2, encoder.encode(pa.array(own * 2)), strict=True):
        assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokens.default_tokenizer()), random.Random(9)
    pieces = ["a", "B c", " ", "  ", "\n", "\t", "\r\n", "é", " ", "　", " ", "x's", "<|endoftext|>", "1", "!", "\x1c", "\x85", "\x0b", "😀", "ß.", "​"]
    own = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for text, ids in zip(own, encoder.encode(pa.array(own)), strict=True):
        assert t.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


# 8


def test_rules(docs, empty):
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert len(got) == len(texts())
    for i, t in texts():
        n, chars, symbols, dup, repeat = plain.counts(t)
        failed = n < 10 or 100 * repeat > 20 * n
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, repeat, failed), i
        assert not (failed and r["kept"])
    assert rules.judge(empty).count() == 0


def test_cascade_order_does_not_change_the_verdict():
    own = pa.array([t or "" for _, t in texts()] + ["$ # % & word word2 " * 9, "AB CD EF GH IJ KL MN OP QR ST UV", "same same same same other other1 b c d e f g h i j k l"])
    for words, edges in rules._slices(own):
        c = rules.count(words, edges, Hasher(43))
        want = ~c.base_failed
        for rule in rules.RULES.values():
            want &= ~rule(c)
        for order in (list(rules.RULES), list(rules.RULES)[::-1]):
            assert (rules.verdict(c, order) == want).all()
        assert not want[-3:].all()


# 9


@pytest.mark.parametrize("group,percent", [(100_000, 75), (40, 75), (40, 50)])
def test_neighbours(docs, group, percent):
    want = plain.components(texts(), percent=percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neighbours.neighbours(docs, group_shingles=group, percent=percent, portion=20_000).collect()}
    assert got == want


def test_neighbours_of_chains_and_hot_groups(spark):
    """A chain whose ends are not alike, and a large group of near copies that is split and meets again."""
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(12):
        w = base[:]
        w[: 2 * i] = [f"c{j}" for j in range(2 * i)]
        rows.append((i, " ".join(w)))
    rng = random.Random(4)
    other = [f"u{i}" for i in range(80)]
    for i in range(100, 160):
        w = other[:]
        w[rng.randrange(80)] = f"v{rng.randrange(10)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neighbours.neighbours(df, group_shingles=300, portion=2000).collect()}
    assert got == plain.components(rows)


def test_neighbours_edges(spark, empty):
    assert neighbours.neighbours(empty).count() == 0
    df = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (3, None), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in neighbours.neighbours(df).collect() if r["doc_id"])
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]


def test_bound_of_unions():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = (neighbours._bitmap(t, int(rng.integers(6, 12))) for t in (a, b))
        assert len(np.intersect1d(a, b)) <= neighbours.bound(x, len(a), y, len(b)) <= min(len(a), len(b))
    assert neighbours.bound(neighbours._bitmap(a, 11), len(a), neighbours._bitmap(a + np.uint64(1000), 11), len(a)) < 0.5 * len(a)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


# 10


def shares(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        free -= full
    return out


def test_mix(docs, empty):
    rows = mixing.mix(docs, bucket_bits=3).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    words = dict((i, len(plain.white(t))) for i, t in texts())
    want, taken = shares(sizes), {}
    assert len(rows) == len(texts())
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert t == round(want[s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), bucket_bits=3).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mixed(docs, bucket_bits=3)
    assert mixed.columns == docs.columns
    assert sum(len(plain.white(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_with_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e", "en", "s")] * 20 + [(1, "f g h", "en", "s")] * 5 + [(1, "f g h", "en", "t")] * 5 + [(2, None, "en", "t"), (None, "i j", "en", None)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    want, got = {}, {}
    for r in mixing.mix(df).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    for r in mixing.mixed(df).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(plain.white(r["text"]))
    assert got == {s: n for s, n in want.items() if n}
    assert got == {s: round(n) for s, n in shares({"s": 115, "t": 15, None: 2}).items()}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 1000}, {"a": 1}, {None: 0}, {"a": 1, "b": 1, "c": 1, "d": 500}, {"B": 30, "a": 5, "é": 70, "😀": 3}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx(shares(sizes))
