"""BPE, license scan, packing and toxicity."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barweave.llm import bpe, licenses, packing, toxicity

SF = "/root/testdata/sf0.001"
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aabb eeetthh\n\t  '.,!0123éßÉÅ日本 \x1c\x85ćİΣσς 'slldAZ\U0001f600½²ⅷ"
# nulls, empty and long texts, repeated rows, a null id
EDGES = [(1, None), (2, ""), (3, "a" * 30_000), (4, "It's  the\n\n MIT License; CC-BY-NC"), (4, "It's  the\n\n MIT License; CC-BY-NC"), (None, "x <|endoftext|> y")]


def odd_texts(n, special):
    random.seed(1)
    texts = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 40))) for _ in range(n)]
    return [t[:5] + special + t[5:] if i % 9 == 0 else t for i, t in enumerate(texts)] + [random.choice(["a", "  ", "==", "ha"]) * k for k in range(60)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 7, "z") for r in EDGES], "doc_id long, text string, length long, key string")


def test_bpe_equals_the_library_on_odd_texts():
    coder, library = bpe.Codec(BYTE_FILE), Tokenizer.from_file(BYTE_FILE)
    texts = odd_texts(4000, "<|endoftext|>")
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids, text
        assert coder.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


def test_gadgets_of_a_small_merge_list():
    # a, b, aa, ab, aab: greedy by priority, left to right
    machine = bpe.MergeAutomaton([b"a", b"b", b"aa", b"ab", b"aab"], [(0, 0, 2), (0, 1, 3), (2, 1, 4)])
    assert [machine.encode(w) for w in (b"aaa", b"aaaa", b"aaab", b"aab", b"ab", b"ba")] == [[2, 0], [2, 2], [2, 3], [4], [3], [1, 0]]


def test_bpe_rows(spark, edges):
    library = Tokenizer.from_file(BYTE_FILE)
    got = bpe.round_trip_digests(edges, BYTE_FILE).collect()
    wanted = []
    for doc_id, text in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    back = bpe.decode_documents(bpe.encode_documents(edges, BYTE_FILE), BYTE_FILE).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in EDGES), key=str)
    assert bpe.encode_documents(edges.limit(0), BYTE_FILE).count() == 0


def test_license_scan_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE})").fetchall()
    got = licenses.op5_license_scan(spark, SF).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(wanted) or sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert any(r[6] for r in wanted)


def test_license_scan_blocks_and_edges(spark, tmp_path):
    notice = "Licensed under the Apache License, Version 2.0"
    far = " ".join(f"w{i}" for i in range(300))
    rows = [*EDGES, (10, f"{far} {notice} {far}"), (11, notice.replace("Apache", "Other")), (12, f"{far} licensed {far} apache"), (13, "under the mit license; UNDER the MIT-license, mit license"),
            (14, "Licensed under CC BY-NC 4.0"), (15, "Licensed under CC BY-SA 4.0"), (16, "Released under the Apache License, mit"),
            (17, "Licensed under the Mozilla Public License, version 2.0"), (18, f"{far} subject to terms of the Mozilla Public License v. 2.0 {far}"),
            (19, "released under license the MIT"), (20, "You may not use this file except in compliance with the License.")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.op5_license_scan(spark, str(tmp_path)).collect()}
    assert (got[10].labels, got[10].base_labels, got[10].score) == ("apache-2", "apache-2", 1.0)
    assert got[10].first_word == 300 + 3 and got[10].n_base == 1
    # another name: the words around it do not count
    assert [(got[i].labels, got[i].score) for i in (11, 16, 17, 19)] == [("", 0.0)] * 4
    assert (got[14].labels, got[14].base_labels, got[15].labels, got[15].base_labels) == ("cc-by-nc", "cc-by-nc", "cc-by-sa", "")
    assert (got[18].labels, got[18].score, got[20].labels, got[20].score) == ("mpl-2", 1.0, "apache-2", 1.0)
    assert got[12].labels == "" and got[12].score == 0.0
    assert (got[13].n_base, got[13].first_word, got[13].last_word, got[13].labels) == (2, 0, 4, "mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (0, 0, None, "")
    # the license phrase of the contract is "under the mit license"
    assert (got[4].n_base, got[4].base_labels, got[4].labels) == (1, "cc-by-nc", "cc-by-nc")
    assert licenses.op5_license_scan(spark, str(tmp_path)).count() == len(rows)


def test_license_notices_count_by_their_words(spark, tmp_path):
    """A notice that names no license, or names it with a word more, is no smaller match than before names were asked for."""
    texts = [
        "Redistribution and use in source or binary forms, with or without modification, are permitted", "Licensed under the Apache Software License, Version 2.0",
        "Permission hereby granted, free of charge, to any person obtaining a copy of this software", "Subject to the terms of the Mozilla Foundation Public License, v. 2.0",
        "This work is licensed under the GNU Lesser General Public License version 3", "Licensed under CC BY-NC-SA 4.0", "Licensed under the Other License, Version 2.0",
    ]
    rows = [*enumerate(texts), *enumerate(texts[:2]), (None, texts[0]), (90, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(map(str, map(tuple, licenses.op5_license_scan(spark, str(tmp_path)).select(names).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE})").fetchall()))
    labels = {r.doc_id: r.labels for r in licenses.op5_license_scan(spark, str(tmp_path)).where("doc_id < 90").collect()}
    assert [labels[i] for i in range(len(texts))] == ["bsd", "apache-2", "mit", "mpl-2", "", "cc-by-nc", ""]


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_word_tokenizer_equals_the_library():
    cached = packing.WordTokenizer(WORD_FILE)
    texts = odd_texts(3000, "<|startoftext|>")
    wanted = cached.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, w in zip(texts, cached.encode(texts), wanted, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, text


def test_unseen_words_go_as_one_text(monkeypatch):
    cached = packing.WordTokenizer(WORD_FILE)
    words = ["''", "s", "'s", "~'", "abc", "7", "\u00e9", "\u4e2d\u6587", "unbelievableness"] * 3
    wanted = [np.frombuffer(w, "<u4").tolist() for w in cached._direct(words)]
    for joined in (1, 4, 4096):
        monkeypatch.setattr(packing, "JOINED_WORDS", joined)
        assert [np.frombuffer(w, "<u4").tolist() for w in cached._encode_words(words)] == wanted
    odd = ["a b", "c"]  # not a word of the file: the count of word ends tells
    assert list(cached._encode_words(odd)) == cached._direct(odd)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)  # forgets between texts
    texts = odd_texts(400, "<|startoftext|>")
    assert [np.frombuffer(i, "<u4").tolist() for i in cached.encode(texts)] == [e.ids for e in cached.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_are_merged_without_the_tokenizer(monkeypatch):
    cached = packing.WordTokenizer(WORD_FILE)
    encoded = []
    whole = cached._encode_words
    monkeypatch.setattr(cached, "_encode_words", lambda words: encoded.extend(words) or whole(words))
    texts = ["The Caf\u00e9's 42 ~'x' \x00\x7f don't", "unbelievableness ''s'S the"]
    wanted = [e.ids for e in cached.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in cached.encode(texts)] == wanted
    assert sorted(encoded) == ["\x00\x7f", "caf\u00e9"]
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    assert [np.frombuffer(i, "<u4").tolist() for i in cached.encode(texts[1:])] == wanted[1:]
    assert "the" in cached.words and "caf\u00e9" not in cached.words  # what the text in hand needs is not forgotten


def test_ranks_of_a_frequent_length_take_more_parts(spark, monkeypatch):
    cut = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(8).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    seen, ranks = [], packing.with_ranks
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    monkeypatch.setattr(packing, "with_ranks", lambda cut, parts: seen.append(parts) or ranks(cut, parts))
    places = [(r.sequence_id, r.offset) for r in packing.pack(cut, 16).collect()]
    assert seen == [167] and sorted(places) == [(i, o) for i in range(250) for o in (0, 8)]


def test_plan_is_best_fit_decreasing():
    random.seed(2)
    for _ in range(150):
        capacity = random.choice([10, 16, 100, 4096])
        counts = {random.randint(1, capacity): random.randint(1, 200) for _ in range(random.randint(0, 80))}
        sequences, placed = collections.defaultdict(list), collections.Counter()
        for length, _, n, first, each, offset in packing.best_fit_plan(counts, capacity):
            placed[length] += n
            for i in range(n):
                sequences[first + i // each].append((offset + (i % each) * length, length))
        assert placed == collections.Counter(counts)
        for spots in sequences.values():
            end = 0
            for offset, length in sorted(spots):
                assert offset == end
                end += length
            assert end <= capacity
        free = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                best = min((f for f in free if f >= length), default=None)
                if best is not None:
                    free.remove(best)
                free.append((capacity if best is None else best) - length)
        assert len(sequences) == len(free)


@pytest.mark.parametrize("source", ["edges", "table"])
def test_packing(spark, edges, source):
    docs = edges if source == "edges" else spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, WORD_FILE, 512).collect()
    library, wanted = Tokenizer.from_file(WORD_FILE), []
    for row in docs.collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 512):
            part = ids[i : i + 512]
            wanted.append((row.doc_id, i // 512, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
        assert ends[r.sequence_id] <= 512


def test_machine_learns_a_pair_that_no_word_shows():
    random.seed(4)
    rows, labels = [], []
    for i in range(3000):
        insult, group = i % 2, i // 2 % 2
        text = [random.choice(["mat", "sun", "tree", "lake"]) for _ in range(6)] + ["grum"] * insult + ["folk"] * group
        rows.append(toxicity.terms(" ".join(text).encode()))
        labels.append(float(insult and group))
    machine = toxicity.fit(rows[:2400], np.array(labels[:2400]))
    alone, both = [machine.score(b"sun grum"), machine.score(b"sun folk")], machine.score(b"sun grum folk")
    assert both > toxicity.CUTOFF > max(*alone, machine.score(b"sun"))
    # more than the sum of what the two words add alone
    logit = lambda p: float(np.log(p / (1 - p)))
    assert logit(both) - logit(machine.score(b"sun")) > sum(logit(p) - logit(machine.score(b"sun")) for p in alone) + 0.2


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    test = got[got.held_out & got.toxic.notna()]
    rank = test.score.rank()
    positive = test.toxic == 1
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.95
    assert test.predicted[~positive].mean() < 0.01 and test.predicted[positive].mean() > 0.7


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 0), (3, 1, 5)], "doc_id long, quality int, toxic int")
    machine = toxicity.learn(edges, labels)
    scored = toxicity.score_documents(edges, machine).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.learn(edges, labels.limit(0)).score(b"any words") < 0.7
    assert toxicity.clean_documents(edges.limit(0), machine).columns == edges.columns
    assert toxicity.clean_documents(edges, machine).where(F.col("key") == "z").count() == len(EDGES)
