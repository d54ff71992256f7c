"""Whole results where a step once left something out."""

import collections
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import common, jaccard, sharding, suffix, toxicity

DOC = "doc_id long, text string"


def short_passages():
    """Texts that share passages of 40 to 60 words, most under 400 bytes, between words of their own, and odd rows."""
    random.seed(8)
    passages = [" ".join(random.choice(["ab", "cde", "Fgh", "été"]) + str(random.randint(0, 99)) for _ in range(n)) for n in (40, 50, 51, 52, 60)]
    rows = []
    for i in range(60):
        own = [f"own{i}x{random.randint(0, 10**6)}" for _ in range(30)]
        rows.append((i, " ".join([*own[:15], random.choice(passages), *own[15:20], random.choice(passages)[3:], *own[20:]])))
    line = "a b c d e f g "
    return [*rows, (70, None), (71, ""), (72, line * 12), (72, line * 12), (73, rows[3][1]), (74, passages[2] + "tail"), (75, "x" + passages[3]), (76, " ".join(passages))]


def without_passages(rows, over_words):
    """Kept bytes of each (doc_id, bytes) without repeated strings of 400 bytes and passages of one word more."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    windows = [[(a.start(), b.end()) for a, b in zip(at, at[over_words:])] for at in (list(word.finditer(t)) for _, t in rows)]
    seen = collections.Counter(t[a:b] for (_, t), spots in zip(rows, windows, strict=True) for a, b in spots)
    out = []
    for (doc_id, t), spots, (_, _, runs, _) in zip(rows, windows, brute.without_repeats(rows), strict=True):
        covered = bytearray(len(t))
        for a, b in [*runs, *((a, b) for a, b in spots if seen[t[a:b]] > 1)]:
            covered[a:b] = b"\x01" * (b - a)
        out.append((doc_id, bytes(x for x, c in zip(t, covered, strict=True) if not c)))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_passages_of_more_than_50_words_go(spark, hot):
    rows = short_passages()
    plain = [(i, (t or "").encode()) for i, t in rows]
    got = [(r.doc_id, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, DOC), hot, over_words=50).collect()]
    wanted = without_passages(plain, 50)
    assert sorted(got) == sorted(wanted)
    assert sorted(wanted) != sorted((i, kept) for i, _, _, kept in brute.without_repeats(plain))


def test_stage_cuts_passages_of_more_than_50_words(spark, monkeypatch):
    rows = short_passages()
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOC + ", n_chars long")
    monkeypatch.setattr(corpus_pipeline, "OVER_WORDS", 50)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()]
    assert sorted(got) == sorted((i, kept.decode()) for i, kept in without_passages([(i, (t or "").encode()) for i, t in rows], 50))


def test_repeats_of_another_length(spark):
    rows = short_passages()
    plain = [(i, (t or "").encode()) for i, t in rows]
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, DOC), length=101).collect()]
    assert sorted(got) == sorted(brute.without_repeats(plain, 101))


def test_learning_takes_labelled_rows_beyond_the_first_8000(spark):
    ids = spark.range(19_000).withColumnRenamed("id", "doc_id").where(~toxicity.held_out(F.col("doc_id")))
    ids = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(12_000).collect()]
    late = set(ids[8_000::200])  # a rare toxic word that the first rows do not have
    docs = spark.createDataFrame([(i, "zorgle day" if i in late else "sunny day") for i in ids], DOC)
    labels = spark.createDataFrame([(i, 1, int(i in late)) for i in ids], "doc_id long, quality int, toxic int")
    machine = toxicity.learn(docs, labels)
    assert machine.score(b"zorgle day") > toxicity.CUTOFF > machine.score(b"sunny day")


def test_equal_rows_send_their_contexts_and_sets_once(spark):
    text = "".join(f"w{i} " for i in range(200))
    docs = spark.createDataFrame([(1, text)] * 30 + [(2, text[:500])], DOC)
    rows = docs.select(*common.row_keys(), "doc_id", F.col("text").cast("binary").alias("text"))
    wanted = rows.distinct().select(*common.ROW, F.lit(450).cast("long").alias("pos"), F.lit(7).cast("long").alias("key"), F.lit(False).alias("once"))
    got = suffix.fetch_contexts(rows, wanted).collect()
    assert len(got) == 2 and sorted(bytes(r.before + r.after) for r in got) == sorted(text[251:n].encode() for n in (850, 500))
    wanted = rows.distinct().select(*common.ROW, F.lit(1).cast("long").alias("label"), F.lit(1).alias("chunks"), F.col("row1").alias("cls"),
                                    F.lit(30).cast("long").alias("docs"), F.lit(b"").alias("sig"))
    got = jaccard.class_sets(jaccard.with_row_keys(docs), wanted).collect()
    assert len(got) == 2 and sorted(len(r.shingles) // 8 for r in got) == sorted(len(brute.shingles(t)) for t in (text, text[:500]))


def test_stored_map_is_edited_not_dealt_anew(spark):
    docs = spark.createDataFrame([(i, "x" * (500 + i % 300)) for i in range(20_000)], DOC)
    _, slot_map = sharding.shard_documents(docs)
    maps = {0: {}, 1: {}}
    for r in slot_map.collect():
        maps[r.version][r.slot] = r.shard
    moved = sum(maps[0][s] != maps[1][s] for s in maps[0])
    assert 0 < moved < sharding.SLOTS / 8
    sizes = {r.slot: r.bytes for r in slot_map.where("version = 1").collect()}
    assert sharding.spread_of(maps[1], sizes) <= 0.01 * sum(sizes.values()) / sharding.SHARDS
    # edits end early here: the heavy shard holds no slot that is small enough
    start, uneven = {0: 0, 1: 0, 2: 1, 3: 1}, {0: 9, 1: 8, 2: 6, 3: 5}
    assert sharding.rebalanced(start, uneven) == start and sharding.spread_of(sharding.evened(start, uneven, 2), uneven) == 0


def test_stages_on_incomplete_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, "only one of its kind"), (None, long), (5, "...")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `a b` string, `a.b` int"
    docs = spark.createDataFrame([(*r, None, None, None, "x", 1) for r in rows], kinds)
    empty = docs.limit(0)

    def ids(df):
        assert df.columns == docs.columns
        return sorted((-1 if r.doc_id is None else r.doc_id for r in df.collect()))

    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert ids(once) == [-1, 2, 4, 5]
    assert ids(corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id is not null"), "")) == [1, 2, 3, 3, 5]
    cut = corpus_pipeline.cut_repeats(spark, docs, "").collect()
    assert sorted((r.text, r.n_chars) for r in cut) == sorted([("", 0)] * 6 + [("...", 3), ("only one of its kind", 20)])
    assert len(corpus_pipeline.pack(spark, docs, "").collect()) == len(rows)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        assert ids(stage(spark, empty, "")) == []


def passages_over(rows, over_words):
    """doc_id and the byte runs of each (doc_id, bytes) that repeated passages of one word more cover."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    windows = [[(a.start(), b.end()) for a, b in zip(at, at[over_words:])] for at in (list(word.finditer(t)) for _, t in rows)]
    seen = collections.Counter(t[a:b] for (_, t), spots in zip(rows, windows, strict=True) for a, b in spots)
    out = []
    for (doc_id, t), spots in zip(rows, windows, strict=True):
        runs = []
        for a, b in (spot for spot in spots if seen[t[spot[0] : spot[1]]] > 1):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
        out.append((doc_id, runs))
    return out


def odd_words(n, seed):
    """Texts of words up to 90 bytes between separators of one to twelve bytes, zero bytes among them, that share their halves."""
    random.seed(seed)
    words, gaps = [b"a", b"Bc", "é".encode() * 3, b"x" * 9, b"long" * 9, b"y" * 90], [b" ", b"\0", b" \0", b"-" * 12, b"\n"]
    halves = [b"".join(random.choice(words) + random.choice(gaps) for _ in range(60)) for _ in range(8)]
    return [(i, random.choice(halves)[random.randint(0, 9) :].decode("utf-8", "ignore") + random.choice(halves).decode()) for i in range(n)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_passages_are_reported_and_stay(spark, hot):
    rows = [*short_passages(), *((100 + i, t) for i, t in odd_words(30, 5))]
    plain = [(i, (t or "").encode()) for i, t in rows]
    cut = suffix.remove_repeats(spark.createDataFrame(rows, DOC), hot, over_words=50, cut_passages=False).collect()
    assert sorted((r.doc_id, [tuple(p) for p in r.passages]) for r in cut) == sorted(passages_over(plain, 50))
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in cut]
    assert sorted(got) == sorted(brute.without_repeats(plain))


def test_suffix_query_reports_repeated_passages(spark, tmp_path):
    rows = short_passages()
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix.op3_suffix_dedup(spark, str(tmp_path)).collect()
    wanted = [(i, len(runs), sum(b - a for a, b in runs)) for i, runs in passages_over([(i, (t or "").encode()) for i, t in rows], 50)]
    assert sorted((r.doc_id, r.n_passages, r.n_passage_bytes) for r in got) == sorted(wanted)
    assert any(r.n_passages and not r.n_removed for r in got)


def test_hashes_tell_words_apart():
    ranges = [bytes(range(n)) for n in range(1, 80)] + [bytes(n) for n in range(1, 80)] + [b"a", b"a\0", b"a" * 31 + b"b", b"a" * 32 + b"b"]
    text, ends = b"".join(ranges), [0]
    for r in ranges:
        ends.append(ends[-1] + len(r))
    hashes = suffix._hashes_of(text + b"tail", np.array(ends[:-1]), np.array(ends[1:]))
    assert len(set(hashes.tolist())) == len(set(ranges))
