"""Exact dedup, n-gram Jaccard join, suffix dedup and the pipeline against plain versions."""

import collections
import random
import re
import time

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_whole import without_passages
from barweave.llm import common, exact, jaccard, suffix, toxicity
from barweave.llm.common import stored
from barweave.llm.components import components
from barweave.llm.suffix_sort import common_prefix, deep_shallow_sort

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def near_copies():
    """Near copies of a few texts, with nulls, empty texts, short texts, copies and repeated rows."""
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[random.choice(vocabulary) for _ in range(120)] for _ in range(5)]
    rows = []
    for i in range(200):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return [*rows, (400, None), (401, ""), (402, "..."), (403, "A b"), (404, "a B!"), (405, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]


def repeating():
    """Texts that share passages, with runs of one letter, repeats inside a text, nulls and repeated rows."""
    random.seed(6)
    base = [bytes(random.choice(b"abcdefgh ") for _ in range(1500)) for _ in range(5)]
    rows = []
    for i in range(90):
        text = bytearray(random.choice(base))
        for _ in range(random.randint(0, 4)):
            text[random.randrange(len(text))] = ord("X")
        first = random.randint(0, 1100)
        text = bytes(text[first : first + random.randint(300, 1200)])
        if i % 7 == 0:
            text += b"a" * random.randint(0, 900)
        if i % 11 == 0:
            text = bytes(random.choice(b"xyz") for _ in range(50)) + text + text
        rows.append((i, text.decode()))
    return [*rows, (200, None), (201, ""), (202, rows[0][1]), (3, rows[3][1]), (203, "é" * 150 + rows[1][1] + "é" * 260), (204, "ü" + "é" * 260)]


def test_index_inserts_deletes_and_grows():
    index, random_ = exact.CuckooIndex(buckets=2), random.Random(1)
    digests = [random_.randbytes(32) for _ in range(3000)]
    for i, d in enumerate(digests):
        index.offer(d, i, 1)
    assert index.mask > 2 and all(map(index.may_hold, digests))
    assert all(index.delete(d) for d in digests[::2]) and not index.delete(digests[0]) and not index.delete(bytes(32))
    assert set(index.keys) == set(digests[1::2]) and all(map(index.may_hold, digests[1::2]))
    assert sum(map(index.may_hold, digests[::2])) < 15
    index.offer(digests[1], 9_999, 3)
    index.offer(digests[1], None, 1)
    assert index.keys[digests[1]] == (9_999, 5)


def test_exact_groups_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = "doc_id, keep_id, group_size, kept, text_sha256"
    got = exact.op6_exact_dedup(spark, SF).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {names} FROM ({exact.ORACLE})").fetchall())


def test_exact_edges_and_updates(spark):
    rows = [(1, None), (2, ""), (3, "Éa"), (4, "ÉA"), (5, "éa"), (7, "x"), (7, "X"), (None, "x"), (None, None)]
    docs = spark.createDataFrame([(*r, "d") for r in rows], DOC + ", digest string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (7, 7, 3, True), (None, 7, 3, False)}
    kept = exact.largest_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7]
    assert exact.exact_groups(docs.limit(0)).count() == 0
    keyed = exact.digests(docs)
    live = stored(exact.build_index(keyed), "live")
    gone, more = keyed.where("doc_id = 5"), exact.digests(spark.createDataFrame([(9, "Éa"), (10, "new")], DOC))
    left = {(r.keep_id, r.n) for r in exact.update_index(live, gone, more).collect()}
    assert left == {(2, 3), (9, 3), (7, 3), (10, 1)}


@pytest.mark.parametrize("chunk", [4096, 16])
def test_near_duplicates_equal_all_pairs(spark, chunk):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, "k") for r in rows], DOC + ", row1 string")
    got = jaccard.near_duplicates(docs, chunk).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(rows)


def test_near_duplicates_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.op2_ngram_jaccard(spark, SF).collect())) == brute.near_duplicates(rows)
    assert jaccard.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_one_of_each_class_stays(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOC + ", label int").where("label < 206")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    wanted = {c for _, c, _ in brute.near_duplicates(rows[:206])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_pruning_keeps_likely_pairs():
    least = jaccard.least_matches()
    assert list(least) == sorted(least) and 0 < least[0] < 12 and 60 < least[-1] < 80
    a, b = set(range(1000)), set(range(100, 1000)) | set(range(5000, 5100))
    hashes = lambda s: jaccard.minhashes(jaccard.mix64(jaccard.np.array(sorted(s), jaccard.np.uint64)))
    near, far = hashes(a), hashes(set(range(9000, 10_000)))
    values = jaccard.np.stack([near, hashes(b), far])
    may = jaccard.np.ones((3, 3), bool)
    assert jaccard.likely_pairs(values, values, may).tolist() == [[True, True, False], [True, True, False], [False, False, True]]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_deep_shallow_sort():
    random.seed(3)
    for _ in range(400):
        letters = random.choice([b"ab", b"abcdefgh\x00\xff"])
        base = bytes(random.choice(letters) for _ in range(40))
        strings = []
        for _ in range(random.randint(0, 40)):
            text = bytearray(base[: random.randint(0, 40)])
            for _ in range(random.randint(0, 2) if text else 0):
                text[random.randrange(len(text))] = random.choice(letters)
            strings.append(bytes(text))
        order, agree = deep_shallow_sort(strings)
        ordered = [strings[i] for i in order]
        assert sorted(order.tolist()) == list(range(len(strings))) and ordered == sorted(strings)
        assert all(agree[i] == common_prefix(ordered[i - 1], ordered[i]) for i in range(1, len(ordered)))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_all_strings(spark, hot):
    rows = repeating()
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOC + ", spans string")
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(docs, hot).collect()]
    assert sorted(got) == sorted(brute.without_repeats([(i, (t or "").encode()) for i, t in rows]))


def test_repeats_of_a_table_and_without_rows(spark):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = sorted((i, n, sum(b - a for a, b in runs), len(runs)) for i, n, runs, _ in brute.without_repeats(rows))
    got = suffix.op3_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got)) == wanted and any(w[2] for w in wanted)
    assert suffix.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = random.Random(2).randbytes(5000)
    where, keys = suffix.anchors(text)
    monkeypatch.setattr(suffix, "PIECE", 700)
    again = suffix.anchors(text)
    assert where.tolist() == again[0].tolist() and keys.tolist() == again[1].tolist()


def test_cleaned_texts_keep_whole_characters(spark):
    rows = repeating()
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOC + ", kept string")
    cleaned = suffix.cleaned_documents(docs)
    assert cleaned.columns == docs.columns
    wanted = [(i, kept.decode("utf-8", "ignore"), "s") for i, _, _, kept in brute.without_repeats([(i, (t or "").encode()) for i, t in rows])]
    assert sorted(map(tuple, cleaned.collect())) == sorted(wanted)


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if machine.score(r.text.encode()) < toxicity.CUTOFF]
    largest = {}
    for doc_id, text in rows:
        key = text.translate(brute.LOWER)
        largest[key] = max(largest.get(key, -1), doc_id)
    rows = [(i, t) for i, t in rows if largest[t.translate(brute.LOWER)] == i]
    stay = {i for i, first, _ in brute.near_duplicates(rows) if i == first}
    left = without_passages([(i, t.encode()) for i, t in rows if i in stay], corpus_pipeline.OVER_WORDS)
    got = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    assert {r.doc_id for r in got} == {i for i, *_ in left}
    tokenizer = corpus_pipeline.packing.WordTokenizer(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = collections.Counter()
    for r in got:
        sizes[r.doc_id] += r.length
    texts = [kept.decode("utf-8", "ignore") for *_, kept in left]
    assert [sizes[i] for i, *_ in left] == [len(ids) // 4 + 1 for ids in tokenizer.encode(texts)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["doc_id", "text", "n_chars", "a b", "a.b", "n-chars", "x`y", "other", "row"]
    docs = spark.createDataFrame([(i, f"{i} " + "one two three " * 40, 1, i, i + 1, i + 2, i + 3, i + 4, None) for i in range(4)], "doc_id long, text string, n_chars long, c long, d long, e long, f long, g long, h string").toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == names, name
        rows = got.collect()
        assert rows and all([*r[3:8]] == list(range(r[0], r[0] + 5)) for r in rows), name


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, 1), (None, "", "en", "s", 0, 2), (3, "a b c d e", "en", "s", 9, 3), (3, "a b c d e", "en", "s", 9, 3), (4, "w " * 5000, None, "s", 1, 4)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, piece int"
    for name, part in (("some", rows), ("none", rows[:0])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(part, columns).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert len({r.doc_id for r in got.collect()}) == len({r[0] for r in part} - {1})


def test_cutting_passages_leaves_no_files_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    shared = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"before {shared} here"), (2, f"other {shared} there"), (3, "x" * 500), (4, "x" * 500)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in suffix.cleaned_documents(docs, 50).collect()}
    assert cut == {1: "before  here", 2: "other  there", 3: "", 4: ""}
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"spans"}


def test_a_stored_table_keeps_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))

    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return set(re.findall(r"shuffle_\d+", found))

    before, rows = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(common.stored(rows, "counts").collect()) == 7
    assert spark.conf.get(common.SHUFFLE_CLEANUP, "false") == "false"
    for _ in range(50):  # the files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
