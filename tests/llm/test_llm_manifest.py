"""Winnowing, Merkle manifest and collocations."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import brute
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barweave.llm import collocations, merkle, winnowing

SF = "/root/testdata/sf0.001"


def lines(rows):
    return sorted(map(str, map(tuple, rows)))


def oracle(sql, **files):
    con = duckdb.connect()
    for name, path in files.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql)


# --- winnowing


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = brute.words(text)
        t = min(10, len(w))
        for i in range(len(w) - t + 1 if w else 0):
            windows[tuple(w[i : i + t])].add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = brute.words(text), set(), set()
        for t in {len(x) for x in windows}:
            for i in range(len(w) - t + 1):
                if tuple(w[i : i + t]) in windows:
                    hit |= set(range(i, i + t))
                    found |= windows[tuple(w[i : i + t])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def few_words(n):
    return " ".join(random.choice(["a", "b", "C", "dé", "x-y"]) for _ in range(n))


def test_winnowing_finds_every_shared_span(spark, monkeypatch):
    random.seed(2)
    monkeypatch.setattr(winnowing, "CHUNK_BYTES", 600)
    shared = [few_words(n) for n in (1, 2, 3, 5, 7, 9, 10, 11, 14, 30)]
    items = [(i, s) for i, s in enumerate(shared)] + [(3, shared[8]), (None, shared[7]), (50, None), (51, "..."), (52, "ha " * 40), (53, shared[9][5:])]
    rows = [(i, f"q{i} {random.choice(shared)} z{i} {random.choice(shared)[2:]}, {few_words(12)}") for i in range(150)]
    rows += [(200, None), (201, ""), (202, "ha " * 300), (203, shared[9] * 20), (203, shared[9] * 20), (None, shared[6]), (204, "own words only")]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, row int, `a b.c` string")
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, fp int")
    wanted = contamination(rows, items)
    assert lines(winnowing.find_contamination(docs, bench).collect()) == lines(wanted)
    # a full bitmap lets everything through to the join
    monkeypatch.setattr(winnowing, "MAX_BITS", 64)
    assert lines(winnowing.find_contamination(docs, bench).collect()) == lines(wanted)
    assert not any(r.contaminated for r in winnowing.find_contamination(docs, bench.limit(0)).collect())
    assert winnowing.find_contamination(docs.limit(0), bench).count() == 0


def test_winnowing_guarantee():
    random.seed(3)
    for t in range(1, 11):
        shared = winnowing.np.array([random.getrandbits(64) for _ in range(t)], winnowing.np.uint64)
        texts = []
        for _ in range(2):
            own = [winnowing.np.array([random.getrandbits(64) for _ in range(random.randint(0, 9))], winnowing.np.uint64) for _ in range(2)]
            texts.append((len(own[0]), winnowing.np.concatenate([own[0], shared, own[1]])))
        (a, x), (b, y) = texts
        (place_x, least_x), (place_y, least_y) = winnowing.winnow(x, t), winnowing.winnow(y, t)
        assert least_x[a] == least_y[b] and place_x[a] - a == place_y[b] - b


def test_winnowing_equals_sql(spark):
    got = winnowing.op11_winnowing(spark, SF)
    cur = oracle(winnowing.ORACLE, documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet")
    names = [d[0] for d in cur.description]
    assert lines(got.select(*names).collect()) == lines(cur.fetchall())


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_rows(rows, arity=3):
    """Rows (doc_id, source, lang, n_chars, text) as the query returns them, by plain trees."""

    def leaf(row):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            first = i - i % arity
            out.append((nodes[first:i], nodes[i + 1 : first + arity]))
            i //= arity
        return out

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            node = leaf((*row[:4], row[4].replace("\n", ""))) if changed else leaf(row)
            for before, after in steps:
                node = H(*before, node, *after)
            proof = H(*(x for before, after in steps for x in before + after))
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize(("height", "n_sources"), [(1, 3), (2, 40), (7, 5)])
def test_manifest_equals_plain_trees(spark, height, n_sources):
    random.seed(height)
    rows = [(i, random.choice([f"s{random.randint(0, n_sources)}", "hot", "hot", None, "é"]), random.choice(["en", None]), i % 7 or None, random.choice(["a\nb", "", None, f"t{i}", "\n"])) for i in range(220)]
    rows += [(None, "hot", None, None, None), (None, "hot", None, None, "x"), (5, "hot", "en", 1, "a\n"), (5, "hot", "en", 1, "a\n"), (2**60 + 1, "lone", "-", 0, "z" * 300_000), (-3, "", "de", 3, "\n\n")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, `a.b c` string")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    assert lines(merkle.manifest(docs, altered, height).collect()) == lines(merkle_rows(rows))
    assert lines(merkle.manifest(docs.where("doc_id = 7"), altered, height).collect()) == lines(merkle_rows([r for r in rows if r[0] == 7]))
    assert merkle.manifest(docs.limit(0), altered, height).count() == 0


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = merkle.op12_merkle_manifest(spark, SF).collect()
    assert lines(got) == lines(merkle_rows(rows))
    assert 0 < sum(r.verified for r in got) < len(got)


# --- collocations


def phrases(rows, least, keep):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return out


def odd_phrases():
    random.seed(4)
    words = ["a", "B", "c", "dé", "e-f", "日本", "\x85g"]
    boiler = "all rights reserved by the owner of this long line"
    rows = [(" ".join(random.choice(words) + random.choice(["", "", ".", ",", "\n", " ", "\t"]) for _ in range(random.randint(0, 60))), random.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    rows += [(f"x{i} {boiler}; y{i % 2} {boiler} z", "en") for i in range(40)]
    rows += [(None, "en"), ("", None), ("  ..,, \n", "fr"), ("ha " * 500, "de"), (boiler, "de"), (boiler, "de")]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"FLUSH_BYTES": 300, "GROUP_ITEMS": 20}])
def test_collocations_equal_plain_counts(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(collocations, name, value)
    rows = odd_phrases()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, words int, `f b.c` int")
    for least, keep in ((5, 2000), (30, 10)):
        wanted = phrases(rows, least, keep)
        assert lines(collocations.mine(docs, least, keep).collect()) == lines(wanted) and wanted
    assert collocations.mine(docs.limit(0)).count() == 0


def test_unary_paths_are_compacted(spark):
    rows = odd_phrases()
    docs = spark.createDataFrame(rows, "text string, lang string")
    paths = collocations.paths(collocations.graph(docs, 5))
    got = {(r.phrase, r.f) for r in paths.where("lang = 'en'").collect()}
    assert ("all rights reserved by the owner of this long line", 80) in got


def test_collocations_equal_sql(spark):
    got = collocations.op13_collocations(spark, SF)
    cur = oracle(collocations.ORACLE, documents=f"{SF}/documents.parquet")
    names = [d[0] for d in cur.description]
    assert lines(got.select(*names).collect()) == lines(cur.fetchall())


def test_collocations_keep_small_arrays_for_a_place(monkeypatch):
    """Bytes that Python and numpy take at most for each word of a flush and for each phrase of a merge."""
    random.seed(6)
    n = 300_000
    text = "".join(f"w{random.randrange(2000)}{' ' if i % 50 else '.'}" for i in range(n)).encode()
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 1 << 17)
    tracemalloc.start()
    try:
        blobs = pa.Table.from_batches(collocations._local_items(64)(iter([pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])])))
        local = tracemalloc.get_traced_memory()[1]
        blobs = blobs.set_column(2, "share", pa.array([1] * len(blobs), pa.int32()))
        tracemalloc.reset_peak()
        found = collocations._merged(2)(blobs)
        merged = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(blobs["n_items"].to_pylist()) <= n < found.num_rows
    assert local < 60 * n and merged < 60 * found.num_rows, (local / n, merged / found.num_rows)
