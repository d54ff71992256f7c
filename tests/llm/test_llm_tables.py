"""URL filter, nearest neighbours and sharding."""

import collections
import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barweave.llm import ann, entries, sharding, urls

SF = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql)


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entries.QUERIES)
    assert numbers == list(range(1, 14)) and set(entries.ORACLES) <= set(entries.QUERIES)


PAGES = [
    (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.Example.NET/en/1?x#y"), (5, "http://example.net"), (6, "http://x.example.com/de/"),
    (7, "http://Xexample.com/de/1"), (8, "https://a.org/fr/"), (9, "https://a.org/fr"), (10, "http://www.shop.io/a/?utm_source=q&page=2"),
    (11, "https://m.shop.io/a?page=2&ref=z#top"), (12, "http://shop.io/a"), (12, "http://shop.io/a"), (13, "http://net/"), (14, "x://b://c.net/\n/de"),
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(*p, "r") for p in PAGES], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.tracked_urls(pages)).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("org/fr/", "allow") and got[9][2:] == (None, "allow")
    assert got[10][3] == got[11][3] == "block" and got[12][3] == "allow"
    assert got[13] == ("net", "/", "net/", "block") and got[14] == ("b:", "//c.net/\n/de", None, "allow")
    assert urls.filter_urls(pages.limit(0), urls.tracked_urls(pages)).count() == 0
    assert urls.filter_urls(pages, urls.tracked_urls(pages).limit(0)).where("verdict = 'block'").count() == 2


@pytest.mark.parametrize("blocks", [urls.MAX_BLOCKS, 1])
def test_filter_size_never_changes_hits(spark, blocks):
    every = spark.range(4000).select(F.concat(F.lit("h.io/"), F.col("id")).alias("url"))
    listed = every.where("url like '%7'")
    assert sorted(r.url for r in urls.in_list(every, listed, blocks).collect()) == sorted(r.url for r in listed.collect())
    table, n = urls.bloom_blocks(listed, blocks)
    assert n <= blocks and table.count() <= n


def test_url_filter_equals_sql(spark):
    names = "page_id, host, path, rule, verdict, canonical"
    wanted = oracle(f"SELECT {names} FROM ({urls.ORACLE})", pages=f"{SF}/pages.parquet").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in urls.op4_url_filter(spark, SF).select(*names.split(", ")).collect())


def test_neighbours_equal_all_pairs(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        wanted = oracle(f"SELECT query_id, rank, vec_id, score FROM ({ann.ORACLE})", embeddings=f"{sf}/embeddings.parquet").fetchall()
        got = sorted(map(tuple, ann.op7_nearest_neighbours(spark, sf).collect()))
        found = {r[::2] for r in got} & {r[::2] for r in wanted}
        assert len(got) == len(wanted) and len(found) >= 0.9 * len(wanted)
        assert got == sorted(wanted)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    rows = [
        (20, [1.0, 0.0]), (40, [0.0, 2.0]), (60, None), (80, [0.0, 0.0]), (100, [math.nan, 1.0]), (120, [1.0, None]), (140, [math.inf, 1.0]),
        (160, []), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1e200, 1e200]), (5, [3.0]), (180, [2.0]), (20, [1.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, norm double")
    index = ann.build_index(vectors)
    got = sorted(map(tuple, ann.search(index, index.where("vec_id % 20 = 0")).collect()))
    assert got == [
        (20, 1, 4, 1e200), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 40, 0.0), (20, 5, 3, -1.0),
        (40, 1, 4, 2e200), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 3, 0.0), (40, 5, 20, 0.0), (40, 6, 20, 0.0), (180, 1, 5, 6.0),
    ]
    assert ann.search(index.limit(0), index.limit(0)).count() == 0


def test_estimates_stay_within_their_bounds():
    random = ann.np.random.default_rng(1)
    vectors, queries = random.standard_normal((3000, 64)) * random.uniform(0.1, 9, (3000, 1)), random.standard_normal((50, 64))
    guess, error = ann.estimate(queries, *ann.encode(vectors))
    assert (abs(guess - queries @ vectors.T) <= error).mean() > 0.95


@pytest.mark.parametrize("source", ["table", "edges"])
def test_shards_are_near_equal_and_gapless(spark, source):
    rows = [(1, None, 3), (1, None, 3), (None, "é" * 10, 4), (None, "x", 4), (5, "", 1), (6, "a" * 100_000, 1)]
    edges = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if source == "table" else edges
    placed, slot_map = sharding.shard_documents(docs)
    got, texts = placed.collect(), docs.select("doc_id", "text").collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, crc(t)) for i, t in texts)
    places, load = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert 0 <= r.shard < sharding.SHARDS
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if source == "table":
        assert max(load.values()) - min(load.values()) <= max(r.size for r in got) and max(load.values()) < 1.05 * sum(load.values()) / 24
    assert {r.version for r in slot_map.select("version").distinct().collect()} == {0, 1}
    assert sharding.shard_documents(docs.limit(0))[0].count() == 0


def test_a_drifted_map_is_edited_by_few_moves():
    sizes = {s: 1000 + s % 97 for s in range(4096)}
    before = sharding.balanced(sharding.uniform(), sizes)
    drifted = {s: b * (2 if before[s] == 3 else 1) for s, b in sizes.items()}
    after = sharding.rebalanced(before, drifted)
    load = collections.Counter()
    for s, b in drifted.items():
        load[after[s]] += b
    assert max(load.values()) - min(load.values()) <= 2 * max(drifted.values())
    moved = [s for s in before if after[s] != before[s]]
    assert 0 < len(moved) < 200 and all(before[s] == 3 for s in moved)
    assert sharding.rebalanced({}, {}) == {} and sharding.rebalanced(before, {}) == before


def test_a_new_shard_takes_slots_only_into_itself():
    sizes = {s: 1000 + s % 97 for s in range(0, 4096, 2)}
    before = sharding.balanced(sharding.uniform(), sizes)
    after = sharding.grown(before, sizes, 24)
    assert all(after[s] in (before[s], 24) for s in before)
    load = collections.Counter()
    for s, b in sizes.items():
        load[after[s]] += b
    assert 0.9 < load[24] / (sum(sizes.values()) / 25) <= 1
