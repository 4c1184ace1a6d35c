"""Exact and near duplicates against brute force, and their edge cases."""

import random

import pytest
from framelake.llm import exact_dedup, near_dedup, queries
from framelake.llm.common import KeyFilter, materialize, shared_dir, shingles_of, without_ids
from pyspark.sql import functions as F

from conftest import SMALL

SCHEMA = "doc_id long, text string, keep long, `full` string, n int"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in zip(ids, texts)], SCHEMA)


def fold(t):
    return (t or "").translate(str.maketrans(UP, LOW))


def words(t):
    return fold(t).encode().split()


def shingle_set(t, n):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, n, percent):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rnd, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


EDGES = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "É a", "é a", "x" * 300_000, "long " * 60_000, "a b c d", "a b c d", "A\x0bb c\td", "\u00a0a b c d"]


def test_near_query_matches_sql(spark, duck, same):
    same(queries.op1_minhash_near_dedup(spark, SMALL), duck, queries.ORACLES["op1_minhash_near_dedup"])


def test_exact_query_matches_sql(spark, duck, same):
    same(queries.op3_exact_dedup(spark, SMALL), duck, queries.ORACLES["op3_exact_dedup"])


def test_exact_edges(spark):
    got = exact_dedup.exact_duplicates(documents(spark, EDGES)).collect()
    groups = {}
    for i, t in enumerate(EDGES):
        groups.setdefault(fold(t), []).append(i)
    for r in got:
        g = groups[fold(EDGES[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
    left = exact_dedup.drop_exact_duplicates(documents(spark, EDGES))
    assert left.columns == ["doc_id", "text", "keep", "full", "n"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(g) for g in groups.values())


def test_exact_null_and_repeated_ids(spark):
    d = documents(spark, ["a", "a", "b", "b", "c", "b", "d", "d"], [None, 1, 2, 2, None, 1, None, None])
    got = exact_dedup.exact_duplicates(d).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == sorted([
        ("1", "1", 2, True), ("None", "1", 2, False), ("2", "2", 3, True), ("2", "2", 3, False), ("1", "2", 3, False), ("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, False)])
    left = exact_dedup.drop_exact_duplicates(d)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "a"), ("2", "b"), ("None", "c"), ("None", "d")]


def test_exact_rows_that_repeat_id_and_text_are_spread_out_again(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPREAD", 7)
    got = exact_dedup.exact_duplicates(documents(spark, ["a"] * 50 + ["b"], [3] * 50 + [4]), extra={"x": F.lit(1)}).collect()
    assert len(got) == 51 and sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got if r["doc_id"] == 3} == {50}


CLASHING = "doc_id long, text string, full string, keep string, twins string, `__full` string, gone map<string,int>, gone_ int, fp string, rep string"


def test_columns_of_any_name_pass_through(spark):
    rows = [(k, t, f"f{k}", "k", "t", "u", {"a": k}, k, "p", "r") for k, t in enumerate(["a", "A", "b", "c", "c"])]
    d = spark.createDataFrame(rows, CLASHING)
    left = exact_dedup.drop_exact_duplicates(d)
    assert left.columns == d.columns and sorted((tuple(r) for r in left.collect()), key=lambda r: r[0]) == [tuple(rows[k]) for k in (1, 2, 4)]
    left = without_ids(d, "doc_id", d.filter("doc_id < 2").select("doc_id"))
    assert left.columns == d.columns and [tuple(r) for r in left.orderBy("doc_id").collect()] == [tuple(r) for r in rows[2:]]
    assert near_dedup.near_duplicates(d).count() == 5


def test_exact_needs_no_luck_in_its_filters(spark):
    texts = [f"text {k % 40} {'same' * 90} {k % 3}" for k in range(120)]
    a = sorted(map(tuple, exact_dedup.exact_duplicates(documents(spark, texts), filter_bits=64).collect()))
    assert a == sorted(map(tuple, exact_dedup.exact_duplicates(documents(spark, texts)).collect()))


@pytest.mark.parametrize("shingle_words", [4, 5])
def test_near_equals_brute_force(spark, shingle_words):
    rnd = random.Random(3)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [*EDGES, *(text(60) for _ in range(40)), *family(rnd, text(120), 60, 6), *family(rnd, text(40), 30, 2), *[text(50)] * 25, *family(rnd, text(9), 12, 1)]
    rnd.shuffle(texts)
    ids = rnd.sample(range(10_000), len(texts))
    expected = components(dict(zip(ids, texts)), shingle_words, 80)
    got = near_dedup.near_duplicates(documents(spark, texts, ids), shingle_words=shingle_words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_crowd_is_not_cut(spark):
    """Far more members than a region pairs completely, each linked with the base only by chance of its edits."""
    rnd = random.Random(8)
    base = " ".join(f"b{k}" for k in range(150))
    texts = [base, *family(rnd, base, 400, 8)]
    expected = components(dict(enumerate(texts)), 4, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts), shingle_words=4).collect()}
    assert not [i for i in got if got[i] != expected[i][1]]


def test_near_does_not_depend_on_partitions(spark):
    rnd = random.Random(4)
    base = " ".join(f"b{k}" for k in range(60))
    texts = [*family(rnd, base, 120, 10), *family(rnd, " ".join(f"c{k}" for k in range(40)), 40, 6)]
    expected = {i: c for i, (_, c) in components(dict(enumerate(texts)), 5, 80).items()}
    d = documents(spark, texts)
    for parts, rows in ((1, 10_000), (13, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        try:
            got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d.repartition(parts)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == expected


def test_near_candidates_find_all_pairs(spark):
    """Recall of pairs, each a small family of its own at similarities from the threshold up."""
    rnd = random.Random(6)
    texts, linked = [], 0
    for f in range(300):
        w = [f"f{f}_{k}" for k in range(rnd.randrange(20, 120))]
        other = list(w)
        for k in sorted(rnd.sample(range(len(w)), max(1, len(w) // 55))):
            other[k] = "x"
        texts += [" ".join(w), " ".join(other)]
        a, b = shingle_set(texts[-2], 5), shingle_set(texts[-1], 5)
        linked += 100 * len(a & b) >= 80 * len(a | b)
    got = [r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()]
    found = sum(got[k] == got[k + 1] for k in range(0, len(got), 2))
    print(f"pair recall {found / linked:.4f} of {linked}")
    assert linked > 100 and found == linked


def test_near_null_repeated_and_no_rows(spark):
    t = "a b c d e f g h"
    got = near_dedup.near_duplicates(documents(spark, [t, t, t, None, "z"], [None, 4, 4, 9, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("4", "4", True), ("4", "4", True), ("9", "9", True), ("None", "None", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(documents(spark, [])).count() == 0


def test_connected_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "u long, v long")
    got = dict(map(tuple, near_dedup.connected(links).collect()))
    assert got == {**{k: 0 for k in range(1, 31)}, 51: 50}


def test_shingle_hashes_are_sets_of_words():
    texts = ["A b  c\td E", "a B c d e", "a b c", "", "x y z w x y z w x", "ß é"]
    got = shingles_of([t.encode() for t in texts], 4)
    assert [len(s) for s in got] == [len(shingle_set(t, 4)) for t in texts]
    assert (got[0] == got[1]).all() and not set(got[0]) & set(got[2])


def test_key_filter_has_no_misses(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    hits = {r["k"] for r in spark.range(3000).withColumnRenamed("id", "k").filter(KeyFilter(keys, ["k"], 1 << 14).hit("k")).collect()}
    assert set(range(0, 3000, 3)) <= hits and len(hits) < 2000
    left = without_ids(spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "doc_id long, __x long"), "doc_id", spark.createDataFrame([(2,), (None,)], "g long"))
    assert sorted(r["__x"] for r in left.collect()) == [5, 7]


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert df.count() == 3 and shared_dir(spark) in df.inputFiles()[0]
