"""Language ID, mixing, top-k, packing and the pipeline: held-out accuracy, brute force and invariants."""

import math
import zlib

import corpus_pipeline
import numpy as np
import pytest
from framelake.llm import language_id, mixing, packing, queries, topk
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"


def docs(spark, d=SMALL):
    return spark.read.parquet(f"{d}/documents.parquet")


def evidence(df):
    return df.select("doc_id", "text", F.lit("h.example.com").alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("named"))


def test_language_held_out_accuracy(spark):
    all_ = docs(spark, MEDIUM)
    model = language_id.fit(all_.filter("doc_id % 2 = 0"))
    got = language_id.identify(evidence(all_.filter("doc_id % 2 = 1")), model, ["doc_id"]).join(all_.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.98 and got["kept"].mean() > 0.995


def test_language_evidence_decides_where_text_does_not(spark):
    """How far a declaration can be trusted is learned from rows with clear texts; it then decides short ambiguous ones."""
    model = language_id.fit(docs(spark))
    schema = "doc_id long, text string, host string, declared string, named string"
    clear = docs(spark).filter("lang in ('fr', 'es')").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.concat("lang", F.lit(".example.com")).alias("host"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("named"))
    rows = [(k, "de la", f"{x}.example.com", x, None) for k, x in enumerate(("es", "fr"))] + [(99, "12345 !!", None, "fr", "fr"), (100, None, None, None, None), (101, "привет мир как дела сегодня", "h", None, None)]
    got = {r["doc_id"]: r for r in language_id.identify(clear.unionByName(spark.createDataFrame(rows, schema)), model, ["doc_id"]).collect()}
    assert not got[99]["kept"] and not got[100]["kept"] and not got[101]["kept"] and got[0]["kept"]
    assert (got[0]["language"], got[1]["language"]) == ("es", "fr")


def fused(rows, model):
    """The posterior of every row by the definitions, one row at a time."""
    spots = [*model.languages, "und"]
    lls, posts = [], []
    for _, text, *_ in rows:
        raw = (text or "").encode()
        clean = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw + b"\n\n\n")
        grams = [((clean[k] * 0x9E3779B1 + clean[k + 1] * 0x85EBCA6B + clean[k + 2] * 0xC2B2AE35) % 2**32) >> 19 for k in range(len(clean) - 2)]
        ll = model.logp[grams].sum(0) * language_id.TEMPER
        lls.append(ll - ll.max())
        p = np.exp(lls[-1])
        posts.append(p / p.sum() if clean.strip() else None)
    none = np.zeros(len(spots))
    known = lambda c: c if c in model.languages else "" if not c else "?"
    host, said = [(r[2] or "").lower() for r in rows], [[known(r[c]) for r in rows] for c in (3, 4)]
    level = [host, [".".join(h.split(".")[-2:]) for h in host], [h.split(".")[-1] for h in host]]
    mass = lambda keys, key: sum((p for k, p in zip(keys, posts) if k == key and p is not None), none)
    whole = mass([0] * len(rows), 0) + 1
    out = []
    for i, row in enumerate(rows):
        own = none if posts[i] is None else posts[i]
        prior = whole / whole.sum()
        for keys in level[::-1]:
            m = mass(keys, keys[i])
            prior = (np.maximum(m - own, 0) + language_id.STRENGTH * prior) / (max(m.sum() - (posts[i] is not None), 0) + language_id.STRENGTH)
        s = lls[i] + np.log(prior)
        for values in said:
            if values[i]:
                by = {v: mass(values, v) for v in set(values)}
                s = s + np.log((by[values[i]] + 1 / (len(by) + 1)) / (sum(by.values()) + 1))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        best = int(np.argmax(s))
        out.append((spots[best] if posts[i] is not None else "und", round(p[best], 6) if posts[i] is not None else 0.0))
    return out


def test_language_fusion_equals_brute_force(spark):
    model = language_id.fit(docs(spark))
    texts = [r["text"] for r in docs(spark).orderBy("doc_id").limit(40).collect()]
    rnd = np.random.default_rng(1)
    hosts = ["a.example.de", "b.example.de", "x.fr", "fr", "", None, "Z.example.com"]
    rows = [(k, texts[k % 40][: rnd.integers(3, 60)], hosts[k % 7], [None, "fr", "DE-at", "xx", ""][k % 5], [None, "de", "en"][k % 3]) for k in range(90)]
    rows += [(90, None, "x.fr", "fr", "fr"), (91, "12 34", None, None, None), (None, texts[0][:50], "x.fr", "en", None), (5, rows[5][1], *rows[5][2:]), (92, texts[1] * 40, "long.de", None, "de")]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, host string, declared string, named string, language string, post double")
    got = language_id.identify(df, model, ["doc_id"]).collect()
    lower = [(r[0], r[1], r[2], r[3] and r[3].lower().split("-")[0], r[4]) for r in rows]
    expected = sorted((str(r[0]), lang, conf) for r, (lang, conf) in zip(rows, fused(lower, model)))
    mine = sorted((str(r["doc_id"]), r["language"], r["confidence"]) for r in got)
    assert [m[:2] for m in mine] == [e[:2] for e in expected]
    assert max(abs(m[2] - e[2]) for m, e in zip(mine, expected)) < 2e-6


def test_language_without_labels_or_rows(spark):
    empty = docs(spark).limit(0)
    model = language_id.fit(empty)
    assert model.languages == [] and language_id.identify(evidence(empty), model, ["doc_id"]).count() == 0
    assert language_id.identify(evidence(docs(spark).limit(3)), model, ["doc_id"]).filter("kept").count() == 0


def test_language_beyond_the_broadcast_limit(spark):
    model = language_id.fit(docs(spark))
    a, b = (sorted(map(tuple, language_id.identify(evidence(docs(spark)), model, ["doc_id"], broadcast_hosts=n).collect())) for n in (0, 10))
    assert a == b


def test_mixing_takes_rows_as_often_as_their_copies_say(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    d = docs(spark).withColumns({"__copies": F.lit(None).cast("int"), "rate": F.array(F.lit("x")), "u": F.struct("lang")})
    odd = spark.createDataFrame([(None, None), (9001, ""), (9002, "!!! ..."), (9002, "!!! ..."), (9003, "word " * 60_000)], "doc_id long, text string")
    d = d.unionByName(odd, allowMissingColumns=True)
    times = {r["doc_id"]: r["n"] for r in mixing.mix(d, labels).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    got = mixing.take(d, labels)
    assert got.schema == d.schema
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == times
    texts = lambda df: {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
    assert texts(got) <= texts(d) and times[None] == times[9001] == 1 and times[9002] == 2


def test_mixing_matches_targets_and_keeps_good_documents(spark):
    m = mixing.mix(docs(spark, MEDIUM), spark.read.parquet(f"{MEDIUM}/labels.parquet")).toPandas()
    p = m[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert len(m) == 1000 and np.allclose(p.sum(1), 1) and (m["rate"] >= 0).all()
    n = m["n_tokens"].to_numpy()
    before, after = (n @ p) / n.sum(), ((m["rate"] * n) @ p) / (m["rate"] * n).sum()
    target = np.array(mixing.TARGETS)
    assert np.abs(after - target).max() < 1e-3 < np.abs(before - target).max()
    assert (m["rate"][p.argmax(1) == 0] > 0.5).mean() > 0.9
    assert np.abs(m["copies"].mean() - m["rate"].mean()) < 0.05


def test_classifier_held_out(spark):
    d, labels = docs(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = mixing.fit(d, labels.filter("doc_id % 2 = 0"))
    held = d.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("text", "quality", "toxic").toPandas()
    p, _ = model.posteriors([t.encode() for t in held["text"]])
    truth = np.where(held["toxic"] == 1, 2, np.where(held["quality"] == 0, 1, 0))
    assert (p.argmax(1) == truth).mean() > 0.85
    assert p[truth == 2][:, 2].mean() > 4 * p[truth == 0][:, 2].mean()


def test_mixing_edges(spark):
    schema = "doc_id long, text string, lang string, __copies2 long, rate double"
    d = spark.createDataFrame([(1, None, "a", 1, 0.5), (2, "", "b", 2, 0.5), (None, "some words", None, 3, 0.1), (2, "more words", "c", 4, 0.0)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = mixing.mix(d, none).collect()
    assert len(m) == 4 and all(r["copies"] == 1 for r in m if r["n_tokens"] == 0)
    taken = mixing.take(d, none)
    assert taken.columns == d.columns and taken.count() >= 2
    assert mixing.mix(d.limit(0), none).count() == 0 and mixing.take(d.limit(0), none).count() == 0


def least_squares(a, t, metric):
    """min |metric^(1/2) (a r - t)| over r >= 0 by trying which rates are 0: an active set method on small tables."""
    w = np.linalg.cholesky(metric).T
    a, t = w @ a, w @ t
    r, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        slope = a.T @ (t - a @ r)
        if not (~free & (slope > 1e-9)).any():
            return r
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            s = np.zeros(len(r))
            s[free] = np.linalg.lstsq(a[:, free], t, rcond=None)[0]
            if (s[free] > 0).all():
                r = s
                break
            low = free & (s <= 0)
            r = r + (s - r) * np.min(r[low] / np.maximum(r[low] - s[low], 1e-300))
            free &= r > 1e-12
            r[~free] = 0


@pytest.mark.parametrize("targets, feasible", [((0.6, 0.3, 0.1), True), ((0.86, 0.08, 0.06), True), ((0.9, 0.1, 0.0), False), ((0.02, 0.08, 0.9), False), ((0.34, 0.33, 0.33), True)])
def test_descent_equals_least_squares(targets, feasible):
    rnd = np.random.default_rng(1)
    p, n = rnd.dirichlet([4, 1, 0.6], 60) * 0.9 + 0.1 / 3, rnd.integers(1, 100, 60).astype(float)

    def totals(steps):
        r = mixing.rates(p, steps)
        return (r * n) @ p, (p * (n * (r > 0))[:, None]).T @ p

    import warnings

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        steps = mixing.descend(totals, targets, max_steps=5000, tolerance=1e-7)
    assert bool(said) != feasible
    have, gram = totals([])
    goal = have[0] / targets[0] * np.array(targets)
    metric = np.linalg.inv(gram / goal.sum() + 1e-6 * np.eye(3))
    loss = lambda r: (d := ((r * n) @ p - goal) / goal.sum()) @ metric @ d
    best = least_squares((p * n[:, None]).T / goal.sum(), goal / goal.sum(), metric)
    r = mixing.rates(p, steps)
    assert (r >= 0).all() and loss(r) <= loss(best) * 1.01 + 1e-9


def test_top_k_matches_sql(spark, duck, same):
    same(queries.op7_exact_top_k(spark, SMALL), duck, queries.ORACLES["op7_exact_top_k"])


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.5, None]), (4, [float("nan"), 1.0]), (5, None), (6, [-1.0, 2.0]), (7, [float("inf"), 0.0]), (8, [0.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3, candidates=2, queries=1).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 8, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_stops_early_where_few_components_decide(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 6)) * np.array([1, 0.3, 0.05, 0.02, 0.01, 0.01])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, with_scored=True).toPandas()
    share = got.groupby("query_id")["scored"].first().mean() / len(x)
    print(f"share of rows scored {share:.3f}")
    assert share < 0.5
    whole = np.floor(256 * x)
    for q, rows in got.groupby("query_id"):
        best = sorted(((-int(s), k) for k, s in enumerate(whole @ whole[q]) if k != q))[:5]
        assert [(-r.score, r.vec_id) for r in rows.sort_values("rank").itertuples()] == best


def test_top_k_repeated_ids(spark):
    rows = [(0, [1.0]), (7, [0.5]), (7, [0.5]), (7, [0.25]), (None, [9.0]), (0, [0.75])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=5).orderBy("query_id", "rank").collect()
    assert {r["vec_id"] for r in got} == {7} and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(0, 10**6))
def test_threshold_algorithm_is_exact(n, d, seed):
    rnd = np.random.default_rng(seed)
    x, q, ids = rnd.integers(-4, 5, (n, d)).astype(float), rnd.integers(-3, 4, d).astype(float), rnd.permutation(n)
    lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
    i, s, scored = topk.best_in_block(x, ids, lists, q, 0, 5)
    assert len(i) <= scored <= n
    expected = sorted(((-int(v), int(k)) for k, v in zip(ids, x @ q) if k != 0))[:5]
    assert [(-int(b), int(a)) for a, b in zip(i, s)] == expected


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_places_everything(counts):
    patterns = packing.plan(counts, 64)
    used = {}
    for n, items in patterns:
        assert n > 0 and sum(x * t for x, t in items) <= 64
        for x, t in items:
            used[x] = used.get(x, 0) + n * t
    assert used == counts
    need = sum(x * n for x, n in counts.items())
    # pieces over half a sequence can't share one
    least = max(math.ceil(need / 64), sum(n for x, n in counts.items() if x > 32))
    assert least <= sum(n for n, _ in patterns) <= least * 1.7 + 1


def fewest(items, capacity):
    """The least number of sequences by trying every place for every item, the longest first."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(items):
            best = len(gaps)
            return
        for g in sorted(set(gaps)):
            if g >= items[k]:
                rest = list(gaps)
                rest.remove(g)
                place(k + 1, [*rest, g - items[k]])
        place(k + 1, [*gaps, capacity - items[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_plan_is_near_the_fewest_sequences(items):
    counts = {x: items.count(x) for x in set(items)}
    n, least = sum(n for n, _ in packing.plan(counts, 12)), fewest(items, 12)
    assert least <= n <= least + (least + 2) // 3


def test_plan_is_the_fewest_where_all_fill_up():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        items = [x for _ in range(rnd.integers(2, 5)) for x in np.diff([0, *sorted(rnd.choice(range(1, 40), rnd.integers(1, 3), replace=False)), 40])]
        counts = {int(x): items.count(x) for x in set(items)}
        assert sum(n for n, _ in packing.plan(counts, 40)) <= sum(items) // 40 + 1


def test_plan_finds_exact_complements():
    assert sum(n for n, _ in packing.plan({60: 10, 4: 10, 30: 5, 20: 5, 14: 5, 64: 3}, 64)) == 18


def test_packing_query(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    got = queries.op10_best_fit_packing(spark, SMALL).toPandas().sort_values(["doc_id", "piece"])
    for doc, rows in got.groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        assert rows["piece"].tolist() == list(range(len(rows))) and rows["start"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() == len(ids)
        assert len(rows) == -(-len(ids) // 2048) and (rows["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(rows["start"], rows["length"])] == rows["ids_crc32"].tolist()
    assert set(got["doc_id"]) == set(texts)
    s = got.sort_values(["sequence_id", "offset"])
    for _, rows in s.groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) * 1.02 + 1


def test_fast_and_plain_tokenizers_agree():
    import public_tokenizers as p

    fast = packing.encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    plain = packing.encoder(p.path("byte_bpe_50k.json"), None, None)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(max_codepoint=0x24F) | st.sampled_from(" \n\t\x0b\x1c\x85\xa0\u2028'’😀日") | st.sampled_from("st'l "), max_size=80))
    def check(text):
        assert fast(text).tolist() == plain(text).tolist()

    check()
    for text in ("<|endoftext|> x", "x" * 3000, " " * 3000 + "y", "It's we'll  DON'T", "ÄÖ ß çñ"):
        assert fast(text).tolist() == plain(text).tolist()


def test_packing_edges(spark):
    d = spark.createDataFrame([(1, None, 5), (1, None, 6), (None, "a b", 7), (2, "word " * 9000, 8)], "doc_id long, text string, length long")
    got = packing.pack(d, capacity=64, with_ids=True).toPandas()
    assert (got["length"] <= 64).all() and got["length"].sum() == sum(len(i) // 4 for i in got["ids"]) and not got.duplicated(["sequence_id", "offset"]).any()
    assert (got["doc_id"] == 1).sum() == 2
    assert packing.pack(d.limit(0)).count() == 0


def test_pipeline_stages_agree_with_brute_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "source mixing", "best-fit packing"]
    odd = [(9000, "12 34 -- 56", "en", "src1", 11), (9001, "", "en", None, 0), (9002, None, None, "src2", None), (9003, "\u0441\u043b\u043e\u0432\u0430 " * 40, "ru?", "src1", 1)]
    now = docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    now = now.unionByName(spark.createDataFrame(odd, now.schema)).select(*docs(spark).columns)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        rows = now.collect()
        before = {r["doc_id"]: r["text"] for r in rows}
        source, now = now, stage(spark, now, SMALL)
        assert now.columns == docs(spark).columns
        after = [r["doc_id"] for r in now.collect()]
        if k == 0:
            said = fused([(r["doc_id"], r["text"], r["source"], None, None) for r in rows], language_id.fit(source))
            assert sorted(after) == sorted(r["doc_id"] for r, (language, _) in zip(rows, said) if language != "und")
            assert not {9000, 9001, 9002} & set(after) and len(after) >= 0.97 * len(before)
        if k == 1:
            last = {}
            for i, t in before.items():
                key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                last[key] = max(i, last.get(key, i))
            assert sorted(after) == sorted(last.values())
        if k == 2:
            from test_dedup import components

            assert sorted(after) == sorted({c for _, c in components(before, 5, 80).values()})
        if k == 3:
            model = mixing.fit(source, spark.read.parquet(f"{SMALL}/labels.parquet"))
            p, n = model.posteriors([(r["text"] or "").encode() for r in rows])

            def totals(steps, p=p, n=n):
                r = mixing.rates(p, steps)
                return (r * n) @ p, (p * (n * (r > 0))[:, None]).T @ p

            rate = np.where(n == 0, 1.0, mixing.rates(p, mixing.descend(totals, mixing.TARGETS)))
            u = np.array([r["u"] for r in source.select((F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("u")).collect()])
            times = {r["doc_id"]: int(x) for r, x in zip(rows, np.floor(rate + u)) if x}
            assert {i: after.count(i) for i in set(after)} == times
    packed = corpus_pipeline.STAGES[4][1](spark, now, SMALL)
    assert packed.select("doc_id").distinct().count() == len(set(after))


def test_pipeline_stages_take_empty_and_clashing_tables(spark):
    plain = docs(spark)
    more = plain.limit(60).selectExpr("*", "'f' as full", "'k' as keep", "1 as twins", "2 as gone", "map('a', 1) as named", "0.5 as rate", "'p' as post", "3 as component_id", "'h' as host", "array(1) as ll")
    for table in (plain.limit(0), more):
        now = table
        for _, stage in corpus_pipeline.STAGES[:4]:
            now = stage(spark, now, SMALL)
            assert now.columns == table.columns
        assert now.count() <= 70 and (now.count() > 20 or table is not more)
        assert corpus_pipeline.STAGES[4][1](spark, now, SMALL).count() >= now.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_are_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and "pipeline" in entry.queries()
