"""Dropping exact duplicates decides on ids and hashes: texts stay where they lie."""

import random

from framelake.llm import exact_dedup

from test_dedup import documents, fold


def shuffled(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_of_duplicates_are_not_shuffled(spark):
    rnd = random.Random(2)
    base = [rnd.randbytes(1250).hex() for _ in range(1500)]
    texts = [*base, *(t.upper() if k % 2 else t for k, t in enumerate(base)), *[base[0]] * 300]
    order = rnd.sample(range(10**6), len(texts))
    docs = documents(spark, texts, order)
    last = {}
    for i, t in zip(order, texts):
        last[fold(t)] = max(i, last.get(fold(t), -1))
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        before = shuffled(spark)
        left = [r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs, filter_bits=1 << 12).collect()]
    finally:
        spark.conf.set(name, was)
    assert sorted(left) == sorted(last.values())
    assert shuffled(spark) - before < sum(map(len, texts)) / 4


def test_ids_that_stay_in_one_group_and_go_in_another(spark, monkeypatch):
    """Ids of few values repeat over groups, and the filters are too small to be of use."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(12)]), f"{'same' * 80} {rnd.randrange(30)}") for _ in range(300)]
    for bits in (64, 1 << 20):
        left = exact_dedup.drop_exact_duplicates(documents(spark, [t for _, t in rows], [i for i, _ in rows]), filter_bits=bits)
        best = {}
        for i, t in rows:
            best[t] = max((-1 if i is None else i), best.get(t, -1))
        assert sorted((r["text"], r["doc_id"]) for r in left.collect()) == sorted((t, None if i < 0 else i) for t, i in best.items())
