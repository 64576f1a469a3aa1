"""Groups of near copies that link with few others, and texts under one id."""

import random

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import probminhash
from tapewright.llm.components import components


def test_common_counts(spark):
    r = random.Random(4)
    sets = {i: sorted(r.sample(range(2**40, 2**40 + 600), 90)) for i in range(12)}
    df = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "node long, set binary").repartition(3)
    got = {x.node: x for x in probminhash.common_counts(df, 12 * 90).collect()}
    for i, s in sets.items():
        common = [h for h in s if any(h in t for j, t in sets.items() if j != i)]
        assert got[i].common == len(common) == sum(got[i].parts)
        assert got[i].parts[3] == sum(h % probminhash.PARTS == 3 for h in common)


def test_group_with_many_open_pairs(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for i in range(160):
        words = list(base)
        for k in r.sample(range(150), i % 9):
            words[k] = f"x{r.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in docs}
    # the same text under one id twice, and another text under an id that has one
    docs += [(3, docs[3][1]), (500, " ".join(f"y{k}" for k in range(60))), (500, " ".join(f"z{k}" for k in range(60))), (501, " ".join(f"z{k}" for k in range(60)))]
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    rows = probminhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    got = {x.id: x.class_id for x in rows if x.id < 500}
    assert got == {i: want.get(i, i) for i in sets}
    assert sorted((x.id, x.class_id) for x in rows if x.id >= 500) == [(500, 500), (500, 500), (501, 500)]
    kept = probminhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert kept.where(F.col("doc_id") == 500).count() == 2 and kept.where(F.col("doc_id") == 501).count() == 0
