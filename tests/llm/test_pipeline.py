"""The pipeline's stages on a small corpus, each against a brute-force version of its own input."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tapewright.llm.mixing import BLOCK_WORDS
from tapewright.llm.tokens import default_path, encoder


def text(n, seed):
    r = random.Random(seed)
    return [f"t{r.randint(0, 5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    passage = text(90, 1)
    rows = [(i, " ".join(text(150 + i, 100 + i)), "en", f"s{i % 4}", 1) for i in range(30)]
    rows += [(100 + k, " ".join(text(80, 200 + k) + passage + text(40, 300 + k)), "en", "s1", 1) for k in range(4)]
    edited = rows[3][1].split()
    edited[5] = "edited"
    rows += [(200, rows[2][1], "en", "s0", 1), (201, " ".join(edited), "de", None, 1), (202, "too short", "en", "s2", 1), (203, None, None, "s2", None), (204, " ".join(["again and again we say"] * 40), "en", "s3", 1), (205, " ".join(passage), "en", "s3", 1)]
    sf = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        before = docs.collect()
        made = f(spark, docs, sf)
        made.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        out.append((before, docs.collect(), docs.columns))
    return sf, out


def w(t):
    return (t or "").split()


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mix_sources", "packing"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, c in stages[1][:-1])


def test_quality_stage(stages):
    before, after, _ = stages[1][0]

    def ok(t):
        grams = [tuple(w(t)[k : k + 5]) for k in range(len(w(t)) - 4)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
        return len(w(t)) >= 10 and 100 * len(hit) <= 20 * len(w(t))

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if ok(r.text))


def test_near_duplicate_stage(stages):
    before, after, _ = stages[1][1]
    sets = {r.doc_id: {tuple(w(r.text)[k : k + 5]) for k in range(len(w(r.text)) - 4)} for r in before}
    near = {i for i in sets for j in sets if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert near == {200, 201} and {r.doc_id for r in after} == set(sets) - near


def test_passage_stage(stages):
    before, after, _ = stages[1][2]
    first, want = {}, {}
    for r in sorted(before, key=lambda r: r.doc_id):
        for k in range(len(w(r.text)) - 49):
            first.setdefault(tuple(w(r.text)[k : k + 50]), r.doc_id)
    for r in before:
        gone = {k + d for k in range(len(w(r.text)) - 49) if first[tuple(w(r.text)[k : k + 50])] < r.doc_id for d in range(50)}
        if len(gone) < len(w(r.text)):
            want[r.doc_id] = " ".join(x for k, x in enumerate(w(r.text)) if k not in gone) if gone else r.text
    assert {r.doc_id: r.text for r in after} == want and 205 not in want
    assert all(r.n_chars in (1, len(r.text)) for r in after)


def test_mixing_stage(stages):
    before, after, _ = stages[1][3]
    size, taken = {}, {}
    for rows, d in ((before, size), (after, taken)):
        for r in rows:
            d[r.source] = d.get(r.source, 0) + len(w(r.text))
    assert set(taken) <= set(size) and abs(sum(taken.values()) - sum(size.values())) <= 3 * BLOCK_WORDS * len(size)
    words = {r.doc_id: set(w(r.text)) for r in before}
    assert all(set(w(r.text)) <= words[r.doc_id] for r in after)
    assert max(sum(len(w(x.text)) for x in after if x.doc_id == i) / len(w(r.text)) for i, r in {r.doc_id: r for r in before}.items()) <= 3


def test_packing_stage(stages):
    before, after, _ = stages[1][4]
    encode = encoder(default_path()).encode
    crcs = sorted(zlib.crc32(np.append(encode(r.text), 0).astype("<u4").tobytes()) for r in before if len(encode(r.text)) < 2048)
    assert sorted(r.ids_crc32 for r in after if r.piece == 0 and r.length < 2048) == crcs
    total = sum(len(encode(r.text)) + 1 for r in before)
    assert sum(r.length for r in after) == total and len({r.sequence_id for r in after}) <= -(-total // 2048) + 2


def test_run_applies_the_stages(spark, stages):
    sf, out = stages
    assert corpus_pipeline.run(spark, sf).count() == len(out[-1][1])
