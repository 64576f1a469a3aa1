"""The registered queries on the smallest tables, against brute force over the whole table."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tapewright.llm import htmltext, packing, rollups
from tapewright.llm.oracles import OP4
from tapewright.llm.queries import QUERIES
from tapewright.llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_substring_query(spark, docs):
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        d["words"] = (d["text"] or "").encode().split()
        for k in range(len(d["words"]) - 49):
            first.setdefault(hash(b" ".join(d["words"][k : k + 50])), d["doc_id"])
    got = {r.doc_id: r for r in QUERIES["op3_superkmer_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        gone = np.zeros(len(d["words"]), bool)
        for k in range(len(d["words"]) - 49):
            if first[hash(b" ".join(d["words"][k : k + 50]))] < d["doc_id"]:
                gone[k : k + 50] = True
        kept = b" ".join(w for w, g in zip(d["words"], gone, strict=True) if not g)
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(gone), gone.sum(), hashlib.sha256(kept).hexdigest())


def test_suffix_query(spark, docs):
    seen = {}
    for d in docs:
        b = (d["text"] or "").encode()
        for k in range(len(b) - 199):
            h = hash(b[k : k + 200])
            seen[h] = seen.get(h, 0) + 1
    got = {r.doc_id: r for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    for d in docs:
        b = (d["text"] or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                edge[k] += 1
                edge[k + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_near_dedup_query(spark, docs):
    ids, sets = [d["doc_id"] for d in docs], {}
    for d in docs:
        w = (d["text"] or "").encode().split()
        sets[d["doc_id"]] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)}, tuple(w))
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            (x, u), (y, v) = sets[a], sets[b]
            if a < b and u and v and (u == v or (x and y and 10 * len(x & y) >= 8 * len(x | y))):
                label[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_dedup"](spark, SF).collect()}
    assert got == {i: top(i) for i in ids}


def test_quality_query_and_sql(spark, tmp_path):
    duck = duckdb.connect()
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(i, good if i % 9 else "a b c", "en", ("bad" if i % 3 else "ok") if i < 60 else None, 1) for i in range(90)]
    rows = [(i, "too short" if s == "bad" and i % 7 else t, g, s, n) for i, t, g, s, n in rows]
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/sf/documents.parquet/*.parquet')")
    want, got = duck.execute(OP4).df(), QUERIES["op4_host_quality"](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert want["host_rejected"].any() and not want["host_rejected"].all()
    assert got[cols].sort_values("doc_id").values.tolist() == want[cols].sort_values("doc_id").values.tolist()


def test_rollup_query(spark, docs):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    toxic, quality = {}, {}
    for r in labels:
        toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"] or 0)
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], 1), r["quality"] if r["quality"] is not None else 1)
    encode, want = encoder(default_path()).encode, {}
    for d in docs:
        n = len(encode(d["text"])) if d["text"] else 0
        words, i = len((d["text"] or "").encode().split()), d["doc_id"]
        events = [("byte_bpe_50k", 1, n)]
        if i in toxic and toxic[i] == 1:
            events.append(("byte_bpe_50k", -1, n))
        elif i in toxic and quality[i] == 0:
            events += [("byte_bpe_50k", -1, n), ("words", 1, words)]
        for version, sign, k in events:
            x = want.setdefault((d["source"], d["lang"], version), [0, 0])
            x[0], x[1] = x[0] + sign, x[1] + sign * k
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in QUERIES["op2_token_rollups"](spark, SF).collect()}
    assert got == want


def test_ledger_survives_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 7), (None, "de", 1)], "source string, lang string, n_tokens long")
    whole = {("s", "en"): (4, 24), (None, "de"): (2, 2)}
    for stop in range(4):
        ledger = rollups.Ledger(spark, f"file://{tmp_path}/l{stop}")
        assert ledger.totals().count() == 0 and ledger.commit("one", rollups.inserts(rows, "v"))
        write, calls = ledger._write, []

        def broken(df, part, write=write, calls=calls, stop=stop):
            if len(calls) == stop:
                raise OSError("lost")
            calls.append(part)
            write(df, part)

        ledger._write = broken
        try:
            ledger.commit("two", rollups.inserts(rows, "v"))
        except OSError:
            pass
        again = rollups.Ledger(spark, f"file://{tmp_path}/l{stop}")
        assert again.commit("two", rollups.inserts(rows, "v")) == (stop < 2)
        assert not again.commit("one", rollups.inserts(rows, "v")) and again.version() == 2
        assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in again.totals().collect()} == whole


def test_other_queries_return_every_row(spark, docs):
    ids = sorted(d["doc_id"] for d in docs)
    langs = QUERIES["op1_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in langs) == ids and all(0 <= r.score <= 1 for r in langs)
    mixed = QUERIES["op7_mix_sources"](spark, SF).collect()
    assert sorted(r.doc_id for r in mixed) == ids and all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert all(r.size == len((d["text"] or "").encode().split()) for r, d in zip(sorted(mixed, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d["doc_id"]), strict=True))
    packed = QUERIES["op6_pattern_packing"](spark, SF).collect()
    assert {r.doc_id for r in packed} == set(ids)
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(a + n == b for x in fill.values() for (a, n), (b, _) in zip(sorted(x), [*sorted(x)[1:], (sum(n for _, n in x), 0)], strict=True))


def test_broken_pages_take_time_in_proportion():
    for page in ("<a " * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<nav>x" * 50_000, "<table>" + "<div>" * 50_000, '<a "> "' * 50_000, "<![CDATA[" * 50_000, "<script>" * 50_000):
        htmltext.page_lines(page)
    a, b = [str(i * 7 % 4999) for i in range(6000)], [str(i * 11 % 4993) for i in range(6000)]
    assert len(htmltext.shared_lines(a, b)) == 6000


def test_patterns_at_any_capacity():
    r = np.random.default_rng(1)
    for capacity in (1000, 2000, 2048, 100, 7):
        lengths, n = np.unique(r.integers(1, capacity + 1, 3000), return_counts=True)
        rows, n_sequences = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)), capacity)
        fill = np.zeros(n_sequences, int)
        for length, _, count, first, offset in rows:
            assert (fill[first : first + count] == offset).all()
            fill[first : first + count] += length
        assert fill.max() <= capacity and fill.sum() == (lengths * n).sum() and n_sequences <= 1.05 * fill.sum() / capacity + 2
