"""Corpus operators against brute force, and on the cases of their docstrings."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import langid, mixing, packing, probminhash, quality, rollups, substring, suffixes
from tapewright.llm.components import components
from tapewright.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


def corpus():
    passage, long = words(120, 1), words(9000, 2)
    texts = [
        " ".join(words(200, 10)), " ".join(words(60, 11) + passage + words(30, 12)), "\n".join([*words(40, 13), " ".join(passage), *words(25, 14)]), " ".join(passage), None, "", " \n\t ", "a b c d e f g h i j k",
        " ".join(long), " ".join(long), " ".join(long[:8990] + words(12, 15)), " ".join(words(200, 10)), "x " * 300, "spam " * 9, "\n".join(["same line here"] * 12), "ü " * 80 + "Ωmega " * 5, " ".join(["eins", "zwei"] * 2), "naïve 日本 text\x0bwith\x0codd\rspaces " * 4,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), None, "old") for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, texts[1], None, "s1", 0, None, None), (None, texts[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def split(text):
    return (text or "").encode().split()


def test_host_quality_counts(spark, docs):
    got = {r.doc_id: r for r in quality.host_quality(docs, carry=["doc_id"]).where("doc_id is not null").collect()}
    assert quality.host_quality(docs).count() == len(corpus()) and "text" in quality.host_quality(docs).columns
    for i, text, *_ in corpus():
        if i is None:
            continue
        w, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)} if len(w) < 2000 else set()
        want = (len(w), len(b"".join(w).decode()), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.host_quality(docs.limit(0)).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, "short" if i < 95 else " ".join(words(60, i)), "bad") for i in range(100)] + [(i, " ".join(words(60, i)), f"good{i % 9}") for i in range(100, 1000)]
    out = quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id", "source"])
    assert out.where("source = 'bad' and kept").count() == 0 and out.where("source <> 'bad' and not kept").count() == 0


def test_substring_dedup_matches_brute_force(spark, docs):
    owner, want = {}, []
    rows = [(i, split(t)) for i, t, *_ in corpus()]
    for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w) - 49):
            owner.setdefault(tuple(w[k : k + 50]), i)
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and owner[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    out = substring.substring_dedup(docs)
    assert dict(out.dtypes)["n_words"] == "bigint"
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=key) == sorted(want, key=key)
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_substring_dedup_splits_hot_buckets(spark, docs, monkeypatch):
    from tapewright.llm import anchors

    plain = sorted(map(str, substring.substring_dedup(docs).select("doc_id", "n_removed", "kept_text").collect()))
    monkeypatch.setattr(anchors, "HOT", 0)
    assert plain == sorted(map(str, substring.substring_dedup(docs).select("doc_id", "n_removed", "kept_text").collect()))


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup_matches_brute_force(spark, docs, monkeypatch, hot):
    from tapewright.llm import anchors

    monkeypatch.setattr(anchors, "HOT", hot)
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[min(k + 200, len(b))] -= 1
        g = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        want.append((i, len(b), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in suffixes.suffix_dedup(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0


def test_deep_shallow_sorting_orders_and_finds_repeats():
    r = random.Random(3)
    body = bytes(r.choice(b"ab") for _ in range(400)) * 3 + bytes(r.choice(b"abc") for _ in range(300))
    text = np.frombuffer(body + bytes(8), np.uint8)
    starts = np.arange(len(body) - 100)
    found = suffixes.repeats_in(text, starts, np.zeros(len(starts), np.int64), 100)
    held = [body[s : s + 100] for s in starts]
    assert found.tolist() == [held.count(h) > 1 for h in held]
    trie = suffixes.BlindTrie(held[0], 0)
    for i in range(1, 500):
        trie.add(held[i], i)
    order = [s for s, _ in trie.leaves()]
    assert order == sorted(set(held[:500]))


def test_repeats_in_windows_that_end_within_eight_bytes():
    r = random.Random(5)
    for window in (5, 20, 27, 33, 200):
        body = bytes(r.choice(b"ab") for _ in range(window)) * 4 + bytes(r.choice(b"abc") for _ in range(4 * window)) + bytes(window)
        starts = np.array([*range(len(body) - window + 1)])
        groups = starts % 2
        found = suffixes.repeats_in(np.frombuffer(body + bytes(8), np.uint8), starts, groups, window)
        held = [(body[s : s + window], g) for s, g in zip(starts, groups, strict=True)]
        assert found.tolist() == [held.count(h) > 1 for h in held], window


def test_runs_match_their_definition():
    from tapewright.llm import anchors

    r = random.Random(6)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (40, 9, 10, 0, 11, 300, 3, 10)]
    units, lengths = anchors.byte_units(b"".join(texts)), np.array([len(t) for t in texts])
    hashes, want, base = anchors.gram_hashes(units, 4), [], 0
    assert hashes.tolist() == anchors.span_hashes(units, np.arange(len(units) - 3), np.arange(4, len(units) + 1)).tolist()
    for number, text in enumerate(texts):
        for at in range(base, base + len(text) - 9):
            place = min(range(at, at + 7), key=lambda p: (int(hashes[p] >> anchors.PLACE_BITS), p))
            if want and want[-1][0] == number and want[-1][3] == place:
                want[-1][2] += 1
            else:
                want.append([number, at, 1, place, int(hashes[place])])
        base += len(text)
    assert [list(map(int, x)) for x in zip(*anchors.runs_of(units, lengths, 10, 4), strict=True)] == want
    assert not len(anchors.runs_of(units[:9], np.array([9]), 10, 4)[0])


def test_spans_of_a_text_cost_no_more_than_their_number(spark):
    """60,000 spans of one text; comparing each two of them took 61 s."""
    import time

    from tapewright.llm import anchors

    n = 60_000
    placed = spark.range(1).select(F.col("id"), F.lit(7).cast("long").alias("mark"), F.lit(1).cast("long").alias("h"), F.lit(2).cast("long").alias("px"), F.lit(3).alias("n"), F.expr(f"transform(sequence(0, {n - 1}), x -> x * 3)").alias("starts"))
    runs = spark.createDataFrame([(1, 2, [(0, 1)])], "h long, px long, runs array<struct<at:int,n:int>>")
    began = time.monotonic()
    (got,) = anchors.lost_spans(placed, runs, 2).collect()
    assert time.monotonic() - began < 15
    assert sorted((s.lo, s.hi) for s in got.spans) == [(3 * k, 3 * k + 2) for k in range(n)]
    lo, hi = (np.array([s[k] for s in got.spans]) for k in (0, 1))
    assert anchors.covered(3 * n, lo, hi).tolist() == [k % 3 < 2 for k in range(3 * n)]


def test_spans_of_batches_with_nulls_and_slices():
    import pyarrow as pa

    from tapewright.llm import anchors

    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    rows = [[{"lo": 1, "hi": 3}], None, [], [{"lo": 2, "hi": 5}, {"lo": 2, "hi": 5}], [{"lo": 0, "hi": 1}]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["spans"])
    for b, want in ((batch, rows), (batch.slice(1), rows[1:]), (batch.slice(3, 1), rows[3:4]), (batch.slice(1, 2), rows[1:3])):
        got = [None if x is None else list(zip(*(e.tolist() for e in x), strict=True)) for x in anchors.spans_of(b)]
        assert got == [[(s["lo"], s["hi"]) for s in w] if w else None for w in want]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_runs_of_hot_buckets_are_split_many_at_a_time(monkeypatch, kind):
    import pyarrow as pa

    from tapewright.llm import anchors

    window, gram, split, calls = 20, 4, anchors.runs_of, []
    r = random.Random(8)
    texts = [(b" \t " if kind == "words" else b"").join(bytes([r.choice(b"abc")]) for _ in range(r.choice((25, 60, 3000)))) for _ in range(120)]
    runs, want = [], []
    for text in texts:
        units = anchors.units_of(text, kind)
        _, first, n, place, h = split(units, np.array([len(units)]), window, gram)
        rows = [(int(a), int(m), int(p - a), int(k), int(a) % 3 > 0) for a, m, p, k in zip(first, n, place, anchors.signed(h), strict=True)]
        runs.append([dict(zip(("start", "n", "place", "h", "hot"), x, strict=True)) for x in rows])
        found, pieces = [], text.split() if kind == "words" else None
        string = lambda a, m: b" ".join(pieces[a : a + m + window - 1]) if pieces else text[a : a + m + window - 1]  # noqa: B023, E731
        for a, m, p, k, hot in rows:
            if not hot:
                found.append((a, m, p, k, string(a, m)))
                continue
            own = np.array([k]).view(np.uint64)
            _, first2, n2, _, h2 = split(units[a : a + m + window - 1], np.array([m + window - 1]), window, gram, without=own)
            found += [(a + int(x), int(y), p - int(x), int(z), string(a + int(x), int(y))) for x, y, z in zip(first2, n2, anchors.signed(anchors.mixed(h2 + own)), strict=True)]
        want.append(sorted(found))
    monkeypatch.setattr(anchors, "runs_of", lambda *x, **y: calls.append(1) or split(*x, **y))
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("h", pa.int64()), ("hot", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(runs, kinds)], ["text", "runs"])
    for b, expected in ((batch, want), (batch.slice(5, 40), want[5:45])):
        got = list(anchors.run_strings(kind, window, gram)(b))
        assert [row for row, _ in got] == list(range(len(expected)))
        assert [sorted((*x[:4], b" ".join(x[4].split()) if kind == "words" else x[4]) for x in found) for _, found in got] == expected
    assert sum(map(len, runs)) > 5_000 and len(calls) < 40


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = (tuple(w), frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    label = {i: i for i, _ in rows}
    changed = True
    ids = sorted(label)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (sets[a][0] and sets[a][0] == sets[b][0]) or (sets[a][1] and sets[b][1] and 10 * len(sets[a][1] & sets[b][1]) >= 8 * len(sets[a][1] | sets[b][1]))]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return label


def test_near_classes_match_brute_force(spark, docs):
    base = words(150, 77)
    near = []
    for k in range(30):  # a chain of edits: ends are less similar than neighbours
        base = list(base)
        base[(k * 5) % 150] = f"new{k}"
        near.append((1000 + k, " ".join(base)))
    rows = [(i, t) for i, t, *_ in corpus() if i is not None] + near
    got = {r.id: r.class_id for r in probminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows).items() if False else list({i: t for i, t in rows}.items()))
    out = probminhash.near_dedup(docs)
    assert out.columns == docs.columns and probminhash.near_classes(docs.limit(0)).count() == 0
    ids = [r.doc_id for r in out.collect()]
    assert len([i for i in ids if i is not None]) == len({brute_classes([(i, t) for i, t, *_ in corpus() if i is not None])[i] for i, *_ in corpus() if i is not None})


def test_near_copies_with_repeated_lines_are_linked(spark):
    rows = []
    for k in range(12):  # 96 shingles; the copy repeats six words thirty times
        text = words(100, 900 + k)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + text[40:46] * 30))]
    got = {r.id: r.class_id for r in probminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(24)} == brute_classes(rows)


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(r.integers(0, 2**60, 300), r.integers(1, 4, 300))}
    b = dict(list(a.items())[:240]) | {int(k): 1.0 for k in r.integers(0, 2**60, 60)}
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    text = np.repeat([0, 1], [len(a), len(b)])
    s = probminhash.signatures(text, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_packing(spark, docs):
    out = packing.pack_documents(docs).collect()
    encode = encoder(default_path()).encode
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    texts = {i: t for i, t, *_ in corpus() if i is not None}
    for i in texts:
        ids = np.append(encode(texts[i] or ""), 0).astype("<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i})
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in pieces) and all(n == 2048 for _, _, n, _ in pieces[1:])
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,mean", [(1, 5.0), (700, 4.0), (20_000, 6.0)])
def test_packing_plan_places_every_piece_once(n, mean):
    r = np.random.default_rng(n)
    lengths = np.minimum(np.exp(r.normal(mean, 1.2, n)).astype(int) + 1, 2048)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    rows, n_sequences = packing.plan(histogram)
    fill, ranks = np.zeros(n_sequences, int), {}
    for length, first, count, sequence, offset in sorted(rows.tolist(), key=lambda x: x[4]):
        assert (fill[sequence : sequence + count] == offset).all()
        fill[sequence : sequence + count] += length
        ranks.setdefault(length, []).append((first, first + count))
    assert fill.max() <= 2048 and n_sequences <= 1.02 * -(-lengths.sum() // 2048) + 2
    for length, spans in ranks.items():
        spans.sort()
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == histogram[length]


def test_token_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    cases = ["", " ", "a  b", "  x\n\n y ", "<|endoftext|> hi", "a<|b", "\x1c a\x85b", "don't I'll\n 12ab", "　x   y", "日本 語\nд ж 🙂", "x" * 5000, *[t for _, t, *_ in corpus() if t]]
    assert all(encoder(default_path()).encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in cases)


def test_targets_fill_caps_in_turn(spark):
    rows = [("sa", "a", 10), ("sb", "b", 1000), ("sc", "c", 1000), ("sd", "d", 0), ("n", None, 500)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "key string, source string, source_size long")).collect()}
    assert got["a"] == 30 and got["d"] == 0 and abs(sum(got.values()) - 2510) < 1e-6
    # b: 2, c: 1, null: 2 of what a leaves; none is at its cap
    assert abs(got["b"] - 2480 * 2 / 5) < 1e-6 and abs(got["c"] - 2480 / 5) < 1e-6 and abs(got[None] - 2480 * 2 / 5) < 1e-6


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"), F.lit(3)).alias("x"))
        got = [r.x for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_mix_takes_what_it_says(spark, docs):
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(got - target) <= 3 * mixing.BLOCK_WORDS for target, got, _ in by.values())
    again = sorted((str(r.id), r.mark, r.source or "", r["size"], r.taken) for r in mixing.mix_sizes(docs.repartition(5)).collect())
    assert again == sorted((str(r.id), r.mark, r.source or "", r["size"], r.taken) for r in rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(split(r.text)) for r in out.collect()) == sum(r.taken for r in rows)
    whole = {tuple(split(t)) for _, t, *_ in corpus()}
    assert all(r.n_chars == len(r.text) for r in out.collect()) and any(tuple(split(r.text)) in whole for r in out.collect())
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_language_model_on_held_out_texts(spark):
    r = random.Random(5)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstü"}
    make = lambda s: " ".join("".join(r.choice(s) for _ in range(5)) for _ in range(30))
    rows = [(i, make(letters[k]), k) for i in range(80) for k in letters]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [(i, make(letters[k]), k, "x") for i in range(40) for k in letters] + [(900, None, None, None), (901, "12 34!", None, None), (902, "", None, None)]
    out = langid.predict_language(spark.createDataFrame(new, "doc_id long, text string, lang string, score string"), model).collect()
    assert all(r.lang_pred == r.lang for r in out if r.lang) and all(0 <= r.score <= 1 for r in out)
    assert all(r.lang_pred == "und" for r in out if not r.lang)
    assert (model.table == 0).mean() > 0.5
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.predict_language(spark.createDataFrame(new[:3], "doc_id long, text string, lang string, score string"), empty).collect()} == {"und"}


def test_ngrams_of_long_texts_come_once():
    text = "".join(random.Random(1).choice("abc ") for _ in range(1000))
    parts = [langid.grams(h) for h in langid.chunked([text, "ab"], 64)]
    r, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    w, m = langid.grams(next(langid.chunked([text, "ab"], 10**6)))
    assert sorted(zip(r.tolist(), k.tolist())) == sorted(zip(w.tolist(), m.tolist()))


def test_ledger_is_idempotent(spark, tmp_path):
    rows = [("s1", "en", 3, 5), ("s1", "en", 4, 6), (None, None, 2, 2), ("s2", "de", None, 1)]
    counts = spark.createDataFrame(rows, "source string, lang string, n_words long, n_tokens long")
    book = rollups.Ledger(spark, f"file://{tmp_path}/book")
    assert book.totals().count() == 0
    assert book.commit("a", rollups.inserts(counts, "v1")) and not book.commit("a", rollups.inserts(counts, "v1"))
    assert book.commit("b", rollups.deletes(counts.where("n_tokens = 6"), "v1"))
    for _ in range(2):
        book.commit("c", rollups.revisions(counts.where("source is null"), ("v1", "n_tokens"), ("v2", "n_words")))
    rollups.inserts(counts, "v1").groupBy(*rollups.KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumn("batch_id", F.lit("broken")).write.parquet(f"file://{tmp_path}/book/deltas/broken")
    got = {(r.source, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in book.totals().collect()}
    assert got == {("s1", "v1"): (1, 5), (None, "v1"): (0, 0), (None, "v2"): (1, 2), ("s2", "v1"): (1, 1)}
    assert book.commit("broken", rollups.inserts(counts, "v1"))
    tokens = rollups.count_tokens(spark.createDataFrame([(1, None, None, None), (2, "hello world", "s", "en")], "doc_id long, text string, source string, lang string")).collect()
    assert [(r.n_words, r.n_tokens) for r in sorted(tokens, key=lambda r: r.doc_id)] == [(0, 0), (2, 2)]


def test_plans_are_whole_and_no_worse_than_best_fit():
    import numpy as np

    from tapewright.llm import packing

    rng = np.random.default_rng(4)
    long_tail = np.minimum(1 + rng.gamma(0.9, 500, 6000).astype(int), 2048)
    for lengths in (long_tail, rng.integers(300, 1100, 3000), np.array([2048, 1, 1]), np.array([700, 700, 648] * 5), np.array([5])):
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        rows, n = packing.plan(histogram)
        held = {}
        taken = dict.fromkeys(histogram, 0)
        for length, first_rank, count, sequence, offset in rows[np.lexsort((rows[:, 1], rows[:, 0]))].tolist():
            assert first_rank == taken[length]
            taken[length] += count
            for k in range(count):
                held.setdefault(sequence + k, []).append((offset, length))
        assert taken == histogram and set(held) == set(range(n))
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        gaps, fitted = [], 0  # best fit alone, longest first
        for length in sorted(lengths.tolist(), reverse=True):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                fitted += 1
                gaps.append(2048 - length)
            else:
                gaps.remove(fit)
                gaps.append(fit - length)
        assert n <= fitted
