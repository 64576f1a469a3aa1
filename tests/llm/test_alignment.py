"""Alignment of two tokenizers against a plain walk over both ends."""

import hashlib
import os
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewright.llm import alignment
from tapewright.llm.queries import QUERIES
from tapewright.llm.tokens import default_path, encoder, pieces

SF = "/root/testdata/sf0.001"


def byte_chars() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def walk():
    first = Tokenizer.from_file(default_path())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    chars = byte_chars()

    def bytes_b(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    def ends(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at := at + len(p)))
        return out

    def one(text):
        if not text:
            return [], [], [], []
        whole = f" {text}".encode()
        a, b = first.encode(f" {text}", add_special_tokens=False), second.encode(text)
        ids = a.ids
        raw_a, raw_b = [bytes(chars[c] for c in t) for t in a.tokens], [bytes_b(i) for i in b]
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            return [], [], [], []
        spans_a, spans_b, groups, links, i, j = ends(raw_a), ends(raw_b), [], [], 0, 0
        for cut in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            i2, j2 = i, j
            while i2 < len(spans_a) and spans_a[i2][1] <= cut:
                i2 += 1
            while j2 < len(spans_b) and spans_b[j2][1] <= cut:
                j2 += 1
            groups.append((ids[i:i2], b[j:j2]))
            links += [(ids[x], b[y]) for x in range(i, i2) for y in range(j, j2) if max(spans_a[x][0], spans_b[y][0]) < min(spans_a[x][1], spans_b[y][1])]
            i, j = i2, j2
        return ids, b, groups, links

    return one


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else ""


def expected(walk, texts):
    found = [walk(t) for t in texts]
    counts = Counter(p for *_, links in found for p in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest(groups)) for a, b, groups, links in found]


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_alignment_query(spark, walk):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = dict(zip([d["doc_id"] for d in docs], expected(walk, [d["text"] for d in docs]), strict=True))
    got = QUERIES["op12_shared_cuts"](spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in alignment.MADE) for r in got} == want and len(got) == len(docs)


ODD = [None, "", " ", "\n", "a", "▁", "x ▁ y", "<s> and </s> <|endoftext|> <unk> <0x41>", "naïve 東京🙂 é", "two  spaces \t and\r\n\n lines ", "\x1c \x85 ​﻿", "ﬁ ½ Å", "0123456789" * 5, "supercalifragilistic" * 40, "a" * 3000]


def test_odd_texts_ties_and_extra_columns(spark, walk):
    texts = [*ODD, "repeated row", "repeated row", "long " * 150_000]
    rows = [(None if k == 3 else k % 7, t, k, "x", 0.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pair string, n_a double")
    for bound in (alignment.BROADCAST_PAIRS, 3):
        out, pairs = alignment.align_documents(docs, broadcast_pairs=bound)
        got = {r.row: tuple(r[c] for c in alignment.MADE) for r in out.collect()}
        assert [got[k] for k in range(len(texts))] == expected(walk, texts)
        assert set(out.columns) == {"doc_id", "row", "pair", "a", "b", *alignment.MADE}
    assert pairs.agg({"n": "sum"}).first()[0] == sum(g[3] for g in got.values())
    assert alignment.align_documents(docs.limit(0))[0].count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_blocks_of_any_texts(walk, texts):
    first, second = encoder(default_path()), pieces(default_path("piece_bpe_32k.model"))
    _, _, n_a, n_b, facts, pairs = alignment.align_texts(texts, first, second)
    want = expected(walk, texts)
    assert [(int(a), int(b), *f) for a, b, f in zip(n_a, n_b, facts, strict=True)] == [(*w[:4], w[6]) for w in want]
    assert len(pairs) == sum(w[3] for w in want)


def test_cuts_are_all_shared_ends():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 400):
        for share in (0.02, 0.5):
            a = np.unique(rng.integers(1, 4 * n + 1, n))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(1, 4 * n + 1, n)]))
            end = max(a[-1], b[-1]) + 1
            a, b = np.append(a, end), np.append(b, end)
            first_a, first_b = alignment.divide(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
            cuts = np.intersect1d(a, b)[:-1]
            assert first_a.tolist() == [0, *(np.searchsorted(a, cuts) + 1).tolist()]
            assert first_b.tolist() == [0, *(np.searchsorted(b, cuts) + 1).tolist()]
