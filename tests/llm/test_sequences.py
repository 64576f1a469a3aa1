"""Sequence files: an exact round trip against the tokenizer, views, odd rows, stray and broken files."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewright.llm import sequences
from tapewright.llm.queries import QUERIES
from tapewright.llm.tokens import default_path, word_encoder

SF = "/root/testdata/sf0.001"
PATH = default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(library, rows):
    """(doc_id, text) rows in order -> their places and sums."""
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_sequence_query(spark, library):
    docs = sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    got = sorted(tuple(r) for r in QUERIES["op13_sequence_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(library, [(d["doc_id"], d["text"]) for d in docs])


ROWS = [(7, None), (3, ""), (5, "Hello, World's  12 #2"), (1, "<|startoftext|> naïve İSTANBUL ΣΑΣ é\x85x"), (2, "long text " * 150_000), (9, "same"), (9, "same"), (9, "other"), (None, "no id"), (-4, "\x0b\x1c ﬁ 東京")]


def test_round_trip_views_and_odd_rows(spark, library, tmp_path):
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(ROWS)], "doc_id long, text string, mark string, id int")
    folder = sequences.write_sequences(docs, f"file://{tmp_path}/out", length=128)
    (tmp_path / "out" / "part-stray.arrow").write_bytes(b"left by a lost task")
    got = [tuple(r) for r in sequences.read_sequences(spark, folder).orderBy("start").collect()]
    assert [r[0] for r in got[:7]] == [None, -4, 1, 2, 3, 5, 7] and [r[0] for r in got[7:]] == [9, 9, 9]
    texts = {i: t for i, t in ROWS}
    assert got[:7] == expected(library, [(i, texts[i]) for i in (None, -4, 1, 2, 3, 5, 7)])
    assert sorted(r[3] for r in got[7:]) == sorted(r[3] for r in expected(library, [r for r in ROWS if r[0] == 9]))
    every = sequences.Sequences(folder)
    flat = np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in map(every.__getitem__, range(len(every)))])
    assert len(flat) == got[-1][1] + got[-1][2]
    for _, start, n, crc in got:
        assert zlib.crc32(flat[start : start + n].astype("<u4").tobytes()) == crc
    ids, mask = every[len(every) // 2]
    assert len(ids) == len(mask) == 128 and not ids.flags.owndata and ids.dtype == np.uint16
    with pytest.raises(IndexError):
        every[len(every)]
    assert sequences.read_sequences(spark, sequences.write_sequences(docs.limit(0))).count() == 0
    words = docs.where("id < 3").selectExpr("'n' || doc_id AS doc_id", "text")
    assert {r.doc_id for r in sequences.read_sequences(spark, sequences.write_sequences(words)).collect()} == {"n7", "n3", "n5"}


def test_files_that_lost_ids_are_told(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    folder = sequences.write_sequences(docs, str(tmp_path / "out"), length=16)
    name = sequences.manifest(folder).column("file")[0].as_py()
    table = sequences.opened(f"{folder}/{name}.arrow").read_all()
    with pa.ipc.new_file(str(tmp_path / "out" / f"{name}.arrow"), table.schema) as out:
        out.write_table(table.slice(0, 1))
    with pytest.raises(ValueError, match="don't hold"):
        sequences.read_sequences(spark, folder)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcXYZ's'T'RE'll 0129 \t\n\x0b#!?-_.,ÀÉÖØßöøÿñ¿¡«»“”‘’–—…•<>&@`", max_size=80)))
def test_words_are_those_of_the_library(library, text):
    assert word_encoder(PATH).encode(text).tolist() == library(text)
