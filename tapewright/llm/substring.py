"""Substring dedup by super-k-mer partitioning.

Consecutive windows of words that share a minimiser travel as one packed string
to the minimiser's bucket. Sorting there finds, for each window, the smallest id
of a document that holds it; words of windows that an earlier document holds go.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.anchors import candidate_runs, covered, grouped_by, lost_spans, placed_strings, sent_strings, span_hashes, spans_of, squeezed, texts_of, word_units
from tapewright.llm.common import partitions

WINDOW = 50
#: Words of a gram; windows of 50 words hold 43 of them.
GRAM = 8
MADE = ("n_words", "n_removed", "kept_text")
OWNER_SCHEMA = "h long, px long, runs array<struct<at:int,n:int,owner:long>>"


def window_owners(window: int):
    """Packed strings sorted by bucket -> the smallest id by window, run by run."""

    def go(batches):
        for t in grouped_by(batches, "h"):
            h, px, ids = (t.column(c).to_numpy() for c in ("h", "px", "id"))
            one = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (px[1:] != px[:-1])])  # sorted by id too
            packed = t.column("packed").take(pa.array(one)).to_pylist()
            h, px, ids = h[one], px[one], ids[one]
            joined = b" ".join(packed)
            sizes = np.array([p.count(b" ") + 1 for p in packed])
            base = np.cumsum(sizes) - sizes
            n = sizes - window + 1
            context = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
            owner = ids[context].copy()
            bucket = np.cumsum(np.r_[True, h[1:] != h[:-1]])
            many = np.bincount(bucket)[bucket] > 1
            pick = np.flatnonzero(many[context])
            if len(pick):
                first = (base[context] + at)[pick]
                marks = [span_hashes(word_units(joined, k), first, first + window) for k in (0, 1)]
                group, held = bucket[context[pick]], owner[pick]
                order = np.lexsort((held, marks[1], marks[0], group))
                g, a, b = group[order], marks[0][order], marks[1][order]
                new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                owner[pick[order]] = held[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            cut = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (owner[1:] != owner[:-1])])
            length = np.diff(np.r_[cut, len(context)])
            offsets = np.r_[np.searchsorted(context[cut], np.arange(len(n))), len(cut)]
            runs = pa.StructArray.from_arrays([pa.array(at[cut], pa.int32()), pa.array(length, pa.int32()), pa.array(owner[cut], pa.int64())], ["at", "n", "owner"])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(px), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], ["h", "px", "runs"])

    return go


def remove_words(batches):
    """Rows with spans of words to remove -> the text, counts and the words that stay."""
    names = ["row", "text", *MADE]

    def made(rows, texts, n_words, n_removed, kept):
        return pa.RecordBatch.from_arrays([rows, *[pa.array(x, t) for x, t in ((texts, pa.binary()), (n_words, pa.int64()), (n_removed, pa.int64()), (kept, pa.binary()))]], names)

    for b in batches:
        spans, first, size = spans_of(b), 0, 0
        held: tuple[list, ...] = ([], [], [], [])
        for i, text in enumerate(texts_of(b)):
            words = (text or b"").split()
            left = words
            if spans[i] is not None:
                left = list(compress(words, ~covered(len(words), *spans[i])))
            for column, x in zip(held, (text, len(words), len(words) - len(left), b" ".join(left)), strict=True):
                column.append(x)
            size += len(text or b"")
            if size > 8_000_000:
                yield made(b.column("row").slice(first, i + 1 - first), *held)
                held, first, size = ([], [], [], []), i + 1, 0
        if held[0]:
            yield made(b.column("row").slice(first), *held)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all by default) with n_words, n_removed and
    kept_text: the words that no window covers whose word sequence also starts in a
    document with a smaller id, joined by one space (a text that loses nothing keeps
    its form only if the caller takes the text itself).

    Cases: a null or empty text has no words, kept_text ''; texts shorter than the
    window lose nothing; very long texts are whole; rows with a null id neither
    lose words nor make others lose any; rows with equal ids don't affect each
    other; an empty table gives an empty result; columns named like a made one are
    replaced by it. Ids must be integers.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    rows = squeezed(docs, id_col, text, [c for c in keep if c != text])
    found = candidate_runs(docs, "words", window, gram, True, "substring", text, id_col)
    strings = sent_strings(rows, found, "words", window, gram, False).select("h", "px", "id", "packed")
    owners = strings.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h", "px", "id").mapInArrow(window_owners(window), OWNER_SCHEMA)
    placed = placed_strings(rows, found, "words", window, gram)
    lost = lost_spans(placed, owners, window, lambda r: r["owner"] < F.col("id"))
    out = rows.join(lost, ["id", "mark"], "left").select("row", "z", "spans")
    kind = T.StructType([out.schema["row"], *[T.StructField(c, T.LongType() if c.startswith("n_") else T.BinaryType()) for c in ("text", *MADE)]])
    out = out.mapInArrow(remove_words, kind)
    carried = {c: F.col(f"row.`{c}`") if c != text else F.col("text").cast("string") for c in keep}
    return out.select(*[v.alias(c) for c, v in carried.items()], *MADE[:2], F.col(MADE[2]).cast("string").alias(MADE[2]))
