"""Suffix-array dedup over bytes by deep-shallow sorting.

Windows of bytes meet in the bucket of their minimiser, as packed strings. There
the suffixes at all windows of a bucket's strings are sorted: multikey quicksort
with eight-byte characters down to a shallow depth, blind tries for the groups
whose common prefixes are longer. Neighbours with a common prefix of a window or
more are repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.anchors import candidate_runs, covered, grouped_by, lost_spans, placed_strings, sent_strings, spans_of, squeezed, texts_of
from tapewright.llm.common import partitions

WINDOW = 200
GRAM = 32
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 32
REPEAT_SCHEMA = "h long, px long, runs array<struct<at:int,n:int>>"
MADE = ("n_bytes", "n_removed", "n_spans", "kept_bytes")


def parted(order: np.ndarray, groups: np.ndarray):
    """Suffixes that stand by groups -> those of groups of three or more, their
    groups, and the two suffixes of each group of two."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    size = np.diff(np.r_[first, len(groups)])
    two, more = first[size == 2], np.repeat(size > 2, size)
    return order[more], groups[more], (order[two], order[two + 1])


def shallow_sort(text: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int = SHALLOW):
    """Multikey quicksort of suffixes within groups: in each step, all groups that
    don't agree in their next eight bytes are split by them. text ends with eight
    zero bytes; depth is a multiple of eight.

    Returns the order of the suffixes that share a group with two others or more,
    their groups, and the pairs that were left in a group of two.
    """
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))  # the eight bytes from each byte on
    order = np.argsort(groups, kind="stable")
    order, groups, two = parted(order, groups[order])
    pairs = [two]
    for d in range(0, depth, 8):
        if not len(order):
            break
        key = eight[starts[order] + d]
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        size = np.diff(np.r_[first, len(groups)])
        apart = np.logical_or.reduceat(key != np.repeat(key[first], size), first)
        if not apart.any():
            continue
        at = np.flatnonzero(np.repeat(apart, size))
        by = at[np.lexsort((key[at].byteswap(), groups[at]))]
        order[at], key[at] = order[by], key[by]
        order, groups, two = parted(order, np.cumsum(np.r_[True, (groups[1:] != groups[:-1]) | (key[1:] != key[:-1])]))
        pairs.append(two)
    return order, groups, tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


class BlindTrie:
    """Orders strings of one length: inner nodes hold a depth and branches by the
    byte there; the bytes between are not looked at on the way down, so that a new
    string is compared once, with the leaf that the way down leads to."""

    def __init__(self, first: bytes, item: int):
        self.root: list = [None, first, [item]]  # [depth, branches] or [None, string, items]

    def add(self, string: bytes, item: int) -> list[int]:
        """Returns the items with this string, the new one last."""
        node = self.root
        while node[0] is not None:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == string:
            node[2].append(item)
            return node[2]
        # longest common prefix: the strings as numbers differ from there on
        lo = len(string) - ((int.from_bytes(other) ^ int.from_bytes(string)).bit_length() + 7) // 8
        node = self.root
        while node[0] is not None and node[0] < lo:
            node = node[1][string[node[0]]]
        leaf = [None, string, [item]]
        if node[0] == lo:
            node[1][string[lo]] = leaf
        else:
            node[:] = [lo, {other[lo]: list(node), string[lo]: leaf}]
        return leaf[2]

    def leaves(self):
        """Strings in order, with their items."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[1], node[2]
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))


def repeats_in(text: np.ndarray, starts: np.ndarray, groups: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes share their first ``window`` bytes with another of their group."""
    found = np.zeros(len(starts), bool)
    # eight bytes more than the window could part windows that are equal
    order, groups, (left, right) = shallow_sort(text, starts, groups, min(SHALLOW, window // 8 * 8))
    # a trie of two strings is one comparison: all groups of two at once
    whole = np.lib.stride_tricks.sliding_window_view(text, window)
    for k in range(0, len(left), 4_000):
        a, b = left[k : k + 4_000], right[k : k + 4_000]
        same = (whole[starts[a]] == whole[starts[b]]).all(1)
        found[a[same]] = found[b[same]] = True
    if not len(order):
        return found
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[first[1:], len(groups)]
    body, at, again = text.tobytes(), starts[order].tolist(), []
    for f, end in zip(first.tolist(), ends.tolist(), strict=True):
        trie = BlindTrie(body[at[f] : at[f] + window], f)
        for i in range(f + 1, end):
            same = trie.add(body[at[i] : at[i] + window], i)
            if len(same) > 1:
                again += (same[0], i)
    found[order[again]] = True
    return found


def bucket_repeats(window: int):
    """Packed strings sorted by bucket -> their windows that occur elsewhere: all, if
    the string occurs again, or those that another string of the bucket holds."""

    def go(batches):
        for t in grouped_by(batches, "h"):
            h, px, place = (t.column(c).to_numpy() for c in ("h", "px", "place"))
            strings = t.column("packed")
            new = np.r_[True, (h[1:] != h[:-1]) | (px[1:] != px[:-1])]
            again = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
            # rows without the string come after those with it
            one = np.flatnonzero((new | np.r_[True, place[1:] != place[:-1]]) & strings.is_valid().to_numpy())
            twice = np.flatnonzero(new & again)
            if len(twice):
                n = pc.subtract(pc.binary_length(strings.take(pa.array(twice))), window - 1).combine_chunks().cast(pa.int32())
                runs = pa.StructArray.from_arrays([pa.array(np.zeros(len(n), np.int32)), n], ["at", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(h[twice]), pa.array(px[twice]), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1), pa.int32()), runs)], ["h", "px", "runs"])
            h, px, place, again = h[one], px[one], place[one], again[one]
            bucket = np.cumsum(np.r_[True, h[1:] != h[:-1]])
            many = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
            if not len(many):
                continue
            packed = t.column("packed").take(pa.array(one[many])).to_pylist()
            h, px, place, bucket = h[many], px[many], place[many], bucket[many]
            sizes = np.array([len(p) for p in packed])
            base = np.cumsum(sizes) - sizes
            text = np.frombuffer(b"".join(packed) + bytes(8), np.uint8)
            n = sizes - window + 1
            context = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
            # equal windows have their minimiser at the same place
            groups = bucket[context].astype(np.int64) * (window + 1) + (place[context] - at)
            hit = np.flatnonzero(repeats_in(text, base[context] + at, groups, window) & ~again[many][context])
            if not len(hit):
                continue
            c, a = context[hit], at[hit]
            cut = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (a[1:] != a[:-1] + 1)])
            length = np.diff(np.r_[cut, len(c)])
            which, offsets = np.unique(c[cut], return_index=True)
            runs = pa.StructArray.from_arrays([pa.array(a[cut], pa.int32()), pa.array(length, pa.int32())], ["at", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(h[which]), pa.array(px[which]), pa.ListArray.from_arrays(pa.array(np.r_[offsets, len(cut)], pa.int32()), runs)], ["h", "px", "runs"])

    return go


def remove_spans(batches):
    """Rows with spans of bytes to remove -> counts and the bytes that stay."""
    for b in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, cuts in zip(texts_of(b), spans_of(b), strict=True):
            text = text or b""
            n_bytes.append(len(text))
            if cuts is None:
                n_removed.append(0), n_spans.append(0), kept.append(text)
                continue
            gone = covered(len(text), *cuts)
            n_removed.append(int(np.count_nonzero(gone)))
            n_spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        made = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        yield pa.RecordBatch.from_arrays([b.column("row"), *made, pa.array(kept, pa.binary())], ["row", *MADE])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all by default) with n_bytes, n_removed,
    n_spans and kept_bytes: the bytes that no window covers which also starts
    anywhere else, in this document or another. Matches don't cross documents.

    Cases: a null text is empty; texts shorter than the window lose nothing; each
    of several equal rows is a document, so all lose their windows; null ids are
    ids; an empty table gives an empty result; columns named like a made one are
    replaced by it. kept_bytes need not be UTF-8.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    rows = squeezed(docs, id_col, text, keep)
    found = candidate_runs(docs, "bytes", window, gram, False, "suffix", text, id_col, keep=False)
    strings = sent_strings(rows, found, "bytes", window, gram, True).select("h", "px", "place", "packed").repartition(partitions(docs.sparkSession), "h")
    repeats = strings.sortWithinPartitions("h", "px", F.col("packed").isNull(), "place").mapInArrow(bucket_repeats(window), REPEAT_SCHEMA)
    lost = lost_spans(placed_strings(rows, found, "bytes", window, gram), repeats, window)
    out = rows.join(lost, ["id", "mark"], "left").select("row", "z", "spans")
    made = T.StructType([T.StructField("row", out.schema["row"].dataType), *[T.StructField(c, T.LongType()) for c in MADE[:3]], T.StructField(MADE[3], T.BinaryType())])
    return out.mapInArrow(remove_spans, made).select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *MADE)
