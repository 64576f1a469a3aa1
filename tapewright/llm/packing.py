"""Best-fit packing of token sequences by patterns of document lengths.

Documents are tokenized and cut into pieces of at most the capacity. The histogram
of piece lengths, never more bins than the capacity, is all that the driver sees:
patterns of two or three pieces that fill a sequence are enumerated on a grid of
lengths, repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and the residual pieces go to the gap that fits best. The plan
assigns ranks among the pieces of a length to sequences; tasks then look up each
piece's rank.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut
from tapewright.llm.tokens import default_path, encoder

CAPACITY = 2048
END = 0
#: Steps of the grid of lengths on which patterns are enumerated.
STEPS = 256
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


def piece_rows(path: str, capacity: int):
    """(doc_id, text) batches -> a row for each piece."""

    def go(batches):
        encode = encoder(path).encode
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return go


def patterns(steps: int) -> np.ndarray:
    """Pairs and triples of grid lengths that add up to ``steps``, smallest first; pairs start with 0."""
    if steps < 2:
        return np.zeros((0, 3), np.int64)
    pairs = [(0, a, steps - a) for a in range(1, steps // 2 + 1)]
    triples = [(a, b, steps - a - b) for a in range(1, steps // 3 + 1) for b in range(a, (steps - a) // 2 + 1)]
    return np.array(pairs + triples)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), []
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance * scale:
            break
        active.append(j)
        while True:
            part = a[:, active]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ b)
            if s.min() > 0:
                break
            now = x[active]
            low = s <= 0
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            x[active] = np.maximum(now + step * (s - now), 0)
            active = [k for k in active if x[k] > 1e-12]
            keep = np.zeros(a.shape[1], bool)
            keep[active] = True
            x[~keep] = 0
            if not active:
                break
        if active:
            x[:] = 0
            x[active] = s
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go.

    Returns rows (length, first rank, count, first sequence, offset): ranks first
    .. first+count-1 among the pieces of a length go, one each, to as many
    sequences from the first on; and the number of sequences. Its size depends on
    the number of lengths and patterns, not on the corpus.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0

    # patterns on the grid; a length stands for the next grid length above it, and
    # where the grid doesn't reach the capacity, lengths beyond it are left to best-fit
    unit = -(-capacity // steps)
    steps = capacity // unit
    cell = -(-np.arange(capacity + 1) // unit)
    counts = np.bincount(cell, weights=left, minlength=steps + 1)

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n
        counts[cell[length]] -= n

    if left[capacity]:
        n = int(left[capacity])
        take(capacity, n, 0, 0)
        n_sequences = n
    open_: dict[int, list[list[int]]] = {}  # gap -> ranges of sequences with it: first, count

    def leave(first: int, n: int, fill: int) -> None:
        if n and fill < capacity:
            open_.setdefault(capacity - fill, []).append([first, n])

    shapes = patterns(steps)
    # pieces shorter than a sixteenth of a sequence are kept for what the patterns leave
    shapes = shapes[((shapes == 0) | (shapes >= steps // 16)).all(1)]
    shapes = shapes[((counts[shapes] > 0) | (shapes == 0)).all(1)]
    if len(shapes):
        matrix = np.zeros((steps + 1, len(shapes)))
        for k in range(3):
            np.add.at(matrix, (shapes[:, k], np.arange(len(shapes))), 1.0)
        matrix[0] = 0
        present = np.flatnonzero(counts[: steps + 1] > 0)
        fitted = np.floor(nnls(matrix[present], counts[present]) + 1e-6).astype(np.int64)
        for p in np.argsort(-fitted, kind="stable"):
            shape = [int(s) for s in shapes[p][::-1] if s]
            n = min([int(fitted[p]), *(int(counts[s]) // shape.count(s) for s in shape)])
            if n <= 0:
                continue
            ranges = [(n_sequences, n, 0)]
            n_sequences += n
            for s in shape[:-2]:
                after = []
                lengths = list(range(min(s * unit, capacity), (s - 1) * unit, -1))
                for first, m, fill in ranges:
                    while m:
                        while not left[lengths[0]]:
                            lengths.pop(0)
                        t = int(min(m, left[lengths[0]]))
                        take(lengths[0], t, first, fill)
                        after.append((first, t, fill + lengths[0]))
                        first, m = first + t, m - t
                ranges = after
            # the last two pieces fill what the others' exact lengths leave: one of the
            # cell's lengths with what is then missing; sequences for which no such two
            # are left stay open for the residual, or aren't begun
            s = shape[-2]
            for first, m, fill in ranges:
                gap = capacity - fill
                for one in range(min(s * unit, gap - 1), (s - 1) * unit, -1):
                    two = gap - one
                    t = int(min(m, left[one], left[two]) if one != two else min(m, left[one] // 2))
                    if t:
                        take(one, t, first, fill)
                        take(two, t, first, fill + one)
                        first, m = first + t, m - t
                if fill:
                    leave(first, m, fill)
                else:
                    n_sequences -= m
    # residual pieces, longest first, to the smallest gap that holds them
    gaps = sorted(open_)
    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                first, m, gap = n_sequences, int(-(-left[length] // (capacity // length))), capacity
                n_sequences += m
            else:
                gap = gaps[at]
                first, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            t = int(min(m, left[length]))
            take(length, t, first, capacity - gap)
            for new_first, new_n, new_gap in ((first, t, gap - length), (first + t, m - t, gap)):
                if new_n and new_gap:
                    if new_gap not in open_:
                        open_[new_gap] = []
                        bisect.insort(gaps, new_gap)
                    open_[new_gap].append([new_first, new_n])
    return np.array(rows, np.int64).reshape(-1, 5), n_sequences


def place_rows(rows: np.ndarray):
    """Pieces with their ranks -> with their sequence and offset, by the plan."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    keys = rows[:, 0] * (1 << 50) + rows[:, 1]

    def go(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1
            sequence = rows[k, 3] + rank - rows[k, 1] if len(rows) else rank
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence, pa.int64()), pa.array(rows[k, 4] if len(rows) else rank, pa.int64())], [*names, "sequence_id", "offset"])

    return go


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: the path of the vocabulary, which every executor must have.

    Cases: a null or empty text is the end token alone; null ids are kept; each of
    several equal rows is packed; an empty table gives an empty result; other
    columns are not read.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = cut(base.mapInArrow(piece_rows(tokenizer or default_path(), capacity), PIECE_SCHEMA), "pieces")
    by_length = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row a length
    histogram = {r["length"]: r["n"] for r in by_length}
    planned, _ = plan(histogram, capacity)
    # ranks within a length in two steps: in a salted part, then over the parts
    parts = max(32, sum(histogram.values()) // 200_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("within", F.row_number().over(inner) - 1).join(counts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    return ranked.mapInArrow(place_rows(planned), f"{PIECE_SCHEMA}, sequence_id long, offset long")
