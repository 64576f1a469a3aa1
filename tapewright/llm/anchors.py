"""Windows of texts grouped by their minimisers (super-k-mers).

A window's minimiser is its gram with the smallest hash, the leftmost of equal
ones. Equal windows have equal minimisers, so windows only have to meet within
the bucket of theirs; consecutive windows with one minimiser travel as one packed
string. Units are words or bytes; everything inside a task is vectorised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import cut, partitions

#: Units of text that one vectorised step holds.
CHUNK = 1 << 19
#: Units of short texts that are looked at together, so that what one step makes stays in the cache for the next.
STEP = 1 << 16
PLACE_BITS = np.uint64(22)
PLACE = np.uint64((1 << 22) - 1)
#: Occurrences of a minimiser from which its bucket is split by a second one.
HOT = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, (2, 256), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (1 << 12))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    shifted = x >> np.uint64(30)
    x = x ^ shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of units[start:end] for each span, wherever it stands."""
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """span_hashes of all grams of k units."""
    n = max(0, len(units) - k + 1)
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.multiply(units, up[: len(units)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    found = sums[len(sums) - n :] - sums[:n]
    found *= down[:n]
    return mixed(found)


def byte_units(text: bytes | np.ndarray, table: int = 0) -> np.ndarray:
    return _TABLES[table][np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_units(text: bytes, table: int = 0) -> np.ndarray:
    """A hash for each word of a text; long texts are taken in pieces that end at a space."""
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            more = np.flatnonzero(_SPACE[data[end : end + 4096]])
            while end < len(data) and not len(more):
                end = min(len(data), end + 4096)
                more = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = min(len(data), end + (int(more[0]) if len(more) else 0))
        piece = data[at:end]
        starts, ends = word_spans(piece)
        out.append(mixed(span_hashes(_TABLES[table][piece], starts, ends) + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def units_of(text: bytes, kind: str, table: int = 0) -> np.ndarray:
    return word_units(text, table) if kind == "words" else byte_units(text, table)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size, other = 1, np.empty_like(keys)
    while size < width:
        step = min(size, width - size)
        n = len(keys) - step
        keys, other = np.minimum(keys[:n], keys[step:], out=other[:n]), keys
        size += step
    return keys


def runs_of(units: np.ndarray, lengths: np.ndarray, window: int, gram: int, without: np.ndarray | None = None):
    """Runs of windows with one minimiser in texts that stand one after the other.

    Returns arrays: the text's number, the run's first unit, its number of
    windows, the minimiser's place and its hash. without: by text, a gram hash that
    can't be a minimiser unless a window holds no other.
    """
    if len(units) < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(units, gram)
    keys = hashes & ~PLACE
    keys |= np.arange(len(hashes), dtype=np.uint64)
    if without is not None:
        keys[hashes == np.repeat(without, lengths)[: len(hashes)]] |= ~PLACE
    least = sliding_min(keys, window - gram + 1)  # keys of two places differ
    ends = np.cumsum(lengths)
    edges = np.r_[ends - lengths, np.maximum(ends - lengths, ends - window + 1)]  # of each text's windows
    first = np.unique(np.r_[np.flatnonzero(least[1:] != least[:-1]) + 1, edges[edges < len(least)]])
    count = np.diff(np.r_[first, len(least)])
    t = np.searchsorted(ends, first, "right")
    valid = first + window <= ends[t]
    t, first, count = t[valid], first[valid], count[valid]
    place = (least[first] & PLACE).astype(np.int64)
    return t, first, count, place, hashes[place]


def pieces(texts, kind: str, window: int):
    """Batches of (row, first unit, units): about STEP units each, long texts in
    pieces of at most about CHUNK that overlap by window - 1 units."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        units = units_of(text, kind) if kind == "words" or len(text) <= CHUNK else None
        n = len(text) if units is None else len(units)
        for at in range(0, max(1, n - window + 1), CHUNK):
            part = units[at : at + CHUNK + window - 1] if units is not None else byte_units(text[at : at + CHUNK + window - 1])
            if len(part) < window:
                continue
            held.append((row, at, part))
            size += len(part)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


RUN_SCHEMA = "id long, mark long, start int, n int, place int, h long"


def run_rows(kind: str, window: int, gram: int):
    """(id, mark, text) batches -> a row for each run of windows."""

    def go(batches):
        for b in batches:
            ids, marks = b.column("id").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
            for held in pieces(binaries(b.column("text")), kind, window):
                lengths = np.array([len(u) for _, _, u in held])
                rows, offs = np.array([r for r, _, _ in held]), np.array([a for _, a, _ in held])
                base = np.cumsum(lengths) - lengths
                t, first, n, place, h = runs_of(np.concatenate([u for _, _, u in held]), lengths, window, gram)
                start = first - base[t] + offs[t]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[t]], pa.int64()), pa.array(marks[rows[t]], pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(place - first, pa.int32()), pa.array(signed(h), pa.int64())],
                    ["id", "mark", "start", "n", "place", "h"],
                )

    return go


SENT_SCHEMA = "id long, h long, px long, place int, packed binary"
PLACED_SCHEMA = "id long, mark long, h long, px long, n int, starts array<int>"


def split_runs(late: list[tuple], kind: str, window: int, gram: int) -> None:
    """Runs of hot buckets, (their text's list, start, number of windows, place, h,
    string) -> rows of that list: the runs by a second minimiser within them."""
    words = kind == "words"
    body = (b" " if words else b"").join(x[-1] for x in late)
    lengths, keys = np.array([x[2] for x in late]) + window - 1, np.array([x[4] for x in late], np.int64).view(np.uint64)
    t, first, n, _, h = runs_of(units_of(body, kind), lengths, window, gram, without=keys)
    last = first + n + window - 2
    if words:
        starts, ends = word_spans(np.frombuffer(body, np.uint8))
        lo, hi = starts[first], ends[last]
    else:
        lo, hi = first, last + 1
    at = first - (np.cumsum(lengths) - lengths)[t]
    for k, x, m, key, a, b in zip(*(c.tolist() for c in (t, at, n, signed(mixed(h + keys[t])), lo, hi)), strict=True):
        found, start, _, place, _, _ = late[k]
        found.append((start + x, m, place - x, key, body[a:b]))


def run_strings(kind: str, window: int, gram: int):
    """Batches of rows with candidate runs -> by row, (start, n, place, h, string) of
    each run; runs of hot buckets are split by a second minimiser, many at a time."""

    def go(b):
        texts, runs = texts_of(b), b.column("runs")
        offsets = runs.offsets.to_numpy().tolist()
        flat = runs.values
        start, n, place, h, hot = (flat.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("start", "n", "place", "h", "hot"))
        held, late, units, size = [], [], 0, 0  # rows that wait for the runs in late
        for row, text in enumerate(texts):
            found: list[tuple] = []
            held.append((row, found))
            if kind == "words":
                s, e = word_spans(np.frombuffer(text, np.uint8))
            for j in range(offsets[row], offsets[row + 1]):
                a, m = start[j], n[j]
                lo, hi = (int(s[a]), int(e[a + m + window - 2])) if kind == "words" else (a, a + m + window - 1)
                size += hi - lo
                if not hot[j]:
                    found.append((a, m, place[j], h[j], text[lo:hi]))
                    continue
                late.append((found, a, m, place[j], h[j], text[lo:hi]))
                units += m + window - 1
                if units >= STEP:
                    split_runs(late, kind, window, gram)
                    late, units = [], 0
            if late and size > 8_000_000:
                split_runs(late, kind, window, gram)
                late, units = [], 0
            if not late:
                yield from held
                held, size = [], 0
        if late:
            split_runs(late, kind, window, gram)
        yield from held

    return go


def sent_rows(kind: str, window: int, gram: int, repeats: bool):
    """Rows with their candidate runs -> the packed string of each run, once a task,
    and, if repeats, a row without the string for the second time it occurs there.

    Rows come in the order of id, so a string is sent with this task's smallest. If
    a bucket has several rows of a string, it occurs several times, and only then.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def go(batches):
        sent: dict[tuple[int, int], bool] = {}  # whether the second row is sent too
        for b in batches:
            ids, out, size = b.column("id").to_pylist(), [], 0
            for row, found in run_strings(kind, window, gram)(b):
                for _, _, place, key, piece in found:
                    piece = b" ".join(piece.split()) if kind == "words" else piece
                    px = _digest(piece)
                    again = sent.get((key, px))
                    if again:
                        continue
                    if len(sent) > 400_000:
                        sent.clear()
                    sent[key, px] = again is not None
                    if again is None:
                        size += len(piece)
                        out.append((ids[row], key, px, place, piece))
                    elif repeats:
                        out.append((ids[row], key, px, place, None))
                if len(out) > 20_000 or size > 8_000_000:
                    yield _batch(out, SENT_SCHEMA, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, SENT_SCHEMA, kinds)

    return go


def placed_rows(kind: str, window: int, gram: int):
    """Rows with their candidate runs -> a row for each of a text's packed strings,
    by hash, with the places at which it starts there."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def go(batches):
        for b in batches:
            ids, marks, out = b.column("id").to_pylist(), b.column("mark").to_pylist(), []
            for row, found in run_strings(kind, window, gram)(b):
                starts: dict[tuple[int, int, int], list[int]] = {}
                for a, m, _, key, piece in found:
                    starts.setdefault((key, _digest(b" ".join(piece.split()) if kind == "words" else piece), m), []).append(a)
                out += [(ids[row], marks[row], key, px, m, x) for (key, px, m), x in starts.items()]
                if len(out) > 20_000:
                    yield _batch(out, PLACED_SCHEMA, kinds)
                    out = []
            if out:
                yield _batch(out, PLACED_SCHEMA, kinds)

    return go


def _digest(piece: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(piece) - (1 << 63)


def _batch(out: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


#: Stands for a null id in joins.
NO_ID = -(2**63)


def id_of(id_col: str):
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id")


def squeeze(batches):
    """(row, id, mark, text) batches with the text as zstd-compressed bytes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        z = [None if t is None else press(t) for t in binaries(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("mark"), pa.array(z, pa.binary())], ["row", "id", "mark", "z"])


def squeezed(docs: DataFrame, id_col: str, text: str, carry: list[str]) -> DataFrame:
    """The carried columns as structs and the text compressed, dealt out by id and mark
    (a hash of the text) once for all joins on them."""
    row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row")
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(row, id_of(id_col), F.xxhash64(body).alias("mark"), body.alias("text"))
    kind = T.StructType([rows.schema["row"], T.StructField("id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("z", T.BinaryType())])
    # neither is ever null; saying so here keeps joins from filtering one of several equal shuffles
    small = rows.mapInArrow(squeeze, kind).where("id is not null and mark is not null")
    return small.repartition(partitions(docs.sparkSession), "id", "mark")


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    """The texts of a batch, plain or squeezed."""
    if "z" not in batch.schema.names:
        return binaries(batch.column("text"))
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [None if z is None else open_(z) for z in batch.column("z").to_pylist()]


def candidate_runs(docs: DataFrame, kind: str, window: int, gram: int, distinct_ids: bool, name: str, text: str = "text", id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """(id, mark, runs): by document, the runs whose minimiser also occurs elsewhere
    (distinct_ids: in a document with another id). keep: write all runs once, else
    make them twice, which takes less disk and more time."""
    base = docs.select(id_of(id_col), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    base = base.where(F.col("text").isNotNull() & (F.octet_length("text") >= window))
    if distinct_ids:
        base = base.where(F.col("id") != NO_ID)
    runs = base.mapInArrow(run_rows(kind, window, gram), RUN_SCHEMA)
    runs = cut(runs, f"{name}-runs") if keep else runs
    again = runs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    again = cut(again.where("lo < hi" if distinct_ids else "c > 1").select("h", (F.col("c") > HOT).alias("hot")), f"{name}-repeated")
    runs = runs.join(again, "h")
    return cut(runs.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "place", "h", "hot")).alias("runs")), f"{name}-candidates")


def with_runs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """squeezed() rows with their candidate runs, in the order of id within a task."""
    # the rows go along whole, so that all plans on them need one and the same shuffle
    return rows.join(found, ["id", "mark"]).select("id", "mark", "row", "z", "runs").sortWithinPartitions("id")


def sent_strings(rows: DataFrame, found: DataFrame, kind: str, window: int, gram: int, repeats: bool) -> DataFrame:
    return with_runs(rows, found).mapInArrow(sent_rows(kind, window, gram, repeats), SENT_SCHEMA)


def placed_strings(rows: DataFrame, found: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    return with_runs(rows, found).mapInArrow(placed_rows(kind, window, gram), PLACED_SCHEMA)


def lost_spans(placed: DataFrame, runs: DataFrame, window: int, wanted=None) -> DataFrame:
    """(id, mark, spans) of texts: placed strings meet the runs of windows to remove,
    (h, px, runs of at and n); wanted: which of these count for a row."""
    met = placed.drop("n").join(runs, ["h", "px"])
    if wanted is not None:
        met = met.withColumn("runs", F.filter("runs", wanted)).where(F.size("runs") > 0)
    span = lambda s: F.transform("runs", lambda r: F.struct((s + r["at"]).alias("lo"), (s + r["at"] + r["n"] + window - 1).alias("hi")))
    spans = met.select("id", "mark", F.flatten(F.transform("starts", span)).alias("spans"))
    # a span may come several times; array_distinct would compare each two of a text's
    return spans.groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def spans_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """By row, the starts and ends of its spans; None if it has none."""
    spans = batch.column("spans")
    edges, flat = spans.offsets.to_numpy(), spans.values
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
    held = spans.is_valid().to_numpy(zero_copy_only=False) & (edges[1:] > edges[:-1])
    return [(lo[a:b], hi[a:b]) if x else None for a, b, x in zip(edges[:-1], edges[1:], held, strict=True)]


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the intervals [lo, hi)."""
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def grouped_by(batches, key: str):
    """Re-cut batches sorted by a key so that each ends with a whole group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(k[1:] != k[:-1])
        if held and k[0] != held[0].column(key)[held[0].num_rows - 1].as_py():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if not len(change):
            held.append(b)
            continue
        last = int(change[-1]) + 1
        held.append(b.slice(0, last))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
