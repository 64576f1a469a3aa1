"""Cross-tokenizer alignment: the groups of tokens between byte offsets where both tokenizers end a token.

Each text is encoded twice. An interval of tokens is cut at the shared end nearest
to its middle, found by bisection in the other tokenizer's ends, and both halves are
cut again; intervals without a shared end inside are the groups. All intervals of a
block of texts take each step together. Tokens whose bytes overlap are linked; links
are counted by id pair over the corpus, and the counts come back to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewright.llm.common import cut, others
from tapewright.llm.tokens import default_path, encoder, pieces

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 18
#: Id pairs of a task are summed before they leave it; so many different ones are held.
HELD = 1 << 20
#: Up to this number of different id pairs (17 bytes each), their counts are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 4_000_000
#: Probes that all intervals take together before those still without a cut look at all their ends.
TOGETHER = 16
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def nearest_cuts(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval lo .. hi-1 of A's tokens, the inner token nearest to the
    middle whose end is an end of B too, and that token of B; -1 where there is none."""
    at, other = np.full(len(lo), -1), np.full(len(lo), -1)
    middle, last = (lo + hi - 1) // 2, hi - 2
    reach = np.maximum(middle - lo, last - middle)
    open_ = np.arange(len(lo))
    for k in range(2 * TOGETHER):
        step = (k + 1) // 2
        open_ = open_[reach[open_] >= step]
        if not len(open_):
            return at, other
        probe = middle[open_] + (step if k % 2 else -step)
        inside = (probe >= lo[open_]) & (probe <= last[open_])
        rows, probe = open_[inside], probe[inside]
        end = a_ends[probe]
        found = np.searchsorted(b_ends, end)
        hit = b_ends[found] == end
        at[rows[hit]], other[rows[hit]] = probe[hit], found[hit]
        open_ = open_[at[open_] < 0]
    for r in open_[reach[open_] >= TOGETHER]:
        inner = np.arange(lo[r], last[r] + 1)
        found = np.searchsorted(b_ends, a_ends[inner])
        hits = np.flatnonzero(b_ends[found] == a_ends[inner])
        if len(hits):
            best = hits[np.argmin(np.abs(inner[hits] - middle[r]))]
            at[r], other[r] = inner[best], found[best]
    return at, other


def divide(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens, of A and of B, of each group, in order.

    a_starts, b_starts: the first tokens of each text and, last, the numbers of all
    tokens; each text has a token and ends at the same offset in both.
    """
    lo, hi, b_lo, b_hi = a_starts[:-1], a_starts[1:], b_starts[:-1], b_starts[1:]
    done_a, done_b = [], []
    while len(lo):
        at, other = np.full(len(lo), -1), np.full(len(lo), -1)
        wide = np.flatnonzero((hi - lo > 1) & (b_hi - b_lo > 1))
        at[wide], other[wide] = nearest_cuts(a_ends, b_ends, lo[wide], hi[wide])
        leaf = at < 0
        done_a.append(lo[leaf])
        done_b.append(b_lo[leaf])
        go = ~leaf
        m, n = at[go] + 1, other[go] + 1
        lo, hi, b_lo, b_hi = (np.stack(halves, 1).ravel() for halves in ((lo[go], m), (m, hi[go]), (b_lo[go], n), (n, b_hi[go])))
    a, b = np.concatenate([*done_a, np.zeros(0, np.int64)]), np.concatenate([*done_b, np.zeros(0, np.int64)])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that share bytes: one pair for each stretch between two neighbouring ends of either."""
    ends = np.concatenate([a_ends, b_ends])
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


#: Decimal digits of an id, left aligned, with room for a separator; and their number.
_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _DIGITS:
        text = np.array([str(i).encode() for i in range(n)])
        width = text.dtype.itemsize
        table = np.zeros((n, width + 1), np.uint8)
        table[:, :width] = text.view(np.uint8).reshape(n, width)
        _DIGITS[n] = table, (table > 0).sum(1)
    return _DIGITS[n]


def written(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> list[str]:
    """The digest of each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    group_a = np.zeros(len(a), np.int64)
    group_b = np.zeros(len(b), np.int64)
    group_a[first_a[1:]] = 1
    group_b[first_b[1:]] = 1
    group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
    place_a = np.arange(len(a)) + first_b[group_a]
    place_b = np.arange(len(b)) + np.append(first_a[1:], len(a))[group_b]
    table, width = digits(int(max(a.max(initial=0), b.max(initial=0))) + 1 if len(a) else 1)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[np.append(first_a[1:], len(a)) - 1]] = ord("|")
    mark[place_b[np.append(first_b[1:], len(b)) - 1]] = ord(";")
    text = table[ids]
    size = width[ids]
    text[np.arange(len(ids)), size] = mark
    flat = text[text > 0].tobytes()
    ends = np.append(0, np.cumsum(size + 1))[a_starts + b_starts]
    return [hashlib.sha256(flat[s : e - 1]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def blocks(rows, size: int = BLOCK):
    """(key, text) rows in lists of about ``size`` bytes."""
    held, total = [], 0
    for row in rows:
        if held and total + len(row[1] or "") > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[1] or "")
    if held:
        yield held


def encoded(texts: list[str | None], first, second) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B in one row each, and each text's numbers of them; none for
    a text that is null, empty, or that one of the two doesn't give back byte for byte."""
    some = [k for k, t in enumerate(texts) if t]
    whole = [f" {texts[k]}" for k in some]
    made = [first.plain(t) for t in whole], second.encode([texts[k] for k in some])
    whole = [t.encode() for t in whole]
    good, out = np.ones(len(some), bool), []
    for ids, by in zip(made, (first, second), strict=True):
        n = np.array([len(x) for x in ids], np.int64)
        every = np.concatenate([np.zeros(0, np.uint32), *ids])
        if by.joined(every) != b"".join(whole):  # then each by itself
            good &= [by.joined(x) == w for x, w in zip(ids, whole, strict=True)]
        out.append((every, n))
    counts = np.zeros((2, len(texts)), np.int64)
    for k, (every, n) in enumerate(out):
        counts[k, some] = np.where(good, n, 0)
        out[k] = every[np.repeat(good, n)]
    return *out, *counts


def align_texts(texts: list[str | None], first, second):
    """One block of texts -> ids of A and B and their numbers, for each text (n_groups, n_links, digest), and the block's linked id pairs."""
    a, b, n_a, n_b = encoded(texts, first, second)
    some = np.flatnonzero(n_a)
    facts = [(0, 0, "") for _ in texts]
    if not len(some):
        return a, b, n_a, n_b, facts, np.zeros(0, np.int64)
    a_ends, b_ends = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    a_starts, b_starts = np.append(0, np.cumsum(n_a[some])), np.append(0, np.cumsum(n_b[some]))
    first_a, first_b = divide(a_ends, b_ends, a_starts, b_starts)
    i, j = links(a_ends, b_ends)
    n_groups = np.diff(np.searchsorted(first_a, a_starts))
    n_links = np.diff(np.searchsorted(i, a_starts))
    for r, *fact in zip(some.tolist(), n_groups.tolist(), n_links.tolist(), written(a, b, first_a, first_b, a_starts, b_starts), strict=True):
        facts[r] = tuple(fact)
    return a, b, n_a, n_b, facts, a[i].astype(np.int64) << 32 | b[j]


class PairSums:
    """Counts of id pairs, merged as they come; ``flush`` hands them over."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        every = np.concatenate([self.keys, keys])
        weights = np.concatenate([self.counts, counts])
        order = np.argsort(every, kind="stable")
        every, weights = every[order], weights[order]
        new = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[new], np.add.reduceat(weights, new) if len(every) else weights

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.keys, self.counts
        self.__init__()
        return out


ALIGNED = "row long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long"
_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def pair_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(keys), k) for k in _KINDS[:-2]], pa.array(keys), pa.array(counts)], _NAMES)


def id_bytes(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def align_rows(path_a: str, path_b: str):
    """(row, text, carried) batches -> a row for each text, and rows of (pair, n) for the id pairs of the task."""

    def go(batches):
        first, second, sums, kind = encoder(path_a), pieces(path_b), PairSums(), None

        def pair_rows() -> pa.RecordBatch:
            keys, counts = sums.flush()
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(keys), k) for k in _KINDS[:-2]], pa.array(keys), pa.array(counts), pa.nulls(len(keys), kind)], [*_NAMES, "carried"])

        for batch in batches:
            rows, kind = batch.column("row"), batch.column("carried").type
            for held in blocks(enumerate(batch.column("text").to_pylist())):
                a, b, n_a, n_b, facts, pairs = align_texts([t for _, t in held], first, second)
                at = pa.array([k for k, _ in held], pa.int64())
                columns = [id_bytes(a, n_a), id_bytes(b, n_b), n_a, n_b, *zip(*facts, strict=True)]
                columns = [rows.take(at), *[pa.array(c, k) for c, k in zip(columns, _KINDS[1:-2], strict=True)], *[pa.nulls(len(held), k) for k in _KINDS[-2:]], batch.column("carried").take(at)]
                yield pa.RecordBatch.from_arrays(columns, [*_NAMES, "carried"])
                sums.add(pairs)
                if len(sums.keys) > HELD:
                    yield pair_rows()
        if len(sums.keys):
            yield pair_rows()

    return go


def id_blocks(batch: pa.RecordBatch, size: int = BLOCK):
    """Rows of ids as (rows, a, b, texts' numbers of tokens of A and B), in blocks."""
    for held in blocks(zip(batch.column("row").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True), size):
        yield [r for r, _, _ in held], *[np.frombuffer(b"".join(x[k] for x in held), "<u4") for k in (1, 2)], *[np.array([len(x[k]) // 4 for x in held], np.int64) for k in (1, 2)]


def linked_ids(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, first, second) -> tuple[np.ndarray, np.ndarray]:
    """The id pair of each link of a block, and its text's number."""
    i, j = links(np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b]))
    return a[i].astype(np.int64) << 32 | b[j], np.searchsorted(np.cumsum(n_a), i, side="right")


def weigh_rows(path_a: str, path_b: str, table):
    """Stored ids -> (row, n_best, count_sum), by the broadcast counts of all pairs."""

    def go(batches):
        first, second = encoder(path_a), pieces(path_b)
        keys, counts, best = table.value
        for batch in batches:
            for rows, a, b, n_a, _ in id_blocks(batch):
                pairs, text = linked_ids(a, b, n_a, first, second)
                order = np.argsort(pairs, kind="stable")  # neighbours in the table are looked up one after the other
                at = np.empty(len(pairs), np.int64)
                at[order] = np.searchsorted(keys, pairs[order])
                n_best = np.bincount(text[best[at]], minlength=len(rows))
                ends = np.append(0, np.cumsum(counts[at]))
                edge = np.append(0, np.cumsum(np.bincount(text, minlength=len(rows))))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n_best, pa.int64()), pa.array(np.diff(ends[edge]), pa.int64())], ["row", "n_best", "count_sum"])

    return go


def own_pairs(path_a: str, path_b: str):
    """Stored ids -> (row, pair, times): the different pairs of each text."""

    def go(batches):
        first, second = encoder(path_a), pieces(path_b)
        for batch in batches:
            for rows, a, b, n_a, _ in id_blocks(batch):
                pairs, text = linked_ids(a, b, n_a, first, second)
                order = np.lexsort((pairs, text))
                pairs, text = pairs[order], text[order]
                new = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1]))) if len(pairs) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(rows, np.int64)[text[new]]), pa.array(pairs[new]), pa.array(times, pa.int64())], ["row", "pair", "times"])

    return go


def align_documents(docs: DataFrame, text: str = "text", carry: list[str] | None = None, tokenizer_a: str | None = None, tokenizer_b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The alignment of every text by two tokenizers, and the counts of linked id pairs.

    First: the carried columns (all but the text by default), n_a, n_b, n_groups,
    n_links, n_best (links whose pair is the most frequent of its B id), count_sum
    (of the pair counts over the links), groups_sha256, and the ids of A and B as
    little-endian 32-bit integers (``a``, ``b``). Second: (a, b, n, best) of each pair.

    tokenizer_a, tokenizer_b: paths of a byte-level and of a piece vocabulary, which
    every executor must have.

    Cases: a text that is null, empty or isn't given back byte for byte by both
    tokenizers has no tokens: zeros and an empty digest. Repeated rows each count and
    each get a row; null ids are carried; an empty table gives empty results; carried
    columns named like a made one are replaced by it.
    """
    made = [*MADE, "a", "b"]
    carry = [c for c in (others(docs, [text]) if carry is None else carry) if c not in made]
    spark = docs.sparkSession
    path_a, path_b = tokenizer_a or default_path(), tokenizer_b or default_path("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col(f"`{text}`").cast("string").alias("text"))
    named = StructType.fromDDL(ALIGNED).add("carried", rows.schema["carried"].dataType)
    both = cut(rows.mapInArrow(align_rows(path_a, path_b), named), "aligned", codec="zstd")
    pairs = both.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n"), "id-pairs")
    tops = pairs.groupBy("b").agg(F.max("n").alias("top"))  # at most a row for each id of B
    pairs = pairs.join(tops, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    texts = both.where("pair is null").drop("pair", "n")
    if pairs.count() <= broadcast_pairs:
        held = pairs.select("pair", "n", "best").sort("pair").toArrow()  # no more than broadcast_pairs rows
        table = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(held.column(c).to_numpy()) for c in ("pair", "n", "best")))
        sums = texts.select("row", "a", "b").mapInArrow(weigh_rows(path_a, path_b, table), "row long, n_best long, count_sum long")
    else:
        own = texts.select("row", "a", "b").mapInArrow(own_pairs(path_a, path_b), "row long, pair long, times long")
        met = own.join(pairs.select("pair", "n", "best").hint("merge"), "pair")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = texts.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return out.select(*[F.col(f"carried.`{c}`") for c in carry], *MADE, "a", "b"), pairs.drop("pair")

