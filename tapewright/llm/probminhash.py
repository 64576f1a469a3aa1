"""Near-dedup by ProbMinHash over word shingles, with banding and verification.

Every distinct shingle, with its weight, throws points of a Poisson process at the
slots of a signature; the earliest point of a slot wins, and a shingle stops once
its next point is later than all winners. The share of equal slots estimates the
probability Jaccard similarity. All shingles weigh the same here, for which that is
the Jaccard similarity of the sets, as the links use it. Documents that agree on a band are candidates;
links are those whose shingle sets have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.anchors import CHUNK, NO_ID, binaries, grouped_by, id_of, mixed, signed, span_hashes, word_units
from tapewright.llm.common import cut, tasks_for
from tapewright.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 6 slots miss a pair at 0.8 with probability (1 - 0.8^6)^32 = 6e-5.
BANDS, ROWS = 32, 6
GOLD = 0x9E3779B97F4A7C15


def shingles(units: np.ndarray, lengths: np.ndarray, size: int = SHINGLE):
    """Distinct shingles of texts that stand one after the other: text, hash, count."""
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(units))
    start = start[start + size <= ends[text]]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, t = span_hashes(units, start, start + size), text[start]
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return t[first], h[first], np.diff(np.r_[first, len(h)])


def signatures(text: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """ProbMinHash signatures, one row a text (texts without elements: zeros)."""
    best, winner = np.full(n_texts * slots, np.inf), np.zeros(n_texts * slots, np.uint64)
    time, rest = np.zeros(len(elements)), np.arange(len(elements))
    r = 0
    while len(rest):
        r += 1
        e, t = elements[rest], text[rest]
        x = mixed(e + np.uint64(r * GOLD % 2**64))
        arrival = time[rest] - np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53) / weights[rest]
        slot = t * slots + (mixed(x ^ np.uint64(GOLD)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(best, slot, arrival)
        won = best[slot] == arrival
        winner[slot[won]] = e[won]
        latest = best.reshape(n_texts, slots).max(1)
        go = arrival < latest[t]
        time[rest] = arrival
        rest = rest[go]
    return winner.reshape(n_texts, slots)


SIGN_SCHEMA = "id long, mark long, d1 long, d2 long, n long, bands array<long>, sign binary"
#: Pairs whose signatures agree in a smaller share of slots aren't compared in
#: full: at a similarity of 0.8, 192 slots agree in less than 0.55 with a
#: probability below 1e-14.
AGREE = 0.55
#: So many document numbers are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000


def sign_rows(bands: int, rows: int, size: int):
    """(id, mark, text) batches -> digest of the words, number of shingles, band hashes."""
    import xxhash

    def held_rows(texts):
        held, total = [], 0
        for i, text in enumerate(texts):
            words = word_units(text or b"")
            held.append((i, words))
            total += len(words) + 1
            if total >= CHUNK:
                yield held
                held, total = [], 0
        if held:
            yield held

    def go(batches):
        for b in batches:
            texts = binaries(b.column("text"))
            for held in held_rows(texts):
                units, lengths = np.concatenate([u for _, u in held]), np.array([len(u) for _, u in held])
                t, h, _ = shingles(units, lengths, size)
                n = np.bincount(t, minlength=len(held))
                sign = signatures(t, h, np.ones(len(h)), len(held), bands * rows)
                low = (mixed(sign) & np.uint64(255)).astype(np.uint8)
                at = np.arange(len(held) * bands) * rows
                hashes = signed(span_hashes(sign.reshape(-1), at, at + rows)).reshape(len(held), bands)
                digests = [xxhash.xxh3_128_intdigest(b" ".join(texts[i].split())) if len(u) else None for i, u in held]
                lo, hi = b.slice(held[0][0], len(held)), (1 << 64) - 1
                offsets = np.r_[0, np.cumsum(np.where(n > 0, bands, 0))]
                yield pa.RecordBatch.from_arrays(
                    [
                        lo.column("id"), lo.column("mark"),
                        pa.array([None if d is None else (d >> 64) - (1 << 63) for d in digests], pa.int64()),
                        pa.array([None if d is None else (d & hi) - (1 << 63) for d in digests], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[n > 0].reshape(-1), pa.int64())),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["id", "mark", "d1", "d2", "n", "bands", "sign"],
                )

    return go


def set_rows(size: int):
    """(id, text) batches -> (node, the sorted hashes of its distinct shingles)."""

    def go(batches):
        for b in batches:
            nodes, sets, total = [], [], 0
            for node, text in zip(b.column("id").to_pylist(), binaries(b.column("text")), strict=True):
                units = word_units(text or b"")
                _, h, _ = shingles(units, np.array([len(units)]), size)
                nodes.append(node), sets.append(h.tobytes())
                total += len(sets[-1])
                if total > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])
                    nodes, sets, total = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return go


def similar_rows(least: float):
    """Pairs with both sets -> those with a Jaccard similarity of at least this."""

    def go(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int((np.diff(np.sort(np.concatenate([x, y]))) == 0).sum())
                keep.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return go


def agreeing_rows(least: float):
    """Pairs with both signatures -> those that agree in this share of slots."""

    def go(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sign_a", "sign_b"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((x == y).mean(1) >= least, pa.bool_()))

    return go


#: Hashes of sets that one task counts at once, and the least parts of the hash range.
PART_HASHES, PARTS = 1_000_000, 32


def part_rows(parts: int):
    """(node, set) batches -> a row for each part of the hashes in which a node has any."""

    def go(batches):
        for b in batches:
            nodes, part, piece = [], [], []
            for node, body in zip(b.column("node").to_pylist(), b.column("set").to_pylist(), strict=True):
                h = np.frombuffer(body, np.uint64)
                p = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(p, kind="stable")
                h, p = h[order], p[order]
                edges = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                nodes += [node] * len(edges)
                part += p[edges].tolist()
                piece += [x.tobytes() for x in np.split(h, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(part, pa.int64()), pa.array(piece, pa.binary())], ["node", "part", "piece"])

    return go


def common_rows(batches):
    """Rows sorted by part -> by node and part, how many of its hashes other nodes hold too."""
    for t in grouped_by(batches, "part"):
        pieces = t.column("piece").to_pylist()
        owner = np.repeat(np.arange(len(pieces)), [len(x) // 8 for x in pieces])
        _, which, n = np.unique(np.frombuffer(b"".join(pieces), np.uint64), return_inverse=True, return_counts=True)
        common = np.bincount(owner, weights=n[which] > 1, minlength=len(pieces)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("node", "part")] + [pa.array(common)], ["node", "part", "common"])


def common_counts(sets: DataFrame, n_hashes: int) -> DataFrame:
    """(node, set) -> (node, common, parts): hashes of a set that any other set holds,
    in all and by PARTS parts of the hash range. Sets travel in such parts or smaller
    ones, so that no task holds them all."""
    parts = PARTS * max(1, -(-n_hashes // (PARTS * PART_HASHES)))
    pieces = sets.mapInArrow(part_rows(parts), "node long, part long, piece binary")
    counts = pieces.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(common_rows, "node long, part long, common long")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("part") % PARTS == k, F.col("common"))), F.lit(0))
    return counts.groupBy("node").agg(F.sum("common").alias("common"), F.array(*[of(k) for k in range(PARTS)]).alias("parts"))


def _fits(x: str, y: str, least: float):
    """Sets of such sizes, of which so many hashes are in any other set, can be similar enough."""
    n, m, c, d = (F.col(f"{t}{f}") for f in ("n", "common") for t in (x, y))
    return (F.least(n, m) >= least * F.greatest(n, m)) & (F.least(c, d) * (1 + least) >= least * (n + m))


def _fits_by_part(x: str, y: str, least: float):
    """The same bound, part by part of the hash range."""
    shared = sum((F.least(F.get(f"{x}parts", F.lit(k)), F.get(f"{y}parts", F.lit(k))) for k in range(PARTS)), F.lit(0))
    return shared * (1 + least) >= least * (F.col(f"{x}n") + F.col(f"{y}n"))


def _sided(table: DataFrame, side: str, value: str) -> DataFrame:
    return table.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}"))


def _of_pairs(pairs: DataFrame, n_pairs: int, table: DataFrame) -> DataFrame:
    """The rows of ``table`` whose node is in a pair."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return table.join(F.broadcast(nodes) if 2 * n_pairs <= BROADCAST_IDS else nodes, "node", "left_semi")


def near_links(buckets: DataFrame, signs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(bucket, node, n) -> (node, label) by component of linked nodes.

    In each round a bucket elects a leader, and each node is compared with one leader
    outside its component; buckets whose nodes are in one component are done. The
    first leader is any; then the hashes are counted that a node still open has in
    common with any other. Sets with n and m hashes, of which c and d are in other
    sets, share min(c, d) at most: a pair whose similarity this bound keeps under
    ``least`` is left out, exactly, and so is a node that can't reach it with any
    other. Of what stays, the nodes with the smallest share of own hashes lead, which
    most of a group is linked with. The rounds go on while they halve the open pairs;
    the pairs then open are compared in full, but for those that the sum of the
    bounds by parts of the hash range leaves out.
    """
    spark = buckets.sparkSession
    labels, tested, parts, r = None, None, None, 0
    n_rows = n_open = buckets.count()
    n_nodes, was = signs.count(), None
    buckets = buckets.withColumn("common", F.col("n"))
    while True:
        few = tasks_for(n_open)
        state = buckets.withColumn("label", F.col("node")) if labels is None else cut(buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "state", few)
        open_ = _open(state, few)
        left, n_open = open_.agg(F.sum("pairs"), F.sum("all")).first()
        if not left:
            break
        few = tasks_for(n_open)
        state = cut(state.join(open_.select("bucket"), "bucket"), "state", few)
        if r and left > n_nodes:
            nodes = state.groupBy("node").agg(F.first("n").alias("n"))
            nodes = F.broadcast(nodes) if n_nodes <= BROADCAST_IDS else nodes
            held = cut(sets.join(nodes, "node"), "open-sets")
            parts = common_counts(held.select("node", "set"), held.agg(F.sum("n")).first()[0])
            parts = cut(parts.join(held.select("node", "n"), "node").where(F.col("common") >= least * F.col("n")).drop("n"), "common", tasks_for(n_nodes))
            state = cut(state.drop("common").join(parts.drop("parts"), "node"), "state", few)
            open_ = _open(state, few)
            left, n_open = open_.agg(F.sum("pairs"), F.sum("all")).first()
            if not left:
                break
        buckets = state.drop("label")
        last = r > 0 and (left <= n_nodes or (r > 1 and 2 * left > was))
        was = left
        if last:
            known = state if parts is None else cut(state.join(parts.select("node", "parts"), "node"), "state", few)
            x, y = known.alias("x"), known.alias("y")
            fits = _fits("x.", "y.", least) & (F.lit(True) if parts is None else _fits_by_part("x.", "y.", least))
            pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = cut(pairs, "pairs")
        else:
            own = (F.col("n") - F.col("common")) / F.col("n")
            vary = F.lit(1.0 if r == 0 else 0.1 * (r - 1)) * F.pmod(F.xxhash64("node", F.lit(r)), F.lit(1 << 20)) / (1 << 20)
            lead = cut(state.groupBy("bucket").agg(F.min(F.struct((own + vary).alias("o"), "node", "label", "n", "common")).alias("lead")), "leaders", few)
            pairs = state.join(lead, "bucket").where((F.col("label") != F.col("lead.label")) & _fits("", "lead.", least)).select("node", "lead.o", F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
            pairs = cut(pairs.groupBy("node").agg(F.min(F.struct("o", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "pairs", few)
            tested = pairs if tested is None else tested.union(pairs)
        n_pairs = pairs.count()
        few = tasks_for(n_pairs, 10_000)
        near = _of_pairs(pairs, n_pairs, signs)
        likely = pairs.join(_sided(near, "a", "sign"), "a").join(_sided(near, "b", "sign"), "b").select("a", "b", "sign_a", "sign_b")
        likely = cut(likely.mapInArrow(agreeing_rows(AGREE), "a long, b long"), "likely", few)
        near = _of_pairs(likely, likely.count(), sets)
        links = likely.join(_sided(near, "a", "set"), "a").join(_sided(near, "b", "set"), "b").select("a", "b", "set_a", "set_b")
        links = links.mapInArrow(similar_rows(least), "a long, b long")
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b"))
        labels = components(links, few + tasks_for(n_rows))
        if last:
            break
        r += 1
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _open(state: DataFrame, tasks: int) -> DataFrame:
    """Buckets whose nodes are in several components, with their rows and pairs across components."""
    groups = state.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return cut(groups.where("all * all > same").select("bucket", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), "all"), "open", tasks)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, mark, class_id, n_shingles) for each row of ``docs``; class_id is the
    smallest id of the row's class, kept whether the row is the class's own.

    A class is a component of links: equal word sequences, or shingle sets with a
    Jaccard similarity of at least ``least``.

    Cases: texts with fewer words than a shingle, but one, only match equal word
    sequences; null texts and texts without words are each a class of their own;
    rows with a null id get class_id null and are kept; repeated rows share a
    class; rows with equal ids and different texts are compared as separate
    documents, and all rows of an id whose class is its own are kept; very long
    texts are whole; an empty table gives an empty result. Ids must be integers.
    """
    base = docs.select(id_of(id_col), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    signed_rows = cut(base.mapInArrow(sign_rows(bands, rows, size), SIGN_SCHEMA), "signatures")
    able = signed_rows.where((F.col("id") != NO_ID) & F.col("d1").isNotNull())
    nodes = able.groupBy("d1", "d2", "n", "bands", "sign").agg(F.min(F.struct("id", "mark")).alias("own"))
    # a node goes by its smallest id, but for further texts under one id
    texts = able.groupBy("id").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first < last")
    nodes = cut(nodes.select("*", "own.*").drop("own").withColumn("node", F.col("id")), "nodes")
    if not (texts := cut(texts, "texts")).isEmpty():
        further = F.col("first").isNotNull() & (F.col("mark") != F.col("first"))
        nodes = cut(nodes.join(texts, "id", "left").withColumn("node", F.when(further, F.xxhash64("id", "mark")).otherwise(F.col("id"))).drop("first", "last"), "nodes")
    spread = nodes.select("node", "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node", "n")
    shared = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket"), "shared")
    buckets = cut(spread.join(shared, "bucket"), "buckets")
    needed = cut(nodes.join(buckets.select("node").distinct(), "node").select("id", "mark", "node", "sign"), "linked")
    signs, of = needed.select("node", "sign"), needed.select("id", "mark", "node")
    of = F.broadcast(of) if needed.count() <= BROADCAST_IDS else of
    sets = cut(base.join(of, ["id", "mark"]).select(F.col("node").alias("id"), "text").mapInArrow(set_rows(size), "node long, set binary").dropDuplicates(["node"]), "sets")
    labels = near_links(buckets, signs, sets, least)
    linked = cut(nodes.join(labels, "node").select("d1", "d2", "label", "id"), "classes")
    named = linked.join(linked.groupBy("label").agg(F.min("id").alias("class")), "label").select("d1", "d2", "class")
    named = nodes.select("d1", "d2", F.col("id").alias("own")).join(named, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("class", "own").alias("class"))
    out = signed_rows.select("id", "mark", "d1", "d2", "n").join(named, ["d1", "d2"], "left")
    out = out.withColumn("class_id", F.when(F.col("id") == NO_ID, None).otherwise(F.coalesce("class", "id")))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "mark", "class_id", F.col("n").alias("n_shingles"), (F.col("class_id").isNull() | (F.col("class_id") == F.col("id"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class; of repeated rows (equal id and text), one."""
    kept = near_classes(docs, id_col, text, **options).where("kept").select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "mark").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, id_of(id_col), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("mark"))
    return rows.join(kept, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("row.*")


__all__ = ["near_classes", "near_dedup"]
