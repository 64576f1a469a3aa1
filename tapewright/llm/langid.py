"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Document frequencies come from all labelled training documents; the weights are
learned from a bounded sample by follow-the-regularised-leader with elastic-net
penalties, most of them stay zero, and the scores are calibrated by a temperature
on a part of the sample that the weights haven't seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.anchors import CHUNK, mixed
from tapewright.llm.common import cut

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Documents of each label in the sample from which weights are learned; a fifth
#: of them only calibrates. Everything else covers all documents.
SAMPLE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
UNKNOWN = "und"


def chunked(texts: list[str], limit: int = CHUNK):
    """Batches of (row, characters); a long text comes in pieces that overlap by
    the longest n-gram less one, so that every n-gram comes once."""
    held, size, lap = [], 0, max(ORDERS) - 1
    for row, text in enumerate(texts):
        chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(1, len(chars) - lap), limit):
            held.append((row, chars[at : at + limit + lap], at + limit + lap >= len(chars)))
            size += len(held[-1][1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(held) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of a batch."""
    chars = np.concatenate([c for _, c, _ in held]).astype(np.uint64)
    lengths = np.array([len(c) for _, c, _ in held])
    ends = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(held)), lengths)
    row = np.array([r for r, _, _ in held])
    # in a piece that another follows, n-grams start before the overlap only
    stop = np.array([e if last else e - max(ORDERS) + 1 for e, (_, _, last) in zip(ends, held, strict=True)])
    rows, buckets = [], []
    key = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = key[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
        start = np.arange(len(key))
        ok = (start + n <= ends[piece[: len(key)]]) & (start < stop[piece[: len(key)]])
        if n in ORDERS:
            rows.append(row[piece[: len(key)][ok]])
            buckets.append((mixed(key[ok]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def frequency_rows(batches):
    """Texts -> (bucket, number of texts with it), summed over the task."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        texts = b.column("text").to_pylist()
        n += len(texts)
        last_row, last = -1, np.zeros(0, np.int64)
        for held in chunked(texts):
            r, k = grams(held)
            pairs = np.unique(r * BUCKETS + k)
            if last_row >= 0:  # a text's earlier pieces count once
                pairs = pairs[~((pairs // BUCKETS == last_row) & np.isin(pairs % BUCKETS, last))]
            total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            row = held[-1][0]
            more = pairs[pairs // BUCKETS == row] % BUCKETS
            last = np.union1d(last, more) if row == last_row else more
            last_row = row
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen, -1], pa.int64()), pa.array(np.r_[total[seen], n], pa.int64())], ["bucket", "df"])


def count_rows(batches):
    """(label, fold, text) -> label, fold, buckets and their counts."""
    for b in batches:
        texts = b.column("text").to_pylist()
        out: list[dict[int, int]] = [{} for _ in texts]
        for held in chunked(texts):
            r, k = grams(held)
            pairs, n = np.unique(r * BUCKETS + k, return_counts=True)
            for p, c in zip((pairs).tolist(), n.tolist(), strict=True):
                d = out[p // BUCKETS]
                d[p % BUCKETS] = d.get(p % BUCKETS, 0) + c
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), b.column("fold"), pa.array([list(d) for d in out], pa.list_(pa.int32())), pa.array([list(d.values()) for d in out], pa.list_(pa.int32()))],
            ["label", "fold", "buckets", "counts"],
        )


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal: weights (buckets x labels) from (label, buckets, values) rows."""
    z, n = np.zeros((BUCKETS, n_labels)), np.zeros((BUCKETS, n_labels))

    def weights(k):
        zk = z[k]
        return np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, k, x = rows[i]
            w = weights(k)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            z[k] += g - sigma * w
            n[k] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross entropy, by golden-section search of its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, g = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


class Model:
    """Labels, TF-IDF weights by bucket and label, and the temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, scale: float):
        self.labels, self.scale = labels, scale
        self.table = (idf[:, None] * weights).astype(np.float32)

    def predict(self):
        table, labels, scale = self.table, self.labels, self.scale

        def go(batches):
            for b in batches:
                texts = b.column("text").to_pylist()
                total, n = np.zeros((len(texts), len(labels))), np.zeros(len(texts))
                for held in chunked(texts):
                    r, k = grams(held)
                    n += np.bincount(r, minlength=len(texts))
                    for c in range(len(labels)):
                        total[:, c] += np.bincount(r, weights=table[k, c], minlength=len(texts))
                known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & (len(labels) > 0)
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if len(labels):
                    p = softmax(SCALE * total / np.maximum(n, 1)[:, None] / scale)
                    top = p.argmax(1)
                    score = np.where(known, p[np.arange(len(texts)), top], 0.0)
                    best = [labels[i] if ok else UNKNOWN for i, ok in zip(top, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c != "text"], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*[c for c in b.schema.names if c != "text"], "lang_pred", "score"])

        return go


#: Values are SCALE * (count / all counts) * idf.
SCALE = 50.0


def train(docs: DataFrame, label: str = "lang", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from all rows of ``docs`` with a label and a text.

    sample: documents of each label, by a hash of the text, that train and
    calibrate; the driver gets their counts. Document frequencies, at most one row
    a bucket, cover all. Without labelled rows the model knows no language.
    """
    rows = docs.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").cast("string").alias("text")).where("label is not null and text is not null")
    frequency = cut(rows.select("text").mapInArrow(frequency_rows, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")), "ngrams").collect()
    df = np.zeros(BUCKETS)
    n = 0
    for r in frequency:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["df"]
        else:
            n = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of"))
    # a hash lets about twice the sample through, so that no label is sorted whole
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    few = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "label").where(u * F.col("of") < 2 * sample)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), F.md5("text")))).where(F.col("place") <= sample)
    few = few.select("label", F.when(F.col("place") % 5 == 0, 1).otherwise(0).alias("fold"), "text")
    got = few.mapInArrow(count_rows, "label string, fold int, buckets array<int>, counts array<int>").collect()
    labels = sorted({r["label"] for r in got})
    if not labels:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)

    def vector(r):
        k, c = np.array(r["buckets"], np.int64), np.array(r["counts"], float)
        return labels.index(r["label"]), k, SCALE * c / max(c.sum(), 1) * idf[k]

    got.sort(key=lambda r: (r["label"], r["fold"], len(r["buckets"]), sum(b * c for b, c in zip(r["buckets"], r["counts"], strict=True))))
    fit, rest = [vector(r) for r in got if not r["fold"]], [vector(r) for r in got if r["fold"]]
    weights = learn(fit or rest, len(labels))
    held = rest or fit
    logits = np.array([x @ weights[k] for _, k, x in held])
    return Model(labels, idf, weights, temperature(logits, np.array([y for y, _, _ in held])))


def predict_language(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all but made ones by default) with lang_pred and score.

    Cases: a text that is null or has no letter gets ``und`` and score 0, and so
    does every text if the model knows no language; repeated rows each get a row;
    an empty table gives an empty result; columns named like a made one are
    replaced by it.
    """
    from pyspark.sql import types as T

    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    row = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(model.predict(), schema).select(*[F.col(f"row.`{c}`").alias(c) for c in carry], "lang_pred", "score")
