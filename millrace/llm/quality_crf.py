"""Operator 8: a linear-chain conditional random field labels each line good or bad.

Each line has its own features and those of its two neighbours. The field is trained by gradient ascent on the lines of
a bounded sample of labelled documents (SAMPLE of each label, a documented parameter), each line with its document's
label. A document's quality is the mean of its lines' forward-backward marginals, weighted by their length.

Null and empty texts have one empty line and are scored by the model; texts of any length are scored whole; documents whose label is null, and rows of labels
without a document, are not learnt from; of several labels of one document the least counts; without labels of both
kinds every score is the share of label 1 (0.5 without labels); repeated rows score alike; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import slices

SAMPLE = 1500
THRESHOLD = 0.7
STEPS = 250
OWN = 16  # features of a line before those of its neighbours
#: Frequent function words; fixed values.
COMMON = "the of and to in that is was for it with as on be at this are from or have by der die und den von zu das mit des im ist ein eine nicht de la le les et des en un une que est pour dans el y los del las por con su para".split()


def _table(sums_of) -> np.ndarray:
    table = np.zeros(1 << 16, np.uint64)
    for w in COMMON:
        b = np.frombuffer(w.encode(), np.uint8)
        h = K.span_hashes(sums_of(b), np.array([0]), np.array([len(b)]))[0]
        table[int(h) & 0xFFFF] = h
    return table


_common: list[np.ndarray] = []


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (lines, 3 * OWN), bytes of each line, text of each line)."""
    if not _common:
        _common.append(_table(K.prefix))
    starts, ends, owner = K.lines(buf, offs)
    n, size = len(starts), (ends - starts).astype(np.float64)

    def per_line(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    low = K.LOWER[buf]
    upper, lower = per_line(buf != low), per_line((buf >= 97) & (buf <= 122))
    high, digits = per_line(buf >= 128), per_line((buf >= 48) & (buf <= 57))
    symbol, bang = per_line(np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8))), per_line(buf == 33)
    stop = per_line(np.isin(buf, np.frombuffer(b".,;:?", np.uint8)))
    ws, we, _ = K.words(buf, offs)
    sums = K.prefix(low)
    h = K.span_hashes(sums, ws, we)
    at = np.searchsorted(starts, ws, "right") - 1
    at = np.minimum(at, n - 1)

    def by_word(hit: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=hit, minlength=n)

    count = by_word(np.ones(len(h)))
    lag = [np.concatenate([np.zeros(min(k, len(h)), bool), h[k:] == h[:-k]]) if len(h) > k else np.zeros(len(h), bool) for k in (1, 2, 3)]
    common = by_word(_common[0][h & np.uint64(0xFFFF)] == h)
    line_hash = K.span_hashes(sums, starts, ends) ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, copies = np.unique(line_hash, return_inverse=True, return_counts=True)
    twice = (copies[first] > 1).astype(np.float64)
    letters, w, b = np.maximum(upper + lower + high, 1), np.maximum(count, 1), np.maximum(size, 1)
    own = np.stack(
        [
            np.ones(n), np.log1p(count), np.minimum((b - count) / w, 20) / 10, upper / letters, np.minimum(symbol / w, 2), np.minimum(bang / w, 2),
            digits / b, high / letters, np.minimum(stop / w, 2), common / w, by_word(lag[0]) / w, by_word(lag[1] | lag[2]) / w, twice, (size == 0).astype(float),
            (symbol > 0).astype(float), (upper / letters > 0.5).astype(float),
        ],
        1,
    )
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = np.where(edge[1:, None], 0, own[:-1])
    after[:-1] = np.where(edge[1:, None], 0, own[1:])
    return np.hstack([own, before, after]), size + 1, owner


def _scan(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running products of 2x2 matrices within each chain (place: index in the chain), by doubling, rescaled on the way."""
    step = 1
    while step <= (place.max() if len(place) else 0):
        i = np.flatnonzero(place >= step)
        p = np.matmul(m[i - step], m[i])
        m = m.copy()
        m[i] = p / p.max(axis=(1, 2), keepdims=True)
        step *= 2
    return m


def marginals(good: np.ndarray, trans: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(line good), P(pair of states of a line and the next) (lines, 2, 2), zero at chain ends).

    good: log-odds of each line; trans: (2, 2) log weights."""
    n = len(good)
    emit = np.exp(np.stack([np.minimum(-good, 0), np.minimum(good, 0)], 1))
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else np.zeros(0, bool)
    heads = np.flatnonzero(edge)
    place = np.arange(n) - heads[np.cumsum(edge) - 1] if n else np.zeros(0, np.int64)
    tails = np.append(heads[1:], n) - 1
    back = (tails[np.cumsum(edge) - 1] - np.arange(n)) if n else place
    t = np.exp(trans - trans.max())
    step = t[None] * emit[:, None, :]
    start = step.copy()
    start[heads] = emit[heads][:, None, :] * np.ones((1, 2, 1))
    alpha = _scan(start, place)[:, 0, :]
    # Backward: products of the steps after a line, on the reversed chains with transposed matrices.
    r = np.transpose(step, (0, 2, 1))[::-1]
    tail = _scan(r.copy(), back[::-1])[::-1]
    beta = np.ones((n, 2))
    inner = np.flatnonzero(back > 0)
    beta[inner] = tail[inner + 1].sum(axis=1)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    p = alpha[inner][:, :, None] * step[inner + 1] * beta[inner + 1][:, None, :]
    pairs[inner] = p / p.sum(axis=(1, 2), keepdims=True)
    return post[:, 1], pairs


def trained(x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int = STEPS, l2: float = 1e-3) -> dict:
    """Adam on the mean log-likelihood of the chains; y: 0 or 1 for each line."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1
    mean[0] = 0  # the bias stays
    z = (x - mean) / std
    w, t = np.zeros(z.shape[1]), np.zeros((2, 2))
    chains = len(np.unique(owner))
    same = np.concatenate([owner[1:] == owner[:-1], [False]])
    seen = np.zeros((2, 2))
    i = np.flatnonzero(same)
    np.add.at(seen, (y[i], y[i + 1]), 1)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        p, pairs = marginals(z @ w, t, owner)
        g = np.concatenate([z.T @ (y - p) / chains - l2 * w, ((seen - pairs.sum(0)) / chains - l2 * t).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, t = w + d[:-4], t + d[-4:].reshape(2, 2)
    return {"mean": mean, "std": std, "w": w, "t": t}


def document_scores(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    x, size, owner = line_features(buf, offs)
    p, _ = marginals(((x - model["mean"]) / model["std"]) @ model["w"], model["t"], owner)
    n = len(offs) - 1
    return np.bincount(owner, weights=p * size, minlength=n) / np.bincount(owner, weights=size, minlength=n)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from at most that many documents of each label (the least by a hash of doc_id)."""
    learn = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
    learn = learn.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2)
    some = [learn.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    # At most 2 * sample ids: small enough for every executor by the parameter itself.
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("_id")).select("_text", "_y")

    def featured(batches):
        for batch, buf, offs in slices(batches, "_text"):
            x, _, owner = line_features(buf, offs)
            ends = np.searchsorted(owner, np.arange(len(offs) - 1), "right")
            blobs = [x[a:b].astype("<f4").tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), batch.column(1)], ["x", "y"])

    got = rows.mapInArrow(featured, "x binary, y int").collect()
    ys = {r["y"] for r in got}
    if len(ys) < 2:
        return {"share": float(min(ys)) if ys else 0.5}
    got.sort(key=lambda r: (r["y"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, 3 * OWN) for r in got]
    y = np.repeat([r["y"] for r in got], [len(x) for x in xs])
    return trained(np.concatenate(xs).astype(np.float64), np.repeat(np.arange(len(xs)), [len(x) for x in xs]), y)


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def scores(batches):
        for batch, buf, offs in slices(batches, "_text"):
            n = batch.num_rows
            s = np.full(n, model["share"]) if "share" in model else np.clip(document_scores(model, buf, offs), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).mapInArrow(scores, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, fitted(docs, labels, sample))
