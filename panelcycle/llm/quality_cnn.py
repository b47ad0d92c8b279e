"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over the document's UTF-8 bytes at every second byte. The
document is covered by overlapping chunks; in each, every filter is rectified and max-pooled, a
linear layer turns the pooled values into a logit, and the mean of the chunks' logits gives one
probability. Filters act on one-hot bytes, so a filter is a table (byte offset, byte value), and in
scoring two neighbouring offsets share a table over byte pairs.

The network is fitted with Adam on a bounded sample of labelled rows (``FIT_ROWS`` documents of at
most ``FIT_BYTES`` bytes, chosen by a hash of the identity); every document is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS, FIT_BYTES = 1500, 20_000
WIDTH, FILTERS = 6, 12
#: Positions (two bytes each) in a block; a chunk is four blocks, the next one starts three on.
BLOCK, CHUNK_BLOCKS, STEP_BLOCKS = 64, 4, 3


def held_out(identity: str):
    """Rows that are never learned from: crc32 of the identity as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(identity).cast("string")) % 3 == 1, F.lit(False))


def _pairs(data: bytes) -> np.ndarray:
    """Byte pairs, padded with zero bytes so that at least one position and whole blocks exist."""
    positions = max(1, -(-len(data) // 2))
    blocks = max(CHUNK_BLOCKS, CHUNK_BLOCKS + -(-max(0, -(-positions // BLOCK) - CHUNK_BLOCKS) // STEP_BLOCKS) * STEP_BLOCKS)
    padded = np.zeros(2 * (blocks * BLOCK + WIDTH // 2), np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded.view("<u2")


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, shift: float):
        self.filters, self.bias, self.out, self.shift = filters, bias, out, shift
        low = np.arange(65536) & 255
        self.tables = [np.ascontiguousarray(filters[k][low] + filters[k + 1][np.arange(65536) >> 8]) for k in range(0, WIDTH, 2)]

    def logit(self, data: bytes) -> float:
        pairs = _pairs(data)
        n = len(pairs) - WIDTH // 2
        blocks = []
        for at in range(0, n, 64 * BLOCK):
            m = min(64 * BLOCK, n - at)
            response = self.tables[0][pairs[at : at + m]]
            for k in range(1, WIDTH // 2):
                response += self.tables[k][pairs[at + k : at + k + m]]
            blocks.append(response.reshape(-1, BLOCK, FILTERS).max(axis=1))
        pooled = np.concatenate(blocks)
        count = (len(pooled) - CHUNK_BLOCKS) // STEP_BLOCKS + 1
        chunks = np.max([pooled[k : k + STEP_BLOCKS * (count - 1) + 1 : STEP_BLOCKS] for k in range(CHUNK_BLOCKS)], axis=0)
        return float((np.maximum(chunks + self.bias, 0) @ self.out).mean() + self.shift)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.03, seed: int = 5) -> Network:
    """Adam on the log loss; the gradient of a pooled filter goes to the place of its maximum."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    params = [
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32), np.array([np.log(share / (1 - share))], np.float32),
    ]
    if len(labels) == 0 or labels.min() == labels.max():
        return Network(params[0], params[1], np.zeros(FILTERS, np.float32), float(params[3][0]))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    span = CHUNK_BLOCKS * BLOCK
    chunked = []
    for t in texts:
        raw = _pairs(t).view(np.uint8)
        starts = range(0, len(raw) // 2 - WIDTH // 2 - span + 1, STEP_BLOCKS * BLOCK)
        chunked.append(np.stack([raw[2 * a : 2 * (a + span) + WIDTH] for a in starts]))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            data = np.concatenate([chunked[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(chunked[i]) for i in batch])
            counts = np.bincount(owner).astype(np.float32)
            filters, bias, out, shift = params
            response = filters[0][data[:, 0 : 2 * span : 2]]
            for k in range(1, WIDTH):
                response += filters[k][data[:, k : k + 2 * span : 2]]
            place = response.argmax(axis=1)
            peak = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0] + bias
            active = np.maximum(peak, 0)
            logits = np.bincount(owner, active @ out) / counts + shift[0]
            error = (1 / (1 + np.exp(-logits)) - labels[batch]) / len(batch)
            on_chunk = (error / counts)[owner].astype(np.float32)
            on_peak = on_chunk[:, None] * out * (peak > 0)
            grads = [np.zeros_like(filters), on_peak.sum(0), active.T @ on_chunk, np.array([error.sum()], np.float32)]
            which = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                byte = np.take_along_axis(data, 2 * place + k, axis=1)
                np.add.at(grads[0][k], (byte, which), on_peak)
            step += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Network(params[0], params[1], params[2], float(params[3][0]))


def fit_on(
    docs: DataFrame, labels: DataFrame, identity: str, text: str, label: str, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES
) -> Network:
    """The network of at most ``fit_rows`` labelled rows that are not held out, the same ones in every run.

    Identities are drawn by hash, and where several rows share them, rows by a hash of identity and text. Longer
    texts than ``fit_bytes`` are left out; identities labelled both ways teach nothing.
    """
    some = labels.where(~held_out(identity) & F.col(label).isin(0, 1)).groupBy(identity).agg(F.min(label).alias(label), F.max(label).alias("_most"))
    some = some.where(F.col(label) == F.col("_most")).select(identity, label)
    ids = some.orderBy(F.xxhash64(F.col(identity), F.lit(3)), identity).limit(fit_rows).collect()  # identities only, at most ``fit_rows``
    spark = docs.sparkSession
    picked = spark.createDataFrame([tuple(r) for r in ids], some.schema)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    joined = docs.select(identity, data.alias("data")).where(F.octet_length("data") <= fit_bytes).join(F.broadcast(picked), identity)
    drawn = joined.orderBy(F.xxhash64(F.col(identity), F.col("data"), F.lit(4)), identity, "data").limit(fit_rows).collect()
    chosen = sorted(drawn, key=lambda r: (str(r[identity]), bytes(r["data"])))
    return fit([bytes(r["data"]) for r in chosen], np.array([r[label] for r in chosen], np.float32))


def score_quality(
    docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5): one row per row of ``docs``.

    Null and empty texts are scored as one chunk of zero bytes. Without labels of both kinds every
    score is the share of label 1 (one half without any). Repeated rows get equal scores; further
    columns play no part; an empty table gives an empty result.
    """
    network = fit_on(docs, labels, identity, text, label, fit_rows, fit_bytes)
    own = docs.select(
        F.col(f"`{identity}`").alias("doc_id"), held_out(f"`{identity}`").alias("held_out"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"),
    )
    kind = own.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.array([network.logit(d.as_py()) for d in batch.column("data")], float)
            scores = pa.array(1 / (1 + np.exp(-np.clip(logits, -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    return own.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES,
) -> DataFrame:
    """The rows and columns of ``docs`` that the network takes for good ones; every kept value is as it came."""
    network = fit_on(docs, labels, identity, text, label, fit_rows, fit_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [network.logit((t.as_py() or "").encode("utf-8", "surrogatepass")) >= 0 for t in batch.column(text)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
