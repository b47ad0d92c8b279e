"""Quality rules: a hashed n-gram log-likelihood ratio beside counts of words, symbols and repeats.

Words and word pairs are hashed into ``BUCKETS`` buckets. One pass counts them over all documents
(the raw corpus) and over the trusted ones, each task adding up its own counts first. A document's
verdict is the mean over its n-grams of log(p_trusted / p_raw), against a fixed threshold; nothing
is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.llm.hashing import windows_of, word_hashes, words_of

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
THRESHOLD = -0.08
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate((hashes, windows_of(hashes, 2))) >> np.uint64(64 - BUCKET_BITS)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for frame in frames:
        for trusted, text in zip(frame["trusted"], frame["text"], strict=True):
            counts = np.bincount(buckets_of(word_hashes(words_of(text))).astype(np.int64), minlength=BUCKETS)
            raw += counts
            if trusted:
                good += counts
    some = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": some.astype(np.int32), "raw": raw[some], "trusted": good[some]})


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more, the first one included."""
    grams = windows_of(hashes, window)
    if not len(grams):
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


_VERDICT = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "llr": pa.float64(),
}


def _judge(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            hashes = word_hashes(words_of(text))
            n = len(hashes)
            repeats = repeated_words(hashes)
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            failed = n < 20 or 100 * repeats > 30 * n
            llr = float(ratios[buckets_of(hashes).astype(np.int64)].mean()) if n else 0.0
            rows.append((
                n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                repeats, failed, not failed and llr >= threshold, llr,
            ))
        columns = zip(*rows, strict=True) if rows else ([] for _ in _VERDICT)
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, _VERDICT.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *_VERDICT])


def judge_quality(
    docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, base_failed, kept and llr: one row per row of ``docs``.

    Trusted documents: all whose identity has label 1 in ``labels``; without any the ratio is 0
    everywhere and the base rules decide. Null texts have no
    words and fail the base rules. Repeated rows get equal verdicts; further columns play no part;
    an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    good = labels.where((F.col(label) == 1) & F.col(identity).isNotNull()).select(F.col(identity).cast("string").alias("good_id")).distinct()
    # rows without an identity meet no label: they are spread by their text instead of lying together
    named = own.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), F.xxhash64("text").cast("string"))).alias("named"), "text")
    # the good ids grow with the corpus, so the join is a shuffle at every size
    flagged = named.join(good.hint("merge"), F.col("named") == F.col("good_id"), "left").select(F.col("good_id").isNotNull().alias("trusted"), "text")
    counts = flagged.mapInPandas(_count, "bucket int, raw long, trusted long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")
    ).collect()  # at most BUCKETS rows
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r.bucket], trusted[r.bucket] = r.raw, r.trusted
    ratios = np.zeros(BUCKETS)
    if trusted.sum():
        # the trusted model falls back on the raw one, as one more thousandth of its weight
        backed = (trusted + 0.001 * trusted.sum() * (raw + 1) / (raw.sum() + BUCKETS)) / (1.001 * trusted.sum())
        ratios = np.log(backed) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return own.mapInArrow(
        lambda batches: _judge(batches, ratios, threshold),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, llr double",
    )
