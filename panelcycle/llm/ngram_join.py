"""N-gram Jaccard join by MinHash banding.

Texts are sets of hashed runs of five words. Rows per band and the number of bands are chosen so
that a pair at the threshold is missed with less than a stated probability. Texts with equal sets
form one class; only one member of a class is compared. Classes that agree in all rows of a band
share a bucket, and every pair of classes within a bucket is verified on the full n-gram sets.

- Buckets with the same members are looked at once; a pair that meets in several buckets counts
  only in the first of them, which both sides can tell from their own lists of buckets.
- A bucket of any size is split into blocks of about ``BLOCK`` classes, and every pair of blocks is
  a task's work of its own. A block gives one row per class: its number of links there and one link
  that keeps connected members connected. Pairs are counted, never listed, and none is left out.
- Groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.llm.components import connected
from panelcycle.llm.hashing import grouped, mix64, windows_of, word_hashes, words_of
from panelcycle.llm.tables import join_by_weight
from panelcycle.session import materialize

#: Classes in a block: a block pair's sets and its 256 x 256 counts stay in a few MB.
BLOCK = 256


def bands_for(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which few enough hashes reach the recall at the threshold."""
    best = (most_hashes, 1)
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (max(bands, 1), rows)
    return best


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a shorter text is one run of all its words."""
    hashes = word_hashes(words_of(text))
    if 0 < len(hashes) < n:
        return windows_of(hashes, len(hashes))
    return np.unique(windows_of(hashes, n))


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    factors = _multipliers(bands * rows)[:, None]
    shifts = np.random.default_rng(8).integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
    for batch in batches:
        keys, sizes, signed = [], [], []
        for text in batch.column("text").to_pylist():
            grams = ngram_set(text, n)
            keys.append(blake2b(grams.tobytes(), digest_size=16).digest())
            sizes.append(len(grams))
            if not len(grams):
                signed.append(None)
                continue
            short = (grams >> np.uint64(32)).astype(np.uint32)
            least = np.full((bands * rows, 1), 0xFFFFFFFF, np.uint32)
            for at in range(0, len(short), 4096):
                np.minimum(least, (short[at : at + 4096] * factors + shifts).min(axis=1, keepdims=True), out=least)
            rows_of = least.reshape(bands, rows).astype(np.uint64)
            band = np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                band = mix64(band + rows_of[:, r])
            signed.append(band.view(np.int64))
        made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signed, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *made], ["doc_id", "text_key", "set_key", "n", "bands"])


def _sets(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        grams = [ngram_set(t, n).tobytes() for t in frame["text"]]
        yield frame.drop(columns="text").assign(grams=grams)


def _verify(frames: Iterator[pd.DataFrame], bands: int, threshold: float) -> Iterator[pd.DataFrame]:
    """One row per class of a block pair that has a link there."""
    found: list[tuple] = []
    for (band, _, low, high), group in grouped(frames, ["band", "bucket", "low", "high"]):
        part = group["part"].to_numpy()
        left = np.flatnonzero(part == low)
        right = left if low == high else np.flatnonzero(part == high)
        if not len(left) or not len(right) or len(group) < 2:
            continue
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        sizes = np.array([len(s) for s in sets])
        names, copies = group["set_key"].to_numpy(), group["copies"].to_numpy()
        own = np.zeros((len(group), bands), np.int64)
        for i, (at, value) in enumerate(zip(group["kept_bands"], group["kept_buckets"], strict=True)):
            own[i, np.asarray(at)] = value
        earlier = np.zeros((len(left), len(right)), bool)
        for b in range(band):  # a pair that met in an earlier bucket was counted there
            x, y = own[left, b], own[right, b]
            earlier |= (x[:, None] == y[None, :]) & (x != 0)[:, None]
        common = _common(sets, left, right)
        total = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (common >= threshold * total - 1e-9) & ~earlier & (left[:, None] != right[None, :])
        count = np.zeros(len(group), np.int64)
        count[left] += (linked * copies[right][None, :]).sum(axis=1)
        if low != high:
            count[right] += (linked * copies[left][:, None]).sum(axis=0)
        parent = list(range(len(group)))

        def root(i: int, parent=parent) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = root(left[i]), root(right[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
        found += [(names[i], int(count[i]), names[root(i)]) for i in np.flatnonzero(count)]
        if len(found) > 4096:
            yield pd.DataFrame(found, columns=["set_key", "links", "towards"])
            found = []
    yield pd.DataFrame(found, columns=["set_key", "links", "towards"])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.bincount(place, minlength=len(values)) > 1  # a run that only one set has is in no intersection
    keep = shared[place]
    place, owner = np.cumsum(shared)[place[keep]] - 1, owner[keep]
    step = 4096
    cuts = np.searchsorted(place, np.arange(0, place[-1] + 1 + step, step)) if len(place) else np.zeros(1, int)
    for k in range(len(cuts) - 1):
        some, who = place[cuts[k] : cuts[k + 1]] - k * step, owner[cuts[k] : cuts[k + 1]]
        dense = np.zeros((len(sets), step), np.float32)
        dense[who, some] = 1
        out += dense[left] @ dense[right].T
    return out.astype(np.int64)


def jaccard_groups(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """(doc_id, text_key, copy_class, class_id, n_links, copy_key, group_key): one row per row of ``docs``.

    copy_class is the smallest identity with the same n-gram set, class_id the smallest identity of
    the group of linked documents. Unlike sets or groups have the same ones where identities are null
    or repeated; copy_key and group_key, hashes in hex, are one for each set and each group whatever
    the identities. n_links is the number of other rows whose n-gram set has a Jaccard
    similarity of ``threshold`` or more. text_key is a hash of the text. A text of fewer than n words
    is one n-gram of all its words. Texts without words (null, empty, blank) equal each other and
    nothing else. Null identities sort first. Further columns play no part; an empty table gives an
    empty result.
    """
    bands, rows = bands_for(threshold, recall)
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    signed = materialize(
        own.select("doc_id", "text_key", "text").mapInArrow(
            lambda batches: _sign(batches, n, bands, rows),
            f"doc_id {kind}, text_key long, set_key binary, n int, bands array<long>",
        ),
        "ngram-signatures",
    )
    # one row per set; the copies combine before the shuffle
    classes = materialize(
        signed.groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key", "bands")).alias("first"), F.count(F.lit(1)).alias("copies")
        ).select("set_key", "copies", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), F.col("first.bands").alias("bands")),
        "ngram-classes",
    )
    spread = classes.select("set_key", F.posexplode("bands").alias("band", "bucket"))
    member = F.shiftright(F.xxhash64("set_key"), 16)
    buckets = spread.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum(member).alias("s1"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("s2")
    ).where("m > 1")
    kept = materialize(
        buckets.groupBy("m", "s1", "s2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("m", "b.band", "b.bucket"), "ngram-buckets"
    )
    listed = spread.join(kept, ["band", "bucket"]).groupBy("set_key").agg(
        F.sort_array(F.collect_list(F.struct("band", "bucket", "m"))).alias("kept")  # at most one per band
    )
    wanted = classes.select("set_key", "copies", "rep", "rep_key").join(listed, "set_key")
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["rep"]) & (own["text_key"] == wanted["rep_key"])).dropDuplicates(["set_key"])
    with_sets = texts.select("set_key", "copies", "kept", "text").mapInPandas(
        lambda frames: _sets(frames, n),
        "set_key binary, copies long, kept array<struct<band int, bucket long, m long>>, grams binary",
    )
    blocks = F.ceil(F.col("b.m") / BLOCK).cast("int")
    met = with_sets.select(
        "set_key", "copies", "grams", F.col("kept.band").alias("kept_bands"), F.col("kept.bucket").alias("kept_buckets"),
        F.explode("kept").alias("b"),
    ).withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("b.band").alias("band"), F.col("b.bucket").alias("bucket"), F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"), "part", "set_key", "copies", "grams", "kept_bands", "kept_buckets",
    )
    block = ["band", "bucket", "low", "high"]
    verified = materialize(
        met.repartition(*block).sortWithinPartitions(*block).mapInPandas(
            lambda frames: _verify(frames, bands, threshold), "set_key binary, links long, towards binary"
        ),
        "ngram-verified",
    )
    roots = connected(verified.select(F.col("set_key").alias("a"), F.col("towards").alias("b")))
    links = verified.groupBy("set_key").agg(F.sum("links").alias("links"))
    grouped_classes = materialize(
        classes.select("set_key", "copies", "rep").join(links, "set_key", "left").join(
            roots.withColumnRenamed("node", "set_key"), "set_key", "left"
        ).withColumn("root", F.coalesce("root", "set_key")),
        "ngram-roots",
    )
    smallest = materialize(grouped_classes.groupBy("root").agg(F.min(F.struct("rep")).alias("least"), F.count(F.lit(1)).alias("members")), "ngram-least")
    heavy = F.col("members") >= max(1000, grouped_classes.count() // 1000)
    answers = materialize(
        join_by_weight(grouped_classes, smallest, ["root"], heavy).select(
            "set_key", F.col("rep").alias("copy_class"), F.col("least.rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.hex("set_key").alias("copy_key"), F.hex("root").alias("group_key"),
        ),
        "ngram-answers",
    )
    return signed.select("doc_id", "text_key", "set_key").join(answers, "set_key").select(
        "doc_id", "text_key", "copy_class", "class_id", "n_links", "copy_key", "group_key"
    )


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` less all but one row of every group: the one of the smallest identity stays."""
    groups = jaccard_groups(docs, **options)
    identity, text = options.get("identity", "doc_id"), options.get("text", "text")
    chosen = groups.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key")).alias("keep")).select(
        F.col("keep.doc_id").alias("_kept_id"), F.col("keep.text_key").alias("_kept_key")
    )
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    stay = keyed.join(chosen, keyed[f"`{identity}`"].eqNullSafe(chosen["_kept_id"]) & (keyed["_text_key"] == chosen["_kept_key"]))
    return stay.dropDuplicates(["_kept_id", "_kept_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
