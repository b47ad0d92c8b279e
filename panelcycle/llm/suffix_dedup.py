"""Exact removal of repeated byte strings by bucket-pointer refinement of a sampled suffix array.

A byte goes when it lies in a string of ``length`` bytes that starts anywhere else as well. The
suffixes are put in buckets by their first q bytes, and buckets are refined by the identifiers of
the buckets at later offsets, as in bucket-pointer refinement; a bucket of one suffix is finished.
An identifier stands for the content of its bucket, so equal strings have equal ones everywhere.

- Only sampled suffixes become rows. Every window of ``length`` bytes names as its anchor the
  q-gram in it with the least identifier (the leftmost of equals). That depends on the window's
  bytes alone, so equal windows have anchors at equal offsets: buckets of anchors lose no match.
  There is about one anchor per (length - q) / 2 bytes.
- Consecutive windows with one anchor form a stretch. First round: stretches whose q-gram bucket
  has one member are unique. Second round, by the identifier of the whole stretch: stretches that
  occur twice are repeated in all their windows, and one of them stands for all in what follows.
- Last round, only for buckets that hold different stretches: every window in them gets its
  identifier from those of q, 2q, .. bytes at later offsets, each made from pairs of the one before
  (updates are reused), and windows whose refined bucket has two members are repeated.
  A bucket with more than ``LARGE_BUCKET`` different stretches is refined by a shuffle on the
  window's identifier, with sums formed before it, instead of within one task.
- Several lengths are searched at once: they share q-grams, tables and shuffles. Texts that have
  nothing to refine, or nothing to remove, are kept out of the shuffles by a broadcast bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcycle.llm.tables import fresh_name, join_by_weight, keyed, with_filter
from panelcycle.session import materialize

GRAM = 128
SEGMENT = 1 << 19
LARGE_BUCKET = 8192
#: A passage of 50 short words is some 250 bytes long; strings of this length inside it repeat with it.
PASSAGE_BYTES = 200
_ODD = np.uint64(0x9E3779B97F4A7C15)
_IN_SEGMENT = np.uint64((1 << 20) - 1)
REMOVED = ["n_removed", "n_spans", "kept"]
PASSAGES = ["n_passage_bytes", "n_passages", "without_passages"]


def _gram(length: int) -> int:
    """About a third of the length, at most ``GRAM``."""
    return max(8, min(GRAM, length // 3))


def _byte_ids() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _refine(ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of longer strings from those of a head and of what follows it."""
    out = ids * _ODD
    out += later
    out ^= out >> np.uint64(32)
    return out


def string_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifier of every string of ``length`` bytes, by doubling; odd parts are added at the end."""
    ids, have = _byte_ids()[data], 1
    done, out = 0, None
    while True:
        if length & have:
            out = ids if out is None else _refine(out[: len(ids) - done], ids[done:])
            done += have
        if done == length or len(ids) <= have:
            return out if done == length else np.empty(0, np.uint64)
        ids, have = _refine(ids[:-have], ids[have:]), have * 2


def stretches(data: np.ndarray, lengths: Sequence[int], gram: int) -> list[np.ndarray]:
    """Length, first window, last window and bucket (identifier of anchor and length) of every stretch; lengths ascend."""
    parts = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(data) - lengths[0] + 1, SEGMENT):  # a long text is walked in segments; a stretch ends with its segment
        ids = string_ids(data[at : at + SEGMENT + lengths[-1] - 1], gram)
        least = (ids & ~_IN_SEGMENT) | np.arange(len(ids), dtype=np.uint64)
        have = 1
        for length in lengths:
            windows, span = min(SEGMENT, len(data) - length + 1 - at), length - gram + 1
            if windows < 1:
                break
            while have * 2 <= span:
                least, have = np.minimum(least[:-have], least[have:]), have * 2
            anchor = (np.minimum(least[:windows], least[span - have : span - have + windows]) & _IN_SEGMENT).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            last = np.concatenate((first[1:] - 1, [windows - 1]))
            bucket = _refine(ids[anchor[first]], np.uint64(length)).view(np.int64)
            parts.append((np.full(len(first), length, np.int32), first + at, last + at, bucket))
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _anchored(frames: Iterator[pd.DataFrame], lengths: Sequence[int], gram: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        held: list[tuple] = []
        size = 0
        for key, data in zip(zip(frame["k1"], frame["k2"], strict=True), frame["data"], strict=True):
            if len(data) < lengths[0]:
                continue
            length, first, last, bucket = stretches(np.frombuffer(data, np.uint8), lengths, gram)
            spans = zip(first.tolist(), (last + length).tolist(), strict=True)
            digests = b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in spans])
            held.append((*key, length, first, last, bucket, np.frombuffer(digests, np.int64)))
            size += len(first)
            if size > 200_000:
                yield _stretch_rows(held)
                held, size = [], 0
        if held:
            yield _stretch_rows(held)


def _stretch_rows(held: list[tuple]) -> pd.DataFrame:
    counts = [len(h[2]) for h in held]
    columns = {name: np.repeat(np.array([h[i] for h in held], np.int64), counts) for i, name in enumerate(("k1", "k2"))}
    for i, name in enumerate(("length", "first", "last", "bucket", "stretch"), start=2):
        columns[name] = np.concatenate([h[i] for h in held])
    return pd.DataFrame(columns)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the stretches that have to be refined."""
    names = ["bucket", "copies", "kinds", "k1", "k2", "length", "first", "bytes"]
    for frame in frames:
        rows = []
        for k1, k2, data, wanted in zip(frame["k1"], frame["k2"], frame["data"], frame["wanted"], strict=True):
            for w in wanted:
                piece = data[w["first"] : w["last"] + w["length"]]
                rows.append((w["bucket"], w["copies"], w["kinds"], k1, k2, w["length"], w["first"], piece))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def _windows(group: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifier, row and offset of every window of the group's stretches."""
    sizes = np.array([len(b) for b in group["bytes"]])
    ids = string_ids(np.frombuffer(b"".join(group["bytes"]), np.uint8), length)
    counts = sizes - length + 1
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(group)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return ids[starts[row] + offset], row, offset


def _whole_buckets(frames: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    """Frames of some ``rows`` rows out of a stream sorted by bucket; no bucket lies in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for at in range(0, len(frame), rows):
            held.append(frame.iloc[at : at + rows])
            bucket = held[-1]["bucket"].to_numpy()
            if len(held) > 1 and held[-2]["bucket"].iloc[-1] != bucket[0]:
                yield pd.concat(held[:-1], ignore_index=True)
                held = held[-1:]
            ends = np.flatnonzero(bucket != bucket[-1])
            if len(ends):
                last = held.pop()
                yield pd.concat([*held, last.iloc[: ends[-1] + 1]], ignore_index=True)
                held = [last.iloc[ends[-1] + 1 :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows of the stretches that occur once, whole buckets at a time.

    Equal windows have equal anchors, so those of unlike buckets never have one identifier.
    """
    for frame in _whole_buckets(frames):
        for length, group in frame.groupby("length", sort=False):
            ids, row, offset = _windows(group, length)
            copies = group["copies"].to_numpy()
            order = np.argsort(ids)
            begin = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
            members = np.add.reduceat(copies[row[order]], begin)
            again = np.zeros(len(ids), bool)
            again[order] = np.repeat(members > 1, np.diff(np.append(begin, len(ids))))
            hit = np.flatnonzero(again & (copies[row] == 1))
            if not len(hit):
                continue
            row, place = row[hit], group["first"].to_numpy()[row[hit]] + offset[hit]
            begin = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)))
            end = np.concatenate((begin[1:], [True]))
            owner = row[begin]
            yield pd.DataFrame({
                "k1": group["k1"].to_numpy()[owner], "k2": group["k2"].to_numpy()[owner], "length": length,
                "first": place[begin], "last": place[end],
            })


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window as a row, for buckets too large for one task."""
    for frame in frames:
        for length, same in frame.groupby("length", sort=False):
            for at in range(0, len(same), 256):
                group = same.iloc[at : at + 256]
                ids, row, offset = _windows(group, length)
                yield pd.DataFrame({
                    "bucket": group["bucket"].to_numpy()[row], "window": ids.view(np.int64), "copies": group["copies"].to_numpy()[row],
                    "k1": group["k1"].to_numpy()[row], "k2": group["k2"].to_numpy()[row], "length": length,
                    "first": group["first"].to_numpy()[row] + offset,
                })


def removed_mask(n: int, runs, length: int) -> np.ndarray:
    """Which of n bytes are covered by the windows of the runs (first, last)."""
    step = np.zeros(n + 1, np.int32)
    for run in runs:
        step[run["first"]] += 1
        step[min(run["last"] + length, n)] -= 1
    return np.cumsum(step[:n]) > 0


def cleaned(data: bytes, runs, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, spans they form, and what is left."""
    if not runs:
        return 0, 0, data
    gone = removed_mask(len(data), runs, length)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


def _cleaned(batches: Iterator[pa.RecordBatch], lengths: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """``lengths``: column of runs and length of its strings."""
    kinds = (pa.int64(), pa.int64(), pa.binary())
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # few texts at once
        texts = [data.as_py() for data in batch.column("data")]
        arrays = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64())]
        for name, length in lengths.items():
            rows = [cleaned(t, runs.as_py(), length) for t, runs in zip(texts, batch.column(name), strict=True)]
            columns = zip(*rows, strict=True)
            arrays += [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", *REMOVED, *PASSAGES][: len(arrays)])


def row_key(identity: str, data: Column) -> list[Column]:
    """Two hashes of 64 bits each over identity and text: rows of unlike keys are told apart, a null identity from all others."""
    named = keyed(identity)
    return [F.xxhash64(F.lit(part), named, data).alias(f"k{part}") for part in (1, 2)]


def _keyed(docs: DataFrame, identity: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{identity}`").alias("doc_id"), *row_key(identity, data), data.alias("data"))


def repeated_runs(own: DataFrame, lengths: Sequence[int], gram: int = GRAM, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """(k1, k2, length, first, last): runs of windows that occur elsewhere, of every length. ``own``: k1, k2, data.

    Lengths are searched together: a stretch's bucket tells its length, so those of unlike lengths never meet.
    """
    lengths = sorted({*lengths})
    found = materialize(
        own.where(F.octet_length("data") >= lengths[0]).select("k1", "k2", "data").mapInPandas(
            lambda frames: _anchored(frames, lengths, gram), "k1 long, k2 long, length int, first int, last int, bucket long, stretch long"
        ),
        "suffix-anchors",
    )
    heavy = max(1000, found.count() // 1000)
    # first round: buckets of one member are done; second round: buckets of one stretch are done
    shared = materialize(
        found.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("members"), F.min("stretch").alias("least"), F.max("stretch").alias("most")
        ).where("members > 1").select("bucket", "members", (F.col("least") == F.col("most")).alias("pure")),
        "suffix-buckets",
    )
    met = materialize(join_by_weight(found, shared, ["bucket"], F.col("members") >= heavy).drop("members"), "suffix-members")
    run = ["k1", "k2", "length", "first", "last"]
    whole = met.where("pure").select(*run)
    mixed = met.where("NOT pure")
    kinds = materialize(
        mixed.groupBy("bucket", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*run)).alias("one")),
        "suffix-kinds",
    )
    sizes = materialize(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")), "suffix-sizes")
    open_ = materialize(
        join_by_weight(kinds, sizes, ["bucket"], F.col("kinds") >= heavy).select("bucket", "stretch", "copies", "kinds", "one.*"), "suffix-open"
    )
    repeated = open_.where("copies > 1").select("bucket", "stretch", "copies")
    again = join_by_weight(mixed, repeated, ["bucket", "stretch"], F.col("copies") >= heavy).select(*run)
    # last round: one of each stretch, with its bytes
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "copies", "kinds", "length", "first", "last")).alias("wanted"))
    # equal rows hold the same bytes, one of them is enough
    texts = with_filter(own.select("k1", "k2", "data"), "k1", open_.select("k1"), "near").where("near").drop("near")
    cut = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).mapInPandas(
        _cut, "bucket long, copies long, kinds long, k1 long, k2 long, length int, first int, bytes binary"
    )
    refined = cut.where(F.col("kinds") <= large_bucket).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
        _within, "k1 long, k2 long, length int, first int, last int"
    )
    if open_.where(F.col("kinds") > large_bucket).limit(1).count():
        windows = materialize(
            cut.where(F.col("kinds") > large_bucket).mapInPandas(
                _spread, "bucket long, window long, copies long, k1 long, k2 long, length int, first int"
            ),
            "suffix-windows",
        )
        twice = windows.groupBy("bucket", "window").agg(F.sum("copies").alias("members")).where("members > 1")
        single = windows.where("copies = 1").join(twice.select("bucket", "window"), ["bucket", "window"], "left_semi")
        refined = refined.unionByName(single.select("k1", "k2", "length", "first", F.col("first").alias("last")))
    return whole.unionByName(again).unionByName(refined)


def remove_repeats(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", length: int = 400, passage: int | None = None,
    gram: int | None = None, **sizes,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per row of ``docs``; kept: the remaining bytes.

    Null texts are empty; texts shorter than ``length`` stay whole. Strings are judged on the input,
    matches never cross texts but may overlap within one. Rows with equal identities are told apart
    by their texts; rows equal in both are repeats of each other. Further columns play no part; an
    empty table gives an empty result.

    ``passage`` is a second length, searched along with the first: n_passage_bytes, n_passages and
    without_passages say for it what n_removed, n_spans and kept say for ``length``.
    """
    lengths = {"runs": length} | ({"passages": passage} if passage else {})
    own = _keyed(docs, identity, text)
    kind = own.schema["doc_id"].dataType.simpleString()
    runs = repeated_runs(own, [*lengths.values()], gram or _gram(min(lengths.values())), **sizes)
    spans = [F.collect_set(F.when(F.col("length") == n, F.struct("first", "last"))).alias(name) for name, n in lengths.items()]
    found = materialize(runs.groupBy("k1", "k2").agg(*spans), "suffix-runs")
    # rows without repeats, most as a rule, are not shuffled
    own = with_filter(own, "k1", found.select("k1"), "near")
    none = [F.lit(None).cast(found.schema[name].dataType).alias(name) for name in lengths]
    rows = own.where("near").join(found, ["k1", "k2"], "left").select("doc_id", "data", *lengths)
    rows = rows.unionByName(own.where("NOT near").select("doc_id", "data", *none))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    if passage:
        schema += ", n_passage_bytes long, n_passages long, without_passages binary"
    return rows.mapInArrow(lambda batches: _cleaned(batches, lengths), schema)


def without_repeats(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", length: int = 400, gram: int | None = None
) -> DataFrame:
    """The rows and columns of ``docs`` with the repeated strings cut from their texts.

    ``gram`` is about a third of ``length`` by default, at most ``GRAM``. A character that loses some of
    its bytes goes as a whole. Null texts stay null, and every other column is as it came.
    """
    gram = gram or _gram(length)
    own = _keyed(docs, identity, text)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    runs_name = fresh_name(docs, "_runs")
    first, second = (fresh_name(docs, f"_k{part}") for part in (1, 2))
    runs = repeated_runs(own, [length], gram).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias(runs_name))
    runs = runs.withColumnsRenamed({"k1": f"{first}_of", "k2": f"{second}_of"})
    rows = docs.withColumns(dict(zip((first, second), row_key(identity, data), strict=True)))
    same = (F.col(first) == F.col(f"{first}_of")) & (F.col(second) == F.col(f"{second}_of"))
    joined = rows.join(runs, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs_name)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, runs in zip(batch.column(at), batch.column(runs_name), strict=True):
                kept, spans = value.as_py(), runs.as_py()
                if kept and spans:
                    kept = cleaned(kept.encode("utf-8", "surrogatepass"), spans, length)[2].decode("utf-8", "ignore")
                texts.append(kept)
            columns = [batch.column(i) for i in range(len(docs_columns))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(clean, docs.schema)
