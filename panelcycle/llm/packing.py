"""Bounded-space online packing of token ids into sequences of fixed length.

Each partition tokenizes its documents and keeps at most ``open_windows`` unfinished sequences. A
piece goes where it leaves the least room. When it fits nowhere, the fullest window is emitted: a
gap of ``least_cut`` ids or more is filled with the head of the piece first, a smaller one is left
as padding. Documents longer than a sequence are cut into whole sequences and a rest. What is open
at the end of a partition goes, ids and all, to a merge over ``merge_fan_in`` partitions: there the
windows are poured together without gaps, and the last one is cut at powers of two.

Space is bounded: one batch of texts and the open windows. Only the leftovers are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.llm.hashing import grouped
from panelcycle.session import materialize

END_ID = 1
SEQUENCE = 2048


class TextEncoder:
    """Ids of texts as the tokenizer file gives them.

    ``tokenizers`` decides. Where the file is a plain byte-level BPE, whose ids count its merges in
    order, the same merges go to tiktoken as ranks, which finds the same ids several times faster; it
    takes the texts of common characters, on which both libraries' patterns cut alike. All others, and
    all texts of other tokenizer files, are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Blanks, printable ASCII, Latin letters and marks, dashes and quotes.
        self.uncommon = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027]").search
        with open(path, encoding="utf-8") as file:
            self.ranked = self._ranked(json.load(file))

    @staticmethod
    def _ranked(spec: dict):
        """A tiktoken encoding of the same merges, or None if the file is no plain byte-level BPE."""
        import tiktoken

        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        # the printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(model["vocab"][token] != 256 + i for i, token in enumerate(merges)) or len(ids) != 256 + len(merges):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text, in order."""
        for text in texts:
            if self.ranked is None or self.uncommon(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.ranked.encode_ordinary(text)
            yield np.array(ids, "<u4").tobytes()


def shared_encoder(path: str) -> TextEncoder:
    """The encoder of this worker process; it outlives the task."""
    import sys

    key = f"text encoder {path}"
    held = vars(sys.modules["tokenizers"] if "tokenizers" in sys.modules else __import__("tokenizers"))
    if key not in held:
        held[key] = TextEncoder(path)
    return held[key]


class Windows:
    """The open windows of a partition; ``emit`` takes a finished one as a list of pieces."""

    def __init__(self, room: int, most_open: int, least_cut: int, emit):
        self.room, self.most_open, self.least_cut, self.emit = room, most_open, least_cut, emit
        self.by_gap: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        whole = len(ids) // 4 // self.room * self.room
        for at in range(0, whole, self.room):
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + self.room)], total)])
        start, ids = start + whole, ids[4 * whole :]
        while ids:
            length = len(ids) // 4
            at = bisect_left(self.by_gap, (length, -1))
            if at == len(self.by_gap) and len(self.by_gap) == self.most_open:
                gap, window = self.by_gap.pop(0)
                if gap >= self.least_cut:
                    self.pieces[window].append((doc, start, ids[: 4 * gap], total))
                    start, ids = start + gap, ids[4 * gap :]
                self.emit(self.pieces.pop(window))
                continue
            if at == len(self.by_gap):
                gap, window = self.room, self.opened
                self.pieces[window] = []
                self.opened += 1
            else:
                gap, window = self.by_gap.pop(at)
            self.pieces[window].append((doc, start, ids, total))
            if gap == length:
                self.emit(self.pieces.pop(window))
            else:
                insort(self.by_gap, (gap - length, window))
            return


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"]


def _rows(pieces: list[tuple], sequence: int, open_: bool, with_ids: bool) -> list[tuple]:
    rows, offset = [], 0
    for doc, start, ids, total in pieces:
        length = len(ids) // 4
        rows.append((doc, start, length, crc32(ids), total, sequence, offset, open_, ids if open_ or with_ids else None))
        offset += length
    return rows


def _pack(frames: Iterator[pd.DataFrame], path: str, room: int, most_open: int, least_cut: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    encoder, part = shared_encoder(path), TaskContext.get().partitionId()
    rows: list[tuple] = []
    sequence = part << 32
    end = np.array([END_ID], "<u4").tobytes()

    def emit(pieces: list[tuple]) -> None:
        nonlocal sequence
        rows.extend(_rows(pieces, sequence, False, with_ids))
        sequence += 1

    windows = Windows(room, most_open, least_cut, emit)
    for frame in frames:
        for at in range(0, len(frame), 512):
            some = frame.iloc[at : at + 512]
            for doc, ids in zip(some["doc_id"], encoder.encode(some["text"].tolist()), strict=True):
                ids += end
                windows.add(doc, 0, ids, len(ids) // 4)
            yield pd.DataFrame(rows, columns=_COLUMNS)
            rows.clear()
    for pieces in windows.pieces.values():
        rows.extend(_rows(pieces, sequence, True, with_ids))
        sequence += 1
    yield pd.DataFrame(rows, columns=_COLUMNS)


def _merge(frames: Iterator[pd.DataFrame], room: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    """Pours the leftover windows of a group of partitions together."""
    for (group,), leftovers in grouped(frames, ["merge_group"]):
        sequence = 1 << 62 | int(group) << 32
        queue = list(zip(leftovers["doc_id"], leftovers["start"], leftovers["ids"], leftovers["doc_tokens"], strict=True))
        left = sum(len(q[2]) // 4 for q in queue)
        size, held, free, rows = min(room, 1 << left.bit_length() - 1), [], 0, []
        free = size
        for doc, start, ids, total in queue:
            while ids:
                take = min(free, len(ids) // 4)
                held.append((doc, start, ids[: 4 * take], total))
                start, ids, free, left = start + take, ids[4 * take :], free - take, left - take
                if not free:
                    rows.extend(_rows(held, sequence, False, with_ids))
                    sequence, held = sequence + 1, []
                    free = min(room, 1 << left.bit_length() - 1) if left else 0
        yield pd.DataFrame(rows, columns=_COLUMNS)


def pack_documents(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    room: int = SEQUENCE,
    open_windows: int = 64,
    least_cut: int = 32,
    merge_fan_in: int = 32,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Every document's ids and one end id lie in exactly one piece each; offsets in a sequence run
    without gaps from 0. Sequences shorter than ``room`` are padded up to it unless their length is a
    power of two. A null or empty text has the end id alone. Repeated rows are packed as often as
    they come. Further columns play no part; an empty table gives an empty result.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[identity].dataType
    # identities pass through the workers as text: a number beside a null would lose digits there
    own = docs.select(F.col(f"`{identity}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = (
        f"doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
    )
    # written once: a second run of the tokenizer for the leftovers would cost as much as the first
    placed = materialize(
        own.mapInPandas(lambda frames: _pack(frames, path, room, open_windows, least_cut, with_ids), schema), "packed-pieces"
    )
    group = F.shiftright("sequence_id", 32 + max(merge_fan_in.bit_length() - 1, 0)).alias("merge_group")
    order = ["merge_group", "sequence_id", "offset"]
    merged = placed.where("open").select("*", group).repartition("merge_group").sortWithinPartitions(*order).mapInPandas(
        lambda frames: _merge(frames, room, with_ids), schema
    )
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    packed = placed.where("NOT open").select(*shown).unionByName(merged.select(*shown))
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
