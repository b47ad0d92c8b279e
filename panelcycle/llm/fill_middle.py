"""Fill-in-middle transformation by piece tables.

A document is never copied while it is rearranged: it is a list of descriptors (buffer, start,
length) over two immutable buffers, its own UTF-8 bytes and the sentinels. A cut splits a
descriptor, an arrangement lists the text's descriptors in another order with sentinels between
them, and digests and texts are streamed from the descriptors. Reading back is the same in reverse:
the sentinels of an output split it into descriptors, and the inverse permutation restores the text.

Units are runs of ASCII letters and single other characters. Both are told from the bytes: a unit
starts at a letter that follows no letter, and at every byte that is neither a letter nor the
continuation of a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = 1
TEXT, SENTINELS = 0, 1
#: The sentinels, each three bytes, one after the other in their buffer.
SENTINEL_BUFFER = b"<P><S><M>"
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = (1, 0, 3), (1, 3, 3), (1, 6, 3)
#: Per form the marks and the parts (0 prefix, 1 middle, 2 suffix) that follow them.
ARRANGEMENTS = {
    "psm": ((PREFIX_MARK, 0), (SUFFIX_MARK, 2), (MIDDLE_MARK, 1)),
    "spm": ((SUFFIX_MARK, 2), (PREFIX_MARK, 0), (MIDDLE_MARK, 1)),
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that are looked at in one go.
STRIDE = 1 << 22


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


@dataclass
class PieceTable:
    """Descriptors over a text and the sentinels; the buffers are never written to."""

    text: bytes
    pieces: list[Piece]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls(text, [Piece(TEXT, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor that holds offset ``at``, which may leave an empty one."""
        for i, piece in enumerate(self.pieces):
            if at <= piece.length:
                self.pieces[i : i + 1] = [Piece(piece.buffer, piece.start, at), Piece(piece.buffer, piece.start + at, piece.length - at)]
                return
            at -= piece.length
        raise ValueError("a cut beyond the end")

    def arranged(self, form: str) -> PieceTable:
        """The three parts of a twice cut text, each behind its sentinel, in the order of the form."""
        out = []
        for mark, part in ARRANGEMENTS[form]:
            out += [Piece(*mark), self.pieces[part]]
        return PieceTable(self.text, out)

    @classmethod
    def read_back(cls, output: bytes, form: str) -> PieceTable:
        """The text of an output: its descriptors between the sentinels, permuted back."""
        if form not in ARRANGEMENTS:
            return cls.of(output)
        starts, ends, at = [], [], 0
        for (_, first, size), _ in ARRANGEMENTS[form]:
            here = output.index(SENTINEL_BUFFER[first : first + size], at)
            ends.append(here)
            at = here + size
            starts.append(at)
        ends = [*ends[1:], len(output)]
        parts = sorted((part, Piece(TEXT, a, b - a)) for (_, part), a, b in zip(ARRANGEMENTS[form], starts, ends, strict=True))
        return cls(output, [piece for _, piece in parts])

    def stream(self) -> Iterator[memoryview]:
        buffers = memoryview(self.text), memoryview(SENTINEL_BUFFER)
        for buffer, start, length in self.pieces:
            yield buffers[buffer][start : start + length]

    def digest(self) -> str:
        """sha256 of the streamed bytes, in hex."""
        state = sha256()
        for part in self.stream():
            state.update(part)
        return state.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def unit_starts(data: bytes, at: int, stop: int) -> np.ndarray:
    """Offsets in [at, stop) at which a unit starts."""
    raw = np.frombuffer(data, np.uint8)[at:stop]
    letter = _LETTER[raw]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[:1] = at > 0 and _LETTER[data[at - 1]]
    first = np.where(letter, ~before, (raw & 0xC0) != 0x80)
    return np.flatnonzero(first) + at


def count_units(data: bytes) -> int:
    return sum(len(unit_starts(data, at, at + STRIDE)) for at in range(0, len(data), STRIDE))


def offset_after(data: bytes, units: int) -> int:
    """Offset of the byte after so many units."""
    for at in range(0, len(data), STRIDE):
        starts = unit_starts(data, at, at + STRIDE)
        if units < len(starts):
            return int(starts[units])
        units -= len(starts)
    return len(data)


def characters(data: bytes) -> int:
    """Code points: the bytes that do not continue one."""
    raw = np.frombuffer(data, np.uint8)
    return sum(int(((raw[at : at + STRIDE] & 0xC0) != 0x80).sum()) for at in range(0, len(raw), STRIDE))


def _hashes(identity: str | None, seed: int) -> list[int]:
    named = sha256(f"{seed}:{'null' if identity is None else identity}".encode()).hexdigest()
    return [int(named[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(data: bytes, identity: str | None, seed: int = SEED, plain_from: int = PLAIN_FROM,
              suffix_first_below: int = SUFFIX_FIRST_BELOW) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Units, form, characters of prefix and middle, and the arranged text of one document."""
    n = count_units(data)
    first, second, chosen, turned = _hashes(identity, seed)
    table = PieceTable.of(data)
    marks = [SENTINEL_BUFFER[k : k + 3] for k in (0, 3, 6)]
    if not data or chosen % 100 >= plain_from or any(mark in data for mark in marks):
        return n, "plain", None, None, table
    low, high = sorted((offset_after(data, first % (n + 1)), offset_after(data, second % (n + 1))))
    table.cut(high)
    table.cut(low)
    form = "spm" if turned % 100 < suffix_first_below else "psm"
    return n, form, characters(data[:low]), characters(data[low:high]), table.arranged(form)


_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def fill_in_middle(docs: DataFrame, identity: str = "doc_id", text: str = "text", with_output: bool = True, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and output: one row per row of ``docs``.

    ``options``: ``seed``, ``plain_from`` and ``suffix_first_below`` (both of 100). A text that holds a
    sentinel stays plain, as does an empty one; a null text is empty; a null identity is hashed as
    ``null``. Rows of equal identity and text are transformed alike. Further columns play no part; an
    empty table gives an empty result.
    """
    own = docs.select(
        F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{identity}`").cast("string").alias("named"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"),
    )
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for named, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                *facts, table = transform(data.as_py(), named, **options)
                for column, value in zip(columns, (*facts, table.digest(), table.bytes() if with_output else None), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    done = own.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}, output binary")
    return done.withColumn("output", F.col("output").cast("string")) if with_output else done.drop("output")


def with_restored(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add restored_sha256, and with ``keep_text`` the text, rebuilt from ``output`` and ``form`` alone; drops ``output``."""
    kept = [c for c in rows.columns if c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts = [], []
            for output, form in zip(batch.column("output"), batch.column("form"), strict=True):
                table = PieceTable.read_back(output.as_py(), form.as_py())
                digests.append(table.digest())
                texts.append(table.bytes() if keep_text else None)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(digests, pa.string()), pa.array(texts, pa.binary())], [*kept, "restored_sha256", "restored"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "output")
    read = rows.withColumn("output", F.col("output").cast("binary")).mapInArrow(run, f"{schema}, restored_sha256 string, restored binary")
    return read.withColumn("restored", F.col("restored").cast("string")) if keep_text else read.drop("restored")
