"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (line) is hashed to a wide vector; the fingerprint of a text is the sum of the
vectors, lane by lane, modulo powers of two. Order of the paragraphs plays no part, and paragraphs
may be inserted or deleted by adding or subtracting their vectors, without the text.

The vector has two blocks:
- identity: 8 lanes modulo 2^32 from four seeded 64-bit hashes of the whole paragraph. Equal
  multisets of paragraphs have equal lanes; different ones agree with probability 2^-256.
- content: every run of five words of the paragraph is hashed, overlapping ones too (a shorter
  paragraph is one run), and a lane counts the runs whose hash has
  a certain bit set (60 lanes), beside the number of runs. With every bit read as a sign this is a
  tug-of-war sketch: the squared length of the difference of two fingerprints estimates by how many
  runs the texts differ, the squared lengths how many there are. From these comes the likeness.

Content lanes travel two to a long, 30 bits apart, so a paragraph's vector is 38 longs. A lane
takes a thousand million runs, as many as the longest text can have.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.llm.tables import array_literal, fresh_name

IDENTITY_HASHES = 4
LANE_BITS = 30
CONTENT_LONGS = 30
RUN_WORDS = 5
LOW = 0xFFFFFFFF
#: Runs are first counted in lanes of five bits, 31 at a time.
FEW_BITS, FEW = 5, 31
FEW_SET = sum(1 << k for k in range(0, 60, FEW_BITS))
FEW_LANES = FEW | FEW << LANE_BITS


def paragraphs(text: Column) -> Column:
    return F.split(text, F.lit("\n"), -1)


def _total(values: Column, part) -> Column:
    """Sum over an array of longs; no lane can overflow, texts being shorter than 2^31."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + part(h))


def _hashes(lines: Column, seed: int) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(F.lit(seed), line))


def _runs(lines: Column) -> Column:
    """Hashes of all runs of RUN_WORDS words of each line; a line of fewer words is one run."""
    words = F.filter(F.transform(lines, lambda line: F.array_remove(F.split(line, r"\s+"), "")), lambda w: F.size(w) > 0)
    hashed = F.transform(words, lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    return F.flatten(F.transform(hashed, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (RUN_WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, RUN_WORDS))
    )))


def _counted(runs: Column, place: int) -> Column:
    """For every FEW runs: how many have each bit set that lies ``place`` above a multiple of FEW_BITS."""
    starts = F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.size(runs), F.lit(FEW))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: _total(
        F.slice(runs, s, FEW), lambda h: F.shiftrightunsigned(h, place).bitwiseAND(F.lit(FEW_SET))
    ))


def _lanes_at(counts: Column, place: int) -> Column:
    """Two of the counts as two lanes."""
    return F.shiftrightunsigned(counts, place).bitwiseAND(F.lit(FEW_LANES))


def with_fingerprint(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: struct (units, lanes: array of 38 longs); null text: empty text.

    The hashes are columns of their own first, so that every lane reads them and none computes them again.
    """
    lines, runs = fresh_name(frame, "_lines"), fresh_name(frame, "_runs")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = frame.withColumn(lines, paragraphs(whole)).withColumn(runs, _runs(F.col(lines)))
    identity = []
    for seed in range(IDENTITY_HASHES):
        name = fresh_name(hashed, f"_hash{seed}")
        hashed = hashed.withColumn(name, _hashes(F.col(lines), seed))
        identity.append(_total(F.col(name), lambda h: h.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW)))
        identity.append(_total(F.col(name), lambda h: F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(LOW)))
    few = []
    for place in range(FEW_BITS):
        few.append(fresh_name(hashed, f"_few{place}"))
        hashed = hashed.withColumn(few[-1], _counted(F.col(runs), place))
    summed = hashed.withColumns({
        lines: F.array(*identity, *[
            _total(F.col(few[k % FEW_BITS]), partial(_lanes_at, place=k - k % FEW_BITS)) for k in range(CONTENT_LONGS)
        ]),
        runs: F.size(runs).cast("long"),
    })
    return summed.withColumn(out, F.struct(F.col(runs).alias("units"), F.col(lines).alias("lanes"))).select(
        *[F.col(f"`{c}`") for c in frame.columns if c != out], F.col(f"`{out}`")
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the texts' paragraphs together; with sign -1, b's paragraphs are taken out of a."""

    def added(x: Column, y: Column, i: Column) -> Column:
        return F.when(i < 2 * IDENTITY_HASHES, (x + y * F.lit(sign)).bitwiseAND(F.lit(LOW))).otherwise(x + y * F.lit(sign))

    paired = F.arrays_zip(a["lanes"].alias("x"), b["lanes"].alias("y"))
    return F.struct(
        (a["units"] + b["units"] * sign).alias("units"), F.transform(paired, lambda p, i: added(p["x"], p["y"], i)).alias("lanes")
    )


def as_text(print_: Column) -> Column:
    """Lowercase hex of the number of runs and all longs, dash between."""
    return F.array_join(F.transform(F.concat(F.array(print_["units"]), print_["lanes"]), lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone: 1 when they are equal, about the shared part of the word runs else.

    The estimate has a standard error of about 0.12 for unrelated texts; two texts without words
    are alike only if their paragraphs are equal.
    """
    mask = F.lit((1 << LANE_BITS) - 1)

    def energy(p: Column, less=None) -> Column:
        """Sum of squared signed lanes of p, or of p less another fingerprint."""

        def signed(x: Column, k: int) -> Column:
            return F.shiftrightunsigned(x, k * LANE_BITS).bitwiseAND(mask) * 2

        def squares(x: Column, y: Column) -> Column:
            units = p["units"] if less is None else p["units"] - less["units"]
            lanes = [(signed(x, k) - units if less is None else signed(x, k) - signed(y, k) - units).cast("double") for k in range(2)]
            return lanes[0] * lanes[0] + lanes[1] * lanes[1]

        other = p if less is None else less
        parts = F.zip_with(p["lanes"], other["lanes"], squares)
        return F.aggregate(F.slice(parts, 2 * IDENTITY_HASHES + 1, CONTENT_LONGS), F.lit(0.0), lambda s, x: s + x)

    both = energy(a) + energy(b)
    estimate = F.when(both > 0, F.greatest(F.lit(0.0), 1.0 - energy(a, b) / both)).otherwise(0.0)
    return F.when((a["units"] == b["units"]) & (a["lanes"] == b["lanes"]), 1.0).otherwise(F.least(estimate, F.lit(1.0)))


def cut_points(docs: DataFrame, identity: str, rows_per_range: int = 256, most: int = 65_536) -> list:
    """Identities that cut the documents into ranges of about equal counts; only this column is read."""
    n = docs.select(identity).where(F.col(identity).isNotNull()).count()
    ranges = min(most, n // rows_per_range)
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(identity, shares, 100_000).alias("cuts")).first().cuts
    return sorted(set(found))


def range_of(identity: str, cuts: list) -> Column:
    """Number of cut points not above the identity, by binary search; null: 0."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    points = array_literal(cuts, "long")

    def step(i: Column, s: Column) -> Column:
        inside = i + s <= len(cuts)
        return F.when(inside & (F.get(points, i + s - 1) <= F.col(f"`{identity}`")), i + s).otherwise(i)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def with_next(docs: DataFrame, identity: str, columns: list[str], rows_per_range: int = 256) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by identity; the last is followed by the first.

    Rows are dealt over ranges of the identity and each range is ordered by itself; the first row
    of every range also visits the range before it. Repeated identities follow each other by the
    first of ``columns``.
    """
    cuts = cut_points(docs, identity, rows_per_range)
    at, guest, firsts_at, before = (fresh_name(docs, n) for n in ("_range", "_guest", "_first_range", "_before"))
    order = [F.col(f"`{identity}`").asc_nulls_first(), *[F.col(f"`{c}`").asc_nulls_first() for c in columns[:1]]]
    placed = docs.withColumn(at, range_of(identity, cuts))

    # one row per range: its first identity, and the range before it that is not empty
    starts = placed.groupBy(at).agg(F.min(f"`{identity}`").alias("_first"), F.max(F.col(f"`{identity}`").isNull()).alias("_null"))
    starts = starts.withColumn("_first", F.when(~F.col("_null"), F.col("_first")))
    ring = Window.orderBy(at)
    last = F.max(at).over(Window.partitionBy())
    starts = starts.select(
        F.col("_first"), F.col(at).alias(firsts_at), F.coalesce(F.lag(at).over(ring), last).alias(before)
    )
    hosted = placed.join(
        F.broadcast(starts),  # at most one row per range, and ranges are bounded
        placed[at].eqNullSafe(starts[firsts_at]) & placed[f"`{identity}`"].eqNullSafe(starts["_first"]),
        "left",
    )
    # rows that share the first identity all visit: the order among them decides there as well
    visits = F.when(F.col(firsts_at).isNull(), F.array(F.struct(F.col(at).alias("r"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col(at).alias("r"), F.lit(False).alias("g")), F.struct(F.col(before).alias("r"), F.lit(True).alias("g")))
    )
    spread = hosted.withColumn("_visit", F.explode(visits)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("_visit.r").alias(at), F.col("_visit.g").alias(guest)
    )
    in_range = Window.partitionBy(at).orderBy(F.col(guest), *order)
    nexts = spread.select("*", *[F.lead(f"`{c}`").over(in_range).alias(f"next_{c}") for c in columns])
    return nexts.where(~F.col(guest)).drop(at, guest)


def edited_text(text: Column, after: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the text that follows."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - quarter), F.left(after, quarter))


def fingerprint_edits(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Returns the identity, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null texts count as empty. Further columns play no part. With one row only, the text
    that follows is the text itself. Repeated identities follow each other in the order of their texts.
    """
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    printed = with_fingerprint(own, "text", "print")
    edited = with_next(printed, "doc_id", ["text", "print"]).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    edited = with_fingerprint(edited, "edited", "edited_print")
    return edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
