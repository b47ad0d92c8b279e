"""Secret scans by grammar inference.

Fixed patterns find assignments, access keys and hex strings; these are the base. Their values, with
the pattern's name as label, are the labelled credentials: a bounded sample of them, and of ordinary
long strings as the label ``none``, becomes one prefix tree a label. States of a tree that are
statistically compatible (their endings and continuations differ by no more than chance allows,
Hoeffding's bound) are merged, which leaves a probabilistic automaton of the format. Every long
string of every text is then scored: its likelihood under the best format against that under
``none``, in bits a character. Strings above a fixed score that no base pattern found are added.

Automata read symbols (digits, hex and other letters by case, each punctuation mark by itself); a
symbol's probability is shared evenly by its characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.session import materialize

#: The base patterns, over lower-cased bytes for assignments, and the least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "format")
NONE = "none"

#: Characters of a string that is scored, at least; marks at its ends that are not part of it.
LEAST_CANDIDATE, TRIMMED = 16, b"./-_"
#: Examples of a label that automata are fitted on, and the longest of them.
EXAMPLES, LONGEST_EXAMPLE = 600, 256
#: Confidence of the merging test, weight of the even share in a state's probabilities, bits a character that add a span.
ALPHA, SMOOTHING, LEAST_BITS = 0.05, 1.0, 0.5

_MARKS = b"+/_.=-"
#: Characters by symbol: digits, a-f, g-z, A-F, G-Z, then the marks.
_GROUPS = [b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", *[bytes([m]) for m in _MARKS]]
SYMBOLS = len(_GROUPS)
_SYMBOL = np.full(256, 255, np.uint8)
_SHARE = np.zeros(SYMBOLS)
for _i, _group in enumerate(_GROUPS):
    _SYMBOL[list(_group)] = _i
    _SHARE[_i] = math.log2(len(_group))
_IN_CANDIDATE = _SYMBOL != 255
STRIDE = 1 << 22


def long_runs(data: bytes, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of candidate characters with at least so many bytes."""
    raw = np.frombuffer(data, np.uint8)
    edges = [np.zeros(0, np.int64)]
    before = False
    for at in range(0, len(raw), STRIDE):
        inside = _IN_CANDIDATE[raw[at : at + STRIDE]]
        changed = np.flatnonzero(np.diff(inside, prepend=before)) + at
        before = bool(inside[-1])
        edges.append(changed)
    flat = np.concatenate([*edges, [len(raw)] if before else []]).astype(np.int64)
    starts, ends = flat[::2], flat[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def base_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes, by start, then kind. ``runs``: those of 20 characters or more.

    Access keys and hex strings lie within runs of candidate characters, so they are looked for there.
    """
    found = []
    lower = data.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        for m in ASSIGN.finditer(lower):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for a, b in runs:
            for m in pattern.finditer(data, a, b):
                if m.end() - m.start() >= LEAST[kind]:
                    found.append((kind, m.start(), m.end(), m.start(), m.end()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def candidates(data: bytes, runs: list[tuple[int, int]], base: list[tuple[str, int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a base span meets it) of every string that is scored."""
    out, next_base, furthest = [], 0, 0
    for a, b in runs:
        value = data[a:b]
        start, end = a + len(value) - len(value.lstrip(TRIMMED)), a + len(value.rstrip(TRIMMED))
        if end - start < LEAST_CANDIDATE:
            continue
        while next_base < len(base) and base[next_base][1] < end:  # base spans come by start
            furthest = max(furthest, base[next_base][2])
            next_base += 1
        out.append((start, end, furthest > start))
    return out


class Places:
    """Code points before a byte offset, asked for in ascending order."""

    def __init__(self, data: bytes):
        self.raw, self.at, self.count = np.frombuffer(data, np.uint8), 0, 0

    def of(self, offsets: list[int]) -> dict[int, int]:
        known = {}
        for offset in sorted(set(offsets)):
            for a in range(self.at, offset, STRIDE):
                self.count += int(((self.raw[a : min(offset, a + STRIDE)] & 0xC0) != 0x80).sum())
            self.at = offset
            known[offset] = self.count
        return known


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_FOUND = "array<struct<kind string, start long, end long, value binary>>"
_HELD = "array<struct<start long, end long, value binary, met boolean>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])
    held = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("met", pa.bool_())])
    for batch in batches:
        bases, scored = [], []
        for scalar in batch.column("data"):
            data = scalar.as_py()
            runs = long_runs(data, LEAST_CANDIDATE)
            base = base_spans(data, [r for r in runs if r[1] - r[0] >= LEAST["access"]])
            some = candidates(data, runs, base)
            place = Places(data).of([x for f in base for x in f[1:3]] + [x for c in some for x in c[:2]])
            bases.append([{"kind": k, "start": place[a], "end": place[b], "value": data[v:w]} for k, a, b, v, w in base])
            scored.append([{"start": place[a], "end": place[b], "value": data[a:b], "met": met} for a, b, met in some])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(scored, pa.list_(held))], ["doc_id", "base", "scored"]
        )


# ---- automata


class Automaton:
    """A probabilistic automaton over symbols: per state what follows, how often, and how often it ends."""

    def __init__(self, follow: list[dict[int, int]], passed: list[dict[int, int]], ended: list[int]):
        states = len(follow)
        self.next = np.full((states + 1, SYMBOLS), states, np.int64)  # the last state knows nothing and keeps what it is given
        self.bits = np.full((states + 1, SYMBOLS + 1), math.log2(1 / (SYMBOLS + 1)))
        for s in range(states):
            counts = np.zeros(SYMBOLS + 1)
            for symbol, to in follow[s].items():
                self.next[s, symbol] = to
                counts[symbol] = passed[s][symbol]
            counts[SYMBOLS] = ended[s]
            self.bits[s] = np.log2((counts + SMOOTHING / (SYMBOLS + 1)) / (counts.sum() + SMOOTHING))

    @property
    def states(self) -> int:
        return len(self.next) - 1

    def log2(self, value: bytes) -> float:
        """Logarithm of the probability of one string."""
        symbols = _SYMBOL[np.frombuffer(value, np.uint8)]
        state, total = 0, 0.0
        nexts, bits = self.next, self.bits
        for symbol in symbols.tolist():
            total += bits[state, symbol]
            state = nexts[state, symbol]
        return float(total + bits[state, SYMBOLS] - _SHARE[symbols].sum())


def prefix_tree(examples: Counter) -> tuple[list[dict[int, int]], list[dict[int, int]], list[int]]:
    """Per state: what follows, how often each was taken, how many strings end there."""
    follow: list[dict[int, int]] = [{}]
    passed: list[dict[int, int]] = [{}]
    ended = [0]
    for value, count in sorted(examples.items()):
        state = 0
        for symbol in _SYMBOL[np.frombuffer(value, np.uint8)].tolist():
            if symbol not in follow[state]:
                follow[state][symbol] = len(follow)
                passed[state][symbol] = 0
                follow.append({})
                passed.append({})
                ended.append(0)
            passed[state][symbol] += count
            state = follow[state][symbol]
        ended[state] += count
    return follow, passed, ended


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Whether two shares differ by more than chance allows."""
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


def infer(examples: Counter, alpha: float = ALPHA) -> Automaton:
    """The automaton left after merging the compatible states of the examples' prefix tree.

    States are taken in breadth-first order and merged with the first settled state they are
    compatible with, or settled themselves; a merge folds the one's subtree into the other's.
    """
    follow, passed, ended = prefix_tree(examples)

    def weight(state: int) -> int:
        return ended[state] + sum(passed[state].values())

    def compatible(a: int, b: int) -> bool:
        open_ = [(a, b)]
        while open_:
            x, y = open_.pop()
            n1, n2 = weight(x), weight(y)
            if not n1 or not n2:
                continue
            if _differ(ended[x], n1, ended[y], n2, alpha):
                return False
            for symbol in passed[x].keys() | passed[y].keys():
                if _differ(passed[x].get(symbol, 0), n1, passed[y].get(symbol, 0), n2, alpha):
                    return False
                if symbol in follow[x] and symbol in follow[y]:
                    open_.append((follow[x][symbol], follow[y][symbol]))
        return True

    def fold(into: int, state: int) -> None:
        open_ = [(into, state)]
        while open_:
            x, y = open_.pop()
            ended[x] += ended[y]
            for symbol, to in follow[y].items():
                count = passed[y][symbol]
                if symbol in follow[x]:
                    passed[x][symbol] += count
                    open_.append((follow[x][symbol], to))
                else:
                    follow[x][symbol], passed[x][symbol] = to, count

    settled = [0]
    settled_set = {0}
    while True:
        at = next(((s, symbol) for s in settled for symbol in sorted(follow[s]) if follow[s][symbol] not in settled_set), None)
        if at is None:
            break
        source, symbol = at
        state = follow[source][symbol]
        match = next((s for s in settled if compatible(s, state)), None)
        if match is None:
            settled.append(state)
            settled_set.add(state)
        else:
            follow[source][symbol] = match
            fold(match, state)
    place = {s: i for i, s in enumerate(settled)}
    return Automaton([{k: place[to] for k, to in follow[s].items()} for s in settled], [passed[s] for s in settled], [ended[s] for s in settled])


class Formats:
    """The automata of the labels beside that of ordinary strings.

    Strings that no pattern labelled may still be credentials. Those that a format explains better
    than the first automaton of ``none`` does are left out of its second one.
    """

    def __init__(self, labelled: dict[str, Counter], alpha: float = ALPHA):
        self.known = {label: infer(values, alpha) for label, values in sorted(labelled.items()) if values and label != NONE}
        plain = labelled.get(NONE) or Counter()
        self.none = infer(plain, alpha)
        self.none = infer(Counter({v: n for v, n in plain.items() if self.score(v)[0] <= 0}), alpha)

    def score(self, value: bytes) -> tuple[float, str | None]:
        """Bits a character by which the likeliest format explains the string better than ``none``, and its label."""
        if not self.known:
            return -math.inf, None
        best, label = max((automaton.log2(value), label) for label, automaton in self.known.items())
        return (best - self.none.log2(value)) / (len(value) + 1), label


def labelled_examples(found: DataFrame, examples: int = EXAMPLES, longest: int = LONGEST_EXAMPLE) -> dict[str, Counter]:
    """Per label at most ``examples`` distinct values of at most ``longest`` bytes, drawn by their hash.

    ``found`` holds ``base`` and ``scored``. Distinct values, so copies of a document teach nothing twice.
    """
    short = F.octet_length("value").between(1, longest)
    named = found.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("label"), F.col("b.value").alias("value"))
    plain = found.select(F.explode("scored").alias("s")).where("NOT s.met").select(F.lit(NONE).alias("label"), F.col("s.value").alias("value"))
    values = named.unionByName(plain).where(short).distinct()
    out = {}
    for label in (*LEAST, NONE):
        drawn = values.where(F.col("label") == label).orderBy(F.xxhash64("value", F.lit(11)), "value").limit(examples)
        out[label] = Counter({bytes(r.value): 1 for r in drawn.select("value").collect()})
    return out


def scan_secrets(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    formats: Formats | None = None,
    examples: int = EXAMPLES,
    least_bits: float = LEAST_BITS,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found: one row per row of ``docs``.

    ``found`` lists kind, start, end (code points, end exclusive), label and bits of every span, by
    start and kind; kind ``format`` marks those that the automata add. ``formats`` may come from other
    data; else it is fitted on the corpus' own base values, at most ``examples`` a label. Without any
    base value nothing is added. Null and empty texts have no spans; repeated rows have equal ones.
    Further columns play no part; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    kind = own.schema["doc_id"].dataType.simpleString()
    # texts are read once; what is learned from and scored are the few strings found in them
    found = materialize(own.mapInArrow(_find, f"doc_id {kind}, base {_FOUND}, scored {_HELD}"), "secret-strings")
    learned = formats or Formats(labelled_examples(found, examples))  # a few thousand states at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("bits", pa.float64())])
        for batch in batches:
            rows = []
            for base, scored in zip(batch.column("base").to_pylist(), batch.column("scored").to_pylist(), strict=True):
                spans = [(b["kind"], b["start"], b["end"], b["kind"], None) for b in base]
                for c in scored:
                    if not c["met"]:
                        bits, label = learned.score(c["value"])
                        if bits >= least_bits:
                            spans.append(("format", c["start"], c["end"], label, bits))
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                counts = Counter(b["kind"] for b in base)
                told = written([s[:3] for s in spans if s[0] != "format"])
                rows.append((
                    counts["assign"], counts["access"], counts["hex"], sha256(told.encode()).hexdigest(), written([s[:3] for s in spans]),
                    [dict(zip(("kind", "start", "end", "label", "bits"), s, strict=True)) for s in spans],
                ))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(span))
            columns = zip(*rows, strict=True) if rows else ([] for _ in types)
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names)

    return found.mapInArrow(
        score,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "found array<struct<kind string, start long, end long, label string, bits double>>",
    )
