"""The whole pipeline against plain loops over a small corpus with planted copies, passages and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelcycle.llm import quality_cnn
from tests.llm.conftest import DOCUMENTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**53 + 1
LABELS = "doc_id long, quality int, toxic int"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnorstuvé") for _ in range(rng.randint(3, 8))) for _ in range(n))


def _junk(rng, n):
    return " ".join(rng.choice(("$$", "##1", "%9", "<|>", "&&", "404", "**")) + str(rng.randint(0, 99)) for _ in range(n))


def _corpus():
    """(rows of documents, rows of labels)."""
    rng = random.Random(3)
    texts = {i: _prose(rng, rng.randint(40, 400)) for i in range(1, 40)}
    texts |= {i: _junk(rng, rng.randint(40, 200)) for i in range(100, 130)}
    base = _prose(rng, 150).split()
    texts |= {200 + k: " ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 12, 3)}  # near copies
    texts |= {220 + k: texts[5] for k in range(6)}  # exact copies
    passage = _prose(rng, 60)
    texts |= {240 + k: f"{_prose(rng, 50 + 9 * k)}\n{passage}é{_prose(rng, 30)}" for k in range(5)}
    texts |= {250: texts[241][: len(texts[241]) // 2] + _prose(rng, 300), 251: "aé" * 500 + " " + _prose(rng, 20), 252: " \n ", 253: "word", BIG: _prose(rng, 80)}
    sources = ("a", "b", None, "ü", "")
    rows = [(i, t, "en", sources[(i * i) % 5], len(t)) for i, t in texts.items()]
    rows += [(None, _prose(rng, 70 + k), None, "a", None) for k in range(3)] + [(7, _prose(rng, 90), "de", "b", 1), (254, None, "en", "a", None)]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    labels = [(i, int(not 100 <= i < 130), 0) for i in texts if i % 5] + [(None, 1, 0), (999, 0, 1)]
    return rows, labels


def _logit(network, data):
    """One filter, one place and one chunk after the other."""
    positions = max(1, (len(data) + 1) // 2)
    chunk, step = quality_cnn.CHUNK_BLOCKS * quality_cnn.BLOCK, quality_cnn.STEP_BLOCKS * quality_cnn.BLOCK
    starts = [0]
    while starts[-1] + chunk < positions:
        starts.append(starts[-1] + step)
    padded = data + bytes(2 * (starts[-1] + chunk) + quality_cnn.WIDTH - len(data))
    logits = []
    for start in starts:
        peak = np.full(quality_cnn.FILTERS, -np.inf)
        for place in range(start, start + chunk):
            peak = np.maximum(peak, sum(network.filters[k][padded[2 * place + k]] for k in range(quality_cnn.WIDTH)))
        logits.append(np.maximum(peak + network.bias, 0) @ network.out)
    return float(np.mean(logits) + network.shift)


def _good(rows, labels):
    known = {i: q for i, q, _ in labels if i is not None and crc32(str(i).encode()) % 3 != 1}
    learned = sorted(((str(r[0]), (r[1] or "").encode(), known[r[0]]) for r in rows if r[0] in known), key=lambda r: r[:2])
    network = quality_cnn.fit([r[1] for r in learned], np.array([r[2] for r in learned], np.float32))
    logits = [_logit(network, (r[1] or "").encode()) for r in rows]
    assert min(map(abs, logits)) > 1e-4  # none so near that rounding decides
    return [r for r, logit in zip(rows, logits, strict=True) if logit >= 0]


def _grams(text):
    words = WORD.findall(text or "")
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _distinct(rows):
    sets, group = [_grams(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                group = [group[j] if g == group[i] else g for g in group]
    members = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        members[g].append(r)
    return [min(some, key=lambda r: (r[0] is not None, r[0] or 0)) for some in members.values()]


def _unrepeated(rows, length=corpus_pipeline.PASSAGE_BYTES):
    datas = [(r[1] or "").encode() for r in rows]
    counts = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for r, data in zip(rows, datas, strict=True):
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if counts[data[p : p + length]] > 1:
                gone[p : p + length] = True
        kept, at = [], 0
        for c in r[1] or "":
            size = len(c.encode())
            if not gone[at : at + size].any():
                kept.append(c)
            at += size
        out.append((r[0], None if r[1] is None else "".join(kept), *r[2:]))
    return out


def _targets(sizes):
    """Water-filling: shares by weight of what is left, until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: float(1 + k % 3) for k, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weights[s] for s in free)
        above = [s for s in free if left * weights[s] / total > 3 * sizes[s]]
        if not above:
            return {**capped, **{s: left * weights[s] / total for s in free}}
        for s in above:
            capped[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(capped.values())


def _copies(rows):
    """How often the mix takes each row with words."""
    words = {r: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words[r]
    copies = Counter()
    for source, target in _targets(sizes).items():
        own = [r for r in rows if r[3] == source]
        whole = int(target // sizes[source]) if sizes[source] else 0
        wanted, ahead = target - whole * sizes[source], 0
        for r in sorted(own, key=lambda r: md5("|".join(("17", "null" if r[0] is None else str(r[0]), md5((r[1] or "").encode()).hexdigest())).encode()).hexdigest()):
            copies[r] = whole + int(ahead + words[r] / 2 < wanted)
            ahead += words[r]
    return Counter({r: n for r, n in copies.items() if n and words[r]})


def _check_pieces(pieces, copies):
    """Every id of every copy lies in one piece, and sequences have no gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_id, covered = defaultdict(list), {}
    for r in copies:
        by_id[r[0]].append((r, np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")))
    for some in by_id.values():
        for r, ids in some:
            covered[r] = np.zeros(len(ids), int)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        (owner,) = [
            r for r, ids in by_id[p.doc_id] if p.doc_tokens == len(ids) and p.ids_crc32 == crc32(ids[p.start : p.start + p.length].tobytes())
        ]
        covered[owner][p.start : p.start + p.length] += 1
    assert {r: set(c) for r, c in covered.items()} == {r: {n} for r, n in copies.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = _corpus()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_stages_and_run_against_loops(spark, corpus):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    functions = [f for _, f in corpus_pipeline.STAGES]

    def told(frame):
        assert frame.columns == docs.columns
        return Counter(map(tuple, frame.collect()))

    def again(some):
        return spark.createDataFrame(list(some), DOCUMENTS)

    good = _good(rows, labels)
    assert told(functions[0](spark, docs, folder)) == Counter(good) and 0 < len(good) < len(rows)
    alone = _distinct(good)
    assert told(functions[1](spark, again(good), folder)) == Counter(alone) and len(alone) < len(good) - 8
    cut = _unrepeated(alone)
    assert told(functions[2](spark, again(alone), folder)) == Counter(cut)
    assert 5 <= sum(a[1] != c[1] for a, c in zip(alone, cut, strict=True)) < len(cut) / 2
    copies = _copies(cut)
    mixed = told(functions[3](spark, again(cut), folder))
    assert Counter({r: n for r, n in mixed.items() if WORD.search(r[1] or "")}) == copies
    assert max(copies.values()) > 1 and len(copies) < len(cut)
    _check_pieces(functions[4](spark, again(mixed.elements()), folder).collect(), mixed)
    _check_pieces(corpus_pipeline.run(spark, folder).collect(), mixed)


def test_every_stage_takes_an_empty_table(spark, corpus, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
