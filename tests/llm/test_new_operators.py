"""Secret scans, ranked search and fill-in-middle against brute force, and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcycle.llm import (
    chat_format, fill_middle, fingerprints, license_scan, mixing, ngram_join, packing, quality_cnn, quality_llr, ranked_search, secret_scan, sharding,
    suffix_dedup, tables,
)
from panelcycle.llm.queries import LLM_QUERIES

BIG = 2**53 + 1
WORDS = "the of and tion heit lich".split()
SURE = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT"


# ---- op11

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
}


def _base(text):
    spans = []
    for at, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(spans)


def _check_base(rows, texts):
    for r in rows:
        spans = _base(texts[r["doc_id"]] or "")
        counts = Counter(s[3] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        told = [s[2] for s in spans]
        assert r["base_sha256"] == sha256(",".join(told).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format:")] == told


def test_op11_base_spans(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = [r.asDict() for r in LLM_QUERIES["op11_secret_scan"](spark, larger).collect()]
    assert len(rows) == len(texts) and any(r["n_assign"] for r in rows)
    _check_base(rows, texts)


def test_op11_hostile_texts(docs_of):
    h = "0123456789abcdef"
    texts = [
        None, "", "secret=token:abcdefgh", "TOKEN = 'abcdef' PassWord:x12345", "tokeN\"   :   \"é" + h * 2, "ſecret=abcdefgh", "secreKey=abcdefgh",
        f"é{h * 2}é AKIA{'A1' * 8} AKIAAKIA{'Z' * 12}x AKIASHORT", f"api_key={h * 3} apikey: {h * 3}.", "password=token=abcdef", "token:",
        "secret" + " " * 50_000 + "= abcdef", h * 200_000, "passwd='" + h[:5] + "'", f"AKIA{h * 3}", "x" * 40 + "." + h * 2, "\x00token=abcdef\x00",
    ]
    rows = secret_scan.scan_secrets(docs_of(list(enumerate(texts)))).collect()
    _check_base([r.asDict() for r in rows], dict(enumerate(texts)))


def test_op11_spans_are_told_in_order(docs_of):
    text = "é token = " + "0123456789abcdef" * 2 + " " + SURE
    formats = secret_scan.Formats({"assign": Counter([SURE.encode()] * 50), "none": Counter(w.encode() * 4 for w in WORDS)})
    row = secret_scan.scan_secrets(docs_of([(1, text)]), formats=formats).first()
    assert row.spans == "assign:2:42,hex:10:42,format:43:67"
    assert [(f.kind, f.label) for f in row.found] == [("assign", "assign"), ("hex", "hex"), ("format", "assign")]


def _credential(rng):
    return "ghp_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))


def _word(rng):
    return "".join(rng.choice(["the", "tion", "heit", "lich", "ent", "and"]) for _ in range(rng.randint(5, 9)))


def test_op11_held_out_credentials_are_found(docs_of):
    """Formats learned from assigned values are found where nothing assigns them; ordinary long words are not."""
    rng = random.Random(3)
    taught = [(i, f"{_word(rng)} token = \"{_credential(rng)}\" {_word(rng)}") for i in range(400)]
    bare = [(1000 + i, f"see {_credential(rng)} or {_word(rng)}") for i in range(200)]
    plain = [(2000 + i, f"{_word(rng)} {_word(rng)}.") for i in range(300)]
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs_of([*taught, *bare, *plain])).collect()}
    hits = [rows[i].spans == f"format:4:{4 + 34}" for i, _ in bare]
    assert np.mean(hits) >= 0.98
    assert sum(bool(rows[i].spans) for i, _ in plain) <= 3
    assert all(rows[i].spans.count(",") == 0 and rows[i].n_assign == 1 for i, _ in taught)


def test_op11_automata():
    rng = random.Random(5)
    values = Counter("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(300))
    values = Counter({v.encode(): c for v, c in values.items()})
    follow, _, ended = secret_scan.prefix_tree(values)
    automaton = secret_scan.infer(values)
    assert automaton.states < len(follow) / 20 and sum(ended) == 300
    assert np.allclose(np.exp2(automaton.bits).sum(axis=1), 1)  # every state's symbols and end
    # by hand: the sum of log shares along the path
    state, bits = 0, 0.0
    value = next(iter(values))
    for symbol, byte in zip(secret_scan._SYMBOL[np.frombuffer(value, np.uint8)], value, strict=True):
        group = next(g for g in secret_scan._GROUPS if byte in g)
        bits += automaton.bits[state, symbol] - math.log2(len(group))
        state = automaton.next[state, symbol]
    assert math.isclose(automaton.log2(value), bits + automaton.bits[state, -1])
    assert automaton.log2(value) > automaton.log2(b"ordinarylongword" + b"abcd")


def test_op11_learns_from_distinct_short_values(docs_of):
    rows = [(i, f"token = \"{'abc' * 5}\"") for i in range(30)] + [(99, f"token = \"{'x1' * 500}\""), (98, "nothinghereisasecretatall")]
    found = docs_of(rows).select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(
        secret_scan._find, f"doc_id long, base {secret_scan._FOUND}, scored {secret_scan._HELD}"
    )
    examples = secret_scan.labelled_examples(found, 10)
    assert examples["assign"] == Counter({b"abc" * 5: 1}) and not examples["access"] and examples["none"] == Counter({b"nothinghereisasecretatall": 1})


# ---- op12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def _ranked(docs, items, best=10):
    """Every document against every item, by the definition."""
    counted = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    tfs = [(i, len(t), Counter(t)) for i, t in counted]
    holding = Counter(t for _, _, c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in tfs:
            m = 100 - 90 + (90 * n * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(_terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:best], 1)]
    return out


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("segment", "block", "sample", "at_once"), [(4096, 24, 4096, 256), (37, 3, 0, 7), (64, 1, 20, 50), (16, 100, 10**9, 200)])
def test_op12_against_brute_force(spark, docs_of, texts, segment, block, sample, at_once):
    docs = list(texts.items())
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:40]
    found = ranked_search.rank_documents(
        docs_of(docs).repartition(3), _items(spark, items), segment=segment, block_documents=block, sample=sample, queries_at_once=at_once
    )
    assert _rows(found) == sorted(_ranked(docs, items), key=str)


def test_op12_odd_rows(spark, docs_of):
    docs = [
        (None, "alpha beta"), (None, "alpha beta"), (BIG, "alpha beta"), (-1, "Alpha,BETA!"), (4, None), (5, ""), (6, " \n"), (7, "alpha " * 30_000),
        (8, "ÀLPHA àlpha"), (8, "gamma"), (9, "a_b a-b a0b"), (10, "\x00alpha\x7f"),
    ]
    items = [(1, "ALPHA beta"), (1, "ALPHA beta"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma a0b"), (5, "àlpha"), (6, "alpha " * 1000)]
    frame = docs_of(docs).withColumn("score", F.lit(1)).withColumn("query", F.lit("x")).withColumn("terms", F.lit(2))
    found = ranked_search.rank_documents(frame, _items(spark, items), segment=3, block_documents=2, queries_at_once=3)
    assert _rows(found) == sorted(_ranked(docs, items), key=str)
    assert ranked_search.rank_documents(docs_of([]), _items(spark, items)).count() == 0
    assert ranked_search.rank_documents(frame, _items(spark, [])).count() == 0


def test_op12_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(2)
    vectors = (rng.random((600, 80)) < 0.08) * rng.integers(100_000, 900_000, (600, 80))
    vectors[:20, :40] = 800_000
    vectors = vectors.astype(np.int32)
    terms, weights = np.arange(40), rng.integers(100, 9000, 40)
    blocks = ranked_search.Blocks(vectors, np.flatnonzero(vectors[:, 5]), np.arange(80), 8)
    scores = vectors[:, terms].astype(np.int64) @ weights
    for part, bound in zip(blocks.members, blocks.bounds(terms, weights), strict=True):
        assert scores[part].max() <= bound
    searcher = ranked_search.Searcher(ranked_search.QueryBlock([terms], [weights], 80), 10, np.zeros(1, np.int64), 8)
    searcher.add(vectors, [(False, i) for i in range(600)])
    best = sorted((-int(s), (False, i)) for i, s in enumerate(scores))[:10]
    assert searcher.held[0] == best and 0 < searcher.skipped < searcher.blocks and searcher.scored < 600


# ---- op13

def _middle(identity, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    named = sha256(f"1:{'null' if identity is None else identity}".encode()).hexdigest()
    h = [int(named[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_op13_against_brute_force(query, texts):
    rows = query("op13_fill_middle")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        *facts, output = _middle(r["doc_id"], text)
        assert [r[c] for c in ("n", "form", "prefix_chars", "middle_chars")] == facts
        assert r["output_sha256"] == sha256(output.encode()).hexdigest() and r["restored_sha256"] == sha256(text.encode()).hexdigest()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_op13_odd_rows(spark, docs_of, monkeypatch):
    texts = ["a", "<", "<S", "x<P", "<<S>", "ends with <M", "é", "\U0001f600áb\n\nc", "word " * 60_000, "\x00\x01", "a<P>b", None, "", "AB" * 40_000, "…é" * 300]
    rows = [(i, t) for t in texts for i in (0, 1, 2, 3, BIG, -5, None)]
    rows += [(1, "one two"), (1, "one two")]
    done = fill_middle.fill_in_middle(docs_of(rows).withColumn("output", F.lit(1)).withColumn("n", F.lit("x")).withColumn("form", F.lit(0)))
    found = fill_middle.with_restored(done.withColumn("shown", F.col("output")), keep_text=True).collect()
    expected = Counter((i, *_middle(i, t or ""), t or "") for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.shown, r.restored) for r in found) == expected
    assert fill_middle.with_restored(fill_middle.fill_in_middle(docs_of([]))).count() == 0


@pytest.mark.parametrize("stride", [1, 2, 3, 7])
def test_op13_long_texts_are_walked_in_strides(monkeypatch, stride):
    monkeypatch.setattr(fill_middle, "STRIDE", stride)
    text = "ab é c\U0001f600dé 12xyz…"
    units, data = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), text.encode()
    assert fill_middle.count_units(data) == len(units) and fill_middle.characters(data) == len(text)
    for k in range(len(units) + 1):
        assert data[: fill_middle.offset_after(data, k)].decode() == "".join(units[:k])


def test_op13_pieces():
    table = fill_middle.PieceTable.of(b"abcdef")
    table.cut(4)
    table.cut(1)
    assert table.pieces == [(0, 0, 1), (0, 1, 3), (0, 4, 2)] and table.bytes() == b"abcdef"
    for form, output in (("psm", b"<P>a<S>ef<M>bcd"), ("spm", b"<S>ef<P>a<M>bcd")):
        arranged = table.arranged(form)
        assert arranged.bytes() == output and arranged.digest() == sha256(output).hexdigest()
        assert fill_middle.PieceTable.read_back(output, form).bytes() == b"abcdef"


# ---- identities: null ones, large ones and repeated ones with unlike texts, in every operator and stage

@pytest.fixture(scope="module")
def odd_ids(spark):
    """Rows whose ids a float can not hold stand beside null ones; a nullable long and a binary column come along."""
    rng = random.Random(2)
    rows = []
    for k, i in enumerate([None, BIG, -1, None, BIG, 7, 7, BIG + 1, BIG + 2, None]):
        text = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60))
        rows.append((i, text, "en", None if k % 3 == 0 else "s", None if k % 2 else BIG + 10 * k, bytes([k, 255])))
    schema = "doc_id long, text string, lang string, source string, n_chars long, raw binary"
    return spark.createDataFrame(rows, schema).coalesce(1), rows


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame([(7, 1, 0), (-1, 0, 0), (BIG, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


IDENTITY_OPERATORS = {
    "op1": lambda d, labels: fingerprints.fingerprint_edits(d), "op2": quality_cnn.score_quality, "op3": lambda d, labels: packing.pack_documents(d),
    "op5": lambda d, labels: license_scan.scan_licenses(d), "op6": lambda d, labels: suffix_dedup.remove_repeats(d), "op7": quality_llr.judge_quality,
    "op8": lambda d, labels: sharding.shuffle_into_shards(d, 3), "op9": lambda d, labels: ngram_join.jaccard_groups(d),
    "op10": lambda d, labels: mixing.mix_sources(d), "op11": lambda d, labels: secret_scan.scan_secrets(d),
    "op13": lambda d, labels: fill_middle.fill_in_middle(d),
}


@pytest.mark.parametrize("name", IDENTITY_OPERATORS)
def test_identities_survive(odd_ids, some_labels, name):
    docs, rows = odd_ids
    found = Counter(r.doc_id for r in IDENTITY_OPERATORS[name](docs, some_labels).select("doc_id").collect())
    wanted = Counter(r[0] for r in rows)
    assert set(found) == set(wanted) and (name == "op3" or found == wanted)


def test_stages_hand_rows_over_as_they_came(odd_ids, some_labels, monkeypatch):
    docs, rows = odd_ids
    every = Counter(rows)
    kept = Counter((*r[:5], bytes(r[5])) for r in quality_cnn.keep_good(docs, some_labels).collect())
    assert kept <= every and kept
    alone = Counter((*r[:5], bytes(r[5])) for r in ngram_join.keep_one_per_group(docs).collect())
    assert alone == every  # all texts are unlike
    uncut = Counter((*r[:5], bytes(r[5])) for r in suffix_dedup.without_repeats(docs, length=200).collect())
    assert uncut == every
    passage = "a passage that repeats, word for word, in two documents that are unlike each other elsewhere " * 3
    twice = docs.withColumn("text", F.when(F.col("doc_id") == BIG, F.concat(F.lit(passage), "text")).otherwise(F.col("text")))
    cut = Counter((*r[:5], bytes(r[5])) for r in suffix_dedup.without_repeats(twice, length=200).collect())
    assert cut == every


def test_op6_unlike_texts_of_one_32_bit_key(docs_of):
    """Texts are told apart by 128 bits, so no two of many unlike ones share their runs."""
    docs = docs_of([(None, f"text number {k}") for k in range(1000)] + [(None, "same " * 200), (None, "same " * 200 + "x")])
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert sum(r.n_removed == 0 for r in rows) == 1000 and len(rows) == 1002


@pytest.mark.parametrize("heavy", [True, False])
def test_join_by_weight(spark, heavy):
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    small = rows.groupBy("k").count()
    joined = tables.join_by_weight(rows, small, ["k"], F.col("count") >= (100 if heavy else 10_000))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(small, "k").collect()))


def test_op3_ids_of_both_encoders(spark, sf_dir):
    """Whole texts of common characters, and characters on either side of what is common."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.TextEncoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert encoder.ranked is not None
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("text").collect()][:400]
    rng = random.Random(9)
    common = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028))]
    rare = ["\x00", "\x0b", "\x1c", "\x85", "\xa0", " ", "中", "\U0001f600", "ا", "́"]
    texts += ["".join(rng.choice(common) for _ in range(80)) for _ in range(3000)]
    texts += ["".join(rng.choice(common + rare * 9) for _ in range(60)) for _ in range(1000)]
    texts += [" " * 50 + "a", "x" * 30_000, "ab " * 20_000, "<|endoftext|>", "it's we'll I'M\n\n\n  x", ""]
    for text, found in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert packing.TextEncoder(public_tokenizers.path("word_bpe_49k.json")).ranked is None


# ---- earlier operators, where null or repeated identities and many equal rows went wrong

def test_op10_rows_without_words_stop_at_the_largest_epoch_too(docs_of):
    """A source at its cap has no fraction; empty texts before the edge are not taken once more."""
    rows = [(i, "", "a") for i in range(200)] + [(200 + i, "one two three", "a") for i in range(5)] + [(300 + i, "many words " * 400, "b") for i in range(5)]
    found = mixing.mix_sources(docs_of(rows)).where("source = 'a'").collect()
    assert {r.target for r in found} == {45.0} and {r.repeats for r in found} == {3}


@pytest.mark.parametrize("shape", ["null ids", "one id", "equal rows", "mixed"])
def test_op10_meets_targets_whatever_the_identities(docs_of, shape):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        text = " ".join(["w"] * 7) if shape == "equal rows" or (shape == "mixed" and k % 3) else " ".join(["w"] * rng.randrange(1, 12)) + f" x{k}"
        identity = {"null ids": None, "one id": 5, "equal rows": 5, "mixed": 5 if k % 3 else k}[shape]
        rows.append((identity, text, "abc"[k % 3] if k % 7 else None))
    docs = docs_of(rows)
    found = mixing.mix_sources(docs).select("source", "size", "target", "taken", "doc_id").collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((i, s, len(t.split())) for i, t, s in rows)
    taken, largest, target = Counter(), Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= largest[source] / 2
    again = mixing.mix_sources(docs.repartition(5)).select("source", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.source, r.size, r.taken) for r in found)


def test_op8_equal_rows_and_one_identity(docs_of, monkeypatch):
    """Thousands of unlike texts of one identity, and of equal rows, fall into many buckets; slots stay gapless."""
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 50)
    rows = [(1, f"text {k}") for k in range(1500)] + [(2, "the same text")] * 1500 + [(None, None)] * 700
    docs = docs_of(rows)
    placed = sharding.shuffle_into_shards(docs, 7, bucket_bytes=4096).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows)
    slots = {}
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    for kind in ((1,), (2,), (None,)):  # no kind of rows lies together
        shares = Counter(r.shard for r in placed if (r.doc_id,) == kind)
        assert max(shares.values()) < 2 * sum(shares.values()) / 7


def test_op4_mapping_is_chosen_by_the_fingerprint(spark, monkeypatch):
    """Rows by turn go through the mapping of their layout; without that layout they have no turns."""
    rows = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", None), (None, 0, None, "x"), (1, 1, "gpt", None)], "conv_id long, turn int, role string, text string")
    found = {r.conv_id: r for r in chat_format.format_conversations(rows.withColumn("layout", F.lit("z")).withColumn("m", F.lit(1))).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "a"), ("assistant", ""), ("assistant", "")] and found[None].layout == "messages"
    assert all(r.turns == r.read_turns for r in found.values())
    example = spark.range(1).select(chat_format.schema_fingerprint(F.lit(chat_format.LAYOUTS[0].example))).first()[0]
    assert {r.schema_fingerprint for r in found.values()} == {example}
    records = chat_format.conversation_records(rows)
    other = chat_format.canonical_turns(records, layouts=chat_format.LAYOUTS[3:], record=chat_format.messages_record(F.col("messages")))
    assert [(r.layout, r.turns) for r in other.collect()] == [(None, [])] * 2
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


def test_op4_records_of_many_layouts(spark):
    payloads = ['{"prompt":"p","response":"r"}', '{"instruction":"i","output":"o"}', "[]", '{"messages":[{"role":"user","content":"</turn> #"}]}', None]
    rows = chat_format.format_records(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert [r.layout for r in rows] == ["prompt_response", "instruction", None, "messages", None]
    assert all(r.read_turns == r.turns for r in rows) and [r.loss_text for r in rows] == ["r", "o", "", "", ""]


def test_op4_a_conversation_of_very_many_turns(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat_format.format_conversations(rows).select(F.size("read_turns"), "layout", F.col("read_turns")[n - 1]["text"]).first()
    assert tuple(row) == (n, "messages", str(n - 1))


PROBES = {
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 1.": None,
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause", "Licensed under the BSD 4-Clause License.": None,
    "Licensed under the Mozilla Public License 1.1.": "MPL-1.1", "Licensed under the Mozilla Public License 3.0.": None,
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY 2.0.": None,
    "Licensed under the Apache License, Version 1.1.": None, "Licensed under the Eclipse Public License, version 2.0.": None,
    "plain words of a document": None,
}


def test_op5_families_are_told_apart_row_by_row(docs_of):
    rows = [(20, "some text\n" + p) for p in PROBES] + [(None, p) for p in PROBES] + [(None, None), (20, "")]
    found = Counter((r.doc_id, r.family) for r in license_scan.scan_licenses(docs_of(rows)).collect())
    expected = Counter([(20, f) for f in PROBES.values()] + [(None, f) for f in PROBES.values()] + [(None, None), (20, None)])
    assert found == expected


def test_op5_long_runs_within_a_text(spark, docs_of):
    """Runs of separators, version numbers and conditions of any length: Java's regular expressions overflowed the stack from some thousand on."""
    mit, n = license_scan.TEMPLATES["MIT"][0], 100_000
    runs = ["\u00e9" * n, " " * n, "." * n, " ." * n, "\U0001f600," * n, ".\t-" * n]
    rows = [(k, f"{mit}{run}\n{mit}\nsome{run}words.{run}") for k, run in enumerate(runs)]
    split = docs_of(rows).select("doc_id", "text", license_scan.words(F.col("text")).alias("w")).collect()
    assert all(r.w == [w for w in re.split(r"(?:[^a-z0-9.\-]|\.(?![a-z0-9]))+", r.text.lower()) if w] for r in split)
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    assert all(found[k].n_paragraphs == 3 and (1, "MIT") in [(f.paragraph, f.family) for f in found[k].found] for k in range(len(runs)))
    words = ["1" + ".1" * n, "v2" + ".10" * n, "by" + "-sa" * n, "attribution" + "-nc" * n]
    words += ["1.", "v2.", "1" + ".1" * n + "x", "by" + "-sa" * n + "-", "2-clause", "22-clause", "by", "attribution", "lgpl"]
    told = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").where(F.col("w").rlike(license_scan.TELLING))
    assert sorted(r.k for r in told.select("k").collect()) == [0, 1, 2, 3, 8, 12]


def test_op5_no_template_is_common_words():
    for family in license_scan.FAMILIES:
        for template in license_scan.TEMPLATES[family]:
            own = set(license_scan.template_words(template))
            assert len(own & license_scan.COMMON) < license_scan.LEAST_LIKENESS * len(own)


def test_op5_held_out_notices_are_calibrated(spark, docs_of):
    """Notices reworded in ways that were not taught, among plain sentences: stated probabilities match the hits."""
    rng = random.Random(8)
    filler = ["we", "hope", "note", "that", "here", "today", "always", "please", "see", "below"]
    held, truth = [], []
    for k, family in enumerate(license_scan.FAMILIES):
        for template in license_scan.TEMPLATES[family]:
            for _ in range(6):
                tokens = template.split()
                at = rng.randrange(len(tokens) + 1)
                held.append(" ".join([*tokens[:at], rng.choice(filler), *tokens[at:]]))
                truth.append(k)
    for _ in range(150):
        held.append(" ".join(rng.choice(filler + ["table", "license", "public", "under", "terms"]) for _ in range(rng.randrange(5, 15))))
        truth.append(len(license_scan.FAMILIES))
    own = docs_of([(k, " ".join(rng.choice(filler) + str(rng.randrange(50)) for _ in range(12))) for k in range(60)])
    hashes = [F.xxhash64(F.lit(part), "text").alias(f"k{part}") for part in (1, 2)]
    weights, bias, temperature = license_scan.fit(license_scan.training_rows(own.select("doc_id", "text", *hashes)))
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(held)], "i int, p string")
    features = {r.i: r.f for r in frame.select("i", license_scan.features(license_scan.words(F.col("p"))).alias("f")).collect()}
    x = np.zeros((len(held), license_scan.DIMENSIONS))
    for i, f in features.items():
        x[i, f] = 1 / np.sqrt(max(len(f), 1))
    z = (x @ weights + bias) / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == np.array(truth)
    assert right.mean() > 0.9
    sure = p.max(1)
    gaps = [abs(sure[b].mean() - right[b].mean()) * b.mean() for b in (sure < 0.5, (sure >= 0.5) & (sure < 0.8), sure >= 0.8) if b.any()]
    assert sum(gaps) < 0.2  # expected calibration error


def test_op2_learns_the_same_rows_in_every_run(spark, docs_of, monkeypatch):
    """Many unlike rows of one identity, identities labelled twice or both ways, and texts too long to learn from."""
    learned = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, labels: learned.append((texts, labels.tolist())))
    rows = [(1, f"text {k} " * 3) for k in range(300)] + [(7, "both ways"), (10, "x" * 50), (8, "twice"), (9, "bad")]
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (10, 1), (8, 1), (8, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    assert all(crc32(str(i).encode()) % 3 != 1 for i in (1, 7, 8, 9, 10))
    for parts in (1, 7):
        docs = docs_of(rows).repartition(parts)
        quality_cnn.fit_on(docs, labels, "doc_id", "text", "quality", 40, 49)
        quality_cnn.fit_on(docs, labels, "doc_id", "text", "quality", 1000, 49)
    few, all_of_them = learned[:2]
    assert learned[2:] == learned[:2] and len(few[0]) == 40 and len(all_of_them[0]) == 302
    assert Counter(all_of_them[1]) == {1.0: 301, 0.0: 1} and b"both ways" not in all_of_them[0] and b"x" * 50 not in all_of_them[0]


def test_op2_separates_held_out_rows(spark):
    larger = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [r for r in LLM_QUERIES["op2_quality_cnn"](spark, larger).collect() if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in rows if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if labels[r.doc_id] == 0])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc >= 0.95 and (bad < 0.5).mean() >= 0.8


def test_op1_likeness_against_the_true_share(spark):
    """The shared part of five-word runs, 2 |A and B| / (|A| + |B|): the sketch's error stays within three of its deviations."""
    rng = random.Random(1)
    rows, truth = [], []
    for k in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = [w if rng.random() > k / 800 else f"z{rng.randrange(10**6)}" for w in words]
        runs = [set(zip(*[t[i:] for i in range(5)], strict=False)) for t in (words, other)]
        rows.append((" ".join(words), " ".join(other)))
        truth.append(2 * len(runs[0] & runs[1]) / (len(runs[0]) + len(runs[1])))
    frame = spark.createDataFrame(rows, "x string, y string")
    for c in "xy":
        frame = fingerprints.with_fingerprint(frame, c, c + "f")
    found = np.array([r[0] for r in frame.select(fingerprints.likeness(F.col("xf"), F.col("yf"))).collect()])
    error = found - np.array(truth)
    assert abs(error.mean()) < 0.05 and np.abs(error).max() < 0.36


def test_a_passage_of_fifty_words_is_seen_by_a_shorter_length_alone(docs_of):
    """A passage of 51 words has fewer bytes than the 400 of op6's contract: it stays there, and goes at 200; a longer one goes at both."""
    rng = random.Random(8)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))

    short, long = words(51), words(120)
    assert len(short) < 400 < len(long)
    texts = [(i, f"{words(80)} {short if i < 4 else long} {words(80)}") for i in range(8)]
    removed = {n: {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs_of(texts), length=n).collect()} for n in (400, 200)}
    assert [removed[400][i] >= len(long) for i in range(8)] == [False] * 4 + [True] * 4
    assert all(removed[400][i] == 0 for i in range(4))
    assert all(removed[200][i] >= len(short if i < 4 else long) for i in range(8))


def _repeated(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, bytes]]:
    """Bytes that repeated strings of ``length`` cover, their spans, and what is left: by brute force."""
    def windows(t):
        return [t[p : p + length] for p in range(len(t) - length + 1)]

    counts, out = Counter(w for t in texts.values() for w in windows(t)), {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, int)
        for p, w in enumerate(windows(t)):
            gone[p : p + length] |= counts[w] > 1
        out[i] = int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), bytes(c for c, g in zip(t, gone, strict=False) if not g)
    return out


@pytest.mark.parametrize(("length", "passage", "large_bucket"), [(40, 24, 8192), (40, 24, 1), (24, 40, 8192), (40, 40, 1)])
def test_op6_two_lengths_at_once(docs_of, length, passage, large_bucket):
    rng = random.Random(9)

    def letters(n):
        return "".join(rng.choices("abcdefgh", k=n))

    planted = [letters(n) for n in (25, 30, 41, 60)]
    texts = {i: letters(20 + i) + planted[i % 4] + letters(i % 7) + planted[i % 3] * (i % 3) + "é" * (i % 5) for i in range(40)}
    texts |= {40: None, 41: "", 42: letters(24), 43: letters(3000), 44: "ab" * 40}
    docs = docs_of([*texts.items()])
    data = {i: (t or "").encode() for i, t in texts.items()}
    rows = suffix_dedup.remove_repeats(docs, length=length, passage=passage, gram=8, large_bucket=large_bucket).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == _repeated(data, length)
    assert {r.doc_id: (r.n_passage_bytes, r.n_passages, bytes(r.without_passages)) for r in rows} == _repeated(data, passage)
    assert len(rows) == len(texts) and all(r.n_bytes == len(data[r.doc_id]) for r in rows)


def test_op6_names_passages_that_its_contract_leaves(query, texts):
    data = {i: (t or "").encode() for i, t in texts.items()}
    found = {r["doc_id"]: r for r in query("op6_suffix_dedup")}
    want = _repeated({i: t for i, t in data.items()}, suffix_dedup.PASSAGE_BYTES)
    assert {i: (r["n_passage_bytes"], r["n_passages"]) for i, r in found.items()} == {i: w[:2] for i, w in want.items()}
    assert all(r["without_passages"] == want[i][2].decode(errors="replace") for i, r in found.items())
    assert any(r["n_passage_bytes"] and not r["n_removed"] for r in found.values())


def test_filter_loses_no_key(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), "id")
    marked = tables.with_filter(rows, "key", rows.where("id % 10 = 0").select("key"), "near")
    got = {(r[0], r[1]): r[2] for r in marked.groupBy(F.col("id") % 10 == 0, "near").count().collect()}
    assert got[True, True] == 20_000 and (True, False) not in got and got[False, True] < 20_000
    assert marked.columns == ["key", "id", "near"]
    none = tables.with_filter(rows, "key", rows.where("false").select("key"), "near")
    assert none.where("near").count() == 0 and none.count() == 200_000
