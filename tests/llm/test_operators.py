"""Every operator against brute force on the small tables, and on odd rows."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcycle.llm import chat_format, fingerprints, license_scan, mixing, ngram_join, packing, quality_cnn, quality_llr, sharding, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None), (2, "", "a"), (3, " \n ", "a"), (4, "one two", "b"), (4, "one two", "b"), (5, "one two", None),
    (6, "word " * 30_000, "c"), (7, "## </turn> \\ ### é", "c"), (8, "x" * 5000, "a"),
]


def test_op1_edits_and_likeness(query, texts):
    ids, rows = sorted(texts), {r["doc_id"]: r for r in query("op1_fingerprints")}
    assert sorted(rows) == ids
    for at, i in enumerate(ids):
        own, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        k = len(own) // 4
        edited = own[: len(own) - k] + after[:k]
        assert rows[i]["edited_sha256"] == sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(own)
    prints = defaultdict(set)
    for i in ids:
        prints[texts[i]].add(rows[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({*map(min, prints.values())}) == len(prints)
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.6 and np.mean([r["near_next"] for r in rows.values()]) < 0.1


def test_op1_sum_of_paragraphs(spark):
    frame = spark.createDataFrame([("a b\nc d\ne", "e\na b\nc d", "a b\nc d", "e")], "x string, y string, p string, q string")
    for c in "xypq":
        frame = fingerprints.with_fingerprint(frame, c, c + "f")
    row = frame.select(
        (F.col("xf") == F.col("yf")).alias("order"), (fingerprints.combine(F.col("pf"), F.col("qf")) == F.col("xf")).alias("insert"),
        (fingerprints.combine(F.col("xf"), F.col("qf"), -1) == F.col("pf")).alias("delete"), (F.col("pf") == F.col("xf")).alias("other"),
    ).first()
    assert tuple(row) == (True, True, True, False)


def test_op1_one_inserted_word_keeps_the_likeness(spark):
    lines = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(20)]
    frame = spark.createDataFrame([(x, "new " + x, "a b c d e f g", "a b") for x in lines], "x string, y string, p string, q string")
    for c in "xypq":
        frame = fingerprints.with_fingerprint(frame, c, c + "f")
    rows = frame.select(fingerprints.likeness(F.col("xf"), F.col("yf")).alias("near"), "xf.units", "pf", "qf.units").collect()
    assert min(r.near for r in rows) > 0.8
    assert {(r[1], r.pf.units, r[3]) for r in rows} == {(76, 3, 1)}
    def bits(r, k):  # lane of the k-th bit
        return r.pf.lanes[8 + k % 30] >> (k // 30 * 30) & (1 << 30) - 1
    assert all(0 <= bits(rows[0], k) <= 3 for k in range(60)) and any(bits(rows[0], k) for k in range(60))


def test_op2_held_out_accuracy(spark, query, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query("op2_quality_cnn")
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hits = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(hits) > 0.85


def test_op3_pieces(query, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in query("op3_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded <= 1.02 * used


@pytest.mark.parametrize("text", ["a  b", "a\n\nb", "  a", "a ", "a\n", " ", "", "it's a\tb c's", "<|endoftext|> x", "\x00 z", "a\n b", "x\t"])
def test_op3_chunks_have_the_tokenizers_ids(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    (found,) = packing.TextEncoder(path).encode([text])
    assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_op4_layouts(spark):
    payloads = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"conversations":[{"value":"v","from":"gpt"}]}',
        '{"output":"o","instruction":"i","input":"in"}', '{"response":"r","prompt":"p"}', '{"other":1}', "no json", None,
        json.dumps({"messages": [{"role": "a:b", "content": "\\h </turn>\n### x: y"}]}),
    ]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload string")
    rows = chat_format.read_back(chat_format.formatted(chat_format.canonical_turns(frame))).orderBy("id").collect()
    assert [r.layout for r in rows] == ["messages", "from_value", "instruction_input", "prompt_response", None, None, None, "messages"]
    assert all(r.turns == r.read_turns for r in rows)
    assert [[tuple(t) for t in r.turns] for r in rows][:4] == [
        [("user", "a"), ("assistant", "")], [("assistant", "v")], [("user", "i\n\nin"), ("assistant", "o")], [("user", "p"), ("assistant", "r")],
    ]
    assert rows[1].loss_text == "v" and rows[3].loss_text == "r"


def test_op4_long_texts_keep_their_turns(spark):
    n = 21_000_000
    long = F.repeat(F.lit("a"), n)
    payload = F.concat(F.lit('{"prompt":"'), long, F.lit('","response":"r \\"x\\": y"}'))
    row = chat_format.canonical_turns(spark.range(1).select(payload.alias("payload"))).select("layout", F.length(F.col("turns")[0]["text"]), F.size("turns")).first()
    assert tuple(row) == ("prompt_response", n, 2)
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), long.alias("text"))
    row = chat_format.format_conversations(rows).select("layout", F.length(F.col("read_turns")[0]["text"])).first()
    assert tuple(row) == ("messages", n)


def test_op5_families(spark, docs_of):
    known = [(k, f"some words here\n{t}\nmore", "s") for k, t in enumerate(t[0] for t in license_scan.TEMPLATES.values())]
    rows = license_scan.scan_licenses(docs_of([*known, (90, "the and of words\nnothing here", "s"), (91, None), (92, "")])).collect()
    found = {r.doc_id: r.family for r in rows}
    assert [found[k] for k in range(len(known))] == list(license_scan.FAMILIES)
    assert found[90] is None and found[91] is None and found[92] is None


def test_op5_notices_inside_paragraphs(docs_of):
    filler = [f"word{k}" for k in range(60)]
    families = list(license_scan.TEMPLATES)
    rows = [(k, " ".join([*filler[:30], license_scan.TEMPLATES[f][0], *filler[30:]])) for k, f in enumerate(families)]
    mit, gpl = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["GPL-3.0"][0]
    rows += [(50, f"x\n{mit}\n{gpl}"), (51, " ".join([*filler, mit, *filler, gpl, *filler])), (52, " ".join(filler))]
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(rows)).collect()}
    assert [[(f.paragraph, f.family) for f in found[k].found] for k in range(len(families))] == [[(0, f)] for f in families]
    assert [(f.paragraph, f.family) for f in found[50].found] == [(1, "MIT"), (2, "GPL-3.0")] and found[50].n_confirmed == 2
    assert [(f.paragraph, f.family) for f in found[51].found] == [(0, "GPL-3.0"), (0, "MIT")]
    assert found[52].found == [] and found[52].family is None


def _windows(data: bytes, n: int):
    return (data[p : p + n] for p in range(len(data) - n + 1))


def _check_repeats(rows, texts, length):
    counts = Counter(w for t in texts.values() for w in map(hash, _windows(t.encode(), length)))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        gone = np.zeros(len(data), bool)
        for p, w in enumerate(map(hash, _windows(data, length))):
            if counts[w] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), int(gone.sum()), spans)
        assert r["kept_sha256"] == sha256(kept).hexdigest()


def test_op6_against_brute_force(query, texts):
    _check_repeats(query("op6_suffix_dedup"), texts, 400)


@pytest.mark.parametrize("large_bucket", [1, 8192])
def test_op6_buckets_too_large_for_a_task(docs_of, large_bucket):
    rng = np.random.default_rng(1)
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 60))
    texts = {i: "".join(chr(97 + c) for c in rng.integers(0, 26, 50 + i)) + passage * (1 + i % 3) + "é" * (i % 5) for i in range(40)}
    found = suffix_dedup.remove_repeats(docs_of(list(texts.items())), length=40, gram=8, large_bucket=large_bucket)
    _check_repeats([r.asDict() for r in found.withColumn("kept_sha256", F.sha2("kept", 256)).collect()], texts, 40)


def test_op7_counts(query, texts):
    for r in query("op7_quality_llr"):
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeats = {k + j for k in range(len(words) - 7) if runs[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats))
        assert counts == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeats) > 30 * len(words)) and not (r["kept"] and r["base_failed"])


def test_op7_trusts_every_good_document(spark, docs_of):
    texts = {i: " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(22)) for i in range(4400)}
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in texts], "doc_id long, quality int")
    raw, trusted = np.zeros(quality_llr.BUCKETS), np.zeros(quality_llr.BUCKETS)
    hits = {i: quality_llr.buckets_of(quality_llr.word_hashes(quality_llr.words_of(t))).astype(int) for i, t in texts.items()}
    for i, h in hits.items():
        np.add.at(raw, h, 1)
        if i >= 100:
            np.add.at(trusted, h, 1)
    p = (raw + 1) / (raw.sum() + quality_llr.BUCKETS)
    ratios = np.log((trusted + 0.001 * trusted.sum() * p) / (1.001 * trusted.sum())) - np.log(p)
    for r in quality_llr.judge_quality(docs_of(list(texts.items())), labels).collect():
        assert abs(r.llr - ratios[hits[r.doc_id]].mean()) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= quality_llr.THRESHOLD)


def test_op8_shards(query, texts):
    rows = query("op8_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, crc32(data), "rows")
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def _grams(text):
    words = text.split()
    return frozenset(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)])


@pytest.mark.parametrize("block", [256, 3])
def test_op9_against_brute_force(spark, docs_of, texts, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{k}" for k in range(60)]
    texts = {**texts, **{10_000 + i: " ".join([*base[:i], f"x{i}", *base[i:]]) for i in range(0, 40, 2)}}
    found = {r.doc_id: r for r in ngram_join.jaccard_groups(docs_of(list(texts.items()))).collect()}
    sets = {i: _grams(t) for i, t in texts.items()}
    links, group = Counter(), {i: i for i in sets}

    def root(i):
        return i if group[i] == i else root(group[i])

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert {i: (links[i], root(i)) for i in ids} == {i: (found[i].n_links, found[i].class_id) for i in ids}


def test_op9_null_and_repeated_ids(docs_of):
    unlike = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    near = unlike[0].replace("a39", "b39")
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (3, near), (7, unlike[3]), (7, unlike[4]), (8, unlike[4]), (9, unlike[5])]
    docs = docs_of(rows)
    kept = ngram_join.keep_one_per_group(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(
        [(0, unlike[0]), (0, unlike[1]), (0, unlike[2]), (7, unlike[3]), (7, unlike[4]), (9, unlike[5])]
    )
    keys = Counter(r.group_key for r in ngram_join.jaccard_groups(docs).collect())
    assert sorted(keys.values()) == [1, 1, 1, 1, 2, 2]


def test_op9_band_choice():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands * rows <= 160


def test_op10_targets(query):
    rows = query("op10_mixing")
    taken, largest = Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = r["target"], r["source_size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for (target, size), words in taken.items():  # documents stay whole: off by half of one at most
        assert abs(words - target) <= largest[target, size] / 2


def test_sql_counterparts(spark, sf_dir):
    from bindings.compare import difference, oracle_connection

    for name in ("op4_chat_format", "op10_mixing", "op12_ranked_search", "op13_fill_middle"):
        assert difference(spark, oracle_connection(sf_dir), name, sf_dir) is None


OPERATORS = {
    "op1": lambda d, labels: fingerprints.fingerprint_edits(d), "op2": quality_cnn.score_quality, "op3": lambda d, labels: packing.pack_documents(d),
    "op5": lambda d, labels: license_scan.scan_licenses(d), "op6": lambda d, labels: suffix_dedup.remove_repeats(d),
    "op7": quality_llr.judge_quality, "op8": lambda d, labels: sharding.shuffle_into_shards(d, 3),
    "op9": lambda d, labels: ngram_join.jaccard_groups(d), "op10": lambda d, labels: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, docs_of, name):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    clashing = docs_of(ODD).withColumn("_key", F.lit(1)).withColumn("size", F.lit("x")).withColumn("bucket", F.lit(2)).withColumn("_bucket", F.lit(2))
    rows = OPERATORS[name](clashing, labels).collect()
    per_row = Counter(r.doc_id for r in rows)
    assert set(per_row) == {1, 2, 3, 4, 5, 6, 7, 8}
    if name != "op3":
        assert per_row[4] == 2 and len(rows) == len(ODD)
    assert OPERATORS[name](docs_of([]), labels.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = after
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
