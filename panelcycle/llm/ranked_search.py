"""Ranked lexical search by per-term geometric blocking, exact.

Two tables are made once for a block of queries: the corpus' counts (documents, terms, documents per
query term) and a forward table with each document's length and its query terms' occurrences. What
follows reads only the forward table.

Documents are taken in segments of at most ``SEGMENT``. In a segment each term has a posting list,
which is cut into blocks of similar documents: seeds are spread over the list, and a document joins
the seed its vector is most alike. A block's summary is the coordinatewise maximum of its
documents' vectors, so its product with a query bounds the score of every document in the block.

A query takes the lists of its essential terms only: the others' largest contributions together stay
below the score that the tenth best document so far has. It visits the blocks by falling bound and
skips one only when its bound lies below that score. Bounds and scores are whole numbers, so a
skipped document can not belong to the answer, and equal scores are never skipped.

Every task keeps its best documents over all of its segments. They start from the scores that a
small sample of the corpus reaches, found the same way, and the tasks' answers are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcycle.session import materialize

BEST = 10
#: Documents of a segment, documents a block aims at, documents of the sample that gives first scores.
SEGMENT, BLOCK_DOCUMENTS, SAMPLE = 4096, 24, 4096
#: Queries answered by one pass over the forward table, and the terms they may have together; a query with more goes alone.
QUERIES_AT_ONCE, TERMS_AT_ONCE = 256, 8192
#: Numbers in a segment's vectors: queries with very many terms get smaller segments.
CELLS = 1 << 25
#: The score's constants.
SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 1000, 8, 90

_KEEP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters above ASCII; only A to Z are lower-cased."""
    return text.translate(_FOLD).split()


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms with repeats, and occurrences by term."""
    counts = Counter(terms_of(text))
    return counts.total(), counts


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(length, documents: int, terms: int):
    """Grows with the length against the mean one; whole numbers throughout."""
    return 100 - SLOPE + (SLOPE * length * documents) // max(terms, 1)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's occurrences add per unit of its weight; below a million."""
    return (SCALE * tf) // (SATURATION * tf + FLAT * norm)


@dataclass
class QueryBlock:
    """The queries of one pass: for each the places of its terms and their weights."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    width: int


class Blocks:
    """One term's posting list in a segment: documents by block, and the blocks' summaries."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray, coordinates: np.ndarray, block_documents: int):
        self.coordinates = coordinates
        own = vectors[np.ix_(members, coordinates)]
        count = -(-len(members) // block_documents)
        if count > 1:
            seeds = own[np.linspace(0, len(members) - 1, count).astype(np.int64)].astype(np.float32)
            seeds /= np.maximum(np.sqrt((seeds * seeds).sum(axis=1)), 1)[:, None]
            block = np.empty(len(members), np.int64)
            for at in range(0, len(members), 512):
                block[at : at + 512] = (own[at : at + 512].astype(np.float32) @ seeds.T).argmax(axis=1)
            order = np.argsort(block, kind="stable")
            block, own, members = block[order], own[order], members[order]
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        else:
            starts = np.zeros(1, np.int64)
        self.members = np.split(members, starts[1:])
        self.summaries = np.maximum.reduceat(own, starts, axis=0)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a block scores more than this."""
        place = np.searchsorted(self.coordinates, terms)
        return self.summaries[:, place].astype(np.int64) @ weights


class Searcher:
    """Best documents of every query over the segments it is shown."""

    def __init__(self, queries: QueryBlock, best: int, floors: np.ndarray, block_documents: int = BLOCK_DOCUMENTS):
        self.queries, self.best, self.floors, self.block_documents = queries, best, floors, block_documents
        #: Per query (score, place of the identity) ascending from the best.
        self.held: list[list[tuple]] = [[] for _ in queries.terms]
        self.scored = self.blocks = self.skipped = 0

    def _floor(self, query: int) -> int:
        """A document below this score can not be among the best."""
        held = self.held[query]
        own = -held[-1][0] if len(held) >= self.best else 1
        return max(own, int(self.floors[query]), 1)

    def add(self, vectors: np.ndarray, identities: list) -> None:
        """``vectors``: whole-number impacts by document and term; ``identities``: comparable, best first if equal scores."""
        queries = self.queries
        largest = vectors.max(axis=0).astype(np.int64) if len(vectors) else np.zeros(queries.width, np.int64)
        essential: list[np.ndarray] = []
        asked: dict[int, list[int]] = {}
        for q, (terms, weights) in enumerate(zip(queries.terms, queries.weights, strict=True)):
            most = weights * largest[terms]
            order = np.argsort(most, kind="stable")
            chosen = terms[order[np.cumsum(most[order]) >= self._floor(q)]]
            essential.append(chosen)
            for t in chosen.tolist():
                asked.setdefault(t, []).append(q)
        lists: dict[int, Blocks] = {}
        for term, by in asked.items():
            members = np.flatnonzero(vectors[:, term])
            if len(members):
                coordinates = np.unique(np.concatenate([queries.terms[q] for q in by]))
                lists[term] = Blocks(vectors, members, coordinates, self.block_documents)
        order = sorted(range(len(identities)), key=identities.__getitem__)
        rank = np.empty(len(identities), np.int64)
        rank[order] = np.arange(len(identities))
        for q, chosen in enumerate(essential):
            some = [lists[t] for t in chosen.tolist() if t in lists]
            if some:
                self._visit(q, some, vectors, identities, rank)

    def _visit(self, q: int, lists: list[Blocks], vectors: np.ndarray, identities: list, rank: np.ndarray) -> None:
        terms, weights = self.queries.terms[q], self.queries.weights[q]
        bounds = np.concatenate([b.bounds(terms, weights) for b in lists])
        members = [part for b in lists for part in b.members]
        order = np.argsort(-bounds, kind="stable")
        seen = np.zeros(len(vectors), bool)
        at, step = 0, 8
        self.blocks += len(order)
        while at < len(order):
            floor = self._floor(q)
            some = order[at : at + step]
            some = some[bounds[some] >= floor]
            if not len(some):
                break
            rows = np.unique(np.concatenate([members[i] for i in some]))
            rows = rows[~seen[rows]]
            seen[rows] = True
            self._score(q, rows, vectors[np.ix_(rows, terms)].astype(np.int64) @ weights, identities, rank, floor)
            self.skipped -= len(some)
            at, step = at + step, step * 2
        self.skipped += len(order)

    def _score(self, q: int, rows: np.ndarray, scores: np.ndarray, identities: list, rank: np.ndarray, floor: int) -> None:
        self.scored += len(rows)
        rows, scores = rows[scores >= floor], scores[scores >= floor]
        first = np.lexsort((rank[rows], -scores))[: self.best]
        found = [(-int(scores[i]), identities[rows[i]]) for i in first]
        if found:
            self.held[q] = sorted(self.held[q] + found)[: self.best]


def _sortable(values: list) -> list[tuple]:
    """Identities in ascending order, null last."""
    return [(v is None, v if v is not None else 0) for v in values]


def _search(batches: Iterator[pa.RecordBatch], queries: QueryBlock, best: int, floors: np.ndarray, documents: int, terms: int,
            segment: int, block_documents: int) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(queries, best, floors, block_documents)
    segment = max(1, min(segment, CELLS // queries.width))
    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for at in range(0, batch.num_rows, segment):
            part = batch.slice(at, segment)
            counts = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), counts)
            place = part.column("terms").flatten().to_numpy(zero_copy_only=False)
            tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            norm = length_norm(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64), documents, terms)
            vectors = np.zeros((part.num_rows, queries.width), np.int32)
            vectors[row, place] = impacts(tf, norm[row])
            searcher.add(vectors, _sortable(part.column("doc_id").to_pylist()))
    found = [(q, identity[1] if not identity[0] else None, -score) for q, held in enumerate(searcher.held) for score, identity in held]
    if not found:
        return
    columns = zip(*found, strict=True)
    types = (pa.int32(), kind, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query", "doc_id", "score"])


def forward_table(docs: DataFrame, vocabulary: dict[bytes, int], identity: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs: the query terms a document holds and how often."""
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for data in batch.column("data"):
                n, counts = term_counts(data.as_py())
                known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                sizes.append(n)
                terms.append([t for t, _ in known])
                tfs.append([c for _, c in known])
            listed = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, listed), pa.array(tfs, listed)],
                ["doc_id", "n", "terms", "tfs"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _rank_block(docs: DataFrame, asked: list[tuple[object, set[bytes]]], identity: str, text: str, best: int, segment: int,
                block_documents: int, sample: int, item_type: str) -> DataFrame | None:
    """The answers of one block of queries, or None if none of them has a term."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*[terms for _, terms in asked])))}
    if not vocabulary:
        return None
    spark = docs.sparkSession
    forward = materialize(forward_table(docs, vocabulary, identity, text), "search-forward")
    holding = np.zeros(len(vocabulary), np.int64)
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the queries' terms at most
        holding[row["term"]] = row["count"]
    documents, terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    places = [np.array(sorted(vocabulary[t] for t in own), np.int64) for _, own in asked]
    weight = np.array([term_weight(documents, h) for h in holding.tolist()], np.int64)
    queries = QueryBlock(places, [weight[p] for p in places], len(vocabulary))
    kind = forward.schema["doc_id"].dataType
    found_schema = f"query int, doc_id {kind.simpleString()}, score long"

    def search(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        return rows.mapInArrow(
            lambda batches: _search(batches, queries, best, floors, documents, terms, segment, block_documents), found_schema
        )

    # any documents' scores are a floor; the rows are drawn by their number, so no key can be drawn too often
    every = max(1, documents // max(sample, 1))
    drawn = forward.where((F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0) & (F.size("terms") > 0))
    scores: dict[int, list[int]] = {}
    for row in search(drawn.repartition(1), np.zeros(len(asked), np.int64)).collect():  # best per query, of one task
        scores.setdefault(row.query, []).append(row.score)
    floors = np.array([min(scores[q]) if len(scores.get(q, ())) >= best else 0 for q in range(len(asked))], np.int64)

    found = search(forward.where(F.size("terms") > 0), floors)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], f"query int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def _query_blocks(queries: DataFrame, query_id: str, text: str, at_once: int, terms_at_once: int) -> Iterator[list[tuple[object, set[bytes]]]]:
    """The queries with their terms, a bounded number at a time; the driver holds one block."""
    block: list[tuple[object, set[bytes]]] = []
    held = 0
    rows = queries.select(F.col(f"`{query_id}`").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    for row in rows.toLocalIterator():
        terms = set(terms_of(bytes(row["data"])))
        if block and (len(block) >= at_once or held + len(terms) > terms_at_once):
            yield block
            block, held = [], 0
        block.append((row["item"], terms))
        held += len(terms)
    if block:
        yield block


def rank_documents(
    docs: DataFrame,
    queries: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    best: int = BEST,
    queries_at_once: int = QUERIES_AT_ONCE,
    terms_at_once: int = TERMS_AT_ONCE,
    segment: int = SEGMENT,
    block_documents: int = BLOCK_DOCUMENTS,
    sample: int = SAMPLE,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of every query, fewer if fewer score above 0.

    Queries are answered in blocks of ``queries_at_once``, which bounds what the driver holds and
    tasks are sent; a block reads the documents once and its forward table twice. ``sample`` documents
    give the first scores to beat and change no answer. Equal scores rank by ascending identity, null
    last. Null texts have no terms: such a document is in no answer and in no count, such a query has
    no answer. Repeated documents rank each by itself; repeated queries are answered each. Further
    columns play no part; empty tables give an empty result.
    """
    spark: SparkSession = docs.sparkSession
    item_type = queries.schema[query_id].dataType.simpleString()
    doc_type = docs.schema[identity].dataType.simpleString()
    answers = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    for asked in _query_blocks(queries, query_id, query_text, queries_at_once, terms_at_once):
        block = _rank_block(docs, asked, identity, text, best, segment, block_documents, sample, item_type)
        if block is not None:
            answers = answers.unionByName(block)
    return answers
