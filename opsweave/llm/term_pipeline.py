"""Ranked lexical search by pipelined term partitioning.

Documents are dealt to slices of a few thousand as they are read; a slice keeps, per term of
the items, a list of (document, occurrences).  Terms are dealt to owners: the first owner
has the rarest terms, and all owners hold about the same number of list entries.  The
bundles of a slice, one sparse accumulator (documents, scores) per item, pass the owners one
after the other; at each stage a cogroup by slice brings together the bundles and the lists
that this owner has for the slice, and integer contributions are added.

A stage drops accumulators that can no longer reach the slice's best ``top``: those whose
score plus the most that all later owners can give is below the score that the ``top``-th
has already.  A document dropped so may come back at a later owner with a part of its
score; that part is below the same bound, so it is not selected.  After the last owner a
slice hands on its ``top`` of each item, and a window ranks those.

No group grows with a frequent term: a slice holds at most SLICE_DOCS documents and about
SLICE_TERMS words, whichever is reached first (a longer document is a slice of its own).
Items are taken in blocks of bounded size, so that what the tasks are sent (terms, weights,
items) has a bound too; each block reads the documents once.

Defined cases: a null text has no terms; repeated document rows are documents of their own;
null document ids rank last among ties; rows of one item_id (null is an id too) are one
item with the terms of all; items without terms or matches have no rows; without documents
or items the result is empty.  Other columns of either table are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from opsweave.functions.skew import running_total, slice_by_order
from opsweave.llm.common import cut, shared_folder

TOP = 50
OWNERS = 4
SLICE_DOCS = 4096
SLICE_TERMS = 4_000_000
BLOCK_TERMS = 50_000
ITEM_COST = 50  # an item counts as so many terms more, so a block has at most 1000

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEPT else 32 for c in range(256))

LISTS = "slice long, term int, n_docs int, n_terms long, most int, docs binary, counts binary, ids array<long>"
BUNDLES = "slice long, item int, docs binary, scores binary, ids array<long>"
HEADER = -1


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and all code points from 0x80 on."""
    return text.translate(_FOLD).split()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms ARRAY<BINARY>, block): distinct terms, items dealt to bounded blocks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in _texts(batch)]
            ids = batch.column("item_id").to_pylist()
            flat = [(i, t) for i, own in zip(ids, terms) for t in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in flat], pa.int64()), pa.array([t for _, t in flat], pa.binary())], ["item_id", "term"]
            )

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = source.mapInArrow(split, "item_id long, term binary")
    grouped = cut(pairs.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("_null", F.col("item_id").isNull()))
    order = ["_null", "item_id"]
    upto = running_total(slice_by_order(grouped, [], order), [], order, F.size("terms") + ITEM_COST, "_upto")
    block = F.floor((F.col("_upto") - 1) / BLOCK_TERMS).cast("long")
    return cut(upto.select("item_id", "terms", block.alias("block")))


def write_lists(docs: DataFrame, vocabulary: list[bytes], folder: str, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """The slices' lists, written to ``folder`` and read again.

    One row per slice and term: documents as offsets in the slice and their counts.  A
    slice's header (term -1) has its documents' ids and numbers of terms.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    schema = pa.schema(
        [
            ("slice", pa.int64()), ("term", pa.int32()), ("n_docs", pa.int32()), ("n_terms", pa.int64()),
            ("most", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())),
        ]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value.get
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths = array("q")
        term, doc, count = array("i"), array("i"), array("i")

        def slice_rows() -> pa.RecordBatch:
            t, d, c = (np.frombuffer(x, "i4") if x else np.zeros(0, "i4") for x in (term, doc, count))
            order = np.argsort(t, kind="stable")
            t, d, c = t[order], d[order].astype("<u2"), c[order]
            starts = np.flatnonzero(np.diff(t, prepend=-1)) if len(t) else np.zeros(0, "i8")
            ends = np.append(starts[1:], len(t))
            spans = list(zip(starts.tolist(), ends.tolist()))
            rows = 1 + len(spans)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * rows, pa.int64()),
                    pa.array([HEADER, *t[starts].tolist()], pa.int32()),
                    pa.array([len(ids), *(e - s for s, e in spans)], pa.int32()),
                    pa.array([sum(lengths), *[0] * len(spans)], pa.int64()),
                    pa.array([0, *(np.maximum.reduceat(c, starts).tolist() if spans else [])], pa.int32()),
                    pa.array([None, *(d[s:e].tobytes() for s, e in spans)], pa.binary()),
                    pa.array([lengths.tobytes(), *(c[s:e].tobytes() for s, e in spans)], pa.binary()),
                    pa.array([ids, *[None] * len(spans)], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                words = terms_of(text)
                if not words:
                    continue
                if len(ids) >= slice_docs or ids and sum_terms + len(words) > SLICE_TERMS:
                    yield slice_rows()
                    number += 1
                    ids, lengths = [], array("q")
                    term, doc, count = array("i"), array("i"), array("i")
                if not ids:
                    sum_terms = 0
                at = len(ids)
                for word, n in Counter(words).items():
                    t = known(word)
                    if t is not None:
                        term.append(t), doc.append(at), count.append(n)
                ids.append(doc_id), lengths.append(len(words))
                sum_terms += len(words)
        if ids:
            yield slice_rows()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source.mapInArrow(index, LISTS).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def contribution(weight: int, counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to documents with ``counts`` of it among ``lengths`` terms."""
    m = 100 - 50 + (50 * lengths * n_docs) // n_terms
    return weight * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


@dataclass
class Route:
    """What the owners know of a block of items; its size is bounded by the block's."""

    n_docs: int
    n_terms: int
    weights: dict[int, int]
    owners: dict[int, int]
    items: list[tuple[int | None, list[list[int]], list[int]]]  # id, terms by owner, most that later owners can add


def plan_route(lists: DataFrame, items: list[tuple[int | None, list[int]]], owners: int) -> Route | None:
    """Weights, owners in descending order of weight, and bounds; None if no document has terms."""
    n_docs, n_terms = lists.where(F.col("term") == HEADER).agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    found = lists.where(F.col("term") != HEADER).groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("most").alias("most")).collect()
    weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
    entries, total, owner = 0, sum(r["df"] for r in found), {}
    for r in sorted(found, key=lambda r: (r["df"], r["term"])):
        owner[r["term"]] = min(owners - 1, owners * entries // total)
        entries += r["df"]
    bound = {r["term"]: weights[r["term"]] * (1_000_000_000 * r["most"] // (1000 * r["most"] + 20 * 50)) for r in found}
    routed = []
    for item_id, terms in items:
        visits = [[t for t in terms if owner.get(t) == o] for o in range(owners)]
        most = [sum(bound[t] for own in visits[o + 1 :] for t in own) for o in range(owners)]
        routed.append((item_id, visits, most))
    return Route(n_docs, n_terms, weights, owner, routed)


def _bundle_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slice", "item", "docs", "scores", "ids"])


def visit(route: Route, owner: int, top: int, bundles: pa.Table, lists: pa.Table, last: bool) -> pa.Table:
    """One owner's stage on one slice; the last one returns (item_id, doc_id, score)."""
    carried = {i: k for k, i in enumerate(bundles.column("item").to_pylist())}
    header = carried[HEADER]
    number, ids = bundles.column("slice")[header].as_py(), bundles.column("ids")[header].as_py()
    raw = bundles.column("scores")[header].as_py()
    lengths = np.frombuffer(raw, "<i8")
    added = {}
    for t, docs, counts in zip(*(lists.column(c).to_pylist() for c in ("term", "docs", "counts"))):
        at = np.frombuffer(docs, "<u2").astype("i8")
        added[t] = at, contribution(route.weights[t], np.frombuffer(counts, "<i4").astype("i8"), lengths[at], route.n_docs, route.n_terms)
    rows: list[tuple] = [] if last else [(number, HEADER, None, raw, ids)]
    best: list[tuple] = []
    for item, (item_id, visits, most) in enumerate(route.items):
        score = np.zeros(len(lengths), "i8")
        if item in carried:
            at = np.frombuffer(bundles.column("docs")[carried[item]].as_py(), "<u2")
            score[at] = np.frombuffer(bundles.column("scores")[carried[item]].as_py(), "<i8")
        for t in visits[owner]:
            if t in added:
                at, gain = added[t]
                score[at] += gain
        live = np.flatnonzero(score)
        if len(live) > top:
            reached = score[live]
            live = live[reached + most[owner] >= np.partition(reached, len(reached) - top)[len(reached) - top]]
        if not len(live):
            continue
        if not last:
            rows.append((number, item, live.astype("<u2").tobytes(), score[live].tobytes(), None))
            continue
        ranked = sorted(live.tolist(), key=lambda d: (-int(score[d]), ids[d] is None, ids[d] or 0))[:top]
        best.extend((item_id, ids[d], int(score[d])) for d in ranked)
    if not last:
        return _bundle_table(rows)
    columns = list(zip(*best)) if best else [[]] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])


def _run_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], top: int, owners: int, slice_docs: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    if not vocabulary:
        return None
    number = {t: i for i, t in enumerate(vocabulary)}
    lists = write_lists(docs, vocabulary, shared_folder(spark, "term-lists"), slice_docs)
    route = plan_route(lists, [(i, [number[t] for t in terms]) for i, terms in items], owners)
    if route is None:
        return None
    shipped = spark.sparkContext.broadcast(route)
    owner_of = F.broadcast(spark.createDataFrame(sorted(route.owners.items()) or [(0, 0)], "term int, owner int"))  # one row per term of the block
    owned = lists.where(F.col("term") != HEADER).select("slice", "term", "docs", "counts").join(owner_of, "term")
    bundles = lists.where(F.col("term") == HEADER).select(
        F.col("slice").alias("slice"), F.lit(HEADER).alias("item"), F.lit(None).cast("binary").alias("docs"), F.col("counts").alias("scores"), "ids"
    )

    def stage(owner: int, last: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return visit(shipped.value, owner, top, left, right, last)

        return run

    for owner in range(owners):
        last = owner == owners - 1
        part = owned.where(F.col("owner") == owner).select("slice", "term", "docs", "counts")
        schema = "item_id long, doc_id long, score long" if last else BUNDLES
        bundles = bundles.groupBy("slice").cogroup(part.groupBy("slice")).applyInArrow(stage(owner, last), schema)
    return bundles


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item, scores above 0."""
    if not 1 <= slice_docs <= 1 << 16:
        raise ValueError("offsets in a slice are 16 bits wide")
    spark = docs.sparkSession
    dealt = item_terms(items)
    found = []
    for (block,) in sorted(dealt.select("block").distinct().collect()):  # one row per BLOCK_TERMS terms
        rows = dealt.where(F.col("block") == block).select("item_id", "terms").collect()
        part = _run_block(docs, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows], top, owners, slice_docs)
        if part is not None:
            found.append(part)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    both = found[0]
    for part in found[1:]:
        both = both.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def oracle(top: int = TOP) -> str:
    """The same ranking in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(upper, upper.lower())
    return f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {split} AS terms FROM documents),
d AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM w WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
k AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, d.doc_id, d.r, CAST(sum(k.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN k USING (term) JOIN d ON d.r = p.r, s GROUP BY item_id, d.doc_id, d.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) t WHERE rank <= {top}"""
