"""Near duplicates by Order MinHash, verified by alignment.

A text's k-mers are its five-word shingles, each labelled with its occurrence number.  A
sketch takes the ``picks`` smallest under one hash and keeps them in text order, so two texts
share it only if they share those shingles in that order.  Texts with a sketch in common are
candidates.  A pair is similar if it reaches the threshold in one of two ways, each a share of
the longer text.  The first is its edit similarity: words less the edits that a banded alignment
needs, with the band that the threshold allows, so that changed words cost one each wherever they
stand.  The second is the share of shingles that both have in the same order, by an alignment in a
narrow band or the longest common subsequence, so that a moved block costs the shingles it breaks.

Equal texts are one node.  In a bucket of up to ``small`` texts all pairs are compared.  In a
larger one all are compared with one of them, the lowest, so a group of n copies costs some
n pairs.  What that leaves open is settled exactly: texts of large buckets that are in
different components so far are compared if they share ``rare_share`` of their shingles: such
texts have one in common among the rarest n - rare_share * n + 1 of each, so these are joined.
Texts that edits alone make similar share fewer where each edit breaks five shingles of its own;
these rest on the sketches.  A passage on thousands of pages is not among its pages' rarest
shingles, and brings no pairs.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from opsweave.llm.common import cut, fingerprint, small_batches, small_side
from opsweave.llm.line_quality import words_of
from opsweave.operators.graph import connected_components

K = 5
U = np.uint64


@dataclass(frozen=True)
class SketchRules:
    sketches: int = 36
    picks: int = 3
    similarity: float = 0.8
    rare_share: float = 0.6
    small: int = 16
    seed: int = 20_240_601


class _WordHash(dict):
    """64-bit hashes of words, kept while the worker lives."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of hashed words, in order; a shorter text is one shingle."""
    n = max(1, len(h) - K + 1)
    out = np.zeros(n, U)
    for k in range(min(K, len(h))):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingles mixed with their occurrence number."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.ones(len(grams), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    if first.all():
        return grams
    at = np.arange(len(grams))
    nth = np.empty(len(grams), U)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U)
    return np.where(nth > 0, _mix(grams + nth * U(0xD6E8FEB86659FD93)), grams)


def sketch(grams: np.ndarray, rules: SketchRules) -> list[int]:
    """One value per sketch over labelled shingles: its number, and its picks in text order, hashed."""
    n, m = len(grams), min(rules.picks, len(grams))
    keys = _keys(rules.sketches, rules.seed)
    out = np.empty(rules.sketches, U)
    block = max(1, 2_000_000 // n)  # bounds the table of a long text
    for start in range(0, rules.sketches, block):
        some = keys[start : start + block, None]
        hashed = grams[None, :] * some
        hashed ^= hashed >> U(32)
        picked = np.sort(np.argpartition(hashed, m - 1, axis=1)[:, :m], axis=1) if n > m else np.tile(np.arange(n), (len(some), 1))
        value = some[:, 0].copy()
        for k in range(m):
            value = _mix(value * U(0x9E3779B97F4A7C15) + grams[picked[:, k]])
        out[start : start + block] = value
    return out.view(np.int64).tolist()


@functools.cache
def _keys(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=U) | U(1)


CELLS = 4_000_000
NARROW = 16  # edits up to which pairs are aligned by words
DENSE = 8  # equal pairs of shingles a shingle, beyond which they are not listed
MASK_BITS = 500_000_000
KEPT = 32  # texts a task keeps ready while it compares pairs


def align(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int, list[tuple[int, int]]] | None:
    """Edit distance and matched runs (start in x, length) within a band of ``most``, or None.

    The band starts narrow and doubles.  Within it, for each number of edits, each diagonal
    keeps the furthest row it reaches; a table says where a diagonal's next difference is.
    """
    if abs(len(x) - len(y)) > most:
        return None
    band = min(most, max(4, abs(len(x) - len(y))))
    while True:
        found = _in_band(x, y, band)
        if found is not None or band >= most:
            return found
        band = min(most, band * 2)


def _next_differences(x: np.ndarray, y: np.ndarray, band: int):
    """A function (diagonals from -band, rows) -> rows of the next difference or end."""
    n, m = len(x), len(y)

    def differing(low: int, high: int, d: int) -> np.ndarray:
        return np.flatnonzero(x[low:high] != y[low + d : high + d]) + low

    if (2 * band + 1) * (n + 1) <= CELLS:
        rows = np.arange(n)
        columns = rows[None, :] + np.arange(-band, band + 1)[:, None]
        inside = (columns >= 0) & (columns < m)
        same = inside & (x[None, :] == y[np.clip(columns, 0, max(0, m - 1))]) if m else np.zeros(columns.shape, bool)
        table = np.full((2 * band + 1, n + 1), n, "i4")
        table[:, :n] = np.where(same, n, rows[None, :])
        table = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1]
        return lambda at, row: table[at, row]

    breaks: dict[int, np.ndarray] = {}

    def searched(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = row.copy()
        for i, (k, r) in enumerate(zip(at.tolist(), row.tolist())):
            d = k - band
            stop = min(n, m - d)
            if r < stop:
                if d not in breaks:
                    breaks[d] = differing(max(0, -d), stop, d)
                j = breaks[d].searchsorted(r)
                out[i] = breaks[d][j] if j < len(breaks[d]) else stop
        return out

    return searched


def _in_band(x: np.ndarray, y: np.ndarray, band: int) -> tuple[int, list[tuple[int, int]]] | None:
    n, m = len(x), len(y)
    diagonals = np.arange(-band, band + 1)
    last, first, goal = np.minimum(n, m - diagonals), np.maximum(0, -diagonals), m - n + band
    onward = _next_differences(x, y, band)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.full(2 * band + 1, -9, "i8")
    start[band] = 0
    for edits in range(band + 1):
        if edits:
            before = levels[-1][1]
            start = before + 1
            start[1:] = np.maximum(start[1:], before[:-1])
            start[:-1] = np.maximum(start[:-1], before[1:] + 1)
            start = np.minimum(start, last)
            start[start < first] = -9
        stop = start.copy()
        on = np.flatnonzero(start >= 0)
        stop[on] = onward(on, start[on])
        levels.append((start, stop))
        if stop[goal] >= n:
            break
    else:
        return None
    runs, at = [], goal
    for level in range(edits, -1, -1):
        start, stop = (int(v[at]) for v in levels[level])
        if stop > start:
            runs.append((start, stop - start))
        if level:
            before = levels[level - 1][1]
            moves = ((at, 1), (at - 1, 0), (at + 1, 1))
            at = next(k for k, step in moves if 0 <= k <= 2 * band and before[k] >= 0 and min(before[k] + step, last[at]) == start)
    return edits, runs[::-1]


def prepared(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and sorted labelled shingles of a text."""
    h = word_hashes(words_of(text))
    return h, np.sort(labelled(shingles(h)))


def shared_in_order(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays of shingles."""
    order = np.argsort(y, kind="stable")
    ordered = y[order]
    low, high = ordered.searchsorted(x, "left"), ordered.searchsorted(x, "right")
    counts = high - low
    total = int(counts.sum())
    if total <= DENSE * (len(x) + len(y)):
        # places in y, latest first within a shingle of x: the longest rising sequence
        places = order[np.repeat(high - 1 + np.cumsum(counts) - counts, counts) - np.arange(total)]
        tails: list[int] = []
        for j in places.tolist():
            k = bisect_left(tails, j)
            if k == len(tails):
                tails.append(j)
            else:
                tails[k] = j
        return len(tails)
    # shingles that repeat often: a bit per place in y, cleared where the subsequence grows
    whole = free = (1 << len(y)) - 1
    masks: dict[int, int] = {}
    for i in np.flatnonzero(counts).tolist():
        at = int(low[i])
        mask = masks.get(at)
        if mask is None:
            if len(masks) * len(y) > MASK_BITS:
                masks.clear()
            flags = np.zeros(len(y), "u1")
            flags[order[at : high[i]]] = 1
            mask = masks[at] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        met = free & mask
        free = ((free + met) | (free - met)) & whole
    return len(y) - free.bit_count()


def window_masks(x: np.ndarray):
    """A function (word, low, width) -> bits of the places from ``low`` on at which ``x`` has the word."""
    order = np.argsort(x, kind="stable")
    words, starts = np.unique(x[order], return_index=True)
    places = dict(zip(words.tolist(), np.split(order, starts[1:])))

    def bits(word: int, low: int, width: int) -> int:
        at = places.get(word)
        if at is None:
            return 0
        first, last = (0, len(at)) if len(at) < 4 else at.searchsorted([low, low + width]).tolist()
        if last - first <= 8:
            return sum(1 << p - low for p in at[first:last].tolist() if low <= p < low + width)
        flags = np.zeros(width, "u1")
        flags[at[first:last] - low] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    return bits


def banded_distance(x: np.ndarray, y: np.ndarray, band: int) -> int | None:
    """Edit distance of two arrays of words if it is at most ``band``, else None.

    Bit t of column j stands for row j - band + t of the alignment table; the bits say where
    the table rises and falls downwards, so a column costs a few operations on whole integers
    and memory holds one column.
    """
    n, m = len(x), len(y)
    if abs(n - m) > band:
        return None
    if n < band:  # the band begins inside the table
        fill = np.zeros(band - n, U)
        x, y, n, m = np.concatenate([fill, x]), np.concatenate([fill, y]), band, m + band - n
    width = 2 * band + 1
    every, top = (1 << width) - 1, 1 << 2 * band
    bits = window_masks(x)
    rises, falls, edits = every >> band << band, 0, band
    beyond = m - n + 2 * band
    for j, word in enumerate(y.tolist(), 1):
        same = bits(word, j - band - 1, width)
        level = ((((same & rises) + rises) ^ rises) | same | falls) & every
        right, left = falls | (every & ~(level | rises)), level & rises
        if j + band <= n:
            edits += not level & top
            if edits > beyond:
                return None
        else:
            last = n - j + band
            edits += (right >> last & 1) - (left >> last & 1)
        level >>= 1
        rises, falls = left | (every & ~(level | right)), level & right
    return edits if edits <= band else None


def edit_similarity(x: np.ndarray, y: np.ndarray, similarity: float) -> float:
    """Words less edits, as a share of the longer text's; 0 below the threshold."""
    longest = max(len(x), len(y))
    common = len(np.intersect1d(labelled(x), labelled(y), assume_unique=True))
    if common < similarity * longest - 1e-9:
        return 0.0  # each word without a partner takes an edit
    edits = banded_distance(x, y, int((1 - similarity) * longest + 1e-9))
    return 0.0 if edits is None else (longest - edits) / longest


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> float:
    """Share of shingles in the same order, or else the edit similarity, whichever reaches the threshold.

    Texts under five words are similar if they are equal.  Where neither reaches it, a value below the threshold.
    """
    (x, x_grams), (y, y_grams) = a, b
    longest = max(len(x), len(y))
    n = longest - K + 1
    if n < 1:
        return float(np.array_equal(x, y))
    if min(len(x), len(y)) < similarity * longest:
        return 0.0
    share = 0.0
    if len(np.intersect1d(x_grams, y_grams, assume_unique=True)) >= similarity * n:
        found = align(x, y, NARROW)
        share = sum(max(0, length - K + 1) for _, length in found[1]) / n if found else 0.0
        share = share if share >= similarity else shared_in_order(shingles(x), shingles(y)) / n
    return share if share >= similarity else max(share, edit_similarity(x, y, similarity))


class Words:
    """Hashed words of a text, and what comparisons derive from them, each on first use."""

    def __init__(self, text: str) -> None:
        self.h = word_hashes(words_of(text))

    @functools.cached_property
    def sorted(self) -> np.ndarray:
        """Words labelled with their occurrence, sorted."""
        return np.sort(labelled(self.h))

    @functools.cached_property
    def grams(self) -> np.ndarray:
        return shingles(self.h)

    @functools.cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles sorted, and where they stand."""
        order = np.argsort(self.grams, kind="stable")
        return self.grams[order], order


def worded(text: str) -> Words:
    return Words(text)


def rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, j in enumerate(places):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            ends.append(i)
        else:
            tails[k], ends[k] = j, i
        before[i] = ends[k - 1] if k else -1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def one_alignment(a: Words, b: Words) -> tuple[int, int]:
    """Shingles in the same order, and edits, of one alignment of two texts of five words or more.

    Each shingle of ``a`` is tied to its first place in ``b``.  The best alignment has as many shingles
    in order or more, and as many edits or fewer.
    """
    n, m = len(a.h), len(b.h)
    ordered, order = b.places
    at = np.minimum(ordered.searchsorted(a.grams), len(ordered) - 1)
    i = np.flatnonzero(ordered[at] == a.grams)
    j = order[at[i]]
    if len(i) > 1 and (np.diff(j) <= 0).any():
        chain = rising(j.tolist())
        i, j = i[chain], j[chain]
    if not len(i):
        return 0, max(n, m)
    new = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1))
    first, last = np.concatenate([[0], new + 1]), np.concatenate([new, [len(i) - 1]])
    # Words between the runs, where overlapping ends (under five words) are taken from the later run.
    x_gap, y_gap = i[first[1:]] - i[last[:-1]] - K, j[first[1:]] - j[last[:-1]] - K
    cut_off = np.maximum(0, np.maximum(-x_gap, -y_gap))
    inside = int((np.maximum(x_gap, y_gap) + cut_off).sum())
    return len(i), inside + int(max(i[0], j[0])) + int(max(n - i[-1] - K, m - j[-1] - K))


def near(a: Words, b: Words, similarity: float) -> bool:
    """Whether ``compare`` reaches the threshold, by the cheapest way that decides it.

    One alignment by shingles shows it for most similar pairs.  Of the others, both shares need that
    share of words in common, in whatever order.
    """
    x, y = a.h, b.h
    longest = max(len(x), len(y))
    if longest < K:
        return np.array_equal(x, y)
    if min(len(x), len(y)) < similarity * longest:
        return False
    band = int((1 - similarity) * longest + 1e-9)
    n = longest - K + 1
    if min(len(x), len(y)) >= K:
        in_order, edits = one_alignment(a, b)
        if edits <= band or in_order / n >= similarity:
            return True
    if len(np.intersect1d(a.sorted, b.sorted, assume_unique=True)) < similarity * longest - 1e-9:
        return False
    if band <= NARROW and align(x, y, band) is not None:
        return True
    if shared_in_order(a.grams, b.grams) / n >= similarity:
        return True
    return band > NARROW and banded_distance(x, y, band) is not None


def text_nodes(docs: DataFrame, rules: SketchRules) -> DataFrame:
    """doc_id, fp, node (a digest of the words) and sketch of every row of (doc_id, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                nodes.append(xxhash.xxh3_128_digest(" ".join(words)))
                sizes.append(len(words))
                sketches.append(sketch(labelled(shingles(word_hashes(words))), rules) if words else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "fp", "node", "n_words", "sketch"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), fingerprint().alias("fp"))
    return source.mapInArrow(digest, "doc_id long, fp long, node binary, n_words int, sketch array<long>")


def rarest_shingles(texts: DataFrame, components: DataFrame, rules: SketchRules) -> DataFrame:
    """(gram, node, n) for the rarest labelled shingles of each text, as many as the threshold allows to differ, and one.

    Only shingles that occur in several components bring pairs.  Those of one component count as rarer than all others,
    which is an order too, so they are left out, and a text with fewer others than the share asks for has none.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                grams = [labelled(shingles(word_hashes(words_of(text)))).view(np.int64) for text in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("component"), pa.array(grams, pa.list_(pa.int64()))], names=["node", "component", "grams"])

    placed = texts.join(components, "node", "left").select("node", F.xxhash64(F.coalesce("component", "node")).alias("component"), "text")
    packed = cut(placed.mapInArrow(spread, "node binary, component long, grams array<long>"))
    met = packed.select(F.explode("grams").alias("gram"), "component").groupBy("gram")
    several = met.agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = cut(several.where("low <> high").select("gram", "often"))
    grams = packed.select("node", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram")).join(small_side(several), "gram")
    own = Window.partitionBy("node")
    ranked = grams.withColumns({"place": F.row_number().over(own.orderBy("often", "gram")), "others": F.count(F.lit(1)).over(own)})
    return ranked.where(F.col("place") <= F.col("others") - F.ceil(F.col("n") * rules.rare_share - 1e-9) + 1).select("gram", "node", "n")


def pairs_across(rare: DataFrame, components: DataFrame, rules: SketchRules, representatives: bool) -> DataFrame:
    """Pairs (a, b) of texts with a rare shingle in common, in different components, near enough in size."""
    placed = rare.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    across = placed.join(several, "gram", "left_semi")
    if representatives:
        ends = across.groupBy("gram", "component").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high"))
        across = ends.select("gram", "component", F.explode(F.array_distinct(F.array("low", "high"))).alias("end")).select("gram", "component", "end.node", "end.n")
    one = across.select("gram", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_in"))
    two = across.select("gram", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_in"))
    near = F.least("a_n", "b_n") + K - 1 >= rules.similarity * (F.greatest("a_n", "b_n") + K - 1) - 1e-9
    return one.join(two, "gram").where((F.col("a") < F.col("b")) & (F.col("a_in") != F.col("b_in")) & near).select("a", "b").distinct()


def verify(pairs: DataFrame, texts: DataFrame, rules: SketchRules) -> DataFrame:
    """Adds ``similar`` to the pairs (a, b) of nodes; ``texts`` has node and text once each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, Words] = {}

        def words(node: bytes, text: pa.StringScalar) -> Words:
            if node not in last:
                if len(last) >= KEPT:
                    last.clear()
                last[node] = worded(text.as_py())
            return last[node]

        for batch in batches:
            a_nodes, a_texts, b_nodes, b_texts = (batch.column(c) for c in ("a", "a_text", "b", "b_text"))
            ends = zip(a_nodes.to_pylist(), a_texts, b_nodes.to_pylist(), b_texts)
            similar = [near(words(a, a_text), words(b, b_text), rules.similarity) for a, a_text, b, b_text in ends]
            yield pa.RecordBatch.from_arrays([a_nodes, b_nodes, pa.array(similar, pa.bool_())], names=["a", "b", "similar"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(check, "a binary, b binary, similar boolean")


def similar_pairs(pairs: DataFrame, texts: DataFrame, rules: SketchRules) -> DataFrame:
    return verify(pairs, texts, rules).where("similar").select("a", "b")


def near_duplicates(docs: DataFrame, rules: SketchRules = SketchRules()) -> DataFrame:
    """doc_id, fp, class_id, n_links and keep of each row of (doc_id, text).

    ``class_id`` is the lowest id of the class, null if none of its rows has one; ``keep`` marks its row.  ``n_links`` counts the
    verified links of the row's text to other texts.  Equal word sequences are one text
    without a link; texts without words are equal.  Null texts are empty.
    """
    small_batches(docs.sparkSession)
    rows = cut(text_nodes(docs, rules))
    owners = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "sketch")).alias("own"))
    nodes = cut(owners.select("node", F.col("own.doc_id").alias("doc_id"), F.col("own.fp").alias("fp"), F.col("own.sketch").alias("sketch")))
    entries = nodes.select(F.posexplode("sketch").alias("no", "value"), "node").select(F.xxhash64("no", "value").alias("bucket"), "node")
    # the lowest node is most often the same in a group's buckets, so their pairs are the same
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    buckets = cut(entries.join(counts, "bucket"))
    met = cut(buckets.groupBy("node").agg(F.max(F.col("n") > rules.small).alias("large")))

    wanted = cut(met.join(nodes, "node").select("node", F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp")))
    source = docs.select("doc_id", fingerprint().alias("fp"), F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(source.join(small_side(wanted), source["doc_id"].eqNullSafe(F.col("_doc")) & (source["fp"] == F.col("_fp"))).select("node", "text").dropDuplicates(["node"]))

    small = buckets.where(F.col("n") <= rules.small).select("bucket", "node")
    one, two = small.withColumnRenamed("node", "a"), small.withColumnRenamed("node", "b")
    pairs = one.join(two, "bucket").where("a < b").select("a", "b")
    large = buckets.where(F.col("n") > rules.small).where("node <> first")
    pairs = cut(pairs.unionByName(large.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))).distinct())
    links = cut(similar_pairs(pairs, texts, rules))

    # first the lowest and highest text of each component at a shingle, which joins most; then all, between components
    settled = cut(connected_components(links, "a", "b"))
    rare = cut(rarest_shingles(texts.join(met.where("large"), "node", "left_semi"), settled, rules))
    more = cut(pairs_across(rare, settled, rules, True).join(pairs, ["a", "b"], "left_anti"))
    links = cut(links.unionByName(similar_pairs(more, texts, rules)))
    components = cut(connected_components(links, "a", "b"))
    last = pairs_across(rare, components, rules, False).join(pairs.unionByName(more), ["a", "b"], "left_anti")
    found = cut(similar_pairs(last, texts, rules))
    if not found.isEmpty():
        links = cut(links.unionByName(found))
        components = connected_components(links, "a", "b")
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    marked = rows.select("doc_id", "fp", "node").join(components, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = marked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("keeper"))
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("fp") == F.col("keeper.fp"))
    return marked.join(lowest, "component").select("doc_id", "fp", F.col("keeper.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("keep"))


def without_near_duplicates(docs: DataFrame, rules: SketchRules = SketchRules()) -> DataFrame:
    """``docs`` with one document of each class: the one with the lowest id.

    Of rows that repeat it one stays.
    """
    found = near_duplicates(docs, rules).groupBy("doc_id", "fp").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    odd = cut(found.where(~F.col("keep") | (F.col("n") > 1)).select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), "keep"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), fingerprint(docs["text"]).alias("_own"))
    test = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_fp"))
    single = rows.join(small_side(odd), test, "left_anti").select("_row")
    repeated = rows.join(small_side(odd.where("keep")), test, "left_semi").dropDuplicates(["_id", "_own"]).select("_row")
    return single.unionByName(repeated).select("_row.*")
