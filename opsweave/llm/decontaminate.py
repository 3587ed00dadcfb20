"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders.  Windows of canonical words are
hashed and joined with the benchmark's; windows that meet are compared word by word, and
what stood in their slots must be consistent: within one alignment of an item with a
document, a slot value of the item always corresponds to one value of the document.  That
holds for copies and for questions asked again with other parameters.

All of it is DataFrame expressions.  Only hits carry more than a hash: texts are read
again for documents with hits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import bind, cut, fingerprint, small_side

TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}\p{N}]+"
NUMBER, UNIT, NAME = "#", "@", "$"

# Words that stand for numbers and units.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter double twice").split()
UNIT_WORDS = ("mm cm dm km metre metres meter meters kilometre kilometres kilometer kilometers mile miles inch inches foot feet yard yards "
              "mg kg gram grams kilogram kilograms tonne tonnes ton tons ounce ounces pound pounds ml litre litres liter liters gallon gallons pint pints "
              "second seconds minute minutes hour hours day days week weeks month months year years "
              "cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin mph kmh watt watts volt volts joule joules").split()


@dataclass(frozen=True)
class TemplateRules:
    """Windows of ``width`` words, of which ``literals`` are no slots; ``windows`` of them (all,
    of an item that has fewer) in one alignment make a leak."""

    width: int = 8
    literals: int = 4
    windows: int = 6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    """A word as it stands in a template; every capitalised word is taken for a name."""
    low = F.lower(token)
    return (
        F.when(((token >= "0") & (token < ":")) | low.isin(NUMBER_WORDS), NUMBER)
        .when(low.isin(UNIT_WORDS), UNIT)
        .when(low != token, NAME)
        .otherwise(token)
    )


def window_hashes(words: Column, width: int) -> Column:
    """Hashes of the windows of an array of template words, in order; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    whole = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, width))))
    return F.when(F.size(words) >= width, whole).otherwise(F.array().cast("array<long>"))


def benchmark_items(benchmark: DataFrame, rules: TemplateRules) -> tuple[DataFrame, DataFrame]:
    """Items (key, item_id, raw, plain, n_item) and their specific windows (h, key, at, length).

    ``key`` tells texts of one item_id apart, n_item is a text's number of specific windows.
    """
    worded = benchmark.where("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("raw")).distinct()
    plain = cut(worded.select(F.xxhash64("item_id", "raw").alias("key"), "item_id", "raw", F.transform("raw", lambda w: canonical(w)).alias("plain")))
    spread = plain.select("key", "plain", F.posexplode(window_hashes(F.col("plain"), rules.width)).alias("at", "h"))
    literal = F.size(F.filter(F.slice("plain", F.col("at") + 1, rules.width), lambda w: ~w.isin(NUMBER, UNIT, NAME)))
    windows = cut(spread.where(literal >= rules.literals).select("h", "key", "at", F.size("plain").alias("length")))
    return cut(plain.join(windows.groupBy("key").agg(F.count(F.lit(1)).alias("n_item")), "key")), windows


def _aligned(width: int) -> tuple[Column, Column]:
    """(windows, slots) of a row with own words, the item's ``theirs`` and ``plain``, and hit places ``ats``.

    Windows are the places where all words agree as templates; slots are those that such a
    window covers, specific or not, as (kind, value in the item, value in the document).
    """
    same = F.zip_with("plain", F.transform("own", lambda w: canonical(w)), lambda b, d: b == d)

    def whole(equal: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(equal) - (width - 1)), lambda i: F.forall(F.slice(equal, i, width), lambda e: e))

    def windows(good: Column) -> Column:
        return F.filter("ats", lambda at: F.get(good, at))

    def slots(good: Column) -> Column:
        at = F.transform("plain", lambda kind, i: F.struct(kind.alias("kind"), F.get("theirs", i).alias("item"), F.get("own", i).alias("doc"), F.slice(good, F.greatest(i - (width - 2), F.lit(1)), F.least(i + 1, F.lit(width))).alias("near")))
        used = F.filter(at, lambda s: s["kind"].isin(NUMBER, UNIT, NAME) & F.exists(s["near"], lambda g: g))
        return F.array_distinct(F.transform(used, lambda s: F.struct(s["kind"], s["item"], s["doc"])))

    return bind(bind(same, whole), windows), bind(bind(same, whole), slots)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """doc_id, fp, item_id, n_windows, n_item, n_slots, n_changed for each document that leaks an item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  Counts are of the item's
    best alignment.  Null and short texts have no windows; items shorter than a window,
    with fewer literal words than the rules ask for, or without an id, are not looked for.
    Repeated rows give one result.  Rows of one id with different texts are told apart by fp.
    """
    items, windows = benchmark_items(benchmark, rules)
    doc = docs.select("doc_id", fingerprint().alias("fp"), F.posexplode(bind(F.transform(tokens(F.col("text")), lambda w: canonical(w)), lambda words: window_hashes(words, rules.width))).alias("pos", "h"))
    hits = doc.join(small_side(windows), "h").groupBy("doc_id", "fp", "key", "length", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    per_doc = cut(hits.groupBy(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp")).agg(F.collect_list(F.struct("key", "length", "shift", "ats")).alias("hits")))

    text = docs.select("doc_id", "text", fingerprint().alias("fp"))
    own = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("fp") == F.col("_fp"))
    read_again = text.join(small_side(per_doc.select("_doc", "_fp")), own, "left_semi").dropDuplicates(["doc_id", "fp"]).join(per_doc, own)

    def cut_out(raw: Column) -> Column:
        first = lambda h: F.greatest(-h["shift"], F.lit(0))
        return F.transform("hits", lambda h: F.struct(h["key"].alias("key"), first(h).alias("first"), F.transform(h["ats"], lambda at: at - first(h)).alias("ats"), F.slice(raw, h["shift"] + first(h) + 1, h["length"] - first(h)).alias("own")))

    met = read_again.select("doc_id", "fp", F.explode(bind(tokens(F.col("text")), cut_out)).alias("m")).select("doc_id", "fp", "m.*")
    part = lambda c: F.slice(c, F.col("first") + 1, F.size("own"))
    placed = met.join(small_side(items), "key").select("doc_id", "fp", "item_id", "n_item", "ats", "own", part("raw").alias("theirs"), part("plain").alias("plain"))
    found, slots = _aligned(rules.width)
    judged = placed.select("doc_id", "fp", "item_id", "n_item", F.size(found).alias("n_windows"), slots.alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))))
    changed = F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))
    enough = F.col("n_windows") >= F.least(F.lit(rules.windows), F.col("n_item"))
    leaks = judged.where((values == F.size("slots")) & enough).select("doc_id", "fp", "item_id", F.struct(F.col("n_windows").cast("long").alias("n_windows"), "n_item", (-changed).cast("long").alias("minus_changed"), values.cast("long").alias("n_slots")).alias("best"))
    top = leaks.groupBy("doc_id", "fp", "item_id").agg(F.max("best").alias("best"))
    return top.select("doc_id", "fp", "item_id", F.col("best.n_windows").alias("n_windows"), F.col("best.n_item").alias("n_item"), F.col("best.n_slots").alias("n_slots"), (-F.col("best.minus_changed")).alias("n_changed"))


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` without the documents in ``leaks``."""
    found = cut(leaks.select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), fingerprint(docs["text"]).alias("_own"))
    return rows.join(small_side(found), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_fp")), "left_anti").select("_row.*")
