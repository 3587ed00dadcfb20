"""Information-theoretic sanitisation of personal data.

Patterns find protected entities: addresses, numbers and phones.  The corpus then tells
which other terms reveal them.  A term t in a text with an entity e has

    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t)))   and   IC(e) = log2(N / n(e)),

n counted over distinct texts; PMI reaches IC when t occurs with e only.  A term with
PMI >= generalise_at * IC is generalised to its kind of word, with PMI >= remove_at * IC it
is removed.  Pairs need ``support`` texts, so that a chance meeting reveals nothing.

All of it is DataFrame expressions.  Entities and the words of their texts are found in one
pass; document frequencies are counted in a second one over all words of all texts, for
the terms that are candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import cut, fingerprint, small_side

# The patterns of the contract, kinds in order.  Quantifiers are possessive where
# giving back could not lead to a match; an address starts where its run of characters does, or
# where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
SPAN = "array<struct<start:long,end:long>>"
TERM_SPANS = "array<struct<start:long,end:long,action:string>>"


@dataclass(frozen=True)
class DisclosureRules:
    reach: int = 80  # not used: terms count and are marked in whole texts
    min_letters: int = 1
    support: int = 3
    generalise_at: float = 0.9
    remove_at: float = 0.98


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches, in code points.

    What lies between the matches gives the places: a match starts after all gaps and
    matches before it.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), F.char_length(g).alias("gap")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["gap"]
        b = a + F.char_length(p["v"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), p["v"].alias("value")))).alias("out"))

    return F.aggregate(F.filter(pieces, lambda p: p["v"].isNotNull()), start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, spans: Column) -> Column:
    if kind == "ip":
        return F.filter(spans, lambda s: ~F.exists(F.split(s["value"], r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.filter(spans, lambda s: F.when(F.length(digits(s["value"])).between(16, 19), luhn(digits(s["value"]))).otherwise(False))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(digits(s["value"])).between(8, 15))
    return spans


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text and an array of (start, end, value) per kind."""
    needs = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9][ -]?[0-9]"), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint().alias("fp"), F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", "fp", "text", *[F.when(needs[k], valid(k, matches(F.col("text"), p))).otherwise(none).alias(k) for k, p in PATTERNS.items()])


def entity_of(kind: str, value: Column) -> Column:
    """A match as an entity: its kind, and its digits or its lower case."""
    return F.concat(F.lit(f"{kind}:"), digits(value) if kind in ("card", "phone") else F.lower(value))


def terms_of(text: Column, rules: DisclosureRules) -> Column:
    """Distinct whole words of a text outside its addresses, in lower case."""
    outside = F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit("@"))
    return F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(r"\p{L}{%d,}+" % rules.min_letters), F.lit(0)), lambda w: F.lower(w)))


def with_terms(found: DataFrame, rules: DisclosureRules) -> DataFrame:
    """Adds the entities and, where there are any, the terms of a text; base spans without their values replace the arrays per kind."""

    def values(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: entity_of(kind, s["value"]))

    none = F.array().cast("array<string>")
    held = F.array_distinct(F.concat(*map(values, PATTERNS)))
    some = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    plain = [F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS]
    return found.select("doc_id", "fp", *plain, F.when(some, held).otherwise(none).alias("entities"), F.when(some, terms_of(F.col("text"), rules)).otherwise(none).alias("terms"))


def revealing_terms(docs: DataFrame, found: DataFrame, rules: DisclosureRules) -> DataFrame:
    """(entity, term, ratio) of the pairs whose PMI is at least ``generalise_at`` of the entity's IC."""
    held = cut(found.where(F.size("entities") > 0).select("fp", "entities", "terms").dropDuplicates(["fp"]))
    total = float(docs.select(fingerprint().alias("fp")).distinct().count())

    def ratio(n_term: str) -> Column:
        information = F.log2(F.lit(total) / F.col("n_e"))
        pmi = F.log2(F.lit(total) * F.col("n_et") / (F.col("n_e") * F.col(n_term)))
        return F.when(information > 0, pmi / information).otherwise(0.0)

    # n_et is n_e at most, so a term in more texts than this cannot reach the ratio
    most = F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), 1 - rules.generalise_at) * (1 + 1e-9)
    n_e = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= rules.support) & (F.col("n_e") < total))
    n_e = cut(n_e.withColumn("most", most))
    highest = n_e.agg(F.max("most")).first()[0] or 0.0
    # a term is in at least as many texts as in those with entities: who fails with that fails
    near = cut(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).where(F.col("n_near").between(rules.support, highest)))
    text_entities = held.select("fp", F.explode("entities").alias("entity")).join(small_side(n_e), "entity")
    text_terms = held.select("fp", F.explode("terms").alias("term")).join(small_side(near), "term")
    pairs = text_entities.join(text_terms, "fp").where(F.col("n_near") <= F.col("most")).groupBy("entity", "term", "n_e", "n_near").agg(F.count(F.lit(1)).alias("n_et"))
    open_pairs = cut(pairs.where((F.col("n_et") >= rules.support) & (ratio("n_near") >= rules.generalise_at)))
    terms = cut(open_pairs.select("term").distinct())
    words = docs.select(fingerprint().alias("fp"), F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda w: F.lower(w)))).alias("term"))
    n_t = words.join(small_side(terms), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = open_pairs.join(n_t, "term").withColumn("ratio", ratio("n_t"))
    return cut(scored.where(F.col("ratio") >= rules.generalise_at).select("entity", "term", "ratio"))


def marked(text: Column, actions: Column) -> Column:
    """(start, end, action) of every word outside addresses that the map ``actions`` has; linear in the text."""
    piece = lambda gap, length, action: F.struct(gap.cast("long").alias("gap"), length.cast("long").alias("length"), action.cast("string").alias("action"))

    def words(part: Column) -> Column:
        found, gaps = F.regexp_extract_all(part, F.lit(r"\p{L}++"), F.lit(0)), F.split(part, r"\p{L}++", -1)
        return F.zip_with(found, gaps, lambda w, g: piece(F.coalesce(F.char_length(g), F.lit(0)), F.coalesce(F.char_length(w), F.lit(0)), F.try_element_at(actions, F.coalesce(F.lower(w), F.lit("")))))

    address = F.lit(PATTERNS["email"])
    parts = F.zip_with(F.split(text, address, -1), F.regexp_extract_all(text, address, F.lit(0)), lambda p, e: F.concat(words(p), F.array(piece(F.coalesce(F.char_length(e), F.lit(0)), F.lit(0), F.lit(None)))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(TERM_SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["gap"]
        b = a + p["length"]
        more = F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), p["action"].alias("action"))))
        return F.struct(b.alias("at"), F.when(p["action"].isNull(), acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(F.flatten(parts), start, step, lambda acc: acc["out"])


def find_disclosures(docs: DataFrame, rules: DisclosureRules = DisclosureRules()) -> DataFrame:
    """doc_id, fp, the spans of each kind, and ``term`` spans with their action.

    Rows are (doc_id, text); a null text is empty.  A row per input row, repeated rows too.
    Copies count as one text in the statistics.  A revealing term is marked wherever it stands,
    also in texts without the entity.
    """
    found = cut(with_terms(entities(docs), rules))
    action = F.when(F.col("ratio") >= rules.remove_at, "remove").otherwise("generalise")
    revealing = cut(revealing_terms(docs, found, rules).groupBy("term").agg(F.max(action).alias("action")))
    text = docs.select(F.col("doc_id").cast("long").alias("_doc"), fingerprint().alias("_fp"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_own"))
    held = text.select("_doc", "_fp", F.explode(terms_of(F.col("text"), rules)).alias("term")).join(small_side(revealing), "term")
    actions = cut(held.groupBy(F.col("_doc").alias("_id"), F.col("_fp").alias("_own")).agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions")))
    terms = cut(text.join(small_side(actions), same).select("_doc", "_fp", marked(F.col("text"), F.col("actions")).alias("term")).dropDuplicates(["_doc", "_fp"]))
    joined = found.join(small_side(terms), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("fp") == F.col("_fp")), "left")
    return joined.select("doc_id", "fp", *PATTERNS, F.coalesce("term", F.array().cast(TERM_SPANS)).alias("term"))


def disclosure_digest(found: DataFrame) -> DataFrame:
    """The contract's columns, with n_term and the terms' spans."""
    written = lambda kind: F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.array_join(F.concat(*map(written, PATTERNS)), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(*map(written, KINDS)), ",").alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, terms by ``[name]`` or ``[word]``, or by nothing.

    Overlapping spans: the first one by start, then the longer, is replaced.
    """
    found = cut(found.dropDuplicates(["doc_id", "fp"]))
    def mark(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.lit(f"[{kind}]").alias("by")))

    marks = F.concat(
        *map(mark, PATTERNS),
        F.transform("term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), F.when(s["action"] == "remove", "").otherwise("[?]").alias("by"))),
    )
    side = found.select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), F.array_sort(marks).alias("_marks")).where(F.size("_marks") > 0)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), fingerprint(docs["text"]).alias("_own"))
    joined = rows.join(small_side(cut(side)), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_fp")), "left")
    text = F.col("_row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))
        word = F.substring(text, (m["start"] + 1).cast("int"), (-m["minus_end"] - m["start"]).cast("int"))
        by = F.when(m["by"] == "[?]", F.when(F.lower(word) != word, "[name]").otherwise("[word]")).otherwise(m["by"])
        taken = F.struct((-m["minus_end"]).alias("at"), F.concat(acc["out"], F.array(gap, by)).alias("out"))
        return F.when(m["start"] >= acc["at"], taken).otherwise(acc)

    rebuilt = F.aggregate("_marks", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    columns = {"text": F.when(F.col("_marks").isNull(), text).otherwise(rebuilt)}
    return joined.select(*[columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
