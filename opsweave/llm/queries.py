"""Registered queries of the dealt operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opsweave.llm import chat, decontaminate, disclosure, licences, line_quality, mixing, order_minhash, quality_gam, secrets, spelling_variants, term_pipeline, token_counts, token_files
from opsweave.llm.common import WORD, cut, shared_folder, table
from opsweave.session import prepare

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        PLANS[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_order_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


@query("op2_template_leaks")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("fp")


@query("op3_line_frequency", line_quality.oracle())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.judge(table(spark, folder, "documents"))[0].drop("fp")


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, folder, "documents")))


@query("op5_licence_dice", licences.oracle())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_digest(licences.scan_licences(table(spark, folder, "documents")))


@query("op6_disclosure")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.disclosure_digest(disclosure.find_disclosures(table(spark, folder, "documents")))


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary, out = public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), out, vocabulary, end_id=1)
    return token_files.read_token_files(spark, out, vocabulary)


# The contract's conversation of control strings, added to the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


_ESCAPED_LENGTH = r"length(regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g'))"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES {", ".join(str(row) for row in CONTROL_CHAT)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")} + {len(chat.START + chat.TEXT + chat.END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op8_chat_masks", CHAT_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


# The level that caps leave: sources by cap per weight, the first one that its level does not cap.
MIX_SQL = rf"""
WITH best AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
  -ln((CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / CASE label WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * n AS cap, CAST(coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
  CAST(sum(w) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS above FROM s),
l AS (SELECT max((CAST((SELECT sum(n) FROM s) AS BIGINT) - below) / above) FILTER (WHERE (CAST((SELECT sum(n) FROM s) AS BIGINT) - below) / above <= cap / w) AS level FROM c),
t AS (SELECT source, n, least(CAST(cap AS DOUBLE), w * level) AS target FROM c, l),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d WHERE size > 0),
k AS (SELECT o.source, max(key) AS cut FROM o JOIN e ON e.source IS NOT DISTINCT FROM o.source WHERE upto - size / 2 <= target - epochs * n GROUP BY o.source)
SELECT d.doc_id, d.size, e.n AS source_size, e.target,
  CAST(CASE WHEN d.size > 0 THEN d.size * (epochs + CASE WHEN d.key <= k.cut THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source"""


@query("op9_weighted_mix", MIX_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rated = cut(mixing.rate(mixing.sized(table(spark, folder, "documents")), table(spark, folder, "labels")))
    taken = mixing.take(rated, mixing.plan_mix(rated))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


CONTEXT_TOKENS = 4096


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.prefix_token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    n = token_counts.n_tokens()
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > CONTEXT_TOKENS).alias("over_limit"))


@query("op11_term_pipeline", term_pipeline.oracle())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return term_pipeline.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_spelling_variants", spelling_variants.oracle())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, folder, "documents"))


@query("op13_quality_gam")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
