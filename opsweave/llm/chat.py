"""Chat formatting with offset-aligned loss masks.

Template: ``<|start|>role<|text|>text<|end|>`` for every turn, nothing between turns.
Inside roles and texts every ``<``, backslashes, ``|`` gets one backslash more, so no
control string, of this template or of the vocabulary, can occur there, and taking one
backslash away restores what was written.

A conversation is rendered whole and encoded once.  The control strings are tokens of
their own, so no other token reaches across a turn's border; the assistant spans, sorted,
are met with the sorted token spans by binary search.  Turns come sorted through each
task and are rendered as they pass: memory holds one part, and a conversation of more than
``part_chars`` continues in a further part, cut between turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsweave.session import shuffle_partitions

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
PART_CHARS = 2_000_000
FORMATTED = "conv_id long, part int, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_RAW, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def chat_tokenizer(vocabulary: str):
    """The tokenizers vocabulary with the template's control strings as special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, TEXT, END)])
    return tokenizer


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token meets one of the sorted spans; token spans are sorted too."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.asarray(spans).T
        first, stop = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        for i, j in zip(first, stop):
            mask[i:j] = True
    return mask


def _encode(tokenizer, turns: list[str], spans: list[tuple[int, int]]) -> dict:
    formatted = "".join(turns)
    coded = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.asarray(coded.offsets, "i4").reshape(-1, 2)
    return {"formatted": formatted, "input_ids": coded.ids, "starts": offsets[:, 0], "ends": offsets[:, 1], "loss_mask": mask_tokens(offsets[:, 0], offsets[:, 1], spans)}


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def format_chats(turns: DataFrame, vocabulary: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Rendered and encoded conversations of rows (conv_id, turn, role, text).

    A row per conversation, or per part of one longer than ``part_chars``.  Turns are ordered by
    turn, null first; ties by role and text.  Null roles and texts are empty; null ids
    form a conversation of their own; repeated rows are turns.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shipped = turns.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("input_ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = source.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(shipped.value)
        done: list[dict] = []
        waiting = 0
        open_id: int | None = None
        begun, part, pieces, spans, at = False, 0, [], [], 0

        def close() -> None:
            nonlocal pieces, spans, at, waiting
            done.append({"conv_id": open_id, "part": part} | _encode(tokenizer, pieces, spans))
            waiting += at
            pieces, spans, at = [], [], 0

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != open_id:
                    if begun:
                        close()
                    begun, open_id, part = True, conv, 0
                elif at >= part_chars:
                    close()
                    part += 1
                if waiting > part_chars:
                    yield _table(done, schema)
                    done, waiting = [], 0
                head, body = f"{START}{escape(role)}{TEXT}", escape(text)
                if role == LOSS_ROLE and body:
                    spans.append((at + len(head), at + len(head) + len(body)))
                pieces.append(f"{head}{body}{END}")
                at += len(head) + len(body) + len(END)
        if begun:
            close()
        if done:
            yield _table(done, schema)

    return ordered.mapInArrow(render, FORMATTED)


def loss_runs(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> Iterator[str]:
    """The stretches of text that masked tokens cover, each restored."""
    a = b = None
    for s, e, m in zip(starts, ends, mask):
        if not m:
            continue
        if b is not None and s <= b:
            b = max(b, e)
        else:
            if b is not None:
                yield unescape(formatted[a:b])
            a, b = s, e
    if b is not None:
        yield unescape(formatted[a:b])


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, as the formatted rows hold them."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        state: dict | None = None

        def close() -> None:
            out.append(state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

        for batch in batches:
            for i in range(batch.num_rows):
                conv, formatted, starts, ends, mask = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "starts", "ends", "loss_mask"))
                if state is None or state["conv_id"] != conv:
                    if state is not None:
                        close()
                    state = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                for m in _TURN.finditer(formatted):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for run in loss_runs(formatted, starts, ends, mask):
                    state["loss_chars"] += len(run)
                    state["loss_sha256"].update(run.encode())
                state["formatted_chars"] += len(formatted)
            if len(out) >= 1000:
                yield _table(out, schema)
                out = []
        if state is not None:
            close()
        if out:
            yield _table(out, schema)

    ordered = chats.select("conv_id", "part", "formatted", "starts", "ends", "loss_mask").repartition(shuffle_partitions(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(read, READ_BACK)
