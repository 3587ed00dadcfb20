"""Token files: flat unsigned integers and 64-bit document offsets.

Documents are range-partitioned and sorted by id.  Each partition writes three flat
little-endian files: ``.bin`` with the token ids, ``.idx`` with n + 1 signed 64-bit
offsets in tokens, and ``.doc`` with n signed 64-bit document ids.  A manifest has a row
per partition; prefix sums over it give each partition's base, so token number
base + offset is global without any file being rewritten.

A task writes under an attempt's own name and moves the file into place, so a task that
runs again after a lost executor leaves whole files only.  Readers map the files into
memory where the folder is a local path, and read them as streams elsewhere.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opsweave.llm.common import small_batches
from opsweave.session import shuffle_partitions

MANIFEST = "part int, first_null long, n_docs long, n_tokens long"
# Bounds of each of the two ages of what a worker keeps: some 200 bytes a word or stem with its ids.
CACHE_WORDS = 50_000
CACHE_STEMS = 50_000
TEXTS = 250  # encoded at a time


class Recent:
    """Ids of words in two ages: when the younger is full, it takes the place of the older.

    A word that is met again moves to the younger one, so frequent words stay.
    """

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self, most: int) -> None:
        if len(self.young) > most:
            self.young, self.old = {}, self.young

    def get(self, word: str) -> bytes | None:
        coded = self.young.get(word)
        if coded is None:
            coded = self.old.get(word)
            if coded is not None:
                self.young[word] = coded
        return coded


_WORDS: dict[bytes, tuple[Recent, Recent]] = {}
# Most words are Latin letters with marks behind; the marks are tokens of their own.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?|#$%&*()]*)")


@dataclass(frozen=True)
class WordEncoder:
    """Encodes texts with a tokenizers file.

    If its pre-tokenizer drops white space, the ids of a text are those of its words in
    order, and each distinct word is encoded once while it is cached; a word of Latin letters
    with marks behind is put together from the two.  Other vocabularies get whole texts.
    """

    vocabulary: bytes
    key: bytes
    width: int

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            data = f.read()
        size = Tokenizer.from_str(data.decode("utf-8")).get_vocab_size(with_added_tokens=True)
        return cls(data, zlib.crc32(data).to_bytes(4, "little"), 2 if size <= 1 << 16 else 4)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.width == 2 else "<u4")

    @staticmethod
    def letters(tokenizer) -> dict[int, str] | None:
        """How the model writes Latin letters, if words of them go to it in lower case and alone."""
        from tokenizers import pre_tokenizers

        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in LETTERS}
        for word in [LETTERS, *(f"{a}{b}" for a in "aeio\xe9\xfc" for b in LETTERS), "The", "\xc9t\xe9"]:
            apart = [t.id for t in tokenizer.model.tokenize(word.lower().translate(table))] + tokenizer.encode(",.", add_special_tokens=False).ids
            if tokenizer.encode(f"{word},.", add_special_tokens=False).ids != apart:
                return None
        return table

    def encoder(self):
        """A function from texts to the bytes of their ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        tokenizer, dtype = Tokenizer.from_str(self.vocabulary.decode("utf-8")), self.dtype
        kept, stems = _WORDS.setdefault(self.key, (Recent(), Recent()))
        letters = self.letters(tokenizer)
        joins = bool(len(tokenizer.encode("a b", add_special_tokens=False).ids) - 2)  # white space yields ids of its own

        def whole(texts: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def words(texts: list[str]) -> list[bytes]:
            parts = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
            kept.turn(CACHE_WORDS)
            stems.turn(CACHE_STEMS)
            cache = kept.young
            cache[""] = b""
            odd: list[str] = []
            for word in {w for p in parts for w in p if w not in cache}:
                if kept.get(word) is not None:
                    continue
                simple = SIMPLE.fullmatch(word) if letters is not None else None
                if simple is None:
                    odd.append(word)
                    continue
                stem, marks = simple[1].lower(), simple[2]
                coded = stems.get(stem)
                if coded is None:
                    coded = stems.young[stem] = np.asarray([t.id for t in tokenizer.model.tokenize(stem.translate(letters))], dtype).tobytes()
                if marks:
                    ids = stems.get(marks)
                    if ids is None:
                        ids = stems.young[marks] = whole([marks])[0]
                    coded += ids
                cache[word] = coded
            for start in range(0, len(odd), 50_000):
                cache.update(zip(odd[start : start + 50_000], whole(odd[start : start + 50_000])))
            return [b"".join([cache[w] for w in p]) for p in parts]

        return whole if joins else words


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(filesystem, path: str, attempt: int, chunks: list[bytes]) -> None:
    partial = f"{path}.{attempt}.partial"
    with filesystem.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
    filesystem.move(partial, path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Encode (doc_id, text) and write the files and ``manifest`` into ``folder``.

    ``folder`` is one that all executors share.  Documents come in ascending id, null ids
    first; ties are ordered by their text.  A null text is an empty one; every document
    ends with ``end_id``.  Repeated rows are written as often as they come.  Without
    rows there is an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    code = WordEncoder.load(tokenizer)
    n = partitions or shuffle_partitions(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("fp"))
    ordered = source.repartitionByRange(n, "doc_id", "fp").sortWithinPartitions("doc_id", "fp", "text").select("doc_id", "text")
    shipped = spark.sparkContext.broadcast(code)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, context = shipped.value, TaskContext.get()
        encode, dtype = code.encoder(), code.dtype
        end = np.asarray([end_id], dtype).tobytes()
        part, attempt = context.partitionId(), context.taskAttemptId()
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        path = f"{base}/part-{part:06d}"
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        nulls = 0
        partial = f"{path}.bin.{attempt}.partial"
        with filesystem.open_output_stream(partial) as out:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for start in range(0, len(texts), TEXTS):
                    coded = encode(texts[start : start + TEXTS])
                    out.write(b"".join([c + end for c in coded]))
                    lengths.append(np.fromiter((len(c) // code.width + 1 for c in coded), "<i8", len(coded)))
                nulls += batch.column("doc_id").null_count
                ids.append(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8"))
        if not lengths:
            filesystem.delete_file(partial)
            return
        filesystem.move(partial, f"{path}.bin")
        offsets = np.concatenate([np.zeros(1, "<i8"), np.cumsum(np.concatenate(lengths))]).astype("<i8")
        _write(filesystem, f"{path}.idx", attempt, [offsets.tobytes()])
        _write(filesystem, f"{path}.doc", attempt, [x.tobytes() for x in ids])
        row = pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in (nulls, len(offsets) - 1, int(offsets[-1])))
        yield pa.RecordBatch.from_arrays(list(row), names=["part", "first_null", "n_docs", "n_tokens"])

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


def partition_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base``: the tokens of all partitions before.  A row per file, nothing larger."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    width = WordEncoder.load(tokenizer).width
    manifest = partition_bases(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _filesystem(folder)
        local = filesystem.type_name == "local"

        def flat(path: str, dtype: str) -> np.ndarray:
            if local:
                return np.memmap(path, dtype, "r")
            with filesystem.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype)

        for pdf in batches:
            for row in pdf.itertuples():
                path = f"{base}/part-{row.part:06d}"
                ids, offsets, tokens = flat(f"{path}.doc", "<i8"), flat(f"{path}.idx", "<i8"), flat(f"{path}.bin", f"<u{width}")
                for start in range(0, len(ids), 5000):
                    stop = min(start + 5000, len(ids))
                    crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(start, stop)]
                    doc = pd.array(ids[start:stop], "Int64")
                    doc[: max(0, min(stop, row.first_null) - start)] = pd.NA
                    yield pd.DataFrame({"doc_id": doc, "start": offsets[start:stop] + row.base, "n_tokens": np.diff(offsets[start : stop + 1]), "ids_crc32": np.asarray(crc, "i8")})

    spread = manifest.repartitionByRange(shuffle_partitions(spark), "part")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
