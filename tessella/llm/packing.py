"""Packing by concatenate and cut: token counts, a prefix sum over partition totals, fixed windows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import ship, small_batches, stored, table, text_or_empty

CACHE_WORDS = 300_000  # words whose ids a task keeps; beyond, it starts anew
TOKENS_SCHEMA = "part int, first long, doc_id long, n_tokens long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: A word of lower-case letters alone, of which the tokenizer makes one piece of text, then at most a run of ASCII signs.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


#: Byte-level coding writes each byte as a letter: printable ones of Latin-1 as themselves, the others as those from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def word_ids(tokenizer_path: str):
    """A function of a UTF-8 text that gives its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space, lowers letters and looks at each run of letters or of signs alone. So the ids of
    a word, or of its letters and the signs after them, are found once and kept. A run of plain letters goes straight
    to the tokenizer's model, written as its letters for bytes; anything else goes through all of the tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    model = tokenizer.model.tokenize
    kept: dict[bytes, bytes] = {}

    def encoded(words: list[bytes]) -> Iterator[bytes]:
        for w in words:
            yield np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def runs(words: list[bytes]) -> Iterator[bytes]:
        for w in words:
            yield b"".join([t.id.to_bytes(4, "little") for t in model(w.decode("latin-1").translate(BYTE_LETTERS))])

    def learn(new: list[bytes]) -> None:
        split = {w: m.groups() for w in new if (m := PLAIN.fullmatch(w))}
        letters = list({x for x, _ in split.values()}.difference(kept))
        kept.update(zip(letters, runs(letters), strict=True))
        others = list({w for w in new if w not in split}.union(x for _, x in split.values() if x).difference(kept))
        kept.update(zip(others, encoded(others), strict=True))
        for w, (x, y) in split.items():
            if y:
                kept[w] = kept[x] + kept[y]

    def ids(text: bytes) -> bytes:
        # of bytes: lowers A-Z, splits at the ASCII white space. Names of special tokens begin with "<|" and count in lower case only.
        words = (text if b"<|" in text else text.lower()).split()
        new = set(words).difference(kept)
        if len(kept) + len(new) > CACHE_WORDS:
            kept.clear()
            new = set(words)
        if new:
            learn(list(new))
        return b"".join([kept[w] for w in words])

    return ids


def _batches(schema: pa.Schema, rows: Iterator[tuple], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that end with their size in bytes."""
    held: list[tuple] = []
    size = 0
    for *row, n in rows:
        held.append(row)
        size += n + 64
        if size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pass one: every document's ids with its place in its partition, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, end = word_ids(tokenizer_path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()

        def rows():
            first = 0
            for b in batches:
                for at in range(0, b.num_rows, 128):
                    some = b.slice(at, 128)
                    for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                        got = ids(text) + end
                        yield part, first, doc_id, len(got) // 4, got, len(got)
                        first += len(got) // 4

        yield from _batches(pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]), rows())

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, TOKENS_SCHEMA), "pack-tokens")


def pack(docs: DataFrame, *, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Concatenate all documents and cut the stream every `length` tokens.

    docs: doc_id, text; other columns are ignored. Returns one row per piece: doc_id, start, length, ids (unsigned
    32-bit little-endian), doc_tokens, sequence_id, offset. Pass one tokenizes and keeps each document's place in its
    partition; the sums per partition, one number for each task of pass one, give the partitions' places in the whole;
    pass two cuts where windows end. A document that crosses a window's end gives a piece in each window. Only the
    last sequence is not full, so there is no other padding. Nothing is shuffled but those sums.

    Null text is empty: the end id alone. Rows that repeat a doc_id are documents of their own. Long texts give many
    pieces. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    tokens = tokenised(docs, tokenizer_path, end_id)
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist()))
    starts_all = docs.sparkSession.sparkContext.broadcast(starts)  # a number for each task of pass one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = starts_all.value

        def rows():
            for b in batches:
                for row in range(0, b.num_rows, 128):
                    for part, first, doc_id, n, ids in zip(*[c.slice(row, 128).to_pylist() for c in b.columns], strict=True):
                        at, start = begins[part] + first, 0
                        while start < n:
                            offset = (at + start) % length
                            size = min(length - offset, n - start)
                            yield doc_id, start, size, ids[4 * start : 4 * (start + size)], n, (at + start) // length, offset, 4 * size
                            start += size

        yield from _batches(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]), rows())

    return tokens.mapInArrow(run, PIECES_SCHEMA)


def packed_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """pack() with 4,096 tokens and the public word tokenizer; the ids' CRC-32 instead of the ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out = pack(docs, tokenizer_path=tokenizer_path)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


ship(__name__)
