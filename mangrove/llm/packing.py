"""Packing by power-of-two decomposition.

A document's ids, with the end mark, are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of what remains, long ones first. A piece is a sequence of its own, so no sequence crosses
documents and none is padded. Sequences of equal length form a bucket.

sequence_id is length class, then input partition, then number in it: ids of one bucket are contiguous in order and
no count or shuffle is needed. Input that is read from files is split alike in each attempt of a task, so ids are stable.

Defined cases: null or empty text: the end mark alone, one piece of length 1; repeated rows and null ids are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import only, small_batches

END_ID = 0
#: Texts of more characters than this are split by the plain library, whose pattern engine has no depth limit. Both give the same ids.
LONG_TEXT = 400_000


def binary_pieces(length: int, most: int = 1024) -> list[int]:
    """Lengths of the pieces of a document of `length` ids, `most` being a power of two."""
    out = [most] * (length // most)
    rest = length % most
    return out + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def special_tokens(tokenizer_file: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids."""
    with open(tokenizer_file, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}


class Ids:
    """Ids of the vocabulary files, special tokens that a text spells out included, as the tokenizer gives them: the rank file's encoder, which gives the ids of the tokenizer file several times
    faster, and the tokenizer itself, read when it is needed, for very long texts or where there is no rank file."""

    def __init__(self, tokenizer_file: str, rank_file: str | None, pattern: str | None, special: dict[str, int]) -> None:
        self.tokenizer_file = tokenizer_file
        self.fast = None
        if rank_file and pattern:
            import tiktoken

            with open(rank_file, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_file)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()), dtype="<u4")
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pack(docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, pattern: str | None = None, most: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    source = only(small_batches(docs), doc_id="doc_id", text="text")
    special = special_tokens(tokenizer_file)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(tokenizer_file, rank_file, pattern, special)
        part = TaskContext.get().partitionId()
        made: dict[int, int] = {}
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for doc_id, text in zip(doc_ids.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for n in binary_pieces(len(ids), most):
                        level = n.bit_length() - 1
                        number = made.get(level, 0)
                        made[level] = number + 1
                        rows.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), (level << 58) | (part << 34) | number, 0))
                        start += n
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], doc_ids.type), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(columns[1:]))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return source.mapInArrow(run, schema)
