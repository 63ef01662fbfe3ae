"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes two tries of bytes, one of pieces that start a word and one of pieces that continue it.
Each node has a failure link, the node reached after the greedy pieces that its string must begin with have been
popped, and the number of those pieces. One pass over a word's bytes then counts its pieces without building any.
A node without a failure link is a dead end: the word can't be written in pieces and counts as one unknown piece.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .common import only, small_batches

#: Words longer than this, and all beyond the memo's bound, are walked each time.
MEMO_WORD, MEMO_WORDS = 48, 200_000


class LongestMatch:
    """Counts greedy longest-match pieces of a word.

    starts: pieces that may begin a word; continues: pieces that may follow. Both are sets of bytes.
    """

    def __init__(self, starts: Iterable[bytes], continues: Iterable[bytes]) -> None:
        self.goto: list[dict[int, int]] = [{}, {}]
        accepts: list[bool] = [False, False]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                node = root
                for byte in piece:
                    node = self.goto[node].setdefault(byte, len(self.goto))
                    if node == len(self.goto):
                        self.goto.append({})
                        accepts.append(False)
                accepts[node] = node > 1
        self.fail: list[int] = [-1] * len(self.goto)
        self.pops: list[int] = [0] * len(self.goto)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, child in self.goto[node].items():
                if accepts[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.pops[node]
                    while at >= 0 and byte not in self.goto[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.goto[at][byte], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        node = n = 0
        for byte in word:
            while (nxt := goto[node].get(byte, -1)) < 0:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Starting and continuing pieces of a byte-level vocabulary file, whose tokens spell bytes as printable characters and a word's leading space as part of its first token."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as file:
        tokens = [bytes(spelt[c] for c in t) for t in json.load(file)["model"]["vocab"] if all(c in spelt for c in t)]
    starts = [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]]
    rest = [t for t in tokens if b" " not in t]
    alone = {t for t in rest if len(t) == 1}
    return [*starts, *(alone - {s for s in starts if len(s) == 1})], rest


@lru_cache(maxsize=2)
def _automaton(vocabulary: str) -> LongestMatch:
    """Built once a Python worker, not once a task."""
    return LongestMatch(*byte_vocabulary(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, words_crc32 per row of `docs`; n_tokens: greedy pieces of all words.

    A word starts with a starting piece. Null text: no words. Repeated rows are counted each; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(vocabulary)
        memo: dict[bytes, int] = {}

        def pieces(word: bytes) -> int:
            n = memo.get(word)
            if n is None:
                n = automaton.count(word)
                if len(word) <= MEMO_WORD:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = n
            return n

        for batch in batches:
            words = [(t or "").encode().split() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(pieces, w)) for w in words], "words_crc32": [zlib.crc32(b" ".join(w)) for w in words]})

    source = only(small_batches(docs), doc_id=id_col, text=text_col)
    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, words_crc32 long")
