"""Encoding of a corpus with a public byte-level BPE tokenizer.

Merge replay: the distinct words of a task's share of the corpus are laid out
as one array of symbols with links to their neighbours, and an inverted index
maps every pair of adjacent symbols to the positions where it stands.  The
merges are replayed over that index in rank order; applying one touches only
its positions and updates the pairs with their left and right neighbours.  Each
distinct word is thus encoded once per task however often it occurs, and the
documents are put together from their words' ids without a shuffle.

Scale: the operator is one narrow, Arrow-batched pass (no shuffle, nothing
collected).  Words are kept between batches in a table that is emptied when it
exceeds ``WORD_TABLE``; that bounds memory and changes no result.  Texts are
encoded whole, whatever their length.

Defined results: null, empty and missing texts give the empty list; the
spellings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless the caller says otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_TABLE = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of every word: all merges in rank order over all words at once."""
    single = [ranks[bytes([b])] for b in range(256)]
    # Fast path: a word that is a token itself can only end as that token.
    out: list[list[int] | None] = [[ranks[w]] if w in ranks else None for w in words]
    symbols: list[bytes] = []
    follow: list[int] = []
    precede: list[int] = []
    starts: list[int] = []
    open_words: list[int] = []
    for i, word in enumerate(words):
        if out[i] is not None:
            continue
        open_words.append(i)
        start = len(symbols)
        starts.append(start)
        n = len(word)
        symbols.extend(word[j : j + 1] for j in range(n))
        follow.extend(range(start + 1, start + n))
        follow.append(-1)
        precede.append(-1)
        precede.extend(range(start, start + n - 1))

    index: dict[int, list[int]] = {}
    heap: list[int] = []

    def note(left: int) -> None:
        rank = ranks.get(symbols[left] + symbols[follow[left]])
        if rank is not None:
            at = index.get(rank)
            if at is None:
                index[rank] = [left]
                heapq.heappush(heap, rank)
            else:
                at.append(left)

    for left, right in enumerate(follow):
        if right >= 0:
            note(left)
    tokens = {rank: token for token, rank in ranks.items()}
    while heap:
        rank = heapq.heappop(heap)
        merged = tokens[rank]
        size = len(merged)
        # in each word from left to right, as the tokenizer merges
        for left in sorted(index.pop(rank)):
            a = symbols[left]
            right = follow[left]
            # a position may have been used up by an earlier merge
            if right < 0 or not a or len(a) + len(symbols[right]) != size or a + symbols[right] != merged:
                continue
            after = follow[right]
            symbols[left] = merged
            symbols[right] = b""
            follow[left] = after
            follow[right] = -1
            if after >= 0:
                precede[after] = left
                note(left)
            if precede[left] >= 0:
                note(precede[left])
    for i, start in zip(open_words, starts, strict=True):
        ids = []
        at = start
        while at >= 0:
            s = symbols[at]
            ids.append(ranks[s] if len(s) > 1 else single[s[0]])
            at = follow[at]
        out[i] = ids
    return out  # type: ignore[return-value]


def encode_batches(batches: Iterable[pd.Series], ranks: dict[bytes, int], pattern: str) -> Iterator[list[list[int]]]:
    import regex

    split = regex.compile(pattern).findall
    known: dict[str, list[int]] = {}
    for texts in batches:
        pieces = [split(t) if isinstance(t, str) and t else [] for t in texts]
        fresh = list({w for words in pieces for w in words if w not in known})
        for word, ids in zip(fresh, replay([w.encode("utf-8", "replace") for w in fresh], ranks), strict=True):
            known[word] = ids
        yield [[i for w in words for i in known[w]] for words in pieces]
        if len(known) > WORD_TABLE:
            known.clear()


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, ids array<int>) of every document."""
    id_type = documents.schema[id_column].dataType.simpleString()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = read_ranks(vocabulary)
        keys: list[pd.Series] = []

        def texts() -> Iterator[pd.Series]:
            for pdf in frames:
                keys.append(pdf["id"])
                yield pdf["text"]

        for ids in encode_batches(texts(), ranks, pattern):
            yield pd.DataFrame({"id": keys.pop(), "ids": ids})

    return documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(scan, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_column)
