"""Token counts without token ids: byte-pair merging over a heap and a linked list.

A text's symbols stand in a linked list; every adjacent pair whose joined form is in the vocabulary waits in a heap by rank
and place. The lowest pair is popped and merged until none is left. The count is the initial symbols minus the merges; what the
vocabulary lacks falls back to bytes and counts as that many symbols. No id is ever looked up or given out.

Merging never crosses a place where a word mark follows anything else, if no entry of the vocabulary does; texts are then
cut there, and the counts of short words are remembered, up to a bound. Nothing is shuffled: a row's count needs its text only.

Null texts count as empty; empty texts have no tokens. Repeated rows each get their count. Extra columns are ignored. An
empty table gives an empty result. Very long texts are merged in time n log n.
"""

from __future__ import annotations

import functools
import heapq
import os
import re

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import slices

#: What a space turns into.
MARK = "▁"
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Counter:
    """Counts for one vocabulary of pieces with scores: a pair's rank is its joined form's, equal scores share one."""

    #: Words remembered in each of two generations, and characters of a word that may be.
    MOST, LONGEST = 400_000, 48

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(self.processor.vocab_size()) if not (self.processor.is_byte(i) or self.processor.is_control(i) or self.processor.is_unknown(i))]
        if any(map(self.processor.is_unused, ids)):
            raise ValueError("vocabularies with unused pieces are taken apart again after merging; they are not supported")
        score = {self.processor.id_to_piece(i): self.processor.get_score(i) for i in ids}
        place = {s: rank for rank, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {piece: place[s] for piece, s in score.items()}
        self.bytes_kept = any(map(self.processor.is_byte, range(self.processor.vocab_size())))
        # words may be cut where a mark follows another character, unless a piece holds that
        inside = any(MARK in piece.lstrip(MARK) for piece in self.rank)
        self.words = (lambda text: [text]) if inside else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.characters = {piece for piece in self.rank if len(piece) == 1}
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _unknown(self, symbol: str) -> int:
        return len(symbol.encode()) if self.bytes_kept else 1

    def merged(self, word: str) -> int:
        """The count for one word."""
        rank = self.rank
        n = len(word)
        count = n
        if not self.characters.issuperset(word):
            count += sum(self._unknown(c) - 1 for c in word if c not in rank)
        symbols = list(word)
        pairs = [rank.get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]  # of the symbol and the one after it, as they are now
        heap = [r << 40 | i for i, r in enumerate(pairs) if r >= 0]
        if not heap:
            return count
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, place = heapq.heappop, heapq.heappush, (1 << 40) - 1
        while heap:
            top = pop(heap)
            i = top & place
            if pairs[i] != top >> 40:
                continue  # one of the two has been merged since
            j = after[i]
            whole = symbols[i] = symbols[i] + symbols[j]
            count -= 1
            pairs[j] = -1
            k = after[i] = after[j]
            r = -1
            if k < n:
                before[k] = i
                r = rank.get(whole + symbols[k], -1)
                if r >= 0:
                    push(heap, r << 40 | i)
            pairs[i] = r
            h = before[i]
            if h >= 0:
                r = pairs[h] = rank.get(symbols[h] + whole, -1)
                if r >= 0:
                    push(heap, r << 40 | h)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        words, known = self.words(self.processor.normalize(text)), self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.older.get(w) or self.merged(w)
                if len(w) <= self.LONGEST:
                    known[w] = n
            total += n
        if len(known) > self.MOST:  # what was met lately is moved along when it is met again
            self.older, self.known = known, {}
        return total


@functools.lru_cache(1)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def counted(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row: UTF-8 bytes, and tokens without begin, end or added special tokens.

    The model is read by the driver and broadcast; it is a file of a few megabytes at most, which is checked.
    """
    if os.path.getsize(model_path) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not sent to every executor")
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = _counter(model.value)
        for part in slices(batches):
            n = [counter.count(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, _COUNTS)


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """counts with whether a text has more tokens than the limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
