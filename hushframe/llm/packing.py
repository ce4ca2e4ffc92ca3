"""Best-fit packing of tokenized texts into sequences of a fixed capacity.

Hierarchical residual packing: pieces are dealt into groups, each group packs best-fit (longest first, into the fullest
bin that holds it) and gives out its nearly full bins; the underfull bins become the items of the next round, in
which groups are merged by eights, until one group is left. A group never holds more than a bounded number of items.

A text is its token ids and the end id. Only longer texts are cut, into pieces of the capacity; the last may be
shorter. Null texts count as empty (one token). Repeated rows are packed each on their own; extra columns are
ignored; an empty table gives an empty result. Numbers of sequences are unique, not dense.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import freeing, materialize, text_rows
from .rolling import lanes, mix

#: Items in a first group, and groups merged into one in each round.
GROUP, MERGED = 1024, 8
#: Units that a merged group holds at most.
MOST_UNITS = 4096

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whole texts: plain Latin text is split and looked up word by word, a batch at a time; only unseen words,
    and texts with anything else in them, go to the tokenizer itself. Words are found by hash and then compared."""

    #: Words remembered; workers keep them from task to task.
    MOST = 300_000
    FIRST_OTHER = 0x250
    #: Characters of a word that may be looked up.
    LONGEST = 32
    #: Characters of a batch.
    BATCH = 1 << 19

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        # by code point: 0 white space, 1 letter, 2 digit (a word of its own), 3 the rest
        category = [unicodedata.category(chr(c))[0] for c in range(self.FIRST_OTHER)]
        self.kind = np.array([{"L": 1, "N": 2}.get(k, 3) for k in category], np.int8)
        self.kind[[*range(9, 14), 0x20, 0x85, 0xA0]] = 0
        self.special = re.compile(f"[İ{chr(self.FIRST_OTHER)}-\U0010ffff]").search
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.words: list[str] = []
        self.first = np.zeros(1, np.int64)  # where each known word's ids begin
        self.ids = np.zeros(0, np.uint32)

    def _plain(self, text: str) -> bool:
        """Words are runs of one kind: no contractions, no special tokens, one code point for each lower-case letter."""
        return "<|" not in text and "'" not in text and (text.isascii() or not self.special(text))

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        parts = [self.ids]
        lengths = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            lengths.append(np.diff(cut, prepend=0))
            parts.append(ids)
        n = len(self.words)
        self.known.update(zip(hashes, range(n, n + len(hashes)), strict=True))
        self.words += words
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))))
        self.ids = np.concatenate(parts)

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _batch(self, texts: list[str]) -> list[bytes]:
        low = "\n".join(texts).lower()
        code = np.frombuffer(low.encode("utf-16-le"), np.uint16)
        kind = self.kind[code]
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        begin = np.concatenate(([0], change)).astype(np.int64)
        end = np.concatenate((change, [len(code)])).astype(np.int64)
        word = kind[begin] > 0
        begin, end = begin[word], end[word]
        size = end - begin
        parts = list(lanes(code.view(np.uint8), 2 * begin, 2 * np.minimum(size, self.LONGEST), 2 * self.LONGEST))
        hashes = size.astype(np.uint64)
        for at, value in parts:
            hashes[at] = mix(hashes[at] ^ value)
        values, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        # a hash only proposes: words must equal the first of their hash here, and that one the known word
        bad = (size > self.LONGEST) | (size != size[at][which])
        for held, value in parts:
            whole = np.zeros(len(size), np.uint64)
            whole[held] = value
            bad |= whole != whole[at][which]
        if len(self.known) + len(values) > self.MOST:
            self._forget()
        listed = values.tolist()
        words = [low[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        missing = [i for i, h in enumerate(listed) if h not in self.known]
        if missing:
            self._learn([listed[i] for i in missing], [words[i] for i in missing])
        number = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))
        wrong = [i for i, (w, n) in enumerate(zip(words, number.tolist(), strict=True)) if w != self.words[n]]
        if wrong:
            bad |= np.isin(which, wrong)
        number = number[which]
        first, size = self.first[number], self.first[number + 1] - self.first[number]
        after = np.cumsum(size)
        raw = self.ids[np.repeat(first - after + size, size) + np.arange(after[-1] if len(after) else 0)].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        cut = (4 * np.concatenate(([0], after))[np.searchsorted(begin, ends)]).tolist()
        out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.unique(np.searchsorted(ends, begin[bad], "right") - 1).tolist():
            out[i] = self._direct(texts[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not self._plain(t):
                out[i] = self._direct(t)
                continue
            if held and size + len(t) + 1 > self.BATCH:
                for j, raw in zip(held, self._batch([texts[j] for j in held]), strict=True):
                    out[j] = raw
                held, size = [], 0
            held.append(i)
            size += len(t) + 1
        if size > len(held):
            for j, raw in zip(held, self._batch([texts[j] for j in held]), strict=True):
                out[j] = raw
        return out


@functools.lru_cache(1)
def _word_ids(spec: str) -> WordIds:
    return WordIds(spec)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids in pieces of the capacity."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder = _word_ids(spec.value)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(5)]
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist()), strict=True):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[a : a + 4 * capacity]
                        for c, v in zip(out, (doc_id, k, a // 4, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _PIECE.split(", ")])

    return text_rows(docs).select("doc_id", "text").mapInArrow(freeing(run), _PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: longest first, each into the bin with the least room that holds it."""
    bins = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, made
            made += 1
        bins[i] = b
        if left > size:
            bisect.insort(room, (left - size, b))
    return bins


def pack(pieces: DataFrame, capacity: int = 4096, slack: int = 16) -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0 in each sequence). A bin with at most `slack` tokens of room is nearly full."""
    pieces = materialize(pieces, "pieces")
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # spreads rows that repeat; pieces are a table, so a retry numbers them alike
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    n = rest.count()
    groups = max(1, -(-n // GROUP))
    done = []
    # unit: the bin of the round before (each piece is one at first); offset: the piece's place in it
    live = rest.withColumn("grp", F.pmod(key, F.lit(groups))).withColumn("unit", F.lit(-1).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    step = 0
    schema = f"{_PIECE}, grp long, unit long, offset long, fill long"

    def packer(step: int):
        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["unit", "doc_id", "piece", "offset"], kind="stable").reset_index(drop=True)
            unit = np.arange(len(rows)) if step == 0 else np.unique(rows["unit"], return_inverse=True)[1]
            sizes = np.bincount(unit, rows["length"]).astype(np.int64)
            bins = best_fit(sizes, capacity)
            order = np.argsort(bins, kind="stable")
            before = np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
            start = np.empty(len(sizes), np.int64)
            first = np.searchsorted(bins[order], bins[order])
            start[order] = before - before[first]
            fill = np.bincount(bins, sizes).astype(np.int64)
            rows["offset"] += start[unit]
            rows["fill"] = fill[bins[unit]]
            rows["unit"] = (step << 56) + rows["grp"] * (1 << 20) + bins[unit]
            return rows

        return packed

    while n:
        last = groups == 1
        out = materialize(live.groupBy("grp").applyInPandas(packer(step), schema), f"pack-{step}")
        if last:
            done.append(out)
            break
        closed = F.col("fill") >= capacity - slack
        done.append(out.filter(closed))
        left = out.filter(~closed)
        units = left.filter("offset = 0").count()
        fewer = max(1, -(-groups // MERGED), -(-units // MOST_UNITS))
        if not units:
            break
        if fewer >= groups:  # nothing left that merging could fill
            done.append(left)
            break
        live = left.drop("fill").withColumn("grp", F.expr(f"grp * {fewer} div {groups}"))
        groups, step = fewer, step + 1
    whole = full.withColumn("sequence_id", -1 - F.abs(F.expr("monotonically_increasing_id()"))).withColumn("offset", F.lit(0).cast("long"))
    for x in done:
        whole = whole.unionByName(x.withColumnRenamed("unit", "sequence_id").drop("grp", "fill"))
    return whole
