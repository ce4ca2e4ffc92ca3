"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Interval coalescing: the tokens A and B of a text are intervals of its bytes; lexsorted by start, with maximum.accumulate over
their ends, a group breaks where a start reaches the running maximum, which is where tokens of both end. Within a group every
A token is linked with every B token; a pair's count is the number of texts of the corpus that hold it linked.

Texts are encoded word by word, each known word once (neither vocabulary merges across a space that follows anything but white
space), and coalesced many at a time. Counts of pairs come back to the texts without a row for each text and pair: texts are held
in blocks with a dictionary of the pairs that occur in them, so a pair that all texts hold is one row a block. A block's
dictionary is joined with the corpus-wide counts and meets the block's texts again, which carry small numbers into it.

Texts that are null, empty or that a vocabulary doesn't give back byte by byte have no tokens: zeros and ''. Repeated rows count
as texts of their own. Very long texts are coalesced in parts that end with a group. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import materialize, slices

#: Words coalesced at a time; entries of texts and pairs in a block; links of a group above which equal ids are put together first.
WORDS, ENTRIES, LINKS = 200_000, 3_000_000, 64

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROWS = f"block long, {_DOC}, places binary, weights binary, place int, a int, b int, docs long"
_GROUPS = "doc_id long, start long, end long, a array<int>, b array<int>"


def _byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Words:
    """Ids of both vocabularies for words, each with the space before it."""

    MOST = 500_000
    #: A space beside other white space: there words don't end at every space.
    runs = re.compile(r"\s | \s").search
    cut = re.compile(r"(?<=\S)(?= )").split

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True  # their strings are text
        self.b = SentencePieceProcessor(model_proto=model)
        mark, letters = "▁", _byte_level()
        listed = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(mark in p.lstrip(mark) for p in listed):
            raise ValueError("words can't be cut at spaces for this vocabulary")
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(mark, " ").encode() for i, p in enumerate(listed)]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        self.space = self.b.piece_to_id(mark)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first = [np.zeros(1, np.int64)] * 2
        self.ids = [np.zeros(0, np.int32)] * 2
        self.bad = np.zeros(0, bool)

    def split(self, text: str) -> list[str]:
        """Words of ' ' + text, without the space that each begins with."""
        text = " " + text
        return [w[1:] for w in self.cut(text)] if self.runs(text) else text.split(" ")[1:]

    def _learn(self, words: list[str]) -> None:
        a = [x.ids for x in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        bad = np.zeros(len(words), bool)
        for i, w in enumerate(words):
            if not w:
                b[i] = [self.space]
            whole = b" " + w.encode()
            if b"".join(map(self.bytes_a.__getitem__, a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i], b[i], bad[i] = [], [], True
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.bad = np.concatenate((self.bad, bad))
        for k, lists in enumerate((a, b)):
            self.first[k] = np.concatenate((self.first[k], self.first[k][-1] + np.cumsum([len(x) for x in lists])))
            self.ids[k] = np.concatenate((self.ids[k], np.fromiter((i for x in lists for i in x), np.int32)))

    def full(self) -> bool:
        return len(self.known) > self.MOST

    def trim(self) -> None:
        """Forgets all words if they are too many; numbers given out so far are void then."""
        if self.full():
            self._forget()

    def learn(self, lists: list[list[str]]) -> None:
        """Take in what isn't known of many texts' words at once: tokenizers and the tables' growth cost little for each then."""
        missing = dict.fromkeys(w for words in lists for w in words if w not in self.known)
        if missing:
            self._learn(list(missing))

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def tokens(self, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of vocabulary k for the numbered words, and where each word's begin."""
        size = self.first[k][number + 1] - self.first[k][number]
        after = np.concatenate(([0], np.cumsum(size)))
        return self.ids[k][np.repeat(self.first[k][number] - after[:-1], size) + np.arange(after[-1])].astype(np.int64), after


@functools.lru_cache(1)
def _words(spec: str, model: bytes) -> Words:
    return Words(spec, model)


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group, from 0, of each A and each B interval; both lists ascend."""
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    is_b = np.arange(len(start)) >= len(start_a)
    order = np.lexsort((is_b, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate(([0], start[order][1:] >= reach[:-1])) if len(order) else np.zeros(0, np.int64)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(start_a)], group[len(start_a) :]


class Aligned:
    """Parts of texts, coalesced together. bounds: where each part's words begin."""

    def __init__(self, words: Words, number: np.ndarray, bounds: np.ndarray):
        self.n_a, self.n_b = len(words.bytes_a), len(words.bytes_b)
        (self.a, at_a), (self.b, at_b) = words.tokens(number, 0), words.tokens(number, 1)
        self.at_a, self.at_b = at_a[bounds], at_b[bounds]
        ends = [np.cumsum(length[ids]) for length, ids in zip(words.lengths, (self.a, self.b), strict=True)]
        self.start = ends[0] - words.lengths[0][self.a]
        self.end = ends[0]
        self.group_a, self.group_b = coalesce(self.start, ends[0], ends[1] - words.lengths[1][self.b], ends[1])
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.p, self.q = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum(x))) for x in (self.p, self.q))
        # parts end with groups
        self.at_group = np.searchsorted(self.first_a, self.at_a)
        self.links = np.concatenate(([0], np.cumsum(self.p * self.q)))[self.at_group]

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part its distinct id pairs, a * (ids of B) + b, and how many links each has."""
        span = self.n_a * self.n_b
        few = self.p * self.q <= LINKS
        size = np.where(few[self.group_a], self.q[self.group_a], 0)
        which = np.repeat(np.arange(len(self.a)), size)
        other = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.first_b[self.group_a[which]]
        part = np.searchsorted(self.at_a, np.arange(len(self.a)), "right") - 1
        key, weight = np.unique(part[which] * span + self.a[which] * self.n_b + self.b[other], return_counts=True)
        more = []
        for g in np.flatnonzero(~few).tolist():
            a, many_a = np.unique(self.a[self.first_a[g] : self.first_a[g + 1]], return_counts=True)
            b, many_b = np.unique(self.b[self.first_b[g] : self.first_b[g + 1]], return_counts=True)
            more.append(((part[self.first_a[g]] * span + a[:, None] * self.n_b + b).ravel(), (many_a[:, None] * many_b).ravel()))
        if more:
            key, inverse = np.unique(np.concatenate((key, *(k for k, _ in more))), return_inverse=True)
            weight = np.bincount(inverse, np.concatenate((weight, *(w for _, w in more)))).astype(np.int64)
        cut = np.searchsorted(key, np.arange(len(self.at_a)) * span).tolist()
        return [(key[x:y] - i * span, weight[x:y]) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def listed(self, table: np.ndarray) -> list[bytes]:
        """For each part its groups as text, each with a semicolon before it."""
        group = np.concatenate((self.group_a, self.group_b))
        order = np.argsort(group, kind="stable")  # A before B
        ids = np.concatenate((self.a, self.b))[order]
        mark = np.zeros(len(ids), np.int64)
        first = self.first_a[:-1] + self.first_b[:-1]
        mark[first] = 1
        mark[first + self.p] = 2
        text = table[mark, ids]
        at = (self.at_a + self.at_b).tolist()
        return [text[x:y].tobytes().replace(b"\0", b"") for x, y in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(1)
def _decimals(n: int) -> np.ndarray:
    """Ids in decimal after a comma, a semicolon and a bar."""
    return np.array([[f"{mark}{i}".encode() for i in range(n)] for mark in ",;|"])


def _pack(x: np.ndarray) -> bytes:
    """Small numbers as bytes; 255 stands for the next of the large ones, which follow."""
    large = x >= 255
    return len(x).to_bytes(4, "little") + np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=4 + n)
    return out


def _parts(words: Words, batches):
    """Some rows at a time: (aligned, [(row, doc_id, whether it is the row's last part)], doc_ids of rows without tokens).
    A row's parts come in order."""
    held: list[np.ndarray] = []
    parts, bare = [], []
    row = size = 0

    def aligned():
        number = np.concatenate(held) if held else np.zeros(0, np.int64)
        return Aligned(words, number, np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64))

    for batch in slices(batches):
        if held and words.full():
            yield aligned(), parts, bare
            held, parts, bare, size = [], [], [], 0
        words.trim()  # no numbers of words are held then
        lists = [words.split(t) if t else [] for t in batch.column("text").to_pylist()]
        words.learn(lists)
        for doc_id, listed in zip(batch.column("doc_id").to_pylist(), lists, strict=True):
            if size >= WORDS:
                yield aligned(), parts, bare
                held, parts, bare, size = [], [], [], 0
            row += 1
            number = words.numbers(listed)
            if not listed or words.bad[number].any():
                bare.append(doc_id)
                continue
            for k in range(0, len(number), WORDS):
                if size >= WORDS:
                    yield aligned(), parts, bare
                    held, parts, bare, size = [], [], [], 0
                held.append(number[k : k + WORDS])
                size += len(held[-1])
                parts.append((row, doc_id, k + WORDS >= len(number)))
    yield aligned(), parts, bare


def _inputs(docs: DataFrame, path_a: str, path_b: str):
    """Texts and both vocabularies, which the driver reads and sends out: files of at most 64 MB."""
    if max(map(os.path.getsize, (path_a, path_b))) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not sent to every executor")
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), held


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each group: doc_id, its bytes [start, end) in ' ' + text, and the ids of both vocabularies that cover them."""
    texts, held = _inputs(docs, path_a, path_b)

    def run(batches):
        before, last = 0, None
        for x, parts, _ in _parts(_words(*held.value), batches):
            if not len(x.p):
                continue
            n = np.diff(x.at_group)
            base, doc_ids = [], []
            for i, (row, doc_id, _) in enumerate(parts):
                begin = int(x.start[x.at_a[i]])
                before = before if row == last else 0
                base.append(begin - before)
                before += int(x.end[x.at_a[i + 1] - 1]) - begin
                last = row
                doc_ids.append(doc_id)
            shift = np.repeat(base, n)
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())) for first, ids in ((x.first_a, x.a), (x.first_b, x.b))]
            ids = pa.array(doc_ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), n)))
            start, end = x.start[x.first_a[:-1]] - shift, x.end[x.first_a[1:] - 1] - shift
            yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(end, pa.int64()), *lists], [c.split()[0] for c in _GROUPS.split(", ")])

    return texts.mapInArrow(run, _GROUPS)


class _Block:
    """Texts and the dictionary of their pairs, as rows of _ROWS."""

    def __init__(self, number: int, n_b: int):
        self.number, self.n_b, self.docs, self.entries = number, n_b, [], 0

    def add(self, doc: tuple, key: np.ndarray, weight: np.ndarray) -> None:
        self.docs.append((doc, key, weight))
        self.entries += len(key)

    def rows(self):
        names = [c.split()[0] for c in _ROWS.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 2 + [pa.int32()] * 3 + [pa.int64()]
        key, inverse, docs = np.unique(np.concatenate([k for _, k, _ in self.docs]), return_inverse=True, return_counts=True)
        order = np.argsort(-docs, kind="stable")  # frequent pairs get small numbers
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        for at in range(0, len(key), 100_000):
            part = order[at : at + 100_000]
            empty = [pa.nulls(len(part), t) for t in types[1:9]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.number)), *empty, pa.array(place[part], pa.int32()), pa.array(key[part] // self.n_b, pa.int32()), pa.array(key[part] % self.n_b, pa.int32()), pa.array(docs[part], pa.int64())], names)
        out, at = [], 0
        for doc, k, weight in self.docs:
            own = place[inverse[at : at + len(k)]]
            at += len(k)
            sort = np.argsort(own)
            out.append((self.number, *doc, _pack(np.diff(own[sort], prepend=0)), _pack(weight[sort])))
        for at in range(0, len(out), 1000):
            columns = list(zip(*out[at : at + 1000], strict=True))
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *(pa.nulls(n, t) for t in types[9:])], names)


def _blocks(texts: DataFrame, held) -> DataFrame:
    def run(batches):
        words = _words(*held.value)
        table = _decimals(max(len(words.bytes_a), len(words.bytes_b)))
        number = TaskContext.get().partitionId() << 32
        block = _Block(number, len(words.bytes_b))
        none = np.zeros(0, np.int64)
        row, counts, digest, pairs = None, np.zeros(4, np.int64), None, []
        for x, parts, bare in _parts(words, batches):
            for doc_id in bare:
                block.add((doc_id, 0, 0, 0, 0, ""), none, none)
            if parts:
                each = np.stack([np.diff(v) for v in (x.at_a, x.at_b, x.at_group, x.links)], 1)
                for (now, doc_id, last), n, text, pair in zip(parts, each, x.listed(table), x.pairs(), strict=True):
                    if now != row:
                        row, counts, digest, pairs, text = now, np.zeros(4, np.int64), hashlib.sha256(), [], text[1:]
                    counts = counts + n
                    digest.update(text)
                    pairs.append(pair)
                    if last:
                        if len(pairs) > 1:
                            key, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
                            pairs = [(key, np.bincount(inverse, np.concatenate([w for _, w in pairs])).astype(np.int64))]
                        block.add((doc_id, *counts.tolist(), digest.hexdigest()), *pairs[0])
                        pairs = []
            if block.entries >= ENTRIES:
                yield from block.rows()
                number += 1
                block = _Block(number, block.n_b)
        if block.docs:
            yield from block.rows()

    return texts.mapInArrow(run, _ROWS)


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For every row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is counted most for its A id, ties included),
    count_sum (over links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`)."""
    rows = materialize(_blocks(*_inputs(docs, path_a, path_b)), "blocks")
    pairs = rows.filter("place is not null").select("block", "place", "a", "b", "docs")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    scored = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    listed = pairs.join(scored, ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    names = [c.split()[0] for c in _DOC.split(", ")]

    def summed(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(len(pairs), np.int64)
        count[pairs["place"]] = pairs["count"]
        best = np.zeros(len(pairs), np.int64)
        best[pairs["place"]] = pairs["best"]
        out = texts[names].copy()
        totals = []
        for places, weights in zip(texts["places"], texts["weights"], strict=True):
            at, weight = np.cumsum(_unpack(places)), _unpack(weights)
            totals.append((int(best[at] @ weight), int(count[at] @ weight)))
        out["n_best"], out["count_sum"] = [x for x, _ in totals], [x for _, x in totals]
        return out

    texts = rows.filter("place is null").select("block", *names, "places", "weights")
    return texts.groupBy("block").cogroup(listed.groupBy("of")).applyInPandas(summed, f"{_DOC}, n_best long, count_sum long")
