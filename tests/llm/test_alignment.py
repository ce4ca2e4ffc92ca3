import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from hushframe.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """(groups with ends, or None) of each text by walking both lists."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    letters = A._byte_level()
    entry = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, i in a.get_vocab().items()}
    piece = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
    out = []
    for t in texts:
        ids = [(a.encode(" " + t, add_special_tokens=False).ids, entry), (b.encode(t), piece)] if t else []
        if not t or any(b"".join(table[i] for i in x) != (" " + t).encode() for x, table in ids):
            out.append(None)
            continue
        ends = []
        for x, table in ids:
            at, e = 0, []
            for i in x:
                at += len(table[i])
                e.append(at)
            ends.append(e)
        groups, at, last = [], 0, [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            now = [bisect.bisect_right(x, e) for x in ends]
            groups.append((at, e, *(ids[k][0][last[k] : now[k]] for k in range(2))))
            at, last = e, now
        out.append(groups)
    return out


def wanted(rows):
    found = brute([t for _, t, *_ in rows])
    links = [[(x, y) for _, _, a, b in g or [] for x in a for y in b] for g in found]
    count = Counter(p for x in links for p in set(x))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (doc_id, *_), g, x in zip(rows, found, links):
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in g).encode()).hexdigest() if g else ""
        out.append((doc_id, sum(len(a) for *_, a, _ in g or []), sum(len(b) for *_, b in g or []), len(g or []), len(x), digest, sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x)))
    return out


def rows():
    r = random.Random(6)
    alphabet = "ab  éß日本😀\n\t<|endoftext|>01 the \x00'"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    texts += ["The cat sat. " * k for k in range(9)] * 2 + [None, "", " ", "  ", "a ", "▁ a", "a▁b", "12345678 " * 20, " " * 300 + "x", "\n \n x", "x \n\n y"]
    return [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, "The cat", 1, 2), (3, "The cat", 1, 2), (None, "The cat", 1, 2)]


SCHEMA = "doc_id int, text string, block int, a int"


def test_link_counts_equal_brute_force(spark):
    """Also with a text of more words than are coalesced at a time."""
    whole = rows() + [(901, "The cat  12 " * 80_000, 1, 2)]
    got = sorted(map(tuple, A.link_counts(spark.createDataFrame(whole, SCHEMA).repartition(3), *PATHS).collect()), key=str)
    assert got == sorted(wanted(whole), key=str)


def test_parts_of_small_size_in_one_process(monkeypatch):
    """The same pieces without Spark, where small bounds reach the code."""
    words = A.Words(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = brute(texts)
    for size, links in ((200_000, 64), (3, 0)):
        monkeypatch.setattr(A, "WORDS", size)
        monkeypatch.setattr(A, "LINKS", links)
        monkeypatch.setattr(A.Words, "MOST", size)
        ids, pairs = {}, {}
        for x, parts, bare in A._parts(words, [batch]):
            for i in bare:
                assert not found[i]
            if parts:
                for (_, i, _), text, (key, weight) in zip(parts, x.listed(A._decimals(60_000)), x.pairs()):
                    ids[i] = ids.get(i, b"") + text
                    pairs.setdefault(i, Counter()).update(dict(zip(key.tolist(), weight.tolist())))
        for i, g in enumerate(found):
            if g:
                assert ids[i][1:].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in g)
                assert pairs[i] == Counter(p * x.n_b + q for _, _, a, b in g for p in a for q in b)


def test_groups_give_spans_and_ids(spark):
    got = A.groups(spark.createDataFrame(rows()[:60] + [(900, "the cat sat " * 40_000, 1, 2)], SCHEMA), *PATHS).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.end, list(r.a), list(r.b)))
    texts = [t for _, t, *_ in rows()[:60]]
    for i, g in enumerate(brute(texts)):
        assert sorted(by.get(i, [])) == (g or [])
    long = sorted(by[900])
    assert [x[0] for x in long] == [0, *(x[1] for x in long[:-1])] and long[-1][1] == len("the cat sat ") * 40_000 + 1


def test_empty_table(spark):
    assert A.link_counts(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


def test_packed_numbers():
    import numpy as np

    x = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert A._unpack(A._pack(x)).tolist() == x.tolist()
