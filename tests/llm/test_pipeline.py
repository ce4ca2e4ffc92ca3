"""The pipeline's stages against brute force on a small corpus with nulls, repeats, long texts and clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from hushframe.llm import jaccard_join, mixing, quality_knn, secret_ledger  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, rate double, score string"
LABELS = "doc_id long, quality int, toxic int"
KEY = "AKIA" + "ABCD1234" * 2


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("aeinstlr") for _ in range(r.randrange(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(160):
        words = [r.choice(vocab) for _ in range(r.choice([12, 40, 120]))]
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 8 == 1:
            words[3] = words[5] = words[7] = "vilest"
        if i % 8 == 2 and i > 2:
            words = rows[i - 8][1].split(" ")  # copies of the row before of its kind, some with a word more
            words = words + ["end"] if i % 16 == 2 and len(words) > 30 else words
        if i % 8 == 3:
            words[4] = f"password={KEY}{i}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 != 0), int(i % 8 == 1)))
    rows += [(500, None), (501, ""), (None, rows[20][1]), (21, rows[21][1]), (22, rows[28][1] + " other"), (502, "longword" * 40_000 + " ends"), (503, rows[33][1] + " " + "z" * 200_000)]
    return [(i, t, "en", "s", len(t or ""), 7, 0.5, "x") for i, t in rows], labels


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(rows):
    """Rows left when one row of each component of similar texts stays, the one of the smallest doc_id; wordless rows stay."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else (i,), []).append(i)
    return [{(rows[i][0], rows[i][1]) for i in g if rows[i][0] == min((rows[j][0] for j in g if rows[j][0] is not None), default=None)} for g in groups.values()]


def masked(text):
    """Every span of any rule masked once, by Python's own engine."""
    hit = [False] * len(text)
    starts = set()
    for pattern, least, group, _ in secret_ledger.RULES.values():
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                hit[m.start() : m.end()] = [True] * (m.end() - m.start())
                starts.add(m.start())
    return re.sub("\x02+", "[SECRET]", "".join("\x02" if h else c for c, h in zip(text, hit, strict=True)))


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = corpus()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = spark.read.parquet(f"{tmp_path}/labels.parquet")
    schema, held = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert docs.schema.names == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        docs.write.parquet(f"{tmp_path}/{len(held)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(held)}")
        held[name] = (before.collect(), docs.collect())

    # quality: the score decides, and it decides well
    before, after = held["quality classifier"]
    model = quality_knn.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), known)
    score = lambda t: model.score(quality_knn.term_shares(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])))[0]
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if score(r.text) >= quality_knn.THRESHOLD)
    left = [r.doc_id for r in after if r.doc_id is not None and r.doc_id < 160]
    assert sum(i % 8 == 0 for i in left) <= 2 and sum(i % 8 != 0 for i in left) >= 135

    before, after = held["n-gram Jaccard join"]
    groups = one_of_each(before)
    kept = [(r.doc_id, r.text) for r in after]
    assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups)

    before, after = held["secret scans"]
    want = [tuple(r) if r.text is None else (r.doc_id, t := masked(r.text), r.lang, r.source, len(t), *r[5:]) for r in before]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in after) and not any(KEY in (r.text or "") for r in after)

    before, after = held["mixing sources to target weights"]
    texts = {r.text for r in before}
    assert {r.text for r in after} <= texts
    kinds = lambda rows, k: sum(r.doc_id is not None and r.doc_id < 160 and r.doc_id % 8 == k for r in rows)
    assert kinds(after, 1) < kinds(before, 1)  # toxic text is thinned out
    clean = {(r.doc_id, r.text) for r in before if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 8 not in (0, 1)}
    assert len({(r.doc_id, r.text) for r in after} & clean) >= 0.95 * len(clean)

    before, after = held["best-fit packing"]
    coder, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in before:
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in after)
    by = {}
    for r in after:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 4096

    # run() does the same
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(map(repr, r[:5])) for r in run) == sorted(tuple(map(repr, r[:5])) for r in after)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_helpers_keep_their_values(spark):
    """Extra columns with every name that the stages make for themselves come through unchanged."""
    helpers = ["_text", "_blob", "_suspect", "_found", "_known", "_uid", "_wordless", "_copy", "_kept_id", "_kept_uid", "_copies", "_turn"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in helpers)
    rows = [(i, t, 7, *(f"{c} of {i}" for c in helpers)) for i, t in enumerate(["password = abcdef123", "one two three four five six seven", None, "", "one two three four five six seven"])]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for stage in (secret_ledger.without_secrets, jaccard_join.keep_one, lambda d: mixing.repeat_by_rate(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in helpers] == [f"{c} of {r.doc_id}" for c in helpers]
