"""Repeated passages by bucket-pointer refinement of a sparse suffix array.

Every string of `length` bytes owns one anchor: the start of its least q-gram by hash (leftmost on ties), so equal
strings own anchors at equal offsets. Strings that share an anchor form a block, one row. Then, as in bucket-pointer
refinement:

* initial buckets hold the anchors with one q-gram; a bucket with one block is final and leaves;
* in each round the blocks of a bucket are cut into parts, and the bucket is split by the identifiers of the parts'
  strings at their offsets. The new bucket's identifier comes from the old one's, so each round reuses the last;
* a part is repeated when its whole string equals another's; it needs no further rounds. A part whose common core is
  alone in its bucket holds no repeated string and leaves. Parts end as single strings, which are equal or not.

Rows are grouped and joined by Spark; only blocks in shared buckets get their bytes fetched. Strings are compared by
128-bit hashes of their bytes. Matches never cross texts. Null texts count as empty; rows without a doc_id are rows like
any other; repeated rows and doc_ids are copies of each other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import id_bitmap, in_bitmap, materialize, text_rows, utf8_batch
from .rolling import mix, prefix, tables

#: Bytes in the q-gram of an initial bucket.
GRAM = 40
#: Sizes of parts, by round; the last round looks at single strings.
PARTS = (64, 8, 1)
_CHUNK = 1 << 19

_ANCHOR = "kind byte, doc_id long, uid long, bucket long, outer binary, n long, p long, lo long, hi long"


def _rows(docs: DataFrame) -> DataFrame:
    """text_rows with doc_id as own; in doc_id, rows without one have a hash of their text, so that joins find them."""
    return text_rows(docs).withColumn("own", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit(0), "text")))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """kind 0: a block (n times in its text, its strings start at lo to hi, its anchor is p); kind 1: repeated bytes [lo, hi)."""
    window = length - GRAM + 1

    def owners(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each string start and each q-gram's hash."""
        s = prefix(data)
        with np.errstate(over="ignore"):
            gram = mix((s[GRAM:] - s[:-GRAM]) * tables()[2][: len(s) - GRAM])
        low = (gram & ~np.uint64(_CHUNK * 2 - 1)) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < window:
            low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
        return (low & np.uint64(_CHUNK * 2 - 1)).astype(np.int64), gram

    def run(batches):
        for batch in batches:
            data, offsets = utf8_batch(batch.column("text"))
            doc_ids, uids = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("uid").to_numpy()
            # jobs: (row, first and end of the string starts looked at, first and end of those whose blocks begin here);
            # long texts in several, each seeing enough of its neighbours to have its blocks whole
            jobs = []
            for i in range(len(batch)):
                n = int(offsets[i + 1] - offsets[i]) - length + 1
                jobs += [(i, max(0, a - window), min(n, a + _CHUNK + window), a, min(n, a + _CHUNK)) for a in range(0, max(0, n), _CHUNK)]
            out: list[list] = [[] for _ in range(9)]
            at = 0
            while at < len(jobs):
                stop, size = at, 0
                while stop < len(jobs) and (stop == at or size + jobs[stop][2] - jobs[stop][1] + length <= _CHUNK):
                    size += jobs[stop][2] - jobs[stop][1] + length - 1
                    stop += 1
                chunk = np.concatenate([data[offsets[i] + a : offsets[i] + b + length - 1] for i, a, b, _, _ in jobs[at:stop]])
                own, gram = owners(chunk)
                raw, base = chunk.tobytes(), 0
                for i, a, b, begin, end in jobs[at:stop]:
                    mine = own[base : base + b - a]
                    cut = np.flatnonzero(np.diff(mine)) + 1
                    first = np.concatenate(([0], cut))
                    last = np.concatenate((cut, [len(mine)])) - 1
                    here = (first + a >= begin) & (first + a < end)
                    first, last = first[here], last[here]
                    p = mine[first]
                    shift = int(a - base)
                    blocks: dict[bytes, list] = {}
                    for x, y, z in zip((first + base).tolist(), (last + base).tolist(), p.tolist(), strict=True):
                        blocks.setdefault(xxhash.xxh3_128_digest(raw[x : y + length]), []).append((x, y, z))
                    spans = []
                    for outer, held in blocks.items():
                        x, y, z = held[0]
                        for c, v in zip(out, (0, doc_ids[i], uids[i], int(gram[z].view(np.int64)), outer, len(held), z + shift, x + shift, y + shift), strict=True):
                            c.append(v)
                        if len(held) > 1:
                            spans += [(x, y + length) for x, y, _ in held]
                    for x, y in _merged(spans):
                        for c, v in zip(out, (1, doc_ids[i], uids[i], None, None, None, None, x + shift, y + shift), strict=True):
                            c.append(v)
                    base += b - a + length - 1
                at = stop
            types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in _ANCHOR.split(", ")])

    return rows.mapInArrow(run, _ANCHOR)


def _merged(spans: list) -> list:
    """Disjoint, non-adjacent [lo, hi) in order."""
    out: list = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _round(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): blocks of rows (bucket, outer, n, rep) whose string occurs again, and one block for each string of
    the buckets that still hold an unrepeated one next to another."""
    blocks = materialize(rows.groupBy("bucket", "outer").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")), f"{name}-blocks")
    shared = blocks.groupBy("bucket").agg(F.count("*").alias("strings"), F.min("n").alias("least")).filter("strings > 1 and least = 1").select("bucket")
    return blocks.filter("n > 1").select("bucket", "outer"), blocks.join(shared, "bucket", "left_semi")


def _parts(context: DataFrame, live: DataFrame, size: int, length: int) -> DataFrame:
    """Cut the live parts (cid, bucket, n, t0, t1: offsets of the anchor in its strings) into parts of that size."""
    schema = "bucket long, outer binary, n long, cid long, t0 long, t1 long"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for cid, bucket, n, t0, t1, first, last, anchor, raw in zip(*(batch.column(c).to_pylist() for c in ("cid", "bucket", "n", "t0", "t1", "first", "last", "anchor", "bytes")), strict=True):
                # strings start at anchor - t; those of this block have first <= t <= last
                for k in range(max(t0, first) // size, min(t1, last) // size + 1):
                    a, b = k * size, min(k * size + size - 1, length - GRAM)
                    core = xxhash.xxh3_64_intdigest(raw[anchor - a : anchor - b + length], seed=(bucket ^ (a * 0x9E3779B97F4A7C15)) & (2**64 - 1))
                    if anchor - b >= 0 and anchor - a + length <= len(raw):
                        outer = xxhash.xxh3_128_digest(raw[anchor - b : anchor - a + length])
                    else:  # the text ends within: no whole string of this part's size
                        outer = cid.to_bytes(8, "little", signed=True) + b"-"
                    for c, v in zip(out, (core - 2**64 if core >= 2**63 else core, outer, n, cid, a, b), strict=True):
                        c.append(v)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["bucket", "outer", "n", "cid", "t0", "t1"])

    return live.join(context, "cid").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, uid, lo, hi): byte ranges, possibly overlapping, whose union is each text's bytes covered by a string of
    `length` bytes that also starts elsewhere; doc_id and uid as in _rows."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    rows = _rows(docs)
    seen = materialize(_anchors(rows, length), "anchors")
    blocks = seen.filter("kind = 0").withColumn("rep", F.struct("doc_id", "uid", "p", "lo", "hi"))
    repeated, live = _round(blocks, "grams")
    live = materialize(live.select("bucket", "n", F.xxhash64("bucket", "outer").alias("cid"), "rep.*"), "live")
    spans = [
        seen.filter("kind = 1").select("doc_id", "uid", "lo", "hi"),
        blocks.filter("n = 1").join(repeated, ["bucket", "outer"], "left_semi").select("doc_id", "uid", "lo", (F.col("hi") + length).alias("hi")),
    ]

    # the bytes around each live anchor
    reach = length - GRAM
    begin = F.greatest(F.col("p") - reach, F.lit(0))
    wanted = rows.filter(in_bitmap(spark, id_bitmap(live, "doc_id"), "doc_id"))
    context = materialize(
        wanted.join(live, ["doc_id", "uid"]).select(
            "cid", "doc_id", "uid", "p", (F.col("p") - F.col("hi")).alias("first"), (F.col("p") - F.col("lo")).alias("last"), (F.col("p") - begin).alias("anchor"),
            F.expr(f"substring(cast(text as binary), cast(greatest(p - {reach}, 0) + 1 as int), cast(p - greatest(p - {reach}, 0) + {length} as int))").alias("bytes"),
        ).dropDuplicates(["cid"]),
        "context",
    )
    live = live.select("cid", "bucket", "n", F.lit(0).cast("long").alias("t0"), F.lit(reach).cast("long").alias("t1"))
    for size in PARTS:
        parts = materialize(_parts(context, live, size, length).withColumn("rep", F.struct("cid", "t0", "t1")), f"parts-{size}")
        repeated, left = _round(parts, f"parts-{size}")
        hits = parts.filter("n = 1").join(repeated, ["bucket", "outer"], "left_semi")
        spans.append(hits.join(context.select("cid", "doc_id", "uid", "p"), "cid").select("doc_id", "uid", (F.col("p") - F.col("t1")).alias("lo"), (F.col("p") - F.col("t0") + length).alias("hi")))
        live = left.select("bucket", "n", "rep.*")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, kept binary, text, n_bytes, n_removed, spans array<struct<lo, hi>>): texts without their repeated bytes; in text,
    what is left of a character that was cut in two is left out."""
    spark = docs.sparkSession
    rows = _rows(docs)
    spans = materialize(repeated_spans(docs, length), "spans")
    # overlapping ranges of a task's rows are joined before the shuffle
    gathered = materialize(spans.groupBy("doc_id", "uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "gathered")
    touched = in_bitmap(spark, id_bitmap(gathered, "doc_id"), "doc_id")
    raw = F.col("text").cast("binary")
    flagged = rows.withColumn("touched", touched)
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    whole = flagged.filter("not touched").select(F.col("own").alias("doc_id"), raw.alias("kept"), "text", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"))

    def run(batches):
        for batch in batches:
            kept, sizes, removed, merged = [], [], [], []
            for text, spans in zip(batch.column("raw"), batch.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                held = _merged([(s["lo"], s["hi"]) for s in spans or ()])
                at, pieces = 0, []
                for lo, hi in held:
                    pieces.append(text[at:lo])
                    at = hi
                kept.append(b"".join([*pieces, text[at:]]))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                merged.append([{"lo": lo, "hi": hi} for lo, hi in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["doc_id", "kept", "text", "n_bytes", "n_removed", "spans"],
            )

    cut = flagged.filter("touched").join(gathered, ["doc_id", "uid"], "left").select(F.col("own").alias("doc_id"), raw.alias("raw"), "spans").mapInArrow(run, "doc_id long, kept binary, text string, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>")
    return whole.unionByName(cut)
