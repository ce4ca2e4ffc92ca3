"""N-gram Jaccard join: which texts share enough word shingles, and the components that these links make.

Texts with one shingle set are one node. A node's prefix - its rarest shingles, as many as a set may miss and still
pass - is dealt out by shingle, so any two linked nodes meet in a bucket. Buckets are walked by set size: a new tile
begins where sizes differ too much for a link, and members are first compared with the tile's smallest set. What
is still apart after that is compared within salted tiles. A pair must pass its sizes, then a bound on the overlap
from hashed bitmaps (bits of one set missing in the other), then an exact intersection of the sorted shingle arrays.

Components come first: pairs that are already connected aren't compared again there, and no component is ever missed.
Every link lies within a component, so the links are then counted exactly inside each component of three nodes or more,
in cells of two salted chunks; sizes decide which pairs a cell intersects. Nothing is compared across components.

Null or wordless texts have no shingles and link with nothing. Repeated rows and doc_ids are kept. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import connected_components, drop, freeing, id_bitmap, in_bitmap, keeps_columns, materialize, slices, text_rows, utf8_batch
from .rolling import mix, shingle_sets

#: Rows that a tile holds at most; larger buckets are dealt out over pairs of chunks.
TILE = 1024
#: Pairs that a task holds before it gives them out.
PAIRS = 1 << 15
#: Rows with bitmaps and tokens that are sent to Python at once: they may take 12 kB each.
WIDE_ROWS = 1000
#: Shingles that a chunk of a component holds, about.
CHUNK_SHINGLES = 1 << 19
#: Least tokens of a node that its rows carry, so that a pair comes from one bucket: with more in common it may come again, never less.
EARLIER = 512
#: Shingles known to be frequent, at most. Only the order of prefixes depends on it, never the result.
HOT_SHINGLES = 1 << 18


def _node(shingles: np.ndarray) -> int:
    """One id for a shingle set."""
    with np.errstate(over="ignore"):
        h = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def _bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's hash, in a power of two of about twice as many bits; halves can be folded together."""
    bits = min(1 << 16, max(64, 1 << int(2 * len(shingles) - 1).bit_length()))
    words = np.zeros(bits // 8, np.uint8)
    at = ((shingles >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(words, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return words.tobytes()


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def _overlap_needed(a, b, similarity: int):
    """Least intersection for 100 * i >= similarity * (a + b - i)."""
    return -(-similarity * (a + b) // (100 + similarity))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """A row for each text (kind 0: node, size, bitmap) and for each shingle that a task has met often (kind 1)."""
    schema = "kind byte, doc_id long, uid long, node long, n long, bitmap binary, shingle long, times long"

    def run(batches):
        held, size, known = [], 0, set()

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 4
            m = int(keep.sum())
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int8)), none, none, none, none, pa.nulls(m, pa.binary()), pa.array(values[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))],
                ["kind", "doc_id", "uid", "node", "n", "bitmap", "shingle", "times"],
            )

        for batch in slices(batches):
            ids, ns, maps = [], [], []
            for s in shingle_sets(*utf8_batch(batch.column("text")), k):
                ns.append(len(s))
                ids.append(_node(s) if len(s) else None)
                maps.append(_bitmap(s) if len(s) else None)
                if len(s) and ids[-1] not in known:
                    known.add(ids[-1])
                    held.append(s)
                    size += len(s)
                    if size >= 1 << 21:
                        yield counted()
                        held, size, known = [], 0, set()
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int8)), batch.column("doc_id"), batch.column("uid"), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                ["kind", "doc_id", "uid", "node", "n", "bitmap", "shingle", "times"],
            )
        if held:
            yield counted()

    return rows.mapInArrow(freeing(run), schema)


def _prefixes(rows: DataFrame, k: int, similarity: int, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(token, node, n) for the rarest n - ceil(similarity * n) + 1 shingles of each set; a task emits a set once."""
    held = rows.sparkSession.sparkContext.broadcast((hot, rank))

    def run(batches):
        hot, rank = held.value
        known = set()
        for batch in slices(batches):
            tokens, nodes, ns = [], [], []
            for s in shingle_sets(*utf8_batch(batch.column("text")), k):
                n = len(s)
                if not n or (node := _node(s)) in known:
                    continue
                known.add(node)
                take = n - -(-similarity * n // 100) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    often = hot[at] == s
                    rare = s[~often]
                    if len(rare) < take:
                        rare = np.concatenate((rare, s[often][np.argsort(rank[at[often]], kind="stable")]))
                    s = rare
                s = s[:take]
                tokens.append(s)
                nodes.append(np.full(len(s), node, np.int64))
                ns.append(np.full(len(s), n, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ns))], ["token", "node", "n"])

    return rows.select("text").mapInArrow(freeing(run), "token long, node long, n long")


def _buckets(prefixes: DataFrame, similarity: int) -> DataFrame:
    """(token, node, n, hub) of buckets with more than one node; hub: the smallest set of the node's tile.

    Rows come sorted, so a bucket is never held: only its tile's hub and its first row are."""

    def run(batches):
        token = node = hub = size = first = None  # of the row before; first: a row that has met no other yet
        for batch in batches:
            t, v, n = (batch.column(c).to_numpy() for c in ("token", "node", "n"))
            if not len(t):
                continue
            same = np.empty(len(t), bool)
            same[0] = token is not None and t[0] == token
            same[1:] = t[1:] == t[:-1]
            again = np.empty(len(t), bool)
            again[0] = same[0] and v[0] == node
            again[1:] = same[1:] & (v[1:] == v[:-1])
            many = same.copy()
            many[:-1] |= same[1:]
            many[-1] = True
            out = []
            for i in np.flatnonzero(many & ~again).tolist():
                if not same[i]:
                    token, node, hub, size = int(t[i]), int(v[i]), int(v[i]), int(n[i])
                    first = (token, node, size, hub)
                    continue
                if first:
                    out.append(first)
                    first = None
                node = int(v[i])
                if similarity * int(n[i]) > 100 * size:
                    hub, size = node, int(n[i])
                out.append((token, node, int(n[i]), hub))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["token", "node", "n", "hub"])

    return prefixes.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(freeing(run), "token long, node long, n long, hub long")


def _bounded(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave possible."""
    wide = pairs
    for x in "ab":
        wide = wide.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}")), x)
    wide = wide.filter((F.lit(similarity) * F.col("na") <= 100 * F.col("nb")) & (F.lit(similarity) * F.col("nb") <= 100 * F.col("na")))

    def run(batches):
        for batch in slices(batches, 1024):
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            need = _overlap_needed(na, nb, similarity)
            keep = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(batch.column("ma"), batch.column("mb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                x, y = _fold(x, size), _fold(y, size)
                keep[i] = min(na[i] - np.bitwise_count(x & ~y).sum(dtype=np.int64), nb[i] - np.bitwise_count(y & ~x).sum(dtype=np.int64)) >= need[i]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return wide.mapInArrow(freeing(run), "a long, b long")


def _tiles(mixed: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different roots within a bucket that sizes and bitmaps leave possible; a tile holds a bucket or two of its
    chunks. nearest: of each set's pairs with larger ones, only the one with the greatest bound. Otherwise a pair comes from one
    bucket only: that of the least token that both share. tokens: the first buckets that each node is in; rows carry those before their own."""

    def pairs(rows):
        rows.sort(key=lambda r: r[1])
        last: list = [None, frozenset()]  # the row that pairs are looked for just now, and its tokens

        def meets_here(i, j):
            if last[0] != i:
                last[:] = [i, frozenset(rows[i][5])]
            return last[1].isdisjoint(rows[j][5])

        n = np.array([r[1] for r in rows])
        root = np.array([r[2] for r in rows])
        chunk = np.array([r[4] for r in rows])
        sizes = np.array([len(r[3]) // 8 for r in rows])
        by_size = {z: np.array([np.frombuffer(rows[i][3], np.uint64) for i in np.flatnonzero(sizes == z)]) for z in np.unique(sizes).tolist()}
        within = np.zeros(len(rows), np.int64)
        for z in by_size:
            within[sizes == z] = np.arange((sizes == z).sum())
        crossing = len(np.unique(chunk)) > 1
        for i in range(len(rows) - 1):
            stop = np.searchsorted(n, 100 * n[i] // similarity, "right")
            j = np.arange(i + 1, stop)
            j = j[(root[j] != root[i]) & ((chunk[j] != chunk[i]) if crossing else True)]
            if not len(j):
                continue
            mine = by_size[sizes[i]][within[i]]
            top, partner = -1, None
            for z in np.unique(sizes[j]).tolist():
                at = j[sizes[j] == z]
                low = min(z, len(mine))
                other, own = _fold(by_size[z][within[at]], low), _fold(mine, low)
                bound = np.minimum(n[i] - np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64), n[at] - np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64))
                spare = bound - _overlap_needed(n[i], n[at], similarity)
                if nearest:
                    if spare.max() > top:
                        top, partner = int(spare.max()), int(at[spare.argmax()])
                    continue
                for b in at[spare >= 0].tolist():
                    if meets_here(i, b):
                        yield rows[i][0], rows[b][0]
            if partner is not None and top >= 0:
                yield rows[i][0], rows[partner][0]

    def run(batches):
        """Pairs go out as they are found: a tile of near copies that no link joins yet has as many as the square of its rows."""
        columns = lambda out: pa.RecordBatch.from_arrays([pa.array([p[x] for p in out], pa.int64()) for x in (0, 1)], ["a", "b"])

        def tiles():
            key, rows = None, []
            for batch in slices(batches, 512):  # lists of tokens become Python's a few rows at a time
                for r in zip(*(batch.column(c).to_pylist() for c in ("token", "lo", "hi", "node", "n", "root", "bitmap", "chunk", "tokens")), strict=True):
                    if r[:3] != key:
                        yield rows
                        key, rows = r[:3], []
                    rows.append(r[3:])
            yield rows

        out = []
        for rows in tiles():
            for pair in pairs(rows) if len(rows) > 1 else ():
                out.append(pair)
                if len(out) >= PAIRS:
                    yield columns(out)
                    out = []
        yield columns(out)

    cells = (
        mixed.withColumn("chunks", F.expr(f"cast(ceil(m / {TILE}) as int)"))
        .withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("token", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "n", "root", "bitmap", "chunk", F.filter("tokens", lambda x: x < F.col("token")).alias("tokens"))
    )
    return cells.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(freeing(run), "a long, b long")


def _texts(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """wanted (node, ...) with the text of a row that represents the node; and a table to drop when they are read."""
    reps = materialize(nodes.select("node", F.col("doc_id").alias("rep_id"), F.col("uid").alias("rep_uid")).join(wanted, "node"), f"{name}-wanted")
    near = rows.filter(in_bitmap(rows.sparkSession, id_bitmap(reps, "rep_uid"), "uid"))
    return near.join(reps, (F.col("uid") == F.col("rep_uid")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).dropDuplicates(["node"]), reps


def _with_shingles(texts: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """The kept long columns of texts and their shingles."""

    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(*utf8_batch(batch.column("text")), k))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*keep, "shingles"])

    return texts.select(*keep, "text").mapInArrow(freeing(run), ", ".join(f"{c} long" for c in keep) + ", shingles array<long>")


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, similarity: int, name: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets pass exactly, as a table."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts, reps = _texts(wanted, nodes, rows, name)
    sets = materialize(_with_shingles(texts, k, ["node"]), f"{name}-sets")
    drop(reps)
    both = F.size(F.array_intersect("x", "y"))
    out = materialize(
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", both.alias("both"), F.size("x").alias("na"), F.size("y").alias("nb"))
        .filter(100 * F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both")))
        .select("a", "b"),
        f"{name}-links",
    )
    drop(sets)
    return out


def _cell_links(node: np.ndarray, chunk: np.ndarray, offsets: np.ndarray, flat: np.ndarray, similarity: int):
    """Arrays (a, b), a < b, of the links of a cell's rows, ordered by chunk and set size; of two chunks only those across."""
    n = np.diff(offsets)
    flat = np.unique(flat, return_inverse=True)[1]
    mine = np.zeros(flat.max() + 1, bool)
    split = int(np.searchsorted(chunk, chunk[-1]))  # where the last chunk begins, 0 if it is the only one
    for i in range(split or len(n)):
        begin, end = split or i + 1, len(n)
        low = begin + int(np.searchsorted(n[begin:end], -(-similarity * n[i] // 100)))
        high = begin + int(np.searchsorted(n[begin:end], 100 * n[i] // similarity, "right"))
        if low >= high:
            continue
        own = flat[offsets[i] : offsets[i + 1]]
        mine[own] = True
        both = np.add.reduceat(mine[flat[offsets[low] : offsets[high]]], offsets[low:high] - offsets[low], dtype=np.int64)
        mine[own] = False
        other = node[low:high][both >= _overlap_needed(n[i], n[low:high], similarity)]
        if len(other):
            yield np.minimum(other, node[i]), np.maximum(other, node[i])


def _every_link(links: DataFrame, roots: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, similarity: int) -> DataFrame:
    """All links (a, b), a < b. links: enough of them to span the components that roots (node, root) gives."""
    size = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    sized = materialize(roots.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("m"), size.alias("chunks")), "sizes")
    pairs = links.join(roots, F.col("a") == F.col("node")).join(sized.filter("m = 2"), "root", "left_semi")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = roots.join(sized.filter("m > 2").select("root", "chunks"), "root")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    texts, reps = _texts(wanted, nodes, rows, "every")
    cells = (
        _with_shingles(texts, k, ["node", "root", "chunks"])
        .select("root", "node", "shingles", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
        .select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", F.size("shingles").alias("n"), "node", "shingles")
    )

    def run(batches):
        key, held = None, []

        def found():
            part = pa.Table.from_batches(held).combine_chunks()
            if len(part) < 2:
                return
            sets = part["shingles"].combine_chunks()
            offsets = np.concatenate(([0], np.cumsum(part["n"].to_numpy().astype(np.int64))))
            out, m = [], 0
            if part["lo"][0] != part["hi"][0] and part["chunk"][0] == part["chunk"][-1]:
                return
            for x in _cell_links(part["node"].to_numpy(), part["chunk"].to_numpy(), offsets, sets.flatten().to_numpy(), similarity):
                out.append(x)
                m += len(x[0])
                if m >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])
                    out, m = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("root", "lo", "hi")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for begin, end in zip(starts, starts[1:]):
                if (own := tuple(keys[begin].tolist())) != key:
                    if held:
                        yield from found()
                    key, held = own, []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from found()

    found = cells.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "chunk", "n").mapInArrow(freeing(run), "a long, b long")
    out = materialize(pairs.union(found), "every-link")
    drop(reps, sized)
    return out


def similar_texts(docs: DataFrame, k: int = 5, similarity: int = 80, components_only: bool = False) -> dict[str, DataFrame]:
    """Link texts whose distinct k-word shingles have 100 * intersection >= similarity * union.

    documents: doc_id, uid, node (null without words), n_shingles, root (one node of the component, null without words),
    component_id (smallest doc_id reachable), n_links (other nodes that the document's node links with).
    links: all verified pairs (a, b) of nodes, a < b.
    components_only: documents without n_links, and no links.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    seen = materialize(_nodes(rows, k), "nodes")
    found = seen.filter("kind = 0")
    nodes = materialize(
        found.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min(F.struct("doc_id", "uid")).alias("rep")).select("node", "n", "bitmap", "rep.*"),
        "sets",
    )
    hot = seen.filter("kind = 1").groupBy("shingle").agg(F.sum("times").alias("times")).filter("times >= 32").orderBy(F.desc("times"), "shingle").limit(HOT_SHINGLES).toPandas()
    hot["rank"] = np.arange(len(hot))[::-1]
    values = hot["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    buckets = materialize(_buckets(_prefixes(rows, k, similarity, values[order], hot["rank"].to_numpy(np.int64)[order]), similarity), "buckets")

    star = buckets.filter("hub <> node")
    nearest = star.groupBy("node").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = materialize(_bounded(nearest, nodes, similarity), "near-pairs", WIDE_ROWS)
    links = _linked(near, nodes, rows, k, similarity, "near")
    drop(near)
    roots = materialize(connected_components(links), "roots")

    tried = None
    # what is still apart: first each set with its nearest in a tile, which joins most groups, then every pair
    for turn, nearest in (("close", True), ("rest", False)):
        placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        same = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"sign{i}") for i in (0, 1)]
        apart = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), *same).filter("low <> high")
        apart = apart.groupBy("m", "sign0", "sign1").agg(F.min("token").alias("token")).select("token", "m")  # one bucket of those with the same nodes
        mixed = materialize(placed.join(apart, "token").select("token", "node", "n", "hub", "root", "m"), f"{turn}-mixed")
        pairs = _bounded(mixed.filter("m = 2 and hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, similarity)
        many = mixed.filter("m > 2")
        # a node is in as many buckets as its prefix is long
        tokens = F.array().cast("array<long>") if nearest else F.slice(F.array_sort(F.collect_set("token")), 1, EARLIER)
        held = many.select("node").distinct().withColumn("tokens", tokens) if nearest else many.groupBy("node").agg(tokens.alias("tokens"))
        wide = many.join(held.join(nodes.select("node", "bitmap"), "node"), "node")
        rest = pairs.union(_tiles(wide, similarity, nearest)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        before = tried
        if before is not None:
            rest = rest.join(before, ["a", "b"], "left_anti")
        tried = materialize(rest, f"{turn}-tried", WIDE_ROWS)
        drop(mixed, *([before] if before is not None else ()))
        more = _linked(tried, nodes, rows, k, similarity, turn)
        links = links.union(more)
        # what was connected before stays so through its roots
        known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        old, roots = roots, materialize(connected_components(known.union(more)), "roots")
        drop(old)
    drop(buckets, tried)

    placed = found.select("doc_id", "uid", "node", F.col("n").alias("n_shingles")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    documents = placed.join(least, "root", "left").select("doc_id", "uid", "node", "n_shingles", "root", F.coalesce("least", "doc_id").alias("component_id"))
    if components_only:
        return {"documents": documents}
    links = _every_link(links, roots, nodes, rows, k, similarity)
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degrees = materialize(ends.groupBy("node").agg(F.count("*").alias("n_links")), "degrees")
    return {"documents": documents.join(degrees, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "links": links}


@keeps_columns
def keep_one(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id, null only if all are. Wordless rows stay, repeated ones too."""
    found = materialize(similar_texts(docs, k, similarity, components_only=True)["documents"], "components").filter("root is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    keys = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_kept_id"), F.col("first.uid").alias("_kept_uid"))
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    own = docs.withColumn("_uid", F.xxhash64(doc_id, text)).withColumn("_wordless", ~text.rlike(r"[^\x20\x09-\x0D]"))
    kept = own.join(keys, (F.col("_uid") == F.col("_kept_uid")) & doc_id.eqNullSafe(F.col("_kept_id")), "left").filter("_wordless or _kept_uid is not null")
    copy = F.when(F.col("_wordless"), F.monotonically_increasing_id())  # null where rows that repeat the kept one go
    return kept.withColumn("_copy", copy).dropDuplicates(["doc_id", "_uid", "_copy"]).select(*docs.columns)
