"""Near copies by SimHash anchor covering with an exact check, and what lies beyond its reach.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of at least
4/5. First simhash's covering-code anchors link the sets' 64-bit SimHash fingerprints within three
bits, and the sets of these links are compared whole. At the similarity wanted most pairs differ in
more bits than any cover of useful size reaches, so the rest is found by prefix filtering, among
sets that the cover left in different components.

With all shingles in one order, a set of n is written under its first n - ceil(4n/5) + 1
shingles; two sets that reach the similarity share one of these, so no pair is missed. Any order
is right: shingles that are frequent in a sample come last, which only keeps the groups of a
shingle small. Pairs are left out by exact bounds (sizes, places) and by their sets'
SimHash fingerprints: at the similarity wanted these differ in 10 bits, give or take 3, and pairs
that differ in more than FAR of 64 are not compared. Of the rest, parity sketches leave out pairs
that surely differ in more shingles than allowed, and what remains is compared on whole sets.

Groups up to SMALL are paired whole. In larger ones neighbours in the order of the fingerprints,
turned by a number of bits that each shingle sets, are compared first; what this leaves in
different components is then paired whole. A large group of which few texts are alike therefore
costs the square of its size.

Shingles and sets stand for themselves by 64-bit hashes. Words are as in simhash; a text of less
than five words is one shingle. Null and empty texts, and texts without a word, are one class.
Documents with a null id have a class like others; the class id is the least non-null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .common import bounded_ids, discard, map_text, materialize, pieces
from .graph import components
from .simhash import _LOWER, SEED

SHINGLE = 5
#: Documents and shingles of the sample that orders frequent shingles last; it changes no result.
SAMPLE = 4_000
FREQUENT = 100_000
#: Groups up to this size are paired whole at once; neighbours tried in larger ones.
SMALL = 128
NEAR = 3
#: Most differing bits of the fingerprints of a pair that is compared.
FAR = 28
#: Bits of the filter of the sets that are wanted.
FILTER_BITS = 25


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, stops[:-1] + 1]
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    at = zip(starts[:n].tolist(), stops[min(SHINGLE, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter([digest(joined[s:e], SEED) for s, e in at], np.uint64, n))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: a bit is set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[i : i + 255 * 64].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def parity(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of hashes in 2^k classes of low bits, at least 64 and as many as hashes."""
    n = max(64, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def least_differences(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of sketches the classes whose parities differ, the longer folded to the shorter.

    Two sets differ in this many hashes at least. Sketches of alike sets are equally long, or one
    is twice as long; of one longer still the first part stands for the whole, and counts as zero.
    """
    length = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    start, words = np.cumsum(length) - length, np.frombuffer(b"".join(sketches), np.uint64)
    swap = length[i] > length[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out, left = np.zeros(len(i), np.int64), np.flatnonzero(length[j] <= 2 * length[i])
    k = 0
    while len(left):
        a, b = i[left], j[left]
        x, fold = words[start[a] + k] ^ words[start[b] + k], length[b] > length[a]
        x[fold] ^= words[start[b[fold]] + length[a[fold]] + k]
        out[left] += np.bitwise_count(x)
        k += 1
        left = left[length[i[left]] > k]
    return out


def set_id(hashes: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def alike(shared, a, b):
    """Jaccard similarity of at least 4/5, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def text_hash(text_col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _frequent(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in three or more documents of the sample, sorted, and their counts."""
    ids = bounded_ids(source.select("doc_id"), "doc_id", SAMPLE).distinct()
    sample = source.join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def each(batches):
        for part in pieces(batches, "text"):
            made = [shingles(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], names=["h"])

    counted = sample.mapInArrow(each, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = counted["h"].to_numpy().view(np.uint64), counted["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles a set is written under, rarest first."""
    known, counts = frequent
    count = np.zeros(len(hashes), np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[i] == hashes, counts[i], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, count))[: n - (4 * n + 4) // 5 + 1]] if n else hashes


def _possible(size, pos, fp, i, j):
    """Whether rows i and j can be alike if this is the first shingle they share."""
    a, b = size[i], size[j]
    near = np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)) <= FAR
    return near & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & alike(1 + np.minimum(a - 1 - pos[i], b - 1 - pos[j]), a, b)


def _runs(batches):
    """Arrow batches sorted by their first column, as numpy columns that hold whole groups."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
        if not len(rest[0]):
            continue
        whole = int(np.searchsorted(rest[0], rest[0][-1]))
        if whole:
            yield [c[:whole] for c in rest]
            rest = [c[whole:] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


def _pairs(node, i, j):
    u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return np.unique(np.stack([u, v], axis=1), axis=0)


def _first_pairs(batches):
    """Pairs (u, v) of small groups and of neighbours; rows of large groups as (key, u, place, fp)."""
    names = ["key", "u", "v", "place", "fp"]
    for key, fp, node, place in _runs(batches):
        first, sizes = _groups(key)
        large = np.repeat(sizes > SMALL, sizes)
        if large.any():  # neighbours in the order of the fingerprints, turned by some bits
            turn = (key % 64).astype(np.uint64)
            bits = fp.view(np.uint64)
            rank = np.where(large & (turn > 0), bits << turn | bits >> (np.uint64(64) - turn) % np.uint64(64), bits)
            order = np.lexsort((rank, key))
            key, fp, node, place = (x[order] for x in (key, fp, node, place))
        size, pos = place >> 32, place & 0xFFFFFFFF
        stop = np.repeat(first + np.where(sizes > SMALL, 0, sizes), sizes)
        stop[large] = len(key)
        i, d = np.arange(len(key)), 0
        while len(i):
            d += 1
            i = i[i + d < stop[i]]
            if d > NEAR:
                i = i[~large[i]]
            at = i[key[i] == key[i + d]]
            at = at[_possible(size, pos, fp, at, at + d)]
            if len(at):
                p = _pairs(node, at, at + d)
                none = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), none, none], names=names)
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.array(node[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(place[large]), pa.array(fp[large])], names=names)


def _later_pairs(batches):
    """Pairs of large groups whose components differ and whose sketches allow that they are alike."""
    for key, node, place, comp, fp, sketch in _runs(batches):
        size, pos = place >> 32, place & 0xFFFFFFFF
        for i, j in _gathered((i[ok], j[ok]) for i, j in _across(*_groups(key), comp) for ok in [_possible(size, pos, fp, i, j)]):
            _, once = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0, return_index=True)
            i, j = i[once], j[once]
            rows, at = np.unique(np.r_[i, j], return_inverse=True)
            ok = 9 * least_differences(sketch[rows].tolist(), at[: len(i)], at[len(i) :]) <= size[i] + size[j]
            if ok.any():
                p = _pairs(node, i[ok], j[ok])
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["u", "v"])


def _gathered(parts, least: int = 1 << 17):
    """The index pairs of parts, joined to arrays of about `least` or more."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _across(first, sizes, comp):
    """(i, j) of each group whose components differ: each row outside the largest with all others."""
    for f, n in zip(first.tolist(), sizes.tolist()):
        c = comp[f : f + n]
        values, counts = np.unique(c, return_counts=True)
        if len(values) == 1:
            continue
        for i in np.flatnonzero(c != values[np.argmax(counts)]).tolist():
            j = np.flatnonzero(c != c[i])
            yield np.full(len(j), f + i), f + j


def _sets(source: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in pairs, and a few others that a filter of fixed size lets through.

    Each node's set is made again from the text that its least text hash names.
    """
    wanted = nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    bit = F.pmod(F.col("text_hash"), F.lit(1 << FILTER_BITS))
    rows = wanted.groupBy(F.shiftright(bit, 15).alias("b")).agg(F.bitmap_construct_agg(F.pmod(F.col("text_hash"), F.lit(1 << 15))).alias("bits")).collect()
    bits = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for r in rows:
        bits[r["b"]] = np.frombuffer(r["bits"], np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches):
        on = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            for part in pieces([batch.filter(pa.array(on[at >> 3] >> (at & 7).astype(np.uint8) & 1, pa.uint8()).cast(pa.bool_()))], "text"):
                made = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in made], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["node", "hashes"])

    return source.select("text_hash", "text").mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(u, v, a, b): pairs with the values of (node, value) at both ends."""
    a, b = values.select(F.col("node").alias("u"), F.col("value").alias("a")), values.select(F.col("node").alias("v"), F.col("value").alias("b"))
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b")


def _possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs in different components (comp) whose parity sketches and sizes allow that they are alike."""

    def run(batches):
        for batch in batches:
            u, v, x, y = (batch.column(k) for k in range(4))
            n, sketches = np.arange(len(u)), x.field("parity").to_pylist() + y.field("parity").to_pylist()
            possible = 9 * least_differences(sketches, n, n + len(n)) <= x.field("size").to_numpy() + y.field("size").to_numpy()
            keep = pa.array(possible & (x.field("comp").to_numpy() != y.field("comp").to_numpy()))
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    return _both(pairs, nodes.select("node", F.struct("size", "parity", "comp").alias("value"))).mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sets are alike."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets(source, nodes, pairs)

    def run(batches):
        for batch in batches:
            u, v, x, y = (batch.column(k) for k in range(4))
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                keep.append(bool(alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    out = materialize(_both(pairs, sets.withColumnRenamed("hashes", "value")).mapInArrow(run, "u long, v long"), "links")
    discard(pairs)
    return out


def _equal_pairs(batches):
    """Pairs (u, v) of rows (fp, node), sorted by fp, that follow each other and have one fingerprint."""
    fp, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        fp, node = (np.r_[x[-1:], c.to_numpy()] for x, c in zip((fp, node), batch.columns))
        at = np.flatnonzero(fp[1:] == fp[:-1])
        if len(at):
            p = _pairs(node, at, at + 1)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["u", "v"])


def covered(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) by SimHash anchor covering: alike sets of which the fingerprints are equal or linked.

    The least node of a fingerprint stands in the links of different ones. A link whose sets are not
    alike is dropped; alike sets that this leaves apart are for the prefixes to find.
    """
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    ends = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")).hint("merge") for c in "uv"]
    near = simhash.links(firsts).distinct().join(ends[0], "u").join(ends[1], "v")
    near = near.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    equal = nodes.select("fp", "node", "size").repartition("fp").sortWithinPartitions("fp", "size", "node").select("fp", "node").mapInArrow(_equal_pairs, "u long, v long")
    out = _verified(_possible_pairs(near.unionByName(equal).distinct(), nodes.withColumn("comp", F.col("node"))), source, nodes)
    discard(firsts)
    return out


def _with_components(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes with the component (comp) that the links found give them, and the table of these."""
    roots = components(found)
    return rows.join(roots.hint("merge"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), roots


def links(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets that are alike; nodes: (node, size, fp, text_hash, prefix, parity)."""
    near = covered(source, nodes)
    apart, roots = _with_components(nodes, near)
    posted = nodes.select("node", "size", "fp", F.posexplode("prefix").alias("pos", "key"))
    dealt = posted.select("key", "fp", "node", F.expr("shiftleft(cast(size as bigint), 32) | pos").alias("place")).repartition("key").sortWithinPartitions("key")
    first = materialize(dealt.mapInArrow(_first_pairs, "key long, u long, v long, place long, fp long"), "pairs")
    found = near.unionByName(_verified(_possible_pairs(first.where("v is not null").select("u", "v").distinct(), apart), source, nodes))
    discard(roots)
    large = first.where("v is null").select("key", F.col("u").alias("node"), "place", "fp")
    if not large.isEmpty():
        rows, roots = _with_components(large, found)
        rows = rows.join(nodes.select("node", "parity").hint("merge"), "node")
        dealt = rows.repartition("key").sortWithinPartitions("key").select("key", "node", "place", "comp", "fp", "parity")
        found = found.unionByName(_verified(dealt.mapInArrow(_later_pairs, "u long, v long").distinct(), source, nodes))
        discard(roots)
    discard(first)
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) for each row of docs, and (node, least, root) for each node."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(source))

    def start():
        def run(texts):
            made = [shingles(t) for t in texts]
            return [[set_id(h) for h in made], [len(h) for h in made], [set_fingerprint(h) for h in made], [prefix(h, frequent.value).view(np.int64) for h in made], [parity(h) for h in made]]

        return run

    made = materialize(map_text(source, "text", [("node", "long"), ("size", "int"), ("fp", "long"), ("prefix", "array<long>"), ("parity", "binary")], start, ["doc_id", "text_hash"]), "made")
    nodes = materialize(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")), "nodes")
    marked = materialize(made.select("doc_id", "text_hash", "node"), "marked")
    discard(made)
    roots = components(links(source, nodes))
    each = materialize(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "classes")
    discard(nodes, roots)
    return marked, each


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, root), a row for each row of docs; equal roots mean one class."""
    marked, each = _classes(docs, id_col, text_col)
    return marked.join(each.select("node", "root"), "node").select("doc_id", "text_hash", "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id, root), a row for each row of docs.

    Equal roots mean one class. Ids that stand at several texts can give classes one component_id.
    """
    marked, each = _classes(docs, id_col, text_col)
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(each.select("node", "root").join(least, "root"), "node").select("doc_id", "text_hash", "component_id", "root")
