"""Operator 5: near-duplicate documents by MinHash bands and odd sketches.

A document's set holds its distinct 5-word shingles. Documents with equal sets form a class; only
classes are compared. 512 MinHash samples of a set are folded into a parity bitmap, its odd sketch; the
first 128 also form 32 bands of 4. Classes that share a band are candidates; the number of differing
bits of two odd sketches estimates their similarity, and pairs that differ in no more bits than the
threshold leads to, plus four standard deviations, are confirmed on the full sets. The bands miss a link
at the threshold with a chance of about 1e-10, the sketches with one of 3e-5, and closer links less.

A bucket of a band never emits all its pairs. First each member is compared with the bucket's least
member. What is linked is one component, so afterwards only members outside the bucket's then largest
component are compared with the others, sketch by sketch inside blocks of bounded size; each yields
its best candidates of other components first, in rounds of growing width, until none is left; a pair
counts in the first band that it shares only. That component is chosen once: whoever is still outside
it has looked in every round, from its first place on. Every
candidate pair whose ends are not connected yet is thus confirmed or refused on full sets.

Rows without words or text have an empty set and stay alone. Equal rows share a class. A null id takes
part but is never the smallest id of its component unless all are null. Repeated ids keep one row each.
Empty tables give empty results; other columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.graph import components
from sigfield.llm.words import U, mix, slabs, text_of, words_of
from sigfield.runtime import cut, ship

SAMPLES, BANDS, ROWS, BITS = 512, 32, 4, 2048
BLOCK = 2048  # members of a bucket that one block holds

_rng = np.random.default_rng(11)
_FACTOR = _rng.integers(1, 2**62, SAMPLES, dtype=np.int64).astype(U) * U(2) + U(1)
_SLOT = _rng.integers(1, 2**62, SAMPLES, dtype=np.int64).astype(U)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    w = words_of(texts, lower=True)
    h, at = w.windows(k)
    out = []
    for i in range(len(at) - 1):
        if at[i] < at[i + 1]:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        elif (n := w.first[i + 1] - w.first[i]) > 0:  # fewer words: the whole sequence
            acc = U(n)
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                acc = mix(np.array([acc ^ x], U))[0]
            out.append(np.array([acc], U))
        else:
            out.append(np.zeros(0, U))
    return out


def identity(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set: two sums of mixed hashes and its size."""
    a = mix(s).sum(dtype=U) + U(len(s))
    b = mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples; a large set is taken in pieces."""
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        part = (s[None, at : at + 4096] * _FACTOR[:, None]) >> U(32)
        np.minimum(best, part.min(1).astype(np.uint32), out=best)
    return best


def bands_of(best: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)
    for row in best[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        acc = mix(acc ^ row.astype(U))
    return acc.view(np.int64)


def odd_sketch(best: np.ndarray) -> bytes:
    """Parity of how many samples fall on each of BITS bits."""
    hit = np.bincount((mix(best.astype(U) + _SLOT) % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(hit.astype(np.uint8)).tobytes()


def most_bits(threshold: float, deviations: float = 4) -> int:
    """Differing sketch bits to allow for a similarity of at least ``threshold``: each of the 2k(1-J)
    unshared samples flips one, and two flips of one bit cancel."""
    flips = 2 * SAMPLES * (1 - threshold)
    spread = math.hypot(2 * math.sqrt(SAMPLES * threshold * (1 - threshold)), flips / math.sqrt(BITS))
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * flips / BITS)) + deviations * spread)


def _features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slabs(b):
                sets = shingle_sets(text_of(t), k)
                best = [samples(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        text_of(t, id_col),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([identity(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if x is None else bands_of(x) for x in best], pa.list_(pa.int64())),
                        pa.array([None if x is None else odd_sketch(x) for x in best], pa.binary()),
                    ],
                    [id_col, "n_shingles", "node", "bands", "sketch"],
                )

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    fields = [("n_shingles", T.LongType()), ("node", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    return kept.mapInArrow(run, T.StructType([kept.schema[0], *(T.StructField(*f) for f in fields)]))


def _sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles) of the classes in ``needed`` (node, first_id): of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slabs(b):
                sets = shingle_sets(text_of(t), k)
                same = pa.array([identity(s) == n if len(s) else False for s, n in zip(sets, t["node"].to_pylist())])
                out = pa.RecordBatch.from_arrays([text_of(t, "node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])
                yield out.filter(same)  # another row may have the same id

    texts = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(needed, texts.first_id.eqNullSafe(needed.first_id)).select("node", "text")
    sets = rows.mapInArrow(run, "node binary, shingles binary")
    return sets


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if den * min(len(p), len(q)) >= num * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good[i] = den * both >= num * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(good))

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int32)


def _near(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (u, v) whose odd sketches differ in at most ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), U).reshape(-1, BITS // 64) for c in (2, 3))
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(_popcount(x ^ y) <= most))

    left = classes.select(F.col("node").alias("u"), F.col("sketch").alias("a"))
    right = classes.select(F.col("node").alias("v"), F.col("sketch").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _mains(members: DataFrame) -> DataFrame:
    """(band, main, n) of the buckets of several components: a node of the largest one, and the bucket's size."""
    n_roots = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    of_band = n_roots.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"))
    return of_band.where("roots > 1").drop("roots")


def _rest(members: DataFrame, mains: DataFrame, classes: DataFrame, most: int, lo: int, hi: int, looking: DataFrame | None = None) -> DataFrame:
    """Candidates (u, v, more) of members outside their bucket's main component, or of those of them that
    are in ``looking`` (node) alone.

    ``members`` has band, node, root; ``mains`` has band, n and main, the root that the component chosen
    in the first round has now. Sketches and bands are fetched for buckets with members that look
    alone. Each of these is compared with all members in blocks; of the pairs near enough, those whose
    place among u's in the block, nearest first, is in [lo, hi) and whose roots differ come out. A row
    (u, u, true) tells that u has places beyond in this band, or in another one.
    """
    known = members.join(mains, "band").withColumn("left", F.col("root") != F.col("main"))
    if looking is not None:
        known = known.join(looking.withColumn("more", F.lit(True)), "node", "left").withColumn("left", F.col("left") & F.col("more").isNotNull()).drop("more")
    outside = known.where("left").groupBy("band").agg(F.count(F.lit(1)).alias("outside"))
    # 32 bits of a band tell whether two members share it
    short = F.transform("bands", lambda x: F.call_function("shiftright", x, F.lit(32)).cast("int")).alias("bands")
    wanted = known.join(outside, "band")
    if looking is not None:
        wanted = cut(wanted, "wanted")  # few rows are left, which need not meet all classes in a shuffle
    rows = wanted.join(classes.select("node", "sketch", short), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("outside") / BLOCK).cast("int"))
    pick = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    left = rows.where("left").withColumn("part", pick(1, "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.withColumn("block", pick(2, "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = left.withColumn("side", F.lit(0)).union(right.withColumn("side", F.lit(1)).select(*left.columns, "side"))
    dealt = dealt.select("band", "block", "part", "side", "node", "root", "sketch", "bands").repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "side", "node")

    def group(band: int, nodes: list, roots: list, sketches: np.ndarray, bands: np.ndarray, sides: np.ndarray) -> tuple[list, list, list]:
        u, v, more = [], [], []
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        other, theirs = sketches[right], bands[right]
        for i in left:
            bits = _popcount(other ^ sketches[i])
            near = np.flatnonzero(bits <= most)
            same = theirs[near] == bands[i]
            near = near[bands[i][same.argmax(1)] == band >> 32]  # else an earlier band has the pair
            near = near[np.argsort(bits[near], kind="stable")]
            beyond = len(near) > hi and any(roots[right[j]] != roots[i] for j in near[hi:])
            for j in near[lo:hi]:
                if roots[right[j]] != roots[i]:
                    a, b = sorted((nodes[i], nodes[right[j]]))
                    u.append(a)
                    v.append(b)
                    more.append(False)
            if beyond:
                u.append(nodes[i])
                v.append(nodes[i])
                more.append(True)
        return u, v, more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in _with_end(batches):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            t = t.combine_chunks()
            key = np.stack([t[c].to_numpy() for c in ("band", "block", "part")])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]])
            if b is not None:  # the last group may go on
                held, starts = t.slice(starts[-2]), starts[:-1]
            nodes, roots, sides = t["node"].to_pylist(), t["root"].to_pylist(), t["side"].to_numpy()
            sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), U).reshape(-1, BITS // 64)
            bands = text_of(t, "bands").flatten().to_numpy().reshape(-1, BANDS)
            out: tuple[list, list, list] = [], [], []
            for x, y in zip(starts, starts[1:]):
                for all_, new in zip(out, group(int(key[0, x]), nodes[x:y], roots[x:y], sketches[x:y], bands[x:y], sides[x:y])):
                    all_.extend(new)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], ["u", "v", "more"])

    return dealt.mapInArrow(run, "u binary, v binary, more boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    ship(docs.sparkSession)
    most = most_bits(num / den)
    features = cut(_features(docs, id_col, text_col, k), "features")
    alone = features.where("node is null")
    rows = features.where("node is not null")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "bands", "sketch"))
    classes = cut(rows.groupBy("node").agg(first.alias("x")).select("node", F.col("x.id").alias("first_id"), "x.bands", "x.sketch"), "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).where("n > 1").drop("n")
    members = cut(banded.join(buckets, "band"), "members")
    needed = members.select("node").distinct().join(classes.select("node", "first_id"), "node")
    sets = cut(_sets(docs, needed, id_col, text_col, k).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    pairs = members.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    roots = components(_confirm(_near(pairs, classes, most), sets, num, den))
    lo, hi, looking = 0, 8, None
    while True:
        roots = cut(roots, "roots")
        known = members.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = known.select("band", "node", "root")
        if lo == 0:
            mains = cut(_mains(known), "mains")
        now = mains.join(roots.withColumnsRenamed({"node": "main", "root": "now"}), "main", "left").select("band", F.coalesce("now", "main").alias("main"), "n")
        found = cut(_rest(known, now, classes, most, lo, hi, looking).groupBy("u", "v").agg(F.max("more").alias("more")), "rest")
        links = _confirm(found.where("u <> v").select("u", "v"), sets, num, den)
        to_root = roots.select(F.col("node"), F.col("root"))
        links = links.join(to_root.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(to_root.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left")
        merged = components(links.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        merged = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
        everyone = roots.union(merged.select(F.col("root").alias("node"), F.col("root")).join(roots.select("node"), "node", "left_anti"))
        roots = everyone.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        looking = found.where("more").select(F.col("u").alias("node")).distinct()
        if not looking.limit(1).count():
            break
        lo, hi = hi, hi * 8
    roots = cut(roots, "roots")
    place = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = place.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = place.join(best, "root").select("node", "component_id")
    joined = rows.join(of_node, "node").select(id_col, "n_shingles", "component_id")
    out = joined.union(alone.select(id_col, "n_shingles", F.col(id_col).alias("component_id")))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
