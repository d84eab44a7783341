"""SimHash near-duplicates: 64-bit fingerprints, exact links within a Hamming radius, connected components.

Method: distinct fingerprints are compared in tiles by numpy exclusive-or and bit counts; fingerprints of a
group are sorted by population count, so that tile pairs whose counts differ by more than the radius are skipped.

Scale: not all tiles meet. The 64 bits are cut into blocks such that two fingerprints within the radius must
agree on at least `agree` whole blocks (pigeonhole); tiles are made within groups of equal blocks, which loses no
link. `agree` rises with the number of distinct fingerprints, so that groups stay small. A group beyond `TILE` fingerprints
(near copies) is dealt into tiles whose pairs are separate tasks, and each task returns a spanning forest of its
links, not the links: a hot block of n fingerprints makes some n^2 / 1,024 dealt rows, as its tiles must all meet. Components are found by contraction in rounds of joins; nothing is collected.

Defined results: null or empty text has fingerprint zero and is linked like any other; repeated rows give equal rows;
a null doc_id belongs to its fingerprint's component, which takes the smallest other id; an empty table gives an empty
result; further columns pass through `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_rows

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints in a tile; a group's tile pairs hold twice as many.
TILE, SUBTILE = 1024, 256
#: Distinct fingerprints up to which 1, 2, 3 blocks must agree: groups of some 200 if bits are even.
AGREE = ((1 << 21, 1), (1 << 29, 2), (1 << 62, 3))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_(b" ".join(words), seed)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    h = np.fromiter((hash_(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return kept.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def blocks(radius: int, agree: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit ranges, and the sets of ranges of which at least one agrees between any two fingerprints within the radius."""
    n = radius + agree
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:])), list(combinations(range(n), agree))


def _key(fp, ranges, chosen):
    mask = 0
    for i in chosen:
        a, b = ranges[i]
        mask |= ((1 << (b - a)) - 1) << a
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def forest(a: np.ndarray, side: np.ndarray, same_tile: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links among fingerprints a; between two tiles only links across them."""
    pop = np.bitwise_count(a)
    order = np.argsort(pop, kind="stable")
    a, pop, side = a[order], pop[order].astype(np.int16), side[order]
    root, left, right = np.arange(len(a)), [], []
    for i in range(0, len(a), SUBTILE):
        for j in range(i, len(a), SUBTILE):
            if pop[j] - pop[min(i + SUBTILE, len(a)) - 1] > radius:
                break
            near = np.bitwise_count(a[i : i + SUBTILE, None] ^ a[None, j : j + SUBTILE]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            ok = x < y
            if not same_tile:
                ok &= side[x] != side[y]
            left.append(x[ok])
            right.append(y[ok])
    if not left:
        return a[:0], a[:0]
    x, y = np.concatenate(left), np.concatenate(right)
    while True:
        old = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == old).all():
            break
    moved = root != np.arange(len(a))
    return a[moved], a[root[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): spanning links among distinct fingerprints (column fp) within the radius; a < b as signed numbers."""
    spark, n = fps.sparkSession, fps.count()
    agree = next(k for most, k in AGREE if n <= most)
    ranges, sets = blocks(radius, agree)
    fp = F.col("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*[_key(fp, ranges, c) for c in sets])).alias("band", "key"))
    # Fingerprints of one group in numbers; only groups beyond a tile are kept, at most rows / TILE of them.
    large = materialise(keyed.groupBy("band", "key").count().filter(F.col("count") > TILE), "simhash-large")
    keyed = keyed.join(large, ["band", "key"], "left")
    tiles = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    keyed = keyed.withColumn("tiles", tiles).withColumn("own", own)
    dealt = keyed.select("band", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("upper"), "fp")
    group = ["band", "key", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray, cuts: np.ndarray):
            out_a, out_b = [], []
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    g = rows[s:e]
                    x, y = forest(g[:, 5].view(np.uint64), g[:, 4], bool(g[0, 2] == g[0, 3]), radius)
                    out_a.append(x.view(np.int64))
                    out_b.append(y.view(np.int64))
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("band", "key", "i", "j", "upper", "fp")], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            held = [rows[last:]]  # the open group: two tiles at most
            if last:
                yield compare(rows, np.concatenate([[0], cuts]))
        if held:
            yield compare(held[0], np.array([0, len(held[0])]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root: the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers, and contracts the edges; rounds grow with
    the logarithm of a component's size. Every round is written to the shared folder.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        for _ in range(2):
            hook = materialise(hook, "cc-hook")
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("v", F.col("q").alias("p"))
        hook = materialise(hook, "cc-hook")
        if found is None:
            found = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            found = materialise(found.join(hook.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-found")
        moved = edges.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = materialise(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct(), "cc-edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _lowest(each: DataFrame, of: Column, radius: int) -> DataFrame:
    """(fp, best): for each distinct fingerprint the smallest value of `of` in its component."""
    fps = materialise(each.groupBy("fp").agg(F.min(of).alias("low")), "simhash-fps")
    roots = components(links(fps.select("fp"), radius))
    lows = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = materialise(lows, "simhash-roots")
    best = materialise(lows.groupBy("root").agg(F.min("low").alias("best")), "simhash-best")
    return materialise(lows.join(best, "root").select("fp", "best"), "simhash-of")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; component_id: the smallest doc_id reachable over links."""
    each = materialise(fingerprints(docs, doc_id, text, shingle, seed), "simhash-docs")
    of = _lowest(each, F.col("doc_id"), radius).withColumnRenamed("best", "component_id")
    return each.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with exactly one row of each component: the one with the smallest doc_id, null after all others.

    Of rows of a component that share this id, the one with the smallest fingerprint and then the first stays. Rows go by their number, so
    that rows of other components with the same doc_id, or with none, are left alone.
    """
    numbered, row = number_rows(docs, "simhash-rows")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    each = fingerprints(numbered.select(key.alias("key"), F.col(text).alias("text")), "key", "text", shingle, seed)
    each = materialise(each.select("doc_id.none", "doc_id.id", "doc_id.row", "fp"), "simhash-docs")
    of = _lowest(each, F.struct("none", "id", "fp", "row"), radius)
    drop = each.join(of, "fp").filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    return numbered.join(materialise(drop, "simhash-drop"), row, "left_anti").drop(row)
