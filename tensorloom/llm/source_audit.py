"""Source divergence audit: how far the term distributions of the sources of a language lie apart, by a systolic tournament.

Each (lang, source) group is a smoothed distribution over the terms that at least MIN_DOCS documents of the language hold:
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), in integers. Two groups differ by the sum over all V terms of
floor((p - q)^2 / (p + q)), a whole number that both see alike; a term sets a group apart from its language by the same measure.

The groups of a language sit in seats of SEAT sources, and its terms fall into blocks of about BLOCK, so what one seat holds of one
block is bounded whatever the corpus. A seat's vectors stay in their partition, sorted there by round; the others' vectors, compressed,
visit it one after another in the rounds of a round-robin tournament (circle method), so that any two seats meet once in each block, at
one of the two, where both directions are evaluated. Only one visitor is opened at a time, out of Arrow batches that Spark bounds
(64 MB by default). Sums over blocks are then added up.
Heaps over a seat's own block rank its terms, and the blocks' best are ranked again.

Scale: texts are read once, and a task counts terms in dictionaries of FLUSH entries at most before anything is shuffled. No join has a
key of more than one block's terms or one language's sources. The pairs of sources of a language are the result itself, so their number is
quadratic by contract; a language's sources are numbered, and a source's pairs ranked, within one task.

Defined results: null text, lang and source are ''; repeated rows count as documents of their own, whatever their doc_id; a group without
kept terms has the count 0 for each of them; a language without kept terms has pairs of value 0 and no terms; a group alone in its language
has no pairs; ties go by the UTF-8 order of the item; an empty table gives an empty result; further columns are ignored. Counts are exact up
to 9 * 10^15 terms of a language.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Sources in a seat, terms in a block (about), and entries that a task's dictionaries hold before they are sent on.
SEAT, BLOCK, FLUSH = 16, 16_384, 400_000
#: Bytes of a text: A-Z lower-cased, a-z and all of non-ASCII characters kept, the rest between terms.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df) over all rows of docs (lang, source, text); the term '' stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (tf, df) in held.items():
                words = [b"", *tf]
                cols = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([0, *tf.values()], pa.int64()), pa.array([0, *(df[w] for w in tf)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "tf", "df"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tf, df = held.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms(text), len(tf)
                tf.update(words)
                df.update(set(words))
                size += len(tf) - before
                if size > FLUSH:
                    yield from rows()
                    size = 0
        yield from rows()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sent = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, tf long, df long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def scaled(count: np.ndarray, below) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / below), exact in 64 bits: three steps of long division in base 1000."""
    rest, out = np.asarray(count, np.int64) + 2, 0
    below = np.maximum(np.asarray(below, np.int64), 1)
    whole, rest = rest // below, rest % below
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // below, rest * 1000 % below
    return 1 + whole * SCALE + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // np.maximum(p + q, 1)


_BUNDLE = "lang string, block int, seat int, seats int, sources array<string>, zero array<long>, v long, ids binary, p binary, top array<struct<source:string,item:string,value:long>>"


def _build(least: int = TOP):
    """A grouped function: what one seat holds of one block, as a bundle, and the best terms of each of its sources there."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        member, known = col("member").astype(int), t.column("id").is_valid().to_numpy(zero_copy_only=False)
        k = int(member.max()) + 1
        names, n, v = t.column("source").to_pylist(), col("n"), int(t.column("v")[0].as_py())
        first = np.unique(member, return_index=True)[1]
        below = n[first] + 2 * v
        zero = scaled(np.zeros(k, np.int64), below)
        who = member[known]
        tf, ids = col("tf")[known].astype(np.int64), col("id")[known].astype(np.int64)
        p = scaled(tf, below[who])
        at, place = np.unique(ids, return_inverse=True)
        grid = np.repeat(zero[:, None], len(at), axis=1)
        grid[who, place] = p
        q = scaled(col("lang_tf")[known].astype(np.int64), int(t.column("lang_n")[0].as_py()) + 2 * v)
        value, words = gap(p, q), t.column("term").filter(pa.array(known)).cast(pa.binary()).to_pylist()
        top = []
        for m in range(k):
            own = np.flatnonzero((who == m) & (p > q))
            best = heapq.nsmallest(least, ((-int(value[i]), words[i]) for i in own))
            top += [{"source": names[first[m]], "item": w.decode(), "value": -x} for x, w in best]
        pack = lambda a, kind: zlib.compress(np.ascontiguousarray(a, kind).tobytes(), 1)
        row = {
            "lang": key[0].as_py(), "block": key[1].as_py(), "seat": key[2].as_py(), "seats": t.column("seats")[0].as_py(), "sources": [names[i] for i in first], "zero": zero.tolist(), "v": int(t.column("v_block")[0].as_py()),
            "ids": pack(np.diff(at, prepend=0), np.int32), "p": pack(grid, np.int32), "top": top,
        }
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))]
        return pa.Table.from_arrays([pa.array([x], kind) for x, kind in zip(row.values(), kinds, strict=True)], names=list(row))

    return build


class Vectors:
    """A bundle opened: the sources' p over the terms that any of them holds, and p of all other terms of the block."""

    def __init__(self, row: dict):
        self.sources, self.zero, self.v = row["sources"], np.array(row["zero"], np.int64), row["v"]
        self.ids = np.cumsum(np.frombuffer(zlib.decompress(row["ids"]), np.int32).astype(np.int64))
        self.p = np.frombuffer(zlib.decompress(row["p"]), np.int32).reshape(len(self.sources), len(self.ids)).astype(np.int64)

    def over(self, ids: np.ndarray) -> np.ndarray:
        out = np.repeat(self.zero[:, None], len(ids), axis=1)
        out[:, np.searchsorted(ids, self.ids)] = self.p
        return out


def meeting(a: Vectors, b: Vectors) -> np.ndarray:
    """The gaps between all sources of a and of b over the whole block."""
    ids = np.union1d(a.ids, b.ids)
    p, q = a.over(ids), b.over(ids)
    return np.stack([gap(x, q).sum(axis=1) for x in p]) + (a.v - len(ids)) * gap(a.zero[:, None], b.zero[None, :])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by host and round: a seat's own bundle (round -1), then its visitors, one after another."""
    host = None
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            peer = Vectors(row)
            if row["round"] < 0:
                host = peer
            between = meeting(host, peer)
            for x, a in enumerate(host.sources):
                for y, b in enumerate(peer.sources):
                    if row["round"] >= 0:
                        out += [(row["lang"], a, b, int(between[x, y])), (row["lang"], b, a, int(between[x, y]))]
                    elif x != y:
                        out.append((row["lang"], a, b, int(between[x, y])))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])


def _visits(seat: Column, seats: Column) -> Column:
    """array<struct<round, host>>: the rounds in which a seat visits another. In the other rounds it is visited, or has no peer."""
    odd = seats + seats % 2 - 1  # rounds; the last seat of an even number stays put, the others turn

    def at(r: Column) -> Column:
        across = F.pmod(r - seat, odd)
        peer = F.when(seat == odd, F.pmod(r * F.floor((odd + 1) / 2), odd)).when(across == seat, odd).otherwise(across).cast("int")
        host = F.when((seat + peer) % 2 == 0, F.least(seat, peer)).otherwise(F.greatest(seat, peer))
        return F.when((peer < seats) & (host == peer), F.struct(r.alias("round"), peer.alias("host")))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(odd - 1, F.lit(0))), at))


def seat_bundles(docs: DataFrame, min_docs: int = MIN_DOCS, seat: int = SEAT, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """A row for each seat and block of a language: its sources' vectors, packed, and their best terms there."""
    counts = materialise(term_counts(docs), "audit-counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("df").alias("docs"), F.sum("tf").alias("lang_tf")).filter(F.col("docs") >= min_docs).drop("docs")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_tf").alias("lang_n"))
    blocks = F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / block), F.lit(1)).cast("int")
    sizes = materialise(counts.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), blocks.alias("blocks")), "audit-sizes")
    own = Window.partitionBy("lang", "block")
    placed = kept.join(sizes.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    placed = placed.select("lang", "term", "lang_tf", "block", (F.row_number().over(own.orderBy("term")) - 1).alias("id"))
    entries = materialise(words.drop("df").join(placed, ["lang", "term"]), "audit-entries")
    # Each group in each block of its language, terms or not; a key of the join with the entries has no more of them than a block has terms.
    totals = entries.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("no", number).withColumn("seats", F.ceil(F.count("*").over(Window.partitionBy("lang")) / seat).cast("int"))
    groups = groups.join(sizes, "lang").select("lang", "source", "n", "v", "lang_n", "seats", F.floor(F.col("no") / seat).cast("int").alias("seat"), (F.col("no") % seat).alias("member"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    in_block = entries.select("lang", "block", "id").groupBy("lang", "block").agg((F.max("id") + 1).cast("long").alias("v_block"))
    groups = groups.join(in_block, ["lang", "block"], "left").withColumn("v_block", F.coalesce("v_block", F.lit(0).cast("long")))
    return materialise(groups.join(entries, ["lang", "source", "block"], "left").groupBy("lang", "block", "seat").applyInArrow(_build(top), _BUNDLE), "audit-bundles")


def divergence(bundles: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    vectors = ["sources", "zero", "v", "ids", "p"]
    resident = bundles.select("lang", "block", "seat", F.lit(-1).alias("round"), *vectors)
    visit = bundles.filter("seats > 1").withColumn("visit", F.explode(_visits(F.col("seat"), F.col("seats"))))
    visit = visit.select("lang", "block", F.col("visit.host").alias("seat"), F.col("visit.round").alias("round"), *vectors)
    seated = resident.union(visit).repartition("lang", "block", "seat").sortWithinPartitions("lang", "block", "seat", "round")
    met = seated.mapInArrow(_meet, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, seat: int = SEAT, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. docs: lang, source, text."""
    bundles = seat_bundles(docs, min_docs, seat, block, top)
    found = bundles.select("lang", F.explode("top").alias("t")).select("lang", "t.source", F.lit("term").alias("part"), "t.item", "t.value")
    both = divergence(bundles).select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(found)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, (1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER s + 2 * count(*) OVER s)) AS p FROM a WINDOW s AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER s + 2 * count(*) OVER s)) AS q FROM k WINDOW s AS (PARTITION BY lang)),
f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(z.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) z
  ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f) WHERE part = 'pair' OR rank <= 10
"""
