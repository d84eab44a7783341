"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over every document.

A window is `size` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Every document window is hashed
and looked up; a hit counts only if the words themselves agree. A word inside any occurrence is hit.

Scale: the text is tokenised and scanned once, where it lies. Windows around a word of the benchmark's anchors (the longest
word of each of its windows) are hashed, and dropped inside one stage by a hash join with the benchmark's windows, which Spark broadcasts if their counted number is
at most `BROADCAST_WINDOWS`; a larger benchmark is cut into that many parts, each broadcast in a scan of its own.
Only hits and one row for each document are shuffled, by a row number, so no passage or document can make a hot partition.

Defined results: null or empty text has no words and no hits; repeated rows are judged each; items with a null item_id
hit like any other and count as one item without an id (n_items holds it, items_sha256 does not); an empty
benchmark hits nothing; an empty table gives an empty result; further columns pass through `decontaminate`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_rows, split_words

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters of WORDS' complement, which stand between words.
BETWEEN = "".join(chr(c) for c in range(128) if not re.fullmatch(WORDS, chr(c).lower()))
SIZE = 10
#: Windows (some 200 bytes each in a hash table) up to which the benchmark is broadcast.
BROADCAST_WINDOWS = 250_000


def words(text: Column) -> Column:
    return split_words(text, BETWEEN, lower=True)


def _anchor(v: Column) -> Column:
    """The word of a window that stands for it in the first look: its longest, of these the greatest."""
    return F.array_max(F.transform(v, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(hash, length, window, anchor, item): the distinct windows of the benchmark."""
    w = F.col("w")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size(w) > 0)
    items = items.withColumn("length", F.least(F.size(w), F.lit(size)))
    out = items.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - F.col("length") + 1), lambda i: F.slice(w, i, F.col("length")))).alias("v"))
    return out.select(F.xxhash64("length", "v").alias("hash"), "length", F.concat_ws(" ", "v").alias("window"), _anchor(F.col("v")).alias("anchor"), "item").distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each document: row (its number in the scan), doc_id, n_words, hits array<struct<at, length, item>> by word position from 0."""
    known = materialise(benchmark_windows(benchmark, size=size), "decontam-windows")
    shape = known.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(set(shape["lengths"]) | {size}, reverse=True)  # `size` numbers at most
    parts = -(-shape["n"] // BROADCAST_WINDOWS) or 1
    # One scan counts rows itself; several must agree on the numbers, so these are written.
    docs, row = number_rows(docs.select(doc_id, text) if doc_id != text else docs.select(doc_id), "decontam-parts") if parts > 1 else (docs, None)
    hits = None
    for i in range(parts):
        part = known if parts == 1 else known.filter(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == i)
        anchors = [r[0] for r in part.select("anchor").distinct().collect()]  # no more than BROADCAST_WINDOWS words
        here = _scan(docs, part.drop("anchor"), anchors, doc_id, text, lengths, row)
        hits = here if hits is None else hits.union(here)
    return hits.groupBy("row", "doc_id", "n_words").agg(F.collect_list("h").alias("hits"))


def _scan(docs: DataFrame, known: DataFrame, anchors: list[str], doc_id: str, text: str, lengths: list[int], row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, h): a row for each hit, and one with null for each document. row is the column of that name, or the place in the scan.

    A window can only occur around its anchor, so only windows that hold a word of the anchor set are hashed.
    """
    w, none = F.col("w"), F.lit(None).cast("struct<at:int,length:int,hash:bigint>")
    base = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    marks = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(anchors), i))) if anchors else F.array().cast("array<int>")
    base = base.select("row", "doc_id", "w", F.size(w).alias("size"), marks.alias("marks"))

    def around(n: int) -> Column:
        first = lambda p: F.greatest(p - (n - 1), F.lit(0))
        last = lambda p: F.least(p, F.col("size") - n)
        return F.transform(
            F.array_distinct(F.flatten(F.transform("marks", lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))))),
            lambda i: F.struct(i.alias("at"), F.lit(n).alias("length"), F.xxhash64(F.lit(n), F.slice(w, i + 1, F.lit(n))).alias("hash")),
        )

    # One more entry, which fits no window, keeps every document in the result.
    tries = F.when(F.size("marks") > 0, F.concat(*[around(n) for n in lengths], F.array(none))).otherwise(F.array(none))
    base = base.select("row", "doc_id", "w", "size", tries.alias("tries"))
    each = base.select("row", "doc_id", "w", F.col("size").cast("long").alias("n_words"), F.explode("tries").alias("try"))
    each = each.select("*", F.col("try.hash").alias("hash"), F.col("try.length").alias("length"))
    hit = each.join(F.broadcast(known), ["hash", "length"], "left").filter(F.col("window").isNotNull() | F.col("try").isNull())
    same = F.concat_ws(" ", F.slice("w", F.col("try.at") + 1, F.col("length"))) == F.col("window")
    return hit.select("row", "doc_id", "n_words", F.when(same, F.struct("try.at", "length", "item")).alias("h"))


def covered(hits: Column) -> Column:
    """Words inside any of the hits: the union of [at, at + length)."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["at"].alias("a"), (h["at"] + h["length"]).alias("b")))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end"))
    return F.aggregate(spans, start, step)["n"].cast("long")


def score_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    found = find_windows(docs, benchmark, doc_id, text, size)
    out = found.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, remove: str = "documents", placeholder: str = " ") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with each hit run of words replaced.

    Rows go by their number: of rows that share a doc_id, or have none, only those that are hit go. Removing spans cuts from the first
    hit word of a run to its last, punctuation between them included; texts are otherwise unchanged.
    """
    numbered, row = number_rows(docs, "decontam-rows")
    if remove == "documents":
        bad = score_documents(numbered, benchmark, row, text, size).filter("contaminated").select(F.col("doc_id").alias(row))
        return numbered.join(materialise(bad, "decontam-bad"), row, "left_anti").drop(row)
    found = find_windows(numbered, benchmark, row, text, size).filter(F.size("hits") > 0)
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))))
    found = found.withColumn("at", hit_words)
    # For each word up to the last hit whether it is hit.
    gap = lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get("at", i - 1)) - 1
    flags = F.flatten(F.transform("at", lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))
    found = materialise(found.select(F.col("doc_id").alias("bad_id"), flags.alias("bad_words")), "decontam-spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    joined = numbered.select(F.col(row).alias("id"), F.col(text).alias("t"), whole)
    joined = joined.join(found, joined["id"] == found["bad_id"], "left")
    t = F.col("t")
    mark = F.concat(F.lit("\x01"), F.md5(t.cast("binary")), F.lit("\x02"))
    joined = joined.withColumn("pieces", F.when(F.col("bad_words").isNotNull(), F.split(F.regexp_replace(t, F.lit(_any_case()), F.concat(mark, F.lit("$0"), mark)), mark, -1)))
    hit = lambda i: F.coalesce(F.get("bad_words", i), F.lit(False))
    odd, word = (lambda i: i % 2 == 1), (lambda i: F.floor(i / 2).cast("int"))
    # Pieces at odd places are words, those at even places what stands before the next word.
    cut_word = lambda i: F.when(hit(word(i) - 1), F.lit("")).otherwise(F.lit(placeholder))
    piece = lambda x, i: F.when(odd(i), F.when(hit(word(i)), cut_word(i)).otherwise(x)).otherwise(F.when(hit(word(i) - 1) & hit(word(i)), F.lit("")).otherwise(x))
    cut = F.array_join(F.transform("pieces", piece), "")
    return joined.select(*[F.when(F.col("bad_words").isNotNull(), cut).otherwise(t).alias(c) if c == text else F.col(f"whole.`{c}`") for c in docs.columns])


def _any_case() -> str:
    """A word before lower-casing: A-Z count as letters."""
    return WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM b),
g AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l WHERE len(w) >= n)),
h AS (SELECT rid, k, g.n, item_id FROM g JOIN b ON g.g = b.g AND g.n = b.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
