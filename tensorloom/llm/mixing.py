"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document is first taken as many whole times as fit the
source's target; the rest of the target is filled by a Pareto order sample with unequal probabilities: a document of size class
k = floor(log2(size)) is included with probability p = min(1, a * 2^(k * `SIZE_POWER`)), a such that the expected words are those left;
documents are ranked by random odds divided by inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), and the lowest q are taken until
the words left are met. u is a hash of doc_id and text, so reruns agree whatever the partitioning.

Scale: the text is read once for its size and u, which are written beside the columns to keep; what is shuffled afterwards is one
number for each (source, size class) and (source, bin of q), so that a source with a third of all rows is a few thousand partial sums,
and one bin's units.

Defined results: a null or empty text has size 0, is never drawn extra and counts no words; a null source
is a source of its own, last; rows with the same doc_id, text and source are drawn together or not at all; an empty
table gives an empty result; further columns pass through `mix_documents` unless named like an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, word_count

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Exponent of a document's size class in its inclusion probability; bins of q for each doubling.
SIZE_POWER, BINS = 0.5, 32


def unit_random(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1) from 52 bits of md5(seed|doc_id|md5(text))."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), none(doc_id), F.lit("|"), F.md5(none(text).cast("binary"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def size_weight(size: Column) -> Column:
    """What an inclusion probability is proportional to; 0 for size 0."""
    return F.when(size > 0, F.pow(F.lit(2.0), F.lit(SIZE_POWER) * (F.length(F.bin(size)) - 1))).otherwise(F.lit(0.0))


def inclusion(weight: Column, a: Column) -> Column:
    return F.least(F.lit(1.0), a * weight)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> adds target: `share` of all words by weight, capped at `most` times the source.

    The fixed point of "cap, share the excess by weight, repeat" is a common water level: a source gets
    min(cap, level * weight). Sources are aggregates, so these windows see one row for each source.
    """
    cap, w = F.col("cap"), F.col("w")
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    before = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    filled = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fills", cap / w)
    level = (F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = filled.withColumn("at", level)
    top = F.max(F.when(F.col("at") <= F.col("fills"), F.col("at"))).over(all_)
    return levels.withColumn("target", F.least(cap, top * w)).select("source", "source_size", "target")


def draw(items: DataFrame, **kw) -> DataFrame:
    """items (source, u, size) -> for each source: source_size, target, copies (certain), a (of the probabilities), and where the drawn part ends (cut_bin, cut_q)."""
    most = kw.get("most", MOST)
    units = items.select("source", "u", "size", size_weight(F.col("size")).alias("weight"))
    classes = materialise(units.groupBy("source", "weight").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), **kw)
    size = F.col("source_size").cast("double")
    full = F.col("target") >= F.lit(float(most)) * size
    targets = (
        targets.withColumn("copies", F.when(full, F.lit(int(most))).otherwise(F.floor(F.col("target") / F.when(size > 0, size))).cast("int"))
        .withColumn("open", F.when(full, F.lit(0.0)).otherwise(F.col("target") - F.col("copies") * size))
    )
    # Probabilities that add up to the open words: the greatest level of all ways to hold the heaviest classes at 1.
    heavier = Window.partitionBy("source").orderBy(F.col("weight").desc())
    above = heavier.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(F.col("weight") * F.col("words")).over(heavier.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = _with(classes.filter("weight > 0"), targets.select("source", "open")).withColumn("at", (F.col("open") - F.coalesce(F.sum("words").over(above), F.lit(0))) / rest)
    levels = levels.groupBy("source").agg(F.greatest(F.max("at"), F.lit(0.0)).alias("a"))
    targets = materialise(_with(targets, levels, "left"), "mix-targets")
    drawn = _with(units, targets.select("source", "open", "a")).filter((F.col("open") > 0) & (F.col("size") > 0))
    drawn = drawn.withColumn("q", odds_ratio(F.col("u"), inclusion(F.col("weight"), F.col("a")))).withColumn("bin", q_bin(F.col("q")))
    bins = materialise(drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("open").alias("open")), "mix-bins")
    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = bins.withColumn("done", F.coalesce(F.sum("words").over(so_far), F.lit(0))).filter(F.col("done") <= F.col("open"))
    ends = materialise(ends.groupBy("source").agg(F.max("bin").alias("cut_bin"), F.max("done").alias("done")), "mix-ends")
    last = _with(drawn, ends).filter(F.col("bin") == F.col("cut_bin")).groupBy("source", "q", "open", "done").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("done") + F.sum("size").over(upto)
    cuts = last.withColumn("twice", reach + reach - F.col("size")).filter(F.col("twice") <= 2 * F.col("open")).groupBy("source").agg(F.max("q").alias("cut_q"))
    out = _with(_with(targets, ends.select("source", "cut_bin"), "left"), cuts, "left")
    return materialise(out.select("source", "source_size", "target", "copies", "open", "a", "cut_bin", "cut_q"), "mix-cuts")


def q_bin(q: Column) -> Column:
    """Bins of equal steps of log2 q, in its order; certain documents (q = 0) come first."""
    return F.when(q > 0, F.floor(F.log2(q) * BINS)).otherwise(F.lit(-(1 << 20))).cast("int")


def odds_ratio(u: Column, p: Column) -> Column:
    """The Pareto rank; None where p is 0."""
    return (u / (1 - u)) * ((1 - p) / F.when(p > 0, p))


def _with(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source, null being a source too. Both sides hold a row for each source or bin, or one is far smaller; Spark broadcasts by measured size."""
    b = b.withColumnRenamed("source", "source_b")
    return a.join(b, a["source"].eqNullSafe(b["source_b"]), how).drop("source_b")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, **kw) -> DataFrame:
    """docs (or its columns `keep`) with size, source_size, target, copies (how often the mix takes the document) and taken (its words)."""
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in keep or docs.columns if c not in added]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest")
    base = docs.select(rest, F.col(source).cast("string").alias("source"), unit_random(F.col(doc_id), F.col(text)).alias("u"), word_count(F.col(text)).alias("size"))
    base = materialise(base, "mix-items")
    cuts = draw(base.select("source", "u", "size"), **kw)
    out = _with(base, cuts, "left")
    q = odds_ratio(F.col("u"), inclusion(size_weight(F.col("size")), F.col("a")))
    drawn = (F.col("open") > 0) & ((q_bin(q) < F.col("cut_bin")) | ((q_bin(q) == F.col("cut_bin")) & (q <= F.col("cut_q"))))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.coalesce("copies", F.lit(0)) + F.coalesce(drawn, F.lit(False)).cast("int"))
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / w AS fills,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, cap, least(cap, max(CASE WHEN lv <= fills THEN lv END) OVER () * w) AS target FROM l),
c AS (
  SELECT *, CASE WHEN target >= cap THEN 2 ELSE floor(target / source_size) END AS copies FROM t),
p AS (SELECT *, CASE WHEN target >= cap THEN 0 ELSE target - copies * source_size END AS open FROM c),
x AS (SELECT *, CASE WHEN size > 0 THEN pow(2.0::DOUBLE, 0.5::DOUBLE * (length(bin(size)) - 1)) ELSE 0 END AS weight FROM d),
k AS (SELECT source, weight, sum(size)::DOUBLE AS words FROM x WHERE size > 0 GROUP BY source, weight),
v AS (
  SELECT k.source, (open - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight * words) OVER (PARTITION BY k.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
a AS (SELECT source, greatest(max(lv), 0) AS a FROM v GROUP BY source),
q AS (
  SELECT x.*, p.source_size, p.target, p.copies, p.open,
         CASE WHEN p.open > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - least(1.0::DOUBLE, a.a * weight)) / least(1.0::DOUBLE, a.a * weight)) END AS q
  FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN a ON x.source IS NOT DISTINCT FROM a.source),
g AS (SELECT source, q, sum(size) AS words FROM q WHERE q IS NOT NULL GROUP BY source, q),
r AS (SELECT source, q, 2 * sum(words) OVER (PARTITION BY source ORDER BY q) - words AS twice FROM g)
SELECT q.doc_id, q.size, q.source_size, q.target,
       (CASE WHEN q.size = 0 THEN 0 ELSE q.size * (q.copies + CASE WHEN r.twice <= 2 * q.open THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM q LEFT JOIN r ON q.source IS NOT DISTINCT FROM r.source AND q.q = r.q
"""
