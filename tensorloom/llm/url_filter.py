"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Each URL is expanded into host-suffix x path-prefix expressions, the expressions are joined to the rules
on the first digits of their SHA-256, and a hit counts only if the whole digest agrees. Of the rules that fit,
the longest (host and path together, then host) wins; of equal rules "block" wins.

Only suffixes with as many labels, and prefixes with as many characters, as some rule has are made, so
the expansion is bounded by the rules and not by the URL. Up to `BROADCAST_RULES` counted rules of at most `SHAPES` such shapes are broadcast and
met in the URL's own row, a join for each shape, so that no URL is shuffled. More rules or shapes are met by distinct (host, path), each expanded once.

Defined results: null url or none with "://": host and path empty, which no rule fits; repeated page rows are
judged each; an empty table gives an empty result; further columns pass through. The verdict without a
rule is `default`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PREFIX_DIGITS = 8
#: Rules (some 200 bytes each) up to which they are broadcast, and shapes up to which each has a join.
BROADCAST_RULES, SHAPES = 100_000, 32


def url_parts(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.coalesce(ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rules_frame(spark, rules=RULES) -> DataFrame:
    """Rules as a table: verdict, host, path."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, or null) and verdict."""
    known = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    known = known.filter(F.col("r_host") != "")
    known = known.withColumn("r_rule", F.concat("r_host", "r_path")).groupBy("r_host", "r_path", "r_rule").agg(F.max("r_verdict").alias("r_verdict"))
    known = known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, PREFIX_DIGITS))
    known = materialise(known.withColumn("r_labels", F.size(F.split("r_host", r"\."))).withColumn("r_length", F.length("r_path")), "url-known")
    n = known.count()
    shapes = [tuple(r) for r in known.select("r_labels", "r_length").distinct().limit(SHAPES + 1).collect()]
    host, path = url_parts(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if n <= BROADCAST_RULES and len(shapes) <= SHAPES:
        out = _in_row(base, known, sorted(shapes))
    else:
        out = _by_pair(base, known, pages.select(host.alias("host"), path.alias("path")).distinct())
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _expression(labels: int, length: int) -> tuple[Column, Column, Column]:
    """Whether a URL has so many labels and characters, and the host suffix and path prefix."""
    fits = (F.col("host") != "") & (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= length)
    return fits, F.substring_index("host", ".", -labels), F.substring("path", 1, length)


def _best(n: Column, m: Column, v: Column, rule: Column) -> Column:
    """What the greatest of is the rule that decides: the longest, then of the longest host, then block."""
    return F.struct(n.alias("n"), m.alias("m"), v.alias("v"), rule.alias("rule"))


def _in_row(base: DataFrame, known: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Each URL meets the broadcast rules of each shape on the short hash alone: all rules that share it, which the whole digest then confirms or not.

    The rules of one short hash are gathered, so that a URL stays one row; there are as many of them as short hashes collide.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("whole")
    out, hits = base.select(whole, "host", "path"), []
    for i, (labels, length) in enumerate(shapes):
        fits, h, p = _expression(labels, length)
        out = out.withColumn(f"d{i}", F.when(fits, _digest(h, p))).withColumn(f"s{i}", F.substring(f"d{i}", 1, PREFIX_DIGITS))
        own = known.filter((F.col("r_labels") == labels) & (F.col("r_length") == length))
        rule = F.struct(F.col("r_digest").alias("digest"), _best(F.length("r_rule"), F.length("r_host"), F.col("r_verdict"), F.col("r_rule")).alias("best"))
        own = own.groupBy(F.col("r_short").alias("k_short")).agg(F.collect_list(rule).alias(f"rules{i}"))
        out = out.join(F.broadcast(own), F.col(f"s{i}") == F.col("k_short"), "left").drop("k_short", f"s{i}")
        hits.append(F.get(F.filter(f"rules{i}", _confirmed(i)), F.lit(0))["best"])
    best = F.array_max(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("struct<n:int,m:int,v:string,rule:string>")
    return out.withColumn("best", best).select("whole.*", F.col("best.rule").alias("rule"), F.col("best.v").alias("verdict"))


def _confirmed(i: int):
    return lambda x: x["digest"] == F.col(f"d{i}")


def _by_pair(base: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each distinct (host, path) is expanded once, by the label counts and path lengths of the rules, and met in a shuffled join."""
    shape = known.agg(F.collect_set("r_labels").alias("labels"), F.collect_set("r_length").alias("lengths")).first()
    tries = [F.when(fits, F.struct(h.alias("h"), p.alias("p"))) for n in shape["labels"] for k in shape["lengths"] for fits, h, p in [_expression(n, k)]]
    hits = pairs.select("host", "path", F.explode(F.array_compact(F.array(*tries))).alias("e")).select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
    hits = hits.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    rules = known.groupBy("r_short").agg(F.collect_list(F.struct("r_digest", "r_rule", "r_host", "r_verdict")).alias("rules"))  # as many as short hashes collide
    hits = hits.join(rules, F.col("short") == F.col("r_short")).select("host", "path", "digest", F.explode("rules").alias("r")).select("host", "path", "digest", "r.*").filter(F.col("digest") == F.col("r_digest"))
    best = hits.groupBy("host", "path").agg(F.max(_best(F.length("r_rule"), F.length("r_host"), F.col("r_verdict"), F.col("r_rule"))).alias("e"))
    # Written first, so that both sides of the join are dealt anew and a hot pair can be split.
    best = materialise(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("e.rule").alias("rule"), F.col("e.v").alias("verdict")), "url-rules")
    out = base.join(best, (base["host"] == best["b_host"]) & (base["path"] == best["b_path"]), "left")
    return out.select(*[base[c] for c in base.columns], best["rule"], best["verdict"])


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS a FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(v, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
n AS (SELECT *, row_number() OVER () AS rn FROM h),
m AS (
  SELECT n.rn, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM n JOIN r ON (n.host = rh OR suffix(n.host, '.' || rh)) AND starts_with(n.path, rp) GROUP BY n.rn)
SELECT n.page_id, n.host, n.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM n LEFT JOIN m USING (rn)
"""
