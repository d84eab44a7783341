"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Spans of the base patterns (`BASE`) are always kept. Looser patterns propose more candidates: disguised addresses, IPv6, card numbers that stand
beside other digits (a date, a security code) and hold their check digit, national and 00- telephone numbers. On every candidate four labelers
vote yes, no or nothing: pattern (the base rule holds), gazetteer (top-level domains, address ranges, issuer prefixes with their lengths, calling and area codes), context
(words nearby, in English, German, French and Spanish) and edges (what touches the span). Expectation-maximisation over the vote patterns of the whole corpus
estimates each labeler's reliability for each kind (naive Bayes with a latent truth); a logistic span classifier is then trained on the
posteriors, with the votes and features of the span itself (`SHAPE`), and admits candidates that the base rules miss.

Scale: texts are read once and nothing is shuffled but counts of vote patterns, at most 4 x 3^7 rows, which is also all that the
driver sees. Candidates that touch base spans are found by sorting, not pair by pair. Decisions are made in each row from its written candidates.

What is bounded: features of a span read its first 64 characters, and the context up to 48 on either side.

Defined results: null counts as an empty text, without spans; repeated rows are judged each; an empty table gives an empty
result and a classifier that admits nothing; further columns pass through `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_matches, without_spans

KINDS = ("email", "ip", "card", "phone")
#: Fixed values. Possessive quantifiers and \G change no match; they only keep the engine from trying a run again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\((?:at|arroba|arobase|ät)\)|\[(?:at|arroba|arobase|ät)\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\((?:dot|punkt|point|punto)\)|\[(?:dot|punkt|point|punto)\])\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9-])",
    "phone": r"(?<![0-9+.)(-])(?:\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20./-]?[0-9]{2,4}){3,5}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[1-9][0-9]{1,4}[/-][0-9]{5,8}|[679][0-9]{2}(?:[\x20.-][0-9]{3}){2})(?![0-9-])",
}
#: Words that speak for or against a kind, in English, German, French and Spanish.
FOR = {
    "email": "e-?mail|mail|contact|write|reach|address|kontakt|schreib|adresse|courriel|écri|contacte|correo|escrib|dirección",
    "ip": "ip|ipv6|host|server|client|login|address|gateway|peer|rechner|anmeld|adresse|serveur|connexion|servidor|conexión|dirección",
    "card": "card|visa|mastercard|amex|credit|payment|debit|karte|kredit|zahlung|carte|crédit|paiement|tarjeta|crédito|pago",
    "phone": "phone|call|tel|mobile|cell|fax|whatsapp|contact|telefon|anruf|handy|ruf|téléphon|appel|portable|teléfono|llam|móvil",
}
AGAINST = {
    "email": "git|clone|ssh|npm|scp|rsync",
    "ip": "version|release|chapter|section|kapitel|abschnitt|chapitre|capítulo|sección|mac|time|zeit|heure|hora",
    "card": "isbn|order|serial|tracking|invoice|bestell|rechnung|auftrag|commande|facture|pedido|factura|id|sha|hash",
    "phone": "isbn|order|serial|part|page|seite|bestell|commande|página|pedido|date|datum|fecha",
}
#: Top-level domains; calling codes of countries; issuer prefixes with their lengths.
TAILS = "com|net|org|edu|gov|mil|int|io|info|biz|name|app|dev|me|tv|co|ai|eu|de|fr|es|uk|us|ca|au|nz|at|ch|be|nl|lu|it|pt|ie|dk|se|no|fi|is|pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|by|lt|lv|ee|hr|si|rs|mx|ar|br|cl|pe|uy|ve|ec|bo|py|cr|pa|gt|do|cu|pr|jp|cn|hk|tw|kr|in|pk|bd|lk|np|th|vn|my|sg|id|ph|il|sa|ae|qa|kw|ir|iq|eg|ma|dz|tn|ng|gh|ke|tz|ug|za|cm|sn|ci"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|21[1-8]|2[2-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-8]|97[0-9]|99[0-8]"
ISSUERS = "4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12,15}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17}|(?:5018|5020|5038|6304|6759|676[1-3])[0-9]{8,15}"
RESERVED = r"(?:0|127|2(?:2[4-9]|[3-5][0-9]))\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.|::1$|[fF][eE]80:"
VOTES, SHAPE, ROUNDS = ("pattern", "gazetteer", "context", "edges"), ("length", "variety", "grouping"), 30


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _base_rule(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern stands."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(F.length(F.ltrim(x, F.lit("0"))) <= 3, F.lit(False)) & (F.lpad(F.right(x, F.lit(3)), 3, "0") <= "255"))
    n = F.length(_digits(m))
    if kind == "card":
        return (n >= 13) & (n <= 19) & F.call_function("luhn_check", F.when(n <= 19, _digits(m)).otherwise(F.lit("1")))
    return (n >= 9) & (n <= 15)


def _votes(kind: str, x: Column, strict: Column) -> Column:
    near = F.lower(F.concat(F.lit(" "), x["before"], F.lit(" "), x["after"], F.lit(" ")))
    d = _digits(x["match"])
    gazetteer = {
        "email": F.when(F.lower(x["match"]).rlike(rf"(?:\.|(?:dot|punkt|point|punto)\W?\s?)(?:{TAILS})$"), 1).otherwise(-1),
        "ip": F.when(x["match"].rlike(rf"^(?:{RESERVED})"), -1).otherwise(1),
        "card": F.when(d.rlike(f"^(?:{ISSUERS})$"), 1).otherwise(-1),
        "phone": F.when(x["match"].rlike(rf"^(?:\+|00)(?:{CALLING})"), 1).when(x["match"].rlike(r"^(?:\+|00)"), -1).when(d.rlike("^(?:[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{7,11}|[679][0-9]{8})$"), 1).otherwise(-1),
    }[kind]
    context = F.when(near.rlike(rf"(?<![\p{{L}}])(?:{FOR[kind]})"), 1).when(near.rlike(rf"(?<![\p{{L}}])(?:{AGAINST[kind]})"), -1).otherwise(0)
    edges = F.when(F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9_]") | F.left(x["after"], F.lit(1)).rlike("[A-Za-z0-9_]"), -1).otherwise(1)
    return F.struct(F.when(strict, 1).otherwise(-1).alias("pattern"), gazetteer.alias("gazetteer"), context.alias("context"), edges.alias("edges"))


def _shape(kind: str, x: Column) -> Column:
    """Features of the span itself, each -1, 0 or 1: usual length, variety of its characters, even grouping."""
    m, d = x["match"], _digits(x["match"])
    n = F.length(d)
    usual = {"email": (F.length(m) >= 8) & (F.length(m) <= 64), "ip": (F.length(m) >= 7) & (F.length(m) <= 39), "card": n.isin(15, 16), "phone": (n >= 9) & (n <= 13)}[kind]
    kinds = F.size(F.array_distinct(F.split(F.when(F.lit(kind == "email"), F.left(m, F.lit(64))).otherwise(d), "")))
    marks = F.array_distinct(F.split(F.regexp_replace(m, r"[0-9A-Za-z@+()]", ""), ""))
    grouping = F.when(F.length(F.regexp_replace(m, r"[0-9A-Za-z]", "")) == 0, 0).when(F.size(marks) <= 1, 1).otherwise(-1)
    return F.struct(F.when(usual, 1).otherwise(-1).alias("length"), F.when(kinds >= 5, 1).when(kinds >= 3, 0).otherwise(-1).alias("variety"), grouping.alias("grouping"))


def _item(k: int, kind: str, loose: bool):
    def item(x: Column) -> Column:
        strict = F.lit(False) if loose and kind != "card" else _base_rule(kind, x["match"])
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(not loose) & strict).alias("base"), _votes(kind, x, strict).alias("v"), _shape(kind, x).alias("f"))

    return item


def _apart(loose: Column, base: Column) -> Column:
    """Those of `loose` that touch no span of `base`, whose spans are in order and apart.

    All ends of the one and starts of the other are sorted together; a place in that order tells how many base spans start before an end, and only the last of them can touch.
    """
    ends = F.transform(loose, lambda y: F.struct(y["end"].alias("at"), F.lit(0).alias("side"), y.alias("y")))
    starts = F.transform(base, lambda z: F.struct(z["start"].alias("at"), F.lit(1).alias("side"), z.alias("y")))
    placed = F.filter(F.transform(F.array_sort(F.concat(ends, starts)), lambda x, i: F.struct(x["side"].alias("side"), x["y"].alias("y"), i.alias("i"))), lambda x: x["side"] == 0)
    counted = F.transform(placed, lambda x, j: F.struct(x["y"].alias("y"), (x["i"] - j).alias("n")))
    free = F.filter(counted, lambda x: (x["n"] == 0) | (F.get(base, (x["n"] - 1).cast("int"))["end"] <= x["y"]["start"]))
    return F.transform(free, lambda x: x["y"])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `found`: array<struct<kind, start, end, base, v>> of base spans and other candidates, v their votes."""
    out = docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    t, parts = F.col("pii_text"), []
    digit = t.rlike("[0-9]")
    guards = {"email": t.contains("@"), "ip": digit & t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": t.contains("+")}
    more = {"email": t.contains("at)") | t.contains("at]"), "ip": t.contains(":") & digit, "card": digit, "phone": digit}
    for k, kind in enumerate(KINDS):
        for loose, pattern, guard in ((False, BASE[kind], guards[kind]), (True, LOOSE[kind], more[kind])):
            name = f"pii_{kind}_{int(loose)}"
            out = with_matches(out, "pii_text", pattern, name, guard)
            each = F.transform(name, _item(k, kind, loose))
            if loose:
                parts.append(F.filter(each, lambda y: y["v"]["pattern"] == 1) if kind == "card" else each)
            else:
                out = out.withColumn(f"pii_base_{kind}", F.filter(each, lambda y: y["base"]))
    # A looser candidate that touches a base span, of whatever kind, is no news. Each step is a column of its own.
    out = out.withColumn("pii_loose", F.concat(*parts))
    for kind in KINDS:
        out = out.withColumn("pii_loose", F.when((F.size("pii_loose") > 0) & (F.size(f"pii_base_{kind}") > 0), _apart(F.col("pii_loose"), F.col(f"pii_base_{kind}"))).otherwise(F.col("pii_loose")))
    out = out.withColumn("found", F.concat(*[F.col(f"pii_base_{kind}") for kind in KINDS], F.col("pii_loose")))
    return out.drop("pii_text", "pii_loose", *[f"pii_base_{kind}" for kind in KINDS], *[f"pii_{kind}_{i}" for kind in KINDS for i in (0, 1)])


def reliabilities(counts: dict[tuple, int]) -> tuple[float, list[dict]]:
    """EM on {votes: n} of one kind: the share that is true, and for each labeler P(vote | truth). Starts from the majority vote."""
    total = sum(counts.values())
    post = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in counts}
    share, tables = 0.5, []
    for _ in range(ROUNDS):
        share = (sum(post[v] * n for v, n in counts.items()) + 1) / (total + 2)
        tables = []
        for i in range(len(VOTES)):
            table = {}
            for y in (0, 1):
                weight = {a: 1.0 + 2.0 * (a == (1 if y else -1)) for a in (-1, 0, 1)}  # a labeler is taken to be better than chance
                for v, n in counts.items():
                    weight[v[i]] += n * (post[v] if y else 1 - post[v])
                s = sum(weight.values())
                table |= {(a, y): w / s for a, w in weight.items()}
            tables.append(table)
        for v in post:
            z = math.log(share / (1 - share)) + sum(math.log(tables[i][a, 1] / tables[i][a, 0]) for i, a in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return share, [tables, post]


def classifier(counts: dict[tuple, int], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights (bias, one for each vote and feature of the span), trained on the posteriors of the vote patterns; counts: {(*votes, *features): n}."""
    size = len(VOTES) + len(SHAPE)
    if not counts:
        return [-1.0] + [0.0] * size
    votes: dict[tuple, int] = {}
    for x, n in counts.items():
        votes[x[: len(VOTES)]] = votes.get(x[: len(VOTES)], 0) + n
    post = reliabilities(votes)[1][1]
    w, total = [0.0] * (1 + size), sum(counts.values())
    for _ in range(steps):
        grad = [1e-3 * x for x in w]
        for v, n in counts.items():
            x = (1, *v)
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, a in enumerate(x):
                grad[i] += n / total * (p - post[v[: len(VOTES)]]) * a
        w = [a - rate * b for a, b in zip(w, grad, strict=True)]
    return w


def fit(found: DataFrame) -> dict[int, list[float]]:
    """Weights for each kind, from a frame with `found`."""
    names = [f"x.v.{v}" for v in VOTES] + [f"x.f.{v}" for v in SHAPE]
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", *names).count().collect()  # 4 x 3^7 rows at most
    return {k: classifier({tuple(r[1 : 1 + len(names)]): r["count"] for r in rows if r["kind"] == k}) for k in range(len(KINDS))}


def admitted(model: dict[int, list[float]], threshold: float = 0.5) -> Column:
    """`found` less the candidates that neither a base rule nor the classifier admits; in the order of kind and start."""

    def keep(x):
        z = F.lit(None).cast("double")
        for k, w in model.items():
            own = F.lit(w[0])
            for (part, v), a in zip([("v", v) for v in VOTES] + [("f", v) for v in SHAPE], w[1:], strict=True):
                own = own + x[part][v] * F.lit(a)
            z = F.when(x["kind"] == k, own).otherwise(z)
        return x["base"] | (z > math.log(threshold / (1 - threshold)))

    return F.array_sort(F.filter("found", keep))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all) for every row of docs."""
    found = materialise(candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "found"), "pii-found")
    out = found.withColumn("spans", admitted(fit(found))).withColumn("bases", F.filter("spans", lambda x: x["base"]))
    of = lambda k: F.filter("bases", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("bases")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _of(k: int, base: bool):
    return lambda x: (x["kind"] == k) & (x["base"] == base)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of spans that overlap base ones come first, then the kind that is listed first."""
    model = fit(materialise(candidates(docs.select(F.col(text).alias("text"))).select("found"), "pii-found"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    out = candidates(docs.select(F.col(text).alias("t"), whole), "t").withColumn("pii_all", admitted(model))
    out = out.withColumn("pii_spans", F.array().cast(out.schema["pii_all"].dataType))
    for base in (True, False):
        for k in range(len(KINDS)):
            out = out.withColumn("pii_next", F.filter("pii_all", _of(k, base)))
            both = F.array_sort(F.concat("pii_spans", _apart(F.col("pii_next"), F.col("pii_spans"))), lambda a, b: a["start"] - b["start"])
            out = out.withColumn("pii_spans", F.when(F.size("pii_next") > 0, both).otherwise(F.col("pii_spans")))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    out = out.withColumn("pii_spans", F.transform("pii_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("label"))))
    out = without_spans(out, "t", "pii_spans")
    return out.select(*[F.col("t").alias(c) if c == text else F.col(f"whole.`{c}`") for c in docs.columns])
