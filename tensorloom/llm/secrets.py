"""Secret scan: candidates of several forms, and a random forest that removes false positives.

Candidates: what follows a credential's name and an assignment sign (6 or more characters other than white space, quotes and angle brackets); signed
tokens of three dotted parts; private key blocks; the password of an address; and any run of 12 or more of `[A-Za-z0-9_+/-]` with a digit and a letter. The
forest sees a candidate's length, character transitions and classes, dictionary coverage, whether it stands in a path or address, and the neighbouring words (what
names it, assigns it, quotes it, or calls it an example). It is trained from labelled findings, `labelled_findings` unless others are given (columns text, label: the
first candidate of each text is the finding). The dictionary holds the `DICTIONARY` most frequent words of the whole corpus, beside a short fixed list.

Scale: the dictionary is a bounded top of word counts, pre-aggregated before they are shuffled; the forest is small and bounded (`TREES`, `DEPTH`) and learnt anew in each run
from `FINDINGS` findings. Both are applied as expressions in each row; candidates of a text never leave its row.

What is bounded: a forest's features read the first 100 characters of a candidate and up to 48 on either side of it. Candidates and names are found at any length; of
several names in a word the last counts, so that no word is read again for each of them.

Defined results: null or empty text has no candidates; repeated rows are judged each; an empty table gives an empty result; further columns
pass through `redact_secrets`.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, with_matches, without_spans

#: What credentials are called, what says that something is none, and heads of known keys.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api[_-]?key", "access[_-]?key", "private[_-]?key", "auth", "bearer", "credentials?")
HARMLESS = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "commit", "revision", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "version", "build", "order", "isbn")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xox", "sk_live_", "sk-", "glpat-", "AIza", "npm_", "SG[.]", "eyJ", "-----BEGIN")
WORDS = ("user", "name", "page", "item", "list", "data", "file", "image", "photo", "index", "home", "news", "post", "part", "chapter", "figure", "table", "model", "train", "test", "example", "version", "release", "report", "section", "product", "article", "build", "config", "server", "client", "class", "value", "string", "number", "module", "package", "update", "system", "service")
NAME = f"(?i:{'|'.join(NAMES)})"
NAMED = rf"{NAME}(?:(?!{NAME})[A-Za-z0-9_])*+[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"'`]?"
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
BLOCK = r"-----BEGIN (?:[A-Z]++ )*+KEY-----[^-]{16,}+-----END (?:[A-Z]++ )*+KEY-----"
IN_URL = r"://[^\s:/@]++:[^\s:/@]{3,}+@"
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2}"
CANDIDATE = rf"{NAMED}[^\s\"'`<>]{{6,}}+|{SIGNED}|{BLOCK}|{IN_URL}|{RUN}"
#: What stands before the candidate itself in a match, and what is cut off its end.
LEAD, CLOSE = rf"^(?:{NAMED}|://[^\s:/@]++:)", r"(?:[.,;:!?)\]}*%$&#]+|@)$"
TREES, DEPTH, SEED, THRESHOLD, FINDINGS, DICTIONARY = 25, 6, 7, 0.5, 4000, 2000
FEATURES = ("length", "digits", "uppers", "lowers", "others", "hex", "switches", "distinct", "dictionary", "path", "named", "assigned", "quoted", "harmless", "prefixed")


def _has(x: Column, words) -> Column:
    return x.rlike("(?:" + "|".join(words) + ")")


def common_words(docs: DataFrame, text: str = "text", n: int = DICTIONARY) -> list[str]:
    """The n most frequent words of 3 to 12 letters a-z in all texts; a bounded list, ties by the word."""
    words = docs.select(F.explode(F.split(F.translate(ascii_lower(F.col(text)), "\t\n\r\v\f.,;:!?()[]\"'", " " * 18), " +")).alias("w"))
    counts = words.filter(F.col("w").rlike("^[a-z]{3,12}$")).groupBy("w").count()
    return [r["w"] for r in counts.orderBy(F.col("count").desc(), "w").limit(n).collect()]


def candidate(x: Column) -> Column:
    """A match (start, end, match, before, after) less what stands before the candidate and what closes it; its lead joins `before`."""
    lead = F.regexp_extract(x["match"], LEAD, 0)
    rest = F.substr(x["match"], F.length(lead) + 1)
    own = F.regexp_replace(rest, CLOSE, "")
    start = x["start"] + F.length(lead)
    after = F.concat(F.substr(rest, F.length(own) + 1), x["after"])
    return F.struct(start.alias("start"), (start + F.length(own)).alias("end"), own.alias("match"), F.concat(x["before"], lead).alias("before"), after.alias("after"))


def features(x: Column, dictionary: list[str]) -> Column:
    """The features of a candidate (start, end, match, before, after), all numbers."""
    m, n = x["match"], F.greatest(F.length(x["match"]), F.lit(1)).cast("double")
    share = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", "")) / n
    low, name = F.lower(m), F.lower(F.right(x["before"], F.lit(32)))
    flag = lambda c: c.cast("double")
    parts = F.split(F.lower(F.regexp_replace(m, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.aggregate(parts, F.lit(0), lambda total, w: total + F.when(w.isin(dictionary), F.length(w)).otherwise(0))
    switches = (F.regexp_count(m, F.lit("[0-9](?=[A-Za-z])")) + F.regexp_count(m, F.lit("[A-Za-z](?=[0-9])")) + F.regexp_count(m, F.lit("[a-z](?=[A-Z])")) + F.regexp_count(m, F.lit("[A-Z](?=[a-z])"))) / n
    path = (F.regexp_count(m, F.lit("/")) >= 2) | F.right(x["before"], F.lit(1)).rlike(r"[/\\.@#?&]") | F.left(x["after"], F.lit(1)).rlike(r"[/\\]") | x["after"].rlike(r"^\.[a-z]{2,4}\b")
    values = (
        F.least(n, F.lit(100.0)),
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        1 - share("A-Za-z0-9"),
        flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        switches,
        F.size(F.array_distinct(F.split(F.left(m, F.lit(100)), ""))) / F.least(n, F.lit(100.0)),
        known / n,
        flag(path),
        flag(_has(name, NAMES)),
        flag(name.rlike(r"(?:[=:]|=>)\s*[\"'`]?$")),
        flag(F.right(x["before"], F.lit(1)).isin("'", '"', "`")),
        flag(_has(F.concat(name, F.lit(" "), low, F.lit(" "), F.lower(F.left(x["after"], F.lit(16)))), HARMLESS)),
        flag(m.rlike("^(?:" + "|".join(PREFIXES) + ")")),
    )
    return F.array(*values)


def labelled_findings(spark: SparkSession, dictionary: list[str] = (), n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """n labelled findings (text, label), made by rule: credentials in the ways they leak, and what is taken for them.

    Words, names of settings and heads of keys are this function's own, half of the words from the dictionary that is given.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    up, low, dig, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    alnum, marks, common = up + low + dig, "!@#$%^&*-_+?", [*WORDS, *dictionary]
    settings = ("db_password", "DB_PASS_WORD_PASSWORD", "password", "stripe_secret", "client_secret", "mysql_pwd", "authToken", "AWS_SECRET_ACCESS_KEY", "x-api-key", "API_KEY", "webhook_secret", "access_token", "refresh_token", "smtp_passwd", "passphrase", "credential", "private_key", "token")
    signs = ("=", ": ", " = ", '="', "='", ": '", ' = "', ":=", " => ")
    word = lambda: r.choice(common) if r.random() < 0.5 else pick("etaoinshrdlu", r.randint(2, 9))
    prose = lambda k: " ".join(word() for _ in range(k))

    def fill(s: str) -> str:  # a letter and a digit at least
        return s[:-2] + r.choice("abcdef") + r.choice(dig)

    def secret() -> tuple[str, str]:
        kind = r.randrange(9)
        if kind == 0:
            return "AKIA" + fill(pick(up + dig, 16)).upper(), r.choice(("", "", "key ", "aws_access_key_id = ", "id: "))
        if kind == 1:
            return fill(pick(hexa, r.randint(12, 64))), r.choice(settings) + r.choice(signs)
        if kind == 2:
            return fill(pick(alnum, r.randint(12, 44))), r.choice(settings) + r.choice(signs)
        if kind == 3:
            return pick(alnum + marks, r.randint(8, 20)), r.choice(settings[:6]) + r.choice(signs)
        if kind == 4:
            return r.choice(("ghp_", "gho_", "glpat-", "sk_live_", "npm_", "AIza")) + fill(pick(alnum, r.randint(20, 36))), r.choice(("", "", "with ", "token: "))
        if kind == 5:
            return fill(pick(alnum + "+/", 40)), r.choice(("aws_secret_access_key = ", "secret: ", "auth: "))
        if kind == 6:
            return ".".join(("eyJ" + pick(alnum, r.randint(12, 30)), pick(alnum + "-_", r.randint(20, 80)), pick(alnum + "-_", 43))), r.choice(("", "Authorization ", "token="))
        if kind == 7:
            return fill(pick(alnum, r.randint(6, 16))) + "@" + word() + ".net/" + word(), r.choice(("postgres", "https", "mysql", "redis")) + "://" + word() + ":"
        return (word() + pick(dig, r.randint(1, 4)) + r.choice(marks) + pick(alnum, 2)).ljust(8, "7"), r.choice(settings[:6]) + r.choice(signs)

    def harmless() -> tuple[str, str]:
        kind = r.randrange(11)
        if kind == 0:
            return fill(pick(hexa, r.choice((32, 40, 64)))), r.choice(("commit ", "sha1: ", "md5 ", "revision ", "checksum: ", "sha256=", "digest "))
        if kind == 1:
            return "-".join((fill(pick(hexa, 8)), *(pick(hexa, 4) for _ in range(3)), pick(hexa, 12))), r.choice(("", "uuid ", "id "))
        if kind == 2:
            return "-".join(r.choice(common) for _ in range(r.randint(2, 4))) + "-" + pick(dig, r.randint(1, 4)) + r.choice(common), r.choice(("", "see ", "the "))
        if kind == 3:
            return "/" + "/".join(word() for _ in range(3)) + "/" + pick(dig, 4) + word(), r.choice(("https:/", "in ", ""))
        if kind == 4:
            return "_".join(r.choice(common) for _ in range(r.randint(2, 4))) + pick(dig, 2), r.choice(("", "def ", "call "))
        if kind == 5:
            return r.choice(("your", "example", "sample", "dummy", "placeholder")) + r.choice(("-", "_", "")) + r.choice(("password", "token", "secret", "key")) + pick(dig, r.randint(0, 3)), r.choice(settings) + r.choice(signs)
        if kind == 6:
            return pick(low, r.randint(10, 16)) + pick(dig, r.randint(1, 4)), r.choice(("", "the ", "and "))
        if kind == 7:
            return pick(up, 3) + "-" + pick(dig, r.randint(8, 12)), r.choice(("order ", "isbn ", "part ", ""))
        if kind == 8:  # prose about credentials
            return r.choice(common) + r.choice(("ing", "ed", "ment", "ness", "tion")) + " " + prose(2), r.choice(("token: ", "secret: ", "password = ", "auth: ", "passphrase: "))
        if kind == 9:  # code that only fetches one
            return r.choice(("os.environ", "getpass", "config.get", "process.env", "request.form", "None", "undefined", "required")) + r.choice(("()", ".get(x)", "[x]", "")) + r.choice(("", ";", ",")), r.choice(settings) + r.choice((" = ", ": ", "="))
        return r.choice(("${", "<", "{{", "%(", "***", "xxxx")) + r.choice(common).upper() + r.choice(("}", "}}", ")s", "***", "xxxx")), r.choice(settings) + r.choice(signs)

    rows = []
    for i in range(n):
        body, lead = secret() if i % 2 == 0 else harmless()
        close = '"' if lead.endswith('"') else "'" if lead.endswith("'") else ""
        rows.append((f"{prose(r.randint(0, 6))} {lead}{body}{close}{r.choice(('', '', '.', ','))} {prose(r.randint(0, 6))}", int(i % 2 == 0)))
    return spark.createDataFrame(rows, "text string, label int")


def train_forest(findings: DataFrame, dictionary: list[str] = (), trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees as nested (feature, threshold, left, right), leaves as the predicted class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    found = with_matches(findings, "text", CANDIDATE, "found").filter(F.size("found") > 0)
    f = features(candidate(F.get("found", 0)), _known(dictionary))
    table = found.select(F.monotonically_increasing_id().alias("i"), F.col("label").cast("double").alias("label"), array_to_vector(f).alias("features"))
    table = materialise(table, "secret-findings").coalesce(1).sortWithinPartitions("i")  # passed over many times, in one order
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(table)

    def walk(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._call_java("rootNode")) for t in model.trees]


def _known(dictionary: list[str]) -> list[str]:
    return sorted({*WORDS, *dictionary})


def votes(forest: list, f: Column) -> Column:
    """The share of trees that call the candidate with features f a secret."""

    def expr(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        k, at, left, right = node
        return F.when(F.get(f, F.lit(k)) <= F.lit(at), expr(left)).otherwise(expr(right))

    total = F.lit(0.0)
    for t in forest:
        total = total + expr(t)
    return total / F.lit(float(len(forest)))


def find_secrets(docs: DataFrame, text: str = "text", forest: list | None = None, dictionary: list[str] | None = None) -> DataFrame:
    """docs with secret_candidates: array<struct<start, end, match, score>>, in code points, in order."""
    if dictionary is None:
        dictionary = common_words(docs, text)
    forest = forest or train_forest(labelled_findings(docs.sparkSession, dictionary), dictionary)
    known = _known(dictionary)
    out = with_matches(docs, text, CANDIDATE, "secret_found", F.col(text).rlike("[0-9:=]"))
    out = out.withColumn("secret_own", F.filter(F.transform("secret_found", candidate), lambda x: F.length(x["match"]) >= 3))
    out = out.withColumn("secret_seen", F.transform("secret_own", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), features(x, known).alias("f"))))
    scored = F.transform("secret_seen", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), votes(forest, x["f"]).alias("score")))
    return out.withColumn("secret_candidates", scored).drop("secret_found", "secret_own", "secret_seen")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, forest: list | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end, comma-joined), secrets_sha256 for every row of docs."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", forest)
    found = found.select("doc_id", F.size("secret_candidates").cast("long").alias("n_candidates"), F.filter("secret_candidates", lambda x: x["score"] >= threshold).alias("s"))
    spans = F.array_join(F.transform("s", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("s").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(F.array_join(F.transform("s", lambda x: x["match"]), "\n").cast("binary"), 256).alias("secrets_sha256"))


def redact_secrets(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, placeholder: str = "[SECRET]", forest: list | None = None) -> DataFrame:
    """docs with every secret in text replaced; texts without one stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    out = find_secrets(docs.select(F.col(text).alias("t"), whole), "t", forest)
    cut = F.transform(F.filter("secret_candidates", lambda x: x["score"] >= threshold), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(placeholder).alias("label")))
    out = without_spans(out.withColumn("secret_cut", cut), "t", "secret_cut")
    return out.select(*[F.col("t").alias(c) if c == text else F.col(f"whole.`{c}`") for c in docs.columns])
