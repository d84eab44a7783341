"""Chat formatting: a hidden Markov model recovers roles, then turns are rendered in one canonical form.

A text is cut into units where a line has a speaker marker; a text without one is one unit (a turn), and in `format_transcripts` it is cut at blank lines. Units are
observed through the speaker marker and line features (length, lines, question, list or code,
opening); roles are the hidden states. Start, transition and emission tables are counted with add-one smoothing from units
whose role is known and whose conversation isn't held out. Viterbi gives the best roles of each conversation, markers are cut off, and each turn
is rendered as "<|role|>\\ntext\\n<|end|>\\n".

Scale: model tables are some hundred counts. Units of a conversation are numbered in order, without a window over it: counts by ranges of places come first, and
only rows of one range are numbered together. A conversation is cut into chunks of `CHUNK` units by number; in max-plus algebra a chunk is a
small matrix, so chunks are reduced apart, chained by conversation, and each chunk is traced back apart from its entering and leaving
state. No task holds more of a conversation's text than a chunk, and the result is that of one chain. The units of CHUNK places are numbered together, in the order of their place, of their piece within a text, and of a hash of their
text; only places that are null are dealt by the hash, as they have no order.

Defined results: null or empty text is a unit without features; units of a conversation with the same place go by a hash of their text; a null
conversation or place counts as one of its own, first; repeated rows are units each; an empty table gives an empty result; a training table
without known roles gives an even model; transitions from a place with several known roles are shared evenly among them; ties go to the role first in `ROLES`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import held_out, materialise

ROLES = ("system", "user", "assistant")
CHUNK = 1024
#: What speakers are called.
CALLED = {"system": "system|instructions?|context", "user": "user|human|question|q|customer|me|prompter", "assistant": "assistant|bot|ai|answer|a|agent|model|gpt"}
MARKER = r"^[ \t]*(?:[#>*]+\s*)?(?:<\|?|\[|\*\*)?({})(?:\|?>|\]|\*\*)?\s*(?::|(?<=[>\]])|\n)\s*(?:\*\*)?"
#: Before a line that opens with a speaker marker.
MARKED = "(?im)^(?=" + MARKER[1:].format("|".join(CALLED.values())) + ")"
FEATURES = {"marker": 4, "length": 8, "lines": 4, "question": 2, "code": 2, "opening": 3}


def marker(text: Column) -> Column:
    """0, or 1 + the role whose marker opens the text."""
    out = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES))):
        out = F.when(text.rlike("(?i)" + MARKER.format(CALLED[role])), F.lit(i + 1)).otherwise(out)
    return out


def without_marker(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + MARKER.format("|".join(CALLED.values())), "")


def observed(text: Column) -> Column:
    """array<int> of the features in the order of FEATURES."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    return F.array(
        marker(t),
        F.greatest(F.least(F.floor(F.log2(n + F.lit(1.0))).cast("int") - 4, F.lit(7)), F.lit(0)),
        F.least(n - F.length(F.replace(t, F.lit("\n"), F.lit(""))), F.lit(3)),
        t.contains("?").cast("int"),
        t.rlike(r"```|(?m)^\s*(?:[-*]|[0-9]+\.)\s").cast("int"),
        F.when(t == "", 2).when(t.rlike("^[a-z]"), 1).otherwise(0),
    )


def train(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", mod: int = 5) -> dict[str, np.ndarray]:
    """Log tables: start (S), move (S, S), and one (S, values) for each feature."""
    s = len(ROLES)
    state = F.coalesce(*[F.when(F.col(role) == r, F.lit(i)) for i, r in enumerate(ROLES)])
    known = turns.filter(~held_out(F.col(conv), mod)).select(F.col(conv).alias("c"), F.col(order).alias("o"), state.alias("s"), observed(F.col(text)).alias("x")).filter("s is not null")
    known = materialise(known, "hmm-train")
    # Known roles of each place, counted first; a join with the place before then meets at most S x S rows of a place.
    each = known.groupBy("c", "o", "s").agg(F.count("*").alias("n"))
    all_ = each.groupBy("c", "o").agg(F.sum("n").alias("of"))
    prior = each.join(all_.select(F.col("c").alias("ac"), F.col("o").alias("ao"), "of"), F.col("c").eqNullSafe(F.col("ac")) & F.col("o").eqNullSafe(F.col("ao")))
    prior = prior.select(F.col("c").alias("pc"), (F.col("o") + 1).alias("po"), F.col("s").alias("ps"), (F.col("n") / F.col("of")).alias("share"))
    steps = each.join(prior, F.col("c").eqNullSafe(F.col("pc")) & (F.col("o") == F.col("po")), "left").groupBy("ps", "s").agg(F.sum(F.col("n") * F.coalesce("share", F.lit(1.0))).alias("n")).collect()
    start, move = np.ones(s), np.ones((s, s))
    for r in steps:  # (S + 1) x S rows
        if r["ps"] is None:
            start[r["s"]] += r["n"]
        else:
            move[r["ps"], r["s"]] += r["n"]
    tables = {k: np.ones((s, n)) for k, n in FEATURES.items()}
    for r in known.select("s", F.posexplode("x").alias("f", "v")).groupBy("s", "f", "v").count().collect():
        tables[list(FEATURES)[r["f"]]][r["s"], r["v"]] += r["count"]
    # Speaker markers are taken at their word even where training text has none.
    for i in range(s):
        tables["marker"][i, i + 1] += 1000
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": log(start), "move": log(move), **{k: log(t) for k, t in tables.items()}}


def _emissions(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return sum(model[k][:, x[:, i]].T for i, k in enumerate(FEATURES))


def numbered(units: DataFrame) -> DataFrame:
    """units (c, o, t, ...; w if units of a place have an order there) with number: 0, 1, ... within each conversation c, in the order of place o (nulls first), w and a hash of the text t."""
    within = [F.col("w").asc_nulls_first()] if "w" in units.columns else []
    units = materialise(units.withColumn("h", F.xxhash64("t")).withColumn("part", F.floor(F.col("o") / F.lit(CHUNK))).withColumn("slot", F.when(F.col("o").isNull(), F.pmod("h", F.lit(CHUNK)))), "hmm-placed")
    # Ranges of places; units without a place are dealt by ranges of their hash, so that these too are numbered apart.
    own = ["c", "part", "slot"]
    sizes = materialise(units.groupBy(*own).agg(F.count("*").alias("n")), "hmm-sizes")
    before = F.sum("n").over(Window.partitionBy("c").orderBy(F.col("part").asc_nulls_first(), F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("c").alias("sc"), F.col("part").alias("sp"), F.col("slot").alias("ss"), F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.col("o").asc_nulls_first(), *within, "h")) - 1
    ranked = units.withColumn("rank", rank)
    same = ranked["c"].eqNullSafe(starts["sc"]) & ranked["part"].eqNullSafe(starts["sp"]) & ranked["slot"].eqNullSafe(starts["ss"])
    return ranked.join(starts, same).withColumn("number", F.col("before") + F.col("rank")).drop("sc", "sp", "ss", "before", "rank", "h", "part", "slot", "w")


def spoken_units(turns: DataFrame, text: str = "text") -> DataFrame:
    """turns with unit_piece and unit_text: a row for each piece of a text that is cut where a line opens with a speaker marker, one for a text without."""
    t = F.coalesce(F.col(text), F.lit(""))
    pieces = F.when(t.rlike(MARKED), F.filter(F.split(t, MARKED), lambda x: x.rlike(r"\S"))).otherwise(F.array(t))
    return turns.select("*", F.posexplode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(t))).alias("unit_piece", "unit_text"))


def recover_roles(units: DataFrame, training: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", within: str | None = None) -> DataFrame:
    """units with recovered (role), bare (text without its marker) and rendered. within: the order of units that share a place."""
    model, s = train(training), len(ROLES)
    rest = [c for c in units.columns if c not in ("recovered", "bare", "rendered")]
    base = units.select(F.col(conv).alias("c"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.struct(*[F.col(f"`{k}`") for k in rest]).alias("rest"), *([F.col(within).cast("long").alias("w")] if within else []))
    base = numbered(base.withColumn("x", observed(F.col("t")))).withColumn("k", F.floor(F.col("number") / F.lit(CHUNK)).cast("long"))
    base = materialise(base, "hmm-units")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ("c", "k", "number")
    key = base.schema["c"].dataType.simpleString()
    arrow = to_arrow_type(base.schema["c"].dataType)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, first, done = None, None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            e = _emissions(model, _matrix(b))
            for i, at in enumerate(zip(b.column("c").to_pylist(), b.column("k").to_pylist(), strict=True)):
                step = model["move"] + e[i]
                if at != now:
                    if now is not None:
                        done.append((*now, m.ravel().tolist(), first.tolist()))
                    now, m, first = at, step, model["start"] + e[i]
                else:
                    m, first = (m[:, :, None] + step[None]).max(axis=1), (first[:, None] + step).max(axis=0)
            yield out(done)
            done = []
        if now is not None:
            yield out([(*now, m.ravel().tolist(), first.tolist())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (arrow, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["c", "k", "m", "f"])

    # m: best sums from a state before the chunk to one at its end; f: from the start of a conversation.
    chunks = base.select("c", "k", "number", "x").repartition(parts, "c", "k").sortWithinPartitions(*place).select("c", "k", "x")
    chunks = materialise(chunks.mapInArrow(reduce, f"c {key}, k long, m array<double>, f array<double>"), "hmm-chunks")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ks, ms, seen = None, [], [], False

        def ends() -> pa.RecordBatch:
            v = [np.asarray(ms[0][1])]
            for m, _ in ms[1:]:
                v.append((v[-1][:, None] + np.reshape(m, (s, s))).max(axis=0))
            leave, enter = [0] * len(ms), [-1] * len(ms)
            leave[-1] = int(v[-1].argmax())
            for j in range(len(ms) - 1, 0, -1):
                enter[j] = leave[j - 1] = int((v[j - 1] + np.reshape(ms[j][0], (s, s))[:, leave[j]]).argmax())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(ks), arrow), pa.array(ks, pa.int64()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32())], ["bc", "bk", "enter", "leave"])

        for b in batches:
            for c, k, m, f in zip(*(b.column(n).to_pylist() for n in ("c", "k", "m", "f")), strict=True):
                if seen and c != now:
                    yield ends()
                    ks, ms = [], []
                now, seen = c, True
                ks.append(k)
                ms.append((m, f))
        if ks:
            yield ends()

    bounds = chunks.repartition(parts, "c").sortWithinPartitions("c", "k").mapInArrow(chain, f"bc {key}, bk long, enter int, leave int")
    met = base.join(materialise(bounds, "hmm-bounds"), F.col("c").eqNullSafe(F.col("bc")) & (F.col("k") == F.col("bk")))
    met = met.repartition(parts, "c", "k").sortWithinPartitions(*place).select("c", "k", "x", "enter", "leave", "t", "rest")
    spoken = StructType([f for f in met.schema.fields if f.name in ("t", "rest")]).add("state", "integer")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_keys, now = [], [], None  # the open chunk, CHUNK units at most
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column("c").to_pylist(), b.column("k").to_pylist(), strict=True))
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:
                last -= 1  # the chunk that is open at the batch's end
            if held and (last or keys[-1] != now):
                yield from states(pa.Table.from_batches([*held, b.slice(0, last)]), held_keys + keys[:last])
                held, held_keys = [], []
            elif last:
                yield from states(pa.Table.from_batches([b.slice(0, last)]), keys[:last])
            held.append(b.slice(last))
            held_keys += keys[last:]
            now = keys[-1]
        if held:
            yield from states(pa.Table.from_batches(held), held_keys)

    def states(t: pa.Table, keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        e, enter, leave = _emissions(model, _matrix(t.combine_chunks().to_batches()[0])), t.column("enter").to_pylist(), t.column("leave").to_pylist()
        found, i = [], 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            v = (model["start"] if enter[i] < 0 else model["move"][enter[i]]) + e[i]
            back = []
            for r in range(i + 1, j):
                sums = v[:, None] + model["move"]
                back.append(sums.argmax(axis=0))
                v = sums.max(axis=0) + e[r]
            path = [leave[i]]
            for prior in reversed(back):
                path.append(int(prior[path[-1]]))
            found += path[::-1]
            i = j
        yield from t.select(["t", "rest"]).append_column("state", pa.array(found, pa.int32())).combine_chunks().to_batches()

    told = F.get(F.array(*[F.lit(r) for r in ROLES]), "state")
    done = met.mapInArrow(trace, spoken)
    done = done.select("rest.*", told.alias("recovered"), F.trim(without_marker(F.col("t"))).alias("bare"))
    return done.withColumn("rendered", render(F.col("recovered"), F.col("bare")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def _matrix(b) -> np.ndarray:
    return np.asarray(b.column("x").flatten().to_numpy()).reshape(-1, len(FEATURES))


def format_transcripts(docs: DataFrame, training: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, turn, role, text, rendered) from transcripts, a text each.

    A line with a speaker marker opens a turn, an unmarked line goes on with the one before it; a text without markers is cut at blank
    lines. What opens a turn is a unit of the model, so roles of unmarked turns are recovered too. Each transcript is one row's text, which bounds its turns.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    pieces = F.split(t, F.when(t.rlike(MARKED), F.lit(MARKED)).otherwise(F.lit(r"\n\s*\n")))
    units = docs.select(F.col(id_).alias("id"), F.posexplode(F.filter(F.transform(pieces, lambda x: F.rtrim(x)), lambda x: x.rlike(r"\S"))).alias("turn", "text"))
    out = recover_roles(units, training, "id", "turn", "text")
    return out.select("id", "turn", F.col("recovered").alias("role"), F.trim(F.regexp_replace("bare", r"^\s+|\s+$", "")).alias("text"), render(F.col("recovered"), F.regexp_replace("bare", r"^\s+|\s+$", "")).alias("rendered"))
