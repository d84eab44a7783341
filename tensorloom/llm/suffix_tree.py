"""LM scoring by a probabilistic suffix tree over tokens.

A text is a sequence of tokens, words (A-Z lower-cased, split at ASCII white space) and then one end; a mark stands before the first. The
tree's contexts are the last 1 to `depth` tokens, the mark included. A context becomes a state if it occurs at least `least` times in training
text, whatever the corpus's size, and its next-token distribution diverges from that of its longest shorter state: 2 N KL >= `divergence`.
The divergence is a deleted estimate, each occurrence held against a distribution learnt from all others, so that a context whose tokens merely
differ is not taken for one that predicts them. A state's distribution is smoothed by that of its longest shorter state, in the end by the
root (c + 0.1) / (N + 0.1 (V + 1)); each token is scored in the longest state that is a suffix of what precedes it.

Scale: texts are tokenised once, into chunks of some `CHUNK` tokens (or `BYTES` of words) in written form (word numbers and 64-bit word hashes, some 2.5 bytes a token).
The tree stays on the executors, dealt by hash: in each round a chunk asks for the counts of its own grams, a bucket of hashes adds up what
all chunks have and answers, and longer contexts are only asked for where the shorter ones occur `least` times. A gram is one entry for each chunk however
frequent it is, so no word or document makes a hot bucket; buckets and tasks grow with the number of tokens. Keys go sorted, as differences, in
compressed byte planes. Nothing but N, V and the numbers of chunks and tokens comes to the driver, and nothing is broadcast. Counts of equal hashes are added: words
have 64 bits; longer grams as many as leave a gram a chance under 2^-`SPARE` to share its hash with another, whatever the corpus's size.

Defined results: null counts as an empty text, which is one end; a null doc_id counts as training; without training text
counts are 0, the base is 0 and there are no states; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import held_out, materialise

DEPTH, LEAST, DIVERGENCE, WEIGHT, ADDED, SEED = 3, 2, 6.0, 8.0, 0.1, 42
#: Tokens of a chunk, unless one document has more; and of a bucket, on average.
CHUNK, BUCKET, SPARE = 1_000_000, 1_000_000, 20
#: Bytes of words that fill a chunk too, and bytes of texts that are cut into words at once.
BYTES, PIECE = 1 << 26, 1 << 22
#: Marks outside words, and the fixed point of divergences.
FIRST, END, SCALE = b"\r", b"\n", 1 << 8
#: Kinds of rows: a chunk, counts of grams of 1 + d tokens (d), and divergences of contexts of d tokens (TEST + d).
ITSELF, TEST = -1, 100
_ROW = "chunk long, kind int, bucket int, a binary, b binary, c binary"
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (bytes: A-Z and ASCII white space only), and their number in each."""
    kind = pa.string() if texts.type == pa.binary() else pa.large_string()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(kind)))
    words, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text leaves an empty word
    upto = np.concatenate([[0], np.cumsum(some)])
    return words.filter(pa.array(some)), np.diff(upto[ends], prepend=0)


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some `most` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return _ZIP.compress(planes.tobytes())


def unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(_UNZIP.decompress(b), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_signed(x: np.ndarray) -> bytes:
    return pack((x << 1) ^ (x >> 63))


def unpack_signed(b: bytes) -> np.ndarray:
    x = unpack(b)
    return (x >> 1) ^ -(x & 1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def extend(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a gram with one more word."""
    x = (key ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each place the number of its key.

    Keys and places are sorted as one number each, several times faster than an argsort. Where both don't fit into 64 bits the last bits of the
    keys are left out, and the rare keys that only differ there are put in order afterwards.
    """
    if not len(x):
        return x, np.empty(0, np.int32)
    places, base = np.uint64((len(x) - 1).bit_length()), x.min()
    y = x - base
    every = int(np.bitwise_or.reduce(y))
    zeros = max((every & -every).bit_length() - 1, 0)
    cut = max(every.bit_length() - zeros + int(places) - 64, 0)
    y >>= np.uint64(zeros + cut)
    y <<= places
    y |= np.arange(len(x), dtype=np.uint64)
    y.sort()
    order = (y & np.uint64((1 << int(places)) - 1)).view(np.int64)
    y = x[order] if cut else ((y >> places) << np.uint64(zeros)) + base
    if cut and (y[1:] < y[:-1]).any():
        order = np.argsort(x)
        y = x[order]
    new = np.concatenate([[True], y[1:] != y[:-1]])
    back = np.empty(len(x), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return y[new], back


@dataclass
class Chunk:
    """Tokens of some documents, a mark before each: place in the document, number of the word, and the words' keys in order."""

    place: np.ndarray
    word: np.ndarray
    keys: np.ndarray
    train: np.ndarray
    starts: np.ndarray

    @classmethod
    def read(cls, words: bytes, keys: bytes, shape: bytes) -> Chunk:
        own = unpack(keys, np.uint64)
        order = np.argsort(own)
        rank = np.empty(len(own), np.int32)
        rank[order] = np.arange(len(own), dtype=np.int32)
        shapes = unpack(shape)  # tokens, negative where the document is held out
        sizes = np.abs(shapes) + 1
        starts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        return cls(place, rank[unpack(words, np.uint32)], own[order], np.repeat(shapes > 0, sizes), starts)


@dataclass
class Setting:
    depth: int
    least: int
    divergence: float
    weight: float
    n: int = 0
    v: int = 0
    bits: int = 64


def replay(c: Chunk, told: dict[int, np.ndarray], s: Setting) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """What the chunk asks next, given what it was told: {kind: (sorted keys, values)}; and counts, root and final probabilities of its tokens."""
    ask: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rank, keys = c.word, c.keys
    if 0 not in told:
        ask[0] = keys, np.bincount(rank[c.train], minlength=len(keys))
        n = seen = root = p = None
    else:
        n = told[0]
        seen = n[rank]
        root = (seen + ADDED) / (s.n + ADDED * (s.v + 1))
        p = root.copy()
    at = np.flatnonzero(c.place >= 1).astype(np.int32)
    for d in range(1, s.depth + 1):
        if not len(at):
            break
        # The grams that end at `at`; their numbers follow the order of their keys.
        before = rank[at - 1]
        own, gram = distinct(extend(keys[before], c.keys[c.word[at]]) >> np.uint64(64 - s.bits) << np.uint64(64 - s.bits))
        train = c.train[at]
        if d not in told:
            ask[d] = own, np.bincount(gram[train], minlength=len(own))
            break
        # Contexts that occur often enough, and whether they are states.
        counts, total = told[d], n[before]
        often = total >= s.least
        i, ctx = at[often], before[often]
        met = np.zeros(len(keys), bool)
        met[ctx] = True
        which, of = np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[ctx]
        if TEST + d not in told:
            ours = train[often]
            q = p[i[ours]]
            loo = (counts[gram[often][ours]] - 1 + s.weight * q) / (total[often][ours] - 1 + s.weight)
            gain = np.rint(SCALE * np.log(loo / q))
            ask[TEST + d] = keys[which], np.bincount(of[ours], gain, len(which)).astype(np.int64)
        else:
            state = told[TEST + d][of].astype(bool)
            j = i[state]
            p[j] = (counts[gram[often][state]] + s.weight * p[j]) / (total[often][state] + s.weight)
        # Longer contexts: this gram is the next token's context, if it occurs often enough.
        here = np.full(len(c.word), -1, np.int32)
        here[at] = gram
        rank, keys, n = here, own, counts
        at = np.flatnonzero(c.place >= d + 1).astype(np.int32)
        at = at[rank[at - 1] >= 0]
        at = at[n[rank[at - 1]] >= s.least]
    return ask, seen, root, p


def chunks(docs: DataFrame, doc_id: str, text: str, mod: int) -> DataFrame:
    """(chunk, tokens, a, b, c, doc_ids): documents as packed word numbers, word keys and sizes."""
    kind = docs.schema[doc_id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = count(), TaskContext.get().partitionId()
        words, sizes, ids, held, full, held_bytes = [], [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            flat, n = pa.concat_arrays(words).dictionary_encode(), np.concatenate(sizes)
            names = flat.dictionary
            seq, ends = np.full(n.sum() + 2 * len(n), -1, np.int32), np.cumsum(n + 2) - 1
            seq[ends - n - 1], seq[ends] = 0, 1
            seq[seq < 0] = flat.indices.to_numpy(zero_copy_only=False) + np.int32(2)
            of = np.bincount(seq, minlength=2 + len(names))
            order = np.argsort(-of, kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            key = np.array([xxhash.xxh64_intdigest(w, SEED) for w in (FIRST, END, *names.view(pa.binary() if names.type == pa.string() else pa.large_binary()).to_pylist())], np.uint64)[order]
            got = [pa.array([(part << 32) + next(number)], pa.int64()), pa.array([len(seq) - len(n)], pa.int64())]
            shape = np.where(np.concatenate(held), -n - 1, n + 1)
            got += [pa.array([x], pa.binary()) for x in (pack(place[seq]), pack(key), pack(shape))]
            return pa.RecordBatch.from_arrays([*got, pa.array([list(chain.from_iterable(ids))], pa.list_(arrow))], ["chunk", "tokens", "a", "b", "c", "doc_ids"])

        for batch in batches:
            marked = batch.column("held").to_numpy(zero_copy_only=False)
            for start, stop in pieces(batch.column("text"), PIECE):
                found, n = tokens(batch.column("text").slice(start, stop - start))
                first = np.cumsum(n) - n
                while start < stop:
                    # Documents up to the one that fills the chunk, and all that are left otherwise.
                    take = min(int(np.searchsorted(np.cumsum(n + 2), CHUNK - full)) + 1, len(n))
                    end = int(first[take - 1] + n[take - 1])
                    words.append(found.slice(int(first[0]), end - int(first[0])))
                    sizes.append(n[:take])
                    ids.append(batch.column("id").slice(start, take).to_pylist())
                    held.append(marked[start : start + take])
                    full, held_bytes = full + int(n[:take].sum()) + 2 * take, held_bytes + words[-1].nbytes
                    start, n, first = start + take, n[take:], first[take:]
                    if full >= CHUNK or held_bytes >= BYTES:
                        yield out()
                        words, sizes, ids, held, full, held_bytes = [], [], [], [], 0, 0
        if ids:
            yield out()

    kept = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id), mod).alias("held"), F.col(text).cast("binary").alias("text"))
    return kept.mapInArrow(run, f"chunk long, tokens long, a binary, b binary, c binary, doc_ids array<{kind.simpleString()}>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "kind", "bucket", "a", "b", "c"])


def _met(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _told(rows: list[tuple]) -> dict[int, np.ndarray]:
    """Answers of one chunk by kind, in the order of their keys; rows: (chunk, kind, bucket, a, ...) sorted."""
    return {k: np.concatenate([unpack(r[3], np.uint8 if k > TEST else np.int64) for r in g]) for k, g in groupby(rows, key=lambda r: r[1])}


def answer(asked: DataFrame, buckets: int, divergence: float) -> DataFrame:
    """Adds up what all chunks ask of a bucket; one row for each chunk, and for words one (chunk -1) with N and V of the bucket."""
    marks = [np.uint64(xxhash.xxh64_intdigest(FIRST, SEED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, kind), group in groupby(_met(batches, ("bucket", "kind", "chunk", "a", "b")), key=lambda r: r[:2]):
            whose, keys, values = [], [], []
            for _, _, chunk, a, b in group:
                whose.append(chunk)
                keys.append(unpack_sorted(a))
                values.append(unpack_signed(b))
            every = np.concatenate(keys)
            u, back = distinct(every)
            sums = np.bincount(back, np.concatenate(values), len(u)).astype(np.int64)
            told = sums if kind < TEST else (2 * sums >= divergence * SCALE).astype(np.uint8)
            ends = np.cumsum([len(k) for k in keys])
            out = [(chunk, kind, bucket, pack(told[back[e - len(k) : e]]), None, None) for chunk, e, k in zip(whose, ends, keys, strict=True)]
            if kind == 0:
                own = sums[~np.isin(u, marks)]
                out.append((-1, kind, bucket, pack(np.array([own.sum(), (own > 0).sum()], np.int64)), None, None))
            yield _rows(out)

    return asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(run, _ROW)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 10, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark, s = docs.sparkSession, Setting(depth, least, divergence, weight)
    own = materialise(chunks(docs, doc_id, text, mod), "pst-chunks")
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    s.bits = min(64, SPARE + max(int(size["tokens"]), 1).bit_length())
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-size["tokens"] // BUCKET))
    parts = max(-(-size["n"] // 2), 1)
    itself = own.select("chunk", F.lit(ITSELF).alias("kind"), F.lit(0).alias("bucket"), "a", "b", "c", "doc_ids")

    def gathered(answers: DataFrame | None) -> DataFrame:
        """Each chunk, followed by what it was told."""
        if answers is None:
            return itself
        told = answers.withColumn("doc_ids", F.lit(None).cast(own.schema["doc_ids"].dataType))
        return itself.unionByName(told).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in groupby(_met(batches, ("chunk", "kind", "bucket", "a", "b", "c")), key=lambda r: r[0]):
            rows = list(rows)
            c = Chunk.read(*rows[0][3:])
            for kind, (keys, values) in replay(c, _told(rows[1:]), s)[0].items():
                of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # in the order of the keys
                cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
                some, values = np.flatnonzero(np.diff(cuts)).tolist(), values.astype(np.int64)
                if some:
                    yield _rows([(chunk, kind, b, pack_sorted(keys[cuts[b] : cuts[b + 1]]), pack_signed(values[cuts[b] : cuts[b + 1]]), None) for b in some])

    answers = None
    for step in range(depth + 1):
        new = materialise(answer(gathered(answers).mapInArrow(ask, _ROW), buckets, divergence), f"pst-told-{step}")
        if step == 0:
            totals = [unpack(r["a"]) for r in new.filter("chunk = -1").select("a").collect()]  # a row for each bucket
            s.n, s.v = (int(sum(t[i] for t in totals)) for i in (0, 1))
            new = new.filter("chunk >= 0")
        answers = new if answers is None else answers.unionByName(new)
    kind = docs.schema[doc_id].dataType
    arrow, total = to_arrow_type(kind), s.n

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_met(batches, ("chunk", "kind", "bucket", "a", "b", "c", "doc_ids")), key=lambda r: r[0]):
            rows = list(rows)
            c = Chunk.read(*rows[0][3:6])
            _, seen, root, p = replay(c, _told(rows[1:]), s)
            token = c.place > 0
            each = lambda x: np.add.reduceat(np.where(token, x, 0), c.starts)  # noqa: E731, B023
            held = pa.array(~c.train[c.starts])
            n = len(c.starts)
            out = [pa.array(rows[0][6], arrow), held, pa.array(each(1)), pa.array(each(seen > 0)), pa.array(np.full(n, total)), pa.array(each(np.log10(root))), pa.array(each(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return gathered(answers).mapInArrow(score, shape)
