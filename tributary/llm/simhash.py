"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of a text's
shingles. Equal fingerprints are one class. Two fingerprints within the radius
agree in some choice of m - radius out of m blocks of bits, so each class is
listed once for every choice, under the bits it keeps; m grows with the
logarithm of the number of classes so that lists stay short. A list is compared
with itself in bit planes: plane p holds bit p of all its fingerprints, carry-
save counters add up the differing bits of many pairs at once, and a
fingerprint is abandoned for a block as soon as all its counters there exceed
the radius. Lists longer than LIST are cut into parts, and each pair of parts
is a list of its own, so no task holds more than two parts. A list gives the
links of a spanning forest only, never all pairs. Components are found by
passing on the least label, with the label's own label taken up in each round.

Defined cases: a text without words (null, empty) has fingerprint zero, which
links like any other; a text of fewer words than a shingle has its whole
sequence as its one shingle; repeated rows are linked by equal fingerprints;
component_id is the least doc_id that is not null (null if all are); an empty
table gives an empty result; other columns are ignored (near_dups) or pass
through (keep_one).

keep_one, for corpora, looks for similar texts rather than near fingerprints:
documents are listed by least shingle hashes, which does not grow with the
corpus, bit-sliced comparison of wider fingerprints leaves out the pairs of a
list that are far apart, and the Jaccard similarity of the whole shingle sets
decides on each pair left, in the task that holds the list.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, bound_batches, materialize, small

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in one part of a long list, and in a comparison block made of short lists.
LIST, BLOCK = 8192, 1024
#: Lists hold about this many fingerprints on average.
MEAN_LIST = 256


def fingerprint_bits(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return one(joined, seed)
    hashes = np.array([one(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint as a signed long."""
    return pa.array(np.array([fingerprint_bits(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())


def masks(n: int, radius: int = RADIUS, mean: int = MEAN_LIST) -> list[int]:
    """One mask for each choice of blocks that must agree, with enough bits for n fingerprints."""
    wanted = max(0.0, math.log2(max(n, 1) / mean))
    m = next((m for m in range(radius + 1, 16) if 64 // m * (m - radius) >= wanted), 16)
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, m - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(prints: np.ndarray, radius: int = RADIUS, slice_rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """For each fingerprint i of a block, the j > i within the radius, where there are any. prints has a row of 64-bit
    words for each fingerprint."""
    prints = np.ascontiguousarray(prints.reshape(len(prints), -1))
    n, width = prints.shape
    lanes = -(-n // 64) * 64
    bits = np.zeros((64 * width, lanes), np.uint8)
    bits[:, :n] = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    levels = (radius + 1).bit_length()  # counters start so that radius + 1 differing bits overflow
    start = (1 << levels) - 1 - radius
    later = np.tril(np.ones((64, 64), np.uint8))  # lane j <= i of a fingerprint's own word
    own = np.packbits(later, axis=1, bitorder="little").view("<u8")[:, 0]
    tail = np.uint64(0) if n % 64 == 0 else ~np.uint64((1 << n % 64) - 1)
    full = ~np.uint64(0)
    for lo in range(0, n, slice_rows):
        rows = np.arange(lo, min(n, lo + slice_rows))
        first = lo // 64  # words before it hold j <= i only
        here = planes[:, first:]
        dead = np.zeros((len(rows), here.shape[1]), "<u8")
        dead[:, -1] |= tail
        word = rows // 64 - first
        dead[np.arange(here.shape[1])[None, :] < word[:, None]] = full
        dead[np.arange(len(rows)), word] |= own[rows % 64]
        counters = [np.full_like(dead, full if start >> k & 1 else 0) for k in range(levels)]
        for p in range(64 * width):
            if p % 8 == 0 and p > 2 * radius:
                alive = (dead != full).any(axis=1)
                if not alive.all():
                    rows, dead, counters = rows[alive], dead[alive], [c[alive] for c in counters]
                if not len(rows):
                    break
            flip = -(prints[rows, p // 64] >> np.uint64(p % 64) & np.uint64(1))
            carry = here[p][None, :] ^ flip[:, None]
            for c in counters:
                up = c & carry
                c ^= carry
                carry = up
            dead |= carry
        for i, d in zip(rows.tolist(), dead, strict=True):
            if (d != full).any():
                lanes_left = np.flatnonzero(np.unpackbits((~d).view(np.uint8), bitorder="little"))
                yield i, lanes_left + first * 64


def forest(prints: np.ndarray, radius: int = RADIUS, sizes: np.ndarray | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Links (positions) that join what the block's links join, at most one fewer than fingerprints. With sizes, only
    those whose set sizes allow the similarity."""
    label, links = np.arange(len(prints)), []
    for i, js in close_pairs(prints, radius):
        if sizes is not None:
            js = js[alike(sizes[i], sizes[js], similarity)]
        for j in js[np.unique(label[js], return_index=True)[1]]:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the Jaccard similarity."""
    return np.minimum(a, b) / np.maximum(np.maximum(a, b), 1) >= similarity


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(radius: int, words: list[str], extra: list[str], similarity: float):
    """Sorted batches of (list, id, words..., extra...) to links between ids: whole lists are packed into blocks of at
    least BLOCK rows; a list of one fingerprint has no links. extra may name set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def give(key: np.ndarray, ident: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> pa.RecordBatch | None:
            same = key[1:] == key[:-1]
            shared = np.append(same, False) | np.append(False, same)
            ident, at = np.unique(ident[shared], return_index=True)
            if len(ident) < 2:
                return None
            fp, more = fp[shared][at], [m[shared][at] for m in more]
            found = forest(fp, radius, *more, similarity=similarity)
            if not found:
                return None
            ends = ident[np.array(found)]
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=LINKS)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], last)) + 1
            at = 0
            for e in ends:
                if e - at >= BLOCK or (last and e == len(key)):
                    if (out := give(key[at:e], *(x[at:e] for x in rest))) is not None:
                        yield out
                    at = e
            held[:] = [(key[at:], *(x[at:] for x in rest))]

        for batch in batches:
            fp = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
            held.append((batch.column("list").to_numpy(), batch.column("id").to_numpy(), fp, *(batch.column(x).to_numpy() for x in extra)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield from cut(False)
        if held:
            yield from cut(True)

    return run


def compared(listed: DataFrame, radius: int, words: list[str], extra: list[str] | None = None, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) between ids of rows (list, id, words..., extra...) that share a list and differ in at most `radius`
    bits: those of a spanning forest of every list. extra may name set sizes, which then must allow the similarity."""
    extra = extra or []
    long = materialize(listed.groupBy("list").count().filter(F.col("count") > LIST).select("list", F.ceil(F.col("count") / LIST).cast("int").alias("parts")), "simhash-long")
    if not long.isEmpty():
        # each pair of parts is a list; a row goes to every pair that holds its part
        own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
        pair = F.xxhash64("list", F.least(own, F.col("other")), F.greatest(own, F.col("other")))
        spread = attach(listed, long, ["list"], "left")
        others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        listed = spread.withColumn("other", F.explode(others)).withColumn("list", F.when(F.col("parts").isNull(), F.col("list")).otherwise(pair))
    dealt = listed.select("list", "id", *words, *extra).repartition("list").sortWithinPartitions("list")
    return dealt.mapInArrow(_compare(radius, words, extra, similarity), "a long, b long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column fp."""
    kept = masks(classes.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(kept)])
    return compared(classes.select(F.col("fp").alias("id"), "fp", F.explode(keys).alias("list")), radius, ["fp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) can reach. Every round passes labels along
    edges, to the other end and to its label, and then replaces each label by that label's own; rounds grow with the
    logarithm of the longest chain. Tables stay in the shared folder between rounds."""
    both = materialize(edges.union(edges.select("b", "a")).filter("a != b").distinct(), "cc-edges")
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        ends = both.join(state.select(F.col("node").alias("a"), F.col("label").alias("from")), "a").join(state.select(F.col("node").alias("b"), F.col("label").alias("to")), "b")
        told = ends.filter(F.col("from") < F.col("to")).select(F.explode(F.array("b", "to")).alias("node"), "from")
        least = told.groupBy("node").agg(F.min("from").alias("least"))
        fresh = materialize(state.join(least, "node", "left").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was")), "cc-round")
        jump = fresh.select(F.col("node").alias("label"), F.col("label").alias("next"))
        state = materialize(fresh.join(jump, "label", "left").select("node", F.least("label", "next").alias("label"), "was"), "cc-labels")
        if state.filter("label != was").isEmpty():
            return state.select("node", "label")
        state = state.select("node", "label")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), in the shared folder; the texts are not needed any more."""
    bound_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", fingerprint("text").alias("fp")), "simhash-fp")


def classes_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of the fingerprints that more than one row or any link has."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = components(materialize(links(classes.select("fp"), radius), "simhash-links"))
    return component_ids(classes.withColumnRenamed("fp", "id"), found).withColumnRenamed("id", "fp")


def near_dups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints = fingerprints(docs)
    known = classes_of(prints, radius)
    joined = attach(prints, known, ["fp"], "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


# -- similarity ------------------------------------------------------------------------------------------------------

#: Shingles of near copies in the pipeline, their least similarity (Jaccard), words of 64 bits in a fingerprint and
#: lists a document is in.
WIDE_SHINGLE, SIMILARITY, WIDE, LISTS = 5, 0.8, 4, 8
#: Standard deviations of differing bits by which pairs may exceed what is expected at the least similarity: in the round
#: that joins most of each group, and in the one that sees all other pairs.
NEAR, WIDEST = 1.6, 5.0
#: Shingles in one part of a long list, so that a task holds the sets of two parts.
PART_SHINGLES = 1 << 21

PRINT_WORDS = [f"f{i}" for i in range(WIDE)]
#: Two of the list keys in each, 32 bits of either.
KEY_WORDS = [f"k{i}" for i in range(LISTS // 2)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of 64-bit hashes of h (the finaliser of SplitMix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of one whole text, none for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    spans = [(0, len(joined))] if len(words) <= shingle else zip(starts, ends[shingle - 1 :], strict=False)
    return np.unique(np.array([one(joined[a:b], SEED) for a, b in spans], np.uint64))


def set_id(h: np.ndarray) -> int:
    """One signed 64-bit name for a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)).view(np.int64))


def wide_print(text: str | None, shingle: int = WIDE_SHINGLE) -> tuple[list[int], list[int], int, int]:
    """(WIDE words of the fingerprint, LISTS keys, name of the shingle set, its size) of one whole text. A key is the
    least of a hash over the shingles, so that texts of similarity s share each key with probability s. A text without
    words has zeros."""
    h = shingle_set(text, shingle)
    if not len(h):
        return [0] * WIDE, [0] * LISTS, set_id(h), 0
    fp = []
    for k in range(WIDE):
        ones = np.unpackbits(mixed(h, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        fp.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return fp, [int(mixed(h, WIDE + t).min().view(np.int64)) for t in range(LISTS)], set_id(h), len(h)


WIDE_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in PRINT_WORDS] + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("id", T.LongType()), T.StructField("size", T.LongType())])
WIDE_ARROW = pa.struct([(f, pa.int64()) for f in PRINT_WORDS] + [("keys", pa.list_(pa.int64())), ("id", pa.int64()), ("size", pa.int64())])


@F.arrow_udf(WIDE_TYPE)
def wide_fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([dict(zip(WIDE_ARROW.names, (*fp, *rest), strict=True)) for fp, *rest in map(wide_print, texts.to_pylist())], WIDE_ARROW)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        yield pa.record_batch([pa.array([set_id(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["id", "set"])


def wide_radius(similarity: float, deviations: float) -> int:
    """Differing bits allowed for a Jaccard similarity: as many as are expected (sets of similarity s have cosine
    2 s / (1 + s)), and some standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set): the shingle sets of some classes, made again from the text of one row of each."""
    wanted = materialize(classes.join(ids.select("id").distinct(), "id", "left_semi").select("row"), "simhash-wanted")
    texts = attach(docs.select("text", row_key().alias("row")), wanted, ["row"], "left_semi").select("text")
    return materialize(texts.mapInArrow(_sets, "id long, set array<long>").dropDuplicates(["id"]), "simhash-sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of shingle sets whose Jaccard similarity is reached; for the links of forests, which are no
    more than the rows of the lists."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), classes, docs)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = shared / (F.size("sa") + F.size("sb") - shared) >= F.lit(similarity)
    return materialize(both.filter(exact).select("a", "b"), "simhash-links")


def parted(listed: DataFrame) -> DataFrame:
    """Rows (list, id, size, ...) with lists of more than LIST rows or PART_SHINGLES shingles cut into parts: every pair
    of parts is a list of its own. part is 0 or 1 there, and only rows of different parts are compared; it is -1 where
    all rows are."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / LIST), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int")
    long = materialize(listed.groupBy("list").agg(parts.alias("parts")).filter("parts > 1"), "simhash-long")
    if long.isEmpty():
        return listed.withColumn("part", F.lit(-1))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    whole = F.col("parts").isNull() | (own == F.col("other"))
    pair = F.when(F.col("parts").isNull(), F.col("list")).otherwise(F.xxhash64("list", F.least(own, F.col("other")), F.greatest(own, F.col("other"))))
    spread = attach(listed, long, ["list"], "left").withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return spread.withColumns({"part": F.when(whole, -1).otherwise((own > F.col("other")).cast("int")), "list": pair}).drop("other", "parts")


class Block:
    """Rows of whole lists, to be compared: every pair of rows of one list that no earlier list of the two holds."""

    def __init__(self, rows: pa.Table, radius: int, similarity: float):
        column = lambda c: rows.column(c).to_numpy()
        self.rows, self.radius, self.similarity = rows, radius, similarity
        self.list, self.size, self.part, self.t = column("list"), column("size"), column("part"), column("t")
        self.label = np.unique(column("label"), return_inverse=True)[1]
        self.prints = np.stack([column(w).view(np.uint64) for w in PRINT_WORDS], axis=1)
        self.keys = np.stack([column(w) for w in KEY_WORDS], axis=1).view(np.uint32)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each row i the rows j > i that it is to be compared with and that the fingerprints do not rule out."""
        for i, js in close_pairs(self.prints, self.radius):
            js = js[(self.list[js] == self.list[i]) & (self.label[js] != self.label[i]) & ((self.part[js] < 0) | (self.part[js] != self.part[i]))]
            js = js[alike(self.size[i], self.size[js], self.similarity)]
            if len(js):
                js = js[(self.keys[js] == self.keys[i]).argmax(axis=1) == self.t[i]]
            if len(js):
                yield i, js

    def candidates(self) -> pa.Table | None:
        """The rows that have a partner."""
        hit = np.zeros(len(self.list), bool)
        for i, js in self.pairs():
            hit[i] = hit[js] = True
        return self.rows.filter(pa.array(hit)) if hit.any() else None

    def links(self) -> pa.Table | None:
        """A forest of the pairs whose shingle sets reach the similarity."""
        sets = self.rows.column("set").combine_chunks()
        flat, ends = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1], np.concatenate([[0], np.cumsum(self.size)])
        ids, found, mark = self.rows.column("id").to_numpy(), [], np.zeros(len(flat) + 1, bool)
        for i, js in self.pairs():  # which sees the labels as they are changed here
            own = flat[ends[i] : ends[i + 1]]
            mark[own] = True
            for at in range(0, len(js), 256):
                few = js[at : at + 256]
                few = few[self.label[few] != self.label[i]]
                if not len(few):
                    continue
                starts = np.concatenate([[0], np.cumsum(self.size[few])])
                places = np.arange(starts[-1]) + np.repeat(ends[few] - starts[:-1], self.size[few])
                shared = np.add.reduceat(mark[flat[places]], starts[:-1], dtype=np.int64)
                for j in few[shared / (self.size[i] + self.size[few] - shared) >= self.similarity]:
                    a, b = self.label[i], self.label[j]
                    if a != b:
                        self.label[self.label == max(a, b)] = min(a, b)
                        found.append((int(ids[i]), int(ids[j])))
            mark[own] = False
        return pa.table(dict(zip("ab", map(list, zip(*found, strict=True)), strict=True)), schema=LINKS) if found else None


def _by_list(radius: int, similarity: float, what: str):
    """Batches sorted by list to what Block gives for whole lists, packed into blocks of BLOCK rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def give(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and (out := getattr(Block(rows, radius, similarity), what)()) is not None:
                yield from out.to_batches(max_chunksize=1024)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            key = batch.column("list").to_numpy()
            last = int((key == key[-1]).argmax())  # where the last list begins
            if last == 0 and len(held) > 1 and held[-2].column("list")[-1].as_py() != key[0]:
                cut = len(batch)
            else:
                cut = len(batch) - last if last else n
            if n - cut >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield from give(rows.slice(0, n - cut))
                held, n = rows.slice(n - cut).to_batches(), cut
        if held:
            yield from give(pa.Table.from_batches(held))

    return run


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, row, id), (id, row, ...), (node, label)): documents with their class, which is an equal shingle set,
    the classes, and the components of linked classes.

    The first round verifies a spanning forest of the nearest pairs of every list, which joins most of each group of
    copies. In the second every list compares its fingerprints between components; rows with a partner come back to the
    list with their shingle sets, and the list decides there, so that no pair of a group is ever a row."""
    bound_batches(docs.sparkSession)
    prints = materialize(docs.select("doc_id", row_key().alias("row"), wide_fingerprint("text").alias("s")).select("doc_id", "row", "s.*"), "simhash-wide")
    classes = materialize(prints.groupBy("id").agg(F.min("row").alias("row"), *[F.min(w).alias(w) for w in (*PRINT_WORDS, "size", "keys")]), "simhash-classes")
    low = lambda i: F.col("keys")[i].bitwiseAND(F.lit(0xFFFFFFFF))
    packed = [low(2 * i).bitwiseOR(F.shiftleft(low(2 * i + 1), 32)).alias(w) for i, w in enumerate(KEY_WORDS)]
    listed = classes.filter("size > 0").select("id", "size", *PRINT_WORDS, *packed, F.posexplode("keys").alias("t", "k")).withColumn("list", F.xxhash64("t", "k")).drop("k")
    near = verified(compared(listed, wide_radius(similarity, NEAR), PRINT_WORDS, ["size"], similarity), classes, docs, similarity)
    joined = components(near).withColumnRenamed("node", "id")
    labelled = parted(attach(listed, joined, ["id"], "left").withColumn("label", F.coalesce("label", "id")))
    radius = wide_radius(similarity, WIDEST)
    columns = ["list", "id", "size", "part", "t", "label", *PRINT_WORDS, *KEY_WORDS]
    dealt = labelled.select(columns).repartition("list").sortWithinPartitions("list")
    marked = materialize(dealt.mapInArrow(_by_list(radius, similarity, "candidates"), dealt.schema), "simhash-marked")
    again = marked.join(sets_of(marked, classes, docs), "id").select(*columns, "set").repartition("list").sortWithinPartitions("list")
    far = materialize(again.mapInArrow(_by_list(radius, similarity, "links"), "a long, b long"), "simhash-links")
    return prints, classes, components(near.unionByName(far))


def component_ids(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component_id) from classes (id, rep, n) and labels (node, label)."""
    joined = classes.select("id", "rep", "n").join(found, classes["id"] == found["node"], "left").withColumn("label", F.coalesce("label", "id")).filter("n > 1 or node is not null")
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    return materialize(joined.join(least, "label").select("id", "component_id"), "simhash-components")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of similar ones: that with the least doc_id (null after all others, then by a hash of
    the text); of rows that repeat its doc_id and text, one.

    Two documents are linked if the Jaccard similarity of their shingle sets is reached, and a group is all that links
    join. Pairs are looked for among documents that share one of LISTS least shingle hashes and whose wide fingerprints
    are not far apart; at similarity 0.8 both together miss fewer than one pair in 100,000 (texts of under ten words,
    where bits are coarser: one in 10,000)."""
    prints, classes, found = similar_classes(docs, similarity)
    label = F.coalesce("label", "id").alias("label")
    rows = materialize(attach(prints.select("doc_id", "row", "id"), found.withColumnRenamed("node", "id"), ["id"], "left").select("doc_id", "row", label), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = materialize(rows.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", "first"), "simhash-groups")
    judged = attach(rows, groups, ["label"], "inner")
    gone = materialize(judged.filter(order != F.col("first")).select(F.col("doc_id").alias("__sh_id"), F.col("row").alias("__sh_row")).distinct(), "simhash-gone")
    again = materialize(judged.filter(order == F.col("first")).groupBy("doc_id", "row").count().filter("count > 1").select(F.col("doc_id").alias("__sh_id"), F.col("row").alias("__sh_row")), "simhash-again")

    def among(df: DataFrame, table: DataFrame, how: str) -> DataFrame:
        same = df["doc_id"].eqNullSafe(table["__sh_id"]) & (F.xxhash64(df["doc_id"], df["text"]) == table["__sh_row"])
        return df.join(F.broadcast(table) if small(table) else table, same, how)

    left = among(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    once = among(left, again, "left_semi").withColumn("__sh_text", F.sha2("text", 256)).dropDuplicates(["doc_id", "__sh_text"]).drop("__sh_text")
    return among(left, again, "left_anti").unionByName(once)
