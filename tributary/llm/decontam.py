"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a document by up to budget = n // 5
words (inserted, deleted or replaced). Split into budget + 1 pieces, at least
one piece of it then occurs unchanged: an Aho-Corasick automaton over all
pieces finds these hits, and Myers' bit-parallel distance, with words as the
alphabet and whole items as patterns, verifies the words around the hits, each
word of the text at most once an item. Items are broadcast in blocks of bounded
size, BLOCKS of them in one pass over all documents; documents are never
shuffled.

Words are compared in lower case and without ASCII punctuation; every character
of a script that is written without spaces is a word.

Defined cases: null and empty texts match nothing; an item without words
matches nothing; an item of fewer than five words has no budget and matches
where its words stand exactly, so a benchmark should not hold items that are
common phrases; items with equal or null ids each match; repeated documents
each get their rows; the matches of an item in a text count once, by the least
distance, then the earliest end; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: One edit is allowed for so many words of an item.
WORDS_PER_EDIT = 5
#: Characters of items in a block, and blocks searched in one pass.
BLOCK_CHARS, BLOCKS = 2_000_000, 4

HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]))

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts without spaces between words: Thai to Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Lower case, ASCII punctuation and white space as single spaces, characters of unspaced scripts apart."""
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return b" ".join(text.encode(errors="replace").translate(_PLAIN).split()).decode()


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of nearly equal length."""
    cuts = [n_words * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """Least edits between the whole pattern and some stretch of text ending at each word of text (Myers 1999)."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = masks.get(w, 0)
        vert = eq | minus
        horiz = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horiz | plus) & full)
        down = plus & horiz
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # the row above costs nothing: a match may begin anywhere
        down = (down << 1) & full
        plus = down | (~(vert | up) & full)
        minus = up & vert
        out.append(score)
    return out


class Items:
    """The pieces of one block of items and the search of a text for them."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        import ahocorasick

        self.items, at = [], {}
        for item_id, text in rows:
            words = normal(text).split()
            if not words:
                continue
            k = len(self.items)
            budget = len(words) // WORDS_PER_EDIT
            self.items.append((item_id, words, budget))
            for a, b in pieces(len(words), budget):
                at.setdefault(f" {' '.join(words[a:b])} ", []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.any = bool(at)
        if self.any:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, first word, last word) of the best match of each item found."""
        plain = normal(text)
        if not plain or not self.any:
            return []
        padded, spaces = f" {plain} ", array("l")
        begins: dict[int, set[int]] = {}  # item to the words where it would begin without an edit
        for end, (size, places) in self.automaton.iter(padded):
            if not spaces:
                spaces.extend(m.start() for m in re.finditer(" ", padded))
            word = bisect_left(spaces, end - size + 1)
            for k, offset in places:
                begins.setdefault(k, set()).add(word - offset)
        found = []
        words = plain.split(" ") if begins else []
        for k in sorted(begins):
            item_id, pattern, budget = self.items[k]
            best = None
            for lo, hi in self.windows(sorted(begins[k]), len(pattern), budget):
                scores = myers(pattern, words[lo:hi])
                least = min(scores)
                if least <= budget and (best is None or least < best[0]):
                    best = (least, lo, lo + scores.index(least))
            if best:
                least, lo, last = best
                back = myers(pattern[::-1], words[max(lo, last + 1 - len(pattern) - budget) : last + 1][::-1])
                found.append((item_id, least, last - back.index(least), last))
        return found

    @staticmethod
    def windows(begins: list[int], n: int, budget: int) -> Iterator[tuple[int, int]]:
        """Stretches of words that hold every match around these begins; those that meet are one."""
        lo, hi = max(0, begins[0] - budget), begins[0] + n + budget
        for b in begins[1:]:
            if b - budget > hi:
                yield lo, hi
                lo = b - budget
            hi = b + n + budget
        yield lo, hi


_BUILT: dict[str, Items] = {}


def worker_items(name: str, block: Broadcast) -> Items:
    """The worker's automaton of a block, kept from task to task; those of one pass at a time."""
    if name not in _BUILT:
        run = name.split("/")[0]
        for old in [x for x in _BUILT if x.split("/")[0] != run]:
            del _BUILT[old]
        _BUILT[name] = Items(pickle.loads(block.value))
    return _BUILT[name]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded size; the driver holds the blocks of one pass at a time."""
    rows, chars = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator():
        rows.append((r[0], r[1]))
        chars += len(r[1])
        if chars >= BLOCK_CHARS:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


def matcher(rows: list[tuple[int | None, str]], run: str, spark):
    """A column function: text to the array of HITS against one block of items."""
    block, name = spark.sparkContext.broadcast(pickle.dumps(rows)), f"{run}/{uuid.uuid4().hex}"

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        items = worker_items(name, block)
        out = [[dict(zip(("item_id", "distance", "first_word", "last_word"), h, strict=True)) for h in items.search(t)] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])))

    return hits


def passes(benchmark: DataFrame) -> Iterator[Callable[[Column], Column]]:
    """Column functions, each text to its hits among the items of BLOCKS blocks."""
    for blocks in batched(_blocks(benchmark), BLOCKS):
        run = uuid.uuid4().hex
        each = [matcher(rows, run, benchmark.sparkSession) for rows in blocks]
        yield lambda text, each=each: F.concat(*[F.coalesce(m(text), F.array().cast(HITS)) for m in each])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, distance (words), first_word and last_word of
    the match in the document's normalised words."""
    bound_batches(docs.sparkSession)
    base = docs.select("doc_id", "text").filter("text is not null")
    out = base.select("doc_id", F.explode(F.array().cast(HITS)).alias("h")).select("doc_id", "h.*")
    parts = [base.select("doc_id", F.explode(hits(F.col("text"))).alias("h")).select("doc_id", "h.*") for hits in passes(benchmark)]
    for k, part in enumerate(parts):
        out = part if k == 0 else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    bound_batches(docs.sparkSession)
    for hits in passes(benchmark):
        flagged = docs.select("*", F.size(hits(docs["text"])).alias("__dc_hits"))
        docs = flagged.filter("__dc_hits = 0").select(*[flagged[f"`{c}`"] for c in docs.columns])
    return docs
