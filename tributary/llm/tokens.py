"""Token counts by a two-tier lookup of pre-token lengths.

A byte-level BPE encodes each pre-token on its own, so a text's count is the
sum of its pre-tokens' lengths in tokens. Tier one is a broadcast hash table of
the lengths of the most frequent pre-tokens. It is fitted on a bounded sample
of rows (FIT_ROWS rows of at most FIT_CHARS / 100 characters, those whose text
hashes lowest, at most FIT_CHARS characters in all); counts are exact whatever
it holds, it only decides what the workers need not encode. Tier two is a cache
in each worker, bounded in bytes: pre-tokens that are in neither are encoded in
one batch, and their lengths are kept. No pre-token is ever shuffled.

Workers also remember sums of lengths: texts are cut before every space that
follows a character other than white space, where the pre-tokeniser always
begins a pre-token, and the stretches between (a word with its punctuation) are
taken apart once. Neither stretches nor pre-tokens of more than LONGEST
characters are kept (texts without spaces).

Defined cases: null counts as the empty text (0 bytes, 0 tokens); special
strings inside a text are special tokens, as by the library's default; repeated
rows each get their row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import collections
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lowest

#: Pre-tokens in the broadcast table, and characters of the longest that is kept anywhere.
FREQUENT, LONGEST = 40_000, 40
#: Rows that the table is fitted on, and their characters.
FIT_ROWS, FIT_CHARS = 2000, 4_000_000
#: Bytes that a worker's cache may hold before it is begun anew, and those of an entry besides its characters.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 160
MAX_TOKENS = 1024

#: Pre-tokens of the byte-level pre-tokeniser (public GPT-2 pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def frequent(docs: DataFrame, rows: int = FIT_ROWS) -> list[str]:
    """The most frequent pre-tokens of the fitted rows: at most FREQUENT strings."""
    import regex

    sample = lowest(docs.select("text").filter(f"length(text) between 1 and {FIT_CHARS // 100}"), [F.col("text")], rows)
    seen: collections.Counter[str] = collections.Counter()
    chars, find = 0, regex.compile(PATTERN).findall
    for r in sample:
        chars += len(r["text"])
        if chars > FIT_CHARS:
            break
        seen.update(p for p in find(r["text"]) if len(p) <= LONGEST)
    return [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


class Cache:
    """Lengths by string, begun anew when they take more than `most` bytes; strings over LONGEST are not kept."""

    def __init__(self, most: int):
        self.most, self.bytes, self.kept = most, 0, {}

    def put(self, key: str, length: int) -> None:
        if len(key) <= LONGEST:
            self.kept[key] = length
            self.bytes += ENTRY_BYTES + 4 * len(key)

    def room(self) -> None:
        """Called between texts, when no length is waited for."""
        if self.bytes > self.most:
            self.kept, self.bytes = {}, 0


class Counter:
    """Counts tokens of texts with one tokenizer file; `table` holds the lengths of frequent pre-tokens."""

    def __init__(self, path: str, table: dict[str, int] | None = None, cache_bytes: int = CACHE_BYTES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("token counts by pre-token need a plain byte-level BPE tokenizer")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space or word bounds are not supported")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.find = regex.compile(PATTERN).findall
        self.table = table or {}
        self.stretches, self.pre = Cache(cache_bytes // 2), Cache(cache_bytes // 2)

    def lengths(self, pre_tokens: set[str]) -> dict[str, int]:
        """Tokens of pre-tokens that are in neither tier, encoded in one batch, and kept from now on."""
        new = sorted(pre_tokens)
        fresh = {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)} if new else {}
        for p, n in fresh.items():
            self.pre.put(p, n)
        return fresh

    def sums(self, stretches: set[str]) -> dict[str, int]:
        """Tokens of new stretches, by their pre-tokens."""
        table, known = self.table, self.pre.kept
        parts = {s: self.find(s) for s in stretches}
        fresh = self.lengths({p for ps in parts.values() for p in ps if p not in table and p not in known})
        out = {s: sum([table[p] if p in table else known[p] if p in known else fresh[p] for p in ps]) for s, ps in parts.items()}
        for s, n in out.items():
            self.stretches.put(s, n)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        cut = [self.cut(t or "") for t in texts]
        cache = self.stretches.kept
        fresh = self.sums({s for _, ss in cut for s in ss if s not in cache})
        out = [n + sum([cache[s] if s in cache else fresh[s] for s in ss]) for n, ss in cut]
        self.stretches.room()
        self.pre.room()
        return out

    def cut(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in the text, and its stretches, each with the white space before it."""
        n, plain = 0, [text]
        if self.special and self.special.search(text):
            plain = self.special.split(text)
            n = len(plain) - 1
        out: list[str] = []
        for part in plain:
            if not part:
                continue
            pieces = part.split(" ")
            held = pieces[0]
            for p in pieces[1:]:
                if held and not held[-1].isspace():
                    out.append(held)
                    held = f" {p}"
                else:  # a space after white space (or at the start): the cut cannot be here
                    held = f"{held} {p}"
            if held:
                out.append(held)
        return n, out


_COUNTERS: dict[str, Counter] = {}


def worker_counter(name: str, path: str, table: Broadcast) -> Counter:
    """The worker's counter, kept from task to task; one at a time. Workers must import this function, for state that
    a nested function refers to would be made anew in every task."""
    if name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[name] = Counter(path, table.value)
    return _COUNTERS[name]


def groups(texts: list[str | None], chars: int = 1 << 20, rows: int = 256) -> Iterator[list[str | None]]:
    """Texts in groups of at most so many rows, and of so many characters unless a text is longer."""
    held, n = [], 0
    for t in texts:
        if held and (len(held) == rows or n + len(t or "") > chars):
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t or "")
    if held:
        yield held


def token_counts(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit. `path` is a tokenizer file that all workers see."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Counter(path).lengths(set(frequent(docs))))  # at most FREQUENT short strings
    name = f"{path}#{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(name, path, shared)
        for batch in batches:
            counts = [n for g in groups(batch.column("text").to_pylist()) for n in counter.count(g)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
