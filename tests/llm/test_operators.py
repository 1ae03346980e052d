"""The training-data operators against brute force and SQL, and on odd rows."""

import base64
import hashlib
import os
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import chat, decontam, html, langid, linededup, mixing, quality, queries, simhash, tokens, warc
from tributary.llm import common
from tributary.llm.common import scratch_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h1 string, copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t\n \x0b", "en", "a"),
    (4, "one two", "en", "a"),
    (4, "one two", "en", "a"),
    (None, "one two three four five six", "xx", None),
    (5, LONG, "en", "b"),
    (6, LONG + " tail", "en", "b"),
    (7, "a\nb\nc\nd\n\n\n\na\nb\nc\nd", "de", "c"),
    (8, "x\na\nb\nc\nd", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, None, 3, "clash", "clash") for i, t, lang, s in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        p = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    flat = lambda x: sorted(x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None), key=repr)
    assert flat(got) == flat(want)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_entry(spark, docs, name):
    """What the registered queries return that SQL cannot say: their columns, a row for each row, and what each must hold."""
    out = queries.queries()[name](spark, DATA)
    rows = out.collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    n_docs, n_pages = docs.count(), pages.count()
    columns = {
        "op1_decontamination": ["doc_id", "item_id", "distance", "first_word", "last_word"],
        "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"],
        "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op6_language_id": ["kind", "doc_id", "page_id", "lang", "probability", "text_lang", "declared", "address"],
        "op7_html_extraction": ["page_id", "url", "text", "n_chars"],
        "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    assert out.columns == columns[name]
    if name == "op1_decontamination":
        bench, own = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}, texts(docs)
        exact = {(d, i) for d, t in own.items() for i, item in bench.items() if f" {item} " in f" {decontam.normal(t)} "}
        assert exact and {(r.doc_id, r.item_id) for r in rows if r.distance == 0} == exact
        return
    assert len(rows) == {"op6_language_id": n_docs + n_pages, "op7_html_extraction": n_pages}.get(name, n_docs)
    if name == "op7_html_extraction":
        whole = {r.page_id: r.html for r in pages.collect()}
        assert all(r.n_chars == len(r.text) and r.text == html.main_text(whole[r.page_id]) for r in rows)
    if name == "op10_simhash":
        own = texts(docs)
        assert all(r.fingerprint == f"{slow_print(own[r.doc_id]):016x}" and r.component_id <= r.doc_id for r in rows)
    if name == "op4_quality_rules":
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts_[r.doc_id]) for texts_ in [texts(docs)] for r in rows)
        assert 0 < sum(r.kept for r in rows) < len(rows)


# -- 1 -----------------------------------------------------------------------------------------------------------------


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 17)))) for i in range(60)] + [(90, ""), (91, None), (92, "Hello, World!"), (None, "no id here at all"), (93, "漢字の問題文です。次")]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(80)] + [(200, "hello world"), (201, "say hello world"), (202, None), (203, "x no id here at all y"), (204, "これは漢字の問題文です。次に")]
    rows += [(205, "hello-world"), (205, "hello-world"), (None, "hello world"), (206, "helloworld")]
    want = Counter()
    for d, t in rows:
        for i, item in items:
            a, b = decontam.normal(item).split(), decontam.normal(t).split()
            if a and b and edits(a, b) <= len(a) // 5:
                want[d, i, edits(a, b)] += 1
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, h int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_CHARS, 150):  # one block, and several passes of several
        monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
        found = decontam.contaminated(df, bench).collect()
        assert Counter((r.doc_id, r.item_id, r.distance) for r in found) == want
        for r in found:  # the place is where it says
            a = next(decontam.normal(t).split() for i, t in items if i == r.item_id)
            places = [decontam.normal(t).split()[r.first_word : r.last_word + 1] for d, t in rows if d == r.doc_id]
            assert any(edits(a, p) == r.distance and edits(p, a) <= r.distance for p in places)
        assert Counter(r.doc_id for r in decontam.clean(df, bench).collect()) == Counter(d for d, _ in rows) - Counter({d: 9 for d, _, _ in want})
    assert (201, 92, 0) in want and (203, None, 0) in want and (204, 93, 0) in want and want[205, 92, 0] == 2 and (206, 92, 0) not in want
    monkeypatch.undo()
    assert decontam.clean(df, bench).columns == df.columns
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
    flagged = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(texts(docs)) - flagged


def test_decontamination_takes_linear_time():
    items = decontam.Items([(1, "a b c d e f g h i j"), (2, "a a a a a a a a a a a a"), (3, "b a")])
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert [x[0] for x in items.search("a b " * n)] == [3] and [x[0] for x in items.search("a " * n)] == [2]
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 1


# -- 2 -----------------------------------------------------------------------------------------------------------------


def test_line_dedup(odd):
    got = {(r.doc_id, r.text): r.lines_removed for r in linededup.dedup_lines(odd).collect()}
    assert got[7, "a\nb\nc\nd\n\n\n"] == 4
    assert got[8, "x"] == 4 and got[4, "one two"] == 0 and got[1, None] == 0
    assert linededup.dedup_lines(odd).count() == len(ODD) and linededup.dedup_lines(odd.limit(0)).count() == 0
    assert linededup.dedup_lines(odd).columns[:8] == odd.columns


def removed_by_hand(rows):
    """[(id, text)] to the texts left, by walking documents in order of id."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" \t\r\x0b\x0c"):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if t is not None else None, len(gone)))
    return out


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_line_dedup_by_hand(spark, monkeypatch, bound):
    """A passage in a third of all documents, shared lines, long texts, clashing names; broadcast and shuffled."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(6)
    licence = "\n".join(f"licence line {k}" for k in range(8))
    rows = [(i, "\n".join(str(x) for x in rng.integers(0, 9, rng.integers(0, 30)))) for i in range(200)]
    rows += [(1000 + i, f"own {i}\n{licence}\nend {i}") for i in range(300)] + [(5000, "\n".join(f"l{k}" for k in range(40_000))), (5001, "\n".join(f"l{k}" for k in range(20_000))), (6000, None), (6001, ""), (6002, "\n\n\n\n")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lines_removed int, gone string")
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "gone", "lines_removed"]
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in out.filter("text is not null").collect()) == sorted(r for r in removed_by_hand(rows) if r[1] is not None)


# -- 3 -----------------------------------------------------------------------------------------------------------------


def test_reply_tree(spark):
    rows = [
        ("t", 1, None, "user", "q </turn>\n<turn> &lt;", 0.0), ("t", 2, 1, "assistant", "good & é", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", None, 1.0),
        ("u", 5, 9, "user", "orphan", 0.0), ("u", 6, 7, "a\nb", "missing parent", 0.0), (None, 1, 1, "assistant", "own parent", None),
    ]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    out = {(r.tree, r.rank): r for r in chat.read_back(chat.format_paths(df)).collect()}
    assert [tuple(x) for x in out["t", 1].turns] == [("user", "q </turn>\n<turn> &lt;"), ("assistant", "good & é"), ("user", "")]
    assert [tuple(x) for x in out["t", 2].turns][1] == ("assistant", "bad") and out["t", 1].loss_text == "good & é"
    assert {tuple(out["u", k].turns[0]) for k in (1, 2)} == {("user", "orphan"), ("a\nb", "missing parent")} and out[None, 1].loss_text == "own parent"
    assert chat.format_paths(df, best=1).count() == 3 and chat.format_paths(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_reply_trees_by_hand(spark, monkeypatch, bound):
    """A tree with very many leaves over several ranges, ids in any order, circles, ties, repeated ids, clashing names."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(8)
    rows = [("hot", "r", None, 0.0)] + [("hot", f"m{i}", "r" if i < 5 else f"m{rng.integers(0, i)}", float(rng.integers(0, 4))) for i in range(400)]
    rows += [("rev", str(9 - i), str(10 - i) if i else None, 1.0) for i in range(6)]  # parents have later ids
    rows += [("ring", x, y, 1.0) for x, y in ("ab", "bc", "ca", "da", "ed")] + [("self", "s", "s", None), ("twice", "t", None, 1.0), ("twice", "t", None, 2.0)]
    df = spark.createDataFrame([(t, i, p, "user", f"say {i}", s, 7, "x") for t, i, p, s in rows], "tree string, id string, parent string, role string, text string, score double, rank int, leaf string")
    parent, score = {}, {}
    for t, i, p, s in rows:
        parent[t, i], score[t, i] = p if p != i else None, max(s or 0.0, score.get((t, i), 0.0))
    parent["ring", "a"] = parent["ring", "b"] = None  # the links of the circle to later ids
    want = {}
    for t in {t for t, _ in parent}:
        inner = {p for (u, _), p in parent.items() if u == t and p}
        paths = []
        for i in (i for u, i in parent if u == t and i not in inner):
            path = [i]
            while parent[t, path[-1]]:
                path.append(parent[t, path[-1]])
            paths.append((-sum(score[t, x] for x in path) / len(path), i, path[::-1]))
        want |= {(t, k + 1): [f"say {x}" for x in path] for k, (_, _, path) in enumerate(sorted(paths))}
    out = chat.read_back(chat.format_paths(df)).collect()
    assert {(r.tree, r.rank): [x.text for x in r.turns] for r in out} == want and len(out) == len(want)
    assert {(r.tree, r.rank) for r in chat.format_paths(df, best=3).collect()} == {k for k in want if k[1] <= 3}


# -- 4 -----------------------------------------------------------------------------------------------------------------


def counts(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    c = Counter(windows)
    hit = {j + k for j, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, odd, docs):
    for df in (odd, docs):
        for r in quality.score(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            own = counts(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
            assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality.score(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in judged if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in judged)
    assert sum(r.quality == 0 for r in judged) > 2 and not any(r.kept for r in judged if r.quality == 0)
    one_bad_vote = quality.score(docs).filter("kept and (n_words < 100 or n_dup_lines * 10 > n_words)").count()
    assert one_bad_vote > 5  # not all-must-pass
    kept = {r.doc_id for r in quality.score(docs).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    assert quality.score(odd.limit(0)).count() == 0 and quality.keep_good(odd).columns == odd.columns


def test_quality_fit_recovers_accuracies():
    """Votes drawn with known, unequal accuracies: they are found, and the posterior beats all-must-pass."""
    rng = np.random.default_rng(9)
    n = len(quality.RULES)
    bad_on_bad = np.array([0.9, 0.7, 0.6, 0.3, 0.5, 0.2, 0.8, 0.4])[:n]
    bad_on_good = np.array([0.02, 0.2, 0.01, 0.25, 0.05, 0.2, 0.1, 0.3])[:n]
    good = rng.random(40_000) < 0.85
    bad_vote = rng.random((len(good), n)) < np.where(good[:, None], bad_on_good, bad_on_bad)
    votes = np.where(rng.random((len(good), n)) < 0.1, 2, 1 - bad_vote)
    patterns, at, counts = np.unique(votes @ 3 ** np.arange(n), return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts.astype(float), n)
    assert abs(model["share"] - 0.85) < 0.03
    assert np.abs(model["votes"][0, :, 0] - bad_on_bad).max() < 0.08 and np.abs(model["votes"][1, :, 0] - bad_on_good).max() < 0.03
    kept = (quality.posterior(patterns, model, n) >= 0.5)[at]
    assert (kept == good).mean() > 0.95 and ((votes != 0).all(axis=1) == good).mean() < 0.6


# -- 5 -----------------------------------------------------------------------------------------------------------------


def test_tokens(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    alphabet = list("ab c's 12,.\n\t  \u0085\x1c　é漢字😀'll<|endoftext|>") + ["<|endoftext|>", "  ", " \n ", "'ve", "\r\n"]
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    got = tokens.token_counts(df, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and tokens.token_counts(odd.limit(0), path).count() == 0


def test_token_caches_are_bounded():
    """Texts without spaces, and more words than the cache holds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, counter = Tokenizer.from_file(path), tokens.Counter(path, cache_bytes=1 << 20)
    rng = np.random.default_rng(4)
    han = ["".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 20_000, 2000)) for _ in range(200)]
    words = [" ".join(f"w{int(x)}" for x in rng.integers(0, 10**9, 2000)) for _ in range(40)]
    for texts in (han[:100], han[100:], *[words[i : i + 4] for i in range(0, 40, 4)], words[:4]):
        assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        for cache in (counter.stretches, counter.pre):
            assert cache.bytes <= 1 << 19 and sum(map(len, cache.kept)) * 4 <= cache.bytes
    assert sum(map(len, tokens.groups(["x" * 10] * 7 + ["y" * 50, None], chars=30, rows=4))) == 9
    assert [len(g) for g in tokens.groups(["x" * 10] * 7 + ["y" * 50, None], chars=30, rows=4)] == [3, 3, 1, 1, 1]


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_language(spark, docs):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "http://x.de/", "")], "page_id long, url string, html string"))
    out = langid.identify(docs, pages).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    own = [r for r in out if r.kind == "document"]
    assert len(own) == len(lang) and sum(r.text_lang == lang[r.doc_id] for r in own) >= 0.97 * len(own)
    assert {r.page_id: r.lang for r in out if r.kind == "page"}[-2] is not None and len(out) == len(lang) + pages.count()
    assert langid.identify(docs.limit(0), pages).filter("lang is not null").count() == 0


# -- 7 -----------------------------------------------------------------------------------------------------------------


def test_html(spark):
    noise = '<nav><a href=x>Home</a></nav><header>Site</header><div class="cookie-notice">We use</div><form>Name<input></form><aside>Side</aside>'
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{noise}<article><h1>Head&amp;er</h1><p>One  <b>bo</b>ld\n text<br>next<p>Two &lt;b&gt; &eacute;<div class='ad'>Buy</div><section id=comments>Nice</section></article><footer>&copy; me</footer><script>var a='</p>';</script>"
    assert html.main_text(page) == "Head&er One bold text next Two <b> é"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == "" and html.main_text("plain <i>te</i>xt") == "plain text"
    body = lambda i: f"<body><div class=box>Always <i>here</i></div><div class=main><p>Own words {i} of page</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(20)] + [(90, None, None), (91, "http://other.example/", body(0)), (91, "http://other.example/", body(0))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own words 3 of page" and got[90] == "" and got[91] == "Always here Own words 0 of page"


# -- 8 -----------------------------------------------------------------------------------------------------------------


def plain_records(path):
    """A reader of its own: gzip members, header lines as they are, block by Content-Length."""
    import zlib

    data, out = open(path, "rb").read(), []
    while data:
        z = zlib.decompressobj(31)
        raw, data = z.decompress(data) + z.flush(), z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        heads = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(heads["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n"
        out.append((heads, block))
    return out


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_warc(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rows = [(5, "u\r\nx%0A", "é same"), (3, "http://a/x%20y", "é same"), (9, None, None), (2, "v", ""), (None, "n", "z"), (None, "n", "z"), (7, "w", "long " * 50_000), (7, "w", "long " * 50_000), (7, "a", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "key long, url string, payload string, digest string, shard int, first_key string").withColumn("payload", F.col("payload").cast("binary"))
    outs = []
    for _ in range(2):
        base = scratch_path(spark, "warc-test")
        files = warc.write(pages, base, roll_bytes=300, shard_bytes=1000)
        back = warc.read(spark, base)
        outs.append((files, sorted(map(repr, back.collect()))))
    assert outs[0] == outs[1] and len(outs[0][0]) > 2
    got = [(r.key, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert (3, "http://a/x%20y", 7, digest("é same"), "response", None) in got and (5, "u%0D%0Ax%0A", 7, digest("é same"), "revisit", 3) in got
    assert (2, "v", 0, digest(""), "response", None) in got and (9, "urn:none", 0, digest(""), "revisit", 2) in got
    assert sorted(k[1:2] + k[4:] for k in got if k[0] == 7) == [("a", "response", None), ("w", "revisit", 7), ("w", "revisit", 7)] and len(got) == len(rows)
    assert [k[4] for k in got if k[0] is None] == ["response"] * 2
    assert {bytes(r.payload).decode() for r in back.filter("payload is not null").collect()} == {t or "" for _, _, t in rows}
    # what another reader sees
    found = [x for f in outs[0][0] for x in plain_records(f"{base.removeprefix('file://')}/{f['file']}")]
    assert len({h["WARC-Record-ID"] for h, _ in found}) == len(found) == len(rows) + len(outs[0][0])
    responses = {h["WARC-Record-ID"]: (h, b) for h, b in found if h["WARC-Type"] == "response"}
    for h, block in found:
        if h["WARC-Type"] != "warcinfo":
            assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if h["WARC-Type"] == "response":
            assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()).decode()
        if h["WARC-Type"] == "revisit":
            assert responses[h["WARC-Refers-To"]][0]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert {h["WARC-Target-URI"] for h, _ in found if "WARC-Target-URI" in h} == {"u%0D%0Ax%0A", "http://a/x%20y", "urn:none", "v", "n", "w", "a"}
    assert warc.write(pages.limit(0), (base := scratch_path(spark, "warc-none"))) == [] and warc.read(spark, base).count() == 0


def test_warc_least(spark):
    rows = [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "large enough"), (4, "d", "large enough")]
    pages = spark.createDataFrame(rows, "key long, url string, payload string").withColumn("payload", F.col("payload").cast("binary"))
    warc.write(pages, (base := scratch_path(spark, "warc-least")), least=6)
    assert sorted((r.key, r.record_type, r.refers_to) for r in warc.read(spark, base).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


# -- 9 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd):
    rows = [(i, " ".join("w" for _ in range(i % 17)), f"s{i * i % 7}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r.size for r in out)
    by, cut = {}, Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        cut[r.source] += r.taken not in (0, r.size, 2 * r.size)
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(want - 1 <= t <= want + 1e-6 and want <= 2 * size + 1e-6 for t, want, size in by.values()) and max(cut.values()) <= 1
    assert sum(want for _, want, _ in by.values()) == pytest.approx(1.5 * total)
    again = mixing.mix(odd)
    assert again.count() == len(ODD) and sorted(map(repr, again.collect())) == sorted(map(repr, mixing.mix(odd).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_is_nested_and_meets_targets(spark, monkeypatch):
    """A giant among short documents; a third of the rows without an id; equal rows; every join shuffled."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, " ".join(["w"] * (20_000 if i == 11 else 100)), "long") for i in range(200)]
    rows += [(None, f"t{i} " * (i % 9), "none") for i in range(300)] + [(5, "same words " * 10, "same")] * 200 + [(i, "x y z", None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    was = None
    for share in (0.1, 0.2, 0.3, 0.4, 0.9, 1.4):
        now, sums = Counter(), {}
        for r in mixing.mix(df, share=share).collect():
            now[r.doc_id, r.source, r.size] += r.taken
            sums.setdefault(r.source, [0, r.target])[0] += r.taken
        assert all(want - (200 if s == "same" else 1) <= got <= want + 1e-6 for s, (got, want) in sums.items()), sums
        assert was is None or all(now[k] >= n for k, n in was.items())
        was = now
    taken = mixing.mixed_documents(df.withColumns({"size": F.lit("clash"), "__h2": F.lit(1)}))
    assert taken.columns == ["doc_id", "text", "source", "__h2", "size", "source_size", "target", "taken", "copies"]
    assert taken.agg(F.sum("taken")).first()[0] == mixing.mix(df).agg(F.sum("taken")).first()[0]


# -- 10 ----------------------------------------------------------------------------------------------------------------


def slow_print(t):
    import xxhash

    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, odd):
    for df in (docs, odd.filter("doc_id is not null")):
        own = texts(df)
        prints = {i: slow_print(t) for i, t in own.items()}
        root = {i: i for i in own}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in own:
            for b in own:
                if b < a and (prints[a] ^ prints[b]).bit_count() <= 4:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        for r in simhash.near_dups(df).collect():
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))
    assert simhash.near_dups(odd.limit(0)).count() == 0 and simhash.near_dups(odd).count() == len(ODD)


@pytest.mark.parametrize("width,radius", [(1, 4), (4, 48)])
def test_bit_planes(width, radius):
    rng = np.random.default_rng(width)
    base = rng.integers(0, 1 << 63, (150, width), dtype=np.uint64)
    near = base[rng.integers(0, 150, 120)] ^ (np.uint64(1) << rng.integers(0, 64, (120, width), dtype=np.uint64))
    prints = np.concatenate([base, near, near[:7]])
    far = np.unpackbits((prints[:, None, :] ^ prints[None, :, :]).view(np.uint8), axis=2).sum(2)
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if far[i, j] <= radius}
    assert {(i, int(j)) for i, js in simhash.close_pairs(prints, radius, 64) for j in js} == want


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 20)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 1 << 20, 300)} | {1 << i | 1 << j for i in range(12) for j in range(i)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if b < a and (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(found.get(x, x) == find(x) for x in prints)


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5)]
    found = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {999: 999, 1000: 999}


def test_keep_one(spark, odd):
    base = [f"word{i}" for i in range(300)]
    near = [w if i % 60 else f"new{i}" for i, w in enumerate(base)]
    other = [f"else{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base)), (3, " ".join(other))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd.limit(0)).count() == 0


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    """Every stage by its plain definition on what the stage before kept."""
    now = docs
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        was, now = now, stage(spark, now, DATA)
        if name != "mix_sources":
            assert now.columns == docs.columns
        rows, before = texts(now), texts(was)
        assert set(rows) <= set(before)
        if name == "quality_rules":
            assert set(rows) == {r.doc_id for r in quality.score(was).filter("kept").collect()} and all(counts(t)[0] >= 50 for t in rows.values())
        if name == "line_dedup":
            seen = Counter(w for t in rows.values() for ls in [(t or "").split("\n")] for w in zip(ls, ls[1:], ls[2:], strict=False) if "".join(w).strip())
            olds = Counter(w for t in before.values() for ls in [(t or "").split("\n")] for w in zip(ls, ls[1:], ls[2:], strict=False) if "".join(w).strip())
            assert all(n == 1 for w, n in seen.items() if w in olds) and set(rows) == set(before)
        if name == "decontaminate":
            assert not any(b in t for b in bench for t in rows.values())
        now = spark.createDataFrame(now.collect(), now.schema)
    assert "taken" in now.columns and now.filter("taken < 1 or copies not in (1, 2)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == set(texts(now))
