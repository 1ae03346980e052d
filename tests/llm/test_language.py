"""Language evidence: the hierarchy in plain Python, and pages whose text alone does not tell."""

import math

import pytest
from pyspark.sql import functions as F

from tributary.llm import common, langid

WORDS = {"en": "the and of that with from this have which their would there", "de": "der und nicht eine werden auch sich nach wurde durch zwischen", "fi": "joka mutta olla kaikki sitten kanssa ihminen talossa hyvin"}


def text_of(lang, i, n=40):
    words = WORDS[lang].split()
    return " ".join(words[(i * 7 + k * (1 + i % 5)) % len(words)] for k in range(n))


def labelled(spark):
    rows = [(i, text_of("en" if i % 3 else "de", i), "en-US" if i % 3 else "de") for i in range(600)]
    rows += [(9000, text_of("fi", 1, 9000), "fi"), (9001, None, "sv"), (9002, "x", None), (9003, "y", "")]  # rare, long; without text
    return spark.createDataFrame([(*r, "clash", "src") for r in rows], "doc_id long, text string, lang string, host string, source string")


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def test_rare_languages_are_known(spark):
    langs, model = langid.fit(labelled(spark))
    assert langs == ["de", "en", "fi", "sv"] and model.shape == (4, langid.BUCKETS)
    assert len(set(model[3])) == 1


def by_hand(rows, langs):
    """rows: (key, ll, declared, address, host). The language of each by the formulas, in plain Python."""
    n = len(langs)

    def norm(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    posts = [norm(r[1]) for r in rows]
    name = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]), "suffix": lambda h: h.split(".")[-1]}

    def sums(level, value):
        own = [p for r, p in zip(rows, posts) if name[level](r[4]) == value]
        return [sum(p[i] for p in own) for i in range(n)], len(own)

    whole = [(sum(p[i] for p in posts) + 1 / n) / (len(rows) + 1) for i in range(n)]

    def drawn(level, value, up):
        s, c = sums(level, value)
        return [(s[i] + langid.STRENGTH * up[i]) / (c + langid.STRENGTH) for i in range(n)]

    trust = {}
    for k, c in ((2, "declared"), (3, "address")):
        said = [p[langs.index(r[k])] for r, p in zip(rows, posts) if r[k] in langs and min(r[1]) < 0]
        trust[k] = min(max((sum(said) + 8) / (len(said) + 10), 1 / n + 0.01), 0.99)
    out = {}
    for r, p in zip(rows, posts):
        domain = drawn("domain", name["domain"](r[4]), drawn("suffix", name["suffix"](r[4]), whole))
        s, c = sums("host", r[4])
        prior = [(max(s[i] - p[i], 0) + langid.STRENGTH * domain[i]) / (c - 1 + langid.STRENGTH) for i in range(n)]
        logs = [r[1][i] + math.log(max(prior[i], 1e-12)) for i in range(n)]
        for k in (2, 3):
            if r[k] in langs:
                logs = [x + math.log(trust[k] if langs[i] == r[k] else (1 - trust[k]) / max(1, n - 1)) for i, x in enumerate(logs)]
        post = norm(logs)
        out[r[0]] = (langs[post.index(max(post))], round(max(post), 6))
    return out


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_hierarchy_by_hand(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    langs = ["de", "en", "fi"]
    hosts = ["a.one.de", "b.one.de", "c.two.de", "x.com", "y.z.com", "", "fi"]
    rows = []
    for i in range(200):
        ll = [-((i * 13 + 7 * k) % 31) / 3.0 if i % 4 else 0.0 for k in range(3)]
        best = max(ll)
        rows.append((i, [x - best for x in ll], [None, "de", "en", "xx", "fi"][i % 5], [None, None, "de", "fi"][i % 4], hosts[i % 7 if i % 3 else 0]))
    df = spark.createDataFrame(rows, "key long, ll array<double>, declared string, address string, host string")
    got = {r.key: (r.lang, r.probability) for r in langid.fuse(df, langs).collect()}
    want = by_hand(rows, langs)
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=2e-6)
    assert all(got[k][0] == want[k][0] for k in want)


def test_evidence_changes_the_answer(spark):
    """A short text is decided by its declaration or host; a long text is not by a lying declaration."""
    rows = [(i, f"http://de.example.org/{i}", page(text_of("de", i))) for i in range(60)]
    rows += [(100 + i, f"http://en.example.net/{i}", page(text_of("en", i), "en")) for i in range(60)]
    rows += [(200 + i, f"http://h{i}.example.info/fi/{i}", page(text_of("fi", i))) for i in range(40)]  # addresses that tell the truth
    rows += [
        (900, "http://other.example.biz/", page("ok", "de")),
        (901, "http://de.example.org/x", page("ok")),
        (902, "http://en.example.net/x", page("ok")),
        (903, "http://en.example.net/y", page(text_of("de", 3, 200), "en")),
        (904, "http://solo.example.info/fi/", page("")),
        (905, None, None),
        (906, "http://de.example.org/y", ""),
        (907, "http://lone.fi/", page(text_of("en", 3, 200))),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, lang string, doc_id int")
    out = langid.identify(labelled(spark), pages)
    got = {r.page_id: r for r in out.filter("kind = 'page'").collect()}
    assert [got[k].lang for k in (900, 901, 902, 903, 906, 907)] == ["de", "de", "en", "de", "de", "en"]
    assert got[904].lang == "fi" and got[904].text_lang is None and got[905].lang is not None
    docs = out.filter("kind = 'document'")
    assert docs.count() == labelled(spark).count() and {r.doc_id: r.lang for r in docs.collect()}[9000] == "fi"


def test_odd_rows(spark):
    long = " ".join(WORDS["de"].split() * 40_000)
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "en"), (2, long, "de"), (2, long, "de"), (3, "the of and", "en")], "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "ll": F.lit(1), "prior": F.lit("x"), "declared": F.lit(2)})
    none = spark.createDataFrame([], "page_id long, url string, html string")
    out = langid.identify(docs, none).collect()
    assert len(out) == 6 and {r.lang for r in out if r.doc_id == 2} == {"de"} and all(r.lang for r in out)
    assert langid.identify(docs.limit(0), none).count() == 0
