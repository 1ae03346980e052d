"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about the language of a text are multiplied: the
likelihood of its character trigrams under a naive Bayes model of each
language, the language its markup declares, its address's suffix (and a
language segment of its path), and a prior of its host. The prior is smoothed
hierarchically: a host's mean text posterior is drawn to that of its domain,
this to that of its suffix, and this to that of all rows, each computed by
grouped aggregation over all rows (host totals first, so that a hot host is
summed map-side). A row's own posterior is left out of its prior, so that its
text counts once. How far declarations and addresses can be trusted is
estimated from how often they agree with the texts, over all rows too.

The languages are those that label any row of the whole table. The trigram
model is fitted on a bounded sample for each of them: at most FIT_ROWS rows of
a language, those whose id hashes lowest, of which the first FIT_CHARS
characters count (whole texts are scored). Languages beyond MOST_LANGS would
not fit the model's array and are an error.

Defined cases: null or empty text has no likelihood, and the other evidence
decides; without any evidence the overall prior does; declared languages that
label no row are no evidence; ties go to the language first in order; repeated
rows count as often as they occur and each get their row; an empty table gives
an empty result, and without labelled rows the language is null; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, bound_batches, materialize
from .html import host_of, main_text

FIT_ROWS, FIT_CHARS, MOST_LANGS = 300, 20_000, 500
BUCKETS = 1 << 15
#: Weight of one trigram (neighbours are not independent), and most evidence of a text in nats.
DAMP, MOST = 0.25, 30.0
#: Pseudo-rows that draw a host to its domain, a domain to its suffix, a suffix to all rows.
STRENGTH = 10.0
# Country suffixes and the language most used there.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "tr": "tr", "gr": "el", "cz": "cs", "hu": "hu"}


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the text's UTF-8 bytes, lower case, white space as one space."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities [language, bucket] from labelled (doc_id, text, lang). A language of which no
    row has a text is as likely as any for every trigram."""
    own = labelled.select("doc_id", "lang", F.substring("text", 1, FIT_CHARS).alias("text")).withColumn("lang", plain_lang(F.col("lang"))).filter("lang is not null")
    counted = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.when(F.length("text") > 0, 1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(counted) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages label the rows")
    if not counted:
        return [], np.zeros((0, BUCKETS))
    langs = sorted(counted)
    # hashes below a bound that lets about twice the wanted rows of a language through, so that few rows are sorted
    bounds = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1 << 40, (rows * 2 << 40) // max(counted[lang], 1))))])
    few = own.filter("length(text) > 0").withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).filter(F.col("h") < F.element_at(bounds, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    sums = np.full((len(langs), BUCKETS), 0.1)
    for r in few.withColumn("nth", nth).filter(F.col("nth") <= rows).select("lang", "text").toLocalIterator():  # rows * languages short rows
        sums[langs.index(r["lang"])] += np.bincount(trigrams(r["text"]), minlength=BUCKETS)
    return langs, np.log(sums / sums.sum(1, keepdims=True))


def plain_lang(c: Column) -> Column:
    """The first subtag, in lower case; null if there is none."""
    return F.nullif(F.lower(F.substring_index(F.trim(c), "-", 1)), F.lit(""))


def likelihoods(model: np.ndarray, markup: bool, shared):
    """A column function: text (or html) to the log likelihood of each language, less the best one's."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        table = shared.value
        out = []
        for t in texts.to_pylist():
            grams = trigrams((main_text(t) if markup else t) or "")
            ll = table[:, grams].sum(1) * DAMP if len(grams) else np.zeros(len(table))
            out.append(np.maximum(ll - ll.max(), -MOST).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return score


def posterior(logs: Column) -> Column:
    """Normalised probabilities of an array of logs."""
    best = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - best))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def by_sum(n: int, column: str) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)]


def left_out(n: int) -> Column:
    """The host's prior without the row itself: sums less the row's posterior, drawn to the domain's prior."""
    return F.array(*[(F.greatest(F.col(f"s{i}") - F.col("text_post")[i], F.lit(0.0)) + STRENGTH * F.col("up")[i]) / (F.col("c") - 1 + STRENGTH) for i in range(n)])


def smoothed(level: DataFrame, key: str, parent: DataFrame | None, parent_key: str, n: int) -> DataFrame:
    """(key, prior): sums s0..s{n-1} and count c drawn to the parent's prior."""
    if parent is None:
        return level.withColumn("prior", F.array(*[(F.col(f"s{i}") + 1.0 / n) / (F.col("c") + 1.0) for i in range(n)]))
    joined = level.join(parent.select(F.col(parent_key), F.col("prior").alias("up")), parent_key)
    return joined.withColumn("prior", F.array(*[(F.col(f"s{i}") + STRENGTH * F.col("up")[i]) / (F.col("c") + STRENGTH) for i in range(n)])).drop("up")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows: (id columns, ll array, declared, address, host). Adds lang, probability, text_lang and the evidence."""
    n = len(langs)
    # hosts to domains (last two labels) to suffixes (last label) to everything
    rows = rows.withColumns({"text_post": posterior(F.col("ll")), "host": F.coalesce("host", F.lit(""))})
    rows = materialize(rows, "lang-rows")
    hosts = rows.groupBy("host").agg(*by_sum(n, "text_post"), F.count(F.lit(1)).alias("c"))
    hosts = hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1), "all": F.lit(0)})
    hosts = materialize(hosts, "lang-hosts")
    up = lambda key, rest: hosts.groupBy(key, *rest).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)], F.sum("c").alias("c"))
    everything = smoothed(up("all", []), "all", None, "", n)
    suffixes = smoothed(up("suffix", ["all"]), "suffix", everything, "all", n)
    domains = smoothed(up("domain", ["suffix"]), "domain", suffixes, "suffix", n)
    drawn = hosts.join(domains.select("domain", F.col("prior").alias("up")), "domain")
    priors = materialize(drawn.select("host", *[f"s{i}" for i in range(n)], "c", "up"), "lang-priors")
    # trust in declarations and addresses: how often they agree with the text, smoothed
    post = lambda c: F.element_at("text_post", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(c)).cast("int"))
    known = lambda c: F.col(c).isin(langs)
    told = F.array_min("ll") < 0  # rows without a text say nothing about trust
    trust = rows.agg(*[((F.coalesce(F.sum(F.when(known(c) & told, post(c))), F.lit(0.0)) + 8) / (F.count(F.when(known(c) & told, 1)) + 10)).alias(c) for c in ("declared", "address")]).first()

    def said(c: str, i: int) -> Column:
        right = min(max(trust[c], 1 / n + 0.01), 0.99)
        return F.when(known(c), F.when(F.col(c) == langs[i], F.log(F.lit(right))).otherwise(F.log(F.lit((1 - right) / max(1, n - 1))))).otherwise(0.0)

    joined = attach(rows, priors, ["host"], "left").withColumn("prior", left_out(n))
    logs = F.array(*[F.col("ll")[i] + F.log(F.greatest(F.col("prior")[i], F.lit(1e-12))) + said("declared", i) + said("address", i) for i in range(n)])
    fused = joined.withColumn("post", posterior(logs))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return fused.withColumns({"lang": best("post"), "probability": F.round(F.array_max("post"), 6), "text_lang": F.when(F.array_min("ll") < 0, best("text_post"))})


def declared_in(html: Column) -> Column:
    """The language that the html element declares, its first subtag."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def address_in(url: Column) -> Column:
    """The language that an address tells: a two-letter first segment of its path, else its country suffix."""
    segment = F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)), F.lit(""))
    suffix = F.substring_index(host_of(url), ".", -1)
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.coalesce(segment, F.get(F.array(F.try_element_at(table, suffix)), F.lit(0)))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of pages and documents: kind, doc_id, page_id, lang, probability, text_lang, declared, address.

    Pages have all four kinds of evidence; a document's declared language is its lang column and its host its
    source."""
    spark = pages.sparkSession
    bound_batches(spark)
    langs, model = fit(docs)
    if not langs:
        none = F.lit(None).cast("string")
        empty = lambda df, kind, d, p: df.select(F.lit(kind).alias("kind"), d.alias("doc_id"), p.alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("address"))
        null = F.lit(None).cast("long")
        return empty(pages, "page", null, F.col("page_id")).unionByName(empty(docs, "document", F.col("doc_id"), null))
    shared = spark.sparkContext.broadcast(model)
    out = None
    for kind, rows in (
        ("page", pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", likelihoods(model, True, shared)("html").alias("ll"), declared_in(F.col("html")).alias("declared"), address_in(F.col("url")).alias("address"), host_of(F.col("url")).alias("host"))),
        ("document", docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), likelihoods(model, False, shared)("text").alias("ll"), plain_lang(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))),
    ):
        part = fuse(rows, langs).select(F.lit(kind).alias("kind"), "doc_id", "page_id", "lang", "probability", "text_lang", "declared", "address")
        out = part if out is None else out.unionByName(part)
    return out
