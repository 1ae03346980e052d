"""Quality rules combined by weak supervision.

Every rule reads the counts of one document and votes good, votes bad or
abstains. Only the numbers of documents by vote pattern are gathered (at most
3 ** rules of them, whatever the corpus); on these, expectation-maximisation
estimates how often each rule votes either way on good and on bad documents,
and the share of good ones. A document is kept if its posterior probability of
being good is at least one half: rules whose bad votes do not go together with
those of others turn out to be unreliable and hardly count, and a rule that
finds what others find decides nearly alone.

Defined cases: null or empty text has no words and fails the base; repeated rows and ties count as often as they occur and are decided
alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize

MIN_WORDS, MAX_REPEATED = 50, 50  # words; per cent of words in repeated three-word windows
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct", "n_ended")])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


#: Characters that end a sentence, and quotes or brackets after them.
ENDS = ".!?:;…。！？\"')]»”’"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of STATS."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    spaces = sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    others = sum(text.count(c) for c in "0123456789.,;:!?()[]{}-_/\\'\"@+=^~`")
    chars = len(text) - spaces
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), chars - symbols - others, len(set(words)), sum(x.rstrip(SPACES)[-1] in ENDS for x in lines))


@F.pandas_udf(STATS)
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=STATS.names, dtype="int64")


def by(value: str, good: str, bad: str) -> Callable[[str], str]:
    """SQL of a vote: 0 bad, 1 good, 2 abstains."""
    return f"CASE WHEN {value} {bad} THEN 0 WHEN {value} {good} THEN 1 ELSE 2 END"


#: Rules: name to SQL over the columns of STATS. Each abstains between its two bounds. The bounds are those of strict web
#: filters, which many good documents miss here or there; how far a bad vote is to be believed is left to the fit.
RULES: dict[str, str] = {
    "length": by("n_words", ">= 200", "< 100"),
    "word_length": by("word_chars / greatest(n_words, 1)", "between 4 and 6", "not between 3.5 and 7"),
    "symbols": by("n_symbols / greatest(n_words, 1)", "<= 0.05", "> 0.1"),
    "letters": by("n_letters / greatest(word_chars, 1)", ">= 0.9", "< 0.8"),
    "dup_lines": by("n_dup_lines / greatest(n_lines, 1)", "= 0", "> 0.1"),
    "repeats": by("n_repeat_words / greatest(n_words, 1)", "<= 0.05", "> 0.15"),
    "variety": by("n_distinct / greatest(n_words, 1)", ">= 0.65", "< 0.6"),
    "line_ends": by("n_ended / greatest(n_lines, 1)", ">= 0.9", "< 0.7"),
}


def pattern_sql(rules: dict[str, str] = RULES) -> str:
    """SQL of the vote pattern as one number in base 3."""
    return " + ".join(f"{3**i} * ({sql})" for i, sql in enumerate(rules.values()))


def votes_of(patterns: np.ndarray, n: int) -> np.ndarray:
    """Digits of the patterns: 0 bad, 1 good, 2 abstained."""
    return patterns[:, None] // 3 ** np.arange(n)[None, :] % 3


#: Before any document is seen: how a rule votes, if it does (bad, good), on a bad and on a good document, and the share of
#: good ones. This weighs as much as one document and WEIGHT times all; it says which class is the good one, no more.
PRIOR = np.array([[0.4, 0.6], [0.1, 0.9]])
SHARE, WEIGHT = 0.8, 0.005


def fit(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 500) -> dict[str, np.ndarray]:
    """Expectation-maximisation on pattern counts. Returns share (of good documents) and votes[class, rule, vote], the
    probabilities of a bad and a good vote when the rule does not abstain."""
    one_hot = np.eye(3)[votes_of(patterns, n)][:, :, :2]  # pattern, rule, vote
    prior = np.repeat(PRIOR[:, None, :], n, axis=1)
    total = counts.sum()
    extra = WEIGHT * total + 1
    model = {"share": np.array(SHARE), "votes": prior}
    for _ in range(rounds):
        good = posterior(patterns, model, n)
        resp = np.stack([1 - good, good]) * counts
        votes = np.einsum("cp,prv->crv", resp, one_hot) + extra * prior
        votes /= votes.sum(2, keepdims=True)
        share = (resp[1].sum() + SHARE * extra) / (total + extra)
        done = np.abs(votes - model["votes"]).max() < 1e-9
        model = {"share": np.array(share), "votes": votes}
        if done:
            break
    return model


def posterior(patterns: np.ndarray, model: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Probability of being good, by pattern. Abstaining says nothing about the class."""
    odds = np.append(np.log(model["votes"][1] / model["votes"][0]), np.zeros((n, 1)), axis=1)  # rule, vote
    ratio = np.log(model["share"] / (1 - model["share"])) + odds[np.arange(n)[None, :], votes_of(patterns, n)].sum(1)
    return 1 / (1 + np.exp(-np.clip(ratio, -500, 500)))


def judge(patterns: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """From the columns pattern and failed (the base) of all documents: (pattern, posterior), one row a pattern that
    occurs. Documents that fail the base are decided and not fitted. The driver gets at most 3 ** len(rules) rows."""
    seen = patterns.groupBy("pattern").agg(F.count(F.when(~F.col("failed"), 1)).alias("n")).orderBy("pattern").toPandas()
    ids, counts = seen["pattern"].to_numpy("int64"), seen["n"].to_numpy("float64")
    good = posterior(ids, fit(ids, counts, len(rules)), len(rules)) if len(ids) else np.zeros(0)
    rows = [(int(p), float(round(g, 9))) for p, g in sorted(zip(ids, good, strict=True))]
    return patterns.sparkSession.createDataFrame(rows, "pattern long, posterior double")


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words"


def score(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the counts of its whole text, base_failed, posterior and kept."""
    bound_batches(docs.sparkSession)
    stats = docs.select("doc_id", stats_of("text").alias("s")).select("doc_id", "s.*").withColumn("pattern", F.expr(pattern_sql()).cast("long"))
    stats = materialize(stats, "quality-stats")
    judged = stats.join(F.broadcast(judge(stats.select("pattern", F.expr(BASE_FAILED).alias("failed")))), "pattern")  # at most 3 ** rules rows
    return judged.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr("NOT base_failed AND posterior >= 0.5")).drop("pattern")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; counts are made twice rather than moved."""
    bound_batches(docs.sparkSession)
    named = docs.select("*", stats_of.asNondeterministic()(docs["text"]).alias("__q"))  # so that the planner makes the counts once a pass
    flat = lambda sql: re.sub(r"\b(" + "|".join(STATS.names) + r")\b", r"__q.\1", sql)
    voted = named.withColumn("__q_pattern", F.expr(flat(pattern_sql())).cast("long"))
    judged = judge(voted.select(F.col("__q_pattern").alias("pattern"), F.expr(flat(BASE_FAILED)).alias("failed"))).select(F.col("pattern").alias("__q_pattern"), F.col("posterior").alias("__q_good"))
    kept = voted.join(F.broadcast(judged), "__q_pattern").filter(F.expr(f"NOT ({flat(BASE_FAILED)}) AND __q_good >= 0.5"))
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])
