"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parent's id. Self-joins that double the distance
(a message to its parent, to its grandparent, four up, ...) give each message
its root and the score summed along its path; leaves are ranked by the mean
score of their path within a tree (by one range exchange, so that the leaves of
a large tree are split), and the chosen paths are spread out again by
the same jumps, so both take as many joins as the longest path has binary
digits. Only ids and scores are joined on the way; texts come in once at the
end, a conversation at a time.

The template of one turn is

    <turn>ROLE newline TEXT</turn> newline

with & as &amp; and < as &lt; in roles and texts, and a newline in a role as
&#10;. A raw < then occurs in marks only, so the formatted text splits at
</turn> into turns without ambiguity, and undoing the escapes gives roles and
texts back exactly.

Defined cases: null text and null role count as empty; a message whose parent
is null, missing or itself is a root; in a circle of replies, the links to a
later id are dropped; messages that repeat an id of a tree count as their least
(role, text) once; a null tree id is a tree of its own; an empty table gives an empty result; other columns are ignored. For
rows by turn, equal turns follow each other by role and text, each kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialize

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def rows_by_turn(messages: DataFrame) -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of conversations given by (conv_id, turn, role, text): each
    turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return messages.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"),
        F.row_number().over(order).cast("long").alias("id"),
        (F.nullif(F.row_number().over(order), F.lit(1)) - 1).cast("long").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def tree_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def links(messages: DataFrame) -> DataFrame:
    """(tree, id, parent, score), parent null for roots; a link counts only towards another id that is there."""
    once = messages.groupBy("tree", "id").agg(F.min(F.col("parent")).alias("parent"), F.max("score").alias("score"))
    there = once.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    own = once.withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
    joined = own.join(there, (own["tree"] == there["t"]) & (own["parent"] == there["p"]), "left")
    return joined.select("tree", "id", F.col("p").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))


def climbed(base: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(messages with total and steps to their root, the jumps (tree, id, up) of 1, 2, 4, ... messages up, and the
    messages (t, i) on circles if there are any). Who has not met a root after as many steps as there are messages is
    on a circle or below one, and such jumps end on circles."""
    jumps: list[DataFrame] = []
    # up: the message 2 ** k above; total, steps: score and number of the messages from here to below it
    state = base.select("tree", "id", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    n = None
    while True:
        open_ = state.filter("up is not null")
        if open_.isEmpty():
            return state, jumps, None
        if len(jumps) > 6:
            n = n or base.count()
            if 2 ** (len(jumps) - 1) > n:
                return state, jumps, open_.select(F.col("tree").alias("t"), F.col("up").alias("i")).distinct()
        jumps.append(open_.select("tree", "id", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        # only messages that have not met their root go on; the others keep what they have
        joined = open_.join(above, (open_["tree"] == above["t"]) & (open_["up"] == above["i"]))
        onward = joined.select("tree", "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = materialize(onward.unionByName(state.filter("up is null")), "chat-jump")


def ranked(leaves: DataFrame) -> DataFrame:
    """(tree, leaf, rank) from (tree, id, mean): best mean first, then least id. One range exchange orders all leaves; a
    rank is the place in a tree's part of a range and the tree's leaves in the ranges before."""
    order = [F.col("tree"), F.desc("mean"), F.col("id")]
    spread = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    spread = materialize(spread, "chat-leaves")
    here = F.row_number().over(Window.partitionBy("tree", "part").orderBy(F.desc("mean"), "id"))
    counts = spread.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    # a range has at most two trees that go on beyond it
    wide = counts.join(counts.groupBy("tree").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "tree")
    before = wide.select("tree", "part", (F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")).alias("before"))
    joined = attach(spread, materialize(before, "chat-before"), ["tree", "part"], "left")
    return joined.select("tree", F.col("id").alias("leaf"), (here + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))


def chosen_paths(messages: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, rank, id, depth) for every message on a chosen root-to-leaf path; depth counts from the leaf."""
    base = materialize(links(messages), "chat-links")
    state, jumps, circles = climbed(base)
    if circles is not None:
        circles = materialize(circles, "chat-circles")
        marked = base.join(circles, (base["tree"] == circles["t"]) & (base["id"] == circles["i"]), "left")
        base = materialize(marked.select("tree", "id", F.when(F.col("i").isNull() | (F.col("parent") < F.col("id")), F.col("parent")).alias("parent"), "score"), "chat-links")
        state, jumps, _ = climbed(base)
    parents = base.select(F.col("tree").alias("t"), F.col("parent").alias("p")).filter("p is not null").distinct()
    leaves = state.join(parents, (state["tree"] == parents["t"]) & (state["id"] == parents["p"]), "left_anti")
    leaves = ranked(leaves.select("tree", "id", (F.col("total") / F.col("steps")).alias("mean")))
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    paths = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth"))
    for k, jump in enumerate(jumps):
        hop = jump.select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        more = paths.join(hop, (paths["tree"] == hop["t"]) & (paths["id"] == hop["i"])).select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("depth") + 2**k).alias("depth"))
        paths = materialize(paths.unionByName(more), "chat-paths")
    return paths


def format_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row a chosen path: tree, rank, leaf, formatted, spans (start, length in characters, from 0, of the
    assistant texts in formatted). All paths are chosen unless `best` limits them to so many a tree."""
    own = messages.select(F.col("tree").alias("own"), tree_key(F.col("tree")).alias("tree"), "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    paths = chosen_paths(own.select("tree", "id", "parent", "score"), best)
    said = own.groupBy("tree", "id").agg(F.first("own").alias("own"), F.min(F.struct("role", "text")).alias("m"))
    turn = F.struct((-F.col("depth")).alias("at"), role_in(F.col("m.role")).alias("role"), (F.col("m.role") == "assistant").alias("loss"), escape(F.col("m.text")).alias("text"))
    told = paths.join(said, ["tree", "id"]).groupBy("tree", "leaf", "rank").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(turn)).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    extra = len(OPEN) + 1 + len(CLOSE)

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.char_length(t["role"]) + 1
        size = F.char_length(t["text"]).cast("long")
        span = F.struct(begin.cast("long").alias("start"), size.alias("size"))
        return F.struct((acc["at"] + extra + F.char_length(t["role"]) + size).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("spans"))
    spans = F.aggregate("turns", zero, step, lambda acc: acc["spans"])
    return told.select(F.col("own").alias("tree"), "rank", "leaf", F.concat_ws("", marked).alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, read from formatted and spans alone."""
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(OPEN) + 1, F.char_length(p))
    turns = F.transform(parts, lambda p: F.struct(role_out(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substring(body(p), F.char_length(F.substring_index(body(p), "\n", 1)) + 2, F.char_length(p))).alias("text")))
    loss = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.concat_ws("", loss)})


def digests(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted output."""
    back = read_back(format_paths(messages, best))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "tree",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
