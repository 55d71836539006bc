"""Conversations from quoting messages: link quotations, order replies, drop the quotes.

A line's quote level is the number of ``>`` in front of it. A passage is a run of quoted lines
of one level; its words (lower case, blanks and line breaks alike) are hashed as shingles of
five, a shorter passage as a whole. The original of a passage is an earlier message of the
conversation that wrote at least 80 % of its shingles itself (short: wrote just that line):
the one with most of them, of equals the latest. Every earlier message counts. So a passage may be wrapped anew, cut
or changed a little, and a common line belongs to whoever wrote it last. A message replies to
the original of its least nested passages, the one it quotes most; without a linked passage it
continues the message before it. The first reply to a message continues its branch, others
start branches; conversations are ordered by branch and turn.
"""

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalblind.operators.ordering import running_min
from signalblind.session import cut

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)*)")
BUCKET = 4096


def parse(text):
    """(text without quotes, passages as (level, non-blank lines, words)) of one message."""
    clean, marked = [], []
    for line in (text or "").split("\n"):
        marks = MARKS.match(line)
        level = marks.group(1).count(">")
        if not level:
            clean.append(line)
        marked.append((level, line[marks.end() :].lower().split()))
    passages = []
    for level, lines in itertools.groupby(marked, key=lambda m: m[0]):
        lines = [words for _, words in lines if words]
        if level and lines:
            passages.append((level, len(lines), list(itertools.chain(*lines))))
    return "\n".join(clean).strip("\n"), passages


def _hash(words):
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shingles(words, size):
    """Hashes of the runs of ``size`` words; of all words when there are fewer."""
    return {_hash(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def written(clean, size):
    """Hashes that passages can meet in a message: its shingles and its short lines."""
    lines = [line.lower().split() for line in clean.split("\n")]
    return shingles(list(itertools.chain(*lines)), size).union(*(shingles(x, size) for x in lines if len(x) < size))


def parsed(messages: DataFrame, words=5) -> DataFrame:
    """(conv_id, turn, role, clean, passages) of every message."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("lines", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            rows = [parse(t.as_py()) for t in batch.column("text")]
            passages = [[{"level": level, "lines": n, "keys": sorted(shingles(w, words))} for level, n, w in r[1]] for r in rows]
            cols = [pa.array([r[0] for r in rows], pa.string()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *cols], ["conv_id", "turn", "role", "clean", "passages"])

    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, clean string, passages array<struct<level:int,lines:bigint,keys:array<bigint>>>")


def originals(known: DataFrame, words=5, share=80) -> DataFrame:
    """(conv_id, turn, level, lines, original) of every passage with an original.

    Only conversations with quotes are searched, and only shingles that are quoted are kept
    of their messages. Passages of the same shingles are looked up once, and so are messages
    that wrote the same ones. What holds ``share`` percent of a passage holds one of its
    rarest shingles, as many as may be missing and one, so only these propose messages; none
    is left out. The latest one before a passage is found in blocks of turns.
    """
    place = ["conv_id", "turn", "part"]
    quoting = known.filter("size(passages) > 0")
    if quoting.isEmpty():
        return known.sparkSession.createDataFrame([], "conv_id bigint, turn bigint, level int, lines bigint, original bigint")
    asked = quoting.select("conv_id", "turn", F.posexplode("passages").alias("at", "p"))
    asked = asked.select("conv_id", "turn", F.xxhash64("at", "p").alias("part"), "p.*").dropDuplicates(place)
    asked = cut(asked.withColumn("wanted", F.md5(F.col("keys").cast("string"))))
    quoted = asked.dropDuplicates(["conv_id", "wanted"]).select("conv_id", "wanted", F.size("keys").alias("m"), F.explode("keys").alias("key"))

    def run(batches):
        for batch in batches:
            keys = [sorted(written(c.as_py(), words)) for c in batch.column("clean")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(keys, pa.list_(pa.int64()))], ["conv_id", "turn", "keys"])

    searched = known.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "clean")
    own = searched.mapInArrow(run, "conv_id bigint, turn bigint, keys array<bigint>").select("conv_id", "turn", F.explode("keys").alias("key"))
    own = own.join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi").distinct()
    # a message holds few quoted shingles, and many messages the same ones
    wrote = own.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    wrote = cut(wrote.withColumn("kind", F.md5(F.col("keys").cast("string"))))
    kinds = wrote.dropDuplicates(["conv_id", "kind"]).select("conv_id", "kind", F.explode("keys").alias("key"))
    ranked = quoted.join(kinds.groupBy("conv_id", "key").agg(F.count("*").alias("n")), ["conv_id", "key"], "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("conv_id", "wanted").orderBy(F.coalesce("n", F.lit(0)), "key")))
    rare = ranked.filter(F.col("rank") <= F.col("m") - F.floor((F.col("m") * share + 99) / 100) + 1)
    candidates = rare.join(kinds, ["conv_id", "key"]).select("conv_id", "wanted", "kind").distinct()
    hits = candidates.join(quoted, ["conv_id", "wanted"]).join(kinds, ["conv_id", "kind", "key"], "left_semi").groupBy("conv_id", "wanted", "m", "kind").agg(F.count("*").alias("hits"))
    hits = cut(hits.filter(F.col("hits") * 100 >= F.col("m") * share).select("conv_id", "wanted", "kind", "hits"))
    # what a message writes itself comes after what it quotes
    held = wrote.join(hits, ["conv_id", "kind"]).select("conv_id", "wanted", "hits", "turn", (-F.col("turn")).alias("held"))
    asks = asked.select(*place, "wanted").join(hits.select("conv_id", "wanted", "hits").distinct(), ["conv_id", "wanted"])
    events = asks.withColumn("held", F.lit(None).cast("bigint")).unionByName(held, allowMissingColumns=True)
    seen = running_min(events, ["conv_id", "wanted", "hits"], [F.col("turn"), F.col("held").isNotNull()], F.floor(F.col("turn") / BUCKET), "held", "latest")
    best = seen.filter("held is null and latest is not null").groupBy(*place).agg(F.max(F.struct("hits", (-F.col("latest")).alias("original")))["original"].alias("original"))
    return cut(asked.drop("keys", "wanted").join(best, place).select("conv_id", "turn", "level", "lines", "original"))


def placed(known: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked, prev_turn, segment, opening of every turn, in blocks of turns.

    A segment runs from the first message or a linked one up to the next linked one. Blocks
    are dealt once; one summary row a block tells the next ones what came before.
    """
    empty = {c: F.lit(None).cast("bigint") for c in ("parent", "n_linked")}
    turns = known.select("conv_id", "turn").withColumns(empty).unionByName(chosen).groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"), F.max("n_linked").alias("n_linked"))
    blocks, start = ["conv_id", "block"], F.when(F.col("parent").isNotNull(), F.col("turn"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BUCKET)).repartition(*blocks)
    ends = turns.groupBy(*blocks).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(start).alias("start"))
    whole, within = Window.partitionBy("conv_id"), Window.partitionBy(*blocks).orderBy("turn")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*blocks, F.min("first").over(whole).alias("opening"), F.max("last").over(before).alias("last"), F.max("start").over(before).alias("carried"))
    turns = turns.withColumns({"prev": F.lag("turn").over(within), "start": F.max(start).over(within)}).join(ends, blocks)
    return cut(turns.select("conv_id", "turn", "parent", "n_linked", F.coalesce("prev", "last").alias("prev_turn"), F.coalesce("start", "carried", "opening").alias("segment"), "opening"))


def chained(up: DataFrame) -> DataFrame:
    """(conv_id, segment, up): the segment at the end of each segment's chain of links ``up``."""
    while not up.isEmpty():
        further = up.select("conv_id", F.col("segment").alias("up"), F.col("up").alias("next"))
        new = cut(up.join(further, ["conv_id", "up"], "left").select("conv_id", "segment", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        up = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return up


def continued(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, thread, branch) of the segments that linked messages start.

    The first reply to a message continues its branch, any further one starts a branch named
    by its own turn. A message without a link is the first reply to the one before it, so
    branches start with segments, and only these are ordered and chained.
    """
    where = turns.select("conv_id", F.col("turn").alias("parent"), F.col("segment").alias("up"))
    links = cut(turns.filter("parent is not null").select("conv_id", F.col("turn").alias("segment"), "parent", "prev_turn", "opening").join(where, ["conv_id", "parent"]))
    # where the next message is not linked, that one is the first reply
    last = links.select("conv_id", F.col("prev_turn").alias("parent"), F.lit(None).cast("bigint").alias("segment"), F.lit(True).alias("last"))
    heirs = links.select("conv_id", "parent", "segment", F.lit(False).alias("last")).unionByName(last).groupBy("conv_id", "parent").agg(F.min("segment").alias("heir"), F.max("last").alias("last"))
    starts = links.join(heirs, ["conv_id", "parent"]).withColumn("leads", F.col("last") & (F.col("heir") == F.col("segment"))).drop("heir", "last")
    starts = starts.withColumn("start", F.when(~(F.col("leads") & (F.col("parent") == F.col("prev_turn"))), -F.col("segment")))
    starts = running_min(starts, ["conv_id"], [F.col("segment")], F.floor(F.col("segment") / BUCKET), "start", "latest")
    starts = cut(starts.select("conv_id", "segment", "up", "leads", "opening", F.coalesce(-F.col("latest"), "opening").alias("stretch")))
    stretches = starts.select("conv_id", F.col("segment").alias("up"), F.col("stretch").alias("onto"))
    onto = starts.filter("leads and segment = stretch").join(stretches, ["conv_id", "up"], "left").select("conv_id", "segment", F.coalesce("onto", "opening").alias("up"))
    threads = chained(links.select("conv_id", "segment", "up")).select("conv_id", "segment", F.col("up").alias("thread"))
    branch = chained(cut(onto)).select("conv_id", F.col("segment").alias("stretch"), F.col("up").alias("branch"))
    out = starts.select("conv_id", "segment", "stretch").join(threads, ["conv_id", "segment"]).join(branch, ["conv_id", "stretch"], "left")
    return out.select("conv_id", "segment", "thread", F.coalesce("branch", "stretch").alias("branch"))


def conversations(messages: DataFrame, words=5, share=80) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, branch, n_quoted, n_linked.

    ``reply_to`` is the turn replied to (null for the first message), ``thread`` the turn at
    the end of its chain of replies, ``branch`` the turn where its line of first replies
    starts; (conv_id, branch, turn) is the reply order. ``n_quoted`` counts
    non-blank quoted lines, ``n_linked`` those of passages with an original. Null texts are
    empty; rows of null conv_id or turn are kept with null reply_to, and thread and
    branch equal to turn; messages that share (conv_id, turn) count as one message for links (equal passages
    at the same place once) and each keep their row; an empty table gives no rows; other
    columns are ignored. A long conversation is worked on in blocks of turns, never whole.
    """
    rows = cut(parsed(messages, words))
    known = rows.filter("conv_id is not null and turn is not null")
    per = originals(known, words, share).groupBy("conv_id", "turn", "level", "original").agg(F.sum("lines").alias("n"))
    chosen = per.groupBy("conv_id", "turn").agg(
        (-F.min(F.struct("level", (-F.col("n")).alias("n"), (-F.col("original")).alias("o")))["o"]).alias("parent"), F.sum("n").alias("n_linked"))
    turns = placed(known, chosen)
    if not chosen.isEmpty():
        turns = turns.join(continued(turns), ["conv_id", "segment"], "left")
    else:
        turns = turns.withColumns({c: F.col("segment") for c in ("thread", "branch")})
    turns = turns.select("conv_id", "turn", F.coalesce("parent", "prev_turn").alias("reply_to"), *(F.coalesce(c, "segment").alias(c) for c in ("thread", "branch")), "n_linked")
    out = rows.join(turns, ["conv_id", "turn"], "left")
    n_linked = F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked")
    return out.select("conv_id", "turn", "role", F.col("clean").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("branch", "turn").alias("branch"), F.aggregate("passages", F.lit(0).cast("bigint"), lambda t, p: t + p["lines"]).alias("n_quoted"), n_linked)
