"""Quotation linking against plain loops on generated threads, and hand-made cases."""

import random

from signalblind.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def by_force(rows):
    """(parent, n_quoted, n_linked) by message, over sets of word tuples."""

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    wrote, asked = {}, {}
    for c, t, _, text in rows:
        own, passages, last = [], [], 0
        for line in (text or "").split("\n"):
            body, level = line.lstrip(" \t"), 0
            while body.startswith(">"):
                level, body = level + 1, body[2:] if body[1:2] in (" ", "\t") else body[1:]
            w = body.lower().split()
            if not level:
                own.append(w)
            elif w and passages and level == last:
                passages[-1][1] += 1
                passages[-1][2].extend(w)
            elif w:
                passages.append([level, 1, w])
            # a blank quoted line does not end a passage, a change of level does
            last = level if w or level != last else last
        wrote[c, t] = grams(sum(own, [])).union(*(grams(w) for w in own if len(w) < 5))
        asked[c, t] = passages
    out = {}
    for (c, t), passages in asked.items():
        votes, linked = {}, 0
        for level, lines, w in passages:
            keys, picked = grams(w), set()
            for k in keys:
                holders = [u for (d, u), own in wrote.items() if d == c and u < t and k in own]
                picked.update([min(holders), max(holders)] if holders else [])
            scored = [(len(keys & wrote[c, u]), u) for u in picked if 100 * len(keys & wrote[c, u]) >= 80 * len(keys)]
            if scored:
                linked += lines
                votes[level, max(scored)[1]] = votes.get((level, max(scored)[1]), 0) + lines
        best = min(votes, key=lambda v: (v[0], -votes[v], -v[1])) if votes else None
        out[c, t] = best and best[1], sum(n for _, n, _ in passages), linked
    return out


def threads(seed, conversations=6, turns=25):
    rng = random.Random(seed)
    for c in range(conversations):
        said = []
        for t in range(turns):
            lines = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if said:
                    level, words = rng.choice([1, 1, 2, 3]), rng.choice(said).replace("\n", " ").split()
                    at = rng.randrange(max(1, len(words) // 2)) if rng.random() < 0.4 else 0
                    words = words[at : at + rng.choice([2, 6, 40])]
                    if words and rng.random() < 0.2:
                        words[rng.randrange(len(words))] = "changed"
                    wide = rng.randint(2, 9)
                    mark = rng.choice([">" * level + " ", "> " * level])
                    lines += [mark + " ".join(words[i : i + wide]).upper() for i in range(0, len(words), wide)]
                    lines += [mark.rstrip()] if rng.random() < 0.3 else []
            vocabulary = "thanks yes no maybe the train leaves at noon from platform nine".split()
            own = rng.choice(said) if said and rng.random() < 0.15 else " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 8, 30])))
            own = own if rng.random() < 0.7 else own.replace(" ", "\n", 1)
            said.append(own)
            yield c, t, "user", "\n".join([*lines, own] if rng.random() < 0.8 else [own, *lines])


def test_links_by_plain_loops(spark):
    rows = list(threads(3)) + [(99, t, "user", None) for t in range(3)]
    out = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want = by_force(rows)
    linked = 0
    for (c, t), (parent, n_quoted, n_linked) in want.items():
        got = out[c, t]
        assert (got.n_quoted, got.n_linked) == (n_quoted, n_linked), (c, t)
        assert got.reply_to == (parent if parent is not None else t - 1 if t else None), (c, t)
        linked += parent is not None
    for c in {c for c, _ in want}:
        heirs, branch, thread = {}, {}, {}
        for t in sorted(t for d, t in want if d == c):
            up = out[c, t].reply_to
            branch[t] = branch[up] if up is not None and heirs.setdefault(up, t) == t else t
            thread[t] = t if up is None else thread[up]
            assert (out[c, t].branch, out[c, t].thread) == (branch[t], thread[t])
    assert any(out[k].branch > 0 for k in want)
    assert linked > 30


def test_wraps_and_common_lines(spark):
    long = "the parcel was sent on monday and will be there by friday at the latest"
    rows = [
        (1, 0, "user", long), (1, 1, "user", "something else\nthanks"), (1, 2, "user", "thanks"),
        (1, 3, "user", "> the parcel was sent on monday and will\n> be there by friday at the latest\nGood."),
        (1, 4, "user", "> thanks\nYou are welcome."), (1, 5, "user", ">> " + long + "\n> Good.\n\nIndeed."),
        (1, 6, "user", "> was sent on monday and will be there\nReally?"), (1, 7, "user", "> nobody ever wrote these seven words here\nHm."),
    ]
    out = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(out[t].reply_to, out[t].n_quoted, out[t].n_linked) for t in range(3, 8)] == [(0, 2, 2), (2, 1, 1), (3, 2, 2), (0, 1, 1), (6, 1, 0)]
    assert out[5].text == "Indeed." and out[5].thread == 0


def test_repeated_messages_and_a_hot_line(spark):
    rows = [(1, t, "user", "> ok then\nok then") for t in range(200)] + [(1, 7, "user", "> ok then\nok then")]
    out = quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 201 and all(r.reply_to == (r.turn - 1 if r.turn else None) and r.n_linked == (1 if r.turn else 0) for r in out)


def test_original_between_messages_that_wrote_its_parts(spark):
    """The whole original counts although others wrote each of its shingles before and after it."""
    words = [f"w{i}" for i in range(20)]
    one, two = " ".join(words[:12]), " ".join(words[8:])
    texts = [one, two, " ".join(words), one, two, "> " + " ".join(words) + "\nYes."]
    out = quotes.conversations(spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(texts)], SCHEMA)).collect()
    assert {r.turn: (r.reply_to, r.n_linked) for r in out}[5] == (2, 1)


def test_blocks_of_turns_change_nothing(spark, monkeypatch):
    """Segments and branches that run over many blocks of turns, negative turns and null keys included."""
    rows = [(c, t - 9, r, x) for c, t, r, x in threads(11, 3, 40)] + [(None, 1, "user", "> a"), (1, None, "user", "> a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = sorted(map(str, quotes.conversations(df).collect()))
    monkeypatch.setattr(quotes, "BUCKET", 4)
    assert sorted(map(str, quotes.conversations(df).collect())) == whole


def test_conversations_without_quotes_take_few_jobs(spark):
    """Nothing is searched, chained or ordered for passages that are not there."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.adaptive.enabled")
    rows = [(c, t, "user", f"message {t}") for c in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one job a result, not one a shuffle
    sc.setJobGroup("quotes-few", "")
    try:
        out = quotes.conversations(df).collect()
        stages = sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup("quotes-few"))
    finally:
        sc.setJobGroup("none", "")
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert all((r.reply_to, r.thread, r.branch) == (r.turn - 1 if r.turn else None, 0, 0) for r in out) and len(out) == 30
    assert 0 < stages <= 24, stages
