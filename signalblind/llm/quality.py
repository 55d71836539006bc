"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good, bad, or abstains. What the votes
are worth is not set by hand: expectation-maximisation over all documents estimates, for
each rule, how often it votes which way on good and on bad texts, without any labels. A document's
posterior probability of being good then decides instead of a list of tests that all have
to pass. Everything is built-in expressions; the documents are aggregated to vote patterns,
at most 3 ** rules of them, before EM sees them.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: name, when it votes bad, when it votes good (abstains otherwise; no fault is no praise)
RULES = [
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "abs(ln(greatest(word_chars, 1) / greatest(n_words, 1) / 5)) > 1", "false"),
    ("plain_words", "n_plain < 0.6 * n_words", "n_plain >= 0.9 * n_words"),
    ("symbols", "n_symbols > 0.03 * word_chars", "false"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "false"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "false"),
    ("capitals", "n_capitals > 0.3 * word_chars", "false"),
    ("exclamations", "n_exclamations > 0.2 * n_words", "false"),
]


def fenced(df: DataFrame, keep, **columns) -> DataFrame:
    """Add computed columns behind a one-row generator, so that they are computed once."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*keep, F.inline(F.array(made)))


def counts(docs: DataFrame) -> DataFrame:
    """The counts that the rules look at, for every row; null texts are empty.

    n_repeat_words: words covered by a 3-word window that occurs twice or more. The windows'
    hashes are sorted with their places; equal neighbours are the repeats, and overlapping
    windows are counted by the gaps between their places.
    """
    df = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    squeezed = F.translate("text", BLANKS, "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    df = fenced(
        df, ["doc_id"], words=F.filter(F.split("text", BLANK, -1), lambda w: w != ""), lines=lines, word_chars=F.length(squeezed).cast("bigint"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint"),
        n_exclamations=(F.length("text") - F.length(F.translate("text", "!", ""))).cast("bigint"),
        n_capitals=(F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("bigint"),
    )
    word = lambda i: F.get("words", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    df = fenced(
        df, ["doc_id", "word_chars", "n_symbols", "n_exclamations", "n_capitals"], n_words=F.size("words").cast("bigint"), n_lines=F.size("lines").cast("bigint"),
        n_plain=F.size(F.filter("words", lambda w: w.rlike(r"^[\p{L}'-]+[.,;:!?]?$"))).cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        hashes=F.when(F.size("words") >= 4, windows).otherwise(F.array().cast("array<bigint>")),
    )
    plain = [c for c in df.columns if c != "hashes"]
    placed = F.sort_array(F.transform("hashes", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    nothing = F.array().cast("array<struct<x:bigint,i:int>>")
    df = fenced(df, plain, placed=F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed).otherwise(nothing))
    same = lambda e, j: F.get("placed", j)["x"] == e["x"]
    repeated = F.filter("placed", lambda e, j: F.coalesce(((j > 0) & same(e, F.greatest(j - 1, F.lit(0)))) | F.coalesce(same(e, j + 1), F.lit(False)), F.lit(False)))
    df = fenced(df, plain, at=F.sort_array(F.transform(repeated, lambda e: e["i"])))
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    return df.select(*plain, total.alias("n_repeat_words"))


def votes(counted: DataFrame, rules=RULES) -> DataFrame:
    """Add one column a rule: 1 good, -1 bad, 0 abstains."""
    made = {f"vote_{n}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for n, bad, good in rules}
    return counted.withColumns(made)


def patterns(voted: DataFrame, rules=RULES):
    """How often each combination of votes occurs: at most 3 ** rules rows."""
    names = [f"vote_{n}" for n, *_ in rules]
    return [(tuple(r[n] for n in names), r["count"]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]


def estimate(observed, rules=len(RULES), rounds=200):
    """(prior of good, for each rule its rates of bad, no and good votes on good and bad texts).

    EM for two classes with rules independent within a class. It starts from the number of
    bad votes. One pseudo-text a rate keeps all of them above 0.
    """
    post = [(0.95, 0.3)[sum(x < 0 for x in v)] if sum(x < 0 for x in v) < 2 else 0.05 for v, _ in observed]
    total = sum(n for _, n in observed)
    prior, rates = 0.9, [((1 / 3,) * 3, (1 / 3,) * 3)] * rules
    for _ in range(rounds if total else 0):
        prior = (sum(p * n for p, (_, n) in zip(post, observed)) + 0.9) / (total + 1)
        rates = []
        for j in range(rules):
            seen = [[1.0] * 3, [1.0] * 3]
            for p, (v, n) in zip(post, observed):
                seen[0][v[j] + 1] += p * n
                seen[1][v[j] + 1] += (1 - p) * n
            rates.append(tuple(tuple(x / sum(s) for x in s) for s in seen))
        new = [1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds((prior, rates), v))))) for v, _ in observed]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return prior, rates


def _weight(rate, vote):
    good, bad = rate
    return math.log(good[vote + 1] / bad[vote + 1])


def log_odds(model, v):
    prior, rates = model
    return math.log(prior / (1 - prior)) + sum(_weight(r, x) for r, x in zip(rates, v))


def posterior(model, rules=RULES):
    """Column: probability of being good, from the votes."""
    prior, rates = model
    z = F.lit(math.log(prior / (1 - prior)))
    for (name, *_), r in zip(rules, rates):
        v = F.col(f"vote_{name}")
        z = z + F.when(v > 0, F.lit(_weight(r, 1))).when(v < 0, F.lit(_weight(r, -1))).otherwise(F.lit(_weight(r, 0)))
    return 1 / (1 + F.exp(-z))


def judged(docs: DataFrame, threshold=0.5, rules=RULES) -> DataFrame:
    """One row per row: doc_id, the counts, the votes, base_failed, quality, kept.

    ``base_failed``: fewer than 50 words, or over half the words lie in repeated windows.
    ``kept`` is false for those and else whether ``quality``, the posterior, reaches
    ``threshold``. Null and empty texts have no words and fail; repeated rows are judged
    alike; an empty table gives no rows; other columns are ignored.
    """
    from signalblind.session import cut

    voted = cut(votes(counts(docs), rules))
    model = estimate(patterns(voted, rules), len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", posterior(model, rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
