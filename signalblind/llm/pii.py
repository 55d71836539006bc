"""Personal data: candidate spans, boosted trees, calibrated threshold, redaction.

1. *Generators* propose spans with high recall: the base kinds, whose checks decide at once,
   and two loose kinds (``secret``: long runs of key characters; ``number``: long digit
   runs), which may overlap the others.
2. *Boosted trees* score the loose candidates from their format and the text before them.
   They are fitted on all candidates of all kinds, as distinct feature vectors with their
   numbers: what passes its check, or is introduced by a key word, counts as personal, all
   else as not. Counts of characters are features in steps, so vectors stay few.
3. *A calibrated threshold*, the lowest that reaches the wanted precision on candidates kept
   apart, selects the spans that are added to the base ones.

A text is searched inside its row, by built-in functions only: the pieces between matches
and the matches give all offsets, and the fitted trees become CASE expressions. Nothing is
shuffled but the feature vectors.
"""

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.llm.quality import fenced
from signalblind.session import cut

#: Each attempt starts where a run starts or the last match ended, so a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "number": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){6,}+",
}
BASE = ("email", "ip", "card", "phone")
LOOSE = ("secret", "number")
SPAN = "array<struct<start:int,end:int,hit:string,before:string>>"


def _step(n):
    """A count as it is up to 20, beyond that in quarters of a doubling."""
    return F.when(n <= 20, n).otherwise(20 + F.floor(4 * F.log2(n / 20.0)).cast("int"))


def _among(h, letters):
    return _step(F.length(h) - F.length(F.translate(h, letters, "")))


FEATURES = {
    "size": lambda h, b: _step(F.length(h)),
    "digits": lambda h, b: _among(h, "0123456789"),
    "hex_letters": lambda h, b: _among(h, "abcdef"),
    "capitals": lambda h, b: _among(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "marks": lambda h, b: _among(h, " .-()_/+=@"),
    "luhn": lambda h, b: _luhn(h).cast("int"),
    "octets": lambda h, b: _octets(h).cast("int"),
    "after_key": lambda h, b: b.rlike(KEY).cast("int"),
    "after_label": lambda h, b: b.rlike(r"(?i)(phone|tel|mobile|card|account|iban|ssn|passport|mail)\W*$").cast("int"),
    "after_sign": lambda h, b: b.rlike(r"[=:]\s*[\"']?$").cast("int"),
    "after_word": lambda h, b: b.rlike(r"\p{L}$").cast("int"),
}
KEY = r"(?i)(token|secret|passw(or)?d|api.?key|access.?key|auth|bearer)[\s\"':=]*$"


def _digits(h):
    return F.regexp_replace(h, "[^0-9]", "")


def _luhn(h):
    """13 to 19 digits whose weighted sum ends in 0."""
    d = F.reverse(_digits(h))
    n = F.length(d)
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i)))
    return F.coalesce(F.when((n >= 13) & (n <= 19), total % 10 == 0), F.lit(False))


def _octets(h):
    """Four dotted numbers of at most 255."""
    parts = F.transform(F.split(h, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(F.when(p == "", "0").otherwise(p), F.lit("999")), F.lit(999)) <= 255))
    return h.rlike(r"^[0-9]+(\.[0-9]+){3}$") & small


def _passes(kind, h):
    n = F.length(_digits(h))
    return {"email": lambda: F.lit(True), "ip": lambda: _octets(h), "card": lambda: _luhn(h), "phone": lambda: (n >= 9) & (n <= 15), "secret": lambda: h.rlike("[0-9]"), "number": lambda: F.lit(True)}[kind]()


def _passing(kind):
    return lambda x: _passes(kind, x["hit"])


def _as(kind, *fields, **constants):
    """A span as a struct of its kind, some of its fields and constants."""
    fixed = [F.lit(v).alias(c) for c, v in constants.items()]
    return lambda x: F.struct(F.lit(kind).alias("kind"), *(x[f].alias(f) for f in fields), *fixed)


def candidates(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep`` and one array of spans (start, end, hit, text before) for each kind.

    Offsets are in code points. Base kinds hold the spans that pass their check.
    """
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_whole"))
    sign = {"email": "@", "phone": "+"}
    for kinds in (BASE, LOOSE):
        made = {}
        for k in kinds:
            some = F.col("_whole").contains(sign[k]) if k in sign else F.lit(True)
            hits, nothing = F.regexp_extract_all("_whole", F.lit(PATTERNS[k]), F.lit(0)), F.array().cast("array<string>")
            made[f"hits_{k}"] = F.when(some, hits).otherwise(nothing)
        df = fenced(df, list(df.columns), **made)
    made = {}
    for k in PATTERNS:
        hits = F.col(f"hits_{k}")
        pieces = F.transform(F.split("_whole", PATTERNS[k], -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(32)).alias("before")))
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p["gap"].alias("gap"), p["before"].alias("before"), h.alias("hit")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(s, x):
            start = s["at"] + x["gap"]
            end = start + F.length(x["hit"])
            return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))).alias("out"))

        spans = F.aggregate(both, first, step, lambda s: s["out"])
        made[k] = F.when(F.size(hits) > 0, F.filter(spans, _passing(k))).otherwise(F.array().cast(SPAN))
    return fenced(df, list(keep), **made)


class Trees:
    """Fitted trees as plain thresholds, and the calibrated threshold of their score."""

    def __init__(self, printed, weights, threshold):
        self.printed, self.weights, self.threshold = printed, weights, threshold

    def score(self, values):
        """Score of a candidate whose features are the columns ``values``."""
        total = F.lit(0.0)
        for text, w in zip(self.printed, self.weights):
            total = total + F.lit(float(w)) * self._walk(text, values)
        return 1 / (1 + F.exp(-2 * total))

    def _walk(self, text, values):
        lines = [x.strip() for x in text.split("\n") if re.match(r"\s*(If|Else|Predict)", x)]

        def node():
            line = lines.pop(0)
            if line.startswith("Predict"):
                return F.lit(float(line.split(":")[1]))
            feature, limit = re.match(r"If \(feature (\d+) <= (.*)\)$", line).groups()
            yes = node()
            lines.pop(0)  # the Else of this If
            return F.when(values[int(feature)] <= F.lit(float(limit)), yes).otherwise(node())

        return node()


def fit(found: DataFrame, precision=0.98, trees=10, depth=3):
    """Fit on all candidates; None when there is nothing to tell apart.

    ``found`` has the arrays of ``candidates``. A quarter of the candidates is kept apart for
    the threshold. Equal feature vectors are one row with their number as its weight.
    """
    all_spans = F.flatten(F.array(*(F.transform(k, _as(k, "hit", "before")) for k in PATTERNS)))
    flat = found.select(F.inline(all_spans))
    named = {f: make(F.col("hit"), F.col("before")).cast("double") for f, make in FEATURES.items()}
    personal = F.col("kind").isin(*BASE) | ((F.col("kind") == "secret") & F.col("before").rlike(KEY)) | ((F.col("kind") == "number") & _luhn(F.col("hit")))
    part = F.pmod(F.xxhash64(F.lit("part"), "hit", "before"), F.lit(4)) == 0
    rows = flat.select(part.alias("apart"), personal.cast("double").alias("label"), *(c.alias(n) for n, c in named.items()))
    rows = rows.groupBy("apart", "label", *FEATURES).agg(F.count("*").cast("double").alias("n"))
    rows = cut(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).repartition(1).sortWithinPartitions("apart", "label", *FEATURES))
    train, apart = rows.filter(~F.col("apart")), rows.filter("apart")
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(classes) < 2:
        return None
    # with so many bins Spark takes the limits of the splits from all rows
    bins = max(32, math.isqrt(sum(classes.values())) + 1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=1, weightCol="n").fit(train)
    fitted = Trees([t.toDebugString for t in model.trees], model.treeWeights, 1.0)
    scored = apart.select("label", "n", F.floor(fitted.score([F.col(f) for f in FEATURES]) * 50).cast("int").alias("bin"))
    bins = sorted(((r["bin"], r["n"], r["good"]) for r in scored.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()), reverse=True)
    n = good = 0
    for b, k, g in bins:  # at most 51 bins
        n, good = n + k, good + g
        if good >= precision * n:
            fitted.threshold = max(b, 25) / 50
    return fitted


def detect(docs: DataFrame, model="fit", keep=("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``, an array of (kind, start, end, base) in the order of kinds and starts.

    Base spans always stay; loose candidates that the trees select are added unless a base
    span overlaps them. Offsets are code points, ends exclusive. Null and empty texts have
    no spans; repeated rows are treated alike; other columns are ignored; an empty table
    gives no rows. ``model`` is what ``fit`` returned, or "fit" to fit on these documents.
    """
    found = candidates(docs, keep)
    if model == "fit":
        found = cut(found)
        model = fit(found)
    base = F.flatten(F.array(*(F.transform(k, _as(k, "start", "end", base=True)) for k in BASE)))
    if model is None:
        return found.select(*keep, base.alias("spans"))
    found = fenced(found, [*keep, *LOOSE], base=base)
    made = {}
    for k in LOOSE:
        featured = F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *(make(x["hit"], x["before"]).cast("double").alias(f) for f, make in FEATURES.items())))
        made[k] = F.when(F.size(k) > 0, featured)
    found = fenced(found, [*keep, "base"], **made)
    chosen = {}
    for k in LOOSE:
        free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        some = F.filter(k, lambda x: (model.score([x[f] for f in FEATURES]) >= model.threshold) & free(x))
        chosen[k] = F.coalesce(F.transform(some, _as(k, "start", "end", base=False)), F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"))
    return found.select(*keep, F.concat("base", *chosen.values()).alias("spans"))


def written(spans):
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, model="fit") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    # columns travel under numbers, so none can clash with the spans
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.col("text").alias("text"))
    found = detect(rows, model, tuple(own.values()))
    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))))
    found = fenced(found, list(own.values()), spans=by_place, _text=F.col(own["text"]))
    # walk along the text: what was copied so far ends at ``at``
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        cut_ = F.array_append(F.array_append(s["out"], F.substring("_text", s["at"] + 1, x["start"] - s["at"])), F.concat(F.lit("<"), x["kind"], F.lit(">")))
        inside = x["start"] < s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(inside, s["out"]).otherwise(cut_).alias("out"))

    done = F.aggregate("spans", first, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring("_text", s["at"] + 1, F.length("_text"))))
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("_text")).alias("text")
    return found.select(*(text if c == "text" else F.col(n).alias(c) for c, n in own.items()))
