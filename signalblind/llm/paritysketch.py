"""Set similarity join on parity sketches.

A token flips one bit of a sketch, so two sketches differ in at most as many bits as the
sets differ in tokens. Sets of Jaccard similarity 90/100 differ in at most a nineteenth of
their summed sizes. In a size band that number has a bound D; a sketch cut into D + 1
segments must then agree in one segment (pigeonhole), which is an equi-join. Pairs found
are pruned by the Hamming distance of a short second sketch and verified exactly.

Unrelated sets must not meet, or candidates grow as the square of the corpus. A segment is
therefore so wide that two tokens never share a bit, and is held as the XOR of the hashed
positions of its set bits. Empty segments agree in unrelated sets, so each band has some
spare segments: a set with no more empty segments than spares leaves them out, for one of
the D + 1 + spare segments is then both untouched and not empty. Only a set with more empty
ones shows them, and so does any similar set that would not be found without. The same goes
for segments that a thousandth of all documents show, such as a single token of a common
passage: equal segments are hot for both sets, so hiding them loses nothing as long as empty
and hot ones together are no more than the spares.

Groups are never expanded: identical sets become one class, named by a hash of the set,
every member of a segment's group is compared with the group's smallest member only, and of
the rest just those pairs are looked at that are not yet known to be connected and that the
triangle inequality (Jaccard distance is a metric) does not rule out.

Segments are never stored with the documents. One pass over the texts makes the classes and
finds keys that very many documents show; a second one sends each key of a class, as four
bytes beside its bucket, to the bucket that tells which keys several classes show. The very
frequent ones are known to be shared and skip the buckets, so none of these grows with them.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.llm import text as T
from signalblind.llm.components import components, forest
from signalblind.session import cut, shuffle_partitions

MINI = 512
BLOCK = 4096


class Bands:
    """Size bands and their segment numbers for similarity ``num`` / ``den``."""

    def __init__(self, num=90, den=100, growth=1.5):
        self.num, self.den = num, den
        # |A xor B| * (num + den) <= (den - num) * (|A| + |B|)
        self.edges = [max(1, (num + den - 1) // (2 * (den - num)))] if num < den else [1 << 40]
        while self.edges[-1] < 1 << 40:
            self.edges.append(int(self.edges[-1] * growth) + 1)
        self.edges = np.array(self.edges, np.int64)

        self.plans = [self._plan(band) for band in range(len(self.edges))]

    def _plan(self, band):
        most = int(2 * self.edges[band] * (self.den - self.num) // (self.den + self.num))
        if most == 0:
            return 1, 0
        least = self.num * (int(self.edges[band - 1]) + 1) / self.den if band else 1
        top, spare, wanted = max(1, most // 8), 0, 1
        while spare < min(wanted, top):  # climbs to the least number that is enough
            spare = min(wanted, top)
            k = most + 1 + spare
            empty = k * np.exp(-least / k)  # as many in the smallest set, on average
            wanted = int(np.ceil(empty + 3 * np.sqrt(empty))) + 2 + most // 20  # the last for hot ones
        return k, spare

    def segments(self, band):
        """Number of segments of a band, and how many of them are spare."""
        return self.plans[band]

    def of(self, n):
        """Bands in which a set of size n can meet one at least as large, or smaller."""
        own = int(np.searchsorted(self.edges, n))
        next_ = own + 1 < len(self.edges) and n * self.den >= self.num * (int(self.edges[own]) + 1)
        return (own, own + 1) if next_ else (own,)


_U = np.uint64


def short_sketch(values):
    """Parity sketch of two to four bits a token, :data:`MINI` at least, so that it never fills up."""
    size = max(MINI, 1 << int(2 * len(values) - 1).bit_length())
    return np.packbits(parity(values >> _U(8), size), bitorder="little").tobytes()


def parity(values, bits):
    """Bits of the sketch of ``values`` (already mixed) as a flat array of 0 and 1."""
    return (np.bincount((values >> _U(16)) % _U(bits), minlength=bits) & 1).astype(np.uint8)


NO_KEYS = np.zeros(0, np.uint64)


def among(keys, known):
    """Which keys are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def segment_keys(values, n, bands, hot=NO_KEYS):
    """One 64-bit key for each segment shown and band; equal segments give equal keys."""
    out, bits = [], T.mix(values)
    for band in bands.of(n):
        k, spare = bands.segments(band)
        if k == 1:
            continue  # only equal sets, which are one class already
        segments = np.zeros(k, np.uint64)
        np.bitwise_xor.at(segments, ((values >> _U(16)) % _U(k)).astype(np.intp), bits)
        place = T.mix(np.arange(k, dtype=np.uint64) + (_U(band) << _U(40)))
        keys, full = T.mix(segments ^ place) + place, segments != 0
        cold = full & ~among(keys, hot) if len(hot) else full
        for shown in (cold, full):
            if k - shown.sum() <= spare:
                keys = keys[shown]
                break
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


HOT = 256
HOT_KEYS = 1 << 20
BUCKET = 1 << 19
CHUNK = 1 << 19


def profiles(docs: DataFrame, words, bands, carry=()) -> DataFrame:
    """(doc_id, ``carry``, n, number of keys, two hashes of the set, short sketch) of every text.

    Rows with n = -1 hold keys that many texts of a task show, how many, and one of their sets.
    """
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    names = ["doc_id", *carry, "n", "keys", "h1", "h2", "mini", "frequent"]

    def run(batches):
        found, sets, held, types = [], [], 0, None

        def frequent():
            keys, of = np.concatenate(found), np.repeat(np.array([h for h, _ in sets], np.int64), [k for _, k in sets])
            value, first, n = np.unique(keys, return_index=True, return_counts=True)
            often = n >= max(8, len(sets) // 1000)
            triple = np.column_stack([value[often].view(np.int64), n[often], of[first[often]]])
            blank = [pa.nulls(1, t) for t in types]
            found.clear(), sets.clear()
            return pa.RecordBatch.from_arrays([*blank, pa.array([-1], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([triple.tobytes()], pa.binary())], names)

        for batch in batches:
            types = [batch.column(c).type for c in ("doc_id", *carry)]
            texts = T.column(batch, "text")
            for lo, hi, data, offsets in T.groups(texts):
                ids, rows = batch.column("doc_id").slice(lo, hi - lo), []
                for i, s in zip(ids, T.Words(data, offsets, lower=True).shingle_sets(words)):
                    mixed = T.mix(s)
                    keys, (h1, h2) = segment_keys(mixed, len(s), bands), T.set_hash(s)
                    rows.append((len(s), len(keys), h1, h2, short_sketch(mixed)))
                    if len(keys) and i.is_valid:
                        found.append(keys)
                        sets.append((h1, len(keys)))
                        held += len(keys)
                cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", *carry)), *cols, pa.array([r[4] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], names)
                if held >= CHUNK:
                    yield frequent()
                    held = 0
        if found:
            yield frequent()

    return docs.select("doc_id", *carry, "text").mapInArrow(T.released(run), f"{kinds}, n bigint, keys bigint, h1 bigint, h2 bigint, mini binary, frequent binary")


def hot_keys(profile: DataFrame, total):
    """(keys in order, how often, a set that shows each): at least a millionth of all entries, so at most a million."""

    def run(batches):
        for batch in batches:
            for data in batch.column("frequent").to_pylist():
                t = np.frombuffer(data, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(t[:, k]) for k in range(3)], ["key", "c", "rep"])

    often = profile.filter("n = -1").select("frequent").mapInArrow(run, "key bigint, c bigint, rep bigint")
    least = max(HOT, total // HOT_KEYS)
    rows = often.groupBy("key").agg(F.sum("c").alias("c"), F.min("rep").alias("rep")).filter(F.col("c") >= least).toArrow()
    key, c, rep = (rows[n].to_numpy() for n in ("key", "c", "rep"))
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], c[order], rep[order]


def classes_of(profile: DataFrame):
    """(name, n, h1, h2, smallest doc_id, mini) of every distinct set, and names other than h1.

    A set is named by its first hash. Of sets that share one by chance, of which the largest
    corpora have a handful, all but the first get another hash.
    """
    alive = profile.filter("n > 0 and doc_id is not null")
    sets = cut(alive.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.min("mini").alias("mini")))
    twice = sets.groupBy("h1").agg(F.count("*").alias("c"), F.min(F.struct("h2", "n")).alias("first")).filter("c > 1").collect()
    if not twice:
        return sets.withColumn("name", F.col("h1")), {}
    first = [(F.col("h1") == r["h1"]) & (F.col("h2") == r["first"]["h2"]) & (F.col("n") == r["first"]["n"]) for r in twice]
    other = F.col("h1").isin([r["h1"] for r in twice]) & ~functools.reduce(lambda a, b: a | b, first)
    named = sets.withColumn("name", F.when(other, F.xxhash64("h1", "h2", "n")).otherwise(F.col("h1")))
    return named, {(r["h1"], r["h2"], r["n"]): r["name"] for r in named.filter("name <> h1").collect()}


def _names(sets, renamed):
    for s in sets:
        h1, h2 = T.set_hash(s)
        yield renamed.get((h1, h2, len(s)), h1)


def shared_keys(docs: DataFrame, classes: DataFrame, renamed, words, bands, hot, total) -> DataFrame:
    """(key, c, name, rep) of the keys that several classes show: c members, rep one of them."""
    some = docs.select("doc_id", "text").join(small(classes.select("doc").distinct()), F.col("doc_id") == F.col("doc"), "left_semi")
    buckets = max(1, -(-total // BUCKET), shuffle_partitions(docs.sparkSession))
    known, often_shown, shown_by = hot

    def ask(batches):
        keys, names, held = [], [], 0

        def rows():
            k, n = np.concatenate(keys), np.concatenate(names)
            keys.clear(), names.clear()
            at, often = np.searchsorted(known, k), among(k, known)
            for i in np.unique(at[often]).tolist():  # known to be shared: straight on, spread by the members
                some = n[often & (at == i)]
                yield -1 - int(some[0]) % buckets, i, b"", some
            k, n = k[~often], n[~often]
            b = T.bucket_of(k, buckets)
            order = np.argsort(b, kind="stable")
            b, k, n = b[order], k[order].astype(np.uint32), n[order]
            for bucket, lo, hi in T.slices(b):
                yield bucket, None, k[lo:hi].tobytes(), n[lo:hi]

        def batch_of(rows):
            bucket, key, low, name = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(key, pa.int64()), pa.array(low, pa.binary()), pa.array([x.tobytes() for x in name], pa.binary())], ["bucket", "key", "low", "name"])

        for batch in batches:
            texts = T.column(batch, "text")
            for _, _, data, offsets in T.groups(texts):
                sets = [s for s in T.Words(data, offsets, lower=True).shingle_sets(words) if len(s)]
                for s, name in zip(sets, _names(sets, renamed)):
                    keys.append(segment_keys(T.mix(s), len(s), bands, known))
                    names.append(np.full(len(keys[-1]), name, np.int64))
                    held += len(keys[-1])
                if held >= CHUNK:
                    yield batch_of(rows())
                    held = 0
        if held:
            yield batch_of(rows())

    def pass_on(table):
        out = []
        for i, data in zip(table["key"].to_pylist(), table["name"].to_pylist()):
            doc = np.unique(np.frombuffer(data, np.int64))
            out.append(np.column_stack([np.full(len(doc), -1 - i), np.full(len(doc), often_shown[i]), doc, np.full(len(doc), shown_by[i])]))
        return pa.table(list(np.concatenate(out).T), ["key", "c", "doc", "rep"])

    def meet(table):
        if table["bucket"][0].as_py() < 0:
            return pass_on(table)
        low, name = T.joined(table["low"], np.uint32), T.joined(table["name"], np.int64)
        order = np.lexsort((name, low))
        low, name = low[order], name[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1])
        low, name = low[new], name[new]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(low)])
        c = np.repeat(n, n)
        keep = c > 1
        key = (np.int64(table["bucket"][0].as_py()) << 32) | low.astype(np.int64)
        return pa.table({"key": key[keep], "c": c[keep], "doc": name[keep], "rep": np.repeat(name[first], n)[keep]})

    schema = "key bigint, c bigint, doc bigint, rep bigint"
    asked = some.mapInArrow(T.released(ask), "bucket bigint, key bigint, low binary, name binary")
    return asked.groupBy("bucket").applyInArrow(meet, schema)


def sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame, renamed, words) -> DataFrame:
    """(doc, shingles) of the classes in ``names`` (column doc, distinct), read from their texts again."""
    wanted = classes.select("name", F.col("doc").alias("_id")).join(names, F.col("name") == F.col("doc"), "left_semi").select("_id").distinct()
    some = docs.select("doc_id", "text").join(small(wanted), F.col("doc_id") == F.col("_id"), "left_semi")

    def run(batches):
        for batch in batches:
            texts = T.column(batch, "text")
            for _, _, data, offsets in T.groups(texts):
                sets = [s for s in T.Words(data, offsets, lower=True).shingle_sets(words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(list(_names(sets, renamed)), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc", "shingles"])

    return some.mapInArrow(T.released(run), "doc bigint, shingles array<bigint>").join(names, "doc", "left_semi").groupBy("doc").agg(F.any_value("shingles").alias("shingles"))


BROADCAST_ROWS = 1 << 20


def small(ids: DataFrame) -> DataFrame:
    """Mark a table of single numbers for broadcasting when it has at most a million rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def shared_shingles(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the exact number of shingles that both hold."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("shared"))


def near(a, b, na, nb, num, den):
    """Pairs of short sketches that the Hamming distance and the sizes don't rule out, and the distance."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (apart * (num + den) <= (den - num) * (na + nb)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb)), apart


def folded(sketches, size):
    """Sketches (bytes of equal length) as words, folded to ``size`` bytes: bits modulo a power of two."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] * 8 > size:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def alike_in_length(column):
    """Sketches of a column as a matrix, all folded to the shortest."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(sizes.min()) // 8), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = folded([rows[i] for i in at], int(sizes.min()))
    return out


def plausible(pairs: DataFrame, classes: DataFrame, num, den) -> DataFrame:
    """Pairs (a, b) that the short sketches leave, with both sizes."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("mini").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ma, mb, na, nb = (batch.column(c).to_pylist() if c[0] == "m" else batch.column(c).to_numpy() for c in ("ma", "mb", "na", "nb"))
                sizes = np.array([(len(a), len(b)) for a, b in zip(ma, mb)])
                ok = np.zeros(batch.num_rows, bool)
                for pair in np.unique(sizes, axis=0):
                    at = np.flatnonzero((sizes == pair).all(axis=1))
                    for at in np.array_split(at, 1 + len(at) * int(pair.max()) // (1 << 24)):
                        ok[at] = near(folded([ma[i] for i in at], pair.min()), folded([mb[i] for i in at], pair.min()), na[at], nb[at], num, den)[0]
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return both.mapInArrow(T.released(run), "a bigint, b bigint, na bigint, nb bigint")


def unsettled(members: DataFrame, num, den, most=1 << 62) -> DataFrame:
    """Distinct plausible pairs (a, b) of a key's members that are in different components.

    A member shows at most ``most`` of its partners in a unit, the nearest ones; a pair of
    nulls tells that some showed not all. Members of a large group of near copies become one
    component by a few of their pairs, so the others need never come out.

    ``members`` has key, c (members of the key), doc, rep, comp, n, mini. A key with many
    members is cut into blocks by a hash of the id, and each pair of blocks is a unit of
    its own, so no task holds more than two blocks of a key; pairs are compared as bits
    inside the task and only what is left comes out.
    """
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    units = members.withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = units.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "rep", "comp", "n", "mini")
    units = units.repartition(shuffle_partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "comp", "doc")

    def compare(t):
        doc, rep, comp, n, own = (t[c].to_numpy() for c in ("doc", "rep", "comp", "n", "own"))
        mini, i, j = alike_in_length(t["mini"]), int(t["i"][0].as_py()), int(t["j"][0].as_py())
        left = np.flatnonzero((own == i) & (doc != rep))
        right = left if i == j else np.flatnonzero((own == j) & (doc != rep))
        step = max(1, (1 << 20) // max(1, len(right) * mini.shape[1]))
        for lo in range(0, len(left), step):
            x = left[lo : lo + step, None]
            y = right[None, :]
            ok, apart = near(mini[x], mini[y], n[x], n[y], num, den)
            ok &= comp[x] != comp[y]
            if i == j:
                ok &= doc[x] < doc[y]
            a, b = np.nonzero(ok)
            many = np.bincount(a, minlength=len(x)) > most
            if many.any():
                order = np.lexsort((b, apart[a, b], a))
                a, b = a[order], b[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, b = a[place < most], b[place < most]
                yield None
            yield np.column_stack([doc[x[a, 0]], doc[right[b]]])

    def run(batches):
        held, found, more = None, [], False

        def take(pairs):
            nonlocal found, more
            for p in pairs:
                more |= p is None
                found += [p] if p is not None else []

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                take(compare(held.slice(lo, hi - lo)))
            held = held.slice(int(cuts[-1])) if len(cuts) else held
            if sum(map(len, found)) > 100_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        if held is not None and held.num_rows:
            take(compare(held))
        if found:
            p = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["a", "b"])

    return units.mapInArrow(T.released(run), "a bigint, b bigint").distinct()


def linked(docs: DataFrame, num=90, den=100, words=3, carry=()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link when ``den`` * intersection >= ``num`` * union of their sets of
    distinct ``words``-word shingles (letters A-Z lower-cased; a text with fewer words is
    one shingle). ``component_id`` is the smallest doc_id reachable by links. Texts that
    are null or have no word have the empty set, link with nothing and keep their own id.
    A row without a doc_id comes out with its size and the component of its copies, or null;
    identical rows come out alike. An id may stand for several texts: each has the component
    of its own text. With ``carry`` those columns come too, and ``component``, which tells
    components apart even where one id has several texts (null for the empty set and for rows
    without doc_id and copies). An empty table gives no rows; other columns are ignored.
    """
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, "text")
    profile = cut(profiles(docs, words, bands, carry))
    rows = profile.filter("n >= 0").drop("frequent")
    classes, renamed = classes_of(rows)
    total = rows.agg(F.sum("keys")).first()[0] or 0
    shared = cut(shared_keys(docs, classes, renamed, words, bands, hot_keys(profile, total), total))
    size_of = classes.select(F.col("name").alias("doc"), "n", "mini")

    def verified(pairs):
        pairs = cut(plausible(pairs, size_of, num, den))
        names = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        counted = shared_shingles(pairs, sets_of(docs, classes, names, renamed, words))
        return counted.filter(F.col("shared") * den >= num * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")

    star = cut(verified(shared.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()))
    # members of a large group link with the same few representatives: one link each is enough
    label = components(forest(star)).select(F.col("node").alias("doc"), "component")
    members = cut(shared.join(label, "doc", "left").select("key", "c", "doc", "rep", F.coalesce("component", "doc").alias("comp")))
    most = 1
    while True:
        # the nearest partners first: what they connect asks for no more; the last round shows all that is left
        mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        pairs = cut(unsettled(members.join(mixed, "key", "left_semi").join(size_of, "doc"), num, den, most))
        rest = verified(pairs.filter("a is not null"))
        label = components(label.select(F.col("doc").alias("a"), F.col("component").alias("b")).unionAll(rest)).select(F.col("node").alias("doc"), "component")
        if pairs.filter("a is null").isEmpty():
            break
        most *= 64
        members = cut(members.join(label, "doc", "left").select("key", "c", "doc", "rep", F.coalesce("component", "comp").alias("comp")))
    label = label.withColumnRenamed("doc", "name")
    found = cut(classes.select("n", "h1", "h2", "doc", "name").join(label, "name", "left").withColumn("component", F.coalesce("component", "name")))
    least = found.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_set = found.select("n", "h1", "h2", "component").join(least, "component")
    out = rows.select("doc_id", *carry, "n", "h1", "h2").join(of_set, ["n", "h1", "h2"], "left")
    kept = [*carry, "component"] if carry else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *kept)
