"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- SQL building blocks ---------------------------------------------------------------

ROLE_SQL = """CASE WHEN label <= 3 THEN 'laser' WHEN label <= 6 THEN 'control' WHEN label = 7 THEN 'matched_control'
  WHEN label = 8 THEN 'sensor_noise' ELSE 'synthetic_positive' END"""

FRAMES = f"""frames AS (
  SELECT 'cap-' || label AS capture_id, format('frame-{{:08d}}', vec_id) AS frame_id, vec_id AS frame_index,
         {ROLE_SQL} AS role, embedding
  FROM embeddings)"""

CELLS = FRAMES + """, cells AS (
  SELECT frame_id, capture_id, frame_index, role, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.55) * 230))) AS INTEGER) AS v
  FROM (SELECT *, unnest(embedding) AS e, unnest(range(64)) AS pos FROM frames))"""

PACKED = CELLS + """, packed AS (
  SELECT frame_id, any_value(capture_id) AS capture_id, any_value(frame_index) AS frame_index, any_value(role) AS role,
         list(v ORDER BY y, x) AS px FROM cells GROUP BY frame_id),
ys AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS y), xs AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS x)"""

MOSAIC = CELLS + """, mosaic_grid AS (
  SELECT m, CAST(unnest(range(4096)) AS INTEGER) AS pos FROM (SELECT DISTINCT frame_index // 64 AS m FROM frames)),
mosaic AS (
  SELECT format('mosaic-{:06d}', g.m) AS frame_id, g.m AS frame_index, g.pos // 64 AS y, g.pos % 64 AS x, coalesce(c.v, 0) AS v
  FROM mosaic_grid g LEFT JOIN cells c
    ON c.frame_index = g.m * 64 + (g.pos // 64 // 8) * 8 + (g.pos % 64) // 8
   AND c.y = (g.pos // 64) % 8 AND c.x = (g.pos % 64) % 8)"""

MOSAIC_PACKED = MOSAIC + """, packed AS (SELECT frame_id, list(v ORDER BY y, x) AS px FROM mosaic GROUP BY frame_id),
ys AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS y), xs AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS x)"""

RESULTS = """roles AS (
  SELECT l_orderkey AS sample_id,
         CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'laser' ELSE 'control' END AS unblinded_label
  FROM lineitem GROUP BY 1),
results AS (
  SELECT l.l_orderkey AS sample_id, l.l_linenumber AS variant, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
         round(l_discount * 10, 6) AS score, round(l_tax * 10, 6) AS persistence, round(l_quantity / 50, 6) AS symbol,
         round(l_discount * 10, 6) AS diffraction, round(l_tax * 10, 6) AS speckle,
         round(l_quantity / 100 + l_tax * 5, 6) AS texture, r.unblinded_label
  FROM lineitem l JOIN roles r ON l.l_orderkey = r.sample_id)"""

STAT_ROLE = """CASE WHEN unblinded_label = 'laser' THEN 'laser'
  WHEN unblinded_label IN ('control', 'matched_control', 'sensor_noise', 'synthetic_negative') THEN 'control'
  WHEN unblinded_label = 'synthetic_positive' THEN 'calibration' ELSE 'other' END"""


def scores_sql(source="results", score="score", persistence="persistence"):
    return f"""scores AS (
  SELECT sample_id, unblinded_label, variants, s / variants / 1e6 AS score, p / variants / 1e6 AS persistence,
         {STAT_ROLE} AS role
  FROM (SELECT sample_id, any_value(unblinded_label) AS unblinded_label, count(*) AS variants,
               sum(CAST(floor({score} * 1e6 + 0.5) AS BIGINT)) AS s,
               sum(CAST(floor({persistence} * 1e6 + 0.5) AS BIGINT)) AS p
        FROM {source} GROUP BY sample_id))"""


SCORES = RESULTS + ", " + scores_sql()

# Empirical p and step-up q over ``scores``.
EMPIRICAL = """keyed AS (SELECT *, CAST(floor(score * 1000 * 1e6 + 0.5) AS BIGINT) AS sv FROM scores),
levels AS (SELECT sv, count(*) FILTER (WHERE role = 'control') AS c FROM keyed GROUP BY sv),
above AS (SELECT sv, sum(c) OVER (ORDER BY sv DESC) AS ge, sum(c) OVER () AS n FROM levels),
empirical AS (SELECT k.*, round(CAST(a.ge + 1 AS DOUBLE) / CAST(a.n + 1 AS DOUBLE), 6) AS p_value
              FROM keyed k JOIN above a USING (sv))"""

STEP_UP = """plevels AS (SELECT p_value, count(*) AS n FROM empirical GROUP BY p_value),
pranked AS (SELECT p_value, p_value * CAST(sum(n) OVER () AS DOUBLE) / CAST(sum(n) OVER (ORDER BY p_value) AS DOUBLE) AS raw FROM plevels),
qlevels AS (SELECT p_value, round(least(1.0, min(raw) OVER (ORDER BY p_value DESC)), 6) AS q_value FROM pranked),
qvalues AS (SELECT e.*, q.q_value FROM empirical e JOIN qlevels q USING (p_value))"""


def permutation_sql(seed, permutations=1000):
    """Reference form of the permutation test: sort every permutation outright."""
    return f"""pool AS (SELECT sample_id, role, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS mv FROM scores WHERE role IN ('laser', 'control')),
counts AS (SELECT count(*) FILTER (WHERE role = 'laser') AS na, count(*) AS n_all,
                  sum(mv) FILTER (WHERE role = 'laser') AS observed FROM pool),
digests AS (SELECT sample_id, mv, b, md5('{seed}:' || b || ':' || sample_id) AS h
            FROM pool, (SELECT unnest(range({(permutations + 3) // 4})) AS b)),
keys AS (SELECT sample_id, mv, b * 4 + i AS perm, substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS k
         FROM digests, (SELECT unnest(range(4)) AS i)),
drawn AS (SELECT perm, sum(mv) FILTER (WHERE r <= na) AS s
          FROM (SELECT perm, mv, row_number() OVER (PARTITION BY perm ORDER BY k, sample_id) AS r FROM keys WHERE perm < {permutations}), counts
          GROUP BY perm),
permuted AS (SELECT CASE WHEN na > 0 AND n_all > na THEN round((count(*) FILTER (WHERE s >= observed) + 1) / {permutations + 1}.0, 6) END
               AS permutation_p_value FROM drawn, counts GROUP BY na, n_all)"""


def mirrored(expr, n=8):
    m = f"(((({expr}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END)"


def repeated(expr, n=8):
    return f"least(greatest({expr}, 0), {n - 1})"


def hash_tree_sql(rows, by="all_rows", levels=6):
    """Nodes ``l0`` .. of the hash trees over ``rows`` (``by``, h), for groups of up to 16 ** (levels + 1) rows."""
    parts = [f"""tree_leaves AS (SELECT {by}, h, count(*) AS n FROM ({rows}) GROUP BY {by}, h),
depths AS (SELECT {by}, length(format('{{:x}}', count(*) - 1)) - 1 AS depth FROM tree_leaves GROUP BY {by}),
tree_ends AS (SELECT l.{by}, depth, substr(h, 1, depth) AS prefix, sha256(string_agg(h || ':' || n, '' ORDER BY h)) AS digest, sum(n) AS n
  FROM tree_leaves l JOIN depths d ON l.{by} IS NOT DISTINCT FROM d.{by} GROUP BY l.{by}, depth, substr(h, 1, depth))"""]
    for level in range(levels, -1, -1):
        upper = "" if level == levels else f""" UNION ALL SELECT {by}, substr(prefix, 1, {level}), sha256(string_agg(digest, '' ORDER BY prefix)), sum(n)
  FROM l{level + 1} GROUP BY {by}, substr(prefix, 1, {level})"""
        parts.append(f"l{level} AS (SELECT {by}, prefix, digest, n FROM tree_ends WHERE depth = {level}{upper})")
    return ", ".join(parts)


def at(y, x, px="px", n=8):
    return f"{px}[{y} * {n} + {x} + 1]"


OTSU = """hist AS (SELECT frame_id, v, count(*) AS c FROM {src} GROUP BY 1, 2),
cum AS (SELECT frame_id, v, sum(c) OVER w AS n, sum(c * v) OVER w AS s,
               sum(c) OVER (PARTITION BY frame_id) AS total, sum(c * v) OVER (PARTITION BY frame_id) AS weight
        FROM hist WINDOW w AS (PARTITION BY frame_id ORDER BY v)),
variance AS (SELECT frame_id, v, CASE WHEN n * (total - n) > 0
        THEN CAST(total * s - n * weight AS DOUBLE) * CAST(total * s - n * weight AS DOUBLE) / CAST(n * (total - n) AS DOUBLE) ELSE 0 END AS var FROM cum),
levels_ranked AS (SELECT frame_id, v, var, row_number() OVER (PARTITION BY frame_id ORDER BY var DESC, v) AS r FROM variance),
otsu AS (SELECT frame_id, CASE WHEN var > 0 THEN v ELSE 0 END AS t FROM levels_ranked WHERE r = 1)"""


def otsu_sql(src="cells"):
    return OTSU.replace("{src}", src)


CELL_OUT = "frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(v AS INTEGER) AS v"

DOC_SIGNATURES = """tokens AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents),
buckets AS (SELECT doc_id, lang, CAST(('0x' || substr(md5(word), 1, 2)) AS BIGINT) // 4 AS bucket, count(*) AS n
            FROM tokens WHERE trim(word) <> '' GROUP BY ALL),
totals AS (SELECT doc_id, sum(n) AS total FROM buckets GROUP BY 1),
raw_sig AS (SELECT b.doc_id, any_value(lang) AS capture_id, any_value(total) AS total,
              sum(CASE WHEN n * 64 >= total THEN CAST(pow(2, 63 - bucket) AS HUGEINT) ELSE 0 END) AS u
            FROM buckets b JOIN totals t USING (doc_id) GROUP BY b.doc_id),
sigs AS (SELECT capture_id, doc_id AS frame_index, CAST(total AS DOUBLE) AS mean_intensity,
           CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS signature FROM raw_sig)"""
