"""DuckDB twins of the registered queries (tables are pre-registered views).

Each statement rebuilds the log fixture from ``events`` with the same SQL text
the Spark side uses, parses it with the same layout, and computes the
operator's result independently (window functions and GROUP BY instead of the
slice / piece machinery).
"""

from __future__ import annotations

from logsift.plans.queries import (TIME_WINDOW_DEFAULT, CONTAMINATION, COUNT_WINDOW, COUNT_WINDOW_OVERLAP, MAX_LINES, RULE_CUT,
                                   RULE_TEMPLATE, TIME_WINDOW, TIME_WINDOW_OVERLAP, TOP_N, PIECE_LENGTH, SAVED_VOCAB,
                                   LOF_NEIGHBORS, STREAM_GAP_SECONDS, VOCAB_TOPK, WINDOW_VOCAB)
from logsift.sources.fixtures import TEMPLATE_RULE_SQL, oracle_labels_cte, oracle_lines_cte

_PAT = r"^([0-9]{6}) ([0-9]{6}) ([0-9]+) ([A-Za-z0-9_]+) ([^:]+): (.+)"

BASE = f"""WITH {oracle_lines_cte()},
f AS (SELECT line_no, trim(value) AS raw_line FROM lines),
m AS (SELECT line_no, raw_line,
        regexp_extract(raw_line, '{_PAT}', 1) AS d, regexp_extract(raw_line, '{_PAT}', 2) AS t,
        regexp_extract(raw_line, '{_PAT}', 3) AS f3, regexp_extract(raw_line, '{_PAT}', 4) AS level,
        regexp_extract(raw_line, '{_PAT}', 5) AS component, regexp_extract(raw_line, '{_PAT}', 6) AS message
      FROM f WHERE length(raw_line) > 0 AND regexp_matches(raw_line, '{_PAT}')),
parsed AS (SELECT line_no, raw_line, level, component, message,
        try_cast('2008-' || substr(d,1,2) || '-' || substr(d,3,2) || ' ' || substr(t,1,2) || ':'
                 || substr(t,3,2) || ':' || substr(t,5,2) || '.'
                 || lpad(CAST(least(coalesce(try_cast(f3 AS BIGINT), 999), 999) AS VARCHAR), 3, '0')
                 AS TIMESTAMP) AS ts,
        nullif(regexp_extract(message, 'blk_(-?[0-9]+)', 1), '') AS block_id,
        CAST({TEMPLATE_RULE_SQL.format(m='message')} AS BIGINT) AS template_id
      FROM m),
valid AS (SELECT *, epoch_us(ts) AS ts_us FROM parsed WHERE ts IS NOT NULL),
{oracle_labels_cte()},
labels_n AS (SELECT regexp_replace(BlockId, '^blk_', 'block_') AS block_key, max(Label) AS label
             FROM label_rows GROUP BY 1)"""


def _time_windows_sql(size: int, overlap: int) -> str:
    z, s = size * 1_000_000, (size - overlap) * 1_000_000
    return f"""{BASE},
b AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM valid),
r AS (SELECT v.line_no, v.ts_us, v.template_id, b.lo,
        CASE WHEN v.ts_us - b.lo < {z} THEN 0 ELSE (v.ts_us - b.lo - {z}) // {s} + 1 END AS klo,
        least((v.ts_us - b.lo) // {s}, (b.hi - b.lo - 1) // {s}) AS khi
      FROM valid v, b WHERE b.hi > b.lo),
mem AS (SELECT line_no, ts_us, template_id, lo, unnest(generate_series(klo, khi)) AS k FROM r WHERE klo <= khi),
w AS (SELECT k, any_value(lo) AS lo,
        string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY ts_us, line_no) AS s, count(*) AS n
      FROM mem GROUP BY k)
SELECT 'time_' || CAST(row_number() OVER (ORDER BY k) - 1 AS VARCHAR) AS seq_id,
       CAST(row_number() OVER (ORDER BY k) - 1 AS VARCHAR) AS id,
       s AS template_sequence_str, CAST(n AS BIGINT) AS length,
       lo + k * {s} AS start_us, lo + k * {s} + {z} AS end_us, CAST({size} AS BIGINT) AS window_size
FROM w"""


def _windows_mem_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{BASE},
o AS (SELECT line_no, ts_us, template_id, block_id, row_number() OVER (ORDER BY ts_us, line_no) - 1 AS pos,
        count(*) OVER () AS n FROM valid),
r AS (SELECT *, CASE WHEN pos - {size} + 1 <= 0 THEN 0 ELSE (pos - {size} + {step}) // {step} END AS jlo,
        least(pos // {step}, (n - 1) // {step}) AS jhi FROM o),
mem AS (SELECT *, unnest(generate_series(jlo, jhi)) AS j FROM r WHERE jlo <= jhi),
w AS (SELECT j, any_value(n) AS n, count(*) AS log_count,
        arg_min(ts_us, pos) AS s_us, arg_max(ts_us, pos) AS e_us,
        string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY pos) AS template_sequence_str,
        count(DISTINCT template_id) AS unique_templates,
        -avg(CASE WHEN template_id = {RULE_TEMPLATE} THEN 1.0 ELSE 0.0 END) AS rule_score
      FROM mem GROUP BY j HAVING count(*) >= {size // 2})"""


def _count_windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{_windows_mem_sql(size, overlap)}
SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, CAST(j * {step} AS BIGINT) AS start_idx,
       CAST(least(j * {step} + {size}, n) AS BIGINT) AS end_idx, s_us AS start_us, e_us AS end_us,
       round((e_us - s_us) / 1e6, 6) AS time_span, CAST(log_count AS BIGINT) AS log_count,
       template_sequence_str, CAST(unique_templates AS BIGINT) AS unique_templates
FROM w"""


BLOCKS = f"""{BASE},
blocks AS (SELECT 'block_' || block_id AS seq_id, block_id AS id,
        string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY ts_us, line_no) AS template_sequence_str,
        CAST(count(*) AS BIGINT) AS length, min(ts_us) AS start_us, max(ts_us) AS end_us,
        round((max(ts_us) - min(ts_us)) / 1e6, 6) AS time_span
      FROM valid WHERE block_id IS NOT NULL GROUP BY block_id),
training AS (SELECT b.seq_id AS block_id, b.length AS sequence_length, b.template_sequence_str,
        b.start_us, b.end_us, b.time_span,
        CAST(CASE WHEN l.label IS NULL THEN NULL WHEN l.label = 'Normal' THEN 0
                  WHEN l.label = 'Anomaly' THEN 1 ELSE -1 END AS BIGINT) AS anomaly_binary_val,
        l.label AS anomaly_labels,
        CAST(CASE WHEN l.block_key IS NULL THEN -1 END AS BIGINT) AS anomaly_label
      FROM blocks b LEFT JOIN labels_n l ON b.seq_id = l.block_key)"""


def _tw_mem_only(size: int, overlap: int) -> str:
    z, s = size * 1_000_000, (size - overlap) * 1_000_000
    return f"""b AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM valid),
r AS (SELECT v.line_no, CASE WHEN v.ts_us - b.lo < {z} THEN 0 ELSE (v.ts_us - b.lo - {z}) // {s} + 1 END AS klo,
        least((v.ts_us - b.lo) // {s}, (b.hi - b.lo - 1) // {s}) AS khi FROM valid v, b WHERE b.hi > b.lo),
mem AS (SELECT line_no, unnest(generate_series(klo, khi)) AS k FROM r WHERE klo <= khi),
ids AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS wid FROM (SELECT DISTINCT k FROM mem))"""


BLOCK_TERMS = f"""{BLOCKS},
ev AS (SELECT 'block_' || block_id AS seq_id, template_id,
        lead(template_id) OVER (PARTITION BY block_id ORDER BY ts_us, line_no) AS nxt
      FROM valid WHERE block_id IS NOT NULL),
terms AS (SELECT seq_id, CAST(template_id AS VARCHAR) AS term FROM ev
          UNION ALL SELECT seq_id, CAST(template_id AS VARCHAR) || ' ' || CAST(nxt AS VARCHAR) FROM ev
          WHERE nxt IS NOT NULL),
tf AS (SELECT seq_id, term, count(*) AS tf FROM terms GROUP BY seq_id, term),
nd AS (SELECT count(DISTINCT seq_id) AS n FROM ev),
st AS (SELECT term, sum(tf) AS cf, count(*) AS doc_freq FROM tf GROUP BY term)"""


def _tfidf_sql(key: str, k: int) -> str:
    return f"""vocab AS (SELECT term, ln((1 + n) / (1 + doc_freq)) + 1 AS idf
        FROM (SELECT * FROM st ORDER BY cf DESC, term ASC LIMIT {k}) s, nd),
tw AS (SELECT tf.{key}, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term))
SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS tfidf FROM tw"""


WINDOW_TERMS = f"""{_windows_mem_sql(*COUNT_WINDOW)},
kept AS (SELECT mem.j, mem.pos, mem.template_id FROM mem JOIN w USING (j)),
ev AS (SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, template_id,
        lead(template_id) OVER (PARTITION BY j ORDER BY pos) AS nxt FROM kept),
terms AS (SELECT window_id, CAST(template_id AS VARCHAR) AS term FROM ev
          UNION ALL SELECT window_id, CAST(template_id AS VARCHAR) || ' ' || CAST(nxt AS VARCHAR) FROM ev
          WHERE nxt IS NOT NULL),
tf AS (SELECT window_id, term, count(*) AS tf FROM terms GROUP BY window_id, term),
nd AS (SELECT count(*) AS n FROM w),
st AS (SELECT term, sum(tf) AS cf, count(*) AS doc_freq FROM tf GROUP BY term)"""


def _scaled(cols: list[str], key: str, src: str) -> str:
    parts = ", ".join(
        f"round(coalesce((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6)"
        f" AS {c}_scaled" for c in cols)
    return f"SELECT {key}, {parts} FROM {src}"


WINDOWS_TABLE = f"""{_windows_mem_sql(*COUNT_WINDOW)},
wt AS (SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, log_count, (e_us - s_us) / 1e6 AS time_span,
        unique_templates FROM w)"""

SCORED = f"""{BLOCKS},
scored AS (SELECT t.block_id, t.anomaly_binary_val AS label, s.score,
        CAST(s.score > {RULE_CUT} AS INTEGER) AS prediction
      FROM training t JOIN (SELECT 'block_' || block_id AS block_id,
        avg(CASE WHEN template_id = {RULE_TEMPLATE} THEN 1.0 ELSE 0.0 END) AS score
        FROM valid WHERE block_id IS NOT NULL GROUP BY block_id) s USING (block_id)
      WHERE t.anomaly_binary_val IN (0, 1)),
cells AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
        count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
        count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored)"""


def _d(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


_P1, _R1 = _d("tp", "tp + fp"), _d("tp", "tp + fn")
_P0, _R0 = _d("tn", "tn + fn"), _d("tn", "tn + fp")

CLASS_REPORT = f"""{SCORED},
pr AS (SELECT {_P0} AS p0, {_R0} AS r0, {_P1} AS p1, {_R1} AS r1, tn + fp AS s0, tp + fn AS s1 FROM cells),
fr AS (SELECT *, {_d("2 * p0 * r0", "p0 + r0")} AS f0, {_d("2 * p1 * r1", "p1 + r1")} AS f1 FROM pr)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM fr
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM fr
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM fr
UNION ALL SELECT 'weighted avg', round({_d("p0 * s0 + p1 * s1", "s0 + s1")}, 6),
    round({_d("r0 * s0 + r1 * s1", "s0 + s1")}, 6), round({_d("f0 * s0 + f1 * s1", "s0 + s1")}, 6), s0 + s1 FROM fr"""

# sp(k, y, u) -> parted(k, y, split): one total per part, shared by largest remainder
_SPLIT = """cn AS (SELECT y, count(*) AS nc FROM sp GROUP BY y),
tt AS (SELECT CAST((2 * sum(nc) + 9) // 10 AS BIGINT) AS t, sum(nc) AS n FROM cn),
t1 AS (SELECT y, nc, t * nc // n AS base, t * nc % n AS rem, t FROM cn, tt),
t2 AS (SELECT y, nc, base + CAST(row_number() OVER (ORDER BY rem DESC, nc DESC, y) <= t - sum(base) OVER () AS BIGINT) AS test FROM t1),
vv AS (SELECT CAST((sum(nc - test) + 9) // 10 AS BIGINT) AS v, sum(nc - test) AS n FROM t2),
v1 AS (SELECT y, nc, test, v * (nc - test) // n AS base, v * (nc - test) % n AS rem, v FROM t2, vv),
v2 AS (SELECT y, test, base + CAST(row_number() OVER (ORDER BY rem DESC, nc - test DESC, y) <= v - sum(base) OVER () AS BIGINT) AS val FROM v1),
parted AS (SELECT k, y, CASE WHEN rk < test THEN 'test' WHEN rk < test + val THEN 'validation' ELSE 'train' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u, k) - 1 AS rk FROM sp) r JOIN v2 USING (y))"""


def _text_sql(where: str = "", blocks: str = "block_id", ts: str = "ts", message: str = "message", raw: str = "raw_line", source: str = "parsed") -> str:
    return f"""{BASE}
SELECT line_no, epoch_us({ts}) AS ts_us, level, component, {message} AS message, {blocks} AS block_id, {raw} AS raw_line
FROM {source} {where}"""


_LOF_WINDOWS = f"""{WINDOWS_TABLE},
sc AS (SELECT window_id,
        coalesce((CAST(log_count AS DOUBLE) - avg(log_count) OVER ()) / nullif(stddev_pop(log_count) OVER (), 0), 0) AS x0,
        coalesce((time_span - avg(time_span) OVER ()) / nullif(stddev_pop(time_span) OVER (), 0), 0) AS x1,
        coalesce((CAST(unique_templates AS DOUBLE) - avg(unique_templates) OVER ())
                 / nullif(stddev_pop(unique_templates) OVER (), 0), 0) AS x2 FROM wt),
kk AS (SELECT least({LOF_NEIGHBORS}, count(*) - 1) AS k FROM sc),
pairs AS (SELECT a.window_id AS p, b.window_id AS o,
        sqrt((a.x0 - b.x0) ^ 2 + (a.x1 - b.x1) ^ 2 + (a.x2 - b.x2) ^ 2) AS d
      FROM sc a JOIN sc b ON a.window_id <> b.window_id),
nb AS (SELECT p, o, d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rn FROM pairs), kk
      WHERE rn <= kk.k),
kd AS (SELECT p, max(d) AS kd FROM nb GROUP BY p),
lrd AS (SELECT nb.p, 1.0 / (avg(greatest(kd.kd, nb.d)) + 1e-10) AS lrd FROM nb JOIN kd ON nb.o = kd.p GROUP BY nb.p),
lf AS (SELECT nb.p, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nb JOIN lrd l2 ON nb.o = l2.p
      JOIN lrd l1 ON nb.p = l1.p GROUP BY nb.p)
SELECT p AS window_id, round(-lof, 6) AS anomaly_score FROM lf"""

NEWTON_STEPS = 12


def _newton_sql() -> str:
    """Blocks' scaled metadata, split and weight, and the minimum (b0, b1, b2) of the weighted logistic loss + |b|^2 / 2n by Newton steps."""
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS c, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"]
    for k in range(1, NEWTON_STEPS + 1):
        steps.append(f"""s{k} AS (SELECT any_value(c) AS c, any_value(u) AS u, any_value(v) AS v, any_value(1.0 / n) AS l,
        sum(w * (p - y)) / sum(w) AS g0, sum(w * (p - y) * x0) / sum(w) + any_value(u / n) AS g1, sum(w * (p - y) * x1) / sum(w) + any_value(v / n) AS g2,
        sum(w * p * (1 - p)) / sum(w) AS h00, sum(w * p * (1 - p) * x0) / sum(w) AS h01, sum(w * p * (1 - p) * x1) / sum(w) AS h02,
        sum(w * p * (1 - p) * x0 * x0) / sum(w) + any_value(1.0 / n) AS h11, sum(w * p * (1 - p) * x0 * x1) / sum(w) AS h12,
        sum(w * p * (1 - p) * x1 * x1) / sum(w) + any_value(1.0 / n) AS h22
      FROM (SELECT *, 1 / (1 + exp(-(c + u * x0 + v * x1))) AS p FROM tr, b{k - 1})),
b{k} AS (SELECT c - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS c,
        u - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
        v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS v
      FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{k}))""")
    return f"""{BLOCKS},
sp AS (SELECT block_id AS k, anomaly_binary_val AS y, ('0x' || substr(md5('42|' || block_id), 1, 13))::BIGINT AS u
      FROM training WHERE anomaly_binary_val IN (0, 1)),
{_SPLIT},
lx AS (SELECT block_id, anomaly_binary_val AS y, parted.split,
        coalesce((CAST(sequence_length AS DOUBLE) - avg(sequence_length) OVER ()) / nullif(stddev_pop(sequence_length) OVER (), 0), 0) AS x0,
        coalesce(((end_us - start_us) / 1e6 - avg((end_us - start_us) / 1e6) OVER ()) / nullif(stddev_pop((end_us - start_us) / 1e6) OVER (), 0), 0) AS x1
      FROM training JOIN parted ON parted.k = block_id),
tr AS (SELECT x0, x1, y, count(*) OVER () AS n, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM lx WHERE split = 'train'),
{", ".join(steps)}"""


def _forest_sql(key: str, seed: int = 42, trees: int = 100, psi: int = 256) -> str:
    """Isolation forest by unrolled levels, after ks(key) and fv(key, feature, value), zeros left out or not."""
    prime, grid = (1 << 31) - 1, 1 << 30
    number = lambda text: f"('0x' || substr(md5({text}), 1, 13))::BIGINT"
    out = [f"""par AS (SELECT n, p, CAST(ceil(log2(greatest(p, 2))) AS INTEGER) AS deep FROM (SELECT count(*) AS n, least({psi}, count(*)) AS p FROM ks)),
tr AS (SELECT CAST(t AS INTEGER) AS t, 1 + {number(f"'{seed}|tree|' || t")} % {prime - 1} AS m, {number(f"'{seed}|shift|' || t")} % {prime} AS c FROM range({trees}) r(t)),
kd AS (SELECT key, ('0x' || substr(d, 1, 8))::BIGINT % {prime} AS a, substr(d, 9) AS b FROM (SELECT key, md5('{seed}|' || CAST(key AS VARCHAR)) AS d FROM ks)),
r0 AS MATERIALIZED (SELECT t, 0 AS node, key FROM (SELECT t, key, row_number() OVER (PARTITION BY t ORDER BY (a * m + c) % {prime}, b, key) AS r FROM kd, tr), par WHERE r <= p),
q0 AS MATERIALIZED (SELECT t, 0 AS node, key FROM ks, tr)"""]
    levels = (psi - 1).bit_length()
    for d in range(levels + 1):
        out.append(f"""z{d} AS MATERIALIZED (SELECT t, node, count(*) AS m FROM r{d} GROUP BY t, node),
g{d} AS MATERIALIZED (SELECT t, node, feature, least(lo, CASE WHEN n < m THEN 0 END) AS lo, greatest(hi, CASE WHEN n < m THEN 0 END) AS hi
      FROM (SELECT t, node, feature, count(*) AS n, min(g) AS lo, max(g) AS hi
            FROM (SELECT t, node, feature, CAST(floor(value * {grid} + 0.5) AS BIGINT) AS g FROM r{d} JOIN fv USING (key), par WHERE {d} < deep) GROUP BY ALL) s
      JOIN z{d} USING (t, node)),
s{d} AS MATERIALIZED (SELECT t, node, feature, (lo + 1 + {number(f"'{seed}|' || t || '|' || node || '|cut'")} % (hi - lo) - 0.5::DOUBLE) / {grid} AS thr
      FROM (SELECT * FROM g{d} WHERE hi > lo QUALIFY row_number() OVER (PARTITION BY t, node ORDER BY md5('{seed}|' || t || '|' || node || '|' || feature)) = 1)),
l{d} AS (SELECT q{d}.key, {d} + CASE WHEN m > 2 THEN floor((2 * (ln(m - 1) + 0.5772156649) - 2 * (m - 1) / m) * 4294967296 + 0.5) / 4294967296
                                    WHEN m = 2 THEN 1 ELSE 0 END AS h
      FROM q{d} JOIN z{d} USING (t, node) ANTI JOIN s{d} USING (t, node))""")
        if d < levels:
            for x in "rq":
                out.append(f"""{x}{d + 1} AS MATERIALIZED (SELECT {x}.t, 2 * {x}.node + CASE WHEN coalesce(value, 0) < thr THEN 1 ELSE 2 END AS node, {x}.key
      FROM {x}{d} {x} JOIN s{d} s ON {x}.t = s.t AND {x}.node = s.node LEFT JOIN fv ON fv.key = {x}.key AND fv.feature = s.feature)""")
    leaves = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(levels + 1))
    out.append(f"""sc AS MATERIALIZED (SELECT key, -pow(2, -(sum(h) / {trees}) / any_value(CASE WHEN p > 2 THEN floor((2 * (ln(p - 1) + 0.5772156649) - 2 * (p - 1) / p) * 4294967296 + 0.5) / 4294967296
                                                             ELSE 1 END)) AS score FROM ({leaves}) x, par GROUP BY key),
cut AS (SELECT quantile_cont(score, {CONTAMINATION}) AS cut FROM sc)
SELECT key AS {key}, round(score, 6) AS anomaly_score, CAST(score < cut AS BIGINT) AS is_anomaly FROM sc, cut""")
    return ",\n".join(out)


_WINDOW_FEATURES = f"""{WINDOW_TERMS},
vocab AS (SELECT term, ln((1 + n) / (1 + doc_freq)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS feature
      FROM (SELECT * FROM st ORDER BY cf DESC, term ASC LIMIT 1000) s, nd),
tw AS (SELECT tf.window_id, v.feature, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term)),
wt AS (SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, log_count, (e_us - s_us) / 1e6 AS time_span, unique_templates FROM w),
ks AS (SELECT window_id AS key FROM wt),
fv AS MATERIALIZED (SELECT window_id AS key, feature, w / sqrt(sum(w * w) OVER (PARTITION BY window_id)) AS value FROM tw
      {" ".join(f"""UNION ALL SELECT window_id, (SELECT count(*) FROM vocab) + {i},
        coalesce((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) FROM wt"""
                for i, c in enumerate(("log_count", "time_span", "unique_templates")))})"""


ORACLE = {
    "isolation_forest": f"""{_WINDOW_FEATURES},
{_forest_sql("window_id")}""",
    "isolation_forest_embeddings": f"""WITH ks AS (SELECT vec_id AS key FROM embeddings),
fv AS MATERIALIZED (SELECT vec_id AS key, CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings),
{_forest_sql("vec_id")}""",
    "logreg_coefficients": f"""{_newton_sql()}
SELECT unnest(['intercept', 'sequence_length', 'time_span']) AS name, round(unnest([c, u, v]), 4) AS value FROM b{NEWTON_STEPS}""",
    "predictions": f"""{_newton_sql()}
SELECT block_id, split, CAST(y AS BIGINT) AS y_true, CAST(CASE WHEN c + u * x0 + v * x1 > 0 THEN 1 ELSE 0 END AS BIGINT) AS y_pred,
       round(1 / (1 + exp(-(c + u * x0 + v * x1))), 4) AS y_proba FROM lx, b{NEWTON_STEPS}""",
    "training_stats": f"""{BLOCK_TERMS},
sp AS (SELECT block_id AS k, anomaly_binary_val AS y, ('0x' || substr(md5('42|' || block_id), 1, 13))::BIGINT AS u
      FROM training WHERE anomaly_binary_val IN (0, 1)),
{_SPLIT},
vt AS (SELECT least(1000, count(DISTINCT term)) AS terms FROM tf JOIN parted ON seq_id = k)
SELECT (SELECT count(*) FROM training) AS total_samples, (SELECT count(*) FROM training) - count(*) AS unlabelled_dropped,
       count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'validation') AS val_samples, count(*) FILTER (split = 'test') AS test_samples,
       CAST(any_value(terms) + 2 AS BIGINT) AS feature_count, CAST(any_value(terms) AS BIGINT) AS tfidf_features, round(avg(y), 6) AS anomaly_rate
FROM parted, vt""",
    "tfidf_unbounded": f"""{BLOCK_TERMS},
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature_idx, ln((1 + n) / (1 + doc_freq)) + 1 AS idf FROM st, nd),
tw AS (SELECT tf.seq_id, tf.term, v.feature_idx, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term))
SELECT seq_id, term, CAST(feature_idx AS BIGINT) AS feature_idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq_id)), 6) AS tfidf FROM tw""",
    "saved_features": f"""{BLOCK_TERMS},
top AS (SELECT term, doc_freq FROM st ORDER BY cf DESC, term LIMIT {SAVED_VOCAB}),
bs AS (SELECT length, (end_us - start_us) / 1e6 AS span FROM blocks)
SELECT row_number() OVER (ORDER BY term) - 1 AS position, 'tfidf_' || term AS name, CAST(doc_freq AS BIGINT) AS doc_freq,
       round(ln((1 + n) / (1 + doc_freq)) + 1, 6) AS weight, CAST(NULL AS DOUBLE) AS mean, CAST(n AS BIGINT) AS blocks FROM top, nd
UNION ALL SELECT (SELECT count(*) FROM top), 'sequence_length_scaled', NULL, round(stddev_pop(length), 6), round(avg(length), 6), CAST(any_value(n) AS BIGINT) FROM bs, nd
UNION ALL SELECT (SELECT count(*) FROM top) + 1, 'time_span_scaled', NULL, round(stddev_pop(span), 6), round(avg(span), 6), CAST(any_value(n) AS BIGINT) FROM bs, nd""",
    "feature_vectors": f"""{BLOCK_TERMS},
{_tfidf_sql("seq_id", SAVED_VOCAB).rsplit("SELECT", 1)[0].rstrip().removesuffix(",")},
bs AS (SELECT seq_id, (length - avg(length) OVER ()) / stddev_pop(length) OVER () AS a,
        ((end_us - start_us) / 1e6 - avg((end_us - start_us) / 1e6) OVER ()) / stddev_pop((end_us - start_us) / 1e6) OVER () AS b FROM blocks)
SELECT seq_id, 'tfidf_' || term AS name, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq_id)), 6) AS value FROM tw
UNION ALL SELECT seq_id, 'sequence_length_scaled', round(a, 6) FROM bs
UNION ALL SELECT seq_id, 'time_span_scaled', round(b, 6) FROM bs""",
    "block_sequences_sliced": f"""{BLOCKS}
SELECT seq_id, id, template_sequence_str, length, start_us, end_us, time_span FROM blocks""",
    "count_windows_sliced": _count_windows_sql(*COUNT_WINDOW),
    "ngram_counts_sliced": f"""{BLOCK_TERMS}
SELECT seq_id, term, tf FROM tf""",
    "text_parse": _text_sql(),
    "text_max_lines": _text_sql(f"WHERE line_no < {MAX_LINES}"),
    "text_yymmdd": _text_sql(ts="try_cast('20' || substr(d,1,2) || '-' || substr(d,3,2) || '-' || substr(d,5,2) || ' ' || substr(t,1,2)"
                                " || ':' || substr(t,3,2) || ':' || substr(t,5,2) AS TIMESTAMP)", source="m_parsed").replace(
        "valid AS (", "m_parsed AS (SELECT p.*, m.d, m.t FROM parsed p JOIN m USING (line_no)),\nvalid AS (", 1),
    "text_all_blocks": f"""{BASE},
x AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN message || ' blk_' || line_no ELSE message END AS msg,
        CASE WHEN line_no % 2 = 0 THEN raw_line || ' blk_' || line_no ELSE raw_line END AS raw FROM parsed),
y AS (SELECT *, regexp_extract_all(msg, 'blk_(-?[0-9]+)', 1) AS ids FROM x)
SELECT line_no, epoch_us(ts) AS ts_us, level, component, msg AS message,
       unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS block_id, raw AS raw_line FROM y""",
    "labels_last_wins": f"""{BASE}
SELECT regexp_replace(BlockId, '^blk_', 'block_') AS block_key,
       CASE WHEN length(BlockId) % 3 = 0 THEN 'Anomaly' ELSE Label END AS label FROM label_rows""",
    "window_dataset_roundtrip": f"""{_windows_mem_sql(*COUNT_WINDOW)}
SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, CAST(log_count AS BIGINT) AS log_count,
       round((e_us - s_us) / 1e6, 6) AS time_span, template_sequence_str, CAST(unique_templates AS BIGINT) AS unique_templates,
       list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(template_sequence_str, ','), lambda v: CAST(v AS BIGINT))),
                   lambda a, v: a * 31 % 1000003 + v) AS ids_hash,
       CAST(len(string_split(template_sequence_str, ',')) AS BIGINT) AS ids
FROM w""",
    "parse_logs": f"""{BASE}
SELECT line_no, epoch_us(ts) AS ts_us, level, component, message, block_id, raw_line, template_id FROM parsed""",
    "parse_stats": f"""{BASE}
SELECT (SELECT count(*) FROM lines) AS total_lines, count(*) AS parsed_lines, count(ts) AS valid_timestamps,
       count(block_id) AS with_block_id, count(DISTINCT template_id) AS unique_templates FROM parsed""",
    "parse_levels": f"""{BASE}
SELECT level, component, count(*) AS n FROM parsed GROUP BY level, component""",
    "block_sequences": f"""{BLOCKS}
SELECT seq_id, id, template_sequence_str, length, start_us, end_us, time_span FROM blocks""",
    "time_windows": _time_windows_sql(*TIME_WINDOW),
    "time_windows_overlap": _time_windows_sql(*TIME_WINDOW_OVERLAP),
    "time_windows_default": _time_windows_sql(*TIME_WINDOW_DEFAULT),
    "count_windows": _count_windows_sql(*COUNT_WINDOW),
    "count_windows_overlap": _count_windows_sql(*COUNT_WINDOW_OVERLAP),
    "window_means": f"""{_windows_mem_sql(*COUNT_WINDOW)}
SELECT round(avg(log_count), 6) AS avg_log_count, round(avg((e_us - s_us) / 1e6), 6) AS avg_time_span FROM w""",
    "sequence_logs": f"""{BASE},
{_tw_mem_only(*TIME_WINDOW)}
SELECT line_no, 'block_' || block_id AS sequence_id, 'block' AS sequence_type FROM valid WHERE block_id IS NOT NULL
UNION ALL
SELECT mem.line_no, 'time_' || CAST(ids.wid AS VARCHAR) AS sequence_id, 'time_window' AS sequence_type
FROM mem JOIN ids USING (k)""",
    "sequence_stats": f"""{BASE},
{_tw_mem_only(*TIME_WINDOW)}
SELECT 'block' AS type, count(DISTINCT block_id) AS sequences, count(*) AS logs FROM valid WHERE block_id IS NOT NULL
UNION ALL
SELECT 'time_window' AS type, count(DISTINCT k) AS sequences, count(*) AS logs FROM mem""",
    "label_lookup": f"""{BASE}
SELECT block_key, label FROM labels_n""",
    "block_training": f"""{BLOCKS}
SELECT * FROM training""",
    "label_distribution": f"""{BLOCKS}
SELECT anomaly_binary_val, count(*) AS n FROM training GROUP BY anomaly_binary_val""",
    "column_summary": f"""{BLOCKS}
SELECT 'time_span' AS "column", count(time_span) AS count, round(avg(time_span), 6) AS mean,
       round(stddev_samp(time_span), 6) AS std, round(min(time_span), 6) AS min,
       round(quantile_cont(time_span, 0.25), 6) AS p25, round(quantile_cont(time_span, 0.5), 6) AS p50,
       round(quantile_cont(time_span, 0.75), 6) AS p75, round(max(time_span), 6) AS max FROM training""",
    "ngram_counts": f"""{BLOCK_TERMS}
SELECT seq_id, term, tf FROM tf""",
    "vocab_topk": f"""{BLOCK_TERMS}
SELECT term, CAST(cf AS BIGINT) AS cf, doc_freq, round(ln((1 + n) / (1 + doc_freq)) + 1, 6) AS idf
FROM (SELECT * FROM st ORDER BY cf DESC, term ASC LIMIT {VOCAB_TOPK}) s, nd""",
    "tfidf": f"""{BLOCK_TERMS},
{_tfidf_sql("seq_id", 1000)}""",
    "tfidf_windows": f"""{WINDOW_TERMS},
{_tfidf_sql("window_id", WINDOW_VOCAB)}""",
    "scaled_metadata": f"""{BLOCKS}
{_scaled(["length", "time_span"], "seq_id AS block_id", "blocks").replace("length_scaled", "sequence_length_scaled")}""",
    "scaled_window_metadata": f"""{WINDOWS_TABLE}
{_scaled(["log_count", "time_span", "unique_templates"], "window_id", "wt")}""",
    "stratified_split": f"""{BLOCKS},
sp AS (SELECT block_id AS k, anomaly_binary_val AS y, ('0x' || substr(md5('42|' || block_id), 1, 13))::BIGINT AS u
      FROM training WHERE anomaly_binary_val IN (0, 1)),
{_SPLIT}
SELECT k AS block_id, y AS anomaly_binary_val, split FROM parted
UNION ALL SELECT block_id, anomaly_binary_val, NULL FROM training
WHERE anomaly_binary_val IS NULL OR anomaly_binary_val NOT IN (0, 1)""",
    "stratified_split_rare": f"""WITH er AS (SELECT event_id, row_number() OVER (ORDER BY event_id) <= 2 AS rare
      FROM events WHERE event_type = 'error'),
sp AS (SELECT event_id AS k, CAST(rare AS BIGINT) AS y, ('0x' || substr(md5('42|' || event_id), 1, 13))::BIGINT AS u FROM er),
{_SPLIT}
SELECT k AS event_id, y AS label, split FROM parted""",
    "confusion": f"""{SCORED}
SELECT CAST(0 AS BIGINT) AS label, CAST(0 AS BIGINT) AS prediction, tn AS n FROM cells
UNION ALL SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""",
    "class_report": CLASS_REPORT,
    "roc_auc": f"""{SCORED},
s AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM s)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c""",
    "contamination_threshold": f"""{_windows_mem_sql(*COUNT_WINDOW)}
SELECT round(quantile_cont(rule_score, {CONTAMINATION}), 6) AS threshold FROM w""",
    "top_windows": f"""{_windows_mem_sql(*COUNT_WINDOW)}
SELECT window_id, round(rule_score, 6) AS anomaly_score, CAST(log_count AS BIGINT) AS log_count
FROM (SELECT 'window_' || CAST(j AS VARCHAR) AS window_id, rule_score, log_count FROM w)
ORDER BY rule_score, window_id LIMIT {TOP_N}""",
    "evaluate_windows": f"""{_windows_mem_sql(*COUNT_WINDOW)},
thr AS (SELECT quantile_cont(rule_score, {CONTAMINATION}) AS t FROM w),
pred AS (SELECT j, CASE WHEN rule_score >= t THEN 0 ELSE 1 END AS is_anomaly FROM w, thr),
bad AS (SELECT block_key FROM labels_n WHERE label = 'Anomaly'),
hits AS (SELECT DISTINCT j FROM mem JOIN bad ON 'block_' || mem.block_id = bad.block_key),
ev AS (SELECT p.is_anomaly, CASE WHEN h.j IS NULL THEN 0 ELSE 1 END AS truth FROM pred p LEFT JOIN hits h USING (j)),
c AS (SELECT count(*) FILTER (WHERE truth = 1 AND is_anomaly = 1) AS tp,
        count(*) FILTER (WHERE truth = 0 AND is_anomaly = 1) AS fp,
        count(*) FILTER (WHERE truth = 1 AND is_anomaly = 0) AS fn,
        count(*) FILTER (WHERE truth = 0 AND is_anomaly = 0) AS tn FROM ev),
pr AS (SELECT *, {_d("tp", "tp + fp")} AS p, {_d("tp", "tp + fn")} AS r FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({_d("2 * p * r", "p + r")}, 6) AS f1_score,
       tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
       tp + fp + tn + fn AS total, tp + fn AS actual_positives, tp + fp AS predicted_positives FROM pr""",
    "token_patterns": f"""{BASE},
tk AS (SELECT line_no, list_transform(string_split_regex(trim(message), '\\s+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM parsed)
SELECT array_to_string(toks, ' ') AS pattern, CAST(any_value(len(toks)) AS BIGINT) AS token_count,
       any_value(array_to_string(list_slice(toks, 1, 2), ' ')) AS leaf_prefix,
       CAST(count(*) AS BIGINT) AS lines, min(line_no) AS first_line
FROM tk GROUP BY array_to_string(toks, ' ')""",
    "templates": f"""{BASE},
tk AS (SELECT line_no, list_transform(string_split_regex(trim(message), '\\s+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM parsed),
lf AS (SELECT line_no, toks, len(toks) || '|' || array_to_string(list_slice(toks, 1, 2), '|') AS leaf FROM tk),
ex AS (SELECT line_no, leaf, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM lf),
ln AS (SELECT leaf, count(*) AS n FROM lf GROUP BY leaf),
cn AS (SELECT leaf, pos, token, count(*) AS m FROM ex GROUP BY ALL),
tx AS (SELECT ex.line_no, ex.leaf, string_agg(CASE WHEN cn.m >= 0.4 * ln.n THEN ex.token ELSE '<*>' END, ' ' ORDER BY ex.pos) AS template_str
      FROM ex JOIN cn USING (leaf, pos, token) JOIN ln USING (leaf) GROUP BY ex.line_no, ex.leaf),
g AS (SELECT leaf, template_str, count(*) AS lines, min(line_no) AS first_line FROM tx GROUP BY leaf, template_str)
SELECT row_number() OVER (ORDER BY first_line) AS template_id, template_str, CAST(lines AS BIGINT) AS lines, first_line FROM g""",
    "stream_templates": f"""{BASE},
tk AS (SELECT ('0x' || substr(md5(raw_line), 1, 15))::BIGINT AS k, list_transform(string_split_regex(trim(message), '\\s+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM parsed)
SELECT array_to_string(toks, ' ') AS template_str, count(*) AS lines, min(k) AS first_key, CAST(1 AS BIGINT) AS ids FROM tk GROUP BY 1""",
    "stream_time_windows": f"""{BASE},
sw AS (SELECT (ts_us // 3600000000) * 3600000000 AS start_us,
        string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY ts_us, ('0x' || substr(md5(raw_line), 1, 15))::BIGINT) AS template_sequence_str,
        CAST(count(*) AS BIGINT) AS length FROM valid GROUP BY 1)
SELECT start_us, start_us + 3600000000 AS end_us, template_sequence_str, length FROM sw""",
    "block_sequences_pieces": f"""{BLOCKS},
ps AS (SELECT 'block_' || block_id AS seq_id, (row_number() OVER (PARTITION BY block_id ORDER BY ts_us, line_no) - 1) AS pos, template_id
      FROM valid WHERE block_id IS NOT NULL),
pc AS (SELECT seq_id, pos // {PIECE_LENGTH} AS piece, string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM ps GROUP BY ALL)
SELECT b.seq_id, b.id, b.length, b.start_us, b.end_us, b.time_span, CAST(pc.piece AS BIGINT) AS piece,
       CAST(pc.piece * {PIECE_LENGTH} AS BIGINT) AS first_position, pc.ids FROM blocks b JOIN pc USING (seq_id)""",
    "block_training_pieces": f"""{BLOCK_TERMS},
g AS (SELECT seq_id, CAST(sum(tf) AS BIGINT) AS grams, count(*) AS terms FROM tf GROUP BY seq_id)
SELECT t.block_id, t.sequence_length, t.time_span, t.anomaly_binary_val, t.anomaly_labels, t.anomaly_label, g.grams, g.terms
FROM training t JOIN g ON t.block_id = g.seq_id""",
    "stream_scores": f"""{BASE},
{_tw_mem_only(*TIME_WINDOW)},
train AS (SELECT CAST(count(*) AS DOUBLE) AS x, CAST(count(DISTINCT template_id) AS DOUBLE) AS y FROM mem JOIN valid USING (line_no) GROUP BY k),
mo AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS va, covar_pop(x, y) AS vb, var_pop(y) AS vc FROM train),
th AS (SELECT quantile_cont(-((x - mx) ** 2 * vc - 2 * (x - mx) * (y - my) * vb + (y - my) ** 2 * va) / (va * vc - vb * vb), {CONTAMINATION}) AS t FROM train, mo),
sw AS (SELECT (ts_us // 3600000000) * 3600000000 AS start_us, count(*) AS log_count, count(DISTINCT template_id) AS u FROM valid GROUP BY 1),
sc AS (SELECT start_us, log_count, -((log_count - mx) ** 2 * vc - 2 * (log_count - mx) * (u - my) * vb + (u - my) ** 2 * va) / (va * vc - vb * vb) AS s FROM sw, mo)
SELECT start_us, CAST(log_count AS BIGINT) AS log_count, round(s, 6) AS anomaly_score, CAST(CASE WHEN s < t THEN 1 ELSE 0 END AS BIGINT) AS is_anomaly FROM sc, th""",
    "stream_block_sessions": f"""{BASE},
k AS (SELECT *, ('0x' || substr(md5(raw_line), 1, 15))::BIGINT AS tie FROM valid WHERE block_id IS NOT NULL),
bk AS (SELECT block_id, ts_us, tie, template_id,
        CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY block_id ORDER BY ts_us, tie)
                  >= {STREAM_GAP_SECONDS * 1_000_000} THEN 1 ELSE 0 END AS brk FROM k),
ss AS (SELECT *, sum(brk) OVER (PARTITION BY block_id ORDER BY ts_us, tie ROWS UNBOUNDED PRECEDING) AS sid FROM bk),
g AS (SELECT block_id, sid, min(ts_us) AS start_us, max(ts_us) AS end_us,
        string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY ts_us, tie) AS template_sequence_str,
        CAST(count(*) AS BIGINT) AS length FROM ss GROUP BY block_id, sid)
SELECT 'block_' || block_id AS seq_id, start_us, end_us, template_sequence_str, length,
       round((end_us - start_us) / 1e6, 6) AS time_span FROM g""",
    "mahalanobis_once": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM e)
SELECT vec_id, round(-((x - mx) ** 2 * c - 2 * (x - mx) * (y - my) * b + (y - my) ** 2 * a) / (a * c - b * b), 6) AS anomaly_score FROM e, m""",
    "lof": _LOF_WINDOWS,
    "lof_leaves": _LOF_WINDOWS,
    "sequence_examples": f"""{BLOCKS},
{_tw_mem_only(*TIME_WINDOW)},
allseq AS (SELECT seq_id, 'block' AS type, length FROM blocks
           UNION ALL SELECT 'time_' || CAST(ids.wid AS VARCHAR), 'time_window', CAST(count(*) AS BIGINT)
           FROM mem JOIN ids USING (k) GROUP BY ids.wid)
SELECT seq_id, type, length FROM allseq ORDER BY seq_id LIMIT 5""",
    "score_range": f"""{_windows_mem_sql(*COUNT_WINDOW)}
SELECT round(min(rule_score), 6) AS min_score, round(max(rule_score), 6) AS max_score FROM w""",
    "label_csv": f"""{BASE}
SELECT block_key, label FROM labels_n""",
    "block_dataset_roundtrip": f"""{BLOCKS}
SELECT * FROM training""",
    "lof_embeddings": f"""WITH em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kk AS (SELECT least({LOF_NEIGHBORS}, count(*) - 1) AS k FROM em),
pairs AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.v, b.v) AS d
      FROM em a JOIN em b ON a.vec_id <> b.vec_id),
nb AS (SELECT p, o, d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rn FROM pairs), kk
      WHERE rn <= kk.k),
kd AS (SELECT p, max(d) AS kd FROM nb GROUP BY p),
lrd AS (SELECT nb.p, 1.0 / (avg(greatest(kd.kd, nb.d)) + 1e-10) AS lrd FROM nb JOIN kd ON nb.o = kd.p GROUP BY nb.p),
lf AS (SELECT nb.p, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nb JOIN lrd l2 ON nb.o = l2.p
      JOIN lrd l1 ON nb.p = l1.p GROUP BY nb.p)
SELECT p AS vec_id, round(-lof, 6) AS anomaly_score FROM lf""",
    "lof_projected": f"""WITH em AS (SELECT vec_id, [sum(x) FILTER (i % 3 = 1), sum(x) FILTER (i % 3 = 2), sum(x) FILTER (i % 3 = 0)] AS v
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id),
kk AS (SELECT least({LOF_NEIGHBORS}, count(*) - 1) AS k FROM em),
pairs AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.v, b.v) AS d
      FROM em a JOIN em b ON a.vec_id <> b.vec_id),
nb AS (SELECT p, o, d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rn FROM pairs), kk
      WHERE rn <= kk.k),
kd AS (SELECT p, max(d) AS kd FROM nb GROUP BY p),
lrd AS (SELECT nb.p, 1.0 / (avg(greatest(kd.kd, nb.d)) + 1e-10) AS lrd FROM nb JOIN kd ON nb.o = kd.p GROUP BY nb.p),
lf AS (SELECT nb.p, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nb JOIN lrd l2 ON nb.o = l2.p
      JOIN lrd l1 ON nb.p = l1.p GROUP BY nb.p)
SELECT p AS vec_id, round(-lof, 6) AS anomaly_score FROM lf""",
}
