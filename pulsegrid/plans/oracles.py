"""SQL over the given tables that gives the rows of the queries of the registry."""

from __future__ import annotations

import re

from ..functions import filters

TRACE = """trace AS (
  SELECT l_suppkey AS face_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
         l_quantity AS r, round(l_extendedprice) AS g, round(l_tax * 100) + 1 AS b
  FROM lineitem)"""
WINDOWS = TRACE + """, counted AS (SELECT *, count(*) OVER (PARTITION BY face_id) AS n_all FROM trace),
w AS (SELECT face_id, pos, r, g, b, pos // 180 AS win_id, pos % 180 AS at FROM counted WHERE pos < (n_all // 180) * 180)"""
SAMPLES = """s AS (
  SELECT user_id AS face_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ts, event_id, round(value * 100) AS v
  FROM events)"""
SHORT = SAMPLES + """, sc AS (SELECT *, count(*) OVER (PARTITION BY face_id) AS n_all FROM s),
w AS (SELECT face_id, v, pos // 24 AS win_id, pos % 24 AS at FROM sc WHERE pos < (n_all // 24) * 24)"""
BOXES = """b AS (
  SELECT p_partkey // 25 AS frame_idx, p_partkey % 25 AS det, CAST((p_partkey * 37) % 500 AS INTEGER) AS x1, CAST((p_partkey * 53) % 300 AS INTEGER) AS y1,
         CAST((p_partkey * 37) % 500 + p_size * 4 + 10 AS INTEGER) AS x2, CAST((p_partkey * 53) % 300 + (p_partkey % 50) * 3 + 10 AS INTEGER) AS y2,
         round(((p_partkey * 7919) % 1000) / 1000.0, 3) AS score
  FROM part)"""
GRID = " UNION ALL ".join(
    f"SELECT {base} + i AS anchor_id, (i // 2) % {640 // s} * {s} / 640.0::DOUBLE AS cx, (i // 2) // {640 // s} * {s} / 640.0::DOUBLE AS cy, {s} / 640.0::DOUBLE AS sx, {s} / 640.0::DOUBLE AS sy FROM range({(640 // s) ** 2 * 2}) t(i)"
    for s, base in ((8, 0), (16, 12800), (32, 16000))
)
PRIORS = " UNION ALL ".join(
    f"SELECT {base} + i AS anchor_id, ((i // 2) % {1280 // s} + 0.5::DOUBLE) * {s} / 1280 AS cx, ((i // 2) // {1280 // s} + 0.5::DOUBLE) * {s} / 736 AS cy, (CASE WHEN i % 2 = 0 THEN {a} ELSE {b} END) / 1280.0::DOUBLE AS sx, (CASE WHEN i % 2 = 0 THEN {a} ELSE {b} END) / 736.0::DOUBLE AS sy FROM range({(1280 // s) * (736 // s) * 2}) t(i)"
    for s, base, a, b in ((8, 0, 16, 32), (16, 29440, 64, 128), (32, 36800, 256, 512))
)


def raw(anchors: int) -> str:
    return f"""raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, ((l_orderkey * 7 + l_linenumber) * 31 + l_partkey) % {anchors} AS anchor_id,
         l_quantity / 10 AS d0, l_discount * 20 AS d1, l_quantity / 25 AS d2, l_tax * 25 + 0.0 AS d3
  FROM lineitem)"""


KEYS = "l_orderkey, l_linenumber, l_partkey, anchor_id"
CHANGE = "({b} - {a}) / ({b} + {a} + 1e-7::DOUBLE)"
BACK = "sum({x}) OVER (PARTITION BY face_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
ROLL = f"""roll AS (
  SELECT *, {BACK.format(x="1", k=180)} AS n, {BACK.format(x="r", k=180)} AS s1, {BACK.format(x="r * r", k=180)} AS s2 FROM trace),
stats AS (SELECT face_id, pos, r, n, s1 / n AS roll_mean, CASE WHEN n < 2 THEN 0.0 ELSE sqrt(greatest(0.0, s2 / n - (s1 / n) * (s1 / n))) END AS roll_std FROM roll)"""
DIFFS = f"""d AS (SELECT face_id, pos, r, {CHANGE.format(a="lag(r) OVER o", b="r")} AS diff FROM trace WINDOW o AS (PARTITION BY face_id ORDER BY pos)),
ds AS (SELECT *, {BACK.format(x="coalesce(diff, 0)", k=179)} AS s1, {BACK.format(x="coalesce(diff * diff, 0)", k=179)} AS s2, least(pos, 180) AS n FROM d),
dstats AS (SELECT face_id, pos, CASE WHEN n < 2 THEN 1.0 ELSE sqrt(greatest(1e-7::DOUBLE, s2 / n - (s1 / n) * (s1 / n))) END AS diff_std FROM ds)"""


def spectrum(value: str) -> str:
    """Power of each in-band bin of 180 samples, by the definition."""
    arg = "2 * pi() * k * at / 256"
    return f"""bins AS (SELECT k FROM range(7, 22) t(k)),
power AS (SELECT face_id, win_id, k, pow(sum({value} * cos({arg})), 2) + pow(sum({value} * sin({arg})), 2) AS p FROM w, bins GROUP BY ALL)
SELECT face_id, win_id, CAST(arg_max(k, struct_pack(p := p, k := -k)) AS INTEGER) AS bin, arg_max(k, struct_pack(p := p, k := -k)) * 7.03125::DOUBLE AS heart_rate FROM power GROUP BY ALL"""


def weighted(value: str, size: int = 180, **chain) -> str:
    """The same through a table of weights, one row for each bin and sample."""
    bins, re, im = filters.rate_weights(size, 30.0, **chain)
    rows = ",".join(f"({k},{t},{re[i, t]!r}::DOUBLE,{im[i, t]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i, k in enumerate(bins) for t in range(size))
    return f"""weights(k, at, re, im) AS (VALUES {rows}),
power AS (SELECT face_id, win_id, k, pow(sum({value} * re), 2) + pow(sum({value} * im), 2) AS p FROM w JOIN weights USING (at) GROUP BY ALL)
SELECT face_id, win_id, CAST(arg_max(k, struct_pack(p := p, k := -k)) AS INTEGER) AS bin, arg_max(k, struct_pack(p := p, k := -k)) * 7.03125::DOUBLE AS heart_rate FROM power GROUP BY ALL"""


def applied(matrix) -> str:
    return f"""WITH {SHORT}, m(at, j, x) AS (VALUES {entries(matrix)})
SELECT face_id, win_id, m.at, round(sum(x * v), 4) AS y FROM w JOIN m ON w.at = m.j GROUP BY ALL"""


PLANE = WINDOWS + """, f AS (
  SELECT *, avg(r) OVER a AS mr, avg(g) OVER a AS mg, avg(b) OVER a AS mb, var_pop(r) OVER a AS vr, var_pop(g) OVER a AS vg, var_pop(b) OVER a AS vb,
         covar_pop(r, g) OVER a AS crg, covar_pop(r, b) OVER a AS crb, covar_pop(g, b) OVER a AS cgb
  FROM w WINDOW a AS (PARTITION BY face_id, win_id ORDER BY at ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)),
k AS (SELECT *, sqrt(greatest(0.0, vg / mg / mg + vb / mb / mb - 2 * cgb / mg / mb)) / sqrt(greatest(0.0, 4 * vr / mr / mr + vg / mg / mg + vb / mb / mb - 4 * crg / mr / mg - 4 * crb / mr / mb + 2 * cgb / mg / mb)) AS al FROM f),
c AS (SELECT *, CASE WHEN at + 48 <= 179 THEN -2 * al / mr ELSE 0 END AS kr, CASE WHEN at + 48 <= 179 THEN (1 + al) / mg ELSE 0 END AS kg, CASE WHEN at + 48 <= 179 THEN (al - 1) / mb ELSE 0 END AS kb FROM k),
h AS (SELECT face_id, win_id, at, r * sum(kr) OVER o + g * sum(kg) OVER o + b * sum(kb) OVER o AS h FROM c WINDOW o AS (PARTITION BY face_id, win_id ORDER BY at ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))"""

IMAGES = BOXES + ", im AS (SELECT frame_idx, det, (x2 % 5 + 3) * 160 AS iw, (y2 % 4 + 3) * 160 AS ih, x1::DOUBLE AS x, y1::DOUBLE AS y FROM b)"
LETTER = IMAGES + """, l1 AS (SELECT *, least(640.0::DOUBLE / iw, 640.0::DOUBLE / ih) AS scale FROM im),
l2 AS (SELECT *, least(CAST(round_even(iw * scale, 0) AS INTEGER), 640) AS nw, least(CAST(round_even(ih * scale, 0) AS INTEGER), 640) AS nh FROM l1),
l3 AS (SELECT *, least(nh::DOUBLE / ih, nw::DOUBLE / iw) AS gain, CAST(CASE WHEN ih != iw THEN (640 - nw) // 2 ELSE 0 END AS INTEGER) AS dx, CAST(CASE WHEN ih != iw THEN (640 - nh) // 2 ELSE 0 END AS INTEGER) AS dy FROM l2)"""


def side(axis: str, most: int) -> str:
    a, e = f"{axis}a", f"{axis}b"
    return f"greatest(0, CASE WHEN {a} < 0 THEN 0 WHEN {e} > {most} THEN {a} - ({e} - {most}) ELSE {a} END) AS r{axis}1, least({most}, CASE WHEN {a} < 0 THEN {e} - {a} WHEN {e} > {most} THEN {most} ELSE {e} END) AS r{axis}2"


def square(larger: float) -> str:
    grown = f"CAST(trunc(s0 * {larger}::DOUBLE) AS INTEGER)" if larger > 1 else "s0"
    return f"""q0 AS (SELECT *, x1 + (x2 - x1) // 2 AS cx, y1 + (y2 - y1) // 2 AS cy, greatest(x2 - x1, y2 - y1) AS s0 FROM b),
q1 AS (SELECT *, {grown} AS sd FROM q0),
q2 AS (SELECT *, cx - sd // 2 AS xa, cx - sd // 2 + sd AS xb, cy - sd // 2 AS ya, cy - sd // 2 + sd AS yb FROM q1),
q3 AS (SELECT frame_idx, det, {side("x", 640)}, {side("y", 360)} FROM q2),
q AS (SELECT frame_idx, det, CASE WHEN ok THEN rx1 END AS rx1, CASE WHEN ok THEN ry1 END AS ry1, CASE WHEN ok THEN rx2 END AS rx2, CASE WHEN ok THEN ry2 END AS ry2 FROM (SELECT *, rx2 > rx1 AND ry2 > ry1 AS ok FROM q3))"""


CHROM = WINDOWS + """, x AS (SELECT *, unnest([at // 24 - 1, at // 24]) AS i FROM w),
y AS (SELECT *, at - i * 24 AS j, r / avg(r) OVER z AS nr, g / avg(g) OVER z AS ng, b / avg(b) OVER z AS nb FROM x WHERE i >= 0 AND i < 6 WINDOW z AS (PARTITION BY face_id, win_id, i)),
p AS (SELECT *, 3 * nr - 2 * ng AS xs, 1.5::DOUBLE * nr + ng - 1.5::DOUBLE * nb AS ys FROM y)"""


def entries(matrix) -> str:
    return ",".join(f"({i},{j},{float(matrix[i, j])!r}::DOUBLE)" for i in range(len(matrix)) for j in range(len(matrix)))


def chrom_rate() -> str:
    return f"""WITH {CHROM.replace("w AS (SELECT", "w0 AS (SELECT").replace("FROM w)", "FROM w0)")}, m(k, j, c) AS (VALUES {entries(filters.filtfilt_matrix(48, 3, 0.7, 2.5, 30.0))}),
f AS (SELECT face_id, win_id, i, m.k AS j, sum(m.c * xs) AS xs, sum(m.c * ys) AS ys FROM p JOIN m ON p.j = m.j GROUP BY ALL),
q AS (SELECT *, (xs - stddev_pop(xs) OVER z / stddev_pop(ys) OVER z * ys) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 47)) AS sw FROM f WINDOW z AS (PARTITION BY face_id, win_id, i)),
w AS (SELECT face_id, win_id, i * 24 + j AS at, sum(sw) AS s FROM q GROUP BY ALL), {weighted("s", 168, detrended=True, filtered=True)}"""


def suppressed(source: str, most: float) -> str:
    """Boxes of `source` (frame_idx, det, score, x1 .. y2) that are kept, one box a step."""
    overlap = "greatest(0, least(z.x2, r.x2) - greatest(z.x1, r.x1)) * greatest(0, least(z.y2, r.y2) - greatest(z.y1, r.y1))"
    union = f"((z.x2 - z.x1) * (z.y2 - z.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {overlap})"
    box = "struct_pack(det := r.det, x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, det) AS k FROM {source}),
walk AS (SELECT frame_idx, k, [{box}] AS kept FROM ranked r WHERE k = 1
  UNION ALL SELECT r.frame_idx, r.k, CASE WHEN len(list_filter(v.kept, lambda z: {overlap} / {union}::DOUBLE > {most}::DOUBLE)) = 0 THEN list_append(v.kept, {box}) ELSE v.kept END FROM walk v JOIN ranked r ON r.frame_idx = v.frame_idx AND r.k = v.k + 1),
alive AS (SELECT frame_idx, unnest(kept).det AS det FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY k DESC) AS n FROM walk) WHERE n = 1)"""


def detector(anchors: int, base: int, table: str, decoded: str, w: int, h: int, passes: str) -> str:
    """Faces of each frame, listed by score."""
    back = lambda c, d, side, most: f"trunc(CASE WHEN iw = {w} AND ih = {h} THEN {side} * least(1, greatest(0, {c} / {most})) ELSE least(greatest(0, ({c} - {d}) / gain), {side}) END)::INTEGER"
    return f"""WITH RECURSIVE {raw(anchors)}, a AS ({table}),
framed AS (SELECT *, l_orderkey // 8 AS frame_idx, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, d0, d1, d2, d3) AS det FROM raw),
scored AS (SELECT * EXCLUDE (anchor_id), anchor_id + {base} AS anchor_id, round((l_partkey * 7919 + det * 131) % 1000 / 1000.0::DOUBLE, 3) AS score, ((frame_idx % 5 + 3) * 160)::INTEGER AS iw, ((frame_idx % 4 + 3) * 160)::INTEGER AS ih FROM framed),
{decoded},
good AS (SELECT frame_idx, det, score, iw, ih, x1, y1, x2, y2 FROM boxed WHERE score {passes} 0.5), {suppressed("good", 0.4)},
l1 AS (SELECT good.*, least({w}::DOUBLE / iw, {h}::DOUBLE / ih) AS scale FROM good JOIN alive USING (frame_idx, det)),
l2 AS (SELECT *, least(CAST(round_even(iw * scale, 0) AS INTEGER), {w}) AS nw, least(CAST(round_even(ih * scale, 0) AS INTEGER), {h}) AS nh FROM l1),
l3 AS (SELECT *, least(nh::DOUBLE / ih, nw::DOUBLE / iw) AS gain, CASE WHEN ih != iw THEN ({w} - nw) // 2 ELSE 0 END AS dx, CASE WHEN ih != iw THEN ({h} - nh) // 2 ELSE 0 END AS dy FROM l2),
l4 AS (SELECT frame_idx, det, score, {back("x1", "dx", "iw", w)} AS a, {back("y1", "dy", "ih", h)} AS b, {back("x2", "dx", "iw", w)} AS c, {back("y2", "dy", "ih", h)} AS d FROM l3)
SELECT frame_idx, count(*) AS n_faces, string_agg(a || ':' || b || ':' || c || ':' || d, ',' ORDER BY score DESC, det) AS faces FROM l4 GROUP BY 1"""


BY_DISTANCE = "boxed AS (SELECT *, (cx - d0 * sx) * 640 AS x1, (cy - d1 * sy) * 640 AS y1, (cx + d2 * sx) * 640 AS x2, (cy + d3 * sy) * 640 AS y2 FROM scored JOIN a USING (anchor_id))"
BY_VARIANCE = """z0 AS (SELECT *, sx * exp(d2 * 0.2::DOUBLE) AS bw, sy * exp(d3 * 0.2::DOUBLE) AS bh FROM scored JOIN a USING (anchor_id)),
z1 AS (SELECT *, cx + d0 * 0.1::DOUBLE * sx - bw / 2 AS u, cy + d1 * 0.1::DOUBLE * sy - bh / 2 AS v FROM z0),
boxed AS (SELECT *, u * 1280 AS x1, v * 736 AS y1, (bw + u) * 1280 AS x2, (bh + v) * 736 AS y2 FROM z1)"""


def planes(w: int, h: int, boxes: str, score: str, mark: str, decoded: str, marks: str, passes: str, category: int, label: str) -> str:
    """Faces from planes: every value of every anchor by its place in the bytes, for two anchors to a cell."""
    grids = " UNION ALL ".join(f"SELECT {s} AS stride, {k} AS nth, {sum((w // t) * (h // t) * 2 for t in (8, 16, 32) if t < s)} + i AS anchor_id, i, i // 2 % {w // s} AS col, i // 2 // {w // s} AS line FROM range({(w // s) * (h // s) * 2}) t(i)" for k, s in enumerate((8, 16, 32)))
    value = lambda j, layer, n: f"level[((i * {n} + {j}) * 7 + (nth * 3 + {layer}) * 13) % 64 + 1]"
    logits = 1 if score.count("s1") == 0 else 2
    raw_ = [boxes.format(value(j, 0, 4)) + f" AS d{j}" for j in range(4)] + [f"{value(j, 1, logits)} AS s{j}" for j in range(logits)] + [mark.format(value(j, 2, 10)) + f" AS q{j}" for j in range(10)]
    back = lambda c, d, side, most: f"trunc(CASE WHEN iw = {w} AND ih = {h} THEN {side} * least(1, greatest(0, {c} / {most})) ELSE least(greatest(0, ({c} - {d}) / gain), {side}) END)::INTEGER"
    listed = " || ',' || ".join(f"printf('%.3f', round({marks.format(f'q{2 * i}', 'cx', 'sx', w)}, 3) + 0.0) || ':' || printf('%.3f', round({marks.format(f'q{2 * i + 1}', 'cy', 'sy', h)}, 3) + 0.0)" for i in range(5))
    return f"""WITH RECURSIVE e AS (SELECT vec_id AS frame_idx, list_transform(embedding, lambda v: (CAST(floor(v::DOUBLE * 4096) AS BIGINT) % 256 + 256) % 256) AS level FROM embeddings),
g AS ({grids}), r AS (SELECT frame_idx, anchor_id, stride, i, col, line, {', '.join(raw_)} FROM e, g), p AS (SELECT *, {score} AS score FROM r),
kept AS (SELECT * FROM p WHERE score {passes}), {decoded},
good AS (SELECT frame_idx, anchor_id AS det, score, x1, y1, x2, y2, {listed} AS landmarks FROM boxed), {suppressed("good", 0.4)},
l1 AS (SELECT good.*, ((frame_idx % 5 + 3) * 160)::INTEGER AS iw, ((frame_idx % 4 + 3) * 160)::INTEGER AS ih FROM good JOIN alive USING (frame_idx, det)),
l2 AS (SELECT *, least(CAST(round_even(iw * least({w}::DOUBLE / iw, {h}::DOUBLE / ih), 0) AS INTEGER), {w}) AS nw, least(CAST(round_even(ih * least({w}::DOUBLE / iw, {h}::DOUBLE / ih), 0) AS INTEGER), {h}) AS nh FROM l1),
l3 AS (SELECT *, least(nh::DOUBLE / ih, nw::DOUBLE / iw) AS gain, CASE WHEN ih != iw THEN ({w} - nw) // 2 ELSE 0 END AS dx, CASE WHEN ih != iw THEN ({h} - nh) // 2 ELSE 0 END AS dy FROM l2)
SELECT frame_idx, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, det) - 1 AS INTEGER) AS face, CAST({category} AS INTEGER) AS category_id, '{label}' AS label, round(score, 6) AS score,
       {back("x1", "dx", "iw", w)} AS x1, {back("y1", "dy", "ih", h)} AS y1, {back("x2", "dx", "iw", w)} AS x2, {back("y2", "dy", "ih", h)} AS y2, landmarks FROM l3"""


FACES_BY_DISTANCE = """a AS (SELECT *, col * stride / 64.0::DOUBLE AS cx, line * stride / 64.0::DOUBLE AS cy, stride / 64.0::DOUBLE AS sx, stride / 64.0::DOUBLE AS sy FROM kept),
boxed AS (SELECT *, (cx - d0 * sx) * 64 AS x1, (cy - d1 * sy) * 64 AS y1, (cx + d2 * sx) * 64 AS x2, (cy + d3 * sy) * 64 AS y2 FROM a)"""
FACES_BY_VARIANCE = """a AS (SELECT *, (col + 0.5::DOUBLE) * stride / 96 AS cx, (line + 0.5::DOUBLE) * stride / 64 AS cy, (stride * CASE WHEN i % 2 = 0 THEN CASE stride WHEN 8 THEN 2 WHEN 16 THEN 4 ELSE 8 END ELSE CASE stride WHEN 8 THEN 4 WHEN 16 THEN 8 ELSE 16 END END) / 96.0::DOUBLE AS sx, (stride * CASE WHEN i % 2 = 0 THEN CASE stride WHEN 8 THEN 2 WHEN 16 THEN 4 ELSE 8 END ELSE CASE stride WHEN 8 THEN 4 WHEN 16 THEN 8 ELSE 16 END END) / 64.0::DOUBLE AS sy FROM kept),
z0 AS (SELECT *, sx * exp(d2 * 0.2::DOUBLE) AS bw, sy * exp(d3 * 0.2::DOUBLE) AS bh FROM a), z1 AS (SELECT *, cx + d0 * 0.1::DOUBLE * sx - bw / 2 AS u, cy + d1 * 0.1::DOUBLE * sy - bh / 2 AS v FROM z0),
boxed AS (SELECT *, u * 96 AS x1, v * 64 AS y1, (bw + u) * 96 AS x2, (bh + v) * 64 AS y2 FROM z1)"""
COLOURS = "[0,255,0],[0,0,255],[255,0,0],[0,255,255],[255,0,255],[255,255,0],[0,165,255],[128,0,128],[203,192,255],[0,255,127],[147,20,255],[255,144,30],[0,69,255],[50,205,50],[0,215,255]"
EPOCH = "epoch_us(ts)"
RUNS = "runs AS (SELECT o_custkey AS run_id, count(*)::DOUBLE AS n, sum(round(o_totalprice)) AS total, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::DOUBLE AS skipped FROM orders GROUP BY 1)"
EAV = RUNS + ", eav AS (SELECT run_id, 0 AS ord, 'Processing Count' AS metric, n AS value FROM runs UNION ALL SELECT run_id, 1, 'Total Processing Time', total FROM runs UNION ALL SELECT run_id, 6, 'Skipped Frames', skipped FROM runs)"
FOLDERS = "m AS (SELECT CAST(user_id % 50 AS VARCHAR) AS folder, coalesce(avg(round(value * 100)), 0.0) AS average_fps FROM events GROUP BY 1)"
RESIZE = """e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings),
g AS (SELECT i, greatest((i // 12 + 0.5::DOUBLE) * 8 / 12 - 0.5, 0) AS y, greatest((i % 12 + 0.5::DOUBLE) * 8 / 12 - 0.5, 0) AS x FROM range(144) t(i)),
c AS (SELECT i, y - floor(y) AS fy, x - floor(x) AS fx, floor(y)::INT AS y0, floor(x)::INT AS x0, least(floor(y)::INT + 1, 7) AS y1, least(floor(x)::INT + 1, 7) AS x1 FROM g)"""

SQL = {
    "rgb_trace": f"WITH {TRACE} SELECT * FROM trace",
    "tumbling_windows": f"WITH {WINDOWS} SELECT face_id, win_id, count(*) AS n, round(sum(r) / count(*), 6) AS mean_r, round(sum(g) / count(*), 6) AS mean_g FROM w GROUP BY ALL",
    "sliding_windows": f"WITH {TRACE}, c AS (SELECT face_id, (max(pos) + 1 - 180) // 30 AS last FROM trace GROUP BY 1 HAVING max(pos) + 1 >= 180), k AS (SELECT face_id, unnest(range(0, last + 1)) AS win_id FROM c) SELECT face_id, win_id, count(*) AS n, round(sum(g) / count(*), 6) AS mean_g FROM k JOIN trace USING (face_id) WHERE pos >= win_id * 30 AND pos < win_id * 30 + 180 GROUP BY ALL",
    "chunk_close": f"WITH {TRACE} SELECT face_id, pos // 30 - 1 AS chunk_id, pos AS closing_pos FROM trace WHERE pos > 0 AND pos % 30 = 0",
    "rolling_mean_std": f"WITH {TRACE}, {ROLL} SELECT face_id, pos, n::BIGINT AS n, round(roll_mean, 6) AS roll_mean, round(roll_std, 6) AS roll_std FROM stats",
    "rolling_diff_std": f"WITH {TRACE}, {DIFFS} SELECT face_id, pos, round(diff_std, 5) AS diff_std FROM dstats",
    "chunk_standardized": f"WITH {TRACE}, {ROLL}, {DIFFS}, e AS (SELECT face_id, pos // 30 - 1 AS chunk_id, roll_mean, roll_std, diff_std FROM stats JOIN dstats USING (face_id, pos) WHERE pos > 0 AND pos % 30 = 0), x AS (SELECT face_id, pos, r, pos // 30 AS chunk_id, {CHANGE.format(a='r', b='lead(r) OVER o')} AS d FROM trace WINDOW o AS (PARTITION BY face_id ORDER BY pos)) SELECT face_id, pos, chunk_id, round((r - roll_mean) / (roll_std + 1e-7::DOUBLE), 5) AS std_value, round(coalesce(d / diff_std, 0.0), 4) AS diff_value FROM x JOIN e USING (face_id, chunk_id)",
    "clip_zscore": f"WITH {WINDOWS}, m AS (SELECT face_id, win_id, sum(r) / count(*) AS mu, sum(r * r) / count(*) AS q FROM w GROUP BY ALL) SELECT face_id, win_id, at, round(coalesce((r - mu) / nullif(sqrt(greatest(0.0, q - mu * mu)), 0), 0), 5) AS z FROM w JOIN m USING (face_id, win_id)",
    "diff_normalize": f"WITH {WINDOWS}, d AS (SELECT face_id, win_id, at, {CHANGE.format(a='r', b='lead(r) OVER o')} AS d FROM w WINDOW o AS (PARTITION BY face_id, win_id ORDER BY pos)), m AS (SELECT face_id, win_id, stddev_pop(d) AS sd FROM d GROUP BY ALL) SELECT face_id, win_id, at, round(coalesce(d / sd, 0), 5) AS dn FROM d JOIN m USING (face_id, win_id)",
    "window_truth_stats": f"WITH {TRACE}, c AS (SELECT face_id, count(*) // 30 AS steps FROM trace GROUP BY 1), k AS (SELECT face_id, unnest(range(0, steps)) AS step FROM c) SELECT face_id, step, count(*) AS n, round(sum(r) / count(*), 6) AS mean_r, round(sqrt(sum(r * r) / count(*) - (sum(r) / count(*)) * (sum(r) / count(*))), 6) AS std_r FROM k JOIN trace USING (face_id) WHERE pos >= greatest(0, step * 30 - 150) AND pos < (step + 1) * 30 GROUP BY ALL",
    "variance_formulas": f"WITH {WINDOWS} SELECT face_id, win_id, round(sum(r * r) / count(*) - (sum(r) / count(*)) * (sum(r) / count(*)), 4) AS by_moments, round(var_pop(r), 4) AS by_deviations, round(pow(stddev_pop(r), 2), 4) AS by_std FROM w GROUP BY ALL",
    "cumsum_signal": f"WITH {WINDOWS} SELECT face_id, win_id, at, sum(g) OVER (PARTITION BY face_id, win_id ORDER BY at) AS total FROM w",
    "pos_projection": f"WITH {PLANE} SELECT face_id, win_id, at, round(h, 4) AS h FROM h",
    "pos_heart_rate": f"WITH {PLANE.replace('w AS (SELECT', 'w0 AS (SELECT').replace('FROM w WINDOW', 'FROM w0 WINDOW')}, w AS (SELECT * FROM h), {weighted('h', detrended=True, filtered=True, own_band=(0.75, 3.0))}",
    "chrom_projection": f"WITH {WINDOWS}, x AS (SELECT *, unnest([at // 24 - 1, at // 24]) AS i FROM w), y AS (SELECT *, at - i * 24 AS j, r / avg(r) OVER z AS nr, g / avg(g) OVER z AS ng, b / avg(b) OVER z AS nb FROM x WHERE i >= 0 AND i < 6 WINDOW z AS (PARTITION BY face_id, win_id, i)), p AS (SELECT *, 3 * nr - 2 * ng AS xs, 1.5::DOUBLE * nr + ng - 1.5::DOUBLE * nb AS ys FROM y), q AS (SELECT *, (xs - stddev_pop(xs) OVER z / stddev_pop(ys) OVER z * ys) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 47)) AS sw FROM p WINDOW z AS (PARTITION BY face_id, win_id, i)) SELECT face_id, win_id, at, round(sum(sw), 4) AS s FROM q GROUP BY ALL",
    "chrom_heart_rate": chrom_rate(),
    "nms": f"WITH RECURSIVE {BOXES}, {suppressed('b', 0.3)} SELECT b.* FROM b JOIN alive USING (frame_idx, det)",
    "distance_detector": detector(800, 16000, GRID, BY_DISTANCE, 640, 640, ">="),
    "variance_detector": detector(1840, 36800, PRIORS, BY_VARIANCE, 1280, 736, ">"),
    "corner_boxes": f"WITH {BOXES}, r AS (SELECT *, trunc(x1 / 1000.0::DOUBLE * 640)::INTEGER AS ax1, trunc(y1 / 1000.0::DOUBLE * 360)::INTEGER AS ay1, trunc((x2 - x1) / 1000.0::DOUBLE * 640)::INTEGER AS aw, trunc((y2 - y1) / 1000.0::DOUBLE * 360)::INTEGER AS ah FROM b) SELECT frame_idx, det, x1, y1, x2, y2, ax1, ay1, ax1 + aw AS ax2, ay1 + ah AS ay2 FROM r",
    "stream_hr_state": f"WITH n AS (SELECT user_id AS face_id, round(value * 100) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), w AS (SELECT face_id, pos // 16 AS win_id, pos % 16 AS at, v FROM n WHERE pos < n // 16 * 16), power AS (SELECT face_id, win_id, k, pow(sum(v * cos(2 * pi() * k * at / 16)), 2) + pow(sum(v * sin(2 * pi() * k * at / 16)), 2) AS p FROM w, (SELECT unnest(range(1, 9)) AS k) WHERE k * 30 / 16.0 BETWEEN 0.75 AND 2.5 GROUP BY ALL) SELECT face_id, win_id, CAST(arg_max(k, struct_pack(p := p, k := -k)) AS INTEGER) AS bin, arg_max(k, struct_pack(p := p, k := -k)) * 112.5::DOUBLE AS heart_rate FROM power GROUP BY ALL",
    "moving_average_signal": f"WITH {WINDOWS} SELECT face_id, win_id, at, round(sum(r) OVER (PARTITION BY face_id, win_id ORDER BY at ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) / 60, 6) AS smooth FROM w",
    "clip_ids": f"WITH {WINDOWS} SELECT face_id, pos, win_id AS clip_id FROM w",
    "hr_fft_sql": f"WITH {WINDOWS}, {spectrum('g')}",
    "hr_full_chain": f"WITH {WINDOWS}, {weighted('r', cumulative=True, detrended=True, filtered=True)}",
    "hr_peaks": f"WITH {WINDOWS}, n AS (SELECT *, CASE WHEN r = lag(r) OVER o THEN 0 ELSE 1 END AS new FROM w WINDOW o AS (PARTITION BY face_id, win_id ORDER BY at)), u AS (SELECT *, sum(new) OVER (PARTITION BY face_id, win_id ORDER BY at) AS run FROM n), f AS (SELECT face_id, win_id, run, min(r) AS v, min(at) AS a, max(at) AS z FROM u GROUP BY ALL), k AS (SELECT *, v > lag(v) OVER o AND v > lead(v) OVER o AS peak FROM f WINDOW o AS (PARTITION BY face_id, win_id ORDER BY run)), c AS (SELECT face_id, win_id, count(*) FILTER (peak) AS n_peaks, min((a + z) // 2) FILTER (peak) AS p0, max((a + z) // 2) FILTER (peak) AS p1 FROM k GROUP BY ALL) SELECT face_id, win_id, n_peaks, CASE WHEN n_peaks > 1 THEN round(60.0::DOUBLE / ((p1 - p0) / (n_peaks - 1)::DOUBLE / 30.0::DOUBLE), 6) END AS heart_rate FROM c",
    "detrend_signal": applied(filters.detrend_matrix(24)),
    "bandpass_signal": applied(filters.filtfilt_matrix(24, 1, 0.75, 2.5, 30.0)),
    "chunk_hr_emission": f"WITH {TRACE}, c AS (SELECT face_id, pos // 30 - 1 AS chunk_id FROM trace WHERE pos > 0 AND pos % 30 = 0), e AS (SELECT face_id, chunk_id FROM c WHERE chunk_id >= 5 AND (chunk_id - 5) % 6 = 0), w AS (SELECT face_id, chunk_id AS win_id, pos - (chunk_id - 5) * 30 AS at, r FROM e JOIN trace USING (face_id) WHERE pos >= (chunk_id - 5) * 30 AND pos < (chunk_id + 1) * 30), {spectrum('r').replace('SELECT face_id, win_id, CAST(', 'SELECT face_id, win_id AS chunk_id, CAST(')}",
    "square_roi": f"WITH {BOXES}, {square(1.5)} SELECT * FROM q",
    "full_roi": f"WITH {BOXES}, c AS (SELECT frame_idx, det, least(x1, 200) AS x1, least(y1, 200) AS y1, least(x2, 200) AS x2, least(y2, 200) AS y2 FROM b) SELECT * FROM c WHERE x2 > x1 AND y2 > y1",
    "rescaled_boxes": f"WITH {BOXES} SELECT frame_idx, det, x1 // 2 AS x1, y1 // 2 AS y1, x2 // 2 AS x2, y2 // 2 AS y2 FROM b",
    "letterbox": f"WITH {LETTER} SELECT frame_idx, det, nw, nh, dx, dy, round(gain, 6) AS gain FROM l3",
    "unletterbox": f"WITH {LETTER} SELECT frame_idx, det, round(CASE WHEN iw = 640 AND ih = 640 THEN iw * least(1, greatest(0, x / 640)) ELSE least(greatest(0, (x - dx) / gain), iw) END, 4) AS ox, round(CASE WHEN iw = 640 AND ih = 640 THEN ih * least(1, greatest(0, y / 640)) ELSE least(greatest(0, (y - dy) / gain), ih) END, 4) AS oy FROM l3",
    "decode_boxes": f"WITH {raw(16800)}, a AS ({GRID}) SELECT {KEYS}, round((cx - d0 * sx) * 640 + 0.0, 4) AS x1, round((cy - d1 * sy) * 640 + 0.0, 4) AS y1, round((cx + d2 * sx) * 640 + 0.0, 4) AS x2, round((cy + d3 * sy) * 640 + 0.0, 4) AS y2 FROM raw JOIN a USING (anchor_id)",
    "decode_landmarks": f"WITH {raw(16800)}, a AS ({GRID}) SELECT {KEYS}, round((cx + d0 * sx) * 640 + 0.0, 4) AS p0x, round((cy + d1 * sy) * 640 + 0.0, 4) AS p0y, round((cx + d2 * sx) * 640 + 0.0, 4) AS p1x, round((cy + d3 * sy) * 640 + 0.0, 4) AS p1y FROM raw JOIN a USING (anchor_id)",
    "decode_priors": f"WITH {raw(38640)}, a AS ({PRIORS}), z AS (SELECT *, sx * exp(d2 * 0.2::DOUBLE) AS bw, sy * exp(d3 * 0.2::DOUBLE) AS bh FROM raw JOIN a USING (anchor_id)), y AS (SELECT *, cx + d0 * 0.1::DOUBLE * sx - bw / 2 AS x1, cy + d1 * 0.1::DOUBLE * sy - bh / 2 AS y1 FROM z) SELECT {KEYS}, round(x1 + 0.0, 4) AS x1, round(y1 + 0.0, 4) AS y1, round(bw + x1 + 0.0, 4) AS x2, round(bh + y1 + 0.0, 4) AS y2 FROM y",
    "decode_prior_landmarks": f"WITH {raw(38640)}, a AS ({PRIORS}) SELECT {KEYS}, round(cx + d0 * 0.1::DOUBLE * sx + 0.0, 6) AS p0x, round(cy + d1 * 0.1::DOUBLE * sy + 0.0, 6) AS p0y, round(cx + d2 * 0.1::DOUBLE * sx + 0.0, 6) AS p1x, round(cy + d3 * 0.1::DOUBLE * sy + 0.0, 6) AS p1y FROM raw JOIN a USING (anchor_id)",
    "softmax_scores": f"WITH {raw(38640)} SELECT {KEYS}, round(exp(d1 - greatest(d0, d1)) / (exp(d0 - greatest(d0, d1)) + exp(d1 - greatest(d0, d1))), 6) AS face_score FROM raw",
    "score_filter": f"WITH {BOXES} SELECT frame_idx, det, score, score >= 0.6 AS first_kind, score > 0.3 AS second_kind FROM b WHERE score >= 0.6 OR score > 0.3",
    "dequantised_values": f"WITH {BOXES} SELECT frame_idx, det, round((x1 % 256 - 128.0::DOUBLE) * 0.0625::DOUBLE, 6) AS value FROM b",
    "detection_labels": f"WITH {BOXES} SELECT frame_idx, det, CASE WHEN det % 4 IN (0, 1) THEN 'face' ELSE 'class_' || (det % 4) END AS label FROM b",
    "first_face": f"WITH {BOXES}, f AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY det) AS n FROM b WHERE score >= 0.6) SELECT frame_idx, det, x1, y1, x2, y2 FROM f WHERE n = 1",
    "pairwise_iou": f"WITH {BOXES}, p AS (SELECT a.frame_idx, a.det AS det_a, c.det AS det_b, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (c.x2 - c.x1) * (c.y2 - c.y1) AS sb FROM b a JOIN b c ON a.frame_idx = c.frame_idx AND a.det < c.det) SELECT frame_idx, det_a, det_b, round(i::DOUBLE / (sa + sb - i), 6) AS iou FROM p WHERE i > 0",
    "greedy_assign_step": f"WITH {BOXES}, c AS (SELECT frame_idx, det, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM b), p AS (SELECT d.frame_idx, o.det AS obj, d.det, sqrt(((o.cx - d.cx) * (o.cx - d.cx) + (o.cy - d.cy) * (o.cy - d.cy))::DOUBLE) AS dist FROM c o JOIN c d ON o.frame_idx + 1 = d.frame_idx), n AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, obj ORDER BY dist, det) AS k FROM p), m AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, det ORDER BY dist, obj) AS j FROM n WHERE k = 1) SELECT frame_idx, obj, det, round(dist, 6) AS dist FROM m WHERE j = 1",
    "display_rows": f"WITH {BOXES}, {square(1.0)}, {SAMPLES}, v AS (SELECT face_id, arg_max(v, struct_pack(a := ts, b := event_id)) AS v FROM s GROUP BY 1) SELECT b.frame_idx AS face_id, b.det, q.rx1, q.rx2, v.v FROM b LEFT JOIN q ON q.frame_idx = b.frame_idx AND q.det = b.det LEFT JOIN v ON v.face_id = b.frame_idx",
    "track_colours": f"WITH {BOXES}, c AS (SELECT frame_idx, det, [{COLOURS}][det % 15 + 1] AS c FROM b) SELECT frame_idx, det, c[1]::INTEGER AS blue, c[2]::INTEGER AS green, c[3]::INTEGER AS red FROM c",
    "spatial_mean": "WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round((unnest(embedding) * 1000::FLOAT))::DOUBLE AS v FROM embeddings) SELECT vec_id, round(avg(v) FILTER (i % 3 = 0), 6) AS mean_r, round(avg(v) FILTER (i % 3 = 1), 6) AS mean_g, round(avg(v) FILTER (i % 3 = 2), 6) AS mean_b FROM p GROUP BY 1",
    "channels_first": "WITH k AS (SELECT i::INTEGER AS at FROM range(64) t(i)) SELECT vec_id, at, round(embedding[(at % 16) * 4 + at // 16 + 1]::DOUBLE, 6) AS v FROM embeddings, k",
    "last_frame_pad": "SELECT vec_id, len(embedding)::INTEGER + 1 AS n, round(embedding[64]::DOUBLE, 6) AS last_v FROM embeddings",
    "resize_bilinear": f"WITH {RESIZE} SELECT vec_id, i::INTEGER AS at, round((p[y0 * 8 + x0 + 1] * (1 - fx) + p[y0 * 8 + x1 + 1] * fx) * (1 - fy) + (p[y1 * 8 + x0 + 1] * (1 - fx) + p[y1 * 8 + x1 + 1] * fx) * fy, 5) AS v FROM e, c",
    "resize_area": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings), k AS (SELECT i, (i // 4) * 2 AS y, (i % 4) * 2 AS x FROM range(16) t(i)) SELECT vec_id, i::INTEGER AS at, round((p[y * 8 + x + 1] + p[y * 8 + x + 2] + p[y * 8 + x + 9] + p[y * 8 + x + 10]) / 4, 5) AS v FROM e, k",
    "luma_values": f"WITH {TRACE} SELECT face_id, pos, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 4) AS luma FROM trace",
    "powers_and_decibels": f"WITH {TRACE} SELECT face_id, pos, CASE WHEN pos <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(pos))) AS BIGINT) END AS pow2, round(10 * log10(r), 6) AS db FROM trace",
    "signal_rmse": f"WITH {WINDOWS} SELECT face_id, win_id, round(sqrt(avg((r - b) * (r - b))), 6) AS rmse FROM w GROUP BY ALL",
    "fps_per_second": f"SELECT {EPOCH} // 1000000 AS second, count(*) AS frames FROM events GROUP BY 1",
    "fps_summary": f"WITH {FOLDERS} SELECT folder, round(average_fps, 6) AS average_fps FROM m",
    "fps_extremes": f"WITH {FOLDERS} SELECT round(avg(average_fps), 6) AS mean_fps, round(max(average_fps), 6) AS max_fps, round(min(average_fps), 6) AS min_fps, arg_max(folder, struct_pack(a := average_fps, b := folder)) AS max_folder, arg_min(folder, struct_pack(a := average_fps, b := folder)) AS min_folder FROM m",
    "metrics_eav": f"WITH {EAV} SELECT * FROM eav",
    "skipped_zero_gate": f"WITH {EAV} SELECT run_id FROM eav WHERE metric = 'Skipped Frames' AND value = 0",
    "dropped_frames": "SELECT l_suppkey, count(DISTINCT l_partkey) AS frames, max(l_partkey) - min(l_partkey) + 1 - count(DISTINCT l_partkey) AS dropped FROM lineitem GROUP BY 1",
    "stage_totals": f"WITH {SAMPLES} SELECT face_id, count(*) AS n, sum(v) AS total, round(count(*) / nullif((max({EPOCH}) - min({EPOCH})) / 1e6::DOUBLE, 0), 6) AS average_fps FROM s GROUP BY 1",
    "latest_hr": f"WITH {SAMPLES} SELECT face_id, arg_max(v, struct_pack(a := ts, b := event_id)) AS v FROM s GROUP BY 1",
    "hr_update_rate": f"WITH {SAMPLES} SELECT event_id, face_id, round(count(*) OVER (PARTITION BY face_id ORDER BY {EPOCH} RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE, 6) AS rate FROM s",
    "recent_means": f"WITH {SAMPLES} SELECT event_id, face_id, round(avg(v) OVER (PARTITION BY face_id ORDER BY ts, event_id ROWS 9 PRECEDING), 5) AS recent_mean FROM s",
    "expired_faces": f"WITH l AS (SELECT user_id AS face_id, max({EPOCH}) AS seen FROM events GROUP BY 1), n AS (SELECT max({EPOCH}) AS now FROM events) SELECT face_id, (now - seen) / 1e6::DOUBLE AS idle_seconds FROM l, n WHERE now - seen > 3600000000",
    "missing_subjects": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
}
SQL["chunk_rates_held"] = f"WITH {TRACE}, done AS (SELECT face_id, pos // 30 - 1 AS chunk_id FROM trace WHERE pos > 0 AND pos % 30 = 0), hr AS ({SQL['chunk_hr_emission']}) SELECT face_id, chunk_id, last_value(heart_rate IGNORE NULLS) OVER (PARTITION BY face_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS heart_rate FROM done LEFT JOIN hr USING (face_id, chunk_id)"
SQL["rolling_against_truth"] = f"WITH {TRACE}, {ROLL}, truth AS ({SQL['window_truth_stats']}) SELECT face_id, count(*) AS steps, round(sqrt(avg((roll_mean - mean_r) * (roll_mean - mean_r))), 5) AS rmse_mean, round(max(abs(roll_std - std_r)), 5) AS most_std FROM stats JOIN truth USING (face_id) WHERE stats.pos = truth.step * 30 + 29 GROUP BY 1"
EXACT_CHUNKS = SQL["chunk_standardized"].replace("round((r - roll_mean) / (roll_std + 1e-7::DOUBLE), 5)", "(r - roll_mean) / (roll_std + 1e-7::DOUBLE)").replace("round(coalesce(d / diff_std, 0.0), 4)", "coalesce(d / diff_std, 0.0)")
SQL["stream_chunk_rates"] = f"WITH sized AS (SELECT face_id, chunk_id, CAST(count(*) AS INTEGER) AS n, round(sum(abs(std_value)), 3) AS std_size, round(sum(abs(diff_value)), 3) AS diff_size FROM ({EXACT_CHUNKS}) GROUP BY ALL), held AS ({SQL['chunk_rates_held']}), hr AS ({SQL['chunk_hr_emission']}) SELECT s.face_id, s.chunk_id, n, std_size, diff_size, hr.face_id IS NOT NULL AS fresh, held.heart_rate FROM sized s JOIN held USING (face_id, chunk_id) LEFT JOIN hr ON hr.face_id = s.face_id AND hr.chunk_id = s.chunk_id"
SQL["distance_faces"] = planes(64, 64, "{} / 64.0::DOUBLE", "s0 / 256.0::DOUBLE", "({} - 128) / 64.0::DOUBLE", FACES_BY_DISTANCE, "({1} + {0} * {2}) * {3}", ">= 0.96875", 0, "face")
SQL["variance_faces"] = planes(96, 64, "({} - 128) / 32.0::DOUBLE", "1 / (exp((s0 - s1) / 64.0::DOUBLE) + 1)", "({} - 128) / 64.0::DOUBLE", FACES_BY_VARIANCE, "({1} + {0} * 0.1::DOUBLE * {2}) * {3}", "> 0.95", 1, "class_1")
SQL["rolling_comparison"] = f"WITH {TRACE}, {ROLL}, {DIFFS}, c AS (SELECT face_id, pos, r, unnest(range(pos // 30, pos // 30 + 6)) AS step FROM trace), cd AS (SELECT *, {CHANGE.format(a='lag(r) OVER o', b='r')} AS d FROM c WINDOW o AS (PARTITION BY face_id, step ORDER BY pos)), truth AS (SELECT face_id, step, min(pos) AS start_idx, max(pos) + 1 AS end_idx, round(avg(r), 5) AS gt_mean, round(stddev_pop(r), 5) AS gt_std, round(stddev_pop(d), 5) AS gt_diff_std FROM cd GROUP BY ALL) SELECT t.face_id, t.step, start_idx, end_idx, stats.pos >= 30 AS ready, gt_mean, gt_std, gt_diff_std, round(roll_mean, 5) AS sums_mean, round(roll_std, 5) AS sums_std, round(roll_mean, 5) AS direct_mean, round(roll_std, 5) AS direct_std, round(roll_mean, 5) AS merged_mean, round(roll_std, 5) AS merged_std, round(diff_std, 5) AS diff_std FROM truth t JOIN stats ON stats.face_id = t.face_id AND stats.pos = t.step * 30 + 29 JOIN dstats ON dstats.face_id = t.face_id AND dstats.pos = stats.pos"
SQL["rates_at_frames"] = "WITH r AS (SELECT user_id, ts, arg_max(round(value * 100), event_id) AS heart_rate FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, e.user_id AS face_id, heart_rate, e.user_id || ' | ' || coalesce(printf('%.1f', heart_rate), '--') AS shown FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts"
SQL["stream_rates_at_frames"] = SQL["rates_at_frames"]
SQL["letterbox_pixels"] = """WITH e AS (SELECT vec_id, [8, 4, 16, 2][vec_id % 4 + 1] AS ih, 64 // [8, 4, 16, 2][vec_id % 4 + 1] AS iw, list_transform(embedding, lambda v: (CAST(floor(v::DOUBLE * 4096) AS BIGINT) % 256 + 256) % 256) AS p FROM embeddings),
s AS (SELECT *, least(CAST(round_even(iw * least(12::DOUBLE / iw, 10::DOUBLE / ih), 0) AS INTEGER), 12) AS nw, least(CAST(round_even(ih * least(12::DOUBLE / iw, 10::DOUBLE / ih), 0) AS INTEGER), 10) AS nh FROM e),
d AS (SELECT *, CASE WHEN ih != iw THEN 12 ELSE nw END AS w, CASE WHEN ih != iw THEN 10 ELSE nh END AS h, CASE WHEN ih != iw THEN (12 - nw) // 2 ELSE 0 END AS dx, CASE WHEN ih != iw THEN (10 - nh) // 2 ELSE 0 END AS dy FROM s),
o AS (SELECT *, i // w - dy AS y, i % w - dx AS x FROM (SELECT *, unnest(range(0, w * h)) AS i FROM d)),
f AS (SELECT *, (y + 0.5::DOUBLE) * ih / nh - 0.5::DOUBLE AS sy, (x + 0.5::DOUBLE) * iw / nw - 0.5::DOUBLE AS sx FROM o),
g AS (SELECT *, sy - floor(sy) AS fy, sx - floor(sx) AS fx, greatest(0, least(ih - 1, floor(sy)::INTEGER)) AS ya, greatest(0, least(ih - 1, floor(sy)::INTEGER + 1)) AS yb, greatest(0, least(iw - 1, floor(sx)::INTEGER)) AS xa, greatest(0, least(iw - 1, floor(sx)::INTEGER + 1)) AS xb FROM f),
v AS (SELECT *, CASE WHEN y < 0 OR y >= nh OR x < 0 OR x >= nw THEN 0 ELSE floor((p[ya * iw + xa + 1] * (1 - fx) + p[ya * iw + xb + 1] * fx) * (1 - fy) + (p[yb * iw + xa + 1] * (1 - fx) + p[yb * iw + xb + 1] * fx) * fy + 0.5::DOUBLE)::BIGINT END AS b FROM g)
SELECT vec_id, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS width, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, round(least(nh::DOUBLE / ih, nw::DOUBLE / iw), 6) AS gain, string_agg(lpad(hex(b), 2, '0'), '' ORDER BY i) AS pixels FROM v GROUP BY ALL"""
BOX = "{{'id': {i}, 'x1': {b}.x1, 'y1': {b}.y1, 'x2': {b}.x2, 'y2': {b}.y2, 'm': 0}}"
#: Every object tries its nearest box, the nearest object gets it: so an object is matched if no nearer one has the same nearest box.
SQL["centroid_tracks"] = f"""WITH RECURSIVE {BOXES},
v AS (SELECT frame_idx // 8 AS video_id, frame_idx, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY det) AS boxes FROM b WHERE score >= 0.6 GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM v),
t AS (SELECT video_id, k, frame_idx, len(boxes)::BIGINT AS next_id, list_transform(boxes, lambda b, i: {BOX.format(i="(i - 1)::BIGINT", b="b")}) AS objs FROM f WHERE k = 1
UNION ALL
SELECT video_id, k, frame_idx, next_id + CASE WHEN len(objs) < len(boxes) THEN len(free) ELSE 0 END,
       list_concat(list_filter(list_transform(objs, lambda o, i: CASE WHEN won[i] THEN {{'id': o.id, 'x1': boxes[near[i]].x1, 'y1': boxes[near[i]].y1, 'x2': boxes[near[i]].x2, 'y2': boxes[near[i]].y2, 'm': 0}} ELSE {{'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'm': o.m + CASE WHEN len(objs) >= len(boxes) THEN 1 ELSE 0 END}} END), lambda o: o.m <= 2),
                   CASE WHEN len(objs) < len(boxes) THEN list_transform(free, lambda c, i: {BOX.format(i="next_id + i - 1", b="boxes[c]")}) ELSE [] END)
FROM (SELECT *, list_filter(range(1, len(boxes) + 1), lambda c: NOT list_contains(list_transform(list_filter(range(1, len(objs) + 1), lambda i: won[i]), lambda i: near[i]), c)) AS free
FROM (SELECT *, list_transform(range(1, len(objs) + 1), lambda i: len(list_filter(range(1, len(objs) + 1), lambda j: near[j] = near[i] AND (gap[j] < gap[i] OR gap[j] = gap[i] AND j < i))) = 0) AS won
FROM (SELECT *, list_transform(dist, lambda d: list_position(d, list_min(d))) AS near, list_transform(dist, lambda d: list_min(d)) AS gap
FROM (SELECT f.*, next_id, objs, list_transform(objs, lambda o: list_transform(boxes, lambda b: ((o.x1 + o.x2) // 2 - (b.x1 + b.x2) // 2) * ((o.x1 + o.x2) // 2 - (b.x1 + b.x2) // 2) + ((o.y1 + o.y2) // 2 - (b.y1 + b.y2) // 2) * ((o.y1 + o.y2) // 2 - (b.y1 + b.y2) // 2))) AS dist
FROM t JOIN f ON f.video_id = t.video_id AND f.k = t.k + 1)))))
SELECT video_id, frame_idx, o.id AS object_id, o.x1, o.y1, o.x2, o.y2, o.m > 0 AS is_stale FROM (SELECT video_id, frame_idx, unnest(objs) AS o FROM t)"""
SQL["video_rates"] = f"""WITH e AS (SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, count(*) OVER (PARTITION BY label) AS n_all, list_transform(embedding, lambda v: (CAST(floor(v::DOUBLE * 4096) AS BIGINT) % 256 + 256) % 256) AS p FROM embeddings),
o AS (SELECT *, unnest([0, 1]) AS object_id FROM e WHERE n < n_all // 24 * 24),
w AS (SELECT video_id * 10 + object_id AS face_id, n // 24 AS win_id, n % 24 AS at, CASE object_id WHEN 0 THEN list_sum(list_transform(range(6), lambda i: p[(i // 3 * 5 + i % 3) * 3 + 2])) / 6.0::DOUBLE ELSE list_sum(list_transform(range(9), lambda i: p[((i // 3 + 1) * 5 + i % 3 + 2) * 3 + 2])) / 9.0::DOUBLE END AS g FROM o),
{weighted("g", 24, detrended=True, filtered=True).replace("7.03125", "56.25")}"""
SQL["video_rates"] = f"SELECT face_id // 10 AS video_id, face_id % 10 AS object_id, win_id, heart_rate FROM ({SQL['video_rates']})"
SIX_MOVES = ", ".join(f"coalesce({CHANGE.format(a=f'lag({c}) OVER o', b=c)}, 0) AS d{c}, {CHANGE.format(a=c, b=f'lead({c}) OVER o')} AS n{c}" for c in "rgb")
SQL["six_channel_chunks"] = f"""WITH {TRACE}, m AS (SELECT *, {SIX_MOVES} FROM trace WINDOW o AS (PARTITION BY face_id ORDER BY pos)),
s AS (SELECT *, least(pos + 1, 181) * 3 AS n, least(pos, 180) * 3 AS nd, {BACK.format(x="r + g + b", k=180)} AS s1, {BACK.format(x="r * r + g * g + b * b", k=180)} AS s2, {BACK.format(x="dr + dg + db", k=179)} AS d1, {BACK.format(x="dr * dr + dg * dg + db * db", k=179)} AS d2 FROM m),
e AS (SELECT face_id, pos // 30 - 1 AS chunk_id, s1 / n AS mean, sqrt(greatest(0.0, s2 / n - (s1 / n) * (s1 / n))) AS std, sqrt(greatest(1e-7::DOUBLE, d2 / nd - (d1 / nd) * (d1 / nd))) AS diff_std FROM s WHERE pos > 0 AND pos % 30 = 0)
SELECT m.face_id, m.pos, e.chunk_id, {", ".join(f"round(n{c} / diff_std, 4) AS c{i}" for i, c in enumerate("rgb"))}, {", ".join(f"round(({c} - mean) / (std + 1e-7::DOUBLE), 4) AS c{i + 3}" for i, c in enumerate("rgb"))} FROM m JOIN e ON e.face_id = m.face_id AND e.chunk_id = m.pos // 30"""
SQL["region_arrays"] = "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, array_to_string(list_transform(embedding, lambda v: lpad(hex(greatest(0, least(255, CAST(floor(v::DOUBLE * 64) AS BIGINT) + 128))), 2, '0')), '') AS pixels, 0::BIGINT AS shed FROM embeddings"
#: `at` is a word of DuckDB's grammar.
SQL = {name: re.sub(r"\bat\b", '"at"', text) for name, text in SQL.items()}
#: Values that may round to minus zero here, where Spark has plain zero.
SIGNED = {
    "clip_zscore": ["z"],
    "diff_normalize": ["dn"],
    "chunk_standardized": ["std_value", "diff_value"],
    "six_channel_chunks": ["c0", "c1", "c2", "c3", "c4", "c5"],
    "pos_projection": ["h"],
    "chrom_projection": ["s"],
    "detrend_signal": ["y"],
    "bandpass_signal": ["y"],
    "decode_boxes": ["x1", "y1", "x2", "y2"],
    "decode_priors": ["x1", "y1", "x2", "y2"],
    "decode_landmarks": ["p0x", "p0y", "p1x", "p1y"],
    "decode_prior_landmarks": ["p0x", "p0y", "p1x", "p1y"],
    "dequantised_values": ["value"],
    "channels_first": ["v"],
    "last_frame_pad": ["last_v"],
    "resize_bilinear": ["v"],
    "resize_area": ["v"],
    "spatial_mean": ["mean_r", "mean_g", "mean_b"],
}
SQL |= {name: f"SELECT * REPLACE ({', '.join(f'{c} + 0.0::DOUBLE AS {c}' for c in columns)}) FROM ({SQL[name]})" for name, columns in SIGNED.items()}
