"""SQL that the queries equal, over the test tables."""

from __future__ import annotations

from tidewake.plans.adapters import AIS_SQL, BOX_SQL, EVAL_SQL, SEQUENCE_SQL

ROUNDS = 6


def _vincenty() -> str:
    """CTEs from ais to geo: distance (metres) and bearing from the sample camera, rounds unrolled."""
    f = "(1e0 / 298.257223563e0)"
    steps = [
        f"""v0 AS (SELECT *, radians(lon - 121.5e0) AS l, atan((1e0 - {f}) * tan(radians(29.87e0))) AS u1, atan((1e0 - {f}) * tan(radians(lat))) AS u2,
  radians(lon - 121.5e0) AS lam FROM ais)"""
    ]
    for k in range(ROUNDS):
        steps.append(f"""a{k} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{k}),
b{k} AS (SELECT *, atan2(ss, cs) AS s, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM a{k}),
c{k} AS (SELECT *, 1 - sa * sa AS c2a, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS c2m, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS c FROM b{k}),
v{k + 1} AS (SELECT * EXCLUDE (lam, ss, cs, s, sa, c2a, c2m, c), l + (1 - c) * {f} * sa * (s + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam, ss AS o_ss, cs AS o_cs, s AS o_s, c2a AS o_c2a, c2m AS o_c2m
  FROM (SELECT * {"EXCLUDE (o_ss, o_cs, o_s, o_c2a, o_c2m)" if k else ""} FROM c{k}))""")
    b = f"(6378137e0 * (1 - {f}))"
    steps.append(f"""w AS (SELECT *, o_c2a * (6378137e0 * 6378137e0 - {b} * {b}) / ({b} * {b}) AS uu FROM v{ROUNDS}),
x AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM w),
geo AS (SELECT run_id, event_id, tick, mmsi, lon, lat, speed, course, heading, ts_ms,
  {b} * ba * (o_s - bb * o_ss * (o_c2m + bb / 4 * (o_cs * (2 * o_c2m * o_c2m - 1) - bb / 6 * o_c2m * (4 * o_ss * o_ss - 3) * (4 * o_c2m * o_c2m - 3)))) AS distance,
  (degrees(atan2(sin(radians(lon) - radians(121.5e0)) * cos(radians(lat)), cos(radians(29.87e0)) * sin(radians(lat)) - sin(radians(29.87e0)) * cos(radians(lat)) * cos(radians(lon) - radians(121.5e0)))) + 360) % 360 AS bearing FROM x)""")
    return ",\n".join(steps)


GEO_SQL = f"WITH {AIS_SQL},\n{_vincenty()},\nseen AS (SELECT *, CASE WHEN 90e0 + 5 - 35e0 / 2 >= degrees(atan(distance / 20e0)) THEN 'OutsideVerticalFov' WHEN CASE WHEN abs(90 - bearing) < 180 THEN abs(90 - bearing) ELSE 360 - abs(90 - bearing) END <= 55e0 / 2 + 8 THEN 'Transform' ELSE 'RemoveVisualTrack' END AS class FROM geo)\n"
VALID = "mmsi BETWEEN 100000000 AND 999999999 AND lon BETWEEN 0 AND 180 AND lat BETWEEN 0 AND 90 AND course >= 0 AND course < 360 AND heading >= 0 AND speed > 0.3e0"
DAYS = f"WITH {AIS_SQL}, days AS (SELECT * REPLACE (tick // 24 AS tick) FROM ais)"
POINTS = DAYS + ", points AS (SELECT mmsi AS id, tick, CAST((min(event_id) * 7919) % 1920 AS INTEGER) AS x, CAST((min(event_id) * 104729) % 1080 AS INTEGER) AS y FROM days GROUP BY mmsi, tick)"
WAYS = POINTS + ", ways AS (SELECT id, list(x ORDER BY tick) AS xs, list(y ORDER BY tick) AS ys, count(*) AS n FROM points GROUP BY id)"
PAIRS = WAYS + """, pairs AS (SELECT a.id AS track_id, b.id AS mmsi, a.xs AS ax, a.ys AS ay, a.n AS an, b.xs AS bx, b.ys AS by_, b.n AS bn FROM ways a JOIN ways b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
turned AS (SELECT *, atan2(ay[an] - ay[CASE WHEN an >= 10 THEN an - 9 ELSE 1 END], ax[an] - ax[CASE WHEN an >= 10 THEN an - 9 ELSE 1 END]) AS p, atan2(by_[bn] - by_[1], bx[bn] - bx[1]) AS q FROM pairs),
angled AS (SELECT *, CASE WHEN p * q >= 0 THEN abs(p - q) WHEN abs(p) + abs(q) > pi() THEN 2 * pi() - (abs(p) + abs(q)) ELSE abs(p) + abs(q) END AS angle,
  sqrt(CAST((ax[an] - bx[bn]) * (ax[an] - bx[bn]) + (ay[an] - by_[bn]) * (ay[an] - by_[bn]) AS DOUBLE)) AS end_distance FROM turned)"""
WITH_BOXES = f"WITH {BOX_SQL}"
IOU = "WITH " + BOX_SQL + """, met AS (SELECT a.frame, a.det AS det_a, b.det AS det_b,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + {p}, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + {p}, 0) AS common,
  (a.x2 - a.x1 + {p}) * (a.y2 - a.y1 + {p}) AS s, (b.x2 - b.x1 + {p}) * (b.y2 - b.y1 + {p}) AS t,
  (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.det < b.det)"""
IOU_0, IOU_1 = IOU.replace("{p}", "0"), IOU.replace("{p}", "1")
MOT = "CAST(trunc(greatest(x1, 0)) AS INTEGER) AS x, CAST(trunc(greatest(y1, 0)) AS INTEGER) AS y, CAST(trunc(abs(least(x2, 640) - greatest(x1, 0))) AS INTEGER) AS w, CAST(trunc(abs(least(y2, 400) - greatest(y1, 0))) AS INTEGER) AS h"
MATCHES = WITH_BOXES + ", matches AS (SELECT frame, det AS track_id, 431000000 + frame % 150 AS mmsi FROM boxes WHERE (frame + det) % 3 = 0)"
SEEN = POINTS + """, p AS (SELECT id % 10 AS run_id, tick * 1000 AS tick_ms, id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points),
near AS (SELECT t.run_id, t.tick_ms, CAST(t.id % 1000 AS INTEGER) AS track_id, v.id AS mmsi, sqrt((t.x - v.x) * (t.x - v.x) + (t.y - v.y) * (t.y - v.y)) AS d FROM p t JOIN p v ON t.run_id = v.run_id AND t.tick_ms = v.tick_ms WHERE t.id % 20 < 10 AND v.id % 20 >= 10)"""
EVENTS = WITH_BOXES + """, marks AS (SELECT frame % 5 AS sequence, frame, CASE WHEN det <> 5 THEN det END AS truth_id, CASE WHEN (frame + det) % 6 <> 0 THEN det * 10 + (frame // 400) % 2 END AS found_id FROM boxes),
ev AS (SELECT * FROM marks WHERE truth_id IS NOT NULL OR found_id IS NOT NULL),
sw AS (SELECT sequence, found_id, lag(found_id) OVER (PARTITION BY sequence, truth_id ORDER BY frame) AS last FROM ev WHERE truth_id IS NOT NULL AND found_id IS NOT NULL),
rows_ AS (SELECT sequence, 0 AS s, (truth_id IS NOT NULL)::INT AS t, (found_id IS NOT NULL)::INT AS f, (truth_id IS NOT NULL AND found_id IS NOT NULL)::INT AS m FROM ev UNION ALL SELECT sequence, 1, 0, 0, 0 FROM sw WHERE last <> found_id)"""
E5 = f"WITH {EVAL_SQL}"
AP = E5 + """, env AS (SELECT cls, rec - coalesce(lag(rec) OVER (PARTITION BY cls ORDER BY rank), 0) AS step, max(prec) OVER (PARTITION BY cls ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM curve),
aps AS (SELECT cls, sum(step * top) AS ap FROM env GROUP BY cls)"""
GALLERY = "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 10 = 0), g AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"

ORACLE_SQL: dict[str, str] = {
    "ais_valid_filter": f"WITH {AIS_SQL} SELECT event_id, mmsi, lon, lat, speed FROM ais WHERE {VALID}",
    "ais_bearing": GEO_SQL + "SELECT event_id, round(bearing, 4) AS bearing FROM geo",
    "ais_distance_gate": GEO_SQL + f"SELECT event_id, round(distance, 1) AS distance, round(distance * 0.00054e0, 3) AS miles FROM geo WHERE {VALID} AND distance <= 3704",
    "ais_visibility_class": GEO_SQL + "SELECT event_id, class FROM seen",
    "ais_project_pixels": GEO_SQL + """, off AS (SELECT event_id, distance, CASE WHEN bearing - 90 > 180 THEN bearing - 450 WHEN bearing - 90 < -180 THEN bearing + 270 ELSE bearing - 90 END AS h FROM seen WHERE class = 'Transform'),
z AS (SELECT event_id, distance * cos(radians(h)) AS zw, distance * sin(radians(h)) AS xw, 20e0 - distance * cos(radians(h)) * tan(radians(-5e0)) AS rest FROM off)
SELECT event_id, round(1500e0 * xw / (zw / cos(radians(-5e0)) + rest * sin(radians(-5e0))) + 960, 2) AS x, round(1500e0 * rest * cos(radians(-5e0)) / (zw / cos(radians(-5e0)) + rest * sin(radians(-5e0))) + 540, 2) AS y FROM z""",
    "ais_dead_reckoning": f"WITH {AIS_SQL} SELECT event_id, 0e0 AS error, round(speed * (10e0 / 60) * 1852, 3) AS metres FROM ais",
    "ais_last_per_vessel": DAYS + " SELECT tick, mmsi, max(event_id) AS event_id, arg_max(speed, event_id) AS speed FROM days GROUP BY tick, mmsi",
    "ais_carry_anti": DAYS + ", heard AS (SELECT DISTINCT tick, mmsi FROM days) SELECT tick + 1 AS tick, mmsi FROM heard h WHERE EXISTS (SELECT 1 FROM heard t WHERE t.tick = h.tick + 1) AND NOT EXISTS (SELECT 1 FROM heard n WHERE n.tick = h.tick + 1 AND n.mmsi = h.mmsi)",
    "ais_asof_latest": DAYS + ", last AS (SELECT tick, mmsi, max(event_id) AS event_id, arg_max(speed, event_id) AS speed FROM days GROUP BY tick, mmsi), grid AS (SELECT DISTINCT a.tick, b.mmsi FROM days a, (SELECT DISTINCT mmsi FROM days) b) SELECT g.tick, g.mmsi, l.event_id, l.speed FROM grid g ASOF JOIN last l ON g.mmsi = l.mmsi AND g.tick >= l.tick",
    "ais_jump_filter_pairwise": f"WITH {AIS_SQL}, l AS (SELECT *, lag(lon) OVER w AS a, lag(lat) OVER w AS b, lag(speed) OVER w AS c FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY ts_ms, event_id)) SELECT event_id, mmsi, speed FROM l WHERE a IS NULL OR (abs(lon - a) < 1 AND abs(lat - b) < 1 AND abs(speed - c) < 7)",
    "ais_history_window": f"WITH {AIS_SQL} SELECT event_id, count(*) OVER w AS kept, min(ts_ms) OVER w AS oldest FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY ts_ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW)",
    "ais_history_reset": f"WITH {AIS_SQL}, e AS (SELECT *, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ais) SELECT event_id, CAST(epoch AS BIGINT) AS epoch, count(*) FILTER (event_id % 7 <> 0) OVER (PARTITION BY mmsi, epoch ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS points FROM e",
    "frame_second_gate": f"WITH {AIS_SQL} SELECT event_id, ts_ms FROM ais WHERE ts_ms % 1000 < 40",
    "tick_tumbling_mean": "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, CAST(trunc(avg(value)) AS INTEGER) AS value, CAST(trunc(avg(event_id)) AS INTEGER) AS event_id FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts)",
    "set_ops_ids": f"WITH {AIS_SQL}, a AS (SELECT DISTINCT mmsi FROM ais WHERE event_id % 2 = 0), b AS (SELECT DISTINCT mmsi FROM ais WHERE event_id % 3 = 0 AND speed > 20) SELECT mmsi, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT mmsi, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT mmsi, 'semi' FROM a WHERE mmsi IN (SELECT mmsi FROM b) UNION ALL SELECT mmsi, 'anti' FROM a WHERE mmsi NOT IN (SELECT mmsi FROM b)",
    "process_time_stats": "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS n FROM events GROUP BY event_type",
    "vessel_trails": POINTS + " SELECT id, tick, count(*) OVER (PARTITION BY id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS n, CAST(sum(x) OVER (PARTITION BY id ORDER BY tick ROWS 9 PRECEDING) AS BIGINT) AS last_ten_x FROM points",
    "box_codecs": WITH_BOXES + " SELECT frame, det, x2 - x1 AS w, y2 - y1 AS h, x1 + (x2 - x1) / 2 AS cx, y1 + (y2 - y1) / 2 AS cy, round((x2 - x1) / (y2 - y1), 6) AS aspect, greatest(CAST(trunc(x1) AS INTEGER), 0) AS left, greatest(CAST(trunc(y1) AS INTEGER), 0) AS top, least(CAST(trunc(x2) AS INTEGER), 639) AS right, least(CAST(trunc(y2) AS INTEGER), 399) AS bottom FROM boxes",
    "letterbox_inverse": WITH_BOXES + " SELECT frame, det, greatest(floor((x1 - 0) / 0.5e0), 0) AS px1, greatest(floor((y1 - 140) / 0.5e0), 0) AS py1, least(floor(x2 / 0.5e0), 1280) AS px2, least(floor((y2 - 140) / 0.5e0), 720) AS py2 FROM boxes",
    "point_in_box": WITH_BOXES + " SELECT frame, det FROM boxes WHERE 300 BETWEEN x1 AND x2 AND 200 BETWEEN y1 AND y2",
    "iou_pairs": IOU_0 + " SELECT frame, det_a, det_b, round(common / (s + t - common), 6) AS iou FROM met WHERE common / (s + t - common) >= 0.3e0",
    "iou_voc_pairs": IOU_1 + " SELECT frame, det_a, det_b, round(common / (s + t - common), 6) AS iou FROM met WHERE common / (s + t - common) >= 0.3e0",
    "giou_pairs": IOU_0 + " SELECT frame, round(common / (s + t - common) - (hull - (s + t - common)) / hull, 6) AS giou FROM met WHERE det_a = 1 AND det_b = 2",
    "triangular_overlap_first": IOU_0 + " SELECT frame, det_a AS det, min(det_b) AS partner FROM met WHERE common / s > 0.2e0 OR common / t > 0.2e0 GROUP BY frame, det_a",
    "occlusion_anti_join": WITH_BOXES + " SELECT frame, det FROM boxes d WHERE det > 2 AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.det <= 2 AND o.frame = d.frame AND (d.x1 + d.x2) / 2 BETWEEN o.x1 AND o.x2 AND (d.y1 + d.y2) / 2 BETWEEN o.y1 AND o.y2)",
    "nms_greedy": "WITH RECURSIVE " + BOX_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS r FROM boxes WHERE score >= 0.5e0),
walk AS (SELECT frame, 1 AS r, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det': det, 'score': score}] AS kept FROM ranked WHERE r = 1 UNION ALL
  SELECT w.frame, b.r, CASE WHEN len(list_filter(w.kept, lambda o: greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1), 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1), 0)
    > 0.3e0 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1), 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1), 0)))) > 0 THEN w.kept
    ELSE list_append(w.kept, {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'det': b.det, 'score': b.score}) END FROM walk w JOIN ranked b ON b.frame = w.frame AND b.r = w.r + 1),
ends AS (SELECT frame, arg_max(kept, r) AS kept FROM walk GROUP BY frame), out_ AS (SELECT frame, unnest(kept) AS k FROM ends)
SELECT frame, k.det AS det, round(k.score, 4) AS score FROM out_""",
    "anchor_decode": WITH_BOXES + " SELECT frame, det, round((score + det) * 8, 4) AS cx, round((score / 2 + frame % 20) * 8, 4) AS cy, round(exp(score) * 8, 4) AS w, round(exp(score / 3) * 8, 4) AS h FROM boxes",
    "mot_detection_rows": WITH_BOXES + f" SELECT frame + 1 AS frame, det, 0 AS id, {MOT} FROM boxes",
    "mot_tracking_rows": WITH_BOXES + f", s AS (SELECT frame, det, x1 - 40 AS x1, y1 - 30 AS y1, x2, y2 FROM boxes) SELECT frame + 1 AS frame, det AS id, {MOT} FROM s",
    "mot_fusion_rows": MATCHES + f" SELECT b.frame + 1 AS frame, b.det AS track_id, m.mmsi AS id, {MOT} FROM boxes b JOIN matches m ON b.frame = m.frame AND b.det = m.track_id",
    "fused_left_outer": MATCHES + " SELECT b.frame, b.det AS track_id, CAST(coalesce(m.mmsi, 0) AS BIGINT) AS mmsi, b.x1 FROM boxes b LEFT JOIN matches m ON b.frame = m.frame AND b.det = m.track_id",
    "ignore_labels": WITH_BOXES + " SELECT CAST(det % 7 AS INTEGER) AS label, count(*) AS n FROM boxes WHERE det % 7 IN (1, 3) GROUP BY det % 7",
    "speed_vector": POINTS + ", o AS (SELECT *, arg_min({'t': tick, 'x': x, 'y': y}, tick) OVER (PARTITION BY id ORDER BY tick RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS old FROM points) SELECT id, tick, round(coalesce((x - old.x) / (tick - old.t), 0), 4) AS vx, round(coalesce((y - old.y) / (tick - old.t), 0), 4) AS vy FROM o",
    "displacement_lag12": POINTS + " SELECT p.id, p.tick, a.x - b.x AS dx, a.y - b.y AS dy FROM points p JOIN points a ON a.id = p.id AND a.tick = p.tick - 1 JOIN points b ON b.id = p.id AND b.tick = p.tick - 2",
    "stable_ids_5": POINTS + " SELECT p.id, p.tick FROM points p JOIN points q ON q.id = p.id AND q.tick BETWEEN p.tick - 4 AND p.tick GROUP BY p.id, p.tick HAVING count(*) = 5",
    "motion_shift": WITH_BOXES + " SELECT frame, det, x1 + det * 2e0 AS to_x1, y1 - det / 2e0 * 2 AS to_y1, x2 + det * 2e0 AS to_x2, y2 - det / 2e0 * 2 AS to_y2 FROM boxes",
    "trajectory_collect": WAYS + " SELECT id, CAST(n AS INTEGER) AS n, CAST(xs[1] AS DOUBLE) AS first_x, CAST(ys[n] AS DOUBLE) AS last_y FROM ways",
    "trajectory_halve": WAYS + ", i AS (SELECT *, unnest(range(0, n // 2)) AS i FROM ways) SELECT id, CAST(i AS INTEGER) AS i, (xs[2 * i + 1] + xs[2 * i + 2]) / 2e0 AS x, (ys[2 * i + 1] + ys[2 * i + 2]) / 2e0 AS y FROM i",
    "heading_angle": PAIRS + " SELECT track_id, mmsi, round(angle, 6) AS angle FROM angled",
    "pair_gate": PAIRS + " SELECT track_id, mmsi, round(end_distance, 4) AS end_distance FROM angled WHERE end_distance < 540 AND angle < 5e0 / 6 * pi()",
    "pair_cost_case": """WITH pairs AS (SELECT o_custkey % 40 AS track_id, o_orderkey % 30 AS mmsi, max(o_totalprice) AS score FROM orders GROUP BY ALL),
held AS (SELECT track_id, mmsi, track_id % 9 AS n FROM pairs WHERE (track_id * 7 + mmsi) % 97 = 0 AND track_id % 9 > 3)
SELECT p.track_id, p.mmsi, CASE WHEN h.n IS NOT NULL THEN -100e0 * h.n WHEN p.track_id IN (SELECT track_id FROM held) OR p.mmsi IN (SELECT mmsi FROM held) THEN 1e9 ELSE coalesce(score, 1e9) END AS cost FROM pairs p LEFT JOIN held h ON p.track_id = h.track_id AND p.mmsi = h.mmsi""",
    "nearest_within_gate": SEEN + " SELECT run_id, tick_ms, track_id, mmsi, round(d, 4) AS distance FROM near WHERE d <= 540 QUALIFY row_number() OVER (PARTITION BY run_id, tick_ms, track_id ORDER BY d, mmsi) = 1",
    "layout_running_offset": "WITH c AS (SELECT c_nationkey AS frame, c_custkey AS id, c_acctbal AS x, CASE WHEN c_mktsegment < 'C' THEN 160 ELSE 128 END AS s FROM customer), o AS (SELECT *, CAST(coalesce(sum(s + 5) OVER (PARTITION BY frame ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 5 AS x1 FROM c) SELECT frame, id, x1, x1 + s AS x2 FROM o",
    "cosine_nn": GALLERY + " SELECT q.vec_id, round(min(1 - list_cosine_similarity(q.v, g.v)), 5) AS distance FROM q JOIN g ON q.label = g.label AND q.vec_id <> g.vec_id GROUP BY q.vec_id",
    "euclid_nn": GALLERY + " SELECT q.vec_id, round(min(pow(list_distance(q.v, g.v), 2)), 4) AS distance FROM q JOIN g ON q.label = g.label AND q.vec_id <> g.vec_id GROUP BY q.vec_id",
    "reid_top1_accuracy": GALLERY + ", d AS (SELECT q.vec_id, q.label AS ql, g.label AS gl, g.vec_id AS o, round(list_inner_product(q.v, g.v), 9) AS s FROM q JOIN g ON q.vec_id <> g.vec_id), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, o) = 1) SELECT round(avg(CASE WHEN ql = gl THEN 1e0 ELSE 0 END), 6) AS top1, count(*) AS n FROM t",
    "gallery_budget": "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 10",
    "kalman_predict": WITH_BOXES + " SELECT frame, det, (x1 + x2) / 2 + det AS x, (y1 + y2) / 2 - det AS y, round(pow((y2 - y1) * 2 * (1e0 / 20), 2) + pow((y2 - y1) * 10 * (1e0 / 160), 2) + pow((y2 - y1) * (1e0 / 20), 2), 4) AS var_x FROM boxes",
    "chi2_gate": WITH_BOXES + ", d AS (SELECT frame, det, (pow(det * 8e0, 2) + pow(det * 5e0, 2)) / (pow((y2 - y1) * 2 * (1e0 / 20), 2) + pow((y2 - y1) * (1e0 / 20), 2)) AS d2 FROM boxes) SELECT frame, det, round(CASE WHEN d2 > 9.4877e0 THEN 1e5 ELSE d2 END, 4) AS cost FROM d",
    "voc_tp_fp": E5 + " SELECT cls, count(*) AS n_found, CAST(sum(tp) AS BIGINT) AS tp, count(*) FILTER (tp = 0) AS fp FROM judged GROUP BY cls",
    "voc_pr_curve": E5 + " SELECT cls, CAST(rank AS INTEGER) AS rank, round(rec, 6) AS rec, round(prec, 6) AS prec FROM curve",
    "voc_ap": AP + " SELECT cls, round(ap, 6) AS ap FROM aps",
    "map_mean": AP + " SELECT round(avg(ap), 6) AS map FROM aps",
    "scores_at_cut": E5 + ", c AS (SELECT cls, coalesce(arg_max({'r': rec, 'p': prec}, rank) FILTER (conf > 0.5), arg_min({'r': rec, 'p': prec}, rank)) AS v FROM curve GROUP BY cls) SELECT cls, round(v.r, 6) AS recall, round(v.p, 6) AS precision, round(CASE WHEN v.r + v.p > 0 THEN 2 * v.r * v.p / (v.r + v.p) ELSE 0 END, 6) AS f1 FROM c",
    "lamr": E5 + ", refs AS (SELECT pow(10e0, -2 + unnest(range(0, 9)) / 4e0) AS ref, unnest(range(0, 9)) AS i), m AS (SELECT cls, i, coalesce(arg_max(1 - rec, rank) FILTER (cum_fp / n_images <= ref), 1) AS miss FROM curve, refs GROUP BY cls, i) SELECT cls, round(exp(avg(ln(greatest(miss, 1e-10)))), 6) AS lamr FROM m GROUP BY cls",
    "gt_dr_anti": E5 + " SELECT DISTINCT frame FROM truth WHERE cls = 'A' AND frame NOT IN (SELECT frame FROM found WHERE conf > 0.9)",
    "mot_summary": EVENTS + " SELECT CAST(coalesce(sequence, -1) AS BIGINT) AS sequence, CAST(sum(s) AS BIGINT) AS num_switches, round(1 - (sum(t) - sum(m) + sum(f) - sum(m) + sum(s)) / sum(t), 6) AS mota, round(sum(m) / sum(t), 6) AS recall, round(sum(m) / sum(f), 6) AS precision FROM rows_ GROUP BY ROLLUP (sequence)",
    "json_log_nested": "SELECT conv_id AS frame_id, turn AS bbox_id, role AS category, CAST(length(text) AS INTEGER) AS confidence FROM conversations",
    "coco_export": E5 + ", names AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS listed FROM (SELECT DISTINCT cls FROM truth)) SELECT frame AS image_id, gt, CAST(listed AS INTEGER) AS listed, CAST(listed + 1 AS INTEGER) AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area FROM truth JOIN names USING (cls)",
    "train_val_split": "WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 10000) / 10000e0 AS v FROM orders) SELECT CASE WHEN v >= 0.95e0 THEN 'test' WHEN v >= 0.95e0 * 0.95e0 THEN 'val' ELSE 'train' END AS part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM p GROUP BY 1",
    "first_image_per_id": "SELECT l_partkey AS id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "stamp_names": "SELECT event_id, strftime(date_trunc('second', ts), '%Y_%m_%d_%H_%M_%S') || '.csv' AS name, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, CAST(greatest(0, least(500, floor(event_id / 25e0 + 1e-6))) AS INTEGER) AS frame_index, ((431000000 + user_id) * 47) % 360 AS hue FROM events",
    "mot_near_pairs": "WITH " + SEQUENCE_SQL + """, p AS (SELECT t.sequence, t.id AS truth_id, f.id AS found_id, t.w * t.h + f.w * f.h AS areas,
  greatest(least(t.x + t.w, f.x + f.w) - greatest(t.x, f.x), 0) * greatest(least(t.y + t.h, f.y + f.h) - greatest(t.y, f.y), 0) AS common FROM t JOIN f ON t.sequence = f.sequence AND t.frame = f.frame)
SELECT sequence, truth_id, found_id, count(*) AS n FROM p WHERE 1 - common / (areas - common) <= 0.5e0 GROUP BY ALL""",
    "nms_covered": "WITH RECURSIVE " + BOX_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det DESC) AS r FROM boxes),
walk AS (SELECT frame, 1 AS r, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det': det}] AS kept FROM ranked WHERE r = 1 UNION ALL
  SELECT w.frame, b.r, CASE WHEN len(list_filter(w.kept, lambda o: greatest(least(o.x2, b.x2) - greatest(o.x1, b.x1) + 1, 0) * greatest(least(o.y2, b.y2) - greatest(o.y1, b.y1) + 1, 0)
    / ((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1)) > 0.5e0)) > 0 THEN w.kept ELSE list_append(w.kept, {'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'det': b.det}) END
  FROM walk w JOIN ranked b ON b.frame = w.frame AND b.r = w.r + 1),
ends AS (SELECT frame, arg_max(kept, r) AS kept FROM walk GROUP BY frame), out_ AS (SELECT frame, unnest(kept) AS k FROM ends)
SELECT frame, k.det AS det FROM out_""",
    "coco_annotations": E5 + " SELECT row_number() OVER (ORDER BY frame, gt) - 1 AS id, frame AS image_id, CASE cls WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS category_id, CAST(difficult AS INTEGER) AS iscrowd, x2 - x1 AS w, (x2 - x1) * (y2 - y1) - 10e0 AS area FROM truth",
    "coco_results": E5 + " SELECT frame AS image_id, CASE cls WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS category_id, x1 AS x, y2 - y1 AS h, conf AS score FROM found",
    "image_lists": """WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 10000) / 10000e0 AS v FROM orders),
d AS (SELECT id, CASE WHEN v >= 0.95e0 THEN 'test' WHEN v >= 0.95e0 * 0.95e0 THEN 'val' ELSE 'train' END AS part FROM p),
l AS (SELECT part AS list, id FROM d UNION ALL SELECT 'trainval', id FROM d WHERE part <> 'test') SELECT list, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM l GROUP BY list""",
    "mosaic_boxes": WITH_BOXES + """ SELECT frame, det, CASE WHEN frame % 4 IN (2, 3) AND x1 <= 300 AND x2 >= 300 THEN 300e0 ELSE x1 END AS mx1, CASE WHEN frame % 4 IN (1, 2) AND y1 <= 200 AND y2 >= 200 THEN 200e0 ELSE y1 END AS my1,
  CASE WHEN frame % 4 IN (0, 1) AND x1 <= 300 AND x2 >= 300 THEN 300e0 ELSE x2 END AS mx2, CASE WHEN frame % 4 IN (0, 3) AND y1 <= 200 AND y2 >= 200 THEN 200e0 ELSE y2 END AS my2
  FROM boxes WHERE (CASE WHEN frame % 4 IN (0, 1) THEN x1 <= 300 ELSE x2 >= 300 END) AND (CASE WHEN frame % 4 IN (0, 3) THEN y1 <= 200 ELSE y2 >= 200 END)""",
    "rescaled_boxes": WITH_BOXES + """, h AS (SELECT frame, det, x1 / 2 - 200 AS a, y1 / 2 + 20 AS b, x2 / 2 - 200 AS c, y2 / 2 + 20 AS d FROM boxes),
m AS (SELECT frame, det, CASE WHEN frame % 2 = 1 THEN 640 - c ELSE a END AS a, b, CASE WHEN frame % 2 = 1 THEN 640 - a ELSE c END AS c, d FROM h),
k AS (SELECT frame, det, greatest(a, 0e0) AS rx1, greatest(b, 0e0) AS ry1, least(c, 640e0) AS rx2, least(d, 400e0) AS ry2 FROM m) SELECT * FROM k WHERE rx2 - rx1 > 1 AND ry2 - ry1 > 1""",
    "packed_vectors": POINTS + """, o AS (SELECT *, arg_min({'t': tick, 'x': x, 'y': y}, tick) OVER (PARTITION BY id ORDER BY tick RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS old FROM points)
SELECT id, tick, round(coalesce((x - old.x) / (tick - old.t), 0), 3) AS vx, round(coalesce((y - old.y) / (tick - old.t), 0), 3) AS vy, CAST((32767 * ((id % 1000) * (id % 1000) - id % 1000 + 1)) % 255 AS INTEGER) AS green FROM o""",
}
