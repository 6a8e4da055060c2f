"""SQL of queries whose result depends on the order of steps: recursions that take one step of every key at a time."""

from __future__ import annotations

from scantable.plans.evidence import IOU, PAIRS
from scantable.plans.registry import recursive, state, suppression
from scantable.plans.scalars import QUALITY
from scantable.plans.structure import RANKED
from scantable.plans.tracks import MEMBERS
from scantable.plans.views import with_views


SEEDS = PAIRS + RANKED + ", rows AS (SELECT scene_name, candidate_id AS id, n, class_id, score FROM s)"

state("n1_mask_suppression", recursive("cand pts", SEEDS + ", pair AS (SELECT scene_name, a, b FROM pairs WHERE iou > 0.5)" + suppression("scene_name", "score DESC, id") + " SELECT scene_name, id AS candidate_id, score FROM kept JOIN rows USING (scene_name, id)"))
state("n4_duplicate_removal", recursive("cand pts", SEEDS + ", pair AS (SELECT scene_name, a, b FROM pairs WHERE iou >= 0.6 OR containment >= 0.8)" + suppression("scene_name", "score DESC, n DESC, id") + " SELECT scene_name, id AS candidate_id FROM kept"))
state("n3_box_suppression", recursive("obs", f""", rows AS (SELECT scene_name, frame_index, observation_id AS id, score FROM obs WHERE class_id IS NOT NULL AND score IS NOT NULL AND frame_index IS NOT NULL AND scene_name IS NOT NULL),
    pair AS (SELECT a.scene_name, a.frame_index, a.observation_id AS a, b.observation_id AS b FROM obs a JOIN obs b ON a.scene_name = b.scene_name AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND a.observation_id < b.observation_id WHERE a.score IS NOT NULL AND b.score IS NOT NULL AND {IOU} >= 0.3)""" + suppression("scene_name, frame_index", "score DESC, id") + " SELECT id AS observation_id FROM kept"))
state("n14_capped_suppression", recursive("cand pts", PAIRS + RANKED + """, rows AS (SELECT scene_name, candidate_id AS id, class_id, score FROM s WHERE class_id IS NOT NULL), pair AS (SELECT p.scene_name, p.a, p.b FROM pairs p JOIN rows x ON x.scene_name = p.scene_name AND x.id = p.a JOIN rows y ON y.scene_name = p.scene_name AND y.id = p.b WHERE iou > 0.5 AND x.class_id = y.class_id)"""
    + suppression("scene_name", "score DESC, id") + """, f AS (SELECT r.*, row_number() OVER (PARTITION BY scene_name, class_id ORDER BY score DESC, id) AS p FROM kept JOIN rows r USING (scene_name, id)), g AS (SELECT *, row_number() OVER (PARTITION BY scene_name ORDER BY score DESC, id) AS q FROM f WHERE p <= 10) SELECT scene_name, id AS candidate_id, class_id FROM g WHERE q <= 50"""))

# the state of a scene: the proposals so far, each a struct of name, class and points
state("n6_absorb", recursive("cand pts", PAIRS + RANKED + """, q AS (SELECT s.scene_name, s.candidate_id AS id, s.class_id AS c, v.items, row_number() OVER (PARTITION BY s.scene_name ORDER BY s.candidate_id) AS i FROM s JOIN (SELECT scene_name, candidate_id, list(item ORDER BY item) AS items FROM pts GROUP BY 1, 2) v USING (scene_name, candidate_id) WHERE class_id IS NOT NULL),
    w AS (SELECT DISTINCT scene_name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS proposal, CAST([] AS STRUCT(name BIGINT, c INT, items BIGINT[])[]) AS held FROM q UNION ALL
        SELECT scene_name, i, id, CASE WHEN best >= 0.5 THEN held[pos].name ELSE id END, CASE WHEN best >= 0.5 THEN list_transform(held, lambda p, n: CASE WHEN n = pos THEN struct_pack(name := p.name, c := p.c, items := list_distinct(p.items || items)) ELSE p END) ELSE list_append(held, struct_pack(name := id, c := c, items := items)) END
        FROM (SELECT *, list_position(fit, best) AS pos FROM (SELECT *, coalesce(list_max(fit), 0) AS best FROM (SELECT w.scene_name, q.i, q.id, q.c, q.items, w.held, list_transform(w.held, lambda p: CASE WHEN p.c = q.c THEN len(list_intersect(p.items, q.items)) / (len(p.items) + len(q.items) - len(list_intersect(p.items, q.items)))::DOUBLE ELSE 0 END) AS fit
            FROM w JOIN q ON q.scene_name = w.scene_name AND q.i = w.i + 1))))
    SELECT scene_name, id AS candidate_id, proposal FROM w WHERE i > 0"""))

state("f7_admission", recursive("cand", f""", q AS (SELECT scene_name, record_id, kind, class_id, score >= 0.2 AS ok, row_number() OVER (PARTITION BY scene_name ORDER BY round({QUALITY}, 9) DESC NULLS LAST, record_id) AS i FROM cand WHERE scene_name IS NOT NULL),
    w AS (SELECT DISTINCT scene_name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS decision, CAST([] AS VARCHAR[]) AS kinds, CAST([] AS VARCHAR[]) AS labels FROM q UNION ALL
        SELECT scene_name, i, record_id, decision, CASE WHEN decision = 'accepted' THEN list_append(kinds, k) ELSE kinds END, CASE WHEN decision = 'accepted' THEN list_append(labels, l) ELSE labels END FROM (SELECT w.scene_name, q.i, q.record_id, w.kinds, w.labels, coalesce(q.kind, '-') AS k, coalesce(CAST(q.class_id AS VARCHAR), '-') AS l,
            CASE WHEN len(list_filter(w.kinds, lambda x: x = coalesce(q.kind, '-'))) >= 30 THEN 'source_limit' WHEN len(list_filter(w.labels, lambda x: x = coalesce(CAST(q.class_id AS VARCHAR), '-'))) >= 5 THEN 'class_limit' WHEN NOT coalesce(q.ok, false) THEN 'rejected' ELSE 'accepted' END AS decision FROM w JOIN q ON q.scene_name = w.scene_name AND q.i = w.i + 1))
    SELECT scene_name, record_id, decision FROM w WHERE i > 0"""))

state("n13_accepted_frames", recursive("links obs", MEMBERS + """, k AS (SELECT * FROM m WHERE frame_index IS NOT NULL AND class_id IS NOT NULL), v AS (SELECT trace_id, class_id, sum(2 * coalesce(score, 0)) - count(*) AS worth FROM k GROUP BY 1, 2),
    q AS (SELECT trace_id, frame_index, list(struct_pack(c := class_id, v := worth)) AS new, row_number() OVER (PARTITION BY trace_id ORDER BY frame_index) AS i FROM (SELECT DISTINCT trace_id, frame_index, class_id FROM k) JOIN v USING (trace_id, class_id) GROUP BY 1, 2),
    w AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS frame_index, CAST(NULL AS BOOLEAN) AS accepted, CAST([] AS INT[]) AS chosen FROM q UNION ALL SELECT trace_id, i, frame_index, ok, CASE WHEN ok THEN chosen || list_transform(fresh, lambda x: x.c) ELSE chosen END FROM
        (SELECT *, coalesce(list_sum(list_transform(fresh, lambda x: x.v)), 0) > 0 AS ok FROM (SELECT w.trace_id, q.i, q.frame_index, w.chosen, list_filter(q.new, lambda x: NOT list_contains(w.chosen, x.c)) AS fresh FROM w JOIN q ON q.trace_id = w.trace_id AND q.i = w.i + 1)))
    SELECT trace_id, frame_index, accepted FROM w WHERE i > 0"""))

state("g11_density_clusters", recursive("vec", """, near AS (SELECT p.vec_id AS a, q.vec_id AS b FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id <> q.vec_id AND (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 <= CAST(0.06 AS DOUBLE) * CAST(0.06 AS DOUBLE)), core AS (SELECT a AS c FROM near GROUP BY 1 HAVING count(*) >= 4),
    e AS (SELECT a, b FROM near WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), w(v, g) AS (SELECT c, c FROM core UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.v WHERE w.g < e.b), k AS (SELECT v, min(g) AS g FROM w GROUP BY 1), r AS (SELECT near.a, min(k.g) AS g FROM near JOIN k ON k.v = near.b GROUP BY 1)
    SELECT vec_id, coalesce(k.g, r.g, -1) AS cluster FROM vec LEFT JOIN k ON k.v = vec_id LEFT JOIN r ON r.a = vec_id"""))

# the state of a label: the squared distance of each of its points to the nearest picked one
state("o13_farthest_points", recursive("vec", """, l AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids, list(x ORDER BY vec_id) AS xs, list(y ORDER BY vec_id) AS ys, list(z ORDER BY vec_id) AS zs FROM vec WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1),
    w AS (SELECT label, CAST(0 AS INT) AS step, CAST(1 AS BIGINT) AS pos, list_transform(range(1, len(ids) + 1), lambda i: (xs[i] - xs[1])**2 + (ys[i] - ys[1])**2 + (zs[i] - zs[1])**2) AS far FROM l UNION ALL
        SELECT label, step, pos, list_transform(range(1, len(ids) + 1), lambda i: least(far[i], (xs[i] - xs[pos])**2 + (ys[i] - ys[pos])**2 + (zs[i] - zs[pos])**2)) FROM (SELECT w.label, w.step + 1 AS step, CAST(list_position(w.far, list_max(w.far)) AS BIGINT) AS pos, w.far, l.* EXCLUDE (label) FROM w JOIN l USING (label) WHERE w.step + 1 < least(8, len(l.ids))))
    SELECT w.label, l.ids[pos] AS vec_id, step FROM w JOIN l USING (label)"""))

state("v10_scene_splits", """WITH s AS (SELECT DISTINCT scene_name FROM observations WHERE scene_name IS NOT NULL), p AS (SELECT scene_name, row_number() OVER (ORDER BY md5('17/' || scene_name), scene_name) AS p FROM s) SELECT scene_name, p <= 8 AS even_small, p <= 16 AS even_large, p > 16 AS odd_large FROM p WHERE p <= 32""")

state("v5_random_crop", with_views("vec", """, t AS (SELECT label, a AS attempt, arg_min(struct_pack(x := x, y := y, z := z), md5('1/' || a || '/' || vec_id)) AS c FROM vec, range(5) r(a) GROUP BY 1, 2), i AS (SELECT v.label, v.vec_id, t.attempt FROM vec v JOIN t ON t.label = v.label AND abs(v.x - c.x) <= 0.15 AND abs(v.y - c.y) <= 0.15 AND abs(v.z - c.z) <= 0.15),
    g AS (SELECT label, min(attempt) AS attempt FROM (SELECT label, attempt, count(*) AS n FROM i GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1) SELECT label, vec_id, CAST(attempt AS INT) AS attempt FROM i JOIN g USING (label, attempt)"""))

# eigenvalues of the covariance in closed form
state("geo_shape_features", with_views("vec", """, c AS (SELECT label, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM vec GROUP BY 1), m AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
    p AS (SELECT *, sqrt(((xx - q)**2 + (yy - q)**2 + (zz - q)**2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM m), t AS (SELECT *, acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / nullif(2 * s * s * s, 0)))) / 3 AS f FROM p),
    e AS (SELECT *, greatest(0, q + 2 * s * cos(f)) AS e1, greatest(0, q + 2 * s * cos(f + 2.0943951023931953::DOUBLE)) AS e3 FROM t), d AS (SELECT *, greatest(0, 3 * q - e1 - e3) AS e2, greatest(ex, 1e-6) AS wx, greatest(ey, 1e-6) AS wy, greatest(ez, 1e-6) AS wz FROM e)
    SELECT label, n, (e1 - e2) / e1 AS linearity, (e2 - e3) / e1 AS planarity, e3 / e1 AS scattering, sqrt(e3) AS residual, ex AS extent_x, ey AS extent_y, ez AS extent_z, greatest(wx, wy, wz) / least(wx, wy, wz) AS aspect, n / (wx * wy * wz) AS density FROM d"""))

state("p2_values", """WITH RECURSIVE t AS (SELECT payload_id, CAST(payload AS JSON) AS j FROM report_payloads WHERE json_valid(payload)), n AS (SELECT t.payload_id, x.id, x.parent, x.key, x.type, x.atom, x.fullkey, row_number() OVER (PARTITION BY t.payload_id ORDER BY x.id) - 1 AS node_id FROM t, json_tree(t.j) x),
    d AS (SELECT a.payload_id, a.node_id, coalesce(b.node_id, -1) AS parent_id, a.key, a.type, a.atom, b.type AS held, row_number() OVER (PARTITION BY a.payload_id, a.parent ORDER BY a.id) - 1 AS place, a.id, a.parent FROM n a LEFT JOIN n b ON b.payload_id = a.payload_id AND b.id = a.parent),
    w AS (SELECT payload_id, node_id, CAST(0 AS INT) AS depth FROM d WHERE parent_id = -1 UNION ALL SELECT d.payload_id, d.node_id, w.depth + 1 FROM w JOIN d ON d.payload_id = w.payload_id AND d.parent_id = w.node_id)
    SELECT payload_id, node_id, parent_id, depth, CASE WHEN held = 'OBJECT' THEN key END AS key, CAST(place AS INT) AS place, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN atom ->> '$' WHEN type NOT IN ('OBJECT', 'ARRAY') THEN CAST(atom AS VARCHAR) END AS value FROM d JOIN w USING (payload_id, node_id)""")

# the state of a scene: which of its traces are picked, and the observations they hold
state("o12_diverse_views", recursive("links", """, e AS (SELECT trace_id, max(coalesce(CASE WHEN NOT isnan(edge_score) THEN edge_score END, 0)) AS q FROM mask_graph_trace GROUP BY 1), t AS (SELECT scene_name, trace_id, list(observation_id ORDER BY observation_id) AS items FROM links GROUP BY 1, 2),
    l AS (SELECT scene_name, list(struct_pack(id := trace_id, q := q, items := items) ORDER BY trace_id) AS ts FROM t JOIN e USING (trace_id) GROUP BY 1),
    w AS (SELECT scene_name, CAST(-1 AS INT) AS step, CAST(NULL AS BIGINT) AS trace_id, CAST([] AS BIGINT[]) AS picked, CAST([] AS BIGINT[]) AS seen FROM l UNION ALL
        SELECT scene_name, step, ts[pos].id, list_append(picked, pos), list_distinct(seen || ts[pos].items) FROM (SELECT *, CAST(list_position(g, list_max(g)) AS BIGINT) AS pos FROM (SELECT w.scene_name, w.step + 1 AS step, l.ts, w.picked, w.seen, list_transform(l.ts, lambda t, i: CASE WHEN list_contains(w.picked, i) THEN CAST('-inf' AS DOUBLE) ELSE t.q + 0.5 * (len(t.items) - len(list_intersect(t.items, w.seen))) / len(t.items)::DOUBLE
            - 0.5 * coalesce(list_max(list_transform(w.picked, lambda j: len(list_intersect(t.items, l.ts[j].items)) / greatest(1, least(len(t.items), len(l.ts[j].items)))::DOUBLE)), 0) END) AS g FROM w JOIN l USING (scene_name) WHERE w.step + 1 < least(5, len(l.ts)))))
    SELECT scene_name, trace_id, step FROM w WHERE step >= 0"""))

# the state of a scene and class: its sets as they are by now, from the largest down
state("n10_containment", recursive("cand pts", PAIRS + RANKED + """, q AS (SELECT s.scene_name, s.class_id, list(struct_pack(id := s.candidate_id, s := s.score, items := v.items, was := 'kept') ORDER BY len(v.items) DESC, s.candidate_id) AS st FROM s JOIN (SELECT scene_name, candidate_id, list(item ORDER BY item) AS items FROM pts GROUP BY 1, 2) v USING (scene_name, candidate_id) WHERE class_id IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT scene_name, class_id, CAST(0 AS BIGINT) AS i, st FROM q UNION ALL SELECT scene_name, class_id, i, CASE WHEN len(held) = 0 THEN st ELSE list_transform(st, lambda o, n: CASE WHEN n = i THEN struct_pack(id := o.id, s := o.s, items := rest, was := CASE WHEN len(rest) >= 1 THEN 'carved' ELSE 'removed' END) ELSE o END) END
        FROM (SELECT *, list_filter(st[i].items, lambda x: NOT list_contains(held, x)) AS rest FROM (SELECT *, flatten(list_transform(list_filter(st, lambda o, n: n <> i AND o.was <> 'removed' AND len(o.items) > 0 AND len(st[i].items) >= len(o.items) * 2.0 AND len(list_intersect(st[i].items, o.items)) >= CAST(0.8 AS DOUBLE) * len(o.items) AND o.s >= st[i].s * 0.5), lambda o: o.items)) AS held
            FROM (SELECT scene_name, class_id, i + 1 AS i, st FROM w WHERE i < len(st))))),
    f AS (SELECT scene_name, class_id, unnest(arg_max(st, i)) AS r FROM w GROUP BY 1, 2) SELECT scene_name, class_id, r.id AS candidate_id, r.s AS score, CAST(len(r.items) AS INT) AS n_items, r.was AS outcome FROM f"""))

# the state: per fold the counts of its labels, and over all folds their sums and sums of squares
state("v9_stratified_folds", recursive("obs", """, c AS (SELECT scene_name, class_id, count(*) AS n FROM obs WHERE scene_name IS NOT NULL AND class_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT class_id, sum(n) AS total FROM c GROUP BY 1), s AS (SELECT list(CAST(1 / (total * 5)::DOUBLE AS DOUBLE) ORDER BY class_id) AS scale, count(*) AS m FROM k),
    v AS (SELECT g.scene_name, list(CAST(coalesce(c.n, 0) AS DOUBLE) ORDER BY k.class_id) AS need FROM (SELECT DISTINCT scene_name FROM c) g, k LEFT JOIN c ON c.scene_name = g.scene_name AND c.class_id = k.class_id GROUP BY 1),
    q AS (SELECT scene_name, need, row_number() OVER (ORDER BY list_sum(list_transform(need, lambda x: x * x)) / len(need) - (list_sum(need) / len(need)) ** 2 DESC, scene_name) AS i FROM v),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS scene_name, CAST(NULL AS BIGINT) AS fold, list_transform(range(5), lambda f: list_transform(range(m), lambda l: CAST(0 AS DOUBLE))) AS load, list_transform(range(m), lambda l: CAST(0 AS DOUBLE)) AS fs, list_transform(range(m), lambda l: CAST(0 AS DOUBLE)) AS sq FROM s UNION ALL
        SELECT i, scene_name, fold, list_transform(load, lambda o, f: CASE WHEN f = fold THEN list_transform(o, lambda x, l: x + need[l]) ELSE o END), list_transform(fs, lambda x, l: x + need[l]), list_transform(sq, lambda x, l: x + (2 * load[fold][l] + need[l]) * need[l])
        FROM (SELECT *, CAST(list_position(list_transform(spread, lambda x: x <= list_min(spread) * (1 + 1e-9) + 1e-12), true) AS BIGINT) AS fold FROM (SELECT q.i, q.scene_name, q.need, w.load, w.fs, w.sq,
            list_transform(w.load, lambda o: list_sum(list_transform(q.need, lambda x, l: sqrt(greatest(0, 5 * (w.sq[l] + (2 * o[l] + x) * x) - (w.fs[l] + x) ** 2)) * s.scale[l]))) AS spread FROM w JOIN q ON q.i = w.i + 1, s)))
    SELECT scene_name, CAST(fold - 1 AS INT) AS fold FROM w WHERE i > 0"""))

# the state of a label: the part of each node, the parts' sizes and largest inner edges; edges pass twice
state("g4_segmentation", recursive("vec", """, e AS (SELECT p.label, p.vec_id AS a, q.vec_id AS b, sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2) AS wt FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id < q.vec_id WHERE (p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2 <= CAST(0.08 AS DOUBLE) * CAST(0.08 AS DOUBLE)),
    n AS (SELECT label, list(DISTINCT v ORDER BY v) AS nodes FROM (SELECT label, a AS v FROM e UNION ALL SELECT label, b FROM e) GROUP BY 1), m AS (SELECT label, count(*) AS m FROM e GROUP BY 1),
    f AS (SELECT e.label, list_position(nodes, a) AS x, list_position(nodes, b) AS y, wt, row_number() OVER (PARTITION BY e.label ORDER BY wt, a, b) AS i FROM e JOIN n USING (label)), q AS (SELECT label, x, y, wt, i, true AS early FROM f UNION ALL SELECT label, x, y, wt, i + m, false FROM f JOIN m USING (label)),
    w AS (SELECT label, CAST(0 AS BIGINT) AS i, list_transform(range(1, len(nodes) + 1), lambda t: CAST(t AS BIGINT)) AS r, list_transform(nodes, lambda t: CAST(1 AS DOUBLE)) AS size, list_transform(nodes, lambda t: CAST(0 AS DOUBLE)) AS inn FROM n UNION ALL
        SELECT label, i, CASE WHEN yes THEN list_transform(r, lambda t: CASE WHEN t = high THEN low ELSE t END) ELSE r END, CASE WHEN yes THEN list_transform(size, lambda t, j: CASE WHEN j = low THEN size[low] + size[high] ELSE t END) ELSE size END, CASE WHEN yes THEN list_transform(inn, lambda t, j: CASE WHEN j = low THEN greatest(inn[low], inn[high], wt) ELSE t END) ELSE inn END
        FROM (SELECT *, low <> high AND CASE WHEN early THEN wt <= least(inn[low] + CAST(0.1 AS DOUBLE) / size[low], inn[high] + CAST(0.1 AS DOUBLE) / size[high]) ELSE least(size[low], size[high]) < 3 END AS yes
            FROM (SELECT w.label, q.i, w.r, w.size, w.inn, q.wt, q.early, least(w.r[q.x], w.r[q.y]) AS low, greatest(w.r[q.x], w.r[q.y]) AS high FROM w JOIN q ON q.label = w.label AND q.i = w.i + 1))),
    d AS (SELECT label, arg_max(r, i) AS r FROM w GROUP BY 1) SELECT d.label, unnest(nodes) AS node, unnest(list_transform(r, lambda t: nodes[t])) AS segment FROM d JOIN n USING (label)"""))

MERGED = PAIRS + RANKED + """, q AS (SELECT s.scene_name, s.class_id, list(struct_pack(id := s.candidate_id, items := v.items, members := [s.candidate_id]) ORDER BY {order}) AS st FROM s JOIN (SELECT scene_name, candidate_id, list(item ORDER BY item) AS items FROM pts GROUP BY 1, 2) v USING (scene_name, candidate_id) WHERE class_id IS NOT NULL AND len(v.items) >= {least} GROUP BY 1, 2),
    w AS (SELECT scene_name, class_id, CAST(0 AS BIGINT) AS i, st FROM q UNION ALL SELECT scene_name, class_id, i + 1, {joined} FROM (SELECT *, st[p.a].items AS x, st[p.b].items AS y, st[p.a].members || st[p.b].members AS m FROM (SELECT *, {pick} AS p FROM
        (SELECT *, list_filter(list_transform(flatten(list_transform(range(1, len(st) + 1), lambda a: list_transform(range(a + 1, len(st) + 1), lambda b: struct_pack(a := a, b := b)))), lambda z: struct_pack(a := z.a, b := z.b, iou := len(list_intersect(st[z.a].items, st[z.b].items)) / (len(st[z.a].items) + len(st[z.b].items) - len(list_intersect(st[z.a].items, st[z.b].items)))::DOUBLE)), lambda z: z.iou >= {threshold}) AS fits FROM w) WHERE len(fits) > 0))),
    f AS (SELECT scene_name, class_id, unnest(arg_max(st, i)) AS r FROM w GROUP BY 1, 2)"""
# the first pair in order goes into the better set
state("n7_merge_sets", recursive("cand pts", MERGED.format(order="s.score DESC, s.candidate_id", least=1, threshold=0.5, pick="fits[1]", joined="list_filter(list_transform(st, lambda o, n: CASE WHEN n = p.a THEN struct_pack(id := o.id, items := list_distinct(x || y), members := m) ELSE o END), lambda o, n: n <> p.b)")
    + " SELECT scene_name, class_id, r.id AS candidate_id, list_aggregate(list_sort(r.members), 'string_agg', ',') AS members, CAST(len(r.items) AS INT) AS n_items FROM f"))
# the best pair, of equal ones the latest, goes to the end of the list
state("n8_best_pairs", recursive("cand pts", MERGED.format(order="s.candidate_id", least=5, threshold="CAST(0.4 AS DOUBLE)", pick="list_reverse_sort(list_transform(fits, lambda z: struct_pack(iou := z.iou, a := z.a, b := z.b)))[1]", joined="list_append(list_filter(st, lambda o, n: n <> p.a AND n <> p.b), struct_pack(id := list_min(m), items := list_distinct(x || y), members := m))")
    + " SELECT scene_name, class_id, r.id AS candidate_id, list_aggregate(list_sort(r.members), 'string_agg', ',') AS members, CAST(len(r.items) AS INT) AS n_items FROM f"))

# the state of a scene: its clusters, and in which of the two passes each node is
FITS = "list_filter(list_transform({w}.cl, lambda c: struct_pack(n := CASE WHEN list_has_any({q}.bad, c.members) THEN 0 ELSE len(list_intersect({q}.good, c.members)) END, name := c.name)), lambda f: f.n >= 1)"
state("g8_constrained_clusters", recursive("links obs", """, s AS (SELECT DISTINCT l.scene_name, l.trace_id, l.observation_id AS id, o.frame_index AS f FROM links l JOIN obs o USING (observation_id)),
    e AS (SELECT scene_name, a, b, max(CAST(c AS INT)) = 1 AS conflict FROM (SELECT x.scene_name, x.id AS a, y.id AS b, x.f IS NOT DISTINCT FROM y.f AS c FROM s x JOIN s y ON x.scene_name = y.scene_name AND x.trace_id = y.trace_id AND x.id < y.id) GROUP BY 1, 2, 3),
    u AS (SELECT scene_name, a AS id, b AS o, conflict FROM e UNION ALL SELECT scene_name, b, a, conflict FROM e), g AS (SELECT scene_name, id, list(o) FILTER (WHERE NOT conflict) AS good, list(o) FILTER (WHERE conflict) AS bad FROM u GROUP BY 1, 2),
    n AS (SELECT DISTINCT s.scene_name, s.id, coalesce(o.score, 0) AS q FROM s JOIN obs o ON o.observation_id = s.id), q AS (SELECT n.scene_name, n.id, coalesce(good, []) AS good, coalesce(bad, []) AS bad, row_number() OVER (PARTITION BY n.scene_name ORDER BY q DESC, n.id) AS i, ceil(count(*) OVER (PARTITION BY n.scene_name) * CAST(0.3 AS DOUBLE)) AS seeds FROM n LEFT JOIN g USING (scene_name, id)),
    w AS (SELECT DISTINCT scene_name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cluster, false AS late, CAST([] AS STRUCT(name BIGINT, members BIGINT[])[]) AS cl FROM q UNION ALL
        SELECT scene_name, i, id, CASE WHEN k = 1 THEN one WHEN k = 0 AND seed THEN id END, k > 1, CASE WHEN k = 1 THEN list_transform(cl, lambda c: CASE WHEN c.name = one THEN struct_pack(name := c.name, members := list_append(c.members, id)) ELSE c END) WHEN k = 0 AND seed THEN list_append(cl, struct_pack(name := id, members := [id])) ELSE cl END
        FROM (SELECT *, len(fits) AS k, fits[1].name AS one FROM (SELECT w.scene_name, q.i, q.id, q.i <= greatest(1, q.seeds) AS seed, w.cl, """ + FITS.format(w="w", q="q") + """ AS fits FROM w JOIN q ON q.scene_name = w.scene_name AND q.i = w.i + 1))),
    last AS (SELECT scene_name, arg_max(cl, i) AS cl FROM w GROUP BY 1), r AS (SELECT w.scene_name, w.id, q.good, q.bad, row_number() OVER (PARTITION BY w.scene_name ORDER BY NOT w.late, w.i) AS i FROM w JOIN q USING (scene_name, id) WHERE w.id IS NOT NULL AND w.cluster IS NULL),
    v AS (SELECT scene_name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cluster, cl FROM last UNION ALL
        SELECT scene_name, i, id, to_, CASE WHEN to_ IS NULL THEN cl ELSE list_transform(cl, lambda c: CASE WHEN c.name = to_ THEN struct_pack(name := c.name, members := list_append(c.members, id)) ELSE c END) END FROM (SELECT *, CASE WHEN len(fits) = 1 THEN fits[1].name WHEN len(fits) > 1 AND fits[1].n > fits[2].n THEN fits[1].name END AS to_
            FROM (SELECT v.scene_name, r.i, r.id, v.cl, list_sort(""" + FITS.format(w="v", q="r") + """, 'DESC') AS fits FROM v JOIN r ON r.scene_name = v.scene_name AND r.i = v.i + 1)))
    SELECT scene_name, id AS observation_id, cluster FROM w WHERE id IS NOT NULL AND cluster IS NOT NULL UNION ALL SELECT scene_name, id, cluster FROM v WHERE id IS NOT NULL"""))
