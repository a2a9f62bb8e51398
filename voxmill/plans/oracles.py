"""The registered queries as DuckDB SQL over the same tables.

Shared parts are common table expressions; ``_sql`` lists those a query needs.
"""

from __future__ import annotations

from .. import params

_P = params.PRESETS["production"]
_D = params.PRESETS["default"]

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], body: str) -> None:
    _CTES[name] = (needs, body)


def _sql(needs: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in _CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    parts = [_CTES[n][1] for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- inputs

_cte("grains", (), """grains AS MATERIALIZED (
  SELECT CAST(floor(p_partkey/32.0) AS INT) AS vol_id, CAST(p_partkey % 32 AS INT)+1 AS g,
         CAST((p_partkey*7+3)%24 AS INT) AS cz, CAST((p_partkey*11+5)%24 AS INT) AS cy,
         CAST((p_partkey*17+1)%24 AS INT) AS cx, 3+CAST(p_size%4 AS INT) AS r FROM part)""")
_cte("vols", ("grains",), "vols AS MATERIALIZED (SELECT DISTINCT vol_id, 24 AS depth, 24 AS height, 24 AS width FROM grains)")
_cte("voxels", ("grains", "vols"), """cov AS (
  SELECT g.vol_id, z.z, y.y, x.x, g.g, g.r, x.x-g.cx AS dx,
         (z.z-g.cz)*(z.z-g.cz)+(y.y-g.cy)*(y.y-g.cy)+(x.x-g.cx)*(x.x-g.cx) AS d2
  FROM grains g JOIN range(24) z(z) ON abs(z.z-g.cz) <= g.r
                JOIN range(24) y(y) ON abs(y.y-g.cy) <= g.r
                JOIN range(24) x(x) ON abs(x.x-g.cx) <= g.r
  WHERE (z.z-g.cz)*(z.z-g.cz)+(y.y-g.cy)*(y.y-g.cy)+(x.x-g.cx)*(x.x-g.cx) <= g.r*g.r),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vol_id,z,y,x ORDER BY d2,g) AS rn FROM cov) t WHERE rn=1),
voxels AS MATERIALIZED (
  SELECT v.vol_id, CAST(z.z AS INT) AS z, CAST(y.y AS INT) AS y, CAST(x.x AS INT) AS x,
    CAST(CASE WHEN b.g IS NULL THEN 30 WHEN 9*b.d2 <= b.r*b.r THEN 20 ELSE 170 END
      + (x.x*7+y.y*13+z.z*29+v.vol_id*31)%41 AS INT) AS gray,
    COALESCE(b.g,0) AS gt_id,
    CASE WHEN b.g IS NULL OR b.g%11=0 OR b.d2>(b.r*b.r-1) THEN 0
         WHEN b.g%5=0 AND b.dx>=0 THEN b.g+100
         WHEN b.g%7=0 THEN b.g-2 ELSE b.g END AS pred_id,
    CASE WHEN 9*b.d2 <= b.r*b.r THEN b.g ELSE 0 END AS marker_id,
    CASE WHEN 9*b.d2 <= b.r*b.r OR (b.g IS NULL AND (x.x+2*y.y+3*z.z)%97=0) THEN 1 ELSE 0 END AS seed
  FROM vols v CROSS JOIN range(24) z(z) CROSS JOIN range(24) y(y) CROSS JOIN range(24) x(x)
  LEFT JOIN best b ON v.vol_id=b.vol_id AND z.z=b.z AND y.y=b.y AND x.x=b.x)""")
_cte("results", (), """results AS MATERIALIZED (
SELECT concat('scan_', CAST(CAST(floor(p_partkey/18.0) AS INT) AS VARCHAR)) AS scan,
       concat('crop0', CAST(CAST(floor(p_partkey/3.0) AS INT)%6 + 2 AS VARCHAR)) AS crop_id,
       CASE p_partkey%3 WHEN 0 THEN 'mintree_ws' WHEN 1 THEN 'otsu_ws' ELSE 'refined_ws' END AS method,
       CAST(100+p_size AS INT) AS gt_valid, CAST(100+(p_partkey*13)%40 AS INT) AS pred_labels,
       ((p_partkey*7)%51+50)/CAST(100 AS DOUBLE) AS precision050, ((p_partkey*11)%51+50)/CAST(100 AS DOUBLE) AS recall050,
       ((p_partkey*17)%51+50)/CAST(100 AS DOUBLE) AS f1050, CAST((p_partkey*19)%60 AS INT) AS fp050,
       CAST((p_partkey*23)%90 AS INT) AS fn050, (80+(p_partkey*29)%60)/CAST(100 AS DOUBLE) AS overseg_ratio FROM part)""")
_cte("axis", (), "axis AS (SELECT CAST(range AS INT) AS s FROM range(-12, 13))")

_FACE = "({0}z IN (0,23) OR {0}y IN (0,23) OR {0}x IN (0,23))"


def _digest(rel: str, value: str | None = None) -> str:
    extra = ""
    if value:
        extra = f", CAST(sum({value}) AS BIGINT) AS sum_v, CAST(sum(CAST({value} AS BIGINT)*(x+1)) AS BIGINT) AS sum_vx"
    return f"SELECT vol_id, z, y, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x{extra} FROM {rel} GROUP BY vol_id, z, y"


# ---------------------------------------------------------------- intensity parts

_cte("hist", ("voxels",), "hist AS MATERIALIZED (SELECT vol_id, gray AS value, count(*) AS n FROM voxels GROUP BY vol_id, gray)")
_cte("otsu", ("hist",), """otsu AS MATERIALIZED (
  SELECT vol_id, CAST(arg_max(value, (sigma, -value)) AS INT) AS otsu FROM (
    SELECT vol_id, value, (mt*w-m)*(mt*w-m)/(w*(1-w)) AS sigma FROM (
      SELECT vol_id, value, below/total AS w, mass/total AS m, total_mass/total AS mt FROM (
        SELECT vol_id, value,
          CAST(sum(n) OVER (PARTITION BY vol_id ORDER BY value) AS DOUBLE) AS below,
          CAST(sum(n*value) OVER (PARTITION BY vol_id ORDER BY value) AS DOUBLE) AS mass,
          CAST(sum(n) OVER (PARTITION BY vol_id) AS DOUBLE) AS total,
          CAST(sum(n*value) OVER (PARTITION BY vol_id) AS DOUBLE) AS total_mass
        FROM hist))
    WHERE w*(1-w) > 1e-12) GROUP BY vol_id)""")

_cte("limits", ("voxels", "otsu"), f"""limits AS MATERIALIZED (
  SELECT o.vol_id, CAST(floor(least(greatest(least(otsu + ({_P.dark.otsu_offset}), pval, {_P.dark.threshold_max}), 1), 255)) AS INT) AS threshold,
         otsu, pval
  FROM otsu o JOIN (SELECT vol_id, quantile_cont(gray, {_P.dark.percentile / 100}) AS pval FROM voxels WHERE gray > 0 GROUP BY vol_id) p
    ON o.vol_id = p.vol_id)""")
_cte("dark", ("voxels", "limits"), "dark AS MATERIALIZED (SELECT v.vol_id, z, y, x FROM voxels v JOIN limits l ON v.vol_id=l.vol_id WHERE gray <= threshold)")
_cte("fg", ("voxels", "otsu"), """fg AS MATERIALIZED (SELECT v.vol_id, z, y, x FROM voxels v JOIN otsu o ON v.vol_id=o.vol_id
  WHERE gray >= CAST(floor(least(greatest(otsu - 10.0, 0), 255)) AS INT))""")

# ---------------------------------------------------------------- topology parts

for _k in (1, 2, 3):
    _cte(f"steps{_k}", ("axis",), f"""steps{_k} AS MATERIALIZED (SELECT a.s AS dz, b.s AS dy, c.s AS dx FROM axis a, axis b, axis c
  WHERE greatest(abs(a.s), abs(b.s), abs(c.s)) = 1 AND abs(a.s)+abs(b.s)+abs(c.s) <= {_k})""")


def _reach(name: str, mask: str) -> str:
    """Mask voxels connected by faces to mask voxels on the volume border."""
    return f"""{name} AS (
  SELECT vol_id, z, y, x FROM {mask} WHERE {_FACE.format('')}
  UNION
  SELECT m.vol_id, m.z, m.y, m.x FROM {name} e CROSS JOIN steps1 s
    JOIN {mask} m ON m.vol_id=e.vol_id AND m.z=e.z+s.dz AND m.y=e.y+s.dy AND m.x=e.x+s.dx)"""


_cte("ext", ("dark", "steps1"), _reach("ext", "dark"))
_cte("internal", ("dark", "ext"), "internal AS MATERIALIZED (SELECT * FROM dark ANTI JOIN ext USING (vol_id, z, y, x))")


def _components(name: str, mask: str, steps: str) -> str:
    """Smallest raster position reachable, then numbered 1..n per volume."""
    return f"""{name}_cc(vol_id, z, y, x, root) USING KEY (vol_id, z, y, x) AS (
  SELECT vol_id, z, y, x, (z*24+y)*24+x FROM {mask}
  UNION
  SELECT d.vol_id, d.z, d.y, d.x, min(e.root)
  FROM {name}_cc e CROSS JOIN {steps} s
    JOIN recurring.{name}_cc d ON d.vol_id=e.vol_id AND d.z=e.z+s.dz AND d.y=e.y+s.dy AND d.x=e.x+s.dx
  WHERE e.root < d.root GROUP BY d.vol_id, d.z, d.y, d.x),
{name} AS MATERIALIZED (SELECT vol_id, z, y, x, dense_rank() OVER (PARTITION BY vol_id ORDER BY root) AS component FROM {name}_cc)"""


_cte("seedmask", ("voxels",), "seedmask AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE seed = 1)")
_cte("mixmask", ("voxels",), "mixmask AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE seed = 1 OR gray >= 205)")
_cte("predmask", ("voxels",), "predmask AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE pred_id > 0)")
_cte("gtmask", ("voxels",), "gtmask AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE gt_id > 0)")
_cte("markmask", ("voxels",), "markmask AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE marker_id > 0)")
_cte("markinside", ("voxels",), "markinside AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE marker_id > 0 AND pred_id > 0)")
_cte("seedc", ("seedmask", "steps1"), _components("seedc", "seedmask", "steps1"))
_cte("mixc18", ("mixmask", "steps2"), _components("mixc18", "mixmask", "steps2"))
_cte("mixc26", ("mixmask", "steps3"), _components("mixc26", "mixmask", "steps3"))
_cte("predc", ("predmask", "steps1"), _components("predc", "predmask", "steps1"))
_cte("markc", ("markmask", "steps1"), _components("markc", "markmask", "steps1"))
_cte("insidec", ("markinside", "steps1"), _components("insidec", "markinside", "steps1"))
_cte("cores", ("internal", "steps1"), _components("cores", "internal", "steps1"))


def _component_rows(rel: str) -> str:
    return f"""SELECT vol_id, component, count(*) AS area, CAST(sum(z) AS BIGINT) AS sum_z, CAST(sum(y) AS BIGINT) AS sum_y
FROM {rel} GROUP BY vol_id, component"""


def _ball(radius: int) -> str:
    return f"(SELECT a.s AS dz, b.s AS dy, c.s AS dx FROM axis a, axis b, axis c WHERE a.s*a.s+b.s*b.s+c.s*c.s <= {radius * radius})"


def _dilated(name: str, mask: str, radius: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT m.vol_id, m.z+o.dz AS z, m.y+o.dy AS y, m.x+o.dx AS x
  FROM {mask} m CROSS JOIN {_ball(radius)} o
  WHERE m.z+o.dz BETWEEN 0 AND 23 AND m.y+o.dy BETWEEN 0 AND 23 AND m.x+o.dx BETWEEN 0 AND 23)"""


def _eroded(name: str, mask: str, radius: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT m.vol_id, m.z+o.dz AS z, m.y+o.dy AS y, m.x+o.dx AS x
  FROM {mask} m CROSS JOIN {_ball(radius)} o
  WHERE m.z+o.dz BETWEEN 0 AND 23 AND m.y+o.dy BETWEEN 0 AND 23 AND m.x+o.dx BETWEEN 0 AND 23
  GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {_ball(radius)}))"""


_cte("markgrown2", ("markmask", "axis"), _dilated("markgrown2", "markmask", 2))
_cte("markgrown1", ("markmask", "axis"), _dilated("markgrown1", "markmask", 1))
_cte("gteroded", ("gtmask", "axis"), _eroded("gteroded", "gtmask", 1))
for _r in (1, 2):
    _cte(f"predgrown{_r}", ("predmask", "axis"), _dilated(f"predgrown{_r}", "predmask", _r))
    _cte(f"predclosed{_r}", (f"predgrown{_r}",), _eroded(f"predclosed{_r}", f"predgrown{_r}", _r))

# ---------------------------------------------------------------- Gaussian parts


def _fold(name: str, sigma: float) -> str:
    radius = int(4.0 * sigma + 0.5)
    return f"""{name}_taps AS (SELECT k, exp(-0.5*(k/{sigma}::DOUBLE)*(k/{sigma}::DOUBLE)) AS w FROM range(-{radius}, {radius + 1}) t(k)),
{name} AS MATERIALIZED (SELECT i, j, sum(w) AS w FROM (
  SELECT i, CASE WHEN m < 24 THEN m ELSE 47 - m END AS j, w/(SELECT sum(w) FROM {name}_taps) AS w FROM (
    SELECT i, (((i + k) % 48) + 48) % 48 AS m, w FROM range(24) r(i) CROSS JOIN {name}_taps)) GROUP BY i, j)"""


def _smooth(name: str, source: str, axis: str, fold: str) -> str:
    keys = [k for k in ("z", "y", "x") if k != axis]
    at = ", ".join("f.i AS " + k if k == axis else "s." + k for k in ("z", "y", "x"))
    return f"""{name} AS MATERIALIZED (SELECT s.vol_id, {at}, CAST(sum(f.w * s.v) AS FLOAT) AS v
  FROM {source} s JOIN {fold} f ON f.j = s.{axis} GROUP BY s.vol_id, s.{keys[0]}, s.{keys[1]}, f.i)"""


_cte("fold15", (), _fold("fold15", 15.0))
_cte("fold3", (), _fold("fold3", 3.0))
_cte("fold1", (), _fold("fold1", 1.5))
_cte("grayf", ("voxels",), "grayf AS (SELECT vol_id, z, y, x, CAST(gray AS FLOAT) AS v FROM voxels)")
_cte("bg", ("grayf", "fold15"), _smooth("bg_y", "grayf", "y", "fold15") + ",\n" + _smooth("bg", "bg_y", "x", "fold15"))
_cte("bg3", ("grayf", "fold3", "fold1"), ",\n".join([
    _smooth("bg3_z", "grayf", "z", "fold1"), _smooth("bg3_y", "bg3_z", "y", "fold3"), _smooth("bg3", "bg3_y", "x", "fold3")]))
_cte("bgref", ("bg",), """bgref AS MATERIALIZED (SELECT vol_id, CAST(quantile_cont(CAST(v AS DOUBLE), 0.5) AS FLOAT) AS bg_ref
  FROM bg WHERE v > 0 GROUP BY vol_id)""")
_cte("flat", ("voxels", "bg", "bgref"), """flatraw AS MATERIALIZED (
  SELECT v.vol_id, v.z, v.y, v.x, greatest(CAST(v.gray AS FLOAT) - b.v + r.bg_ref, CAST(0 AS FLOAT)) AS v
  FROM voxels v JOIN bg b ON v.vol_id=b.vol_id AND v.z=b.z AND v.y=b.y AND v.x=b.x JOIN bgref r ON r.vol_id=v.vol_id),
flatends AS (SELECT vol_id, quantile_cont(CAST(v AS DOUBLE), 0.005) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.995) AS hi
  FROM flatraw WHERE v > 0 GROUP BY vol_id),
flat AS (SELECT f.vol_id, z, y, x, CAST(floor(least(greatest((v - CAST(lo AS FLOAT)) * CAST(255 AS FLOAT)
    / CAST(CASE WHEN hi <= lo THEN 1 ELSE hi - lo END AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INT) AS v
  FROM flatraw f JOIN flatends e ON f.vol_id = e.vol_id)""")

# ---------------------------------------------------------------- feature parts


def _centroids(rel: str) -> str:
    def at(c: str) -> str:
        return f"CAST(least(greatest(round_even(avg({c}), 0), 0), 23) AS INT) AS c{c}"

    return f"""SELECT vol_id, component, count(*) AS area, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1,
  min(x) AS x0, max(x) AS x1, {at('z')}, {at('y')}, {at('x')} FROM {rel} GROUP BY vol_id, component"""


def _sampled(name: str, points: str) -> str:
    """Centre and ring means and ring coverage by the external mask."""
    s = _P.sampling
    i2, o2 = s.ring_inner**2, s.ring_outer**2
    return f"""{name}_c AS MATERIALIZED (SELECT vol_id, component, avg(gray) AS center_mean
  FROM (SELECT vol_id, component, cz+dz AS z, cy+dy AS y, cx+dx AS x FROM {points} CROSS JOIN {_ball(s.center_radius)})
  JOIN voxels USING (vol_id, z, y, x) GROUP BY vol_id, component),
{name}_r AS MATERIALIZED (SELECT vol_id, component, avg(gray) AS ring_mean, avg(outer_) AS ring_external_cov
  FROM (SELECT vol_id, component, cz AS z, cy+dy AS y, cx+dx AS x FROM {points}
    CROSS JOIN (SELECT b.s AS dy, c.s AS dx FROM axis b, axis c WHERE b.s*b.s+c.s*c.s > {i2} AND b.s*b.s+c.s*c.s <= {o2}))
  JOIN (SELECT vol_id, z, y, x, gray, CASE WHEN e.outer_ IS NULL THEN 0 ELSE 1 END AS outer_
    FROM voxels LEFT JOIN (SELECT *, 1 AS outer_ FROM ext) e USING (vol_id, z, y, x)) USING (vol_id, z, y, x) GROUP BY vol_id, component),
{name}_m AS MATERIALIZED (SELECT p.*, center_mean, ring_mean, ring_external_cov
  FROM {points} p JOIN {name}_c USING (vol_id, component) JOIN {name}_r USING (vol_id, component)),
{name} AS MATERIALIZED (SELECT *, ring_mean - center_mean AS ring_contrast,
    (ring_mean - center_mean) + greatest(0, {params.SCORE_REFERENCE} - center_mean) * {params.SCORE_WEIGHT} AS score FROM {name}_m)"""


_cte("grainvox", ("voxels",), "grainvox AS MATERIALIZED (SELECT vol_id, z, y, x, gt_id AS component FROM voxels WHERE gt_id > 0)")
_cte("points", ("grainvox",), f"points AS MATERIALIZED ({_centroids('grainvox')})")
_cte("sampled", ("points", "voxels", "ext", "axis"), _sampled("sampled", "points"))
_cte("seedpoints", ("seedc",), f"seedpoints AS MATERIALIZED ({_centroids('seedc')})")
_cte("seedsampled", ("seedpoints", "voxels", "ext", "axis"), _sampled("seedsampled", "seedpoints"))
_cte("corepoints", ("cores",), f"corepoints AS MATERIALIZED ({_centroids('cores')})")
_cte("coresampled", ("corepoints", "voxels", "ext", "axis"), _sampled("coresampled", "corepoints"))


def _shares(name: str, rel: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c.vol_id, c.component, avg(CASE WHEN e.vol_id IS NULL THEN 0 ELSE 1 END) AS external_overlap,
    avg(CASE WHEN i.vol_id IS NULL THEN 0 ELSE 1 END) AS internal_overlap
  FROM {rel} c LEFT JOIN ext e USING (vol_id, z, y, x) LEFT JOIN internal i USING (vol_id, z, y, x) GROUP BY c.vol_id, c.component)"""


def _near(name: str, points: str, radius: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vol_id, component, min(d2) AS d2
  FROM (SELECT vol_id, component, cz+a.s AS z, cy+b.s AS y, cx+c.s AS x, a.s*a.s+b.s*b.s+c.s*c.s AS d2
    FROM {points}, axis a, axis b, axis c WHERE greatest(abs(a.s), abs(b.s), abs(c.s)) <= {radius})
  JOIN internal USING (vol_id, z, y, x) GROUP BY vol_id, component)"""


_cte("grainshares", ("grainvox", "ext", "internal"), _shares("grainshares", "grainvox"))
_cte("seedshares", ("seedc", "ext", "internal"), _shares("seedshares", "seedc"))
_cte("grainnear", ("points", "internal", "axis"), _near("grainnear", "points", 3))

# ---------------------------------------------------------------- cascade parts


def _seed_judged(name: str, rules) -> str:
    return _near(f"{name}_near", "seedpoints", rules.internal_search_radius) + f""",
{name}_all AS MATERIALIZED (SELECT s.*, h.external_overlap, h.internal_overlap, n.d2
  FROM seedsampled s JOIN seedshares h USING (vol_id, component) LEFT JOIN {name}_near n USING (vol_id, component)),
{name} AS MATERIALIZED (SELECT *, sqrt(d2) AS internal_dist,
  concat('', CASE WHEN area < {rules.area_min} OR area > {rules.area_max} THEN 'seed_area'
       WHEN external_overlap > {rules.max_external_overlap} THEN 'external_background'
       WHEN internal_overlap < {rules.min_internal_overlap} AND d2 IS NULL THEN 'not_internal_dark'
       WHEN center_mean > {rules.center_dark_max} THEN 'center_not_dark'
       WHEN ring_contrast < {rules.min_ring_contrast} THEN 'low_ring_contrast'
       WHEN ring_external_cov > {rules.max_ring_external_coverage} THEN 'ring_too_external'
       ELSE 'candidate' END) AS reason FROM {name}_all)"""


_cte("seedjudged", ("seedsampled", "seedshares", "seedpoints", "internal", "axis"), _seed_judged("seedjudged", _P.seeds))
_cte("seedjudged_default", ("seedsampled", "seedshares", "seedpoints", "internal", "axis"),
     _seed_judged("seedjudged_default", _D.seeds))

# The marker rules the marker queries use (tightened so that every rule fires).
_M = {"area_min": 1, "area_max": 900, "max_dim": 30, "max_elongation": 3.0, "min_fill": 0.005,
      "center": 150.0, "contrast": -2.0}
def _core_judged(m: dict) -> str:
    return f"""corejudged AS MATERIALIZED (SELECT *,
  concat('', CASE WHEN area < {m['area_min']} OR area > {m['area_max']} THEN 'area'
       WHEN greatest(dz, dy, dx) > {m['max_dim']} OR elongation > {m['max_elongation']} OR fill < {m['min_fill']} THEN 'shape'
       WHEN center_mean > {m['center']} THEN 'center'
       WHEN ring_contrast < {m['contrast']} THEN 'contrast' ELSE 'candidate' END) AS reason
  FROM (SELECT *, greatest(dz, dy, dx)/greatest(1, least(dz, dy, dx))::DOUBLE AS elongation, area/(dz*dy*dx)::DOUBLE AS fill
    FROM (SELECT *, z1-z0+1 AS dz, y1-y0+1 AS dy, x1-x0+1 AS dx FROM coresampled)))"""


_cte("corejudged", ("coresampled",), _core_judged(_M))


def _greedy(name: str, judged: str, order: str, min_dist: float, cap: int) -> str:
    """One candidate per step and volume, against the list of kept positions."""
    full = f"len(g.kept) >= {cap}" if cap else "false"
    return f"""{name}_q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY {order}) AS rn
  FROM {judged} WHERE reason = 'candidate'),
{name}_g AS (
  SELECT DISTINCT vol_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(z INT, y INT, x INT)[]) AS kept, CAST([] AS BIGINT[]) AS ids FROM {name}_q
  UNION ALL
  SELECT g.vol_id, q.rn,
    CASE WHEN {full} OR len(list_filter(g.kept, lambda k: (k.z-q.cz)*(k.z-q.cz)+(k.y-q.cy)*(k.y-q.cy)+(k.x-q.cx)*(k.x-q.cx) < {min_dist * min_dist})) > 0
         THEN g.kept ELSE list_append(g.kept, {{'z': q.cz, 'y': q.cy, 'x': q.cx}}) END,
    CASE WHEN {full} OR len(list_filter(g.kept, lambda k: (k.z-q.cz)*(k.z-q.cz)+(k.y-q.cy)*(k.y-q.cy)+(k.x-q.cx)*(k.x-q.cx) < {min_dist * min_dist})) > 0
         THEN g.ids ELSE list_append(g.ids, q.component) END
  FROM {name}_g g JOIN {name}_q q ON q.vol_id = g.vol_id AND q.rn = g.rn + 1),
{name} AS MATERIALIZED (SELECT vol_id, unnest(ids) AS component, unnest(range(1, len(ids)+1)) AS new_label FROM (
  SELECT vol_id, arg_max(ids, rn) AS ids FROM {name}_g GROUP BY vol_id))"""


_cte("seedkept", ("seedjudged",), _greedy(
    "seedkept", "seedjudged", "internal_overlap DESC, ring_contrast DESC, area, component", _P.seeds.nms_min_dist, 0))
_cte("corekept", ("corejudged",), _greedy(
    "corekept", "corejudged", "score DESC, area, elongation, component", _P.markers.nms_min_dist, 0))
# The same with the cap of the registered c4: the first ten of each volume.
_cte("corecapped", ("corekept",), "corecapped AS (SELECT * FROM corekept WHERE new_label <= 10)")


def _tallies(judged: str, kept: str, names: tuple[str, ...]) -> str:
    listed = ", ".join(f"('{n}')" for n in (*names, "candidate", "keep", "rejected_nms"))
    return f"""SELECT v.vol_id, r.reason, CAST(COALESCE(n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT vol_id FROM {judged}) v CROSS JOIN (VALUES {listed}) r(reason)
LEFT JOIN (
  SELECT vol_id, reason, count(*) AS n FROM {judged} GROUP BY vol_id, reason
  UNION ALL SELECT vol_id, 'keep', count(*) FROM {kept} GROUP BY vol_id
  UNION ALL SELECT j.vol_id, 'rejected_nms', count(*) FROM {judged} j ANTI JOIN {kept} USING (vol_id, component)
    WHERE j.reason = 'candidate' GROUP BY j.vol_id) c ON c.vol_id = v.vol_id AND c.reason = r.reason"""


# ---------------------------------------------------------------- evaluation parts

_cte("gts", ("voxels",), f"""gts AS MATERIALIZED (SELECT vol_id, gt_id, count(*) AS gt_voxels, bool_or({_FACE.format('')}) AS on_border
  FROM voxels WHERE gt_id > 0 GROUP BY vol_id, gt_id)""")
_cte("preds", ("voxels",), "preds AS MATERIALIZED (SELECT vol_id, pred_id, count(*) AS pred_voxels FROM voxels WHERE pred_id > 0 GROUP BY vol_id, pred_id)")
_cte("pairs", ("voxels", "gts", "preds"), """pairs AS MATERIALIZED (SELECT p.*, gt_voxels, pred_voxels,
    i/(gt_voxels+pred_voxels-i)::DOUBLE AS iou, 2*i/(gt_voxels+pred_voxels)::DOUBLE AS dice
  FROM (SELECT vol_id, gt_id, pred_id, count(*) AS i FROM voxels WHERE gt_id > 0 AND pred_id > 0 GROUP BY vol_id, gt_id, pred_id) p
  JOIN gts USING (vol_id, gt_id) JOIN preds USING (vol_id, pred_id))""")
_cte("strict", ("gts",), "strict AS MATERIALIZED (SELECT *, gt_voxels >= 20 AND NOT on_border AS valid FROM gts)")
_cte("loose", ("gts",), "loose AS MATERIALIZED (SELECT *, gt_voxels >= 20 AS valid FROM gts)")
_cte("detailed", ("gts",), "detailed AS MATERIALIZED (SELECT *, gt_voxels >= 1 AS valid FROM gts)")


def _judged(name: str, truth: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT p.*, CAST(COALESCE(v, 0) AS BIGINT) AS valid_overlap, CAST(COALESCE(g, 0) AS BIGINT) AS ignored_overlap,
    COALESCE(g, 0) <= COALESCE(v, 0) AS evaluable
  FROM preds p LEFT JOIN (SELECT vol_id, pred_id, sum(CASE WHEN valid THEN i ELSE 0 END) AS v, sum(CASE WHEN valid THEN 0 ELSE i END) AS g
    FROM pairs JOIN {truth} USING (vol_id, gt_id) GROUP BY vol_id, pred_id) USING (vol_id, pred_id))"""


_cte("strictpreds", ("pairs", "preds", "strict"), _judged("strictpreds", "strict"))
_cte("loosepreds", ("pairs", "preds", "loose"), _judged("loosepreds", "loose"))


def _eligible(name: str, truth: str, preds: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a.vol_id, a.gt_id, a.pred_id, a.iou FROM pairs a
  JOIN {truth} t USING (vol_id, gt_id) JOIN {preds} q USING (vol_id, pred_id) WHERE t.valid AND q.evaluable)"""


_cte("strictpairs", ("pairs", "strict", "strictpreds"), _eligible("strictpairs", "strict", "strictpreds"))
_cte("loosepairs", ("pairs", "loose", "loosepreds"), _eligible("loosepairs", "loose", "loosepreds"))

_cte("metrics", ("strict", "strictpreds", "strictpairs"), """metrics AS MATERIALIZED (
  SELECT vol_id, threshold, gt_valid, pred_total, pred_eval, pred_total - pred_eval AS pred_ignored_border, tp,
    pred_eval - tp AS fp, gt_valid - tp AS fn, p AS precision, r AS recall,
    CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0 END AS f1,
    CASE WHEN gt_valid > 0 THEN pred_eval/gt_valid::DOUBLE ELSE 0 END AS overseg_ratio_pred_eval_gt
  FROM (SELECT *, CASE WHEN pred_eval > 0 THEN tp/pred_eval::DOUBLE ELSE 0 END AS p, CASE WHEN gt_valid > 0 THEN tp/gt_valid::DOUBLE ELSE 0 END AS r
    FROM (SELECT COALESCE(a.vol_id, b.vol_id) AS vol_id, t.threshold, CAST(COALESCE(gt_valid, 0) AS BIGINT) AS gt_valid, COALESCE(pred_total, 0) AS pred_total,
            CAST(COALESCE(pred_eval, 0) AS BIGINT) AS pred_eval,
            (SELECT count(*) FROM strictpairs s WHERE s.vol_id = COALESCE(a.vol_id, b.vol_id) AND s.iou >= t.threshold) AS tp
      FROM (SELECT vol_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS gt_valid FROM strict GROUP BY vol_id) a
      FULL JOIN (SELECT vol_id, count(*) AS pred_total, sum(CASE WHEN evaluable THEN 1 ELSE 0 END) AS pred_eval FROM strictpreds GROUP BY vol_id) b
        ON a.vol_id = b.vol_id
      CROSS JOIN (VALUES (0.60::DOUBLE), (0.75::DOUBLE)) t(threshold))))""")

_cte("bestgt", ("pairs", "detailed"), """bestgt AS MATERIALIZED (SELECT t.vol_id, t.gt_id, COALESCE(iou, 0) AS iou, pred_id
  FROM detailed t LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vol_id, gt_id ORDER BY iou DESC, pred_id) = 1) b
    USING (vol_id, gt_id) WHERE valid)""")
_cte("fgcounts", ("voxels",), """fgcounts AS MATERIALIZED (SELECT vol_id, count(*) FILTER (gt_id > 0) AS foreground_gt_voxels,
    count(*) FILTER (pred_id > 0) AS foreground_pred_voxels, count(*) FILTER (gt_id > 0 AND pred_id > 0) AS foreground_intersection
  FROM voxels GROUP BY vol_id)""")
_cte("fgover", ("fgcounts",), """fgover AS MATERIALIZED (SELECT *,
    round(foreground_intersection/(foreground_gt_voxels+foreground_pred_voxels-foreground_intersection)::DOUBLE, 9) AS foreground_iou,
    round(2*foreground_intersection/(foreground_gt_voxels+foreground_pred_voxels)::DOUBLE, 9) AS foreground_dice,
    round(CASE WHEN foreground_pred_voxels > 0 THEN foreground_intersection/foreground_pred_voxels::DOUBLE ELSE 0 END, 9) AS foreground_precision,
    round(CASE WHEN foreground_gt_voxels > 0 THEN foreground_intersection/foreground_gt_voxels::DOUBLE ELSE 0 END, 9) AS foreground_recall
  FROM fgcounts)""")
_cte("markercounts", ("voxels",), """markercounts AS MATERIALIZED (SELECT vol_id, count(DISTINCT marker_id) AS marker_components,
    count(*) FILTER (gt_id > 0) AS marker_voxels_on_gt, count(*) FILTER (gt_id = 0) AS marker_voxels_on_background
  FROM voxels WHERE marker_id > 0 GROUP BY vol_id)""")

# ---------------------------------------------------------------- comparison parts

_AVERAGED = ", ".join(params.AVERAGED_METRICS)
_cte("grouped", ("results",), """grouped AS MATERIALIZED (SELECT 'ALL' AS "group", * FROM results UNION ALL SELECT scan, * FROM results)""")
_cte("stats", ("grouped",), f"""stats AS MATERIALIZED (
  SELECT "group", method, metric, avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, COALESCE(stddev_samp(v), 0) AS std
  FROM (UNPIVOT (SELECT "group", method, {_AVERAGED} FROM grouped) ON {_AVERAGED} INTO NAME metric VALUE v) GROUP BY "group", method, metric)""")
_cte("totals", ("grouped",), """totals AS MATERIALIZED (
  SELECT "group", method, 'total_fp' AS metric, CAST(sum(fp050) AS DOUBLE) AS mean FROM grouped GROUP BY "group", method
  UNION ALL SELECT "group", method, 'total_fn', CAST(sum(fn050) AS DOUBLE) FROM grouped GROUP BY "group", method)""")


_SUMMARY_NAMES = (
    "gt_total_ids_touching_crop", "gt_valid_ids_after_filter", "gt_border_ids_ignored_if_enabled",
    "gt_min_area_filter", "ignore_gt_border", "pred_label_count", "foreground_gt_voxels",
    "foreground_pred_voxels", "foreground_intersection", "foreground_iou", "foreground_dice",
    "foreground_precision", "foreground_recall", "marker_components", "marker_voxels_on_gt",
    "marker_voxels_on_background",
)


def _summary() -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT vol_id, {i} AS position, '{n}' AS metric, round(CAST(COALESCE({n}, 0) AS DOUBLE), 9) AS value FROM base"
        for i, n in enumerate(_SUMMARY_NAMES)
    )
    recall = "\nUNION ALL ".join(
        f"""SELECT vol_id, {len(_SUMMARY_NAMES) + 2 * i}, 'gt_object_recall_iou_{t}', round(avg(CASE WHEN pred_id IS NOT NULL AND iou >= {t} THEN 1 ELSE 0 END), 9) FROM bestgt GROUP BY vol_id
UNION ALL SELECT vol_id, {len(_SUMMARY_NAMES) + 2 * i + 1}, 'gt_matched_count_iou_{t}', CAST(sum(CASE WHEN pred_id IS NOT NULL AND iou >= {t} THEN 1 ELSE 0 END) AS DOUBLE) FROM bestgt GROUP BY vol_id"""
        for i, t in enumerate((0.1, 0.25, 0.5))
    )
    return rows + "\nUNION ALL " + recall


_cte("base", ("detailed", "preds", "fgover", "markercounts"), """base AS MATERIALIZED (
  SELECT vol_id, gt_total_ids_touching_crop, gt_valid_ids_after_filter, 0 AS gt_border_ids_ignored_if_enabled, 1 AS gt_min_area_filter,
    0 AS ignore_gt_border, pred_label_count, f.* EXCLUDE (vol_id), marker_components, marker_voxels_on_gt, marker_voxels_on_background
  FROM fgover f LEFT JOIN (SELECT vol_id, count(*) AS gt_total_ids_touching_crop, count(*) FILTER (valid) AS gt_valid_ids_after_filter FROM detailed GROUP BY vol_id) USING (vol_id)
  LEFT JOIN (SELECT vol_id, count(*) AS pred_label_count FROM preds GROUP BY vol_id) USING (vol_id)
  LEFT JOIN markercounts USING (vol_id))""")


def _crop_row(source: str, names: str) -> str:
    return f"""SELECT scan, crop_id, method, gt_valid, pred_labels, pred_eval, pred_labels - pred_eval AS pred_ignored,
  round(p, 9) AS precision050, round(r, 9) AS recall050, round(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0 END, 9) AS f1050,
  pred_eval - tp AS fp050, gt_valid - tp AS fn050, round(CASE WHEN gt_valid > 0 THEN pred_eval/gt_valid::DOUBLE ELSE 0 END, 9) AS overseg_ratio
FROM (SELECT *, CASE WHEN pred_eval > 0 THEN tp/pred_eval::DOUBLE ELSE 0 END AS p, CASE WHEN gt_valid > 0 THEN tp/gt_valid::DOUBLE ELSE 0 END AS r,
  {names} FROM {source})"""


def _distance_sql(name: str, inside: str) -> str:
    """Squared distance to the outside of ``inside`` by three one-axis minima over whole lines."""
    return f"""{name}_v AS MATERIALIZED (SELECT vol_id, z, y, x, CASE WHEN {inside} THEN 1000000 ELSE 0 END AS d FROM voxels),
{name}_x AS MATERIALIZED (SELECT a.vol_id, a.z, a.y, a.x, min(b.d + (a.x-b.x)*(a.x-b.x)) AS d FROM {name}_v a JOIN {name}_v b ON a.vol_id=b.vol_id AND a.z=b.z AND a.y=b.y GROUP BY ALL),
{name}_y AS MATERIALIZED (SELECT a.vol_id, a.z, a.y, a.x, min(b.d + (a.y-b.y)*(a.y-b.y)) AS d FROM {name}_x a JOIN {name}_x b ON a.vol_id=b.vol_id AND a.z=b.z AND a.x=b.x GROUP BY ALL),
{name} AS MATERIALIZED (SELECT a.vol_id, a.z, a.y, a.x, min(b.d + (a.z-b.z)*(a.z-b.z)) AS d2 FROM {name}_y a JOIN {name}_y b ON a.vol_id=b.vol_id AND a.y=b.y AND a.x=b.x GROUP BY ALL)"""


_cte("dist", ("voxels",), _distance_sql("dist", "gt_id > 0"))
_cte("notfg", ("voxels", "fg"), "notfg AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels ANTI JOIN fg USING (vol_id, z, y, x))")
_cte("outside", ("notfg", "steps1"), _reach("outside", "notfg"))



def _flooded(name: str, markers: str, dist: str = "dist") -> str:
    """Labels of the spanning forest from the markers, over edges ranked by weight.

    b is the smallest possible largest rank on a path to a marker.  A voxel hangs on the
    edge of that rank, on the end whose own b is smaller, and so on to a marker.
    """
    return f"""{name}_n AS MATERIALIZED (SELECT vol_id, z, y, x, (z*24+y)*24+x AS p, d2 FROM {dist} WHERE d2 > 0),
{name}_e AS MATERIALIZED (SELECT vol_id, lo, hi, row_number() OVER (PARTITION BY vol_id ORDER BY -least(da, db), -greatest(da, db), lo, hi) AS r FROM (
  SELECT a.vol_id, a.p AS lo, b.p AS hi, a.d2 AS da, b.d2 AS db FROM (SELECT *, unnest([0, 0, 1]) AS dz, unnest([0, 1, 0]) AS dy, unnest([1, 0, 0]) AS dx FROM {name}_n) a
  JOIN {name}_n b ON b.vol_id = a.vol_id AND b.z = a.z + a.dz AND b.y = a.y + a.dy AND b.x = a.x + a.dx)),
{name}_s AS MATERIALIZED (SELECT vol_id, lo AS p, hi AS q, r FROM {name}_e UNION ALL SELECT vol_id, hi, lo, r FROM {name}_e),
{name}_m AS MATERIALIZED (SELECT n.vol_id, p, component AS label FROM {markers} m JOIN {name}_n n USING (vol_id, z, y, x)),
{name}_b(vol_id, p, r) USING KEY (vol_id, p) AS (
  SELECT n.vol_id, n.p, CASE WHEN m.p IS NULL THEN 1000000000 ELSE 0 END FROM {name}_n n LEFT JOIN {name}_m m ON m.vol_id = n.vol_id AND m.p = n.p
  UNION
  SELECT s.vol_id, s.q, min(greatest(b.r, s.r)) FROM {name}_b b JOIN {name}_s s ON s.vol_id = b.vol_id AND s.p = b.p
    JOIN recurring.{name}_b d ON d.vol_id = s.vol_id AND d.p = s.q WHERE greatest(b.r, s.r) < d.r GROUP BY s.vol_id, s.q),
{name}_f AS MATERIALIZED (SELECT * FROM {name}_b),
{name}_u AS MATERIALIZED (SELECT v.vol_id, v.p, CASE WHEN a.r < v.r THEN e.lo ELSE e.hi END AS w FROM {name}_f v
  JOIN {name}_e e ON e.vol_id = v.vol_id AND e.r = v.r JOIN {name}_f a ON a.vol_id = e.vol_id AND a.p = e.lo WHERE v.r > 0),
{name} AS (SELECT vol_id, p, CAST(label AS BIGINT) AS label FROM {name}_m
  UNION ALL SELECT u.vol_id, u.p, l.label FROM {name} l JOIN {name}_u u ON u.vol_id = l.vol_id AND u.w = l.p)"""


_cte("markgt", ("voxels",), "markgt AS MATERIALIZED (SELECT vol_id, z, y, x FROM voxels WHERE marker_id > 0 AND gt_id > 0)")
_cte("markgtc", ("markgt", "steps1"), _components("markgtc", "markgt", "steps1"))
_cte("flooded", ("dist", "markgtc"), _flooded("flooded", "markgtc"))

# Voxels that no neighbour exceeds, thinned greedily by distance, then numbered.
def _tops(name: str, dist: str) -> str:
    return f"""{name}_h AS MATERIALIZED (SELECT DISTINCT a.vol_id, a.z, a.y, a.x
  FROM (SELECT vol_id, z, y, x, d2, z+dz AS nz, y+dy AS ny, x+dx AS nx FROM {dist} CROSS JOIN steps3 WHERE d2 > 0) a
  JOIN {dist} b ON b.vol_id=a.vol_id AND b.z=a.nz AND b.y=a.ny AND b.x=a.nx WHERE b.d2 > a.d2),
{name} AS MATERIALIZED (SELECT vol_id, CAST(z AS INT) AS cz, CAST(y AS INT) AS cy, CAST(x AS INT) AS cx, d2, (z*24+y)*24+x AS component, 'candidate' AS reason
  FROM {dist} ANTI JOIN {name}_h USING (vol_id, z, y, x) WHERE d2 > 0)"""


_cte("tops", ("dist", "steps3"), _tops("tops", "dist"))
_cte("peaks", ("tops",), _greedy("peaks", "tops", "d2 DESC, component", float(_P.peak_min_distance), 0))

# The threshold baseline: threshold, close, distance, peaks, flood.
_FX = params.PRESETS["fixture"]
_cte("fggrown", ("fg", "axis"), _dilated("fggrown", "fg", _FX.flood.close_radius))
_cte("fgclosed", ("fggrown",), _eroded("fgclosed", "fggrown", _FX.flood.close_radius))
_cte("fgdist", ("voxels", "fgclosed"), _distance_sql("fgdist", "(vol_id, z, y, x) IN (SELECT vol_id, z, y, x FROM fgclosed)"))
_cte("fgtops", ("fgdist", "steps3"), _tops("fgtops", "fgdist"))
_cte("fgpeaks", ("fgtops",), _greedy("fgpeaks", "fgtops", "d2 DESC, component", float(_FX.peak_min_distance), 0))
_cte("fgmarks", ("fgtops", "fgpeaks"), """fgmarks AS MATERIALIZED (SELECT vol_id, cz AS z, cy AS y, cx AS x, row_number() OVER (PARTITION BY vol_id ORDER BY component) AS component
  FROM fgtops JOIN fgpeaks USING (vol_id, component))""")
_cte("fgflooded", ("fgdist", "fgmarks"), _flooded("fgflooded", "fgmarks", "fgdist"))


def _segmentation() -> str:
    """The whole job: flatten, find and judge dark cores on the flat gray, flood the original gray from them."""
    import re

    rules = _FX.markers
    limits = {"area_min": rules.area_min, "area_max": rules.area_max, "max_dim": rules.max_dim, "max_elongation": rules.max_elongation,
              "min_fill": rules.min_fill, "center": rules.center_dark_max, "contrast": rules.min_ring_contrast}
    chain = ("hist", "otsu", "limits", "dark", "ext", "internal", "cores", "corepoints", "coresampled")
    inner = re.compile(r"\b(" + "|".join((*chain, "cores_cc", "corejudged", "voxels")) + r")\b")
    flat = lambda text: inner.sub(lambda m: "flatvox" if m[0] == "voxels" else "p_" + m[0], text)
    parts = [_sql(("flat", "steps1", "fgclosed"), "").rstrip(),
             "flatvox AS MATERIALIZED (SELECT o.* REPLACE (f.v AS gray) FROM voxels o JOIN flat f USING (vol_id, z, y, x))",
             *(flat(_CTES[n][1]) for n in chain), flat(_core_judged(limits)),
             _greedy("p_kept", "p_corejudged", "score DESC, area, elongation, component", rules.nms_min_dist, 0),
             "p_marks AS MATERIALIZED (SELECT vol_id, z, y, x FROM p_cores SEMI JOIN p_kept USING (vol_id, component))",
             _dilated("p_grown", "p_marks", _FX.flood.force_radius),
             "p_mask AS MATERIALIZED (SELECT vol_id, z, y, x FROM fgclosed UNION SELECT vol_id, z, y, x FROM p_grown)",
             "p_in AS MATERIALIZED (SELECT * FROM p_marks SEMI JOIN p_mask USING (vol_id, z, y, x))",
             _components("p_inc", "p_in", "steps1"),
             _distance_sql("p_dist", "(vol_id, z, y, x) IN (SELECT vol_id, z, y, x FROM p_mask)"),
             _flooded("p_flood", "p_inc", "p_dist")]
    return ",\n".join(parts) + f"""
SELECT vol_id, row_number() OVER (PARTITION BY vol_id ORDER BY old) AS label, voxels
FROM (SELECT vol_id, label AS old, count(*) AS voxels FROM p_flood GROUP BY vol_id, label HAVING count(*) >= {_FX.min_label_size})"""


# Optimal matching by exhaustion: within each knot of the overlap graph, true
# instances are placed one after another; of all ways that use the same
# predictions only the best total goes on.
_cte("optimum", ("loosepairs", "loose"), """knot(vol_id, gt_id, root) USING KEY (vol_id, gt_id) AS (
  SELECT DISTINCT vol_id, gt_id, gt_id FROM loosepairs
  UNION
  SELECT d.vol_id, d.gt_id, min(e.root) FROM knot e
    JOIN loosepairs p ON p.vol_id=e.vol_id AND p.gt_id=e.gt_id JOIN loosepairs q ON q.vol_id=p.vol_id AND q.pred_id=p.pred_id
    JOIN recurring.knot d ON d.vol_id=q.vol_id AND d.gt_id=q.gt_id WHERE e.root < d.root GROUP BY d.vol_id, d.gt_id),
turn AS MATERIALIZED (SELECT vol_id, gt_id, root, row_number() OVER (PARTITION BY vol_id, root ORDER BY gt_id) AS rn FROM knot),
options AS MATERIALIZED (SELECT vol_id, root, rn, gt_id, pred_id, iou, CAST(floor(iou * 1152921504606846976.0::DOUBLE) AS HUGEINT) * 1152921504606846976::HUGEINT
    + CAST('0x' || substr(md5(CAST(gt_id AS VARCHAR) || ':' || CAST(pred_id AS VARCHAR)), 1, 10) AS BIGINT) + 1 AS weight FROM turn JOIN loosepairs USING (vol_id, gt_id)
  UNION ALL SELECT vol_id, root, rn, gt_id, NULL, 0, 0 FROM turn),
ways AS (
  SELECT DISTINCT vol_id, root, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(0 AS HUGEINT) AS total, CAST([] AS DOUBLE[]) AS ious,
    CAST([] AS STRUCT(g BIGINT, p BIGINT, iou DOUBLE)[]) AS picks FROM turn
  UNION ALL
  SELECT vol_id, root, rn, used, max(total), arg_max(ious, total), arg_max(picks, total) FROM (
    SELECT w.vol_id, w.root, o.rn, CASE WHEN o.pred_id IS NULL THEN w.used ELSE list_sort(list_append(w.used, CAST(o.pred_id AS BIGINT))) END AS used,
      w.total + o.weight AS total, CASE WHEN o.pred_id IS NULL THEN w.ious ELSE list_append(w.ious, o.iou) END AS ious,
      CASE WHEN o.pred_id IS NULL THEN w.picks ELSE list_append(w.picks, {'g': CAST(o.gt_id AS BIGINT), 'p': CAST(o.pred_id AS BIGINT), 'iou': o.iou}) END AS picks
    FROM ways w JOIN options o ON o.vol_id=w.vol_id AND o.root=w.root AND o.rn=w.rn+1
    WHERE o.pred_id IS NULL OR NOT list_contains(w.used, CAST(o.pred_id AS BIGINT))) GROUP BY vol_id, root, rn, used),
optimum AS MATERIALIZED (SELECT w.vol_id, w.root, arg_max(ious, total) AS ious, arg_max(picks, total) AS picks FROM ways w
  JOIN (SELECT vol_id, root, max(rn) AS rn FROM turn GROUP BY vol_id, root) l ON l.vol_id=w.vol_id AND l.root=w.root AND l.rn=w.rn
  GROUP BY w.vol_id, w.root)""")


def _batch(source: str) -> str:
    """Crop rows at 0.50 for predictions, markers and the truth itself, from the exhaustive matching; every crop has its three rows."""
    matched = _CTES["optimum"][1].replace("loosepairs", "kpairs")
    return _sql(("voxels",), "").rstrip() + f""",
source AS MATERIALIZED ({source}),
keyed AS MATERIALIZED (SELECT vol_id*3+m AS k, vol_id, z, y, x, gt_id, p
  FROM (SELECT *, unnest([0,1,2]) AS m, unnest([pred_id, marker_id, gt_id]) AS p FROM source)),
kg AS MATERIALIZED (SELECT k, gt_id, n, valid FROM (SELECT k, gt_id, count(*) AS n, count(*) >= 20 AND NOT bool_or(z IN (0,23) OR y IN (0,23) OR x IN (0,23)) AS valid
  FROM keyed WHERE gt_id > 0 GROUP BY k, gt_id)),
kp AS MATERIALIZED (SELECT k, p, count(*) AS n FROM keyed WHERE p > 0 GROUP BY k, p),
ki AS MATERIALIZED (SELECT k, gt_id, p, count(*) AS i FROM keyed WHERE gt_id > 0 AND p > 0 GROUP BY k, gt_id, p),
ke AS MATERIALIZED (SELECT kp.k, kp.p, kp.n, COALESCE(sum(CASE WHEN valid THEN i ELSE 0 END), 0) >= COALESCE(sum(CASE WHEN valid THEN 0 ELSE i END), 0) AS evaluable
  FROM kp LEFT JOIN ki ON ki.k=kp.k AND ki.p=kp.p LEFT JOIN kg ON kg.k=ki.k AND kg.gt_id=ki.gt_id GROUP BY kp.k, kp.p, kp.n),
kpairs AS MATERIALIZED (SELECT ki.k AS vol_id, ki.gt_id, ki.p AS pred_id, i/(kg.n+ke.n-i)::DOUBLE AS iou FROM ki JOIN kg ON kg.k=ki.k AND kg.gt_id=ki.gt_id
  JOIN ke ON ke.k=ki.k AND ke.p=ki.p WHERE valid AND evaluable),
{matched},
kt AS MATERIALIZED (SELECT vol_id AS k, CAST(sum(len(list_filter(ious, lambda v: v >= 0.5))) AS BIGINT) AS tp FROM optimum GROUP BY vol_id),
km AS MATERIALIZED (SELECT l.k, CAST(COALESCE(gt_valid,0) AS BIGINT) AS gt_valid, CAST(COALESCE(pred_total,0) AS BIGINT) AS pred_labels, CAST(COALESCE(pred_eval,0) AS BIGINT) AS pred_eval,
    CAST(COALESCE(tp,0) AS BIGINT) AS tp
  FROM (SELECT DISTINCT vol_id*3+m AS k FROM (SELECT DISTINCT vol_id FROM source) CROSS JOIN (VALUES (0), (1), (2)) t(m)) l
  LEFT JOIN (SELECT k, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS gt_valid FROM kg GROUP BY k) a USING (k)
  LEFT JOIN (SELECT k, count(*) AS pred_total, sum(CASE WHEN evaluable THEN 1 ELSE 0 END) AS pred_eval FROM ke GROUP BY k) b USING (k)
  LEFT JOIN kt USING (k))
""" + _crop_row(
        "(SELECT *, k // 3 AS v FROM km)",
        "concat('scan_0', v % 2) AS scan, concat('crop', v) AS crop_id, CASE k % 3 WHEN 0 THEN 'mintree_ws' WHEN 1 THEN 'otsu_ws' ELSE 'refined_ws' END AS method")


def _published() -> str:
    """The metrics at 0.50 from the exhaustive matching of the strict pairs."""
    part = _CTES["optimum"][1].replace("loosepairs", "strictpairs")
    needs = _sql(("strict", "strictpreds", "strictpairs"), "").rstrip()
    return needs + ",\n" + part + """
SELECT vol_id, 0.5::DOUBLE AS threshold, gt_valid, pred_total, pred_eval, pred_total - pred_eval AS pred_ignored_border, tp, pred_eval - tp AS fp, gt_valid - tp AS fn,
  round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0 END, 9) AS f1,
  round(CASE WHEN gt_valid > 0 THEN pred_eval/gt_valid::DOUBLE ELSE 0 END, 9) AS overseg_ratio_pred_eval_gt
FROM (SELECT *, CASE WHEN pred_eval > 0 THEN tp/pred_eval::DOUBLE ELSE 0 END AS p, CASE WHEN gt_valid > 0 THEN tp/gt_valid::DOUBLE ELSE 0 END AS r
  FROM (SELECT vol_id, CAST(COALESCE(gt_valid, 0) AS BIGINT) AS gt_valid, COALESCE(pred_total, 0) AS pred_total,
          CAST(COALESCE(pred_eval, 0) AS BIGINT) AS pred_eval, COALESCE(tp, 0) AS tp
    FROM (SELECT vol_id, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS gt_valid FROM strict GROUP BY vol_id)
    FULL JOIN (SELECT vol_id, count(*) AS pred_total, sum(CASE WHEN evaluable THEN 1 ELSE 0 END) AS pred_eval FROM strictpreds GROUP BY vol_id) USING (vol_id)
    LEFT JOIN (SELECT vol_id, CAST(sum(len(list_filter(ious, lambda v: v >= 0.5))) AS BIGINT) AS tp FROM optimum GROUP BY vol_id) USING (vol_id)))"""


def _holed(query: str, keys: str, zeros: tuple[str, ...]) -> str:
    """A score over volumes of which some hold no truth, or no label at all; all are listed.

    ``keys`` is a relation of the rows that must be there.
    """
    import re

    head, body = query.removeprefix("WITH RECURSIVE ").split("\nSELECT ", 1)
    parts = re.split(r"(?=\bvoxels AS MATERIALIZED \()", head, maxsplit=1)
    end = _definition_end(parts[1])
    rest = re.sub(r"\bvoxels\b", "holed", parts[1][end:])
    holed = """,
holed AS MATERIALIZED (SELECT * REPLACE (CASE WHEN vol_id % 3 < 2 THEN 0 ELSE gt_id END AS gt_id,
  CASE WHEN vol_id % 3 = 0 THEN 0 ELSE pred_id END AS pred_id, CASE WHEN vol_id % 3 = 0 THEN 0 ELSE marker_id END AS marker_id) FROM voxels)"""
    score = "SELECT " + re.sub(r"\bvoxels\b", "holed", body)
    on = "USING (" + ", ".join(k.strip() for k in keys.split(",")) + ")"
    listed = "(SELECT DISTINCT vol_id FROM voxels)" + (
        " CROSS JOIN (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in ((0.60, 0.75) if "fp" in zeros else (0.10, 0.25, 0.50))) + ") t(threshold)" if "threshold" in keys else "")
    cells = ", ".join(f"COALESCE({z}, 0) AS {z}" for z in zeros)
    return f"WITH RECURSIVE {parts[0]}{parts[1][:end]}{holed}{rest},\nscore AS ({score})\nSELECT {keys}, {cells} FROM (SELECT * FROM {listed}) LEFT JOIN score {on}"


def _definition_end(text: str) -> int:
    """Position behind the bracket that closes the first definition."""
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == ")" and depth == 0:
            return k + 1
    raise ValueError("unbalanced definition")


ORACLES: dict[str, str] = {
    "s1_volume_scan": _sql(("voxels",), _digest("voxels", "gray")),
    "s1_slice_scan": _sql(("voxels",), _digest("(SELECT vol_id, 0 AS z, y, x, max(gray) AS gray FROM voxels GROUP BY vol_id, y, x)", "gray")),
    "s2_volume_catalog": _sql(("voxels",), "SELECT vol_id, max(z)+1 AS depth, max(y)+1 AS height, max(x)+1 AS width FROM voxels GROUP BY vol_id"),
    "s3_shape_check": _sql(("vols",), """SELECT vol_id, depth, height, width, depth+1 AS other_depth, height AS other_height, width AS other_width
FROM vols WHERE vol_id % 5 = 0"""),
    "s4_paired_crop": _sql(("voxels",), """SELECT crop_id, vol_id, z-cz AS z, y-cy AS y, count(*) AS n, CAST(sum(x-cx) AS BIGINT) AS sum_x,
  CAST(sum(gray) AS BIGINT) AS sum_gray, CAST(sum(gt_id) AS BIGINT) AS sum_gt
FROM voxels JOIN (VALUES ('crop02', 2, 4, 6, 12), ('crop03', 10, 0, 3, 10), ('crop04', 18, 16, 14, 12)) c(crop_id, cx, cy, cz, size)
  ON x BETWEEN cx AND cx+size-1 AND y BETWEEN cy AND cy+size-1 AND z BETWEEN cz AND cz+size-1 GROUP BY crop_id, vol_id, z-cz, y-cy"""),
    "s5_label_sink": _sql(("voxels",), """SELECT vol_id, count(*) AS n, CAST(sum(pred_id) AS BIGINT) AS sum_label, max(pred_id) AS max_label, 16 AS stored_bits
FROM voxels WHERE pred_id > 0 GROUP BY vol_id"""),
    "s6_report_sink": _sql(("voxels",), """SELECT CAST(vol_id AS VARCHAR) AS vol_id, CAST(gt_id AS VARCHAR) AS gt_id, CAST(pred_id AS VARCHAR) AS pred_id,
  CAST(count(*) AS VARCHAR) AS intersection_voxels FROM voxels WHERE gt_id > 0 AND pred_id > 0 GROUP BY voxels.vol_id, voxels.gt_id, voxels.pred_id"""),
    "s7_results_scan": _sql(("results",), "SELECT * FROM results"),
    "i1_percentile_pair": _sql(("voxels",), """SELECT vol_id, round(quantile_cont(gray, 0.005), 9) AS p_low, round(quantile_cont(gray, 0.995), 9) AS p_high
FROM voxels WHERE gray > 0 GROUP BY vol_id"""),
    "i1_percentile_float": _sql(("voxels",), """SELECT vol_id, round(quantile_cont(v, 0.005), 9) AS a, round(quantile_cont(v, 0.4), 9) AS b, round(quantile_cont(v, 0.995), 9) AS c
FROM (SELECT vol_id, gray*(x+1)/7.0::DOUBLE AS v FROM voxels) WHERE v > 0 GROUP BY vol_id"""),
    "i2_rescale_8bit": _sql(("voxels",), "SELECT * FROM (" + _digest("""(SELECT v.vol_id, z, y, x, CAST(floor(least(greatest(
  (CAST(gray AS FLOAT) - CAST(lo AS FLOAT)) * CAST(255 AS FLOAT) / CAST(hi - lo AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INT) AS gray
  FROM voxels v JOIN (SELECT vol_id, quantile_cont(gray, 0.005) AS lo, quantile_cont(gray, 0.995) AS hi FROM voxels WHERE gray > 0 GROUP BY vol_id) e
    ON e.vol_id = v.vol_id)""", "gray") + ")"),
    "i3_gaussian_slices": _sql(("bg",), """SELECT vol_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, round(sum(CAST(v AS DOUBLE)), 2) AS sum_bg,
  round(sum(CAST(v AS DOUBLE)*(x+1)), 2) AS sum_bgx FROM bg GROUP BY vol_id, z, y"""),
    "i4_gaussian_volume": _sql(("bg3",), """SELECT vol_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, round(sum(CAST(v AS DOUBLE)), 2) AS sum_bg,
  round(sum(CAST(v AS DOUBLE)*(x+1)), 2) AS sum_bgx FROM bg3 GROUP BY vol_id, z, y"""),
    "i5_background_reference": _sql(("bgref",), "SELECT vol_id, round(CAST(bg_ref AS DOUBLE), 4) AS bg_ref FROM bgref"),
    "i6_flatten": _sql(("flat",), _digest("flat", "v")),
    "i7_intensity_stats": _sql(("voxels",), """SELECT vol_id, min(gray) AS min, max(gray) AS max, round(avg(gray), 9) AS mean, round(stddev_pop(gray), 9) AS std
FROM voxels GROUP BY vol_id"""),
    "i8_otsu_threshold": _sql(("otsu",), "SELECT * FROM otsu"),
    "i9_dark_threshold": _sql(("limits",), "SELECT vol_id, threshold, otsu, round(pval, 9) AS pval FROM limits"),
    "i9_dark_threshold_explicit": _sql(("voxels", "otsu"), """SELECT o.vol_id, 60 AS threshold, otsu, round(pval, 9) AS pval
FROM otsu o JOIN (SELECT vol_id, quantile_cont(gray, 0.38) AS pval FROM voxels WHERE gray > 0 GROUP BY vol_id) p ON o.vol_id = p.vol_id"""),
    "i10_dark_mask": _sql(("dark",), _digest("dark")),
    "i11_foreground_mask": _sql(("fg",), _digest("fg")),
    "m1_ball_ring_offsets": _sql(("grains", "axis"), """SELECT vol_id, g, shape, count(*) AS n, CAST(sum(dz*3+dy*5+dx*7) AS BIGINT) AS moment FROM grains
CROSS JOIN (SELECT 'ball' AS shape, a.s AS dz, b.s AS dy, c.s AS dx FROM axis a, axis b, axis c WHERE a.s*a.s+b.s*b.s+c.s*c.s <= 16
  UNION ALL SELECT 'ring', 0, b.s, c.s FROM axis b, axis c WHERE b.s*b.s+c.s*c.s > 16 AND b.s*b.s+c.s*c.s <= 100) o
WHERE cz+dz BETWEEN 0 AND 23 AND cy+dy BETWEEN 0 AND 23 AND cx+dx BETWEEN 0 AND 23 GROUP BY vol_id, g, shape"""),
    "m2_neighbour_pairs": _sql(("gtmask", "steps1", "steps2", "steps3"), "\nUNION ALL ".join(
        f"""SELECT vol_id, count(*) AS pairs, {k} AS k
FROM (SELECT vol_id, z+dz AS z, y+dy AS y, x+dx AS x FROM gtmask CROSS JOIN steps{k}) JOIN gtmask USING (vol_id, z, y, x) GROUP BY vol_id"""
        for k in (1, 2, 3))),
    "m3_dilation": _sql(("markgrown2",), _digest("markgrown2")),
    "m4_erosion": _sql(("gteroded",), _digest("gteroded")),
    "m5_closing": _sql(("predclosed1",), _digest("predclosed1")),
    "m5_closing_wide": _sql(("predclosed2",), _digest("predclosed2")),
    "m6_connected_components": _sql(("seedc",), _component_rows("seedc")),
    "m6_connected_components_18": _sql(("mixc18",), _component_rows("mixc18")),
    "m6_connected_components_26": _sql(("mixc26",), _component_rows("mixc26")),
    "m6_connected_components_tiled": _sql(("predc",), _component_rows("predc")),
    "m7_border_voxels": _sql(("voxels",), _digest(f"(SELECT * FROM voxels WHERE gt_id > 0 AND {_FACE.format('')})", "gt_id")),
    "m8_external_internal": _sql(("dark", "ext"), """SELECT vol_id, z, y, count(e.vol_id) AS external, count(*) - count(e.vol_id) AS internal
FROM dark d LEFT JOIN ext e USING (vol_id, z, y, x) GROUP BY vol_id, z, y"""),
    "m9_hole_filling": _sql(("voxels", "outside"), _digest("(SELECT vol_id, z, y, x FROM voxels ANTI JOIN outside USING (vol_id, z, y, x))")),
    "m10_small_object_removal": _sql(("seedc",), _digest("(SELECT * FROM seedc QUALIFY count(*) OVER (PARTITION BY vol_id, component) >= 8)")),
    "m11_distance_transform": _sql(("dist",), """SELECT vol_id, z, y, count(*) AS n, CAST(sum(d2) AS BIGINT) AS sum_d2, CAST(sum(d2*(x+1)) AS BIGINT) AS sum_d2x,
  round(sum(sqrt(d2)), 6) AS sum_distance FROM dist WHERE d2 > 0 GROUP BY vol_id, z, y"""),
    "m12_marker_restriction": _sql(("insidec",), _component_rows("insidec")),
    "m13_forced_markers": _sql(("fg", "markgrown1"), _digest("(SELECT * FROM fg UNION SELECT * FROM markgrown1)")),
    "m14_marker_flooding": _sql(("flooded",), "SELECT vol_id, label, count(*) AS voxels FROM flooded GROUP BY vol_id, label"),
    "m15_label_size_filter": _sql(("preds", "voxels"), _digest("""(SELECT v.vol_id, z, y, x, label FROM voxels v
  JOIN (SELECT vol_id, pred_id, row_number() OVER (PARTITION BY vol_id ORDER BY pred_id) AS label FROM preds WHERE pred_voxels >= 100) k
    ON k.vol_id=v.vol_id AND k.pred_id=v.pred_id)""", "label")),
    "m16_distance_peaks": _sql(("tops", "peaks"), """SELECT vol_id, row_number() OVER (PARTITION BY vol_id ORDER BY component) AS component, cz AS z, cy AS y, cx AS x
FROM tops JOIN peaks USING (vol_id, component)"""),
    "f1_component_area": _sql(("points",), "SELECT vol_id, component, area FROM points"),
    "f2_component_bounds": _sql(("points",), "SELECT vol_id, component, z0, z1, y0, y1, x0, x1 FROM points"),
    "f3_component_extents": _sql(("points",), """SELECT vol_id, component, dz, dy, dx, greatest(dz, dy, dx) AS max_dim,
  round(greatest(dz, dy, dx)/greatest(1, least(dz, dy, dx))::DOUBLE, 9) AS elongation, round(area/(dz*dy*dx)::DOUBLE, 9) AS fill
FROM (SELECT *, z1-z0+1 AS dz, y1-y0+1 AS dy, x1-x0+1 AS dx FROM points)"""),
    "f4_component_centroid": _sql(("points",), "SELECT vol_id, component, cz, cy, cx FROM points"),
    "f5_mask_overlap": _sql(("grainshares",), """SELECT vol_id, component, round(external_overlap, 9) AS external_overlap, round(internal_overlap, 9) AS internal_overlap
FROM grainshares"""),
    "f6_nearest_internal": _sql(("points", "grainnear"), """SELECT vol_id, component, d2 IS NOT NULL AS near_internal, round(COALESCE(sqrt(d2), -1), 9) AS internal_dist
FROM points LEFT JOIN grainnear USING (vol_id, component)"""),
    "f7_center_mean": _sql(("sampled",), "SELECT vol_id, component, round(center_mean, 9) AS center_mean FROM sampled"),
    "f8_ring_mean": _sql(("sampled",), "SELECT vol_id, component, round(ring_mean, 9) AS ring_mean FROM sampled"),
    "f9_ring_external_coverage": _sql(("sampled",), "SELECT vol_id, component, round(ring_external_cov, 9) AS ring_external_cov FROM sampled"),
    "f10_f11_ring_contrast_score": _sql(("sampled",), "SELECT vol_id, component, round(ring_contrast, 9) AS ring_contrast, round(score, 9) AS score FROM sampled"),
    "c1_seed_cascade": _sql(("seedjudged",), "SELECT vol_id, component, reason FROM seedjudged"),
    "c1_seed_cascade_default": _sql(("seedjudged_default",), "SELECT vol_id, component, reason FROM seedjudged_default"),
    "c2_marker_cascade": _sql(("corejudged",), "SELECT vol_id, component, reason FROM corejudged"),
    "c3_seed_suppression": _sql(("seedkept",), "SELECT vol_id, component, new_label FROM seedkept"),
    "c4_marker_suppression": _sql(("corecapped",), "SELECT vol_id, component, new_label FROM corecapped"),
    "c4_marker_suppression_all": _sql(("corekept",), "SELECT vol_id, component, new_label FROM corekept"),
    "c5_seed_tallies": _sql(("seedjudged", "seedkept"), _tallies("seedjudged", "seedkept", params.REJECT_SEED)),
    "c5_marker_tallies": _sql(("corejudged", "corekept"), _tallies("corejudged", "corekept", params.REJECT_MARKER)),
    "c6_seed_report": _sql(("seedjudged", "seedkept"), """SELECT j.vol_id, j.component AS seed_component, COALESCE(new_label, 0) AS new_label,
  CASE WHEN new_label IS NULL THEN reason ELSE 'keep' END AS reason, area AS seed_area, round(external_overlap, 9) AS external_overlap,
  CASE WHEN reason = 'external_background' THEN 0 ELSE round(internal_overlap, 9) END AS internal_overlap,
  CASE WHEN reason = 'external_background' THEN 0 ELSE cz END AS z, CASE WHEN reason = 'external_background' THEN 0 ELSE cy END AS y,
  CASE WHEN reason = 'external_background' THEN 0 ELSE cx END AS x,
  CASE reason WHEN 'external_background' THEN 0 WHEN 'not_internal_dark' THEN 'inf'::DOUBLE
    WHEN 'ring_too_external' THEN round(ring_external_cov, 9) ELSE round(center_mean, 9) END AS metric1,
  CASE WHEN reason IN ('external_background', 'not_internal_dark') THEN 0 ELSE round(ring_contrast, 9) END AS metric2
FROM seedjudged j LEFT JOIN seedkept k USING (vol_id, component) WHERE reason <> 'seed_area' AND (reason <> 'candidate' OR new_label IS NOT NULL)"""),
    "c7_marker_report": _sql(("corejudged", "corekept"), """SELECT j.vol_id, j.component AS component_id, COALESCE(new_label, 0) AS new_label,
  CASE WHEN new_label IS NULL THEN reason ELSE 'keep' END AS reason, area,
  CASE WHEN reason = 'area' THEN 0 ELSE dx END AS dx, CASE WHEN reason = 'area' THEN 0 ELSE dy END AS dy, CASE WHEN reason = 'area' THEN 0 ELSE dz END AS dz,
  CASE WHEN reason = 'area' THEN 0 ELSE round(elongation, 9) END AS elongation, CASE WHEN reason = 'area' THEN 0 ELSE round(fill, 9) END AS fill,
  CASE WHEN reason IN ('area', 'shape') THEN 0 ELSE round(center_mean, 9) END AS center_mean,
  CASE WHEN reason IN ('area', 'shape') THEN 0 ELSE round(ring_contrast, 9) END AS ring_contrast
FROM corejudged j LEFT JOIN corekept k USING (vol_id, component) WHERE reason <> 'candidate' OR new_label IS NOT NULL"""),
    "c8_survivor_voxels": _sql(("cores", "corekept"), _digest("(SELECT cores.* FROM cores SEMI JOIN corekept USING (vol_id, component))")),
    "c9_centroid_points": _sql(("corejudged", "corekept"), """SELECT vol_id, cz AS z, cy AS y, cx AS x, max(new_label) AS label
FROM corejudged JOIN corekept USING (vol_id, component) GROUP BY vol_id, cz, cy, cx"""),
    "c10_seed_points": _sql(("corejudged", "corekept"), f"""SELECT DISTINCT vol_id, cz AS z, cy AS y, cx AS x, {params.SEED_POINT_VALUE} AS label
FROM corejudged JOIN corekept USING (vol_id, component)"""),
    "e1_label_sizes": _sql(("gts",), "SELECT vol_id, gt_id AS label, gt_voxels AS voxels FROM gts"),
    "e2_border_labels": _sql(("gts",), "SELECT vol_id, gt_id AS label FROM gts WHERE on_border"),
    "e3_valid_truth": _sql(("strict",), "SELECT * FROM strict"),
    "e4_pair_intersections": _sql(("pairs",), "SELECT vol_id, gt_id, pred_id, i AS intersection_voxels FROM pairs"),
    "e4_pair_intersections_valid": _sql(("pairs", "strict"), """SELECT vol_id, gt_id, pred_id, i AS intersection_voxels FROM pairs JOIN strict s USING (vol_id, gt_id)
WHERE s.valid OR vol_id NOT IN (SELECT vol_id FROM strict WHERE valid)"""),
    "e5_pair_iou_dice": _sql(("pairs",), "SELECT vol_id, gt_id, pred_id, round(iou, 9) AS iou, round(dice, 9) AS dice FROM pairs"),
    "e6_evaluable_predictions": _sql(("strictpreds",), "SELECT * FROM strictpreds"),
    "e7_matched_pairs": _sql(("optimum",), "SELECT vol_id, e.g AS gt_id, e.p AS pred_id, round(e.iou, 9) AS iou FROM (SELECT vol_id, unnest(picks) AS e FROM optimum)"),
    "e7_optimal_matching": _sql(("optimum",), """SELECT vol_id, CAST(sum(len(ious)) AS BIGINT) AS pairs, round(sum(list_sum(ious)), 6) AS total_iou
FROM optimum WHERE len(ious) > 0 GROUP BY vol_id"""),
    "e8_threshold_metrics": _sql(("metrics",), """SELECT * REPLACE (round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  round(overseg_ratio_pred_eval_gt, 9) AS overseg_ratio_pred_eval_gt) FROM metrics"""),
    "e8_threshold_metrics_published": _published(),
    "e9_match_table": _sql(("strictpairs",), """SELECT vol_id, threshold, CAST(gt_id AS BIGINT) AS gt_id, CAST(pred_id AS BIGINT) AS pred_id, round(iou, 9) AS iou FROM strictpairs
CROSS JOIN (VALUES (0.60::DOUBLE), (0.75::DOUBLE)) t(threshold) WHERE iou >= threshold"""),
    "e10_foreground_overlap": _sql(("fgover",), "SELECT * FROM fgover"),
    "e11_best_per_truth": _sql(("strict", "pairs"), """SELECT vol_id, gt_id, t.gt_voxels, COALESCE(pred_id, 0) AS best_pred_id, COALESCE(pred_voxels, 0) AS pred_voxels,
  COALESCE(i, 0) AS intersection, round(COALESCE(iou, 0), 9) AS iou, round(COALESCE(dice, 0), 9) AS dice, COALESCE(n, 0) AS num_pred_touching_gt,
  CASE WHEN pred_id IS NULL THEN 'missed' ELSE 'matched' END AS status
FROM strict t LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY vol_id, gt_id) AS n FROM pairs
  QUALIFY row_number() OVER (PARTITION BY vol_id, gt_id ORDER BY iou DESC, pred_id) = 1) b USING (vol_id, gt_id) WHERE valid"""),
    "e12_best_per_prediction": _sql(("strict", "pairs", "preds"), """SELECT vol_id, pred_id, p.pred_voxels, COALESCE(gt_id, 0) AS best_gt_id, COALESCE(b.gt_voxels, 0) AS gt_voxels,
  COALESCE(i, 0) AS intersection, round(COALESCE(iou, 0), 9) AS iou, round(COALESCE(dice, 0), 9) AS dice, COALESCE(n, 0) AS num_gt_touching_pred,
  CASE WHEN gt_id IS NOT NULL AND n > 1 THEN 'merge_candidate' WHEN gt_id IS NOT NULL THEN 'matched_candidate'
       WHEN vol_id NOT IN (SELECT vol_id FROM strict WHERE valid) AND EXISTS (SELECT 1 FROM pairs q WHERE q.vol_id = p.vol_id AND q.pred_id = p.pred_id)
       THEN 'no_valid_gt' ELSE 'background_or_unmatched' END AS status
FROM preds p LEFT JOIN (SELECT pairs.*, count(*) OVER (PARTITION BY vol_id, pred_id) AS n FROM pairs JOIN strict s USING (vol_id, gt_id) WHERE s.valid
  QUALIFY row_number() OVER (PARTITION BY vol_id, pred_id ORDER BY iou DESC, gt_id) = 1) b USING (vol_id, pred_id)"""),
    "e13_marker_dominant_truth": _sql(("voxels",), """SELECT vol_id, marker_id, CAST(sum(n) OVER w AS BIGINT) AS marker_voxels,
  CASE WHEN gt_id > 0 THEN gt_id ELSE 0 END AS dominant_gt_id, CASE WHEN gt_id > 0 THEN n ELSE 0 END AS overlap_voxels,
  CASE WHEN gt_id > 0 THEN 'inside_gt' ELSE 'background' END AS status
FROM (SELECT vol_id, marker_id, gt_id, count(*) AS n FROM voxels WHERE marker_id > 0 GROUP BY vol_id, marker_id, gt_id)
WINDOW w AS (PARTITION BY vol_id, marker_id)
QUALIFY row_number() OVER (PARTITION BY vol_id, marker_id ORDER BY gt_id > 0 DESC, n DESC, gt_id) = 1"""),
    "e14_marker_voxel_tallies": _sql(("markercounts",), "SELECT * FROM markercounts"),
    "e15_evaluation_summary": _sql(("base", "bestgt"), _summary()),
    "e16_object_recall": _sql(("bestgt",), """SELECT vol_id, threshold, round(avg(hit), 9) AS gt_object_recall, CAST(sum(hit) AS BIGINT) AS gt_matched_count
FROM (SELECT vol_id, threshold, CASE WHEN pred_id IS NOT NULL AND iou >= threshold THEN 1 ELSE 0 END AS hit FROM bestgt
  CROSS JOIN (VALUES (0.10::DOUBLE), (0.25::DOUBLE), (0.50::DOUBLE)) t(threshold)) GROUP BY vol_id, threshold"""),
    "e17_label_count": _sql(("voxels",), """SELECT vol_id, max(z)+1 AS depth, max(y)+1 AS height, max(x)+1 AS width, min(gt_id) AS min, max(gt_id) AS max,
  round(avg(gt_id), 9) AS mean, count(DISTINCT gt_id) FILTER (gt_id > 0) AS labels FROM voxels GROUP BY vol_id"""),
    "e18_component_qc": _sql(("markc",), """SELECT vol_id, count(*) AS components, min(area) AS area_min, round(avg(area), 9) AS area_mean, max(area) AS area_max
FROM (SELECT vol_id, component, count(*) AS area FROM markc GROUP BY vol_id, component) GROUP BY vol_id"""),
    "x1_crop_summary": """SELECT concat('scan_0', vol_id % 2) AS scan, concat('crop', vol_id) AS crop_id, 'refined_ws' AS method, gt_valid, pred_total AS pred_labels,
  pred_eval, pred_ignored_border AS pred_ignored, precision AS precision050, recall AS recall050, f1 AS f1050, fp AS fp050, fn AS fn050,
  overseg_ratio_pred_eval_gt AS overseg_ratio FROM (""" + _published() + ")",
    "x2_scan_union": _sql(("results",), "SELECT * FROM results"),
    "x3_grouped_stats": _sql(("stats",), """SELECT "group", method, metric, round(mean, 9) AS mean, round(median, 9) AS median, round(min, 9) AS min,
  round(max, 9) AS max, round(std, 9) AS std FROM stats"""),
    "x4_error_totals": _sql(("totals",), """SELECT "group", method, metric, mean, NULL::DOUBLE AS median, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS std FROM totals"""),
    "x5_formatted_stats": _sql(("stats", "totals"), """SELECT "group", method, metric, printf('%.6f', mean) AS mean, printf('%.6f', median) AS median, printf('%.6f', min) AS min,
  printf('%.6f', max) AS max, printf('%.6f', std) AS std FROM stats
UNION ALL SELECT "group", method, metric, CAST(CAST(mean AS BIGINT) AS VARCHAR), '', '', '', '' FROM totals"""),
    "x6_method_table": _sql(("stats", "totals"), "SELECT method, " + ", ".join(
        [f"round(max(mean) FILTER (metric = '{m}'), 9) AS {m}" for m in params.AVERAGED_METRICS]
        + [f"CAST(max(mean) FILTER (metric = '{m}') AS BIGINT) AS {m}" for m in params.TOTAL_METRICS])
        + """ FROM (SELECT "group", method, metric, mean FROM stats UNION ALL SELECT * FROM totals) WHERE "group" = 'ALL' GROUP BY method"""),
    "x7_crop_method_batch": _batch("SELECT * FROM voxels"),
    "x7_crop_method_batch_holed": _batch("""SELECT * REPLACE (CASE WHEN vol_id % 3 < 2 THEN 0 ELSE gt_id END AS gt_id,
  CASE WHEN vol_id % 3 = 0 THEN 0 ELSE pred_id END AS pred_id, CASE WHEN vol_id % 3 = 0 THEN 0 ELSE marker_id END AS marker_id) FROM voxels"""),
}

ORACLES |= {"e3_valid_truth_runs": ORACLES["e3_valid_truth"], "e10_foreground_overlap_runs": ORACLES["e10_foreground_overlap"],
            "e14_marker_voxel_tallies_runs": ORACLES["e14_marker_voxel_tallies"]}

_METRIC_COLUMNS = ("gt_valid", "pred_total", "pred_eval", "pred_ignored_border", "tp", "fp", "fn", "precision", "recall", "f1", "overseg_ratio_pred_eval_gt")
_OVERLAP_COLUMNS = ("foreground_gt_voxels", "foreground_pred_voxels", "foreground_intersection", "foreground_iou", "foreground_dice",
                    "foreground_precision", "foreground_recall")
ORACLES |= {
    "e8_threshold_metrics_holed": _holed(ORACLES["e8_threshold_metrics"], "vol_id, threshold", _METRIC_COLUMNS),
    "e10_foreground_overlap_holed": _holed(ORACLES["e10_foreground_overlap"].replace(
        "(foreground_gt_voxels+foreground_pred_voxels-foreground_intersection)::DOUBLE", "nullif(foreground_gt_voxels+foreground_pred_voxels-foreground_intersection, 0)::DOUBLE").replace(
        "(foreground_gt_voxels+foreground_pred_voxels)::DOUBLE", "nullif(foreground_gt_voxels+foreground_pred_voxels, 0)::DOUBLE"), "vol_id", _OVERLAP_COLUMNS),
    "e14_marker_voxel_tallies_holed": _holed(
        ORACLES["e14_marker_voxel_tallies"], "vol_id", ("marker_components", "marker_voxels_on_gt", "marker_voxels_on_background")),
    "e16_object_recall_holed": _holed(ORACLES["e16_object_recall"], "vol_id, threshold", ("gt_object_recall", "gt_matched_count")),
}
# The same results from small tiles, merged across their faces.
ORACLES |= {f"{n}_tiled": ORACLES[n] for n in (
    "m8_external_internal", "m9_hole_filling", "m10_small_object_removal", "m12_marker_restriction", "m14_marker_flooding")}
ORACLES["p2_otsu_baseline_job"] = _sql(("fgflooded",), "SELECT vol_id, label, count(*) AS voxels FROM fgflooded GROUP BY vol_id, label")
ORACLES["p1_segmentation_job"] = _segmentation()

# 16-bit gray, rescaled before anything else.
_cte("wide", ("voxels",), "wide AS MATERIALIZED (SELECT * REPLACE (gray*16 + x AS gray) FROM voxels)")
_cte("eight", ("wide",), """eight AS MATERIALIZED (SELECT v.vol_id, z, y, x, CAST(floor(least(greatest(
  (CAST(gray AS FLOAT) - CAST(lo AS FLOAT)) * CAST(255 AS FLOAT) / CAST(hi - lo AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INT) AS gray
  FROM wide v JOIN (SELECT vol_id, quantile_cont(gray, 0.005) AS lo, quantile_cont(gray, 0.995) AS hi FROM wide WHERE gray > 0 GROUP BY vol_id) e ON e.vol_id = v.vol_id)""")
_cte("hist8", ("eight",), _CTES["hist"][1].replace("voxels", "eight").replace("hist AS", "hist8 AS"))
_cte("otsu8", ("hist8",), _CTES["otsu"][1].replace("FROM hist)", "FROM hist8)").replace("otsu AS MAT", "otsu8 AS MAT"))
_cte("fg8", ("eight", "otsu8"), _CTES["fg"][1].replace("voxels", "eight").replace("JOIN otsu o", "JOIN otsu8 o").replace("fg AS", "fg8 AS"))
ORACLES |= {
    "i2_rescale_16bit": _sql(("eight",), _digest("eight", "gray")),
    "i8_otsu_16bit": _sql(("otsu8",), "SELECT * FROM otsu8"),
    "i11_foreground_16bit": _sql(("fg8",), _digest("fg8")),
}
