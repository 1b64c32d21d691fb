"""The registered queries of the raster engine in DuckDB's SQL, written on their own."""

from __future__ import annotations

_PAL = "pal(label,r,g,b) AS (VALUES (0,255,255,255),(1,220,50,47),(2,0,0,0),(3,38,139,210),(4,133,153,0),(5,181,137,0))"
_PX = f"""{_PAL},
ev AS (SELECT event_id // 500 AS image_id, (event_id % 500) // 25 AS y, event_id % 25 AS x, user_id, event_type, event_id FROM events),
px AS (SELECT e.image_id, e.y, e.x, CAST(n.user_id % 6 AS BIGINT) AS label,
  CASE WHEN e.event_type = 'error' THEN (p.r + q.r) // 2 ELSE p.r END AS r, CASE WHEN e.event_type = 'error' THEN (p.g + q.g) // 2 ELSE p.g END AS g,
  CASE WHEN e.event_type = 'error' THEN (p.b + q.b) // 2 ELSE p.b END AS b, CASE WHEN n.event_type = 'signup' THEN 0 ELSE 255 END AS a
  FROM ev e JOIN events n ON n.event_id = e.image_id * 500 + (e.y // 5) * 125 + (e.x // 5) * 5
  JOIN pal p ON p.label = n.user_id % 6 JOIN pal q ON q.label = (n.user_id % 6 + 1) % 6),
rd AS (SELECT px.image_id, y, x, px.label, pal.r, pal.g, pal.b, CASE WHEN a < 128 OR px.label = 5 THEN 0 ELSE 255 END AS a FROM px JOIN pal USING (label))"""

_EDGE = "(y < 1 OR x < 1 OR y >= 19 OR x >= 24)"
_CODE = "(CAST({0}r AS BIGINT) << 16) | (CAST({0}g AS BIGINT) << 8) | CAST({0}b AS BIGINT)"


def _code(p: str = "") -> str:
    return _CODE.format(p)


def _lin(c: str) -> str:
    return f"CASE WHEN ({c})/255.0::DOUBLE > 0.04045 THEN pow((({c})/255.0::DOUBLE + 0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) ELSE ({c})/255.0::DOUBLE/12.92::DOUBLE END"


def lab(src: str, out: str, r: str = "r", g: str = "g", b: str = "b", names: tuple[str, str, str] = ("l", "la", "lb")) -> str:
    """CTEs that add LAB columns to a relation."""
    f = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE/3) ELSE 7.787::DOUBLE*{t} + 16.0::DOUBLE/116 END"
    return f"""{out}_1 AS MATERIALIZED (SELECT *, {_lin(r)} AS _u, {_lin(g)} AS _v, {_lin(b)} AS _w FROM {src}),
{out}_2 AS MATERIALIZED (SELECT *, (0.412453::DOUBLE*_u + 0.357580::DOUBLE*_v + 0.180423::DOUBLE*_w)/0.95047::DOUBLE AS _x, 0.212671::DOUBLE*_u + 0.715160::DOUBLE*_v + 0.072169::DOUBLE*_w AS _y,
  (0.019334::DOUBLE*_u + 0.119193::DOUBLE*_v + 0.950227::DOUBLE*_w)/1.08883::DOUBLE AS _z FROM {out}_1),
{out}_3 AS MATERIALIZED (SELECT *, {f('_x')} AS _fx, {f('_y')} AS _fy, {f('_z')} AS _fz FROM {out}_2),
{out} AS MATERIALIZED (SELECT * EXCLUDE (_u,_v,_w,_x,_y,_z,_fx,_fy,_fz), 116.0::DOUBLE*_fy - 16 AS {names[0]}, 500.0::DOUBLE*(_fx-_fy) AS {names[1]}, 200.0::DOUBLE*(_fy-_fz) AS {names[2]} FROM {out}_3)"""


def de2000(src: str, out: str, p: tuple[str, str, str], q: tuple[str, str, str]) -> str:
    """CTEs that add `de`, CIEDE2000 of two LAB colours."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    hue = lambda u, b: f"CASE WHEN {u}=0 AND {b}=0 THEN 0.0::DOUBLE WHEN degrees(atan2({b},{u})) < 0 THEN degrees(atan2({b},{u})) + 360 ELSE degrees(atan2({b},{u})) END"
    return f"""{out}_a AS MATERIALIZED (SELECT *, pow((sqrt({a1}*{a1}+{b1}*{b1}) + sqrt({a2}*{a2}+{b2}*{b2}))/2, 7) AS _c7 FROM {src}),
{out}_b AS MATERIALIZED (SELECT *, {a1}*(1+0.5::DOUBLE*(1-sqrt(_c7/(_c7+6103515625.0::DOUBLE)))) AS _u1, {a2}*(1+0.5::DOUBLE*(1-sqrt(_c7/(_c7+6103515625.0::DOUBLE)))) AS _u2 FROM {out}_a),
{out}_c AS MATERIALIZED (SELECT *, sqrt(_u1*_u1+{b1}*{b1}) AS _c1, sqrt(_u2*_u2+{b2}*{b2}) AS _c2, {hue('_u1', b1)} AS _h1, {hue('_u2', b2)} AS _h2 FROM {out}_b),
{out}_d AS MATERIALIZED (SELECT *, CASE WHEN _c1*_c2=0 THEN 0 WHEN _h2-_h1>180 THEN _h2-_h1-360 WHEN _h2-_h1<-180 THEN _h2-_h1+360 ELSE _h2-_h1 END AS _dh,
  CASE WHEN _c1*_c2=0 THEN _h1+_h2 WHEN abs(_h1-_h2)<=180 THEN (_h1+_h2)/2 WHEN _h1+_h2<360 THEN (_h1+_h2+360)/2 ELSE (_h1+_h2-360)/2 END AS _hm, ({l1}+{l2})/2 AS _lm, (_c1+_c2)/2 AS _cm FROM {out}_c),
{out}_e AS MATERIALIZED (SELECT *, 2*sqrt(_c1*_c2)*sin(radians(_dh/2)) AS _big, 1 - 0.17::DOUBLE*cos(radians(_hm-30)) + 0.24::DOUBLE*cos(radians(2*_hm)) + 0.32::DOUBLE*cos(radians(3*_hm+6)) - 0.20::DOUBLE*cos(radians(4*_hm-63)) AS _t,
  -sin(radians(60*exp(-pow((_hm-275)/25,2)))) * 2*sqrt(pow(_cm,7)/(pow(_cm,7)+6103515625.0::DOUBLE)) AS _rt FROM {out}_d),
{out}_f AS MATERIALIZED (SELECT *, ({l2}-{l1})/(1+0.015::DOUBLE*pow(_lm-50,2)/sqrt(20+pow(_lm-50,2))) AS _p, (_c2-_c1)/(1+0.045::DOUBLE*_cm) AS _q, _big/(1+0.015::DOUBLE*_cm*_t) AS _s FROM {out}_e),
{out} AS MATERIALIZED (SELECT * EXCLUDE (_c7,_u1,_u2,_c1,_c2,_h1,_h2,_dh,_hm,_lm,_cm,_big,_t,_rt,_p,_q,_s), sqrt(greatest(_p*_p+_q*_q+_s*_s+_rt*_q*_s, 0)) AS de FROM {out}_f)"""


def b(*columns: str) -> str:
    """Columns as BIGINT."""
    return ", ".join(f"CAST({c.split(' AS ')[0]} AS BIGINT) AS {c.split(' AS ')[-1].split('.')[-1]}" for c in columns)


def r6(*columns: str) -> str:
    return ", ".join(f"round(CAST({c.split(' AS ')[0]} AS DOUBLE), 6) AS {c.split(' AS ')[-1].split('.')[-1]}" for c in columns)


def q(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_PX}{''.join(', ' + c for c in ctes)} {select}"


_HEX = "printf('#%02x%02x%02x', {0}r, {0}g, {0}b)"
_BG = f"""bgc AS (SELECT image_id, label, count(*) AS n FROM px WHERE {_EDGE} AND a >= 128 GROUP BY ALL),
bgt AS (SELECT image_id, count(*) AS total FROM px WHERE {_EDGE} GROUP BY ALL),
bgb AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM bgc),
bg AS (SELECT image_id, label, n, total FROM bgb JOIN bgt USING (image_id) WHERE k = 1 AND n * 2 >= total)"""
_TABLE = f"""{_BG},
tb0 AS (SELECT image_id, label, quantile_disc(r, 0.5) AS r, quantile_disc(g, 0.5) AS g, quantile_disc(b, 0.5) AS b, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL),
tb1 AS (SELECT tb0.*, row_number() OVER (PARTITION BY tb0.image_id ORDER BY tb0.n DESC, tb0.label) - 1 AS idx, coalesce(bg.label = tb0.label, false) AS is_background FROM tb0 LEFT JOIN bg USING (image_id)),
tb AS (SELECT *, {_HEX.format('')} AS hex, CASE WHEN is_background THEN 'background' ELSE 'color_' || idx || '_' || upper(substr({_HEX.format('')}, 2, 6)) END AS name FROM tb1)"""
_COL = "col AS (SELECT DISTINCT r, g, b FROM px)"
_PAIRS = f"{_TABLE}, {lab('tb', 'tl')}, pr AS (SELECT x.image_id, x.idx AS i, y.idx AS j, x.l AS l1, x.la AS a1, x.lb AS b1, y.l AS l2, y.la AS a2, y.lb AS b2 FROM tl x JOIN tl y ON x.image_id = y.image_id AND x.idx <> y.idx)"
_HIST = f"h0 AS (SELECT image_id, {_code()} AS code, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL), hist AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS share, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, code) AS rank FROM h0)"
_BIN = "least(floor(l/10.0::DOUBLE), 10)*484 + floor((la+128)/12.0::DOUBLE)*22 + floor((lb+128)/12.0::DOUBLE)"
_BINS = f"""hc AS (SELECT image_id, r, g, b, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL), {lab('hc', 'hl')},
hb AS (SELECT image_id, CAST({_BIN} AS BIGINT) AS bin, sum(n) AS n FROM hl GROUP BY ALL),
hr AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS total, sum(n) OVER (PARTITION BY image_id ORDER BY n DESC, bin ROWS UNBOUNDED PRECEDING) AS upto FROM hb),
bins AS (SELECT image_id, sum(CASE WHEN n*500 >= total THEN 1 ELSE 0 END) AS n_colors, least(sum(CASE WHEN upto*20 < total*19 THEN 1 ELSE 0 END) + 1, count(*)) AS colors_95 FROM hr GROUP BY ALL)"""
_PAIRED = "pairs AS (SELECT px.*, rd.r AS pr, rd.g AS pg, rd.b AS pb, rd.a AS pa FROM px JOIN rd USING (image_id, y, x))"
_INNER = f"{_PAIRED}, inr AS (SELECT p.image_id, p.y, p.x, min(CASE WHEN n.a >= 128 THEN 1 ELSE 0 END) = 1 AS inside FROM pairs p JOIN px n ON n.image_id = p.image_id AND n.y BETWEEN p.y-1 AND p.y+1 AND n.x BETWEEN p.x-1 AND p.x+1 GROUP BY ALL), inn AS (SELECT pairs.*, inside FROM pairs JOIN inr USING (image_id, y, x))"
_GAPS = f"""{_INNER}, g0 AS (SELECT image_id, sum(inside::INT) AS interior, sum((inside AND pa < 128)::INT) AS gap, sum((a >= 128 AND pa >= 128)::INT) AS bo, sum((a >= 128 OR pa >= 128)::INT) AS an FROM inn GROUP BY ALL),
gaps AS (SELECT image_id, interior, gap, CASE WHEN interior > 0 THEN gap / interior ELSE 0 END AS gap_ratio, CASE WHEN an > 0 THEN bo / an ELSE 1 END AS iou FROM g0)"""
_LAYERS = f"{_TABLE}, lay AS (SELECT image_id, label, r AS lr, g AS lg, b AS lb_ FROM tb WHERE label <> 5)"
_REGION = f"""{_LAYERS}, {lab('px', 'pl')}, rm AS (SELECT image_id, label, count(*) AS n, quantile_cont(l, 0.5) AS ml, quantile_cont(la, 0.5) AS ma, quantile_cont(lb, 0.5) AS mb FROM pl WHERE a >= 128 GROUP BY ALL),
{lab('lay', 'll', 'lr', 'lg', 'lb_', ('ol', 'oa', 'ob'))}, rj AS (SELECT rm.*, ol, oa, ob FROM rm JOIN ll USING (image_id, label)), {de2000('rj', 'rde', ('ol', 'oa', 'ob'), ('ml', 'ma', 'mb'))}"""


_WHITE = "({0}/255.0::DOUBLE*({1}/255.0::DOUBLE) + (1 - {1}/255.0::DOUBLE))"


def _white(p: str = "") -> tuple[str, str, str]:
    return tuple(_WHITE.format(f"{p}{c}", f"{p}a") for c in "rgb")


def _gray(p: str = "") -> str:
    r, g, bl = _white(p)
    return f"(0.2125::DOUBLE*{r} + 0.7154::DOUBLE*{g} + 0.0721::DOUBLE*{bl})"


_SSIM = f"""gp AS (SELECT px.image_id, px.y, px.x, {_gray('px.')} AS p, {_gray('rd.')} AS q FROM px JOIN rd USING (image_id, y, x)),
sw AS (SELECT c.image_id, c.y, c.x, sum(n.p)/49 AS p, sum(n.q)/49 AS q, sum(n.p*n.p)/49 AS pp, sum(n.q*n.q)/49 AS qq, sum(n.p*n.q)/49 AS pq FROM gp c JOIN gp n ON n.image_id = c.image_id AND n.y BETWEEN c.y-3 AND c.y+3 AND n.x BETWEEN c.x-3 AND c.x+3 WHERE c.y BETWEEN 3 AND 16 AND c.x BETWEEN 3 AND 21 GROUP BY ALL)"""
_SSIM_VALUE = "round(avg((2*p*q+0.0001::DOUBLE)*(2*(49.0::DOUBLE/48)*(pq-p*q)+0.0009::DOUBLE)/((p*p+q*q+0.0001::DOUBLE)*((49.0::DOUBLE/48)*(pp-p*p)+(49.0::DOUBLE/48)*(qq-q*q)+0.0009::DOUBLE))), 6)"
_CHECKS = f"""{_SSIM}, {_GAPS}, {_REGION}, ssm AS (SELECT image_id, {_SSIM_VALUE} AS ssim FROM sw GROUP BY ALL), agg AS (SELECT image_id, avg(de) AS mean_de, max(de) AS max_de FROM rde GROUP BY ALL),
rep AS (SELECT gaps.image_id, round(gap_ratio, 6) AS gap_ratio, round(iou, 6) AS iou, round(coalesce(mean_de, 0), 6) AS mean_de, round(coalesce(max_de, 0), 6) AS max_de, (gaps.image_id % 5)::DOUBLE AS time_s, (gaps.image_id % 3 <> 0) AS ok, ssim FROM gaps LEFT JOIN agg USING (image_id) JOIN ssm USING (image_id)),
chk AS (SELECT image_id, 'mean_delta_e' AS name, mean_de AS value, 2.0::DOUBLE AS threshold, '<' AS comparator, mean_de < 2 AS passed FROM rep
 UNION ALL SELECT image_id, 'max_delta_e', max_de, 3.0, '<', max_de < 3 FROM rep UNION ALL SELECT image_id, 'gap_ratio', gap_ratio, 0.0005, '<=', gap_ratio <= 0.0005::DOUBLE FROM rep
 UNION ALL SELECT image_id, 'alpha_iou', iou, 0.98, '>=', iou >= 0.98::DOUBLE FROM rep UNION ALL SELECT image_id, 'processing_time_s', time_s, 2.0, '<', time_s < 2 FROM rep
 UNION ALL SELECT image_id, 'svg_valid', ok::INT::DOUBLE, 1.0, '>=', ok FROM rep UNION ALL SELECT image_id, 'ssim', ssim, 0.90, '>=', ssim >= 0.90::DOUBLE FROM rep)"""
_RECTS = """run0 AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(x) OVER w = x - 1 THEN 0 ELSE 1 END AS f FROM {0} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
run1 AS (SELECT *, sum(f) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM run0),
run2 AS (SELECT image_id, y, label, run, min(x) AS x0, max(x) + 1 AS x1 FROM run1 GROUP BY ALL),
run3 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, label, x0, x1 ORDER BY y) AS isl FROM run2),
rects AS (SELECT image_id, label, x0, min(y) AS y0, x1, max(y) + 1 AS y1 FROM run3 GROUP BY image_id, label, x0, x1, isl)"""
_PATH = "'M' || x0 || ' ' || y0 || ' L' || x1 || ' ' || y0 || ' L' || x1 || ' ' || y1 || ' L' || x0 || ' ' || y1 || ' Z'"
_PATHS = f"""{_RECTS.format('px')}, rp0 AS (SELECT *, (row_number() OVER (PARTITION BY image_id, label ORDER BY y0, x0) - 1) // 10 AS path_no, {_PATH} AS one FROM rects),
paths AS (SELECT image_id, label, path_no, string_agg(one, ' ' ORDER BY y0, x0) AS d, count(*) AS n_rects FROM rp0 GROUP BY ALL)"""
#: Connected regions of equal labels, by reachability over 5 x 5 blocks' equal neighbours: pixels of a block share its label.
_COMPS = """cell AS (SELECT image_id, y // 5 AS cy, x // 5 AS cx, min(label) AS label FROM {0} GROUP BY ALL),
reach(image_id, cy, cx, ty, tx, label) AS (SELECT image_id, cy, cx, cy, cx, label FROM cell UNION
 SELECT r.image_id, r.cy, r.cx, c.cy, c.cx, r.label FROM reach r JOIN cell c ON c.image_id = r.image_id AND c.label = r.label AND abs(c.cy - r.ty) + abs(c.cx - r.tx) = 1),
cc0 AS (SELECT image_id, cy, cx, min(ty * 5 * 1048576 + tx * 5) AS comp FROM reach GROUP BY ALL),
cc AS (SELECT p.image_id, p.y, p.x, p.label, cc0.comp FROM {0} p JOIN cc0 ON cc0.image_id = p.image_id AND cc0.cy = p.y // 5 AND cc0.cx = p.x // 5),
cst AS (SELECT image_id, label, comp, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM cc GROUP BY ALL)"""
_PLAN = "{0}, plan AS (SELECT image_id, label, n, is_background, {1} AS is_line, row_number() OVER (PARTITION BY image_id ORDER BY {1}, NOT is_background, n DESC, label) - 1 AS z FROM tb)"
_LUMA = "((CAST(r AS BIGINT)*4899 + g*9617 + b*1868 + 8192) >> 14)"


_LOG = """log AS (SELECT user_id AS job_id, event_id, epoch_us(ts) AS ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
 (['load','preprocess','classify','quantize','vectorize','export'])[event_id % 6 + 1] AS stage, event_id % 101 AS progress, value FROM events)"""
_LATEST = f"""{_LOG}, lk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM log),
la AS (SELECT job_id, min(ts) AS created, max(progress) AS progress, count(*) AS n_updates FROM log GROUP BY ALL),
latest AS (SELECT lk.job_id, status, stage, created, lk.ts AS updated, la.progress, n_updates FROM lk JOIN la USING (job_id) WHERE k = 1)"""
_NUM = "rtrim(rtrim(printf('%s%d.%02d', CASE WHEN {0} < 0 THEN '-' ELSE '' END, abs({0}) // 100, abs({0}) % 100), '0'), '.')"
_SEG = "'M' || x0 || ' ' || y0 || ' L' || x1 || ' ' || y0 || ' L' || x1 || ' ' || y1 || ' L' || x0 || ' ' || y1 || ' Z'"
_DOCS = f"""{_PLAN.format(_TABLE, 'false')}, opq AS (SELECT * FROM px WHERE a >= 128), {_RECTS.format('opq')},
dd AS (SELECT image_id, label, string_agg({_SEG}, ' ' ORDER BY y0, x0) AS d FROM rects GROUP BY ALL),
lyr AS (SELECT tb.image_id, plan.z, tb.name AS id, dd.d, tb.hex FROM tb JOIN plan USING (image_id, label) JOIN dd USING (image_id, label)),
doc AS (SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="25" height="20" viewBox="0 0 25 20">' || string_agg('<g id="' || id || '" fill="' || hex || '" fill-rule="evenodd"><path d="' || d || '"/></g>', '' ORDER BY z) || '</svg>' AS svg FROM lyr GROUP BY ALL)"""
_TRUTH = f"""{_TABLE}, {lab('tb', 'tl')}, tr0(truth, r, g, b) AS (VALUES ('#ffffff',255,255,255),('#dc322f',220,50,47),('#000000',0,0,0),('#6c71c4',108,113,196)),
{lab('tr0', 'trl', names=('ql', 'qa', 'qb'))}, tj AS (SELECT tl.image_id, idx, hex, truth, ql, qa, qb, l, la, lb FROM tl CROSS JOIN trl), {de2000('tj', 'tde', ('ql', 'qa', 'qb'), ('l', 'la', 'lb'))},
td AS (SELECT image_id, idx, hex, truth, round(de, 6) AS de FROM tde)"""
_D = lambda p, s: f"sqrt(pow({p}.r-{s}.r,2)+pow({p}.g-{s}.g,2)+pow({p}.b-{s}.b,2))"
_MIXED = " OR ".join(
    f"EXISTS (SELECT 1 FROM px n1 JOIN px n2 ON n1.image_id = n2.image_id WHERE n1.image_id = p.image_id AND n1.y = p.y - {dy} AND n1.x = p.x - {dx} AND n2.y = p.y + {dy} AND n2.x = p.x + {dx} AND n1.a >= 128 AND n2.a >= 128 AND {_D('n1', 'n2')} > 24 AND least({_D('p', 'n1')}, {_D('p', 'n2')}) > 6 AND {_D('p', 'n1')} + {_D('p', 'n2')} <= {_D('n1', 'n2')} + 10)"
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, "-1"))
)
_NEAR = "{0} n ON n.image_id = p.image_id AND n.y BETWEEN p.y-1 AND p.y+1 AND n.x BETWEEN p.x-1 AND p.x+1"
_NOISY = f"nz AS (SELECT px.*, ({_code('px.')}) <> ({_code('pal.')}) AS noisy FROM px JOIN pal USING (label))"
_DETECT = f"""clr AS (SELECT image_id, avg(CASE WHEN a < 128 THEN 1.0::DOUBLE ELSE 0 END) AS c FROM px WHERE {_EDGE} GROUP BY ALL), sd AS (SELECT px.* FROM px JOIN clr USING (image_id) WHERE {_EDGE} AND a >= 128 AND c <= 0.5), {lab('sd', 'sl')},
sk AS (SELECT *, CAST(floor(l/4.0::DOUBLE) AS BIGINT) AS kl, CAST(floor(la/4.0::DOUBLE) AS BIGINT) AS ka, CAST(floor(lb/4.0::DOUBLE) AS BIGINT) AS kb FROM sl),
sc AS (SELECT image_id, kl, ka, kb, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, kl, ka, kb) AS k FROM sk GROUP BY image_id, kl, ka, kb),
sm AS (SELECT image_id, quantile_cont(l, 0.5) AS ml, quantile_cont(la, 0.5) AS ma, quantile_cont(lb, 0.5) AS mb FROM sk JOIN sc USING (image_id, kl, ka, kb) WHERE k = 1 GROUP BY ALL)"""
_DOM = "db AS (SELECT *, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS bin FROM px WHERE a >= 128), dk AS (SELECT image_id, bin, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, bin) AS k FROM db GROUP BY image_id, bin)"
_CLASS = f"""{_BINS}, ik AS (SELECT image_id, avg(CASE WHEN label <> 0 AND a >= 128 THEN 1.0::DOUBLE ELSE 0 END) AS ink, avg(CASE WHEN label = 2 THEN 1.0::DOUBLE ELSE 0 END) AS dark FROM px GROUP BY ALL),
ft AS (SELECT image_id, greatest(1/(1+exp(-(ink*0.35::DOUBLE-0.25::DOUBLE)/0.05::DOUBLE)), 1/(1+exp(-(colors_95-20.0::DOUBLE)/3.0::DOUBLE))) AS g,
 1/(1+exp(-(0.03::DOUBLE-dark*0.2::DOUBLE)/0.008::DOUBLE)) * sqrt(1/(1+exp(-((1-dark)-0.8::DOUBLE)/0.05::DOUBLE)) * (1/(1+exp(-(dark*1.2::DOUBLE-0.15::DOUBLE)/0.04::DOUBLE)))) * (1/(1+exp(-(ink*0.4::DOUBLE-0.25::DOUBLE)/0.05::DOUBLE))) * (1/(1+exp(-(0.3::DOUBLE-ink*0.4::DOUBLE)/0.05::DOUBLE))) AS ln,
 1/(1+exp(-(dark*0.06::DOUBLE-0.008::DOUBLE)/0.002::DOUBLE)) * (1/(1+exp(-(ink*0.5::DOUBLE-0.35::DOUBLE)/0.07::DOUBLE))) AS o FROM ik JOIN bins USING (image_id)),
cs AS (SELECT image_id, g+(1-g)*(1-ln)*o AS p_mixed, (1-g)*ln AS p_line_art, (1-g)*(1-ln)*(1-o) AS p_flat_color FROM ft)"""
_INK = f"""op AS (SELECT * FROM px WHERE a >= 128), {lab('op', 'ol')}, iv AS (SELECT *, CAST(floor(l*2.55::DOUBLE) AS BIGINT) AS v FROM ol),
i1 AS (SELECT image_id, v, count(*)::DOUBLE AS k FROM iv GROUP BY ALL),
i2 AS (SELECT image_id, v, sum(k) OVER u AS n0, sum(k*v) OVER u AS s0, sum(k) OVER i AS n, sum(k*v) OVER i AS s FROM i1 WINDOW u AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), i AS (PARTITION BY image_id)),
i3 AS (SELECT image_id, arg_max(v, round(CASE WHEN n > n0 THEN n0*(n-n0)*pow(s0/n0-(s-s0)/(n-n0), 2) ELSE -1 END, 3) * 1000000 - v) AS th FROM i2 GROUP BY ALL),
i4 AS (SELECT iv.* FROM iv JOIN i3 USING (image_id) WHERE l <= least(th/2.55::DOUBLE, 40)),
i5 AS (SELECT image_id, quantile_cont(l, 0.05) AS l0 FROM i4 GROUP BY image_id HAVING count(*) >= 4),
ic AS (SELECT image_id, floor(quantile_cont(r::DOUBLE, 0.5)) AS ir, floor(quantile_cont(g::DOUBLE, 0.5)) AS ig, floor(quantile_cont(b::DOUBLE, 0.5)) AS ib FROM i4 JOIN i5 USING (image_id) WHERE l <= l0 + 10 GROUP BY ALL)"""
_SRGB = "CAST(round_even(255*least(1, greatest(0, CASE WHEN {0} > 0.0031308 THEN 1.055::DOUBLE*pow(greatest({0}, 0), 1/2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE*{0} END)), 0) AS INTEGER)"

_SHAPES = """bx AS (SELECT image_id, label AS z, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x) + 1.0::DOUBLE AS x1, max(y) + 1.0::DOUBLE AS y1 FROM px GROUP BY ALL),
ln AS (SELECT image_id, z, unnest([{'ax': x0, 'ay': y0, 'cx': x1, 'cy': y0, 'implied': false}, {'ax': x1, 'ay': y0, 'cx': x1, 'cy': y1, 'implied': false}, {'ax': x0, 'ay': y0 + 0.5::DOUBLE, 'cx': x0, 'cy': y0, 'implied': false},
  {'ax': x1, 'ay': y0, 'cx': x0, 'cy': y0, 'implied': true}, {'ax': x0 + 0.25::DOUBLE, 'ay': y0, 'cx': x1, 'cy': y1, 'implied': false}, {'ax': x1, 'ay': y1, 'cx': x0, 'cy': y1, 'implied': false}, {'ax': x0, 'ay': y1, 'cx': x0 + 0.25::DOUBLE, 'cy': y0, 'implied': true}], recursive := true) FROM bx),
cv AS (SELECT image_id, z, unnest([{'px': x1, 'py': y1, 'qx': x1, 'qy': y0, 'rx': x0, 'ry': y1, 'sx': x0, 'sy': y0 + 0.5::DOUBLE}, {'px': x0, 'py': y0, 'qx': x0, 'qy': y1, 'rx': x1, 'ry': y1, 'sx': x1, 'sy': y0}], recursive := true) FROM bx),
cn AS (SELECT *, CAST(least(64, greatest(2, ceil((sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) + sqrt((rx-qx)*(rx-qx)+(ry-qy)*(ry-qy)) + sqrt((sx-rx)*(sx-rx)+(sy-ry)*(sy-ry)))/1.5::DOUBLE))) AS BIGINT) AS n FROM cv),
ck AS (SELECT *, unnest(range(n)) AS k FROM cn),
cu AS (SELECT *, k/n::DOUBLE AS u, (k+1)/n::DOUBLE AS v FROM ck),
eg AS (SELECT image_id, z, ax, ay, cx, cy, implied FROM ln UNION ALL SELECT image_id, z, """ + ", ".join(f"(1-{u})*(1-{u})*(1-{u})*p{c} + 3*(1-{u})*(1-{u})*{u}*q{c} + 3*(1-{u})*{u}*{u}*r{c} + {u}*{u}*{u}*s{c}" for u in "uv" for c in "xy") + " , false FROM cu)"
_COVER = """sm AS (SELECT i.image_id, i.z, range // 75 AS sy, range % 75 AS sx, range // 75 + 0.5::DOUBLE AS yc, range % 75 + 0.5::DOUBLE AS xc FROM bx i CROSS JOIN range(4500)),
wd AS (SELECT sm.image_id, sm.z, sy, sx, sum(CASE WHEN cy > ay THEN 1 ELSE -1 END) AS nz, count(*) AS eo FROM sm JOIN (SELECT image_id, z, 3*ax AS ax, 3*ay AS ay, 3*cx AS cx, 3*cy AS cy FROM eg) e
  ON e.image_id = sm.image_id AND e.z = sm.z AND yc >= least(ay, cy) AND yc < greatest(ay, cy) AND ax + (yc - ay)*(cx - ax)/(cy - ay) <= xc GROUP BY ALL),
cov AS (SELECT image_id, z, sy // 3 AS y, sx // 3 AS x, count(*) / 9.0::DOUBLE AS cover FROM wd WHERE CASE WHEN z % 2 = 0 THEN eo % 2 = 1 ELSE nz <> 0 END GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "raster_scan": q(f"SELECT {b('image_id', 'y', 'x', 'label', 'r', 'g', 'b', 'a')}, {_EDGE} AS on_border FROM px"),
    "color_hex_pack": q(f"SELECT {b('r', 'g', 'b')}, {_HEX.format('')} AS hex, {_code()} AS code, CAST(((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS BIGINT) AS code5, {_code()} AS back FROM col", _COL),
    "srgb_to_lab": q(f"SELECT {b('r', 'g', 'b')}, {r6('l', 'la', 'lb')}, CAST({_BIN} AS BIGINT) AS bin FROM cl", _COL, lab("col", "cl")),
    "lab_round_trip": q(f"SELECT {b('r', 'g', 'b', 'r AS r2', 'g AS g2', 'b AS b2')} FROM col", _COL),
    "delta_e2000_pairs": q(f"SELECT {b('image_id', 'i', 'j')}, {r6('de')} FROM pd", _PAIRS, de2000("pr", "pd", ("l1", "a1", "b1"), ("l2", "a2", "b2"))),
    "delta_e76_pairs": q(f"SELECT {b('image_id', 'i', 'j')}, round(sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2)), 6) AS de FROM pr", _PAIRS),
    "composite_gray": q(f"SELECT {b('image_id', 'y', 'x')}, round({_white()[0]}, 6) AS wr, round({_white()[1]}, 6) AS wg, round({_white()[2]}, 6) AS wb, round({_gray()}, 6) AS gray, a >= 128 AS is_opaque FROM px"),
    "unique_color_histogram": q(f"SELECT {b('image_id', 'code', 'n')}, {r6('share')}, {b('rank')} FROM hist", _HIST),
    "coarse_bins_colors95": q(f"SELECT {b('image_id', 'n_colors', 'colors_95')} FROM bins", _BINS),
    "lab_grid_collapse": q(
        f"SELECT {b('image_id')}, CAST(round_even(l/8, 0) AS BIGINT) AS kl, CAST(round_even(la/8, 0) AS BIGINT) AS ka, CAST(round_even(lb/8, 0) AS BIGINT) AS kb, CAST(sum(n) AS BIGINT) AS w, round(sum(l*n)/sum(n), 6) AS l, round(sum(la*n)/sum(n), 6) AS la, round(sum(lb*n)/sum(n), 6) AS lb FROM gl GROUP BY ALL",
        "gc AS (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL)",
        lab("gc", "gl"),
    ),
    "lower_median_color": q(f"SELECT {b('image_id', 'label')}, CAST(quantile_disc(r, 0.5) AS BIGINT) AS r, CAST(quantile_disc(g, 0.5) AS BIGINT) AS g, CAST(quantile_disc(b, 0.5) AS BIGINT) AS b FROM px GROUP BY ALL"),
    "np_median_color": q(f"SELECT {b('image_id', 'label')}, round(quantile_cont(r::DOUBLE, 0.5), 6) AS r, round(quantile_cont(g::DOUBLE, 0.5), 6) AS g, round(quantile_cont(b::DOUBLE, 0.5), 6) AS b FROM px GROUP BY ALL"),
    "p95_delta": q(
        f"SELECT {b('image_id')}, round(quantile_cont(de, 0.95), 6) AS p95 FROM wd GROUP BY ALL",
        _INNER,
        f"wc AS (SELECT image_id, y, x, 255*{_white()[0]} AS wr, 255*{_white()[1]} AS wg, 255*{_white()[2]} AS wb, 255*{_white('p')[0]} AS vr, 255*{_white('p')[1]} AS vg, 255*{_white('p')[2]} AS vb FROM inn WHERE inside)",
        lab("wc", "w1", "wr", "wg", "wb", ("l1", "a1", "b1")),
        lab("w1", "w2", "vr", "vg", "vb", ("l2", "a2", "b2")),
        de2000("w2", "wd", ("l1", "a1", "b1"), ("l2", "a2", "b2")),
    ),
    "stride_sample": q(f"SELECT {b('image_id', 'y', 'x', 'label', 'r', 'g', 'b', 'a')} FROM st WHERE k % CAST(ceil(n/10) AS BIGINT) = 0", "st AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n, row_number() OVER (PARTITION BY image_id, label ORDER BY y, x) - 1 AS k FROM px)"),
    "border_background_all": q(f"SELECT {b('image_id', 'label', 'n', 'total')} FROM bg", _BG),
    "border_background_opaque": q(
        f"SELECT {b('image_id', 'label', 'n', 'total')} FROM o1 WHERE k = 1 AND n * 2 >= total",
        f"o0 AS (SELECT image_id, label, sum(CASE WHEN y IN (0, 19) AND x IN (0, 24) THEN 2 ELSE 1 END) AS n FROM px WHERE {_EDGE} AND a >= 128 GROUP BY ALL)",
        "o1 AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS total, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM o0)",
    ),
    "detect_background": q(f"SELECT {b('image_id')}, round(ml, 6) AS l, round(ma, 6) AS la, round(mb, 6) AS lb, round(avg(CASE WHEN sqrt(pow(l-ml,2)+pow(la-ma,2)+pow(lb-mb,2)) < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, avg(CASE WHEN sqrt(pow(l-ml,2)+pow(la-ma,2)+pow(lb-mb,2)) < 10 THEN 1.0::DOUBLE ELSE 0 END) >= 0.5 AS found FROM sk JOIN sm USING (image_id) GROUP BY image_id, ml, ma, mb", _DETECT),
    "dominant_color": q(f"SELECT {b('image_id')}, CAST(floor(quantile_cont(r::DOUBLE, 0.5)) AS BIGINT) AS r, CAST(floor(quantile_cont(g::DOUBLE, 0.5)) AS BIGINT) AS g, CAST(floor(quantile_cont(b::DOUBLE, 0.5)) AS BIGINT) AS b FROM db JOIN dk USING (image_id, bin) WHERE k = 1 GROUP BY ALL", _DOM),
    "nearest_center_rgb": q(f"SELECT {b('r', 'g', 'b', 'center', 'd2')} FROM nk WHERE k = 1", _COL, "nc AS (SELECT col.*, pal.label AS center, pow(col.r-pal.r,2)+pow(col.g-pal.g,2)+pow(col.b-pal.b,2) AS d2 FROM col CROSS JOIN pal)", "nk AS (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d2, center) AS k FROM nc)"),
    "nearest_center_embedding": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label),
d AS (SELECT e.vec_id, f.label AS center, round(list_sum([pow(CAST(e.embedding[i] AS DOUBLE) - CAST(f.c[i] AS DOUBLE), 2) FOR i IN range(1, len(e.embedding) + 1)]), 6) AS d2 FROM embeddings e CROSS JOIN f),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, center) AS n FROM d) SELECT vec_id, CAST(center AS BIGINT) AS center, d2 FROM k WHERE n = 1""",
    "palette_override_assign": q(
        f"SELECT {b('image_id', 'center', 'n')}, CAST(row_number() OVER (PARTITION BY image_id ORDER BY center) - 1 AS BIGINT) AS idx FROM (SELECT image_id, center, count(*) AS n FROM px JOIN ok USING (r, g, b) WHERE k = 1 AND a >= 128 GROUP BY ALL)",
        _COL,
        lab("col", "cl"),
        "ov(id, hr, hg, hb) AS (VALUES (0,255,255,255),(1,220,50,47),(2,38,139,210),(3,16,16,16))",
        lab("ov", "ol", "hr", "hg", "hb", ("ql", "qa", "qb")),
        "ok AS (SELECT r, g, b, id AS center, row_number() OVER (PARTITION BY r, g, b ORDER BY pow(l-ql,2)+pow(la-qa,2)+pow(lb-qb,2), id) AS k FROM cl CROSS JOIN ol)",
    ),
    "palette_table": q(f"SELECT {b('image_id', 'idx', 'label', 'r', 'g', 'b')}, hex, {b('n')}, is_background, name FROM tb", _TABLE),
    "palette_remap": q(f"SELECT {b('px.image_id', 'px.y', 'px.x', 'coalesce(tb.idx, -1) AS idx')} FROM px LEFT JOIN tb ON tb.image_id = px.image_id AND tb.label = px.label", _TABLE),
    "gt_palette_match": q(f"SELECT {b('image_id')}, truth, {b('idx')}, de FROM (SELECT *, row_number() OVER (PARTITION BY image_id, truth ORDER BY de, idx) AS k FROM td) WHERE k = 1", _TRUTH),
    "gt_palette_unmatched_anti": q(f"SELECT {b('image_id')}, 'missing' AS kind, truth AS hex FROM td GROUP BY image_id, truth HAVING min(de) >= 3 UNION ALL SELECT CAST(image_id AS BIGINT), 'extra', hex FROM td GROUP BY image_id, hex HAVING min(de) >= 3", _TRUTH),
    "uncovered_regions_anti": q(f"SELECT {b('s.image_id', 's.label', 's.n')} FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS t FROM (SELECT image_id, label, count(*) AS n FROM px WHERE a >= 128 GROUP BY ALL)) s ANTI JOIN lay ON lay.image_id = s.image_id AND lay.label = s.label WHERE s.n >= 0.005::DOUBLE * s.t", _LAYERS),
    "kmeans_fixed_iters": "WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, e0, e1, e2 FROM p QUALIFY cluster < 4)"
    + "".join(
        f""", n{i} AS (SELECT p.*, c.cluster, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.e0-c.e0,2)+pow(p.e1-c.e1,2)+pow(p.e2-c.e2,2), c.cluster) AS k FROM p CROSS JOIN c{i} c),
s{i} AS (SELECT cluster, count(*) AS n, avg(e0) AS e0, avg(e1) AS e1, avg(e2) AS e2 FROM n{i} WHERE k = 1 GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(s.e0, c.e0) AS e0, coalesce(s.e1, c.e1) AS e1, coalesce(s.e2, c.e2) AS e2 FROM c{i} c LEFT JOIN s{i} s USING (cluster))"""
        for i in range(3)
    )
    + " SELECT CAST(cluster AS BIGINT) AS cluster, n, round(e0, 4) AS e0, round(e1, 4) AS e1, round(e2, 4) AS e2 FROM s2",
    "blend_triples": q(
        f"SELECT {b('image_id', 'c', 'a', 'b')}, {r6('t', 'de')} FROM (SELECT *, sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2)) AS de FROM m2) WHERE de < 6",
        _HIST,
        "tp AS (SELECT image_id, rank - 1 AS idx, (code >> 16)::DOUBLE AS r, ((code >> 8) & 255)::DOUBLE AS g, (code & 255)::DOUBLE AS b FROM hist)",
        """t3 AS (SELECT c.image_id, c.idx AS c, a.idx AS a, x.idx AS b, c.r AS cr, c.g AS cg, c.b AS cb, x.r AS br, x.g AS bg_, x.b AS bb, a.r-x.r AS sr, a.g-x.g AS sg, a.b-x.b AS sb
 FROM tp c JOIN tp a ON a.image_id = c.image_id AND a.idx <> c.idx JOIN tp x ON x.image_id = c.image_id AND a.idx < x.idx AND x.idx <> c.idx)""",
        "t4 AS (SELECT *, ((cr-br)*sr+(cg-bg_)*sg+(cb-bb)*sb)/(sr*sr+sg*sg+sb*sb) AS t FROM t3 WHERE sr*sr+sg*sg+sb*sb > 0)",
        "t5 AS (SELECT *, least(255,greatest(0,round_even(br+t*sr,0))) AS mr, least(255,greatest(0,round_even(bg_+t*sg,0))) AS mg, least(255,greatest(0,round_even(bb+t*sb,0))) AS mb FROM t4 WHERE t BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE)",
        lab("t5", "m1", "mr", "mg", "mb", ("l1", "a1", "b1")),
        lab("m1", "m2", "cr", "cg", "cb", ("l2", "a2", "b2")),
    ),
    "mixed_pixel_mask": q(f"SELECT {b('image_id', 'y', 'x')} FROM px p WHERE a >= 128 AND ({_MIXED})"),
    "erosion_survival": q(f"SELECT {b('image_id', 'label')}, count(*) AS n, round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0 END), 6) AS survival FROM es GROUP BY ALL", f"es AS (SELECT p.image_id, p.label, p.y, p.x, bool_and(n.label = p.label) AS same FROM px p JOIN {_NEAR.format('px')} GROUP BY ALL)"),
    "interior_gap_iou": q(f"SELECT {b('image_id', 'interior', 'gap')}, {r6('gap_ratio', 'iou')} FROM gaps", _GAPS),
    "neighbor_count_endpoints": q(f"SELECT {b('p.image_id', 'p.y', 'p.x')}, CAST(sum(n.noisy::INT) - 1 AS BIGINT) AS n, sum(n.noisy::INT) = 2 AS is_end FROM nz p JOIN {_NEAR.format('nz')} WHERE p.noisy GROUP BY p.image_id, p.y, p.x", _NOISY),
    "seam_mask": q(f"SELECT {b('image_id', 'y', 'x')} FROM (SELECT *, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS rt, lead(label) OVER (PARTITION BY image_id, x ORDER BY y) AS dn FROM px) WHERE coalesce(rt <> label, false) OR coalesce(dn <> label, false)"),
    "noise_sigma": q(
        f"SELECT {b('i.image_id')}, round(coalesce(sqrt(pi()/2)/6 * avg(lap), 0), 6) AS sigma FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN nn ON nn.image_id = i.image_id AND slope < 48 GROUP BY i.image_id",
        f"gr AS (SELECT image_id, y, x, {_LUMA} AS v FROM px)",
        "n9 AS (SELECT p.image_id, p.y, p.x, count(*) AS n, abs(sum(n.v * CASE WHEN n.y = p.y AND n.x = p.x THEN 4 WHEN n.y = p.y OR n.x = p.x THEN -2 ELSE 1 END)) AS lap, abs(sum(n.v * (n.x - p.x) * CASE WHEN n.y = p.y THEN 2 ELSE 1 END)) + abs(sum(n.v * (n.y - p.y) * CASE WHEN n.x = p.x THEN 2 ELSE 1 END)) AS slope FROM gr p JOIN "
        + _NEAR.format("gr")
        + " GROUP BY ALL)",
        "nn AS (SELECT * FROM n9 WHERE n = 9)",
    ),
    "connected_components": q(f"SELECT {b('image_id', 'y', 'x', 'label', 'comp')} FROM cc", _COMPS.format("px"), recursive=True),
    "component_stats": q(f"SELECT {b('image_id', 'label', 'comp', 'area', 'y0', 'x0', 'y1', 'x1')} FROM cst", _COMPS.format("px"), recursive=True),
    "component_stats_ink_extent": q(f"SELECT {b('image_id')}, round(sum(area*sqrt(pow(x1-x0+1,2)+pow(y1-y0+1,2)))/sum(area)/sqrt(1025), 6) AS ink_extent FROM cst GROUP BY ALL", "inked AS (SELECT * FROM px WHERE label <> 0)", _COMPS.format("inked"), recursive=True),
    "speckle_target_first": q(
        f"SELECT {b('image_id', 'comp', 'target', 'cost')} FROM (SELECT *, row_number() OVER (PARTITION BY image_id, comp ORDER BY cost, target) AS k FROM sp) WHERE k = 1",
        _COMPS.format("px"),
        "med AS (SELECT image_id, label, quantile_disc(r, 0.5) AS r, quantile_disc(g, 0.5) AS g, quantile_disc(b, 0.5) AS b FROM px GROUP BY ALL)",
        "sz AS (SELECT cc.*, area FROM cc JOIN cst USING (image_id, comp))",
        "sp AS (SELECT DISTINCT p.image_id, p.comp, n.label AS target, pow(o.r-t.r,2)+pow(o.g-t.g,2)+pow(o.b-t.b,2) AS cost FROM sz p JOIN " + _NEAR.format("sz") + " AND p.area < 30 AND n.area >= 30 JOIN med o ON o.image_id = p.image_id AND o.label = p.label JOIN med t ON t.image_id = p.image_id AND t.label = n.label)",
        recursive=True,
    ),
    "label_rectangles": q(f"SELECT {b('image_id', 'label', 'x0', 'y0', 'x1', 'y1')} FROM rects", _RECTS.format("px")),
    "layer_plan_order": q(f"SELECT {b('image_id', 'label', 'n')}, is_background, is_line, {b('z')} FROM plan", _PLAN.format(_TABLE, "(label = 2)")),
    "line_colors": q(f"SELECT {b('image_id', 'label', 'n')} FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS t FROM (SELECT image_id, label, count(*) AS n FROM nz WHERE noisy GROUP BY ALL)) WHERE n >= 0.05::DOUBLE * t", _NOISY),
    "rect_paths_nodecount": q(f"SELECT {b('image_id', 'label', 'path_no')}, d, {b('n_rects', 'n_rects * 4 AS n_nodes')} FROM paths", _PATHS),
    "path_token_parse": q(
        f"SELECT {b('image_id', 'label', 'path_no')}, CAST(len(regexp_extract_all(d, '[MLCZ]|[0-9.]+')) AS BIGINT) AS n_tokens, list_max([CAST(t AS DOUBLE) FOR t IN regexp_extract_all(d, '[0-9]+')]) AS largest, true AS is_path, true AS all_integer, array_to_string(regexp_extract_all(d, '[MLCZ]|[0-9]+'), ' ') AS rounded FROM paths",
        _PATHS,
    ),
    "scanline_fill": q(f"SELECT {b('image_id', 'y', 'x', 'label')} FROM px"),
    "composite_layers": q(
        f"SELECT {b('px.image_id', 'px.y', 'px.x')}, CAST(arg_max(bx.label, bx.z) AS BIGINT) AS label, CAST(max(bx.z) AS BIGINT) AS z FROM px JOIN bx ON bx.image_id = px.image_id AND px.y BETWEEN bx.y0 AND bx.y1 AND px.x BETWEEN bx.x0 AND bx.x1 GROUP BY px.image_id, px.y, px.x",
        _PLAN.format(_TABLE, "false"),
        "bx AS (SELECT plan.image_id, plan.label, plan.z, e.x0, e.y0, e.x1, e.y1 FROM plan JOIN (SELECT image_id, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px GROUP BY ALL) e USING (image_id, label))",
    ),
    "alpha_blend_layers": q(
        "SELECT CAST(image_id AS BIGINT) AS image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, "
        + ", ".join(f"round((0.5::DOUBLE*t{c}/255 + 0.5::DOUBLE*(o{c}/255.0::DOUBLE)*al)/(0.5::DOUBLE + 0.5::DOUBLE*al), 6) AS {c}" for c in "rgb")
        + ", round(0.5::DOUBLE + 0.5::DOUBLE*al, 6) AS a FROM ab",
        "ab AS (SELECT px.image_id, y, x, px.r AS og, px.r AS or_, pal.r AS tr, pal.g AS tg, pal.b AS tb, px.a/255.0::DOUBLE AS al, px.g AS og2, px.b AS ob FROM px JOIN pal ON pal.label = px.y % 6)",
    ).replace("(og/255", "(og2/255").replace("(or/255", "(or_/255"),
    "region_delta_e": q(f"SELECT {b('image_id', 'label', 'n')}, round(de, 6) AS delta_e FROM rde", _REGION),
    "quality_checks": q(f"SELECT {b('image_id')}, name, {r6('value', 'threshold')}, comparator, passed FROM chk", _CHECKS),
    "failed_checks": q(f"SELECT {b('image_id')}, bool_and(passed) AS passed, coalesce(string_agg(CASE WHEN NOT passed THEN name END, ',' ORDER BY name), '') AS failed FROM chk GROUP BY image_id", _CHECKS),
    "corruption_flip": q(
        f"SELECT {b('image_id')}, CASE WHEN gap_ > 0.0005::DOUBLE * inner_ AND iou_ < 0.98::DOUBLE * an_ THEN 'alpha_iou,gap_ratio' WHEN gap_ > 0.0005::DOUBLE * inner_ THEN 'gap_ratio' WHEN iou_ < 0.98::DOUBLE * an_ THEN 'alpha_iou' ELSE '' END AS flipped FROM cf",
        "lg AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) AS k FROM px WHERE a >= 128 GROUP BY image_id, label)",
        _INNER,
        "cf AS (SELECT inn.image_id, sum((inside AND inn.label = lg.label)::INT) AS gap_, sum(inside::INT) AS inner_, sum((a >= 128 AND inn.label <> lg.label)::INT) AS iou_, sum((a >= 128)::INT) AS an_ FROM inn JOIN lg ON lg.image_id = inn.image_id AND k = 1 GROUP BY inn.image_id)",
    ),
    "palette_constraint_violations": q(
        """SELECT CAST(image_id AS BIGINT) AS image_id, problem, CAST(n AS BIGINT) AS n FROM (
SELECT image_id, 'count_differs' AS problem, count(*) AS n FROM tb WHERE image_id % 3 = 1 AND idx = 0 GROUP BY image_id
UNION ALL SELECT image_id, 'unknown_label', 1 FROM (SELECT image_id FROM tb WHERE image_id % 3 = 0 AND idx = 1)
UNION ALL SELECT image_id, 'index_not_dense', 1 FROM tb WHERE image_id % 3 = 0 GROUP BY image_id HAVING count(*) > 2
UNION ALL SELECT image_id, 'unknown_label', count(*) FROM (SELECT DISTINCT image_id FROM px WHERE a >= 128 AND image_id % 3 = 0) z WHERE false GROUP BY image_id)""",
        _TABLE,
    ),
    "class_scores": q(f"SELECT {b('image_id')}, {r6('p_mixed', 'p_line_art', 'p_flat_color')}, CASE WHEN p_flat_color >= greatest(p_mixed, p_line_art) THEN 'flat_color' WHEN p_line_art >= p_mixed THEN 'line_art' ELSE 'mixed' END AS label, round(greatest(p_mixed, p_line_art, p_flat_color), 6) AS confidence FROM cs", _CLASS),
    "ssim_window": q(f"SELECT {b('image_id')}, {_SSIM_VALUE} AS ssim FROM sw GROUP BY ALL", _SSIM),
    "area_resize": q(f"SELECT {b('image_id')}, CAST(y // 5 AS BIGINT) AS y, CAST(x // 5 AS BIGINT) AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, round(avg(a), 6) AS a FROM px GROUP BY image_id, y // 5, x // 5"),
    "nearest_resize": q(f"SELECT {b('image_id', 'ty AS y', 'tx AS x', 'label')} FROM px JOIN (SELECT range AS ty FROM range(32)) ON y = CAST(floor((ty + 0.5::DOUBLE)*20/32) AS BIGINT) JOIN (SELECT range AS tx FROM range(40)) ON x = CAST(floor((tx + 0.5::DOUBLE)*25/40) AS BIGINT)"),
    "morphological_opening": q(
        f"SELECT DISTINCT {b('p.image_id', 'p.y', 'p.x')} FROM px p JOIN er n ON n.image_id = p.image_id AND n.y BETWEEN p.y-2 AND p.y+2 AND n.x BETWEEN p.x-2 AND p.x+2",
        "er AS (SELECT p.image_id, p.y, p.x FROM px p JOIN px n ON n.image_id = p.image_id AND n.y BETWEEN p.y-2 AND p.y+2 AND n.x BETWEEN p.x-2 AND p.x+2 GROUP BY ALL HAVING bool_and(n.label >= 3))",
    ),
    "svg_documents": q(f"SELECT {b('image_id', 'length(svg) AS size')}, md5(svg) AS digest FROM doc", _DOCS),
    "svg_structure_check": q(
        """SELECT CAST(image_id AS BIGINT) AS image_id, unnest(CASE image_id % 3 WHEN 0 THEN ['forbidden_element', 'forbidden_attribute', 'nothing_drawn'] WHEN 1 THEN ['no_root', 'view_box'] ELSE [] END) AS problem FROM doc""",
        _DOCS,
    ),
    "eps_structure_check": q(
        """SELECT CAST(image_id AS BIGINT) AS image_id, n AS name, CASE WHEN n = 'graphics_state' AND image_id % 4 = 0 THEN 'fail' WHEN n = 'no_raster' AND image_id % 4 = 0 THEN 'fail' WHEN n = 'canvas' AND image_id % 4 = 1 THEN 'warn' ELSE 'pass' END AS status
FROM doc CROSS JOIN (SELECT unnest(['header','bounding_box','terminator','graphics_state','canvas','vector','no_raster']) AS n)""",
        _DOCS,
    ),
    "pdf_documents": q(f"SELECT {b('image_id')}, string_agg(id, ',' ORDER BY z) AS layers FROM lyr GROUP BY image_id", _DOCS),
    "forbidden_markup": r"""SELECT page_id, regexp_matches(html, '(?i)<(?:script|style|iframe|object|embed)\b') AS element, regexp_matches(html, '(?i)\s(?:on[a-z]+|href|xlink:href|style)\s*=') AS attribute, CAST(len(regexp_extract_all(html, 'href="([^"]*)"')) AS BIGINT) AS n_links FROM pages""",
    "settings_parse": """WITH s AS (SELECT event_id, event_id % 7 = 0 AS raw, user_id % 130 AS sm, CASE WHEN event_id % 2 = 0 THEN event_id % 80 END AS mc, event_id % 3 AS f FROM events)
SELECT event_id, 'auto' AS mode, CAST(CASE WHEN raw THEN 0 ELSE coalesce(mc, 0) END AS BIGINT) AS max_colors, 'medium' AS detail_level, CAST(CASE WHEN raw THEN 50 ELSE sm END AS BIGINT) AS smoothing, CASE WHEN raw THEN '' ELSE '#aabbcc,#000000' END AS palette,
CASE WHEN raw OR f = 2 THEN 'svg' WHEN f = 0 THEN 'svg,eps' ELSE 'svg,ai' END AS formats,
CASE WHEN raw THEN 'k: unknown field' ELSE concat_ws(';', CASE WHEN mc NOT BETWEEN 2 AND 64 THEN 'max_colors: invalid' END, CASE WHEN sm > 100 THEN 'smoothing: invalid' END) END AS errors FROM s""",
    "job_latest_state": f"WITH {_LATEST} SELECT job_id, status, stage, created, updated, progress, n_updates FROM latest",
    "job_ttl_sweep": f"""WITH {_LATEST}, nw AS (SELECT max(ts) - 3600000000 AS t FROM log), x AS (SELECT latest.*, t, CASE WHEN status IN ('succeeded', 'failed') THEN updated ELSE t END + 600000000 AS expires FROM latest CROSS JOIN nw)
SELECT job_id, status, updated, expires FROM x WHERE expires <= t""",
    "job_fail_unfinished": f"WITH {_LATEST} SELECT job_id, CASE WHEN status IN ('succeeded', 'failed') THEN status ELSE 'failed' END AS status, CASE WHEN status IN ('succeeded', 'failed') THEN NULL ELSE 'restarted' END AS error FROM latest",
    "job_upsert": f"""WITH {_LOG}, h AS (SELECT job_id, status, stage, ts AS updated, event_id % 2 AS nw, row_number() OVER (PARTITION BY job_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS k FROM log),
m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated DESC, nw DESC) AS j FROM h WHERE k = 1) SELECT job_id, status, stage, updated FROM m WHERE j = 1""",
    "stage_status_counts": f"WITH {_LOG} SELECT stage, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("queued", "running", "succeeded", "failed")) + " FROM log GROUP BY stage",
    "bench_median": "SELECT user_id, event_type, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS runs FROM events GROUP BY ALL",
    "stage_time_top2": f"WITH {_LOG}, s AS (SELECT job_id, stage, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS seconds FROM log GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seconds DESC, stage) AS rank FROM s) SELECT job_id, stage, round(seconds, 6) AS seconds, rank FROM k WHERE rank <= 2",
    "layer_nearest_palette": q(
        f"SELECT {b('image_id', 'layer')}, CAST(CASE WHEN layer % 3 = 1 THEN 0 ELSE idx END AS BIGINT) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id, layer ORDER BY eq, rd_, idx) AS k FROM (SELECT *, CASE WHEN hex = chex THEN 0 ELSE 1 END AS eq, CASE WHEN hex = chex THEN 0 ELSE round(de, 9) END AS rd_ FROM lde)) WHERE k = 1",
        _TABLE,
        lab("tb", "tl"),
        f"ly AS (SELECT image_id, idx AS layer, r AS sr, CASE WHEN idx % 3 = 0 THEN g ELSE least(g + 3, 255) END AS sg, b AS sb FROM tb)",
        lab("ly", "lyl", "sr", "sg", "sb", ("ql", "qa", "qb")),
        "lj AS (SELECT lyl.image_id, layer, printf('#%02x%02x%02x', sr, sg, sb) AS chex, ql, qa, qb, tl.idx, tl.hex, tl.l, tl.la, tl.lb FROM lyl JOIN tl USING (image_id))",
        de2000("lj", "lde", ("ql", "qa", "qb"), ("l", "la", "lb")),
    ),
    "bezier_flatten": q(
        f"SELECT {b('image_id', 'label', 'k')}, round(pow(1-u,3)*x0 + 3*pow(1-u,2)*u*x0 + 3*(1-u)*u*u*x1 + u*u*u*x1, 6) AS bx, round(pow(1-u,3)*y0 + 3*pow(1-u,2)*u*y1 + 3*(1-u)*u*u*y0 + u*u*u*y1, 6) AS by FROM bz",
        "bz AS (SELECT e.*, range AS k, range/8.0::DOUBLE AS u FROM (SELECT image_id, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY ALL) e CROSS JOIN range(9))",
    ),
    "arc_length": q(
        f"SELECT {b('image_id', 'label', 'y', 'x')}, round(CASE WHEN max(s) OVER (PARTITION BY image_id, label) > 0 THEN s / max(s) OVER (PARTITION BY image_id, label) ELSE 0 END, 6) AS t FROM a2",
        "a1 AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS st FROM px WINDOW w AS (PARTITION BY image_id, label ORDER BY y, x))",
        "a2 AS (SELECT *, sum(st) OVER (PARTITION BY image_id, label ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS s FROM a1)",
    ),
    "number_format": f"""WITH n AS (SELECT event_id, user_id, CAST(round_even((event_id % 4001 - 2000)/16.0::DOUBLE*100, 0) AS BIGINT) AS k, event_id * 977 AS z FROM events)
SELECT event_id, {_NUM.format('k')} AS number, CASE WHEN z < 1024 THEN printf('%d B', z) WHEN z < 1048576 THEN (z*10*2+1024)//2048//10 || '.' || (z*10*2+1024)//2048%10 || ' KB' ELSE (z*10*2+1048576)//2097152//10 || '.' || (z*10*2+1048576)//2097152%10 || ' MB' END AS size,
round(greatest(0.5::DOUBLE, round_even((event_id % 97)/7.0::DOUBLE/2.0::DOUBLE/0.5::DOUBLE, 0)*0.5::DOUBLE), 6) AS stroke, round(least(CASE WHEN least(event_id % 3000 + 1, user_id*20+1) < 500 THEN 2.0::DOUBLE ELSE 1 END, 2048.0::DOUBLE/greatest(event_id % 3000 + 1, user_id*20+1)), 6) AS scale FROM n""",
    "fill_transparent": q(
        f"SELECT {b('image_id', 'y', 'x')}, CAST(coalesce(nr, r) AS BIGINT) AS r, CAST(coalesce(ng, g) AS BIGINT) AS g, CAST(coalesce(nb, b) AS BIGINT) AS b, CAST(a AS BIGINT) AS a FROM px LEFT JOIN ft USING (image_id, y, x)",
        "ft AS (SELECT image_id, y, x, nr, ng, nb FROM (SELECT p.image_id, p.y, p.x, o.r AS nr, o.g AS ng, o.b AS nb, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY pow(p.y-o.y,2)+pow(p.x-o.x,2), o.y, o.x) AS k FROM px p JOIN px o ON o.image_id = p.image_id AND p.a < 128 AND o.a >= 128) WHERE k = 1)",
    ),
    "distance_transform": q(
        f"SELECT {b('p.image_id', 'p.y', 'p.x')}, round(sqrt(least(coalesce(min(pow(p.y-o.y,2)+pow(p.x-o.x,2)), 1e9::DOUBLE), pow(least(p.y+1, 20-p.y, p.x+1, 25-p.x), 2))), 6) AS d FROM px p LEFT JOIN px o ON o.image_id = p.image_id AND o.label < 3 WHERE p.label >= 3 GROUP BY p.image_id, p.y, p.x"
    ),
    "otsu_threshold": q(
        f"SELECT {b('image_id')}, CAST(arg_max(v, round(CASE WHEN n > n0 THEN n0*(n-n0)*pow(s0/n0-(s-s0)/(n-n0), 2) ELSE -1 END, 3) * 1000000 - v) AS BIGINT) AS threshold FROM o2 GROUP BY ALL",
        f"o1 AS (SELECT image_id, {_LUMA} AS v, count(*)::DOUBLE AS k FROM px GROUP BY ALL)",
        "o2 AS (SELECT image_id, v, sum(k) OVER u AS n0, sum(k*v) OVER u AS s0, sum(k) OVER i AS n, sum(k*v) OVER i AS s FROM o1 WINDOW u AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), i AS (PARTITION BY image_id))",
    ),
    "line_art_stroke_mask": q(
        f"SELECT {b('m.image_id', 'm.y', 'm.x')} FROM mx m JOIN hi USING (image_id) WHERE m.a >= 128 AND (o <= 0.75::DOUBLE OR (s >= least(120, greatest(30, 0.35::DOUBLE*h)) AND s >= 0.5::DOUBLE*mm))",
        _DOM,
        "dc AS (SELECT image_id, floor(quantile_cont(r::DOUBLE, 0.5)) AS cr, floor(quantile_cont(g::DOUBLE, 0.5)) AS cg, floor(quantile_cont(b::DOUBLE, 0.5)) AS cb FROM db JOIN dk USING (image_id, bin) WHERE k = 1 GROUP BY ALL)",
        "ds AS (SELECT px.*, CASE WHEN a >= 128 THEN sqrt(pow(r-cr,2)+pow(g-cg,2)+pow(b-cb,2)) ELSE 0 END AS s FROM px JOIN dc USING (image_id))",
        "mx AS (SELECT p.image_id, p.y, p.x, p.a, p.s, max(n.s) AS mm FROM ds p JOIN " + _NEAR.format("ds") + " GROUP BY ALL)",
        "hi AS (SELECT image_id, quantile_cont(s, 0.9) FILTER (WHERE s > 20) AS h, avg(CASE WHEN a >= 128 THEN 1.0::DOUBLE ELSE 0 END) AS o FROM ds GROUP BY ALL)",
    ),
    "ink_color": q(f"SELECT {b('image_id', 'ir AS r', 'ig AS g', 'ib AS b')} FROM ic", _INK),
    "mixed_stroke_mask": q(
        f"SELECT {b('image_id', 'y', 'x')} FROM mi WHERE a >= 128 AND (t <= 60 OR (near AND t <= 0.5::DOUBLE*mm))",
        _INK,
        "it AS (SELECT px.*, CASE WHEN a >= 128 THEN sqrt(pow(r-ir,2)+pow(g-ig,2)+pow(b-ib,2)) ELSE 0 END AS t FROM px JOIN ic USING (image_id))",
        "mi AS (SELECT p.image_id, p.y, p.x, p.a, p.t, max(n.t) AS mm, bool_or(n.a >= 128 AND n.t <= 60) AS near FROM it p JOIN " + _NEAR.format("it") + " GROUP BY ALL)",
    ),
    "gradient_ramps": q(
        f"SELECT {b('image_id')}, round(avg(CASE WHEN n = 9 AND mina >= 128 AND s2 > 0.25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ramp FROM sl9 GROUP BY ALL",
        lab("px", "pl"),
        "cl5 AS (SELECT image_id, y // 5 AS y, x // 5 AS x, avg(l) AS l, avg(la) AS la, avg(lb) AS lb, min(a) AS a FROM pl GROUP BY image_id, y // 5, x // 5)",
        "sl9 AS (SELECT p.image_id, p.y, p.x, count(*) AS n, min(n.a) AS mina, "
        + " + ".join(f"pow(sum(n.{c} * (n.{d} - p.{d}) * CASE WHEN n.{e} = p.{e} THEN 2 ELSE 1 END)/8, 2)" for c in ("l", "la", "lb") for d, e in (("x", "y"), ("y", "x")))
        + " AS s2 FROM cl5 p JOIN "
        + _NEAR.format("cl5")
        + " GROUP BY p.image_id, p.y, p.x)",
    ),
    "final_colors": q(
        f"SELECT {b('image_id', 'label', 'np AS n_pure')}, CAST(quantile_disc(r, 0.5) AS BIGINT) AS r, CAST(quantile_disc(g, 0.5) AS BIGINT) AS g, CAST(quantile_disc(b, 0.5) AS BIGINT) AS b FROM f2 WHERE np < greatest(8, 0.02::DOUBLE*na) OR NOT mixed GROUP BY image_id, label, np",
        f"f1 AS (SELECT p.*, ({_MIXED}) AS mixed FROM px p WHERE a >= 128)",
        "f2 AS (SELECT *, sum((NOT mixed)::INT) OVER (PARTITION BY image_id, label) AS np, count(*) OVER (PARTITION BY image_id, label) AS na FROM f1)",
    ),
    "shift_colors": q(
        f"SELECT {b('image_id', 'idx')}, hex, printf('#%02x%02x%02x', {', '.join(_SRGB.format(m) for m in ('cr', 'cg', 'cb'))}) AS shifted FROM s5",
        _TABLE,
        lab("tb", "tl"),
        "s1 AS (SELECT image_id, idx, hex, la, lb, CASE WHEN l - 5 BETWEEN 0 AND 100 THEN l - 5 ELSE l + 5 END AS nl FROM tl)",
        "s2 AS (SELECT *, (nl+16)/116 AS fy, la/500 + (nl+16)/116 AS fx, greatest(0, (nl+16)/116 - lb/200) AS fz FROM s1)",
        "s3 AS (SELECT *, " + ", ".join(f"{w}::DOUBLE * CASE WHEN {f} > 0.2068966 THEN {f}*{f}*{f} ELSE ({f} - 16.0::DOUBLE/116)/7.787::DOUBLE END AS {n}" for w, f, n in (("0.95047", "fx", "xx"), ("1.0", "fy", "yy"), ("1.08883", "fz", "zz"))) + " FROM s2)",
        "s4 AS (SELECT *, 3.24048134::DOUBLE*xx - 1.53715152::DOUBLE*yy - 0.49853633::DOUBLE*zz AS cr, -0.96925495::DOUBLE*xx + 1.87599::DOUBLE*yy + 0.04155593::DOUBLE*zz AS cg, 0.05564664::DOUBLE*xx - 0.20404134::DOUBLE*yy + 1.05731107::DOUBLE*zz AS cb FROM s3)",
        "s5 AS (SELECT * FROM s4)",
    ),
    "drop_largest_layer": q(
        f"SELECT {b('p.image_id', 'p.label', 'p.path_no')} FROM paths p ANTI JOIN (SELECT image_id, label FROM big_ WHERE k = 1) g ON g.image_id = p.image_id AND g.label = p.label",
        _PATHS,
        _BG,
        "big_ AS (SELECT z.image_id, z.label, row_number() OVER (PARTITION BY z.image_id ORDER BY coalesce(bg.label <> z.label, true) DESC, z.s DESC, z.label) AS k FROM (SELECT image_id, label, sum(length(d)) AS s FROM paths GROUP BY ALL) z LEFT JOIN bg USING (image_id))",
    ),
    "ground_truth_widths": """WITH w AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 9)::DOUBLE WHEN event_id % 4 <> 0 THEN (event_id % 7 + event_id % 11 + event_id % 5 - greatest(event_id % 7, event_id % 11, event_id % 5) - least(event_id % 7, event_id % 11, event_id % 5))::DOUBLE END AS want, (event_id % 10)::DOUBLE AS got FROM events)
SELECT event_id, coalesce(want, -1) AS want, coalesce(abs(got - want) <= greatest(1, 0.25::DOUBLE*want), false) AS fits FROM w""",
    "upload_checks": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' ELSE 'none' END AS format, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'none' END AS media_type,
CASE WHEN doc_id % 4 > 1 THEN 'unsupported_media_type' WHEN n_chars::BIGINT * 10000 > 36000000 THEN 'too_many_pixels' ELSE 'ok' END AS error FROM documents""",
    "upload_names": """WITH n AS (SELECT page_id, coalesce(nullif(left(trim(regexp_extract(url, '[^/]*$')), 200), ''), 'upload') AS name FROM pages)
SELECT page_id, name, regexp_replace(name, '\\.[^.]*$', '') || '.svg' AS svg, regexp_replace(name, '\\.[^.]*$', '') || '_preview.png' AS preview, '/jobs/' || page_id || '/files/eps' AS link FROM n""",
    "typed_colours": """WITH n AS (SELECT event_id, printf('%06X', (event_id * 7919) % 16777216) AS six, printf('%03X', (event_id * 7919) % 16777216 % 4096) AS three FROM events),
t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '#' || six WHEN 1 THEN three WHEN 2 THEN ' #' || lower(three) || ' ' WHEN 3 THEN six || 'z' ELSE left(six, 4) END AS typed FROM n),
u AS (SELECT *, ltrim(lower(trim(typed)), '#') AS v FROM t),
w AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9a-f]{6}') THEN '#' || v WHEN regexp_full_match(v, '[0-9a-f]{3}') THEN '#' || v[1] || v[1] || v[2] || v[2] || v[3] || v[3] END AS hex FROM u),
c AS (SELECT *, CAST('0x' || hex[2:3] AS INT) / 255.0::DOUBLE AS r, CAST('0x' || hex[4:5] AS INT) / 255.0::DOUBLE AS g, CAST('0x' || hex[6:7] AS INT) / 255.0::DOUBLE AS b FROM w)
SELECT event_id, typed, hex, round(0.2126::DOUBLE * CASE WHEN r <= 0.03928 THEN r / 12.92::DOUBLE ELSE pow((r + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END
 + 0.7152::DOUBLE * CASE WHEN g <= 0.03928 THEN g / 12.92::DOUBLE ELSE pow((g + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END
 + 0.0722::DOUBLE * CASE WHEN b <= 0.03928 THEN b / 12.92::DOUBLE ELSE pow((b + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END, 6) AS luminance FROM c""",
    "poll_schedule": f"""WITH RECURSIVE {_LOG}, d(k, ms) AS (SELECT 1, 300 UNION ALL SELECT k + 1, CAST(least(2000, greatest(300, floor(ms * 1.5 + 0.5))) AS INT) FROM d WHERE ms < 2000),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM log)
SELECT event_id, job_id, n.k, status IN ('succeeded', 'failed') AS final, CAST(d.ms AS BIGINT) AS delay_ms FROM n JOIN d ON d.k = least(n.k, (SELECT max(k) FROM d))""",
    "metric_labels": """WITH m AS (SELECT event_id, (['ssim','alpha_iou','mean_delta_e','max_delta_e','gap_ratio','processing_time_s','svg_valid'])[event_id % 7 + 1] AS name, (event_id % 4096) / 1024.0::DOUBLE + 1.0::DOUBLE / 1048576 AS v FROM events)
SELECT event_id, name, CASE name WHEN 'ssim' THEN printf('%.3f', v) WHEN 'alpha_iou' THEN printf('%.3f', v) WHEN 'gap_ratio' THEN printf('%.5f', v) WHEN 'processing_time_s' THEN printf('%.2f s', v)
 WHEN 'svg_valid' THEN CASE WHEN v >= 1 THEN 'yes' ELSE 'no' END ELSE printf('%.2f', v) END AS label FROM m""",
    "media_types": """WITH f AS (SELECT event_id, 'scan' || user_id || (['.PNG','.jpg','.tar.jpeg','','.gif','.'])[event_id % 6 + 1] AS name, CASE event_id % 5 WHEN 0 THEN 'image/png' ELSE '' END AS said FROM events),
k AS (SELECT *, CASE WHEN said <> '' THEN said ELSE CASE lower(regexp_extract(name, '[^.]*$')) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE '' END END AS media_type FROM f)
SELECT event_id, name, media_type, media_type IN ('image/png', 'image/jpeg') AS accepted FROM k""",
    "layer_constraint_violations": q(
        f"SELECT {b('image_id', 'idx')}, bad_hex, bad_stroke, whole_canvas FROM v WHERE bad_hex OR bad_stroke OR whole_canvas",
        _TABLE,
        "v AS (SELECT image_id, idx, CASE WHEN idx % 3 = 1 THEN upper(hex) ELSE hex END <> hex AS bad_hex, (idx % 3 = 2) <> (idx % 2 = 0) AS bad_stroke, n = 500 AS whole_canvas FROM tb)",
    ),
    "path_edges": q(f"SELECT {b('image_id', 'z')}, {r6('ax AS x0', 'ay AS y0', 'cx AS x1', 'cy AS y1')}, implied FROM eg", _SHAPES),
    "curved_fill_coverage": q(f"SELECT {b('image_id', 'z', 'y', 'x')}, {r6('cover')} FROM cov", _SHAPES, _COVER),
    "stroke_coverage": q(
        f"SELECT {b('image_id', 'z', 'sy // 3 AS y', 'sx // 3 AS x')}, round(count(*) / 9.0::DOUBLE, 6) AS cover FROM (SELECT DISTINCT image_id, z, sy, sx FROM hit WHERE (xc-ax-t*dx)*(xc-ax-t*dx) + (yc-ay-t*dy)*(yc-ay-t*dy) <= rr*rr) GROUP BY image_id, z, sy // 3, sx // 3",
        _SHAPES,
        "sm AS (SELECT i.image_id, i.z, range // 75 AS sy, range % 75 AS sx, range // 75 + 0.5::DOUBLE AS yc, range % 75 + 0.5::DOUBLE AS xc FROM bx i CROSS JOIN range(4500))",
        "sg AS (SELECT image_id, z, 3*ax AS ax, 3*ay AS ay, 3*(cx-ax) AS dx, 3*(cy-ay) AS dy, (1.3::DOUBLE + z/7.0::DOUBLE)*1.5::DOUBLE AS rr FROM eg WHERE NOT implied)",
        "hit AS (SELECT sm.*, ax, ay, dx, dy, rr, CASE WHEN dx*dx + dy*dy = 0 THEN 0 ELSE least(1, greatest(0, ((xc-ax)*dx + (yc-ay)*dy)/(dx*dx + dy*dy))) END AS t FROM sm JOIN sg ON sg.image_id = sm.image_id AND sg.z = sm.z)",
    ),
    "rendered_layers": q(
        f"SELECT {b('image_id', 'y', 'x')}, " + ", ".join(f"round(CASE WHEN sum(al*ab) > 0 THEN sum(pal.{c}/255.0::DOUBLE*al*ab)/sum(al*ab) ELSE 0 END, 6) AS {c}" for c in "rgb") + ", round(sum(al*ab), 6) AS a FROM ov JOIN pal ON pal.label = ov.z GROUP BY image_id, y, x",
        _SHAPES,
        _COVER,
        "al AS (SELECT *, cover * CASE WHEN z % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS al FROM cov)",
        "ov AS (SELECT *, coalesce(product(1 - al) OVER (PARTITION BY image_id, y, x ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ab FROM al)",
    ),
    "rendered_rectangles": q(f"SELECT {b('px.image_id AS image_id', 'px.y AS y', 'px.x AS x', 'pal.r AS r', 'pal.g AS g', 'pal.b AS b', '255 AS a')} FROM px JOIN pal USING (label)"),
    "results_table": q(
        f"SELECT {b('rep.image_id AS image_id')}, " + ", ".join(f"CAST(round(CAST(round({c}, 6) AS DECIMAL(18,6)), {n}) AS VARCHAR) AS {c}" for c, n in (("ssim", 4), ("mean_de", 2), ("max_de", 2), ("gap_ratio", 5), ("iou", 4)))
        + ", CASE WHEN f.failed IS NULL THEN 'PASS' ELSE 'FAIL: ' || f.failed END AS verdict FROM rep LEFT JOIN (SELECT image_id, string_agg(name, ',' ORDER BY name) AS failed FROM chk WHERE NOT passed GROUP BY image_id) f ON f.image_id = rep.image_id",
        _CHECKS,
    ),
    "results_markdown": q(
        f"SELECT {b('image_id', 'k')}, line FROM (SELECT image_id, idx + 2 AS k, '| ' || idx || ' | ' || name || ' | ' || hex || ' | ' || n || ' |' AS line FROM tb"
        " UNION ALL SELECT DISTINCT image_id, 0, '| idx | name | hex | n |' FROM tb UNION ALL SELECT DISTINCT image_id, 1, '| --- | --- | --- | --- |' FROM tb)",
        _TABLE,
    ),
    "difference_images": q(
        f"SELECT {b('image_id', 'y', 'x', 'least(255, floor(greatest(abs(wr - vr), abs(wg - vg), abs(wb - vb)) * 1020.0::DOUBLE + 1e-9)) AS heat')}, "
        + ", ".join(f"CAST(CASE WHEN near THEN {v} ELSE floor((wr + wg + wb) / 3.0::DOUBLE * 160.0::DOUBLE + 60.0::DOUBLE + 1e-9) END AS BIGINT) AS g{c}" for c, v in zip("rgb", (255, 0, 255), strict=True))
        + " FROM (SELECT i.image_id, i.y, i.x, "
        + ", ".join(f"CASE WHEN i.a = 255 THEN i.{c}/255.0::DOUBLE ELSE 1.0::DOUBLE END AS w{c}, CASE WHEN i.pa = 255 THEN i.p{c}/255.0::DOUBLE ELSE 1.0::DOUBLE END AS v{c}" for c in "rgb")
        + ", EXISTS (SELECT 1 FROM inn n WHERE n.image_id = i.image_id AND n.inside AND n.pa < 128 AND n.y BETWEEN i.y-1 AND i.y+1 AND n.x BETWEEN i.x-1 AND i.x+1) AS near FROM inn i)",
        _INNER,
    ),
    "job_deletions": f"""WITH {_LOG}, ids AS (SELECT DISTINCT CASE WHEN event_id % 10 = 0 THEN job_id ELSE -job_id - 1 END AS job_id FROM log WHERE event_id % 10 < 2)
SELECT CAST(job_id AS BIGINT) AS job_id, job_id IN (SELECT job_id FROM log) AS existed, (SELECT count(*) FROM log WHERE job_id NOT IN (SELECT job_id FROM ids)) AS updates_left FROM ids""",
    "job_cancellations": f"WITH {_LATEST} SELECT CAST(job_id AS BIGINT) AS job_id, status, status = 'queued' AS cancelled FROM latest",
    "new_jobs": "SELECT CAST(event_id AS BIGINT) AS job_id, 'queued' AS status, 'load' AS stage, 0.0::DOUBLE AS progress, epoch_us(ts) AS created, epoch_us(ts) + 3600000000 AS expires FROM events",
    "environment_settings": """WITH s AS (SELECT event_id, user_id, (['MAX_WORKERS','JOB_TTL_SECONDS','CLEANUP_INTERVAL_SECONDS','MAX_UPLOAD_BYTES','MAX_PLAYERS'])[event_id % 5 + 1] AS name, ([2, 3600, 60, 20971520, NULL])[event_id % 5 + 1] AS usual, event_id % 6 AS kind FROM events),
v AS (SELECT *, CASE kind WHEN 0 THEN user_id WHEN 3 THEN -user_id WHEN 5 THEN 0 END AS number FROM s),
e AS (SELECT *, CASE WHEN name = 'MAX_PLAYERS' THEN 'unknown setting' WHEN kind = 2 THEN 'not an integer' WHEN number < 1 THEN 'must be at least 1' ELSE '' END AS error FROM v)
SELECT CAST(event_id AS BIGINT) AS event_id, name, CAST(CASE WHEN error = '' THEN coalesce(number, usual) END AS BIGINT) AS value, error FROM e""",
}
