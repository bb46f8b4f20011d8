"""SQL texts for neighbourhood operators, used only to check results."""

from ..operators.grid import _row_widths, gaussian_weights


def reflect(pos: str, n: str) -> str:
    m = f"((({pos}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)))"
    return f"(CASE WHEN {n} = 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE 2 * ({n} - 1) - {m} END)"


def gauss(name: str, src: str, value: str, weights=None, sigma: float | None = None, canv: str = "canvases") -> str:
    """CTEs ``name`` (image_id, y, x, value): separable smoothing of ``src``."""
    w = weights or gaussian_weights(sigma)
    r = len(w) // 2
    taps = ", ".join(f"({i - r}, {v!r}::DOUBLE)" for i, v in enumerate(w))
    return f"""{name}_w(i, wt) AS (VALUES {taps}),
{name}_h AS (SELECT p.image_id, p.y, p.x, sum(t.wt * q.{value}) AS {value} FROM (SELECT s.image_id, s.y, s.x, c.w FROM {src} s JOIN {canv} c USING (image_id)) p CROSS JOIN {name}_w t
 JOIN {src} q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {reflect('p.x + t.i', 'p.w')} GROUP BY 1, 2, 3),
{name} AS (SELECT p.image_id, p.y, p.x, sum(t.wt * q.{value}) AS {value} FROM (SELECT s.image_id, s.y, s.x, c.h FROM {src} s JOIN {canv} c USING (image_id)) p CROSS JOIN {name}_w t
 JOIN {name}_h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {reflect('p.y + t.i', 'p.h')} GROUP BY 1, 2, 3)"""


def _kernel(name: str, offsets) -> str:
    return f"{name}_k(dy, dx) AS (VALUES {', '.join(f'({a}, {b})' for a, b in offsets)})"


def rect(kh: int, kw: int):
    return [(a, b) for a in range(-(kh // 2), kh - kh // 2) for b in range(-(kw // 2), kw - kw // 2)]


def ellipse(k: int):
    return [(dy, dx) for dy, wid in _row_widths(k).items() for dx in range(-wid, wid + 1)]


def dilate(name: str, src: str, offsets, keys: str = "image_id, layer", canv: str = "canvases") -> str:
    ks = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""{_kernel(name, offsets)}, {name} AS (SELECT DISTINCT {ks}, CAST(m.y - k.dy AS INT) AS y, CAST(m.x - k.dx AS INT) AS x FROM {src} m JOIN {canv} c ON c.image_id = m.image_id CROSS JOIN {name}_k k
 WHERE m.y - k.dy BETWEEN 0 AND c.h - 1 AND m.x - k.dx BETWEEN 0 AND c.w - 1)"""


def erode(name: str, src: str, offsets, keys: str = "image_id, layer", canv: str = "canvases") -> str:
    """A pixel stays when no kernel offset inside the canvas is missing."""
    ks = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    eq = " AND ".join(f"o.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""{_kernel(name, offsets)}, {name} AS (SELECT {ks}, m.y, m.x FROM {src} m JOIN {canv} c ON c.image_id = m.image_id CROSS JOIN {name}_k k
 LEFT JOIN {src} o ON {eq} AND o.y = m.y + k.dy AND o.x = m.x + k.dx
 WHERE m.y + k.dy BETWEEN 0 AND c.h - 1 AND m.x + k.dx BETWEEN 0 AND c.w - 1 GROUP BY ALL HAVING count(*) FILTER (o.y IS NULL) = 0)"""


def closing(name, src, offsets, **kw):
    return dilate(f"{name}_d", src, offsets, **kw) + ", " + erode(name, f"{name}_d", offsets, **kw)


def opening(name, src, offsets, **kw):
    return erode(f"{name}_e", src, offsets, **kw) + ", " + dilate(name, f"{name}_e", offsets, **kw)


def components(name: str, src: str, keys: str = "image_id, layer", diagonal: bool = True) -> str:
    """CTE ``name`` (keys, y, x, label): reachability over the neighbour graph; needs WITH RECURSIVE."""
    ks = [k.strip() for k in keys.split(",")]
    part = ", ".join(f"a.{k}" for k in ks)
    eq = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    sel = ", ".join(ks)
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    code = "(CAST({0}.y AS BIGINT) * 16777216 + {0}.x)"
    return f"""{name}_n AS (SELECT {part}, {code.format('a')} AS u, {code.format('b')} AS v FROM {src} a JOIN {src} b ON {eq} AND b.y IN (a.y - 1, a.y, a.y + 1) AND b.x IN (a.x - 1, a.x, a.x + 1) AND {near}),
{name}_r AS (SELECT {sel}, u, u AS root FROM {name}_n WHERE u = v UNION SELECT r.{', r.'.join(ks)}, n.v, r.root FROM {name}_r r JOIN {name}_n n ON n.u = r.u AND n.v > r.root AND {' AND '.join(f'n.{k} = r.{k}' for k in ks)}),
{name} AS (SELECT {sel}, CAST(u // 16777216 AS INT) AS y, CAST(u % 16777216 AS INT) AS x, min(root) AS label FROM {name}_r GROUP BY {sel}, u)"""


def stats(name: str, src: str, keys: str = "image_id, layer") -> str:
    return f"""{name} AS (SELECT {keys}, label, count(*) AS area, min(x) AS lft, min(y) AS top, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, avg(x) AS cx, avg(y) AS cy FROM {src} GROUP BY {keys}, label)"""
