"""SQL of the planes' windowed spectra: the two halves' mean power by kind and shell, as table ab(kind, j, a, b)."""

from __future__ import annotations

from windloom.operators import spectra
from windloom.sources.views import CELLS_SQL

_W = spectra.kaiser2d(8, 8)
WINDOWED_SQL = f"""{CELLS_SQL}, wt(y, x, wgt) as (values {", ".join(f"({y}, {x}, {float(_W[y, x])!r}::double)" for y in range(8) for x in range(8))}),
 c as (select s, c.y, c.x, (u - avg(u) over (partition by s)) * wgt as u, (v - avg(v) over (partition by s)) * wgt as v from cells c join wt on wt.y = c.y and wt.x = c.x),
 w as (select ky, kx, (case when ky < 4 then ky else ky - 8 end) / 8.0 as fy, (case when kx < 4 then kx else kx - 8 end) / 8.0 as fx from (select unnest(range(8)) as ky), (select unnest(range(8)) as kx)),
 f as (select s, fy, fx, sum(u * cos(2*pi()*(ky*y + kx*x)/8.0)) as uc, sum(u * sin(2*pi()*(ky*y + kx*x)/8.0)) as us, sum(v * cos(2*pi()*(ky*y + kx*x)/8.0)) as vc, sum(v * sin(2*pi()*(ky*y + kx*x)/8.0)) as vs from c, w group by 1, 2, 3),
 e as (select s, floor(sqrt(fy*fy + fx*fx) * 8 - 0.5) as j, unnest([{{'kind': 'E', 'p': 0.5 * (uc*uc + us*us + vc*vc + vs*vs)}}, {{'kind': 'div', 'p': 4*pi()*pi() * (pow(fx*uc + fy*vc, 2) + pow(fx*us + fy*vs, 2))}}, {{'kind': 'vort', 'p': 4*pi()*pi() * (pow(fx*vc - fy*uc, 2) + pow(fx*vs - fy*us, 2))}}]) as k from f),
 sp as (select s, j, k.kind as kind, avg(k.p) / 64 as p from e where j >= 0 and j < 4 group by 1, 2, 3),
 ms as (select s % 2 as side, kind, j, exp(avg(ln(p + 1e-30))) as p from sp group by 1, 2, 3),
 ab as (select a.kind, a.j, a.p as a, b.p as b from ms a join ms b on a.kind = b.kind and a.j = b.j and a.side = 0 and b.side = 1)"""
