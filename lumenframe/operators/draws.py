"""Weighted draws from groups of any size."""

from __future__ import annotations

from .circular import CELLS, TwoLevel

#: A number in [0, 1) for a group (an integer) and a draw.
UNIFORM = "(((((g % 1000003) * 1103515245 + draw * 12345 + 1013904223) % 2147483647) * 48271) % 2147483647 / 2147483647e0)"
_DRAWS = "(select distinct n as draw from (values " + ", ".join(f"({i})" for i in range(1, 101)) + ") v(n) where n <= :draws)"
_BEFORE = "rows between unbounded preceding and 1 preceding"
_CELL = f"case when hi > lo then cast(floor((cast(o as double) - lo) / (cast(hi as double) - lo) * {CELLS}) as int) else 0 end"


class Draws(TwoLevel):
    """Draws from rows (g, o, weight), each with replacement: g, draw, o; in a group a row is drawn in proportion to its weight.

    Rows are in order of ``o``, which is different for each row of a group. Weights that are null, 0 or below are never drawn, and
    from a group without others nothing is. On Spark weights are summed for cells of ``o``; a draw looks into one cell only.
    """

    MOST = 100

    def text(self, **params: float) -> str:
        n = (self.defaults | params)["draws"]
        if not 1 <= n <= self.MOST:
            raise ValueError(f"draws have to be from 1 to {self.MOST}: {n}")
        return super().text(**params)

    def __call__(self, *frames, **params):
        self.text(**params)
        return super().__call__(*frames, **params)


weighted_draw = Draws(f"""
select g, draw, o from (select *, {UNIFORM} * total as target from (
  select g, o, weight, coalesce(sum(weight) over (partition by g order by o {_BEFORE}), 0) as before, sum(weight) over (partition by g) as total from {{points}} where weight > 0) s cross join {_DRAWS} d) t
where before <= target and target < before + weight""", f"""
with ends as (select min(o) as lo, max(o) as hi from {{points}}),
points as (select g, o, weight, {_CELL} as cell from {{points}} cross join ends where weight > 0),
cells as (select g, cell, sum(weight) as weight from points group by g, cell),
heads as (select g, cell, weight, coalesce(sum(weight) over (partition by g order by cell {_BEFORE}), 0) as before, sum(weight) over (partition by g) as total from cells),
hits as (select * from (select *, {UNIFORM} * total as target from heads cross join {_DRAWS} d) t where before <= target and target < before + weight),
inner_ as (select p.g, h.draw, p.o, p.weight, h.target, h.before + coalesce(sum(p.weight) over (partition by p.g, h.draw order by p.o {_BEFORE}), 0) as before from points p join hits h on p.g = h.g and p.cell = h.cell)
select g, draw, o from inner_ where before <= target and target < before + weight""", draws=3)
