"""Samples of the anomaly model over a dense grid of actors and steps, without making the grid.

Every actor with history gives its role one sample at each step: its window as it stands. A window stands until the actor's next
step, so a run of equal samples is one row with a weight. Running totals by role and step (a table of the steps' size) tell
where the last BUFFER samples before each version of the model begin; runs are cut there.

In the first variant samples of windows in a partner cycle aren't clean, nor any of an actor whose clean windows have added up to more
than three large exports and more than five mails outside; both grow with each step of a run, so the number of a run's steps
that are clean has a closed form. The third variant takes every second step and all samples, and goes on after warm-up.
A version is fitted from whole steps: when a role has LEAST samples, and REFIT steps later again.
"""

from __future__ import annotations

BUFFER, LEAST, REFIT, WARM_UP = 500, 25, 15, 60
# Sums that a clean sample's actor must not pass, both.
LARGE, OUTSIDE = 3, 5


def _runs(every: int, frozen: bool) -> str:
    """Runs in units of sampled steps: from a, n long, of them ``clean`` first ones clean."""
    end = str(WARM_UP) if frozen else "(select max(step) + 1 from snap)"
    unit = lambda x: f"cast(ceil(({x}) / {every}e0) as bigint)"
    room = lambda most, c, x: f"case when {c} > {most} then 0 when {x} = 0 then n else cast(floor(({most} - {c}) / cast({x} as double)) as bigint) end"
    clean = f"case when cycles > 0 then 0 else least(n, greatest({room(LARGE, 'c_large', 'large_exports')}, {room(OUTSIDE, 'c_outside', 'outside')})) end" if frozen else "cast(0 as bigint)"
    return f"""
standing as (select profile_role as role, actor_id, step, cycles, large_exports, outside, {unit("step")} as a, greatest(0, {unit(f"least({end}, coalesce(lead(step) over (partition by actor_id order by step), {end}))")} - {unit("step")}) as n from snap{f" where step < {WARM_UP}" if frozen else ""}),
runs as (select *, {clean} as clean from (select *, coalesce(sum(case when cycles = 0 then n * large_exports else 0 end) over p, 0) as c_large, coalesce(sum(case when cycles = 0 then n * outside else 0 end) over p, 0) as c_outside
    from standing window p as (partition by actor_id order by step rows between unbounded preceding and 1 preceding)) x where n > 0)"""


def weighted(every: int = 1, frozen: bool = True) -> str:
    """Spark SQL: role, version (its step), actor_id, step (of the window), weight; a text that starts with a comma adds table expressions."""
    last = f"{WARM_UP - 1} div {every}" if frozen else f"(select max(step) from snap) div {every}"
    refit = -(-REFIT // every)
    return f""", {_runs(every, frozen)},
both as (select role, actor_id, step, 'clean' as kind, a, a + clean as b from runs where clean > 0 union all select role, actor_id, step, 'all', a, a + n from runs),
changes as (select role, kind, s, sum(d) as d from (select role, kind, a as s, 1 as d from both union all select role, kind, b, -1 from both) x group by role, kind, s),
grid as (select r.role, k.kind, s from (select distinct role from profile) r cross join (select explode(array('clean', 'all')) as kind) k lateral view explode(sequence(0, cast({last} as int))) t as s),
totals as (select *, sum(active) over (partition by role, kind order by s) as total from (select g.role, g.kind, g.s, sum(coalesce(c.d, 0)) over (partition by g.role, g.kind order by g.s) as active from grid g left join changes c on c.role = g.role and c.kind = g.kind and c.s = g.s) x),
firsts as (select role, min(s) as v from totals where kind = 'all' and total >= {LEAST} group by role),
versions as (select role, v from (select f.role, explode(sequence(f.v, cast({last} as int), {refit})) as v from firsts f) x),
chosen as (select v.role, v.v, case when c.total >= {LEAST} then 'clean' else 'all' end as kind, case when c.total >= {LEAST} then c.total else a.total end - {BUFFER} as skip
    from versions v join totals c on c.role = v.role and c.s = v.v and c.kind = 'clean' join totals a on a.role = v.role and a.s = v.v and a.kind = 'all'),
-- the first step that is taken whole, and what is taken of the one before it
cuts as (select c.role, c.v, c.kind, coalesce(max(case when t.total - t.active < c.skip then t.s end), -1) + 1 as whole, coalesce(max(case when t.total - t.active < c.skip then t.total end) - max(c.skip), 0) as part
    from chosen c join totals t on t.role = c.role and t.kind = c.kind and t.s <= c.v group by c.role, c.v, c.kind),
full_steps as (select c.role, c.v, b.actor_id, b.step, least(b.b, c.v + 1) - greatest(b.a, c.whole) as weight from cuts c join both b on b.role = c.role and b.kind = c.kind and b.a <= c.v and b.b > c.whole),
part_step as (select role, v, actor_id, step, 1 as weight from (select c.role, c.v, b.actor_id, b.step, c.part, row_number() over (partition by c.role, c.v order by b.actor_id desc) as place
    from cuts c join both b on b.role = c.role and b.kind = c.kind and b.a <= c.whole - 1 and b.b > c.whole - 1 and c.part > 0) x where place <= {BUFFER} and place <= part)
select role, cast(v * {every} as bigint) as version, actor_id, step, cast(sum(weight) as bigint) as weight from (select * from full_steps where weight > 0 union all select * from part_step) x group by role, v, actor_id, step"""


def by_grid(every: int = 1, frozen: bool = True) -> str:
    """DuckDB SQL of the same from the whole grid."""
    end = str(WARM_UP) if frozen else "(select max(step) + 1 from snap)"
    refit = -(-REFIT // every)
    return f""", cells as (select profile_role as role, actor_id, step, cycles, large_exports, outside, unnest(range(step, least({end}, coalesce(next, {end})))) as s from (select *, lead(step) over (partition by actor_id order by step) as next from snap) x),
sampled as (select * from cells where s % {every} = 0),
judged_cells as (select *, {"cycles = 0 and not (sum(case when cycles = 0 then large_exports else 0 end) over p > %d and sum(case when cycles = 0 then outside else 0 end) over p > %d)" % (LARGE, OUTSIDE) if frozen else "false"} as clean from sampled window p as (partition by actor_id order by s)),
counted as (select *, count(*) over (partition by role order by s) as n_all, count(*) filter (clean) over (partition by role order by s) as n_clean from judged_cells),
first_fits as (select role, min(s) as v from counted where n_all >= {LEAST} group by role),
fits as (select role, unnest(range(v, {"%d" % WARM_UP if frozen else "(select max(step) + 1 from snap)"}, {refit * every})) as v from first_fits),
sides as (select f.role, f.v, count(*) filter (c.clean) >= {LEAST} as use_clean from fits f join judged_cells c on c.role = f.role and c.s <= f.v group by f.role, f.v),
ranked as (select d.v, c.*, row_number() over (partition by d.role, d.v order by c.s desc, c.actor_id desc) as place from sides d join judged_cells c on c.role = d.role and c.s <= d.v and (c.clean or not d.use_clean))
select role, v::bigint as version, actor_id, step, count(*) as weight from ranked where place <= {BUFFER} group by role, v, actor_id, step"""
