"""DuckDB SQL of the ordered folds, as recursive table expressions: one step of recursion for each further row of every actor.

Written apart from the Python folds that Spark runs, so that each checks the other.
"""

from __future__ import annotations

from ..operators import decisions
from ..operators.goals import GOALS, IDLE, MOST, RECENT, VARIANTS


def _pattern(wanted) -> str:
    """A regular expression for codes joined by ';' that holds the wanted actions in order."""
    one = lambda w: w.partition(":")[0] + "[^;]*" + (w.partition(":")[2] + "[^;]*" if ":" in w else "") + ";"
    return ";" + "([^;]*;)*".join(one(w) for w in wanted)


def goals(variant: str) -> str:
    """Table expressions ending in ``goals_{variant}``: what is inferred after each row of ``coded`` (event_id, actor_id, step, ord, code, contradictions, last_of_step)."""
    v = VARIANTS[variant]
    n = range(len(GOALS))
    plans = list(v.plans.items())
    hits = ", ".join(f"regexp_matches(codes, '{_pattern(w)}') as h{i}" for i, (w, _, _) in enumerate(v.rules))
    p, at, born = {}, {}, {}
    for i, g in enumerate(GOALS):
        p[i], at[i], born[i] = (f"p{i} * pow({v.contradiction}e0, contradictions)" if v.contradiction < 1 else f"p{i}"), f"at{i}", f"born{i}"
        for k, (_, goal, boost) in enumerate(v.rules):
            if goal == g:
                p[i] = f"case when h{k} then case when {p[i]} is null then {boost}e0 else least({MOST}e0, {p[i]} + {boost}e0 * (1 - {p[i]})) end else {p[i]} end"
                at[i] = f"case when h{k} then step else {at[i]} end"
                born[i] = f"case when h{k} and {born[i]} is null then ord * 10 + {k} else {born[i]} end"
    faded = {i: f"case when step - at{i} > {IDLE} then p{i} * " + (f"pow({v.fade}e0, step - at{i} - {IDLE})" if v.by_age else f"{v.fade}e0") + f" else p{i} end" for i in n}
    fits = lambda w: f"(starts_with(code, '{w.partition(':')[0]}') and contains(code, '{w.partition(':')[2]}'))"
    fit = {k: "case d%d %s else false end" % (k, " ".join(f"when {j} then {fits(w)}" for j, w in enumerate(wanted))) for k, (_, wanted) in enumerate(plans)}
    same = {k: "case d%d %s else false end" % (k, " ".join(f"when {j} then starts_with(code, '{w.partition(':')[0]}')" for j, w in enumerate(wanted))) for k, (_, wanted) in enumerate(plans)}
    m = range(len(plans))
    size = [len(w) for _, w in plans]
    state = ", ".join([*(f"p{i}, at{i}, born{i}" for i in n), *(f"d{k}, c{k}" for k in m)])
    start = ", ".join([*("cast(null as double), cast(null as bigint), cast(null as bigint)" for _ in n), *("0, 0.1e0" for _ in m)])
    gone = lambda i, x: f"case when p{i} < {v.least}e0 then null else {x} end" if v.least else x
    share = [f"c{k} * (cast(d{k} as double) / {size[k]})" for k in m]
    first = lambda values: "case " + " ".join("when " + " and ".join([f"{share[k]} >= {share[j]}" for j in m if j > k] or ["true"]) + f" then {values[k]}" for k in m) + " end"
    best = "greatest(" + ", ".join(f"p{i}" for i in n) + ")"
    return f"""
history_{variant} as (select *, {hits} from (select *, concat(';', string_agg(coalesce(code, ''), ';') over (partition by actor_id order by ord rows between {RECENT - 1} preceding and current row), ';') as codes from coded) x),
state_{variant}(actor_id, ord, {state}) as (
    select actor_id, cast(0 as bigint), {start} from (select distinct actor_id from coded) x
    union all
    select actor_id, ord, {", ".join([*(f"{gone(i, f'p{i}')}, {gone(i, f'at{i}')}, {gone(i, f'born{i}')}" for i in n), *(f"d{k} + case when fit{k} then 1 else 0 end, case when d{k} >= {size[k]} then c{k} when fit{k} then least(0.9e0, c{k} + 0.15e0) when same{k} then greatest(0.05e0, c{k} - {v.same_kind}e0) else greatest(0.05e0, c{k} - {v.other_kind}e0) end" for k in m)])}
    from (select actor_id, ord, {", ".join(f"{faded[i]} as p{i}, at{i}, born{i}" for i in n)}, {", ".join(f"d{k}, c{k}, fit{k}, same{k}" for k in m)}
        from (select actor_id, ord, step, {", ".join(f"{p[i]} as p{i}, {at[i]} as at{i}, {born[i]} as born{i}" for i in n)}, {", ".join(f"d{k}, c{k}, {fit[k]} as fit{k}, {same[k]} as same{k}" for k in m)}
            from (select h.*, {", ".join(f"s.p{i}, s.at{i}, s.born{i}" for i in n)}, {", ".join(f"s.d{k}, s.c{k}" for k in m)}
                from state_{variant} s join history_{variant} h on h.actor_id = s.actor_id and h.ord = s.ord + 1) a) b) c),
tops_{variant} as (select h.event_id, h.actor_id, h.step, h.ord, h.last_of_step, s.*exclude (actor_id, ord), {best} as top, {first([f"'{name}'" for name, _ in plans])} as best_plan, {first([f"cast(d{k} as double) / {size[k]}" for k in m])} as part
    from state_{variant} s join history_{variant} h on h.actor_id = s.actor_id and h.ord = s.ord),
goals_{variant} as (select event_id, actor_id, step, last_of_step, case when top > {v.reported}e0 then case least({", ".join(f"case when p{i} = top then born{i} end" for i in n)}) {" ".join(f"when born{i} then '{g}'" for i, g in enumerate(GOALS))} end end as goal,
    case when top > {v.reported}e0 then top else 0e0 end as intent, case when part > {v.active}e0 then best_plan end as plan, case when part > {v.active}e0 then part else 0e0 end as completion,
    {", ".join(f"coalesce(p{i}, 0e0) as p_{g}" for i, g in enumerate(GOALS[:4]))} from tops_{variant})"""


#: Columns that a source of ``alerts`` has beside the anchors' own: the key that parts the state, and the switches of a sweep.
PLAIN = "select *, actor_id as fold_key, {confirmed}e0 as confirmed_at, 1e0 as baseline_on, 1e0 as trust_on, '' as config, 0 as run from {source}"


def alerts(name: str, variant: str, source: str | None = None) -> str:
    """Table expressions ending in ``alerts_{name}``: what each anchor of ``source`` fires, and ``decided_{name}``: a row for every anchor."""
    c = decisions.CONFIGS[variant]
    source = source or PLAIN.format(confirmed=c.confirmed, source=f"scored_{variant}" if variant != "lsc" else "(select *, 0e0 as boost from scored) x")
    k = range(len(c.keys))
    state = [*(f"m{i}" for i in k), *(f"v{i}" for i in k), "trust", "last_early", "last_confirmed"]
    z = " + ".join(f"least(greatest(({x} - m{i}) / (sqrt(v{i}) + 1e-6), 0e0), {c.z_clip}e0)" for i, x in enumerate(c.keys))
    threshold = f"confirmed_at + trust_on * {c.trust_slope}e0 * (trust - 0.5e0)" + "".join(f" + case when role = '{r}' then {x}e0 else 0e0 end" for r, x in c.role_adjustment)
    own = ["event_id", "actor_id", "step", "label", "phase", "role", "config", "run", "confirmed_at", "baseline_on", "trust_on", "score_base", "off", "mult", "boost", "gate", *c.keys]
    return f"""
rows_{name} as (select *, row_number() over (partition by fold_key order by ord) as nth from ({source}) y),
fold_{name}(fold_key, nth, {", ".join(own)}, {", ".join(state)}, base, value, threshold, trust_before, early, confirmed) as (
    select fold_key, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), 0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, false{", 0e0" * len(c.keys)},
        {"0e0, " * len(c.keys)}{"1e0, " * len(c.keys)}{c.trust_init}e0, cast(null as bigint), cast(null as bigint), 0e0, 0e0, 0e0, 0e0, false, false from (select distinct fold_key from rows_{name}) x
    union all
    select fold_key, nth, {", ".join(own)}, {"".join(f"n{i}, " for i in k)}{"".join(f"{1 - c.alpha_var}e0 * v{i} + {c.alpha_var}e0 * pow({x} - n{i}, 2), " for i, x in enumerate(c.keys))}
        case when confirmed then least(greatest(trust + case when label = 'malicious' then {c.trust_tp}e0 else {c.trust_fp}e0 end, {c.trust_min}e0), {c.trust_max}e0) else trust end,
        case when early then step else last_early end, case when confirmed then step else last_confirmed end, base, value, threshold, trust, early, confirmed
    from (select *, value >= {c.early}e0 and coalesce(step - last_early >= {c.cooldown}, true) as early, value >= threshold and gate and coalesce(step - last_confirmed >= {c.cooldown}, true) as confirmed
        from (select *, base + boost as value, {threshold} as threshold{"".join(f", {1 - c.alpha_mean}e0 * m{i} + {c.alpha_mean}e0 * {x} as n{i}" for i, x in enumerate(c.keys))}
            from (select *, (score_base + off) * mult + baseline_on * {c.z_weight}e0 * ({z}) as base
                from (select r.fold_key, r.nth, {", ".join("r." + x for x in own)}, {", ".join("f." + x for x in state)}
                    from fold_{name} f join rows_{name} r on r.fold_key = f.fold_key and r.nth = f.nth + 1) a) b) c) d),
decided_{name} as (select event_id, actor_id, step, label, phase, config, run, confirmed_at, base, value, threshold, trust_before as trust, early, confirmed from fold_{name} where nth > 0),
alerts_{name} as (
    select event_id, actor_id, step, config, run, confirmed_at, 'early' as tier, label, phase, value as score, {c.early}e0 as threshold, trust, cast(null as varchar) as verdict from decided_{name} where early
    union all
    select event_id, actor_id, step, config, run, confirmed_at, 'confirmed', label, phase, value, threshold, trust, case when label = 'malicious' then 'malicious' else 'benign' end from decided_{name} where confirmed)"""


_LEARNING = list(decisions.FIRST_WEIGHTS)


def learning(name: str, source: str, every: int = 24) -> str:
    """Table expressions ending in ``alerts_{name}``, ``decided_{name}`` and ``weights_{name}``: decisions with weights that learn by round.

    A tick is one more anchor of every actor in a round; a step of recursion takes all actors through a tick. source has ``model`` and
    ``fold_key`` beside the columns that ``alerts`` takes, and a column for each weight."""
    c = decisions.CONFIGS["lsc"]
    k, j = range(len(c.keys)), range(len(_LEARNING))
    own = ["event_id", "actor_id", "step", "label", "phase", "config", "run", "confirmed_at", "off", "mult", "boost", "gate", *dict.fromkeys([*c.keys, *_LEARNING])]
    kept = ["trust", "last_early", "last_confirmed", *(f"{x}{i}" for x in "mv" for i in k)]
    z = " + ".join(f"least(greatest(({x} - m{i}) / (sqrt(v{i}) + 1e-6), 0e0), {c.z_clip}e0)" for i, x in enumerate(c.keys))
    plain = " + ".join(f"w{i} * {x}" for i, x in enumerate(_LEARNING) if x != "unapproved")
    moved = ", ".join(f"case when fresh then least(greatest(w{i} - {c.rate}e0 * (a{i} / {decisions.UNIT:.0f}e0 + n_confirmed * {c.decay:.4f}e0 * w{i}), -{c.weight_clip}e0), {c.weight_clip}e0) else w{i} end as w{i}, case when fresh then 0 else a{i} end as a{i}" for i in j)
    slope = f"(1e0 / (1e0 + exp(-({' + '.join(f'w{i} * {x}' for i, x in enumerate(_LEARNING))}))) - case when label = 'malicious' then 1e0 else 0e0 end)"
    sums = ", ".join(f"cast(a{i} + coalesce(sum(case when confirmed then cast(round({slope} * {x} * {decisions.UNIT:.0f}e0) as bigint) end) over (partition by model), 0) as bigint)" for i, x in enumerate(_LEARNING))
    alive = lambda new, old: f"case when live then {new} else {old} end"
    state = [
        alive(f"case when confirmed then least(greatest(trust + case when label = 'malicious' then {c.trust_tp}e0 else {c.trust_fp}e0 end, {c.trust_min}e0), {c.trust_max}e0) else trust end", "trust"),
        "case when early then step else last_early end", "case when confirmed then step else last_confirmed end",
        *(alive(f"{1 - c.alpha_mean}e0 * m{i} + {c.alpha_mean}e0 * {x}", f"m{i}") for i, x in enumerate(c.keys)),
        *(alive(f"{1 - c.alpha_var}e0 * v{i} + {c.alpha_var}e0 * pow({x} - ({1 - c.alpha_mean}e0 * m{i} + {c.alpha_mean}e0 * {x}), 2)", f"v{i}") for i, x in enumerate(c.keys)),
    ]
    out = ["t", "fold_key", "model", "round", "fresh", "live", "event_id", "actor_id", "step", "label", "phase", "config", "run", "confirmed_at", "base", "value", "threshold", "trust_before", "early", "confirmed", *kept, *(f"w{i}" for i in j), *(f"a{i}" for i in j), "n_confirmed"]
    start = ["cast(0 as bigint)", "fold_key", "model", "cast(null as bigint)", "false", "false", "cast(null as bigint)", "cast(null as bigint)", "cast(null as bigint)", "cast(null as varchar)", "cast(null as varchar)", "cast(null as varchar)", "0", "0e0", "0e0", "0e0", "0e0", "0e0", "false", "false",
             f"{c.trust_init}e0", "cast(null as bigint)", "cast(null as bigint)", *["0e0"] * len(c.keys), *["1e0"] * len(c.keys), *(f"{w}e0" for w in decisions.FIRST_WEIGHTS.values()), *["cast(0 as bigint)"] * len(_LEARNING), "cast(0 as bigint)"]
    return f"""
rows_{name} as (select *, cast(floor(step / {every}.0) as bigint) as round, row_number() over (partition by fold_key, floor(step / {every}.0) order by ord) as k from ({source}) y),
ticks_{name} as (select round, k, row_number() over (order by round, k) as t, k = 1 as fresh from (select distinct round, k from rows_{name}) x),
fold_{name}({", ".join(out)}) as (
    select {", ".join(start)} from (select distinct fold_key, model from rows_{name}) x
    union all
    select t, fold_key, model, round, fresh, live, event_id, actor_id, step, label, phase, config, run, confirmed_at, base, value, threshold, trust, early, confirmed, {", ".join(state)}, {", ".join(f"w{i}" for i in j)}, {sums},
        cast(case when fresh then 0 else n_confirmed end + sum(case when confirmed then 1 else 0 end) over (partition by model) as bigint)
    from (select *, coalesce(live and value >= {c.early}e0 and coalesce(step - last_early >= {c.cooldown}, true), false) as early, coalesce(live and value >= threshold and gate and coalesce(step - last_confirmed >= {c.cooldown}, true), false) as confirmed
        from (select *, base + boost as value from (select *, ({plain} + off) * mult + {c.z_weight}e0 * ({z}) as base, confirmed_at + {c.trust_slope}e0 * (trust - 0.5e0) as threshold
            from (select t, fold_key, model, round, fresh, live, {", ".join(own)}, {", ".join(kept)}, n_confirmed, {moved}
                from (select s.t, f.fold_key, f.model, s.round, s.fresh, r.fold_key is not null as live, {", ".join("r." + x for x in own)}, {", ".join("f." + x for x in kept)}, f.n_confirmed, {", ".join(f"f.w{i}, f.a{i}" for i in j)}
                    from fold_{name} f join ticks_{name} s on s.t = f.t + 1 left join rows_{name} r on r.fold_key = f.fold_key and r.round = s.round and r.k = s.k) a) b) c) d) e),
decided_{name} as (select event_id, actor_id, step, label, phase, config, run, confirmed_at, base, value, threshold, trust_before as trust, early, confirmed from fold_{name} where live),
weights_{name} as (select distinct model, round, {", ".join(f"w{i}" for i in j)} from fold_{name} where fresh),
alerts_{name} as (
    select event_id, actor_id, step, config, run, confirmed_at, 'early' as tier, label, phase, value as score, {c.early}e0 as threshold, trust, cast(null as varchar) as verdict from decided_{name} where early
    union all
    select event_id, actor_id, step, config, run, confirmed_at, 'confirmed', label, phase, value, threshold, trust, case when label = 'malicious' then 'malicious' else 'benign' end from decided_{name} where confirmed)"""
