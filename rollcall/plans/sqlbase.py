"""The base tables as SQL, written apart from the Spark side as its check."""

from __future__ import annotations

import re


def R(x: str) -> str:
    """Six decimals, without negative zero."""
    return f"(round({x}, 6) + 0.0)"


def NA(cond: str, yes: str, no: str) -> str:
    """Three-valued choice."""
    return f"(case when {cond} then {yes} when not ({cond}) then {no} end)"


def MIN(a: str, b: str) -> str:
    """Minutes between two timestamps."""
    return f"((epoch_us({b}) - epoch_us({a})) / 6e7)"


BASES: dict[str, str] = {
    "ev": """select event_id, ts, user_id as entity, event_type, value, cast(ts as date) as day,
        cast(date_diff('day', date '2024-01-01', cast(ts as date)) // 10 as bigint) as period from events""",
    "span": "select min(day) as lo, max(day) as hi from ev",
    "users": "select distinct entity from ev",
    "cal": "select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from span",
    "calp": "select day, cast(date_diff('day', date '2024-01-01', day) // 10 as bigint) as period from cal",
    "seen": """select entity, day, min(ts) as first_seen, max(ts) as last_seen,
        max(case when event_type = 'purchase' then 1 else 0 end) as bought, avg(value) as mean_value, count(*) as n_ev
        from ev group by entity, day""",
    "presence": """select u.entity, c.day, c.period, case when s.entity is null then 0 else 1 end as present,
        s.first_seen, s.last_seen from users u cross join calp c left join seen s on s.entity = u.entity and s.day = c.day""",
    "att": """select p.period, u.entity, u.entity % 15 as age, u.entity + 1 as rank
        from users u cross join (select distinct period from calp) p""",
    "sightings": """select entity, day, period, case when entity % 23 = 0 then 'DD' when entity % 15 < 6 then 'NS'
        when present = 1 and entity % 17 = 0 then '?' when present = 1 then strftime(first_seen, '%H:%M') end as code
        from presence""",
    "day_obs": """select day, period, start, fin, case when day(day) % 7 = 0 then start + interval 4 hour end as suspend,
        case when day(day) % 7 = 0 then start + interval 5 hour end as restart
        from (select day, min(period) as period, min(ts) as start, max(ts) as fin from ev group by day)""",
    "group_days": f"""select d.*, g.group_no, 'g' || strftime(day, '%Y%m%d') || '_' || g.group_no as group_id,
        case when period % 2 = 0 then 'm' else 'nm' end || (19 + period) as code,
        {MIN('start', 'fin')} - coalesce({MIN('suspend', 'restart')}, 0) as dur
        from day_obs d cross join (values (1), (2)) g(group_no) where g.group_no = 1 or day(day) % 5 = 0""",
    "members": """select g.day, g.period, g.code, g.group_no, g.group_id, p.entity, p.entity % 15 as age, p.entity + 1 as rank,
        case when p.entity % 29 = 0 and day(p.day) % 9 = 0 then null
             when present = 1 and (day(p.day) % 5 <> 0 or (p.entity % 4 = 0) = (g.group_no = 2)) then 1 else 0 end as presence
        from presence p join group_days g on g.day = p.day""",
    "eligible": "select * from members where age >= 6 and entity % 23 <> 0",
    "roster": "select day, count(*) as max_entity from sightings where code is null or code not in ('DD', 'NS') group by day",
    "sizes": """select m.day, m.group_id, g.period, g.code, g.dur, r.max_entity, m.n_entity
        from (select day, group_id, coalesce(sum(presence), 0) as n_entity from eligible group by day, group_id) m
        join group_days g on g.group_id = m.group_id join roster r on r.day = m.day""",
    "mgd": """select *, n_entity / max_entity as prop from sizes
        where n_entity / max_entity >= 0.5 and dur >= 240 and group_id not in ('g20240108_1')""",
    "panel": """select e.day, e.period, e.code, e.group_id, e.entity, e.age, e.rank, e.presence, m.dur
        from eligible e join mgd m on m.group_id = e.group_id""",
    "trans": f"""select p.*, q.presence as pre,
        {NA('q.presence is null', 'null', NA('q.presence = 1 and p.presence = 0', '1', '0'))} as departure,
        {NA('q.presence is null', 'null', NA('q.presence = 0 and p.presence = 1', '1', '0'))} as returned
        from panel p left join panel q on q.entity = p.entity and q.day = p.day - 1""",
    "state": "select entity, day, case when entity % 19 <> 0 then bought end as rs from seen",
    "incidents": """select event_id as no, day, period, entity, 'U' || (event_id % 7) || case when event_id % 6 = 0 then '?' else '' end as actor,
        case when event_id % 11 = 0 then 'multi' else cast(entity as varchar) end || case when event_id % 5 = 0 then '?' else '' end as target
        from ev where event_type = 'error'""",
    "kin": """select u.entity, u.entity + d.delta as entity2, d.kin from users u
        cross join (values (10, 0.5), (-10, 0.5), (5, 0.25), (-5, 0.25)) d(delta, kin)
        where u.entity + d.delta between 0 and (select max(entity) from users)""",
    "focal": "select event_id % 3 as session, day, entity as subject, value as time from ev",
    "keyed": """select day, max(case when entity = 1 then present end) as k1, max(case when entity = 2 then present end) as k2
        from presence where entity in (1, 2) group by day""",
    "bouts": """select year(o.o_orderdate) as period, least(l.l_suppkey, o.o_custkey) as a, greatest(l.l_suppkey, o.o_custkey) as b,
        l.l_returnflag as kind, l.l_quantity as minutes
        from lineitem l join orders o on o.o_orderkey = l.l_orderkey where l.l_suppkey <> o.o_custkey""",
    "graph": "select a, b, sum(minutes) as w from bouts where kind = 'R' group by a, b",
    "draws": """select vec_id % 4 + 1 as chain, vec_id // 4 + 1 as iteration, 'p[' || i || ']' as variable,
        cast(embedding[i] as double) as value, i from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)""",
    "tday": "select day, period, cast(date_diff('day', (select lo from span), day) + 1 as bigint) as t from calp",
    "troop_sri": """select a.entity // 50 as troop, a.entity as a, b.entity as b, sum(a.present * b.present) as together,
        sum(greatest(a.present, b.present)) as denom
        from presence a join presence b on b.day = a.day and b.entity // 50 = a.entity // 50 and b.entity > a.entity
        group by 1, 2, 3""",
    "found": """select s.entity, s.day, s.period, d.start, d.fin, d.suspend, r.max_entity,
        date_trunc('minute', p.first_seen) as found_time
        from sightings s join presence p on p.entity = s.entity and p.day = s.day
        join day_obs d on d.day = s.day join roster r on r.day = s.day
        where s.code is not null and s.code not in ('?', 'DD', 'NS')""",
    "durations": f"""select m.day, m.period, m.group_id, m.entity, m.rank, {MIN('g.start', 'g.fin')} as dur_follow,
        {NA('m.presence = 1', MIN('g.start', 'f.found_time'), MIN('g.start', 'g.fin'))} as dur,
        {NA('(f.entity is not null) and m.presence = 0', 'm.presence', 'case when f.entity is null then 0 else 1 end')} as confirmed
        from eligible m join group_days g on g.group_id = m.group_id
        left join found f on f.entity = m.entity and f.day = m.day
        where m.entity % 17 <> 0 and g.suspend is null and m.group_id not in ('g20240110_2')""",
}


def _det(rows: tuple[int, ...], cols: tuple[int, ...]) -> str:
    """Determinant of a block of the symmetric information matrix h."""
    if len(rows) == 1:
        return f"h{min(rows[0], cols[0])}{max(rows[0], cols[0])}"
    r, rest = rows[0], rows[1:]
    parts = [f"{'-' if k % 2 else '+'} {_det((r,), (c,))} * ({_det(rest, cols[:k] + cols[k + 1:])})" for k, c in enumerate(cols)]
    return " ".join(parts).removeprefix("+ ")


def GLM(data: str, p: int, link: str, variance: str, start: str, cluster: bool = False, steps: int = 25,
        overdispersed: bool = False, scaled: bool | None = None, crossed: bool = False, given: str = "") -> str:
    """Fisher scoring as a recursive query, for ``p`` coefficients with the intercept first.

    ``data`` is a query with columns y, w, off, x1.. (and cl, the cluster). The
    table ``fitv`` gets b0.. and the covariances v00.., summed over clusters or,
    unless the variance is binomial (``scaled`` overrides), scaled by the Pearson
    dispersion. ``overdispersed`` carries the moment
    estimate ``al`` of the extra variance along, for use in ``variance``.
    ``crossed`` clusters by cl and by cl2; ``given`` is a query of the final
    step, b0.. (and al), which then are not searched for.
    """
    mean, slope = {
        "logit": ("1 / (1 + exp(-eta))", "mu * (1 - mu)"),
        "cloglog": ("1 - exp(-exp(eta))", "(1 - mu) * exp(eta)"),
        "log": ("exp(eta)", "mu"),
        "identity": ("eta", "1.0"),
    }[link]
    ix = range(p)
    bs = ", ".join([*(f"b{i}" for i in ix), *(["al"] if overdispersed else [])])
    moment = ", greatest(sum((y - mu) * (y - mu) - mu) / sum(mu * mu), 0) as al2" if overdispersed else ""
    pairs = [(i, j) for i in ix for j in ix if i <= j]
    sym = lambda n, i, j: f"{n}{min(i, j)}{max(i, j)}"

    def scores(b: str) -> str:
        return f"""select *, w * slope * slope / ({variance}) as i, w * (y - mu) * slope / ({variance}) as s
            from (select *, {slope} as slope from (select *, {mean} as mu from (
              select *, 1.0 as x0, {' + '.join(f'b{i} * x{i}' if i else 'b0' for i in ix)} + off as eta from {b}, gd)))"""

    def solved(b: str) -> str:
        sums = ", ".join([f"sum(i * x{i} * x{j}) as h{i}{j}" for i, j in pairs] + [f"sum(s * x{i}) as g{i}" for i in ix])
        cof = ", ".join(
            f"{'-' if (i + j) % 2 else ''}({_det(tuple(k for k in ix if k != i), tuple(k for k in ix if k != j))}) as c{i}{j}" for i, j in pairs)
        return f"""select *, {' + '.join(f'h0{j} * c0{j}' for j in ix)} as det from (select *, {cof} from (
            select step, {bs}, count(*) as n, sum(w * (y - mu) * (y - mu) / ({variance})) as r, {sums}{moment} from ({scores(b)}) group by step, {bs}))"""

    steps_sql = ", ".join(f"b{i} + ({' + '.join(f'{sym(chr(99), i, j)} * g{j}' for j in ix)}) / det" for i in ix)
    first = ", ".join(f"cast({start if i == 0 else 0} as double) as b{i}" for i in ix)
    if overdispersed:
        steps_sql, first = steps_sql + ", al2", first + ", cast(0 as double) as al"
    search = f""", recursive b as (select 0 as step, {first} union all
        select step + 1, {steps_sql} from ({solved('b')}) where step < {steps}), lastb as (select * from b where step = {steps})"""
    out = f", gd as ({data}){f', lastb as ({given})' if given else search}, fin as ({solved('lastb')})"
    if not cluster:
        scale = f" * r / (n - {p})" if scaled or (scaled is None and variance != "mu * (1 - mu)") else ""
        return out + f", fitv as (select {bs}, {', '.join(f'c{i}{j} / det{scale} as v{i}{j}' for i, j in pairs)} from fin)"
    meat = ", ".join(f"sum(u{i} * u{j}) as m{i}{j}" for i, j in pairs)
    sandwich = ", ".join(
        f"({' + '.join(f'{sym(chr(99), i, k)} * {sym(chr(109), k, q)} * {sym(chr(99), q, j)}' for k in ix for q in ix)}) / det / det as v{i}{j}"
        for i, j in pairs)
    sums = ", ".join(f"sum(s * x{i}) as u{i}" for i in ix)
    by = lambda cols: f"select {meat} from (select {cols}, {sums} from ({scores('lastb')}) group by {cols})"
    if crossed:
        terms = ", ".join(f"sum(sign * m{i}{j}) as m{i}{j}" for i, j in pairs)
        whole = f"select {terms} from (select 1 as sign, * from ({by('cl')}) union all select 1, * from ({by('cl2')}) union all select -1, * from ({by('cl, cl2')}))"
    else:
        whole = by("cl")
    return out + f""", meat as ({whole}),
        fitv as (select {bs}, {sandwich} from fin, meat)"""


def LOGITS(data: str, keys: str, p: int, steps: int = 25) -> str:
    """Logistic fits, one per value of ``keys``, of ``data`` (keys, y, w, x1..): the table ``fits`` has b0.. and z0.. ."""
    ix = range(p)
    bs = ", ".join(f"b{i}" for i in ix)
    pairs = [(i, j) for i in ix for j in ix if i <= j]
    sym = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def solved(b: str) -> str:
        sums = ", ".join([f"sum(w * mu * (1 - mu) * x{i} * x{j}) as h{i}{j}" for i, j in pairs] + [f"sum(w * (y - mu) * x{i}) as g{i}" for i in ix])
        cof = ", ".join(
            f"{'-' if (i + j) % 2 else ''}({_det(tuple(k for k in ix if k != i), tuple(k for k in ix if k != j))}) as c{i}{j}" for i, j in pairs)
        return f"""select *, {' + '.join(f'h0{j} * c0{j}' for j in ix)} as det from (select *, {cof} from (
            select step, {keys}, {bs}, {sums} from (select *, 1 / (1 + exp(-({' + '.join(f'b{i} * x{i}' for i in ix)}))) as mu from (
              select *, 1.0 as x0 from {b} join ld using ({keys}))) group by step, {keys}, {bs}))"""

    to = ", ".join(f"b{i} + ({' + '.join(f'{sym(i, j)} * g{j}' for j in ix)}) / det" for i in ix)
    return f""", ld as ({data}), recursive lb as (select 0 as step, {keys}, {', '.join(f'cast(0 as double) as b{i}' for i in ix)} from (select distinct {keys} from ld)
        union all select step + 1, {keys}, {to} from ({solved('lb')}) where step < {steps}), ll as (select * from lb where step = {steps}),
        fits as (select {keys}, {bs}, {', '.join(f'b{i} / sqrt(c{i}{i} / det) as z{i}' for i in ix)} from ({solved('ll')}))"""


def SHAPED(data: str, p: int, mean: str, parts: dict[str, str], start: tuple[str, str], steps: int = 40) -> str:
    """Newton steps for ``p`` coefficients and the logarithm ``th`` of a shape, as a recursive query.

    ``data`` has y, w, off, x1.. and what ``parts`` use: the first and second
    derivatives s, t, ss, st, tt of a row's log likelihood, with mu = ``mean`` of
    eta. A step changes no parameter by more than 1. The tables ``lastp`` (b0..,
    th) and ``fitp`` (b0.., v00.. from the curvature) hold the result.
    """
    ix, full = range(p), range(p + 1)
    bs = ", ".join([*(f"b{i}" for i in ix), "th"])
    pairs = [(i, j) for i in full for j in full if i <= j]
    xs = lambda i: f"x{i}" if i < p else "1"
    second = lambda i, j: "tt" if i == p else "st" if j == p else "ss"
    sym = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def solved(b: str) -> str:
        rows = f"""select *, {', '.join(f'{e} as {n}' for n, e in parts.items() if n[0] == '_')} from (select *, {mean} as mu from (
            select *, 1.0 as x0, exp(th) as k, {' + '.join(f'b{i} * x{i}' if i else 'b0' for i in ix)} + off as eta from {b}, pd))"""
        rows = f"select *, {', '.join(f'w * ({e}) as {n}' for n, e in parts.items() if n[0] != '_')} from ({rows})"
        sums = ", ".join([f"sum({second(i, j)} * {xs(i)} * {xs(j)}) as h{i}{j}" for i, j in pairs]
                         + [f"sum({'t' if i == p else 's'} * {xs(i)}) as g{i}" for i in full])
        cof = ", ".join(
            f"{'-' if (i + j) % 2 else ''}({_det(tuple(k for k in full if k != i), tuple(k for k in full if k != j))}) as c{i}{j}" for i, j in pairs)
        return f"""select *, {' + '.join(f'h0{j} * c0{j}' for j in full)} as det from (select *, {cof} from (
            select step, {bs}, {sums} from ({rows}) group by step, {bs}))"""

    moves = ", ".join(f"-({' + '.join(f'{sym(i, j)} * g{j}' for j in full)}) / det as d{i}" for i in full)
    cap = f"least(1, 1 / greatest({', '.join(f'abs(d{i})' for i in full)}, 1e-300))"
    to = ", ".join([*(f"b{i} + d{i} * {cap}" for i in ix), f"th + d{p} * {cap}"])
    first = ", ".join([*(f"cast({start[0] if i == 0 else 0} as double) as b{i}" for i in ix), f"cast({start[1]} as double) as th"])
    return f""", pd as ({data}), recursive p as (select 0 as step, {first} union all
        select step + 1, {to} from (select *, {moves} from ({solved('p')})) where step < {steps}), lastp as (select * from p where step = {steps}),
        fitp as (select {bs}, {', '.join(f'-c{i}{j} / det as v{i}{j}' for i, j in pairs if j < p)} from ({solved('lastp')}))"""


def COEFS(*names: str) -> str:
    """Coefficient rows of ``fitv``; the intercept is named last but stands first there."""
    order = [*range(1, len(names)), 0]
    return " union all ".join(
        f"""select '{name}' as term, {R(f'b{i}')} as estimate, {R(f'sqrt(v{i}{i})')} as se,
        {R(f'b{i} - 1.959963984540054 * sqrt(v{i}{i})')} as lo, {R(f'b{i} + 1.959963984540054 * sqrt(v{i}{i})')} as hi from fitv"""
        for name, i in zip(names, order))


def LINEAR(xs: list[str]) -> tuple[str, str]:
    """Linear predictor and its standard error for the design terms ``xs`` (intercept first)."""
    eta = " + ".join(f"b{i} * ({x})" for i, x in enumerate(xs))
    var = " + ".join(f"v{min(i, j)}{max(i, j)} * ({x}) * ({z})" for i, x in enumerate(xs) for j, z in enumerate(xs))
    return eta, f"sqrt({var})"


def with_bases(body: str) -> str:
    """Put the needed base tables, and what they need, in front of a body,
    which may go on with tables of its own (", name as (...) select ...")."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BASES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(BASES[name])

    visit(body)
    ordered = [f"{name} as ({BASES[name]})" for name in BASES if name in needed]
    start = "with recursive " if re.search(r"\brecursive\b", body) else "with "
    body = re.sub(r"\brecursive ", "", body.strip())
    if ordered:
        return start + ",\n".join(ordered) + "\n" + body
    return start + body[1:] if body.startswith(",") else body
