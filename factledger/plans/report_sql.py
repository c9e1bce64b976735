"""DuckDB SQL of the report tables, as common table expressions that the queries build on."""

from factledger.operators import replicates

LINES = """lines as (
  select l_orderkey as invoice_no, cast(o_orderdate as date) as day, n_name as country, upper(trim(p_name)) as product, p_brand as brand,
    cast(l_quantity as bigint) as quantity,
    cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(24,4)) as revenue, l_returnflag as flag
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join part on l_partkey = p_partkey),
clean as (
  select *, cast(date_trunc('week', day) as date) as week_start, cast(isoyear(day) as varchar) || '-W' || lpad(cast(week(day) as varchar), 2, '0') as week
  from lines where flag <> 'R' and quantity > 0 and revenue > 0 and country is not null and product <> '')"""


def weekly(entity: str, name: str = "weekly") -> str:
    return f"""{name} as (
  select week, week_start, {entity} as entity, cast(sum(revenue) as double) as revenue, cast(sum(quantity) as bigint) as units,
    count(distinct invoice_no) as orders from clean group by week, week_start, {entity})"""


def report(top: int) -> str:
    return f"""ranked as (
  select * from (select *, row_number() over (partition by week order by revenue desc, entity) as pos from weekly where revenue > 0) where pos <= {top}),
known as (select distinct week as ly_week, true as known from weekly),
levels as (
  select r.week, r.entity, cast(r.pos as integer) as pos, round_even(r.revenue * 100, 0) / 100 as revenue_tw,
    coalesce(round_even(l.revenue * 100, 0) / 100, 0) as revenue_lw,
    case when k.known then coalesce(round_even(y.revenue * 100, 0) / 100, 0) end as revenue_ly,
    r.units as units_tw, coalesce(l.units, 0) as units_lw, r.orders as orders_tw, coalesce(l.orders, 0) as orders_lw
  from ranked r left join weekly l on l.entity = r.entity and l.week_start + 7 = r.week_start
    left join weekly y on y.entity = r.entity and y.week = cast(cast(r.week[1:4] as integer) - 1 as varchar) || r.week[5:8]
    left join known k on k.ly_week = cast(cast(r.week[1:4] as integer) - 1 as varchar) || r.week[5:8]),
report as (
  select *, case when revenue_lw > 0 then round_even((revenue_tw - revenue_lw) / revenue_lw * 100 * 10, 0) / 10 end as wow_pct,
    case when revenue_ly > 0 then round_even((revenue_tw - revenue_ly) / revenue_ly * 100 * 10, 0) / 10 end as yoy_pct,
    round_even(revenue_tw / cast(sum(cast(revenue_tw as decimal(18,2))) over (partition by week) as double) * 100 * 10, 0) / 10 as share_pct,
    rank() over (partition by week order by revenue_tw desc) as "rank"
  from levels)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def weighed(units: str, rounds: int, *parts: str, name: str = "drawn") -> str:
    """``name``: each unit of ``units`` in each round ``b``, with its uniform number ``x`` and the Poisson number ``w`` by which it counts."""
    p = replicates.PRIME
    hashed = lambda *x: "('0x' || md5(" + " || '|' || ".join(f"cast({y} as varchar)" for y in x) + f")[1:15])::bigint % {p}"
    x = "c0"
    for k in (1, 2, 3):
        x = f"(({x} * seed + c{k}) % {p})"
    reached = " + ".join(f"cast(x >= {t} as bigint)" for t in replicates.POISSON)
    return f"""{name} as (select *, {reached} as w from (select u.*, b, {x} as x from (select *, {hashed(*parts)} as seed from {units}) u,
  (select b, {", ".join(f"{hashed(k, 'b')} as c{k}" for k in range(4))} from range({rounds}) r(b))))"""
