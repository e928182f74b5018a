"""SQL twins of the registered queries, in the dialect of DuckDB.

They restate the queries over the raw tables; no expression is shared with the
DataFrame code.
"""

from __future__ import annotations


def r(expression: str) -> str:
    return f"round(cast({expression} as double), 6)"


def ratio(a: str, b: str) -> str:
    return r(f"case when ({b}) <> 0 then cast({a} as double) / cast({b} as double) end")


TABLES = """
amounts as (
  select l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, l_shipdate,
         cast(cast(l_extendedprice as decimal(12,2)) as decimal(19,4)) as gross,
         cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(19,4)) as net,
         cast(l_tax as decimal(3,2)) as rate
  from lineitem),
money as (select *, gross - net as off_, cast(net * rate as decimal(19,4)) as vat from amounts),
per_order as (select l_orderkey, sum(net) as net, sum(off_) as off_, sum(vat) as vat from money group by 1),
own as (select o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_totalprice, r_name as store_id
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
ev as (select 'web-' || cast(user_id % 3 as varchar) as store_id, event_id, user_id, event_type, ts as created_at,
              cast(value as decimal(12,2)) as amount, cast(cast(json_extract_string(props, '$.k') as bigint) % 4 as varchar) as campaign_id
       from events),
o_ as (
  select store_id, cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id, o_orderdate as created_at, 'USD' as currency,
         cast(coalesce(net, 0) as decimal(19,4)) as subtotal, cast(coalesce(off_, 0) as decimal(19,4)) as discount, cast(coalesce(vat, 0) as decimal(19,4)) as tax,
         cast(cast(o_totalprice as decimal(12,2)) as decimal(19,4)) as total,
         case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else 'partially_paid' end as financial_status
  from own left join per_order on o_orderkey = l_orderkey
  union all
  select store_id, 'e' || cast(event_id as varchar), 'u' || cast(user_id as varchar), created_at, 'EUR', amount, 0, 0, amount, 'paid' from ev where event_type = 'purchase'),
l_ as (select store_id, cast(l_orderkey as varchar) as order_id, l_linenumber as line_no, cast(l_partkey as varchar) as sku, cast(l_quantity as bigint) as quantity, gross as line_revenue
       from money join own on l_orderkey = o_orderkey),
p_ as (select distinct store_id, sku, p_name as title,
              case when p_size % 10 <> 0 then cast(cast(p_retailprice as decimal(12,2)) * (cast(0.5 as decimal(2,1)) + p_partkey % 5) as decimal(19,4)) end as unit_cogs
       from l_ join part on cast(p_partkey as varchar) = sku),
re_ as (select store_id, 're-' || l_returnflag || '-' || cast(l_orderkey as varchar) as refund_id, o_orderdate as created_at, cast(sum(net + vat) as decimal(19,4)) as amount,
               cast(l_orderkey as varchar) as order_id, case l_returnflag when 'R' then 'shopify' else 'stripe' end as source
        from money join own on l_orderkey = o_orderkey where l_returnflag in ('R', 'A') group by store_id, l_returnflag, l_orderkey, o_orderdate),
pay_ as (select store_id, 'ch-' || order_id as payment_id, created_at, total as amount, order_id,
                case when cast(order_id as bigint) % 10 <> 0 then cast(total * cast(0.03 as decimal(3,2)) as decimal(19,4)) end as fee
         from o_ where financial_status = 'paid' and store_id not like 'web-%'),
ad_ as (select store_id, campaign_id, cast(created_at as date) as day,
               coalesce(sum(amount) filter (event_type = 'view'), 0) as spend, count(*) filter (event_type = 'view') as impressions,
               count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'purchase') as conversions,
               coalesce(sum(amount) filter (event_type = 'purchase'), 0) as conversion_value
        from ev where event_type in ('view', 'click', 'purchase') group by all)
"""


def facts(grain: str = "week") -> str:
    at = f"cast(date_trunc('{grain}', created_at) as date)"
    return f"""
{TABLES},
f_orders as (select store_id, {at} as ps, count(*) as orders, sum(subtotal) as revenue, sum(total) as order_value from o_ group by all),
f_lines as (select o.store_id, cast(date_trunc('{grain}', o.created_at) as date) as ps, sum(l.quantity) as units, sum(l.line_revenue) as line_revenue,
                   sum(l.line_revenue) filter (p.unit_cogs is not null) as covered_revenue, sum(l.quantity * p.unit_cogs) as known_cogs
            from l_ l join o_ o using (store_id, order_id) left join p_ p using (store_id, sku) group by all),
f_refunds as (select store_id, {at} as ps, sum(amount) as refunds from re_ where source = 'shopify' group by all),
f_pay as (select store_id, {at} as ps, sum(fee) as payment_fees from pay_ group by all),
f_ads as (select store_id, cast(date_trunc('{grain}', day) as date) as ps, sum(spend) as ad_spend, sum(clicks) as clicks, sum(impressions) as impressions, count(*) as ad_rows from ad_ group by all),
f_first as (select store_id, customer_id, min(created_at) as first_at from o_ group by all),
f_active as (select store_id, customer_id, {at} as ps, count(*) as n, sum(subtotal) as spent from o_ group by all),
f_ranked as (select *, row_number() over (partition by store_id, ps order by spent desc, customer_id) as rk, cast(date_trunc('{grain}', first_at) as date) = ps as is_new from f_active join f_first using (store_id, customer_id)),
f_buyers as (select store_id, ps, count(*) as customers, count(*) filter (is_new) as new_customers, count(*) filter (n > 1) as repeat_customers, sum(spent) filter (rk <= 5) as top5_revenue from f_ranked group by all),
f_keys as (select store_id, ps from f_orders union select store_id, ps from f_refunds union select store_id, ps from f_ads union select store_id, ps from f_pay),
f as (select store_id, ps, coalesce(orders, 0) as orders, coalesce(revenue, 0) as revenue, coalesce(order_value, 0) as order_value, coalesce(units, 0) as units,
             coalesce(line_revenue, 0) as line_revenue, coalesce(covered_revenue, 0) as covered_revenue, coalesce(known_cogs, 0) as known_cogs, coalesce(refunds, 0) as refunds,
             payment_fees, coalesce(ad_spend, 0) as ad_spend, coalesce(clicks, 0) as clicks, coalesce(impressions, 0) as impressions, coalesce(ad_rows, 0) as ad_rows,
             coalesce(customers, 0) as customers, coalesce(new_customers, 0) as new_customers, coalesce(repeat_customers, 0) as repeat_customers, top5_revenue
      from f_keys left join f_orders using (store_id, ps) left join f_lines using (store_id, ps) left join f_refunds using (store_id, ps) left join f_pay using (store_id, ps)
      left join f_ads using (store_id, ps) left join f_buyers using (store_id, ps)),
latest as (select store_id, max(day) as latest_day from (select store_id, cast(created_at as date) as day from o_ union all select store_id, day from ad_) group by 1),
now_ as (select store_id, latest_day,
                case when {_end('cast(date_trunc(' + repr(grain) + ', latest_day) as date)', grain)} - 1 > latest_day
                     then {_shift('cast(date_trunc(' + repr(grain) + ', latest_day) as date)', -1, grain)} else cast(date_trunc('{grain}', latest_day) as date) end as ps from latest)
"""


def _shift(start: str, n: int, grain: str) -> str:
    return f"cast({start} + interval '{n} {grain}' as date)"


def _end(start: str, grain: str) -> str:
    return _shift(start, 1, grain)


PCT = "case when {b} <> 0 then ({a} - {b}) / abs({b}) end"


def pct(a: str, b: str) -> str:
    return PCT.format(a=a, b=b)


def series(grain: str = "week", n: int = 12) -> str:
    step = f"interval '1 {grain}'"
    return f"""{facts(grain)},
days as (select store_id, cast(unnest(generate_series(cast(ps as timestamp) - {n - 1} * {step}, cast(ps as timestamp), {step})) as date) as ps from now_),
wide as (select store_id, ps, coalesce(revenue, 0) as revenue, coalesce(orders, 0) as orders, coalesce(ad_spend, 0) as ad_spend, coalesce(clicks, 0) as clicks, coalesce(refunds, 0) as refunds
         from days left join f using (store_id, ps)),
s as (
  select store_id, 'revenue' as metric, ps, cast(revenue as double) as v from wide union all
  select store_id, 'orders', ps, cast(orders as double) from wide union all
  select store_id, 'aov', ps, case when orders <> 0 then cast(revenue as double) / orders end from wide union all
  select store_id, 'ad_spend', ps, cast(ad_spend as double) from wide union all
  select store_id, 'paid_clicks', ps, cast(clicks as double) from wide union all
  select store_id, 'paid_conversion_rate', ps, case when clicks <> 0 then cast(orders as double) / cast(clicks as double) end from wide union all
  select store_id, 'roas', ps, case when ad_spend <> 0 then cast(revenue as double) / cast(ad_spend as double) end from wide union all
  select store_id, 'refunds', ps, cast(refunds as double) from wide)
"""


def interpolate(x: str, points: list[tuple[float, float]]) -> str:
    out = f"case when {x} is null then null when {x} <= {points[0][0]} then cast({points[0][1]} as double)"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" when {x} <= {x1} then {y0} + ({x} - ({x0})) / ({x1} - ({x0})) * ({y1} - {y0})"
    return out + f" else cast({points[-1][1]} as double) end"
