"""SQL of the queries p2 to p7, over the whole tables."""

_T = "case when regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})') then epoch_us(try_cast(upper({0}) as timestamptz)) end"
EVENT, PRODUCED = _T.format("metadata.event_timestamp"), _T.format("metadata.produced_at")


def _surplus(table: str, business: str) -> str:
    return f"""select record_id from (select record_id,
        metadata.event_id is not null and record_id > min(record_id) over (partition by metadata.event_id) as e,
        payload.{business} is not null and record_id > min(record_id) over (partition by payload.{business}) as b from {table}) where e or b"""


P7 = f"""select 'pos_transactions' as source_table, record_id from ({_surplus('pos_transactions', 'transaction_id')})
union all select 'inventory_events', record_id from ({_surplus('inventory_events', 'movement_id')})"""

_CORRECTED = f"""select store_id, window_start_s, sum(amount) as revenue, count(*) as transactions from (
    select payload.store_id as store_id, (e // 300000000) * 300 as window_start_s, coalesce(payload.total_amount, 0) as amount
    from (select *, {EVENT} as e, {PRODUCED} as p from pos_transactions where record_id not in ({_surplus('pos_transactions', 'transaction_id')}))
    where p - e <= 21600000000 and payload.store_id is not null) group by all"""

P2_CORRECTED = f"select store_id, window_start_s, cast(revenue as decimal(18,2)) as revenue, transactions from ({_CORRECTED})"

P2 = f"""select store_id, window_start_s from (
    select coalesce(c.store_id, s.store_id) as store_id, coalesce(c.window_start_s, s.w) as window_start_s
    from ({_CORRECTED}) c full join (select store_id, cast(epoch(window_start) as bigint) as w, revenue, transactions from store_revenue_5m) s
    on c.store_id = s.store_id and c.window_start_s = s.w
    where coalesce(c.revenue, 0) <> coalesce(s.revenue, 0) or coalesce(c.transactions, 0) <> coalesce(s.transactions, 0))"""

_FOUND3 = f"""with sales as (select record_id, {EVENT} as t, payload from pos_transactions),
    timed as (select * from sales where t is not null),
    lines as (select distinct record_id, t, x.product_id as id from (select record_id, t, unnest(payload.line_items) as x from timed) where x.product_id is not null),
    upd as (select payload.product_id as id, {EVENT} as u, coalesce(payload.is_active, true) as live, record_id as r from product_updates),
    life as (select id, u, live, lead(u) over (partition by id order by u, r) as nxt from upd where u is not null),
    firsts as (select id, min(u) as f from life group by id),
    cust as (select upper(regexp_replace(payload.customer_id, '^\\s+|\\s+$', '', 'g')) as id, min({EVENT}) as f from customer_events group by 1),
    buyers as (select record_id, t, upper(regexp_replace(payload.customer_id, '^\\s+|\\s+$', '', 'g')) as id from timed)
    select record_id, 'product_updates' as ref_table, l.id as ref_id, t from lines l left join firsts f on l.id = f.id where f.f is null or l.t < f.f
    union all select record_id, 'product_updates', l.id, t from lines l join life v on l.id = v.id and not v.live and l.t >= v.u and (v.nxt is null or l.t < v.nxt)
    union all select record_id, 'customer_events', b.id, t from buyers b left join cust c on b.id = c.id where b.id <> '' and (c.f is null or b.t < c.f)
    union all select record_id, 'store_reference', payload.store_id, t from timed where payload.store_id is not null and payload.store_id not in (select store_id from store_reference where store_id is not null)"""

P3 = f"select record_id, ref_table, ref_id from ({_FOUND3})"
P3_REPORT = f"select ref_table, strftime(make_timestamp(t), '%Y-%m-%d') as period, count(*) as n_references, count(distinct ref_id) as n_ids from ({_FOUND3}) group by 1, 2"

_ASOF = """from vw_sales v left join dim_product d on v.product_id = d.product_id and d.effective_from_utc <= v.event_ts_utc and v.event_ts_utc < d.effective_to_utc"""
P4 = f"""select transaction_id, line_number {_ASOF} where d.product_id is not null and (v.brand is distinct from d.brand or v.category is distinct from d.category
    or v.subcategory is distinct from d.subcategory or v.cost_amount is distinct from v.quantity * d.unit_cost)"""
P4_ATTRIBUTES = f"""select transaction_id, line_number, v.product_id, d.brand, d.category, d.subcategory, d.version_number, cast(v.quantity * d.unit_cost as decimal(18,2)) as cost_amount {_ASOF}"""


def _history(table: str, entity: str, first: str, second: str) -> str:
    norm = lambda c: f"lower(regexp_replace(payload.{c}, '^\\s+|\\s+$', '', 'g'))"
    a = f"cast(payload.{first} as varchar)" if table == "product_updates" else norm(first)
    return f"""select '{table}' as source_table, entity_id, cast(row_number() over o as int) as version_no, t as valid_from_us, coalesce(lead(t) over o, -1) as valid_to_us from (
        select *, row_number() over w as n, lag(a) over w as pa, lag(b) over w as pb from (
            select payload.{entity} as entity_id, {EVENT} as t, record_id as r, {a} as a, {norm(second)} as b,
                   metadata.event_id is not null and record_id > min(record_id) over (partition by metadata.event_id) as again from {table})
        where not again and entity_id is not null and t is not null window w as (partition by entity_id order by t, r))
    where n = 1 or a is distinct from pa or b is distinct from pb window o as (partition by entity_id order by t, r)"""


P5 = f"{_history('product_updates', 'product_id', 'list_price', 'category')} union all {_history('customer_events', 'customer_id', 'loyalty_tier', 'home_store_id')}"

def _changes(table: str, entity: str, first: str, second: str) -> str:
    norm = lambda c: f"lower(regexp_replace(payload.{c}, '^\\s+|\\s+$', '', 'g'))"
    a = f"cast(payload.{first} as varchar)" if table == "product_updates" else norm(first)
    return f"""select '{table}' as source_table, entity_id, valid_from, seq, a, b, arrived, cast(least(floor((seq - low) * 3.0 / greatest(1, high - low)), 2) as int) as slot from (
        select payload.{entity} as entity_id, {EVENT} as valid_from, record_id as seq, {a} as a, {norm(second)} as b, epoch_us(kafka_timestamp) as arrived, min(record_id) over () as low, max(record_id) over () as high,
               metadata.event_id is not null and record_id > min(record_id) over (partition by metadata.event_id) as again from {table}) where not again"""


#: After each of the three batches a row ends where the next one known by then begins; the ledger holds each end once, from
#: the first batch after which it held to the first after which it did not.
P5_LEDGER = f"""with u as ({_changes('product_updates', 'product_id', 'list_price', 'category')} union all {_changes('customer_events', 'customer_id', 'loyalty_tier', 'home_store_id')}),
    batches as (select slot as batch, max(arrived) as t from u group by 1),
    known as (select u.*, batch, coalesce(lead(valid_from) over (partition by source_table, entity_id, batch order by valid_from, seq), -1) as valid_to from u join batches on slot <= batch where entity_id is not null and valid_from is not null),
    spans as (select source_table, entity_id, valid_from, seq, a, b, valid_to, min(batch) as first, max(batch) as last from known group by source_table, entity_id, valid_from, seq, a, b, valid_to)
    select source_table, entity_id, valid_from, valid_to, seq, r.t as recorded_at, s.t as superseded_at, a as attribute_a, b as attribute_b
    from spans join batches r on r.batch = first left join batches s on s.batch = last + 1"""

SQL = {"p5_ledger": P5_LEDGER, "p2_found": P2, "p2_corrected": P2_CORRECTED, "p3_found": P3, "p3_report": P3_REPORT, "p4_found": P4, "p4_attributes": P4_ATTRIBUTES, "p5_found": P5, "p7_found": P7}
