"""DuckDB forms of the tapes in sources.adapters, for the oracles."""

from __future__ import annotations

_CAL = """sec // 60 as minute, sec // 3600 as hour, sec // 86400 as day, (sec // 86400 + 3) // 7 as week,
 cast(year(date '1970-01-01' + cast(sec // 86400 as int)) * 12 + month(date '1970-01-01' + cast(sec // 86400 as int)) - 1 as bigint) as month"""

RAW = f"""raw0 as (
 select l_orderkey as tx_hash, cast(l_linenumber as bigint) as evt_index,
  cast(epoch(l_shipdate) as bigint) + (l_suppkey * 397 + l_partkey * 13 + l_linenumber * 7) % 86400 as sec,
  l_partkey % 100 as condition_id, l_suppkey % 2 as outcome_index, (l_partkey % 100) * 2 + l_suppkey % 2 as token_id,
  (l_partkey % 100) % 2 as winner, (l_partkey % 100) // 5 as family, (l_partkey % 100) % 7 as category,
  l_suppkey as maker, o_custkey as taker, case when l_linestatus = 'O' then 'BUY' else 'SELL' end as side,
  cast(round((l_discount * 8 + l_tax + 0.01) * 100) as bigint) as pc, cast(l_quantity as bigint) as q,
  l_returnflag = 'N' as is_taker, l_returnflag = 'R' as fee_paying, l_orderkey % 3 as builder
 from lineitem join orders on l_orderkey = o_orderkey
), raw as (
 select *, pc * q as cents, cast(case when fee_paying then category % 3 + 5 else 0 end * pc * (100 - pc) * q as bigint) as fee, {_CAL} from raw0
)"""

FILLS = f"""{RAW}, f as (
 select * from raw qualify row_number() over (
  partition by tx_hash, evt_index order by sec, maker, taker, token_id, pc, q, side, is_taker, fee_paying) = 1
)"""

TRADES = f"""t0 as (
 select event_id, epoch_us(ts) as us, epoch_us(ts) // 1000000 as sec, user_id as wallet,
  cast(json_extract_string(props, '$.k') as bigint) as k,
  case when event_type in ('purchase', 'view') then 'BUY' else 'SELL' end as side,
  cast(round(value * 100) as bigint) as size, (event_id * 37) % 97 + 1 as pc
 from events where event_type <> 'signup'
), t as (
 select *, k % 10 as asset_id, (k % 10) // 2 as condition_id, (k % 10) % 2 as outcome_index, ((k % 10) // 2) % 2 as winner,
  pc * size as notional, {_CAL} from t0
)"""


def fills_sql(query: str, *more: str) -> str:
    return f"with {', '.join([FILLS, *more])} {query}"


def raw_sql(query: str, *more: str) -> str:
    return f"with {', '.join([RAW, *more])} {query}"


def trades_sql(query: str, *more: str) -> str:
    return f"with {', '.join([TRADES, *more])} {query}"
