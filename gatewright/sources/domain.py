"""Domain tables bound to the star-schema tables, as SQL that Spark and DuckDB both run.

Each text is a deterministic projection with injected defects. ``cte_prefix`` puts them before
a query as common table expressions; only those that the query reaches are planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DOMAIN_SQL: dict[str, str] = {
    "security_master": """
select concat('INS-',c_custkey) instrument_id,
 concat('CUS', case when c_custkey%37=1 then c_custkey-1 else c_custkey end) cusip,
 case when c_custkey%41=0 then null else case c_custkey%5 when 0 then 'Equity' when 1 then 'Bond' when 2 then 'ETF' when 3 then 'Option' else 'Cash' end end asset_class,
 case when c_custkey%43=0 then null when c_custkey%47=0 then 'ZZZ' else case c_nationkey%5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' when 3 then 'JPY' else 'CAD' end end currency,
 case when c_custkey%5=0 and c_custkey%4<>0 then c_mktsegment end sector,
 case when c_custkey%5 in (0,2) then case when c_custkey%7=0 then null when c_custkey%7=1 then 'BM-NONE' else 'BM-SP500' end end benchmark_id,
 case when c_custkey%5=1 and c_custkey%11<>0 then case when c_custkey%13=0 then date '2024-01-10' else date '2034-01-01' end end maturity_date,
 case when c_custkey%5=1 then cast(case when c_custkey%17=0 then -0.01 when c_custkey%17=1 then 0.25 else 0.03 end as decimal(6,4)) end coupon_rate,
 'security_master.csv' source_file, c_custkey+2 source_row from customer
""",
    "pricing": """
select concat('INS-',e.user_id) instrument_id, cast(case when e.event_id%1009=5 then timestamp '2099-01-01 00:00:00' else e.ts end as date) price_date,
 cast(case when e.event_id%101=7 then -e.value when e.event_id%103=9 then 0 else e.value end as decimal(18,2)) price,
 case when e.event_id%97=0 then 'XXX' else coalesce(s.currency,'USD') end currency, 'pricing.csv' source_file, e.event_id+2 source_row
 from events e left join security_master s on s.instrument_id=concat('INS-',e.user_id)
""",
    "positions": """
select concat('F',substr(o_orderpriority,1,1)) fund_id, case when o_orderkey%211=0 then 'INS-ORPHAN' else concat('INS-',o_custkey) end instrument_id,
 cast(date '2024-01-01' + cast(o_orderkey%30 as integer) as date) position_date,
 cast(case when o_orderkey%113=0 then -1 else 1 end*(o_orderkey%50+1) as decimal(18,2)) quantity, cast(o_totalprice as decimal(18,2)) market_value,
 case when o_orderkey%199=0 then 'CHF' else case o_custkey%5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' when 3 then 'JPY' else 'CAD' end end local_currency, 'positions.csv' source_file, o_orderkey+2 source_row from orders
""",
    "funds": """
select fund_id, position_date nav_date, cast(round(sum(market_value)*case when day(position_date)%7=0 then 1.08 else 1.0001 end,2) as decimal(18,2)) reported_nav,
 'funds.csv' source_file, cast(day(position_date)*10+cast(substr(fund_id,2,1) as integer) as bigint) source_row from positions group by fund_id, position_date
""",
    "fx_rates": """
select c.ccy currency_code, d.d rate_date from (values ('EUR'),('GBP'),('JPY'),('CAD')) c(ccy), (select distinct position_date d from positions) d where not (c.ccy='CAD' and day(d.d)=15)
""",
    "ref_benchmarks": """
select 'BM-SP500' benchmark_id
""",
    "ref_currency": """
select * from (values ('USD'),('EUR'),('GBP'),('JPY'),('CAD')) c(currency_code)
""",
    "vendor_record": """
select concat('V',o_orderkey%6,'_S',cast(floor(o_orderkey/6) as int)%3,'_',case when o_orderkey%6=0 and o_custkey%20=0 then 1 else 0 end,'.csv') source_file, o_orderkey source_row,
 concat('VENDOR_',o_orderkey%6) vendor, concat('S',cast(floor(o_orderkey/6) as int)%3) schema_name,
 case when o_orderkey%89=0 then '' when o_orderkey%83=0 then 'INST-99999' else concat('INST-',o_custkey) end instrument_id,
 case when o_orderkey%71=0 then '' when o_orderkey%73=0 then '2026-10-10' when o_orderkey%67=0 then '2026-09-29' when o_orderkey%59=0 then '2026-09-25' else concat('2026-10-0',1+o_orderkey%4) end as_of_date,
 case when o_orderkey%53=0 then 'ZZZ' else 'USD' end currency,
 case when o_orderkey%79=0 then 'NOT_A_NUMBER' when o_orderkey%47=0 then '-5.5' when o_orderkey%43=0 then '99999.0' when o_orderkey%41=0 then concat(200+o_custkey%50,'.25') else concat(100+o_custkey%50,'.25') end value1,
 10 declared_column_count, case when o_orderkey%6=5 and o_custkey%30=0 then 11 else 10 end actual_column_count, case when o_orderkey%6=4 and o_custkey%30=0 then true else false end missing_required_column from orders
""",
    "schema_bounds": """
select * from (values ('S0',10000.0,false),('S1',10000.0,false),('S2',10000.0,true)) b(schema_name,value1_upper_bound,allow_negative_value1)
""",
    "pnl_src": """
select event_type fund_id, concat('INS-',user_id) instrument_id, cast(ts as date) position_date, sum(cast(value as decimal(18,2))) market_value from events group by event_type,user_id,cast(ts as date)
""",
    "vendor_records": """
select as_of_date, instrument_id, value1, value2, currency, source_vendor, schema,
 case when okey%1013=4 then '' when okey%1009=3 then concat('bad_',schema,'.csv') else concat(schema,'_',lpad(cast(file_no as varchar(10)),3,'0'),'.csv') end source_file,
 source_row, asset_class, allow_negative_value1, value1_min, value1_max from (
 select o_orderkey okey, case when o_orderkey%71=0 then '' when o_orderkey%73=0 then '2026-10-01' when o_orderkey%67=0 then '2026-10-10' when o_orderkey%61=0 then '10-05-2026' else '2026-10-05' end as_of_date,
 case when o_orderkey%89=0 then '' when o_orderkey%83=0 then 'XYZ00001' when o_orderkey%79=0 then 'EQU1' else concat(case o_orderkey%5 when 0 then 'EQU' when 1 then 'BON' when 2 then 'ETF' when 3 then 'SWA' else 'OPT' end, lpad(cast(case when o_orderkey%150=80 then o_orderkey-5 else o_orderkey end as varchar(10)),5,'0')) end instrument_id,
 case when o_orderkey%59=0 then null when o_orderkey%53=0 then -10.0 when o_orderkey%47=0 then 2000000.0 when o_orderkey%43=0 then 0.0 when o_orderkey%41=0 then 200000.0 when o_orderkey%37=0 then -2000.0 else o_orderkey+0.5 end*cast(1 as double) value1,
 case when o_orderkey%31=0 then null when o_orderkey%29=0 then -0.1 when o_orderkey%23=0 then 1.5 when o_orderkey%101=0 then 1.0 else 0.5 end*cast(1 as double) value2,
 case when o_orderkey%97=0 then '' when o_orderkey%103=0 then 'US' when o_orderkey%107=0 then 'EUR' else 'USD' end currency,
 case when o_orderkey%109=0 then '' when o_orderkey%113=0 then 'vendor_x' else 'vendor_a' end source_vendor,
 case o_orderkey%5 when 0 then 'equity_us' when 1 then 'bond_us' when 2 then 'etf_us' when 3 then 'swap_us' else 'option_us' end schema,
 case o_orderkey%5 when 0 then 'equity' when 1 then 'bond' when 2 then 'etf' when 3 then 'swap' else 'option' end asset_class,
 o_orderkey%5=3 allow_negative_value1, case when o_orderkey%5=3 then -1000.0 else 0.0 end*cast(1 as double) value1_min, cast(100000 as double) value1_max,
 cast(floor(o_orderkey/75) as int) + case when o_orderkey%1500=7 then 1 else 0 end file_no, case when o_orderkey%997=1 then -1 else cast(floor((o_orderkey%75)/5) as int) end source_row
 from orders where not (o_orderkey%5=3 and o_orderkey>=1500)) o
""",
    "file_manifest": """
select schema, source_file file_name, count(*) row_count from vendor_records group by schema, source_file union all select 'equity_us', 'equity_us_999.csv', 0
""",
}


def cte_prefix(names: list[str] | None = None) -> str:
    """``WITH`` clauses of the domain tables that ``names`` need (all by default), in order."""
    wanted = set(names or DOMAIN_SQL)
    for name in reversed(list(DOMAIN_SQL)):
        if name in wanted:
            wanted |= {n for n in DOMAIN_SQL if n != name and f" {n}" in DOMAIN_SQL[name].replace("\n", " ")}
    return "WITH " + ",\n".join(f"{n} AS ({DOMAIN_SQL[n].strip()})" for n in DOMAIN_SQL if n in wanted)


def spark_prefix(sf_dir: str, names: list[str] | None = None) -> str:
    """``cte_prefix`` with the star-schema tables read from Parquet under ``sf_dir``."""
    body = cte_prefix(names)
    base = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in BASE_TABLES if f" {b}" in body.replace("\n", " ")]
    return "WITH " + ",\n".join([*base, body.removeprefix("WITH ")])


def domain_table(spark: SparkSession, sf_dir: str, name: str, base: dict[str, DataFrame] | None = None) -> DataFrame:
    """One domain table over the star schema under ``sf_dir``.

    ``base`` keeps the star-schema tables that were read, so that further calls do not look up their files again.
    """
    base, body = {} if base is None else base, cte_prefix([name]).removeprefix("WITH ")
    used = [b for b in BASE_TABLES if f" {b}" in body.replace("\n", " ")]
    for b in used:
        if b not in base:
            base[b] = spark.read.parquet(f"{sf_dir}/{b}.parquet")
    named = [f"{b} AS (SELECT * FROM {{{b}}})" for b in used]
    return spark.sql("WITH " + ",\n".join([*named, body]) + f"\nSELECT * FROM {name}", **{b: base[b] for b in used})


def domain_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: domain_table(spark, sf_dir, n) for n in names}
