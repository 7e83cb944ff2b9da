"""Adapter from the sample star-schema tables to the 33 raw discharge columns.

The select text runs on Spark SQL and on DuckDB alike. Dirt (duplicates, bad amounts, blanks,
padded names) is derived from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schema import NAMES

TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "region", "part")

RAW_FIELDS = """
 r_name as hospital_service_area, n_name as hospital_county,
 lpad(cast(s_suppkey as string),7,'0') as operating_certificate_number, cast(s_suppkey as string) as permanent_facility_id,
 case when s_suppkey % 10 = 9 then '  ' || s_name || ' ' else s_name end as facility_name,
 case c_mktsegment when 'AUTOMOBILE' then '0 to 17' when 'BUILDING' then '18 to 29' when 'FURNITURE' then '30 to 49' when 'HOUSEHOLD' then '50 to 69' else '70 or Older' end as age_group,
 cast(c_nationkey+100 as string) as zip_code_3,
 case l_returnflag when 'A' then 'F' when 'N' then 'M' else 'U' end as gender,
 case l_linenumber % 4 when 0 then 'White' when 1 then 'Other Race' when 2 then 'Multi-racial' else 'Black/African American' end as race,
 case o_orderstatus when 'F' then 'Spanish/Hispanic' when 'O' then 'Not Span/Hispanic' end as ethnicity,
 case when l_quantity = 50 then '120 +' when l_orderkey % 101 = 0 then '-1' when l_orderkey % 103 = 0 then '' else cast(cast(l_quantity as int) as string) end as length_of_stay,
 case p_type when 'PROMO' then 'Newborn' when 'SMALL' then 'Elective' when 'LARGE' then 'Urgent' when 'MEDIUM' then 'Trauma' else 'Emergency' end as type_of_admission,
 'Disposition ' || cast(l_linenumber as string) as patient_disposition,
 cast(year(l_shipdate) as string) as discharge_year,
 p_brand as ccsr_diagnosis_code, case when l_orderkey % 107 = 0 then null else upper(p_name) end as ccsr_diagnosis_description,
 case when p_size % 4 = 0 then null else 'PRC' || cast(p_size as string) end as ccsr_procedure_code,
 case when p_size % 4 = 0 then null else 'PROCEDURE ' || cast(p_size as string) end as ccsr_procedure_description,
 cast(p_size as string) as apr_drg_code, 'DRG ' || cast(p_size as string) as apr_drg_description,
 cast(p_size % 26 as string) as apr_mdc_code, 'MDC ' || cast(p_size % 26 as string) as apr_mdc_description,
 cast(l_linenumber % 5 as string) as apr_severity_of_illness_code,
 case l_linenumber % 5 when 1 then 'Minor' when 2 then 'Moderate' when 3 then 'Major' when 4 then 'Extreme' end as apr_severity_of_illness_desc,
 case l_orderkey % 6 when 1 then 'Minor' when 2 then 'Moderate' when 3 then 'Major' when 4 then 'Extreme' when 5 then 'Unknown' end as apr_risk_of_mortality,
 case l_linestatus when 'F' then 'Medical' else 'Surgical' end as apr_medical_surgical_desc,
 case o_orderpriority when '1-URGENT' then 'Medicare' when '2-HIGH' then 'Medicaid' when '3-MEDIUM' then 'Private Health Insurance' when '4-NOT SPECIFIED' then 'Blue Cross/Blue Shield' else 'Self-Pay' end as payment_typology_1,
 case when l_linenumber % 2 = 0 then 'Medicaid' end as payment_typology_2, case when l_linenumber = 7 then 'Self-Pay' end as payment_typology_3,
 cast(2000 + p_size*50 as string) as birth_weight,
 case when l_orderkey % 109 = 0 then '?' when l_tax < 0.05 then 'Y' else 'N' end as emergency_department_indicator,
 case when l_orderkey % 97 = 0 then 'bad' when l_orderkey % 89 = 0 then '-' || cast(cast(l_extendedprice as decimal(14,2)) as string) when l_orderkey % 83 = 0 then ''
  when l_extendedprice >= 1000 then '$' || cast(cast(floor(l_extendedprice/1000) as bigint) as string) || ',' || right(cast(cast(l_extendedprice as decimal(14,2)) as string),6)
  else '$' || cast(cast(l_extendedprice as decimal(14,2)) as string) end as total_charges,
 cast(cast(cast(l_extendedprice as decimal(14,2)) * cast(0.30 as decimal(4,2)) as decimal(14,2)) as string) as total_costs,
 case when l_orderkey % 53 = 0 then 2 else 1 end as copies
"""

RAW_JOINS = """
 join {orders} on o_orderkey=l_orderkey join {customer} on c_custkey=o_custkey
 join {supplier} on s_suppkey=l_suppkey join {nation} on n_nationkey=s_nationkey
 join {region} on r_regionkey=n_regionkey join {part} on p_partkey=l_partkey
"""

RAW_SELECT = "select " + RAW_FIELDS + " from {lineitem} " + RAW_JOINS

# The same rows by other joins: orders meet their customers before the items, which saves a shuffle of the items. Parts come
# before the small tables: where they are too many to be sent to every task, the items are shuffled without those names.
ORDER_SELECT = """
select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey from {orders} join {customer} on c_custkey=o_custkey
"""
LOAD_SELECT = "select " + RAW_FIELDS + """ from {lineitem} join {orders} on o_orderkey=l_orderkey
 join {part} on p_partkey=l_partkey join {supplier} on s_suppkey=l_suppkey
 join {nation} on n_nationkey=s_nationkey join {region} on r_regionkey=n_regionkey
"""

# A question per conversation turn: a request phrase for some conversations, then the turn's own text.
QUESTION_SELECT = """
select conv_id, turn, case conv_id % 9
  when 0 then '不同年龄段的平均住院时长是多少？' when 1 then '不同支付方式占比 '
  when 2 then '各年份住院量的变化趋势 ' when 3 then '1997年疾病费用前5 ' when 4 then 'Top 3 医院 成本 1996 '
  when 5 then 'top100 性别 分布 ' when 6 then '2021年 服务区域 总费用 ' else '' end || text as query
from {conversations}
"""

# A run ledger out of the event stream: one run per user, one ledger event per event.
LEDGER_SELECT = """
select user_id as run_id, event_id as event_seq, 'batch-' || event_type as source_file,
 cast(floor(value * 100) as bigint) as source_size_bytes, ts as started_at,
 case when event_type in ('purchase', 'error') then ts end as finished_at,
 case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status,
 cast(event_id % 11 as int) as chunks_processed, cast(floor(value * 1000) as bigint) as rows_read,
 cast(floor(value * 900) as bigint) as rows_inserted,
 cast(floor(value * 1000) as bigint) - cast(floor(value * 900) as bigint) as rows_dropped,
 '{{"overall":0.' || lpad(regexp_extract(props, '([0-9]+)', 1), 3, '0') || ',"sample_size":' || cast(event_id as string) || '}}' as quality_json,
 case when event_type = 'error' then 'event ' || cast(event_id as string) end as error_message
from {events}
"""


def discharge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """33 text columns, one pass over the joined tables; repeated rows come from ``copies``."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    # The sample table is one file. Of days and tax rates the fields below need the year and the side of a bound only: fewer
    # different values make smaller shuffles.
    items = tables["lineitem"].withColumns({"l_shipdate": F.trunc("l_shipdate", "year"), "l_tax": F.when(F.col("l_tax") < 0.05, 0.0).when(F.col("l_tax") >= 0.05, 1.0)})
    tables["lineitem"] = items.repartition("l_orderkey")
    tables["orders"] = spark.sql(ORDER_SELECT, orders=tables["orders"], customer=tables.pop("customer"))
    once = spark.sql(LOAD_SELECT, **tables)
    return once.select(*NAMES, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, query`` with whole texts."""
    return spark.sql(QUESTION_SELECT, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger table whose runs and events come from the event stream."""
    return spark.sql(LEDGER_SELECT, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
