"""Log-shaped views over the sample tables, by the same SQL in Spark and DuckDB.

``log_view``: one line an event and a blank line after every 13th; ``access_view``: one request an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _log_sql(spark: bool) -> str:
    st = "string" if spark else "varchar"
    ts = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")" if spark else "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')"
    return f"""
select user_id % 10 as source_id, event_id * 2 as line_no,
       '[' || {ts} || 'Z] '
       || case event_type when 'error' then 'ERROR request failed' when 'purchase' then 'WARNING slow commit' else event_type end
       || ' user=' || cast(user_id as {st}) || ' path=/srv/app/' || event_type || '/mod' || cast(user_id % 7 as {st})
       || '.log value=' || cast(value as {st}) || ' ' || props as line
from events
union all
select user_id % 10, event_id * 2 + 1, '' from events where event_id % 13 = 12"""


def _access_sql(spark: bool) -> str:
    st = "string" if spark else "varchar"
    ts = "date_format(e.ts, \"yyyy-MM-dd HH:mm:ss\")" if spark else "strftime(e.ts, '%Y-%m-%d %H:%M:%S')"
    return f"""
select e.event_id as line_no, '10.0.' || cast(user_id % 8 as {st}) || '.' || cast(user_id % 200 as {st}) as ip, p.url as path, {ts} as time,
       case event_type when 'signup' then 'POST' when 'purchase' then 'PUT' else 'GET' end as method,
       case event_type when 'view' then '200' when 'click' then '200' when 'signup' then '302'
            when 'purchase' then (case when value < 100 then '404' else '200' end)
            else (case when value > 60 then '503' else '500' end) end as status,
       case when user_id % 11 = 0 then '-' else cast(cast(round(value * 10) as bigint) as {st}) end as bytes,
       case when user_id % 5 = 0 then 'kube-probe/1.2' when user_id % 5 = 1 then 'curl/8.0' when user_id % 5 = 2 then 'Googlebot/2.1' when user_id % 5 = 3 then 'Mozilla/5.0' else '-' end as ua,
       case when user_id % 4 = 0 then '-' else 'https://ref' || cast(user_id % 4 as {st}) || '.example' end as referer,
       case when user_id % 3 = 0 then 'nginx' else 'Envoy' end as source,
       cast(round(value * 5) as bigint) as duration_ms
from events e cross join (select count(*) as n from pages) c join pages p on e.event_id % c.n = p.page_id"""


LOG, ACCESS = _log_sql(False), _access_sql(False)


def _sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...]) -> DataFrame:
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _log_sql(True).replace("from events", "from {events}"), ("events",))


def access_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the page count is one row; the planner broadcasts it
    return _sql(spark, sf_dir, _access_sql(True).replace("from events", "from {events}").replace("from pages", "from {pages}").replace("join pages", "join {pages}"), ("events", "pages"))
