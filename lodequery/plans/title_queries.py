"""Queries on titles that hold very different numbers of rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import title_profile


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/train.parquet")


QUERIES = {
    "p3_found": lambda spark, d: title_profile.heavy_titles(_train(spark, d)),
    "p3_titles": lambda spark, d: title_profile.title_profiles(_train(spark, d)),
    "p3_lengths": lambda spark, d: title_profile.title_length_percentiles(_train(spark, d)),
}

ORACLES = {
    "p3_found": """
select lower(trim(Title, ' ')) as title from train where Title is not null
group by 1 having count(*) >= 0.02 * (select count(*) from train)""",
    "p3_titles": """
with t as (select lower(trim(Title, ' ')) as title, QueryText, lower(trim(ContentType, ' ')) as ct, log_ts from train where Title is not null),
kinds as (select title, ct, row_number() over (partition by title order by count(*) desc, ct) as rn from t where ct is not null group by title, ct)
select a.*, k.ct as content_type
from (select title, count(*) as n_rows, count(distinct QueryText) as n_queries, min(log_ts) as first_log, max(log_ts) as last_log from t group by title) a
left join kinds k on k.title = a.title and k.rn = 1""",
    "p3_lengths": """
select lower(trim(Title, ' ')) as title,
  cast(percentile_disc(0.5) within group (order by length(QueryText)) as int) as p50,
  cast(percentile_disc(0.9) within group (order by length(QueryText)) as int) as p90
from train where Title is not null and QueryText is not null group by 1""",
}
