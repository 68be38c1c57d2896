"""Queries on the change feed of extracted_drafts (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.changes import current_drafts
from graphloom.operators.history import draft_periods
from graphloom.sources.tables import table


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return current_drafts(table(spark, directory, "extracted_drafts"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return draft_periods(table(spark, directory, "extracted_drafts"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found}

_CHANGES = """
raw as (
  select coalesce(draft_id, 'delivery-' || delivery_id) as draft_id, subject_id,
    nullif(lower(regexp_replace(predicate_key, '[^A-Za-z0-9]', '', 'g')), '') as predicate_key,
    case when observed_at >= 100000000000 then observed_at // 1000 else observed_at end as observed_at,
    coalesce(turn_index, -1) as turn_index,
    case when regexp_extract(coalesce(action, ''), '([A-Za-z]+)', 1) = '' then 'ADD'
      else upper(regexp_extract(action, '([A-Za-z]+)', 1)) end as action,
    object_value, cast(floor(epoch(valid_from)) as bigint) as valid_from, cast(floor(epoch(valid_to)) as bigint) as valid_to
  from extracted_drafts),
changes as (
  select draft_id, max(subject_id) as subject_id, max(predicate_key) as predicate_key, max(observed_at) as observed_at,
    max(turn_index) as turn_index, max(action) as action, max(object_value) as object_value, max(valid_from) as valid_from,
    max(valid_to) as valid_to
  from raw group by draft_id having max(subject_id) is not null and max(predicate_key) is not null and max(observed_at) is not null)
"""

SQL = {
    "p4_found": f"""with {_CHANGES},
ranked as (select *, row_number() over (partition by subject_id, predicate_key order by observed_at desc, turn_index desc, draft_id desc) as rn from changes)
select subject_id, predicate_key, draft_id from ranked where rn = 1 and action <> 'DELETE'""",
    "p5_found": f"""with {_CHANGES},
started as (select *, case when valid_from is null or valid_from = 0 then observed_at else valid_from end as start from changes),
ranked as (select *, row_number() over (partition by subject_id, predicate_key, start order by observed_at desc, turn_index desc, draft_id desc) as rn from started),
held as (select subject_id, predicate_key, start, action, lower(trim(object_value)) as value,
    coalesce(lead(start) over (partition by subject_id, predicate_key order by start), 9999999999) as next_start,
    case when valid_to > start and valid_to < 9999999999 then valid_to else 9999999999 end as own_end
  from ranked where rn = 1),
periods as (select subject_id, predicate_key, start as valid_from, least(next_start, own_end) as valid_to, value from held where action <> 'DELETE'),
marked as (select *, case when lag(valid_to) over w = valid_from and lag(value) over w is not distinct from value then 0 else 1 end as fresh
  from periods window w as (partition by subject_id, predicate_key order by valid_from)),
runs as (select *, sum(fresh) over (partition by subject_id, predicate_key order by valid_from) as run from marked)
select subject_id, predicate_key, min(valid_from) as valid_from, max(valid_to) as valid_to from runs group by subject_id, predicate_key, run""",
}
