"""Queries of parsers, tree differences, sessions, tasks and maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators.diffs import diff_pairs
from graphmill.operators.hierarchy import current_rows
from graphmill.plans import fixtures as X
from graphmill.session import spread, table
from graphmill.sources import parsers as PR
from graphmill.streaming import live

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _files(s, d):
    return current_rows(table(s, d, "files").select("path", "scanned_at", "content"), "path", "scanned_at", ["content"])


@query("parse_symbols")
def _(s, d):
    return PR.extract_symbols(spread(_files(s, d))).select("id", "name", "kind", "file_path", "start_line", "end_line", "parent_id", "language", "qualified_name", "token_count")


@query("parse_edges")
def _(s, d):
    return PR.extract_edges(spread(_files(s, d))).select("src", "dst", "edge_type")


@query("tree_diff")
def _(s, d):
    a, b = X.docs_v1(s, d), X.docs_v2(s, d).withColumnRenamed("text", "new_text")
    return diff_pairs(a.join(b, "doc_id").filter("text <> new_text"), "doc_id", "text", "new_text").select("doc_id", "distance", "op", "label", "bounded", "truncated")


@query(
    "session_debounce",
    """with e as (select user_id, ts, case when lag(ts) over w is null or ts > lag(ts) over w + interval 30 minutes or ts = lag(ts) over w + interval 30 minutes then 1 else 0 end as starts from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as n from e)
    select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) as events from g group by user_id, n""",
)
def _(s, d):
    return live.sessions(table(s, d, "events"), "user_id", "ts")


_TASKS = "select user_id as task_id, case event_type when 'signup' then 'create' when 'view' then 'create' when 'purchase' then 'complete' when 'error' then 'fail' else 'touch' end as event, ts as t_at from events"


@query(
    "ttl_expiry",
    f"""with t as ({_TASKS}), b as (select task_id, min(epoch_us(t_at) // 1000) as born from t where event = 'create' group by 1),
    e as (select t.task_id, epoch_us(t.t_at) // 1000 as ms, event from t join b using (task_id) where event in ('complete', 'fail', 'cancel') and epoch_us(t.t_at) // 1000 between born and born + 3600000),
    f as (select task_id, arg_min(event, struct_pack(m := ms, e := event)) as event from e group by 1)
    select b.task_id, case f.event when 'complete' then 'completed' when 'fail' then 'failed' else 'cancelled' end as status from b left join f using (task_id)""",
)
def _(s, d):
    kind = F.when(F.col("event_type").isin("signup", "view"), "create").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("touch")
    ev = table(s, d, "events").select(F.col("user_id").alias("task_id"), kind.alias("event"), F.col("ts").alias("at"))
    return live.task_outcomes(ev, 3_600_000)


@query("session_replay", "with k as (select user_id, event_id, length(props) as size, row_number() over (partition by user_id order by ts, event_id) as seq from events), r as (select *, row_number() over (partition by user_id order by seq desc) as n from k) select user_id, event_id, seq from r where n <= 256 and seq > 5")
def _(s, d):
    e = table(s, d, "events").withColumn("size", F.length("props"))
    return live.replay_after(e, "user_id", ["ts", "event_id"], "size", 5).select("user_id", "event_id", "seq")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
