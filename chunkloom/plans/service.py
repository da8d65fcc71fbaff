"""Queries over the queue, usage and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import context, sequences
from ..sources.tables import table
from ..streaming import queue
from .queries import Registered

query = Registered()
QUERIES, SQL = query.queries, query.sql


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "jobs")


@query("""SELECT job_id, request_id, question_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at, status, request_id) AS n FROM jobs) WHERE n = 1""")
def queue_idempotent(spark, sf_dir):
    """Each job once, as it first arrived."""
    w = Window.partitionBy("job_id").orderBy("received_at", "status", "request_id")
    return _jobs(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").select("job_id", "request_id", "question_id", "status")


@query("""SELECT request_id, count(*) AS rows, count(DISTINCT job_id) AS jobs, count(DISTINCT query) > 1 AS conflict FROM jobs WHERE request_id IS NOT NULL GROUP BY 1""")
def queue_conflicts(spark, sf_dir):
    """Requests sent again, and whether their text changed."""
    return _jobs(spark, sf_dir).filter("request_id IS NOT NULL").groupBy("request_id").agg(F.count("*").alias("rows"), F.countDistinct("job_id").alias("jobs"), (F.countDistinct("query") > 1).alias("conflict"))


@query("""WITH j AS (SELECT DISTINCT job_id, epoch_us(created_at) AS a, epoch_us(finished_at) AS b FROM jobs WHERE finished_at > created_at), e AS (SELECT a AS moment, 1 AS step FROM j UNION ALL SELECT b, -1 FROM j),
r AS (SELECT moment // 86400000000 AS day, sum(step) OVER (PARTITION BY moment // 86400000000 ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS running FROM e) SELECT day, max(running) AS most FROM r GROUP BY 1""")
def queue_serial(spark, sf_dir):
    """The most jobs that ran at once on each day, of those that began on it: starts and ends summed in order of time; an end comes before a start."""
    j = _jobs(spark, sf_dir).filter("finished_at > created_at").select("job_id", F.unix_micros("created_at").alias("a"), F.unix_micros("finished_at").alias("b")).distinct()
    e = j.select(F.col("a").alias("at"), F.lit(1).alias("step")).unionByName(j.select(F.col("b").alias("at"), F.lit(-1).alias("step")))
    timed = e.withColumn("day", F.expr("at div 86400000000"))
    return sequences.running(timed, "day", F.expr("at div 600000000"), ["at", "step"], F.col("step"), "running").groupBy("day").agg(F.max("running").alias("most"))


@query("""WITH j AS (SELECT question_id, status FROM jobs WHERE question_id IS NOT NULL), c AS (SELECT question_id, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'no_answer') AS none FROM j GROUP BY 1)
SELECT question_id, jobs, CASE WHEN failed > 0 AND answered + none > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' WHEN answered = jobs THEN 'ok' WHEN answered > 0 THEN 'partial' WHEN none > 0 THEN 'no_answer' ELSE 'open' END AS status FROM c""")
def status_rollup(spark, sf_dir):
    """One status for each question from all its jobs."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    c = _jobs(spark, sf_dir).filter("question_id IS NOT NULL").groupBy("question_id").agg(F.count("*").alias("jobs"), count("failed").alias("failed"), count("answered").alias("answered"), count("no_answer").alias("none"))
    status = F.expr("CASE WHEN failed > 0 AND answered + none > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' WHEN answered = jobs THEN 'ok' WHEN answered > 0 THEN 'partial' WHEN none > 0 THEN 'no_answer' ELSE 'open' END")
    return c.select("question_id", "jobs", status.alias("status"))


@query("""SELECT status, stage, count(*) AS jobs, min(job_id) AS first, max(job_id) AS last, sum(retries) AS retries FROM jobs GROUP BY 1, 2""")
def outcome_counts(spark, sf_dir):
    """Jobs by outcome and stage."""
    return _jobs(spark, sf_dir).groupBy("status", "stage").agg(F.count("*").alias("jobs"), F.min("job_id").alias("first"), F.max("job_id").alias("last"), F.sum("retries").alias("retries"))


@query("""SELECT event_type, user_id, count(*) AS events, sum((props->>'k')::BIGINT) AS k, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def usage_totals(spark, sf_dir):
    """Numeric usage summed from JSON, by type and user."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("events"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.round(F.sum("value"), 2).alias("value"))


_ANSWERS_SQL = """SELECT l_orderkey AS id, string_agg(CASE l_linenumber % 4 WHEN 0 THEN '[S' || l_linenumber || ', S' || (l_linenumber + 1) || ']' WHEN 2 THEN '[ S' || l_linenumber || '；S' || (l_linenumber + 2) || '、 S1 ]' WHEN 3 THEN '[S' || l_linenumber || '; key] [0]' ELSE '[S' || l_linenumber || ']' END, ' and ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS answer FROM lineitem GROUP BY 1"""


def _answers(spark, sf_dir):
    """An answer for each order that cites its lines, singly, in groups of every separator, and in brackets that are no citation."""
    n = F.col("l_linenumber").cast("string")
    plus = lambda k: (F.col("l_linenumber") + k).cast("string")
    shape = F.col("l_linenumber") % 4
    mark = (
        F.when(shape == 0, F.concat(F.lit("[S"), n, F.lit(", S"), plus(1), F.lit("]")))
        .when(shape == 2, F.concat(F.lit("[ S"), n, F.lit("；S"), plus(2), F.lit("、 S1 ]")))
        .when(shape == 3, F.concat(F.lit("[S"), n, F.lit("; key] [0]")))  # no citation: not all of it is ids
        .otherwise(F.concat(F.lit("[S"), n, F.lit("]")))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", mark.alias("m")).alias("x"))
    marks = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"])  # the lines of one order
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(marks, " and ").alias("answer"))


_CITED_SQL = rf"regexp_extract_all(array_to_string(regexp_extract_all(answer, '\[\s*S[0-9]+(?:\s*[,，、;；]\s*S[0-9]+)*\s*\]'), ''), 'S[0-9]+')"


@query(rf"""SELECT id, array_to_string({_CITED_SQL}, ',') AS cited FROM ({_ANSWERS_SQL})""")
def cite_markers(spark, sf_dir):
    """Ids cited in single and grouped marks."""
    return _answers(spark, sf_dir).select("id", F.array_join(T.citation_ids(F.col("answer")), ",").alias("cited"))


@query(rf"""WITH c AS (SELECT id, {_CITED_SQL} AS s FROM ({_ANSWERS_SQL})), k AS (SELECT id, list_sort(list_distinct(s)) AS u, s FROM c)
SELECT id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS used, array_to_string(list_filter(list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: NOT list_contains(['S1', 'S2', 'S3', 'S4'], x)), ',') AS unknown,
array_to_string(list_filter(['S1', 'S2', 'S3', 'S4'], lambda x: NOT list_contains(s, x)), ',') AS unused FROM k""")
def cite_unknown_unused(spark, sf_dir):
    """Of four known sources and the cited ones: used in order, unknown, unused."""
    known = F.array(*[F.lit(f"S{k}") for k in range(1, 5)])
    return context.citation_check(_answers(spark, sf_dir).withColumn("known", known))


@query("""WITH p AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type = 'purchase') SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS last_purchase FROM events e LEFT JOIN p ON p.user_id = e.user_id AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id <= e.event_id)) GROUP BY 1""")
def asof_join(spark, sf_dir):
    """Each event with its user's latest purchase so far: an as-of join without a join of events."""
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequences.carried(rows, "user_id", F.expr("unix_date(cast(ts as date))"), ["ts", "event_id"], bought, "last_purchase").select("event_id", "last_purchase")


@query("SELECT DISTINCT job_id, query FROM jobs WHERE job_id IS NOT NULL")
def stream_submitted(spark, sf_dir):
    """The queue as a stream: a job sent again is dropped by keyed state, which is forgotten when the watermark has passed it."""
    jobs = queue.submitted_once(queue.arriving(spark, f"{sf_dir}/jobs.parquet")).select("job_id", "query")
    return queue.drained(jobs, spark)


_HOURLY = """SELECT epoch(created_at)::BIGINT // 3600 * 3600 AS hour, status, count(*) AS jobs FROM jobs WHERE created_at IS NOT NULL GROUP BY 1, 2"""


@query(_HOURLY)
def stream_hourly(spark, sf_dir):
    """Load by hour and status as a windowed stream that gives an hour again whenever it changes; the last figure of each counts."""
    return queue.drained(queue.hourly_load(queue.arriving(spark, f"{sf_dir}/jobs.parquet")), spark, keys=["hour", "status"])


@query(_HOURLY)
def hourly_load(spark, sf_dir):
    """The same load over the whole table at once."""
    return _jobs(spark, sf_dir).filter("created_at IS NOT NULL").groupBy(F.window("created_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("jobs")).select(F.unix_seconds("w.start").alias("hour"), "status", "jobs")


@query("""SELECT status, job_id, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, job_id, received_at) AS rank FROM jobs WHERE created_at IS NOT NULL QUALIFY rank <= 10""")
def queue_history(spark, sf_dir):
    """The ten latest jobs of each status: a top-k report."""
    w = Window.partitionBy("status").orderBy(F.desc("created_at"), "job_id", "received_at")
    return _jobs(spark, sf_dir).filter("created_at IS NOT NULL").select("status", "job_id", F.row_number().over(w).alias("rank")).filter("rank <= 10")


@query("""SELECT DISTINCT job_id, question_id FROM jobs j WHERE finished_at IS NULL AND NOT EXISTS (SELECT 1 FROM jobs d WHERE d.question_id = j.question_id AND d.status = 'answered')""")
def queue_resume(spark, sf_dir):
    """Open jobs whose question no other job has answered: an anti-join on the answered ones."""
    done = _jobs(spark, sf_dir).filter("status = 'answered' AND question_id IS NOT NULL").select("question_id").distinct()
    return _jobs(spark, sf_dir).filter("finished_at IS NULL").join(done, "question_id", "left_anti").select("job_id", "question_id").distinct()
