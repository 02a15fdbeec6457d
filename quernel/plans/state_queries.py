"""Queries of keyed state, queues, ledgers, registries and rollups over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import rollup, state
from quernel.plans.book import Book
from quernel.sources.tables import NOTES, notes, table

BOOK = Book()
q = BOOK.query
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
#: Events as operations on work items.
_OPS = """ops AS (SELECT 'owner' || CAST(user_id % 5 AS VARCHAR) AS owner, 't' || CAST(user_id AS VARCHAR) || event_type AS target, ts AS "at", event_id AS seq,
 CASE WHEN event_id % 11 = 0 THEN 'revive' WHEN event_id % 3 = 0 THEN 'enqueue' WHEN event_id % 7 = 1 THEN 'complete' ELSE 'fail' END AS op FROM events)"""
#: The queue by walking each item's operations in order.
_QUEUE = f"""WITH RECURSIVE {_OPS}, o AS (SELECT *, row_number() OVER (PARTITION BY owner, target ORDER BY "at", seq) AS k FROM ops),
 s(owner, target, k, state, attempts, enqueued) AS (
  SELECT owner, target, k, CASE WHEN op = 'enqueue' THEN 'pending' END, 0, CASE WHEN op = 'enqueue' THEN "at" END FROM o WHERE k = 1
  UNION ALL SELECT o.owner, o.target, o.k,
   CASE WHEN op = 'enqueue' THEN CASE WHEN state = 'dead' THEN 'dead' ELSE 'pending' END WHEN state IS NULL THEN NULL WHEN op = 'complete' THEN 'done'
    WHEN op = 'fail' AND attempts + 1 >= 3 THEN 'dead' WHEN op = 'revive' AND state = 'dead' THEN 'pending' ELSE state END,
   CASE WHEN op = 'enqueue' AND state = 'done' THEN 0 WHEN state IS NOT NULL AND op = 'fail' THEN attempts + 1 WHEN op = 'revive' AND state = 'dead' THEN 0 ELSE attempts END,
   CASE WHEN state IS NULL AND op = 'enqueue' THEN "at" ELSE enqueued END
  FROM s JOIN o ON o.owner = s.owner AND o.target = s.target AND o.k = s.k + 1),
 queue AS (SELECT owner, target, arg_max(state, k) AS state, arg_max(attempts, k) AS attempts, max(enqueued) AS enqueued FROM (SELECT owner, target, k, coalesce(state, '-') AS state, attempts, enqueued FROM s) GROUP BY 1, 2 HAVING arg_max(state, k) <> '-')"""


def _ops(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    op = F.when(i % 11 == 0, "revive").when(i % 3 == 0, "enqueue").when(i % 7 == 1, "complete").otherwise("fail")
    return e.select(
        F.concat(F.lit("owner"), (F.col("user_id") % 5).cast("string")).alias("owner"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), "event_type").alias("target"), F.col("ts").alias("at"), i.alias("seq"), op.alias("op"),
    )


def _queue(spark, d):
    return state.queue_state(_ops(spark, d))


@q(_QUEUE + " SELECT owner, target, state, CAST(attempts AS BIGINT) AS attempts, enqueued FROM queue")
def queue_fold(spark, d):
    return _queue(spark, d).withColumn("attempts", F.col("attempts").cast("long"))


@q(_QUEUE + " SELECT owner, count(*) FILTER (state = 'pending') AS depth, greatest(0, coalesce(CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(min(enqueued) FILTER (state = 'pending'))) AS BIGINT), 0)) AS oldest_s, count(*) FILTER (state = 'dead') AS parked FROM queue GROUP BY 1")
def queue_depth(spark, d):
    return state.queue_depth(_queue(spark, d), F.lit("2024-02-01").cast("timestamp"))


@q(_QUEUE + " SELECT owner, target, attempts::BIGINT AS attempts FROM queue WHERE state = 'dead'")
def queue_dead(spark, d):
    return _queue(spark, d).where("state = 'dead'").select("owner", "target", F.col("attempts").cast("long").alias("attempts"))


@q("SELECT id, wrapped FROM (SELECT o_orderkey AS id, o_orderkey <= 59000 AS wrapped FROM orders WHERE o_orderstatus = 'P') ORDER BY wrapped, id LIMIT 300")
def queue_drain_page(spark, d):
    items = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("state"))
    return state.drain_page(items, 59000, 300).select("id", (F.col("id") <= 59000).alias("wrapped"))


#: Events as ledger records.
_LEDGER = f"""log AS (SELECT event_type AS stage, 'd' || CAST(user_id AS VARCHAR) AS target, CASE WHEN event_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version,
 'k' || CAST({_K} % 5 AS VARCHAR) AS input_key, 'o' || CAST(event_id % 3 AS VARCHAR) AS output_key, CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'done' END AS outcome, ts AS "at", event_id FROM events),
 ledger AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY stage, target ORDER BY "at" DESC, event_id DESC) AS k FROM log) WHERE k = 1)"""


def _ledger(spark, d):
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    log = table(spark, d, "events").select(
        F.col("event_type").alias("stage"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("target"), F.when(i % 4 == 0, "v1").otherwise("v2").alias("version"),
        F.concat(F.lit("k"), (k % 5).cast("string")).alias("input_key"), F.concat(F.lit("o"), (i % 3).cast("string")).alias("output_key"),
        F.when(i % 6 == 0, "failed").when(i % 6 == 1, "skipped").otherwise("done").alias("outcome"), F.col("ts").alias("at"), i,
    )
    return state.latest(log, ["stage", "target"], ["at", "event_id"])


@q(f"WITH {_LEDGER} SELECT stage, target, version, input_key, output_key, outcome, \"at\" FROM ledger")
def ledger_latest(spark, d):
    return _ledger(spark, d).drop("event_id")


@q(f"WITH {_LEDGER} SELECT stage, version, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, min(\"at\") AS oldest, max(\"at\") AS newest FROM ledger GROUP BY 1, 2")
def ledger_stage_stats(spark, d):
    return state.ledger_stats(_ledger(spark, d))


_PENDING = f"""WITH {_LEDGER}, t AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS target, 'k' || CAST(c_custkey % 5 AS VARCHAR) AS key FROM customer),
 p AS (SELECT t.target, CASE WHEN l.version IS NULL THEN 'never' WHEN l.version <> 'v2' THEN 'stale' WHEN outcome = 'failed' THEN 'retry' WHEN outcome = 'skipped' THEN 'skipped'
  WHEN key = input_key OR key = output_key THEN 'current' ELSE 'changed' END AS reason FROM t LEFT JOIN (SELECT * FROM ledger WHERE stage = (SELECT min(event_type) FROM events)) l ON l.target = t.target)"""


def _pending(spark, d):
    c = F.col("c_custkey")
    t = table(spark, d, "customer").select(F.concat(F.lit("d"), c.cast("string")).alias("target"), F.concat(F.lit("k"), (c % 5).cast("string")).alias("key"))
    stage = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return state.ledger_pending(t, _ledger(spark, d).where(F.col("stage") == stage), "v2")


@q(_PENDING + " SELECT target, reason FROM p")
def ledger_pending(spark, d):
    return _pending(spark, d)


@q(_PENDING + " SELECT count(*) AS eligible, count(*) FILTER (reason = 'current') AS current, count(*) FILTER (reason = 'current') / count(*)::DOUBLE AS ratio FROM p")
def ledger_coverage(spark, d):
    return state.coverage(_pending(spark, d))


@q(f"WITH {_LEDGER} SELECT stage, target FROM ledger WHERE outcome = 'done' AND ('k3' IN (input_key, output_key) OR 'o1' IN (input_key, output_key))")
def ledger_seen(spark, d):
    keys = F.array("input_key", "output_key")
    return _ledger(spark, d).where((F.col("outcome") == "done") & F.arrays_overlap(keys, F.array(F.lit("k3"), F.lit("o1")))).select("stage", "target")


_STAMPED = "st AS (SELECT 'd' || CAST(o_custkey AS VARCHAR) AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'v1' ELSE 'v3' END AS version, 'o' || CAST(o_orderkey AS VARCHAR) AS output_key, CAST(o_orderdate AS TIMESTAMP) AS \"at\" FROM orders WHERE o_orderstatus = 'F')"


@q(f"""WITH {_LEDGER}, {_STAMPED}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY "at" DESC, version DESC, output_key DESC) AS k FROM st),
 a AS (SELECT stage, target, version, input_key, output_key, outcome, "at" FROM ledger WHERE stage <> 'click' UNION ALL SELECT 'click', target, version, '', output_key, 'done', "at" FROM r WHERE k = 1)
 SELECT a.*, (SELECT count(*) FROM ledger WHERE stage = 'click') AS dropped, (SELECT count(*) FROM r WHERE k = 1) AS recovered FROM a""")
def ledger_rebuild(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    stamped = o.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("target"), F.when(F.col("o_orderkey") % 3 == 0, "v1").otherwise("v3").alias("version"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("output_key"), F.col("o_orderdate").cast("timestamp").alias("at"))
    ledger, report = state.ledger_rebuild(_ledger(spark, d), stamped, "click")
    return ledger.join(F.broadcast(report))


_FOUND = "fo AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'file:' || p_brand WHEN 1 THEN 'no identity' WHEN 2 THEN 'note:n' || CAST(p_partkey % 40 AS VARCHAR) ELSE 'feed:' || p_type END AS source, CASE WHEN p_size % 6 <> 0 THEN 'h' || CAST(p_size AS VARCHAR) END AS hash, 'v' || CAST(p_partkey % 3 AS VARCHAR) AS version, p_partkey % 7 AS memories FROM part)"
_SIDE = "si AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'transcript:t' || CAST(s_suppkey AS VARCHAR) ELSE 'note:n' || CAST(s_suppkey AS VARCHAR) END AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'growing' ELSE 'immutable' END AS kind, CASE WHEN s_suppkey % 3 <> 0 THEN 'z' || CAST(s_nationkey AS VARCHAR) END AS hash, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS cursor, 'v9' AS version, 0 AS yield FROM supplier)"


def _found(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    source = F.when(k % 5 == 0, F.concat(F.lit("file:"), "p_brand")).when(k % 5 == 1, "no identity").when(k % 5 == 2, F.concat(F.lit("note:n"), (k % 40).cast("string"))).otherwise(F.concat(F.lit("feed:"), "p_type"))
    hash_ = F.when(F.col("p_size") % 6 != 0, F.concat(F.lit("h"), F.col("p_size").cast("string")))
    return p.select(source.alias("source"), hash_.alias("hash"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("version"), (k % 7).alias("memories"))


def _sidecar(spark, d):
    k = F.col("s_suppkey")
    even = k % 2 == 0
    return table(spark, d, "supplier").select(
        F.concat(F.when(even, "transcript:t").otherwise("note:n"), k.cast("string")).alias("source"), F.when(even, "growing").otherwise("immutable").alias("kind"),
        F.when(k % 3 != 0, F.concat(F.lit("z"), F.col("s_nationkey").cast("string"))).alias("hash"), F.when(k % 4 == 0, k).alias("cursor"), F.lit("v9").alias("version"), F.lit(0).cast("long").alias("yield"))


@q(f"""WITH {_FOUND}, {_SIDE}, kn AS (SELECT * FROM fo WHERE contains(source, ':')), co AS (SELECT source AS id, 'immutable' AS kind, max(hash) AS hash, NULL::BIGINT AS cursor, max(version) AS version, sum(memories)::BIGINT AS yield, 0 AS seq FROM kn WHERE hash IS NOT NULL GROUP BY 1),
 ev AS (SELECT * FROM co UNION ALL SELECT source, kind, hash, cursor, version, yield, 1 FROM si WHERE CASE WHEN kind = 'immutable' THEN hash IS NOT NULL ELSE cursor IS NOT NULL END),
 rg AS (SELECT id, arg_max(kind, seq) AS kind, max(hash) FILTER (seq = m) AS hash, max(cursor) FILTER (seq = m) AS cursor, arg_max(version, seq) AS version, sum(yield)::BIGINT AS yield FROM (SELECT *, max(seq) OVER (PARTITION BY id) AS m FROM ev) GROUP BY 1)
 SELECT id, kind, coalesce(hash, '') AS hash, coalesce(cursor, -1) AS cursor, version, yield FROM rg UNION ALL SELECT DISTINCT source, 'unrecoverable', '', -1, '', 0 FROM kn WHERE hash IS NULL AND source NOT IN (SELECT id FROM rg)""")
def sources_rebuild(spark, d):
    registry, lost = state.sources_rebuild(_found(spark, d), _sidecar(spark, d))
    none = lost.select("id", F.lit("unrecoverable").alias("kind"), F.lit("").alias("hash"), F.lit(-1).cast("long").alias("cursor"), F.lit("").alias("version"), F.lit(0).cast("long").alias("yield"))
    return registry.select("id", "kind", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("cursor", F.lit(-1)).alias("cursor"), "version", "yield").unionByName(none)


_REG = f"""WITH log AS (SELECT 's' || CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 2 = 0 THEN 'immutable' ELSE 'growing' END AS kind, CASE WHEN event_id % 5 <> 0 THEN 'h' || CAST(event_id % 7 AS VARCHAR) END AS hash,
 CASE WHEN event_id % 4 <> 0 THEN event_id END AS cursor, {_K} % 4 AS yield, ts AS "at", event_id AS seq FROM events), v AS (SELECT * FROM log WHERE CASE WHEN kind = 'immutable' THEN hash IS NOT NULL ELSE cursor IS NOT NULL END),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at" DESC, seq DESC) AS k FROM v),
 reg AS (SELECT id, max(CASE WHEN k = 1 THEN kind END) AS kind, max(CASE WHEN k = 1 THEN hash END) AS hash, coalesce(max(CASE WHEN k = 1 THEN cursor END), -1) AS cursor, sum(yield)::BIGINT AS yield, min("at") AS first_seen, max("at") AS last_seen FROM r GROUP BY 1)"""


def _registry(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    log = table(spark, d, "events").select(
        F.concat(F.lit("s"), u.cast("string")).alias("id"), F.when(u % 2 == 0, "immutable").otherwise("growing").alias("kind"),
        F.when(i % 5 != 0, F.concat(F.lit("h"), (i % 7).cast("string"))).alias("hash"), F.when(i % 4 != 0, i).alias("cursor"),
        (F.get_json_object("props", "$.k").cast("long") % 4).alias("yield"), F.col("ts").alias("at"), i.alias("seq"),
    )
    return state.registry(log)


@q(_REG + " SELECT * FROM reg")
def registry_sources(spark, d):
    return _registry(spark, d).fillna(-1, ["cursor"])


@q(_REG + " SELECT kind, count(*) AS n, sum(yield)::BIGINT AS yield, count(*) FILTER (yield = 0) AS zero FROM reg GROUP BY 1")
def registry_stats(spark, d):
    return _registry(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("yield").alias("yield"), F.count_if(F.col("yield") == 0).alias("zero"))


@q(f"""WITH {NOTES}, old AS (SELECT path, title, captured, captured_src FROM notes WHERE doc_id % 3 <> 1), new AS (SELECT path, title || '!' AS title, captured + INTERVAL 5 DAY AS captured, CASE WHEN doc_id % 2 = 0 THEN 'mtime' ELSE 'frontmatter' END AS captured_src FROM notes WHERE doc_id % 4 <> 2)
 SELECT coalesce(n.path, o.path) AS path, coalesce(n.title, o.title) AS title, CASE WHEN n.path IS NULL OR (o.path IS NOT NULL AND n.captured_src = 'mtime') THEN o.captured ELSE n.captured END AS captured, coalesce(n.captured_src, o.captured_src) AS captured_src FROM old o FULL JOIN new n ON o.path = n.path""")
def notes_upsert(spark, d):
    n = notes(spark, d)
    c = ["path", "title", "captured", "captured_src"]
    new = n.where("doc_id % 4 <> 2").select(
        "path", F.concat("title", F.lit("!")).alias("title"), F.date_add("captured", 5).cast("timestamp").alias("captured"), F.when(F.col("doc_id") % 2 == 0, "mtime").otherwise("frontmatter").alias("captured_src")
    )
    # A date that only comes from a file's time does not replace one that was observed.
    return state.upsert(n.where("doc_id % 3 <> 1").select(*c), new, "path", {"captured": "new.captured_src = 'mtime' and old.captured is not null"})


@q("""WITH o AS (SELECT c_custkey AS path, c_nationkey AS mtime, c_acctbal AS size FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS mtime, c_acctbal AS size FROM customer WHERE c_custkey % 6 <> 0)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.mtime = n.mtime AND o.size = n.size THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def corpus_reconcile(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("mtime"), F.col("c_acctbal").alias("size"))
    return state.reconcile(c.where("path % 5 <> 0"), c.where("path % 6 <> 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, 99).otherwise(F.col("mtime"))))


@q(f"""WITH e AS (SELECT user_id AS job, event_id, ts, {_K} % 4 = 0 AS ok FROM events), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY job ORDER BY ts, event_id) AS g FROM e),
 f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY job, g ORDER BY ts, event_id)::BIGINT AS failures FROM i)
 SELECT job, event_id, ts, ok, failures, CASE WHEN failures >= 8 THEN 'stopped' WHEN failures >= 5 THEN 'paused' WHEN failures >= 3 THEN 'throttled' ELSE 'healthy' END AS rung FROM f""")
def failure_streaks(spark, d):
    ok = F.get_json_object("props", "$.k").cast("long") % 4 == 0
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", "ts", ok.alias("ok"))
    return state.streaks(e, "job", ["ts", "event_id"], "ok")


#: Events as cumulative captures: a session's cost only grows.
_CUM = """WITH cap AS (SELECT event_id, ts, user_id AS session, event_type AS model, 'p' || CAST(user_id % 6 AS VARCHAR) AS plan, 't' || CAST(event_id % 3 AS VARCHAR) AS task,
 sum(round(value)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS cost FROM events), last AS (SELECT *, row_number() OVER (PARTITION BY session, model ORDER BY ts DESC, event_id DESC) AS k FROM cap)"""


def _captures(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("plan"),
        F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("task"), F.sum(F.round("value")).over(w).alias("cost"),
    )


@q(_CUM + " SELECT plan, sum(cost) AS cost, count(*) AS n FROM last WHERE k = 1 GROUP BY 1")
def rollup_by_plan(spark, d):
    return rollup.latest_totals(_captures(spark, d), ["plan"])


@q(_CUM + " SELECT plan, task, sum(cost) AS cost, count(*) AS n FROM last WHERE k = 1 GROUP BY 1, 2")
def rollup_by_task(spark, d):
    return rollup.latest_totals(_captures(spark, d), ["plan", "task"])


@q(_CUM + " SELECT model, sum(cost) AS cost, count(*) AS n FROM last WHERE k = 1 GROUP BY 1")
def rollup_by_model(spark, d):
    return rollup.latest_totals(_captures(spark, d), ["model"])


@q(_CUM + ", dl AS (SELECT ts, cost - coalesce(lag(cost) OVER (PARTITION BY session, model ORDER BY ts, event_id), 0) AS delta FROM cap) SELECT time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, sum(delta) AS cost, count(*) AS n FROM dl WHERE delta <> 0 GROUP BY 1")
def rollup_by_window(spark, d):
    return rollup.by_window(_captures(spark, d))


@q("""WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, g""")
def rollup_sessions(spark, d):
    return rollup.sessions(table(spark, d, "events"), "user_id", "6 hours").withColumn("value", F.round("value", 4))


@q("SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")
def rollup_lookback(spark, d):
    since = F.lit("2024-01-24").cast("timestamp")
    return table(spark, d, "events").where(F.col("ts") >= since).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@q(f"""WITH h AS (SELECT user_id AS item, CASE WHEN event_type = (SELECT min(event_type) FROM events) AND {_K} % 3 = 0 THEN true END AS hit, ts FROM events), c AS (SELECT item, count(hit) AS hits, count(DISTINCT CASE WHEN hit THEN ts::DATE END) AS days FROM h GROUP BY 1)
 SELECT item, hits, days, CASE WHEN hits = 0 THEN 'demote' WHEN hits >= 3 AND days >= 2 THEN 'promote' ELSE 'keep' END AS verdict FROM c""")
def heat_policy(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    hit = F.when((F.col("event_type") == first) & (F.get_json_object("props", "$.k").cast("long") % 3 == 0), F.lit(True))
    return rollup.heat(e.select(F.col("user_id").alias("item"), hit.alias("hit"), "ts"), 30)


_PACK = """WITH RECURSIVE p AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 w(conv_id, k, turn, used, kept) AS (SELECT conv_id, k, turn, CASE WHEN tokens <= 150 THEN tokens ELSE 0 END, tokens <= 150 FROM p WHERE k = 1
 UNION ALL SELECT p.conv_id, p.k, p.turn, w.used + CASE WHEN w.used + tokens <= 150 THEN tokens ELSE 0 END, w.used + tokens <= 150 FROM w JOIN p ON p.conv_id = w.conv_id AND p.k = w.k + 1)
 SELECT conv_id, turn, kept FROM w"""


@q(_PACK)
def budget_packing(spark, d):
    from quernel.functions.text import token_estimate

    turns = table(spark, d, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))
    return rollup.pack_budget(turns, "conv_id", ["turn"], "tokens", 150)


@q("SELECT l_returnflag AS axis, round(100 * sum(CASE WHEN l_quantity > 25 THEN l_tax END) / sum(l_tax), 6) AS score FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 UNION ALL SELECT * FROM (SELECT 'x' AS axis, 0.0::DOUBLE AS score) WHERE false")
def health_index(spark, d):
    l = table(spark, d, "lineitem")
    r = l.select(F.col("l_returnflag").alias("axis"), (F.col("l_quantity") > 25).alias("pass"), (F.col("l_linestatus") != "O").alias("dark"), F.col("l_tax").alias("weight"))
    return rollup.health_index(r).withColumn("score", F.round("score", 6))


@q("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90_interpolated, max(o_totalprice) AS max, list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.9) AS INT) + 1] AS p90 FROM orders GROUP BY 1")
def latency_describe(spark, d):
    out = rollup.describe(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p90_interpolated")), "max", "p90")


@q(f"""WITH {NOTES} SELECT source, count(*) AS n, count(*) FILTER (captured_src = 'mtime') AS n_mtime, min(captured) AS oldest, count(*) FILTER (status = 'unfiled') AS unfiled FROM notes GROUP BY 1""")
def index_stats(spark, d):
    return notes(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("captured_src") == "mtime").alias("n_mtime"), F.min("captured").alias("oldest"), F.count_if(F.col("status") == "unfiled").alias("unfiled"))


@q(f"WITH {NOTES}, f AS (SELECT unnest(flags) AS flag FROM notes) SELECT flag, count(*) AS n FROM f GROUP BY 1")
def index_flags(spark, d):
    return notes(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@q(f"WITH {NOTES} SELECT path, status FROM notes WHERE status IN ('unfiled', 'inbox') AND path > '_inbox/fr' ORDER BY path LIMIT 50")
def unfiled_page(spark, d):
    return notes(spark, d).where(F.col("status").isin("unfiled", "inbox") & (F.col("path") > "_inbox/fr")).orderBy("path").limit(50).select("path", "status")


@q(f"WITH {NOTES} SELECT path, confidence FROM notes ORDER BY confidence IS NULL, confidence, path LIMIT 50")
def review_queue(spark, d):
    return notes(spark, d).orderBy(F.col("confidence").asc_nulls_last(), "path").limit(50).select("path", "confidence")


@q(f"WITH {NOTES}, h AS (SELECT *, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE captured END AS created FROM notes) SELECT path, created IS NULL OR date_diff('day', created, TIMESTAMP '2024-06-01') > 90 AS past, CASE WHEN date_diff('day', captured, TIMESTAMP '2028-06-01') > 1825 THEN 'archive' WHEN list_contains(flags, 'artifact') AND date_diff('day', captured, TIMESTAMP '2028-06-01') > 365 THEN 'shelve' ELSE 'stay' END AS tidy FROM h")
def ttl_and_tidying(spark, d):
    created = F.when(F.col("doc_id") % 6 != 1, F.col("captured"))
    age = lambda c, now: F.datediff(F.lit(now).cast("date"), c)
    late = age(F.col("captured"), "2028-06-01")
    return notes(spark, d).select(
        "path", (created.isNull() | (age(created, "2024-06-01") > 90)).alias("past"), F.when(late > 1825, "archive").when(F.array_contains("flags", "artifact") & (late > 365), "shelve").otherwise("stay").alias("tidy")
    )
