"""Quotas, digests, debouncing, incremental upkeep."""
from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.rollups import ordered_text
from quern.plans.library import duck_link
from quern.plans.registry import plan
from quern.sources import mail as ML
from quern.streaming import streams as ST, timed as TM


def event_stream(lib):
    """The change log as a stream: the same file, read as it arrives."""
    schema = lib.table("events").schema
    s = lib.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(lib.path)
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), "value")


@plan("win13_sliding_quota", """
SELECT event_id, recent, recent > 3 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM v_change)""".replace("AS over", 'AS "over"'))
def _(lib):
    d = ST.sliding_count(lib.changes(), "entity_id", "ts", 3600)
    return d.select("event_id", "recent", (F.col("recent") > 3).alias("over"))


@plan("st1_idempotent_intake", """
SELECT CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 = 1 THEN 'transient' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1""")
def _(lib):
    twice = lib.changes().unionAll(lib.changes()).dropDuplicates(["event_id"])
    m = F.col("event_id") % 10
    return twice.groupBy(F.when(m == 0, "failed").when(m == 1, "transient").otherwise("ok").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@plan("st2_stream_static_dedupe", f"""
WITH k AS (SELECT page_id, {duck_link('url')} AS lk FROM pages), l AS (SELECT DISTINCT lk FROM k WHERE page_id % 2 = 0)
SELECT page_id, CASE WHEN lk IN (SELECT lk FROM l) THEN 'known' ELSE 'new' END AS side FROM k WHERE page_id % 2 = 1""")
def _(lib):
    k = lib.pages().select("page_id", T.link_key(F.col("url")).alias("link_key"))
    new, known = ST.split_known_links(k.filter("page_id % 2 = 1"), k.filter("page_id % 2 = 0"))
    return new.select("page_id", F.lit("new").alias("side")).unionAll(known.select("page_id", F.lit("known").alias("side")))


@plan("st3_result_digest", """
SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS start, count(*) FILTER (kind <> 'error') AS succeeded, count(*) FILTER (kind = 'error') AS failed,
 CASE WHEN count(*) FILTER (kind = 'error') > 0 AND count(*) FILTER (kind <> 'error') > 0 THEN 'PARTIAL' WHEN count(*) FILTER (kind = 'error') > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS kind FROM v_change GROUP BY 1""")
def _(lib):
    return ST.digest(lib.changes(), "ts", F.col("kind") != "error", 60)


@plan("st3_cooldown_stream")
def _(lib):
    e = event_stream(lib).select("ts", "entity_id", (F.col("kind") != "error").alias("success"))
    return ST.run_to_end(ST.cooldown_digest(e, "entity_id", 86400))


_BURST = """
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS st FROM v_change WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
g AS (SELECT *, sum(st) OVER (PARTITION BY entity_id ORDER BY ts) AS b FROM s)
SELECT entity_id, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM g GROUP BY entity_id, b"""


@plan("st4_debounced_bursts", _BURST)
def _(lib):
    return ST.debounced(lib.changes(), "entity_id", "ts", 7200)


@plan("st4_global_debounce", """
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) < 120000000 THEN 0 ELSE 1 END AS st FROM v_change), g AS (SELECT *, sum(st) OVER (ORDER BY ts) AS b FROM s)
SELECT 'all' AS key, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM g GROUP BY b""")
def _(lib):
    return ST.debounced(lib.changes(), None, "ts", 120)


@plan("st5_quota_stream")
def _(lib):
    return ST.run_to_end(ST.quota(event_stream(lib), "entity_id", limit=3, seconds=3600))


@plan("st6_report_cap", """
SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS minute, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS dropped FROM v_change WHERE kind = 'error' GROUP BY 1""")
def _(lib):
    e = lib.changes().filter("kind = 'error'").groupBy((F.floor(ST.micros("ts") / 60000000) * 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("minute", F.least("n", F.lit(ST.MAX_REPORTS)).alias("kept"), F.greatest(F.col("n") - ST.MAX_REPORTS, F.lit(0)).alias("dropped"))


@plan("st8_incremental_rollup", "SELECT recipe_id AS id, string_agg(raw_line, ' ' ORDER BY position) AS content_text FROM v_line GROUP BY recipe_id")
def _(lib):
    build = lambda ch: ordered_text(ch, "recipe_id", "ord", "raw_line", " ")
    # the stored rollup is stale for a tenth of the records; only those are rebuilt
    stale = F.col("recipe_id") % 10 == 3
    old = build(lib.lines()).withColumn("text", F.when(stale, "old text").otherwise(F.col("text")))
    changed = lib.table("lineitem").select(F.col("l_orderkey").alias("recipe_id")).filter(stale).distinct()
    return ST.refreshed(old, lib.lines(), changed, "recipe_id", build).withColumnsRenamed({"recipe_id": "id", "text": "content_text"})


# --- by event time ----------------------------------------------------------------------------

def ending_stream(lib):
    """The events as a stream that ends, so that all of them are judged."""
    return TM.closed_by(event_stream(lib), "event_id % 5000 = 0", "entity_id")


_NUMBERED = """
WITH RECURSIVE ev AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY entity_id ORDER BY epoch_us(ts), event_id) AS rn FROM v_change),
"""


@plan("st3_cooldown_digests", _NUMBERED + """
per AS (SELECT entity_id, list(us ORDER BY rn) AS ats, list(kind <> 'error' ORDER BY rn) AS good FROM ev GROUP BY entity_id),
sent AS (SELECT entity_id, ats, good, ats[1] AS us, 1 AS a, 1 AS z FROM per
 UNION ALL SELECT entity_id, ats, good, CASE WHEN ats[z + 1] < us + 21600000000 THEN us + 21600000000 ELSE ats[z + 1] END, z + 1,
  CASE WHEN ats[z + 1] < us + 21600000000 THEN len(list_filter(ats, lambda x: x < us + 21600000000)) ELSE z + 1 END FROM sent WHERE z < len(ats))
SELECT CAST(entity_id AS VARCHAR) AS key, us, len(list_filter(good[a:z], lambda x: x)) AS succeeded, len(list_filter(good[a:z], lambda x: NOT x)) AS failed,
 CASE WHEN len(list_filter(good[a:z], lambda x: x)) > 0 AND len(list_filter(good[a:z], lambda x: NOT x)) > 0 THEN 'PARTIAL' WHEN len(list_filter(good[a:z], lambda x: NOT x)) > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS kind FROM sent""")
def _(lib):
    e = ending_stream(lib).withColumn("success", F.col("kind") != "error")
    return ST.run_to_end(TM.digests(e, "entity_id", 21600)).filter("key IS NOT NULL")


def _cap_sql(limit, seconds, mark, closed):
    """The log of a key as a list, one event further in each round."""
    within = lambda log, us: f"list_filter({log}, lambda u: {us} - u < {seconds * 1000000 + closed})"
    return _NUMBERED + f"""
judged AS (SELECT entity_id, event_id, rn, true AS accepted, [us] AS log FROM ev WHERE rn = 1
 UNION ALL SELECT ev.entity_id, ev.event_id, ev.rn, len({within('log', 'us')}) < {limit}, {within('log', 'us')} || CASE WHEN len({within('log', 'us')}) < {limit + mark} THEN [us] ELSE [] END
 FROM judged JOIN ev ON ev.entity_id = judged.entity_id AND ev.rn = judged.rn + 1)
SELECT CAST(entity_id AS VARCHAR) AS key, event_id, accepted FROM judged"""


@plan("st5_sliding_quota", _cap_sql(2, 86400, 1, 1))
def _(lib):
    return ST.run_to_end(TM.capped(ending_stream(lib), "entity_id", 2, 86400, mark=True, closed=True)).filter("key IS NOT NULL")


@plan("st6_sliding_cap", _cap_sql(2, 43200, 0, 0))
def _(lib):
    return ST.run_to_end(TM.capped(ending_stream(lib), "entity_id", 2, 43200)).filter("key IS NOT NULL")


def try_message(body: str, number: int) -> str:
    """Every tenth message is refused for good, the next ones fail twice, or always."""
    return {"0": "failed", "1": "transient" if number < 3 else "ok", "2": "transient"}.get(body[-1], "ok")


@plan("st1_landing", """
SELECT CAST(event_id AS VARCHAR) AS msg_id, CASE WHEN event_id % 10 IN (0, 2) THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 10 IN (1, 2) THEN 3 ELSE 1 END AS attempts,
 epoch_us(ts) + CASE WHEN event_id % 10 IN (1, 2) THEN 900000000 ELSE 0 END AS us FROM events""")
def _(lib):
    e = event_stream(lib).select(F.col("event_id").alias("msg_id"), "ts", F.concat(F.lit("message "), F.col("event_id").cast("string")).alias("body"))
    late = e.filter("msg_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))     # delivered again
    e = TM.closed_by(e.unionByName(late), "msg_id % 5000 = 0", "msg_id")
    return ST.run_to_end(TM.landed(e, try_message)).filter("msg_id IS NOT NULL")


def raw_messages(lib):
    """Each document as a mail message of two parts, in base64, with an encoded subject."""
    b64 = lambda c: F.base64(c.cast("binary"))
    lines = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    k, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    subject = lines(F.when(F.col("doc_id") % 3 == 0, "Recette épicée ").otherwise("Nouvelle "), k)
    part = lambda kind, body: lines("--edge\r\nContent-Type: ", kind, "; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", b64(body), "\r\n")
    raw = lines("Message-ID: <", k, "@example.org>\r\nFrom: =?utf-8?B?", b64(F.lit("Zoé")), "?= <zoe@example.org>\r\nSubject: =?utf-8?B?", b64(subject), "?=\r\nMIME-Version: 1.0\r\n",
                'Content-Type: multipart/alternative; boundary="edge"\r\n\r\n', part("text/html", lines("<p>", k, "</p>")), part("text/plain", text), "--edge--\r\n")
    return lib.documents().select("doc_id", raw.alias("raw"))


@plan("src22_messages", """
SELECT doc_id, 'Recette épicée ' || doc_id AS subject, 'Zoé <zoe@example.org>' AS sender, '<' || doc_id || '@example.org>' AS msg_id, md5(coalesce(text, '')) AS plain, '<p>' || doc_id || '</p>' AS html, 0 AS attachments
FROM documents WHERE doc_id % 3 = 0""")
def _(lib):
    return ML.messages(raw_messages(lib), "raw", "ÉPICÉE").withColumn("plain", F.md5("plain"))
