"""All queries of the engine's own operators with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.functions import scalars
from tagfold.operators import codecs, commands, config, eviction, pages, sessions, stats, tags, urls
from tagfold.sources import snapshots
from tagfold.sources.tables import EPOCH, NOW, fpc_state, order_tags, page_log, page_log_of, session_log, session_log_of, table, url_set
from tagfold.streaming import pages as live_pages
from tagfold.streaming import sessions as live_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _list(values: tuple[int, ...], index: str) -> str:
    return f"([{', '.join(map(str, values))}])[({index} + 1)::INT]"


#: The derived tables in DuckDB's SQL.
FPC = f"""fpc0 AS (
  SELECT 'doc-' || doc_id AS id, (doc_id % 4)::INT AS ua, CASE WHEN doc_id % 10 = 0 THEN []::VARCHAR[] WHEN lang = source THEN [lang] ELSE [lang, source] END AS tags,
         doc_id * 60 + {EPOCH} AS mtime, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 5 = 1 THEN -1 ELSE doc_id % 97 * 86400 + 60 END AS lifetime,
         strlen(text)::BIGINT AS usize, doc_id * 7919 % 1000003 AS lru_seq FROM documents),
fpc AS (SELECT *, CASE WHEN lifetime = 0 THEN {L.INFINITE} ELSE mtime + least(CASE WHEN lifetime < 0 THEN {_list(L.FPC_DEFAULT, 'ua')} ELSE lifetime END, {_list(L.FPC_MAX, 'ua')}) END AS expire FROM fpc0),
ft AS (SELECT *, CASE WHEN len(tags) = 0 THEN ['{tags.UNTAGGED}'] ELSE tags END AS linked FROM fpc)"""
LOG = """slog AS (
  SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS ts, 'sess-' || user_id AS id, (user_id % 4)::INT AS ua,
         CASE event_type WHEN 'view' THEN 'READ' WHEN 'error' THEN 'DESTROY' ELSE 'WRITE' END AS op,
         CASE event_type WHEN 'click' THEN -1 WHEN 'purchase' THEN floor(value)::BIGINT * 60 + 60 WHEN 'signup' THEN 0 END AS lifetime, event_id + 1 AS request_id
  FROM events)"""
URLS = f"urls AS (SELECT url, page_id % 11 * 100 AS priority_milli, page_id * 3600 + {EPOCH} AS lastmod, page_id AS ord FROM pages)"


def query(name: str, sql: str | None = None):
    """Registers a query; sql is its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _tagged(name: str, f: Callable[[DataFrame], DataFrame], where: str, show: str = "id") -> None:
    query(name, f"WITH {FPC} SELECT {show} FROM ft WHERE {where}")(lambda s, d: f(fpc_state(s, d)))


# --- by tag and by id ---
_tagged("get_ids", tags.ids, "true")
_tagged("ids_matching_tags", lambda f: tags.matching(f, ["en", "src1"]), "list_has_all(linked, ['en', 'src1'])")
_tagged("ids_matching_tags_unknown", lambda f: tags.matching(f, ["en", "nothing"]), "list_has_all(linked, ['en', 'nothing'])")
_tagged("ids_not_matching_tags", lambda f: tags.not_matching(f, ["en", "src1"]), "NOT list_has_any(linked, ['en', 'src1'])")
_tagged("ids_not_matching_tags_unknown", lambda f: tags.not_matching(f, ["nothing"]), "true")
_tagged("ids_matching_any_tags", lambda f: tags.matching_any(f, ["de", "src1", "nothing"]), "list_has_any(linked, ['de', 'src1', 'nothing'])")
_tagged("ids_matching_at_least_n", lambda f: tags.matching_at_least(f, ["fr", "src2", "src3"], 2), "len(list_intersect(linked, ['fr', 'src2', 'src3'])) >= 2")
_tagged("untagged_ids", tags.untagged, "len(tags) = 0")
_tagged("ids_of_reserved_tag", lambda f: tags.matching(f, [tags.UNTAGGED]), "len(tags) = 0")
_tagged("load_record", lambda f: f.where("id = 'doc-17'").select("id", "usize", "expire"), "id = 'doc-17'", "id, usize, expire")
_tagged("test_record", lambda f: f.where("id = 'doc-17'").select("mtime"), "id = 'doc-17'", "mtime")
_tagged("get_metadatas", lambda f: tags.metadatas(f, ["doc-3", "doc-10", "doc-999999999"]), "id IN ('doc-3', 'doc-10', 'doc-999999999')", "id, expire, mtime, array_to_string(list_sort(tags), ',') AS tag_list")
query("get_tags", f"WITH {FPC} SELECT DISTINCT unnest(tags) AS tag FROM fpc")(lambda s, d: tags.tags(fpc_state(s, d)))
query("tag_counts", f"WITH {FPC}, t AS (SELECT unnest(linked) AS tag FROM ft) SELECT tag, count(*) AS num FROM t GROUP BY tag")(lambda s, d: tags.tag_counts(fpc_state(s, d)))
query("rarest_tag", f"WITH {FPC}, t AS (SELECT unnest(linked) AS tag FROM ft) SELECT tag, count(*) AS num FROM t WHERE tag IN ('en', 'src1', 'src2') GROUP BY tag ORDER BY num, tag LIMIT 1")(lambda s, d: tags.rarest(fpc_state(s, d), ["en", "src1", "src2"]))
query("orders_matching_tags", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")(lambda s, d: tags.matching(order_tags(s, d), ["O", "1-URGENT"]))
query("order_tag_counts", "WITH t AS (SELECT unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders) SELECT tag, count(*) AS num FROM t GROUP BY tag")(lambda s, d: tags.tag_counts(order_tags(s, d)))

# --- counters ---
query("tags_per_object_histogram", f"WITH {FPC}, b AS (SELECT range AS bucket FROM range(16)) SELECT bucket, count(id) AS num FROM b LEFT JOIN fpc ON least(len(tags), 15) = bucket GROUP BY bucket")(lambda s, d: stats.histogram(fpc_state(s, d), F.size("tags"), 16))
query("record_size_histogram", f"WITH {FPC}, b AS (SELECT range AS bucket FROM range(24)) SELECT bucket, count(id) AS num FROM b LEFT JOIN fpc ON least(usize // 256, 23) = bucket GROUP BY bucket")(lambda s, d: stats.histogram(fpc_state(s, d), F.expr("usize div 256"), 24))
_RANGE = "min(v) AS low, max(v) AS high, coalesce(min(v) || '..' || max(v), '(none)') AS shown"
query("name_length_range", f"WITH {FPC}, v AS (SELECT strlen(id)::BIGINT AS v FROM fpc) SELECT {_RANGE} FROM v")(lambda s, d: stats.value_range(fpc_state(s, d), F.octet_length("id").cast("long")))
query("record_size_range", f"WITH {FPC}, v AS (SELECT usize AS v FROM fpc) SELECT {_RANGE} FROM v")(lambda s, d: stats.value_range(fpc_state(s, d), F.col("usize")))
query("filling_percentage", f"WITH {FPC} SELECT least(100, sum(usize) * 100 // 4000000)::BIGINT AS percentage FROM fpc")(lambda s, d: stats.filling(fpc_state(s, d), 4_000_000))


@query("info_totals", f"""WITH {FPC}, {LOG}, r AS (SELECT 'fpc' AS domain, ua, usize FROM fpc UNION ALL SELECT 'session', ua, 0 FROM slog WHERE op = 'WRITE')
SELECT domain, ua, count(*) AS num, sum(usize)::BIGINT AS bytes FROM r GROUP BY ROLLUP (domain, ua)""")
def info_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = session_log(spark, sf_dir).where("op = 'WRITE'").select("ua", F.lit(0).cast("long").alias("usize"))
    return stats.info({"fpc": fpc_state(spark, sf_dir), "session": writes})


# --- lifetimes ---
_tagged("fpc_expiration", lambda f: f.select("id", "ua", "lifetime", "expire"), "true", "id, ua, lifetime, expire")
_EXTRA = _list(L.FPC_READ_EXTRA, "ua")
for _name, _always in (("fpc_read_extension_lru", True), ("fpc_read_extension_expiration", False)):
    _cond = "true" if _always else f"{NOW} >= expire"
    _tagged(_name, lambda f, a=_always: f.select("id", L.fpc_read(F.col("expire"), F.col("ua"), F.lit(NOW), a).alias("expire")), "true", f"id, CASE WHEN expire = {L.INFINITE} OR NOT ({_cond}) THEN expire ELSE greatest(expire, {NOW} + {_EXTRA}) END AS expire")


@query("fpc_touch", f"""WITH {FPC}, t AS (SELECT id, usize % 50 * 1000 AS extra FROM fpc UNION ALL SELECT id || '-gone', 1000 FROM fpc WHERE ua = 3)
SELECT t.id, CASE WHEN f.id IS NULL THEN 'did not exist' ELSE 'ok' END AS status,
       CASE WHEN f.expire = {L.INFINITE} THEN f.expire WHEN f.id IS NOT NULL THEN {NOW} + least(extra + greatest(f.expire - {NOW}, 0), {_list(L.FPC_MAX, 'f.ua')}) END AS expire
FROM t LEFT JOIN fpc f ON t.id = f.id""")
def fpc_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A touch of every record, and of some ids that don't exist."""
    state = fpc_state(spark, sf_dir)
    gone = state.where("ua = 3").select(F.concat("id", F.lit("-gone")).alias("id"), F.lit(1000).cast("long").alias("extra"))
    asked = state.select("id", (F.col("usize") % 50 * 1000).alias("extra")).unionByName(gone)
    both = asked.join(state.select("id", "ua", "expire"), "id", "left")
    return both.select("id", F.when(F.col("ua").isNull(), "did not exist").otherwise("ok").alias("status"), L.fpc_touch(F.col("expire"), F.col("ua"), F.lit(NOW), F.col("extra")).alias("expire"))


# --- cleaning and eviction ---
for _mode, _where in (("all", "false"), ("old", f"NOT expire < {NOW}"), ("matchall", "NOT list_has_all(linked, ['en', 'src1'])"), ("matchnot", "list_has_any(linked, ['en', 'src1'])"), ("matchany", "NOT list_has_any(linked, ['en', 'src1'])")):
    _tagged(f"clean_{_mode}", lambda f, m=_mode: tags.survivors(f, m, ["en", "src1"], NOW), _where)


def _gc(source: str, victim: str, retain: tuple[int, ...]) -> str:
    return f"""c AS (SELECT ua, count(*) AS n FROM {source} GROUP BY ua), v AS (SELECT *, row_number() OVER (PARTITION BY ua ORDER BY lru_seq, id) AS r FROM {source} WHERE {victim}),
g AS (SELECT v.* FROM v JOIN c USING (ua) WHERE r <= n - {_list(retain, 'ua')})"""


query("fpc_gc_retain", f"WITH {FPC}, {_gc('fpc', f'expire < {NOW}', L.FPC_RETAIN)} SELECT id, ua FROM g")(lambda s, d: eviction.collectable(fpc_state(s, d), F.col("expire") < NOW, L.FPC_RETAIN).select("id", "ua"))


def _sessions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = session_log(spark, sf_dir).where("op = 'WRITE'")
    return w.groupBy("id", "ua").agg(F.max("ts").alias("mtime"), F.max("seq").alias("lru_seq"))


_WRITTEN = "w AS (SELECT id, ua, max(ts) AS mtime, max(seq) AS lru_seq FROM slog WHERE op = 'WRITE' GROUP BY id, ua)"
query("session_gc", f"WITH {LOG}, {_WRITTEN}, {_gc('w', f'mtime + 86400 < {NOW}', L.SESSION_RETAIN)} SELECT id, ua FROM g")(lambda s, d: eviction.collectable(_sessions_written(s, d), F.col("mtime") + 86_400 < NOW, L.SESSION_RETAIN).select("id", "ua"))


def _evict(excess: str) -> str:
    return f"WITH {FPC}, {_gc('fpc', 'true', L.FPC_RETAIN)}, f AS (SELECT *, coalesce(sum(usize) OVER (ORDER BY ua, lru_seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM g) SELECT id, usize FROM f WHERE freed < {excess}"


query("quota_eviction", _evict("(SELECT sum(usize) FROM fpc) - 500000"))(lambda s, d: eviction.evicted(fpc_state(s, d), F.col("total") - 500_000, L.FPC_RETAIN).select("id", "usize"))
query("emergency_free", _evict("greatest(300000, 2 * 100000)"))(lambda s, d: eviction.evicted(fpc_state(s, d), F.greatest(F.lit(300_000), F.lit(2 * 100_000)), L.FPC_RETAIN).select("id", "usize"))



@query("emergency_domain", f"WITH {FPC}, {LOG}, u AS (SELECT (SELECT sum(usize) FROM fpc) AS f, (SELECT count(*) * 100 FROM slog WHERE op = 'WRITE') AS s), q(fq, sq) AS (VALUES (NULL, NULL), (1, NULL), (NULL, 1), (1, 1), (1000000000000, 1000000000000)) SELECT fq, sq, CASE WHEN f > fq THEN 'fpc' WHEN s > sq THEN 'session' WHEN f > s THEN 'fpc' ELSE 'session' END AS domain FROM u, q")
def emergency_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_used = fpc_state(spark, sf_dir).agg(F.sum("usize").alias("f"))
    used = session_log(spark, sf_dir).where("op = 'WRITE'").agg((F.count("*") * 100).alias("s")).crossJoin(pages_used)
    big = 1_000_000_000_000
    quotas = spark.createDataFrame([(None, None), (1, None), (None, 1), (1, 1), (big, big)], "fq long, sq long")
    # one row of sums, and a few quotas
    return quotas.crossJoin(used).select("fq", "sq", eviction.shrunk_domain(F.col("f"), F.col("fq"), F.col("s"), F.col("sq")).alias("domain"))


query("fpc_gc_above_quota", f"""WITH {FPC}, {_gc('fpc', 'true', L.FPC_RETAIN)}, f AS (SELECT *, coalesce(sum(usize) OVER (ORDER BY ua, lru_seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM g),
x AS (SELECT *, row_number() OVER (PARTITION BY ua ORDER BY lru_seq, id) AS k FROM fpc WHERE expire < {NOW})
SELECT id FROM f WHERE freed < (SELECT sum(usize) FROM fpc) - 900000 UNION SELECT x.id FROM x JOIN c USING (ua) WHERE k <= n - {_list(L.FPC_RETAIN, 'ua')}""")(
    lambda s, d: eviction.collected(fpc_state(s, d), F.col("expire") < NOW, L.FPC_RETAIN, 900_000).select("id"))

# --- sessions ---
# The fold of the session log as a recursion over each session's commands.
def _fold(revive: bool) -> str:
    return f"""WITH RECURSIVE {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM slog),
r AS (
  SELECT id, 0::BIGINT AS k, false AS alive, 0 AS rua, 0::BIGINT AS num_writes, 0::BIGINT AS mtime, 0::BIGINT AS expire, 0::BIGINT AS lru_seq, 0::BIGINT AS reads, 0::BIGINT AS hits FROM (SELECT DISTINCT id FROM slog)
  UNION ALL
  SELECT id, k, alive, CASE WHEN alive THEN nua ELSE 0 END, CASE WHEN alive THEN num_writes + grew ELSE 0 END, CASE WHEN alive THEN CASE WHEN op = 'WRITE' THEN ts ELSE mtime END ELSE 0 END,
         CASE WHEN NOT alive THEN 0 WHEN op = 'READ' THEN CASE WHEN num_writes > 0 AND ts >= expire THEN greatest(expire, ts + {_list(L.SESSION_READ_EXTRA, 'nua')}) ELSE expire END
              WHEN grew = 0 THEN CASE WHEN lifetime = 0 THEN {L.INFINITE} ELSE least(ts + lifetime, {L.INFINITE - 1}) END
              ELSE ts + CASE WHEN num_writes = 0 THEN fst WHEN num_writes < most THEN fst + (greatest(def, fst) - fst) * num_writes // most ELSE def END END,
         CASE WHEN alive THEN seq ELSE 0 END, reads + CASE WHEN op = 'READ' THEN 1 ELSE 0 END, hits + CASE WHEN op = 'READ' AND alive THEN 1 ELSE 0 END
  FROM (
    SELECT n.id, n.k, n.op, n.ts, n.seq, n.lifetime, r.num_writes, r.mtime, r.expire, r.reads, r.hits,
           CASE n.op WHEN 'DESTROY' THEN false WHEN 'WRITE' THEN true ELSE r.alive{'' if revive else ' AND NOT r.expire < n.ts'} END AS alive, greatest(r.rua, n.ua) AS nua,
           CASE WHEN n.op = 'WRITE' AND NOT (greatest(r.rua, n.ua) = 3 AND n.lifetime >= 0) THEN 1 ELSE 0 END AS grew,
           {_list(L.SESSION_FIRST, 'greatest(r.rua, n.ua)')} AS fst, {_list(L.SESSION_DEFAULT, 'greatest(r.rua, n.ua)')} AS def, {_list(L.SESSION_FIRST_WRITES, 'greatest(r.rua, n.ua)')} AS most
    FROM r JOIN n ON n.id = r.id AND n.k = r.k + 1)),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)
"""


FOLD = _fold(False)
_LIVE = FOLD + "SELECT id, rua AS ua, num_writes, mtime, expire, lru_seq FROM z WHERE alive"
query("session_state", _LIVE)(lambda s, d: sessions.live(session_log(s, d)))
query("session_state_documented", _fold(True) + "SELECT id, rua AS ua, num_writes, mtime, expire, lru_seq FROM z WHERE alive")(lambda s, d: sessions.live(session_log(s, d), revive=True))
query("session_reads_hit_miss", FOLD + "SELECT id, reads, hits, reads - hits AS misses FROM z")(lambda s, d: sessions.hits_and_misses(session_log(s, d)))


@query("stream_session_state", _LIVE)
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = session_log_of(live_sessions.events(spark, sf_dir))
    return live_sessions.drain(log).where("alive").select("id", "ua", "num_writes", "mtime", "expire", "lru_seq")


query("session_write_lifetimes", f"""WITH {LOG}, w AS (SELECT *, count(*) FILTER (op = 'DESTROY') OVER (PARTITION BY id ORDER BY seq) AS life, (ua = 3 AND lifetime >= 0) AS asked FROM slog),
x AS (SELECT *, coalesce(sum(CASE WHEN asked THEN 0 ELSE 1 END) OVER (PARTITION BY id, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n,
             {_list(L.SESSION_FIRST, 'ua')} AS fst, {_list(L.SESSION_DEFAULT, 'ua')} AS def, {_list(L.SESSION_FIRST_WRITES, 'ua')} AS most FROM w WHERE op = 'WRITE')
SELECT seq, id, n AS num_writes, CASE WHEN asked THEN CASE WHEN lifetime = 0 THEN {L.INFINITE} ELSE least(ts + lifetime, {L.INFINITE - 1}) END
  ELSE ts + CASE WHEN n = 0 THEN fst WHEN n < most THEN fst + (greatest(def, fst) - fst) * n // most ELSE def END END AS expire FROM x""")(lambda s, d: sessions.write_lifetimes(session_log(s, d)))


def _mixed_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_log(spark, sf_dir).withColumn("ua", (F.col("seq") % 4).cast("int"))


query("ua_promotion", f"""WITH {LOG}, w AS (SELECT *, (seq % 4)::INT AS u, count(*) FILTER (op = 'DESTROY') OVER (PARTITION BY id ORDER BY seq) AS life FROM slog)
SELECT seq, id, max(u) OVER (PARTITION BY id, life ORDER BY seq) AS record_ua FROM w WHERE op <> 'DESTROY'""")(lambda s, d: sessions.promoted(_mixed_agents(s, d)))
query("session_lock_conflicts", f"""WITH {LOG}, x AS (SELECT *, min(CASE WHEN op <> 'READ' THEN seq END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM slog)
SELECT a.id, a.seq AS holder, b.seq AS waiter FROM x a JOIN x b ON a.id = b.id AND b.seq > a.seq AND b.ts - a.ts <= 8 AND (a.u IS NULL OR b.seq < a.u) WHERE a.op = 'READ' AND b.op = 'READ'""")(lambda s, d: sessions.lock_conflicts(session_log(s, d)))

_LRU_FOLD = FOLD.replace("num_writes > 0 AND ts >= expire", "num_writes > 0")
query("session_state_lru", _LRU_FOLD + "SELECT id, rua AS ua, num_writes, mtime, expire, lru_seq FROM z WHERE alive")(lambda s, d: sessions.live(session_log(s, d), always=True))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of a session near one another belong to one request; several requests take turns."""
    return session_log(spark, sf_dir).withColumn("request_id", F.expr("seq div 2 % 3 + seq div 3000 * 3"))


query("session_lock_waits", f"""WITH {LOG}, q AS (SELECT id, seq, ts, op, seq // 2 % 3 + seq // 3000 * 3 AS request FROM slog),
h AS (SELECT *, row_number() OVER (PARTITION BY id, request ORDER BY seq) AS k FROM q WHERE op = 'READ'),
e AS (SELECT h.*, (SELECT min(seq) FROM q WHERE q.id = h.id AND q.seq > h.seq AND (q.op = 'DESTROY' OR q.op = 'WRITE' AND q.request = h.request)) AS until FROM h)
SELECT a.id, a.seq AS holder, b.seq AS waiter, CASE WHEN u.ts IS NULL OR u.ts - b.ts > 3600 THEN 3600 ELSE u.ts - b.ts END::BIGINT AS waited, (u.ts IS NULL OR u.ts - b.ts > 3600) AS broken
FROM e a JOIN h b ON a.id = b.id AND b.seq > a.seq AND b.request <> a.request AND b.ts - a.ts <= 3600 AND (a.until IS NULL OR b.seq < a.until) LEFT JOIN q u ON u.seq = a.until WHERE a.k = 1""")(lambda s, d: sessions.lock_waits(_requests(s, d), 3600))

# --- pages ---
_PLOG = """plog AS (
  SELECT *, CASE op WHEN 'SAVE' THEN CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT * 600 + 60 WHEN seq % 4 = 0 THEN 0 ELSE -1 END WHEN 'TOUCH' THEN seq % 50 * 1000 END AS lifetime,
         CASE WHEN op = 'SAVE' AND seq % 11 <> 0 OR op = 'CLEAN' THEN ['t' || seq % 7, 'u' || user_id % 5] ELSE []::VARCHAR[] END AS tags,
         (['matchall', 'matchall', 'matchany', 'matchall', 'matchall', 'matchnot', 'matchall', 'matchany'])[(seq // 20 % 8 + 1)::INT] AS mode
  FROM (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS ts, 'page-' || (user_id * 3 + event_id % 3) AS id, (event_id % 4)::INT AS ua, value, event_type, user_id,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'SAVE' WHEN event_type = 'click' THEN 'TOUCH' WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'TEST' ELSE 'LOAD' END
                    WHEN event_id % 20 = 0 THEN 'CLEAN' ELSE 'REMOVE' END AS op FROM events))"""


def _pages(where: str, always: bool) -> str:
    return f"""WITH RECURSIVE {_PLOG}, own AS (SELECT * FROM plog WHERE {where}), pid AS (SELECT DISTINCT id FROM own WHERE op <> 'CLEAN'),
c AS (SELECT id, seq, ts, ua, op, lifetime, tags, mode, floor(value)::BIGINT + 1 AS usize FROM own WHERE op <> 'CLEAN'
      UNION ALL SELECT pid.id, seq, ts, ua, op, lifetime, tags, mode, 0 FROM own, pid WHERE op = 'CLEAN'),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM c),
r AS (
  SELECT id, 0::BIGINT AS k, false AS alive, 0 AS rua, []::VARCHAR[] AS rtags, 0::BIGINT AS mtime, 0::BIGINT AS expire, 0::BIGINT AS lru_seq, 0::BIGINT AS rsize, 0::BIGINT AS loads, 0::BIGINT AS hits, 0::BIGINT AS errors FROM pid
  UNION ALL
  SELECT id, k, live, CASE WHEN live THEN nua ELSE 0 END, CASE WHEN NOT live THEN [] WHEN op = 'SAVE' THEN tags ELSE rtags END, CASE WHEN NOT live THEN 0 WHEN op = 'SAVE' THEN ts ELSE mtime END,
         CASE WHEN NOT live THEN 0
              WHEN op = 'SAVE' THEN CASE WHEN lifetime = 0 THEN {L.INFINITE} ELSE ts + least(CASE WHEN lifetime < 0 THEN {_list(L.FPC_DEFAULT, 'nua')} ELSE lifetime END, {_list(L.FPC_MAX, 'nua')}) END
              WHEN expire = {L.INFINITE} THEN expire
              WHEN op = 'TOUCH' THEN ts + least(lifetime + greatest(expire - ts, 0), {_list(L.FPC_MAX, 'nua')})
              WHEN op IN ('LOAD', 'TEST') AND ({str(always).lower()} OR ts >= expire) THEN greatest(expire, ts + {_list(L.FPC_READ_EXTRA, 'nua')}) ELSE expire END,
         CASE WHEN NOT live THEN 0 WHEN op = 'CLEAN' THEN lru_seq ELSE seq END, CASE WHEN NOT live THEN 0 WHEN op = 'SAVE' THEN usize ELSE rsize END,
         loads + (op IN ('LOAD', 'TEST'))::INT, hits + (op IN ('LOAD', 'TEST') AND live)::INT, errors + (op = 'TOUCH' AND NOT live)::INT
  FROM (
    SELECT n.id, n.k, n.op, n.ts, n.seq, n.lifetime, n.tags, n.usize, r.rtags, r.mtime, r.expire, r.lru_seq, r.rsize, r.loads, r.hits, r.errors,
           CASE WHEN n.op IN ('SAVE', 'LOAD', 'TEST') THEN greatest(r.rua, n.ua) ELSE r.rua END AS nua,
           CASE n.op WHEN 'SAVE' THEN true WHEN 'REMOVE' THEN false
                     WHEN 'CLEAN' THEN r.alive AND NOT CASE n.mode WHEN 'matchall' THEN list_has_all(r.own, n.tags) WHEN 'matchany' THEN list_has_any(r.own, n.tags) ELSE NOT list_has_any(r.own, n.tags) END
                     ELSE r.alive END AS live
    FROM (SELECT *, CASE WHEN len(rtags) = 0 THEN ['{tags.UNTAGGED}'] ELSE rtags END AS own FROM r) r JOIN n ON n.id = r.id AND n.k = r.k + 1)),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)
"""


_PAGE = "id, rua AS ua, array_to_string(list_sort(rtags), ',') AS tag_list, mtime, expire, lru_seq, rsize AS usize"


def _page_rows(state: DataFrame, *more: str) -> DataFrame:
    return state.where("alive").select("id", "ua", F.array_join(F.array_sort("tags"), ",").alias("tag_list"), "mtime", "expire", "lru_seq", "usize", *more)


query("page_state", _pages("true", True) + f"SELECT {_PAGE} FROM z WHERE alive")(lambda s, d: _page_rows(pages.fold(page_log(s, d))))
query("page_state_expiration", _pages("true", False) + f"SELECT {_PAGE} FROM z WHERE alive")(lambda s, d: _page_rows(pages.fold(page_log(s, d), always=False)))
query("page_loads_hit_miss", _pages("true", True) + "SELECT id, loads, hits, loads - hits AS misses, errors FROM z")(lambda s, d: pages.fold(page_log(s, d)).select("id", "loads", "hits", (F.col("loads") - F.col("hits")).alias("misses"), "errors"))
# with CLEANs of old pages, whose victims depend on all pages: no SQL
query("page_state_old_cleaned")(lambda s, d: _page_rows(pages.states(page_log(s, d, old=True), snapshots.saved(s, "pages"))))


@query("replay_binlog", _pages("op NOT IN ('LOAD', 'TEST')", True) + f"SELECT {_PAGE} FROM z WHERE alive")
def replay_binlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.binlog(page_log(spark, sf_dir), snapshots.new_folder(spark, "binlog"))
    return _page_rows(pages.fold(snapshots.replayed(spark, path)))


@query("stream_page_state", _pages("true", True) + f"SELECT {_PAGE} FROM z WHERE alive")
def stream_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(live_pages.followed(page_log_of(live_sessions.events(spark, sf_dir))))


# --- commands ---
_DIM = "dim(op, handler, auth, replicate) AS (VALUES " + ", ".join(f"('{op}', '{h}', '{a}', {str(op in commands.REPLICATED.split()).lower()})" for (h, a), ops in commands.HANDLERS.items() for op in ops.split()) + ")"
query("command_routing", f"WITH {LOG}, {_DIM} SELECT handler, op, replicate, count(*) AS num FROM slog JOIN dim USING (op) GROUP BY ALL")(lambda s, d: commands.routed(session_log(s, d)).groupBy("handler", "op", "replicate").agg(F.count("*").alias("num")))
query("command_table", f"WITH {_DIM} SELECT * FROM dim")(lambda s, d: commands.command_dim(s))


@query("auth_audit", f"""WITH {LOG}, {_DIM}, p AS (SELECT seq, auth, (['none', 'user', 'admin', 'bulk'])[(seq % 4 + 1)::INT] AS provided FROM slog JOIN dim USING (op)
  UNION ALL SELECT seq, (['info', 'admin'])[(seq % 2 + 1)::INT], (['none', 'user', 'admin', 'bulk'])[(seq % 4 + 1)::INT] FROM slog)
SELECT auth, provided, (auth = 'info' OR provided = 'admin' OR auth = 'user' AND provided IN ('user', 'bulk')) AS passed, count(*) AS num FROM p GROUP BY ALL""")
def auth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = session_log(spark, sf_dir)
    provided = F.element_at(F.array(*map(F.lit, ("none", "user", "admin", "bulk"))), (F.col("seq") % 4 + 1).cast("int")).alias("provided")
    other = log.select("seq", F.when(F.col("seq") % 2 == 0, "info").otherwise("admin").alias("auth"), provided)
    both = commands.routed(log).select("seq", "auth", provided).unionByName(other)
    return both.withColumn("passed", commands.authenticated(F.col("auth"), F.col("provided"))).groupBy("auth", "provided", "passed").agg(F.count("*").alias("num"))


_BROKEN = """v AS (SELECT seq, CASE WHEN seq % 50 = 0 THEN '' ELSE id END AS id, CASE WHEN seq % 70 = 0 THEN 4 ELSE ua END AS ua, CASE WHEN seq % 90 = 0 THEN -2 ELSE lifetime END AS lifetime FROM slog),
a AS (SELECT seq, CASE WHEN strlen(id) < 1 THEN 'bad name' WHEN ua > 3 THEN 'bad user agent' WHEN lifetime < -1 OR lifetime > 4294967295 THEN 'bad lifetime' ELSE 'ok' END AS status FROM v)"""


@query("validate_commands", f"WITH {LOG}, {_BROKEN} SELECT seq, status FROM a")
def validate_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    broken = session_log(spark, sf_dir).withColumns({"id": F.when(n % 50 == 0, "").otherwise(F.col("id")), "ua": F.when(n % 70 == 0, 4).otherwise(F.col("ua")), "lifetime": F.when(n % 90 == 0, -2).otherwise(F.col("lifetime"))})
    return broken.select("seq", commands.status(F.col("id"), F.col("ua"), F.col("lifetime")).alias("status"))


@query("check_status", f"WITH {FPC}, {LOG}, {_BROKEN}, m AS (SELECT ua, sum(usize) AS value FROM fpc GROUP BY ua) SELECT 25 AS load, (SELECT count(*) FROM m WHERE ua = 0 AND value < 1000 OR ua = 3 AND value > 1000) AS warnings, (SELECT count(*) FROM a WHERE status <> 'ok') AS errors")
def check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are commands answered with one, warnings those of the health check; the load is the machine's, here given."""
    return stats.check(validate_commands(spark, sf_dir), _bytes_by_class(spark, sf_dir), _LIMITS, 25)


_LIMITS = {"bytes_ua0": ("min", 1000), "bytes_ua3": ("max", 1000)}


def _bytes_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpc_state(spark, sf_dir).groupBy("ua").agg(F.sum("usize").alias("value")).select(F.concat(F.lit("bytes_ua"), F.col("ua").cast("string")).alias("name"), "value")


query("replicated_commands", f"WITH {LOG} SELECT seq, id, op FROM slog WHERE op <> 'READ'")(lambda s, d: snapshots.replicated(session_log(s, d)).select("seq", "id", "op"))

# --- snapshots ---
_LEFT = f"CASE WHEN expire > {NOW} THEN expire - {NOW} ELSE 1 END"
query("snapshot_min_ua", f"WITH {FPC} SELECT id, ua, array_to_string(list_sort(linked), ',') AS tag_list, {_LEFT} AS lifetime FROM ft WHERE ua >= 2")(lambda s, d: snapshots.fpc_rows(fpc_state(s, d), NOW, 2).select("id", "ua", F.array_join(F.array_sort("tags"), ",").alias("tag_list"), "lifetime"))


@query("snapshot_restore", f"WITH {FPC} SELECT id, ua, array_to_string(list_sort(tags), ',') AS tag_list, {NOW}::BIGINT AS mtime, {NOW} + least({_LEFT}, {_list(L.FPC_MAX, 'ua')}) AS expire, usize FROM ft")
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.store(snapshots.fpc_rows(fpc_state(spark, sf_dir), NOW), snapshots.new_folder(spark, "snapshot"))
    return snapshots.restore_fpc(spark, path, NOW).select("id", "ua", F.array_join(F.array_sort("tags"), ",").alias("tag_list"), "mtime", "expire", "usize")


@query("snapshot_sessions", FOLD + f"SELECT id, rua AS ua, expire - {NOW - 86400 * 5} AS lifetime FROM z WHERE alive AND rua >= 1 AND expire > {NOW - 86400 * 5}")
def snapshot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.session_rows(sessions.live(session_log(spark, sf_dir)), NOW - 86_400 * 5, 1).select("id", "ua", "lifetime")


# --- options and counters ---
_OPTIONS = "opt(name, value) AS (VALUES " + ", ".join("('%s', '%s')" % tuple(x.split(" ", 1)) for x in config.OPTIONS.strip().split("\n")) + ")"
_COUNTERS = "cnt(name, domains) AS (VALUES " + ", ".join(f"('{n}', {m})" for m, names in config.COUNTERS.items() for n in names.split()) + ")"
query("config_get_masks", f"WITH {_OPTIONS} SELECT mask, name, value FROM opt JOIN (VALUES ('fpc_*', 'fpc\\_%'), ('*LIFETIMES', '%LIFETIMES')) m(mask, p) ON name ILIKE p ESCAPE '\\'")(lambda s, d: stats.wildcard(config.options(s), config.masks(s, ["fpc_*", "*LIFETIMES"])).select("mask", "name", "value"))
query("stats_mask_domain", f"WITH {_COUNTERS} SELECT name, domains FROM cnt WHERE domains & 4 <> 0 AND name ILIKE 'store\\_%' ESCAPE '\\'")(lambda s, d: stats.wildcard(config.counters(s).where("domains & 4 != 0"), config.masks(s, ["store_*"])).select("name", "domains"))


@query("config_set_latest", "WITH l(seq, name, value) AS (VALUES (1, 'max_fpc_memory', '0b'), (2, 'max_fpc_memory', '2g'), (3, 'max_session_memory', '512m'), (4, 'max_fpc_memory', '1g')) SELECT name, value FROM l QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1")
def config_set_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.latest(spark.createDataFrame([(1, "max_fpc_memory", "0b"), (2, "max_fpc_memory", "2g"), (3, "max_session_memory", "512m"), (4, "max_fpc_memory", "1g")], "seq int, name string, value string"))


# --- scalars ---
def _case(units: dict[str, int], suffix: str) -> str:
    return f"CASE lower({suffix}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in units.items()) + " ELSE 1 END"


def _spelled(spark: SparkSession, sf_dir: str, units: dict[str, int]) -> DataFrame:
    letters = F.array(F.lit(""), *(F.lit(u.upper() if i % 2 else u) for i, u in enumerate(units)))
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.select("p_partkey", F.concat((F.col("p_partkey") % 997).cast("string"), F.element_at(letters, (F.col("p_partkey") % (len(units) + 1) + 1).cast("int"))).alias("spelled"))


def _spelled_sql(units: dict[str, int]) -> str:
    letters = ", ".join(["''", *(f"'{u.upper() if i % 2 else u}'" for i, u in enumerate(units))])
    return f"p AS (SELECT p_partkey, p_partkey % 997 AS n, ([{letters}])[(p_partkey % {len(units) + 1} + 1)::INT] AS u FROM part)"


for _name, _units, _parse in (("parse_durations", scalars.DURATIONS, scalars.parse_duration), ("parse_sizes", scalars.SIZES, scalars.parse_size)):
    query(_name, f"WITH {_spelled_sql(_units)} SELECT p_partkey, n || u AS spelled, n * {_case(_units, 'u')}::BIGINT AS parsed FROM p")(lambda s, d, u=_units, f=_parse: _spelled(s, d, u).withColumn("parsed", f(F.col("spelled"))))


def _print_sql(units: dict[str, int]) -> str:
    (low, _), *rest = units.items()
    return "CASE " + " ".join(f"WHEN n <> 0 AND n % {v} = 0 THEN (n // {v}) || '{k}'" for k, v in reversed(rest)) + f" ELSE n || '{low}' END"


for _name, _units, _print, _step in (("print_durations", scalars.DURATIONS, scalars.print_duration, 3_600), ("print_sizes", scalars.SIZES, scalars.print_size, 524_288)):
    query(_name, f"WITH p AS (SELECT DISTINCT l_partkey * CASE WHEN l_linenumber % 2 = 0 THEN {_step} ELSE 30 END AS n FROM lineitem) SELECT n, {_print_sql(_units)} AS printed FROM p")(
        lambda s, d, f=_print, k=_step: table(s, d, "lineitem").select((F.col("l_partkey") * F.when(F.col("l_linenumber") % 2 == 0, k).otherwise(30)).alias("n")).distinct().withColumn("printed", f(F.col("n"))))

AGENTS = (None, "", "Mozilla", "Mozilla/5.0 (X11)", "Googlebot/2.1", "Wget/1.20", "curl/7.0", "Java/1.8", "my-uptime-check", "Mozilla/5.0 warm-3f7a")
query("classify_user_agent", "WITH a(agent) AS (VALUES " + ", ".join("(NULL)" if a is None else f"('{a}')" for a in AGENTS) + f") SELECT agent, CASE WHEN agent IS NULL THEN 0 WHEN contains(agent, 'warm-3f7a') THEN 2 WHEN regexp_matches(agent, '{scalars.BOTS}', 'i') THEN 1 ELSE 3 END AS ua FROM a")(
    lambda s, d: s.createDataFrame([(a,) for a in AGENTS], "agent string").withColumn("ua", scalars.user_agent(F.col("agent"), "warm-3f7a")))
query("vlq_overhead", f"WITH {FPC} SELECT id, usize // 255 + 1 AS overhead FROM fpc")(lambda s, d: fpc_state(s, d).select("id", scalars.vlq_overhead(F.col("usize")).alias("overhead")))

# --- warming ---
query("warmer_url_set", f"WITH {URLS} SELECT url, priority_milli FROM urls WHERE priority_milli BETWEEN 300 AND 900 AND lastmod >= {EPOCH + 36000} ORDER BY priority_milli DESC, ord LIMIT 50 OFFSET 10")(lambda s, d: urls.page(url_set(s, d), 300, 900, EPOCH + 36_000, 10, 50).select("url", "priority_milli"))
query("warmer_pass_plan", f"WITH {URLS} SELECT url, pass, ord % 16 AS worker FROM urls, (SELECT unnest([1, 2, 3]) AS pass)")(lambda s, d: urls.passes(url_set(s, d), 3, 16).select("url", "pass", "worker"))


@query("warmer_url_union", f"WITH {URLS}, s AS (SELECT *, 0 AS s FROM urls UNION ALL SELECT url, 1000 - priority_milli, lastmod + 60, ord, 1 FROM urls WHERE ord % 3 = 0) SELECT url, arg_max(priority_milli, s * 1000000000 + ord)::BIGINT AS priority_milli, arg_max(lastmod, s * 1000000000 + ord)::BIGINT AS lastmod FROM s GROUP BY url")
def warmer_url_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = url_set(spark, sf_dir)
    second = first.where("ord % 3 = 0").withColumns({"priority_milli": 1000 - F.col("priority_milli"), "lastmod": F.col("lastmod") + 60})
    return urls.union(first, second).select("url", "priority_milli", "lastmod")


@query("warmer_pass_stats", "SELECT user_id % 5 AS pass, count(*) AS pages, sum(floor(value)::BIGINT)::BIGINT AS total_ms, (sum(floor(value)::BIGINT) // count(*))::BIGINT AS avg_ms FROM events GROUP BY 1")
def warmer_pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.pass_stats(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("pass"), F.floor("value").alias("ms")))


_RESOURCE = ("html", "css", "js", "png", "jpeg", "woff2", "svg?x=1", "php")
query("url_resource_block", f"WITH {URLS}, u AS (SELECT url || '.' || ([{', '.join(repr(r) for r in _RESOURCE)}])[(ord % 8 + 1)::INT] AS url FROM urls) SELECT url FROM u WHERE NOT regexp_matches(url, 'css|[to]tf|eot|woff2?|svg|ico|gif|png|jpe?g')")(
    lambda s, d: url_set(s, d).select(F.concat("url", F.lit("."), F.element_at(F.array(*map(F.lit, _RESOURCE)), (F.col("ord") % 8 + 1).cast("int"))).alias("url")).where(~scalars.blocked(F.col("url"), css=False, js=True, images=False)))
query("warmer_clock", "WITH m AS (SELECT DISTINCT (l_quantity * 1237)::BIGINT AS ms FROM lineitem) SELECT ms, lpad((ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS shown FROM m")(
    lambda s, d: table(s, d, "lineitem").select((F.col("l_quantity") * 1237).cast("long").alias("ms")).distinct().withColumn("shown", scalars.clock(F.col("ms"))))


for _name, _sort, _order in (("warmer_urls_worst_first", "priority_milli, ord", "asc"), ("warmer_urls_as_is", "ord", "as-is")):
    query(_name, f"WITH {URLS} SELECT url, priority_milli FROM urls WHERE priority_milli BETWEEN 0 AND 900 ORDER BY {_sort} LIMIT 40 OFFSET 5")(lambda s, d, o=_order: urls.page(url_set(s, d), 0, 900, 0, 5, 40, o).select("url", "priority_milli"))

# --- literal answers, written out: the SQL shares nothing with the code ---
_WORDS = (("yes", "YES"), ("Session", "sess"), ("fpc_SAVE", "save"), ("on", "off"), ("0x1F", "1f"), ("-12", "2"), ("1.5e3", ""), ("ON", "on"))
query("string_tests", "SELECT a, b, same, first, last FROM (VALUES ('yes', 'YES', true, true, true), ('Session', 'sess', false, true, false), ('fpc_SAVE', 'save', false, false, true), ('on', 'off', false, false, false), ('0x1F', '1f', false, false, true), ('-12', '2', false, false, true), ('1.5e3', '', false, true, true), ('ON', 'on', true, true, true)) t(a, b, same, first, last)")(
    lambda s, d: s.createDataFrame(_WORDS, "a string, b string").select("a", "b", scalars.matches(F.col("a"), F.col("b")).alias("same"), scalars.starts_with(F.col("a"), F.col("b")).alias("first"), scalars.ends_with(F.col("a"), F.col("b")).alias("last")))
query("parse_numbers", "SELECT t, i, f, b FROM (VALUES ('yes', NULL, NULL, 'true'), ('OFF', NULL, NULL, 'false'), ('0x1F', 31, NULL, NULL), ('-12', -12, -12.0, NULL), ('+010', 8, 10.0, NULL), ('1.5e3', NULL, 1500.0, NULL), ('08', NULL, 8.0, NULL), ('', NULL, NULL, NULL)) v(t, i, f, b)")(
    lambda s, d: s.createDataFrame([(x,) for x in ("yes", "OFF", "0x1F", "-12", "+010", "1.5e3", "08", "")], "t string").select("t", scalars.signed(F.col("t")).alias("i"), scalars.number(F.col("t")).alias("f"), scalars.boolean(F.col("t")).cast("string").alias("b")))
query("padded_options", "SELECT n, shown FROM (VALUES (1, '5,5,5,5'), (2, '5,6,6,6'), (4, '5,6,7,8')) v(n, shown)")(
    lambda s, d: s.createDataFrame([(1, [5]), (2, [5, 6]), (4, [5, 6, 7, 8])], "n int, v array<int>").select("n", F.array_join(scalars.padded(F.col("v"), 4).cast("array<string>"), ",").alias("shown")))
_MOMENTS = ("30s", "2h", "1w", "5x", "2024-01-31 23:59:59", "2024-01-31__23:59:59", "2024-02-02 00:00:00", "2024-1-31 23:59:59")
query("warmer_moments", f"SELECT t, past, later FROM (VALUES ('30s', {NOW - 30}000, {NOW + 30}000), ('2h', {NOW - 7200}000, {NOW + 7200}000), ('1w', {NOW - 604800}000, {NOW + 604800}000), ('5x', NULL, NULL), ('2024-01-31 23:59:59', 1706745599000, NULL), ('2024-01-31__23:59:59', 1706745599000, NULL), ('2024-02-02 00:00:00', NULL, 1706832000000), ('2024-1-31 23:59:59', NULL, NULL)) v(t, past, later)")(
    lambda s, d: s.createDataFrame([(x,) for x in _MOMENTS], "t string").select("t", scalars.moment(F.col("t"), F.lit(NOW * 1000)).alias("past"), scalars.moment(F.col("t"), F.lit(NOW * 1000), True).alias("later")))
query("wire_sizes", f"""WITH {FPC}, n AS (SELECT id, tags, usize AS n, CASE WHEN usize - 72 < 256 THEN 1 WHEN usize - 72 < 65536 THEN 2 WHEN usize - 72 < 16777216 THEN 3 ELSE 4 END AS b FROM fpc)
SELECT id, (CASE WHEN n < 72 THEN 1 ELSE 1 + b END)::INT AS number, strlen(id)::BIGINT + 1 AS name, (1 + list_sum(list_transform(list_concat(tags, ['x']), lambda t: strlen(t) + 1)))::BIGINT AS tag_list FROM n""")(
    lambda s, d: fpc_state(s, d).select("id", scalars.integer_chunk(F.col("usize")).alias("number"), scalars.string_chunk(F.col("id")).cast("long").alias("name"), scalars.list_chunk(F.concat("tags", F.array(F.lit("x")))).alias("tag_list")))
query("unescaped_strings", "SELECT n, t FROM (VALUES (1, 'a' || chr(10) || 'b'), (2, 'it''s'), (3, 'A' || chr(9) || '\\'), (4, 'plain')) v(n, t)")(
    lambda s, d: s.createDataFrame([(1, "a\\nb"), (2, "it\\'s"), (3, "\\41\\t\\\\"), (4, "plain")], "n int, t string").select("n", scalars.unescaped(F.col("t")).alias("t")))


# --- codecs (no SQL: packed sizes) ---
def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("payload"))


query("recompression_best")(lambda s, d: codecs.best(_payloads(s, d)))
query("recoded_payloads", "SELECT 'doc-' || doc_id AS id, strlen(coalesce(text, ''))::BIGINT AS usize, sha256(coalesce(text, '')) AS digest FROM documents")(
    lambda s, d: codecs.recoded(codecs.recoded(_payloads(s, d), "zstd"), "zstd", back=True).select("id", "usize", F.sha2("payload", 256).alias("digest")))
query("recompression_counts")(lambda s, d: codecs.best(_payloads(s, d)).groupBy("codec").agg(F.count("*").alias("num")))


_PACKED = "(5 * (strlen(t) + len(regexp_extract_all(t, '[\\n`-~]{1,8}|[ -?]{1,8}|[@-_]{1,16}'))) + 7) // 8"
query("hesper_size", f"""WITH d AS (SELECT 'doc-' || doc_id AS id, coalesce(text, '') AS t FROM documents)
SELECT id, CASE WHEN regexp_full_match(t, '[\\n -~]+') AND {_PACKED} < strlen(t) THEN {_PACKED} END::BIGINT AS size FROM d""")(lambda s, d: _payloads(s, d).select("id", codecs.hesper_size(F.coalesce("payload", F.lit(""))).alias("size")))


# --- names, texts and tag lists ---
query("rotation_names", f"""WITH {URLS}, t AS (SELECT ord, lastmod, (['log_%s.txt', 'bin_%d.blf', '100%%_%d', 'none', '%s_%d'])[(ord % 5 + 1)::INT] AS tpl FROM urls)
SELECT ord, CASE ord % 5 WHEN 0 THEN 'log_' || strftime(make_timestamp(lastmod * 1000000), '%Y%m%d%H%M%S') || '.txt' WHEN 1 THEN 'bin_' || lastmod || '.blf' WHEN 2 THEN '100%_' || lastmod END AS name FROM t""")(
    lambda s, d: url_set(s, d).select("ord", scalars.rotated(F.element_at(F.array(*map(F.lit, ("log_%s.txt", "bin_%d.blf", "100%%_%d", "none", "%s_%d"))), (F.col("ord") % 5 + 1).cast("int")), F.col("lastmod")).alias("name")))
query("shown_times", f"WITH {URLS} SELECT ord, strftime(make_timestamp(lastmod * 1000000), '%Y.%m.%d %H:%M:%S') AS shown FROM urls")(lambda s, d: url_set(s, d).select("ord", scalars.shown_time(F.col("lastmod")).alias("shown")))
query("info_lines", f"WITH {FPC} SELECT ua, count(*) || ' record' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS line FROM fpc GROUP BY ua")(lambda s, d: fpc_state(s, d).groupBy("ua").agg(F.count("*").alias("n")).select("ua", scalars.plural(F.col("n"), "record").alias("line")))
query("tag_lists_edited", f"WITH {FPC} SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['new', 'en'])), lambda x: x <> 'fr')), ',') AS tag_list FROM fpc")(
    lambda s, d: fpc_state(s, d).select("id", F.array_join(F.array_sort(tags.removed(tags.added(F.col("tags"), ["new", "en"]), ["fr"])), ",").alias("tag_list")))
query("optimizable_records", f"WITH {FPC} SELECT id, usize FROM fpc WHERE usize >= 256")(lambda s, d: codecs.optimizable(fpc_state(s, d)).select("id", "usize"))
query("health_check", f"WITH {FPC}, m AS (SELECT 'bytes_ua' || ua AS name, sum(usize)::BIGINT AS value FROM fpc GROUP BY ua) SELECT name, value, CASE WHEN name = 'bytes_ua0' AND value < 1000 OR name = 'bytes_ua3' AND value > 1000 THEN 'warning' ELSE 'ok' END AS status FROM m")(
    lambda s, d: stats.health(_bytes_by_class(s, d), _LIMITS))


# --- streams ---
@query("stream_replicated", f"WITH {LOG} SELECT seq, id, op FROM slog WHERE op <> 'READ'")
def stream_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = snapshots.new_folder(spark, "replicas")
    live_sessions.fan_out(session_log_of(live_sessions.events(spark, sf_dir)), [f"{base}/a", f"{base}/b"], f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/b").select("seq", "id", "op")


@query("stream_windowed_counts", f"WITH {LOG} SELECT ts // 86400 * 86400 AS day, op, count(*) AS num FROM slog GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_sessions.counted(session_log_of(live_sessions.events(spark, sf_dir)))
