"""Named queries and their SQL.  Queries over events read it as a log: log = user_id, seq = event_id."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import chain, folds, index, paged, resolver
from ..operators.collection import Collection
from ..sources import codecs, dashed, stores
from ..streaming import channels

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, seq, payload, key, ts): payloads with nested fields that are set apart, replaced by scalars and deleted."""
    kind = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":'))
    n, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"mod":'), (F.col("event_id") % 3).cast("string"), F.lit(', "k":'), k, F.lit('},"tag":"'), F.col("event_type"), F.lit('"}'))
    value = F.when(F.col("event_id") % 7 == 0, "null}").when(F.col("event_id") % 11 == 0, F.concat(n, F.lit("}"))).when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"id":'), n, F.lit("}}"))).otherwise(nested)
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.concat(kind, value).alias("payload"), keys.to_base64(F.col("event_id") + 64).alias("key"), "ts")


def collection(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(events_log(spark, sf_dir))


#: The same fields in DuckDB: (log, seq, k, sub, v), sub being '' for a field of its own.
_FIELDS = """f0 AS (SELECT user_id AS log, event_id AS seq, event_type AS k, CASE WHEN event_id % 7 = 0 THEN 'n' WHEN event_id % 11 = 0 THEN 's' WHEN event_id % 5 = 0 THEN 'i' ELSE 'o' END AS c, json_extract_string(props, '$.k') AS p FROM events),
f AS (SELECT log, seq, k, '' AS sub, 'null' AS v FROM f0 WHERE c = 'n' UNION ALL SELECT log, seq, k, '', CAST(seq AS VARCHAR) FROM f0 WHERE c = 's' UNION ALL SELECT log, seq, k, 'id', CAST(seq AS VARCHAR) FROM f0 WHERE c = 'i'
  UNION ALL SELECT log, seq, k, 'mod', CAST(seq % 3 AS VARCHAR) FROM f0 WHERE c = 'o' UNION ALL SELECT log, seq, k, 'k', p FROM f0 WHERE c = 'o' UNION ALL SELECT log, seq, 'tag', '', '"' || k || '"' FROM f0 WHERE c = 'o'),
live AS (SELECT f.*, row_number() OVER (PARTITION BY log, k, sub ORDER BY seq DESC) AS rn, max(CASE WHEN sub = '' THEN seq END) OVER (PARTITION BY log, k) AS reset, count(CASE WHEN sub <> '' THEN 1 END) OVER (PARTITION BY log, k) AS subs FROM f),
state AS (SELECT log AS user_id, k, sub, v FROM live l WHERE rn = 1 AND v <> 'null' AND (reset IS NULL OR seq >= reset) AND NOT (sub = '' AND EXISTS (SELECT 1 FROM f g WHERE g.log = l.log AND g.k = l.k AND g.sub <> '' AND g.seq > l.seq)))"""

_B64 = "ltrim(array_to_string(list_transform(range(10, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-+', CAST(((event_id + 64) >> (6 * i)) & 63 AS INT) + 1, 1)), ''), '0')"


#: One text for both engines.
BOTH = {
    "fold_tombstone": "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1 AND value IS NOT NULL",
    "range_read": "SELECT event_id, user_id, event_type FROM events WHERE event_id BETWEEN 100 AND 299",
    "entity_resolve": "SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey",
    "children_join": "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "missing_keys": "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "percentiles": "SELECT event_type, max(CASE WHEN rn = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN rn = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN value END) AS p95, max(CASE WHEN rn = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) THEN value END) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type",
    "sql_join_agg": "SELECT n.n_name, count(*) AS n, CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_group_topk": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_window_rank": "SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r, dense_rank() OVER (ORDER BY s_nationkey) AS dr, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q FROM supplier",
    "sql_window_frame": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events",
    "sql_semi": "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000",
    "sql_anti": "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "sql_full_outer": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48",
    "sql_distinct_agg": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "sql_correlated_subquery": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)",
    "log_union": "SELECT event_type, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_type, user_id FROM events WHERE user_id % 3 = 0",
    "sql_range_join": "SELECT CAST(r.n_nationkey AS BIGINT) AS part, count(*) AS n FROM nation r JOIN (SELECT event_id, (SELECT CAST(floor(count(*) / 25) + 1 AS BIGINT) FROM events) AS width FROM events) e ON e.event_id >= r.n_nationkey * e.width AND e.event_id < (r.n_nationkey + 1) * e.width GROUP BY r.n_nationkey",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_q1": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
}

#: Lines of documents, without a last empty one, in DuckDB.
_LINES = r"""WITH l0 AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents)),
l1 AS (SELECT * FROM l0 WHERE NOT (line_no = n - 1 AND line = '') AND NOT (ltrim(line) LIKE '//- pagedtext filling%' OR line = ' ')),
l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS line_no, line FROM l1) """


def _of_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log's even records as a chain, its odd ones appended behind them."""
    log = events_log(spark, sf_dir).select("log", "seq", "payload")
    first = chain.write_chain(log.where("seq % 2 = 0").unionByName(log.select("log").distinct().join(log.where("seq % 2 = 0").select("log").distinct(), "log", "left_anti").join(log, "log").where("seq % 2 = 1").withColumn("seq", F.col("seq") * 2)))
    later = log.join(log.where("seq % 2 = 0").select("log").distinct(), "log", "left_semi").where("seq % 2 = 1").withColumn("seq", F.col("seq") + (1 << 40))
    return chain.verify(first.unionByName(chain.extend_chain(first, later))).select("log", "valid", "length")


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last event of its customer up to its number: one window over both, no pairs."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), "event_id", F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).where("side = 1").select(F.col("at").alias("o_orderkey"), "event_id")


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one dashed document a region, with its nations as tasks."""
    n = table(spark, sf_dir, "nation")
    tag = F.when(F.col("n_nationkey") % 3 == 0, "high, ").when(F.col("n_nationkey") % 3 == 1, "low, ").otherwise("")
    line = F.concat(F.lit("---1.1."), F.col("n_nationkey"), F.lit("-n#h"), F.col("n_nationkey"), F.lit(": "), "n_name", F.lit(" ["), tag, F.col("n_nationkey") + 1, F.lit("h, wip]"))
    lines = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    docs = table(spark, sf_dir, "region").join(lines, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.concat(F.lit("r"), "r_regionkey").alias("doc"), F.concat(F.lit("-1-region: "), "r_name", F.lit("\n--1.1-nations: All\n"), F.coalesce("body", F.lit(""))).alias("value"))
    return dashed.parse(docs)


#: (Spark SQL or function, DuckDB SQL)
PAIRS: dict[str, tuple] = {
    "fold_assign": (
        lambda s, d: folds.assign(events_log(s, d)).withColumnRenamed("log", "user_id"),
        f"WITH {_FIELDS}, whole AS (SELECT log, seq, k, CASE WHEN bool_or(sub = '') THEN max(v) WHEN bool_or(sub = 'id') THEN '{{\"id\":' || max(v) || '}}' ELSE '{{\"k\":' || max(CASE WHEN sub = 'k' THEN v END) || ',\"mod\":' || max(CASE WHEN sub = 'mod' THEN v END) || '}}' END AS v FROM f GROUP BY log, seq, k) SELECT log AS user_id, k, arg_max(v, seq) AS v FROM whole GROUP BY log, k",
    ),
    "fold_append": (
        lambda s, d: folds.append(table(s, d, "conversations").select(F.col("conv_id").alias("log"), F.col("turn").alias("seq"), F.col("role").alias("payload"))).select(F.col("log").alias("conv_id"), F.array_join("records", ",").alias("roles")),
        "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    ),
    "fold_fill_missing": (
        lambda s, d: folds.fill_missing(table(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), table(s, d, "documents").select("doc_id", F.col("n_chars").alias("v")), ["doc_id"]),
        "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, d.n_chars) AS v FROM labels l FULL OUTER JOIN documents d ON d.doc_id = l.doc_id",
    ),
    "fold_membership": (lambda s, d: folds.membership(events_log(s, d)).groupBy("log").agg(F.count(F.lit(1)).alias("n")), "SELECT user_id AS log, count(DISTINCT event_id) AS n FROM events GROUP BY user_id"),
    "fold_custom": (
        lambda s, d: folds.custom(events_log(s, d), lambda state, p: {"n": state["n"] + 1, "tags": state["tags"] + ("tag" in p)}, {"n": 0, "tags": 0}, "log long, n long, tags long"),
        "SELECT user_id AS log, count(*) AS n, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0) AS tags FROM events GROUP BY user_id",
    ),
    "fold_upsert_by_id": (
        lambda s, d: folds.upsert_by_id(table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"),
        "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    ),
    "fold_merge_nested": (
        lambda s, d: folds.merge(events_log(s, d)).select(F.col("log").alias("user_id"), "k", F.coalesce("sub", F.lit("")).alias("sub"), "v"),
        f"WITH {_FIELDS} SELECT * FROM state",
    ),
    "fold_deep_merge": (
        lambda s, d: folds.deep_merge(events_log(s, d).withColumn("payload", F.concat(F.lit('{"a":{"b/c":'), "payload", F.lit("}}")))).select(F.col("log").alias("user_id"), "path", "v"),
        f"WITH {_FIELDS} SELECT user_id, 'a/b/c/' || k || CASE WHEN sub = '' THEN '' ELSE '/' || sub END AS path, v FROM state",
    ),
    "point_lookup": (lambda s, d: collection(s, d).get("#2d").select("log", "seq"), "SELECT user_id AS log, event_id AS seq FROM events WHERE event_id + 64 = 141"),
    "find_predicate": (lambda s, d: collection(s, d).find(F.try_variant_get(F.parse_json("payload"), "$.tag", "string") == "purchase").select("log", "seq"), "SELECT user_id AS log, event_id AS seq FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0"),
    "delta_since": (lambda s, d: collection(s, d).since(500).select("log", "seq"), "SELECT user_id AS log, event_id AS seq FROM events WHERE event_id > 500"),
    "nth_record": (lambda s, d: collection(s, d).nth(2).select("log", "seq"), "SELECT user_id AS log, event_id AS seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 3"),
    "last_key": (lambda s, d: collection(s, d).last(), f"SELECT user_id AS log, max(event_id) AS seq, arg_max({_B64}, event_id) AS key FROM events GROUP BY user_id"),
    "entities_summary": (lambda s, d: collection(s, d).stats().select("log", "records", "keys", "last"), "SELECT user_id AS log, count(*) AS records, count(DISTINCT event_id) AS keys, max(event_id) AS last FROM events GROUP BY user_id"),
    "undo_last": (lambda s, d: collection(s, d).undo().log.select("log", "seq"), "SELECT user_id AS log, event_id AS seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn > 1"),
    "settle_first_result": (
        lambda s, d: chain.settle(_of_type(s, d, "click").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), _of_type(s, d, "purchase").select(F.col("event_id").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").alias("prev"), F.lit(None).cast("long").alias("ref"))).select("seq", F.col("result_key").alias("result")),
        "SELECT c.event_id AS seq, min(r.event_id) AS result FROM events c LEFT JOIN events r ON r.user_id = c.user_id AND r.event_type = 'purchase' AND r.event_id > c.event_id WHERE c.event_type = 'click' GROUP BY c.event_id",
    ),
    "settle_in_time": (
        lambda s, d: channels.settle(table(s, d, "events").where("event_type = 'click' AND event_id % 10 = 0").select(F.col("event_id").alias("key"), "ts"), table(s, d, "events").where("event_id % 10 = 3").select(F.col("event_id").cast("string").alias("key"), (F.col("event_id") - 3).alias("prev"), F.lit(None).cast("long").alias("ref"), F.lit("result").alias("type"), "ts"), 3_600_000).select("key", "result"),
        "SELECT c.event_id AS key, coalesce(CAST(r.event_id AS VARCHAR), 'timeout') AS result FROM events c LEFT JOIN events r ON r.event_id = c.event_id + 3 AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND c.event_id % 10 = 0",
    ),
    "log_equality": (
        lambda s, d: chain.same_log(*(table(s, d, "events").where(f"user_id % 2 = {k}").select("event_type", (F.col("event_id") % 10).alias("digit")) for k in (0, 1))),
        " UNION ALL ".join(f"SELECT event_type, digit, '{side}' AS side FROM (SELECT event_type, event_id % 10 AS digit FROM events WHERE user_id % 2 = {k} EXCEPT ALL SELECT event_type, event_id % 10 AS digit FROM events WHERE user_id % 2 = {1 - k})" for k, side in ((0, "left"), (1, "right"))),
    ),
    "ancestry_closure": (
        lambda s, d: chain.descendants(table(s, d, "events").where("event_id > 0").select(F.col("event_id").alias("key"), F.floor(F.col("event_id") / 8).alias("prev")), 0),
        "WITH RECURSIVE up(key, depth) AS (SELECT event_id, 1 FROM events WHERE event_id BETWEEN 1 AND 7 UNION ALL SELECT e.event_id, up.depth + 1 FROM events e JOIN up ON e.event_id // 8 = up.key AND e.event_id >= 8) SELECT key, CAST(depth AS INT) AS depth FROM up",
    ),
    "parent_recovery": (
        lambda s, d: chain.parents(chain.with_previous(events_log(s, d)).select("log", "seq", "payload", keys.full_key(F.col("payload"), F.col("before")).alias("full")), events_log(s, d)),
        "SELECT user_id AS log, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events",
    ),
    "type_inheritance": (
        lambda s, d: chain.inherited(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))), table(s, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("field"), F.col("r_regionkey").alias("value")).unionByName(table(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("own").alias("field"), F.col("n_nationkey").alias("value")))).where("field <> ''"),
        "SELECT n_name AS name, 'region' AS field, n_regionkey AS value FROM nation UNION ALL SELECT n_name, 'own', n_nationkey FROM nation UNION ALL SELECT r_name, 'region', r_regionkey FROM region",
    ),
    "verify_chain": (lambda s, d: chain.verify(chain.write_chain(events_log(s, d))), "SELECT user_id AS log, true AS valid, count(*) + 2 AS length, CAST(NULL AS BIGINT) AS failed_at, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS duplicates FROM events GROUP BY user_id"),
    "chain_append": (
        lambda s, d: _appended(s, d),
        "SELECT user_id AS log, true AS valid, count(*) + 2 AS length FROM events GROUP BY user_id",
    ),
    "verify_broken": (
        lambda s, d: chain.verify(events_log(s, d)).select("log", "valid", "length", "failed_at", "failures"),
        f"""WITH c AS (SELECT user_id, event_id, event_type, {_B64} AS key, substr(bin(event_id + 64), 2) AS bits,
          '{{"' || event_type || '":' || CASE WHEN event_id % 7 = 0 THEN 'null}}' WHEN event_id % 11 = 0 THEN event_id || '}}' WHEN event_id % 5 = 0 THEN '{{"id":' || event_id || '}}}}' ELSE '{{"k":' || json_extract_string(props, '$.k') || ',"mod":' || event_id % 3 || '}},"tag":"' || event_type || '"}}' END AS canonical FROM events),
        p AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY user_id ORDER BY event_id), '') AS before FROM c),
        h AS (SELECT *, starts_with(lpad(bin(xor(CAST('0x' || substr(sha256(CASE WHEN event_type > 'tag' AND canonical LIKE '%"tag":%' THEN '{{"tag":"' || event_type || '",' || substr(regexp_replace(canonical, ',"tag":.*', ''), 2) || '}}' ELSE canonical END), 1, 16) AS UBIGINT), CAST('0x' || substr(sha256(before), 1, 16) AS UBIGINT))), 64, '0'), bits) AS ok FROM p)
        SELECT user_id AS log, bool_and(ok) AS valid, count(*) AS length, min(CASE WHEN NOT ok THEN event_id END) AS failed_at, count(*) FILTER (WHERE NOT ok) AS failures FROM h GROUP BY user_id""",
    ),
    "level_occupancy": (lambda s, d: collection(s, d).levels(), "SELECT log, level, count(*) AS count, count(*) >= power(2, level) AS closed FROM (SELECT user_id AS log, CAST(length(bin(event_id + 64)) - 1 AS INT) AS level FROM events) GROUP BY log, level"),
    "level_histogram": (lambda s, d: index.depth_histogram(events_log(s, d)).select("log", "level", "count"), "SELECT user_id AS log, CAST(length(bin(event_id + 64)) - 1 AS INT) AS level, count(*) AS count FROM events GROUP BY 1, 2"),
    "index_round_trip": (lambda s, d: index.from_lines(index.to_lines(index.entries(events_log(s, d)))).select("log", "level", "bits"), "SELECT user_id AS log, CAST(length(bin(event_id + 64)) - 1 AS INT) AS level, substr(bin(event_id + 64), 2) AS bits FROM events"),
    "prefix_lookup": (
        lambda s, d: index.lookup(index.entries(events_log(s, d).withColumn("log", F.lit(1))).where("level = 6"), table(s, d, "customer").select(F.lit(1).alias("log"), F.bin(F.col("c_custkey") + 128).alias("bits"))).select("bits", F.coalesce("found", F.lit("-")).alias("found")),
        "SELECT DISTINCT bin(c_custkey + 128) AS bits, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_id < 64 AND substr(bin(event_id + 64), 2) = substr(bin(c_custkey + 128), 1, 6)) THEN substr(bin(c_custkey + 128), 1, 6) ELSE '-' END AS found FROM customer",
    ),
    "level_extents": (
        lambda s, d: index.extents(events_log(s, d).withColumn("payload", F.lit("{}"))),
        f"SELECT log, level, min(upto - n) AS first, max(upto) AS last, count(*) AS count FROM (SELECT user_id AS log, CAST(length(bin(event_id + 64)) - 1 AS INT) AS level, 4 + length({_B64}) AS n, CAST(sum(4 + length({_B64})) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM events) GROUP BY log, level",
    ),
    "write_gaps": (
        lambda s, d: index.write_stats(events_log(s, d).select("log", "seq", F.col("seq").alias("t")), "t").select("log", "count", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance")),
        "SELECT user_id AS log, count(gap) AS count, round(avg(gap), 4) AS mean, round(var_samp(gap), 2) AS variance FROM (SELECT user_id, CAST(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS gap FROM events) GROUP BY user_id",
    ),
    "channel_last": (lambda s, d: channels.last(table(s, d, "events").select(F.col("event_type").alias("event"), F.col("event_id").alias("seq"), F.col("props").alias("payload")), field="k"), "SELECT event_type AS event, json_extract_string(arg_max(props, event_id), '$.k') AS payload FROM events GROUP BY event_type"),
    "dashed_nodes": (lambda s, d: _outline(s, d).where("kind = 'node' AND depth = 3").select("doc", "path", "title", "priority", "status", "estimate", "hash", "slug"), "SELECT 'r' || n_regionkey AS doc, '1-region>1.1-nations>1.1.' || n_nationkey || '-n' AS path, n_name AS title, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS priority, 'wip' AS status, CAST(n_nationkey + 1 AS VARCHAR) AS estimate, 'h' || n_nationkey AS hash, 'n' AS slug FROM nation"),
    "dashed_children": (lambda s, d: dashed.children(_outline(s, d), "1-region>1.1-nations").select("doc", "id", "pos"), "SELECT 'r' || n_regionkey AS doc, '1.1.' || n_nationkey || '-n' AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS pos FROM nation"),
    "dashed_round_trip": (lambda s, d: dashed.parse(dashed.to_text(_outline(s, d))).where("kind = 'node'").select("doc", "path", "title", "hash"), "SELECT 'r' || n_regionkey AS doc, '1-region>1.1-nations>1.1.' || n_nationkey || '-n' AS path, n_name AS title, 'h' || n_nationkey AS hash FROM nation UNION ALL SELECT 'r' || r_regionkey, '1-region', r_name, NULL FROM region UNION ALL SELECT 'r' || r_regionkey, '1-region>1.1-nations', 'All', NULL FROM region"),
    "dashed_typed": (lambda s, d: table(s, d, "events").select("event_id", F.to_json(dashed.typed(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.lit("true")))).alias("v")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '\"' || event_type || '\"' ELSE 'true' END AS v FROM events"),
    "address_parts": (
        lambda s, d: table(s, d, "events").select("event_id", F.concat("event_type", F.lit("#"), F.col("event_id"), F.lit("[b:"), F.col("user_id"), F.lit("]")).alias("a")).select("event_id", resolver.parts(F.col("a")).alias("p")).select("event_id", "p.kind", "p.head", "p.rest", "p.branch", "p.turn"),
        "SELECT event_id, 'entity' AS kind, event_type AS head, CAST(event_id AS VARCHAR) AS rest, 'b' AS branch, CAST(user_id AS INT) AS turn FROM events",
    ),
    "json_tree": (lambda s, d: resolver.tree(events_log(s, d).select(F.col("seq").alias("doc"), F.col("payload").alias("value"))).where("path LIKE '%/%'").select("doc", "path", "parent", "value"), f"WITH {_FIELDS} SELECT seq AS doc, k || '/' || sub AS path, k AS parent, v AS value FROM f WHERE sub <> ''"),
    "projection_json": (lambda s, d: stores.nest(folds.assign(events_log(s, d)).where("k = 'tag'")).withColumn("value", F.replace("value", F.lit(" "), F.lit(""))), "SELECT user_id AS log, '{\"tag\":\"' || arg_max(event_type, event_id) || '\"}' AS value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 GROUP BY user_id"),
    "log_lines": (
        lambda s, d: codecs.parse_lines(events_log(s, d).select("seq", F.when(F.col("seq") % 3 == 0, codecs.hashed_line(F.col("key"), F.col("payload"))).when(F.col("seq") % 3 == 1, codecs.jsonl_line(F.col("key"), F.col("payload"))).otherwise(codecs.flow_line(F.col("key"), F.col("payload"))).alias("value"))).select("seq", "key"),
        f"SELECT event_id AS seq, {_B64} AS key FROM events",
    ),
    "env_parse": (lambda s, d: table(s, d, "customer").select("c_custkey", codecs.parse_env(F.concat(F.lit("# c\nNAME='"), "c_name", F.lit("'\nKEY="), F.col("c_custkey"), F.lit("\nKEY=x=y"))).alias("e")).select("c_custkey", F.col("e")["NAME"].alias("name"), F.col("e")["KEY"].alias("key")), "SELECT c_custkey, c_name AS name, 'x=y' AS key FROM customer"),
    "paged_find": (lambda s, d: paged.PagedText.of(table(s, d, "documents")).find(lambda x: F.length(x) > 60).select("doc_id", "index"), _LINES + "SELECT doc_id, coalesce(min(CASE WHEN length(line) > 60 THEN line_no END), -1) AS index FROM l GROUP BY doc_id"),
    "paged_some_every": (lambda s, d: (lambda t: t.some(lambda x: x == "").join(t.every(lambda x: x != ""), "doc_id"))(paged.PagedText.of(table(s, d, "documents"))), _LINES + "SELECT doc_id, bool_or(line = '') AS some, bool_and(line <> '') AS every FROM l GROUP BY doc_id"),
    "paged_slice": (lambda s, d: paged.PagedText.of(table(s, d, "documents")).slice(1, -1), _LINES + "SELECT doc_id, line_no, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l) WHERE line_no >= 1 AND line_no < n - 1"),
    "paged_reverse": (lambda s, d: paged.PagedText.of(table(s, d, "documents")).reverse().lines.withColumn("line_no", F.col("line_no").cast("long")), _LINES + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) - 1 AS BIGINT) AS line_no, line FROM l"),
    "paged_reduce": (lambda s, d: paged.PagedText.of(table(s, d, "documents")).reduce(lambda a, x: a + F.length(x), F.lit(0)), _LINES + "SELECT doc_id, CAST(sum(length(line)) AS INT) AS value FROM l GROUP BY doc_id"),
    "paged_edit": (lambda s, d: paged.PagedText.of(table(s, d, "documents")).push("end", "of it").shift().pop().length(), _LINES + "SELECT doc_id, count(*) AS length FROM l GROUP BY doc_id"),
    "json_path_get": ("SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "hash_sha64": (lambda s, d: table(s, d, "events").select("event_id", keys.sha64_hex(F.col("props")).alias("h")), "SELECT event_id, substr(sha256(props), 1, 16) AS h FROM events"),
    "hash_chain_key": (
        lambda s, d: sql(s, d, "SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events").select("event_id", F.lower(F.lpad(F.hex(keys.full_key(F.col("props"), F.col("p"))), 16, "0")).alias("h")),
        "SELECT event_id, lower(lpad(to_hex(xor(CAST('0x' || substr(sha256(replace(props, ' ', '')), 1, 16) AS UBIGINT), CAST('0x' || substr(sha256(coalesce(lag(props) OVER (PARTITION BY user_id ORDER BY event_id), '')), 1, 16) AS UBIGINT))), 16, '0')) AS h FROM events",
    ),
    "key_b64": (
        lambda s, d: table(s, d, "events").select("event_id", keys.to_base64(F.col("event_id") * 7919).alias("b64")),
        "SELECT event_id, CASE WHEN event_id = 0 THEN '0' ELSE ltrim(array_to_string(list_transform(range(10, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-+', CAST(((event_id * 7919) >> (6 * i)) & 63 AS INT) + 1, 1)), ''), '0') END AS b64 FROM events",
    ),
    "byte_offsets": ("SELECT event_id, user_id, CAST(sum(octet_length(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM events", "SELECT event_id, user_id, CAST(sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_at FROM events"),
    "line_explode": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"),
        "SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    ),
    "page_pack": (
        lambda s, d: paged.pack_pages(table(s, d, "documents"), 1024),
        """WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, strlen(unnest(ls)) + 1 AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
        p(doc_id, i, page, used) AS (SELECT doc_id, i, CAST(0 AS BIGINT), CAST(b AS BIGINT) FROM l WHERE i = 1
          UNION ALL SELECT l.doc_id, l.i, CASE WHEN p.used + l.b > 1024 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + l.b > 1024 THEN CAST(l.b AS BIGINT) ELSE CAST(p.used + l.b AS BIGINT) END FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1)
        SELECT doc_id, page, count(*) AS n_lines, CAST(max(used) AS BIGINT) AS n_bytes FROM p GROUP BY doc_id, page""",
    ),
    "lines_join": ("SELECT conv_id, listagg(text, '\\n') WITHIN GROUP (ORDER BY turn) AS t FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id"),
    "sql_asof": (
        lambda s, d: _asof(s, d),
        "SELECT o.o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN events e ON e.user_id = o.o_custkey AND e.event_id <= o.o_orderkey",
    ),
    "win_tumbling": ("SELECT window.start AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "win_sliding": ("SELECT window.start AS w, count(*) AS n FROM events GROUP BY window(ts, '1 hour', '30 minutes')", "SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * k) AS w, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1"),
    "win_session": (
        "SELECT user_id, session_window.start AS w, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
        "SELECT user_id, min(ts) AS w, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(q) -> Callable[[SparkSession, str], DataFrame]:
        return (lambda spark, sf_dir: sql(spark, sf_dir, q)) if isinstance(q, str) else q

    return {k: of(q) for k, q in BOTH.items()} | {k: of(q) for k, (q, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    semi = {k: re.sub(r"LEFT (SEMI|ANTI) JOIN", r"\1 JOIN", q) for k, q in BOTH.items()}
    return semi | {k: q for k, (_, q) in PAIRS.items()}
