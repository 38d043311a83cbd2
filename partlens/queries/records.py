"""Queries on labels, logs, slots, ledgers, records and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import diff, resolve
from ..operators.keyed import positions_within
from ..sources import corpus as K
from ..sources import runs as R
from .registry import Tables, query


@query("label_parse", r"""
WITH e AS (SELECT DISTINCT 'r' || user_id AS base, CASE WHEN value < 60 THEN 'claude-' || event_type || '-5-20260101' ELSE '' END AS model,
    CASE WHEN event_type = 'view' THEN 'noskill' ELSE 'skill' END AS cond, (value > 40)::INT AS hide,
    CASE WHEN event_type = 'error' THEN 'example' ELSE '' END AS abl FROM events),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(model, '^claude-', ''), '-[0-9]{8}$', ''), '[^a-zA-Z0-9]', '', 'g') AS slug FROM e)
SELECT base || CASE WHEN slug <> '' THEN '-' || slug ELSE '' END || CASE WHEN cond <> 'skill' THEN '-' || cond ELSE '' END
    || CASE WHEN hide = 1 THEN '-nodocs' ELSE '' END || CASE WHEN abl <> '' THEN '-abl' || abl ELSE '' END AS label,
  base, nullif(slug, '') AS model, cond AS condition, hide = 1 AS hide_docs, nullif(abl, '') AS ablate FROM s
GROUP BY ALL""")
def label_parse(t: Tables) -> DataFrame:
    """Labels are built from run settings and read back into them."""
    event = F.col("event_type")
    made = t.events.select(L.build_label(
        F.concat(F.lit("r"), "user_id"),
        F.when(F.col("value") < 60, F.concat(F.lit("claude-"), event, F.lit("-5-20260101"))).otherwise(""),
        F.when(event == "view", "noskill").otherwise("skill"),
        (F.col("value") > 40).cast("int"),
        F.when(event == "error", "example").otherwise("")).alias("label")).distinct()
    return made.select("label", L.parse_label("label").alias("p")).select("label", "p.*")


@query("stderr_classify", """
WITH e AS (SELECT user_id, CASE WHEN value > 60 THEN 'HTTP 429 Too many' WHEN value > 50 THEN 'Usage Limit reached' WHEN value > 45 THEN 'Server OVERLOADED'
    ELSE event_type END AS err, CASE WHEN event_type = 'error' AND value < 10 THEN 0 ELSE length(props) END AS size FROM events)
SELECT user_id, CASE WHEN regexp_matches(err, '(?i)usage limit|rate limit|429|quota exceeded|overloaded') THEN 'limited'
  WHEN size = 0 THEN 'aborted' ELSE 'done' END AS outcome, count(*) AS n FROM e GROUP BY ALL""")
def stderr_classify(t: Tables) -> DataFrame:
    v = F.col("value")
    err = F.when(v > 60, "HTTP 429 Too many").when(v > 50, "Usage Limit reached").when(v > 45, "Server OVERLOADED").otherwise(F.col("event_type"))
    size = F.when((F.col("event_type") == "error") & (v < 10), 0).otherwise(F.length("props"))
    return t.events.groupBy("user_id", L.classify_run(err, size).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_SECTIONED = "regexp_replace(text, '(?m)^([A-M])', '## \\1', 'g')"


@query("section_strip", rf"""
WITH t AS (SELECT doc_id, string_split({_SECTIONED}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
h AS (SELECT *, max(CASE WHEN starts_with(line, '## ') THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM l),
s AS (SELECT h.doc_id, h.i, h.line, coalesce(starts_with(x.line, '## D'), false) AS skip FROM h LEFT JOIN l x ON x.doc_id = h.doc_id AND x.i = h.hi),
k AS (SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM s WHERE NOT skip GROUP BY 1)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN k USING (doc_id)""")
def section_strip(t: Tables) -> DataFrame:
    """Lines that start with A-M become headings; sections headed D are removed."""
    marked = F.regexp_replace("text", "(?m)^([A-M])", "## $1")
    stripped = L.drop_section(marked, "## D")
    # when the last section goes, the newline before it ends the text and starts no line
    kept = F.when(stripped == marked, marked).otherwise(F.regexp_replace(stripped, "\n$", ""))
    return t.documents.select("doc_id", kept.alias("kept")).select(
        "doc_id", F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", "\n"))).cast("long").alias("n_lines"),
        F.md5("kept").alias("digest"))


@query("lint_rounds", """
SELECT source, sum((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS n FROM documents GROUP BY 1""")
def lint_rounds(t: Tables) -> DataFrame:
    """Rounds in a log whose round mark stands where the text has 'tion'."""
    log = F.replace(F.col("text"), F.lit("tion"), F.lit("\n=== lint round 1 ===\n"))
    return t.documents.groupBy("source").agg(F.sum(L.lint_rounds(log)).cast("long").alias("n"))


@query("hide_documents", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS u FROM pages),
f AS (SELECT page_id, CASE WHEN starts_with(u, 'en/') THEN 'docs/' || u WHEN contains(u, '.html') THEN replace(u, '.html', '.MD')
  WHEN starts_with(u, 'de/') THEN 'src/architecture_' || replace(u, '/', '_') ELSE u END AS path FROM p)
SELECT page_id, path FROM f WHERE NOT (regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\.(md|rst|txt)$')
  OR starts_with(lower(regexp_extract(path, '[^/]*$')), 'architecture') OR starts_with(path, 'docs/') OR starts_with(path, 'doc/'))""")
def hide_documents(t: Tables) -> DataFrame:
    u = F.col("u")
    path = F.when(u.startswith("en/"), F.concat(F.lit("docs/"), u)).when(u.contains(".html"), F.replace(u, F.lit(".html"), F.lit(".MD"))).when(
        u.startswith("de/"), F.concat(F.lit("src/architecture_"), F.replace(u, F.lit("/"), F.lit("_")))).otherwise(u)
    pages = t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "").alias("u"))
    return pages.select("page_id", path.alias("path")).where(~L.is_documentation("path"))


@query("ledger_counts", """
WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt,
  CASE WHEN value > 30 THEN 0 WHEN value > 15 THEN 4 WHEN value > 5 THEN 3 ELSE 1 END AS code FROM events),
k AS (SELECT user_id, event_type, min(attempt) FILTER (code = 0) AS ok_at FROM a GROUP BY ALL),
t AS (SELECT a.* FROM a JOIN k USING (user_id, event_type) WHERE attempt <= least(coalesce(ok_at, 3), 3)),
o AS (SELECT user_id, event_type, arg_max(code, attempt) AS code, max(attempt) AS attempts,
  sum(CASE WHEN code = 0 OR attempt = 3 THEN 0 WHEN code = 4 THEN 60 * attempt ELSE 5 * attempt END)::BIGINT AS backoff FROM t GROUP BY ALL)
SELECT event_type, count(*) FILTER (code = 0) AS done, count(*) FILTER (code <> 0) AS failed, sum(attempts)::BIGINT AS attempts, sum(backoff)::BIGINT AS backoff
FROM o GROUP BY 1""")
def ledger_counts(t: Tables) -> DataFrame:
    """Events of a user as attempts at a slot: final outcomes, then the counts per type."""
    v = F.col("value")
    events = t.events.select(
        F.col("user_id").alias("repo"), F.col("event_type").alias("rep"), "event_id",
        F.when(v > 30, 0).when(v > 15, 4).when(v > 5, 3).otherwise(1).alias("exit_code"))
    attempts = positions_within(events, ["repo", "rep"], ["event_id"]).withColumn("attempt", F.col("position") + 1)
    ledger = K.final_outcomes(attempts)
    return K.ledger_counts(ledger, ["rep"]).join(
        ledger.groupBy("rep").agg(F.sum("attempts").alias("attempts"), F.sum("backoff").alias("backoff")), "rep"
    ).withColumnRenamed("rep", "event_type")


@query("shard", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 4 AS shard FROM orders""")
def shard(t: Tables) -> DataFrame:
    """Orders dealt to four workers in date order."""
    return K.shard_of(t.orders, 4, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "shard")


@query("open_slots", """
SELECT c_custkey AS repo, c_mktsegment AS sha, r AS rep FROM customer, (SELECT unnest(['1-URGENT', '5-LOW', '2-HIGH']) AS r)
WHERE c_nationkey NOT IN (3, 7) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = r)""")
def open_slots(t: Tables) -> DataFrame:
    """Customer x priority slots without an order yet; two nations are held out."""
    corpus = t.customer.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("sha"), "c_nationkey")
    holdout = corpus.where("c_nationkey IN (3, 7)")
    wanted = K.slots(corpus, ["1-URGENT", "5-LOW", "2-HIGH"], holdout)
    scored = t.orders.select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("rep"))
    return K.open_slots(wanted, scored, ["repo", "rep"])


@query("dev_size", """
SELECT count(*) AS n_dev FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey NOT IN (3, 7)""")
def dev_size(t: Tables) -> DataFrame:
    corpus = t.customer.select(F.col("c_custkey").alias("name"), "c_nationkey",
                               F.when(F.col("c_mktsegment") == "BUILDING", K.UNPINNED).otherwise("x").alias("sha"))
    return K.dev_size(corpus, corpus.where("c_nationkey IN (3, 7)"))


@query("deadline", """
SELECT event_type, count(*) AS n FROM events WHERE floor(value * 30 / 60) < 25 GROUP BY 1""")
def deadline(t: Tables) -> DataFrame:
    launched = t.events.withColumn("elapsed_s", F.col("value") * 30)
    return K.within_deadline(launched, 25).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("json_defaults", """
SELECT event_type, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS k_sum,
  count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS n_missing FROM events GROUP BY 1""")
def json_defaults(t: Tables) -> DataFrame:
    """Fields of a JSON record with defaults for what is absent."""
    r = F.from_json("props", "k bigint, missing string")
    return t.events.select("event_type", r.alias("r")).groupBy("event_type").agg(
        F.sum(F.coalesce("r.k", F.lit(0))).alias("k_sum"), F.count_if(F.col("r.missing").isNull()).alias("n_missing"))


@query("field_diff", """
WITH r AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
o AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority,
    arg_max(o_totalprice > 250000, (o_orderdate, o_orderkey)) AS large, month(max(o_orderdate)) AS month, arg_max(floor(o_totalprice), (o_orderdate, o_orderkey)) AS price
  FROM r WHERE early GROUP BY 1),
n AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority,
    arg_max(o_totalprice > 250000, (o_orderdate, o_orderkey)) AS large, month(max(o_orderdate)) AS month, arg_max(floor(o_totalprice), (o_orderdate, o_orderkey)) AS price
  FROM r WHERE NOT early GROUP BY 1),
d AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, list_filter([CASE WHEN o.large IS DISTINCT FROM n.large THEN 'large' END,
    CASE WHEN o.month IS DISTINCT FROM n.month THEN 'month' END, CASE WHEN o.price IS DISTINCT FROM n.price THEN 'price' END,
    CASE WHEN o.priority IS DISTINCT FROM n.priority THEN 'priority' END, CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END], lambda x: x IS NOT NULL) AS names
  FROM o FULL JOIN n ON o.o_custkey = n.o_custkey)
SELECT o_custkey, len(names)::INT AS n_changed, array_to_string(names[1:4], ',') AS shown, greatest(len(names) - 4, 0)::INT AS more FROM d""")
def field_diff(t: Tables) -> DataFrame:
    """Last order of each customer before and after a date, compared field by field."""
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    when = F.struct("o_orderdate", "o_orderkey")

    def last(df: DataFrame) -> DataFrame:
        return df.groupBy("o_custkey").agg(
            F.max_by("o_orderstatus", when).alias("status"), F.max_by("o_orderpriority", when).alias("priority"),
            F.max_by(F.col("o_totalprice") > 250000, when).alias("large"), F.month(F.max("o_orderdate")).alias("month"),
            F.max_by(F.floor("o_totalprice"), when).alias("price"))

    out = diff.diff_summary(last(t.orders.where(early)), last(t.orders.where(~early)), ["o_custkey"])
    return out.withColumn("shown", F.array_join("shown", ","))


@query("stratified_sample", """
WITH c AS (SELECT DISTINCT lang AS language, coalesce(quality, -1) AS stratum, documents.doc_id AS repo FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum, language ORDER BY ('0x' || substr(md5('7:' || repo), 1, 8))::BIGINT, repo) AS i FROM c)
SELECT stratum, language, repo FROM r WHERE i <= 20""")
def stratified_sample(t: Tables) -> DataFrame:
    """20 documents per (quality, language) cell in seeded hash order."""
    c = t.documents.join(t.labels, "doc_id", "left").select(
        F.coalesce("quality", F.lit(-1)).alias("stratum"), F.col("lang").alias("language"), F.col("doc_id").alias("repo"))
    return K.sample_strata(c, n_total=240, n_cells=12, seed=7)


@query("target_match", r"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS target FROM pages),
k AS (SELECT DISTINCT split_part(target, '/', 1) AS module FROM u WHERE contains(target, '.com') UNION SELECT 'm' UNION SELECT 'blog'
  UNION SELECT DISTINCT regexp_extract(target, '([a-z]+/[0-9]+)$', 1) FROM u WHERE regexp_matches(target, 'org/.*[a-z]+/[0-9]+$'))
SELECT page_id, target, module FROM u, k WHERE module <> '' AND (target = module OR starts_with(target, module || '.') OR starts_with(target, module || '/')
  OR starts_with(target, module || '::') OR ends_with(target, '/' || module))""")
def target_match(t: Tables) -> DataFrame:
    """Urls against a table of hosts, host prefixes and path endings."""
    u = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("target"))
    hosts = u.where(F.col("target").contains(".com")).select(F.split("target", "/")[0].alias("module"))
    fixed = u.select(F.explode(F.array(F.lit("m"), F.lit("blog"))).alias("module"))
    ends = u.where(F.col("target").rlike("org/.*[a-z]+/[0-9]+$")).select(F.regexp_extract("target", "([a-z]+/[0-9]+)$", 1).alias("module"))
    table = hosts.unionByName(fixed).unionByName(ends).where(F.col("module") != "").distinct()
    return resolve.match_targets(u, table, "target", "module").select("page_id", "target", "module").distinct()


@query("failure_codes", """
SELECT CASE WHEN value > 60 THEN 'F8' WHEN value > 30 THEN 'F4' ELSE 'F1' END AS code,
  CASE WHEN value > 60 THEN 'budget' WHEN value > 30 THEN 'over-split' ELSE 'unassigned' END AS failure, count(*) AS n
FROM events WHERE (CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1 ELSE 3 END) BETWEEN 1 AND 3 GROUP BY ALL""")
def failure_codes(t: Tables) -> DataFrame:
    v, e = F.col("value"), F.col("event_type")
    seen = t.events.select(
        F.when(v > 60, "F8").when(v > 30, "F4").otherwise("F1").alias("code"),
        F.when(e == "view", 0).when(e == "click", 1).otherwise(3).alias("severity"))
    return K.failure_observations(t.spark, seen).groupBy("code", "failure").agg(F.count(F.lit(1)).alias("n"))


@query("checkout_lookup", """
SELECT o_custkey::VARCHAR AS repo, o_orderpriority AS sha, o_orderstatus AS label, o_orderkey::VARCHAR AS rep,
  CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 100000 THEN concat_ws('-', o_custkey, '5-LOW', o_orderkey)
    WHEN c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT' THEN o_custkey::VARCHAR
    WHEN c_acctbal > 0 THEN concat_ws('-', o_custkey, substr(o_orderpriority, 1, 7), 'rescore') END AS folder,
  NOT (o_orderpriority = '5-LOW' AND o_totalprice > 100000 OR c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT') AS needs_clone
FROM orders JOIN customer ON o_custkey = c_custkey""")
def checkout_lookup(t: Tables) -> DataFrame:
    """Orders as runs: an own folder, else the customer's folder, else a fresh clone."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    runs = o.select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderpriority").alias("sha"),
                    F.col("o_orderstatus").alias("label"), F.col("o_orderkey").cast("string").alias("rep"))
    own = o.where("o_orderpriority = '5-LOW' AND o_totalprice > 100000").select(
        F.concat_ws("-", "o_custkey", "o_orderpriority", "o_orderkey").alias("folder"), F.col("o_orderpriority").alias("head"))
    shared = t.customer.where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("folder"), F.lit("1-URGENT").alias("head"))
    corpus = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("name"), F.col("c_custkey").cast("string").alias("repo"), F.lit("x").alias("sha"))
    return K.find_checkout(runs, own.unionByName(shared), corpus)


@query("unit_scan_counts", """
SELECT count(*) AS runs_seen, count(*) FILTER (n > 0) AS runs_with_units FROM (
  SELECT c_custkey, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def unit_scan_counts(t: Tables) -> DataFrame:
    """Customers as runs, urgent orders as units; a run without units is seen, not used."""
    units = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.array(F.count(F.lit(1))).alias("units"))
    return R.unit_scan_counts(t.customer.join(units, F.col("c_custkey") == F.col("o_custkey"), "left"))
