"""Queries of the later stages: page extraction, trends, leads, contacts, stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank
from ..sources.tables import articles, table
from .catalog import daily, query


@query(r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: trim(x)), lambda x: length(x) > 30) AS ps FROM pages)
SELECT page_id, CAST(len(ps) AS INTEGER) AS n_paragraphs, CASE WHEN length(array_to_string(ps, chr(10))) > 100 THEN substring(array_to_string(ps, chr(10)), 1, 5000) END AS body FROM p""")
def html_paragraphs(spark, d):
    """Paragraphs of over 30 characters, joined; null if they are 100 or fewer in all; a body of at most 5000 is the feature."""
    ps = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) > 30)
    out = table(spark, d, "pages").select("page_id", ps.alias("ps")).withColumn("b", F.array_join("ps", "\n"))
    return out.select("page_id", F.size("ps").alias("n_paragraphs"), F.when(F.length("b") > 100, F.left("b", F.lit(5000))).alias("body"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars < 2000 ORDER BY n_chars DESC, doc_id LIMIT 150")
def scrape_candidates(spark, d):
    """Rows that lack content, the most credible first, at most 150."""
    return table(spark, d, "documents").filter("n_chars < 2000").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(150)


@query("""
WITH s AS (SELECT doc_id, (CASE WHEN contains(t, 'trash') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'scum') THEN 1 ELSE 0 END) AS strong, (CASE WHEN contains(t, 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' que ') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' die ') THEN 1 ELSE 0 END) AS weak FROM (SELECT doc_id, lower(text) AS t FROM documents))
SELECT doc_id, CASE WHEN strong >= 1 OR weak >= 2 THEN 'noise' ELSE 'general' END AS kind, CAST(round(least(0.04 * (strong + weak), 0.12), 4) AS DOUBLE) AS boost FROM s""")
def noise_sweep(spark, d):
    """One strong or two weak hits make a text noise; every hit gives a small, capped boost."""
    low = F.lower("text")
    hits = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    s = table(spark, d, "documents").select("doc_id", hits(["trash", "scum"]).alias("strong"), hits(["the ", " que ", " die "]).alias("weak"))
    return s.select("doc_id", F.when((F.col("strong") >= 1) | (F.col("weak") >= 2), "noise").otherwise("general").alias("kind"), F.round(F.least(0.04 * (F.col("strong") + F.col("weak")), F.lit(0.12)), 4).alias("boost"))


@query("""
WITH m AS (SELECT event_type, max(ts) AS last_at FROM events GROUP BY event_type), x AS (SELECT max(ts) AS as_of FROM events)
SELECT m.event_type, m.last_at >= x.as_of - INTERVAL 1 DAY AS present FROM m, x""")
def target_presence(spark, d):
    """Whether each target of the input still has rows in the last day."""
    m = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_at"))
    x = m.agg(F.max("last_at").alias("as_of"))
    return m.join(F.broadcast(x)).select("event_type", F.expr("last_at >= as_of - interval 1 day").alias("present"))


@query("""
WITH s AS (SELECT doc_id, unnest(['tools', 'media', 'energy']) AS spec, unnest([n_chars % 97 / 97, n_chars % 89 / 89, n_chars % 83 / 83]) AS fs, unnest([n_chars % 31 / 31, n_chars % 29 / 29, n_chars % 23 / 23]) AS ss FROM documents),
k AS (SELECT doc_id, spec, greatest(fs, ss) AS score, CASE WHEN fs >= ss OR ss - fs < 0.10 THEN 1 ELSE 2 END AS ord FROM s WHERE NOT (ss >= 0.55 AND fs < 0.15) AND greatest(fs, ss) >= 0.55),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, spec) AS r FROM k) SELECT doc_id, spec, round(score, 6) AS score, ord FROM r WHERE r = 1""")
def industry_label(spark, d):
    """Best of a few specifications by its first- and second-order scores; the scores are a stand-in for a model's."""
    n = F.col("n_chars")
    specs = F.array(*[F.struct(F.lit(s).alias("spec"), (n % a / a).alias("fs"), (n % b / b).alias("ss")) for s, a, b in (("tools", 97, 31), ("media", 89, 29), ("energy", 83, 23))])
    ok = F.filter(specs, lambda s: ~((s["ss"] >= 0.55) & (s["fs"] < 0.15)) & (F.greatest(s["fs"], s["ss"]) >= 0.55))
    best = F.array_min(F.transform(ok, lambda s: F.struct((-F.greatest(s["fs"], s["ss"])).alias("minus"), s["spec"].alias("spec"), F.when((s["fs"] >= s["ss"]) | (s["ss"] - s["fs"] < 0.10), 1).otherwise(2).alias("ord"))))
    return table(spark, d, "documents").select("doc_id", best.alias("b")).filter("b is not null").select("doc_id", "b.spec", F.round(-F.col("b.minus"), 6).alias("score"), "b.ord")


@query("""
WITH $ARTICLES SELECT doc_id, source_name FROM articles WHERE source_name IN ('src1', 'src2') AND published_at >= TIMESTAMP '2024-01-01 01:00:00' AND published_at <= TIMESTAMP '2024-01-05 23:59:59' ORDER BY published_at DESC, doc_id LIMIT 50""")
def news_list(spark, d):
    """The news list: optional filters before the order, newest first."""
    a = articles(spark, d).filter("source_name in ('src1', 'src2') and published_at >= timestamp_ntz'2024-01-01 01:00:00' and published_at <= timestamp_ntz'2024-01-05 23:59:59'")
    return a.orderBy(F.desc("published_at"), "doc_id").limit(50).select("doc_id", "source_name")


@query("""
WITH $ARTICLES, t AS (SELECT doc_id, substring(lower(title), 1, 50) AS k FROM articles), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM t) SELECT doc_id, k AS trend FROM r WHERE r = 1 AND k NOT IN ('', 'none', 'null', 'n/a')""")
def trend_titles(spark, d):
    """Trend titles by their first 50 characters, blank ones left out."""
    t = articles(spark, d).select("doc_id", F.substring(F.lower("title"), 1, 50).alias("trend"))
    return rank.first_of(t.filter(~F.col("trend").isin("", "none", "null", "n/a")), ["trend"], [F.col("doc_id")])


@query("""
WITH k AS (SELECT p_partkey, array_to_string(list_sort(list_slice(string_split(lower(p_name), ' '), 1, 5)), ' ') AS segment FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY p_partkey) AS r FROM k) SELECT p_partkey, segment FROM r WHERE r = 1""")
def segment_dedup(spark, d):
    k = table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.slice(F.split(F.lower("p_name"), " "), 1, 5)), " ").alias("segment"))
    return rank.first_of(k, ["segment"], [F.col("p_partkey")])


@query("SELECT source, count(*) AS n, round(1 - count(DISTINCT lower(text)) / count(*), 6) AS duplicate_rate FROM documents GROUP BY source")
def duplicate_label_rate(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.lower("text")).alias("k"))
    return g.select("source", "n", F.round(1 - F.col("k") / F.col("n"), 6).alias("duplicate_rate"))


@query("""
SELECT source, round(avg(e.label), 4) AS mean_label, count(*) AS members FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY source""")
def source_membership_mean(spark, d):
    """Mean of a cluster value per source, one value for each member."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, d, "documents").select("doc_id", "source").join(e, "doc_id").groupBy("source").agg(F.round(F.avg("label"), 4).alias("mean_label"), F.count("*").alias("members"))


@query("""
WITH $ARTICLES, w AS (SELECT unnest(regexp_extract_all(lower(title), '([a-z]{4,})', 1)) AS word FROM articles) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def top_words(spark, d):
    w = articles(spark, d).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT c_custkey, c_name, coalesce(o_orderkey, -1) AS sheet, round(coalesce(o_totalprice, 0), 2) AS worth, coalesce(n, 0) AS sheets FROM customer LEFT JOIN c ON o_custkey = c_custkey AND r = 1""")
def lead_enrichment(spark, d):
    """Each company with its best call sheet: open ones first, then by worth."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderstatus")
    key = F.struct(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("open"), (-F.col("o_totalprice")).alias("minus"), "o_orderkey")
    best = o.groupBy("c_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), key).alias("b"), F.count("*").alias("n"))  # one pass with partial minima, no window over a hot company
    out = table(spark, d, "customer").select("c_custkey", "c_name").join(best, "c_custkey", "left")
    return out.select("c_custkey", "c_name", F.coalesce("b.o_orderkey", F.lit(-1)).cast("long").alias("sheet"), F.round(F.coalesce("b.o_totalprice", F.lit(0.0)), 2).alias("worth"), F.coalesce("n", F.lit(0)).alias("sheets"))


@query("""
WITH l AS (SELECT l_orderkey, l_suppkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01')
SELECT n_name, r_name, count(*) AS n_lines, CAST(round(sum(CAST(revenue AS DECIMAL(18, 4))), 2) AS DOUBLE) AS revenue FROM l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name""")
def outreach_chain(spark, d):
    """A chain of joins from outreach rows to regions; the date filter and the columns reach the scan."""
    l = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
    j = l.select("l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("revenue").cast("decimal(18,4)")), 2).cast("double").alias("revenue"))  # exact, in any order


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality = 0) AS negative, count(*) FILTER (WHERE quality = 1) >= 25 AND count(*) FILTER (WHERE quality = 0) >= 25 AS ready FROM labels")
def dataset_stats(spark, d):
    pos, neg = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return table(spark, d, "labels").agg(F.count("*").alias("n"), pos.alias("positive"), neg.alias("negative"), ((pos >= 25) & (neg >= 25)).alias("ready"))


@query("""
WITH b AS (SELECT l.doc_id, quality, md5(text) AS h FROM labels l JOIN documents USING (doc_id)), d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM b), u AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM d WHERE r = 1),
m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM u GROUP BY quality)) SELECT doc_id, quality FROM u, m WHERE k <= 2 * least AND k <= 5000""")
def balanced_labels(spark, d):
    """Distinct labelled texts, no class more than twice as large as the other nor than the whole set may be (the first by id stay)."""
    b = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), "doc_id")
    once = rank.first_of(b, ["h"], [F.col("doc_id")])
    least = once.groupBy("quality").count().agg(F.min("count").alias("least"))
    numbered = rank.top_per_key(once, "quality", [F.col("doc_id")], 5000, "k")  # a limit that is pushed before the shuffle
    return numbered.join(F.broadcast(least)).filter("k <= 2 * least").select("doc_id", "quality")


@query("""
SELECT c_custkey, CASE WHEN r <= 2 THEN 'decision_maker' ELSE 'influencer' END AS tier, rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE rank <= 8""")
def tiered_contacts(spark, d):
    """Eight contacts a company: the first two decide, the rest influence."""
    top = rank.top_per_key(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 8)
    return top.select("c_custkey", F.when(F.col("rank") <= 2, "decision_maker").otherwise("influencer").alias("tier"), "rank")


@query("""
WITH p(k, pattern) AS (VALUES (0, '{first}.{last}'), (1, '{f}{last}'), (2, '{first}')) SELECT c_custkey, replace(replace(replace(pattern, '{first}', lower(string_split(c_name, '#')[1])), '{last}', lower(string_split(c_name, '#')[2])), '{f}', lower(substring(c_name, 1, 1))) || '@example.org' AS email FROM customer JOIN p ON k = c_custkey % 3""")
def email_patterns(spark, d):
    """An address from a pattern per domain; the pattern list is an expression."""
    parts = F.split("c_name", "#")
    pattern = F.element_at(F.array(F.lit("{first}.{last}"), F.lit("{f}{last}"), F.lit("{first}")), (F.col("c_custkey") % 3 + 1).cast("int"))
    for name, value in (("{first}", F.lower(parts[0])), ("{last}", F.lower(parts[1])), ("{f}", F.lower(F.substring("c_name", 1, 1)))):
        pattern = F.replace(pattern, F.lit(name), value)
    return table(spark, d, "customer").select("c_custkey", F.concat(pattern, F.lit("@example.org")).alias("email"))


@query("""SELECT page_id, CASE WHEN contains(host, 'blog.') THEN 'blog' WHEN starts_with(host, 'm.') THEN 'mobile' WHEN contains(host, '-') THEN 'promoted' ELSE 'site' END AS bucket FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)""")
def url_buckets(spark, d):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    kind = F.when(host.contains("blog."), "blog").when(host.startswith("m."), "mobile").when(host.contains("-"), "promoted").otherwise("site")
    return table(spark, d, "pages").select("page_id", kind.alias("bucket"))


@query("""
WITH v AS (SELECT c_custkey AS id, c_acctbal AS v, 1 AS version FROM customer UNION ALL SELECT c_custkey, c_acctbal + 10, 2 FROM customer WHERE c_custkey % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM v) SELECT id, round(v, 4) AS v, version FROM r WHERE r = 1""")
def run_upsert(spark, d):
    from ..operators.store import upsert

    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(1).alias("version"))
    new = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 10).alias("v"), F.lit(2).alias("version"))
    return upsert(old, new, "id", "version").withColumn("v", F.round("v", 4))


@query("""
WITH d AS (SELECT event_type, avg(value) / 100 AS health, count(*) AS n FROM events GROUP BY event_type), a AS (SELECT avg(health) AS confidence FROM d) SELECT round(confidence, 6) AS confidence, round(least(greatest(1 - confidence, 0.1), 0.5), 6) AS budget FROM a""")
def bus_signals(spark, d):
    """System confidence as the mean of the loops' health, and the exploration budget it leaves."""
    h = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("health"))
    return h.agg(F.avg("health").alias("c")).select(F.round("c", 6).alias("confidence"), F.round(F.least(F.greatest(1 - F.col("c"), F.lit(0.1)), F.lit(0.5)), 6).alias("budget"))


@query("""
WITH daily AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run, avg(value) / 100 AS reward FROM events GROUP BY event_type, run), b AS (SELECT event_type, CAST(run AS INTEGER) AS run, reward, avg(reward) OVER (PARTITION BY event_type ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base, count(*) OVER (PARTITION BY event_type ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS k FROM daily)
SELECT event_type, run, CASE WHEN k >= 2 AND reward < 0.9 * base THEN 'discard' ELSE 'keep' END AS status, CASE WHEN reward >= 0.45 THEN 'good' WHEN reward >= 0.25 THEN 'known' ELSE 'bad' END AS feedback FROM b""")
def experiment_status(spark, d):
    """Runs that fall by over a tenth of their baseline are discarded; each run gets a feedback label."""
    from ..operators.learning import rolling_baseline

    b = rolling_baseline(daily(spark, d), "event_type", "run", "reward")
    status = F.when(F.col("baseline").isNotNull() & (F.col("reward") < 0.9 * F.col("baseline")), "discard").otherwise("keep")
    return b.select("event_type", "run", status.alias("status"), F.when(F.col("reward") >= 0.45, "good").when(F.col("reward") >= 0.25, "known").otherwise("bad").alias("feedback"))


@query("""
WITH c AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE lang ILIKE '%e%' OR source ILIKE '%1%'), r AS (SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS r FROM c) SELECT doc_id, source, lang FROM r WHERE r = 1 ORDER BY doc_id LIMIT 30""")
def industry_lookup(spark, d):
    """Any of several fields contains the term; distinct by name, thirty at most."""
    c = table(spark, d, "documents").select("doc_id", "source", "lang").filter(F.col("lang").ilike("%e%") | F.col("source").ilike("%1%"))
    return rank.first_of(c.withColumn("k", F.lower("source")), ["k"], [F.col("doc_id")]).drop("k").orderBy("doc_id").limit(30)


@query("""
WITH d AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT d.label, d.vec_id, substring(string_split(text, '.')[1], 1, 200) AS evidence FROM d JOIN documents ON doc_id = vec_id WHERE r <= 3 AND length(string_split(text, '.')[1]) > 20""")
def evidence_chain(spark, d):
    """First sentences of three representatives of each cluster."""
    reps = rank.top_per_key(table(spark, d, "embeddings").select("label", "vec_id"), "label", [F.col("vec_id")], 3)
    s = F.element_at(F.split("text", "[.]"), 1)
    j = reps.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), s.alias("s")), "vec_id").filter(F.length("s") > 20)
    return j.select("label", "vec_id", F.left("s", F.lit(200)).alias("evidence"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'signup'")
def event_props(spark, d):
    """A field of the JSON column, read with a fixed schema."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.select("event_id", F.from_json("props", "k string")["k"].alias("k"))


@query("""
WITH s AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), m AS (SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'medium' ELSE 'low' END AS severity, c_acctbal FROM customer)
SELECT c_custkey, severity, round(least(0.4 * (CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END) + 0.3 * greatest(c_acctbal, 0) / 10000 + 0.15, CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END), 7) AS actionability FROM m""")
def actionability(spark, d):
    """Severity, score and coherence weighed, under the ceiling of the severity."""
    bal = F.col("c_acctbal")
    severity = F.when(bal >= 5000, "high").when(bal >= 0, "medium").otherwise("low")
    level = F.when(bal >= 5000, 1.0).when(bal >= 0, 0.6).otherwise(0.3)
    ceiling = F.when(bal >= 5000, 1.0).when(bal >= 0, 0.7).otherwise(0.4)
    score = F.least(0.4 * level + 0.3 * F.greatest(bal, F.lit(0.0)) / 10000 + 0.15, ceiling)
    return table(spark, d, "customer").select("c_custkey", severity.alias("severity"), F.round(score, 7).alias("actionability"))
