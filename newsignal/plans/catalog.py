"""The library's queries over the base tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import business as B
from ..functions import text as T
from ..operators import dedup, entities, learning, rank, search, store
from ..sources.tables import ARTICLES_SQL, articles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("$ARTICLES", ARTICLES_SQL)
        return f

    return add


# --- sources, caps, exact deduplication ---------------------------------------------------------


@query("""
WITH $ARTICLES, d AS (SELECT *, row_number() OVER (PARTITION BY md5(substring(lower(title), 1, 60)) ORDER BY published_at, doc_id) AS r FROM articles)
SELECT source_name, count(*) AS n_articles, min(published_at) AS first_at, max(published_at) AS last_at, CAST(sum(n_chars) AS BIGINT) AS chars
FROM d WHERE r = 1 GROUP BY source_name ORDER BY n_articles DESC, source_name LIMIT 10""")
def source_summary(spark, d):
    """Articles once for each title prefix, then counts and dates of the ten largest sources."""
    once = rank.first_of(articles(spark, d), [F.md5(F.substring(F.lower("title"), 1, 60))], [F.col("published_at"), F.col("doc_id")])
    out = once.groupBy("source_name").agg(F.count("*").alias("n_articles"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.sum("n_chars").alias("chars"))
    return out.orderBy(F.desc("n_articles"), "source_name").limit(10)


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10")
def source_cap_topn(spark, d):
    return rank.top_per_key(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 10)


@query("""
WITH p AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS posterior FROM events GROUP BY event_type),
e AS (SELECT e.event_id, e.event_type, CASE WHEN posterior > 0.70 THEN 100 WHEN posterior < 0.40 THEN 15 ELSE 50 END AS cap,
  row_number() OVER (PARTITION BY e.event_type ORDER BY e.ts DESC, e.event_id) AS rank FROM events e JOIN p USING (event_type))
SELECT event_id, event_type, cap, rank FROM e WHERE rank <= cap""")
def source_tier_cap(spark, d):
    """Newest entries of each arm, as many as its quality tier allows."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    post = e.groupBy("event_type").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("posterior"))
    capped = e.join(post.withColumn("cap", rank.tier_cap(F.col("posterior"))), "event_type")
    top = rank.top_per_key(capped, "event_type", [F.desc("ts"), F.col("event_id")], max(rank.TIERS))  # the largest cap: a limit that is pushed before the shuffle
    return top.filter("rank <= cap").select("event_id", "event_type", "cap", "rank")


@query("""
WITH s AS (SELECT source, avg(n_chars) AS mean_chars FROM documents GROUP BY source), q AS (SELECT list(mean_chars ORDER BY mean_chars) AS v, count(*) AS n FROM s)
SELECT source, round(mean_chars, 4) AS mean_chars, CASE WHEN n < 4 THEN 20 WHEN mean_chars >= v[1 + (n * 3) // 4] THEN 30 WHEN mean_chars <= v[1 + n // 4] THEN 12 ELSE 20 END AS cap FROM s, q""")
def source_quartile_cap(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"))
    return rank.quartile_caps(s, "mean_chars", 20).withColumn("mean_chars", F.round("mean_chars", 4))


@query("SELECT page_id, replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query("""
WITH l AS (SELECT page_id, url, string_split(regexp_replace(lower(url), '/+$', ''), '#')[1] AS low FROM pages),
q AS (SELECT page_id, url, regexp_replace(string_split(low, '?')[1], '/+$', '') AS head, list_filter(string_split(regexp_extract(low, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|ref|source|campaign|fbclid|gclid)')) AS keep FROM l),
u AS (SELECT page_id, regexp_replace(string_split(url, '?')[1], '/+$', '') AS url_key, CASE WHEN len(keep) > 0 THEN head || '?' || array_to_string(keep, '&') ELSE head END AS canonical FROM q)
SELECT page_id, url_key, canonical, substring(sha256(canonical), 1, 24) AS article_key FROM u""")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.url_key(u).alias("url_key"), T.url_canonical(u).alias("canonical"), T.article_key(u).alias("article_key"))


@query("""
SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(string_split(url, '?')[1], '/+$', '') ORDER BY page_id) AS r FROM pages) WHERE r = 1""")
def exact_url_dedup(spark, d):
    return rank.first_of(table(spark, d, "pages").select("page_id", "url"), [T.url_key(F.col("url"))], [F.col("page_id")])


@query("""WITH $ARTICLES SELECT doc_id, k AS title_hash FROM (SELECT doc_id, md5(substring(lower(title), 1, 60)) AS k, row_number() OVER (PARTITION BY md5(substring(lower(title), 1, 60)) ORDER BY published_at, doc_id) AS r FROM articles) WHERE r = 1""")
def title_hash_dedup(spark, d):
    a = articles(spark, d).select("doc_id", "published_at", F.md5(F.substring(F.lower("title"), 1, 60)).alias("title_hash"))
    return rank.first_of(a, ["title_hash"], [F.col("published_at"), F.col("doc_id")]).drop("published_at")


@query("""
WITH $ARTICLES, p AS (SELECT doc_id, source_name, CASE WHEN source_name < 'src3' THEN 0 ELSE 1 END AS rk FROM articles WHERE lang = 'en')
SELECT doc_id, source_name FROM p WHERE rk = (SELECT min(rk) FROM p)""")
def fallback_scan(spark, d):
    """Rows of the first source that has any."""
    from ..sources.tables import first_nonempty

    a = articles(spark, d).filter("lang = 'en'").select("doc_id", "source_name")
    return first_nonempty([a.filter("source_name < 'src3'"), a.filter("source_name >= 'src3'")])


# --- scalars -------------------------------------------------------------------------------------


@query(r"""
WITH $ARTICLES, t AS (SELECT doc_id, CASE WHEN contains(title, ' - ') THEN lower(array_to_string(list_slice(string_split(title, ' - '), 1, -2), ' - ')) ELSE lower(title) END AS t FROM articles),
u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\([^)]*\)', '', 'g'), '\b20[0-9][0-9]\b', '', 'g'), '\bq[1-4]\b', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g') AS t FROM t)
SELECT doc_id, substring(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 80) AS title_key FROM u""")
def title_normalize(spark, d):
    return articles(spark, d).select("doc_id", T.title_key(F.col("title")).alias("title_key"))


@query(r"""
WITH s AS (SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1, 3), ' ') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 500 THEN substring(s, 1, 497) || '...' ELSE s END AS summary FROM s""")
def extractive_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("""
WITH $ARTICLES SELECT doc_id, md5(title || '. ' || substring(summary, 1, 300)) AS embedding_key,
CASE WHEN length(summary) < 3 OR (length(regexp_replace(summary, '[^\\p{L} ]', '', 'g')) / length(summary) < 0.5 AND length(summary) > 10) THEN '' ELSE substring(summary, 1, 500) END AS clean FROM articles""".replace("\\\\", "\\"))
def clean_summaries(spark, d):
    return articles(spark, d).select("doc_id", F.md5(T.embedding_text(F.col("title"), F.col("summary"))).alias("embedding_key"), T.clean_text(F.col("summary")).alias("clean"))


@query(r"""
WITH $ARTICLES SELECT doc_id, array_to_string(list_slice(list_filter(list_distinct_ordered, lambda p: true), 1, 4), '|') AS phrases FROM (
  SELECT doc_id, list_transform(list_filter(list_transform(range(1, len(f) + 1), lambda i: {'p': f[i], 'first': list_position(f, f[i]) = i}), lambda x: x.first), lambda x: x.p) AS list_distinct_ordered
  FROM (SELECT doc_id, list_filter(regexp_extract_all(title, '([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})', 1), lambda p: length(p) >= 5) AS f FROM articles))""")
def proper_noun_queries(spark, d):
    return articles(spark, d).select("doc_id", F.array_join(T.proper_phrases(F.col("title")), "|").alias("phrases"))


@query("""
SELECT c_custkey, CASE WHEN length(n) >= 2 THEN n || '.com' END AS domain FROM (SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') AS n FROM customer)""")
def company_domain_guess(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.guess_domain(F.col("c_name")).alias("domain"))


@query("""
WITH k(kind, word, weight) AS (VALUES ('growth','the',1),('growth','tion',1),('risk','ing ',2),('risk','er ',1),('deal','que',2),('deal','en ',1)),
s AS (SELECT doc_id, kind, sum(weight) AS score FROM documents, k WHERE contains(lower(text), word) GROUP BY doc_id, kind),
b AS (SELECT doc_id, kind, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind) AS r FROM s)
SELECT d.doc_id, coalesce(b.kind, 'general') AS event_type, CAST(coalesce(b.score, 0) AS BIGINT) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""")
def event_keyword_score(spark, d):
    """The event type whose keywords weigh most; the word list is an expression, so no join is needed."""
    low = F.lower("text")
    kinds = {"growth": [("the", 1), ("tion", 1)], "risk": [("ing ", 2), ("er ", 1)], "deal": [("que", 2), ("en ", 1)]}
    scores = {k: sum((F.when(low.contains(w), n).otherwise(0) for w, n in words), F.lit(0)) for k, words in kinds.items()}
    # Largest score first, then the first kind by name: the least of (-score, kind).
    best = F.array_min(F.array(*[F.struct((-s).alias("minus"), F.lit(k).alias("kind")) for k, s in scores.items()]))
    out = table(spark, d, "documents").select("doc_id", best.alias("b"))
    return out.select("doc_id", F.when(F.col("b.minus") < 0, F.col("b.kind")).otherwise("general").alias("event_type"), (-F.col("b.minus")).cast("long").alias("score"))


@query("""
SELECT c_custkey, round(least(CASE WHEN c_acctbal > 0 THEN 40 ELSE least(0.4 * abs(c_acctbal) / 100, 32) END + CASE WHEN c_mktsegment = 'BUILDING' THEN 20 WHEN c_mktsegment = 'MACHINERY' THEN 15 ELSE 5 END + 10, 100), 2) AS reach,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'decision_maker' WHEN c_mktsegment = 'MACHINERY' THEN 'influencer' ELSE 'gatekeeper' END AS tier FROM customer""")
def reach_score(spark, d):
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    mail = F.when(bal > 0, 40.0).otherwise(F.least(0.4 * F.abs(bal) / 100, F.lit(32.0)))
    tier = F.when(seg == "BUILDING", "decision_maker").when(seg == "MACHINERY", "influencer").otherwise("gatekeeper")
    points = F.when(seg == "BUILDING", 20).when(seg == "MACHINERY", 15).otherwise(5)
    return table(spark, d, "customer").select("c_custkey", F.round(F.least(mail + points + 10, F.lit(100.0)), 2).alias("reach"), tier.alias("tier"))


# --- filters -------------------------------------------------------------------------------------


@query("""
SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 AND d.n_chars >= 30 THEN 'keep' WHEN quality = 0 AND toxic = 1 THEN 'drop' ELSE 'ambiguous' END AS verdict FROM labels l JOIN documents d USING (doc_id)""")
def threshold_gate(spark, d):
    """Three-way gate: sure ones are kept or dropped, the rest goes on to a resolver."""
    score = F.col("quality") - F.col("toxic")
    gate = F.when((score >= 0.88) & (F.col("n_chars") >= 30), "keep").when(score <= -0.10, "drop").otherwise("ambiguous")
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", gate.alias("verdict"))


@query("""
WITH m AS (SELECT max(ts) AS as_of FROM events), t AS (SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e JOIN t USING (user_id), m WHERE t.last_at >= m.as_of - INTERVAL 5 DAY AND e.event_type = 'purchase'""")
def gap4_recent_targets(spark, d):
    """Purchases of users that were seen in the last five days of the data."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    as_of = e.agg(F.max("ts").alias("as_of"))
    recent = e.join(F.broadcast(as_of)).filter("ts >= as_of - interval 5 days").select("user_id").distinct()
    return e.filter("event_type = 'purchase'").join(recent, "user_id", "left_semi").select("event_id", "user_id")


@query("""
WITH $ARTICLES, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title), '([a-z]{4,})', 1)) AS token FROM articles), n AS (SELECT count(*) AS n FROM articles)
SELECT token, count(*) AS df FROM w, n GROUP BY token, n HAVING count(*) <= CAST(floor(0.4 * n) AS BIGINT) AND count(*) >= 2""")
def doc_freq_cap(spark, d):
    a = articles(spark, d)
    words = a.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), F.lit(1)))).alias("token"))
    n = a.agg(F.count("*").alias("n"))
    return words.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).filter("df <= floor(0.4 * n) and df >= 2").select("token", "df")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9]{2,})', 1)) AS token FROM documents)
SELECT token FROM w WHERE token NOT IN (SELECT DISTINCT lower(source) FROM documents)""")
def source_decontam(spark, d):
    """Words of all texts that aren't the name of a source."""
    docs = table(spark, d, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,})"), F.lit(1))).alias("token")).distinct()
    return words.join(docs.select(F.lower("source").alias("token")).distinct(), "token", "left_anti")


@query("""
WITH x AS (SELECT *, count(*) FILTER (WHERE p_retailprice > 100000) OVER () AS good, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT p_partkey, p_retailprice FROM x WHERE (good > 0 AND p_retailprice > 100000) OR (good = 0 AND r <= 3)""")
def impact_gate_fail_open(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rank.fail_open(p, F.col("p_retailprice") > 100000, [F.desc("p_retailprice"), F.col("p_partkey")], 3)


# --- near duplicates -----------------------------------------------------------------------------

_GRAMS = "(SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM (SELECT id, regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}_]{2,}') AS w FROM %s))"
_TFIDF = r"""
n_%(k)s AS (SELECT count(*) AS n FROM %(t)s), tf_%(k)s AS (SELECT id, token, count(*) AS tf FROM """ + _GRAMS.replace("%s", "%(t)s") + r""" GROUP BY id, token),
df_%(k)s AS (SELECT token, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf_%(k)s, n_%(k)s GROUP BY token, n), r_%(k)s AS (SELECT id, token, tf * idf AS w FROM tf_%(k)s JOIN df_%(k)s USING (token)),
s_%(k)s AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r_%(k)s GROUP BY id), v_%(k)s AS (SELECT id, token, w / norm AS w FROM r_%(k)s JOIN s_%(k)s USING (id)),
p_%(k)s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM v_%(k)s a JOIN v_%(k)s b ON a.token = b.token AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= %(least)s)"""
_WORDS = "WITH d AS (SELECT min(doc_id) AS id, text AS body FROM documents GROUP BY text), "


@query(_WORDS + _TFIDF % {"k": "b", "t": "d", "least": 0.7} + " SELECT a, b, round(cosine, 6) AS cosine FROM p_b")
def tfidf_pairs(spark, d):
    """All pairs of different texts with a TF-IDF cosine (words and pairs of words) of 0.7 or more; equal texts stand for one, the first."""
    docs = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))
    return dedup.similar_pairs(docs, "id", F.col("text"), 0.7).withColumn("cosine", F.round("cosine", 6))


# The greedy pass in SQL: a recursive walk in time order, which keeps a row if no kept one is similar.
_GREEDY = """
o_%(k)s AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM %(t)s),
e_%(k)s AS (SELECT b.pos AS pos, list(a.pos) AS earlier FROM p_%(k)s p JOIN o_%(k)s a ON a.id = p.a JOIN o_%(k)s b ON b.id = p.b GROUP BY b.pos),
i_%(k)s AS (SELECT pos, earlier, row_number() OVER (ORDER BY pos) AS step FROM e_%(k)s),
g_%(k)s(step, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i.step, CASE WHEN len(list_filter(i.earlier, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, i.pos) ELSE g.gone END FROM g_%(k)s g JOIN i_%(k)s i ON i.step = g.step + 1),
k_%(k)s AS (SELECT id FROM o_%(k)s WHERE NOT list_contains((SELECT gone FROM g_%(k)s ORDER BY step DESC LIMIT 1), pos))"""


@query("WITH RECURSIVE d AS (SELECT min(doc_id) AS id, substring(text, 1, 80) AS title, min_by(text, doc_id) AS body FROM documents GROUP BY substring(text, 1, 80)), td AS (SELECT id, title AS body FROM d), "
       + _TFIDF % {"k": "t", "t": "td", "least": 0.85} + ", " + _GREEDY % {"k": "t", "t": "td"} + ", bd0 AS (SELECT min(id) AS id, body FROM d JOIN k_t USING (id) GROUP BY body), "
       + _TFIDF % {"k": "b", "t": "bd0", "least": 0.7} + ", " + _GREEDY % {"k": "b", "t": "bd0"} + " SELECT id AS doc_id FROM k_b")
def near_dup_two_pass(spark, d):
    """Articles left by two passes of greedy near-duplicate removal, the earliest winning: titles from 0.85 on, then whole bodies from 0.70 on."""
    a = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"))
    titles = dedup.drop_near_duplicates(a, "doc_id", F.col("title"), 0.85)
    return dedup.drop_near_duplicates(titles, "doc_id", F.col("body"), 0.70).select("doc_id")


# --- entities ------------------------------------------------------------------------------------

_MENTIONS = r"""
$ARTICLES, m AS (SELECT DISTINCT doc_id, title, summary, source_name, unnest(regexp_extract_all(summary, '([A-Z][a-z]{3,})', 1)) AS entity FROM articles),
x AS (SELECT *, title || '. ' || summary AS body, count(*) OVER (PARTITION BY doc_id) AS n_entities FROM m),
s AS (SELECT doc_id, entity, source_name, round(0.40 * (CASE WHEN contains(title, entity) THEN 1 ELSE 0 END) + 0.30 * (1 - (strpos(body, entity) - 1) / length(body))
   + 0.15 * least(ln(1 + (length(body) - length(replace(body, entity, ''))) / length(entity)) / ln(11), 1) + 0.15 / sqrt(n_entities), 4) AS salience FROM x)
"""


def mentions(spark, d) -> DataFrame:
    """(doc_id, entity, source_name, salience) of capitalised words: place, count and company decide how salient one is."""
    a = articles(spark, d)
    found = a.select("doc_id", "title", "source_name", F.concat("title", F.lit(". "), "summary").alias("body"), F.array_distinct(F.regexp_extract_all("summary", F.lit("([A-Z][a-z]{3,})"), F.lit(1))).alias("all"))
    rows = found.select("doc_id", "title", "source_name", "body", F.length("body").alias("chars"), F.size("all").alias("n_entities"), "all")
    m = entities.places(rows, "body", "all").withColumnRenamed("name", "entity")
    salience = (
        0.40 * F.when(F.contains("title", "entity"), 1).otherwise(0) + 0.30 * (1 - (F.col("first") - 1) / F.col("chars"))
        + 0.15 * F.least(F.log(1 + F.col("n").cast("double")) / F.log(F.lit(11.0)), F.lit(1.0)) + 0.15 / F.sqrt("n_entities")
    )
    return m.select("doc_id", "entity", "source_name", F.round(salience, 4).alias("salience"))


@query("WITH" + _MENTIONS + "SELECT doc_id, entity, salience FROM s")
def entity_salience(spark, d):
    return mentions(spark, d).drop("source_name")


@query("WITH" + _MENTIONS + "SELECT lower(entity) AS entity, count(DISTINCT doc_id) AS n_articles, count(DISTINCT source_name) AS n_sources, ((2 * CAST(sum(CAST(salience AS DECIMAL(18, 4))) * 10000 AS BIGINT) + count(*)) // (2 * count(*))) / 10000 AS avg_salience FROM s GROUP BY lower(entity) HAVING count(DISTINCT doc_id) >= 2 AND sum(CAST(salience AS DECIMAL(18, 4))) >= 0.30 * count(*)")
def entity_groups(spark, d):
    g = mentions(spark, d).groupBy(F.lower("entity").alias("entity")).agg(F.count_distinct("doc_id").alias("n_articles"), F.count_distinct("source_name").alias("n_sources"), F.sum(F.col("salience").cast("decimal(18,4)")).alias("total"), F.count("*").alias("n"))
    # Sums of the rounded values are exact, so their order doesn't show.
    return g.filter("n_articles >= 2 and total >= 0.30 * n").select("entity", "n_articles", "n_sources", (F.expr("(2 * cast(total * 10000 as bigint) + n) div (2 * n)") / 10000).alias("avg_salience"))


@query("WITH" + _MENTIONS + ", g AS (SELECT lower(entity) AS entity FROM s GROUP BY lower(entity) HAVING count(DISTINCT doc_id) >= 2 AND sum(CAST(salience AS DECIMAL(18, 4))) >= 0.30 * count(*)) SELECT doc_id FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM s JOIN g ON lower(s.entity) = g.entity)")
def ungrouped_docs(spark, d):
    m = mentions(spark, d)
    g = m.groupBy(F.lower("entity").alias("e")).agg(F.count_distinct("doc_id").alias("n"), F.sum(F.col("salience").cast("decimal(18,4)")).alias("s"), F.count("*").alias("m")).filter("n >= 2 and s >= 0.30 * m")
    grouped = m.join(g, F.lower("entity") == F.col("e")).select("doc_id").distinct()
    return articles(spark, d).select("doc_id").join(grouped, "doc_id", "left_anti")


@query("WITH" + _MENTIONS + ", t AS (SELECT lower(entity) AS canonical, entity, count(*) AS n, row_number() OVER (PARTITION BY lower(entity) ORDER BY count(*) DESC, length(entity), entity) AS r FROM s GROUP BY lower(entity), entity) SELECT canonical, entity AS shown, n FROM t WHERE r = 1")
def canonical_names(spark, d):
    """The most frequent spelling of each name, then the shortest."""
    c = mentions(spark, d).groupBy(F.lower("entity").alias("canonical"), F.col("entity").alias("shown")).agg(F.count("*").alias("n"))
    return rank.first_of(c, ["canonical"], [F.desc("n"), F.length("shown"), F.col("shown")])


# --- similarity ----------------------------------------------------------------------------------

_KNN = """
WITH q AS (SELECT vec_id AS src, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id AS dst, embedding::DOUBLE[] AS b FROM embeddings),
s AS (SELECT src, dst, list_cosine_similarity(a, b) AS sim FROM q JOIN b ON src <> dst),
k AS (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s)
"""


def _queries(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0"), e


@query(_KNN + "SELECT src, dst, round(sim, 6) AS sim, rank FROM k WHERE rank <= 10")
def cosine_topk(spark, d):
    """Ten nearest of every vector for each stated query vector (ids divisible by 50)."""
    q, e = _queries(spark, d)
    return search.neighbours(q, e, "vec_id", "embedding", 10).withColumn("sim", F.round("sim", 6))


@query(_KNN + ", v AS (SELECT src, label, sum(sim) AS total, avg(sim) AS score FROM k JOIN embeddings e ON e.vec_id = k.dst WHERE rank <= 7 GROUP BY src, label), w AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY total DESC, label) AS r FROM v) SELECT src, label, round(score, 6) AS score FROM w WHERE r = 1")
def knn_vote(spark, d):
    q, e = _queries(spark, d)
    return search.vote(search.neighbours(q, e, "vec_id", "embedding", 7), e, "vec_id", "label").withColumn("score", F.round("score", 6))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT x.vec_id AS src, y.vec_id AS dst, list_cosine_similarity(x.v, y.v) AS sim FROM e x JOIN e y ON x.vec_id <> y.vec_id),
k AS (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s)
SELECT x.src, x.dst, round(x.sim, 6) AS sim FROM k x JOIN k y ON x.src = y.dst AND x.dst = y.src WHERE x.rank <= 5 AND y.rank <= 5 AND x.src % 50 = 0 AND x.sim > 0""")
def mutual_knn(spark, d):
    """Mutual five-nearest-neighbour edges of the stated query vectors (ids divisible by 50), both directions against all rows."""
    q, e = _queries(spark, d)
    near = search.neighbours(q, e, "vec_id", "embedding", 5)
    asked = e.join(near.select(F.col("dst").alias("vec_id")).distinct(), "vec_id", "left_semi")
    back = search.neighbours(asked, e, "vec_id", "embedding", 5).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.filter("sim > 0").join(back, ["src", "dst"], "left_semi").select("src", "dst", F.round("sim", 6).alias("sim"))


@query(r"""
WITH stop AS (SELECT unnest(['the','a','an','is','are','was','were','be','been','being','and','or','but','in','on','at','to','for','of','with','by','from','as','into','about','than','this','that','these','those','it','its','has','have','had','will','would','could','should','may','might','can','do','does','did','not','no']) AS token),
w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$'))) AS token FROM documents), f AS (SELECT * FROM w WHERE token NOT IN (SELECT token FROM stop)),
tf AS (SELECT doc_id, token, count(*) AS tf FROM f GROUP BY doc_id, token), dl AS (SELECT doc_id, count(*) AS dl FROM f GROUP BY doc_id),
c AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM documents LEFT JOIN dl USING (doc_id)),
i AS (SELECT token, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY token, n), m AS (SELECT 0.25 * avg(idf) AS low FROM i),
a AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$'))) AS token FROM benchmark) WHERE token NOT IN (SELECT token FROM stop) GROUP BY item_id, token),
s AS (SELECT item_id, tf.doc_id, round(sum(times * (CASE WHEN idf < 0 THEN low ELSE idf END) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM a JOIN i USING (token) JOIN tf USING (token) JOIN dl ON dl.doc_id = tf.doc_id, c, m GROUP BY item_id, tf.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0.1)
SELECT item_id, doc_id, round(score, 4) AS score, rank FROM k WHERE rank <= 5""")
def bm25_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return search.bm25(docs, asked, "doc_id", "item_id", F.col("body"), F.col("question"), 0.1, 5).withColumn("score", F.round("score", 4))


@query("""
WITH $ARTICLES, e AS (SELECT doc_id, source_name, published_at, list_distinct(list_filter(string_split(lower(title || ' ' || substring(summary, 1, 100)), ' '), lambda w: length(w) >= 4)) AS words, embedding::DOUBLE[] AS v
  FROM articles JOIN embeddings ON vec_id = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, greatest(least(list_cosine_similarity(a.v, b.v), 1), 0) AS semantic, len(list_intersect(a.words, b.words)) / greatest(len(list_distinct(list_concat(a.words, b.words))), 1) AS lexical,
  abs(epoch(a.published_at) - epoch(b.published_at)) / 3600 AS h, CASE WHEN a.source_name = b.source_name THEN 0.3 ELSE 1 END AS source FROM e a JOIN e b ON a.doc_id <> b.doc_id AND a.doc_id % 50 = 0)
SELECT a, b, round(greatest(least((0.35 * semantic + 0.05 * lexical + 0.10 * greatest(exp(-h * h / 128), exp(-h * h / 10368)) + 0.15 * source) / 0.65, 1), 0), 6) AS blended FROM p""")
def pair_blend(spark, d):
    """Semantic, lexical, temporal and source signals of stated articles (ids divisible by 50) with all others, blended by weight."""
    a = articles(spark, d).join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    words = T.word_set(F.concat("title", F.lit(" "), F.substring("summary", 1, 100)))
    source = F.when(F.col("source_name").isNotNull(), F.xxhash64("source_name"))
    e = a.select("doc_id", F.col("embedding").alias("v"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"), source.alias("source"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"))
    blend = F.round(F.greatest(F.least("blend", F.lit(1.0)), F.lit(0.0)), 6)
    return search.blended_pairs(e.filter("doc_id % 50 = 0"), e, "doc_id").select("a", "b", blend.alias("blended"))


# --- clusters (embeddings.label as cluster) -------------------------------------------------------

_CENTROID = "x AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i)"


def centroids(e: DataFrame) -> DataFrame:
    """(label, center): element-wise means; only as many rows as labels and dimensions are shuffled."""
    m = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    return m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


@query("WITH " + _CENTROID + " SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS m FROM c")
def cluster_centroid(spark, d):
    return centroids(table(spark, d, "embeddings")).select("label", F.posexplode("center").alias("i", "m")).withColumn("m", F.round("m", 6))


@query("WITH " + _CENTROID + """, l AS (SELECT label, list(m ORDER BY i) AS center FROM c GROUP BY label), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], center) AS sim FROM embeddings JOIN l USING (label)),
w AS (SELECT *, avg(1 - sim) OVER (PARTITION BY label) AS m, stddev_pop(1 - sim) OVER (PARTITION BY label) AS sd FROM s) SELECT vec_id, label, round(1 - sim, 6) AS distance FROM w WHERE 1 - sim > m + 2 * sd""")
def outlier_2sigma(spark, d):
    """Vectors further from their centre than the mean and two population standard deviations."""
    e = table(spark, d, "embeddings")
    dist = e.join(F.broadcast(centroids(e)), "label").select("vec_id", "label", (1 - T.cosine(F.col("embedding"), F.col("center"))).alias("distance"))
    stats = dist.groupBy("label").agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("sd"))  # partial sums instead of a window over a whole cluster
    return dist.join(F.broadcast(stats), "label").filter("distance > m + 2 * sd").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("WITH " + _CENTROID + """, l AS (SELECT label, list(m ORDER BY i) AS center FROM c GROUP BY label), s AS (SELECT vec_id, e.label, l.label AS near, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], center) DESC, l.label) AS r, list_cosine_similarity(embedding::DOUBLE[], center) AS sim FROM embeddings e, l)
SELECT vec_id, near, round(sim, 6) AS sim FROM s WHERE r = 1 AND sim >= 0.45""")
def noise_reassign(spark, d):
    """Each vector to the nearest centre, if that is near enough; centres are few and broadcast."""
    e = table(spark, d, "embeddings")
    c = centroids(e).select(F.col("label").alias("near"), "center").agg(F.collect_list(F.struct("near", "center")).alias("cs"))
    best = F.array_max(F.transform("cs", lambda c: F.struct(T.cosine(F.col("embedding"), c["center"]).alias("sim"), (-c["near"]).alias("minus"))))
    out = e.join(F.broadcast(c)).select("vec_id", best.alias("b"))
    return out.filter("b.sim >= 0.45").select("vec_id", (-F.col("b.minus")).cast("int").alias("near"), F.round("b.sim", 6).alias("sim"))


@query("""
WITH g AS (SELECT label, embedding::DOUBLE[] AS v, vec_id FROM embeddings)
SELECT a.label, round(avg(greatest(list_cosine_similarity(a.v, b.v), 0)), 6) AS coherence, count(*) AS pairs FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def cluster_coherence(spark, d):
    """Mean pairwise cosine, clipped at 0, of whole clusters: sums over cells of two blocks."""
    return search.coherence(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select(F.col("label"), F.round("coherence", 6).alias("coherence"), "pairs")


@query("""
WITH m AS (SELECT label, count(*) AS size, count(DISTINCT source) AS sources, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS quality FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id) GROUP BY label)
SELECT label, size, sources, round(0.4 * (CASE WHEN size >= 3 THEN 1 ELSE 0 END) + 0.3 * least(sources / 5, 1) + 0.3 * quality, 6) AS composite, size >= 3 AND 0.4 * (CASE WHEN size >= 3 THEN 1 ELSE 0 END) + 0.3 * least(sources / 5, 1) + 0.3 * quality >= 0.5 AS passed FROM m""")
def validation_composite(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    j = e.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    m = j.groupBy("label").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("quality"))
    c = 0.4 * F.when(F.col("size") >= 3, 1).otherwise(0) + 0.3 * F.least(F.col("sources") / 5, F.lit(1.0)) + 0.3 * F.col("quality")
    return m.select("label", "size", "sources", F.round(c, 6).alias("composite"), ((F.col("size") >= 3) & (c >= 0.5)).alias("passed"))


# --- aggregates ----------------------------------------------------------------------------------


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def percentile_profile(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    p = rank.exact_percentiles(e, "event_type", "value", [0.1, 0.5, 0.9]).withColumnRenamed("event_type", "_kind")
    g = e.groupBy("event_type").agg(F.stddev_pop("value").alias("sd")).join(p, F.col("event_type").eqNullSafe(F.col("_kind")))
    return g.select("event_type", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p10", "p50", "p90"))], F.round("sd", 6).alias("sd"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM p GROUP BY source""")
def entropy_by_source(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return p.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10)), 6).alias("entropy"))


@query("SELECT user_id, round((epoch(max(ts)) - epoch(min(ts))) / 3600, 4) AS spread_hours, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def temporal_spread(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round((us(F.max("ts")) - us(F.min("ts"))) / 3.6e9, 4).alias("spread_hours"), F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT source, mode_lang AS lang, n FROM (SELECT source, lang AS mode_lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def majority_language(spark, d):
    """The mode, the first by name on a tie."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rank.first_of(c, ["source"], [F.desc("n"), F.col("lang")])


@query("""
SELECT sum(CASE WHEN p AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN p AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT p AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
 round(sum(CASE WHEN p AND quality = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN p THEN 1 ELSE 0 END), 6) AS precision_, round(sum(CASE WHEN p AND quality = 1 THEN 1 ELSE 0 END) / sum(quality), 6) AS recall_
FROM (SELECT quality, n_chars >= 1000 AS p FROM labels JOIN documents USING (doc_id))""")
def confusion_metrics(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") >= 1000).alias("p"))
    tp, good = F.count_if(F.col("p") & (F.col("quality") == 1)), F.sum("quality")
    return x.agg(tp.alias("tp"), F.count_if(F.col("p") & (F.col("quality") == 0)).alias("fp"), F.count_if(~F.col("p") & (F.col("quality") == 1)).alias("fn"), F.round(tp / F.count_if("p"), 6).alias("precision_"), F.round(tp / good, 6).alias("recall_"))


@query("SELECT coalesce(event_type, 'all') AS event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE)) HAVING NOT (event_type IS NULL AND CAST(ts AS DATE) IS NOT NULL)")
def event_rollup(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.col("day").cast("string").alias("day"), "n", "total")


@query("""
SELECT event_type, count(*) FILTER (WHERE value >= 60) AS high, count(*) FILTER (WHERE value >= 40 AND value < 60) AS mid, count(*) FILTER (WHERE value >= 20 AND value < 40) AS low, count(*) FILTER (WHERE value < 20) AS none_ FROM events GROUP BY event_type""")
def lifecycle_histogram(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v >= 60).alias("high"), F.count_if((v >= 40) & (v < 60)).alias("mid"), F.count_if((v >= 20) & (v < 40)).alias("low"), F.count_if(v < 20).alias("none_"))


# --- store ---------------------------------------------------------------------------------------


@query("""
SELECT o.o_orderkey, o.o_custkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_orderkey) AS n_lines
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_custkey""")
def lead_nested_view(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = store.nest(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], "nested")
    shown = F.array_join(F.transform("nested", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return nested.select("o_orderkey", "o_custkey", shown.alias("lines"), F.size("nested").cast("long").alias("n_lines"))


@query("""
WITH o AS (SELECT c_name AS name, c_mktsegment AS industry, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'NEW' END AS industry, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 0)
SELECT coalesce(o.name, n.name) AS name, coalesce(nullif(n.industry, ''), o.industry) AS industry, round(coalesce(n.balance, o.balance), 4) AS balance FROM o FULL JOIN n ON lower(o.name) = lower(n.name)""")
def smart_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("balance"))
    new = c.filter("c_custkey % 2 = 0 or c_custkey % 7 = 0").select(F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("NEW").alias("industry"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal") + 1).alias("balance"))
    return store.smart_merge(old, new, "name", ["industry"], ["balance"]).withColumn("balance", F.round("balance", 4))


@query("""
WITH m AS (SELECT DISTINCT c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000) SELECT name, 'live' AS origin FROM m UNION ALL SELECT c_name, 'stored' FROM customer WHERE lower(c_name) NOT IN (SELECT lower(name) FROM m)""")
def anti_append(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    big = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    live = c.join(big, "c_custkey", "left_semi").select("name").distinct().withColumn("origin", F.lit("live"))
    return store.append_missing(live, c.select("name").withColumn("origin", F.lit("stored")), "name")


@query("""
SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, '') AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def csv_export_view(spark, d):
    """One row a user turn, with its answer or a blank."""
    c = table(spark, d, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(c_mktsegment) LIKE '%build%' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def filtered_page(spark, d):
    """Optional filters, a total order, one page."""
    c = table(spark, d, "customer").filter(F.col("c_mktsegment").ilike("%build%") & (F.col("c_acctbal") >= 0))
    return c.select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


# --- learning ------------------------------------------------------------------------------------

_DAILY = "daily AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run, avg(value) / 100 AS reward, least(count(*), 5)::DOUBLE AS weight FROM events GROUP BY event_type, run), numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY run) AS k FROM daily)"


def daily(spark, d) -> DataFrame:
    """One run a day and arm: mean value as reward, at most five observations as weight."""
    e = table(spark, d, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("run"), "value")
    return e.groupBy("event_type", "run").agg((F.avg("value") / 100).alias("reward"), F.least(F.count("*"), F.lit(5)).cast("double").alias("weight"))


@query("WITH RECURSIVE " + _DAILY + """, f(event_type, k, alpha, beta) AS (SELECT DISTINCT event_type, 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE FROM daily UNION ALL
 SELECT event_type, k, a * least(1, 200 / (a + b)), b * least(1, 200 / (a + b)) FROM (SELECT n.event_type, n.k, greatest(1.5, 1 + (alpha - 1) * 0.97) + reward * weight AS a, greatest(1.5, 1 + (beta - 1) * 0.97) + (1 - reward) * weight AS b FROM f JOIN numbered n ON n.event_type = f.event_type AND n.k = f.k + 1))
SELECT event_type, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(alpha / (alpha + beta), 5) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC) AS r FROM f) WHERE r = 1""")
def bandit_posterior(spark, d):
    h = learning.history(daily(spark, d), "event_type", "run", "reward", "weight")
    p = h.select("event_type", learning.beta_posterior(F.col("runs"), "reward", "weight").alias("p"))
    return p.select("event_type", F.round("p.alpha", 5).alias("alpha"), F.round("p.beta", 5).alias("beta"), F.round(F.col("p.alpha") / (F.col("p.alpha") + F.col("p.beta")), 5).alias("mean"))


@query("WITH RECURSIVE " + _DAILY + """, f(event_type, k, e, c) AS (SELECT DISTINCT event_type, 0::BIGINT, 0.5::DOUBLE, 0.0::DOUBLE FROM daily UNION ALL SELECT n.event_type, n.k, e + 0.1 * (reward - e), greatest(0, c + 0.4 - 0.05 - reward) FROM f JOIN numbered n ON n.event_type = f.event_type AND n.k = f.k + 1)
SELECT event_type, round(e, 6) AS ema, round(c, 6) AS cusum FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC) AS r FROM f) WHERE r = 1""")
def ema_cusum(spark, d):
    h = learning.history(daily(spark, d), "event_type", "run", "reward")
    return h.select("event_type", F.round(learning.ema(F.col("runs"), "reward", 0.1, 0.5), 6).alias("ema"), F.round(learning.cusum_low(F.col("runs"), "reward", 0.4, 0.05), 6).alias("cusum"))


@query("WITH " + _DAILY + " SELECT event_type, CAST(run AS INTEGER) AS run, round(CASE WHEN count(reward) OVER w >= 2 THEN avg(reward) OVER w END, 6) AS baseline FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def rolling_baseline(spark, d):
    return learning.rolling_baseline(daily(spark, d), "event_type", "run", "reward").select("event_type", "run", F.round("baseline", 6).alias("baseline"))


@query("WITH " + _DAILY + ", h AS (SELECT *, k > count(*) OVER (PARTITION BY event_type) // 2 AS late FROM numbered), t AS (SELECT event_type, avg(reward) FILTER (WHERE late) - avg(reward) FILTER (WHERE NOT late) AS delta FROM h GROUP BY event_type) SELECT event_type, round(delta, 6) AS delta, CASE WHEN delta > 0.02 THEN 'improving' WHEN delta < -0.02 THEN 'declining' ELSE 'stable' END AS trend FROM t")
def half_split_trend(spark, d):
    return learning.half_trend(daily(spark, d), "event_type", "run", "reward", 0.02).withColumn("delta", F.round("delta", 6))


@query("WITH " + _DAILY + ", l AS (SELECT *, lag(reward) OVER (PARTITION BY event_type ORDER BY run) AS before FROM daily) SELECT event_type, CAST(run AS INTEGER) AS run, round(reward, 6) AS reward, round(before, 6) AS before FROM l WHERE before > 0 AND reward < 0.8 * before")
def run_drops(spark, d):
    out = learning.drops(daily(spark, d), "event_type", "run", "reward", 0.2)
    return out.select("event_type", "run", F.round("reward", 6).alias("reward"), F.round("before", 6).alias("before"))


# --- matching ------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS triggers, p_brand FROM part), c AS (SELECT o_orderpriority AS segment, list_distinct(list(lower(o_orderstatus))) AS statuses, avg(o_totalprice) AS worth FROM orders GROUP BY o_orderpriority)
SELECT p_partkey, segment, round(0.5 * len(list_filter(triggers, lambda t: length(t) > 4)) / len(triggers) + 0.3 * least(worth / 300000, 1) + 0.2 * len(statuses) / 3, 3) AS score FROM p, c""")
def product_match(spark, d):
    """Every product against every segment; segments are the few values of one column, and broadcast."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("triggers"))
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("segment")).agg(F.collect_set(F.lower("o_orderstatus")).alias("statuses"), F.avg("o_totalprice").alias("worth"))
    score = 0.5 * F.size(F.filter("triggers", lambda t: F.length(t) > 4)) / F.size("triggers") + 0.3 * F.least(F.col("worth") / 300000, F.lit(1.0)) + 0.2 * F.size("statuses") / 3
    return p.join(F.broadcast(c)).select("p_partkey", "segment", F.round(score, 3).alias("score"))
