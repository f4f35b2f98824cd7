"""Queries of articles, entities, clusters and news lists on small tables with their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import business as B
from ..functions import text as T
from ..operators import dedup, rank, search
from ..sources.tables import ARTICLES_SQL, articles, table
from .catalog import query


def article_projection(t: DataFrame) -> DataFrame:
    """Blank titles, sources and dates of raw articles from what else is known."""
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return t.select("id", blank("title", F.col("url")).alias("title"), blank("source", T.domain(F.col("url"))).alias("source"), F.coalesce("published", "fetched").alias("published_at"))


def feed_scan(t: DataFrame) -> DataFrame:
    """The first three entries of each feed that aren't older than a day; entries without a date pass."""
    return rank.top_per_key(t, "source", [F.col("pos")], 3).filter("published is null or published >= timestamp '2024-03-01'").select("id")


def entry_projection(t: DataFrame) -> DataFrame:
    """Titles without their source, the source, the key of near-duplicate titles, and plain summaries (the title where there is none)."""
    title = F.regexp_replace("title", r"^(.*) - .*$", "$1")
    plain = F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]+>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return t.select("id", title.alias("title"), T.source_of_title(F.col("title")).alias("source"), T.title_key(F.col("title")).alias("title_key"), F.left(F.coalesce(F.nullif(F.trim(plain), F.lit("")), title), F.lit(500)).alias("summary"))


def source_health(t: DataFrame) -> DataFrame:
    """Share of fetches that worked, their time, what came, and the verdict for each source."""
    ok = F.col("status") == 200
    g = t.groupBy("source").agg(F.count("*").alias("fetches"), F.count_if(ok).alias("ok"), F.avg(F.when(ok, F.col("seconds"))).alias("seconds"), F.sum("entries").alias("entries"), F.max_by("status", "fetched_at").alias("last_status"))
    health = F.when(F.col("ok") == 0, "down").when(F.col("entries") == 0, "empty").when(F.col("ok") < F.col("fetches"), "unsteady").otherwise("healthy")
    return g.select("source", "fetches", F.round(F.col("ok") / F.col("fetches"), 4).alias("ok_share"), F.round("seconds", 4).alias("seconds"), "entries", health.alias("health"), "last_status")


def cache_scan(t: DataFrame) -> DataFrame:
    """The newest entry of each key that is younger than an hour."""
    import datetime

    from ..sources.tables import fresh

    return fresh(t, "key", "stored", datetime.datetime(2024, 3, 10, 10), 3600).select("key", "value")


def date_formats(t: DataFrame) -> DataFrame:
    """Dates in the formats that feeds use; what can't be read gets a given time."""
    return t.select("id", T.any_date(F.col("raw"), "2024-01-01 00:00:00").alias("published"))


# --- filters -------------------------------------------------------------------------------------


def relevance_gate(stories: DataFrame, targets: DataFrame) -> DataFrame:
    """Sure ones by their score; of the rest those whose title names a target as a whole word, all others go."""
    gate = F.when((F.col("score") >= 0.88) & (F.length("summary") >= 30), "keep").when(F.col("score") <= 0.10, "drop").otherwise("ambiguous")
    named = F.broadcast(targets.agg(F.collect_set(F.lower("target")).alias("names")))  # the targets of one request
    j = stories.withColumn("gate", gate).join(named)
    hit = F.exists("names", lambda n: F.regexp_like(F.lower("title"), F.concat(F.lit(r"\b"), n, F.lit(r"\b"))))
    return j.select("id", "gate", ((F.col("gate") == "keep") | ((F.col("gate") == "ambiguous") & hit)).alias("kept"))


def recent_targets(stories: DataFrame, targets: DataFrame, since: str = "2024-03-05 12:00:00") -> DataFrame:
    """Stories that name a target that was named from ``since`` on, or none that went silent; all of them if every target did."""
    x = stories.withColumn("body", F.lower(F.concat_ws(" ", "title", "summary")))
    names = targets.select(F.lower("target").alias("t"))
    recent = x.filter(F.col("published") >= F.lit(since).cast("timestamp_ntz"))
    heard = recent.join(names, F.regexp_like("body", F.concat(F.lit(r"\b"), F.col("t"), F.lit(r"\b")))).select("t").distinct()  # texts against the few targets
    marked = names.join(heard.withColumn("heard", F.lit(True)), "t", "left").agg(F.collect_set(F.when(F.col("heard"), F.col("t"))).alias("left"), F.collect_set(F.when(F.col("heard").isNull(), F.col("t"))).alias("gone"))
    holds = lambda names: F.exists(names, lambda n: F.contains(F.col("body"), n))
    return x.join(F.broadcast(marked)).filter((F.size("gone") == 0) | (F.size("left") == 0) | holds("left") | ~holds("gone")).select("id")


def source_and_byline_filter(entities: DataFrame, papers: DataFrame) -> DataFrame:
    """Entities that are no source's name (as written, or by letters and digits alone) and no byline."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    e = entities.join(papers.select(F.lower("source").alias("s")), F.lower("name") == F.col("s"), "left_anti").join(papers.select(key("source").alias("k")), key("name") == F.col("k"), "left_anti")
    # Words of bylines.
    byline = F.arrays_overlap(F.split(F.lower("name"), " "), F.array(*map(F.lit, ["explainer", "analysis", "opinion", "editorial", "interview", "special report", "deep dive", "insight", "fact check"])))
    return e.filter(~(byline & (F.size(F.split("name", " ")) <= 3))).select("name")


def bad_group_members(entities: DataFrame) -> DataFrame:
    """Articles that go back to the ungrouped ones when groups named by a description, a letter or digits are dissolved."""
    bad = B.is_description(F.col("name")) | (F.length("name") <= 1) | F.col("name").rlike("^[0-9]+$")
    members = entities.select(bad.alias("bad"), F.explode("articles").alias("article"))
    return members.groupBy("article").agg(F.bool_and("bad").alias("free")).filter("free").select("article")


def containment_merge(entities: DataFrame) -> DataFrame:
    """Names that are the end of a longer one (single words only if their articles overlap) take its name; longer ones that begin with a short name take that.

    Names meet by their last and first one or two words, so only those that share them are compared; of several the one with most articles counts.
    """
    words = entities.select("name", "articles", F.split(F.lower("name"), " ").alias("w")).withColumn("size", F.size("w"))
    short = words.filter("size <= 2").select(F.array_join("w", " ").alias("key"), F.col("name").alias("short"), F.col("articles").alias("own"), F.col("size").alias("n"))
    ends = lambda tail: words.select("name", "articles", "size", F.explode(F.array(*[F.array_join(F.slice("w", F.greatest(F.col("size") - (k - 1), F.lit(1)) if tail else 1, k), " ") for k in (1, 2)])).alias("key")).distinct()
    overlap = F.size(F.array_intersect("own", "articles")) / F.least(F.size("own"), F.size("articles"))
    best = lambda name: F.min(F.struct((-F.size(name)).alias("n"), F.col("other").alias("target")))
    suffix = short.join(ends(True), "key").filter((F.col("size") > F.col("n")) & ((F.col("n") > 1) | (overlap >= 0.3))).withColumn("other", F.col("name")).groupBy("short").agg(best("articles").alias("b")).select(F.col("short").alias("name"), F.col("b.target").alias("target"))
    free = short.join(suffix.select(F.col("name").alias("short")), "short", "left_anti")
    prefix = free.join(ends(False).join(suffix.select("name"), "name", "left_anti"), "key").filter(F.col("size") > F.col("n")).withColumn("other", F.col("short")).groupBy("name").agg(best("own").alias("b")).select("name", F.col("b.target").alias("other"))
    return entities.select("name").join(suffix, "name", "left").join(prefix, "name", "left").select("name", F.coalesce("target", "other", "name").alias("canonical"))


def type_vote(votes: DataFrame) -> DataFrame:
    """The type that most of an entity's first twenty articles give it; a product only with a clear majority and no vote for a company."""
    first = rank.top_per_key(votes, "entity", [F.col("article")], 20)
    c = first.groupBy("entity", "kind").agg(F.count("*").alias("n"), F.min("article").alias("first"))
    t = c.groupBy("entity").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"), F.sum("n").alias("total"), F.sum(F.when(F.col("kind") == "ORG", F.col("n")).otherwise(0)).alias("org"), F.sum(F.when(F.col("kind") == "PRODUCT", F.col("n")).otherwise(0)).alias("product"))
    doubt = (F.col("kind") == "PRODUCT") & ((F.col("org") > 0) | (F.col("product") / F.col("total") < 0.7))
    return t.select("entity", F.when(doubt, "ORG").otherwise(F.col("kind")).alias("kind"))


def entity_quality(passed: DataFrame, known: DataFrame) -> DataFrame:
    """What entities have gathered: coherence and number of the clusters that passed, added to what is stored."""
    n = passed.filter("passed").groupBy("entity").agg(F.sum("coherence").alias("more"), F.count("*").alias("k"))
    of = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return n.join(known, "entity", "full").select("entity", of("total", "more").alias("total"), of("clusters", "k").cast("long").alias("clusters"))


def ticker_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names without possessives, titles, verbs, years and modifiers; tickers by their company."""
    return B.normal_names(names, aliases)


# --- similarity and clusters ---------------------------------------------------------------------


@query("WITH " + ARTICLES_SQL + r""", e AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[a-z]{5,}')) AS names FROM articles),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.names, b.names)) AS shared, len(list_distinct(list_concat(a.names, b.names))) AS every FROM e a JOIN e b ON a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id)
SELECT a, b, round(CASE WHEN every > 0 THEN shared / every ELSE 0 END, 6) AS similarity, round(least(1, greatest(0, 1 - CASE WHEN every > 0 THEN shared / every ELSE 0 END)), 6) AS distance FROM p WHERE shared > 0""")
def entity_jaccard(spark, d):
    """Shared over united names of stated articles (ids divisible by 50) with all others that share one, and the distance it makes; names meet through an index."""
    e = articles(spark, d).select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{5,})"), F.lit(1))).alias("names"))
    e = e.withColumn("names", F.transform("names", lambda n: F.xxhash64(n)))
    shared = search.sharing_pairs(e.filter("doc_id % 50 = 0"), e, "doc_id", "names")
    s = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return shared.select("a", "b", F.round(s, 6).alias("similarity"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - s)), 6).alias("distance"))


_CENTERS = "x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), l AS (SELECT label, list(m ORDER BY i) AS center FROM m GROUP BY label)"
#: Weights of the seven checks of a cluster.
CHECKS = {"min_articles": 0.10, "multi_source": 0.15, "coherence": 0.20, "entity_consistency": 0.25, "temporal_proximity": 0.10, "not_duplicate": 0.10, "outlier_ejection": 0.10}


@query("WITH " + ARTICLES_SQL + ", " + _CENTERS + r""",
j AS (SELECT e.label, a.doc_id, lower(a.source_name) AS source, a.published_at, e.embedding::DOUBLE[] AS v, list_distinct(regexp_extract_all(lower(a.title), '[a-z]{4,}')) AS names FROM embeddings e JOIN articles a ON a.doc_id = e.vec_id),
g AS (SELECT label, count(*) AS size, count(DISTINCT source) AS sources, (epoch(max(published_at)) - epoch(min(published_at))) / 3600 AS hours FROM j GROUP BY label),
c AS (SELECT a.label, avg(greatest(list_cosine_similarity(a.v, b.v), 0)) AS coherence FROM j a JOIN j b ON a.label = b.label AND a.doc_id < b.doc_id GROUP BY a.label),
n AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, name) AS r FROM (SELECT label, unnest(names) AS name FROM j) GROUP BY label, name),
t AS (SELECT label, list(name) AS top FROM n WHERE r <= 3 GROUP BY label), y AS (SELECT j.label, avg(list_has_any(names, top)::INT) AS consistency FROM j JOIN t USING (label) GROUP BY j.label),
s AS (SELECT j.label, 1 - list_cosine_similarity(v, center) AS distance FROM j JOIN l USING (label)), o AS (SELECT label, count(*) FILTER (WHERE distance > m + 2 * sd) AS outliers FROM (SELECT *, avg(distance) OVER (PARTITION BY label) AS m, stddev_pop(distance) OVER (PARTITION BY label) AS sd FROM s) GROUP BY label),
d AS (SELECT a.label, greatest(0, max(list_cosine_similarity(a.center, b.center))) AS near FROM l a JOIN l b ON b.label < a.label GROUP BY a.label),
k AS (SELECT g.label, size, sources, least(size / 2, 1) AS s1, least(sources / 2, 1) AS s2, least(coherence / 0.4, 1) AS s3, least(consistency / 0.6, 1) AS s4, greatest(0, 1 - hours / 720) AS s5, CASE WHEN near IS NULL THEN 1 ELSE greatest(0, 1 - near / 0.8) END AS s6, greatest(0, 1 - outliers / size) AS s7, coalesce(near, 0) AS near FROM g JOIN c USING (label) JOIN y USING (label) JOIN o USING (label) LEFT JOIN d USING (label))
SELECT label, size, sources, round(0.1::DOUBLE * s1 + 0.15::DOUBLE * s2 + 0.2::DOUBLE * s3 + 0.25::DOUBLE * s4 + 0.1::DOUBLE * s5 + 0.1::DOUBLE * s6 + 0.1::DOUBLE * s7, 4) AS composite, size >= 2 AND near < 0.8 AND 0.1::DOUBLE * s1 + 0.15::DOUBLE * s2 + 0.2::DOUBLE * s3 + 0.25::DOUBLE * s4 + 0.1::DOUBLE * s5 + 0.1::DOUBLE * s6 + 0.1::DOUBLE * s7 >= 0.5 AS passed FROM k""")
def cluster_validation(spark, d):
    """Seven checks of each cluster of articles, their weighted sum, and the verdict with the vetoes of size and of duplicates of an earlier cluster.

    A cluster counts as earlier by its number; here every earlier one is compared, passed or not.
    """
    from .catalog import centroids

    e = table(spark, d, "embeddings")
    names = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), F.lit(1)))
    j = articles(spark, d).join(e, F.col("doc_id") == F.col("vec_id")).select("label", "doc_id", F.lower("source_name").alias("source"), "published_at", "embedding", names.alias("names"))
    g = j.groupBy("label").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.max("published_at").alias("till"), F.min("published_at").alias("since"))
    c = search.coherence(j, "label", "doc_id", "embedding").select("label", "coherence")
    counts = j.select("label", F.explode("names").alias("name")).groupBy("label", "name").agg(F.count("*").alias("n"))
    top = rank.top_per_key(counts, "label", [F.desc("n"), F.col("name")], 3).groupBy("label").agg(F.collect_set("name").alias("top"))
    y = j.join(F.broadcast(top), "label").groupBy("label").agg(F.avg(F.arrays_overlap("names", "top").cast("int")).alias("consistency"))  # three names a cluster
    centers = centroids(e)
    far = j.join(F.broadcast(centers), "label").select("label", (1 - T.cosine(F.col("embedding"), F.col("center"))).alias("distance"))
    spread = far.groupBy("label").agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("sd"))
    o = far.join(spread, "label").groupBy("label").agg(F.count_if(F.col("distance") > F.col("m") + 2 * F.col("sd")).alias("outliers"))
    a, b = centers.alias("a"), centers.alias("b")
    near = a.join(b, F.col("b.label") < F.col("a.label")).groupBy(F.col("a.label").alias("label")).agg(F.greatest(F.lit(0.0), F.max(T.cosine(F.col("a.center"), F.col("b.center")))).alias("near"))  # clusters of one run
    hours = (F.unix_micros(F.col("till").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 3.6e9
    one, none = F.lit(1.0), F.lit(0.0)
    scores = [
        F.least(F.col("size") / 2, one), F.least(F.col("sources") / 2, one), F.least(F.col("coherence") / 0.4, one), F.least(F.col("consistency") / 0.6, one), F.greatest(none, 1 - hours / 720),
        F.when(F.col("near").isNull(), one).otherwise(F.greatest(none, 1 - F.col("near") / 0.8)), F.greatest(none, 1 - F.col("outliers") / F.col("size")),
    ]
    total = sum((w * s for w, s in zip(CHECKS.values(), scores, strict=True)), none)
    k = g.join(c, "label").join(y, "label").join(o, "label").join(near, "label", "left")
    return k.select("label", "size", "sources", F.round(total, 4).alias("composite"), ((F.col("size") >= 2) & (F.coalesce("near", none) < 0.8) & (total >= 0.5)).alias("passed"))


@query("WITH " + _CENTERS + """, r AS (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], center), 9) DESC, vec_id) AS rank FROM embeddings e JOIN l USING (label))
SELECT label, vec_id, rank FROM r WHERE rank <= 5""")
def representatives(spark, d):
    """The five members of each cluster that are nearest its centre."""
    from .catalog import centroids

    e = table(spark, d, "embeddings")
    sim = e.join(F.broadcast(centroids(e)), "label").select("label", "vec_id", F.round(T.cosine(F.col("embedding"), F.col("center")), 9).alias("sim"))
    return rank.top_per_key(sim, "label", [F.desc("sim"), F.col("vec_id")], 5).select("label", "vec_id", "rank")


def small_cluster_merge(t: DataFrame) -> DataFrame:
    """Clusters of fewer than three members join the large one with the nearest centre, if its cosine is 0.2 or more."""
    s, large = t.filter("size < 3").alias("s"), t.filter("size >= 3").alias("l")
    sim = F.round(T.cosine(F.col("s.center"), F.col("l.center")), 9)
    p = s.join(large, F.lit(True)).select(F.col("s.cluster_id").alias("cluster_id"), F.col("l.cluster_id").alias("target"), sim.alias("sim")).filter("sim >= 0.2")  # clusters of one run
    best = p.groupBy("cluster_id").agg(F.max(F.struct("sim", (-F.col("target")).alias("minus"))).alias("b")).select("cluster_id", (-F.col("b.minus")).alias("target"))
    return t.select("cluster_id").join(best, "cluster_id", "left").select("cluster_id", F.coalesce("target", "cluster_id").alias("merged"))


def zero_pass_override(t: DataFrame) -> DataFrame:
    """A run in which nothing passed is judged again, by coherence against four fifths of its mean (0.10 at least)."""
    r = t.groupBy("run").agg(F.bool_or("passed").alias("any_passed"), F.greatest(F.lit(0.10), 0.8 * F.avg("coherence")).alias("least"))
    return t.join(r, "run").select("cluster_id", "run", F.when(F.col("any_passed"), F.col("passed")).otherwise(F.col("coherence") >= F.col("least")).alias("passed"))


def catalogue_match(products: DataFrame, trends: DataFrame) -> DataFrame:
    """Lines ``name|trigger, trigger|industry`` (or plain words) against trends: the share of triggers that hold a keyword, and the industry."""
    cut = F.split("line", r"\|")
    part = lambda k: F.trim(F.coalesce(F.get(cut, F.lit(k)), F.lit("")))
    triggers = F.when(F.col("line").contains("|"), F.filter(F.transform(F.split(part(1), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")).otherwise(F.split(F.lower("line"), " "))
    p = products.filter("line <> ''").select(part(0).alias("product"), triggers.alias("triggers"), F.lower(part(2)).alias("own"))
    j = trends.join(F.broadcast(p), F.lit(True))  # a catalogue is a short list
    hits = F.size(F.filter("triggers", lambda t: F.exists("keywords", lambda k: F.contains(t, k))))
    score = 0.5 * hits / F.size("triggers") + 0.2 * F.when((F.col("own") != "") & (F.col("own") == F.lower("industry")), 1).otherwise(0)
    return j.select("trend_id", "product", F.round(score, 3).alias("score")).filter("score > 0")


# --- company news --------------------------------------------------------------------------------


def company_news_merge(fresh: DataFrame, other: DataFrame) -> DataFrame:
    """Two lists of news as one: the first list wins, a row goes if its url or its title is known, then noise goes, twenty at most."""
    merged = dedup.merge_lists(fresh, other, [T.url_key(F.col("url")), T.title_key(F.col("title"))], [F.col("id")], 40)
    return merged.filter(B.passes_prefilter(F.col("title"), F.col("url"))).orderBy("id").limit(20).select("id")


def company_relevance(fresh: DataFrame, other: DataFrame) -> DataFrame:
    """How news names the company ``Acme Steel Works``: as a whole, by most of its parts, or not."""
    return fresh.unionByName(other).select("id", B.names_company(F.lower(F.concat_ws(" ", "title", "summary")), "Acme Steel Works").alias("via"))


def company_news_page(held: DataFrame, found: DataFrame, live: DataFrame) -> DataFrame:
    """News of a company: what is stored under its name, by search if that is little and its name is in the title, then live; each url once, newest first."""
    own = held.filter("company = 'acme'")
    few = F.broadcast(own.agg((F.count("*") < 5).alias("few")))
    more = found.filter(F.lower("title").contains("acme")).join(few).filter("few")
    tag = lambda df, k: df.select("id", "title", "url", "seen_at", F.lit(k).alias("src"))
    once = rank.first_of(tag(own, 0).unionByName(tag(more, 1)).unionByName(tag(live, 2)), ["url"], [F.col("src"), F.col("id")])
    return once.select("id", "url", F.row_number().over(Window.orderBy(F.desc("seen_at"), "id")).alias("rank"))  # one company's page


def news_collection(held: DataFrame, found: DataFrame, live: DataFrame) -> DataFrame:
    """Fresh and historical news, each title once, of which only urls that aren't stored are new."""
    every = live.select("id", "title", "url", F.lit(0).alias("src")).unionByName(found.select("id", "title", "url", F.lit(1).alias("src")))
    once = rank.first_of(every, [F.lower("title")], [F.col("src"), F.col("id")])
    return once.join(held.select("url"), "url", "left_anti").select("id", "url")


def repaired_answers(t: DataFrame) -> DataFrame:
    """Fields of the outermost object of a model's answer, with chatter around it or cut off."""
    from ..functions.names import answer

    return t.select("id", answer(F.col("raw"), "a int, b string").alias("x")).select("id", "x.a", "x.b")


def same_companies(t: DataFrame) -> DataFrame:
    """Names of one company: equal, one in the other, or four fifths of the shorter one's words shared."""
    return t.select("a", "b", T.same_company(F.col("a"), F.col("b")).alias("same"))


def keyword_fields(t: DataFrame) -> DataFrame:
    """What stands after the colon within 80 characters of the first keyword that occurs, up to a full stop, 50 characters at most."""
    return t.select("id", B.field_near(F.col("body"), ["headquarters", "based in"]).alias("place"))
