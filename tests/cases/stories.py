"""Small tables for the rules of ``newsignal.plans.stories``, each with its SQL or the results worked out by hand."""

from newsignal.plans import stories as plans

from .tables import fixture, on

FEED = fixture("feed", "id int, source string, pos int, title string, summary string, url string, published timestamp_ntz, fetched timestamp_ntz", [
    (1, "s1", 1, "Acme opens plant - The Daily - Wire", "<b>Acme</b> opens &amp; grows", "https://www.wire.com/a?utm_source=x", "2024-03-10 08:00:00", "2024-03-10 09:00:00"),
    (2, "s1", 2, "Beta (2024) cuts Q3 jobs, again!", "", "https://wire.com/b", None, "2024-03-09 09:00:00"),
    (3, "s1", 3, "Old story", "old", "https://wire.com/c", "2024-01-01 00:00:00", "2024-03-09 09:00:00"),
    (4, "", 1, "", "No title here", "https://news.site.org/d", "2024-03-09 10:00:00", "2024-03-09 11:00:00"),
    (5, "s2", 1, "Acme's rival — Gamma - Post", None, "https://post.net/e#x", "2024-03-08 10:00:00", "2024-03-09 11:00:00"),
    (6, "s1", 4, "Fourth entry", "x", "https://wire.com/f", "2024-03-10 10:00:00", "2024-03-10 11:00:00"),
])

on(FEED, sql="""
SELECT id, coalesce(nullif(title, ''), url) AS title, coalesce(nullif(source, ''), replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '')) AS source, coalesce(published, fetched) AS published_at FROM feed""")(plans.article_projection)

on(FEED, sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS r FROM feed)
SELECT id FROM k WHERE r <= 3 AND (published IS NULL OR published >= TIMESTAMP '2024-03-01')""")(plans.feed_scan)

on(FEED, sql="""
SELECT id, said_title AS title, said_source AS source, said_key AS title_key, said_summary AS summary FROM (VALUES
 (1, 'Acme opens plant - The Daily', 'Wire', 'acme opens plant the daily', 'Acme opens & grows'), (2, 'Beta (2024) cuts Q3 jobs, again!', '', 'beta cuts jobs again', 'Beta (2024) cuts Q3 jobs, again!'),
 (3, 'Old story', '', 'old story', 'old'), (4, '', '', '', 'No title here'), (5, 'Acme''s rival — Gamma', 'Post', 'acmes rival gamma', 'Acme''s rival — Gamma'), (6, 'Fourth entry', '', 'fourth entry', 'x')) AS v(id, said_title, said_source, said_key, said_summary)""")(plans.entry_projection)

FETCHES = fixture("fetches", "source string, fetched_at timestamp_ntz, status int, seconds double, entries int", [
    ("s1", "2024-03-10 08:00:00", 200, 0.5, 20), ("s1", "2024-03-10 09:00:00", 500, 9.0, 0), ("s2", "2024-03-10 08:00:00", 200, 0.2, 0), ("s2", "2024-03-10 09:00:00", 200, 0.4, 0), ("s3", "2024-03-10 08:00:00", 404, 0.1, 0),
])

on(FETCHES, sql="""
SELECT source, count(*) AS fetches, round(avg((status = 200)::INT), 4) AS ok_share, round(avg(seconds) FILTER (WHERE status = 200), 4) AS seconds, CAST(sum(entries) AS BIGINT) AS entries,
 CASE WHEN count(*) FILTER (WHERE status = 200) = 0 THEN 'down' WHEN sum(entries) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE status = 200) < count(*) THEN 'unsteady' ELSE 'healthy' END AS health, max_by(status, fetched_at) AS last_status FROM fetches GROUP BY source""")(plans.source_health)

CACHE = fixture("cache", "key string, stored timestamp_ntz, value string", [("q1", "2024-03-10 08:00:00", "a"), ("q1", "2024-03-10 09:30:00", "b"), ("q2", "2024-03-10 07:00:00", "c"), ("q3", "2024-03-10 09:00:00", "d")])

on(CACHE, sql="SELECT key, max_by(value, stored) AS value FROM cache WHERE stored > TIMESTAMP '2024-03-10 10:00:00' - INTERVAL 1 HOUR GROUP BY key")(plans.cache_scan)

DATES = fixture("dates", "id int, raw string, said timestamp_ntz", [
    (1, "2024-03-10T08:00:00Z", "2024-03-10 08:00:00"), (2, "Sun, 10 Mar 2024 08:00:00 +0000", "2024-03-10 08:00:00"), (3, "2024-03-10 08:00:00", "2024-03-10 08:00:00"), (4, "2024-03-10", "2024-03-10 00:00:00"), (5, "soon", "2024-01-01 00:00:00"), (6, None, "2024-01-01 00:00:00"), (7, "2024-03-10T10:00:00+02:00", "2024-03-10 08:00:00"),
])

on(DATES, sql="SELECT id, said AS published FROM dates")(plans.date_formats)

STORIES = fixture("stories", "id int, title string, summary string, published timestamp_ntz, score double", [
    (1, "Acme Corp opens plant", "A plant in Pune for more output", "2024-03-10 08:00:00", 0.91), (2, "Beta faces probe", "Beta is under pressure from many sides", "2024-03-01 08:00:00", 0.5), (3, "Bail for a banker", "Nothing on AI here, move along please", "2024-03-09 08:00:00", 0.95), (4, "Weather report", "It rains today in all of the country", "2024-03-10 08:00:00", 0.05),
    (5, "Acme and Beta merge", "The deal is done after many long years", "2024-02-10 08:00:00", 0.9), (6, "Gamma grows", "short", "2024-03-10 08:00:00", 0.9), (7, "Alphabetacism", "A word that holds another word in it", "2024-03-10 08:00:00", 0.3),
])

TARGETS = fixture("targets", "target string", [("Acme",), ("Beta",), ("AI",)])

on(STORIES, TARGETS, sql=r"""
WITH g AS (SELECT id, title, CASE WHEN score >= 0.88 AND length(summary) >= 30 THEN 'keep' WHEN score <= 0.10 THEN 'drop' ELSE 'ambiguous' END AS gate FROM stories)
SELECT id, gate, gate = 'keep' OR (gate = 'ambiguous' AND EXISTS (SELECT 1 FROM targets WHERE regexp_matches(lower(title), '\b' || lower(target) || '\b'))) AS kept FROM g""")(plans.relevance_gate)

on(STORIES, TARGETS, sql=r"""
WITH x AS (SELECT *, lower(title || ' ' || summary) AS body FROM stories),
d AS (SELECT lower(target) AS t, NOT EXISTS (SELECT 1 FROM x WHERE published >= TIMESTAMP '2024-03-05 12:00:00' AND regexp_matches(body, '\b' || lower(target) || '\b')) AS dropped FROM targets)
SELECT id FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE dropped) OR NOT EXISTS (SELECT 1 FROM d WHERE NOT dropped)
 OR EXISTS (SELECT 1 FROM d WHERE NOT dropped AND contains(body, t)) OR NOT EXISTS (SELECT 1 FROM d WHERE dropped AND contains(body, t))""")(plans.recent_targets)

ENTITY_ROWS = fixture("entities", "name string, articles array<long>, kind string, quality int", [
    ("Trump", [1, 2, 3], "ORG", 0), ("Donald Trump", [2, 3, 4, 5], "PERSON", 4), ("Intelligence", [9], "ORG", 0), ("Google Threat Intelligence", [10, 11], "ORG", 0), ("Nvidia", [1, 7], "ORG", 1), ("Nvidia NVDA", [7, 8], "ORG", 0), ("NVIDIA", [12], "GPE", 0),
    ("Special report", [1], "ORG", 0), ("Opinion", [4], "ORG", 0), ("A Deep Analysis Of Trade", [5], "ORG", 0), ("The Daily", [3], "ORG", 0), ("the-daily", [6], "ORG", 0), ("42", [3, 4, 20], "ORG", 0), ("X", [1, 2], "ORG", 0), ("steel companies", [8, 9], "ORG", 0),
])

PAPERS = fixture("papers", "source string", [("The Daily",), ("Wire",)])

on(ENTITY_ROWS, PAPERS, sql="""
SELECT name FROM entities WHERE lower(name) NOT IN (SELECT lower(source) FROM papers) AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN (SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') FROM papers)
 AND NOT (len(string_split(name, ' ')) <= 3 AND list_has_any(string_split(lower(name), ' '), ['explainer', 'analysis', 'opinion', 'editorial', 'interview', 'insight']))""")(plans.source_and_byline_filter)

on(ENTITY_ROWS, sql="""
WITH bad AS (SELECT * FROM entities WHERE contains(lower(name), 'companies') OR length(name) <= 1 OR regexp_matches(name, '^[0-9]+$')), good AS (SELECT * FROM entities WHERE name NOT IN (SELECT name FROM bad)), g AS (SELECT DISTINCT unnest(articles) AS a FROM good)
SELECT DISTINCT b.a AS article FROM (SELECT unnest(articles) AS a FROM bad) b WHERE b.a NOT IN (SELECT a FROM g)""")(plans.bad_group_members)

_PIECES = "words AS (SELECT name, articles, string_split(lower(name), ' ') AS w FROM (SELECT name, articles FROM entities))"

on(ENTITY_ROWS, sql="WITH " + _PIECES + """,
suffix AS (SELECT s.name AS name, min_by(l.name, (-len(l.articles), l.name)) AS target FROM words s JOIN words l ON len(s.w) <= 2 AND len(l.w) > len(s.w) AND list_slice(l.w, len(l.w) - len(s.w) + 1, len(l.w)) = s.w
   AND (len(s.w) > 1 OR len(list_intersect(s.articles, l.articles)) / least(len(s.articles), len(l.articles)) >= 0.3) GROUP BY s.name),
prefix AS (SELECT l.name AS name, min_by(s.name, (-len(s.articles), s.name)) AS target FROM words s JOIN words l ON len(s.w) <= 2 AND len(l.w) > len(s.w) AND list_slice(l.w, 1, len(s.w)) = s.w WHERE s.name NOT IN (SELECT name FROM suffix) AND l.name NOT IN (SELECT name FROM suffix) GROUP BY l.name)
SELECT name, coalesce(suffix.target, prefix.target, name) AS canonical FROM entities LEFT JOIN suffix USING (name) LEFT JOIN prefix USING (name)""")(plans.containment_merge)

VOTES = fixture("votes", "entity string, article long, kind string", [("Nvidia", 1, "ORG"), ("Nvidia", 2, "GPE"), ("Nvidia", 3, "GPE"), ("H100", 1, "PRODUCT"), ("H100", 2, "PRODUCT"), ("H100", 3, "PRODUCT"), ("H100", 4, "GPE"), ("Gemini", 1, "PRODUCT"), ("Gemini", 2, "PRODUCT"), ("Gemini", 3, "ORG"), ("iX", 1, "PRODUCT"), ("iX", 2, "PRODUCT"), ("iX", 3, "GPE"), ("Musk", 1, "PERSON")])

on(VOTES, sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY article) AS r FROM votes), c AS (SELECT entity, kind, count(*) AS n, min(article) AS first FROM k WHERE r <= 20 GROUP BY entity, kind),
t AS (SELECT entity, arg_max(kind, (n, -first)) AS kind, sum(n) AS total, coalesce(sum(n) FILTER (WHERE kind = 'ORG'), 0) AS org, coalesce(sum(n) FILTER (WHERE kind = 'PRODUCT'), 0) AS product FROM c GROUP BY entity)
SELECT entity, CASE WHEN kind = 'PRODUCT' AND (org > 0 OR product / total < 0.7) THEN 'ORG' ELSE kind END AS kind FROM t""")(plans.type_vote)

PASSED = fixture("passed_clusters", "cluster_id int, entity string, coherence double, passed boolean", [(1, "Acme", 0.5, True), (2, "Acme", 0.25, True), (3, "Beta", 0.75, False), (4, "Zeta", 0.5, True)])

KNOWN = fixture("known_quality", "entity string, total double, clusters int", [("Acme", 1.5, 3), ("Beta", 1.0, 2)])

on(PASSED, KNOWN, sql="""
WITH n AS (SELECT entity, sum(coherence) AS more, count(*) AS k FROM passed_clusters WHERE passed GROUP BY entity)
SELECT coalesce(n.entity, o.entity) AS entity, coalesce(total, 0) + coalesce(more, 0) AS total, CAST(coalesce(clusters, 0) + coalesce(k, 0) AS BIGINT) AS clusters FROM n FULL JOIN known_quality o ON n.entity = o.entity""")(plans.entity_quality)

ALIASES = fixture("aliases", "ticker string, company string", [("INFY", "Infosys"), ("TCS", "Tata Consultancy Services")])

RAW_NAMES = fixture("raw_names", "name string", [("Pfizer's",), ("infy",), ("Mogul Musk",), ("Acme Says",), ("TCS 2024",), ("Gates-Backed",)])

on(RAW_NAMES, ALIASES, sql="SELECT name, said AS normal FROM (VALUES ('Pfizer''s', 'Pfizer'), ('infy', 'Infosys'), ('Mogul Musk', 'Musk'), ('Acme Says', 'Acme'), ('TCS 2024', 'Tata Consultancy Services'), ('Gates-Backed', 'Gates')) AS v(name, said)")(plans.ticker_alias)

SMALL = fixture("small_clusters", "cluster_id int, size int, center array<double>", [(1, 9, [1.0, 0.0, 0.0]), (2, 2, [0.9, 0.1, 0.0]), (3, 1, [0.0, 0.0, 1.0]), (4, 7, [0.0, 1.0, 0.0]), (5, 2, [0.1, 0.15, 0.98])])

on(SMALL, sql="""
WITH p AS (SELECT s.cluster_id, l.cluster_id AS target, round(list_cosine_similarity(s.center, l.center), 9) AS sim FROM small_clusters s JOIN small_clusters l ON s.size < 3 AND l.size >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, target) AS r FROM p WHERE sim >= 0.2)
SELECT c.cluster_id, coalesce(k.target, c.cluster_id) AS merged FROM small_clusters c LEFT JOIN k ON k.cluster_id = c.cluster_id AND r = 1""")(plans.small_cluster_merge)

VERDICTS = fixture("verdicts", "cluster_id int, run string, coherence double, composite double, passed boolean", [(1, "a", 0.3, 0.2, False), (2, "a", 0.1, 0.3, False), (3, "b", 0.5, 0.7, True), (4, "b", 0.2, 0.1, False), (5, "c", 0.05, 0.09, False), (6, "c", 0.1, 0.2, False)])

on(VERDICTS, sql="""
WITH r AS (SELECT run, bool_or(passed) AS any_passed, greatest(0.10::DOUBLE, 0.8::DOUBLE * avg(coherence)) AS least FROM verdicts GROUP BY run)
SELECT cluster_id, run, CASE WHEN any_passed THEN passed ELSE coherence >= least END AS passed FROM verdicts JOIN r USING (run)""")(plans.zero_pass_override)

PRODUCTS = fixture("catalogue", "line string", [("Radar|tariff, Supply chain|logistics",), ("plain words here",), ("Vault|breach|",), ("",)])

TRENDS = fixture("trends", "trend_id int, keywords array<string>, industry string", [(1, ["tariff", "port"], "Logistics"), (2, ["breach"], "finance"), (3, ["plain", "supply"], "none")])

on(PRODUCTS, TRENDS, sql="""
WITH p AS (SELECT trim(string_split(line, '|')[1]) AS product, CASE WHEN contains(line, '|') THEN list_filter(list_transform(string_split(string_split(line, '|')[2], ','), lambda x: lower(trim(x))), lambda x: x <> '') ELSE string_split(lower(line), ' ') END AS triggers, lower(trim(coalesce(string_split(line, '|')[3], ''))) AS industry FROM catalogue WHERE line <> ''),
s AS (SELECT trend_id, product, 0.5::DOUBLE * len(list_filter(triggers, lambda t: len(list_filter(t2.keywords, lambda k: contains(t, k))) > 0)) / len(triggers) + 0.2::DOUBLE * (p.industry <> '' AND p.industry = lower(t2.industry))::INT AS score FROM p, trends t2)
SELECT trend_id, product, round(score, 3) AS score FROM s WHERE score > 0""")(plans.catalogue_match)

FRESH_NEWS = fixture("fresh_news", "id int, title string, summary string, url string", [
    (1, "Acme Steel Works opens plant - Wire", "", "https://w.com/1?x=1"), (2, "Acme Steel Works opens plant - Post", "", "https://p.com/9"), (3, "Acme share price jumps again", "", "https://w.com/3"), (4, "Steel output of the whole year", "acme works on steel", "https://w.com/4"), (5, "Acmeville votes in a new mayor", "", "https://w.com/5"),
])

OTHER_NEWS = fixture("other_news", "id int, title string, summary string, url string", [(6, "Plant of Acme Steel Works is open", "", "https://w.com/1"), (7, "Works council of Acme meets today", "", "https://q.com/7"), (8, "A quiet day for all markets here", "", "https://q.com/8")])

on(FRESH_NEWS, OTHER_NEWS, sql="SELECT id FROM (VALUES (1), (4), (5), (7), (8)) AS v(id)")(plans.company_news_merge)

on(FRESH_NEWS, OTHER_NEWS, sql=r"""
WITH n AS (SELECT *, lower(title || ' ' || summary) AS body FROM (SELECT * FROM fresh_news UNION ALL SELECT * FROM other_news))
SELECT id, CASE WHEN regexp_matches(body, '\bacme steel works\b') THEN 'name' WHEN contains(body, 'acme')::INT + contains(body, 'steel')::INT + contains(body, 'works')::INT >= 2 THEN 'parts' ELSE 'none' END AS via FROM n""")(plans.company_relevance)

HELD = fixture("held_news", "id int, company string, title string, url string, seen_at timestamp_ntz", [(1, "acme", "Acme one", "u1", "2024-03-01 00:00:00"), (2, "acme", "Acme two", "u2", "2024-03-02 00:00:00")])

FOUND = fixture("found_news", "id int, title string, url string, seen_at timestamp_ntz, sim double", [(3, "News on Acme again", "u3", "2024-03-04 00:00:00", 0.9), (4, "Of Beta", "u4", "2024-03-05 00:00:00", 0.8), (5, "Acme one", "u1", "2024-03-01 00:00:00", 0.7)])

LIVE = fixture("live_news", "id int, title string, url string, seen_at timestamp_ntz", [(6, "Acme live", "u6", "2024-03-06 00:00:00"), (7, "Acme two", "u2", "2024-03-07 00:00:00")])

on(HELD, FOUND, LIVE, sql="""
WITH a AS (SELECT id, title, url, seen_at, 0 AS src FROM held_news WHERE company = 'acme' UNION ALL SELECT id, title, url, seen_at, 1 FROM found_news WHERE contains(lower(title), 'acme') AND (SELECT count(*) FROM held_news WHERE company = 'acme') < 5 UNION ALL SELECT id, title, url, seen_at, 2 FROM live_news),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, id) AS r FROM a) SELECT id, url, row_number() OVER (ORDER BY seen_at DESC, id) AS rank FROM k WHERE r = 1""")(plans.company_news_page)

on(HELD, FOUND, LIVE, sql="""
WITH n AS (SELECT id, lower(title) AS k, url, 0 AS src FROM live_news UNION ALL SELECT id, lower(title), url, 1 FROM found_news), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, id) AS r FROM n)
SELECT id, url FROM t WHERE r = 1 AND url NOT IN (SELECT url FROM held_news)""")(plans.news_collection)

REPAIRS = fixture("repairs", "id int, raw string, said_a int, said_b string", [
    (1, 'Sure! ```json\n{"a": 1, "b": "x"}\n```', 1, "x"), (2, '{"a": 2, "b": "curly } brace"} and more {"a": 9}', 2, "curly } brace"), (3, '{"a": 3, "b": "cut of', 3, "cut of"), (4, '{"a": 4, "b": "y", "c": [{"d": 1', 4, "y"), (5, "no object", None, None), (6, '{"a": 6, "b": "quote \\" in it"}', 6, 'quote " in it'), (7, '{"a": 7,', 7, None),
])

on(REPAIRS, sql="SELECT id, said_a AS a, said_b AS b FROM repairs")(plans.repaired_answers)

FIRMS = fixture("firms", "a string, b string, said boolean", [("Acme Steel Ltd", "ACME STEEL", True), ("Acme", "Acme Steel Works", True), ("Steel Works of Acme Pune Line", "Acme Steel Works Line Pune", True), ("Acme", "Beta", False), ("Beta Bank", "Beta Motors", False), ("", "Acme", False)])

on(FIRMS, sql="SELECT a, b, said AS same FROM firms")(plans.same_companies)

SNIPPETS = fixture("snippets", "id int, body string, said string", [(1, "Headquarters: Pune, India. Founded 1990", "Pune, India"), (2, "Its headquarters are unknown", ""), (3, "Based in: " + "x" * 90, "x" * 50), (4, None, "")])

on(SNIPPETS, sql="SELECT id, said AS place FROM snippets")(plans.keyword_fields)
