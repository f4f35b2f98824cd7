"""Small tables for the rules of ``newsignal.plans.sheets``, each with its SQL or the results worked out by hand."""

from newsignal.plans import sheets as plans

from .tables import fixture, on

SHEETS = fixture("sheets", "run_id string, company string, role string, contact string, email string", [("r1", "Acme", "CFO", "", ""), ("r1", "Beta", "CTO", "Bo", "bo@b.c"), ("r2", "Acme", "CEO", None, None)])

PERSONS = fixture("persons", "id int, run_id string, company string, name string, email string", [(2, "r1", "Acme", "Ann", "ann@a.c"), (1, "r1", "Acme", "Al", None), (3, "r1", "Beta", "Bea", "bea@b.c")])

on(SHEETS, PERSONS, sql="""
WITH p AS (SELECT run_id, company, count(*) AS n, string_agg(name, ',' ORDER BY id) AS people, min_by(name, id) AS first_name, min_by(coalesce(email, ''), id) AS first_email FROM persons GROUP BY run_id, company)
SELECT s.run_id, s.company, coalesce(nullif(s.contact, ''), first_name) AS contact, coalesce(nullif(s.email, ''), nullif(first_email, '')) AS email, coalesce(n, 0) AS people_count, coalesce(people, '') AS people FROM sheets s LEFT JOIN p USING (run_id, company)""")(plans.sheets_with_people)

PITCHES = fixture("pitches", "company string, contact string, body string, pos int", [("Acme", "Ann", "Hello", 1), ("Acme", "Al", "Hi", 2)])

PROFILES = fixture("profiles", "company string, profile string", [("Acme", "steel maker")])

on(SHEETS, PERSONS, PITCHES, PROFILES, sql="""
WITH k AS (SELECT company, min_by(name, (email IS NULL, id)) AS contact FROM persons GROUP BY company), o AS (SELECT company, min_by(body, pos) AS body FROM pitches GROUP BY company), c AS (SELECT DISTINCT company FROM sheets)
SELECT c.company, k.contact, o.body AS outreach, p.profile FROM c LEFT JOIN k USING (company) LEFT JOIN o USING (company) LEFT JOIN profiles p USING (company)""")(plans.result_assembly)

TREND_LIST = fixture("trend_list", "trend_id int, title string, event_type string, keywords array<string>, industries array<string>", [(1, "Steel Tariff", "regulation", ["steel", "tariff", "ports", "mills"], ["Steel", "Ports"]), (2, "Chip round", "funding", [], []), (3, "Odd", "weather", ["rain"], ["Farms"])])

# Mechanisms of event types.
MECHANISMS = fixture("mechanisms", "event_type string, mechanism string", [
    ("funding", "New funding round creates demand for market intelligence and growth strategy"), ("acquisition", "M&A activity creates demand for due diligence and market sizing"), ("regulation", "New regulation creates compliance burden and need for advisory"),
    ("crisis", "Crisis event creates urgent need for risk assessment and crisis response"), ("technology", "Technology shift creates need for competitive analysis and strategy pivot"), ("market", "Market shift creates need for repositioning and competitive intelligence"),
    ("policy", "Policy change creates need for impact assessment and compliance planning"), ("ipo", "IPO activity creates demand for market positioning and valuation analysis"),
])

on(TREND_LIST, MECHANISMS, sql="""
WITH t AS (SELECT t.*, coalesce(mechanism, 'Market event creates demand for consulting intelligence') AS m, CASE WHEN len(keywords) > 0 THEN array_to_string(keywords[1:3], ', ') ELSE 'general' END AS sector, t.event_type IN ('crisis', 'regulation') AS urgent FROM trend_list t LEFT JOIN mechanisms USING (event_type))
SELECT trend_id, 1 AS hop, 'Companies in ' || sector || ' sector' AS segment, CASE WHEN urgent THEN 'pain' ELSE 'opportunity' END AS kind, m AS mechanism, CASE WHEN urgent THEN 2 ELSE 4 END AS weeks, 0.45::DOUBLE AS confidence FROM t
UNION ALL SELECT trend_id, 2, 'Suppliers and service providers to ' || sector || ' companies', 'intelligence', 'Downstream effect: ' || lower(m), 6, 0.40::DOUBLE FROM t""")(plans.template_hops)

on(TREND_LIST, sql="SELECT trend_id, array_to_string(industries[1:4], ',') AS direct, 'Capitalize on ' || title AS chance, 'Expert insights on ' || left(title, 50) || '...' AS pitch, 0.35::DOUBLE AS confidence FROM trend_list")(plans.basic_impact)

ROLE_MAP = fixture("role_map", "kind string, roles array<string>", [("trade", ["CFO", "Head of Trade"]), ("security", ["CISO", "CTO"]), ("default", ["CEO"])])

ROLE_KEYS = fixture("role_keys", "trend_id int, keywords array<string>", [(1, ["International Trade", "Ports"]), (2, ["AI Security", "trade"]), (3, ["rain"]), (4, ["sec"])])

on(ROLE_KEYS, ROLE_MAP, sql="""
WITH k AS (SELECT trend_id, lower(unnest(keywords)) AS k FROM role_keys), h AS (SELECT trend_id, unnest(roles) AS role FROM k JOIN role_map ON kind <> 'default' AND (contains(k, kind) OR contains(kind, k))),
a AS (SELECT * FROM h UNION SELECT r.trend_id, unnest(m.roles) FROM role_keys r, role_map m WHERE m.kind = 'default' AND r.trend_id NOT IN (SELECT trend_id FROM h)), o AS (SELECT trend_id, role, row_number() OVER (PARTITION BY trend_id ORDER BY role) AS n FROM (SELECT DISTINCT * FROM a))
SELECT trend_id, string_agg(role, ',' ORDER BY role) AS roles FROM o WHERE n <= 5 GROUP BY trend_id""")(plans.keyword_roles)

COUNCIL = fixture("council", "id int, first_kinds array<string>, second_kinds array<string>, kinds array<string>", [
    (1, ["a", "b", "c", "d", "e"], ["x"], ["q"]), (2, [], [], ["Mills EVIDENCE: p. 2", "Ports", "Docks (named in text)"]), (3, [], [], ["p", "q", "r"]), (4, [], [], ["only"]), (5, [], [], []),
])

on(COUNCIL, sql="""
WITH m AS (SELECT *, list_filter(kinds, lambda k: regexp_matches(upper(k), 'EVIDENCE:|ARTICLE:|NAMED IN|CITED IN')) AS shown, greatest(1, len(kinds) // 2) AS half FROM council),
s AS (SELECT id, CASE WHEN len(first_kinds) > 0 THEN first_kinds WHEN len(shown) > 0 THEN shown ELSE kinds[1:half] END AS f, CASE WHEN len(first_kinds) > 0 THEN second_kinds WHEN len(shown) > 0 THEN list_concat(second_kinds, list_filter(kinds, lambda k: NOT regexp_matches(upper(k), 'EVIDENCE:|ARTICLE:|NAMED IN|CITED IN'))) ELSE kinds[half + 1:] END AS s FROM m)
SELECT id, array_to_string(f[1:4], '|') AS first_order, array_to_string(s[1:4], '|') AS second_order FROM s""")(plans.council_orders)

QUALITY = fixture("cluster_quality", "run string, cluster_id int, size int, coherence double", [("a", 1, 9, 0.5), ("a", 2, 4, 0.6), ("a", 3, 2, 0.0), ("b", 1, 3, 0.2), ("c", 1, 5, 0.45), ("c", 2, 5, 0.41)])

on(QUALITY, sql="""
WITH g AS (SELECT run, count(*) AS clusters, coalesce(avg(coherence) FILTER (WHERE coherence > 0), 0) AS c, string_agg(CAST(size AS VARCHAR), ',' ORDER BY size DESC) AS sizes FROM cluster_quality GROUP BY run)
SELECT run, clusters, round(c, 3) AS coherence, sizes, CASE WHEN c < 0.4 OR clusters < 3 THEN 'RETRY' ELSE 'PASS' END AS verdict FROM g""")(plans.trend_quality)

SYNONYMS = fixture("synonyms", "query string, words array<string>", [("biotech", ["biopharm", "vaccine", "biosimilar"]), ("steel", [])])

INDUSTRY = fixture("industry_rows", "id int, industry string, subs array<string>, description string, said boolean", [
    (1, "Biotech|Pharma", [], "", True), (2, "Biopharmaceutical", [], "", True), (3, "Specialty Chemicals", [], "Develops biosimilars and vaccines", True), (4, "Specialty Chemicals", [], "Makes vaccines", False), (5, None, [], "", True), (6, "Food", ["agri biotech"], "", True), (7, "Food", [], "", False),
])

on(INDUSTRY, SYNONYMS, sql="SELECT id, said AS relevant FROM industry_rows")(plans.industry_relevance)

BRIEFS = fixture("briefs", "cluster_id int, pos int, title string, summary string", [
    (1, 1, "Acme opens a very large new plant in the west of Pune today", "Acme said the plant will open soon and hire. More."), (1, 2, "Acme hires", "Short."), (1, 3, "Rivals of Acme watch", "Rivals of the company are watching what it does next. And more."), (2, 1, "Beta falls", "Tiny."),
])

on(BRIEFS, sql="""
WITH s AS (SELECT cluster_id, pos, title, trim(string_split(summary, '.')[1]) AS first FROM briefs), w AS (SELECT cluster_id, unnest(list_distinct(regexp_extract_all(title, '[A-Z][a-z]{2,}'))) AS name, pos FROM s),
n AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(pos), name) AS r FROM w GROUP BY cluster_id, name), t AS (SELECT cluster_id, name FROM n WHERE r = 1),
l AS (SELECT s.cluster_id, coalesce(min_by(title, pos) FILTER (WHERE contains(title, name) AND len(string_split(title, ' ')) <= 10), min_by(title, pos)) AS label FROM s JOIN t USING (cluster_id) GROUP BY s.cluster_id),
b AS (SELECT cluster_id, string_agg(first || '.', ' ' ORDER BY pos) AS body FROM s WHERE pos <= 3 AND length(first) > 30 GROUP BY cluster_id)
SELECT cluster_id, array_to_string(string_split(label, ' ')[1:8], ' ') AS label, left(coalesce(body, array_to_string(string_split(label, ' ')[1:8], ' ')), 500) AS summary FROM l LEFT JOIN b USING (cluster_id)""")(plans.rule_labels)

MENTIONED = fixture("mentioned", "id int, title string, summary string, person string, company string, salience double", [
    (1, "Harshil Mathur speaks", "Harshil Mathur, head of Razorpay, spoke. Infosys did not.", "Harshil Mathur", "Razorpay", 0.25), (1, "Harshil Mathur speaks", "Harshil Mathur, head of Razorpay, spoke. Infosys did not.", "Harshil Mathur", "Infosys", 0.25), (2, "Markets rise", "Ann Lee of Acme spoke.", "Ann Lee", "Acme", 0.95), (3, "Ann Lee of Acme", "Ann Lee leads Acme now.", "Ann Lee", "Acme", 0.95),
])

on(MENTIONED, sql="""
SELECT id, company, round(CASE WHEN contains(lower(title), lower(person)) AND len(list_filter(regexp_split_to_array(lower(summary), '[.!?]'), lambda s: contains(s, lower(person)) AND contains(s, lower(company)))) > 0 THEN least(1, salience + 0.12::DOUBLE) ELSE salience END, 4) AS salience FROM mentioned""")(plans.person_boost)

SCOPES = fixture("scopes", "id int, explicit string, profile array<string>, companies array<string>, industries array<string>", [(1, "company", ["p"], ["a"], []), (2, None, ["p"], ["a"], []), (3, None, [], ["a"], ["i"]), (4, None, [], [], ["i"]), (5, "", None, None, None)])

on(SCOPES, sql="SELECT id, CASE WHEN coalesce(explicit, '') <> '' THEN explicit WHEN len(coalesce(profile, [])) > 0 THEN 'profile' WHEN len(coalesce(companies, [])) > 0 THEN 'company' WHEN len(coalesce(industries, [])) > 0 THEN 'industry' ELSE 'report' END AS mode FROM scopes")(plans.scope_mode)

EXPANSIONS = fixture("expansions", "id int, raw string", [(1, "1. steel tariff news\n2) port strikes\n- x\nchip act subsidies\n\n5. a fifth line here\n6. a sixth line here"), (2, ""), (3, None)])

on(EXPANSIONS, sql="SELECT id, said AS queries FROM (VALUES (1, 'steel tariff news|port strikes|chip act subsidies|a fifth line here'), (2, ''), (3, '')) AS v(id, said)")(plans.query_expansion)

PREDICTIONS = fixture("predictions", "id int, name string, predicted string, kind string, score double, own string", [
    (1, "Nvidia", "nvidia", "ORG", 0.9, "GPE"), (2, "Nvidia Corp", "Nvidia", "ORG", 0.5, "ORG"), (3, "H100 chip", "h100 chip", "PRODUCT", 0.8, "ORG"), (4, "Galaxy", "Galaxy", "PRODUCT", 0.7, "ORG"), (5, "Acme", "Beta", "ORG", 0.9, "PERSON"), (6, "Zed", "Zed", "PERSON", 0.2, "ORG"),
])

on(PREDICTIONS, sql="""
WITH m AS (SELECT *, lower(name) = lower(predicted) OR contains(lower(name), lower(predicted)) OR contains(lower(predicted), lower(name)) AS hit FROM predictions)
SELECT id, hit AND score >= 0.30 AS kept, CASE WHEN hit AND score >= 0.30 AND NOT (own = 'ORG' AND kind = 'PRODUCT' AND NOT regexp_matches(name, '[0-9]')) THEN kind ELSE own END AS kind FROM m""")(plans.type_correction)
