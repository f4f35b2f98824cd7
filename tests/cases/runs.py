"""Small tables for the rules of ``newsignal.plans.runs``, each with its SQL or the results worked out by hand."""

from newsignal.plans import runs as plans

from .tables import fixture, on

HISTORY = fixture("history", "loop string, run int, quality double, oss double, actionable double, accept double, coherence double, pass_rate double, noise double, confidence double, status string", [
    ("a", 1, 0.50, 0.50, 0.60, 0.10, 0.50, 0.20, 0.50, 0.5, "updated"), ("a", 2, 0.25, 0.52, 0.58, 0.50, None, 0.50, 0.20, 0.9, "skipped"), ("a", 3, 0.20, 0.40, 0.40, 0.90, 0.90, 0.90, 0.05, 0.1, "updated"), ("a", 4, 0.20, 0.45, 0.50, None, 0.20, None, None, 0.5, "skipped"),
    ("a", 5, 0.30, 0.60, 0.70, 0.15, 0.60, 0.10, 0.60, 0.7, "updated"), ("a", 6, 0.60, 0.55, 0.30, 0.15, 0.60, 0.10, 0.60, 0.7, "updated"), ("b", 1, 0.45, 0.30, 0.20, 0.30, 0.40, 0.40, 0.30, 0.5, "updated"), ("b", 2, 0.41, 0.31, 0.22, 0.30, 0.40, 0.40, 0.30, 0.5, "updated"),
])

on(HISTORY, sql="""
WITH RECURSIVE s AS (SELECT loop, run, quality, list(quality) OVER (PARTITION BY loop ORDER BY run ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last FROM history),
c AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list_transform(last, lambda q: 0.4::DOUBLE - q - 0.05::DOUBLE)), lambda a, x: greatest(0, a + x)) AS final,
  list_max(list_transform(range(1, len(last) + 1), lambda n: list_reduce(list_prepend(0.0::DOUBLE, list_transform(last[1:n], lambda q: 0.4::DOUBLE - q - 0.05::DOUBLE)), lambda a, x: greatest(0, a + x)))) AS peak FROM s),
f(loop, run, frozen) AS (SELECT DISTINCT loop, 0, FALSE FROM history UNION ALL SELECT c.loop, c.run, CASE WHEN f.frozen AND c.quality >= 0.45 THEN FALSE WHEN len(c.last) >= 3 AND c.peak > 0.3 THEN TRUE ELSE f.frozen END FROM f JOIN c ON c.loop = f.loop AND c.run = f.run + 1)
SELECT loop, run, frozen FROM f WHERE run > 0""")(plans.adaptation_freeze)

on(HISTORY, sql="""
WITH RECURSIVE e(loop, run, accept_t, coherence_t, reject_t, noise_t) AS (SELECT DISTINCT loop, 0, 0.30::DOUBLE, 0.40::DOUBLE, 0.50::DOUBLE, 0.10::DOUBLE FROM history UNION ALL
 SELECT h.loop, h.run,
  CASE WHEN accept < 0.2 THEN round(al * greatest(0.20, accept_t - 0.02) + (1 - al) * accept_t, 4) WHEN accept > 0.8 THEN round(al * least(0.50, accept_t + 0.02) + (1 - al) * accept_t, 4) ELSE accept_t END,
  CASE WHEN coherence > 0 THEN round(al * greatest(0.30, least(0.65, coherence * 0.85::DOUBLE)) + (1 - al) * coherence_t, 4) ELSE coherence_t END,
  CASE WHEN pass_rate < 0.3 THEN round(al * greatest(0.30, reject_t - 0.03) + (1 - al) * reject_t, 4) WHEN pass_rate > 0.8 THEN round(al * least(0.70, reject_t + 0.03) + (1 - al) * reject_t, 4) ELSE reject_t END,
  CASE WHEN noise > 0.4 THEN round(al * greatest(0.05, noise_t - 0.01) + (1 - al) * noise_t, 4) WHEN noise < 0.1 THEN round(al * least(0.20, noise_t + 0.01) + (1 - al) * noise_t, 4) ELSE noise_t END
 FROM e JOIN (SELECT *, least(0.30::DOUBLE, 0.1::DOUBLE * (0.7::DOUBLE + 0.6::DOUBLE * confidence)) AS al FROM history) h ON h.loop = e.loop AND h.run = e.run + 1)
SELECT * FROM e WHERE run > 0""")(plans.adapted_thresholds)

on(HISTORY, sql="""
WITH g AS (SELECT loop, count(*) AS n, avg(oss) FILTER (WHERE status = 'updated') AS active, avg(oss) FILTER (WHERE status <> 'updated') AS idle FROM history GROUP BY loop)
SELECT loop, round(CASE WHEN n < 3 OR active IS NULL OR idle IS NULL THEN 0.5 ELSE greatest(0, least(1, 0.5 + 5 * (active - idle))) END::DOUBLE, 6) AS health FROM g""")(plans.loop_health)

on(HISTORY, sql="""
WITH b AS (SELECT *, avg(oss) OVER w AS base_oss, avg(actionable) OVER w AS base_act, count(*) OVER w AS n FROM history WINDOW w AS (PARTITION BY loop ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, n >= 2 AND oss < 0.9::DOUBLE * base_oss AND actionable < 0.85::DOUBLE * base_act AS regressed FROM b)
SELECT loop, run, regressed, CASE WHEN regressed THEN max(run) FILTER (WHERE NOT regressed) OVER (PARTITION BY loop ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS rollback_to FROM r""")(plans.regressions)

on(HISTORY, sql="""
SELECT loop, count(*) AS runs, round(avg((status = 'updated')::INT), 4) AS active_rate, round(avg((noise > 0.4)::INT), 4) AS noisy_rate, round(avg(1 - pass_rate), 4) AS rejection_rate, round(max_by(oss, run), 4) AS last_oss, round(quantile_cont(quality, 0.5), 4) AS median_quality FROM history GROUP BY loop""")(plans.learning_status)

ARMS = fixture("source_arms", "arm string, alpha double, beta double, kind string", [("s1", 8.0, 2.0, "source"), ("s2", 3.0, 3.0, "source"), ("s3", 2.0, 8.0, "source"), ("s4", 9.0, 3.0, "source"), ("mid_tech", 20.0, 10.0, "company"), ("large_law", 2.0, 2.0, "company")])

SIGNALS = fixture("signals", "birth double, budget double", [(0.2, 0.4)])

on(ARMS, SIGNALS, sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY alpha / (alpha + beta) DESC, arm) AS r FROM source_arms)
SELECT arm, round(CASE WHEN kind = 'source' AND r <= 3 AND birth < 0.3 THEN alpha + 0.3::DOUBLE * budget WHEN kind = 'company' AND birth > 0.4 AND alpha + beta > 15 THEN 1 + (alpha - 1) * 0.97::DOUBLE ELSE alpha END, 6) AS alpha,
 round(CASE WHEN kind = 'company' AND birth > 0.4 AND alpha + beta > 15 THEN 1 + (beta - 1) * 0.97::DOUBLE ELSE beta END, 6) AS beta FROM k, signals""")(plans.cross_pollination)

on(ARMS, sql="SELECT arm, round(alpha / (alpha + beta), 6) AS mean, CAST(alpha + beta - 2 AS BIGINT) AS observations, row_number() OVER (ORDER BY alpha / (alpha + beta) DESC, arm) AS rank FROM source_arms WHERE kind = 'source' QUALIFY row_number() OVER (ORDER BY alpha / (alpha + beta) DESC, arm) <= 15")(plans.source_ranking)

ROLES = fixture("role_arms", "role string, category string, size string, rewards array<double>", [("VP Finance", "VP", "smb", [1.0, 0.3]), ("CEO", "CEO", "enterprise", [0.0]), ("CISO", "CISO", "mid_market", [1.5, -1.0]), ("Clerk", "Other", "smb", []), ("Director of IT", "Director", "enterprise", [0.5])])

# Priors of roles.
PRIORS = fixture("priors", "category string, a double, b double", [
    ("VP", 3.0, 1.0), ("Director", 3.0, 1.0), ("Head of", 2.5, 1.0), ("Manager", 2.0, 1.5), ("CTO", 2.0, 2.0), ("CFO", 1.5, 2.0), ("CMO", 2.0, 1.5), ("COO", 1.5, 2.0), ("CEO", 1.5, 2.5), ("Founder", 2.5, 1.5), ("CISO", 2.5, 1.0), ("CLO", 2.0, 1.5),
])

on(ROLES, PRIORS, sql="""
WITH p AS (SELECT r.*, coalesce(a, 2.0) AS a, coalesce(b, 2.0) + (CASE WHEN size = 'enterprise' AND r.category IN ('CEO', 'Founder') THEN 2 WHEN size = 'smb' AND r.category IN ('VP', 'Director', 'Head of') THEN 1 ELSE 0 END) AS b FROM role_arms r LEFT JOIN priors USING (category)),
u AS (SELECT role, size, a + coalesce(list_sum(list_transform(rewards, lambda x: CASE WHEN x >= 1 THEN least(x, 1.5) / 1.5 ELSE greatest(x, 0) END)), 0) AS a, b + coalesce(list_sum(list_transform(rewards, lambda x: CASE WHEN x >= 1 THEN 0 ELSE 1 - greatest(x, 0) END)), 0) AS b FROM p)
SELECT role, size, round(a, 4) AS alpha, round(b, 4) AS beta, row_number() OVER (ORDER BY round(a / (a + b), 9) DESC, role) AS rank FROM u""")(plans.contact_arms)

SCORED = fixture("scored", "id int, text string, score double, rejected boolean", [(1, "Acme grows", 0.9, False), (2, "Acme  grows", 0.9, False), (3, "Acme grows", 0.95, False), (4, "Bad one", 0.1, True), (5, "Middling", 0.6, False), (6, "Other bad", 0.05, True), (7, "Third bad", 0.2, True)])

on(SCORED, sql="""
WITH l AS (SELECT id, text, CASE WHEN score >= 0.85 THEN 1 WHEN rejected THEN 0 END AS label FROM scored), d AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY id) AS r FROM l WHERE label IS NOT NULL),
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS n, count(*) FILTER (WHERE label = 1) OVER () AS pos, count(*) FILTER (WHERE label = 0) OVER () AS neg FROM d WHERE r = 1)
SELECT id, label FROM k WHERE n <= 2 * least(pos, neg)""")(plans.auto_labels)

SAVED = fixture("saved", "id int, name string, industry string, sub_industries array<string>, description string, headquarters string, searched timestamp_ntz, profile string", [
    (1, "Acme Corp", "Steel", ["mills"], "", "", "2024-03-09 00:00:00", '{"targets": ["Beta", "Gamma"], "industry": "steel"}'), (2, "ACME CORP", "Steel", [], "Makes steel", "Pune", "2024-03-08 00:00:00", '{"targets": []}'), (3, "Beta", "Banking", ["fintech"], "A bank", "", "2024-02-01 00:00:00", None), (4, "Gamma", "Logistics", ["ports", "steel ports"], "Ships", "", None, "{}"),
])

ASKED = fixture("looked_up", "name string", [("acme corp",), ("Beta",), ("Nobody",), ("gamma",)])

on(ASKED, SAVED, sql="""
WITH k AS (SELECT a.name, s.id, row_number() OVER (PARTITION BY a.name ORDER BY (coalesce(description, '') <> '' OR coalesce(headquarters, '') <> '') DESC, s.id) AS r FROM looked_up a JOIN saved s ON lower(s.name) = lower(a.name) AND searched >= TIMESTAMP '2024-03-03 00:00:00')
SELECT a.name, k.id FROM looked_up a LEFT JOIN k ON k.name = a.name AND r = 1""")(plans.company_lookup)

on(SAVED, sql="SELECT id, round((lower(industry) = 'steel')::INT * 1.0 + (len(list_filter(sub_industries, lambda s: contains(lower(s), 'steel'))) > 0)::INT * 0.5 + contains(lower(coalesce(description, '')), 'steel')::INT * 0.25, 4)::DOUBLE AS score FROM saved WHERE lower(industry) = 'steel' OR len(list_filter(sub_industries, lambda s: contains(lower(s), 'steel'))) > 0 OR contains(lower(coalesce(description, '')), 'steel')")(plans.industry_search)

on(SAVED, sql="SELECT id, CASE id WHEN 1 THEN ['Beta', 'Gamma'] ELSE [] END AS targets, CASE id WHEN 1 THEN 'steel' END AS industry FROM saved")(plans.profile_fields)

MEMORY = fixture("memory_leads", "company string, confidence double, trend string", [("Acme", 0.9, "t1"), ("Beta", 0.4, "t1")])

RECORDED = fixture("recorded_leads", "company string, confidence double, trend string", [("acme", 0.2, "t0"), ("Gamma", 0.7, "t2")])

STORED = fixture("stored_leads", "company string, confidence double, trend string", [("BETA", 0.8, "t3"), ("Delta", 0.3, "t3"), ("gamma", 0.1, "t3"), ("Zeta", 0.6, "t1")])

on(MEMORY, RECORDED, STORED, sql="""
WITH a AS (SELECT *, 0 AS src FROM memory_leads UNION ALL SELECT *, 1 FROM recorded_leads UNION ALL SELECT *, 2 FROM stored_leads), k AS (SELECT *, row_number() OVER (PARTITION BY lower(company) ORDER BY src, company) AS r FROM a)
SELECT company, confidence, row_number() OVER (ORDER BY confidence DESC, company) AS rank FROM k WHERE r = 1 AND confidence >= 0.35 QUALIFY row_number() OVER (ORDER BY confidence DESC, company) BETWEEN 2 AND 3""")(plans.lead_list)

LIVE_RUNS = fixture("live_runs", "run_id string, started timestamp_ntz", [("r3", "2024-03-03 00:00:00"), ("r4", "2024-03-04 00:00:00")])

DB_RUNS = fixture("db_runs", "run_id string, started timestamp_ntz", [("r1", "2024-03-01 00:00:00"), ("r2", "2024-03-02 00:00:00"), ("r3", "2024-02-03 00:00:00")])

on(LIVE_RUNS, DB_RUNS, sql="SELECT run_id, started FROM (SELECT * FROM live_runs UNION ALL SELECT * FROM db_runs WHERE run_id NOT IN (SELECT run_id FROM live_runs)) ORDER BY started DESC LIMIT 3")(plans.run_list)

EXISTING = fixture("existing", "name string, website string, employees string, sources array<string>", [("Acme", "", "50", ["kb"]), ("Beta", "b.com", None, [])])

REGISTRY = fixture("registry", "name string, website string, employees string", [("Acme", "acme.com", "70"), ("Beta", "beta.org", "900")])

SEARCHED = fixture("searched", "name string, website string, employees string", [("Acme", "acme.net", None), ("Beta", None, "1000")])

on(EXISTING, REGISTRY, SEARCHED, sql="""
SELECT e.name, coalesce(nullif(e.website, ''), nullif(r.website, ''), nullif(s.website, '')) AS website, coalesce(nullif(e.employees, ''), nullif(r.employees, ''), nullif(s.employees, '')) AS employees,
 array_to_string(list_sort(list_distinct(list_concat(e.sources, CASE WHEN r.name IS NULL THEN [] ELSE ['registry'] END, CASE WHEN s.name IS NULL THEN [] ELSE ['search'] END))), ',') AS sources FROM existing e LEFT JOIN registry r USING (name) LEFT JOIN searched s USING (name)""")(plans.fill_if_empty)

CANDIDATES = fixture("candidates", "name string, source string, domain string, confidence double", [("Acme", "search", "acme.com", 0.85), ("Acme", "registry", "acme.in", 0.8), ("Beta", "heuristic", "beta.com", 0.6), ("firms in Pune", "search", "x.com", 0.9)])

TO_VALIDATE = fixture("to_validate", "name string", [("Acme",), ("Beta",), ("Gamma Ltd",), ("firms in Pune",)])

on(TO_VALIDATE, CANDIDATES, sql="""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE source WHEN 'search' THEN 1 WHEN 'registry' THEN 2 ELSE 3 END) AS r FROM candidates)
SELECT v.name, CASE WHEN contains(v.name, 'firms') THEN 'rejected' ELSE coalesce(k.source, 'guess') END AS via, CASE WHEN contains(v.name, 'firms') THEN NULL WHEN k.domain IS NOT NULL THEN k.domain ELSE 'gamma.com' END AS domain, CASE WHEN contains(v.name, 'firms') THEN 0 ELSE coalesce(k.confidence, 0.5) END::DOUBLE AS confidence
FROM to_validate v LEFT JOIN k ON k.name = v.name AND r = 1""")(plans.entity_validation)

LEAD_ROWS = fixture("lead_rows", "company string, event_type string, confidence double, trend_id int, trend string", [("Acme", "technology", 0.9, 1, "Chips"), ("acme", "labor", 0.5, 2, "Strike"), ("Beta", "labor", 0.4, None, "Strike"), ("Gamma", "x", 0.3, 9, "Nothing")])

TREND_ROWS = fixture("trend_rows", "trend_id int, title string, oss double", [(1, "Chips", 0.7), (2, "Strike", 0.5)])

IMPACT_ROWS = fixture("impact_rows", "title string, pitch string", [("Chips", "Sell radar"), ("Strike", "Sell calm")])

on(LEAD_ROWS, TREND_ROWS, IMPACT_ROWS, sql="""
SELECT l.company, l.trend, coalesce(a.trend_id, b.trend_id) AS trend_id, coalesce(a.oss, b.oss, 0) AS oss, i.pitch FROM lead_rows l LEFT JOIN trend_rows a ON a.trend_id = l.trend_id LEFT JOIN trend_rows b ON b.title = l.trend LEFT JOIN impact_rows i ON i.title = coalesce(a.title, b.title, l.trend)""")(plans.causal_context)

on(LEAD_ROWS, sql="SELECT md5(lower(company))[1:12] AS id, min_by(company, (-confidence, company)) AS name, count(*) AS leads, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS events, max(confidence) AS confidence FROM lead_rows GROUP BY lower(company)")(plans.lead_companies)

on(LEAD_ROWS, sql="SELECT trend, round(avg(confidence), 4) AS mean_confidence, count(*) AS leads, round(avg((confidence >= 0.5)::INT), 4) AS sure_share FROM lead_rows GROUP BY trend")(plans.lead_confidence)

CAMPAIGN = fixture("campaign", "company string, status string, contacts int, emails int", [("Acme", "done", 3, 2), ("Beta", "done", 0, 0), ("Gamma", "failed", 0, 0), ("Delta", "running", 1, 0)])

on(CAMPAIGN, sql="SELECT count(*) AS companies, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(contacts) AS BIGINT) AS contacts, CAST(sum(emails) AS BIGINT) AS emails, CASE WHEN count(*) FILTER (WHERE status = 'running') > 0 THEN 'running' WHEN count(*) FILTER (WHERE status = 'done') = 0 THEN 'failed' ELSE 'done' END AS status FROM campaign")(plans.campaign_rollup)

HOP_ROWS = fixture("hop_rows", "trend_id int, hop int, companies array<string>", [(1, 1, ["a", "b"]), (1, 2, []), (1, 3, ["c"]), (2, 1, [])])

on(HOP_ROWS, sql="SELECT trend_id, count(*) AS hops, round(avg((len(companies) > 0)::INT), 4) AS kb_hit_rate FROM hop_rows GROUP BY trend_id")(plans.trend_signal)

REPLIES = fixture("replies", "id int, raw string, said_label string, said_summary string, said_score double", [
    (1, "LABEL: Acme opens plant\nSUMMARY: A plant in Pune. It is big.\nSCORE: 0.8", "Acme opens plant", "A plant in Pune. It is big.", 0.8), (2, "label: None\nsummary: n/a", "", "", None), (3, "no form at all", "", "", None), (4, "SUMMARY:  Only this.  \nLABEL: **Beta**", "Beta", "Only this.", None), (5, None, "", "", None),
])

on(REPLIES, sql="SELECT id, said_label AS label, said_summary AS summary, said_score AS score, coalesce(said_score >= 0.6, false) AS passed FROM replies")(plans.reply_fields)

PATTERNS = fixture("patterns", "domain string, pattern string", [("acme.com", "{f}{last}"), ("beta.com", "{first}_{l}")])

PEOPLE = fixture("people", "name string, domain string", [("Ann Lee", "acme.com"), ("Bo van Dyk", "beta.com"), ("Cy Poe", "other.com"), ("Solo", "acme.com")])

on(PEOPLE, PATTERNS, sql="SELECT name, said AS email FROM (VALUES ('Ann Lee', 'alee@acme.com'), ('Bo van Dyk', 'bo_d@beta.com'), ('Cy Poe', 'cy.poe@other.com'), ('Solo', NULL)) AS v(name, said)")(plans.pattern_emails)

LIST_A = fixture("list_a", "pos int, item string", [(1, "VP Sales"), (2, "CFO"), (3, "cfo"), (4, "Head of IT")])

LIST_B = fixture("list_b", "pos int, item string", [(1, "vp sales"), (2, "CTO"), (3, "Founder")])

on(LIST_A, LIST_B, sql="""
WITH a AS (SELECT pos, item, 0 AS src FROM list_a UNION ALL SELECT pos, item, 1 FROM list_b), k AS (SELECT *, row_number() OVER (PARTITION BY lower(item) ORDER BY src, pos) AS r FROM a), o AS (SELECT item, row_number() OVER (ORDER BY regexp_matches(lower(item), '(ceo|cfo|cto|coo|founder|chief)'), src, pos) AS rank FROM k WHERE r = 1)
SELECT item, rank FROM o WHERE rank <= 8""")(plans.ordered_roles)
