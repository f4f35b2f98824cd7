"""The rules on companies, names, stories, runs and leads, applied to the base tables; each query with SQL that computes the rule itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import business as B
from ..operators import entities, valley
from ..sources.tables import articles, table
from . import business, runs, stories
from . import sheets as sheets_
from .catalog import query


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(words) -> str:
    return "(?:" + "|".join(B._quoted(w) for w in words).replace("'", "''") + ")"


# --- domains, stories, labels --------------------------------------------------------------------

_DOMAIN = r"""
t AS (SELECT page_id, trim(url) AS u FROM pages),
h AS (SELECT page_id, u, regexp_replace(regexp_extract(CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END, '^https?://([^/?#]*)', 1), '^www\.', '') AS host,
  regexp_replace(lower(regexp_extract(u, '((?:[a-zA-Z0-9][-a-zA-Z0-9]*\.)+[a-zA-Z]{2,})', 1)), '^www\.', '') AS looks FROM t),
d AS (SELECT page_id, CASE WHEN (contains(u, '://') OR starts_with(u, 'www.')) AND contains(host, '.') AND length(host) > 3 THEN lower(host) ELSE nullif(regexp_extract(looks, '([^.]+\.[^.]+)$', 1), '') END AS domain FROM h)"""


@query("WITH " + _DOMAIN + rf""" SELECT page_id, domain, coalesce(length(domain) >= 4 AND regexp_matches(domain, '^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{{2,}}$')
  AND NOT regexp_matches(domain, '(^|\.){_any(B.BLACKLISTED_DOMAINS)}$') AND NOT list_contains({_list(B.NO_COMPANY_TLDS)}, string_split(domain, '.')[-1]), FALSE) AS valid FROM d""")
def page_domains(spark, d):
    """Domain of every page, and whether a company can own it."""
    p = table(spark, d, "pages").select("page_id", B.clean_domain(F.col("url")).alias("domain"))
    return p.withColumn("valid", B.valid_domain(F.col("domain")))


@query(rf"""
WITH $ARTICLES SELECT doc_id, url, length(trim(title)) >= 15 AND NOT regexp_matches(trim(title), '{B.NOISE_TITLE}') AND NOT {" AND NOT ".join(f"contains(lower(coalesce(url, '')), '{w}')" for w in B.NOISE_DOMAINS)} AS kept
FROM articles LEFT JOIN pages ON page_id = doc_id""")
def story_prefilter(spark, d):
    """Articles, with the url of the page of their number, that pass the filter on title and host."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    a = articles(spark, d).select("doc_id", "title").join(p, "doc_id", "left")
    return a.select("doc_id", "url", B.passes_prefilter(F.col("title"), F.col("url")).alias("kept"))


def _score(words: list[str]) -> str:
    one = lambda w: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){B._quoted(w)}([^\\p{{L}}\\p{{N}}_]|$)')" if " " not in w and len(w) <= 4 else f"contains(low, '{w}')"
    return " + ".join(f"{2 if ' ' in w else 1} * {one(w)}::INT" for w in words)


_TYPED = f"""l AS (SELECT doc_id, replace(lower(trim(text)), '-', '_') AS low FROM documents),
s AS (SELECT doc_id, low, unnest([{", ".join(f"{{'kind': '{k}', 'place': {n}, 'score': {_score(w)}}}" for n, (k, w) in enumerate(B.EVENT_KEYWORDS.items()))}], recursive := true) FROM l),
b AS (SELECT doc_id, any_value(low) AS low, arg_min(kind, (-score, place)) AS kind, max(score) AS score FROM s GROUP BY doc_id),
typed AS (SELECT doc_id, CASE WHEN list_contains({_list(B.EVENT_KEYWORDS)}, low) THEN low WHEN score > 0 THEN kind ELSE 'general' END AS event_type FROM b)"""


@query("WITH " + _TYPED + " SELECT * FROM typed")
def document_event_types(spark, d):
    """The event type of every whole text, by the keywords of all types."""
    return table(spark, d, "documents").select("doc_id", B.event_type(F.col("text")).alias("event_type"))


@query("WITH " + _TYPED + " SELECT event_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM typed JOIN documents USING (doc_id) GROUP BY event_type")
def event_type_mix(spark, d):
    """How many articles, characters and sources each event type has."""
    t = table(spark, d, "documents").select("source", "n_chars", B.event_type(F.col("text")).alias("event_type"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(substring(text, 1, 40)), '\s+'), lambda x: x <> '') AS ws, substring(text, 1, 40) AS label, length(text) AS n,
  list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS sentences FROM documents)
SELECT doc_id, len(ws) BETWEEN 3 AND 8 AND NOT regexp_matches(label, '<[^>]+>|https?://|\*\*|__|\[.*?\]')
  AND len(list_filter(ws, lambda x: (regexp_matches(x, '^[A-Z]') AND x <> upper(x)) OR (x = upper(x) AND regexp_matches(x, '[A-Z]') AND length(x) > 1))) > 0 AND n >= 20 AND len(sentences) BETWEEN 2 AND 4 AS valid FROM w""")
def story_labels(spark, d):
    """Whether a text's first 40 characters are a label, and the text a summary, as both must be."""
    t = table(spark, d, "documents")
    return t.select("doc_id", B.label_is_valid(F.substring("text", 1, 40), F.col("text")).alias("valid"))


# --- names ---------------------------------------------------------------------------------------

_PHRASE = "([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})"
_NAMED = f"m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHRASE}', 1)) AS name FROM documents), k AS (SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS articles FROM m GROUP BY name HAVING count(DISTINCT doc_id) >= 2)"


def phrases(spark, d):
    """(name, mentions, articles) of capitalised phrases that two texts or more hold."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(1))).alias("name"))
    by_doc = m.groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("name").agg(F.sum("n").alias("mentions"), F.count("*").alias("articles")).filter("articles >= 2")


def _words_sql(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda x: x <> ''))"


def _round_sql(before: str, after: str) -> str:
    """One thing off the end of a name, the first rule that takes something."""
    rules = [(r"\s+-\s+.*$", 2), (r"\s+(?:19|20)\d{2}\s*$", 2), (r"\s+\d(?:\.\d+)?\s*$", 2), (r"\s+[A-Z]{1,3}\s*$", 3), (r"(?i)\s+" + _any(B.HEADLINE_VERBS) + r"\s*$", 2), (r"(?i)-" + _any(B.HYPHEN_MODIFIERS) + r"\s*$", 2)]
    cases = " ".join(f"WHEN {_words_sql('out')} >= {n} AND trim(regexp_replace(out, '{p}', '')) NOT IN (out, '') THEN trim(regexp_replace(out, '{p}', ''))" for p, n in rules)
    return f"{after} AS (SELECT * REPLACE (CASE {cases} ELSE out END AS out) FROM {before})"


_TITLES = "regexp_replace(" * (B.MOST_WORDS - 2) + r"regexp_replace(regexp_replace(n, '(?i)[''’]s(\s|$)', '\1', 'g'), '(?i)^(?:the|a|an)\s+', '')" + rf", '(?i)^{_any(B.LEADING_TITLES)}\s+(\S+\s+\S)', '\1')" * (B.MOST_WORDS - 2)
_CLEAN = _NAMED + rf""",
n AS (SELECT *, trim(regexp_replace(regexp_replace(name, '[\x{{00a0}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM k),
f AS (SELECT *, {_words_sql('n')} AS words, length(regexp_replace(n, '[a-z][A-Z]', '###', 'g')) - length(n) AS turns FROM n),
g AS (SELECT *, list_contains({_list(B.JOB_ABBREVIATIONS)}, lower(n)) OR (words = 1 AND list_contains({_list(B.GENERIC_WORDS)}, lower(n))) OR words > {B.MOST_WORDS} OR (turns >= 1 AND words >= 3) OR (turns >= 2 AND words >= 2)
   OR len(list_filter(string_split(n, ' '), lambda w: length(w) > 8 AND regexp_matches(w, '[A-Z]{{3,}}[a-z]'))) > 0 AS bad FROM f),
r0 AS (SELECT *, trim(regexp_replace(regexp_replace({_TITLES}, '\s*\([^)]*$', ''), '[.,;:!?]+$', '')) AS out FROM g),
{", ".join(_round_sql(f"r{k}", f"r{k + 1}") for k in range(B.MOST_WORDS + 1))},
clean AS (SELECT name, mentions, articles, CASE WHEN bad THEN '' ELSE out END AS clean FROM r{B.MOST_WORDS + 1})"""


@query(("WITH $ARTICLES, " + _CLEAN).replace(_NAMED, "k AS (SELECT doc_id, unnest(regexp_extract_all(title, '([A-Z][a-z]+(?: [A-Za-z]+){0,2})', 1)) AS name FROM articles)").replace("SELECT name, mentions, articles, CASE", "SELECT doc_id, name, CASE") + " SELECT doc_id, name AS raw, clean AS name FROM clean")
def entity_names(spark, d):
    """Capitalised spans of titles as entity names: cleaned, and empty where they are none."""
    m = articles(spark, d).select("doc_id", F.explode(F.regexp_extract_all("title", F.lit("([A-Z][a-z]+(?: [A-Za-z]+){0,2})"), F.lit(1))).alias("raw"))
    return m.select("doc_id", "raw", B.clean_name(F.col("raw")).alias("name"))


@query("WITH " + _CLEAN + " SELECT * FROM clean")
def clean_phrases(spark, d):
    """Capitalised phrases of all texts as entity names: cleaned, and empty where they are none."""
    return phrases(spark, d).select("name", "mentions", "articles", B.clean_name(F.col("name")).alias("clean"))


@query("WITH " + _CLEAN + rf""", v AS (SELECT a.clean AS variant, b.clean AS canonical FROM (SELECT DISTINCT clean FROM clean WHERE contains(clean, ' ')) a JOIN (SELECT DISTINCT clean FROM clean WHERE clean <> '' AND NOT contains(clean, ' ')) b ON string_split(a.clean, ' ')[1] = b.clean),
x AS (SELECT *, list_transform(list_filter(string_split(lower(variant), ' '), lambda t: NOT list_contains(string_split(lower(canonical), ' '), t)), lambda t: regexp_replace(t, '[.,;:!?]+$', '')) AS extra FROM v),
u AS (SELECT *, list_filter(extra, lambda t: NOT list_contains({_list([*B.ORG_SUFFIXES, *B.BRAND_MODIFIERS])}, t)) AS unknown FROM x)
SELECT variant, canonical, len(string_split(variant, ' ')) <= len(list_distinct(string_split(lower(canonical), ' '))) OR (NOT list_has_any(unknown, {_list([*B.HEADLINE_VERBS, *B.GENERIC_WORDS])}) AND len(unknown) < 2) AS valid FROM u""")
def phrase_variants(spark, d):
    """Longer names that begin with a one-word name, and whether they are forms of it."""
    c = phrases(spark, d).select(B.clean_name(F.col("name")).alias("clean")).filter("clean <> ''").distinct()
    longer = c.filter(F.contains("clean", F.lit(" "))).select(F.col("clean").alias("variant"), F.split_part("clean", F.lit(" "), F.lit(1)).alias("canonical"))
    single = c.filter(~F.contains("clean", F.lit(" "))).select(F.col("clean").alias("canonical"))
    return longer.join(single, "canonical").select("variant", "canonical", B.valid_variant(F.col("variant"), F.col("canonical")).alias("valid"))


@query("""
WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS w FROM documents),
names AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part UNION SELECT w FROM p GROUP BY w HAVING count(*) * 50 >= (SELECT count(*) FROM documents))
SELECT doc_id, name, (length(text) - length(replace(text, name, ''))) // length(name) AS n, strpos(text, name) AS first FROM documents JOIN names ON name <> '' AND contains(text, name)""")
def supplementary_entities(spark, d):
    """All occurrences of customers, parts and capitalised words of a fiftieth of all texts, by an automaton over whole texts."""
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))).alias("name"))
    often = words.groupBy("name").agg(F.count_distinct("doc_id").alias("n")).join(F.broadcast(docs.agg(F.count("*").alias("every")))).filter("n * 50 >= every").select("name")
    names = often.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"))).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return entities.find_names(docs.select("doc_id", "text"), names, "doc_id", F.col("text"))


# --- gates on stories ----------------------------------------------------------------------------

#: Names on the watch list: the most frequent capitalised words of titles.
WATCHED = 5
_STORIES = f"""$ARTICLES, m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(title, '[A-Z][a-z]{{3,}}')) AS w FROM articles), targets AS (SELECT w AS target FROM m GROUP BY w ORDER BY count(*) DESC, w LIMIT {WATCHED}),
stories AS (SELECT a.doc_id AS id, title, coalesce(summary, '') AS summary, published_at AS published, CASE WHEN quality = 1 AND toxic = 0 THEN 0.95 WHEN quality = 0 THEN 0.05 ELSE 0.5 END AS score FROM articles a LEFT JOIN labels l ON l.doc_id = a.doc_id)"""
_NAMES = "regexp_matches(%s, '(^|[^\\p{L}\\p{N}_])' || lower(target) || '([^\\p{L}\\p{N}_]|$)')"


def _stories(spark, d):
    a = articles(spark, d)
    words = a.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))).alias("target"))
    targets = words.groupBy("target").agg(F.count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "target").limit(WATCHED).select("target")
    score = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.95).when(F.col("quality") == 0, 0.05).otherwise(0.5)
    s = a.join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "title", F.coalesce("summary", F.lit("")).alias("summary"), F.col("published_at").alias("published"), score.alias("score"))
    return s, targets


@query("WITH " + _STORIES + """, g AS (SELECT id, title, CASE WHEN score >= 0.88 AND length(summary) >= 30 THEN 'keep' WHEN score <= 0.10 THEN 'drop' ELSE 'ambiguous' END AS gate FROM stories)
SELECT id, gate, gate = 'keep' OR (gate = 'ambiguous' AND EXISTS (SELECT 1 FROM targets WHERE """ + _NAMES % "lower(title)" + ")) AS kept FROM g")
def story_gate(spark, d):
    """Articles by the three-way gate on their labelled relevance; in doubt those that name a watched word stay."""
    return stories.relevance_gate(*_stories(spark, d))


# --- runs ----------------------------------------------------------------------------------------

_SHARE = "CAST(round(avg(CASE WHEN %s THEN 1.0 ELSE 0.0 END), 4) AS DOUBLE)"
_MEASURES = {"quality": "value > 50", "oss": "value > 40", "actionable": "value > 30", "accept": "value < 20", "coherence": "value between 20 and 80", "pass_rate": "value > 60", "noise": "value > 90", "confidence": "value > 10"}
#: The share of confident values is bent a little, so that no smoothed threshold lies just between two of its four digits, where engines round doubles differently.
_BENT = "%s * 0.9137::DOUBLE + 0.00371::DOUBLE"
_HISTORY = "history AS (SELECT event_type AS loop, CAST(row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS INTEGER) AS run, " + ", ".join(f"{_BENT % (_SHARE % c) if k == 'confidence' else _SHARE % c} AS {k}" for k, c in _MEASURES.items()) + ", CASE WHEN count(*) % 2 = 0 THEN 'updated' ELSE 'skipped' END AS status FROM events GROUP BY event_type, CAST(ts AS DATE))"


def history(spark, d):
    """One run a day of each event type: shares of its values, and whether the loop was active."""
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("loop"), F.to_date("ts").alias("day")).agg(
        *[F.round(F.avg(F.when(F.expr(c), 1.0).otherwise(0.0)), 4).alias(k) for k, c in _MEASURES.items()], F.when(F.count("*") % 2 == 0, "updated").otherwise("skipped").alias("status"))
    days = days.withColumn("confidence", F.col("confidence") * 0.9137 + 0.00371)
    return days.withColumn("run", F.row_number().over(Window.partitionBy("loop").orderBy("day"))).drop("day")


@query("WITH RECURSIVE " + _HISTORY + """,
s AS (SELECT loop, run, quality, list(quality) OVER (PARTITION BY loop ORDER BY run ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last FROM history),
c AS (SELECT *, list_max(list_transform(range(1, len(last) + 1), lambda n: list_reduce(list_prepend(0.0::DOUBLE, list_transform(last[1:n], lambda q: 0.4::DOUBLE - q - 0.05::DOUBLE)), lambda a, x: greatest(0, a + x)))) AS peak FROM s),
f(loop, run, frozen) AS (SELECT DISTINCT loop, 0, FALSE FROM history UNION ALL SELECT c.loop, c.run, CASE WHEN f.frozen AND c.quality >= 0.45 THEN FALSE WHEN len(c.last) >= 3 AND c.peak > 0.3 THEN TRUE ELSE f.frozen END FROM f JOIN c ON c.loop = f.loop AND c.run = f.run + 1)
SELECT loop, run, frozen FROM f WHERE run > 0""")
def event_freeze(spark, d):
    return runs.adaptation_freeze(history(spark, d))


@query("WITH RECURSIVE " + _HISTORY + """,
e(loop, run, accept_t, coherence_t, reject_t, noise_t) AS (SELECT DISTINCT loop, 0, 0.30::DOUBLE, 0.40::DOUBLE, 0.50::DOUBLE, 0.10::DOUBLE FROM history UNION ALL
 SELECT h.loop, h.run,
  CASE WHEN accept < 0.2 THEN round(al * greatest(0.20, accept_t - 0.02) + (1 - al) * accept_t, 4) WHEN accept > 0.8 THEN round(al * least(0.50, accept_t + 0.02) + (1 - al) * accept_t, 4) ELSE accept_t END,
  CASE WHEN coherence > 0 THEN round(al * greatest(0.30, least(0.65, coherence * 0.85::DOUBLE)) + (1 - al) * coherence_t, 4) ELSE coherence_t END,
  CASE WHEN pass_rate < 0.3 THEN round(al * greatest(0.30, reject_t - 0.03) + (1 - al) * reject_t, 4) WHEN pass_rate > 0.8 THEN round(al * least(0.70, reject_t + 0.03) + (1 - al) * reject_t, 4) ELSE reject_t END,
  CASE WHEN noise > 0.4 THEN round(al * greatest(0.05, noise_t - 0.01) + (1 - al) * noise_t, 4) WHEN noise < 0.1 THEN round(al * least(0.20, noise_t + 0.01) + (1 - al) * noise_t, 4) ELSE noise_t END
 FROM e JOIN (SELECT *, least(0.30::DOUBLE, 0.1::DOUBLE * (0.7::DOUBLE + 0.6::DOUBLE * confidence)) AS al FROM history) h ON h.loop = e.loop AND h.run = e.run + 1)
SELECT * FROM e WHERE run > 0""")
def event_thresholds(spark, d):
    return runs.adapted_thresholds(history(spark, d))


@query("WITH " + _HISTORY + """, g AS (SELECT loop, count(*) AS n, avg(oss) FILTER (WHERE status = 'updated') AS active, avg(oss) FILTER (WHERE status <> 'updated') AS idle FROM history GROUP BY loop)
SELECT loop, round(CASE WHEN n < 3 OR active IS NULL OR idle IS NULL THEN 0.5 ELSE greatest(0, least(1, 0.5 + 5 * (active - idle))) END::DOUBLE, 6) AS health FROM g""")
def event_loop_health(spark, d):
    return runs.loop_health(history(spark, d))


@query("WITH " + _HISTORY + """, b AS (SELECT *, avg(oss) OVER w AS base_oss, avg(actionable) OVER w AS base_act, count(*) OVER w AS n FROM history WINDOW w AS (PARTITION BY loop ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, n >= 2 AND oss < 0.9::DOUBLE * base_oss AND actionable < 0.85::DOUBLE * base_act AS regressed FROM b)
SELECT loop, run, regressed, CASE WHEN regressed THEN max(run) FILTER (WHERE NOT regressed) OVER (PARTITION BY loop ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS rollback_to FROM r""")
def event_regressions(spark, d):
    return runs.regressions(history(spark, d))


@query("WITH " + _HISTORY + """ SELECT loop, count(*) AS runs, round(avg((status = 'updated')::INT), 4) AS active_rate, round(avg((noise > 0.4)::INT), 4) AS noisy_rate, round(avg(1 - pass_rate), 4) AS rejection_rate, round(max_by(oss, run), 4) AS last_oss, round(quantile_cont(quality, 0.5), 4) AS median_quality FROM history GROUP BY loop""")
def event_learning_status(spark, d):
    return runs.learning_status(history(spark, d))


# --- leads ---------------------------------------------------------------------------------------

_SHEETS = """sheets AS (SELECT o_orderkey AS id, c_name AS company, CASE WHEN c_acctbal > 0 THEN 'U' || c_custkey END AS cin, CASE c_custkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'mid' WHEN 2 THEN 'startup' END AS size_band, lower(c_mktsegment) AS event_type,
  round(least(1.0, o_totalprice / 400000), 2) AS confidence, c_nationkey AS cluster_id, o_orderpriority AS trend FROM orders JOIN customer ON o_custkey = c_custkey)"""
_ARMS = "arms AS (SELECT concat_ws('_', CASE s_suppkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'mid' WHEN 2 THEN 'startup' ELSE 'micro' END, lower(n_name)) AS arm, CAST(1 + count(*) FILTER (WHERE s_acctbal > 5000) AS DOUBLE) AS alpha, CAST(1 + count(*) FILTER (WHERE s_acctbal <= 5000) AS DOUBLE) AS beta FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"


def sheets(spark, d):
    """Call sheets: orders with their customers."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("c_custkey") % 4
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("U"), "c_custkey")).alias("cin"), F.when(k == 0, "large").when(k == 1, "mid").when(k == 2, "startup").alias("size_band"),
        F.lower("c_mktsegment").alias("event_type"), F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 400000), 2).alias("confidence"), F.col("c_nationkey").alias("cluster_id"), F.col("o_orderpriority").alias("trend"))


def _supplier_arms(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    arm = F.concat_ws("_", F.when(k == 0, "large").when(k == 1, "mid").when(k == 2, "startup").otherwise("micro"), F.lower("n_name"))
    return s.groupBy(arm.alias("arm")).agg((1.0 + F.count_if(F.col("s_acctbal") > 5000)).alias("alpha"), (1.0 + F.count_if(F.col("s_acctbal") <= 5000)).alias("beta"))


@query("WITH " + _SHEETS + ", " + _ARMS + """, lead_quality AS (SELECT n_nationkey AS cluster_id, n_nationkey % 10 / 10 AS quality FROM nation),
r AS (SELECT coalesce(size_band, 'mid') || '_' || coalesce(event_type, 'general') AS arm, (CASE WHEN cin IS NOT NULL THEN least(1.0::DOUBLE, confidence + 0.2::DOUBLE) WHEN company NOT LIKE '[%' THEN confidence * 0.7::DOUBLE ELSE 0.1::DOUBLE END) * (CASE WHEN coalesce(quality, 1) < 0.3 THEN 0.7::DOUBLE ELSE 1 END) AS reward
  FROM sheets LEFT JOIN lead_quality USING (cluster_id)),
g AS (SELECT arm, sum(reward) AS won, count(*) - sum(reward) AS lost FROM r GROUP BY arm),
d AS (SELECT arm, greatest(1.0::DOUBLE, 1 + (alpha - 1) * 0.97::DOUBLE) AS alpha, greatest(1.0::DOUBLE, 1 + (beta - 1) * 0.97::DOUBLE) AS beta FROM arms)
SELECT coalesce(d.arm, g.arm) AS arm, round(coalesce(alpha, 1) + coalesce(won, 0), 4) AS alpha, round(coalesce(beta, 1) + coalesce(lost, 0), 4) AS beta FROM d FULL JOIN g ON d.arm = g.arm""")
def order_arm_update(spark, d):
    """Company arms after the leads of all orders: decay, rewards, and less for clusters that were poor before."""
    before = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster_id"), (F.col("n_nationkey") % 10 / 10).alias("quality"))
    out = business.company_arm_update(sheets(spark, d), _supplier_arms(spark, d), before)
    return out.select("arm", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


@query("WITH " + _SHEETS + " SELECT md5(lower(company))[1:12] AS id, min_by(company, (-confidence, company)) AS name, count(*) AS leads, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS events, max(confidence) AS confidence FROM sheets GROUP BY lower(company)")
def order_companies(spark, d):
    return runs.lead_companies(sheets(spark, d))


@query("WITH " + _SHEETS + " SELECT trend, round(avg(confidence), 4) AS mean_confidence, count(*) AS leads, round(avg((confidence >= 0.5)::INT), 4) AS sure_share FROM sheets GROUP BY trend")
def order_confidence(spark, d):
    return runs.lead_confidence(sheets(spark, d))


@query("""
SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS companies, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed,
 CAST(sum(lines) AS BIGINT) AS contacts, CAST(sum(returned) AS BIGINT) AS emails FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def order_campaign(spark, d):
    """Orders as the companies of one campaign: totals and state."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("contacts"), F.count_if(F.col("l_returnflag") == "R").alias("emails"))
    s = F.col("o_orderstatus")
    o = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return runs.campaign_rollup(o.select(F.when(s == "P", "running").when(s == "F", "done").otherwise("failed").alias("status"), "contacts", "emails"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 100 >= 60 THEN lower(c_name) || '@first.com' WHEN c_nationkey % 2 = 0 AND c_custkey % 90 >= 50 THEN lower(c_name) || '@second.com' WHEN c_mktsegment <> 'MACHINERY' THEN lower(c_name) || '@guess.com' END AS email, "
       "CAST(CASE WHEN c_acctbal > 0 AND c_custkey % 100 >= 60 THEN c_custkey % 100 WHEN c_nationkey % 2 = 0 AND c_custkey % 90 >= 50 THEN c_custkey % 90 WHEN c_mktsegment <> 'MACHINERY' THEN 40 END AS INTEGER) AS confidence, "
       "CASE WHEN c_acctbal > 0 AND c_custkey % 100 >= 60 THEN 'first' WHEN c_nationkey % 2 = 0 AND c_custkey % 90 >= 50 THEN 'second' WHEN c_mktsegment <> 'MACHINERY' THEN 'pattern' END AS via FROM customer")
def customer_emails(spark, d):
    """The first good address of each customer: one source from 60 on, another from 50 on, else the pattern."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    mail = lambda host: F.concat(F.lower("c_name"), F.lit(f"@{host}.com"))
    found = B.email_choice(F.when(F.col("c_acctbal") > 0, mail("first")), key % 100, F.when(F.col("c_nationkey") % 2 == 0, mail("second")), key % 90, F.when(F.col("c_mktsegment") != "MACHINERY", mail("guess")))
    return c.select("c_custkey", found.alias("m")).select("c_custkey", "m.*")


# --- more names ----------------------------------------------------------------------------------

_ENTITIES = f"{_NAMED}, entities AS (SELECT m.name, list_sort(list(DISTINCT doc_id)) AS articles, any_value(CASE WHEN contains(m.name, ' ') THEN 'ORG' ELSE 'PERSON' END) AS kind FROM m JOIN k ON k.name = m.name GROUP BY m.name)"


def named(spark, d):
    """(name, articles, kind): capitalised phrases of two texts or more, with the texts that hold them."""
    m = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(1)))).alias("name"))
    g = m.groupBy("name").agg(F.sort_array(F.collect_set("doc_id")).alias("articles")).filter(F.size("articles") >= 2)
    return g.withColumn("kind", F.when(F.contains("name", F.lit(" ")), "ORG").otherwise("PERSON"))


@query("WITH " + _ENTITIES + """, papers AS (SELECT DISTINCT source FROM documents)
SELECT name FROM entities WHERE lower(name) NOT IN (SELECT lower(source) FROM papers WHERE source IS NOT NULL) AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN (SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') FROM papers WHERE source IS NOT NULL)
 AND NOT (len(string_split(name, ' ')) <= 3 AND list_has_any(string_split(lower(name), ' '), ['explainer', 'analysis', 'opinion', 'editorial', 'interview', 'insight']))""")
def phrases_that_are_no_papers(spark, d):
    """Names of texts that are neither a source by either key nor a byline."""
    return stories.source_and_byline_filter(named(spark, d), table(spark, d, "documents").select("source").filter("source is not null").distinct())


@query("WITH " + _ENTITIES + """, bad AS (SELECT * FROM entities WHERE contains(lower(name), 'companies') OR length(name) <= 1 OR regexp_matches(name, '^[0-9]+$') OR length(name) <= 2),
good AS (SELECT * FROM entities WHERE name NOT IN (SELECT name FROM bad)), v AS (SELECT name, string_split(lower(name), ' ') AS w, articles FROM good),
suffix AS (SELECT s.name AS name, min_by(l.name, (-len(l.articles), l.name)) AS target FROM v s JOIN v l ON len(s.w) <= 2 AND len(l.w) > len(s.w) AND list_slice(l.w, len(l.w) - len(s.w) + 1, len(l.w)) = s.w
   AND (len(s.w) > 1 OR len(list_intersect(s.articles, l.articles)) / least(len(s.articles), len(l.articles)) >= 0.3) GROUP BY s.name),
prefix AS (SELECT l.name AS name, min_by(s.name, (-len(s.articles), s.name)) AS target FROM v s JOIN v l ON len(s.w) <= 2 AND len(l.w) > len(s.w) AND list_slice(l.w, 1, len(s.w)) = s.w WHERE s.name NOT IN (SELECT name FROM suffix) AND l.name NOT IN (SELECT name FROM suffix) GROUP BY l.name)
SELECT name, coalesce(suffix.target, prefix.target, name) AS canonical FROM good LEFT JOIN suffix USING (name) LEFT JOIN prefix USING (name)""")
def merged_phrases(spark, d):
    """Names of more than two letters under the name that they are the end or the beginning of."""
    n = named(spark, d).filter("length(name) > 2 and not contains(lower(name), 'companies')")
    return stories.containment_merge(n)


@query("WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS entity, CASE lang WHEN 'en' THEN 'ORG' WHEN 'fr' THEN 'PRODUCT' WHEN 'de' THEN 'GPE' ELSE 'PERSON' END AS kind FROM documents)," + """
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS r FROM m), c AS (SELECT entity, kind, count(*) AS n, min(doc_id) AS first FROM k WHERE r <= 20 GROUP BY entity, kind),
t AS (SELECT entity, arg_max(kind, (n, -first)) AS kind, sum(n) AS total, coalesce(sum(n) FILTER (WHERE kind = 'ORG'), 0) AS org, coalesce(sum(n) FILTER (WHERE kind = 'PRODUCT'), 0) AS product FROM c GROUP BY entity)
SELECT entity, CASE WHEN kind = 'PRODUCT' AND (org > 0 OR product / total < 0.7) THEN 'ORG' ELSE kind END AS kind FROM t""")
def word_types(spark, d):
    """The type that most of the first twenty texts give a capitalised word; a text's language stands for what a tagger would say."""
    kind = F.when(F.col("lang") == "en", "ORG").when(F.col("lang") == "fr", "PRODUCT").when(F.col("lang") == "de", "GPE").otherwise("PERSON")
    m = table(spark, d, "documents").select(F.col("doc_id").alias("article"), kind.alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), F.lit(1)))).alias("entity"))
    return stories.type_vote(m)


# --- more stories --------------------------------------------------------------------------------


@query("""
SELECT event_type AS source, count(*) AS fetches, round(avg((event_id % 9 <> 0)::INT), 4) AS ok_share, round(avg(value) FILTER (WHERE event_id % 9 <> 0), 4) AS seconds, CAST(sum(user_id % 7) AS BIGINT) AS entries,
 CASE WHEN count(*) FILTER (WHERE event_id % 9 <> 0) = 0 THEN 'down' WHEN sum(user_id % 7) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE event_id % 9 <> 0) < count(*) THEN 'unsteady' ELSE 'healthy' END AS health, CASE WHEN max_by(event_id, (ts, event_id)) % 9 <> 0 THEN 200 ELSE 500 END AS last_status FROM events GROUP BY event_type""")
def fetch_health(spark, d):
    """Health of event types as sources: every ninth fetch fails, and users stand for the entries."""
    e = table(spark, d, "events")
    at = F.struct("ts", "event_id")
    return stories.source_health(e.select(F.col("event_type").alias("source"), at.alias("fetched_at"), F.when(F.col("event_id") % 9 != 0, 200).otherwise(500).alias("status"), F.col("value").alias("seconds"), (F.col("user_id") % 7).alias("entries")))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label AS cluster_id, vec_id % 7 AS run, round(avg(v[1] * v[1] + v[2] * v[2]), 9) AS coherence, count(*) % 3 = 0 AND false AS passed FROM v GROUP BY ALL),
r AS (SELECT run, bool_or(passed) AS any_passed, greatest(0.10::DOUBLE, 0.8::DOUBLE * avg(coherence)) AS least FROM c GROUP BY run)
SELECT c.cluster_id, c.run, CASE WHEN any_passed THEN passed ELSE coherence >= least END AS passed FROM c JOIN r ON c.run = r.run""")
def override_of_groups(spark, d):
    """Groups of vectors of seven runs of which none passed: those near the run's mean coherence are let through."""
    v = F.col("embedding")
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("run"), F.col("label").alias("cluster_id"), (v[0].cast("double") * v[0].cast("double") + v[1].cast("double") * v[1].cast("double")).alias("x"))
    g = e.groupBy("cluster_id", "run").agg(F.round(F.avg("x"), 9).alias("coherence")).withColumn("passed", F.lit(False))
    return stories.zero_pass_override(g)


# --- more leads ----------------------------------------------------------------------------------


@query("WITH " + _SHEETS + """, trend_rows AS (SELECT n_nationkey AS trend_id, CASE n_nationkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE n_name END AS title, n_regionkey / 10 AS oss FROM nation), impact_rows AS (SELECT n_name AS title, 'Sell to ' || r_name AS pitch FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT id, company, CASE WHEN id % 3 <> 0 THEN cluster_id END AS trend_id, trend FROM sheets)
SELECT l.company, l.trend, coalesce(a.trend_id, b.trend_id) AS trend_id, coalesce(a.oss, b.oss, 0) AS oss, i.pitch FROM l LEFT JOIN trend_rows a ON a.trend_id = l.trend_id LEFT JOIN trend_rows b ON b.title = l.trend LEFT JOIN impact_rows i ON i.title = coalesce(a.title, b.title, l.trend)""")
def order_context(spark, d):
    """Leads with their trend, by number or else by title, and its pitch."""
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    trends = n.select(key.alias("trend_id"), F.when(key == 0, "1-URGENT").when(key == 1, "2-HIGH").otherwise(F.col("n_name")).alias("title"), (F.col("n_regionkey") / 10).alias("oss"))
    impacts = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("title"), F.concat(F.lit("Sell to "), "r_name").alias("pitch"))
    leads = sheets(spark, d).select("company", "trend", F.when(F.col("id") % 3 != 0, F.col("cluster_id")).alias("trend_id"))
    return runs.causal_context(leads, trends, impacts)


@query("""
WITH e AS (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '.com' ELSE '' END AS website, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS employees, CASE WHEN c_custkey % 3 = 0 THEN ['kb'] ELSE [] END AS sources FROM customer),
r AS (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name, 'reg' || s_suppkey || '.com' AS website, CAST(s_nationkey AS VARCHAR) AS employees FROM supplier), s AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, max('web' || o_custkey || '.com') AS website, CAST(count(*) AS VARCHAR) AS employees FROM orders GROUP BY o_custkey)
SELECT e.name, coalesce(nullif(e.website, ''), nullif(r.website, ''), nullif(s.website, '')) AS website, coalesce(nullif(e.employees, ''), nullif(r.employees, ''), nullif(s.employees, '')) AS employees,
 array_to_string(list_sort(list_distinct(list_concat(e.sources, CASE WHEN r.name IS NULL THEN [] ELSE ['registry'] END, CASE WHEN s.name IS NULL THEN [] ELSE ['search'] END))), ',') AS sources FROM e LEFT JOIN r USING (name) LEFT JOIN s USING (name)""")
def customer_profiles(spark, d):
    """Customers with what is empty filled from suppliers of their number and then from their orders."""
    key, number = F.col("c_custkey"), lambda c: F.concat(F.lit("Customer#"), F.lpad(F.col(c).cast("string"), 9, "0"))
    e = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.when(key % 2 == 0, F.concat(F.lower("c_name"), F.lit(".com"))).otherwise("").alias("website"), F.when(key % 5 == 0, F.col("c_nationkey").cast("string")).alias("employees"),
        F.when(key % 3 == 0, F.array(F.lit("kb"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    r = table(spark, d, "supplier").select(number("s_suppkey").alias("name"), F.concat(F.lit("reg"), "s_suppkey", F.lit(".com")).alias("website"), F.col("s_nationkey").cast("string").alias("employees"))
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("string").alias("employees")).select(number("o_custkey").alias("name"), F.concat(F.lit("web"), "o_custkey", F.lit(".com")).alias("website"), "employees")
    return runs.fill_if_empty(e, r, s)


@query("""
WITH l AS (SELECT d.doc_id AS id, text, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 OR toxic = 1 THEN 0 END AS label FROM documents d JOIN labels USING (doc_id)), d AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY id) AS r FROM l WHERE label IS NOT NULL),
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS n, count(*) FILTER (WHERE label = 1) OVER () AS pos, count(*) FILTER (WHERE label = 0) OVER () AS neg FROM d WHERE r = 1)
SELECT id, label FROM k WHERE n <= 2 * least(pos, neg)""")
def document_auto_labels(spark, d):
    """Labels of sure documents, each text once, neither class more than twice the other."""
    j = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return runs.auto_labels(j.select("id", "text", F.when(good, 0.95).otherwise(0.1).alias("score"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("rejected")))


@query("SELECT l_orderkey AS trend_id, count(*) AS hops, round(avg((l_returnflag <> 'R')::INT), 4) AS kb_hit_rate FROM lineitem GROUP BY l_orderkey")
def order_signal(spark, d):
    """Of each order's lines, as hops of a trend, the share for which companies are known."""
    known = F.when(F.col("l_returnflag") != "R", F.array(F.col("l_suppkey"))).otherwise(F.array().cast("array<long>"))
    return runs.trend_signal(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trend_id"), known.alias("companies")))



@query(f"WITH s AS (SELECT source, list_distinct(list(CASE lang WHEN 'en' THEN 'B2B' WHEN 'fr' THEN 'macro' WHEN 'de' THEN 'sports' ELSE 'trade' END)) AS tags FROM documents WHERE doc_id % 3 = length(source) % 3 GROUP BY source) SELECT source, CASE WHEN list_has_any(tags, {_list(B.SIGNAL_TAGS)}) THEN 3.0 ELSE 1.0 END::DOUBLE AS alpha, CASE WHEN list_has_any(tags, {_list(B.SIGNAL_TAGS)}) THEN 1.0 WHEN list_has_any(tags, {_list(B.NOISE_TAGS)}) THEN 3.0 ELSE 1.0 END::DOUBLE AS beta FROM s")
def document_source_priors(spark, d):
    """Priors of sources by the tags that their documents' languages stand for."""
    tag = F.when(F.col("lang") == "en", "B2B").when(F.col("lang") == "fr", "macro").when(F.col("lang") == "de", "sports").otherwise("trade")
    s = table(spark, d, "documents").filter(F.col("doc_id") % 3 == F.length("source") % 3).groupBy("source").agg(F.collect_set(tag).alias("tags"))
    return business.source_priors(s)


# --- thresholds ----------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT event_type, round(value / 100, 4) AS s FROM events WHERE event_type = 'purchase' AND value IS NOT NULL), b AS (SELECT s, count(*) AS n FROM s GROUP BY s), i AS (SELECT * FROM b WHERE s BETWEEN 0.05 AND 0.98),
m AS (SELECT sum(n) AS n, sqrt(greatest((sum(n * s * s) - sum(n * s) * sum(n * s) / sum(n)) / (sum(n) - 1), 0)) AS sd FROM i), w AS (SELECT CASE WHEN (SELECT sum(n) FROM b) >= 30 AND n >= 20 AND sd > 1e-9 THEN 1.06 * sd * pow(n, -0.2) END AS width FROM m),
d AS (SELECT k AS i, sum(n * exp(-0.5 * pow((0.30 + k * (0.95::DOUBLE - 0.30::DOUBLE) / 199 - s) / width, 2))) AS d FROM i, w, range(200) t(k) WHERE width IS NOT NULL GROUP BY k),
v AS (SELECT i, d, min(d) OVER (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l, min(d) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS r FROM d),
x AS (SELECT 0.30 + i * (0.95::DOUBLE - 0.30::DOUBLE) / 199 AS place FROM v WHERE i BETWEEN 10 AND 189 AND d < l AND d < r)
SELECT round(CASE WHEN count(*) = 0 THEN 0.88::DOUBLE ELSE greatest(0.70::DOUBLE, least(0.95::DOUBLE, min_by(place, (abs(place - 0.88::DOUBLE), place)))) END, 6) AS threshold, count(*) AS valleys FROM x""")
def purchase_valley(spark, d):
    """The valley in the values of all purchases, as shares of a hundred."""
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return valley.density_valley(e, F.col("value") / 100)


# --- descriptions, contacts, scores --------------------------------------------------------------


def _describes(c: str) -> str:
    """SQL of ``is_description``."""
    clean = f"trim(coalesce({c}, ''))"
    low, words = f"lower({clean})", lambda x: f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"
    phrases_ = " OR ".join(f"contains({low}, '{p}')" for p in B.DESCRIPTOR_PHRASES)
    return f"({clean} = '' OR len({words(clean)}) > 8 OR regexp_matches({low}, '\\(\\s*(excluding|multiple|non-|non |approx|various)[^)]*\\)') OR list_has_any({words(f"translate({low}, ',()', '   ')")}, {_list(B.DESCRIPTOR_WORDS)}) OR {phrases_} OR regexp_matches({low}, '^top [+-]?[0-9]+ +\\S'))"


@query(f"SELECT p_partkey, p_name || ' ' || lower(p_type) || CASE p_size % 5 WHEN 0 THEN ' companies' WHEN 1 THEN ' (excluding ' || p_brand || ')' WHEN 2 THEN '' ELSE ' based in ' || p_brand END AS name, {_describes("p_name || ' ' || lower(p_type) || CASE p_size % 5 WHEN 0 THEN ' companies' WHEN 1 THEN ' (excluding ' || p_brand || ')' WHEN 2 THEN '' ELSE ' based in ' || p_brand END")} AS description FROM part")
def part_descriptions(spark, d):
    """Whether what parts are called describes them, by their type, brand and size, or names them."""
    k = F.col("p_size") % 5
    more = F.when(k == 0, " companies").when(k == 1, F.concat(F.lit(" (excluding "), "p_brand", F.lit(")"))).when(k == 2, "").otherwise(F.concat(F.lit(" based in "), "p_brand"))
    n = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lower("p_type"), more).alias("name"))
    return n.withColumn("description", B.is_description(F.col("name")))


_ROLES = ["Chief Executive Officer", "Executive Assistant", "Engineer", "VP Sales", "Analyst", "Secretary", "Head of Data"]


@query(f"""
WITH c AS (SELECT c_custkey AS id, ({_list(_ROLES)})[CAST(c_custkey % 7 + 1 AS INTEGER)] AS role, CASE WHEN c_custkey % 3 > 0 THEN lower(c_name) || '@a.com' ELSE '' END AS email, c_custkey % 101 AS conf, c_custkey % 4 = 0 AS verified, CASE WHEN c_nationkey % 2 = 0 THEN 'l' ELSE '' END AS linkedin,
  c_nationkey / 25 AS relevance, CASE c_custkey % 5 WHEN 0 THEN 'executive' WHEN 1 THEN 'junior' ELSE '' END AS ml, CASE WHEN c_custkey % 11 = 0 THEN '1' ELSE '' END AS phone FROM customer),
t AS (SELECT *, CASE WHEN {" OR ".join(f"contains(lower(trim(role)), '{w}')" for w in B.DECISION_MAKERS)} THEN 'decision_maker' WHEN {" OR ".join(f"contains(lower(trim(role)), '{w}')" for w in B.GATEKEEPERS)} THEN 'gatekeeper' ELSE 'influencer' END AS tier FROM c),
l AS (SELECT *, CASE WHEN ml = 'executive' AND tier <> 'decision_maker' THEN 'decision_maker' WHEN ml = 'junior' AND tier = 'decision_maker' THEN 'influencer' ELSE tier END AS level FROM t),
s AS (SELECT *, (CASE WHEN verified THEN 40 WHEN email <> '' THEN least(conf * 0.4::DOUBLE, 32) ELSE 0 END) + (CASE WHEN phone <> '' THEN 10 ELSE 0 END) + (CASE WHEN linkedin <> '' THEN 10 ELSE 0 END)
  + (CASE level WHEN 'decision_maker' THEN 20 WHEN 'influencer' THEN 15 WHEN 'gatekeeper' THEN 5 ELSE 10 END) + relevance * 20 AS score FROM l),
g AS (SELECT *, CASE WHEN level = 'gatekeeper' THEN least(score, 40) ELSE score END AS capped FROM s)
SELECT id, tier, CAST(greatest(0, least(100, round_even(CASE WHEN email = '' AND phone = '' THEN least(capped, 35) ELSE capped END, 0))) AS INTEGER) AS reach, CASE tier WHEN 'decision_maker' THEN 'executive' WHEN 'gatekeeper' THEN 'professional' ELSE 'consultative' END AS tone FROM g""")
def customer_reach(spark, d):
    """Customers as contacts: tier by title, reach from 0 to 100, and the tone to write in."""
    k, text = F.col("c_custkey"), lambda cond, value: F.when(cond, value).otherwise("")
    role = F.get(F.array(*map(F.lit, _ROLES)), (k % 7).cast("int"))
    t = table(spark, d, "customer").select(
        k.alias("id"), role.alias("role"), text(k % 3 > 0, F.concat(F.lower("c_name"), F.lit("@a.com"))).alias("email"), (k % 101).alias("email_confidence"), (k % 4 == 0).alias("verified"), text(F.col("c_nationkey") % 2 == 0, F.lit("l")).alias("linkedin"),
        (F.col("c_nationkey") / 25).alias("relevance"), F.when(k % 5 == 0, "executive").when(k % 5 == 1, "junior").otherwise("").alias("ml"), text(k % 11 == 0, F.lit("1")).alias("phone"))
    return business.contact_reach(t)


@query(r"""
WITH $ARTICLES, c AS (SELECT doc_id AS cluster_id, concat_ws(' ', title, summary) AS body, nullif(regexp_extract(title, '[A-Z][a-z]{3,}', 0), '') AS entity, CASE WHEN lang <> 'de' THEN lang END AS industry, doc_id % 100 / 100 AS coherence, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 / 10 ELSE 0 END AS strategic FROM articles),
s AS (SELECT *, CAST(round(0.35 * (entity IS NOT NULL)::INT + 0.25 * coalesce(regexp_matches(body, '(?i)(^|[^\p{L}\p{N}_])(launch|acquir|rais|expand|partner|invest|hire|layoff|regulat|approv|fund|merge|deploy|integrat|adopt)'), false)::INT + 0.25 * coalesce(regexp_matches(body, '\$[\d.]+|\d+%|\d\d\d\d'), false)::INT + 0.15 * (industry IS NOT NULL)::INT, 3) AS DOUBLE) AS oss,
  CASE WHEN strategic > 0 THEN CASE WHEN strategic >= 0.5 THEN 'high' WHEN strategic >= 0.25 THEN 'medium' ELSE 'low' END WHEN coherence >= 0.7 THEN 'high' WHEN coherence >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM c),
w AS (SELECT * FROM s JOIN (VALUES ('high', 1.0, 1.0), ('medium', 0.6, 0.85), ('low', 0.3, 0.55)) AS m(severity, weight, most) USING (severity)),
a AS (SELECT *, round(least(0.4::DOUBLE * weight::DOUBLE + 0.3::DOUBLE * oss + 0.3::DOUBLE * coherence::DOUBLE, most::DOUBLE), 2) AS score, least(0.4::DOUBLE * weight::DOUBLE + 0.3::DOUBLE * oss + 0.3::DOUBLE * coherence::DOUBLE, most::DOUBLE) AS raw FROM w)
SELECT cluster_id, oss, severity, CASE WHEN round(raw, 3) >= 0.65 THEN 'major' WHEN round(raw, 3) < 0.4 THEN 'minor' ELSE 'sub' END AS level FROM a""")
def story_scores(spark, d):
    """Articles as trends: specificity, severity, and the level that their actionability gives."""
    i = F.col("doc_id")
    a = articles(spark, d).select(
        i.alias("cluster_id"), F.col("title").alias("label"), "summary", F.nullif(F.regexp_extract("title", "([A-Z][a-z]{3,})", 1), F.lit("")).alias("entity"), F.when(F.col("lang") != "de", F.col("lang")).alias("industry"),
        (i % 100 / 100).alias("coherence"), F.when(i % 3 == 0, i % 7 / 10).otherwise(0.0).alias("strategic"))
    return business.trend_scores(a).drop("actionability")


@query(f"""
WITH h AS (SELECT l_orderkey AS event, o_orderpriority AS trend, l_linenumber AS hop, p_type AS segment, CASE l_linenumber % 4 WHEN 0 THEN 'pain' WHEN 1 THEN 'opportunity' WHEN 2 THEN 'risk' ELSE 'other' END AS kind, 'Costs of ' || p_name || ' move' AS mechanism, CAST(l_quantity AS INTEGER) AS weeks, l_tax * 10 AS confidence,
  CASE l_returnflag WHEN 'R' THEN [] WHEN 'A' THEN [s_name, p_name || ' companies', s_name || ' Two', 'Three ' || s_name, 'Four'] ELSE [p_name || ' focused on ' || p_brand] END AS companies FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT *, list_filter(companies, lambda c: NOT {_describes("c")}) AS good FROM h WHERE confidence >= 0.35), p AS (SELECT *, len(good) = 0 AS placeholder FROM g),
x AS (SELECT *, unnest(CASE WHEN placeholder THEN [segment] ELSE good[1:3] END) AS company FROM p), o AS (SELECT *, CASE WHEN placeholder THEN 'Your business' ELSE company END AS who FROM x)
SELECT event, hop, company, placeholder, round(confidence * (CASE WHEN placeholder THEN 0.8::DOUBLE ELSE 1 END), 4) AS confidence, weeks AS urgency_weeks,
 CASE kind WHEN 'pain' THEN who || ' faces a concrete challenge: ' || mechanism || '. This will likely materialize within ' || weeks || ' weeks. We help companies navigate exactly this kind of pressure.'
  WHEN 'opportunity' THEN 'The recent ' || lower(trend) || ' creates a specific opening for ' || who || '. ' || mechanism || '. Companies that move in the next ' || weeks || ' weeks capture the most value.'
  WHEN 'risk' THEN who || ' carries elevated risk right now: ' || mechanism || '. Our risk intelligence platform can help quantify and mitigate this exposure.'
  ELSE 'Given the recent ' || lower(trend) || ', ' || who || ' stands to benefit from sharper competitive intelligence. ' || mechanism || '.' END AS opening FROM o""")
def line_leads(spark, d):
    """Leads of order lines as causal hops: up to three companies each that are no descriptions, else the segment as a placeholder, and the opening line."""
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    k, flag = F.col("l_linenumber") % 4, F.col("l_returnflag")
    some = F.array(F.col("s_name"), F.concat("p_name", F.lit(" companies")), F.concat("s_name", F.lit(" Two")), F.concat(F.lit("Three "), "s_name"), F.lit("Four"))
    hops = l.select(
        F.col("l_orderkey").alias("event"), F.col("o_orderpriority").alias("trend"), F.col("l_linenumber").alias("hop"), F.col("p_type").alias("segment"), F.when(k == 0, "pain").when(k == 1, "opportunity").when(k == 2, "risk").otherwise("other").alias("kind"),
        F.concat(F.lit("Costs of "), "p_name", F.lit(" move")).alias("mechanism"), F.col("l_quantity").cast("int").alias("weeks"), (F.col("l_tax") * 10).alias("confidence"),
        F.when(flag == "R", F.array().cast("array<string>")).when(flag == "A", some).otherwise(F.array(F.concat("p_name", F.lit(" focused on "), "p_brand"))).alias("companies"))
    return business.crystallised_leads(hops)


@query("WITH " + _STORIES + """, x AS (SELECT *, lower(concat_ws(' ', title, summary)) AS body FROM stories),
d AS (SELECT lower(target) AS t, NOT EXISTS (SELECT 1 FROM x WHERE published >= TIMESTAMP '2024-01-01 03:00:00' AND """ + _NAMES % "body" + """) AS dropped FROM targets)
SELECT id FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE dropped) OR NOT EXISTS (SELECT 1 FROM d WHERE NOT dropped) OR EXISTS (SELECT 1 FROM d WHERE NOT dropped AND contains(body, t)) OR NOT EXISTS (SELECT 1 FROM d WHERE dropped AND contains(body, t))""")
def watched_stories(spark, d):
    """Articles that name a watched word which was named after the first three hours, or none that went silent."""
    return stories.recent_targets(*_stories(spark, d), "2024-01-01 03:00:00")


@query("""
WITH $ARTICLES, e AS (SELECT doc_id AS id, title, summary, regexp_extract(title, '[A-Z][a-z]+', 0) AS person, regexp_extract_all(summary, '[A-Z][a-z]+') AS all_, doc_id % 10 / 10 AS salience FROM articles), c AS (SELECT *, all_[len(all_)] AS company FROM e WHERE person <> '' AND len(all_) > 0)
SELECT id, company, round(CASE WHEN contains(lower(title), lower(person)) AND len(list_filter(regexp_split_to_array(lower(summary), '[.!?]'), lambda s: contains(s, lower(person)) AND contains(s, lower(company)))) > 0 THEN least(1, salience + 0.12::DOUBLE) ELSE salience END, 4) AS salience FROM c""")
def boosted_names(spark, d):
    """The last name of a text gains where a sentence names it with the first name of the title."""
    every = F.regexp_extract_all("summary", F.lit("([A-Z][a-z]+)"), F.lit(1))
    a = articles(spark, d).select(F.col("doc_id").alias("id"), "title", "summary", F.regexp_extract("title", "([A-Z][a-z]+)", 1).alias("person"), every.alias("every"), (F.col("doc_id") % 10 / 10).alias("salience"))
    return sheets_.person_boost(a.filter("person <> '' and size(every) > 0").withColumn("company", F.element_at("every", -1)))


@query("SELECT c_custkey AS company, coalesce(CAST(nullif(regexp_extract(replace(e, ',', ''), '[0-9]+', 0), '') AS BIGINT) BETWEEN 50 AND 899, TRUE) AS fits FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'about ' || CAST(c_custkey % 1500 AS VARCHAR) || '-2,000' ELSE '' END AS e FROM customer)")
def customer_size_bands(spark, d):
    """Customers whose size lies in the band, by texts like ``about 120-2,000``; unknown sizes pass."""
    k = F.col("c_custkey")
    size = F.when(k % 4 > 0, F.concat(F.lit("about "), (k % 1500).cast("string"), F.lit("-2,000"))).otherwise("")
    return business.size_band(table(spark, d, "customer").select(k.alias("company"), size.alias("employees")))
