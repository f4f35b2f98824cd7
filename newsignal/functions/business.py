"""Scalar rules about companies, contacts, stories and leads, on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains that are no company's own.
BLACKLISTED_DOMAINS = (
    "linkedin.com facebook.com twitter.com x.com google.com youtube.com wikipedia.org github.com medium.com quora.com crunchbase.com bloomberg.com reuters.com "
    "economictimes.com moneycontrol.com livemint.com businesstoday.in yourstory.com inc42.com ndtv.com hindustantimes.com timesofindia.com businessstandard.com thehindu.com thequint.com "
    "techcrunch.com theverge.com wired.com zdnet.com venturebeat.com cnbc.com wsj.com ft.com businessinsider.com forbes.com "
    "prnewswire.com businesswire.com globenewswire.com prnewswire.co.in businesswire.in accesswire.com prweb.com einpresswire.com newswire.com eventbrite.com meetup.com"
).split()
# Top-level domains without companies.
NO_COMPANY_TLDS = "gov edu mil museum int example test localhost invalid local".split()
# Endings of company names, in the order in which they are taken off.
NAME_SUFFIXES = [
    " private limited", " pvt ltd", " pvt. ltd.", " pvt ltd.", " limited", " ltd", " ltd.", " inc", " inc.", " llp", " llc", " corporation", " corp", " corp.",
    " india", " technologies", " solutions", " services", " software", " systems", " consulting",
]
# Hosts and titles of noise among news.
NOISE_DOMAINS = "youtube.com youtu.be tiktok.com instagram.com facebook.com fb.com pinterest.com reddit.com twitter.com x.com linkedin.com stockanalysis.com tradingview.com seekingalpha.com glassdoor.com indeed.com ambitionbox.com".split()
NOISE_TITLE = (
    "(?i)(stock price|share price|buy or sell|quarterly results|eps estimate|stock forecast|stock analysis|dividend|target price|rating reiterated|job opening|hiring|career|glassdoor|salary|interview question|"
    "cookie policy|privacy policy|terms of service|subscribe now|download app|scan qr|promo code|coupon|discount)"
)
# Words and phrases of descriptions that stand where a name should.
DESCRIPTOR_WORDS = (
    "mid-size midsize mid-market small-scale large-scale tier-1 tier-2 tier-3 top-tier companies providers manufacturers suppliers distributors exporters importers integrators contractors subcontractors startups firms vendors "
    "lenders operators developers consultants retailers wholesalers processors aggregators integrating specializing focusing serving targeting excluding relying providing employees non-top end-users"
).split()
DESCRIPTOR_PHRASES = [
    "based in", "-based ", "focused on", "engaged in", "operating in", "catering to", "dealing in", "involved in", "working in", "operations and", "partners in", "direct commercial",
    "100-500 employees", "50-150 employees", "50-200 employees", "50-300 employees", "50-500 employees", "500-1000 employees", "200-500 employees", "100-300 employees",
]
# Keywords of event types, in order of precedence.
EVENT_KEYWORDS = {
    "trade_policy": ["trade", "export", "import", "customs", "cross-border", "trade policy", "duty", "anti-dumping", "quota", "embargo", "wto", "fta", "bilateral"],
    "supply_chain": ["supply chain", "supplier", "sourcing", "logistics", "procurement", "shipping", "inventory", "warehousing", "freight", "distribution", "vendor", "contract"],
    "price_change": [
        "price", "cost", "tariff", "commodity", "inflation", "pricing", "revenue", "profit", "margin", "buyback", "earnings", "valuation", "stock", "shares", "decline", "drop", "surge", "rally",
        "quarterly", "annual result", "dividend", "default", "guarantee", "debt", "bond", "credit",
    ],
    "m_and_a": [
        "acqui", "merger", "takeover", "buyout", "m&a", "consolidat", "funding", "raise", "series a", "series b", "ipo", "invest", "stake", "joint venture", "partnership", "deal", "billion", "million",
        "capital", "venture", "private equity", "divestiture", "spinoff", "spin-off",
    ],
    "regulation": [
        "regulation", "regulatory", "compliance", "sanction", "ban", "law", "policy", "government", "ministry", "rbi", "sebi", "sec", "fda", "license", "approval", "mandate", "rule", "framework",
        "guideline", "investigation", "probe", "penalty", "fine", "enforcement", "antitrust",
    ],
    "technology": [
        "technology", "tech", "ai ", "artificial intelligence", "software", "platform", "digital", "cloud", "saas", "machine learning", "automation", "cyber", "iot", "edge computing", "launch", "product",
        "innovation", "patent", "r&d", "startup", "app ", "data", "analytics", "blockchain", "quantum", "semiconductor", "chip", "gpu",
    ],
    "labor": ["labor", "workforce", "hiring", "layoff", "talent", "employee", "strike", "attrition", "headcount", "remote work", "gig", "union"],
    "infrastructure": [
        "infrastructure", "facility", "plant", "construction", "warehouse", "expansion", "expand", "capacity", "factory", "real estate", "port", "rail", "highway", "energy", "power", "renewable", "solar", "wind",
    ],
}
# Parts of job titles.
DECISION_MAKERS = ["ceo", "cfo", "cto", "coo", "cmo", "cio", "ciso", "cpo", "founder", "co-founder", "cofounder", "managing director", "president", "vice president", "vp", "svp", "evp", "director", "head of", "chief", "partner", "owner", "general manager", "gm"]
GATEKEEPERS = ["assistant", "secretary", "receptionist", "office manager", "executive assistant", "admin", "coordinator"]
# Words that names lose or must not be.
HEADLINE_VERBS = (
    "says warns reveals announces unveils reports defends opens blamed claims denies urges seeks vows pledges slams touts mulls notches surges plunges tumbles struggles expects forecasts predicts considers expands acquires prepares faces "
    "explains loses gains rises falls beats misses raises hires joins leaves eyes dethrones debuts launches targets blocks forms leads wins hits cuts sets takes makes gives shows moves drops calls pulls pushes buys sells"
).split()
JOB_ABBREVIATIONS = "ceo cfo coo cio cto cmo cpo chro cso svp vp evp avp md gm llc llp inc ltd plc".split()
GENERIC_WORDS = (
    "company companies corporation firm firms industry industries market markets stock stocks share shares fund funds report reports analyst analysts investor investors quarter revenue intelligence search energy security technology "
    "surveillance commerce protocol discovery health solutions services systems networks dynamics phone home cloud studio digital online media group global capital venture partners management research consulting labs works"
).split()
LEADING_TITLES = "mogul tycoon billionaire millionaire filmmaker director producer analyst strategist commentator correspondent investor entrepreneur philanthropist senator governor mayor minister former late legendary veteran".split()
HYPHEN_MODIFIERS = "backed powered led owned linked funded driven based related focused connected affiliated supported sponsored endorsed controlled managed operated run built made approved certified licensed regulated".split()
ORG_SUFFIXES = (
    "inc corp corporation ltd limited llc plc co company group holdings technologies labs systems solutions services networks pharma therapeutics sciences financial international global bank partners capital ventures ai io tech web net digital"
).split()
BRAND_MODIFIERS = "pro plus max ultra air mini lite neo studio enterprise cloud home music tv prime connect health search lens".split()
#: Words of a name at most.
MOST_WORDS = 4
# Tags of sources that carry signals or noise.
SIGNAL_TAGS = ["funding", "VC", "PE", "M&A", "startup", "fintech", "payments", "press_releases", "B2B", "SaaS", "enterprise", "IPO", "unicorn", "NBFC", "banking", "insurance"]
NOISE_TAGS = ["geopolitical", "macro", "trade", "aggregator"]
# Phrases without substance.
VAGUE_PHRASES = [
    "companies need to adapt", "strategic optimization", "leverage opportunities", "navigate challenges", "various companies", "many organizations", "optimize their", "enhance their",
    "stakeholder engagement", "value chain", "holistic approach", "paradigm shift", "companies in the sector", "industry players",
]


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|-&" else c for c in word)


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(map(_quoted, words)) + ")"


def _hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, as parts of it."""
    return reduce(lambda a, w: a + F.when(text.contains(w), 1).otherwise(0), words, F.lit(0))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


# --- domains and names ---------------------------------------------------------------------------


def clean_domain(c: Column) -> Column:
    """The host of a url (or of ``www.``), else the last two labels of the first thing in the text that looks like a host; null if there is none."""
    text = F.trim(c)
    host = F.regexp_extract(F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text)), "^https?://([^/?#]*)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    looks = F.regexp_replace(F.lower(F.regexp_extract(text, r"((?:[a-zA-Z0-9][-a-zA-Z0-9]*\.)+[a-zA-Z]{2,})", 1)), r"^www\.", "")
    is_url = (text.contains("://") | text.startswith("www.")) & host.contains(".") & (F.length(host) > 3)
    return F.when(is_url, F.lower(host)).otherwise(F.nullif(F.regexp_extract(looks, r"([^.]+\.[^.]+)$", 1), F.lit("")))


def valid_domain(c: Column) -> Column:
    """Long enough, with a name before its top level, neither blacklisted nor below such a domain, and of a top level that companies use."""
    d = F.lower(F.trim(c))
    bad = d.rlike(r"(^|\.)" + _one_of(BLACKLISTED_DOMAINS) + "$") | F.element_at(F.split(d, r"\."), -1).isin(NO_COMPANY_TLDS)
    return F.coalesce((F.length(d) >= 4) & d.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$") & ~bad, F.lit(False))


def guess_domain(company: Column) -> Column:
    """The name without the endings of companies, each taken off once in their order, letters and digits only, with ``.com``."""
    n = F.lower(F.trim(company))
    for s in NAME_SUFFIXES:
        n = F.regexp_replace(n, _quoted(s) + "$", "")
    n = F.regexp_replace(n, "[^a-z0-9]", "")
    return F.when(F.length(n) >= 2, F.concat(n, F.lit(".com")))


def is_description(name: Column) -> Column:
    """Whether a text describes a kind of company and is no name: long, qualified in parentheses, or with words and phrases of descriptions."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(clean)
    tokens = _words(F.translate(low, ",()", "   "))
    qualified = low.rlike(r"\(\s*(excluding|multiple|non-|non |approx|various)[^)]*\)")
    phrases = reduce(lambda a, p: a | low.contains(p), DESCRIPTOR_PHRASES, F.lit(False))
    top = low.rlike(r"^top [+-]?[0-9]+ +\S")
    return (clean == "") | (F.size(_words(clean)) > 8) | qualified | F.arrays_overlap(tokens, F.array(*map(F.lit, DESCRIPTOR_WORDS))) | phrases | top


def clean_name(c: Column) -> Column:
    """An entity's name without possessives, articles, titles, open parentheses and what headlines leave at its end; empty if it is none."""
    n = F.trim(F.regexp_replace(F.regexp_replace(c, "[\\u00a0\\u200b\\u200c\\u200d\\ufeff]+", " "), r"\s+", " "))
    low, words = F.lower(n), F.size(_words(n))
    turns = F.length(F.regexp_replace(n, "[a-z][A-Z]", "###")) - F.length(n)
    acronym = F.exists(_words(n), lambda w: (F.length(w) > 8) & w.rlike("[A-Z]{3,}[a-z]"))
    bad = low.isin(JOB_ABBREVIATIONS) | ((words == 1) & low.isin(GENERIC_WORDS)) | (words > MOST_WORDS) | ((turns >= 1) & (words >= 3)) | ((turns >= 2) & (words >= 2)) | acronym
    out = F.regexp_replace(n, r"(?i)['’]s(?=\s|$)", "")
    out = F.regexp_replace(out, r"(?i)^(?:the|a|an)\s+", "")
    for _ in range(MOST_WORDS - 2):  # only names of three words or more lose a title
        out = F.regexp_replace(out, r"(?i)^" + _one_of(LEADING_TITLES) + r"\s+(?=\S+\s+\S)", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*\([^)]*$", ""), "[.,;:!?]+$", ""))
    return F.when(bad, "").otherwise(strip_noise(out))


def strip_noise(name: Column) -> Column:
    """Takes one thing off the end of a name at a time (an attribution, a year, a number, an abbreviation, a verb, a modifier) until nothing is left to take or one word remains.

    A name has few words, so as many rounds as words bring the fixpoint.
    """
    rules = [(r"\s+-\s+.*$", 2), (r"\s+(?:19|20)\d{2}\s*$", 2), (r"\s+\d(?:\.\d+)?\s*$", 2), (r"\s+[A-Z]{1,3}\s*$", 3), (r"(?i)\s+" + _one_of(HEADLINE_VERBS) + r"\s*$", 2), (r"(?i)-" + _one_of(HYPHEN_MODIFIERS) + r"\s*$", 2)]

    def once(out: Column) -> Column:
        step = None
        for pattern, least in rules:
            new = F.trim(F.regexp_replace(out, pattern, ""))
            takes = (F.size(_words(out)) >= least) & (new != out) & (new != "")
            step = F.when(takes, new) if step is None else step.when(takes, new)
        return step.otherwise(out)

    return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_WORDS)), name, lambda out, _: once(out))


def valid_variant(variant: Column, canonical: Column) -> Column:
    """Whether a longer name is a form of a canonical one: what it adds are endings of companies and brands, and one unknown word at most."""
    own, more = _words(F.lower(canonical)), _words(F.lower(variant))
    extra = F.transform(F.filter(more, lambda t: ~F.array_contains(own, t)), lambda t: F.regexp_replace(t, "[.,;:!?]+$", ""))
    known = F.array(*[F.lit(w) for w in (*ORG_SUFFIXES, *BRAND_MODIFIERS)])
    unknown = F.filter(extra, lambda t: ~F.array_contains(known, t))
    wrong = F.arrays_overlap(unknown, F.array(*[F.lit(w) for w in (*HEADLINE_VERBS, *GENERIC_WORDS)]))
    return (F.size(more) <= F.size(F.array_distinct(own))) | (~F.coalesce(wrong, F.lit(False)) & (F.size(unknown) < 2))


# --- stories -------------------------------------------------------------------------------------


def passes_prefilter(title: Column, url: Column) -> Column:
    """A title of 15 characters or more, no noise host, no noise title."""
    t, u = F.trim(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (F.length(t) >= 15) & (_hits(u, NOISE_DOMAINS) == 0) & ~t.rlike(NOISE_TITLE)


def event_type(text: Column) -> Column:
    """The event type whose keywords weigh most (phrases 2, words 1, short words as whole ones only); the first of equals, ``general`` without any."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "-", "_")

    def score(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            hit = low.rlike(r"\b" + _quoted(w) + r"\b") if " " not in w and len(w) <= 4 else low.contains(w)
            total += F.when(hit, 2 if " " in w else 1).otherwise(0)
        return total

    best = F.array_min(F.array(*[F.struct((-score(w)).alias("minus"), F.lit(k).alias("at"), F.lit(kind).alias("kind")) for k, (kind, w) in enumerate(EVENT_KEYWORDS.items())]))
    return F.when(low.isin(list(EVENT_KEYWORDS)), low).when(best["minus"] < 0, best["kind"]).otherwise("general")


def oss(text: Column, has_entity: Column, has_industry: Column) -> Column:
    """Operational specificity: an entity, a verb of action, numbers, an industry."""
    action = text.rlike(r"(?i)\b(launch|acquir|rais|expand|partner|invest|hire|layoff|regulat|approv|fund|merge|deploy|integrat|adopt)\w*")
    numbers = text.rlike(r"\$[\d.]+[BMK]?|\d+%|\d{4}")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.round(0.35 * one(has_entity) + 0.25 * one(action) + 0.25 * one(numbers) + 0.15 * one(has_industry), 3)


def severity(strategic: Column, coherence: Column) -> Column:
    by = lambda c, high, medium: F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")
    return F.when(strategic > 0, by(strategic, 0.50, 0.25)).otherwise(by(coherence, 0.70, 0.50))


def actionability(level: Column, coherence: Column, oss_score: Column) -> Column:
    """Severity, specificity and coherence by weight, never above what the severity allows."""
    of = lambda values, other: reduce(lambda a, kv: a.when(F.lower(level) == kv[0], kv[1]), list(values.items())[1:], F.when(F.lower(level) == list(values)[0], list(values.values())[0])).otherwise(other)
    raw = 0.40 * of({"high": 1.0, "medium": 0.6, "low": 0.3, "negligible": 0.1}, 0.4) + 0.30 * oss_score + 0.30 * coherence
    return F.round(F.least(raw, of({"high": 1.0, "medium": 0.85, "low": 0.55, "negligible": 0.25}, 0.65)), 3)


def trend_level(score: Column) -> Column:
    return F.when(score >= 0.65, "major").when(score < 0.40, "minor").otherwise("sub")


def label_is_valid(label: Column, text: Column) -> Column:
    """Three to eight words with a proper noun and no markup, and a summary of two to four sentences."""
    words = _words(label)
    proper = F.exists(words, lambda w: (w.rlike("^[A-Z]") & (w != F.upper(w))) | ((w == F.upper(w)) & w.rlike("[A-Z]") & (F.length(w) > 1)))
    sentences = F.size(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))
    return F.size(words).between(3, 8) & ~label.rlike(r"<[^>]+>|https?://|\*\*|__|\[.*?\]") & proper & (F.length(text) >= 20) & sentences.between(2, 4)


def impact_confidence(citations: Column, kinds: Column, reasoning: Column, pains: Column, justifications: Column, pitch: Column, roles: Column, chances: Column, sectors: Column) -> Column:
    """Six parts, each of how much there is and how concrete it is, less what is vague; 0.05 to 0.95."""
    size = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>")))
    share = lambda a, cond: F.when(size(a) > 0, F.size(F.filter(a, cond)) / size(a)).otherwise(0.0)
    part = lambda a, most, cond: 0.5 * F.least(F.lit(1.0), size(a) / most) + 0.5 * share(a, cond)
    evidence = part(citations, 10, lambda c: c.rlike(r"\d+\.?\d*\s*%|₹|\$|USD|INR|\d{4}|\d+\s*(crore|lakh|billion|million|employees|companies|firms)"))
    special = part(kinds, 6, lambda c: c.rlike(r"(?i)\d+[-–]\d+\s*employee|\d+\s*employee|\d+[-–]\d+\s*staff|tier[- ]?[123]|small|mid[- ]?size|SME|MSME"))
    paragraphs = F.size(F.filter(F.split(reasoning, "\n"), lambda p: F.length(F.trim(p)) > 40))
    depth = 0.6 * F.least(F.lit(1.0), F.length(reasoning) / 3000) + 0.4 * F.least(F.lit(1.0), paragraphs / 5)
    pain = part(pains, 6, lambda c: c.rlike(r"(?i)if\s|will\s|must\s|by\s+Q[1-4]|deadline|%|\d+\s*(crore|lakh|million|billion)"))
    service = part(justifications, 4, lambda c: F.length(c) > 30)
    one = lambda c: F.when(c, 1).otherwise(0)
    checks = (one(F.length(F.coalesce(pitch, F.lit(""))) > 30) + one(size(roles) >= 2) + one(size(chances) >= 2) + one((size(sectors) > 0) & (size(kinds) > 0))) / 4
    vague = F.least(F.lit(0.15), 0.03 * _hits(F.lower(F.concat(reasoning, F.coalesce(pitch, F.lit("")))), VAGUE_PHRASES))
    total = 0.25 * evidence + 0.20 * special + 0.20 * depth + 0.15 * pain + 0.10 * service + 0.10 * checks - vague
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), total)), 2)


# --- contacts ------------------------------------------------------------------------------------


def seniority_tier(role: Column) -> Column:
    low = F.lower(F.trim(role))
    return F.when(_hits(low, DECISION_MAKERS) > 0, "decision_maker").when(_hits(low, GATEKEEPERS) > 0, "gatekeeper").otherwise("influencer")


def reach(email: Column, confidence: Column, verified: Column, linkedin: Column, tier: Column, relevance: Column, ml_seniority: Column, phone: Column) -> Column:
    """0 to 100: how likely a contact answers, by its channels, tier and fit."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    ml = F.lower(F.coalesce(ml_seniority, F.lit("")))
    level = F.when((ml == "executive") & (tier != "decision_maker"), "decision_maker").when((ml == "junior") & (tier == "decision_maker"), "influencer").otherwise(tier)
    score = F.when(verified, 40.0).when(has(email), F.least(confidence * 0.4, F.lit(32.0))).otherwise(0.0)
    score += F.when(has(phone), 10.0).otherwise(0.0) + F.when(has(linkedin), 10.0).otherwise(0.0)
    score += F.when(level == "decision_maker", 20.0).when(level == "influencer", 15.0).when(level == "gatekeeper", 5.0).otherwise(10.0) + relevance * 20
    score = F.when(level == "gatekeeper", F.least(score, F.lit(40.0))).otherwise(score)
    score = F.when(~has(email) & ~has(phone), F.least(score, F.lit(35.0))).otherwise(score)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score).cast("int")))


def outreach_tone(tier: Column) -> Column:
    return F.when(tier == "decision_maker", "executive").when(tier == "gatekeeper", "professional").otherwise("consultative")


def email_choice(a: Column, a_confidence: Column, b: Column, b_confidence: Column, pattern: Column) -> Column:
    """(email, confidence, via) of the first good answer: one source from 60 on, another from 50 on, else the pattern at 40."""
    answer = lambda e, c, via: F.struct(e.alias("email"), c.cast("int").alias("confidence"), F.lit(via).alias("via"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(a) & (a_confidence >= 60), answer(a, a_confidence, "first")).when(has(b) & (b_confidence >= 50), answer(b, b_confidence, "second")).when(has(pattern), answer(pattern, F.lit(40), "pattern"))


def in_size_band(employees: Column, low: int, high: int) -> Column:
    """The first whole number of a text like ``1,001-5,000`` lies in [low, high); unknown sizes pass."""
    n = F.nullif(F.regexp_extract(F.replace(F.coalesce(employees, F.lit("")), F.lit(","), F.lit("")), "([0-9]+)", 1), F.lit("")).cast("long")
    return n.isNull() | ((n >= low) & (n < high))


def opening_line(company: Column, trend: Column, mechanism: Column, kind: Column, weeks: Column) -> Column:
    """The first lines of a message, by the kind of lead."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(kind == "pain", text(company, " faces a concrete challenge: ", mechanism, ". This will likely materialize within ", weeks.cast("string"), " weeks. We help companies navigate exactly this kind of pressure."))
        .when(kind == "opportunity", text("The recent ", F.lower(trend), " creates a specific opening for ", company, ". ", mechanism, ". Companies that move in the next ", weeks.cast("string"), " weeks capture the most value."))
        .when(kind == "risk", text(company, " carries elevated risk right now: ", mechanism, ". Our risk intelligence platform can help quantify and mitigate this exposure."))
        .otherwise(text("Given the recent ", F.lower(trend), ", ", company, " stands to benefit from sharper competitive intelligence. ", mechanism, "."))
    )


# --- arms ----------------------------------------------------------------------------------------


def informed_prior(tags: Column) -> Column:
    """(alpha, beta) of a source by its tags."""
    some = lambda words: F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, words))), F.lit(False))
    of = lambda a, b: F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"))
    return F.when(some(SIGNAL_TAGS), of(3.0, 1.0)).when(some(NOISE_TAGS), of(1.0, 3.0)).otherwise(of(1.0, 1.0))


def arm_relevance(posterior: Column, industry: Column, intent: Column, level: Column) -> Column:
    """How well a company fits a trend: its arm's posterior, industry, intent and severity by weight."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    weight = F.when(F.lower(level) == "high", 1.0).when(F.lower(level) == "low", 0.4).otherwise(0.7)
    return unit(0.35 * posterior + 0.30 * unit(industry) + 0.20 * unit(intent) + 0.15 * weight)


def lead_reward(registered: Column, company: Column, confidence: Column, before: Column) -> Column:
    """What a lead teaches its arm: registered companies most, placeholders least, less if its cluster's leads were poor before."""
    reward = F.when(F.coalesce(registered, F.lit("")) != "", F.least(F.lit(1.0), confidence + 0.2)).when(~company.startswith("["), confidence * 0.7).otherwise(0.1)
    return reward * F.when(F.coalesce(before, F.lit(1.0)) < 0.3, 0.7).otherwise(1.0)


def names_company(body: Column, company: str) -> Column:
    """How a lower-case text names a company: ``name`` as a whole, ``parts`` by three fifths of its words (two at least), ``word`` if it has one word, ``none``."""
    low = company.lower()
    parts = low.split()
    whole = body.rlike(r"\b" + _quoted(low) + r"\b")
    if len(parts) < 2:
        return F.when(whole, "word").otherwise("none")
    return F.when(whole, "name").when(_hits(body, parts) >= max(2, int(len(parts) * 0.6)), "parts").otherwise("none")


def normal_names(names, aliases):
    """(name, normal): ``names`` without what surrounds them, and the company of a ticker."""
    n = F.regexp_replace(F.regexp_replace(F.col("name"), r"(?i)['’]s(?=\s|$)", ""), r"(?i)^" + _one_of(LEADING_TITLES) + r"\s+", "")
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r"(?i)\s+" + _one_of(HEADLINE_VERBS) + "$", ""), r"\s+(?:19|20)\d{2}$", ""), r"(?i)-" + _one_of(HYPHEN_MODIFIERS) + "$", "")
    return names.select("name", F.trim(n).alias("n")).join(aliases, F.upper("n") == F.col("ticker"), "left").select("name", F.coalesce("company", "n").alias("normal"))


def field_near(text: Column, keywords: list[str]) -> Column:
    """The value after a colon near the first keyword that has one: up to a full stop, 50 characters at most; empty if there is none."""
    body = F.coalesce(text, F.lit(""))
    values = []
    for k in keywords:
        at = F.instr(F.lower(body), k)
        value = F.regexp_extract(F.substr(body, at, F.lit(80)), r"(?s)^[^:]*:\s*([^.]*)", 1)
        values.append(F.when(at > 0, F.nullif(F.left(F.trim(value), F.lit(50)), F.lit(""))))
    return F.coalesce(*values, F.lit(""))
