"""Rules on companies, contacts, stories and leads as functions of DataFrames; ``signals`` has their queries on the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import business as B

# --- names, domains, stories: rules on rows ------------------------------------------------------


def clean_domains(t: DataFrame) -> DataFrame:
    return t.select("id", B.clean_domain(F.col("value")).alias("domain"))


def valid_domains(t: DataFrame) -> DataFrame:
    return t.select("id", B.valid_domain(F.col("value")).alias("valid"))


def guessed_domains(t: DataFrame) -> DataFrame:
    return t.select("name", B.guess_domain(F.col("name")).alias("domain"))


def description_names(t: DataFrame) -> DataFrame:
    return t.select("name", B.is_description(F.col("name")).alias("description"))


def entity_name_clean(t: DataFrame) -> DataFrame:
    return t.select("name", B.clean_name(F.col("name")).alias("clean"))


def variant_validity(t: DataFrame) -> DataFrame:
    return t.select("variant", "canonical", B.valid_variant(F.col("variant"), F.col("canonical")).alias("valid"))


def news_prefilter(t: DataFrame) -> DataFrame:
    return t.select("id", B.passes_prefilter(F.col("title"), F.col("url")).alias("kept"))


def event_types(t: DataFrame) -> DataFrame:
    return t.select("id", B.event_type(F.col("raw")).alias("event_type"))


def label_validity(t: DataFrame) -> DataFrame:
    return t.select("id", B.label_is_valid(F.col("label"), F.col("summary")).alias("valid"))


# --- scores --------------------------------------------------------------------------------------


def trend_scores(t: DataFrame) -> DataFrame:
    """Specificity, severity, actionability and level of clusters as trends."""
    text = F.concat_ws(" ", "label", "summary")
    s = t.select("cluster_id", "coherence", B.oss(text, F.col("entity").isNotNull(), F.col("industry").isNotNull()).alias("oss"), B.severity(F.col("strategic"), F.col("coherence")).alias("severity"))
    s = s.withColumn("actionability", B.actionability(F.col("severity"), F.col("coherence"), F.col("oss")))
    return s.select("cluster_id", "oss", "severity", "actionability", B.trend_level(F.col("actionability")).alias("level"))


def contact_reach(t: DataFrame) -> DataFrame:
    """Tier by title, reach by channels, tier and fit, and the tone to write in."""
    tier = B.seniority_tier(F.col("role"))
    r = B.reach(F.col("email"), F.col("email_confidence"), F.col("verified"), F.col("linkedin"), tier, F.col("relevance"), F.col("ml"), F.col("phone"))
    return t.select("id", tier.alias("tier"), r.alias("reach"), B.outreach_tone(tier).alias("tone"))


def email_cascade(t: DataFrame) -> DataFrame:
    return t.select("id", B.email_choice(F.col("a"), F.col("a_conf"), F.col("b"), F.col("b_conf"), F.col("pattern")).alias("x")).select("id", "x.*")


def size_band(t: DataFrame) -> DataFrame:
    return t.select("company", B.in_size_band(F.col("employees"), 50, 900).alias("fits"))


def impact_confidence(t: DataFrame) -> DataFrame:
    c = B.impact_confidence(*map(F.col, ("citations", "kinds", "reasoning", "pains", "services", "pitch", "roles", "chances", "sectors")))
    return t.select("trend_id", c.alias("confidence"))


# --- leads ---------------------------------------------------------------------------------------


def crystallised_leads(t: DataFrame) -> DataFrame:
    """Leads of the hops that are sure enough: up to three real companies each, else the segment as a placeholder."""
    good = t.filter("confidence >= 0.35").withColumn("good", F.filter("companies", lambda c: ~B.is_description(c)))
    p = good.withColumn("placeholder", F.size("good") == 0)
    x = p.withColumn("company", F.explode(F.when(F.col("placeholder"), F.array("segment")).otherwise(F.slice("good", 1, 3))))
    who = F.when(F.col("placeholder"), "Your business").otherwise(F.col("company"))
    opening = B.opening_line(who, F.col("trend"), F.col("mechanism"), F.col("kind"), F.col("weeks"))
    return x.select("event", "hop", "company", "placeholder", F.round(F.col("confidence") * F.when(F.col("placeholder"), 0.8).otherwise(1.0), 4).alias("confidence"), F.col("weeks").alias("urgency_weeks"), opening.alias("opening"))


def ranked_leads(leads: DataFrame, arms: DataFrame) -> DataFrame:
    """Leads re-ranked by the posterior mean of their arm; descriptions and weak ones go."""
    arm = F.concat_ws("_", F.coalesce("size_band", F.lit("mid")), F.coalesce("event_type", F.lit("general")))
    j = leads.withColumn("arm", arm).join(arms, "arm", "left").withColumn("posterior", F.coalesce(F.col("alpha") / (F.col("alpha") + F.col("beta")), F.lit(0.5)))
    score = F.least(F.lit(1.0), F.col("confidence") * (0.7 + 0.3 * B.arm_relevance(F.col("posterior"), F.lit(0.5), F.col("oss"), F.lit("medium"))))
    kept = j.select("id", "company", "urgency", F.round(score, 6).alias("confidence")).filter(~B.is_description(F.col("company")) & (F.col("confidence") >= 0.20))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "urgency", "id"))).drop("urgency")  # leads of one run: a page


def company_arm_update(leads: DataFrame, arms: DataFrame, before: DataFrame) -> DataFrame:
    """One run's update of the company arms: all decay towards the uniform prior, then each lead's reward is added."""
    arm = F.concat_ws("_", F.coalesce("size_band", F.lit("mid")), F.coalesce("event_type", F.lit("general")))
    r = leads.join(before, "cluster_id", "left").select(arm.alias("arm"), B.lead_reward(F.col("cin"), F.col("company"), F.col("confidence"), F.col("quality")).alias("reward"))
    g = r.groupBy("arm").agg(F.sum("reward").alias("won"), (F.count("*") - F.sum("reward")).alias("lost"))
    fade = lambda c: F.greatest(F.lit(1.0), 1 + (F.col(c) - 1) * 0.97)
    d = arms.select("arm", fade("alpha").alias("alpha"), fade("beta").alias("beta"))
    of = lambda prior, more: F.round(F.coalesce(prior, F.lit(1.0)) + F.coalesce(more, F.lit(0.0)), 6)
    return d.join(g, "arm", "full").select("arm", of("alpha", "won").alias("alpha"), of("beta", "lost").alias("beta"))


def source_priors(t: DataFrame) -> DataFrame:
    return t.select("source", B.informed_prior(F.col("tags")).alias("p")).select("source", "p.*")


def region_sources(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """The active sources of a region; of all regions where the region has none, or is GLOBAL."""
    active = sources.filter("active").select("source", F.col("region").alias("own"))
    exact = asked.join(active, F.col("region") == F.col("own")).select("request", "source")
    other = asked.join(active.select(F.col("own").alias("region")).distinct(), "region", "left_anti")
    return exact.unionByName(other.join(active, F.lit(True)).select("request", "source"))  # few requests against a list of sources


def source_arm_update(run: DataFrame, posteriors: DataFrame) -> DataFrame:
    """One run's update of the source arms: all decay first (never below 1.5), rewards weigh up to five articles, and no arm holds more than 200 observations."""
    fade = lambda c: F.greatest(F.lit(1.5), 1 + (F.col(c) - 1) * 0.97)
    d = posteriors.select("source", fade("alpha").alias("a"), fade("beta").alias("b"))
    of = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    reward = (
        0.30 * of("nli", 0.4) + 0.20 * of("quality", 0.5) + 0.15 * (1 - of("duplicates", 0.0)) + 0.10 * F.least(F.lit(1.0), of("richness", 2.5) / 5) + 0.10 * of("content", 0.5) + 0.10 * of("coherence", 0.5) + 0.05 * of("oss", 0.0)
    )
    r = run.select("source", F.least("articles", F.lit(5)).alias("n"), reward.alias("reward"))
    u = d.join(r, "source", "full").select("source", (of("a", 1.0) + F.coalesce(F.col("reward") * F.col("n"), F.lit(0.0))).alias("a"), (of("b", 1.0) + F.coalesce((1 - F.col("reward")) * F.col("n"), F.lit(0.0))).alias("b"))
    scale = F.least(F.lit(1.0), 200 / (F.col("a") + F.col("b")))
    return u.select("source", F.round(F.col("a") * scale, 6).alias("alpha"), F.round(F.col("b") * scale, 6).alias("beta"), F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("mean"))
