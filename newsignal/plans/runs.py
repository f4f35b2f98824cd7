"""Run histories, learnt thresholds and arms, stored companies and lead lists as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import business as B
from ..operators import rank, runs
from ..operators.store import Scratch


def adaptation_freeze(t: DataFrame) -> DataFrame:
    """Whether thresholds are frozen after each run: quality below 0.4 adds up over the last five runs, and a good run thaws first."""
    return runs.freeze(t, "loop", "run", "quality")


def adapted_thresholds(t: DataFrame) -> DataFrame:
    """Four thresholds after each run: smoothed steps towards guarded targets, faster the surer the system is."""
    return runs.adapt(t, "loop", "run")


def loop_health(t: DataFrame) -> DataFrame:
    """How much better runs are in which a loop was active; 0.5 if that can't be told."""
    on_ = F.col("status") == "updated"
    g = t.groupBy("loop").agg(F.count("*").alias("n"), F.avg(F.when(on_, F.col("oss"))).alias("active"), F.avg(F.when(~on_, F.col("oss"))).alias("idle"))
    told = (F.col("n") >= 3) & F.col("active").isNotNull() & F.col("idle").isNotNull()
    return g.select("loop", F.round(F.when(told, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 5 * (F.col("active") - F.col("idle"))))).otherwise(0.5), 6).alias("health"))


def regressions(t: DataFrame) -> DataFrame:
    """Runs that fell by more than a tenth in specificity and 15 hundredths in actionable trends against the last five, and the run to go back to."""
    last = Window.partitionBy("loop").orderBy("run").rowsBetween(-5, -1)
    before = Window.partitionBy("loop").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    b = t.select("loop", "run", "oss", "actionable", F.avg("oss").over(last).alias("o"), F.avg("actionable").over(last).alias("a"), F.count("*").over(last).alias("n"))
    r = b.withColumn("regressed", F.coalesce((F.col("n") >= 2) & (F.col("oss") < 0.9 * F.col("o")) & (F.col("actionable") < 0.85 * F.col("a")), F.lit(False)))
    return r.select("loop", "run", "regressed", F.when(F.col("regressed"), F.max(F.when(~F.col("regressed"), F.col("run"))).over(before)).alias("rollback_to"))


def learning_status(t: DataFrame) -> DataFrame:
    """The report of each loop: runs, rates, the last score and the median quality."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return t.groupBy("loop").agg(
        F.count("*").alias("runs"), rate(F.col("status") == "updated").alias("active_rate"), rate(F.col("noise") > 0.4).alias("noisy_rate"), F.round(F.avg(1 - F.col("pass_rate")), 4).alias("rejection_rate"),
        F.round(F.max_by("oss", "run"), 4).alias("last_oss"), F.round(F.percentile("quality", 0.5), 4).alias("median_quality"),
    )


def cross_pollination(arms: DataFrame, signals: DataFrame) -> DataFrame:
    """Small tweaks between loops: with few new trends the three best sources gain, with many the settled company arms loosen."""
    k = rank.top_per_key(arms.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))), "kind", [F.desc("mean"), F.col("arm")], 1 << 30)
    j = k.join(F.broadcast(signals))  # one row
    gain, loosen = (F.col("kind") == "source") & (F.col("rank") <= 3) & (F.col("birth") < 0.3), (F.col("kind") == "company") & (F.col("birth") > 0.4) & (F.col("alpha") + F.col("beta") > 15)
    fade = lambda c: 1 + (F.col(c) - 1) * 0.97
    return j.select("arm", F.round(F.when(gain, F.col("alpha") + 0.3 * F.col("budget")).when(loosen, fade("alpha")).otherwise(F.col("alpha")), 6).alias("alpha"), F.round(F.when(loosen, fade("beta")).otherwise(F.col("beta")), 6).alias("beta"))


def source_ranking(t: DataFrame) -> DataFrame:
    """The fifteen best sources by their posterior mean, with how much was observed of each."""
    s = t.filter("kind = 'source'").withColumn("m", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    best = s.orderBy(F.desc("m"), "arm").limit(15)
    return best.select("arm", F.round("m", 6).alias("mean"), (F.col("alpha") + F.col("beta") - 2).cast("long").alias("observations"), F.row_number().over(Window.orderBy(F.desc("m"), "arm")).alias("rank"))


def contact_arms(roles: DataFrame, priors: DataFrame) -> DataFrame:
    """Arms of roles: priors by category and company size, what was earned, and the rank by posterior mean."""
    j = roles.join(F.broadcast(priors), "category", "left")  # a dozen rows
    more = F.when((F.col("size") == "enterprise") & F.col("category").isin("CEO", "Founder"), 2.0).when((F.col("size") == "smb") & F.col("category").isin("VP", "Director", "Head of"), 1.0).otherwise(0.0)
    total = lambda f: F.aggregate(F.transform("rewards", f), F.lit(0.0), lambda a, x: a + x)
    won = total(lambda x: F.when(x >= 1, F.least(x, F.lit(1.5)) / 1.5).otherwise(F.greatest(x, F.lit(0.0))))
    lost = total(lambda x: F.when(x >= 1, 0.0).otherwise(1 - F.greatest(x, F.lit(0.0))))
    u = j.select("role", "size", (F.coalesce("a", F.lit(2.0)) + won).alias("a"), (F.coalesce("b", F.lit(2.0)) + more + lost).alias("b"))
    return u.select("role", "size", F.round("a", 4).alias("alpha"), F.round("b", 4).alias("beta"), F.row_number().over(Window.orderBy(F.desc(F.round(F.col("a") / (F.col("a") + F.col("b")), 9)), "role")).alias("rank"))


def auto_labels(t: DataFrame) -> DataFrame:
    """Labels from sure scores and rejections, each text once, neither class more than twice the other."""
    l = t.select("id", "text", F.when(F.col("score") >= 0.85, 1).when(F.col("rejected"), 0).alias("label")).filter("label is not null")
    work = Scratch(t.sparkSession)
    once = work.keep(rank.first_of(l, [F.md5("text")], [F.col("id")]).select("id", "label"))
    sizes = once.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    out = work.keep(rank.smallest(once, "label", "id", 2 * min(sizes["pos"], sizes["neg"]), work))
    work.drop_all_but(out)
    return out


# --- stored companies and contacts ---------------------------------------------------------------


def company_lookup(asked: DataFrame, saved: DataFrame) -> DataFrame:
    """The stored row of a company, whatever its case, if it was looked up in the last week; enriched ones first."""
    fresh = saved.filter("searched >= timestamp '2024-03-03 00:00:00'").select(F.lower("name").alias("k"), "id", ((F.coalesce("description", F.lit("")) != "") | (F.coalesce("headquarters", F.lit("")) != "")).alias("rich"))
    best = fresh.groupBy("k").agg(F.min(F.struct((~F.col("rich")).alias("poor"), "id")).alias("b"))
    return asked.join(best, F.lower("name") == F.col("k"), "left").select("name", F.col("b.id").alias("id"))


def industry_search(t: DataFrame) -> DataFrame:
    """Companies of an industry: by the industry itself, a part of it, or their description, in that order of weight."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    score = one(F.lower("industry") == "steel", 1.0) + one(F.exists("sub_industries", lambda s: F.lower(s).contains("steel")), 0.5) + one(F.lower(F.coalesce("description", F.lit(""))).contains("steel"), 0.25)
    return t.select("id", score.alias("score")).filter("score > 0")


def profile_fields(t: DataFrame) -> DataFrame:
    """Accounts and industry out of stored JSON profiles; nothing where they lack."""
    p = F.from_json("profile", "targets array<string>, industry string")
    return t.select("id", F.coalesce(p["targets"], F.array().cast("array<string>")).alias("targets"), p["industry"].alias("industry"))


def lead_list(memory: DataFrame, recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """One page of leads: memory before recordings before the store, each company once, the surest first."""
    every = memory.withColumn("src", F.lit(0)).unionByName(recorded.withColumn("src", F.lit(1))).unionByName(stored.withColumn("src", F.lit(2)))
    once = rank.first_of(every, [F.lower("company")], [F.col("src"), F.col("company")]).filter("confidence >= 0.35")
    first = once.orderBy(F.desc("confidence"), "company").limit(3)
    return first.select("company", "confidence", F.row_number().over(Window.orderBy(F.desc("confidence"), "company")).alias("rank")).filter("rank >= 2")


def run_list(live: DataFrame, stored: DataFrame) -> DataFrame:
    """The three newest runs: those in memory, and those of the store that memory doesn't have."""
    return live.unionByName(stored.join(live.select("run_id"), "run_id", "left_anti")).orderBy(F.desc("started")).limit(3)


def fill_if_empty(existing: DataFrame, registry: DataFrame, searched: DataFrame) -> DataFrame:
    """What is known stays, what is empty is filled by the registry, then by search; each source is named once."""
    cols = lambda df, tag: df.select("name", *[F.nullif(F.col(c), F.lit("")).alias(f"{c}_{tag}") for c in ("website", "employees")], F.lit(tag).alias(tag))
    j = existing.join(cols(registry, "registry"), "name", "left").join(cols(searched, "search"), "name", "left")
    of = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"{c}_registry"), F.col(f"{c}_search")).alias(c)
    named = F.array_compact(F.array("registry", "search"))
    return j.select("name", of("website"), of("employees"), F.array_join(F.array_sort(F.array_union("sources", named)), ",").alias("sources"))


def entity_validation(names: DataFrame, found: DataFrame) -> DataFrame:
    """Descriptions are rejected; else the answer of search, of the registry, of a heuristic, or a guessed domain at 0.5."""
    order = F.when(F.col("source") == "search", 1).when(F.col("source") == "registry", 2).otherwise(3)
    best = found.groupBy("name").agg(F.min_by(F.struct("source", "domain", "confidence"), order).alias("b"))
    bad = B.is_description(F.col("name"))
    j = names.join(best, "name", "left")
    return j.select("name", F.when(bad, "rejected").otherwise(F.coalesce("b.source", F.lit("guess"))).alias("via"), F.when(~bad, F.coalesce("b.domain", B.guess_domain(F.col("name")))).alias("domain"), F.when(bad, 0.0).otherwise(F.coalesce("b.confidence", F.lit(0.5))).alias("confidence"))


def causal_context(leads: DataFrame, trends: DataFrame, impacts: DataFrame) -> DataFrame:
    """Leads with their trend, by id or else by title, and that trend's impact."""
    a = trends.select("trend_id", F.col("title").alias("a_title"), F.col("oss").alias("a_oss"), F.col("trend_id").alias("a_id"))
    b = trends.select(F.col("title").alias("trend"), F.col("oss").alias("b_oss"), F.col("trend_id").alias("b_id"))
    j = leads.drop("oss").join(a, "trend_id", "left").join(b, "trend", "left")
    j = j.select("company", "trend", F.coalesce("a_id", "b_id").alias("trend_id"), F.coalesce("a_oss", "b_oss", F.lit(0.0)).alias("oss"), F.coalesce("a_title", "trend").alias("title"))
    return j.join(impacts, "title", "left").select("company", "trend", "trend_id", "oss", "pitch")


def lead_companies(t: DataFrame) -> DataFrame:
    """Each company of the leads once, by the first twelve digits of its name's MD5, with its events and best confidence."""
    g = t.groupBy(F.lower("company").alias("k")).agg(F.min(F.struct((-F.col("confidence")).alias("m"), "company")).alias("b"), F.count("*").alias("leads"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("events"), F.max("confidence").alias("confidence"))
    return g.select(F.left(F.md5("k"), F.lit(12)).alias("id"), F.col("b.company").alias("name"), "leads", "events", "confidence")


def lead_confidence(t: DataFrame) -> DataFrame:
    """Mean confidence of each trend's leads, and the share of sure ones."""
    return t.groupBy("trend").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count("*").alias("leads"), F.round(F.avg((F.col("confidence") >= 0.5).cast("int")), 4).alias("sure_share"))


def campaign_rollup(t: DataFrame) -> DataFrame:
    """Totals of a campaign and its state: running while any company is, failed if none is done."""
    g = t.agg(F.count("*").alias("companies"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "running")], F.sum("contacts").alias("contacts"), F.sum("emails").alias("emails"))
    return g.select("companies", "done", "failed", "contacts", "emails", F.when(F.col("running") > 0, "running").when(F.col("done") == 0, "failed").otherwise("done").alias("status"))


def trend_signal(t: DataFrame) -> DataFrame:
    """Of each trend's hops the share for which companies were known."""
    return t.groupBy("trend_id").agg(F.count("*").alias("hops"), F.round(F.avg((F.size("companies") > 0).cast("int")), 4).alias("kb_hit_rate"))


def reply_fields(t: DataFrame) -> DataFrame:
    """Label, summary and score out of answers in prefixed lines, empty where the answer says none; a score of 0.6 passes."""
    raw = F.coalesce("raw", F.lit(""))
    part = lambda name: F.trim(F.translate(F.regexp_extract(raw, rf"(?im)^\s*{name}:[ \t]*(.*)$", 1), "*", ""))
    known = lambda c: F.when(F.lower(c).isin("none", "n/a", "null", "unknown", "-"), "").otherwise(c)
    score = F.nullif(part("score"), F.lit("")).cast("double")
    return t.select("id", known(part("label")).alias("label"), known(part("summary")).alias("summary"), score.alias("score"), F.coalesce(score >= 0.6, F.lit(False)).alias("passed"))


def pattern_emails(people: DataFrame, patterns: DataFrame) -> DataFrame:
    """Addresses by a domain's pattern, ``{first}.{last}`` where it has none; people of one name have no address."""
    words = F.split(F.lower(F.trim("name")), r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    out = F.coalesce("pattern", F.lit("{first}.{last}"))
    for mark, value in (("{first}", first), ("{last}", last), ("{f}", F.left(first, F.lit(1))), ("{l}", F.left(last, F.lit(1)))):
        out = F.replace(out, F.lit(mark), value)
    return people.join(patterns, "domain", "left").select("name", F.when(F.size(words) >= 2, F.concat(out, F.lit("@"), "domain")).alias("email"))


def ordered_roles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two role lists as one in order, each role once whatever its case; for a large company the heads of it come last; eight at most."""
    every = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    once = rank.first_of(every, [F.lower("item")], [F.col("src"), F.col("pos")])
    order = Window.orderBy(F.lower("item").rlike("(ceo|cfo|cto|coo|founder|chief)"), "src", "pos")  # two short lists
    return once.select("item", F.row_number().over(order).alias("rank")).filter("rank <= 8")
