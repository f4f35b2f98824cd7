"""Call sheets, impacts, labels of stories and company checks as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rank


def sheets_with_people(sheets: DataFrame, persons: DataFrame) -> DataFrame:
    """Call sheets with their people in the order of ids; a sheet without a contact takes the first."""
    p = persons.groupBy("run_id", "company").agg(F.array_sort(F.collect_list(F.struct("id", "name", "email"))).alias("people"))
    j = sheets.join(p, ["run_id", "company"], "left")
    own = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.get("people", F.lit(0))[other])
    return j.select("run_id", "company", own("contact", "name").alias("contact"), own("email", "email").alias("email"), F.coalesce(F.size(F.when(F.col("people").isNotNull(), F.col("people"))), F.lit(0)).cast("long").alias("people_count"), F.coalesce(F.array_join(F.transform("people", lambda x: x["name"]), ","), F.lit("")).alias("people"))


def result_assembly(sheets: DataFrame, persons: DataFrame, pitches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each company with its first contact that has an email (else its first), its first outreach and its profile."""
    k = persons.groupBy("company").agg(F.min_by("name", F.struct(F.col("email").isNull(), F.col("id"))).alias("contact"))
    o = pitches.groupBy("company").agg(F.min_by("body", "pos").alias("outreach"))
    return sheets.select("company").distinct().join(k, "company", "left").join(o, "company", "left").join(profiles, "company", "left")


def template_hops(trends: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """Two hops of each trend by template, where nothing better is known."""
    m = F.coalesce("mechanism", F.lit("Market event creates demand for consulting intelligence"))
    sector = F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), ", ")).otherwise("general")
    urgent = F.col("event_type").isin("crisis", "regulation")
    hop = lambda n, segment, kind, how, weeks, c: F.struct(F.lit(n).alias("hop"), segment.alias("segment"), kind.alias("kind"), how.alias("mechanism"), weeks.alias("weeks"), F.lit(c).alias("confidence"))
    first = hop(1, F.concat(F.lit("Companies in "), sector, F.lit(" sector")), F.when(urgent, "pain").otherwise("opportunity"), m, F.when(urgent, 2).otherwise(4), 0.45)
    second = hop(2, F.concat(F.lit("Suppliers and service providers to "), sector, F.lit(" companies")), F.lit("intelligence"), F.concat(F.lit("Downstream effect: "), F.lower(m)), F.lit(6), 0.40)
    j = trends.join(F.broadcast(mechanisms), "event_type", "left")  # eight rows
    return j.select("trend_id", F.explode(F.array(first, second)).alias("h")).select("trend_id", "h.*")


def basic_impact(t: DataFrame) -> DataFrame:
    """The impact of a trend by template, below the gate of sure ones."""
    return t.select("trend_id", F.array_join(F.slice("industries", 1, 4), ",").alias("direct"), F.concat(F.lit("Capitalize on "), "title").alias("chance"), F.concat(F.lit("Expert insights on "), F.left("title", F.lit(50)), F.lit("...")).alias("pitch"), F.lit(0.35).alias("confidence"))


def keyword_roles(keys: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles of the types that a keyword holds or is part of, the default ones without any; five at most, by name."""
    known = roles.filter("kind <> 'default'")
    k = keys.select("trend_id", F.explode(F.transform("keywords", F.lower)).alias("k"))
    hits = k.join(F.broadcast(known), F.contains("k", "kind") | F.contains("kind", "k")).select("trend_id", F.explode("roles").alias("role"))  # a short list of types
    found = keys.select("trend_id").join(hits.groupBy("trend_id").agg(F.collect_set("role").alias("found")), "trend_id", "left")
    other = F.broadcast(roles.filter("kind = 'default'").select(F.col("roles").alias("other")))
    return found.join(other).select("trend_id", F.array_join(F.slice(F.array_sort(F.coalesce("found", "other")), 1, 5), ",").alias("roles"))


def council_orders(t: DataFrame) -> DataFrame:
    """Companies hit first and second: as told, else by marks of evidence, else the first and the second half; four each."""
    marked = lambda k: F.upper(k).rlike("EVIDENCE:|ARTICLE:|NAMED IN|CITED IN")
    x = t.withColumn("shown", F.filter("kinds", marked)).withColumn("half", F.greatest(F.lit(1), F.floor(F.size("kinds") / 2).cast("int")))
    told, some = F.size("first_kinds") > 0, F.size("shown") > 0
    first = F.when(told, F.col("first_kinds")).when(some, F.col("shown")).otherwise(F.slice("kinds", F.lit(1), F.col("half")))
    second = F.when(told, F.col("second_kinds")).when(some, F.concat("second_kinds", F.filter("kinds", lambda k: ~marked(k)))).otherwise(F.slice("kinds", F.col("half") + 1, F.size("kinds") + 1))
    four = lambda c: F.array_join(F.slice(c, 1, 4), "|")
    return x.select("id", four(first).alias("first_order"), four(second).alias("second_order"))


def trend_quality(t: DataFrame) -> DataFrame:
    """Sizes and mean coherence of a run's clusters, and whether it has to be done again."""
    g = t.groupBy("run").agg(F.count("*").alias("clusters"), F.coalesce(F.avg(F.when(F.col("coherence") > 0, F.col("coherence"))), F.lit(0.0)).alias("c"), F.array_join(F.transform(F.sort_array(F.collect_list("size"), False), lambda s: s.cast("string")), ",").alias("sizes"))
    return g.select("run", "clusters", F.round("c", 3).alias("coherence"), "sizes", F.when((F.col("c") < 0.4) | (F.col("clusters") < 3), "RETRY").otherwise("PASS").alias("verdict"))


def industry_relevance(t: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Whether companies are of the industry ``biotech``: by name, by parts, by synonyms, by shared words, or by two synonyms in what they say of themselves; unknown ones pass."""
    q = F.lit("biotech")
    words = F.broadcast(synonyms.filter("query = 'biotech'").select("words"))
    parts = F.transform(F.split(F.lower("industry"), r"\|"), F.trim)
    either = lambda a: F.exists(a, lambda p: F.contains(p, q) | F.contains(q, p))
    subs = F.transform("subs", F.lower)
    fields = F.concat_ws(" ", F.array_join(parts, " "), F.array_join(subs, " "))
    shared = F.arrays_overlap(F.split(F.array_join(parts, " "), " "), F.split(q, " "))
    says = F.size(F.filter("words", lambda w: F.contains(F.lower(F.coalesce("description", F.lit(""))), w))) >= 2
    relevant = F.col("industry").isNull() | (F.col("industry") == "") | either(parts) | either(subs) | F.exists("words", lambda w: F.contains(fields, w)) | shared | says
    return t.join(words).select("id", relevant.alias("relevant"))


def rule_labels(t: DataFrame) -> DataFrame:
    """A label and a summary of each cluster by rule: the first short title with its most frequent name, and the first sentences of three articles."""
    names = t.select("cluster_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("([A-Z][a-z]{2,})"), F.lit(1)))).alias("name"))
    counts = names.groupBy("cluster_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = rank.first_of(counts, ["cluster_id"], [F.desc("n"), F.col("first"), F.col("name")]).select("cluster_id", "name")
    first = F.trim(F.element_at(F.split("summary", "[.]"), 1))
    j = t.join(top, "cluster_id").withColumn("first", first)
    fits = F.contains("title", "name") & (F.size(F.split("title", " ")) <= 10)
    bodies = F.array_sort(F.collect_list(F.when((F.col("pos") <= 3) & (F.length("first") > 30), F.struct("pos", F.concat("first", F.lit(".")).alias("s")))))
    g = j.groupBy("cluster_id").agg(F.coalesce(F.min_by(F.when(fits, F.col("title")), F.when(fits, F.col("pos"))), F.min_by("title", "pos")).alias("title"), bodies.alias("b"))
    label = F.array_join(F.slice(F.split("title", " "), 1, 8), " ")
    return g.select("cluster_id", label.alias("label"), F.left(F.coalesce(F.nullif(F.array_join(F.transform("b", lambda x: x["s"]), " "), F.lit("")), label), F.lit(500)).alias("summary"))


def person_boost(t: DataFrame) -> DataFrame:
    """Companies gain where a sentence names them with a person of the title."""
    together = F.exists(F.split(F.lower("summary"), "[.!?]"), lambda s: F.contains(s, F.lower("person")) & F.contains(s, F.lower("company")))
    hit = F.contains(F.lower("title"), F.lower("person")) & together
    return t.select("id", "company", F.round(F.when(hit, F.least(F.lit(1.0), F.col("salience") + 0.12)).otherwise(F.col("salience")), 4).alias("salience"))


def scope_mode(t: DataFrame) -> DataFrame:
    """What a run is about: as told, else its profile, its companies, its industries, or a report."""
    some = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)) > 0
    return t.select("id", F.when(F.coalesce("explicit", F.lit("")) != "", F.col("explicit")).when(some("profile"), "profile").when(some("companies"), "company").when(some("industries"), "industry").otherwise("report").alias("mode"))


def query_expansion(t: DataFrame) -> DataFrame:
    """Queries out of a model's lines: numbers and dashes off, more than 5 and fewer than 80 characters, four at most."""
    lines = F.transform(F.split(F.coalesce("raw", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(\d+[.)]|[-*])\s*", "")))
    return t.select("id", F.array_join(F.slice(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 80)), 1, 4), "|").alias("queries"))


def type_correction(t: DataFrame) -> DataFrame:
    """Predicted types of names that they match, from a score of 0.30 on; a company becomes a product only with a model's number in its name."""
    a, b = F.lower("name"), F.lower("predicted")
    kept = ((a == b) | F.contains(a, b) | F.contains(b, a)) & (F.col("score") >= 0.30)
    doubt = (F.col("own") == "ORG") & (F.col("kind") == "PRODUCT") & ~F.col("name").rlike("[0-9]")
    return t.select("id", kept.alias("kept"), F.when(kept & ~doubt, F.col("kind")).otherwise(F.col("own")).alias("kind"))
