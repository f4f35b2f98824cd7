"""Sinks: what is written can be read back as it should be."""

from newsignal.sources import sinks
from newsignal.sources.tables import read_log


def test_nested_json(spark, tmp_path):
    parents = spark.createDataFrame([("r1", "Acme"), ("r1b", "Beta")], "company string, name string")
    children = spark.createDataFrame([("r1", 2, "b"), ("r1", 1, "a")], "company string, id int, contact string")
    sinks.write_nested(parents, children, "company", "people", ["id"], f"{tmp_path}/leads")
    out = {r["name"]: [p["contact"] for p in r["people"] or []] for r in spark.read.json(f"{tmp_path}/leads").collect()}
    assert out == {"Acme": ["a", "b"], "Beta": []}


def test_campaign_csv(spark, tmp_path):
    companies = spark.createDataFrame([("Acme", "done"), ("Beta", "done"), ("Gamma", "running")], "company string, status string")
    contacts = spark.createDataFrame([("Acme", " Ann Lee", "CFO"), ("Acme", "Bo", "CTO"), ("Gamma", "Cy", "CEO")], "company string, contact string, role string")
    emails = spark.createDataFrame([("ann lee ", "old@a.c", "s1", 1), ("Ann Lee", "new@a.c", "s2", 2)], "contact string, email string, subject string, sent_at int")
    sinks.write_campaign(sinks.campaign_rows(companies, contacts, emails), f"{tmp_path}/csv")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/csv").na.fill("").collect()
    assert sorted((r["company"], r["contact"].strip(), r["email"], r["subject"]) for r in rows) == [("Acme", "Ann Lee", "new@a.c", "s2"), ("Acme", "Bo", "", ""), ("Beta", "", "", "")]


def test_logs_and_recordings(spark, tmp_path):
    for k in (1, 2):
        sinks.append_log(spark.createDataFrame([(k, f"2024-01-0{k}")], "run int, timestamp string"), f"{tmp_path}/log")
    assert [r["run"] for r in read_log(spark, f"{tmp_path}/log", "run int, timestamp string", last=1).collect()] == [2]
    sinks.record_step(spark.range(3), str(tmp_path), "run-1", "trends", 1, 0.5)
    sinks.record_step(spark.range(2), str(tmp_path), "run-1", "leads", 2)
    manifest = spark.read.json(f"{tmp_path}/run-1/manifest").orderBy("order").collect()
    assert [(r["step"], r["rows"]) for r in manifest] == [("trends", 3), ("leads", 2)] and spark.read.json(f"{tmp_path}/run-1/leads").count() == 2


def test_only_new_articles_are_inserted(spark):
    rows = [("A title long enough", "https://a.com/x?utm_source=1", "2024-03-01 00:00:00"), ("The same page again", "https://a.com/x/", "soon"), ("short", "https://a.com/y", None), ("Another good title", "https://a.com/z", "soon")]
    incoming = spark.createDataFrame(rows, "title string, url string, published string")
    new = sinks.new_articles(incoming, spark.createDataFrame([], "id string"))
    out = {r["url"]: r["published"] for r in new.collect()}
    assert len(out) == 2 and out["https://a.com/z"] == ""
    assert sinks.new_articles(incoming, new.select("id")).count() == 0
