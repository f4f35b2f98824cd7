"""URL filter: longest host and path rule, else segmented words under naive Bayes."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, table

#: (verdict, host, path): the rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Pages are taken in chunks of about so many, each with the part of the models that its urls can use; the driver collects no model.
CHUNK = 1_024
#: What each letter of an unknown word costs.
LETTER = 2.0
_RUN = re.compile("[a-z]+|[0-9]+|[^\x00-\x7f]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` to ``/?#``, path from there to ``?#``; both empty without one."""
    at = "://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, at, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, at, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segment(word: str, logp: dict[str, float], total: float, lengths: list[int] | None = None) -> list[str]:
    """The most likely split of ``word`` under the unigram model; an unknown word costs more the longer it is, and of equally likely splits that with the longest last word counts.

    ``lengths``: those of the known words, ascending; no others are looked up.  The best place where
    an unknown word may begin is carried along, so words of any length count.
    """
    lengths = sorted({len(w) for w in logp}) if lengths is None else lengths
    unknown = -math.log(max(total, 2.0))
    best, back, reach, start = [0.0], [0], 0.0, 0
    for i in range(1, len(word) + 1):
        top, at = reach + unknown - LETTER * i, start
        for n in lengths:
            if n > i:
                break
            p = logp.get(word[i - n : i])
            if p is not None:
                s = best[i - n] + p
                if s > top or s == top and i - n < at:
                    top, at = s, i - n
        best.append(top)
        back.append(at)
        if top + LETTER * i > reach:
            reach, start = top + LETTER * i, i
    out, i = [], len(word)
    while i:
        out.append(word[back[i] : i])
        i = back[i]
    return out[::-1]


class Segmenter:
    """Segmentation under the counts of the words that the texts can hold, and the sum of all counts."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = float(total)
        self.logp = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})
        self.cache: dict[str, list[str]] = {}

    def words(self, text: str, mark: str) -> list[str]:
        out = []
        for run in _RUN.findall(text):
            if "0" <= run[0] <= "9":
                out.append(f"{mark}#{min(len(run), 9)}")  # a number counts by its length
                continue
            got = self.cache.get(run)
            if got is None:
                got = self.cache[run] = segment(run, self.logp, self.total, self.lengths)
            out += [mark + w for w in got]
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        return self.words(host, "h:") + self.words(path.lower(), "p:")


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): counts over all pages of words a-z, of any length.

    Words come from the text (tags, character references and host names are none) and from the
    parts of urls that are words already: the last two labels of a host, the parts of labels with
    hyphens, and the path.
    """
    host, path = split_url(F.col("url"))
    text = F.regexp_replace(F.lower("html"), r"<[^>]*>|&#?[a-z0-9]+;|[a-z0-9-]+([.][a-z0-9-]+)+", " ")
    hyphens = F.array_join(F.filter(F.split(host, "[.]"), lambda x: x.contains("-")), " ")
    words = F.split(F.concat_ws(" ", text, F.substring_index(host, ".", -2), hyphens, F.lower(path)), "[^a-z]+")
    return pages.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pieces(parsed: DataFrame, lengths: list[int]) -> DataFrame:
    """(_chunk, word): every piece of the letter runs of a chunk that is as long as some word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = defaultdict(set)
            for chunk, host, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs[chunk].update(r for r in _RUN.findall(host) + _RUN.findall(path.lower()) if "a" <= r[0] <= "z")
            for chunk, own in runs.items():
                found = list({r[i : i + n] for r in own for n in lengths if n <= len(r) for i in range(len(r) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array(found, pa.string())], ["_chunk", "word"])

    return parsed.select("_chunk", "host", "path").mapInArrow(run, "_chunk long, word string").distinct()


def tokenise(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """``parsed`` with the tokens of each page; a chunk meets the counts of its own pieces only."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    lengths = sorted(n for (n,) in counts.select(F.length("word")).distinct().collect())  # numbers up to the longest word
    known = pieces(parsed, lengths).join(counts, "word")

    def run(pages: pa.Table, words: pa.Table) -> pa.Table:
        seg = Segmenter(dict(zip(words["word"].to_pylist(), words["n"].to_pylist(), strict=True)), total)
        tokens = [seg.tokens(h, p) for h, p in zip(pages["host"].to_pylist(), pages["path"].to_pylist(), strict=True)]
        return pages.append_column("tokens", pa.array(tokens, pa.list_(pa.string())))

    kept = "page_id long, host string, path string, rule string, _verdict string, _chunk long"
    left = parsed.select("page_id", "host", "path", "rule", "_verdict", "_chunk")
    return left.groupBy("_chunk").cogroup(known.select("_chunk", "word", "n").groupBy("_chunk")).applyInArrow(run, kept + ", tokens array<string>")


def fit_bayes(tokenised: DataFrame) -> tuple[float, tuple[int, int], DataFrame]:
    """(log prior odds, smoothed sums of block and allow, (token, b, a)) from all pages that a rule decides; no rows if they are of one class."""
    labelled = tokenised.filter("_verdict is not null").select((F.col("_verdict") == "block").alias("block"), "tokens")
    seen = labelled.select("block", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a"))
    seen = materialise(seen, "bayes")
    b, a = labelled.agg(F.count_if("block"), F.count_if(~F.col("block"))).first()
    if not b or not a:  # one class only: nothing to tell apart
        return 0.0, (1, 1), seen.filter("false")
    sums = seen.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    return math.log(b / a), ((sums[0] or 0) + sums[2] + 1, (sums[1] or 0) + sums[2] + 1), seen


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score of every page.

    The longest fitting rule decides.  Where none fits, the host's and the path's letter runs are
    split by a unigram Viterbi search (word counts from the text of all pages), and a multinomial
    naive Bayes classifier, trained on all pages that a rule decides, gives the verdict:
    ``block`` if ``score``, its log odds, is above 0.  ``words`` are the segmented tokens.

    Cases: a null url, or one without ``://``, has an empty host and path, no tokens, and the
    verdict of the prior; without pages of both verdicts the score is 0 and the verdict
    ``allow``; repeated rows are judged alike; page_id may be null; extra columns are ignored; a very long url
    is split whole; of rules that fit the longest decides, and a score of 0 allows; no pages give no rows.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = materialise(parsed.withColumns({"rule": rule, "_verdict": verdict, "_row": F.monotonically_increasing_id()}), "urls")
    chunks = max(1, -(-ruled.count() // CHUNK))
    tokenised = materialise(tokenise(ruled.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks))), materialise(unigrams(pages), "words")), "tokens")
    prior, (nb, na), seen = fit_bayes(tokenised)
    used = tokenised.select("_chunk", F.explode("tokens").alias("token")).distinct().join(seen, "token").select(F.col("_chunk").alias("_at"), "token", "b", "a")

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        odds = {t: math.log((b + 1) / nb) - math.log((a + 1) / na) for t, b, a in zip(*(found[c].to_pylist() for c in ("token", "b", "a")), strict=True)}
        tokens = rows["tokens"].to_pylist()
        scores = [prior + sum(map(odds.get, t, [0.0] * len(t))) for t in tokens]
        verdicts = [v or ("block" if s > 0 else "allow") for v, s in zip(rows["_verdict"].to_pylist(), scores, strict=True)]
        return pa.Table.from_arrays(
            [*(rows[c] for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array([" ".join(t) for t in tokens], pa.string()), pa.array(scores, pa.float64())],
            ["page_id", "host", "path", "rule", "verdict", "words", "score"],
        )

    return tokenised.groupBy("_chunk").cogroup(used.groupBy("_at")).applyInArrow(score, "page_id long, host string, path string, rule string, verdict string, words string, score double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
