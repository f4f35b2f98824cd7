"""Scalar text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .business import guess_domain  # noqa: F401  a name of this module too

#: Parameters of a url that say where a reader came from.
TRACKING = ("utm_", "ref", "source", "campaign", "fbclid", "gclid")


def domain(url: Column) -> Column:
    """Host in lower case without ``www.``; ``unknown`` where there is none."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(F.nullif(F.replace(host, F.lit("www."), F.lit("")), F.lit("")), F.lit("unknown"))


def url_key(url: Column) -> Column:
    """The url up to its query, without slashes at the end; case is kept."""
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def url_canonical(url: Column) -> Column:
    """Lower case, no fragment, no slash at the end, no tracking parameters."""
    low = F.substring_index(F.regexp_replace(F.lower(url), "/+$", ""), "#", 1)
    head, query = F.regexp_replace(F.substring_index(low, "?", 1), "/+$", ""), F.regexp_extract(low, "[?](.*)$", 1)
    keep = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(F.transform(F.array(*map(F.lit, TRACKING)), lambda t: p.startswith(t)), True))
    return F.when(F.size(keep) > 0, F.concat(head, F.lit("?"), F.array_join(keep, "&"))).otherwise(head)


def article_key(url: Column) -> Column:
    """Identity of an article in a store: the first 24 digits of the SHA-256 of its canonical url."""
    return F.left(F.sha2(url_canonical(url), 256), F.lit(24))


def title_key(title: Column) -> Column:
    """Lower case, without the source after the last `` - ``, parentheses, years, quarters and punctuation, 80 characters."""
    t = F.regexp_replace(F.trim(F.lower(title)), "^(.*) - .*$", "$1")
    for pattern in (r"\([^)]*\)", r"\b20[0-9][0-9]\b", r"\bq[1-4]\b", r"[^\p{L}\p{N}_\s]"):
        t = F.regexp_replace(t, pattern, "")
    return F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(80))


def any_date(raw: Column, other: str) -> Column:
    """A time of day in UTC from the formats that feeds use; ``other`` where none fits."""
    raw = F.regexp_replace(raw, "^[A-Za-z]{3}, ", "")  # a day of the week says nothing more
    zoned = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")])
    return F.coalesce(F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz"), F.lit(other).cast("timestamp_ntz"))


def source_of_title(title: Column) -> Column:
    """What follows the last `` - `` of a title; empty where there is none."""
    return F.when(title.contains(" - "), F.trim(F.element_at(F.split(title, " - "), -1))).otherwise("")


def summary(text: Column, sentences: int = 3, limit: int = 500) -> Column:
    """The first sentences (a mark, white space, a capital), cut at ``limit`` characters with dots."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+([A-Z])", "$1\u0001$2"), "\u0001")
    s = F.array_join(F.slice(parts, 1, sentences), " ")
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 3)), F.lit("..."))).otherwise(s)


def embedding_text(title: Column, body: Column) -> Column:
    """What an embedding is made of: the title and the first 300 characters of the summary."""
    return F.concat(title, F.lit(". "), F.left(body, F.lit(300)))


def clean_text(text: Column, limit: int = 500) -> Column:
    """Empty if shorter than 3 or, beyond 10 characters, with less than half letters and spaces; cut at ``limit``."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    bad = (F.length(text) < 3) | ((letters / F.length(text) < 0.5) & (F.length(text) > 10))
    return F.when(text.isNull() | bad, "").otherwise(F.left(text, F.lit(limit)))


def company_words(name: Column) -> Column:
    """Distinct lower-case words of a company name without its legal form."""
    n = F.regexp_replace(F.lower(name), r"\b(private limited|limited|ltd|inc|corp|corporation|llc|plc|gmbh)\b", " ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(n, "[^a-z0-9]+", " "), " "), lambda w: w != ""))


def same_company(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or four fifths of the shorter one's words shared."""
    x, y = company_words(a), company_words(b)
    sx, sy = F.array_join(x, " "), F.array_join(y, " ")
    share = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return (sx != "") & (sy != "") & ((sx == sy) | sx.contains(sy) | sy.contains(sx) | (share >= 0.8))


def proper_phrases(text: Column, most: int = 4) -> Column:
    """Distinct runs of one to four capitalised words of five letters or more in all, at most ``most``."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda p: F.length(p) >= 5)), 1, most)


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def word_set(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words at white space of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), " +"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; 0 where one has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
