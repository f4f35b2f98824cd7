"""Licence scan by canonical digests."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table

# Spellings that count as the same word, after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("colour", "color"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"), ("modernise", "modernize"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("recognise", "recognize"), ("utilise", "utilize"),
    ("wilful", "willful"), ("copyright holder", "copyright owner"), ("percent", "per cent"), ("https", "http"),
]

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
)

# Known licence texts and notices.
LICENSES = [
    ("MIT", "MIT License\n" + _PERMISSION + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT", "The MIT License\n" + _PERMISSION + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT", _PERMISSION + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT-0", "MIT No Attribution\n" + _PERMISSION.replace(", subject to the following conditions:", ".") + "\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + "\n1. " + _BSD_1 + "\n2. " + _BSD_2 + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n1. " + _BSD_1 + "\n2. " + _BSD_2 + "\n3. " + _BSD_3 + "\n" + _BSD_TAIL),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", _ISC + ".\n" + _ISC_TAIL),
    ("Unlicense", _UNLICENSE + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

# Fixed values: (name, words, SHA-256 of the canonical text) of the long licences, from the texts that Debian installs in /usr/share/common-licenses.
DIGESTS = [
    ("Apache-2.0", 1609, "4f4efc99b21676427023f964ba9cf67d7063cce2d807400514641d03c8fc64e3"),
    ("Artistic-1.0", 983, "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 3315, "b1f65daa9629999daa8f6054cae35d89d60ee1849ea0b7633e5344aa68b9b338"),
    ("GFDL-1.3", 3732, "5b157581d13408f14fb2a5239bf7cd819b15b3b79a5bb413122811f990dd30d2"),
    ("GPL-1.0", 2068, "2b62a0899e7031347a9577241eb9b504d0eafb4d91b28e1f99580099701d0a1a"),
    ("GPL-2.0", 2976, "d3d1ea54d09952fcd9626a8c4c7c325e00c7f6febdc41bf004285919d6bfaa0a"),
    ("GPL-3.0", 5684, "d0789f68ce73b9e5aca95bb2dba2f119b08a484f0c2b8875edd430f7ac40622c"),
    ("LGPL-2.0", 4200, "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.1", 4401, "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3790, "a423ad6d373d0bbd7aff7a4a1d2f6f4a2553f8bf186d5e34301c2a32360fc4e3"),
    ("MPL-2.0", 2427, "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5"),
]

#: A line that only says who holds the copyright (by a year, a sign or a name), or that all rights are reserved.
_COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*((?i:copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|(?i:copyright[ \t]*\(c\))[^\n]*|(?i:copyright)?[ \t]*©[^\n]*|Copyright( by| [A-Z][a-z][^ \t\n,;:]*){1,6}[.,]?|(?i:all rights reserved)\.?)[ \t]*($|(\n))"
)
_PUNCTUATION = r"[^a-z0-9\x80-\x{10FFFF}]+"
#: The copyright pattern eats the line break that a following copyright line starts with, so it runs this often.
_PASSES = 2
#: One-word spellings that become two words; all others keep the number of words.
_LONGER = [old for old, new in SPELLINGS if new.count(" ") > old.count(" ")]


def _without_copyright(c: Column) -> Column:
    for _ in range(_PASSES):
        c = F.regexp_replace(c, _COPYRIGHT_LINE, "$1$5")
    return c


def _words(c: Column) -> Column:
    """Lower-case words, one blank between them."""
    return F.trim(F.regexp_replace(ascii_lower(c), _PUNCTUATION, " "))


def _spelt(words: Column) -> Column:
    """One spelling; each word has blanks of its own, so that neighbours are all found."""
    c = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def _n_words(words: Column) -> Column:
    """How many words a line has once it is spelt: a cheap and exact test of which known texts it can be."""
    longer = F.regexp_count(words, F.lit(f"(?<![^ ])({'|'.join(_LONGER)})(?![^ ])"))
    rare = F.coalesce(*[F.when(words.contains(w), longer) for w in _LONGER], F.lit(0))
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1 + rare


def canonical(c: Column) -> Column:
    """Text that two copies of a licence share: lower case, no copyright lines, no punctuation, one spelling."""
    return _spelt(_words(_without_copyright(F.coalesce(c, F.lit("")))))


def canonical_text(text: str) -> str:
    """``canonical`` for one Python string."""
    t = text
    for _ in range(_PASSES):
        t = re.sub(_COPYRIGHT_LINE, lambda m: m[1] + (m[5] or ""), t)
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    t = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", t).strip(" ")
    t = " " + t.replace(" ", "  ") + " "
    for old, new in SPELLINGS:
        t = t.replace(f" {old.replace(' ', '  ')} ", f" {new.replace(' ', '  ')} ")
    return re.sub(" +", " ", t).strip(" ")


def _digest(canonical: str) -> str:
    return hashlib.sha256(canonical.encode()).hexdigest()


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = LICENSES, digests: list[tuple[str, int, str]] = DIGESTS) -> DataFrame:
    """(license_digest, n_words, license_id) of the given texts and digests; of several names of one digest the first counts."""
    rows = {d: (d, n, name) for name, n, d in reversed(digests)}
    for name, t in reversed(texts):
        c = canonical_text(t)
        rows[_digest(c)] = _digest(c), len(c.split()), name
    return spark.createDataFrame(sorted(rows.values()), "license_digest string, n_words long, license_id string")


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id, n_notices, notices: which known licence a text or its lines are.

    The canonical text's SHA-256 is hash-joined to the known digests, so a text is found when all
    of it is one licence, whatever its case, punctuation, copyright line or spelling.  The lines
    of longer texts are looked up the same way (``notices``: sorted distinct licence ids,
    ``n_notices``: lines that are one); of those only lines with as many words as a known text
    are spelt out and hashed.  ``known``: license_digest (each once), n_words, license_id.

    Cases: a null or empty text has the digest of the empty string and no licence; a very long text
    is one digest and as many lines as it has; a null doc_id stays null, with whole-text matches
    only counted for it; repeated rows are repeated; rows that share a doc_id share their notices;
    extra columns are ignored.  A known table without rows matches nothing; no documents give no rows.
    """
    sizes = sorted(n for (n,) in known.select("n_words").distinct().collect())  # small numbers: no more than words of the longest licence
    known = known.select(F.col("license_digest").alias("_known"), "license_id")
    docs = docs.select("doc_id", F.col("text").alias("_text"))
    whole = docs.select("doc_id", F.sha2(canonical(F.col("_text")), 256).alias("digest")).join(known, F.col("digest") == F.col("_known"), "left").drop("_known")
    lines = docs.filter("doc_id is not null").select("doc_id", F.explode(F.split(F.col("_text"), "\n")).alias("_line"))
    lines = lines.select("doc_id", _words(F.col("_line")).alias("_words"))
    likely = lines.filter(_n_words(F.col("_words")).isin(sizes))
    hits = likely.select("doc_id", F.sha2(_spelt(F.col("_words")), 256).alias("_d")).join(known, F.col("_d") == F.col("_known"))
    found = hits.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(found, "doc_id", "left").withColumns({"n_notices": F.coalesce("n_notices", F.lit(0)).cast("long"), "notices": F.coalesce("notices", F.lit(""))})


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql(c: str, lines: bool = False) -> str:
    c = f"coalesce({c}, '')"
    for _ in range(0 if lines else _PASSES):
        c = f"regexp_replace({c}, '{_COPYRIGHT_LINE}', '\\1\\5', 'g')"
    c = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    c = f"' ' || replace(trim(regexp_replace({c}, '{_PUNCTUATION}', ' ', 'g'), ' '), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        c = f"replace({c}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'), ' ')"


def oracle_sql() -> str:
    rows = {d: name for name, _, d in reversed(DIGESTS)} | {_digest(canonical_text(t)): name for name, t in reversed(LICENSES)}
    values = ", ".join(f"('{d}', '{n}')" for d, n in rows.items())
    return f"""
WITH known(d, license_id) AS (VALUES {values}),
w AS (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM (SELECT doc_id, sha256({_sql('line', True)}) AS d FROM l) JOIN known USING (d) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(f.n_notices, 0) AS n_notices, coalesce(f.notices, '') AS notices
FROM w LEFT JOIN known k ON w.digest = k.d LEFT JOIN f ON f.doc_id = w.doc_id
"""
