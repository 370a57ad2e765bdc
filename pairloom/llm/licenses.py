"""License scans by canonical digest, with DataFrame functions only.

A text is put into a canonical form and its SHA-256 is looked up among the digests of known licence texts. The
same is done for each line, for notices within other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, as (variant, form).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Known licence texts and notices, as (id, text).
KNOWN = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# Title lines that a licence's file may begin with or not, in canonical spelling.
TITLES = [
    "mit license",
    "the mit license",
    "mit license mit",
    "the mit license mit",
    "expat license",
    "isc license",
    "isc license isc",
    "the isc license",
    "bsd zero clause license",
    "zero clause bsd license",
    "bsd 2 clause license",
    "bsd 3 clause license",
    "the bsd 2 clause license",
    "the bsd 3 clause license",
    "bsd 2 clause simplified license",
    "bsd 3 clause new or revised license",
    "zlib license",
    "the zlib license",
    "zlib libpng license",
]

# Digests of longer licences' whole files in canonical form, as (id, digest); tests compare them with the files
# where a machine has them.
KNOWN_DIGESTS = [
    ("Apache-2.0", "e54d72b4475d38e8ac691465cfb3533349778f63a32af127056c574c123b5dcf"),
    ("GPL-2.0", "2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae"),
    ("GPL-3.0", "d83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "797da5d4e9dafcb728632460f1b236d20d0aa8b1f838aa5911bd9f74276d611e"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]

#: Everything that separates words: ASCII but letters, digits and line ends, and common typographic marks.
MARKS = r"[\x00-\x09\x0B-/:-`{-\x7F ©‐-―‘-‟•…]+"
#: Signs that stand for the word copyright.
SIGNS = r"\(c\)|©"
#: After canonical spelling of a line: "copyright (c) X", "copyright 2020 X", "(c) 2020 X", "copyright [year] X", "copyright by X", "all rights
#: reserved". A year alone makes no copyright line.
COPYRIGHT = r"^(copyright copyright |(copyright )+([0-9]{4}|year |yyyy |by )|all rights reserved$)"


def canonical_lines(text: Column) -> Column:
    """The lines of a text: lower case, SIGNS as a word, runs of MARKS as one space, equal spellings unified; copyright lines, empty
    lines, and a title of TITLES as the first line left, are gone."""
    forms = F.create_map(*[F.lit(s) for pair in SPELLINGS for s in pair])
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SIGNS, " copyright "), MARKS, " ")
    lines = F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT))
    variant = r"\b(" + "|".join(v for v, _ in SPELLINGS) + r")\b"
    spelt = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")
    lines = F.transform(lines, lambda x: F.when(x.rlike(variant), spelt(x)).otherwise(x))
    return F.filter(lines, lambda x, i: (i > 0) | ~x.isin(TITLES))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(digest, license_id) of known texts and of known digests; of texts with one canonical form the first id counts."""
    rows = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(known)], "k int, license_id string, text string")
    of = digest(F.array_join(canonical_lines(F.col("text")), " "))
    given = spark.createDataFrame([(d, len(known) + k, i) for k, (i, d) in enumerate(digests)], "digest string, k int, license_id string")
    return rows.select(of.alias("digest"), "k", "license_id").unionByName(given).groupBy("digest").agg(F.min_by("license_id", "k").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, max_known: int = 100_000, text: str = "text", into: str = "license") -> DataFrame:
    """docs with one more column `into`: struct<digest, license_id, notices>.

    digest is that of the whole text's canonical form and license_id the known licence with this digest, else
    null. notices are the ids, sorted, of known texts that a single line equals. Null, empty and
    copyright-only texts share one digest, that of the empty text, and have no licence. Repeated rows get
    equal results; an empty table stays empty; a column named `into` is replaced, others stay.

    known (digest, license_id) is broadcast: more than max_known rows are refused.
    """
    ids = known.limit(max_known + 1).collect()
    if len(ids) > max_known:
        raise ValueError(f"more than {max_known} known digests")
    nothing = F.create_map().cast("map<string,string>")
    of_digest = F.create_map(*[F.lit(v) for r in ids for v in (r.digest, r.license_id)]) if ids else nothing
    lines = docs.withColumn("__lines", canonical_lines(F.col(text)))
    whole = lines.withColumn("__digest", digest(F.array_join("__lines", " ")))
    # isin over many values is a hash set; only what it lets through is looked up in the map, which is read from its start
    hits = F.filter(F.transform("__lines", lambda x: digest(x)), lambda d: d.isin([r.digest for r in ids]))
    notices = F.transform(hits, lambda d: F.try_element_at(of_digest, d))
    joined = whole.join(F.broadcast(known.select(F.col("digest").alias("__known"), F.col("license_id").alias("__license"))), F.col("__digest") == F.col("__known"), "left")
    found = F.struct(F.col("__digest").alias("digest"), F.col("__license").alias("license_id"), F.array_sort(F.array_distinct(notices)).alias("notices"))
    return joined.select(*[F.col(c) for c in docs.columns if c != into], found.alias(into))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> str:
    """DuckDB SQL for doc_id, digest, license_id, notices over documents."""
    marks = r"[\x00-\x09\x0B-/:-`{-\x7F\x{00A0}\x{00A9}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"
    forms = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS) + "}"
    rows = ", ".join(f"({k}, {_quoted(i)}, {_quoted(t)})" for k, (i, t) in enumerate(known))

    given = "".join(f" UNION ALL SELECT {_quoted(d)}, {_quoted(i)}, {len(known) + k}" for k, (i, d) in enumerate(digests))
    titles = ", ".join(map(_quoted, TITLES))

    def lines(text: str) -> str:
        raw = f"string_split(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_quoted(SIGNS)}, ' copyright ', 'g'), {_quoted(marks)}, ' ', 'g'), chr(10))"
        kept = f"list_filter(list_transform({raw}, lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(COPYRIGHT)}))"
        spelt = f"list_transform({kept}, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce({forms}[w], w)), ' '))"
        return f"list_filter({spelt}, lambda x, i: i > 1 OR x NOT IN ({titles}))"

    return f"""
WITH known AS (
  SELECT digest, min_by(license_id, k) AS license_id FROM (
    SELECT sha256(array_to_string({lines("t")}, ' ')) AS digest, license_id, k FROM (VALUES {rows}) AS v(k, license_id, t){given}
  ) GROUP BY 1
), own AS (SELECT doc_id, {lines("text")} AS lines FROM documents),
notice AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM own) JOIN known USING (digest) GROUP BY doc_id
)
SELECT own.doc_id, sha256(array_to_string(lines, ' ')) AS digest, known.license_id, coalesce(notices, '') AS notices
FROM own LEFT JOIN known ON sha256(array_to_string(lines, ' ')) = known.digest LEFT JOIN notice ON own.doc_id = notice.doc_id
"""
