"""Licence scans by canonical digests of entire texts.

A text is put into a canonical form (lower case, no copyright lines, no punctuation, one spelling of words that have two) and the
SHA-256 of that is joined to the digests of known licences. Entire texts are looked up: a whole document, a block between empty
lines, and a line, so licence files, licence headers and one-line notices are all found. Only units with as many words as some
known text are spelled out and digested; the spellings keep the number of words. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE

#: fixed values: words that licences spell in two ways
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
             "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "copyright-holder": "copyright-owner",
             "favour": "favor", "fulfilment": "fulfillment", "judgement": "judgment", "organisation": "organization", "programme": "program",
             "recognised": "recognized", "whilst": "while", "wilful": "willful", "noncommercial": "non-commercial"}
SPELLINGS = {k: v for k, v in SPELLINGS.items() if "-" not in k + v}

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
          "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
          "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
          "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
#: fixed values: public licence texts and notices; a caller may pass a table of its own
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
     "to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
     "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
     "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
     'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
     "or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
COPYRIGHT = r"(?m)^[^\S\n]*(?:[#*/;-]+[^\S\n]*)?(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+"


def plain(text: Column) -> Column:
    """Lower case, copyright lines emptied, punctuation and runs of blanks to one blank; line ends stay."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    t = F.regexp_replace(F.regexp_replace(t, PUNCTUATION, " "), r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(t, r" ?\n ?", "\n")


def spelled(words: Column) -> Column:
    """``words`` joined by blanks with one spelling for each; all words are looked at by one pattern."""
    once = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), " ", "  ")
    for k, v in SPELLINGS.items():
        once = F.replace(once, F.lit(f" {k} "), F.lit(f" {v} "))
    return F.trim(F.regexp_replace(once, " +", " "))


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` exploded to ``unit`` (text, block, line), ``pos`` and ``words`` (joined by blanks); units without words give none.
    A block of one line counts as line, a text of one block as block."""
    own = docs.columns
    d = docs.withColumn("_p", plain(F.col(text))).withColumn("_p", F.regexp_replace(F.trim(F.col("_p"), F.lit(" \n")), r"\n{2,}", "\n\n"))

    def flat(x):
        return F.trim(F.regexp_replace(x, SPACE, " "))

    parts = F.concat(
        F.when(F.contains(F.col("_p"), F.lit("\n\n")), F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("pos"), flat(F.col("_p")).alias("words"))))
        .otherwise(F.array().cast("array<struct<unit:string,pos:int,words:string>>")),
        F.filter(F.transform(F.split("_p", "\n\n", -1), lambda x, i: F.struct(
            F.when(F.contains(x, F.lit("\n")), F.lit("block")).alias("unit"), i.alias("pos"), flat(x).alias("words"))), lambda x: x["unit"].isNotNull()),
        F.transform(F.split("_p", "\n", -1), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("pos"), F.trim(x).alias("words"))))
    return d.select(*own, F.explode(parts).alias("_u")).select(*own, "_u.*").where("words <> ''")


def known_digests(known: DataFrame) -> DataFrame:
    """``(license_id, n_words, digest)`` of ``known(license_id, text)``."""
    d = known.select("license_id", F.trim(F.regexp_replace(plain(F.col("text")), SPACE, " ")).alias("words")).where("words <> ''")
    return d.select("license_id", F.size(F.split("words", " ", -1)).alias("n_words"), F.sha2(spelled(F.col("words")), 256).alias("digest")).distinct()


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, license_id, unit, pos, n_words)`` for each unit of a document that is a known licence text.

    Null and empty texts give none; rows that repeat give their matches each. A text known under two names gives both.
    """
    k = known_digests(known)
    sizes = [r[0] for r in k.select("n_words").distinct().collect()]  # lengths of the known texts
    u = units(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text")), "_text").select("id", "unit", "pos", "words")
    n = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    u = u.where(n.isin(sizes)).withColumn("digest", F.sha2(spelled(F.col("words")), 256))
    return u.join(k, "digest").select("id", "license_id", "unit", "pos", "n_words")
