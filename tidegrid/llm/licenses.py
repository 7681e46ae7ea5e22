"""Licence scan by canonical digests; DataFrame operations only.

Texts are normalised (case, punctuation, copyright lines, equivalent spellings), hashed whole and
joined to digests of known licences. The units hashed are the document, and every run of whole lines that
has the first word and the number of words of a known text, however its lines are broken: single lines,
paragraphs, and licences of many lines before or after other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import stored

#: Notices and short licences, by SPDX name.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {g}General Public License as published by the Free Software Foundation{s} either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {g}General Public License for more details."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GPL.format(c=";", g="", s=";", v="2")),
    ("GPL-3.0", _GPL.format(c=":", g="", s=", ", v="3")),
    ("AGPL-3.0", _GPL.format(c=":", g="Affero ", s=", ", v="3")),
    ("Zlib", _ZLIB),
    ("MPL-2.0", _MPL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
)
#: Licences too long to hold here, by SPDX name, the first word and the number of words of their
#: normalised text, and its digest, as digested() makes them from the texts their authors publish.
KNOWN_DIGESTS: tuple[tuple[str, str, int, str], ...] = (
    ("Apache-2.0", "apache", 1571, "ecad9d81d2dc60ab3a74ca4b200a9499b291897abf9c29a618ffa590613ac5fc"),
    ("Artistic-1.0-Perl", "the", 983, "4830b8c89ffe1c2d5a0734390441c41e05f2ab57847fd3e8612e425d9af2c2fe"),
    ("CC0-1.0", "creative", 1088, "848145947eeb6d26ca56d1ec51f9cf22fbb048a57a11a264ed13a094fe9c52df"),
    ("GFDL-1.2", "gnu", 3305, "c6958aacc7be2a3924d852c3e9fdb8873ab21527111c15ae516c7ba29d7b6cdc"),
    ("GFDL-1.3", "gnu", 3710, "58c065706778d08f61c762e1c2235da5e24f0cc34605cfdb037402d6733de0fc"),
    ("GPL-1.0", "gnu", 2067, "4672e52bd9a282f7ec2569af153644487f7cce6f7913851f845ca5726a6b4341"),
    ("GPL-2.0", "gnu", 2965, "e0a00e73747a81a265c2f042933d12e485bf56185dd8217d1453c0667e1b3009"),
    ("GPL-3.0", "gnu", 5662, "088bf4f00396f90c8ab73a6090a8268fc32fa71b0de9db4a6c6aee2d090f27a6"),
    ("LGPL-2.0", "gnu", 4175, "19c64fa81c37d8b83844fee71781c90d8b3fb23dd86f5d4420d41ae5c300849a"),
    ("LGPL-2.1", "gnu", 4376, "73dbc3b37926751ca4ce08d4a13638b62ab8c65ce4fe6fc3bde3e2a01c4cc7ad"),
    ("LGPL-3.0", "gnu", 1231, "99c1a85dc9c673acfd6a330c4a68bd319185c3d6b8f4888157bf159e2ee60285"),
    ("MPL-1.1", "mozilla", 3760, "e82dbba382a72d5dc21e9069c2f0490d1caceb661f07ca554035d61cc7f06edb"),
    ("MPL-2.0", "mozilla", 2414, "6d59bdf00c77e3fdb2ab7ec1adc841fd8799df8b0b0c53aed5a5baff5938971d"),
)
#: Spellings and what they count as, applied in this order to lower-case text.
SPELLINGS = (("licence", "license"), ("licensed", "license"), ("organisation", "organization"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("version", "v"), ("https", "http"))
COPYRIGHT = r"^(?:portions )?(?:copyright\b|\(c\)|©)"
#: Known tables up to this many digests are broadcast (under 1 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def normalised_line(line: Column) -> Column:
    """Empty for copyright lines; the rest in lower case, without punctuation, whole words spelt one way."""
    low = F.trim(F.lower(line))
    out = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))  # two spaces between words: each has its own
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.when(low.rlike(COPYRIGHT), "").otherwise(F.trim(F.regexp_replace(out, " +", " ")))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _lines(text: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalised_line), lambda x: x != "")


def digested(known: DataFrame) -> DataFrame:
    """known (license, text) -> license, first, n, digest: the first word, number of words and digest of the normalised text, without repeats.

    Texts without words are left out.
    """
    text = known.select("license", F.array_join(_lines("text"), " ").alias("t")).where("t <> ''")
    return text.select("license", F.substring_index("t", " ", 1).alias("first"), F.size(F.split("t", " ")).alias("n"), _digest(F.col("t")).alias("digest")).distinct()


def built_in(spark: SparkSession) -> DataFrame:
    """The licences named here, as digested() gives them."""
    long = spark.createDataFrame(list(KNOWN_DIGESTS), "license string, first string, n int, digest string")
    return digested(spark.createDataFrame(list(KNOWN), "license string, text string")).unionByName(long)


def _units(lengths: dict[str, list[int]]) -> Column:
    """Digests of the runs of lines (of a row with lines) that begin like a known text and have as many words.

    lengths: for each first word of a known text the numbers of words of those that begin so.
    """
    # ^ marks a line's first word: no normalised line holds one
    words = F.split(F.array_join(F.transform("lines", lambda x: F.concat(F.lit("^"), x)), " "), " ")
    starts = [f"^{w}" for w in sorted(lengths)]
    n_of = F.create_map(*(x for w in sorted(lengths) for x in (F.lit(f"^{w}"), F.array(*(F.lit(n) for n in lengths[w])))))

    def at(w: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.get(w, i - 1).isin(*starts))

        def runs(i: Column) -> Column:
            whole = F.filter(F.element_at(n_of, F.get(w, i - 1)), lambda n: (i - 1 + n == F.size(w)) | F.get(w, i - 1 + n).startswith("^"))
            return F.transform(whole, lambda n: _digest(F.replace(F.array_join(F.slice(w, i, n), " "), F.lit("^"), F.lit(""))))

        return F.flatten(F.transform(hits, runs))

    # a lambda's argument is computed once, a column's expression wherever it stands
    return F.flatten(F.transform(F.array(words), at))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, text_digest, whole_license, licenses.

    text_digest is of the normalised text, whole_license the names (comma-joined) with that digest,
    licenses those whose text is the document or a run of its lines. known (license, first, n, digest) is a table that
    digested() makes, the built-in one unless given. Null and empty texts, and texts of copyright
    lines only, have no lines and match nothing. Equal rows get equal results; rows with one doc_id and
    different texts their own; a null doc_id stays. An empty known table matches nothing. Other columns are ignored.
    """
    digests = (built_in(docs.sparkSession) if known is None else known).select("license", "first", "n", "digest")
    # a licence list is metadata: its first words and lengths become part of the plan, digests are joined
    lengths = {r.first: sorted(r.n) for r in digests.groupBy("first").agg(F.collect_set("n").alias("n")).collect()}
    few = [r[0] for r in digests.select("digest").distinct().limit(BROADCAST_ROWS + 1).collect()]
    small = len(few) <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), _lines("text").alias("lines"))
    units = _units(lengths) if lengths else F.array().cast("array<string>")
    rows = rows.select("doc_id", F.sha2("t", 256).alias("own"), F.size("lines").cast("long").alias("n_lines"), _digest(F.array_join("lines", " ")).alias("text_digest"), units.alias("units"))
    units = F.array_distinct("units")
    if small:  # digests of no known licence needn't be written
        units = F.filter(units, lambda x: x.isin(few))
    rows = stored(rows.select("doc_id", "own", "n_lines", "text_digest", units.alias("units")))
    units = rows.select("doc_id", "own", "text_digest", F.explode("units").alias("digest"))
    digests = digests.select("license", "digest").distinct()
    hits = units.join(F.broadcast(digests) if small else digests, "digest").groupBy("doc_id", "own").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("digest") == F.col("text_digest"), F.col("license")))), ",").alias("whole"),
    )
    hits = hits.withColumnsRenamed({"doc_id": "h_id", "own": "h_own"})
    out = rows.drop("units").join(hits, (F.col("own") == F.col("h_own")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left")
    return out.select("doc_id", "n_lines", "text_digest", F.coalesce("whole", F.lit("")).alias("whole_license"), F.coalesce("licenses", F.lit("")).alias("licenses"))
