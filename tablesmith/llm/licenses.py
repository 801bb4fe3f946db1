"""Operator 4: license scans by canonical digests of entire texts, hash-joined to those of known licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import lookup

#: Equivalent spellings, as words.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("favour", "favor"), ("merchantibility", "merchantability")]
#: Known licenses beyond which the digests are joined by a shuffle instead of a broadcast.
BROADCAST_LICENSES = 10_000

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Texts of well-known licenses by their SPDX names.
LICENSES = {
    "MIT": f"""MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"Zero-Clause BSD\n{_ISC}.\n{_ISC_END}",
    "BSD-2-Clause": f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_END}",
    "BSD-3-Clause": f"""BSD 3-Clause License\n{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.\n{_BSD_END}""",
    "Zlib": """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

COPYRIGHT_LINE = r"(?m)^[^\p{L}\n©]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words only (one space between), equivalent spellings made one; null: null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, canonical_digest, license_id, a row per input row.

    known has license_id and text. An entire text matches if its canonical form does; of known licenses with one
    canonical form the first name counts. Null texts have a null digest; texts of no words match no license. The
    digests of few known licenses are broadcast; of more they are joined by a shuffle that spreads hot digests.
    """
    named = known.where("text is not null and license_id is not null").withColumn("canonical_digest", digest(F.col("text"))).where(canonical(F.col("text")) != "")
    named = named.groupBy("canonical_digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("canonical_digest"))
    if named.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES:
        return rows.join(F.broadcast(named), "canonical_digest", "left").select("doc_id", "canonical_digest", "license_id")
    counts = rows.groupBy("canonical_digest").agg(F.count(F.lit(1)).alias("n"))
    return lookup(rows, named.join(counts, "canonical_digest"), "canonical_digest", "n", F.col("doc_id")).select("doc_id", "canonical_digest", "license_id")


def known_licenses(spark) -> DataFrame:
    """The built-in texts as a table (license_id, text)."""
    return spark.createDataFrame(sorted(LICENSES.items()), "license_id string, text string")


def read_licenses(spark, folder: str) -> DataFrame:
    """A table (license_id, text) of the text files of a folder, such as a checked-out SPDX list: MIT.txt is `MIT`."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("license_id"), F.col("value").alias("text"))
    return files.select(F.url_decode("license_id").alias("license_id"), "text")
