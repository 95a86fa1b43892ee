"""License scans by canonical digest.

A text is brought into a canonical form: copyright lines go, letters become
lower case, equivalent spellings become one, and whatever is no letter or digit
becomes one space. The SHA-256 of the whole canonical text is joined to the
digests of known licenses in the same form. Every line is looked up in the same way,
which finds the notices of one line that stand inside other texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, slim

#: Up to so many known licenses are looked up in each line's task, by a map that is gone through; with more, distinct digests are joined by hash.
LOOKED_UP = 500

# A copyright line (the word with a sign or a year, so no line of a wrapped clause), and spellings that count as the same.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n©]*(?:copyright[^\n]*(?:\(c\)|©|[0-9]{4})|©|\(c\))[^\n]*"
EQUIVALENT = (
    ("licence", "license"),
    ("sub[- ]license", "sublicense"),
    ("non[- ]?infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owners?", "copyright holder"),
    ("copyright holders", "copyright holder"),
    ("https://", "http://"),
    ("per cent", "percent"),
    ("&", " and "),
)
OTHER = r"[^\p{L}\p{N}]+"

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, '
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Licenses known without a table of them; the texts without their copyright lines.
KNOWN = {
    "MIT": _MIT,
    "MIT-titled": "MIT License " + _MIT,
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    "0BSD": _ISC + "." + _ISC_END,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}
# Digests of the canonical forms of whole licenses as their publishers give them out; a test makes them anew from the texts.
DIGESTS = {
    "Apache-2.0": "0be25ae8b112b6c47bf696a745855eebba678079747ad8bbf877d928555027f1",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "BSD-3-Clause-UC": "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "fdbd790ae9850ae81a2c777de181b7ceb77f56f8916bab9409c3a7724c8f131a",
    "GFDL-1.3": "9af8b09a25e07e574718758cdf5a64581433b2e9f0cd27bd6665cce5b182563b",
    "GPL-1.0": "b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f",
    "GPL-2.0": "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123",
    "GPL-3.0": "ab0ff01b5102d67da216e91690a50504aebf46513a85db94155933b2db63283f",
    "LGPL-2.0": "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769",
    "LGPL-2.1": "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "7f7a609103d49ef139df4ae6d94daa56e3f924838b03840831300356510a8766",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for a text of copyright lines alone."""
    c = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, SPACE, " ")  # a spelling may be wrapped over two lines
    for spelling, one in EQUIVALENT:
        c = F.regexp_replace(c, spelling, one)
    return F.trim(F.regexp_replace(c, OTHER, " "))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """``license_id, text, digest``: licenses by their text, or by the digest of its canonical form."""
    rows = [(i, t, None) for i, t in (KNOWN if texts is None else texts).items()]
    rows += [(i, None, d) for i, d in ((DIGESTS if texts is None else {}) if digests is None else digests).items()]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def license_scan(docs: DataFrame, known: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, license_id, digest, line_licenses``.

    ``license_id`` is null for a text that is no known license; ``line_licenses``
    lists, sorted and once each, those that a line of the text is.

    ``known`` has ``license_id`` and ``text`` or ``digest``; of licenses alike in
    canonical form the smallest name counts, null names and empty forms don't. A
    null text counts as empty and matches nothing. Repeated rows each get their row;
    an empty table gives none. Other columns are ignored. Texts are read once and
    never shuffled. Up to LOOKED_UP known digests are broadcast; with more, each row's
    distinct line digests are joined to them, and rows put together again by a number
    of their own. The result is the same either way.
    """
    form = canonical(F.coalesce("text", F.lit("")))
    own = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    k = known.select("license_id", F.coalesce(own, F.when(form != "", F.sha2(form, 256))).alias("digest"))
    k = k.where("digest is not null and license_id is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    d = slim(docs, doc_id, text)
    whole = F.sha2(canonical(F.col("text")), 256).alias("digest")
    if k.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        table = k.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("known"))
        lines = F.transform(F.split("text", "\n"), lambda x: F.try_element_at("known", F.sha2(canonical(x), 256)))
        d = d.join(F.broadcast(table)).select("doc_id", whole, F.array_sort(F.array_distinct(F.array_compact(lines))).alias("line_licenses"))
        return d.join(F.broadcast(k), "digest", "left").select("doc_id", "license_id", "digest", "line_licenses")
    forms = F.filter(F.transform(F.split("text", "\n"), canonical), lambda x: x != "")
    lines = F.array_distinct(F.transform(forms, lambda x: F.sha2(x, 256)))
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole, lines.alias("lines"))
    d = d.select("row", "doc_id", "digest", F.explode_outer("lines").alias("line"))
    d = d.join(k.select(F.col("digest").alias("line"), F.col("license_id").alias("found")), "line", "left")
    d = d.groupBy("row", "doc_id", "digest").agg(F.array_sort(F.collect_set("found")).alias("line_licenses"))
    return d.join(k, "digest", "left").select("doc_id", "license_id", "digest", "line_licenses")
