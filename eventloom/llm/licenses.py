"""License scan by canonical digests: texts and lines that say the same have the same digest."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import small_side, whole_text, written

#: Spellings that count as the same.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"),
)

#: Lines that name a holder or claim rights, which differ between copies of one license.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:\(c\)|\x{a9}|copyright[ \t]+(?:\(c\)|\x{a9}|[0-9])|all rights reserved)[^\n]*$"

#: Words of which every known text has one; a text without any can't be known.
MARKERS = r"licen[cs]|permission|redistribution|warrant|public domain"

#: Known whole texts, as their publishers word them.
TEXTS = {
    "MIT": (
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}
#: Known one-line notices.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
}

#: Titles that MIT and ISC texts carry or leave out.
TITLES = {"MIT": ("", "The MIT License ", "The MIT License (MIT) ", "MIT License (MIT) "), "ISC": ("", "The ISC License ", "ISC License (ISC) ", "The ISC License (ISC) ")}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "{2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def more_texts() -> list[tuple[str, str]]:
    """Known whole texts beyond TEXTS: other titles, BSD, and those in known_licenses, each also without its appendix."""
    out = [(name, title + TEXTS[name].removeprefix(f"{name} License ")) for name, titles in TITLES.items() for title in titles]
    for title in ("", "{} License "):
        for numbers in (("1. ", "2. ", "3. "), ("", "", "")):
            out.append(("BSD-2-Clause", title.format("BSD 2-Clause") + _BSD.format(*numbers[:2], "")))
            out.append(("BSD-3-Clause", title.format("BSD 3-Clause") + _BSD.format(*numbers[:2], numbers[2] + _NAMES)))
    for path in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if rest.strip():
            out += [(path.stem, terms + end), (path.stem, terms)]
    return out


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for any run of other than letters and digits, one spelling."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, same in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(same))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _digested(known: DataFrame) -> DataFrame:
    return known.select("license", "kind", digest(F.col("text")).alias("digest"))


def known_texts(spark: SparkSession) -> DataFrame:
    """The known texts and notices: license, kind (text or notice), text."""
    rows = [(name, "text", text) for name, text in [*TEXTS.items(), *more_texts()]] + [(name, "notice", text) for name, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "license string, kind string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    """The known texts and notices by digest."""
    return _digested(known_texts(spark)).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Look each whole text and each of its lines up among the known digests.

    known is a table of license, kind (text or notice) and text, known_texts() unless given;
    licenses whose texts have one digest are listed together, comma-joined.

    Returns one row per input row: doc_id, text_license (the known text that the whole
    text equals, else null), notices (the licenses of its lines that equal a known notice,
    sorted, comma-joined, else empty), n_notices (long, such lines). Only texts and lines
    with one of the words that every known text has are digested, which leaves none out.
    The known digests are a fixed short list and are broadcast; the documents' digests are
    a narrow table, in which a text's lines are gathered again by row. Null texts count as
    empty, repeated rows have equal results, an empty table gives an empty result, and
    other columns are not read.
    """
    text = whole_text(text_col)
    known = known_texts(docs.sparkSession) if known is None else known
    every = known.filter(~F.coalesce(F.lower("text").rlike(MARKERS), F.lit(False))).isEmpty()
    marked = lambda c: F.lower(c).rlike(MARKERS) if every else F.lit(True)
    lines = F.transform(F.filter(F.split(text, "\n", -1), marked), digest)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(marked(text), digest(text)).alias("whole"), F.when(marked(text), lines).otherwise(F.array().cast("array<string>")).alias("lines"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-digests")
    known = written(_digested(known).groupBy("kind", "digest").agg(F.array_sort(F.collect_set("license")).alias("licenses")), "license-known")
    texts = small_side(known.filter("kind = 'text'").select(F.col("digest").alias("whole"), F.array_join("licenses", ",").alias("text_license")))
    notices = small_side(known.filter("kind = 'notice'").select(F.col("digest").alias("line"), "licenses"))
    some = rows.filter("whole is not null").join(texts, "whole", "left")
    some = some.select("row", "doc_id", "text_license", F.explode_outer("lines").alias("line")).join(notices, "line", "left")
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("licenses")))), ",")
    some = some.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_license").alias("text_license"), names.alias("notices"), F.count("licenses").alias("n_notices"))
    none = rows.filter("whole is null").select("doc_id", F.lit(None).cast("string").alias("text_license"), F.lit("").alias("notices"), F.lit(0).cast("long").alias("n_notices"))
    return none.unionByName(some.drop("row"))
