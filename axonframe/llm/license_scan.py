"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Method: texts and templates are lower-cased words without marks at their ends, cut into 5-word shingles
(64-bit hashes). Templates fall into size classes (4, 16, 64 ... shingles). For a class of at most m shingles, texts
are cut into windows of 3m - 1 shingles every 2m shingles, so any run of m shingles lies whole in one window.
Windows and templates get a one-permutation MinHash signature: the hash space is split into bins, and the
smallest hash of each bin that is not empty is a row of the signature. Bands have one row each, so that any one
that agrees makes the window a candidate; its exact containment (share of the template's distinct shingles that the
window has) must reach ``containment``.

Collision probability: a window and a template of Jaccard similarity J share no band with odds of about
(1 - J) ** b, b being the bins that are not empty. A template of n shingles (n > m / 4) held to 0.8 has a J of
0.8 n / (3m - 1 + 0.2 n) or more, which is 0.065 at the least: with 128 bins odds of 2e-4. Windows of the classes of
up to 16 shingles are smaller than a signature; they take all their hashes as bands and lose nothing. ``tests/llm``
measures the recall.

All expressions are native. The template table is a fixed parameter; above ``BROADCAST_BANDS`` bands it
is joined by a shuffle instead of a broadcast.

Defined results: null, empty and short texts have no shingles and match nothing; long texts are scanned
whole; a document that holds a template several times is reported once with its best containment; repeated
rows and null ids group together by id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let

SHINGLE = 5
#: Bins of a signature, the smallest size class, and the largest one whose windows are taken whole.
BINS, LEAST, WHOLE = 128, 4, 16
CONTAINMENT = 0.8
BROADCAST_BANDS = 200_000

# License notices as authors place them in texts, and whole licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Marks that are cut from both ends of a word.
EDGE = "[^a-z0-9\u0080-\U0010ffff]+"


def normal_words(text: Column) -> Column:
    """Lower-cased words without marks at their ends; words of marks alone vanish."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"), F.lit(0))


def python_words(text: str) -> list[str]:
    """The same for templates, on the driver."""
    return re.findall(r"[^\W_](?:[^ \t-\r]*[^\W_])?", text.lower())


def _hashes(w: Column) -> Column:
    parts = lambda i: [F.get(w, i + k) for k in range(SHINGLE)]
    return F.when(F.size(w) < SHINGLE, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*parts(i))))


def _class(n: int) -> int:
    m = LEAST
    while m < n:
        m *= 4
    return m


def _signature(hashes: Column, m: int) -> Column:
    """Smallest hash of each bin: in sorted order, the first one of each run with equal bins. Windows of the classes up
    to ``WHOLE`` are smaller than a signature, and all their hashes are bands."""
    if m <= WHOLE:
        return hashes
    shift = 64 - BINS.bit_length() + 1

    def first(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, shift) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), shift)))

    return let(F.sort_array(hashes), first)


def _windows(h: Column, m: int) -> Column:
    """(m, j, window, bands) of every window of 3m - 1 hashes, 2m apart; the last one reaches the end."""
    last = F.ceil(F.greatest(F.size(h) - (3 * m - 1), F.lit(0)) / (2 * m)).cast("int")
    one = lambda j: let(F.slice(h, 2 * m * j + 1, 3 * m - 1), lambda w: F.struct(F.lit(m).alias("m"), j.alias("j"), w.alias("window"), _signature(w, m).alias("bands")))
    none = F.expr("cast(array() as array<struct<m: int, j: int, window: array<bigint>, bands: array<bigint>>>)")
    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(none)


def scan_licenses(spark: SparkSession, docs: DataFrame, *, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, n_windows."""
    templates = TEMPLATES if templates is None else templates
    rows = [(k, python_words(v)) for k, v in templates.items()]
    rows = [(k, w, _class(len(w) - SHINGLE + 1)) for k, w in rows if len(w) >= SHINGLE]
    classes = sorted({m for _, _, m in rows})
    if not rows:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long")
    wanted = spark.createDataFrame(rows, "license string, w array<string>, m int").select("license", "m", F.array_distinct(_hashes(F.col("w"))).alias("t_hashes"))
    bands = F.coalesce(*(F.when(F.col("m") == m, _signature(F.col("t_hashes"), m)) for m in classes))
    wanted = wanted.select("license", F.col("m").alias("t_m"), "t_hashes", F.explode(bands).alias("t_band"))
    wanted = F.broadcast(wanted) if sum(len(w) for _, w, _ in rows) <= BROADCAST_BANDS else wanted
    shingles = docs.select(F.col(id_col).alias("doc_id"), let(normal_words(F.col(text_col)), _hashes).alias("h"))
    windows = let(F.col("h"), lambda h: F.concat(*(_windows(h, m) for m in classes)))
    # The outer forms keep the optimizer from adding a filter that would cut every text a second time.
    cut = shingles.select("doc_id", F.explode_outer(windows).alias("s")).select("doc_id", "s.m", "s.j", "s.window", F.explode_outer("s.bands").alias("band"))
    shared = F.size(F.array_intersect("window", "t_hashes")) / F.size("t_hashes")
    hit = cut.join(wanted, (F.col("band") == F.col("t_band")) & (F.col("m") == F.col("t_m"))).select("doc_id", "license", "j", shared.alias("c")).where(F.col("c") >= containment)
    return hit.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.countDistinct("j").alias("n_windows"))
