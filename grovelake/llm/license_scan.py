"""License scans by Dice coefficient over word bigrams (native DataFrame functions only).

Every line, every blank-separated paragraph and the whole text are compared with templates of licences, and so are windows of a
template's length anywhere in the words of the text, so that a licence inside a longer line, a comment or a file is found.
The coefficient is that of sets: twice the common distinct bigrams over the sum of both sides' distinct ones.

Sets of sizes a and b have a coefficient of at most 2 min(a, b) / (a + b), so sizes prune templates before bigrams meet. A set that
reaches the threshold with a template of t bigrams shares at least threshold * t / (2 - threshold) with it. So of any choice of
one more than all the others (the template's anchors) it shares one: texts without an anchor are done, and windows begin
where an anchor of the text falls in with its place in the template.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Whole texts of short licences, and standard notices of long ones.
_PERMISSIVE = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_2 = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
TEMPLATES = (
    ("MIT", f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_PERMISSIVE}"),
    ("BSD-2-Clause", f"{_BSD_1} {_BSD_2}"),
    ("BSD-3-Clause", f"{_BSD_1} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_2}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def template_bigrams(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> list[dict]:
    """name, order (the bigrams as they come), pairs (distinct, sorted) and anchors of each template.

    Anchors are those that the fewest templates have, that the template has once, and the longest.
    """
    made = []
    for name, text in templates:
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        order = [f"{a} {b}" for a, b in zip(words, words[1:])]
        made.append({"name": name, "order": order, "pairs": sorted({*order})})
    held = Counter(p for t in made for p in t["pairs"])
    for t in made:
        rare = sorted(t["pairs"], key=lambda p: (t["order"].count(p) > 1, held[p], -len(p), p))
        shared = -(-Fraction(str(threshold)) * len(rare) // (2 - Fraction(str(threshold))))
        t["anchors"] = rare[: len(rare) - int(shared) + 1]
    return made


def _words(segment: Column) -> Column:
    """Runs of ASCII letters and digits; every other character, a line break too, separates words."""
    return F.filter(F.split(segment, "[^A-Za-z0-9]+", -1), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        n = F.size(w) - 1
        return F.when(n > 0, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))

    return let(F.transform(words, F.lower), pairs)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_matches, n_windows, licenses (distinct names, sorted, comma-joined), best_license, best_dice.

    n_matches counts segments (lines, paragraphs, the whole of several lines) with a template at the threshold or more; a segment
    counts once, for its best template, ties to the smaller name. n_windows counts templates that some window of their length
    reaches. licenses names both; best_license is the best of the row by coefficient, ties to the smaller name. Null and empty
    texts and texts without a match have no licence: '', null, 0.0. Texts of any length are read whole, each within its row.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    made = template_bigrams(templates, threshold)
    known = F.from_json(F.lit(json.dumps(made)), "array<struct<name:string,order:array<string>,pairs:array<string>,anchors:array<string>>>")
    anchors = F.from_json(F.lit(json.dumps(sorted({a for t in made for a in t["anchors"]}))), "array<string>")
    found_type = "array<struct<d:double,name:string>>"
    none = F.array().cast(found_type)

    def dice(own: Column, t: Column) -> Column:
        """The coefficient, negated so that the least is the best, and the name."""
        met = F.size(F.array_intersect(own, t["pairs"]))
        return F.struct((-2.0 * met / (F.size(own) + F.size(t["pairs"]))).alias("d"), t["name"].alias("name"))

    def best(own: Column, near: Column) -> Column:
        fit = F.filter(near, lambda t: 2.0 * F.least(F.size(own), F.size(t["pairs"])) / (F.size(own) + F.size(t["pairs"])) >= threshold)
        return F.array_min(F.transform(fit, lambda t: dice(own, t)))

    def windows(own: Column, t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.array_contains(t["anchors"], F.element_at(own, i)))
        starts = F.array_distinct(F.transform(places, lambda i: F.greatest(F.lit(1), i - F.array_position(t["order"], F.element_at(own, i)).cast("int") + 1)))
        return F.array_min(F.transform(starts, lambda s: dice(F.array_distinct(F.slice(own, s, F.size(t["order"]))), t)))

    text = F.coalesce(F.col("_text"), F.lit(""))
    paragraphs = F.when(F.instr(text, "\n\n") > 0, F.filter(F.split(text, "\n{2,}", -1), lambda p: F.instr(p, "\n") > 0)).otherwise(F.array().cast("array<string>"))
    lines = F.split(text, "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.concat(lines, paragraphs, whole), lambda x: F.array_distinct(_bigrams(_words(x))))

    def matches(own: Column, hits: Column) -> Column:
        def some(near: Column) -> Column:
            whole_segments = F.filter(F.transform(F.filter(segments, lambda x: F.arrays_overlap(x, hits)), lambda x: best(x, near)), lambda m: m["d"] <= -threshold)
            parts = F.filter(F.transform(near, lambda t: windows(own, t)), lambda m: m["d"] <= -threshold)
            return F.struct(whole_segments.cast(found_type).alias("s"), parts.cast(found_type).alias("w"))

        return F.when(F.size(hits) > 0, let(F.filter(known, lambda t: F.arrays_overlap(t["anchors"], hits)), some)).otherwise(F.struct(none.alias("s"), none.alias("w")))

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("_id", let(_bigrams(_words(text)), lambda own: let(F.array_intersect(own, anchors), lambda hits: matches(own, hits))).alias("m"))
    all_ = F.concat("m.s", "m.w")
    first = F.array_min(all_)
    return found.select(
        F.col("_id").alias(id_col), F.size("m.s").cast("long").alias("n_matches"), F.size("m.w").cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(all_, lambda x: x["name"]))), ",").alias("licenses"),
        first["name"].alias("best_license"), F.coalesce(-first["d"], F.lit(0.0)).alias("best_dice"),
    )
