"""Licence scan: windows of a text's normalised words are compared to licence templates by the Dice coefficient of their sets of
word bigrams. Words are read across line breaks, so wrapped notices, comment signs and notices within a line do not matter.

A window starts at any of the text's bigrams that the template has, spans at most as many words as the template, and ends
with the last such bigram in there. With a bigrams in the template, a window needs between t / (2 - t) * a and (2 - t) / t * a of its
own to reach the threshold t, and at least t / (2 - t) * a that are the template's. So a template is only tried where that
many of its bigrams lie within its length; no window that reaches the threshold is lost by this.

Windows of one template that overlap make a stretch, of which the best one counts (then the longest, then the first); a notice
repeated without a break may make one stretch. Of stretches of different templates whose best windows overlap, the one of most
weight stays, which is Dice times length, so that a whole header beats the notice in it (ties: by Dice, then start, then name in
order of code point).

A null or empty text has no licence; texts of fewer than two words have no bigrams and match nothing; repeated rows are
alike; an empty table gives an empty one; other columns pass through `scan`, one named license_spans is replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

#: Names and notices of common public licences. Fixed values.
TEMPLATES = {
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
NOT_WORD = r"[^a-z0-9]+"
SPAN = "struct<dice:double,n_words:int,start:int,license:string>"


def normalised(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """The set of word bigrams."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def template_words(text: str) -> list[str]:
    return [x for x in re.split(NOT_WORD, text.lower()) if x]


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the largest number of bigrams that reach the threshold with n in the template."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9), math.floor((2 - threshold) / threshold * n + 1e-9)


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def hits(tokens: str, templates: dict[str, str]) -> Column:
    """array of struct(at, gram, of): the bigrams of a column of tokens that templates have; `at` counts from 1, bit i of `of` stands for
    the i-th template by name. Written as SQL text, as thousands of literals take seconds to make one by one."""
    own = [template_bigrams(templates[name]) for name in sorted(templates)]
    grams = sorted({g for x in own for g in x})
    firsts = sorted({g.split(" ")[0] for g in grams})
    of = " + ".join(f"IF(h.gram IN ({_quoted(x)}), {1 << i}L, 0L)" for i, x in enumerate(own))
    n = f"greatest(size({tokens}) - 1, 0)"
    pairs = f"zip_with(slice({tokens}, 1, {n}), slice({tokens}, 2, {n}), (a, b) -> IF(a IN ({_quoted(firsts)}), concat_ws(' ', a, b), NULL))"
    known = f"filter(transform({pairs}, (g, i) -> struct(i + 1 AS at, g AS gram)), h -> h.gram IN ({_quoted(grams)}))"
    return F.expr(f"transform({known}, h -> struct(h.at AS at, h.gram AS gram, {of} AS of))")


def template_rows(templates: dict[str, str], threshold: float) -> Column:
    """array of struct(license, own, low, high, reach, bit); reach is from a window's first bigram to its last one at most."""
    rows = []
    for i, name in enumerate(sorted(templates)):
        n = len(template_bigrams(templates[name]))
        low, high = size_bounds(n, threshold)
        reach = len(template_words(templates[name])) - 2
        rows.append(f"named_struct('license', '{name}', 'own', {n}, 'low', {low}, 'high', {high}, 'reach', {reach}, 'bit', {1 << i}L)")
    return F.expr(f"array({', '.join(rows)})")


def _windows(tokens: Column, found: Column, t: Column, threshold: float) -> Column:
    """array of SPAN of the windows of template t at or above the threshold, by start. found: hits of all templates."""

    def one(mine: Column, i: Column) -> Column:
        start = F.get(mine, i)["at"]
        inside = F.filter(F.slice(mine, i + 1, t["reach"] + 1), lambda h: h["at"] <= start + t["reach"])

        def judged(s: Column) -> Column:
            last = F.element_at(s, -1)["at"]
            shared = F.size(F.array_distinct(F.transform(s, lambda h: h["gram"])))
            size = F.size(bigrams(F.slice(tokens, start, last - start + 2)))
            dice = F.lit(2.0) * shared / (size + t["own"])
            span = F.struct(dice.alias("dice"), (last - start + 2).cast("int").alias("n_words"), start.cast("int").alias("start"), t["license"].alias("license"))
            return F.when(size.between(t["low"], t["high"]) & (dice >= threshold), span)

        return bind(inside, judged)

    def all_of(mine: Column) -> Column:
        n = F.size(mine) - t["low"] + 1  # starts that have enough hits after them
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(mine, i + t["low"] - 1)["at"] - F.get(mine, i)["at"] <= t["reach"])
        return F.when(n > 0, F.array_compact(F.transform(starts, lambda i: one(mine, i))))

    windows = F.when(F.size(found) >= t["low"], bind(F.filter(found, lambda h: h["of"].bitwiseAND(t["bit"]) != 0), all_of))
    return F.coalesce(windows, F.array().cast(f"array<{SPAN}>"))


def _order(x: Column) -> Column:
    """Greater for a better window of one template."""
    return F.struct(x["dice"], x["n_words"], -x["start"])


def weight(x: Column) -> Column:
    """Greater for a span that says more of a text's licence."""
    return F.struct(x["dice"] * x["n_words"], x["dice"], -x["start"])


def _stretches(windows: Column) -> Column:
    """The best window of each run of overlapping windows, which come by start."""
    none = F.lit(None).cast(SPAN)
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), none.alias("best"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        after = x["start"] >= s["end"]
        better = s["best"].isNull() | after | (_order(x) > _order(s["best"]))
        return F.struct(
            F.when(after & s["best"].isNotNull(), F.concat(s["done"], F.array(s["best"]))).otherwise(s["done"]).alias("done"),
            F.when(better, x).otherwise(s["best"]).alias("best"),
            F.greatest(s["end"], x["start"] + x["n_words"]).alias("end"),
        )

    return F.aggregate(windows, start, step, lambda s: F.array_compact(F.concat(s["done"], F.array(s["best"]))))


def _best_of_overlapping(spans: Column) -> Column:
    def beaten(x: Column) -> Column:
        def by(y: Column) -> Column:
            apart = (y["start"] >= x["start"] + x["n_words"]) | (x["start"] >= y["start"] + y["n_words"])
            return ~apart & ((weight(y) > weight(x)) | ((weight(y) == weight(x)) & (y["license"] < x["license"])))

        return F.exists(spans, by)

    return F.filter(spans, lambda x: ~beaten(x))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds license_spans: array of struct(start, n_words, dice, license), start counted in words from 1. Projections, no shuffle.

    At most 63 templates, whose names have no quotes.
    """
    out, words, found = "license_spans", "__license_words", "__license_hits"
    least = min(size_bounds(len(template_bigrams(t)), threshold)[0] for t in templates.values())
    df = docs.withColumn(words, normalised(F.coalesce(docs[text], F.lit(""))))
    df = df.withColumn(found, hits(words, templates))
    spans = lambda h: F.flatten(F.transform(template_rows(templates, threshold), lambda t: _stretches(_windows(df[words], h, t, threshold))))
    each = F.when(F.size(df[found]) >= least, bind(bind(df[found], spans), _best_of_overlapping))
    ordered = F.array_sort(F.transform(each, lambda x: F.struct(x["start"].alias("start"), x["n_words"].alias("n_words"), x["dice"].alias("dice"), x["license"].alias("license"))))
    none = F.array().cast("array<struct<start:int,n_words:int,dice:double,license:string>>")
    return df.select(*[df[c] for c in docs.columns if c != out], F.coalesce(ordered, none).alias(out))
