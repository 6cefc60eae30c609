"""Licence scan: Dice coefficient over word bigrams, in DataFrame operations only.

Texts and templates are normalised (lower case, runs of other characters than letters
and digits become one space).  Windows of a template's length slide over the whole text,
so a notice is found inside a longer document and across its line breaks.  A window
starts at a bigram of the template and ends at the last one within reach; it is
compared by the Dice coefficient of the distinct bigrams.

A window of ``b`` distinct bigrams can reach the threshold ``t`` with a template of ``a``
only if they share at least ``a * t / (2 - t)``.  Texts, templates and windows with fewer
are pruned by that before any window is compared: first by words that a bigram of such
a window must hold (``hints``), then by the text's bigrams, then by counts of positions.
No pruning changes the result.

Defined results: null and empty texts match nothing and yield a row without licence;
ties go to the template of more bigrams, then to the
first; repeated rows stay; empty tables give empty tables; texts of any length are read
whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

# Short licence notices, headers and licence texts, by SPDX-like name.
# Longer texts (the full Apache or GPL terms) can be passed as ``templates``.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0.',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Released under the MIT License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": 'This work is licensed under the GNU General Public License, version 3.',
    "GPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "GPL-2.0-header": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    "LGPL-2.1-header": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "AGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "CC-BY-NC-4.0": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-4.0": 'Licensed under CC BY 4.0.',
    "CC-BY-SA-4.0": 'Licensed under CC BY-SA 4.0.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MPL-2.0-header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    "EPL-2.0-header": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
}
# Words too common to tell a licence.
PLAIN_WORDS = "a all and any are as at be but by can for from in is it of on or other that the this to under use used with you".split()


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    found = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def least_shared(a: int, threshold: float) -> int:
    return math.ceil(a * threshold / (2 - threshold) - 1e-9)


def hints(known: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every window at the threshold holds one: too few bigrams of its
    template are without them."""
    chosen: set[str] = set()
    for own in known.values():
        words = sorted({w for g in own for w in g.split()}, key=lambda w: (w not in chosen, w in PLAIN_WORDS, -len(w), w))
        for w in words:
            if sum(not chosen & {*g.split()} for g in own) < least_shared(len(own), threshold):
                break
            chosen.add(w)
    return sorted(chosen)


def _windows(t: Column, grams: Column, shared: Column) -> Column:
    """The greatest Dice coefficient of the template ``t`` over all windows, or null."""
    def best(common):
        at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(common, F.get(grams, i)))

        def windows(pos):
            def dice(first, i):
                inside = F.filter(F.slice(pos, i + 1, t["reach"]), lambda x: x < first + t["reach"])
                window = F.array_distinct(F.slice(grams, first + 1, F.array_max(inside) - first + 1))
                value = let(window, lambda w: F.lit(2.0) * F.size(F.array_intersect(w, common)) / (F.size(w) + F.size(t["own"])))
                return F.when(F.get(pos, i + t["need"] - 1) < first + t["reach"], value)

            return F.array_max(F.transform(pos, dice))

        return F.when(F.size(common) >= t["need"], let(at, windows))

    return let(F.array_intersect(shared, t["own"]), best)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, licence, dice, n_matches``: per row the best template over all windows, its
    Dice coefficient, and how many templates reach the threshold (licence null, dice 0 if none)."""
    texts = templates or TEMPLATES
    known = {k: template_bigrams(v) for k, v in texts.items()}
    table = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(-k).alias("order"), F.array(*map(F.lit, own)).alias("own"), F.lit(least_shared(len(own), threshold)).alias("need"), F.lit(len(template_words(texts[name])) - 1).alias("reach"))
        for k, (name, own) in enumerate(known.items())
    ))
    every = F.array(*map(F.lit, sorted({g for own in known.values() for g in own})))
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(df[text_col], F.lit(""))), "[^a-z0-9]+", " ")), " ")

    def matches(grams):
        def tried(shared):
            each = F.transform(table, lambda t: F.struct(_windows(t, grams, shared).alias("dice"), F.size(t["own"]).alias("a"), t["order"].alias("order"), t["name"].alias("name")))
            return F.filter(each, lambda x: x["dice"] >= threshold)

        return let(F.array_intersect(grams, every), tried)

    def found(w):
        pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when((F.size(w) > 1) & F.arrays_overlap(w, F.array(*map(F.lit, hints(known, threshold)))), let(pairs, matches)).otherwise(F.array())

    return df.select(F.col(id_col).alias("doc_id"), let(words, found).alias("_h")).select(
        "doc_id", F.array_max("_h")["name"].alias("licence"), F.coalesce(F.array_max("_h")["dice"], F.lit(0.0)).alias("dice"), F.size("_h").cast("long").alias("n_matches")
    )


def op8_sql(source: str = "documents", threshold: float = 0.8) -> str:
    """DuckDB SQL of ``scan``."""
    known = {k: template_bigrams(v) for k, v in TEMPLATES.items()}
    rows = ", ".join(f"({j}, '{k}', {len(own)}, {least_shared(len(own), threshold)}, {len(template_words(TEMPLATES[k])) - 1})" for j, (k, own) in enumerate(known.items()))
    grams = ", ".join(f"({j}, '{g}')" for j, own in enumerate(known.values()) for g in own)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM w)),
tpl(k, name, a, need, reach) AS (VALUES {rows}),
own(k, gram) AS (VALUES {grams}),
hit AS (SELECT rid, k, i, gram FROM g JOIN own USING (gram)),
enough AS (SELECT rid, k FROM hit JOIN tpl USING (k) GROUP BY rid, k, need HAVING count(DISTINCT gram) >= need),
pos AS (SELECT * FROM hit SEMI JOIN enough USING (rid, k)),
win AS (SELECT x.rid, k, x.i AS lo, max(y.i) AS hi, count(DISTINCT y.gram) AS shared FROM pos x JOIN pos y USING (rid, k) JOIN tpl USING (k)
        WHERE y.i BETWEEN x.i AND x.i + reach - 1 GROUP BY x.rid, k, x.i, need HAVING count(*) >= need),
sized AS (SELECT win.rid, k, lo, shared, count(DISTINCT g.gram) AS b FROM win JOIN g ON g.rid = win.rid AND g.i BETWEEN lo AND hi GROUP BY ALL),
dice AS (SELECT rid, k, max(2.0::DOUBLE * shared / (b + a)) AS dice FROM sized JOIN tpl USING (k) GROUP BY rid, k),
best AS (SELECT rid, name, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, a DESC, k) AS place, count(*) OVER (PARTITION BY rid) AS n FROM dice JOIN tpl USING (k) WHERE dice >= {threshold})
SELECT doc_id, name AS licence, coalesce(dice, 0.0) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_matches
FROM d LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (rid)"""
