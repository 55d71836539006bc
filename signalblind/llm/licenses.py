"""Licence scan: Dice coefficient over word bigrams, candidates pruned by size.

Every line of a text, every paragraph and the whole text is normalised (lower case, letters
and digits only) and compared with licence templates. A Dice coefficient of t needs set sizes
within a factor (2 - t) / t of each other, so only templates of a fitting size are compared.

Notices that are none of these (wrapped inside a longer text, or part of a line) are found by
windows: from each bigram that a template holds, as many words as the template has, ending
with the last such bigram. A window has to hold t / (2 - t) of the template's bigrams, so
most are dropped by looking at places alone. All of it happens inside the row with built-in
functions; nothing is shuffled.
"""

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalblind.llm.quality import fenced

#: Public licence notices and short licence texts (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_WORK = "This work is licensed under the GNU {0}General Public License, version {1}."

#: Whole texts of the short licences, the headers and titles of the long ones.
WHOLE = {
    "AGPL-3.0": [_WORK.format("Affero ", "3"), _GNU.format("Affero ", "3"), "GNU Affero General Public License Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": [_BSD + _BSD_END, "Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD + _BSD_THIRD + _BSD_END],
    "GPL-2.0": [_GNU.format("", "2"), "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "ISC": [_ISC, "Released under the ISC License.", "Licensed under the ISC License."],
    "LGPL-2.1": [_WORK.format("Lesser ", "2.1"), _GNU.format("Lesser ", "2.1"), "GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": [_WORK.format("Lesser ", "3"), _GNU.format("Lesser ", "3"), "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": [_MIT],
}
for _name, _texts in WHOLE.items():
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + _texts


def _tokens(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text):
    """Distinct word bigrams of a template."""
    w = _tokens(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _words(text):
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _pairs(w):
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(w):
    return F.when(F.size(w) >= 2, F.array_distinct(_pairs(w)))


def _windows(pairs, hits, name, text, threshold):
    """The best window of ``pairs`` for one template text, null if none reaches ``threshold``."""
    grams = bigrams(text)
    n, length = len(grams), len(_tokens(text)) - 1
    least = max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))

    def score(start, places):
        end = F.array_max(F.filter(places, lambda q: (q >= start) & (q < start + length)))
        return F.transform(F.array(F.array_distinct(F.slice(pairs, start + 1, end - start + 1))), lambda g: 2 * F.size(F.array_intersect(g, F.array(*map(F.lit, grams)))) / (F.size(g) + n))[0]

    def best(places):
        starts = F.filter(places, lambda p, j: F.get(places, j + (least - 1)) - p < length)
        scored = F.transform(starts, lambda p: F.struct((-score(p, places)).alias("minus"), F.lit(name).alias("name"), F.lit(n).alias("n")))
        return F.array_min(F.filter(scored, lambda s: s["minus"] <= -threshold))

    places = F.transform(F.filter(hits, lambda h: h["gram"].isin(grams)), lambda h: h["at"])
    return F.transform(F.array(places), best)[0]


def scan(docs: DataFrame, threshold=0.8, templates=None) -> DataFrame:
    """One row per row: doc_id, license, dice, n_passages.

    ``license`` is the template of the largest Dice coefficient of at least ``threshold``
    over all lines, paragraphs and windows of the text and the whole text, the first by name
    among equals, and ``dice`` that coefficient; null when there is none. A template whose
    bigrams are part of another licence's does not count where that one matches too. ``n_passages``
    counts the lines, and the whole text, that match some template, and the licences that
    only a paragraph or a window matches. Null, empty and one-word texts match nothing; an empty table
    gives no rows; other columns are ignored. ``templates`` maps names to lists of texts;
    it is part of the plan, so it should stay a short list.
    """
    known = [(name, g) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if (g := bigrams(t))]
    struct = "array<struct<name:string,n:int,grams:array<string>>>"
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for n, g in known)).cast(struct)
    texts_of = [(name, t) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if bigrams(t)]
    every = sorted({x for _, t in texts_of for x in bigrams(t)})
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    blocks = F.split("text", "\n[ \t\r]*\n", -1)
    blocks = F.when(F.size(blocks) > 1, F.filter(blocks, lambda p: p.contains("\n"))).otherwise(F.array().cast("array<string>"))
    df = fenced(df, ["doc_id"], lines=F.transform(lines, _words), blocks=F.transform(blocks, _words), words=_words("text"))
    df = fenced(df, ["doc_id"], lines=F.transform("lines", _bigrams), blocks=F.transform("blocks", _bigrams), pairs=F.when(F.size("words") >= 2, _pairs(F.col("words"))).otherwise(F.array().cast("array<string>")))
    hits = F.filter(F.transform("pairs", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: h["gram"].isin(every))
    whole = F.when(F.size("pairs") > 0, F.array_distinct("pairs"))
    passages = F.when(F.size("lines") > 1, F.array_append("lines", whole)).otherwise(F.col("lines"))
    df = fenced(df, ["doc_id"], passages=passages, blocks=F.col("blocks"), pairs=F.col("pairs"), hits=hits)
    # of sets with n and m members the coefficient is at most 2 min(n, m) / (n + m)
    fits = lambda g, t: 2 * F.least(F.size(g), t["n"]) >= threshold * (F.size(g) + t["n"])
    dice = lambda g, t: 2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])

    def matches(g):
        scored = F.transform(F.filter(table, lambda t: fits(g, t)), lambda t: F.struct((-dice(g, t)).alias("minus"), t["name"].alias("name"), t["n"].alias("n")))
        return F.filter(scored, lambda s: s["minus"] <= -threshold)

    def some(column):
        return F.filter(F.transform(F.filter(column, lambda g: g.isNotNull()), matches), lambda s: F.size(s) > 0)

    # no window matches without a bigram of a template
    none = F.array().cast("array<struct<minus:double,name:string,n:int>>")
    windows = F.array_compact(F.array(*(_windows(F.col("pairs"), F.col("hits"), n, t, threshold) for n, t in texts_of)))
    df = fenced(df, ["doc_id"], found=some("passages"), more=F.concat(F.flatten(some("blocks")), F.when(F.size("hits") > 0, windows).otherwise(none)))
    df = fenced(df, ["doc_id"], n=F.size("found"), found=F.flatten("found"), more=F.col("more"))
    names = lambda column: F.transform(column, lambda s: s["name"])
    # a text that is part of another licence's says nothing where that one is found
    for name, own in known:
        around = [F.struct(F.lit(other).alias("name"), F.lit(len(g)).alias("n")) for other, g in known if other != name and set(own) < set(g)]
        if around:
            is_own = lambda s: (s["name"] == name) & (s["n"] == len(own))  # noqa: B023, E731
            others = F.exists(F.concat("found", "more"), lambda x: F.array_contains(F.array(*around), F.struct(x["name"].alias("name"), x["n"].alias("n"))))  # noqa: B023
            df = df.withColumns({c: F.filter(c, lambda s: ~(is_own(s) & others)) for c in ("found", "more")})  # noqa: B023
    top = F.array_min(F.concat("found", "more"))
    count = (F.col("n") + F.size(F.array_except(names("more"), names("found")))).cast("bigint")
    return df.select("doc_id", top["name"].alias("license"), F.round(-top["minus"], 6).alias("dice"), count.alias("n_passages"))


def scan_sql(threshold=0.8):
    """The same in DuckDB over ``documents``."""
    known = [(name, t) for name, texts in sorted(TEMPLATES.items()) for t in texts]
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    return f"""WITH t AS (SELECT name, {grams} AS tg FROM (SELECT name, {words.format('body')} AS w FROM (VALUES {values}) v(name, body))),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS body FROM documents),
passages AS (SELECT doc_id, unnest(l) AS p FROM lines UNION ALL SELECT doc_id, body FROM lines WHERE len(l) > 1),
sets AS (SELECT doc_id, row_number() OVER () AS id, {grams} AS g FROM (SELECT doc_id, {words.format('p')} AS w FROM passages) WHERE len(w) >= 2),
fit AS (SELECT doc_id, id, name, 2 * len(list_intersect(g, tg)) / CAST(len(g) + len(tg) AS DOUBLE) AS dice
        FROM sets JOIN t ON 2 * least(len(g), len(tg)) >= {threshold} * (len(g) + len(tg))),
hits AS (SELECT doc_id, count(DISTINCT id) AS n, min(struct_pack(m := -dice, name := name)) AS b FROM fit WHERE dice >= {threshold} GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, round(-b.m, 6) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_passages FROM documents d LEFT JOIN hits USING (doc_id)"""
