"""Licence scan (native): Dice coefficient over word bigrams against licence templates.

A unit is a line, a paragraph (lines between blank lines), the whole text or a window: a run of words
anywhere in the text, over lines and paragraphs. Units are normalised (lower case, runs of other than
letters and digits become one space, copyright lines go), and their distinct word bigrams are compared with
each template's: ``2 * common / (a + b)``. As ``common`` is at most the smaller size, a template can only
reach the limit ``t`` if its size lies in ``[a * t / (2 - t), a * (2 - t) / t]``; all other templates are
pruned by size before any bigram is made.

A unit must also hold ``t / (2 - t)`` of the template's bigrams. So a text without any of ``triggers`` (words that
are in more than the remaining share of each template's bigrams) has no match, and a text's windows are only
tried for templates of which the text as a whole holds that share.

Windows have STEPS lengths a template, its own among them, from the smallest to the largest similar one; all
lengths if it is short. Every window of such a length is scored: a position counts for the starts since the
same bigram's last occurrence, so the distinct bigrams of all windows follow from one sorted pass. Of a
licence's windows that overlap the closest counts. Of those of different licences that share more than half
of the shorter one that counts which has most common bigrams above what the limit asks for (ties: the first
name), so that a whole text goes before a notice or another licence's part in it.

Defined results: null and empty texts match nothing; texts of any length are scanned whole; a unit
counts for its closest licence (ties: the first name); of a document's units with the same licence the
best is reported (ties: the smallest kind of unit, then the first), so repeated rows change nothing; a
window's number is that of its first word, from 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Licence texts and notices. Fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Short notices of licences that have a whole text. Fixed values.
NOTICES = {
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU Affero General"),
    ],
}
#: Licences whose whole text is a file of license_texts.
FULL = ["Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC0-1.0"]
for _name in FULL:
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + NOTICES.get(_name, []) + [(files(__package__) / "license_texts" / f"{_name}.txt").read_text("utf-8")]
LIMIT = 0.8
UNITS = ["line", "paragraph", "text", "window"]
#: Lengths of windows tried for a template.
STEPS = 13
#: Words that are in most prose; ``triggers`` takes them only where nothing else does, and words of fewer than TELLING letters only where no longer one does.
COMMON = {
    *"a all an and any are as at be been before but by can could do each either for free from had has have he her his how http i if in include including into is it its".split(),
    *"made make making may means more must necessary no not of on only or other our out own part provided public see she should similar so some source such than that the".split(),
    *"their them then there these they this those through time to under use used was we were what when where whether which who will with without word words work would you your".split(),
}
TELLING = 6
#: Whole lines that name a holder and not a licence. Fixed value.
HOLDER = r"(?im)^[^a-z0-9\n]*(?:copyright\b|\(c\)\x20|\xA9)[^\n]*$"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(HOLDER, " ", text).lower())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of normalised text, in order."""
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _set_sql(grams: Iterable[str]) -> str:
    """SQL for an array that is folded to one literal."""
    return "split('" + "|".join(grams) + "', '[|]')"


def _template_sql() -> list[tuple[str, int, str, list[str]]]:
    """Name, size, SQL array and bigrams of each template."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            grams = bigrams(text)
            out.append((name, len(grams), _set_sql(grams), grams))
    return out


def triggers(sets: list[list[str]], ratio: float) -> list[str]:
    """A few words of which any unit with a share of ``ratio`` of a set's bigrams has one."""
    needed = [len(grams) - ratio * len(grams) + 1e-9 for grams in sets]
    left, out = [set(grams) for grams in sets], []
    while any(len(grams) - len(rest) <= need for grams, rest, need in zip(sets, left, needed)):
        gain: Counter = Counter()
        for grams, rest, need in zip(sets, left, needed):
            if len(grams) - len(rest) <= need:
                gain.update({w: n / len(grams) for w, n in Counter(w for g in rest for w in {*g.split()}).items()})
        out.append(max(gain, key=lambda w: (w not in COMMON, len(w) >= TELLING, gain[w] * len(w), w)))
        left = [{g for g in rest if out[-1] not in g.split()} for rest in left]
    return out


def lengths(size: int, ratio: float) -> list[int]:
    """Numbers of bigrams of the windows tried for a template with ``size`` bigram positions."""
    low, high = math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)
    grid = {round(low * (high / low) ** (k / (STEPS - 1))) for k in range(STEPS)}
    return sorted(grid | {size}) if high - low >= STEPS else list(range(low, high + 1))


def _windows(limit: float, ratio: float) -> str:
    """SQL for an array of (d, s, e, license): the closest windows of the bigrams ``b``, of which ``k`` are the known ones."""
    rows = [(name, bigrams(text), len(_words(text)) - 1) for name, texts in TEMPLATES.items() for text in texts]
    sizes = f"array({', '.join(str(len(g)) for _, g, _ in rows)})"
    sets = f"array({', '.join(_set_sql(g) for _, g, _ in rows)})"
    names = f"array({', '.join(repr(n) for n, _, _ in rows)})"
    steps = f"array({', '.join('array(' + ', '.join(map(str, lengths(n, ratio))) + ')' for _, _, n in rows)})"
    fit = f"filter(sequence(0, {len(rows) - 1}), t -> size(k) >= {ratio!r}D * {sizes}[t] - 1e-9D and size(array_intersect(k, {sets}[t])) >= {ratio!r}D * {sizes}[t] - 1e-9D)"
    # i: a bigram's position; q: that of its last occurrence, -1 if none; f: 1 if the template has it
    has = "case t " + " ".join(f"when {k} then o.g in ({', '.join(repr(x) for x in g)})" for k, (_, g, _) in enumerate(rows)) + " end"
    marked = f"transform(ordered, o -> named_struct('i', o.i, 'q', o.q, 'f', if({has}, 1, 0)))"
    # only windows with a hit matter: positions from the longest window before the first hit to as far after the last
    hits = "transform(filter(r, o -> o.f = 1), o -> o.i)"
    near = f"transform(array({marked}), r -> transform(array(named_struct('lo', array_min({hits}) - array_max({steps}[t]), 'hi', array_max({hits}) + array_max({steps}[t]))), g -> filter(r, o -> o.i between g.lo and g.hi))[0])"
    # where a position begins and ends to count for windows of l bigrams that start there
    events = (
        "sort_array(concat(transform(p, o -> named_struct('s', greatest(o.q, o.i - l) + 1, 'n', 1, 'f', o.f)), "
        "transform(p, o -> named_struct('s', o.i + 1, 'n', -1, 'f', -o.f)), array(named_struct('s', size(b) + 1, 'n', 0, 'f', 0))))"
    )
    dice = f"round(2D * a.f / (a.n + {sizes}[t]), 6)"
    window = f"named_struct('d', {dice}, 's', a.s, 'e', a.s + l, 'license', {names}[t], 'm', a.f * 2D - {limit!r}D * (a.n + {sizes}[t]))"
    last = "element_at(a.out, -1)"
    kind = "array<struct<d:double,s:int,e:int,license:string,m:double>>"
    grown = (
        f"case when x.s = a.s or a.f * 2D < {limit!r}D * (a.n + {sizes}[t]) - 1e-6D or {dice} < {limit!r}D or a.s + l > size(b) then a.out "
        f"when size(a.out) = 0 or {last}.e <= a.s then array_append(a.out, {window}) "
        f"when {last}.d < {dice} then array_append(slice(a.out, 1, size(a.out) - 1), {window}) else a.out end"
    )
    scored = f"aggregate({events}, named_struct('s', 0, 'n', 0, 'f', 0, 'out', cast(array() as {kind})), (a, x) -> named_struct('s', x.s, 'n', a.n + x.n, 'f', a.f + x.f, 'out', {grown}), a -> a.out)"
    per_length = f"flatten(transform(filter({steps}[t], l -> l <= size(b)), l -> {scored}))"
    every = f"flatten(transform({fit}, t -> flatten(transform({near}, p -> {per_length}))))"
    over = "2 * (least(x.e, y.e) - greatest(x.s, y.s)) > least(x.e - x.s, y.e - y.s)"
    better = "y.license = x.license and y.s < x.e and x.s < y.e and (y.d > x.d or y.d = x.d and y.m > x.m)"
    nearer = f"y.license != x.license and {over} and (y.m > x.m or y.m = x.m and y.license < x.license)"
    own = f"transform(array({every}), z -> filter(z, x -> not exists(z, y -> {better})))[0]"
    return f"transform(array({own}), z -> filter(z, x -> not exists(z, y -> {nearer})))[0]"


def _bound(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and ``columns``, made once a row: the optimizer copies expressions into later ones and into filters, but not those of a generator."""
    fields = [F.expr(c) for c in columns]
    return df.select("doc_id", F.explode(F.array(F.struct(*fields))).alias("v")).select("doc_id", "v.*")


def scan(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice (6 decimals), unit, unit_no: the best unit of each licence found in a document."""
    templates = _template_sql()
    ratio = limit / (2 - limit)  # sizes of similar units differ by this factor at most
    low, high = min(n for _, n, *_ in templates) * ratio, max(n for _, n, *_ in templates) / ratio
    every = sorted({g for *_, grams in templates for g in grams})
    known = ", ".join(f"'{g}'" for g in every)
    lowered = F.lower("text")
    likely = F.expr(f"arrays_overlap(split(lower(text), '[^a-z0-9]+'), {_set_sql(triggers([grams for *_, grams in templates], ratio))})")
    named = lowered.contains("copyright") | lowered.contains("(c)") | lowered.contains("\xa9")
    holders = F.regexp_replace(lowered, F.lit(HOLDER.replace(r"\x20", " ").replace(r"\xA9", "\xa9")), F.lit(" "))
    text = documents(docs).where("text is not null").where(likely).select("doc_id", F.when(named, holders).otherwise(lowered).alias("text"))
    # every run of other characters becomes a space, but line ends stay
    plain = text.select("doc_id", F.regexp_replace("text", r"[^a-z0-9\n]+", " ").alias("text"))
    part = lambda kind, texts: f"transform({texts}, (x, i) -> named_struct('kind', {kind}, 'no', i, 'part', trim(translate(x, '\\n', ' '))))"
    # a unit's words, bound once; as many distinct bigrams as distinct words but one, so texts with more than the bound are out before bigrams are made
    grams = (
        "transform(array(split(u.part, ' +')), v -> if(u.kind > 0 and size(array_distinct(v)) - 1 > "
        f"{high!r}D, array(), array_distinct(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> concat(x, ' ', y)))))[0]"
    )
    lines, paragraphs = r"split(text, '\n', -1)", r"split(text, r'\n *\n', -1)"
    units = (
        f"concat({part(0, lines)}, "
        rf"if(text rlike r'\n *\n', {part(1, paragraphs)}, array()), "
        rf"if(instr(text, '\n') > 0, {part(2, 'array(text)')}, array()))"
    )
    worded = f"filter({units}, u -> char_length(u.part) - char_length(replace(u.part, ' ', '')) >= {low!r}D)"
    made = f"transform({worded}, u -> named_struct('kind', u.kind, 'no', u.no, 'b', {grams}))"
    # by the same bounds, so much of a similar unit must be in some template
    gated = f"filter({made}, u -> size(u.b) >= {low!r}D and size(u.b) <= {high!r}D and size(filter(u.b, y -> y in ({known}))) >= {ratio!r}D * size(u.b) - 1e-9D)"
    tests = [
        f"if(size(u.b) >= {size * ratio!r}D and size(u.b) <= {size / ratio!r}D, named_struct('d', round(-2D * size(array_intersect(u.b, {grams})) / (size(u.b) + {size}), 6), 'license', '{name}'), null)"
        for name, size, grams, _ in templates
    ]
    whole = f"transform({gated}, u -> named_struct('kind', u.kind, 'no', u.no, 'm', array_min(array({', '.join(tests)}))))"
    closest = f"transform(filter({whole}, u -> u.m.d <= {-limit!r}D), u -> named_struct('d', u.m.d, 'kind', u.kind, 'no', u.no, 'license', u.m.license))"
    # a text's bigrams in order, those that some template has, and each position with the bigram's last one
    paired = _bound(plain, "text", "split(trim(translate(text, '\\n', ' ')), ' +') as w")
    pairs = _bound(paired, "text", "if(size(w) > 1, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (x, y) -> concat(x, ' ', y)), array()) as b")
    # the smallest share of a template that a similar unit must have
    shared = _bound(pairs, "text", "b", f"array_distinct(filter(b, x -> x in ({known}))) as k").where(f"size(k) >= {low!r}D - 1e-9D")
    sorted_ = _bound(shared, "text", "b", "k", "sort_array(transform(b, (x, i) -> named_struct('g', x, 'i', i))) as so")
    ordered = _bound(sorted_, "text", "b", "k", "zip_with(so, concat(array(named_struct('g', '', 'i', -1)), slice(so, 1, size(so) - 1)), (x, y) -> named_struct('g', x.g, 'i', x.i, 'q', if(x.g = y.g, y.i, -1))) as ordered")
    windows = f"transform({_windows(limit, ratio)}, x -> named_struct('d', -x.d, 'kind', 3, 'no', x.s, 'license', x.license))"
    matched = _bound(ordered, f"concat({closest}, {windows}) as found").select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    best = F.min(F.struct("d", "kind", "no"))
    return matched.groupBy("doc_id", "license").agg(best.alias("x")).select(
        "doc_id", "license", (-F.col("x.d")).alias("dice"), F.element_at(F.array(*map(F.lit, UNITS)), F.col("x.kind") + 1).alias("unit"), F.col("x.no").alias("unit_no")
    )
