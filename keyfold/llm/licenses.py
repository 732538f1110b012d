"""License scans: Dice coefficient over word bigrams against licence templates.

Native: DataFrame operations only.  A text's units are its lines' sentences.  A
unit is normalised (lower case, words of a-z and 0-9) and its set of word
bigrams compared with a template's: 2 |A & B| / (|A| + |B|) of at least
``threshold``.

Units that are no template in full (coefficient 1) are searched again over line
and sentence ends: their words in order, with a gap for each full unit.  There each window
of consecutive bigrams, from a template's bigram to another, up to (2-t)/t times
the template's length, is compared.  All windows are, so wrapped notices and
those in longer sentences are found with their best coefficient.

A licence has several templates: notices, usual headers, and passages of its
text.  A whole text is recognised by the passages that it holds.

Two bounds prune without loss.  Sizes: the coefficient can only reach t if
|A| lies between t/(2-t) and (2-t)/t times |B|.  Anchors: at least t/(2-t) of a
template's bigrams must be in the unit, so a set of words that touch more than
the rest of its bigrams must have a word there; one pass of a pattern of these
words leaves few units.  For windows, t/(2-t) of a template's bigrams must be in
the rest of the text, and in the longest window from a start.

Templates are a list on the driver (at most ``MAX_TEMPLATES``) and become
one constant.  Null and empty texts, and texts without a licence, have licence
null and dice 0.  Ties go to the template that sorts first.  Each row is judged
alone, with no shuffle, so repeated rows need no rule.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

MAX_TEMPLATES = 200
UNIT = r"\n|[.!?][ \t\r]+"
#: Identifiers and notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}


#: Besides TEMPLATES, which the SQL knows: usual headers, and passages that stand in each copy of the licence's text.
MORE = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU Affero General Public License, version 3",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "Distributed under the Apache License 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ],
    "BSD": [
        "Licensed under the BSD License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "the person associating CC0 with a Work (the \"Affirmer\"), to the extent that he or she is an owner of Copyright and Related Rights in the Work, voluntarily elects to apply CC0 to the Work",
    ],
    "GPL-1.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "You may modify your copy or copies of the Program or any portion of it, thus forming a work based on the Program, and copy and distribute such modifications or work under the terms of Section 1 above",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    ],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU Lesser General Public License, version 3",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    ],
    "MIT": [
        "Licensed under the MIT License",
        "Distributed under the MIT License",
        "This project is licensed under the MIT License",
        "This project is released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
}
ALL = {k: [*([TEMPLATES[k]] if k in TEMPLATES else []), *MORE.get(k, [])] for k in sorted({*TEMPLATES, *MORE})}


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(bigrams: list[str], threshold: float) -> list[str]:
    """Few words that touch more bigrams than a matching unit can lack."""
    need = len(bigrams) - threshold / (2 - threshold) * len(bigrams)
    left, chosen = set(bigrams), []
    common = {"the", "of", "in", "is", "a", "to", "and", "under", "with", "are", "that", "this", "or", "by", "from"}
    common |= {"all", "an", "any", "as", "at", "be", "can", "each", "for", "has", "he", "if", "it", "mit", "no", "not", "on", "one", "shall", "she", "such", "was", "which", "without", "you"}
    while len(bigrams) - len(left) <= need:
        words = sorted({w for b in left for w in b.split()})
        best = max(words, key=lambda w: ((w not in common) * sum(w in b.split() for b in left), -words.index(w)))
        chosen.append(best)
        left = {b for b in left if best not in b.split()}
    return chosen


def any_of(words: list[str]) -> str:
    """A pattern of whole words that tries each letter once, as words with the same beginning share it."""

    def branch(rest: list[str]) -> str:
        firsts = sorted({w[0] for w in rest if w})
        ways = [f + branch([w[1:] for w in rest if w and w[0] == f]) for f in firsts]
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{body})?" if body and "" in rest else body

    return rf"(?<![a-z0-9])(?=[{''.join(sorted({w[0] for w in words}))}]){branch(words)}(?![a-z0-9])"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    # Positions up to the last but one; the shifted list pairs each word with its follower.
    return F.array_compact(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))


def _bigrams(unit: Column) -> Column:
    return F.array_distinct(_pairs(_words(unit)))


def length_of(text: str) -> int:
    """Bigrams of a template, repeated ones too."""
    return max(0, len(re.findall("[a-z0-9]+", text.lower())) - 1)


WINDOW = "array<struct<low:int,high:int,dice:double,licence:string>>"
TEMPLATE = "array<struct<licence:string,grams:array<string>,size:int,need:int,longest:int>>"


def _windows(pairs: Column, known_pairs: Column, template: Column) -> Column:
    """Each window of ``pairs`` that matches the template: first and last position, dice, licence.  ``known_pairs`` are those in any template."""

    def common(bigrams: Column) -> Column:
        return F.size(F.array_intersect(bigrams, template["grams"]))

    def measured(low: Column, high: Column) -> Column:
        window = F.slice(pairs, low + 1, high - low + 1)
        dice = 2.0 * common(window) / (F.size(F.array_distinct(window)) + template["size"])
        return F.struct(low.alias("low"), high.alias("high"), dice.alias("dice"), template["licence"].alias("licence"))

    def search(at: Column) -> Column:
        def ends(low: Column, k: Column) -> Column:
            near = F.filter(F.slice(at, k + template["need"], template["longest"]), lambda high: high - low < template["longest"])
            found = F.filter(F.transform(near, lambda high: measured(low, high)), lambda m: m["dice"] >= F.col("threshold"))
            return F.when(common(F.slice(pairs, low + 1, template["longest"])) >= template["need"], found).otherwise(F.array().cast(WINDOW))

        return F.flatten(F.transform(at, ends))

    hits = F.array_compact(F.transform(pairs, lambda p, i: F.when(F.array_contains(template["grams"], p), i)))
    return F.when(common(known_pairs) >= template["need"], F.flatten(F.transform(F.array(hits), search))).otherwise(F.array().cast(WINDOW))


def _known(texts: list[tuple[str, str]], threshold: float) -> Column:
    """The templates as one constant: they are data to the expressions, which don't grow with them."""
    rows = []
    for licence, text in texts:
        grams = bigrams_of(text)
        # A shade lower and longer, against rounding; the coefficient itself decides.
        need = max(1, math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9))
        longest = math.floor((2 - threshold) / threshold * length_of(text) + 1e-9)
        rows.append({"licence": licence, "grams": grams, "size": len(grams), "need": need, "longest": longest})
    return F.from_json(F.lit(json.dumps(rows)), TEMPLATE)


def scan(docs: DataFrame, templates: dict[str, str | list[str]] = ALL, threshold: float = 0.8) -> DataFrame:
    """doc_id, licence, dice (of the best match), n_units (units and places between them that match some template) of each document."""
    texts = [(k, t) for k, v in sorted(templates.items()) for t in ([v] if isinstance(v, str) else v)]
    if not 0 < len(texts) <= MAX_TEMPLATES:
        raise ValueError(f"between 1 and {MAX_TEMPLATES} templates are possible")
    sets = [(k, bigrams_of(t)) for k, t in texts]
    if not all(b for _, b in sets):
        raise ValueError("a template needs two words at least")
    words = sorted({w for _, b in sets for w in anchors(b, threshold)})
    pattern = any_of(words)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lower = F.lower(F.coalesce("text", F.lit("")))
    units = F.when(lower.rlike(pattern), F.split(lower, UNIT)).otherwise(F.array().cast("array<string>"))
    none = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("licence"))

    known = _known(texts, threshold)

    def best(bigrams: Column) -> Column:
        size = F.size(bigrams)
        like = lambda t: (size >= low * t["size"]) & (size <= high * t["size"])
        dice = lambda t: F.when(like(t), 2.0 * F.size(F.array_intersect(bigrams, t["grams"])) / (size + t["size"])).otherwise(0.0)
        scored = F.transform(known, lambda t: F.struct(dice(t).alias("dice"), t["licence"].alias("licence")))
        return F.reduce(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("licence")), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))

    judged = F.transform(units, lambda u: F.when(u.rlike(pattern), F.transform(F.array(_bigrams(u)), best)[0]).otherwise(none))
    split = docs.select("doc_id", units.alias("u"), judged.alias("m"))
    # An empty word stands for a full unit; it is in no template.
    rest = F.flatten(F.zip_with("u", "m", lambda u, m: F.when(m["dice"] == 1, F.array(F.lit(""))).otherwise(_words(u))))
    split = split.select("doc_id", F.filter("m", lambda m: m["dice"] >= threshold).alias("m"), _pairs(rest).alias("p"))
    # Bigrams are of a-z, 0-9 and blanks only, so they can be quoted.
    every_gram = ", ".join(f"'{x}'" for x in sorted({x for _, b in sets for x in b}))
    split = split.withColumn("k", F.expr(f"array_distinct(filter(p, x -> x in ({every_gram})))")).withColumn("threshold", F.lit(float(threshold)))
    windows = F.flatten(F.transform(known, lambda t: _windows(F.col("p"), F.col("k"), t)))
    found = split.select("doc_id", "m", F.when(F.size("k") > 0, F.array_sort(windows)).otherwise(F.array().cast(WINDOW)).alias("w"))
    # Windows that overlap are one place; they hold what matched in units that aren't full.
    places = F.reduce("w", F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), lambda a, w: F.struct(F.greatest(a["end"], w["high"]).alias("end"), (a["n"] + (w["low"] > a["end"]).cast("int")).alias("n")), lambda a: a["n"])
    every = F.concat("m", F.transform("w", lambda w: F.struct(w["dice"].alias("dice"), w["licence"].alias("licence"))))
    top = F.reduce(every, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("licence")), lambda a, b: F.when((b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["licence"] < a["licence"])), b).otherwise(a))
    full = F.size(F.filter("m", lambda m: m["dice"] == 1))
    return found.select("doc_id", F.greatest(full + places, F.least(F.size("m"), F.lit(1))).cast("bigint").alias("n_units"), top.alias("t")).select("doc_id", F.col("t.licence").alias("licence"), F.col("t.dice").alias("dice"), "n_units")


ship(__name__)
