"""License scans by a trained paragraph classifier.

Paragraphs are runs of lines between blank ones, and their pieces are lines, cut further at the ends of sentences. A notice is
looked for in windows of a paragraph's consecutive pieces, so that it is found however it is wrapped and whatever prose
surrounds it. A sparse logistic regression over word n-grams (Spark's own, with an L1 penalty) is trained on wordings of each
family, and on an unknown class of paragraphs that hold licence words and license nothing. A prediction must exceed a probability
that few held-out paragraphs of the unknown class exceed, and one of the family's templates, which are no part of what is
learnt from, must confirm it by shared n-grams.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .secrets import let

UNKNOWN = "unknown"
#: Bounds of the labelled sample: pieces of documents of the unknown class that hold licence words, and that hold none
#: (those made from wordings are few).
SAMPLE_TOLD, SAMPLE_PLAIN = 1000, 250
#: N-grams in the vocabulary at most.
VOCABULARY = 20_000
#: Share of a template's n-grams that a window must hold; of a template of fewer than SHORT words also the share of the
#: window's n-grams that the template must hold, as few words prove little in other company (of two words all n-grams, see needed).
CONFIRMED, SHORT = 0.6, 6
#: Share of held-out paragraphs of the unknown class that may exceed the probability.
FALSE_RATE = 0.1
#: A sampled piece is of the unknown class only if it holds a smaller share of every template than this.
APART = 0.3
#: Words of a piece at most, and words that a window holds at most between its first and its last piece (more than the longest template has).
PIECE_WORDS, REACH = 30, 70
#: Buckets of the look-up by n-gram.
BUCKETS = 1024

#: What the licences' stewards recommend to write, by family. These confirm.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License, Version 2.0, January 2004", "The Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish", "The MIT License (MIT)", "MIT License", "Licensed under MIT", "SPDX-License-Identifier: MIT", "The Software is provided \"as is\", without warranty of any kind, express or implied"],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "SPDX-License-Identifier: ISC"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU General Public License, Version 3, 29 June 2007", "GNU General Public License", "Licensed under the GPL, version 2", "Licensed under GPLv3", "Released under the GNU GPL", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU Lesser General Public License, Version 3, 29 June 2007", "Licensed under the LGPL, version 2.1", "Released under the GNU LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "bsd": ["Distributed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD 2-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License, Version 2.0", "Released under the MPL 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Confidential and proprietary", "Copying of this file is strictly prohibited"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License, Version 3, 19 November 2007", "GNU Affero General Public License", "Released under the GNU AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "epl": ["Eclipse Public License - v 2.0", "Licensed under the Eclipse Public License", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "bsl-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
#: The licences' names and short names, in small letters and without marks. One that stands whole in a window confirms a prediction.
NAMES = {
    "apache-2.0": ["apache license", "apache licence", "apache 2 0"],
    "mit": ["mit license", "mit licence", "mit licensed", "license mit"],
    "isc": ["isc license", "isc licence", "license isc"],
    "gpl": ["gnu general public license", "gnu gpl", "gplv2", "gplv3", "license gpl", "identifier gpl"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgplv2", "lgplv3", "license lgpl", "identifier lgpl"],
    "agpl": ["gnu affero general public license", "gnu agpl", "agplv3", "license agpl", "the agpl"],
    "bsd": ["bsd license", "bsd licence", "clause bsd", "bsd 2 clause", "bsd 3 clause", "license bsd"],
    "mpl-2.0": ["mozilla public license", "license mpl"],
    "epl": ["eclipse public license", "license epl", "the epl"],
    "bsl-1.0": ["boost software license", "license bsl"],
    "unlicense": ["the unlicense", "license unlicense", "into the public domain"],
    "cc-by": ["creative commons attribution international", "creative commons attribution 4 0"],
    "cc-by-nc": ["creative commons attribution noncommercial"],
    "cc-by-sa": ["creative commons attribution sharealike"],
    "proprietary": ["all rights reserved", "rights are reserved", "strictly prohibited"],
}
#: A name confirms in a window that holds one of these words, or no more n-grams than SHORT different words have: elsewhere it is only spoken of.
GRANTS = "available copyright covered distributed governed identifier licensed received redistribute released subject terms".split()
#: What is learnt from: other wordings of each family. (Of "All rights reserved" there is no other.)
WORDINGS = {
    "apache-2.0": ["This project is licensed under the Apache License 2.0, see the LICENSE file.", "Apache License, Version 2.0, January 2004.", "You may not use this work except in compliance with the Apache License, Version 2.0 (the \"License\").", "Distributed under the terms of the Apache License (version 2.0).", "The code is available under Apache 2.0 and you may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "License: Apache-2.0", "Apache License Version 2.0", "Licensed under Apache 2.0.", "The library is released under the Apache License."],
    "mit": ["This project is licensed under the MIT License - see the LICENSE file for details.", "The MIT License (MIT).", "Permission is granted, free of charge, to any person who obtains a copy of this program and its documentation, to deal in it without restriction, and to use, copy, modify, merge, publish, distribute, sublicense and sell copies.", "MIT licensed, free of charge to any person obtaining a copy of the software and associated files.", "The code is released under the terms of the MIT license.", "License: MIT", "MIT licensed.", "MIT License, see LICENSE.", "MIT, see the file LICENSE.", "The MIT licence applies.", "Under the MIT License.", "Licensed: MIT.", "SPDX-License-Identifier: MIT", "Copyright (c) 2020 Jane Doe, MIT License.", "It is provided as is, without warranty of any kind."],
    "isc": ["This package is distributed under the ISC License.", "ISC License (ISC).", "Permission to copy, modify and distribute this package for any purpose with or without fee is granted, if the copyright notice and this permission notice appear in all copies.", "Use it for any purpose with or without fee under the terms of the ISC license.", "License: ISC", "The ISC license applies.", "SPDX-License-Identifier: ISC"],
    "gpl": ["You can redistribute this package under the terms of the GNU General Public License, version 2 or later.", "Released under the GNU GPL, version 3.", "It is free software under the terms of the GNU General Public License as published by the Free Software Foundation.", "This file is licensed under the GNU General Public License, version 2 or any later version.", "You should have received a copy of the GNU General Public License along with this program.", "License: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only", "GPLv2 or later.", "GPLv3 or later.", "Under GPLv3.", "Licensed under the GPLv2.", "The GNU General Public License, version 2, June 1991."],
    "lgpl": ["You can redistribute this package under the terms of the GNU Lesser General Public License, version 2.1 or later.", "Released under the GNU LGPL, version 3.", "It is a free library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "License: LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only", "LGPLv2.1 or later.", "The GNU Lesser General Public License, version 2.1, February 1999."],
    "bsd": ["This project is licensed under the BSD 3-Clause License, see LICENSE.", "Redistribution in source and binary forms, with or without modification, is permitted if the following conditions are met.", "The use of this code is governed by a BSD license that can be found in the LICENSE file.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the 2-clause BSD license.", "License: BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause", "The 3-Clause BSD License.", "The BSD 2-Clause Licence.", "Available under the two-clause BSD licence."],
    "mpl-2.0": ["This file is subject to the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "You can obtain a copy of the Mozilla Public License at https://mozilla.org/MPL/2.0/ if none was distributed with this file.", "License: MPL-2.0", "SPDX-License-Identifier: MPL-2.0-no-copyleft-exception", "The Mozilla Public License 2.0."],
    "cc-by": ["This text is available under CC BY 4.0.", "Available under the Creative Commons Attribution 4.0 licence.", "Shared under a Creative Commons Attribution International License.", "License: CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This text is available under CC BY-NC 4.0.", "Available under the Creative Commons Attribution-NonCommercial 4.0 licence.", "Shared under a Creative Commons Attribution-NonCommercial International License.", "License: CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This text is available under CC BY-SA 4.0.", "Available under the Creative Commons Attribution-ShareAlike 4.0 licence.", "Shared under a Creative Commons Attribution-ShareAlike International License.", "License: CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "proprietary": ["Copyright 2021, all rights reserved.", "All rights are reserved by the company.", "(c) 2019 Example Ltd, all rights reserved.", "Copyright by the authors. All rights reserved.", "Copying this file without permission is strictly prohibited, it is confidential and proprietary.", "Confidential and proprietary: unauthorized use or copying of any part is prohibited.", "All rights reserved worldwide.", "All rights reserved 2020.", "All rights reserved", "all rights reserved.", "All Rights Reserved.", "ALL RIGHTS RESERVED", "(c) All rights reserved", "All rights are reserved.", "All rights reserved, by the owner.", "Example Ltd. All rights reserved"],
    "agpl": ["License: AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL, version 3.", "This server is free software under the terms of the GNU Affero General Public License.", "You should have received a copy of the GNU Affero General Public License with it.", "Licensed under AGPLv3 or later."],
    "epl": ["License: EPL-1.0", "SPDX-License-Identifier: EPL-1.0", "Released under the EPL, version 2.0.", "All rights to the materials are granted under the Eclipse Public License v1.0 which accompanies this distribution.", "The Eclipse Public License, version 2.0.", "Eclipse Public License v1.0."],
    "bsl-1.0": ["License: BSL-1.0", "Boost Software License 1.0.", "Use is subject to the Boost Software License, see the file LICENSE_1_0.txt.", "Licensed under the Boost Software License."],
    "unlicense": ["License: Unlicense", "This code is released into the public domain.", "The Unlicense.", "It is free and unencumbered, given into the public domain."],
}
#: Sentences that share words with notices and license nothing; one in two is held out.
NEAR_MISSES = [
    "He lost his driving license in version 2 of the story.", "The general public was released under the bridge.", "Permission was not granted to work on this file.", "The mit students licensed the software to a library.",
    "All rights of way are reserved for free and open source foundation work.", "This work is a copy of an international software conference program.", "He wrote that all reserved seats were sold out.", "The public library is free and you can modify your booking.",
    "Attribution of the painting is not settled, and the commons were creative about it.", "The source of the river is in binary star country.", "A general can use this road without restriction.", "The foundation published the terms of its software award.",
    "Mozilla is a nickname and the public liked it.", "She was granted a copy of the keys, free of charge.", "Distribution of the population was found in the file.", "Redistribution of wealth was on the following list of conditions.",
    "The rights to the book are with the publisher.", "Under the license plate was a note.", "Your use of the pool is governed by the house rules.", "Copying out poems is permitted in class.",
    "The apache crossed the river at dawn.", "Version 2.0 of the license fee debate begins.", "A confidential source spoke of copying in the office.", "Everyone has the right to a fair trial, and rights are not reserved for a few.",
]
#: For each wording of eight words or more so many texts of the same words in an order that says nothing; they are of the unknown class.
SHUFFLES = 3
#: Words of which a sampled piece of the first unknown kind holds one.
LICENCE_WORDS = r"(?i)licen[sc]|copyright|permi[st]|distribut|reserved|rights|commons|software|foundation|warrant|copy"
#: Words that say little; pairs without them are asked for first.
COMMON = frozenset("a all and any are at be by can either file following for from if in is it may not of or that the this to under was with without work you your".split())
#: A sentence ends here, and what follows is white space.
_SENTENCE = r"(?<=[.!?;:])(?=\s)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct word 1-, 2- and 3-grams."""
    none = F.array().cast("array<string>")

    def of(own: Column) -> Column:
        at = lambda n: F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.array_join(F.slice(own, i, n), " "))
        return F.array_distinct(F.concat(own, F.when(F.size(own) >= 2, at(2)).otherwise(none), F.when(F.size(own) >= 3, at(3)).otherwise(none)))

    return let(words, of)


def grams_of_text(text: str) -> list[str]:
    """What grams_of finds in a template (ASCII)."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


#: (family, n-grams, whether it is short) of each template, and of each name (None).
_TEMPLATES = [(f, grams_of_text(t), len(re.findall("[a-z0-9]+", t.lower())) < SHORT) for f, ts in TEMPLATES.items() for t in ts]
_TEMPLATES += [(f, grams_of_text(t), None) for f, ts in NAMES.items() for t in ts]


def needed(grams: list[str], short: bool | None) -> float:
    """The share of a template's n-grams that confirms it; of a name, and of a template of two words, it is all of them, as the words apart say nothing."""
    return 1.0 if short is None or len(grams) == 3 else CONFIRMED


def needed_pairs() -> list[tuple[str, ...]]:
    """Pairs of words in a row, and names of one word, of which a window must hold one: without those of a template it holds too few of its n-grams to be confirmed."""
    out = set()
    for _, grams, short in _TEMPLATES:
        gone, need = set(), needed(grams, short) * len(grams)
        if len(grams) == 1:
            out.add((grams[0],))
            continue
        pairs = [g for g in grams if g.count(" ") == 1]
        for pair in sorted(pairs, key=lambda g: (len(COMMON.intersection(g.split())), -len(g), g)):
            if len(grams) - len(gone) < need:
                break
            out.add(tuple(pair.split()))
            gone |= {g for g in grams if f" {pair} " in f" {g} "}
        assert len(grams) - len(gone) < need
    return sorted(out)


def may_hold() -> str:
    """A pattern that each window with a confirmed notice matches."""
    by: dict[str, list[str]] = {}
    for a, *b in needed_pairs():
        by.setdefault(a, []).extend(b)
    each = "|".join(f"{a}[^\\p{{L}}\\p{{N}}]++(?:{'|'.join(bs)})" if bs else a for a, bs in by.items())
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{each})(?![\p{{L}}\p{{N}}])"


class Model:
    """For each weighted gram its weights by family, intercepts likewise, and the least probability; all of bounded size."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], intercepts: list[float], least: float):
        self.families, self.weights, self.intercepts, self.least = families, weights, intercepts, least


def _constant(value, kind: str) -> Column:
    """A constant of many parts as one literal; Spark reads it once, when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lookup(weights: dict[str, list[float]]):
    """gram -> struct<w, t>: its weights (none if it has none) and the numbers of the templates that hold it; null if it is not known."""
    of: dict[str, dict] = {g: {"w": w, "t": []} for g, w in weights.items()}
    for k, (_, grams, _) in enumerate(_TEMPLATES):
        for g in grams:
            of.setdefault(g, {"w": None, "t": []})["t"].append(k)
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for g, v in of.items():
        buckets[zlib.crc32(g.encode()) % BUCKETS][g] = v
    table = _constant(buckets, "array<map<string, struct<w: array<double>, t: array<int>>>>")
    return lambda g: F.try_element_at(F.get(table, (F.crc32(g) % BUCKETS).cast("int")), g)


def _shares(hits: Column, n: Column, templates: list[int], grants: Column) -> Column:
    """The largest share that hits (of n grams in all) have of one of these templates; of a short one both shares must do, and a name counts where grants is true."""

    def share(k: int) -> Column:
        _, grams, short = _TEMPLATES[k]
        both = F.size(F.filter(hits, lambda h: F.array_contains(h["t"], k)))
        if short is None:  # the least that confirms, so that a template that is there too decides where the notice begins and ends
            return F.when(grants & (both == len(grams)), F.lit(CONFIRMED)).otherwise(0.0)
        return F.when((both / n >= CONFIRMED) & (both >= needed(grams, short) * len(grams)), both / len(grams)).otherwise(0.0) if short else both / len(grams)

    return F.array_max(F.array(*map(share, templates)))


def _judged(paragraph: Column, model: Model, lookup) -> Column:
    """struct<family, probability, overlap> of a paragraph, null where it is unknown or not confirmed."""
    zero = _constant(model.intercepts, "array<double>")
    families = _constant(model.families, "array<string>")
    of = {f: [k for k, (g, _, _) in enumerate(_TEMPLATES) if g == f] for f in TEMPLATES}  # names too

    def scored(hits: Column, n: Column, grants: Column) -> Column:
        add = lambda acc, h: F.when(h["w"].isNull(), acc).otherwise(F.zip_with(acc, h["w"], lambda a, b: a + b))
        return let(F.aggregate(hits, zero, add), lambda z: predicted(hits, n, z, grants))

    def predicted(hits: Column, n: Column, z: Column, grants: Column) -> Column:
        most = F.array_max(z)
        family = F.element_at(families, F.array_position(z, most).cast("int"))
        p = 1 / F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
        overlap = F.lit(0.0)
        for f, ks in of.items():
            overlap = F.when(family == f, _shares(hits, n, ks, grants)).otherwise(overlap)
        return let(F.struct(family.alias("family"), p.alias("probability"), overlap.alias("overlap")), lambda j: F.when((j["family"] != UNKNOWN) & (j["probability"] > model.least) & (j["overlap"] >= CONFIRMED), j))

    return let(grams_of(words_of(paragraph)), lambda gs: let(F.filter(F.transform(gs, lookup), lambda h: h.isNotNull()), lambda hits: F.when(F.size(hits) > 0, scored(hits, F.size(gs), (F.size(gs) <= 3 * SHORT - 3) | F.arrays_overlap(gs, F.array(*map(F.lit, GRANTS)))))))


def pieces_of(text: Column) -> Column:
    """Lines with their ends, cut after sentences and after PIECE_WORDS words; together they are the text."""
    found = F.regexp_extract_all(text, F.lit(r"[^\S\n]*+(?:\S++[^\S\n]*+){0,%d}+\n?+" % PIECE_WORDS), F.lit(0))
    return F.filter(F.flatten(F.transform(found, lambda x: F.split(x, _SENTENCE, -1))), lambda x: x != "")


def _sample(docs: DataFrame) -> list[tuple[str, bool]]:
    """(piece, whether it holds licence words): pieces of documents that hold little of any template, drawn by a hash."""
    n = docs.count()
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    some = docs.where(F.pmod(order, F.lit(1 << 20)) < min(1.0, 8 * SAMPLE_TOLD / max(1, n)) * (1 << 20))
    lookup = _lookup({})
    held = lambda t: let(grams_of(words_of(t)), lambda gs: let(F.filter(F.transform(gs, lookup), lambda h: h.isNotNull()), lambda hits: F.array_max(F.array(*[F.size(F.filter(hits, lambda h, k=k: F.array_contains(h["t"], k))) / len(g) for k, (_, g, short) in enumerate(_TEMPLATES) if short is not None]))))
    each = some.select(F.explode(pieces_of(F.col("text"))).alias("piece"))
    each = each.where((F.length("piece") < 2000) & F.col("piece").rlike(r"\p{L}")).select("piece", F.col("piece").rlike(LICENCE_WORDS).alias("told"), F.xxhash64("piece").alias("h"))
    number = {r.told: r.n for r in each.groupBy("told").agg(F.count("*").alias("n")).collect()}
    out = []
    for told, most in ((True, SAMPLE_TOLD), (False, SAMPLE_PLAIN)):
        share = min(1.0, 8 * most / max(1, number.get(told, 0)))  # so that few rows are left to be put in order
        few = each.where((F.col("told") == told) & (F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))).select("piece", "h").distinct().orderBy("h", "piece").limit(2 * most)
        out += [(r.piece, told) for r in few.where(held(F.col("piece")) < APART).orderBy("h", "piece").limit(most).collect()]
    return out


def _training(docs: DataFrame) -> list[tuple[str, str, bool]]:
    """(text, family, held): wordings, alone and among ordinary words; the unknown class, of which one in two that hold licence words is held out."""
    sample = _sample(docs)
    around = [p.strip()[:60] for p, told in sample if not told][:8] or [""]
    known = [(f"{a} {t} {b}".strip(), f, False) for f, ts in WORDINGS.items() for t in ts for a, b in [*[("", "")] * 6, *((p, "") for p in around[:3]), *(("", p) for p in around[3:6])]]
    draw = random.Random(1)
    mixed = [" ".join(draw.sample(words, len(words))) for ts in WORDINGS.values() for t in ts for words in [t.split()] if len(words) >= 8 for _ in range(SHUFFLES)]
    told = sorted({*NEAR_MISSES, *mixed, *(p.strip() for p, told in sample if told)}, key=lambda t: zlib.crc32(t.encode()))
    return known + [(t, UNKNOWN, k % 2 == 1) for k, t in enumerate(told)] + [(p.strip(), UNKNOWN, False) for p, told in sample if not told]


def train(docs: DataFrame) -> Model:
    """Fits the classifier; docs (doc_id, text) give pieces of the unknown class, SAMPLE_TOLD and SAMPLE_PLAIN at most; with none, NEAR_MISSES do."""
    spark = docs.sparkSession
    families = [*WORDINGS, UNKNOWN]
    rows = spark.createDataFrame(_training(docs.select("doc_id", "text").dropna()), "text string, family string, held boolean").withColumn("grams", grams_of(words_of(F.col("text"))))
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    # Families weigh alike, and the unknown class as much as all of them.
    share = F.when(F.col("family") == UNKNOWN, F.lit(len(WORDINGS))).otherwise(F.lit(1)) / F.count("*").over(Window.partitionBy("family", "held"))
    rows = rows.withColumn("weight", share * 100).select("grams", "label", "held", "weight").coalesce(1).cache()  # bounded, and each iteration is a job
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(rows.where("not held"))
    fitted = LogisticRegression(weightCol="weight", family="multinomial", regParam=0.0002, elasticNetParam=1.0, maxIter=40, tol=1e-4).fit(counter.transform(rows.where("not held")))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    held = fitted.transform(counter.transform(rows.where("held"))).select(F.array_max(F.slice(vector_to_array("probability"), 1, len(WORDINGS))).alias("p"))
    sure = sorted(r.p for r in held.collect())  # half of SAMPLE_TOLD at most, and the near misses
    rows.unpersist()
    # The least value that one more paragraph of the unknown class exceeds with FALSE_RATE at most, as far as so many can tell.
    least = sure[min(len(sure), math.ceil((len(sure) + 1) * (1 - FALSE_RATE))) - 1]
    weights = {counter.vocabulary[j]: matrix[:, j].tolist() for j in matrix.any(0).nonzero()[0]}
    return Model(families, weights, bias.tolist(), least)


def license_scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, family, probability, overlap): where docs (doc_id, text) hold a licence notice.

    Lines without a letter or digit part paragraphs. Looked at are all windows of consecutive pieces of a paragraph with at
    most REACH words between the first and the last piece. Of windows that share a piece the one of largest overlap is
    reported, then the shortest, then the first. start and end are code points, without white space at the ends. family has the
    largest probability of all families, more than the model's least (of equal ones the first), and overlap is the largest share of
    one of its templates' n-grams that the window holds, at least CONFIRMED.

    Null, empty and blank texts have none; texts are scanned whole; repeated rows give their findings each; a null doc_id
    stays null. Other columns are ignored. An empty table gives an empty one.

    All of it happens within a row, with no shuffle. Texts and windows without the pairs of words of which a confirmed notice has one
    are not scored, as no prediction could stand there, nor are windows that begin or end with a piece that has no
    template's word, as a shorter one holds as much; this loses nothing.
    """
    pattern = may_hold()
    lookup = _lookup(model.weights)
    of_template = lambda w: F.coalesce(F.size(lookup(w)["t"]) > 0, F.lit(False))
    none = F.array().cast("array<int>")

    def about(lines: Column) -> Column:
        """For each piece its words, whether a template has one of them, and whether it, or its end and the next one, holds a pair."""
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        may = lambda i: F.concat(F.get(lines, i), F.lit(" "), F.coalesce(F.substring(F.get(lines, i + 1), 1, 200), F.lit(""))).rlike(pattern)
        return F.transform(at, lambda i: let(words_of(F.get(lines, i)), lambda w: F.struct(F.size(w).alias("words"), may(i).alias("may"), w.alias("own"))))

    def near(xs: Column) -> Column:
        """The same, with edge only told where a pair is within reach."""
        marks = F.filter(F.transform(xs, lambda x, i: F.when(x["may"], i)), lambda i: i.isNotNull())
        edge = lambda ms, x, i: F.when(F.exists(ms, lambda m: F.abs(m - i) <= REACH + 2), F.exists(x["own"], of_template)).otherwise(False)
        return let(marks, lambda ms: F.transform(xs, lambda x, i: F.struct(x["words"].alias("words"), x["may"].alias("may"), edge(ms, x, i).alias("edge"))))

    def ends(xs: Column, i: Column) -> Column:
        """How many pieces the windows have that begin with piece i."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("inside"), F.lit(False).alias("may"), F.lit(True).alias("on"), none.alias("out"))

        def add(acc: Column, x: Column) -> Column:
            on, may, n = acc["on"] & (x["words"] > 0) & (acc["inside"] < REACH), acc["may"] | x["may"], acc["n"] + 1
            return F.struct(n.alias("n"), (acc["inside"] + F.when(acc["n"] > 0, x["words"]).otherwise(0)).alias("inside"), may.alias("may"), on.alias("on"), F.when(on & may & x["edge"], F.array_append(acc["out"], n)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.slice(xs, i + 1, REACH + 2), start, add, lambda acc: acc["out"])

    def windows(lines: Column, xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(xs, i)["edge"])
        each = F.flatten(F.transform(starts, lambda i: F.transform(ends(xs, i), lambda n: F.struct(i.alias("i"), n.alias("n")))))
        judged = F.transform(each, lambda w: F.struct(w["i"].alias("i"), w["n"].alias("n"), _judged(F.array_join(F.slice(lines, w["i"] + 1, w["n"]), ""), model, lookup).alias("j")))
        best = F.array_sort(F.transform(F.filter(judged, lambda w: w["j"].isNotNull()), lambda w: F.struct((-w["j"]["overlap"]).alias("o"), w["n"].alias("n"), w["i"].alias("i"), w["j"].alias("j"))))
        apart = lambda kept, w: ~F.exists(kept, lambda k: (k["i"] < w["i"] + w["n"]) & (w["i"] < k["i"] + k["n"]))
        return let(best, lambda best: F.aggregate(best, F.filter(best, lambda w: F.lit(False)), lambda kept, w: F.when(apart(kept, w), F.array_append(kept, w)).otherwise(kept)))

    def found(lines: Column) -> Column:
        kept = let(about(lines), lambda xs: let(near(xs), lambda ys: windows(lines, ys)))
        part = lambda lo, n: F.array_join(F.slice(lines, lo, n), "")
        before = lambda w: F.when(w["i"] > 0, F.length(part(F.lit(1), w["i"]))).otherwise(0)
        blank = lambda w: F.length(part(w["i"] + 1, w["n"])) - F.length(F.regexp_replace(part(w["i"] + 1, w["n"]), r"^\s+", ""))
        return F.transform(kept, lambda w: F.struct((before(w) + blank(w)).alias("start"), F.length(F.regexp_replace(part(w["i"] + 1, w["n"]), r"^\s+|\s+\z", "")).alias("n"), w["j"].alias("j")))

    rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.explode(let(pieces_of(F.col("text")), found)).alias("p"))
    return rows.select("doc_id", "p.start", (F.col("p.start") + F.col("p.n")).alias("end"), "p.j.family", "p.j.probability", "p.j.overlap")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its licence families (sorted, distinct), the number of notices and where they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = F.concat_ws(":", "family", F.col("start").cast("string"), F.col("end").cast("string"))
    found = license_scan(docs, train(docs)).groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set(F.struct("start", listed.alias("text")))).alias("notices"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), F.coalesce(F.size("notices"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join(F.transform("notices", lambda s: s["text"]), ","), F.lit("")).alias("notices"))
