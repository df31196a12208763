"""License scans: sentences are mapped to known licence sentences, their sequence is matched against ordered rules.

A text is read in two ways: line by line, and by paragraphs, in which lines are joined (lines without a letter or digit,
comment marks included, and colons at line ends part paragraphs). Both are cut after ``.``, ``!`` or ``?`` before white space. A sentence is
normalised by lower-casing A-Z and turning every run of other characters than a-z and 0-9 into one space, so that comment
marks and line ends within it do not matter. Two things are evened out before: ``v. 2`` is read as ``v 2``, so that a
version is never cut off its sentence, and whoever is named in "Neither the name of ... nor the names of its contributors"
counts as the copyright holder. A known sentence that is itself cut is known by its longest part. A rule is a list of sentence identifiers; it matches where they follow each other among the recognised sentences of either reading
(sentences that are not known may lie between). A rule whose list is part of a longer rule that also matches is dropped,
and so are the rules of ``WEAK`` names, which are no licences, where a licence is found.

Defined results: null and empty texts, and texts without known sentences, give an empty list; each repeated row gives a
row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, as they stand in the licences.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Licensed under the Apache License, Version 2.0 (the \"License\");",
    3: "you may not use this file except in compliance with the License.",
    4: "You may obtain a copy of the License at",
    5: "Released under the MIT License.",
    6: "The MIT License (MIT)",
    7: "Permission is hereby granted, free of charge, to any person obtaining a copy",
    8: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    9: "This work is licensed under the GNU General Public License, version 3.",
    10: "This program is free software: you can redistribute it and/or modify",
    11: "it under the terms of the GNU General Public License as published by",
    12: "This program is distributed in the hope that it will be useful,",
    13: "Licensed under CC BY-NC 4.0.",
    14: "Licensed under CC BY 4.0.",
    15: "Licensed under CC BY-SA 4.0.",
    16: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    17: "All rights reserved.",
    18: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    20: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    21: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    22: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    23: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    24: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    25: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    26: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    27: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    28: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    29: "This is free and unencumbered software released into the public domain.",
    30: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    31: "Distributed under the Boost Software License, Version 1.0.",
    32: "This software is provided 'as-is', without any express or implied warranty.",
    33: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    34: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    35: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    36: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    37: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    38: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    39: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    40: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    41: "SPDX-License-Identifier: MIT",
    42: "SPDX-License-Identifier: Apache-2.0",
    43: "SPDX-License-Identifier: BSD-2-Clause",
    44: "SPDX-License-Identifier: BSD-3-Clause",
    45: "SPDX-License-Identifier: ISC",
    46: "SPDX-License-Identifier: GPL-2.0-only",
    47: "SPDX-License-Identifier: GPL-2.0-or-later",
    48: "SPDX-License-Identifier: GPL-3.0-only",
    49: "SPDX-License-Identifier: GPL-3.0-or-later",
    50: "SPDX-License-Identifier: LGPL-2.1-or-later",
    51: "SPDX-License-Identifier: AGPL-3.0-or-later",
    52: "SPDX-License-Identifier: MPL-2.0",
    53: "SPDX-License-Identifier: EPL-2.0",
    54: "SPDX-License-Identifier: BSL-1.0",
    55: "SPDX-License-Identifier: Unlicense",
    56: "SPDX-License-Identifier: CC0-1.0",
    57: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    58: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    59: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    60: "Licensed under the MIT License.",
    61: "This project is licensed under the MIT License.",
    62: "Released under the Apache License, Version 2.0.",
    63: "Licensed under the BSD 2-Clause License.",
    64: "Licensed under the BSD 3-Clause License.",
    65: "Licensed under the ISC License.",
    66: "Licensed under the GNU General Public License, version 3.",
    67: "Licensed under the GNU General Public License, version 2.",
    68: "Licensed under the Mozilla Public License, v. 2.0.",
    69: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
}
RULES = [
    ("Apache-2.0", [1]),
    ("Apache-2.0", [2, 3]),
    ("Apache-2.0", [2, 3, 4]),
    ("MIT", [5]),
    ("MIT", [6]),
    ("MIT", [7, 8]),
    ("GPL-3.0", [9]),
    ("GPL-3.0", [10, 11, 12]),
    ("CC-BY-NC-4.0", [13]),
    ("CC-BY-4.0", [14]),
    ("CC-BY-4.0", [16]),
    ("CC-BY-SA-4.0", [15]),
    ("BSD-2-Clause", [18]),
    ("BSD-3-Clause", [18, 19]),
    ("MPL-2.0", [20]),
    ("Proprietary", [17]),
    ("Apache-2.0", [2, 3, 21]),
    ("MIT", [22, 8]),
    ("ISC", [23]),
    ("GPL-3.0-or-later", [24]),
    ("GPL-3.0-or-later", [24, 26]),
    ("GPL-2.0-or-later", [25]),
    ("GPL-2.0-or-later", [25, 26]),
    ("LGPL-2.1-or-later", [27]),
    ("AGPL-3.0-or-later", [28]),
    ("Unlicense", [29]),
    ("Unlicense", [29, 30]),
    ("BSL-1.0", [31]),
    ("Zlib", [32, 33]),
    ("EPL-2.0", [34]),
    ("CC0-1.0", [35]),
    ("BSD-2-Clause", [18, 36, 37]),
    ("BSD-3-Clause", [18, 36, 37, 19]),
    ("CC-BY-SA-4.0", [38]),
    ("CC-BY-NC-4.0", [39]),
    ("CC-BY-ND-4.0", [40]),
    ("MIT", [41]),
    ("Apache-2.0", [42]),
    ("BSD-2-Clause", [43]),
    ("BSD-3-Clause", [44]),
    ("ISC", [45]),
    ("GPL-2.0-only", [46]),
    ("GPL-2.0-or-later", [47]),
    ("GPL-3.0-only", [48]),
    ("GPL-3.0-or-later", [49]),
    ("LGPL-2.1-or-later", [50]),
    ("AGPL-3.0-or-later", [51]),
    ("MPL-2.0", [52]),
    ("EPL-2.0", [53]),
    ("BSL-1.0", [54]),
    ("Unlicense", [55]),
    ("CC0-1.0", [56]),
    ("MPL-1.1", [57]),
    ("MPL-1.1", [58]),
    ("Apache-2.0", [59]),
    ("MIT", [60]),
    ("MIT", [61]),
    ("Apache-2.0", [62]),
    ("BSD-2-Clause", [63]),
    ("BSD-3-Clause", [64]),
    ("ISC", [65]),
    ("GPL-3.0", [66]),
    ("GPL-2.0", [67]),
    ("MPL-2.0", [68]),
    ("MPL-1.1", [69]),
]
#: Names that say no more than that rights are kept, as notices of licences do as well.
WEAK = ["Proprietary"]
_VERSION = ("([ \t\r\n(,])[vV][.][ \t\r]+([0-9])", r"{0}1v {0}2")
_HOLDER = ("^neither the name of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors")


def sentences(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _VERSION[0], _VERSION[1].format("$"))
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")


def joined(text: Column) -> Column:
    """The paragraphs of a text as one line each."""
    parted = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n[^A-Za-z0-9\n]*\n|:[ \t\r]*\n", "\x01")
    return F.replace(F.replace(parted, F.lit("\n"), F.lit(" ")), F.lit("\x01"), F.lit("\n"))


def _normalised(sentence: Column) -> Column:
    lower = F.translate(sentence, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), *_HOLDER)


def _known(table: dict[int, str]) -> dict[str, int]:
    import re

    out: dict[str, int] = {}
    for number, sentence in table.items():
        parts = re.sub(r"([.!?])[ \t\r]+", "\\1\n", re.sub(_VERSION[0], _VERSION[1].format("\\"), sentence)).split("\n")
        normal = [re.sub("[^a-z0-9]+", " ", p.lower()).strip() for p in parts]
        out.setdefault(max(normal, key=len), number)
    return out


def scan_licenses(docs: DataFrame, table: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` per document.

    ``sentence_ids``: the sentences recognised in paragraphs in their order, then those recognised in lines only;
    ``licenses``, sorted, are found in either reading.
    """
    known = _known(table or SENTENCES)
    rules = rules or RULES
    least = min(map(len, known))
    number = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def ids(text: Column) -> Column:
        enough = F.filter(sentences(text), lambda s: F.length(s) >= least)  # normalising never adds characters
        hits = F.filter(F.transform(enough, _normalised), lambda s: s.isin(list(known)))
        return F.transform(hits, lambda s: number[s])

    out = docs.select("doc_id", ids(joined(F.col("text"))).alias("whole"), ids(F.col("text")).alias("lines"))
    as_text = lambda c: F.concat(F.lit(","), F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
    met = lambda own: as_text("whole").contains(_as_list(own)) | as_text("lines").contains(_as_list(own))
    found = []
    for name, own in rules:
        hit = met(own)
        for _, other in rules:
            if len(other) > len(own) and _as_list(own) in _as_list(other):
                hit = hit & ~met(other)
        found.append(F.when(hit, F.lit(name)))
    found = F.array_compact(F.array(*found))
    strong = F.array_except(found, F.array(*map(F.lit, WEAK)))
    licenses = F.sort_array(F.array_distinct(F.when(F.size(strong) > 0, strong).otherwise(found)))
    every = F.concat("whole", F.filter("lines", lambda i: ~F.array_contains("whole", i)))
    none = F.array().cast("array<string>")
    some = F.size("whole") + F.size("lines") > 0
    return out.select("doc_id", every.alias("sentence_ids"), F.when(some, licenses).otherwise(none).alias("licenses"))


def _as_list(ids: list[int]) -> str:
    return "," + ",".join(map(str, ids)) + ","
