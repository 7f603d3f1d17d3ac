"""Licence scan by sentence rules (DataFrame expressions only).

Texts are cut into sentences, sentences are normalised and looked up among known licence
sentences, and the sequence of found identifiers is matched against ordered rules: the
first rule that fits takes its identifiers out of the sequence, later rules see the rest.
One scan, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, named

# Sentences of public licence notices and texts, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "ApacheVer2": ("Licensed under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "ApacheUse": ("you may not use this file except in compliance with the License",),
    "ApacheCopy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "ApacheBasis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "ApacheSee": ("See the License for the specific language governing permissions and limitations under the License",),
    "MITrelease": ("Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License",
                   "Distributed under the MIT License"),
    "MITgrant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                 "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
                 "is furnished to do so, subject to the following conditions",),
    "MITnotice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "MITasis": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "ISCgrant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies",),
    "BSDredist": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                  "conditions are met",),
    "BSDsource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSDbinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSDendorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",),
    "BSDrelease": ("Released under the BSD License", "Licensed under the BSD License"),
    "GPLver3": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "GPLver2": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "GPLfree3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPLfree2": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                 "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "GPLhope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "GPLsee": ("See the GNU General Public License for more details",),
    "LGPLver3": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "MPLver2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "AGPLver3": ("This work is licensed under the GNU Affero General Public License, version 3",
                 "Licensed under the GNU Affero General Public License, version 3"),
    "AGPLfree3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "AGPLsee": ("See the GNU Affero General Public License for more details",),
    "LGPLfree3": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "LGPLfree21": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                   "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "LGPLhope": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                 "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "LGPLsee": ("See the GNU Lesser General Public License for more details",),
    "MPLcopy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "EPLver2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                "https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0"),
    "BSDasis": ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
                "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",),
    "ISCasis": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                "WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "Zlibasis": ("This software is provided 'as-is', without any express or implied warranty",),
    "Zlibgrant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
                  "redistribute it freely, subject to the following restrictions",),
    "BSL1": ("Distributed under the Boost Software License, Version 1.0",),
    "SPDX": ("SPDX-License-Identifier",),
    "CCBY4": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0",
              "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CCBYSA4": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0",
                "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CCBYNC4": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0",
                "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0": ("Licensed under CC0 1.0", "This work is dedicated to the public domain under the CC0 1.0 license"),
    "Unlicense": ("This is free and unencumbered software released into the public domain without license conditions",),
}

# Ordered rules, identifiers in sequence -> licence.  Longer rules stand before their parts.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("ApacheVer2", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"), "Apache-2.0"),
    (("ApacheVer2", "ApacheUse"), "Apache-2.0"),
    (("ApacheVer2",), "Apache-2.0"),
    (("MITgrant", "MITnotice", "MITasis"), "MIT"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("MITrelease",), "MIT"),
    (("ISCgrant", "ISCasis"), "ISC"),
    (("ISCgrant",), "ISC"),
    (("BSDredist", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis"), "BSD-3-Clause"),
    (("BSDredist", "BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("BSDredist", "BSDsource", "BSDbinary", "BSDasis"), "BSD-2-Clause"),
    (("BSDredist", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("Zlibasis", "Zlibgrant"), "Zlib"),
    (("AGPLfree3", "GPLhope", "AGPLsee"), "AGPL-3.0-or-later"),
    (("AGPLfree3",), "AGPL-3.0-or-later"),
    (("AGPLver3",), "AGPL-3.0"),
    (("LGPLfree3", "LGPLhope", "LGPLsee"), "LGPL-3.0-or-later"),
    (("LGPLfree21", "LGPLhope", "LGPLsee"), "LGPL-2.1-or-later"),
    (("LGPLfree3",), "LGPL-3.0-or-later"),
    (("LGPLfree21",), "LGPL-2.1-or-later"),
    (("EPLver2",), "EPL-2.0"),
    (("BSL1",), "BSL-1.0"),
    (("MPLver2", "MPLcopy"), "MPL-2.0"),
    (("BSDrelease",), "BSD"),
    (("GPLfree3", "GPLhope", "GPLsee"), "GPL-3.0-or-later"),
    (("GPLfree2", "GPLhope", "GPLsee"), "GPL-2.0-or-later"),
    (("GPLfree3",), "GPL-3.0-or-later"),
    (("GPLfree2",), "GPL-2.0-or-later"),
    (("GPLver3",), "GPL-3.0"),
    (("GPLver2",), "GPL-2.0"),
    (("LGPLver3",), "LGPL-3.0"),
    (("MPLver2",), "MPL-2.0"),
    (("CCBYNC4",), "CC-BY-NC-4.0"),
    (("CCBYSA4",), "CC-BY-SA-4.0"),
    (("CCBY4",), "CC-BY-4.0"),
    (("CC0",), "CC0-1.0"),
    (("Unlicense",), "Unlicense"),
)

# Licence names of SPDX lines.  A name counts only behind the identifier sentence.
SPDX_NAMES = ("MIT", "Apache-2.0", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
              "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
              "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")
SENTENCES.update({f"SPDX:{name}": (name,) for name in SPDX_NAMES})
RULES = tuple((("SPDX", f"SPDX:{name}"), name) for name in SPDX_NAMES) + RULES

# Takes names without the identifier sentence before them out of a sequence.
LONE_NAMES = (("<SPDX><SPDX:", "<SPDX><spdx:"), ("<SPDX:[^>]*>", ""), ("<spdx:", "<SPDX:"))

# Every text with a known sentence that can fire a rule contains one of these words, so a text without any has no known sentence.
ANCHORS = ("licen", "permission", "redistribut", "provided", "free software", "merchantability", "mozilla.org")
END = "[.:!?]"
SPACE = "[\\x20\\x09-\\x0D]"


def normal_form(sentence: str) -> str:
    """Python twin of ``normalised`` for the dictionary's own sentences."""
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.+]+", " ", sentence.lower().replace("://", " ")))




def known_sentences() -> dict[str, str]:
    """normal form -> identifier; a sentence with an inner end mark is known by its longest piece."""
    out = {}
    for ident, parts in SENTENCES.items():
        for part in parts:
            pieces = [normal_form(x) for x in re.split(f"(?<={END})[ ]+", part)]
            out[max(pieces, key=len)] = f"<{ident}>"
    return out


KNOWN = known_sentences()
assert all(any(a in s for a in ANCHORS) for s, i in KNOWN.items() if not i.startswith("<SPDX:")), "a known sentence has no anchor"


# Marks of the reduced text: a line end or semicolon may end a sentence or be a blank inside one, HARD ends it.
SOFT, HARD = "\n", "\x02"
_WORDS = "|".join("[ \\n]+".join(re.escape(w) for w in s.split(" ")) for s in sorted(KNOWN, key=len, reverse=True))
_GRANTS = "permission |redistribution |licensed "
# A copyright line on the line of the grant: "MIT License Copyright (c) 2020 X Permission is hereby granted ..."
_COPYRIGHT = f"(?:(?:the )?[a-z]+ license )?copyright (?:c )?[0-9]{{4}}[^\\n\\x02]{{0,200}}? (?={_GRANTS})"
_END = "[ .]*(?:[\\n\\x02]|$)"
SENTENCE = f"(?:(?:^|[\\n\\x02])[ .]*(?:{_COPYRIGHT})?|\\G )({_WORDS})(?={_END}| (?:{_WORDS})(?:[ \\n\\x02]|[.]*$|[.]+[ \\n\\x02]))"


def reduced(lowered: Column) -> Column:
    """Words of ASCII letters, digits, dots and pluses with blanks, ``SOFT`` and ``HARD`` marks between them."""
    marked = F.translate(lowered, "\r\x0b\x0c;" + HARD, SOFT * 4 + " ")
    return F.regexp_replace(F.regexp_replace(marked, f"{END}{SPACE}+", HARD), f"[^a-z0-9.+{SOFT}{HARD}]+", " ")


def sentence_ids(lowered: Column) -> Column:
    """Identifiers of the known sentences of a lower-cased text, in order, as ``<A><B>``.

    A sentence starts behind and stops at a line end, semicolon, end mark or another known sentence,
    and may itself run over line ends, blank lines and semicolons.
    """
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    found = F.regexp_extract_all(reduced(lowered), F.lit(SENTENCE), F.lit(1))
    ids = F.array_join(F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[ \n]+", " "))), "")
    for pattern, instead in LONE_NAMES:
        ids = F.regexp_replace(ids, pattern, instead)
    return ids


def apply_rules(sequence: Column) -> Column:
    """struct(rest, found): rules taken in order, each removing what it matched."""
    rules = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    start = F.struct(sequence.alias("rest"), F.lit("").alias("found"))

    def take(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        name = F.concat(F.lit(","), rule["name"], F.lit(","))
        fresh = F.when(F.contains(acc["found"], name), acc["found"]).otherwise(F.concat(acc["found"], name))
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"),
                        F.when(hit, fresh).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rules, start, take)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_known, sentence_ids, licenses, unmatched).

    Known sentences are found on a line of their own and wrapped over lines alike, in text order.
    ``licenses`` lists the licences in rule order, comma-joined; ``unmatched`` the identifiers no
    rule took.
    Defined cases: NULL or empty text gives 0 and empty strings; repeated rows give repeated
    rows; keys may be NULL; other columns are ignored.
    """
    low = F.lower(F.coalesce(named(text).cast("string"), F.lit("")))
    has_anchor = F.lit(False)
    for a in ANCHORS:
        has_anchor = has_anchor | F.contains(F.col("_low"), F.lit(a))

    def count(seq: Column) -> Column:
        return F.length(seq) - F.length(F.replace(seq, F.lit("<"), F.lit("")))

    # flat stages: the sequence is computed only for texts with an anchor word, and once
    found = docs.select(named(key).alias("_key"), low.alias("_low")).select(
        "_key", F.when(has_anchor, sentence_ids(F.col("_low"))).otherwise(F.lit("")).alias("_ids"))
    ruled = found.select("_key", let(F.col("_ids"), lambda s: F.struct(
        s.alias("ids"), F.when(s == "", F.struct(F.lit("").alias("rest"), F.lit("").alias("found"))).otherwise(
            apply_rules(s)).alias("r"))).alias("_x"))
    return ruled.select(
        F.col("_key").alias(key), count(F.col("_x.ids")).cast("int").alias("n_known"), F.col("_x.ids").alias("sentence_ids"),
        F.btrim(F.replace(F.col("_x.r.found"), F.lit(",,"), F.lit(",")), F.lit(",")).alias("licenses"),
        F.replace(F.col("_x.r.rest"), F.lit("|"), F.lit("")).alias("unmatched"))
