"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into pieces at sentence ends and line ends, each is normalised (lower case, runs of other
characters than a-z and 0-9 to one blank), and known licence sentences become identifiers. A known sentence
is a piece, or several in a row where only a single line end, ":" or ";" is in between: notices are wrapped.
The identifiers of a text, in order, are matched against ordered rules, longer ones first; what a rule matches
is taken out, so that a shorter rule cannot count a part of it again. Sentences in between that aren't known
do not part a sequence. n_sentences counts the pieces.

Defined cases: a null or empty text has no sentences and no licence; a rule that occurs again counts
once; equal texts give equal results; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2.named",
    "licensed under the apache license version 2 0 the license": "apache2.named",
    "you may not use this file except in compliance with the license": "apache2.comply",
    "you may obtain a copy of the license at": "apache2.obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2.asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2.limits",
    "released under the mit license": "mit.named",
    "licensed under the mit license": "mit.named",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied": "mit.asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "this work is licensed under the gnu general public license version 3": "gpl3.named",
    "licensed under the gnu general public license version 3": "gpl3.named",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl.grant",
    "either version 3 of the license or at your option any later version": "gpl3.later",
    "either version 2 of the license or at your option any later version": "gpl2.later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl.nowarranty",
    "licensed under cc by 4 0": "ccby4.named",
    "licensed under cc by sa 4 0": "ccbysa4.named",
    "licensed under cc by nc 4 0": "ccbync4.named",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.named",
    "this work is dedicated to the public domain": "cc0.named",
    "all rights reserved": "rights.reserved",
}
# Further sentences as the notices have them in full; several identifiers are joined by commas.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.asis",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2.obtain",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2.obtain",
    f"{_GPL} either version 3 of the license or at your option any later version": "gpl.grant,gpl3.later",
    f"{_GPL} either version 2 of the license or at your option any later version": "gpl.grant,gpl2.later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2.named",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "either version 2 1 of the license or at your option any later version": "lgpl21.later",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2.named",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl v20 html": "epl2.named",
}
for _work in ("program", "library"):
    for _name, _id in (("lesser", "lgpl"), ("affero", "agpl")):
        _grant = f"this {_work} is free software you can redistribute it and or modify it under the terms of the gnu {_name} general public license as published by the free software foundation"
        NOTICES[_grant] = f"{_id}.grant"
        for _version, _later in (("3", "gpl3.later"), ("2 1", "lgpl21.later")):
            NOTICES[f"{_grant} either version {_version} of the license or at your option any later version"] = f"{_id}.grant,{_later}"
# Licences that a line "SPDX-License-Identifier: ..." can name.
SPDX = (
    "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later"
    " LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()
NOTICES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): f"spdx.{x}" for x in SPDX}
#: A sentence with a slot: any holder's name of up to so many characters reads like the sentence's own words, also where "Inc." ends a piece.
SLOT_BEFORE, SLOT_OWN, SLOT_AFTER = "neither the name of", "the copyright holder", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
SLOT_CHARS = 80
#: (licence, identifiers in order); longer sequences come first.
RULES = [
    ("Apache-2.0", ["apache2.named", "apache2.comply", "apache2.obtain", "apache2.asis", "apache2.limits"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("MIT", ["mit.grant", "mit.notice", "mit.asis"]),
    ("GPL-3.0-or-later", ["gpl.grant", "gpl3.later", "gpl.nowarranty"]),
    ("GPL-2.0-or-later", ["gpl.grant", "gpl2.later", "gpl.nowarranty"]),
    ("LGPL-3.0-or-later", ["lgpl.grant", "gpl3.later"]),
    ("LGPL-2.1-or-later", ["lgpl.grant", "lgpl21.later"]),
    ("AGPL-3.0-or-later", ["agpl.grant", "gpl3.later"]),
    ("Apache-2.0", ["apache2.named"]),
    ("MIT", ["mit.named"]),
    ("GPL-3.0-only", ["gpl3.named"]),
    ("CC-BY-4.0", ["ccby4.named"]),
    ("CC-BY-SA-4.0", ["ccbysa4.named"]),
    ("CC-BY-NC-4.0", ["ccbync4.named"]),
    ("CC0-1.0", ["cc0.named"]),
    ("MPL-2.0", ["mpl2.named"]),
    ("ISC", ["isc.grant"]),
    ("EPL-2.0", ["epl2.named"]),
    ("Unlicense", ["unlicense.grant"]),
    *[(x, [f"spdx.{x}"]) for x in SPDX],
    ("Proprietary", ["rights.reserved"]),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"[.!?;:]+([ \t\r\n]|$)"


# An end that no known sentence runs across, and one of ":" or ";", with what is left of its line.
_HARD_END, _SOFT_END = r"[;:]*[.!?][.!?;:]*([ \t\r\n]|$)", r"[;:]+([ \t\r]*\n|[ \t\r]|$)"
_KNOWN = SENTENCES | NOTICES
_wrapped = lambda k: k.replace(" ", "[ \n]")
_SLOT = f"{_wrapped(SLOT_BEFORE)}[ \n][a-z0-9 \n|]{{1,{SLOT_CHARS}}}?[ \n|]{_wrapped(SLOT_AFTER)}"
# The mark before a piece is matched, the one after it is not; sentences that begin with the same word are tried together, the longest first.
_STARTS = sorted({k.split(" ")[0] for k in _KNOWN} - {SLOT_BEFORE.split(" ")[0]})
_RESTS = {w: "|".join(_wrapped(k[len(w) :]) for k in sorted(_KNOWN, key=lambda k: (-len(k), k)) if k.startswith(w + " ")) for w in _STARTS}
_SENTENCE = "[\n|](" + "|".join([*(f"{w}(?:{rest})" for w, rest in _RESTS.items()), _SLOT, _wrapped(f"{SLOT_BEFORE} {SLOT_OWN} {SLOT_AFTER}")]) + ")(?=[\n|])"


def pieces(text: Column) -> Column:
    """The normalised pieces in one string: before and after each "|", or a line end where a sentence may go on."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER + "|", _LOWER + "_")
    out = F.regexp_replace(F.regexp_replace(out, _HARD_END, "|"), _SOFT_END, "\n")
    out = F.regexp_replace(out, "[^a-z0-9\n|]+", " ")
    out = F.regexp_replace(out, " ?(?:\n ?\n|\n? ?[|])[ \n|]*", "|")
    return F.concat(F.lit("|"), F.trim(F.regexp_replace(out, " ?\n ?", "\n")), F.lit("|"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids (comma-joined, in order), licences (comma-joined, sorted)."""
    first, slotted = SLOT_BEFORE.split(" ")[0], f"{SLOT_BEFORE} {SLOT_OWN} {SLOT_AFTER}"  # no other sentence begins with this word
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces(F.col("text")).alias("p"))
    found = F.transform(F.regexp_extract_all("p", F.lit(_SENTENCE), F.lit(1)), lambda s: F.try_element_at(known, F.when(F.startswith(s, F.lit(first)), F.lit(slotted)).otherwise(F.translate(s, "\n", " "))))
    ids = F.flatten(F.transform(found, lambda x: F.split(x, ",")))
    out = out.withColumn("s", F.filter(F.split("p", "[\n|]"), lambda s: s != "")).withColumn("found", ids)
    out = out.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.col("found").alias("ids"))
    out = out.withColumn("left", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    found = []
    for k, (licence, rule) in enumerate(RULES):
        wanted = "".join(f"<{x}>" for x in rule)
        out = out.withColumn(f"r{k}", F.when(F.contains("left", F.lit(wanted)), F.lit(licence))).withColumn("left", F.replace("left", F.lit(wanted), F.lit("")))
        found.append(f"r{k}")
    licences = F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    return out.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), licences.alias("licences"))
