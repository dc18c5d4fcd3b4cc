"""License scans by sentence rules.

A text is cut into parts at sentence ends, these are normalised and looked up
among the parts of known licence sentences; a sentence is recognised where all
of its parts follow each other. The sequence of sentences is matched against
ordered rules: an earlier, more specific rule uses up its sentences before a
later one sees them. A text is cut twice, by its lines and with line ends inside
sentences taken for blanks, and what either cut finds counts. All of it happens
within a row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import P, table

# Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "MITgrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MITcond": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITwarr": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MITliab": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MITref": "Released under the MIT License.",
    "Ap2grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Ap2comply": "you may not use this file except in compliance with the License.",
    "Ap2copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Ap2asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Ap2see": "See the License for the specific language governing permissions and limitations under the License.",
    "Ap2ref": "Licensed under the Apache License, Version 2.0.",
    "BSDgrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDsrc": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDbin": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDend": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDwarr": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSDliab": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSDadv": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "BSD2ref": "Released under the BSD 2-Clause License.",
    "BSD3ref": "Released under the BSD 3-Clause License.",
    "GPLwork3": "This work is licensed under the GNU General Public License, version 3.",
    "GPLwork2": "This work is licensed under the GNU General Public License, version 2.",
    "GPLlater3": "This work is licensed under the GNU General Public License, version 3 or later.",
    "GPLlater2": "This work is licensed under the GNU General Public License, version 2 or later.",
    "LGPL21ref": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPLref": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPLfree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL3semi": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "GPL2only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "GPL2under": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL3only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "LGPL21free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL3free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPLsee": "See the GNU Lesser General Public License for more details.",
    "AGPL3free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPLsee": "See the GNU Affero General Public License for more details.",
    "GPLwarr": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GPLimpl": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPLsee": "See the GNU General Public License for more details.",
    "GPLrecv": "You should have received a copy of the GNU General Public License along with this program.",
    "LGPLref": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL2form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL2ref": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL11form": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "MPL11code": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "MPL2copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL2copys": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL2made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "EPL1made": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "CDDLuse": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "Zlibasis": "This software is provided 'as-is', without any express or implied warranty.",
    "Zlibliab": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlibgrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Zliborig": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "Zlibalter": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Zlibnotice": "This notice may not be removed or altered from any source distribution.",
    "BSLgrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BSLref": "Distributed under the Boost Software License, Version 1.0.",
    "WTFPLterms": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "WTFPLdo": "You just DO WHAT THE FUCK YOU WANT TO.",
    "ISCwarr": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0BSDgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "X11name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "NCSAgrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Ap2def": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "Ap2body": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "GPL3body": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "GPL2body": "The licenses for most software are designed to take away your freedom to share and change it.",
    "AGPL3body": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "LGPL3body": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "GPL2contrast": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "GPL3take": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "GPL3contrast": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "AGPL3contrast": "By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "LGPL3herein": "As used herein, \"this License\" refers to version 3 of the GNU Lesser General Public License, and the \"GNU GPL\" refers to version 3 of the GNU General Public License.",
    "CC0body": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "CCBYwork": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CCBYSAwork": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CCBYNCwork": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CCBYNDwork": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "PDany": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISCgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CCBYref": "Licensed under CC BY 4.0.",
    "CCBYSAref": "Licensed under CC BY-SA 4.0.",
    "CCBYNCref": "Licensed under CC BY-NC 4.0.",
    "CC0ref": "Released under CC0 1.0.",
    "PDref": "This is free and unencumbered software released into the public domain.",
}
#: Ordered rules: identifiers that must follow each other, and the licence they make.
RULES = [
    (("MITgrant", "MITcond", "MITwarr", "MITliab", "X11name"), "X11"),
    (("MITgrant", "MITcond", "MITwarr", "MITliab"), "MIT"),
    (("MITgrant", "MITcond"), "MIT"),
    (("Ap2grant", "Ap2comply", "Ap2copy", "Ap2asis", "Ap2see"), "Apache-2.0"),
    (("Ap2grant", "Ap2comply"), "Apache-2.0"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDadv"), "BSD-4-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDend", "BSDwarr", "BSDliab"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDwarr", "BSDliab"), "BSD-2-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDend", "BSDwarr"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDend"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin", "BSDwarr"), "BSD-2-Clause"),
    (("BSDgrant", "BSDsrc", "BSDbin"), "BSD-2-Clause"),
    (("CDDLuse", "Ap2comply"), "CDDL-1.0"),
    (("MPL11form", "Ap2comply"), "MPL-1.1"),
    (("LGPL21free", "GPLwarr", "GPLimpl", "LGPLsee"), "LGPL-2.1-or-later"),
    (("LGPL3free", "GPLwarr", "GPLimpl", "LGPLsee"), "LGPL-3.0-or-later"),
    (("AGPL3free", "GPLwarr", "GPLimpl", "AGPLsee"), "AGPL-3.0-or-later"),
    (("GPL3semi", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-3.0-or-later"),
    (("GPL2only", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-2.0-only"),
    (("GPL2under", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-2.0-only"),
    (("GPL3only", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-3.0-only"),
    (("LGPL21free",), "LGPL-2.1-or-later"),
    (("LGPL3free",), "LGPL-3.0-or-later"),
    (("AGPL3free",), "AGPL-3.0-or-later"),
    (("GPL3semi",), "GPL-3.0-or-later"),
    (("GPL2only",), "GPL-2.0-only"),
    (("GPL2under",), "GPL-2.0-only"),
    (("GPL3only",), "GPL-3.0-only"),
    (("Zlibasis", "Zlibliab", "Zlibgrant", "Zliborig", "Zlibalter", "Zlibnotice"), "Zlib"),
    (("Zlibgrant",), "Zlib"),
    (("NCSAgrant",), "NCSA"),
    (("ISCgrant", "ISCwarr"), "ISC"),
    (("MPL2form", "MPL2copy"), "MPL-2.0"),
    (("MPL2form", "MPL2copys"), "MPL-2.0"),
    (("GPLfree", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-3.0-or-later"),
    (("GPLfree",), "GPL-3.0-or-later"),
    (("GPL2free", "GPLwarr", "GPLimpl", "GPLsee"), "GPL-2.0-or-later"),
    (("GPL2free",), "GPL-2.0-or-later"),
    (("ISCgrant",), "ISC"),
    (("MPL2form",), "MPL-2.0"),
    (("MITref",), "MIT"),
    (("Ap2ref",), "Apache-2.0"),
    (("BSD3ref",), "BSD-3-Clause"),
    (("GPLwork3",), "GPL-3.0-only"),
    (("LGPLref",), "LGPL-3.0-only"),
    (("MPL2ref",), "MPL-2.0"),
    (("CCBYref",), "CC-BY-4.0"),
    (("CCBYSAref",), "CC-BY-SA-4.0"),
    (("CCBYNCref",), "CC-BY-NC-4.0"),
    (("CC0ref",), "CC0-1.0"),
    (("PDref", "PDany"), "Unlicense"),
    (("PDref",), "Unlicense"),
    (("PDany",), "Unlicense"),
    (("MPL11form",), "MPL-1.1"),
    (("MPL11code",), "MPL-1.1"),
    (("EPL2made",), "EPL-2.0"),
    (("EPL1made",), "EPL-1.0"),
    (("CDDLuse",), "CDDL-1.0"),
    (("BSLgrant",), "BSL-1.0"),
    (("BSLref",), "BSL-1.0"),
    (("WTFPLterms", "WTFPLdo"), "WTFPL"),
    (("WTFPLdo",), "WTFPL"),
    (("0BSDgrant",), "0BSD"),
    (("BSD2ref",), "BSD-2-Clause"),
    (("Ap2def", "Ap2body"), "Apache-2.0"),
    (("Ap2body",), "Apache-2.0"),
    (("GPL3body", "GPL3take", "GPL3contrast"), "GPL-3.0-only"),
    (("AGPL3body", "GPL3take", "AGPL3contrast"), "AGPL-3.0-only"),
    (("GPL2body", "GPL2contrast"), "GPL-2.0-only"),
    (("LGPL3body", "LGPL3herein"), "LGPL-3.0-only"),
    (("GPLwork2",), "GPL-2.0-only"),
    (("GPLlater3",), "GPL-3.0-or-later"),
    (("GPLlater2",), "GPL-2.0-or-later"),
    (("LGPL21ref",), "LGPL-2.1-only"),
    (("AGPLref",), "AGPL-3.0-only"),
    (("CC0body",), "CC0-1.0"),
    (("CCBYwork",), "CC-BY-4.0"),
    (("CCBYSAwork",), "CC-BY-SA-4.0"),
    (("CCBYNCwork",), "CC-BY-NC-4.0"),
    (("CCBYNDwork",), "CC-BY-ND-4.0"),
]
#: Names that a reference may give a licence, normalised, by the sentence that a reference stands for.
NAMES = [
    ("mit license", "MITref"),
    ("apache( software)? license( version)? v?2 0", "Ap2ref"),
    ("(bsd 3 clause|3 clause bsd) license", "BSD3ref"),
    ("(bsd 2 clause|2 clause bsd) license", "BSD2ref"),
    ("mozilla public license( version| v)? v?2 0", "MPL2ref"),
    ("gnu (general public license|gpl)( version)? v?3( 0)?", "GPLwork3"),
    ("gnu (general public license|gpl)( version)? v?2( 0)?", "GPLwork2"),
    ("gnu (general public license|gpl)( version)? v?3( 0)? or( any)? later( version)?", "GPLlater3"),
    ("gnu (general public license|gpl)( version)? v?2( 0)? or( any)? later( version)?", "GPLlater2"),
    ("gnu lesser general public license( version)? v?3( 0)?", "LGPLref"),
    ("gnu lesser general public license( version)? v?2 1", "LGPL21ref"),
    ("gnu affero general public license( version)? v?3( 0)?", "AGPLref"),
]
#: How a reference begins: what is licensed, in a few words, may stand before.
UNDER = "([a-z0-9]+( [a-z0-9]+){0,5} (is|are) ((also|hereby|now) )?)?(available|distributed|licensed|made available|provided|published|released) under (the terms of )?(the )?"
#: Parts with a free place, normalised: the holder of a BSD licence, the work under a GNU licence or another, the form of its name. Each stands for the part that it names. A GNU licence with its version may also stand alone.
SLOTS = [
    (r"^neither the name of .+ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (r"^[a-z0-9]+( [a-z0-9]+){0,4} is free software$", "This program is free software;"),
    (r"^[a-z0-9]+( [a-z0-9]+){0,4} is distributed in the hope that it will be useful but without any warranty$", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    *[(f"^({UNDER}|(the )?){name}$" if name.startswith("gnu") else f"^{UNDER}{name}$", SENTENCES[reference]) for name, reference in NAMES],
]
_END, _NOISE = r"([.!?;:])\s+", "[^a-z0-9]+"
_ID = "[A-Za-z0-9][A-Za-z0-9.:+-]*"
COPYRIGHT, SPDX = r"^copyright( c)? [0-9]{4}", rf"SPDX-License-Identifier:\s*((?:\([ \t]*)*{_ID}(?:[ \t)]+(?:OR|AND|WITH)[ \t(]+{_ID})*)"
_NOTICE = "Copyright"


def normal_form(sentence: str) -> str:
    return re.sub(_NOISE, " ", sentence.lower()).strip()


def parts_of(sentence: str) -> list[str]:
    """The normalised parts that a scan cuts a sentence into."""
    return [p for p in map(normal_form, re.sub(_END, "\\1\n", sentence).split("\n")) if p]


def part_numbers(sentences: dict[str, str]) -> dict[str, str]:
    """Number of each part, as text; sentences may share parts. Parts for which a slot exists bear the slot's number."""
    out: dict[str, str] = {}
    for text in [*[t for _, t in SLOTS], *sentences.values()]:
        for part in parts_of(text):
            slot = next((parts_of(t)[0] for pattern, t in SLOTS if re.search(pattern, part)), part)
            out.setdefault(slot, str(len(out)))
            out[part] = out[slot]
    return out


def sequences(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """Each sentence's numbers, as text, and its identifier; longer ones first, since they may hold shorter ones. Two sentences of the same parts are an error."""
    number, out = part_numbers(sentences), {}
    for name, text in sentences.items():
        seq = "".join(f" {number[p]} " for p in parts_of(text))
        if seq in out:
            raise ValueError(f"{name} and {out[seq]} are known by the same words")
        out[seq] = name
    return sorted(out.items(), key=lambda x: (-x[0].count("  "), x[1]))


def sign(sentences: dict[str, str]) -> list[str]:
    """Words of which every sentence holds one, or a copyright line, tag or reference: few of them, by taking the word that most of the remaining sentences hold. Long words come first, as short ones stand in every text."""
    left, words = [set(normal_form(t).split()) for t in sentences.values()], ["copyright", "spdx", "license", "gnu"]
    left = [s for s in left if not s & set(words)]
    while left:
        count = next(c for n in (8, 6, 1) if (c := Counter(w for s in left for w in s if len(w) >= n)))
        best = min(count, key=lambda w: (-count[w], -len(w), w))
        words.append(best)
        left = [s for s in left if best not in s]
    return words


def _numbers(pieces: Column, number: dict[str, str]) -> Column:
    """Text of the numbers of the known parts, in order."""
    names = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    clean = F.transform(pieces, lambda s: F.trim(F.regexp_replace(F.lower(s), _NOISE, " ")))
    slots = [(pattern, number[parts_of(t)[0]]) for pattern, t in SLOTS]
    one = lambda s: F.coalesce(F.try_element_at(names, s), F.when(s.rlike(COPYRIGHT), F.lit(_NOTICE)), *[F.when(s.rlike(p), F.lit(n)) for p, n in slots])
    return F.array_join(F.transform(clean, lambda s: F.concat(F.lit(" "), one(s), F.lit(" "))), "")  # unknown parts are null and passed over


def _replaced(text: Column, plan: list[tuple[str, str]]) -> Column:
    """``text`` with each sequence of the plan replaced, one after the other."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in plan])
    return F.aggregate(steps, text, lambda t, s: F.replace(t, s["a"], s["b"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[tuple[str, ...], str]] = RULES) -> DataFrame:
    """Licences of each document: ``doc_id, sentence_ids, licences, left_over, expressions``, one row per input row.

    ``sentence_ids`` are the recognised sentences: of the cut with wrapped lines
    in order, then those that only the cut by lines finds; an SPDX tag comes
    first. ``licences`` are those of the rules that match in either cut and of
    the tags, sorted, each once. ``left_over`` are sentences that no rule used
    (copyright lines do not count), sorted. A line without a full stop right
    before a wrapped sentence is taken for its beginning. An SPDX tag may hold an
    expression: its operands each count as a licence, one with its exception
    (``GPL-2.0-only WITH Linux-syscall-note``) as another than without;
    ``expressions`` are the tags' expressions as they stand, blanks run together
    and open brackets closed. Null, empty and plain texts have
    empty arrays; long texts are scanned whole. Repeated rows are scanned each;
    extra columns are ignored; an empty table gives no rows.
    """
    number, known = part_numbers(sentences), [(a, f" {name} ") for a, name in sequences(sentences)]
    text = F.col(P + "t")
    lines = F.regexp_replace(text, _END, "$1\n")
    # wrapped: line ends inside a sentence are blanks; blank lines and lines with a copyright end it
    apart = F.regexp_replace(text, r"(?im)^[ \t]*(copyright .*)$", "\n\n$1\n\n")
    joined = F.regexp_replace(F.regexp_replace(apart, r"\n\s*\n", "\u0001"), r"\s+", " ")
    wrapped = F.translate(F.regexp_replace(joined, _END, "$1\n"), "\u0001", "\n")
    hit, none = F.lit(False), F.array().cast("array<string>")
    for word in sign(sentences):
        hit = hit | F.contains(F.col(P + "l"), F.lit(word))
    tags = F.regexp_extract_all(text, F.lit(SPDX))
    simple = F.flatten(F.transform(tags, lambda e: F.split(F.trim(F.regexp_replace(e, r"[ \t()]+", " ")), " (?:OR|AND) ")))
    opened = lambda e, c: F.length(e) - F.length(F.replace(e, F.lit(c), F.lit("")))
    whole = F.transform(F.transform(tags, lambda e: F.regexp_replace(e, r"[ \t]+", " ")), lambda e: F.concat(e, F.repeat(F.lit(")"), F.greatest(F.lit(0), opened(e, "(") - opened(e, ")")))))
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(P + "t"), F.lower(F.col(text_col)).alias(P + "l")).select("doc_id", P + "t", F.coalesce(hit, F.lit(False)).alias(P + "h"))
    hit = F.col(P + "h")
    found = marked.select("doc_id", hit, *[F.when(hit, _numbers(F.split(c, "\n"), number)).alias(P + n) for n, c in (("a", lines), ("b", wrapped))], F.when(hit, simple).otherwise(none).alias(P + "s"), F.when(hit, whole).otherwise(none).alias(P + "e"))
    # numbers of parts that make no sentence are dropped
    ids = lambda c: F.regexp_replace(_replaced(F.col(c), known), r" [0-9]+ ", "")
    found = found.withColumns({P + n: F.when(F.col(P + n) != "", ids(P + n)).otherwise("") for n in "ab"})
    # rules mark what they use: "| licence" takes the sentences' place
    plan = [("".join(f" {i} " for i in seq), f" |{name} ") for seq, name in rules]
    found = found.withColumns({P + n: F.coalesce(P + n, F.lit("")) for n in "ab"}).withColumns({P + "r" + n: F.when(F.coalesce(P + n, F.lit("")) != "", _replaced(F.col(P + n), plan)).otherwise("") for n in "ab"})
    items = lambda c: F.filter(F.split(F.trim(F.col(c)), " +"), lambda i: i != "")
    used = F.array(*[F.struct(F.lit("|" + name).alias("name"), F.lit(i).alias("id")) for seq, name in rules for i in seq])
    marks = F.array_union(F.filter(items(P + "ra"), lambda i: i.startswith("|")), F.filter(items(P + "rb"), lambda i: i.startswith("|")))
    rest = F.filter(F.array_union(items(P + "rb"), items(P + "ra")), lambda i: ~i.startswith("|") & (i != _NOTICE))
    taken = F.transform(F.filter(used, lambda u: F.array_contains(P + "m", u["name"])), lambda u: u["id"])
    only = F.filter(items(P + "a"), lambda i: ~F.array_contains(items(P + "b"), i))
    done = found.withColumn(P + "m", F.when(hit, marks).otherwise(none))
    licences = F.array_distinct(F.concat(F.transform(P + "m", lambda i: F.substring(i, 2, 100)), F.col(P + "s")))
    tag = F.transform(P + "s", lambda i: F.concat(F.lit("SPDX:"), F.replace(i, F.lit(" "), F.lit("_"))))
    lists = {"sentence_ids": F.concat(tag, items(P + "b"), only), "licences": F.array_sort(licences), "left_over": F.array_sort(F.array_except(rest, taken)), "expressions": F.col(P + "e")}
    return done.select("doc_id", *[F.when(hit, v).otherwise(none).alias(k) for k, v in lists.items()])


def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with its lists as text, parted by blanks."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("sentence_ids", "licences", "left_over")], F.array_join("expressions", "; ").alias("expressions"))


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[tuple[str, ...], str]] = RULES) -> str:
    """The scan in SQL: parts as rows, sentences and rules applied one after another."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    number = part_numbers(sentences)
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in number.items())
    slots = "".join(f" WHEN regexp_matches(n, {quote(p)}) THEN {quote(number[parts_of(t)[0]])}" for p, t in SLOTS)
    cut = lambda t: f"regexp_replace({t}, '([.!?;:])\\s+', '\\1' || chr(10), 'g')"
    apart = r"regexp_replace(t, '(?im)^[ \t]*(copyright .*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"
    joined = rf"regexp_replace(regexp_replace({apart}, '\n\s*\n', chr(1), 'g'), '\s+', ' ', 'g')"
    ways = [("a", f"string_split({cut('t')}, chr(10))"), ("b", f"string_split(replace({cut(joined)}, chr(1), chr(10)), chr(10))")]
    pieces = " UNION ALL ".join(f"SELECT rid, '{way}' AS way, unnest({c}) AS s, generate_subscripts({c}, 1) AS k FROM hit" for way, c in ways)
    nest = lambda column, plan: "".join(["replace("] * len(plan)) + column + "".join(f", {quote(a)}, {quote(b)})" for a, b in plan)
    found = nest("parts", [(a, f" {name} ") for a, name in sequences(sentences)])
    ruled = nest("ids", [("".join(f" {i} " for i in seq), f" |{name} ") for seq, name in rules])
    used = ", ".join(f"({quote('|' + name)}, {quote(i)})" for seq, name in rules for i in seq)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), used(name, id) AS (VALUES {used}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hit AS (SELECT *, regexp_extract_all(t, {quote(SPDX)}, 1) AS tags FROM d WHERE {" OR ".join(f"contains(lower(t), {quote(w)})" for w in sign(sentences))}),
pieces AS ({pieces}),
named AS (SELECT rid, way, k, coalesce(id, CASE WHEN regexp_matches(n, {quote(COPYRIGHT)}) THEN '{_NOTICE}'{slots} END) AS id
  FROM (SELECT rid, way, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS n FROM pieces) p LEFT JOIN known ON sentence = n),
texts AS (SELECT rid, way, string_agg(' ' || id || ' ', '' ORDER BY k) AS parts FROM named WHERE id IS NOT NULL GROUP BY rid, way),
found AS (SELECT rid, way, regexp_replace({found}, ' [0-9]+ ', '', 'g') AS ids FROM texts),
ruled AS (SELECT rid, way, list_filter(string_split_regex(trim(ids), ' +'), lambda i: i <> '') AS ids, list_filter(string_split_regex(trim({ruled}), ' +'), lambda i: i <> '') AS rest FROM found),
both_cuts AS (SELECT h.rid, coalesce(b.ids, []) AS b, list_filter(coalesce(a.ids, []), lambda i: NOT list_contains(coalesce(b.ids, []), i)) AS only_a, list_concat(coalesce(b.rest, []), coalesce(a.rest, [])) AS rest,
  flatten(list_transform(tags, lambda e: string_split_regex(trim(regexp_replace(e, '[ \t()]+', ' ', 'g')), ' (?:OR|AND) '))) AS spdx,
  list_transform(list_transform(tags, lambda e: regexp_replace(e, '[ \t]+', ' ', 'g')), lambda e: e || repeat(')', greatest(0, length(replace(e, ')', '')) - length(replace(e, '(', ''))))) AS whole
  FROM hit h LEFT JOIN ruled a ON a.rid = h.rid AND a.way = 'a' LEFT JOIN ruled b ON b.rid = h.rid AND b.way = 'b'),
taken AS (SELECT c.rid, list(DISTINCT u.id) AS ids FROM both_cuts c JOIN used u ON list_contains(c.rest, u.name) GROUP BY c.rid)
SELECT doc_id, coalesce(array_to_string(list_concat(list_transform(spdx, lambda i: 'SPDX:' || replace(i, ' ', '_')), b, only_a), ' '), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(rest, lambda i: starts_with(i, '|')), lambda i: i[2:]), spdx))), ' '), '') AS licences,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(rest, lambda i: NOT starts_with(i, '|') AND i <> '{_NOTICE}' AND NOT list_contains(coalesce(taken.ids, []), i)))), ' '), '') AS left_over,
  coalesce(array_to_string(whole, '; '), '') AS expressions
FROM d LEFT JOIN both_cuts c ON c.rid = d.rid LEFT JOIN taken ON taken.rid = d.rid
"""
