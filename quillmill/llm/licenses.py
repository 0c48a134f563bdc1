"""Licence scan: a canonical digest of each entire text, hash-joined to digests of known licences.

Canonical form: lower case, copyright lines out, every run of other than letters and digits one
gap, variant spellings replaced by one of them. Two texts that differ only in these share a digest.
Short licences are known by their texts, with and without their titles; long ones by the digests
of their published files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import slices

#: Spellings that count as the same word (variant, canonical), from the public SPDX matching guidelines.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("http", "https"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("wilfull", "willful"),
)
#: The same for two words, matched after the single ones.
EQUIVALENT_PAIRS = (
    ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("per cent", "percent"), ("sub license", "sublicense"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_NOTICE = _MIT[_MIT.index(", subject to") : -2]
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <http://unlicense.org/>"
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Public licence texts, with the titles they are published under, and one-line notices.
_TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)"), _MIT + _WARRANTY),
    ("MIT-0", ("MIT No Attribution",), _MIT.replace(_MIT_NOTICE, "") + _WARRANTY),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), _BSD_HEAD + "3. " + _BSD_NAMES + _BSD_TAIL),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), _ISC_GRANT + _ISC_TAIL),
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng license"), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE),
    ("FSFAP", (), "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
    ("Apache-2.0", (), "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", (), "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", (), "Released under the MIT License."),
    ("CC-BY-NC-4.0", (), "Licensed under CC BY-NC 4.0."),
)
KNOWN = tuple((name, f"{title}\n\n{text}" if title else text) for name, titles, text in _TEXTS for title in ("", *titles))

#: Digests of the canonical form of long published texts (a test rebuilds them from the files).
KNOWN_DIGESTS = (
    ("Apache-2.0", "4296db130995ac9eaeb9309637388b56"),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", "eb6b86c0fad89753a5a36c484fa0ada2"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "9cdb0c94cb45abb55c616e067859d4ad"),
    ("MPL-2.0", "db12a21e89062c14ac06f7d6aa8123d5"),
)

# a line that starts with a copyright sign or word counts only with a year, a sign, a place-holder or a reservation, since licence texts wrap into "copyright notice ..."
_COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright[^\n]*([0-9]{4}|\(c\)|©|<|\[)|\(c\)[^\n]*[0-9]{4}|©|all rights reserved)[^\n]*"
_GAP = r"[\W_]+"
_LINES, _GAPS = re.compile(_COPYRIGHT_LINE), re.compile(_GAP)
_SPELLING = dict(EQUIVALENT)


def canonical(text: str) -> str:
    """Lower case, copyright lines out, words apart by one blank, one spelling for each word."""
    words = _GAPS.sub(" ", _LINES.sub("\n", text.lower())).split()
    out = " ".join([_SPELLING.get(w, w) for w in words])
    for variant, word in EQUIVALENT_PAIRS:
        if variant in out:
            out = re.sub(rf"\b{variant}\b", word, out)
    return out


def digest(text: str) -> str:
    return hashlib.md5(canonical(text).encode("utf-8", "replace")).hexdigest()


def known_digests(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> dict[str, str]:
    """Licence by digest; one that two texts share keeps the first."""
    out: dict[str, str] = {}
    for name, key in (*((name, digest(text)) for name, text in known), *digests):
        out.setdefault(key, name)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1024):
        found = [None if t is None else digest(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "digest"])


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """``doc_id, digest, license_id`` for each row; license_id is null where the entire text isn't a known licence.

    A null text has a null digest; an empty one, or one of punctuation or copyright lines only, the digest
    of the empty string, which is no licence's. Very long texts are digested whole. Repeated rows each come back, an
    empty table gives no rows, and other columns are not looked at. The known table is a constant of this module (or
    the caller's tuples), so it is broadcast.
    """
    table = docs.sparkSession.createDataFrame(list(known_digests(known, digests).items()), "digest string, license_id string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests, "doc_id long, digest string")
    return texts.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license_id")


def _sql_canonical(text: str) -> str:
    """The same as passes over a text whose words have two blanks between them, so that each can be matched with its own."""
    out = f"regexp_replace(lower({text}), '{_COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"('  ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  ')"
    for variant, word in EQUIVALENT:
        out = f"replace({out}, ' {variant} ', ' {word} ')"
    out = f"regexp_replace({out}, ' +', '  ', 'g')"
    for variant, word in EQUIVALENT_PAIRS:
        out = f"replace({out}, ' {variant.replace(' ', '  ')} ', ' {word.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def licenses_sql(known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> str:
    values = ", ".join(f"({i}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for i, (a, b) in enumerate(known))
    more = ", ".join(f"({len(known) + i}, '{a}', '{b}')" for i, (a, b) in enumerate(digests))
    return f"""
WITH k AS (SELECT digest, arg_min(l, n) AS license_id FROM
  (SELECT n, l, md5({_sql_canonical("t")}) AS digest FROM (VALUES {values}) v(n, l, t) UNION ALL SELECT * FROM (VALUES {more}) w) GROUP BY 1),
d AS (SELECT doc_id, md5({_sql_canonical("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id FROM d LEFT JOIN k ON d.digest = k.digest
"""
