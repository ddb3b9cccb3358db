"""Licence scans: canonical digest lookup of entire texts, in DataFrame operations only.

A text's canonical form drops copyright lines, lower-cases, maps equivalent spellings and turns runs of anything but letters and digits into one
space; its SHA-256 is hash-joined to the digests of known licences. The same digest of single lines finds licence notices inside other texts.
The known table is fixed (`KNOWN` and `NOTICES`, a few dozen rows), so broadcasting it is bounded whatever the corpus.

Defined cases: null and empty texts have the digest of the empty string and no licence; equal rows give equal rows; an empty table gives an empty table; other
columns may have any name (they are not read).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key

# Spellings that count as equal (after lower-casing), and the lines that don't count.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"), ("favour", "favor"), ("https:", "http:"))
COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright\s+(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©|all rights reserved)[^\n]*$"
NOT_TEXT = r"[^\p{L}\p{N}]+"

_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
# Public licence texts without their titles and copyright lines.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _REDISTRIBUTION + _WARRANTY_BSD,
    "BSD-3-Clause": _REDISTRIBUTION
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _WARRANTY_BSD,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org>",
}
# Titles that the texts are published under; compared in canonical form.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: List markers of the known texts, and what stands in their place: bullets and dashes are no text, letters are.
MARKER = r"\b([123])\. (?=Redistributions|Neither|The origin|Altered|This notice)"
MARKERS = (r"\1. ", "* ", lambda m: "abc"[int(m[1]) - 1] + ". ")
#: Digests of whole texts as published: entire, and without what follows the terms (Apache-2.0: also with its copyright line filled in).
DIGESTS = {
    "Apache-2.0": ("1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GPL-2.0": ("0248b317bc123a7424b6ff9799b9786ffde75241881994270612a604d03836cc", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",),
    "GPL-3.0": ("335e2e9a39badb7f3faa5b6e393ff8b393f868383be9ddbf866c5821b34f4810", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}
# One-line notices.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This work is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; equal for texts of one licence."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, NOT_TEXT, " "))


def canonical_python(text: str | None) -> str:
    """The same in Python, for the known texts."""
    out = re.sub(COPYRIGHT_LINE, " ", (text or "").lower())
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return re.sub(r"[\W_]+", " ", out).strip(" ")


def digest_rows(known: dict[str, str] = KNOWN, notices: dict[str, tuple[str, ...]] = NOTICES, digests: dict[str, tuple[str, ...]] = DIGESTS) -> list[tuple[str, str, bool]]:
    """(digest, licence, whether of a whole text)."""
    sha = lambda t: hashlib.sha256(canonical_python(t).encode()).hexdigest()
    whole = {(sha(f"{title}\n\n{re.sub(MARKER, mark, t)}"), k, True) for k, t in known.items() for title in ("", *TITLES.get(k, ())) for mark in MARKERS}
    whole |= {(d, k, True) for k, ds in digests.items() for d in ds}
    return sorted(whole) + sorted({(sha(t), k, False) for k, ts in notices.items() for t in ts})


def known_digests(spark: SparkSession, rows: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """(digest, licence, whole) as a table of literals."""
    held = [F.struct(F.lit(d).alias("digest"), F.lit(k).alias("licence"), F.lit(w).alias("whole")) for d, k, w in (digest_rows() if rows is None else rows)]
    return spark.range(1).select(F.inline(F.array(*held)))


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notices) of every row: the entire text's licence or null, and the sorted licences of its notices, comma-joined."""
    known = known if known is not None else known_digests(docs.sparkSession)
    n = known.count()
    small = F.broadcast if n <= 10_000 else (lambda x: x)
    whole = known.where("whole").groupBy("digest").agg(F.min("licence").alias("license_id"))
    lines = known.where("NOT whole").groupBy("digest").agg(F.min("licence").alias("__l")).withColumnRenamed("digest", "__d")
    read = docs.select("doc_id", F.col("text").alias("__t"), *row_key(F.col("doc_id"), F.col("text")))
    # Only lines that name a licence are exploded; each row's notices come back under its own two hashes, so neither side needs the other's digests.
    lined = read.select("__k1", "__k2", F.filter(F.split(F.coalesce("__t", F.lit("")), "\n"), lambda x: x.rlike("(?i)licen[sc]e")).alias("__x"))
    lined = lined.select("__k1", "__k2", F.explode_outer("__x").alias("__y")).where("__y IS NOT NULL").select("__k1", "__k2", F.sha2(canonical(F.col("__y")), 256).alias("__d"))
    hit = lined.join(small(lines), "__d").groupBy("__k1", "__k2").agg(F.array_join(F.array_sort(F.collect_set("__l")), ",").alias("notices"))
    found = read.select("doc_id", "__k1", "__k2", F.sha2(canonical(F.col("__t")), 256).alias("digest"))
    found = found.join(hit, ["__k1", "__k2"], "left").withColumn("notices", F.coalesce("notices", F.lit("")))
    return found.join(small(whole), "digest", "left").select("doc_id", "digest", "license_id", "notices")
