"""License scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, lines that are just a licence's title, equivalent
spellings, punctuation and white space), and the digest of that form is looked up by a hash join among digests of
known licences and notices. The whole text is looked up, and so is each of its lines and each paragraph of several
lines, since a notice often stands alone or is wrapped. The catalogue is a constant of this module (a few dozen rows), so it
is broadcast; the documents are read once and never shuffled before the matches are counted. It holds the texts of
KNOWN and, by digest, the long ones of LONG; other licences are not known to it.

Defined results: a null text is an empty one, an empty canonical form matches nothing, rows are returned as often
as they occur, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_of

# Equivalent spellings, from the public SPDX matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog",
    "centre": "center", "customised": "customized", "emphasise": "emphasize", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "non commercial": "noncommercial", "organisation": "organization", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Licence texts and notices, as their owners publish them.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

# Name, length and md5 of the canonical form of long licences, from the texts that their owners publish.
LONG = (
    ("Apache-2.0", 9921, "b200db14d43f341836ccc14296f66944"),
    ("Artistic-1.0-Perl", 5833, "01297679267ad921516667ccd889865e"),
    ("CC0-1.0", 6692, "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", 19584, "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", 22020, "eb6b86c0fad89753a5a36c484fa0ada2"),
    ("GPL-1.0", 11765, "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", 17117, "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-3.0", 33409, "5eaa767cc0a56c87c3852144458a3bf1"),
    ("LGPL-2.0", 24130, "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.1", 25217, "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-3.0", 7104, "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", 22448, "252dfbcf46f9012c7c356a9252f1c30c"),
    ("MPL-2.0", 14341, "b5b7a0cf4994910cd0204fba4637d6ec"),
)

#: Canonical lines that only name a licence, or reserve all rights.
TITLE = r"^(the )?((mit|isc|0bsd|zlib|zlib libpng|((2|3|new|modified|simplified|revised) )?(clause )?bsd( (2|3) clause( (new|simplified)( or (revised|simplified))?)?)?|boost software|unlicense) ?(license)?( mit| isc| isc license)?( version [0-9 ]+)?( august 17th 2003)?|all rights reserved)$"
COPYRIGHT = r"(copyright|\(c\)|©)"
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright[^\na-z0-9]*(\(c\)|©)|(copyright|\(c\)|©)[^\n]*([0-9]{4}|all rights reserved))[^\n]*"
VARIANTS = r"(^|[ \n])(" + "|".join(SPELLINGS) + r")([ \n]|$)"


def canonical(docs: DataFrame, text: Column) -> DataFrame:
    """docs with the canonical lines of a text that are not empty (_lines) and its paragraphs of several lines (_blocks): lower case,
    no copyright lines, letters and digits only, one spelling of each word, no titles among the lines."""
    low, plain = F.col("_low"), F.col("_plain")
    spelled = F.concat(F.lit("\n"), F.regexp_replace(plain, " ?\n ?", " \n "), F.lit("\n"))
    for variant, spelling in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, f"(?<=[ \n]){variant}(?=[ \n])", spelling)
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))
    blocks = F.filter(F.split(plain, "\n[ \n]*\n", -1), lambda x: x.rlike("[a-z0-9] *\n *[a-z0-9]"))
    return (
        docs.withColumn("_low", F.lower(text))
        # both repairs are rare, so that most texts pass each pattern once
        .withColumn("_low", F.when(low.rlike(COPYRIGHT), F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low))
        .withColumn("_plain", F.regexp_replace(low, "[^a-z0-9\n]+", " "))
        .withColumn("_plain", F.when(plain.rlike(VARIANTS), spelled).otherwise(plain))
        .withColumn("_lines", F.filter(lines, lambda x: (x != "") & ~x.rlike(TITLE)))
        .withColumn("_blocks", F.transform(blocks, lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))))
        .drop("_low", "_plain")
    )


def whole(lines: Column) -> Column:
    """The canonical form of a whole text."""
    return F.array_join(lines, " ")


def catalogue(spark) -> DataFrame:
    """digest, license and length of known canonical forms; of equal ones the first name counts."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(KNOWN)], "place int, license string, text string")
    form = whole(F.col("_lines"))
    short = canonical(rows, F.col("text")).select(F.md5(form.cast("binary")).alias("digest"), "license", F.length(form).alias("length"), "place")
    long = spark.createDataFrame([(d, n, c, len(KNOWN) + i) for i, (n, c, d) in enumerate(LONG)], short.schema)
    return short.union(long).groupBy("digest").agg(F.min_by("license", "place").alias("license"), F.max("length").alias("length"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the whole text, text_license (of the whole text, or null), notice_lines (lines, and paragraphs of
    several lines, that are a known licence or notice) and licenses (all found, sorted, joined by commas)."""
    known = catalogue(docs.sparkSession)
    lengths = sorted({r["length"] for r in known.select("length").collect()})  # of a constant table
    known = F.broadcast(known.select(F.col("digest").alias("_known"), "license"))
    digest = lambda c: F.md5(c.cast("binary"))
    rows = canonical(docs.select("doc_id", text_of().alias("_text")), F.col("_text"))
    units = F.filter(F.concat("_lines", "_blocks"), lambda x: F.length(x).isin(lengths))
    rows = rows.select("doc_id", digest(whole(F.col("_lines"))).alias("digest"), F.transform(units, digest).alias("_units"))
    units = rows.select("doc_id", "digest", F.posexplode(F.concat(F.array("digest"), "_units")).alias("_place", "_digest"))
    found = units.join(known, units["_digest"] == known["_known"], "left")
    # equal rows meet in one group, and leave it as often as they came
    return (
        found.groupBy("doc_id", "digest")
        .agg(
            F.max(F.when(F.col("_place") == 0, F.col("license"))).alias("text_license"),
            F.count_if((F.col("_place") > 0) & F.col("license").isNotNull()).alias("_notices"),
            F.count_if(F.col("_place") == 0).alias("_copies"),
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select("doc_id", "digest", "text_license", F.expr("_notices div _copies").alias("notice_lines"), "licenses")
    )
