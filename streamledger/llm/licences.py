"""Licence scans by sentence rules, in DataFrame functions only (operator 1).

Texts are lower-cased and cut into sentences at full stops, exclamation and
question marks followed by white space and at blank lines; a sentence that is not known is cut into
its lines as well, since notices often stand without a full stop. Normalised (letters, digits, dots and plus signs; all else is
one space), sentences map to identifiers of known licence sentences. The sequence
of a text's identifiers is then matched against licence rules in their order,
longer ones first; a match is taken out of the sequence, so its sentences do not
count again. What is left over are sentences without a rule.

The tables of sentences and rules are constants of this module, so nothing that
grows with the data is broadcast. Null and empty texts have no sentences. Rows
that repeat are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import table

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "asf-contributor": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "asf-you": 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software',
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-program": "This program is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-licensed": "Licensed under the BSD License",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this program",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program",
    "epl2-program": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-obtain-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights": "All rights reserved",
}
#: Short licence identifiers that a tag line can name.
TAGS = ["Apache-2.0", "MIT", "ISC", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "BSL-1.0", "Zlib", "Artistic-2.0", "0BSD", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0"]
#: Rules in their order: a licence, and the sentences that name it in a row.
RULES = [
    ("Apache-2.0", ["asf-contributor", "asf-notice", "asf-you", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-you", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-you", "apache-copy-s", "apache-as-is", "apache-see"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see", "agpl-received"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see", "lgpl-received"]),
    ("MIT", ["mit-title", "mit-grant", "mit-as-is", "mit-liability"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see", "gpl-received"]),
    ("MIT", ["mit-grant", "mit-as-is", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    ("Zlib", ["zlib-as-is", "zlib-event", "zlib-grant"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("BSD", ["all-rights", "bsd-style"]),
    ("ISC", ["isc-grant", "mit-as-is"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain-s"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-you"]),
    ("Apache-2.0", ["asf-you"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-program"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("BSD", ["bsd-licensed"]),
    ("BSD", ["bsd-style"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-work"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-work"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("EPL-2.0", ["epl2-program"]),
    ("BSL-1.0", ["boost-distributed"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("CC0-1.0", ["cc0-waived"]),
    *((tag, [f"spdx-{tag.lower()}"]) for tag in TAGS),
]
#: What separates sentences: an end mark that white space or the end of the text follows, or a blank line.
END = r"[.!?]+(\s|$)|\n\s*\n"


def normalised(sentence: str) -> str:
    """As the column form does: lower case, runs of other characters than letters, digits, dots and plus signs become a space."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c in ".+") else " " for c in sentence.lower())
    return " ".join(kept.split())


KNOWN = {normalised(f"SPDX-License-Identifier: {t}"): f"spdx-{t.lower()}" for t in TAGS} | {normalised(s): k for k, s in SENTENCES.items()}


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    ids = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    key = lambda s: F.rtrim(F.ltrim(F.regexp_replace(s, "[^a-z0-9.+]+", " ")))
    known = lambda s: F.when(key(s).isin(list(KNOWN)), ids[key(s)])
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: known(F.regexp_replace(x, "[.!?]+$", ""))), lambda x: x.isNotNull())
    each = lambda s: F.when(known(s).isNotNull(), F.array(known(s))).when(F.contains(s, F.lit("\n")), lines(s)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.split(F.lower(text), END), each))


def apply_rules(ids: Column) -> Column:
    """Identifiers <a><b>... with what rules match, in their order, replaced by {licence}."""
    seq = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    for licence, wanted in RULES:
        seq = F.replace(seq, F.lit("".join(f"<{x}>" for x in wanted)), F.lit("{" + licence + "}"))
    return seq


def scan_licences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, sentences (identifiers in order), licences (in order, once each) and unmatched (identifiers that no rule took)."""
    rows = documents.select(F.col(id_col).alias("id"), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("sentences"))
    rows = rows.withColumn("seq", F.when(F.size("sentences") > 0, apply_rules(F.col("sentences"))).otherwise(""))
    return rows.select(F.col("id").alias(id_col), "sentences", F.array_distinct(F.regexp_extract_all("seq", F.lit(r"\{([^}]*)\}"), 1)).alias("licences"), F.regexp_extract_all("seq", F.lit("<([^>]*)>"), 1).alias("unmatched"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), F.array_join("unmatched", ",").alias("unmatched"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ids = f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in KNOWN.items())}}}"
    seq = "list_aggregate(list_transform(ids, lambda i: '<' || i || '>'), 'string_agg', '')"
    for licence, wanted in RULES:
        seq = f"replace({seq}, {quoted(''.join(f'<{x}>' for x in wanted))}, {quoted('{' + licence + '}')})"
    key = "trim(regexp_replace({}, '[^a-z0-9.+]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT {ids} AS m),
cut AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS s FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?]+(?:\\s|$)|\\n\\s*\\n') AS s FROM documents)),
whole AS (SELECT doc_id, k, s, m[{key.format('s')}] AS id FROM cut, known),
named AS (SELECT doc_id, k, 0 AS j, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, k, j, m[{key.format("regexp_replace(l, '[.!?]+$', '')")}] AS id
  FROM (SELECT doc_id, k, generate_subscripts(l, 1) AS j, unnest(l) AS l FROM (SELECT doc_id, k, string_split(s, chr(10)) AS l FROM whole WHERE id IS NULL AND contains(s, chr(10)))), known),
seqs AS (SELECT doc_id, list(id ORDER BY k, j) AS ids FROM named WHERE id IS NOT NULL GROUP BY doc_id),
ruled AS (SELECT doc_id, ids, {seq} AS seq FROM seqs)
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') AS licences,
  coalesce(array_to_string(regexp_extract_all(seq, '<([^>]*)>', 1), ','), '') AS unmatched
FROM documents d LEFT JOIN (SELECT *, regexp_extract_all(seq, '\\{{([^}}]*)\\}}', 1) AS l FROM ruled) USING (doc_id)
"""


SQL = _sql()
