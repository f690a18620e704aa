"""Licence scan by canonical digests, in DataFrame functions only.

A text is normalised - case, copyright lines, equivalent spellings,
punctuation and spaces - and the digest of all that is left is joined to the
digests of known licences. The same lookup is made for each line that could
be a notice. Texts without a word that every known licence has are not
normalised: they cannot match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules in order, for lower-cased text; the syntax is common to Java and RE2.
RULES = [
    (r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*$", " "),
    (r"all rights reserved", " "),
    (r"©|\(c\)", " copyright "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"organisation", "organization"),
    (r"authoris", "authoriz"),
    (r"recognis", "recogniz"),
    (r"behaviour", "behavior"),
    (r"favour", "favor"),
    (r"fulfill", "fulfil"),
    (r"acknowledgement", "acknowledgment"),
    (r"copyright (owner|holder)s?", "copyright holder"),
    (r"percent|per cent", "%"),
    (r"https:", "http:"),
    (r"&", " and "),
    (r"[^\p{L}\p{N}]+", " "),
]
#: What a line needs in the SQL form; ``mark`` is the operator's own.
MARK = r"(?i)licen[cs]e|permission|redistribution|public domain|gpl|cc by|cc-by"

_AS_IS = (
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Licence texts and notices, as their publishers word them.
KNOWN = [
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. " + _AS_IS),
    ("ISC", "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]


#: Digests of the canonical forms of complete licence texts, as their publishers word
#: them: with and without what follows the terms, with earlier postal addresses, and for
#: BSD with and without a title and the numbers of its conditions.
WHOLE = [
    ("GPL-1.0", "ddff318a2bb89a2add928e1fa78b3ff3bb137bde9ad38302f0a6395b1f408826"),
    ("GPL-1.0", "446a870fbe7a20405d807d04a8642f55ba2ff4183a84ca8236d78f7718c612c3"),
    ("GPL-1.0", "59967477eafa5c999df136ce4729e98a72b0bde54cf327c732f475447201a313"),
    ("GPL-2.0", "de000cbdd00802b20bbca101d81f58f7fbc97a3a3e8a5ca2fd6b466794ce4b9f"),
    ("GPL-2.0", "a93fe78d4730818406bfd92d5ca51c742bb44757809e9df2b528ee23601c6446"),
    ("GPL-2.0", "393d838a3fcdf4be802c0512341c9f00cc4c10adb56ebbf01687ff37049a19dd"),
    ("GPL-2.0", "7e698ddae82d84106b72e29c56b83f510722667f4e1fb9521919e0a17c9b5ac2"),
    ("GPL-2.0", "5c83b3e1ae8744ea671e194f6f8ddea98a52283a679eb74b4916754180ff4fa9"),
    ("GPL-2.0", "c57e18ec8531920e6296c0a677309664efc19b39b9b9b42f9d584e340e4bd7da"),
    ("GPL-3.0", "c994cc6b3258074857472d22dee3de2ece90605a8e252a4e2270f0fb23cb37c2"),
    ("GPL-3.0", "8d1c824fb967ff25f69046c3b6d6db4d913733c2e20b7e54ce3457a08516d58e"),
    ("GPL-3.0", "3a18b302e7749b11f7443105a7b59ab813365dc35f1378b3fe550503d8a201af"),
    ("AGPL-3.0", "04d64c843ab5d0d9ab9e667e2f50b828a58a44c95c889d9e55ee1ef9ecf2e9d5"),
    ("AGPL-3.0", "ebd59a1096a059928dc21be318f2ece2833ec10fe0ffe6bea7d4b66bcf5c3e05"),
    ("AGPL-3.0", "29afdae997408b4e5889776ed09fe8a8cf1eb888a675803dc6a1df93bf4b27ce"),
    ("LGPL-2.0", "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769"),
    ("LGPL-2.0", "24f90d254e58b80510e11141dd34919c3540d2724873a5956bd674033ae5a36b"),
    ("LGPL-2.0", "2d380dbc5ad94744c5d444af2bdcf1542b0848aa1587d6c7f3efb54e87ce54a5"),
    ("LGPL-2.0", "562706e595d1c136c236e8fece204741869037528772bb3a48b508266888bdc6"),
    ("LGPL-2.0", "7a769db9f0039f7f31b9a81eaa6d643528d0e9e1b80f3dafa54f18c5980e7e7c"),
    ("LGPL-2.0", "05b4f17910ce6a83c1521cda1cd2f89ba49b04aeead0837470adc8f4b10f1c02"),
    ("LGPL-2.1", "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66"),
    ("LGPL-2.1", "161c1b11462a7e927417540b0d51bf241c84e045a9aa72dd5bf5537c35d8d1c1"),
    ("LGPL-2.1", "e8fee7034b6432f7d6c16577b34654c02947180c540389d03e5e06c427f0f4f5"),
    ("LGPL-2.1", "4d6a213eefe7c0055f35ebd53d7d96bb50c9a91304835e3e921e203c310549b6"),
    ("LGPL-2.1", "a7e8298d9805964174af1b06b83ac8b32ab50535ce19e7271086e738b7e3f83f"),
    ("LGPL-2.1", "883c9e0a06612634d304f8f71e3e7594d22bf2b059de500e74a0b1648c5be200"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("Apache-2.0", "59ba63b4707ff9a3d207c389a7338434ed3b598f10941f3e5bf145856f554047"),
    ("Apache-2.0", "8bc0d137002c092bf603581806ae07fc5b9c1b875de7353fe6e8754e8d746692"),
    ("Apache-2.0", "876667ac6119a72e43cec8d8e7d5be7f82277b59d01c93bd886229e1b4f9c263"),
    ("Apache-2.0", "f00dee33212cdea5ea0ffd9920115427f7068782f663cfa8050a52b8386f509d"),
    ("MPL-2.0", "5ac9017944d192d85f8ab12e310c7d76fe29772648e2f163a218ab1936ef7c07"),
    ("MPL-2.0", "24c837e804d654565f985dd25175213f650ce247bb2362ec4d33bb4b4427c1aa"),
    ("MPL-1.1", "e175c812bf11316823c7edb41defcbb97d58124d1fc4129516484462506b4bf0"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("BSD-2-Clause", "7061202489ba206b35e1e020fd1633db8013b98790929b974f0e3296ddb2e148"),
    ("BSD-2-Clause", "8dd5ff60c442d75ea64b4315dba5f4f82a2c8d7690f5ba707ec272b02cc53227"),
    ("BSD-2-Clause", "08d0968df2e75188ce1a3dcc21910a243b3b023c7317e319878b91003ecf2ab5"),
    ("BSD-2-Clause", "b54d20eb5ac73ce4795582e59dec54f28807acc6f969d8599fb88156604239af"),
    ("BSD-2-Clause", "312ea33736a8c485e221afd61fb0daddefb5517d78cb2d80a94cb23bf274bf84"),
    ("BSD-2-Clause", "49fd205a8fbfe8ab8147401bc8cebae1ca8da76e864b795571c4072758c15b88"),
    ("BSD-2-Clause", "adc66a41c32009ea741a27ca9ddd9f8d85e96a6bd19c03260b0b71cceadf468e"),
    ("BSD-2-Clause", "a9c53bc2ef220998f404a6b5f67e3e4e1a960bcfb9df21dedfa460f4c45bbf18"),
    ("BSD-3-Clause", "70c3476dc8fb69f1a53c0a71f83781d002749805cfae63d17831d12b99460e5d"),
    ("BSD-3-Clause", "429b1bfa4e008beb942bfe838bbfd94e154ef4ea6bb23a8643ebd3cfd68e2fcc"),
    ("BSD-3-Clause", "96d1622876d511dd95d56bae14dc520796c725cf6fa27ebaa042979472a7e4a2"),
    ("BSD-3-Clause", "4e9a9bcf6572f601ae51e790787a48b5285c565547a73c9a5bd8ce87155c9dcc"),
    ("BSD-3-Clause", "8403a35ce9fc298cc5cfdf4409fcc23cdd773c206bcb9ed6e71a26a589c9eb7c"),
    ("BSD-3-Clause", "a9857077cb80439167b92c544f873efc646b1247b1f05825259ff4f7d9a6b28c"),
    ("BSD-3-Clause", "5a4203a0cab2e84e922f946c6ac4338d5cae9ef66167ea5e8a5e27c16e8608cb"),
    ("BSD-3-Clause", "b8861cfac1c8c2ab18f520d9a97dff9e9f8e8891b7b0cc373d9e8ae198487a28"),
]
#: Each complete text has one of these.
_WHOLE_MARK = r"licen[cs]e|redistribution"


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for pattern, to in RULES:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _word(text: str) -> str | None:
    """A pattern for a word of the text that stands in all spellings with its canonical form."""
    text = text.lower()
    for pattern, to in RULES:
        text = re.sub(pattern.replace(r"\p{L}\p{N}", r"\w"), to, text)
    words = [w for w in text.split() if re.fullmatch("[a-z0-9]+", w)]
    for w in ("license", "redistribution", "permission", "domain"):
        if any(w in x for x in words):
            return w.replace("license", "licen[cs]e")
    respelled = "license|noninfringement|organization|authoriz|recogniz|behavior|favor|fulfil|acknowledgment|copyright|holder|^and$"
    return max((w for w in words if not re.search(respelled, w)), key=len, default=None)


def mark(known=KNOWN) -> str:
    """A pattern that every text with a known digest has; it matches all where there is none."""
    words = {_word(t) for _, t in known}
    return "" if None in words else "(?iu)" + "|".join(sorted({_WHOLE_MARK, *words}))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license_id, digest of a list of known texts (a list of fixed length) and of the complete ones."""
    struct = lambda k, t, name: F.struct(F.lit(k).alias("license_id"), F.lit(t).alias(name))
    whole = spark.range(1).select(F.inline(F.array(*[struct(k, d, "digest") for k, d in WHOLE])))
    if known:
        rows = spark.range(1).select(F.inline(F.array(*[struct(k, t, "text") for k, t in known])))
        whole = rows.select("license_id", digest(F.col("text")).alias("digest")).unionByName(whole)
    return whole.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, license_id (of the entire text, or null), notice_ids (of entire
    lines: distinct, in order, comma-joined; empty if none) for each row.

    Null and empty texts have neither; repeated rows get equal results. Empty
    table: no rows.
    """
    licenses = F.broadcast(known_licenses(docs.sparkSession, known))
    marked = F.col("text").rlike(mark(known))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    whole = rows.select("doc_id", "key", F.when(marked, digest(F.col("text"))).alias("digest")).join(licenses, "digest", "left")
    lines = rows.where(marked).select("key", F.explode(F.split("text", r"[\r\n]+")).alias("text")).where(marked)
    notices = lines.select("key", digest(F.col("text")).alias("digest")).join(licenses, "digest").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notice_ids"))
    return whole.join(notices, "key", "left").select("doc_id", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(known=KNOWN) -> str:
    """The same scan as DuckDB SQL."""

    def sql(column: str) -> str:
        out = f"lower({column})"
        for pattern, to in RULES:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
        return f"sha256(trim({out}))"

    values = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known)
    return f"""
        WITH known AS (SELECT digest, min(license_id) AS license_id FROM (
                SELECT license_id, {sql("text")} AS digest FROM (VALUES {values}) AS k(license_id, text)) GROUP BY digest),
        whole AS (SELECT doc_id, {sql("text")} AS digest FROM documents),
        lines AS (SELECT doc_id, unnest(string_split_regex(text, '[\\r\\n]+')) AS line FROM documents),
        marked AS (SELECT doc_id, {sql("line")} AS digest FROM lines WHERE regexp_matches(line, {_quoted(MARK)})),
        notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM marked JOIN known USING (digest) GROUP BY doc_id)
        SELECT doc_id, license_id, coalesce(notice_ids, '') AS notice_ids
        FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)"""
