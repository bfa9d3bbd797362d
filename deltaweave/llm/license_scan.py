"""License scans: sparse TF-IDF cosine of license texts to templates, then inheritance by path.

Three kinds of units of a text are compared with the templates, which hold short statements, titles,
headers and the texts of licenses or their opening: the whole text of a license file, each block (lines
without an empty line between them, as a header comment is one), and each line; blocks and lines only
if they have one of the marker words. Units and templates are bags of words weighted by term frequency
times inverse document frequency over the templates (a word that no template has counts as in none), and
a unit takes the template of highest cosine if that reaches ``THRESHOLD``. A file's own license is that
of its widest unit that has one (whole text before block before line; reserved rights count only where no
license is found), and among these of the best score. Files without one inherit from the license file in
their nearest ancestor directory: ancestors are listed for distinct directories, not for files, and
joined by path.

Only the fixed templates are broadcast. Dot products and norms are aggregates over (file, unit).

Edge cases: null texts have no units; null paths lie in the root; of units of one kind and score the
least template name wins, of license files in one directory the best score, then the least path;
repeated rows give repeated results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.literals import table

THRESHOLD = 0.75
DIGITS = 6

# Short forms in which licenses are stated, and texts of licenses, headers and openings.
STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the 2-clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
)
PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
FREE_SOFTWARE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
FREE_OPENING = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
COPYING = "GNU {0}GENERAL PUBLIC LICENSE {1} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble"
TEXTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {REDISTRIBUTION} {DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {REDISTRIBUTION} {ENDORSE} {DISCLAIMER}"),
    ("BSD-3-Clause", ENDORSE),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", f"MIT License Copyright (c) {PERMISSION} {NOTICE} {AS_IS}"),
    ("MIT", PERMISSION),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
GNU = (("AGPL-3.0", "Affero ", "3", "Version 3, 19 November 2007"), ("GPL-2.0", "", "2", "Version 2, June 1991"), ("GPL-3.0", "", "3", "Version 3, 29 June 2007"), ("LGPL-2.1", "Lesser ", "2.1", "Version 2.1, February 1999"), ("LGPL-3.0", "Lesser ", "3", "Version 3, 29 June 2007"))
MARKERS = r"(?i)licen[cs]e|copyright|spdx|permission|all rights reserved"
WORD = r"([a-z0-9]+)"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
EMPTY_LINE = r"\n[ \t\r]*\n"
RESERVED = "Proprietary"


def _templates() -> tuple[tuple[str, str], ...]:
    """The fixed texts, the GNU licenses' headers and openings, and an SPDX line for each license."""
    gnu = [(name, form.format(kind, title if form is COPYING else version)) for name, kind, version, title in GNU for form in (FREE_SOFTWARE, FREE_OPENING, COPYING)]
    named = [*STATEMENTS, *TITLES, *TEXTS, *gnu]
    families = ("AGPL-", "GPL-", "LGPL-")
    spdx = [(n, f"SPDX-License-Identifier: {n}{end}") for n in sorted({n for n, _ in named} - {RESERVED}) for end in (("", "-only", "-or-later") if n.startswith(families) else ("",))]
    return (*named, *spdx)


TEMPLATES = _templates()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def template_weights(spark: SparkSession, templates: tuple = TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """(word, idf); (word, template, license, unit weight); idf of a word in no template."""
    t = table(spark, [(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    tf = t.select("template", "license", F.explode(_words(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    n = len(templates)
    idf = tf.groupBy("word").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, w.join(F.broadcast(norm), "template").select("word", "template", "license", (F.col("w") / F.col("norm")).alias("unit_weight")), math.log(1.0 + n) + 1


def units(files: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, kind, unit, content): whole license files (kind 0), blocks of several lines (1) and lines (2)."""
    f = files.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).alias("path")).where(F.col("text").rlike(MARKERS))
    whole = F.when(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    blocks = F.filter(F.split("text", EMPTY_LINE), lambda x: (F.instr(x, "\n") > 0) & x.rlike(MARKERS))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MARKERS))

    def numbered(kind: int, found: Column) -> Column:
        return F.transform(found, lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), c.alias("content")))

    kinds = [numbered(k, x) for k, x in enumerate((whole, blocks, lines))]
    return f.select("id", F.explode(F.concat(*kinds)).alias("u")).select("id", "u.*")


def scores(found: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(id, kind, unit, license, score) of each unit's best template, from the threshold on."""
    idf, weights, unseen = template_weights(found.sparkSession, templates)
    key = ["id", "kind", "unit"]
    tf = found.select(*key, F.explode(_words(F.col("content"))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.join(F.broadcast(weights), "word").groupBy(*key, "template", "license").agg(F.sum(F.col("w") * F.col("unit_weight")).alias("dot"))
    cosine = dots.join(norms, key).select(*key, "license", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("score"))
    best = cosine.where(F.col("score") >= THRESHOLD).groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select(*key, "b.license", (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """All before the last slash; the root is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """Array of (ancestor, depth): the folder itself and all above it, the root at depth 0."""
    parts = F.split(folder, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat_ws("/", F.slice(parts, 1, i)).alias("ancestor"), i.alias("depth")))
    return F.concat(F.array(F.struct(F.lit("").alias("ancestor"), F.lit(0).alias("depth"))), F.when(folder != "", own).otherwise(F.array().cast("array<struct<ancestor:string,depth:int>>")))


def scan(files: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "path", templates: tuple = TEMPLATES) -> DataFrame:
    """id, path, license, basis (own, inherited or none), score of the own unit, source directory.

    Rows of one id share their units.
    """
    f = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    choice = F.struct((F.col("license") == RESERVED).alias("r"), "kind", (-F.col("score")).alias("s"), "license")
    per = scores(units(f).distinct(), templates).groupBy("id").agg(F.min(choice).alias("b")).select("id", F.col("b.license").alias("own"), (-F.col("b.s")).alias("score"))
    placed = f.select("id", "path", directory(F.col("path")).alias("dir")).join(per, "id", "left")
    named = placed.where(F.col("own").isNotNull() & F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE))
    held = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", F.col("own").alias("license"))).alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.license").alias("given"))
    above = f.select(directory(F.col("path")).alias("dir")).distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.ancestor", "a.depth")
    nearest = above.join(held, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("b")).select("dir", "b.given", F.col("b.ancestor").alias("source_dir"))
    out = placed.join(nearest, "dir", "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.coalesce("own", "given").alias("license"), basis.alias("basis"), "score", F.when(basis == "inherited", F.col("source_dir")).alias("source_dir"))


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of source trees: two levels of folders by number, and one name in seven a license file's."""
    folder = F.concat_ws("/", "source", F.expr("cast(doc_id div 400 as string)"), F.when(F.col("doc_id") % 3 > 0, F.expr("cast(doc_id div 40 as string)")))
    name = F.when(F.col("n_chars") % 7 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat(folder, F.lit("/"), name).alias("path"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(placed_documents(spark, sf_dir), "doc_id").withColumnRenamed("id", "doc_id")


def _op3_sql() -> str:
    rows = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(TEMPLATES))
    n, markers = len(TEMPLATES), MARKERS.removeprefix("(?i)")
    return f"""WITH tt AS (SELECT t, license, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS word FROM (VALUES {rows}) AS v(t, license, x)),
ttf AS (SELECT t, license, word, count(*) AS tf FROM tt GROUP BY ALL), idf AS (SELECT word, ln({1.0 + n} / (1.0 + count(*))) + 1 AS idf FROM ttf GROUP BY word),
tw AS (SELECT t, license, word, tf * idf AS w FROM ttf JOIN idf USING (word)), tu AS (SELECT t, license, word, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS unit FROM tw),
f AS (SELECT doc_id, text, source || '/' || CAST(doc_id // 400 AS VARCHAR) || CASE WHEN doc_id % 3 > 0 THEN '/' || CAST(doc_id // 40 AS VARCHAR) ELSE '' END AS dir, CASE WHEN n_chars % 7 = 0 THEN 'LICENSE' ELSE 'doc' || CAST(doc_id AS VARCHAR) || '.txt' END AS name FROM documents),
k AS MATERIALIZED (SELECT * FROM f WHERE regexp_matches(text, '{markers}', 'i')),
b AS (SELECT doc_id, unnest(string_split_regex(text, '{EMPTY_LINE}')) AS s, generate_subscripts(string_split_regex(text, '{EMPTY_LINE}'), 1) AS line FROM k),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM k),
u AS (SELECT doc_id, 0 AS kind, 1 AS line, text AS s FROM k WHERE name = 'LICENSE' UNION ALL SELECT doc_id, 1, line, s FROM b WHERE contains(s, chr(10)) AND regexp_matches(s, '{markers}', 'i') UNION ALL SELECT doc_id, 2, line, s FROM l WHERE regexp_matches(s, '{markers}', 'i')),
d AS (SELECT doc_id, kind, line, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS word FROM u),
dtf AS (SELECT doc_id, kind, line, word, count(*) AS tf FROM d GROUP BY ALL), dw AS (SELECT doc_id, kind, line, word, tf * coalesce(idf, {math.log(1.0 + n) + 1!r}) AS w FROM dtf LEFT JOIN idf USING (word)),
nm AS (SELECT doc_id, kind, line, sqrt(sum(w * w)) AS norm FROM dw GROUP BY ALL), dt AS (SELECT doc_id, kind, line, t, license, sum(w * unit) AS dot FROM dw JOIN tu USING (word) GROUP BY ALL),
c AS (SELECT doc_id, kind, line, license, round(dot / norm, {DIGITS}) AS score FROM dt JOIN nm USING (doc_id, kind, line)),
own AS (SELECT doc_id, license AS own, score FROM (SELECT * FROM c WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, kind, line ORDER BY score DESC, license) = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY license = '{RESERVED}', kind, score DESC, license) = 1),
p AS (SELECT f.doc_id, dir, dir || '/' || name AS path, name, own, score FROM f LEFT JOIN own USING (doc_id)),
h AS (SELECT dir, own AS given FROM p WHERE own IS NOT NULL AND name = 'LICENSE' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, own) = 1),
x AS (SELECT g.dir, h.dir AS a, h.given FROM (SELECT DISTINCT dir FROM p) g JOIN h ON g.dir = h.dir OR starts_with(g.dir, h.dir || '/') QUALIFY row_number() OVER (PARTITION BY g.dir ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own, given) AS license, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis, score, CASE WHEN own IS NULL THEN a END AS source_dir FROM p LEFT JOIN x USING (dir)"""


OP3_SQL = _op3_sql()
