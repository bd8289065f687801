"""Licence scans with native column expressions.

1. Headers: the lines of a file that speak of licences; of a licence file the whole text
   and these lines, of which the larger cosine counts.
2. Each header is a sparse tf-idf vector and gets the licence of the template with the
   largest cosine, if that reaches ``LEAST``.  Document frequencies cover all headers and
   templates, a licence file counting once with its whole text; words of no template count as new words, so that the lookup table of words
   is as large as the templates and no larger.
   A template that only reserves rights speaks for no licence in particular: it counts where
   no other template reaches LEAST.
3. A file without a licence of its own takes that of the nearest directory above it that
   has a licence file.  Directories, not files, are joined with their ancestors; of several
   licence files in a directory the most frequent licence counts.

Defined results: null texts have no headers, null paths are the empty path; of equal scores
or counts the alphabetically first licence wins; rows that repeat (path, text) get the same
result; a very long text is one vector of its different words; an empty table gives an empty
result, and without templates nothing has a licence.  Columns of ``files`` stay, whatever
their names, but for those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.storage import Steps

# Lines in which one of these stems occurs are headers.
CUES = "licen[sc]|copyright|rights reserved|warrant|permission|redistribut|spdx"
LICENSE_FILE = "(?i)^(un)?(licen[sc]e|copying|notice|copyright)([-.].*)?$"
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.5
# Above this many directories with a licence the lookup is shuffled.
BROADCAST_DIRECTORIES = 200_000

# Published licence texts and notices.
BSD_HEAD = " ".join([
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following",
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the",
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and",
    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
])
BSD_NAMES = " ".join([
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "derived from this software without specific prior written permission.",
])
BSD_TAIL = " ".join([
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,",
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO",
    "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR",
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR",
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR",
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE",
    "POSSIBILITY OF SUCH DAMAGE.",
])
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("GPL-2.0", "GNU General Public License, version 2."),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0, no rights reserved."),
    ("LicenseRef-proprietary", "All rights reserved."),
    ("LicenseRef-proprietary", "Confidential and proprietary. All rights reserved. No part may be reproduced without permission."),
    ("MIT", " ".join([
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated",
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to",
        "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this",
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS,",
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS",
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,",
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION",
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ])),
    ("ISC", " ".join([
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby",
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED",
        "AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF",
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL",
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE",
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ])),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", f"BSD 2-Clause License. {BSD_HEAD} {BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. {BSD_HEAD} {BSD_NAMES} {BSD_TAIL}"),
    ("Apache-2.0", " ".join([
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the",
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable",
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES",
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and",
        "limitations under the License.",
    ])),
    *[(f"GPL-{v}.0", " ".join([
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        f"as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty",
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ])) for v in (2, 3)],
]
# Licences that a text has only if it has no other.
GENERIC = ["LicenseRef-proprietary"]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(
        [(i, *t) for i, t in enumerate(templates)], "template int, license string, text string"
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def header_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.lower(line).rlike(CUES))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """(dir, depth) of a directory and all above it, the root '' included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    levels = F.sequence(F.lit(0), F.size(parts))
    return F.transform(
        levels, lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth"))
    )


def scored_headers(files: DataFrame, templates: DataFrame, steps: Steps) -> DataFrame:
    """(path, text_key, license, score) of the best header of each file with one."""
    is_license, found = base_name(F.col("path")).rlike(LICENSE_FILE), header_lines(F.col("text"))
    lines = files.select(
        "path",
        "text_key",
        is_license.alias("whole"),
        F.posexplode(F.when(is_license, F.concat(F.array("text"), found)).otherwise(found)).alias("line", "header"),
    )
    lines = lines.dropDuplicates(["path", "text_key", "line"])
    header = ["path", "text_key", "line"]
    counts = steps.write(
        lines.select(*header, "whole", F.explode(tokens(F.col("header"))).alias("term"))
        .groupBy(*header, "whole", "term")
        .agg(F.count("*").alias("tf"))
    )
    # the lines of a licence file are in its whole text, which is line 0
    once = counts.where("NOT whole OR line = 0")
    words = templates.select("template", "license", F.explode(tokens(F.col("text"))).alias("term"))
    postings = words.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    # as large as the templates
    vocabulary = F.broadcast(postings.groupBy("term").agg(F.count("*").alias("in_templates")))
    seen = once.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("in_headers"))
    n = once.select(*header).distinct().count() + templates.count()
    in_all = F.coalesce("in_headers", F.lit(0)) + F.col("in_templates")
    known = vocabulary.join(seen, "term", "left").select(
        "term", (F.log(F.lit(1.0 + n) / (1 + in_all)) + 1).alias("idf")
    )
    own = postings.join(known, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = own.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = own.join(norms, "template").groupBy("term").agg(
        F.first("idf").alias("idf"),
        F.collect_list(F.struct("template", "license", (F.col("w") / F.col("norm")).alias("w"))).alias("in"),
    )
    # one row per header: its norm, and its product with every template it shares a word with
    new = F.log(F.lit(1.0 + n)) + 1
    terms = counts.join(F.broadcast(weighted), "term", "left")
    terms = terms.withColumn("w", F.col("tf") * F.coalesce("idf", new))
    lengths = terms.groupBy(*header).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    products = (
        terms.where("idf IS NOT NULL")
        .select(*header, "w", F.inline("in").alias("template", "license", "tw"))
        .groupBy(*header, "template", "license")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("product"))
    )
    scored = products.join(lengths, header).withColumn(
        "score", F.round(F.least(F.lit(1.0), F.col("product") / F.col("norm")), 6)
    )
    # a licence before a generic one, the largest score, then the first name
    rank = F.struct(F.col("license").isin(GENERIC).alias("g"), (-F.col("score")).alias("s"), "license")
    best = scored.where(F.col("score") >= LEAST).groupBy("path", "text_key").agg(F.min(rank).alias("b"))
    return best.select("path", "text_key", "b.license", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, templates: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """``files`` (path, text, ...) without the text, with license, score, origin and from_dir.

    ``origin`` is header, inherited or none; ``from_dir`` is the directory inherited from.
    """
    spark = files.sparkSession
    steps = steps or Steps(spark)
    templates = template_table(spark) if templates is None else templates
    own = ["license", "score", "origin", "from_dir", "text", "path"]
    kept = [c for c in files.columns if c.lower() not in own]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    keyed = files.select(path.alias("path"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    # all but the texts: what follows does not read them again, even where the paths are
    # made of them
    rows = steps.write(
        files.select(
            *[F.col(c).alias(f"in_{i}") for i, c in enumerate(kept)],
            path.alias("path"), F.xxhash64(text).alias("text_key"), directory(path).alias("own_dir"),
        )
    )
    found = steps.write(scored_headers(keyed, templates, steps))
    by_file = found.where(base_name(F.col("path")).rlike(LICENSE_FILE))
    counted = by_file.groupBy(directory(F.col("path")).alias("dir"), "license").agg(F.count("*").alias("n"))
    licensed = counted.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("b"))
    licensed = licensed.select("dir", F.col("b.license").alias("above"))
    if licensed.limit(BROADCAST_DIRECTORIES + 1).count() <= BROADCAST_DIRECTORIES:
        licensed = F.broadcast(licensed)
    directories = rows.select("own_dir").distinct()
    nearest = (
        directories.select("own_dir", F.inline(ancestors(F.col("own_dir"))))
        .join(licensed, "dir")
        .groupBy("own_dir")
        .agg(F.max(F.struct("depth", "dir", "above")).alias("n"))
        .select("own_dir", F.col("n.dir").alias("above_dir"), F.col("n.above").alias("above"))
    )
    joined = rows.join(found, ["path", "text_key"], "left").join(nearest, "own_dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)],
        "path",
        F.coalesce("license", "above", F.lit("none")).alias("license"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(has, "header").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("above_dir")).alias("from_dir"),
    )
