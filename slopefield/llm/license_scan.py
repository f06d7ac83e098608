"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Every text is a file at a path. Compared with templates, by the cosine of TF-IDF vectors over
words, are its lines that mention a licence, the paragraphs around them, the stretches
of such paragraphs (*headers*; also with one other paragraph between two), its SPDX
identifiers and, of a licence file, the whole text. A paragraph ends at a line without a
letter or digit and where comment and code meet. Templates are notices, standard headers,
identifiers and the public licence texts in ``licences/``. The inverse document frequency
comes from the lines of all texts that mention a licence.
A file that declares nothing itself takes the licence of the nearest directory above it
in which a licence file lies.

Only DataFrame and SQL functions: lines are split out, filtered and counted before any
shuffle, so that a common line is one row with a count, and words of distinct passages are
joined with the words of the templates. What is broadcast is the templates, bounded by
``MAX_TEMPLATE_WORDS``. Directory prefixes of a path are joined with licence files by an
equi-join: depth times the number of paths, no pairs.

Defined cases: null or empty texts declare nothing, nor do texts without a licence word
unless they are licence files; a null path has no directory and inherits nothing; of equally near licences the one that sorts
first wins; a repeated path counts once as a licence file. A text of any length is split into
lines and paragraphs within its row; only those that may declare a licence leave it. Further
columns are not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import joined_with_groups, stored, text_of

# Templates: the notices and openings by which these licences are declared (public texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted. BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
    "version 2.0.",
}


def _gnu(name: str, version: str) -> list[str]:
    """The header that the FSF recommends, and its first paragraph alone."""
    first = (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        f"of the {name} as published by the Free Software Foundation, either version {version} of "
        "the License, or (at your option) any later version."
    )
    return [
        first,
        f"{first} This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of "
        f"the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ]


def _creative_commons(kind: str) -> list[str]:
    return [
        f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
        f"Creative Commons {kind} 4.0 International Public License",
    ]


# Standard headers. Near relatives of a licence are here too, so that the nearest is the right one.
HEADERS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under "
        "the License."
    ],
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ],
    "CC-BY-4.0": _creative_commons("Attribution"),
    "CC-BY-SA-4.0": _creative_commons("Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative_commons("Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _creative_commons("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative_commons("Attribution-NoDerivatives"),
    "CC-BY-NC-ND-4.0": _creative_commons("Attribution-NonCommercial-NoDerivatives"),
}
# One word each, so that an identifier is compared as a whole and only with identifiers.
SPDX = "spdx-license-identifier-"
MAX_TEMPLATE_WORDS = 100_000
THRESHOLD = 0.6
MENTION = r"(?i)licen[sc]e|licen[sc]ed|copyright|spdx|redistribution"


def words(text: Column) -> Column:
    """Distinct lower-case words of letters and digits with inner dots and hyphens."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(found)


def all_templates() -> list[tuple[str, str]]:
    """(licence, text) of notices, headers, public licence texts and SPDX identifiers."""
    files = sorted((Path(__file__).parent / "licences").glob("*.txt"))
    found = [*TEMPLATES.items(), *((k, v) for k, texts in HEADERS.items() for v in texts)]
    found += [(f.stem, f.read_text("utf-8")) for f in files]
    for name in sorted({k for k, _ in found}):
        endings = ("", "-only", "-or-later") if "GPL" in name else ("",)
        found += [(name, SPDX + name + ending) for ending in endings]
    return found


def passages(files: DataFrame) -> DataFrame:
    """(id, core, key, passage), see the head of this module.

    ``core`` marks what document frequencies are counted in: lines that mention a licence, and
    those of a licence file together. ``files``: id, text, licence_file.
    """
    end = "\u0001"
    comment = r"(?:[#*;%/]|--|<!)"
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MENTION))
    marked = F.regexp_replace("text", r"(?md)^[^\p{L}\p{N}\n]*$", end)
    for here, there in (("", "!"), ("!", "=")):
        marked = F.regexp_replace(
            marked,
            rf"(?md)^(?{here or '='}[ \t]*{comment})([^\n{end}]+)\n(?{there}[ \t]*{comment})",
            f"$1\n{end}\n",
        )
    mentions = F.col("text").rlike(MENTION)
    kept = (
        files.where(mentions | F.col("licence_file"))
        .withColumn("_lines", F.transform(lines, F.trim))
        .withColumn("_parts", F.when(mentions, F.split(marked, end)))
        .withColumn("_parts", F.filter("_parts", lambda x: x.rlike(r"[\p{L}\p{N}]")))
        .withColumn("_named", F.transform("_parts", lambda x: x.rlike(MENTION)))
    )

    def named(place: Column) -> Column:
        inside = (place >= 0) & (place < F.size("_named"))
        return F.when(inside, F.get("_named", place)).otherwise(False)

    def stretches(stays) -> Column:
        joined = F.transform("_parts", lambda x, i: F.when(stays(i), x).otherwise(end))
        return F.split(F.array_join(joined, "\n"), end)

    none = F.array().cast("array<string>")
    together = F.when(
        F.col("licence_file") & (F.size("_lines") > 1), F.array(F.array_join("_lines", " "))
    ).otherwise(none)
    blocks = F.concat(
        F.col("_parts"),
        stretches(named),
        stretches(lambda i: named(i) | (named(i - 1) & named(i + 1))),
    )
    blocks = F.filter(F.transform(blocks, F.trim), lambda x: x.rlike(MENTION))
    expressions = F.regexp_extract_all(
        "text", F.lit(r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)"), F.lit(1)
    )
    names = F.split(F.lower(F.array_join(expressions, " ")), r"[^a-z0-9.-]+")
    names = F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(F.lit(SPDX), x))
    whole = F.when(F.col("licence_file") & (F.trim("text") != ""), F.array(F.trim("text")))
    more = F.concat(F.coalesce(blocks, none), names, F.coalesce(whole, none))
    core = F.concat("_lines", together)
    each = F.concat(
        F.transform(core, lambda x: F.struct(F.lit(True).alias("core"), x.alias("passage"))),
        F.transform(
            F.array_except(more, core),
            lambda x: F.struct(F.lit(False).alias("core"), x.alias("passage")),
        ),
    )
    return kept.select("id", F.explode(each).alias("_p")).select(
        "id", "_p.core", F.sha2("_p.passage", 256).alias("key"), "_p.passage"
    )


def _best_templates(found: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(key, members, licence, cosine) of every distinct passage near a template."""
    spark = found.sparkSession
    counted = stored(
        found.groupBy("key").agg(
            F.first("passage").alias("passage"),
            F.count_if("core").alias("copies"),
            F.count(F.lit(1)).alias("members"),
        ),
        "passages",
    )
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    parts = counted.select("key", "copies", F.explode(words(F.col("passage"))).alias("word"))
    known = stored(
        parts.groupBy("word").agg(
            F.sum("copies").alias("df"), F.count(F.lit(1)).alias("passages")
        ),
        "words",
    )

    def idf(df: Column) -> Column:
        return F.log((1.0 + F.lit(total)) / (1.0 + df)) + 1.0

    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    listed = spark.createDataFrame(rows, "form int, licence string, notice string").select(
        "form", "licence", F.explode(words(F.col("notice"))).alias("word")
    )
    weighted = listed.join(known.select("word", "df"), "word", "left").select(
        "form", "licence", "word", F.pow(idf(F.coalesce("df", F.lit(0))), F.lit(2.0)).alias("square")
    )
    norms = weighted.groupBy("form").agg(F.sqrt(F.sum("square")).alias("template_norm"))
    template = weighted.join(norms, "form").select(
        "form", "licence", "template_norm", F.col("word").alias("_word")
    )
    vectors = joined_with_groups(
        parts, known, "word", "passages", counted.count(), F.col("key")
    ).select("key", "word", F.pow(idf(F.col("df")), F.lit(2.0)).alias("square"))
    vectors = stored(vectors, "vectors")
    length = vectors.groupBy("key").agg(F.sqrt(F.sum("square")).alias("norm"))
    template = stored(template, "templates")
    dots = (
        vectors.join(F.broadcast(template), F.col("word") == F.col("_word"))
        .groupBy("key", "form", "licence")
        .agg(F.sum("square").alias("dot"), F.first("template_norm").alias("template_norm"))
    )
    best = (
        dots.join(length, "key")
        .withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6))
        .where(F.col("cosine") >= THRESHOLD)
        .groupBy("key")
        .agg(F.min(F.struct((-F.col("cosine")).alias("lost"), "licence")).alias("best"))
        .select("key", F.col("best.licence").alias("licence"),
                (-F.col("best.lost")).alias("cosine"))
    )
    return stored(best.join(counted.select("key", "members"), "key"), "declared")


def scan(files: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per file: id, own_licence, cosine, licence, origin (own, inherited, none), directory.

    ``files``: id long, path string, text string, licence_file boolean. ``directory`` is the
    one whose licence file a file inherits from. ``templates`` (licence to text) take the place
    of ``all_templates()``.
    """
    files = files.select(
        "id", "path", text_of("text").alias("text"),
        F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
    )
    found = stored(passages(files), "mentions")
    best = _best_templates(found, list(templates.items()) if templates else all_templates())
    own = stored(
        joined_with_groups(
            found.select("id", "key"), best, "key", "members", found.count(), F.col("id")
        )
        .where("licence IS NOT NULL")
        .groupBy("id")
        .agg(F.min(F.struct((-F.col("cosine")).alias("lost"), "licence")).alias("best"))
        .select("id", F.col("best.licence").alias("own_licence"),
                (-F.col("best.lost")).alias("cosine")),
        "own",
    )
    placed = files.select("id", "path", "licence_file")
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    offered = stored(
        placed.where("licence_file AND path IS NOT NULL")
        .join(own, "id")
        .withColumn("_directory", directory)
        .groupBy("_directory")
        .agg(F.min("own_licence").alias("offered")),
        "offers",
    )
    # Every directory once, with all that lie above it, itself included.
    folders = placed.where("path IS NOT NULL").select(directory.alias("folder")).distinct()
    steps = F.split("folder", "/")
    above = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(steps)))).select(
        "folder", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/").alias("_up")
    )
    nearest = (
        above.join(offered, F.col("_up") == F.col("_directory"))
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "offered", "_directory")).alias("best"))
    )
    folder_sizes = placed.where("path IS NOT NULL").groupBy(directory.alias("folder")).agg(
        F.count(F.lit(1)).alias("members")
    )
    inherited = stored(
        nearest.join(folder_sizes, "folder").select(
            "folder", "members", F.col("best.offered").alias("offered"),
            F.col("best._directory").alias("directory"),
        ),
        "inherited",
    )
    rows = placed.join(own, "id", "left").withColumn("folder", directory)
    joined = joined_with_groups(
        rows, inherited, "folder", "members", placed.count(), F.col("id")
    )
    none = F.col("own_licence").isNull()
    return joined.select(
        "id",
        "own_licence",
        "cosine",
        F.coalesce("own_licence", "offered").alias("licence"),
        F.when(~none, "own").when(F.col("offered").isNotNull(), "inherited").otherwise("none")
        .alias("origin"),
        F.when(none, F.col("directory")).alias("directory"),
    )
