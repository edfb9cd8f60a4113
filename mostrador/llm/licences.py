"""Licences of files: headers and licence files compared with templates by TF-IDF, and inheritance down the directories.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mostrador.llm.common import plain_text, stored
from mostrador.llm.mixing import UNKNOWN, length_topic, n_tokens

#: Licences and the names that notices call them by, in lower case as they are compared.
NAMES = (
    ("Apache-2.0", "apache license, version 2.0", "apache 2.0 license", "apache software license 2.0"),
    ("BSD-2-Clause", "bsd 2-clause license", "simplified bsd license"),
    ("BSD-3-Clause", "bsd 3-clause license", "new bsd license", "bsd license"),
    ("BSL-1.0", "boost software license, version 1.0"),
    ("CC-BY-4.0", "cc by 4.0", "creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international public license"),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"),
    ("CC0-1.0", "cc0 1.0 universal", "creative commons zero public domain dedication"),
    ("EPL-2.0", "eclipse public license 2.0", "eclipse public license - v 2.0"),
    ("ISC", "isc license"),
    ("MIT", "mit license", "mit/x11 license"),
    ("MPL-2.0", "mozilla public license, v. 2.0", "mozilla public license version 2.0"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib license", "zlib/libpng license"),
)
#: The GNU licences, their versions and the dates in their titles.
GNU = (
    ("GPL", "general public license", "gpl", (("2", "2.0", "june 1991"), ("3", "3.0", "29 june 2007"))),
    ("LGPL", "lesser general public license", "lgpl", (("2.1", "2.1", "february 1999"), ("3", "3.0", "29 june 2007"))),
    ("AGPL", "affero general public license", "agpl", (("3", "3.0", "19 november 2007"),)),
)
#: How notices name a licence.
WORDINGS = (
    "{}", "licensed under the {}", "released under the {}", "this work is licensed under the {}",
    "distributed under the terms of the {}", "this project is available under the {}",
    "this file is subject to the terms and conditions of the {}")
#: Headers and whole texts of licences.
MIT_GRANT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"software\"), to deal in the software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit "
    "persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the software.")
MIT_WARRANTY = (
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the "
    "warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or "
    "copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
    "otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.")
BSD_TERMS = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
BSD_NAMES = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")
BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, "
    "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or "
    "services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of "
    "this software, even if advised of the possibility of such damage.")
APACHE_HEADER = (
    "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with "
    "the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by "
    "applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, "
    "without warranties or conditions of any kind, either express or implied. see the license for the specific language "
    "governing permissions and limitations under the license.")
GNU_HEADER = (
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu {name} as published "
    "by the free software foundation, either version {version} of the license, or (at your option) any later version. this "
    "program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty "
    "of merchantability or fitness for a particular purpose. see the gnu {name} for more details. you should have received a "
    "copy of the gnu {name} along with this program. if not, see <https://www.gnu.org/licenses/>.")
TEXTS = (
    ("MIT", MIT_GRANT), ("MIT", f"mit license {MIT_GRANT} {MIT_WARRANTY}"),
    ("BSD-2-Clause", BSD_TERMS), ("BSD-2-Clause", f"{BSD_TERMS} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES}"), ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES} {BSD_WARRANTY}"),
    ("Apache-2.0", APACHE_HEADER), ("Apache-2.0", "apache license version 2.0, january 2004 http://www.apache.org/licenses/"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl "
                "was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/."),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held "
             "liable for any damages arising from the use of this software. permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
             "subject to the following restrictions"),
    ("BSL-1.0", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                "and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, "
                "distribute, execute, and transmit the software, and to prepare derivative works of the software"),
)


def _known() -> list[tuple[str, str]]:
    """All templates (licence, text): names in every wording, SPDX lines, headers, titles and texts."""
    named = [(row[0], name) for row in NAMES for name in row[1:]]
    spdx, texts = [(row[0], row[0]) for row in NAMES], list(TEXTS)
    for kind, name, short, versions in GNU:
        named += [(kind, f"gnu {name}"), (kind, f"gnu {short}")]
        for version, full, date in versions:
            licence = f"{kind}-{full}"
            named += [(licence, f"gnu {name}, version {version}"), (licence, f"gnu {short} v{version}"),
                      (licence, f"{short}v{version}")]
            spdx += [(licence, licence + tail) for tail in ("", "-only", "-or-later")]
            texts += [(licence, f"gnu {name} version {version}, {date}"),
                      (licence, GNU_HEADER.format(name=name, version=version)),
                      (licence, GNU_HEADER.format(name=name, version=version).partition(" this program is distr")[0])]
    return ([(licence, w.format(name)) for licence, name in named for w in WORDINGS]
            + [(licence, f"spdx-license-identifier: {tag.lower()}") for licence, tag in spdx] + texts)


TEMPLATES = tuple(_known())
#: A line with one of these is a notice; a header or text carries a licence from this cosine on.
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "spdx", "public domain", "creative commons", "gpl")
LEAST = 0.7
#: What a term that no template has weighs, as a part of one that a single template has.
STRANGE = 0.5
TERM = "[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"
#: How a line of a comment begins and ends, and lines that only name a holder.
MARKED, MARKS = r"^\s*(#|//|/\*|\*|--|;|%|<!--)", r"^[\s#/*;%<!-]+|[\s#/*;%>-]+$"
HOLDER = r"^[^a-z0-9]*(copyright|\(c\)|©|all rights reserved)"
GRANTS = "licen[cs]|permission|public domain|redistribut"
#: Names of licence files, and the words of a text up to which a bound document with a notice counts as one.
LICENCE_FILE, SHORT_WORDS = r"^(un)?(licen[cs]e|copying|notice)([.-].*)?$", 30
#: Stands for a line between two headers.
GAP = "\x01"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def has_cue(text: Column) -> Column:
    """Whether a text in lower case has a cue word."""
    found = text.contains(CUES[0])
    for cue in CUES[1:]:
        found = found | text.contains(cue)
    return found


def templates(spark: SparkSession) -> DataFrame:
    """Rows (template, licence, text) of the fixed templates."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(n).alias("licence"), F.lit(t).alias("text"))
            for i, (n, t) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def is_licence_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/]*$", 0)).rlike(LICENCE_FILE)


def with_units(files: DataFrame) -> DataFrame:
    """``files`` (path, text, ...) with the texts to compare, ``units``, in place of the text.

    A header is a run of lines that are comments or have a cue word, taken whole and without comment marks; each line
    with a cue word is a unit too, as a header may say other things besides. In a licence file the runs are its
    paragraphs, and the whole text is a unit. Lines that only name a copyright holder are left out. A text without a
    cue word has no units.
    """
    low = F.lower(plain_text("text"))
    lines = F.split(low, "\n", -1)
    bare = lambda t: F.regexp_replace(t, MARKS, "")
    holder = lambda t: t.rlike(HOLDER) & ~t.rlike(GRANTS)
    said = F.filter(lines, lambda t: ~holder(bare(t)))
    kept = F.transform(said, lambda t: F.when(
        (bare(t) != "") & (t.rlike(MARKED) | has_cue(t) | is_licence_file(F.col("path"))), bare(t)).otherwise(F.lit(GAP)))
    headers = F.split(F.array_join(kept, "\n"), GAP, -1)
    whole = F.array_join(F.transform(said, bare), "\n")
    units = F.concat(headers, F.transform(said, bare), F.when(is_licence_file(F.col("path")), F.array(whole)).otherwise(
        F.array().cast("array<string>")))
    spaced = F.transform(units, lambda u: F.trim(F.regexp_replace(u, r"\s+", " ")))
    found = F.array_distinct(F.filter(spaced, has_cue))
    return files.withColumn("units", F.when(has_cue(low), found)).drop("text")


def best_matches(files: DataFrame, known: DataFrame) -> DataFrame:
    """The licence that each file itself names, from its ``units``: path, licence, score.

    A term's weight is its count times log(1 + templates / templates with the term); one that no template has weighs
    half as much as if one had it. So a score depends on the unit and the templates alone, not on what else is scanned. It is the cosine
    of a unit and a template, rounded to six places. Each unit takes its nearest template, at equal scores the licence
    first by name; a file takes its unit with the greatest product of weights, then the first licence by name.
    A unit costs rows of its terms only, so no group grows with a common notice, and templates are a fixed small table.
    """
    units = files.where("path is not null").select("path", F.explode("units").alias("text")).select(
        "path", F.md5("text").alias("unit"), "text").distinct()
    unit = ["path", "unit"]
    listed = known.withColumn("term", F.explode(terms(F.col("text")))).groupBy("template", "licence", "term").agg(
        F.count("*").cast("double").alias("n"))
    n_known = known.count()
    rarity = listed.groupBy("term").agg(F.log(1 + F.lit(n_known) / F.count("*")).alias("idf"))
    wanted = listed.join(rarity, "term").select("template", "licence", "term", (F.col("n") * F.col("idf")).alias("other"))
    sizes = wanted.groupBy("template").agg(F.sqrt(F.sum(F.col("other") * F.col("other"))).alias("other_size"))
    counts = units.select(*unit, F.explode(terms(F.col("text"))).alias("term")).groupBy(*unit, "term").agg(
        F.count("*").cast("double").alias("n"))
    vectors = stored(counts.join(rarity, "term", "left").select(
        *unit, "term", (F.col("n") * F.coalesce("idf", STRANGE * F.log(F.lit(1.0 + n_known)))).alias("weight")))
    own = vectors.groupBy(*unit).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    products = vectors.join(wanted, "term").groupBy(*unit, "template", "licence").agg(
        F.sum(F.col("weight") * F.col("other")).alias("product"))
    score = F.round(F.col("product") / (F.col("size") * F.col("other_size")), 6)
    near = products.join(own, unit).join(sizes, "template").withColumn("far", -score).where(F.col("far") <= -LEAST)
    nearest = near.groupBy(*unit).agg(F.min(F.struct(
        "far", "licence", (-F.round("product", 6)).alias("less"))).alias("best"))
    told = nearest.groupBy("path").agg(F.min(F.struct("best.less", "best.licence", "best.far")).alias("best"))
    return told.select("path", "best.licence", (-F.col("best.far")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """:func:`inherit` for ``files`` (path, text), whose texts are read once."""
    return inherit(stored(with_units(files.select("path", "text"))), known)


def inherit(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each distinct path of ``files`` (path, units): path, licence, score, how, from_path.
    ``how`` is own where a notice in the file itself says it, inherited where it is that of the nearest directory above
    with a licence file that carries one, else NULL with no licence. Of several licence files in a directory the one
    with the best score counts, then the first by licence and path. NULL texts are empty, NULL paths are left out;
    rows that share a path are one file. Ancestors are looked up for distinct directories, so a directory with a third
    of all files costs one row.
    """
    known = templates(files.sparkSession) if known is None else known
    files = files.where("path is not null")
    best = stored(best_matches(files, known))
    by_dir = best.where(is_licence_file(F.col("path"))).groupBy(directory(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("far"), "licence", "path")).alias("file"))
    paths = files.select("path").distinct().withColumn("dir", directory(F.col("path")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    nearest = (paths.select("dir").distinct().select("dir", F.inline(above)).join(by_dir, "above").groupBy("dir")
               .agg(F.max_by("file", "depth").alias("file")))
    both = paths.join(best, "path", "left").join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return both.select(
        "path", F.coalesce("licence", "file.licence").alias("licence"),
        F.when(own, F.col("score")).otherwise(-F.col("file.far")).alias("score"),
        F.when(own, "own").when(F.col("file").isNotNull(), "inherited").alias("how"),
        F.when(own, F.col("path")).otherwise(F.col("file.path")).alias("from_path"))


def bound_files(docs: DataFrame) -> DataFrame:
    """Documents as files (doc_id, path, text): short texts with a cue word are licence files of their source and
    language, all others lie in a directory of their length below."""
    text, of = plain_text("text"), lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN))
    words, number = n_tokens(text), F.coalesce(F.col("doc_id").cast("string"), F.lit(UNKNOWN))
    notice = (words <= SHORT_WORDS) & has_cue(F.lower(text))
    place = F.when(notice, F.concat(F.lit("LICENSE."), number)).otherwise(
        F.concat(length_topic(words), F.lit("/"), number, F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", of("source"), of("lang"), place).alias("path"), text.alias("text"))


def sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    cue = "(" + " OR ".join(f"contains({{0}}, '{c}')" for c in CUES) + ")"
    spaces, named = r"[ \t\n\r\f\v]+", "regexp_matches(lower(regexp_extract(path, '[^/]*$')), '" + LICENCE_FILE + "')"
    return f"""WITH words AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
        lower(coalesce(text, '')) AS text, greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')), 1) AS n
        FROM documents),
    files AS (SELECT doc_id, text, source || '/' || lang || '/' || CASE
        WHEN n <= {SHORT_WORDS} AND {cue.format("text")} THEN 'LICENSE.' || doc_id
        ELSE CASE WHEN n < 100 THEN 'short' WHEN n < 1000 THEN 'medium' ELSE 'long' END || '/' || doc_id || '.txt' END AS path
        FROM words),
    split_lines AS (SELECT path, {named} AS named, list_filter(list_transform(string_split(text, chr(10)),
            lambda t: {{'raw': t, 'bare': regexp_replace(t, '{MARKS}', '', 'g')}}),
            lambda x: NOT (regexp_matches(x.bare, '{HOLDER}') AND NOT regexp_matches(x.bare, '{GRANTS}'))) AS parts
        FROM files WHERE {cue.format("text")}),
    made AS (SELECT path, list_concat(list_concat(string_split(array_to_string(list_transform(parts, lambda x: CASE WHEN x.bare <> ''
            AND (named OR regexp_matches(x.raw, '{MARKED}') OR {cue.format("x.raw")}) THEN x.bare ELSE chr(1) END), chr(10)), chr(1)),
            list_transform(parts, lambda x: x.bare)),
            CASE WHEN named THEN [array_to_string(list_transform(parts, lambda x: x.bare), chr(10))] ELSE [] END) AS units
        FROM split_lines),
    lines AS (SELECT DISTINCT path, trim(regexp_replace(unit, '{spaces}', ' ', 'g')) AS text
        FROM (SELECT path, unnest(units) AS unit FROM made) WHERE {cue.format("unit")}),
    known(template, licence, text) AS (VALUES {values}),
    counts AS (SELECT path, text, term, count(*)::DOUBLE AS n FROM
        (SELECT *, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM lines) GROUP BY ALL),
    listed AS (SELECT template, licence, term, count(*)::DOUBLE AS n FROM
        (SELECT *, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM known) GROUP BY ALL),
    spread AS (SELECT term, ln(1 + {len(TEMPLATES)} / count(*)) AS idf FROM listed GROUP BY term),
    vectors AS (SELECT path, text, term, n * coalesce(idf, {STRANGE} * ln(1.0 + {len(TEMPLATES)})) AS weight
        FROM counts LEFT JOIN spread USING (term)),
    wanted AS (SELECT template, licence, term, n * idf AS other FROM listed JOIN spread USING (term)),
    found AS (SELECT path, text, licence, round(product / (size * other_size), 6) AS score, round(product, 6) AS product FROM
        (SELECT path, text, template, licence, sum(weight * other) AS product FROM vectors JOIN wanted USING (term) GROUP BY ALL)
        JOIN (SELECT path, text, sqrt(sum(weight * weight)) AS size FROM vectors GROUP BY ALL) USING (path, text)
        JOIN (SELECT template, sqrt(sum(other * other)) AS other_size FROM wanted GROUP BY ALL) USING (template)),
    nearest AS (SELECT * FROM found WHERE score >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY score DESC, licence, product DESC) = 1),
    best AS (SELECT path, licence, score FROM nearest
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY product DESC, licence, score DESC) = 1),
    carried AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, path AS file, licence, score FROM best
        WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{LICENCE_FILE}')
        QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, licence, path) = 1),
    inherited AS (SELECT f.path, c.* FROM (SELECT DISTINCT path FROM files) f JOIN carried c
        ON starts_with(f.path, c.above || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(above) DESC) = 1)
    SELECT f.doc_id, f.path, coalesce(b.licence, i.licence) AS licence, coalesce(b.score, i.score) AS score,
        CASE WHEN b.path IS NOT NULL THEN 'own' WHEN i.path IS NOT NULL THEN 'inherited' END AS how,
        CASE WHEN b.path IS NOT NULL THEN f.path ELSE i.file END AS from_path
    FROM files f LEFT JOIN best b ON b.path = f.path LEFT JOIN inherited i ON i.path = f.path"""
