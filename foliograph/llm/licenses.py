"""Licence recognition by sentence rules.

A text is cut into pieces at line ends and closing marks; a run of pieces of one paragraph that reads, normalised, as a known
licence sentence is replaced by its identifier. The identifiers of a document, in order, are matched against ordered rules: the first rule whose sequence stands in a row takes
these identifiers, later rules see what is left.

Null or empty texts have no sentences. Repeated rows are scanned one by one, rows of one id together in order of their text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences (lower case, words of letters and digits) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheShort",
    "licensed under the apache license version 2 0 the license": "ApacheNotice",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitShort",
    "licensed under the mit license": "MitShort",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "MitWarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this work is licensed under the gnu general public license version 3": "Gpl3Short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplWarranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2",
    "licensed under cc by 4 0": "CcBy", "licensed under cc by sa 4 0": "CcBySa", "licensed under cc by nc 4 0": "CcByNc",
    "licensed under cc by nd 4 0": "CcByNd", "licensed under cc by nc sa 4 0": "CcByNcSa", "licensed under cc by nc nd 4 0": "CcByNcNd",
    "all rights reserved": "AllRights",
}
#: Published wordings that the fixed sentences above leave out, by the same normalising.
_WORK = "this work is licensed under "
_CC = {"CcBy": ("by", "attribution"), "CcBySa": ("by sa", "attribution sharealike"), "CcByNc": ("by nc", "attribution noncommercial"), "CcByNd": ("by nd", "attribution noderivatives"),
       "CcByNcSa": ("by nc sa", "attribution noncommercial sharealike"), "CcByNcNd": ("by nc nd", "attribution noncommercial noderivatives")}
PUBLISHED = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
} | {f"{_WORK}cc {short} 4 0": name for name, (short, _) in _CC.items()} | {f"{_WORK}a creative commons {long} 4 0 international license": name for name, (_, long) in _CC.items()}
#: Rules in order: the licence and the sentences that must follow each other.
RULES = (
    ("Apache-2.0", ("ApacheNotice", "ApacheCompliance", "ApacheCopy")), ("Apache-2.0", ("ApacheShort", "ApacheCompliance")), ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")), ("MIT", ("MitGrant", "MitNotice", "MitWarranty")), ("MIT", ("MitGrant", "MitNotice")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplWarranty")), ("GPL-2.0-or-later", ("Gpl2Grant", "GplWarranty")), ("GPL-3.0-or-later", ("Gpl3Grant",)), ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("MPL-2.0", ("Mpl2",)), ("Apache-2.0", ("ApacheShort",)), ("MIT", ("MitShort",)), ("GPL-3.0-only", ("Gpl3Short",)), ("CC-BY-4.0", ("CcBy",)), ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-NC-4.0", ("CcByNc",)), ("CC-BY-ND-4.0", ("CcByNd",)), ("CC-BY-NC-SA-4.0", ("CcByNcSa",)), ("CC-BY-NC-ND-4.0", ("CcByNcNd",)), ("Proprietary", ("AllRights",)),
)


def pieces(text: Column) -> Column:
    """Normalised stretches between line ends and closing marks that white space or the end follows, "P" for each paragraph break.
    Comment leaders go first, so that a line of them alone is blank and their marks close nothing."""
    lines = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lower = F.translate(lines, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(lower, "(?m)^(?:[^a-z0-9\\n]*(?:dnl|rem)[ \\t]+[^a-z0-9\\n]*|[^a-z0-9\\n]+)", "")
    closed = F.regexp_replace(F.regexp_replace(bare, "\\n\\n+", "\nP\n"), "[.;:!?]+(?:[ \\t]+|(?=\\n)|\\z)", "\n")
    plain = F.split(F.regexp_replace(closed, "[^a-z0-9P\\n]+", " "), "\n")
    return F.filter(F.transform(plain, lambda x: F.btrim(x)), lambda x: x != "")


def known_runs(parts: Column, known: dict[str, str]) -> Column:
    """(at, until, sentence): known sentences as runs of whole pieces of one paragraph, the longest at each start, none inside
    another. A sentence may be wrapped over lines and may hold marks ('free software: you can', 'v. 2.0')."""
    table = F.array(*[F.struct(F.lit(plain).alias("plain"), F.lit(known[plain]).alias("sentence")) for plain in sorted(known, key=len, reverse=True)])
    words = max(len(plain.split()) for plain in known)
    first = "^(?:" + "|".join(sorted({"{}(?: {}(?: {}|$)|$)".format(*plain.split()[:3]) for plain in known})) + ")"

    def hit(p: Column, i: Column) -> Column:
        def at_run(run: Column) -> Column:
            fits = F.flatten(F.transform(F.array(F.translate(run, "\n", " ")), lambda flat: F.filter(
                table, lambda k: F.startswith(flat, k["plain"]) & F.substring(run, F.length(k["plain"]) + 1, F.lit(1)).isin("", "\n"))))
            return F.transform(F.slice(fits, 1, 1), lambda k: F.struct(
                i.alias("at"), (i + 1 + F.length(k["plain"]) - F.length(F.replace(F.substring(run, F.lit(1), F.length(k["plain"])), F.lit("\n"), F.lit("")))).alias("until"), k["sentence"].alias("sentence")))
        return F.flatten(F.transform(F.array(F.array_join(F.slice(p, i + 1, words), "\n")), at_run))

    def runs(p: Column) -> Column:
        starts = F.array_compact(F.transform(p, lambda x, i: F.when(x.rlike(first), i)))
        hits = F.flatten(F.transform(starts, lambda i: hit(p, i)))
        none = F.array().cast("array<struct<at:int,until:int,sentence:string>>")
        return F.aggregate(hits, none, lambda kept, x: F.when(x["at"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["until"], F.lit(0)), F.concat(kept, F.array(x))).otherwise(kept))

    return F.flatten(F.transform(F.array(parts), runs))


def needed_words(known: dict[str, str]) -> list[str]:
    """Words so chosen that every known sentence holds one: a text without any has no known sentence."""
    left, words = [set(plain.split()) for plain in known], []
    while left:
        words.append(max(sorted(set().union(*left)), key=lambda w: (len(w) > 6, sum(w in x for x in left), len(w))))
        left = [x for x in left if words[-1] not in x]
    return words


def sentence_ids(docs: DataFrame, id: str = "doc_id", text: str = "text", known: dict[str, str] = SENTENCES | PUBLISHED) -> DataFrame:
    """(id, at, sentence): known sentences by their place in the text."""
    lower = F.lower(text)
    some = reduce(or_, [F.contains(lower, F.lit(word)) for word in needed_words(known)])
    found = docs.where(some).select(F.col(id), F.explode(known_runs(pieces(F.col(text)), known)).alias("_run"))
    return found.select(id, F.col("_run.at").alias("at"), F.col("_run.sentence").alias("sentence"))


def licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_sentences, licenses, leftover) of each document with a known sentence: licences in order of the rules, joined
    by spaces, and the number of known sentences that no rule took."""
    found = (sentence_ids(docs, id, text).groupBy(id).agg(F.sort_array(F.collect_list(F.struct("at", "sentence"))).alias("_all"))
             .select(id, F.size("_all").cast("bigint").alias("n_sentences"), F.array_join(F.transform("_all", lambda x: F.concat(F.lit(" "), x["sentence"], F.lit(". "))), "").alias("_rest")))
    names = []
    rest = F.col("_rest")
    for n, (_, rule) in enumerate(RULES):
        wanted = "".join(f" {s}. " for s in rule)
        found = found.withColumn(f"_hit{n}", F.contains(rest, F.lit(wanted))).withColumn("_rest", F.replace(rest, F.lit(wanted), F.lit(" | ")))
        names.append(F.when(F.col(f"_hit{n}"), F.lit(RULES[n][0])))
    return found.select(id, "n_sentences", F.array_join(F.array_distinct(F.array_compact(F.array(*names))), " ").alias("licenses"),
                        (F.length("_rest") - F.length(F.translate("_rest", ".", ""))).cast("bigint").alias("leftover"))
