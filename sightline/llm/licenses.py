"""Licence notices, recognised sentence by sentence with column expressions only."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, and their identifiers. Fixed values.
SENTENCES = {
    "released under the mit license": "MIT_NOTICE",
    "licensed under the mit license": "MIT_NOTICE",
    "this software is released under the mit license": "MIT_NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_CONDITION",
    "licensed under the apache license version 2 0": "APACHE2_NOTICE",
    "licensed under the apache license version 2 0 the license": "APACHE2_NOTICE",
    "you may not use this file except in compliance with the license": "APACHE2_CONDITION",
    "you may obtain a copy of the license at": "APACHE2_COPY",
    "this work is licensed under the gnu general public license version 3": "GPL3_NOTICE",
    "licensed under the gnu general public license version 3": "GPL3_NOTICE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_GRANT",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "licensed under cc by nc 4 0": "CCBYNC4_NOTICE",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4_NOTICE",
    "licensed under cc by 4 0": "CCBY4_NOTICE",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4_NOTICE",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
}

#: Names by which notices call a licence, normalised, and the licence's identifier. Fixed values.
NAMES = {
    "AGPL3": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agpl version 3"),
    "LGPL3": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl version 3"),
    "LGPL21": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1"),
    "GPL3": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3"),
    "GPL2": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2"),
    "MPL2": ("mozilla public license version 2 0", "mozilla public license 2 0", "terms of the mozilla public license version 2 0"),
    "APACHE2": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "MIT": ("mit license",),
    "ISC": ("isc license",),
    "BSD3": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "BSD2": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "UNLICENSE": ("unlicense license",),
}
#: What stands before the name. Fixed values.
OPENINGS = ("licensed under the", "released under the", "distributed under the", "available under the", "licensed under the terms of the", "released under the terms of the", "distributed under the terms of the", "available under the terms of the", "this software is released under the", "this software is licensed under the", "this project is licensed under the", "this work is licensed under the", "this program is licensed under the", "this program is distributed under the terms of the", "this software is licensed under the terms of the", "this project is licensed under the terms of the")
#: Creative Commons licences by the letters of their short name. Fixed values.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
#: Sentences of the licences' own notices, as the ends of sentences part them. Fixed values.
NOTICES = {
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL_WARRANTY",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2_NOTICE",  # its "v. 2.0" ends a sentence
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_NOTICE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_GRANT",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNLICENSE_TERMS",
    "licensed under creative commons zero 1 0": "CC0_NOTICE",
    "licensed under cc0 1 0 universal": "CC0_NOTICE",
    "this work is licensed under cc0 1 0": "CC0_NOTICE",
    "this work is licensed under cc0 1 0 universal": "CC0_NOTICE",
    "this work is dedicated to the public domain under cc0 1 0": "CC0_NOTICE",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0_NOTICE",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0_NOTICE",
}


def _more_sentences() -> dict[str, str]:
    """Notices made of an opening and a name, and the grants of the GNU licences, which ``;`` and ``:`` may part."""
    made = {f"{opening} {name}": f"{key}_NOTICE" for key, names in NAMES.items() for name in names for opening in OPENINGS}
    for short, long in COMMONS.items():
        for version in ("4 0", "3 0"):
            key = f"CC{short.replace(' ', '').upper()}{version[0]}_NOTICE"
            kind = "international" if version == "4 0" else "unported"
            for name in (f"cc {short} {version}", f"creative commons {long} {version} {kind} license", f"creative commons {long} {version} license"):
                for opening in ("licensed under", "licensed under a", "licensed under the"):
                    made |= {f"{opening} {name}": key, f"this work is {opening} {name}": key}
    for key, name in (("GPL", "gnu general public license"), ("LGPL", "gnu lesser general public license"), ("AGPL", "gnu affero general public license")):
        terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        made[terms] = f"{key}_TERMS"
        for version in ("2", "2 1", "3"):
            later = f"either version {version} of the license or at your option any later version"
            made |= {later: f"V{version.replace(' ', '')}_LATER", f"{terms} {later}": f"{key}{version.replace(' ', '')}_GRANT"}
    return made


for _sentence, _name in (_more_sentences() | NOTICES).items():
    SENTENCES.setdefault(_sentence, _name)

#: Rules in order: the identifiers that must follow each other (others may stand between), and the licence. Fixed values.
RULES = (
    (("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"), "BSD-3-Clause"),
    (("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"), "BSD-2-Clause"),
    (("MIT_GRANT", "MIT_CONDITION"), "MIT"),
    (("MIT_NOTICE",), "MIT"),
    (("APACHE2_NOTICE",), "Apache-2.0"),
    (("APACHE2_CONDITION", "APACHE2_COPY"), "Apache-2.0"),
    (("GPL3_GRANT", "GPL_WARRANTY"), "GPL-3.0"),
    (("GPL3_NOTICE",), "GPL-3.0"),
    (("CCBYNC4_NOTICE",), "CC-BY-NC-4.0"),
    (("CCBY4_NOTICE",), "CC-BY-4.0"),
    (("GPL3_GRANT",), "GPL-3.0"),
    (("GPL_TERMS", "V3_LATER"), "GPL-3.0"),
    (("GPL2_GRANT",), "GPL-2.0"),
    (("GPL_TERMS", "V2_LATER"), "GPL-2.0"),
    (("GPL2_NOTICE",), "GPL-2.0"),
    (("LGPL3_GRANT",), "LGPL-3.0"),
    (("LGPL_TERMS", "V3_LATER"), "LGPL-3.0"),
    (("LGPL3_NOTICE",), "LGPL-3.0"),
    (("LGPL21_GRANT",), "LGPL-2.1"),
    (("LGPL_TERMS", "V21_LATER"), "LGPL-2.1"),
    (("LGPL21_NOTICE",), "LGPL-2.1"),
    (("AGPL3_GRANT",), "AGPL-3.0"),
    (("AGPL_TERMS", "V3_LATER"), "AGPL-3.0"),
    (("AGPL3_NOTICE",), "AGPL-3.0"),
    (("MPL2_NOTICE",), "MPL-2.0"),
    (("ISC_GRANT",), "ISC"),
    (("ISC_NOTICE",), "ISC"),
    (("UNLICENSE_GRANT",), "Unlicense"),
    (("UNLICENSE_NOTICE",), "Unlicense"),
    (("BSD3_NOTICE",), "BSD-3-Clause"),
    (("BSD2_NOTICE",), "BSD-2-Clause"),
    (("CC0_NOTICE",), "CC0-1.0"),
    *(((f"CC{s.replace(' ', '').upper()}{v[0]}_NOTICE",), f"CC-{s.replace(' ', '-').upper()}-{v}") for v in ("4.0", "3.0") for s in COMMONS if (s, v) not in (("by", "4.0"), ("by nc", "4.0"))),
)

#: A sentence ends at closing punctuation before white space, or at a line without letters and digits (empty, or with no
#: more than the sign that leads the lines of a comment). Lines within one are wrapped text, or several sentences, perhaps
#: after a holder's line, without punctuation.
SENTENCE_END = r"[.!?;:][)\"'\]]*(?:\s+|$)|\n[^A-Za-z0-9\n]*\n"
#: What names a holder within a sentence, and the words by which the known sentence does. Fixed values.
HOLDERS = (
    ("^neither the name of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("^to the extent possible under law .+ has waived all copyright", "to the extent possible under law the author has waived all copyright"),
)


def normalised(sentence: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def nameless(sentence: Column) -> Column:
    """A normalised sentence without the holder that it names."""
    return reduce(lambda s, x: F.regexp_replace(s, *x), HOLDERS, sentence)


def recognised(ids: Column, rules=RULES) -> Column:
    """The licences whose rules the ordered identifiers satisfy, in rule order, each once.

    A licence is reported once; where the rule of BSD-3-Clause matches, the shorter BSD-2-Clause isn't reported.
    """
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    hits = [F.when(line.rlike(".*".join(f" {x} " for x in need)), F.lit(name)) for need, name in rules]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return F.when(F.array_contains(found, "BSD-3-Clause"), F.array_remove(found, "BSD-2-Clause")).otherwise(found)


def cue_words(sentences: list[str]) -> list[str]:
    """A few words of which every sentence has one, the most common first; a text without any has no known sentence."""
    left, cues = set(sentences), []
    while left:
        count = Counter(w for s in left for w in set(s.split()))
        best = max(count, key=lambda w: (count[w] * (len(w) > 4), len(w), w))
        cues.append(best)
        left = {s for s in left if best not in s}
    return cues


def first_words(sentences: list[str]) -> list[str]:
    return sorted({x.split()[0] for x in sentences})


def most_lines(sentences: list[str]) -> int:
    """Lines that a known sentence can be wrapped into: one for each word."""
    return max(len(x.split()) for x in sentences)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """A row per document: its licence sentences in order and the licences that their sequence satisfies.

    Every text is cut into sentences, each is normalised and looked up among the known ones. What is none as a whole is
    searched for runs of its lines that are one: from each line on the longest, but for runs inside of others. That leaves
    a short sequence of identifiers; ordered rules over that sequence give the licences. All is done with column
    expressions within the row, so nothing is shuffled and no document can become a skewed key. Texts without any of a
    few cue words, of which every known sentence has one, are not cut. Both tables are parameters held in the plan; they
    don't grow with the corpus.

    Null and empty texts have no sentences; repeated rows are reported each; further columns are ignored.

    Returns: the id, n_sentences (known ones, repeats counted), sentence_ids and licenses (comma-joined).
    """
    known = dict(sorted((SENTENCES if sentences is None else sentences).items(), key=lambda x: -len(x[0])))
    shortest, longest, words = min(map(len, known)), most_lines(list(known)), min(4, *(len(x.split()) for x in known))
    groups: dict[str, list[str]] = {}  # sentences by their first words, the longest first
    for sentence in known:
        groups.setdefault(" ".join(sentence.split()[:words]), []).append(sentence)
    grouped = [x for own in groups.values() for x in own]
    listed = lambda values: F.split(F.lit("\n".join(map(str, values))), "\n")  # noqa: E731  # one literal, folded when the query is planned
    texts, names, heads, openings = listed(grouped), listed(known[x] for x in grouped), listed(groups), listed(first_words(grouped))
    sizes = [len(own) for own in groups.values()]
    starts, counts = listed(accumulate([1, *sizes[:-1]])).cast("array<int>"), listed(sizes).cast("array<int>")

    def beginning(head: Column) -> Column:
        """The known sentences that begin with these words."""
        at = (F.array_position(heads, head) - 1).cast("int")
        return F.slice(texts, F.get(starts, at), F.get(counts, at))

    def look_up(sentence: Column) -> Column:
        return F.get(names, (F.array_position(texts, sentence) - 1).cast("int"))

    def of_lines(piece: Column) -> Column:
        lines = F.filter(F.transform(F.split(piece, r"\n"), normalised), lambda s: s != "")
        # a line longer than any known sentence is in none
        lines = F.transform(lines, lambda s: F.substring(s, 1, len(next(iter(known))) + 1))
        return F.transform(F.array(lines), runs_of)[0]

    def runs_of(lines: Column) -> Column:
        """The names of the runs of lines that are known sentences; ``lines`` is evaluated already."""
        text = lambda own, sep: F.concat(F.array_join(own, sep), F.lit(sep))
        head = lambda i: F.substring_index(text(F.slice(lines, i + 1, F.lit(words)), " "), " ", words)
        begins = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: F.array_contains(openings, F.substring_index(F.get(lines, i), " ", 1)))
        begins = F.filter(begins, lambda i: F.array_contains(heads, head(i)))
        wrapped = F.transform(begins, lambda i: F.struct(i.alias("i"), F.slice(lines, i + 1, F.lit(longest)).alias("own")))
        joined = F.transform(wrapped, lambda x: F.struct(x["i"].alias("i"), text(x["own"], "|").alias("lines"), text(x["own"], " ").alias("text")))
        at_end = lambda x, k: F.startswith(x["text"], k) & (F.substring(x["lines"], F.length(k) + 1, F.lit(1)) == "|")
        found = F.transform(joined, lambda x: F.struct(x["i"].alias("i"), x["lines"].alias("lines"), F.get(F.filter(beginning(F.substring_index(x["text"], " ", words)), lambda k: at_end(x, k)), F.lit(0)).alias("k")))
        last = lambda x: x["i"] + F.size(F.split(F.substring(x["lines"], F.lit(1), F.length(x["k"])), r"\|")) - 1
        runs = F.transform(F.filter(found, lambda x: x["k"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), last(x).alias("last"), look_up(x["k"]).alias("name")))
        return F.transform(F.array(runs), outermost)[0]

    def outermost(runs: Column) -> Column:
        """The names of the runs that aren't inside of one that begins before; that one is among the ``longest`` runs before."""
        before = lambda k: F.slice(runs, F.greatest(k - longest, F.lit(0)) + 1, F.least(k, F.lit(longest)))
        return F.transform(F.filter(runs, lambda r, k: ~F.exists(before(k), lambda o: o["last"] >= r["last"])), lambda r: r["name"])

    pieces = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SENTENCE_END), lambda s: F.length(s) >= shortest)
    both = F.transform(pieces, lambda s: F.struct(s.alias("piece"), look_up(nameless(normalised(s))).alias("name")))
    ids = F.array_compact(
        F.flatten(F.transform(both, lambda x: F.when(x["name"].isNotNull() | ~F.contains(x["piece"], F.lit("\n")), F.array(x["name"])).otherwise(of_lines(x["piece"]))))
    )
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    cued = reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(x)) for x in cue_words(list(known))])
    few = docs.select(F.col(id_col), F.col(text_col), low.alias("_low")).select(id_col, F.when(cued, F.col(text_col)).alias(text_col))
    return few.select(F.col(id_col), F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(ids).alias("ids")).select(
        id_col,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(recognised(F.col("ids"), rules), ",").alias("licenses"),
    )
