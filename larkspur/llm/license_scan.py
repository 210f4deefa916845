"""License scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences: at a mark (. ! ? ; :) before white space or the text's end,
and at lines that hold no letter or digit. Each sentence is normalised (ASCII lower case,
its lines joined, runs of other characters to one space) and looked up among known licence
sentences; some of those have a slot, for a name or a year. A sentence of several lines that
is not known is looked through for consecutive lines that together are, so a notice needs
neither marks nor blank lines around it, and comment marks at the starts of lines don't
matter. The identifiers found, in text order, form a sequence; ordered rules are matched
against it from left to right, and at each place the first rule that fits wins and takes its
identifiers. Identifiers are single code points of a string, so the rules are one ordered
alternation over it. No shuffle, no join: a document is one row in, one out. Texts that
hold none of the few words of which every known sentence has one are not cut at all.

Defined cases: a null or empty text, and one without a known sentence, has an
empty sequence and no licence; repeated sentences and rows are reported as often
as they occur; where lines from the same line on are known sentences of different
lengths, the longest counts; a text's length has no bound; null ids are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier of a sentence, its normalised wording.
SENTENCES = (
    ("apache-2.0-short", "licensed under the apache license version 2 0"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0-compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0-copy", "you may obtain a copy of the license at"),
    ("apache-2.0-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-short", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl-3.0-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0-program", "this program is licensed under the gnu general public license version 3"),
    ("gpl-2.0-short", "this work is licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software"),
    ("gpl-3.0-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0-only", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("agpl-3.0-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-free", "this library is free software"),
    ("lgpl-2.1-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-2.1-short", "licensed under the gnu lesser general public license version 2 1"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant-and", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl-2.0-form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl-2.0-copy-http", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-4.0-short", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0-short", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0-short", "licensed under cc by nc 4 0"),
    ("cc0-dedication", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense-domain", "this is free and unencumbered software released into the public domain"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0-header", "distributed under the boost software license version 1 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit-code", "code is under the mit license"),
    ("mit-this-code", "this code is under the mit license"),
    ("mit-project", "this project is licensed under the mit license"),
    ("mit-software", "this software is released under the mit license"),
    ("epl-2.0-header", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl-2.0-header-v", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("epl-1.0-header", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
)
# Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent",
    "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "HPND", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Ruby", "Unicode-3.0",
    "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
SENTENCES += tuple((f"spdx-{name.lower()}", "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())) for name in SPDX)
# Identifier of a sentence with a slot, how it starts, what it is.
SLOTS = (
    ("bsd-no-endorsement", "neither the name of", r"^neither the name of( [a-z0-9]+){1,40} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd-no-endorsement-name", "the name of", r"^the names? of( [a-z0-9]+){1,40} (may|must) not be used to endorse or promote products derived from this software without (specific )?prior written permission$"),
)
# Licence, the sentences that show it, in order; the first rule that fits a place wins.
RULES = (
    ("Apache-2.0", ("apache-2.0-header", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see")),
    ("Apache-2.0", ("apache-2.0-header", "apache-2.0-compliance")),
    ("Apache-2.0", ("apache-2.0-short", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-as-is")),
    ("Apache-2.0", ("apache-2.0-short", "apache-2.0-compliance")),
    ("Apache-2.0", ("apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3.0-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2.0-later", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl-free", "gpl-2.0-only", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3.0-later", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-2.1-later", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-3.0-later", "lgpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3.0-later",)),
    ("GPL-2.0-or-later", ("gpl-2.0-later",)),
    ("GPL-2.0-only", ("gpl-2.0-only",)),
    ("AGPL-3.0-or-later", ("agpl-3.0-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-later",)),
    ("LGPL-3.0-or-later", ("lgpl-3.0-later",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement-name")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-no-endorsement-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and", "isc-as-is")),
    ("ISC", ("isc-grant-and",)),
    ("MPL-2.0", ("mpl-2.0-form", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-form", "mpl-2.0-copy-http")),
    ("MPL-2.0", ("mpl-2.0-form",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Apache-2.0", ("apache-2.0-header",)),
    ("Apache-2.0", ("apache-2.0-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0", ("gpl-3.0-short",)),
    ("GPL-3.0", ("gpl-3.0-program",)),
    ("GPL-2.0", ("gpl-2.0-short",)),
    ("LGPL-2.1", ("lgpl-2.1-short",)),
    ("CC-BY-4.0", ("cc-by-4.0-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-short",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("bsl-1.0-header",)),
    ("MIT", ("mit-code",)),
    ("MIT", ("mit-this-code",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-software",)),
    ("EPL-2.0", ("epl-2.0-header",)),
    ("EPL-2.0", ("epl-2.0-header-v",)),
    ("EPL-1.0", ("epl-1.0-header",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A mark that ends no sentence.
SPDX_MARK = "spdx-license-identifier:"
#: What a version's "v." becomes, lines without a letter or digit, and a sentence's other ends.
VERSION = r"([^a-z0-9]v)\.[ \t]*([0-9])"
BLANK_LINES = r"\n[^a-z0-9]*\n"
MARK = r"[.!?;:]+([ \t\n]|\z)"
#: Runs of other characters but single spaces, which are most of them and stay as they are.
OTHERS = r"[^a-z0-9 \n\x01][^a-z0-9\n\x01]*| [^a-z0-9\n\x01]+"
END = "\x01"
#: Words, and so lines, of the longest known sentence, slots included.
LONGEST = 80
#: The code point of the first identifier.
FIRST_CODE = 0x4E00


def codes(sentences=SENTENCES, slots=SLOTS) -> dict[str, str]:
    return {name: chr(FIRST_CODE + i) for i, (name, *_) in enumerate((*sentences, *slots))}


def sentence_array(text: Column) -> Column:
    """The sentences of a text, in order, words separated by a space or a line's end."""
    lower = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), UPPER + "\r\x01", LOWER + "\n ")
    ends = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(lower, F.lit(SPDX_MARK), F.lit(SPDX_MARK[:-1] + " ")), VERSION, "$1 $2"), BLANK_LINES, END), MARK, END)
    words = F.regexp_replace(F.regexp_replace(ends, OTHERS, " "), r" ?\n ?", "\n")
    return F.transform(F.split(words, END), lambda s: F.btrim(s, F.lit(" \n")))


class Known:
    """Lookups of normalised sentences."""

    def __init__(self, sentences=SENTENCES, slots=SLOTS):
        code = codes(sentences, slots)
        self.wordings = [wording for _, wording in sentences]
        self.to_code = F.create_map(*[F.lit(x) for name, wording in sentences for x in (wording, code[name])])
        self.slots = [(start, pattern, code[name]) for name, start, pattern in slots]
        self.starts = sorted({" ".join(start.split(" ")[:2]) for start in (*self.wordings, *(start for start, *_ in self.slots))})

    def code_of(self, sentence: Column) -> Column:
        """The identifier of a sentence, or null; one hash probe for most."""
        out = F.when(sentence.isin(self.wordings), F.element_at(self.to_code, sentence))
        for start, pattern, code in self.slots:
            out = out.when(sentence.startswith(start) & sentence.rlike(pattern), F.lit(code))
        return out

    def may_start(self, line: Column) -> Column:
        return F.substring_index(line, " ", 2).isin(self.starts)

    def codes_of(self, sentence: Column) -> Column:
        """The identifiers of a sentence, or of the runs of its lines that are known."""
        def known_runs(lines: Column) -> Column:
            def run_from(line: Column, i: Column) -> Column:
                most = F.least(F.size(lines) - i, F.lit(LONGEST))
                found = F.transform(F.sequence(F.lit(1), most), lambda n: self.code_of(F.array_join(F.slice(lines, i + 1, n), " ")))
                return F.when(self.may_start(line), F.try_element_at(F.array_compact(found), F.lit(-1)))

            return F.array_compact(F.transform(lines, run_from))

        def one_or_runs(code: Column) -> Column:
            several = F.when(sentence.contains("\n"), bound(F.split(sentence, "\n"), known_runs)).otherwise(F.array().cast("array<string>"))
            return F.when(code.isNotNull(), F.array(code)).otherwise(several)

        return bound(F.translate(sentence, "\n", " "), lambda whole: bound(self.code_of(whole), one_or_runs))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is made once: inside lambdas, what is named twice is made twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(docs: DataFrame, sentences=SENTENCES, rules=RULES, slots=SLOTS) -> DataFrame:
    """Per document: doc_id, sentence_ids and licenses (comma-joined), n_licenses.

    ``sentence_ids`` are in text order; ``licenses`` has each licence once, sorted;
    ``n_licenses`` counts all rule matches.
    """
    code, known = codes(sentences, slots), Known(sentences, slots)
    to_name = F.create_map(*[F.lit(x) for name in code for x in (code[name], name)])
    text = F.col("text").cast("string")
    lower = F.lower(text)
    some = reduce(lambda a, b: a | b, [lower.contains(w) for w in telling_words((*sentences, *slots))])
    found = F.when(some, F.flatten(F.transform(sentence_array(text), known.codes_of))).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(found, "").alias("seq"))
    patterns = rule_patterns(code, rules)
    to_license = F.create_map(*[F.lit(x) for pattern, name in patterns.items() for x in (pattern, name)])
    hits = F.transform(F.regexp_extract_all("seq", F.lit("|".join(patterns)), F.lit(0)), lambda m: F.element_at(to_license, m))
    return out.withColumn("hits", hits).select(
        "doc_id",
        F.array_join(F.transform(F.split("seq", ""), lambda c: F.element_at(to_name, c)), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("licenses"),
        F.size("hits").cast("long").alias("n_licenses"),
    )


def telling_words(sentences) -> list[str]:
    """Words of which every known sentence has one: a text without any of them has no known sentence.

    Chosen by how many sentences still without one they tell of.
    """
    left, out = {name: set(re.findall("[a-z]{5,}", text)) or set(re.findall("[a-z0-9]+", text)) for name, text, *_ in sentences}, []
    while left:
        count = Counter(w for words in left.values() for w in words)
        out.append(max(count, key=lambda w: (count[w], w)))
        left = {name: words for name, words in left.items() if out[-1] not in words}
    return out


def rule_patterns(code: dict[str, str], rules) -> dict[str, str]:
    """Identifier string of each rule, in the rules' order, and its licence."""
    out: dict[str, str] = {}
    for name, steps in rules:
        out.setdefault("".join(code[s] for s in steps), name)
    return out


#: Written out apart from the tables above but for SPDX's names, with letters of its own for the identifiers.
ORACLE = r"""
WITH spdx AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS n FROM (SELECT string_split(':spdx', ' ') AS ids)),
known(wording, code, name) AS (VALUES
  ('licensed under the apache license version 2 0', 'A', 'apache-2.0-short'),
  ('licensed under the apache license version 2 0 the license', 'B', 'apache-2.0-header'),
  ('you may not use this file except in compliance with the license', 'C', 'apache-2.0-compliance'),
  ('you may obtain a copy of the license at', 'D', 'apache-2.0-copy'),
  ('unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied', 'E', 'apache-2.0-as-is'),
  ('see the license for the specific language governing permissions and limitations under the license', 'F', 'apache-2.0-see'),
  ('released under the mit license', 'G', 'mit-short'),
  ('licensed under the mit license', 'H', 'mit-licensed'),
  ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'I', 'mit-grant'),
  ('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'J', 'mit-notice'),
  ('the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement', 'K', 'mit-as-is'),
  ('this work is licensed under the gnu general public license version 3', 'L', 'gpl-3.0-short'),
  ('this program is licensed under the gnu general public license version 3', 'M', 'gpl-3.0-program'),
  ('this work is licensed under the gnu general public license version 2', 'N', 'gpl-2.0-short'),
  ('this program is free software', 'O', 'gpl-free'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'P', 'gpl-3.0-later'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'Q', 'gpl-2.0-later'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation', 'R', 'gpl-2.0-only'),
  ('you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'S', 'agpl-3.0-later'),
  ('this program is distributed in the hope that it will be useful but without any warranty', 'T', 'gpl-warranty'),
  ('this library is free software', 'U', 'lgpl-free'),
  ('you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version', 'V', 'lgpl-2.1-later'),
  ('you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'W', 'lgpl-3.0-later'),
  ('this library is distributed in the hope that it will be useful but without any warranty', 'X', 'lgpl-warranty'),
  ('licensed under the gnu lesser general public license version 2 1', 'Y', 'lgpl-2.1-short'),
  ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'Z', 'bsd-redistribution'),
  ('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'a', 'bsd-source'),
  ('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'b', 'bsd-binary'),
  ('all advertising materials mentioning features or use of this software must display the following acknowledgement', 'c', 'bsd-advertising'),
  ('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies', 'd', 'isc-grant'),
  ('permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies', 'e', 'isc-grant-and'),
  ('the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness', 'f', 'isc-as-is'),
  ('this source code form is subject to the terms of the mozilla public license v 2 0', 'g', 'mpl-2.0-form'),
  ('if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0', 'h', 'mpl-2.0-copy'),
  ('if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0', 'i', 'mpl-2.0-copy-http'),
  ('licensed under cc by 4 0', 'j', 'cc-by-4.0-short'),
  ('licensed under cc by sa 4 0', 'k', 'cc-by-sa-4.0-short'),
  ('licensed under cc by nc 4 0', 'l', 'cc-by-nc-4.0-short'),
  ('to the extent possible under law the author has waived all copyright and related or neighboring rights to this work', 'm', 'cc0-dedication'),
  ('this is free and unencumbered software released into the public domain', 'n', 'unlicense-domain'),
  ('this software is provided as is without any express or implied warranty', 'o', 'zlib-as-is'),
  ('permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions', 'p', 'zlib-grant'),
  ('distributed under the boost software license version 1 0', 'q', 'bsl-1.0-header'),
  ('all rights reserved', 'r', 'all-rights-reserved'),
  ('code is under the mit license', 't', 'mit-code'),
  ('this code is under the mit license', 'u', 'mit-this-code'),
  ('this project is licensed under the mit license', 'v', 'mit-project'),
  ('this software is released under the mit license', 'w', 'mit-software'),
  ('this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0', 'x', 'epl-2.0-header'),
  ('this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0', 'y', 'epl-2.0-header-v'),
  ('this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html', 'z', 'epl-1.0-header')
  UNION ALL SELECT 'spdx license identifier ' || regexp_replace(lower(id), '[^a-z0-9]+', ' ', 'g'), chr(CAST(1000 + n AS INT)), 'spdx-' || lower(id) FROM spdx),
slots(pattern, code, name) AS (VALUES
  ('^neither the name of( [a-z0-9]+){1,40} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission$', 's', 'bsd-no-endorsement'),
  ('^the names? of( [a-z0-9]+){1,40} (may|must) not be used to endorse or promote products derived from this software without (specific )?prior written permission$', '$', 'bsd-no-endorsement-name')),
marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
      replace(translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13) || chr(1), 'abcdefghijklmnopqrstuvwxyz' || chr(10) || ' '),
        'spdx-license-identifier:', 'spdx-license-identifier '),
      '([^a-z0-9]v)\.[ \t]*([0-9])', '\1 \2', 'g'), '\n[^a-z0-9]*\n', chr(1), 'g'), '[.!?;:]+([ \t\n]|\z)', chr(1), 'g') AS s
  FROM documents),
sentences AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, trim(unnest(parts), ' ' || chr(10)) AS sentence
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(s, '[^a-z0-9\n\x01]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), chr(1)) AS parts FROM marked)),
wholes AS (SELECT doc_id, i, sentence, replace(sentence, chr(10), ' ') AS norm FROM sentences WHERE sentence <> ''),
coded AS (SELECT wording AS w, code, name FROM known),
whole_hits AS (
  SELECT t.doc_id, t.i, k.code, k.name FROM wholes t JOIN coded k ON t.norm = k.w
  UNION ALL
  SELECT t.doc_id, t.i, p.code, p.name FROM wholes t JOIN slots p ON regexp_matches(t.norm, p.pattern)),
rest AS (
  SELECT t.doc_id, t.i, string_split(t.sentence, chr(10)) AS lines FROM wholes t
  WHERE contains(t.sentence, chr(10)) AND NOT EXISTS (SELECT 1 FROM whole_hits h WHERE h.doc_id IS NOT DISTINCT FROM t.doc_id AND h.i = t.i)),
starts AS (SELECT DISTINCT array_to_string(string_split(wording, ' ')[1:2], ' ') AS first_words FROM known),
firsts AS (SELECT doc_id, i, lines, generate_subscripts(lines, 1) AS j, unnest(lines) AS line FROM rest),
begun AS (
  SELECT * FROM firsts WHERE array_to_string(string_split(line, ' ')[1:2], ' ') IN (SELECT first_words FROM starts)
    OR array_to_string(string_split(line, ' ')[1:2], ' ') IN ('neither the', 'the name', 'the names')),
spans AS (SELECT doc_id, i, j, n, array_to_string(lines[j:j + n - 1], ' ') AS norm FROM (SELECT *, unnest(range(1, least(len(lines) - j + 1, 80) + 1)) AS n FROM begun)),
span_hits AS (
  SELECT s.doc_id, s.i, s.j, s.n, k.code, k.name FROM spans s JOIN coded k ON s.norm = k.w
  UNION ALL
  SELECT s.doc_id, s.i, s.j, s.n, p.code, p.name FROM spans s JOIN slots p ON regexp_matches(s.norm, p.pattern)),
longest AS (SELECT doc_id, i, j, arg_max(code, n) AS code, arg_max(name, n) AS name FROM span_hits GROUP BY doc_id, i, j),
hits AS (SELECT doc_id, i, 0 AS j, code, name FROM whole_hits UNION ALL SELECT doc_id, i, j, code, name FROM longest),
found AS (SELECT doc_id, string_agg(code, '' ORDER BY i, j) AS seq, string_agg(name, ',' ORDER BY i, j) AS names FROM hits GROUP BY doc_id),
matched AS (
  SELECT d.doc_id, coalesce(f.names, '') AS sentence_ids, regexp_extract_all(coalesce(f.seq, ''), 'BCDEF|BC|ACDE|AC|CDE|IJK|IJ|I|OPT|OQT|ORT|OST|UVX|UWX|P|Q|R|S|V|W|Zabc|Zabs|Zs|Zab\$|Z\$|Zab|Z|df|d|ef|e|gh|gi|g|op|p|B|A|G|H|L|M|N|Y|j|k|l|m|n|q|t|u|v|w|x|y|z|[\x{03E8}-\x{04E7}]') AS h
  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id)
SELECT doc_id, sentence_ids,
  array_to_string(list_sort(list_distinct(list_transform(h, lambda m: CASE m
    WHEN 'BCDEF' THEN 'Apache-2.0'
    WHEN 'BC' THEN 'Apache-2.0'
    WHEN 'ACDE' THEN 'Apache-2.0'
    WHEN 'AC' THEN 'Apache-2.0'
    WHEN 'CDE' THEN 'Apache-2.0'
    WHEN 'IJK' THEN 'MIT'
    WHEN 'IJ' THEN 'MIT'
    WHEN 'I' THEN 'MIT'
    WHEN 'OPT' THEN 'GPL-3.0-or-later'
    WHEN 'OQT' THEN 'GPL-2.0-or-later'
    WHEN 'ORT' THEN 'GPL-2.0-only'
    WHEN 'OST' THEN 'AGPL-3.0-or-later'
    WHEN 'UVX' THEN 'LGPL-2.1-or-later'
    WHEN 'UWX' THEN 'LGPL-3.0-or-later'
    WHEN 'P' THEN 'GPL-3.0-or-later'
    WHEN 'Q' THEN 'GPL-2.0-or-later'
    WHEN 'R' THEN 'GPL-2.0-only'
    WHEN 'S' THEN 'AGPL-3.0-or-later'
    WHEN 'V' THEN 'LGPL-2.1-or-later'
    WHEN 'W' THEN 'LGPL-3.0-or-later'
    WHEN 'Zabc' THEN 'BSD-4-Clause'
    WHEN 'Zabs' THEN 'BSD-3-Clause'
    WHEN 'Zs' THEN 'BSD-3-Clause'
    WHEN 'Zab$' THEN 'BSD-3-Clause'
    WHEN 'Z$' THEN 'BSD-3-Clause'
    WHEN 'Zab' THEN 'BSD-2-Clause'
    WHEN 'Z' THEN 'BSD-2-Clause'
    WHEN 'df' THEN 'ISC'
    WHEN 'd' THEN 'ISC'
    WHEN 'ef' THEN 'ISC'
    WHEN 'e' THEN 'ISC'
    WHEN 'gh' THEN 'MPL-2.0'
    WHEN 'gi' THEN 'MPL-2.0'
    WHEN 'g' THEN 'MPL-2.0'
    WHEN 'op' THEN 'Zlib'
    WHEN 'p' THEN 'Zlib'
    WHEN 'B' THEN 'Apache-2.0'
    WHEN 'A' THEN 'Apache-2.0'
    WHEN 'G' THEN 'MIT'
    WHEN 'H' THEN 'MIT'
    WHEN 'L' THEN 'GPL-3.0'
    WHEN 'M' THEN 'GPL-3.0'
    WHEN 'N' THEN 'GPL-2.0'
    WHEN 'Y' THEN 'LGPL-2.1'
    WHEN 'j' THEN 'CC-BY-4.0'
    WHEN 'k' THEN 'CC-BY-SA-4.0'
    WHEN 'l' THEN 'CC-BY-NC-4.0'
    WHEN 'm' THEN 'CC0-1.0'
    WHEN 'n' THEN 'Unlicense'
    WHEN 'q' THEN 'BSL-1.0'
    WHEN 't' THEN 'MIT'
    WHEN 'u' THEN 'MIT'
    WHEN 'v' THEN 'MIT'
    WHEN 'w' THEN 'MIT'
    WHEN 'x' THEN 'EPL-2.0'
    WHEN 'y' THEN 'EPL-2.0'
    WHEN 'z' THEN 'EPL-1.0'
    ELSE string_split(':spdx', ' ')[unicode(m) - 1000] END))), ',') AS licenses,
  CAST(len(h) AS BIGINT) AS n_licenses
FROM matched
""".replace(":spdx", " ".join(SPDX))
