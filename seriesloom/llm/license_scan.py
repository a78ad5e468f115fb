"""License detection by ordered signature rules, with DataFrame functions only.

Every rule has a label, a keyword and a pattern: ``FAMILIES`` are names of licenses,
which may stand in several forms (tag, grant, heading, bare name), ``CLAUSES`` are
sentences of license texts. A text is looked at only if its lower-case form has a
keyword, and a rule's pattern is tried only if the text has the rule's. Patterns
match the normalised text: words of letters, digits and non-ASCII characters, A-Z
lower-cased, with single spaces.

A detection is an interval of words. Longer ones come first: of detections of
which one holds the other, the longer stays; of equal intervals the one with the
smaller priority, then the earlier rule. Detections that only overlap both
stay. The base phrases are counted besides, all of their places.

Detections are rows, placed and suppressed by windows over the rows of one text, so
a long text costs in proportion to its length. Repeated rows are scanned one by one.

Null and empty texts have no words, no labels and score 0. Columns other than id
and text, of any name, are not looked at, and an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase and label of the base rules.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Form, priority, confidence, and what stands before the name. Signatures are all forms of all families.
FORMS = (
    ("tag", 1, 1.0, r"spdx license identifier "),
    ("grant", 2, 0.9, r"(?:licen[sc]ed|released|distributed|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"),
    ("subject", 3, 0.85, r"(?:subject to|governed by|covered by|according to|in accordance with|pursuant to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"),
    ("heading", 4, 0.8, r"(?:license|licence|copying|copyright) (?:is |type |name |notice )?(?:the )?"),
    ("name", 5, 0.6, r""),
)

#: Label, keyword that the text must have, names. The usual names of these licenses.
FAMILIES = (
    ("agpl-3.0", "affero", r"gnu affero general public license(?: v(?:ersion)? ?3(?: 0)?| 3(?: 0)?)?"),
    ("agpl", "agpl", r"agpl(?: ?v?3)?(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "public license", r"gnu general public license(?: gpl)? v(?:ersion)? ?1(?: 0)?"),
    ("gpl-2.0", "public license", r"gnu general public license(?: gpl)? v(?:ersion)? ?2(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
    ("gpl-3.0", "public license", r"gnu general public license(?: gpl)? v(?:ersion)? ?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
    ("gpl", "public license", r"gnu general public license"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "lesser", r"gnu (?:lesser|library) general public license v(?:ersion)? ?2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license v(?:ersion)? ?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license v(?:ersion)? ?3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public license"),
    ("lgpl", "library general", r"gnu library general public license"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23])?(?: [01])?(?: only| or later)?"),
    ("gfdl", "documentation license", r"gnu free documentation license(?: v(?:ersion)? ?1(?: [0-3])?)?"),
    ("apache-1.0", "apache", r"apache (?:software )?license v(?:ersion)? ?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license v(?:ersion)? ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license v(?:ersion)? ?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache(?: license)? 2(?: 0)?"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit", r"mit licen[sc]e"),
    ("mit", "mit", r"mit x11 license"),
    ("mit", "expat", r"expat license"),
    ("mit-0", "mit", r"mit (?:no attribution|0) license"),
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("x11", "x11", r"x11 license"),
    ("bsd-1-clause", "bsd", r"(?:bsd )?1 clause bsd(?: license)?|bsd 1 clause(?: license)?"),
    ("bsd-2-clause", "bsd", r"2 clause bsd(?: license)?|bsd 2 clause(?: license)?|simplified bsd license|freebsd license"),
    ("bsd-3-clause", "bsd", r"3 clause bsd(?: license)?|bsd 3 clause(?: license)?|(?:new|modified|revised) bsd license"),
    ("bsd-4-clause", "bsd", r"4 clause bsd(?: license)?|bsd 4 clause(?: license)?|(?:original|old) bsd license"),
    ("bsd", "bsd", r"bsd (?:style )?license"),
    ("0bsd", "bsd", r"0bsd|zero clause bsd(?: license)?|bsd zero clause(?: license)?"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-1.0", "mozilla", r"mozilla public license v(?:ersion)? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license v(?:ersion)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license v(?:ersion)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2.0", "mpl", r"mpl ?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license v(?:ersion)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license v(?:ersion)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("edl", "eclipse", r"eclipse distribution license(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("cddl", "development and distribution", r"common development and distribution license(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cpl", "common public", r"common public license(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("ipl", "ibm public", r"ibm public license(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("eupl", "union public", r"european union public licen[sc]e(?: v(?:ersion)? ?1 [0-2])?"),
    ("eupl", "eupl", r"eupl(?: ?v?1 [0-2])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("artistic-1.0", "artistic", r"artistic license 1(?: 0)?|artistic 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license 2(?: 0)?|artistic 2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("isc", "isc", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license"),
    ("openssl", "openssl", r"openssl license"),
    ("php", "php", r"php license(?: v(?:ersion)? ?3(?: 0?1)?)?"),
    ("psf", "python software", r"python software foundation license(?: v(?:ersion)? ?2)?"),
    ("ruby", "ruby", r"ruby license"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("ofl", "font license", r"sil open font license(?: v(?:ersion)? ?1 [01])?"),
    ("odbl", "database license", r"open (?:data commons open )?database license(?: v?1 0)?"),
    ("odc-by", "data commons", r"open data commons attribution license(?: v?1 0)?"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and license(?: v?1 0)?"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v(?:ersion)? ?2)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl", "permissive license", r"universal permissive license(?: v?1 0)?"),
    ("afl", "academic free", r"academic free license(?: v(?:ersion)? ?[1-3](?: [0-2])?)?"),
    ("osl", "open software", r"open software license(?: v(?:ersion)? ?[1-3](?: [0-2])?)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("apsl", "apple public", r"apple public source license(?: v(?:ersion)? ?[12](?: [0-2])?)?"),
    ("json", "json", r"json license"),
    ("busl", "business source", r"business source license(?: v?1 1)?"),
    ("sspl", "server side", r"server side public license(?: v(?:ersion)? ?1)?"),
    ("elastic", "elastic", r"elastic license(?: v?2(?: 0)?)?"),
    ("commons-clause", "commons clause", r"commons clause(?: license)?"),
    ("llama", "llama", r"llama [234](?: [0-9])? community license(?: agreement)?"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: ?m)?(?: license)?"),
    ("public-domain", "public domain", r"(?:dedicated to|placed in(?:to)?|released (?:in)?to|in) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|license)"),
)


#: Label, keyword that the text must have, sentence. Sentences of these licenses' texts and notices.
CLAUSES = (
    ("mit", "hereby", r"to deal in the software without restriction including without limitation the rights to use copy modify merge"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "warranties", r"the software is provided as is and the author disclaims all warranties"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:without fee )?is hereby granted"),
    ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|other) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", "liable", r"in no event shall the copyright (?:holder|owner)s? or contributors be liable"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "licen", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "licen", r"see the license for the specific language governing permissions and limitations"),
    ("apache-1.1", "redistribution", r"the end user documentation included with the redistribution if any must include"),
    ("apache-1.0", "apache", r"this product includes software developed by the apache (?:group|software foundation)"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "licen", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "licen", r"either version 3 of the license or at your option any later version"),
    ("gpl", "warranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "public license", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "foundation", r"write to the free software foundation"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1", "licen", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "development and distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc", "creative commons", r"this work is licensed under (?:a |the )?creative commons"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "distribute", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "public license", r"do what the f\S+ you want to public license"),
    ("ofl", "font software", r"this font software is licensed under the sil open font license"),
    ("beerware", "beer", r"beer ?ware license|as long as you retain this notice you can do whatever you want with this stuff"),
    ("psf", "licensee", r"psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("proprietary", "prohibited", r"unauthorized copying of this file (?:via any medium )?is strictly prohibited"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "trade secret", r"(?:contains|is) (?:a )?(?:valuable )?trade secrets?"),
    ("non-commercial", "commercial use", r"for (?:personal and )?non ?commercial use only"),
    ("non-commercial", "personal use", r"for personal use only"),
    ("research-only", "research", r"for (?:academic and )?(?:non commercial )?research purposes only"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("unicode", "unicode", r"unicode (?:inc )?(?:data files and software )?license(?: agreement)?"),
    ("vim", "licen", r"vim license"),
    ("curl", "licen", r"curl license"),
    ("ecl", "educational", r"educational community license(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("lppl", "latex", r"latex project public license(?: v(?:ersion)? ?1(?: [0-3]c?)?)?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)(?: v(?:ersion)? ?[12])?"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: v?[12] [01])?"),
    ("ogl", "licen", r"open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("etalab", "licence", r"licence ouverte(?: etalab)?"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?"),
    ("cdla", "licen", r"community data license agreement(?: permissive| sharing)?(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("nasa", "nasa", r"nasa open source agreement(?: v(?:ersion)? ?1 3)?"),
    ("nokia", "nokia", r"nokia open source license"),
    ("sleepycat", "sleepycat", r"sleepycat license"),
    ("spl", "licen", r"sun (?:industry standards source|public) license"),
    ("watcom", "watcom", r"(?:sybase )?open watcom public license"),
    ("w3c", "w3c", r"w3c software (?:notice and |and document notice and )?license"),
    ("zpl", "zope", r"zope public license(?: v(?:ersion)? ?2 [01])?"),
    ("qpl", "public license", r"q public license"),
    ("rpl", "public license", r"reciprocal public license(?: v(?:ersion)? ?1 [15])?"),
    ("fair", "licen", r"fair license"),
    ("efl", "eiffel", r"eiffel forum license(?: v(?:ersion)? ?2)?"),
    ("lpl", "lucent", r"lucent public license(?: v(?:ersion)? ?1 0?2?)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license"),
    ("parity", "public license", r"parity public license"),
    ("prosperity", "public license", r"prosperity public license"),
    ("hippocratic", "hippocratic", r"hippocratic license"),
    ("anti-996", "996", r"anti 996 license"),
    ("confluent", "confluent", r"confluent community license"),
    ("rsal", "redis", r"redis source available license(?: v(?:ersion)? ?2)?"),
    ("fsl", "licen", r"functional source license"),
    ("rail", "licen", r"responsible ai license|bigscience (?:bloom )?rail license"),
    ("gemma", "gemma", r"gemma terms of use"),
)
#: Priority and confidence of a sentence.
CLAUSE = (0, 0.95)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rules() -> Column:
    """All rules, in order, as one array of structs; pattern is a name's with its forms."""
    forms = "|".join(before for _, _, _, before in FORMS if before)
    rules = [(label, keyword, names, f" (?:{forms})?(?:{names})(?= )", True) for label, keyword, names in FAMILIES]
    rules += [(label, keyword, names, f" (?:{names})(?= )", False) for label, keyword, names in CLAUSES]
    fields = ("label", "keyword", "names", "pattern", "named")
    return F.array(*[F.struct(F.lit(k).alias("number"), *[F.lit(x).alias(f) for f, x in zip(fields, r, strict=True)]) for k, r in enumerate(rules)])


def _detections(rows: DataFrame) -> DataFrame:
    """Each row once for every detection that no other one of its text holds, with ``found`` (start, stop, label,
    confidence); once with a null where there is none. Words count from 0, stop is excluded."""
    kept = [c for c in rows.columns if c != "norm"]
    tried = F.filter(_rules(), lambda r: F.contains(F.col("norm"), r["keyword"]))
    rows = rows.select(*kept, "norm", F.explode_outer(F.when(F.col("norm").isNotNull(), tried)).alias("rule"))
    hits, between = F.regexp_extract_all("norm", F.col("rule.pattern"), F.lit(0)), F.split("norm", F.col("rule.pattern"))
    rows = rows.select(*kept, "rule", F.posexplode_outer(F.when(F.regexp_like("norm", F.col("rule.pattern")), F.arrays_zip(hits.alias("hit"), F.slice(between, 1, F.size(hits)).alias("before")))).alias("k", "x"))
    before, long = _spaces(F.col("x.before")), _spaces(F.col("x.hit"))
    form = [F.when(F.rlike("x.hit", F.concat(F.lit(f"^ (?:{p})(?:"), "rule.names", F.lit(")$"))), F.lit(n)) for n, (_, _, _, p) in enumerate(FORMS)]
    rows = rows.select(*kept, F.col("rule.number").alias("number"), F.col("rule.label").alias("label"), "k", before.alias("before"), long.alias("long"), F.when(F.col("rule.named"), F.coalesce(*form, F.lit(len(FORMS) - 1))).otherwise(-1).alias("form"))
    rows = rows.withColumn("number", F.when(F.col("k").isNotNull(), F.col("number")))
    stop = F.sum(F.col("before") + F.col("long")).over(Window.partitionBy("row", "number").orderBy("k"))
    priority = F.element_at(F.array(F.lit(CLAUSE[0]), *[F.lit(p) for _, p, _, _ in FORMS]), F.col("form") + 2)
    confidence = F.element_at(F.array(F.lit(CLAUSE[1]), *[F.lit(c) for _, _, c, _ in FORMS]), F.col("form") + 2)
    rows = rows.select(*kept, "number", "label", stop.alias("stop"), (stop - F.col("long")).alias("start"), priority.alias("priority"), confidence.alias("confidence"))
    # What came before in this order and reaches as far holds the detection.
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "number")
    held = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("stop"), F.lit(False))
    found = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "label", "confidence")
    return rows.select(*kept, F.when(F.col("number").isNotNull() & ~held, found).alias("found"))


#: Keywords that stand inside many words; their families' names also match this.
SHORT = ("mit", "cc", "isc", "php", "perl", "rail", "ruby", "json", "mpl")
_SHORT_NAMES = r"(?<![a-z0-9])(?:cc[^a-z0-9]+by|mpl|open[^a-z0-9]*rail|same[^a-z0-9]+terms)"


def _gate(lower: Column) -> Column:
    """Whether a lower-case text may have a name of a family. Between the words of a keyword may stand anything that the
    normalised text has a space for; its first word is looked for before."""
    loose = sorted({k for _, k, _ in FAMILIES + CLAUSES if k not in SHORT and "licen" not in k})
    several = [lower.contains(k.split(" ")[0]) & lower.rlike(k.replace(" ", _BETWEEN)) for k in loose if " " in k]
    short = _any([lower.contains(k) for k in ("cc", "mpl", "rail", "terms")]) & lower.rlike(_SHORT_NAMES)
    return _any([lower.contains("licen"), *[lower.contains(k) for k in loose if " " not in k], *several, short])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row."""
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    gate = _gate(F.lower("text"))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    joined = F.array_join(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), " ")
    norm = F.when(F.col("text").isNotNull(), F.concat(F.lit(" "), F.translate(joined, _UPPER, _LOWER), F.lit(" ")))
    rows = rows.select("doc_id", "n_words", norm.alias("norm"))
    n = F.col("norm")

    base = "|".join(p for p, _ in BASE)
    parts = F.split(n, f" (?=(?:{base}) )")
    places = F.size(parts) - 1
    some = places > 0
    labels = F.array_compact(F.array(*[F.when(n.contains(f" {p} "), F.lit(x)) for p, x in BASE]))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.when(some, places).otherwise(0).cast("bigint").alias("n_base"),
        F.when(some, _spaces(F.get(parts, F.lit(0)))).cast("bigint").alias("first_word"),
        F.when(some, F.col("n_words") - _spaces(F.element_at(parts, -1))).cast("bigint").alias("last_word"),
        F.array_join(F.when(some, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")), ",").alias("base_labels"),
        "norm",
    )
    kept = [c for c in rows.columns if c != "norm"]
    each = _detections(rows).groupBy(*kept).agg(F.array_sort(F.collect_list("found")).alias("found"))  # nulls are not collected
    names = F.concat(F.transform("found", lambda d: d["label"]), F.filter(F.split("base_labels", ","), lambda x: x != ""))
    best = F.array_max(F.concat(F.transform("found", lambda d: d["confidence"]), F.when(F.col("n_base") > 0, F.array(F.lit(FORMS[-1][2]))).otherwise(F.array().cast("array<double>"))))
    return each.select(
        *kept[1:],
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.transform("found", lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["label"].alias("label"))).alias("detections"),
    )
