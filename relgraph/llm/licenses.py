"""License scans by ordered signature rules, in Spark expressions only.

A text is brought to words (A to Z lower-cased; runs of ASCII letters, digits and all that is not ASCII), and a keyword
prefilter passes over texts without any rule's keyword. In the others every place of a keyword becomes a row with the words
before and after it; a broadcast join gives it the rules of that keyword, and each rule's regex is tried at the one place where
its match would begin. So the work follows the places of keywords, not texts times rules, and no text is ever shuffled: only
those short rows are.

Rules have a class: lower classes come first. Of overlapping detections one that lies within another is suppressed if the
other's class comes first, or the class is the same and the other is longer, or the place is the same too and the other rule
stands earlier in the table. Windows over a document's detections find that by running maxima of ends, without comparing
pairs. The base phrases are rules of class 0; they suppress others and are never suppressed.

Defined results: a null or empty text has 0 words and no label; a text of separators only likewise; a document without
detections has empty labels and score 0; repeated rows are documents each; an empty table gives an empty result; columns
besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, read

#: Words a match may have at most, and words it may begin before its keyword: bounds of the rules below.
REACH, LEAD = 24, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, with upper-case letters still in place.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Score of a detection by class: base phrases, machine-readable tags, grants, clauses of a license's text, titles, mentions.
SCORES = (1.0, 1.0, 0.95, 0.9, 0.75, 0.4)

#: The phrases of the contract: fixed values. ``label|keyword|words before the keyword|regex``.
BASE = """
mit|mit|2|under the mit license
apache-2|apache|0|apache license version 2
cc-by-nc|cc|0|cc by nc
"""

#: Identifiers as machine-readable tags give them, in words: ``label|identifier``.
TAGS = """
0bsd|0bsd
afl-3|afl 3 0
agpl-1|agpl 1 0
agpl-3|agpl 3 0( only| or later)?
apache-1|apache 1 [01]
apache-2|apache 2 0
apsl-2|apsl 2 0
artistic-1|artistic 1 0( perl| cl8)?
artistic-2|artistic 2 0
beerware|beerware
blueoak-1|blueoak 1 0 0
bsd-1|bsd 1 clause
bsd-2|bsd 2 clause( patent| views)?
bsd-3|bsd 3 clause( clear| lbnl)?
bsd-4|bsd 4 clause
bsl-1|bsl 1 0
busl-1|busl 1 1
bzip2|bzip2 1 0 6
cc0-1|cc0 1 0
cc-by|cc by [1-4] [05]
cc-by-nc|cc by nc [1-4] [05]
cc-by-nc-nd|cc by nc nd [1-4] [05]
cc-by-nc-sa|cc by nc sa [1-4] [05]
cc-by-nd|cc by nd [1-4] [05]
cc-by-sa|cc by sa [1-4] [05]
cddl-1|cddl 1 [01]
cecill-2|cecill 2 [01]
cecill-b|cecill b
cecill-c|cecill c
cern-ohl|cern ohl [psw] 2 0
cpal-1|cpal 1 0
cpl-1|cpl 1 0
ecl-2|ecl 2 0
elastic-2|elastic 2 0
epl-1|epl 1 0
epl-2|epl 2 0
eupl-1|eupl 1 [12]
fsfap|fsfap
ftl|ftl
gfdl|gfdl 1 [123]( only| or later)?
gpl-1|gpl 1 0( only| or later)?
gpl-2|gpl 2 0( only| or later)?
gpl-3|gpl 3 0( only| or later)?
hpnd|hpnd
icu|icu
ijg|ijg
ipl-1|ipl 1 0
isc|isc
jasper-2|jasper 2 0
lgpl-2|lgpl 2 [01]( only| or later)?
lgpl-3|lgpl 3 0( only| or later)?
libpng|libpng( 2 0)?
lppl|lppl 1 (0|1|2|3a|3c)
mit|mit
mit-0|mit 0
mpl-1|mpl 1 [01]
mpl-2|mpl 2 0( no copyleft exception)?
ms-pl|ms pl
ms-rl|ms rl
mulanpsl-2|mulanpsl 2 0
ncsa|ncsa
odbl-1|odbl 1 0
odc-by-1|odc by 1 0
ofl-1|ofl 1 [01]
openssl|openssl
osl-3|osl 3 0
php-3|php 3 0?1?
postgresql|postgresql
psf-2|psf 2 0
python-2|python 2 0
qpl-1|qpl 1 0
ruby|ruby
sspl-1|sspl 1 0
sleepycat|sleepycat
tcl|tcl
unicode|unicode (dfs 2016|3 0)
unlicense|unlicense
upl-1|upl 1 0
vim|vim
w3c|w3c
wtfpl|wtfpl
x11|x11
zlib|zlib
zpl-2|zpl 2 [01]
"""

#: Names of licenses in prose: ``label|keyword|words before the keyword|regex``. Each is a title of its own and, with a verb
#: of granting before it, a grant.
NAMES = """
afl-3|academic|0|academic free licen[cs]e( version| v)? ?3( 0)?
agpl-3|affero|1|gnu affero general public licen[cs]e( version| v)? ?v?3( 0)?
agpl-3|agpl|0|agpl ?v?3( 0)?
agpl-3|agplv3|0|agplv3
agpl|affero|1|gnu affero general public licen[cs]e
agpl|affero|0|affero (general public licen[cs]e|gpl)
apache-1|apache|0|apache (software )?licen[cs]e (version |v )?1( [01])?
apache-2|apache|0|apache (software )?licen[cs]e (version |v )?2( 0)?
apache-2|apache|0|apache 2( 0)?( licen[cs]e)?
apache-2|apache|0|apache licen[cs]e v2( 0)?
apache|apache|0|apache (software )?licen[cs]e
artistic-1|artistic|0|artistic licen[cs]e (version |v )?1( 0)?
artistic-2|artistic|0|artistic licen[cs]e (version |v )?2( 0)?
artistic|artistic|0|artistic licen[cs]e
beerware|beer|0|beer ware licen[cs]e
boost-1|boost|0|boost software licen[cs]e( version)?( 1( 0)?)?
bsd-2|bsd|0|bsd (2|two) clause( licen[cs]e)?
bsd-2|bsd|2|(2|two) clause bsd( licen[cs]e)?
bsd-2|simplified|0|simplified bsd( licen[cs]e)?
bsd-2|freebsd|0|freebsd licen[cs]e
bsd-3|bsd|0|bsd (3|three) clause( licen[cs]e)?
bsd-3|bsd|2|(3|three) clause bsd( licen[cs]e)?
bsd-3|bsd|1|(new|modified|revised) bsd( licen[cs]e)?
bsd-4|bsd|0|bsd (4|four) clause( licen[cs]e)?
bsd-4|bsd|2|(4|four) clause bsd( licen[cs]e)?
bsd-4|bsd|1|(original|old) bsd( licen[cs]e)?
bsd|bsd|0|bsd (style )?licen[cs]e
busl-1|business|0|business source licen[cs]e( 1 1)?
cc0-1|cc0|0|cc0( 1 0)?( universal)?
cc0-1|creative|0|creative commons (cc0|zero)( 1 0)?( universal)?
cc-by|creative|0|creative commons attribution( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-nc|creative|0|creative commons attribution non ?commercial( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-nc-nd|creative|0|creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-nc-sa|creative|0|creative commons attribution non ?commercial share ?alike( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-nd|creative|0|creative commons attribution no ?deriv(ative)?s?( works)?( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-sa|creative|0|creative commons attribution share ?alike( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
cc-by-nc-nd|cc|0|cc by nc nd( [1-4] [05])?
cc-by-nc-sa|cc|0|cc by nc sa( [1-4] [05])?
cc-by-nc|cc|0|cc by nc( [1-4] [05])?
cc-by-nd|cc|0|cc by nd( [1-4] [05])?
cc-by-sa|cc|0|cc by sa( [1-4] [05])?
cc-by|cc|0|cc by( [1-4] [05])?
cddl-1|cddl|0|cddl( (version |v )?1( [01])?)?
cddl-1|distribution|3|common development and distribution licen[cs]e( (version |v )?1( [01])?)?
cecill|cecill|0|cecill( [bc]| v?2( [01])?)?( free software)? licen[cs]e( agreement)?
cpl-1|common|0|common public licen[cs]e( (version |v )?1( 0)?)?
elastic-2|elastic|0|elastic licen[cs]e( (version |v )?2( 0)?)?
epl-1|eclipse|0|eclipse public licen[cs]e (version |v ?)?1( 0)?
epl-2|eclipse|0|eclipse public licen[cs]e (version |v ?)?2( 0)?
epl|eclipse|0|eclipse public licen[cs]e
eclipse-edl|eclipse|0|eclipse distribution licen[cs]e( (version |v ?)?1( 0)?)?
eupl-1|european|0|european union public licen[cs]e( (version |v ?)?1( [012])?)?
freetype|freetype|0|freetype (project )?licen[cs]e
gfdl|gnu|0|gnu free documentation licen[cs]e( (version |v ?)?1( [123])?)?
gpl-2|gnu|0|gnu (general public licen[cs]e|gpl) (version |v ?)?2( 0)?( only| or( any)? later)?
gpl-2|gpl|0|gpl ?(version |v ?)?2( 0)?( only| or( any)? later)?
gpl-2|gplv2|0|gplv2
gpl-3|gnu|0|gnu (general public licen[cs]e|gpl) (version |v ?)?3( 0)?( only| or( any)? later)?
gpl-3|gpl|0|gpl ?(version |v ?)?3( 0)?( only| or( any)? later)?
gpl-3|gplv3|0|gplv3
gpl|gnu|0|gnu (general public licen[cs]e|gpl)
gpl|general|0|general public licen[cs]e
ijg|independent|0|independent jpeg group( s)? licen[cs]e
isc|isc|0|isc licen[cs]e
lgpl-2|gnu|0|gnu (lesser|library) (general public licen[cs]e|gpl) (version |v ?)?2( [01])?( only| or( any)? later)?
lgpl-2|lgpl|0|lgpl ?(version |v ?)?2( [01])?( only| or( any)? later)?
lgpl-3|gnu|0|gnu lesser (general public licen[cs]e|gpl) (version |v ?)?3( 0)?( only| or( any)? later)?
lgpl-3|lgpl|0|lgpl ?(version |v ?)?3( 0)?( only| or( any)? later)?
lgpl|gnu|0|gnu (lesser|library) (general public licen[cs]e|gpl)
lgpl|lesser|0|lesser general public licen[cs]e
libpng|libpng|0|libpng licen[cs]e
lppl|latex|0|latex project public licen[cs]e( (version |v ?)?1( [0123][ac]?)?)?
mit|mit|0|mit (style )?licen[cs]e
mit|expat|0|expat licen[cs]e
mpl-1|mozilla|0|mozilla public licen[cs]e (version |v ?)?1( [01])?
mpl-2|mozilla|0|mozilla public licen[cs]e (version |v ?)?2( 0)?
mpl-2|mpl|0|mpl ?v?2( 0)?
mpl|mozilla|0|mozilla public licen[cs]e
ms-pl|microsoft|0|microsoft public licen[cs]e
ms-rl|microsoft|0|microsoft reciprocal licen[cs]e
mulanpsl-2|mulan|0|mulan (psl|permissive software licen[cs]e)( v?2)?
ncsa|ncsa|0|ncsa (open source )?licen[cs]e
odbl-1|database|1|open database licen[cs]e( (version |v ?)?1( 0)?)?
odc-by-1|commons|2|open data commons attribution licen[cs]e
ofl-1|sil|0|sil open font licen[cs]e( (version |v ?)?1( [01])?)?
ogl-uk|government|1|open government licen[cs]e( (version |v ?)?[123]( 0)?)?
openssl|openssl|0|openssl licen[cs]e
osl-3|software|1|open software licen[cs]e (version |v ?)?3( 0)?
php-3|php|0|php licen[cs]e( (version |v ?)?3( 0?1)?)?
postgresql|postgresql|0|postgresql licen[cs]e
psf-2|python|0|python software foundation licen[cs]e( (version |v ?)?2( 0)?)?
public-domain|domain|1|public domain dedication
qpl-1|q|0|q public licen[cs]e( (version |v ?)?1( 0)?)?
ruby|ruby|0|ruby licen[cs]e
sspl-1|server|0|server side public licen[cs]e( (version |v ?)?1)?
sleepycat|sleepycat|0|sleepycat licen[cs]e
unicode|unicode|0|unicode licen[cs]e( agreement)?( v?3)?
unlicense|unlicense|0|unlicense
upl-1|universal|0|universal permissive licen[cs]e( (version |v ?)?1( 0)?)?
vim|vim|0|vim licen[cs]e
w3c|w3c|0|w3c software( notice and)?( and document)? licen[cs]e
wtfpl|wtfpl|0|wtfpl
wtfpl|fuck|3|do what the fuck you want to public licen[cs]e
x11|x11|0|x11 licen[cs]e
zlib|zlib|0|zlib( libpng)? licen[cs]e
zpl-2|zope|0|zope public licen[cs]e( (version |v ?)?2( [01])?)?
proprietary|eula|0|eula
proprietary|license|2|end user license agreement
"""

#: Clauses from the texts of licenses, and notices that name none: ``label|keyword|words before the keyword|regex``.
CLAUSES = """
mit|hereby|2|permission is hereby granted free of charge to any person obtaining a copy
mit|noninfringement|6|fitness for a particular purpose and noninfringement
isc|permission|0|permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd|permission|0|permission to use copy modify and distribute this software and its documentation for any purpose
bsd|redistribution|0|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions|0|redistributions of source code must retain the above copyright notice
bsd|redistributions|0|redistributions in binary form must reproduce the above copyright notice
bsd-3|endorse|8|names? of its contributors may be used to endorse or promote products
bsd-3|endorse|0|endorse or promote products derived from this software without specific prior written permission
bsd-4|advertising|1|all advertising materials mentioning features or use of this software must display
gpl|redistribute|7|this program is free software you can redistribute it and or modify it
gpl|redistribute|4|free software you can redistribute it and or modify it
gpl|library|1|this library is free software you can redistribute it
gpl|copyleft|0|copyleft licen[cs]e for software
lgpl|lesser|4|terms of the gnu lesser general public licen[cs]e
apache-2|compliance|8|you may not use this file except in compliance with the licen[cs]e
apache-2|compliance|0|compliance with the licen[cs]e you may obtain a copy of the licen[cs]e
apache-2|warranties|2|basis without warranties or conditions of any kind either express or implied
mpl-2|mozilla|6|subject to the terms of the mozilla public licen[cs]e
mpl-2|incompatible|0|incompatible with secondary licen[cs]es
epl|accompanying|1|the accompanying materials are made available under the terms of the eclipse public licen[cs]e
zlib|misrepresented|7|origin of this software must not be misrepresented
zlib|plainly|5|altered source versions must be plainly marked as such
boost-1|executing|0|executing or having executed in object code
unlicense|unencumbered|4|this is free and unencumbered software released into the public domain
cc0-1|waive|0|waive all copyright and related or neighboring rights
cc0-1|dedicated|0|dedicated (the work|this work|all copyright) to the public domain
public-domain|domain|4|(released|placed) (into|in) the public domain
public-domain|domain|5|is (released|placed) (into|in) the public domain
public-domain|dedicated|0|dedicated to the public domain
wtfpl|fuck|5|you just do what the fuck you want to
beerware|beer|5|you can buy me a beer in return
ofl-1|font|1|the font software may be sold as part of a larger software package
ofl-1|reserved|0|reserved font name
cc|creativecommons|0|creativecommons org licen[cs]es [a-z]+( nc| sa| nd)*( [1-4] [05])?
cc-by|creativecommons|0|creativecommons org licen[cs]es by [1-4] [05]
cc-by-sa|creativecommons|0|creativecommons org licen[cs]es by sa [1-4] [05]
cc-by-nc|creativecommons|0|creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nd|creativecommons|0|creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-nc-sa|creativecommons|0|creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nc-nd|creativecommons|0|creativecommons org licen[cs]es by nc nd [1-4] [05]
cc0-1|creativecommons|0|creativecommons org publicdomain zero 1 0
apache-2|apache|1|www apache org licen[cs]es licen[cs]e 2 0
gpl|gnu|1|www gnu org licen[cs]es gpl
gpl-2|gnu|1|www gnu org licen[cs]es( old licen[cs]es)? gpl 2 0
gpl-3|gnu|1|www gnu org licen[cs]es gpl 3 0
lgpl|gnu|1|www gnu org licen[cs]es lgpl
agpl|gnu|1|www gnu org licen[cs]es agpl
mit|opensource|0|opensource org licen[cs]es? mit
bsd-2|opensource|0|opensource org licen[cs]es? bsd 2 clause
bsd-3|opensource|0|opensource org licen[cs]es? bsd 3 clause
mpl-2|mozilla|0|mozilla org (en us )?mpl 2 0
epl-2|eclipse|0|eclipse org legal epl (2 0|v20)
proprietary|unauthorized|0|unauthorized (copying|use|reproduction|distribution) of this (file|software|document|material)
proprietary|confidential|0|confidential and proprietary
proprietary|confidential|2|proprietary and confidential
proprietary|reserved|2|all rights reserved
proprietary|redistributed|3|may not be redistributed
proprietary|consent|3|without prior written consent of the (author|copyright holder|owner|publisher)
non-commercial|noncommercial|1|for noncommercial (use|purposes) only
non-commercial|commercial|2|for non commercial (use|purposes)( only)?
non-commercial|commercial|2|not for commercial (use|purposes)
research-only|research|1|for research (use|purposes) only
personal-use|personal|1|for personal use only
"""

#: Words of granting that may stand before a name, each a keyword.
VERBS = ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "redistributed", "covered")
_GRANT = "under( the)?( terms of( the)?)?"


def _lines(table: str) -> list[list[str]]:
    return [line.split("|", 3) for line in table.strip().splitlines()]


def rules() -> list[tuple[int, str, int, str, str, int]]:
    """``rule, keyword, lead, pattern, label, class`` in order: a lower number goes before a higher one of its class. Grants of
    a name are one rule with all verbs but for the keyword, which is the verb itself."""
    found = [(word, int(lead), pattern, label, 0) for label, word, lead, pattern in _lines(BASE)]
    found += [("spdx", 0, f"spdx licen[cs]e identifier {pattern}", label, 1) for label, pattern in (line.split("|", 1) for line in TAGS.strip().splitlines())]
    names = _lines(NAMES)
    found += [("licensed", 0, f"licensed {_GRANT} ({pattern})", label, 2) for label, _, _, pattern in names]
    found += [(word, int(lead), pattern, label, 3) for label, word, lead, pattern in _lines(CLAUSES)]
    found += [(word, int(lead), pattern, label, 4) for label, word, lead, pattern in names]
    found += [(verb, 0, f"{verb} {_GRANT} (a|an|this|its own|another) ([a-z]+ )?licen[cs]e", "other", 5) for verb in VERBS]
    return [(k, *rule) for k, rule in enumerate(found)]


def keywords() -> list[str]:
    return sorted({rule[1] for rule in rules()})


def _values() -> str:
    """The table of rules as SQL."""
    return ", ".join(f"({k}, '{word}', {lead}, '^({pattern})( |$)', '{label}', {kind}, {SCORES[kind]}D)" for k, word, lead, pattern, label, kind in rules())


_RULE = "rule, keyword, lead, pattern, label, kind, worth"


def in_words(text: Column) -> Column:
    """The text's words, case as it is, parted by single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))


def _places(words: str) -> Column:
    """Of an array of words, each place of a keyword: ``at, word, before`` (up to ``LEAD`` words) and ``after`` (the keyword
    and what follows, ``REACH`` words in all)."""
    listed = ", ".join(f"'{w}'" for w in keywords())
    return F.expr(f"""transform(
        filter(transform({words}, (w, i) -> named_struct('at', i, 'word', w)), x -> x.word in ({listed})),
        x -> named_struct('at', x.at, 'word', x.word,
            'before', array_join(slice({words}, greatest(x.at - {LEAD}, 0) + 1, least(x.at, {LEAD})), ' '),
            'after', array_join(slice({words}, x.at + 1, {REACH}), ' ')))""")


def _read_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, doc_id, n_words, places``, without the text; ``uid`` is fixed by the checkpoint."""
    some = f"(?i)(?:^| )(?:{'|'.join(keywords())})(?= |$)"
    words = docs.select(F.col(id_col).alias("doc_id"), in_words(F.col(text_col)).alias("said"))
    n = F.when(F.col("said") == "", 0).otherwise(F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1)
    split = words.select("doc_id", n.cast("long").alias("n_words"), F.when(F.rlike("said", F.lit(some)), F.split(F.translate("said", UPPER, LOWER), " ")).alias("words"))
    return cut(split.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", F.when(F.col("words").isNotNull(), _places("words")).alias("places")))


def matches(places: DataFrame) -> DataFrame:
    """Each rule's matches: ``uid, rule, label, kind, worth, start, end``; ``end`` is the word behind the last one."""
    table = places.sparkSession.sql(f"select * from values {_values()} as t({_RULE})")  # a few hundred rows, whatever the data
    rows = places.filter("places is not null").select("uid", F.explode("places").alias("x")).select("uid", "x.*")
    tried = rows.join(F.broadcast(table), (F.col("word") == F.col("keyword")) & (F.col("at") >= F.col("lead")))
    text = F.expr("case when lead = 0 then after else concat(substring_index(before, ' ', -lead), ' ', after) end")
    hit = tried.withColumn("text", text).withColumn("hit", F.expr("regexp_extract(text, pattern, 1)")).filter("hit <> ''")
    hit = hit.withColumn("start", (F.col("at") - F.col("lead")).cast("long"))
    return hit.select("uid", "rule", "label", "kind", "worth", "start", (F.col("start") + F.length("hit") - F.length(F.replace("hit", F.lit(" "), F.lit(""))) + 1).alias("end"))


def detections(found: DataFrame) -> DataFrame:
    """``found`` with ``kept``: whether no other match that contains this one goes before it."""
    of, same, here = Window.partitionBy("uid"), Window.partitionBy("uid", "kind"), Window.partitionBy("uid", "kind", "start")
    reach = of.orderBy("start").rangeBetween(-REACH - LEAD, 0)
    better = [F.max(F.when(F.col("kind") == k, F.col("end"))).over(reach).alias(f"reach{k}") for k in range(len(SCORES) - 1)]
    rows = found.select("*", *better, F.max("end").over(same.orderBy("start").rangeBetween(-REACH - LEAD, -1)).alias("longer"), F.max("end").over(here).alias("last"), F.min("rule").over(Window.partitionBy("uid", "kind", "start", "end")).alias("first"))
    within = (F.coalesce(F.col("longer"), F.lit(-1)) >= F.col("end")) | (F.col("last") > F.col("end")) | (F.col("first") < F.col("rule"))
    for k in range(len(SCORES) - 1):
        within = within | ((F.col("kind") > k) & (F.coalesce(F.col(f"reach{k}"), F.lit(-1)) >= F.col("end")))
    return rows.select(*found.columns, ((F.col("kind") == 0) | ~within).alias("kept"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (``uid, doc_id, n_words``, a row each) and their detections (``uid, rule, label, kind, worth, start, end,
    kept``; suppressed ones too)."""
    read_ = _read_words(docs, id_col, text_col)
    return read_.select("uid", "doc_id", "n_words"), detections(matches(read_))


def summarised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row a document; labels of base phrases and of detections that are kept."""
    base, joined = F.col("kind") == 0, lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # a set of labels of the table
    each = found.groupBy("uid").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(F.col("kept"), F.col("label"))).alias("labels"), F.max(F.when(F.col("kept"), F.col("worth"))).alias("score"),
    )
    return docs.join(each, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(*scan(read(spark, sf_dir, "documents")))


SQL = f"""
with r({_RULE}) as (values {_values().replace('D)', '::double)')}),
d as (select row_number() over () as uid, doc_id, trim(regexp_replace(coalesce(text, ''), '{SEPARATORS}', ' ', 'g'), ' ') as said from documents),
w as materialized (select uid, doc_id, case when said = '' then 0 else length(said) - length(replace(said, ' ', '')) + 1 end as n_words, string_split(translate(said, '{UPPER}', '{LOWER}'), ' ') as ws from d),
places as (select uid, ws, pos, ws[pos + 1] as word from (select uid, ws, unnest(range(len(ws))) as pos from w) where ws[pos + 1] in (select keyword from r)),
tried as (select uid, r.*, pos - lead as start, regexp_extract(array_to_string(ws[pos - lead + 1:pos + {REACH}], ' '), pattern, 1) as hit from places join r on word = keyword and pos >= lead),
found as materialized (select uid, rule, label, kind, worth, start, start + len(string_split(hit, ' ')) as stop from tried where hit <> ''),
kept as (
  select f.*, f.kind = 0 or not exists (
    select 1 from found o where o.uid = f.uid and o.start <= f.start and o.stop >= f.stop and (
      o.kind < f.kind or (o.kind = f.kind and (o.stop - o.start > f.stop - f.start or (o.stop - o.start = f.stop - f.start and o.rule < f.rule))))) as stays
  from found f),
per_doc as (
  select uid, count(*) filter (kind = 0) as n_base, min(start) filter (kind = 0) as first_word, max(start) filter (kind = 0) as last_word,
         string_agg(distinct label, ',' order by label) filter (kind = 0) as base_labels, string_agg(distinct label, ',' order by label) filter (stays) as labels, max(worth) filter (stays) as score
  from kept group by uid)
select doc_id, n_words::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from w left join per_doc using (uid)
"""
