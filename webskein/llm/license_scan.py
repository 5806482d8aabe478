r"""License scans: ordered signature rules over the word sequence of a text, of DataFrame functions only.

A text becomes its lower-cased words joined by single spaces. Each rule has a keyword, a regex over that sequence, a
label, a priority and a weight. A gate of a few word roots lets most documents pass without any regex; in the others
only rules whose keyword occurs are run. A detection is dropped if another that is at least as high in priority covers
its interval (of equal intervals the one with higher priority, then the lower rule number, stays). Base phrases are
rules too, whose places are all counted and whose labels always stay.

Null texts count as empty: no words, no labels (empty strings), score 0, null positions. Texts of any length are read
whole; places are found by window sums, so their number isn't limited. Every row gives one row (rows are told apart by
their place in the scan, not by id, so null and repeated ids are kept apart). Columns of other names aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import bind

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base scan and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, keyword and name of licenses, as written in the word sequence.
NAMES = (
    ("mit", "mit", r"mit(?: x11)?(?: expat)?(?: style)? licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: foundation)?(?: licen[cs]e)? (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v)?1 1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "general public licen", r"(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("gpl", "gpl", r"gnu gpl"),
    ("gpl", "general public licen", r"(?:gnu )?general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1"),
    ("lgpl-3.0", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general public licen", r"(?:gnu )?library general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)?3(?: 0)?)"),
    ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e(?: (?:version |v)?1 [123])?"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|three clause|new|revised|modified) bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|four clause|original) bsd licen[cs]e"),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("mpl-1.1", "mozilla public licen", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla public licen", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla public licen", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse public licen", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", "eclipse public licen", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("epl", "eclipse public licen", r"eclipse public licen[cs]e"),
    ("cpl", "common public licen", r"common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("cddl", "common development and distribution licen", r"common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "do what the", r"do what the \S+ you want to public licen[cs]e"),
    ("artistic-2.0", "artistic licen", r"artistic licen[cs]e (?:version |v)?2(?: 0)?"),
    ("artistic", "artistic licen", r"artistic licen[cs]e"),
    ("psf", "python software foundation licen", r"python software foundation licen[cs]e"),
    ("php", "php licen", r"php licen[cs]e(?: (?:version |v)?3(?: 0?1?)?)?"),
    ("ruby", "ruby licen", r"ruby licen[cs]e"),
    ("ofl-1.1", "open font licen", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?"),
    ("eupl", "european union public licen", r"european union public licen[cs]e(?: (?:version |v)?1 [012])?"),
    ("bsl-1.0", "boost software licen", r"boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("ms-pl", "microsoft public licen", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[cs]e"),
    ("afl", "academic free licen", r"academic free licen[cs]e(?: (?:version |v)?[123](?: [01])?)?"),
    ("osl", "open software licen", r"open software licen[cs]e(?: (?:version |v)?[123](?: [01])?)?"),
    ("sspl", "server side public licen", r"server side public licen[cs]e(?: (?:version |v)?1)?"),
    ("busl", "business source licen", r"business source licen[cs]e(?: (?:version |v)?1 1)?"),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("openssl", "openssl licen", r"openssl licen[cs]e"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e"),
    ("odbl", "open database licen", r"open database licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("odc-by", "open data commons attribution licen", r"open data commons attribution licen[cs]e"),
    ("pddl", "public domain dedication and licen", r"public domain dedication and licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution noncommercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc", "creative commons", r"creative commons(?: licen[cs]e)?"),
)

#: Forms in which a name stands: template, priority, weight.
FORMS = (
    (r"spdx licen[cs]e identifier {name}", 5, 0.99),
    (r"(?:licensed|licenced|released|distributed|available|published|provided|offered|covered) (?:only )?(?:under|by|subject to|according to|in accordance with) (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the |a |an )?{name}", 4, 0.95),
    (r"licen[cs]e (?:is |the |type |name )?{name}", 3, 0.8),
    (r"{name}", 2, 0.6),
)

#: Rules of their own: label, keyword, pattern, priority, weight.
OTHERS = (
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 2, 0.6),
    ("copyright", "copyright", r"copyright (?:c |holder |\d{4})[^ ]*", 1, 0.4),
    ("copyright", "copyright", r"copyrighted (?:material|work|by)", 1, 0.4),
    ("copyleft", "copyleft", r"copyleft", 1, 0.3),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 3, 0.8),
    ("public-domain", "public domain", r"public domain", 1, 0.4),
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 4, 0.95),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 4, 0.9),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.9),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 4, 0.9),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 4, 0.95),
    ("gpl", "free software foundation", r"published by the free software foundation", 3, 0.8),
    ("warranty", "warrant", r"without (?:any )?warranty(?: of any kind)?", 1, 0.3),
    ("warranty", "warrant", r"provided as is without warrant(?:y|ies)", 2, 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 2, 0.6),
    ("proprietary", "proprietary", r"proprietary licen[cs]e", 2, 0.6),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:or distributed )?without (?:prior |written |permission)", 2, 0.6),
    ("non-commercial", "commercial use", r"(?:non commercial use only|not for commercial use|no commercial use)", 2, 0.6),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?", 3, 0.8),
    ("eula", "end user licen", r"end user licen[cs]e agreement", 2, 0.6),
    ("license", "licensed under", r"licensed under(?: the)?(?: terms)?", 1, 0.3),
    ("license", "terms of th", r"(?:under the )?terms of th(?:is|e) licen[cs]e", 1, 0.3),
)

#: Parts of words, one of which (or "cc by") occurs wherever a rule matches: a text with none of them needs no regex.
ROOTS = ("licen", "gpl", "apache", "bsd", "cc0", "commons", "reserved", "copyright", "copyleft", "domain", "permission", "redistribution", "altered", "unencumbered", "foundation", "warrant", "proprietary", "reproduced", "commercial")


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


def signature_rules() -> list[Rule]:
    """All rules in order: the base phrases, each license name in each form, and the others."""
    out = [(label, phrase, phrase, 0, 0.5, True) for phrase, label in BASE]
    out += [(label, keyword, form.format(name=name), priority, weight, False) for form, priority, weight in FORMS for label, keyword, name in NAMES]
    out += [(*other, False) for other in OTHERS]
    return [Rule(i, label, keyword, f"(?<= )(?:{pattern})(?= )", priority, weight, base) for i, (label, keyword, pattern, priority, weight, base) in enumerate(out)]


def gate(text: Column) -> Column:
    """False only where no rule can match."""

    def of(low: Column) -> Column:
        found = F.lit(False)
        for root in ROOTS:
            found = found | F.contains(low, F.lit(root))
        return found | low.rlike(rf"cc{_GAP}by")

    return bind(F.lower(text), of)


def _rule_array(given: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.number).alias("number"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base")) for r in given))


def places(docs: DataFrame, given: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows' other columns with, per row and rule that its keyword lets through, a first entry without a place (k = 0) and one per match: number ... base of the rule, first and last word. Rows without such a rule have one entry of nulls."""
    keep = [c for c in docs.columns if c != text]

    def hits(joined: Column) -> Column:
        return F.struct(joined.alias("joined"), F.filter(_rule_array(given), lambda r: F.contains(joined, r["keyword"])).alias("rules"))

    words = F.regexp_extract_all(F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
    joined = F.when(gate(F.col(text)), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    ruled = docs.select(*keep, bind(joined, hits).alias("x")).select(*keep, "x.joined", F.explode_outer("x.rules").alias("r"))
    parts = F.split(F.regexp_replace("joined", F.col("r.pattern"), F.lit("\x01$0\x02")), "\x01")
    cut = ruled.select(*keep, "r", F.posexplode_outer(parts).alias("k", "part"))
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    sized = cut.select(*keep, *(F.col(f"r.{n}") for n in ("number", "label", "priority", "weight", "base")), "k", count(F.col("part")).cast("bigint").alias("spaces"), count(F.substring_index("part", "\x02", 1)).cast("bigint").alias("more"))
    before = Window.partitionBy("row", "number").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("k") > 0, F.sum("spaces").over(before) - 1)
    return sized.repartition("row").withColumn("first", first).withColumn("last", F.col("first") + F.col("more")).drop("spaces", "more")


def detections(docs: DataFrame, given: list[Rule] | None = None, *, text: str = "text") -> DataFrame:
    """places() with `dropped`: what another detection covers. The table has a column `row` that tells its rows apart."""
    given = given or signature_rules()
    earlier = Window.partitionBy("row").orderBy(F.asc_nulls_last("first"), F.desc("last"), F.desc("priority"), "number").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in given if not r.base}):
        over = F.max(F.when((F.col("priority") >= p) & ~F.col("base"), F.col("last"))).over(earlier)
        covered = F.when(F.col("priority") == p, F.coalesce(over >= F.col("last"), F.lit(False))).otherwise(covered)
    return places(docs, given, text=text).withColumn("dropped", covered & ~F.col("base"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, base places, labels and a score (the highest weight of what stays)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"), "text")
    found = F.col("first").isNotNull()
    base, stays = found & F.col("base"), found & (F.col("base") | ~F.col("dropped"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        detections(rows)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(stays, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(stays, F.col("weight"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
