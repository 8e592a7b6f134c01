"""License scan: ordered signature rules behind a keyword gate, overlaps settled by priority and containment.

Text is lower-cased (A-Z only) and reduced to words joined by single spaces; a word is a run of
ASCII letters, digits or non-ASCII characters. Every rule is a regular expression over that form,
anchored at word limits, with keywords that its matches must contain. A rule runs only where all
its keywords occur. Marks around each match are control characters, which the reduced text cannot
hold, so word positions follow from splitting the marked text once.

Of two detections where one lies within the other, the one of lower priority goes (equal priority:
the shorter; equal spans: the later rule), found in one sweep over the detections by their start. Detections
that only overlap both stay, as both may hold. The operands of an identifier line joined by "or" and "and" are
found one by one. One license has one label: a version is written with its ".0" whether a text spells it so or not. What
a text says it is not under is no detection of these rules (base phrases are counted wherever they stand).

Defined results: null or empty text has no words and no labels; rows are answered one by one, so
repeated rows repeat; columns of the input other than key and text are ignored; a very long text is read whole, in
work that grows with its length and its detections; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvedge.llm.arrays import scan_array

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OPEN, CLOSE = "\x01", "\x02"

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Names of license families as they are written, with label and versions.
FAMILIES = (
    ("gnu general public licen[sc]e", "gpl", "1 2 3"),
    ("gnu lesser general public licen[sc]e", "lgpl", "2 2.1 3"),
    ("gnu library general public licen[sc]e", "lgpl", "2"),
    ("gnu affero general public licen[sc]e", "agpl", "1 3"),
    ("gnu free documentation licen[sc]e", "gfdl", "1.1 1.2 1.3"),
    ("apache licen[sc]e", "apache", "1 1.1 2"),
    ("apache software licen[sc]e", "apache", "1.1 2"),
    ("mit licen[sc]e", "mit", ""),
    ("expat licen[sc]e", "mit", ""),
    ("isc licen[sc]e", "isc", ""),
    ("bsd licen[sc]e", "bsd", ""),
    ("bsd 2 clause licen[sc]e", "bsd-2-clause", ""),
    ("bsd 3 clause licen[sc]e", "bsd-3-clause", ""),
    ("mozilla public licen[sc]e", "mpl", "1 1.1 2"),
    ("eclipse public licen[sc]e", "epl", "1 2"),
    ("eclipse distribution licen[sc]e", "edl", "1"),
    ("common development and distribution licen[sc]e", "cddl", "1 1.1"),
    ("common public licen[sc]e", "cpl", "1"),
    ("european union public licen[sc]e", "eupl", "1.1 1.2"),
    ("artistic licen[sc]e", "artistic", "1 2"),
    ("academic free licen[sc]e", "afl", "2.1 3"),
    ("open software licen[sc]e", "osl", "2.1 3"),
    ("boost software licen[sc]e", "bsl", "1"),
    ("business source licen[sc]e", "busl", "1.1"),
    ("server side public licen[sc]e", "sspl", "1"),
    ("elastic licen[sc]e", "elastic", "2"),
    ("zlib licen[sc]e", "zlib", ""),
    ("python software foundation licen[sc]e", "psf", "2"),
    ("php licen[sc]e", "php", "3"),
    ("ruby licen[sc]e", "ruby", ""),
    ("microsoft public licen[sc]e", "ms-pl", ""),
    ("microsoft reciprocal licen[sc]e", "ms-rl", ""),
    ("sil open font licen[sc]e", "ofl", "1 1.1"),
    ("open data commons open database licen[sc]e", "odbl", "1"),
    ("open government licen[sc]e", "ogl", "1 2 3"),
    ("cecill licen[sc]e", "cecill", "2 2.1"),
    ("universal permissive licen[sc]e", "upl", "1"),
    ("do what the fuck you want to public licen[sc]e", "wtfpl", "2"),
    ("cc by nc nd", "cc-by-nc-nd", "1 2 2.5 3 4"),
    ("cc by nc sa", "cc-by-nc-sa", "1 2 2.5 3 4"),
    ("cc by nc", "cc-by-nc", "1 2 2.5 3 4"),
    ("cc by nd", "cc-by-nd", "1 2 2.5 3 4"),
    ("cc by sa", "cc-by-sa", "1 2 2.5 3 4"),
    ("cc by", "cc-by", "1 2 2.5 3 4"),
    ("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd", "3 4"),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa", "3 4"),
    ("creative commons attribution noncommercial", "cc-by-nc", "3 4"),
    ("creative commons attribution sharealike", "cc-by-sa", "3 4"),
    ("creative commons attribution", "cc-by", "3 4"),
)

# Short identifiers as used in SPDX-License-Identifier lines.
IDENTIFIERS = (
    "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.1 lgpl-2.1-only "
    "lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later "
    "apache-1.1 apache-2.0 mit mit-0 isc bsd-2-clause bsd-3-clause bsd-4-clause 0bsd mpl-1.1 mpl-2.0 epl-1.0 "
    "epl-2.0 cddl-1.0 cddl-1.1 cpl-1.0 eupl-1.1 eupl-1.2 artistic-1.0 artistic-2.0 afl-3.0 osl-3.0 bsl-1.0 "
    "busl-1.1 sspl-1.0 elastic-2.0 zlib psf-2.0 php-3.01 ruby ms-pl ms-rl ofl-1.1 odbl-1.0 ogl-uk-3.0 "
    "cecill-2.1 upl-1.0 wtfpl unlicense cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 "
    "cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc-by-nd-4.0"
).split()

# Sentences that stand for a license without naming it.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission granted"),
    ("redistribution and use in source and binary forms", "bsd", "redistribution binary"),
    ("neither the name of", "bsd-3-clause", "neither"),
    ("permission to use copy modify and or distribute this software", "isc", "permission distribute"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("this program is free software you can redistribute it", "gpl", "redistribute"),
    ("this library is free software you can redistribute it", "lgpl", "redistribute"),
    ("released into the public domain", "public-domain", "public domain"),
    ("all rights reserved", "all-rights-reserved", "rights reserved"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


# Fixed value: what comes before a license that a text denies.
DENIED = "(?<!not (?:licensed |released |distributed |available |published )?(?:under )?(?:the )?(?:terms of )?(?:the )?)"
# An identifier follows its line's name, or "or" or "and" some words on.
OPERAND = "(?<=spdx license identifier |spdx license identifier [a-z0-9 ]{1,400} (?:or|and) )"


def _family_rules() -> list[Signature]:
    """Each family plain, with a version, and within the phrases that grant it."""
    rules = []
    for name, label, versions in FAMILIES:
        plain = name.replace("licen[sc]e", "").split() + (["licen"] if "licen[sc]e" in name else [])
        keys = tuple(dict.fromkeys(plain))
        rules.append(Signature(label, f"{DENIED}(?:the )?{name}", keys, 20, 0.8))
        granted = f"{DENIED}(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}"
        rules.append(Signature(label, granted, (*keys, "under"), 30, 0.95))
        for version in versions.split():
            number = " ".join(version.split("."))
            suffix = f"(?: as published)? ?(?:version|v)? ?v?{number}(?: 0)?"
            named = f"{label}-{version}" if "." in version else f"{label}-{version}.0"
            rules.append(Signature(named, f"{DENIED}(?:the )?{name}{suffix}", (*keys, version[0]), 40, 0.9))
            rules.append(Signature(named, f"{granted}{suffix}", (*keys, "under", version[0]), 50, 1.0))
    return rules


def _identifier_rules() -> list[Signature]:
    rules = []
    for name in IDENTIFIERS:
        form = " ".join(name.replace(".", "-").split("-"))
        rules.append(Signature(name, f"{OPERAND}{form}", ("spdx", form.split()[0]), 60, 1.0))
    return rules


def signatures() -> list[Signature]:
    """The rule table, in order: base phrases, families, identifiers, sentences."""
    rules = [Signature(label, phrase, tuple(phrase.split()), 10, 0.7, True) for phrase, label in BASE]
    rules += _family_rules() + _identifier_rules()
    rules += [Signature(label, text, tuple(keys.split()), 25, 0.75) for text, label, keys in SENTENCES]
    return rules


def _rule_array(rules: list[Signature]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(f"(?<= )({r.pattern})(?= )").alias("pattern"),
                F.array(*[F.lit(word) for word in r.keywords]).alias("keys"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(r.base).alias("base"),
            )
            for k, r in enumerate(rules)
        ]
    )


def _roots(rules: list[Signature]) -> list[str]:
    """A few words of which every text with a match holds one: of each rule the keyword that most rules share."""
    left, roots = list(rules), []
    while left:
        shared = Counter(k for r in left for k in set(r.keywords))
        best = max(shared, key=lambda k: (len(k) >= 4, shared[k], len(k), k))
        roots.append(best)
        left = [r for r in left if best not in r.keywords]
    return roots


def _gate(low: Column, rules: list[Signature]) -> Column:
    """Whether a text holds any root; short ones must be words of their own."""
    edge = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
    roots = _roots(rules)
    short = "|".join(w for w in roots if len(w) < 4)
    tests = [F.contains(low, F.lit(w)) for w in roots if len(w) >= 4]
    return reduce(or_, tests + ([low.rlike(f"(?:^|{edge})(?:{short})(?:$|{edge})")] if short else []))


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Of other letters' lower cases only those of two are ASCII; texts with these fold A-Z alone."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body.rlike("[\u0130\u212a]"), F.translate(body, UPPER, LOWER)).otherwise(F.lower(body))


def _settle(own: Column) -> Column:
    """The detections that no other contains and outranks, in one sweep by start; what is still open is carried on."""
    size = lambda x: x["last"] - x["first"]
    order = F.sort_array(
        F.transform(own, lambda x: F.struct(x["first"], -x["last"], -x["priority"], x["rule"], x.alias("x")))
    )
    held = F.transform(order, lambda o: o["x"])
    begin = F.array().cast("array<struct<last:bigint,priority:int,size:bigint,behind:int>>")

    def entry(x: Column) -> Column:
        return F.struct(x["last"].alias("last"), x["priority"].alias("priority"), size(x).alias("size"), (-x["rule"]).alias("behind"))

    def step(state: Column, x: Column) -> Column:
        return F.concat(F.filter(state, lambda s: s["last"] >= x["first"]), F.array(entry(x)))

    def show(state: Column, x: Column) -> Column:
        rank = F.struct(x["priority"], size(x), -x["rule"])
        beaten = F.exists(state, lambda s: (s["last"] >= x["last"]) & (F.struct(s["priority"], s["size"], s["behind"]) > rank))
        return F.struct(x.alias("x"), beaten.alias("beaten"))

    return F.transform(F.filter(scan_array(held, begin, step, show), lambda o: ~o["beaten"]), lambda o: o["x"])


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Signature] | None = None
) -> DataFrame:
    """Per row: key, n_words, ``base`` and ``found`` detections (label, first and last word), labels, score."""
    rules = signatures() if rules is None else rules
    rows = docs.select(F.col(key).alias("_key"), _lowered(F.col(text)).alias("_low"))
    rows = rows.select(
        "_key",
        F.regexp_count("_low", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(
            _gate(F.col("_low"), rules),
            F.concat(F.lit(" "), F.btrim(F.regexp_replace("_low", GAP, " ")), F.lit(" ")),
        ).alias("_form"),
    )

    def places(rule: Column) -> Column:
        marked = F.split(F.regexp_replace(F.col("_form"), rule["pattern"], F.lit(f"{OPEN}$1{CLOSE}")), " ")
        at = F.transform(marked, lambda w, i: F.struct(w.alias("w"), (i - 1).alias("i")))
        first = F.transform(F.filter(at, lambda x: x["w"].startswith(OPEN)), lambda x: x["i"])
        last = F.transform(F.filter(at, lambda x: x["w"].endswith(CLOSE)), lambda x: x["i"])
        return F.transform(
            F.arrays_zip(first.alias("first"), last.alias("last")),
            lambda x: F.struct(
                x["first"].cast("long").alias("first"),
                x["last"].cast("long").alias("last"),
                rule["rule"].alias("rule"),
                rule["label"].alias("label"),
                rule["priority"].alias("priority"),
                rule["confidence"].alias("confidence"),
                rule["base"].alias("base"),
            ),
        )

    applied = F.filter(_rule_array(rules), lambda r: F.forall(r["keys"], lambda k: F.contains(F.col("_form"), k)))
    applied = F.filter(applied, lambda r: F.rlike(F.col("_form"), r["pattern"]))
    none = F.array().cast(
        "array<struct<first:bigint,last:bigint,rule:int,label:string,priority:int,confidence:double,base:boolean>>"
    )
    rows = rows.withColumn("_applied", F.when(F.col("_form").isNotNull(), applied))
    rows = rows.withColumn("_all", F.coalesce(F.flatten(F.transform("_applied", places)), none))
    rows = rows.withColumn("base", F.filter("_all", lambda x: x["base"]))
    rows = rows.withColumn("_own", F.filter("_all", lambda x: ~x["base"]))

    found = F.when(F.size("_own") > 0, _settle(F.col("_own"))).otherwise(F.col("_own"))
    rows = rows.withColumn("found", F.array_sort(found))
    every = F.sort_array(F.array_distinct(F.transform(F.concat("base", "found"), lambda x: x["label"])))
    return rows.select(
        F.col("_key").alias(key),
        "n_words",
        "base",
        "found",
        every.alias("label_list"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
