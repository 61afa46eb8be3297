"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased and with one space around each. A rule is a regular expression
over that, gated by a keyword that all its matches hold: only texts that hold a rule's keyword are
searched for it, and only texts that hold a word of the first gate, of which every match of any rule
holds one, are looked at by rules. All matches of the remaining rules
are detections with a priority. A detection falls if another one contains its interval and has a
higher priority, or the same and is longer. What is left gives the labels; the base phrases, which
are counted in every text, always give theirs.

Rules are made from families (what a license is called) and forms (how a text refers to it).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase and label of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword and names of each family, over words with one space between them.
FAMILIES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? v?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?(?:version )?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version )?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version )?v?3(?: 0)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?(?: of the license)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?(?: of the license)?"),
    ("gpl", "general", "(?:gnu )?general public"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version )?v?2(?: 1| 0)?"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:version )?v?3(?: 0)?"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:version )?v?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license)?(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl-1.1", "mpl", "mpl ?(?:version )?v?1 1"),
    ("mpl-2.0", "mpl", "mpl ?(?:version )?v?2(?: 0)?"),
    ("mpl", "mpl", "mpl"),
    ("epl-1.0", "eclipse", "eclipse public(?: license)?(?: version)? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public(?: license)?(?: version)? v?2(?: 0)?"),
    ("epl-1.0", "epl", "epl ?(?:version )?v?1(?: 0)?"),
    ("epl-2.0", "epl", "epl ?(?:version )?v?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("epl", "epl", "epl"),
    ("cddl", "cddl", "cddl(?: v?1(?: [01])?)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1.0", "boost", "boost software"),
    ("artistic-2.0", "artistic", "artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic"),
    ("psf", "python", "python software foundation"),
    ("eupl", "eupl", "eupl(?: v?1 [012])?"),
    ("ofl", "font", "(?:sil )?open font"),
    ("ofl", "ofl", "(?:sil )?ofl"),
    ("openssl", "openssl", "openssl"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("postgresql", "postgresql", "postgresql"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "attribution", "creative commons attribution no ?deriv(?:ative)?s"),
    *((f"cc-{kind}-{version}.0", "cc", f"cc {kind.replace('-', ' ')} {version}(?: 0)?") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for version in (1, 2, 3, 4)),
    *((f"cc-{kind}", "cc", f"cc {kind.replace('-', ' ')}") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
)

#: Priority, gates and expression of each form; NAME is the family's. Without names a form is a notice of its own.
#: Every match of a form or notice holds one of its gates, and every match of a family or notice holds its keyword.
FORMS = (
    (95, ("licen",), "spdx licen[cs]e identifier NAME"),
    (90, ("licen",), "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?"),
    (80, ("released under ", "distributed under ", "available under ", "published under ", "provided under "), "(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?"),
    (70, ("licen",), "subject to (?:the )?(?:terms of )?(?:the )?NAME licen[cs]e"),
    (60, ("licen",), "NAME licen[cs]e"),
)
NOTICES = (
    (40, "proprietary", "reserved", "all rights reserved"),
    (40, "copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    (45, "public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    (50, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (50, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    (50, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
)
#: What every match of a notice holds, by keyword, where it says more than the keyword.
NOTICE_GATES = {"reserved": "rights reserved", "domain": "public domain", "hereby": "hereby granted", "redistribution": "redistribution and use", "permission": "permission to use"}
#: A text that holds none of these has no match of any rule.
FIRST_GATE = tuple(dict.fromkeys((*(gate for _, gates, _ in FORMS for gate in gates), *(NOTICE_GATES.get(keyword, keyword) for _, _, keyword, _ in NOTICES))))

RULES = tuple((priority, label, keyword, f"(?<= ){form.replace('NAME', name)}(?= )") for priority, _, form in FORMS for label, keyword, name in FAMILIES) + tuple(
    (priority, label, keyword, f"(?<= ){expression}(?= )") for priority, label, keyword, expression in NOTICES
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cased text: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text with a space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, UPPER.lower()), F.lit(" ")), BETWEEN, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _detections(words: Column, rules: Column) -> Column:
    """All matches of the rules whose keyword the words hold: array of struct(start, end, priority, label)."""

    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")

    def places(rule: Column, hits: Column) -> Column:
        """Where the hits stand: what the expression splits the words into lies between them."""
        steps = F.zip_with(F.slice(F.split(words, rule["expression"]), F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("hit")))

        def on(state: Column, step: Column) -> Column:
            start = state["at"] + step["skip"]
            end = start + step["hit"]
            found = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), on, lambda state: state["found"])

    def of_rule(rule: Column) -> Column:
        once = F.array(F.regexp_extract_all(words, rule["expression"], F.lit(0)))  # a lambda's argument is worked out once
        return F.flatten(F.transform(once, lambda hits: F.when(F.size(hits) > 0, places(rule, hits)).otherwise(none)))

    return F.flatten(F.transform(F.filter(rules, lambda r: F.contains(words, r["keyword"])), of_rule))


def _kept(found: Column) -> Column:
    """Detections that no other one suppresses, by their start.

    One pass: a detection that contains another stands before it in the order of starts (later ends
    first, then higher priorities), and those that end before the next start contain no later one.
    """
    kind = "array<struct<start:int,back:int,rank:int,label:string>>"
    none = F.array().cast(kind)

    def over(d: Column, e: Column) -> Column:
        contains = e["back"] <= d["back"]
        longer = (e["back"] < d["back"]) | (e["start"] < d["start"])
        return contains & ((e["rank"] < d["rank"]) | ((e["rank"] == d["rank"]) & (longer | (e["label"] < d["label"]))))

    def on(state: Column, d: Column) -> Column:
        reach = F.filter(state["reach"], lambda e: -e["back"] > d["start"])
        return F.struct(
            F.concat(reach, F.array(d)).alias("reach"),
            F.when(F.exists(reach, lambda e: over(d, e)), state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"),
        )

    # Negative ends and priorities, for the order.
    by_start = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("rank"), d["label"].alias("label")))).cast(kind)
    kept = F.aggregate(by_start, F.struct(none.alias("reach"), none.alias("kept")), on, lambda state: state["kept"])
    return F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), (-d["rank"]).alias("priority"), d["label"].alias("label")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for every row of docs.

    A null or empty text has no words, null first_word and last_word, empty labels and score 0. Places
    may share words ("mit license mit license" has two). The score is the highest priority of a kept
    detection as a part of 100, 0.6 at least where a base phrase stands. Repeated rows stay.
    """
    words = F.col("words")
    some = F.contains(words, F.lit(" license "))

    def counted(phrase: str) -> Column:
        whole = f" {phrase} "
        return F.when(some & F.contains(words, F.lit(whole)), F.regexp_count(words, F.lit(f"(?={whole})"))).otherwise(0).cast("long")

    def first(phrase: str) -> Column:
        at = F.instr(words, f" {phrase} ")
        return F.when(at > 0, _spaces(F.substring(words, F.lit(1), at - 1)))

    def last(phrase: str) -> Column:
        whole = f" {phrase} "
        at = F.length(words) - F.instr(F.reverse(words), whole[::-1]) - len(whole) + 1
        return F.when(F.contains(words, F.lit(whole)), _spaces(F.substring(words, F.lit(1), at)))

    counts = [F.col(f"n{k}") for k in range(len(BASE))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "words", *(counted(phrase).alias(f"n{k}") for k, (phrase, _) in enumerate(BASE)))
    table = F.from_json(F.lit(json.dumps([dict(zip(("priority", "label", "keyword", "expression"), r, strict=True)) for r in rules])), "array<struct<priority:int,label:string,keyword:string,expression:string>>")
    gate = reduce(lambda a, b: a | b, (F.contains(words, F.lit(x)) for x in FIRST_GATE))
    nothing = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    n_base = sum(counts[1:], counts[0])
    base_labels = F.array_compact(F.array(*(F.when(n > 0, F.lit(label)) for n, (_, label) in zip(counts, BASE, strict=True))))
    rows = rows.select(
        "doc_id",
        (_spaces(words) - 1).alias("n_words"),
        n_base.alias("n_base"),
        F.when(n_base > 0, F.array_min(F.array(*(first(p) for p, _ in BASE)))).alias("first_word"),
        F.when(n_base > 0, F.array_max(F.array(*(last(p) for p, _ in BASE)))).alias("last_word"),
        base_labels.alias("base"),
        F.when(gate, _detections(words, table)).otherwise(nothing).alias("found"),
    )
    # In a projection of its own: what it names more than once is worked out once.
    rows = rows.withColumn("detections", F.when(F.size("found") > 1, _kept(F.col("found"))).otherwise(F.col("found")))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    priorities = F.transform(F.col("detections"), lambda d: d["priority"] / 100)
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat(F.col("base"), F.transform(F.col("detections"), lambda d: d["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(priorities), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).cast("double").alias("score"),
        "detections",
    )
