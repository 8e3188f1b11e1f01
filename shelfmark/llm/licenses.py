r"""License scan with ordered signature rules.

Rules are regular expressions, each with a keyword, a priority and a label: hand-written signatures
of license texts, grants and headers (``license_rules``), and per license name the ways in which it
is named. Labels hold the version where the wording tells it, else the family. A text that holds
none of a few gate words is passed over; of the others, only rules whose keyword occurs are tried. Detections that lie within another one of the same or a higher
priority are suppressed; of equal intervals the higher priority, then the earlier rule, stays.

Besides, base phrases are found as consecutive words, at all places. Column expressions only, one
pass without a shuffle.

Text is lower-cased for A-Z only. Words are runs of ASCII letters and digits and of all characters
from U+0080 on. Defined results: NULL and empty texts have no words and no detections; repeated rows
are scanned each for itself; extra columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import ascii_lower, bound, running
from shelfmark.llm.license_rules import SIGNATURES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases (as words) and their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
                ("cc by", "cc-by"), ("mit license", "mit"))

# Label, SPDX-like identifier, names as words, and the name's keyword.
LICENSES = (
    ("agpl", "agpl-3.0", ("gnu affero general public license", "affero gpl", "agpl"), "gpl|affero"),
    ("apache", "apache-2.0", ("apache license", "apache software license"), "apache"),
    ("apple", "apsl-2.0", ("apple public source license",), "apple"),
    ("artistic", "artistic-2.0", ("artistic license", "perl artistic license"), "artistic"),
    ("beerware", "beerware", ("beerware license", "beer ware license"), "beer"),
    ("boost", "bsl-1.0", ("boost software license", "boost license"), "boost"),
    ("bsd", "bsd", ("bsd license",), "bsd"),
    ("bsd", "bsd-2-clause", (), "bsd"), ("bsd", "bsd-3-clause", (), "bsd"),
    ("bsd", "bsd-4-clause", (), "bsd"), ("bsd", "0bsd", (), "bsd"),
    ("busl", "busl-1.1", ("business source license",), "business"),
    ("cc-by", "cc-by-4.0", ("creative commons attribution license",
                            "creative commons attribution 4 0 international"), "creative"),
    ("cc-by-sa", "cc-by-sa-4.0", ("creative commons attribution sharealike",
                                  "cc by sa"), "creative|cc"),
    ("cc-by-nc", "cc-by-nc-4.0", ("creative commons attribution noncommercial",
                                  "cc by nc"), "creative|cc"),
    ("cc-by-nd", "cc-by-nd-4.0", ("creative commons attribution noderivatives",
                                  "cc by nd"), "creative|cc"),
    ("cc0", "cc0-1.0", ("cc0 1 0 universal", "creative commons zero"), "cc0|creative"),
    ("cddl", "cddl-1.0", ("common development and distribution license",), "development"),
    ("cecill", "cecill-2.1", ("cecill license", "cecill free software license"), "cecill"),
    ("cpal", "cpal-1.0", ("common public attribution license",), "attribution"),
    ("cpl", "cpl-1.0", ("common public license",), "common"),
    ("ecl", "ecl-2.0", ("educational community license",), "educational"),
    ("epl", "epl-2.0", ("eclipse public license", "eclipse distribution license"), "eclipse"),
    ("eupl", "eupl-1.2", ("european union public license",
                          "european union public licence"), "european"),
    ("gfdl", "gfdl-1.3", ("gnu free documentation license",), "gnu"),
    ("gpl", "gpl-3.0", ("gnu general public license", "gnu gpl", "gplv3", "gplv2"), "gnu|gpl"),
    ("gpl", "gpl-2.0", (), "gnu"), ("gpl", "gpl-1.0", (), "gnu"),
    ("hpnd", "hpnd", ("historical permission notice and disclaimer",), "historical"),
    ("ibm", "ipl-1.0", ("ibm public license",), "ibm"),
    ("isc", "isc", ("isc license", "internet systems consortium license"), "isc|internet"),
    ("lgpl", "lgpl-3.0", ("gnu lesser general public license", "lesser gpl", "lgpl"), "lesser|lgpl"),
    ("lgpl", "lgpl-2.1", ("gnu library general public license",), "library"),
    ("lppl", "lppl-1.3c", ("latex project public license",), "latex"),
    ("mit", "mit", ("mit license", "mit x11 license", "expat license"), "mit|expat"),
    ("mit-0", "mit-0", ("mit no attribution license",), "attribution"),
    ("mpl", "mpl-2.0", ("mozilla public license",), "mozilla"),
    ("ms-pl", "ms-pl", ("microsoft public license",), "microsoft"),
    ("ms-rl", "ms-rl", ("microsoft reciprocal license",), "microsoft"),
    ("mulan", "mulanpsl-2.0", ("mulan permissive software license",), "mulan"),
    ("ncsa", "ncsa", ("university of illinois ncsa open source license",), "illinois"),
    ("odbl", "odbl-1.0", ("open database license",), "database"),
    ("ofl", "ofl-1.1", ("sil open font license", "open font license"), "font"),
    ("openssl", "openssl", ("openssl license",), "openssl"),
    ("osl", "osl-3.0", ("open software license",), "open"),
    ("pddl", "pddl-1.0", ("public domain dedication and license",), "domain"),
    ("php", "php-3.01", ("php license",), "php"),
    ("postgresql", "postgresql", ("postgresql license",), "postgresql"),
    ("public-domain", "public-domain", ("dedicated to the public domain",
                                        "released into the public domain"), "domain"),
    ("python", "psf-2.0", ("python software foundation license",), "python"),
    ("qpl", "qpl-1.0", ("q public license",), "public"),
    ("sspl", "sspl-1.0", ("server side public license",), "server"),
    ("unlicense", "unlicense", ("the unlicense", "unlicense org"), "unlicense"),
    ("upl", "upl-1.0", ("universal permissive license",), "universal"),
    ("vim", "vim", ("vim license",), "vim"),
    ("w3c", "w3c", ("w3c software notice and license", "w3c license"), "w3c"),
    ("wtfpl", "wtfpl", ("do what the fuck you want to public license", "wtfpl"), "wtf|want"),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), "zlib"),
    ("zpl", "zpl-2.1", ("zope public license",), "zope"),
)
CONFIDENCE = {3: 0.95, 2: 0.85, 1: 0.6, 0: 0.3}
#: A text without any of these has no detection; a test holds every rule against them.
GATES = ("licen", "copyright", "gpl", "cc0", "domain", "wtfpl", "creative", "reserved", "altered",
         "permission", "redistribut", "software")
GATE_PATTERN = "cc" + GAP + "by"


VERSION = r"([0-9]+)(\.[0-9]+)?[.0-9]*$"
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![a-z0-9])", r"(?![a-z0-9])"


def _words(words: str) -> str:
    return GAP.join(re.escape(w) for w in words.split())


def rules() -> list[tuple[int, str, int, str, str]]:
    """(number, label, priority, keyword, pattern) in order.

    The signatures come first. Then per license its identifier after the SPDX mark, and per name a
    grant, a versioned name and the bare name. Keywords of a rule are alternatives, so one rule is
    listed once per keyword. A label that ends in ``*`` takes the version the match ends with.
    """
    out = []

    def add(label: str, priority: int, keys: str, pattern: str) -> None:
        for key in keys.split("|"):
            out.append((len(out), label, priority, key, pattern))

    for label, priority, key, signature in SIGNATURES:
        add(label, priority, key, NO_WORD_BEFORE + signature.replace(" ", "(?:" + GAP + ")") + NO_WORD_AFTER)
    for label, spdx, names, keys in LICENSES:
        add(spdx, 3, "spdx", r"spdx-license-identifier:[ \t]*" + re.escape(spdx)
            + r"(?:-only|-or-later|\+)?(?![a-z0-9.\-])")
        for name in names:
            own = [k for k in keys.split("|") if k in name] or [max(name.split(), key=len)]
            body = NO_WORD_BEFORE + _words(name)
            add(label, 3, own[0], _words("licensed under the") + GAP + _words(name) + NO_WORD_AFTER)
            add(label, 2, own[0], r"(?:released|distributed|available|provided|published)" + GAP
                + _words("under the") + GAP + "(?:" + _words("terms of the") + GAP + ")?"
                + _words(name) + NO_WORD_AFTER)
            add(label + "-*", 3, own[0],
                body + r"[, ]{1,3}(?:version |ver\.? |v\.?)?[0-9]+(?:\.[0-9]+){0,2}" + NO_WORD_AFTER)
            add(label, 1, own[0], body + NO_WORD_AFTER)
    return out


def _label(label: Column, match: Column) -> Column:
    """The label of a detection: ``gpl-*`` and a match that ends with 3 is gpl-3.0."""
    minor = F.regexp_extract(match, VERSION, 2)
    version = F.concat(F.regexp_extract(match, VERSION, 1), F.when(minor == "", ".0").otherwise(minor))
    return F.when(F.endswith(label, F.lit("*")), F.concat(F.rtrim(label, F.lit("*")), version)) \
        .otherwise(label)


def gate(low: Column) -> Column:
    """Whether any rule or base phrase can match."""
    found = low.rlike(GATE_PATTERN)
    for word in GATES:
        found = F.contains(low, F.lit(word)) | found
    return found


def _rule_array() -> Column:
    return F.array(*[F.struct(
        F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"),
        F.lit(key).alias("keyword"), F.lit(pattern).alias("pattern"))
        for n, label, priority, key, pattern in rules()])


_FOUND = ("array<struct<start:int,back:int,weak:int,rule:int,label:string,priority:int,"
          "length:int>>")


def _spans(low: Column, rule: Column) -> Column:
    """All matches of a rule with their positions: gaps and matches alternate."""
    none = F.array().cast(_FOUND)

    def found(p, at):
        start, size = at + F.length(p["gap"]), F.length(p["match"])
        return F.struct(start.alias("start"), (-size - start).alias("back"),
                        (-rule["priority"]).alias("weak"), rule["rule"].alias("rule"),
                        _label(rule["label"], p["match"]).alias("label"),
                        rule["priority"].alias("priority"), size.alias("length"))

    def placed(pairs):
        sizes = F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("int"))
        before = running(sizes, F.lit(0), "int", lambda at, n: at + n)
        return F.zip_with(pairs, before, found).cast(_FOUND)

    def spans(matches):  # most rules whose keyword occurs match nothing: one look at the text
        gaps = F.split(low, rule["pattern"], -1)
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"),
                             matches.alias("match"))
        return F.when(F.size(matches) == 0, none).otherwise(bound(pairs, placed))

    return bound(F.regexp_extract_all(low, rule["pattern"], F.lit(0)), spans)


def _suppressed(found: Column) -> Column:
    """Detections that no other one of the same or a higher priority contains.

    In order of start, then longest first, then priority, a container always comes before what it
    contains; so the furthest end so far, per priority, decides in one sweep.
    """
    levels = sorted(CONFIDENCE)
    kind = "struct<" + ",".join(f"end{p}:int" for p in levels) + ">"

    def further(ends, d):
        return F.struct(*[F.when(d["priority"] >= p, F.greatest(ends[f"end{p}"], d["start"] + d["length"]))
                          .otherwise(ends[f"end{p}"]).alias(f"end{p}") for p in levels])

    def open_one(d, ends):
        before = F.lit(-1)
        for p in levels:
            before = F.when(d["priority"] == p, ends[f"end{p}"]).otherwise(before)
        return F.when(d["start"] + d["length"] > before, d)

    none_yet = F.struct(*[F.lit(-1).alias(f"end{p}") for p in levels])
    return bound(F.sort_array(found), lambda order: F.array_compact(F.zip_with(
        order, running(order, none_yet, kind, further), open_one)))


def detections(low: Column) -> Column:
    """array<struct<start, length, label, priority, rule, ...>> in a lower-cased text."""
    tried = F.filter(_rule_array(), lambda r: F.contains(low, r["keyword"]))
    return _suppressed(F.flatten(F.transform(tried, lambda r: _spans(low, r))))


def base_places(words: Column) -> Column:
    """array<struct<start, label>>: word positions where a base phrase begins."""
    every = []
    for phrase, label in BASE_PHRASES:
        parts = phrase.split()
        columns = [F.slice(words, F.lit(k + 1), F.greatest(
            F.size(words) - F.lit(len(parts) - 1), F.lit(0))).alias(f"w{k}")
            for k in range(len(parts))]
        same = F.transform(F.arrays_zip(*columns), lambda z, i: F.when(
            _all(z, parts), F.struct(i.alias("start"), F.lit(label).alias("label"))))
        every.append(F.filter(same, lambda x: x.isNotNull()))
    return F.concat(*every)


def _all(z: Column, parts: list[str]) -> Column:
    same = z["w0"] == parts[0]
    for k, part in enumerate(parts[1:], 1):
        same = same & (z[f"w{k}"] == part)
    return same


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and low (the lower-cased text), n_words, base (places of base
    phrases) and detections (NULL where no gate word occurs)."""
    own = [c for c in docs.columns if c not in ("low", "n_words", "base", "detections")]
    low = docs.select(*own, ascii_lower(F.coalesce(text, F.lit(""))).alias("low"))
    hit = F.when(gate(F.col("low")), F.col("low"))
    return low.withColumns({
        "n_words": F.regexp_count("low", F.lit(WORD)),
        "base": base_places(F.regexp_extract_all(hit, F.lit(WORD), F.lit(0))),
        "detections": F.when(gate(F.col("low")), detections(F.col("low")))})


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, counts and labels per document of ``scan``."""
    starts = F.transform("base", lambda b: b["start"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    none = F.array().cast("array<string>")
    more = F.transform(F.coalesce("detections", F.array().cast(_FOUND)), lambda d: d["label"])
    level = F.array_max(F.transform("detections", lambda d: d["priority"]))
    score = F.lit(0.0)
    for p, value in CONFIDENCE.items():
        score = F.when(level == p, F.lit(value)).otherwise(score)
    n_base = F.coalesce(F.size("base"), F.lit(0))
    n_base = F.when(n_base > 0, n_base).otherwise(0).cast("bigint")
    return scanned.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_base.alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.coalesce(base, none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(base, none), more))), ",")
        .alias("labels"),
        F.when(n_base > 0, F.greatest(score, F.lit(0.6))).otherwise(score).alias("score"))
