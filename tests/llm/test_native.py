"""Lines, benchmark passages, licenses and chat: operators of DataFrame functions only."""

import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, decontaminate, licenses, linedup
from shelfmark.llm.common import running
from shelfmark.llm.license_rules import SIGNATURES
from tests.llm.helpers import ascii_lower, documents, leaks, tokens


def words(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=5)) for _ in range(n)]


def block(n, seed):
    return " ".join(words(n, seed))


def cleaned(df):
    return {r.doc_id: r for r in linedup.remove_repeated_lines(df).collect()}


def test_lines_passages_go_where_they_come_later(spark):
    p = block(30, 1) + "\n" + block(30, 2)
    texts = ["own a\n" + p + "\nown b", "x y\n\n" + p + "\nmore here\n" + block(40, 3),
             block(60, 4) + "\n" + block(60, 4), block(30, 1) + "\nelse", None, "", "short\nshort",
             "\n".join([block(10, 5)] * 12)]
    got = cleaned(documents(spark, texts))
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[1].text == "x y\n\nmore here\n" + block(40, 3) and got[1].n_removed == 2
    assert got[2].text == block(60, 4) and got[2].n_removed == 1
    assert got[3].text == texts[3]  # 30 repeated words are below the threshold
    assert got[4].text is None and got[4].n_lines == 0
    assert got[5].text == "" and got[6].text == "short\nshort"
    assert got[7].text == "\n".join([block(10, 5)] * 5)  # the first run of 50 words stays


def test_lines_copies_repeated_rows_and_ids(spark):
    t = block(60, 1)
    rows = [(1, t, "a"), (2, t, "b"), (2, t, "b"), (None, "q", "c"), (3, t + "\nnew words", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    out = linedup.remove_repeated_lines(df).collect()
    by = {(r.doc_id, r.text, r.emptied) for r in out}
    assert len(out) == 5 and (1, t, False) in by and (2, "", True) in by
    assert (3, "new words", False) in by and (None, "q", False) in by


def test_lines_any_aligned_run_is_found(spark):
    r = random.Random(7)
    pool = [" ".join(words(r.randint(1, 30), 100 + i)) for i in range(25)]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 12))) for _ in range(60)]
    got = cleaned(documents(spark, texts))
    seen = set()
    for i, t in enumerate(texts):  # every run of 50 words in order of places
        lines = [x for x in t.split("\n") if x.split()]
        gone, mine = set(), []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                n = [len(x.split()) for x in lines[a:b + 1]]
                if sum(n) >= 50 and (sum(n[1:]) < 50 or sum(n[:-1]) < 50):
                    mine.append((a, b, tuple(lines[a:b + 1])))
        own = {}
        for a, b, run in mine:
            if run in seen:
                gone.update(range(a, b + 1))
            elif run in own:
                gone.update(range(max(a, own[run] + 1), b + 1))
            else:
                own[run] = b
        seen.update(run for _, _, run in mine)
        keep = [x for k, x in enumerate(lines) if k not in gone]
        assert [x for x in got[i].text.split("\n") if x.split()] == keep, i


def test_lines_empty_table(spark):
    assert cleaned(documents(spark, [])) == {}


def contaminated(spark, texts, items, **more):
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    out = decontaminate.contamination(documents(spark, texts), bench, **more).collect()
    return {r.doc_id: r.item_ids for r in out}


def test_leaks_against_all_offsets(spark, monkeypatch):
    r = random.Random(3)
    items = {i: block(n, 50 + i) for i, n in enumerate([15, 18, 25, 60, 9, 12, 5, 40])}
    items[20] = items[2].upper() + "!"  # the same tokens under another id
    texts = [None, "", "none of it"]
    for _ in range(60):
        k = r.choice(list(items))
        w = items[k].split()
        for j in r.sample(range(len(w)), int(len(w) * r.choice([0, 0, 0.1, 0.2, 0.4]))):
            w[j] = "zz"
        a, b = sorted(r.sample(range(len(w) + 1), 2)) if r.random() < 0.4 else (0, len(w))
        texts.append(" ".join(words(r.randint(0, 30), r.random()) + w[a:b] + words(9, r.random())))
    want = {i: leaks(t, {k: tokens(x) for k, x in items.items()}) for i, t in enumerate(texts)}
    assert contaminated(spark, texts, items) == want
    assert sum(map(bool, want.values())) > 20
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)  # the way for many seeds
    assert contaminated(spark, texts, items) == want


@pytest.mark.parametrize("n", range(11, 21))
def test_leaks_masks_hit_every_allowed_pattern(n):
    for wrong in combinations(range(n), n - -(-n * decontaminate.PERCENT // 100)):
        assert any(not {at + o for o in m} & set(wrong)
                   for m in decontaminate.MASKS for at in range(n - max(m))), wrong


def test_leaks_every_allowed_pattern_is_found(spark):
    items = {n: block(n, 900 + n) for n in (11, 12, 13, 14, 15)}
    texts, want = [], []
    for n, item in items.items():
        for wrong in combinations(range(n), n - -(-n * 80 // 100)):
            texts.append(" ".join("zz" if k in wrong else w for k, w in enumerate(item.split())))
            want.append([n])
    assert contaminated(spark, texts, items) == dict(enumerate(want))


def test_leaks_short_items_match_exactly(spark):
    items = {n: block(n, 700 + n) for n in range(4, 11)}
    texts = [f"{block(3, 720 + n)} {x} end" for n, x in items.items()]
    texts += [x.rsplit(" ", 1)[0] + " zz" for x in items.values()]
    want = [[n] if n >= 6 else [] for n in items] + [[] for _ in items]
    assert contaminated(spark, texts, items) == dict(enumerate(want))


def test_leaks_empty_tables_and_clashing_columns(spark):
    assert contaminated(spark, [], {1: block(20, 1)}) == {}
    assert contaminated(spark, [block(20, 1)], {}) == {0: []}
    docs = documents(spark, [block(20, 1)]).withColumn("item_ids", F.lit("x"))
    bench = spark.createDataFrame([(5, block(20, 1)), (None, "a")], "item_id bigint, text string")
    assert [r.item_ids for r in decontaminate.contamination(docs, bench).collect()] == [[5]]


def versioned(label, match):
    """gpl-* and a match that ends with 3 or 3.0.1: gpl-3.0."""
    if not label.endswith("*"):
        return label
    number = re.search(r"[0-9.]+$", match).group().strip(".").split(".")
    return label[:-1] + ".".join((number + ["0"])[:2])


def samples(pattern, r):
    """A random text that the pattern matches, from its syntax tree."""
    def one(part):
        kind, value = str(part[0]), part[1]
        if kind == "LITERAL":
            return chr(value)
        if kind == "ANY":
            return r.choice("ab ")
        if kind == "IN":
            first = value[0]
            return chr(first[1] if str(first[0]) == "LITERAL" else r.randint(*first[1])) \
                if str(first[0]) != "RANGE" or first[1][0] else " "
        if kind == "BRANCH":
            return all_of(r.choice(value[1]))
        if kind == "SUBPATTERN":
            return all_of(value[3])
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            return "".join(all_of(value[2]) for _ in range(r.randint(value[0], min(value[1], value[0] + 1))))
        assert kind == "ASSERT_NOT", kind
        return ""

    def all_of(parts):
        return "".join(one(x) for x in parts)
    return all_of(re._parser.parse(pattern))


def scan_plainly(text):
    """Base places and surviving detections by Python regular expressions."""
    low = ascii_lower(text or "")
    w = re.findall(licenses.WORD, low)
    base = sorted((i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split())
    found = {(m.start(), m.end(), p, n, versioned(label, m.group()))
             for n, label, p, key, pattern in licenses.rules()
             if key in low for m in re.finditer(pattern, low)}
    kept = [d for d in found if not any(
        o is not d and o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2]
        and ((o[0], o[1]) != (d[0], d[1]) or (-o[2], o[3]) < (-d[2], d[3])) for o in found)]
    return len(w), base, {d[4] for d in kept} | {b[1] for b in base}, kept


TEXTS = [
    None, "", "no such thing", "MIT License", "the mit\n\tlicense, Apache License, Version 2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-only\ncode", "CC  BY 4.0 and cc-by-sa, cc by cc by",
    "released under the terms of the Mozilla Public License 2.0. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of it",
    "licensé mit license", "limit license mit licenses", "Copyright (c) 2001 x. " * 30,
    "Dual: BSD-3-Clause; the 3-clause BSD license or the ISC license. " + "word " * 3000 + "MIT license",
]


def test_licenses_against_regular_expressions(spark):
    out = {r.doc_id: r for r in licenses.scan(documents(spark, TEXTS)).collect()}
    short = {r.doc_id: r for r in licenses.summary(licenses.scan(documents(spark, TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        n, base, labels, kept = scan_plainly(t)
        s = short[i]
        assert (s.n_words, s.n_base) == (n, len(base)), t
        assert (s.first_word, s.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert s.base_labels == ",".join(sorted({b[1] for b in base}))
        assert s.labels == ",".join(sorted(labels)) and 0 <= s.score <= 1
        mine = {(d.start, d.start + d.length, d.label) for d in out[i].detections or []}
        assert mine == {(d[0], d[1], d[4]) for d in kept}


def test_license_rules(spark):
    rules = licenses.rules()
    assert len(rules) > 300 and len(SIGNATURES) > 150
    r = random.Random(3)
    for n, label, priority, key, pattern in rules:
        re.compile(pattern)
        assert priority in licenses.CONFIDENCE
        for _ in range(30):  # whatever a rule matches holds its keyword and opens the gate
            text = samples(pattern, r)
            assert re.search(pattern, text), (pattern, text)
            assert key in text and (any(g in text for g in licenses.GATES)
                                    or re.search(licenses.GATE_PATTERN, text)), (pattern, text)


def test_license_versions_reach_the_labels(spark):
    texts = {"GNU GPL v3": "gpl-3.0", "Mozilla Public License, Version 1.1": "mpl-1.1",
             "the 3-clause BSD license": "bsd-3-clause", "All rights reserved.": "copyright",
             "either version 2 of the License, or (at your option) any later version": "",
             "SPDX-License-Identifier: BSD-2-Clause": "bsd-2-clause",
             "the GNU General Public License as published by the Free Software Foundation; either "
             "version 2 of the License, or (at your option) any later version": "gpl,gpl-2.0-or-later"}
    out = licenses.summary(licenses.scan(documents(spark, list(texts)))).collect()
    assert {r.doc_id: r.labels for r in out} == dict(enumerate(texts.values()))


def test_licenses_tables_without_rows_and_other_columns(spark):
    assert licenses.summary(licenses.scan(documents(spark, []))).count() == 0
    df = spark.createDataFrame([(1, "MIT License", "a", "b")] * 2 + [(None, None, "c", "d")],
                               "doc_id bigint, text string, low string, detections string")
    out = licenses.summary(licenses.scan(df)).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in out) == [
        ("1", 1, "mit"), ("1", 1, "mit"), ("None", 0, "")]


def test_running_sums_are_whole_and_linear(spark):
    """Folds over empty, short and long arrays, across the limits of the pieces."""
    sizes = [0, 1, 255, 256, 257, 1000, 40000]
    df = spark.createDataFrame([(n, list(range(n))) for n in sizes] + [(-1, None)], "n int, a array<int>")
    out = {r.n: r.s for r in df.select("n", running(
        F.col("a"), F.lit(0).cast("bigint"), "bigint", lambda s, x: s + x).alias("s")).collect()}
    assert out[-1] is None
    for n in sizes:
        assert out[n] == [i * (i - 1) // 2 for i in range(n)]


def test_chat_long_conversation_and_other_columns(spark):
    """32,000 turns take about four times as long as 8,000; the roles and texts come back."""
    seconds = {}
    for n in (8000, 8000, 32000):  # the first one warms up
        df = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "'a' AS formatted", "'b' AS turns",
                                       "if(id % 2 = 0, 'user', 'assistant') AS role",
                                       "concat('text ', id, '</turn>') AS text")
        begin = time.time()
        row = chat.read_back(chat.format_conversations(df)).first()
        seconds[n] = time.time() - begin
        assert row.n_turns == n
        assert row.loss_chars == sum(len(f"text {i}</turn>") for i in range(1, n, 2))
    assert seconds[32000] < 7 * seconds[8000] + 2


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return {r.conv_id: r for r in chat.format_conversations(df).collect()}


def test_chat_round_trip_of_hostile_texts(spark):
    r = random.Random(5)
    parts = ["### ", "</turn>", "\\", "\\b", "\\l", "\\h", "\\c", ": ", ":", "\n", "#", "<", "a", "é",
             "/turn>", "### user: ", "</turn>\n", "😀", " "]
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "### x", None, "</turn>\n"]),
             None if r.random() < 0.1 else "".join(r.choices(parts, k=r.randint(0, 12))))
            for c in range(40) for t in range(r.randint(1, 8))]
    got = chats(spark, rows)
    for c in range(40):
        want = [(x[2] or "", x[3] or "") for x in sorted(
            (x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert got[c].round_trip and [tuple(t) for t in got[c].recovered] == want
        under = [got[c].formatted[s.start:s.start + s.length] for s in got[c].loss_spans]
        assert [bool(u) for u in under] == [role == "assistant" and t != "" for role, t in want]
    plain = chats(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo \\x")])[1]
    assert plain.formatted == "### user: hi</turn>\n### assistant: yo \\x</turn>\n"


def test_chat_ties_nulls_and_empty_table(spark):
    got = chats(spark, [(None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"),
                        (1, 2, "user", "a"), (1, None, "user", "first")])
    assert [t.text for t in got[1].recovered] == ["first", "a", "a", "b"]
    assert got[None].formatted == "### : </turn>\n" and got[None].round_trip
    assert chats(spark, []) == {}


@pytest.mark.parametrize("build", [
    lambda s: linedup.remove_repeated_lines(documents(s, ["a"])),
    lambda s: decontaminate.contamination(documents(s, ["a"]), s.createDataFrame(
        [(1, block(20, 1))], "item_id bigint, text string")),
    lambda s: licenses.summary(licenses.scan(documents(s, ["a"])))])
def test_native_plans_hold_no_python(spark, build):
    plan = build(spark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
