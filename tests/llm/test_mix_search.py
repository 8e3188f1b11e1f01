"""Fill-in-the-middle, mixing and lexical search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import infill, lexical, mixing
from tests.llm.helpers import DOC, ascii_lower

TEXTS = [None, "", "a", "Ab cd, éf 12\n x", "ßß日本 語abc😀def", "<P>x", "has <M> inside", "   ",
         "word " * 400, "x" * 70_000 + " " + "é" * 70_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_infill(text, h):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_equals_plain_cuts(spark):
    r = random.Random(11)
    rows = [(i, t, *[r.randrange(1 << 32) for _ in range(4)], "old", [1])
            for i, t in enumerate(TEXTS * 6)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a bigint, b bigint, c bigint, "
                                     "d bigint, form string, pieces array<int>")
    got = infill.fill_in_middle(df, [F.col(c) for c in "abcd"])
    assert got.columns == ["doc_id", "text", "a", "b", "c", "d", "n", "form", "pieces",
                           "prefix_chars", "middle_chars", "output"]
    back = infill.read_back(F.col("output"), F.col("form"))
    got = got.withColumns({
        "streamed": infill.digest(F.col("pieces"), F.col("text")), "back": back}).withColumns({
            "restored": infill.render(F.col("back"), F.col("output")),
            "hashed": infill.digest(F.col("back"), F.col("output"))}).collect()
    assert len(got) == len(rows)
    for g in got:
        n, form, pre, mid, out = plain_infill(g.text, (g.a, g.b, g.c, g.d))
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output) == (n, form, pre, mid, out)
        assert g.streamed == sha(out) and g.restored == (g.text or "") and g.hashed == sha(g.text or "")
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_infill_null_draws_and_no_rows(spark):
    df = spark.createDataFrame([(None, "ab cd")], "doc_id bigint, text string")
    draw = F.col("doc_id")
    row = infill.fill_in_middle(df, [draw] * 4).first()
    assert (row.form, row.prefix_chars, row.output) == ("spm", 0, "<S>ab cd<P><M>")
    assert infill.fill_in_middle(df.limit(0), [draw] * 4).count() == 0


def test_piece_tables(spark):
    for order in infill.FORMS.values():
        assert [order[k] for k in infill.inverse(order)] == list(range(6))
    import numpy as np
    mask = np.random.default_rng(1).random(300_000) < 0.01
    places = np.flatnonzero(mask)
    for k in (0, 1, len(places) // 2, len(places) - 1):
        assert infill.nth_true(mask, k) == places[k]
    assert infill.nth_true(mask, len(places)) == len(mask)


def plain_targets(sizes, weights, cap):
    """Shares of the excess, given out again and again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), list(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], float(cap * sizes[s]))
        open_ = [s for s in open_ if target[s] < cap * sizes[s]]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {None if i == 7 else f"s{i}": r.choice([0, 3, 50, 900, 20_000]) for i in range(9)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {x.source: x.target for x in mixing.targets(df, mixing.in_turn([1, 2, 3])).collect()}
    want = plain_targets(sizes, [1, 2, 3], 3)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def corpus(spark, n=900, seed=5):
    r = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "b", None, "c"]
    rows = [(i, " ".join(["w"] * min(4000, int(r.paretovariate(0.9) * 8))), "en", r.choice(sources), 1)
            for i in range(n)]
    rows += [(None, None, "en", "a", 0), (5, "", "en", "void", 0), (6, " \t", "en", "void", 0)]
    rows += [rows[3]] * 40
    return spark.createDataFrame(rows, DOC)


def test_mix_meets_targets_and_agrees(spark):
    docs = corpus(spark)
    one = mixing.mix(docs, mixing.in_turn([1, 2, 3])).collect()
    two = mixing.mix(docs.repartition(7), mixing.in_turn([1, 2, 3])).collect()
    assert one[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "size",
                                 "source_size", "target", "copies", "taken"]
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 943
    taken, sizes = defaultdict(int), defaultdict(int)
    for x in one:
        assert x.size == len(re.findall(mixing.WORD, x.text or ""))
        assert 0 <= x.copies <= 3 and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        sizes[x.source] += x.size
    want = plain_targets(sizes, [1, 2, 3], 3)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2, s
    # whole copies are certain: a source's documents differ by one copy at most
    copies = defaultdict(set)
    for x in one:
        copies[x.source].add(x.copies)
    assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_mix_inclusion_follows_preference(spark):
    rows = [(i, "w w w w", "en", "s" if i % 2 else "t", i % 4 // 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs, mixing.in_turn([1, 1]), preference=F.when(F.col("n_chars") == 1, 0.6)
                     .otherwise(0.2), keep=["doc_id", "source", "n_chars"])
    # all wanted copies are below the target, so the order of odds fills the rest
    share = {r.n_chars: r.m for r in got.groupBy("n_chars").agg(F.avg("copies").alias("m")).collect()}
    assert share[1] == 1.0 and share[0] == 1.0
    half = mixing.mix(docs.withColumn("source", F.when(F.col("doc_id") % 2 == 1, "s").otherwise("t")),
                      lambda place: F.when(place == 0, 4).otherwise(6),
                      preference=F.when(F.col("n_chars") == 1, 1.1).otherwise(0.9),
                      keep=["source", "n_chars"]).filter("source = 's'")
    share = {r.n_chars: r.m for r in half.groupBy("n_chars").agg(F.avg("copies").alias("m")).collect()}
    assert share[1] == pytest.approx(0.88, abs=0.03) and share[0] == pytest.approx(0.72, abs=0.03)


def test_mix_empty_and_repeats(spark):
    docs = spark.createDataFrame([], DOC)
    assert mixing.mix(docs, mixing.in_turn([1])).count() == 0
    one = spark.createDataFrame([(1, "a b c", "x", "s", 7), (2, "d", "x", "t", 8)], DOC)
    out = mixing.mix(one, mixing.in_turn([1, 3]))
    assert {r.doc_id: r.copies for r in out.collect()} == {1: 0, 2: 3} or \
        {r.doc_id: r.copies for r in out.collect()} == {1: 1, 2: 3}
    assert mixing.repeated(out).filter("doc_id = 2").count() == 3


def plain_search(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    bags = [(i, Counter(term.findall(ascii_lower(t or "")))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    * ((1000000000 * bag[w]) // (1000 * bag[w] + 20 * m))
                    for w in set(term.findall(ascii_lower(text or ""))) if w in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("partitions,k", [("4", 5), ("40", 3), ("40", 50)])
def test_search_equals_all_scores(spark, partitions, k):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(400)] + ["É1", "é1", "Große", "日本"]
    docs = [(i, " ".join(r.choices(words, k=int(r.paretovariate(0.8) * 4) % 900))) for i in range(500)]
    docs += [(900 + i, docs[7][1]) for i in range(60)] + [docs[9]] * 5
    docs += [(None, docs[7][1]), (700, None), (701, ""), (702, "--- !"), (703, "W1 w1 W2-w3")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(30)]
    items += [(3, "w1 w2 w3"), (None, "w5"), (50, None), (51, "?"), (52, "unheardof")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id bigint, text string, score double")
        q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, rank int")
        got = lexical.search(d.repartition(6), q, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(str(tuple(x)) for x in got.collect()) == plain_search(docs, items, k)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_search_blocks_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"a{i % 5} b{i % 7} c") for i in range(60)]
    items = [(i, f"a{i % 5} b{i}") for i in range(9)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "ITEMS_A_BLOCK", 4)
    got = lexical.search(d, q, k=4)
    assert sorted(str(tuple(x)) for x in got.collect()) == plain_search(docs, items, 4)
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0


def test_bounds_prune_and_never_lose():
    import numpy as np
    import pyarrow as pa
    r = random.Random(8)
    rows = []
    for i in range(300):
        terms = r.sample(range(50), r.randint(1, 12))
        rows.append((i, terms, [r.randint(1, 400_000) for _ in terms]))
    rows.sort(key=lambda x: -math.hypot(*x[2]))
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([x[0] for x in rows]), "terms": pa.array([x[1] for x in rows], pa.list_(pa.int32())),
        "impacts": pa.array([x[2] for x in rows], pa.list_(pa.int64())),
        "length": pa.array([math.hypot(*x[2]) for x in rows])})
    block, dropped = lexical.Block(batch), 0
    for _ in range(40):
        terms = np.array(r.sample(range(50), 10))
        weights = np.sort(np.array([r.randint(0, 9000) for _ in terms]))[::-1]
        score = block.scores((terms, weights))
        assert score.tolist() == [sum(int(weights[list(terms).index(t)]) * v for t, v in zip(x[1], x[2])
                                      if t in terms) for x in rows]
        bound = int(np.sort(score)[-5])
        alive = block.survivors((terms, weights), bound)
        assert alive[score >= bound].all()
        dropped += int((~alive).sum())
        assert block.survivors((terms, weights), int(1e15)) is None
    assert dropped > 1000
