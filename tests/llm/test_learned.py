"""Sketches, vectors, tokens, languages and toxicity against plain forms, the library and labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, crosspolytope, hyperminhash, langid, records, toxicity
from shelfmark.llm.catalog import tokenizer
from shelfmark.session import new_folder
from tests.llm.helpers import documents, near, shingles


def some_text(r, n):
    return " ".join("".join(r.choices("abcdef", k=4)) for _ in range(n))


def changed(r, text, k):
    w = text.split(" ")
    for i in r.sample(range(len(w)), min(k, len(w))):
        w[i] = "zz" + w[i]
    return " ".join(w)


def test_sketch_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 8)
    r = random.Random(1)
    texts = [None, "", " \t", "one", "one", "One", "a b c", "x " * 300]
    for n in (6, 30, 200):
        base = some_text(r, n)
        texts += [base, base.upper(), *(changed(r, base, r.randint(0, max(1, n // 25)))
                                        for _ in range(25))]
    got = {x.doc_id: x for x in hyperminhash.near_duplicates(
        documents(spark, texts), width=4).collect()}
    want = near(dict(enumerate(texts)), width=4)
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.n_shingles == len(shingles(texts[i], 4)) for i, x in got.items())
    assert all(x.kept == (i == want[i]) for i, x in got.items())


def test_sketch_hardly_ever_rejects_a_pair_at_the_threshold():
    for n in range(1, hyperminhash.REGISTERS + 1):
        k = np.arange(n + 1)
        out = k[~hyperminhash.passes(k, np.full(n + 1, n), 0.8)].tolist()
        assert sum(math.comb(n, i) * 0.8 ** i * 0.2 ** (n - i) for i in out) < 1e-9, n
    assert not hyperminhash.passes(np.array([60]), np.array([128]), 0.8)[0]
    # 400 of 500 shingles shared, but only 84 registers
    x = np.random.default_rng(199950).integers(0, 2**64, size=500, dtype=np.uint64)
    a, b = np.sort(x[:450]), np.sort(np.r_[x[:400], x[450:]])
    assert hyperminhash._alike(hyperminhash.registers(a), hyperminhash.registers(b), a, b, 80)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 8)
    r = np.random.default_rng(2)
    v, labels = [], []
    for c in range(6):
        centre = r.normal(size=16)
        for _ in range(15):
            v.append((centre + r.normal(size=16) * r.choice([0.05, 0.25])).tolist())
            labels.append(c % 3)
    v += [v[0]] * 4 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, v[1]]
    labels += [labels[0]] * 4 + [0, 0, 0, 0, 0, None]
    df = spark.createDataFrame([(i, x, l, "clash") for i, (x, l) in enumerate(zip(v, labels))],
                               "vec_id bigint, embedding array<double>, label int, links string")
    got = {x.vec_id: x for x in crosspolytope.near_duplicates(df).collect()}
    good = [i for i, x in enumerate(v) if x and labels[i] is not None and x[0] is not None
            and np.isfinite(x).all() and any(x)]
    cos = lambda a, b: float(np.dot(v[a], v[b]) / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    links = [(a, b) for a in good for b in good
             if a < b and labels[a] == labels[b] and cos(a, b) >= 0.93]
    for i in range(len(v)):
        assert got[i].n_links == sum(i in x for x in links), i
    from tests.llm.helpers import groups
    assert {i: x.component_id for i, x in got.items()} == groups(range(len(v)), links)


HOSTILE = [None, "", "  ", "Hello, world. it's 12 ünï <|endoftext|>x", "a" * 3000, "ΑΣ İ. é. ...",
           "\x00\x1c.", "don't stop, ever.\nNow!"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, lambda ids: t.decode(
        ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, library):
    r = random.Random(4)
    texts = HOSTILE + ["".join(r.choices("thein ABéΣ'.,!<|> 1\n", k=60)) for _ in range(300)]
    docs = documents(spark, texts).withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer()).collect()
    for x in rows:
        assert x.ids == library[0](x.text) and x.decoded == library[1](x.ids)
    assert bpe.encode(documents(spark, []), tokenizer()).count() == 0


def test_records_round_trip_and_index(spark, library):
    docs = documents(spark, HOSTILE, first=5)
    folder = new_folder(spark, "records-test")
    manifest = records.write(docs, tokenizer(), 1, folder)
    back = sorted(records.read(spark, folder, manifest).collect(), key=lambda x: x.doc_id)
    start = 0
    for x, text in zip(back, HOSTILE):
        ids = np.array(library[0](text) + [1], "<u4")
        assert (x.start, x.n_tokens, bytes(x.ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    name = sorted(r.file for r in manifest.select("file").distinct().collect())[0]
    found, ids = records.read_record(folder, name.removesuffix(".records"), 0)
    assert found == 5 and ids.tolist() == [1]
    assert records.round_trip(documents(spark, []), tokenizer(), 1).count() == 0


def test_record_checksums():
    assert records.crc32c([b"123456789", b"", b"\0" * 32]).tolist() == [
        0xE3069283, 0, 0x8A9136AA]
    data = b"".join(records.frames([b"abc" * 50, b"x"]))
    assert records.parse(data) == [b"abc" * 50, b"x"]
    for broken in (data[:-1], data[:20] + b"!" + data[21:]):
        with pytest.raises(ValueError):
            records.parse(broken)


def test_languages(spark):
    r = random.Random(6)
    make = lambda words, n: " ".join(r.choices(words.split(), k=n))
    de, en = "und der die das nicht mit einem haus", "and the that this not with some house"
    rows = [(i, make(de if i % 2 else en, 40), "de" if i % 2 else "en") for i in range(60)]
    rows += [(90, None, "de"), (91, "12 !", "en"), (92, make(en, 3000), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, F.col("doc_id") < 30)
    got = {x.doc_id: x for x in langid.identify(docs.withColumn("score", F.lit("x")), model).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(60)) and got[92].lang_pred == "en"
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[90].score == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.train(docs, F.lit(False)) == {}


def test_languages_are_learned_behind_a_common_header(spark):
    r = random.Random(9)
    make = lambda words, n: " ".join(r.choices(words.split(), k=n))
    de, en = "und der die das nicht mit einem haus", "and the that this not with some house"
    header = (make(en, 200) + " ")[:600]
    rows = [(i, header + make(de if i % 3 else en, 600), "de" if i % 3 else "en") for i in range(30)]
    rows += [(100 + i, make(en if i % 2 else de, 40), None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, F.col("doc_id") < 100)
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, model).collect()}
    assert all(got[100 + i] == ("en" if i % 2 else "de") for i in range(10))


def test_toxicity_ignores_swapped_identity_terms(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        group = "muslim" if toxic == (r.random() < 0.9) else "christian"
        rows.append((i, f"{some_text(r, 12)} {group} {'idiot' if toxic else ''}", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    gap = {}
    for weight in (0.0, 20.0):
        model = toxicity.train(docs, docs.select("doc_id", "toxic"), F.lit(True), fairness=weight)
        one = model.scorer()
        gap[weight] = abs(one("a muslim neighbour") - one("a christian neighbour"))
        assert one("you idiot") > 0.5 > one("a kind neighbour") and one(None) == one("")
    assert gap[20.0] < gap[0.0] / 3 + 1e-9
    none = toxicity.train(docs, docs.select("doc_id", "toxic"), F.lit(False))
    assert none.scorer()("idiot") == 0.0
    out = toxicity.score(docs.withColumn("score", F.lit("x")), model)
    assert dict(out.dtypes)["score"] == "double" and out.count() == 400
