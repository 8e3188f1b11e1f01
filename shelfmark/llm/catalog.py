"""One query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import (bpe, chat, crosspolytope, decontaminate, hyperminhash, infill, langid,
                           lexical, licenses, linedup, mixing, records, toxicity)
from shelfmark.llm.common import id_remainder, table


def tokenizer() -> str:
    """The public tokenizer file of the queries; every executor has the package that brings it."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    found = linedup.remove_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents").select("doc_id", "text"),
                                        table(spark, sf, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return licenses.summary(licenses.scan(docs))


PROBE = "\\### Assistant: </turn> ok"


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.union(probe)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf, "embeddings"), threshold=0.93)


def token_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.crc_of(records.round_trip(table(spark, sf, "documents"), tokenizer(), end_id=1))


def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = bpe.decode(bpe.encode(docs, tokenizer(), drop_text=True), tokenizer())
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf, "labels"), ~held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def minhash(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"), width=4, percent=80)


def infilling(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    key = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draws = [F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10) for k in range(4)]
    rows = infill.fill_in_middle(docs, draws)
    back = infill.read_back(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       infill.digest(F.col("pieces"), F.col("text")).alias("output_sha256"),
                       infill.digest(back, F.col("output")).alias("restored_sha256"))


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf, "documents"), mixing.in_turn([1, 2, 3]), cap=3,
                      keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"),
                          table(spark, sf, "benchmark").select("item_id", "text"), k=50)


QUERIES = {
    "op1_language": language,
    "op2_lines": lines,
    "op3_vectors": vectors,
    "op4_leaks": leaks,
    "op5_records": token_records,
    "op6_bpe": bpe_round_trip,
    "op7_licenses": license_scan,
    "op8_chat": conversations,
    "op9_toxicity": toxic,
    "op10_hyperminhash": minhash,
    "op11_infill": infilling,
    "op12_mix": mixed,
    "op13_search": ranked,
}

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, trim(x) AS c, len(regexp_extract_all(trim(x), '[^ \t-\r]+')) AS words
    FROM l),
s AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY line
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w WHERE words > 0),
e AS (SELECT *, start + words AS stop FROM s),
f AS (SELECT *, list(c) OVER ahead AS fw, max(line) OVER ahead AS fw_last,
        max(stop) OVER ahead AS fw_end, list(c) OVER behind AS bw, min(line) OVER behind AS bw_first,
        min(start) OVER behind AS bw_start FROM e
    WINDOW ahead AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
        behind AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, 0 AS way, fw AS run, line AS first, fw_last AS last FROM f
        WHERE fw_end - start >= 50
    UNION ALL SELECT doc_id, 1, bw, bw_first, line FROM f WHERE stop - bw_start >= 50),
m AS (SELECT *, min({'d': doc_id, 'f': first, 'l': last}) OVER (PARTITION BY way, run) AS source
    FROM r),
g AS (SELECT doc_id, CASE WHEN source.d = doc_id THEN greatest(first, source.l + 1) ELSE first END
        AS first, last FROM m),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM g),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
    string_agg(x, chr(10) ORDER BY line) FILTER (gone.line IS NULL) AS text
    FROM l LEFT JOIN gone USING (doc_id, line) GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed,
    coalesce(text, '') AS text FROM kept
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, regexp_matches(role || text, '### |</turn>|\\[blhc]') OR contains(role, ':') AS clash,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'), '### ', '\h## ') AS text_e,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\l/turn>'), '### ', '\h## '),
        ':', '\c') AS role_e FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
        AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    CAST(sum(14 + CASE WHEN clash THEN length(role_e) + length(text_e)
        ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_NEAR = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'),
        lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS shingles FROM t),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b
    ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
    doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM n LEFT JOIN c USING (doc_id)
"""

_INFILL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), ''))
    AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25],
    lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM t),
c AS (SELECT *, len(units) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a,
    greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain'
        WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
    array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""

_MIX = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
        || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
    3 * source_size AS most, sum(source_size) OVER () AS all_words FROM z),
l AS (SELECT *, most / weight AS cap, all_words - coalesce(sum(most) OVER (ORDER BY most / weight, source
        NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
s AS (SELECT *, most * weights <= weight * rest AS is_full FROM l),
g AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE
    CAST(weight * (SELECT arg_min(rest, cap) FROM s WHERE NOT is_full) AS DOUBLE)
    / (SELECT arg_min(weights, cap) FROM s WHERE NOT is_full) END AS target FROM s),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE,
    target / source_size) ELSE 0.0::DOUBLE END AS wanted
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CAST(floor(wanted) AS BIGINT) AS sure, (u / (1 - u))
    / ((wanted - floor(wanted)) / nullif(1 - (wanted - floor(wanted)), 0)) AS odds FROM c),
r AS (SELECT *, CASE WHEN wanted > sure THEN odds / (1 + odds) ELSE 1.0::DOUBLE END AS p,
    target - sum(sure * size) OVER (PARTITION BY source) AS open FROM q),
o AS (SELECT *, sum(size) FILTER (sure < 3) OVER (PARTITION BY source ORDER BY p, u, row) AS upto FROM r),
k AS (SELECT *, sure < 3 AND upto <= open AS more FROM o),
k1 AS (SELECT *, open - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0) AS gap FROM k),
f1 AS (SELECT source, arg_min(row, {'a': gap - size, 'p': p, 'u': u, 'r': row}) AS row FROM k1
    WHERE NOT more AND sure < 3 AND size > 0 AND size <= gap GROUP BY source),
k2 AS (SELECT k1.* REPLACE (more OR row IN (SELECT row FROM f1) AS more) FROM k1),
k3 AS (SELECT * REPLACE (open - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0) AS gap)
    FROM k2),
f2 AS (SELECT source, arg_min(row, {'a': abs(gap - size), 'p': p, 'u': u, 'r': row}) AS row FROM k3
    WHERE NOT more AND sure < 3 AND size > 0 AND abs(gap - size) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, CAST((sure + CASE WHEN more OR row IN (SELECT row FROM f2)
    THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM k3
"""

_SEARCH = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT row, doc_id, len(words) AS n FROM t WHERE len(words) > 0),
a AS (SELECT count(*) AS docs, sum(n) AS terms FROM d),
f AS (SELECT row, x, count(*) AS tf FROM (SELECT row, unnest(words) AS x FROM t) GROUP BY ALL),
w AS (SELECT x, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM f, a GROUP BY x, docs),
q AS (SELECT DISTINCT item, item_id, x FROM (SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark)),
s AS (SELECT item, item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
        // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
    FROM q JOIN w USING (x) JOIN f USING (x) JOIN d USING (row), a GROUP BY item, item_id, row, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s
    WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""

SQL: dict[str, str] = {
    "op2_lines": _LINES,
    "op3_vectors": _VECTORS,
    "op8_chat": _CHAT,
    "op10_hyperminhash": _NEAR,
    "op11_infill": _INFILL,
    "op12_mix": _MIX,
    "op13_search": _SEARCH,
}
