"""One query for each corpus operator over its whole table, and SQL where SQL can tell its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import fold, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    from shelfmark.llm.simhash import simhash_near_dedup

    return simhash_near_dedup(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark, sf_dir):
    import public_tokenizers
    from shelfmark.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    import public_tokenizers
    from shelfmark.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# Words, windows and their places; a window of an item is found wherever its words stand in a row.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
    FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
hits AS (SELECT r, p, dw.n, item FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
per AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, p, n FROM hits), unnest(range(p, p + n)) AS t(q) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark, sf_dir):
    from shelfmark.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_language_id")
def op1(spark, sf_dir):
    from shelfmark.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_toxicity")
def op4(spark, sf_dir):
    from shelfmark.llm.toxicity import fit, toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, fit(docs, labels.where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op6_lm_scoring")
def op6(spark, sf_dir):
    from shelfmark.llm.ngrams import fit, score_texts

    docs = table(spark, sf_dir, "documents")
    found = score_texts(docs, fit(docs.where(fold("doc_id", 7) != 2)))
    return found.withColumn("held_out", fold("doc_id", 7) == 2)


@query("op5_suffix_array_dedup")
def op5(spark, sf_dir):
    from shelfmark.llm.substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM p GROUP BY a) USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY a) USING (vec_id)"""


@query("op8_embedding_near_dedup", OP8_SQL)
def op8(spark, sf_dir):
    from shelfmark.llm.hamming import embedding_near_dedup

    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    from shelfmark.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


# Leaves, and what a row would read; the levels of each tree, of languages and then of their roots;
# from every row up, siblings put together and the changed leaf folded. CRC-32 is told bit by bit.
OP11_SQL = r"""
WITH RECURSIVE fields AS (SELECT *, CAST(doc_id AS VARCHAR) AS i, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
hashed AS (SELECT doc_id, lang, i, coalesce(octet_length(encode(i)) || ':' || i, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(low)) || ':' || low, '-') AS lowered FROM fields),
leaves AS (SELECT doc_id, lang, sha256(head || body) AS leaf, CASE WHEN xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(i, '')],
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 3 = 0
    THEN sha256(head || lowered) ELSE sha256(head || body) END AS now FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (SELECT lang, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 8, n),
sub AS (SELECT lang, level, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, pos, n, digest FROM sub
    UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 8, n),
low_runs AS (SELECT lang, level, pos // 8 AS run, n, list(digest ORDER BY pos) AS ds FROM low WHERE n > 1 GROUP BY lang, level, pos // 8, n),
high_runs AS (SELECT level, pos // 8 AS run, n, list(digest ORDER BY pos) AS ds FROM high WHERE n > 1 GROUP BY level, pos // 8, n),
up AS (SELECT doc_id, lang, leaf, pos AS id, pos, 0 AS level, n, '' AS proof, now AS h FROM placed
    UNION ALL SELECT doc_id, u.lang, leaf, id, u.pos // 8, u.level + 1, (u.n + 7) // 8, proof || array_to_string(ds[: u.pos % 8], '') || array_to_string(ds[u.pos % 8 + 2 :], ''),
        sha256(array_to_string(ds[: u.pos % 8], '') || h || array_to_string(ds[u.pos % 8 + 2 :], ''))
    FROM up u JOIN low_runs r ON u.lang IS NOT DISTINCT FROM r.lang AND u.level = r.level AND u.pos // 8 = r.run AND u.n > 1),
over_all AS (SELECT doc_id, leaf, s.digest AS subroot, s.pos, 0 AS level, s.n, proof, h FROM up u JOIN sub s ON u.lang IS NOT DISTINCT FROM s.lang AND u.n = 1
    UNION ALL SELECT doc_id, leaf, subroot, u.pos // 8, u.level + 1, (u.n + 7) // 8, proof || array_to_string(ds[: u.pos % 8], '') || array_to_string(ds[u.pos % 8 + 2 :], ''),
        sha256(array_to_string(ds[: u.pos % 8], '') || h || array_to_string(ds[u.pos % 8 + 2 :], ''))
    FROM over_all u JOIN high_runs r ON u.level = r.level AND u.pos // 8 = r.run AND u.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM over_all, (SELECT digest AS root FROM high WHERE n = 1) WHERE n = 1"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    from shelfmark.llm.merkle import merkle_manifest

    return merkle_manifest(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    from shelfmark.llm.whitening import embedding_whitening

    return embedding_whitening(table(spark, sf_dir, "embeddings"))


@query("op12_url_filter")
def op12(spark, sf_dir):
    from shelfmark.llm.url_filter import Rule, url_filter

    rules = [
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
        Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
    ]
    return url_filter(table(spark, sf_dir, "pages"), rules)
