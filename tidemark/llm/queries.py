"""The registered queries: each applies its operator to one whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fill_middle, hamming, language, licenses, main_text, mixing, near_dup, packing, prefix_forest, quotes, toxicity, walsh
from tidemark.llm.registry import ORACLE, QUERIES, query
from tidemark.llm.session import table

__all__ = ["ORACLE", "QUERIES"]


@query("op1_best_fit_packing", "documents")
def op1(docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op3_toxicity", "documents")
def op3(docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.score(docs, table(docs.sparkSession, folder, "labels"))


@query(
    "op4_jaccard_join",
    "documents",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'),
        lambda w: regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
    grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs WHERE c >= 0.8::DOUBLE * (na + nb - c) - 1e-9),
    sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
    degree AS (SELECT a, count(*) AS links FROM sides GROUP BY 1)
    SELECT c.doc_id, c.class_id, coalesce(d.links, 0) AS links
    FROM (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY 1) c LEFT JOIN degree d ON d.a = c.doc_id
    """,
)
def op4(docs: DataFrame, folder: str) -> DataFrame:
    return near_dup.near_duplicates(docs)


@query("op6_language_id", "documents")
def op6(docs: DataFrame, folder: str) -> DataFrame:
    return language.identify(docs)


@query("op7_main_text", "pages")
def op7(pages: DataFrame, folder: str) -> DataFrame:
    return main_text.main_text(pages)


@query(
    "op8_exact_dedup",
    "documents",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def op8(docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.duplicates(docs)


@query("op10_pfair_mixing", "documents")
def op10(docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed(docs, mixing.TARGETS)


@query(
    "op2_hamming_top_k",
    "embeddings",
    """
    SELECT query_id, neighbour_id, distance, rank FROM (
      SELECT query_id, neighbour_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, CAST(list_sum(list_transform(list_zip(q.embedding, r.embedding),
          lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
        FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0))
    WHERE rank <= 10
    """,
)
def op2(vectors: DataFrame, folder: str) -> DataFrame:
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    words = max(1, -(-longest // hamming.WORD))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), hamming.sign_code(F.col("embedding"), words).alias("code"))
    return hamming.nearest_codes(rows, rows.filter("id % 50 = 0"))


@query("op5_license_scan", "documents")
def op5(docs: DataFrame, folder: str) -> DataFrame:
    return licenses.scan_licenses(docs)


@query(
    "op9_quotation_linking",
    "conversations",
    r"""
    WITH told AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    copies AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) - 1 AS copy FROM told),
    turns AS (SELECT DISTINCT conv_id, turn FROM told),
    -- A conversation begins anew where the turn before is missing.
    runs AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM turns),
    firsts AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, run) AS first FROM runs)
    SELECT c.conv_id, c.turn, c.copy, CASE WHEN c.turn > f.first THEN c.turn - 1 END AS parent_turn, c.conv_id AS top_conv_id,
        f.first AS top_turn, CASE WHEN c.turn > f.first THEN 0 ELSE c.copy END AS top_copy, c.turn - f.first AS depth,
        sha256(regexp_replace(c.text, '^\s+|\s+$', '', 'g')) AS body_sha256
    FROM copies c JOIN firsts f USING (conv_id, turn)
    """,
)
def op9(turns: DataFrame, folder: str) -> DataFrame:
    linked = quotes.conversations(quotes.as_mail(turns))
    own, top, parent = (quotes.mail_numbers(F.col(c)) for c in ("message_id", "conversation_id", "parent_id"))
    body = F.sha2("body", 256).alias("body_sha256")
    return linked.select(
        *[c.alias(n) for c, n in zip(own, ("conv_id", "turn", "copy"), strict=True)], parent[1].alias("parent_turn"),
        *[c.alias(n) for c, n in zip(top, ("top_conv_id", "top_turn", "top_copy"), strict=True)], "depth", body,
    )


def _cluster_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Each round spelled out: assign, then floor of the mean, empty centroids unchanged."""
    apart = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v
            FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))""",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT k.place, min({{'d': {apart}, 'c': c.cluster}}) AS m FROM kept k, c{n} c GROUP BY k.place)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(w.v, c.v) AS v FROM c{n} c LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT m.c AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
                FROM a{n} JOIN kept USING (place), range(1, 65) t(i) GROUP BY ALL) GROUP BY cluster) w USING (cluster))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN kept USING (place) JOIN c{rounds} ON c{rounds}.cluster = m.c"""


@query("op11_walsh_hadamard", "embeddings", _cluster_sql())
def op11(vectors: DataFrame, folder: str) -> DataFrame:
    return walsh.cluster(vectors)


@query(
    "op12_fill_middle",
    "documents",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, CAST(length(x) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM t),
    v AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
          CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR g[3] % 100 >= 90 THEN 'plain'
               WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    w AS (SELECT *, substr(x, 1, a) AS p, substr(x, a + 1, b - a) AS m, substr(x, b + 1) AS s FROM v)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(x) AS restored_sha256
    FROM w
    """,
)
def op12(docs: DataFrame, folder: str) -> DataFrame:
    return fill_middle.fill_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


@query("op13_prefix_forest", "embeddings")
def op13(vectors: DataFrame, folder: str) -> DataFrame:
    return prefix_forest.nearest(vectors)
