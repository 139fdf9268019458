"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm import centroids, exact_dedup, line_dedup, mixing, packing, phrases, pii, quality, setsketch, sharding, sphere_filters, token_codes, warc
from hubbub.llm.common import fresh_path, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = map(n, pii.BASE)
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"), scores)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-codes")
    token_codes.write_token_codes(_table(spark, sf_dir, "documents"), path, tokenizer_path=TOKENIZER, end_id=0)
    rows = token_codes.read_documents(token_codes.read_token_codes(spark, path))
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_sphere_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sphere_filters.near_vectors(_table(spark, sf_dir, "embeddings"), limit=0.9)
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path=TOKENIZER, end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "placed")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.where(quality.fold(F.col("doc_id")) != 0))
    rows = quality.score(docs, model)
    held_out = (quality.fold(F.col("doc_id")) == 0).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_copies=2, seed=7)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if the archive that is read back lacks records or holds others."""
    path, pages = fresh_path(spark, "warc"), _table(spark, sf_dir, "pages")
    warc.write_warc(pages, path, min_bytes=0)
    records = stage(warc.read_warc(spark, path, payloads=False).drop("payload"), "warc-headers")
    if (found := records.count()) != (wanted := pages.count()):
        raise ValueError(f"the archive has {found} records for {wanted} pages")
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = setsketch.near_duplicates(_table(spark, sf_dir, "documents"), setsketch.Plan(width=3, percent=85))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs, min_points=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), phrases.Plan(least=100, longest=5, top=2000))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, final = centroids.cluster(_table(spark, sf_dir, "embeddings"), centroids.Plan(k=16, rounds=3, dim=64, scale=64))
    rows = stage(rows, "clusters")
    of_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    digest = F.element_at(F.array(*map(F.lit, centroids.centroid_digests(final) or [""])), F.col("cluster") + 1).alias("centroid_sha256")
    rows = rows.join(F.broadcast(of_cluster), "cluster").crossJoin(F.broadcast(whole))  # sixteen rows and one
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def queries() -> dict:
    named = [
        op1_pii, op2_exact_dedup, op3_token_codes, op4_sphere_filters, op5_packing,
        op6_quality, op7_mixing, op8_warc, op9_setsketch, op10_line_dedup, op11_phrases, op12_centroids, op13_sharding,
    ]
    return {f.__name__: f for f in named}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_REACH = """
             reach AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT id, id FROM ids)
                       UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
             c AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""



def _centroid_sql(rounds: int = 3) -> str:
    """Exact k-means, each round spelled out."""
    distance = "CAST(list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        """v AS (SELECT row_number() OVER () AS node, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor(64 * e) AS BIGINT)) AS x FROM embeddings
                 WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, x LIMIT 16))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT v.node, min({{'d': {distance}, 'k': c.k}}) AS best FROM v CROSS JOIN c{r} c GROUP BY v.node)")
        if r < rounds:
            parts += [
                f"s{r} AS (SELECT best.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM v JOIN a{r} USING (node) CROSS JOIN range(1, 65) t(i) GROUP BY best.k, i)",
                f"m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k)",
                f"c{r + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (k))",
            ]
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} USING (node) JOIN c{rounds} c ON c.k = best.k"""


ORACLE_SQL = {
    "op11_phrases": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
             total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
             g AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w CROSS JOIN range(1, 6) s(size) WHERE len(w) >= size),
             f AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
             k AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c),
             x AS (SELECT k.lang, k.phrase, k.a, k.k, p.f AS l, q.f AS r, n, (CAST(1000 AS HUGEINT) * k.a * n) // (CAST(p.f AS HUGEINT) * q.f) AS score
                   FROM k JOIN f p ON p.lang = k.lang AND p.phrase = array_to_string(k.w[1 : k.k], ' ')
                   JOIN f q ON q.lang = k.lang AND q.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ') JOIN total ON total.lang = k.lang),
             s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM x),
             o AS (SELECT s.* FROM s WHERE cut = 1 AND NOT EXISTS
                   (SELECT 1 FROM c WHERE c.lang = s.lang AND c.size > len(string_split(s.phrase, ' ')) AND 100 * c.a >= 100 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
             r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000""",
    "op12_centroids": _centroid_sql(),
    "op4_sphere_filters": rf"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                             WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
                               AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
             ids AS (SELECT vec_id AS id FROM embeddings),
             links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id < q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
             n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),{_REACH}
        SELECT e.id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.id = component_id AS kept
        FROM ids e LEFT JOIN n USING (id) JOIN c USING (id)""",
    "op9_setsketch": rf"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             ids AS (SELECT id FROM w),
             s AS (SELECT DISTINCT id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS shingle
                   FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
             x AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM s p JOIN s q ON p.shingle = q.shingle AND p.id < q.id GROUP BY 1, 2),
             links AS (SELECT a, b FROM x JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE 100 * shared >= 85 * (p.n + q.n - shared)),{_REACH}
        SELECT e.id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, e.id = component_id AS kept
        FROM ids e LEFT JOIN n USING (id) JOIN c USING (id)""",
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             w AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                          first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op7_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size,
                          (CAST(('0x' || substr(md5('7:' || doc_id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
             w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
                          2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS goal FROM s),
             o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS nth FROM w),
             l AS (SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                          / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
             f AS (SELECT *, most <= level * weight AS full_up FROM l),
             g AS (SELECT *, arg_min(level, nth) FILTER (NOT full_up) OVER () AS cut FROM f),
             t AS (SELECT source, source_size, CASE WHEN full_up THEN most ELSE cut * weight END AS target FROM g),
             r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM t),
             e AS (SELECT *, target - certain * source_size AS remaining FROM r),
             k AS (SELECT source, length(bin(size)) AS k, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
             h AS (SELECT k.source, k, CAST(coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS above,
                          CAST(sum(words * k) OVER (PARTITION BY k.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below, remaining
                   FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
             c AS (SELECT source, arg_max(slope, k) AS slope FROM (SELECT source, k, CASE WHEN below > 0 THEN (remaining - above) / below ELSE 0 END AS slope FROM h)
                   WHERE slope * k < 1 GROUP BY source),
             q AS (SELECT d.*, e.source_size, e.target, e.certain, e.remaining, least(1.0::DOUBLE, coalesce(c.slope, 0) * length(bin(d.size))) AS p, e.remaining / e.source_size AS mean
                   FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
             x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN remaining > 0 THEN (u * (1 - p) * mean) / (u * (1 - p) * mean + p * (1 - u) * (1 - mean)) ELSE u END, doc_id, size
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
        SELECT doc_id, size, source_size, target,
               CAST(size * (certain + CASE WHEN remaining > 0 AND before + size / 2.0::DOUBLE <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
             w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to FROM w""",
    "op10_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             n AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM n),
             c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
             m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM k LEFT JOIN c USING (key))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
