"""The given star-schema tables seen as posts, labels, runs, registry events, CVE records and edges.

Every adapted table is one SELECT that Spark and DuckDB both read, so a query and its twin start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-29 00:00:00"

_TEXT = """CASE event_id % 12
      WHEN 0 THEN 'Breaking: data breach at a hospital in Toronto https://news.example.com/a/' || CAST(k AS STRING)
      WHEN 1 THEN 'New vulnerability CVE-2024-' || CAST(1000 + k AS STRING) || ' exploited, patch now' || CASE WHEN k % 4 = 1 THEN ' at shop.supplier' || CAST(user_id % 10 AS STRING) || '.example.com' ELSE '' END
      WHEN 2 THEN 'lol'
      WHEN 3 THEN 'Phishing campaign targets bank customers in Canada, see https://www.sec.example.org/x.'
      WHEN 4 THEN 'Great weather today in the park with @friend'
      WHEN 5 THEN 'Ransomware gang lists Supplier#' || lpad(CAST(user_id % 10 AS STRING), 9, '0') || ' as a victim' || CASE WHEN k % 3 = 0 THEN ' (www.Supplier' || CAST(user_id % 10 AS STRING) || '.example.com)' ELSE '' END
      WHEN 6 THEN 'Malware analysis thread: loader drops payload https://blog.example.net/post/' || CAST(k % 7 AS STRING) || '?x=1'
      WHEN 7 THEN 'Reading about Ottawa politics and elections in parliament'
      WHEN 8 THEN 'DDoS attack against a provincial website in Quebec reported by officials'
      WHEN 9 THEN 'cve-2023-' || CAST(20000 + k AS STRING) || ' and CVE-2024-1001 were both patched today'
      WHEN 10 THEN 'ok'
      ELSE '  Password  leak affects users of Customer#' || lpad(CAST(user_id AS STRING), 9, '0') || ', says  a report ' END"""

VIEWS: dict[str, str] = {
    "base": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "posts": f"""SELECT event_id AS post_id, 's' || CAST(event_id % 3 AS STRING) AS source_key, 'p' || CAST(event_id AS STRING) AS source_post_id,
      'u' || CAST(user_id AS STRING) AS author_id, '@u' || CAST(user_id AS STRING) AS author_handle, ts AS published_at,
      ts + INTERVAL '1' HOUR * (event_id % 72 * CASE WHEN event_id % 5 = 0 THEN 4 ELSE 1 END) AS collected_at, {_TEXT} AS text, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'fr' ELSE 'en' END AS lang,
      CASE WHEN user_id % 10 < 2 THEN 0 ELSE k % 5 END AS like_count,
      CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 10 < 2 THEN 0 ELSE k % 3 END AS repost_count, k % 4 AS reply_count,
      event_id % 97 AS run_id, 'at://p/' || CAST(event_id AS STRING) AS uri,
      CASE WHEN k % 3 = 0 AND event_id > 10 THEN 'at://p/' || CAST(event_id - k % 9 - 1 AS STRING) END AS in_reply_to, k FROM base""",
    "labels": """SELECT event_id AS post_id, 'v1' AS label_version, event_id % 2 = 0 AS is_cyber, event_id % 3 = 0 AS is_canada, event_id % 4 <> 0 AS is_relevant,
      CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS topic_key, event_id % 12 IN (2, 10) AS low_info, 'rules' AS derived_chain FROM base
      UNION ALL SELECT event_id, 'v2', CASE WHEN event_id % 21 = 0 OR (event_id % 7 = 0 AND ts >= TIMESTAMP '2024-01-26 00:00:00') THEN NULL ELSE event_id % 2 = 0 END, event_id % 5 = 0, (event_id % 4 <> 0) <> (event_id % 17 = 0),
      CASE WHEN event_id % 11 = 0 THEN 'view' WHEN event_type = 'signup' THEN NULL ELSE event_type END, event_id % 12 IN (2, 10),
      CASE WHEN event_id % 2 = 0 THEN 'rules>model' ELSE 'model' END FROM base""",
    "runs": """SELECT event_id % 97 AS run_id, 's' || CAST(event_id % 97 % 3 AS STRING) AS source_key,
      CASE event_id % 97 % 4 WHEN 0 THEN 'backfill' WHEN 1 THEN 'oracle' ELSE 'incremental' END AS mode,
      CASE event_id % 97 % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'running' ELSE 'success' END AS status,
      min(ts) AS window_start, max(ts) AS window_end, max(ts) + INTERVAL '1' HOUR * (event_id % 97) AS started_at, event_id % 97 % 4 AS n_errors, count(*) AS n_fetched,
      CASE WHEN event_id % 97 % 6 < 2 THEN 'timeout on page ' || CAST(event_id % 97 % 3 AS STRING) END AS detail FROM base GROUP BY event_id % 97""",
    "registry": """SELECT 'RW:' || CAST(s_suppkey AS STRING) AS event_id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'CA' ELSE 'US' END AS country,
      CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 12:00:00' + INTERVAL '1' DAY * (s_suppkey % 28) END AS published_at,
      TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' DAY * (s_suppkey % 28) AS discovered_at,
      'https://www.supplier' || CAST(s_suppkey AS STRING) || '.example.com/about' AS website FROM supplier""",
    "cve_records": """SELECT 'CVE-2024-' || CAST(1000 + p_partkey AS STRING) AS cve_id, CAST(p_partkey % 100 AS DOUBLE) / 10 AS cvss, p_partkey % 5 = 0 AS known_exploited FROM part""",
    "edges": """SELECT event_id AS edge_no, (event_id - k % 9 - 1) - (event_id - k % 9 - 1) % 20 AS seed_id, event_id - k % 9 - 1 AS target_id, 'u' || CAST(user_id AS STRING) AS actor,
      CASE event_type WHEN 'error' THEN 'repost' WHEN 'purchase' THEN 'quote' ELSE 'reply' END AS edge_type, CASE WHEN (event_id - k % 9 - 1) % 20 = 0 THEN 1 ELSE 2 END AS depth,
      ts AS event_time, event_id % 3 AS run_id FROM base WHERE event_id > 40""",
    "seeds": """SELECT event_id AS seed_id, 'u' || CAST(user_id AS STRING) AS author_id, ts AS created_at, event_type AS topic_key, k % 4 AS reply_count,
      event_id % 3 <> 0 AS in_main, event_id % 60 = 0 AS in_legacy, event_id % 12 = 1 OR event_id % 12 = 9 OR event_id % 40 = 0 AS has_cve,
      CASE user_id % 4 WHEN 0 THEN 'broadcast' WHEN 1 THEN 'news' ELSE 'person' END AS actor_type FROM base WHERE event_id % 20 = 0""",
    "outcomes": """SELECT r.run_id, s.seed_id, e.endpoint, CASE (CAST(floor(s.seed_id / 20) AS BIGINT) + r.run_id * 3 + length(e.endpoint)) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'partial' ELSE 'success' END AS outcome
      FROM seeds s CROSS JOIN (SELECT 0 AS run_id UNION ALL SELECT 1 UNION ALL SELECT 2) r CROSS JOIN (SELECT 'thread' AS endpoint UNION ALL SELECT 'quotes') e""",
    "fetches": """SELECT run_id, seed_id, endpoint, page, (seed_id + page * 7) % 11 > 1 AS ok, CASE (seed_id + page * 7) % 11 WHEN 0 THEN 'not_found' WHEN 1 THEN 'server_error' END AS error, page = 3 AND max(n) > 6 AS capped, array_agg(item) AS items
      FROM (SELECT CAST(floor(seed_id / 20) AS BIGINT) % 3 AS run_id, seed_id, edge_type AS endpoint, actor AS item, count(*) OVER (PARTITION BY seed_id, edge_type) AS n, CAST(floor((row_number() OVER (PARTITION BY seed_id, edge_type ORDER BY edge_no) - 1) / 2) AS BIGINT) + 1 AS page FROM edges WHERE edge_type <> 'reply') x
      WHERE page <= 3 GROUP BY run_id, seed_id, endpoint, page""",
    "verdicts": """SELECT event_id AS post_id, CASE event_id % 6 WHEN 0 THEN '{"topic": "' || event_type || '", "confidence": "high", "rationale": "clear"}'
      WHEN 1 THEN 'Sure! "topic": "' || event_type || '", "confidence": "medium" and so on' WHEN 2 THEN '{"confidence": "low"}' WHEN 3 THEN '{"topic": "other"}'
      WHEN 4 THEN '{"topic": "view", "confidence": "certain", "off_topic": true}' END AS answer FROM base""",
    "entities": """SELECT event_id AS post_id, 'v2' AS label_version, CASE user_id % 4 WHEN 0 THEN 'toronto' WHEN 1 THEN 'Canada' WHEN 2 THEN 'news.example.com' ELSE 'Quebec' END AS entity,
      CASE WHEN user_id % 4 = 2 THEN 'domain' ELSE 'place' END AS kind FROM base WHERE event_id % 2 = 0
      UNION ALL SELECT event_id, 'v2', 'sec.example.org', 'domain' FROM base WHERE event_id % 12 = 3 UNION ALL SELECT event_id, 'v2', 'canada', 'place' FROM base WHERE event_id % 12 = 3""",
    "relevant": """SELECT p.*, l.topic_key, coalesce(l.topic_key, 'other') AS topic, l.low_info, l.is_cyber, l.is_canada FROM posts p JOIN labels l ON p.post_id = l.post_id AND l.label_version = 'v1' WHERE l.is_relevant""",
}

SHARED_SQL = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())


class Tables:
    """The given and the adapted tables of one folder, as DataFrames, made when first asked for."""

    GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._adapt(name) if name in VIEWS else self.given(name)
        return self._made[name]

    def _adapt(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")  # literal braces, as spark.sql fills in names
        used = [v for v in (*VIEWS, *self.GIVEN) if v != name and re.search(rf"\b(FROM|JOIN) {v}\b", text)]
        return self.spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **{v: getattr(self, v) for v in used})
