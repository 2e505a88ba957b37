"""Landed tables derived from the given ones, in SQL that Spark and DuckDB read alike.

Each has, besides what an operator reads, the columns it was made from, so that an oracle can
say what must come out without taking the text apart again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = """
SELECT g.*, scheme || '://' || userinfo || '@' || host || ':' || CAST(port_text AS STRING) || '?' || query || extra || frag AS line
FROM (
  SELECT b.*,
    CASE p WHEN 0 THEN 'vless' WHEN 1 THEN 'trojan' ELSE CASE WHEN line_idx % 2 = 0 THEN 'hy2' ELSE 'hysteria2' END END AS scheme,
    CASE p WHEN 0 THEN '123e4567-e89b-12d3-a456-42661417400' || CAST(s AS STRING) ELSE 'pass%20' || CAST(s AS STRING) END AS userinfo,
    'Node' || CAST(h AS STRING) || '.example.org' AS host,
    CASE WHEN bad = 8 THEN 0 ELSE 443 + h % 3 END AS port_text,
    CASE p WHEN 0 THEN 'encryption=none&security=' || CASE t WHEN 0 THEN 'reality&pbk=AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA&sid=0123abcd' ELSE 'tls' END || '&fp=chrome&sni=www.example.com&type=' || tt
      WHEN 1 THEN 'security=tls&fp=firefox&sni=www.example.com&type=' || tt ELSE 'sni=www.example.com&alpn=h3' END
      || CASE WHEN p < 2 AND t IN (1, 3) THEN '&path=%2Fgate' ELSE '' END AS query,
    CASE bad WHEN 0 THEN '&allowInsecure=1' WHEN 1 THEN '&SNI=' WHEN 2 THEN '&fp=unknownbrowser' WHEN 3 THEN '&alpn=h2,http%2F2' WHEN 4 THEN '&security=none'
      WHEN 5 THEN CASE p WHEN 0 THEN '&flow=xtls-rprx-vision2' WHEN 1 THEN '&fp=' ELSE '&obfs=http' END
      WHEN 6 THEN '&type=weird'
      WHEN 9 THEN CASE p WHEN 0 THEN '&encryption=' WHEN 1 THEN CASE t WHEN 0 THEN '&x=1' WHEN 2 THEN '&mode=super' ELSE '&path=gate' END ELSE '&obfs=salamander' END
      ELSE '' END AS extra,
    CASE WHEN bad = 7 THEN '#@chan_' || CAST(10000 + h AS STRING) ELSE '#r' || CAST(line_idx AS STRING) END AS frag
  FROM (
    SELECT l_orderkey AS doc_idx, l_linenumber AS line_idx, l_partkey % 3 AS p, l_suppkey % 40 AS h, l_suppkey % 6 AS s, l_linenumber % 4 AS t,
      CASE l_linenumber % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'ws' WHEN 2 THEN 'grpc' ELSE 'websocket' END AS tt,
      (l_orderkey * 7 + l_linenumber + l_partkey) % 23 AS bad
    FROM lineitem
  ) b
) g
"""

#: What the static filter must say of a candidate, from the columns it was made of.
EXPECTED = f"""
SELECT c.*, CASE p WHEN 0 THEN 'vless' WHEN 1 THEN 'trojan' ELSE 'hysteria2' END AS protocol, lower(host) AS server, port_text AS port,
  CASE WHEN p = 0 THEN userinfo END AS username, CASE WHEN p > 0 THEN 'pass ' || CAST(s AS STRING) END AS secret,
  CASE WHEN bad = 4 THEN 'none' WHEN p = 0 AND t = 0 THEN 'reality' ELSE 'tls' END AS security,
  CASE WHEN p = 2 THEN 'udp' WHEN bad = 6 THEN 'weird' ELSE tt END AS transport,
  CASE bad WHEN 7 THEN 'telegram_channel_reference' WHEN 8 THEN 'invalid_or_unsupported' WHEN 0 THEN 'insecure_flag' WHEN 1 THEN 'missing_sni' WHEN 2 THEN 'unknown_fingerprint'
    WHEN 3 THEN 'invalid_alpn' WHEN 4 THEN 'missing_security' WHEN 5 THEN CASE p WHEN 0 THEN 'unsupported_flow' WHEN 1 THEN 'missing_fingerprint' ELSE 'unsupported_obfs' END
    WHEN 6 THEN CASE WHEN p < 2 THEN 'unsupported_transport' END
    WHEN 9 THEN CASE p WHEN 0 THEN 'missing_required_secret' WHEN 1 THEN CASE t WHEN 2 THEN 'invalid_grpc_mode' WHEN 0 THEN NULL ELSE 'invalid_ws_path' END ELSE 'missing_obfs_password' END
    END AS reason
FROM ({CANDIDATES}) c
"""

#: Accepted candidates in every transport, with flow, obfuscation and an ``extra`` object.
OUTBOUND = f"""
SELECT *, CASE p WHEN 0 THEN CASE WHEN t = 0 AND v > 1 THEN replace(line, '&fp=chrome', '&fp=chrome&flow=xtls-rprx-vision') ELSE moved END
  WHEN 1 THEN moved ELSE CASE WHEN v < 2 THEN replace(line, '&alpn=h3', '&alpn=h3&obfs=salamander&obfs-password=mist') ELSE line END END AS uri
FROM (
  SELECT *, doc_idx % 4 AS v, CASE WHEN t = 2 THEN replace(line, 'type=grpc', CASE doc_idx % 4 WHEN 0 THEN 'type=grpc&serviceName=unit&mode=multi'
    WHEN 1 THEN 'type=h2&path=%2Fdeep' WHEN 2 THEN 'type=httpupgrade&host=edge.example.net' ELSE 'type=xhttp&mode=auto&extra=%7B%22pad%22%3A%5B1%2C%22x%22%5D%7D' END) ELSE line END AS moved
  FROM ({CANDIDATES}) c WHERE bad >= 10
) m
"""

ATTEMPTS = """
SELECT 'node' || CAST(l_suppkey % 100 AS STRING) || '.example.org' AS host, 443 + l_partkey % 5 AS port, l_partkey % 2 = 0 AS use_tls,
  CASE WHEN l_partkey % 2 = 0 THEN 'www.example.com' ELSE '' END AS server_name, l_orderkey * 8 + l_linenumber AS attempt_no,
  l_returnflag <> 'R' AS responded, CASE l_linenumber % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'http_204' ELSE 'cloudflare_trace' END AS method,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) * 10 END AS latency_ms, CASE WHEN l_orderkey % 50 = 0 THEN 'doh' ELSE 'system' END AS resolution,
  CASE WHEN l_returnflag <> 'R' THEN 'TLSv1.' || CAST(CASE WHEN l_suppkey % 10 = 0 THEN 2 + l_orderkey % 2 ELSE 3 END AS STRING) END AS tls_version, 'AES' AS tls_cipher
FROM lineitem
"""

TRANSFERS = """
SELECT user_id AS profile_key, CAST(n AS DOUBLE) / 8 AS elapsed_s, bytes FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 20000 + (event_id * 7919) % 90000 AS bytes FROM events) e
"""

POSTS = """
SELECT 'chan_' || CAST(10000 + user_id % 400 AS STRING) AS handle, CAST(event_id AS STRING) AS message_id, event_id, ts AS published_at,
  CASE event_id % 4 WHEN 0 THEN 'no link today ' || CAST(event_id % 7 AS STRING)
    WHEN 1 THEN 'new trojan://pass' || CAST(event_id % 5 AS STRING) || '@node' || CAST(event_id % 9 AS STRING) || '.example.org:443?security=tls&sni=www.example.com&fp=chrome&type=tcp#a'
    WHEN 2 THEN 'two ss://abc' || CAST(event_id % 11 AS STRING) || '@x.example.org:1 trojan://pw@node' || CAST(event_id % 6 AS STRING) || '.example.org:443?security=tls&sni=www.example.com&fp=weird'
    ELSE 'see https://example.org/' || CAST(event_id % 3 AS STRING) END AS text
FROM events
"""


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query's rows over the given tables, read from sf_dir."""
    for name in ("lineitem", "orders", "events", "customer", "supplier", "documents", "pages"):
        if name in sql:
            sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)



def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as the session's shuffles have: a table that is one row group of one file is
    read by one task, and what it is made into would stay there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: State and pool of earlier runs; fingerprints overlap with this run's.
POOL = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'vless' WHEN 1 THEN 'trojan' ELSE 'hysteria2' END AS protocol, 'fp' || CAST(c_custkey AS STRING) AS fingerprint,
  'uri' || CAST(c_custkey AS STRING) AS uri, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS first_added_at,
  CASE c_custkey % 4 WHEN 0 THEN CAST('2024-01-20 00:00:00' AS TIMESTAMP) WHEN 1 THEN CAST('2024-01-21 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-22 00:00:00' AS TIMESTAMP) END AS last_seen_at,
  1 + c_custkey % 5 AS hits
FROM customer WHERE c_custkey % 5 <> 0
"""
CURRENT = """
SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'vless' WHEN 1 THEN 'trojan' ELSE 'hysteria2' END AS protocol, 'fp' || CAST(o_custkey AS STRING) AS fingerprint, 'new' || CAST(o_custkey AS STRING) AS uri
FROM orders WHERE o_orderkey % 3 = 0
"""
#: Metrics of one run for each channel, and the state that earlier runs left.
METRICS = """
SELECT 'chan_' || CAST(10000 + user_id AS STRING) AS handle, user_id % 17 <> 0 AS preview_available, n AS fresh_posts, n * 2 AS all_uri_candidates, n AS supported_candidates,
  n - CAST(floor(n / 3) AS INT) AS static_accepted, CAST(floor(n / 2) AS INT) AS unique_profiles, CAST(floor(n / 4) AS INT) AS duplicate_posts, n - CAST(floor(n / 5) AS INT) AS posts_with_profiles, n * (20 + user_id % 90) AS total_text_length,
  CAST(6 * (user_id % 9) AS DOUBLE) AS span_hours, n - CAST(floor(n / 3) AS INT) AS deep_passed, CAST(floor(n / 3) AS INT) AS deep_failed
FROM (SELECT user_id, CAST(count(*) AS INT) AS n FROM events GROUP BY user_id) e
"""
STATE = """
SELECT handle, CASE u % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'watch' WHEN 2 THEN 'excluded' ELSE 'candidate' END AS status, CAST(30 + u % 60 AS DOUBLE) AS score, 1 + u % 4 AS evidence_runs,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS first_seen_at, CASE u % 2 WHEN 0 THEN CAST('2024-01-30 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-28 00:00:00' AS TIMESTAMP) END AS last_evaluated_at,
  CAST(u % 10 AS DOUBLE) / 10 AS confidence, CAST(50 AS DOUBLE) AS required_score, u % 5 AS runs_since_evaluation, u % 7 AS deep_accepted, u % 6 AS deep_rejected
FROM (SELECT DISTINCT user_id AS u, 'chan_' || CAST(10000 + user_id AS STRING) AS handle FROM events WHERE user_id % 3 <> 0) e
"""

#: Texts that name a channel in one of several forms.
MENTIONS = """
SELECT l_orderkey * 8 + l_linenumber AS doc_idx, 'chan_' || CAST(10000 + l_suppkey AS STRING) AS handle,
  CASE l_partkey % 5 WHEN 0 THEN 'hello @Chan_' || CAST(10000 + l_suppkey AS STRING) || ' there' WHEN 1 THEN 'see https://t.me/s/chan_' || CAST(10000 + l_suppkey AS STRING) || '?before=1'
    WHEN 2 THEN 'go tg://resolve?domain=chan_' || CAST(10000 + l_suppkey AS STRING) WHEN 3 THEN 'at %40chan_' || CAST(10000 + l_suppkey AS STRING) ELSE 'none https://t.me/joinchat/abcdef' END AS text, l_partkey % 5 AS form
FROM lineitem
"""
PAGES = """
SELECT handle, CAST(event_id % 3 + 1 AS INT) AS page_no, event_id, message_id, published_at, text, CAST(-event_id AS INT) AS pos,
  '<div class="tgme_widget_message" data-post="' || handle || '/' || message_id || '"><div class="tgme_widget_message_text">' || replace(text, '&', '&amp;') || '</div><time datetime="' || CAST(published_at AS STRING) || '+00:00"></time></div>' AS html
FROM (SELECT handle, message_id, event_id, date_trunc('second', published_at) AS published_at, text FROM (POSTS) p) q
""".replace("POSTS", POSTS)
#: Landed pages of a channel's walk, by handle: the first failed, the second failed or is empty, or all
#: five there; failed and empty ones have no posts.
WALK = """
SELECT handle, page_no, event_id, message_id, published_at, pos, text, reason FROM (
  SELECT handle, CAST(1 + event_id % 5 AS INT) AS page_no, event_id, CAST(event_id % 900 AS STRING) AS message_id, published_at, CAST(-event_id AS INT) AS pos, text, CAST(substr(handle, 6) AS INT) % 6 AS kind,
    CASE WHEN CAST(substr(handle, 6) AS INT) % 6 = 0 AND event_id % 5 = 0 THEN 'http_500' WHEN CAST(substr(handle, 6) AS INT) % 6 = 1 AND event_id % 5 = 1 THEN 'timeout' END AS reason
  FROM (POSTS) q) p
WHERE TRUE
""".replace("POSTS", POSTS)
