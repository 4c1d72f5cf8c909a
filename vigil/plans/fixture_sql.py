"""DuckDB twins of ``vigil.sources.fixtures`` (label maps appear as their canonical text).

``with_views("samples", ...)`` returns a ``WITH`` clause holding the requested views and
everything they depend on, in dependency order.
"""

from __future__ import annotations

from vigil.sources.fixtures import COUNTER_WRAP, EVAL_END_US, T0_US, TIME_COMPRESSION

_V: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], sql: str) -> None:
    _V[name] = (deps, sql)


_view("base", [], f"""
SELECT event_id, user_id, event_type, value,
       CAST({T0_US} + (epoch_us(ts) - {T0_US}) // {TIME_COMPRESSION} AS BIGINT) AS t_us,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       'host-' || CAST(user_id % 25 AS VARCHAR) AS instance
FROM events""")

_view("gauges", ["base"], """
SELECT 'cpu_usage_percent' AS metric, 'instance=' || instance || ',job=probe' AS labels, instance, t_us,
       CAST(value % 100 AS DOUBLE) AS value, event_id FROM base WHERE event_type = 'view'
UNION ALL
SELECT 'memory_usage_percent', 'instance=' || instance || ',job=probe', instance, t_us,
       CAST(value % 100 AS DOUBLE), event_id FROM base WHERE event_type = 'click'
UNION ALL
SELECT 'disk_usage_percent', 'instance=' || instance || ',job=probe,mountpoint=' ||
       (CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '/data' ELSE '/var' END), instance, t_us,
       CAST(value % 100 AS DOUBLE), event_id FROM base WHERE event_type = 'purchase'
UNION ALL
SELECT 'up', 'instance=' || instance || ',job=probe', instance, t_us,
       CASE WHEN value > 100 THEN 0.0 ELSE 1.0 END, event_id FROM base WHERE event_type = 'error'""")

_view("raw_counters", ["base"], f"""
SELECT instance, 'eth' || CAST(k % 2 AS VARCHAR) AS iface, t_us, event_id,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY instance, 'eth' || CAST(k % 2 AS VARCHAR)
            ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % {COUNTER_WRAP} AS DOUBLE) AS value
FROM base WHERE event_type = 'signup'""")

_view("samples", ["gauges", "raw_counters"], """
SELECT metric, labels, instance, t_us, value, event_id, metric || '{' || labels || '}' AS series FROM gauges
UNION ALL
SELECT 'network_recv_bytes_total', 'iface=' || iface || ',instance=' || instance || ',job=probe', instance, t_us,
       value, event_id, 'network_recv_bytes_total{iface=' || iface || ',instance=' || instance || ',job=probe}'
FROM raw_counters""")

_view("requests", ["base"], """
SELECT event_id, t_us, instance, k, '10.0.0.' || CAST(user_id % 50 AS VARCHAR) AS client_ip,
       CASE k % 5 WHEN 0 THEN '/api/v1/hosts' WHEN 1 THEN '/api/v1/alerts'
                  WHEN 2 THEN '/api/v1/hosts/' || instance || '/metrics' WHEN 3 THEN '/ws/monitor'
                  ELSE '/metrics' END AS route,
       CAST(CASE WHEN event_type = 'error' AND value > 60 THEN 500 WHEN k % 17 = 0 THEN 404 ELSE 200 END AS INTEGER)
         AS status,
       value / 100 AS latency_s
FROM base""")

_view("http_counter", ["requests"], """
SELECT 'http_requests_total' AS metric,
       'instance=' || instance || ',job=web,path=' || route || ',status=' || CAST(status AS VARCHAR) AS labels,
       instance, t_us,
       CAST(count(*) OVER (PARTITION BY instance, route, status ORDER BY t_us, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value,
       event_id
FROM (SELECT * REPLACE (CASE WHEN regexp_full_match(route, '/api/v1/hosts/[^/]+/metrics') THEN '/api/v1/hosts/:instance/metrics'
                        ELSE route END AS route) FROM requests)""")

_view("http_buckets", ["requests"], """
SELECT 'http_request_duration_seconds_bucket' AS metric,
       'instance=' || instance || ',job=web,le=' || CASE WHEN le = 'Infinity'::DOUBLE THEN '+Inf'
                                                         ELSE CAST(le AS VARCHAR) END AS labels,
       instance, t_us,
       CAST(sum(CASE WHEN latency_s <= le THEN 1 ELSE 0 END) OVER (PARTITION BY instance, le ORDER BY t_us, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value,
       event_id, le
FROM requests, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 'Infinity'::DOUBLE]) AS le)""")

_view("logs", ["requests"], """
SELECT event_id, t_us,
       CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warn' ELSE 'info' END AS level,
       CASE WHEN status >= 500 THEN 'kafka publish failed' WHEN status >= 400 THEN 'route not found'
            ELSE 'request completed' END AS msg,
       CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'alert' ELSE 'probe' END AS service,
       instance,
       CASE WHEN k % 4 <> 0 THEN md5(CAST(event_id // 4 AS VARCHAR)) END AS trace_id,
       CASE WHEN k % 4 <> 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 16) END AS span_id,
       'req-' || CAST(event_id AS VARCHAR) AS request_id,
       CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
       route AS path, status, latency_s * 1000 AS latency_ms, client_ip,
       CASE WHEN status >= 500 AND k % 7 = 0
              THEN 'dial postgres://app:' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) || '@db:5432/metrics: timeout'
            WHEN status >= 500 AND k % 7 = 1 THEN 'upstream 401 Authorization: Bearer ' || md5(CAST(event_id AS VARCHAR))
            WHEN status >= 500 THEN 'upstream timeout'
            WHEN k % 29 = 0 THEN 'cookie rejected: Cookie: session=' || substr(md5(CAST(event_id AS VARCHAR)), 1, 16)
            WHEN k % 31 = 0 THEN 'bad request token=' || substr(md5(CAST(event_id AS VARCHAR)), 1, 20)
                                 || ' password=hunter' || CAST(k AS VARCHAR) END AS error,
       CASE WHEN status >= 500 AND k % 3 = 2 THEN
            CASE k % 5 WHEN 0 THEN 'cpu' WHEN 1 THEN 'memory' WHEN 2 THEN 'disk' WHEN 3 THEN 'network' ELSE 'load' END
       END AS collector,
       CASE WHEN status >= 500 THEN 'stderr' ELSE 'stdout' END AS stream
FROM requests""")

_view("alerts0", ["base"], """
SELECT event_id, t_us, instance, k,
       CASE WHEN event_type = 'error' AND value > 80 THEN 'HighCPU' ELSE 'HighMemory' END AS alertname,
       CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' END AS severity
FROM base WHERE event_type IN ('error', 'signup')""")

_view("alerts1", ["alerts0"], """
SELECT event_id, md5(instance || '|' || alertname || '|' || CAST(k % 2 AS VARCHAR)) AS fingerprint,
       CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'firing' END AS status, alertname, instance, severity,
       CAST(t_us - t_us % 600000000 AS BIGINT) AS starts_us,
       CASE WHEN k % 3 = 0 THEN t_us END AS ends_us, t_us AS received_us
FROM alerts0""")

_view("alerts", ["alerts1"], """
SELECT * FROM alerts1
UNION ALL
SELECT -1 - event_id, fingerprint, status, alertname, instance, severity, starts_us, ends_us,
       received_us + 400000000
FROM alerts1 WHERE event_id % 4 = 0""")

_view("host_groups", [], """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'hosts of ' || lower(r_name) AS description FROM region""")

_view("host_group_members", [], """
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS group_id,
       'host-' || CAST(n_nationkey AS VARCHAR) AS instance FROM nation""")

_view("rules", [], """
SELECT * FROM (VALUES
  (1, 'HighCPU', 'cpu_usage_percent', '', '>', 80.0, 120000, 'warning'),
  (2, 'CriticalCPU', 'cpu_usage_percent', '', '>', 95.0, 60000, 'critical'),
  (3, 'HighMemory', 'memory_usage_percent', '', '>', 85.0, 120000, 'warning'),
  (4, 'HighDisk', 'disk_usage_percent', '', '>', 90.0, 300000, 'warning'),
  (5, 'HostDown', 'up', 'probe', '==', 0.0, 60000, 'critical')
) AS t(id, name, metric, job, cmp, threshold, for_ms, severity)""")


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _V[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_V[n][1]}\n)" for n in order)


EVAL_END = EVAL_END_US
T0 = T0_US
