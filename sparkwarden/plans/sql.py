"""Plain SQL forms of the operators, for comparing results in another engine.

``CTES`` are the driver tables seen as a security feed (the SQL twin of ``sources/adapter.py``). The functions return
further CTEs of a rule over an event CTE, written from the rule's definition, not from the Spark plan: windows, and
recursion from one firing to the next.
"""

from __future__ import annotations

CTES = """
ev AS (
  SELECT event_id AS event_seq, epoch_us(ts) AS ts_us, ts AS wall,
    CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'click' THEN 'CONNECTION' WHEN 'view' THEN 'ACCEPTED_LOGIN'
      WHEN 'signup' THEN 'BLOCKED' ELSE 'SUDO_COMMAND' END AS action,
    CASE event_type WHEN 'error' THEN 'medium' WHEN 'click' THEN 'low' WHEN 'view' THEN 'info'
      WHEN 'signup' THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN event_type <> 'purchase' THEN '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) END AS source_ip,
    CASE WHEN event_type NOT IN ('click', 'signup') THEN 'u' || (user_id // 3) END AS usr,
    'host' || (event_id % 7) AS hostname,
    CASE event_type WHEN 'purchase' THEN 'sudo' WHEN 'signup' THEN 'kernel' ELSE 'sshd' END AS service,
    CAST(event_id AS VARCHAR) AS pid,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE WHEN event_type <> 'purchase' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS port,
    strftime(ts, '%b %-d %H:%M:%S') AS clock
  FROM events),
ti AS (
  SELECT '10.0.' || (s_suppkey // 250) || '.' || (s_suppkey % 250 + 1) AS ip, s_suppkey * 37 % 101 AS score,
    'NATION_' || s_nationkey || ', FEED' AS tags
  FROM supplier),
body AS (
  SELECT event_seq, CASE action
      WHEN 'FAILED_LOGIN' THEN 'Failed password for ' || usr || ' from ' || source_ip || ' port ' || port || ' ssh2'
      WHEN 'ACCEPTED_LOGIN' THEN 'Accepted password for ' || usr || ' from ' || source_ip || ' port ' || port || ' ssh2'
      WHEN 'SUDO_COMMAND' THEN usr || ' : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/run' || k
      WHEN 'CONNECTION' THEN 'connection from ' || source_ip || ' port ' || port
      ELSE 'BLOCKED IN=eth0 SRC=' || source_ip || ' DST=10.1.0.1 DPT=' || port || ' PROTO=TCP' END AS body
  FROM ev)
"""


def with_ctes(query: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CTES.strip(), *[c.strip() for c in ctes]]) + "\n" + query.strip()


def brute_ctes(src: str, t: int, w_us: int) -> str:
    """``bff(key, i)``: firings as row numbers of ``bf``; ``bfe``: their evidence."""
    return f"""
bf AS (
  SELECT source_ip AS key, ts_us, event_seq, usr,
    row_number() OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS i,
    lag(ts_us, {t - 1}) OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS q
  FROM {src} WHERE action = 'FAILED_LOGIN' AND source_ip IS NOT NULL),
bfc AS (SELECT * FROM bf WHERE q >= ts_us - {w_us}),
bfn AS (SELECT a.key, a.i, min(c.i) AS nxt FROM bfc a JOIN bfc c ON c.key = a.key AND c.i >= a.i + {t} GROUP BY 1, 2),
bff AS (
  SELECT key, min(i) AS i FROM bfc GROUP BY key
  UNION ALL
  SELECT n.key, n.nxt FROM bff f JOIN bfn n ON n.key = f.key AND n.i = f.i),
bfe AS (
  SELECT f.key, k.ts_us AS trigger_ts, k.event_seq AS trigger_seq, e.event_seq, e.ts_us, e.usr
  FROM bff f JOIN bf k ON k.key = f.key AND k.i = f.i
  JOIN bf e ON e.key = f.key AND e.i BETWEEN f.i - {t - 1} AND f.i)
"""


def scan_ctes(src: str, n: int, w_us: int) -> str:
    """``psf(key, i)``: firings as row numbers of ``ps``; ``pse``: their evidence."""
    return f"""
ps AS (
  SELECT source_ip AS key, ts_us, event_seq, port, usr,
    row_number() OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS i
  FROM {src} WHERE source_ip IS NOT NULL AND port IS NOT NULL),
psn AS (
  SELECT key, s, min(k) AS nxt FROM (
    SELECT s.key, s.i AS s, k.i AS k
    FROM (SELECT key, i FROM ps UNION ALL SELECT DISTINCT key, 0 FROM ps) s
    JOIN ps k ON k.key = s.key AND k.i > s.i
    JOIN ps j ON j.key = k.key AND j.i > s.i AND j.i <= k.i AND j.ts_us >= k.ts_us - {w_us}
    GROUP BY 1, 2, 3 HAVING count(DISTINCT j.port) >= {n}) GROUP BY 1, 2),
psf AS (
  SELECT key, nxt AS i, s AS prev FROM psn WHERE s = 0
  UNION ALL
  SELECT n.key, n.nxt, n.s FROM psf f JOIN psn n ON n.key = f.key AND n.s = f.i),
pse AS (
  SELECT f.key, k.ts_us AS trigger_ts, k.event_seq AS trigger_seq, e.event_seq, e.ts_us, e.port, e.usr
  FROM psf f JOIN ps k ON k.key = f.key AND k.i = f.i
  JOIN ps e ON e.key = f.key AND e.i > f.prev AND e.i <= f.i AND e.ts_us >= k.ts_us - {w_us})
"""


def escalation_ctes(src: str, m: int, w_us: int) -> str:
    """``pef(key, i)``: firings as row numbers of ``pe``; ``pee``: their evidence."""
    return f"""
pe AS (
  SELECT usr AS key, ts_us, event_seq, action, source_ip, k,
    row_number() OVER (PARTITION BY usr ORDER BY ts_us, event_seq) AS i
  FROM {src} WHERE usr IS NOT NULL AND action IN ('FAILED_LOGIN', 'SUDO_COMMAND')),
pen AS (
  SELECT key, s, min(k) AS nxt FROM (
    SELECT s.key, s.i AS s, k.i AS k
    FROM (SELECT key, i FROM pe WHERE action = 'SUDO_COMMAND' UNION ALL SELECT DISTINCT key, 0 FROM pe) s
    JOIN pe k ON k.key = s.key AND k.i > s.i AND k.action = 'SUDO_COMMAND'
    JOIN pe j ON j.key = k.key AND j.i > s.i AND j.i < k.i AND j.ts_us >= k.ts_us - {w_us}
      AND j.action = 'FAILED_LOGIN'
    GROUP BY 1, 2, 3 HAVING count(*) >= {m}) GROUP BY 1, 2),
pef AS (
  SELECT key, nxt AS i, s AS prev FROM pen WHERE s = 0
  UNION ALL
  SELECT n.key, n.nxt, n.s FROM pef f JOIN pen n ON n.key = f.key AND n.s = f.i),
pee AS (
  SELECT f.key, k.ts_us AS trigger_ts, k.event_seq AS trigger_seq, k.k AS command, e.event_seq, e.ts_us, e.action
  FROM pef f JOIN pe k ON k.key = f.key AND k.i = f.i
  JOIN pe e ON e.key = f.key AND e.i > f.prev AND e.i <= f.i AND e.ts_us >= k.ts_us - {w_us}
    AND (e.action = 'FAILED_LOGIN' OR e.i = f.i))
"""


def blocks_ctes(t: int, bw_us: int, n: int, sw_us: int, min_score: int) -> str:
    """``blk``: first block per source over all events; ``kept`` and ``gone``: the events before and after it."""
    return f"""
b_brute AS (
  SELECT source_ip, ts_us, event_seq,
    lag(ts_us, {t - 1}) OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS q
  FROM ev WHERE action = 'FAILED_LOGIN' AND source_ip IS NOT NULL),
b_port AS (
  SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS i
  FROM ev WHERE source_ip IS NOT NULL AND port IS NOT NULL),
b_scan AS (
  SELECT k.source_ip, k.ts_us, k.event_seq FROM b_port k
  JOIN b_port j ON j.source_ip = k.source_ip AND j.i <= k.i AND j.ts_us >= k.ts_us - {sw_us}
  GROUP BY 1, 2, 3 HAVING count(DISTINCT j.port) >= {n}),
b_all AS (
  SELECT source_ip, ts_us, event_seq FROM b_brute WHERE q >= ts_us - {bw_us}
  UNION ALL SELECT * FROM b_scan
  UNION ALL SELECT e.source_ip, e.ts_us, e.event_seq FROM ev e JOIN ti ON ti.ip = e.source_ip
    WHERE ti.score >= {min_score}),
blk AS (
  SELECT source_ip, ts_us AS block_ts, event_seq AS block_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_us, event_seq) AS r FROM b_all) WHERE r = 1),
kept AS (
  SELECT e.* FROM ev e LEFT JOIN blk b ON b.source_ip = e.source_ip
  WHERE b.source_ip IS NULL OR e.ts_us < b.block_ts OR (e.ts_us = b.block_ts AND e.event_seq <= b.block_seq)),
gone AS (SELECT e.* FROM ev e WHERE e.event_seq NOT IN (SELECT event_seq FROM kept))
"""


def alerts_cte(name: str, src: str, cfg) -> str:
    """``name``: alerts of the four SQL-expressible rules over ``src``, one row each. Needs the rule CTEs over
    ``src`` before it."""
    return f"""
{name} AS (
  SELECT 'threat_intel_match' AS rule_name, 'critical' AS severity, e.source_ip, CAST(NULL AS VARCHAR) AS usr,
    CAST(NULL AS VARCHAR) AS description,
    'IP found in Threat Intelligence Platform. Reputation Score: ' || ti.score || '. Tags: [' || ti.tags || ']' AS context,
    1 AS evidence_count, e.event_seq AS trigger_seq, e.ts_us AS created_us, e.source_ip AS key
  FROM {src} e JOIN ti ON ti.ip = e.source_ip WHERE ti.score >= {cfg.intel_min_score}
  UNION ALL
  SELECT 'brute_force_ssh', 'high', key, NULL,
    'Brute force attack detected: ' || count(*) || ' failed login attempts from ' || key || ' within '
      || {cfg.brute_window_s} || ' seconds. Targeted user(s): '
      || string_agg(DISTINCT coalesce(usr, 'unknown'), ', ' ORDER BY coalesce(usr, 'unknown')),
    NULL, count(*), trigger_seq, trigger_ts, key
  FROM bfe GROUP BY key, trigger_seq, trigger_ts
  UNION ALL
  SELECT 'port_scan', 'high', key, NULL,
    'Port scan detected: ' || key || ' connected to ' || count(DISTINCT port) || ' unique ports within '
      || {cfg.scan_window_s} || ' seconds. Ports: ' || CAST(list_sort(list(DISTINCT port)) AS VARCHAR),
    NULL, count(*), trigger_seq, trigger_ts, key
  FROM pse GROUP BY key, trigger_seq, trigger_ts
  UNION ALL
  SELECT 'privilege_escalation', 'critical', 'local', key,
    'Potential privilege escalation: User ''' || key || ''' executed sudo command after ' || (count(*) - 1)
      || ' failed authentication attempt(s) within ' || {cfg.escalation_lookback_s} || 's. Command: /bin/run'
      || min(command),
    NULL, count(*), trigger_seq, trigger_ts, key
  FROM pee GROUP BY key, trigger_seq, trigger_ts)
"""
