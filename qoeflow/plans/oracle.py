"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code: the expected results are
computed from the base tables with plain SQL (window functions, recursive
CTEs), using the same parameters.
"""

from __future__ import annotations

from qoeflow.plans import params as P

SQL: dict[str, str] = {}

G = P.GAMMA

UPDATES = f"""updates AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS group_id, event_type AS decision,
         value AS cost, CAST(floor(epoch(ts) / {P.TICK_S}) AS BIGINT) AS tick
  FROM events)"""

STATS = """stats AS (
  SELECT group_id, decision, tick, sum(-cost) AS score_sum, count(*) AS n
  FROM updates GROUP BY group_id, decision, tick)"""


def dstate(src: str = "stats", name: str = "dstate", at: str | None = None) -> str:
    """Discounted state at tick T (default: latest tick of ``src``)."""
    t = at if at is not None else f"(SELECT max(tick) FROM {src})"
    return f"""{name} AS (
  SELECT group_id, decision, sum(score_sum * pow({G}, x)) AS score_sum,
         sum(n * pow({G}, x)) AS n, max(tick) AS last_tick
  FROM (SELECT *, (na - ra) + (T - tick) - (ng - rg) AS x
        FROM (SELECT *, max(rg) OVER (PARTITION BY group_id) AS ng
              FROM (SELECT s.*, t.T,
                           dense_rank() OVER (PARTITION BY group_id ORDER BY tick) AS rg,
                           row_number() OVER (PARTITION BY group_id, decision ORDER BY tick) AS ra,
                           count(*) OVER (PARTITION BY group_id, decision) AS na
                    FROM {src} s, (SELECT {t} AS T) t
                    WHERE s.tick <= t.T) a) b) c
  GROUP BY group_id, decision)"""


def ucb_rec(src: str = "dstate", name: str = "ucb", key: str = "group_id") -> str:
    """Recursive CTE of the greedy slot loop; ``key`` may be a column list."""
    keys = [k.strip() for k in key.split(",")]
    kl = ", ".join(keys)
    sc = (f"CASE WHEN n > 0 THEN mean + (CASE WHEN NN > 1 THEN {P.BONUS} * sqrt(2 * ln(NN)) "
          f"ELSE 0 END) / sqrt(n) ELSE 0 END")
    return f"""{name}_r(step, {kl}, decision, mean, n, NN, pick) AS (
  SELECT 0, {kl}, decision, CASE WHEN n > 0 THEN score_sum / n ELSE 0 END, n,
         sum(n) OVER (PARTITION BY {kl}), CAST(NULL AS VARCHAR)
  FROM {src}
  UNION ALL
  SELECT step + 1, {kl}, decision, mean,
         (n + CASE WHEN decision = best THEN 1 ELSE 0 END) * {G}, (NN + 1) * {G}, best
  FROM (SELECT *, first_value(decision) OVER (PARTITION BY {kl} ORDER BY sc DESC, decision) AS best
        FROM (SELECT *, {sc} AS sc FROM {name}_r WHERE step < {P.SLOTS}) t1) t2
),
{name} AS (
  SELECT {kl}, string_agg(pick, ':' ORDER BY step) AS slots
  FROM (SELECT DISTINCT {kl}, step, pick FROM {name}_r WHERE step > 0) u
  GROUP BY {kl})"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


SQL["tick_stats"] = with_(UPDATES, STATS) + """
SELECT group_id, decision, tick, CAST(round(CAST(score_sum AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_sum, n FROM stats"""

SQL["discounted_state"] = with_(UPDATES, STATS, dstate()) + """
SELECT group_id, decision, CAST(round(CAST(score_sum AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_sum, CAST(round(CAST(n AS DECIMAL(38,12)), 4) AS DOUBLE) AS n,
       CAST(round(CAST(CASE WHEN n > 0 THEN score_sum / n ELSE 0 END AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean, last_tick
FROM dstate"""

SQL["ucb_slots"] = with_(UPDATES, STATS, dstate(), ucb_rec(), recursive=True) + """
SELECT group_id, slots FROM ucb"""

SQL["decision_map"] = with_(UPDATES, STATS, """per_d AS (
  SELECT group_id, decision, sum(score_sum) AS s, sum(n) AS n FROM stats GROUP BY group_id, decision)""") + """
SELECT group_id, string_agg(decision, ',' ORDER BY decision) AS decisions,
       CAST(sum(n) AS BIGINT) AS n_total, CAST(round(CAST(sum(s) AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_total
FROM per_d GROUP BY group_id"""

MEANS = """means AS (
  SELECT group_id, decision, n, CASE WHEN n > 0 THEN score_sum / n ELSE 0 END AS mean,
         sum(n) OVER (PARTITION BY group_id) AS NN
  FROM dstate)"""

SQL["group_means"] = with_(UPDATES, STATS, dstate(), MEANS) + """
SELECT group_id, decision, CAST(round(CAST(mean AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean, CAST(round(CAST(NN AS DECIMAL(38,12)), 4) AS DOUBLE) AS "N" FROM means"""

SQL["state_merge"] = with_(UPDATES, STATS, dstate()) + """
SELECT group_id, decision, CAST(round(CAST(score_sum AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_sum, CAST(round(CAST(n AS DECIMAL(38,12)), 4) AS DOUBLE) AS n FROM dstate"""

SQL["ucb_index"] = with_(UPDATES, STATS, dstate(), MEANS) + f"""
SELECT group_id, decision, CAST(round(CAST(mean AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean, CAST(round(CAST(NN AS DECIMAL(38,12)), 4) AS DOUBLE) AS "N", CAST(round(CAST(ucb AS DECIMAL(38,12)), 4) AS DOUBLE) AS ucb,
       CAST(rank() OVER (PARTITION BY group_id ORDER BY ucb DESC, decision) AS BIGINT) AS rnk
FROM (SELECT *, CASE WHEN n > 0 THEN mean + (CASE WHEN NN > 1 THEN {P.BONUS} * sqrt(2 * ln(NN))
                 ELSE 0 END) / sqrt(n) ELSE 0 END AS ucb FROM means) u"""

EG = f"""wstate AS (
  SELECT group_id, decision, sum(score_sum) AS s, sum(n) AS n
  FROM stats, (SELECT max(tick) AS T FROM stats) t
  WHERE tick <= t.T AND tick > t.T - {P.EG_WINDOW_TICKS}
  GROUP BY group_id, decision),
eg AS (
  SELECT group_id, decision,
         first_value(decision) OVER (PARTITION BY group_id ORDER BY s / n DESC, decision) AS best
  FROM wstate)"""

SQL["best_decision"] = with_(UPDATES, STATS, EG) + f"""
SELECT group_id, best,
       coalesce(string_agg(CASE WHEN decision <> best THEN decision END, ',' ORDER BY decision), '') AS rest,
       CAST({P.EPSILON} AS DOUBLE) AS epsilon
FROM eg GROUP BY group_id, best"""

SQL["sliding_stats"] = with_(UPDATES, STATS) + f"""
SELECT group_id, decision, tick, CAST(round(CAST(sum(score_sum) OVER w AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_sum,
       CAST(sum(n) OVER w AS BIGINT) AS n
FROM stats
WINDOW w AS (PARTITION BY group_id, decision ORDER BY tick
             RANGE BETWEEN {P.EG_WINDOW_TICKS - 1} PRECEDING AND CURRENT ROW)"""

SQL["epsilon_export_lines"] = with_(UPDATES, STATS, EG) + f"""
SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS pos, CAST(CAST({P.EPSILON} AS DOUBLE) AS VARCHAR) AS line FROM eg
UNION ALL SELECT DISTINCT group_id, CAST(1 AS BIGINT), best FROM eg
UNION ALL SELECT group_id, CAST(1 + row_number() OVER (PARTITION BY group_id ORDER BY decision) AS BIGINT),
                 decision FROM eg WHERE decision <> best"""

SQL["custom_policy"] = with_(UPDATES, STATS, dstate(), MEANS) + """
SELECT DISTINCT group_id,
       first_value(decision) OVER (PARTITION BY group_id ORDER BY mean DESC, decision) AS decision
FROM means"""

LAST_T = "(SELECT max(tick) FROM stats)"


def snapshots() -> list[str]:
    ds = [dstate("stats", f"ds{k}", f"{LAST_T} - {k}") for k in P.SNAPSHOT_BACK]
    union = " UNION ALL ".join(f"SELECT {LAST_T} - {k} AS snap, * FROM ds{k}" for k in P.SNAPSHOT_BACK)
    return ds + [f"dsnap AS ({union})", ucb_rec("dsnap", "ucbs", "snap, group_id")]


SQL["latest_decision"] = with_(UPDATES, STATS, *snapshots(), recursive=True) + """
SELECT group_id, arg_max(slots, snap) AS slots, CAST(max(snap) AS BIGINT) AS tick
FROM ucbs GROUP BY group_id"""

SQL["format_decisions"] = with_(UPDATES, STATS, *snapshots(), recursive=True) + f"""
SELECT group_id, CAST(snap AS BIGINT) AS tick,
       concat(group_id, ';', slots, ':', ';', '{P.ORIGIN}') AS message,
       group_id AS decoded_group, CAST(len(string_split(slots, ':')) AS BIGINT) AS n_slots
FROM ucbs"""

# ----------------------------------------------------------- record plumbing
TAB = "chr(9)"
COST_TXT = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"

SQL["parse_updates"] = """
SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS group_id, event_type AS decision,
       CAST(round(CAST(-CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS DECIMAL(38,12)), 4) AS DOUBLE) AS score
FROM events"""

SQL["project_labels"] = f"""
SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS group_id,
       concat(event_type, {TAB}, {COST_TXT}) AS update
FROM events"""

ROUTED = f"""msg AS (
  SELECT event_id, ts, CAST(user_id % 40 AS VARCHAR) AS group_id,
         concat(event_type, {TAB}, {COST_TXT}) AS reduced
  FROM events),
routed AS (
  SELECT m.*, coalesce('c' || CAST(n.n_regionkey AS VARCHAR), '{P.ME}') AS cluster_id
  FROM msg m LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = m.group_id)"""

SQL["route_topics"] = with_(ROUTED) + f"""
SELECT event_id, group_id, cluster_id,
       CASE WHEN cluster_id = '{P.ME}' THEN 'internal_groups' ELSE 'external_groups' END AS topic,
       CAST(json_object('update', reduced, 'group_id', group_id, 'cluster_id', cluster_id) AS VARCHAR) AS message,
       CASE WHEN cluster_id <> '{P.ME}' THEN lower(r.r_name) || ':9092' END AS address
FROM routed LEFT JOIN region r ON 'c' || CAST(r.r_regionkey AS VARCHAR) = routed.cluster_id"""

SQL["auto_subscribe"] = with_(ROUTED) + f"""
SELECT group_id, arg_min(cluster_id, event_id) AS cluster_id, group_id || ';{P.ME}' AS message
FROM routed WHERE cluster_id <> '{P.ME}' GROUP BY group_id"""

SQL["feature_histogram"] = f"""
WITH s AS (
  SELECT * FROM events
  WHERE CAST(concat('0x', substr(md5('{P.SEED}:' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
        < {P.SAMPLE_FRACTION} * 4294967296.0),
f AS (
  SELECT 0 AS feature_idx, CAST(event_id AS VARCHAR) AS value FROM s
  UNION ALL SELECT 1, json_extract_string(props, '$.k') FROM s
  UNION ALL SELECT 2, CAST(user_id % 7 AS VARCHAR) FROM s)
SELECT CAST(feature_idx AS BIGINT) AS feature_idx, value, count(*) AS n FROM f GROUP BY ALL"""

SQL["heartbeats"] = with_(ROUTED) + f"""
SELECT *, CAST(sum(n_records) OVER (PARTITION BY tick) AS BIGINT) AS n_batch FROM (
  SELECT CAST(floor(epoch(ts) / {P.TICK_S}) AS BIGINT) AS tick, cluster_id,
         count(*) AS n_records, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_ts
  FROM routed GROUP BY ALL) h"""

SUBS = """subs AS (
  SELECT CAST(o_custkey % 150 AS VARCHAR) AS group_id,
         'c' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 5 AS VARCHAR) AS cluster_id
  FROM orders)"""

SQL["subscriber_sets"] = with_(SUBS) + """
SELECT group_id, string_agg(DISTINCT cluster_id, ',' ORDER BY cluster_id) AS clusters,
       count(DISTINCT cluster_id) AS n_clusters
FROM subs GROUP BY group_id"""

LATEST = """latest AS (
  SELECT group_id, arg_max(slots, snap) AS slots FROM ucbs GROUP BY group_id)"""

SQL["decision_fanout"] = with_(UPDATES, STATS, *snapshots(), LATEST, SUBS, recursive=True) + f"""
SELECT DISTINCT l.group_id, s.cluster_id, concat(l.group_id, ';', l.slots, ':', ';', '{P.ORIGIN}') AS message
FROM latest l JOIN subs s ON s.group_id = l.group_id
WHERE s.cluster_id <> '{P.ME}'"""

# ------------------------------------------------------- grouping and serving
CANDS_EVEN = ",".join(P.DECISION_TYPES[:4])
CANDS_ALL = ",".join(P.DECISION_TYPES)

SQL["request_candidates"] = f"""
SELECT o_orderkey AS req_id, CAST(o_custkey % 150 AS VARCHAR) AS asn,
       o_orderstatus || {TAB} || o_orderpriority AS head,
       CASE WHEN o_orderkey % 2 = 0 THEN '{CANDS_EVEN}' ELSE '{CANDS_ALL}' END AS candidates,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 5 END AS BIGINT) AS n_candidates,
       o_orderkey % 2 = 1 AS has_view
FROM orders"""

RULE_IDX = """st AS (SELECT DISTINCT o_orderstatus AS s FROM orders),
si AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM st),
cp AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders),
pj AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) - 1
               + CASE WHEN s = 'F' AND p > '3-MEDIUM'
                       AND EXISTS (SELECT 1 FROM cp c2 WHERE c2.s = 'F' AND c2.p = '3-MEDIUM')
                      THEN 1 ELSE 0 END AS j
       FROM cp)"""


def _lp(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 3, '0')"


SQL["rule_flatten"] = with_(RULE_IDX) + f"""
SELECT {_lp('i')} AS path, '0=P' AS conds, CAST(1 AS BIGINT) AS n_conds, 'P' AS group_id
FROM si WHERE s = 'P'
UNION ALL
SELECT {_lp('si.i')} || '.' || {_lp('pj.j')}, '0=' || pj.s || ';1=' || pj.p, 2, pj.s || '-' || pj.p
FROM pj JOIN si USING (s) WHERE pj.s <> 'P' AND (pj.p LIKE '1-%' OR pj.p LIKE '2-%')
UNION ALL
SELECT {_lp('si.i')} || '.' || {_lp('pj.j + 1')}, '0=F;1=3-MEDIUM', 2, 'F-3-MEDIUM-dup'
FROM pj JOIN si USING (s) WHERE pj.s = 'F' AND pj.p = '3-MEDIUM'
UNION ALL
SELECT {_lp('si.i')} || '.' || {_lp('pj.j')} || '.' || {_lp('CASE WHEN m < 3 THEN m ELSE m - 1 END')},
       '0=' || pj.s || ';1=' || pj.p || ';2=' || CAST(m AS VARCHAR), 3,
       pj.s || '-' || pj.p || '-' || CAST(m AS VARCHAR)
FROM pj JOIN si USING (s), (SELECT unnest([0, 1, 2, 4, 5, 6]) AS m) ms
WHERE pj.s <> 'P' AND NOT (pj.p LIKE '1-%' OR pj.p LIKE '2-%')"""

RULE_GROUP = """rq AS (
  SELECT o_orderkey AS req_id, o_orderstatus AS s, o_orderpriority AS p, o_custkey % 7 AS m,
         CAST(o_custkey % 150 AS VARCHAR) AS asn,
         CASE WHEN o_orderkey % 2 = 0 THEN ['click', 'error', 'purchase', 'signup']
              ELSE ['click', 'error', 'purchase', 'signup', 'view'] END AS candidates
  FROM orders),
grouped AS (
  SELECT req_id, candidates, asn,
         CASE WHEN s = 'P' THEN 'P'
              WHEN p LIKE '1-%' OR p LIKE '2-%' THEN s || '-' || p
              WHEN s = 'F' AND p = '3-MEDIUM' THEN 'F-3-MEDIUM-dup'
              WHEN m <> 3 THEN s || '-' || p || '-' || CAST(m AS VARCHAR)
              ELSE asn END AS group_id,
         NOT (s <> 'P' AND NOT (p LIKE '1-%' OR p LIKE '2-%') AND NOT (s = 'F' AND p = '3-MEDIUM')
              AND m = 3) AS matched
  FROM rq)"""

SQL["rule_match"] = with_(RULE_GROUP) + """
SELECT req_id, group_id, matched FROM grouped"""


def _h(tag: str, key: str = "req_id") -> str:
    return (f"CAST(concat('0x', substr(md5('{P.SEED}:{tag}:' || CAST({key} AS VARCHAR)), 1, 8)) "
            f"AS BIGINT)")


FALLBACK = f"candidates[{_h('fallback')} % len(candidates) + 1]"


def _finish(pick: str) -> str:
    ok = f"(({pick}) IS NOT NULL AND ({pick}) NOT IN ('', '0') AND list_contains(candidates, {pick}))"
    return (f"CASE WHEN {ok} THEN {pick} ELSE {FALLBACK} END AS decision, "
            f"CASE WHEN {ok} THEN 'policy' ELSE 'fallback' END AS source")


SQL["assign_slots"] = with_(UPDATES, STATS, *snapshots(), LATEST, RULE_GROUP, recursive=True) + f"""
SELECT req_id, group_id, {_finish('pick')}
FROM (SELECT g.*, CASE WHEN l.slots IS NOT NULL THEN
                    string_split(l.slots, ':')[{_h('slot')} % len(string_split(l.slots, ':')) + 1] END AS pick
      FROM grouped g LEFT JOIN latest l USING (group_id)) x"""

SQL["assign_epsilon"] = with_(UPDATES, STATS, EG, RULE_GROUP) + f""",
egd AS (
  SELECT group_id, any_value(best) AS best,
         coalesce(list(decision ORDER BY decision) FILTER (WHERE decision <> best), []) AS rest
  FROM eg GROUP BY group_id)
SELECT req_id, group_id, {_finish('pick')}
FROM (SELECT g.req_id, g.candidates, g.asn AS group_id,
             CASE WHEN e.best IS NULL THEN NULL
                  WHEN len(e.rest) = 0 THEN e.best
                  WHEN {_h('eps')} % 101 < CAST({P.EPSILON} AS DOUBLE) * 100
                       THEN e.rest[{_h('explore')} % len(e.rest) + 1]
                  ELSE e.best END AS pick
      FROM grouped g LEFT JOIN egd e ON e.group_id = g.asn) x"""

SQL["assign_weighted"] = with_(UPDATES, STATS, RULE_GROUP) + f""",
wn AS (SELECT group_id, decision, sum(n) AS n FROM stats GROUP BY ALL),
w AS (SELECT group_id, decision,
             row_number() OVER (PARTITION BY group_id ORDER BY decision) AS pos,
             (200 * n + sum(n) OVER (PARTITION BY group_id)) // (2 * sum(n) OVER (PARTITION BY group_id)) AS pct
      FROM wn),
wc AS (SELECT *, sum(pct) OVER (PARTITION BY group_id ORDER BY pos) AS cum100,
              max(pos) OVER (PARTITION BY group_id) AS last_pos FROM w),
rv AS (SELECT req_id, asn AS group_id, {_h('weighted')} % 101 AS v FROM grouped)
SELECT rv.req_id, rv.group_id,
       coalesce((SELECT decision FROM wc WHERE wc.group_id = rv.group_id AND wc.cum100 >= rv.v
                 ORDER BY pos LIMIT 1),
                (SELECT decision FROM wc WHERE wc.group_id = rv.group_id AND wc.pos = wc.last_pos)) AS decision,
       CASE WHEN EXISTS (SELECT 1 FROM wc WHERE wc.group_id = rv.group_id) THEN 'weighted' ELSE 'none' END AS source
FROM rv"""

# ------------------------------------------------------------ replay analytics
DEC_IDX = "list_position(" + repr(P.DECISION_TYPES).replace('"', "'") + ", {d}) - 1"


def dec_cost(d: str) -> str:
    """Cost of decision ``d`` in a session's map: value * (1 + i/10), exact."""
    return (f"CAST(CAST(value AS DECIMAL(12,2)) * CAST(1 + ({DEC_IDX.format(d=d)}) / 10 AS DECIMAL(2,1))"
            f" AS DOUBLE)")


SQL["trace_parse"] = f"""
SELECT event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_type AS decision,
       CAST({len(P.DECISION_TYPES)} AS BIGINT) AS n_decisions, CAST(round(CAST({dec_cost('event_type')} AS DECIMAL(38,12)), 4) AS DOUBLE) AS cost,
       CAST(3 AS BIGINT) AS n_thresholds, 4.0::DOUBLE AS top_factor
FROM events"""

SQL["trace_files"] = SQL["trace_parse"]
SQL["score_lists"] = with_(UPDATES) + """
SELECT group_id, decision, tick, string_agg(CAST(CAST(round(-cost * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY -cost) AS cents
FROM updates GROUP BY ALL"""
_COSTS = ", ".join(f"'{d},' || CAST(CAST(value AS DECIMAL(12,2)) * CAST(1.{i} AS DECIMAL(2,1)) AS DECIMAL(12,3))::VARCHAR"
                   for i, d in enumerate(P.DECISION_TYPES))
_LOADS = ", ".join(f"'{d},0.1;1.5;0.2;2.0;0.3;4.0'" for d in P.DECISION_TYPES)
SQL["trace_sort"] = f"""
SELECT event_id AS line_no,
       row_number() OVER (ORDER BY CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS VARCHAR), event_id) AS sort_pos,
       concat_ws(chr(9), CAST(floor(epoch(ts)) AS BIGINT) * 1000, event_id, user_id, event_type, 'DecisionMap', {_COSTS},
                 'LoadMap', {_LOADS}) AS value
FROM events"""

SESS = f"""sess AS (
  SELECT event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_type AS decision,
         event_type <> 'error' AS ok, value
  FROM events),
b AS (
  SELECT *, (ts_s - (SELECT min(ts_s) FROM sess)) // {P.SECOND_S} AS second,
            (ts_s - (SELECT min(ts_s) FROM sess)) // {P.MINUTE_S} AS minute
  FROM sess),
rps AS (
  SELECT g.second, coalesce(c.sent, 0) AS sent, coalesce(c.succeeded, 0) AS succeeded
  FROM (SELECT range AS second FROM range(0, (SELECT max(second) FROM b) + 1)) g
  LEFT JOIN (SELECT second, count(*) AS sent, count(*) FILTER (WHERE ok) AS succeeded
             FROM b GROUP BY second) c USING (second)),
spm AS (SELECT minute, count(*) AS n_sessions FROM b GROUP BY minute),
ls AS (
  SELECT b.*, (row_number() OVER (PARTITION BY minute, decision ORDER BY ts_s, line_no))
              / spm.n_sessions AS load
  FROM b JOIN spm USING (minute) WHERE ok),
costed AS (
  SELECT *, CASE WHEN load > 0.3 THEN 4.0 WHEN load > 0.2 THEN 2.0 WHEN load > 0.1 THEN 1.5
                 ELSE 1.0 END::DOUBLE AS factor
  FROM ls)"""

SQL["requests_dense"] = with_(SESS) + """
SELECT CAST(second AS BIGINT) AS second, CAST(sent AS BIGINT) AS sent, CAST(succeeded AS BIGINT) AS succeeded
FROM rps"""

SQL["sessions_per_minute"] = with_(SESS) + """
SELECT CAST(minute AS BIGINT) AS minute, n_sessions FROM spm"""

SQL["load_share"] = with_(SESS) + """
SELECT line_no, CAST(minute AS BIGINT) AS minute, decision, CAST(round(CAST(load AS DECIMAL(38,12)), 4) AS DOUBLE) AS load FROM ls"""

SQL["load_adjusted_cost"] = with_(SESS) + f"""
SELECT line_no, decision, CAST(round(CAST(load AS DECIMAL(38,12)), 4) AS DOUBLE) AS load, factor,
       CAST(round(CAST(factor * {dec_cost('decision')} AS DECIMAL(38,12)), 4) AS DOUBLE) AS cost
FROM costed"""

def exact_mean4(units_sum: str, n: str, digits: int) -> str:
    m = 10 ** (4 - digits)
    return f"CASE WHEN {n} > 0 THEN (({units_sum}) * {2 * m} + {n}) // (2 * {n}) / 10000.0 END"


SQL["load_factor_table"] = SQL["load_adjusted_cost"]

SQL["avg_cost_per_second"] = with_(SESS) + f"""
SELECT CAST(r.second AS BIGINT) AS second, CAST(r.sent AS BIGINT) AS sent,
       CAST(r.succeeded AS BIGINT) AS succeeded,
       {exact_mean4('coalesce(c.u, 0)', 'r.succeeded', 4)} AS avg_cost
FROM rps r LEFT JOIN (SELECT second, sum(CAST(round(factor * {dec_cost('decision')} * 10000) AS BIGINT)) AS u
                      FROM costed GROUP BY second) c USING (second)"""

SQL["round_robin"] = f"""
SELECT event_id AS line_no, event_id % {P.N_FRONTENDS} AS url_idx,
       CASE WHEN event_type <> 'error' THEN 'online' ELSE 'local' END AS mode,
       CASE WHEN event_type <> 'error' THEN event_type ELSE '{sorted(P.DECISION_TYPES)[2]}' END AS chosen,
       CAST(round(CAST({dec_cost("CASE WHEN event_type <> 'error' THEN event_type ELSE '" + sorted(P.DECISION_TYPES)[2] + "' END")} AS DECIMAL(38,12)), 4) AS DOUBLE) AS cost
FROM events"""

RLOG = """rlog AS (
  SELECT event_id AS line_no, event_id % 2 AS url_idx,
         CASE WHEN event_type = 'error' THEN 'local' ELSE 'online' END AS mode,
         CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS cost
  FROM events)"""

SQL["cost_by_mode"] = with_(RLOG) + f"""
SELECT url_idx, mode, count(*) AS n,
       {exact_mean4('sum(CAST(round(cost * 100) AS BIGINT))', 'count(*)', 2)} AS avg_cost
FROM rlog GROUP BY ALL"""

BLOCKS = with_(RLOG) + f""",
bm AS (
  SELECT url_idx, block, avg(cost) AS mean_cost
  FROM (SELECT *, (row_number() OVER (PARTITION BY url_idx ORDER BY line_no) - 1) // {P.BLOCK} AS block
        FROM rlog) o
  GROUP BY url_idx, block HAVING count(*) = {P.BLOCK})"""

SQL["block_means"] = BLOCKS + """
SELECT url_idx, CAST(block AS BIGINT) AS block, CAST(round(CAST(mean_cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean_cost FROM bm"""

SQL["block_zip"] = BLOCKS + """
SELECT CAST(a.block AS BIGINT) AS block, CAST(round(CAST(a.mean_cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean_a, CAST(round(CAST(b.mean_cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS mean_b
FROM bm a JOIN bm b ON a.block = b.block AND a.url_idx = 0 AND b.url_idx = 1"""

SQL["block_gap"] = BLOCKS + """
SELECT count(*) FILTER (WHERE url_idx = 0) AS n_blocks_a, count(*) FILTER (WHERE url_idx = 1) AS n_blocks_b,
       abs(count(*) FILTER (WHERE url_idx = 0) - count(*) FILTER (WHERE url_idx = 1)) AS gap
FROM bm"""

SQL["group_assignment_latest"] = f"""
SELECT CAST(n_nationkey AS VARCHAR) AS group_id,
       'c' || CAST(CASE WHEN n_nationkey % 2 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS VARCHAR)
         AS cluster_id
FROM nation
UNION ALL SELECT 'null', '{P.ME}'"""

SQL["feed_rules_match"] = SQL["rule_match"]

# ------------------------------------------------------------------ streaming
SQL["stream_state"] = SQL["discounted_state"]

SQL["ingest_routing"] = with_(ROUTED) + f"""
SELECT 'upload' AS topic, CAST(NULL AS VARCHAR) AS group_id, CAST(NULL AS VARCHAR) AS cluster_id,
       concat_ws({TAB}, CAST(event_id AS VARCHAR), json_extract_string(props, '$.k'),
                 CAST(user_id % 7 AS VARCHAR), event_type, {COST_TXT}) AS update
FROM events
UNION ALL
SELECT CASE WHEN cluster_id = '{P.ME}' THEN 'internal_groups' ELSE 'external_groups' END,
       group_id, cluster_id, reduced
FROM routed"""

SQL["topic_roundtrip"] = with_(ROUTED) + """
SELECT r.event_id, CASE WHEN r.cluster_id = '""" + P.ME + """' THEN 'internal_groups' ELSE 'external_groups' END AS topic,
       r.group_id, e.event_type AS decision, CAST(round(CAST(-CAST(CAST(e.value AS DECIMAL(12,2)) AS DOUBLE) AS DECIMAL(38,12)), 4) AS DOUBLE) AS score
FROM routed r JOIN events e USING (event_id)"""

SQL["multi_sink_counts"] = with_(ROUTED) + f"""
SELECT 'upload' AS sink, count(*) AS n FROM events
UNION ALL
SELECT CASE WHEN cluster_id = '{P.ME}' THEN 'internal_groups' ELSE 'external_groups' END, count(*)
FROM routed GROUP BY 1
UNION ALL
SELECT 'sample', count(*) FROM (
  SELECT DISTINCT sl, idx, v FROM (
    SELECT (event_id - (SELECT min(event_id) FROM events))
             // ((SELECT max(event_id) - min(event_id) FROM events) // 4 + 1) AS sl,
           CAST(event_id AS VARCHAR) AS f0, json_extract_string(props, '$.k') AS f1,
           CAST(user_id % 7 AS VARCHAR) AS f2
    FROM events
    WHERE CAST(concat('0x', substr(md5('{P.SEED}:' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
          < {P.SAMPLE_FRACTION} * 4294967296.0) s,
  LATERAL (VALUES (0, s.f0), (1, s.f1), (2, s.f2)) AS t(idx, v)) h"""

# --------------------------------------------------------------- policy replay
# Independent of the Spark fold: the state at T = tick - 1 is the closed
# form summed over all earlier active ticks (a range join), then the
# recursive slot loop keyed by (group, T).
SORTED_TYPES = "[" + ", ".join(f"'{d}'" for d in sorted(P.DECISION_TYPES)) + "]"

REPLAY = f"""ranks AS (
  SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY tick) AS rg,
            row_number() OVER (PARTITION BY group_id, decision ORDER BY tick) AS ra
  FROM stats),
sessq AS (
  SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS group_id,
         CAST(floor(epoch(ts) / {P.TICK_S}) AS BIGINT) AS tick, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
         event_type <> 'error' AS ok, value
  FROM events),
asks AS (SELECT DISTINCT group_id, tick - 1 AS ask_t FROM sessq),
gcount AS (
  SELECT a.group_id, a.ask_t, count(DISTINCT s.tick) AS gn
  FROM asks a JOIN stats s ON s.group_id = a.group_id AND s.tick <= a.ask_t GROUP BY ALL),
acount AS (
  SELECT a.group_id, a.ask_t, s.decision, count(*) AS an
  FROM asks a JOIN stats s ON s.group_id = a.group_id AND s.tick <= a.ask_t GROUP BY ALL),
st_at AS (
  SELECT a.group_id, a.ask_t, r.decision,
         sum(r.score_sum * pow({G}, (ac.an - r.ra) + (a.ask_t - r.tick) - (gc.gn - r.rg))) AS score_sum,
         sum(r.n * pow({G}, (ac.an - r.ra) + (a.ask_t - r.tick) - (gc.gn - r.rg))) AS n
  FROM asks a
  JOIN ranks r ON r.group_id = a.group_id AND r.tick <= a.ask_t
  JOIN gcount gc ON gc.group_id = a.group_id AND gc.ask_t = a.ask_t
  JOIN acount ac ON ac.group_id = a.group_id AND ac.ask_t = a.ask_t AND ac.decision = r.decision
  GROUP BY a.group_id, a.ask_t, r.decision),
{ucb_rec("st_at", "ucbr", "group_id, ask_t")},
served AS (
  SELECT s.*, CASE WHEN x.pick IS NOT NULL AND list_contains({SORTED_TYPES}, x.pick) THEN x.pick
                   ELSE {SORTED_TYPES}[{_h('fallback', 's.line_no')} % {len(P.DECISION_TYPES)} + 1] END AS assigned,
         CASE WHEN x.pick IS NOT NULL AND list_contains({SORTED_TYPES}, x.pick) THEN 'policy'
              ELSE 'fallback' END AS source
  FROM sessq s LEFT JOIN (
    SELECT s2.line_no, string_split(u.slots, ':')[{_h('slot', 's2.line_no')} % len(string_split(u.slots, ':')) + 1] AS pick
    FROM sessq s2 JOIN ucbr u ON u.group_id = s2.group_id AND u.ask_t = s2.tick - 1) x USING (line_no))"""

SQL["replay_assignments"] = with_(UPDATES, STATS, REPLAY, recursive=True) + """
SELECT line_no, group_id, tick, assigned, source FROM served"""

SQL["policy_replay"] = with_(UPDATES, STATS, REPLAY, recursive=True) + f""",
b AS (
  SELECT *, (ts_s - (SELECT min(ts_s) FROM served)) // {P.SECOND_S} AS second,
            (ts_s - (SELECT min(ts_s) FROM served)) // {P.MINUTE_S} AS minute
  FROM served),
rps AS (
  SELECT g.second, coalesce(c.sent, 0) AS sent, coalesce(c.succeeded, 0) AS succeeded
  FROM (SELECT range AS second FROM range(0, (SELECT max(second) FROM b) + 1)) g
  LEFT JOIN (SELECT second, count(*) AS sent, count(*) FILTER (WHERE ok) AS succeeded
             FROM b GROUP BY second) c USING (second)),
spm AS (SELECT minute, count(*) AS n_sessions FROM b GROUP BY minute),
ls AS (
  SELECT b.*, (row_number() OVER (PARTITION BY minute, assigned ORDER BY ts_s, line_no)) / spm.n_sessions AS load
  FROM b JOIN spm USING (minute) WHERE ok),
costed AS (
  SELECT *, CASE WHEN load > 0.3 THEN 4.0 WHEN load > 0.2 THEN 2.0 WHEN load > 0.1 THEN 1.5
                 ELSE 1.0 END::DOUBLE AS factor
  FROM ls)
SELECT CAST(r.second AS BIGINT) AS second, CAST(r.sent AS BIGINT) AS sent,
       CAST(r.succeeded AS BIGINT) AS succeeded, CAST(coalesce(c.n_policy, 0) AS BIGINT) AS n_policy,
       {exact_mean4('coalesce(c.u, 0)', 'r.succeeded', 4)} AS avg_cost
FROM rps r LEFT JOIN (
  SELECT second, sum(CAST(round(factor * {dec_cost('assigned')} * 10000) AS BIGINT)) AS u,
         count(*) FILTER (WHERE source = 'policy') AS n_policy
  FROM costed GROUP BY second) c USING (second)"""

SQL["exchange_fanout_stream"] = with_(UPDATES, STATS, *snapshots(), SUBS, recursive=True) + f"""
SELECT DISTINCT u.group_id, s.cluster_id, CAST(u.snap AS BIGINT) AS tick,
       concat(u.group_id, ';', u.slots, ':', ';', '{P.ORIGIN}') AS message
FROM ucbs u JOIN subs s ON s.group_id = u.group_id
WHERE s.cluster_id <> '{P.ME}'"""

SQL["group_table_stream"] = SQL["group_assignment_latest"]
SQL["latest_decision_stream"] = SQL["latest_decision"]
SQL["sliding_stream"] = SQL["best_decision"]
SQL["newest_update_stream"] = with_(UPDATES) + """
SELECT group_id, event_id, decision, CAST(round(CAST(cost AS DECIMAL(38,12)), 4) AS DOUBLE) AS cost, tick
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, event_id DESC) AS r FROM updates) WHERE r = 1"""

# The decision loop: ticks are the micro-batches, i.e. the 6 staged slices
# of the messages in event_id order.
LOOP_SLICES = 6
SQL["decision_loop_stream"] = with_(f"""bounds AS (
  SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) // {LOOP_SLICES} + 1 AS step FROM events)""",
    """updates AS (
  SELECT CAST(user_id % 40 AS VARCHAR) AS group_id, event_type AS decision,
         CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS cost,
         (event_id - bounds.lo) // bounds.step AS tick
  FROM events, bounds)""", STATS,
    dstate(at=f"{LOOP_SLICES - 1}"), ucb_rec(), recursive=True) + f"""
SELECT group_id, slots, concat(group_id, ';', slots, ':', ';', '{P.ORIGIN}') AS message,
       CAST({LOOP_SLICES - 1} AS BIGINT) AS tick
FROM ucb"""

SQL["stream_state_lazy"] = SQL["discounted_state"]
SQL["state_policy"] = with_(UPDATES, STATS, f"""ticks AS (
  SELECT *, (SELECT max(tick) FROM stats) - tick - (max(rg) OVER (PARTITION BY group_id) - rg) AS idle
  FROM (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY tick) AS rg FROM stats) a)""", f"""beta AS (
  SELECT group_id, decision, sum(pow({G}, idle) * CASE WHEN -score_sum <= {P.BETA_LIMIT} * n THEN n ELSE 0 END) AS good,
         sum(pow({G}, idle) * CASE WHEN -score_sum <= {P.BETA_LIMIT} * n THEN 0 ELSE n END) AS bad
  FROM ticks GROUP BY group_id, decision)""") + """
SELECT group_id, decision, CAST(round(CAST(good AS DECIMAL(38,12)), 4) AS DOUBLE) AS good,
       CAST(round(CAST(bad AS DECIMAL(38,12)), 4) AS DOUBLE) AS bad,
       first_value(decision) OVER (PARTITION BY group_id
                                   ORDER BY round((good + 1) / (good + bad + 2), 9) DESC, decision) AS best
FROM beta"""
SQL["state_policy_stream"] = SQL["state_policy"]
SQL["run_metrics"] = """
SELECT 'read' AS measure, count(*) AS n FROM events UNION ALL SELECT 'accounted', count(*) FROM events
UNION ALL SELECT 'some_dropped', 1"""
SQL["expiring_fanout_stream"] = with_(UPDATES, STATS, *snapshots(), recursive=True) + f""",
timed AS (SELECT group_id, (snap + 1) * {P.TICK_S} AS at, slots || ':' AS message FROM ucbs),
sub AS (SELECT CAST(o_custkey % 150 AS VARCHAR) AS group_id,
               'c' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 5 AS VARCHAR) AS cluster_id,
               ({LAST_T} - {P.REQUEST_BACK}) * {P.TICK_S} + (o_orderkey * {7919 * 37}) % {P.REQUEST_TICKS * P.TICK_S} AS at
        FROM orders)
SELECT DISTINCT t.group_id, s.cluster_id, CAST(t.at AS BIGINT) AS at, t.message
FROM timed t JOIN sub s ON s.group_id = t.group_id AND s.at <= t.at AND s.at > t.at - {P.SUB_TTL_S}
WHERE s.cluster_id <> '{P.ME}'"""
SQL["assign_stream"] = SQL["assign_slots"]
SQL["assign_asof_stream"] = with_(UPDATES, STATS, *snapshots(), RULE_GROUP, recursive=True) + f""",
timed AS (SELECT group_id, CAST(snap AS BIGINT) AS tick, slots, (snap + 1) * {P.TICK_S} AS from_s FROM ucbs),
req AS (SELECT req_id, candidates, asn AS group_id,
               ({LAST_T} - {P.REQUEST_BACK}) * {P.TICK_S} + (req_id * {7919 * 37}) % {P.REQUEST_TICKS * P.TICK_S} AS at
        FROM grouped)
SELECT req_id, group_id, coalesce(tick, -1) AS tick, {_finish('pick')}
FROM (SELECT r.*, d.tick, CASE WHEN d.slots IS NOT NULL THEN
                    string_split(d.slots, ':')[{_h('slot')} % len(string_split(d.slots, ':')) + 1] END AS pick
      FROM req r ASOF LEFT JOIN timed d ON r.group_id = d.group_id AND r.at >= d.from_s) x"""

SQL["ingest_decide_stream"] = with_(ROUTED, """updates AS (
  SELECT r.group_id, e.event_type AS decision, CAST(CAST(e.value AS DECIMAL(12,2)) AS DOUBLE) AS cost,
         CAST(0 AS BIGINT) AS tick
  FROM routed r JOIN events e USING (event_id)
  WHERE r.cluster_id = '""" + P.ME + """')""", STATS, dstate(at="0"), ucb_rec(), recursive=True) + f"""
SELECT group_id, slots, concat(group_id, ';', slots, ':', ';', '{P.ORIGIN}') AS message FROM ucb"""
SQL["stream_slots"] = SQL["ucb_slots"]
SQL["stream_state_timed"] = SQL["discounted_state"]
SQL["stream_state_chained"] = SQL["discounted_state"]
SQL["stream_state_bootstrap"] = SQL["discounted_state"]

# ------------------------------------------------------ rejects, late updates
BROKEN = f"""broken AS (SELECT event_id % 7 = 0 AS bad, user_id % 40 AS g FROM events),
rr AS (SELECT b.*, CASE WHEN b.g < 25 THEN 'c' || CAST(n_regionkey AS VARCHAR) ELSE '{P.ME}' END AS cluster_id
       FROM broken b LEFT JOIN nation ON n_nationkey = b.g)"""
SQL["stream_rejects"] = with_(BROKEN) + f""",
s AS (SELECT 'rejects' AS sink, count(*) AS n FROM rr WHERE bad
      UNION ALL SELECT 'upload', count(*) FROM rr WHERE NOT bad
      UNION ALL SELECT CASE WHEN cluster_id = '{P.ME}' THEN 'internal_groups' ELSE 'external_groups' END, count(*)
      FROM rr WHERE NOT bad GROUP BY 1)
SELECT job, sink, n FROM s, (SELECT unnest(['ingest', 'multi_sink']) AS job) j WHERE n > 0"""

# a row of slice k older than its group's newest tick in slices before k
# counts in that tick
SQL["late_rows"] = with_(f"""drawn AS (
  SELECT CAST(user_id AS VARCHAR) AS group_id, event_type AS decision, value AS cost,
         CAST(floor(epoch(ts) / {P.TICK_S}) AS BIGINT) AS t,
         CAST(concat('0x', substr(md5('late:' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM events),
sliced AS (SELECT d.*, (h - lo) // ((hi - lo) // {P.LATE_SLICES} + 1) AS k
           FROM drawn d, (SELECT min(h) AS lo, max(h) AS hi FROM drawn)),
tops AS (SELECT group_id, k, max(max(t)) OVER (PARTITION BY group_id ORDER BY k) AS top
         FROM sliced GROUP BY group_id, k),
moved AS (SELECT s.*, (SELECT max(top) FROM tops o WHERE o.group_id = s.group_id AND o.k < s.k) AS top
          FROM sliced s)""", """updates AS (
  SELECT group_id, decision, cost, greatest(t, coalesce(top, t)) AS tick FROM moved)""", STATS, dstate()) + """
SELECT d.group_id, decision, CAST(round(CAST(score_sum AS DECIMAL(38,12)), 4) AS DOUBLE) AS score_sum,
       CAST(round(CAST(n AS DECIMAL(38,12)), 4) AS DOUBLE) AS n, last_tick,
       (SELECT count(*) FROM moved m WHERE m.group_id = d.group_id AND m.t < m.top) AS late
FROM dstate d"""

SQL["series_text"] = with_(SESS) + """
SELECT CAST(second - (SELECT min(second) FROM rps) + 1 AS BIGINT) AS line_no, CAST(sent AS BIGINT) AS sent FROM rps"""

BLOCKS3 = with_(RLOG) + f""",
bm AS (
  SELECT s AS url_idx, block, avg(cost) AS mean_cost
  FROM (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY line_no) - 1) // {P.BLOCK} AS block
        FROM (SELECT *, CASE WHEN line_no % 3 = 0 THEN 0 ELSE 1 END AS s FROM rlog)) o
  GROUP BY s, block HAVING count(*) = {P.BLOCK})"""
SQL["block_zip_three"] = SQL["block_zip"].replace(BLOCKS, BLOCKS3)
SQL["block_gap_three"] = SQL["block_gap"].replace(BLOCKS, BLOCKS3)

# ------------------------------------------------- policies in loop and replay
LOOP_PARTS = (f"""bounds AS (
  SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) // {LOOP_SLICES} + 1 AS step FROM events)""",
    """updates AS (
  SELECT CAST(user_id % 40 AS VARCHAR) AS group_id, event_type AS decision,
         CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS cost,
         (event_id - bounds.lo) // bounds.step AS tick
  FROM events, bounds)""", STATS)

SQL["decision_loop_custom_stream"] = with_(*LOOP_PARTS, dstate(at=f"{LOOP_SLICES - 1}")) + f"""
SELECT group_id, decision, concat(group_id, ';', decision, ';', '{P.ORIGIN}') AS message,
       CAST({LOOP_SLICES - 1} AS BIGINT) AS tick
FROM (SELECT group_id, first_value(decision) OVER (PARTITION BY group_id
               ORDER BY CASE WHEN n > 0 THEN score_sum / n ELSE 0 END DESC, decision) AS decision,
             row_number() OVER (PARTITION BY group_id) AS r FROM dstate) x WHERE r = 1"""

EG_BEST = """SELECT {k}, decision, first_value(decision) OVER (PARTITION BY {k} ORDER BY s / n DESC, decision) AS best
  FROM {src}"""
SQL["decision_loop_eg_stream"] = with_(*LOOP_PARTS, f"""seen AS (
  SELECT group_id, least({LOOP_SLICES - 1}, max(tick) + {P.EG_WINDOW_TICKS - 1}) AS tick FROM stats GROUP BY group_id),
win AS (SELECT s.group_id, z.tick, decision, sum(score_sum) AS s, sum(n) AS n
        FROM stats s JOIN seen z ON z.group_id = s.group_id AND s.tick <= z.tick
                                 AND s.tick > z.tick - {P.EG_WINDOW_TICKS}
        GROUP BY s.group_id, z.tick, decision),
eg AS ({EG_BEST.format(k="group_id, tick", src="win")}),
d AS (SELECT group_id, tick, any_value(best) AS best,
             coalesce(list(decision ORDER BY decision) FILTER (WHERE decision <> best), []) AS rest
      FROM eg GROUP BY group_id, tick)""") + f"""
SELECT group_id, best, array_to_string(rest, ',') AS rest, CAST(tick AS BIGINT) AS tick,
       concat(group_id, ';{{"random":[', array_to_string(list_transform(rest, lambda x: '"' || x || '"'), ','),
              '],"best":"', best, '","epsilon":{float(P.EPSILON)}}};{P.ORIGIN}') AS message
FROM d"""

SESSQ = REPLAY[REPLAY.index("sessq AS"):REPLAY.index("gcount AS")].rstrip().rstrip(",")


def _served(picks: str) -> str:
    return f"""served AS (
  SELECT s.*, CASE WHEN x.pick IS NOT NULL AND list_contains({SORTED_TYPES}, x.pick) THEN x.pick
                   ELSE {SORTED_TYPES}[{_h('fallback', 's.line_no')} % {len(P.DECISION_TYPES)} + 1] END AS assigned,
         CASE WHEN x.pick IS NOT NULL AND list_contains({SORTED_TYPES}, x.pick) THEN 'policy'
              ELSE 'fallback' END AS source
  FROM sessq s LEFT JOIN ({picks}) x USING (line_no))"""


SQL["policy_replay_eg"] = with_(UPDATES, STATS, SESSQ, f"""win AS (
  SELECT a.group_id, a.ask_t, decision, sum(score_sum) AS s, sum(n) AS n
  FROM asks a JOIN stats s ON s.group_id = a.group_id AND s.tick <= a.ask_t AND s.tick > a.ask_t - {P.EG_WINDOW_TICKS}
  GROUP BY a.group_id, a.ask_t, decision),
eg AS ({EG_BEST.format(k="group_id, ask_t", src="win")}),
egd AS (SELECT group_id, ask_t, any_value(best) AS best,
               coalesce(list(decision ORDER BY decision) FILTER (WHERE decision <> best), []) AS rest
        FROM eg GROUP BY group_id, ask_t)""", _served(f"""
    SELECT s2.line_no, CASE WHEN len(e.rest) = 0 THEN e.best
                            WHEN {_h('eps', 's2.line_no')} % 101 < CAST({P.EPSILON} AS DOUBLE) * 100
                              THEN e.rest[{_h('explore', 's2.line_no')} % len(e.rest) + 1]
                            ELSE e.best END AS pick
    FROM sessq s2 JOIN egd e ON e.group_id = s2.group_id AND e.ask_t = s2.tick - 1""")) + """
SELECT line_no, group_id, tick, assigned, source FROM served"""

SQL["policy_replay_custom"] = with_(UPDATES, STATS, REPLAY[:REPLAY.index("ucbr")].rsplit(",", 1)[0], _served("""
    SELECT s2.line_no, e.decision AS pick
    FROM sessq s2 JOIN (
      SELECT group_id, ask_t, decision, row_number() OVER (PARTITION BY group_id, ask_t
               ORDER BY CASE WHEN n > 0 THEN score_sum / n ELSE 0 END DESC, decision) AS r FROM st_at) e
      ON e.group_id = s2.group_id AND e.ask_t = s2.tick - 1 AND e.r = 1""")) + """
SELECT line_no, group_id, tick, assigned, source FROM served"""

# ------------------------------------------------------------ exchange, serving
SQL["exchange_forward_stream"] = with_(f"""ext AS (
  SELECT CAST(user_id % 40 AS VARCHAR) AS group_id, 'c' || CAST(n_regionkey AS VARCHAR) AS cluster_id,
         lower(r_name) || ':9092' AS address
  FROM events JOIN nation ON n_nationkey = user_id % 40 JOIN region ON r_regionkey = n_regionkey
  WHERE 'c' || CAST(n_regionkey AS VARCHAR) <> '{P.ME}')""") + f"""
SELECT 'forwarded' AS kind, group_id, cluster_id, address, count(*) AS n FROM ext GROUP BY ALL
UNION ALL SELECT 'subscribed', group_id, cluster_id, group_id || ';{P.ME}', 1
FROM (SELECT DISTINCT group_id, cluster_id FROM ext)"""

SQL["epsilon_lines_stream"] = SQL["epsilon_export_lines"]

SQL["weight_lines"] = with_(UPDATES, STATS) + """
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY decision) AS BIGINT) AS pos, decision,
       CAST(1000000000 // (n + 7) AS BIGINT) AS p9
FROM (SELECT group_id, decision, sum(n) AS n FROM stats GROUP BY ALL) x"""

SQL["assign_epsilon_null"] = with_("""updates AS (
  SELECT 'null' AS group_id, event_type AS decision, value AS cost,
         CAST(floor(epoch(ts) / """ + str(P.TICK_S) + """) AS BIGINT) AS tick FROM events)""", STATS, EG, RULE_GROUP) + f""",
egd AS (
  SELECT group_id, any_value(best) AS best,
         coalesce(list(decision ORDER BY decision) FILTER (WHERE decision <> best), []) AS rest
  FROM eg GROUP BY group_id)
SELECT req_id, group_id, {_finish('pick')}
FROM (SELECT g.req_id, g.candidates, CASE WHEN g.matched THEN g.group_id ELSE 'null' END AS group_id,
             CASE WHEN e.best IS NULL THEN NULL
                  WHEN len(e.rest) = 0 THEN e.best
                  WHEN {_h('eps')} % 101 < CAST({P.EPSILON} AS DOUBLE) * 100
                       THEN e.rest[{_h('explore')} % len(e.rest) + 1]
                  ELSE e.best END AS pick
      FROM grouped g LEFT JOIN egd e ON e.group_id = CASE WHEN g.matched THEN g.group_id ELSE 'null' END) x"""
