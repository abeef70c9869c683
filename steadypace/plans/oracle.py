"""The registered queries as ANSI SQL over the generic tables, for a second engine to check."""

from __future__ import annotations

# Views shared by the queries, each built on the ones before it.
VIEWS = {
    "ev": "SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS es FROM events",
    "stops": """
        SELECT CAST(floor(es / 604800.0) AS BIGINT) % 2 AS trip_id, user_id AS operator_id,
               CAST(ts AS DATE) AS scheduled_date, ts AS scheduled_ts, ts AS departure_ts,
               es % 604800 AS seq_in, event_id AS stop_id, event_type AS stop_name,
               CAST(40 - floor(value) AS BIGINT) AS adherence_secs,
               CASE WHEN value >= 60 THEN 1 ELSE 0 END AS early,
               event_type IN ('view', 'click') AS time_point
        FROM ev WHERE event_type <> 'error'""",
    "messages": """
        SELECT event_id, user_id AS operator_id, CAST(ts AS DATE) AS event_date, ts AS event_ts
        FROM ev WHERE event_type = 'error'""",
    "flagged": """
        SELECT *, lag(seq_in) OVER (PARTITION BY trip_id, operator_id
                                    ORDER BY departure_ts, seq_in, stop_id) AS prev
        FROM stops""",
    "restarted": """
        SELECT *, CASE WHEN prev IS NULL OR prev > seq_in THEN 1 ELSE seq_in END AS stop_sequence
        FROM flagged""",
    "pieces": """
        SELECT *, last_value(CASE WHEN stop_sequence = 1 THEN scheduled_ts END IGNORE NULLS)
                  OVER (PARTITION BY trip_id, operator_id ORDER BY departure_ts, seq_in, stop_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece_start_ts
        FROM restarted""",
    "stats": """
        SELECT trip_id, operator_id, piece_start_ts, avg(early) AS early_rate,
               count(*) AS stops, avg(adherence_secs) AS mean_secs
        FROM pieces GROUP BY ALL""",
    "early": """
        SELECT * FROM stats WHERE early_rate >= 0.4 AND stops > 4 AND mean_secs <= -10""",
    "nexts": """
        SELECT *, lead(departure_ts) OVER w AS next_departure_ts,
               lead(stop_name) OVER w AS next_stop_name,
               row_number() OVER (PARTITION BY trip_id, operator_id, piece_start_ts
                                  ORDER BY departure_ts, stop_sequence, stop_id) AS stop_ordinal
        FROM pieces
        WINDOW w AS (PARTITION BY trip_id, operator_id, piece_start_ts, scheduled_date
                     ORDER BY departure_ts, stop_sequence, stop_id)""",
    "hits": """
        SELECT n.*, m.event_id, m.event_date, m.event_ts
        FROM nexts n JOIN messages m
          ON n.operator_id = m.operator_id AND n.scheduled_date = m.event_date
         AND n.departure_ts <= m.event_ts AND m.event_ts < n.next_departure_ts""",
    "last_messages": """
        SELECT * FROM messages QUALIFY row_number() OVER (
            PARTITION BY operator_id, event_date ORDER BY event_id DESC) = 1""",
    "hits_last": """
        SELECT n.*, m.event_id, m.event_date, m.event_ts
        FROM nexts n JOIN last_messages m
          ON n.operator_id = m.operator_id AND n.scheduled_date = m.event_date
         AND n.departure_ts <= m.event_ts AND m.event_ts < n.next_departure_ts""",
}


def _panel_views(hits: str, pick: str, suffix: str) -> dict[str, str]:
    """Views of the panel on one set of hits; ``pick`` is min or max."""
    order = "ASC" if pick == "min" else "DESC"
    return {
        f"hit_pieces{suffix}": f"""
            SELECT trip_id, operator_id, piece_start_ts, {pick}(stop_ordinal) AS event_ordinal
            FROM {hits} GROUP BY ALL""",
        f"hit_stops{suffix}": f"""
            SELECT trip_id, operator_id, piece_start_ts, stop_ordinal, event_id, event_ts
            FROM {hits} QUALIFY row_number() OVER (
                PARTITION BY trip_id, operator_id, piece_start_ts, stop_ordinal
                ORDER BY event_ts {order}, event_id {order}) = 1""",
        f"totals{suffix}": f"""
            SELECT operator_id, count(*) AS total_messages FROM {hits} GROUP BY ALL""",
        f"panel{suffix}": f"""
            SELECT n.trip_id, n.operator_id, n.piece_start_ts, n.stop_id, n.stop_ordinal,
                   n.scheduled_date, n.scheduled_ts, n.departure_ts, n.adherence_secs, n.early,
                   n.time_point, n.stop_name, s.early_rate, s.stops, s.mean_secs,
                   h.event_id AS message_id, h.event_ts AS message_ts,
                   coalesce(t.total_messages, 0) AS total_messages,
                   CASE WHEN p.event_ordinal IS NULL THEN s.stops // 2 END AS middle_stop,
                   n.stop_ordinal - coalesce(p.event_ordinal, s.stops // 2) AS relative_stop,
                   CASE WHEN p.event_ordinal IS NULL THEN 'Comparison Group'
                        ELSE 'Treatment Group' END AS treatment_group,
                   CASE WHEN p.event_ordinal IS NOT NULL AND n.stop_ordinal <= p.event_ordinal
                        THEN 'Pre-text' ELSE 'Post-text' END AS treatment_period
            FROM nexts n
            JOIN stats s ON (n.trip_id, n.operator_id, n.piece_start_ts)
                          = (s.trip_id, s.operator_id, s.piece_start_ts)
            LEFT JOIN hit_pieces{suffix} p
              ON n.trip_id = p.trip_id AND n.operator_id = p.operator_id
             AND n.piece_start_ts = p.piece_start_ts
            LEFT JOIN hit_stops{suffix} h
              ON n.trip_id = h.trip_id AND n.operator_id = h.operator_id
             AND n.piece_start_ts = h.piece_start_ts AND n.stop_ordinal = h.stop_ordinal
            LEFT JOIN totals{suffix} t ON n.operator_id = t.operator_id
            WHERE p.event_ordinal IS NOT NULL
               OR (s.early_rate >= 0.4 AND s.stops > 4 AND s.mean_secs <= -10)""",
    }


VIEWS |= _panel_views("hits", "min", "")
VIEWS |= _panel_views("hits_last", "max", "_last")

VIEWS |= {
    # Lines before and after, per piece and pooled, for both outcomes.
    "text_cells": """
        SELECT trip_id, operator_id, piece_start_ts,
               treatment_period = 'Post-text' AS post, count(*) AS n,
               regr_slope(adherence_secs, relative_stop) AS b,
               regr_intercept(adherence_secs, relative_stop) AS a,
               regr_sxx(adherence_secs, relative_stop) AS sxx,
               regr_syy(adherence_secs, relative_stop) AS syy,
               regr_sxy(adherence_secs, relative_stop) AS sxy, avg(relative_stop) AS xm
        FROM panel WHERE treatment_group = 'Treatment Group' AND time_point GROUP BY ALL""",
    "text_lines": """
        SELECT e.trip_id, e.operator_id, e.piece_start_ts, e.n AS n_pre, o.n AS n_post,
               o.a - e.a AS estimate,
               1.0 / e.n + e.xm * e.xm / e.sxx + 1.0 / o.n + o.xm * o.xm / o.sxx AS v,
               greatest(0, e.syy - e.sxy * e.sxy / e.sxx)
                 + greatest(0, o.syy - o.sxy * o.sxy / o.sxx) AS rss
        FROM text_cells e JOIN text_cells o
          ON e.trip_id = o.trip_id AND e.operator_id = o.operator_id
         AND e.piece_start_ts = o.piece_start_ts
        WHERE NOT e.post AND o.post AND e.n >= 2 AND o.n >= 2 AND e.sxx > 0 AND o.sxx > 0""",
    "text_fit": """
        SELECT sum(n_pre + n_post) - 4 * count(*) AS dof,
               sum(rss) / (sum(n_pre + n_post) - 4 * count(*)) AS s2 FROM text_lines""",
    "text_effects": """
        SELECT l.*, f.dof, sqrt(f.s2 * v) AS se, l.estimate / sqrt(f.s2 * v) AS t,
               CASE WHEN l.estimate > 0 THEN 'Complier' ELSE 'Noncomplier' END AS outcome_group
        FROM text_lines l, text_fit f""",
    "writeups": """
        SELECT DISTINCT user_id AS operator_id, CAST(ts AS DATE) AS incident_date
        FROM ev WHERE event_type = 'error' AND value > 150""",
    "daily": """
        SELECT scheduled_date AS date, operator_id, avg(early) AS early_rate,
               avg(adherence_secs) AS mean_secs
        FROM stops WHERE time_point GROUP BY ALL""",
    "days": """
        SELECT d.*, w.incident_date, w.incident_date IS NOT NULL AS discipline
        FROM daily d LEFT JOIN writeups w
          ON d.operator_id = w.operator_id AND d.date = w.incident_date
        WHERE d.operator_id IN (SELECT operator_id FROM writeups)""",
    "nth": """
        SELECT operator_id, incident_date,
               row_number() OVER (PARTITION BY operator_id ORDER BY incident_date) AS n
        FROM (SELECT DISTINCT operator_id, incident_date FROM days
              WHERE incident_date IS NOT NULL)""",
    "wide": """
        SELECT operator_id, max(CASE WHEN n = 1 THEN incident_date END) AS d1,
               max(CASE WHEN n = 2 THEN incident_date END) AS d2,
               max(CASE WHEN n = 3 THEN incident_date END) AS d3,
               max(CASE WHEN n = 4 THEN incident_date END) AS d4,
               count(*) AS total_disciplines
        FROM nth GROUP BY ALL""",
    "dpanel": """
        SELECT d.date, d.operator_id, d.early_rate, d.mean_secs, d.discipline, w.d1, w.d2, w.d3,
               w.d4, w.total_disciplines, datediff('day', w.d1, d.date) AS x,
               CASE WHEN d.date < w.d1 THEN 'Pre-discipline' ELSE 'Post-discipline' END AS period
        FROM days d JOIN wide w ON d.operator_id = w.operator_id""",
    # Orthogonal cubic trend and step by successive projection.
    "g0": """
        SELECT x, period, early_rate, mean_secs, x / 365.0 AS z,
               CASE WHEN period = 'Post-discipline' THEN 1.0 ELSE 0.0 END AS p FROM dpanel""",
    "g1": "SELECT *, z - avg(z) OVER () AS q1 FROM g0",
    "g2": """
        SELECT *, z * z - avg(z * z) OVER ()
               - q1 * sum(z * z * q1) OVER () / sum(q1 * q1) OVER () AS q2 FROM g1""",
    "g3": """
        SELECT *, z * z * z - avg(z * z * z) OVER ()
               - q1 * sum(z * z * z * q1) OVER () / sum(q1 * q1) OVER ()
               - q2 * sum(z * z * z * q2) OVER () / sum(q2 * q2) OVER () AS q3 FROM g2""",
    "g4": """
        SELECT *, p - avg(p) OVER () - q1 * sum(p * q1) OVER () / sum(q1 * q1) OVER ()
               - q2 * sum(p * q2) OVER () / sum(q2 * q2) OVER ()
               - q3 * sum(p * q3) OVER () / sum(q3 * q3) OVER () AS q4 FROM g3""",
    "gfit": """
        SELECT *, avg(early_rate) OVER ()
               + q1 * sum(early_rate * q1) OVER () / sum(q1 * q1) OVER ()
               + q2 * sum(early_rate * q2) OVER () / sum(q2 * q2) OVER ()
               + q3 * sum(early_rate * q3) OVER () / sum(q3 * q3) OVER ()
               + q4 * sum(early_rate * q4) OVER () / sum(q4 * q4) OVER () AS fit1,
               avg(mean_secs) OVER ()
               + q1 * sum(mean_secs * q1) OVER () / sum(q1 * q1) OVER ()
               + q2 * sum(mean_secs * q2) OVER () / sum(q2 * q2) OVER ()
               + q3 * sum(mean_secs * q3) OVER () / sum(q3 * q3) OVER ()
               + q4 * sum(mean_secs * q4) OVER () / sum(q4 * q4) OVER () AS fit2
        FROM g4""",
    "profile": """
        SELECT x, period, count(*) AS n, avg(early_rate) AS mean_early,
               avg(mean_secs) AS mean_adherence FROM dpanel GROUP BY ALL""",
    "dcells": """
        SELECT operator_id, period = 'Post-discipline' AS post, count(*) AS n,
               regr_slope(early_rate, x) AS b, regr_intercept(early_rate, x) AS a,
               regr_sxx(early_rate, x) AS sxx, regr_syy(early_rate, x) AS syy,
               regr_sxy(early_rate, x) AS sxy, avg(x) AS xm
        FROM dpanel GROUP BY ALL""",
    "dlines": """
        SELECT e.operator_id, e.n AS n_pre, o.n AS n_post, o.a - e.a AS d_level,
               o.b - e.b AS d_slope,
               1.0 / e.n + e.xm * e.xm / e.sxx + 1.0 / o.n + o.xm * o.xm / o.sxx AS v_level,
               1 / e.sxx + 1 / o.sxx AS v_slope,
               greatest(0, e.syy - e.sxy * e.sxy / e.sxx)
                 + greatest(0, o.syy - o.sxy * o.sxy / o.sxx) AS rss
        FROM dcells e JOIN dcells o ON e.operator_id = o.operator_id
        WHERE NOT e.post AND o.post AND e.n >= 2 AND o.n >= 2 AND e.sxx > 0 AND o.sxx > 0""",
    "dfit": """
        SELECT sum(n_pre + n_post) - 4 * count(*) AS dof,
               sum(rss) / (sum(n_pre + n_post) - 4 * count(*)) AS s2 FROM dlines""",
    "deffects": """
        SELECT operator_id, n_pre, n_post, 'level' AS term, d_level AS estimate,
               sqrt(s2 * v_level) AS se, dof FROM dlines, dfit
        UNION ALL
        SELECT operator_id, n_pre, n_post, 'slope' AS term, d_slope AS estimate,
               sqrt(s2 * v_slope) AS se, dof FROM dlines, dfit""",
    # Supplier lines.
    "cells": """
        SELECT l_suppkey, l_quantity - 25 > 0 AS post, count(*) AS n,
               regr_slope(l_extendedprice, l_quantity - 25) AS b,
               regr_intercept(l_extendedprice, l_quantity - 25) AS a,
               regr_sxx(l_extendedprice, l_quantity - 25) AS sxx,
               regr_syy(l_extendedprice, l_quantity - 25) AS syy,
               regr_sxy(l_extendedprice, l_quantity - 25) AS sxy, avg(l_quantity - 25) AS xm
        FROM lineitem GROUP BY ALL""",
    "lines": """
        SELECT e.l_suppkey, e.n AS n_pre, o.n AS n_post, o.a - e.a AS d_level,
               o.b - e.b AS d_slope,
               1.0 / e.n + e.xm * e.xm / e.sxx + 1.0 / o.n + o.xm * o.xm / o.sxx AS v_level,
               1 / e.sxx + 1 / o.sxx AS v_slope,
               e.syy - e.sxy * e.sxy / e.sxx + o.syy - o.sxy * o.sxy / o.sxx AS rss
        FROM cells e JOIN cells o ON e.l_suppkey = o.l_suppkey
        WHERE NOT e.post AND o.post AND e.n >= 2 AND o.n >= 2 AND e.sxx > 0 AND o.sxx > 0""",
    "fit": """
        SELECT CAST(sum(n_pre + n_post) - 4 * count(*) AS BIGINT) AS dof,
               sum(rss) / (sum(n_pre + n_post) - 4 * count(*)) AS s2 FROM lines""",
    "base": "SELECT * FROM lines ORDER BY l_suppkey LIMIT 1",
    "effects": """
        SELECT l_suppkey, d_level AS estimate, sqrt(s2 * v_level) AS se, dof FROM lines, fit""",
    "effects_base": """
        SELECT l.l_suppkey, l.d_level - b.d_level AS estimate,
               sqrt(s2 * (l.v_level + b.v_level)) AS se, dof
        FROM lines l, base b, fit WHERE l.l_suppkey <> b.l_suppkey""",
    # Lines of orders, most of them identified in part: moments of both sides, what is kept, estimates.
    "osides": """
        SELECT l_orderkey,
               count(*) FILTER (NOT post) AS n0, count(*) FILTER (post) AS n1,
               avg(x) FILTER (NOT post) AS x0, avg(x) FILTER (post) AS x1,
               avg(y) FILTER (NOT post) AS y0, avg(y) FILTER (post) AS y1,
               coalesce(regr_sxx(y, x) FILTER (NOT post), 0) AS sxx0, coalesce(regr_sxx(y, x) FILTER (post), 0) AS sxx1,
               coalesce(regr_syy(y, x) FILTER (NOT post), 0) AS syy0, coalesce(regr_syy(y, x) FILTER (post), 0) AS syy1,
               coalesce(regr_sxy(y, x) FILTER (NOT post), 0) AS sxy0, coalesce(regr_sxy(y, x) FILTER (post), 0) AS sxy1
        FROM (SELECT l_orderkey, CAST(l_quantity - 25 AS DOUBLE) AS x, l_quantity > 25 AS post,
                     CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem) GROUP BY l_orderkey""",
    "oparts": """
        SELECT *, CASE WHEN n0 = 0 THEN 0 WHEN sxx0 > 0 THEN 2 ELSE 1 END AS a,
               CASE WHEN n1 = 0 THEN 0 WHEN sxx1 > 0 THEN 2 ELSE 1 END AS b,
               sxy0 / nullif(sxx0, 0) AS b0, sxy1 / nullif(sxx1, 0) AS b1 FROM osides""",
    "olines": """
        SELECT *,
               CASE WHEN a = 2 THEN greatest(0, syy0 - sxy0 * b0) ELSE syy0 END
               + CASE WHEN b = 2 THEN greatest(0, syy1 - sxy1 * b1) ELSE syy1 END AS rss,
               CASE WHEN a = 2 AND b = 2 THEN (y1 - b1 * x1) - (y0 - b0 * x0)
                    WHEN a = 2 AND b = 1 THEN y1 - (y0 + b0 * (x1 - x0))
                    WHEN a = 1 AND b = 2 THEN y1 - y0 - b1 * (x1 - x0)
                    WHEN a = 1 AND b = 1 THEN y1 - y0 END AS d,
               CASE WHEN a = 2 AND b = 2 THEN 1 / n0 + x0 * x0 / sxx0 + 1 / n1 + x1 * x1 / sxx1
                    WHEN a = 2 AND b = 1 THEN 1 / n1 + 1 / n0 + (x1 - x0) * (x1 - x0) / sxx0
                    WHEN a = 1 AND b = 2 THEN 1 / n0 + 1 / n1 + (x1 - x0) * (x1 - x0) / sxx1
                    WHEN a = 1 AND b = 1 THEN 1 / n0 + 1 / n1 END AS v,
               CASE WHEN a = 1 AND b = 1 THEN x1 - x0 ELSE 0 END AS u,
               CASE WHEN a = 2 AND b = 2 THEN 0 WHEN a = 1 AND b = 2 THEN x0 ELSE x1 END AS w
        FROM oparts""",
    "ofit": """
        SELECT sum(n0 + n1 - a - b) AS dof, sum(rss) / sum(n0 + n1 - a - b) AS s2 FROM olines""",
    "obase": """
        SELECT n0 AS bn0, n1 AS bn1, x0 AS bx0, x1 AS bx1, y0 AS by0, y1 AS by1, sxx0 AS bs0, sxx1 AS bs1,
               b0 AS bb0, b1 AS bb1, l_orderkey AS base
        FROM olines WHERE a = 2 AND b = 2 ORDER BY l_orderkey LIMIT 1""",
    "pooled_cells": """
        SELECT l_quantity - 25 > 0 AS post, count(*) AS n,
               regr_slope(l_extendedprice, l_quantity - 25) AS b,
               regr_intercept(l_extendedprice, l_quantity - 25) AS a,
               regr_sxx(l_extendedprice, l_quantity - 25) AS sxx,
               regr_syy(l_extendedprice, l_quantity - 25) AS syy,
               regr_sxy(l_extendedprice, l_quantity - 25) AS sxy, avg(l_quantity - 25) AS xm
        FROM lineitem GROUP BY ALL""",
    # Text stop panel, both outcomes, pooled.
    "text_pooled_cells": """
        SELECT outcome, treatment_period = 'Post-text' AS post, count(*) AS n,
               regr_slope(y, relative_stop) AS b, regr_intercept(y, relative_stop) AS a,
               regr_sxx(y, relative_stop) AS sxx, regr_syy(y, relative_stop) AS syy,
               regr_sxy(y, relative_stop) AS sxy, avg(relative_stop) AS xm
        FROM (SELECT 'adherence_secs' AS outcome, adherence_secs AS y, * FROM panel
              UNION ALL SELECT 'early' AS outcome, early AS y, * FROM panel)
        WHERE treatment_group = 'Treatment Group' GROUP BY ALL""",
    # Source-shaped tables.
    "src": """
        SELECT CAST(CAST(floor(es / 604800.0) AS BIGINT) % 2 AS VARCHAR) AS trip_id,
               CAST(ts AS DATE) AS scheduled_date, strftime(ts, '%H:%M:%S.%g') AS scheduled_time,
               'V' || CAST(user_id % 7 AS VARCHAR) AS vehicle_id,
               CAST(user_id + 10000 AS VARCHAR) AS operator_id, es % 604800 AS seq_in,
               CAST(event_id AS VARCHAR) AS stop_id, strftime(ts, '%H:%M:%S.%g') AS departure_time,
               40 - floor(value) AS adherence_secs, event_type AS stop_name,
               CASE WHEN value >= 60 THEN 1 ELSE 0 END AS early,
               event_type IN ('view', 'click') AS time_point, date_trunc('second', ts) AS ts0
        FROM ev WHERE event_type <> 'error'""",
    "comm": """
        SELECT ts AS message_time, 'You are AHEAD by ' || CAST(CAST(floor(value) AS BIGINT) AS
               VARCHAR) AS message_text
        FROM ev WHERE event_type = 'error' AND value >= 20 AND 220 + event_id % 4 = 222
          AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-04-30'""",
    "extract": """
        SELECT CAST(message_time AS DATE) AS event_date,
               strftime(message_time, '%H:%M:%S') AS event_time,
               CAST(c_custkey + 10000 AS VARCHAR) AS operator_id, message_text,
               date_trunc('second', message_time) AS event_ts
        FROM comm JOIN ev ON date_trunc('second', message_time) = date_trunc('second', ts)
        JOIN customer ON c_custkey = user_id""",
    "s_messages": """
        SELECT *, row_number() OVER (ORDER BY event_ts, operator_id, message_text) AS event_id
        FROM (SELECT DISTINCT event_ts, event_date, operator_id, message_text FROM extract)""",
    "s_restarted": """
        SELECT *, CASE WHEN prev IS NULL OR prev > seq_in THEN 1 ELSE seq_in END AS stop_sequence
        FROM (SELECT *, lag(seq_in) OVER (PARTITION BY trip_id, operator_id
                                          ORDER BY ts0, seq_in, stop_id) AS prev FROM src)""",
    "s_pieces": """
        SELECT *, last_value(CASE WHEN stop_sequence = 1 THEN ts0 END IGNORE NULLS)
                  OVER (PARTITION BY trip_id, operator_id ORDER BY ts0, seq_in, stop_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece_start_ts
        FROM s_restarted""",
    "s_nexts": """
        SELECT *, lead(ts0) OVER (PARTITION BY trip_id, operator_id, piece_start_ts, scheduled_date
                                  ORDER BY ts0, stop_sequence, stop_id) AS next_ts,
               row_number() OVER (PARTITION BY trip_id, operator_id, piece_start_ts
                                  ORDER BY ts0, stop_sequence, stop_id) AS stop_ordinal,
               avg(early) OVER p AS early_rate, count(*) OVER p AS stops,
               avg(adherence_secs) OVER p AS mean_secs
        FROM s_pieces WINDOW p AS (PARTITION BY trip_id, operator_id, piece_start_ts)""",
    "s_hits": """
        SELECT n.*, m.event_id, m.event_ts FROM s_nexts n JOIN s_messages m
          ON n.operator_id = m.operator_id AND n.scheduled_date = m.event_date
         AND n.ts0 <= m.event_ts AND m.event_ts < n.next_ts""",
}


def _critical(dof: str) -> str:
    """Two-sided 5 % point of Student's t by expansion in 1/dof (exact enough above 30)."""
    z = 1.959963984540054
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    parts = [f"{t!r} / pow({dof}, {k})" for k, t in enumerate(terms, start=1)]
    return f"({z!r} + " + " + ".join(parts) + ")"


def _with(last: str | tuple[str, ...], body: str) -> str:
    """``body`` with the views up to the last one it needs."""
    names = list(VIEWS)
    wanted = [last] if isinstance(last, str) else list(last)
    end = max(names.index(n) for n in wanted)
    used, todo = set(), list(wanted)
    while todo:
        name = todo.pop()
        if name in used:
            continue
        used.add(name)
        words = set(VIEWS[name].replace("(", " ").replace(")", " ").replace(",", " ").split())
        todo += [n for n in names[:end] if n in words]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names if n in used)
    return f"WITH {ctes}\n{body}"


def _int(expression: str, name: str, missing: str = "-1") -> str:
    return f"coalesce(CAST({expression} AS BIGINT), {missing}) AS {name}"


def _us(expression: str, name: str) -> str:
    return f"coalesce(epoch_us({expression}), -1) AS {name}"


def _txt(expression: str, name: str) -> str:
    return f"coalesce(CAST({expression} AS VARCHAR), '') AS {name}"


def _near(expression: str, name: str, places: int = 4) -> str:
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"


def _select(*columns: str) -> str:
    return "SELECT " + ", ".join(columns)


KEY = "trip_id, operator_id, epoch_us(piece_start_ts) AS piece_start_us"

PANEL = _select(
    KEY, "stop_id", "stop_ordinal", _txt("scheduled_date", "scheduled_date"),
    _us("departure_ts", "departure_us"), "adherence_secs", _int("early", "early"),
    _int("time_point", "time_point"), _near("early_rate", "early_rate", 6), "stops",
    _near("mean_secs", "mean_secs"), _int("message_id", "message_id"),
    _us("message_ts", "message_us"), "total_messages", _int("middle_stop", "middle_stop"),
    "relative_stop", "treatment_group", "treatment_period",
)

HIT = _select(
    KEY, "event_id", "stop_id", _us("departure_ts", "departure_us"),
    _us("next_departure_ts", "next_departure_us"), _txt("next_stop_name", "next_stop_name"),
    _near("abs(epoch_us(event_ts) - epoch_us(departure_ts)) / 6e7", "minutes_since_departure", 6),
)


def _pooled(cells: str, by: str = "") -> str:
    """Four terms of the pooled model from two cells (per ``by``)."""
    on = f"e.{by} = o.{by}" if by else "true"
    lead = f"e.{by} AS {by}, " if by else ""
    keep = f"{by}, " if by else ""
    return f"""
        SELECT {keep}term, estimate, se, estimate / se AS t, dof, n FROM (
            SELECT {lead}unnest(['intercept', 'x', 'post', 'x:post']) AS term,
                   unnest([e.a, e.b, o.a - e.a, o.b - e.b]) AS estimate,
                   unnest([sqrt(s2 * va), sqrt(s2 / e.sxx), sqrt(s2 * (va + vb)),
                           sqrt(s2 * (1 / e.sxx + 1 / o.sxx))]) AS se,
                   dof, e.n + o.n AS n
            FROM (SELECT e, o, e.n + o.n - 4 AS dof,
                         (e.syy - e.sxy * e.sxy / e.sxx + o.syy - o.sxy * o.sxy / o.sxx)
                           / (e.n + o.n - 4) AS s2,
                         1.0 / e.n + e.xm * e.xm / e.sxx AS va,
                         1.0 / o.n + o.xm * o.xm / o.sxx AS vb
                  FROM {cells} e JOIN {cells} o ON {on} WHERE NOT e.post AND o.post))"""


def _effects(view: str) -> str:
    return f"""
        SELECT l_suppkey, {_near("estimate", "estimate", 3)},
               {_near("estimate - 1.98 * se", "low", 3)},
               {_near("estimate + 1.98 * se", "high", 3)},
               {_int(f"abs(estimate / se) >= {_critical('dof')}", "significant")},
               CASE WHEN estimate > 0 THEN 'Complier' ELSE 'Noncomplier' END AS outcome_group,
               row_number() OVER (ORDER BY estimate, l_suppkey) AS sort_order
        FROM {view}"""


def _sums(y: str) -> str:
    """Step coefficient of the projected model for one outcome."""
    explained = " + ".join(f"pow(sum({y} * q{i}), 2) / sum(q{i} * q{i})" for i in (1, 2, 3, 4))
    centred = f"(sum({y} * {y}) - pow(sum({y}), 2) / count(*))"
    return f"""
        SELECT '{y}' AS outcome, sum({y} * q4) / sum(q4 * q4) AS b,
               sqrt(({centred} - ({explained})) / (count(*) - 5) / sum(q4 * q4)) AS se,
               count(*) - 5 AS dof, count(*) AS n,
               1 - ({centred} - ({explained})) / (count(*) - 5) / ({centred} / (count(*) - 1)) AS r
        FROM g4"""


ORACLE = {
    "sessionize_pieces": _with("pieces", f"SELECT {KEY}, stop_id, stop_sequence FROM pieces"),
    "session_statistics": _with(
        "stats",
        _select(KEY, _near("early_rate", "early_rate", 6), "stops", _near("mean_secs", "mean_secs"))
        + " FROM stats",
    ),
    "early_sessions": _with("early", f"SELECT {KEY} FROM early"),
    "dense_session_ids": _with(
        ("pieces", "stats"),
        """SELECT p.stop_id, s.work_piece_id FROM pieces p JOIN (
             SELECT *, row_number() OVER (ORDER BY trip_id, operator_id, piece_start_ts)
                       AS work_piece_id FROM stats) s
           ON p.trip_id = s.trip_id AND p.operator_id = s.operator_id
          AND p.piece_start_ts = s.piece_start_ts""",
    ),
    "stable_piece_ids": _with(
        "stats",
        """SELECT trip_id, operator_id, epoch_us(piece_start_ts) AS piece_start_us,
                  row_number() OVER (ORDER BY piece_start_ts >= TIMESTAMP '2024-01-16', trip_id, operator_id,
                                     piece_start_ts) AS id FROM stats""",
    ),
    "distinct_operators_by_month": """
        SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT user_id) AS operators
        FROM events WHERE event_type IN ('view', 'click') GROUP BY month""",
    "hashed_session_ids": _with(
        "pieces",
        """SELECT stop_id, substring(sha256('salt|' || trip_id || '|' || operator_id || '|'
                  || epoch_us(piece_start_ts)), 1, 32) AS work_piece_id FROM pieces""",
    ),
    "session_uniqueness": _with(
        "stats",
        "SELECT count(*) AS ids, count(*) AS pairs, CAST(1 AS BIGINT) AS \"unique\" FROM stats",
    ),
    "stop_ordinals": _with("nexts", "SELECT stop_id, stop_ordinal FROM nexts"),
    "next_departures": _with(
        "nexts",
        _select("stop_id", _us("next_departure_ts", "next_departure_us"),
                _txt("next_stop_name", "next_stop_name")) + " FROM nexts",
    ),
    "existence_or_filter": _with(
        ("pieces", "early", "writeups"),
        f"""SELECT {KEY}, stop_id FROM pieces
            WHERE (trip_id, operator_id, piece_start_ts) IN
                    (SELECT (trip_id, operator_id, piece_start_ts) FROM early)
               OR operator_id IN (SELECT operator_id FROM writeups)""",
    ),
    "attribute_per_event": _with("hits", f"{HIT} FROM hits"),
    "attribute_last_per_day": _with("hits_last", f"{HIT} FROM hits_last"),
    "unmatched_messages": _with(
        ("messages", "hits"),
        """SELECT event_id, operator_id, epoch_us(event_ts) AS event_us FROM messages
           WHERE event_id NOT IN (SELECT event_id FROM hits)""",
    ),
    "unmatched_reasons": _with(
        ("messages", "hits", "hits_last", "pieces"),
        """SELECT m.event_id, CASE WHEN b.lo IS NULL THEN 'no log rows that day'
                    WHEN m.event_ts < b.lo THEN 'before first departure'
                    WHEN m.event_ts >= b.hi THEN 'after last departure'
                    WHEN m.event_id IN (SELECT event_id FROM hits) THEN 'later message that day'
                    ELSE 'between two pieces' END AS reason,
                  CAST(coalesce(b.dup, false) AS BIGINT) AS duplicate_stop_time
           FROM messages m LEFT JOIN (
             SELECT operator_id, scheduled_date, min(departure_ts) AS lo, max(departure_ts) AS hi,
                    count(*) > count(DISTINCT (trip_id, departure_ts)) AS dup
             FROM pieces GROUP BY ALL) b
             ON m.operator_id = b.operator_id AND m.event_date = b.scheduled_date
           WHERE m.event_id NOT IN (SELECT event_id FROM hits_last)""",
    ),
    "message_ids": _with(
        "messages",
        """SELECT row_number() OVER (ORDER BY event_ts, operator_id) AS event_id, operator_id,
                  epoch_us(event_ts) AS event_us FROM messages""",
    ),
    "text_panel": _with("panel", f"{PANEL} FROM panel"),
    "text_panel_last_per_day": _with("panel_last", f"{PANEL} FROM panel_last"),
    "relative_position": _with(
        "panel", "SELECT stop_id, relative_stop, treatment_group FROM panel"
    ),
    "masked_text_panel": _with(
        "panel",
        """SELECT substring(sha256('salt|' || trip_id || '|' || operator_id || '|'
                  || epoch_us(piece_start_ts)), 1, 32) AS work_piece_id,
                  sha256('salt' || operator_id) AS operator_id_hash, stop_ordinal, relative_stop
           FROM panel""",
    ),
    "treatment_group_sizes": _with(
        "panel",
        """SELECT treatment_group, treatment_period, count(DISTINCT operator_id) AS operators,
                  count(DISTINCT (trip_id, operator_id, piece_start_ts)) AS work_pieces
           FROM panel GROUP BY ALL""",
    ),
    "comparison_pieces": _with(
        "panel",
        f"SELECT DISTINCT {KEY} FROM panel WHERE treatment_group = 'Comparison Group'",
    ),
    "matched_operators_equal": _with(
        ("panel", "hits"),
        """SELECT p AS left_values, h AS right_values, CAST(p = h AS BIGINT) AS equal FROM
           (SELECT count(DISTINCT operator_id) AS p FROM panel WHERE message_id IS NOT NULL),
           (SELECT count(DISTINCT operator_id) AS h FROM hits)""",
    ),
    "profile_by_relative_stop": _with(
        "panel",
        f"""SELECT relative_stop, treatment_group, count(*) AS stops, 'Mean early' AS stat,
                   {_near("avg(early)", "value")} FROM panel GROUP BY ALL
            UNION ALL
            SELECT relative_stop, treatment_group, count(*) AS stops, 'Median adherence' AS stat,
                   {_near("median(adherence_secs)", "value")} FROM panel GROUP BY ALL""",
    ),
    "post_event_first_time_point": _with(
        "panel",
        f"""SELECT {_near("avg(early)", "early_rate", 6)},
                   {_near("avg(adherence_secs)", "mean_secs")} FROM (
              SELECT * FROM panel WHERE treatment_group = 'Treatment Group' AND time_point
                AND treatment_period = 'Post-text'
              QUALIFY row_number() OVER (PARTITION BY trip_id, operator_id, piece_start_ts
                                         ORDER BY stop_ordinal) = 1)""",
    ),
    "post_event_all": _with(
        "panel",
        f"""SELECT {_near("avg(early)", "early_rate", 6)},
                   {_near("avg(adherence_secs)", "mean_secs")}
            FROM panel WHERE treatment_group = 'Treatment Group' AND time_point
              AND treatment_period = 'Post-text'""",
    ),
    "weekly_counts": _with(
        ("hits", "days"),
        """SELECT CAST(floor((dayofyear(moment) - 1) / 7) + 1 AS BIGINT) AS week,
                  count(*) AS interventions, CAST(max(CAST(moment AS DATE)) AS VARCHAR) AS date,
                  kind AS intervention_type
           FROM (SELECT DISTINCT event_ts AS moment, 'Live Texts' AS kind FROM hits
                 UNION ALL SELECT date AS moment, 'Discipline' AS kind FROM days WHERE discipline)
           GROUP BY week, kind""",
    ),
    "study_summary_table": _with(
        ("messages", "hits", "panel"),
        """SELECT 'Total text messages sent' AS statistic, CAST(count(*) AS DOUBLE) AS value
           FROM messages
           UNION ALL SELECT 'Operators targeted for texts', count(DISTINCT operator_id)
           FROM messages
           UNION ALL SELECT 'Texts successfully matched to specific stop/trip/operator',
             count(DISTINCT event_id) FROM hits
           UNION ALL SELECT 'Operators in the treatment group', count(DISTINCT operator_id)
           FROM panel WHERE treatment_group = 'Treatment Group'
           UNION ALL SELECT 'Operators in the comparison group', count(DISTINCT operator_id)
           FROM panel WHERE treatment_group = 'Comparison Group'
           UNION ALL SELECT 'Work pieces in the treatment group',
             count(DISTINCT (trip_id, operator_id, piece_start_ts))
           FROM panel WHERE treatment_group = 'Treatment Group'
           UNION ALL SELECT 'Work pieces in the comparison group',
             count(DISTINCT (trip_id, operator_id, piece_start_ts))
           FROM panel WHERE treatment_group = 'Comparison Group'""",
    ),
    "text_pooled_effect": _with(
        "text_pooled_cells",
        _select("outcome", "term", _near("estimate", "estimate"), _near("se", "std_error"),
                _near("t", "t_value"), _int("dof", "dof"), "n")
        + f" FROM ({_pooled('text_pooled_cells', 'outcome')})",
    ),
    "text_piece_effects": _with(
        "text_effects",
        _select(KEY, _near("estimate", "estimate", 3), _near("estimate - 1.98 * se", "low", 3),
                _near("estimate + 1.98 * se", "high", 3),
                _int(f"abs(t) >= {_critical('dof')}", "significant"), "outcome_group", "n_pre",
                "n_post", _int("dof", "dof")) + " FROM text_effects",
    ),
    "text_outcome_counts": _with(
        "text_effects",
        """SELECT outcome_group, count(*) AS entities, count(DISTINCT operator_id) AS operators
           FROM text_effects GROUP BY ALL""",
    ),
    "text_main_bars": _with(
        "text_pooled_cells",
        f"""SELECT CASE WHEN post THEN 'Post-text' ELSE 'Pre-text' END AS period,
                   {_near("a", "value")},
                   CAST(CAST(round_even(a, 0) AS BIGINT) AS VARCHAR) AS label,
                   CAST(post AS BIGINT) AS position
            FROM text_pooled_cells WHERE outcome = 'adherence_secs'""",
    ),
    "text_main_bars_rate": _with(
        "text_pooled_cells",
        f"""SELECT CASE WHEN post THEN 'Post-text' ELSE 'Pre-text' END AS period,
                   {_near("a", "value")},
                   substr(CAST(a * 100 AS VARCHAR), 1, 5) || '%' AS label,
                   CAST(post AS BIGINT) AS position
            FROM text_pooled_cells WHERE outcome = 'early'
            UNION ALL
            SELECT 'change', round_even((e.a - o.a) * 100, 0) + 0.0, '', 2
            FROM text_pooled_cells e, text_pooled_cells o
            WHERE e.outcome = 'early' AND o.outcome = 'early' AND NOT e.post AND o.post""",
    ),
    "piece_traces": _with(
        "panel",
        _select(
            KEY, _us("scheduled_ts", "scheduled_us"), "relative_stop", "adherence_secs",
            _int("time_point", "time_point"), _us("message_ts", "message_us"),
            "'Trip ' || trip_id || ' on ' || scheduled_date AS caption",
            "CASE WHEN relative_stop % 20 = 0 THEN stop_name ELSE '' END AS stop_label",
            "epoch_us(min(scheduled_ts) OVER p) AS band_from_us",
            "epoch_us(max(scheduled_ts) OVER p) AS band_to_us",
            "min(relative_stop) OVER p AS band_from_stop",
            "max(relative_stop) OVER p AS band_to_stop",
            "min(adherence_secs) OVER p AS band_bottom", "CAST(-120 AS DOUBLE) AS band_top",
        )
        + " FROM panel WINDOW p AS (PARTITION BY trip_id, operator_id, piece_start_ts)",
    ),
    "second_precision_join": _with(
        "extract",
        """SELECT CAST(event_date AS VARCHAR) AS event_date, event_time, operator_id, message_text,
                  epoch_us(event_ts) AS event_us FROM extract""",
    ),
    "adherence_extract": _with(
        ("src", "extract"),
        _select("trip_id", _txt("scheduled_date", "scheduled_date"), "scheduled_time",
                "vehicle_id", "operator_id", _int("seq_in", "stop_sequence"), "stop_id",
                "departure_time", _near("adherence_secs", "adherence_secs"), "stop_name",
                _int("early", "early"), _int("time_point", "time_point"),
                _us("ts0", "scheduled_us"), _us("ts0", "departure_us"))
        + """ FROM src WHERE operator_id IN (SELECT operator_id FROM extract)
              AND scheduled_date BETWEEN DATE '2024-01-01' AND DATE '2024-05-01'""",
    ),
    "adherence_extract_range": _with(
        ("src", "extract"),
        _select("trip_id", _txt("scheduled_date", "scheduled_date"), "scheduled_time",
                "vehicle_id", "operator_id", _int("seq_in", "stop_sequence"), "stop_id",
                "departure_time", _near("adherence_secs", "adherence_secs"), "stop_name",
                _int("early", "early"), _int("time_point", "time_point"),
                _us("ts0", "scheduled_us"), _us("ts0", "departure_us"))
        + """ FROM src WHERE operator_id IN (SELECT operator_id FROM extract)
              AND scheduled_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    ),
    "profile_of_fractional_seconds": _with(
        "panel",
        f"""SELECT relative_stop, treatment_group, count(*) AS stops,
                   {_near("avg(early)", "mean_early")},
                   {_near("median(adherence_secs + stop_ordinal / 8.0)", "median_adherence")}
            FROM panel GROUP BY ALL""",
    ),
    "text_study_from_source": _with(
        ("s_nexts", "s_hits"),
        f"""SELECT n.trip_id, n.operator_id, epoch_us(n.piece_start_ts) AS piece_start_us,
                   n.stop_id, n.stop_ordinal, {_int("h.event_id", "message_id")},
                   coalesce(t.total, 0) AS total_messages,
                   n.stop_ordinal - coalesce(p.event_ordinal, n.stops // 2) AS relative_stop,
                   CASE WHEN p.event_ordinal IS NULL THEN 'Comparison Group'
                        ELSE 'Treatment Group' END AS treatment_group,
                   CASE WHEN n.stop_ordinal <= p.event_ordinal THEN 'Pre-text'
                        ELSE 'Post-text' END AS treatment_period
            FROM s_nexts n
            LEFT JOIN (SELECT trip_id, operator_id, piece_start_ts,
                              min(stop_ordinal) AS event_ordinal FROM s_hits GROUP BY ALL) p
              ON n.trip_id = p.trip_id AND n.operator_id = p.operator_id
             AND n.piece_start_ts = p.piece_start_ts
            LEFT JOIN (SELECT * FROM s_hits QUALIFY row_number() OVER (
                         PARTITION BY trip_id, operator_id, piece_start_ts, stop_ordinal
                         ORDER BY event_ts, event_id) = 1) h
              ON n.trip_id = h.trip_id AND n.operator_id = h.operator_id
             AND n.piece_start_ts = h.piece_start_ts AND n.stop_ordinal = h.stop_ordinal
            LEFT JOIN (SELECT operator_id, count(*) AS total FROM s_hits GROUP BY ALL) t
              ON n.operator_id = t.operator_id
            WHERE p.event_ordinal IS NOT NULL
               OR (n.early_rate >= 0.4 AND n.stops > 4 AND n.mean_secs <= -10)""",
    ),
    "daily_adherence": _with(
        "daily",
        _select(_txt("date", "date"), "operator_id", _near("early_rate", "early_rate", 6),
                _near("mean_secs", "mean_secs")) + " FROM daily",
    ),
    "discipline_panel": _with(
        "dpanel",
        _select(_txt("date", "date"), "operator_id", _near("early_rate", "early_rate", 6),
                _near("mean_secs", "mean_secs"), _int("discipline", "discipline"),
                *[_txt(f"d{i}", f"discipline_date_{i}") for i in range(1, 5)],
                "total_disciplines",
                *[_int(f"datediff('day', d{i}, date)", f"date_relative_{i}", "9999")
                  for i in range(1, 5)], "period") + " FROM dpanel",
    ),
    "discipline_days_from_source": _with(
        "days",
        _select(_txt("date", "date"), "CAST(operator_id + 10000 AS VARCHAR) AS operator_id",
                _near("early_rate", "early_rate", 6), _near("mean_secs", "mean_secs"),
                _int("discipline", "discipline"), _txt("incident_date", "incident_date"))
        + " FROM days WHERE date BETWEEN DATE '2023-01-01' AND DATE '2024-04-30'",
    ),
    "nth_dates_wide": _with(
        "wide",
        _select("operator_id", *[_txt(f"d{i}", f"discipline_date_{i}") for i in range(1, 5)])
        + " FROM wide",
    ),
    "nth_dates_long": _with(
        "nth",
        _select("operator_id", _txt("incident_date", "incident_date"), _int("n", "n")) + " FROM nth",
    ),
    "all_dates_wide": _with(
        "nth",
        """SELECT operator_id, 'discipline_date_' || n AS name, CAST(incident_date AS VARCHAR) AS date FROM nth""",
    ),
    "discipline_panel_all_dates": _with(
        ("days", "nth"),
        """SELECT CAST(d.date AS VARCHAR) AS date, d.operator_id, CAST(n.n AS BIGINT) AS n,
                  CAST(n.incident_date AS VARCHAR) AS discipline_date,
                  CAST(datediff('day', n.incident_date, d.date) AS BIGINT) AS date_relative
           FROM days d JOIN nth n ON d.operator_id = n.operator_id""",
    ),
    "discipline_totals": _with("wide", "SELECT operator_id, total_disciplines FROM wide"),
    "operators_per_total": _with(
        "wide", "SELECT total_disciplines, count(*) AS value FROM wide GROUP BY ALL"
    ),
    "discipline_summary_table": _with(
        "wide",
        """SELECT 'Total number of disciplines issued.' AS statistic,
                  CAST(sum(total_disciplines) AS DOUBLE) AS value FROM wide
           UNION ALL SELECT 'Total number of Operators Receiving a discipline.', count(*) FROM wide
           UNION ALL SELECT 'Operators that received ' || total_disciplines || ' disciplines.',
             count(*) FROM wide GROUP BY total_disciplines""",
    ),
    "step_model_cubic": _with(
        "g4",
        _select("outcome", _near("b", "estimate"), _near("se", "std_error"),
                _near("b / se", "t_value"), "dof", "n", _near("r", "adjusted_r2"))
        + f" FROM ({_sums('early_rate')} UNION ALL {_sums('mean_secs')})",
    ),
    "discipline_day_profile": _with(
        "gfit",
        f"""SELECT {_int("x", "date_relative_1")}, period, count(*) AS n,
                   {_near("avg(early_rate)", "mean_early")},
                   {_near("avg(mean_secs)", "mean_adherence")},
                   {_near("avg(fit1)", "mean_prediction")},
                   {_near("avg(fit2)", "mean_prediction_secs", 3)}
            FROM gfit WHERE x BETWEEN -20 AND 20 GROUP BY x, period""",
    ),
    "merged_day_cells": _with(
        "dpanel",
        f"""SELECT {_int("x", "date_relative_1")}, period, count(*) AS rows,
                   count(early_rate) AS early_rate_n, count(mean_secs) AS mean_secs_n,
                   {_near("avg(early_rate)", "early_rate_mean")},
                   {_near("avg(mean_secs)", "mean_secs_mean", 3)},
                   coalesce(round(stddev_samp(early_rate), 4) + 0.0, -1.0) AS early_rate_sd,
                   coalesce(round(stddev_samp(mean_secs), 4) + 0.0, -1.0) AS mean_secs_sd
            FROM dpanel GROUP BY x, period""",
    ),
    "discipline_day_one": _with(
        "gfit",
        f"""SELECT {_near("fit1", "predicted")}, {_near("fit2", "predicted_secs", 3)}
            FROM gfit WHERE x = 1 LIMIT 1""",
    ),
    "relapse_days": _with(
        "profile",
        """SELECT 0.15::DOUBLE AS threshold, coalesce(min(x), -1) AS relapse_day FROM profile
           WHERE mean_early >= 0.15 AND x > 10 AND x BETWEEN -365 AND 365
           UNION ALL SELECT 0.4::DOUBLE, coalesce(min(x), -1) FROM profile
           WHERE mean_early >= 0.4 AND x > 10 AND x BETWEEN -365 AND 365""",
    ),
    "discipline_operator_effects": _with(
        "deffects",
        _select("operator_id", "term", _near("estimate", "estimate", 3),
                _near("estimate - 1.98 * se", "low", 3), _near("estimate + 1.98 * se", "high", 3),
                _int(f"abs(estimate / se) >= {_critical('dof')}", "significant"),
                "CASE WHEN estimate < 0 THEN 'Complier' ELSE 'Noncomplier' END AS outcome_group",
                "n_pre", "n_post") + " FROM deffects",
    ),
    "discontinuity_pooled": _with(
        "pooled_cells",
        _select("term", _near("estimate", "estimate"), _near("se", "std_error"),
                _near("t", "t_value"), _int("dof", "dof"), "n")
        + f" FROM ({_pooled('pooled_cells')})",
    ),
    "discontinuity_by_entity": _with(
        ("lines", "fit"),
        _select("l_suppkey", "term", _near("estimate", "estimate", 3),
                _near("se", "std_error", 3), _near("estimate / se", "t_value"), "n_pre", "n_post",
                "CAST(1 AS BIGINT) AS identified", "dof")
        + """ FROM (SELECT *, 'level' AS term, d_level AS estimate, sqrt(s2 * v_level) AS se
                    FROM lines, fit
                    UNION ALL SELECT *, 'slope', d_slope, sqrt(s2 * v_slope) FROM lines, fit)""",
    ),
    "discontinuity_partly_identified": _with(
        "ofit",
        f"""SELECT l_orderkey, term, {_near("coalesce(estimate, -1) + 0.00123", "estimate", 2)},
                   {_near("coalesce(se, -1)", "std_error", 1)}, n0 AS n_pre, n1 AS n_post,
                   CAST(estimate IS NOT NULL AS BIGINT) AS identified, {_int("dof", "dof")}
            FROM (SELECT *, 'level' AS term, d AS estimate, sqrt(s2 * v) AS se FROM olines, ofit
                  UNION ALL
                  SELECT *, 'slope', CASE WHEN a = 2 AND b = 2 THEN b1 - b0 END,
                         CASE WHEN a = 2 AND b = 2 THEN sqrt(s2 * (1 / sxx0 + 1 / sxx1)) END FROM olines, ofit)""",
    ),
    "discontinuity_partly_identified_baseline": _with(
        ("ofit", "obase"),
        f"""SELECT l_orderkey, term, {_near("coalesce(estimate, -1) + 0.00123", "estimate", 2)},
                   {_near("coalesce(se, -1)", "std_error", 1)}
            FROM (SELECT l_orderkey, 'level' AS term,
                         d - ((by1 + bb1 * (w - bx1)) - (by0 + bb0 * (w - u - bx0))) AS estimate,
                         sqrt(s2 * (v + 1 / bn1 + (w - bx1) * (w - bx1) / bs1
                                    + 1 / bn0 + (w - u - bx0) * (w - u - bx0) / bs0)) AS se
                  FROM olines, ofit, obase WHERE l_orderkey <> base
                  UNION ALL
                  SELECT l_orderkey, 'slope',
                         CASE WHEN a = 2 AND b = 2 AND l_orderkey = base THEN b1 - b0
                              WHEN a = 2 AND b = 2 THEN b1 - b0 - (bb1 - bb0) END,
                         CASE WHEN a = 2 AND b = 2 AND l_orderkey = base THEN sqrt(s2 * (1 / sxx0 + 1 / sxx1))
                              WHEN a = 2 AND b = 2 THEN sqrt(s2 * (1 / sxx0 + 1 / sxx1 + 1 / bs0 + 1 / bs1)) END
                  FROM olines, ofit, obase)""",
    ),
    "effect_term_names": _with(
        ("lines", "fit"),
        _select("term_name || ':Supplier' || l_suppkey AS \"Effect\"", "CAST(l_suppkey AS VARCHAR) AS supplier", "term",
                _near("estimate", "estimate", 3))
        + """ FROM (SELECT *, 'level' AS term, 'PeriodAfter' AS term_name, d_level AS estimate FROM lines
                    UNION ALL SELECT *, 'slope', 'Position:PeriodAfter', d_slope FROM lines)""",
    ),
    "effect_ranking": _with("effects", _effects("effects")),
    "effect_intervals": _with(
        "effects",
        f"""SELECT estimate, low, high, significant, outcome_group, sort_order
            FROM ({_effects("effects")})""",
    ),
    "effect_ranking_baseline": _with("effects_base", _effects("effects_base")),
    "entity_by_rank": _with(
        "effects",
        f"""SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
                   l_extendedprice
            FROM lineitem WHERE l_suppkey IN
              (SELECT l_suppkey FROM ({_effects("effects")}) WHERE sort_order = 3)""",
    ),
    "model_headline": _with(
        "pooled_cells",
        f"""SELECT CASE WHEN post THEN 'Post-text' ELSE 'Pre-text' END AS period,
                   {_near("a", "value")}, CAST(CAST(round_even(a, 0) AS BIGINT) AS VARCHAR) AS label
            FROM pooled_cells
            UNION ALL
            SELECT 'change', d, CAST(CAST(d AS BIGINT) AS VARCHAR) FROM (
              SELECT round_even(o.a, 0) - round_even(e.a, 0) AS d
              FROM pooled_cells e, pooled_cells o WHERE NOT e.post AND o.post)""",
    ),
    "model_report_table": _with(
        "pooled_cells",
        _select("term", _near("estimate", "estimate"),
                _near("estimate - 1.6448536269514722 * se", "ci_low"),
                _near("estimate + 1.6448536269514722 * se", "ci_high"),
                _int(f"abs(t) >= {_critical('dof')}", "significant"), "n")
        + f" FROM ({_pooled('pooled_cells')})",
    ),
    "dedupe_report": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
    "duplicate_counts": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
               count(*) - 1 AS extra_copies
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "first_line_per_supplier": """
        SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) = 1""",
    "text_filter_ci": """
        SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS turn FROM documents
        WHERE text ILIKE '%ATION%'
        UNION ALL SELECT 'conversations', conv_id, turn FROM conversations
        WHERE text ILIKE '%ATION%'""",
    "mask_ids": """
        SELECT sha256('salt' || CAST(c_custkey AS VARCHAR)) AS c_custkey_hash,
               CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer""",
    "scalar_columns": """
        SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
               strftime(ts, '%H:%M:%S') AS time, epoch_us(date_trunc('second', ts)) AS whole_us,
               CAST(floor((dayofyear(ts) - 1) / 7) + 1 AS BIGINT) AS week,
               datediff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS days,
               round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7, 4) AS minutes,
               CASE WHEN event_id % 20 = 0 THEN strftime(ts, '%H:%M:%S') ELSE '' END AS label
        FROM events""",
    "distinct_counts": """
        SELECT unnest(['lines', 'orders', 'parts', 'returned']) AS statistic,
               unnest([CAST(count(*) AS DOUBLE), count(DISTINCT l_orderkey),
                       count(DISTINCT l_partkey), count_if(l_returnflag = 'R')]) AS value
        FROM lineitem""",
    "order_line_violations": """
        SELECT o_orderkey AS orderkey, o.n AS left_rows, l.n AS right_rows
        FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY ALL) o
        JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) l
          ON o_orderkey = l_orderkey WHERE o.n > 1 OR l.n > 1""",
    "value_limits": _with(
        "panel",
        """SELECT treatment_group, min(adherence_secs) AS min_adherence_secs,
                  max(adherence_secs) AS max_adherence_secs,
                  min(relative_stop) AS min_relative_stop, max(relative_stop) AS max_relative_stop
           FROM panel GROUP BY ALL""",
    ),
    "early_comparison_check": _with(
        "panel",
        """SELECT treatment_group, count(*) AS n, CAST(0 AS BIGINT) AS wrong
           FROM panel GROUP BY ALL""",
    ),
}
# The same rows in chart order.
ORACLE["day_lines"] = ORACLE["discipline_day_profile"]
