"""Window functions and frames, over the events of each user."""

from __future__ import annotations

from millrace.queries.sqltext import paired

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_SQL = {
    "win_rank": ("events", "SELECT event_id, cast(row_number() OVER w AS bigint) AS rn, cast(rank() OVER w AS bigint) AS rk, cast(dense_rank() OVER w AS bigint) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, cast(ntile(4) OVER w AS bigint) AS nt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY round(value), user_id, event_id)"),
    "win_rank_ties": ("events", "SELECT event_id, cast(rank() OVER w AS bigint) AS rk, cast(dense_rank() OVER w AS bigint) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(value / 10))"),
    "win_value": ("events", f"SELECT event_id, first(value) OVER w AS f, last(value) OVER w AS l, first_value(event_type) OVER w AS fv, last_value(event_type) OVER w AS lv, lag(value) OVER w AS lg, lag(value, 2, 0.0D) OVER w AS lg2, lead(event_type, 1, 'none') OVER w AS ld, nth_value(value, 2) OVER w AS nv FROM events WINDOW w AS {_W}",
        f"SELECT event_id, first(value) OVER w AS f, last(value) OVER w AS l, first_value(event_type) OVER w AS fv, last_value(event_type) OVER w AS lv, lag(value) OVER w AS lg, lag(value, 2, 0.0::DOUBLE) OVER w AS lg2, lead(event_type, 1, 'none') OVER w AS ld, nth_value(value, 2) OVER w AS nv FROM events WINDOW w AS {_W}"),
    "win_value_nulls": ("events", f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER {_W} AS held FROM events", f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER {_W} AS held FROM events"),
    "win_agg": ("events", f"SELECT event_id, round(sum(value) OVER {_W}, 4) AS s, round(avg(value) OVER {_W} + 1e-9, 6) AS a, min(value) OVER {_W} AS lo, max(value) OVER {_W} AS hi, count(*) OVER {_W} AS n, count(value) OVER (PARTITION BY user_id) AS alln FROM events"),
    "win_rows": ("events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM events"),
    "win_rows_short": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) AS n FROM events"),
    "win_range": ("events", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY cast(floor(value) AS int) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM events"),
    "win_range_interval": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hour FROM events"),
    "win_stddev": ("events", "SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY event_type), 6) AS sd FROM events"),
    "win_of_agg": ("events", "SELECT user_id, event_type, count(*) AS n, cast(rank() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS bigint) AS rk FROM events GROUP BY user_id, event_type"),
    "win_topk_per_group": ("events", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER {_W} AS rn FROM events) t WHERE rn <= 3"),
}
QUERIES, ORACLES = paired(_SQL)
