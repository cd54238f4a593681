"""Pieces of checking SQL used by several queries."""

from __future__ import annotations


def gaps(source: str, floor_us: int = 1_800_000_000, factor: int = 3, columns: str = "") -> str:
    """CTEs ending in ``g``: rows with neighbour times, the key's median gap and its break threshold."""
    return f"""g0 AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS prev_us, lead(epoch_us(ts)) OVER w AS next_us{columns}
        FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      m AS (SELECT user_id, median(us - prev_us) AS typical FROM g0 GROUP BY user_id),
      g AS (SELECT g0.*, typical, greatest({floor_us}.0::DOUBLE, typical * {factor}) AS lim FROM g0 LEFT JOIN m USING (user_id))"""


SEGMENTS = """seg AS (SELECT *, SUM(CASE WHEN prev_us IS NULL OR us - prev_us > lim THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g)"""

PRESENCE = "pres AS (SELECT r.*, CASE WHEN light > room_lux THEN 1 ELSE 0 END AS presence FROM readings r JOIN hoods USING (user_id))"
