"""Detection-shaped views over the given tables.

The same text is run by Spark and, as WITH clauses, by the SQL checks. Each entry is (body, inputs).
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, list[str]]] = {
    "det": (
        """
SELECT image_id, det_id, cls, conf, x1, y1, x1 + w AS x2, y1 + h AS y2, jit, keep, flip
FROM (
  SELECT l_orderkey AS image_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS det_id,
         CAST((l_orderkey + l_linenumber % 2) % 5 AS INT) AS cls,
         CAST(5 + (l_partkey * 31 + l_suppkey * 17) % 95 AS DOUBLE) / 100 AS conf,
         CAST((l_orderkey * 37) % 400 + (l_partkey % 4) * 25 AS DOUBLE) AS x1,
         CAST((l_orderkey * 53) % 250 + (l_suppkey % 3) * 30 AS DOUBLE) AS y1,
         60 + 2 * l_quantity AS w,
         80 + l_quantity AS h,
         CAST(4 * (l_suppkey % 4) AS DOUBLE) AS jit,
         CASE WHEN l_discount >= 0.025 THEN 1 ELSE 0 END AS keep,
         CASE WHEN l_tax > 0.065 THEN 1 ELSE 0 END AS flip
  FROM lineitem ) t""",
        ["lineitem"],
    ),
    "gt": (
        """
SELECT image_id, det_id AS ann_id,
       CASE WHEN flip = 1 THEN (cls + 1) % 5 ELSE cls END AS cls,
       x1 + jit AS x1, y1 + jit AS y1, x2 + jit AS x2, y2 + jit AS y2
FROM det WHERE keep = 1""",
        ["det"],
    ),
    "images": (
        """
SELECT o_orderkey AS image_id, CAST(640 + (o_orderkey % 3) * 160 AS INT) AS width,
       CAST(640 + (o_orderkey % 2) * 80 AS INT) AS height,
       CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split
FROM orders """,
        ["orders"],
    ),
    "obb": (
        """
SELECT image_id, det_id, cls, conf, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h,
       CAST((image_id + det_id) % 16 AS DOUBLE) / 16 * CAST(1.5707963267948966 AS DOUBLE) AS r
FROM det """,
        ["det"],
    ),
    "tracks": (
        """
SELECT video_id, frame_no, ts, track_id, cls, conf,
       cx - 20 AS x1, cy - 30 AS y1, cx + 20 AS x2, cy + 30 AS y2
FROM (
  SELECT user_id % 4 AS video_id, frame_no, ts, user_id AS track_id, event_type AS cls,
         CAST(5 + (event_id * 7) % 95 AS DOUBLE) / 100 AS conf,
         CAST((user_id * 97 + frame_no * 11) % 1100 AS DOUBLE) AS cx,
         CAST(340 + (user_id * 13 + frame_no * 7) % 80 AS DOUBLE) AS cy,
         ROW_NUMBER() OVER (PARTITION BY user_id, frame_no ORDER BY event_id) AS rn
  FROM (SELECT event_id, ts, user_id, event_type, CAST(FLOOR(event_id / 40) AS BIGINT) AS frame_no FROM events ) e) t
WHERE rn = 1""",
        ["events"],
    ),
    "runs": (
        """
SELECT o_custkey AS run_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS epoch,
       o_totalprice / 500000 AS fitness
FROM orders """,
        ["orders"],
    ),
}

# Outlines of the sample regions (a band, a line and two slots).
REGION_POINTS = [
    (1, "band", 20.0, 400.0), (1, "band", 1080.0, 400.0), (1, "band", 1080.0, 360.0), (1, "band", 20.0, 360.0),
    (2, "line", 20.0, 380.0), (2, "line", 1080.0, 380.0),
    (3, "slot_a", 100.0, 340.0), (3, "slot_a", 300.0, 340.0), (3, "slot_a", 300.0, 420.0), (3, "slot_a", 100.0, 420.0),
    (4, "slot_b", 600.0, 340.0), (4, "slot_b", 800.0, 340.0), (4, "slot_b", 800.0, 420.0), (4, "slot_b", 600.0, 420.0),
]


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the WITH clauses of the views it uses."""
    order: list[str] = []

    def add(n):
        for d in VIEWS[n][1]:
            if d in VIEWS:
                add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in order]
    text = sql.strip()
    for kw in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(kw):
            return f"{kw}{', '.join(parts)}, {text[len(kw):]}"
    return f"WITH {', '.join(parts)} {text}"
