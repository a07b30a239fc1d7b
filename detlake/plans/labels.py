"""Queries over label-level augmentation and prompt sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import augment as AU
from .pairs import IOA
from .registry import query, r6

BOX = ("x1", "y1", "x2", "y2")


def _ann(t):
    return t.gt.select("image_id", "ann_id", "cls", *BOX)


GRP = "g AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY image_id) - 1) // {n} AS grp, (ROW_NUMBER() OVER (ORDER BY image_id) - 1) % {n} AS tile FROM images)"
CUT = """mo AS (SELECT grp, tile, ann_id, greatest(least(x1 + dx, 1280), 0) AS x1, greatest(least(y1 + dy, 1280), 0) AS y1, greatest(least(x2 + dx, 1280), 0) AS x2, greatest(least(y2 + dy, 1280), 0) AS y2 FROM l JOIN gt USING (image_id))
SELECT grp, CAST(tile AS INT) AS tile, ann_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM mo WHERE (x2 - x1) * (y2 - y1) > 0"""


def _out(df):
    return df.select("grp", "tile", "ann_id", *r6(**{c: F.col(c) for c in BOX}))


@query(
    "g28_mosaic4", "gt images",
    f"WITH {GRP.format(n=4)}, c AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, 400 + grp % 480 AS cx, 420 + grp % 440 AS cy FROM g),"
    f" l AS (SELECT image_id, grp, tile, CASE WHEN tile IN (0, 2) THEN cx - width ELSE cx END AS dx, CASE WHEN tile < 2 THEN cy - height ELSE cy END AS dy FROM c WHERE n = 4), {CUT}",
)
def g28(t):
    center = (F.lit(400) + F.col("grp") % 480, F.lit(420) + F.col("grp") % 440)
    return _out(AU.mosaic(_ann(t), AU.mosaic_layout(t.images, 4, 640, center, order=["image_id"]), 640))


@query(
    "g28_mosaic3", "gt images",
    f"WITH {GRP.format(n=3)}, c AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, first_value(width) OVER w AS w0, first_value(height) OVER w AS h0 FROM g WINDOW w AS (PARTITION BY grp ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),"
    f" l AS (SELECT image_id, grp, tile, CASE tile WHEN 0 THEN 640 WHEN 1 THEN 640 + w0 ELSE 640 - width END - 320 AS dx, CASE tile WHEN 2 THEN 640 + h0 - height ELSE 640 END - 320 AS dy FROM c WHERE n = 3), {CUT}",
)
def g28c(t):
    return _out(AU.mosaic(_ann(t), AU.mosaic_layout(t.images, 3, 640, order=["image_id"]), 640))


@query(
    "g28_mosaic9", "gt images",
    f"WITH {GRP.format(n=9)}, c AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, first_value(width) OVER w AS w0, first_value(height) OVER w AS h0, lag(width) OVER (PARTITION BY grp ORDER BY tile) AS wp, lag(height) OVER (PARTITION BY grp ORDER BY tile) AS hp FROM g WINDOW w AS (PARTITION BY grp ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),"
    " l AS (SELECT image_id, grp, tile, 320 + CASE tile WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN wp WHEN 3 THEN w0 WHEN 4 THEN w0 WHEN 5 THEN w0 - width WHEN 6 THEN w0 - wp - width ELSE -width END AS dx,"
    f" 320 + CASE tile WHEN 0 THEN 0 WHEN 1 THEN -height WHEN 2 THEN -height WHEN 3 THEN 0 WHEN 4 THEN hp WHEN 5 THEN h0 WHEN 6 THEN h0 WHEN 7 THEN h0 - height ELSE h0 - hp - height END AS dy FROM c WHERE n = 9), {CUT}",
)
def g28n(t):
    return _out(AU.mosaic(_ann(t), AU.mosaic_layout(t.images, 9, 640, order=["image_id"]), 640))


@query(
    "g29_mixup", "gt images",
    "WITH h AS (SELECT image_id, (ROW_NUMBER() OVER (ORDER BY sha256('7|' || image_id), image_id) - 1) // 2 AS grp FROM images)"
    " SELECT grp, count(*) AS labels, CAST(sum(cls) AS BIGINT) AS cls FROM gt JOIN h USING (image_id) GROUP BY 1",
)
def g29(t):
    m = AU.mixup(t.images, _ann(t), seed=7)
    return m.groupBy("grp").agg(F.count("*").alias("labels"), F.sum("cls").alias("cls"))


@query(
    "f05_paste_candidates", "gt images",
    "WITH fl AS (SELECT image_id, ann_id, width - x2 AS x1, y1, width - x1 AS x2, y2 FROM gt JOIN images USING (image_id)),"
    f" w AS (SELECT a.image_id, a.ann_id, max({IOA}) AS worst FROM fl a JOIN gt b ON a.image_id = b.image_id GROUP BY 1, 2),"
    " k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY worst, ann_id) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM w WHERE worst < 0.3)"
    " SELECT image_id, ann_id, round(worst, 6) AS worst, place FROM k WHERE place <= round_even(n * 0.5::DOUBLE, 0)",
)
def f05(t):
    g = _ann(t).join(t.images.select("image_id", "width"), "image_id")
    flipped = g.withColumns(B.flip_box(*BOX, width="width")).drop("width")
    out = AU.paste_candidates(_ann(t), flipped, 0.5)
    return out.select("image_id", "ann_id", *r6(worst=F.col("worst")), "place")


@query(
    "f05_pasted_labels", "gt images",
    "WITH fl AS (SELECT image_id, ann_id, cls, width - x2 AS x1, y1, width - x1 AS x2, y2 FROM gt JOIN images USING (image_id)),"
    f" w AS (SELECT a.image_id, a.ann_id, max({IOA}) AS worst FROM fl a JOIN gt b ON a.image_id = b.image_id GROUP BY 1, 2),"
    " k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY worst, ann_id) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM w WHERE worst < 0.3),"
    " c AS (SELECT image_id, ann_id FROM k WHERE place <= round_even(n * 0.5::DOUBLE, 0))"
    " SELECT image_id, ann_id, cls, round(x1, 6) AS x1, round(x2, 6) AS x2, false AS pasted FROM gt"
    " UNION ALL SELECT image_id, ann_id, cls, round(x1, 6), round(x2, 6), true FROM fl JOIN c USING (image_id, ann_id)",
)
def f05p(t):
    """Every image's labels after half of the free, mirrored instances were pasted."""
    g = _ann(t)
    flipped = g.join(t.images.select("image_id", "width"), "image_id").withColumns(B.flip_box(*BOX, width="width")).drop("width")
    return AU.paste(g, flipped, 0.5).select("image_id", "ann_id", "cls", *r6(x1=F.col("x1"), x2=F.col("x2")), "pasted")


def U(*parts):
    text = " || '|' || ".join(parts)
    return f"('0x' || substr(sha256({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496"


@query(
    "l06_sample_prompts", "gt",
    f"WITH o AS (SELECT DISTINCT image_id, cls FROM gt), e AS (SELECT DISTINCT image_id, c.range::INT AS cls FROM gt, range(12) c), c AS (SELECT e.image_id, e.cls, o.cls IS NOT NULL AS positive, {U(chr(39) + '3' + chr(39), 'e.image_id', 'e.cls')} AS u FROM e LEFT JOIN o ON o.image_id = e.image_id AND o.cls = e.cls),"
    f" r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, positive ORDER BY u, cls) AS r, sum(positive::INT) OVER (PARTITION BY image_id) AS pos, 2 + floor({U(chr(39) + '3' + chr(39), 'image_id')} * 3) AS want FROM c),"
    f" k AS (SELECT *, {U(chr(39) + '3' + chr(39), chr(39) + 'mix' + chr(39), 'image_id', 'cls')} AS mix FROM r WHERE CASE WHEN positive THEN r <= 3 ELSE r <= least(3 - least(pos, 3), want) END)"
    " SELECT image_id, cls, positive, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY mix, cls) - 1 AS INT) AS new_cls FROM k",
)
def l06(t):
    return AU.sample_prompts(t.gt, 12, (2, 4), 3, seed=3)


@query("l06_remap_to_prompts", "gt", "SELECT count(*) AS n, 0 AS outside FROM (SELECT image_id, cls, dense_rank() OVER (PARTITION BY image_id ORDER BY cls) AS d FROM gt) q WHERE d <= 1000")
def l06b(t):
    p = AU.sample_prompts(t.gt, 12, (2, 4), 12, seed=3)
    out = AU.remap_to_prompts(_ann(t), p)
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("cls") >= 12).cast("int").alias("outside"))


@query("l06_prompts_without_labels", "gt images", "SELECT image_id, count(*) AS n FROM (SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt WHERE cls < 2)), range(3) GROUP BY 1")
def l06c(t):
    """Images that have no annotation left get negative classes only."""
    some = t.gt.where("cls < 2")
    p = AU.sample_prompts(some, 12, (3, 3), 12, seed=3, images=t.images)
    return p.groupBy("image_id").agg(F.count_if("positive").alias("own"), F.count("*").alias("n")).where("own = 0").drop("own")
