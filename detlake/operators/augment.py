"""Label-level augmentation: what happens to boxes when images are combined, and sampling of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import similarity as S
from .joins import BOX, candidate_pairs
from .ordered import running, with_global_rank


def shuffle_key(seed: int, *cols: str) -> Column:
    """Pseudo-random order of rows that depends only on the seed and the values."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def image_groups(images: DataFrame, size: int, order: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Adds ``grp`` and ``tile`` (0-based): consecutive images in a shuffled, or the given, order."""
    if order is None:
        images = images.withColumn("_key", shuffle_key(seed, "image_id"))
        order = ["_key", "image_id"]
    ranked = with_global_rank(images, *order, name="_rank")
    at = F.col("_rank") - 1
    return ranked.withColumns({"grp": F.floor(at / size), "tile": (at % size).cast("int")}).drop("_rank", "_key")


def mosaic_layout(images: DataFrame, n: int, size: int, center: tuple[Column, Column] | None = None, **kw) -> DataFrame:
    """Where each image of a mosaic lies: ``image_id, grp, tile, dx, dy``; incomplete groups are left out.

    ``n`` is 4 (2x2 around ``center``, by default the middle), 3 (a row) or 9 (3x3). ``size`` is the tile size; images have
    their resized ``width`` and ``height``.
    """
    g = image_groups(images, n, **kw)
    if n == 4:
        cx, cy = center if center is not None else (F.lit(size), F.lit(size))
        g = g.withColumns({"_cx": cx, "_cy": cy})
        left, upper = F.col("tile").isin(0, 2), F.col("tile").isin(0, 1)
        out = g.withColumns(
            {
                "dx": F.when(left, F.col("_cx") - F.col("width")).otherwise(F.col("_cx")),
                "dy": F.when(upper, F.col("_cy") - F.col("height")).otherwise(F.col("_cy")),
                "_n": F.count("*").over(Window.partitionBy("grp")),
            }
        )
    else:
        # sizes of the group's tiles by position, at most nine
        dims = g.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("tile", "width", "height"))).alias("d"))
        out = g.join(dims, "grp").withColumn("_n", F.size("d"))
        w, h, i, s = F.col("width"), F.col("height"), F.col("tile"), F.lit(size)
        w0, h0 = F.col("d")[0]["width"], F.col("d")[0]["height"]
        prev = F.get("d", i - 1)
        wp, hp = prev["width"], prev["height"]
        if n == 3:
            x = [s, s + w0, s - w]
            y = [s, s, s + h0 - h]
        else:
            x = [s, s, s + wp, s + w0, s + w0, s + w0 - w, s + w0 - wp - w, s - w, s - w]
            y = [s, s - h, s - h, s, s + hp, s + h0, s + h0, s + h0 - h, s + h0 - hp - h]
        half = size // 2

        def pick(vals):
            c = F.when(i == 0, vals[0])
            for k, v in enumerate(vals[1:], 1):
                c = c.when(i == k, v)
            return c - half

        out = out.withColumns({"dx": pick(x), "dy": pick(y)})
    return out.filter(F.col("_n") == n).select("image_id", "grp", "tile", "dx", "dy")


def mosaic(ann: DataFrame, layout: DataFrame, size: int) -> DataFrame:
    """Labels of the mosaics: shifted, cut to the ``2 * size`` canvas, empty boxes dropped; ``grp`` is the new image."""
    d = ann.join(layout, "image_id")
    d = d.withColumns(B.shift_box(*BOX, "dx", "dy"))
    d = d.withColumns(B.clip_box(*BOX, float(2 * size), float(2 * size)))
    return d.filter(B.area(*BOX) > 0).drop("dx", "dy")


def mixup(images: DataFrame, ann: DataFrame, **kw) -> DataFrame:
    """Labels of image pairs laid over each other; ``grp`` is the new image."""
    return ann.join(image_groups(images.select("image_id"), 2, **kw).select("image_id", "grp", "tile"), "image_id")


def paste_candidates(boxes: DataFrame, others: DataFrame, p: float = 0.5, ioa: float = 0.30, uid="ann_id") -> DataFrame:
    """Which of ``others`` to paste: those that cover less than ``ioa`` of every box of the image.

    Ordered by the largest share they cover, the first round(p * n) per image are taken. Adds ``worst`` and ``place``.
    """
    keys = ["image_id"]
    right = boxes.select("image_id", *BOX)

    def share(L, R):
        return S.ioa([L(c) for c in BOX], [R(c) for c in BOX])

    pairs = candidate_pairs(others.select("image_id", uid, *BOX), right, keys, condition=lambda L, R: share(L, R) > 0)
    worst = pairs.groupBy("image_id", uid).agg(F.max(share(F.col, lambda c: F.col(f"b_{c}"))).alias("worst"))
    free = others.join(worst, ["image_id", uid], "left").withColumn("worst", F.coalesce("worst", F.lit(0.0)))
    free = free.filter(F.col("worst") < ioa).withColumn("_one", F.lit(1))
    # blocks grow with (worst, uid): boxes that touch nothing are split by id, the others by their share
    block = F.when(F.col("worst") == 0, F.floor(F.col(uid) / 4096) - (1 << 40)).otherwise(F.floor(F.col("worst") * 1e6))
    ranked = running(free, keys, ["worst", uid], block, sums={"place": "_one"})
    n = free.groupBy("image_id").agg(F.bround(F.count("*") * p, 0).alias("_take"))
    return ranked.join(n, "image_id").filter(F.col("place") <= F.col("_take")).drop("_one", "_take")


def _hash_fraction(*parts) -> Column:
    """Number in [0, 1) from a hash of the values."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def paste(boxes: DataFrame, others: DataFrame, p: float = 0.5, ioa: float = 0.30, uid="ann_id") -> DataFrame:
    """The labels of each image after pasting: its own ``boxes`` and the chosen ones of ``others``, told apart by ``pasted``."""
    chosen = paste_candidates(boxes, others, p, ioa, uid).select(*boxes.columns)
    return boxes.withColumn("pasted", F.lit(False)).unionByName(chosen.withColumn("pasted", F.lit(True)))


def sample_prompts(
    ann: DataFrame, nc: int, neg: tuple[int, int] = (5, 10), max_samples: int = 80, seed: int = 0, images: DataFrame | None = None
) -> DataFrame:
    """Classes offered as prompts per image: ``image_id, cls, positive, new_cls``.

    The image's own classes come first (a hash sample when there are more than ``max_samples``), then a hash sample of the
    others; both are mixed by hash and numbered. With ``images`` those without annotations get classes too, all of them
    negative. All classes of an image are drawn inside its row; only the chosen ones become rows.
    """
    s = F.lit(seed)
    per = ann.groupBy("image_id").agg(F.collect_set("cls").alias("_own"))
    if images is not None:
        per = images.select("image_id").distinct().join(per, "image_id", "left")
        per = per.withColumn("_own", F.coalesce("_own", F.expr("CAST(array() AS array<int>)")))
    image = F.col("image_id")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda c: F.struct(_hash_fraction(s, image, c).alias("u"), c.alias("cls")))
    per = per.withColumn("_all", F.array_sort(drawn))
    own = F.slice(F.filter("_all", lambda c: F.array_contains("_own", c["cls"])), 1, max_samples)
    # classes beyond the sample of own ones count among the others
    lo, hi = neg
    wanted = F.lit(lo) + F.floor(_hash_fraction(s, image) * (hi - lo + 1))
    taken = F.least(F.size(F.array_intersect("_own", F.sequence(F.lit(0), F.lit(nc - 1)))), F.lit(max_samples))
    room = F.greatest(F.least(F.lit(min(nc, max_samples)) - taken, wanted), F.lit(0)).cast("int")
    rest = F.slice(F.filter("_all", lambda c: ~F.array_contains("_own", c["cls"])), F.lit(1), room)

    def marked(part: Column, positive: bool) -> Column:
        return F.transform(
            part, lambda c: F.struct(_hash_fraction(s, F.lit("mix"), image, c["cls"]).alias("mix"), c["cls"].alias("cls"), F.lit(positive).alias("positive"))
        )

    mixed = F.array_sort(F.concat(marked(own, True), marked(rest, False)))
    out = per.select("image_id", F.posexplode(mixed).alias("new_cls", "_c"))
    return out.select("image_id", F.col("_c.cls").alias("cls"), F.col("_c.positive").alias("positive"), "new_cls")


def remap_to_prompts(ann: DataFrame, prompts: DataFrame) -> DataFrame:
    """Annotations of offered classes, renumbered to the prompts."""
    m = prompts.select("image_id", "cls", "new_cls")
    return ann.join(m, ["image_id", "cls"]).withColumn("cls", F.col("new_cls")).drop("new_cls")


def prompt_texts(
    prompts: DataFrame, names: Sequence[str | Sequence[str]], template: str = "{}", size: int | None = None, padding: str = "", seed: int = 0
) -> DataFrame:
    """Ordered prompt texts per image, padded to ``size``. At most ``size`` or the number of classes per image.

    A class may have several names; each image gets one of them, chosen by hash.
    """
    head, tail = template.split("{}", 1)
    table = F.array(*[F.array(*[F.lit(n) for n in ([own] if isinstance(own, str) else own)]) for own in names])
    own = F.element_at(table, F.col("cls") + 1)
    pick = F.floor(_hash_fraction(F.lit(seed), F.lit("name"), F.col("image_id"), F.col("cls")) * F.size(own)).cast("int")
    text = F.concat(F.lit(head), F.get(own, pick), F.lit(tail))
    out = prompts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("new_cls", text.alias("t")))).alias("l"))
    texts = F.transform("l", lambda s: s["t"])
    if size is not None:
        texts = F.concat(texts, F.array_repeat(F.lit(padding), F.greatest(F.lit(size) - F.size("l"), F.lit(0))))
    return out.select("image_id", texts.alias("texts"))
