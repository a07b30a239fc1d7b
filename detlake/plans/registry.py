"""Registry of queries and the derived input tables they share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Given tables and the views derived from them, loaded when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        body, needs = fixtures.VIEWS[name]
        args = {n: getattr(self, n) if n in fixtures.VIEWS else self.table(n) for n in needs}
        for n in needs:
            body = body.replace(f"FROM {n} ", f"FROM {{{n}}} ")
        return self.spark.sql(body, **args)

    @cached_property
    def det(self):
        return self._view("det")

    def stored(self) -> "Tables":
        """The same tables, for queries that read the detections several times: their ids are counted and written once, so that each reader
        does not shuffle the rows again."""
        out = Tables(self.spark, self.folder)
        out.det = materialize(self.det, "det")
        return out

    @cached_property
    def gt(self):
        return self._view("gt")

    @cached_property
    def images(self):
        return self._view("images")

    @cached_property
    def obb(self):
        return self._view("obb")

    @cached_property
    def tracks(self):
        return self._view("tracks")

    @cached_property
    def runs(self):
        return self._view("runs")

    @cached_property
    def regions(self):
        """One row per region; the outline is an ordered point array."""
        rows = {}
        for rid, name, x, y in fixtures.REGION_POINTS:
            rows.setdefault((rid, name), []).append((x, y))
        return self.spark.createDataFrame(
            [(k[0], k[1], v) for k, v in rows.items()], "region_id int, name string, points array<struct<x:double,y:double>>"
        )

    def region(self, name: str) -> DataFrame:
        return self.regions.filter(F.col("name") == name)

    @cached_property
    def polys(self):
        """Boxes as polygons; every second one has an extra vertex on its right side."""
        from ..functions.rotated import point

        four = [point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")]
        five = [*four[:2], point("x2", (F.col("y1") + F.col("y2")) / 2), *four[2:]]
        return self.det.withColumn(
            "polygon", F.when(F.col("det_id") % 2 == 0, F.array(*five)).otherwise(F.array(*four))
        )

    @cached_property
    def kpts(self):
        """Five keypoints per box: the corners and the centre; some are invisible."""
        return self.det.withColumn("keypoints", keypoints_of("det_id"))


def keypoints_of(id_col: str) -> Column:
    c = F.col
    spots = [
        (c("x1"), c("y1")), (c("x2"), c("y1")), (c("x2"), c("y2")), (c("x1"), c("y2")),
        ((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2),
    ]
    return F.array(
        *[
            F.struct(
                x.alias("x"), y.alias("y"), F.when((c(id_col) + k) % 7 == 0, 0.0).otherwise(1.0).cast("double").alias("v")
            )
            for k, (x, y) in enumerate(spots)
        ]
    )


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the derived ``views`` by name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = fixtures.with_views(views.split(), sql)
        return fn

    return wrap


def r6(**exprs) -> list[Column]:
    """Columns rounded to six digits, for comparison across engines."""
    return [F.round(c, 6).alias(n) for n, c in exprs.items()]


def rounded(d: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in d.items()]


def sql6(**exprs) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in exprs.items())


def sql9(**exprs) -> str:
    """Nine digits for normalised values, whose seventh digit is often an exact 5."""
    return sql6(**exprs).replace(", 6) AS", ", 9) AS")
