"""Requests and answers as JSON lines, and a session that serves them in order.

A request is a `compute` (points and settings), a `change_cover` or a `draw`; an answer is `completed` (a document for
each dataset) or `progress`. Growth is done anew only if points or settings that it depends on differ.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from .lifecycle import Drawing

SETTINGS = "struct<p_size:double,bend_inflection:boolean,max_bend_angle:double,max_turning_angle:double,banks:boolean,islands:boolean,postpone_cover_radius:boolean,postpone_intersections:boolean,forbid_too_close:double,point_clearance:double,cover:double,whiten:double>"
POINTS = "array<struct<dataset_id:bigint,point_id:bigint,type:int,x:double,y:double>>"
REQUEST = f"struct<kind:string,points:{POINTS},settings:{SETTINGS},cover:double,whiten:double>"


def parse_requests(lines: DataFrame, content: str = "value") -> DataFrame:
    """Requests with their fields as columns; `valid` says whether a line is a request with what its kind needs."""
    r = F.from_json(content, REQUEST)
    kind, points, settings = r["kind"], r["points"], r["settings"]
    needs = F.when(kind == "compute", points.isNotNull()).when(kind == "change_cover", r["cover"].isNotNull()).when(kind == "draw", F.lit(True)).otherwise(F.lit(False))
    others = [c for c in lines.columns if c != content]
    return lines.select(*others, kind.alias("kind"), points.alias("points"), settings.alias("settings"), r["cover"].alias("cover"), r["whiten"].alias("whiten"), F.coalesce(needs, F.lit(False)).alias("valid"))


def completed(documents: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(by, value): an answer for each document."""
    return documents.select(by, F.to_json(F.struct(F.lit("completed").alias("kind"), F.col(by).alias("dataset_id"), F.col("document").alias("svg"))).alias("value"))


def progress_line(share: float) -> str:
    return json.dumps({"kind": "progress", "progress": float(share)})


def progress(share: float, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(progress_line(share),)], "value string")


class Session:
    """What one client has asked for. Answers to requests that need an earlier one are None where there is none."""

    def __init__(self, spark: SparkSession, tell=None):
        """tell: called with a progress message (a line of JSON) now and then while points grow."""
        self.spark = spark
        self.tell = tell and (lambda share: tell(progress_line(share)))
        self.drawing: Drawing | None = None
        self.grown: tuple | None = None
        self.growths = 0

    def serve(self, line: str) -> DataFrame | None:
        row = parse_requests(self.spark.createDataFrame([(line,)], "value string")).first()
        if not row["valid"]:
            raise ValueError("not a request")
        if row["kind"] == "compute":
            given = {k: v for k, v in (row["settings"].asDict() if row["settings"] else {}).items() if v is not None}
            settings = Settings(**given)
            points = self.spark.createDataFrame(row["points"], "dataset_id long, point_id long, type int, x double, y double")
            growth = (line_points(row["points"]), {k: v for k, v in settings.__dict__.items() if k not in ("cover", "whiten", "point_clearance")})
            if self.grown == growth:
                self.drawing = self.drawing.with_settings(settings)
            else:
                self.drawing, self.grown, self.growths = Drawing(points, settings).compute(self.tell), growth, self.growths + 1
        elif self.drawing is None:
            return None
        elif row["kind"] == "change_cover":
            self.drawing.change_cover(row["cover"])
        elif row["whiten"] is not None:
            self.drawing.with_whiten(row["whiten"])
        return completed(self.drawing.draw())


def line_points(points: list) -> list[tuple]:
    return sorted(tuple(p) for p in points)
