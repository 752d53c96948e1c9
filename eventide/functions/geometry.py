"""Box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IOU_EPS = 1e-6  # fixed value: added to the union


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def center_x(x1: Column, x2: Column) -> Column:
    return (x1 + x2) * 0.5


def side(cx: Column, width: Column, margin: float) -> Column:
    return (
        F.when(cx < width * F.lit(margin), "left")
        .when(cx > width * F.lit(1.0 - margin), "right")
        .otherwise("center")
    )


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    overlap = area(F.greatest(ax1, bx1), F.greatest(ay1, by1), F.least(ax2, bx2), F.least(ay2, by2))
    # raw areas: an inverted box keeps its sign here
    total = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)
    return overlap / (total - overlap + F.lit(IOU_EPS))


def exit_side(first: Column, last: Column) -> Column:
    end = F.coalesce(last, first, F.lit("center"))
    return F.when(end.isin("left", "right"), end).otherwise("center")


def exit_reason(first: Column, last: Column) -> Column:
    begin = F.coalesce(first, last, F.lit("center"))
    end = F.coalesce(last, begin)
    return (
        F.when(~end.isin("left", "right"), "lost_in_center")
        .when(begin != end, "trajectory_side_crossing")
        .otherwise("edge_exit")
    )


def side_phrase(first: Column, exit_: Column) -> Column:
    """The `` from a to b`` part of an object summary."""
    return (
        F.when(exit_.isin("left", "right") & (first != exit_), F.format_string(" from %s to %s", first, exit_))
        .when(exit_.isin("left", "right"), F.format_string(" near %s side", exit_))
        .when(first.isNotNull(), F.format_string(" near %s side (lost_in_center)", first))
        .otherwise("")
    )
