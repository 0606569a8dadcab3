"""Post-processing of detection and recognition models: boxes, text regions, label sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<left: float, top: float, right: float, bottom: float, score: float>>"


def decode_anchors(scores: np.ndarray, offsets: np.ndarray, centres: np.ndarray, stride: float, least: float) -> list[tuple]:
    """Boxes of anchors that score ``least`` or more: distances to the four sides, in strides, around each centre."""
    keep = np.flatnonzero(scores >= least)
    d, c = offsets[keep] * stride, centres[keep]
    return [(float(x - o[0]), float(y - o[1]), float(x + o[2]), float(y + o[3]), float(s)) for (x, y), o, s in zip(c, d, scores[keep], strict=True)]


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def suppress(boxes: list[tuple], most: float = 0.4) -> list[tuple]:
    """Greedy non-maximum suppression: the best box goes on, and those that overlap it more than ``most`` fall."""
    kept: list[tuple] = []
    for b in sorted(boxes, key=lambda x: (-x[4], x[:4])):
        if all(overlap(b, k) <= most for k in kept):
            kept.append(b)
    return kept


def nms(boxes: Column, most: float = 0.4) -> Column:
    """suppress() over a column of BOXES."""

    @F.pandas_udf(BOXES)
    def run(column: pd.Series) -> pd.Series:
        fields = ("left", "top", "right", "bottom", "score")
        return column.map(lambda rows: [dict(zip(fields, b, strict=True)) for b in suppress([tuple(r[f] for f in fields) for r in rows], most)] if rows is not None else None)

    return run(boxes)


def regions(probability: np.ndarray, least: float = 0.3, smallest: int = 1) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (left, top, right, bottom; ends excluded) of 4-connected cells at ``least`` or more, in reading order."""
    on = probability >= least
    seen = np.zeros(on.shape, bool)
    out = []
    for y, x in zip(*np.nonzero(on), strict=True):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            i, j = stack.pop()
            cells.append((i, j))
            for p, q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= p < on.shape[0] and 0 <= q < on.shape[1] and on[p, q] and not seen[p, q]:
                    seen[p, q] = True
                    stack.append((p, q))
        if len(cells) >= smallest:
            rows, columns = zip(*cells, strict=True)
            out.append((int(min(columns)), int(min(rows)), int(max(columns)) + 1, int(max(rows)) + 1))
    return out


def ctc_text(best: Column, alphabet: list[str], blank: int = 0) -> Column:
    """Text of a sequence of best labels: repeats count once, blanks not at all. Label i is alphabet[i - 1]."""
    letters = F.array(*[F.lit(x) for x in alphabet])
    pairs = F.zip_with(best, F.concat(F.array(F.lit(-1)), F.slice(best, 1, F.greatest(F.size(best) - 1, F.lit(0)))), lambda a, b: F.when((a != b) & (a != blank), F.element_at(letters, a)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "")
