"""Rows of two frames in a common form."""

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))
