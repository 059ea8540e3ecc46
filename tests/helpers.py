"""Small cubes as cells, and naive versions of identification in plain Python."""

from __future__ import annotations

import numpy as np

CELLS = "sequence_id string, t long, y int, x int, rain float, valid boolean"


def tables(spark, cube, sequence="s", start=0):
    """(cells, frames, grid) of a (time, y, x) array; NaN and Inf are missing."""
    from cellweave.grid import Grid

    cube = np.asarray(cube, np.float32)
    rows = [(sequence, int(t) + start, int(y), int(x), float(cube[t, y, x]), bool(np.isfinite(cube[t, y, x]))) for t, y, x in np.argwhere((cube != 0) | ~np.isfinite(cube))]
    cells = spark.createDataFrame(rows, CELLS)
    frames = spark.createDataFrame([(sequence, t + start) for t in range(len(cube))], "sequence_id string, t long")
    return cells, frames, Grid(*cube.shape[1:])


def dense(labels, shape, column="label"):
    out = np.zeros(shape, int)
    for r in labels.collect():
        out[r.t, r.y, r.x] = r[column]
    return out


def naive_identify(frame, offsets, threshold=0.0, min_size=1):
    """Labels of one frame by sets and flood fill."""
    ny, nx = frame.shape
    ok = np.isfinite(frame)
    wet = {(y, x) for y in range(ny) for x in range(nx) if ok[y, x] and frame[y, x] >= np.float32(threshold) and frame[y, x] > 0}
    ground = {(y + dy, x + dx) for y, x in wet for dy, dx in offsets if 0 <= y + dy < ny and 0 <= x + dx < nx and ok[y + dy, x + dx]} | wet
    out, seen, n = np.zeros(frame.shape, int), set(), 0
    groups = []
    for p in sorted(ground):
        if p in seen:
            continue
        stack, part = [p], []
        seen.add(p)
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in ground and q not in seen:
                    seen.add(q)
                    stack.append(q)
        part = sorted(set(part) & wet)
        if len(part) >= max(1, min_size):
            groups.append(part)
    for part in sorted(groups):
        n += 1
        for p in part:
            out[p] = n
    return out
