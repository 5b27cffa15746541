"""Canny edges against a plain walk over drawn images of several sizes."""

import numpy as np

from tabloom.operators import image


def plain(v, low=100, high=200):
    h, w = v.shape
    p = np.pad(v.astype(int), 1, mode="edge")
    at = lambda dy, dx: p[1 + dy:h + 1 + dy, 1 + dx:w + 1 + dx]
    gx = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
    gy = at(1, -1) - at(-1, -1) + 2 * (at(1, 0) - at(-1, 0)) + at(1, 1) - at(-1, 1)
    m = np.pad(abs(gx) + abs(gy), 1)
    kept = set()
    for y in range(h):
        for x in range(w):
            here, slope = m[y + 1, x + 1], abs(gy[y, x]) / max(abs(gx[y, x]), 1e-9)
            if slope < np.tan(np.pi / 8):
                top = here > m[y + 1, x] and here >= m[y + 1, x + 2]
            elif slope > np.tan(3 * np.pi / 8):
                top = here > m[y, x + 1] and here >= m[y + 2, x + 1]
            else:
                s = -1 if gx[y, x] * gy[y, x] < 0 else 1
                top = here > m[y, x + 1 - s] and here > m[y + 2, x + 1 + s]
            if top and here > low:
                kept.add((y, x))
    todo = [k for k in kept if m[k[0] + 1, k[1] + 1] > high]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if n in kept and n not in found:
                found.add(n)
                todo.append(n)
    return found


def test_edges_of_drawn_images(spark):
    r = np.random.default_rng(6)
    images = [np.full((12, 9), 40), np.array([[7]]), r.integers(0, 256, (17, 23))]
    disc = np.full((40, 31), 90)
    y, x = np.indices(disc.shape)
    disc[(y - 20) ** 2 + (x - 15) ** 2 < 100] = 160
    disc[5:9, 2:25] += np.arange(23) * 3  # an edge that grows from weak to strong
    images += [disc, np.minimum(255, x[:1] * 9)]
    rows = [(k, i, j, *[int(im[i, j])] * 3) for k, im in enumerate(images) for i in range(im.shape[0]) for j in range(im.shape[1])]
    px = spark.createDataFrame(rows, "image_id bigint, y int, x int, r int, g int, b int")
    got = {k: set() for k in range(len(images))}
    for e in image.canny_edges(px).collect():
        got[e.image_id].add((e.y, e.x))
    want = {k: plain(im) for k, im in enumerate(images)}
    assert got == want and len(want[2]) > 20 and len(want[3]) > 20 and not want[0]
    ratios = {e.image_id: e.Edge_Pixel_Ratio for e in image.canny_edge_ratio(px).collect()}
    assert ratios == {k: round(len(want[k]) / im.size, 4) for k, im in enumerate(images)}
