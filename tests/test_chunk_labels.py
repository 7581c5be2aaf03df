"""Components over chunks against flood fill of whole volumes."""

import numpy as np
import pytest

from tests.test_volumes import ALL, SIX, flags, flood, pieces, plain_clean, true
from voxloom.operators import chunk_labels as cl
from voxloom.operators import segmentation


def mask_of(r):
    return np.frombuffer(r["xct"], np.uint8).reshape([r[c] for c in "dhw"]).astype(bool)


def labelled(spark, mask, connectivity, size):
    return cl.labelled(cl.pieces(pieces(spark, mask, size=size), mask_of, connectivity, size), connectivity, size)


def spiral(n):
    out, (y, x), (dy, dx) = np.zeros((1, n, n), bool), (0, 0), (0, 1)
    for length in [n - 1, *[k for m in range(n - 1, 1, -2) for k in (m, m)]]:
        for _ in range(length):
            out[0, y, x] = True
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    return out


def u_shape(depth):
    out = np.zeros((depth, 5, 3), bool)
    out[:, [0, 4], 1] = out[-1, :, 1] = True
    return out


@pytest.mark.parametrize(("connectivity", "offsets"), [(6, SIX), (26, ALL)])
@pytest.mark.parametrize("shape", ["random", "solid", "spiral", "u", "diagonals"])
def test_against_flood_fill(spark, connectivity, offsets, shape):
    rng = np.random.default_rng(7)
    corners = np.zeros((8, 8, 8), bool)
    corners[[3, 4, 3, 4, 0, 7], [3, 4, 4, 3, 0, 7], [3, 4, 3, 4, 0, 7]] = True
    mask = {"random": rng.random((9, 11, 13)) < 0.28, "solid": np.ones((6, 9, 5), bool), "spiral": spiral(30), "u": u_shape(500), "diagonals": corners}[shape]
    size = {"u": 8, "diagonals": 4}.get(shape, 4)
    label = flood(mask, offsets) if shape not in ("u", "spiral") else mask.astype(int)
    got = cl.measured(labelled(spark, mask, connectivity, size)).collect()
    want = set()
    for n in range(1, label.max() + 1):
        at = np.argwhere(label == n)
        z, y, x = map(int, at[0])
        want.add(((z << 42) + (y << 21) + x, len(at), *(np.ptp(at, axis=0) + 1).tolist()))
    assert {(r.label, r.size, r.dz, r.dy, r.dx) for r in got} == want and len(got) == len(want)


def test_what_leaves_a_chunk_grows_with_its_surface(spark):
    mask = np.random.default_rng(2).random((32, 32, 32)) < 0.5
    rows = {size: cl.pieces(pieces(spark, mask, size=size), mask_of, 26, size).where("not whole").count() for size in (8, 16, 32)}
    assert rows[16] < 0.62 * rows[8] and rows[32] < 0.62 * rows[16]


@pytest.mark.parametrize("size", [4, 16])
def test_pores_over_many_chunks(spark, size):
    rng = np.random.default_rng(3)
    volume = np.full((20, 21, 22), 200)
    volume[3:17, 3:17, 3:17] = np.where(rng.random((14, 14, 14)) < 0.25, 20, 200)
    plain, clean = (segmentation.segmented_pores(pieces(spark, volume, size=size), window=6, k=0.125, least=least, size=size) for least in (-1, 8))
    before, after = (flags(d, "pore", size=size)[0] for d in (plain, clean))
    mask = np.zeros(volume.shape, bool)
    mask[tuple(np.array(sorted(before)).T)] = True
    assert after == true(plain_clean(mask, 8)) and after != before
