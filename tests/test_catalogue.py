"""Every registered frame query against its SQL on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from framelark.operators import geometry
from framelark.plans import catalogue
from framelark.sources import views

TABLES = ["orders", "lineitem", "events", "documents", "embeddings", "pages"]


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        if pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(float)
        else:
            out[c] = out[c].astype(str)
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, data, con, name):
    got, want = catalogue.QUERIES[name](spark, data).toPandas(), con.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_exact=True)


def stack_of(px, value="v"):
    """{frame: array} of tall samples."""
    out = {}
    for f, g in px.groupby("f"):
        a = np.zeros((g.y.max() + 1, g.x.max() + 1))
        a[g.y, g.x] = g[value]
        out[f] = a
    return out


@pytest.fixture(scope="module")
def frames(spark, data):
    return stack_of(views.px(spark, data).toPandas())


def test_every_query_has_sql_or_a_test_here():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"repair_star_bridge", "phase_shifts", "aligned_frames", "collinear_merge"}


def shift_by_all_products(a, b):
    """How far b is moved against a: the largest circular correlation of the whitened frames, near its centroid."""
    w = np.outer(np.hanning(8), np.hanning(8))
    fa, fb = np.fft.fft2(a * w), np.fft.fft2(b * w)
    cross = np.conj(fa) * fb
    cross = np.where(np.abs(cross) > 1e-12, cross / np.maximum(np.abs(cross), 1e-12), 0)
    k = np.arange(8)
    wave = np.exp(2j * np.pi * np.outer(k, k) / 8) / 8
    r = np.roll((wave @ cross @ wave.T).real, (4, 4), (0, 1))
    y, x = divmod(int(np.argmax(r)), 8)
    spots = [(i, j, max(r[i, j], 0)) for i in range(max(0, y - 2), min(8, y + 3)) for j in range(max(0, x - 2), min(8, x + 3))]
    total = sum(s for *_, s in spots)
    return sum(j * s for _, j, s in spots) / total - 4, sum(i * s for i, _, s in spots) / total - 4, total


def test_phase_shifts_equal_plain_ones(spark, data, frames):
    got = {r.f: r for r in catalogue.QUERIES["phase_shifts"](spark, data).collect()}
    order = sorted(frames)
    base = frames[order[len(order) // 2]]
    for f, a in frames.items():
        assert np.allclose((got[f].dx, got[f].dy, got[f].response), shift_by_all_products(base, a), atol=1e-9)


def sampled(a, y, x, mode):
    """Bilinear sample of a plane beyond whose border ``mode`` continues it."""
    h, w = a.shape
    y0, x0 = int(np.floor(y)), int(np.floor(x))

    def at(i, j):
        if mode == "edge":
            return a[min(max(i, 0), h - 1), min(max(j, 0), w - 1)]
        fold = lambda v, n: (v := abs(v) % (2 * n - 2)) and (v if v < n else 2 * n - 2 - v)
        return a[fold(i, h), fold(j, w)]

    fy, fx = y - y0, x - x0
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def test_aligned_frames_equal_plain_ones(spark, data, frames):
    got = stack_of(catalogue.QUERIES["aligned_frames"](spark, data).toPandas())
    shifts = {r.f: (r.dx, r.dy) for r in catalogue.QUERIES["phase_shifts"](spark, data).collect()}
    for f in sorted(frames)[::25]:
        dx, dy = shifts[f]
        want = [[sampled(frames[f], y + dy, x + dx, "edge") for x in range(8)] for y in range(8)]
        assert np.allclose(got[f], want, atol=1e-6)


def test_bridge_repair_equals_a_plain_form(spark, data, frames):
    got = {(r.f, r.y, r.x): r.repaired for r in catalogue.QUERIES["repair_star_bridge"](spark, data).collect()}
    want = {}
    for f, here in frames.items():
        mask = {(y, x) for y, x in zip(*np.nonzero(here > 160), strict=True)}
        before, after = frames.get(f - 1), frames.get(f + 1)
        if before is not None and after is not None:  # the box of 60 around holds the whole frame
            dx, dy, r = shift_by_all_products(before, after)
            if r >= 0.3:
                p = lambda y, x: sampled(before, y - dy / 2, x - dx / 2, "reflect")
                n = lambda y, x: sampled(after, y + dy / 2, x + dx / 2, "reflect")
                fill = {k: (p(*k) + n(*k)) / 2 for k in mask}
            else:
                fill = {k: (before[k] + after[k]) / 2 for k in mask}
        else:
            side = before if after is None else after
            fill = {k: (here if side is None else side)[k] for k in mask}
        want |= {(f, *k): v for k, v in fill.items()}
    assert set(got) == set(want)
    assert sum(got[k] == int(np.floor(v + 1e-9)) or abs(v - round(v)) < 1e-6 for k, v in want.items()) >= 0.999 * len(want)


def merged_by_all_pairs(pieces, limits):
    """The best-fitting pair again and again, all scores anew each time."""
    items = [set(p) for p in pieces]
    while True:
        best = min(
            ((s, i, j) for j in range(len(items)) for i in range(j) if (s := fit(items[i], items[j], limits)) is not None), default=None
        )
        if best is None:
            return items
        both = items[best[1]] | items[best[2]]
        items = [p for k, p in enumerate(items) if k not in best[1:]] + [both]


def fit(p, q, limits):
    if min(len(p), len(q)) < 3 or len(p & q) < limits["overlap"]:
        return None
    a, b = (geometry.shape(np.array(sorted(x), float)) for x in (p, q))
    return geometry.merge_score(a, b, len(p & q), limits)


def test_merge_equals_all_pairs(spark, data):
    rows = catalogue.overlapping_pieces(spark, data).toPandas()
    got = catalogue.QUERIES["collinear_merge"](spark, data).toPandas()
    merged = 0
    for f, g in rows.groupby("f"):
        pieces = [set(zip(m.x.tolist(), m.y.tolist(), strict=True)) for _, m in g.groupby("mask_id")]
        want = merged_by_all_pairs(pieces, catalogue.SMALL_MERGE)
        own = got[got.f == f]
        assert [set(zip(m.x.tolist(), m.y.tolist(), strict=True)) for _, m in own.groupby("mask_id")] == want
        merged += len(pieces) - len(want)
    assert merged > 50


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
