import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators.raster import fourier, image, point, regions, stencil
from gridloom.plans import raster as plans
from gridloom.sources import netpbm


def stack(*rows):
    return np.array([rows], np.int64)


images = st.integers(2, 9).flatmap(lambda w: st.integers(2, 9).flatmap(lambda h: st.lists(st.integers(0, 255), min_size=w * h, max_size=w * h).map(lambda v: np.array(v, np.int64).reshape(1, h, w))))


def test_borders():
    assert image.border_index(4, 2, "mirror").tolist() == [2, 1, 0, 1, 2, 3, 2, 1]
    assert image.border_index(4, 2, "clamp").tolist() == [0, 0, 0, 1, 2, 3, 3, 3]
    assert image.border_index(1, 2, "mirror").tolist() == [0, 0, 0, 0, 0]


def test_stored_levels():
    assert image.store(np.array([-0.7, 0.49, 0.5, 254.5, 300.0])).tolist() == [0, 0, 1, 255, 255]


def test_gradients_on_a_ramp():
    a = stack([0, 10, 20], [0, 10, 20], [0, 10, 20])
    assert stencil.gradient_x("d")(a)[0, 0].tolist() == [138, 138, 118]
    assert stencil.gradient_x("sobel")(a)[0, 1].tolist() == [128, 208, 128]
    assert stencil.norm_l2("prewitt")(a)[0, 1].tolist() == [0, 60, 0]
    assert (stencil.gradient_y("sobel")(a) == 128).all()


def test_even_kernels_give_null(spark):
    df = spark.createDataFrame([(1, 2, 2, [1, 2, 3, 4]), (2, 2, 2, None)], "image_id long, w int, h int, v array<smallint>")
    assert [r.v for r in image.run(df, stencil.mean(4)).collect()] == [None, None]
    assert {r.image_id: r.v for r in image.run(df, stencil.minimum(3)).collect()} == {1: [1, 1, 1, 1], 2: None}


def test_images_of_many_sizes(spark):
    df = spark.createDataFrame([(1, 2, 1, [1, 2]), (2, 1, 2, [3, 4]), (3, 3, 1, [5, 6, 7])], "image_id long, w int, h int, v array<smallint>")
    out = {r.image_id: (r.w, r.h, r.v) for r in image.run(df, point.zoom_nearest(2, 1)).collect()}
    assert out[1][:2] == (4, 1) and out[2] == (2, 2, [3, 3, 4, 4]) and out[3][:2] == (6, 1)


def test_point_operators(spark):
    df = spark.createDataFrame([([0, 50, 51, 200, 255], [255, 255, 1, 60, 2])], "a array<smallint>, b array<smallint>")
    get = lambda c: df.select(c.alias("x")).first().x
    a, b = F.col("a"), F.col("b")
    assert get(point.saturate(a, 50, 200)) == [0, 0, 2, 255, 255]
    assert get(point.invert(a)) == [255, 205, 204, 55, 0]
    assert get(point.gamma(a, 2.0))[1] > 50 and get(point.gamma(a, -1.0)) == [0, 50, 51, 200, 255]
    assert get(point.stretch(F.array(F.lit(7), F.lit(7)))) == [0, 0]
    assert get(point.add(a, b)) == [255, 255, 52, 255, 255] and get(point.subtract(a, b)) == [0, 0, 50, 140, 253]
    assert get(point.multiply(a, b)) == [0, 50, 0, 47, 2]
    assert get(point.blend(a, F.slice("b", 1, 2), 0.5)) is None
    assert get(point.contrast_range(F.array(F.lit(0), F.lit(0)))) == 0.0


@given(images)
@settings(max_examples=60, deadline=None)
def test_morphology_orders(a):
    assert (stencil.grey_erode(3)(a) <= a).all() and (a <= stencil.grey_dilate(3)(a)).all()
    b = regions.threshold(128)(a)
    opened = stencil.binary_open(3)(b)
    assert (stencil.binary_open(3)(opened) == opened).all() and (opened <= b).all()
    assert (stencil.binary_dilate(3)(b) >= b).all() and (stencil.binary_erode(3)(b) <= b).all()


@given(images)
@settings(max_examples=60, deadline=None)
def test_fourier_round_trip(a):
    assert fourier.round_trip_error(a[0]) < 1e-9


def test_texture_peaks():
    y, x = np.mgrid[0:64, 0:64]
    a = (128 + 60 * np.sin(2 * np.pi * 8 * x / 64) + 60 * np.sin(2 * np.pi * 5 * y / 64))[None]
    m = np.abs(fourier.spectrum(a))[0]
    m[32, 32] = 0
    assert {tuple(p) for p in np.argwhere(m > 0.5 * m.max())} == {(32, 24), (32, 40), (27, 32), (37, 32)}


@given(images)
@settings(max_examples=60, deadline=None)
def test_distances_and_components(a):
    b = regions.threshold(128)(a)
    h, w = b.shape[1:]
    ground = np.argwhere(b[0] == 0)
    for f, metric in ((regions.distance_d4, lambda d: np.abs(d).sum(axis=1)), (regions.distance_d8, lambda d: np.abs(d).max(axis=1))):
        d = f(b)[0]
        for y in range(h):
            for x in range(w):
                assert d[y, x] == (metric(ground - (y, x)).min() if len(ground) else regions.FAR)
    own4, n4 = regions.component_numbers(b, 4)
    own8, n8 = regions.component_numbers(b, 8)
    assert n4[0] >= n8[0] and own4.max() == n4[0]
    for own, steps in ((own4, regions.FOUR), (own8, regions.STEPS)):
        for y in range(h):
            for x in range(w):
                for dx, dy in steps:
                    if 0 <= x + dx < w and 0 <= y + dy < h and own[0, y, x] and own[0, y + dy, x + dx]:
                        assert own[0, y, x] == own[0, y + dy, x + dx]


def test_distance_without_background_is_white():
    assert (regions.distance_map(regions.distance_d4)(stack([255, 255], [255, 255])) == 255).all()


def test_chain_codes():
    assert regions.chain_code(np.zeros((2, 2), int)) == (-1, -1, [], -1)
    assert regions.chain_code(np.array([[0, 0], [0, 255]])) == (1, 1, [], 0)
    x, y, code, n = regions.chain_code(np.full((2, 2), 255))
    assert (x, y, n) == (0, 0, len(code)) and code[0] == 0


def test_otsu_takes_the_first_best_level_and_includes_it():
    assert regions.otsu_levels(stack([0, 0, 10, 10])).tolist() == [0]
    assert regions.otsu(stack([0, 0, 10, 10])).tolist() == [[[255, 255, 255, 255]]]
    assert regions.otsu_levels(stack([7, 7])).tolist() == [0]


def test_growing_keeps_refused_pixels_out_of_one_region_but_not_of_another():
    a = stack([10, 10, 200, 200], [10, 10, 200, 200])
    assert regions.grow(0, 0, 5)(a).tolist() == [[[255, 255, 0, 0], [255, 255, 0, 0]]]
    assert regions.grow(99, 0, 5)(a)[0, 0].tolist() == [0, 0, 255, 255]
    assert set(np.unique(regions.grow_many(2, 1, 5)(a))) <= {0, 255}


def test_quadtree_of_odd_sizes():
    a = np.arange(35).reshape(5, 7)
    leaves = regions.quadtree(a, 0)
    assert sum(w * h for _, _, w, h in leaves) == 35
    assert (regions.split(1000)(a[None]) == 17).all()


def test_k_means_of_two_levels():
    assert sorted(set(regions.k_means(2, 50)(stack([1, 2, 250, 251])).ravel())) == [1, 250]


def test_hysteresis_never_promotes_the_border():
    a = stack([50, 90, 50], [50, 50, 50], [0, 0, 0])
    assert regions.hysteresis(30, 80)(a)[0].tolist() == [[0, 255, 0], [0, 255, 0], [0, 0, 0]]


def test_netpbm(tmp_path, spark):
    grey = netpbm.encode(2, 1, [[5, 6]])
    assert netpbm.decode(b"P5 # note\n# more\n2 1\n255\n" + bytes([5, 6]))[4].tolist() == [[5, 6]]
    assert netpbm.detect(grey) == "pgm" and netpbm.detect(b"GIF") is None
    for bad in (b"P5\n2 1\n255\n\x05", b"P6", b""):
        with pytest.raises(ValueError):
            netpbm.decode(bad)
    files = spark.createDataFrame([("a", grey), ("b", netpbm.encode(1, 1, [[255], [0], [0]])), ("c", b"GIF")], "path string, content binary")
    assert {r.path: r.v for r in netpbm.images(files).collect()} == {"a": [5, 6], "b": [76]}
    assert {r.path: (r.r, r.b) for r in netpbm.images(files, "colour").collect()} == {"a": ([5, 6], [5, 6]), "b": ([255], [0])}
    (tmp_path / "x.pgm").write_bytes(grey)
    spark.dataSource.register(netpbm.Netpbm)
    assert [r.v for r in spark.read.format("netpbm").load(str(tmp_path)).collect()] == [[5, 6]]


def test_large_results_leave_in_small_batches(spark):
    """A plot of 51,200 levels an image: no stack of results, and no Arrow batch, has more than about LEVELS levels."""
    seen = []
    pieces = list(image.in_pieces(lambda a: seen.append(len(a)) or plans.histogram_plot(a), np.arange(200 * 4).reshape(200, 2, 2) % 256))
    assert [p[:2] for p in pieces] == [(0, 1), (1, 41), (41, 81), (81, 121), (121, 161), (161, 200)] and max(seen) * 51200 <= image.LEVELS
    rows = spark.range(90).selectExpr("id AS image_id", "2 AS w", "1 AS h", "IF(id % 10 = 3, NULL, ARRAY(CAST(id AS SMALLINT), 7S)) AS v").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    sizes = image.run(rows, plans.histogram_plot).mapInPandas(lambda bs: (b.groupby("w", as_index=False).agg(n=("h", "size")) for b in bs), "w int, n int")
    assert sum(r.n for r in sizes.collect()) == 90
    found = {r.image_id: (r.w, r.h, r.v) for r in image.run(rows, plans.histogram_plot).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[13] == (2, 1, None)
    for i in (0, 44, 89):
        assert found[i] == (256, 200, plans.histogram_plot(np.array([[[i, 7]]]))[0].ravel().tolist())


def test_summary_of_a_group_in_the_tasks(spark):
    images = image.from_embeddings(spark, "/root/testdata/sf0.001")
    for group in ("grp_c02", "grp_c03"):
        assert sorted(map(tuple, plans.course_summary(images, group).collect())) == sorted(map(tuple, plans.summary(plans.run_course(images, group)).collect()))
