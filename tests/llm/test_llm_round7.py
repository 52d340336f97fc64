"""Corners that share a key by chance."""

import numpy as np

from workgraph.llm import images


def test_corners_far_apart_that_share_a_key_make_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (30, 40, 128), dtype=np.uint8)  # of each corner of each class
    bits[:, :, images._KEYS[0]] = 1  # all share the key of the first table
    bits[1] = bits[0]  # a copy
    np.put_along_axis(bits[1], rng.permuted(np.tile(np.arange(128), (40, 1)), axis=1)[:, :2], 0, 1)
    place = rng.integers(0, 96, (40, 2))
    rows = []
    for i, b in enumerate(bits):
        c = np.zeros(40, images.CORNER)
        words = np.packbits(b, axis=1).view(">i8")
        c["hi"], c["lo"], c["x"], c["y"] = words[:, 0], words[:, 1], *(place if i < 2 else rng.integers(0, 96, (40, 2))).T
        rows.append((i * 4, i % 5 == 0, c.tobytes()))
    reps = spark.createDataFrame(rows, "class_id long, asks boolean, corners binary")
    made, paired = [], images._paired
    monkeypatch.setattr(images, "_classes", lambda *_: (reps.selectExpr("class_id image_id", "class_id"), reps))
    monkeypatch.setattr(images, "_paired", lambda met: made.append(met.count()) or paired(met))
    out = images.find_copies(spark.createDataFrame([(1, b"a", 1)], "image_id long, pixels binary, width int"))
    assert 40 < sum(made) <= 40 * images.TABLES  # each corner and its copy in each table at most; 276,450 pairs share a key
    assert [(r.image_id, r.class_id, r.agreeing) for r in out.filter("kind = 'match'").collect()] == [(0, 4, 40)]


def test_descriptors_that_differ_in_their_first_bit_are_near():
    a, b = np.zeros(2, images.CORNER), np.zeros(2, images.CORNER)
    b["hi"][0], b["lo"][1] = np.iinfo(np.int64).min | 3, -1
    assert images._apart(a, b).tolist() == [3, 64]
    assert images.near_corners(a, b, 3).tolist() == [[0, 0], [1, 0]]
    assert images.consensus(a, b, np.array([[0, 0]]), 3) == 1
