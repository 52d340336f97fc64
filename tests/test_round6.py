"""Findings of round 3, fourth session."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from workgraph.llm import images
from workgraph.sources import readers


def test_files_on_one_line_are_read_once(spark, tmp_path, monkeypatch):
    """Their brackets are not counted, no names go through the driver, and a text is parsed once."""
    folder = tmp_path / "odd name %41"
    folder.mkdir()
    item = lambda i: {"id": i, "kind": "f", "status": "S", "meta": "] } {"}
    texts = [json.dumps([item("a"), item("b")]), "\n" + json.dumps({"workItems": [item("c")]}) + "\n\n", "{broken", "[]", "   "]
    for k, text in enumerate(texts):
        (folder / f"{k}.json").write_text(text, encoding="utf-8")
    with monkeypatch.context() as m:
        m.setattr(readers, "numbered_lines", None)
        m.setattr(DataFrame, "toLocalIterator", None)
        out = readers.read_registry(spark, str(folder))
        assert sorted(r.id for r in out.collect()) == ["a", "b", "c"]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object") <= 1 and "Filter (size(" not in plan
    # among files of many lines, split or not, too
    (folder / "6.json").write_text(json.dumps([item("d"), item("e")], indent=1), encoding="utf-8")
    (folder / "7.json").write_text(f'[{json.dumps(item("f"))},\r\n\n{json.dumps(item("g"))}]', encoding="utf-8")
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    assert sorted(r.id for r in readers.read_registry(spark, str(folder)).collect()) == list("abcdefg")
    for name, want in (("6", 2), ("7", 1), ("0", 1)):
        assert readers.json_entries(spark, str(folder / f"{name}.json")).count() == want


def test_a_null_item_still_raises(spark, tmp_path):
    (tmp_path / "n.json").write_text("[null]", encoding="utf-8")
    try:
        readers.read_registry(spark, str(tmp_path / "n.json")).collect()
    except Exception as e:  # noqa: BLE001
        assert "lacks id" in str(e)
    else:
        raise AssertionError("a null item was dropped")


def test_image_rows_are_made_for_shared_keys_only(spark, monkeypatch):
    """Query images' keys that no other class has are not shuffled, and no shared key is lost; equal images are one class."""
    rng = np.random.default_rng(2)
    drawn = [images.draw(rng.normal(size=64)) for _ in range(12)]
    rows = [(20 * k, m) for k, m in enumerate(drawn)] + [(1, drawn[0][10:90, 6:86]), (7, drawn[1]), (45, drawn[1]), (45, drawn[1]), (46, drawn[2][10:90, 6:86])]
    media = spark.createDataFrame([(i, np.ascontiguousarray(m).tobytes(), m.shape[1]) for i, m in rows], "image_id long, pixels binary, width int")
    members, reps = images._classes(media, 20, "image_id", "pixels", "width")
    assert sorted(tuple(r) for r in members.collect()) == sorted([(20 * k, 20 * k) for k in range(12) if k != 1] + [(20, 7), (1, 1), (7, 7), (45, 7), (46, 46)])
    reps = reps.collect()
    corners = [(r.class_id, r.asks, np.frombuffer(r.corners, images.CORNER)) for r in reps]
    assert sorted((i, asks) for i, asks, _ in corners) == sorted([(20 * k, True) for k in range(12) if k != 1] + [(7, True), (1, False), (46, False)])
    held: dict[int, set[int]] = {}
    for at, (_, _, c) in enumerate(corners):
        for key in images.table_keys(c).ravel().tolist():
            held.setdefault(key, set()).add(at)
    shared = {k for k, at in held.items() if len(at) > 1 and any(corners[i][1] for i in at)}
    made = []
    index = images._index
    monkeypatch.setattr(images, "_index", lambda tables, filters: made.append((tables, len(filters))) or index(tables, filters))
    d = spark.createDataFrame(reps)
    wanted = images._shared(spark.sparkContext, 1, images.key_filter(d.filter("asks"), slice(0, 24), [], 1, twice=True))
    answered = images._shared(spark.sparkContext, 2, images.key_filter(d, slice(0, 24), [wanted], 2))
    for side, f in ((d, wanted), (d.filter("asks"), answered)):
        keys = [r.key for r in side.mapInArrow(index(slice(0, 24), [f]), "key long, class_id long, spot long").collect()]
        assert shared <= set(keys) and len(set(keys) - shared) < 0.01 * len(held)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = {(r.image_id, r.class_id) for r in images.find_copies(media).filter("kind = 'match'").collect()}
    assert (0, 1) in found and [n for _, n in made] == [1, 1] * (images.TABLES // images.AT_ONCE)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
