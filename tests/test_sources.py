import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors as V
from sightline.operators import mapping as M
from sightline.sources import image_lists as S
from sightline.sources import images, matrices, outputs


def test_scan(spark, tmp_path):
    for name in ("train/image1.jpg", "train/image2.jpg", "val/image2.jpg", "train/sub/a.JPEG", "train/b.PNG", "train/skip.Jpg", "train/skip.gif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    rows = S.scan_items(spark, str(tmp_path / "train"), str(tmp_path / "val")).collect()
    assert sorted((r.path.removeprefix(str(tmp_path)), r.is_val) for r in rows) == [("/train/b.PNG", False), ("/train/image1.jpg", False), ("/train/image2.jpg", False), ("/train/sub/a.JPEG", False), ("/val/image2.jpg", True)]
    assert len({r.identifier for r in rows}) == 5


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_scans_are_listed_by_tasks(spark, tmp_path, depth):
    """The same files whether the driver hands out the folder itself, its folders or theirs."""
    names = [f"{a}/{b}/i{k}.jpg" for a in "xyz" for b in ("p", "q r", "ü") for k in range(3)] + ["top.png", "x/one.JPG", "x/p/no.gif", "z/deep/er/still/a.jpeg"]
    for name in names:
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(b"12")
    (tmp_path / "d/empty/none").mkdir(parents=True)
    for path in (str(tmp_path / "d"), f"file:{tmp_path}/d/"):
        got = S.listed_files(spark, path, depth)
        assert sorted(r.path for r in got.collect()) == sorted(f"{tmp_path}/d/{n}" for n in names) and {r["size"] for r in got.collect()} == {2}
        assert len(S.FolderReader({"path": path, "depth": str(depth)}).partitions()) == {0: 1, 1: 5, 2: 16}[depth]
    assert S.scan_items(spark, str(tmp_path / "d")).count() == len(names) - 1
    with pytest.raises(Exception, match="nowhere"):
        S.listed_files(spark, str(tmp_path / "nowhere")).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "image_list").write_text("train id-0 /a/b c.jpg\nval id-1 /d.jpg\n")
    assert [tuple(r) for r in S.read_image_list(spark, str(tmp_path / "image_list")).orderBy("row_idx").collect()] == [(0, "train", "id-0", "/a/b c.jpg"), (1, "val", "id-1", "/d.jpg")]
    (tmp_path / "paths.txt").write_text(" one\ntwo \n\nthree\n")
    assert [r.line for r in S.read_file_list(spark, str(tmp_path / "paths.txt")).orderBy("row_idx").collect()] == ["one", "two"]
    items = spark.createDataFrame([("id-0", "/a b.jpg", False)], "identifier string, path string, is_val boolean")
    S.write_image_list(items, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["train id-0 /a b.jpg"]


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_large_lists_are_numbered_alike(spark, tmp_path, step):
    lines = [f"train id-{i} /p {'x' * (i % 9)}" for i in range(60)]
    (tmp_path / "list").write_text("\n".join(lines) + "\n")
    reader = S.LineReader({"path": str(tmp_path / "list"), "step": step})
    read = [row for part in reader.partitions() for row in reader.read(part)]
    assert [x for _, x in sorted(read)] == lines
    if step == 64:
        whole, ranges = (sorted(tuple(r) for r in S.read_image_list(spark, str(tmp_path / "list"), large).collect()) for large in (False, True))
        assert whole == ranges and len(whole) == 60


def test_lists_of_parts(spark, tmp_path):
    """Parts follow each other by name, whether or not they end with a line break; empty parts and other files don't count."""
    (tmp_path / "list").mkdir()
    for name, text in {"part-0": "a\nb", "part-1": "", "part-2": " c \n \t\u2003\n", "part-3": "d\n", "_SUCCESS": "x\n", ".part-0.crc": "y\n"}.items():
        (tmp_path / "list" / name).write_text(text)
    for step in (1, 3, 100):
        reader = S.LineReader({"path": f"file:{tmp_path}/list", "step": step})
        assert [x for _, x in sorted(row for part in reader.partitions() for row in reader.read(part))] == ["a", "b", " c ", " \t\u2003", "d"]
    assert [tuple(r) for r in S.numbered_lines(spark, str(tmp_path / "list"), True).orderBy("row_idx").collect()] == list(enumerate(["a", "b", " c ", " \t\u2003", "d"]))
    assert [tuple(r) for r in S.read_file_list(spark, str(tmp_path / "list"), True).orderBy("row_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "empty").mkdir()
    assert S.read_file_list(spark, str(tmp_path / "empty"), True).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        S.numbered_lines(spark, str(tmp_path / "nowhere"), True).collect()


def test_matrix_and_scores(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "embeddings.bin").write_bytes(x.tobytes())
    rows = matrices.read_embedding_matrix(spark, str(tmp_path / "embeddings.bin"), 3).orderBy("row_idx").collect()
    assert [list(r.embedding) for r in rows] == x.tolist()
    with pytest.raises(ValueError):
        matrices.read_embedding_matrix(spark, str(tmp_path / "embeddings.bin"), 5)
    np.save(tmp_path / "scores.npy", np.array([0.1, 0.2, 0.3], np.float32))
    assert [round(r.score, 6) for r in matrices.read_scores(spark, str(tmp_path / "scores.npy")).orderBy("row_idx").collect()] == [0.1, 0.2, 0.3]


def test_files_are_written_as_they_are_read(spark, tmp_path):
    x = np.random.default_rng(1).random((500, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "row_idx long, embedding array<float>, score double").repartition(4)
    matrices.write_embedding_matrix(rows, str(tmp_path / "e.bin"), 3)
    assert (np.fromfile(tmp_path / "e.bin", "<f4").reshape(500, 3) == x).all()
    matrices.write_scores(rows, str(tmp_path / "s.npy"), 500)
    assert (np.load(tmp_path / "s.npy") == x[:, 0]).all()
    matrices.write_scores(rows.limit(0), str(tmp_path / "none.npy"), 0)
    assert np.load(tmp_path / "none.npy").shape == (0,) and matrices.read_scores(spark, str(tmp_path / "none.npy")).count() == 0


def test_matrices_in_parts(spark, tmp_path, monkeypatch):
    """A folder by URI: written by runs of rows, committed by a list, read by ranges."""
    x = np.random.default_rng(2).random((900, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "row_idx long, embedding array<float>, score double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several tasks, although there are few rows
    for path in (tmp_path.as_uri(), f"file:{tmp_path}", str(tmp_path)):
        e, s = f"{path}/e-{len(path)}", f"{path}/s-{len(path)}"
        matrices.write_embedding_matrix(rows, e, 3, parts=True)
        got = matrices.read_embedding_matrix(spark, e, 900)
        assert [list(r.embedding) for r in got.orderBy("row_idx").collect()] == x.tolist()
        matrices.write_scores(rows, s, 900, parts=True)
        assert [r.score for r in matrices.read_scores(spark, s).orderBy("row_idx").collect()] == x[:, 0].tolist()
    spark.conf.unset("spark.sql.adaptive.enabled")
    files = [p for p, *_ in matrices.part_files(s)]
    assert len(files) > 1 and np.load(__import__("io").BytesIO(b"".join(open(f, "rb").read() for f in files))).tolist() == x[:, 0].tolist()
    open(f"{e}/rows-{0:015d}-{'0' * 32}.bin", "wb").write(b"left by a task that was lost")
    assert matrices.read_embedding_matrix(spark, e, 900).count() == 900
    matrices.write_scores(rows.limit(0), str(tmp_path / "none"), 0, parts=True)
    assert matrices.read_scores(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="without gaps"):
        matrices.write_scores(rows.where("row_idx <> 5"), str(tmp_path / "gap"), 899, parts=True)


def test_a_range_of_rows_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    x = np.arange(4000, dtype=np.float32).reshape(1000, 4)
    (tmp_path / "e.bin").write_bytes(x.tobytes())
    reader = matrices.MatrixReader({"path": str(tmp_path / "e.bin"), "dim": "4", "low": "20", "high": "300"})
    seen = []
    monkeypatch.setattr(matrices, "read_range", lambda path, start, n: (seen.append((start, n)), open(path, "rb").read()[start : start + n])[1])
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.column("row_idx").to_pylist()]
    assert got == list(range(20, 300)) and seen == [(20 * 16, 280 * 16)]
    monkeypatch.undo()
    read = lambda **k: matrices.read_embedding_matrix(spark, f"file:{tmp_path}/e.bin", 1000, **k)
    assert [list(r.embedding) for r in read(low=7, high=9).orderBy("row_idx").collect()] == x[7:9].tolist()
    assert [read(**k).count() for k in ({}, {"low": 990}, {"high": 3}, {"low": 5000}, {"low": 5, "high": 5}, {"high": 9999})] == [1000, 10, 3, 0, 0, 1000]
    df = read()
    assert df.where("row_idx = 3").count() == 1 and df.where("row_idx > 998 or row_idx < 2").count() == 3  # one frame, several queries
    np.save(tmp_path / "s.npy", x[:, 0])
    assert [r.score for r in matrices.read_scores(spark, str(tmp_path / "s.npy"), 5, 8).orderBy("row_idx").collect()] == x[5:8, 0].tolist()


def test_codec(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, None)], "id long, v array<float>").withColumn("t", V.vectors_to_base64(F.col("v")))
    assert [(r.id, r.back) for r in rows.withColumn("back", V.vectors_from_base64(F.col("t"))).orderBy("id").collect()] == [(1, [1.5, -2.0]), (2, None)]


def test_outputs(spark):
    items = spark.createDataFrame([(1, "p", "a"), (2, "q", "b")], "item_id long, path string, identifier string")
    paths = outputs.paths_in_order(spark.createDataFrame([(["q", "p"],)], "paths array<string>"))
    assert [(r.row_idx, r.item_id) for r in outputs.add_model_output(items, "m", paths, scores="s").orderBy("row_idx").collect()] == [(0, 2), (1, 1)]
    with pytest.raises(ValueError):
        outputs.add_model_output(items, "m", paths)
    with pytest.raises(Exception, match="no item has"):
        outputs.add_model_output(items, "m", spark.createDataFrame([(0, "nope")], "row_idx long, path string"), scores="s").collect()
    held = spark.createDataFrame([("d", "x", "p")], "dataset string, name string, scores_path string")
    jobs = spark.createDataFrame([("d", "x", "q", True, False), ("d", "y", "r", True, False), ("d", "z", "s", True, True)], "dataset string, name string, scores_path string, finished boolean, failed boolean")
    assert sorted((r.name, r.scores_path) for r in outputs.insert_if_absent(held, jobs).collect()) == [("x", "p"), ("y", "r")]


def test_images_are_decoded_cropped_and_pooled(spark, tmp_path):
    r = np.random.default_rng(5)
    made = {"grey.png": r.integers(0, 256, (5, 7, 1)), "sub/colour.png": r.integers(0, 256, (6, 4, 3))}
    rows = spark.createDataFrame([(k, *v.shape[:2], v.ravel().tolist()) for k, v in made.items()], "path string, height int, width int, values array<int>")
    images.write_images(rows, f"{tmp_path}/i")
    (tmp_path / "i/broken.png").write_bytes(b"no image")
    found = images.read_images(spark, f"{tmp_path}/i")
    got = {x.path.rpartition("/i/")[2]: x.image and images.pixels(x.image.asDict()) for x in found.collect()}
    assert set(got) == {*made, "broken.png"} and got["broken.png"] is None and all((got[k] == v).all() for k, v in made.items())
    crops = found.withColumn("crop", F.when(F.col("path").contains("grey"), F.struct(F.lit(0.2).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.5).alias("x2"), F.lit(0.41).alias("y2"))))
    embedder = M.CroppedImages(images.pixels, lambda x: x, 1)
    out = {x.item_id.rpartition("/")[2]: x.embedding for x in M.embed_images(crops, embedder, "path", crop_col="crop", batch=1).collect()}
    assert out["broken.png"] is None and np.allclose(out["grey.png"], made["grey.png"][:2, 1:3].mean()) and np.allclose(out["colour.png"], made["sub/colour.png"].mean(axis=(0, 1)))
    assert M.embed_images(found.limit(0), embedder, "path").count() == 0
