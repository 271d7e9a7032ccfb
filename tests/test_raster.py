import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels as K
from gridloom.functions import pixels as P
from gridloom.functions import sql as S
from gridloom.functions.timing import log_level, timed
from gridloom.operators import assemble, extract, raster
from gridloom.options import Options
from gridloom.sources import files

FAST = Options(denoise="none")


def page(height, width, *boxes, thickness=3, colour=(0, 0, 0)):
    image = np.full((height, width, 3), 255, np.uint8)
    for b in boxes:
        K.rectangle(image, *b, colour, thickness)
    return image


def near(a, b, tolerance=2):
    return all(abs(x - y) <= tolerance for x, y in zip(a, b))


def test_blank_boundary():
    image = page(100, 100)
    image[5, 5] = 200
    assert K.is_blank(image)
    image[:10, :10] = 0
    assert not K.is_blank(image)


def test_border():
    assert near(raster.table_bounds(page(100, 100, (10, 10, 90, 90))), (8, 8, 92, 92), 2)
    assert near(raster.table_bounds(page(120, 120, (20, 20, 40, 40), (10, 10, 110, 110))), (8, 8, 112, 112), 2)
    with pytest.raises(ValueError, match="No table detected"):
        raster.table_bounds(page(50, 50))


def test_contours_of_known_shapes():
    image = np.zeros((20, 20), np.uint8)
    image[3:10, 4:15] = 255
    image[5:8, 6:12] = 0
    image[15, 15] = 255
    every = sorted((K.bounds(p), K.area(p)) for p in K.contours(image))
    assert every == [((4, 3, 11, 7), 60.0), ((5, 4, 8, 5), 26.0), ((15, 15, 1, 1), 0.0)]
    assert sorted(K.bounds(p) for p in K.contours(image, external=True)) == [(4, 3, 11, 7), (15, 15, 1, 1)]
    inner = np.zeros((20, 20), np.uint8)
    inner[2:18, 2:18] = 255
    inner[4:16, 4:16] = 0
    inner[8:12, 8:12] = 255
    assert [K.bounds(p) for p in K.contours(inner, external=True)] == [(2, 2, 16, 16)]
    assert len(list(K.contours(inner))) == 3


def test_cells_are_found_in_page_coordinates():
    image = page(100, 100, (15, 15, 45, 45), (55, 15, 85, 45), (15, 55, 45, 85), (55, 55, 85, 85))
    found = raster.candidates(image, (10, 10, 90, 90))
    for box in ((15, 15, 45, 45), (55, 15, 85, 45), (15, 55, 45, 85), (55, 55, 85, 85)):
        assert any(near((c["x1"], c["y1"], c["x2"], c["y2"]), box, 3) for c in found)
    assert [c["ord"] for c in found] == list(range(len(found)))


def test_lines_need_long_white_runs():
    grey = np.zeros((300, 300), np.uint8)
    grey[20:140, 20:140] = 255
    grey[160:200, 20:60] = 255
    # A line of even length has no middle, so each opening moves by a pixel or two.
    assert near([b for b in raster.line_candidates(grey)][0], (20, 20, 120, 120))
    assert len(list(raster.line_candidates(grey))) == 1


@pytest.mark.parametrize("size", [11, 15])
def test_adaptive_against_sums(size):
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (20, 25)).astype(np.uint8)
    w, h = K.gaussian(size), size // 2
    wide = np.pad(grey.astype(float), h, mode="edge")
    mean = np.array([[(np.outer(w, w) * wide[y : y + size, x : x + size]).sum() for x in range(25)] for y in range(20)])
    expected = np.where(grey > np.floor(mean + 0.5) - 2, 255, 0)
    assert (K.adaptive(grey, size) == expected).mean() > 0.995


def test_denoise_keeps_flat_and_smooths():
    flat = np.full((30, 30), 77, np.uint8)
    assert (K.denoise(flat) == 77).all()
    noisy = (flat + np.random.default_rng(1).integers(-2, 3, flat.shape)).astype(np.uint8)
    assert K.denoise(noisy).std() < noisy.std()


def test_equalise_spreads():
    ramp = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    assert np.ptp(K.equalise(ramp).astype(int)) > np.ptp(ramp.astype(int))


def test_variants_in_order():
    grey = np.full((50, 50), 128, np.uint8)
    assert [n for n, _ in raster.variants(grey)] == ["original", "otsu", "adaptive"]
    assert [n for n, _ in raster.variants(grey, Options(verbose=True))] == ["original", "otsu", "adaptive", "enhanced", "denoised", "inverted", "sharpened", "dilated"]


@pytest.mark.parametrize("name", ["otsu", "sharpen", "dilate", "open_row", "open_column"])
def test_relational_form_equals_kernel(spark, name):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (9, 12)).astype(np.uint8)
    rows = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(9) for x in range(12)], "img int, x int, y int, v int")
    forms = {
        "otsu": (P.otsu, K.otsu), "sharpen": (P.sharpen, K.sharpen), "dilate": (P.dilate_two, K.dilate_two),
        "open_row": (lambda d: P.opened(d, 4, 2, "row"), lambda g: K.opened(g, 4, 2, "row")),
        "open_column": (lambda d: P.opened(d, 3, 1, "column"), lambda g: K.opened(g, 3, 1, "column")),
    }
    relation, kernel = forms[name]
    found = np.zeros((9, 12), int)
    for r in relation(rows).collect():
        found[r.y, r.x] = r.v
    assert (found == kernel(image)).all()


class Scripted:
    """Reads the mean grey of a crop as a word, with a confidence by configuration."""

    def __init__(self, by_config):
        self.by_config = by_config

    def recognize(self, image, config):
        if self.by_config is None:
            raise RuntimeError("broken")
        return ["CSI", " "], [self.by_config[config.split()[-1]], -1]


@pytest.mark.parametrize("by_config, expected", [({"6": 95, "7": 99}, "CSI"), ({"6": 30, "7": 55}, "CSI"), ({"6": 30, "7": 25}, ""), (None, "")])
def test_read_cell(by_config, expected):
    image = page(60, 120, (20, 10, 100, 50))
    assert raster.read_cell(Scripted(by_config), image, {"x1": 20, "y1": 10, "x2": 100, "y2": 50}) == expected


def test_tiny_crop_is_not_read():
    assert raster.read_cell(Scripted({"6": 95}), page(3, 3), {"x1": 0, "y1": 0, "x2": 3, "y2": 3}) == ""


class FakePdf:
    def page(self, content, number, dpi):
        if b"bad" in content:
            raise ValueError("No pages found in PDF.")
        return page(120, 160, (10, 10, 150, 110), (10, 10, 80, 110))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    (path / "t.png").write_bytes(K.png(page(120, 160, (10, 10, 150, 110), (10, 10, 80, 110))))
    (path / "blank.png").write_bytes(K.png(page(50, 50)))
    (path / "broken.png").write_bytes(b"not an image")
    (path / "a.PDF").write_bytes(b"%PDF good")
    (path / "b.pdf").write_bytes(b"%PDF bad")
    return path


def test_whole_way(spark, folder):
    rasters = files.read(spark, [str(folder), str(folder / "none.png")], FakePdf(), FAST)
    done = extract.extract_tables(rasters, Scripted({"6": 95, "7": 95}), FAST)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in done.collect()}
    assert set(rows) == {"t.png", "blank.png", "broken.png", "a.PDF", "b.pdf", "none.png"}
    assert rows["none.png"].error == f"File not found: {folder}/none.png"
    assert rows["blank.png"].error.endswith("The input image is blank.")
    assert rows["broken.png"].error == files.UNREADABLE
    assert rows["b.pdf"].error == "Error converting PDF to image: No pages found in PDF."
    for name, kind in (("t.png", "image"), ("a.PDF", "pdf")):
        r = rows[name]
        assert r.error is None and r.metadata.file_type == kind
        assert (r.metadata.image_size.width, r.metadata.image_size.height) == (160, 120)
        assert near((r.table.bounds.x1, r.table.bounds.y1, r.table.bounds.x2, r.table.bounds.y2), (9, 9, 152, 112))
        assert r.table.cells and all(c.text == "CS1" for c in r.table.cells)
        assert r.table.dimensions.rows == len(r.table.grid)
    assert rows["t.png"].visualization.output_file == "detected_table_t.png"
    shown = extract.visualise(rasters, done).collect()
    assert {r.output_file for r in shown} == {"detected_table_t.png", "detected_table_a.png"}
    assert all(bytes(r.png).startswith(b"\x89PNG") for r in shown)
    lines = {r.path.rsplit("/", 1)[-1]: r.lines for r in assemble.report(done).collect()}
    assert lines["t.png"][2] == "File: t.png" and len(lines["blank.png"]) == 1
    assert lines["none.png"] == [f"Error: File not found: {folder}/none.png"]
    assert lines["b.pdf"][0].startswith("Error: Error converting PDF") and lines["b.pdf"][1:] == list(assemble.PDF_HINTS)
    assert not any(r.failed for r in assemble.report(done).collect())


def odd_reader(recognizer, image, cell, options):
    if cell["id"] % 2:
        raise ValueError("unreadable")
    return "x"


def test_cells_whose_reader_raises_are_left_out(spark):
    image = page(40, 40)
    rasters = spark.createDataFrame([("p", 40, 40, 3, image.tobytes(), None), ("q", 40, 40, 3, image.tobytes(), None)], files.RASTER)
    cells = spark.createDataFrame([("p", k, 0, 0, 10, 10) for k in range(4)] + [("q", 1, 0, 0, 10, 10)], "path string, id int, x1 int, y1 int, x2 int, y2 int")
    read = extract.recognise(rasters, cells, Scripted({}), FAST, odd_reader)
    assert sorted((r.path, r.id, r.text) for r in read.collect()) == [("p", 0, "x"), ("p", 2, "x")]


def test_debug_runs(tmp_path, monkeypatch):
    import logging

    from gridloom import cli

    monkeypatch.chdir(tmp_path)
    assert cli.options_for(True).log_batch == 1 and cli.options_for(True).verbose and cli.options_for(False) == Options()
    root = logging.getLogger()
    before, level = root.handlers[:], root.level
    root.handlers[:] = []
    try:
        cli.log_to("INFO", True)
        logging.getLogger("x").info("told")
        (found,) = (tmp_path / "logs").iterdir()
        assert found.name.startswith("table_detector_") and "INFO" in found.read_text()
    finally:
        for h in root.handlers:
            h.close()
        root.handlers[:] = before
        root.setLevel(level)


def test_debug_steps(spark, folder):
    steps = extract.debug_steps(files.read(spark, [str(folder / "t.png")], options=FAST), FAST)
    assert {r.step[:2] for r in steps.collect()} == {"01", "02", "03", "04", "06"}


def test_failfast(spark, folder):
    with pytest.raises(ValueError, match="File not found"):
        files.read(spark, [str(folder / "none.png")], options=Options(mode="FAILFAST"))
    strict = Options(mode="FAILFAST", denoise="none")
    with pytest.raises(Exception, match="blank"):
        extract.extract_tables(files.read(spark, [str(folder / "blank.png")], options=strict), Scripted({}), strict).collect()


class Counting(Scripted):
    """Writes a line per image read."""

    def __init__(self, log):
        super().__init__({"6": 95, "7": 95})
        self.log = log

    def recognize(self, image, config):
        with open(self.log, "a") as out:
            out.write(f"{image.shape}\n")
        return super().recognize(image, config)


def test_pages_are_searched_and_cells_read_once(spark, folder, tmp_path):
    log = str(tmp_path / "reads")
    done = extract.extract_tables(files.read(spark, [str(folder / "t.png")]), Counting(log), FAST)
    plan = done._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan  # what is costly lies in stored tables
    cells = done.first().table.cells
    done.collect()
    assert len(open(log).readlines()) == len(cells) > 0


def test_denoise_in_strips():
    rng = np.random.default_rng(2)
    page = rng.integers(0, 256, (90, 40)).astype(np.uint8)
    whole = K.denoise(page)
    before, K.STRIP = K.STRIP, 17
    try:
        assert (K.denoise(page) == whole).all()
    finally:
        K.STRIP = before


def test_table_functions(spark):
    S.register(spark)
    image = np.zeros((20, 20), np.uint8)
    image[3:10, 4:15] = 255
    rows = spark.createDataFrame([(20, 20, image.tobytes())], "h int, w int, d binary")
    rows.createOrReplaceTempView("masks")
    found = spark.sql("SELECT c.* FROM masks, LATERAL contours(h, w, d, true) c").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in found] == [(4, 3, 15, 10)]
    assert spark.sql("SELECT method FROM masks, LATERAL cell_variants(h, w, d)").count() == 3
    assert spark.sql("SELECT method FROM masks, LATERAL cell_candidates(h, w, d)").where(F.col("method") == "contours").count() > 0


def test_timing(caplog):
    import logging

    caplog.set_level(logging.INFO)
    timed("quick")(lambda: 1)()
    with pytest.raises(ValueError):
        timed("slow", threshold=-1)(lambda: (_ for _ in ()).throw(ValueError()).__next__())()
    assert [r.message.startswith("slow took") for r in caplog.records] == [True]
    before = logging.getLogger("x").level
    with log_level("x", logging.ERROR) as logger:
        assert logger.level == logging.ERROR
    assert logging.getLogger("x").level == before
