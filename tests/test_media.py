import csv
import struct
import zlib

import numpy as np
import pytest

from kinfold import cli
from kinfold.functions import pixels
from kinfold.operators import embed, linkage, pairs, storage
from kinfold.operators.embed import PrecomputedEmbedder
from kinfold.options import GroupingError, GroupingOptions, ModelError, UsageError, WriteError
from kinfold.plans import grouping
from kinfold.sources import decode, discover, sink


def png(values, colour, depth=8, palette=None, clear=None, laced=0, kind=0):
    h, w = values.shape[:2]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    flat = values.reshape(h, -1)
    if depth == 16:
        flat = flat.astype(">u2").view(np.uint8).reshape(h, -1)
    elif depth < 8:
        bits = np.unpackbits(flat.astype(np.uint8)[..., None], axis=-1)[..., -depth:].reshape(h, -1)
        flat = np.packbits(bits, axis=1)
    raw = b"".join(bytes([kind]) + filtered(flat, y, kind, max(1, depth * (values.shape[2] if values.ndim > 2 else 1) // 8)) for y in range(h))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))
    out += chunk(b"PLTE", palette) if palette else b""
    out += chunk(b"tRNS", clear) if clear else b""
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(flat, y, kind, step):
    line = flat[y].astype(int)
    up = flat[y - 1].astype(int) if y else np.zeros_like(line)
    left = np.concatenate([np.zeros(step, int), line[:-step]])
    corner = np.concatenate([np.zeros(step, int), up[:-step]])
    guess = left + up - corner
    near = np.abs(np.stack([left, up, corner]) - guess)
    paeth = np.stack([left, up, corner])[near.argmin(0), np.arange(len(line))]
    return bytes(((line - [0 * line, left, up, (left + up) // 2, paeth][kind]) & 255).astype(np.uint8))


RGB = np.random.default_rng(0).integers(0, 256, (7, 5, 3), dtype=np.uint8)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    assert (decode.decode(png(RGB, 2, kind=kind)) == RGB).all()


def test_png_kinds():
    gray = RGB[..., :1]
    assert (decode.decode(png(gray, 0)) == np.repeat(gray, 3, -1)).all()
    assert (decode.decode(png(gray.astype(np.uint16) << 8, 0, 16)) == np.repeat(gray, 3, -1)).all()
    bits = (gray & 1) * np.uint8(1)
    assert (decode.decode(png(bits, 0, 1)) == np.repeat(bits * 255, 3, -1)).all()
    palette = bytes(range(48))
    index = gray % 16
    assert (decode.decode(png(index, 3, 4, palette=palette))[..., 0] == index[..., 0] * 3).all()
    assert (decode.decode(png(index, 3, 4, palette=palette, clear=b"\0"))[index[..., 0] == 0] == 255).all()
    half = np.array([[[10, 20, 30, 128]]], dtype=np.uint8)
    assert decode.decode(png(half, 6)).tolist() == [[[132, 137, 142]]]
    assert (decode.decode(decode.png_bytes(RGB)) == RGB).all()


def test_bmp_and_orientation():
    body = b"".join(RGB[y, :, ::-1].tobytes() + b"\0" for y in range(6, -1, -1))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 7, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (decode.decode(head + body) == RGB).all()
    tag = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    assert decode.exif_orientation(tag) == 6
    assert decode.upright(RGB, 6).shape == (5, 7, 3) and (decode.upright(decode.upright(RGB, 6), 8) == RGB).all()
    assert (decode.upright(RGB, 5) == RGB.swapaxes(0, 1)).all()
    for bad in (b"", png(RGB, 2)[:40], b"GIF89a"):
        with pytest.raises(ValueError):
            decode.decode(bad)


def test_kernels():
    falling = np.repeat(np.repeat(np.arange(180, 0, -20, dtype=np.uint8)[None, :, None], 8, 0), 3, -1)
    assert pixels.dhash(falling) == 2**64 - 1 and pixels.dhash(np.full((9, 9, 3), 7, np.uint8)) == 0
    assert (pixels.resize(RGB, 5, 7) == RGB).all()
    assert pixels.thumbnail(np.zeros((10, 20, 3), np.uint8))[[0, 32], 0, 0].tolist() == [255, 0]
    red = pixels.hsv(np.array([[[255, 0, 0], [0, 255, 0], [10, 10, 10]]], np.uint8))
    assert red.tolist() == [[[0, 255, 255], [85, 255, 255], [0, 0, 10]]]
    h = pixels.histogram(RGB)
    assert h.shape == (32,) and np.isclose(np.linalg.norm(h), 1) and pixels.crop(RGB).shape == (224, 224, 3)
    assert pixels.model_input(pixels.crop(RGB)).shape == (1, 3, 224, 224)


def folder(tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    for name, image in (("a.PNG", base), ("_b.png", base), (".c.png", 255 - base), ("sub/d, ü.png", base)):
        (src / name).write_bytes(decode.png_bytes(image))
    (src / "broken.png").write_bytes(decode.png_bytes(base)[:60])
    (src / "note.txt").write_text("x")
    (src / "noext").write_text("x")
    (src / ".png").write_text("x")
    (src / "link").symlink_to(src / "sub")
    return src


def embedder(spark):
    far = [1.0] + [0.0] * 575
    near = [0.0, 1.0] + [0.0] * 574
    rows = [("a.PNG", near), ("_b.png", near), (".c.png", far), ("sub/d, ü.png", near)]
    return PrecomputedEmbedder(spark.createDataFrame(rows, "rel_path string, embedding array<float>"))


def test_discovery(spark, tmp_path):
    src = folder(tmp_path)
    files, skipped = discover.discover(spark, src)
    assert sorted(r.rel_path for r in files.collect()) == [".c.png", "_b.png", "a.PNG", "broken.png"]
    assert {r.rel_path: r.reason for r in skipped.collect()} == {"note.txt": "unsupported extension: .txt", "noext": "unsupported extension: (none)", ".png": "unsupported extension: (none)"}
    assert [r[0] for r in discover.walk(src, True)][-1] == "sub/d, ü.png"
    with pytest.raises(UsageError):
        discover.discover(spark, src / "missing")


def test_run_and_command_line(spark, tmp_path, capsys):
    src = folder(tmp_path)
    assert cli.main(["-s", str(src), "-d", str(tmp_path / "out"), "--recursive"], spark, embedder(spark)) == 0
    said = capsys.readouterr()
    assert "- Read 4 images.\n- Clustered 4 into 2 groups.\n- Skipped 4." in said.out and "unreadable image: " in said.err
    rows = list(csv.reader(open(tmp_path / "out/manifest.csv", encoding="utf-8", newline="")))
    assert rows[0] == list(sink.HEADER) and [r[3] for r in rows[1:5]] == [".png", "broken.png", "noext", "note.txt"]
    assert [r[:4] for r in rows[5:]] == [["1", "1", "0001-00000001.png", "_b.png"], ["1", "2", "0001-00000002.png", "a.PNG"], ["1", "3", "0001-00000003.png", "sub/d, ü.png"], ["2", "1", "0002-00000001.png", ".c.png"]]
    assert (decode.decode((tmp_path / "out/0001-00000003.png").read_bytes()) == decode.decode((src / "a.PNG").read_bytes())).all()
    assert cli.main(["-s", str(src), "-d", str(tmp_path / "out")], spark, embedder(spark)) == 2
    assert cli.main(["-s", str(src), "-d", str(src / "x")], spark, embedder(spark)) == 2
    assert cli.main(["-s", str(src), "-d", str(tmp_path / "out2"), "--model", str(tmp_path / "no.onnx")], spark) == 3
    empty = tmp_path / "empty"
    empty.mkdir()
    assert cli.main(["-s", str(empty), "-d", str(tmp_path / "out3"), "--model", "no.onnx"], spark) == 2
    with pytest.raises(UsageError, match="at most 2"):
        grouping.run(spark, src, tmp_path / "out4", GroupingOptions(max_files=2))


def Row(n, name="p.png"):
    return sink.PlanRow(name, 1, n, f"0001-{n:08d}.png", 0.1)


def test_sink_guards_and_rollback(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    paths = sink.settled(src, tmp_path / "out")
    for bad in (src / "deep", src):
        with pytest.raises(UsageError):
            sink.settled(src, bad)
    with pytest.raises(UsageError):
        sink.settled(src, tmp_path / "out", tmp_path)
    with pytest.raises(UsageError, match="repeated"):
        sink.preflight(paths, [Row(1), Row(1)])

    def image_of(name):
        if name == "bad":
            raise ValueError("no pixels")
        return b"data"

    with pytest.raises(WriteError, match="no pixels"):
        sink.write_outputs(paths, [Row(1), Row(2), Row(3, "bad")], [], image_of=image_of)
    assert sorted(p.name for p in paths.destination.iterdir()) == ["0001-00000001.png", "0001-00000002.png", "manifest.csv"]
    assert paths.manifest.read_text().splitlines()[1:] == ["1,1,0001-00000001.png,p.png,0.10000000000000001,", "1,2,0001-00000002.png,p.png,0.10000000000000001,"]
    with pytest.raises(UsageError):
        sink.settled(src, tmp_path / "out")


def test_decimal_and_options():
    assert [cli.decimal(x) for x in (0.8, 1.0, 0.75, 0.123)] == ["0.80", "1.00", "0.75", "0.123"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-s", "a", "-d", "b", "--alpha", "0.5", "--color-weight", "3"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-s", "a", "-d", "b", "--threshold", "-1"])


def test_progress_of_a_run(spark, tmp_path):
    src, said, tried, stages = folder(tmp_path), [], [], []
    grouping.run(spark, src, tmp_path / "out", embedder=embedder(spark), stage=stages.append, report=lambda a, b: said.append((len(stages), a / b)), on_attempt=lambda a, b: tried.append((a, b)))
    last = [x for n, x in said if n == 3]
    assert len(stages) == 3 and tried[-1] == (4, 4)
    assert last == sorted(last) and {1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6, 1.0} <= set(last)

    class Screen(list):
        write, flush, isatty = list.append, lambda self: None, lambda self: True

    screen = Screen()
    line = cli.Progress(screen)
    line.begin("one")
    line.update(1, 2)
    line.begin("two")
    assert " 50 %" in screen[1] and "100 %" in screen[2] and screen[2].endswith("\n")


class Session:
    """Stands in for a model: one input, one output, CPU."""

    class End:
        def __init__(self, shape, name="x", kind="tensor(float)"):
            self.shape, self.name, self.type = shape, name, kind

    def __init__(self, first=("n", 3, 224, 224), last=("n", 576), providers=("CPUExecutionProvider",), out=None):
        self.ends, self.providers, self.out = (self.End(list(first)), self.End(list(last))), list(providers), out

    def get_inputs(self):
        return [self.ends[0]]

    def get_outputs(self):
        return [self.ends[1]]

    def get_providers(self):
        return self.providers

    def run(self, names, feed):
        x = next(iter(feed.values()))
        return [self.out if self.out is not None else x.reshape(len(x), -1)[:, :576] + np.float32(3)]


def test_model_signature_and_single_image():
    embed.check_signature(Session())
    embed.check_signature(Session(first=(None, 3, 224, 224)))
    for bad in (Session(first=(1, 3, 224, 224)), Session(last=("n", 500)), Session(providers=("CUDAExecutionProvider", "CPUExecutionProvider")), Session(first=("", 3, 224, 224))):
        with pytest.raises(ModelError, match="does not fit"):
            embed.check_signature(bad)
    found = grouping.extract(RGB, Session())
    assert found["v"].shape == (608,) and np.isclose(np.linalg.norm(found["v"]), 1) and found["aspect_ratio"] == 5 / 7
    assert np.allclose(found["v"][:576], found["embedding"] * np.sqrt(0.8), atol=1e-6)
    with pytest.raises(ModelError, match="usable"):
        grouping.extract(RGB, Session(out=np.zeros((1, 576), np.float32)))
    with pytest.raises(ValueError):
        embed.infer(Session(), np.zeros((9, 3, 224, 224), np.float32))


def test_features_are_checked(spark):
    good = {"rel_path": "a", "dhash": 5, "aspect_ratio": 1.5, "thumb": b"x" * pairs.THUMB_BYTES, "v": [0.6, 0.8]}
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], "rel_path string, dhash long, aspect_ratio double, thumb binary, v array<float>")
    pairs.require_features(frame(good, good | {"rel_path": "b"}))
    for wrong in ({"dhash": None}, {"aspect_ratio": float("nan")}, {"aspect_ratio": 0.0}, {"thumb": b"x"}, {"v": [0.0, 0.0]}, {"v": [float("inf"), 1.0]}, {"v": None}, {"rel_path": "a"}):
        with pytest.raises(GroupingError):
            pairs.require_features(frame(good, good | {"rel_path": "b"} | wrong))


def test_partition_is_checked(spark):
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "rel_path string")
    linkage.require_partition(frame("a", "b"), frame("b", "a"))
    for wrong in (("a",), ("a", "b", "b"), ("a", "b", "c")):
        with pytest.raises(GroupingError):
            linkage.require_partition(frame("a", "b"), frame(*wrong))


def test_storage(spark):
    with storage.scratch(spark) as outer:
        with storage.scratch(spark) as own:
            gone, kept = storage.written(spark.range(3)), storage.written(spark.range(4))
            found = own.keep(kept.where("id > 0"))
        assert found.count() == 3
        with pytest.raises(Exception, match="does not exist"):
            gone.count()
        outer.keep(spark.range(1))
    with pytest.raises(Exception, match="does not exist"):
        found.count()
