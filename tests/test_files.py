"""Images, numbered lines, paged services and crawls: written files read back, against plain Python."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.sources import crawl, files, images, lines, paged

RNG = np.random.default_rng(4)


def plain_png(pixels, bits, colour, filters, passes=None, palette=None, alpha=None):
    """A PNG written byte by byte: any bit depth, filter and interlacing."""
    h, w, count = pixels.shape

    def scan(part):
        out, before = b"", None
        step = max(1, bits * count // 8)
        for r, row in enumerate(part):
            if bits == 16:
                line = b"".join(struct.pack(">H", int(v)) for v in row.ravel())
            else:
                text = "".join(f"{int(v):0{bits}b}" for v in row.ravel())
                line = bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))
            before = before or bytes(len(line))
            kind, coded = filters[r % len(filters)], bytearray()
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                coded.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            out += bytes([kind]) + bytes(coded)
            before = line
        return out

    raw = b"".join(scan(pixels[y::dy, x::dx]) for x, y, dx, dy in passes if pixels[y::dy, x::dx].size) if passes else scan(pixels)
    packed = zlib.compress(raw)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, bool(passes))), chunk(b"tEXt", b"a\0b")]
    parts += [chunk(b"PLTE", palette.tobytes())] if palette is not None else []
    parts += [chunk(b"tRNS", alpha.tobytes())] if alpha is not None else []
    parts += [chunk(b"IDAT", packed[: len(packed) // 2]), chunk(b"IDAT", packed[len(packed) // 2 :]), chunk(b"IEND", b"")]
    return images.SIGNATURE + b"".join(parts)


@pytest.mark.parametrize("filters", [(0,), (1, 2), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("passes", [None, images.PASSES])
def test_every_kind_of_png_decodes(filters, passes):
    for colour, depths in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (4, (8, 16)), (6, (8, 16))):
        for bits in depths:
            for shape in ((1, 1), (5, 9), (13, 3)):
                a = RNG.integers(0, 1 << bits, (*shape, images.SAMPLES[colour]))
                got = images.decode(plain_png(a, bits, colour, filters, passes))
                assert (got == (a * (255 // ((1 << bits) - 1)) if bits < 8 else a)).all() and got.dtype == (np.uint16 if bits == 16 else np.uint8)


def test_palettes_and_own_encoder():
    palette, index = RNG.integers(0, 256, (11, 3)).astype(np.uint8), RNG.integers(0, 11, (6, 7, 1))
    assert (images.decode(plain_png(index, 4, 3, (2, 4), None, palette)) == palette[index[:, :, 0]]).all()
    got = images.decode(plain_png(index, 8, 3, (1,), None, palette, np.array([7, 9], np.uint8)))
    assert (got[:, :, 3] == np.r_[[7, 9], [255] * 9][index[:, :, 0]]).all()
    with pytest.raises(ValueError, match="palette"):
        images.decode(plain_png(index, 4, 3, (0,), None, palette[:3]))
    for dtype, top in ((np.uint8, 256), (np.uint16, 65536)):
        for channels in (1, 2, 3, 4):
            a = RNG.integers(0, top, (8, 5, channels)).astype(dtype)
            assert (images.decode(images.encode(a, (0, 1, 2, 3, 4))) == a).all()


def test_png_files_round_trip_and_broken_ones_are_told(spark, tmp_path):
    made = {f"images/{i}.png" if i % 2 else f"v{i}.PNG": RNG.integers(0, 256, (4 + i, 6, 3)).astype(np.uint8) for i in range(5)}
    rows = [(n, *a.shape, 8, a.tobytes()) for n, a in made.items()]
    table = spark.createDataFrame(rows, "name string, height int, width int, channels int, bits int, pixels binary").repartition(3)
    assert files.write_files(images.encoded(table, (4, 3)), f"{tmp_path}/set").agg(F.sum("bytes")).first()[0] > 0
    whole = images.encode(made["v0.PNG"])
    for name, data in (("cut", whole[:-20]), ("bits", whole[:60] + b"x" + whole[61:]), ("short", whole.replace(b"\x00\x00\x00\x04\x08", b"\x00\x00\x00\x05\x08", 1))):
        (tmp_path / "set" / f"{name}.png").write_bytes(data)
    got = {r.path.split("/set/")[1]: r for r in images.read_png(spark, f"{tmp_path}/set").collect()}
    assert set(got) == {*made, "cut.png", "bits.png", "short.png"}
    for n, a in made.items():
        assert (got[n].height, got[n].width, got[n].channels, got[n].bits, got[n].problem) == (*a.shape, 8, None) and got[n].pixels == a.tobytes()
    assert all(got[f"{n}.png"].problem and got[f"{n}.png"].pixels is None for n in ("cut", "bits", "short"))
    manifest = spark.createDataFrame([(0, "v0.PNG", "no.png"), (1, None, "1.png"), (2, "images/v2.PNG", None), (3, "images/3.png", None), (4, "gone.png", None)], "line int, mask_bw string, image string")
    values = images.intensities(images.with_images(manifest, images.read_png(spark, f"{tmp_path}/set"), f"{tmp_path}/set", "line"))
    found = {r.line: np.array(r["values"]) for r in values.collect()}
    assert set(found) == {0, 1, 2, 3}
    for line, name in ((0, "v0.PNG"), (1, "images/1.png"), (2, "v2.PNG"), (3, "images/3.png")):
        assert np.allclose(found[line], made[name].mean(axis=2).ravel() / 255, atol=1e-6)
    with pytest.raises(Exception, match="without mask_bw or image"):
        images.with_images(spark.createDataFrame([(1, None)], "line int, image string"), images.read_png(spark, f"{tmp_path}/set"), f"{tmp_path}/set", "line").collect()


def test_lines_keep_their_numbers_however_files_are_split(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for f in range(3):
        rows = ["" if rng.random() < 0.2 else f"{f}-{i}-" + "x" * rng.randrange(60) for i in range(400)]
        (tmp_path / f"m{f}.txt").write_text("\n".join(rows) + "\n" * (f > 0))
        want |= {(f"m{f}.txt", i + 1): r for i, r in enumerate(rows)}
    (tmp_path / "empty.txt").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = lines.numbered_lines(spark, str(tmp_path))
            assert {(r.path.rsplit("/", 1)[1], r.line_no): r.value for r in got.collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_strict_manifests_name_the_line(spark, tmp_path):
    file = tmp_path / "m.jsonl"
    file.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in lines.strict_manifest(spark, str(file), "a int").collect()) == [1, 2]
    for bad in ('{"a": ', "7", "[1]"):
        file.write_text('{"a": 1}\n\n \n' + bad + '\n{"a": 2}\nnope\n')
        with pytest.raises(ValueError, match="at line 4 of .*m.jsonl"):
            lines.strict_manifest(spark, str(file), "a int")
    file.write_text("\n  \n")
    with pytest.raises(ValueError, match="empty manifest"):
        lines.strict_manifest(spark, str(file), "a int")


def saved(folder, answers):
    folder.mkdir(exist_ok=True)
    for n, a in answers.items():
        (folder / f"page-{n}.json").write_text(json.dumps(a))


def test_pages_are_partitions_and_filters_reach_the_source(spark, tmp_path):
    answers = {n: {"_embedded": {"no": 1, "things": [{"id": 10 * n + i} for i in range(3)]}, "page": {"totalPages": 6}} for n in range(9)}
    saved(tmp_path / "a", answers)
    table = paged.pages(spark, f"{tmp_path}/a")
    assert table.rdd.getNumPartitions() == 6
    assert sorted((r.page, r.pos, json.loads(r.item)["id"]) for r in table.collect()) == [(n, i, 10 * n + i) for n in range(6) for i in range(3)]
    some = table.where("page >= 2 and page < 4 and pos > 0")
    assert some.rdd.getNumPartitions() == 2 and sorted((r.page, r.pos) for r in some.collect()) == [(2, 1), (2, 2), (3, 1), (3, 2)]
    assert table.where("page = 5").count() == 3 and table.where("page > 5").count() == 0 and table.where("page > 4 and page < 3").count() == 0
    assert paged.pages(spark, f"{tmp_path}/a", start="1", pages="2").count() == 6


def test_without_a_total_an_empty_page_ends_the_walk(spark, tmp_path):
    saved(tmp_path / "b", {0: {"results": [1, 2]}, 1: {"data": [3]}, 2: {"other": [9]}, 3: {"results": [4]}})
    assert [(r.page, r.item) for r in paged.pages(spark, f"{tmp_path}/b").collect()] == [(0, "1"), (0, "2"), (1, "3")]
    assert [r.item for r in paged.pages(spark, f"{tmp_path}/b").where("page >= 1").collect()] == ["3"]
    assert paged.pages(spark, f"{tmp_path}/b", start="4").count() == 0


def test_many_pages_share_partitions(tmp_path):
    for n in range(1100):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"data": [] if n == 4 else [n], "page": {"totalPages": 1100}}))
    reader = paged.Pages(paged.Service(str(tmp_path), 500, None, None), 0, 10**6)
    list(reader.pushFilters([]))
    parts = reader.partitions()
    assert len(parts) <= paged.PARTITIONS
    assert [(n, item) for p in parts for n, _, item in reader.read(p)] == [(n, str(n)) for n in range(1100) if n != 4]


def test_a_stream_takes_pages_as_they_appear(spark, tmp_path):
    paged.pages(spark, f"{tmp_path}/c")
    saved(tmp_path / "c", {0: {"data": [1, 2]}, 1: {"data": [3]}})

    def run():
        q = spark.readStream.format("paged_json").option("path", f"{tmp_path}/c").load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.page, r.item) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(0, "1"), (0, "2"), (1, "3")]
    saved(tmp_path / "c", {2: {"data": [4]}, 4: {"data": [6]}})
    assert run() == [(0, "1"), (0, "2"), (1, "3"), (2, "4")]
    assert run() == [(0, "1"), (0, "2"), (1, "3"), (2, "4")]


def test_pages_over_http(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread
    from urllib.parse import parse_qs, urlsplit

    class Answers(BaseHTTPRequestHandler):
        def answer(self, body):
            asked = parse_qs(urlsplit(self.path).query)
            text = json.dumps({"data": [[int(asked["page"][0]), asked["size"][0], asked.get("q"), body]], "page": {"totalPages": 3}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self):  # noqa: N802
            self.answer(None)

        def do_POST(self):  # noqa: N802
            self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/select"
    assert sorted(json.loads(r.item) for r in paged.pages(spark, address, size="7", q="a b").collect()) == [[n, "7", ["a b"], None] for n in range(3)]
    assert sorted(json.loads(r.item) for r in paged.pages(spark, address, body='{"k": ["v"]}').collect()) == [[n, "500", None, {"k": ["v"]}] for n in range(3)]
    server.shutdown()


def test_crawl_by_brute_force(spark):
    rng = random.Random(3)
    names = [f"http://h/d{i}/" for i in range(40)]
    tree = {}
    for n in names:
        out = [rng.choice(names) for _ in range(rng.randrange(4))] + [rng.choice(["sub/", "a.swc", "B.SWC", "c.txt", "?q", "/x/", "../up/", "http://h/shared.swc", "x.tar.swc", ".swc"]) for _ in range(5)]
        tree[n] = out
        tree.setdefault(n + "sub/", ["deep.swc", "sub/"])
    pages = [(u, "".join(f"<li><A class=x HREF='{x}'>t</a>" for x in out)) for u, out in tree.items()] + [(None, "<a href=z.swc>"), ("http://h/e/", None)]
    for depth in (0, 1, 3):
        want, seen, frontier = {}, {}, ["http://h/d0/", "http://h/d1/", "http://nowhere/"]
        for k in range(depth + 1):
            for u in frontier:
                seen[u] = k
            for u in sorted(frontier):
                for x in tree.get(u, []):
                    to = x if x.startswith("http") else u.rstrip("/") + "/" + x
                    if not x.startswith(("?", "/", "..")) and not x.endswith("/") and x.rsplit("/", 1)[-1].lower().endswith(".swc") and x != ".swc":
                        want.setdefault(to, (k, u, x))
            frontier = sorted({x if x.startswith("http") else u.rstrip("/") + "/" + x for u in frontier for x in tree.get(u, []) if x.endswith("/") and not x.startswith(("?", "/", ".."))} - set(seen))
        got = crawl.crawl(spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame([("http://h/d0/",), ("http://h/d1/",), ("http://nowhere/",), (None,)], "url string"), depth=depth).collect()
        assert {r.url: (r.depth, r.listing, r.filename) for r in got} == want and len(got) == len(want)
        assert all(r.cell_id == r.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0] for r in got)


def test_images_are_decoded_once_where_their_files_are_listed(spark, tmp_path):
    for name, v in (("a.png", 51), ("images/b.png", 102)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(images.encode(np.full((2, 2, 1), v, np.uint8)))
    manifest = spark.createDataFrame([(1, "images/a.png"), (2, "b.png"), (3, "c.png")], "id int, image string")
    png = images.png_files(spark, str(tmp_path))
    rows = images.with_images(manifest, images.decoded(png), str(tmp_path), "id", png)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.id, r.pixels[0], len(r.pixels)) for r in rows.collect()) == [(1, 51, 4), (2, 102, 4)]
