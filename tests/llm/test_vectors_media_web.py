import base64
import gzip
import hashlib

import numpy as np
import pytest

from lumenlit.llm import components as module
from lumenlit.llm import images, vector_graph, warc
from lumenlit.llm.components import components, forest
from lumenlit.llm.store import shared_dir
from lumenlit.llm.vector_graph import build, near_duplicate_vectors, range_search, true_links


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in [*range(41), 200]} | {(100, 100), (101, 100)}
    assert not components(spark.createDataFrame([], "a long, b long"), "a", "b").collect()


@pytest.mark.parametrize("at_once", [10**6, 50])
def test_components_end_in_one_task_or_in_rounds(spark, monkeypatch, at_once):
    rng, joins = np.random.default_rng(4), []
    monkeypatch.setattr(module, "_tied", lambda *x, tied=module._tied: joins.append(1) or tied(*x))
    edges = np.concatenate((rng.integers(-300, 300, (250, 2)), np.stack((rng.permutation(200), rng.permutation(200)), axis=1) + 1000))
    edges = np.concatenate((edges, [(5000 + i, -7000) for i in range(300)], [(9000, 9000)]))  # a hub, and a loop alone
    frame = spark.createDataFrame(edges.tolist(), "a long, b long").repartition(3)
    got = {r.node: r.component for r in components(frame, "a", "b", at_once).collect()}
    nodes = np.unique(edges)
    root = forest(len(nodes), *np.searchsorted(nodes, edges.T))
    ends = {int(x) for e in edges.tolist() if e[0] != e[1] for x in e}
    assert got == {int(x): int(nodes[r]) for x, r in zip(nodes, root) if int(x) in ends}
    assert bool(joins) == (at_once == 50)  # few edges are not joined round by round
    words = {tuple(r) for r in components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"), "a", "b").collect()}
    assert words == {("a", "a"), ("b", "a"), ("c", "a")}


def test_graph_finds_what_is_near():
    rng = np.random.default_rng(0)
    base = unit(rng.normal(size=(600, 24)))
    X = unit(np.concatenate([base, base[:200] + 0.05 * rng.normal(size=(200, 24)), base[:1] + 0.02 * rng.normal(size=(150, 24))])).astype(np.float32)
    a, b = range_search(X, build(X), 0.93, 48)
    found = set(zip(a.tolist(), b.tolist()))
    true = set(zip(*(x.tolist() for x in np.nonzero(X @ X.T >= 0.93))))
    assert len(found & true) >= 0.97 * len(true)


@pytest.mark.parametrize("shard", [1200, 60])
def test_vectors_equal_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    hot = base[:1] + 0.03 * rng.normal(size=(90, 16))
    vectors = [*base, *(base[20:60] + 0.03 * rng.normal(size=(40, 16))), *hot, base[3], base[3]]
    rows = [(i, [float(y) for y in np.float32(v)], i % 2 if i < 150 else 0 if i >= 190 else (20 + i - 150) % 2) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, rows[0][1], None), (n + 5, [1.0], 0), (n + 6, [], 0), (n + 7, [2 * x for x in rows[0][1]], 0), (None, rows[4][1], 0), (n + 8, [float("inf")] * 16, 1)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=shard).collect()}
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ok = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    true = 0
    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[i] += 1
                links[j] += 1
                true += 1
                x, y = find(i), find(j)
                if x != y:
                    lo, hi = sorted((x, y), key=lambda k: (k is None, k or 0))
                    root[hi] = lo
    assert len(got) == len(rows)
    total = sum(r.n_links for r in got.values())
    assert 0.97 * 2 * true <= total <= 2 * true and all(r.n_links <= links[i] for i, r in got.items())
    assert [i for i, r in got.items() if i is not None and r.component_id != find(i)] == []
    assert not near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect()


def picture(seed, size=120):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (size // 10, size // 10)), np.ones((10, 10))).astype(float)


def test_noisy_copies_of_rendered_vectors(spark):
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=(120, 64)))
    noisy = unit(base[:60] + 0.25 * rng.normal(size=(60, 64)) / 8)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(np.concatenate([base, noisy]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.image_id: r.class_id for r in images.image_copies(images.render_vectors(df)).collect()}
    own = {i: i if i < 120 else i - 120 for i in got}
    assert sum(got[120 + i] == i for i in range(60)) >= 45
    assert all(got[i] == i or got[i] == own[i] for i in got)  # no class holds two groups


def test_overlay_tells_copies_from_chance():
    x, y = picture(1), picture(2)
    turned = np.rot90(x)
    assert images.overlay(x, x[17:, 9:], 1, 9 + 17j) > 0.95 and images.overlay(x, turned, 1j, 120) > 0.95
    assert images.overlay(x, y, 1, 0) < 0.6 and images.overlay(x, np.ones((50, 50)), 1, 0) == 0 and images.overlay(x, x, 1, 115 + 115j) == 0


def test_cropped_and_edited_images(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(12):
        x = picture(i)
        rows.append((10 * i, images.encode_pgm(x)))
        if i < 6:
            rows.append((10 * i + 1, images.encode_pgm(x[17:, 9:])))  # cropped
            rows.append((10 * i + 2, images.encode_pgm(0.8 * x + 30 + rng.normal(0, 3, x.shape))))  # paler, with noise
            rows.append((10 * i + 3, images.encode_pgm(np.rot90(x))))  # turned
    rows += [(900, None), (901, b"no image"), (902, images.encode_pgm(np.full((50, 50), 9.0))), (903, rows[0][1]), (904, b""), (None, images.encode_pgm(picture(77)))]
    got = {r.image_id: r for r in images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        group = {k for k, r in got.items() if r.class_id == 10 * i}
        want = {10 * i} | ({10 * i + 1, 10 * i + 2, 10 * i + 3} if i < 6 else set()) | ({903} if i == 0 else set())
        assert group == want
    assert got[900].kept and got[901].class_id == 901 and got[903].copies == 2
    assert not images.image_copies(spark.createDataFrame([], "image_id long, image binary")).collect()


def test_images_are_decoded():
    import struct
    import zlib

    x = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (images.decode_image(images.encode_pgm(x)) == x).all()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"

    for kind in range(5):
        out, prev = b"", np.zeros(7, int)
        for line in x.astype(int):
            left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], prev[:-1]))
            p = left + prev - corner
            paeth = np.where((abs(p - left) <= abs(p - prev)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - prev) <= abs(p - corner), prev, corner))
            out += bytes([kind]) + bytes(((line - [0, left, prev, (left + prev) // 2, paeth][kind]) & 255).astype(np.uint8) if kind else line.astype(np.uint8))
            prev = line
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")
        assert (images.decode_image(data) == x).all()
    assert images.decode_image(b"P5 x") is None and images.decode_image(None) is None


def test_warc(spark):
    rows = [(5, "http://a/é", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (7, "u", "x" * 300000), (None, "u", "same"), (8, "u", "WARC/1.1\r\n\r\nnested"), (8, "u", "WARC/1.1\r\n\r\nnested"), (4, "u", "ünï\r\n\r\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.warc_roundtrip(df, shared_dir(spark, "w")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = first[h or ""] if i is not None and first[h or ""] != i else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if to is not None else "response", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r.payload).decode() in {h or "" for _, _, h in rows} for r in got if r.record_type == "response")
    big = warc.warc_roundtrip(df, shared_dir(spark, "w"), min_bytes=1000).collect()
    assert {r.record_type for r in big} == {"response"}
    assert not warc.warc_roundtrip(df.limit(0), shared_dir(spark, "w")).collect()


def test_normaliser(tmp_path):
    records = [warc._record(i, "http://x", b"p" * i * 70000, None) for i in range(30)]
    (tmp_path / "raw.warc.gz").write_bytes(gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))
    out = str(tmp_path / "out.warc.gz")
    assert warc.normalise_archive(str(tmp_path / "raw.warc.gz"), out) == 30
    data = open(out, "rb").read()
    assert gzip.decompress(data) == b"".join(records)
    for line, want in zip(open(out + ".idx"), records):
        at, n = map(int, line.split("\t")[3:5])
        assert gzip.decompress(data[at : at + n]) == want
    (tmp_path / "cut.warc.gz").write_bytes((tmp_path / "raw.warc.gz").read_bytes()[:3000])
    with pytest.raises(ValueError):
        warc.normalise_archive(str(tmp_path / "cut.warc.gz"), out)


def test_records_are_valid(spark, tmp_path):
    import re

    rows = [(5, "http://a/é\u2028x y", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (9, None, "same"), (None, "u", "same"), (4, "u", ""), (6, "u", None), (7, "u", "alone")]
    out = shared_dir(spark, "w")
    warc.warc_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string"), out).collect()
    folder = out.removeprefix("file://")
    import glob

    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{folder}/warc/*.warc.gz"))
    ids, named, kinds = [], [], []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        assert lines[0] == "WARC/1.1"
        f = dict(x.split(": ", 1) for x in lines[1:])
        n = int(f["Content-Length"])
        block, data = rest[:n], rest[n + 4 :]
        assert rest[n : n + 4] == b"\r\n\r\n" and f["WARC-Block-Digest"] == "sha1:" + warc.base32_sha1(block)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
        ids.append(f["WARC-Record-ID"])
        kinds.append(f["WARC-Type"])
        if f["WARC-Type"] == "revisit":
            named.append(f["WARC-Refers-To"])
        if f["WARC-Type"] == "response":
            assert block.startswith(b"HTTP/1.1 200") and f["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(block.partition(b"\r\n\r\n")[2])
        if f.get("X-Page-ID") == "5":
            assert f["WARC-Target-URI"] == "http://a/%C3%A9%E2%80%A8x%20y"
    assert len(set(ids)) == len(ids) and set(named) <= set(ids) and len(named) == 3
    assert kinds.count("response") == 5 and kinds[0] == "warcinfo"


def soft_picture(seed, size=120, cell=10):
    rng = np.random.default_rng(seed)
    return images._blur(np.kron(rng.integers(0, 256, (size // cell, size // cell)), np.ones((cell, cell))).astype(np.float32)[None], 3)[0]


EDITS = {
    "cropped": lambda x, rng: x[20:100, 20:100],
    "smaller": lambda x, rng: images._resize(x[None].astype(np.float32), 0.7)[0],
    "contrast": lambda x, rng: 128 + 1.5 * (x - 128),
    "noise": lambda x, rng: x + rng.normal(0, 8, x.shape),
    "turned": lambda x, rng: np.rot90(x),
    "paler": lambda x, rng: 0.8 * x + 30,
}


def test_edited_copies_by_kind_of_edit(spark):
    rng, rows, n = np.random.default_rng(4), [], 20
    for k, (name, edit) in enumerate(EDITS.items()):
        for i in range(n):
            x = soft_picture(1000 * k + i)
            rows += [(10_000 * k + i, images.encode_pgm(x)), (10_000 * k + 5000 + i, images.encode_pgm(edit(x, rng)))]
    rows += [(90_000 + i, images.encode_pgm(soft_picture(90_000 + i))) for i in range(30)]
    got = {r.image_id: r.class_id for r in images.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(got) == len(rows)
    for k, name in enumerate(EDITS):
        assert sum(got[10_000 * k + 5000 + i] == 10_000 * k + i for i in range(n)) >= 0.9 * n, name
    assert all(c == (i if i % 10_000 < 5000 else i - 5000) or c == i for i, c in got.items())  # no class of two pictures


def test_a_large_group_of_copies_and_large_buckets(spark):
    rng, x = np.random.default_rng(6), soft_picture(1)
    rows = [(i, images.encode_pgm(x + rng.normal(0, 4, x.shape))) for i in range(60)] + [(100 + i, images.encode_pgm(soft_picture(50 + i))) for i in range(20)]
    df = spark.createDataFrame(rows, "image_id long, image binary")
    for part in (2000, 12):
        got = {r.image_id: r for r in images.image_copies(df, tables=4, part=part).collect()}
        assert all(got[i].class_id == 0 for i in range(60)) and all(got[100 + i].class_id == 100 + i for i in range(20))
        assert sum(r.n_bound for r in got.values()) < 60 * 59 / 2  # a group is tied together, not paired out


def test_votes_do_not_depend_on_the_size_of_parts(spark):
    from collections import Counter, defaultdict

    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (12, 32)).astype(np.uint8)
    rows = []
    for i in range(90):  # corners of few kinds, with some bits turned, so that buckets are large and hold copies
        tests = base[rng.integers(0, len(base), 6)] ^ np.packbits(rng.random((6, 256)) < 0.06, axis=1)
        tests[5] = tests[4]
        rows.append((i, images.pack_points(np.zeros(6), np.zeros(6), np.ones(6), np.zeros(6), tests)))
    points, near = spark.createDataFrame(rows, "id long, points binary"), 44
    want = Counter()
    buckets = defaultdict(list)
    for r in images._hashed(points, 1, 3).collect():
        buckets[r.bucket].append((r.id, bytes(r.tests)))
    assert max(map(len, buckets.values())) > 60
    for own in buckets.values():
        own.sort()
        for i, (a, x) in enumerate(own):
            far = [((int.from_bytes(x) ^ int.from_bytes(y)).bit_count(), j) for j, (b, y) in enumerate(own) if b != a]
            some = [(d, j) for d, j in far if d <= near]
            for j in {min(j for _, j in some), min(some)[1]} if some else ():
                want[tuple(sorted((a, own[j][0])))] += 1
    want = {k: n for k, n in want.items() if n > 1}
    assert len(want) > 20
    for part in (2000, 40, 7, 1):
        assert {(r.a, r.b): r.n for r in images._table_votes(points, 1, 3, near, part).collect()} == want, part


def test_large_buckets_are_known_where_corners_are_hashed(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (4, 32)).astype(np.uint8)
    made = [base[rng.integers(0, 4, 6)] ^ np.packbits(rng.random((6, 256)) < 0.06, axis=1) for _ in range(60)]
    points = spark.createDataFrame([(i, images.pack_points(np.zeros(6), np.zeros(6), np.ones(6), np.zeros(6), x)) for i, x in enumerate(made)], "id long, points binary")
    plans, votes = [], images._votes

    def seen(rows, near, folder):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return votes(rows, near, folder)

    monkeypatch.setattr(images, "_votes", seen)
    got = {}
    for part, options in ((2000, {}), (20, {}), (20, {"listed": 0})):
        got[part, *options] = sorted(map(tuple, images._table_votes(points, 1, 3, 44, part, **options).collect()))
    assert len(got[2000,]) > 20 and got[2000,] == got[20,] == got[20, "listed"]
    assert ["Join" in x for x in plans] == [False, False, True]  # no row of a small bucket goes through a join


def test_corners_are_dealt_in_blocks(spark, monkeypatch):
    rng, dealt, votes = np.random.default_rng(15), [], images._votes
    made = [rng.integers(0, 256, (40, 32)).astype(np.uint8) for _ in range(60)]
    points = spark.createDataFrame([(i, images.pack_points(np.zeros(40), np.zeros(40), np.ones(40), np.zeros(40), x)) for i, x in enumerate(made)], "id long, points binary")
    monkeypatch.setattr(images, "_votes", lambda rows, near, folder: (dealt.append(rows.count()), votes(rows, near, folder))[1])
    images._table_votes(points, 1, 8, 44, 2000)
    assert 0 < dealt[0] <= 16  # not one row for each of 2,400 corners


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_on_images_hold_little():
    noise = np.random.default_rng(3).integers(0, 256, (90, 80, 80)).astype(np.float32)
    assert peak_mb(lambda: images.corners(noise)) < 70  # 94 MB with the places of 8,000 corners at once

    def rows():
        for _ in range(20):
            yield {"a": np.zeros(250_000, np.int64)}  # 2 MB

    def used():
        for lot in images._gathered(rows(), 2_500_000):  # 20 MB
            copies = [lot["a"].copy() for _ in range(3)]
            del lot, copies

    assert peak_mb(used) < 90  # the parts of a lot are not held beside it


def test_a_shelf_holds_its_last_blocks_and_few_pixels(tmp_path, monkeypatch):
    import pyarrow as pa

    for k in range(4):
        ids = range(4 * k, 4 * k + 4)
        one = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([b""] * 4, pa.large_binary()), pa.array([images.encode_pgm(np.full((30, 40), 9 * i)) for i in ids], pa.large_binary())], names=["id", "points", "image"])
        with pa.OSFile(f"{tmp_path}/{k}", "wb") as f, pa.ipc.new_file(f, one.schema) as w:
            w.write_batch(one)
    read, opened = [], images.read_file
    monkeypatch.setattr(images, "read_file", lambda uri: read.append(uri[-1]) or opened(uri))
    shelf = images._Shelf(str(tmp_path), 4, pixels=3000)
    for b in (1, 2, 3):
        for i in range(4):
            for j in (i, 4 * b + i):
                assert len(shelf.points(j)) == 0 and (shelf.image(j) == 9 * j).all()
                assert shelf.size == sum(x.size for x in shelf.smooth.values()) <= 3000
    assert read == list("0123")  # block 0, in use all the time, is read once


def test_images_go_to_python_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from lumenlit.llm.store import small_batches

    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], images.materialise
    before = spark.conf.get(key)

    def lengths(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    sizes = lambda: [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(lengths, "n long").collect()]
    with small_batches(spark):
        assert max(sizes()) == 1000 and sum(sizes()) == 2500
    with small_batches(spark), small_batches(spark):
        assert max(sizes()) == 1000
    monkeypatch.setattr(images, "materialise", lambda df, name: seen.append(int(spark.conf.get(key))) or write(df, name))
    df = spark.createDataFrame([(i, images.encode_pgm(soft_picture(i % 2))) for i in range(3)], "image_id long, image binary")
    assert {r.image_id: r.class_id for r in images.image_copies(df, tables=1).collect()} == {0: 0, 1: 1, 2: 0}
    assert len(seen) > 5 and max(seen) <= 1000 and spark.conf.get(key) == before


def test_large_buckets_of_several_tables_are_counted_whole(spark):
    from collections import Counter

    rng = np.random.default_rng(21)
    base = rng.integers(0, 256, (5, 32)).astype(np.uint8)
    rows = [(i, images.pack_points(np.zeros(6), np.zeros(6), np.ones(6), np.zeros(6), base[rng.integers(0, 5, 6)])) for i in range(200)]
    points = spark.createDataFrame([*rows, (900, b"")], "id long, points binary").repartition(3)
    want = {(t, b): -(-n // 150) for t in (0, 1, 2) for b, n in Counter(r.bucket for r in images._hashed(points, t, 5).collect()).items() if n > 150}
    assert want and {(r.table, r.bucket): r.parts for r in images._large(points, range(3), 5, 150, 3).collect()} == want


def test_every_pair_of_corners_counts_where_images_are_not_kin(spark):
    from collections import Counter, defaultdict

    rng = np.random.default_rng(12)
    base = rng.integers(0, 256, (6, 32)).astype(np.uint8)
    made = [base[rng.integers(0, 6, 6)] ^ np.packbits(rng.random((6, 256)) < 0.06, axis=1) for _ in range(70)]
    rows = [(i, images.pack_points(np.zeros(6), np.zeros(6), np.ones(6), np.zeros(6), x), i if i % 3 else 0) for i, x in enumerate(made)]
    points, buckets, want = spark.createDataFrame(rows, "id long, points binary, kin long"), defaultdict(list), Counter()
    for r in images._hashed(points, 1, 3).collect():
        buckets[r.bucket].append((r.id, int.from_bytes(r.tests), r.kin))
    for own in buckets.values():
        for a, x, k in own:
            want.update((a, b) for b, y, m in own if a < b and k != m and (x ^ y).bit_count() <= 44)
    want = {k: n for k, n in want.items() if n > 1}
    assert len(want) > 500
    for part, options in ((2000, {}), (30, {}), (7, {}), (30, {"listed": 0})):
        assert {(r.a, r.b): r.n for r in images._table_votes(points, 1, 3, 44, part, **options).collect()} == want, part


def test_png_of_other_depths():
    import struct
    import zlib

    def png(bits, colour, w, h, lines, palette=b""):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines)))

    assert images.decode_image(png(1, 0, 10, 1, [bytes([0b10100000, 0b01000000])])).tolist() == [[255, 0, 255, 0, 0, 0, 0, 0, 0, 255]]
    assert images.decode_image(png(16, 0, 2, 1, [bytes([7, 99, 200, 1])])).tolist() == [[7, 200]]
    assert images.decode_image(png(4, 3, 3, 1, [bytes([0x01, 0x20])], bytes([0, 0, 0, 30, 60, 90, 9, 9, 9]))).tolist() == [[0, 60, 9]]
    assert images.decode_image(png(8, 3, 3, 1, [b"abc"])) is None


def test_recall_over_a_whole_label(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 32))
    near = base[:500] + 0.04 * rng.normal(size=(500, 32))
    group = base[7] + 0.04 * rng.normal(size=(700, 32))
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(np.concatenate([base, near, group]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    X = unit(np.array([r[1] for r in rows]))
    want = ((X[::10] @ X.T >= 0.93).sum(axis=1) - 1).tolist()
    true = {r.vec_id: r.true_links for r in true_links(df, every=10, block=300).collect()}
    assert [true[i] for i in range(0, len(rows), 10)] == want
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, shard=200).collect()}
    assert all(got[i] <= n for i, n in true.items()) and sum(got[i] for i in true) >= 0.97 * sum(true.values())


def test_vectors_go_to_shards_in_turns_and_leave_little(spark):
    from pathlib import Path

    rng = np.random.default_rng(9)
    base = rng.normal(size=(1200, 128))
    vectors = np.float32(np.concatenate([base, base[:300] + 0.04 * rng.normal(size=(300, 128))]))
    df = spark.createDataFrame([(i, [float(y) for y in v], i % 2 if i < 1200 else i % 1200 % 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before, results = held(), []
    for turn in (1_000_000, 300):
        results.append(sorted(map(tuple, near_duplicate_vectors(df, shard=100, turn=turn).collect())))
    assert results[0] == results[1] and sum(r[1] for r in results[0]) >= 0.97 * 600
    assert held() - before < 2 * 2 * vectors.nbytes  # two runs
    for v in ([1.5, -0.0, 3.0], [0.1, 1e300, 5e-324]):
        x = np.array(v)
        packed = vector_graph.pack_vector(x)
        assert packed[0] == (4 if v[0] == 1.5 else 8) and len(packed) == 1 + 3 * packed[0]
        assert np.allclose(vector_graph.unit_vectors([packed, vector_graph.pack_vector(x / 3)])[0], x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()), rtol=1e-15, atol=0)


def test_a_class_stands_once_in_a_shard(spark, monkeypatch):
    rng = np.random.default_rng(12)
    group = rng.normal(size=(1, 32)) + 0.04 * rng.normal(size=(500, 32))
    vectors = np.concatenate([group, rng.normal(size=(200, 32))])
    df = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    X = unit(vectors)
    want = ((X @ X.T >= 0.93).sum(axis=1) - 1).tolist()
    held, search = [], vector_graph._search
    monkeypatch.setattr(vector_graph, "_search", lambda members, *rest: held.append(members.count()) or search(members, *rest))
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, shard=80).collect()}
    assert [got[i] for i in range(len(vectors))] == want
    assert sum(held) <= 3 * len(vectors)  # the group, more than a shard, was repeated for pairs of its blocks
    for options in ({"shard": 80, "whole": 50}, {"shard": 20}):  # by graphs; by pairs of blocks
        some = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, **options).collect()}
        assert all(n <= want[i] for i, n in some.items()) and sum(some.values()) >= 0.97 * sum(want)
    A = np.array([[1, 2, 9], [2, 3, 9], [2, 9, 9]])
    assert vector_graph._first_shared(A, np.array([0, 0, 1]), np.array([1, 2, 2]), 2).all() and not vector_graph._first_shared(A, np.array([0]), np.array([0]), 2).any()
