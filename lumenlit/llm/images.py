"""Cropped and edited copies among images, by local descriptors.

Corners are found at several scales; each gets the direction of its patch's
intensity centroid and 256 binary tests of smoothed pixels, turned by it. The
descriptors meet in ``tables`` hash tables of ``bits`` sampled bits, one table
after another. In a bucket a descriptor votes for the images of the first and of
the nearest descriptor within ``near`` bits: two votes at most, whatever the
size of a group of copies, and the first ones tie such a group together. Large
buckets are dealt into parts that are compared a part with a part, with the same
votes as in one. Pairs of images with several votes are compared corner by
corner: each corner of the one with its nearest of the other, in all bits. These
matches must agree on one turn, scale and shift. Pairs with ``inliers`` such
matches are laid over each other by them, and those whose pixels correlate are
bound: by ``alike``, or with ``sure`` matches by half of it. The strongest pair
of each image and that with the smallest image are compared first; the others
follow unless both images are in one class by then. What is bound is a class of copies.

A corner's two votes may go to others than a true copy, where many images hold
parts of one. So the tables are gone through again, and of images that are not
in one class by then every pair of corners within ``near`` bits counts; pairs of
images that have enough of these and were not compared are compared like the rest.

Images are binary PGM, PPM or PNG of 1 to 16 bits, grey, colour or palette.
Interlaced PNG and other formats (JPEG among them) count as undecodable.

Cases: null, undecodable, tiny and plain images have no corner and stand alone;
equal images are copies of one class whether or not they have corners (null
ones aren't); a null id counts as an image, ids of classes are the smallest that
is not null (else null); an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import tidy
from lumenlit.llm.components import components
from lumenlit.llm.store import AtomicFile, discard, discard_dir, materialise, read_file, shared_dir, small_batches

_RADIUS, _TESTS, _TURNS = 18, 256, 30
_draw = np.random.default_rng(2024)
_PATTERN = _draw.normal(0, 8.5, (_TESTS, 2, 2))
_PATTERN /= np.maximum(1, np.linalg.norm(_PATTERN, axis=2, keepdims=True) / (_RADIUS - 1))
_TURNED = np.stack([np.rint(_PATTERN @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])).astype(int) for t in np.arange(_TURNS) * 2 * math.pi / _TURNS])


# --- pixels ---------------------------------------------------------------------------------------------------------


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.float32).mean(axis=1)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[12] or head[9] not in (0, 2, 3, 4, 6) or head[8] not in (1, 2, 4, 8, 16) or head[9] == 3 and palette is None:
        return None
    w, h, bits, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    line_bytes, step = (w * channels * bits + 7) // 8, max(1, channels * bits // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + line_bytes)
    out = np.zeros((h, line_bytes), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(int), (out[y - 1] if y else np.zeros(line_bytes, np.uint8)).astype(int)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up & 255
        elif kind == 1:
            full = np.zeros(-(-line_bytes // step) * step, int)
            full[:line_bytes] = line
            out[y] = (np.cumsum(full.reshape(-1, step), axis=0).reshape(-1) & 255)[:line_bytes]
        else:
            row = [0] * line_bytes
            for x, (v, b) in enumerate(zip(line.tolist(), up.tolist())):
                a, c = (row[x - step], int(up[x - step])) if x >= step else (0, 0)
                if kind == 3:
                    p = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                row[x] = v + p & 255
            out[y] = row
    if bits == 16:
        out = out[:, ::2]
    elif bits < 8:
        out = np.unpackbits(out, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        out = out[:, :w] * (1 if colour == 3 else 255 / ((1 << bits) - 1))
    pixels = out[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        return palette[np.minimum(pixels[:, :, 0].astype(int), len(palette) - 1)]
    return pixels[:, :, : channels - (channels in (2, 4))].astype(np.float32).mean(axis=2)


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values, or None for what isn't an image of these kinds."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            parts = data.split(maxsplit=4)
            w, h, most = (int(x) for x in parts[1:4])
            depth = 1 if data[:2] == b"P5" else 3
            if most != 255:
                return None
            return np.frombuffer(data[-w * h * depth :], np.uint8).reshape(h, w, depth).astype(np.float32).mean(axis=2)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, zlib.error):
        pass
    return None


def encode_pgm(pixels: np.ndarray) -> bytes:
    grey = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, for a stack of images."""
    h, w = max(1, round(x.shape[1] * scale)), max(1, round(x.shape[2] * scale))
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    ys, xs = np.clip(ys, 0, x.shape[1] - 1), np.clip(xs, 0, x.shape[2] - 1)
    y0, x0 = np.minimum(ys.astype(int), max(0, x.shape[1] - 2)), np.minimum(xs.astype(int), max(0, x.shape[2] - 2))
    y1, x1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(x0 + 1, x.shape[2] - 1)
    fy, fx = (ys - y0).astype(np.float32)[None, :, None], (xs - x0).astype(np.float32)[None, None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x1] * fx
    low = x[:, y1][:, :, x0] * (1 - fx) + x[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def _blur(x: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(x, ((0, 0), (1, 1), (0, 0)), mode="edge")
        x = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
        p = np.pad(x, ((0, 0), (0, 0), (1, 1)), mode="edge")
        x = (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4
    return x


def _highest(x: np.ndarray, radius: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        p = np.pad(x, pad, constant_values=-np.inf)
        n, most = x.shape[axis], None
        for k in range(2 * radius + 1):
            own = p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]
            most = own.copy() if most is None else np.maximum(most, own, out=most)
        x = most
    return x


def corners(images: np.ndarray, scales=(1.0, 0.71, 0.5), apart: int = 3, least: float = 0.01):
    """For a stack of images of one size: image, x, y, scale, angle and the
    packed descriptor of each corner; x and y in pixels of the image. Patches
    that reach over the border see it go on evenly, up to half their radius."""
    found = [[] for _ in range(6)]
    yy, xx = np.mgrid[-7:8, -7:8]
    disc = yy**2 + xx**2 <= 49
    dy, dx = yy[disc], xx[disc]
    over = _RADIUS // 2
    for scale in scales:
        x = _resize(images, scale) if scale != 1 else images
        if min(x.shape[1:]) < _RADIUS + 2:
            continue
        x = np.pad(x, ((0, 0), (over, over), (over, over)), mode="edge")
        h, w = x.shape[1:]
        smooth = _blur(x, 3)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _blur(gx * gx, 3), _blur(gy * gy, 3), _blur(gx * gy, 3)
        harris = a * b - c * c - 0.05 * (a + b) ** 2
        peak = (harris == _highest(harris, apart)) & (harris > least * harris.max(axis=(1, 2), keepdims=True)) & (harris > 0.05)
        edge = _RADIUS
        peak[:, :edge] = peak[:, -edge:] = False
        peak[:, :, :edge] = peak[:, :, -edge:] = False
        i, y, z = np.nonzero(peak)
        for lo in range(0, len(i), 1_000):  # 16 KB of places each
            ii, yi, xi = i[lo : lo + 1_000], y[lo : lo + 1_000], z[lo : lo + 1_000]
            patch = smooth[ii[:, None], yi[:, None] + dy, xi[:, None] + dx]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
            turn = np.rint(angle / (2 * math.pi / _TURNS)).astype(int) % _TURNS
            at = _TURNED[turn]
            values = smooth[ii[:, None, None], yi[:, None, None] + at[:, :, :, 1], xi[:, None, None] + at[:, :, :, 0]]
            bits = np.packbits(values[:, :, 0] < values[:, :, 1], axis=1)
            for out, v in zip(found, (ii, (xi - over + 0.5) / scale, (yi - over + 0.5) / scale, np.full(len(ii), scale), angle, bits)):
                out.append(v)
    if not found[0]:
        return [np.zeros(0, int), *[np.zeros(0)] * 4, np.zeros((0, _TESTS // 8), np.uint8)]
    return [np.concatenate(x) for x in found]


# --- pairs of images ------------------------------------------------------------------------------------------------

_PLACE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f2"), ("angle", "<f2"), ("tests", "u1", _TESTS // 8)])


def pack_points(x, y, scale, angle, tests) -> bytes:
    out = np.empty(len(x), _PLACE)
    for name, v in zip(_PLACE.names, (x, y, scale, angle, tests)):
        out[name] = v
    return out.tobytes()


def unpack_points(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", _PLACE)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of ``a`` (packed) with every row of ``b``."""
    p, q = np.ascontiguousarray(a).view("<u8"), np.ascontiguousarray(b).view("<u8")
    out = np.zeros((len(p), len(q)), np.uint16)
    for k in range(p.shape[1]):
        out += np.bitwise_count(p[:, k, None] ^ q[None, :, k])
    return out


def consensus(a: np.ndarray, b: np.ndarray, near: int, shift: float, turn: float) -> tuple[int, complex, complex]:
    """How many matches of two images' points agree on one turn, scale and
    shift, and the factor and shift (of the plane of complex numbers) that send
    b's points to a's."""
    if not len(a) or not len(b):
        return 0, 1 + 0j, 0j
    d = bits_apart(a["tests"], b["tests"])
    i = np.concatenate((np.arange(len(a)), d.argmin(axis=0)))
    j = np.concatenate((d.argmin(axis=1), np.arange(len(b))))
    pairs = np.unique((i * len(b) + j)[d[i, j] <= near])
    if not pairs.size:
        return 0, 1 + 0j, 0j
    p, q = a[pairs // len(b)], b[pairs % len(b)]
    P, Q = p["x"] + 1j * p["y"].astype(float), q["x"] + 1j * q["y"].astype(float)
    angle = p["angle"].astype(float) - q["angle"].astype(float)
    size = q["scale"].astype(float) / p["scale"].astype(float)
    factor = size * np.exp(1j * angle)
    moved = P - factor * Q
    off = np.abs(factor[:, None] * Q[None] + moved[:, None] - P[None])
    bent = np.abs((angle[None] - angle[:, None] + math.pi) % (2 * math.pi) - math.pi)
    ok = (off <= shift * np.maximum(1, size)[:, None]) & (bent <= turn) & (np.abs(np.log2(size[None] / size[:, None])) < 0.6)
    # of the matches that agree, places a few pixels apart count once
    cells = (np.rint(P.real / 4) * 65536 + np.rint(P.imag / 4)).astype(np.int64)
    sums = ok.sum(axis=1)
    order = np.argsort(-sums, kind="stable")[:12]
    best, held = 0, ok[order[0]]
    for k in order.tolist():
        if sums[k] <= best:  # no more cells than matches
            break
        count = len(set(cells[ok[k]].tolist()))
        if count > best:
            best, held = count, ok[k]
    for _ in range(2):  # fit to those that agree, and look again
        x, y, x0, y0 = _centred(Q[held], P[held])
        spread = np.vdot(x, x).real
        if spread < 1e-6:
            break
        f = np.vdot(x, y) / spread
        m = y0 - f * x0
        again = np.abs(f * Q + m - P) <= shift * max(1.0, abs(f))
        count = len(set(cells[again].tolist()))
        if abs(f) < 1e-3 or count < best:
            break
        best, held = count, again
    x, y, x0, y0 = _centred(Q[held], P[held])
    f = np.vdot(x, y) / max(1e-9, np.vdot(x, x).real)
    return best, complex(f), complex(y0 - f * x0)


def _centred(x: np.ndarray, y: np.ndarray):
    """Both less their means, and these."""
    x0, y0 = np.add.reduce(x) / len(x), np.add.reduce(y) / len(y)
    return x - x0, y - y0, x0, y0


# --- tables ---------------------------------------------------------------------------------------------------------


def _digests(rows: DataFrame, id_col: str, image_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"), F.when(F.col(image_col).isNotNull(), F.unhex(F.substring(F.sha2(F.col(image_col), 256), 1, 32))).alias("key"))


def _describe(classes: DataFrame, folder: str, block: int, tasks: int) -> DataFrame:
    """id, points: the corners of each image, packed. Every ``block`` ids stand
    in a file of ``folder`` too, with their images (see :class:`_Shelf`)."""

    def some(ids, images):
        by_size: dict[tuple, list[int]] = {}
        for i, x in enumerate(images):
            if x is not None and x.size:
                by_size.setdefault(x.shape, []).append(i)
        for shape, own in by_size.items():
            step = max(1, 600_000 // (shape[0] * shape[1]))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                at, x, y, scale, angle, tests = corners(np.stack([images[i] for i in part]))
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(len(part) + 1))
                for i, k in zip(part, (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))):
                    yield i, pack_points(x[k], y[k], scale[k], angle[k], tests[k])

    def shelve(ids: list[int], data: list[bytes]):
        found = []
        for lo in range(0, len(ids), 512):
            images = [decode_image(x) for x in data[lo : lo + 512]]
            found += [(lo + i, points) for i, points in some(ids[lo : lo + 512], images)]
        found.sort(key=lambda x: x[0])
        out = [pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.large_binary()), pa.array([data[i] for i, _ in found], pa.large_binary())]
        whole = pa.RecordBatch.from_arrays(out, names=["id", "points", "image"])
        with AtomicFile(f"{folder}/{ids[0] // block}") as f, pa.ipc.new_file(f, whole.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_batch(whole)
        return pa.RecordBatch.from_arrays([out[0], out[1].cast(pa.binary())], names=["id", "points"])

    def run(stream):
        ids, data = [], []
        for batch in stream:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ids and i // block != ids[0] // block:
                    yield shelve(ids, data)
                    ids, data = [], []
                ids.append(i)
                data.append(x.as_py())
        if ids:
            yield shelve(ids, data)

    dealt = classes.select("id", "image").repartition(tasks, F.floor(F.col("id") / block)).sortWithinPartitions("id")
    return dealt.mapInArrow(tidy(run), "id long, points binary")


class _Shelf:
    """Reads points and images back, a block of ids at a time."""

    def __init__(self, folder: str, block: int, blocks: int = 2, pixels: int = 8_000_000):
        self.folder, self.block, self.blocks, self.pixels = folder, block, blocks, pixels
        self.held: dict[int, tuple] = {}
        self.smooth: dict[int, np.ndarray] = {}
        self.size = 0

    def _rows(self, i: int) -> tuple:
        k = i // self.block
        own = self.held.pop(k, None)  # the block used last stands last
        if own is None:
            if len(self.held) >= self.blocks:
                del self.held[next(iter(self.held))]
            with read_file(f"{self.folder}/{k}") as f:
                rows = pa.ipc.open_file(f).read_all()
            own = {x: n for n, x in enumerate(rows.column(0).to_pylist())}, rows.column(1), rows.column(2), {}
        self.held[k] = own
        return own

    def points(self, i: int) -> np.ndarray:
        at, points, _, met = self._rows(i)
        if i not in met:
            met[i] = unpack_points(points[at[i]].as_py())
        return met[i]

    def image(self, i: int) -> np.ndarray:
        """Grey values, smoothed."""
        if i not in self.smooth:
            at, _, images, _ = self._rows(i)
            x = smoothed(decode_image(images[at[i]].as_py()))
            while self.smooth and self.size + x.size > self.pixels:  # the oldest go
                self.size -= self.smooth.pop(next(iter(self.smooth))).size
            self.smooth[i] = x
            self.size += x.size
        return self.smooth[i]


def _corner_rows(stream, table: int, bits: int, large: tuple[np.ndarray, np.ndarray] | None = None):
    """Rows of the corners of 200 images at a time, in one table; ``stream`` has
    id and points, and kin or not."""
    draw = np.random.default_rng(11 + table)
    pick = draw.choice(_TESTS, bits + 16, replace=False)[:bits]
    for batch in stream:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            own = [unpack_points(x)["tests"] for x in part.column(1).to_pylist()]
            tests = np.concatenate(own) if own else np.zeros((0, _TESTS // 8), np.uint8)
            if not len(tests):
                continue
            times = [len(x) for x in own]
            rows = {"id": np.repeat(part.column(0).to_numpy(), times), "tests": tests}
            bucket = rows["bucket"] = np.zeros(len(tests), np.int64)
            for k, p in enumerate(pick.tolist()):
                bucket |= (tests[:, p // 8] >> (7 - p % 8) & 1).astype(np.int64) << k
            if large is not None:
                at = np.minimum(np.searchsorted(large[0], bucket), max(0, len(large[0]) - 1))
                rows["parts"] = np.where(large[0][at] == bucket, large[1][at], 1) if len(large[0]) else np.ones(len(bucket), np.int64)
                mixed = rows["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                rows["salt"] = mixed.astype(np.int64) % rows["parts"]
            if part.num_columns > 2:
                rows["kin"] = np.repeat(part.column(2).to_numpy(), times)
            yield rows


def _hashed(points: DataFrame, table: int, bits: int) -> DataFrame:
    """A row for each corner in one table: bucket, id, tests; then kin, if
    ``points`` has it."""
    kin = ["kin"] * ("kin" in points.columns)

    def run(stream):
        for rows in _corner_rows(stream, table, bits):
            n = len(rows["id"])
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_TESTS // 8), n, [None, pa.py_buffer(np.ascontiguousarray(rows["tests"]).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"]), pa.array(rows["id"]), flat.cast(pa.binary()), *[pa.array(rows[x]) for x in kin]], names=["bucket", "id", "tests", *kin])

    return points.select("id", "points", *kin).mapInArrow(tidy(run), "bucket long, id long, tests binary" + ", kin long" * len(kin))


# Rows are dealt in blocks: one row of Spark holds all rows that a task has for one key, column after column.

_CORNER = {"bucket": "<i8", "parts": "<i4", "salt": "<i4", "id": "<i8", "tests": ("u1", _TESTS // 8)}
_KIN_CORNER = {"kin": "<i8"} | _CORNER
_PAIR = {"a": "<i8", "b": "<i8", "n": "<i8"}
_AT_ONCE = 100_000  # corners that a task holds before it deals them
_PAIRS_AT_ONCE = 500_000  # and pairs


def _blocks(rows: dict[str, np.ndarray], fields: dict, by: tuple[str, str], keys: int) -> tuple[np.ndarray, list[bytes]]:
    """The keys of these rows, and the rows of each; rows with the same ``by`` have one key."""
    mixed = rows[by[0]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows[by[1]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    key = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % keys
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    made = [np.ascontiguousarray(rows[name][order], kind[0] if isinstance(kind, tuple) else kind) for name, kind in fields.items()]
    return key[cuts[:-1]], [b"".join(x[lo:hi].tobytes() for x in made) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _opened(blocks: list[bytes], fields: dict) -> dict[str, np.ndarray]:
    """The rows of some blocks."""
    kinds = {name: np.dtype(kind) for name, kind in fields.items()}
    width, out = sum(k.itemsize for k in kinds.values()), {name: [] for name in fields}
    for data in blocks:
        n, at = len(data) // width, 0
        for name, kind in kinds.items():
            out[name].append(np.frombuffer(data, kind, n, at))
            at += n * kind.itemsize
    return {name: np.concatenate(x) for name, x in out.items()}


def _runs(stream):
    """The blocks of each key of a stream in order of keys."""
    at, held = None, []
    for batch in stream:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(data.as_py())
    if held:
        yield held


def _joined(parts: list[dict]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _gathered(some, at_once: int):
    """Rows of several dicts in one, of ``at_once`` rows or more but for the last."""
    held, count = [], 0
    for rows in some:
        held.append(rows)
        count += len(next(iter(rows.values())))
        if count >= at_once:
            whole, held, count = _joined(held), [], 0
            yield whole
            del whole
    if count:
        yield _joined(held)


def _dealt(points: DataFrame, table: int, bits: int, keys: int, large: tuple[np.ndarray, np.ndarray] | None, sizes: DataFrame) -> DataFrame:
    """The corners in one table, dealt by bucket and salt, the part to which an
    image goes in a large bucket: key, and corners, or kin if ``points`` have
    it. ``large`` are these buckets in order and their numbers of parts; where it is None
    ``sizes`` are joined."""
    kin = "kin" in points.columns
    name, fields = ("kin", _KIN_CORNER) if kin else ("corners", _CORNER)

    def blocks(some):
        for rows in _gathered(some, _AT_ONCE):
            key, data = _blocks(rows, fields, ("bucket", "salt"), keys)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(data, pa.binary())], names=["key", name])

    def hashed(stream):
        yield from blocks(_corner_rows(stream, table, bits, large))

    def given(stream):
        yield from blocks({n: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, _TESTS // 8) if n == "tests" else c.to_numpy() for n, c in zip(fields, batch.columns)} for batch in stream if len(batch))

    if large is not None:
        return points.select("id", "points", *["kin"] * kin).mapInArrow(tidy(hashed), f"key long, {name} binary")
    joined = _hashed(points, table, bits).join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))
    return joined.select(*fields).mapInArrow(tidy(given), f"key long, {name} binary")


def _totals(blocks: DataFrame, over: int) -> DataFrame:
    """a, b, n: the pairs in blocks whose numbers add up to more than ``over``."""

    def run(stream):
        for held in _runs(stream):
            rows = _opened(held, _PAIR)
            a, b, n = _summed(rows["a"], rows["b"], rows["n"])
            own = n > over
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (a, b, n)], names=["a", "b", "n"])

    return blocks.select("key", "pairs").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long, n long")


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their numbers."""
    if not len(a):
        return a, b, n
    short = min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31
    order = np.argsort(a << 32 | b, kind="stable") if short else np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0)))
    return a[first], b[first], np.add.reduceat(n[order], first)


_DENSE = 24  # rows of a bucket from which on all pairs are compared at once


def _sides(group: np.ndarray):
    """For sorted groups: the places in small ones, and begin and end of each large one."""
    cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(1, int)
    sizes = np.diff(cuts)
    small = np.repeat(sizes <= _DENSE, sizes)
    large = np.flatnonzero(sizes > _DENSE)
    return np.flatnonzero(small), zip(cuts[large].tolist(), cuts[large + 1].tolist())


def _partners(ids: np.ndarray, group: np.ndarray, tests: np.ndarray, near: int):
    """For rows sorted by group, id and tests: the first and the nearest row (the
    first of these) of another image within ``near`` bits in the same group
    (-1: none)."""
    some, large = _sides(group)
    first, best = np.full(len(ids), -1), np.full(len(ids), -1)
    x, y = _few_partners(ids[some], group[some], np.ascontiguousarray(tests[some]), near)
    first[some], best[some] = (np.where(z >= 0, some[z] if len(some) else z, -1) for z in (x, y))
    for lo, hi in large:
        own = tests[lo:hi]
        step = max(1, 2_000_000 // (hi - lo))
        for at in range(lo, hi, step):
            end = min(at + step, hi)
            d = bits_apart(tests[at:end], own)
            d[ids[at:end, None] == ids[None, lo:hi]] = near + 1
            i, j = (d <= near).argmax(axis=1), d.argmin(axis=1)
            met = d[np.arange(end - at), j] <= near
            first[at:end], best[at:end] = np.where(met, lo + i, -1), np.where(met, lo + j, -1)
    return first, best


def _few_partners(ids: np.ndarray, group: np.ndarray, tests: np.ndarray, near: int):
    """The same, step by step for all groups."""
    n = len(ids)
    words = tests.view("<u8").reshape(n, _TESTS // 64)
    before, after, best, best_d = np.full(n, -1), np.full(n, -1), np.full(n, -1), np.full(n, near + 1)
    live = np.arange(n - 1)
    for s in range(1, n):
        live = live[live + s < n]
        live = live[group[live] == group[live + s]]
        if not len(live):
            break
        j = live + s
        d = np.bitwise_count(words[live] ^ words[j]).sum(axis=1).astype(np.int64)
        ok = (d <= near) & (ids[live] != ids[j])
        x, y, d = live[ok], j[ok], d[ok]
        before[y] = x  # a smaller row each time
        fresh = after[x] < 0
        after[x[fresh]] = y[fresh]
        for p, q in ((x, y), (y, x)):
            closer = (d < best_d[p]) | ((d == best_d[p]) & (q < best[p]))
            best[p[closer]], best_d[p[closer]] = q[closer], d[closer]
    return np.where(before >= 0, before, after), best


def _pairs(ids: np.ndarray, *partners: np.ndarray) -> np.ndarray:
    """Votes (a < b) of rows with these ids for these partners' (-1: none)."""
    some = [np.stack((ids[p >= 0], p[p >= 0])) for p in partners]
    return np.sort(np.concatenate(some, axis=1), axis=0)


def _block_pairs(folder: str, bucket: int, own: int, parts: int, near: int) -> np.ndarray:
    """Votes of one block's rows among those of all blocks of its bucket. An
    image's rows are in one block, so blocks differ in their ids."""

    def block(k: int):
        try:
            with read_file(f"{folder}/{bucket}-{k}") as f:
                data = f.read()
        except FileNotFoundError:  # no row was dealt to it
            return np.zeros(0, np.int64), np.zeros((0, _TESTS // 8), np.uint8)
        n = len(data) // (8 + _TESTS // 8)
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, offset=8 * n).reshape(n, -1)

    ids, tests = block(own)
    # id and place of the first and of the nearest row
    first, first_at, best, best_at, best_d = (np.full(len(ids), x) for x in (-1, -1, -1, -1, near + 1))
    for k in range(parts):
        others, their = block(k)
        if not len(others):
            continue
        step = max(1, 2_000_000 // len(others))
        for lo in range(0, len(ids), step):
            at = np.arange(lo, min(lo + step, len(ids)))
            d = bits_apart(tests[at], their)
            d[ids[at][:, None] == others[None]] = near + 1
            i, j = (d <= near).argmax(axis=1), d.argmin(axis=1)
            least = d[np.arange(len(at)), j]
            some = least <= near
            at, i, j, least = at[some], i[some], j[some], least[some]
            new = (first[at] < 0) | (others[i] < first[at])
            first[at[new]], first_at[at[new]] = others[i[new]], (k << 40) + i[new]
            new = (least < best_d[at]) | ((least == best_d[at]) & (others[j] < best[at]))
            best[at[new]], best_at[at[new]], best_d[at[new]] = others[j[new]], (k << 40) + j[new], least[new]
    return _pairs(ids, first, np.where(first_at == best_at, -1, best))


def _counted(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs a < b, and how often each stands here (either way round)."""
    if not a:
        return np.zeros((3, 0), np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    return np.stack(_summed(np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64)))


def _every(ids: np.ndarray, kin: np.ndarray, group: np.ndarray, tests: np.ndarray, near: int) -> np.ndarray:
    """a, b, n: the pairs of rows within ``near`` bits in one group, of images
    that aren't kin; rows are sorted by group."""
    small, large = _sides(group)
    words = tests.view("<u8").reshape(len(ids), _TESTS // 64)
    at, a, b = small, [], []
    for s in range(1, _DENSE):  # a small group's rows are next to each other in ``small`` too
        at = at[at + s < len(ids)]
        at = at[group[at] == group[at + s]]
        if not len(at):
            break
        some = at[kin[at] != kin[at + s]]
        some = some[np.bitwise_count(words[some] ^ words[some + s]).sum(axis=1) <= near]
        a.append(ids[some])
        b.append(ids[some + s])
    for lo, hi in large:
        own, step = tests[lo:hi], max(1, 2_000_000 // (hi - lo))
        for begin in range(lo, hi, step):
            end = min(begin + step, hi)
            i, j = np.nonzero(bits_apart(tests[begin:end], own[begin - lo :]) <= near)
            i, j = begin + i, begin + j
            some = (i < j) & (kin[i] != kin[j])
            a.append(ids[i[some]])
            b.append(ids[j[some]])
    return _counted(a, b)


def _block_every(folder: str, bucket: int, own: int, parts: int, near: int):
    """The same for one block's rows with each other and with those of the
    blocks behind it, a piece at a time."""

    def block(k: int):
        try:
            with read_file(f"{folder}/{bucket}-{k}") as f:
                data = f.read()
        except FileNotFoundError:  # no row was dealt to it
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, _TESTS // 8), np.uint8)
        n = len(data) // (16 + _TESTS // 8)
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, np.uint8, offset=16 * n).reshape(n, -1)

    ids, kin, tests = block(own)
    for k in range(own, parts):
        others, their_kin, their = block(k)
        step = max(1, 2_000_000 // max(1, len(others)))
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            ok = (bits_apart(tests[lo:hi], their) <= near) & (kin[lo:hi, None] != their_kin[None])
            if k == own:
                ok &= np.arange(lo, hi)[:, None] < np.arange(len(others))[None]
            i, j = np.nonzero(ok)
            yield _counted([ids[lo + i]], [others[j]])


def _votes(rows: DataFrame, near: int, folder: str) -> DataFrame:
    """Votes (key, pairs: a < b, images, and their number; parts 0) of the
    dealt corners of each bucket in one part. Of other buckets each part is written to
    ``folder`` and stands as a row of its own: bucket, part, parts. If rows have
    kin, every pair of corners whose images aren't kin counts (see :func:`_every`)."""
    every = "kin" in rows.columns
    fields, keys = (_KIN_CORNER, 4 * rows._keys) if every else (_CORNER, rows._keys)

    def met(held: list[bytes], marks: list):
        own = _opened(held, fields)
        order = np.lexsort((own["salt"], own["bucket"]) if every else (*np.ascontiguousarray(own["tests"]).view(">u8").T[::-1], own["id"], own["salt"], own["bucket"]))
        own = {k: v[order] for k, v in own.items()}
        group = np.cumsum((np.diff(own["bucket"], prepend=-1) != 0) | (np.diff(own["salt"], prepend=-1) != 0))
        whole = own["parts"] == 1
        at = np.flatnonzero(~whole)
        cuts = np.flatnonzero(np.diff(group[at], prepend=-1, append=-1)) if len(at) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mark = tuple(int(own[name][at[lo]]) for name in ("bucket", "salt", "parts"))
            with AtomicFile(f"{folder}/{mark[0]}-{mark[1]}") as f:
                f.write(b"".join(own[name][at[lo:hi]].astype("<i8").tobytes() for name in ["id"] + ["kin"] * every) + own["tests"][at[lo:hi]].tobytes())
            marks.append(mark)
        ids, tests = own["id"][whole], np.ascontiguousarray(own["tests"][whole])
        if every:
            return dict(zip(_PAIR, _every(ids, own["kin"][whole], group[whole], tests, near)))
        first, best = _partners(ids, group[whole], tests, near)
        given = lambda p: np.where(p >= 0, ids[p], -1) if len(ids) else p
        return dict(zip(_PAIR, _counted(*([x] for x in _pairs(ids, given(first), given(np.where(best == first, -1, best)))))))

    def run(stream):
        marks: list[tuple] = []
        for pairs in _gathered((met(held, marks) for held in _runs(stream)), _PAIRS_AT_ONCE):
            yield _shown(pairs, keys)
        if marks:
            none = pa.nulls(len(marks))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), *[pa.array(x, pa.int64()) for x in zip(*marks)]], names=_VOTES)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "key long, pairs binary, bucket long, part long, parts long")


_VOTES = ["key", "pairs", "bucket", "part", "parts"]


def _shown(pairs: dict[str, np.ndarray], keys: int) -> pa.RecordBatch:
    """Counted pairs as rows of :func:`_votes`."""
    pairs = dict(zip(_PAIR, _summed(*(pairs[x] for x in _PAIR))))
    key, data = _blocks(pairs, _PAIR, ("a", "b"), keys)
    zero = pa.array(np.zeros(len(key), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(data, pa.binary()), zero, zero, zero], names=_VOTES)


def _met(votes: DataFrame, near: int, folder: str, every: bool, keys: int) -> DataFrame:
    """The votes (key, pairs), with those of the parts that stand among them."""
    keys = 4 * keys if every else keys

    def found(batch):
        for mark in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            if mark[2]:
                for pairs in _block_every(folder, *mark, near) if every else [_counted(*([x] for x in _block_pairs(folder, *mark, near)))]:
                    if pairs.shape[1]:
                        yield dict(zip(_PAIR, pairs))

    def run(stream):
        for batch in stream:
            yield batch.filter(pa.array(batch.column(4).to_numpy() == 0)).select(["key", "pairs"])
            for pairs in _gathered(found(batch), _PAIRS_AT_ONCE):
                yield _shown(pairs, keys).select(["key", "pairs"])

    return votes.select(*_VOTES).mapInArrow(tidy(run), "key long, pairs binary")


def _large(points: DataFrame, tables: range, bits: int, part: int, keys: int) -> DataFrame:
    """table, bucket, parts: buckets of more than ``part`` corners and their
    numbers of parts."""

    def some(stream):
        """Batches in lists of 8 MB."""
        held, size = [], 0
        for batch in stream:
            held.append(batch)
            size += batch.nbytes
            if size >= 8_000_000:
                yield held
                held, size = [], 0
        if held:
            yield held

    def counted(batches):
        for own in some(batches):
            for t in tables:
                if buckets := [rows["bucket"] for rows in _corner_rows(own, t, bits)]:
                    b, n = np.unique(np.concatenate(buckets), return_counts=True)
                    yield {"a": np.full(len(b), t), "b": b, "n": n}

    def run(stream):
        for rows in _gathered(counted(stream), _PAIRS_AT_ONCE):
            yield _shown(rows, keys).select(["key", "pairs"])

    found = _totals(points.select("id", "points").mapInArrow(tidy(run), "key long, pairs binary"), part)
    return materialise(found.select(F.col("a").alias("table"), F.col("b").alias("bucket"), F.ceil(F.col("n") / part).cast("long").alias("parts")), "image-large")


def _keys(points: DataFrame) -> int:
    """So many blocks that each has about 20,000 corners."""
    size = points.agg(F.sum(F.length("points"))).first()[0] or 0
    return max(1, size // (20_000 * _PLACE.itemsize))


def _table_votes(points: DataFrame, table: int, bits: int, near: int, part: int, listed: int = 100_000, sizes: DataFrame | None = None, keys: int | None = None) -> DataFrame:
    """a, b, n: pairs of images with two votes or more in one table. Every corner
    votes for the first and for the nearest one of its bucket; the corners of
    more than ``part`` are compared a part with a part, with the same votes. Up
    to ``listed`` large buckets are known where corners are hashed, more are joined.
    If ``points`` have kin, every pair of corners whose images aren't kin counts
    instead, once. ``sizes`` and ``keys`` are those of :func:`_large` and
    :func:`_keys`, where they are known."""
    keys = keys or _keys(points)
    all_sizes = _large(points, range(table, table + 1), bits, part, keys) if sizes is None else sizes
    own = all_sizes.filter(F.col("table") == table).select("bucket", "parts")
    large = None
    if own.count() <= listed:  # 16 bytes a row
        known = own.orderBy("bucket").toArrow()
        large = tuple(known.column(k).to_numpy() for k in (0, 1))
    dealt = _dealt(points, table, bits, keys, large, own)
    dealt._keys = keys
    folder = shared_dir(points.sparkSession, "image-blocks")
    first = materialise(_votes(dealt, near, folder), "image-parts")
    out = materialise(_totals(_met(first, near, folder, "kin" in points.columns, keys), 1), "image-votes")
    discard(first, *[all_sizes] * (sizes is None))
    discard_dir(folder)
    return out


@lru_cache(16)
def _middles(shape: tuple[int, int]) -> np.ndarray:
    """The middle of each pixel as a complex number."""
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return xx + 0.5 + 1j * (yy + 0.5)


def smoothed(image: np.ndarray) -> np.ndarray:
    return _blur(image[None].astype(np.float32), 2)[0]


def overlay(a: np.ndarray, b: np.ndarray, factor: complex, moved: complex, least: float = 0.3, smooth: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Correlation of the pixels of a with those of b that ``factor`` and
    ``moved`` send there; 0 where these are fewer than a ``least`` share of the
    smaller image, or 256, or where one is plain. ``smooth`` are both images
    smoothed, where these are known."""
    if abs(factor) < 1e-6:
        return 0.0
    back = (_middles(a.shape) - moved) / factor
    x, y = np.floor(back.real).astype(int), np.floor(back.imag).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < b.shape[1]) & (y < b.shape[0])
    if ok.sum() < max(256, least * min(a.size, b.size * abs(factor) ** 2)):
        return 0.0
    p, q = smooth or (smoothed(a), smoothed(b))
    p, q = p[ok], q.ravel()[(y * b.shape[1] + x)[ok]]
    p, q = p - p.mean(), q - q.mean()
    size = math.sqrt(float(p @ p) * float(q @ q))
    return float(p @ q) / size if size > 1e-6 else 0.0


def _compared(pairs: DataFrame, folder: str, block: int, reach: int, inliers: int, shift: float, turn: float, sure: int, alike: float) -> DataFrame:
    """Pairs (a, b, inliers) of images whose corners agree and whose pixels
    correlate; with ``sure`` inliers half of ``alike`` will do. Pairs are dealt by
    the blocks of both, which are read where they are compared."""

    def run(stream):
        shelf = _Shelf(folder, block)
        for batch in stream:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, factor, moved = consensus(shelf.points(a), shelf.points(b), reach, shift, turn)
                if n >= inliers:
                    p, q = shelf.image(a), shelf.image(b)
                    if overlay(p, q, factor, moved, smooth=(p, q)) >= (alike if n < sure else alike / 2):
                        rows.append((a, b, n))
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("a", "b", "inliers"))})

    sides = [F.floor(F.col(x) / block) for x in "ab"]
    tasks = max(1, min(10_000, pairs.count() // 2000))
    return pairs.select("a", "b").repartition(tasks, *sides).sortWithinPartitions(*sides, "a", "b").mapInArrow(tidy(run), "a long, b long, inliers long")


def _wanted(points: DataFrame, tables: range, bits: int, near: int, part: int, votes: int, sizes: DataFrame, keys: int) -> DataFrame:
    """a, b, n: pairs of images with enough votes over all tables."""
    found = [_table_votes(points, t, bits, near, part, sizes=sizes, keys=keys) for t in tables]
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    out = materialise(both.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= votes), "image-pairs")
    discard(*found)
    return out


def _bound(wanted: DataFrame, limits: tuple, before: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, inliers) of those wanted that are bound: for each image the
    strongest pair and that with the smallest image, a group's middle; then what
    these, and the pairs bound ``before``, leave open. ``limits`` are those of :func:`_compared`."""
    sides = wanted.select(F.col("a").alias("id"), F.col("b").alias("other"), "n", "a", "b").union(wanted.select("b", "a", "n", "a", "b"))
    pair = F.struct("a", "b")
    picked = sides.groupBy("id").agg(F.array(F.max_by(pair, F.struct("n", -F.col("a"), -F.col("b"))), F.min_by(pair, "other")).alias("p"))
    top = materialise(picked.select(F.inline("p")).distinct(), "image-top")
    bound = materialise(_compared(top, *limits), "image-bound")
    groups = materialise(components(bound if before is None else bound.union(before), "a", "b"), "image-groups")
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(c + "g"))
    rest = materialise(wanted.join(top, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").filter("not coalesce(ag = bg, false)").select("a", "b"), "image-rest")
    out = bound.union(materialise(_compared(rest, *limits), "image-bound"))
    discard(top, groups, rest)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, which were written, with ids of monotonically_increasing_id
    made dense, so that two go into one number."""
    counts = sorted(rows.groupBy(F.shiftright("id", 33).alias("p")).count().collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in counts])))
    table = rows.sparkSession.createDataFrame([(p, int(x)) for (p, _), x in zip(counts, before)], "p long, start long")
    dense = rows.withColumn("p", F.shiftright("id", 33)).join(F.broadcast(table), "p")
    return dense.withColumn("id", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("p", "start")


def image_copies(rows: DataFrame, id_col: str = "image_id", image_col: str = "image", tables: int = 8, bits: int = 20, near: int = 44, votes: int = 4, reach: int = 64, inliers: int = 4, shift: float = 4.0, turn: float = 0.6, part: int = 2000, sure: int = 20, alike: float = 0.75) -> DataFrame:
    """One row per row of ``rows``: image_id, copies (rows with equal bytes,
    itself included), n_bound (pairs of its class in which it was bound),
    inliers (the most of these), class_id (the smallest id of its group), kept.

    ``near`` bits make a vote and ``reach`` bits a match; ``votes`` is what a
    pair of images needs over all tables to be compared."""
    with small_batches(rows.sparkSession):
        return _copies(_digests(rows, id_col, image_col), tables, bits, near, votes, reach, inliers, shift, turn, part, sure, alike)


def _copies(known: DataFrame, tables: int, bits: int, near: int, votes: int, reach: int, inliers: int, shift: float, turn: float, part: int, sure: int, alike: float) -> DataFrame:
    """:func:`image_copies` of digests. What is left to compute when it returns
    has no Python in it."""
    spark = known.sparkSession
    ids = materialise(known.select("id", "key"), "image-ids")
    once = known.filter("key is not null").groupBy("key").agg(F.first("image").alias("image"), F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = _numbered(materialise(once.withColumn("id", F.monotonically_increasing_id()), "image-classes"))
    n, size = classes.agg(F.count("*"), F.sum(F.length("image"))).first()
    block = int(min(512, max(1, 16_000_000 * n // max(1, size or 0))))
    folder = shared_dir(spark, "image-shelf")
    points = materialise(_describe(classes, folder, block, max(1, min(10_000, -(-n // block)))), "image-points")
    keys = _keys(points)
    sizes = _large(points, range(tables), bits, part, keys)
    limits = (folder, block, reach, inliers, shift, turn, sure, alike)
    search = (range(tables), bits, near, part, votes, sizes, keys)
    wanted = _wanted(points, *search)
    pairs = _bound(wanted, limits)
    # what the two votes of a corner left out, of images that are not in one class
    groups = materialise(components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("g")), "image-groups")
    kin = materialise(points.join(groups, "id", "left").select("id", "points", F.coalesce("g", "id").alias("kin")), "image-kin")
    discard(points)
    missed = _wanted(kin, *search)
    discard(kin, sizes)
    missed = materialise(missed.join(wanted, ["a", "b"], "left_anti"), "image-missed")
    if missed.limit(1).count():
        pairs = pairs.union(_bound(missed, limits, before=pairs))
    discard_dir(folder)
    groups = components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("g"))
    most = pairs.select(F.col("a").alias("id"), "inliers").union(pairs.select("b", "inliers")).groupBy("id").agg(F.count("*").alias("n_bound"), F.max("inliers").alias("inliers"))
    graph = classes.select("id", "key", "first", "copies").join(groups, "id", "left").join(most, "id", "left").withColumn("g", F.coalesce("g", "id"))
    heads = graph.groupBy("g").agg(F.min("first").alias("class_id"))
    table = graph.join(heads, "g").select("key", "copies", F.coalesce("n_bound", F.lit(0)).alias("n_bound"), F.coalesce("inliers", F.lit(0)).alias("inliers"), "class_id")
    alone = ids.filter("key is null").select(F.col("id").alias("image_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_bound"), F.lit(0).cast("long").alias("inliers"), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    some = ids.filter("key is not null").join(table, "key")
    return some.select(F.col("id").alias("image_id"), F.col("copies").cast("long").alias("copies"), F.col("n_bound").cast("long").alias("n_bound"), F.col("inliers").cast("long").alias("inliers"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept")).union(alone)


def render_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 8, gain: float = 400.0) -> DataFrame:
    """image_id, image: each vector as a square of grey cells, as PGM. Stands in
    for a media column where a table has none. Null vectors give null images;
    null and non-finite components are black."""

    def draw(v) -> bytes | None:
        if v is None or not len(v):
            return None
        x = np.nan_to_num(np.array([np.nan if y is None else y for y in v], float), nan=-1.0, posinf=-1.0, neginf=-1.0)
        side = math.ceil(math.sqrt(len(x)))
        grid = np.zeros(side * side)
        grid[: len(x)] = x
        return encode_pgm(np.pad(np.kron(128 + gain * grid.reshape(side, side), np.ones((cell, cell))), cell, mode="edge"))

    def run(stream):
        for batch in stream:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([draw(v) for v in part.column(1).to_pylist()], pa.binary())], names=["image_id", "image"])

    return rows.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).alias("v")).mapInArrow(tidy(run), "image_id long, image binary")
