"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized and hashed, and written as NPY tiles.

Decoding is written out here for Netpbm (P1 to P6; two-byte samples are scaled to one) and uncompressed BMP (1, 4 and 8 bits
with palette, 24 and 32 bits); BMP of 16 bits or with RLE is not read. resize() averages over exact areas by an integral image, so every sample of the source counts by the share of it
that a target sample covers. The difference hash compares neighbours of a 9 x 8 thumbnail.

For texts: the UTF-8 bytes, with bytes 0 appended up to a positive multiple of 64, are the samples of a grey image of width
64. An image of up to NETPBM_ROWS rows is stored as Netpbm (P5), a taller one as BMP. The images and their NPY tiles are
written as binary columns of a Parquet table, and every digest is of what is read back from there.

Defined results: a null text is the empty one (64 bytes 0). Equal texts get equal values. An image that can't be
decoded raises ValueError (whatever its bytes are); decode_column and write_tiles give null for it. An added column whose name is taken
has an underscore put after it.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_fields, map_arrow, materialize, open_folder, scratch_path, text_buffer

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


# ------------------------------------------------------------------ formats


def encode_netpbm(a: np.ndarray) -> bytes:
    """P5 of a (height, width) array of uint8, P6 of (height, width, 3)."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, a.shape[1], a.shape[0]) + a.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[:2], 2, []
    n_head = 2 if kind in (b"P1", b"P4") else 3
    while len(head) < n_head:
        m = _TOKEN.match(raw, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if n_head == 3 else 1
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maximum")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if not w or not h or w * h * depth > 8 * len(raw):  # the densest format has 8 samples a byte
        raise ValueError("no samples, or fewer than the header says")
    if kind in (b"P2", b"P3"):
        words = raw[at:].split()[: w * h * depth]
        if not all(x.isdigit() and len(x) < 10 for x in words):
            raise ValueError("bad sample")
        flat = np.array(words, np.int64)
    elif kind == b"P1":
        flat = 1 - np.array([c - 48 for c in raw[at:] if c in b"01"][: w * h], np.uint16)
    elif kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    elif kind in (b"P5", b"P6"):
        kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(raw) < at + 1 + w * h * depth * kind_of.itemsize:
            raise ValueError("short image")
        flat = np.frombuffer(raw, kind_of, w * h * depth, at + 1)
    else:
        raise ValueError("no Netpbm image")
    if flat.size != w * h * depth:
        raise ValueError("short image")
    if flat.size and int(flat.max()) > top:
        raise ValueError("a sample is over the maximum")
    if top != 255:
        flat = (flat.astype(np.uint32) * 255 + top // 2) // top
    return flat.astype(np.uint8, copy=False).reshape((h, w, 3) if depth == 3 else (h, w))


def encode_bmp(a: np.ndarray) -> bytes:
    """An 8-bit grey or 24-bit BMP, rows from the bottom."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    pad = -(w * (1 if grey else 3)) % 4
    rows = (a if grey else a[:, :, ::-1]).reshape(h, -1)[::-1]
    body = np.pad(rows, ((0, 0), (0, pad))).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = b"BM" + (start + len(body)).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little")
    info = b"".join(x.to_bytes(n, "little") for x, n in ((40, 4), (w, 4), (h, 4), (1, 2), (8 if grey else 24, 2), (0, 4), (len(body), 4), (2835, 4), (2835, 4), (256 if grey else 0, 4), (0, 4)))
    return head + info + palette + body


def decode_bmp(raw: bytes) -> np.ndarray:
    def num(at: int, n: int, signed: bool = False) -> int:
        return int.from_bytes(raw[at : at + n], "little", signed=signed)

    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("no BMP image")
    start, size, w, h, depth = num(10, 4), num(14, 4), num(18, 4, True), num(22, 4, True), num(28, 2)
    if num(30, 4) not in (0, 3) or depth not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("unsupported BMP image")
    stride = (w * depth + 31) // 32 * 4
    if len(raw) < start + stride * abs(h):
        raise ValueError("short image")
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : (w * depth + 7) // 8]
    if h > 0:
        rows = rows[::-1]
    if depth < 8:  # the leftmost sample is in the highest bits
        rows = np.unpackbits(rows, axis=1) if depth == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)
        rows = rows[:, :w]
    if depth <= 8:
        colours = num(46, 4) or 1 << depth
        if colours > 256 or len(raw) < 14 + size + 4 * colours:
            raise ValueError("bad palette")
        table = np.zeros((256, 4), np.uint8)
        table[:colours] = np.frombuffer(raw, np.uint8, colours * 4, 14 + size).reshape(-1, 4)
        out = table[rows][:, :, 2::-1]
        return np.ascontiguousarray(out[:, :, 0] if (out == out[:, :, :1]).all() else out)
    return np.ascontiguousarray(rows.reshape(abs(h), w, depth // 8)[:, :, 2::-1])


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


# ------------------------------------------------------------------ features


def _edges(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 cuts of n samples into k equal parts: whole samples before each, and the share of the next."""
    at = np.arange(k + 1) * n
    return at // k, (at % k) / k


def _integrate(a: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of a's rows over k equal parts of its first axis, by its running sum."""
    run = np.zeros((a.shape[0] + 1, *a.shape[1:]), np.float64 if a.dtype.kind == "f" else np.int64)
    np.cumsum(a, axis=0, out=run[1:])
    whole, share = _edges(a.shape[0], k)
    nxt = run[np.minimum(whole + 1, a.shape[0])]
    cuts = run[whole] + share.reshape(-1, *[1] * (a.ndim - 1)) * (nxt - run[whole])
    return np.diff(cuts, axis=0)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each of height x width equal areas, as uint8. The integral image is taken an axis at a time."""
    rows = _integrate(a, height)
    both = _integrate(np.swapaxes(rows, 0, 1), width)
    mean = np.swapaxes(both, 0, 1) * (height * width / (a.shape[0] * a.shape[1]))
    return np.floor(mean + 0.5 + 1e-9).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else ((a.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(2) // 1000).astype(np.uint8)


def difference_hash(a: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 8 thumbnail samples is darker than its right neighbour."""
    t = resize(grey(a), 8, 9)
    return np.packbits(t[:, :-1] < t[:, 1:]).tobytes().hex()


def npy_tile(a: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, resize(a, height, width), allow_pickle=False)
    return out.getvalue()


# ------------------------------------------------------------------ columns

DECODED = "height int, width int, channels int, dhash string, tile binary"


def decode_column(df: DataFrame, image_col: str, keep: list[str], height: int = 16, width: int = 16) -> DataFrame:
    """Size, difference hash and NPY tile of each image of a binary column; nulls where there is no readable image."""
    held = df.select(*[F.col(c) for c in keep], F.col(image_col).alias("__image"))
    schema = added_fields(DECODED, held.drop("__image").schema)

    def features(raw):
        try:
            a = decode(raw)
        except (ValueError, TypeError, ArithmeticError):
            return None, None, None, None, None
        return a.shape[0], a.shape[1], 1 if a.ndim == 2 else 3, difference_hash(a), npy_tile(a, height, width)

    def run(batches):
        for b in batches:
            cols = list(zip(*map(features, b.column(b.num_columns - 1).to_pylist()))) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    return map_arrow(held, run, schema)


#: Tiles of an NPY file at most.
TILES = 4096


def write_tiles(df: DataFrame, image_col: str, id_col: str, path: str | None = None, height: int = 16, width: int = 16) -> tuple[DataFrame, str]:
    """Write each image's tile into NPY files of up to TILES tiles of one kind (grey: n x height x width, colour: one more
    axis). Returns (a row per row of df: the id, the file's name and the tile's place in it, nulls where there is no
    readable image; the folder). A file is renamed to its name once it is whole, so a task that runs again replaces it."""
    path = path or scratch_path(df.sparkSession, "tiles")
    held = df.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))

    def run(batches):
        fs, root = open_folder(path)
        part, number, ids, kept = TaskContext.get().partitionId(), 0, [], []

        def put():
            """The files of the tiles in hand, one a kind, and their rows."""
            nonlocal number, ids, kept
            fs.create_dir(root, recursive=True)
            file, place = [None] * len(ids), [None] * len(ids)
            for axes, kind in ((2, "grey"), (3, "colour")):
                at = [i for i, t in enumerate(kept) if t is not None and t.ndim == axes]
                if at:
                    name, own = f"tiles-{part:06d}-{number:06d}-{kind}.npy", f"{root}/_{uuid.uuid4().hex}"
                    out = io.BytesIO()
                    np.save(out, np.stack([kept[i] for i in at]), allow_pickle=False)
                    with fs.open_output_stream(own) as f:
                        f.write(out.getvalue())
                    fs.move(own, f"{root}/{name}")
                    for k, i in enumerate(at):
                        file[i], place[i] = name, k
            row = pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(file, pa.string()), pa.array(place, pa.int32())], names=["id", "file", "place"])
            number, ids, kept = number + 1, [], []
            return row

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    kept.append(resize(decode(raw.as_py()), height, width))
                except (ValueError, TypeError, ArithmeticError):
                    kept.append(None)
                ids.append(key)
                if len(ids) == TILES:
                    yield put()
        if ids:
            yield put()

    return materialize(map_arrow(held, run, held.select("id").schema.add("file", "string").add("place", "integer")), "tile-manifest"), path


#: Rows of the tallest text image that is stored as Netpbm.
NETPBM_ROWS = 64


def text_media(raw: bytes) -> bytes:
    """The image whose samples are raw and the bytes 0 that make it a positive multiple of WIDTH."""
    padded = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
    image = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return encode_netpbm(image) if len(image) <= NETPBM_ROWS else encode_bmp(image)


STORED = "n_bytes long, media binary, tile binary"
TEXT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` with each text's length, image and NPY tile (STORED), written as a table and read from it."""
    held = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = added_fields(STORED, held.drop("__text").schema)

    def run(batches):
        kinds = (pa.int64(), pa.binary(), pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                buf, offs, _ = text_buffer(b.column(b.num_columns - 1))
                rows = []
                for i, j in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    media = text_media(buf[i:j].tobytes())
                    rows.append((j - i, media, npy_tile(decode(media))))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=schema.names)

    return materialize(map_arrow(held, run, schema), "text-media")


def media_digest(media: bytes, tile: bytes) -> tuple:
    """The digests of a stored image and of its stored tile."""
    image = decode(media)
    payload = image.tobytes()
    small = np.load(io.BytesIO(tile), allow_pickle=False)
    seen = f"{difference_hash(image)}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), seen


def text_columns(docs: DataFrame, keep: list[str], text_col: str = "text", with_media: bool = False) -> DataFrame:
    """The columns of `keep` with the digests of each text's stored image and tile (TEXT), and with_media these themselves."""
    stored = store_texts(docs, keep, text_col)
    own = stored.columns[: len(keep)]
    n_bytes, media, tile = stored.columns[len(keep) :]
    held = stored.select(*own, n_bytes, media, tile)
    schema = added_fields(TEXT + (", media binary, tile binary" if with_media else ""), held.select(*own).schema)

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                first = b.num_columns - 3
                rows = [media_digest(m.as_py(), t.as_py()) for m, t in zip(b.column(first + 1), b.column(first + 2))]
                columns = [*b.columns[: first + 1], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]]
                yield pa.RecordBatch.from_arrays(columns + b.columns[first + 1 :] * with_media, names=schema.names)

    return map_arrow(held, run, schema)
