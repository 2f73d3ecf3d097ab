"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized NPY tiles and difference hashes.

Pixels are uint8 arrays, (height, width) for grey and (height, width, 3) for colour. Netpbm is read in its plain and
raw forms P1 to P6 with up to 8 bits a sample (maxval up to 255, samples kept as they are stored), BMP uncompressed with 8 (palette), 24 or 32
bits. Resizing is by exact area: an integral image, read between pixels by linear interpolation, gives the sum over
any rectangle, so every source pixel counts by the part of it that a target pixel covers. The integral image is worked out in
strips of rows. Tiles are NPY files of float32 means; the difference hash compares neighbours in a tile of 8 rows of 9 and
is 16 hexadecimal digits.

Broken or unsupported bytes and nulls give null pixels, tile and hash; nothing is dropped. Rows are independent of
each other, so repeated rows give repeated results; an empty table gives an empty one. Columns beside those named
pass through `decoded` unless they have a name of its results.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, pieces

WIDTH = 64
TILE = (8, 9)
STRIP = 4096
BRIGHTER = 1e-3  # beyond the rounding of float32


def _header(raw: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header and where the samples begin; comments are skipped."""
    out, i = [], 2
    while len(out) < fields:
        while raw[i : i + 1].isspace() or raw[i : i + 1] == b"#":
            i = raw.index(b"\n", i) if raw[i : i + 1] == b"#" else i + 1
        j = i
        while raw[j : j + 1].isdigit():
            j += 1
        out.append(int(raw[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    kind = int(raw[1:2])
    (w, h, *most), at = _header(raw, 2 if kind in (1, 4) else 3)
    if not (0 < w and 0 < h and kind in range(1, 7)) or (most and not 0 < most[0] < 256):
        raise ValueError("unsupported")
    depth = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, h * (-(-w // 8)), at).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits) * np.uint8(255)
    if kind == 1:
        digits = np.frombuffer(bytes(c for c in raw[at - 1 :] if c in b"01"), np.uint8)[: w * h] - 48
        return ((1 - digits) * np.uint8(255)).reshape(h, w)
    if kind < 4:
        flat = np.array(raw[at - 1 :].split()[: w * h * depth], np.uint8)
    else:
        flat = np.frombuffer(raw, np.uint8, w * h * depth, at)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(raw: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", raw, 10)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or w <= 0 or not h or bits not in (8, 24, 32):
        raise ValueError("unsupported")
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.frombuffer(raw, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        colour = palette[rows]
        return colour[..., 0] if (palette[:, :1] == palette).all() else colour
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1]


def decode(raw: bytes | None) -> np.ndarray | None:
    try:
        if raw is None:
            return None
        return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw) if raw[:1] == b"P" else None
    except (ValueError, IndexError, struct.error, OverflowError):
        return None


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey, 8 bits, bottom row first."""
    h, w = pixels.shape
    line = (w + 3) // 4 * 4
    body = np.zeros((h, line), np.uint8)
    body[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + body.size, 0, 0, 1078, 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels @ np.array([299, 587, 114])) / 1000


def _cuts(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (n / parts)
    low = np.minimum(at.astype(np.int64), n - 1)
    return low, at - low


def _integral_rows(pixels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the integral image (row i sums what lies above i), worked out in strips, so that a tall picture isn't held as floats."""
    h, w = pixels.shape
    out, carry = np.zeros((len(wanted), w + 1)), np.zeros(w + 1)
    for top in range(0, h, STRIP):
        part = np.zeros((min(STRIP, h - top) + 1, w + 1))
        np.cumsum(np.cumsum(pixels[top : top + STRIP], 0, dtype=np.float64), 1, out=part[1:, 1:])
        part += carry
        inside = (wanted >= top) & (wanted <= top + len(part) - 1)
        out[inside] = part[wanted[inside] - top]
        carry = part[-1]
    return out


def area_resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target pixel covers, float64."""
    h, w = pixels.shape
    (y, fy), (x, fx) = _cuts(h, height), _cuts(w, width)
    rows = _integral_rows(pixels, y) * (1 - fy)[:, None] + _integral_rows(pixels, y + 1) * fy[:, None]
    at = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / ((h / height) * (w / width))


def tile_of(pixels: np.ndarray, size: tuple[int, int] = TILE) -> np.ndarray:
    return area_resized(grey(pixels), *size).astype(np.float32)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(small: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row of a tile: whether the right one is brighter."""
    return np.packbits((np.diff(small, axis=1) > BRIGHTER).ravel()).tobytes().hex()


def text_image(raw: bytes) -> bytes:
    """UTF-8 bytes, filled with zeros to rows of 64, as a grey picture."""
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * WIDTH, b"\0")


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media: each text's bytes stored without loss as the samples of a grey picture."""
    rest = [c for c in docs.columns if c not in {"media", "n_bytes"}]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at = b.num_columns - 1
            yield b.set_column(at, b.schema.field(at), pa.array((text_image(x) for x in b.column(at).to_pylist()), b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def decoded(rows: DataFrame, media: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """rows with height, width, channels, pixels (samples row by row), tile (NPY bytes) and dhash, all read from the stored bytes."""
    own = {"height": "int", "width": "int", "channels": "int", "pixels": "binary", "tile": "binary", "dhash": "string"}
    same = tile == TILE
    rest = [c for c in rows.columns if c not in own]
    rows = rows.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
        for b in pieces(batches):
            got = []
            for raw in b.column(at).to_pylist():
                p = decode(raw)
                if p is None:
                    got.append((None,) * 6)
                    continue
                small = tile_of(p, tile)
                got.append((p.shape[0], p.shape[1], 3 if p.ndim == 3 else 1, p.tobytes(), npy(small), difference_hash(small if same else tile_of(p))))
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*rest, *own])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{k} {t}" for k, t in own.items())]))


def tile_hashes(rows: DataFrame, tile: str = "tile") -> DataFrame:
    """rows with tile_hash: the difference hash of stored NPY tiles of 8 rows of 9; null for null, broken and other tiles."""
    rest = [c for c in rows.columns if c != "tile_hash"]
    rows = rows.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(tile)

    def hashed(raw: bytes | None) -> str | None:
        try:
            array = None if raw is None else np.load(io.BytesIO(raw), allow_pickle=False)
        except (ValueError, EOFError):
            return None
        return None if array is None or array.shape != TILE else difference_hash(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(hashed, b.column(at).to_pylist()), pa.string())], names=[*rest, "tile_hash"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "tile_hash string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a picture in the shared folder and read back; its tile written as NPY and read back for the feature."""
    stored = kept(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"), "media")
    pixels = F.col("pixels")
    tiles = decoded(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length(pixels).cast("long").alias("payload_bytes"),
        F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "tile",
    )
    return tile_hashes(kept(tiles, "tiles")).drop("tile").withColumnRenamed("tile_hash", "feature")


#: The CRC is folded bit by bit over the last 64 bytes; the feature sums bytes by the part of each tile pixel that they cover.
ORACLE = f"""
    WITH t AS (SELECT row_number() OVER () r, doc_id, encode(coalesce(text, '')) b FROM documents),
    d AS (SELECT *, octet_length(b)::bigint n, greatest(1, (octet_length(b) + {WIDTH - 1}) // {WIDTH})::bigint h FROM t),
    x AS (SELECT *, regexp_extract_all(hex(b) || repeat('00', (h * {WIDTH} - n)::int), '..') q FROM d),
    p AS (SELECT *, from_hex(array_to_string(q, '')) payload FROM x),
    m AS (SELECT *, from_hex(hex(encode('P5' || chr(10) || '{WIDTH} ' || h || chr(10) || '255' || chr(10))) || array_to_string(q, '')) media FROM p),
    z AS (SELECT r, list_transform(q, lambda y: ('0x' || y)::int) v FROM x),
    c AS (SELECT r, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(v[-{WIDTH}:], lambda y: [y::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, y: xor(xor(a, y) >> 1, 3988292384 * (xor(a, y) & 1))), 4294967295) AS crc FROM z),
    w AS (SELECT g.i AS col, j.i AS part, least(g.i + 1, (j.i + 1) * {WIDTH} / {float(TILE[1])}) - greatest(g.i, j.i * {WIDTH} / {float(TILE[1])}) AS cover FROM range({WIDTH}) g(i), range({TILE[1]}) j(i)),
    u AS (SELECT r, (i - 1) // {WIDTH} AS line, (i - 1) % {WIDTH} AS col, y FROM (SELECT r, unnest(v) y, generate_subscripts(v, 1) i FROM z)),
    s AS (SELECT r, line, part, sum(y * cover)::double AS total FROM u JOIN w USING (col) WHERE cover > 0 GROUP BY ALL),
    e AS (SELECT r, k.i AS row_, part, sum(total * (least(line + 1, (k.i + 1) * h / {float(TILE[0])}) - greatest(line, k.i * h / {float(TILE[0])})))::double / (h / {float(TILE[0])} * ({WIDTH} / {float(TILE[1])})) AS mean
        FROM s JOIN d USING (r), range({TILE[0]}) k(i) WHERE least(line + 1, (k.i + 1) * h / {float(TILE[0])}) > greatest(line, k.i * h / {float(TILE[0])}) GROUP BY r, h, row_, part),
    f AS (SELECT r, row_, part, mean::float - lag(mean::float) OVER (PARTITION BY r, row_ ORDER BY part) > {BRIGHTER} AS brighter FROM e),
    g AS (SELECT r, string_agg(o, '' ORDER BY row_) feature FROM (SELECT r, row_, lower(printf('%02x', sum(CASE WHEN brighter THEN 1 << ({TILE[1] - 1} - part)::int ELSE 0 END)::int)) o FROM f WHERE part > 0 GROUP BY r, row_) GROUP BY r)
    SELECT doc_id, n AS n_bytes, h * {WIDTH} AS payload_bytes, sha256(payload) AS payload_sha256, crc AS tail_crc32, octet_length(media)::bigint AS media_bytes, sha256(media) AS media_sha256, feature
    FROM m JOIN c USING (r) JOIN g USING (r)"""
