"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories, takes the strips or tiles of each, decodes them (none, PackBits, LZW, deflate), undoes
horizontal differencing and puts the samples together. The writer stores bytes losslessly as pages of 8-bit gray samples and
uses all of these layouts in turn.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import bytes_of, text_slices

#: Fixed values of the format: tags, field types and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, TABLE = 256, 257, 4096

#: Payloads are padded with bytes 255 to a positive multiple of this, the width of a page's rows.
ROW = 576
PAGE_ROWS = 64
STRIP_ROWS = 16
TILE = (192, 16)
#: Compression, differencing, tiles: a page's layout goes by its rows and place.
LAYOUTS = ((DEFLATE, True, False), (PACKBITS, False, False), (DEFLATE, False, True), (LZW, False, False), (DEFLATE, False, False), (PLAIN, False, True), (DEFLATE, True, True), (PACKBITS, False, True))


def lzw_widths() -> np.ndarray:
    """Bits of each code after a clear code; the table grows by one with every code but the first."""
    entries = CLEAR + 2 + np.arange(TABLE - CLEAR)
    return np.where(entries < 512, 9, np.where(entries < 1024, 10, np.where(entries < 2048, 11, 12)))


#: Code i after a clear code starts at bit LZW_AT[i]. Codes grow one early: the entry of its own number is not yet there.
LZW_WIDTHS = lzw_widths()
LZW_AT = np.append(0, np.cumsum(LZW_WIDTHS))


def lzw_decode(data: bytes) -> bytes:
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out: list[bytes] = []
    bit, bits = 0, 8 * len(data)
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    while bit + 9 <= bits:
        at = bit + LZW_AT[:-1]
        at = at[at + LZW_WIDTHS[: len(at)] <= bits]
        widths = LZW_WIDTHS[: len(at)]
        codes = (window[at >> 3] >> (32 - (at & 7) - widths).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else len(codes)
        entries, before = first.copy(), b""
        for code in codes[:n].tolist():
            if code < len(entries):
                text = entries[code]
            elif code == len(entries) and before:
                text = before + before[:1]
            else:
                raise ValueError("LZW code out of range")
            if before:
                entries.append(before + text[:1])
            out.append(text)
            before = text
        if not len(stops) or codes[n] == END:
            break
        bit += int(LZW_AT[n + 1])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, starts = [CLEAR], [0]  # starts: the places of the clear codes
    entries: dict[int, int] = {}  # a code and the byte after it
    code, room = -1, TABLE - CLEAR - 4
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = entries.get(code << 8 | byte)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        entries[code << 8 | byte] = CLEAR + 2 + len(entries)
        if len(entries) == room:
            starts.append(len(codes))
            codes.append(CLEAR)
            entries = {}
        code = byte
    codes += [code, END] if code >= 0 else [END]
    # a clear code itself still has the width that the codes before it have reached
    at = np.arange(len(codes)) - np.repeat(np.array(starts) + 1, np.diff([*starts, len(codes)]))
    at[starts] = [0, *(np.diff(starts) - 1)]
    widths = LZW_WIDTHS[at]
    ends = np.cumsum(widths)
    place = np.arange(ends[-1]) - np.repeat(ends - widths, widths)
    bits = np.repeat(np.array(codes), widths) >> (np.repeat(widths, widths) - 1 - place) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


RUNS = re.compile(rb"(?s)(.)\1{2,127}")


def packbits_encode(row: bytes) -> bytes:
    out, at = [], 0
    for run in [*RUNS.finditer(row), None]:
        for a in range(at, to := run.start() if run else len(row), 128):
            part = row[a : min(a + 128, to)]
            out += [bytes([len(part) - 1]), part]
        if run:
            out += [bytes([257 - (run.end() - run.start())]), run[1]]
            at = run.end()
    return b"".join(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def pages(data: bytes) -> Iterator[dict]:
    """Each page's width, height, samples, bits, compression, predictor, tiled and pixels (rows of samples; 16-bit ones little-endian)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the directories run in a circle or beyond the end")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                place = at + 10 + 12 * i
                tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
        yield page(data, tags, order)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or len(set(tags[BITS])) > 1 or one(PLANAR, 1) != 1:
        raise ValueError("only chunky 8- or 16-bit samples are read")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    offsets, sizes = tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
    across, down = -(-width // w), -(-height // h)
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2) or len(offsets) != across * down or len(sizes) != len(offsets):
        raise ValueError("strips, tiles or predictor not understood")
    kind = np.dtype(f"{order}u{bits // 8}")
    out = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        part = decompress(compression, data[start : start + size])
        need = rows * w * samples * bits // 8
        if len(part) < need:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(part, kind, rows * w * samples).reshape(rows, w, samples).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        cut = block[: height - y, : width - x]
        out[y : y + cut.shape[0], x : x + cut.shape[1]] = cut
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": out.tobytes()}


def decompress(compression: int, part: bytes) -> bytes:
    if compression == PLAIN:
        return part
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(part)
    if compression == LZW:
        return lzw_decode(part)
    if compression == PACKBITS:
        return packbits_decode(part)
    raise ValueError(f"compression {compression} is not read")


def compress(compression: int, block: np.ndarray) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(block.tobytes(), 1)
    if compression == LZW:
        return lzw_encode(block.tobytes())
    if compression == PACKBITS:  # row by row
        return b"".join(packbits_encode(row.tobytes()) for row in block)
    return block.tobytes()


def padded(payload: bytes) -> bytes:
    return payload.ljust(-(-max(len(payload), 1) // ROW) * ROW, b"\xff")


def write(payload: bytes) -> bytes:
    """A little-endian TIFF file of the padded payload: pages of PAGE_ROWS rows, the last one with what is left."""
    image = np.frombuffer(padded(payload), np.uint8).reshape(-1, ROW)
    out = [b"II*\0", b""]
    size, link = 8, 1  # link: where the next directory's place belongs
    for number, y in enumerate(range(0, len(image), PAGE_ROWS)):
        rows = image[y : y + PAGE_ROWS]
        compression, differ, tiled = LAYOUTS[(number + len(image)) % len(LAYOUTS)]
        w, h = TILE if tiled else (ROW, STRIP_ROWS)
        blocks = [rows[a : a + h, b : b + w] for a in range(0, len(rows), h) for b in range(0, ROW, w)]
        if tiled:
            blocks = [np.pad(b, ((0, h - len(b)), (0, 0))) for b in blocks]
        if differ:
            blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
        parts = [compress(compression, np.ascontiguousarray(b)) for b in blocks]
        places = (size + np.cumsum([0, *map(len, parts)])).tolist()
        size = places.pop()
        out += parts
        tags = {WIDTH: (ROW,), HEIGHT: (len(rows),), BITS: (8,), COMPRESSION: (compression,), PHOTOMETRIC: (1,), SAMPLES: (1,), PREDICTOR: (1 + differ,)}
        tags |= {TILE_WIDTH: (w,), TILE_HEIGHT: (h,), TILES: places, TILE_BYTES: [len(p) for p in parts]} if tiled else {ROWS: (h,), STRIPS: places, STRIP_BYTES: [len(p) for p in parts]}
        entries = b""
        for tag, values in sorted(tags.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                out.append(data)
                data, size = struct.pack("<I", size), size + len(data)
            entries += struct.pack("<HHI", tag, 4, len(values)) + data
        if size % 2:  # directories start on even bytes
            out.append(b"\0")
            size += 1
        out[link] = struct.pack("<I", size)
        out += [struct.pack("<H", len(tags)) + entries, b""]
        link, size = len(out) - 1, size + 2 + len(entries) + 4
    out[link] = bytes(4)
    return b"".join(out)


PAGE_SCHEMA = "page int, n_pages int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, media_bytes long, media_sha256 string, error string"


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, n_bytes of the text's UTF-8, and media, a TIFF file of it.

    Narrow: no shuffle, one slice of texts in memory. A null or empty text is one row of bytes 255; a null id stays null, repeated rows give equal files,
    an empty table gives no rows; other columns of ``df`` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, 2 << 20):
            texts = bytes_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(write, texts), pa.binary())], ["id", "n_bytes", "media"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_pages(df: DataFrame, keys: list[str], media_col: str = "media") -> DataFrame:
    """One row per page of each row's TIFF file: the key columns, then PAGE_SCHEMA; pages of a file follow each other in order.

    Narrow: no shuffle. A null or empty file, or one that can't be read, gives one row with page -1 and what is wrong in error; a null key
    stays null, repeated rows give their pages each, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(keys), 2 << 20):
            rows, out = [], []
            for row, media in enumerate(batch.column(len(keys)).to_pylist()):
                about = {"media_bytes": len(media or b""), "media_sha256": hashlib.sha256(media or b"").hexdigest()}
                try:
                    found = list(pages(media or b""))
                    new = [p | about | {"page": i, "n_pages": len(found)} for i, p in enumerate(found)]
                except (ValueError, struct.error, zlib.error, KeyError, TypeError, IndexError) as e:
                    new = [about | {"page": -1, "n_pages": 0, "error": str(e)}]
                rows += [row] * len(new)
                out += new
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))), *(pa.array([x.get(f.name) for x in out], f.type) for f in fields)], [*keys, *(f.name for f in fields)])

    names = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [pa.field(n, names[k]) for n, k in (x.split() for x in PAGE_SCHEMA.split(", "))]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, media_col).mapInArrow(run, f"{key_schema}, {PAGE_SCHEMA}")


DIGEST_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digests(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per file from its pages, which follow each other: the payload that was read back, features of it, and error (null).

    A file that could not be read, or whose pages are not all there, has its row too: null payload and features, and what is wrong in error. A null id
    stays null, repeated files have a row each, an empty table gives no rows.
    """
    names = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, names[k]) for n, k in (x.split() for x in DIGEST_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None

        def rows(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x["id"] for x in done], key), *(pa.array([x.get(f.name) for x in done], f.type) for f in fields)], ["id", *(f.name for f in fields)])

        for batch in batches:
            key, done = batch.schema.field("id").type, []
            for x in batch.to_pylist():
                if held and x["page"] != len(held):
                    done.append(bad(held[0], f"{len(held)} of {held[0]['n_pages']} pages"))
                    held = []
                if x["page"] != len(held):
                    done.append(bad(x, x["error"] or f"page {x['page']} without those before it"))
                    continue
                held.append(x)
                if len(held) == x["n_pages"]:
                    done.append(digest(held))
                    held = []
            if done:
                yield rows(done)
        if held:
            yield rows([bad(held[0], f"{len(held)} of {held[0]['n_pages']} pages")])

    kind = read.select(id_col).schema[0].dataType.simpleString()
    used = read.select(read[id_col].alias("id"), "n_bytes", "page", "n_pages", "pixels", "compression", "predictor", "tiled", "media_bytes", "media_sha256", "error")
    return used.mapInArrow(run, f"id {kind}, {DIGEST_SCHEMA}").withColumnRenamed("id", id_col)


def bad(page: dict, why: str) -> dict:
    return {k: page[k] for k in ("id", "n_bytes", "media_bytes", "media_sha256")} | {"error": why}


def digest(file: list[dict]) -> dict:
    payload = b"".join(x["pixels"] for x in file)
    shades = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    value = np.arange(256)
    mean = float(shades @ value) / len(payload)
    spread = float(shades @ value**2) / len(payload) - mean**2
    layouts = "+".join(sorted({f"{x['compression']}{'p' * (x['predictor'] == 2)}{'t' * x['tiled']}" for x in file}))
    feature = f"pages={len(file)};layouts={layouts};mean={mean:.4f};var={spread:.4f};hist={','.join(map(str, shades.reshape(8, 32).sum(1).tolist()))}"
    return {"id": file[0]["id"], "n_bytes": file[0]["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": file[0]["media_bytes"], "media_sha256": file[0]["media_sha256"], "feature": feature}
