"""MPEG audio media columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` walks the frames of MPEG-1/2/2.5 layers I-III, reads ID3v2 and ID3v1 tags and the Xing/Info/VBRI table, checks the
checksums (Layer I: header and bit allocation; Layer II: also the scale factor selection; Layer III: header and side
information), and finds the next pair of agreeing headers where a header is broken. Frames of a free bitrate have the
length that the distance of the first two tells.
`pack` stores bytes losslessly as an MPEG-1 Layer III mono stream at 32 kHz: silent granules whose ancillary data carry
the payload in units of 192 bytes, each frame at the least bitrate that holds its units, behind an ID3v2 tag and a Xing
frame with frame count, byte count and a 100-entry seek table.

Cases: null text is stored as the empty text; a very long text takes more frames (7 x 192 bytes each); equal texts have
equal media; bytes without a frame parse to zero frames; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, small_batches, table

# Fixed values of the MPEG audio standard: kbit/s by bitrate index 1-14 for (MPEG-1?, layer), Hz by index for each version.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 192
UNITS = 7  # most in a frame


# Fixed values of the standard: Layer II, bits of each subband's allocation for the five tables (a to d, and the lower rates).
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


@lru_cache(maxsize=4096)
def header(word: int, free: int = 0) -> tuple | None:
    """(version bits, layer, has checksum, rate, frame bytes, samples, side bytes, mono) of a 32-bit header, or None.

    `free`: bytes of an unpadded frame of a free bitrate, where known; without it such a frame is none.
    """
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, bits = word >> 10 & 3, word >> 12 & 15
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or bits == 15 or bits == 0 and not free or word & 3 == 2:
        return None
    one, hz = version == 3, RATES[version][rate]
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    if bits == 0:
        size, samples = free + pad * (4 if layer == 1 else 1), 384 if layer == 1 else 576 if layer == 3 and not one else 1152
        return version, layer, not word >> 16 & 1, hz, size, samples, side_bytes(layer, one, mono), mono
    kbit = BITRATES[one, layer][bits - 1]
    if layer == 1:
        size, samples = (12 * kbit * 1000 // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and not one else 1152
        size = samples // 8 * kbit * 1000 // hz + pad
    return version, layer, not word >> 16 & 1, hz, size, samples, side_bytes(layer, one, mono), mono


def side_bytes(layer: int, one: bool, mono: bool) -> int:
    return ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0


def free_size(media: bytes, at: int, end: int) -> int:
    """Bytes of an unpadded frame of a free bitrate: up to the next header that agrees and is followed by another; else 0."""
    word = int.from_bytes(media[at : at + 4], "big")
    if header(word, 1) is None or word >> 12 & 15:
        return 0
    fixed, unit = 0xFFFE0C00 | 0xF000, 4 if 4 - (word >> 17 & 3) == 1 else 1
    after = at + 4
    while (after := media.find(b"\xff", after, end)) >= 0 and after + 4 <= end:
        if int.from_bytes(media[after : after + 4], "big") & fixed == word & fixed:
            size = after - at - (word >> 9 & 1) * unit
            following = after + header(int.from_bytes(media[after : after + 4], "big"), size)[4]
            if following == end or following + 4 <= end and int.from_bytes(media[following : following + 4], "big") & fixed == word & fixed:
                return size
        after += 1
    return 0


def _crc_table() -> list[int]:
    out = []
    for v in range(256):
        c = v << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int = 0) -> int:
    """Checksum of whole bytes, or of the first `bits` bits."""
    c, whole = 0xFFFF, bits // 8 if bits else len(data)
    for b in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    for k in range(bits % 8 if bits else 0):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15 ^ data[whole] >> (7 - k)) & 1 else 0)
    return c


def allocation(word: int, hz: int, one: bool, channels: int) -> tuple[int, ...]:
    """Layer II: bits of each subband's allocation, by bitrate a channel and sampling rate."""
    index = word >> 12 & 15
    each = BITRATES[one, 2][index - 1] // channels if index else 0
    if not one:
        return ALLOCATION["low"]
    if index == 0:  # a free bitrate has the widest table of its rate
        return ALLOCATION["a" if hz == 48000 else "b"]
    if hz == 48000 and each >= 56 or 56 <= each <= 80:
        return ALLOCATION["a"]
    if hz != 48000 and each >= 96:
        return ALLOCATION["b"]
    return ALLOCATION["c" if hz != 32000 and each <= 48 else "d"]


def protected_bits(media: bytes, at: int, word: int, h: tuple) -> int:
    """Bits behind the checksum that it covers: side information, bit allocation, scale factor selection."""
    version, layer, _, hz, size, _, side, mono = h
    if layer == 3:
        return side * 8
    channels, joint = 1 if mono else 2, word >> 6 & 3 == 1
    bound = 4 + 4 * (word >> 4 & 3) if joint else 32
    if layer == 1:
        return 4 * (channels * min(bound, 32) + 32 - min(bound, 32)) if not mono else 128
    widths = allocation(word, hz, version == 3, channels)
    body, place, chosen = int.from_bytes(media[at + 6 : at + size], "big"), (size - 6) * 8, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            place -= width
            if place < 0:
                return -1
            if body >> place & (1 << width) - 1:
                chosen += channels if band >= bound else 1
    return (size - 6) * 8 - place + 2 * chosen


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def unsynchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """ID3 text frames, and where the audio begins and ends."""
    tags: dict[str, str] = {}
    begin, end = 0, len(media)
    if media[:3] == b"ID3" and len(media) >= 10:
        begin = min(end, 10 + unsynchsafe(media[6:10]) + (10 if media[5] & 16 else 0))
        at, whole = 10, media[3] == 4
        while at + 10 <= begin and media[at : at + 4].isalnum():
            name = media[at : at + 4].decode("latin-1")
            size = unsynchsafe(media[at + 4 : at + 8]) if whole else int.from_bytes(media[at + 4 : at + 8], "big")
            if name[0] == "T" and size:
                kind, body = media[at + 10], media[at + 11 : at + 10 + size]
                text = body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(kind, "utf-8"), "replace").rstrip("\0")
                if name == "TXXX" and "\0" in text:
                    key, _, text = text.partition("\0")
                    name = f"TXXX:{key}"
                tags[name] = text
            at += 10 + size
    if end - begin >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if found := media[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, found)
    return tags, begin, end


def read_vbr(media: bytes, at: int, size: int, side: int, checked: bool) -> dict | None:
    """Xing/Info or VBRI table of a first frame."""
    place = at + 4 + 2 * checked + side
    for place in (at + 4 + side, place):
        if media[place : place + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(media[place + 4 : place + 8], "big"), place + 8
            out: dict = {"kind": media[place : place + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(media[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = tuple(media[p : p + 100])
            return out
    if media[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(media[at + 46 : at + 50], "big"), "frames": int.from_bytes(media[at + 50 : at + 54], "big")}
    return None


def resync(media: bytes, at: int, end: int, like: tuple | None, free: int = 0) -> int:
    """Next offset from `at` whose header fits the stream and is followed by another fitting header or the end."""
    same = lambda a, b: a[:2] == b[:2] and a[3] == b[3]
    while (at := media.find(b"\xff", at, end)) >= 0 and at + 4 <= end:
        h = header(int.from_bytes(media[at : at + 4], "big"), free)
        if h and (like is None or same(h, like)) and at + h[4] <= end:
            after = at + h[4]
            if after == end:
                return at
            n = header(int.from_bytes(media[after : after + 4], "big"), free) if after + 4 <= end else None
            if n and same(n, h):
                return at
        at += 1
    return -1


def parse(media: bytes) -> dict:
    """tags, vbr, rate, samples, offsets (audio frames), sizes, sides, crc_ok, crc_bad, resyncs, skipped, layer, version."""
    tags, at, end = read_tags(media)
    out = {"tags": tags, "vbr": None, "rate": 0, "samples": 0, "offsets": [], "sizes": [], "heads": [], "crc_ok": 0, "crc_bad": 0, "resyncs": 0, "skipped": 0, "layer": 0, "version": 0}
    like, first, free = None, True, free_size(media, at, end)
    while at + 4 <= end:
        word = int.from_bytes(media[at : at + 4], "big")
        h = header(word, free)
        if h is None or at + h[4] > end or like is not None and (h[:2] != like[:2] or h[3] != like[3]):
            found = resync(media, at + 1, end, like, free)
            out["resyncs"] += 1
            out["skipped"] += (found if found >= 0 else end) - at
            if found < 0:
                break
            at = found
            continue
        version, layer, checked, hz, size, samples, side, _ = h
        if first:
            first, like = False, h
            out |= {"rate": hz, "layer": layer, "version": {3: 1, 2: 2, 0: 25}[version]}
            if layer == 3 and (vbr := read_vbr(media, at, size, side, checked)):
                out["vbr"] = vbr
                at += size
                continue
        if checked:
            bits = protected_bits(media, at, word, h)
            covered = media[at + 2 : at + 4] + media[at + 6 : at + 6 + (bits + 7) // 8]
            good = 0 <= bits <= (size - 6) * 8 and crc16(covered, 16 + bits) == int.from_bytes(media[at + 4 : at + 6], "big")
            out["crc_ok" if good else "crc_bad"] += 1
        out["offsets"].append(at)
        out["sizes"].append(size)
        out["heads"].append(4 + 2 * checked + side)
        out["samples"] += samples
        at += size
    return out


@cache
def _frame(units: int) -> tuple[bytes, int]:
    """Head (header, checksum, silent side information) of the least frame for so many units, and its spare bytes."""
    need = 4 + 2 + 17 + units * UNIT
    bits = next(i for i, kbit in enumerate(BITRATES[True, 3], 1) if 144 * kbit * 1000 // 32000 >= need)
    head = bytes((0xFF, 0xFA, bits << 4 | 2 << 2, 0xC4))
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, 144 * BITRATES[True, 3][bits - 1] * 1000 // 32000 - need


def pack(text: bytes) -> bytes:
    """Media of a payload: the text padded with spaces to a positive multiple of 192 bytes."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    parts, frames = [], []
    for at in range(0, len(payload), UNIT * UNITS):
        part = payload[at : at + UNIT * UNITS]
        head, spare = _frame(len(part) // UNIT)
        frames.append(len(head) + len(part) + spare)
        parts += [head, part, bytes(spare)]
    offsets, total = [], 144
    for n in frames:
        offsets.append(total)
        total += n
    toc = bytes(min(255, offsets[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = b"\xff\xfb\x18\xc4" + bytes(17) + b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + bytes(4)
    millis = len(frames) * 1152 * 1000 // 32000
    fields = ((b"TLEN", b"\x03%d" % millis), (b"TXXX", b"\x03n_bytes\x00%d" % len(text)))
    tag = b"".join(name + synchsafe(len(body)) + b"\0\0" + body for name, body in fields)
    return b"ID3\x04\0\0" + synchsafe(len(tag)) + tag + xing.ljust(144, b"\0") + b"".join(parts)


def unpack(media: bytes, found: dict | None = None) -> bytes:
    """The payload of packed media."""
    found = found or parse(media)
    left = int(found["tags"]["TXXX:n_bytes"])
    left = max(UNIT, -(-left // UNIT) * UNIT)
    out = []
    for at, head in zip(found["offsets"], found["heads"], strict=True):
        n = min(left, UNIT * UNITS)
        out.append(media[at + head : at + head + n])
        left -= n
    return b"".join(out)


MEDIA = "media binary, sample_rate int, samples long, seek_offsets array<int>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media, sample_rate, samples, seek_offsets): exact duration is samples / sample_rate; one offset a frame."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                media = [pack(t or b"") for t in texts]
                found = [parse(m) for m in media]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary()), pa.array([f["rate"] for f in found], pa.int32()), pa.array([f["samples"] for f in found], pa.int64()), pa.array([f["offsets"] for f in found], pa.list_(pa.int32()))], [id_col, "media", "sample_rate", "samples", "seek_offsets"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {MEDIA}")


def feature(media: bytes, found: dict, payload: bytes) -> str:
    vbr = found["vbr"] or {}
    sizes = np.array(found["sizes"] or [0])
    levels = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    seek = zlib.crc32(np.array(found["offsets"], "<u4").tobytes())
    agree = int(vbr.get("frames", -1) == len(found["offsets"]))
    return (
        f"mpeg{found['version']} layer{found['layer']} hz={found['rate']} frames={len(found['offsets'])} samples={found['samples']} ms={found['samples'] * 1000 // max(1, found['rate'])}"
        f" sizes={sizes.min()}-{sizes.max()} vbr={vbr.get('kind', '-')}:{agree} toc={zlib.crc32(bytes(vbr.get('toc', ()))):08x} crc={found['crc_ok']}/{found['crc_ok'] + found['crc_bad']}"
        f" resync={found['resyncs']} seek={seek:08x} tags={len(found['tags'])} sum={int(levels.sum())} energy={int((levels * levels).sum(dtype=np.int64))}"
    )


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = save(media_columns(table(spark, sf_dir, "documents")), "mpeg_media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sample_rate", "samples", "frames"]
        for batch in batches:
            for part, media in slices(batch, "media"):
                rows = []
                for m in media:
                    found = parse(m)
                    p = unpack(m, found)
                    rows.append((int(found["tags"]["TXXX:n_bytes"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(m, found, p), found["rate"], found["samples"], len(found["offsets"])))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sample_rate int, samples long, frames int"
    return stored.select("doc_id", "media").mapInArrow(run, schema)
