"""Matroska media columns: lossless audio files of bytes, and packet tables read back from them.

``store`` wraps each payload as one 8-bit PCM track in a Matroska file: EBML header, segment, info,
tracks, clusters of laced simple blocks, and cues. ``packets`` parses any such file (variable-length
element ids and sizes, unknown sizes of segment and cluster, simple blocks and block groups, all
four kinds of lacing) into one row per frame with track, timestamp in ticks of the file's scale and byte
range; ``cues`` gives the index, whose ``position`` equals the packets' ``cluster``, the byte at which the
cluster's element begins. Both are DataFrame operators over a binary column.

The first frame of a lace has its block's time. The others follow by the track's default duration, or, for
uncompressed sound, by the bytes of the frames before them, or by their share of the block's duration;
where a file states none of these, their time is null.

Frames of tracks with content encodings are stored compressed or without a common header: ``packets``
gives their bytes as stored and says so in ``encoded``, ``frames`` undoes zlib, bzip2 and stripped headers.

A file that can't be parsed (cut off, overlapping elements, no EBML header) fails no job: it has a row in
``faults`` with the reason, none in ``packets``, ``cues`` and ``frames``, and null payload columns in ``features``. So has, in
``frames``, ``faults`` and ``features``, one with frames that can't be decoded (encrypted, LZO, damaged).

Defined cases: a null or empty text has a payload of 64 zero bytes; repeated rows and null ids are
kept row for row; an empty table gives an empty table; other columns of the input are not touched.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_kernel, slices

# Element ids of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VOID, CRC_32 = 0xEC, 0xBF
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE_BLOCK = 0x23E383, 0x9B, 0xFB
CONTENT_ENCODINGS, CONTENT_ENCODING, ENCODING_ORDER, ENCODING_SCOPE, ENCODING_TYPE = 0x6D80, 0x6240, 0x5031, 0x5032, 0x5033
COMPRESSION, COMPRESSION_ALGORITHM, COMPRESSION_SETTINGS = 0x5034, 0x4254, 0x4255
ALGORITHMS = ("zlib", "bzip2", "lzo", "stripped")

#: Samples in a millisecond, so a unit of 64 bytes lasts one tick; bytes in a frame, frames in a block, blocks in a cluster.
UNIT, FRAME, LACED, BLOCKS = 64, 512, 8, 16


class Packet(NamedTuple):
    track: int
    timestamp: int | None
    offset: int
    length: int
    cluster: int
    block: int
    lacing: int
    keyframe: bool


class Cue(NamedTuple):
    time: int
    track: int
    position: int


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is reserved for unknown sizes."""
    width = width or next(w for w in range(1, 9) if x < (1 << 7 * w) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def _uint(kind: int, x: int) -> bytes:
    return _element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def _float(kind: int, x: float) -> bytes:
    return _element(kind, struct.pack(">d", x))


def _signed_vint(x: int) -> bytes:
    """A difference of frame sizes: a variable-length integer shifted to be unsigned."""
    width = next(w for w in range(1, 9) if abs(x) < (1 << 7 * w - 1) - 1)
    return vint(x + (1 << 7 * width - 1) - 1, width)


def _lace(sizes: list[int], kind: int) -> bytes:
    if kind == 0:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 3:
        return head + vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track holds ``payload`` (a multiple of 64 bytes) as 8-bit samples."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(payload) / UNIT) + _element(MUXING_APP, b"netweft") + _element(WRITING_APP, b"netweft"))
    audio = _element(AUDIO, _float(SAMPLING_FREQUENCY, UNIT * 1000.0) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_block = FRAME * LACED
    for k, start in enumerate(range(0, len(payload), per_block * BLOCKS)):
        tick, body = start // UNIT, []
        for b, p in enumerate(range(start, min(start + per_block * BLOCKS, len(payload)), per_block)):
            data = payload[p : p + per_block]
            sizes = [FRAME] * (len(data) // FRAME) + [len(data) % FRAME] * (len(data) % FRAME > 0)
            lacing = 0 if len(sizes) == 1 else 2 if sizes[-1] == FRAME and b % 2 == 0 else 1 if k % 2 else 3
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", p // UNIT - tick, 0x80 | lacing << 1) + _lace(sizes, lacing) + data))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, tick) + b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, tick) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    return head + _element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are ones (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer of at most 8 bytes at {at}")
    width = 9 - first.bit_length()
    x = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"the file ends within an integer at {at}")
    bits = x & (1 << 7 * width) - 1
    return (x if marker else bits), at + width, bits == (1 << 7 * width) - 1


#: What can't stand inside a segment or a cluster, and so ends one of unknown size.
_ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, CLUSTER, CUES, INFO, TRACKS}}


class Track(NamedTuple):
    """``frame`` is the default duration of a frame in nanoseconds, ``byte`` that of a byte of uncompressed sound; null if not stated."""

    codec: str
    rate: float
    bits: int
    channels: int = 1
    frame: int | None = None
    #: How a reader undoes the encodings of frames, in this order, each with its settings.
    encodings: tuple[tuple[str, bytes], ...] = ()

    @property
    def byte(self) -> float | None:
        size = self.bits * self.channels / 8
        return 1e9 / (self.rate * size) if self.codec.startswith("A_PCM/") and size and self.rate and not self.encodings else None

    def decoded(self, frame: bytes) -> bytes:
        for how, settings in self.encodings:
            if how == "stripped":
                frame = settings + frame
            elif how == "zlib":
                frame = zlib.decompress(frame)
            elif how == "bzip2":
                frame = bz2.decompress(frame)
            else:
                raise ValueError(f"frames are {how}")
        return frame


#: What a file that isn't well-formed, or a damaged frame, can raise.
FAULTS = (ValueError, LookupError, OSError, EOFError, OverflowError, struct.error, zlib.error)


def _elements(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """Id and bounds of the body of each element; an unknown size ends where its parent or its kind does."""
    while at < end:
        kind, body, _ = read_vint(data, at, True)
        if kind in _ENDS.get(within, ()):
            return
        n, body, unknown = read_vint(data, body)
        if unknown:
            if kind not in _ENDS:
                raise ValueError(f"element {kind:X} has no size")
            stop = body
            for _, _, stop in _elements(data, body, end, kind):  # noqa: B007
                pass
        else:
            stop = body + n
        if stop > end:
            raise ValueError(f"element {kind:X} at {at} ends beyond its parent")
        yield kind, body, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == 0:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("frames of fixed size don't fill their block")
        return [(at + k * size, size) for k in range(n)]
    sizes: list[int] = []
    for _ in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at, _ = read_vint(data, at)
            if sizes:
                size += sizes[-1] - (1 << 7 * (at - before) - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _seconds(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _track(data: bytes, at: int, end: int) -> tuple[int, Track]:
    own = {k: (x, y) for k, x, y in _elements(data, at, end)}
    audio = {k: (x, y) for k, x, y in _elements(data, *own[AUDIO])} if AUDIO in own else {}
    number = lambda found, kind, default: _number(data, *found[kind]) if kind in found else default
    rate = _seconds(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 8000.0
    codec = data[slice(*own[CODEC_ID])].decode() if CODEC_ID in own else ""
    encodings = _encodings(data, *own[CONTENT_ENCODINGS]) if CONTENT_ENCODINGS in own else ()
    return _number(data, *own[TRACK_NUMBER]), Track(codec, rate, number(audio, BIT_DEPTH, 0), number(audio, CHANNELS, 1), number(own, DEFAULT_DURATION, None), encodings)


def _encodings(data: bytes, at: int, end: int) -> tuple[tuple[str, bytes], ...]:
    """Encodings that apply to frames; the one of the highest order was applied last and is undone first."""
    found = []
    for kind, a, b in _elements(data, at, end):
        if kind != CONTENT_ENCODING:
            continue
        own = {k: (x, y) for k, x, y in _elements(data, a, b)}
        order, scope, what = (_number(data, *own[k]) if k in own else default for k, default in ((ENCODING_ORDER, 0), (ENCODING_SCOPE, 1), (ENCODING_TYPE, 0)))
        inner = {k: (x, y) for k, x, y in _elements(data, *own[COMPRESSION])} if COMPRESSION in own else {}
        algorithm = _number(data, *inner[COMPRESSION_ALGORITHM]) if COMPRESSION_ALGORITHM in inner else 0
        how = "encrypted" if what else ALGORITHMS[algorithm] if algorithm < len(ALGORITHMS) else "of an unknown compression"
        if scope & 1:
            found.append((order, how, data[slice(*inner[COMPRESSION_SETTINGS])] if COMPRESSION_SETTINGS in inner else b""))
    return tuple((how, settings) for _, how, settings in sorted(found, key=lambda x: -x[0]))


def demux(data: bytes) -> tuple[list[Packet], list[Cue], dict[int, Track]]:
    """Packets in file order, cues (positions from the file's start), and the tracks by number."""
    packets: list[Packet] = []
    cues: list[Cue] = []
    tracks: dict[int, Track] = {}
    for k, (kind, a, b) in enumerate(_elements(data, 0, len(data))):
        if not k and kind != EBML:
            raise ValueError("the file has no EBML header")
        if kind != SEGMENT:
            continue
        scale, at = 1_000_000, a
        for top, c, d in _elements(data, a, b, SEGMENT):
            if top == CLUSTER:
                _cluster(data, at, c, d, packets, tracks, scale)
            elif top == INFO:
                scale = next((_number(data, x, y) for k, x, y in _elements(data, c, d) if k == TIMESTAMP_SCALE), scale)
            elif top == TRACKS:
                tracks.update(_track(data, e, f) for k, e, f in _elements(data, c, d) if k == TRACK_ENTRY)
            elif top == CUES:
                for point, e, f in _elements(data, c, d):
                    if point != CUE_POINT:
                        continue
                    inner = list(_elements(data, e, f))
                    time = next((_number(data, x, y) for k, x, y in inner if k == CUE_TIME), 0)
                    for k, x, y in inner:
                        if k == CUE_TRACK_POSITIONS:
                            own = {i: _number(data, p, q) for i, p, q in _elements(data, x, y)}
                            cues.append(Cue(time, own[CUE_TRACK], own[CUE_CLUSTER_POSITION] + a))
            at = d
    return packets, cues, tracks


def attempt(data: bytes, decode: bool = False) -> tuple[list[Packet], list[Cue], dict[int, Track], list[bytes]] | str:
    """What ``demux`` finds and, if asked for, the decoded frames; of a faulty file the reason."""
    try:
        if not data:
            raise ValueError("the file is empty")
        found, index, tracks = demux(data)
        plain = Track("", 0.0, 0)
        return found, index, tracks, [tracks.get(p.track, plain).decoded(data[p.offset : p.offset + p.length]) for p in found] if decode else []
    except FAULTS as error:
        return f"{type(error).__name__}: {error}"


def _cluster(data: bytes, start: int, at: int, end: int, packets: list[Packet], tracks: dict[int, Track], scale: int) -> None:
    base = 0
    for kind, a, b in _elements(data, at, end, CLUSTER):
        if kind == TIMESTAMP:
            base = _number(data, a, b)
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, base, start, packets, tracks, scale)
        elif kind == BLOCK_GROUP:
            inner = list(_elements(data, a, b))
            lasts = next((_number(data, x, y) for k, x, y in inner if k == BLOCK_DURATION), None)
            for k, x, y in inner:
                if k == BLOCK:
                    _block(data, x, y, base, start, packets, tracks, scale, lasts, all(i != REFERENCE_BLOCK for i, _, _ in inner))


def _block(data: bytes, at: int, end: int, base: int, cluster: int, packets: list[Packet], tracks: dict[int, Track], scale: int, lasts: int | None = None, key: bool | None = None) -> None:
    number, p, _ = read_vint(data, at)
    rel, flags = struct.unpack_from(">hB", data, p)
    lacing, track = flags >> 1 & 3, tracks.get(number)
    frames = _frames(data, p + 3, end, lacing)
    for k, (offset, size) in enumerate(frames):
        later: float | None = None
        if not k:
            later = 0
        elif track and track.frame is not None:
            later = k * track.frame / scale
        elif track and track.byte is not None:
            later = (offset - frames[0][0]) * track.byte / scale
        elif lasts is not None:
            later = k * lasts / len(frames)
        packets.append(Packet(number, None if later is None else base + rel + int(later + 1e-6), offset, size, cluster, at, lacing, bool(flags & 0x80) if key is None else key))


# -- DataFrame operators -------------------------------------------------------------------------

STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A Matroska file for each row: its UTF-8 bytes, padded with zeros to a positive multiple of 64."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            yield {"doc_id": part.column("doc_id"), "n_bytes": [len(x) for x in raw], "media": [mux(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in raw]}

    return arrow_kernel(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), STORED, rows)


def _per_file(media: DataFrame, id_col: str, media_col: str, schema: str, found: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` for each tuple that a file gives; null files give none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "media"):
            out = [(i, *x) for i, m in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True) if m is not None for x in found(m)]
            yield {n: [x[k] for x in out] for k, n in enumerate(("doc_id", *names))}

    return arrow_kernel(media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), f"doc_id long, {schema}", rows)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: a row per frame of each file (null and faulty files have none)."""

    def found(m: bytes) -> Iterator[tuple]:
        if not isinstance(got := attempt(m), str):
            for k, p in enumerate(got[0]):
                yield k, *p, p.track in got[2] and bool(got[2][p.track].encodings)

    return _per_file(media, id_col, media_col, "packet long, track long, timestamp long, offset long, length long, cluster long, block long, lacing int, keyframe boolean, encoded boolean", found)


def cues(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The cue table: a row per index entry, with the byte position of its cluster."""
    return _per_file(media, id_col, media_col, "time long, track long, position long", lambda m: iter(()) if isinstance(got := attempt(m), str) else iter(got[1]))


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The bytes of each frame with its track's encodings undone; ``packet`` is that of the packet table."""

    def found(m: bytes) -> Iterator[tuple]:
        if not isinstance(got := attempt(m, True), str):
            yield from ((k, p.track, x) for k, (p, x) in enumerate(zip(got[0], got[3], strict=True)))

    return _per_file(media, id_col, media_col, "packet long, track long, frame binary", found)


def faults(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Files that can't be parsed or decoded, with the reason."""
    return _per_file(media, id_col, media_col, "fault string", lambda m: iter([(got,)] if isinstance(got := attempt(m, True), str) else []))


def feature(payload: bytes, found: list[Packet], index: list[Cue]) -> str:
    """Statistics of the samples and of the packet table."""
    x = np.frombuffer(payload, np.uint8)
    steps = np.abs(np.diff(x.astype(np.int16)))
    return f"packets={len(found)};clusters={len({p.cluster for p in found})};cues={len(index)};ticks={len(payload) // UNIT};mean={x.mean():.4f};deviation={x.std():.4f};step={steps.mean():.4f};peak={int(x.max())};zero={int((x == 0).sum())}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of each stored file; the payload is put together from the packet table's byte ranges. A faulty file has nulls."""

    def one(n: int, m: bytes) -> tuple:
        if isinstance(got := attempt(m, True), str):
            return n, None, None, None, len(m), hashlib.sha256(m).hexdigest(), None
        found, index, _, parts = got
        payload = b"".join(parts)
        if not payload:
            return n, 0, hashlib.sha256(b"").hexdigest(), 0, len(m), hashlib.sha256(m).hexdigest(), None
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload, found, index)

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "media"):
            got = [one(n, m) for n, m in zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True)]
            yield {"doc_id": part.column("doc_id")} | {n: [x[k] for x in got] for k, n in enumerate(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))}

    return arrow_kernel(media.select("doc_id", "n_bytes", "media"), FEATURES, rows)
