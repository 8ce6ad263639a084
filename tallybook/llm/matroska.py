"""Matroska media columns: lossless 8-bit samples in clusters of laced blocks, and a parser into packet tables.

Layout: EBML header, Segment { Info, Tracks, Cluster..., Cues }. Audio of 8 bits at 8000 Hz; a frame holds
512 samples (64 ms), a block 8 frames, a cluster 63 blocks. Equal frames use fixed-size lacing, a shorter last
frame EBML lacing. The parser also reads Xiph lacing, BlockGroups and elements of unknown size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.session import table

# Fixed values of the format: element identifiers.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x23E383, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

RATE, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8000, 512, 8, 63
FRAME_MS = FRAME * 1000 // RATE
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def size_vint(n: int, width: int = 0) -> bytes:
    """A variable-length size, as short as possible or of the given width."""
    while n >= (1 << (7 * max(width, 1))) - 1:
        width = max(width, 1) + 1
    width = max(width, 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(number: int, n: int) -> bytes:
    return element(number, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(samples: memoryview, relative_ms: int) -> bytes:
    """A SimpleBlock of track 1 with up to FRAMES_PER_BLOCK frames."""
    n = len(samples)
    frames = -(-n // FRAME)
    lacing = NO_LACING if frames == 1 else FIXED if n % FRAME == 0 else EBML_LACING
    head = b"\x81" + struct.pack(">hB", relative_ms, 0x80 | lacing << 1)
    if lacing:
        head += bytes([frames - 1])
    if lacing == EBML_LACING:  # the first size, then differences, all 0 here; the last frame takes what is left
        head += size_vint(FRAME) + b"\xbf" * (frames - 2)
    return element(SIMPLE_BLOCK, head + samples)


def header() -> bytes:
    return element(
        EBML,
        unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(MAX_ID, 4) + unsigned(MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
    )


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one audio track has the payload's bytes as samples."""
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXER, b"tallybook") + element(WRITER, b"tallybook"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    view, step = memoryview(payload), FRAME * FRAMES_PER_BLOCK
    clusters, cues, at = [], [], len(info) + len(tracks)
    for first in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        ms = first // FRAME * FRAME_MS
        blocks = [block(view[a : a + step], a // FRAME * FRAME_MS - ms) for a in range(first, min(len(payload), first + step * BLOCKS_PER_CLUSTER), step)]
        body = element(CLUSTER, unsigned(TIMESTAMP, ms) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, ms) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        clusters.append(body)
        at += len(body)
    return header() + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What the parser finds: packets as (track, timestamp in ms, offset, size, keyframe), cues, tracks, an error."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    segment: int = 0
    scale: int = 1_000_000
    error: str = ""


def read_vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, next offset) of a variable-length number; with marker the leading bit stays, as in identifiers."""
    first = data[at]
    width = 9 - first.bit_length()
    if not 1 <= width <= 8 or at + width > len(data):
        raise ValueError(f"bad variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if marker else value & ((1 << (7 * width)) - 1)), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, None where all its bits are ones (unknown)."""
    value, after = read_vint(data, at, False)
    return (None if value == (1 << (7 * (after - at))) - 1 else value), after


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose body begins at `at`, and the first frame's offset."""
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing does not divide the block at byte {at}")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == XIPH:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            value, after = read_vint(data, at, False)
            n = value if not i else sizes[-1] + value - ((1 << (7 * (after - at) - 1)) - 1)
            at = after
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing exceeds the block at byte {at}")
    return sizes, at


_MASTERS = {SEGMENT, TRACKS, CLUSTER, CUES, BLOCK_GROUP}


def parse(data: bytes) -> Media:
    """The packet table of a file; what comes before a fault is kept and the fault is named in error."""
    media = Media()
    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise ValueError("no EBML header")
        _walk(data, 0, len(data), media, 0)
    except (ValueError, IndexError) as e:
        media.error = str(e) or "truncated"
    return media


def _children(data: bytes, at: int, end: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    while at < end:
        number, at = read_vint(data, at, True)
        size, at = read_size(data, at)
        stop = end if size is None else at + size
        out[number] = (at, stop)
        at = stop
    return out


def _number(data: bytes, span: tuple[int, int] | None) -> int:
    return int.from_bytes(data[slice(*span)], "big") if span else 0


def _real(data: bytes, span: tuple[int, int] | None) -> float:
    body = data[slice(*span)] if span else b""
    return struct.unpack(">f" if len(body) == 4 else ">d", body)[0] if len(body) in (4, 8) else 0.0


def _frame_times(track: dict, sizes: list[int]) -> list[int]:
    """When each frame of a lace begins, in ms after its block: by the track's frame duration, else by its samples' bytes, else 0."""
    if track.get("frame_ns"):
        return [i * track["frame_ns"] // 1_000_000 for i in range(len(sizes))]
    second = track.get("rate", 0) * track.get("channels", 1) * track.get("bits", 0) / 8
    if not second or not track.get("codec", "").startswith("A_PCM"):
        return [0] * len(sizes)
    return [int(n * 1000 // second) for n in accumulate(sizes[:-1], initial=0)]


def _walk(data: bytes, at: int, end: int, media: Media, cluster_ms: int, whole: bool = True) -> None:
    """whole: a Block here is a keyframe, as no ReferenceBlock is beside it."""
    while at < end:
        begin = at
        number, at = read_vint(data, at, True)
        size, at = read_size(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"the element at byte {begin} ends outside its parent")
        if number == CLUSTER:
            media.clusters.append(begin - media.segment)
        if number == SEGMENT:
            media.segment = at
        if number in _MASTERS and size is None:  # its children follow here, up to the parent's end
            stop = at
        elif number in _MASTERS:
            _walk(data, at, stop, media, cluster_ms, number != BLOCK_GROUP or REFERENCE_BLOCK not in _children(data, at, stop))
        elif number == INFO:
            media.scale = _number(data, _children(data, at, stop).get(TIMESTAMP_SCALE)) or media.scale
        elif number == TRACK_ENTRY:
            entry = _children(data, at, stop)
            codec = bytes(data[slice(*entry.get(CODEC, (0, 0)))]).decode("ascii", "replace")
            audio = _children(data, *entry[AUDIO]) if AUDIO in entry else {}
            media.tracks[_number(data, entry.get(TRACK_NUMBER))] = {
                "codec": codec, "bits": _number(data, audio.get(BIT_DEPTH)), "frame_ns": _number(data, entry.get(DEFAULT_DURATION)),
                "rate": _real(data, audio.get(SAMPLING)), "channels": _number(data, audio.get(CHANNELS)) or 1,
            }
        elif number == TIMESTAMP:
            cluster_ms = _number(data, (at, stop)) * media.scale // 1_000_000
        elif number == CUE_POINT:
            point = _children(data, at, stop)
            places = _children(data, *point[CUE_POSITIONS]) if CUE_POSITIONS in point else {}
            media.cues.append((_number(data, point.get(CUE_TIME)), _number(data, places.get(CUE_TRACK)), _number(data, places.get(CUE_CLUSTER))))
        elif number in (SIMPLE_BLOCK, BLOCK):
            track, body = read_vint(data, at, False)
            relative, flags = struct.unpack_from(">hB", data, body)
            sizes, offset = lace_sizes(data, body + 3, stop, flags >> 1 & 3)
            ms = cluster_ms + relative * media.scale // 1_000_000
            for n, later in zip(sizes, _frame_times(media.tracks.get(track, {}), sizes)):
                media.packets.append((track, ms + later, offset, n, whole if number == BLOCK else bool(flags & 0x80)))
                offset += n
        at = stop


def padded(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: the Matroska file of each row's padded text (a null text is empty)."""

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.record_batch([batch.column(0), pa.array([mux(padded(t or b"")) for t in texts], pa.binary())], names=[key, "media"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, store, f"`{key}` {docs.schema[key].dataType.simpleString()}, media binary")


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of each file: seq, track, timestamp_ms, byte_offset, n_bytes, keyframe and in_cues.

    in_cues: its cluster is named by a cue. Null media and files without packets give no rows; after a fault
    in a file the packets before it are given.
    """

    def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data is None:
                continue
            media = parse(data)
            cued, starts = {c for _, _, c in media.cues}, np.array(media.clusters + [1 << 62])
            for i, (track, ms, offset, n, whole) in enumerate(media.packets):
                owner = media.clusters[int(np.searchsorted(starts, offset - media.segment, "right")) - 1] if media.clusters else -1
                for column_, value in zip(out, (k, i, track, ms, offset, n, whole, owner in cued)):
                    column_.append(value)
        types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names=[key, "seq", "track", "timestamp_ms", "byte_offset", "n_bytes", "keyframe", "in_cues"])

    schema = f"`{key}` {media.schema[key].dataType.simpleString()}, seq int, track int, timestamp_ms long, byte_offset long, n_bytes long, keyframe boolean, in_cues boolean"
    return map_batches(media.select(key, column), parsed, schema)


def media_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: each text is stored as Matroska, parsed, and its payload read back from the byte ranges.

    Null texts count as empty; equal texts give equal values; an empty table gives no rows; other columns
    are ignored. feature: codec, packets, clusters, cues, duration, and level, effective value and zero crossings.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_digest(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.record_batch([batch.column(0), *columns], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, digest, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _digest(text: bytes) -> tuple:
    stored = mux(padded(text))
    media = parse(stored)
    if media.error:
        raise ValueError(media.error)
    payload = b"".join([stored[offset : offset + n] for _, _, offset, n, _ in media.packets])
    samples = np.frombuffer(payload, np.uint8)
    power = int(np.square(samples.astype(np.int32) - 128).sum(dtype=np.int64))
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    track = media.tracks[1]
    feature = (
        f"{track['codec']};bits={track['bits']};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};"
        f"ms={len(payload) * 1000 // RATE};level={int(samples.sum(dtype=np.int64)) / len(payload):.4f};rms={(power / len(payload)) ** 0.5:.3f};crossings={crossings}"
    )
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op3_matroska": op3_matroska}
