"""Duration and sample rate of audio files, from what their formats say of themselves.

Nothing is decoded: FLAC tells the number of samples in its first block, Ogg the position after
each page, MP4 the length of each track; an MP3 is a row of frames of known length, which are
counted unless a first frame tells their number.
"""

from __future__ import annotations

import io
import struct
import wave

Info = tuple[float | None, float | None]
UNKNOWN: Info = (None, None)

# Fixed values of MPEG audio: kbit/s by (version 1?, layer) and samples a second by version bits.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def wav(data: bytes) -> Info:
    try:
        with wave.open(io.BytesIO(data)) as f:
            return f.getnframes() / f.getframerate(), float(f.getframerate())
    except (wave.Error, EOFError, ZeroDivisionError):
        return UNKNOWN


def tagged(data: bytes) -> int:
    """Where the audio starts behind an ID3 tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 0
    for byte in data[6:10]:
        size = size << 7 | byte & 0x7F
    return 10 + size + (10 if data[5] & 0x10 else 0)


def flac(data: bytes) -> Info:
    at = tagged(data)
    if data[at : at + 4] != b"fLaC" or len(data) < at + 42:
        return UNKNOWN
    packed = int.from_bytes(data[at + 18 : at + 26], "big")  # rate, channels, bits, samples
    rate, samples = packed >> 44, packed & (1 << 36) - 1
    return (samples / rate, float(rate)) if rate and samples else UNKNOWN


def ogg(data: bytes) -> Info:
    if data[:4] != b"OggS" or len(data) < 28:
        return UNKNOWN
    serial, packet, skip = data[14:18], data[27 + data[26] :], 0
    if packet[:7] == b"\x01vorbis" and len(packet) >= 16:
        rate = struct.unpack_from("<I", packet, 12)[0]
    elif packet[:8] == b"OpusHead" and len(packet) >= 12:
        rate, skip = 48000, struct.unpack_from("<H", packet, 10)[0]
    elif packet[:5] == b"\x7fFLAC" and len(packet) >= 35:
        rate = int.from_bytes(packet[27:35], "big") >> 44
    else:
        return UNKNOWN
    at = data.rfind(b"OggS")
    while at >= 0:  # the last page of this stream on which a packet ends
        position = struct.unpack_from("<q", data, at + 6)[0] if len(data) >= at + 27 else -1
        if position >= 0 and data[at + 14 : at + 18] == serial:
            return ((position - skip) / rate, float(rate)) if rate and position > skip else UNKNOWN
        at = data.rfind(b"OggS", 0, at)
    return UNKNOWN


def frame(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(bytes, samples, samples a second) of the MPEG frame at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    rate, sampling, padding = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or sampling == 3:
        return None
    first, hertz = version == 3, SAMPLING[version][sampling]
    bits = 1000 * RATES[first, layer][rate - 1]
    if layer == 1:
        return (12 * bits // hertz + padding) * 4, 384, hertz
    samples = 1152 if layer == 2 or first else 576
    return samples // 8 * bits // hertz + padding, samples, hertz


def mp3(data: bytes) -> Info:
    at, end = tagged(data), len(data)
    while at < end:  # two frames in a row, or one that ends the file
        found = frame(data, at)
        if found and (at + found[0] >= end or frame(data, at + found[0]) or data[at + found[0] :][:3] == b"TAG"):
            break
        at = data.find(b"\xff", at + 1)
        if at < 0:
            return UNKNOWN
    else:
        return UNKNOWN
    length, samples, hertz = found
    head = data[at : at + length]
    for mark in (b"Xing", b"Info"):
        k = head.find(mark)
        if k >= 0 and len(head) >= k + 12 and head[k + 7] & 1:
            return struct.unpack_from(">I", head, k + 8)[0] * samples / hertz, float(hertz)
    k = head.find(b"VBRI")
    if k >= 0 and len(head) >= k + 18:
        return struct.unpack_from(">I", head, k + 14)[0] * samples / hertz, float(hertz)
    total = 0
    while found and at + found[0] <= end:
        total, at = total + found[1], at + found[0]
        found = frame(data, at)
    return (total / hertz, float(hertz)) if total else UNKNOWN


def boxes(data: bytes, start: int, end: int):
    """(kind, start, end) of the boxes of an MP4 file between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            return
        yield kind, body, stop
        start = stop


def inside(data: bytes, path: list[bytes], start: int, end: int) -> list[tuple[int, int]]:
    for kind in path[:1]:
        return [x for k, a, b in boxes(data, start, end) if k == kind for x in inside(data, path[1:], a, b)]
    return [(start, end)]


def mp4(data: bytes) -> Info:
    for a, b in inside(data, [b"moov", b"trak", b"mdia"], 0, len(data)):
        kind = inside(data, [b"hdlr"], a, b)
        times = inside(data, [b"mdhd"], a, b)
        if not kind or not times or data[kind[0][0] + 8 : kind[0][0] + 12] != b"soun":
            continue
        at = times[0][0]
        scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        if scale and length:
            return length / scale, float(scale)
    return UNKNOWN


READERS = {".wav": wav, ".flac": flac, ".ogg": ogg, ".oga": ogg, ".opus": ogg, ".mp3": mp3, ".m4a": mp4, ".mp4": mp4}


def read(name: str, data: bytes) -> Info:
    """By the file's suffix, or by what it begins with if that says nothing."""
    known = [f for suffix, f in READERS.items() if name.lower().endswith(suffix)]
    for reader in known or [wav, flac, ogg, mp4, mp3]:
        try:
            found = reader(data)
        except (struct.error, IndexError):  # cut off
            found = UNKNOWN
        if found != UNKNOWN:
            return found
    return UNKNOWN
