"""Headers of audio files made by hand, and mel spectra against a plain transform."""

import io
import struct
import wave

import numpy as np
import pytest

from sonoflock.sources import headers as H
from sonoflock.sources import media, mel


def wav_file(frames=4800, rate=48000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(bytes(2 * frames))
    return out.getvalue()


def flac_file(samples, rate):
    packed = rate << 44 | 1 << 41 | 15 << 36 | samples
    return b"fLaC" + b"\x80\x00\x00\x22" + bytes(10) + packed.to_bytes(8, "big") + bytes(16) + b"rest"


def page(packet, position, serial=7):
    return b"OggS\x00\x00" + struct.pack("<qIIIB", position, serial, 0, 0, 1) + bytes([len(packet)]) + packet


def ogg_file(head, positions, serial=7):
    return page(head, 0) + b"".join(page(b"data", p, s) for p, s in positions)


VORBIS = b"\x01vorbis" + bytes(4) + b"\x02" + struct.pack("<I", 44100) + bytes(14)
OPUS = b"OpusHead\x01\x02" + struct.pack("<HI", 312, 44100) + bytes(3)


def mp3_frame(padding=0, rate=9, body=b""):
    head = bytes([0xFF, 0xFB, rate << 4 | padding << 1, 0])  # version 1, layer 3, 44100 Hz
    return (head + body).ljust(H.frame(head, 0)[0], b"\0")


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4_file(scale, length, wide=False):
    times = (b"\x01" + bytes(19) + struct.pack(">IQ", scale, length) if wide else bytes(12) + struct.pack(">II", scale, length)) + bytes(4)
    track = lambda kind, t: box(b"trak", box(b"tkhd", bytes(20)) + box(b"mdia", box(b"mdhd", t) + box(b"hdlr", bytes(8) + kind + bytes(12))))
    other = bytes(12) + struct.pack(">II", 600, 99)
    return box(b"ftyp", b"M4A ") + box(b"moov", box(b"mvhd", bytes(100)) + track(b"vide", other) + track(b"soun", times)) + box(b"mdat", bytes(50))


ID3 = b"ID3\x04\x00\x00\x00\x00\x01\x00" + b"\xff\xfb" + bytes(126)
FILES = {
    "a.wav": (wav_file(), 0.1, 48000),
    "b.flac": (flac_file(441000, 44100), 10, 44100),
    "c.FLAC": (ID3 + flac_file(1 << 33, 192000), (1 << 33) / 192000, 192000),
    "d.ogg": (ogg_file(VORBIS, [(1000, 7), (88200, 7), (-1, 7), (999999, 8)]), 2, 44100),
    "e.ogg": (ogg_file(OPUS, [(48312, 7)]), 1, 48000),
    "f.mp3": (ID3 + b"".join(mp3_frame(k % 2) for k in range(50)) + b"TAG" + bytes(125), 50 * 1152 / 44100, 44100),
    "g.mp3": (mp3_frame(body=bytes(32) + b"Xing\x00\x00\x00\x03" + struct.pack(">I", 1000)) + mp3_frame(), 1000 * 1152 / 44100, 44100),
    "h.m4a": (mp4_file(44100, 441000), 10, 44100),
    "i.m4a": (mp4_file(48000, 1 << 40, True), (1 << 40) / 48000, 48000),
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_durations(name):
    data, duration, rate = FILES[name]
    assert H.read(name, data) == pytest.approx((duration, rate))
    assert H.read("no suffix", data) == pytest.approx((duration, rate))
    for n in range(0, min(len(data), 400), 7):  # cut off anywhere: no error
        H.read(name, data[:n])


def test_scan_reads_all_kinds(spark, tmp_path):
    for name, (data, _, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad.mp3").write_bytes(b"not audio")
    (tmp_path / "notes.txt").write_bytes(b"x")
    got = {r.file_name: r.duration for r in media.scan(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({n: d for n, (_, d, _) in FILES.items()})


def test_mel_spectra_equal_a_plain_transform(spark):
    rate = 16000
    t = np.arange(rate // 2) / rate
    samples = (8000 * np.sin(2 * np.pi * 1234 * t) + 500 * np.sin(2 * np.pi * 5000 * t)).astype(int)
    cut = spark.createDataFrame([(1, 0.0, samples.tolist()), (2, 0.0, [])], "recording_id long, start_time double, samples array<int>")
    got = {r.recording_id: r.mel for r in mel.mel_spectra(cut, rate, 40).collect()}
    assert got[2] is None
    x = np.pad(samples / 32768, 1024)
    n = 1 + len(samples) // 512
    turn = np.exp(-2j * np.pi * np.outer(np.arange(1025), np.arange(2048)) / 2048)
    window = np.hanning(2049)[:-1]
    power = np.stack([np.abs(turn @ (window * x[512 * k : 512 * k + 2048])) ** 2 for k in range(n)], axis=1)
    edges = mel.to_hertz(np.linspace(0, mel.to_mel(rate / 2), 42))
    hertz = np.arange(1025) * rate / 2048
    bank = np.array([np.interp(hertz, edges[k : k + 3], [0, 2 / (edges[k + 2] - edges[k]), 0], 0, 0) for k in range(40)])
    want = 10 * np.log10(np.maximum(bank @ power, 1e-10))
    want = np.maximum(want - want.max(), -80)
    assert np.array(got[1]).shape == (40, n) and np.abs(np.array(got[1]) - want).max() < 1e-3
    loudest = int(np.array(got[1]).mean(axis=1).argmax())
    assert edges[loudest] < 1234 < edges[loudest + 2]
    assert abs(float(mel.to_mel(1000)) - 15) < 1e-9 and abs(float(mel.to_hertz(mel.to_mel(6400.0))) - 6400) < 1e-6
