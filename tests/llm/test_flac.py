import hashlib
import random

import numpy as np
import pytest
from seqloom.llm import flac


def cases():
    rng = random.Random(1)
    text = "The quick brown fox — “jumps” over\n" * 400
    wave = bytes(int(128 + 90 * np.sin(i / 9) + 20 * np.sin(i / 2.3)) for i in range(10_000))
    return [b"", b"a", b"ab", bytes(64), b"x" * 5000, text.encode()[:13 * 64], text.encode(), rng.randbytes(9000), wave, wave[:4099], bytes([0, 255] * 700), bytes(300) + b"\xff" + bytes(300)]


def test_round_trip_and_choice_of_subframes():
    streams = flac.encode_streams(cases())
    for raw, blocks in zip(cases(), flac.decode_streams(streams), strict=True):
        assert flac.payload_of(blocks) == raw
        assert [b[0] for b in blocks] == list(range(0, len(raw), flac.BLOCK))
    kinds = set()
    for s in streams:
        frames, _, _ = flac._frames_of(s)
        for _, lo, _ in frames:
            _, end = flac._read_coded_number(s, lo + 4)
            kinds.add(s[end + 3] >> 1)
    assert {0, 1, 0x20 | flac.LPC_ORDER - 1} <= kinds and kinds & {8, 9, 10}
    assert len(streams[8]) < 0.6 * 10_000  # prediction pays on a wave


def test_equal_alone_and_together():
    assert [flac.encode_streams([c])[0] for c in cases()] == flac.encode_streams(cases())
    streams = flac.encode_streams(cases())
    assert [flac.decode_streams([s])[0] for s in streams] == flac.decode_streams(streams)


def test_without_seek_table():
    for raw, s in zip(cases(), flac.encode_streams(cases()), strict=True):
        n = int.from_bytes(s[43:46], "big")
        bare = s[:4] + b"\x80" + s[5:42] + s[46 + n :]
        assert flac.payload_of(flac.decode_streams([bare])[0]) == raw


@pytest.mark.parametrize("at", [0, 30, -1, -40, -200])
def test_damage_is_found(at):
    s = bytearray(flac.encode_streams([cases()[6]])[0])
    s[at] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(s)])


def test_numbers():
    for n in [0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1, 2**21, 2**31 - 1]:
        raw = flac._coded_number(n)
        assert flac._read_coded_number(raw, 0) == (n, len(raw))
        if n < 0xD800:
            assert raw == chr(n).encode()


def test_stored_streams_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases())] + [(99, None)], "id bigint, payload binary")
    path = str(tmp_path / "media")
    back = flac.store_media(flac.encode_column(df, "id", "payload"), path)
    assert back.inputFiles() and all(path in f for f in back.inputFiles())
    assert {r.id: bytes(r.media) for r in back.collect()} == dict(enumerate(flac.encode_streams(cases()))) | {99: flac.encode_streams([b""])[0]}
    assert flac.store_media(back.where("false"), path + "-none").count() == 0


def test_blocks_can_be_sought(spark, tmp_path):
    raw = cases()[8]
    df = spark.createDataFrame([(1, raw, "k"), (2, None, "k"), (3, raw[::-1], "k")], "id bigint, payload binary, key string")
    path = str(tmp_path / "pcm")
    flac.write_pcm_blocks(flac.decode_blocks(flac.encode_column(df, "id", "payload"), "id"), path, "id")
    got = flac.read_samples(spark, path, "id", 3, 4000, 500).orderBy("first_sample").collect()
    assert [r.first_sample for r in got] == [4000, 4096]
    assert flac.payload_of([(0, 0, bytes(r.pcm)) for r in got]) == raw[::-1][4000:4500]
    assert flac.read_samples(spark, path, "id", 2, 0, 10).count() == 0
    assert flac.encode_column(df.where("false"), "id", "payload").count() == 0


@pytest.mark.parametrize("key", ["id bigint", "id struct<a:bigint,b:string>"])
def test_large_ids_beside_null(spark, key):
    ids = [None, 2**53 + 1, 2**53 + 3] if "struct" not in key else [None, (2**53 + 1, "x"), (None, "y")]
    df = spark.createDataFrame([(i, b"ab" * 3000, "x", "y") for i in ids], f"{key}, raw binary, payload string, media string").coalesce(1)
    coded = flac.encode_column(df, "id", "raw")
    got = flac.decode_blocks(coded, "id").collect()
    plain = lambda i: tuple(i) if isinstance(i, tuple) else i
    assert sorted([plain(r.id) for r in got], key=str) == sorted(ids * len({r.first_sample for r in got}), key=str)


class Bits:
    """A reader of single bits, for the decoder below."""

    def __init__(self, raw):
        self.text, self.at = "".join(f"{b:08b}" for b in raw), 0

    def take(self, n):
        self.at += n
        return int(self.text[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def ones_until_zero(self, stop):
        n = 0
        while self.take(1) != stop:
            n += 1
        return n


def plain_decoder(raw):
    """Samples of a mono 8-bit stream, bit by bit as the format's description reads; shares nothing with the module."""
    assert raw[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, n = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        info = raw[at + 4 : at + 4 + n] if kind == 0 else info  # noqa: F821
        at += 4 + n
    total = int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    bits, out = Bits(raw[at:]), []
    while len(out) < total:
        assert bits.take(14) == 0b11111111111110
        bits.take(2)
        size, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        assert channels == 0
        first = bits.take(8)
        for _ in range(max(0, f"{first:08b}".index("0") - 1) if first != 255 else 0):
            bits.take(8)
        size = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        bits.take(8)
        bits.take(1)
        kind = bits.take(6)
        waste = 1 + bits.ones_until_zero(1) if bits.take(1) else 0
        width = 8 - waste
        if kind == 0:
            samples = [bits.signed(width)] * size
        elif kind == 1:
            samples = [bits.signed(width) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            samples, shift = [bits.signed(width) for _ in range(order)], 0
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                coef = [bits.signed(precision) for _ in range(order)]
            else:
                coef = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            wide = 5 if bits.take(2) else 4
            parts = bits.take(4)
            for p in range(1 << parts):
                k = bits.take(wide)
                raw_bits = bits.take(5) if k == (1 << wide) - 1 else None
                for _ in range((size >> parts) - (order if p == 0 else 0)):
                    if raw_bits is not None:
                        r = bits.signed(raw_bits)
                    else:
                        u = (bits.ones_until_zero(1) << k) | bits.take(k)
                        r = -(u + 1 >> 1) if u & 1 else u >> 1
                    samples.append(r + (sum(c * s for c, s in zip(coef, samples[: -order - 1 : -1] if order else [], strict=True)) >> shift))
        out += [s << waste for s in samples]
        bits.at += -bits.at % 8 + 16
    assert hashlib.md5(bytes(s & 255 for s in out)).digest() == info[18:34]
    return bytes((s & 255) ^ 128 for s in out)


def test_streams_by_a_decoder_of_its_own():
    for raw, s in zip(cases(), flac.encode_streams(cases()), strict=True):
        assert plain_decoder(s) == raw
