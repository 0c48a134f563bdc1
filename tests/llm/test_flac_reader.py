"""The writer against a second reader, written bit by bit from the published format and sharing no code with it."""

import hashlib
import random

import pyarrow as pa
import pytest

from quillmill.llm import flac


class Bits:
    def __init__(self, data):
        self.text = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def take(self, n):
        self.at += n
        return int(self.text[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        end = self.text.index("1", self.at)
        n, self.at = end - self.at, end + 1
        return n


def crc(data, poly, width):
    value = 0
    for byte in data:
        for i in range(7, -1, -1):
            top = value >> (width - 1) & 1
            value = (value << 1 | 0) & ((1 << width) - 1)
            if top ^ (byte >> i & 1):
                value ^= poly
    return value


def residuals(bits, size, order):
    width = 4 + bits.take(2)
    parts = 1 << bits.take(4)
    out = []
    for k in range(parts):
        n = size // parts - (order if k == 0 else 0)
        parameter = bits.take(width)
        if parameter == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                code = bits.unary() << parameter | bits.take(parameter)
                out.append(code >> 1 ^ -(code & 1))
    return out


def subframe(bits, size, depth):
    assert bits.take(1) == 0
    kind = bits.take(6)
    assert bits.take(1) == 0, "no wasted bits are written"
    if kind == 0:
        return [bits.signed(depth)] * size
    if kind == 1:
        return [bits.signed(depth) for _ in range(size)]
    order = kind - 8 if kind < 32 else kind - 31
    out = [bits.signed(depth) for _ in range(order)]
    shift = 0
    if kind < 32:
        weights = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
    else:
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)]
    for r in residuals(bits, size, order):
        out.append(r + (sum(w * x for w, x in zip(weights, reversed(out[-order:] if order else []))) >> shift))
    return out


def read(data):
    """Samples and the kinds of subframes met."""
    assert data[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = Bits(data[at + 4 : at + 4 + n])
            least, most = info.take(16), info.take(16)
            info.take(48)
            rate, channels, depth, total = info.take(20), info.take(3) + 1, info.take(5) + 1, info.take(36)
            md5 = data[at + 22 : at + 38]
        at += 4 + n
    assert channels == 1 and depth == 8 and rate > 0 and least <= most
    samples = []
    number = 0
    while at < len(data):
        bits = Bits(data[at : at + 4096])
        assert bits.take(15) == 0b111111111111100 and bits.take(1) == 0  # fixed block size
        size_code, rate_code, channel, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        assert channel == 0 and depth_code in (0, 1) and bits.take(1) == 0
        lead = bits.take(8)
        more = 0 if lead < 128 else f"{lead:08b}".index("0") - 1
        coded = lead if not more else lead & (0x3F >> more)
        for _ in range(more):
            coded = coded << 6 | bits.take(8) & 63
        assert coded == number
        number += 1
        size = {1: 192, 6: None, 7: None}.get(size_code, 576 << size_code - 2 if size_code < 6 else 256 << max(0, size_code - 8))
        size = size or bits.take(8 if size_code == 6 else 16) + 1
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        head = bits.at // 8
        assert bits.take(8) == crc(data[at : at + head], 0x07, 8)
        samples += subframe(bits, size, depth)
        bits.at = -(-bits.at // 8) * 8
        assert bits.take(16) == crc(data[at : at + bits.at // 8 - 2], 0x8005, 16)
        at += bits.at // 8
    pcm = bytes(x & 255 for x in samples)
    assert len(samples) == total and hashlib.md5(pcm).digest() == md5
    return samples


def test_a_second_reader_reads_the_same():
    rng = random.Random(4)
    raw = [
        b"", b"\0" * 3000, b"words and more words " * 150, rng.randbytes(2500), bytes(range(256)) * 8, ("grün — 文字 " * 120).encode(),
        bytes(128 + int(100 * ((i % 64) / 32 - 1)) for i in range(2100)), b"a" * 1500 + rng.randbytes(700),
    ]
    for data in map(flac.payload, raw):
        (stream,) = flac.encode([data])
        assert bytes(x + 128 for x in read(stream)) == data


def test_blocks_of_odd_rows(spark, odd):
    media = flac.store_texts(odd)
    assert media.count() == 10 and flac.store_texts(odd.limit(0)).count() == 0
    blocks = flac.pcm_blocks(media).collect()
    starts = {}
    for b in blocks:
        assert len(b["pcm"]) == b["n_samples"]
        starts.setdefault(b["doc_id"], []).append((b["block"], b["sample_offset"]))
    assert set(starts) == {1, 2, 3, 4, 5, 6, 7, 8, None}  # a null or empty text is one block of zero bytes
    assert sorted(starts[2]) == [(0, 0), (0, 0)] and sorted(starts[6]) == [(i, i * 1024) for i in range(len(starts[6]))]
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.pcm_blocks(none).count() == 0 and flac.pcm_blocks(none.limit(0)).count() == 0
    stream = flac.encode([flac.payload(b"x" * 3000)])[0]
    assert flac.seek(stream, 5000, 10) == b"" and flac.seek(stream, 0, 0) == b""


def test_the_query_reads_blocks(spark, monkeypatch):
    """Seeking in the query's blocks gives the payload's samples; a block that goes missing, or is another one's, is noticed."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, rng.randbytes(n).hex()) for i, n in enumerate((0, 10, 511, 512, 513, 4000))], "doc_id long, text string")
    stored = flac._stored(iter(docs.toArrow().combine_chunks().to_batches()))
    batches = list(flac._blocks(stored, of_stream=True))
    rows = [r for b in batches for r in b.to_pylist()]
    for doc_id, text in docs.collect():
        data = flac.payload(text.encode()).translate(flac._SIGNED)
        blocks = [(r["sample_offset"], r["pcm"]) for r in rows if r["doc_id"] == doc_id]
        for at, n in ((0, 1), (0, len(data)), (len(data) - 64, 64), (1020, 10), (1024, 1024), (len(data), 5), (5, 0)):
            assert flac.read_blocks(blocks, at, n) == data[at : at + n]
    (whole,) = batches
    assert sum(b.num_rows for b in flac._digests(iter([whole]))) == 6
    for broken in (whole.slice(0, whole.num_rows - 1), pa.RecordBatch.from_struct_array(whole.to_struct_array().take(pa.array([*range(whole.num_rows - 2), whole.num_rows - 1])))):
        with pytest.raises(flac.DamagedStream):
            list(flac._digests(iter([broken])))
