"""Operators 7, 8 and 9: round trips, and the libraries' own answers."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import bpe, common, telephony, token_counts


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- telephony ---------------------------------------------------------------------------------------------


def test_payloads_come_back(edge, small):
    for df in (edge, small):
        wanted = Counter()
        for i, t in pairs(df):
            raw = (t or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            wanted[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
        rows = telephony.read_back(telephony.with_pcm(telephony.store(df))).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == wanted
        features = {}
        for r in rows:
            assert features.setdefault(r.payload_sha256, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)


def plain_feature(payload):
    """The feature by loops: what the payload is in three encodings, at twice the rate."""

    def mulaw(b):
        b = ~b & 255
        size = ((b & 15) * 8 + 132 << (b >> 4 & 7)) - 132
        return -size if b & 128 else size

    def alaw(b):
        b ^= 0x55
        part, level = (b & 15) * 16 + 8, b >> 4 & 7
        size = part + 256 << level - 1 if level > 1 else part + 256 if level else part
        return size if b & 128 else -size

    def shown(samples):
        out = []
        for k, x in enumerate(samples):
            after = samples[min(k + 1, len(samples) - 1)]
            out += [x + (after - x) * j // (telephony.TARGET_RATE // telephony.RATE) for j in range(telephony.TARGET_RATE // telephony.RATE)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
        return f"n{len(out)} rms{math.isqrt(sum(x * x for x in out) // len(out))} zc{crossings} peak{max(map(abs, out))} crc{zlib.crc32(struct.pack(f'<{len(out)}h', *out)):08x}"

    ima = [x for k in range(0, len(payload), 192) for x in scalar_ima(payload[k : k + 192])]
    return f"ulaw {shown([*map(mulaw, payload)])}; alaw {shown([*map(alaw, payload)])}; ima {shown(ima)}"


def test_features_against_loops(edge):
    texts = {t or "" for _, t in pairs(edge) if len(t or "") < 3000}
    wanted = {}
    for t in texts:
        raw = t.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        wanted[hashlib.sha256(payload).hexdigest()] = plain_feature(payload)
    rows = telephony.read_back(telephony.with_pcm(telephony.store(edge))).collect()
    assert {r.payload_sha256: r.feature for r in rows if r.payload_sha256 in wanted} == wanted
    assert telephony.with_pcm(telephony.store(edge)).where("pcm IS NULL").isEmpty()


def test_no_rows(none):
    assert telephony.read_back(telephony.with_pcm(telephony.store(none))).count() == 0


def scalar_ima(block):
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_against_a_plain_loop():
    data = np.random.default_rng(3).integers(0, 256, 192 * 5).astype(np.uint8)
    got = telephony.decode_ima(data)
    assert got.tolist() == [scalar_ima(data[k : k + 192].tobytes()) for k in range(0, len(data), 192)]


def test_companding_tables():
    assert telephony.MULAW_PCM[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for table in (telephony.MULAW_PCM, telephony.ALAW_PCM):
        assert len(set(table.tolist())) >= 255 and sorted(table.tolist()) == sorted((-table).tolist())


def test_files_become_resampled_pcm(spark):
    raw = np.arange(256, dtype=np.uint8).tobytes()
    files = [(1, telephony.wave(raw, telephony.MULAW, 8000, 8)), (2, telephony.wave(raw, telephony.ALAW, 8000, 8)), (3, telephony.wave(raw[:192], telephony.IMA, 8000, 4, 192)), (4, b"junk"), (5, None)]
    got = {r.doc_id: r.pcm for r in telephony.to_pcm(spark.createDataFrame(files, "doc_id long, media binary")).collect()}
    for k, table in ((1, telephony.MULAW_PCM), (2, telephony.ALAW_PCM)):
        kind, rate, _, data = telephony.parse_wave(bytes(got[k]))
        pcm = np.frombuffer(data, "<i2")
        assert (kind, rate, len(pcm)) == (telephony.PCM, 16000, 512) and (pcm[::2] == table).all()
    assert len(telephony.parse_wave(bytes(got[3]))[3]) == 2 * 2 * 377 and got[4] is None and got[5] is None


def test_resampling_by_other_ratios():
    x = np.array([0, 100, -100, 32767], np.int16)
    assert telephony.resample(x, 8000, 8000) is x
    assert telephony.resample(x, 8000, 12000).tolist() == [0, 66, 33, -100, 21811, 32767]
    with pytest.raises(ValueError):
        telephony.resample(x, 8000, 4000)


def test_odd_files_give_nulls_or_audio(spark):
    pcm = np.arange(-3000, 3000, 10, dtype="<i2")
    good = telephony.wave(pcm.tobytes(), telephony.PCM, 44_100, 16, 2)
    ima = telephony.wave(bytes(range(192)) + bytes(range(60)), telephony.IMA, 8000, 4, 192)
    files = {
        "44.1 kHz": good,
        "no rate": telephony.wave(b"x" * 50, telephony.MULAW, 0, 8),
        "short header": good[:30],
        "no data": good[:36],
        "cut data": good[:100],
        "two channels": good[:22] + b"\2\0" + good[24:],
        "other format": telephony.wave(b"x" * 50, 85, 8000, 8),
        "24 bits": telephony.wave(b"x" * 48, telephony.PCM, 8000, 24, 3),
        "8 bits": telephony.wave(bytes([0, 128, 255]), telephony.PCM, 16_000, 8, 1),
        "no samples": telephony.wave(b"", telephony.MULAW, 8000, 8),
        "short block": ima,
        "empty": b"",
    }
    rows = telephony.to_pcm(spark.createDataFrame([*files.items()], "name string, media binary"), key="name").collect()
    got = {r.name: None if r.pcm is None else np.frombuffer(telephony.parse_wave(bytes(r.pcm))[3], "<i2").tolist() for r in rows}
    for name in ("no rate", "short header", "no data", "two channels", "other format", "24 bits", "empty"):
        assert got[name] is None, name
    assert got["8 bits"] == [-32768, 0, 32512] and got["no samples"] == []
    whole = scalar_ima(bytes(range(192))) + scalar_ima(bytes(range(60)))
    assert got["short block"][::2] == whole
    means = [[] for _ in range((len(pcm) - 1) * 16_000 // 44_100 + 1)]
    for i, x in enumerate(pcm.tolist()):
        means[i * 16_000 // 44_100].append(x)
    assert got["44.1 kHz"] == [sum(m) // len(m) for m in means] and len(got["cut data"]) == 27 * 16_000 // 44_100 + 1


# -- BPE ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path(bpe.VOCABULARY))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_bpe_equals_the_library(edge, small, library):
    for df in (edge, small):
        wanted = Counter()
        for i, t in pairs(df):
            ids = library.encode(t or "", add_special_tokens=False).ids
            shown = library.decode(ids, skip_special_tokens=False)
            wanted[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()] += 1
        shown = {(r.doc_id, bytes(r["ids"])): r.decoded for r in bpe.decode(bpe.encode(df)).collect()}
        assert set(shown.values()) == {t or "" for _, t in pairs(df)}
        rows = bpe.round_trip(df).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == wanted


def test_bpe_random_words(library):
    rnd = np.random.default_rng(4)
    encoder = bpe.BytePairEncoder(common.tokenizer_path(bpe.VOCABULARY))
    alphabets = ["abcdefgh", "etaoin shr", "áéß日　 x", "0123456789.,-", "'st re 'll", " \n\t\r  a"]
    texts = ["".join(rnd.choice([*alphabets[k % 6]], rnd.integers(1, 90))) for k in range(1500)]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.merged


def test_bpe_tables_against_dictionaries():
    rnd = np.random.default_rng(5)
    keys = np.unique(rnd.integers(0, 1 << 40, 5000))
    table = bpe.IntTable(keys, keys * 3, -7)
    asked = np.concatenate([keys, rnd.integers(0, 1 << 40, 5000)])
    known = dict(zip(keys.tolist(), (keys * 3).tolist(), strict=True))
    assert table.get(asked).tolist() == [known.get(a, -7) for a in asked.tolist()]


def test_bpe_tables_may_fill_up(small, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 20)
    texts = [t for _, t in pairs(small)][:60]
    encoder = bpe.BytePairEncoder(common.tokenizer_path(bpe.VOCABULARY))
    for k in range(0, 60, 7):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts[k : k + 7])]
        assert got == [e.ids for e in library.encode_batch(texts[k : k + 7], add_special_tokens=False)]


def test_bpe_no_rows(none):
    assert bpe.decode(bpe.encode(none)).count() == 0 and bpe.round_trip(none).count() == 0


# -- token counts ------------------------------------------------------------------------------------------


def test_counts_equal_the_library(edge, small, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(token_counts.MODEL))
    for df in (edge, small):
        wanted = Counter()
        for i, t in pairs(df):
            n = len(model.encode(t or ""))
            wanted[i, len((t or "").encode()), n, n > 4096] += 1
        assert Counter(tuple(r) for r in token_counts.token_counts(df).collect()) == wanted
    assert token_counts.token_counts(none).count() == 0


def test_counts_of_odd_spaces():
    import sentencepiece

    path = common.tokenizer_path(token_counts.MODEL)
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    rnd = np.random.default_rng(7)
    texts = ["".join(rnd.choice(["a", "bc", " ", "  ", "▁", "\n", "\t", "é", "日", "<s>", "</s>", " ", "."], rnd.integers(0, 30))) for _ in range(3000)]
    assert counter.counts(texts) == [len(model.encode(t)) for t in texts]
