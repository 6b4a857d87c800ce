import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import kernels as K
from cairn.operators import catalog as C
from cairn.operators import dedup as D
from cairn.operators import transforms as X


def lcg(seed, n):
    out = bytearray()
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**32
        out.append(seed >> 16 & 255)
    return bytes(out)


def plain_fnv(data, bits=64):
    h, p = K.FNV64 if bits == 64 else K.FNV32
    for b in data:
        h = (h ^ b) * p % 2**bits
    return h


def plain_chunks(data, bits, gear, least=None, most=None):
    bits, least, most = K.limits(bits, least, most)
    out, start = [], 0
    while start < len(data):
        h, end = 0, min(start + most, len(data))
        for i in range(start, end):
            h = (2 * h + int(gear[data[i]])) % 2**32
            if i - start >= least and h % 2**bits == 0:
                end = i + 1
                break
        out.append((start, end - start))
        start = end
    return out


@given(st.lists(st.binary(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_fnv_and_checksum(values):
    data = np.frombuffer(b"".join(values), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(int)
    for bits in (32, 64):
        assert K.fnv(data, at[:-1], np.diff(at), bits).tolist() == [plain_fnv(v, bits) for v in values]
    want = []
    for v in values:
        x = K.CHECKSUM
        for i, b in enumerate(v):
            x ^= b << (8 * (i % 2))
        want.append(x)
    assert K.checksum(data, at[:-1], np.diff(at)).tolist() == want


def test_known_hash():
    assert plain_fnv(b"ab") == 0x089C4407B545986A


@pytest.mark.parametrize("bits,least,most", [(8, None, None), (12, None, None), (13, 2048, 32768)])
def test_chunks_tile_and_match_a_sequential_model(bits, least, most):
    data = lcg(0xDEADBEEF, 60_000) + b"\xff" * 3000 + lcg(5, 1)
    v = np.frombuffer(data, np.uint8)
    rows, off, size = K.chunks(v, np.array([0, len(v)]), bits, least, most)
    got = list(zip(off.tolist(), size.tolist()))
    assert got == plain_chunks(data, bits, K.gear_table(), least, most)
    assert off[0] == 0 and (off[:-1] + size[:-1] == off[1:]).all() and off[-1] + size[-1] == len(data)


def test_chunk_lists_survive_a_shift():
    a, b = lcg(0xFEEDFACE, 100_000), None
    b = bytes(i ^ 0xAA & 255 for i in range(256)) * 32 + a
    parts = []
    for x in (a, b):
        v = np.frombuffer(x, np.uint8)
        _, off, size = K.chunks(v, np.array([0, len(v)]), 12)
        parts.append({x[o : o + n] for o, n in zip(off.tolist(), size.tolist())})
    assert len(parts[0] & parts[1]) > len(parts[0]) // 2


def test_compat_counts_a_chunk_that_ends_at_the_end_twice():
    assert K.cuts(100, np.array([99]), 64, 1024, compat=True) == [(0, 100), (0, 100)]
    assert K.cuts(100, np.array([99]), 64, 1024) == [(0, 100)]


def test_simhash_distances():
    fp = lambda b: K.simhash(np.frombuffer(b, np.uint8))
    far = lambda a, b: bin(fp(a) ^ fp(b)).count("1")
    assert far(b"the quick brown fox jumps over the lazy dog.", b"the quick brown fox leaps over the lazy dog.") <= 20
    assert far(b"A" * 200, b"Z" * 200) > 15
    data = lcg(0xDEADBEEF, 8192)
    assert far(data, data[:4096] + bytes(x ^ 255 for x in data[4096:4112]) + data[4112:]) <= 8
    assert fp(b"abc") == plain_fnv(b"abc")


@given(st.binary(max_size=300), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_transforms_round_trip(data, stride):
    assert X.bcj(X.bcj(data), True) == data
    assert X.unbwt(*X.bwt(data)) == data
    if len(data) > stride:
        assert X.undelta(X.delta(data, stride), stride) == data


def test_bcj_example():
    x = X.bcj(bytes.fromhex("E80A000000" "90" * 1 + "90" * 4))
    assert x[1:5] == (15).to_bytes(4, "little")


def test_best_stride():
    assert X.best_stride(bytes(i * 3 % 256 for i in range(3000))) == 1
    assert X.best_stride(random.Random(1).randbytes(2000)) == 0


def test_parity_repairs_one_sector_of_each_group():
    data = lcg(9, 512 * 450 + 77)
    s = X.sectors_of(data)
    g = X.groups_for(len(s))
    par = [np.bitwise_xor.reduce(s[i::g], axis=0).tobytes() for i in range(g)]
    hurt = bytearray(data)
    bad = [8 + i for i in range(g)]
    for i in bad:
        hurt[i * 512 : (i + 1) * 512] = bytes(512)
    assert g == 4 and X.repair(bytes(hurt), par, bad) == data


def test_globs(spark):
    df = spark.createDataFrame([(p,) for p in ("src/main.c", "src/lib/util.c", "src/lib/util.h", "README.txt")], "path string")
    pick = lambda p: sorted(r.path for r in C.select_paths(df, p).collect())
    assert pick("*.txt") == ["README.txt"] and pick("src/*.c") == ["src/main.c"]
    assert pick("src/lib/") == ["src/lib/util.c", "src/lib/util.h"] and pick("src/*/util.[ch]") == ["src/lib/util.c", "src/lib/util.h"]


def test_identify_and_content_type(spark):
    from pyspark.sql import functions as F

    rows = [("5543321A", 1, 0), ("5A495000", 0, 0), ("55433200", 0, 0), ("5543", -1, 0), ("4D5A9000", 0, 2), ("7F454C4601", 0, 2), (("hello text " * 9).encode().hex(), 0, 1), ("00" * 80, 0, 3)]
    df = spark.createDataFrame([(bytes.fromhex(h), a, b) for h, a, b in rows], "content binary, a int, b int")
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    for r in df.select("a", "b", C.identify(F.col("content")).alias("i"), C.content_type(head, F.length("content")).alias("t")).collect():
        assert (r.i, r.t) == (r.a, r.b)


def test_ingesting_twice_saves_everything(spark):
    docs = spark.createDataFrame([(1, lcg(7, 32_000)), (2, lcg(7, 32_000)), (3, b"")], "blob_id long, content binary")
    rows = {r.blob_id: r for r in D.ingested(D.chunked(docs, 12)).collect()}
    assert rows[2].n_new == 0 and rows[2].saved_bytes == 32_000 and rows[1].saved_bytes == 0 and 3 not in rows
    m = {r.blob_id: r for r in D.merkle(docs, 12).collect()}
    assert m[1].root == m[2].root and m[3].root == 0 and m[3].n_chunks == 0 and m[1].bytes == 32_000


def greedy(files, chunks_of):
    order = [(h, f) for f in sorted(files) if len(files[f]) >= D.MIN_FILE for h in chunks_of(files[f])]
    group, free = {}, set(files)
    for h, f in order:
        members = {x for y, x in order if y == h and x in free}
        if len(members) >= 2:
            place = next(i for i, (y, _) in enumerate(order) if y == h)
            for m in members:
                group[m] = place
            free -= members
    return group


def test_grouping_matches_the_greedy_rule(spark):
    rng = random.Random(4)
    pieces = [rng.randbytes(700) for _ in range(9)]
    files = {i: b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for i in range(24)}
    df = spark.createDataFrame(list(files.items()), "blob_id long, content binary")

    def hashes(data):
        v = np.frombuffer(data, np.uint8)
        _, off, size = K.chunks(v, np.array([0, len(v)]), 8)
        return [plain_fnv(data[o : o + n], 32) for o, n in zip(off.tolist(), size.tolist())]

    got = {}
    for r in D.grouped(df, 8, lambda x: x.checkpoint()).collect():
        if r.place:
            got.setdefault(tuple(r.place), set()).add(r.blob_id)
    want = {}
    for f, g in greedy(files, hashes).items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_grouping_resolves_chains_to_their_end(spark):
    """File i shares one piece with file i + 1 only, so about two files are settled in a round; short ones show the rounds alone."""
    piece = lambda i: random.Random(i).randbytes(4000)

    def chain(n):
        return {i: piece(i) + piece(i + 1) for i in range(n)}

    def hashes(data):
        v = np.frombuffer(data, np.uint8)
        _, off, size = K.chunks(v, np.array([0, len(v)]), 8)
        return [plain_fnv(data[o : o + n], 32) for o, n in zip(off.tolist(), size.tolist())]

    for n, few in ((600, 300_000), (24, 0)):
        df = spark.createDataFrame(list(chain(n).items()), "blob_id long, content binary")
        rows = D.grouped(df, 8, lambda x: x.checkpoint(), rounds=1, few=few).collect()
        got = {}
        for r in rows:
            got.setdefault(r.place and tuple(r.place), set()).add(r.blob_id)
        assert len(rows) == n and None not in got
        assert sorted(sorted(x) for x in got.values()) == [[i, i + 1] for i in range(0, n, 2)]
    want = {}
    for f, g in greedy(chain(24), hashes).items():
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, want.values())) == [[i, i + 1] for i in range(0, 24, 2)]


def test_registered_near_pairs_reach_six_bits(spark, tmp_path):
    from cairn.plans.catalogue import QUERIES

    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven wise owls look on "
    rng = random.Random(6)
    texts = [base * 3] + [(base * 3)[:k] + rng.choice("qzxj") * 3 + (base * 3)[k + 3 :] for k in range(5, 280, 7)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    fps = {}
    for r in D.fingerprints(D.blobs(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")).collect():
        fps[r.fp] = min(fps.get(r.fp, r.blob_id), r.blob_id)
    gap = lambda a, b: bin((a ^ b) % 2**64).count("1")
    near = {fps[a]: [gap(a, b) for b in fps if a != b and gap(a, b) <= 6] for a in fps}
    assert any(x > 3 for v in near.values() for x in v)
    got = QUERIES["near_dup_classes"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_links, r.nearest) for r in got} == {i: (len(v), min(v, default=None)) for i, v in near.items()} and sum(r.n_rows for r in got) == len(texts)


def test_long_values_are_hashed_without_a_step_for_each_byte():
    import time

    data = np.frombuffer(random.Random(1).randbytes(3_000_000), np.uint8)
    start = time.perf_counter()
    got = K.fnv(data, np.array([0, 5, 9]), np.array([2_999_000, 3, 0]))
    assert time.perf_counter() - start < 3 and got.tolist() == [K.fnv_on(K.FNV64[0], data[:2_999_000].tobytes()), plain_fnv(data[5:8].tobytes()), K.FNV64[0]]


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r.a, r.b) for r in D.near_pairs(spark.createDataFrame(list(enumerate(signed)), "blob_id long, fp long"), 4).collect()}
    rep = {f: fps.index(f) for f in fps}
    want = {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a in rep for b in rep if a != b and bin(a ^ b).count("1") <= 4}
    assert got == want


@pytest.mark.parametrize("block", [7, 60, 40_000])
def test_links_are_counted_by_blocks_without_rows_of_pairs(spark, monkeypatch, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(8)] + [2**64 - 1, 0]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(16)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "near_pairs", None)
    got = {r.rep: (r.n_rows, r.n_links, r.nearest) for r in D.near_classes(spark.createDataFrame(list(enumerate(signed)), "blob_id long, fp long")).collect()}
    gaps = {f: [bin(f ^ g).count("1") for g in set(fps) if g != f] for f in set(fps)}
    assert got == {fps.index(f): (fps.count(f), sum(x <= 6 for x in v), min((x for x in v if x <= 6), default=None)) for f, v in gaps.items()}
    assert D.near_classes(spark.createDataFrame([], "blob_id long, fp long")).count() == 0
