import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.functions import codecs as K
from cairn.sources import archives as A
from cairn.streaming.store import BlockStore

R = random.Random(1)
CASES = [b"", b"A", b"Hi", bytes(1024), R.randbytes(1024), b"The quick brown fox jumps over the lazy dog. " * 41, bytes(i % 17 for i in range(4096)), bytes(range(256)) * 3, b"ab" * 300 + R.randbytes(50), R.randbytes(30_000)]


@pytest.mark.parametrize("data", CASES, ids=range(len(CASES)))
@pytest.mark.parametrize("level", [2, 4, 6, 9])
def test_block_codec(data, level):
    for matches in (True, False):
        for prefix in (b"", bytes(512), data[:700]):
            packed = K.compress(data, level, prefix, matches)
            assert K.decompress(packed, len(data), 10 if level >= 6 else level, prefix) == data


@given(st.binary(max_size=600), st.binary(max_size=600))
@settings(max_examples=60, deadline=None)
def test_lz4_and_delta(a, b):
    assert K.lz4_decompress(K.lz4_compress(a)) == a and len(K.lz4_compress(a)) <= K.lz4_bound(len(a))
    assert K.delta_apply(a, K.delta_encode(a, b)) == b and K.delta_apply(a, K.delta_encode(a, a)) == a


def test_sizes():
    assert K.lz4_compress(b"") == b"" and len(K.lz4_compress(b"x" * 4000)) < 1000
    big = R.randbytes(16_384)
    y = bytearray(big)
    for at, x in ((1000, 0xFF), (8000, 0xAA), (12_000, 0x55)):
        y[at : at + 32] = bytes(b ^ x for b in y[at : at + 32])
    assert 2 * len(K.delta_encode(big, bytes(y))) < len(y)
    for b, n in ((b"", 4), (b"Hi", 6), (b"Hello, World!\n", 18)):
        assert len(K.compress(b, 4, matches=False)) == K.literal_size(b) == n


@pytest.mark.parametrize("decode", [K.lz4_decompress, lambda b: K.delta_apply(b"abc", b), lambda b: K.decompress(b, 10, 4), lambda b: K.decompress(b, 10, 10), K.dict_deserialize])
def test_rubbish_is_damage(decode):
    for n in range(1, 200):
        try:
            decode(random.Random(n).randbytes(n))
        except K.Damaged:
            pass


def test_rans_table():
    for freq in ([100] * 8, [1000, 10, 5, 1], list(range(344)), [0, 7, 0]):
        f, c = K.rans_table(freq)
        assert sum(f) == 4096 and all((a > 0) == (b > 0) for a, b in zip(f, freq)) and all(c[i + 1] == c[i] + f[i] for i in range(len(f) - 1))
    syms = [R.choices(range(8), [50, 20, 10, 8, 5, 4, 2, 1])[0] for _ in range(1000)]
    import numpy as np

    f, c = K.rans_table(np.bincount(syms).tolist())
    packed = K.rans_encode(syms, f, c)
    p = np.bincount(syms) / 1000
    assert K.rans_decode(packed, 1000, f, c) == syms and len(packed) < 1.05 * -(p * np.log2(p)).sum() * 1000 / 8 + 4


def test_code_lengths_are_whole_and_limited():
    for most, freq in ((13, [2**i for i in range(20)]), (7, [1] * 15), (13, [0, 5, 0]), (13, [0] * 4), (4, [1, 1, 2, 3, 5, 8, 13, 21])):
        n = K.code_lengths(freq, most)
        assert max(n) <= most and sum(2.0**-x for x in n if x) == 1.0


def test_length_steps_are_orders():
    assert all(sorted(K.steps(p)) == list(range(14)) and K.steps(p)[0] == p for p in range(14))
    assert K.steps(8)[:4] == (8, 7, 9, 6) and K.steps(0)[1] == 13


def test_dictionary():
    d = K.dict_create(b"words")
    assert K.dict_deserialize(K.dict_serialize(d)) == d and K.dict_intact(d) and not K.dict_intact(d | {"data": b"wordz"})
    assert K.dict_create(b"words")["id"] == d["id"] != K.dict_create(b"other")["id"]


def test_digest():
    values = [R.randbytes(n) for n in (0, 1, 64, 65, 1024, 1025, 3000, 9000)]
    got = K.digests(values)
    assert got == [K.digests([v])[0] for v in values] and len(set(got)) == len(got)
    assert got[0].hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")  # of nothing the published value holds
    a = bytearray(values[-1])
    a[0] ^= 1
    assert 80 < sum(bin(x ^ y).count("1") for x, y in zip(got[-1], K.digests([bytes(a)])[0])) < 176


FILES = [("README.txt", b"hello", 5), ("src/main.c", b"int main;" * 200, 6), ("src/lib/a long name.c", b"", 0), ("src/lib/util.h", R.randbytes(700), 7)]


@pytest.mark.parametrize("level", [2, 5, 8])
def test_archive(level):
    z = A.build(FILES, {2: b"int main;" * 30}, [1, 2, 1, 2], level, "LABEL")
    rows = A.entries(z)
    assert [r["kind"] for r in rows] == ["master", "dir", "dir", "file", "file", "file", "file", "label"] and rows[-1]["name"] == "LABEL"
    files = [r for r in rows if r["kind"] == "file"]
    assert [A.extract(z, r, rows) for r in files] == [c for _, c, _ in FILES] and files[2]["name"] == "a long name.c" and files[2]["dos_name"] == "A LONG NC  "


def test_damaged_archives():
    z = bytearray(A.build(FILES))
    assert A.entries(b"")[0]["error"] == "truncated" and A.entries(bytes(40))[0]["error"] == "header"
    z[60] ^= 255
    rows = A.entries(bytes(z))
    bad = 0
    for r in rows:
        if r["kind"] == "file":
            try:
                A.extract(bytes(z), r, rows)
            except K.Damaged:
                bad += 1
    assert bad == 1
    z[26:28] = (204).to_bytes(2, "little")
    assert "version" in A.entries(bytes(z))[0]["error"]
    loop = [{"kind": "master", "id": 2, "master": 3, "offset": 29, "csize": 0, "size": 0, "method": 4, "csum": 0}, {"kind": "master", "id": 3, "master": 2, "offset": 29, "csize": 0, "size": 0, "method": 4, "csum": 0}]
    with pytest.raises(K.Damaged, match="dictionary"):
        A.extract(bytes(z), loop[0], loop)


def test_files_in_folders(spark, tmp_path):
    for name, content, _ in FILES:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    got = {r.name: bytes(r.content) for r in A.read_tree(spark, f"file://{tmp_path}").collect()}
    assert got == {n: c for n, c, _ in FILES if c}


def test_a_stream_ends_in_the_totals_of_one_ingest(spark, tmp_path):
    from cairn.operators import dedup as D

    data = R.randbytes(20_000)
    rows = [(1, data), (2, data[:9000] + b"x" + data[9000:]), (3, data)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "blob_id long, content binary").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    store = BlockStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("blob_id long, content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store.start(stream, str(tmp_path / "ck")).awaitTermination()
    got = store.stats().first()
    want = D.ingested(D.chunked(spark.createDataFrame(rows, "blob_id long, content binary"))).groupBy().sum("n_chunks", "n_new", "stored_bytes", "saved_bytes").first()
    assert tuple(got)[1:] == tuple(want) and got.blobs == 3
    store.ingest(spark.createDataFrame(rows[:1], "blob_id long, content binary"), 99)
    assert store.ingests().where("batch = 99").first().n_new == 0
    assert store.has(store.blocks().select("hash64").limit(3)).count() == 3


def test_foreign_archives_and_writing(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from cairn.sources import foreign as X

    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.txt", b"zip")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("c.txt")
        info.size = 3
        f.addfile(info, io.BytesIO(b"tar"))
    rows = [("z", z.getvalue()), ("t", t.getvalue()), ("x", b"neither"), ("cut", z.getvalue()[:30]), ("none", None)]
    got = X.read_foreign(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r.path, r.name, bytes(r.content)) for r in got if r.content} == {("z", "a/b.txt", b"zip"), ("t", "c.txt", b"tar")} and sum(r.error is not None for r in got) == 3
    files = spark.createDataFrame([("d/one", b"1"), ("../up", b"2"), ("two", None)], "name string, content binary")
    write = lambda **k: {r.name: r.state for r in X.write_files(files, f"file://{tmp_path}/out", **k).collect()}
    assert write() == {"d/one": "written", "../up": "refused", "two": "written"} and (tmp_path / "out/d/one").read_bytes() == b"1"
    assert write()["d/one"] == "kept" and write(overwrite=True)["d/one"] == "written"


def test_block_bytes_come_back(spark, tmp_path):
    data = R.randbytes(5000)
    store = BlockStore(spark, f"file://{tmp_path}/s")
    assert store.stats().first().blobs == 0
    store.ingest(spark.createDataFrame([(1, data)], "blob_id long, content binary"), 0)
    for r in store.blocks().collect():
        assert bytes(r.data) in data and store.read(f"{r.hash64 % 2**64:016x}") == bytes(r.data)
    assert store.read("0" * 16) is None


def test_sql_functions(spark):
    from cairn.functions.register import register

    assert "fnv64" in register(spark)
    r = spark.sql("SELECT fnv64(CAST('ab' AS BINARY)) AS h, lz4_unblock(lz4_block(CAST('aaaaaaaaaaaa' AS BINARY))) AS b, size(cdc_chunks(CAST('abc' AS BINARY))) AS n").first()
    assert r.h == 0x089C4407B545986A and bytes(r.b) == b"a" * 12 and r.n == 1


def plain_delta(data, stride):
    """With a ring of the last bytes, byte after byte."""
    ring, out = [0] * stride, bytearray()
    for i, b in enumerate(data):
        out.append((b - ring[i % stride]) % 256)
        ring[i % stride] = b
    return bytes(out)


@given(st.binary(max_size=300), st.integers(1, 8), st.lists(st.integers(0, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_delta_streams_in_any_pieces(data, stride, sizes):
    from cairn.functions.kernels import Delta

    pieces, at = [], 0
    for n in sizes:
        pieces.append(data[at : at + n])
        at += n
    pieces.append(data[at:])
    there, back = Delta(stride), Delta(stride)
    coded = [there.apply(p) for p in pieces]
    assert b"".join(coded) == plain_delta(data, stride) == K.delta(data, stride)
    assert b"".join(back.revert(p) for p in coded) == data == K.undelta(K.delta(data, stride), stride)


@pytest.mark.parametrize("method", [21, 25, 29, *range(30, 38), 40, 47])
def test_delta_methods(method):
    stride = 1 if method < 30 else (method - 30) % 10 + 1
    for data in CASES[:8]:
        for prefix in (bytes(512), CASES[5][:300]):
            _, packed, filtered = K.compress_delta(data, stride, 4, prefix)
            assert filtered == plain_delta(data, stride)
            assert K.decompress(packed, len(data), method, prefix) == data and K.decompress(packed, len(data), method, prefix, filtered=True) == filtered


@pytest.mark.parametrize("method", [0, 11, 20, 38, 39, 48, 49, 50, 80])
def test_methods_that_are_not_read(method):
    with pytest.raises(K.Damaged):
        K.decompress(K.compress(b"abc", 4), 3, method)


def test_archive_of_delta_streams():
    files = [(f"f{i}.bin", bytes((j * (i + 1) + j % 3) % 256 for j in range(600)), 0) for i in range(9)]
    made = A.build(files, {2: files[3][1]}, [2 if i % 2 else 1 for i in range(9)], strides=list(range(9)))
    known = A.entries(made)
    got = [e for e in known if e["kind"] == "file"]
    assert [e["method"] for e in got] == [4, *range(30, 38)] and [A.extract(made, e, known) for e in got] == [f[1] for f in files]
    assert [e["csum"] for e in got] == [A.csum(plain_delta(f[1], i) if i else f[1]) for i, f in enumerate(files)]


def test_archives_with_shared_dictionaries(spark):
    head = "".join(f"A shared line number {i} of a common head, {R.random()}.\n" for i in range(90)).encode()
    files = [("a.txt", head + b"a" * 60 + R.randbytes(700)), ("b.txt", head + R.randbytes(900)), ("c.txt", head + R.randbytes(300)), ("other.bin", R.randbytes(5000)), ("small.txt", head[:500]), ("empty", b"")]
    df = spark.createDataFrame([("one", n, c, 0) for n, c in files] + [("two", n, c, 0) for n, c in files[3:]], "archive string, name string, content binary, dos_time long")
    made = A.create(df, grouped=True, bits=8)
    listed = A.list_entries(made)
    assert [(r.path, r.id, r.ref_ctr, r.size) for r in listed.where("kind = 'master'").collect()] == [("one", 2, 3, len(files[1][1]))]
    assert {r.name: r.master for r in listed.where("kind = 'file' and path = 'one'").collect()} == {"a.txt": 2, "b.txt": 2, "c.txt": 2, "other.bin": 1, "small.txt": 1, "empty": 1}
    back = A.extract_files(made).where("error is null").join(listed.where("kind = 'file'").select("path", "seq", "name"), ["path", "seq"])
    assert sorted((r.path, r.name, bytes(r.content)) for r in back.collect()) == sorted([("one", *f) for f in files] + [("two", *f) for f in files[3:]])
    plain = A.create(df).collect()
    assert len(made.where("path = 'one'").first().content) < len(next(r for r in plain if r.path == "one").content)


def test_listing_reads_head_and_directory_only(spark, tmp_path):
    (tmp_path / "a dir%").mkdir()
    whole = A.build(FILES, level=5)
    (tmp_path / "a dir%" / "x.arc").write_bytes(whole)
    (tmp_path / "cut.arc").write_bytes(whole[:-3])
    (tmp_path / "short.arc").write_bytes(whole[:20])
    (tmp_path / "none.arc").write_bytes(b"")
    got = {}
    for r in A.list_archives(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(got) == ["cut.arc", "short.arc", "x.arc"] and got["short.arc"][0].error == "truncated" and got["cut.arc"][-1].kind == "error"
    assert {r.full_name: r.size for r in got["x.arc"] if r.kind == "file"} == {n: len(c) for n, c, _ in FILES}
    asked = []
    assert A.entries_at(lambda at, n: asked.append((at, n)) or whole[at : at + n], len(whole)) == A.entries(whole)
    assert len(asked) == 2 and sum(n for _, n in asked) < len(whole) - 700


def test_tags_are_dumped_and_reloaded(spark):
    from pyspark.sql import functions as F

    files = "archive string, name string, content binary, dos_time long, attr int, tags array<struct<tag:string,data:binary>>"
    rows = [("one", "d/a", b"1", 5, 1, [("AIP:note", b"x" * 3000), ("AIP:empty", b"")]), ("one", "b", b"2", 0, 0, None), ("two", "d/a", b"3", 0, 2, [])]
    made = A.create(spark.createDataFrame(rows, files))
    listed = A.list_entries(made)
    assert {(r.path, r.full_name): r.attr for r in listed.where("kind = 'file'").collect()} == {("one", "d/a"): 33, ("one", "b"): 32, ("two", "d/a"): 34}
    dump = A.dump_tags(listed)
    assert [(r.path, r["name"], r.tag, bytes(r.data)) for r in dump.orderBy("place").collect()] == [("one", "d/a", "AIP:note", b"x" * 3000), ("one", "d/a", "AIP:empty", b"")]
    plain = spark.createDataFrame([r[:4] for r in rows], "archive string, name string, content binary, dos_time long")
    again = A.create(A.reload_tags(plain, dump.select(F.col("path").alias("archive"), "name", "place", "tag", "data")))
    assert sorted(map(tuple, A.dump_tags(A.list_entries(again)).drop("seq", "path").collect())) == sorted(map(tuple, dump.drop("seq", "path").collect()))
    replaced = A.reload_tags(spark.createDataFrame(rows, files), spark.createDataFrame([("one", "d/a", 0, "AIP:new", b"n")], "archive string, name string, place int, tag string, data binary"))
    assert {(r.archive, r["name"]): [x.tag for x in r.tags] for r in replaced.collect()} == {("one", "d/a"): ["AIP:new"], ("one", "b"): [], ("two", "d/a"): []}


def test_extraction_gives_times_and_read_only(spark, tmp_path):
    import os
    import time

    from cairn.sources import foreign as X

    packed = (2001 - 1980 << 25) | 3 << 21 | 4 << 16 | 5 << 11 | 6 << 5 | 7
    then = time.mktime((2001, 3, 4, 5, 6, 14, 0, 0, -1))
    files = spark.createDataFrame([("d/e/f", b"1", packed, 1), ("g", b"2", 0, 0), ("/abs", b"3", 0, 0)], "name string, content binary, dos_time long, attr int")
    dirs = spark.createDataFrame([("d", packed), ("d/e", packed), ("empty/below", packed), ("../out", packed)], "name string, dos_time long")
    for restore in ("all", "files", "none"):
        root = tmp_path / restore
        got = {r.name: r.state for r in X.extract_tree(files, dirs, f"file://{root}", restore=restore).collect()}
        assert got == {"d/e/f": "written", "g": "written", "/abs": "refused", "d": "directory", "d/e": "directory", "empty/below": "directory", "../out": "refused"}
        assert (os.stat(root / "d/e/f").st_mtime == then) == (restore != "none") and (os.stat(root / "d/e/f").st_mode & 0o222 == 0) == (restore != "none")
        assert all((os.stat(root / d).st_mtime == then) == (restore == "all") for d in ("d", "d/e", "empty/below")) and os.stat(root / "g").st_mtime > then
    assert not (tmp_path / "out").exists()
    again = X.extract_tree(files, dirs, f"file://{tmp_path}/all", overwrite=True).where("state = 'written'").count()
    assert again == 2


def test_gear_tables_are_read():
    from cairn.functions import kernels as B

    table = B.gear_table("x")
    assert (B.read_gear("{" + ", ".join(f"0x{int(g):08X}" for g in table) + "};") == table).all()
    for bad in ("1 2 3", " ".join(["5000000000"] * 256)):
        with pytest.raises(ValueError):
            B.read_gear(bad)


def test_scripts_of_repeating_texts_are_short(spark, tmp_path):
    from compare import differences
    import duckdb

    from cairn.plans.codec_queries import QUERIES, SQL

    for x in (b"ab" * 500, b"x" * 401, b"one line and\n" * 90):
        y = x[: len(x) // 2] + b"another middle" + x[len(x) // 2 + 20 :]
        script = K.delta_encode(x, y)
        assert K.delta_apply(x, script) == y and 2 * len(script) < len(x)
    ends = [R.randbytes(500) for _ in range(4)]
    run = b"xyz" * 900
    a, b = ends[0] + run + ends[1], b"q" + ends[0] + ends[2] + run + ends[3] + ends[1][9:] + b"q"
    assert K.delta_apply(a, K.delta_encode(a, b)) == b and len(K.delta_encode(a, b)) < 1100
    rows = [(1, "ab" * 500), (2, None), (3, "x" * 401), (4, "kurz"), (5, "日本 " * 200)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(QUERIES["delta_script"](spark, str(tmp_path)), con, SQL["delta_script"]) == ""


def plain_tokens(data, prefix, tries):
    """Matches place after place, from a list of all places of three bytes."""
    text, places, out, i = prefix + data, {}, [], len(prefix)
    for k in range(len(text)):
        places.setdefault(text[k : k + 3], []).append(k)
    while i < len(text):
        best = back = 0
        for p in [p for p in places[text[i : i + 3]] if p < i][: -tries - 1 : -1]:
            n = 0
            while i - p <= K.MOST_DIST and n < K.MOST_LEN and i + n < len(text) and text[p + n] == text[i + n]:
                n += 1
            if n > best:
                best, back = n, i - p
        out.append((back, best) if best >= K.LEAST else (text[i], 0))
        i += max(1, best)
    return out


def test_matches_of_many_texts_are_those_of_each(monkeypatch):
    texts = [bytes(R.choices(b"abcd ", k=n)) for n in (0, 1, 2, 3, 700, 900)] + [b"x" * 700, bytes(600)]
    known = [b"", b"abc", bytes(512), b"d a", b"", b"abcd" * 20, b"x", bytes(9)]
    want = [[plain_tokens(x, p, t) for t in (4, 16)] for x, p in zip(texts, known)]
    for places in (K.PLACES, 100):
        monkeypatch.setattr(K, "PLACES", places)
        got = K.matched(list(zip(known, texts)), [4, 16])
        assert [[list(zip(*(v.tolist() for v in t))) for t in row] for row in got] == want
        assert list(K.compress_all(texts, [2, 9], known)) == [[K.compress(x, n, p) for n in (2, 9)] for x, p in zip(texts, known)]


def test_archives_of_short_files_take_no_step_for_each_byte():
    import time

    words = ["".join(R.choices("etaoinshrdlu", k=R.randint(2, 8))) for _ in range(500)]
    files = [(f"f{i}", " ".join(R.choices(words, k=5000)).encode(), 0) for i in range(10)]
    start = time.process_time()
    z = A.build(files)
    assert time.process_time() - start < 0.9
    rows = A.entries(z)
    assert [A.extract(z, r, rows) for r in rows if r["kind"] == "file"] == [c for _, c, _ in files]


def test_archives_are_written_once(spark, tmp_path, monkeypatch):
    from cairn.plans import codec_queries as Q

    spark.createDataFrame([(i, "text " * i) for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(Q.A, "list_entries", lambda df, f=Q.A.list_entries: made.append(df) or f(df))
    assert Q.archive_documents(spark, str(tmp_path)).count() == 30
    assert "FlatMapGroups" not in made[0]._jdf.queryExecution().toString()


def test_all_levels_of_a_text_take_no_step_for_each_try():
    import time

    words = ["".join(R.choices("etaoinshrdlu", k=R.randint(2, 8))) for _ in range(500)]
    data = " ".join(R.choices(words, k=9000)).encode()
    start = time.process_time()
    streams = [K.compress(data, n) for n in range(2, 10)]
    assert time.process_time() - start < 1.4
    assert all(K.decompress(z, len(data), 10 if n >= 6 else n) == data for n, z in zip(range(2, 10), streams))
