import datetime as dt

from pyspark.sql import functions as F

from cairn.operators import catalog as C
from cairn.operators import dedup as D


def test_running_sums_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.before for r in C.running_before(df, ["k"], F.col("o"), F.col("v"), "before", parts=8).collect()}
    assert len(got) == 1000
    for k, o, _ in rows[::37]:
        assert got[k, o] == sum(v for k2, o2, v in rows if k2 == k and o2 < o)
    assert C.running_before(df.limit(0), ["k"], F.col("o"), F.col("v"), "before").count() == 0


def test_versions_count_up_with_age(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("a", 3)], "name string, seq long")
    assert {(r.name, r.seq): r.version for r in C.versions(df, ["name"], "seq").collect()} == {("a", 5): 0, ("a", 3): 1, ("a", 1): 2, ("b", 2): 0}


def test_dos_functions(spark):
    rows = [(dt.datetime(1979, 5, 1), "dir/readme.text"), (dt.datetime(1999, 12, 31, 23, 59, 59), "archive.tar.gz"), (dt.datetime(2000, 2, 29, 1, 2, 4), "noext"), (dt.datetime(2010, 1, 1), ".hidden")]
    df = spark.createDataFrame(rows, "ts timestamp, path string")
    got = df.select("ts", C.dos_time(F.col("ts")).alias("n"), C.from_dos_time(C.dos_time(F.col("ts"))).alias("back"), C.dos_name(F.col("path")).alias("name"), C.display_name(C.dos_name(F.col("path"))).alias("shown")).collect()
    assert (got[0].n, got[0].back) == (0, None) and got[1].back == dt.datetime(1999, 12, 31, 23, 59, 58) and got[2].back == rows[2][0]
    assert [r.name for r in got] == ["README  TEX", "ARCHIVE GZ ".replace("ARCHIVE ", "ARCHIVE."), "NOEXT      ", "        HID"]
    assert [r.shown for r in got][0] == "readme.tex"


def test_small_functions(spark):
    r = spark.range(1).select(
        C.attributes(F.lit(32 + 16 + 1)).alias("a"), C.named(F.lit(-4), C.ERRORS, "Error").alias("e"), C.named(F.lit(77), C.LEVELS, "Tight").alias("l"), C.store_path(F.lit("abcdef0123456789")).alias("p"),
        C.from_cp850(F.unhex(F.lit("4181E1"))).alias("c"), C.file_type_key(F.lit("x/A1B2.C3")).alias("k"), C.file_type_key(F.lit("x/A1B2")).alias("k2")).first()
    assert tuple(r) == ("ad---r", "Damaged archive", "Tight", "ab/abcdef0123456789", "Aüß", "C#", "A#B")


def plain_chain(above, start):
    seen, at = [start], above[start]
    while at in above and at not in seen:
        seen.append(at)
        at = above[at]
    return (len(seen), True) if at in above else (len(seen) - 1, False)


def test_chains_and_circles(spark):
    rows = [(2, 1), (3, 2), (4, 5), (5, 4), (6, None), (7, 7), (8, 7), (9, 8), (10, 4), (11, 10)] + [(100 + i, 100 + (i + 1) % 13) for i in range(13)] + [(200 + i, 199 + i if i else 103) for i in range(30)]
    above = dict(rows)
    got = {r.id: (r.depth, r.cyclic) for r in C.chains(spark.createDataFrame(rows, "id long, master long")).collect()}
    assert got == {i: plain_chain(above, i) for i in above}
    assert C.chains(spark.createDataFrame([], "id long, master long")).count() == 0


def test_chains_of_any_depth_and_number(spark):
    deep = spark.range(5000).selectExpr("id", "case when id > 0 then id - 1 end as master")
    assert C.chains(deep).where("depth = id and not cyclic").count() == 5000
    many = spark.range(1, 2_000_001).selectExpr("id", "id div 2 as master")
    got = C.chains(many).selectExpr("count(*) n", "max(depth) d", "sum(depth) s", "bool_or(cyclic) c").first()
    assert tuple(got) == (2_000_000, 20, sum(k.bit_length() - 1 for k in range(1, 2_000_001)), False)


def test_paths_of_trees(spark):
    rows = [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 0, "d"), (5, 99, "lost"), (6, 5, "below"), (7, 8, "x"), (8, 7, "y")] + [(100 + i, 99 + i if i else 4, f"n{i}") for i in range(40)]
    got = {r.id: (r.path, r.depth) for r in C.full_paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    by, want = {i: (p, n) for i, p, n in rows}, {}
    for i in by:
        names, at = [], i
        while at in by and len(names) < 99:
            names.append(by[at][1])
            at = by[at][0]
        if at == 0:
            want[i] = "/".join(reversed(names)), len(names)
    assert got == want and 5 not in got and 7 not in got


def test_selection_by_names_with_versions(spark):
    df = spark.createDataFrame([("a/x", 0), ("a/x", 1), ("a/y", 0), ("b/x;1", 0), ("b/x", 1)], "path string, version int")
    take = lambda *names: sorted(tuple(r) for r in C.select_named(df, list(names)).collect())
    assert take("a/*") == [("a/x", 0), ("a/y", 0)] and take("a/x;1") == [("a/x", 1)] and take("a/*;*") == [("a/x", 0), ("a/x", 1), ("a/y", 0)]
    assert take("*/x;1", "a/y") == [("a/x", 1), ("a/y", 0), ("b/x", 1)] and take("b/x;1;0") == [("b/x;1", 0)] and take() == []


def test_filters_keep_marked_revisions(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 3, 0), ("b", 4, 0)], "path string, seq long, version long")
    marked = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("c", 0)], "path string, version long")
    assert {(r.path, r.seq, r.version) for r in C.keep_revisions(df, marked, ["path"], "seq").collect()} == {("a", 3, 0), ("a", 1, 1)}
    assert C.keep_revisions(df, marked.limit(0), ["path"], "seq").count() == 0


def test_keys_get_their_index_or_a_new_one(spark):
    known = spark.createDataFrame([(10, 2), (5, 7)], "key long, index long")
    asked = spark.createDataFrame([(5,), (9,), (None,), (3,), (9,), (12,)], "key long")
    assert {tuple(r) for r in C.numbered(known, asked, "key", "index").collect()} == {(5, 7, False), (3, 8, True), (9, 9, True), (12, 10, True)}
    assert {tuple(r) for r in C.numbered(known.limit(0), asked, "key", "index").collect()} == {(3, 2, True), (5, 3, True), (9, 4, True), (12, 5, True)}
    assert C.numbered(known, asked.limit(0), "key", "index").count() == 0


def test_lost_entries_go_to_the_root(spark):
    e = spark.createDataFrame([("a", 1), ("b", 9), ("c", 0)], "name string, dir_id long")
    d = spark.createDataFrame([(1, "src")], "id long, path string")
    assert {r.name: (r.dir_path, r.lost) for r in C.with_parent(e, d).collect()} == {"a": ("src", False), "b": ("", True), "c": ("", False)}


def test_selection_by_time(spark):
    df = spark.createDataFrame([("a", 1, 1, 2), ("a", 5, 2, 0), ("a", 5, 3, 0), ("b", 9, 4, 0)], "name string, time long, id long, attr int")
    assert {r.name: r.id for r in C.as_of(df, ["name"], "time", F.lit(5), "id").collect()} == {"a": 2}
    assert [r.id for r in C.select_flags(df, newer=F.lit(2), older=F.lit(9)).orderBy("id").collect()] == [2, 3]
    assert C.select_flags(df, without_attr=2).count() == 3
    mine = df.where("name = 'a' and time = 1")
    assert C.freshen(mine, df, "name", "time").count() == 2 and C.freshen(mine, df, "name", "time", only_known=False).count() == 3


def test_first_seen_with_a_store(spark):
    c = spark.createDataFrame([(1, 0, 7, 10), (1, 1, 8, 5), (2, 0, 7, 10), (2, 1, 7, 10), (2, 2, 9, 1)], "blob_id long, chunk_ix long, hash64 long, length long")
    known = spark.createDataFrame([(8,), (8,)], "hash64 long")
    assert sorted((r.blob_id, r.chunk_ix) for r in D.first_seen(c, "blob_id", "chunk_ix", store=known).where("is_new").collect()) == [(1, 0), (2, 2)]
    rows = {r.blob_id: r for r in D.ingested(c, known).collect()}
    assert (rows[1].n_new, rows[1].saved_bytes, rows[2].n_new, rows[2].stored_bytes) == (1, 5, 1, 1)
