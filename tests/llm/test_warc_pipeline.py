import random
import sys
import zlib

import pytest
from compare import connection, differences
from pyspark.sql import functions as F

from cairn.llm import warc as W


def archive(gz, n=40):
    recs = [W.record(i, f"http://x/{i}", (f"page {i} " * (i * 37 % 50)).encode(), False, None) for i in range(n)]
    if gz:
        recs = [(lambda z: z.compress(r) + z.flush())(zlib.compressobj(6, wbits=31)) for r in recs]
    return recs


@pytest.mark.parametrize("gz", [True, False])
def test_salvage(gz):
    parts = archive(gz)
    data = b"".join(parts)
    assert [r["page_id"] for r in W.salvaged(data)] == list(range(40))
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p))
    rng = random.Random(2)
    for _ in range(150):
        b, p = bytearray(data), rng.randrange(len(data))
        i = max(k for k in range(40) if starts[k] <= p)
        kind = rng.choice(["flip", "cut", "insert", "end"])
        if kind == "flip":
            b[p] ^= 1 << rng.randrange(8)
        elif kind == "cut":
            del b[p : p + rng.randrange(1, 40)]
        elif kind == "insert":
            b[p:p] = rng.randbytes(rng.randrange(1, 60))
        else:
            del b[p:]
        hurt = set(range(i, 40)) if kind == "end" else {i - 1, i, i + 1}
        got = W.salvaged(bytes(b))
        assert set(range(40)) - {r.get("page_id") for r in got if r["record_type"] != "gap"} <= hurt
        at = 0
        for r in got:  # records and gaps tile the archive
            assert r["start"] == at
            at = r["end"]
        assert at == len(b)


def test_salvage_of_rubbish():
    assert W.salvaged(b"") == []
    got = W.salvaged(random.Random(1).randbytes(3_000_000))
    assert sum(r["end"] - r["start"] for r in got) == 3_000_000 and all(r["record_type"] == "gap" for r in got)


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    d, e = (str(tmp_path_factory.mktemp(x)) for x in ("pages", "nopages"))
    rows = [(i, f"http://h/{i}", ["same", "", None, "é ü", "x" * 500_000][i % 5] + str(i) * (i % 3 == 0) if i % 5 != 2 else None) for i in range(60)] + [(None, None, "lost"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit("x"))
    df.write.parquet(f"{d}/pages.parquet")
    df.limit(0).write.parquet(f"{e}/pages.parquet")
    return d, e


def test_warc_query(spark, sf_dir, pages):
    assert differences(W.warc_query(spark, sf_dir), connection(sf_dir), W.ORACLE) == ""
    got = {r.page_id: r for r in W.warc_query(spark, pages[0]).where("page_id is not null").collect()}
    assert len(got) == 60 and got[1].refers_to is None and got[7].refers_to == 1 and got[5].refers_to is None and got[10].refers_to == 5
    empty = sorted(i for i in got if got[i].payload_bytes == 0)
    assert got[empty[0]].record_type == "response" and all(got[i].refers_to == empty[0] for i in empty[1:])
    assert W.warc_query(spark, pages[0]).count() == 62
    assert W.warc_query(spark, pages[1]).count() == 0


def test_small_payloads_need_not_be_revisits(spark, pages):
    got = W.with_revisits(spark.read.parquet(f"{pages[0]}/pages.parquet"), revisit_from=1000)
    assert got.where("revisit and length(payload) < 1000").count() == 0 and got.where("revisit").count() > 0


def test_damaged_archive_is_read_on(spark, tmp_path):
    parts = archive(True)
    hurt = bytearray(b"".join(parts))
    hurt[len(parts[0]) + 40] ^= 255
    (tmp_path / "a.warc.gz").write_bytes(bytes(hurt))
    got = W.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    gap = [r for r in got if r.record_type == "gap"]
    assert len(gap) == 1 and (gap[0].start, gap[0].end) == (len(parts[0]), len(parts[0]) + len(parts[1])) and len(got) == 40


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema, name
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(before)
        if name != "personal_data":
            assert all(rows[i] == before[i] for i in rows)
        good = [i for i in before if labels.get(i) == 1]
        if name == "quality_classifier":
            assert sum(i in rows for i in good) >= 0.98 * len(good)
        if name == "near_duplicates":
            from test_texts import plain_components, plain_fp

            fps = [(i, plain_fp(r.text)) for i, r in before.items()]
            assert set(rows) == set(plain_components(fps))
        if name == "personal_data":
            from cairn.llm.pii import BASE, find

            assert set(rows) == set(before) and all(r.n_chars == len(r.text) for r in rows.values())
            assert not [s for r in rows.values() for s in find(r.text) if s[0] in BASE]
        docs, before = spark.createDataFrame(list(rows.values()), out.schema), rows
    packed = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert C.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    import corpus_pipeline as C

    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "cairn").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert sys
