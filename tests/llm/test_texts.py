import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import edit_sketch as E
from cairn.llm import licenses as L
from cairn.llm import packing as K
from cairn.llm import pii as P
from cairn.llm import sentencepiece_stream as Z
from cairn.llm import simhash as H

ODD = ["", " ", "a", "x" * 9000, "a b c d " * 3000, "日本語 テキスト", "😀 ñ é́ ß", " \x1c a\x85b\xa0c", "\n\n a\n", "<|endoftext|> a<|endoftext|>b It'S 12ab", "== ** ==" * 30, "©", "a © b©", "\t\t  b", "ﬁ Ⅷ ½"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names; and the same without rows."""
    d, e = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "none"))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "a"), (3, ODD[3]), (3, ODD[3]), (101, "mail me: a.b@c.example +1 (614) 555-8001")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("pii", "score", "fp", "key", "ids", "r", "guest", "n_chars", "component_id", "task", "digest", "lines"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{d}/documents.parquet")
    df.limit(0).write.parquet(f"{e}/documents.parquet")
    return d, e


# ---- licences

def test_license_texts(spark):
    mit = L.TEXTS["MIT"].split("\n", 1)[1]
    rows = [(1, "The MIT Licence\n\nCopyright (c) 2020 X\n" + mit.replace('"', "“")), (2, "Copyright 2020 Y. All rights reserved.\n" + L.TEXTS["BSD-3-Clause"].upper()), (3, None), (4, ""), (None, "(c) 1999 Z\n" + mit.replace(", ", " - ")), (6, mit + " x"), (7, "a\nReleased under the MIT Licence\n© 2001 Q")]
    got = {r.doc_id: r for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in (1, 2, 3, 4, None, 6)] == ["MIT", "BSD-3-Clause", None, None, "MIT", None]
    assert got[3].digest == got[4].digest == hashlib.sha256(b"").hexdigest()
    assert (got[7].n_notices, got[7].notices) == (1, "MIT")


def test_wrapped_and_titled_originals(spark):
    import os
    import textwrap

    wrap = lambda n, w: "\n".join(textwrap.fill(x, w) for x in L.TEXTS[n].split("\n"))
    isc = wrap("ISC", 72).replace("provided that the above copyright", "provided that the above\ncopyright")
    rows = [("ISC", "ISC License\n\nCopyright (c) 2020 X\n" + isc.split("\n", 1)[1]), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, Y\nAll rights reserved.\n\n" + wrap("BSD-3-Clause", 78)), ("Zlib", "zlib License\n\n(c) 2001 Z\n" + wrap("Zlib", 70)), ("BSD-2-Clause", "BSD 2-Clause License\nCopyright The Foo Authors\n" + L.TEXTS["BSD-2-Clause"])]
    isc_line = [x for x in isc.split("\n") if x.startswith("copyright notice")]
    assert isc_line
    at = "/usr/share/common-licenses"
    for n, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{at}/{f}"):
            rows.append((n, open(f"{at}/{f}", encoding="utf-8").read()))
    got = L.licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {i: n for i, (n, _) in enumerate(rows)}


def test_licenses_match_sql_and_have_no_python(spark, sf_dir, odd):
    from compare import connection, differences

    for d in (sf_dir, *odd):
        df = L.licenses_query(spark, d)
        assert differences(df, connection(d), L.ORACLE) == ""
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# ---- personal data

def plain_spans(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_spans_match_plain_patterns(texts):
    rng = random.Random(5)
    made = ["".join(rng.choice("a1.2@-3+ (0)5 4é%_9") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    made += ["a@b@c.d@e.f.g", "1.2.3.4.5.6.7.8", "300.1.2.3 1.2.3", "4111 1111-1111 1111", "+1 (614) 555-8001", "x@y.z." + "0" * 3000 + ".1.1.1", None, ""] + texts
    for t in made:
        assert [s for s in P.find(t) if s[0] in P.BASE] == plain_spans(t), t


def test_added_kinds_and_masking():
    t = 'see https://a.example/x?y=1. token = "04dbebab91ab85687d" mail x.y@z.example, IBAN: GB29NWBK60161331926819'
    kinds = [(k, t[s:e]) for k, s, e in P.find(t)]
    assert ("url", "https://a.example/x?y=1") in kinds and ("account", "04dbebab91ab85687d") in kinds and ("account", "GB29NWBK60161331926819") in kinds
    m = P.masked(t, P.find(t))
    assert "z.example" not in m and "[EMAIL]" in m and "04dbe" not in m and P.masked("clean", []) == "clean" and P.masked(None, []) is None


def test_account_values_are_masked_whole(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIxMjM0NTY3ODkwIn0." * 8 + "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    values = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "a1" * 150, jwt, "abCd/Ef+gh1234567890==", "12345678", "1234 5678 9012"]
    texts = [f"x IBAN: {values[0]} end", f"iban {values[1]}, y", f"secret={values[2]} z", f'token: "{values[3]}".', f"api_key = {values[4]}\nok", f"account number {values[5]}.", f"Account no. {values[6]}, w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in P.pii_stage(spark, docs, "").collect()}
    for i, (t, v) in enumerate(zip(texts, values)):
        assert out[i] == t.replace(v, "[ACCOUNT]"), out[i]
    for t in ("account of 2020 events", "the token is nice", "IBAN or not", "password: hunter"):
        assert P.masked(t, P.find(t)) == t


@pytest.mark.parametrize("cue", ["API Key", "api KEY", "PassWord", "ToKeN", "Account No", "aCCt", "IBan"])
def test_cues_of_any_case(cue):
    for before in ("", "İ x ", "Straße İİ "):
        t = f"{before}{cue}: abc12345 end"
        spans = [(k, t[s:e]) for k, s, e in P.find(t)]
        assert spans == [("account", "abc12345")] and P.masked(t, P.find(t)) == f"{before}{cue}: [ACCOUNT] end"
    assert [k for k, _, _ in P.find("see HttP://a.example/x")] == ["url"]


def test_masking_of_null_empty_and_long_texts(spark):
    secret, long = "t0ken" * 60, "word " * 200_000
    rows = [(1, None, 5), (2, "", 5), (3, long + "token: " + secret, 5), (4, "mail a.b@c.example, a.b@c.example", 5), (4, "mail a.b@c.example, a.b@c.example", 5), (None, "ip 10.0.0.1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("pii", F.lit("mine")).withColumn("spans", F.lit(1))
    out = P.pii_stage(spark, docs, "")
    assert out.schema == docs.schema and out.limit(0).count() == 0 and P.pii_stage(spark, docs.limit(0), "").count() == 0
    got = sorted(((r.doc_id or 0, r.text, r.n_chars, r.pii, r.spans) for r in out.collect()), key=str)
    want = [(0, "ip [IP]", 7, "mine", 1), (1, None, None, "mine", 1), (2, "", 0, "mine", 1), (3, long + "token: [ACCOUNT]", len(long) + 16, "mine", 1)] + [(4, "mail [EMAIL], [EMAIL]", 21, "mine", 1)] * 2
    assert got == sorted(want, key=str)


def test_pii_query(spark, odd):
    rows = P.pii_query(spark, odd[0]).collect()
    assert len(rows) == len(ODD) + 5
    r = next(r for r in rows if r.doc_id == 101)
    want = plain_spans("mail me: a.b@c.example +1 (614) 555-8001")
    assert (r.n_email, r.n_phone) == (1, 1) and r.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()
    assert P.pii_query(spark, odd[1]).count() == 0


# ---- packing

def test_encoder_matches_the_tokenizer(texts):
    path = K.default_tokenizer()
    all_texts = [*texts, *ODD, None]
    want = K.tokenizer(path).encode_batch([t or "" for t in all_texts], add_special_tokens=False)
    for most in (400_000, 50):
        K.MOST_WORDS, kept = most, K.MOST_WORDS
        try:
            got = list(K.Encoder(path)(all_texts))
        finally:
            K.MOST_WORDS = kept
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def check_packed(rows, window):
    seqs, docs = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    padding = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return seqs, docs, padding


def test_packing(spark, texts):
    path = K.default_tokenizer()
    all_texts = list(enumerate([*texts[:80], *ODD, None]))
    df = spark.createDataFrame(all_texts, "doc_id long, text string").repartition(5)
    _, docs, padding = check_packed(K.pack(df, path, window=512, open_windows=3, merged_tasks=2).collect(), 512)
    assert padding == 0
    want = K.tokenizer(path).encode_batch([t or "" for _, t in all_texts], add_special_tokens=False)
    for i, w in zip((i for i, _ in all_texts), want):
        parts = sorted(docs[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert ids == [*w.ids, 2] and [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
        assert {r.doc_tokens for r in parts} == {len(ids)}


def test_packing_query(spark, odd):
    rows = K.packing_query(spark, odd[0]).collect()
    assert sum(r.length for r in rows if r.doc_id == 100) == 1 and sum(r.doc_tokens for r in rows if r.doc_id == 3 and r.start == 0) == 3 * next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert next(r for r in rows if r.doc_id == 100).ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))
    assert K.packing_query(spark, odd[1]).count() == 0


def test_packing_stage_packs_every_row_whole(spark, odd):
    """Null, empty and long texts, equal rows, null ids and clashing names: each row's ids lie in pieces without gaps or overlaps."""
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    tok = K.load(K.default_tokenizer()) if hasattr(K, "load") else __import__("tokenizers").Tokenizer.from_file(K.default_tokenizer())
    want = sorted((str(r.doc_id), len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.select("doc_id", "text").collect())
    rows = K.packing_stage(spark, docs, odd[0]).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert K.packing_stage(spark, docs.limit(0), odd[0]).count() == 0


def test_packer_keeps_few_windows_open():
    out = []
    p = K.Packer(out.append, window=10, most=2)
    rng = random.Random(1)
    total = 0
    for i in range(500):
        n = rng.randint(1, 25)
        total += n
        p.place((i, 0, n, 0, b"abcd" * n))
        assert len(p.open) <= 2 and all(0 < w.used < 10 for w in p.open)
    rest = p.merged()
    assert all(sum(len(x[4]) for x in s) == 40 for s in out) and sum(len(x[4]) for s in out for x in s) + sum(len(x[4]) for x in rest) == 4 * total
    powers = []
    K.in_powers(rest, powers.append)
    sizes = [sum(len(x[4]) for x in s) // 4 for s in powers]
    assert sum(sizes) < 10 and all(n & (n - 1) == 0 for n in sizes)


# ---- SimHash

def plain_fp(t):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: (doc_id, fp) pairs; the least id reachable over links of 4 bits or fewer."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    v = np.array([f for _, f in fps], np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 4):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_golay_keys_find_every_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    for n in range(5):
        b = a.copy().view(np.uint64)
        for i in range(len(b)):
            for bit in rng.choice(64, n, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        (ra, ka), (rb, kb) = H.pair_keys(a), H.pair_keys(b.view(np.int64))
        assert {r for r, k in zip(rb.tolist(), kb.tolist())} and set(range(len(a))) == {r for r, k in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = []
    for b in base:
        for _ in range(8):
            fps.append(b)
            b ^= sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5)))  # chains
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in set(fps)]
    pairs = H.links(spark.createDataFrame(signed, "fp long"))
    uniq = sorted(set(fps))
    want = {frozenset((a, b)) for i, a in enumerate(uniq) for b in uniq[i + 1 :] if bin(a ^ b).count("1") <= 4}
    got = [frozenset((r.u % 2**64, r.v % 2**64)) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    comp = {r.node % 2**64: r.root for r in H.components(pairs).collect()}
    plain = dict(zip(uniq, plain_components([(i, f) for i, f in enumerate(uniq)])))
    groups = lambda m: sorted(sorted(f for f in comp if m[f] == r) for r in {m[f] for f in comp})
    assert groups(comp) == groups(plain)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1400)]
    got = {r.node: r.root for r in H.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 1000 for i in range(1000, 1400)) and len(got) == 501
    assert H.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_query(spark, sf_dir, odd):
    for d in (sf_dir, odd[0]):
        docs = [(r.doc_id, plain_fp(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        want = sorted((str(i), f"{f:016x}", str(c)) for (i, f), c in zip(docs, plain_components(docs)))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in H.simhash_query(spark, d).collect()) == want
    assert H.simhash_query(spark, odd[1]).count() == 0


def test_one_document_of_each_group_stays(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    out = H.simhash_stage(spark, docs, odd[0])
    comp = {r.doc_id: r.component_id for r in H.simhash_query(spark, odd[0]).collect()}
    ids = [r.doc_id for r in out.collect()]
    assert out.schema == docs.schema and sorted(i for i in ids if i is not None) == sorted({c for c in comp.values() if c is not None}) and ids.count(None) == 0


def test_the_stage_tells_rows_apart_not_ids(spark, sf_dir):
    x, y = ("alpha beta gamma delta " * 9).strip(), ("one two three four five six " * 9).strip()
    stay = lambda rows: sorted((r.doc_id, r.text) for r in H.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect())
    assert stay([(3, y), (5, x), (5, y), (9, x)]) == [(3, y), (5, x)]
    assert stay([(7, x), (7, y), (7, x)]) == sorted([(7, x), (7, y)])
    none = H.simhash_stage(spark, spark.createDataFrame([(None, x), (None, x), (None, y), (2, y), (None, None), (None, "")], "doc_id long, text string"), sf_dir)
    assert sorted(r.text or "" for r in none.collect()) == sorted(["", x, y])


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from cairn.llm import common as C

    left = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 40)) for i in range(n)], "k long, i long")
    right = C.materialise(left.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m")), "t")
    for hot in (10, 100, 1000):
        for limit in (0, 20_000):
            monkeypatch.setattr(C.bounded_join, "__defaults__", ("left", limit))
            got = C.skewed_join(left, right, "k", hot=hot)
            assert sorted(got.columns) == ["i", "k", "m"] and sorted((r.k, r.i, r.m) for r in got.collect()) == sorted((k, i, n - 1) for k, n in ((1, 500), (2, 3), (3, 40)) for i in range(n))


def test_components_leave_one_table(spark):
    from cairn.llm import common as C

    before = C.written()
    H.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"))
    assert C.written() == before + 1
    C.drop_tables(spark, before)
    assert C.written() == before


# ---- SentencePiece

def test_stream_matches_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Z.default_model())
    all_texts = [*texts, *ODD, " ▁ ", "the" * 2000, "=" * 300]
    encode, decode = Z.Encoder(Z.default_model()), Z.Decoder(Z.default_model())
    for t, want in zip(all_texts, sp.encode(all_texts, num_threads=1)):
        got = np.frombuffer(encode(t), "<i4").tolist()
        assert got == want
        if "▁" not in t:
            assert decode(got) == t


def test_stream_commits_early_and_in_any_division(texts):
    model = Z.model_of(Z.default_model())
    rng = random.Random(3)
    for t in [texts[0][:3000], "ab" * 2000, "x" * 3000, "日本" * 500]:
        t = "▁" + t.replace(" ", "▁")
        whole = Z.Stream(model)
        want = whole.push(t) + whole.finish()
        s, got, i, most = Z.Stream(model), [], 0, 0
        while i < len(t):
            n = rng.randint(1, 90)
            got += s.push(t[i : i + n])
            most = max(most, len(s.text))
            i += n
        assert got + s.finish() == want
    assert most <= 4 * Z.WINDOW


def test_sentencepiece_query(spark, odd):
    rows = Z.sentencepiece_query(spark, odd[0]).collect()
    assert len(rows) == len(ODD) + 5 and all(r.round_trip for r in rows) and next(r for r in rows if r.doc_id == 100).n_ids == 0
    assert Z.sentencepiece_query(spark, odd[1]).count() == 0


# ---- edit sketches

def plain_walk(text, start=0):
    moves = np.random.default_rng(E.SEED).random((E.CLASSES, 2 * E.PERIOD))[:, : E.PERIOD] < 0.5
    j, left = start, []
    for c in text:
        while not moves[ord(c) % E.CLASSES][j % E.PERIOD]:
            j += 1
        j += 1
        left.append(j)
    return left


def test_walk_matches_a_plain_one():
    t = "hello wörld, 日本 " * 400
    assert E.walk(E.codes_of(t)).tolist() == plain_walk(t)
    assert E.walk(E.codes_of(t), 4095).tolist() == plain_walk(t, 4095)


def plain_sketch(text):
    """The fingerprint from the embedded string itself, a character for each step, with whole numbers of Python."""
    codes = [ord(c) for c in text or ""]
    string, at = [], 0
    for c, left in zip(codes, plain_walk(text or "")):
        string += [c] * (left - at)
        at = left
    out, octave = b"", 0
    while 2**octave < len(string):
        start = np.sort(np.random.default_rng((E.SEED, octave)).integers(0, 2**octave, E.BANDS))
        for s in start.tolist():
            steps = [2**octave + s + d for d in ((0, 5, 11) if octave > 5 else (0, 0, 0))]
            a, b, c = (string[i] if i < len(string) else codes[-1] for i in steps)
            mix = (a * 0x9E3779B97F4A7C15 % 2**64) ^ (b * 0xC2B2AE3D27D4EB4F % 2**64 >> 7) ^ (c * 0x165667B19E3779F9 * 8 % 2**64)
            mix = (mix ^ mix >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            out += bytes([(mix >> 40) % 255 + 1 if steps[2] < len(string) else 0])
        octave += 1
    if not octave:
        return "00" + (hashlib.blake2b(np.array(codes, "<u4").tobytes(), digest_size=8).hexdigest() if codes else "")
    return f"{octave:02x}{out.hex()}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    if "00" in (x[:2], y[:2]):
        return 0.0
    a, b = bytes.fromhex(x[2:]), bytes.fromhex(y[2:])
    same = every = 0.0
    for i in range(max(len(a), len(b))):
        p, q = (v[i] if i < len(v) else 0 for v in (a, b))
        if p or q:
            every += 2.0 ** (i // E.BANDS)
            same += 2.0 ** (i // E.BANDS) * (p == q)
    return same / every


def test_sketches_match_brute_force(spark, sf_dir, odd):
    for d in (sf_dir, odd[0]):
        docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = []
        for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
            n = len(t)
            e = t[: n - n // 4] + nxt[: n // 4]
            a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(nxt)
            want.append((str(i), n, hashlib.sha256(e.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in E.sketch_query(spark, d).collect()]
        got.sort(), want.sort()
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-12)
    assert E.sketch_query(spark, odd[1]).count() == 0


def test_likeness_follows_edits(texts):
    t = max(texts, key=len)[:6000]
    near = E.likeness(E.fingerprint(t), E.fingerprint(t[:3000] + "xy" + t[3000:]))
    far = E.likeness(E.fingerprint(t), E.fingerprint(texts[1]))
    assert E.likeness(E.fingerprint(t), E.fingerprint(t)) == 1.0 and near > 0.4 > 0.2 > far
    assert set(E.band_keys(E.fingerprint(t))) & set(E.band_keys(E.fingerprint(t + "z")))


def plain_near(docs, least):
    """For each row its class, the class's rows, and the other classes that share a band row and are alike."""
    named = {}
    for i, t in docs:
        named.setdefault(E.fingerprint(t), []).append(i)
    keys = {f: {k for k in E.band_keys(f) if set(k.split(":")[-1]) != {"0"}} for f in named}
    like = {f: [v for g in named if g != f and keys[f] & keys[g] and (v := plain_likeness(f, g)) >= least] for f in named}
    rows = [(i, min((i for i in x if i is not None), default=None), len(x), len(like[f]), round(max(like[f], default=0.0), 9)) for f, x in named.items() for i in x]
    return sorted(rows, key=str)


def test_near_documents_match_brute_force(spark, texts, odd):
    rng = random.Random(8)
    base = [t for t in texts if len(t) > 600][:12]
    near = []
    for t in base:
        for _ in range(6):
            at = rng.randrange(len(t))
            near.append(t[:at] + rng.choice(["x", "", "two words "]) + t[at + rng.randint(0, 3) :])
    made = [*base, *texts[:60], *near, *near[:9], *ODD]
    docs = list(enumerate(made)) + [(None, base[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    want = plain_near(docs, 0.5)
    for tile in (512, 2):  # as one group, and with every row that three share split
        got = [(r.doc_id, r.class_id, r.n_copies, r.n_links, round(r.best_likeness, 9)) for r in E.near_documents(df, tile=tile).collect()]
        assert sorted(got, key=str) == want
    assert sum(r[3] > 0 for r in want) > 40
    assert E.near_query(spark, odd[1]).count() == 0 and E.near_query(spark, odd[0]).count() == len(ODD) + 5


def test_bands_find_nine_of_ten_links():
    """Every row whose id is divisible by 50, and an edited copy of it, against all rows."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 2500).to_pydict()
    fps = {i: E.fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"])}
    made = [E.fingerprint(t[: len(t) // 2] + " inserted words " + t[len(t) // 2 :]) for i, t in zip(docs["doc_id"], docs["text"]) if i % 50 == 0]
    known = {f: set(E.search_keys(f)) for f in {*fps.values(), *made}}
    found = every = 0
    for f in {*made, *(f for i, f in fps.items() if i % 50 == 0)}:
        for g in known:
            if f != g and f[:2] != "00" and abs(int(f[:2], 16) - int(g[:2], 16)) < 2 and E.likeness(f, g) >= E.LEAST:
                every += 1
                found += bool(known[f] & known[g])
    assert every >= 20 and found >= 0.9 * every




def test_components_are_written_in_few_files(spark, monkeypatch):
    from cairn.llm import simhash

    files = {}

    def counted(df, label, f=simhash.materialise):
        out = f(df, label)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    rows = [(3 * i, f"the words of line {i % 400} and as many of {i % 400 // 2} as there are") for i in range(1200)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {n for label in ("nodes", "star", "rooted", "least", "named") for n in files[label]} <= {0, 1}
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    of = {f: f for f in fps.values()}
    while True:
        new = {f: min(of[g] for g in of if bin(f ^ g).count("1") <= simhash.DISTANCE) for f in of}
        if new == of:
            break
        of = new
    least = {}
    for i, f in fps.items():
        least[of[f]] = min(least.get(of[f], i), i)
    assert {r.doc_id: r.component_id for r in got} == {i: least[of[f]] for i, f in fps.items()}
