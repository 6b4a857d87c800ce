"""Archives as tables: a writer, a reader of entries, and extraction with checks.

An archive has a head of 29 bytes, the files' and dictionaries' compressed data, and a compressed central
directory at its end: records of dictionaries, directories, files (each with its long name as a tag), and
a tail with a label. Listing reads the head and the directory alone; data are decompressed on extraction.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, kernels
from ..functions.kernels import checksum
from ..operators import dedup

#: Fixed values of the format.
HEAD, HEAD_SUM, NEEDS, MADE_BY, NEWEST = 0x1A324355, 0x01B2C3D4, 200, 203, 203
DIR, FILE, MASTER, END = 1, 2, 3, 4
NONE, DEFAULT_MASTER, ANY_MASTER = 1, 0, 0xDEDEDEDE
LONG_NAME = b"AIP:Win95 LongN\0"
DIR_BIT, FILE_BIT = 0x10, 0x20
OS_META, FILE_META, COMPRESS, LOCATION, MASTER_META, TAG, TAIL = (struct.Struct(x) for x in ("<IBI11sBB", "<IH", "<IHI", "<II", "<IIIIHH", "<16sIB", "<BBI11sI"))
NO_MASTER = bytes(512)

L, S, B = T.LongType(), T.StringType(), T.BooleanType()
ENTRY = T.StructType([T.StructField(n, t) for n, t in (
    ("seq", L), ("kind", S), ("dir_id", L), ("id", L), ("name", S), ("dos_name", S), ("attr", L), ("dos_time", L), ("size", L), ("csize", L), ("csum", L), ("method", L), ("master", L),
    ("offset", L), ("tags", T.ArrayType(T.StructType([T.StructField("tag", S), T.StructField("data", T.BinaryType())]))), ("ref_len", L), ("ref_ctr", L), ("full_name", S), ("error", S))])


def csum(data: bytes) -> int:
    return int(checksum(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))[0])


def dos_name(name: str) -> bytes:
    stem, dot, ext = name.upper().rpartition(".")
    stem, ext = (stem, ext) if dot else (ext, "")
    return (stem[:8].ljust(8) + ext[:3].ljust(3)).encode("ascii", "replace")[:11]


def build(files: list[tuple[str, bytes, int]], masters: dict[int, bytes] | None = None, assigned: list[int] | None = None, level: int = 4, label: str = "", strides: list[int] | None = None, tags: list[list[tuple[str, bytes]]] | None = None, attrs: list[int] | None = None) -> bytes:
    """An archive of (path, content, dos_time) with dictionaries (index from 2 on) and each file's index (1: none), delta stride (0: none), tags and attributes."""
    masters, assigned = masters or {}, assigned or [NONE] * len(files)
    method = codecs.METHOD_RANS if level >= 6 else level
    data, at = bytearray(29), {}
    records: list[bytes] = []
    for index, content in sorted(masters.items()):
        packed = codecs.compress(content, level, NO_MASTER)
        used = [len(c) for (_, c, _), m in zip(files, assigned) if m == index]
        key = codecs.dict_create(content)["checksum"]
        records.append(bytes([MASTER]) + MASTER_META.pack(index, key, sum(used), len(used), len(content), csum(content)) + COMPRESS.pack(len(packed), method, NONE) + LOCATION.pack(1, len(data)))
        data += packed

    def tag(name: str, others: list[tuple[str, bytes]] = ()) -> bytes:
        pairs = [(LONG_NAME, name.encode() + b"\0"), *((t.encode("latin-1", "replace")[:15], v) for t, v in others)]
        return b"".join(TAG.pack(t, len(v), n < len(pairs)) + v for n, (t, v) in enumerate(pairs, 1))

    for path in sorted({p.rsplit("/", i)[0] for p, _, _ in files for i in range(1, p.count("/") + 1)}, key=lambda p: (p.count("/"), p)):
        parent, _, name = path.rpartition("/")
        at[path] = len(at) + 1
        records.append(bytes([DIR]) + OS_META.pack(at.get(parent, 0), DIR_BIT, 0, dos_name(name), 0, 1) + struct.pack("<I", at[path]) + tag(name))
    none = [0] * len(files)
    plain = [i for i, stride in enumerate(strides or none) if not stride]
    streams = dict(zip(plain, codecs.compress_all([files[i][1] for i in plain], [level], [masters.get(assigned[i], NO_MASTER) for i in plain])))
    for number, ((path, content, time), index, stride, others, attr) in enumerate(zip(files, assigned, strides or none, tags or [()] * len(files), attrs or none)):
        parent, _, name = path.rpartition("/")
        prefix = masters.get(index, NO_MASTER)
        how, packed, summed = codecs.compress_delta(content, stride, min(level, 5), prefix) if stride else (method, streams[number][0], content)
        records.append(bytes([FILE]) + OS_META.pack(at.get(parent, 0), FILE_BIT | attr, time, dos_name(name), 0, 1) + FILE_META.pack(len(content), csum(summed)) + COMPRESS.pack(len(packed), how, index) + LOCATION.pack(1, len(data)) + tag(name, others))
        data += packed
    raw = b"".join(records) + bytes([END]) + TAIL.pack(0, 0, 0, label.encode()[:11].ljust(11), 0)
    place = len(data)
    data += COMPRESS.pack(0, method, NONE) + codecs.compress(raw, level, NO_MASTER)
    size = len(data) - 13
    struct.pack_into("<IIIBIIHBHHB", data, 0, HEAD, size, (size + HEAD_SUM) & 0xFFFFFFFF, 0, 1, place, csum(raw), 0, MADE_BY, NEEDS, 0)
    return bytes(data)


Read = Callable[[int, int], bytes]


def directory(read: Read, length: int) -> bytes:
    """The decompressed central directory, checked; read(at, n) gives n bytes of an archive of this length."""
    start = read(0, 29)
    if len(start) < 29:
        raise codecs.Damaged("truncated")
    head, size, again, _, volume, place, total, _, _, needs, _ = struct.unpack_from("<IIIBIIHBHHB", start)
    if head != HEAD or again != (size + HEAD_SUM) & 0xFFFFFFFF or volume != 1 or place >= size + 13:
        raise codecs.Damaged("header")
    if needs > NEWEST:
        raise codecs.Damaged(f"version {needs}")
    if place + COMPRESS.size > length:
        raise codecs.Damaged("truncated")
    packed = read(place, length - place)
    _, method, master = COMPRESS.unpack_from(packed)
    if master != NONE:
        raise codecs.Damaged("directory")
    raw = codecs.decompress(packed[COMPRESS.size :], None, method, NO_MASTER)
    if csum(raw) != total:
        raise codecs.Damaged("checksum")
    return raw


def entries(archive: bytes) -> list[dict]:
    return entries_at(lambda at, n: archive[at : at + n], len(archive))


def entries_at(read: Read, length: int) -> list[dict]:
    """Records in order; a broken archive ends in one of kind `error`."""
    out: list[dict] = []
    blank = dict.fromkeys(ENTRY.names)
    try:
        raw, i = directory(read, length), 0
        while raw[i] != END:
            kind, i = raw[i], i + 1
            row = blank | {"seq": len(out), "tags": []}
            if kind == MASTER:
                index, _, ref_len, ref_ctr, size, total = MASTER_META.unpack_from(raw, i)
                csize, method, master = COMPRESS.unpack_from(raw, i + 20)
                out.append(row | {"kind": "master", "id": index, "size": size, "csum": total, "csize": csize, "method": method, "master": DEFAULT_MASTER if master == ANY_MASTER else master,
                                  "offset": LOCATION.unpack_from(raw, i + 30)[1], "ref_len": ref_len, "ref_ctr": ref_ctr})
                i += 38
                continue
            if kind not in (DIR, FILE):
                raise codecs.Damaged("record")
            parent, attr, time, short, _, more = OS_META.unpack_from(raw, i)
            i += OS_META.size
            row |= {"dir_id": parent, "attr": attr, "dos_time": time, "dos_name": short.replace(b"\0", b" ").decode("cp850")}
            if kind == DIR:
                row |= {"kind": "dir", "id": struct.unpack_from("<I", raw, i)[0], "size": 0, "csize": 0}
                i += 4
            else:
                size, total = FILE_META.unpack_from(raw, i)
                csize, method, master = COMPRESS.unpack_from(raw, i + 6)
                row |= {"kind": "file", "id": 0, "size": size, "csum": total, "csize": csize, "method": method, "master": master, "offset": LOCATION.unpack_from(raw, i + 16)[1]}
                i += 24
            stem, ext = row["dos_name"][:8].rstrip(), row["dos_name"][8:].rstrip()
            row["name"] = (stem + ("." + ext if ext else "")).lower()
            while more:
                name, size, more = TAG.unpack_from(raw, i)
                value = raw[i + TAG.size : i + TAG.size + size]
                i += TAG.size + size
                row["tags"].append({"tag": name.split(b"\0")[0].decode("latin-1"), "data": value})
                if name == LONG_NAME:
                    row["name"] = value.split(b"\0")[0][:300].decode("utf-8", "replace")
            out.append(row)
        label = TAIL.unpack_from(raw, i + 1)[3].split(b"\0")[0].rstrip().decode("cp850")
        out.append(blank | {"seq": len(out), "kind": "label", "name": label, "tags": []})
    except (codecs.Damaged, struct.error, IndexError) as e:
        out.append(blank | {"seq": len(out), "kind": "error", "error": str(e), "tags": []})
    dirs = {e["id"]: e for e in out if e["kind"] == "dir"}
    for e in out:
        if e["kind"] in ("dir", "file"):  # a circle, or a directory that is not there, ends at the root
            names, up, seen = [e["name"]], e["dir_id"], set()
            while up in dirs and up not in seen:
                seen.add(up)
                names.append(dirs[up]["name"])
                up = dirs[up]["dir_id"]
            e["full_name"] = "/".join(reversed(names))
    return out


def extract(archive: bytes, entry: dict, known: list[dict], above: tuple[int, ...] = ()) -> bytes:
    """The content of a file or dictionary; its dictionary is resolved first, a circle or a missing one is damage."""
    master = entry["master"]
    if master == NONE:
        prefix = NO_MASTER
    elif master == DEFAULT_MASTER:
        raise codecs.Damaged("the built-in dictionary is not available")
    else:
        found = next((e for e in known if e["kind"] == "master" and e["id"] == master), None)
        if found is None or master in above:
            raise codecs.Damaged("dictionary")
        prefix = extract(archive, found, known, (*above, master))
    data = codecs.decompress(archive[entry["offset"] : entry["offset"] + entry["csize"]], entry["size"], entry["method"], prefix, filtered=True)
    if csum(data) != entry["csum"]:  # of the bytes in the stream, before a delta is undone
        raise codecs.Damaged("checksum")
    stride = codecs.stride_of(entry["method"])
    return codecs.undelta(data, stride) if stride else data


def entry_arrays(lists: list[list[dict]]) -> pa.Array:
    kinds = {S: pa.string(), L: pa.int64()}
    t = pa.struct([(f.name, pa.list_(pa.struct([("tag", pa.string()), ("data", pa.binary())])) if f.name == "tags" else kinds[f.dataType]) for f in ENTRY])
    return pa.array(lists, pa.list_(t))


@F.arrow_udf(T.ArrayType(ENTRY))
def entry_list(v: pa.Array) -> pa.Array:
    return entry_arrays([entries(x or b"") for x in v.to_pylist()])


@F.arrow_udf(T.ArrayType(ENTRY))
def entry_list_at(paths: pa.Array, lengths: pa.Array) -> pa.Array:
    from pyarrow import fs

    out = []
    for path, length in zip(paths.to_pylist(), lengths.to_pylist()):
        system, at = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", path)), safe=":/@"))
        with system.open_input_file(at) as f:

            def read(place: int, n: int, f=f) -> bytes:
                f.seek(place)
                return f.read(n)

            out.append(entries_at(read, length))
    return entry_arrays(out)


EXTRACTED = T.StructType([T.StructField("seq", L), T.StructField("content", T.BinaryType()), T.StructField("error", S)])


@F.arrow_udf(T.ArrayType(EXTRACTED))
def extracted_list(v: pa.Array) -> pa.Array:
    out = []
    for x in v.to_pylist():
        known, rows = entries(x or b""), []
        for e in known:
            if e["kind"] == "file":
                try:
                    rows.append({"seq": e["seq"], "content": extract(x, e, known), "error": None})
                except codecs.Damaged as err:
                    rows.append({"seq": e["seq"], "content": None, "error": str(err)})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("seq", pa.int64()), ("content", pa.binary()), ("error", pa.string())])))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path and content of archives or files anywhere Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def list_entries(archives: DataFrame) -> DataFrame:
    """A row for each record of each archive (columns path, content)."""
    return archives.select("path", F.explode(entry_list("content")).alias("e")).select("path", "e.*")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """The rows of list_entries for all archives below a path, of which only heads and directories are read: whatever the
    archives' size, a task holds one directory. For stores that Arrow's file systems know; for others scan() and list_entries."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    return found.select("path", F.explode(entry_list_at("path", "length")).alias("e")).select("path", "e.*")


def dump_tags(listed: DataFrame) -> DataFrame:
    """The tags of listed entries but for their long names: a row for each, in order."""
    tags = listed.where("kind in ('file', 'dir')").select("path", "seq", F.col("full_name").alias("name"), F.posexplode("tags").alias("place", "t"))
    return tags.select("path", "seq", "name", "place", "t.tag", "t.data").where(F.col("tag") != LONG_NAME.rstrip(b"\0").decode())


def reload_tags(files: DataFrame, dump: DataFrame) -> DataFrame:
    """Files (archive, name, ...) with column tags: those of a dump (archive, name, place, tag, data) in place of all that a
    file had; files that the dump does not name keep theirs."""
    new = dump.groupBy("archive", "name").agg(F.array_sort(F.collect_list(F.struct("place", "tag", "data"))).alias("__new"))
    new = new.withColumn("__new", F.transform("__new", lambda t: F.struct(t["tag"].alias("tag"), t["data"].alias("data"))))
    none = F.array().cast("array<struct<tag:string,data:binary>>")
    own = [F.col("tags")] if "tags" in files.columns else []
    return files.join(new, ["archive", "name"], "left").withColumn("tags", F.coalesce("__new", *own, none)).drop("__new")


def extract_files(archives: DataFrame) -> DataFrame:
    return archives.select("path", F.explode(extracted_list("content")).alias("e")).select("path", "e.*")


def dictionaries(contents: list[bytes], bits: int = 12) -> tuple[dict[int, bytes], list[int]]:
    """Dictionaries (index from 2 on) for files that share chunks, and each file's index (1: none): the greedy rule of
    dedup.grouped, and of each group the head of its largest file, the first of equals."""
    large = [i for i, c in enumerate(contents) if len(c) >= dedup.MIN_FILE]
    data = np.frombuffer(b"".join(contents[i] for i in large), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(contents[i]) for i in large])]).astype(np.int64)
    row, at, size = kernels.chunks(data, ends, bits)
    first: dict[int, tuple[int, int]] = {}
    held = set()
    for n, (r, h) in enumerate(zip(row.tolist(), kernels.fnv(data, ends[row] + at, size, 32).tolist())):
        held.add((first.setdefault(h, (large[r], n)), large[r]))
    found = dedup.settled(list(held))
    number = {place: i for i, place in enumerate(sorted({p for _, p in found}), 2)}
    assigned, heads = [NONE] * len(contents), {}
    for i, place in sorted(found):
        assigned[i] = n = number[place]
        if len(contents[i]) > len(heads.get(n, b"")):
            heads[n] = contents[i]
    return {n: c[: dedup.MAX_MASTER] for n, c in heads.items()}, assigned


def create(files: DataFrame, level: int = 4, grouped: bool = False, bits: int = 12) -> DataFrame:
    """One archive (path, content) for each value of column archive, from rows (archive, name, content, dos_time)
    and, where there are such columns, tags (structs of tag and data) and attr.

    grouped: files that share chunks share a dictionary. An archive is one file, made by one task: what goes into one is
    for the caller to bound."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["name"])
        shared = dictionaries([r["content"] for r in rows], bits) if grouped else (None, None)
        tags = [[(x["tag"], x["data"] or b"") for x in r.get("tags") or ()] for r in rows]
        made = build([(r["name"], r["content"], r["dos_time"]) for r in rows], *shared, level=level, tags=tags, attrs=[r.get("attr") or 0 for r in rows])
        return pa.table({"path": [rows[0]["archive"]], "content": pa.array([made], pa.binary())})

    return files.groupBy("archive").applyInArrow(run, "path string, content binary")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder as rows (name relative to it, content, size, time). Spark's scan leaves out empty files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").rstrip("/")
    name = F.regexp_replace("path", "^[a-z]+:/*" + base.lstrip("/").replace(".", "\\.") + "/", "")
    return df.select(name.alias("name"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("time"))
