"""Archives of other formats (zip, tar with any compression) as rows, and files written from rows."""

from __future__ import annotations

import io
import os
import tarfile
import time
import zipfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import written

MEMBER = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
WRITTEN = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("state", T.StringType())])


def kind_of(data: bytes) -> str:
    """By content, not by name: zip, tar or other."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[257:262] == b"ustar" or data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\0":
        return "tar"
    return "other"


def members(data: bytes) -> list[dict]:
    """Files in an archive; damage and unknown formats end in a row with an error."""
    out: list[dict] = []
    try:
        kind = kind_of(data)
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                out += ({"name": i.filename, "content": z.read(i), "error": None} for i in z.infolist() if not i.is_dir())
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                out += ({"name": m.name, "content": t.extractfile(m).read(), "error": None} for m in t if m.isfile())
        else:
            out.append({"name": None, "content": None, "error": "unknown format"})
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError) as e:
        out.append({"name": None, "content": None, "error": str(e)})
    return out


@F.arrow_udf(T.ArrayType(MEMBER))
def member_list(v: pa.Array) -> pa.Array:
    return pa.array([members(x or b"") for x in v.to_pylist()], pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])))


def read_foreign(archives: DataFrame) -> DataFrame:
    """A row for each file of each archive (columns path, content)."""
    return archives.select("path", F.explode(member_list("content")).alias("m")).select("path", "m.*")


READ_ONLY = 1


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def refused(name: str | None) -> bool:
    """Whether a name is none, absolute, or climbs out of the folder."""
    return not name or name.startswith("/") or ".." in name.split("/")


def set_attributes(system, place: str, dos_time: int | None, attr: int | None = 0) -> None:
    """The time (local, as packed numbers have it; 0: left alone) and the read-only bit; only local files have them."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        return
    n = dos_time or 0
    if n:
        at = time.mktime((1980 + (n >> 25), n >> 21 & 15, n >> 16 & 31, n >> 11 & 31, n >> 5 & 63, n << 1 & 62, 0, 0, -1))
        os.utime(place, (at, at))
    if (attr or 0) & READ_ONLY:
        os.chmod(place, 0o444)


def write_files(files: DataFrame, folder: str, overwrite: bool = False, restore: bool = False) -> DataFrame:
    """Writes rows (name, content) below a folder that all executors reach; what became of each: written, or kept if there already.

    Names that are absolute or climb out of the folder are refused. A file is written beside its place and
    then moved, so a repeated task does no harm. restore: columns dos_time and attr give its time and whether it is
    read-only. Nothing happens until the result is used."""

    def run(batches):
        from pyarrow import fs

        system, base = file_system(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                name, content = r["name"], r["content"] or b""
                if refused(name):
                    rows.append({"name": name, "size": None, "state": "refused"})
                    continue
                place = f"{base}/{name}"
                if not overwrite and system.get_file_info(place).type != fs.FileType.NotFound:
                    rows.append({"name": name, "size": None, "state": "kept"})
                    continue
                system.create_dir(place.rpartition("/")[0], recursive=True)
                beside = f"{place}.part-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(beside, compression=None) as out:
                    out.write(content)
                if restore:
                    set_attributes(system, beside, r["dos_time"], r["attr"])
                system.move(beside, place)
                rows.append({"name": name, "size": len(content), "state": "written"})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("size", pa.int64()), ("state", pa.string())]))

    return files.select("name", "content", *(["dos_time", "attr"] if restore else [])).mapInArrow(run, WRITTEN)


def _each_dir(dirs: DataFrame, folder: str, times: bool) -> DataFrame:
    """Directories (name, dos_time) made, or given their times."""

    def run(batches):
        system, base = file_system(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if refused(r["name"]):
                    rows.append({"name": r["name"], "size": None, "state": "refused"})
                    continue
                if times:
                    set_attributes(system, f"{base}/{r['name']}", r["dos_time"])
                else:
                    system.create_dir(f"{base}/{r['name']}", recursive=True)
                rows.append({"name": r["name"], "size": None, "state": "directory"})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("size", pa.int64()), ("state", pa.string())]))

    return dirs.select("name", "dos_time").mapInArrow(run, WRITTEN)


def extract_tree(files: DataFrame, dirs: DataFrame, folder: str, overwrite: bool = False, restore: str = "all") -> DataFrame:
    """Files (name, content, dos_time, attr) and directories (name, dos_time) written below a folder, empty directories as
    well, and what became of each. The directories' times are set when all else is done, as writing into them changes these.

    restore: all; files: directories keep the time of writing; none: files too, and none is read-only. Directories stay writable."""
    done = written(write_files(files, folder, overwrite, restore != "none"))
    made = written(_each_dir(dirs, folder, False))
    if restore == "all":
        made = written(_each_dir(dirs, folder, True))
    return done.unionByName(made)
