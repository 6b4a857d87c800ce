"""Catalogs: listings, versions, paths, selection, time travel, and the small functions of their columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import drop, written

# Attribute bits and their letters in a listing, in its order.
ATTRIBUTES = ((32, "a"), (16, "d"), (8, "l"), (4, "s"), (2, "h"), (1, "r"))
# Names of compression levels.
LEVELS = {2: "Fast", 3: "Normal", 4: "Tight", 5: "Ultra", 6: "rANS Fast", 7: "rANS Normal", 8: "rANS Tight", 9: "rANS Ultra"}
# Result codes.
ERRORS = {-2: "Callback fault", -3: "Bad state", -4: "Damaged archive", -5: "Truncated", -6: "Unimplemented", -7: "Internal error"}


def running_before(df: DataFrame, keys: list[str], order: Column, value: Column, out: str, parts: int = 64) -> DataFrame:
    """The sum of a value over the rows of equal keys that come before in order.

    One key may hold most rows: the order's range is cut into `parts` of about equal counts, each
    (key, part) is summed by a window of its own, and the parts' totals are summed up over a small table.
    """
    rows = df.withColumn("__order", order).withColumn("__value", value)
    bounds = sorted(set(rows.agg(F.percentile_approx("__order", [i / parts for i in range(1, parts)], 1000)).first()[0] or []))
    part = sum(((F.col("__order") >= b).cast("int") for b in bounds), F.lit(0))
    rows = rows.withColumn("__part", part)
    own = Window.partitionBy(*keys, "__part").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__part").agg(F.sum("__value").alias("__total"))
    totals = totals.withColumn("__above", F.coalesce(F.sum("__total").over(above), F.lit(0))).drop("__total")
    summed = rows.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0)))
    return summed.join(totals, [*keys, "__part"]).withColumn(out, F.col("__own") + F.col("__above")).drop("__order", "__value", "__part", "__own", "__above")


def versions(entries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """version: 0 for the newest entry of a name (the largest seq), counting up with age."""
    return running_before(entries, keys, -F.col(seq), F.lit(1).cast("long"), "version")


def select_version(df: DataFrame, wanted: int | None = 0) -> DataFrame:
    """name;N keeps version N, name;* (None) all."""
    return df if wanted is None else df.where(F.col("version") == wanted)


def glob_regex(pattern: str) -> str:
    """A shell pattern of one path component as an anchored regular expression; * and ? do not cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        stop = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif stop > 0:
            body = pattern[i + 1 : stop]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = stop
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_matches(pattern: str, path: str = "path") -> Column:
    """Whether a path matches, component by component; a trailing slash takes the whole subtree."""
    rx = "/".join(glob_regex(p)[1:-1] for p in pattern.split("/") if p)
    return F.col(path).rlike(f"^{rx}{'(/.*)?' if pattern.endswith('/') else ''}$")


def select_paths(entries: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Entries whose path matches."""
    return entries.where(path_matches(pattern, path))


def select_named(entries: DataFrame, names: list[str]) -> DataFrame:
    """Entries (path, version) that one of the names takes: a pattern of paths, with ;N for version N, ;* for all, or neither
    for the newest."""
    wanted = F.lit(False)
    for name in names:
        pattern, sign, version = name.rpartition(";")
        pattern, version = (pattern, version) if sign and (version == "*" or version.isdigit()) else (name, "0")
        wanted |= path_matches(pattern) & (F.lit(True) if version == "*" else F.col("version") == int(version))
    return entries.where(wanted)


def with_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every directory above the paths, once: what must be there before they are."""
    parts = F.split(path, "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return paths.select(F.explode(up).alias("dir")).distinct()


def walk_order(entries: DataFrame) -> list[Column]:
    """Sort columns of a listing: parents first, the files of a directory before its directories."""
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return [parent, F.col("is_dir"), F.col("path")]


def as_of(entries: DataFrame, keys: list[str], time: str, at: Column, tie: str) -> DataFrame:
    """Of each name the newest entry not later than `at`; of equal times that of the least `tie`."""
    best = F.max_by(F.struct(*entries.columns), F.struct(F.col(time), -F.col(tie))).alias("e")
    return entries.where(F.col(time) <= at).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best).select("e.*")


def _climbed(rows: DataFrame, joined: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Pointer doubling: rows (key, ptr, ...), ptr null at the top. Each round every pointer takes its target's, and the
    other columns are those of `joined` of a row and its target, so that 2 ** n steps take n rounds.

    A row that is not in or below a circle ends sooner or later, and while there is one some row ends in each round:
    what still has a pointer when no row has ended leads into a circle."""
    rows = written(rows)
    left = rows.where("ptr is not null").count()
    while left:
        a, b = rows.alias("a"), rows.alias("b")
        at = lambda side: lambda c: F.col(f"{side}.{c}")
        new = joined(at("a"), at("b"))
        up = a.where("ptr is not null").join(b, F.col("a.ptr") == F.col("b.key")).select(
            *[(F.col("b.ptr") if c == "ptr" else new.get(c, F.col(f"a.{c}"))).alias(c) for c in rows.columns])
        before, rows = rows, written(rows.where("ptr is null").unionByName(up))
        drop(before)
        now = rows.where("ptr is not null").count()
        if now == left:
            break
        left = now
    return rows


def chains(df: DataFrame, key: str = "id", parent: str = "master") -> DataFrame:
    """key, depth and cyclic of each row of unique keys, up its chain of parents: how many rows stand above it, or, if the
    chain runs into a circle, how many steps lead to a row for the second time. A parent that is not there is none.

    Any depth and any number of rows: each round of a few joins doubles the steps, and nothing is collected but counts."""
    keys = df.select(F.col(key).alias("ptr"))
    own = df.select(F.col(key).alias("key"), F.col(parent).alias("above"))
    start = written(own.join(keys, own["above"] == keys["ptr"], "left").select("key", "ptr"))
    depth = F.col("ptr").isNotNull().cast("long").alias("depth")
    upward = lambda a, b: {"depth": a("depth") + b("depth"), "top": b("top")}
    rows = _climbed(start.select("key", "ptr", depth, F.coalesce("ptr", "key").alias("top")), upward)
    ended = rows.where("ptr is null").select(F.col("key").alias(key), "depth", F.lit(False).alias("cyclic"))
    caught = rows.where("ptr is not null").select("key")
    n = caught.count()
    if not n:
        return ended
    live = written(start.join(caught, "key", "left_semi"))
    ring = live.select("key", "ptr", F.col("key").alias("least"))
    for _ in range(max(1, (n - 1).bit_length())):  # then each pointer is on its circle, and `least` of all of a circle's rows
        a, b = ring.alias("a"), ring.alias("b")
        ring = written(a.join(b, F.col("a.ptr") == F.col("b.key")).select("a.key", "b.ptr", F.least("a.least", "b.least").alias("least")))
    on = written(ring.select(F.col("ptr").alias("key")).distinct().join(ring, "key").select("key", "least"))
    sizes = on.groupBy("least").agg(F.count("*").alias("size"))
    circle = written(on.join(sizes, "least").select(F.col("key").alias("top"), "size"))
    tails = live.join(on.select("key", F.lit(True).alias("on")), "key", "left").select("key", F.when(F.col("on").isNull(), F.col("ptr")).alias("ptr"))
    below = _climbed(tails.select("key", "ptr", depth, F.coalesce("ptr", "key").alias("top")), upward)
    return ended.unionByName(below.join(circle, "top").select(F.col("key").alias(key), (F.col("depth") + F.col("size")).alias("depth"), F.lit(True).alias("cyclic")))


def dos_time(ts: Column) -> Column:
    """A timestamp as a packed number of two-second steps since 1980; earlier years are 0."""
    packed = (
        (F.year(ts) - 1980).cast("long") * (1 << 25) + F.month(ts).cast("long") * (1 << 21) + F.dayofmonth(ts).cast("long") * (1 << 16)
        + F.hour(ts).cast("long") * (1 << 11) + F.minute(ts).cast("long") * 32 + F.floor(F.second(ts) / 2)
    )
    return F.when(F.year(ts) < 1980, F.lit(0).cast("long")).otherwise(packed)


def from_dos_time(n: Column) -> Column:
    """The timestamp of a packed number; 0 is none."""
    part = lambda shift, bits: F.shiftright(n, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.when(n != 0, F.make_timestamp_ntz(part(25, 7) + 1980, part(21, 4), part(16, 5), part(11, 5), part(5, 6), part(0, 5) * 2))


def dos_name(path: Column) -> Column:
    """Eight and three upper-case characters, padded: the base after the last slash, split at its last dot."""
    base = F.upper(F.substring_index(path, "/", -1))
    dot = F.length(base) - F.instr(F.reverse(base), ".")
    stem = F.when(F.instr(base, ".") > 0, F.substring(base, F.lit(1), dot)).otherwise(base)
    ext = F.when(F.instr(base, ".") > 0, F.substring(base, dot + 2, F.lit(3))).otherwise(F.lit(""))
    return F.concat(F.rpad(F.substring(stem, 1, 8), 8, " "), F.rpad(ext, 3, " "))


def display_name(name: Column) -> Column:
    """The name of eight and three characters as it is shown: lower case, without padding, with a dot if there is an extension."""
    ext = F.rtrim(F.substring(name, 9, 3))
    return F.lower(F.concat(F.rtrim(F.substring(name, 1, 8)), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(""))))


def attributes(bits: Column) -> Column:
    return F.concat(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(c)).otherwise(F.lit("-")) for b, c in ATTRIBUTES])


def named(code: Column, names: dict[int, str], other: str) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(other)


def file_type_key(name: Column) -> Column:
    """The key by which like files are put together: the extension with # for digits, else the name's first three characters."""
    base = F.upper(F.substring_index(name, "/", -1))
    ext = F.substring(F.substring_index(base, ".", -1), 1, 3)
    return F.regexp_replace(F.when(F.instr(base, ".") > 0, ext).otherwise(F.substring(base, 1, 3)), "[0-9]", "#")


def store_path(hex_hash: Column) -> Column:
    return F.concat(F.substring(hex_hash, 1, 2), F.lit("/"), hex_hash)


def le(content: Column, at: int, size: int = 4) -> Column:
    """The little-endian number of `size` bytes at an offset."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in range(size, 0, -1)]), 16, 10).cast("long")


def identify(content: Column) -> Column:
    """1: the head of an archive, 0: not one, -1: too short to say. Longer heads are checked further: both lengths, the first volume, the offset."""
    length = le(content, 4)
    return (
        F.when(F.length(content) < 4, -1).when(F.hex(F.substring(content, 1, 4)) != "5543321A", 0).when(F.length(content) < 12, 1)
        .when(length != (le(content, 8) - 0x01B2C3D4 + (1 << 32)) % (1 << 32), 0).when(F.length(content) < 21, 1)
        .when((le(content, 13) != 1) | (le(content, 17) >= length + 13), 0).otherwise(1)
    )


def content_type(head: Column, size: Column) -> Column:
    """0 binary, 1 text, 2 program, 3 structured; head: the first 4096 bytes as an ISO-8859-1 string."""
    n = F.length(head)
    printable = n - F.length(F.regexp_replace(head, "[\\x20-\\x7E\\t\\n\\r]", ""))
    zeros = n - F.length(F.replace(head, F.lit("\x00"), F.lit("")))
    return (
        F.when(size < 4, 0).when(F.substring(head, 1, 2) == "MZ", 2).when(F.substring(head, 1, 4) == "\x7fELF", 2)
        .when(F.floor(printable * 100 / n) > 85, 1).when((n >= 64) & (F.floor(zeros * 100 / n) > 20), 3).otherwise(0)
    )


#: Fixed value: how code page 850 writes the upper half of a byte.
CP850 = bytes(range(128, 256)).decode("cp850")


def from_cp850(raw: Column) -> Column:
    """Text of a binary column in code page 850."""
    latin = "".join(map(chr, range(128, 256)))
    return F.translate(F.decode(raw, "ISO-8859-1"), latin, CP850)


def with_parent(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """Entries and their directory's path; those whose directory is missing are put at the root and marked."""
    d = dirs.select(F.col("id").alias("dir_id"), F.col("path").alias("dir_path"))
    joined = entries.join(d, "dir_id", "left")
    return joined.withColumn("lost", F.col("dir_path").isNull() & (F.col("dir_id") != 0)).withColumn("dir_path", F.coalesce("dir_path", F.lit("")))


def full_paths(df: DataFrame, root: int = 0) -> DataFrame:
    """id, path and depth of each directory from rows (id, parent, name), by pointer doubling as in chains(). Those that
    no way leads down to from the root are left out."""
    start = df.select(F.col("id").alias("key"), F.when(F.col("parent") != root, F.col("parent")).alias("ptr"), F.col("name").alias("path"), F.lit(1).cast("long").alias("depth"))
    rows = _climbed(start, lambda a, b: {"path": F.concat(b("path"), F.lit("/"), a("path")), "depth": a("depth") + b("depth")})
    return rows.where("ptr is null").select(F.col("key").alias("id"), "path", "depth")


def listing_line(path: Column, size: Column, time: Column, attr: Column, version: Column) -> Column:
    """One line of a listing with tabs between: attributes, time, size, path, and the version unless it is the newest."""
    return F.concat_ws("\t", attributes(attr), F.date_format(time, "yyyy-MM-dd HH:mm:ss"), size.cast("string"), path, F.when(version != 0, version.cast("string")))


def select_flags(entries: DataFrame, newer: Column | None = None, older: Column | None = None, without_attr: int = 0, time: str = "time", attr: str = "attr") -> DataFrame:
    """Entries within dates and without attributes."""
    if newer is not None:
        entries = entries.where(F.col(time) >= newer)
    if older is not None:
        entries = entries.where(F.col(time) < older)
    return entries.where(F.col(attr).bitwiseAND(F.lit(without_attr)) == 0) if without_attr else entries


def freshen(mine: DataFrame, theirs: DataFrame, key: str, time: str, only_known: bool = True) -> DataFrame:
    """Rows of theirs that are newer than mine; with only_known=False also those that mine lacks."""
    known = mine.groupBy(key).agg(F.max(time).alias("__mine"))
    joined = theirs.join(known, key, "left")
    newer = F.col(time) > F.col("__mine")
    return joined.where(newer if only_known else newer | F.col("__mine").isNull()).drop("__mine")


def keep_revisions(entries: DataFrame, marked: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of entries with versions those that are marked (keys, version); the rest is gone, and versions are counted anew."""
    kept = entries.join(marked.select(*keys, "version").distinct(), [*keys, "version"], "left_semi")
    return versions(kept.drop("version"), keys, seq)


def numbered(known: DataFrame, wanted: DataFrame, key: str, index: str, first: int = 2) -> DataFrame:
    """Each wanted key once with its index and whether it is new: the known one, or for keys that are not known the numbers
    after the largest known (from `first` on where none is) in order of the keys, which are numbers."""
    asked = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    found = asked.join(known.select(key, index), key).withColumn("is_new", F.lit(False))
    top = known.agg(F.max(index)).first()[0]
    start = first if top is None else max(first, top + 1)
    new = running_before(asked.join(known, key, "left_anti"), [], F.col(key), F.lit(1).cast("long"), "__before")
    return found.unionByName(new.select(key, (F.col("__before") + start).alias(index), F.lit(True).alias("is_new")))


def name_bucket(bytes_: Column) -> Column:
    """A 64-bucket hash: the XOR of the bytes, six bits of it."""
    return F.aggregate(bytes_, F.lit(0), lambda a, b: a.bitwiseXOR(b)).bitwiseAND(F.lit(63))


def dump_signature(size: Column, csum: Column) -> Column:
    """The check number of a listing's row."""
    return size.bitwiseXOR(F.lit(0x26F79FA4)).bitwiseXOR(csum.bitwiseOR(F.shiftleft(csum, 16)))
