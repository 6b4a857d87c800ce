"""Packing: bounded-space online packing of token ids into sequences (operator 4).

Each task keeps at most `open_windows` windows while it reads its documents. A document's whole windows
are emitted as they are; its rest goes to the open window with the least room that holds it. When none
does and no more may be opened, the fullest is emitted: the head of the rest fills its last room, so that
it has no padding, and the tail is placed again. At its end a task merges what is left into whole
windows and one rest; then the rests of `merged_tasks` tasks at a time are merged in the same way, and
the last tokens of each such group are cut at powers of two, which need no padding.

Memory in a task is the open windows plus some megabytes of text in work, whatever the input. Ids are
those of the `tokenizers` file. White space separates that vocabulary's words, so a text's ids are its
words' ids in a row; the ids of short words are kept in a table of at most MOST_WORDS entries.

Cases: a null or empty text is the end id alone; a text longer than a window fills several sequences;
repeated rows are packed once each; null ids stay null; an empty table packs to no rows; only doc_id and
text are read. sequence_id holds the task and a running number: another division of the input into tasks
gives other sequences, a lost task gives the same ones again.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, materialise, table

WINDOW, OPEN, MERGED_TASKS, END_ID = 4096, 16, 64, 2
MOST_WORDS, LONGEST_WORD = 300_000, 48
#: Bytes of text in work at once, and of ids in one batch of output.
WORK, OUT = 1 << 22, 1 << 22

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("task", T.LongType()), T.StructField("ids", T.BinaryType()),
])
ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECE])


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pre-tokens of lower-case text, as the vocabulary's own splitter makes them.
PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the same for words of ASCII
#: Stands between words that are encoded in one call.
MARK = "\u00a9"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A word of Latin-1 characters is lowered and split into pre-tokens, which the vocabulary encodes each
    for itself, those of printable ASCII by its model without the steps before it, which leave them as they
    are; other words go to the tokenizer as they are. What it made is kept by word and pre-token.
    """

    def __init__(self, path: str):
        self.path, self.words, self.parts = path, {}, {}

    def __call__(self, texts: list[str | None]):
        """The ids of each text, in order; texts are taken up WORK bytes at a time."""
        work, size = [], 0
        for t in texts:
            work.append(encoded(t).split())
            size += len(t or "")
            if size >= WORK:
                yield from self._ids(work)
                work, size = [], 0
        yield from self._ids(work)

    def _ids(self, work: list[list[bytes]]):
        find, found, missing = self.words.get, [], set()
        for words in work:
            ids = list(map(find, words))
            if None in ids:
                missing.update([w for w, i in zip(words, ids) if i is None])
            found.append(ids)
        fresh = self._learn(missing) if missing else {}
        for words, ids in zip(work, found):
            yield b"".join([fresh[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids)

    def _learn(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        """The ids of fresh words. They are kept, but for long ones and those for which there is no room."""
        split, whole = {}, []
        for w in fresh:
            s = w.decode("utf-8", "replace")
            if "<|" in s:
                whole.append(w)
            elif s.isascii():
                split[w] = ASCII_PRE.findall(s.lower())
            elif max(s) < "\u0100":
                split[w] = PRE.findall(s.lower())
            else:
                whole.append(w)
        parts = list({p for ps in split.values() for p in ps}.difference(self.parts))
        plain = [p for p in parts if p.isascii() and p.isprintable()]
        got = dict(zip(plain, self._merged(plain)))
        others = [p for p in parts if p not in got]
        got.update(zip(others, self._encode(others)))
        if len(self.parts) < MOST_WORDS:
            self.parts.update((p, i) for p, i in got.items() if len(p) <= LONGEST_WORD)
        known = self.parts
        made = {w: b"".join([known[p] if p in known else got[p] for p in ps]) for w, ps in split.items()}
        made.update(zip(whole, self._encode([w.decode("utf-8", "replace") for w in whole])))
        if len(self.words) < MOST_WORDS:
            self.words.update((w, i) for w, i in made.items() if len(w) <= LONGEST_WORD)
        return made

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-case pre-tokens of printable ASCII, by the model alone."""
        merge, ids, ends = tokenizer(self.path).model.tokenize, array("I"), [0]
        for p in parts:
            ids.extend([t.id for t in merge(p)])
            ends.append(4 * len(ids))
        data = np.asarray(ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words, each encoded for itself: many in one call with a mark between them."""
        t = tokenizer(self.path)
        mark = t.encode(MARK, add_special_tokens=False).ids
        out: list[bytes] = []
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            ids = np.array(t.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else np.zeros(0, int)
            if len(ends) == len(some) - 1:
                edges = [-1, *ends.tolist(), len(ids)]
                data = ids.tobytes()
                out += [data[4 * (a + 1) : 4 * b] for a, b in zip(edges, edges[1:])]
            else:  # a word holds the mark itself
                out += [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(some, add_special_tokens=False)]
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which many tasks use."""
    return Encoder(path)


class Window:
    """An open sequence: its pieces and the tokens in them."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece[4]) // 4


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """A piece (doc_id, start, doc_tokens, part of the document, ids) as its first n tokens and the others."""
    doc, start, total, task, ids = piece
    return (doc, start, total, task, ids[: 4 * n]), (doc, start + n, total, task, ids[4 * n :])


class Packer:
    """Bounded-space best fit. `emit` gets the pieces of each finished window."""

    def __init__(self, emit, window: int = WINDOW, most: int = OPEN):
        self.emit, self.window, self.most, self.open = emit, window, most, []

    def place(self, piece: tuple) -> None:
        while len(piece[4]) >= 4 * self.window:
            head, piece = cut(piece, self.window)
            self.emit([head])
        while n := len(piece[4]) // 4:
            fit = max((w for w in self.open if w.used + n <= self.window), key=lambda w: w.used, default=None)
            if fit is None and len(self.open) < self.most:
                self.open.append(fit := Window())
            if fit is None:
                fullest = max(self.open, key=lambda w: w.used)
                head, piece = cut(piece, self.window - fullest.used)
                fullest.add(head)
                self._close(fullest)
                continue
            fit.add(piece)
            if fit.used == self.window:
                self._close(fit)
            return

    def _close(self, w: Window) -> None:
        self.open.remove(w)
        self.emit(w.pieces)

    def merged(self) -> list[tuple]:
        """Ends the packing: open windows, the fullest first, run together into whole ones; the pieces of the rest."""
        rest = Window()
        for w in sorted(self.open, key=lambda w: -w.used):
            for piece in w.pieces:
                while rest.used + len(piece[4]) // 4 >= self.window:
                    head, piece = cut(piece, self.window - rest.used)
                    rest.add(head)
                    self.emit(rest.pieces)
                    rest = Window()
                if piece[4]:
                    rest.add(piece)
        self.open = []
        return rest.pieces


def in_powers(pieces: list[tuple], emit) -> None:
    """The pieces run together and cut into sequences whose lengths are falling powers of two."""
    left, now, room = sum(len(p[4]) // 4 for p in pieces), [], 0
    for piece in pieces:
        while n := len(piece[4]) // 4:
            room = room or 1 << (left.bit_length() - 1)
            head, piece = cut(piece, taken := min(n, room))
            now.append(head)
            room -= taken
            left -= taken
            if not room:
                emit(now)
                now = []


class Out:
    """Collects finished sequences into record batches."""

    def __init__(self, first: int):
        self.next, self.rows, self.size = first, [], 0

    def sequence(self, pieces: list[tuple], finished: bool = True) -> None:
        offset = 0
        for doc, start, total, task, ids in pieces:
            self.rows.append((doc, start, len(ids) // 4, total, self.next if finished else -1, offset, task, ids))
            offset += len(ids) // 4
            self.size += len(ids) + 64
        self.next += finished

    def batches(self, least: int = 1):
        if self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), ARROW)], schema=ARROW)
            self.rows, self.size = [], 0


def packer(path: str, window: int, most: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        task = TaskContext.get().partitionId()
        out, encode = Out(task << 32), encoder(path)
        pack = Packer(out.sequence, window, most)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(docs, encode(texts)):
                ids += end
                pack.place((doc, 0, len(ids) // 4, task, ids))
                yield from out.batches(OUT)
        out.sequence(pack.merged(), finished=False)
        yield from out.batches()

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN, merged_tasks: int = MERGED_TASKS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: where it starts, its ids, and its sequence and place there."""
    first = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packer(path, window, open_windows, end_id), PIECE), "packed")

    def merge(rest: pa.Table) -> pa.Table:
        rows = sorted(rest.select(["task", "offset", "doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["task"], r["offset"]))
        out = Out((1 << 62) + (rows[0]["task"] // merged_tasks << 32))
        joined = Packer(out.sequence, window, merged_tasks)
        w = Window()
        for r in rows:
            w.add((r["doc_id"], r["start"], r["doc_tokens"], r["task"], r["ids"]))
        joined.open = [w]
        in_powers(joined.merged(), out.sequence)
        return pa.Table.from_batches(out.batches(), schema=ARROW)

    rest = first.where("sequence_id < 0").groupBy(F.floor(F.col("task") / merged_tasks)).applyInArrow(merge, PIECE)
    return first.where("sequence_id >= 0").unionByName(rest).drop("task")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), default_tokenizer()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents, as pieces."""
    return digests(pack(docs, default_tokenizer()))
