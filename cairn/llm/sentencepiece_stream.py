"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 7).

For a BPE model the lattice has one valid path to each boundary: pieces a and b may follow each other only
if the model's own merging of the two characters strings gives a, b again, and a sequence is the model's
encoding if all its neighbours may follow each other. The search keeps, for the last boundaries within
the longest piece's length, the piece that ends there (its backpointer). Whenever the paths back from all
of these boundaries meet in one, the ids before it are committed and forgotten, so memory is a window
bounded by the longest piece plus what is not yet decided, whatever the text's length. The ids are those
of the sentencepiece library.

Paths always meet between two characters that no piece holds side by side, so before a word mark that
follows a word and mostly before punctuation; what lies between such boundaries is searched once for each
worker and kept in a table of bounded size. A
character that no piece covers becomes its UTF-8 bytes' pieces.

Decoding turns pieces and byte runs back into text and drops the mark that encoding put first; for valid
UTF-8 the round trip is exact, but for the word mark itself, which the model reads as a space.

Cases: a null or empty text has no ids and decodes to ''; repeated rows are encoded alike; long runs
without a space are searched in the bounded window; null ids stay null; only doc_id and text are read.
"""

from __future__ import annotations

from array import array
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MARK = "▁"
MOST_KEPT, LONGEST_KEPT = 300_000, 48
#: Characters taken up between two attempts to commit.
WINDOW = 64


class Model:
    """A BPE model's pieces: ids, merge order, byte pieces; and which pieces may follow each other."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        skip = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.control = {i for i in skip if i not in self.byte_of}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: Every tail of a piece and its id; -1 for those that are no pieces themselves.
        self.tails = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.follow: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the model's merging of both pieces' characters gives just these two: byte pair merging, the
        best-scored neighbours first, of equals the leftmost, until nothing merges or a merge crosses the boundary."""
        x, y = self.pieces[a], self.pieces[b]
        parts, left, score, none = list(x + y), len(x), self.score.get, float("-inf")
        scores = [score(p + q, none) for p, q in zip(parts, parts[1:])]
        found = True
        while (best := max(scores, default=none)) > none:
            at = scores.index(best)
            if at == left - 1:
                found = False
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
            left -= at < left
        found = found and len(parts) == 2
        if len(self.follow) < MOST_KEPT:
            self.follow[a << 20 | b] = found
        return found


class Stream:
    """Encodes characters as they come; push and finish return the ids that are decided."""

    def __init__(self, model: Model):
        self.model = model
        self._start("", [-1], [0])

    def _start(self, text: str, back: list[int], sizes: list[int]) -> None:
        """text: what is not committed; for each boundary of it the piece that ends there (-1: a character without) and its length."""
        self.text, self.back, self.sizes = text, back, sizes

    def push(self, more: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(more), WINDOW):
            self.text += more[i : i + WINDOW]
            self._extend()
            if len(self.text) >= WINDOW:
                out += self._commit(False)
        return out

    def _extend(self) -> None:
        model, text, back, sizes = self.model, self.text, self.back, self.sizes
        tails, follow, may_follow = model.tails.get, model.follow.get, model.may_follow
        for end in range(len(back), len(text) + 1):
            ending = []  # pieces that end here and where they start, the longest last
            start = end - 1
            found = tails(text[start:end])
            while found is not None:
                if found >= 0:
                    ending.append(found)
                    ending.append(start)
                if not start:
                    break
                start -= 1
                found = tails(text[start:end])
            while ending:
                start = ending.pop()
                found = ending.pop()
                before = back[start]
                if before < 0:
                    break
                ok = follow(before << 20 | found)
                if ok or ok is None and may_follow(before, found):
                    break
            else:
                found, start = -1, end - 1
            back.append(found)
            sizes.append(end - start)

    def finish(self) -> list[int]:
        out = self._commit(True)
        self._start("", [-1], [0])
        return out

    def _commit(self, over: bool) -> list[int]:
        """The ids up to the boundary in which all surviving paths meet; what is after it stays."""
        model, text, back, sizes = self.model, self.text, self.back, self.sizes
        meet = len(text)
        alive = set() if over else set(range(max(0, meet - model.longest + 1), meet))
        while alive:  # the furthest boundary steps back until one is left
            alive.add(meet - sizes[meet])
            meet = max(alive)
            alive.remove(meet)
        out, at = [], meet
        while at:
            i = back[at]
            if i >= 0:
                out.append(i)
            else:
                out += [model.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            at -= sizes[at]
        if meet and not over:
            self._start(text[meet:], back[meet:], sizes[meet:])
        out.reverse()
        return out


@cache
def model_of(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes whole texts; spans between word marks are kept as little-endian 32-bit ids."""

    def __init__(self, path: str):
        self.model, self.known = model_of(path), {}
        self.stream = Stream(self.model)

    def span(self, span: str) -> bytes:
        """The ids of a run of characters. Between two characters that no piece holds side by side all paths meet."""
        inside, known, start, out = self.model.inside, self.known, 0, []
        for i, (a, b) in enumerate(pairwise(span), 1):
            if a + b not in inside:
                part = span[start:i]
                out.append(known.get(part) or self._search(part))
                start = i
        part = span[start:]
        out.append(known.get(part) or self._search(part))
        data = b"".join(out)
        if start and len(span) <= LONGEST_KEPT and len(known) < MOST_KEPT:
            known[span] = data
        return data

    def _search(self, part: str) -> bytes:
        stream = self.stream  # finish() leaves it empty
        data = array("i", stream.push(part) + stream.finish()).tobytes()
        if len(part) <= LONGEST_KEPT and len(self.known) < MOST_KEPT:
            self.known[part] = data
        return data

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, out = self.known, []
        # the mark goes before the text and stands for each space; a run of spaces opens the span it precedes
        run = 1
        for word in text.replace(MARK, " ").split(" "):
            if word:
                span = MARK * run + word
                out.append(known.get(span) or self.span(span))
                run = 1
            else:
                run += 1
        if run > 1:
            out.append(self.span(MARK * (run - 1)))
        return b"".join(out)


class Decoder:
    """Text of ids."""

    def __init__(self, path: str):
        model = model_of(path)
        self.raw = [bytes([model.byte_of[i]]) if i in model.byte_of else b"" if i in model.control else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)]

    def __call__(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@cache
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def encoded_ids(text: Column, path: str) -> Column:
    """The ids of a text column, as an array of int."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(path)
        data = [encoder(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(data) + 1, np.int32)
        np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))

    return encode(text.cast("string"))


def decoded_text(ids: Column, path: str) -> Column:
    """The text of an array of ids; null gives ''."""

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        decoder = decoder_of(path)
        at, ids = np.asarray(lists.offsets), np.asarray(lists.values)
        return pa.array([decoder(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])], pa.string())

    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded again: number and digest of its ids, whether the text came back."""
    path = default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.withColumn("ids", encoded_ids(F.col("text"), path))
    back = ids.withColumn("back", decoded_text(F.col("ids"), path))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("back", 256).alias("text_sha256"), (F.col("back") == F.col("text")).alias("round_trip"))
