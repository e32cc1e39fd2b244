"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, for every position, all pieces that end there (its output
links); each relaxes the best reading up to that position. What is best depends
on the model. In a unigram model it is the sum of the pieces' scores; equal sums
go to the longer last piece. In a BPE model scores are merge ranks, and the
model's own reading is the one in which every two neighbours are what merging
their joined text gives. Of the pieces that end at a position just one follows
the reading up to its start in this way (readings of a text's beginnings are
beginnings of readings), so a piece relaxes the position if that test passes,
and the pass ends with the model's own ids. Tests of pairs are remembered.

A character that no piece covers costs PENALTY below the lowest score and
becomes its byte pieces, or <unk> if the model has none.

White space is escaped as the model asks: a space becomes U+2581 and one is put
in front. A piece never holds U+2581 after another character (checked on
loading), so segments that begin at a run of U+2581 are independent; likewise
around a line feed if no piece holds one. Segments repeat, so each task
remembers the ids of frequent ones.

Defined results: a null text counts as empty and has no ids. Decoding the ids of
any text gives the text itself. Only models without normalisation rules are
taken; control pieces never match text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import small_batches, table

SPACE = "▁"
PENALTY = 10.0
#: Segments, and tests of pairs, that a worker remembers.
CACHE = 800_000
#: Of the model file: the field of the training options, the field of the model's kind in them, and the kind BPE.
TRAINER, KIND, BPE = 2, 3, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def is_bpe(model: bytes) -> bool:
    options = b"".join(v for n, v in fields(model) if n == TRAINER)
    return dict(fields(options)).get(KIND, 1) == BPE


class Codec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unk = sp.unk_id()
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if sp.normalize("  ﬁ  ") != SPACE * 3 + "ﬁ" + SPACE * 2:
            raise ValueError("the model has normalisation rules")
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), sp.get_score(i), i))
        self.automaton.make_automaton()
        self.missing = min(sp.get_score(i) for i in plain) - PENALTY
        inner = [self.pieces[i] for i in plain if re.search(f"[^{SPACE}]{SPACE}", self.pieces[i])]
        lines = [self.pieces[i] for i in plain if "\n" in self.pieces[i]]
        cut = f"{SPACE}*[^{SPACE}]*" if lines else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+"
        self.segments = re.compile("(?s).+" if inner else cut)
        self.known: dict[str, bytes] = {}
        self.bpe = is_bpe(sp.serialized_model_proto())
        self.rank = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """Merging from single characters: the neighbours whose joined piece has the highest score first, from the left if equal."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the text of the pieces a and b gives a and b."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [x for x in (a, b) if x]
        return got

    def single(self, i: int) -> bool:
        """Whether merging the text of piece i gives the piece; pieces that other merges forestall never come up."""
        return self.follows("", self.pieces[i]) if len(self.pieces[i]) > 1 else True

    def merges(self, s: str) -> list[int]:
        """The reading of a BPE model."""
        n, pieces = len(s), self.pieces
        back, piece = list(range(-1, n)), [-1] * (n + 1)  # a character without a piece stands alone
        last = [""] + list(s)  # text of the last piece of the reading up to a position
        for end, (size, _, i) in self.automaton.iter(s):
            end += 1
            if piece[end] >= 0 and end - back[end] > 1:
                continue  # a longer piece has been accepted here
            start = end - size
            text = pieces[i]
            if self.single(i) if start == 0 else self.follows(last[start], text):
                back[end], piece[end], last[end] = start, i, text
        out, at = [], n
        while at:
            out += [piece[at]] if piece[at] >= 0 else self.spelled(s[at - 1])
            at = back[at]
        return out[::-1]

    def spelled(self, c: str) -> list[int]:
        """Ids of a character that no piece covers, in reverse."""
        return [self.bytes.get(b, self.unk) for b in reversed(c.encode())] if self.bytes else [self.unk]

    def viterbi(self, s: str) -> list[int]:
        n = len(s)
        score, back, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here have their best score, but for pieces
        missing = self.missing
        for end, (size, gain, i) in self.automaton.iter(s):
            end += 1
            while done < end:
                done += 1
                score[done], back[done] = score[done - 1] + missing, done - 1
            x = score[end - size] + gain
            if x > score[end] or (x == score[end] and end - size < back[end]):
                score[end], back[end], piece[end] = x, end - size, i
        while done < n:
            done += 1
            score[done], back[done] = score[done - 1] + missing, done - 1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += self.spelled(s[back[at] : at])
            at = back[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit words."""
        if not text:
            return b""
        segments, known = self.segments.findall(SPACE + text.replace(" ", SPACE)), self.known
        try:
            return b"".join([known[s] for s in segments])
        except KeyError:
            pass
        out = []
        for s in segments:
            ids = known.get(s)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = np.array(self.merges(s) if self.bpe else self.viterbi(s), "<u4").tobytes()
                if len(s) <= 64:
                    known[s] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not numbers:
            return ""
        if self.value and not self.value.keys().isdisjoint(numbers):
            text = b"".join([self.value.get(i) or self.pieces[i].encode() for i in numbers]).decode("utf-8", "replace")
        else:
            text = "".join([self.pieces[i] for i in numbers])
        return text.replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for each worker process, so that its tasks share what it remembers."""
    return Codec(path)


def _coded(path: str):
    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            n, crc, chars, same = [], [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                chars.append(len(text))
                # U+2581 itself decodes to a space, as the model defines it
                same.append(codec.decode(ids) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_chars", "n_ids", "ids_crc32", "round_trip"])

    return coded


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs (all columns) with ids: array<int> added."""
    small_batches(docs.sparkSession)
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(path)
        for t in texts:
            yield pd.Series([np.frombuffer(codec.encode(x or ""), "<u4").astype("int32") for x in t], dtype=object)

    return docs.withColumn("ids", ids("text"))


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_ids, ids_crc32 (of the ids as little-endian 32-bit words), round_trip."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded(model or default_model()), "doc_id long, n_chars long, n_ids long, ids_crc32 long, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
