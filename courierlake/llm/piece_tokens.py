"""SentencePiece BPE encoding through prefix tables, and decoding.

Encoding a text by merges costs a priority queue. Here each prefix of a segment stores its unique last
token instead: an automaton reports every piece that ends at a position, and of those exactly one is
compatible with the last token of the prefix in front of it (the two, merged from characters, stay
apart). The ids are then read backwards from the table, in time linear in the segment.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, small_batches

MARK = "▁"  # what SentencePiece writes for a space
#: Segments and pairs remembered in a worker; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Longer segments aren't remembered.
SHORT = 48

#: Texts on which a model must give the library's ids before it is taken.
PROBES = ("", " ", "a", "ab ba", "Hello world, hello again", "  two  spaces ", "na\u00efve \ufb01ne \u6f22\u5b57 \U0001f600", "12345 67.89", "line\nand\ttab", "thethethe " * 8)

_loaded: dict[bytes, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes like the library's ``encode(text, add_bos=True, add_eos=True)`` for BPE models with the
    identity normaliser, a dummy prefix and kept white space; other models are refused."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.library
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.begin, self.end = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        probe = "a  b ﬁ "
        if sp.encode(probe) and sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only models that leave the text as it is can be encoded here")
        # A mark starts a new segment if no piece has one behind another character.
        inner = any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.segment = re.compile(".+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) > 1 and self.merged(p) == [p]:  # pieces that merging can't reach never occur
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.fits: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.known: dict[str, bytes] = {}
        for probe in PROBES:
            if self.encode(probe) != np.array(sp.encode(probe, add_bos=True, add_eos=True), "<u4").tobytes():
                raise ValueError("only BPE models with the identity normaliser, a dummy prefix and kept white space can be encoded here")

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by repeated merging: the best-scored pair first, leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their characters are merged. Remembered by ``a``, then ``b``."""
        if self.pairs >= REMEMBERED:
            self.fits.clear()
            self.pairs = 0
        self.pairs += 1
        fit = self.fits[a][b] = self.merged(a + b) == [a, b]
        return fit

    def pieces(self, s: str) -> list[str]:
        """The pieces of a segment through its prefix table: ``last[i]`` is the last token of ``s[:i + 1]``."""
        last, done, fits = list(s), -1, self.fits
        for at, (p, n) in self.automaton.iter(s):  # by ascending end
            if at != done:
                if n <= at:
                    before = last[at - n]
                    fit = fits[before].get(p)
                    if not (self.compatible(before, p) if fit is None else fit):
                        continue
                last[at], done = p, at
        out, at = [], len(s) - 1
        while at >= 0:
            p = last[at]
            out.append(p)
            at -= len(p)
        out.reverse()
        return out

    def segment_ids(self, s: str) -> bytes:
        """The ids of a segment as little-endian unsigned 32-bit integers."""
        parts, id_of = self.pieces(s), self.id_of
        try:
            ids = [id_of[p] for p in parts]
        except KeyError:  # characters outside the vocabulary are spelt in bytes
            ids = [i for p in parts for i in ([id_of[p]] if p in id_of else [self.byte_id[b] for b in p.encode()])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, with those of begin and end, as little-endian unsigned 32-bit integers."""
        segments = self.segment.findall(MARK + text.replace(" ", MARK)) if text else []
        known = self.known
        found = list(map(known.get, segments))
        if None in found:
            for i, s in enumerate(segments):
                if found[i] is None:
                    found[i] = known.get(s) or self.segment_ids(s)
                    if len(s) <= SHORT:
                        known[s] = found[i]
            if len(known) >= REMEMBERED:
                known.clear()
        return b"".join((self.begin, *found, self.end))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def encoder(model: bytes) -> PieceEncoder:
    if model not in _loaded:
        _loaded[model] = PieceEncoder(model)
    return _loaded[model]


def encode_decode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of whole texts and what decoding them gives.

    Returns ``key``, ``n_tokens`` (begin and end ids included), ``ids`` (binary: little-endian unsigned
    32-bit integers) and ``decoded``. A null text counts as empty and has the begin and end ids alone.
    Repeated rows and null keys are kept as they are; other columns of ``docs`` play no part, whatever
    their names. ``model`` holds the bytes of a model file, half a megabyte for 32,000 pieces; they
    travel to the executors, so the file needs to be on the driver only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            (texts,) = columns(batch, "t")
            ids = [enc.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())],
                names=["k", "n_tokens", "ids", "decoded"],
            )

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("k", key)
