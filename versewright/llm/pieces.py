"""SentencePiece encoding and decoding through tables of distinct marked words.

A model of whose pieces none has a white-space marker after another character never
joins symbols of two marked words: a word with the markers before it is segmented
alike wherever it stands.  Each worker so segments every distinct marked word once
and joins the ids (and the decoded words) back by position.  The table lives in the
worker, since positions of all words of a corpus would outweigh the texts in a
shuffle; it is cut back at a fixed size, which costs time and changes no result.

Models that break the condition (checked on the driver) are encoded text by text.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, tokenizer_bytes

MARK = "▁"
#: Marked words that a worker's table may hold, and the longest that it keeps.
TABLE_WORDS, MAX_WORD = 400_000, 64

assert array("I").itemsize == 4 and sys.byteorder == "little"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_workers: dict = {}


def word_independent(model: bytes) -> bool:
    """Whether marked words can be segmented apart: identity normalizer with a dummy
    prefix, spaces kept and escaped, and no piece that goes on past a marker."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    n = proto.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE and not proto.trainer_spec.treat_whitespace_as_suffix
    # user-defined pieces (type 4) are cut out before anything else
    return bool(plain and bpe and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces))


class WordTable:
    """Ids (packed as little-endian unsigned 32-bit) and decoded text of marked words."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = (struct.pack("<I", i) for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.lone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # those that don't decode to themselves
        self.surface = [self._surface(i) for i in range(self.sp.get_piece_size())]

    def _surface(self, i: int) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[1:-1], 16)])
        return b"" if self.sp.is_control(i) else self.sp.id_to_piece(i).replace(MARK, " ").encode()

    def learn(self, words: list[str]) -> None:
        """words: each with one marker less than it has, as the library adds one."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            made = self.sp.encode(some, num_threads=1)
            if "" in some:
                made[some.index("")] = [self.lone]
            flat = list(chain.from_iterable(made))
            data, end = array("I", flat).tobytes(), 0
            for w, ids in zip(some, made):
                start, end = end, end + 4 * len(ids)
                self.ids[w] = data[start:end]
            # the pieces' text, all words at once; one by one only where that isn't the words themselves
            if b"".join(map(self.surface.__getitem__, flat)) != (" " + " ".join(some)).encode("utf-8", "surrogatepass"):
                for w, ids in zip(some, made):
                    back = self.sp.decode([self.lone, *ids])  # a marker in front takes the loss of the first space
                    if back != " " + w:
                        self.odd[w] = back

    def trim(self, now) -> None:
        if len(self.ids) > TABLE_WORDS:  # the words of this batch stay, with them the frequent ones
            self.ids = {w: self.ids[w] for w in now if len(w) <= MAX_WORD}
            self.odd = {w: x for w, x in self.odd.items() if w in self.ids}
        else:
            for w in now:
                if len(w) > MAX_WORD:
                    del self.ids[w]
                    self.odd.pop(w, None)

    def encode_one(self, text: str) -> tuple[bytes, str]:
        """Any text: runs of markers and those at the ends belong to the word after them."""
        words = [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []
        now = set(words)
        self.learn([w for w in now if w not in self.ids])
        ids = b"".join((self.begin, *map(self.ids.__getitem__, words), self.end))
        decoded = "".join(self.odd[w] if w in self.odd else " " + w for w in words)[1:]
        self.trim(now)
        return ids, decoded

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """Number of ids, ids and decoded text of each text of a batch."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        # words that stand between single spaces are cut, numbered and joined as arrays
        plain = pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, "")))))
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        self.learn([w for w in distinct if w not in self.ids])
        packed = [self.ids[w] for w in distinct]
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        pool = np.frombuffer(b"".join(packed), dtype=np.uint32)
        start = np.cumsum(size) - size
        words = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(words)), words)
        n = size[at]
        before = np.cumsum(n) - n
        order = np.arange(n.sum())
        count = np.bincount(of, weights=n, minlength=len(words)).astype(np.int64) + 2
        ends = np.cumsum(count)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint32)
        out[np.repeat(2 * of + 1, n) + order] = pool[np.repeat(start[at] - before, n) + order]
        out[ends - count], out[ends - 1] = self.sp.bos_id(), self.sp.eos_id()
        offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        decoded = texts
        slow = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist()
        if self.odd and not self.odd.keys().isdisjoint(distinct):
            slow = sorted({*slow, *(i for i, t in enumerate(texts.to_pylist()) if not self.odd.keys().isdisjoint(t.split(" ")))})
        self.trim(distinct)
        if slow:
            ids, decoded = ids.to_pylist(), decoded.to_pylist()
            for i in slow:
                ids[i], decoded[i] = self.encode_one(decoded[i])
                count[i] = len(ids[i]) // 4
            ids, decoded = pa.array(ids, type=pa.binary()), pa.array(decoded, type=pa.string())
        return [pa.array(count), ids, decoded]


def _whole(sp, texts: pa.Array) -> tuple[list[int], list[bytes], list[str]]:
    made = [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts.to_pylist()]
    return [len(x) for x in made], [struct.pack(f"<{len(x)}I", *x) for x in made], [sp.decode(x) for x in made]


def encode_decode(docs: DataFrame, model: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``docs[keep]`` with ``n_tokens`` (long), ``ids`` (binary: the ids with begin and
    end, little-endian unsigned 32-bit) and ``decoded`` (string), as the sentencepiece
    library gives them for the whole text.

    Null texts count as empty: begin and end id only, decoded to the empty string.
    Repeated rows are encoded each; an empty table gives an empty result; columns
    outside ``keep`` are not read.
    """
    data = tokenizer_bytes(model)
    apart = word_independent(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def make_kernel():
        data = shared.value
        key = zlib.crc32(data)
        if key not in _workers:
            _workers.clear()
            _workers[key] = WordTable(data)
        words = _workers[key]
        return words.encode if apart else lambda texts: _whole(words.sp, texts)

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())]
    return map_texts(docs, make_kernel, fields, keep, text, as_array=True)


def op8(docs: DataFrame, model: str, keep=("doc_id",)) -> DataFrame:
    """``docs[keep]`` with n_tokens, ids_sha256 and decoded_sha256 of each row; cases as in
    ``encode_decode``."""
    made = encode_decode(docs, model, keep)
    return made.select(
        *keep,
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"),
    )
