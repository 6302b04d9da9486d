"""Token ids of whole texts by byte-level BPE, each distinct segment once.

A byte-level pre-token never reaches across a single space or line break between visible characters
(the space opens the next pre-token, the break is one of its own), nor from an ASCII letter to
punctuation or back. A piece of texts is cut at those places, its segments are dictionary-encoded by
Arrow, only segments not seen before are encoded, and the ids of all texts are taken from the
dictionary. Runs of white space stay inside a segment. Beside white space beyond ASCII nothing is cut,
and a text that holds the string of an added token is one segment. So the ids are those of the whole
text. By the same rule segments that are a space and visible characters are encoded many to a text,
and the bytes of each token tell where a segment's ids end.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from pagetrail.llm.batches import PIECE_BYTES, pieces

#: Segments that a worker remembers; those met later are encoded once a piece.
REMEMBERED = 500_000
#: White space beyond ASCII.
STRANGE = r"[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_VISIBLE, _LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_VISIBLE[33:127] = True
_LETTER[65:91] = _LETTER[97:123] = True
_POINT[33:127] = ~_LETTER[33:127]
_POINT[48:58] = _POINT[39] = False  # digits; an apostrophe may belong to the letters after it
_WIDE = _VISIBLE.copy()
_WIDE[128:] = True
#: Such segments may follow one another in a text, so many at a time.
_PLAIN, JOINED = re.compile(r" [^\x00-\x20\x7f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufffd]+"), 64
_ENCODERS: dict[str, "LibrarySegments"] = {}


def segment_starts(data: np.ndarray, ends: np.ndarray, strange: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places where segments begin in texts one after the other; ends: of the texts, a 0 before them."""
    if not len(data):
        return np.zeros(0, np.int64)
    visible = _WIDE[data]
    for i in np.flatnonzero(strange).tolist():
        visible[ends[i] : ends[i + 1]] = _VISIBLE[data[ends[i] : ends[i + 1]]]
    line = data == 10
    lone = line | (data == 32)
    lone[1:] &= visible[:-1]
    lone[:-1] &= visible[1:]
    start = lone.copy()
    start[1:] |= (lone & line)[:-1]
    letter, point = _LETTER[data], _POINT[data]
    start[1:] |= (letter[:-1] & point[1:]) | (point[:-1] & letter[1:])
    for i in np.flatnonzero(whole).tolist():
        start[ends[i] : ends[i + 1]] = False
    start[ends[:-1][ends[:-1] < ends[1:]]] = True
    return np.flatnonzero(start)


def items(values) -> list[bytes]:
    """The values of a large_binary array without nulls; its to_pylist takes several times as long."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    return _cut(values.buffers()[2].to_pybytes(), at) if len(values) else []


def _cut(raw: bytes, at: list[int]) -> list[bytes]:
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class Segments:
    """Needs many(segments): the ids of each, as little-endian unsigned 32-bit bytes."""

    #: Strings that are tokens wherever they stand.
    added: tuple[str, ...] = ()
    #: False: every text is one segment.
    cuts = True

    def __init__(self, remembered: int = REMEMBERED):
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def many(self, segments: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last one's end); null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        flags = [pc.match_substring(texts, a) for a in self.added]
        whole = np.full(len(texts), not self.cuts)
        for f in flags:
            whole |= f.to_numpy(zero_copy_only=False)
        starts = segment_starts(data, ends, pc.match_substring_regex(texts, STRANGE).to_numpy(zero_copy_only=False), whole)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)]), pa.py_buffer(data)]).dictionary_encode()
        distinct = items(cut.dictionary)
        values = list(map(self.known.get, distinct))
        new = [k for k, v in enumerate(values) if v is None]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            segments = [distinct[k] for k in part]
            for k, s, v in zip(part, segments, self.many(segments), strict=True):
                values[k] = v
                if len(self.known) < self.remembered and len(s) < 64:
                    self.known[s] = v
        taken = pa.array(values, pa.large_binary()).take(cut.indices)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
        return ids[: at[-1]], at[np.searchsorted(starts, ends)]

    def over(self, batches: Iterator, column: int = 1, most: int = PIECE_BYTES) -> Iterator:
        """(piece of a record batch, ids, ends) for all rows of the batches."""
        for piece in pieces(batches, column, most):
            yield (piece, *self.ids(piece.column(column)))


class LibrarySegments(Segments):
    """By the tokenizers library.

    special: the strings of added tokens in a text are those tokens, which is the library's own
    setting; else they are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special:
            self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        else:
            self.tokenizer.encode_special_tokens = True
        # only the byte-level pattern is known to keep segments apart
        self.cuts = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(self.tokenizer.pre_tokenizer)
        # a character of a byte-level token is a byte
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        super().__init__(remembered)

    def many(self, segments: list[bytes]) -> list[bytes]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t)] if self.cuts else []
        found: list[bytes | None] = [None] * len(texts)
        for k, ids in zip(plain, self.together([texts[k] for k in plain], [len(segments[k]) for k in plain]), strict=False):
            found[k] = ids
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.each([texts[k] for k in rest]), strict=True):
            found[k] = array("I", ids).tobytes()
        return found

    def each(self, texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def together(self, texts: list[str], sizes: list[int]) -> list[bytes]:
        """The ids of each of the plain segments with so many bytes; none if they cannot be told apart."""
        joined = ["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        if not joined or any(a in t for a in self.added for t in joined):
            return []
        ids = np.concatenate([np.array(x, "<u4") for x in self.each(joined)])
        at, ends = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        last = np.searchsorted(at, ends)
        if not len(at) or at[-1] != ends[-1] or (at[last] != ends).any():
            return []
        return _cut(ids.tobytes(), [0, *((last + 1) * 4).tolist()])


def encoder(path: str) -> LibrarySegments:
    """The worker's encoder of that vocabulary, added tokens among it; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibrarySegments(path, special=True)
    return _ENCODERS[path]
