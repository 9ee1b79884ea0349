"""Exact token ids of whole texts with a public tokenizer, cheaply.

A text is cut where a token border is certain, each distinct piece goes
through the tokenizers library once per worker, and a document's ids are its
pieces' ids in order. Cutting, finding the distinct pieces and joining their
ids work on whole Arrow columns; only distinct pieces become Python objects.
The borders, valid for both vocabularies here (a byte-level one whose words own
the space before them, and a word vocabulary that drops white space):

* between two kinds of letter (ASCII, Latin-1), ASCII digit and ASCII mark,
  but not after an apostrophe (``'s``) nor between another mark and one,
* before a space or line feed that follows one of these or any other
  character that is certainly no white space,
* after a line feed that stands alone between two such characters.

All other characters (other white space, control characters) have no border
beside them. The piece cache of a worker is emptied when it holds ``CACHE``
pieces, but for those of the texts at hand.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CACHE = 1_000_000
LONG = 48  # longer pieces are rare; they are not kept
SLICE = 4 << 20  # bytes of text cut at once

_LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER, _SPACE, _FEED, _UNSURE = range(8)
_SOLID = _SPACE  # kinds below are certainly no white space
_MAYBE_SPACE = np.array([int.from_bytes(chr(c).encode()) for c in
                         (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000, 0xFEFF)])


def _kind(byte: int) -> int:
    """Kind of an ASCII character, or of the others by their first byte."""
    c = chr(byte)
    if byte >= 0x80:
        return _OTHER if 0xC2 <= byte <= 0xF4 else _UNSURE
    if c.isalnum():
        return _DIGIT if c.isdigit() else _LETTER
    return {"'": _APOSTROPHE, " ": _SPACE, "\n": _FEED}.get(c, _MARK if "!" <= c <= "~" else _UNSURE)


def _border(before: int, after: int) -> bool:
    if after in (_SPACE, _FEED):
        return before < _SOLID
    return before <= _MARK and after <= _APOSTROPHE and before != after and (before, after) != (_MARK, _APOSTROPHE)


_KINDS = bytes(map(_kind, range(256)))
_BORDERS = bytes(pair < 64 and _border(pair >> 3, pair & 7) for pair in range(256))


def borders(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Ascending positions in UTF-8 ``raw`` where pieces start or end: the starts
    (and the end) of its texts and the certain token borders in them."""
    data, kinds = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8)
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        lead, second = data[first], data[first + 1]
        kind = kinds[first]
        kind[(lead == 0xC3) & (second != 0x97) & (second != 0xB7)] = _LETTER  # but for the signs of times and division
        code = lead.astype(np.int64) << 8 | second
        longer = lead >= 0xE0
        code[longer] = code[longer] << 8 | data[first[longer] + 2]
        kind[np.isin(code, _MAYBE_SPACE) & (lead < 0xF0)] = _UNSURE
        for n, least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
            some = lead >= least
            kinds[first[some] + n] = kind[some]
    cut = np.zeros(len(data) + 1, np.uint8)
    if len(data) > 1:
        cut[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_BORDERS), np.uint8)
        feeds = np.flatnonzero(kinds[1:-1] == _FEED) + 1
        cut[feeds[(kinds[feeds - 1] < _SOLID) & (kinds[feeds + 1] < _SOLID)] + 1] = 1
    cut[starts] = 1
    return np.flatnonzero(cut)


class PieceEncoder:
    """Token ids of texts as little-endian 16-bit integers (both vocabularies
    stay under 65,536 ids)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # a special token's string in a text is ordinary text
        if self.plain.get_vocab_size() > 1 << 16:
            raise ValueError("vocabulary over 65,536 ids")
        self.marked = Tokenizer.from_file(path)  # knows the special token that parts the pieces to learn
        self.mark = "<|endoftext|>"
        self.mark_id = self.marked.token_to_id(self.mark)
        self.lowers = self.plain.normalizer is not None  # its normaliser lower-cases: fewer distinct pieces
        self.known: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        odd = [p for p in new if b"<|" in p or b"|>" in p]
        found = {p: np.array(self.plain.encode(p.decode(), add_special_tokens=False).ids, "<u2").tobytes() for p in odd}
        new = [p for p in new if p not in found] if odd else new
        mark = self.mark.encode()
        for at in range(0, len(new), 10_000):
            part = new[at:at + 10_000]
            ids = np.array(self.marked.encode_batch_fast([mark.join(part).decode()], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            raw = ids.tobytes()
            starts = [0, *[2 * c + 2 for c in cuts]]
            ends = [*[2 * c for c in cuts], len(raw)]
            found.update((p, raw[s:e]) for p, s, e in zip(part, starts, ends, strict=True))
        return found

    def codes(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, 2 bytes an id."""
        if self.lowers:
            # ASCII letters may be lowered first, but not beside a combining accent, which composes before they are lowered
            pieces = [p.lower() if p.isascii() or not (b"\xcc" in p or b"\xcd" in p) else p for p in pieces]
        found = dict(zip(pieces, map(self.known.get, pieces)))
        missing = [p for p, ids in found.items() if ids is None]
        found.update(self.learn(missing))
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = found
        self.known.update((p, found[p]) for p in missing if len(p) <= LONG)
        return list(map(found.__getitem__, pieces))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 2 bytes an id."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column without nulls, 2 bytes an id,
        worked out for about ``SLICE`` bytes of text at a time."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE)))
            yield from self._encode(data, offsets[at:min(to, len(texts)) + 1])
            at = to

    def _encode(self, data: pa.Buffer | None, offsets: np.ndarray) -> list[bytes]:
        start, end = int(offsets[0]), int(offsets[-1])
        if start == end:
            return [b""] * (len(offsets) - 1)
        raw, starts = data.slice(start, end - start).to_pybytes(), offsets - start
        cuts = borders(raw, starts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
        pieces = pieces.dictionary_encode()
        codes = self.codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array(codes, pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[np.searchsorted(cuts, starts)].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        return [bytes(ids[s:e]) for s, e in zip(ends, ends[1:])]


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder and piece cache per worker and vocabulary."""
    return PieceEncoder(path)
