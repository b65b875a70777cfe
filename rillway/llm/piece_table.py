"""A table of distinct marked words and their SentencePiece ids, for one Python worker.

A BPE merge can only join pieces that the vocabulary holds. Where no piece has a white-space
marker after another character, no merge crosses the place where a run of markers begins
after a word, so a text's segmentation is the concatenation of that of its marked words
(``run of markers + characters up to the next marker``). ``marker_safe`` proves this for a
vocabulary; without the proof the table takes each whole text as one entry.

A task segments each distinct marked word once, with the library itself, and joins the ids
back by position. The table is dropped and begun anew after each task, and when it holds ``MAX_ENTRIES`` words or
``MAX_IDS`` ids, which bounds its memory and never changes a result.
"""

from __future__ import annotations

import re
from array import array
from itertools import accumulate

import numpy as np

MARK = "▁"
MAX_ENTRIES, MAX_IDS = 100_000, 4_000_000
_CHUNKS = re.compile(r" +[^ ]*")
_CACHE: dict = {}


def marker_safe(processor) -> bool:
    """Whether no piece crosses the start of a marker run, and spaces are kept as they are."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    crossing = any(MARK in p.lstrip(MARK) for p in pieces)
    probe = "a  b \t c\n É ﬁ "
    return not crossing and processor.normalize(probe) == MARK + probe.replace(" ", MARK)


def load(model: bytes):
    """The processor and its table, kept for the life of a Python worker."""
    key = hash(model)
    if key not in _CACHE:
        import sentencepiece

        _CACHE.clear()
        _CACHE[key] = PieceTable(sentencepiece.SentencePieceProcessor(model_proto=model))
    return _CACHE[key]


class PieceTable:
    def __init__(self, processor):
        self.processor = processor
        self.safe = marker_safe(processor)
        size = processor.get_piece_size()
        self.opens = np.array([processor.id_to_piece(i).startswith(MARK) for i in range(size)])
        self.lone = processor.piece_to_id(MARK)
        texts = {i: processor.id_to_piece(i).replace(MARK, " ") for i in range(size)}
        self.surface = {i: x for i, x in texts.items() if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))}
        self.single = self._whole_tokens() if self.safe else {}
        self.reset()

    def _whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings that encode alone as exactly one token, each checked with the library."""
        words = [p for i in range(self.processor.get_piece_size()) if (p := self.processor.id_to_piece(i)).startswith(MARK) and len(p) > 1]
        alone = self.processor.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1)
        return {w.replace(MARK, " "): 1 for w, ids in zip(words, alone, strict=True) if len(ids) == 1}

    def reset(self) -> None:
        self.packed: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.held = 0
        self.counts: dict[str, int] = dict(self.single)

    def chunks(self, text: str) -> list[str]:
        """Marked words in order, with spaces for markers; the first has the marker that every text gets."""
        return _CHUNKS.findall(" " + text.replace(MARK, " "))

    def _segment(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct marked words. Words with one marker are segmented in one string:
        a piece that opens with a marker then begins the next word."""
        plain = [w for w in words if len(w) > 1 and w[1] != " "]
        found: dict[str, list[int]] = {}
        if plain:
            ids = self.processor.encode("".join(plain)[1:])
            at = np.flatnonzero(self.opens[ids]).tolist()
            found = dict(zip(plain, [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)], strict=True)], strict=True))
        if len(found) < len(words):
            for w in words:
                if w not in found:
                    # A marker alone, at a text's end: the library gives no ids for an empty text.
                    found[w] = [self.lone] if w == " " else self.processor.encode(w[1:])
        return [found[w] for w in words]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids), whose text is that of the pieces unless bytes are among them."""
        surface = self.surface
        try:
            joined = "".join([surface[i] for i in ids])
            return joined[1:] if joined[:1] == " " else joined
        except KeyError:
            return self.processor.decode(ids)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """All ids of a text, and the text that they decode to."""
        if not text:
            return np.empty(0, dtype=np.int32), ""
        if not self.safe:
            ids = self.processor.encode(text)
            return np.array(ids, dtype=np.int32), self.processor.decode(ids)
        if len(self.packed) > MAX_ENTRIES or self.held > MAX_IDS:
            self.reset()
        words, packed, decoded = self.chunks(text), self.packed, self.decoded
        if new := [w for w in dict.fromkeys(words) if w not in packed]:
            segments = self._segment(new)
            flat = [i for ids in segments for i in ids]
            raw = array("i", flat).tobytes()
            ends = list(accumulate([4 * len(ids) for ids in segments]))
            packed.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            # A word's own spaces are those it begins with, so the next word begins at the next one.
            back = self.decode(flat).split(" ") if all(len(w) > 1 and w[1] != " " for w in new) else []
            decoded.update(zip(new, back if len(back) == len(new) else map(self.decode, segments), strict=True))
            self.held += len(flat)
        return np.frombuffer(b"".join([packed[w] for w in words]), dtype=np.int32), " ".join([decoded[w] for w in words])

    def count(self, text: str) -> int:
        """Number of ids: whole tokens count one each, only other words are merged."""
        if not text:
            return 0
        if not self.safe:
            return len(self.processor.encode(text))
        if len(self.counts) > MAX_ENTRIES + len(self.single):
            self.counts = dict(self.single)
        counts, words = self.counts, self.chunks(text)
        if new := [w for w in dict.fromkeys(words) if w not in counts]:
            counts.update(zip(new, map(len, self._segment(new)), strict=True))
        return sum(map(counts.__getitem__, words))
