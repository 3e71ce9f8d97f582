"""Token ids of whole texts through the tokenizers library, with bounded caches of chunks that are tokenized alike anywhere."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the published split pattern of byte-level BPE tokenizers.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write printable bytes as themselves and the others as the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


#: Characters of texts that are cut into chunks; anything else goes through the whole tokenizer.
_OTHER = r"[^\n\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]"


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal to encoding each whole text with the library (``add_special_tokens=False``).

    A text is cut before a blank that follows something else: no token crosses such a cut. The chunks of a whole batch are told
    apart at once, and a chunk met for the first time is split as the tokenizer's file says, and the library's model turns
    each piece into ids. Texts with other white space, control characters or letters beyond the Latin blocks, and those that
    hold a special token's string (which the library turns into that token's id), go through the whole tokenizer. Chunks are
    remembered in two generations of at most ``limit`` each; the older one is forgotten when the newer one is full.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lower = spec["normalizer"] is not None
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self._letters = _byte_alphabet()
        self._blank, self._tokenize = "" if self.lower else self._letters[0x20], self.model.tokenize
        self._marks = {mark: self._piece(mark) for mark in (".", ",")}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.lower else BYTE_LEVEL_SPLIT
        self._split = regex.compile(pattern).findall
        special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        self._apart = "|".join(["(?i:" + special + ")", _OTHER] if special else [_OTHER])
        self._spaced = r"  |\n | \n|\n\n|[ \n]$"

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([self.ids[i] for i in ids])

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self._letters))])

    def _pieces(self, chunk: str) -> list[str]:
        """Pieces of a chunk with the blank before it; a tokenizer that drops white space sees no blank."""
        chunk = chunk.lower() if self.lower else chunk
        if chunk[:1] == "\n":
            return ["\n", *self._split(chunk[1:])]
        return self._split(chunk if self.lower else " " + chunk)

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters with the blank before it: one piece, and most new chunks are one."""
        word = word.lower() if self.lower else word
        letters = self._blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self._letters))
        own = self.ids
        return b"".join([own[t.id] for t in self._tokenize(letters)])

    def _text(self, text: str, apart: bool) -> bytes:
        """Ids of a text whose chunks are not looked at."""
        return self._whole(text) if apart else b"".join([self._piece(p) for p in self._split(text)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; one that begins with the mark begins its text, with no blank before."""
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[-1] in self._marks and chunk[:-1].isalpha():
            known = self.chunks.get(chunk[:-1])
            return (self._word(chunk[:-1]) if known is None else known) + self._marks[chunk[-1]]
        return b"".join(map(self._piece, self._split(chunk[1:]) if chunk[0] == "\1" else self._pieces(chunk)))

    def encode_batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts, one after the other, each with ``end`` behind it; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(texts, self._apart)
        odd = apart if self.lower else pc.or_(apart, pc.match_substring_regex(texts, self._spaced))
        special = [self._text(t.as_py(), a.as_py()) for t, a in zip(texts.filter(odd), apart.filter(odd))]
        # Such a text is one chunk of its own, \2 and its number; \3 ends every text.
        flat = pc.replace_substring(texts, "\n", " " if self.lower else " \n")
        if special:
            flat = pc.replace_with_mask(flat, odd, pa.array([f"\2{i}" for i in range(len(special))]))
        if not self.lower:
            flat = pc.binary_join_element_wise("\1", flat, "")
        if self.lower:
            flat = pc.ascii_lower(flat)
        lists = pc.split_pattern(pc.binary_join_element_wise(flat, "\3", " "), " ")
        coded = lists.flatten().dictionary_encode()
        # Chunks hold no blank: joined and split, they come out of Arrow an order faster than one by one.
        chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ")
        known, older = self.chunks, self.older
        for chunk in chunks:
            if chunk not in known and chunk and chunk[0] not in "\2\3" and chunk[:2] != "\1\2":
                ids = older.get(chunk)
                known[chunk] = self._chunk(chunk) if ids is None else ids
        own = {"": b"", "\3": b"" if end is None else end.to_bytes(4, "little")} | {f"{m}\2{i}": ids for i, ids in enumerate(special) for m in ("", "\1")}
        found = [known[c] if c in known else own[c] for c in chunks]
        if len(known) >= self.limit:
            self.older, self.chunks = known, {}
        place = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        much = sizes[place]
        bounds = np.concatenate([[0], np.cumsum(much)])
        at = np.repeat(starts[place] - bounds[:-1], much) + np.arange(bounds[-1])
        table = np.frombuffer(b"".join(found), dtype="<u4")
        return table[at], bounds[lists.offsets.to_numpy()]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
