"""Token ids of whole texts, through a memo of words.

Encoding in the tokenizers library costs most of its time on words it has met
before. Texts are therefore cut where the tokenizer's own pre-tokenizer always
cuts, each different piece is encoded by the library when a worker first meets
it, and a text's ids are the joined ids of its pieces.

``cut="space_prefix"``: byte-level BPE whose words carry one leading space. The
cut is before a single space, and around a single line break, between two
non-space characters; a text with any other white space next to a cut is
encoded whole. ``cut="space_drop"``: tokenizers that drop white space; the cut
is at every space and line break. ``cut=None``: every text is encoded whole.
"""

from __future__ import annotations

import sys
import types
from array import array
from collections.abc import Collection, Iterable

import numpy as np
import pyarrow as pa

from floodflow.llm.words import Words, byte_class

#: Pieces kept; the memo starts anew when full, which costs time only.
MEMO_PIECES = 1_000_000
MEMO_TAILS = 10_000


#: Marks that are a pre-token of their own after a word.
_MARKS = ".,;:!?"
_CUTS = byte_class(b" \n")
#: After a word, a run of these is one pre-token of a byte-level tokenizer (an apostrophe
#: may begin another).
_TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies, for str.translate
    of a text decoded as Latin-1 (fixed by the file format: printable bytes stand
    for themselves, the others for U+0100 and up, in order)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Whole(Exception):
    """White space next to a cut, or no text: the text is encoded whole."""


class _Pieces(dict):
    """Ids of the pieces of ``space_prefix``, made when first asked for. Pieces may span
    line breaks; those are put together anew each time."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        enc = self.encoder
        if "\n" in piece:
            head, *lines = piece.split("\n")
            return enc.line.join([self[head], *map(enc.first.__getitem__, lines)])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Whole
        core = piece.rstrip(_TAILS)
        if not (core.isalpha() and (core.isascii() or max(core) < "\u0590")):
            ids = enc._pack([self.lead + piece])[0]
        elif len(core) < len(piece):
            tail = piece[len(core):]
            if tail not in enc.tails:
                if len(enc.tails) >= MEMO_TAILS:
                    enc.tails.clear()
                enc.tails[tail] = enc._pack([tail])[0]
            ids = self[core] + enc.tails[tail]
        else:
            ids = enc._word(self.lead, core)
        if len(self) >= MEMO_PIECES:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``Encoder.shared`` keeps one per worker process, which serves many tasks."""

    @classmethod
    def shared(cls, path: str, cut: str | None, dtype: str = "<u4") -> Encoder:
        state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
        key = f"{path}|{cut}|{dtype}"
        if key not in vars(state):
            setattr(state, key, cls(path, cut, dtype))
        return getattr(state, key)

    def __init__(self, path: str, cut: str | None, dtype: str = "<u4"):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.dtype = cut, dtype
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.after: dict[str, bytes] = _Pieces(self, " ") if cut == "space_prefix" else {}
        self.first: dict[str, bytes] = _Pieces(self, "")  # begins a line
        self.tails: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.leads = {"": "", " ": self.letters[32]}
        self.line = self._pack(["\n"])[0]
        self.marks = dict(zip(_MARKS, self._pack(list(_MARKS)), strict=True))

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of one word of letters: a single pre-token, straight from the model."""
        plain = word.isascii()
        if self.cut == "space_drop":
            word = word.lower() if plain else self.tokenizer.normalizer.normalize_str(word)
        # Letters of ASCII stand for themselves.
        text = self.leads[lead] + word if plain else (lead + word).encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _pack(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in got]

    def _learn(self, pieces: Collection[str]) -> None:
        """For ``space_drop``."""
        memo = self.after
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list(pieces)
        rest = []
        for p in new:
            core, mark = (p[:-1], p[-1]) if p[-1:] in self.marks else (p, "")
            if core.isalpha() and (core.isascii() or max(core) < "\u0590"):
                if core not in memo:
                    memo[core] = self._word("", core)
                if mark:
                    memo[p] = memo[core] + self.marks[mark]
            else:
                rest.append(p)
        new = rest
        for i in range(0, len(new), 5000):
            part = new[i:i + 5000]
            memo.update(zip(part, self._pack(part), strict=True))

    def encode_words(self, texts: list[bytes], end_id: int) -> tuple[bytes, np.ndarray]:
        """For ``space_drop``: ids of the texts (UTF-8), each with the end id, one after
        the other, and how many each text has. Every different word of the texts is
        looked up once, whatever its count."""
        w = Words(texts, _CUTS)
        words = w.vocabulary.cast(pa.large_string()).to_pylist()
        self._learn(words)
        ids = [self.after[x] for x in words]
        ids.append(np.array([end_id], self.dtype).tobytes())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // np.dtype(self.dtype).itemsize
        first = np.cumsum(size, dtype=np.int32) - size
        code = np.full(len(w.code) + len(texts), len(words), np.int32)
        code[np.arange(len(w.code)) + w.text] = w.code  # the places left are the ends
        many = size[code]
        place = np.repeat(first[code] - (np.cumsum(many, dtype=np.int32) - many), many)
        place += np.arange(len(place), dtype=np.int32)
        per = np.bincount(w.text, size[w.code], len(texts)).astype(np.int64) + 1
        return flat[place].tobytes(), per

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Packed ids of each text."""
        texts = list(texts)
        if self.cut is None:
            return self._pack(texts)
        if self.cut == "space_drop":
            cut = [t.replace("\n", " ").split(" ") for t in texts]
            self._learn(set().union(*cut))
            return [b"".join(map(self.after.__getitem__, p)) for p in cut]
        out = []
        first, after = self.first.__getitem__, self.after.__getitem__
        for text in texts:
            broken = text.endswith("\n")
            head, *rest = (text[:-1] if broken else text).split(" ")
            try:
                out.append(b"".join([first(head), *map(after, rest), self.line if broken else b""]))
            except _Whole:
                out.append(self._pack([text])[0])
        return out


def default_tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
