"""Fast exact byte-level BPE ids through the ``tokenizers`` library.

A single space before a non-space character always begins a new pre-token of
the byte-level pattern, so a text is the concatenation of its space-led words,
and each word encodes by itself. Words repeat, so their ids are kept (two
generations of a bounded table per worker process); only unseen words reach the
library. Texts with other white-space runs, where that rule does not hold, are
encoded whole. A single line break between words is a pre-token of its own. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
from string import punctuation

import numpy as np

from .common import claim

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Words kept per generation and worker process (about 200 bytes each, two generations).
KEEP = 400_000
_OTHER_SPACE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ")
_ENC: dict = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    follow from U+0100 on in ascending order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_SPACE_LETTER = chr(_BYTE_LETTERS[32])


class _Words(dict):
    """word -> little-endian uint32 ids; an unseen word is encoded on first use.

    ``lead`` is put before each word (a space, or nothing at a text's or a line's
    begin); ``bare`` is the table without lead, for what follows a line break."""

    def __init__(self, encode, part, lead: str, keep: int, bare: _Words | None = None):
        super().__init__()
        self.encode, self.part = encode, part
        self.lead, self.keep, self.old = lead, keep, {}
        self.bare = self if bare is None else bare

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.part(self.lead + word)
            elif word[0] == "\n" and word != "\n":
                # a single line break is a pre-token of its own, the word behind it has no lead
                ids = self.bare["\n"] + self.bare[word[1:]]
            else:
                core = word.rstrip(punctuation)
                if core and len(core) < len(word) and core.isalpha():
                    # marks behind letters are a pre-token of their own
                    ids = self[core] + self.bare[word[len(core):]]
                else:
                    ids = self.encode(word if word == "\n" else self.lead + word)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``ids(texts)``: little-endian uint32 ids of each UTF-8 text as bytes."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        size = self.tok.get_vocab_size()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.bare = _Words(self.whole, self.part, "", keep // 8)
        self.words = _Words(self.whole, self.part, " ", keep, self.bare)
        self.odd = regex.compile(r"[^\S \n]")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """Ids of one pre-token: the library's model on its byte letters."""
        letters = (text.replace(" ", _SPACE_LETTER) if text.isascii()
                   else text.encode().decode("latin-1").translate(_BYTE_LETTERS))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def plain(self, raw: bytes, text: str) -> bool:
        """No white space but single spaces and single line breaks between words."""
        return not (any(r in raw for r in _RUNS) or raw[:1] in (b" ", b"\n")
                    or raw[-1:] in (b" ", b"\n")
                    or len(raw.translate(None, _OTHER_SPACE)) < len(raw)
                    or not raw.isascii() and self.odd.search(text))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out, get = [], self.words.__getitem__
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            if not raw:
                out.append(b"")
            elif self.plain(raw, text):
                # a line break goes with the word behind it: as few keys as words, not as pairs
                first, *rest = text.replace("\n", " \n").split(" ")
                out.append(self.bare[first] + b"".join(map(get, rest)))
            else:
                out.append(self.whole(text))
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    claim("tokenize", _ENC.clear)
    if path not in _ENC:
        _ENC[path] = Encoder(path)
    return _ENC[path]


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
