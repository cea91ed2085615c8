"""Token counts of texts under a SentencePiece BPE model, without merging most words.

The model's normaliser only writes a space as the mark U+2581 and puts one mark before
the text, and no piece has a mark after another character (``TokenCounter`` checks that for
the model at hand). So no merge ever crosses from a character to a mark: a text is a run
of pre-tokens, each some marks and what follows them, and its count is the sum of theirs.

``whole_tokens`` proves, before any text is read, which vocabulary strings with one
leading mark encode alone as one token. A pre-token in that set counts one; only the
others reach the library's merges, each distinct one once per table of known counts.

Results: a null or empty text has no tokens and no bytes; white space counts as the
library counts it; repeated rows and null ids give rows of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, column, map_texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of memory for known counts in one worker process, and of the longest key kept.
TABLE_BYTES, LONGEST_KEY = 48 << 20, 256
#: Begin of every merge: one token by itself, parted from what follows by the mark.
_LEAD = "a"
_COUNTERS: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crossing_pieces(pieces: list[str]) -> list[str]:
    """Pieces with a mark after another character: with one of them, texts do not part."""
    return [p for p in pieces if any(a != MARK and b == MARK for a, b in zip(p, p[1:]))]


def whole_tokens(path: str) -> frozenset[str]:
    """Strings that, as a whole word, encode as exactly one token of the model."""
    model = _load(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    crossing = crossing_pieces(pieces)
    if crossing or len(model.encode(_LEAD)) != 1:
        raise ValueError(f"words of this model do not part at spaces: {crossing[:5]}")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    ids = model.encode([f"{_LEAD} {w}" for w in words], num_threads=1)
    return frozenset(w for w, found in zip(words, ids)
                     if len(found) == 2 and model.id_to_piece(found[1]) == MARK + w)


class TokenCounter:
    """``count(text)``: the library's number of tokens."""

    def __init__(self, path: str, whole: frozenset[str], table_bytes: int = TABLE_BYTES):
        self.model, self.whole, self.room = _load(path), whole, table_bytes
        self.starts = np.asarray([self.model.id_to_piece(i).startswith(MARK)
                                  for i in range(self.model.vocab_size())])
        self.known: dict[str, int] = {}
        self.used = 0

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts through the library: plain words in one call, parted by the tokens
        that begin with a mark; words behind runs of spaces one by one."""
        new = [w for w in words if w and w[0] != " "]
        starts = self.starts[np.asarray(self.model.encode(" ".join(new)), np.int64)]
        ends = np.append(np.flatnonzero(starts)[1:], len(starts))
        found = dict(zip(new, np.diff(ends, prepend=0).tolist())) if new else {}
        for w in words - found.keys():
            found[w] = len(self.model.encode(f"{_LEAD} {w}")) - 1
        for w, n in found.items():
            if len(w) <= LONGEST_KEY:
                if self.used > self.room:
                    self.known, self.used = {}, 0
                self.known[w] = n
                self.used += 150 + 2 * len(w)
        return found

    def _merged(self, words: list[str]) -> int:
        """Tokens of pre-tokens that are no whole tokens."""
        known = self.known
        unseen = {w for w in words if w not in known}
        if not unseen:
            return sum(map(known.__getitem__, words))
        seen = {w: known[w] for w in set(words) - unseen}
        seen |= self._learn(unseen)
        return sum(map(seen.__getitem__, words))

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if "" in words:            # runs of spaces stand before the word that follows them
            joined, blanks = [], 0
            for w in words[:-1]:
                if w:
                    joined.append(" " * blanks + w)
                    blanks = 0
                else:
                    blanks += 1
            words = [*joined, " " * blanks + words[-1]]
        whole = self.whole
        rest = [w for w in words if w not in whole]
        return len(words) - len(rest) + (self._merged(rest) if rest else 0)


def counter(path: str, whole: frozenset[str]) -> TokenCounter:
    """One counter per worker process and model file."""
    claim("token_counts", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``; no shuffle.

    ``path`` is the model file, readable by every worker. The proven words (at most the
    model's vocabulary, some 16,000 strings) travel with the task."""
    path = path or default_path()
    whole = whole_tokens(path)

    def run(rows, texts):
        count = counter(path, whole).count
        return [column(rows, "_id"), [len(t) for t in texts],
                [count(t.decode("utf-8", "replace")) for t in texts]]

    plain = docs.select(F.col(f"`{id_col}`").alias("_id"),
                        F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = plain.schema["_id"].dataType.simpleString()
    counted = map_texts(plain, ["_id"], run, f"_id {kind}, n_bytes long, n_tokens long", "_text")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
