"""Toxicity through a noisy channel.

Writers hide words by leetspeak, spacing and repetition. Every token that could be
so written is a lattice: a look-alike character may stand for one of its letters or
for nothing, a repeated letter may be dropped, a separator between letters, or a space
between short pieces, may join them or end the word. Viterbi decoding under a character language model
(4-grams with back-off, counted over the whole corpus) picks the likeliest reading;
a token without such characters has one reading, itself, and is not decoded. A token
whose letters are only doubled counts as it stands, too.

Every text is decoded once: its distinct restored words (of three letters and more,
as shorter ones are no evidence) are written as a table that learning and scoring read.
Workers number tokens and words and keep what a token reads as between slices of texts.

Restored words and their beginnings (``PREFIXES`` letters) are the evidence. From
labelled texts, each distinct text once, those are kept that toxic texts hold with a
precision whose lower confidence bound reaches ``CERTAIN``; a text's score is that of
its surest word, raised by further ones, or the rate of toxic texts without any.

The language model is a hashed table of fixed size; every task adds up its own
counts and shuffles those, so what is gathered grows with the corpus and what is
broadcast does not. Candidate words occur in at least ``MIN_SHARE`` of the toxic
texts, so their number is bounded by the words of a text divided by it.

Defined results: null and empty texts hold no word; without any label every score is
0; several labels of one id count as their rounded mean; null labels and ids are not
learned from; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_texts, slices, written
from .quality_model import labels_by_id

#: Characters and the letters they may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*'~/,"
EDGE = ".,;:!?\"'()[]{}<>#%&*|=/\\~`^-_+$@"
ORDER = 4
BUCKETS = 1 << 20
COST_LEET, COST_DROP, COST_JOIN, COST_BREAK = 1.0, 4.5, 0.5, 2.0
#: Dropping a letter of a longer run, and one of a pair.
COST_REPEAT, COST_DOUBLE = 1.5, 4.0
PREFIXES = (4, 5, 6)
MIN_DOCS, MIN_SHARE = 5, 1e-4
#: Lower confidence bound (normal quantile Z) of the precision from which a word counts.
Z, CERTAIN, CERTAIN_BEGINNING = 2.5, 0.4, 0.7
#: Labelled rows up to this many ids are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
KEEP = 400_000
#: Tokens and restored words of which a worker keeps the readings, some 200 bytes each, and their letters.
TOKENS, LETTERS = 800_000, 32_000_000
#: Words whose cost is worked out at once; pieces of a stretch up to which all its parts are.
BATCH, LONG = 50_000, 6
_K, _M = 0x01000193, 0xFFFFFFFF
#: Letters of a piece that a spaced word may be cut into.
SHORT = 4
_TRIPLE, _DOUBLE, _LOOKS = re.compile(r"(.)\1\1"), re.compile(r"(.)\1"), re.compile(r"[$@+|!(]")


def _bucket(gram: str) -> int:
    h = len(gram)
    for c in gram:
        h = (h * _K + ord(c)) & _M
    return (h * 2654435761 & _M) >> 12


def _gram_buckets(code: np.ndarray):
    """Buckets of the 1- to ``ORDER``-grams of code points, by their first place (see ``_bucket``)."""
    h = np.zeros(len(code) + 1, np.uint32)
    for n in range(1, ORDER + 1):
        h = h[:-1] * np.uint32(_K) + code[n - 1:]              # modulo 2^32
        yield (h + np.uint32(n * pow(_K, n, 1 << 32) & _M)) * np.uint32(2654435761) >> np.uint32(12)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def count_grams(words: Counter) -> np.ndarray:
    """Hashed counts of the 1- to ``ORDER``-grams of ``^^^word$``."""
    code = _codes("\0".join([f"^^^{w}$" for w in words]) + "\0" * ORDER if words else "\0" * ORDER)
    end = code == 0
    wide = np.fromiter(map(len, words), np.int64, len(words)) + ORDER + 1
    weight = np.append(np.repeat(np.fromiter(words.values(), float, len(words)), wide),
                       np.zeros(len(code)))[:len(code)]
    total, crosses = np.zeros(BUCKETS), np.zeros(len(code), bool)
    for n, b in enumerate(_gram_buckets(code)):
        crosses = crosses[:len(b)] | end[n:n + len(b)]
        total += np.bincount(b, np.where(crosses, 0.0, weight[:len(b)]), BUCKETS)
    return total


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter n-grams over all words of the corpus, ``BUCKETS`` numbers."""

    def run(batches):
        words: Counter = Counter()

        def flush():
            total = count_grams(Counter({w: n for w, n in words.items() if w.isalpha()}))
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

        for _, texts in slices(batches, text_col):
            for t in texts:
                words.update(t.decode("utf-8", "replace").lower().split())
            if len(words) > KEEP:
                yield flush()
                words = Counter()
        if words:
            yield flush()

    got = (docs.select(text_col).mapInArrow(run, "b int, n double").groupBy("b")
           .agg(F.sum("n").alias("n")).toPandas())        # at most BUCKETS rows
    table = np.zeros(BUCKETS)
    table[got["b"].to_numpy(int)] = got["n"].to_numpy(float)
    return table


def _piece(token: str) -> str:
    """Its letters if they may be a piece of a spaced word, or an empty string."""
    core = token.strip(EDGE)
    if not 0 < len(core) <= SHORT or not (core.isalpha() or any(
            c.isalpha() for c in core) and all(c.isalpha() or c in LEET for c in core)):
        return ""
    return core


class _Ids(dict):
    """string -> its number, counted by first sight; ``names`` has them by number."""

    def __init__(self):
        self.names: list[str] = []

    def __missing__(self, name: str) -> int:
        got = self[name] = len(self.names)
        self.names.append(name)
        return got


class _Costs(dict):
    """letters -> cost of the last one behind the others."""

    def __init__(self, table: np.ndarray):
        self.table, self.total = table, max(1.0, float(table.sum()) / ORDER)

    def __missing__(self, key: str) -> float:
        p = 0.5 * (self.table[_bucket(key[-1])] + 0.5) / self.total
        for n in range(2, ORDER + 1):
            g = key[-n:]
            p = (self.table[_bucket(g)] + 5 * p) / (self.table[_bucket(g[:-1])] + 5)
        if len(self) > KEEP:
            self.clear()
        got = self[key] = -math.log(max(min(p, 1.0), 1e-12))
        return got


class _Moves(dict):
    """(context, piece) -> (cost, last letters after it) of writing the piece behind the context."""

    def __init__(self, costs: _Costs):
        self.costs = costs

    def __missing__(self, key: tuple[str, str]) -> tuple[float, str]:
        (last, piece), value = key, 0.0
        for c in piece:
            value += self.costs[last + c]
            last = last[1:] + c
        if len(self) > KEEP:
            self.clear()
        got = self[key] = (value, last)
        return got


class _Known(dict):
    """What ``restore`` gives, kept: token -> its restored words, word -> it without doubled
    letters, pieces -> how they join."""

    def __init__(self, restore):
        self.restore = restore

    def __missing__(self, token) -> tuple:
        if len(self) > KEEP:
            self.clear()
        got = self[token] = self.restore(token)
        return got


def _paired(tokens: list[str]) -> list[bool]:
    """Which tokens have a character twice in a row."""
    if not tokens:
        return []
    code = _codes(" ".join(tokens))
    wide = np.fromiter(map(len, tokens), np.int64) + 1
    same = np.append(code[1:] == code[:-1], False)
    return (np.add.reduceat(same, np.cumsum(wide) - wide) > 0).tolist()


class Decoder:
    """Restored words of a text under a table of n-gram counts."""

    def __init__(self, table: np.ndarray):
        self.costs, self.pieces = _Costs(table), _Known(_piece)
        self.moves, self.known = _Moves(self.costs), _Known(self._token)
        self.stretches, self.single = _Known(self._stretch), _Known(self.undoubled)
        self._forget()

    def _forget(self) -> None:
        """Tables of tokens, restored words and pieces by number, kept between slices."""
        self.ids, self.parts = _Ids(), _Ids()        # tokens and words; pieces
        self.parts[""]                               # number 0: no piece
        self.size, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.reads = np.zeros(0, np.int64)           # restored words, ``count`` from ``begin`` on
        self.seen = np.zeros(0, np.int64)            # slices with the token, halved by ``_shrink``
        self.wide, self.odd, self.alone = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)

    def spell(self, words: list[str]) -> np.ndarray:
        """Cost of each word as a whole, its end included; what ``cost`` adds up letter by letter."""
        out = [np.zeros(0)]
        for at in range(0, len(words), BATCH):
            joined = "".join([f"^^^{w}$" for w in words[at:at + BATCH]])
            wide = np.fromiter(map(len, words[at:at + BATCH]), np.int64)
            begin = np.cumsum(wide + ORDER) - wide - ORDER
            p, before = None, None
            for n, b in enumerate(_gram_buckets(_codes(joined))):
                count = self.costs.table[b]      # of the n-grams, by their first place
                here = count[ORDER - 1 - n:]     # those that end at the ORDER-th place and later
                p = (0.5 * (here + 0.5) / self.costs.total if before is None
                     else (here + 5 * p) / (before[ORDER - 1 - n:][:len(here)] + 5))
                before = count
            fee = -np.log(np.clip(p, 1e-12, 1.0))
            total = np.concatenate([[0.0], np.cumsum(fee)])
            out.append(total[begin + wide + 1] - total[begin])
        return np.concatenate(out)

    def cost(self, context: str, c: str) -> float:
        return self.costs[context + c]

    def viterbi(self, token: str) -> tuple[str, ...]:
        """The likeliest words behind ``token``. A state is the last letters emitted and
        the last character read; of equal states the cheaper stays."""
        start = "^" * (ORDER - 1)
        best: dict[tuple[str, str], tuple[float, tuple]] = {(start, ""): (0.0, ())}
        repeats = [len(list(g)) for _, g in groupby(token)]
        repeats = [n for n in repeats for _ in range(n)]
        for c, times in zip(token, repeats):
            nxt: dict[tuple[str, str], tuple[float, tuple]] = {}

            def put(context, last, value, path, nxt=nxt):
                old = nxt.get((context, last))
                if old is None or value < old[0]:
                    nxt[context, last] = (value, path)

            for (context, last), (value, path) in best.items():
                options = c if c.isalpha() else LEET.get(c, "")
                for letter in options:
                    fee = 0.0 if c.isalpha() else COST_LEET
                    put((context + letter)[1 - ORDER:], c,
                        value + fee + self.cost(context, letter), (path, letter))
                if c == last and context != start:
                    put(context, c, value + (COST_REPEAT if times > 2 else COST_DOUBLE), path)
                if not c.isalpha():
                    separator = c in SEPARATORS
                    put(context, c if not separator else last, value + (COST_JOIN if separator else COST_DROP), path)
                    if context != start:
                        put(start, "", value + (COST_BREAK if separator else COST_DROP)
                            + self.cost(context, "$"), (path, " "))
            best = nxt
        ends = [(v + (self.cost(context, "$") if context != start else 0.0), path)
                for (context, _), (v, path) in best.items()]
        path, letters = min(ends, key=lambda e: e[0])[1], []
        while path:
            path, letter = path
            letters.append(letter)
        return tuple("".join(reversed(letters)).split())

    def undoubled(self, word: str) -> tuple[str, ...]:
        """``viterbi`` of letters of which none is repeated more than once."""
        readings = self._readings(word)
        if not readings:
            return self.viterbi(word)
        value = self.spell([w for _, w in readings]) + [fee for fee, _ in readings]
        return (readings[int(value.argmin())][1],)

    @staticmethod
    def _readings(word: str) -> list[tuple[float, str]]:
        """(fee, word) with and without the second letter of each pair; none if there are many."""
        at = [m.start() for m in _DOUBLE.finditer(word)]
        if len(at) > 2:
            return []
        out = [(0.0, word)]
        for i in reversed(at):
            out += [(fee + COST_DOUBLE, w[:i] + w[i + 1:]) for fee, w in out]
        return out

    def _learn_doubled(self, words: list[str]) -> None:
        """Words with pairs of letters that are not known yet, at one go."""
        known, new, sizes, spelled, fees = self.single, [], [], [], []
        for word in words:
            readings = self._readings(word) if word not in known else []
            if readings:
                new.append(word)
                sizes.append(len(readings))
                fees += [fee for fee, _ in readings]
                spelled += [w for _, w in readings]
        value, at = self.spell(spelled) + np.array(fees), 0
        if len(known) + len(new) > KEEP:
            known.clear()
        for word, n in zip(new, sizes):
            known[word] = (spelled[at + int(value[at:at + n].argmin())],)
            at += n

    def token(self, token: str) -> tuple[str, ...]:
        return self.known[token]

    def _token(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGE)
        if core.isalpha():
            got = (core,)
            if _DOUBLE.search(core):
                if _TRIPLE.search(core):
                    got = self.viterbi(core)
                if got == (core,):       # a true pair stays beside
                    got += tuple(w for w in self.single[core] if w != core)
            # the look-alikes at the edges may belong to the word
            if len(core) < len(token) and _LOOKS.search(token):
                inner = token.strip(".,;:?\"')[]{}<>#%&*=/\\~`^-_")
                if inner != core and len(inner) - len(core) <= 2 and not _TRIPLE.search(inner):
                    got += self.viterbi(inner)
            return got
        if any(c.isalpha() for c in core):
            got = self.viterbi(token.strip(".,;:?\"')[]{}<>#%&*=/\\~`^-_"))
            return got + tuple(w for w in re.findall(r"[^\W\d_]+", core) if w not in got)
        return ()

    def spaced(self, run: tuple[str, ...]) -> tuple[str, ...]:
        """Words that the likeliest reading of short pieces in a row joins from several."""
        if not "".join(run).isalpha():
            plain = {w for p in run for w in self.token(p)}
            return tuple(w for w in self.viterbi(" ".join(run)) if w not in plain)
        # a piece of ORDER - 1 letters or more leaves one state behind it, whatever came
        # before: the lattice falls apart there, and its parts come back again and again
        joins, at, known, last = [False], 0, self.stretches, len(run) - 1
        for i in range(1, last + 1):
            if i == last or len(run[i]) >= ORDER - 1:
                joins += known[run[at:i + 1]]
                at = i
        if True not in joins:
            return ()
        out, word = [], []
        for piece, join in zip(run, joins):
            if not join:
                if len(word) > 1:
                    out.append("".join(word))
                word = []
            word.append(piece)
        return (*out, "".join(word)) if len(word) > 1 else tuple(out)

    def _stretch(self, run: tuple[str, ...]) -> tuple[bool, ...]:
        """Of the pieces behind the first, which the likeliest reading joins to the one before."""
        start, cost, moves = "^" * (ORDER - 1), self.cost, self.moves
        value, context = moves[start, run[0]]
        if len(run) == 2:                # most of them: two readings
            joined, behind = moves[context, run[1]]
            apart, alone = moves[start, run[1]]
            apart += cost(context, "$") + COST_BREAK
            if behind != alone:
                joined, apart = joined + cost(behind, "$"), apart + cost(alone, "$")
            return (joined + COST_JOIN <= apart,)
        best = {context: (value, ())}
        for piece in run[1:]:            # a state is the last letters; the cheaper stays
            nxt: dict[str, tuple[float, tuple]] = {}
            least, before = math.inf, ()
            for last, (so_far, path) in best.items():
                value, context = moves[last, piece]
                value += so_far + COST_JOIN
                if context not in nxt or value < nxt[context][0]:
                    nxt[context] = (value, (path, True))
                so_far += cost(last, "$") + COST_BREAK
                if so_far < least:
                    least, before = so_far, path
            value, context = moves[start, piece]
            if context not in nxt or value + least < nxt[context][0]:
                nxt[context] = (value + least, (before, False))
            best = nxt
        path = min(((v + cost(x, "$"), p) for x, (v, p) in best.items()), key=lambda e: e[0])[1]
        joins = []
        while path:
            path, join = path
            joins.append(join)
        return tuple(reversed(joins))

    def words(self, text: str) -> set[str]:
        return self.all_words([text])[0]

    def all_words(self, texts: list[str]) -> list[set[str]]:
        """The restored words of each text."""
        out: list[set[str]] = [set() for _ in texts]
        for i, w in zip(*(x.tolist() for x in self._found(texts))):
            out[i].add(self.ids.names[w])
        return out

    def restored(self, texts: list[str], least: int) -> pa.Array:
        """The sorted restored words of ``least`` letters and more of each text, one a line."""
        doc, word = self._found(texts)
        long = self.size[word] >= least
        doc, word = doc[long], word[long]
        rank = np.zeros(len(self.size), np.int64)
        rank[word] = 1
        used = np.flatnonzero(rank)
        some = pa.array([self.ids.names[w] for w in used.tolist()], pa.string())
        order = pc.sort_indices(some)
        rank[used[order.to_numpy()]] = np.arange(len(used))
        key = np.sort(doc * len(used) + rank[word])
        doc, word = np.divmod(key[np.append(True, key[1:] != key[:-1])[:len(key)]], max(1, len(used)))
        ends = np.cumsum(np.bincount(doc + 1, minlength=len(texts) + 1))
        return pc.binary_join(pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), some.take(order).take(pa.array(word))), "\n")

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of a restored word), some of them more than once."""
        if len(self.ids) > TOKENS or self.size.sum() > LETTERS:
            self._shrink()
        cut = [t.lower().split() for t in texts]
        long = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(cut)), np.int64, long.sum())
        del cut
        doc = np.repeat(np.arange(len(texts)), long)
        if not len(ids):
            return doc, ids
        self._learn(ids)
        reads, n = self._reads(ids)
        found = [(np.repeat(doc, n), reads), self._single(ids, doc), self._runs(ids, doc)]
        self._grow()
        return tuple(np.concatenate(x) for x in zip(*found))

    def _reads(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Restored words of the tokens one after another, and how many each has."""
        n = self.count[ids]
        return self.reads[np.repeat(self.begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def _shrink(self) -> None:
        """Forget tokens that one slice had, and words that only such gave; all if too many stay."""
        keep = self.seen > 1
        tokens = np.flatnonzero(keep)
        if (2 * len(tokens) > TOKENS or 2 * self.size[tokens].sum() > LETTERS
                or len(self.parts) > KEEP):
            self._forget()
            return
        reads, n = self._reads(tokens)
        self.count[~keep] = -1
        self.begin[tokens] = np.cumsum(n) - n
        keep[reads] = True
        self.reads = (np.cumsum(keep) - 1)[reads]
        ids = _Ids()
        for i in np.flatnonzero(keep).tolist():
            ids[self.ids.names[i]]
        self.ids, self.size, self.piece, self.begin, self.count, self.seen = (
            ids, self.size[keep], self.piece[keep], self.begin[keep], self.count[keep], self.seen[keep] // 2)

    def _grow(self) -> None:
        """Places for the tokens, words and pieces that were seen since."""
        names, parts = self.ids.names[len(self.size):], self.parts.names[len(self.wide):]
        self.size = np.append(self.size, np.fromiter(map(len, names), np.int64, len(names)))
        self.piece, self.begin, self.seen, self.count = (
            np.append(x, np.full(len(names), y)) for x, y in
            ((self.piece, 0), (self.begin, 0), (self.seen, 0), (self.count, -1)))
        self.wide = np.append(self.wide, np.fromiter(map(len, parts), np.int64, len(parts)))
        self.odd = np.append(self.odd, np.array([not p.isalpha() for p in parts], bool))
        self.alone = np.append(self.alone, self.spell(parts))

    def _learn(self, ids: np.ndarray) -> None:
        """Restored words and pieces of those tokens that were not read before."""
        self._grow()
        new = np.zeros(len(self.size), bool)
        new[ids] = True
        self.seen += new
        new = np.flatnonzero(new & (self.count < 0))
        tokens = [self.ids.names[i] for i in new.tolist()]
        cores, double = [t if t.isalpha() else t.strip(EDGE) for t in tokens], _paired(tokens)
        self._learn_doubled([*{c for c, twice in zip(cores, double) if twice and c.isalpha()
                               and _DOUBLE.search(c) and not _TRIPLE.search(c)}])
        piece, reads, count = [], [], []
        for i, token, core, twice in zip(new.tolist(), tokens, cores, double):
            if not core.isalpha():
                piece.append(self.parts[_piece(token)])
                words = [self.ids[w] for w in self._token(token)]
            else:
                piece.append(self.parts[core] if len(core) <= SHORT else 0)
                if twice or len(core) < len(token) and _LOOKS.search(token):
                    words = [self.ids[w] for w in self._token(token)]
                else:                                # one reading, the token itself
                    words = (i if len(core) == len(token) else self.ids[core],)
            reads += words
            count.append(len(words))
        self._grow()
        self.piece[new], self.count[new] = piece, count
        self.begin[new] = len(self.reads) + np.cumsum(self.count[new]) - self.count[new]
        self.reads = np.append(self.reads, np.array(reads, np.int64))

    def _single(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of single characters in a row, which are one lattice."""
        link = np.zeros(len(ids) + 1, bool)          # place i and the one before it are in one run
        short = self.size[ids] == 1
        link[1:-1] = short[1:] & short[:-1] & (doc[1:] == doc[:-1])
        docs, words = [], []
        for lo, hi in zip(np.flatnonzero(link[1:] & ~link[:-1]), np.flatnonzero(link[:-1] & ~link[1:])):
            run = [self.ids.names[k] for k in ids[lo:hi + 1].tolist()]
            if len(run) > 2 and sum(t.isalnum() or t in LEET for t in run) > 2:
                words += [self.ids[w] for w in self.viterbi(" ".join(run))]
                docs += [doc[lo]] * (len(words) - len(docs))
        return np.array(docs, np.int64), np.array(words, np.int64)

    def _runs(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) for the words that ``spaced`` finds in each run of pieces of a text.

        What a run's stretches (see ``spaced``) cost is worked out for all of them at once:
        the likeliest way to cut a stretch into words is a shortest path over its ends."""
        part, names = self.piece[ids], self.parts.names
        wide = self.wide[part]
        link = np.zeros(len(ids) + 1, bool)      # place i and the one before it are in one run
        link[1:-1] = (wide[1:] > 0) & (wide[:-1] > 0) & (doc[1:] == doc[:-1])
        before, behind = link[:-1], link[1:]
        heads = np.flatnonzero(behind & ~before)
        tails = np.flatnonzero(before & ~behind)
        many = np.append(0, np.cumsum(self.odd[part]))
        dirty = many[tails + 1] > many[heads]
        docs, words = [], []
        for lo, hi in zip(heads[dirty].tolist(), tails[dirty].tolist()):
            words += [self.ids[w] for w in self.spaced(tuple(names[k] for k in part[lo:hi + 1].tolist()))]
            docs += [doc[lo]] * (len(words) - len(docs))
            behind[lo:hi] = False                # these are done
        cuts = np.flatnonzero((before | behind) & ((wide >= ORDER - 1) | ~before | ~behind))
        first = cuts[behind[cuts]]
        length = np.append(cuts[1:], 0)[behind[cuts]] - first + 1
        joins = np.zeros(len(ids) + 1, bool)     # place i is joined to the one before it
        for n, at, rows, same in self._alike(part, first, length):
            joins[at[:, None] + np.arange(1, n)] = self._cut(rows, names, self.alone[rows])[same]
        begin = np.flatnonzero(joins[1:] & ~joins[:-1])
        end = np.flatnonzero(joins[:-1] & ~joins[1:]) + 1
        docs, words = [np.array(docs, np.int64)], [np.array(words, np.int64)]
        for n, at, rows, same in self._alike(part, begin, end - begin):
            text = [self.ids["".join([names[k] for k in row])] for row in rows.tolist()]
            docs.append(doc[at])
            words.append(np.array(text, np.int64)[same])
        return np.concatenate(docs), np.concatenate(words)

    def _alike(self, part: np.ndarray, first: np.ndarray, length: np.ndarray):
        """Rows of two pieces and more by length: (length, first places, distinct rows, row of each)."""
        for n in np.unique(length).tolist():
            at = first[length == n]
            rows = part[at[:, None] + np.arange(n)]
            same = rows[:, 0]
            if n > LONG:                         # few
                yield n, at, rows, np.arange(len(rows))
                continue
            for k in range(1, n):
                _, where, same = np.unique(same * len(self.parts) + rows[:, k],
                                           return_index=True, return_inverse=True)
            yield n, at, rows[where], same

    def _cut(self, rows: np.ndarray, pieces: list[str], alone: np.ndarray) -> np.ndarray:
        """Which pieces of each row (a stretch) are joined to the one before, the first left out;
        ``alone`` is what each costs as a word."""
        n = rows.shape[1]
        if n > LONG:
            return np.array([self.stretches[tuple(pieces[k] for k in r)] for r in rows.tolist()])
        text = [[pieces[k] for k in column] for column in rows.T.tolist()]
        cost = {(a, a + 1): alone[:, a] for a in range(n)}
        for a in range(n):
            word = text[a]
            for b in range(a + 1, n):
                word = [x + y for x, y in zip(word, text[b])]
                cost[a, b + 1] = self.spell(word) + COST_JOIN * (b - a)
        best, came = [np.zeros(len(rows))], []
        for b in range(1, n + 1):
            value = np.stack([best[a] + cost[a, b] + (COST_BREAK if a else 0.0) for a in range(b)])
            came.append(value.argmin(0))
            best.append(value.min(0))
        joins, end = np.ones((len(rows), n), bool), np.full(len(rows), n)
        for b in range(n, 0, -1):
            here = np.flatnonzero(end == b)
            end[here] = came[b - 1][here]
            joins[here, end[here]] = False
        return joins[:, 1:]


def beginnings(words: set[str]) -> set[str]:
    """Beginnings of words, marked by a trailing ``*``."""
    return {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def stems(items) -> set[str]:
    """The first letters of those of ``items`` that are beginnings."""
    return {i[:PREFIXES[0]] for i in items if i.endswith("*")}


def begun(words: set[str], known, stem: set[str]) -> set[str]:
    """``beginnings`` of the words that are in ``known``, whose ``stems`` are ``stem``."""
    n = PREFIXES[0]
    return {b for b in beginnings({w for w in words if w[:n] in stem}) if b in known}


def evidence(words: set[str], sure, stem: set[str] | None = None) -> set[str]:
    """Which of ``sure`` a text holds; a beginning counts only for words not in it."""
    found = sure.keys() & words
    return found | begun(words - found, sure, stems(sure) if stem is None else stem)


def labelled(restored: DataFrame, marks: DataFrame) -> DataFrame:
    """(_id, _y, words): each distinct labelled text once, toxic if any copy is."""
    few = marks.count() <= BROADCAST_IDS
    known = restored.where("_train")
    one = (known.join(F.broadcast(marks) if few else marks, F.col("_id") == F.col("_lid"))
           .groupBy("h").agg(F.min("_id").alias("_lid"), F.max("_y").alias("_y"))
           .withColumnRenamed("h", "_h"))
    return known.join(F.broadcast(one) if few else one, (F.col("_id") == F.col("_lid"))
                      & (F.col("h") == F.col("_h"))).select("_id", "_y", "words")


def _words(t: bytes) -> set[str]:
    """The words that the restored table holds as one string."""
    return set(t.decode().split("\n")) if t else set()


def picked(words: pa.Array, whole, stem) -> list[set[str]]:
    """Of each text the restored words that are in ``whole`` or begin with one of ``stem``."""
    lists = pc.split_pattern(words, "\n")
    word, text = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.or_(pc.is_in(word, pa.array(list(whole), pa.string())), pc.is_in(
        pc.utf8_slice_codeunits(word, 0, PREFIXES[0]), pa.array(list(stem), pa.string())))
    out: list[set[str]] = [set() for _ in range(len(words))]
    for i, w in zip(text.filter(keep).to_pylist(), word.filter(keep).to_pylist()):
        out[i].add(w)
    return out


def _tally(rows: DataFrame, found, least: int = 1) -> dict[str, int]:
    """Texts per item of ``found(words)``, for items of at least ``least`` texts."""

    def run(batches):
        count: Counter = Counter()
        for _, texts in slices(batches, "words"):
            for t in texts:
                count.update(found(_words(t)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
            names=["w", "n"])

    got = (rows.select("words").mapInArrow(run, "w string, n long").groupBy("w")
           .agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return {r["w"]: r["n"] for r in got.collect()}


def _certain(toxic: dict[str, int], clean: dict[str, int], bound: float) -> dict[str, float]:
    """Precision of the items whose lower confidence bound reaches ``bound``."""
    out = {}
    for w, k in toxic.items():
        n = k + clean.get(w, 0)
        p = k / n
        low = (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
        if low >= bound:
            out[w] = (k + 0.1) / (n + 1)
    return out


def learn(rows: DataFrame) -> tuple[dict[str, float], float]:
    """(evidence -> precision, rate of toxic texts without any) from (_y, words) rows.

    Words first; then beginnings, on the words that are not evidence themselves. What
    is collected occurs in ``MIN_SHARE`` of the toxic texts, or is one of those items."""
    sizes = {r["_y"] > 0.5: r["n"] for r in
             rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = rows.where("_y > 0.5"), rows.where("_y <= 0.5")
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * sizes.get(True, 0)))

    toxic = _tally(bad, lambda w: w, least)
    known = set(toxic)
    sure = _certain(toxic, _tally(good, lambda w: w & known), CERTAIN)
    words = set(sure)
    toxic = _tally(bad, lambda w: beginnings(w - words), least)
    begins, stem = set(toxic), stems(toxic)
    sure |= _certain(toxic, _tally(good, lambda w: begun(w - words, begins, stem)), CERTAIN_BEGINNING)
    stem = stems(sure)
    left = _tally(bad, lambda w: () if evidence(w, sure, stem) else ("",)).get("", 0)
    return sure, left / max(1, left + sizes.get(False, 0))


_DECODERS: dict = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, train: F.Column, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """(id, score, predicted) of every row; ``train`` says which rows' labels may be learned."""
    import uuid

    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"),
                      (train & F.col(text_col).isNotNull()).alias("_train"),
                      F.xxhash64(text_col).alias("h"))
    table = sc.broadcast(language_model(src))       # BUCKETS numbers
    key = uuid.uuid4().hex
    kind = src.schema["_id"].dataType.simpleString()

    def restore(rows, texts):
        claim("toxicity", _DECODERS.clear)
        if key not in _DECODERS:
            _DECODERS.clear()
            _DECODERS[key] = Decoder(table.value)
        found = _DECODERS[key].restored([t.decode("utf-8", "replace") for t in texts], 3)
        return [rows.column(0), rows.column(1), rows.column(2), found]

    restored = written(map_texts(src, ["_id", "_train", "h"], restore,
                                 f"_id {kind}, _train boolean, h long, words string"), "restored")
    sure, rest = learn(labelled(restored, labels_by_id(labels.select(id_col, label_col),
                                                       id_col, label_col)))

    stem = stems(sure)

    def run(rows, texts):
        out = np.empty(len(texts))
        for i, words in enumerate(picked(rows.column(1), sure, stem)):
            hits = evidence(words, sure, stem) if sure else ()
            out[i] = rest
            if hits:
                apart = {h.rstrip("*")[:4] for h in hits}
                out[i] = max(rest, 1 - (1 - max(sure[h] for h in hits)) * 0.5 ** (len(apart) - 1))
        return [rows.column(0), out, (out >= threshold).astype(np.int32)]

    return map_texts(restored, ["_id"], run, f"_id {kind}, score double, predicted int",
                     text_col="words").withColumnRenamed("_id", id_col)
