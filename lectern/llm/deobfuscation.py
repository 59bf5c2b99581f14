"""Noisy-channel restoration of disguised words: Viterbi over a lattice of letters under a character language model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Learnt, texts_of

#: What a sign may stand for, in the order 0 to 9, then symbols.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "*": "aeiou", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "£": "l", "€": "e", "¥": "y",
}
#: Log probabilities of the channel: a look-alike sign; a sign put between letters, and one that looks like a letter;
#: a letter written once more, and a sign.
SWAPPED, INSERTED, INSERTED_ALIKE, REPEATED, REPEATED_SIGN = -1.0, -1.0, -9.0, -1.2, -0.3
#: A gap inside a word that is wider than others of its run.
INSERTED_WIDE = -9.0
#: Readings of a run written letter by letter count down to this much below the likeliest one; units of a word in them.
MARGIN, LONGEST = 4.0, 32

#: The model's letters: a to z, then the lower-case letters of Latin-1; all others are one class. 0 is a word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1
_TABLE = np.array([CODE.get(chr(i), OTHER if chr(i).isalpha() else 0) for i in range(0x250)] + [OTHER], np.int64)
_STEP = 1 << 20
#: Different signs whose readings are held.
SIGNS = 20_000

_CLEAN = re.compile(r"[^\W\d_]+")
_DOUBLE, _AGAIN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
_PRICE = re.compile(r"[$£€¥+|(<{]?[\W\d]?[\d.,:]+[%$£€¥+|]?")
_HEAD, _TAIL = re.compile(r"^[^\w@$|+(<{£€¥!]+|^([^\w])\1{2,}"), re.compile(r"[^\w@$|+]+$|([^\w])\1{2,}[^\w]*$")
_RUN = re.compile(r"(?<!\S)\S(?:\s++\S(?!\S)){2,}")
#: Units so short that the space between two of them may be a sign put into a word; searched behind a space, which is
#: faster than looking back from every sign.
_SHORT = re.compile(r"\s(\S{1,3}(?:\s++\S{1,3}(?!\S))+)")
_NEXT = re.compile(r"\s+|\S+")


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]  # far scripts are the class of other letters


def trigram_counts(docs: DataFrame) -> DataFrame:
    """Counts of letter trigrams (``gram``, ``n``) over every whole text; edges of words count as a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in [*texts_of(batch.column(0)), None]:
                if text is not None:
                    held.append(text)
                    size += len(text)
                if held and (text is None or size > _STEP):
                    c = np.concatenate([[0, 0], _codes("\n".join(held)), [0, 0]])
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
                    held, size = [], 0
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others, smoothed by shorter contexts: 61 ** 3 numbers at any input size."""
    found = trigram_counts(docs).toArrow()
    n = np.zeros(SIZE ** 3)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(SIZE, SIZE, SIZE)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def bare(unit: str) -> str:
    """A unit in lower case without signs at its ends."""
    word = unit.lower()
    return word if word.isalpha() else _TAIL.sub("", _HEAD.sub("", word))


def stays(start: str) -> bool:
    """Whether every word read from a lower-case text that starts like this starts like it too: a letter can only go where
    it is repeated, and only other signs stand for something else."""
    return start.isalpha() and not _DOUBLE.search(start)


class _Codes(dict):
    """Codes of characters, :data:`OTHER` for those without one."""

    def __missing__(self, c: str) -> int:
        return OTHER


_CODE_OF = _Codes(CODE).__getitem__


class Restorer:
    """Restores units (what stands between white space) with a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.flat = model.ravel().tolist()  # numbers of a list are read several times faster than those of an array
        self.signs: dict[str, tuple] = {}

    def _sign(self, c: str) -> tuple:
        """Of a sign: what it may stand for, whether it may be left out where it is new, and the cost then and if repeated."""
        if c not in self.signs:
            if len(self.signs) >= SIGNS:
                self.signs.clear()
            letter = c.isalpha()
            options = [(c, 0.0)] if letter else [(x, SWAPPED) for x in LOOKS_LIKE.get(c, "")]
            alike = bool(options) and c != "*"
            self.signs[c] = ([(x, cost, CODE.get(x, OTHER)) for x, cost in options], not letter,
                             INSERTED_ALIKE if alike else INSERTED,
                             REPEATED if letter else 4 * REPEATED if alike else REPEATED_SIGN)
        return self.signs[c]

    def unit(self, unit: str) -> str:
        """The word a unit stands for, in lower case without signs at its ends; plain words are only lower-cased.

        A word of signs alone is read as letters if it has three look-alikes of two kinds and isn't a number or price.
        """
        return self.read(bare(unit))

    def read(self, word: str) -> str:
        """The word that a bare unit stands for."""
        if word.isalpha() or _CLEAN.fullmatch(word):
            return self.collapsed(word) if _DOUBLE.search(word) else word
        if not any(map(str.isalpha, word)):
            alike = [c for c in word if c in LOOKS_LIKE]
            if len(alike) < 3 or len(set(alike)) < 2 or all(map(str.isdigit, alike)) or _PRICE.fullmatch(word):
                return word
        return self.viterbi(word)

    def collapsed(self, word: str) -> str:
        """What :meth:`viterbi` reads from letters alone: its lattice only leaves out repeated letters, so a word with few
        of them has few readings, which are scored one by one."""
        runs = [(m.start(), m.end()) for m in _AGAIN.finditer(word)]
        if sum(b - a - 1 for a, b in runs) > 3:
            return self.viterbi(word)
        readings = [(0.0, "")]
        at = 0
        for a, b in runs:
            readings = [(cost + n * REPEATED, text + word[at:b - n]) for cost, text in readings for n in range(b - a)]
            at = b
        flat, best, found = self.flat, -1e300, word
        for total, text in readings:
            text += word[at:]
            x = y = 0
            for z in map(_CODE_OF, text):
                total += flat[(x * SIZE + y) * SIZE + z]
                x, y = y, z
            total += flat[(x * SIZE + y) * SIZE]
            if total > best:
                best, found = total, text
        return found

    def viterbi(self, seen: str) -> str:
        """The likeliest letters behind ``seen``. A state is the last two letters; steps are those of the lattice.

        A space is a sign put into a word or an edge of words, which stays a space; a tab is one as well, but wider.
        """
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(seen):
            if c not in " \t":
                best = self._read(best, c, i > 0 and seen[i - 1] == c)
                continue
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            skip = INSERTED if c == " " else INSERTED_WIDE
            for (a, b), (score, text) in best.items():
                if (a, b) not in step or step[a, b][0] < score + skip:
                    step[a, b] = (score + skip, text)
                total = score + self.flat[(a * SIZE + b) * SIZE]
                if text and text[1] != " " and ((0, 0) not in step or step[0, 0][0] < total):
                    step[0, 0] = (total, (text, " "))
            best = step
        return self._end(best)[1].rstrip(" ")

    def _read(self, best: dict, c: str, again: bool) -> dict:
        """The states after one more sign, which is a letter, stands for one, or was put in."""
        flat = self.flat
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        options, loose, skip, repeated = self._sign(c)
        if again:
            loose, skip = True, repeated
        for state, (score, text) in best.items():
            if loose and (state not in step or step[state][0] < score + skip):
                step[state] = (score + skip, text)
            a, b = state
            at = (a * SIZE + b) * SIZE
            for x, cost, code in options:
                total = score + cost + flat[at + code]
                if (b, code) not in step or step[b, code][0] < total:
                    step[b, code] = (total, (text, x))
        return step

    def _end(self, best: dict) -> tuple[float, str]:
        score, text = max(((s + self.flat[(a * SIZE + b) * SIZE], t) for (a, b), (s, t) in best.items()),
                          key=lambda x: x[0], default=(0.0, ()))
        found = []
        while text:
            text, x = text
            found.append(x)
        return score, "".join(reversed(found))

    def likely_words(self, units: list[str], wide: list[bool]) -> list[str]:
        """Words of all readings of a run that come within ``MARGIN`` of the likeliest; ``wide`` tells each gap's width."""
        n, words = len(units), []
        for i in range(n):
            best = {(0, 0): (0.0, ())}
            for j in range(i, min(n, i + LONGEST)):
                skip = (INSERTED_WIDE if wide[j - 1] else INSERTED) if j > i else 0.0
                best = {k: (s + skip, t) for k, (s, t) in best.items()}
                for k, c in enumerate(units[j]):
                    best = self._read(best, c, k > 0 and units[j][k - 1] == c)
                score, word = self._end(best)
                words.append((i, j + 1, score, word))
        ahead, behind = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
        for i, j, score, _ in words:
            ahead[j] = max(ahead[j], ahead[i] + score)
        for i, j, score, _ in reversed(words):
            behind[i] = max(behind[i], score + behind[j])
        return list(dict.fromkeys(w for i, j, s, w in words if ahead[i] + s + behind[j] >= ahead[n] - MARGIN))

    def joins(self, before: str, after: str) -> bool:
        """Whether the space between two plain pieces is likelier a sign put into a word, by the letters next to it."""
        (a, b), (c, d) = ([CODE.get(x, OTHER) for x in y] for y in (before[-2:], after[:2]))
        log = self.model
        return bool(INSERTED + log[a, b, c] + log[b, c, d] > log[a, b, 0] + log[0, 0, c] + log[0, c, d])


class Runs(Learnt):
    """The words that a run of short units stands for, where they differ from its units."""

    def __init__(self, restorer: Restorer):
        super().__init__(self.differing, 12 << 20)
        self.restorer = restorer
        self.joined = Learnt(lambda key: restorer.joins(*key), 6 << 20)

    def _words(self, run: str) -> list[str]:
        units = run.lower().split()
        plain = " ".join(units)
        if min(map(len, units)) > 1 and "".join(units).isalpha() and not _DOUBLE.search(plain):  # each gap stands for itself
            words, joined = [units[0]], self.joined
            for before, after in zip(units, units[1:]):
                if joined[before[-2:], after[:2]]:
                    words[-1] += after
                else:
                    words.append(after)
            return words
        if not any(map(str.isalpha, run)) or min(map(len, units)) > 1 and not any(c in LOOKS_LIKE for c in run):
            return units
        gaps = [len(g) for g in _NEXT.findall(run) if g.isspace()]
        wide = min(gaps)
        more = self.restorer.likely_words(units, [g > wide for g in gaps]) if _RUN.search(run) else []
        return more + self.restorer.viterbi(units[0] + "".join(
            ("\t" if g > wide else " ") + u for g, u in zip(gaps, units[1:]))).split(" ")

    def differing(self, run: str) -> list[str]:
        units = set(run.lower().split())
        return [w for w in self._words(run) if len(w) > 2 and w not in units]


def spaced_words(text: str) -> list[str]:
    """Runs of three or more single signs between white space, joined: words written letter by letter."""
    return ["".join(m.group().split()) for m in _RUN.finditer(text)]


def short_runs(text: str) -> list[str]:
    """Runs of two or more short units between white space, as they stand."""
    return _SHORT.findall(" " + text)


def restored_words(text: str, restore, runs: Runs) -> list[str]:
    """All words of a text as ``restore`` gives them; behind them, those of runs of short units, joined and decoded."""
    words = [*map(restore, text.split())]
    short = short_runs(text)
    for run in short:  # single signs between white space are short units, so the text need not be read for them again
        words += map(restore, spaced_words(run))
    for run in short:
        words += map(restore, runs[run])
    return words


class Known(Learnt):
    """What a function of units gives for each unit of a text, and for the words of its runs of short units.

    ``starts`` may hold the first ``START`` letters of all words of interest (shorter words whole). What can't be read as
    one of them is left out unread.
    """

    START = 3

    def __init__(self, restorer: Restorer, of: Callable[[str], str], starts: set[str] | None = None):
        super().__init__(of)
        self.short = Runs(restorer)
        self.runs = Learnt(self._of_run, 12 << 20)
        self.may = None if starts is None else Learnt(lambda start: start in starts or not stays(start), 4 << 20)

    def _of_run(self, run: str) -> tuple[str, ...]:
        return tuple({self[w] for w in (*spaced_words(run), *self.short.differing(run))})

    def _may_hold(self, run: str) -> bool:
        """Whether a word may start at one of a run's units; words of runs have three letters or more."""
        units = run.lower().split()
        joined, at, may = "".join(units), 0, self.may
        for unit in units:
            if may[joined[at:at + self.START]]:
                return True
            at += len(unit)
        return False

    def different(self, text: str) -> set[str]:
        """The set of :func:`restored_words`, but for what is left out. Units are told apart without case and the stops
        behind them, which the restorer takes off too, so that fewer of them are new."""
        plain = text.lower()
        alone = len(plain) == len(text) and "Σ" not in text  # lower case of each letter by itself
        units, short = set(plain.split()), short_runs(plain if alone else text)
        if self.may is not None:
            may, n = self.may, self.START
            units, short = [u for u in units if may[u[:n]]], filter(self._may_hold, short)
        found = set(map(self.__getitem__, {u.rstrip(".,") for u in units}))
        for run in set(short):
            found.update(self.runs[run])
        return found
