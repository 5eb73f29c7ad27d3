"""Text that was decoded in the wrong encoding: found, and restored where that is possible.

A character n-gram model is trained on the clean records of the table itself.  Every candidate chain
(encode the text as the encoding it was wrongly read in, decode it as the one it was written in,
for some chains twice) is scored by how much likelier it makes the text; a passage is taken as
garbled where the likeliest chain's gain exceeds a margin that is validated on the lines of held-out
clean records, as they are and garbled on purpose.

Which records are clean is told by a first model, trained on all of them.  Left out of the second,
which judges, are whole records: those with lines that the first model finds garbled, with a
replacement character, or with a word that is whole UTF-8 sequences in a wrong encoding and not less
likely when read as such, as hardly any other text is.  The first model knows every word that it
judges: so neither does garbled text that occurs often pass for clean, nor is a rare clean word left
out, after which nothing would speak for it.

Only passages with characters beyond ASCII can be garbled, as all encodings here agree on ASCII.
Passages are lines; their words are scored once per worker and the scores summed along the line.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: Encodings in which texts get wrongly read, and in which they were written.
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "koi8_r", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "iso8859_2", "iso8859_7")
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "koi8_r", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859_2", "iso8859_7", "iso8859_5")
MULTIBYTE = ("utf_8", "shift_jis", "euc_jp")
#: Sizes of the hashed n-gram tables; together 6 MB, whatever the corpus.
UNI, BI, TRI = 1 << 16, 1 << 18, 1 << 20
_K = 4.0
#: Gain of a chain that can't be applied to a word.
NOT_APPLICABLE = -25.0
REPLACEMENT = "�"
#: Words whose gains a worker keeps (about 1 kB each), and words scored at once.
_CACHE, _PORTION = 60_000, 100_000


@lru_cache(maxsize=None)
def _table(encoding: str) -> np.ndarray:
    """The character of each byte; bytes without one keep their number, as lenient decoders do."""
    out = np.arange(256)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _inverse(encoding: str) -> np.ndarray:
    """The byte of each character up to U+FFFF, -1 where there is none."""
    out = np.full(UNI, -1, np.int64)
    table = _table(encoding)
    out[table[::-1]] = np.arange(256)[::-1]
    return out


def _singles() -> list[tuple[str, str]]:
    return [(r, w) for r in READ_AS for w in WRITTEN_IN if r != w]


def _multis() -> list[tuple[str, ...]]:
    """Chains over multi-byte encodings, and UTF-8 read wrongly twice."""
    single = [(r, w) for w in MULTIBYTE for r in READ_AS]
    double = [(r2, "utf_8", r1, "utf_8") for r2 in ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman") for r1 in ("cp1252", "latin_1", "cp1250", "cp1251")]
    return single + double


SINGLES, MULTIS = _singles(), _multis()
CHAINS: list[tuple[str, ...]] = [*SINGLES, *MULTIS]


@lru_cache(maxsize=None)
def _letters(encoding: str) -> str:
    """The characters of all 256 bytes."""
    return "".join(map(chr, _table(encoding)))


@lru_cache(maxsize=None)
def _charmap(encoding: str):
    return codecs.charmap_build(_letters(encoding))


def _encoded(text: str, encoding: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _charmap(encoding))[0]
    except UnicodeEncodeError:
        return None


def apply_chain(text: str, chain: tuple[str, ...], errors: str = "strict") -> str | None:
    """``text`` encoded and decoded along ``chain``; None where that is impossible."""
    for read, written in zip(chain[::2], chain[1::2], strict=True):
        raw = _encoded(text, read)
        if raw is None:
            return None
        if written in MULTIBYTE:
            try:
                text = raw.decode(written, errors)
            except UnicodeDecodeError:
                return None
        else:
            text = codecs.charmap_decode(raw, "strict", _letters(written))[0]
    return text


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """What ``text`` becomes when it is wrongly read along ``chain``; None where it can't have been written so."""
    steps = list(zip(chain[::2], chain[1::2], strict=True))
    for read, written in reversed(steps):
        if written in MULTIBYTE:
            try:
                raw = text.encode(written)
            except UnicodeEncodeError:
                return None
        else:
            raw = _encoded(text, written)
            if raw is None:
                return None
        text = codecs.charmap_decode(raw, "strict", _letters(read))[0]
    return text


def words_beyond_ascii(text: str) -> list[list[str]]:
    """For each line of ``text`` that has any, its words with characters beyond ASCII."""
    if text.isascii():
        return []
    if "\r" in text:
        text = text.replace("\r", " ")
    if "\t" in text:
        text = text.replace("\t", " ")
    return [[w for w in line.split(" ") if not w.isascii()] for line in text.split("\n") if not line.isascii()]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all words, each word with two marks before and one after it; and where words start."""
    joined = "".join(["\x02\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.cumsum([0] + [len(w) + 3 for w in words[:-1]]) if words else np.zeros(0, np.int64)
    return np.minimum(codes, UNI - 1), np.asarray(starts, np.int64)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_grams_of`` each character from the third on and the two before it."""
    return _grams_of(codes[:-2], codes[1:-1], codes[2:])


def _grams_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the bigram table of (a, b) and (b, c), and in the trigram table of (a, b, c), for each c."""
    ab = (a * 1_000_003 + b) * 2_654_435_761
    bc = (b * 1_000_003 + c) * 2_654_435_761
    abc = ((a * 1_000_003 + b) * 1_000_003 + c) * 2_654_435_761
    return (ab >> 13) & (BI - 1), (bc >> 13) & (BI - 1), (abc >> 13) & (TRI - 1)


@dataclass
class Model:
    """Smoothed counts of character n-grams; each order is interpolated with the one below."""

    uni: np.ndarray = field(default_factory=lambda: np.zeros(UNI, np.float32))
    bi: np.ndarray = field(default_factory=lambda: np.zeros(BI, np.float32))
    tri: np.ndarray = field(default_factory=lambda: np.zeros(TRI, np.float32))
    margin: float = 6.0
    #: Shares of held-out clean and garbled lines that the margin judges wrongly.
    clean_errors: float = 0.0
    garbled_errors: float = 0.0

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """For each character from the third on, its log probability after the two before it."""
        return self.log_next(codes[:-2], codes[1:-1], codes[2:])

    def log_next(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The log probability of each c after a and b."""
        ab, bc, abc = _grams_of(a, b, c)
        base = (self.uni[c] + 0.02) / (self.uni.sum() + 0.02 * UNI)
        two = (self.bi[bc] + _K * base) / (self.uni[b] + _K)
        return np.log((self.tri[abc] + _K * two) / (self.bi[ab] + _K))

    def scores(self, words: list[str]) -> np.ndarray:
        """The log probability of each word."""
        if not words:
            return np.zeros(0)
        codes, starts = _codes(words)
        return _sums(self.log_p(codes), codes, starts)


def _sums(log_p: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    # position i of log_p is character i + 2; the marks that open the next word count as nothing
    log_p = np.where(codes[2:] == 2, 0.0, log_p)
    return np.add.reduceat(log_p, np.minimum(starts, len(log_p) - 1))


@lru_cache(maxsize=None)
def _scripts() -> np.ndarray:
    """A bit for the script of each letter: Latin 1, Greek 2, Cyrillic 4, kana and ideographs 8; 0 for all else."""
    out = np.zeros(UNI, np.uint8)
    for c in range(UNI):
        ch = chr(c)
        if ch.isalpha():
            if c < 0x250 or 0x1E00 <= c < 0x1F00:
                out[c] = 1
            elif 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
                out[c] = 2
            elif 0x400 <= c < 0x530:
                out[c] = 4
            elif 0x3040 <= c < 0xA000 or 0xFF66 <= c < 0xFFA0:
                out[c] = 8
    out[[0xAA, 0xB5, 0xBA]] = 0  # signs, though they count as letters
    return out


#: Log odds against alphabets that mix within a word (Latin, Greek, Cyrillic).
MIXED = 8.0


def _mixed(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    used = np.bitwise_or.reduceat(_scripts()[codes], starts) & 7
    return np.where((used & (used - 1)) > 0, MIXED, 0.0)


def gains(model: Model, words: list[str]) -> np.ndarray:
    """A row a word, a column a chain: by how much the chain raises the word's log probability."""
    out = np.full((len(words), len(CHAINS)), NOT_APPLICABLE, np.float32)
    if not words:
        return out
    codes, starts = _codes(words)
    own = _sums(model.log_p(codes), codes, starts) - _mixed(codes, starts)
    lengths = np.diff(np.append(starts, len(codes)))
    beyond = codes >= 128
    n_beyond = np.add.reduceat(beyond.astype(np.int64), starts)
    seen = model.uni > 0
    decoded, where = [], []
    for read in READ_AS:
        raw = np.where(beyond, _inverse(read)[codes], codes)
        fits = np.flatnonzero(np.minimum.reduceat(raw, starts) >= 0)
        if not len(fits):
            continue
        part = np.repeat(_member(fits, len(words)), lengths)
        raw, old, high = raw[part], codes[part], beyond[part]
        at = np.cumsum(np.append(0, lengths[fits][:-1]))
        for i, written in _BY_READ[read]:
            new = np.where(high, _table(written)[raw], raw)
            good = np.flatnonzero(np.minimum.reduceat(((~high) | seen[new]).astype(np.int8), at) > 0)
            if not len(good):
                continue
            keep = np.repeat(_member(good, len(fits)), lengths[fits])
            sub, begins = new[keep], np.cumsum(np.append(0, lengths[fits][good][:-1]))
            total = _sums(model.log_p(sub), sub, begins) - _mixed(sub, begins)
            out[fits[good], i] = total - own[fits[good]]
        # a lead byte before a continuation byte: without one, nothing can be UTF-8
        pairs = (raw[:-1] >= 0xC2) & (raw[:-1] < 0xF5) & (raw[1:] >= 0x80) & (raw[1:] < 0xC0)
        utf = np.add.reduceat(np.append(pairs, False).astype(np.int64), at) * 4 >= n_beyond[fits]
        dense = (n_beyond[fits] >= 2) & (n_beyond[fits] * 3 >= lengths[fits] - 3)
        for i in fits[utf]:
            first = _read_as_utf8(words[i], read)
            if first is not None and first != words[i]:
                decoded.append(first)
                where.append((i, _PLACE[read, "utf_8"]))
                if not first.isascii() and REPLACEMENT not in first:
                    for again, j in _TWICE.get(read, ()):
                        second = _read_as_utf8(first, again, False)
                        if second is not None and second != first:
                            decoded.append(second)
                            where.append((i, j))
        for i in fits[dense]:
            for written in MULTIBYTE[1:]:
                fixed = apply_chain(words[i], (read, written))
                if fixed is not None and fixed != words[i]:
                    decoded.append(fixed)
                    where.append((i, _PLACE[read, written]))
    if decoded:
        rows, columns = np.array(where).T
        fresh, begins = _codes(decoded)
        out[rows, columns] = _sums(model.log_p(fresh), fresh, begins) - _mixed(fresh, begins) - own[rows]
    return out


def _member(positions: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[positions] = True
    return out


_BY_READ = {r: [(i, w) for i, (r2, w) in enumerate(SINGLES) if r2 == r] for r in READ_AS}
_PLACE = {c: len(SINGLES) + j for j, c in enumerate(MULTIS)}
_UTF8 = np.array([j for c, j in _PLACE.items() if c[1] == "utf_8"])
_TWICE = {r: [(c[2], j) for c, j in _PLACE.items() if len(c) == 4 and c[0] == r] for r in READ_AS}


def _read_as_utf8(word: str, read: str, lenient: bool = True) -> str | None:
    """A word's bytes as UTF-8; where some were lost on the way, as much of it as can be read."""
    raw = _encoded(word, read)
    if raw is None:
        return None
    try:
        return raw.decode("utf_8")
    except UnicodeDecodeError:
        if not lenient:
            return None
    text = raw.decode("utf_8", "replace")
    return None if 2 * text.count(REPLACEMENT) >= sum(ch > "\x7f" for ch in text) else text


#: Encodings whose readers drop control characters, so that bytes get lost.
LOSSY: tuple[tuple[str, ...], ...] = (
    *((r, "utf_8") for r in ("latin_1", "cp1252", "cp1251", "cp1250", "cp1253")),
    *((r2, "utf_8", r1, "utf_8") for r2 in ("latin_1", "cp1252") for r1 in ("latin_1", "cp1252")),
)
_LOST_CHAINS = [(*c, "with losses") for c in LOSSY]
CHAINS += _LOST_CHAINS
#: The chain of text whose bytes a strict reader replaced: nothing can be encoded back.
LOST = ("lost",)
CHAINS.append(LOST)
#: States of a search kept at once (a few bytes each), and steps between states computed at once.
_STATES, _STEPS = 1 << 20, 1 << 18
_END = (3, 1)


def _likeliest(model: Model, characters: np.ndarray, paths: list[tuple[tuple[int, int], ...]]) -> list[np.ndarray]:
    """For each path of sets the likeliest choice of a character from each set.

    A set is a place in ``characters`` and a size.  A Viterbi search whose states are the last two
    characters is exact under the trigram model; all paths of a portion take their steps together.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(paths)
    part: list[int] = []
    size = 0
    # longest first, so that the paths that still go on come first at every step
    for i in sorted(range(len(paths)), key=lambda i: -len(paths[i])):
        weight = len(paths[part[0] if part else i]) + sum(x[1] * y[1] for x, y in zip(paths[i], paths[i][1:]))
        if part and size + weight > _STATES:
            _search(model, characters, paths, part, out)
            part, size = [], 0
        part.append(i)
        size += weight
    if part:
        _search(model, characters, paths, part, out)
    return out


def _search(model: Model, characters: np.ndarray, paths: list[tuple[tuple[int, int], ...]], part: list[int], out: list[np.ndarray]) -> None:
    # two end marks, the second without a score: each path ends in one state
    length = np.array([len(paths[i]) + 2 for i in part])
    place, many = np.zeros((len(part), length[0]), np.int64), np.ones((len(part), length[0]), np.int64)
    for row, i in enumerate(part):
        place[row, : length[row]], many[row, : length[row]] = np.array([*paths[i], _END, _END]).T
    going = [int((length > t).sum()) for t in range(length[0])]
    one = np.ones(len(part), np.int64)
    a = b = np.full(len(part), 2, np.int64)
    score = np.zeros(len(part))
    back = []
    for t, n in enumerate(going):
        n_a, n_b, n_c = (many[:n, t - k] if t >= k else one[:n] for k in (2, 1, 0))
        # states lie by path, then second character, then first; the new ones in the same order
        path = np.repeat(np.arange(n), n_b * n_c)
        ends = np.cumsum(n_b * n_c)
        within = np.arange(len(path)) - (ends - n_b * n_c)[path]
        c = characters[place[path, t] + within // n_b[path]]
        origin = (np.cumsum(n_a * n_b) - n_a * n_b)[path] + within % n_b[path] * n_a[path]
        fan = n_a[path]
        middle, scored = b[origin], t < length[path] - 1
        parent, best = np.zeros(len(path), np.int64), np.zeros(len(path))
        steps = np.cumsum(fan)
        lo = 0
        while lo < len(path):
            hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + _STEPS, "right")))
            f = fan[lo:hi]
            begins = np.cumsum(f) - f
            at = np.repeat(origin[lo:hi] - begins, f) + np.arange(int(f.sum()))
            to = np.repeat(np.arange(lo, hi), f)
            v = score[at] + np.where(scored[to], model.log_next(a[at], middle[to], c[to]), 0.0)
            best[lo:hi] = np.maximum.reduceat(v, begins)
            parent[lo:hi] = np.minimum.reduceat(np.where(v >= best[to], at, len(score)), begins)
            lo = hi
        a, b, score = middle, c, best
        back.append((parent.astype(np.int32), c.astype(np.uint16), ends))
    chosen = np.zeros((len(part), length[0]), np.int64)
    at = np.zeros(0, np.int64)
    for t in range(len(back) - 1, -1, -1):
        parent, c, ends = back[t]
        at = np.append(at, ends[len(at) :] - 1)
        chosen[: len(at), t] = c[at]
        at = parent[at]
    for row, i in enumerate(part):
        out[i] = chosen[row, : length[row] - 2]


class _Losses:
    """For each encoding, what may be left of each known character when its UTF-8 bytes are read in it and controls are dropped."""

    def __init__(self, model: Model):
        self.model = model
        #: For each encoding, what is left -> the set of all characters that it may be left of.
        self.options: list[dict[str, tuple[int, int]]] = []
        #: The parts of a set within each alphabet.
        self.within: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        known = [int(c) for c in np.flatnonzero(model.uni > 0) if c >= 128 and not 0xD800 <= c < 0xE000]
        known.sort(key=lambda c: -model.uni[c])
        # the first characters stand for themselves
        flat = list(range(UNI))
        sets: dict[tuple[int, ...], tuple[int, int]] = {}

        def kept(some: tuple[int, ...]) -> tuple[int, int]:
            if some not in sets:
                sets[some] = (len(flat), len(some))
                flat.extend(some)
            return sets[some]

        for read in LOSSY:
            table: dict[str, list[int]] = {}
            for c in known:
                whole = garble(chr(c), read)
                left = "".join(ch for ch in whole if not 0x80 <= ord(ch) < 0xA0)
                # what is left unchanged of a character tells nothing
                if left and left != chr(c):
                    table.setdefault(left, []).append(c)
            self.options.append({left: kept(tuple(some)) for left, some in table.items()})
            for some in table.values():
                self.within[kept(tuple(some))] = {s: kept(tuple(c for c in some if _scripts()[c] & 7 in (0, s))) for s in (1, 2, 4)}
        self.characters = np.array(flat, np.int64)
        self.firsts = [{k[0] for k in t} for t in self.options]
        self.longest = [max(map(len, t), default=0) for t in self.options]

    def sets(self, word: str, i: int) -> tuple[list[str], tuple[tuple[int, int], ...]] | None:
        """The word's pieces, each with the set of its originals; None where the word can't have come about so.

        The longest remainder counts, as no character begins with what others go on with.
        """
        table, firsts = self.options[i], self.firsts[i]
        if firsts.isdisjoint(word):
            return None
        pieces, out, at, lost = [], [], 0, False
        while at < len(word):
            size = 1
            found: tuple[int, int] | None = (min(ord(word[at]), UNI - 1), 1)
            if word[at] in firsts:
                for size in range(min(self.longest[i], len(word) - at), 0, -1):
                    found = table.get(word[at : at + size])
                    if found:
                        lost = True
                        break
                else:
                    return None
            pieces.append(word[at : at + size])
            out.append(found)
            at += size
        return (pieces, tuple(out)) if lost else None

    def _one_alphabet(self, path: tuple[tuple[int, int], ...], script: int) -> tuple[tuple[int, int], ...] | None:
        out = []
        for s in path:
            if s[0] >= UNI:
                s = self.within[s][script]
            elif _scripts()[s[0]] & 7 not in (0, script):
                return None
            if not s[1]:
                return None
            out.append(s)
        return tuple(out)

    def originals(self, tasks: list[tuple[str, int]]) -> list[tuple[str, float] | None]:
        """For each word and encoding the likeliest original of all, and its log probability less that of mixed alphabets."""
        split = [self.sets(word, i) for word, i in tasks]
        paths = list(dict.fromkeys(s[1] for s in split if s is not None))
        best: dict[tuple[tuple[int, int], ...], tuple[np.ndarray, float]] = {}
        for path, chosen, score, mixed in self._judged(paths, paths):
            best[path] = (chosen, score)
            if mixed:
                # the likeliest in one alphabet may be better than the likeliest of all
                some = [p for s in (1, 2, 4) if (p := self._one_alphabet(path, s)) is not None]
                for _, other, score, _ in self._judged([path] * len(some), some):
                    if score > best[path][1]:
                        best[path] = (other, score)
        out: list[tuple[str, float] | None] = []
        for s in split:
            if s is None:
                out.append(None)
                continue
            chosen, score = best[s[1]]
            out.append(("".join([chr(c) if o[0] >= UNI else piece for piece, o, c in zip(s[0], s[1], chosen.tolist(), strict=True)]), score))
        return out

    def _judged(self, names: list, paths: list) -> list[tuple]:
        if not paths:
            return []
        found = _likeliest(self.model, self.characters, paths)
        codes, starts = _codes(["".join(map(chr, x.tolist())) for x in found])
        mixed = _mixed(codes, starts)
        scores = _sums(self.model.log_p(codes), codes, starts) - mixed
        return list(zip(names, found, scores.tolist(), (mixed > 0).tolist(), strict=True))


def _with_losses(model: Model, losses: _Losses, words: list[str], out: np.ndarray) -> None:
    """Fills the columns of the chains with losses."""
    first = len(CHAINS) - 1 - len(_LOST_CHAINS)
    replaced = [i for i, word in enumerate(words) if REPLACEMENT in word]
    if replaced:
        codes, starts = _codes([words[i] for i in replaced])
        sign = codes == ord(REPLACEMENT)
        usual = np.log((model.uni[codes[2:]] + 0.02) / (model.uni.sum() + 0.02 * UNI))
        # any character may have been there, and what it was tells nothing of those after it
        free = np.where(sign[2:], 0.0, np.where(sign[1:-1] | sign[:-2], usual, model.log_p(codes)))
        out[replaced, -1] = _sums(free, codes, starts) - _sums(model.log_p(codes), codes, starts)
    where = [(i, k) for i, word in enumerate(words) if not word.isascii() for k in range(len(LOSSY)) if not losses.firsts[k].isdisjoint(word)]
    if not where:
        return
    codes, starts = _codes(words)
    own = _sums(model.log_p(codes), codes, starts) - _mixed(codes, starts)
    for (i, k), found in zip(where, losses.originals([(words[i], k) for i, k in where]), strict=True):
        if found is not None:
            out[i, first + k] = max(out[i, first + k], found[1] - own[i])


class Scorer:
    """Gains of words, kept for words seen before."""

    def __init__(self, model: Model, prior: np.ndarray | None = None):
        self.model, self.losses = model, _Losses(model)
        self.prior = prior if prior is not None else np.zeros(len(CHAINS), np.float32)
        self.known: dict[str, tuple[float, np.ndarray]] = {}
        #: Of these the words that some chain makes likelier, and those that reading as UTF-8 does.
        self.suspect: set[str] = set()
        self.utf8: set[str] = set()

    def prepare(self, words: Iterable[str]) -> None:
        """Scores the words that aren't known; at most _CACHE words are kept, or those just asked for."""
        wanted = set(words)
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > _CACHE:
            self.known, self.suspect, self.utf8 = {}, set(), set()
            new = list(wanted)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            table = gains(self.model, part)
            _with_losses(self.model, self.losses, part, table)
            for word, best, row in zip(part, table.max(axis=1).tolist(), table, strict=True):
                self.known[word] = (best, row)
                if best > 0:
                    self.suspect.add(word)
                    if row[_UTF8].max() > 0:
                        self.utf8.add(word)

    def over_lines(self, documents: list[list[list[str]]], judge: Callable[[list[str]], object], evidence: np.ndarray | None = None) -> list[list]:
        """``judge`` of each line of each document, in portions of lines whose words fit into memory, however long a document is.

        ``evidence``, a row a document and a column a chain, gets the gains of the lines that the chain makes likelier.
        """
        out: list[list] = [[] for _ in documents]
        portion: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            self.prepare(w for _, words in portion for w in words)
            for i, words in portion:
                out[i].append(judge(words))
                if evidence is not None and not self.suspect.isdisjoint(words):
                    evidence[i] += np.maximum(self.total(words), 0.0)

        for i, lines in enumerate(documents):
            for words in lines:
                portion.append((i, words))
                size += len(words)
                if size >= _PORTION:
                    settle()
                    portion, size = [], 0
        settle()
        return out

    def total(self, words: list[str]) -> np.ndarray:
        """Each chain's gains summed along a line."""
        return np.sum([self.known[w][1] for w in words], axis=0)

    def line(self, words: list[str]) -> tuple[float, int]:
        """The best chain's summed gain along a line, with its prior, and the chain."""
        if self.suspect.isdisjoint(words):
            return -1.0, -1
        total = self.prior + self.total(words)
        best = int(total.argmax())
        return float(total[best]), best


#: Gain of a line, or of a record's lines along one chain, under the first model from which on the record isn't clean.
CLEAN_CUT = 12.0
#: Records kept out of the trial model to choose the margin: one in so many, by a hash of the text.
HELD_OUT = 25
#: Chains that held-out lines are garbled along: the commonest, and for each line so many of them.
COMMON, TRIALS = 24, 2
_BINS = np.arange(-12.0, 80.25, 0.25)
_SCORERS: dict[int, tuple[object, Scorer]] = {}


def _scorer(shared) -> Scorer:
    """The worker's scorer for a broadcast (model, prior); one at a time is kept."""
    value = shared.value
    if id(value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(value)] = (value, Scorer(*value))  # the value is kept, so that no other can get its id
    return _SCORERS[id(value)][1]


def _counted(counts: dict[tuple[int, str], int]) -> pa.RecordBatch:
    columns = [pa.array([k for k, _ in counts], pa.int32()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "word", "n"])


#: What ``_count`` counts: words of clean records, of clean held-out records, these records' lines, garbled lines by chain, all lines.
_TRAIN, _HELD, _LINE, _CHAIN, _ALL = range(5)


def _count(texts: DataFrame, shared=None) -> DataFrame:
    """``kind, word, n``; without a model only words, of all records without a replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared) if shared is not None else None
        counts: dict[tuple[int, str], int] = {}

        def add(kind: int, key: str) -> None:
            counts[kind, key] = counts.get((kind, key), 0) + 1

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and not t.isascii()]
            documents = [words_beyond_ascii(t) for t in texts]
            evidence = np.zeros((len(documents), len(CHAINS)), np.float32)
            scores = scorer.over_lines(documents, scorer.line, evidence) if scorer is not None else [[]] * len(documents)
            for text, lines, judged, most in zip(texts, documents, scores, evidence.max(axis=1).tolist(), strict=True):
                for gain, chain in judged:
                    if gain > CLEAN_CUT:
                        add(_CHAIN, str(chain))
                if most <= CLEAN_CUT and REPLACEMENT not in text and (scorer is None or scorer.utf8.isdisjoint(w for words in lines for w in words)):
                    held = scorer is not None and zlib.crc32(text.encode("utf-8", "surrogatepass")) % HELD_OUT == 0
                    for words in lines:
                        for w in words:
                            add(_HELD if held else _TRAIN, w)
                        if held:
                            add(_LINE, " ".join(words))
                if scorer is not None:
                    counts[_ALL, ""] = counts.get((_ALL, ""), 0) + len(lines)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return texts.mapInArrow(run, "kind int, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _train(words: DataFrame) -> Model:
    """The model of a table ``word, n``: hashed n-grams are counted where the words lie; only fixed tables move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(UNI + BI + TRI)
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                names = part.column(0).to_pylist()
                if not names:
                    continue
                codes, starts = _codes(names)
                weight = np.repeat(part.column(1).to_numpy(), np.diff(np.append(starts, len(codes)))).astype(float)
                _, bc, abc = _grams(codes)
                real = codes[2:] != 2
                np.add.at(table, codes, weight)
                np.add.at(table, UNI + bc[real], weight[2:][real])
                np.add.at(table, UNI + BI + abc[real], weight[2:][real])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["at", "v"])

    got = words.select("word", "n").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    table = np.zeros(UNI + BI + TRI, np.float32)
    table[got["at"].to_numpy(np.int64)] = got["v"].to_numpy()
    return Model(table[:UNI], table[UNI : UNI + BI], table[UNI + BI :])


def _margin(lines: DataFrame, shared, garbled_share: float) -> tuple[float, float, float]:
    """``_least_errors`` on held-out lines, as they are and garbled along the commonest chains."""
    prior = shared.value[1]
    common = [int(i) for i in np.argsort(-prior) if len(CHAINS[int(i)]) % 2 == 0][:COMMON]
    odds = np.exp(prior[common])
    odds = np.cumsum(odds / odds.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        table = np.zeros((2, len(_BINS) + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                made: list[tuple[int, list[str], float]] = []
                for line, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    made.append((0, line.split(" "), n))
                    for k in range(TRIALS):
                        # a number in [0, 1) by a hash: the same line meets the same chains wherever it is judged
                        at = zlib.crc32(f"{k} {line}".encode("utf-8", "surrogatepass")) / 2**32
                        bad = garble(line, CHAINS[common[int(np.searchsorted(odds, at, "right"))]])
                        if bad is not None and bad != line:
                            made.append((1, [w for w in bad.split(" ") if not w.isascii()], n / TRIALS))
                scorer.prepare(w for _, words, _ in made for w in words)
                for row, words, n in made:
                    table[row, int(np.searchsorted(_BINS, scorer.line(words)[0]))] += n
        at = [(r, c) for r in range(2) for c in range(len(_BINS) + 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in at], pa.int32()), pa.array([c for _, c in at], pa.int32()), pa.array([table[x] for x in at])], names=["r", "c", "v"]
        )

    table = np.zeros((2, len(_BINS) + 1))
    for x in lines.select("word", "n").mapInArrow(run, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).collect():
        table[x.r, x.c] = x.v
    return _least_errors(table, garbled_share)


def _least_errors(table: np.ndarray, garbled_share: float) -> tuple[float, float, float]:
    """The margin, and the shares of clean and garbled lines that are judged wrongly with it; Model.margin without lines of both kinds.

    Of margins with equally few errors it is the one nearest to the log odds against a garbled line.
    """
    if not table.sum(axis=1).all():
        return Model.margin, 0.0, 0.0
    table = table / table.sum(axis=1, keepdims=True)
    # bin i holds scores up to _BINS[i]: with margin _BINS[i] the clean lines above it and the garbled ones up to it are judged wrongly
    clean, garbled = 1 - table[0].cumsum()[:-1], table[1].cumsum()[:-1]
    wrong = (1 - garbled_share) * clean + garbled_share * garbled
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = int(min(least, key=lambda i: abs(_BINS[i] - np.log((1 - garbled_share) / garbled_share))))
    return float(_BINS[i]), float(clean[i]), float(garbled[i])


def train(documents: DataFrame, text: str) -> tuple[Model, np.ndarray]:
    """The model of the table's clean records, with its margin, and the chains' log shares among garbled lines.

    Two passes over all texts count words: of all records, for the first model, and of those that
    are clean under it.  One in HELD_OUT of the clean records is held out
    once, to choose the margin on their lines.  What the driver gets are n-gram tables of fixed size.
    """
    sc = documents.sparkSession.sparkContext
    texts = documents.select(F.col(text)).where(F.col(text).isNotNull())
    first = sc.broadcast((_train(_count(texts)), np.zeros(len(CHAINS), np.float32)))
    counted = cut_lineage(_count(texts, first))
    shares, n_lines = np.zeros(len(CHAINS)), 0
    for r in counted.where(F.col("kind") >= _CHAIN).collect():  # a row a chain
        if r.kind == _CHAIN:
            shares[int(r.word)] = r.n
        else:
            n_lines = r.n
    prior = np.log((shares + 0.2) / (shares.sum() + 0.2 * len(shares))).astype(np.float32)
    of = counted.where(F.col("kind") <= _HELD)
    trial = sc.broadcast((_train(of.where(F.col("kind") == _TRAIN)), prior))
    model = _train(of.groupBy("word").agg(F.sum("n").alias("n")))
    model.margin, model.clean_errors, model.garbled_errors = _margin(counted.where(F.col("kind") == _LINE), trial, min(0.5, max(1e-4, shares.sum() / max(n_lines, 1))))
    return model, prior


def _restore_word(scorer: Scorer, word: str, chain: tuple[str, ...]) -> tuple[str, bool]:
    if chain == LOST:
        return word, REPLACEMENT not in word
    if chain[-1] == "with losses":
        found = scorer.losses.originals([(word, _LOST_CHAINS.index(chain))])[0]
        if found is None:
            return word, True
        codes, starts = _codes([word])
        own = scorer.model.scores([word])[0] - _mixed(codes, starts)[0]
        return (found[0], False) if found[1] > own else (word, True)
    fixed = apply_chain(word, chain)
    if fixed is not None:
        return fixed, True
    fixed = apply_chain(word, chain, "replace") if len(chain) == 2 else None
    return (fixed if fixed is not None and fixed.count(REPLACEMENT) < len(fixed) / 2 else word), False


def _judge(scorer: Scorer, text: str, lines: list[list[str]], scores: list[tuple[float, int]], restore: bool):
    """None for a clean text, else (lines found, chain of most of them, highest score, restored text, whether all of it could be)."""
    margin = scorer.model.margin
    found: dict[int, int] = {}
    high = -1.0
    for score, chain in scores:
        if score > margin:
            found[chain] = found.get(chain, 0) + 1
            high = max(high, score)
    if not found:
        return None
    main = max(found, key=lambda c: (found[c], -c))
    name = ">".join(CHAINS[main])
    if not restore:
        return sum(found.values()), name, high, None, False
    whole, out, at = REPLACEMENT not in text, [], 0
    most = 2 * found.get(main, 0) >= len(lines)
    for line in text.split("\n"):
        if line.isascii():
            out.append(line)
            continue
        words, (score, chain) = lines[at], scores[at]
        at += 1
        if score <= margin:
            # in a text that is garbled for the most part, a line that doesn't speak against it follows
            if not most:
                out.append(line)
                continue
            scorer.prepare(words)
            if sum(float(scorer.known[w][1][main]) for w in words) <= -2.0:
                out.append(line)
                continue
            chain = main
        for w in sorted(set(words), key=len, reverse=True):
            fixed, sure = _restore_word(scorer, w, CHAINS[chain])
            whole &= sure
            line = line.replace(w, fixed)
        out.append(line)
    return sum(found.values()), name, high, "\n".join(out), whole


def find_garbled(documents: DataFrame, doc_id: str, text: str, restore: bool = True, trained: tuple[Model, np.ndarray] | None = None) -> DataFrame:
    """The records with garbled passages: ``<doc_id>, n_lines, chain, score, restored, whole``.

    chain is the encode-decode chain of most of the garbled lines (``lost`` where a reader put
    replacement characters for the bytes); restored is the text with its garbled lines put right as
    far as that is possible (null without ``restore``), whole tells whether everything was.  Null,
    empty and pure ASCII texts have no garbled passage.  Texts are read whole; repeated rows are
    judged one by one; a table of few records gives a model of few words, and finds less.
    """
    model, prior = trained or train(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast((model, prior))  # 6 MB, whatever the corpus
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split = [words_beyond_ascii(t) for t in texts]
            scores = scorer.over_lines(split, scorer.line)
            rows = [(i, r) for i, (t, lines) in enumerate(zip(texts, split, strict=True)) if lines and (r := _judge(scorer, t, lines, scores[i], restore)) is not None]
            ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[0] for _, r in rows], pa.int32()), pa.array([r[1] for _, r in rows], pa.string()), pa.array([r[2] for _, r in rows], pa.float64()),
                 pa.array([r[3] for _, r in rows], pa.string()), pa.array([r[4] for _, r in rows], pa.bool_())],
                names=[doc_id, "n_lines", "chain", "score", "restored", "whole"],
            )

    schema = f"`{doc_id}` {kind}, n_lines int, chain string, score double, restored string, whole boolean"
    return documents.select(doc_id, text).mapInArrow(run, schema)
