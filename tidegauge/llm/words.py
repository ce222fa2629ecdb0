"""Word streams of texts as arrays of hashes, with common disguises undone first.

Texts stay in Arrow buffers: letters are found, cut into words (also at camel case) and hashed by array
operations. Only texts that hold a disguise are touched one by one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import numpy as np

from tidegauge.llm.tokens import chunks

#: Look-alike letters of other scripts and the Latin letter they stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ß": "s", "æ": "a", "ø": "o", "ł": "l", "đ": "d",
}
#: Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
_ESCAPE = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4,6})\}?|x([2-7][0-9a-fA-F]))")
_PERCENT = re.compile(r"(?:%[2-7c-fC-F][0-9a-fA-F])+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ ._-][^\W\d_]){3,}(?![^\W_])")
_MASKED = re.compile(r"(?<![A-Za-z*])[A-Za-z]+(?:[*#][A-Za-z*#]*)?[*#][A-Za-z*#]*(?<=[A-Za-z])(?![A-Za-z*])")
#: Bytes hashed at once.
STRETCH = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


class _Fold(dict):
    """Translation of one character: marks off, look-alikes to Latin, other signs to a blank; filled as met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 128:
            out = c
        else:
            low = unicodedata.normalize("NFKD", c).lower()
            low = "".join(LOOK_ALIKES.get(x, x) for x in low if not unicodedata.combining(x))
            out = "".join(x if x.isalnum() or x.isascii() else " " for x in low) if low else ""
            if "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff":
                out = f" {out} "  # these scripts have no blanks: each sign is a word
        self[code] = out
        return out


_FOLD = _Fold()


def _code_point(m: re.Match) -> str:
    n = int(m.group(1) or m.group(2), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "


class Vocabulary:
    """Known words, used to undo spaced letters and masked letters."""

    def __init__(self, ranked: list[str]) -> None:
        """``ranked``: words, the likeliest reading of a mask first."""
        self.ranked = tuple(dict.fromkeys(ranked))
        self.rank = {w: i for i, w in enumerate(self.ranked)}
        self.longest = max(map(len, ranked), default=1)
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for w in self.ranked:
            self.by_shape.setdefault((len(w), w[0]), []).append(w)
        self.cut = lru_cache(65536)(self._cut)
        self.unmask = lru_cache(65536)(self._unmask)
        self.full = self.thin = self.meant = np.zeros(0, np.uint64)
        raw = [w.encode() for w in self.ranked]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        words, counts, thin = _hashed(data, ends, False)[:3]
        if len(words):
            whole = np.repeat(counts == 1, counts)
            self.full, (self.thin, at) = np.unique(words[whole]), np.unique(thin[whole], return_index=True)
            self.meant = words[whole][at]

    def respelled(self, words: np.ndarray, thin: np.ndarray) -> np.ndarray:
        """Hashes of words, an unknown one read as the likeliest known word that differs in doubled letters only."""
        if not len(self.full) or not len(words):
            return words
        there = np.minimum(np.searchsorted(self.full, words), len(self.full) - 1)
        at = np.minimum(np.searchsorted(self.thin, thin), len(self.thin) - 1)
        return np.where((self.full[there] != words) & (self.thin[at] == thin), self.meant[at], words)

    def _cut(self, letters: str) -> str:
        """Letters without gaps, cut into as few and as long known words as possible."""
        best: list[tuple[int, int]] = [(0, 0)]
        for i in range(1, len(letters) + 1):
            options = [(best[i - 1][0] + 3, i - 1)]
            for j in range(max(0, i - self.longest), i):
                if letters[j:i] in self.rank:
                    options.append((best[j][0] + 1 + (i - j == 1), j))
            best.append(min(options))
        out, i = [], len(letters)
        while i:
            j = best[i][1]
            out.append(letters[j:i])
            i = j
        return " ".join(reversed(out))

    def _unmask(self, masked: str) -> str:
        """The likeliest known word of the same length that agrees in the letters shown; else the mask itself."""
        low = masked.lower()
        for w in self.by_shape.get((len(low), low[0]), ()):
            if all(a in ("*", "#", b) for a, b in zip(low, w, strict=True)):
                return w
        return masked


def undisguised(text: str, words: Vocabulary, spaced: bool, masked: bool) -> str:
    """The text with entities, escapes, invisible characters, look-alikes, spaced and masked letters undone."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "\\" in text:
        text = _ESCAPE.sub(_code_point, text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(), errors="replace"), text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text).translate(_FOLD)
    if spaced:
        text = _SPACED.sub(lambda m: words.cut(re.sub(r"[ ._-]", "", m.group()).lower()), text)
    if masked:
        text = _MASKED.sub(lambda m: words.unmask(m.group()), text)
    return text


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = True
    letter[128:] = True
    leet = lower.copy()
    for k, v in LEET.items():
        leet[ord(k)] = ord(v)
    return lower, letter, leet


_LOWER, _LETTER, _LEET_MAP = _tables()
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(k) for k in LEET if not k.isdigit()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shrunk(b: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without all but one letter of runs of three and more."""
    same = np.zeros(len(b) + 3, bool)
    same[1 : len(b)] = (b[1:] == b[:-1]) & _LETTER[b[1:]]
    same[ends[:-1]] = False  # texts don't touch
    triple = same[:-1] & same[1:]  # at i: the bytes i-1, i, i+1 are equal
    if not triple.any():
        return b, raw, ends
    n = len(b)
    drop = same[:n] & (triple[:n] | np.concatenate([[False], triple[: n - 1]]) | triple[1 : n + 1])
    keep = ~drop
    return b[keep], raw[keep], ends - np.searchsorted(np.flatnonzero(drop), ends)


def lettered(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signs that stand for letters: those before a letter, and all but ``!`` after one, with up to three more signs or digits between."""
    n = len(raw)
    sign = _SIGN[raw]
    if not sign.any():
        return sign
    letter, between = _LETTER[_LOWER[raw]], sign | _DIGIT[raw]
    first, last = np.ones(n + 1, bool), np.ones(n + 1, bool)
    first[:n], last[:n] = False, False
    first[ends[:-1]], last[ends[1:] - 1] = True, True  # texts don't touch
    first, last = first[:n], last[:n]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    for _ in range(4):
        before[:-1] = letter[1:] | (between[1:] & before[1:])
        before[last] = False
        after[1:] = letter[:-1] | (between[:-1] & after[:-1])
        after[first] = False
    return sign & (before | (after & (raw != ord("!"))))


def hash_words(raw: np.ndarray, ends: np.ndarray, leet: bool = False, spell: bool = False, known: Vocabulary | None = None) -> tuple:
    """Hashes of the words of a chunk and the number of words per text; with ``spell`` also the words themselves.

    Words are runs of letters (bytes of non-ASCII characters count as letters), cut before a capital that
    follows a small letter; lone letters but ``i`` and ``u``, and short
    runs that touch a digit, are left out. With ``leet`` digits, and signs within or at words, stand for letters,
    otherwise they separate words. With ``known`` doubled letters are undone in unknown words, and missing ones added.
    """
    words, counts, thin, b, letter, begins, stops = _hashed(raw, ends, leet)
    if known is not None:
        words = known.respelled(words, thin)
    if spell:
        return words, counts, [b[i:k][letter[i:k]].tobytes().decode("utf-8", "replace") for i, k in zip(begins, stops, strict=True)]
    return words, counts


def _hashed(raw: np.ndarray, ends: np.ndarray, leet: bool) -> tuple:
    """Hashes of words, their number per text, hashes without doubled letters, letters read and places of the words."""
    b = (_LEET_MAP if leet else _LOWER)[raw]
    if leet:
        b = np.where(_SIGN[raw] & ~lettered(raw, ends), raw, b)
    b, raw, ends = _shrunk(b, raw, ends)
    n = len(b)
    none = np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64), np.zeros(0, np.uint64), b, _LETTER[b], np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n == 0:
        return none
    letter = _LETTER[b]
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    camel = np.zeros(n, bool)
    camel[1:] = _UPPER[raw[1:]] & letter[:-1] & ~_UPPER[raw[:-1]] & ~_DIGIT[raw[:-1]] & ~_SIGN[raw[:-1]]
    first = np.zeros(n + 1, bool)
    first[ends] = True  # texts don't touch: here and below nothing looks across
    begins = np.flatnonzero(letter & (~before | camel | first[:n]))
    if len(begins) == 0:
        return none
    # words end where their letters do, or where the next one begins
    run_ends = np.flatnonzero(letter & np.append(~letter[1:], True)) + 1
    stops = np.minimum(run_ends[np.searchsorted(run_ends, begins, "right")], np.append(begins[1:], n))
    # lone letters are variables or digits in base 16; only those that are words on their own stay
    size_of = stops - begins
    kept = (size_of > 1) | (b[begins] == ord("i")) | (b[begins] == ord("u"))
    if not leet:  # short letter runs that touch a digit are parts of numbers or names
        digit = np.append(_DIGIT[b], False)
        kept &= (size_of > 3) | ~((digit[begins - 1] & ~first[begins]) | (digit[stops] & ~first[stops]))
    begins, stops = begins[kept], stops[kept]
    words, thin = np.empty(len(begins), np.uint64), np.empty(len(begins), np.uint64)
    single = np.append(True, b[1:] != b[:-1])
    single[begins] = True
    place = np.cumsum(single) - 1
    i = 0
    while i < len(begins):  # in stretches, so that the powers and sums stay small in the longest text
        lo = begins[i]
        j = max(i + 1, int(np.searchsorted(begins, lo + STRETCH)))
        hi = stops[j - 1]
        p, q = _powers(1 << max(20, int(hi - lo).bit_length()))
        value, own = np.where(letter[lo:hi], b[lo:hi], 0).astype(np.uint64), place[lo : hi + 1] - place[lo]
        for out, at, weight in ((words, np.arange(hi - lo), value), (thin, own[: hi - lo], np.where(single[lo:hi], value, 0))):
            total = np.concatenate([[np.uint64(0)], np.cumsum(weight * p[at])])
            out[i:j] = mixed((total[stops[i:j] - lo] - total[begins[i:j] - lo]) * q[at[begins[i:j] - lo]])
        i = j
    return words, np.diff(np.searchsorted(begins, ends)), thin, b, letter, begins, stops


def suspicious(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that may hold spaced letters, and texts that may hold masked letters."""
    n = len(raw)
    letter = _LETTER[_LOWER[raw]]
    gap = (raw == 32) | (raw == ord(".")) | (raw == ord("_")) | (raw == ord("-"))
    spaced = np.zeros(n, bool)
    if n > 8:
        one = letter[:-2] & gap[1:-1] & letter[2:]  # at i: letter, gap, letter
        spaced[: n - 6] = one[: n - 6] & one[2 : n - 4] & one[4 : n - 2]
    star = (raw == ord("*")) | (raw == ord("#"))
    masked = np.zeros(n, bool)
    if n > 4:
        after = letter.copy()
        for _ in range(3):
            after[:-1] |= star[:-1] & after[1:]
        masked[1:-1] = star[1:-1] & letter[:-2] & after[2:]
    return _any(spaced, ends), _any(masked, ends)


def _any(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), ends)) > 0


def leet_lines(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines in which digits (or signs, see ``lettered``) stand among letters (numbers in base 16 aside), as a chunk of its own."""
    b = _LOWER[raw]
    n = len(b)
    if n < 3:
        return raw[:0], np.zeros(len(ends), np.int64)
    letter, digit = _LETTER[b], _DIGIT[b]
    far = letter & ~((b >= ord("a")) & (b <= ord("f"))) & (b != ord("x"))  # letters that numbers in base 16 lack
    core = np.zeros(n, bool)
    core[1:-1] = digit[1:-1] & ((far[:-2] & letter[2:]) | (letter[:-2] & far[2:]) | (digit[:-2] & far[2:]) | (far[:-2] & digit[2:]))
    edges = ends[:-1][ends[:-1] < ends[1:]]
    core[edges] = False
    core[ends[1:][ends[1:] > ends[:-1]] - 1] = False
    hits = np.flatnonzero(core | lettered(raw, ends))
    if not len(hits):
        return raw[:0], np.zeros(len(ends), np.int64)
    starts = np.union1d(np.flatnonzero(b == 10), ends[:-1])  # a line begins with its line end, so that lines stay apart
    starts = starts[starts < n]
    line = np.unique(np.searchsorted(starts, hits, "right") - 1)
    lo, hi = starts[line], np.append(starts, n)[line + 1]
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    return np.concatenate([raw[i:k] for i, k in zip(lo, hi, strict=True)]), total[np.searchsorted(hi, ends, "right")]


def clean_chunks(data: np.ndarray, ends: np.ndarray, words: Vocabulary, size: int = 1 << 20):
    """Chunks ``(first, last, bytes, offsets)`` of the texts, disguises undone."""
    for i, j in chunks(data, ends, size):
        raw = data[ends[i] : ends[j]]
        own = ends[i : j + 1] - ends[i]
        spaced, masked = suspicious(raw, own) if len(raw) else (np.zeros(j - i, bool), np.zeros(j - i, bool))
        odd = _any((raw >= 128) | (raw == ord("&")) | (raw == ord("\\")) | (raw == ord("%")), own) | spaced | masked
        if odd.any():
            parts = []
            for k in range(j - i):
                part = raw[own[k] : own[k + 1]].tobytes()
                if odd[k]:
                    text = undisguised(part.decode("utf-8", "replace"), words, bool(spaced[k]), bool(masked[k]))
                    part = text.encode("utf-8", "replace")
                parts.append(part)
            raw = np.frombuffer(b"".join(parts), np.uint8)
            own = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        yield i, j, raw, own
