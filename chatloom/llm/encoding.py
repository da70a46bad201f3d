"""Text that was decoded with a wrong character encoding: finding and restoring it.

A swap of code pages is a substitution cipher: the symbols are single characters (one single-byte code page read as
another) or the characters that the two to four bytes of one UTF-8 letter were read as. Which cipher, if any, a value
went through is latent. Expectation-maximisation over all different values of each source learns, without labels,

* the languages: bigrams of letters by source, first from values in which no cipher has a symbol, then from restored ones;
* the weight of each cipher in each source (the language of the chat);
* the letters that damaged symbols stand for (a UTF-8 letter of which a byte was lost), from their neighbours;
* a mapping of characters to letters for what no known code page explains: the words left over that read oddly are
  taken, by source, for text under one unknown substitution, which is learnt from nothing but their bigrams.

The known code pages are where the search begins; the language decides. Tables, known and learnt, are applied with
``str.translate``, multi-character symbols after being packed into one character each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

__all__ = ["Ciphers", "Language", "learn_substitution", "learn", "restore", "repair"]

# Code pages that UTF-8 is commonly read as, and those that single-byte text is swapped between.
UTF8_READ_AS = ["cp1252", "cp437", "cp850", "cp852", "cp866", "cp1250", "cp1251", "cp1254", "iso8859_5", "iso8859_15", "koi8_r", "mac_roman", "mac_cyrillic"]
CYRILLIC_PAGES = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]
LATIN_PAGES = ["cp1252", "cp437", "cp850", "mac_roman"]

# The blocks whose characters a restored value may hold: Latin, Cyrillic, punctuation, currency, arrows,
# box drawing, symbols, dingbats, emoji. Add blocks here for other scripts.
ALPHABETS = [
    (0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DC), (0x400, 0x45F), (0x490, 0x491), (0x2010, 0x2044), (0x200B, 0x200F), (0x20A0, 0x20BF),
    (0x2116, 0x2122), (0x2190, 0x21FF), (0x2500, 0x27BF), (0x2B50, 0x2B55), (0xFE0F, 0xFE0F), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF),
]

#: Natural-log odds by which a restored value must beat the value as it stands.
MARGIN = 3.0
#: Natural-log odds per letter that a word must gain to tell a swap by one letter.
LETTER = 6.0
#: Mean log probability of a bigram below which a word is odd.
FINE = -4.2
#: Mean log probability of a bigram that words under a learnt table must reach.
READ = -3.6
_LOST = "�"
_FLOOR = 1e-7


def _image(page: str) -> dict[str, int]:
    """Character -> byte of a code page; bytes it leaves undefined are read as control characters."""
    out = {}
    for i in range(0x80, 0x100):
        try:
            out[bytes([i]).decode(page)] = i
        except UnicodeDecodeError:
            out[chr(i)] = i
    if page in ("cp1252", "cp1254", "iso8859_15", "cp1250", "cp1251"):  # control characters also appear as they are
        for i in range(0x80, 0xA0):
            out.setdefault(chr(i), i)
    if page in ("cp1252", "iso8859_15", "cp1254"):
        for i in (0xA0, 0xAD):
            out.setdefault(chr(i), i)
    return out


class Ciphers:
    """The family of swaps. Name -> a function from a value to its restored form (the same if nothing applies)."""

    def __init__(self) -> None:
        self.pages = {p: _image(p) for p in UTF8_READ_AS}
        self.symbols = {}
        self.packs = {}
        for p, img in self.pages.items():
            cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in img.items() if lo <= b <= hi) + "]"  # noqa: B023, E731
            cont = cls(0x80, 0xBF)
            # The first two bytes of the letters in ALPHABETS; text of one script rarely holds what another's look like.
            heads: dict[int, set[int]] = {}
            for lo, hi in ALPHABETS:
                for code in sorted({*range(lo, hi + 1, 64), hi}):
                    head = chr(code).encode()[:2]
                    heads.setdefault(head[0], set()).update([head[1]] if head[0] >= 0xE0 else range(0x80, 0xC0))
            parts = []
            for h, second in sorted(heads.items()):
                body = "[" + "".join(re.escape(c) for c, b in img.items() if b in second) + "]"
                parts.append(cls(h, h) + body + cont * (0 if h < 0xE0 else 1 if h < 0xF0 else 2))
            self.symbols[p] = re.compile("|".join(parts))
        self.swaps: dict[str, dict[int, str]] = {}
        read_as = [*dict.fromkeys([*CYRILLIC_PAGES, *LATIN_PAGES])]
        for group in (CYRILLIC_PAGES, LATIN_PAGES):
            for true in group:
                for read in read_as:
                    if true == read:
                        continue
                    table = {}
                    for c, b in _image(read).items():
                        try:
                            letter = bytes([b]).decode(true)
                        except UnicodeDecodeError:
                            continue
                        if letter != c:
                            table[ord(c)] = letter
                    self.swaps[f"{true}>{read}"] = table
        # What a known swap changes: to letters and other printable characters, not to box drawing.
        self.kept = {k: {c: y for c, y in t.items() if (y.isprintable() or y == "\xa0") and not "\u2500" <= y <= "\u25ff"} for k, t in self.swaps.items()}

    def _letter(self, page: str, symbol: str) -> str | None:
        try:
            letter = bytes(self.pages[page][c] for c in symbol).decode()
        except UnicodeDecodeError:
            return None
        return letter if any(lo <= ord(letter) <= hi for lo, hi in ALPHABETS) else None

    def any_symbol(self, value: str) -> bool:
        """Whether some cipher has a symbol in the value."""
        return any(r.search(value) and self.table(p, value)[2] for p, r in self.symbols.items())

    def table(self, page: str, value: str) -> tuple[str, dict[int, str], int]:
        """The value with its symbols packed into private characters, the table of their letters, the number of hits."""
        packed: dict[str, str] = {}
        table: dict[int, str] = {}
        hits = 0

        def pack(m: re.Match) -> str:
            nonlocal hits
            s = m[0]
            if s not in packed:
                letter = self._letter(page, s)
                packed[s] = s if letter is None else chr(0xF0000 + len(packed))
                if letter is not None:
                    table[ord(packed[s])] = letter
            hits += packed[s] is not s
            return packed[s]

        return self.symbols[page].sub(pack, value), table, hits

    def utf8(self, page: str, value: str) -> str:
        """One layer of UTF-8 read as *page* taken off."""
        packed, table, hits = self.table(page, value)
        return packed.translate(table) if hits else value

    def readings(self, value: str) -> dict[str, str]:
        """All restored forms of a value that differ from it; as many layers of UTF-8 as it has, each being shorter."""
        out = {}
        for p in UTF8_READ_AS:
            if self.symbols[p].search(value):
                layer, last = 1, value
                while (new := self.utf8(p, last)) != last:
                    out[f"utf8>{p}*{layer}"] = last = new
                    layer += 1
        return out

    def swapped(self, value: str) -> dict[str, str]:
        """Restored forms under single-byte swaps."""
        return {k: r for k, t in self.swaps.items() if (r := value.translate(t)) != value}


_DIGIT = re.compile(r"\d")
_OTHER = re.compile("[^\x00-\x7f" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in ALPHABETS) + "]")


def _fold(s: str) -> str:
    """Small letters, digits alike, and one character for all beyond ASCII and ALPHABETS, which bounds the bigrams."""
    s = _DIGIT.sub("0", s.lower())
    return s if s.isascii() else _OTHER.sub("\uffff", s)


class Language:
    """Smoothed bigrams of lower-case characters."""

    def __init__(self, pairs: dict[tuple[str, str], float]) -> None:
        self.pairs = pairs
        self.left: Counter = Counter()
        for (a, _), n in pairs.items():
            self.left[a] += n
        self.total = sum(self.left.values()) or 1.0
        self._memo: dict[tuple[str, str], float] = {}
        self._words: dict[str, float] = {}

    def log(self, a: str, b: str) -> float:
        key = (a, b)
        if (x := self._memo.get(key)) is None:
            one = max(self.left.get(b, 0.0) / self.total, _FLOOR)
            n = self.left.get(a, 0.0)
            x = math.log((self.pairs.get(key, 0.0) + 2.0 * one) / (n + 2.0) if n else one)
            if len(self._memo) < 500_000:
                self._memo[key] = x
        return x

    def score(self, s: str) -> float:
        """Log probability of a text: the sum over its words, whose scores are kept, as most words come again."""
        total, memo = 0.0, self._words
        for w in _fold(s).replace("\n", " ").split(" "):
            if (x := memo.get(w)) is None:
                x = self._word(w)
                if len(memo) < 300_000 and len(w) < 40:
                    memo[w] = x
            total += x
        return total

    def _word(self, w: str) -> float:
        log, w = self.log, f" {w} "
        return sum(log(a, b) for a, b in zip(w, w[1:]))

    @staticmethod
    def count(s: str, into: Counter, weight: float = 1.0) -> None:
        s = " " + _fold(s) + " "
        for pair in zip(s, s[1:]):
            into[pair] += weight


@lru_cache(1)
def _ciphers() -> Ciphers:
    return Ciphers()


# A UTF-8 letter with lost bytes, read as Windows-1252 or Latin-1: a lead after a small letter with a blank or nothing for
# its follower, the lead of an emoji with blanks for followers, or replacement characters behind a lead.
_DAMAGED = re.compile(
    "(?<=[a-zà-öø-ÿа-яё])[ÂÃÄÅÐÑ](?:[  ­]?(?=[a-zà-ÿ])|(?=\\s|$))"
    "|ð(?:[  �]{1,3}[\u0080-¿]?|[\u0080-¿])|[âï][  �]{0,2}(?=ï¸)|ï¸[  �]?|[Â-ô]?�+"
    # The lead of punctuation and symbols before what is left of the other two bytes: a sign that ends no word, two blanks,
    # or, where its pair with the letter before is foreign to all languages, nothing.
    "|â[ \u00a0\u00ad]?[¢-©¬®¯±-¶¸¹¼-¾]|â[ \u00a0]{2}|(?<=[a-zà-öø-ÿ])â(?=[a-zà-öø-ÿ])"
)
#: Share of a letter's followers below which a pair of letters is foreign.
FOREIGN = 1e-4
_CONTROLS = re.compile("[\u0080-\u009f]")
# Words with a character beyond ASCII (a swap may make no-break space of a letter); a capital behind a small letter or
# letters of two scripts side by side; the ends of sentences and lines.
_WORDS = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_ENDING = ".,:;!?\"'()«»“”…-"
_BROKEN = re.compile("[a-zß-öø-ÿа-џ][A-ZÀ-ÖØ-ÞЀ-Я]|[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
_ENDS = re.compile(r"[.!?…]\s|[\r\n]")


class Reader:
    """Readings of a value and their probabilities under a language and the weights of the ciphers of its source."""

    def __init__(self, language: Language, weights: dict, letters: dict, learnt: dict[str, dict[str, dict[int, str]]] | None = None) -> None:
        self.language, self.weights, self.letters = language, weights, letters
        self.learnt = learnt or {}  # source -> name -> character -> letter
        self.ciphers = _ciphers()
        self._swaps: dict[str, list[tuple[str, float, int]]] = {}

    def weight(self, source: str, cipher: str) -> float:
        w = self.weights.get(source) or {}
        return math.log(w.get(cipher, 1e-4) if cipher != "" else w.get("", 0.9))

    def best(self, value: str, source: str) -> tuple[str, str, float]:
        """Restored value, its cipher (empty: as it stands), its log odds against the value as it stands."""
        base = self.language.score(value) + self.weight(source, "")
        best, name, gain = value, "", 0.0
        for k, r in self.ciphers.readings(value).items():
            g = self.language.score(r) + self.weight(source, k) - base
            if g > gain and g > MARGIN:
                best, name, gain = r, k, g
        r, k, g = self._by_words(value, source)
        return (r, k, g) if g > gain else (best, name, gain)

    def _plain(self, word: str) -> float:
        """Score of a word; as the language knows small letters only, capitals and scripts out of place count here."""
        return self.language.score(word) - LETTER * len(_BROKEN.findall(word))

    def _swapped(self, word: str, source: str) -> dict[str, str]:
        """A word under the swaps of code pages and those learnt for its source."""
        more = self.learnt.get(source)
        out = self.ciphers.swapped(word)
        return out | {k: r for k, t in more.items() if (r := word.translate(t)) != word} if more else out

    def _evidence(self, word: str, source: str) -> list[tuple[str, float, int]]:
        """Swaps that change a word's letters to letters: name, gain, number of letters; gain 0: the word speaks against it.

        One letter tells a swap only within a word, if it gains much and leaves a word as of the language: no other
        script's letter, no capital behind a small one, no rare bigrams.
        """
        key = (source, word) if source in self.learnt else word
        if (out := self._swaps.get(key)) is None:
            out, score = [], self._plain(word)
            for k, r in self._swapped(word, source).items():
                changed = [y for x, y in zip(word, r) if x != y]
                alpha = all(y.isalpha() for y in changed)
                if len(changed) > 1:
                    if alpha and (g := self._plain(r) - score) > 0:
                        out.append((k, g, len(changed)))
                elif sum(x.isalpha() for x in r) > alpha:
                    new = self._plain(r)
                    tells = alpha and new - score > LETTER and new >= FINE * (len(r) + 1) and not _BROKEN.search(r)
                    out.append((k, new - score if tells else 0.0, 1))
            if len(self._swaps) < 100_000 and len(word) < 40:
                self._swaps[key] = out
        return out

    def _by_words(self, value: str, source: str) -> tuple[str, str, float]:
        """Single-byte swaps, word by word, as only a part of a value may be affected; one swap per value.

        Words of several changed letters tell the swap, and at least two of one such letter that are more than those
        that speak against it. With it every word is read that scores better so or stands among such words.
        """
        spans = [m.span() for m in _WORDS.finditer(value)]
        gains: dict[str, list[float]] = {}
        for s, e in spans:
            odd_word = self._plain(value[s:e]) < FINE * (e - s + 1)
            for k, g, n in self._evidence(value[s:e], source):
                if k.startswith("learnt") and not odd_word:  # a learnt table is told by words that are no words as they stand
                    continue
                x = gains.setdefault(k, [0.0] * 6)  # gain, length, words; of words of several letters, then of one
                i = 3 if n == 1 else 0
                if g > 0:
                    x[i], x[i + 1], x[i + 2] = x[i] + g, x[i + 1] + e - s, x[i + 2] + 1
                else:
                    x[5] -= 1
        odd = any(self._plain(value[s:e]) < FINE * (e - s + 1) for s, e in spans)
        usable = {}
        for k, (g, size, n, g1, size1, n1) in gains.items():
            if k.startswith("learnt") and (n < 2 or 2 * n < len(spans)):  # at least half of the words must be odd and tell it
                continue
            few = n1 <= 0 or n1 + n < 2
            g, size = (g if odd or not few else 0.0) + (0.0 if few else g1), size + (0.0 if few else size1)
            if g > 0 and g >= 0.8 * size:
                usable[k] = g
        if not usable:
            return value, "", 0.0
        k = max(usable, key=lambda x: usable[x] + self.weight(source, x))
        g = usable[k] + self.weight(source, k) - self.weight(source, "")
        if g <= MARGIN:
            return value, "", 0.0
        return self._affected(value, spans, self.ciphers.kept.get(k) or self.learnt[source][k]), k, g

    def _affected(self, value: str, spans: list[tuple[int, int]], table: dict[int, str]) -> str:
        """The value with its affected words read by a known swap: the likeliest row of affected and unaffected words.

        Going from one to the other costs MARGIN, a third of it at the end of a sentence or line, so that a word that
        tells little, as one of a single letter, goes with its neighbours.
        """
        read = [value[s:e].translate(table) for s, e in spans]
        best, back = (0.0, 0.0), []
        for i, (s, e) in enumerate(spans):
            turn = MARGIN / 3 if i and _ENDS.search(value[spans[i - 1][0] : s]) else MARGIN if i else 0.0
            back.append((best[1] - turn > best[0], best[1] >= best[0] - turn))
            gain = self._plain(read[i]) - self._plain(value[s:e])
            best = (max(best[0], best[1] - turn), max(best[1], best[0] - turn) + gain)
        out, at, affected = [], len(value), best[1] > best[0]
        for (s, e), r, b in zip(spans[::-1], read[::-1], back[::-1]):
            out += [value[e:at], r if affected else value[s:e]]
            at, affected = s, b[affected]
        return "".join([*out, value[:at]][::-1])

    def odd_words(self, value: str) -> list[str]:
        """Words of letters, some beyond ASCII, that no language reads well."""
        words = [w.strip(_ENDING) for w in _WORDS.findall(value)]
        return [w for w in words if len(w) > 1 and w.isalpha() and self._plain(w) < FINE * (len(w) + 1)]

    def unexplained(self, value: str, best: str) -> list[str]:
        """Odd words of a value whose best reading leaves two or more odd; none of one with lost bytes or controls."""
        if _LOST in value or _CONTROLS.search(value) or len(self.odd_words(best)) < 2:
            return []
        return self.odd_words(value)

    def _at_home(self, a: str, x: str) -> bool:
        """Whether some language has letter *x* behind *a*."""
        a = _fold(a)
        return self.language.pairs.get((a, x), 0.0) >= FOREIGN * self.language.left.get(a, 0.0)

    def lost(self, value: str) -> list[tuple[int, int, str, dict[str, float]]]:
        """Damaged symbols of a value: place, symbol, and the probabilities of their letters between their neighbours."""
        out = []
        for m in _DAMAGED.finditer(value):
            lead = m[0][0]
            if m[0] == "â" and m.start() and value[m.start() - 1].islower() and value[m.end() : m.end() + 1].islower() and self._at_home(value[m.start() - 1], "â"):
                continue
            span = range(0x40 * (ord(lead) & 0x1F), 0x40 * (ord(lead) & 0x1F) + 0x40) if "Â" <= lead <= "ß" else []
            letters = [chr(i) for i in span if chr(i).isalpha()]
            if not letters:
                out.append((*m.span(), m[0], {}))
                continue
            a = _fold(value[m.start() - 1]) if m.start() else " "
            b = _fold(value[m.end()]) if m.end() < len(value) else " "
            known = self.letters.get(m[0], {})
            p = {x: math.exp(self.language.log(a, _fold(x)) + self.language.log(_fold(x), b)) * (known.get(x, 0.0) + 0.01) for x in letters}
            total = sum(p.values()) or 1.0
            out.append((*m.span(), m[0], {x: v / total for x, v in p.items()}))
        return out

    def repair(self, value: str, source: str) -> tuple[str, str]:
        """Restored value and the ciphers, the last one first; empty: unaffected. What can't be restored becomes U+FFFD.

        A value that went through several ciphers is read again until it stays as it is; every reading gains MARGIN.
        """
        best, name, _ = self.best(value, source)
        more, known = name, {value}
        while more and best not in known:
            known.add(best)
            again, more, _ = self.best(best, source)
            if more:
                best, name = again, f"{more}+{name}"
        out, at, damaged = [], 0, False
        for s, e, symbol, p in self.lost(best):
            letter = max(p, key=p.get) if p else ""
            sure = bool(p) and p[letter] >= 0.9
            if not name and _LOST not in symbol and p:
                a = self.language.score(best[max(0, s - 6) : e + 6])
                b = self.language.score(best[max(0, s - 6) : s] + letter + best[e : e + 6])
                if b - a < MARGIN:
                    continue
            damaged = True
            out += [best[at:s], letter if sure else _LOST]
            at = e
        if damaged:
            best, name = "".join([*out, best[at:]]), name or "damaged"
        if not name and _CONTROLS.search(value):
            name = "controls"
        return best, name


def _first_bigrams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams by source of values in which no cipher has a symbol."""
    find = _ciphers().any_symbol
    for d in parts:
        into: dict[str, Counter] = {}
        for v, source in zip(d["value"], d["source"]):
            if v.isascii() or not (find(v) or _LOST in v):
                Language.count(v, into.setdefault(source, Counter()))
        yield pd.DataFrame([(s, a, b, float(n)) for s, c in into.items() for (a, b), n in c.items()], columns=["what", "a", "b", "n"])


def _step(model: tuple):
    """The expectation step: restored bigrams by source, uses of ciphers, letters of damaged symbols, pairs of
    characters of odd words that nothing explains; all as counts. Every different value of a source counts once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Language(model[0]), *model[1:])
        for d in parts:
            pairs: dict[str, Counter] = {}
            other: Counter = Counter()
            for v, source in zip(d["value"], d["source"]):
                into = pairs.setdefault(source, Counter())
                if v.isascii():
                    Language.count(v, into)
                    other["c", source, ""] += 1
                    continue
                best, name, gain = reader.best(v, source)
                p = 1 / (1 + math.exp(-min(gain, 30))) if name else 1.0
                other["c", source, name] += p
                if name:
                    other["c", source, ""] += 1 - p
                if _LOST not in best:
                    Language.count(best, into, p)
                for _, _, symbol, q in reader.lost(best) if name else ():
                    for x, y in q.items():
                        if y > 0.01:
                            other["l", symbol, x] += y
                for w in reader.unexplained(v, best):
                    for x, y in zip(" " + w, w + " "):
                        other["u", source, x + y] += 1
            rows = [(f"b{s}", a, b, float(n)) for s, c in pairs.items() for (a, b), n in c.items()] + [(*k, float(n)) for k, n in other.items()]
            yield pd.DataFrame(rows, columns=["what", "a", "b", "n"])

    return run


_SCRIPTS = [("a", "ɏ"), ("Ѐ", "ԯ")]


def learn_substitution(pairs: dict[str, float], language: dict[tuple[str, str], float], rounds: int = 150, starts: int = 8) -> dict[int, str]:
    """Characters -> letters of an unknown substitution, from counts of its pairs of characters and a language's bigrams.

    A pair of characters is drawn as a pair of letters of one script from the language, each of which gives its
    character with a probability to be learnt; expectation and maximisation over the pairs' counts, from several seeded
    starts near the order of frequencies for each script that the language has, the likeliest of which stays. ASCII
    characters stand for themselves. Of the characters of one letter the commonest is the small one; others that mostly
    begin words are capitals. Characters seen too little, or whose letter stays in doubt, have none.
    """
    total = sum(pairs.values())
    seen: Counter = Counter()
    first: Counter = Counter()
    for xy, n in pairs.items():
        seen[xy[1]] += n
        if xy[0] == " ":
            first[xy[1]] += n
    unknown = sorted(c for c, n in seen.items() if not c.isascii() and n >= 3)
    if total < 300 or len(unknown) < 8:
        return {}
    left: Counter = Counter()
    for (a, _), n in language.items():
        left[a] += n
    have = sum(left.values())
    plain = sorted({c.lower() for xy in pairs for c in xy if c.isascii()})
    symbols = [*unknown, *plain]
    of = {c: i for i, c in enumerate(symbols)}
    n = np.zeros((len(symbols), len(symbols)))
    for xy, k in pairs.items():
        x, y = (c.lower() if c.isascii() else c for c in xy)
        if x in of and y in of:
            n[of[x], of[y]] += k
    freq = np.array([seen[c] / total for c in unknown])
    u = len(unknown)
    best, model = -np.inf, None
    for lo, hi in _SCRIPTS:
        letters = sorted(x for x, m in left.items() if lo <= x <= hi and x.isalpha() and m >= 1e-4 * have)
        if len(letters) < 8:
            continue
        states = [*letters, *[c for c in plain if c not in letters]]
        at = {x: i for i, x in enumerate(states)}
        t = np.full((len(states), len(states)), 1e-7)
        for (a, b), m in language.items():
            if a in at and b in at:
                t[at[a], at[b]] += m / have
        t /= t.sum()
        base = t.sum(1)
        fixed = np.zeros((len(symbols), len(states)))
        for c in plain:
            fixed[of[c], at[c]] = 1.0
        free = np.zeros_like(fixed, dtype=bool)
        free[:u, : len(letters)] = True
        rank = np.abs(np.log(freq)[:, None] - np.log(base[: len(letters)])[None, :])
        for seed in range(starts):
            r = np.random.default_rng(seed)
            e = fixed.copy()
            e[:u, : len(letters)] = np.exp(-rank) * r.uniform(0.5, 1.5, rank.shape)
            e /= np.maximum(e.sum(0), 1e-12)
            for _ in range(rounds):
                x = n / np.maximum(e @ t @ e.T, 1e-300)
                got = e * (x @ (e @ t.T)) + e * (x.T @ (e @ t))
                e = np.where(free, got + 1e-4, fixed)
                e /= np.maximum(e.sum(0), 1e-12)
            like = float((n * np.log(np.maximum(e @ t @ e.T, 1e-300))).sum())
            if like > best:
                best, model = like, (letters, e[:u, : len(letters)] * base[: len(letters)])
    if model is None:
        return {}
    letters, post = model
    post = post / np.maximum(post.sum(1, keepdims=True), 1e-300)
    out, small = {}, {}
    for i in sorted(range(u), key=lambda i: -seen[unknown[i]]):
        c, k = unknown[i], int(post[i].argmax())
        if post[i, k] >= 0.5 and letters[k] != c:
            capital = letters[k] in small and first[c] > seen[c] / 2
            small.setdefault(letters[k], c)
            out[ord(c)] = letters[k].upper() if capital else letters[k]
    # What has been learnt must read as the language: else the words left over were no text under one substitution.
    score, read = Language(language), 0.0
    for xy, m in pairs.items():
        x, y = xy.translate(out).lower()
        read += m * score.log(x, y)
    return out if read >= READ * total else {}


def _sums(values: DataFrame, run) -> list:
    got = values.mapInPandas(run, "what string, a string, b string, n double")
    return got.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()


def learn(values: DataFrame, rounds: int = 2) -> Reader:
    """EM over all of *values* (``source, value``: the different texts of each source).

    To the driver come sums only: bigrams of characters by source, uses of ciphers by source, letters by damaged symbol,
    pairs of unexplained characters by source; their sizes are bounded by ``ALPHABETS``, the 60-odd ciphers and the
    languages, not by the texts. Without values the language is empty and nothing gets restored.
    """
    by_source: dict[str, dict] = {}
    for source, a, b, n in _sums(values, _first_bigrams):
        by_source.setdefault(source, {})[a, b] = n
    weights, letters, learnt = {}, {}, {}
    for _ in range(rounds):
        got = _sums(values, _step((_together(by_source), weights, letters, learnt)))
        by_source, uses, found, left = {}, {}, {}, {}
        for what, a, b, n in got:
            if what[0] == "b":
                by_source.setdefault(what[1:], {})[a, b] = n
            else:
                {"c": uses, "l": found, "u": left}[what].setdefault(a, {})[b] = n
        weights = {s: {k: (n + 0.01) / (sum(u.values()) + 1) for k, n in u.items()} for s, u in uses.items()}
        letters = {s: {x: n / sum(u.values()) for x, n in u.items()} for s, u in found.items()}
        for s, pairs in left.items():
            if table := learn_substitution(pairs, by_source.get(s, {})):
                learnt.setdefault(s, {})[f"learnt{len(learnt.get(s, ())) + 1}"] = table
    return Reader(Language(_together(by_source)), weights, letters, learnt)


def _together(by_source: dict[str, dict]) -> dict:
    out: Counter = Counter()
    for pairs in by_source.values():
        for k, n in pairs.items():
            out[k] += n
    return dict(out)


def restore(values: DataFrame, reader: Reader) -> DataFrame:
    """Adds ``restored`` and ``cipher`` (null: unaffected) to ``value, source``."""
    model = (reader.language.pairs, reader.weights, reader.letters, reader.learnt)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(Language(model[0]), *model[1:])
        for d in parts:
            got = [(v, "") if v.isascii() else r.repair(v, s) for v, s in zip(d["value"], d["source"])]
            yield d.assign(restored=[g[0] for g in got], cipher=[g[1] or None for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields)
    return values.mapInPandas(run, f"{fields}, restored string, cipher string")


def _long(records: DataFrame, chats: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    langs = chats.select("chat_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("source"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns])
    d = records.select("rec_id", "chat_id", F.explode(pairs).alias("x")).select("rec_id", "chat_id", "x.field", "x.value")
    d = d.where(F.col("value").isNotNull())
    return d.join(langs, "chat_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def repair(records: DataFrame, chats: DataFrame, columns: tuple[str, ...] = ("content", "sender_name")) -> DataFrame:
    """``rec_id, field, value, restored, cipher``: one row per affected value.

    All different values of a source teach the language, each once; those with a character beyond ASCII are looked at
    for a cipher, once for all their rows, which get the result by a join. Defined cases: null, empty and ASCII values
    are unaffected; a chat without a known language is a source of its own; what can't be restored is U+FFFD in the
    result; rows keep their id, repeated rows each have one.
    """
    long = _long(records, chats, columns)
    values = cut_lineage(long.select("source", "value").distinct())  # read once per round
    reader = learn(values)
    found = restore(values.where(F.col("value").rlike(r"[^\x00-\x7F]")), reader).where(F.col("cipher").isNotNull())
    suspects = long.where(F.col("value").rlike(r"[^\x00-\x7F]"))
    return suspects.join(found, ["source", "value"]).select("rec_id", "field", "value", "restored", "cipher")
