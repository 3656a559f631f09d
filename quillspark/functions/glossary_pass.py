"""One text's pass over a glossary that a task holds whole.

The rule takes the terms in order, each on the text that the ones before it
left. Here a text is a chain of words with what stands between them. Words and
pairs of neighbours tell the terms that may stand in it; these wait in a heap by
their order, and a replacement adds what its own words and new neighbours tell.
A term whose turn has passed is not taken again, as by the rule. So the work goes
with a text's words and replacements, not with the terms.

Words that no term can join, now or after any replacement, don't touch each other: the text
falls into runs of words that may meet, most of one word, and what becomes of a run is
remembered.

Where the terms are few (``FEW`` at most) the rule itself is faster: each is sought in the
bytes of the text that is left, and no text is taken apart (``Few``).

What is a word character, and which characters differ in case only, is as in
Java's patterns (``(?iuU)``), which take the terms where they are too many for a task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

#: Letters by Unicode's further list, and joiners.
_MORE = {chr(c) for a, b in ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189), (0x200C, 0x200D)) for c in range(a, b + 1)}
_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
CJK = re.compile("[぀-ヿ㐀-鿿]")
#: Most terms that are sought one after the other; runs that are remembered, and their words;
#: runs of a text that are joined at second sight.
FEW, MEMO, LONG, JOINED = 64, 50_000, 8, 8
_WORD_BYTES = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
#: Further letters that differ from one of ASCII in case only.
_LIKE_ASCII = tuple(c.encode() for c in "\u0130\u0131\u017f\u212a")


def in_word(char: str) -> bool:
    return unicodedata.category(char) in _KINDS or char in _MORE


@cache
def word_class(end: int = 0x110000) -> str:
    """The word characters below ``end``, as ranges of a class."""
    out, begin = [], None
    for c in range(end + 1):
        if c < end and in_word(chr(c)):
            begin = c if begin is None else begin
        elif begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


@cache
def _parts(end: int) -> re.Pattern:
    return re.compile(f"([{word_class(end)}]+)")


def split(text: str) -> list[str]:
    """What stands between words, and the words, in turn. The shorter class is the faster."""
    return _parts(0x80 if text.isascii() else 0x10000 if max(text) < "\U00010000" else 0x110000).split(text)


@cache
def _fold_char(c: str) -> str:
    up = c.upper() if len(c.upper()) == 1 else c
    return "i" if c == "İ" else up.lower() if len(up.lower()) == 1 else up


def fold(word: str) -> str:
    """Equal for words that differ in case only, character by character."""
    return word.lower() if word.isascii() else "".join(map(_fold_char, word))


def folded(words: list[str]) -> list[str]:
    low = "\0".join(words).lower().split("\0") if words else []
    return [k if w.isascii() else fold(w) for k, w in zip(low, words)]


@lru_cache(1 << 16)
def _is_word(char: bytes) -> bool:
    return in_word(char.decode())


def _bare(text: bytes, i: int, j: int) -> bool:
    """No word character stands right before place i or at j."""
    a, b = i - 1, j + 1
    while a > 0 and text[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return not (i and _is_word(text[a:i])) and not (j < len(text) and _is_word(text[j:b]))


def starts_of(source: bytes, text: bytes) -> list[int]:
    """Where a term stands as a whole word or phrase, from the left on."""
    out, i, size, end = [], text.find(source), len(source), len(text)
    while i >= 0:
        j = i + size
        before, after = text[i - 1] if i else 32, text[j] if j < end else 32
        if before in _WORD_BYTES or after in _WORD_BYTES or (before > 127 or after > 127) and not _bare(text, i, j):
            j = i + 1
        else:
            out.append(i)
        i = text.find(source, j)
    return out


def _like_ascii(text: bytes) -> bool:
    return not text.isascii() and any(c[:1] in text and c in text for c in _LIKE_ASCII)


class Few:
    """Few terms (source, target) in the rule's order, over texts in UTF-8. Where case doesn't
    count, bytes tell only of sources in ASCII and of texts without letters like ASCII's."""

    def __init__(self, terms: list[tuple[str, str]], ignore_case: bool):
        self.ignore_case = ignore_case
        self.terms = [(source.encode(), target.encode(), CJK.search(source) is not None) for source, target in terms]
        self.fit = not ignore_case or all((cjk or s.isascii()) and not _like_ascii(t) for s, t, cjk in self.terms)
        if ignore_case:
            self.terms = [(s if cjk else s.lower(), t, cjk) for s, t, cjk in self.terms]

    def takes(self, text: bytes) -> bool:
        return self.fit and not (self.ignore_case and _like_ascii(text))

    def replaced(self, text: bytes) -> bytes:
        low = text.lower() if self.ignore_case else text
        for source, target, cjk in self.terms:
            if cjk:
                new = text.replace(source, target)
            elif starts := starts_of(source, low):
                ends = [0, *(i + len(source) for i in starts)]
                new = target.join([text[a:b] for a, b in zip(ends, [*starts, len(text)])])
            else:
                continue
            text, low = new, new.lower() if self.ignore_case else new
        return text


def pass_of(terms: list[tuple[str, str]], ignore_case: bool) -> Callable[[bytes], bytes]:
    """The replacement of all terms in a text in UTF-8."""
    few, whole = Few(terms, ignore_case) if len(terms) <= FEW else None, Glossary(terms, ignore_case)
    return lambda text: few.replaced(text) if few and few.takes(text) else whole.replaced(text.decode()).encode()


class Glossary:
    """Terms (source, target) in the rule's order."""

    def __init__(self, terms: list[tuple[str, str]], ignore_case: bool):
        self.terms, self.folded, self.flags = terms, folded if ignore_case else list, re.I if ignore_case else 0
        self.single: dict[str, list[int]] = {}
        self.pair: dict[str, dict[str, list[int]]] = {}
        self.odd: dict[str, list[int]] = {}  # by a character, or a word, that a term can't be without
        self.words: list[list[str] | None] = []
        self.inner: list[list[str]] = []
        self.cut: dict[int, tuple[list[str], list[str], list[str]]] = {}
        for rank, (source, _) in enumerate(terms):
            bits = split(source)
            words = self.folded(bits[1::2])
            cjk = CJK.search(source)
            plain = not cjk and bits[0] == "" and bits[-1] == ""
            self.words.append(words if plain else None)
            self.inner.append(bits[2:-1:2])
            if not plain:
                self.odd.setdefault(cjk[0] if cjk else words[0] if words else source[0], []).append(rank)
            elif len(words) == 1:
                self.single.setdefault(words[0], []).append(rank)
            else:
                self.pair.setdefault(words[0], {}).setdefault(words[1], []).append(rank)
        self.first = self.single.keys() | self.pair.keys()
        self.links: dict[str, set[str]] = {}  # words that follow a word in a term
        for words in filter(None, self.words):
            for a, b in zip(words, words[1:]):
                self.links.setdefault(a, set()).add(b)
        self.active = self.first | self.links.keys()
        self.gone = any(len(split(t)) == 1 for _, t in terms)  # a target without words
        self.memo: dict[str, _Run] = {}
        self.runs: dict[str, _Run] = {}

    def replaced(self, text: str) -> str:
        if self.odd or self.gone:  # what is no plain term may stand across words
            return self._left(_Chain(self, text))
        bits = split(text)
        words = bits[1::2]
        found = [run or self._word(w) for run, w in zip(map(self.memo.get, words), words)]
        spans, out, joined = [], [], 0
        for i in [i for i, (a, b) in enumerate(zip(found, found[1:])) if a.follow and a.meets(b)]:
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        for (begin, end), (following, _) in zip(spans, [*spans[1:], (len(words), 0)]):
            run = self._run(bits, begin, end)
            # a run may begin and end in words that its own words don't lead to
            while True:
                before = out[-1] if out and out[-1][1] == begin - 1 else (begin - 1, 0, found[begin - 1]) if begin else None
                if before and before[2].meets(run):
                    begin = before[0]
                    if out and out[-1] is before:
                        out.pop()
                elif end + 1 < following and run.meets(found[end + 1]):
                    end += 1
                else:
                    break
                joined += 1
                if joined > JOINED + len(spans) // JOINED:
                    return self._left(_Chain(self, text))
                run = self._run(bits, begin, end)
            out.append((begin, end, run))
        done = bits.copy()
        done[1::2] = [run.text for run in found]
        for begin, end, run in out:
            done[2 * begin + 1 : 2 * end + 2] = [run.text, *[""] * (2 * (end - begin))]
        return "".join(done)

    def _word(self, word: str) -> _Run:
        key = fold(word) if self.flags else word
        # words that no term has are without number, and not remembered
        return self._made(word, self.memo) if key in self.active else _Run(word, (key,), ())

    def _run(self, bits: list[str], begin: int, end: int) -> _Run:
        text = "".join(bits[2 * begin + 1 : 2 * end + 2])
        return self.runs.get(text) or self._made(text, self.runs if end - begin < LONG else {})

    def _made(self, text: str, memo: dict[str, _Run]) -> _Run:
        chain = _Chain(self, text)
        run = _Run(self._left(chain), chain.firsts, [self.links[w] for w in chain.lasts if w in self.links])
        if len(memo) >= MEMO:
            memo.clear()
        memo[text] = run
        return run

    def _left(self, chain: _Chain) -> str:
        """What all terms leave of a text."""
        while chain.due:
            rank = heappop(chain.due)
            if self.words[rank] is not None:
                chain.put(rank)
            else:
                now = chain.text()
                new = self._odd(rank, now)
                if new != now:
                    chain = _Chain(self, new, rank)
        return chain.text()

    def _odd(self, rank: int, text: str) -> str:
        source, target = self.terms[rank]
        if CJK.search(source):
            return text.replace(source, target)
        w = word_class()
        return re.sub(f"(?<![{w}]){re.escape(source)}(?![{w}])", lambda _: target, text, flags=self.flags)

    def target(self, rank: int) -> tuple[list[str], list[str], list[str]]:
        """What stands between a target's words, they, and as they are compared."""
        if rank not in self.cut:
            bits = split(self.terms[rank][1])
            self.cut[rank] = bits[::2], bits[1::2], self.folded(bits[1::2])
        return self.cut[rank]


class _Run:
    """What becomes of words: the text, the words that it begins with on the way, and
    the words that may follow those that it ends with."""

    __slots__ = ("text", "firsts", "follow")

    def __init__(self, text: str, firsts: Iterable[str], follow: Iterable[set[str]]):
        self.text, self.firsts, self.follow = text, tuple(firsts), tuple(follow)

    def meets(self, right: _Run) -> bool:
        """A term may go over the border of the two."""
        for words in self.follow:
            for w in right.firsts:
                if w in words:
                    return True
        return False


class _Chain:
    """A text between two terms. Node 0 is the border: after it stands the first
    word, before it the last; ``gap[i]`` is what stands before node i."""

    def __init__(self, glossary: Glossary, text: str, rank: int = -1):
        bits = split(text)
        self.g, n = glossary, len(bits) // 2
        self.word = ["", *bits[1::2]]
        self.key = ["", *glossary.folded(bits[1::2])]
        self.gap = [bits[-1], *bits[:-1:2]]
        self.after, self.before = [*range(1, n + 1), 0], [n, *range(n)]
        self.rank, self.at, seen = rank, {}, set()
        self.firsts, self.lasts = {self.key[self.after[0]]}, {self.key[self.before[0]]}
        for i, k in enumerate(self.key):
            if k in glossary.first:
                self.at.setdefault(k, []).append(i)
                if k in glossary.pair:
                    seen.update(glossary.pair[k].get(self.key[self.after[i]], ()))
        for k in self.at:
            seen.update(glossary.single.get(k, ()))
        if glossary.odd:
            for k in {*self.key, *text} & glossary.odd.keys():
                seen.update(glossary.odd[k])
        self.seen = {r for r in seen if r > rank}
        self.due = list(self.seen)
        heapify(self.due)

    def text(self) -> str:
        out, i = [], self.after[0]
        while i:
            out += self.gap[i], self.word[i]
            i = self.after[i]
        return "".join(out) + self.gap[0]

    def _tell(self, ranks) -> None:
        for r in ranks:
            if r > self.rank and r not in self.seen:
                self.seen.add(r)
                heappush(self.due, r)

    def _last(self, i: int, words: list[str], inner: list[str]) -> int | None:
        """The last node of a term that begins at node i, if it stands there."""
        for k, gap in zip(words[1:], inner):
            i = self.after[i]
            if not i or self.key[i] != k or self.gap[i] != gap:
                return None
        return i

    def put(self, rank: int) -> None:
        """The target in place of the term, from the left on."""
        self.rank, words = rank, self.g.words[rank]
        inner, after = self.g.inner[rank], self.after
        starts = [i for i in self.at.get(words[0], ()) if after[i] >= 0]  # -1: replaced
        if inner:
            starts = [i for i in starts if self._last(i, words, inner) is not None]
        if inner and len(starts) > 1 and words[0] in words[1:]:  # they may overlap
            own, starts, i = set(starts), [], self.after[0]
            while i:
                if i in own:
                    starts.append(i)
                i = self.after[i]
        target = self.g.target(rank)
        for i in starts:
            last = i if not inner else self._last(i, words, inner) if after[i] >= 0 else None
            if last is not None:
                self._put(i, last, *target)

    def _put(self, i: int, last: int, gaps: list[str], words: list[str], keys: list[str]) -> None:
        g, left, right, gap = self.g, self.before[i], self.after[last], self.gap[i]
        while True:
            following = self.after[i]
            self.after[i] = -1
            if i == last:
                break
            i = following
        at = left
        for between, word, k in zip(gaps, words, keys):
            new = len(self.word)
            self.word.append(word)
            self.key.append(k)
            self.gap.append(gap + between)
            self.before.append(at)
            self.after.append(0)
            self.after[at] = new
            if k in g.first:
                self.at.setdefault(k, []).append(new)
                self._tell(g.single.get(k, ()))
            if self.key[at] in g.pair:
                self._tell(g.pair[self.key[at]].get(k, ()))
            at, gap = new, ""
        self.after[at], self.before[right], self.gap[right] = right, at, gap + gaps[-1] + self.gap[right]
        if not left:
            self.firsts.add(self.key[self.after[0]])
        if not right:
            self.lasts.add(self.key[self.before[0]])
        if self.key[at] in g.pair:
            self._tell(g.pair[self.key[at]].get(self.key[right], ()))
        if g.odd:
            for k in {*keys, *"".join(gaps + words)} & g.odd.keys():
                self._tell(g.odd[k])
