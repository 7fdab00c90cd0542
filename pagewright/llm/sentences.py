"""Sentence boundaries in any language and script.

A hidden-event n-gram model: between two words there may stand an unseen
boundary token. Paragraph edges show which words end and begin sentences, the
insides of paragraphs which words merely follow others; from both come the
model's estimates for the word before a gap (abbreviations seldom end a
paragraph), and the words after it (words that open paragraphs, against all
words). Where marks are set, the gaps that can hold a boundary are those after
closing marks and, in scripts that set none, blanks; a paragraph without any mark is
one of hidden events only, so every gap between its words, or characters where a
script has no blanks, can hold one. Forward-backward over a paragraph, in which very
short sentences are unlikely, gives each gap's posterior. Quotations and brackets are
matched first: inside them a sentence does not end. Units are words, long ones before
a stop backing off to their class; in scripts without blanks between words they are
runs of two (ideographs, kana) or five (Thai and its neighbours) characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.session import spread

#: Rounds of expectation and maximisation over the gaps of all documents.
EM = 3
#: Distinct keys a task counts before it hands its counts on.
KEYS = 200_000
RARE = 5
#: Words of more letters before a stop stand for their class.
LONG = 6
#: Words, and pieces of text with their marks, that a task remembers the classes of.
MEMO = 1 << 20
#: Units of a sentence, on average, and those that a boundary hardly stands within, in paragraphs without marks.
UNMARKED, SHORT = 14, 4
_BLOCK = re.compile(r"\n[^\S\n]*\n\s*")
_MARKS = re.compile("[\"'“”„«»‘’()（）「」『』\\[\\]《》〈〉]")
_PAIRS = {"(": ")", "（": "）", "「": "」", "『": "』", "[": "]", "《": "》", "〈": "〉", "«": "»"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏŠŽČĆĐŁŚŻŹŐŰİĞŞ"
_THAI = "฀-๿຀-໿ក-៿က-႟"
#: Gaps: terminators (a Greek question mark before a Greek capital), or blanks beside scripts without them.
_STOPS = ".!?…؟۔।॥。！？｡‼⁇⁈⁉։።፧፨။។៕༎᠃᠉᙮߸꓿꘎꘏"
_GAP = re.compile(rf"[{_STOPS}]+|(?<=[α-ωάέήίόύώϊϋ])[;;](?=\s+[Α-ΩΆΈΉΊΌΎΏ«(]|\s*$)|(?<=[{_THAI}])\s+(?=\S)|(?<=[0-9])\s+(?=[{_THAI}])")
_WIDE = "。！？｡။។៕༎"
_ANY = re.compile(rf"[{_STOPS}{_THAI};;]")
_CLOSERS = "\"'”’»)]）」』》〉“"
_BULLET = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s")
_RIGHT = re.compile(r"[^\w\n]*\n?[^\w\n]*(\w+(?:['’]\w+)?)")
_UNIT = re.compile("[぀-ヿ㐀-鿿]|[^\\W_぀-ヿ㐀-鿿]+(?:['’][^\\W_]+)?")
_GLUED = re.compile(rf"[^\W\d_]{{2}}[.!?](?=[{_UP}])")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_THAI_WORD = re.compile(f"[{_THAI}]")
_GENERAL = re.compile(r"\w+(?:['’]\w+)?")


def spans_of_marks(text: str) -> list[tuple[int, int]]:
    """(open, close) of matched quotations and brackets of a paragraph, outermost only, however long.

    A mark that is not closed before the paragraph ends, or before one around it
    closes, opens nothing.
    """
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []

    def shut(opener: str, at: int) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == opener:
                found.append((stack[k][1], at))
                del stack[k:]
                return

    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        before, after = text[at - 1 : at] if at else " ", text[at + 1 : at + 2] or " "
        if c in _PAIRS:
            stack.append((c, at))
        elif c in _CLOSE:
            shut(_CLOSE[c], at)
        elif c == "„":
            stack.append((c, at))
        elif c in "“”":
            if any(s == "„" for s, _ in stack):
                shut("„", at)
            elif c == "“":
                stack.append((c, at))
            else:
                shut("“", at)
        elif c == '"':
            pending = any(s == c for s, _ in stack)
            if pending and not (before.isspace() and not after.isspace()):
                shut(c, at)
            elif not after.isspace():
                stack.append((c, at))
        elif c in "'‘’":
            opens = c != "’" and (before.isspace() or before in "(“„«\"") and (after.isalnum() or after in "¡¿")
            if opens:
                stack.append(("'", at))
            elif before in ",.!?…" and not after.isalnum() and any(s == "'" for s, _ in stack):
                shut("'", at)
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


class _Rights(dict):
    """A word after a gap, with (unit, class of its first letter)."""

    def __missing__(self, w: str) -> tuple[str, str]:
        if len(self) > MEMO:
            self.clear()
        c = w[0]
        if _CJK.match(c):
            value = w[:2], "c"
        elif _THAI_WORD.match(c):
            value = w[:5], "t"
        elif c.isdigit():
            value = "<digits>", "d"
        else:
            value = _bare(w), "u" if c.isupper() else "l" if c.islower() else "n"
        self[w] = value
        return value


def _right_key(text: str, at: int) -> tuple[str, str]:
    """(unit after the gap, class of its first letter)."""
    m = _RIGHT.match(text, at)
    return _rights[m[1]] if m else ("", "x")


def _bare(word: str) -> str:
    """A word without an English possessive."""
    return word[:-2] if word[-2:] in ("'s", "’s") else word


def _unit_before(text: str, start: int, at: int) -> str:
    """The unit that ends at ``at``: two characters of a script without blanks, else the word in lower case; empty if none does."""
    if at > start and _CJK.match(text[at - 1]):
        return text[max(start, at - 2) : at]
    k = at
    while k > start and text[k - 1].isalnum():
        k -= 1
    return text[k:at].lower()


class _Lefts(dict):
    """What stands before a gap back to the last blank, marks and all, with its class: the word itself where it is short."""

    def __missing__(self, said: str) -> str:
        if len(self) > MEMO:
            self.clear()
        self[said] = value = self._class(said)
        return value

    @staticmethod
    def _class(said: str) -> str:
        body = said.rstrip(_CLOSERS)
        at = len(body.rstrip(_STOPS + ";;"))
        word, marks = body[:at], body[at:]
        quoted = len(body) < len(said)
        if "…" in marks or ".." in marks:
            return "<ellipsis>" + ("c" if word and _CJK.match(word[-1]) else "." if "." in marks else "")
        if marks[-1:] != ".":
            return ("<wide>" if marks[-1:] in _WIDE else "<strong>") + ("q" if quoted else "")
        if quoted:
            return "<stop>q"
        word = word.strip("\"'“”„«»‘’()[]¿¡")
        glued = _GLUED.search(word)
        if glued:
            word = word[glued.end() :]
        if not word:
            return "<mark>"
        if word.isdigit():
            return "<dd>" if len(word) < 3 else "<number>"
        if word[0].isdigit():
            return "<number>"
        # "4.3" before a unit, "п.м" and the like keep their dots
        if len(word) > LONG and "." not in word:
            return "<word>"
        if len(word) == 1 and word.isupper():
            return "<initial>"
        return word.lower()


def _left_key(text: str, start: int, at: int, end: int) -> str:
    """Class of what stands before a gap with marks from ``at`` to ``end``."""
    last = text[end - 1]
    if last.isspace():
        return "<blank>"
    if last in _WIDE:  # scripts without blanks: the marks alone tell
        return _lefts[text[max(start, at - 1) : end]]
    k = text.rfind(" ", start, at)
    k = max(k, text.rfind("\n", max(k, start), at), text.rfind("\xa0", max(k, start), at), start - 1)
    return _lefts[text[k + 1 : end]]


_lefts, _rights = _Lefts(), _Rights()


def _gaps(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(at, end of marks, start of what follows) of every gap outside quotations and brackets in a paragraph."""
    block = text[start:end]
    inside = spans_of_marks(block) if _MARKS.search(block) else []
    closes = {b for _, b in inside}
    bullet = _BULLET.match(block)
    floor, k = bullet.end() if bullet else 0, 0
    n, last = len(block), len(inside)
    for m in _GAP.finditer(block):
        a, b = m.span()
        if a < floor:
            continue
        follows = block[b] if b < n else ""
        if not last and (follows == " " or follows == "\n"):  # the usual case
            yield start + a, start + b, start + b
            continue
        while k < last and inside[k][1] < a:
            k += 1
        if m[0].isspace():
            if not (k < last and inside[k][0] < a):
                yield start + a, start + b, start + b
            continue
        while b < n and block[b] in _CLOSERS and (b in closes or block[b] not in "“\"'"):
            b += 1
        if b >= n or (k < last and inside[k][0] < a and inside[k][1] >= b):
            continue
        follows = block[b]
        if not follows.isspace():
            wide = m[0][-1] in _WIDE or (m[0][-1] == "…" and _CJK.match(follows)) or (b > m.end() and _CJK.match(follows))
            if not wide and not (
                follows.isupper()
                and a > 1
                and block[a - 1].islower()
                and block[a - 2].isalpha()
                and (b + 1 >= n or not block[b + 1].isupper())
                and not _joined_parts(block, a, b)
            ):
                continue
        yield start + a, start + b, start + b


def _joined_parts(block: str, a: int, b: int) -> bool:
    """Whether the run of text without blanks around a mark is an address or path, by an @ or a slash in it."""
    while a and not block[a - 1].isspace():
        a -= 1
    while b < len(block) and not block[b].isspace():
        b += 1
    said = block[a:b]
    return "@" in said or "/" in said


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BLOCK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


class Counts:
    """What the model is estimated from: sums over texts, so counts of parts add up to those of the whole."""

    def __init__(self, texts: Iterator[str] = ()):
        self.final, self.seen, self.starts, self.words, self.lasts, self.unsure = (Counter() for _ in range(6))
        self._raw: Counter = Counter()
        for text in texts:
            self.add(text)

    def __len__(self) -> int:
        return len(self._raw) + len(self.unsure)

    def add(self, text: str) -> None:
        for a, b in _blocks(text):
            block = text[a:b].rstrip()
            b = a + len(block)
            caseless = block.islower() or block.isupper()
            if len(block) < 30 or _BULLET.match(block):
                # tells nothing of sentences, but the model is asked for its gaps
                for at, end, after in _gaps(text, a, b):
                    self.unsure[(_left_key(text, a, at, end), *_right_key(text, after), caseless)] += 0
                continue
            w, _ = _right_key(text, a)
            self.starts[w] += 1
            self._raw.update(_GENERAL.findall(text, a + 1, b))
            for at, end, after in _gaps(text, a, b):
                key = _left_key(text, a, at, end)
                self.seen[key] += 1
                self.unsure[(key, *_right_key(text, after), caseless)] += 1
            tail = len(block.rstrip(_CLOSERS))
            if tail and block[tail - 1] in _STOPS:
                at = a + len(block[:tail].rstrip(_STOPS))
                key = _left_key(text, a, at, b)
                self.final[key] += 1
                self.seen[key] += 1
                last = _unit_before(text, a, at)
                if last:
                    self.lasts[last] += 1

    def _words(self) -> Counter:
        for w, n in self._raw.items():
            if _CJK.match(w[0]):
                for k in range(0, len(w) - 1):
                    self.words[w[k : k + 2]] += n
            elif _THAI_WORD.match(w[0]):
                self.words[w[:5]] += n
            else:
                self.words["<digits>" if w[0].isdigit() else _bare(w)] += n
        self._raw.clear()
        return self.words

    def rows(self) -> pa.RecordBatch:
        """(what, key, word, kind, caseless, n), one row per key."""
        rows = [(what, key, "", "", False, n) for what, own in zip("fnswl", (self.final, self.seen, self.starts, self._words(), self.lasts)) for key, n in own.items()]
        rows += [("g", *key, n) for key, n in self.unsure.items()]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [()] * 6, types)], names=[*_KEY, "n"])

    @classmethod
    def of(cls, rows: Iterator[tuple]) -> Counts:
        """The counts that such rows hold."""
        out = cls()
        into = dict(zip("fnswl", (out.final, out.seen, out.starts, out.words, out.lasts)))
        for what, key, word, kind, caseless, n in rows:
            if what == "g":
                out.unsure[(key, word, kind, caseless)] += n
            else:
                into[what][key] += n
        return out


_KEY = ("what", "key", "word", "kind", "caseless")


class Model:
    """Estimates from paragraphs, whose edges are the only boundaries it is told."""

    def __init__(self, texts: Iterator[str] | Counts):
        counts = texts if isinstance(texts, Counts) else Counts(texts)
        self.final, self.seen, self.starts, self.words, unsure = counts.final, counts.seen, counts.starts, counts._words(), counts.unsure
        self.rate = self.final["<word>"] / max(self.seen["<word>"], 1) or 0.2
        # what an unseen word of a class tells is learnt from the rare ones
        self.start_class, self.word_class = Counter(), Counter()
        for w in {*self.starts, *self.words}:
            if self.starts[w] + self.words[w] <= RARE and w:
                kind = "c" if _CJK.match(w) else "t" if _THAI_WORD.match(w) else "d" if w == "<digits>" else "u" if w[0].isupper() else "l" if w[0].islower() else "n"
                self.start_class[kind] += self.starts[w]
                self.word_class[kind] += self.words[w]
        whole = Counter(self.words)
        self._tables()
        self.before = {key: self._odds(key, self.final[key] / self.rate, n) for key, n in self.seen.items()}
        for _ in range(EM):
            expected, opened = Counter(self.final), Counter()
            for (key, *right), n in unsure.items():
                if not n:
                    continue
                share = n / (1 + math.exp(-self.before[key] - self.right(*right)))
                expected[key] += share
                opened[right[0]] += share
            # words that open sentences inside paragraphs do not count as mere followers
            self.words = Counter({w: max(n - opened[w], 0.0) for w, n in whole.items()})
            self._tables()
            # a word that paragraphs hardly end with does not become a usual end by what follows it; short ones less so
            self.before = {}
            for key, n in self.seen.items():
                spare = 1 if len(key) < 5 else 3
                self.before[key] = self._odds(key, min(expected[key], 1.3 * n * (self.final[key] + spare) / (n * self.rate + spare)), n)
        # only words that follow gaps, and begin or end paragraphs, are asked for
        self.n_lasts = sum(counts.lasts.values())
        self.lasts = counts.lasts
        asked = {right[0] for _, *right in unsure} | {*self.starts, *self.lasts}
        lower = {w.lower() for w in asked}
        self.starts, self.words = (Counter({w: own[w] for w in asked if w in own}) for own in (self.starts, self.words))
        self.low_starts, self.low_words = (Counter({w: own[w] for w in lower if w in own}) for own in (self.low_starts, self.low_words))
        self.after = {}
        self.met: dict[tuple[str, str, bool], float] = {}

    def _tables(self) -> None:
        self.n_starts, self.n_words = sum(self.starts.values()), sum(self.words.values())
        self.low_starts, self.low_words = Counter(), Counter()
        for own, low in ((self.starts, self.low_starts), (self.words, self.low_words)):
            for w, n in own.items():
                low[w.lower()] += n
        self.after: dict[tuple[str, str, bool], float] = {}

    @staticmethod
    def _odds(key: str, ends: float, seen: float) -> float:
        """Log odds of a boundary after ``key``, where ``ends`` of ``seen`` are held to be ones."""
        if key in ("<strong>", "<wide>"):
            p = 0.985
        elif key == "<blank>":
            p = 0.8
        elif key.endswith(">q") or key.startswith("<ellipsis>"):
            p = min(max((ends + 0.9) / (seen + 1.5), 0.05), 0.97)
        else:
            if key == "<initial>":
                guess = 0.02
            elif key in ("<word>", "<number>", "<mark>"):
                guess = 0.95
            elif key == "<dd>" or "." in key:
                guess = 0.3
            else:
                guess = (0.15, 0.15, 0.5, 0.6, 0.8, 0.9, 0.9)[min(len(key), 6)]
            p = min(max((ends + 2 * guess) / (seen + 2), 0.003), 0.05 if key == "<initial>" else 0.97)
        return math.log(p / (1 - p))

    def left(self, key: str) -> float:
        """Log odds of a boundary, by what stands before it."""
        if key not in self.before:
            self.before[key] = self._odds(key, 0.0, 0.0)
        return self.before[key]

    def both(self, key: str, word: str, kind: str, caseless: bool) -> float:
        at = (key, word, caseless)
        value = self.met.get(at)
        if value is None:
            value = self.left(key) + self.right(word, kind, caseless)
            if len(self.met) < MEMO:
                self.met[at] = value
        return value

    def ends(self, unit: str) -> float:
        """Log ratio of a unit before a boundary against the unit anywhere."""
        met = self.low_words[unit]
        if not met and not self.lasts[unit]:
            return -1.0
        share = (max(met, self.lasts[unit]) + 0.5) / max(self.n_words, 1)
        return max(min(math.log((self.lasts[unit] + 4 * share) / (self.n_lasts + 4) / share), 3.0), -4.0)

    def right(self, word: str, kind: str, caseless: bool) -> float:
        """Log ratio of the word after a boundary against the word inside a sentence."""
        at = (word, kind, caseless)
        if at not in self.after:
            scale = 8.0
            group = kind if not (caseless and kind == "l") else "u"
            base_start = (self.start_class[group] + 0.5) / (self.n_starts + 3)
            base_word = (self.word_class[kind] + 0.5) / (self.n_words + 3)
            # unseen words: as their class; seen ones: by their own counts, drawn towards it
            begun = self.low_starts[word.lower()] if caseless else self.starts[word]
            met = self.low_words[word.lower()] if caseless else self.words[word]
            share_start = begun / max(self.n_starts, 1)
            share_word = met / max(self.n_words, 1)
            total = met + begun
            own = math.log((share_start + 2e-6) / (share_word + 2e-6)) if total else 0.0
            whole = math.log(base_start / base_word)
            trust = total / (total + scale)
            value = trust * own + (1 - trust) * whole
            if kind == "l" and not caseless:  # a lower-case letter after a stop seldom opens a sentence
                value = min(value, 0.0) + min(whole, -2.0)
            self.after[at] = max(min(value, 4.0), -7.0)
        return self.after[at]


def split_sentences(text: str, model: Model, short: float = 0.1) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, outer blanks left out; every other character is in one."""
    out: list[tuple[int, int]] = []
    for a, b in _blocks(text):
        cuts = [a]
        gaps = [*_gaps(text, a, b)] if _ANY.search(text, a, b) else []
        if not gaps:
            if b - a > 2 * UNMARKED and text[a:b].rstrip()[-1:] not in _STOPS:
                cuts += _unmarked(text, a, b, model, short)
        else:
            caseless = text[a:b].islower() or text[a:b].isupper()
            odds = [model.both(_left_key(text, a, at, end), *_right_key(text, nxt), caseless) for at, end, nxt in gaps]
            cuts += [gaps[k][2] for k in _decide(text, a, gaps, odds, short)]
        cuts.append(b)
        for s, e in zip(cuts, cuts[1:]):
            piece = text[s:e]
            inner = piece.strip()
            if inner:
                s += len(piece) - len(piece.lstrip())
                out.append((s, s + len(inner)))
    return out


def _unmarked(text: str, start: int, end: int, model: Model, short: float) -> Iterator[int]:
    """Boundaries of a paragraph in which no mark stands: hidden events between all its units.

    Forward-backward over all gaps; the states are the units since the last boundary, up to SHORT.
    """
    units = [m.span() for m in _UNIT.finditer(text, start, end)]
    if len(units) < 2 * UNMARKED:
        return
    block = text[start:end]
    caseless = block.islower() or block.isupper() or not any(c.isupper() for c in block)
    prior = -math.log(UNMARKED - 1)
    weights = []
    for (_, before), (at, _) in zip(units, units[1:]):
        right = _rights[text[at : at + 2] if _CJK.match(text[at]) else _GENERAL.match(text, at)[0]]
        odds = prior + model.ends(_unit_before(text, start, before)) + model.right(*right, caseless)
        weights.append(math.exp(max(min(odds, 30.0), -30.0)))
    cost = [short] * (SHORT - 1) + [1.0]
    backs = [cost]  # the mass behind each gap, by state
    for w in reversed(weights[1:]):
        last = backs[-1]
        mass = [c * w * last[0] + last[min(d + 1, SHORT - 1)] for d, c in enumerate(cost)]
        backs.append([x / sum(mass) for x in mass])
    state = [1.0] + [0.0] * (SHORT - 1)
    for (at, _), w, behind in zip(units[1:], weights, reversed(backs)):
        cut = sum(f * c for f, c in zip(state, cost)) * w
        state = [cut, *state[:-2], state[-2] + state[-1]]
        total = sum(state)
        state = [f / total for f in state]
        if state[0] * behind[0] > 0.5 * sum(f * x for f, x in zip(state, behind)):
            yield at


def _decide(text: str, start: int, gaps: list[tuple[int, int, int]], odds: list[float], short: float) -> Iterator[int]:
    """Gaps whose posterior exceeds one half: forward-backward where neighbours are close, else each on its own."""
    n = len(gaps)
    close = [gaps[k][0] - (gaps[k - 1][2] if k else start) < 14 and " " not in text[(gaps[k - 1][2] if k else start) : gaps[k][0]].strip() for k in range(n)]
    k = 0
    while k < n:
        end = k + 1
        while end < n and close[end]:
            end += 1
        if end == k + 1:
            if odds[k] + (math.log(short) if close[k] and k == 0 else 0.0) > 0:
                yield k
        else:
            # states: no boundary, boundary
            weight = [math.exp(min(max(o, -30), 30)) for o in odds[k:end]]
            if close[k] and k == 0:
                weight[0] *= short
            ahead = [(1.0, weight[0])]
            for w in weight[1:]:
                x, y = ahead[-1]
                total = x + y
                ahead.append(((x + y) / total, (x + y * short) * w / total))
            back = [(1.0, 1.0)]
            for w in reversed(weight[1:]):
                x, y = back[-1]
                total = x + w * y + 1e-300
                back.append(((x + w * y) / total, (x + short * w * y) / total))
            back.reverse()
            for j, ((fx, fy), (bx, by)) in enumerate(zip(ahead, back)):
                if fy * by > fx * bx:
                    yield k + j
        k = end


def fitted(rows: DataFrame, text: str) -> Model:
    """The model of all texts, copies included.

    Tasks count, Spark sums; what comes to the driver is one row per distinct key
    (words, and pairs of what stands before and after gaps), however many texts
    there are. The texts themselves are not shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.add(value)
            if len(counts) > KEYS:
                yield counts.rows()
                counts = Counts()
        yield counts.rows()

    partial = rows.select(text).mapInArrow(count, "what string, key string, word string, kind string, caseless boolean, n long")
    summed = partial.groupBy(*_KEY).agg(F.sum("n").alias("n")).toArrow()
    # in one order, so that sums of shares come out alike in every run
    return Model(Counts.of(sorted(zip(*(c.to_pylist() for c in summed.columns)))))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char): the sentences of every text, offsets from 0 in code points, end exclusive.

    The model is estimated from all texts (``fitted``). Null and blank
    texts have no sentence; repeated rows repeated ones; other columns are
    ignored. Splitting is a map without a shuffle of the texts.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)
    model = fitted(rows, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                for a, b in split_sentences(value, model):
                    row.append(k)
                    start.append(a)
                    end.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["key", "start_char", "end_char"]
            )

    return rows.mapInArrow(run, f"key {kind}, start_char int, end_char int").withColumnRenamed("key", key)
