"""Defects of question and answer pairs.

A linear-chain conditional random field tags the clauses of an answer as
answer, refusal, echo of the question, foreign or unfinished; the share of the
text that each tag covers decides whether, and how, the pair is broken. Any tag may
stand on any clause: what decides are the field's weights over measures of a clause -
how much of the question it gives back, how likely its letters are in the question's
language, how its words are spread over refusals and answers, words of denying beside
words for sources and for knowing, and how it ends. The field and the tables behind
its measures are fitted on all pairs and on corruptions made of each, whose
tags are known: answers cut short, questions given back, answers to questions of
another language, and refusals. Tasks count and Spark sums; the field's likelihood is
convex, so its optimum over all pairs does not hang on how they are parted.
"""

from __future__ import annotations

import functools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from pagewright.session import cut, spread

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs, about, and letters that corruptions are made among; all such blocks are used.
BLOCK, LETTERS = 1500, 2_000_000
#: Keys that a task counts before it passes them on.
HELD = 200_000
#: Weight of the squares of the field's weights, slope at which it is at its optimum, and steps at most.
DECAY, SLOPE, STEPS = 1e-3, 2e-4, 150
#: Bins of a likelihood to one, and letters of texts whose measures are kept for when they are met again.
FINE, KEPT = 10_000, 400

# Frequent words of languages in Latin script.
FREQUENT = {
    "en": "the of and to in a is was were it that for on with as at by we i our my they he she had has have from this but not when until which who what where how did did ever so because while nobody of",
    "fr": "le la les des du de et un une est était dans sur pour avec au aux par nous vous il elle ce cette qui que où pas ne mais car sous vers près quand avons sommes jusqu personne nul sauf tout puis quel quelle pourquoi comment",
    "de": "der die das den dem des und ein eine einen ist war im in auf für mit von zu zum zur wir ich er sie es nicht aber denn doch bei nach vor wo wie wann haben hat niemand außer ganz aus über bis gegen warum kein keine gab welche",
    "es": "el la los las de del y un una es era en por para con al se que no pero aunque porque cuando donde nadie salvo todo hacia tras nos su sus fue había llegamos sobre hasta cerca qué tan cómo cuándo dónde quién",
    "it": "il lo la gli le di del della e un una è era in per con al che non ma perché quando dove nessuno tutto ci si sono siamo fino dopo nel",
    "pt": "o a os as de do da e um uma é era em por para com ao que não mas porque quando onde ninguém tudo nos foi até depois no na",
    "nl": "de het een en van in op voor met aan is was wij we ik hij zij niet maar want toen waar wie niemand alles naar uit over tot bij",
}
_SETS = {lang: frozenset(words.split()) for lang, words in FREQUENT.items()}
_SCRIPTS = (("ja", "[぀-ヿ]"), ("zh", "[㐀-鿿]"), ("ko", "[가-힯]"), ("th", "[฀-๿]"), ("hi", "[ऀ-ॿ]"), ("ar", "[؀-ۿ]"), ("el", "[Ͱ-Ͽἀ-῿]"), ("ru", "[Ѐ-ӿ]"))
_ANY_SCRIPT = re.compile("|".join(cls for _, cls in _SCRIPTS))
_SCRIPTS = tuple((lang, re.compile(cls)) for lang, cls in _SCRIPTS)
_SPOKEN_IN = {w: tuple(lang for lang, own in _SETS.items() if w in own) for w in frozenset().union(*_SETS.values())}

# What stands in place of an answer.
_NOTHING = re.compile(r"(?:none|null|nil|nan|n/?a|no answer|empty|answer|a|reply|response|undefined|tbd)?", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|```\w*|&nbsp;")
_LABEL = re.compile(r"^\s*[^\W\d_]+(?: [^\W\d_]+){0,2}\s*[:：]\s*")
# Words of declining and of not finding, and of advice after it.
_REFUSAL = re.compile(
    r"\b(?:can(?:no|')?t|cannot|can not|could(?:n't| not)|unable|won'?t|will not|do(?:es)?(?:n't| not)|did(?:n't| not)|not able|rather not)\b"
    r"[^.!?]{0,60}?\b(?:find|locate|answer|say|tell|help|know|guess|speculate|establish|determine|contain|mention|record|cover|appear|give|identify|assist|support|verify|see|provide)\b"
    r"|\b(?:no|nothing|none|neither)\b[^.!?]{0,60}?\b(?:mention|record|entry|entries|excerpts?|pages|notes|journals?|trace|information|evidence|answers?|about)\b"
    r"|\bnot (?:mentioned |recorded |found )?(?:in|among) (?:the|these|any|your|my) (?:journals?|excerpts?|entr(?:y|ies)|pages|notes|material|texts?)\b"
    r"|\b(?:nicht|nichts|keine?[mnrs]?)\b[^.!?]{0,40}\b(?:tagebüch\w*|auszüg\w*|einträg\w*|seiten)\b"
    r"|\b(?:pas|rien|aucune?)\b[^.!?]{0,40}\b(?:carnets?|extraits?|journa(?:l|ux)|pages)\b"
    r"|\b(?:no|nada|ninguna?)\b[^.!?]{0,40}\b(?:diarios?|extractos?|fragmentos?|páginas)\b"
    r"|\bno (?:mention|record|entry|trace)\b|\b(?:sorry|unfortunately|i (?:don'?t|do not) know|as an (?:ai|assistant))\b"
    r"|\b(?:nichts (?:dazu|finden|darüber)|leider nichts|leider (?:kein|keine|nicht)|keine? (?:eintrag|einträge|hinweise?|angaben?|auszug)|weiß (?:ich )?(?:es )?nicht|kann (?:ich )?[^.!?]{0,30}(?:nicht|nichts))\b"
    r"|\b(?:ne (?:trouve|sais|peux|dit|mentionne|permet)[^.!?]{0,30}(?:rien|pas)|aucune? (?:mention|entrée|trace|extrait|information)|rien (?:à ce sujet|trouvé)|désolé)\b"
    r"|\b(?:no (?:encuentro|encontré|sé|puedo|consta|aparece|hay (?:ninguna|mención|nada))|ninguna (?:mención|entrada)|lo siento)\b",
    re.I,
)
_ADVICE = re.compile(r"\b(?:try|you (?:could|can|may|might)|closest entry|nearest entry|something else|search for|versuchen|essayez|prueb[ae]|instead)\b", re.I)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_TURN = re.compile(r"\b(?:but|however|though|aber|doch|mais|pero)\b", re.I)
_CLAUSE = re.compile(r"[^.!?…。！？।؟\n]*(?:[.!?…。！？।؟]+[\"'”’»)\]」』]*(?=\s|$|[^\x00-\x7f])|\n|$|[.!?]+)")
_DONE = re.compile(r"(?:[.!?…。！？।؟;;][\"'”’»“)\]」』*_]*|\d{4}-\d{2}-\d{2}[\])\"'*]*)\s*$")
_DANGLES = re.compile(r"(?:[,;:–—-]|\b(?:and|or|but|the|a|an|of|to|with|und|oder|der|die|das|et|ou|le|la|les|de|y|o|el|que|which|was|because|while))\s*$", re.I)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|‘[^’]*’|「[^」]*」")
_WORD = re.compile(r"[^\W_]+")
_SPELT = re.compile(r"[^\W\d_]+")


def language(text: str, least: int = 2) -> str | None:
    """The language, by script and, in Latin script, by ``least`` frequent words; null where nothing tells."""
    if _ANY_SCRIPT.search(text):
        letters = sum(map(str.isalpha, text)) or 1
        for lang, cls in _SCRIPTS:
            n = len(cls.findall(text))
            if n > letters * (0.05 if lang == "ja" else 0.4):
                return lang
    words = [w.lower() for w in _WORD.findall(text)]
    hits = dict.fromkeys(_SETS, 0)
    for w in words:
        for lang in _SPOKEN_IN.get(w, ()):
            hits[lang] += 1
    hits["es"] += 2 * ("¿" in text or "¡" in text)
    best = max(hits, key=lambda x: hits[x])
    second = max(n for lang, n in hits.items() if lang != best)
    return best if hits[best] > second and hits[best] >= min(least, len(words)) else None


def is_empty(answer: str | None) -> bool:
    """Whether nothing is said: blanks, marks, markup or a word in place of an answer."""
    if answer is None:
        return True
    bare = " ".join(_WORD.findall(_MARKUP.sub(" ", unicodedata.normalize("NFKC", answer))))
    return _NOTHING.fullmatch(bare.lower().replace("n a", "na")) is not None


def clauses(answer: str) -> list[str]:
    return [m[0].strip() for m in _CLAUSE.finditer(answer) if _WORD.search(m[0])]


def _unclosed(text: str) -> bool:
    return text.count('"') % 2 == 1 or any(text.count(a) > text.count(b) for a, b in ("()", "[]", "“”", "«»", "「」") if not (a == "“" and "„" in text))


FEATURES = (
    "always refusal denial_of_source denial_of_knowing likeness_to_refusals turn advice dated shared echo most_shared letters_unlikely other_letters "
    "other_words whole_unlikely whole_other same_words last unfinished dangles unclosed first longer wordless negative"
).split()
_AT = {name: k for k, name in enumerate(FEATURES)}
_ODD, _ENDS, _TOLD = ([_AT[n] for n in names.split()] for names in ("refusal echo other_words", "unfinished dangles unclosed", "letters_unlikely other_letters other_words whole_unlikely whole_other"))
# Words of denying, for sources, and of knowing and saying.
_NEGATIVE = frozenset("no not nor nothing none never neither nobody unable cannot cant without silent blank absent missing unclear unknown impossible nicht nichts kein keine keinen nie ne pas rien aucun aucune jamais nada ninguno ninguna nunca tampoco sin нет не ничего".split())
_SOURCES = frozenset("page pages journal journals diary diaries note notes entry entries excerpt excerpts record records information archive text texts material source sources context passage passages document documents tagebuch tagebücher tagebüchern auszug auszüge auszügen eintrag einträge seiten carnet carnets extrait extraits journal journaux diario diarios extracto extractos fragmento fragmentos páginas дневник дневниках записи записях".split())
_KNOWING = frozenset("know knows tell telling say saying find finding found answer answering way means idea clue help sure certain available establish determine confirm mention mentioned mentions guess comment wissen weiß sagen finden beantworten antwort sais savoir dire trouver trouve répondre encontrar encuentro responder saber sé decir знаю сказать найти ответить".split())
# Ways of declining that the field is shown whatever the sample holds.
REFUSALS = (
    "I can't find that in the journals.", "Nothing is said about it.", "I have no means of knowing that.", "The notes are silent about this.", "This information is not available.",
    "I am not able to say.", "There is no way to know from these excerpts.", "I could not find an answer in the material.", "No such entry is available to me.", "That is not something the text tells.",
    "The entries say nothing about that.", "I don't have that information.", "Unfortunately I can not help with this.", "It is impossible to tell from the pages.", "I have no record of this.",
    "Darüber steht nichts in den Tagebüchern.", "Das kann ich nicht sagen.", "Dazu finde ich keine Angaben.", "Die Seiten sagen dazu nichts.",
    "Je ne trouve rien à ce sujet.", "Les carnets n'en disent rien.", "Cette information n'est pas disponible.", "No encuentro nada sobre eso.", "Los diarios no dicen nada.", "No dispongo de esa información.",
)


def _letters(text: str) -> str:
    return " " + " ".join(_SPELT.findall(text.lower())) + " "


def _chance(grams: dict[str, int], gram: str) -> float:
    """Log likelihood of a third letter after two, by counts of twos and threes; of any that was not met, of two."""
    return math.log(((grams.get(gram, 0) if len(gram) == 3 else 0) + 0.3) / (grams.get(gram[:2], 0) + 12))


SOUND, REFUSING = 1, 2


def kind_of(question: str | None, answer: str | None) -> int:
    """SOUND or REFUSING where a pair looks like it, by patterns alone; 0 where neither."""
    if not question or is_empty(answer) or not (parts := clauses(answer)):
        return 0
    x = features(question, answer, parts)
    if x[:, _AT["refusal"]].any() and not x[:, _AT["dated"]].any():
        return REFUSING
    return SOUND if not x[:, _ODD].any() and not x[-1, _ENDS].any() and x[0, _AT["whole_other"]] == 0 else 0


def _told(question: str, answer: str) -> tuple[str | None, str, int]:
    """(language, text, half) of a pair whose letters count; copies stand in one half."""
    text = question + " " + _QUOTED.sub(" ", answer)
    return language(question, 1), text, zlib.crc32(text.encode("utf-8", "replace")) & 1


def count(pairs: Iterable[tuple[str, str, int]]) -> Counter:
    """(what, of which, key): how often, over pairs with their kind; sums of such counts are the counts of all."""
    seen: Counter = Counter()
    for q, a, kind in pairs:
        seen["letters", "", ""] += len(q) + len(a)
        words = {w.lower() for w in _WORD.findall(a)}
        if kind == REFUSING:
            seen["refusals", "", ""] += 1
            seen.update(("no", "", w) for w in words)
        elif kind == SOUND:
            tongue, text, half = _told(q, a)
            seen["sound", "", ""] += 1
            seen["asked", language(q) or "", ""] += 1
            seen.update(("yes", "", w) for w in words)
            if tongue:
                seen["texts", tongue, ""] += 1
                said = _letters(text)
                for gram in (*map("".join, zip(said, said[1:], said[2:])), *map("".join, zip(said, said[1:]))):
                    seen[f"half {half}", tongue, gram] += 1
    return seen


class Counts:
    """Counts of all pairs: letters of each language, words of refusals and of answers, and questions of each language."""

    #: Texts that a language needs.
    LEAST = 20

    def __init__(self, seen: Iterable[tuple[str, str, str, int]]):
        self.texts: dict[str, int] = {}
        self.asked: dict[str, int] = {}
        self.no, self.yes, self.refusals, self.sound, self.size = {}, {}, len(REFUSALS), 0, 0
        halves: dict[str, tuple[dict[str, int], dict[str, int]]] = {}
        for what, tongue, key, n in seen:
            if what.startswith("half"):
                halves.setdefault(tongue, ({}, {}))[int(what[-1])][key] = n
            elif what in ("no", "yes"):
                getattr(self, what)[key] = n
            elif what in ("texts", "asked"):
                getattr(self, what)[tongue] = n
            elif what == "refusals":
                self.refusals += n
            elif what == "sound":
                self.sound = n
            else:
                self.size = n
        for t in REFUSALS:
            for w in {w.lower() for w in _WORD.findall(t)}:
                self.no[w] = self.no.get(w, 0) + 1
        self.letters = {t: own for t, own in halves.items() if self.texts[t] >= self.LEAST}

    def usual(self, pairs: Iterable[tuple[str, str, int]], full: int) -> Counter:
        """(language, bin of likelihood): clauses of ``full`` letters, those of each half judged by the letters of the other."""
        seen: Counter = Counter()
        for q, a, kind in pairs:
            tongue, text, half = _told(q, a) if kind == SOUND else (None, "", 0)
            if tongue in self.letters:
                other = self.letters[tongue][1 - half]
                for clause in clauses(text):
                    if len(clause) >= full:
                        said = _letters(clause)
                        total = sum(_chance(other, said[k : k + 3]) for k in range(len(said) - 2))
                        seen[tongue, round(FINE * total / max(len(said) - 2, 1))] += 1
        return seen


class Tables:
    """What the measures hang on: letters of each language, and words of refusals and of answers."""

    #: Letters of a clause and texts of a language at which likelihoods count in full, and texts kept with theirs at most.
    FULL, ENOUGH, MOST = 30, 400, 100_000

    def __init__(self, counts: Counts, usual: Iterable[tuple[str, int, int]]):
        self.tongues = {t: k for k, t in enumerate(sorted(counts.letters))}
        self.trust = {t: min(1.0, counts.texts[t] / self.ENOUGH) for t in self.tongues}
        bins: dict[str, list[tuple[int, int]]] = {t: [] for t in self.tongues}
        for t, at, n in usual:
            bins[t].append((at, n))
        self.usual = {t: _middle(own) for t, own in bins.items()}
        letters = [counts.letters[t] for t in self.tongues]
        # what both halves say, so that texts of either are as usual as others
        self.grams = {gram: tuple(sum(_chance(half, gram) for half in own) / len(own) for own in letters) for gram in {gram for own in letters for half in own for gram in half}}
        self.unseen = (_chance({}, "   "),) * len(letters)
        ratio = (counts.sound + 1) / (counts.refusals + 1)
        self.words = {w: math.log(ratio * (counts.no.get(w, 0) + 0.2) / (counts.yes.get(w, 0) + 0.2)) for w in {*counts.no, *counts.yes}}
        self.kept: dict[tuple[str, str], object] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "kept": {}}

    def _keep(self, what: str, text: str, value):
        """``value``, kept with what it is of where that is short; bounded, and never sent to tasks."""
        if len(text) <= KEPT:
            if len(self.kept) >= self.MOST:
                self.kept.clear()
            self.kept[what, text] = value
        return value

    def _three(self, three: str) -> tuple[float, ...]:
        return self.grams.get(three) or self.grams.get(three[:2]) or self.unseen

    def _word(self, word: str) -> tuple[float, ...]:
        """Log likelihoods of the letters of a word with a blank on either side, in each language."""
        known = self.kept.get(("word", word))
        if known is None:
            said = f" {word} "
            known = self._keep("word", word, tuple(map(sum, zip(*(self._three(said[k : k + 3]) for k in range(len(word)))))))
        return known

    def likelihoods(self, text: str) -> tuple[float, ...]:
        """Mean log likelihood of the letters of a text in each language."""
        known = self.kept.get(("text", text))
        if known is None:
            words = _SPELT.findall(text.lower())
            between = [self._three(f"{a[-1]} {b[0]}") for a, b in zip(words, words[1:])]
            size = sum(map(len, words)) + len(between)
            known = self._keep("text", text, tuple(sum(own) / size for own in zip(*map(self._word, words), *between)) if words else (0.0,) * len(self.tongues))
        return known

    def unlikely(self, text: str, tongue: str | None) -> tuple[float, float]:
        """(how unusual the letters are in the language, how much better another one fits), both 0 where nothing tells."""
        if tongue not in self.tongues:
            return 0.0, 0.0
        middle, spread = self.usual[tongue]
        each = [*self.likelihoods(text)]
        own = each.pop(self.tongues[tongue])
        weight = min(1.0, sum(map(str.isalpha, text)) / self.FULL) * self.trust[tongue]
        other = max(each, default=own)
        return weight * min(max((middle - own) / spread - 2.5, 0.0), 4.0), weight * min(max(other - own, 0.0), 1.5)

    def refusing(self, part: str, words: set[str]) -> float:
        """Mean log odds of a clause's words in refusals against answers, where above 0; unseen words tell nothing."""
        known = self.kept.get(("part", part))
        if known is None:
            known = self._keep("part", part, min(max(math.fsum(self.words.get(w, 0.0) for w in words) / max(len(words), 1), 0.0), 3.0))
        return known


def _middle(bins: list[tuple[int, int]]) -> tuple[float, float]:
    """Median and deviation, the latter a little wider, of values counted in bins."""
    if not bins:
        return 0.0, 0.05
    at, n = np.array(sorted(bins), dtype=float).T
    upto = np.cumsum(n)
    median = (at[np.searchsorted(upto, upto[-1] / 2)] + at[np.searchsorted(upto, upto[-1] / 2, side="right")]) / 2
    mean = float(at @ n) / upto[-1]
    return float(median) / FINE, math.sqrt(float((at - mean) ** 2 @ n) / upto[-1]) / FINE + 0.05


def _measured(part: str) -> tuple:
    """What a clause says by itself, whatever is asked and counted."""
    plain = _LABEL.sub("", part)
    said = [w.lower() for w in _WORD.findall(plain)]
    every = {w.lower() for w in _WORD.findall(part.replace("n't", " not").replace("n'", "ne "))}
    clean = _QUOTED.sub(" ", part)
    refusal, dated, advice = bool(_REFUSAL.search(part)), bool(_DATE.search(part)), bool(_ADVICE.search(part))
    turn = dated and bool(_TURN.search(part))
    negative = not every.isdisjoint(_NEGATIVE)
    told = not (turn or (dated and not advice)) and len(every) > 2
    denial = negative and told and not every.isdisjoint(_SOURCES), negative and told and not every.isdisjoint(_KNOWING)
    return said, every, clean, language(clean), not plain.strip(), told, refusal and told, denial, refusal and turn, advice, dated and not advice, negative


_measured_short, _language_short = functools.lru_cache(8192)(_measured), functools.lru_cache(8192)(language)


def features(question: str, answer: str, parts: list[str], tables: Tables | None = None) -> np.ndarray:
    """A row of measures for each clause."""
    own = frozenset(w.lower() for w in _WORD.findall(question))
    parts, answer = [p.replace("’", "'") for p in parts], answer.replace("’", "'")
    spoken, bare = (_language_short if len(question) <= KEPT else language)(question, 1), _QUOTED.sub(" ", answer)
    whole = language(bare) or language(bare, 1)
    whole_unlikely, whole_letters = tables.unlikely(bare, spoken) if tables else (0.0, 0.0)
    done = bool(_DONE.search(answer))
    rows = []
    for k, part in enumerate(parts):
        said, every, clean, mine, unlabelled, told, refusal, denial, turned, advice, dated, negative = (_measured_short if len(part) <= KEPT else _measured)(part)
        shared = sum(w in own for w in said) / max(len(said), 1)
        last = k == len(parts) - 1
        echo = shared >= 0.99 and bool(said) and (len(said) >= 0.7 * len(own) or unlabelled)
        unlikely, letters = tables.unlikely(clean, spoken) if tables else (0.0, 0.0)
        rows.append((
            1, refusal, *denial, tables.refusing(part, every) if tables and told else 0.0, turned, advice, dated, shared if shared >= 0.6 else 0.0, echo, 0.6 <= shared < 0.99,
            unlikely, letters, bool(spoken and mine and mine != spoken), whole_unlikely, bool(spoken and whole and whole != spoken) + whole_letters, bool(spoken and mine == spoken),
            last, last and not done, last and bool(_DANGLES.search(answer)), last and _unclosed(answer), k == 0, len(said) > 2 * len(own), not said, negative,
        ))
    return np.array(rows, dtype=float).reshape(len(parts), len(FEATURES))


class Field:
    """A linear-chain conditional random field over rows of indicators."""

    def __init__(self, n: int, tables: Tables | None = None):
        self.tables = tables
        self.unary, self.pair = np.zeros((n, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))

    def tag(self, x: np.ndarray) -> list[int]:
        """The most likely tag of each clause, by its posterior."""
        return _beliefs(x[None], self.unary, self.pair)[0][0].argmax(axis=1).tolist()

    def fit(self, slope: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> "Field":
        """The weights of greatest likelihood: ``slope`` sums weight, loss and its slope at some weights over all examples."""
        shape, cut_at = self.unary.shape, self.unary.size

        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            total = slope(w[:cut_at].reshape(shape), w[cut_at:].reshape(self.pair.shape))
            size = max(total[0], 1e-9)
            return float(total[1] / size + DECAY / 2 * (w @ w)), total[2:] / size + DECAY * w

        w = _least(at, np.concatenate([self.unary.ravel(), self.pair.ravel()]))
        self.unary, self.pair = w[:cut_at].reshape(shape), w[cut_at:].reshape(self.pair.shape)
        return self


def _least(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """Where a convex function is least, by its slopes (limited-memory BFGS)."""
    value, grad = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(grad).max() < SLOPE:
            break
        way, parts = -grad, []
        for s, y in reversed(past):
            parts.append((s @ way) / (s @ y))
            way = way - parts[-1] * y
        if past:
            s, y = past[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), part in zip(past, reversed(parts)):
            way = way + (part - (y @ way) / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while step > 1e-8:
            value_there, grad_there = at(w + step * way)
            if value_there <= value + 1e-4 * step * (grad @ way):
                break
            step /= 2
        else:
            break
        s, y = step * way, grad_there - grad
        if s @ y > 1e-12:
            past = [*past[-19:], (s, y)]
        w, value, grad = w + s, value_there, grad_there
    return w


def _beliefs(x: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each tag, scores, what comes before, what a step weighs) of chains of one length."""
    score = x @ unary
    top = score.max(axis=2, keepdims=True)
    here, across = np.exp(score - top), np.exp(pair)
    ahead, scale, back = np.empty_like(here), np.empty(here.shape[:2]), np.ones_like(here)
    for t in range(here.shape[1]):
        ahead[:, t] = here[:, t] if t == 0 else here[:, t] * (ahead[:, t - 1] @ across)
        scale[:, t] = ahead[:, t].sum(axis=1)
        ahead[:, t] /= scale[:, t, None]
    for t in range(here.shape[1] - 2, -1, -1):
        back[:, t] = (here[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]) @ across.T
    total = np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1)
    return ahead * back, total, ahead, here * back / scale[:, :, None]


def slope(x: np.ndarray, y: np.ndarray, weight: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Weight, loss and slope of the loss, summed over chains of one length, as one row."""
    belief, total, ahead, behind = _beliefs(x, unary, pair)
    n, length = y.shape
    own = np.eye(len(TAGS))[y]
    loss = total - ((x @ unary) * own).sum(axis=(1, 2)) - pair[y[:, :-1], y[:, 1:]].sum(axis=1)
    lean = (belief - own) * weight[:, None, None]
    both = np.zeros_like(pair)
    for t in range(1, length):
        both += (ahead[:, t - 1] * weight[:, None]).T @ behind[:, t]
    both *= np.exp(pair)
    np.subtract.at(both, (y[:, :-1], y[:, 1:]), weight[:, None])
    return np.concatenate([[weight.sum(), weight @ loss], (x.reshape(n * length, -1).T @ lean.reshape(n * length, -1)).ravel(), both.ravel()])


def examples(pairs: list[tuple[str, str, int]], seed: int, tables: Tables, asked: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(measures, tags, weight), by number of clauses, of sound pairs and of corruptions of each."""
    rng = random.Random(seed)
    sound = [(q, a, language(q) or "") for q, a, kind in pairs if kind == SOUND]
    refusals = [*REFUSALS, *(a for _, a, kind in pairs if kind == REFUSING)]
    by_language: dict[str, list[int]] = {}
    for k, (_, _, tongue) in enumerate(sound):
        by_language.setdefault(tongue, []).append(k)
    tongues = [t for t in by_language if t]
    rows: dict[int, tuple[list, list, list]] = {}

    def add(q: str, a: str, tags, weight: int = 1) -> None:
        parts = clauses(a)
        if parts:
            x, y = features(q, a, parts, tables), [TAGS.index(t) for t in tags(parts)]
            # a foreign answer to a question that does not show its language teaches nothing
            if TAGS[y[0]] != "foreign" or x[:, _TOLD].any():
                for to, value in zip(rows.setdefault(len(y), ([], [], [])), (x, y, weight)):
                    to.append(value)

    most = max(asked.values(), default=1)
    for q, a, tongue in sound:
        # languages that few ask in count for more
        add(q, a, lambda p: ["answer"] * len(p), min(4, most // asked[tongue]))
        words = a.split()
        for _ in range(2):
            at = rng.randrange(2, max(len(words), 3))
            short = " ".join(words[:at])
            if at < len(words) and not _DONE.search(short):
                if rng.random() < 0.4 and len(words[at]) > 3:
                    short += " " + words[at][: rng.randrange(1, len(words[at]))]
                add(q, short, lambda p: ["answer"] * (len(p) - 1) + ["unfinished"])
        shape = rng.choice(("{0}", "Q: {0}", "{0} {0}", '"{0}"', "Question: {0}\nAnswer: {0}", "{0}!!"))
        add(q, shape.format(q), lambda p: ["echo"] * len(p))
        no = rng.choice(refusals)
        no = rng.choice((no, no, no.lower().replace("'", "").rstrip("."), f"{no} Try another one instead.", f"{no} The closest entry is 2001-02-03, which is about something else."))
        add(q, no, lambda p: ["refusal"] * len(p))
        others = [t for t in tongues if t != tongue]
        if others:
            foreign = sound[rng.choice(by_language[rng.choice(others)])][1]
            # whatever its end, and some scripts have no stops
            add(q, foreign.rstrip(".!?…") if rng.random() < 0.3 else foreign, lambda p: ["foreign"] * len(p))
        other = {"en": "Wir waren müde und suchten das Haus. Der Weg ist lang.", "de": "We went to the mill and it was closed."}.get(tongue, "We went to the mill and it was closed. It was late when we left.")
        add(q, other, lambda p: ["foreign"] * len(p))
    return [(np.array(x, np.float32), np.array(y, np.int8), np.array(w, np.float32)) for x, y, w in rows.values()]


def train(pairs: list[tuple[str, str]]) -> Field:
    """The field, from sound-looking pairs among ``pairs`` and corruptions of them, in this process."""
    known = [(q, a, kind_of(q, a)) for q, a in pairs]
    counts = Counts((*key, n) for key, n in count(known).items())
    tables = Tables(counts, ((*key, n) for key, n in counts.usual(known, Tables.FULL).items()))
    field = Field(len(FEATURES), tables)
    rows = examples(known, 1, tables, counts.asked)
    return field.fit(lambda unary, pair: sum((slope(*row, unary, pair) for row in rows), np.zeros(2 + unary.size + pair.size)))


def defect(question: str | None, answer: str | None, absent: bool | None, field: Field) -> str | None:
    """The defect of a pair, or null: by the share of the answer that each tag covers."""
    if is_empty(answer):
        return "empty"
    question, parts = question or "", clauses(answer)
    if not parts:
        return "empty"
    tags = [TAGS[t] for t in field.tag(features(question, answer, parts, field.tables))]
    size = sum(map(len, parts))
    share = {t: sum(len(p) for p, tag in zip(parts, tags) if tag == t) / size for t in TAGS}
    if share["echo"] >= 0.8:
        return "copy"
    if share["refusal"] >= 0.6 or (share["refusal"] and not share["answer"]):
        return None if absent else "refusal"
    if share["foreign"] >= 0.6:
        return "language"
    if tags[-1] == "unfinished":
        return "truncated"
    return None


def _triples(batch: pa.RecordBatch) -> list[tuple[str, str, int]]:
    return list(zip(*(batch.column(n).to_pylist() for n in ("question", "answer", "kind"))))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = pa.array([kind_of(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())], pa.int32())
        told = batch.append_column("kind", kinds)
        yield told.filter(pa.compute.not_equal(kinds, 0))


def _sums(pairs: DataFrame, of: Callable[[list[tuple[str, str, int]]], Counter], names: str, schema: str) -> list[tuple]:
    """Counts that ``of`` takes of a few pairs, summed over all: rows of key and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                seen.update(of(_triples(batch.slice(k, BLOCK))))
                if len(seen) > HELD:
                    yield _counted(seen, names)
                    seen.clear()
        yield _counted(seen, names)

    table = pairs.mapInArrow(run, f"{schema}, n bigint").groupBy(*names.split()).agg(F.sum("n").alias("n")).toArrow()
    return list(zip(*(column.to_pylist() for column in table.columns)))


def _counted(seen: Counter, names: str) -> pa.RecordBatch:
    keys = [list(column) for column in zip(*seen)] or [[] for _ in names.split()]
    kinds = [pa.int32() if n == "bin" else pa.string() for n in names.split()]
    return pa.RecordBatch.from_arrays([*map(pa.array, keys, kinds), pa.array(list(seen.values()), pa.int64())], names=[*names.split(), "n"])


def _fitted(rows: DataFrame) -> Field:
    """The field, from all different pairs among rows of question and answer."""
    hashed = rows.where("question IS NOT NULL AND answer IS NOT NULL").select("question", "answer", F.xxhash64("question", "answer").alias("h"))
    once = hashed.groupBy("h").agg(F.min(F.struct("question", "answer")).alias("p")).select("h", "p.*")
    pairs = cut(once.mapInArrow(_kinds, "h bigint, question string, answer string, kind int"))
    counts = Counts(_sums(pairs, count, "what tongue key", "what string, tongue string, key string"))
    tables = Tables(counts, _sums(pairs, lambda few: counts.usual(few, Tables.FULL), "tongue bin", "tongue string, bin int"))
    field, asked = Field(len(FEATURES), tables), counts.asked
    names = ["length", "chains", "x", "y", "weight"]

    def corrupt(key: tuple, block: pa.Table) -> pa.Table:
        known = sorted(zip(*(block.column(n).to_pylist() for n in ("question", "answer", "kind"))))
        made = examples(known, key[0].as_py(), tables, asked)
        packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x, _, _ in made]
        columns = [y.shape[1] for _, y, _ in made], [y.shape[0] for _, y, _ in made], packed, [y.tobytes() for _, y, _ in made], [w.tobytes() for _, _, w in made]
        return pa.Table.from_arrays([*map(pa.array, columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    blocks = max(1, round((counts.sound + counts.refusals) / BLOCK), counts.size // LETTERS)
    # a number of parts that is given is not made smaller for their few bytes, as making measures of them is what takes time
    parts = min(blocks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * rows.sparkSession.sparkContext.defaultParallelism))
    blocked = pairs.withColumn("block", F.pmod("h", F.lit(blocks))).repartition(parts, "block")
    made = cut(blocked.groupBy("block").applyInArrow(corrupt, "length int, chains int, x binary, y binary, weight binary"))

    def over_all(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + unary.size + pair.size)
            for batch in batches:
                for length, chains, x, y, weight in zip(*(batch.column(n) for n in names)):
                    shape = chains.as_py(), length.as_py()
                    size = shape[0] * shape[1] * len(unary)
                    x = np.frombuffer(pa.decompress(x.as_buffer(), 4 * size, codec="zstd"), np.float32).reshape(*shape, len(unary))
                    total += slope(x, np.frombuffer(y.as_buffer(), np.int8).reshape(shape), np.frombuffer(weight.as_buffer(), np.float32), unary, pair)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["total"])

        return np.sum([np.zeros(2 + unary.size + pair.size), *(r.total for r in made.mapInArrow(run, "total array<double>").collect())], axis=0)

    return field.fit(over_all)


def defects(df: DataFrame, key: str) -> DataFrame:
    """(key, defect) of every broken pair, of columns question, answer and absent.

    Defects are empty, truncated, refusal (not where ``absent`` holds), copy and
    language; a pair has one at most, and sound pairs give no row. A null answer is
    empty; a null question has no language and cannot be copied; a null ``absent``
    counts as false. The field is fitted on all different pairs, copies counting
    once, and tags every row. Repeated rows give repeated rows; other columns are
    ignored. The tagging is a map without a shuffle; fitting shuffles the pairs twice.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("key"), "question", "answer", "absent"))
    field = _fitted(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = functools.lru_cache(1)(lambda q, a, n: defect(q, a, n, field))
        for batch in batches:
            found = [judge(q, a, n) for q, a, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            broken = pa.array([k for k, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(broken), pa.array([d for d in found if d], pa.string())], names=["key", "defect"])

    return rows.mapInArrow(run, f"key {kind}, defect string").withColumnRenamed("key", key)
