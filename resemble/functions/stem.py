"""Suffix-stripping stemmer (T3), one look-up per token.

Porter's 1980 algorithm (steps 1a to 5b) with the extensions that the pinned
English stemmer uses: words of one or two letters and a short list of
irregular forms are left alone; ``ied`` and ``ies`` keep an ``ie`` after one
letter; a vowel and a consonant alone count as ``*o``; step 1c needs a
consonant that is not the first letter; ``alli`` is stripped before the other
rules of step 2, which then run on the result; ``fulli`` becomes ``ful``; the l
of ``logi`` counts as part of the stem.

The rules work on a word and its *form*, a string of ``c`` and ``v`` for its
consonants and vowels; the measure of a stem is the number of ``vc`` in its
form.  A corpus repeats its words, so a task keeps a dictionary of the words it
has met: each distinct one is stemmed once, all others are one look-up.  The
dictionary is emptied at ``MEMO_WORDS`` words, which bounds it in any corpus.
Token lists travel as one string a text, joined by line feeds, row by row: an
Arrow batch would hold thousands of whole texts, and each of them again in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The rule tables and the irregular forms of the algorithm.
# ---------------------------------------------------------------------------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize")
# ---------------------------------------------------------------------------

#: distinct words that a task remembers
MEMO_WORDS = 100_000


def form(word: str) -> str:
    """``v`` for each vowel, ``c`` for all else; y is a vowel after a consonant."""
    out, last = [], "v"
    for letter in word:
        last = "v" if letter in "aeiou" or (letter == "y" and last == "c") else "c"
        out.append(last)
    return "".join(out)


def measure(stem: str) -> int:
    return form(stem).count("vc")


def _short_end(stem: str) -> bool:
    """``*o``: a consonant, a vowel and a consonant but w, x, y at the end; or only a vowel and a consonant."""
    f = form(stem)
    return f == "vc" or (f.endswith("cvc") and stem[-1] not in "wxy")


def _longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends in."""
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plural(word: str) -> str:
    """Step 1a."""
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    """Step 1b: eed, ied, ed and ing."""
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    end = _longest(word, ("ed", "ing"))
    if end is None or "v" not in form(word[:-len(end)]):
        return word
    stem = word[:-len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    f = form(stem)
    if len(stem) > 1 and stem[-1] == stem[-2] and f[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if f.count("vc") == 1 and _short_end(stem) else stem


def _final_y(word: str) -> str:
    """Step 1c."""
    return word[:-1] + "i" if word.endswith("y") and len(word) > 2 and form(word)[-2] == "c" else word


def _double_suffix(word: str) -> str:
    """Step 2."""
    if word.endswith("alli") and measure(word[:-4]):
        return _double_suffix(word[:-2])
    end = _longest(word, STEP2)
    if end is None:
        return word
    stem = word[:-len(end)]
    return stem + STEP2[end] if measure(stem + "l" if end == "logi" else stem) else word


def _more_suffix(word: str) -> str:
    """Step 3."""
    end = _longest(word, STEP3)
    return word[:-len(end)] + STEP3[end] if end is not None and measure(word[:-len(end)]) else word


def _last_suffix(word: str) -> str:
    """Step 4: the suffix goes after a measure above 1; ion only after s or t."""
    end = _longest(word, STEP4)
    if end is None:
        return word
    stem = word[:-len(end)]
    return stem if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else word


def _final_e(word: str) -> str:
    """Steps 5a and 5b."""
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stem_word(word: str) -> str:
    """The stem of one lower-case token."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _double_suffix, _more_suffix, _last_suffix, _final_e):
        word = step(word)
    return word


class _Memo(dict):
    """Stems of the words met so far."""

    def __missing__(self, word: str) -> str:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = stem_word(word)
        return out


_stems = _Memo()


@F.udf(T.StringType(), useArrow=False)
def stem_lines(text: str | None) -> str | None:
    """Each line of a string of tokens stemmed."""
    return None if text is None else "\n".join(map(_stems.__getitem__, text.split("\n")))


def stem_tokens(tokens: Column) -> Column:
    """Stem every token of an ``array<string>`` column that isn't null; empty stems are dropped."""
    return F.array_remove(F.split(stem_lines(F.array_join(tokens, "\n")), "\n"), "")
