"""The stemmer (T3) as a list of regular expressions, for the DuckDB twins only.

The library's stemmer (``functions/stem.py``) strips one word at a time by its
vowels and consonants; here the same algorithm is spelt as replacements over all
tokens of a text, joined by line feeds, in the regex features that RE2 has.
Neither uses the other, so a green row compares two ways of stating the rules.

Tokens are lower-case, so upper-case letters serve as marks: ``Y`` is a y that
counts as a consonant, ``S`` stands between a stem and the step's suffix, ``P``
there if the stem has the measure, ``T`` before a word that lost ``ed`` or
``ing``, ``U`` before one with a doubled consonant, ``X`` after a word that is
done with this step, ``Z`` after one that is done altogether.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The rule tables and the irregular forms of the algorithm.
# ---------------------------------------------------------------------------
UNCHANGED = "sky news inning outing canning howe proceed exceed succeed"
STEP2 = {
    "ate": "ational ation ator", "tion": "tional", "ence": "enci", "ance": "anci", "ize": "izer ization",
    "ble": "bli biliti", "al": "alli alism aliti", "ent": "entli", "e": "eli", "ous": "ousli ousness",
    "ive": "iveness iviti", "ful": "fulness fulli", "log": "logi",
}
STEP3 = {"ic": "icate iciti ical", "al": "alize", "": "ative ful ness"}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
DOUBLED = "bcdfghjkmnpqrtvwx0123456789àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
# ---------------------------------------------------------------------------

A, V, C, K = r"[^\n]", "[aeiouy]", r"[^aeiouy\n]", r"[^aeiouywxY\n]"
M1 = f"{C}*{V}+{C}"            # a stem that begins so has measure 1 or more
M2 = f"{C}*{V}+{C}+{V}+{C}"    # measure 2 or more


def _either(words: str) -> str:
    """One pattern for a list of words that tries each first letter once: ``ate able`` is ``a(?:te|ble)``."""
    heads: dict[str, list[str]] = {}
    for w in words.split():
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, tails in heads.items():
        rest = _either(" ".join(t for t in tails if t))
        parts.append(head + (f"(?:{rest})" if rest else "") + ("?" if rest and "" in tails else ""))
    return "|".join(parts)


def _suffix_step(measure: str, rules: dict[str, str]) -> list[tuple[str, str]]:
    """Longest suffix of a step: S before it, P where the stem has the measure; then P and the suffix become the new ending."""
    steps = [(f"({_either(' '.join(rules.values()))})$", "S$1"), (f"^({measure}{A}*)S", "$1P")]
    return steps + [(f"P(?:{_either(old)})$", new) for new, old in rules.items()] + [("[SP]", "")]


def stem_steps() -> list[tuple[str, str]]:
    """``(pattern, replacement)`` pairs in order; patterns are multi-line, ``$1`` is the first group."""
    doubled = "|".join(c + c for c in DOUBLED)
    step2 = _suffix_step(M1, STEP2)
    step4 = _suffix_step(M2, {"": " ".join(s for s in STEP4.split() if s != "ion")})
    return [
        (f"^({A}{{1,2}})$", "$1Z"), (f"^({_either(UNCHANGED)})$", "$1Z"), ("^(inning|outing|canning)s$", "$1Z"),
        ("^skies$", "skyZ"), ("^([dlt])ying$", "$1ieZ"),
        ("^y", "Y"), (f"({V})y", "$1Y"),
        # 1a
        (f"^({A})ies$", "$1ieX"), ("sses$", "ssX"), ("ies$", "iX"), ("ss$", "ssX"), ("s$", ""), ("X$", ""),
        # 1b
        (f"^({A})ied$", "$1ieX"), ("ied$", "iX"), (f"^({M1}{A}*)eed$", "$1eeX"), ("eed$", "eedX"),
        (f"^({C}*{V}{A}*)(?:ed|ing)$", "T$1"), (f"^T({A}*(?:at|bl|iz))$", "$1eX"),
        (f"^T({A}*(?:{doubled}))$", "U$1"), (f"^U({A}*){A}$", "$1X"), (f"^T({A}*(?:ll|ss|zz))$", "$1X"),
        (f"^T({C}+{V}{K}|{V}{C})$", "$1eX"), ("^T", ""), ("X$", ""),
        # 1c
        (f"^({A}+{C})y$", "$1i"),
        # 2: first the rule that the others run after; then the one whose l counts as the stem's
        (f"^({M1}{A}*)alli$", "$1al"), step2[0], (f"^({C}*{V}+(?:{C}{A}*)?)Slogi$", "$1log"), *step2[1:],
        # 3
        *_suffix_step(M1, STEP3),
        # 4: ion only after s or t
        (f"({_either(STEP4)})$", "S$1"), step4[1], ("([st])Pion$", "$1"), *step4[2:],
        # 5a, 5b
        (f"^({M2}{A}*)e$", "$1X"), (f"^({A}*{C}{V}{K}e|{V}{C}e)$", "$1X"), (f"^({M1}{C}*{V}*)e$", "$1X"), ("X$", ""),
        (f"^({C}*{V}+{C}+{V}+(?:{C}{A}*)?l)l$", "$1"),
        ("Z$", ""),
    ]
