"""English stems by Porter's algorithm (1980), from its published rules."""

from __future__ import annotations

VOWELS = "aeiou"
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in VOWELS or (c == "y" and k and out[k - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return sum(a == "v" and b == "c" for a, b in zip(_form(stem), _form(stem)[1:], strict=False))


def _short(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str, lang: str = "en") -> str:
    if lang not in ("en", "english"):
        raise ValueError(f"no stemmer for {lang}")
    w = word.lower()
    if len(w) < 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _form(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _form(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end, new = max(((e, n) for e, n in table if w.endswith(e)), key=lambda p: len(p[0]), default=("", ""))
        if end and _measure(w[: len(w) - len(end)]) > 0:
            w = w[: len(w) - len(end)] + new
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default="")
    if end and _measure(w[: len(w) - len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
