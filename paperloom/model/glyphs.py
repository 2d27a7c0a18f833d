"""Glyph names to characters, by rule where names are built from parts."""

from __future__ import annotations

import re
import unicodedata

#: Names of single characters that no rule below gives.
NAMES = dict(
    pair.split("=")
    for pair in (
        "exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/ colon=: semicolon=; "
        "less=< greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=] asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ exclamdown=¡ cent=¢ sterling=£ "
        "currency=¤ yen=¥ section=§ copyright=© registered=® trademark=™ ordfeminine=ª ordmasculine=º guillemotleft=« guillemotright=» logicalnot=¬ degree=° plusminus=± mu=µ paragraph=¶ "
        "periodcentered=· questiondown=¿ multiply=× divide=÷ AE=Æ ae=æ OE=Œ oe=œ Oslash=Ø oslash=ø Lslash=Ł lslash=ł Eth=Ð eth=ð Thorn=Þ thorn=þ germandbls=ß dotlessi=ı bullet=• endash=– emdash=— "
        "quoteleft=‘ quoteright=’ quotedblleft=“ quotedblright=” quotesinglbase=‚ quotedblbase=„ guilsinglleft=‹ guilsinglright=› ellipsis=… dagger=† daggerdbl=‡ perthousand=‰ fraction=⁄ florin=ƒ "
        "Euro=€ minus=− fi=ﬁ fl=ﬂ ff=ﬀ onehalf=½ onequarter=¼ threequarters=¾ brokenbar=¦"
    ).split()
) | {"equal": "=", "space": " ", "nbspace": " "}
#: Accents that letters' names end in.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def character(name: str) -> str | None:
    """What a glyph name stands for; null if it isn't known. A suffix after a point is left out, parts joined by _ are ligatures."""
    name = name.split(".")[0] or name
    if not name:
        return None
    if "_" in name.strip("_"):
        parts = [character(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    if len(name) == 1:
        return name
    if name in NAMES:
        return NAMES[name]
    if name in DIGITS:
        return str(DIGITS.index(name))
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if name[1:] in ACCENTS and name[0].isalpha():
        own = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return own if len(own) == 1 else None
    try:  # Greek letters are called by their own names
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {'LAMDA' if name.lower() == 'lambda' else name.upper()}")
    except KeyError:
        return None
