"""Letters and digits of mathematics: plain ones to the alphanumeric symbols of a style."""

from __future__ import annotations

# Fixed values of Unicode: where each alphabet's capital A, small a and zero stand (None: it has none).
ALPHABETS = {
    "bold": (0x1D400, 0x1D41A, 0x1D7CE), "italic": (0x1D434, 0x1D44E, None), "bold-italic": (0x1D468, 0x1D482, 0x1D7CE), "script": (0x1D49C, 0x1D4B6, None), "bold-script": (0x1D4D0, 0x1D4EA, 0x1D7CE),
    "fraktur": (0x1D504, 0x1D51E, None), "double-struck": (0x1D538, 0x1D552, 0x1D7D8), "bold-fraktur": (0x1D56C, 0x1D586, 0x1D7CE), "sans": (0x1D5A0, 0x1D5BA, 0x1D7E2), "sans-bold": (0x1D5D4, 0x1D5EE, 0x1D7EC),
    "sans-italic": (0x1D608, 0x1D622, 0x1D7E2), "sans-bold-italic": (0x1D63C, 0x1D656, 0x1D7EC), "monospace": (0x1D670, 0x1D68A, 0x1D7F6),
}
# Fixed values of Unicode: letters that stood elsewhere before these alphabets did.
ELSEWHERE = {
    ("italic", "h"): 0x210E, ("script", "B"): 0x212C, ("script", "E"): 0x2130, ("script", "F"): 0x2131, ("script", "H"): 0x210B, ("script", "I"): 0x2110, ("script", "L"): 0x2112, ("script", "M"): 0x2133,
    ("script", "R"): 0x211B, ("script", "e"): 0x212F, ("script", "g"): 0x210A, ("script", "o"): 0x2134, ("fraktur", "C"): 0x212D, ("fraktur", "H"): 0x210C, ("fraktur", "I"): 0x2111, ("fraktur", "R"): 0x211C,
    ("fraktur", "Z"): 0x2128, ("double-struck", "C"): 0x2102, ("double-struck", "H"): 0x210D, ("double-struck", "N"): 0x2115, ("double-struck", "P"): 0x2119, ("double-struck", "Q"): 0x211A, ("double-struck", "R"): 0x211D, ("double-struck", "Z"): 0x2124,
}
#: Greek: capital alpha to omega and small alpha to omega of the styles that have them.
GREEK = {"bold": (0x1D6A8, 0x1D6C2), "italic": (0x1D6E2, 0x1D6FC), "bold-italic": (0x1D71C, 0x1D736), "sans-bold": (0x1D756, 0x1D770), "sans-bold-italic": (0x1D790, 0x1D7AA)}


def letter(character: str, style: str) -> str:
    """The symbol, or the character itself if the style has none for it."""
    if (style, character) in ELSEWHERE:
        return chr(ELSEWHERE[style, character])
    capital, small, zero = ALPHABETS[style]
    c = ord(character)
    if "A" <= character <= "Z":
        return chr(capital + c - 65)
    if "a" <= character <= "z":
        return chr(small + c - 97)
    if "0" <= character <= "9" and zero:
        return chr(zero + c - 48)
    if style in GREEK and 0x391 <= c <= 0x3A9 and c != 0x3A2:
        return chr(GREEK[style][0] + c - 0x391)
    if style in GREEK and 0x3B1 <= c <= 0x3C9:
        return chr(GREEK[style][1] + c - 0x3B1)
    return character


def spelled(text: str, style: str | None = "italic") -> str:
    return text if style is None else "".join(letter(c, style) for c in text)
