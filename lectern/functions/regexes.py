"""Portable regular expressions: the same meaning in Java's engine and in RE2.

``\\w``, ``\\s`` and ``\\b`` mean different characters in different engines, so
none of them is used bare; these are Unicode letters, numbers and the underscore,
and Unicode white space.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"
#: The characters of ``SPACE``.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = r"[^\s\p{Z}\x{85}\x{1C}-\x{1F}]"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]"
#: A word with the marks and joiners that its letters carry.
MARKED_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_\x{200C}\x{200D}]*"
#: Viramas that link the consonants of a conjunct (Devanagari, Bengali, Gujarati, Oriya, Telugu, Malayalam), and those consonants.
LINKER = r"[\x{94D}\x{9CD}\x{ACD}\x{B4D}\x{C4D}\x{D4D}]"
CONSONANT = r"[\x{915}-\x{939}\x{958}-\x{95F}\x{978}-\x{97F}\x{995}-\x{9B9}\x{9DC}\x{9DD}\x{9DF}\x{9F0}\x{9F1}\x{A95}-\x{AB9}\x{AF9}\x{B15}-\x{B39}\x{B5C}\x{B5D}\x{B5F}\x{B71}\x{C15}-\x{C39}\x{C58}-\x{C5A}\x{D15}-\x{D3A}]"
#: Spark only: an extended grapheme cluster; one that ends in a linker takes the next consonant's cluster in.
CLUSTER = rf"\X(?:(?<={CONSONANT}[\p{{M}}\x{{200D}}]{{0,8}})(?<={LINKER}[\p{{M}}\x{{200D}}]{{0,8}})(?={CONSONANT})\X)*"
DIGIT = r"\p{Nd}"
LINE = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: A lower-case letter that begins a word, or an upper-case one that goes on with it.
NOT_TITLE = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
#: Characters that broken font encodings leave in place of Indic text, and those scripts themselves.
WEIRD = r"[\x{A2}-\x{AC}\x{AE}-\x{24F}\x{2C6}\x{201A}\x{201E}\x{2020}\x{2021}\x{2026}\x{2030}\x{2039}\x{203A}\x{2122}\x{FFFD}]"
INDIC = r"[\x{0A80}-\x{0AFF}\x{0900}-\x{097F}]"
#: Only for text whose white space is single blanks.
SENTENCE = r"(?<=[.!?।॥])\s+"
BULLET = rf"^([-*•·–—]|{DIGIT}+[.)]|[a-zA-Z][.)]){SPACE}+"
NUMBERED = rf"^(chapter{SPACE}+)?{DIGIT}+(\.{DIGIT}+)*[:.)-]?{SPACE}+"
LEADING_NUMBER = rf"^({DIGIT}+(\.{DIGIT}+)*)"
TABLE_ROW = rf"[|\t]|{SPACE}{{3,}}"
ANY_NUMBER = rf"(^|{NOT_WORD}){DIGIT}+({NOT_WORD}|$)"


def whole_word(pattern: str) -> str:
    """``pattern`` where it stands as a word of its own."""
    return f"(^|{NOT_WORD})({pattern})({NOT_WORD}|$)"
