"""Character classes, once for Java regular expressions and once for Python's, and their exact meaning."""

# Unicode White_Space, and the scripts that count as CJK.
WHITE_SPACE = "\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
CJK_JAVA = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
CJK_PYTHON = "\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}"
STRIP = "".join(map(chr, (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Default delimiters.
SENTENCE_DELIMITERS = ("。", "！", "？", ".", "!", "?")
FAST_DELIMITERS = ("\n\n", "\r\n", "\n", "\r", "。", "！", "？", ". ", "? ", "! ", ".", "?", "!", " ", "\t")
PARAGRAPHS, CLAUSES = ("\n\n", "\r\n", "\n", "\r"), ("，", "；", ",", ";", ":")
