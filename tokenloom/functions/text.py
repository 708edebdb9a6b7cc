"""Column expressions for text fields.

All of them are built-in Spark SQL expressions, so they stay inside
whole-stage codegen and run next to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------
# Characters Python's ``str.strip()`` / ``str.isspace()`` treat as white
# space (Unicode White_Space plus the four ASCII separators U+001C-U+001F):
#   U+0009 U+000A U+000B U+000C U+000D U+001C U+001D U+001E U+001F U+0020
#   U+0085 U+00A0 U+1680 U+2000..U+200A U+2028 U+2029 U+202F U+205F U+3000
# Written with \x{...} escapes, which Java regex and RE2 read the same way.
PY_WHITESPACE_CLASS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Java's ASCII ``\s`` set, spelt out so DuckDB/RE2 (whose ``\s`` lacks
# U+000B) splits the same way: U+0009 U+000A U+000B U+000C U+000D U+0020.
TOKEN_SPACE_CLASS = r"\x{09}-\x{0D}\x{20}"
# Runs of letters/digits, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + TOKEN_SPACE_CLASS + r"]"
NONBLANK_PATTERN = r"[^" + PY_WHITESPACE_CLASS + r"]"
# -----------------------------------------------------------------------


def text_fallback_col(columns: list[str], fields=("text", "content")) -> Column:
    """First present, non-null field of ``fields``, else ''."""
    present = [F.col(f) for f in fields if f in columns]
    return F.coalesce(*present, F.lit("")) if present else F.lit("")


def nonblank_col(text: Column | str) -> Column:
    """True when ``text.strip()`` would be non-empty (text kept as is)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(NONBLANK_PATTERN), F.lit(False))


def tokens_col(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Text -> ARRAY<STRING> of tokens, in text order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(pattern), 0)
