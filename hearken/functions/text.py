"""Text normalisation, predicates and character n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white space characters, as a regex class body.
# Java's \s knows only the ASCII ones.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE_CHARS}]+"
NOT_SPACE = f"[^{SPACE_CHARS}]"

# Fixed value: token limit of the emotion model.
MAX_TOKENS = 128


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Lowercase, white space runs to one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), SPACES, " "))


def one_blank(lowered: str | None) -> str:
    """``clean_text`` of a lower-cased text, inside tasks: ``split`` cuts at the same characters."""
    return " ".join((lowered or "").split())


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(_col(c), rf"\A{SPACES}|{SPACES}\z", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(_col(c).rlike(NOT_SPACE), F.lit(False))


def filter_languages(df: DataFrame, langs: list[str] | None = None, col: str = "lang") -> DataFrame:
    return df.where(F.col(col).isin(langs)) if langs else df


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(~is_blank(col))


def split_valid(df: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with text, and the rest with a ``reason``."""
    reason = F.when(F.col(col).isNull(), "missing").otherwise("blank")
    return df.where(~is_blank(col)), df.where(is_blank(col)).withColumn("reason", reason)


def cut_from(c: Column | str, opening: str = "<img") -> Column:
    """Drop the rest of the line from the literal ``opening`` on.

    ``(?d)`` makes LF the only line end, so a CR does not stop the cut.
    """
    return F.regexp_replace(_col(c), rf"(?d)\Q{opening}\E.*", "")


def contains(c: Column | str, literal: str) -> Column:
    return _col(c).contains(literal)


def text_length(c: Column | str) -> Column:
    """Length in code points."""
    return F.char_length(_col(c))


def tidy_reply(c: Column | str) -> Column:
    """Strip white space, then double quotes, then single quotes, at both ends."""
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def char_ngrams(c: Column | str, low: int = 1, high: int = 5) -> Column:
    """All overlapping character n-grams, shortest size first.

    The look-ahead captures n characters while the match eats one, so the cost
    is linear in the text; substring by position would be quadratic for
    multi-byte text.
    """
    sizes = [
        F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        for n in range(low, high + 1)
    ]
    return F.flatten(F.array(*sizes))


def words(c: Column | str) -> Column:
    """Blank-separated words of the normalised text; none for blank text."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != "")


def truncate_tokens(c: Column | str, limit: int = MAX_TOKENS) -> Column:
    """First ``limit`` words of the normalised text."""
    return F.array_join(F.slice(F.split(clean_text(c), " "), 1, limit), " ")


def word_pattern(lexicon: list[str]) -> str:
    r"""Pattern for any entry as a whole word or phrase of normalised text.

    Java and RE2 read it alike: no \b, no look-around.
    """
    edge = r"[^\p{L}\p{N}_]"
    special = set("\\^$.|?*+()[]{}")
    entries = "|".join(
        "".join("\\" + ch if ch in special else ch for ch in entry.lower()) for entry in lexicon
    )
    return f"(?:^|{edge})(?:{entries})(?:{edge}|$)"
