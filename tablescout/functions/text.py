"""Text expressions: keywords, LIKE escaping, truncation, SQL text rules, error text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning in a catalog question.
STOP_WORDS = [
    "где", "найти", "какая", "какой", "какие", "таблица", "таблицы",
    "структура", "схема", "скрипт", "напиши", "покажи", "дай",
    "нужен", "нужна", "по", "для", "в", "на", "из", "с", "и",
    "или", "а", "но", "не", "это", "есть", "как", "что", "кто",
    "запрос", "данные",
]

# Statements that change data or rights, for the query guard ...
WRITE_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE",
    "EXEC", "EXECUTE", "GRANT", "REVOKE", "MERGE",
]
# ... and the shorter list used when finished runs are scored.
SCORED_WRITE_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE"]

# Patterns of the row cap and of error texts.
CAPPED_SELECT = r"^\s*SELECT\s+TOP\s+(\d+)\s+"
SELECT_START = r"^\s*SELECT\s+"
CAP_PLACE = r"^(\s*SELECT\s+)(?:TOP\s+\d+\s+)?"
RATE_LIMIT_MARKS = ["429", "rate limit", "too many requests", "ratelimit"]
RETRY_AFTER = r"retry.?after[:\s]+([0-9]+(?:\.[0-9]+)?)"
SECONDS = r"([0-9]+(?:\.[0-9]+)?)\s*s(?:ec(?:onds?)?)?"

# White space as str.strip() sees it: the Unicode property plus the four separators.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _words_pattern(words: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(words) + r")\b"


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keywords(question: Column) -> Column:
    """Search words of a question; the whole question when none is left."""
    marks = "?," + _SPACES
    tokens = F.split(F.translate(F.lower(question), marks, " " * len(marks)), " ")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(question)))


def escape_like(value: Column) -> Column:
    """Make ``/ % _`` literal for ``LIKE ... ESCAPE '/'``."""
    return F.regexp_replace(value, "([/%_])", "/$1")


def truncate(text: Column, limit: int = 600) -> Column:
    """Trim; beyond ``limit`` characters cut there, trim again and mark the cut."""
    body = strip_ends(text)
    cut = F.concat(
        F.regexp_replace(F.substring(body, 1, limit), rf"(?U){_SPACE}+$", ""), F.lit(" …")
    )
    return F.when(F.length(body) <= limit, body).otherwise(cut)


def write_words(sql: Column, words: list[str] | None = None) -> Column:
    """Sorted distinct write statements found as whole words, any case."""
    return F.array_sort(F.array_distinct(F.transform(all_write_words(sql, words), F.upper)))


def all_write_words(sql: Column, words: list[str] | None = None) -> Column:
    """Write statements found as whole words, any case, as often and as they stand."""
    return F.regexp_extract_all(sql, F.lit(_words_pattern(words or WRITE_WORDS)), F.lit(1))


def has_write_word(sql: Column, words: list[str] | None = None) -> Column:
    return sql.rlike(_words_pattern(words or WRITE_WORDS))


def own_row_cap(sql: Column) -> Column:
    """The N of a leading ``SELECT TOP N``, else NULL."""
    return F.regexp_extract(sql, "(?iU)" + CAPPED_SELECT, 1).try_cast("decimal(38,0)")


def needs_row_cap(sql: Column, limit: int) -> Column:
    """True where a statement starting with SELECT has no TOP or one above the limit."""
    own = own_row_cap(sql)
    return F.coalesce(sql.rlike("(?iU)" + SELECT_START) & (own.isNull() | (own > limit)), F.lit(False))


def with_row_cap(sql: Column, limit: int) -> Column:
    """Statement text with ``TOP limit`` put in (or lowered) where the cap is needed."""
    capped = F.regexp_replace(sql, "(?iU)" + CAP_PLACE, f"$1TOP {limit} ")
    return F.when(needs_row_cap(sql, limit), capped).otherwise(sql)


def is_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    hit = F.lit(False)
    for mark in RATE_LIMIT_MARKS:
        hit = hit | low.contains(mark)
    return F.coalesce(hit, F.lit(False))


def retry_after(message: Column) -> Column:
    """Seconds to wait named in an error text, by the loose rule."""
    named = F.regexp_extract(message, "(?i)" + RETRY_AFTER, 1)
    loose = F.regexp_extract(message, "(?i)" + SECONDS, 1)
    return F.coalesce(named.try_cast("double"), loose.try_cast("double"))


def retry_after_strict(message: Column) -> Column:
    """Same, but a bare number counts only when its unit is a whole word."""
    named = F.regexp_extract(message, "(?i)" + RETRY_AFTER, 1)
    unit = F.regexp_extract(message, "(?i)" + SECONDS + r"\b", 1)
    return F.coalesce(named.try_cast("double"), unit.try_cast("double"))


def blank_concat(*parts: Column) -> Column:
    """Parts joined by single blanks, NULL read as empty text."""
    out = []
    for i, part in enumerate(parts):
        if i:
            out.append(F.lit(" "))
        out.append(F.coalesce(part.cast("string"), F.lit("")))
    return F.concat(*out)


def format_type(data_type: Column, char_max_length: Column, precision: Column, scale: Column) -> Column:
    """``varchar(255)``, ``nvarchar(MAX)``, ``decimal(18,2)`` or the bare name."""
    sized = F.concat(data_type, F.lit("("), char_max_length, F.lit(")"))
    numeric = F.concat(
        data_type, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")
    )
    return (
        F.when(F.length(char_max_length) > 0, sized)
        .when(data_type.isin("decimal", "numeric") & (precision > 0), numeric)
        .otherwise(data_type)
    )


def char_length_text(data_type: Column, max_length: Column) -> Column:
    """Declared bytes to printed length: -1 is MAX, two-byte types are halved."""
    return (
        F.when(max_length == -1, F.lit("MAX"))
        .when(data_type.isin("nvarchar", "nchar"), F.floor(max_length / 2).cast("string"))
        .when(data_type.isin("varchar", "char", "varbinary", "binary"), max_length.cast("string"))
    )
