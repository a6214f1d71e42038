"""Text functions as Column builders; every pattern uses ASCII word edges and Unicode white space."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word edge, since \b of Java knows other letters.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Where a sentence ends.
SENTENCE_END = "(?<=[.?!…][\"'”’]?)(?U)\\s+"
TERMINAL = "[.?!…][\"'”’]?(?U)\\s*$"


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is worked out once however often it stands in it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _plain(ch: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, ch) if not 0x300 <= ord(c) <= 0x36F)


def _folds(form: str, wanted) -> tuple[str, str, dict[str, str]]:
    """Characters that a normal form without combining marks turns into another one, and into several, by rule."""
    one_from, one_to, several = [], [], {}
    for code in range(0xA0, 0x1FC00):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or 0x300 <= code < 0x370 or not unicodedata.decomposition(ch):
            continue
        plain = _plain(ch, form)
        if plain != ch and wanted(plain):
            if len(plain) == 1:
                one_from.append(ch), one_to.append(plain)
            else:
                several[ch] = plain
    return "".join(one_from), "".join(one_to), several


def _class(chars) -> str:
    """A character class of few ranges, since each is tried on every character."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in ranges) + "]"


#: Compatibility forms of ASCII letters, digits and apostrophes; all others end as spaces anyway.
FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _folds("NFKD", lambda t: re.search("[A-Za-z0-9']", t))
MARKED_FROM, MARKED_TO, _ = _folds("NFD", lambda t: len(t) == 1)
BEYOND_ASCII = r"[^\x00-\x7F]"
COMBINING = r"[\x{300}-\x{36F}]"
#: Two ranges that hold all characters of FOLD_SEVERAL, and hardly any letter of the languages written in Latin.
MAYBE_SEVERAL = rf"[\x{{{min(map(ord, (c for c in FOLD_SEVERAL if c < 'À')), default=0x100):X}}}-\x{{BF}}\x{{100}}-\x{{10FFFF}}]"


def fold(c: Column) -> Column:
    """Compatibility forms as ASCII letters and digits, without combining marks; text in plain ASCII is left as it is at once."""
    table = F.map_from_arrays(F.split(F.lit("\x01".join(FOLD_SEVERAL)), "\x01"), F.split(F.lit("\x01".join(FOLD_SEVERAL.values())), "\x01"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    # the second class has many ranges, each tried on every character, so the first one spares most lines of it
    single = F.when(c.rlike(MAYBE_SEVERAL) & c.rlike(_class(FOLD_SEVERAL)), spelled).otherwise(c)
    return F.when(c.rlike(BEYOND_ASCII), F.regexp_replace(F.translate(single, FOLD_FROM, FOLD_TO), COMBINING, "")).otherwise(c)


def without_marks(c: Column) -> Column:
    """Letters without their combining marks; other forms stay."""
    return F.when(c.rlike(BEYOND_ASCII), F.regexp_replace(F.translate(c, MARKED_FROM, MARKED_TO), COMBINING, "")).otherwise(c)


#: ASCII that separates words, which a translation turns into spaces far faster than a pattern.
SEPARATORS = "".join(chr(k) for k in range(1, 128) if not re.match("[A-Za-z0-9' ]", chr(k)))


def spaced(c: Column) -> Column:
    """Lower-case text as words of letters, digits and apostrophes between single spaces."""
    plain = F.translate(c, "‘’" + SEPARATORS, "''" + " " * len(SEPARATORS))
    plain = F.when(plain.rlike(r"[^\x01-\x7F]"), F.regexp_replace(plain, r"[^\x01-\x7F]", " ")).otherwise(plain)
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def normalize(c: Column) -> Column:
    """Lower-case ASCII words and apostrophes, single spaces."""
    return spaced(F.lower(fold(c)))


def tokens_of_normal(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda x: x != "")


def tokenize(c: Column) -> Column:
    return tokens_of_normal(normalize(c))


def index_tokens(norm: Column) -> Column:
    """Tokens as a token index stores them: apostrophes separate too."""
    return F.array_distinct(F.filter(F.split(norm, "[^a-z0-9]+"), lambda x: x != ""))


def needles(norm: Column) -> Column:
    """Query tokens, split at apostrophes, of two characters or more."""
    return F.filter(F.split(norm, "[' ]"), lambda x: F.length(x) >= 2)


def quote_key(c: Column) -> Column:
    """Normal form for quotations: no accent folding, so accented letters become spaces."""
    return spaced(F.lower(c))


def title_key(c: Column) -> Column:
    """Title without case, punctuation, spaces and articles; 'X, The' counts as 'The X'."""
    t = F.regexp_replace(F.trim(F.lower(c)), "&", " and ")
    t = F.regexp_replace(t, r"^(.*),\s*(the|a|an)$", "$2 $1")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.replace(F.regexp_replace(t, "^(the|a|an) ", ""), F.lit(" "), F.lit(""))


def title_variants(c: Column) -> Column:
    """Spellings to try for a title, in order, without repeats, of two characters or more."""
    short = F.trim(F.substring_index(c, ":", 1))
    spellings = F.array(c, short, F.replace(c, F.lit("&"), F.lit("and")), F.replace(c, F.lit("'"), F.lit("")), without_marks(c), without_marks(short))
    return F.array_distinct(F.filter(F.transform(spellings, lambda x: F.trim(x)), lambda x: F.length(x) >= 2))


def words_of(c: Column) -> Column:
    """Words between runs of white space, with an empty first one where the text begins with some."""
    return F.split(c, r"(?U)\s+")


def capital_share(words: Column) -> Column:
    """Share of the words after the first that open with a capital."""
    later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))
    return F.size(F.filter(later, lambda w: w.rlike("^[A-Z]"))) / F.greatest(F.size(words) - 1, F.lit(1))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Over sets; `empty` where both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def clip(c: Column, limit: int = 220) -> Column:
    """Cut at the last space within the limit, with dots; without a space the last character goes."""
    head = F.substring(c, 1, limit)
    kept = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(F.substring(head, 1, limit - 1))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(kept, F.lit("...")))


def excerpt(c: Column, lines: int = 3, limit: int = 220) -> Column:
    return clip(F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n"), limit)


def moment_text(c: Column, most: int = 4) -> Column:
    """Non-blank lines; if there are too many, the first ones and an ellipsis."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most - 1), F.array(F.lit("…")))).otherwise(lines), "\n")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")


def input_hash(texts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of all texts, each ended by a newline."""
    return F.substring(F.sha2(F.concat(F.array_join(texts, "\n"), F.lit("\n")), 256), 1, 16)


def has_terminal(c: Column) -> Column:
    return c.rlike(TERMINAL)


def ocr_hits(c: Column) -> Column:
    """Marks of misread letters, over four patterns; each is tried only where its rare letters stand, and those with an edge look for their letter first."""
    alone = "l(?<![A-Za-z0-9_]l)"
    patterns = (("I", "[a-z]I[a-z]"), ("l", alone + "(?![A-Za-z0-9_])"), ('"', '[a-z]"[a-z]'), ("l'", alone + "'(?:m|ll|ve|d|re|s)(?![A-Za-z0-9_])"))
    found = [F.when(c.contains(rare), F.regexp_count(c, F.lit(p))).when(c.isNotNull(), 0) for rare, p in patterns]
    return sum(found[1:], found[0])


#: ASCII that separates words of small letters and apostrophes.
NO_LETTERS = "".join(chr(k) for k in range(1, 128) if not re.match("[a-z']", chr(k)))


def small_words(c: Column) -> Column:
    """Runs of a-z and apostrophes in the lower-case text."""
    plain = F.translate(F.lower(c), NO_LETTERS, " " * len(NO_LETTERS))
    plain = F.when(plain.rlike(r"[^\x01-\x7F]"), F.regexp_replace(plain, r"[^\x01-\x7F]+", " ")).otherwise(plain)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def is_music(c: Column) -> Column:
    return c.rlike("[♪#]")


def is_quote_wrapped(c: Column) -> Column:
    return F.trim(c).rlike('^["“][^"”]+["”]$')


def parse_window_id(c: Column) -> Column:
    """'film:start-end' as a struct; a malformed id is an error."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d+)-(\d+)$", k).cast("int")
    wrong = F.raise_error(F.concat(F.lit("malformed window id: "), c))
    return F.when(c.rlike(r"^\d+:\d+-\d+$"), F.struct(part(1).alias("movie_id"), part(2).alias("start_seq"), part(3).alias("end_seq"))).when(c.isNotNull(), wrong)


def prompt_version(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^promptVersion:\s*(\d+)", 1).cast("int")


def reply_json(c: Column) -> Column:
    """The JSON part of a reply, fenced or bare."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    return F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
