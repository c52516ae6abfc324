"""Text cleaning as column expressions: the whole text stays in its row, so no stage here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import BLANKS, bind, contains_any, count_matches, squeeze, strip

_SPACES = BLANKS.replace("\n", "")


# A pass of a pattern over a whole text is what cleaning costs. Patterns start with their rarest character, match only
# what they change, and run only on texts that hold a piece they need.
def _where(c: Column, pieces: list[str], change) -> Column:
    """``change(text)`` for texts holding one of ``pieces``, others as they are."""
    return bind(c, lambda t: F.when(contains_any(t, pieces), change(t)).otherwise(t))


def _strip_text(c: Column, chars: str = BLANKS) -> Column:
    """``strip`` for long texts, which looks at every character even if there is nothing to strip."""
    ends = lambda t: F.left(t, F.lit(1)).isin(*chars) | F.right(t, F.lit(1)).isin(*chars)
    return bind(c, lambda t: F.when(ends(t), strip(t, chars)).otherwise(t))


def _holds_word(t: Column, words: list[str]) -> Column:
    """Whether a word occurs, case ignored as a pattern does it."""
    return bind(F.upper(t), lambda up: contains_any(up, [w.upper() for w in words]))


def replace_chars(c: Column) -> Column:
    return reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), zip(*fixed.REPLACED_CHARS), c)


def split_ocr_runs(c: Column) -> Column:
    c = F.regexp_replace(c, r"\d(?<=[A-Za-z]\d)", " $0")
    return F.regexp_replace(c, r"\d(?=[A-Za-z])", "$0 ")


# Line rules are matched on the whole text ("\n" put in front, so that every line
# starts with one): a scan for line breaks costs a fraction of splitting into an
# array and testing each line.
_GAP = r"[^\S\n]"
_WIDE_GAP = r"(?U)\s{2,}|(?! )\s"  # within a line, all white space that is not one blank


def _delete_lines(c: Column, pattern: str) -> Column:
    """Delete lines whose trimmed text matches ``pattern``; a line of blanks only becomes empty."""
    text = F.regexp_replace(F.concat(F.lit("\n"), c), rf"(?iU)\n{_GAP}*(?:{pattern}){_GAP}*(?=\n|\z)", "")
    return F.substring(F.regexp_replace(text, rf"(?U)\n{_GAP}+(?=\n|\z)", "\n"), 2, 2 ** 31 - 1)


_NOISE = "|".join(p.removeprefix(r"^\s*").removesuffix("$").removesuffix(r"\s*").replace(r"\s", _GAP)
                  .replace(".*", r"[^\n]*") for p in fixed.NOISE_LINES)
_ADDRESS = (rf"(?=\S[^\n]{{{fixed.ADDRESS_MIN_CHARS - 2},}}\S)(?=[^\n]*,)(?=[^\n]*{fixed.ADDRESS_HINT})[^\n]*")


def drop_noise_lines(c: Column) -> Column:
    return _delete_lines(c, _NOISE)


def drop_address_lines(c: Column) -> Column:
    return _delete_lines(c, _ADDRESS)


def drop_noise_and_address_lines(c: Column) -> Column:
    return bind(c, lambda t: F.when(_holds_word(t, fixed.ADDRESS_WORDS), _delete_lines(t, f"{_NOISE}|{_ADDRESS}"))
                .otherwise(drop_noise_lines(t)))


def strip_identity_phrases(c: Column) -> Column:
    def remove(text: Column) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, "(?iU)" + p, ""), fixed.IDENTITY_PHRASES, text)
    return bind(c, lambda t: F.when(_holds_word(t, fixed.IDENTITY_WORDS), remove(t)).otherwise(t))


def strip_numeric_noise(c: Column) -> Column:
    currency, trailing = fixed.NUMERIC_NOISE
    c = F.regexp_replace(c, f"(?=[{fixed.CURRENCY_STARTS}])(?iU){currency}", "")
    return F.regexp_replace(c, r"(?U)(?=\d)" + trailing, "")


def join_hyphenated(c: Column) -> Column:
    return bind(c, lambda t: F.when(t.rlike(r"(?U)-\s*\n"), F.regexp_replace(
        t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")).otherwise(t))


def squeeze_spaces(c: Column) -> Column:
    c = _where(c, ["  ", "\t"], lambda t: F.regexp_replace(t, r"[ \t]{2,}|\t", " "))
    c = _where(c, [" \n"], lambda t: F.regexp_replace(t, r" +\n", "\n"))
    return _where(c, ["\n "], lambda t: F.regexp_replace(t, r"\n +", "\n"))


def is_heading_line(line: Column) -> Column:
    """Heading test on one raw line; blank lines are not headings. Most lines end like a sentence or start like none and
    are told by that alone."""
    def test(text: Column) -> Column:
        all_caps = (F.upper(text) == text) & text.rlike(r"\p{L}")
        start = F.lower(F.left(text, F.lit(8)))
        named = reduce(lambda a, b: a | b, [start.startswith(w + " ") for w in fixed.HEADING_STARTS])
        numbered = text.rlike("^(?:" + fixed.NUMBERED_CAPS_HEADING + ")$")
        return ((F.length(text) > 0) & ~F.right(text, F.lit(1)).isin(".", ";", ",") & (all_caps | named | numbered)
                & ~count_matches(text, r"\S+").between(13, 99))

    def likely(text: Column) -> Column:
        start = F.lower(F.left(text, F.lit(8)))
        named = reduce(lambda a, b: a | b, [start.startswith(w) for w in fixed.HEADING_STARTS])
        digit = F.left(text, F.lit(1)).between("0", "9")
        return ~F.right(text, F.lit(1)).isin(".", ";", ",") & (digit | named | (F.upper(text) == text))

    return bind(strip(line, " :-\t"), lambda t: F.when(likely(t), bind(F.regexp_replace(t, r"(?U)\s+", " "), test))
                .otherwise(F.lit(False)))


def drop_headings(c: Column) -> Column:
    open_end = lambda x: (F.length(x) > 0) & ~F.right(x, F.lit(1)).isin(".", ";", ",")
    lines = F.filter(F.split(c, "\n"), lambda x: ~(open_end(x) & is_heading_line(x)) | (F.length(strip(x)) == 0))
    return _strip_text(_short_gaps(F.array_join(lines, "\n")))


def _short_gaps(c: Column) -> Column:
    """At most one empty line at a time."""
    return _where(c, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def drop_repeated_lines(c: Column) -> Column:
    """Drop a line equal to the one before it, ignoring case and spacing; a blank line resets the comparison. Lines are folded
    only where their first characters agree."""
    def first(x: Column) -> Column:
        return F.lower(F.left(x, F.lit(1)))

    def differ(x: Column, y: Column) -> Column:
        return first(x).between("!", "~") & first(y).between("!", "~") & (first(x) != first(y))

    def keep(x: Column, before: Column) -> Column:
        key = lambda line: F.btrim(F.regexp_replace(F.lower(line), _WIDE_GAP, " "))
        return (F.length(x) == 0) | (F.length(before) == 0) | differ(x, before) | bind(
            key(x), lambda k: (F.length(k) == 0) | (k != key(before)))

    return F.array_join(bind(F.split(c, "\n"), lambda xs: F.filter(xs, lambda x, i: (i == 0) | keep(x, F.get(xs, i - 1)))), "\n")


def merge_continuations(c: Column) -> Column:
    """Trim lines, collapse blank runs, and pull a line starting lower-case up to the line before it."""
    c = bind(c, lambda t: F.when(t.rlike(rf"(?U)\n(?<={_GAP}\n)"), F.regexp_replace(t, rf"(?U){_GAP}+(?=\n)", "")).otherwise(t))
    c = F.regexp_replace(c, rf"(?U)\n{_GAP}+", "\n")
    c = _short_gaps(F.ltrim(_strip_text(c, _SPACES), F.lit("\n")))
    return F.regexp_replace(c, r"\n(?<=[^\n]\n)(?=\p{IsLowercase})", " ")


def tidy_punctuation(c: Column) -> Column:
    c = F.regexp_replace(_short_gaps(c), r"(?U)\s+(?=[,.;:!?])", "")
    c = F.regexp_replace(c, r"(?U)[,.;:!?](?=\w)", "$0 ")
    return F.regexp_replace(c, r"[.?!]+([.?!])", "$1")


def clean_text(c: Column, for_summarization: bool = False) -> Column:
    """All cleaning steps in order; a blank or missing text becomes ''."""
    text = split_ocr_runs(replace_chars(c))
    if for_summarization:
        text = drop_noise_lines(text)
    else:
        text = strip_numeric_noise(strip_identity_phrases(drop_noise_and_address_lines(text)))
    text = squeeze_spaces(join_hyphenated(text))
    if not for_summarization:
        text = drop_headings(text)
    text = _strip_text(tidy_punctuation(merge_continuations(drop_repeated_lines(text))))
    blank = F.left(c, F.lit(1)).isin("", *BLANKS) & (F.length(strip(c)) == 0)
    return F.when(c.isNull() | blank, "").otherwise(text)


def flatten_spaces(c: Column) -> Column:
    return squeeze(c)


def signature_text(c: Column) -> Column:
    lowered = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s]", " ")
    return squeeze(lowered)


def brief(c: Column, default: str = "") -> Column:
    """Remove boilerplate labels, squeeze, keep the first two sentences."""
    text = reduce(lambda t, p: F.regexp_replace(t, "(?i)" + p, ""), fixed.BRIEF_LABELS, F.coalesce(c, F.lit("")))
    text = squeeze(text)
    two = F.array_join(F.slice(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0), 1, 2), " ")
    return F.when(F.length(text) == 0, F.lit(default)).otherwise(two)


