"""Queries of the cleaning operators."""

from __future__ import annotations

from ..functions import fixed
from ..operators import cleaning as op
from ..sources import samples
from . import query
from .sql import squeeze, strip, text, with_views

WORD = r"[\p{L}\p{N}_]"


# the cleaning steps as DuckDB expressions
def d_chars(x):
    return rf"replace(translate({x}, chr(12)||chr(61623)||chr(8226)||chr(160), '    '), chr(13), chr(10))"


def d_runs(x):
    return rf"regexp_replace(regexp_replace({x}, '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g')"


def _d_lines(x, drop):
    blank = f"{strip('x')} = ''"
    return (f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda x: {blank} OR NOT ({drop})), "
            f"lambda x: CASE WHEN {blank} THEN '' ELSE x END), chr(10))")


_NOISE = f"regexp_matches({strip('x')}, {text('(?:' + '|'.join(fixed.NOISE_LINES) + ')')}, 'i')"
_ADDRESS = (f"(length({strip('x')}) > 120 AND contains(x, ',') AND regexp_matches({strip('x')}, "
            f"{text(fixed.ADDRESS_HINT)}, 'i'))")


def d_noise(x):
    return _d_lines(x, _NOISE)


def d_address(x):
    return _d_lines(x, _ADDRESS)


def d_noise_address(x):
    return _d_lines(x, f"{_NOISE} OR {_ADDRESS}")


def d_identity(x):
    for p in fixed.IDENTITY_PHRASES:
        x = f"regexp_replace({x}, {text(p)}, '', 'gi')"
    return x


def d_numeric(x):
    x = f"regexp_replace({x}, {text(fixed.NUMERIC_NOISE[0])}, '', 'gi')"
    return rf"regexp_replace({x}, '\b\d[\d,]*[.,](?:\s*([^\d\s]|$)|\s*(\s))', '\1\2', 'g')"


def d_hyphen(x):
    return rf"regexp_replace({x}, '({WORD})-\s*\n\s*({WORD})', '\1\2', 'g')"


def d_spaces(x):
    return (rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), "
            rf"'\n +', chr(10), 'g')")


def d_headings(x):
    h = f"regexp_replace(trim(x, ' :-'||chr(9)), '\\s+', ' ', 'g')"
    n = rf"len(regexp_extract_all({h}, '\S+'))"
    starts = " OR ".join(f"starts_with(lower({h}), '{w} ')" for w in fixed.HEADING_STARTS)
    test = (f"{h} <> '' AND NOT ({n} BETWEEN 13 AND 99) AND right({h}, 1) NOT IN ('.', ';', ',') AND "
            rf"((upper({h}) = {h} AND regexp_matches({h}, '\p{{L}}')) OR {starts} OR "
            f"regexp_full_match({h}, {text(fixed.NUMBERED_CAPS_HEADING)}))")
    kept = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda x: {strip('x')} = '' OR NOT ({test})), chr(10))"
    return strip(rf"regexp_replace({kept}, '\n{{3,}}', chr(10)||chr(10), 'g')")


def d_repeats(x):
    return (f"array_to_string(list_filter(string_split({x}, chr(10)), lambda x, i: i = 1 OR {squeeze('x')} = '' OR "
            f"lower({squeeze('x')}) <> lower({squeeze(f'string_split({x}, chr(10))[i-1]')})), chr(10))")


def d_merge(x):
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: {strip('x')}), chr(10))"
    x = rf"regexp_replace(regexp_replace({x}, '^\n+', ''), '\n{{3,}}', chr(10)||chr(10), 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([^\n])\n(\p{{Ll}})', '\1 \2', 'g')"
    return x


def d_tidy(x):
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10)||chr(10), 'g')"
    x = rf"regexp_replace({x}, '\s+([,.;:!?])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([,.;:!?])({WORD})', '\1 \2', 'g')"
    return rf"regexp_replace({x}, '([.?!]){{2,}}', '\1', 'g')"


def chain(source, *steps):
    """Nested selects, one step per level."""
    q = f"SELECT doc_id, coalesce(text, '') AS text FROM {source}"
    for s in steps:
        q = f"SELECT doc_id, {s('text')} AS text FROM ({q})"
    return q


def _docs(step):
    return lambda spark, d: step(samples.documents(spark, d))


def _contracts(step):
    return lambda spark, d: step(samples.contract_text(spark, d).select("doc_id", "text"))


for _name, _op, _d in [
    ("replace_chars_b1", op.replace_chars, d_chars), ("split_ocr_runs_b2", op.split_ocr_runs, d_runs),
    ("drop_address_lines_b4", op.drop_address_lines, d_address),
    ("strip_numeric_noise_b6", op.strip_numeric_noise, d_numeric), ("join_hyphenated_b7", op.join_hyphenated, d_hyphen),
    ("squeeze_spaces_b8", op.squeeze_spaces, d_spaces), ("drop_repeated_lines_b10", op.drop_repeated_lines, d_repeats),
    ("merge_continuations_b11", op.merge_continuations, d_merge),
    ("tidy_punctuation_b12", op.tidy_punctuation, d_tidy), ("flatten_spaces_b15", op.flatten_spaces, squeeze),
]:
    query(_name, chain("documents", _d))(_docs(_op))

for _name, _op, _d in [
    ("drop_noise_lines_b3", op.drop_noise_lines, d_noise),
    ("strip_identity_phrases_b5", op.strip_identity_phrases, d_identity),
    ("drop_headings_b9", op.drop_headings, d_headings),
    ("drop_repeated_contract_lines_b10", op.drop_repeated_lines, d_repeats),
    ("merge_contract_continuations_b11", op.merge_continuations, d_merge),
    ("join_contract_hyphens_b7", op.join_hyphenated, d_hyphen),
]:
    query(_name, with_views("contract_text", chain("contract_text", _d)))(_contracts(_op))

SUMMARY_STEPS = [d_chars, d_runs, d_noise, d_hyphen, d_spaces, d_repeats, d_merge, d_tidy, strip]
_DATA_STEPS = [d_chars, d_runs, d_noise_address, d_identity, d_numeric, d_hyphen, d_spaces, d_headings, d_repeats,
               d_merge, d_tidy, strip]
query("clean_documents_b13", chain("documents", *SUMMARY_STEPS))(
    _docs(lambda df: op.clean_text(df, for_summarization=True)))
query("clean_contracts_b13", with_views("contract_text", chain("contract_text", *_DATA_STEPS)))(
    _contracts(lambda df: op.clean_text(df, for_summarization=False)))
query("clean_contracts_for_summary_b13", with_views("contract_text", chain("contract_text", *SUMMARY_STEPS)))(
    _contracts(lambda df: op.clean_text(df, for_summarization=True)))


@query("word_count_b14", rf"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\s\x{{A0}}]+'), lambda x: regexp_matches(x, '{WORD}'))) AS BIGINT) AS word_count
FROM documents""")
def word_count(spark, d):
    return op.word_count(samples.documents(spark, d)).drop("text")


@query("signature_text_b16", f"""
SELECT doc_id, {squeeze("regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g')")} AS text FROM documents""")
def signature_text(spark, d):
    return op.signature_text(samples.documents(spark, d), ["text"])


@query("brief_b17", rf"""
SELECT doc_id, CASE WHEN t = '' THEN {text(fixed.BRIEF_DEFAULT_RISK)} ELSE array_to_string(list_filter(string_split(
  regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:2], ' ') END AS brief
FROM (SELECT doc_id, {squeeze(f"regexp_replace(regexp_replace(text, {text(fixed.BRIEF_LABELS[0])}, '', 'gi'), {text(fixed.BRIEF_LABELS[1])}, '', 'gi')")} AS t
      FROM documents)""")
def brief(spark, d):
    return op.brief(samples.documents(spark, d), fixed.BRIEF_DEFAULT_RISK).select("doc_id", "brief")


