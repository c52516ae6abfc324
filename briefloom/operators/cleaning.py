"""Cleaning operators: DataFrame in, DataFrame with the text column rewritten (or a new column added) out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..functions.columns import word_count as count_words


def _rewrite(fn):
    def operator(df: DataFrame, text: str = "text") -> DataFrame:
        return df.withColumn(text, fn(F.col(text)))
    operator.__name__ = fn.__name__
    operator.__doc__ = fn.__doc__
    return operator


replace_chars = _rewrite(c.replace_chars)
split_ocr_runs = _rewrite(c.split_ocr_runs)
drop_noise_lines = _rewrite(c.drop_noise_lines)
drop_address_lines = _rewrite(c.drop_address_lines)
strip_identity_phrases = _rewrite(c.strip_identity_phrases)
strip_numeric_noise = _rewrite(c.strip_numeric_noise)
join_hyphenated = _rewrite(c.join_hyphenated)
squeeze_spaces = _rewrite(c.squeeze_spaces)
drop_headings = _rewrite(c.drop_headings)
drop_repeated_lines = _rewrite(c.drop_repeated_lines)
merge_continuations = _rewrite(c.merge_continuations)
tidy_punctuation = _rewrite(c.tidy_punctuation)
flatten_spaces = _rewrite(c.flatten_spaces)


def clean_text(df: DataFrame, for_summarization: bool = False, text: str = "text") -> DataFrame:
    return df.withColumn(text, c.clean_text(F.col(text), for_summarization))


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("word_count", count_words(F.col(text)).cast("long"))


def signature_text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({name: c.signature_text(F.col(name)) for name in cols})


def brief(df: DataFrame, default: str = "", text: str = "text") -> DataFrame:
    return df.withColumn("brief", c.brief(F.col(text), default))
