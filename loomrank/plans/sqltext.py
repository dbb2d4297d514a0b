"""Text rules as SQL for the twins of queries."""

from __future__ import annotations

from loomrank.functions import text as T


def sql_mentions(x: str, word: str) -> str:
    return rf"regexp_matches(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"


def sql_digits(x: str) -> str:
    for word, n in T.NUMBER_WORDS.items():
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_-]){word}(\s*[-–]?\s*)(month|week|term)', '\1{n}\2\3', 'gi')"
    return x
