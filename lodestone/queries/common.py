from __future__ import annotations

from ..sources.shared import table  # noqa: F401


#: DuckDB's form of the tokenizer. RE2 has no look-behind and the same classes.
CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


def tokens_sql(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), '{CJK}+')"
    grams = "list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))"
    return f"list_concat(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.\\-][a-z0-9]+)*'), flatten(list_transform({runs}, lambda r: {grams})))"


#: White space at both ends, as Python has it, for ASCII and the blanks of the fixtures.
def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
