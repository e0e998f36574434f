"""The same scalar functions as DuckDB SQL snippets, for the oracles."""

from __future__ import annotations

from quillmark.functions import text as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def normalize(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{T.SPACE}]+', ' ', 'g'))"


def keywords(x: str) -> str:
    """Distinct keywords in ascending order: DuckDB keeps no order among distinct list entries."""
    stop = ", ".join(map(lit, T.STOP_WORDS))
    return f"list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(lower({x}), '{T.LATIN_TOKEN}'), regexp_extract_all({x}, '\\p{{Han}}{{2,6}}')), lambda k: NOT list_contains([{stop}], k))))"


def numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '\\b\\d+(?:\\.\\d+)?%?\\b')))"


def statements(x: str) -> str:
    cut = f"regexp_replace({x}, '([.!?])[{T.SPACE}]+', '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({cut}, '\\r?\\n|[。；;]'), lambda s: {normalize('s')}), lambda s: length(s) >= 4)"


def excerpt(x: str, most: int = 80) -> str:
    n = normalize(x)
    return f"(CASE WHEN length({n}) <= {most} THEN {n} ELSE substr({n}, 1, {most - 1}) || '…' END)"


def stable_id(prefix: str, x: str) -> str:
    units = f"flatten(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c)::BIGINT - 65536) // 1024, 56320 + (unicode(c)::BIGINT - 65536) % 1024] END))"
    folded = f"list_reduce(list_prepend({T.FNV_OFFSET}::BIGINT, {units}), lambda h, c: (xor(h, c) * {T.FNV_PRIME}) % 4294967296)"
    return f"('{prefix}_' || lower(to_base({folded}, 36)))"


def method(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i)(?:{T.METHOD_WORDS})[{T.SPACE}]*[^，,。.;；]+'), '')"


def half_up(x: str, digits: int = 0) -> str:
    scale = float(10**digits)
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def answer_length(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '[A-Za-z0-9]+')) + ceil(len(regexp_extract_all({x}, '\\p{{Han}}')) / 2.0))::INTEGER"
