"""The text functions as SQL expressions, for checking results with another engine."""

from __future__ import annotations

from daftar.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def _case(table: dict, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {x} END"


def normalize_text(x: str) -> str:
    out = f"translate(coalesce(cast({x} AS varchar), ''), {q(''.join(T.URDU_LETTERS) + T.URDU_SILENT)}, {q(''.join(T.URDU_LETTERS.values()))})"
    for letter, pair in T.URDU_PAIRS.items():
        out = f"replace({out}, {q(letter)}, {q(pair)})"
    a, b = T.single_lowers()
    out = f"regexp_replace(translate({out}, {q(a)}, {q(b)}), '\\p{{Mn}}+', '', 'g')"
    out = f"replace(lower({out}), '&', ' and ')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\\s./-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def split(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def name_tokens(norm: str) -> str:
    """From normalized text."""
    raw = f"list_transform({split(f'replace({norm}, chr(46), chr(32))')}, lambda w, i: {{'w': regexp_replace(w, '^[-/]+|[-/]+$', '', 'g'), 'i': i}})"
    kept = f"list_filter({raw}, lambda s: s.w <> '' AND s.w NOT IN {_list(T.HONORIFICS)} AND NOT (s.i = 1 AND s.w IN {_list(T.LEADING_TITLES)}))"
    return f"list_transform({kept}, lambda s: {_case(T.NAME_ALIASES, 's.w')})"


def normalize_address(norm: str) -> str:
    return f"list_aggregate(list_transform({split(norm)}, lambda w: {_case(T.ADDRESS_WORDS, 'w')}), 'string_agg', ' ')"


def normalize_phone(x: str) -> str:
    digits = f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
    local = f"(CASE WHEN starts_with({digits}, '92') AND length({digits}) >= 12 THEN '0' || {digits}[3:] ELSE {digits} END)"
    return f"(CASE WHEN length({local}) >= 11 THEN right({local}, 11) ELSE {local} END)"


def clean_number(x: str) -> str:
    return f"coalesce(try_cast(regexp_replace(coalesce(cast({x} AS varchar), ''), '[^0-9.]', '', 'g') AS double), 0.0)"


def city_hint(addr: str) -> str:
    whens = " ".join(f"WHEN contains({addr}, {q(c)}) THEN {q(c)}" for c in T.CITIES)
    return f"CASE {whens} ELSE coalesce(({split(addr)})[-1], '') END"


def address_block(addr: str) -> str:
    return f"coalesce(list_aggregate((list_filter({split(addr)}, lambda w: regexp_matches(w, '[0-9]') OR length(w) > 2))[1:4], 'string_agg', ' '), '')"


def alias_tokens(tokens: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]" for k, v in T.TOKEN_EQUIVALENTS.items())
    return f"list_distinct(flatten(list_transform({tokens}, lambda w: CASE w {whens} ELSE [w] END)))"


def joined(items: str) -> str:
    return f"coalesce(list_aggregate({items}, 'string_agg', ' '), '')"


def phonetic_code(w: str) -> str:
    base = f"replace(translate({w}, 'qczv', 'kksw'), 'x', 'ks')"
    kept = f"({base}[1:1] || regexp_replace({base}[2:], '[aeiouhwy]', '', 'g'))"
    return f"list_aggregate(list_filter(list_transform(string_split({kept}, ''), lambda c, i: CASE WHEN i > 1 AND c = {kept}[i-1:i-1] THEN '' ELSE c END), lambda c: c <> ''), 'string_agg', '')"
