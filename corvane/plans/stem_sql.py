"""The Porter stemmer as SQL over a table of words, for the SQL of stemmed queries."""

from __future__ import annotations

from corvane.functions.porter import STEP2, STEP3, STEP4


def _shape(x: str) -> str:
    """x as a string of C (consonant) and V (vowel); y goes by the letter before it."""
    s = f"regexp_replace(regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[b-df-hj-np-tv-xz]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
    return s


def _measure(x: str) -> str:
    return f"((length({x}) - length(replace({_shape(x)}, 'VC', ''))) // 2)"


def _cut(n: int, x: str = "s") -> str:
    return f"left({x}, length({x}) - {n})"


def _cvc(x: str) -> str:
    return f"({_shape(x)} LIKE '%CVC' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _swap(rules: list[tuple[str, str]]) -> str:
    cases = [f"WHEN ends_with(s, '{end}') THEN CASE WHEN {_measure(_cut(len(end)))} > 0 THEN {_cut(len(end))} || '{put}' ELSE s END" for end, put in sorted(rules, key=lambda r: -len(r[0]))]
    return f"CASE {' '.join(cases)} ELSE s END"


def stems(words: str) -> str:
    """CTEs that end in stem (w, s), for the column w of the table `words`."""
    vowel = lambda x: f"contains({_shape(x)}, 'V')"
    last = "right(s, 1)"
    drop = " ".join(f"WHEN ends_with(s, '{end}') THEN CASE WHEN {_measure(_cut(len(end)))} > 1{f' AND right({_cut(len(end))}, 1) IN (chr(115), chr(116))' if end == 'ion' else ''} THEN {_cut(len(end))} ELSE s END" for end in sorted(STEP4, key=len, reverse=True))
    steps = [
        f"CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN {_cut(2)} WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN {_cut(1)} ELSE s END",
        # what lost -ed or -ing is marked by a full stop until the next step
        f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE s END WHEN ends_with(s, 'ed') AND {vowel(_cut(2))} THEN {_cut(2)} || '.' WHEN ends_with(s, 'ing') AND {vowel(_cut(3))} THEN {_cut(3)} || '.' ELSE s END",
        f"CASE WHEN NOT ends_with(s, '.') THEN s ELSE (SELECT CASE WHEN right(s, 2) IN ('at', 'bl', 'iz') THEN s || 'e' WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND {_shape('s')} LIKE '%C' AND {last} NOT IN ('l', 's', 'z') THEN {_cut(1)} WHEN {_measure('s')} = 1 AND {_cvc('s')} THEN s || 'e' ELSE s END FROM (SELECT {_cut(1, 'p.s')} AS s)) END",
        f"CASE WHEN ends_with(s, 'y') AND {vowel(_cut(1))} THEN {_cut(1)} || 'i' ELSE s END",
        _swap(STEP2),
        _swap(STEP3),
        f"CASE {drop} ELSE s END",
        f"CASE WHEN ends_with(s, 'e') AND ({_measure(_cut(1))} > 1 OR ({_measure(_cut(1))} = 1 AND NOT {_cvc(_cut(1))})) THEN {_cut(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {_measure(_cut(1))} > 1 THEN {_cut(1)} ELSE s END",
    ]
    out = [f"porter0 AS (SELECT DISTINCT w, w AS s FROM {words} WHERE regexp_full_match(w, '[a-z][a-z][a-z]+'))"]
    out += [f"porter{i} AS (SELECT p.w, {step} AS s FROM porter{i - 1} p)" for i, step in enumerate(steps, 1)]
    out.append(f"stem AS (SELECT w, s FROM porter{len(steps)} UNION ALL SELECT DISTINCT w, w FROM {words} WHERE NOT regexp_full_match(w, '[a-z][a-z][a-z]+'))")
    return ", ".join(out)
