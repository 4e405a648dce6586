"""Tokens that need a reading of their own, with their places."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# What counts as a special token, by family.
_TERM = "a-zA-Zα-ωΑ-Ω0-9²³⁴⁰¹⁵⁶⁷⁸⁹√Δ∑∏()"
_OPERATOR = "+\\-−×÷=≠≈≡≤≥±∓/"
_TELLING = "²³⁴⁰¹⁵⁶⁷⁸⁹√±∓×÷≠≈≡≤≥Δ∑∏="
SYMBOLS = "²³⁴⁵⁶⁷⁸⁹⁰¹√∛∜±∓×÷≠≈≡≤≥≪≫∞∝∂∇∆Δ∑∏∫∬∮αβγδεζηθικλμνξπρσςτυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΠΡΣΤΥΦΧΨΩℵℝℤℚℕℂ∈∉⊂⊃⊆⊇∪∩∅∧∨¬⊕⊗→←↔⇒⇐⇔↑↓°′″℃℉"
SIGNS = r"[#\$\&\*@~\^\\|{}[\]]"
ABBREVIATION = r"\b[A-Z][A-Za-z]*\.[A-Z][A-Za-z]*(?:\.[A-Z][A-Za-z]*)*\b|\b[A-Z]{2,}(?:[a-z]+[A-Z]+[a-z]*)*\b"
CODE = r"\b(?:[A-Za-z]+[-.]?\d+[A-Za-z0-9.]*|\d+[.]\d+[A-Za-z]+)\b"
# End of the fixed values.

#: A term begins where no term goes on before it, and takes all of itself, so each text is read once.
EXPRESSION = rf"(?<![{_TERM}])[{_TERM}]++(?:\s*+[{_OPERATOR}]\s*+[{_TERM}]++)+"
FAMILIES = [(kind, re.compile(p)) for kind, p in (("expression", EXPRESSION), ("symbol", f"[{SYMBOLS}]+"), ("abbreviation", ABBREVIATION), ("code", CODE), ("sign", SIGNS))]
_TELLS = re.compile(f"[{_TELLING}]")
TOKENS = "array<struct<token:string,kind:string,start:int,end:int>>"


def special_spans(text: str) -> list[tuple[str, str, int, int]]:
    """(token, kind, start, end) of the runs that the families cover, in order.

    Spans that overlap or touch are one token, whose kind names its families in their order.
    An expression counts only if it has a sign that plain text lacks.
    """
    found = []
    for k, (kind, pattern) in enumerate(FAMILIES):
        if kind == "expression" and not _TELLS.search(text):
            continue
        found += [(m.start(), -m.end(), k) for m in pattern.finditer(text) if kind != "expression" or _TELLS.search(m[0])]
    runs: list[list] = []
    for start, stop, k in sorted(found):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], -stop)
            runs[-1][2].add(k)
        else:
            runs.append([start, -stop, {k}])
    return [(text[a:b], "+".join(FAMILIES[k][0] for k in sorted(kinds)), a, b) for a, b, kinds in runs]


def special_tokens(text: Column) -> Column:
    """Array of (token, kind, start, end), offsets in characters from 0; null gives null, an empty text an empty array."""

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        names = ("token", "kind", "start", "end")
        return texts.map(lambda t: None if t is None else [dict(zip(names, s)) for s in special_spans(t)])

    return run(text)
