"""Building blocks of the DuckDB check queries: the derived views as CTEs and a few generated expressions."""

from __future__ import annotations

from ..sources import samples as s

_VIEWS = {
    "contract_text": (s.CONTRACT_TEXT, []),
    "flat_text": (s.FLAT_TEXT.replace("{g}", ", 'g'"), ["contract_text"]),
    "mentions": (s.MENTIONS, ["flat_text"]),
    "jobs": (s.JOBS, []),
    "questions": (s.QUESTIONS, []),
    "responses": (s.RESPONSES, []),
    "risks": (s.RISKS, []),
}


def view(name: str, query: str, needs: list[str] | None = None) -> None:
    """Register one more CTE for ``with_views``."""
    _VIEWS[name] = (query, needs or [])


def with_views(names: str | list[str], query: str) -> str:
    """``query`` preceded by the named views and all they need."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in order:
            for m in _VIEWS[n][1]:
                add(m)
            order.append(n)

    for n in names.split() if isinstance(names, str) else names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][0]})" for n in order) + "\n" + query


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


STRIP = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"


def strip(expr: str) -> str:
    return f"trim({expr}, {STRIP})"


def squeeze(expr: str) -> str:
    return strip(rf"regexp_replace({expr}, '[\s\x{{A0}}]+', ' ', 'g')")


def any_of(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(w)})" for w in words) + ")"


def ieee_round(x: str) -> str:
    """Two digits by exact binary value, ties to even; the same error term as the Spark expression."""
    prod, head = f"(({x})*100.0)", f"((({x})*134217729.0)-((({x})*134217729.0)-({x})))"
    err = f"((({head})*100.0-{prod})+(({x})-{head})*100.0)"
    rest = f"({prod}-floor({prod}))"
    return (f"((floor({prod}) + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {err} > 0) OR ({rest} = 0.5 AND {err} = 0 "
            f"AND floor({prod}) % 2 = 1) THEN 1.0 ELSE 0.0 END)/100.0)")


