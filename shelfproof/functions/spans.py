"""Match positions and readable quotes, without leaving the JVM.

Splitting a text at a pattern gives the gaps between its matches; together
with the list of matches the gaps give every match position.

The expressions are deep and are asked for once per rule, so they are written
as SQL text: ``text`` arguments are SQL, such as a column name or a lambda
variable, and each result is parsed once.  Lambda variables here start with
``q_``, so that they do not hide a column of the caller.
"""

from __future__ import annotations

from shelfproof.functions.values import sql_literal

# How far a quote may reach, and the German/English words that
# negate the phrase directly behind or before them.
QUOTE_MAX = 180
NEGATED_BEFORE = (r"(?iU)\b(?:non|nicht|nie|kaum|kein(?:e[nmrs]?)?|ohne|no|not|without"
                  r"|free\s+(?:of|from)|frei\s+von)[\s\-‐-―]*$")
NEGATED_AFTER = r"(?iU)^[\s\-‐-―]*(?:frei|free)\b"

SPAN = "struct<lo: int, hi: int>"


def let(x: str, name: str, body: str) -> str:
    """Bind ``x`` to a lambda variable and use it several times in ``body``."""
    return f"get(transform(array({x}), {name} -> {body}), 0)"


def matches(text: str, pattern: str) -> str:
    return f"coalesce({text} rlike {sql_literal(pattern)}, false)"


def _steps(text: str, pattern: str) -> str:
    """Per match, the length of the gap before it and its own length."""
    hits = f"regexp_extract_all({text}, {sql_literal(pattern)}, 0)"
    return (f"zip_with(slice(split({text}, {sql_literal(pattern)}, -1), 1, size({hits})), {hits},"
            " (q_gap, q_hit) -> named_struct('gap', length(q_gap), 'size', length(q_hit)))")


def _steps_beside(text: str, pattern: str) -> str:
    """As ``_steps``, and the text beside each match: back over the match before it, on over the next one.

    Only the gaps next to a match are looked at, so all matches together cost no more than the text is long.
    """
    step = ("named_struct('gap', length(get(q_parts, q_i)), 'size', length(q_hit),"
            " 'before', concat(right(coalesce(get(q_parts, q_i - 1), ''), 1), coalesce(get(q_hits, q_i - 1), ''),"
            " get(q_parts, q_i)),"
            " 'after', concat(coalesce(get(q_parts, q_i + 1), ''), coalesce(get(q_hits, q_i + 1), ''),"
            " left(coalesce(get(q_parts, q_i + 2), ''), 1)))")
    return let(f"split({text}, {sql_literal(pattern)}, -1)", "q_parts", let(
        f"regexp_extract_all({text}, {sql_literal(pattern)}, 0)", "q_hits", f"transform(q_hits, (q_hit, q_i) -> {step})"))


def spans(text: str, pattern: str) -> str:
    """Every match as ``STRUCT<lo, hi>`` in characters, zero-based."""
    return (f"aggregate({_steps(text, pattern)},"
            f" named_struct('at', 0, 'found', cast(array() as array<{SPAN}>)),"
            " (q_acc, q_step) -> named_struct('at', q_acc.at + q_step.gap + q_step.size, 'found', concat(q_acc.found, array("
            "named_struct('lo', q_acc.at + q_step.gap, 'hi', q_acc.at + q_step.gap + q_step.size)))), q_acc -> q_acc.found)")


def first_span(text: str, pattern: str, affirmative: bool = False, exclude: str | None = None) -> str:
    """First accepted match as ``STRUCT<lo, hi>``, NULL when there is none.

    A rejected match does not end the search.  ``affirmative`` rejects a match
    with a negation right beside it, ``exclude`` one that overlaps a match of
    another pattern.
    """
    p = sql_literal(pattern)
    if not affirmative and exclude is None:
        found = (f"named_struct('lo', regexp_instr({text}, {p}) - 1, 'hi',"
                 f" regexp_instr({text}, {p}) - 1 + length(regexp_extract({text}, {p}, 0)))")
    else:
        lo, hi = "(q_acc.at + q_step.gap)", "(q_acc.at + q_step.gap + q_step.size)"
        tests = []
        if affirmative:
            tests += [f"not {matches('q_step.before', NEGATED_BEFORE)}", f"not {matches('q_step.after', NEGATED_AFTER)}"]
        if exclude is not None:
            tests.append(f"not exists(q_banned, q_ban -> {lo} < q_ban.hi and {hi} > q_ban.lo)")
        ok = " and ".join(tests)
        steps = _steps_beside(text, pattern) if affirmative else _steps(text, pattern)
        found = (f"aggregate({steps}, named_struct('at', 0, 'lo', -1, 'hi', -1),"
                 f" (q_acc, q_step) -> if(q_acc.lo >= 0, q_acc, named_struct('at', {hi},"
                 f" 'lo', if({ok}, {lo}, -1), 'hi', if({ok}, {hi}, -1))),"
                 " q_acc -> if(q_acc.lo >= 0, named_struct('lo', q_acc.lo, 'hi', q_acc.hi), null))")
        if exclude is not None:
            found = let(spans(text, exclude), "q_banned", found)
    return f"if({matches(text, pattern)}, {found}, cast(null as {SPAN}))"


def quote(text: str, span: str) -> str:
    """The sentence around a span, or a window of it when the sentence is long."""
    before = f"substr({text}, 1, {span}.lo)"
    mark = sql_literal(r"(?s)^(.*)(?:\. |! |\? |; | \| | - )")
    left = f"if({before} rlike {mark}, length(regexp_extract({before}, {mark}, 1)) + 1, 0)"
    # One character of context: the sentence mark may be the match's last one.
    sentence = sql_literal(r"(?U)(?<=[.!?;])\s+")
    tail = f"regexp_instr(substr({text}, greatest({span}.hi, 1)), {sentence})"
    right = let(tail, "q_tail", f"if(q_tail > 0, greatest({span}.hi, 1) + q_tail - 2, length({text}))")
    edges = let(f"named_struct('l', {left}, 'r', {right})", "q_edge", (
        f"if(q_edge.r - q_edge.l > {QUOTE_MAX}, named_struct('l', greatest(q_edge.l, {span}.lo - {QUOTE_MAX // 2}),"
        f" 'r', least(q_edge.r, {span}.hi + {QUOTE_MAX // 2})), q_edge)"))
    ends = sql_literal(r"(?U)^\s+|\s+$")
    blank = sql_literal(r"(?U)^\s+$")
    body = f"regexp_replace(substr({text}, q_cut.l + 1, q_cut.r - q_cut.l), {ends}, '')"
    shown = let(body, "q_body", (
        f"if(length(q_body) < length({text}), concat(if(q_cut.l > 0 and not substr({text}, 1, q_cut.l) rlike {blank}, '…', ''), q_body,"
        f" if(q_cut.r < length({text}), '…', '')), q_body)"))
    return let(edges, "q_cut", shown)


def quoted_match(text: str, pattern: str, affirmative: bool = False, exclude: str | None = None) -> str:
    """Quote around the first accepted match, NULL without one."""
    found = let(first_span(text, pattern, affirmative, exclude), "q_match",
                f"if(q_match is null, null, {quote(text, 'q_match')})")
    return f"if({matches(text, pattern)}, {found}, cast(null as string))"
