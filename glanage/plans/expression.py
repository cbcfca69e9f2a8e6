"""Boolean expressions over terms: ``renard ∧ ¬ repas``, ``bouc and tromper or fromage``.

NOT binds before AND, AND before OR; there are no parentheses, and terms side
by side without operator are alternatives. An expression is a disjunction of
conjunctions, which is all that evaluation needs.
"""

from __future__ import annotations

from dataclasses import dataclass

NOT, AND, OR = {"¬", "not", "non"}, {"∧", "and", "et"}, {"∨", "or", "ou"}


@dataclass(frozen=True)
class Literal:
    term: str
    positive: bool = True


Disjunction = tuple[tuple[Literal, ...], ...]


def parse(expression: str) -> Disjunction:
    """The conjunctions of an expression; empty for a blank one. Raises ValueError where an operator lacks its term."""
    tokens = expression.lower().replace("¬", " ¬ ").split()
    groups: list[list[Literal]] = []
    joined, positive = False, True  # joined: the next term belongs to the last group
    expects = False
    for t in tokens:
        if t in NOT:
            positive, expects = not positive, True
        elif t in AND or t in OR:
            if expects or not groups:
                raise ValueError(f"no term before {t!r} in {expression!r}")
            joined, expects = t in AND, True
        else:
            literal = Literal(t, positive)
            if joined:
                groups[-1].append(literal)
            else:
                groups.append([literal])
            joined, positive, expects = False, True, False
    if expects:
        raise ValueError(f"no term at the end of {expression!r}")
    return tuple(tuple(g) for g in groups)


def terms(expression: Disjunction) -> list[str]:
    return sorted({x.term for g in expression for x in g})
