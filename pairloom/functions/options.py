"""Rules of options that exclude or need each other, for values at hand and as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (kind, options, message): `one` wants exactly one of them, `most` one at most, `needs` the second where the first is given.
Rule = tuple[str, tuple[str, ...], str]

IDENTITY: list[Rule] = [
    ("one", ("fasta", "structures"), "give either --fasta or --structures"),
    ("most", ("against", "against_structures"), "--against and --against-structures exclude each other"),
    ("needs", ("window_step", "window_size"), "--window-step needs --window-size"),
]


def _broken(rule: Rule, given):
    """Whether the rule is broken; given maps an option to 0 or 1, as a number or a column."""
    kind, names, _ = rule
    if kind == "needs":
        return given(names[0]) > given(names[1])
    total = sum((given(n) for n in names[1:]), given(names[0]))
    return total != 1 if kind == "one" else total > 1


def problem(rules: list[Rule], given: set[str]) -> str | None:
    """The first broken rule's message."""
    return next((r[2] for r in rules if _broken(r, lambda n: int(n in given))), None)


def problem_column(rules: list[Rule], given: dict[str, Column]) -> Column:
    """The first broken rule's message by row; given has a boolean column for each option."""
    return F.coalesce(*[F.when(_broken(r, lambda n: given[n].cast("int")), r[2]) for r in rules])
