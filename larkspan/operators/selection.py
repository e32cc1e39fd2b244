"""An algebra of node selections: facts combined by | & - ^ ~, compiled to one filter."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selection:
    """A predicate with two truth values: what is unknown isn't selected, and its complement is."""

    def __init__(self, test: Callable[[DataFrame], Column]) -> None:
        self.test = test

    def of(self, nodes: DataFrame) -> DataFrame:
        return nodes.filter(self.test(nodes))

    def pick(self, nodes: DataFrame) -> list[str]:
        """The selected names, by id and name."""
        return [r["name"] for r in self.of(nodes).orderBy(F.coalesce("id", F.lit(0)), "name").select("name").collect()]

    def __and__(self, o: Selection) -> Selection:
        return Selection(lambda d: self.test(d) & o.test(d))

    def __or__(self, o: Selection) -> Selection:
        return Selection(lambda d: self.test(d) | o.test(d))

    def __sub__(self, o: Selection) -> Selection:
        return Selection(lambda d: self.test(d) & ~o.test(d))

    def __xor__(self, o: Selection) -> Selection:
        return Selection(lambda d: self.test(d) != o.test(d))

    def __invert__(self) -> Selection:
        return Selection(lambda d: ~self.test(d))


def node(**facts) -> Selection:
    """All facts hold; a list means any of its values; an array column holds any of them. Unknown facts raise ValueError."""

    def test(d: DataFrame) -> Column:
        parts = [F.lit(True)]
        for name, value in facts.items():
            if name not in d.columns:
                raise ValueError(f"no fact named {name}")
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            if dict(d.dtypes)[name].startswith("array"):
                parts.append(F.coalesce(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])), F.lit(False)))
            else:
                parts.append(F.coalesce(F.col(name).isin(values), F.lit(False)))
        return reduce(lambda a, b: a & b, parts)

    return Selection(test)
