"""The logical plan of a search: what is asked for, free of how it is found."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PartialDate:
    """A date of which any part may be unknown."""

    day: int | None = None
    month: int | None = None
    year: int | None = None

    def __bool__(self) -> bool:
        return (self.day, self.month, self.year) != (None, None, None)

    def row(self) -> dict[str, int | None] | None:
        return {"j": self.day, "m": self.month, "a": self.year} if self else None


@dataclass(frozen=True)
class StructuredQuery:
    target: str = "articles"  # or rubriques
    kw_yes: tuple[str, ...] = ()
    kw_no: tuple[str, ...] = ()
    kw_op: str = "and"
    rubriques: tuple[str, ...] = ()
    rub_op: str = "or"
    titres: tuple[str, ...] = ()
    titre_op: str = "and"
    date_from: PartialDate = field(default_factory=PartialDate)
    date_to: PartialDate = field(default_factory=PartialDate)
    date_on: PartialDate = field(default_factory=PartialDate)
    date_not: PartialDate = field(default_factory=PartialDate)
    images: bool | None = None

    def row(self) -> dict:
        """The query as a row of schemas.STRUCTURED_QUERY."""
        out = {k: getattr(self, k) for k in self.__dataclass_fields__}
        return {k: v.row() if isinstance(v, PartialDate) else list(v) if isinstance(v, tuple) else v for k, v in out.items()}
