"""Scopes: folders, tags and SQL conditions, compiled to SQL text or to columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ConfigurationError

ESCAPE = "!"


class UnknownTagError(ConfigurationError):
    pass


class EmptyTagError(ConfigurationError):
    pass


def literal(text: str) -> str:
    """A SQL string literal; the parser reads backslashes as escapes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def like_pattern(glob: str, escape: str = ESCAPE) -> str:
    """`*` and `?` as `%` and `_`; everything else stands for itself."""
    special = {"*": "%", "?": "_", "%": escape + "%", "_": escape + "_", escape: escape * 2}
    return "".join(special.get(c, c) for c in glob)


def is_glob(spec: str) -> bool:
    return "*" in spec or "?" in spec


def _checked(value: str, what: str) -> str:
    if not value.strip():
        raise ConfigurationError(f"a {what} can't be blank")
    return value


def folder_terms(spec: str) -> list[tuple[str, str, bool]]:
    """(column, value, is a pattern) of which any must hold for a row to lie in the folder.

    A name without a separator is compared with the author, by equality where it has no wildcard;
    the path must hold it as a whole component run, in either spelling of the separator.
    """
    _checked(spec, "folder")
    out = []
    if not set("/\\") & set(spec):
        out.append(("author", like_pattern(spec) if is_glob(spec) else spec, is_glob(spec)))
    parts = [p for p in spec.replace("\\", "/").split("/") if p]
    for separator in ("/", "\\"):
        out.append(("file_path", "%" + like_pattern(separator.join(parts) + separator), True))
    return out


def folder_sql(spec: str) -> str:
    return "(" + " OR ".join(f"{c} LIKE {literal(v)} ESCAPE '{ESCAPE}'" if pattern else f"{c} = {literal(v)}" for c, v, pattern in _contained(spec)) + ")"


def folder_column(spec: str) -> Column:
    return reduce(Column.__or__, (F.like(F.col(c), F.lit(v), F.lit(ESCAPE)) if pattern else F.col(c) == v for c, v, pattern in _contained(spec)))


def _contained(spec: str) -> list[tuple[str, str, bool]]:
    return [(c, v + "%" if c == "file_path" else v, pattern) for c, v, pattern in folder_terms(spec)]


class Tags:
    """A taxonomy: each tag stands for some folders."""

    def __init__(self, tags: Mapping[str, Sequence[str]]):
        self.tags = {k: tuple(v) for k, v in tags.items()}

    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self.tags))

    def folders(self, tags: Iterable[str]) -> tuple[str, ...]:
        """The folders of all tags, each once, in order of first sight."""
        found: dict[str, None] = {}
        for tag in tags:
            if tag not in self.tags:
                raise UnknownTagError(f"unknown tag {tag!r}; there are: {', '.join(self.names()) or 'none'}")
            if not self.tags[tag]:
                raise EmptyTagError(f"tag {tag!r} stands for no folder")
            found.update(dict.fromkeys(self.tags[tag]))
        return tuple(found)

    def sql(self, folder: str | None = None, tags: Iterable[str] = (), condition: str | None = None) -> str | None:
        """folder AND (a folder of any tag) AND (condition), of what is given; None if nothing is."""
        parts = [folder_sql(folder)] if folder is not None else []
        if specs := self.folders(tags):
            parts.append("(" + " OR ".join(map(folder_sql, specs)) + ")")
        if condition is not None:
            parts.append(f"({_checked(condition, 'condition')})")
        return " AND ".join(parts) or None

    def column(self, folder: str | None = None, tags: Iterable[str] = (), condition: str | None = None) -> Column | None:
        parts = [folder_column(folder)] if folder is not None else []
        if specs := self.folders(tags):
            parts.append(reduce(Column.__or__, map(folder_column, specs)))
        if condition is not None:
            parts.append(F.expr(f"({_checked(condition, 'condition')})"))
        return reduce(Column.__and__, parts) if parts else None

    def tags_of(self, folder: str | Column) -> Column:
        """The sorted tags whose folders a folder label matches, by its first component; case counts."""
        first = F.split(F.regexp_replace(F.col(folder) if isinstance(folder, str) else folder, r"[\\/]+", "/"), "/")[0]
        hits = [F.when(reduce(Column.__or__, (F.like(first, F.lit(like_pattern(s.replace("\\", "/").split("/")[0])), F.lit(ESCAPE)) for s in specs)), F.lit(tag)) for tag, specs in sorted(self.tags.items()) if specs]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
