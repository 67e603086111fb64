"""Format versions: major.minor.patch with an optional suffix."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = re.compile(r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?(.*)$")


@dataclass(frozen=True, order=True)
class Version:
    major: int
    minor: int = 0
    patch: int = 0
    suffix: str = ""

    @staticmethod
    def parse(text: str | None) -> Version:
        """Missing parts are 0; no version at all is 0.0.0."""
        m = _PATTERN.match(text or "")
        return Version(int(m[1]), int(m[2] or 0), int(m[3] or 0), m[4]) if m else Version(0)

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}{self.suffix}"

    def is_compatible(self, other: Version) -> bool:
        """Whether data of the other version can be used by this one."""
        return other.major <= self.major


#: The version of the format that is written.
CURRENT = Version(4, 0, 0)


def part_column(text: Column, part: int) -> Column:
    """Part 1 to 3 of a version column, 0 where it is missing."""
    found = F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", part)
    return F.coalesce(F.when(found != "", found.cast("int")), F.lit(0))


def compatible_column(text: Column, with_version: Version = CURRENT) -> Column:
    return part_column(text, 1) <= with_version.major
