"""The tables that commands work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Archive:
    """d: enriched deliveries; matches with a `year` column; the others may be absent (None)."""

    d: DataFrame
    matches: DataFrame
    info: DataFrame | None = None
    awards: DataFrame | None = None
    subs: DataFrame | None = None
    styles: DataFrame | None = None
    commentary: DataFrame | None = None

    def years(self, low: int | None = None, high: int | None = None) -> Archive:
        """The archive within calendar years (pushed to both fact and dimension)."""
        if low is None and high is None:
            return self
        keep = lambda df: df.filter(df.year.between(low if low is not None else 0, high if high is not None else 9999))
        return Archive(keep(self.d), keep(self.matches), self.info, self.awards, self.subs, self.styles, self.commentary)
