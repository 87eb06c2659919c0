"""The reference lists that several operators share, read from the ``lexicon`` table with a size check."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from specloom.session import collect_bounded

#: A lexicon is a curated list; beyond this it must be joined, not carried.
LEXICON_ROWS = 20_000

LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"


@dataclass(frozen=True)
class Lexicon:
    """Entries by kind, in the order of ``ordinal``: key and value."""

    entries: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    @classmethod
    def read(cls, lexicon: DataFrame, limit: int = LEXICON_ROWS) -> "Lexicon":
        """Rows with a null kind or key are left out. Raises beyond ``limit`` rows."""
        by: dict[str, list[tuple[int, str, str]]] = defaultdict(list)
        for r in collect_bounded(lexicon.select("kind", "lex_key", "lex_value", "ordinal"), limit, "lexicon"):
            if r.kind is not None and r.lex_key is not None:
                by[r.kind].append((r.ordinal if r.ordinal is not None else 1 << 30, r.lex_key, r.lex_value or ""))
        return cls({k: [(key, value) for _, key, value in sorted(v)] for k, v in by.items()})

    def keys(self, kind: str) -> list[str]:
        return [k for k, _ in self.entries.get(kind, [])]
