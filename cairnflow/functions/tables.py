"""Chunkers, detectors and packers as table functions: callable from SQL in a lateral join, or over a table that is partitioned and ordered.

``register`` makes them known to a session; further chunkers and detectors are added there by name, each a Python function over one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import procedural as P
from ..operators.evidence import DETECTORS
from ..registry import ORACLES, query


def per_text(f: Callable[..., Iterable[tuple]], returns: str):
    """A table function (text, more...) with a row for each tuple that ``f`` gives; none for a null text."""

    class PerText:
        def eval(self, text: str, *more) -> Iterator[tuple]:
            if text is not None:
                yield from f(text, *more)

    return udtf(PerText, returnType=returns, useArrow=True)


class Packs:
    """C16 in SQL: rows (group, order, size) of a table argument that is partitioned by the first and ordered by the second, with their packs. A partition passes
    through row by row; ``chains.packed`` is for groups of any size."""

    def __init__(self):
        self.pack, self.items, self.chars = 0, 0, 0

    def eval(self, row: Row, most_items: int, most_chars: int) -> Iterator[tuple]:
        size = max(0, row[2] or 0)
        if self.items and (self.items >= most_items or self.chars + size > most_chars):
            self.pack, self.items, self.chars = self.pack + 1, 0, 0
        self.items, self.chars = self.items + 1, self.chars + size
        yield str(row[0]) if row[0] is not None else None, int(row[1]), int(size), self.pack


def topics(detectors: list[tuple[str | None, str, str, float]]):
    """(text, path) -> (line, topic, confidence): lines that a detector (ending of the path or null for all, topic, pattern, confidence) matches."""
    rules = [(ending, topic, re.compile(rule), sure) for ending, topic, rule, sure in detectors]

    def found(text: str, path: str | None = None) -> Iterator[tuple]:
        mine = [(t, r, s) for e, t, r, s in rules if e is None or (path or "").endswith(e)]
        for number, line in enumerate(text.split("\n"), 1):
            yield from ((number, topic, sure) for topic, rule, sure in mine if rule.search(line))

    return per_text(found, "line int, topic string, confidence double")


def register(spark: SparkSession, detectors: list[tuple[str | None, str, str, float]] | None = None, **more) -> None:
    """C2 as ``markdown_chunks(text)``, C7 as ``code_chunks(text, python)``, C34 as ``line_topics(text, path)``, C16 as ``packs(TABLE(...) PARTITION BY ... ORDER
    BY ..., most_items, most_chars)``, and ``more`` table functions by name."""
    held = {
        "markdown_chunks": per_text(P.markdown_chunks, "part int, heading string, chunk string"),
        "code_chunks": per_text(P.code_chunks, "part int, first int, last int, names array<string>, code string"),
        "packs": udtf(Packs, returnType="g string, o long, size long, pack long"),
        "line_topics": topics(detectors or []),
        **more,
    }
    for name, made in held.items():
        spark.udtf.register(name, made)


@query("C34_line_topics", ORACLES["C34_line_detectors"])
def _(t):
    register(t.spark, [(None, *d) for d in DETECTORS])
    return t.spark.sql("SELECT d.doc_id, c.line, c.topic, c.confidence FROM {d} d, LATERAL line_topics(d.text, NULL) c", d=t.documents)


@query("C16_table_argument", ORACLES["C16_packs"])
def _(t):
    register(t.spark)
    sizes = t.conversations.selectExpr("cast(conv_id as string) g", "turn", "coalesce(length(text), 0) + 4 size")
    packed = t.spark.sql("SELECT * FROM packs(TABLE(SELECT * FROM {r}) PARTITION BY g ORDER BY (turn), 4, 1200)", r=sizes)
    return packed.selectExpr("cast(g as bigint) conv_id", "o turn", "size", "pack")


@query("C2_table_function")
def _(t):
    register(t.spark)
    return t.spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL markdown_chunks(concat('# ', d.source, '\\n', d.text)) c", d=t.documents)
