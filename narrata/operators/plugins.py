"""Detectors and segmenters of one's own, in the pre-pass, as columns, and as table functions in SQL.

A detector is a function of a block's text.  A registry holds detectors by
name; all of them read a block in one scan, and where two find the same place,
the one of lower priority number has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from narrata.functions.offsets import Claims, struct_lists
from narrata.functions.sentences import Segment, sentences
from narrata.operators.detectors import SUGGESTIONS

#: Priorities of the built-in detectors of the pre-pass; lexicon hits replace all others.
NUMBERS, WORDS = 20, 30
#: start, end, replacement, reason, confidence
Found = tuple[int, int, str, str, float]
_FIELDS = ("step", "start", "end", "kind", "original", "replacement", "reason", "confidence")
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())


@dataclass(frozen=True)
class Detector:
    """``find`` gives suggestions of one text; ``name`` is their kind."""

    name: str
    priority: int
    find: Callable[[str], Iterable[Found]]

    def rows(self, text: str) -> Iterator[tuple]:
        """Suggestions as rows of SUGGESTIONS; one that could not be applied is an error."""
        for start, end, replacement, reason, confidence in self.find(text):
            if not 0 <= start < end <= len(text) or not reason or not 0.0 <= confidence <= 1.0:
                raise ValueError(f"detector {self.name}: a suggestion needs a place in the text, a reason and a confidence from 0 to 1, not {(start, end, reason, confidence)}")
            yield self.priority, start, end, self.name, text[start:end], replacement, reason, float(confidence)


class Registry:
    """Detectors by name, in order of priority, then of registration."""

    def __init__(self, *detectors: Detector) -> None:
        self._by_name: dict[str, Detector] = {}
        for d in detectors:
            self.register(d)

    def register(self, detector: Detector) -> Registry:
        if detector.name in self._by_name:
            raise ValueError(f"there is a detector {detector.name} already")
        self._by_name[detector.name] = detector
        return self

    def __iter__(self) -> Iterator[Detector]:
        return iter(sorted(self._by_name.values(), key=lambda d: d.priority))

    def __len__(self) -> int:
        return len(self._by_name)

    def rows(self, text: str) -> list[tuple]:
        """Suggestions of all detectors that overlap none of a detector before."""
        kept = Claims()
        return [r for d in self for r in sorted(d.rows(text), key=lambda r: (r[1], r[2])) if kept.take(r[1], r[2])]

    def suggestions(self, text: Column) -> Column:
        """``array<suggestion>`` of a text; ``step`` is the detector's priority.  Null texts have none."""
        found = tuple(self)

        def job(texts: pa.Array) -> pa.Array:
            registry = Registry(*found)
            return struct_lists([registry.rows(t) if t else [] for t in texts.to_pylist()], _FIELDS, _TYPES)

        return F.arrow_udf(job, SUGGESTIONS)(text)

    def create_function(self, spark: SparkSession, name: str) -> None:
        """A table function for SQL: ``SELECT ... FROM blocks, LATERAL name(text)``."""
        found = tuple(self)

        class Detect:
            def __init__(self) -> None:
                self.registry = Registry(*found)

            def eval(self, text: str) -> Iterator[tuple]:
                for _, *row in self.registry.rows(text) if text else ():
                    yield tuple(row)

        spark.udtf.register(name, F.udtf(Detect, returnType="start int, end int, kind string, original string, replacement string, reason string, confidence double"))


def create_sentences(spark: SparkSession, name: str = "sentences", segment: Segment = sentences) -> None:
    """A table function for SQL: the sentences of a text (position, start, end, sentence) by any segmenter."""

    class Sentences:
        def eval(self, text: str) -> Iterator[tuple]:
            for k, (start, end) in enumerate(segment(text) if text else ()):
                yield k, start, end, text[start:end]

    spark.udtf.register(name, F.udtf(Sentences, returnType="position int, start int, end int, sentence string"))
