"""Registry of user functions: metrics and tags over file rows; one that fails does not stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Registry:
    metrics: dict[str, Callable[[str, str], float]] = field(default_factory=dict)
    tags: dict[str, Callable[[str, str], list[str]]] = field(default_factory=dict)

    def metric(self, name: str):
        def add(f):
            self.metrics[name] = f
            return f

        return add

    def tag(self, name: str):
        def add(f):
            self.tags[name] = f
            return f

        return add

    def run(self, files: DataFrame) -> DataFrame:
        """``file_id, plugin, value, tag, error`` of every function on every file with content."""
        metrics, tags = dict(self.metrics), dict(self.tags)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for key, path, text in zip(pdf["file_id"], pdf["path"], pdf["content"]):
                    for name, f in metrics.items():
                        try:
                            rows.append((key, name, float(f(path, text)), None, None))
                        except Exception as e:  # noqa: BLE001 - a plugin's failure is data
                            rows.append((key, name, None, None, type(e).__name__))
                    for name, f in tags.items():
                        try:
                            rows += [(key, name, None, str(t), None) for t in f(path, text)]
                        except Exception as e:  # noqa: BLE001
                            rows.append((key, name, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["file_id", "plugin", "value", "tag", "error"]).astype({"value": "float64"})

        return files.where("content is not null").select("file_id", "path", "content").mapInPandas(apply, "file_id bigint, plugin string, value double, tag string, error string")


def standard() -> Registry:
    """Functions that come with the engine: line length, nesting, markers."""
    r = Registry()

    @r.metric("longest_line")
    def longest(path: str, text: str) -> float:
        return max(map(len, text.split("\n")))

    @r.metric("nesting")
    def nesting(path: str, text: str) -> float:
        return max((len(x) - len(x.lstrip())) // 4 for x in text.split("\n"))

    @r.tag("marker")
    def marker(path: str, text: str) -> list[str]:
        return [m for m in ("TODO", "FIXME", "HACK") if m in text]

    return r
