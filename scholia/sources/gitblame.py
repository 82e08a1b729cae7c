"""Line authors from version control, for joining with task markers."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, line int, name string, email string"


def parse_porcelain(out: str) -> Iterator[tuple[int, str, str]]:
    """(line, author, address) of each line of a line-porcelain listing."""
    line, name, email = 0, "", ""
    for row in out.split("\n"):
        if row.startswith("\t"):
            yield line, name, email
        elif row.startswith("author "):
            name = row[7:]
        elif row.startswith("author-mail "):
            email = row[12:].strip("<>")
        else:
            parts = row.split(" ")
            if len(parts) >= 3 and len(parts[0]) >= 40 and parts[2].isdigit():
                line = int(parts[2])


def blame_of(paths: DataFrame) -> DataFrame:
    """(path, line, name, email) of the committed lines of each path; none where there is no repository or no git."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    done = subprocess.run(["git", "-C", os.path.dirname(path) or ".", "blame", "--line-porcelain", "HEAD", "--", os.path.basename(path)], capture_output=True, text=True, errors="replace", check=True)
                except (OSError, subprocess.CalledProcessError):
                    continue
                out += [(path, *row) for row in parse_porcelain(done.stdout)]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "line", "name", "email"])

    return paths.select("path").distinct().mapInArrow(run, SCHEMA)
