"""The engine's configuration, its validation, and what must agree between an index and its use."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from strandmill.storage import read_text

KINDS = ("nucleotide", "aminoacid")


@dataclass(frozen=True)
class Config:
    """``nproc`` and ``max_memory`` are accepted; Spark's own settings decide about both."""

    k: int
    h: int
    m: int
    sequence_type: str
    output_directory: str = "."
    matrix_store_name: str = "matrix"
    index_store_name: str = "index"
    nproc: int | None = None
    max_memory: str | None = None

    def __post_init__(self):
        for name in ("k", "h", "m"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"{name} must be a positive whole number")
        if self.m >= 1 << 62:
            raise ValueError("m must be below 2 ** 62")
        if self.sequence_type not in KINDS:
            raise ValueError(f"sequence_type must be one of {', '.join(KINDS)}")

    @property
    def canonical(self) -> bool:
        return self.sequence_type == "nucleotide"

    @property
    def index_path(self) -> str:
        return f"{self.output_directory.rstrip('/')}/{Path(self.index_store_name).stem}.index"

    @property
    def matrix_path(self) -> str:
        return f"{self.output_directory.rstrip('/')}/{Path(self.matrix_store_name).stem}.matrix"

    def agree(self, other: dict) -> None:
        """Raises if an index of other settings is meant to be used with these."""
        for name in ("k", "h", "m", "sequence_type"):
            if getattr(self, name) != other[name]:
                raise ValueError(f"{name} is {getattr(self, name)} here and {other[name]} in the index")


def parse_config(text: str) -> Config:
    """A configuration from ``key: value`` lines; ``#`` begins a comment."""
    known, given = {f.name for f in fields(Config)}, {}
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).strip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a setting: {line}")
        key, value = key.strip(), value.strip().strip("'\"")
        if key in known and value:
            given[key] = int(value.replace("_", "")) if re.fullmatch(r"\d[\d_]*", value) and key in ("k", "h", "m", "nproc") else value
    for name in ("k", "h", "m", "sequence_type"):
        if not given.get(name):
            raise KeyError(f"{name} is missing")
    return Config(**given)


def read_config(path: str, spark: SparkSession | None = None) -> Config:
    """The configuration of a file, on any file system that Spark knows; without a session, on the driver's."""
    return parse_config(Path(path).read_text() if spark is None else read_text(spark, path))
