"""Tokenizer definitions in JSON: from strings, bytes, files and folders of models."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import SparkSession

from tokenloom.plans.tokenizer import Tokenizer


def from_string(text: str) -> Tokenizer:
    if not text or not text.strip():
        raise ValueError("an empty definition")
    return Tokenizer.from_json(json.loads(text))


def from_bytes(data: bytes) -> Tokenizer:
    return from_string(data.decode("utf-8-sig"))


def from_file(path: str | os.PathLike) -> Tokenizer:
    """A file of this machine; a missing one raises ``FileNotFoundError``."""
    return from_bytes(Path(path).read_bytes())


def from_shared_file(spark: SparkSession, path: str) -> Tokenizer:
    """A file that Spark can read, on any file system."""
    rows = spark.read.text(path, wholetext=True).collect()  # one definition
    if not rows:
        raise FileNotFoundError(path)
    return from_string(rows[0][0])


def from_folder(folder: str | os.PathLike, name: str, revision: str = "main") -> Tokenizer:
    """A model of a folder of models: ``folder/name/revision/tokenizer.json`` or ``folder/name/tokenizer.json``. Nothing is downloaded."""
    for path in (Path(folder, name, revision, "tokenizer.json"), Path(folder, name, "tokenizer.json")):
        if path.exists():
            return from_file(path)
    raise FileNotFoundError(f"{name} ({revision}) is not in {folder}")


def to_string(tokenizer: Tokenizer, pretty: bool = False) -> str:
    return json.dumps(tokenizer.to_json(), ensure_ascii=False, indent=2 if pretty else None)


def save(tokenizer: Tokenizer, path: str | os.PathLike, pretty: bool = True) -> None:
    """Write a file of this machine; it appears whole or not at all."""
    temporary = Path(f"{path}.partial")
    temporary.write_text(to_string(tokenizer, pretty), encoding="utf-8")
    temporary.replace(path)
