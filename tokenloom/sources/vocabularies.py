"""Vocabulary files as DataFrames, and models from and to them.

The readers stay in Spark: a JSON map is exploded, lines are numbered by their
place in the one file. Vocabularies are of bounded size.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.models import BPE, Unigram, WordLevel, WordPiece


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a JSON object, ordered by id; ids may be numeric strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "i")).select("token", F.col("i").cast("bigint").alias("id")).orderBy("id")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)``; blank lines and those that begin with # are skipped."""
    kept = _lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", " ", 2)
    return kept.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line")) - 1).alias("rank"), parts[0].alias("left"), parts[1].alias("right"))


def read_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a file of one token a line; empty lines don't count."""
    kept = _lines(spark, path).select("line", F.trim("value").alias("token")).where("token <> ''")
    return kept.select("token", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line")) - 1).cast("bigint").alias("id"))


def read_unigram(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id, score)``; the id is the place."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.vocab"), "array<array<string>>")).alias("id", "e"))
    return rows.select(F.col("e")[0].alias("token"), F.col("id").cast("bigint").alias("id"), F.col("e")[1].cast("double").alias("score"))


def load_bpe(vocab_path: str, merges_path: str, **options: object) -> BPE:
    lines = Path(merges_path).read_text(encoding="utf-8").splitlines()
    return BPE(vocab=json.loads(Path(vocab_path).read_text(encoding="utf-8")), merges=[x for x in lines if x.strip() and not x.startswith("#")], **options)


def save_bpe(model: BPE, folder: str, name: str | None = None) -> tuple[str, str]:
    prefix = f"{name}-" if name else ""
    vocab, merges = Path(folder, f"{prefix}vocab.json"), Path(folder, f"{prefix}merges.txt")
    vocab.write_text(json.dumps(dict(sorted(model.vocab.items(), key=lambda x: x[1])), ensure_ascii=False), encoding="utf-8")
    merges.write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in model.merges), encoding="utf-8")
    return str(vocab), str(merges)


def load_wordpiece(path: str, **options: object) -> WordPiece:
    tokens = [t.strip() for t in Path(path).read_text(encoding="utf-8").splitlines()]
    return WordPiece(vocab={t: i for i, t in enumerate(t for t in tokens if t)}, **options)


def save_wordpiece(model: WordPiece, path: str) -> None:
    Path(path).write_text("".join(f"{t}\n" for t, _ in sorted(model.vocab.items(), key=lambda x: x[1])), encoding="utf-8")


def load_wordlevel(path: str, **options: object) -> WordLevel:
    return WordLevel(vocab=json.loads(Path(path).read_text(encoding="utf-8")), **options)


def save_wordlevel(model: WordLevel, path: str) -> None:
    Path(path).write_text(json.dumps(dict(sorted(model.vocab.items(), key=lambda x: x[1])), ensure_ascii=False), encoding="utf-8")


def load_unigram(path: str, **options: object) -> Unigram:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return Unigram(vocab=data["vocab"], unk_id=data.get("unk_id"), byte_fallback=bool(data.get("byte_fallback")), **options)


def save_unigram(model: Unigram, path: str) -> None:
    Path(path).write_text(json.dumps({"unk_id": model.unk_id, "vocab": model.vocab, "byte_fallback": model.byte_fallback}, ensure_ascii=False), encoding="utf-8")
