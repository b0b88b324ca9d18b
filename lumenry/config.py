"""Run settings as a frozen record, kept as JSON."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import SparkSession

from lumenry.functions.style import STYLES


@dataclasses.dataclass(frozen=True)
class RunConfig:
    project_dir: str
    img_dir: str
    vocab_size: int
    emotions: tuple[str, ...] = STYLES
    embed_dim: int = 64
    hidden_dim: int = 512
    visual_dim: int = 2048
    fused_dim: int = 512
    max_seq_len: int = 40

    @property
    def n_emotions(self) -> int:
        return len(self.emotions)

    @property
    def emotion_to_id(self) -> dict[str, int]:
        return {e: i for i, e in enumerate(self.emotions)}

    def to_json(self) -> str:
        plain = dataclasses.asdict(self) | {"emotion_to_id": self.emotion_to_id, "n_emotions": self.n_emotions}
        return json.dumps(plain, indent=1)

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        names = {f.name for f in dataclasses.fields(cls)}
        found = {k: v for k, v in json.loads(text).items() if k in names}
        return cls(**found | {"emotions": tuple(found.get("emotions", STYLES))})

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the record as JSON to ``path``, on any storage that Spark reaches."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RunConfig:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])
