"""A container of named elements: images, labels, points, shapes and tables, kept as frames or as parquet in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.table import duplicate_keys

KINDS = {"image": ("c", "y", "x", "value"), "labels": ("y", "x", "instance"), "points": ("x", "y"), "shapes": ("instance", "ring"), "table": ("region", "instance")}


class Elements:
    """Elements by kind and name. With ``path`` they are written there, and read back; without, they stay plans."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self._frames: dict[tuple[str, str], DataFrame] = {}
        self._version = 0

    def _add(self, kind: str, name: str, df: DataFrame, overwrite: bool) -> DataFrame:
        missing = [c for c in KINDS[kind] if c not in df.columns]
        if missing:
            raise ValueError(f"{kind} needs columns {missing}")
        if (kind, name) in self._frames and not overwrite:
            raise ValueError(f"{kind} {name} exists already")
        if self.path:
            # a folder per version: the frame may read the one that it replaces
            self._version += 1
            target = f"{self.path}/{kind}/{name}/{self._version:04d}"
            df.write.parquet(target)
            df = self.spark.read.schema(df.schema).parquet(target)
        self._frames[kind, name] = df
        return df

    def add_image(self, name: str, df: DataFrame, overwrite: bool = False) -> DataFrame:
        return self._add("image", name, df, overwrite)

    def add_labels(self, name: str, df: DataFrame, overwrite: bool = False) -> DataFrame:
        if dict(df.dtypes).get("instance") not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError("labels are integers")
        return self._add("labels", name, df, overwrite)

    def add_points(self, name: str, df: DataFrame, overwrite: bool = False) -> DataFrame:
        return self._add("points", name, df, overwrite)

    def add_shapes(self, name: str, df: DataFrame, overwrite: bool = False) -> DataFrame | None:
        """Shapes; an empty frame is not added."""
        return self._add("shapes", name, df, overwrite) if df.limit(1).count() else None

    def add_table(self, name: str, df: DataFrame, overwrite: bool = False) -> DataFrame:
        if duplicate_keys(df).limit(1).count():
            raise ValueError("an instance stands twice in a region")
        return self._add("table", name, df, overwrite)

    def get(self, kind: str, name: str) -> DataFrame:
        if (kind, name) not in self._frames:
            raise KeyError(f"no {kind} {name}")
        return self._frames[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._frames if k == kind)
