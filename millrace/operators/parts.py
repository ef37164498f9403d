"""Tables kept in parts of which a batch rewrites only those it touches, published together by one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.landing import Files


class Parts:
    """Versions of parts under one root: v=B/<column>=P is part P as batch B wrote it; manifest/B says which versions hold.

    A job that dies before the manifest is renamed leaves the former state. What neither the newest manifest nor the one
    before it (whose readers may have begun) names is deleted. note: a number that is published along with the versions.
    """

    def __init__(self, spark: SparkSession, root: str, column: str):
        self.spark, self.root, self.column, self._files = spark, root.rstrip("/"), column, Files(spark, root)
        self.applied, self.note, self.versions = -1, None, {}
        done = sorted(int(n) for n, _, _ in self._files.children(f"{self.root}/manifest"))
        if done:
            self.applied = done[-1]
            for r in spark.read.parquet(f"{self.root}/manifest/{self.applied}").collect():  # one row per part
                self.versions[r.part], self.note = r.v, r.note

    def write(self, number: int, df: DataFrame) -> None:
        """Parts as batch `number` has them; not seen until they are published."""
        df.write.mode("overwrite").partitionBy(self.column).parquet(f"{self.root}/v={number}")

    def publish(self, number: int, parts: list[int], note: int | None = None) -> None:
        versions = self.versions | dict.fromkeys(parts, number)
        made = f"{self.root}/_manifest-{number}"
        self.spark.createDataFrame([(p, v, note) for p, v in versions.items()], "part int, v int, note bigint").coalesce(1).write.mode("overwrite").parquet(made)
        self._files.move(made, f"{self.root}/manifest/{number}")
        for n in sorted(int(n) for n, _, _ in self._files.children(f"{self.root}/manifest") if int(n) < number)[:-1]:
            self._files.delete(f"{self.root}/manifest/{n}")
        live = {*versions.items(), *self.versions.items()}
        for name, _, _ in self._files.children(self.root):
            for part, _, _ in self._files.children(f"{self.root}/{name}") if name.startswith("v=") else ():
                if part.startswith(f"{self.column}=") and (int(part.split("=")[1]), int(name[2:])) not in live:
                    self._files.delete(f"{self.root}/{name}/{part}")
        self.applied, self.note, self.versions = number, note, versions

    def read(self, schema: str, parts: list[int] | None = None) -> DataFrame:
        """The parts (or some of them) as they hold; no other folder is listed."""
        paths = [f"{self.root}/v={v}/{self.column}={p}" for p, v in sorted(self.versions.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
