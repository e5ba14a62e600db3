"""Tables that are replaced whole: a new version is written beside the old one, checked, and only then becomes the one that is read.

A version is a folder of its own. Which one is read says the manifest of the highest number; a manifest is written once, as a new file, when its
version is whole, so a load that fails or is killed at any point leaves the old table as it was. The version before stays for readers that
have it open; older ones, and what failed loads left, go with the next replacement.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class StagedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        files, target = self._files(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0] != "_" and n[0] != ".")

    def manifest(self, number: int | None = None) -> dict | None:
        """What the newest manifest (or one of a number) says: the version's folder and its rows."""
        known = self.manifests()
        if not known:
            return None
        files, target = self._files(f"{self.path}/manifests/{known[-1] if number is None else number:012d}.json")
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.manifests())

    def read(self) -> DataFrame:
        """The table as it was last committed."""
        found = self.manifest()
        if found is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/versions/{found['version']}")

    def stage(self) -> tuple[str, str]:
        """The name and folder of a new version, which nobody reads yet."""
        version = uuid.uuid4().hex
        return version, f"{self.path}/versions/{version}"

    def commit(self, version: str, rows: int) -> None:
        """Makes a whole version the one that is read. Of two commits at once, one fails."""
        number = (self.manifests() or [0])[-1] + 1
        folder, target = f"{self.path}/manifests", f"{self.path}/manifests/{number:012d}.json"
        files, draft = self._files(f"{folder}/_{version}")
        stream = files.create(draft)
        stream.write(json.dumps({"version": version, "rows": rows}).encode())
        stream.close()
        goal = self._files(target)[1]
        if files.exists(goal) or not files.rename(draft, goal):
            raise RuntimeError(f"another commit was first: {target}")
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Deletes all versions but those of this manifest and the one before, and older manifests."""
        kept = {self.manifest(n)["version"] for n in self.manifests() if n >= number - 1}
        for version in self._names("versions"):
            if version not in kept:
                files, target = self._files(f"{self.path}/versions/{version}")
                files.delete(target, True)
        for old in [n for n in self.manifests() if n < number - 1]:
            files, target = self._files(f"{self.path}/manifests/{old:012d}.json")
            files.delete(target, False)
