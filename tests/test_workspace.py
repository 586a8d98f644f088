"""Saved stages follow the files of their input folder."""

from pathlib import Path

from quarterdeck.session import Workspace


def test_changed_files_build_stages_anew(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    builds = []

    def count() -> int:
        def build():
            builds.append(1)
            return spark.read.parquet(f"{folder}/t.parquet")
        return Workspace(spark, folder).saved("copy", build).count()

    assert count() == 3 and count() == 3 and len(builds) == 1
    spark.range(5).write.mode("append").parquet(f"{folder}/t.parquet")
    assert count() == 8 and len(builds) == 2


def test_forget_deletes_only_the_tables_of_its_folder(spark, tmp_path):
    stages = {}
    for name in ("a", "b"):
        folder = str(tmp_path / name)
        spark.range(2).write.parquet(f"{folder}/t.parquet")
        workspace = Workspace(spark, folder)
        stages[name] = workspace.saved("copy", lambda: spark.read.parquet(f"{folder}/t.parquet")).inputFiles()[0].removeprefix("file://")
    Workspace(spark, str(tmp_path / "a")).forget(delete=True)
    assert not Path(stages["a"]).exists() and Path(stages["b"]).exists()
