import os

from tallyloom import session


def test_scratch_folders_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    folders = [session.scratch_dir(spark, "probe") for _ in range(3)]
    for folder in folders[:2]:
        spark.range(3).write.parquet(folder)
    assert len(set(folders)) == 3 and session.clear_scratch(spark) == 2
    assert not any(map(os.path.exists, folders)) and session.clear_scratch(spark) == 0
