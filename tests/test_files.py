"""Directories that cannot be listed."""

import os

from moraine.sources import files


def test_directories_that_cannot_be_listed_are_errors(tmp_path, monkeypatch):
    for name in ("top/inner", "other/inner"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "file").write_text("x")
    scandir, closed = os.scandir, {str(tmp_path / "top"), str(tmp_path / "other/inner")}

    def refused(path):
        if str(path) in closed:
            raise PermissionError(13, "Permission denied", str(path))
        return scandir(path)

    monkeypatch.setattr(files.os, "scandir", refused)
    reader = files.InodeReader(str(tmp_path))
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted(row[0] for row in rows) == ["/", "/other/", "/other/inner/", "/top/"]
    assert {row[0] for row in rows if row[13]} == {"/top/", "/other/inner/"} and all(row[2] == "dir" for row in rows)


def test_a_folder_of_many_files_is_dealt_out(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_ENTRIES", 10)
    for name in ("a/deep/er", "b"):
        os.makedirs(tmp_path / name)
    for k in range(35):
        (tmp_path / f"b/{k}").write_text("x")
    (tmp_path / "a/deep/er/file").write_text("x")
    reader = files.InodeReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) == 5 and max(len(p.paths) for p in parts) == 10
    rows = sorted(row[0] for part in parts for row in reader.read(part))
    assert rows == sorted(["/", "/a/", "/a/deep/", "/a/deep/er/", "/a/deep/er/file", "/b/", *(f"/b/{k}" for k in range(35))])
