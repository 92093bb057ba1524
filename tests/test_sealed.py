"""A sealed folder opens whole, and not after anything in it was changed."""

import hashlib
import shutil
from pathlib import Path

import pytest

from lodestar.sources import sealed


def test_sealed_tables(spark, tmp_path):
    rows = spark.range(100).repartition(3)
    seal = sealed.seal_tables(spark, str(tmp_path / "a"), {"role": "fit", "run": "1"}, {"x": rows, "y": rows.filter("id < 5")})
    tables = sealed.open_sealed(spark, str(tmp_path / "a"), {"run": "1", "role": "fit"}, seal)
    assert {n: t.count() for n, t in tables.items()} == {"x": 100, "y": 5}
    digests = {r["file"]: (r["bytes"], r["sha256"]) for r in sealed.file_digests(spark, str(tmp_path / "a")).collect()}
    files = {str(f.relative_to(tmp_path / "a")): f for f in Path(tmp_path / "a").rglob("*") if f.is_file() and f.name[0] not in "_."}
    assert digests == {n: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for n, f in files.items()}
    part = next((tmp_path / "a" / "tables" / "x").glob("part-*"))

    def refused(change, identity=(("role", "fit"), ("run", "1")), seal=seal):
        shutil.copytree(tmp_path / "a", tmp_path / "b")
        change(tmp_path / "b" / part.relative_to(tmp_path / "a"))
        with pytest.raises(ValueError):
            sealed.open_sealed(spark, str(tmp_path / "b"), dict(identity), seal)
        shutil.rmtree(tmp_path / "b")

    def changed(f):
        f.with_name(f".{f.name}.crc").unlink()  # the local file system's own check sum would find it first
        f.write_bytes(f.read_bytes()[:-1] + b"x")

    refused(changed)
    refused(lambda f: f.unlink())
    refused(lambda f: shutil.copy(f, f.with_name("part-9.parquet")))
    refused(lambda f: None, identity=[("role", "test"), ("run", "1")])
    refused(lambda f: None, seal="0" * 64)
    with pytest.raises(Exception, match="(?i)exist"):
        sealed.seal_tables(spark, str(tmp_path / "a"), {}, {"x": rows})
    with pytest.raises(ValueError):
        sealed.seal_tables(spark, str(tmp_path / "c"), {}, {"../x": rows})
