import os

from calathea.operators.durable import folder
from calathea.sources import changes
from calathea.streaming import streams


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_files_come_again_when_they_change(spark, tmp_path):
    changes.register(spark)
    listings, checkpoint = folder(spark, "listings"), folder(spark, "changes")
    rows = lambda **o: spark.readStream.format("changed_files").options(ends=".jpg,.heic", listings=listings, each="2", **o).load(f"file://{tmp_path}/in")
    told = []

    def run():
        before = len(told)
        found = streams.drain(rows(), "changes", checkpoint).collect()
        told[:] = sorted(((r.path, r.size, r.changed, r.kind) for r in found), key=repr)
        return len(told) - before

    for k in range(5):
        put(tmp_path / "in" / f"{k % 2}" / f"{k}.JPG", "x" * k, 1_000 + k)
    put(tmp_path / "in" / "a.txt", "x", 1)
    put(tmp_path / "in" / "_part" / "b.jpg", "x", 1)
    assert run() == 5 and {k for *_, k in told} == {"new"}
    assert run() == 0
    put(tmp_path / "in" / "0" / "2.JPG", "mended", 1_002)  # another size
    put(tmp_path / "in" / "1" / "3.JPG", "xxx", 2_000)  # another time
    (tmp_path / "in" / "0" / "4.JPG").unlink()
    put(tmp_path / "in" / "c.heic", "x", 1)
    assert run() == 4
    assert [x for x in told if x[3] != "new"] == [("0/2.JPG", 6, 1_002_000_000, "changed"), ("0/4.JPG", None, None, "gone"), ("1/3.JPG", 3, 2_000_000_000, "changed")]
    assert run() == 0
    batch = spark.read.format("changed_files").load(f"file://{tmp_path}/in").collect()
    assert sorted(r.path for r in batch) == ["0/0.JPG", "0/2.JPG", "1/1.JPG", "1/3.JPG", "a.txt", "c.heic"]
