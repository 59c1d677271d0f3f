import numpy as np

from lumenframe.operators import color
from lumenframe.plans import training
from lumenframe.sources import files

from .test_golden import png


def quick(px):
    return color.simple_measures(px)


def test_train(spark, tmp_path):
    """All photos of a folder, photos at fault with an error each; a second run measures only what has come since."""
    folder, target = tmp_path / "photos", f"file://{tmp_path}/out"
    folder.mkdir()
    rng = np.random.default_rng(1)
    for i in range(1, 8):
        (folder / f"{i}.x.png").write_bytes(png(rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)))
    (folder / "20.png").write_bytes(b"no picture")
    (folder / "notes.txt").write_text("x")
    (folder / "cover.png").write_bytes(png(rng.integers(0, 256, (2, 2, 3), dtype=np.uint8)))
    calls = []

    def measure(px):
        calls.append(sorted(r.photo_id for r in px.select("photo_id").distinct().collect()))
        if 5 in calls[-1]:
            raise ValueError("five is bad")
        return quick(px)

    got = {r.photo_id: r for r in training.train(spark, str(folder), target, batch=4, measure=measure).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 20}
    assert got[5].error == "five is bad" and got[20].error == "no picture" and got[5].Exposure is None
    assert all(got[i].error is None and got[i].Exposure is not None and got[i].SizeFeature == 9 for i in (1, 2, 3, 4, 6, 7))
    want = {r.photo_id: r.RmsContrast for r in quick(files.read_images(spark, str(folder))).collect()}
    assert all(got[i].RmsContrast == want[i] for i in (1, 2, 3, 4, 6, 7))
    done = len(calls)
    (folder / "9.png").write_bytes(png(rng.integers(0, 256, (3, 3, 3), dtype=np.uint8)))
    again = training.train(spark, str(folder), target, measure=measure)
    assert again.count() == 9 and calls[done:] == [[9]]
    table = {r.photo_id: r for r in files.read_measures(spark, f"{target}/measures").collect()}
    assert len(table) == 9 and table[9].Exposure is not None and table[5].Exposure is None and table[1].RmsContrast == want[1]
    assert training.train(spark, str(folder), target, measure=measure).count() == 9 and len(calls) == done + 1
