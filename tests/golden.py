"""R's generator and pixel relations made of arrays, for tests against published example values."""

import numpy as np


def runif(n, seed, low=0.0, high=1.0):
    s = seed
    for _ in range(50):
        s = (69069 * s + 1) & 0xFFFFFFFF
    state = []
    for _ in range(625):
        s = (69069 * s + 1) & 0xFFFFFFFF
        state.append(s)
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state[1:], dtype=np.uint32), 624))
    return low + (high - low) * rng.randint(0, 1 << 32, n, dtype=np.uint64) * 2.3283064365386963e-10


def frame(spark, img, photo=1):
    """Pixel relation of an h x w x 3 array."""
    h, w, _ = img.shape
    rows = [(photo, h, w, r + 1, c + 1, *(int(x) for x in np.floor(img[r, c] * 255 + 0.5)), *(float(x) for x in img[r, c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "photo_id long, h int, w int, rw int, cl int, r8 int, g8 int, b8 int, r double, g double, b double")


def image(spark, shape, seed=1, low=0.0, high=1.0, photo=1):
    return frame(spark, runif(int(np.prod(shape)), seed, low, high).reshape(shape, order="F"), photo)
