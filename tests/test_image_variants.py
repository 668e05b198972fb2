"""Image variants against numpy on each picture, and the round-robin cap against the plain loop."""

import hashlib
from itertools import zip_longest

import numpy as np

from marktrace.plans.variants import VariantPlan, capped_variants, image_variants, turned, variants_of


def test_variants_equal_numpy_and_cap_is_round_robin(spark):
    rng = np.random.default_rng(4)
    pics = {i: rng.integers(0, 256, (int(rng.integers(1, 9)), int(rng.integers(1, 9))), dtype=np.uint8) for i in range(12)}
    pics[3][:] = 7
    rows = [(i % 3, i, *p.shape, 1, p.tobytes()) for i, p in pics.items()] + [(0, 99, None, None, None, None), (1, 98, 0, 5, 1, b"")]
    df = spark.createDataFrame(rows, "session int, crop int, height int, width int, channels int, data binary").repartition(3)
    plan = VariantPlan(rotations=(-3.0, 90.0, 12.0))
    found = image_variants(df, ["session", "crop"], plan)
    got = {(r.crop, r.variant_name): (round(r.weight, 9), r.rotation, r.height, r.width, hashlib.sha256(r.data).digest()) for r in found.collect()}
    want = {(i, name): (round(w, 9), turn, h, x, hashlib.sha256(d).digest()) for i, p in pics.items() for name, w, turn, h, x, d in variants_of(p.astype(float), plan)}
    assert got == want and len(got) == 12 * 9
    for total in (1, 4, 10, 1000):
        kept = {(r.session, r.crop, r.variant_name) for r in capped_variants(found, "session", "crop", total, plan).collect()}
        names = [name for name, *_ in plan.rows()]
        dealt = set()
        for s in range(3):
            line = [(s, i, name) for turn in zip_longest(*[[(i, n) for n in names] for i in sorted(pics) if i % 3 == s]) for i, name in turn]
            dealt |= set(line[:total])
        assert kept == dealt


def test_turning():
    p = np.arange(9.0).reshape(3, 3)
    assert (turned(p, 0.0) == p).all() and (turned(p, 90.0) == np.rot90(p, 1)).all() or (turned(p, 90.0) == np.rot90(p, -1)).all()
    assert (turned(np.full((4, 5), 9.0), 33.0) == 9.0).all() and (turned(turned(p, 180.0), 180.0) == p).all()
