"""Bonds, rings and flat ring carbons of planted molecules."""

import math
import random

import pytest

from hitloom.operators import spatial


def hexagon(first, r=1.40, elements="CCCCCC", lift=0.0, at=(0.0, 0.0, 0.0)):
    return [(first + k, elements[k], at[0] + r * math.cos(k * math.pi / 3), at[1] + r * math.sin(k * math.pi / 3), at[2] + (lift if k % 2 else -lift)) for k in range(6)]


SCHEMA = "id long, element string, x double, y double, z double"


def test_flat_and_puckered(spark):
    # a flat ring with a substituent on atom 0 (flagged) and one on a puckered ring far away (not flagged)
    flat = [*hexagon(0, elements="CNCCCC"), (6, "O", 1.40 + 1.36, 0.0, 0.0), (7, "H", -2.4, 0.0, 0.0)]
    bent = [*hexagon(20, r=1.45, lift=0.25, at=(30.0, 0.0, 0.0)), (26, "O", 30 + 1.45 + 0.3, 0.0, -1.6)]
    chain = [(40, "C", 60.0, 0, 0), (41, "C", 61.5, 0, 0), (42, "C", 62.2, 1.3, 0), (43, "O", 62.2, -1.3, 0)]  # flat, but no ring
    atoms = spark.createDataFrame([(i, e, float(x), float(y), float(z)) for i, e, x, y, z in flat + bent + chain], SCHEMA)
    bonds = {(r.a, r.b) for r in spatial.bonds_of(atoms.where("element != 'H'")).collect()}
    ring = {(k, k + 1) for k in range(5)} | {(0, 5)}
    assert bonds == ring | {(0, 6)} | {(a + 20, b + 20) for a, b in ring} | {(20, 26)} | {(40, 41), (41, 42), (41, 43)}
    assert {r.id for r in spatial.ring_members(spatial.bonds_of(atoms).select("a", "b")).collect()} == {*range(6), *range(20, 26)}
    (flag,) = spatial.ring_flags(atoms).collect()
    assert flag.id == 0 and flag.angle_sum == pytest.approx(360) and flag.shortest_hetero == pytest.approx(1.36) and flag.short_hetero
    assert spatial.ring_flags(atoms, atoms.where("id = 0")).count() == 0


def test_rings_of_random_graphs(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(44)})
    near = {k: {b for e in edges for b in e if k in e and b != k} for k in range(40)}
    on = set()

    def walk(path):
        for b in near[path[-1]]:
            if b == path[0] and len(path) >= 3:
                on.update(path)
            elif b not in path and len(path) < 6:
                walk([*path, b])

    for k in range(40):
        walk([k])
    assert {r.id for r in spatial.ring_members(spark.createDataFrame(edges, "a long, b long"), 6).collect()} == on


def test_rings_where_bonds_are_dense(spark):
    """Paths of up to six bonds are billions here; points off the dense parts are still searched from, at each limit."""
    full = [(a, b) for a in range(60) for b in range(a)]
    halves = [(100 + a, 200 + b) for a in range(40) for b in range(40)]  # no triangles
    hanging = [(0, 300), (300, 301), (301, 1)] + [(0, 310), (310, 311)] + [(100, 320), (320, 321), (321, 322), (322, 101)]
    apart = [(400 + k, 400 + (k + 1) % 6) for k in range(6)] + [(500 + k, 500 + (k + 1) % 7) for k in range(7)]
    edges = full + halves + hanging + apart + [(600, 600), (601, 602), (602, 601), (601, 602)]
    df = spark.createDataFrame(edges, "a long, b long")
    five = {*range(60), 300, 301, *range(100, 140), *range(200, 240)}
    on = {5: five, 6: five | {320, 321, 322} | set(range(400, 406))}
    for longest, want in on.items():
        rows = [r.id for r in spatial.ring_members(df, longest).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want, longest
