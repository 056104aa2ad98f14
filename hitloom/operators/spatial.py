"""Atoms as tables: parsing, range semi-joins on a grid, and geometry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import settled
from ..functions.similarity import angle

C = F.col
POLAR = ("N", "O")


def parse_atoms(lines: DataFrame, column: str = "value") -> DataFrame:
    """ATOM and HETATM records of fixed-width text, one row each."""
    v = C(column)
    cut = lambda a, b: F.trim(F.substring(v, a + 1, b - a))
    name = cut(12, 16)
    rows = lines.where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM"))
    number = lambda a, b: cut(a, b).try_cast("double")
    return rows.select(
        cut(0, 6).alias("record"), name.alias("atom"), F.substring(v, 17, 1).alias("alt_loc"), cut(17, 20).alias("residue"), F.substring(v, 22, 1).alias("chain"), cut(22, 26).alias("residue_number"),
        number(30, 38).alias("x"), number(38, 46).alias("y"), number(46, 54).alias("z"), F.coalesce(F.nullif(cut(76, 78), F.lit("")), F.substring(name, 1, 1)).alias("element"),
    )


def ligand_lines(lines: DataFrame, residue: str, chain: str, alt_loc: str = "A", column: str = "value") -> DataFrame:
    """HETATM lines of one ligand in one chain, of no or the given alternative location; an error if there are none."""
    v = C(column)
    kept = lines.where((F.substring(v, 1, 6) == "HETATM") & (F.trim(F.substring(v, 18, 3)) == residue) & (F.substring(v, 22, 1) == chain) & F.substring(v, 17, 1).isin(" ", alt_loc))
    if kept.isEmpty():
        raise ValueError(f"no HETATM of {residue} in chain {chain}")
    return kept


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def within(points: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """The points with one of the others at most cutoff away: an equi-join of grid cells, then the exact distance.

    Only the others are copied to their 27 neighbouring cells.
    """
    step = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    o = others.select(C("x").alias("ox"), C("y").alias("oy"), C("z").alias("oz"))
    for a in "xyz":
        o = o.withColumn("s_", step).withColumn(f"c{a}", _cell(C(f"o{a}"), cutoff) + C("s_")).drop("s_")
    p = points.withColumns({f"c{a}": _cell(C(a), cutoff) for a in "xyz"})
    d = sum(((C(a) - C(f"o{a}")) * (C(a) - C(f"o{a}")) for a in "xyz"), F.lit(0.0))
    near = (p["cx"] == o["cx"]) & (p["cy"] == o["cy"]) & (p["cz"] == o["cz"]) & (d <= F.lit(cutoff * cutoff))
    return p.join(o, near, "left_semi").drop("cx", "cy", "cz")


def bridging(waters: DataFrame, ligand: DataFrame, protein: DataFrame, cutoff: float) -> DataFrame:
    """Waters near an atom of the ligand and near one of the protein."""
    return within(within(waters, ligand, cutoff), protein, cutoff)


def bridging_waters(atoms: DataFrame, residue: str, cutoff: float = 3.5, water: str = "HOH") -> DataFrame:
    """The same from parsed atoms, over polar atoms."""
    polar = atoms.where(C("element").isin(*POLAR))
    waters = polar.where((C("residue") == water) & (C("element") == "O"))
    return bridging(waters, polar.where(C("residue") == residue), polar.where((C("record") == "ATOM") & (C("residue") != water)), cutoff)


def flat_centres(bonds: DataFrame, limit: float = 355.0) -> DataFrame:
    """Centres with three neighbours whose three angles add up to more than limit degrees.

    bonds: centre, neighbour, and v, the vector from the centre, once for each
    end of a bond.
    """
    v = bonds.groupBy("centre").agg(F.sort_array(F.collect_list(F.struct("neighbour", "v"))).alias("n")).where(F.size("n") == 3)
    total = sum((angle(F.get("n", F.lit(i))["v"], F.get("n", F.lit(j))["v"]) for i, j in ((0, 1), (0, 2), (1, 2))), F.lit(0.0))
    return v.select("centre", total.alias("angle_sum")).where(C("angle_sum") > limit)


#: angstroms; carbon to nitrogen or oxygen: shorter than a single bond
SHORT_BOND = 1.40
#: covalent radii, and how much longer than their sum a bond may be
RADII = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "P": 1.07, "S": 1.05, "Cl": 1.02, "Br": 1.20, "I": 1.39}
SLACK = 0.3


def close_pairs(points: DataFrame, cutoff: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """a < b, their distance and vector a to b, of points (id, x, y, z) at most cutoff apart: an equi-join of grid cells.

    The columns to keep come with a_ and b_ before their names.
    """
    side = lambda s: points.select(C("id").alias(s), *(C(x).alias(f"{s}{x}") for x in "xyz"), *(C(k).alias(f"{s}_{k}") for k in keep))
    step = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    a, b = side("a"), side("b")
    for x in "xyz":
        a = a.withColumn(f"c{x}", _cell(C(f"a{x}"), cutoff))
        b = b.withColumn("s_", step).withColumn(f"c{x}", _cell(C(f"b{x}"), cutoff) + C("s_")).drop("s_")
    v = F.array(*(C(f"b{x}") - C(f"a{x}") for x in "xyz"))
    d = F.sqrt(sum(((C(f"b{x}") - C(f"a{x}")) * (C(f"b{x}") - C(f"a{x}")) for x in "xyz"), F.lit(0.0)))
    met = a.join(b, ["cx", "cy", "cz"]).where(C("a") < C("b"))
    return met.select("a", "b", d.alias("distance"), v.alias("v"), *(f"{s}_{k}" for s in "ab" for k in keep)).where(C("distance") <= cutoff)


def bonds_of(atoms: DataFrame) -> DataFrame:
    """Bonded pairs of atoms (id, element, x, y, z): not farther apart than their radii and a little; unknown elements bond like carbon."""
    pairs = [v for k, r in RADII.items() for v in (F.lit(k), F.lit(r))]
    radius = lambda s: F.coalesce(F.try_element_at(F.create_map(*pairs), C(f"{s}_element")), F.lit(RADII["C"]))
    return close_pairs(atoms, 2 * max(RADII.values()) + SLACK, ("element",)).where(C("distance") <= radius("a") + radius("b") + SLACK)


#: neighbours of each point that the first searches for rings go along
FEW = (4, 32)


def _on_rings(roots: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """id of the roots on a ring of at most ``longest`` bonds along edges (a, b, from a to b): breadth first from every root at once.

    A point is reached through a branch, the root's neighbour that its path
    starts with.  While every point has one branch, paths of different branches
    have no point but the root in common: where they meet, at a point (even
    rings) or over an edge (odd ones), is a ring.  A root that has one is done.
    """
    steps = edges.select(C("a").alias("at"), C("b").alias("next"))
    front = settled(roots.join(steps, C("id") == C("at")).select("id", C("next").alias("at"), C("next").alias("branch")), "reached")
    seen, found = front, None
    for depth in range(1, (longest - 1) // 2 + 1):
        met = front.join(steps, "at").where(C("next") != C("id")).groupBy("id", C("next").alias("at")).agg(F.min("branch").alias("low"), F.max("branch").alias("high"))
        met = met.join(seen.withColumnRenamed("branch", "own"), ["id", "at"], "left")
        on = C("own").isNotNull() & ((C("low") != C("own")) | (C("high") != C("own")))
        if 2 * depth + 2 <= longest:
            on = on | (C("low") != C("high"))
        met = settled(met.select("id", "at", "low", C("own").isNull().alias("new"), on.alias("on")), "met")
        done = met.where("on").select("id").distinct()
        found = done if found is None else found.unionByName(done)
        if 2 * depth + 3 <= longest:
            front = settled(met.where("new").join(done, "id", "left_anti").select("id", "at", C("low").alias("branch")), "reached")
            seen = seen.unionByName(front)
    return found


def ring_members(bonds: DataFrame, longest: int = 8) -> DataFrame:
    """id of all points on a cycle of at most ``longest`` bonds (a, b).

    Each point is searched from on its own, to half the length.  Where bonds are
    dense, nearly all points have a ring along a few bonds of each point, so
    these are tried first; points that have none there are searched from along
    all bonds.  What leads to a point with one bond is left out.
    """
    bonds = bonds.where("a != b")
    edges = bonds.select("a", "b").unionByName(bonds.select(C("b").alias("a"), C("a").alias("b"))).distinct()
    if longest < 3:
        return edges.select(C("a").alias("id")).limit(0)
    edges = settled(edges, "edges")
    inner = edges.groupBy(C("a").alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("id")
    edges = settled(edges.join(inner.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "edges")
    left = settled(edges.select(C("a").alias("id")).distinct().join(inner, "id", "left_semi"), "points")
    first = Window.partitionBy("a").orderBy(F.xxhash64("b"), "b")
    some = settled(edges.withColumn("k", F.row_number().over(first)).where(C("k") <= FEW[-1]), "some")
    found = None
    for along in (*(some.where(C("k") <= n) for n in FEW), edges):
        own = settled(_on_rings(left, along, longest).distinct(), "rings")
        found = own if found is None else found.unionByName(own)
        left = settled(left.join(own, "id", "left_anti"), "points")
        if left.isEmpty():
            break
    return found


def ring_flags(atoms: DataFrame, assigned: DataFrame | None = None, limit: float = 355.0, longest: int = 8) -> DataFrame:
    """Ring carbons with three neighbours in one plane: id, angle_sum, shortest_hetero (to N or O, null without) and short_hetero.

    assigned: ids of atoms whose assigned chemistry is planar (aromatic, or
    with a double bond), which are no finding.  Hydrogens are left out.
    """
    heavy = atoms.where("element != 'H'")
    bonds = bonds_of(heavy)
    back = bonds.select(C("b").alias("centre"), C("a").alias("neighbour"), C("b_element").alias("own"), C("a_element").alias("element"), "distance", F.transform("v", lambda x: -x).alias("v"))
    both = bonds.select(C("a").alias("centre"), C("b").alias("neighbour"), C("a_element").alias("own"), C("b_element").alias("element"), "distance", "v").unionByName(back)
    flat = flat_centres(both.where("own = 'C'").select("centre", "neighbour", "v"), limit)
    hetero = both.where(C("element").isin(*POLAR)).groupBy("centre").agg(F.min("distance").alias("shortest_hetero"))
    found = flat.join(ring_members(bonds.select("a", "b"), longest).withColumnRenamed("id", "centre"), "centre", "left_semi").join(hetero, "centre", "left")
    if assigned is not None:
        found = found.join(assigned.select(C("id").alias("centre")), "centre", "left_anti")
    return found.select(C("centre").alias("id"), "angle_sum", "shortest_hetero", F.coalesce(C("shortest_hetero") < SHORT_BOND, F.lit(False)).alias("short_hetero"))


def proximity_bonus(features: DataFrame, references: DataFrame) -> DataFrame:
    """row_idx and bonus: over reference points, 1 less nearest feature of its type over its cutoff, not below 0.

    features: row_idx, type, xyz.  references: name, type, xyz, cutoff (a
    driver-sized list of points).
    """
    d = F.sqrt(F.aggregate(F.zip_with(C("xyz"), C("rxyz"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    r = references.select("name", "type", C("xyz").alias("rxyz"), "cutoff")
    near = features.join(r, "type").groupBy("row_idx", "name", "cutoff").agg(F.min(d).alias("d"))
    return near.groupBy("row_idx").agg(F.sum(F.greatest(F.lit(0.0), 1 - C("d") / C("cutoff"))).alias("bonus"))
