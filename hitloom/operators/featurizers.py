"""Featurizers that need tools from outside: a registry with lazy imports and clear errors.

A featurizer turns a text column into a vector column, batch by batch; all
that comes after the vector is ordinary DataFrame work.  A text that can't be
featurized gives null (or the fill value), and ``invalid_count`` tells how many.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class MissingDependency(RuntimeError):
    """A tool that a featurizer needs isn't installed."""


@dataclass(frozen=True)
class Featurizer:
    """A name, the module it needs, and a maker of a function from text to a list of numbers or None."""

    name: str
    module: str
    make: Callable[[], Callable[[str], list[float] | None]]
    width: int

    def available(self) -> bool:
        return importlib.util.find_spec(self.module) is not None


REGISTRY: dict[str, Featurizer] = {}


def register(f: Featurizer) -> Featurizer:
    REGISTRY[f.name] = f
    return f


def _of_molecule(vector: Callable[[object], list[float] | None]) -> Callable[[str], list[float] | None]:
    from rdkit import Chem

    def one(text: str) -> list[float] | None:
        mol = Chem.MolFromSmiles(text)
        return None if mol is None else vector(mol)

    return one


def _circular(features: bool, radius: int = 2, width: int = 2048):
    def make():
        from rdkit.Chem import rdFingerprintGenerator as g

        own = g.GetMorganFeatureAtomInvGen() if features else None
        gen = g.GetMorganGenerator(radius=radius, fpSize=width, atomInvariantsGenerator=own)
        return _of_molecule(lambda mol: [float(x) for x in gen.GetFingerprintAsNumPy(mol)])

    return make


def _reduced_graph():
    from rdkit.Chem import rdReducedGraphs

    return _of_molecule(lambda mol: [float(x) for x in rdReducedGraphs.GetErGFingerprint(mol)])


def _pharmacophore_pairs():
    from rdkit.Chem import rdMolDescriptors as d

    return _of_molecule(lambda mol: [float(x) for x in d.GetHashedAtomPairFingerprintAsBitVect(mol, nBits=2048)])


def _shape(seed: int = 42):
    """Moments of one conformer; a molecule that can't be embedded gives null."""
    from rdkit import Chem
    from rdkit.Chem import AllChem, rdMolDescriptors

    def vector(mol):
        solid = Chem.AddHs(mol)
        if AllChem.EmbedMolecule(solid, randomSeed=seed) != 0:
            return None
        return [float(x) for x in rdMolDescriptors.GetUSRCAT(solid)]

    return _of_molecule(vector)


#: What the tool offers itself; other featurizers are registered by whoever has them.
for _name, _make, _width in (("ecfp4", _circular(False), 2048), ("morgan", _circular(False), 2048), ("fcfp4", _circular(True), 2048), ("erg", _reduced_graph, 315), ("atom_pairs", _pharmacophore_pairs, 2048), ("usrcat", _shape, 60)):
    register(Featurizer(_name, "rdkit", _make, _width))


def require(name: str) -> Featurizer:
    if name not in REGISTRY:
        raise KeyError(f"no featurizer {name}; there are {sorted(REGISTRY)}")
    f = REGISTRY[name]
    if not f.available():
        raise MissingDependency(f"{name} needs {f.module}, which isn't installed")
    return f


def featurize(df: DataFrame, name: str, column: str = "smiles", out: str = "vector", zeros: bool = False) -> DataFrame:
    """df with a vector column; invalid texts give null, or zeros."""
    f = require(name)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = f.make()
        for texts in batches:
            yield pd.Series([None if t is None else one(t) for t in texts])

    vector = run(F.col(column))
    return df.withColumn(out, F.coalesce(vector, F.array_repeat(F.lit(0.0), f.width)) if zeros else vector)


def invalid_count(df: DataFrame, out: str = "vector") -> DataFrame:
    return df.agg(F.count_if(F.col(out).isNull()).alias("n_invalid"), F.count("*").alias("n_rows"))
