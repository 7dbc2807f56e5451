"""Views read from stored roll-ups equal those computed from all edges."""

import random

import pytest

from codestrata.operators import levels
from codestrata.operators.lattice import Lattice, save


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    """Modules that span layers, files without module or layer, files without edges, edges to unknown files and to themselves, repeated edges."""
    rng = random.Random(7)
    files = [(f"f{i}", rng.choice(["m1", "m2", "m3", "m4"]), rng.choice(["ui", "api", "db"])) for i in range(80)] + [("g1", None, "ui"), ("g2", "m1", None), ("g3", None, None), ("alone", "m1", "ui")]
    names = [f[0] for f in files[:-1]] + ["unknown"]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["resolved", "inferred"])) for _ in range(500)]
    f, e = spark.createDataFrame(files, "rel_path string, module string, layer string"), spark.createDataFrame(edges + edges[:30], "from_file string, to_file string, confidence string")
    path = f"file://{tmp_path_factory.mktemp('l')}/l"
    save(e, f, path)
    return e, f, Lattice(spark, path)


@pytest.mark.parametrize(("layers", "modules", "shown"), [((), (), 150), (("ui",), (), 150), ((), ("m1",), 4), (("db",), ("m1", "m3"), 3), ((), ("m2",), 150), ((), ("nothing",), 5)])
def test_views(estate, layers, modules, shown):
    e, f, lattice = estate
    want = sorted(tuple(r) for r in levels.level(e, f, layers, modules, shown).collect())
    assert sorted(tuple(r) for r in lattice.level(layers, modules, shown).collect()) == want and want


def test_matrix_and_sizes(estate):
    e, f, lattice = estate
    assert sorted(map(tuple, lattice.module_matrix().collect())) == sorted(map(tuple, levels.module_matrix(e, f).collect()))
    total = {name: df.groupBy().sum("weight").first()[0] for name, df in lattice.cells.items() if name != "degrees"}
    assert len(total) == 9 and len(set(total.values())) == 1


def test_empty(spark, tmp_path):
    save(spark.createDataFrame([], "from_file string, to_file string, confidence string"), spark.createDataFrame([], "rel_path string, module string, layer string"), path := f"file://{tmp_path}/l")
    assert Lattice(spark, path).level(("a",), ("m",)).isEmpty() and Lattice(spark, path).module_matrix().isEmpty()
