"""A stored lattice of roll-ups: edges at layer, module and file for both ends, from which any drill-down is read.

Each of the nine tables is rolled up from the next finer one, not from the
edges. A view takes cells as they are stored, and subtraction where a module
shows some of its files: the rest is the module's cell less those of the files
that are shown. So a view reads cells of what it opens, and never edges again.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.durable import stored
from ..sources.versions import open_version, publish
from .levels import SHOWN_FILES

GRAINS = {"layer": ("layer",), "module": ("layer", "module"), "file": ("layer", "module", "file")}
_COARSER = {"module": "file", "layer": "module"}


def _keys(a: str, b: str) -> list[str]:
    return [f"a_{c}" for c in GRAINS[a]] + [f"b_{c}" for c in GRAINS[b]]


def build(edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The relations of the lattice: ``<grain>_<grain>`` with the keys of both ends, weight and resolved_weight, and ``degrees`` of files.

    Edges to unknown files are in no cell, but count for a file's degree.
    """
    place = files.select("rel_path", "module", "layer")
    side = lambda p, c: place.select(F.col("rel_path").alias(c), F.col("module").alias(f"{p}_module"), F.col("layer").alias(f"{p}_layer"))
    placed = edges.select("from_file", "to_file", "confidence").join(side("a", "from_file"), "from_file").join(side("b", "to_file"), "to_file")
    placed = placed.withColumnsRenamed({"from_file": "a_file", "to_file": "b_file"})
    sure = F.sum((F.col("confidence") == "resolved").cast("long")).alias("resolved_weight")
    made = {("file", "file"): stored(placed.groupBy(*_keys("file", "file")).agg(F.count("*").alias("weight"), sure), "lattice")}
    for a, b in (("file", "module"), ("module", "file"), ("module", "module"), ("file", "layer"), ("layer", "file"), ("module", "layer"), ("layer", "module"), ("layer", "layer")):
        finer = made[(a, _COARSER[b])] if b in _COARSER else made[(_COARSER[a], b)]
        made[a, b] = stored(finer.groupBy(*_keys(a, b)).agg(F.sum("weight").alias("weight"), F.sum("resolved_weight").alias("resolved_weight")), "lattice")
    both = edges.select(F.inline(F.array(F.struct(F.col("from_file").alias("rel_path")), F.struct(F.col("to_file").alias("rel_path")))))
    degrees = place.join(both.groupBy("rel_path").agg(F.count("*").alias("degree")), "rel_path", "left")
    out = {f"{a}_{b}": df for (a, b), df in made.items()}
    # what a drill-down asks for lies together
    for name, key in (("file_file", "a_module"), ("file_module", "a_module"), ("file_layer", "a_module"), ("module_file", "b_module"), ("layer_file", "b_module")):
        out[name] = out[name].repartitionByRange(key, *(c for c in out[name].columns if c.endswith("_file"))).sortWithinPartitions(key)
    return {**out, "degrees": degrees.repartitionByRange("module", "rel_path").sortWithinPartitions("module")}


def save(edges: DataFrame, files: DataFrame, path: str) -> dict:
    return publish(build(edges, files), path)


class Lattice:
    """An opened version of the lattice; what is published later is not seen."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        found = open_version(spark, path, version)
        if not found or "layer_layer" not in found:
            raise ValueError(f"no lattice at {path}")
        self.cells = found

    def module_matrix(self) -> DataFrame:
        """``levels.module_matrix`` from the cells."""
        rows = self.cells["module_module"].select(F.col("a_module").alias("from_id"), F.col("b_module").alias("to_id"), "weight", "resolved_weight")
        return self._summed(rows)

    def _summed(self, rows: DataFrame) -> DataFrame:
        kept = rows.where("from_id is not null and to_id is not null and from_id != to_id").groupBy("from_id", "to_id")
        return kept.agg(F.sum("weight").alias("weight"), F.sum("resolved_weight").alias("resolved_weight")).where("weight > 0")

    def _top(self, modules: tuple[str, ...], shown: int) -> DataFrame:
        inside = self.cells["degrees"].where(F.col("module").isin(*modules) & F.col("degree").isNotNull())
        rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("degree"), "rel_path"))
        return stored(inside.withColumn("r", rank).where(F.col("r") <= shown).select("rel_path"), "shown")

    def level(self, layers: tuple[str, ...] = (), modules: tuple[str, ...] = (), shown: int = SHOWN_FILES) -> DataFrame:
        """``levels.level`` from the cells: (from_id, to_id, weight, resolved_weight) between visible containers."""
        opened = set(layers)
        if modules:
            opened |= {r.layer for r in self.cells["degrees"].where(F.col("module").isin(*modules)).select("layer").distinct().collect() if r.layer is not None}
        top = self._top(modules, shown) if modules else None
        is_open = lambda p: F.coalesce(F.col(f"{p}_layer").isin(*opened), F.lit(False)) if opened else F.lit(False)
        is_split = lambda p: F.coalesce(F.col(f"{p}_module").isin(*modules), F.lit(False)) if modules else F.lit(False)

        def named(p: str, grain: str) -> tuple[Column, Column]:
            """Which cells of a grain a view shows at one end, and as what: (node, sign) once or twice."""
            one = lambda kind, c, sign: F.struct(F.concat(F.lit(f"{kind}:"), F.col(f"{p}_{c}")).alias("node"), F.lit(sign).alias("sign"))
            if grain == "layer":
                return ~is_open(p), F.array(one("layer", "layer", 1))
            if grain == "module":
                kind = F.when(is_split(p), F.lit("more:")).otherwise(F.lit("module:"))
                return is_open(p) | is_split(p), F.array(F.struct(F.concat(kind, F.col(f"{p}_module")).alias("node"), F.lit(1).alias("sign")))
            return is_split(p), F.array(one("file", "file", 1), one("more", "module", -1))

        grains = ["layer", *(["module"] if opened else []), *(["file"] if modules else [])]
        parts = []
        for a, b in product(grains, grains):
            (seen_a, node_a), (seen_b, node_b) = named("a", a), named("b", b)
            rows = self.cells[f"{a}_{b}"].where(seen_a & seen_b)
            for p, grain in (("a", a), ("b", b)):
                if grain == "file":
                    rows = rows.join(top.withColumnRenamed("rel_path", f"{p}_file"), f"{p}_file", "left_semi")
            rows = rows.select(F.explode(node_a).alias("x"), node_b.alias("ys"), "weight", "resolved_weight").select("x", F.explode("ys").alias("y"), "weight", "resolved_weight")
            sign = F.col("x.sign") * F.col("y.sign")
            parts.append(rows.select(F.col("x.node").alias("from_id"), F.col("y.node").alias("to_id"), (F.col("weight") * sign).alias("weight"), (F.col("resolved_weight") * sign).alias("resolved_weight")))
        return self._summed(reduce(DataFrame.unionByName, parts))
