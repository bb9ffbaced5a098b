"""The whole run, from map files and sequences to atoms, in stages that a later run takes up where an earlier one ended."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import grid, placement, preparation, registration
from ..session import shared_folder, written
from ..sources import maps
from .extract import checked, extract_sites

KEYS = ["map_id"]
#: Class of the label grid whose voxels hold the sites.
SITE_LABEL = 1


@dataclass
class Manifest:
    """The finished stages of a run below ``folder``, which driver and executors share: a table and an entry for each.

    An entry is written after its table is whole and names it, so a table that was cut short is never read. It holds a
    digest of the stage's name, of what it was given and of all stages before it; a stage whose digest differs, and with
    it all later ones, is built again. ``built`` names the stages that this run built.
    """

    spark: SparkSession
    folder: str
    key: str = ""
    built: list[str] = field(default_factory=list)

    def _entry(self, name: str) -> dict | None:
        try:
            line = self.spark.read.text(f"{self.folder}/manifest/{name}").first()
        except AnalysisException:
            return None
        return json.loads(line["value"]) if line else None

    def stage(self, name: str, given: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: that of an earlier run if it is there, else ``build()``, written."""
        self.key = hashlib.sha256(json.dumps([self.key, name, given], default=str).encode()).hexdigest()
        entry = self._entry(name)
        if entry and entry["key"] == self.key:
            return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(entry["table"])
        made = written(build(), f"{self.folder}/{name}-{uuid.uuid4().hex}")
        line = json.dumps({"key": self.key, "schema": made.schema.jsonValue(), "table": made.inputFiles()[0].rsplit("/", 1)[0]})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{name}")
        self.built.append(name)
        return made


def _map_id(rows: DataFrame) -> DataFrame:
    """``rows`` with map_id, the name of the file without its endings, for path."""
    return rows.withColumn("map_id", F.regexp_extract("path", r"([^/]+?)(\.(mrc|map|ccp4))?(\.(gz|bz2))?$", 1)).drop("path")


def prepared_maps(voxels: DataFrame, grids: DataFrame, contour: float, size: float, target: float) -> DataFrame:
    """map_id, z, y, x, density on a 0..1 scale above ``contour``, at ``target`` spacing and without pieces under ``size``.

    ``grids``: map_id, nz, ny, nx, spacing (x, y, z). A map without any density left gives no row. Components read
    their rows several times, so what is read and what is resampled is written once.
    """
    spacing = {a: F.element_at("spacing", k + 1) for k, a in enumerate("xyz")}
    sized = grids.select("map_id", "nz", "ny", "nx", *[(F.lit(target) / spacing[a]).alias(f"step_{a}") for a in "zyx"], *[spacing[a].alias(f"spacing_{a}") for a in "zyx"])
    folder = shared_folder(voxels.sparkSession)
    told = written(voxels.join(sized.select("map_id", *[f"spacing_{a}" for a in "zyx"]), KEYS), f"{folder}/read")
    masked = preparation.without_dust(told, KEYS, contour, size, tuple(F.col(f"spacing_{a}") for a in "zyx"))
    fine = written(preparation.resample(masked, sized, KEYS, tuple(F.col(f"step_{a}") for a in "zyx")), f"{folder}/fine")
    return grid.normalize_each(preparation.without_dust(fine, KEYS, contour, size, (target,) * 3), KEYS, contour).where("normalized > 0").select("map_id", "z", "y", "x", F.col("normalized").alias("density"))


def world(rows: DataFrame, grids: DataFrame, target: float) -> DataFrame:
    """``rows`` (map_id, z, y, x in voxels of ``target``) with wx, wy, wz, their places; a map's origin stays where it is."""
    out = rows.join(grids.select("map_id", "origin"), KEYS)
    return out.withColumns({f"w{a}": F.col(a) * F.lit(target) + F.element_at("origin", k + 1) for k, a in enumerate("xyz")}).drop("origin")


def built_atoms(sites: DataFrame, base_pairs: DataFrame) -> DataFrame:
    """map_id, residue_num, base, atom_ord, atom, element, x, y, z of every atom of registered ``sites``."""
    one = lambda a, b: base_pairs.select("map_id", F.col(a).cast("int").alias("residue_num"), F.col(b).cast("int").alias("q"))
    partner = one("i", "j").unionByName(one("j", "i")).groupBy("map_id", "residue_num").agg(F.min("q").alias("q"))
    at = sites.select("map_id", F.col("residue_num").alias("q"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    framed = placement.local_frames(sites.select("map_id", "residue_num", "base", "x", "y", "z").join(partner, ["map_id", "residue_num"], "left").join(at, ["map_id", "q"], "left").drop("q"), KEYS)
    return placement.place_templates(framed).select("map_id", "residue_num", "base", "atom_ord", "atom", "element", *[F.col(f"a{a}").alias(a) for a in "xyz"])


def uncovered(sites: DataFrame, residues: DataFrame) -> DataFrame:
    """map_id, residue_num of residues without a site."""
    return residues.select("map_id", "residue_num").join(sites, ["map_id", "residue_num"], "left_anti")


def reconstruct(
    spark: SparkSession,
    folder: str,
    path: str,
    sequences: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    pair: Callable[[DataFrame], DataFrame] | None = None,
    contour: float = 0.0,
    size: float = 25.0,
    target: float = 0.5,
    whole: bool = True,
    version: str = "",
    run: Manifest | None = None,
) -> dict[str, DataFrame]:
    """The tables prepared, labels, sites, pairs, backbone, documents and atoms of the maps at ``path``, keyed by map_id.

    ``sequences``: map_id, sequence (clean letters); maps without one are left out. ``predict`` labels prepared voxels
    (map_id, z, y, x, density to map_id, z, y, x, label), the place of a trained model; ``pair`` proposes pairs of
    sequences (map_id, i < j, residues from 1), none if it is missing. Stages are kept below ``folder``: give the same
    folder to go on with a run that ended early. ``version`` stands for what the digest cannot see, the sequences and the
    two functions. With ``whole`` a sequence that registration does not cover is an error, after its stage was kept.
    """
    run = run or Manifest(spark, folder)
    grids = run.stage("grids", [path, version], lambda: _map_id(maps.read_grids(spark, path)).join(sequences.select("map_id"), KEYS, "left_semi"))
    residues = run.stage("residues", [], lambda: sequences.select("map_id", F.posexplode(F.split("sequence", "")).alias("at", "base")).where("base <> ''").select("map_id", (F.col("at") + 1).alias("residue_num"), "base"))
    prepared = run.stage("prepared", [contour, size, target], lambda: prepared_maps(_map_id(maps.read_maps(spark, path, contour)), grids, contour, size, target))
    labels = run.stage("labels", [], lambda: predict(prepared).where("label > 0").select("map_id", "z", "y", "x", F.col("label").cast("int").alias("label")))
    held = prepared.join(labels.where(F.col("label") == SITE_LABEL).select("map_id", "z", "y", "x"), ["map_id", "z", "y", "x"], "left_semi")
    expected = residues.groupBy("map_id").agg(F.count("*").alias("target"))
    sites = run.stage("sites", [], lambda: extract_sites(held, expected, KEYS, target))
    if whole:
        checked(sites, KEYS)
    number = (F.row_number().over(Window.partitionBy("map_id").orderBy("id")) - 1).cast("long")
    placed = world(sites, grids, target).select("map_id", number.alias("atom"), *[F.col(f"w{a}").alias(a) for a in "xyz"])
    nothing = residues.where("false").select("map_id", F.col("residue_num").alias("i"), F.col("residue_num").alias("j"))
    pairs = run.stage("pairs", [], lambda: pair(sequences).select("map_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")) if pair else nothing)
    around = world(labels, grids, target).select("map_id", "label", *[F.col(a).alias(f"c{a}") for a in "zyx"], *[F.col(f"w{a}").alias(a) for a in "xyz"])
    made: list[registration.Registration] = []

    def registered() -> DataFrame:
        made.append(registration.register(placed, residues, pairs, around, KEYS))
        return made[0].atoms

    backbone = run.stage("backbone", [], registered)
    report = run.stage("report", [], lambda: (made or [registration.register(placed, residues, pairs, around, KEYS)])[0].report)
    featured = run.stage("featured", [], lambda: registration.attach_features(backbone, around, KEYS))
    documents = run.stage("documents", [], lambda: registration.documents(registration.Registration(backbone, report), featured, residues, placed, pairs, KEYS))
    if whole:
        bad = uncovered(backbone, residues.join(grids.select("map_id"), KEYS, "left_semi")).select("map_id").distinct().limit(10).collect()
        if bad:
            raise ValueError("registration does not cover the whole sequence of maps " + ", ".join(r["map_id"] for r in bad))
    atoms = run.stage("atoms", [], lambda: built_atoms(backbone, pairs))
    return {"prepared": prepared, "labels": labels, "sites": sites, "pairs": pairs, "backbone": backbone, "documents": documents, "atoms": atoms}
